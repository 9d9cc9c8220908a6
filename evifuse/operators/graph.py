"""Money-and-contact graph between entities, as node and edge frames."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evifuse.functions.fields import institution
from evifuse.functions.geo import node_city
from evifuse.operators.keyed import top_per_key
from evifuse.operators.scoring import tier_rank
from evifuse.operators.temporal import CALL_TYPES


def transfers(events: DataFrame, index: DataFrame) -> DataFrame:
    """Directed transfers with both ends known: a debit leaves the entity, a credit reaches it."""
    look = index.select(F.col("identifier").alias("counterparty"), F.col("entity_id").alias("_other"))
    d = (
        events.where("event_type = 'transaction' and amount <> 0 and entity_id is not null and counterparty is not null")
        .select("entity_id", "counterparty", "amount", "us", "raw_row_ref", "source_file")
        .join(look, "counterparty")
    )
    debit = F.col("amount") < 0
    return d.select(
        F.when(debit, F.col("entity_id")).otherwise(F.col("_other")).alias("src"),
        F.when(debit, F.col("_other")).otherwise(F.col("entity_id")).alias("dst"),
        F.abs("amount").alias("amt"),
        debit.alias("is_debit"),
        "us",
        "raw_row_ref",
        F.coalesce("source_file", F.lit("unknown")).alias("source_file"),
    )


def contacts(events: DataFrame, phones: DataFrame) -> DataFrame:
    """Calls and messages between two different known entities."""
    look = phones.select(F.col("identifier").alias("counterparty"), F.col("entity_id").alias("dst"))
    return (
        events.where(F.col("event_type").isin(*CALL_TYPES) & F.col("entity_id").isNotNull() & F.col("counterparty").isNotNull())
        .select(F.col("entity_id").alias("src"), "counterparty", "us", "raw_row_ref", F.coalesce("source_file", F.lit("unknown")).alias("source_file"))
        .join(look, "counterparty")
        .where("src <> dst")
    )


def flow_edges(moves: DataFrame) -> DataFrame:
    """One edge per (src, dst); when the pair has debits, its credits are the same money seen
    from the other side and are left out.

    Rows are first added up per (pair, side, file), which is a plain hash aggregate on
    the map side; both versions of a pair are then formed and one is kept, so the rows of
    a pair are never gathered. The file is the one that speaks of the pair first.
    """
    units = F.round(F.col("amt") * 10_000).cast("bigint")
    part = moves.groupBy("src", "dst", "is_debit", "source_file").agg(
        F.sum(units).alias("w"), F.count(F.lit(1)).alias("n"), F.min("us").alias("a"), F.max("us").alias("z")
    )
    d = F.col("is_debit")

    def side(cond: Column, tag: str) -> list[Column]:
        return [
            F.sum(F.when(cond, F.col("w"))).alias(f"w{tag}"),
            F.sum(F.when(cond, F.col("n"))).alias(f"n{tag}"),
            F.min_by("source_file", F.when(cond, F.struct("a", "source_file"))).alias(f"f{tag}"),
            F.min(F.when(cond, F.col("a"))).alias(f"a{tag}"),
            F.max(F.when(cond, F.col("z"))).alias(f"z{tag}"),
        ]

    g = part.groupBy("src", "dst").agg(*side(d, "d"), *side(~d, "c"))
    has = F.col("nd").isNotNull()

    def pick(c: str) -> Column:
        return F.when(has, F.col(f"{c}d")).otherwise(F.col(f"{c}c"))

    return g.select(
        "src", "dst", (pick("w") / 10_000).alias("weight"), pick("n").alias("count"),
        pick("f").alias("source_file"), has.alias("counted_from_debit"),
        pick("a").alias("first_us"), pick("z").alias("last_us"),
    )


def call_edges(talks: DataFrame) -> DataFrame:
    """One edge per (src, dst) with its number of calls, added up per file first."""
    part = talks.groupBy("src", "dst", "source_file").agg(
        F.count(F.lit(1)).alias("n"), F.min("us").alias("a"), F.max("us").alias("z")
    )
    return part.groupBy("src", "dst").agg(
        F.sum("n").alias("call_frequency"),
        F.min_by("source_file", F.struct("a", "source_file")).alias("source_file"),
        F.min("a").alias("first_us"),
        F.max("z").alias("last_us"),
    )


def merged_edges(flows: DataFrame, calls: DataFrame) -> DataFrame:
    """All edges; a pair that moved money and talked is one transaction edge."""
    c = calls.select(
        "src", "dst", "call_frequency", F.col("source_file").alias("_f"), F.col("first_us").alias("_a"), F.col("last_us").alias("_z")
    )
    money = F.col("weight").isNotNull()
    return flows.join(c, ["src", "dst"], "full").select(
        "src", "dst",
        F.when(money, "transaction").otherwise("call").alias("edge_type"),
        F.coalesce("weight", F.col("call_frequency") * 100.0).alias("weight"),
        F.coalesce("count", "call_frequency").alias("count"),
        "call_frequency",
        F.coalesce("source_file", "_f").alias("source_file"),
        institution(F.coalesce("source_file", "_f")).alias("institution"),
        "counted_from_debit",
        F.least("first_us", "_a").alias("first_us"),
        F.greatest("last_us", "_z").alias("last_us"),
    )


def build_edges(events: DataFrame, index: DataFrame, phones: DataFrame) -> DataFrame:
    return merged_edges(flow_edges(transfers(events, index)), call_edges(contacts(events, phones)))


def node_places(events: DataFrame) -> DataFrame:
    """Institutions, source files and cities of each entity, as long distinct rows."""
    return (
        events.where("entity_id is not null and entity_id <> ''")
        .select(
            "entity_id",
            F.explode(
                F.array(
                    F.struct(F.lit("institution").alias("kind"), F.when(F.col("source_file").isNotNull(), institution(F.col("source_file"))).alias("value")),
                    F.struct(F.lit("source_file").alias("kind"), F.col("source_file").alias("value")),
                    F.struct(F.lit("city").alias("kind"), node_city(F.col("location")).alias("value")),
                )
            ).alias("x"),
        )
        .select("entity_id", "x.kind", "x.value")
        .where("value is not null")
        .distinct()
    )


def node_attributes(places: DataFrame) -> DataFrame:
    """One row per entity with all its sorted institutions, files and cities; ``node_places`` is the long form."""

    def values(kind: str) -> Column:
        return F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.col("value"))))

    return places.groupBy("entity_id").agg(
        F.min(F.when(F.col("kind") == "institution", F.col("value"))).alias("institution"),
        values("institution").alias("institutions"),
        values("source_file").alias("source_files"),
        values("city").alias("cities"),
    )


def chain_hops(best: DataFrame) -> DataFrame:
    """Distinct (src, dst) hops of the reported layering chains."""
    n = F.size("path") - 1
    return (
        best.select(F.explode(F.arrays_zip(F.slice("path", 1, n).alias("src"), F.slice("path", 2, n).alias("dst"))).alias("h"))
        .select("h.src", "h.dst")
        .distinct()
    )


def distinct_chains(best: DataFrame) -> DataFrame:
    """Each reported path once, with the first entity it was detected on."""
    return best.where(F.size("path") >= 2).groupBy("path").agg(F.min("origin").alias("detected_on"))


def classify_edges(edges: DataFrame, hops: DataFrame, firings: DataFrame) -> DataFrame:
    """Edge class: hop of a chain, transfer at an entity with a timing rule, transfer, call."""
    timing = firings.where(F.col("rule_id").isin("TCS-1", "TCS-2")).select("entity_id").distinct()
    a = timing.select(F.col("entity_id").alias("src"), F.lit(True).alias("_s"))
    b = timing.select(F.col("entity_id").alias("dst"), F.lit(True).alias("_d"))
    money = F.col("edge_type") == "transaction"
    return (
        edges.join(hops.withColumn("_h", F.lit(True)), ["src", "dst"], "left")
        .join(a, "src", "left")
        .join(b, "dst", "left")
        .withColumn(
            "edge_class",
            F.when(F.col("_h").isNotNull(), "layering")
            .when(money & (F.col("_s").isNotNull() | F.col("_d").isNotNull()), "smoking_gun")
            .when(money, "transaction")
            .otherwise("call"),
        )
        .withColumn("amount", F.when(money, F.col("weight")).otherwise(0.0))
        .drop("_h", "_s", "_d")
    )


def value_in_out(edges: DataFrame) -> DataFrame:
    """Money into and out of each entity, over transaction edges."""
    w = F.round(F.col("weight") * 10_000).cast("bigint")
    return (
        edges.where("edge_type = 'transaction'")
        .select(
            F.explode(
                F.array(
                    F.struct(F.col("src").alias("entity_id"), F.lit(0).cast("bigint").alias("i"), w.alias("o")),
                    F.struct(F.col("dst").alias("entity_id"), w.alias("i"), F.lit(0).cast("bigint").alias("o")),
                )
            ).alias("x")
        )
        .groupBy("x.entity_id")
        .agg((F.sum("x.i") / 10_000).alias("value_in"), (F.sum("x.o") / 10_000).alias("value_out"))
    )


def degrees(edges: DataFrame) -> DataFrame:
    """Edges at each node; an edge to itself counts at both ends."""
    return (
        edges.select(F.explode(F.array("src", "dst")).alias("entity_id"))
        .groupBy("entity_id")
        .agg(F.count(F.lit(1)).alias("degree"))
    )


def ranked_nodes(edges: DataFrame, scored: DataFrame) -> DataFrame:
    """Every node with its degree and tier."""
    return degrees(edges).join(scored.select("entity_id", "risk_tier"), "entity_id", "full").select(
        "entity_id",
        F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"),
        F.coalesce("risk_tier", F.lit("LOW")).alias("risk_tier"),
    )


# A node is worth drawing if it is connected, or flagged MEDIUM and above.
WORTH_DRAWING = "degree > 0 or risk_tier in ('CRITICAL', 'HIGH', 'MEDIUM')"


def visible_nodes(edges: DataFrame, scored: DataFrame, max_nodes: int | None = None) -> DataFrame:
    """Nodes worth drawing: connected, or flagged MEDIUM and above.

    A cap keeps the worst tiers and, inside a tier, the best connected.
    """
    v = ranked_nodes(edges, scored).where(WORTH_DRAWING)
    if max_nodes is None:
        return v
    return v.orderBy(tier_rank(F.col("risk_tier")), F.desc("degree"), "entity_id").limit(max_nodes)


def visible_counts(edges: DataFrame, scored: DataFrame, max_nodes: int) -> DataFrame:
    """One row: all nodes, those worth drawing, the isolated ones left out, and whether a cap of ``max_nodes`` cuts the view."""
    both = ranked_nodes(edges, scored).agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.expr(WORTH_DRAWING)).alias("visible"))
    return both.select("nodes", "visible", (F.col("nodes") - F.col("visible")).alias("hidden_isolated"), (F.col("visible") > max_nodes).alias("truncated"))


def graph_meta(classed: DataFrame) -> DataFrame:
    """Counts, total value and the ranges a filter can offer; one row."""
    money = F.col("edge_type") == "transaction"
    amount = F.when(money & (F.col("weight") > 0), F.col("weight"))
    return classed.agg(
        F.count(F.lit(1)).alias("edges"),
        F.count_if(money).alias("transaction_edges"),
        F.count_if(~money).alias("call_edges"),
        F.count_if(F.col("edge_class") == "layering").alias("layering_edges"),
        F.count_if(F.col("edge_class") == "smoking_gun").alias("smoking_gun_edges"),
        (F.coalesce(F.sum(F.when(money, F.round(F.col("weight") * 10_000).cast("bigint"))), F.lit(0)) / 10_000).alias("total_value"),
        F.coalesce(F.min(amount), F.lit(0.0)).alias("amount_min"),
        F.coalesce(F.max(amount), F.lit(0.0)).alias("amount_max"),
        F.min("first_us").alias("time_min_us"),
        F.max("last_us").alias("time_max_us"),
    )


def graph_facets(places: DataFrame, firings: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Option lists for filters: distinct cities and rules, and identifier kinds."""
    out = places.where("kind = 'city'").select(F.lit("city").alias("facet"), "value").unionByName(
        firings.select(F.lit("rule").alias("facet"), F.col("rule_id").alias("value"))
    )
    if members is not None:
        out = out.unionByName(members.select(F.lit("id_type").alias("facet"), F.col("id_type").alias("value")))
    return out.distinct()


def identity_view(
    members: DataFrame, ownership: DataFrame, scored: DataFrame, attributes: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the identifier graph."""
    nodes = (
        members.join(scored.select("entity_id", "risk_tier"), "entity_id", "left")
        .join(attributes.select("entity_id", "institution"), "entity_id", "left")
        .select(
            "identifier", "id_type", "entity_id",
            F.coalesce("risk_tier", F.lit("LOW")).alias("risk_tier"),
            F.coalesce("institution", F.lit("Unknown")).alias("institution"),
        )
    )
    return nodes, ownership.select("src", "dst", "source")


def neighbours(edges: DataFrame) -> DataFrame:
    """Total weight between each entity and each other entity, both directions."""
    units = F.round(F.col("weight") * 10_000).cast("bigint")
    return (
        edges.where("src <> dst")
        .select(
            F.explode(
                F.array(
                    F.struct(F.col("src").alias("entity_id"), F.col("dst").alias("other"), units.alias("w")),
                    F.struct(F.col("dst").alias("entity_id"), F.col("src").alias("other"), units.alias("w")),
                )
            ).alias("x")
        )
        .groupBy("x.entity_id", "x.other")
        .agg((F.sum("x.w") / 10_000).alias("weight"))
    )


def ego_view(edges: DataFrame, k: int = 10) -> DataFrame:
    """The k heaviest counterparties of every entity and how many more it has."""
    near = neighbours(edges)
    total = near.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
    top = top_per_key(near, ["entity_id"], [F.desc("weight"), F.asc("other")], k)
    return top.join(total, "entity_id").select(
        "entity_id", "rank", "other", "weight", F.greatest(F.col("n") - k, F.lit(0)).cast("bigint").alias("remaining")
    )


def direct_counterparties(edges: DataFrame, scored: DataFrame, k: int = 15) -> DataFrame:
    """The k largest edges of every entity with their direction and the other side's tier."""
    rows = edges.select(
        F.explode(
            F.array(
                F.struct(F.col("src").alias("entity_id"), F.col("dst").alias("other"), F.lit("out").alias("direction")),
                F.struct(F.col("dst").alias("entity_id"), F.col("src").alias("other"), F.lit("in").alias("direction")),
            )
        ).alias("x"),
        "edge_type",
        F.col("weight").alias("amount"),
    ).select("x.*", "edge_type", "amount")
    top = top_per_key(rows, ["entity_id"], [F.desc("amount"), F.asc("other"), F.asc("direction")], k)
    tiers = scored.select(F.col("entity_id").alias("other"), F.col("risk_tier").alias("tier"))
    return top.join(tiers, "other", "left").withColumn("tier", F.coalesce("tier", F.lit("LOW")))


def money_flow_totals(edges: DataFrame) -> DataFrame:
    money = F.col("edge_type") == "transaction"
    return edges.agg(
        F.count_if(money).alias("transfer_edges"),
        F.count_if(~money).alias("call_edges"),
        (F.coalesce(F.sum(F.when(money, F.round(F.col("weight") * 10_000).cast("bigint"))), F.lit(0)) / 10_000).alias("total_transferred"),
    )


def largest_transfers(edges: DataFrame, scored: DataFrame, k: int = 12) -> DataFrame:
    top = (
        edges.where("edge_type = 'transaction'")
        .orderBy(F.desc("weight"), "src", "dst")
        .limit(k)
        .select("src", "dst", F.col("weight").alias("amount"), "count")
    )
    t = scored.select("entity_id", "risk_tier")
    a = t.select(F.col("entity_id").alias("src"), F.col("risk_tier").alias("src_tier"))
    b = t.select(F.col("entity_id").alias("dst"), F.col("risk_tier").alias("dst_tier"))
    return (
        top.join(a, "src", "left").join(b, "dst", "left")
        .withColumn("src_tier", F.coalesce("src_tier", F.lit("LOW")))
        .withColumn("dst_tier", F.coalesce("dst_tier", F.lit("LOW")))
    )


# ------------------------------------------------------------------ filters, search

# Tiers that a "tier at least" filter keeps.
AT_LEAST = {"CRITICAL": ("CRITICAL",), "HIGH": ("CRITICAL", "HIGH"), "MEDIUM": ("CRITICAL", "HIGH", "MEDIUM")}


def filter_edges(
    edges: DataFrame,
    money_only: bool = False,
    layering_only: bool = False,
    amount_min: float = 0,
    from_us: int | None = None,
    to_us: int | None = None,
) -> DataFrame:
    """Edges by their own fields. Calls carry no amount and pass the amount filter; an edge
    passes the time filter when its span overlaps the range."""
    d = edges
    if money_only:
        d = d.where("edge_type = 'transaction'")
    if layering_only:
        d = d.where("edge_class = 'layering'")
    if amount_min:
        d = d.where((F.col("edge_type") != "transaction") | (F.col("weight") >= amount_min))
    ends = F.coalesce("last_us", "first_us")
    if from_us is not None:
        d = d.where(ends.isNull() | (ends >= from_us))
    if to_us is not None:
        d = d.where(F.col("first_us").isNull() | (F.col("first_us") <= to_us))
    return d


def filter_nodes(
    nodes: DataFrame,
    tier_at_least: str | None = None,
    rule: str | None = None,
    places: DataFrame | None = None,
    city: str | None = None,
    flagged: bool = False,
    id_type: str | None = None,
) -> DataFrame:
    """Nodes (entity_id, risk_tier, rules_fired ...) by their own fields."""
    d = nodes
    if flagged:
        d = d.where("risk_tier <> 'LOW'")
    if id_type:
        d = d.where(F.col("id_type") == id_type)
    if tier_at_least:
        d = d.where(F.col("risk_tier").isin(*AT_LEAST[tier_at_least]))
    if rule:
        d = d.where(F.array_contains("rules_fired", rule))
    if city:
        there = places.where((F.col("kind") == "city") & (F.col("value") == city)).select("entity_id")
        d = d.join(there, "entity_id", "left_semi")
    return d


def search_nodes(nodes: DataFrame, edges: DataFrame, members: DataFrame, term: str) -> DataFrame:
    """Entities whose id, name, phone or account contains the term, and their neighbours."""
    t = term.strip().lower()
    hit = F.lower("entity_id").contains(t)
    if "name" in nodes.columns:
        hit = hit | F.coalesce(F.lower("name").contains(t), F.lit(False))
    by_self = nodes.where(hit).select("entity_id")
    by_id = members.where(F.col("id_type").isin("phone", "account") & F.lower("identifier").contains(t)).select("entity_id")
    hits = by_self.unionByName(by_id).distinct()
    there = edges.join(hits.withColumnRenamed("entity_id", "src"), "src", "left_semi").select(F.col("dst").alias("entity_id"))
    back = edges.join(hits.withColumnRenamed("entity_id", "dst"), "dst", "left_semi").select(F.col("src").alias("entity_id"))
    keep = hits.unionByName(there).unionByName(back).distinct()
    return nodes.join(keep, "entity_id", "left_semi")


def consistent_view(nodes: DataFrame, edges: DataFrame, edge_filter_on: bool) -> tuple[DataFrame, DataFrame]:
    """Edges keep both ends visible; with an edge filter on, nodes left without one go."""
    ids = nodes.select("entity_id")
    e = edges.join(ids.withColumnRenamed("entity_id", "src"), "src", "left_semi").join(
        ids.withColumnRenamed("entity_id", "dst"), "dst", "left_semi"
    )
    if not edge_filter_on:
        return nodes, e
    ends = e.select(F.explode(F.array("src", "dst")).alias("entity_id")).distinct()
    return nodes.join(ends, "entity_id", "left_semi"), e


def figure_view(
    edges: DataFrame, scored: DataFrame, rules: tuple[str, ...] = (), min_amount: float = 0
) -> tuple[DataFrame, DataFrame]:
    """Flagged nodes (optionally with one of ``rules``), their neighbours, and the edges among
    them; everything when nothing is flagged."""
    seed = scored.where(F.col("risk_tier").isin("CRITICAL", "HIGH", "MEDIUM"))
    if rules:
        seed = seed.where(F.arrays_overlap("rules_fired", F.array(*[F.lit(r) for r in rules])))
    seed = seed.select("entity_id")
    if seed.isEmpty():
        nodes = edges.select(F.explode(F.array("src", "dst")).alias("entity_id")).unionByName(scored.select("entity_id")).distinct()
    else:
        there = edges.join(seed.withColumnRenamed("entity_id", "src"), "src", "left_semi").select(F.col("dst").alias("entity_id"))
        back = edges.join(seed.withColumnRenamed("entity_id", "dst"), "dst", "left_semi").select(F.col("src").alias("entity_id"))
        nodes = seed.unionByName(there).unionByName(back).distinct()
    return consistent_view(nodes, filter_edges(edges, amount_min=min_amount), False)
