"""Identifiers to entities.

Frames are long: ``kyc`` (entry, name, id_type, identifier), ``nodes`` (identifier,
id_type), ``edges`` (src, dst), ``members`` (entity_id, identifier, id_type). Lists per
entity are only built for display, with a fixed length.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from evifuse.functions.fields import digits, identifier_type, present
from evifuse.operators.keyed import top_per_key
from evifuse.session import at_once, cut

# Order in which the kinds of identifier are listed.
ID_TYPES = ("phone", "account", "vpa", "imei", "ip")
# Edges that a task connects at once.
LOCAL_EDGES = 2_000_000
# (characters of a group, groups of a window), widest first: a grid serves phrases of their sum less one and more.
GRIDS = ((6, 11), (4, 5), (4, 1), (3, 1), (2, 1), (1, 1))
SAMPLE_CHARS = 1 << 16
# Anchors that tasks get to leave out other samples before the join, at most (8 bytes each).
SENT_ANCHORS = 1_000_000


def kyc_from_events(bank: DataFrame, cdr: DataFrame, ipdr: DataFrame) -> DataFrame:
    """Ownership seen in the events themselves: a number with its devices and addresses,
    an account with itself. A caller is never tied to a callee, nor an account to a payee."""

    def rows(df: DataFrame, **held: str) -> DataFrame:
        """One pass of ``df``: its pairs of reference and identifier, cleaned once each."""
        each = F.explode(F.array(*[F.struct(F.lit(t).alias("id_type"), F.col(c).alias("identifier")) for t, c in held.items()]))
        d = df.select(F.col("entity_ref").alias("entry"), each.alias("x")).select("entry", "x.*")
        return d.where("entry is not null and identifier is not null").distinct()

    owned = rows(cdr, phone="entity_ref", imei="imei").unionByName(rows(ipdr, phone="entity_ref", ip="_public_ip"))
    return (
        owned.unionByName(rows(bank, account="entity_ref"))
        .select(present(F.col("entry")).alias("entry"), "id_type", present(F.col("identifier")).alias("identifier"))
        .where("entry is not null and identifier is not null")
        .groupBy("entry", "id_type", "identifier")
        .agg(F.lit(None).cast("string").alias("name"))
        .select("entry", "name", "id_type", "identifier")
    )


def kyc_from_flat(pairs: DataFrame) -> DataFrame:
    """Flat (identifier, name) pairs, grouped by name; the kind is read off the text."""
    return (
        pairs.select(present(F.col("identifier")).alias("identifier"), present(F.col("name")).alias("name"))
        .where("identifier is not null and name is not null")
        .distinct()
        .select(F.col("name").alias("entry"), "name", identifier_type(F.col("identifier")).alias("id_type"), "identifier")
    )


def identity_nodes(kyc: DataFrame, events: DataFrame) -> DataFrame:
    """Every identifier once; its kind is the first known one, ownership records first."""
    e = events
    txn, ses = F.col("event_type") == "transaction", F.col("event_type") == "ip_session"
    call = F.col("event_type").isin("call", "sms")
    cp, none = F.col("counterparty"), F.lit(None).cast("string")

    def seen(rank: int, id_type, identifier):
        kind = id_type if not isinstance(id_type, str) else F.lit(id_type)
        return F.struct(F.lit(rank).alias("rank"), kind.alias("id_type"), identifier.alias("identifier"))

    seen_all = e.select(
        F.explode(
            F.array(
                seen(2, F.when(txn, "account").otherwise("phone"), F.col("entity_ref")),
                seen(3, F.when(cp.contains("@"), "vpa").otherwise("account"), F.when(txn, cp)),
                seen(5, "phone", F.when(call, cp)),
                seen(6, "imei", F.when(call, F.col("imei"))),
                seen(8, "ip", F.when(ses, F.col("_public_ip"))),
                seen(9, F.when(cp.contains("."), "ip").otherwise("unknown"), F.when(ses, cp)),
            )
        ).alias("x")
    ).select("x.*")
    owned = kyc.select(F.lit(1).alias("rank"), "id_type", "identifier")
    return (
        owned.unionByName(seen_all)
        .where("identifier is not null")
        # Made distinct first: that combines by hash map-side, cleaning and choice then see few rows.
        .distinct()
        .withColumn("identifier", present(F.col("identifier")))
        .where("identifier is not null")
        .groupBy("identifier")
        .agg(
            F.min_by("id_type", F.struct((F.col("id_type") == "unknown").alias("u"), "rank")).alias("id_type")
        )
    )


def ownership_edges(kyc: DataFrame) -> DataFrame:
    """One edge from the first identifier of an ownership entry to each of the others.

    A star joins the same identifiers as drawing every pair would, with as many
    edges as identifiers.
    """
    hub = kyc.groupBy("entry").agg(F.min("identifier").alias("src"))
    return (
        kyc.select("entry", F.col("identifier").alias("dst"))
        .join(hub, "entry")
        .where("src <> dst")
        .select("src", "dst", F.lit("kyc_ownership").alias("source"))
        .distinct()
    )


def spanning_links(u: pa.Array, v: pa.Array) -> tuple[pa.Array, pa.Array]:
    """A star of links (member, centre) for every group of values that the pairs (u, v) connect."""
    names = pa.chunked_array([u, v]).combine_chunks().dictionary_encode()
    code = names.indices.to_numpy()
    a, b = code[:len(u)], code[len(u):]
    root = np.arange(len(names.dictionary))
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root != root[root]).any():
            root = root[root]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    member = np.flatnonzero(root != np.arange(len(root)))
    return names.dictionary.take(pa.array(member)), names.dictionary.take(pa.array(root[member]))


def local_links(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v) with what each partition connects drawn as stars, block by block of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def settle() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            found = spanning_links(*(t.column(c).combine_chunks() for c in range(2)))
            return pa.RecordBatch.from_arrays(list(found), names=["u", "v"])

        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= LOCAL_EDGES:
                yield settle()
                held = []
        if held:
            yield settle()

    return edges.select("u", "v").mapInArrow(run, edges.select("u", "v").schema)


def components(edges: DataFrame) -> DataFrame:
    """Connected components: (identifier, component), named by the smallest member.

    First each task connects what its own edges connect, so only stars of representatives are joined. Then alternates two steps until neither changes an edge; then only stars are left. Large step: a node
    links its larger neighbours to its smallest neighbour. Small step: it links its smaller
    ones. The minima combine map-side and are written before they are joined back: the join then
    reads plain tables, and adaptive execution can split a hub's edges over many tasks. Changes are counted
    by the jobs that write the steps. The joins are merges: a broadcast would pass the minima of every step through the driver.
    """
    e = local_links(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).where("u <> v"))
    e = cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")

    def step(found: DataFrame, changed: Column) -> tuple[DataFrame, int]:
        seen = Observation()
        moved = found.observe(seen, F.sum(changed.cast("bigint")).alias("n")).where("u <> v").select("u", "v")
        out = cut(moved.distinct(), "cc")
        return out, seen.get["n"] or 0

    changes = 1
    while changes:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "cc-low")
        large = both.join(low.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"), F.col("u").alias("w"))
        large, a = step(large, F.col("v") != F.col("w"))
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")), "cc-low")
        small = large.join(low.hint("merge"), "u").select(
            F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"),
            (F.col("v") != F.col("m")).alias("w"),
        )
        e, b = step(small, F.col("w"))
        changes = a + b
    tops = e.select(F.col("v").alias("identifier")).distinct().withColumn("component", F.col("identifier"))
    return e.select(F.col("u").alias("identifier"), F.col("v").alias("component")).unionByName(tops)


def entity_name_of(component):
    """Stable entity id of a component."""
    return F.concat(F.lit("ENT_"), F.substring(F.sha2(component, 256), 1, 12))


def assign_entities(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Every node with the entity of its component: (entity_id, identifier, id_type)."""
    nodes, comp = at_once(lambda: cut(nodes, "nodes"), lambda: components(edges))
    return nodes.join(comp, "identifier", "left").select(
        entity_name_of(F.coalesce("component", "identifier")).alias("entity_id"), "identifier", "id_type"
    )


def entity_table(members: DataFrame, kyc: DataFrame) -> DataFrame:
    """One row per entity: name, counts per kind, and all identifiers per kind; ``members`` is the long form."""
    names = (
        kyc.where("name is not null").groupBy("identifier").agg(F.max("name").alias("name"))
    )
    counts = (
        members.join(names, "identifier", "left")
        .groupBy("entity_id")
        .agg(
            F.min_by("name", F.when(F.col("name").isNotNull(), F.col("identifier"))).alias("_kyc"),
            *[F.count_if(F.col("id_type") == t).alias(f"n_{t}s") for t in ID_TYPES],
            *[F.min(F.when(F.col("id_type") == t, F.col("identifier"))).alias(f"_first_{t}") for t in ID_TYPES],
        )
    )
    lists = members.groupBy("entity_id").agg(
        *[F.sort_array(F.collect_set(F.when(F.col("id_type") == t, F.col("identifier")))).alias(f"{t}s") for t in ID_TYPES]
    )
    name = F.coalesce(
        "_kyc",
        F.concat(F.lit("Phone "), "_first_phone"),
        F.concat(F.lit("Acct "), "_first_account"),
        F.concat(F.lit("VPA "), "_first_vpa"),
        F.concat(F.lit("IP "), "_first_ip"),
        "entity_id",
    )
    return counts.join(lists, "entity_id").select(
        "entity_id", name.alias("name"), *[f"n_{t}s" for t in ID_TYPES], *[f"{t}s" for t in ID_TYPES]
    )


def validate_entities(members: DataFrame, kyc: DataFrame) -> DataFrame:
    """Split every entity whose phones, accounts and devices no single record vouches for.

    A record covers an entity when it holds as many of its checked identifiers as the
    entity has. An entity that fails becomes one entity per identifier.
    """
    checked = ("phone", "account", "imei")
    need = members.groupBy("entity_id").agg(
        *[F.count_if(F.col("id_type") == t).alias(t) for t in checked]
    )
    multi = need.where(" or ".join(f"{t} > 1" for t in checked)).select(
        "entity_id", sum((F.col(t) for t in checked), F.lit(0)).alias("need")
    )
    held = kyc.where(F.col("id_type").isin(*checked)).select("entry", "id_type", "identifier").distinct()
    covered = (
        members.where(F.col("id_type").isin(*checked))
        .join(multi.select("entity_id"), "entity_id", "left_semi")
        .join(held, ["id_type", "identifier"])
        .groupBy("entity_id", "entry")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("entity_id")
        .agg(F.max("n").alias("best"))
    )
    verdict = multi.join(covered, "entity_id", "left").select(
        "entity_id", (F.coalesce("best", F.lit(0)) < F.col("need")).alias("_split")
    )
    own = F.concat("entity_id", F.lit("_"), F.substring(F.sha2(F.col("identifier"), 256), 1, 8))
    return members.join(verdict, "entity_id", "left").select(
        F.when(F.coalesce("_split", F.lit(False)) & F.col("id_type").isin(*ID_TYPES), own)
        .otherwise(F.col("entity_id"))
        .alias("entity_id"),
        "identifier",
        "id_type",
    )


def apply_mapping(events: DataFrame, id_map: DataFrame) -> DataFrame:
    """Events with the entity of their reference, or UNRESOLVED_<reference>."""
    m = id_map.select(F.col("identifier").alias("entity_ref"), F.col("entity_id").alias("_e"))
    return (
        events.drop("entity_id")
        .join(m, "entity_ref", "left")
        .withColumn("entity_id", F.coalesce("_e", F.concat(F.lit("UNRESOLVED_"), F.coalesce("entity_ref", F.lit("")))))
        .drop("_e")
    )


def coverage(nodes: DataFrame, kyc: DataFrame, members: DataFrame) -> DataFrame:
    """How much of the graph ownership records explain, as (metric, value) rows."""

    def long(df: DataFrame) -> DataFrame:
        pairs = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("bigint").alias("value")) for c in df.columns]
        return df.select(F.explode(F.array(*pairs)).alias("x")).select("x.*")

    known = kyc.select("identifier").distinct().withColumn("_k", F.lit(1))
    n = nodes.join(known, "identifier", "left").agg(
        F.count(F.lit(1)).alias("nodes"),
        F.count("_k").alias("kyc_mapped"),
        (F.count(F.lit(1)) - F.count("_k")).alias("unmapped"),
    )
    per = members.groupBy("entity_id").agg(
        F.count_if(F.col("id_type").isin("phone", "account", "imei", "vpa")).alias("n")
    )
    m = per.agg(
        F.count(F.lit(1)).alias("entities"),
        F.count_if(F.col("n") > 1).alias("multi_identifier"),
        F.count_if(F.col("n") <= 1).alias("singletons"),
    )
    return long(n).unionByName(long(m))


def identifier_index(members: DataFrame, kinds=("phone", "account", "vpa")) -> DataFrame:
    """Reverse index identifier -> entity."""
    return members.where(F.col("id_type").isin(*kinds)).select("identifier", "entity_id").distinct()


def lookup_entities(wanted: DataFrame, members: DataFrame) -> DataFrame:
    """Resolve ``wanted`` (key): an entity id stands for itself, an identifier for its owner."""
    ids = members.select(F.col("entity_id").alias("key"), "entity_id").unionByName(
        members.select(F.col("identifier").alias("key"), "entity_id")
    )
    return wanted.join(ids.distinct(), "key", "left")


def sampled_groups(texts: list[str], size: int, window: int, known: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the groups of ``size`` characters that are smallest in some run of ``window`` consecutive
    groups of a text; of the hashes in sorted ``known`` only, if given."""
    whole, span = "".join(texts), size + window - 1
    lengths = np.array([len(t) for t in texts], np.int64)
    text_at, ends = np.repeat(np.arange(len(texts)), lengths), np.cumsum(lengths)
    owners, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for at in range(0, len(whole) - span + 1, SAMPLE_CHARS):
        codes = np.frombuffer(whole[at:at + SAMPLE_CHARS + span - 1].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        n = len(codes) - size + 1
        h = codes[:n] + np.uint64(size)
        for k in range(1, size):
            h *= np.uint64(0x9E3779B97F4A7C15)
            h += codes[k:k + n]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        low, wide = h, 1
        while 2 * wide <= window:
            low = np.minimum(low[:-wide], low[wide:])
            wide *= 2
        if wide < window:
            low = np.minimum(low[:wide - window], low[window - wide:])
        owner = text_at[at:at + len(low)]
        inside = np.arange(at, at + len(low)) + span <= ends[owner]  # no window over the end of its text
        low, owner = low[inside], owner[inside]
        # Neighbouring windows mostly share their smallest group.
        keep = np.concatenate([[True], (low[1:] != low[:-1]) | (owner[1:] != owner[:-1])])[:len(low)]
        if known is not None:
            place = np.searchsorted(known, low)
            place[place == len(known)] = 0
            keep &= known[place] == low if len(known) else False
        owners.append(owner[keep])
        found.append(low[keep])
    return np.concatenate(owners), np.concatenate(found)


def anchors(rows: DataFrame, key: str, grids: tuple[set[int], set[int]] | None = None, known: Broadcast | None = None) -> DataFrame:
    """(key, grid, anchor): sampled character groups of the second column of ``rows``.

    A phrase, when ``grids`` is None, is sampled on the widest grid that it is long enough for, a text on each of the
    first of ``grids``, and on the second if it has an @; of its samples only those in ``known`` are kept, if that is given. A text that holds the phrase holds its windows
    of that grid whole, so it has the phrase's samples, too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for g, (size, window) in enumerate(GRIDS):
                if grids is None:
                    above = GRIDS[g - 1][0] + GRIDS[g - 1][1] - 1 if g else None
                    mine = [n for n, t in enumerate(texts) if size + window - 1 <= len(t) and (above is None or len(t) < above)]
                else:
                    mine = [n for n, t in enumerate(texts) if size + window - 1 <= len(t) and (g in grids[0] or g in grids[1] and "@" in t)]
                at = 0
                while at < len(mine):
                    end, chars = at, 0
                    while end < len(mine) and (end == at or chars + len(texts[mine[end]]) <= SAMPLE_CHARS):
                        chars += len(texts[mine[end]])
                        end += 1
                    owner, found = sampled_groups([texts[n] for n in mine[at:end]], size, window, None if known is None else known.value)
                    if len(found):
                        rows = pa.array(np.array(mine[at:end])[owner])
                        yield pa.RecordBatch.from_arrays(
                            [b.column(0).take(rows), pa.array(np.full(len(found), g, np.int32)), pa.array(found.view(np.int64))], names=[key, "grid", "anchor"]
                        )
                    at = end

    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(run, f"{key} {kind}, grid int, anchor bigint")


def mention_links(texts: DataFrame, members: DataFrame, names: DataFrame, limit: int = 3) -> DataFrame:
    """Entities that a text is about: (text_id, entity_id, how), the first ``limit`` per text.

    ``texts`` (text_id, text), ``names`` (entity_id, name). Ids and digit runs are equality
    joins. Names and handles are found inside the text through one sampled group of characters
    each (``GRIDS``): the sample of the name that the fewest other names share is looked up among the
    samples of the whole text, and the hit is then confirmed on the text.
    """
    lowered = F.lower("text")
    found = texts.select(
        "text_id",
        F.posexplode(F.regexp_extract_all("text", F.lit(r"(?i)\bENT[\s_\-]?([0-9a-f]{1,12})\b"), F.lit(1))).alias("pos", "raw"),
    )
    bare = F.regexp_replace("raw", "^0+(?=.)", "")
    padded = F.when(F.col("raw").rlike("^[0-9]{1,6}$"), F.concat(F.lit("ENT_"), F.lpad(bare, 4, "0")))
    padded = F.when(F.length(bare) > 4, F.concat(F.lit("ENT_"), bare)).otherwise(padded)
    forms = found.select(
        "text_id", "pos",
        F.explode(F.array_distinct(F.array_compact(F.array(padded, F.concat(F.lit("ENT_"), F.lower("raw")))))).alias("entity_id"),
    )
    ids = members.select("entity_id").distinct()
    by_id = forms.join(ids, "entity_id").select(
        "text_id", "entity_id", F.lit("id").alias("how"), F.struct(F.lit(1).alias("a"), F.col("pos").alias("b"), F.lit("").alias("c")).alias("ord")
    )
    squeezed = F.regexp_replace("text", r"[\s\-()+]", "")
    long_run = F.col("text").rlike(r"(?:[0-9][\s\-()+]*){6}")
    runs = texts.where(long_run).select("text_id", F.explode(F.array_distinct(F.regexp_extract_all(squeezed, F.lit(r"([0-9]{6,})"), F.lit(1)))).alias("run"))
    runs = cut(runs, "runs")
    numbers = members.where(F.col("id_type").isin("phone", "account", "imei", "vpa")).select(
        "entity_id", digits(F.col("identifier")).alias("run")
    ).where("run <> ''")
    by_digits = runs.join(numbers, "run").select(
        "text_id", "entity_id", F.lit("identifier").alias("how"),
        F.struct(F.lit(3).alias("a"), F.lit(0).alias("b"), F.col("entity_id").alias("c")).alias("ord"),
    )
    phrases = names.where(F.length("name") >= 4).select(
        "entity_id", F.lower("name").alias("phrase"), F.lit("name").alias("how"),
        F.struct(F.lit(2).alias("a"), (-F.length("name")).alias("b"), F.col("entity_id").alias("c")).alias("ord"),
    ).unionByName(
        members.where((F.col("id_type") == "vpa") & (F.length("identifier") > 0)).select(
            "entity_id", F.lower("identifier").alias("phrase"), F.lit("vpa").alias("how"),
            F.struct(F.lit(4).alias("a"), F.lit(0).alias("b"), F.col("entity_id").alias("c")).alias("ord"),
        )
    )

    # Every phrase has one anchor: of the sampled character groups that any text with the phrase must have, the
    # one that the fewest other phrases have. Written first, so its size is known when Spark picks the join.
    known = phrases.select("phrase").distinct()
    parts = cut(anchors(known.select("phrase", F.col("phrase").alias("_t")), "phrase"), "parts")
    shared = parts.groupBy("anchor").agg(F.count(F.lit(1)).alias("_n"))
    anchor = parts.join(shared, "anchor").groupBy("phrase").agg(F.min_by(F.struct("anchor", "grid"), F.struct("_n", "anchor")).alias("a"))
    anchor = cut(anchor.select("phrase", "a.*"), "anchors")
    # The few grids of phrases without an @, and of those with one: no other text can hold these.
    plain, handles, n = anchor.agg(
        F.collect_set(F.when(~F.col("phrase").contains("@"), F.col("grid"))), F.collect_set(F.when(F.col("phrase").contains("@"), F.col("grid"))), F.count(F.lit(1))
    ).first()
    known = None
    if n <= SENT_ANCHORS:  # beyond that the join alone finds them
        hashes = anchor.select("anchor").toArrow()["anchor"].to_numpy()
        known = texts.sparkSession.sparkContext.broadcast(np.unique(hashes.view(np.uint64)))
    inside = anchors(texts.select("text_id", lowered.alias("_t")), "text_id", (set(plain), set(handles)), known)
    maybe = inside.select("text_id", "anchor").distinct().join(anchor.select("phrase", "anchor"), "anchor").select("text_id", "phrase")
    hits = (
        cut(maybe, "maybe").join(texts.select("text_id", lowered.alias("_t")), "text_id")
        .where(F.col("_t").contains(F.col("phrase")))
        .select("text_id", "phrase")
    )
    # A handle only counts in a text that also has a digit run.
    has_run = runs.select("text_id").distinct().withColumn("_run", F.lit(True))
    by_name = (
        cut(hits, "hits").join(phrases, "phrase").join(has_run, "text_id", "left").where("how = 'name' or _run")
    )
    every = (
        by_id.unionByName(by_digits)
        .unionByName(by_name.select("text_id", "entity_id", "how", "ord"))
        .groupBy("text_id", "entity_id")
        .agg(F.min(F.struct("ord", "how")).alias("m"))
        .select("text_id", "entity_id", "m.how", "m.ord")
    )
    return top_per_key(every, ["text_id"], [F.asc("ord")], limit, "rank").drop("ord")
