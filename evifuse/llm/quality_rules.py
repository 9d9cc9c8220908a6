"""Document rules and a hashed n-gram likelihood ratio, with DataFrame functions only.

Two multinomials over hashed token n-grams are counted: the trusted target (documents labelled
good) and the raw corpus (all documents). A document's score is the mean log ratio of the two
over its n-grams, and every document is kept or rejected by comparing it with one threshold.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evifuse.llm.common import fresh, let, text_of, words_of

BUCKETS = 16_384
# Mean log ratio (nats per n-gram) below which a document is rejected. Ordinary text lies near
# zero; text made of n-grams that the target hardly has lies below -0.7.
THRESHOLD = -0.3
# Letters and digits, or other visible characters, as in the usual word-and-punctuation split.
TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"
SYMBOLS = "[#*$%&|<>]"


def n_repeat_words(words: Column) -> Column:
    """Words that lie in a three-word window found twice or more among ``words``.

    Windows are compared by hash first, packed with their position so that the sort is on numbers;
    only those with an equal hash are compared as text.
    """

    def windows(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - 3)
        return F.transform(at, lambda i: F.shiftleft(F.hash(w[i], w[i + 1], w[i + 2]).cast("bigint"), 32).bitwiseOR(i.cast("bigint")))

    def twins(s: Column, key, value) -> Column:
        """Values of the elements of sorted ``s`` whose key a neighbour shares."""
        last = F.size(s) - 1
        same = F.filter(s, lambda x, k: ((k > 0) & (key(x) == key(F.get(s, k - 1)))) | ((k < last) & (key(x) == key(F.get(s, k + 1)))))
        return F.transform(same, value)

    def covered(p: Column) -> Column:
        """Words that windows at the sorted positions ``p`` cover."""
        return F.aggregate(p, F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-3).alias("last")), lambda acc, x: F.struct((acc["n"] + F.least(F.lit(3), x - acc["last"])).alias("n"), x.alias("last")), lambda acc: acc["n"])

    def exact(w: Column, at: Column) -> Column:
        texts = F.array_sort(F.transform(at, lambda i: F.struct(F.concat_ws(" ", w[i], w[i + 1], w[i + 2]).alias("t"), i.alias("i"))))
        return let(texts, lambda s: covered(F.array_sort(twins(s, lambda x: x["t"], lambda x: x["i"]))))

    def body(w: Column) -> Column:
        by_hash = let(
            F.sort_array(windows(w)),
            lambda s: twins(s, lambda x: F.shiftright(x, 32), lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")),
        )
        return let(by_hash, lambda at: F.when(F.size(at) == 0, F.lit(0).cast("bigint")).otherwise(exact(w, at)))

    return F.when(F.size(words) < 3, F.lit(0).cast("bigint")).otherwise(let(words, body))


def document_rules(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, ``base_failed``.

    A null text has no words and fails. Existing columns of these names are replaced.
    """
    w, t = fresh(docs, "_words", "_text")
    d = docs.withColumn(t, text_of(text_col)).withColumn(w, words_of(F.col(t)))
    lines = F.filter(F.split(F.col(t), "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    d = d.withColumns({
        "n_words": F.size(w).cast("bigint"),
        "word_chars": F.length(F.array_join(F.col(w), "")).cast("bigint"),
        "n_symbols": F.regexp_count(F.col(t), F.lit(SYMBOLS)).cast("bigint"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint"),
        "n_repeat_words": n_repeat_words(F.col(w)),
    }).drop(w, t)
    return d.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def gram_buckets(text: Column, buckets: int) -> Column:
    """Buckets of a text's tokens and token pairs, one for each occurrence."""

    def bucket(*parts: Column) -> Column:
        return F.pmod(F.hash(*parts), F.lit(buckets))

    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    return let(
        tokens,
        lambda w: F.concat(
            F.transform(w, lambda x: bucket(x)),
            F.when(F.size(w) > 1, F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: bucket(a, b))).otherwise(F.array().cast("array<int>")),
        ),
    )


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int, id_col: str, text_col: str) -> DataFrame:
    """One row: ``ratios``, an array of ``buckets`` log ratios of target and raw corpus, add-one smoothed.

    ``trusted`` holds the ids of the target's documents, once each.
    """
    texts = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    # The corpus is counted where it is read. Only the target needs a join; on large tables Spark filters
    # the documents by the ids before it shuffles any text.
    target = texts.join(trusted.select(F.col(trusted.columns[0]).alias("_id")).hint("merge"), "_id")

    def counted(part: DataFrame, name: str, other: str) -> DataFrame:
        grams = part.select(F.explode(gram_buckets(F.col("_text"), buckets)).alias("b"))
        return grams.groupBy("b").agg(F.count(F.lit(1)).alias(name)).withColumn(other, F.lit(0).cast("bigint")).select("b", "raw", "good")

    counts = counted(texts, "raw", "good").unionByName(counted(target, "good", "raw"))
    # At most ``buckets`` rows from here on. Buckets that no n-gram fell into are added with zeros.
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b"), F.lit(0).cast("bigint").alias("raw"), F.lit(0).cast("bigint").alias("good"))
    full = every.unionByName(counts).groupBy("b").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good"))
    table = full.agg(F.array_sort(F.collect_list(F.struct("b", "raw", "good"))).alias("c"), F.sum("raw").alias("r"), F.sum("good").alias("g"))

    def ratio(x: Column) -> Column:
        both = F.log((x["good"] + 1) / (F.col("g") + buckets)) - F.log((x["raw"] + 1) / (F.col("r") + buckets))
        return F.when(F.col("g") > 0, both).otherwise(F.lit(0.0))

    return table.select(F.transform("c", ratio).alias("ratios"))


def quality_rules(
    docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, threshold: float = THRESHOLD,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``docs`` with the rule columns of ``document_rules``, ``target_ratio`` and ``kept``.

    ``trusted`` is a frame whose first column holds ids of target documents (nulls and repeats
    are ignored). A text without n-grams has ratio 0, and so has every text if there is no target or no
    corpus. Counts are over all rows, repeated ones included; a document is kept unless a rule
    fails or its ratio is below ``threshold``, ties with it are kept. Result columns replace existing
    ones of the same name; an empty table gives no rows.
    """
    ids = trusted.select(F.col(trusted.columns[0]).alias("_id")).where("_id is not null").distinct()
    ratios = log_ratios(docs, ids, buckets, id_col, text_col)
    (r,) = fresh(docs, "_ratios")
    d = document_rules(docs, text_col).withColumn(r, ratios.scalar())

    def mean(b: Column) -> Column:
        total = F.aggregate(b, F.lit(0.0), lambda acc, x: acc + F.get(F.col(r), x))
        return F.when(F.size(b) > 0, total / F.size(b)).otherwise(F.lit(0.0))

    # Bound once: a filter on ``kept`` would else compute the n-grams for each mention of them.
    d = d.withColumn("target_ratio", let(gram_buckets(text_of(text_col), buckets), mean)).drop(r)
    return d.withColumn("kept", ~F.col("base_failed") & (F.col("target_ratio") >= threshold))
