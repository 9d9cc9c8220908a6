"""The operators of this subpackage on their whole tables, with production parameters."""
from __future__ import annotations

from pyspark.sql import functions as F

from evifuse.llm import (
    chat, decontaminate, fill_middle, importance, line_dedup, ngram_join, quality_model, quality_rules, simhash_links, token_matrix, url_filters,
)
from evifuse.llm.common import table, tokenizer_path

QUERIES: dict = {}
ORACLES: dict[str, str] = {
    "op2_line_dedup": line_dedup.ORACLE,
    "op4_url_filters": url_filters.ORACLE,
    "op5_chat_perspectives": chat.ORACLE,
    "op11_fill_in_middle": fill_middle.ORACLE,
    "op12_importance_resampling": importance.ORACLE,
}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_quality_classifier(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    return quality_model.score_quality(table(spark, sf, "documents"), labels)


@query
def op2_line_dedup(spark, sf):
    return line_dedup.dedup_lines(table(spark, sf, "documents")).select("doc_id", "text", "n_removed")


@query
def op3_quality_rules(spark, sf):
    good = table(spark, sf, "labels").where("quality = 1").select("doc_id")
    return quality_rules.quality_rules(table(spark, sf, "documents"), good).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def page_outcomes(spark, sf):
    """Labels as outcomes of the pages with the same number: bad if low in quality or toxic."""
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.coalesce("quality", "toxic").isNotNull(), 0)
    return table(spark, sf, "labels").select(F.col("doc_id").alias("page_id"), bad.alias("bad"))


@query
def op4_url_filters(spark, sf):
    return url_filters.filter_urls(table(spark, sf, "pages"), page_outcomes(spark, sf)).select("page_id", "host", "path", "rule", "verdict")


@query
def op5_chat_perspectives(spark, sf):
    spans = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"], x["length"])), ",")
    out = chat.rotate_perspectives(table(spark, sf, "conversations"))
    return out.select("conv_id", "speaker", "part", "n_turns", "n_chars", "text", F.when(spans != "", spans).alias("spans"))


@query
def op6_benchmark_decontamination(spark, sf):
    return decontaminate.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query
def op7_ngram_jaccard_join(spark, sf):
    return ngram_join.near_duplicates(table(spark, sf, "documents"))


@query
def op8_best_fit_packing(spark, sf):
    from evifuse.llm.packing import pack_documents

    return pack_documents(table(spark, sf, "documents"), tokenizer_path("word_bpe_49k.json"))


@query
def op9_token_matrix(spark, sf):
    """Each packed sequence with its segments; the two matrices as checksums of their rows."""
    import public_tokenizers

    packed = token_matrix.pack_matrix(table(spark, sf, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return packed.select(
        "sequence_id", "n_tokens", "n_segments", "cu_seqlens", "doc_ids", "pieces", "starts",
        F.crc32("ids").alias("ids_crc32"), F.crc32("positions").alias("positions_crc32"),
    )


@query
def op10_token_counts(spark, sf):
    from evifuse.llm.tokens import token_counts

    return token_counts(table(spark, sf, "documents"), tokenizer_path("piece_bpe_32k.model"))


@query
def op11_fill_in_middle(spark, sf):
    out = fill_middle.fill_middle(table(spark, sf, "documents"))
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256")
    )


@query
def op12_importance_resampling(spark, sf):
    return importance.resample(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query
def op13_simhash_near_dedup(spark, sf):
    return simhash_links.simhash_components(table(spark, sf, "documents"))
