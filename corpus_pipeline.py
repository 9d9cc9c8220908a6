"""A training corpus from ``documents`` in five stages, each written and read by the next."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evifuse.llm.common import WORD, table, tokenizer_path
from evifuse.llm.decontaminate import drop_contaminated
from evifuse.llm.line_dedup import dedup_lines
from evifuse.llm.ngram_join import drop_near_duplicates
from evifuse.llm.packing import pack_documents
from evifuse.llm.quality_rules import quality_rules
from evifuse.session import cut


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and resemble the trusted target; the others go."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality_rules(docs, good).where("kept").select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated line runs; ``n_chars`` follows. One that loses its last word goes."""
    out = dedup_lines(docs).where((F.col("n_removed") == 0) | F.col("text").rlike(WORD))
    length = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id."""
    return drop_near_duplicates(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark``."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in token sequences."""
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("best-fit packing", packing),
]

# Near-duplicate groups, edited passages and tokenizer ids have no SQL form; tests/llm compares
# the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the ``documents`` table; the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = cut(docs, f"pipeline-{name.replace(' ', '-')}")
    return docs
