"""The corpus pipeline: five stages, each one of the operators of ``wakeline.llm``.

``run`` applies the stages to ``documents``; between two stages the rows are written
to the shared folder as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from wakeline.llm import decontaminate, jaccard_join, language_id, line_dedup, packing
from wakeline.llm.base import cut, table


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID (8): documents whose language cannot be told (no letters, null text) go.  Where no
    labelled row gives a model, documents with letters stay."""
    model = language_id.fit(docs.filter(~language_id.held_out()))
    told = F.col("lang_pred") != language_id.UNDETERMINED
    kept = language_id.identify(docs, model).filter(told if model.langs else F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return kept.select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup (7): lines that many documents share go; texts and n_chars follow, and
    documents of which nothing but blanks is left go."""
    out = line_dedup.dedup_lines(docs)
    changed = F.col("n_dropped") > 0
    out = out.withColumns({
        "text": F.when(changed, F.col("kept_text")).otherwise(F.col("text")),
        "n_chars": F.when(changed, F.char_length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")),
    })
    return out.filter(~changed | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join (3): the smallest id of each group stays."""
    return jaccard_join.drop_near_duplicates(docs).select(*docs.columns)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination (10): documents in which an item leaks go."""
    return decontaminate.drop_leaking(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing (5): batches of optimal length buckets."""
    return packing.pack(docs)


STAGES = [
    ("language ID", keep_identified),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", decontaminate_benchmark),
    ("packing", pack_batches),
]

#: Language ID, the LSH search and the dynamic programme have no SQL form; a test compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs, name.replace(" ", "-"))
    return docs
