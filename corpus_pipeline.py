"""The corpus pipeline: documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs. All but the last return the
columns of ``documents``, further ones included: names that an operator adds are set
aside where a table has them already. Empty tables pass through as empty, and texts of
any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcells.llm import decontam, langid, linededup, packing, simhash
from gridcells.runtime import staged, table


def _apart(docs: DataFrame, names) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its own columns of these names renamed, and the way back."""
    own = {n: f"own_{i}_{n}" for i, n in enumerate(names) if n in docs.columns}
    return docs.withColumnsRenamed(own), {v: k for k, v in own.items()}


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language: no letters, or no codeword more likely
    than all others together. Where no row has a label there is nothing to learn, and
    only documents without letters go. A null text has none; repeated rows are decided
    alike; a score of exactly 0.5 (a tie) stays."""
    renamed, back = _apart(docs, langid.ADDED)
    model = langid.train(docs)
    rejected = "lang_pred = 'und' OR score < 0.5" if model.langs else r"NOT coalesce(text, '') RLIKE '\\p{L}'"
    found = langid.identify(renamed, model).where(f"NOT ({rejected})")
    return found.drop(*langid.ADDED).withColumnsRenamed(back).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines found in many documents (exactly ten, the tie, included); n_chars
    follows the text. Every row stays, repeated ones too; null text stays null."""
    renamed, back = _apart(docs, linededup.OUT)
    kept = linededup.dedup_lines(renamed, linededup.build_index(docs))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")))
    return kept.drop(*linededup.OUT).withColumnsRenamed(back).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each near-duplicate component, by doc_id, then by
    row (the ties of repeated rows); rows without an id come last. Null, empty and
    wordless texts are one component."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item. Null and empty texts
    hold none and stay; repeated rows are decided alike."""
    renamed, back = _apart(docs, decontam.ADDED)
    found = decontam.scan(renamed, table(spark, sf_dir, "benchmark")).where(~decontam.contaminated(F.col("n_hit")))
    return found.drop(*decontam.ADDED).withColumnsRenamed(back).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens along the curve; a null text is its end
    token, repeated rows are packed each."""
    pieces = packing.pack(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language", language), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("packing", packed)]
#: The language model and the SimHash components are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
