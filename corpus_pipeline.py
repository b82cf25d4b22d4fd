"""The corpus pipeline: quality, lines, near-duplicates, mixture, packing.

STAGES are (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoframe.llm import line_dedup, mixing, packing, quality, simhash
from cytoframe.llm._common import Written, held_out, small, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, n_chars as the text now has."""
    return df.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least the classifier's threshold; the others go."""
    scored = quality.quality_scores(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id"), 5, 0))
    return _documents(scored.where(F.col("quality_score") >= quality.THRESHOLD))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that an earlier one has."""
    return _documents(line_dedup.line_dedup(docs))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (five-word shingles, similarity 0.8 or more): of the smallest doc_id, null last, the text of the least hash."""
    groups = simhash.near_duplicates(docs)
    first = groups.groupBy("group_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("r")).select("r.doc_id", "r.text_hash").distinct()
    first = small(Written(first).df)
    at = docs.withColumn("_hash", F.xxhash64("text")).alias("d").join(
        first.alias("g"), F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("d._hash") == F.col("g.text_hash")), "left_semi"
    )
    repeated = groups.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    return _documents(at.dropDuplicates(["doc_id", "_hash"]) if repeated else at)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mixture takes: one row for each document, pass and shard."""
    return _documents(mixing.mix(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences. The stages before leave their mark on a worker's memory, so it keeps fewer words."""
    return packing.digest(docs, cache_words=100_000)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("simhash near-dedup", near_duplicate_stage),
    ("source mixing", mixing_stage),
    ("best-fit packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written in the shared folder and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        now = Written(stage(spark, docs, sf_dir))
        if before:
            before.drop()
        docs, before = now.df, now
    return STAGES[-1][1](spark, docs, sf_dir)


#: Scores, draws and packing are beyond SQL.
ORACLE_SQL = None
