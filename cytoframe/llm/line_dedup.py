"""Line dedup: explode normalised lines, hash, count documents per hash, drop, reassemble.

Defined cases: a null text is one empty line. Rows of one doc_id are one
document. A null doc_id is a document of its own kind that sorts after all
others: it loses a shared line to any other document. Other columns pass by.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import LOWER, UPPER, WS, Written, map_in_arrow, meet, named


def line_key(line: Column) -> Column:
    """The line stripped of ASCII white space at both ends, A-Z lower-cased."""
    return F.translate(F.trim(line, F.lit(WS)), UPPER, LOWER)


def dropped_positions(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """(doc_id, text_hash, dropped): positions of the lines that each document loses.

    Lines are exploded and hashed once, into a written table of digests, ids
    and positions. Documents per key are counted with map-side sums. The few
    hot keys are broadcast; other keys meet their lines in a join.
    """
    lines = docs.select(
        "doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")
    )
    keyed = lines.select("doc_id", "text_hash", "pos", line_key(F.col("line")).alias("k")).where(F.length("k") >= min_chars)
    held = Written(keyed.select(F.unhex(F.md5("k")).alias("key"), "doc_id", "text_hash", "pos")).df
    seen = held.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), *_documents(min_docs))
    shared = Written(seen.where(F.col("n_docs") >= min_docs).select("key", "n", "first")).df
    lost = meet(held, shared, "key", held.count())
    lost = lost.where(~F.col("doc_id").eqNullSafe(F.col("first")))
    return lost.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("dropped"))


def _documents(min_docs: int) -> list[Column]:
    """n_docs of a key; up to two, the least and the greatest id tell, and need no second shuffle. A null id is one document."""
    null = F.max(F.col("doc_id").isNull().cast("int"))
    if min_docs <= 2:
        return [(F.coalesce((F.min("doc_id") < F.max("doc_id")).cast("int"), F.lit(-1)) + 1 + null).alias("n_docs")]
    return [(F.count_distinct("doc_id") + null).alias("n_docs")]


def line_dedup(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """docs with text replaced by what stays, and n_lines, n_dropped."""
    extra = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "text_hash", "dropped")]
    docs = docs.select(*map(named, extra)).withColumn("text", F.coalesce("text", F.lit("")))
    lost = dropped_positions(docs, min_chars, min_docs)
    keyed = docs.withColumn("text_hash", F.xxhash64("text"))
    joined = keyed.alias("d").join(
        lost.alias("l"),
        F.col("d.doc_id").eqNullSafe(F.col("l.doc_id")) & (F.col("d.text_hash") == F.col("l.text_hash")),
        "left",
    ).select("d.*", "l.dropped")
    at, names = joined.columns.index("text"), extra
    spec = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, totals, drops = [], [], []
            for text, lost in zip(b.column(at).to_pylist(), b.column("dropped").to_pylist()):
                parts = text.split("\n")
                gone = set(lost or ())
                texts.append("\n".join(x for i, x in enumerate(parts) if i not in gone) if gone else text)
                totals.append(len(parts))
                drops.append(len(gone))
            cols = [pa.array(texts, pa.string()) if n == "text" else b.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(totals, pa.int64()), pa.array(drops, pa.int64())], [*names, "n_lines", "n_dropped"])

    return map_in_arrow(joined, rebuild, spec)


def digest(docs: DataFrame) -> DataFrame:
    return line_dedup(docs.select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    )


_WS_SQL = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
e AS (SELECT rid, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, {_WS_SQL}), '{UPPER}', '{LOWER}') AS k FROM e),
s AS (SELECT k, min(doc_id) AS first FROM k WHERE length(k) >= 10 GROUP BY k
      HAVING count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) >= 2),
f AS (SELECT k.rid, k.doc_id, k.pos, k.line, s.k IS NOT NULL AND k.doc_id IS DISTINCT FROM s.first AS gone
      FROM k LEFT JOIN s ON k.k = s.k)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM f GROUP BY rid
"""
