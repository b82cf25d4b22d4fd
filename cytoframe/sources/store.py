"""Stored tables by chromosome with a manifest, stages with their signatures, and exports of the site matrix."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.tables import _file_system
from . import sinks
from .versions import Versions


def data_signature(df: DataFrame, columns: list[str] | None = None) -> str:
    """A digest of a table's rows, whatever the order of rows and columns: one aggregate with map-side sums."""
    columns = sorted(columns or df.columns)
    h = F.xxhash64(*columns)
    n, x, s = df.agg(F.count("*"), F.bit_xor(h), F.sum(F.pmod(h, F.lit(1_000_000_007)))).first()
    return hashlib.sha256(f"{n}|{x}|{s}|{sorted(df.select(*columns).dtypes)}".encode()).hexdigest()


def signature(*parts: object) -> str:
    """A key of settings and of other signatures."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


class ResultStore:
    """A table partitioned by chromosome, with a manifest; each change is one commit.

    A chromosome is one folder, so reading one reads no other, and rewriting one
    leaves the others' files as they are. Readers see a state as a whole.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.versions = Versions(spark, self.path)

    def _write(self, df: DataFrame) -> dict[str, str]:
        folder = self.versions.fresh()
        df.repartition("chrom").sortWithinPartitions("chrom", "pos").write.option("compression", "zstd").partitionBy("chrom").parquet(f"{self.path}/{folder}")
        return self.versions.parts(folder)

    @classmethod
    def create(cls, df: DataFrame, path: str, **about) -> ResultStore:
        store = cls(df.sparkSession, path)
        parts = store._write(df)
        store.versions.change(lambda _: {"parts": parts, "about": about | {"schema": df.schema.jsonValue()}})
        return store

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> ResultStore:
        store = cls(spark, path)
        if store.manifest() is None:
            raise FileNotFoundError(f"no store at {path}")
        return store

    def manifest(self) -> dict | None:
        state = self.versions.current()[1]
        return None if state is None else state["about"]

    def write_manifest(self, about: dict) -> None:
        self.versions.change(lambda state: {"parts": (state or {}).get("parts", {}), "about": (state or {}).get("about", {}) | about})

    def mark_adjusted(self, q: str = "qvalue", method: str = "bh") -> None:
        self.write_manifest({"adjusted": {"column": q, "method": method}})

    def to_dataframe(self, columns: list[str] | None = None) -> DataFrame:
        state = self.versions.current()[1]
        x = self.versions.read(list(state["parts"].values()), StructType.fromJson(state["about"]["schema"]))
        return x.select(*columns) if columns else x

    def scan_chrom(self, chrom: str) -> DataFrame:
        return self.to_dataframe().where(F.col("chrom") == chrom)

    def read_chrom(self, chrom: str, columns: list[str] | None = None) -> DataFrame:
        x = self.scan_chrom(chrom)
        return x.select(*columns) if columns else x

    def chroms(self) -> list[str]:
        """Names in genomic order; one row each."""
        names = self.to_dataframe(["chrom"]).distinct().orderBy(sinks.chromosome_order())
        return [r[0] for r in names.collect()]

    def iter_chroms(self, columns: list[str] | None = None) -> Iterator[tuple[str, DataFrame]]:
        for c in self.chroms():
            yield c, self.read_chrom(c, columns)

    def update_chrom(self, chrom: str, df: DataFrame) -> None:
        """Replaces one chromosome, or takes it out if df is empty; df may read the store itself."""
        if df.where(~F.col("chrom").eqNullSafe(chrom)).limit(1).count():
            raise ValueError(f"rows of other chromosomes than {chrom}")
        parts = self._write(df)
        name = f"chrom={self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(chrom)}"
        self.versions.change(lambda state: state | {"parts": {k: v for k, v in state["parts"].items() if k != name} | parts})

    def delete(self) -> None:
        fs, p = _file_system(self.spark, self.path)
        fs.delete(p, True)


class Stages:
    """A log of finished stages with their settings and input signatures; a stage is reused under the very same signature only.

    Each entry is a commit, so entries of two that log at once are both kept.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.versions = Versions(spark, f"{self.root}/_stages")

    def all(self) -> list[dict]:
        return (self.versions.current()[1] or {"entries": []})["entries"]

    def find(self, stage: str, key: str | None = None) -> dict | None:
        """The last entry of a stage, or the one of a signature."""
        return next((e for e in reversed(self.all()) if e["stage"] == stage and key in (None, e["signature"])), None)

    def append(self, stage: str, params: dict, key: str, path: str, **more) -> dict:
        entry = {"stage": stage, "params": params, "signature": key, "path": path} | more
        self.versions.change(lambda state: {"entries": [*(state or {"entries": []})["entries"], entry]})
        return entry

    def completed(self) -> list[str]:
        return list(dict.fromkeys(e["stage"] for e in self.all()))

    def resume(self, stage: str) -> DataFrame:
        found = self.find(stage)
        if found is None:
            raise KeyError(f"stage {stage!r} has not ended; {self.completed()} have")
        return self.spark.read.parquet(found["path"])

    def run(self, stage: str, params: dict, source: DataFrame, make: Callable[[], DataFrame]) -> DataFrame:
        """The stage's table: as stored, if source's rows and the settings are the same, else made and stored."""
        key = signature(stage, params, data_signature(source))
        if found := self.find(stage, key):
            return self.spark.read.parquet(found["path"])
        path = f"{self.root}/{stage}-{key[:16]}"
        make().write.mode("overwrite").option("compression", "zstd").parquet(path)
        self.append(stage, params, key, path)
        return self.spark.read.parquet(path)


# --- the matrix of samples and sites -----------------------------------------


def site_axis(sites: DataFrame, how: str = "union", n_samples: int | None = None) -> DataFrame:
    """(chrom, pos, site): sites numbered by chromosome name and position. Numbers are counts of the chromosomes before plus the row in its own."""
    g = sites.groupBy("chrom", "pos").agg(F.count_distinct("sample").alias("_k"))
    g = g.where(F.col("_k") == n_samples).drop("_k") if how == "intersect" else g.drop("_k")
    n = g.groupBy("chrom").agg(F.count("*").alias("_n"))
    n = n.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("chrom").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    row = F.row_number().over(Window.partitionBy("chrom").orderBy("pos"))
    return g.withColumn("_row", row).join(n, "chrom").select("chrom", "pos", (F.col("_before") + F.col("_row") - 1).alias("site"))


def matrix_entries(sites: DataFrame, axis: DataFrame, samples: list[str], layer: str = "beta") -> DataFrame:
    """(sample, site, value) of one layer: beta, coverage, n_meth or n_unmeth; sites off the axis are left out, missing values too."""
    number = F.create_map(*(F.lit(x) for i, s in enumerate(samples) for x in (s, i)))
    x = sites.join(axis, ["chrom", "pos"]).select(F.try_element_at(number, F.col("sample")).alias("sample"), "site", sinks.value_of(layer).alias("value"))
    return x.where("sample IS NOT NULL AND value IS NOT NULL")


def write_matrix(sites: DataFrame, obs: DataFrame, path: str, samples: list[str], layers: tuple[str, ...] = ("beta",), how: str = "union", modalities: dict[str, DataFrame] | None = None) -> None:
    """The matrix as Parquet: obs (a row a sample), var (the site axis), layers/<name> by sample, and any further modality as given."""
    axis = site_axis(sites, how, len(samples))
    obs.write.mode("overwrite").parquet(f"{path}/obs")
    axis.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/var")
    var = sites.sparkSession.read.parquet(f"{path}/var")
    for layer in layers:
        matrix_entries(sites, var, samples, layer).repartition("sample").sortWithinPartitions("sample", "site").write.mode("overwrite").option("compression", "zstd").partitionBy("sample").parquet(f"{path}/layers/{layer}")
    for name, df in (modalities or {}).items():
        df.write.mode("overwrite").parquet(f"{path}/modalities/{name}")


def smoothed_counts(sites: DataFrame, smoothed: DataFrame) -> DataFrame:
    """Sites with counts that the smoothed level (sample, chrom, pos, smoothed) implies: level x coverage, rounded to even, within 0..coverage. Without a level the counts stay."""
    x = sites.join(smoothed.select("sample", "chrom", "pos", "smoothed"), ["sample", "chrom", "pos"], "left")
    m = F.least(F.greatest(F.bround(F.col("smoothed") * F.col("coverage")), F.lit(0)), F.col("coverage")).cast("int")
    x = x.withColumn("n_meth", F.when(F.col("smoothed").isNotNull() & ~F.isnan("smoothed"), m).otherwise(F.col("n_meth")))
    return x.withColumn("n_unmeth", F.col("coverage") - F.col("n_meth")).select(*sites.columns)

