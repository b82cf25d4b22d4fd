"""MethylFrame: sites, samples and results under one roof, saved and loaded as tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.tables import written
from ..operators import annotate as A
from ..operators import dispatch, fdr, models, profiles, qc, reads, regions, sequence, sites as S, tests
from ..sources import sinks, store
from ..sources.versions import Versions


class MethylFrame:
    """sites: the site table. case, control: sample names. obs: a row for each sample, column sample and any others.

    results holds the tables that methods made, by name. A method that makes a
    new frame leaves this one as it is.
    """

    def __init__(self, sites: DataFrame, case: list[str], control: list[str], results: dict[str, DataFrame] | None = None, meta: dict | None = None, obs: DataFrame | None = None):
        self.sites, self.case, self.control = sites, list(case), list(control)
        self.results, self.meta, self._obs = dict(results or {}), dict(meta or {}), obs

    @property
    def samples(self) -> list[str]:
        return [*self.case, *self.control]

    @property
    def is_case(self) -> Column:
        return F.col("sample").isin(self.case)

    @property
    def obs(self) -> DataFrame:
        if self._obs is None:
            rows = [(s, int(s in self.case)) for s in self.samples]
            self._obs = self.sites.sparkSession.createDataFrame(rows, "sample string, treatment int")
        return self._obs

    def _with(self, sites: DataFrame, **meta) -> MethylFrame:
        return MethylFrame(sites, self.case, self.control, self.results, self.meta | meta, self._obs)

    def _describe(self, table: DataFrame) -> DataFrame:
        """Adds the columns of a table with a row for each sample to obs, in the place of those of these names."""
        new = [c for c in table.columns if c != "sample"]
        self._obs = self.obs.drop(*new).join(F.broadcast(table), "sample", "left")  # a row for each sample
        return self._obs

    # --- preparation ------------------------------------------------------

    def filter_coverage(self, low: int = 10, high: float = 99.9, blacklist: DataFrame | None = None) -> MethylFrame:
        return self._with(S.filter_coverage(self.sites, low, high, blacklist), filtered=[low, high])

    def normalize_coverage(self, method: str = "median") -> MethylFrame:
        if "filtered" not in self.meta:
            raise ValueError("filter the coverage first")
        return self._with(S.normalize_coverage(self.sites, method), normalized=method)

    def unite(self, how: str = "union") -> MethylFrame:
        return self._with(self.sites, united=how)

    def smooth(self, kernel: str = "gaussian", **parameters) -> MethylFrame:
        """A frame whose results hold the smoothed levels, for use by dmc(smoothed=True)."""
        out = self._with(self.sites, smoothed=[kernel, parameters])
        out.results["smoothed"] = written(sequence.smooth(self.sites, kernel, **parameters))
        return out

    def _tested(self, smoothed: bool = False, smooth_bp: int | None = None) -> DataFrame:
        mine = self.sites.where(F.col("sample").isin(self.samples))
        if self.meta.get("united") == "intersect":
            mine = mine.join(S.unite(mine, "intersect", len(self.samples)).select("chrom", "pos"), ["chrom", "pos"], "left_semi")
        if smoothed:
            if "smoothed" not in self.results:
                raise ValueError("smooth the frame first")
            mine = store.smoothed_counts(mine, self.results["smoothed"])
        if smooth_bp:
            x = regions.smooth_counts(mine, smooth_bp)
            mine = x.withColumns({"coverage": F.bround("cov_sm").cast("int"), "n_meth": F.least(F.bround("meth_sm"), F.bround("cov_sm")).cast("int")}).withColumn("n_unmeth", F.col("coverage") - F.col("n_meth")).select(*mine.columns)
        return mine

    # --- per site ---------------------------------------------------------

    def _design(self, formula: str, covariates: list[str] | tuple[str, ...] = ()) -> tuple[list[str], np.ndarray]:
        at = {r["sample"]: r.asDict() for r in self.obs.collect()}  # a row for each sample
        names, full = models.design([at[s] for s in self.samples], formula, covariates)
        if len(names) >= len(self.samples):
            raise ValueError(f"{len(names)} columns for {len(self.samples)} samples; drop terms or add samples")
        return names, full

    def _groups(self, test: str, formula: str | None = None, contrast: object = None, covariates: list[str] | tuple[str, ...] = ()) -> dispatch.Groups:
        if test != "glm":
            return dispatch.Groups(self.case, self.control)
        names, full = self._design(formula or "~ treatment", covariates)
        if contrast is not None:
            return dispatch.Groups(self.case, self.control, full, contrasts=models.contrast(contrast, names))
        if "treatment" not in names:
            raise ValueError(f"no treatment term in {names}; give a contrast")
        return dispatch.Groups(self.case, self.control, full, names.index("treatment"))

    def dmc(
        self, test: str = "auto", dispersion: str = "eb", reference: str = "adaptive", fdr_method: str = "bh", neighbour_bp: int | None = None, alpha: float = 0.05,
        formula: str | None = None, covariates: list[str] | tuple[str, ...] = (), contrast: object = None, min_case: int = 0, min_control: int = 0, allow_single: bool = False,
        smoothed: bool = False, smooth_bp: int | None = None, separated: float | None = None, permutations: int = 0, seed: int = 42, boost: bool | str = False,
    ) -> DataFrame:
        """Per-site results with q-values, kept as results["dmc_<test>"].

        test: auto, lr, score, fisher, cmh, welch_t, logit_t, bb_lr or glm. A
        formula over obs, or covariates beside the treatment, make it a
        regression, with a contrast of its terms or else the treatment term
        against the rest. permutations adds an
        empirical p-value from as many shuffles of the labels. boost combines
        neighbours within 500 bp and lets an exact test count where levels
        differ by 0.9; as "auto" it does so for lr with two samples or fewer in a group.
        """
        if test == "auto":
            test = "glm" if formula or covariates else tests.auto_test(len(self.case), len(self.control), allow_single)
        if boost is True or (boost == "auto" and test == "lr" and min(len(self.case), len(self.control)) <= 2):
            neighbour_bp, separated = neighbour_bp or 500, 0.9 if separated is None else separated
        tests.check_groups(len(self.case), len(self.control), self.meta.get("united", "union"), allow_single or test == "fisher" or bool(formula), min_case, min_control)
        x = self._tested(smoothed, smooth_bp)
        out = dispatch.site_test(x, self._groups(test, formula, contrast, covariates), test, dispersion, reference, separated)
        out = tests.masked(out, x, self.is_case, min_case, min_control)
        if permutations:
            if test not in ("lr", "score"):
                raise ValueError("labels are permuted for lr and score")
            null = tests.permuted_tests(x, tests.label_sets(self.case, self.control, permutations, seed), test, dispersion, reference)
            out = fdr.adjust(tests.permuted_pvalues(out, null), "p_empirical", "bh", alpha, "drop", "q_empirical").drop("reject")
        if neighbour_bp:
            out = regions.combine_neighbours(out, neighbour_bp).drop("pvalue").withColumnRenamed("pvalue_combined", "pvalue")
        self.results[f"dmc_{test}"] = fdr.adjust(out, "pvalue", fdr_method, alpha)
        self.meta["last_dmc"] = f"dmc_{test}"
        return self.results[f"dmc_{test}"]

    def get_dmc(self, test: str | None = None, annotated: bool = True) -> DataFrame:
        """The table of a test, or of the last one; with features where it has been annotated."""
        name = f"dmc_{test}" if test else self.meta.get("last_dmc")
        if name not in self.results:
            raise KeyError(f"no {name}; there are {sorted(self.results)}")
        return self.results.get(f"{name}_annotated", self.results[name]) if annotated else self.results[name]

    def significant_dmcs(self, alpha: float = 0.05, test: str | None = None) -> DataFrame:
        x = self.get_dmc(test)
        return x.where(F.col("qvalue" if "qvalue" in x.columns else "pvalue") < alpha)

    def dvc(self, alpha: float = 0.05, mean_alpha: float = 0.05) -> DataFrame:
        x = fdr.adjust(tests.bartlett(self._tested(), self.is_case), "p_var", "bh", alpha, "drop", "q_var").drop("reject")
        self.results["dvc"] = x.withColumn("is_dvc", F.coalesce((F.col("q_var") < alpha) & (F.col("p_mean") > mean_alpha), F.lit(False)))
        return self.results["dvc"]

    # --- regions ----------------------------------------------------------

    def dmr(
        self, method: str = "chain_merge", test: str = "auto", permutations: int = 0, seed: int = 42, min_mean_q: float | None = 0.05, formula: str | None = None, covariates: list[str] | tuple[str, ...] = (), allow_single: bool = False, **settings,
    ) -> DataFrame:
        """Regions by chain_merge, sliding_window, hmm or tile, kept as results["dmr"]; those with a q-value of min_mean_q or more are left out, unless it is None.

        Only tiles are tested anew, by any of the site tests (auto: as for
        sites) or a regression by a formula; where sites were united by
        intersection only tiles that every sample has are. Labels are permuted
        for tiles of lr and score, by the test that was asked for.
        """
        if method == "tile":
            if test == "auto":
                test = "glm" if formula or covariates else tests.auto_test(len(self.case), len(self.control), allow_single)
            united, least = self.meta.get("united", "union"), [settings.get(c, 0) for c in ("min_case", "min_control")]
            tests.check_groups(len(self.case), len(self.control), united, allow_single or test == "fisher" or bool(formula), *least)
            x = self._tested()
            out = regions.dmr_tiles(x, self._groups(test, formula, covariates=covariates), test=test, united=united == "intersect", **settings)
            if permutations:
                if test not in ("lr", "score"):
                    raise ValueError("labels are permuted for lr and score")
                t = regions.tested_tiles(x, settings.get("size", 1000), settings.get("min_cpgs", 5), len(self.samples) if united == "intersect" else None)
                null = tests.permuted_tests(t, tests.label_sets(self.case, self.control, permutations, seed), test, settings.get("dispersion", "site"), settings.get("reference", "adaptive"))
                out = fdr.adjust(tests.permuted_pvalues(out, null), "p_empirical", "bh", 0.05, "drop", "q_empirical").drop("reject")
        else:
            if permutations:
                raise ValueError("labels are permuted for tiles")
            name = self.meta.get("last_dmc") if test == "auto" else f"dmc_{test}"
            source = self.results[name] if name in self.results else self.dmc(test)
            out = {"chain_merge": regions.dmr_chain, "sliding_window": regions.dmr_sliding, "hmm": sequence.dmr_hmm}[method](source, **settings)
        q = next((c for c in ("combined_qvalue", "qvalue") if c in out.columns), None)
        self.results["dmr"] = out if min_mean_q is None or q is None else out.where(F.col(q) < min_mean_q)
        return self.results["dmr"]

    def dvr(self, **settings) -> DataFrame:
        source = self.results["dvc"] if "dvc" in self.results else self.dvc()
        self.results["dvr"] = regions.dvr_density(source, **settings)
        return self.results["dvr"]

    def pmd(self, **settings) -> DataFrame:
        self.results["pmd"] = sequence.pmd(self._tested(), **settings)
        return self.results["pmd"]

    def hmr(self, **settings) -> DataFrame:
        self.results["hmr"] = sequence.hmr(self._tested(), **settings)
        return self.results["hmr"]

    def annotate(self, genes: DataFrame, exons: DataFrame, islands: DataFrame | None = None, significant_only: bool = True, alpha: float = 0.05, gene_types: list[str] | None = None, **index) -> dict[str, DataFrame]:
        """Features, genes, nearest gene start and island context of the last test's sites and of the regions' middles."""
        if gene_types:
            genes = genes.where(F.col("gene_type").isin(gene_types))
            exons = exons.join(genes.select("gene_id").distinct(), "gene_id", "left_semi")
        features = written(A.feature_index(genes, exons, **index))

        def of(x: DataFrame) -> DataFrame:
            x = A.nearest_tss(A.best_feature(A.all_features(x, features), features), genes)
            return x if islands is None else A.island_context(x, islands)

        out = {}
        if name := self.meta.get("last_dmc"):
            out[f"{name}_annotated"] = of(self.significant_dmcs(alpha, name[4:]) if significant_only else self.get_dmc(annotated=False))
        if "dmr" in self.results:
            out["dmr_annotated"] = of(self.results["dmr"].withColumn("pos", F.expr("cast((start + end) div 2 as int)")))
        self.results |= out
        return out

    # --- samples ----------------------------------------------------------

    def qc(self, other_context: DataFrame | None = None, sex_chrom: str | None = None, contamination: bool = False, correlation: str | None = None) -> DataFrame:
        """Quality figures of each sample, added to obs; the tables behind them are kept in results."""
        whole = self.sites.groupBy("sample").agg(F.count("*").alias("n_sites"), F.avg("coverage").alias("mean_coverage"), F.try_divide(F.sum("n_meth").cast("double"), F.sum("coverage")).alias("methylation"))
        outliers = qc.global_methylation(self.sites)
        self.results |= {"qc_summary": qc.sample_summary(self.sites), "qc_global": outliers, "qc_uniformity": qc.coverage_uniformity(self.sites)}
        x = whole.join(outliers.groupBy("sample").agg(F.bool_or("is_outlier").alias("is_outlier")), "sample", "left")
        if other_context is not None:
            x = x.join(qc.conversion_rate(other_context), "sample", "left")
        if sex_chrom:
            x = x.join(qc.sex_check(self.sites, sex_chrom).select("sample", "sex"), "sample", "left")
        if contamination:
            x = x.join(qc.contamination(self.sites).select("sample", "intermediate"), "sample", "left")
        if correlation:
            self.results["qc_correlation"] = qc.sample_correlation(self.sites, self.samples, correlation)
        return self._describe(x)

    def age_clock(self, coefficients: DataFrame, manifest: DataFrame, name: str = "age", **settings) -> DataFrame:
        x = models.age_clock(self.sites, coefficients, manifest, **settings)
        return self._describe(x.select("sample", F.col("age").alias(name)))

    def deconvolve(self, reference: DataFrame, manifest: DataFrame, cell_types: list[str]) -> DataFrame:
        """Proportions, kept as results["deconvolution"], and a column of obs for each cell type."""
        self.results["deconvolution"] = models.deconvolve(self.sites, reference, manifest, cell_types)
        return self._describe(self.results["deconvolution"].groupBy("sample").pivot("cell_type", cell_types).agg(F.first("proportion")))

    def asm(self, calls: DataFrame, alleles: DataFrame, **settings) -> DataFrame:
        self.results["asm"] = reads.allele_specific(calls, alleles, **settings)
        return self.results["asm"]

    def entropy(self, calls: DataFrame, **settings) -> DataFrame:
        self.results["entropy"] = reads.entropy(calls, **settings)
        return self.results["entropy"]

    def dashboard(self, bins: int = 50, top: int = 100, method: str = "spearman") -> dict[str, DataFrame]:
        """The tables of a quality overview: coverage by sample, levels, correlation, and the samples that look most mixed."""
        mixed = qc.contamination(self.sites)
        return {
            "coverage": qc.coverage_histogram(self.sites, bins, top), "levels": qc.global_methylation(self.sites), "uniformity": qc.coverage_uniformity(self.sites),
            "correlation": qc.sample_correlation(self.sites, self.samples, method), "contamination": mixed, "worst": profiles.worst_samples(mixed),
        }

    # --- reports and storage ---------------------------------------------

    def report(self, n: int = 50, alpha: float = 0.05, delta: float = 0.1) -> dict[str, DataFrame]:
        """The tables of a report: samples, counts of hits, best sites and regions; each short."""
        out = {"samples": self.obs}
        if self.meta.get("last_dmc"):
            x = self.get_dmc()
            out |= {"hits": profiles.hit_counts(x, alpha, delta), "top_dmcs": profiles.top_sites(x, n)}
        if "dmr" in self.results:
            x = self.results["dmr"]
            out["top_dmrs"] = profiles.top_regions(x, n, "combined_qvalue" if "combined_qvalue" in x.columns else "qvalue" if "qvalue" in x.columns else "mean_q")
        return out

    def signature(self) -> str:
        """A key of the sites, samples and settings; results are reused under the same key only."""
        return store.signature(store.data_signature(self.sites), self.case, self.control, self.meta)

    def save(self, path: str) -> None:
        """Sites, samples, results and settings in one commit; the frame may have been loaded from the same path. A load sees this save or the one before, whatever ends it midway."""
        v = Versions(self.sites.sparkSession, path)
        folder = v.fresh()
        sites = self.sites.repartition("sample", "chrom").sortWithinPartitions("sample", "chrom", "pos")
        sites.write.option("compression", "zstd").partitionBy("sample", "chrom").parquet(f"{v.root}/{folder}/sites")
        self.obs.write.parquet(f"{v.root}/{folder}/obs")
        for k, df in self.results.items():
            df.write.option("compression", "zstd").parquet(f"{v.root}/{folder}/results/{k}")
        about = {"case": self.case, "control": self.control, "meta": self.meta, "results": sorted(self.results), "signature": self.signature(), "schema": self.sites.schema.jsonValue()}
        v.change(lambda _: about | {"folder": folder})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> MethylFrame:
        v = Versions(spark, path)
        about = v.current()[1]
        if about is None:
            raise FileNotFoundError(f"no saved frame at {path}")
        at = f"{v.root}/{about['folder']}"
        results = {k: spark.read.parquet(f"{at}/results/{k}") for k in about["results"]}
        schema = StructType.fromJson(about["schema"])
        sites = spark.read.schema(schema).parquet(f"{at}/sites").select(*schema.names)
        obs = spark.read.parquet(f"{at}/obs")
        return cls(sites, about["case"], about["control"], results, about["meta"], obs)
