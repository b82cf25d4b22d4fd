"""Registered queries of the methylation operators, each beside its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import annotate as A
from ..operators import dispatch, fdr, matrix, models, profiles as P, qc, ranges, reads, regions, sequence, sites as S, tests
from ..functions.tables import scratch, written
from ..sources import bigwig, fasta, indexed, readers, sinks, store, views as V
from . import tails as T
from .frame import MethylFrame

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *needs: str):
    """Registers a function by its name; needs: views that its SQL reads."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = (f"WITH {', '.join(needs)} " if needs else "") + sql
        return fn

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(F.col(f"`{c}`").cast("double"), digits).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes))




def is_case():
    return F.col("sample").isin(V.CASE)


S_, R_, G_, E_, I_, C_, L_, D_ = V.SITES, V.REGIONS, V.GENES, V.EXONS, V.ISLANDS, V.CALLS, V.ALLELES, V.RESULTS

# --- sources ---------------------------------------------------------------


@query("SELECT * FROM sites", S_)
def sites_view(spark, d):
    return V.sites(spark, d)


@query("SELECT chrom, pos, '*' AS strand, 'CpG' AS context, n_meth, n_unmeth, coverage, sample FROM sites", S_)
def parse_cov_lines(spark, d):
    s = V.sites(spark, d)
    line = F.concat_ws("\t", "chrom", F.col("pos").cast("string"), (F.col("pos") + 1).cast("string"), F.lit("0"), F.col("n_meth").cast("string"), F.col("n_unmeth").cast("string"))
    return readers.parse_coverage(s.select("sample", line.alias("value")))


@query("SELECT chrom, pos, '*' AS strand, 'CpG' AS context, n_meth, n_unmeth, coverage, sample FROM sites", S_)
def parse_bed12_lines(spark, d):
    s = V.sites(spark, d)
    line = F.concat_ws("\t", "chrom", F.col("pos").cast("string"), F.lit("1\t0\t0\t0\t0\t0\t0"), F.col("n_meth").cast("string"), F.col("coverage").cast("string"), F.lit("0"))
    return readers.parse_strand_pairs(s.select("sample", line.alias("value")))


@query("SELECT 's' || s_suppkey AS sample_id, CASE WHEN s_nationkey % 3 = 0 THEN 'case' ELSE 'control' END AS \"group\", 'p' || s_suppkey AS path, CASE WHEN s_nationkey % 3 = 0 THEN 1 ELSE 0 END AS treatment FROM supplier WHERE s_nationkey % 3 < 2")
def samplesheet_obs(spark, d):
    obs = V.table(spark, d, "supplier").selectExpr("concat('s', s_suppkey) AS sample_id", "element_at(array('case', 'control', 'other'), s_nationkey % 3 + 1) AS group", "concat('p', s_suppkey) AS path")
    return readers.with_treatment(obs, "case", "control")


@query("SELECT chrom, CAST(\"start\" AS BIGINT) AS \"start\", CAST(\"end\" AS BIGINT) AS \"end\", region_id FROM regions", R_)
def parse_bed(spark, d):
    r = V.regions(spark, d)
    return readers.parse_bed(r.select(F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("end").cast("string"), "region_id").alias("value")))


@query("SELECT chrom, 'gene' AS feature, \"start\", \"end\", strand, gene_id, gene_id AS gene_name, gene_type FROM genes", G_)
def parse_gtf(spark, d):
    g = V.genes(spark, d)
    line = F.format_string('%s\tx\tgene\t%d\t%d\t.\t%s\t.\tgene_id "%s"; gene_type "%s";', "chrom", F.col("start") + 1, "end", "strand", "gene_id", "gene_type")
    return readers.parse_gtf(g.select(line.alias("value")))


# --- filters, normalisation, sets -------------------------------------------


@query("SELECT sample, chrom, count(*) AS n_sites, round(avg(coverage), 6) AS mean_coverage, round(median(coverage), 6) AS median_coverage, round(sum(n_meth) / CAST(sum(coverage) AS DOUBLE), 6) AS methylation FROM sites GROUP BY ALL", S_)
def sample_summary(spark, d):
    return rounded(qc.sample_summary(V.sites(spark, d)))


_CAPS = "caps AS (SELECT sample, CAST(min(coverage) AS INTEGER) AS cap FROM (SELECT sample, coverage, row_number() OVER (PARTITION BY sample ORDER BY coverage) - 1 AS i, count(*) OVER (PARTITION BY sample) AS n FROM sites) WHERE i >= floor(0.99 * (n - 1) + 0.5) GROUP BY sample)"


@query("SELECT * FROM caps", S_, _CAPS)
def coverage_quantile(spark, d):
    return S.coverage_quantile(V.sites(spark, d), 0.99)


@query("SELECT sites.* FROM sites JOIN caps USING (sample) WHERE coverage >= 60 AND coverage <= cap", S_, _CAPS)
def filter_sites(spark, d):
    s = V.sites(spark, d)
    return S.filter_coverage(s, 60, 99.0).select(*s.columns)


@query("SELECT s.* FROM sites s WHERE NOT EXISTS (SELECT 1 FROM regions r WHERE r.chrom = s.chrom AND s.pos >= r.\"start\" AND s.pos < r.\"end\")", S_, R_)
def blacklist_filter(spark, d):
    return ranges.points_in(V.sites(spark, d), V.regions(spark, d), "left_anti")


def _norm_sql(stat):
    return (
        f"SELECT s.chrom, s.pos, s.strand, s.context, CAST(round(n_meth * f) AS INTEGER) AS n_meth, CAST(round(n_unmeth * f) AS INTEGER) AS n_unmeth, CAST(round(n_meth * f) AS INTEGER) + CAST(round(n_unmeth * f) AS INTEGER) AS coverage, s.sample "
        f"FROM sites s JOIN (SELECT sample, (SELECT {stat}(c) FROM ctr) / c AS f FROM ctr) USING (sample)"
    )


@query(_norm_sql("median"), S_, "ctr AS (SELECT sample, CAST(median(coverage) AS DOUBLE) AS c FROM sites GROUP BY sample)")
def normalize_median(spark, d):
    s = V.sites(spark, d)
    return S.normalize_coverage(s, "median").select(*s.columns)


@query(_norm_sql("avg"), S_, "ctr AS (SELECT sample, avg(coverage) AS c FROM sites GROUP BY sample)")
def normalize_mean(spark, d):
    s = V.sites(spark, d)
    return S.normalize_coverage(s, "mean").select(*s.columns)


@query("SELECT chrom, pos, '+' AS strand FROM sites GROUP BY ALL HAVING count(DISTINCT sample) = 8", S_)
def intersect_sites(spark, d):
    return S.unite(V.sites(spark, d), "intersect", 8)


@query("SELECT DISTINCT chrom, pos, '+' AS strand FROM sites", S_)
def union_sites(spark, d):
    return S.unite(V.sites(spark, d), "union", 8)


@query("SELECT chrom, pos, count(*) FILTER (WHERE sample < 's4') AS n_case, count(*) FILTER (WHERE sample >= 's4') AS n_control FROM sites WHERE coverage > 0 GROUP BY ALL HAVING n_case >= 4 AND n_control >= 3", S_)
def min_samples_guard(spark, d):
    return S.covered_in(V.sites(spark, d), is_case(), 4, 3)


@query("SELECT sample, chrom, pos - CASE WHEN (pos // 100) % 2 = 1 THEN 1 ELSE 0 END AS pos, CAST(sum(n_meth) AS INTEGER) AS n_meth, CAST(sum(n_unmeth) AS INTEGER) AS n_unmeth, count(*) AS n_strands, CAST(sum(n_meth) AS INTEGER) + CAST(sum(n_unmeth) AS INTEGER) AS coverage, '+' AS strand FROM sites GROUP BY ALL", S_)
def merge_strand_pairs(spark, d):
    s = V.sites(spark, d)
    return S.merge_strands(s.withColumn("strand", F.when(F.expr("(pos div 100) % 2 = 1"), "-").otherwise("+")))


@query("SELECT sample, chrom, CAST(pos // 300 AS INTEGER) AS pos, '+' AS strand, 'CpG' AS context, CAST(sum(n_meth) AS INTEGER) AS n_meth, CAST(sum(n_unmeth) AS INTEGER) AS n_unmeth, CAST(sum(coverage) AS INTEGER) AS coverage FROM sites GROUP BY sample, chrom, pos // 300", S_)
def dedupe_sum_sites(spark, d):
    return S.sum_duplicates(V.sites(spark, d).withColumn("pos", F.expr("cast(pos div 300 as int)"))).select("sample", "chrom", "pos", "strand", "context", "n_meth", "n_unmeth", "coverage")


# --- random access, regions, tiles ------------------------------------------

_BETA = "round(n_meth / CAST(nullif(coverage, 0) AS DOUBLE), 6) AS beta"


@query(f"SELECT *, {_BETA} FROM sites WHERE chrom = 'chr1' AND pos >= 1000 AND pos < 9000", S_)
def query_region(spark, d):
    return rounded(S.query_region(V.sites(spark, d), "chr1", 1000, 9000))


@query(f"SELECT s.*, r.\"start\", r.\"end\", r.region_id, {_BETA} FROM sites s JOIN regions r ON r.chrom = s.chrom AND s.pos >= r.\"start\" AND s.pos < r.\"end\"", S_, R_)
def query_regions(spark, d):
    return rounded(S.query_regions(V.sites(spark, d), V.regions(spark, d)))


@query(f"SELECT s.*, {_BETA} FROM sites s WHERE (chrom, pos) IN (SELECT chrom, \"start\" FROM regions)", S_, R_)
def query_sites(spark, d):
    return rounded(S.query_sites(V.sites(spark, d), V.regions(spark, d).withColumnRenamed("start", "pos")))


@query("SELECT a.sample, round(beta, 6) AS beta, coalesce(n_sites, 0) AS n_sites, round(mean_coverage, 6) AS mean_coverage FROM (SELECT DISTINCT sample FROM sites) a LEFT JOIN (SELECT sample, sum(n_meth) / CAST(greatest(sum(coverage), 1) AS DOUBLE) AS beta, count(*) AS n_sites, avg(coverage) AS mean_coverage FROM sites WHERE chrom = 'chr2' AND pos BETWEEN 2000 AND 8000 GROUP BY sample) b USING (sample)", S_)
def region_beta(spark, d):
    s = V.sites(spark, d)
    return rounded(S.region_beta(s, s.select("sample").distinct(), "chr2", 2000, 8000))


@query("""SELECT sample, chrom, region_id, "start", "end", CAST(sum(n_meth) AS BIGINT) AS n_meth, CAST(sum(n_unmeth) AS BIGINT) AS n_unmeth, count(*) AS n_cpgs, CAST(sum(coverage) AS BIGINT) AS coverage, CAST(("start" + "end") // 2 AS INTEGER) AS pos
FROM (SELECT s.sample, s.chrom, s.pos AS p, s.n_meth, s.n_unmeth, s.coverage, r."start", r."end", r.region_id FROM sites s ASOF JOIN regions r ON s.chrom = r.chrom AND s.pos >= r."start") WHERE p < "end" GROUP BY ALL""", S_, R_)
def aggregate_regions(spark, d):
    return S.aggregate_regions(V.sites(spark, d), V.regions(spark, d))


@query("SELECT sample, chrom, CAST(pos // 1000 * 1000 AS INTEGER) AS pos, CAST(sum(n_meth) AS BIGINT) AS n_meth, CAST(sum(n_unmeth) AS BIGINT) AS n_unmeth, count(*) AS n_cpgs, '+' AS strand, CAST(sum(coverage) AS BIGINT) AS coverage FROM sites GROUP BY sample, chrom, pos // 1000", S_)
def tile_counts(spark, d):
    return S.tiles(V.sites(spark, d), 1000)


@query("SELECT chrom, pos, " + ", ".join(f"round(max(n_meth / CAST(nullif(coverage, 0) AS DOUBLE)) FILTER (WHERE sample = '{s}'), 6) AS {s}" for s in V.SAMPLES) + " FROM sites GROUP BY chrom, pos", S_)
def site_matrix_pivot(spark, d):
    return rounded(S.site_matrix(V.sites(spark, d), V.SAMPLES))


# --- quality control ---------------------------------------------------------


@query("SELECT sample, context, n_sites, round(methylation, 6) AS methylation, coalesce(n >= 3 AND mad > 0 AND dev > 3 * 1.4826 * mad, false) AS is_outlier FROM (SELECT *, median(dev) OVER (PARTITION BY context) AS mad FROM (SELECT *, abs(methylation - median(methylation) OVER (PARTITION BY context)) AS dev, count(*) OVER (PARTITION BY context) AS n FROM (SELECT sample, context, count(*) AS n_sites, sum(n_meth) / CAST(sum(coverage) AS DOUBLE) AS methylation FROM sites GROUP BY ALL)))", S_)
def global_methylation_mad(spark, d):
    return rounded(qc.global_methylation(V.sites(spark, d)))


@query("SELECT sample, chrom, n_sites, round(mean_coverage, 6) AS mean_coverage, round(g50 / CAST(n_sites AS DOUBLE), 6) AS frac_ge_50x, round(g100 / CAST(n_sites AS DOUBLE), 6) AS frac_ge_100x FROM (SELECT * FROM b UNION ALL SELECT sample, 'genome', CAST(sum(n_sites) AS BIGINT), avg(mean_coverage), sum(g50), sum(g100) FROM b GROUP BY sample)", S_, "b AS (SELECT sample, chrom, count(*) AS n_sites, avg(coverage) AS mean_coverage, count(*) FILTER (WHERE coverage >= 50) AS g50, count(*) FILTER (WHERE coverage >= 100) AS g100 FROM sites GROUP BY ALL)")
def coverage_uniformity(spark, d):
    return rounded(qc.coverage_uniformity(V.sites(spark, d), (50, 100)))


@query("SELECT sample, round(1 - sum(n_meth) / CAST(sum(coverage) AS DOUBLE), 6) AS conversion_rate FROM sites GROUP BY sample", S_)
def conversion_rate(spark, d):
    return rounded(qc.conversion_rate(V.sites(spark, d)))


@query("SELECT sample, count(*) AS n_sites, round(avg(CASE WHEN n_meth / CAST(coverage AS DOUBLE) > 0.2 AND n_meth / CAST(coverage AS DOUBLE) < 0.8 THEN 1 ELSE 0 END), 6) AS intermediate FROM sites WHERE coverage >= 10 GROUP BY sample", S_)
def contamination(spark, d):
    return rounded(qc.contamination(V.sites(spark, d)))


@query("SELECT sample, round(x_beta, 6) AS x_beta, CASE WHEN x_beta > (SELECT (x_beta + prev) / 2 FROM g WHERE prev IS NOT NULL ORDER BY x_beta - prev DESC, x_beta LIMIT 1) THEN 'XX' ELSE 'XY' END AS sex FROM g", S_, "g AS (SELECT *, lag(x_beta) OVER (ORDER BY x_beta, sample) AS prev FROM (SELECT sample, sum(n_meth) / CAST(sum(coverage) AS DOUBLE) AS x_beta FROM sites WHERE chrom = 'chr4' AND coverage >= 5 GROUP BY sample))")
def sex_gap(spark, d):
    return rounded(qc.sex_check(V.sites(spark, d), "chr4"))


_WIDE = "w AS (SELECT chrom, pos, " + ", ".join(f"max(n_meth / CAST(coverage AS DOUBLE)) FILTER (WHERE sample = '{s}') AS {s}" for s in V.SAMPLES) + " FROM sites WHERE coverage >= 10 GROUP BY chrom, pos HAVING count(*) = 8)"
_PAIRS = [(a, b) for i, a in enumerate(V.SAMPLES) for b in V.SAMPLES[i + 1 :]]


@query(" UNION ALL ".join(f"SELECT '{a}' AS sample_a, '{b}' AS sample_b, round(corr({a}, {b}), 6) AS r FROM w" for a, b in _PAIRS), S_, _WIDE)
def corr_pearson(spark, d):
    return rounded(qc.sample_correlation(V.sites(spark, d), V.SAMPLES))


_RANKED = "k AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {s}) + (count(*) OVER (PARTITION BY {s}) - 1) / 2.0 AS {s}" for s in V.SAMPLES) + " FROM w)"


@query(" UNION ALL ".join(f"SELECT '{a}' AS sample_a, '{b}' AS sample_b, round(corr({a}, {b}), 6) AS r FROM k" for a, b in _PAIRS), S_, _WIDE, _RANKED)
def corr_spearman(spark, d):
    return rounded(qc.sample_correlation(V.sites(spark, d), V.SAMPLES, "spearman"))


@query("SELECT sample, CAST(least(floor(coverage * 20 / 400.0), 19) AS INTEGER) AS bin, count(*) AS n FROM sites GROUP BY ALL", S_)
def coverage_hist(spark, d):
    return qc.coverage_histogram(V.sites(spark, d), 20, 400)


# --- tests -------------------------------------------------------------------


def _acc(g, on):
    n, m = "CAST(coverage AS DOUBLE)", "CAST(n_meth AS DOUBLE)"
    return (
        f"CAST(coalesce(sum(coverage) FILTER (WHERE {on}), 0) AS BIGINT) AS s0_{g}, CAST(coalesce(sum(n_meth) FILTER (WHERE {on}), 0) AS BIGINT) AS s1_{g}, coalesce(sum({m} * {m} / {n}) FILTER (WHERE {on} AND coverage > 0), 0) AS s2_{g}, "
        f"count(*) FILTER (WHERE {on} AND coverage > 0) AS v_{g}, avg({m} / {n}) FILTER (WHERE {on} AND coverage > 0) AS mean_{g}, var_samp({m} / {n}) FILTER (WHERE {on} AND coverage > 0) AS var_{g}"
    )


_ACC = f"acc AS (SELECT chrom, pos, {_acc('a', chr(115) + 'ample < ' + repr('s4'))}, {_acc('b', 'sample >= ' + repr('s4'))} FROM sites GROUP BY chrom, pos)"
_ROUND_ACC = "SELECT chrom, pos, " + ", ".join(f"s0_{g}, s1_{g}, round(s2_{g}, 6) AS s2_{g}, v_{g}, round(mean_{g}, 6) AS mean_{g}, round(var_{g}, 6) AS var_{g}" for g in "ab")


@query(f"{_ROUND_ACC} FROM acc", S_, _ACC)
def accumulators(spark, d):
    return rounded(tests.accumulate(V.sites(spark, d), is_case()))


_DISP = (
    "d0 AS (SELECT *, CAST(s1_a AS DOUBLE) / nullif(s0_a, 0) AS pi_a, CAST(s1_b AS DOUBLE) / nullif(s0_b, 0) AS pi_b, "
    + ", ".join(f"coalesce(CAST(s1_{g} AS DOUBLE) * (s0_{g} - s1_{g}) / nullif(CAST(s0_{g} AS DOUBLE) * s0_{g}, 0), 0) AS den_{g}, s2_{g} - CAST(s1_{g} AS DOUBLE) * s1_{g} / nullif(s0_{g}, 0) AS num_{g}" for g in "ab")
    + " FROM acc), d1 AS (SELECT *, "
    + ", ".join(f"CASE WHEN den_{g} > 0 THEN num_{g} / den_{g} ELSE 0 END AS chi_{g}" for g in "ab")
    + ", s0_a > 0 AND s0_b > 0 AND v_a > 0 AND v_b > 0 AS both_, s0_a > 0 AND s0_b > 0 AND v_a > 0 AND v_b > 0 AND den_a > 0 AND den_b > 0 AS disp, v_a + v_b - 2 AS df FROM d0), "
    "d2 AS (SELECT *, greatest(CASE WHEN disp AND df > 0 THEN (chi_a + chi_b) / df ELSE 1 END, 1.0) AS phi_site FROM d1), "
    "dc AS (SELECT chrom, count(*) FILTER (WHERE disp) AS nd, sum(chi_a + chi_b) FILTER (WHERE disp) AS sc, sum(v_a + v_b) FILTER (WHERE disp) AS sv, avg(phi_site) FILTER (WHERE disp) AS m, var_pop(phi_site) FILTER (WHERE disp) AS v FROM d2 GROUP BY chrom), "
    "dd AS (SELECT chrom, greatest(1.0, CASE WHEN nd >= 100 THEN sc / greatest(sv - 2 * nd, 1) ELSE 1 END) AS phi_chrom, CASE WHEN nd >= 100 AND v > 1e-9 THEN greatest(1.0, 2 * (m * m / v + 2)) ELSE 4.0 END AS w FROM dc)"
)
_PHI = {
    "site": "SELECT chrom, pos, round(phi_site, 6) AS phi FROM d2",
    "chrom": "SELECT chrom, pos, round(phi_chrom, 6) AS phi FROM d2 JOIN dd USING (chrom)",
    "shrink": "SELECT chrom, pos, round(CASE WHEN disp THEN greatest(1.0, (df * phi_site + 4 * phi_chrom) / nullif(df + 4, 0)) ELSE phi_chrom END, 6) AS phi FROM d2 JOIN dd USING (chrom)",
    "eb": "SELECT chrom, pos, round(CASE WHEN disp THEN greatest(1.0, (df * phi_site + w * phi_chrom) / nullif(df + w, 0)) ELSE phi_chrom END, 6) AS phi FROM d2 JOIN dd USING (chrom)",
}


def _phi(mode):
    def fn(spark, d):
        return rounded(tests.with_dispersion(tests.accumulate(V.sites(spark, d), is_case()), mode).select("chrom", "pos", "phi"))

    fn.__name__ = f"dispersion_{mode}"
    query(_PHI[mode], S_, _ACC, _DISP)(fn)


for _mode in _PHI:
    _phi(_mode)

_CL = "least(greatest({}, 1e-6), 1 - 1e-6)"
_RAW = (
    f"raw AS (SELECT *, CASE WHEN both_ AND va > 0 THEN (s1_a - s0_a * pu) ** 2 / va END AS score_raw, CASE WHEN both_ AND va > 0 THEN 2 * (s1_a * ln({_CL.format('pi_a')} / p) + (s0_a - s1_a) * ln((1 - {_CL.format('pi_a')}) / (1 - p)) "
    f"+ s1_b * ln({_CL.format('pi_b')} / p) + (s0_b - s1_b) * ln((1 - {_CL.format('pi_b')}) / (1 - p))) END AS lr_raw FROM (SELECT *, CAST(s0_a AS DOUBLE) * s0_b / nullif(s0_a + s0_b, 0) * p * (1 - p) AS va FROM "
    f"(SELECT *, CAST(s1_a + s1_b AS DOUBLE) / nullif(s0_a + s0_b, 0) AS pu, {_CL.format('CAST(s1_a + s1_b AS DOUBLE) / nullif(s0_a + s0_b, 0)')} AS p FROM d2)))"
)


@query("SELECT chrom, pos, round(score_raw, 6) AS score_raw FROM raw", S_, _ACC, _DISP, _RAW)
def score_stat(spark, d):
    return rounded(tests.raw_statistics(tests.with_dispersion(tests.accumulate(V.sites(spark, d), is_case()))).select("chrom", "pos", "score_raw"))


@query("SELECT chrom, pos, round(lr_raw, 6) AS lr_raw FROM raw", S_, _ACC, _DISP, _RAW)
def lr_stat(spark, d):
    return rounded(tests.raw_statistics(tests.with_dispersion(tests.accumulate(V.sites(spark, d), is_case()))).select("chrom", "pos", "lr_raw"))


@query(
    "SELECT chrom, pos, round(sum(a - r1 * c1 / n), 5) AS ome, round(sum(r1 * r2 * c1 * (n - c1) / (n * n * (n - 1))), 5) AS \"var\", round(sum(a * (r2 - c) / n), 5) AS or_num, round(sum((r1 - a) * c / n), 5) AS or_den FROM "
    "(SELECT *, r1 + r2 AS n, a + c AS c1 FROM (SELECT x.chrom, x.pos, CAST(x.n_meth AS DOUBLE) AS a, CAST(x.coverage AS DOUBLE) AS r1, CAST(y.n_meth AS DOUBLE) AS c, CAST(y.coverage AS DOUBLE) AS r2 FROM sites x JOIN sites y ON x.chrom = y.chrom AND x.pos = y.pos AND x.sample < 's4' AND y.sample >= 's4')) WHERE n > 1 GROUP BY chrom, pos", S_)
def cmh_stat(spark, d):
    return rounded(tests.cmh(V.sites(spark, d), is_case()).select("chrom", "pos", "ome", "var", "or_num", "or_den"), 5)


def _welch_exact(logit):
    loc = (lambda g: f"ln({_CL.format('mean_' + g)} / (1 - {_CL.format('mean_' + g)}))") if logit else (lambda g: f"mean_{g}")
    jac = (lambda g: f"* (1 / ({_CL.format('mean_' + g)} * (1 - {_CL.format('mean_' + g)}))) ** 2") if logit else (lambda g: "")
    stat, df = "CASE WHEN ok AND ea + eb > 0 THEN (la - lb) / sqrt(ea + eb) END", "CASE WHEN ok AND ea + eb > 0 THEN greatest(1.0, (ea + eb) ** 2 / nullif(ea * ea / greatest(v_a - 1, 1) + eb * eb / greatest(v_b - 1, 1), 0)) END"
    own = f"v_a > 0 AND v_b > 0 AND s0_a > 0 AND s0_b > 0 AS ok, {loc('a')} AS la, {loc('b')} AS lb, coalesce(var_a, 0) {jac('a')} / greatest(v_a, 1) AS ea, coalesce(var_b, 0) {jac('b')} / greatest(v_b, 1) AS eb"
    return f"SELECT *, phi_site AS phi, {stat} AS stat, {df} AS t_df FROM (SELECT *, {own} FROM d2)"


def _welch_sql(logit):
    return f"SELECT chrom, pos, round(stat, 6) AS stat, round(t_df, 5) AS t_df FROM ({_welch_exact(logit)})"


def _welch_query(spark, d, how):
    x = tests.welch(V.sites(spark, d), is_case(), how)
    return x.select("chrom", "pos", F.round("stat", 6).alias("stat"), F.round("t_df", 5).alias("t_df"))


@query(_welch_sql(False), S_, _ACC, _DISP)
def welch_stat(spark, d):
    return _welch_query(spark, d, "none")


@query(_welch_sql(True), S_, _ACC, _DISP)
def logit_t_stat(spark, d):
    return _welch_query(spark, d, "logit")


_BARTLETT = "CASE WHEN v_a > 1 AND v_b > 1 AND var_a > 0 AND var_b > 0 THEN ((v_a + v_b - 2) * ln(((v_a - 1) * var_a + (v_b - 1) * var_b) / (v_a + v_b - 2)) - (v_a - 1) * ln(var_a) - (v_b - 1) * ln(var_b)) / (1 + (1.0 / (v_a - 1) + 1.0 / (v_b - 1) - 1.0 / (v_a + v_b - 2)) / 3) END"


@query(f"SELECT chrom, pos, round({_BARTLETT}, 5) AS bartlett, round(CASE WHEN v_a > 1 AND v_b > 1 AND var_a > 0 AND var_b > 0 THEN log2(var_a / var_b) END, 5) AS var_log_ratio FROM acc", S_, _ACC)
def bartlett_stat(spark, d):
    return rounded(tests.bartlett(V.sites(spark, d), is_case()).select("chrom", "pos", "bartlett", "var_log_ratio"), 5)


_SE = "sqrt(coalesce(var_a / nullif(v_a, 0), 0) + coalesce(var_b / nullif(v_b, 0), 0))"
_DIFF = "CASE WHEN pi_a IS NOT NULL AND pi_b IS NOT NULL THEN round({}, 4) END"


@query(f"SELECT chrom, pos, {_DIFF.format('greatest(-1.0, pi_a - pi_b - 1.959963984540054 * se)')} AS lo, {_DIFF.format('least(1.0, pi_a - pi_b + 1.959963984540054 * se)')} AS hi FROM (SELECT *, {_SE} AS se FROM d2)", S_, _ACC, _DISP)
def ci_meth_diff(spark, d):
    x = tests.with_dispersion(tests.accumulate(V.sites(spark, d), is_case()))
    lo, hi = C.welch_ci(F.col("pi_a"), F.coalesce(F.try_divide("var_a", "v_a"), F.lit(0.0)), F.col("pi_b"), F.coalesce(F.try_divide("var_b", "v_b"), F.lit(0.0)))
    return x.select("chrom", "pos", F.round(lo, 4).alias("lo"), F.round(hi, 4).alias("hi"))


@query(f"SELECT chrom, pos, round(log2(({_CL.format('pi_a')} / (1 - {_CL.format('pi_a')})) / ({_CL.format('pi_b')} / (1 - {_CL.format('pi_b')}))), 5) AS log2_odds FROM d2 WHERE pi_a IS NOT NULL AND pi_b IS NOT NULL", S_, _ACC, _DISP)
def log2_odds(spark, d):
    x = tests.with_dispersion(tests.accumulate(V.sites(spark, d), is_case())).where("pi_a IS NOT NULL AND pi_b IS NOT NULL")
    return x.select("chrom", "pos", F.round(C.log2_odds_ratio(F.col("pi_a"), F.col("pi_b")), 5).alias("log2_odds"))


_LOG2 = f"CASE WHEN {{0}}_a IS NOT NULL AND {{0}}_b IS NOT NULL THEN log2(({_CL.format('{0}_a')} / (1 - {_CL.format('{0}_a')})) / ({_CL.format('{0}_b')} / (1 - {_CL.format('{0}_b')}))) END"


def _effects(mean):
    single = lambda x: f"round(CAST(CAST({x} AS FLOAT) AS DOUBLE), 6)"
    return f"{single(mean + '_a')} AS mean_beta_case, {single(mean + '_b')} AS mean_beta_control, {single(f'{mean}_a - {mean}_b')} AS meth_diff, round({_LOG2.format(mean)}, 6) AS log2_odds_ratio"


def _tested(effects):
    return f"SELECT chrom, pos, {effects}, round(stat, 6) AS stat, round(phi, 6) AS phi, round(pvalue, 6) AS pvalue, round(q, 6) AS qvalue, coalesce(q <= 0.05, false) AS reject FROM {T.bh('tested', 'pvalue')}"


_EB = "CASE WHEN disp THEN greatest(1.0, (df * phi_site + w * phi_chrom) / nullif(df + w, 0)) ELSE phi_chrom END"


def _quasi(stat, phi, reference="adaptive"):
    f, chi = T.f1("stat", "greatest(df, 1)"), T.chi2("stat")
    p = f"CASE WHEN phi > 1 THEN {f} ELSE {chi} END" if reference == "adaptive" else chi
    return f"tested AS (SELECT *, {p} AS pvalue FROM (SELECT *, {stat} / phi AS stat FROM (SELECT *, {phi} AS phi FROM raw JOIN dd USING (chrom))))"


def _welch(logit):
    return f"tested AS (SELECT *, {T.f1('(stat * stat)', 't_df')} AS pvalue FROM ({_welch_exact(logit)}))"


_CMH = (
    "strata AS (SELECT x.chrom, x.pos, CAST(x.n_meth AS DOUBLE) AS a, CAST(x.coverage AS DOUBLE) AS r1, CAST(y.n_meth AS DOUBLE) AS c, CAST(y.coverage AS DOUBLE) AS r2 FROM sites x JOIN sites y ON x.chrom = y.chrom AND x.pos = y.pos AND x.sample < 's4' AND y.sample >= 's4'), "
    "cm AS (SELECT chrom, pos, sum(a - r1 * c1 / n) AS ome, sum(r1 * r2 * c1 * (n - c1) / (n * n * (n - 1))) AS va, sum(a * (r2 - c) / n) AS num, sum((r1 - a) * c / n) AS den FROM (SELECT *, r1 + r2 AS n, a + c AS c1 FROM strata) WHERE n > 1 GROUP BY chrom, pos), "
    "tested AS (SELECT *, " + T.chi2("stat") + " AS pvalue FROM (SELECT *, CASE WHEN va > 0 THEN ome * ome / va END AS stat, CASE WHEN num > 0 AND den > 0 THEN log2(num / den) END AS lor FROM cm))"
)


_FISHER_OR = "CASE WHEN s0_a > 0 AND s0_b > 0 AND s1_a * (s0_b - s1_b) > 0 THEN CASE WHEN (s0_a - s1_a) * s1_b > 0 THEN round(log2(CAST(s1_a AS DOUBLE) * (s0_b - s1_b) / (CAST(s0_a - s1_a AS DOUBLE) * s1_b)), 6) ELSE CAST('inf' AS DOUBLE) END END"
_LEVELS = _effects("mean").split(", round(CASE")[0]


@query(f"SELECT chrom, pos, round({T.fisher_doubled('s1_a', '(s0_a - s1_a)', 's1_b', '(s0_b - s1_b)')}, 6) AS pvalue, {_FISHER_OR} AS log2_odds_ratio, {_LEVELS} FROM d2", S_, _ACC, _DISP)
def fisher_pooled(spark, d):
    return rounded(tests.fisher(V.sites(spark, d), is_case()).select("chrom", "pos", "pvalue", "log2_odds_ratio", "mean_beta_case", "mean_beta_control", "meth_diff"))


def _dmc(name, make, sql, *needs):
    def fn(spark, d):
        x = make(V.sites(spark, d))
        cols = [c for c in ("mean_beta_case", "mean_beta_control", "meth_diff", "log2_odds_ratio", "stat", "phi", "pvalue") if c in x.columns]
        return rounded(fdr.adjust(x.select("chrom", "pos", *cols)))

    fn.__name__ = name
    query(sql, *needs)(fn)


_dmc("dmc_lr", lambda s: tests.quasi_binomial(s, is_case(), "lr", "eb"), _tested(_effects("pi")), S_, _ACC, _DISP, _RAW, _quasi("lr_raw", _EB))
_dmc("dmc_score", lambda s: tests.quasi_binomial(s, is_case(), "score", "site"), _tested(_effects("pi")), S_, _ACC, _DISP, _RAW, _quasi("score_raw", "phi_site"))
_dmc(
    "dmc_cmh", lambda s: tests.cmh(s, is_case()),
    f"SELECT chrom, pos, {_LEVELS}, round(lor, 6) AS log2_odds_ratio, round(stat, 6) AS stat, round(pvalue, 6) AS pvalue, round(q, 6) AS qvalue, coalesce(q <= 0.05, false) AS reject FROM {T.bh('(SELECT tested.*, mean_a, mean_b FROM tested JOIN acc USING (chrom, pos))', 'pvalue')}", S_, _ACC, _CMH,
)
_dmc("dmc_welch", lambda s: tests.welch(s, is_case()), _tested(_effects("mean")), S_, _ACC, _DISP, _welch(False))
_dmc("dmc_logit_t", lambda s: tests.welch(s, is_case(), "logit"), _tested(_effects("mean")), S_, _ACC, _DISP, _welch(True))
_FAR = "CASE WHEN both_ AND abs(pi_a - pi_b) >= 0.2 AND pvalue > 0.05 THEN least(pvalue, exact) ELSE pvalue END"
_TWO_SIDED = (
    "least(1.0, list_sum(list_filter(list_transform(range(greatest(0, s1_a + s1_b - s0_b), least(s0_a, s1_a + s1_b) + 1), lambda x: exp(lgamma(s0_a + 1) - lgamma(x + 1) - lgamma(s0_a - x + 1) + lgamma(s0_b + 1) - lgamma(s1_a + s1_b - x + 1) - lgamma(s0_b - s1_a - s1_b + x + 1) "
    "- lgamma(s0_a + s0_b + 1) + lgamma(s1_a + s1_b + 1) + lgamma(s0_a + s0_b - s1_a - s1_b + 1))), lambda p: p <= (1 + 1e-7) * exp(lgamma(s0_a + 1) - lgamma(s1_a + 1) - lgamma(s0_a - s1_a + 1) + lgamma(s0_b + 1) - lgamma(s1_b + 1) - lgamma(s0_b - s1_b + 1) "
    "- lgamma(s0_a + s0_b + 1) + lgamma(s1_a + s1_b + 1) + lgamma(s0_a + s0_b - s1_a - s1_b + 1)))))"
)


@query(f"SELECT chrom, pos, round({_FAR}, 6) AS pvalue FROM (SELECT *, {_TWO_SIDED} AS exact FROM tested)", S_, _ACC, _DISP, _RAW, _quasi("lr_raw", _EB))
def exact_fallback(spark, d):
    return rounded(tests.quasi_binomial(V.sites(spark, d), is_case(), "lr", "eb", separated=0.2).select("chrom", "pos", "pvalue"))


@query("SELECT t.chrom, t.pos, CASE WHEN coalesce(g.n_case, 0) >= 3 AND coalesce(g.n_control, 0) >= 4 THEN round(CAST(CAST(pi_a - pi_b AS FLOAT) AS DOUBLE), 6) END AS meth_diff, CASE WHEN coalesce(g.n_case, 0) >= 3 AND coalesce(g.n_control, 0) >= 4 THEN round(pvalue, 6) END AS pvalue FROM tested t LEFT JOIN (SELECT chrom, pos, count(*) FILTER (WHERE sample < 's4') AS n_case, count(*) FILTER (WHERE sample >= 's4') AS n_control FROM sites WHERE coverage > 0 GROUP BY ALL) g USING (chrom, pos)", S_, _ACC, _DISP, _RAW, _quasi("score_raw", "phi_site"))
def sample_minima(spark, d):
    s = V.sites(spark, d)
    return rounded(tests.masked(tests.quasi_binomial(s, is_case(), "score", "site"), s, is_case(), 3, 4).select("chrom", "pos", "meth_diff", "pvalue"))


_SETS = tests.label_sets(V.CASE, V.CONTROL, 4)
_PERM_ACC = (
    "sets(perm, cs) AS (VALUES " + ", ".join(f"({i}, {x!r})" for i, x in enumerate(_SETS)) + "), pacc AS (SELECT perm, chrom, pos, "
    + ", ".join(f"coalesce(sum(coverage) FILTER (WHERE {on}), 0) AS s0_{g}, coalesce(sum(n_meth) FILTER (WHERE {on}), 0) AS s1_{g}, coalesce(sum(CAST(n_meth AS DOUBLE) * n_meth / coverage) FILTER (WHERE {on} AND coverage > 0), 0) AS s2_{g}, count(*) FILTER (WHERE {on} AND coverage > 0) AS v_{g}" for g, on in (("a", "list_contains(cs, sample)"), ("b", "NOT list_contains(cs, sample)")))
    + " FROM sites, sets GROUP BY ALL)"
)
_PERM_STAT = (
    "pst AS (SELECT perm, chrom, pos, CASE WHEN ok AND va > 0 THEN (s1_a - s0_a * pu) ** 2 / va / greatest(1.0, CASE WHEN den_a > 0 AND den_b > 0 AND v_a + v_b > 2 THEN (num_a / nullif(den_a, 0) + num_b / nullif(den_b, 0)) / (v_a + v_b - 2) ELSE 1 END) END AS stat FROM (SELECT *, s0_a * s0_b / nullif(s0_a + s0_b, 0) * p * (1 - p) AS va FROM (SELECT *, v_a > 0 AND v_b > 0 AS ok, "
    f"CAST(s1_a + s1_b AS DOUBLE) / nullif(s0_a + s0_b, 0) AS pu, {_CL.format('CAST(s1_a + s1_b AS DOUBLE) / nullif(s0_a + s0_b, 0)')} AS p, "
    + ", ".join(f"CAST(s1_{g} AS DOUBLE) * (s0_{g} - s1_{g}) / nullif(CAST(s0_{g} AS DOUBLE) * s0_{g}, 0) AS den_{g}, s2_{g} - CAST(s1_{g} AS DOUBLE) * s1_{g} / nullif(s0_{g}, 0) AS num_{g}" for g in "ab")
    + " FROM pacc)))"
)


@query(f"SELECT perm, chrom, pos, round({T.chi2('stat')}, 6) AS pvalue FROM pst", S_, _PERM_ACC, _PERM_STAT)
def permuted_sites(spark, d):
    return rounded(tests.permuted_tests(V.sites(spark, d), _SETS, "score", "site", "chi2"))


_TILED = "allsites AS (SELECT * FROM sites), tl AS (SELECT sample, chrom, CAST(pos // 1000 * 1000 AS INTEGER) AS pos, sum(n_meth) AS n_meth, sum(coverage) AS coverage, count(*) AS n_cpgs FROM allsites GROUP BY sample, chrom, pos // 1000 HAVING count(*) >= 3)"


@query(f"SELECT perm, chrom, pos, round({T.chi2('stat')}, 6) AS pvalue FROM pst", S_, _TILED, _PERM_ACC.replace("FROM sites, sets", "FROM tl, sets"), _PERM_STAT)
def permuted_tiles(spark, d):
    t = S.tiles(V.sites(spark, d), 1000).where("n_cpgs >= 3")
    return rounded(tests.permuted_tests(t, _SETS, "score", "site", "chi2"))


def _obs():
    return [{"sample": s, "treatment": int(s in V.CASE), "age": 20 + 7 * i} for i, s in enumerate(V.SAMPLES)]


@query()
def dmc_bb_lr(spark, d):
    return rounded(models.two_group_glm(V.sites(spark, d), V.CASE, V.CONTROL, "eb"))


@query()
def dmc_glm(spark, d):
    _, x = models.design(_obs(), "~ treatment + age")
    return rounded(models.glm(V.sites(spark, d), V.SAMPLES, x, x[:, [0, 2]]))


@query()
def dmc_contrast(spark, d):
    names, x = models.design(_obs(), "~ treatment + age")
    return rounded(models.glm(V.sites(spark, d), V.SAMPLES, x, contrasts=models.contrast("treatment - age", names)))


# of equal variances the statistic is 0, but its logarithms can leave it at -4e-16, whose root is no number and sorts above all
@query(f"SELECT chrom, pos, round(CASE WHEN v_a > 1 AND v_b > 1 AND var_a > 0 AND var_b > 0 THEN log2(var_a / var_b) END, 6) AS var_log_ratio, round(p_var, 6) AS p_var, round(q, 6) AS q_var, round(pvalue, 6) AS p_mean, coalesce(q < 0.05 AND pvalue > 0.05, false) AS is_dvc FROM {T.bh('vt', 'p_var', drop=True)}", S_, _ACC, _DISP, _welch(False), f"vt AS (SELECT *, {T.chi2('ba')} AS p_var FROM (SELECT *, CASE WHEN bs < 0 THEN 0 ELSE bs END AS ba FROM (SELECT *, {_BARTLETT} AS bs FROM tested)))")
def dvc(spark, d):
    x = fdr.adjust(tests.bartlett(V.sites(spark, d), is_case()), "p_var", "bh", 0.05, "drop", "q_var")
    return rounded(x.select("chrom", "pos", "var_log_ratio", "p_var", "q_var", "p_mean", F.coalesce((F.col("q_var") < 0.05) & (F.col("p_mean") > 0.05), F.lit(False)).alias("is_dvc")))


# --- multiple testing ---------------------------------------------------------

_RK = "rk AS (SELECT chrom, pos, pvalue, count(*) OVER () AS n, count(*) OVER (ORDER BY pvalue RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS r FROM results)"
_QSQL = "SELECT chrom, pos, round(q, 6) AS qvalue, q <= 0.05 AS reject FROM (SELECT chrom, pos, least(1.0, min(pvalue * n * {f} / r) OVER (ORDER BY pvalue DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS q FROM rk)"
_TWO = "coalesce((SELECT CASE WHEN k IN (0, n) THEN {a} ELSE (n - k) / CAST(n AS DOUBLE) * {a} END FROM (SELECT coalesce(max(r) FILTER (WHERE pvalue * n / r <= 0.05 / {a}), 0) AS k, max(n) AS n FROM rk)), 1.0)"
_FACTORS = {
    "bh": "1.0", "by": "(SELECT sum(1.0 / i) FROM range(1, (SELECT max(n) + 1 FROM rk)) t(i))", "storey": "(SELECT least(1.0, count(*) FILTER (WHERE pvalue > 0.5) / (count(*) * 0.5)) FROM rk)",
    "tsbh": _TWO.format(a="CAST(1.0 AS DOUBLE)"), "tsbky": _TWO.format(a="CAST(1.05 AS DOUBLE)"),
}


def _fdr(method):
    def fn(spark, d):
        return rounded(fdr.adjust(V.results(spark, d).drop("qvalue"), "pvalue", method).select("chrom", "pos", "qvalue", "reject"))

    fn.__name__ = f"fdr_{method}"
    query(_QSQL.format(f=_FACTORS[method]), S_, D_, _RK)(fn)


for _m in _FACTORS:
    _fdr(_m)


@query("SELECT chrom, pos, round(CAST(meth_diff AS DOUBLE) * t / (t + se2), 5) AS shrunk FROM (SELECT *, (SELECT greatest(0.0, var_samp(CAST(meth_diff AS DOUBLE)) - avg(se2)) FROM x) AS t FROM x)", S_, D_, "x AS (SELECT chrom, pos, meth_diff, ((0.2 + pvalue) / (2 * 1.959963984540054)) ** 2 AS se2 FROM results)")
def shrink_meth_diff(spark, d):
    x = V.results(spark, d).withColumns({"meth_diff_ci_lo": F.lit(0.0), "meth_diff_ci_hi": 0.2 + F.col("pvalue")})
    return tests.shrink_differences(x).select("chrom", "pos", F.round("meth_diff_shrunk", 5).alias("shrunk"))


@query("SELECT chrom, pos, round(((SELECT count(*) FROM results y WHERE 1 - y.pvalue * y.pvalue <= x.pvalue) + 1) / CAST((SELECT count(*) FROM results) + 1 AS DOUBLE), 6) AS p_empirical FROM results x", S_, D_)
def empirical_p(spark, d):
    r = written(V.results(spark, d))  # of both tables
    return rounded(tests.permuted_pvalues(r, r.select((1 - F.col("pvalue") * F.col("pvalue")).alias("pvalue"))).select("chrom", "pos", "p_empirical"))


# --- windows and regions --------------------------------------------------------


@query("SELECT sample, chrom, pos, round(avg(n_meth) OVER w, 6) AS meth_sm, round(avg(coverage) OVER w, 6) AS cov_sm FROM sites WINDOW w AS (PARTITION BY sample, chrom ORDER BY pos RANGE BETWEEN 250 PRECEDING AND 250 FOLLOWING)", S_)
def smooth_box(spark, d):
    return rounded(regions.smooth_counts(V.sites(spark, d)).select("sample", "chrom", "pos", "meth_sm", "cov_sm"))


@query("SELECT chrom, pos, count(*) OVER w AS n_near, CASE WHEN meth_diff >= 0 THEN count(*) FILTER (WHERE meth_diff >= 0) OVER w ELSE count(*) FILTER (WHERE meth_diff < 0) OVER w END AS n_agree FROM results WINDOW w AS (PARTITION BY chrom ORDER BY pos RANGE BETWEEN 200 PRECEDING AND 200 FOLLOWING)", S_, D_)
def neighbour_window_counts(spark, d):
    return regions.neighbour_counts(V.results(spark, d)).select("chrom", "pos", "n_near", "n_agree")


_Z = f"zs AS (SELECT pvalue, {T.normal_isf('least(greatest(pvalue, 1e-300), 1 - 1e-12) / 2')} AS z FROM (SELECT DISTINCT pvalue FROM results))"
_NEAR = (
    "nz AS (SELECT chrom, pos, pvalue, n, sz / sqrt(n) AS zz, CASE WHEN meth_diff >= 0 THEN nu ELSE n - nu END / CAST(n AS DOUBLE) AS agree FROM (SELECT *, count(*) OVER w AS n, sum(CASE WHEN meth_diff < 0 THEN -z ELSE z END) OVER w AS sz, count(*) FILTER (WHERE meth_diff >= 0) OVER w AS nu "
    "FROM results JOIN zs USING (pvalue) WINDOW w AS (PARTITION BY chrom ORDER BY pos RANGE BETWEEN 200 PRECEDING AND 200 FOLLOWING)))"
)


@query(f"SELECT chrom, pos, round(CASE WHEN agree >= 0.6 AND pvalue < 0.5 AND pc < pvalue THEN pc ELSE pvalue END, 6) AS pvalue_combined FROM (SELECT *, {T.normal_two_sided('zz')} AS pc FROM nz)", S_, D_, _Z, _NEAR)
def neighbour_combine(spark, d):
    return rounded(regions.combine_neighbours(V.results(spark, d)).select("chrom", "pos", "pvalue_combined"))


_SIG = "sg AS (SELECT *, pvalue < 0.5 AND abs(meth_diff) >= CAST(0.05 AS FLOAT) AS sig FROM results)"


def _sig():
    return regions.significant("pvalue", 0.5, 0.05)


def _sliding(sg):
    windows = f"SELECT chrom, pos AS s, CAST(pos + 500 AS INTEGER) AS e, count(*) OVER w AS n, count(*) FILTER (WHERE sig) OVER w AS ns FROM {sg} WINDOW w AS (PARTITION BY chrom ORDER BY pos RANGE BETWEEN CURRENT ROW AND 499 FOLLOWING)"
    reach = f"SELECT *, max(e) OVER (PARTITION BY chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM ({windows}) WHERE n >= 5 AND ns >= 3"
    return f'SELECT chrom, min(s) AS "start", max(e) AS "end" FROM (SELECT *, sum(CASE WHEN prev IS NULL OR s > prev THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY s ROWS UNBOUNDED PRECEDING) AS k FROM ({reach})) GROUP BY chrom, k'


def _chain(sg, gap):
    step = f"SELECT *, lag(pos) OVER (PARTITION BY chrom ORDER BY pos) AS prev FROM {sg} WHERE sig"
    return f'SELECT chrom, CAST(min(pos) AS INTEGER) AS "start", CAST(max(pos) + 1 AS INTEGER) AS "end" FROM (SELECT *, sum(CASE WHEN prev IS NULL OR pos - prev > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY pos ROWS UNBOUNDED PRECEDING) AS k FROM ({step})) GROUP BY chrom, k HAVING max(pos) + 1 - min(pos) >= 50'


def _scored(spans, sg):
    """CTEs up to `scored`: counts, mean difference, Stouffer's p and direction of spans over the sites of sg."""
    z = T.normal_isf("least(greatest(pvalue, 1e-300), 1 - 1e-15) / 2")
    return (
        f"zd AS (SELECT pvalue, {z} AS z FROM (SELECT DISTINCT pvalue FROM results)), spans AS ({spans}), "
        f'agg AS (SELECT r.chrom, r."start", r."end", count(*) AS n_cpgs, count(*) FILTER (WHERE s.sig) AS n_significant, avg(CAST(s.meth_diff AS DOUBLE)) AS mean_meth_diff, sum(sign(CAST(s.meth_diff AS DOUBLE)) * z) / sqrt(count(z)) AS zz, '
        f'count(*) FILTER (WHERE s.meth_diff > 0) AS up, count(*) FILTER (WHERE s.meth_diff < 0) AS down FROM spans r JOIN {sg} s ON s.chrom = r.chrom AND s.pos >= r."start" AND s.pos < r."end" JOIN zd USING (pvalue) GROUP BY ALL), '
        f"scored AS (SELECT *, {T.normal_two_sided('zz')} AS combined_pvalue, CASE WHEN greatest(up, down) / greatest(up + down, 1) < 0.6 THEN 'mixed' WHEN mean_meth_diff > 0 THEN 'hyper' ELSE 'hypo' END AS dmr_type FROM agg)"
    )


_REGION = 'SELECT chrom, "start", "end", n_cpgs, n_significant, round(mean_meth_diff, 6) AS mean_meth_diff, round(combined_pvalue, 6) AS combined_pvalue, dmr_type, round(q, 6) AS combined_qvalue FROM '


@query(_sliding("sg"), S_, D_, _SIG)
def sliding_spans(spark, d):
    return regions.sliding_spans(V.results(spark, d), _sig())


@query(_chain("sg", 200), S_, D_, _SIG)
def chain_spans(spark, d):
    return regions.chain_spans(V.results(spark, d), _sig(), 200)


def _merged(tiles, more=""):
    """CTEs up to `merged`: neighbouring tiles (chrom, start, end, n_cpgs, meth_diff, pvalue, dmr_type) of one direction as one."""
    p = "least(greatest(pvalue, 1e-300), 1 - 1e-15)"
    isf = f"CASE WHEN {p} <= 0.5 THEN {T.normal_isf(p)} ELSE -{T.normal_isf(f'(1 - {p})')} END"
    half = T.erfc("(abs(z) / sqrt(2))")
    return (
        f"tz AS (SELECT *, {isf} AS z FROM ({tiles})), "
        'ti AS (SELECT *, sum(new) OVER (PARTITION BY chrom ORDER BY "start" ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT *, CASE WHEN lag("end") OVER w IS NULL OR "start" > lag("end") OVER w OR dmr_type <> lag(dmr_type) OVER w THEN 1 ELSE 0 END AS new FROM tz WINDOW w AS (PARTITION BY chrom ORDER BY "start"))), '
        'tg AS (SELECT chrom, min("start") AS "start", max("end") AS "end", CAST(sum(n_cpgs) AS BIGINT) AS n_cpgs, any_value(dmr_type) AS dmr_type, avg(CAST(meth_diff AS DOUBLE)) AS meth_diff, ' + more + 'list_reduce(list(z ORDER BY "start"), lambda a, b: (a + b) / sqrt(2)) AS z FROM ti GROUP BY chrom, k), '
        f"merged AS (SELECT *, CASE WHEN z >= 0 THEN 0.5 * {half} ELSE 1 - 0.5 * {half} END AS pvalue FROM tg)"
    )


_MERGED = f'SELECT chrom, "start", "end", n_cpgs, dmr_type, round(meth_diff, 6) AS meth_diff, round(pvalue, 6) AS pvalue, round(q, 6) AS qvalue FROM {T.bh("merged", "pvalue")}'
_RUNS = 'SELECT chrom, CAST(pos // 1000 * 1000 AS INTEGER) AS "start", CAST(pos // 1000 * 1000 + 1000 AS INTEGER) AS "end", count(*) AS n_cpgs, round(avg(CAST(meth_diff AS DOUBLE)), 9) AS meth_diff, min(pvalue) AS pvalue, CASE WHEN round(avg(CAST(meth_diff AS DOUBLE)), 9) > 0 THEN \'hyper\' ELSE \'hypo\' END AS dmr_type FROM results GROUP BY chrom, pos // 1000'


@query(_MERGED, S_, D_, _merged(_RUNS))
def tile_runs(spark, d):
    t = V.results(spark, d).groupBy("chrom", F.expr("cast(pos div 1000 * 1000 as int)").alias("start")).agg(F.count("*").alias("n_cpgs"), F.round(F.avg(F.col("meth_diff").cast("double")), 9).alias("meth_diff"), F.min("pvalue").alias("pvalue"))
    return rounded(regions.merge_tiles(t.withColumns({"end": F.col("start") + 1000, "dmr_type": F.when(F.col("meth_diff") > 0, "hyper").otherwise("hypo")})))


_SG_Q = "sq AS (SELECT *, qvalue < 0.5 AND abs(meth_diff) >= CAST(0.01 AS FLOAT) AS sig FROM results)"


@query(_REGION + T.bh("(SELECT * FROM scored WHERE n_cpgs >= 5 AND n_significant >= 3 AND abs(mean_meth_diff) >= 0.01)", "combined_pvalue"), S_, D_, _SG_Q, _scored(f'SELECT * FROM ({_sliding("sq")}) WHERE "end" - "start" <= 10000', "sq"))
def dmr_sliding(spark, d):
    return rounded(regions.dmr_sliding(V.results(spark, d), alpha=0.5, delta=0.01))


@query(_REGION + T.bh("(SELECT * FROM scored WHERE n_cpgs >= 3 AND n_significant / n_cpgs >= 0.5)", "combined_pvalue"), S_, D_, _SIG, _scored(_chain("sg", 200), "sg"))
def dmr_chain(spark, d):
    return rounded(regions.dmr_chain(V.results(spark, d), alpha=0.5, delta=0.05, gap=200))


_TILES = "allsites AS (SELECT * FROM sites), tl AS (SELECT sample, chrom, CAST(pos // 800 * 800 AS INTEGER) AS pos, CAST(sum(n_meth) AS BIGINT) AS n_meth, CAST(sum(coverage) AS BIGINT) AS coverage, count(*) AS n_cpgs FROM allsites GROUP BY sample, chrom, pos // 800 HAVING count(*) >= 5)"
_OF_TILES = "log2_odds_ratio", "mean_beta_case", "mean_beta_control"


def _tile_hits(mean, odds, tested="tested"):
    """Tiles of `tested` (mean_a, v_a, pvalue and so on) that differ."""
    x = f"(SELECT t.*, CAST({mean}_a - {mean}_b AS FLOAT) AS diff, n_cpgs FROM {tested} t JOIN (SELECT chrom, pos, max(n_cpgs) AS n_cpgs FROM tl GROUP BY ALL) USING (chrom, pos))"
    return (
        f"SELECT chrom, pos AS \"start\", pos + 800 AS \"end\", n_cpgs, diff AS meth_diff, {odds} AS log2_odds_ratio, CAST({mean}_a AS FLOAT) AS mean_beta_case, CAST({mean}_b AS FLOAT) AS mean_beta_control, v_a AS n_case, v_b AS n_control, pvalue, "
        f"CASE WHEN diff > 0 THEN 'hyper' ELSE 'hypo' END AS dmr_type FROM {T.bh(x, 'pvalue')} WHERE q < 0.5 AND abs(diff) >= CAST(0.02 AS FLOAT)"
    )


def _tile_query(name, test, hits, *needs):
    means = "".join(f"CASE WHEN count({c}) = count(*) THEN avg(CAST({c} AS DOUBLE)) END AS {c}, " for c in _OF_TILES) + "max(n_case) AS n_case, max(n_control) AS n_control, "
    cols = ", ".join(f"round({c}, 6) AS {c}" for c in ("meth_diff", *_OF_TILES, "pvalue"))

    def fn(spark, d):
        return rounded(regions.dmr_tiles(V.sites(spark, d), dispatch.Groups(V.CASE, V.CONTROL), 800, test, alpha=0.5, delta=0.02, reference="chi2"))

    fn.__name__ = name
    sql = f'SELECT chrom, "start", "end", n_cpgs, CAST(n_case AS INTEGER) AS n_case, CAST(n_control AS INTEGER) AS n_control, dmr_type, {cols}, round(q, 6) AS qvalue FROM {T.bh("merged", "pvalue")}'
    query(sql, S_, _TILES, *needs, _merged(hits, means))(fn)


_TACC = _ACC.replace("FROM sites", "FROM tl")
_tile_query("dmr_tile", "logit_t", _tile_hits("mean", _LOG2.format("mean")), _TACC, _DISP, _welch(True))
_tile_query("dmr_tile_welch", "welch_t", _tile_hits("mean", _LOG2.format("mean")), _TACC, _DISP, _welch(False))
_tile_query("dmr_tile_lr", "lr", _tile_hits("pi", _LOG2.format("pi")), _TACC, _DISP, _RAW, _quasi("lr_raw", "phi_site", "chi2"))
_tile_query("dmr_tile_score", "score", _tile_hits("pi", _LOG2.format("pi")), _TACC, _DISP, _RAW, _quasi("score_raw", "phi_site", "chi2"))
_tile_query("dmr_tile_fisher", "fisher", _tile_hits("mean", _FISHER_OR.replace("round(log2(", "(log2(").replace("), 6) ELSE", ")) ELSE"), "tf"), _TACC, _DISP,
            f"tf AS (SELECT *, {T.fisher_doubled('s1_a', '(s0_a - s1_a)', 's1_b', '(s0_b - s1_b)')} AS pvalue FROM d2)")
_tile_query("dmr_tile_cmh", "cmh", _tile_hits("mean", "lor", "tc"), _TACC, _CMH.replace("FROM sites x JOIN sites y", "FROM tl x JOIN tl y"),
            "tc AS (SELECT tested.*, mean_a, mean_b, v_a, v_b FROM tested JOIN acc USING (chrom, pos))")


@query("SELECT chrom, \"start\", \"end\", n_cpgs, n_dvc, round(mean_log_ratio, 6) AS mean_log_ratio, round(sign_sum, 6) AS sign_sum, round(pvalue, 6) AS pvalue, round(q, 6) AS qvalue, coalesce(q <= 0.05, false) AS is_dvr FROM "
    + T.bh(f"(SELECT *, {T.binomial('n_dvc', 'n_cpgs', 'rate')} AS pvalue FROM dn)", "pvalue", drop=True), S_, D_,
    "dn AS (SELECT chrom, min(pos) AS \"start\", CAST(max(pos) + 1 AS INTEGER) AS \"end\", count(*) AS n_cpgs, count(*) FILTER (WHERE pvalue < 0.2) AS n_dvc, avg(CAST(meth_diff AS DOUBLE)) AS mean_log_ratio, sum(sign(CAST(meth_diff AS DOUBLE))) FILTER (WHERE pvalue < 0.2) AS sign_sum, "
    "(SELECT count(*) FILTER (WHERE pvalue < 0.2) / CAST(count(*) AS DOUBLE) FROM results) AS rate FROM results GROUP BY chrom, pos // 1000 HAVING count(*) >= 5)")  # fmt: skip
def dvr_density(spark, d):
    x = V.results(spark, d).select("chrom", "pos", F.col("meth_diff").cast("double").alias("var_log_ratio"), (F.col("pvalue") < 0.2).alias("is_dvc"))
    return rounded(regions.dvr_density(x))


@query("SELECT r.chrom, r.\"start\", r.\"end\", round(min_q, 6) AS min_q, n_sites, CASE WHEN EXISTS (SELECT 1 FROM called c WHERE c.chrom = r.chrom AND c.\"end\" >= r.\"start\" AND c.\"start\" <= r.\"end\") THEN 'called' WHEN n_sites IS NULL THEN 'no_sites' WHEN min_q < 0.1 THEN 'filtered' ELSE 'not_significant' END AS status FROM (SELECT DISTINCT chrom, \"start\", \"end\" FROM regions) r LEFT JOIN (SELECT r.chrom, r.\"start\", r.\"end\", min(qvalue) AS min_q, count(*) AS n_sites FROM regions r JOIN results s ON s.chrom = r.chrom AND s.pos >= r.\"start\" AND s.pos <= r.\"end\" GROUP BY ALL) b USING (chrom, \"start\", \"end\")", S_, D_, R_, "called AS (SELECT chrom, \"start\", \"end\" FROM regions WHERE \"start\" % 1200 = 0)")
def diagnose_dmr(spark, d):
    r = V.regions(spark, d).select("chrom", "start", "end")
    return rounded(regions.diagnose(V.results(spark, d), r, r.where("start % 1200 = 0"), 0.1))


# --- annotation ------------------------------------------------------------------

_TSS = "CASE WHEN strand = '+' THEN \"start\" ELSE \"end\" END"
_TES = "CASE WHEN strand = '+' THEN \"end\" ELSE \"start\" END"
_PROM = f"promoters AS (SELECT chrom, CAST(greatest({_TSS} - CASE WHEN strand = '+' THEN 2000 ELSE 200 END, 0) AS INTEGER) AS \"start\", CAST({_TSS} + CASE WHEN strand = '+' THEN 200 ELSE 2000 END AS INTEGER) AS \"end\", gene_id FROM genes)"
_INTR = "introns AS (SELECT chrom, CAST(greatest(a, gs) AS INTEGER) AS \"start\", CAST(least(\"start\", ge) AS INTEGER) AS \"end\", gene_id FROM (SELECT e.chrom, e.gene_id, e.\"start\", e.\"end\", g.\"start\" AS gs, g.\"end\" AS ge, coalesce(max(e.\"end\") OVER (PARTITION BY e.gene_id ORDER BY e.\"start\", e.\"end\" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), g.\"start\") AS a FROM exons e JOIN genes g USING (gene_id)) WHERE least(\"start\", ge) > greatest(a, gs))"
_INDEX = "idx AS (SELECT DISTINCT * FROM (SELECT *, 'promoter' AS feature, 0 AS priority FROM promoters UNION ALL SELECT chrom, \"start\", \"end\", gene_id, 'exon', 4 FROM exons UNION ALL SELECT *, 'intron', 5 FROM introns))"


@query("SELECT * FROM promoters", G_, _PROM)
def promoters(spark, d):
    return A.promoters(V.genes(spark, d))


@query(f"SELECT chrom, CAST(greatest({_TES} - CASE WHEN strand = '+' THEN 100 ELSE 1000 END, 0) AS INTEGER) AS \"start\", CAST({_TES} + CASE WHEN strand = '+' THEN 1000 ELSE 100 END AS INTEGER) AS \"end\", gene_id FROM genes", G_)
def tts(spark, d):
    return A.tts(V.genes(spark, d))


@query("SELECT * FROM introns", G_, E_, _INTR)
def introns(spark, d):
    return A.introns(V.exons(spark, d), V.genes(spark, d))


@query("SELECT chrom, \"start\", \"end\", gene_id FROM genes WHERE gene_type <> 'protein_coding'", G_)
def noncoding(spark, d):
    return A.noncoding(V.genes(spark, d))


def _index(spark, d):
    return A.feature_index(V.genes(spark, d), V.exons(spark, d))


_ANN = (S_, D_, G_, E_, _PROM, _INTR, _INDEX)
_HITS = "hits AS (SELECT s.chrom, s.pos, i.feature, i.gene_id, i.priority, i.\"start\" FROM (SELECT DISTINCT chrom, pos FROM results) s JOIN idx i ON i.chrom = s.chrom AND s.pos >= i.\"start\" AND s.pos < i.\"end\")"


@query("SELECT r.chrom, r.pos, coalesce(feature, 'intergenic') AS feature_type, gene_id AS feature_gene FROM results r LEFT JOIN (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY chrom, pos ORDER BY priority, gene_id, \"start\") = 1) USING (chrom, pos)", *_ANN, _HITS)
def feature_overlap_best(spark, d):
    return A.best_feature(V.results(spark, d), _index(spark, d)).select("chrom", "pos", "feature_type", "feature_gene")


@query(f"SELECT r.chrom, r.pos, h.gene_id AS feature_gene, g.strand AS gene_strand, CASE WHEN g.strand = '-' THEN {_TSS} - r.pos ELSE r.pos - {_TSS} END AS gene_distance FROM results r LEFT JOIN (SELECT chrom, pos, gene_id FROM hits QUALIFY row_number() OVER (PARTITION BY chrom, pos ORDER BY priority, gene_id, \"start\") = 1) h USING (chrom, pos) LEFT JOIN genes g ON g.gene_id = h.gene_id", *_ANN, _HITS)
def feature_gene_distance(spark, d):
    x = A.best_feature(V.results(spark, d), _index(spark, d))
    return A.feature_tss(x, V.genes(spark, d)).select("chrom", "pos", "feature_gene", "gene_strand", "gene_distance")


@query("SELECT r.chrom, r.pos, coalesce(f, '') AS features, coalesce(g, '') AS genes FROM results r LEFT JOIN (SELECT chrom, pos, string_agg(DISTINCT feature, ',' ORDER BY feature) AS f, string_agg(DISTINCT gene_id, ',' ORDER BY gene_id) AS g FROM hits GROUP BY ALL) USING (chrom, pos)", *_ANN, _HITS)
def feature_overlap_all(spark, d):
    x = A.all_features(V.results(spark, d), _index(spark, d))
    return x.select("chrom", "pos", F.array_join("all_overlapping_features", ",").alias("features"), F.array_join("all_overlapping_genes", ",").alias("genes"))


@query(f"SELECT s.chrom, s.pos, name AS nearest_gene, s.pos - tss AS tss_distance FROM (SELECT chrom, pos FROM results) s JOIN (SELECT chrom, {_TSS} AS tss, min(gene_id) AS name FROM genes GROUP BY ALL) m USING (chrom) QUALIFY row_number() OVER (PARTITION BY s.chrom, s.pos ORDER BY abs(s.pos - tss), tss) = 1", S_, D_, G_)
def nearest_tss(spark, d):
    return A.nearest_tss(V.results(spark, d), V.genes(spark, d)).select("chrom", "pos", "nearest_gene", "tss_distance")


@query("SELECT r.chrom, r.pos, CASE WHEN EXISTS (SELECT 1 FROM islands i WHERE i.chrom = r.chrom AND r.pos >= i.\"start\" AND r.pos < i.\"end\") THEN 'island' WHEN EXISTS (SELECT 1 FROM islands i WHERE i.chrom = r.chrom AND r.pos >= i.\"start\" - 2000 AND r.pos < i.\"end\" + 2000) THEN 'shore' WHEN EXISTS (SELECT 1 FROM islands i WHERE i.chrom = r.chrom AND r.pos >= i.\"start\" - 4000 AND r.pos < i.\"end\" + 4000) THEN 'shelf' ELSE 'open_sea' END AS cpg_context FROM results r", S_, D_, I_)
def island_context(spark, d):
    return A.island_context(V.results(spark, d), V.islands(spark, d)).select("chrom", "pos", "cpg_context")


def _annotated(spark, d):
    x = A.all_features(V.results(spark, d), _index(spark, d))
    return A.best_feature(x, _index(spark, d)).withColumn("grp", F.when(F.col("meth_diff") > 0, "hyper").otherwise("hypo"))


@query("SELECT feature AS annotation, count(DISTINCT chrom || ':' || pos) AS n FROM hits GROUP BY feature", *_ANN, _HITS)
def annotation_counts(spark, d):
    return A.annotation_counts(A.all_features(V.results(spark, d), _index(spark, d)))


@query("SELECT a, b, count(*) AS n FROM (SELECT DISTINCT chrom, pos, feature AS a FROM hits) JOIN (SELECT DISTINCT chrom, pos, feature AS b FROM hits) USING (chrom, pos) GROUP BY a, b", *_ANN, _HITS)
def coannotation(spark, d):
    return A.coannotation(A.all_features(V.results(spark, d), _index(spark, d)))


@query("SELECT grp, annotation, n, round(n / CAST(sum(n) OVER (PARTITION BY grp) AS DOUBLE), 6) AS share FROM (SELECT grp, annotation, count(*) AS n FROM (SELECT g.grp, annotation FROM an, (SELECT unnest([1, 2]) AS k) u, LATERAL (SELECT CASE WHEN k = 1 THEN an.grp ELSE 'all' END AS grp) g) GROUP BY ALL)", *_ANN, _HITS, "an AS (SELECT CASE WHEN meth_diff > 0 THEN 'hyper' ELSE 'hypo' END AS grp, coalesce(feature, 'intergenic') AS annotation, meth_diff FROM results LEFT JOIN (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY chrom, pos ORDER BY priority, gene_id, \"start\") = 1) USING (chrom, pos))")
def categorical_share(spark, d):
    return rounded(A.categorical_shares(_annotated(spark, d), "grp"))


@query("SELECT annotation, round(CAST(meth_diff AS DOUBLE), 6) AS value FROM an UNION ALL SELECT 'All', round(CAST(meth_diff AS DOUBLE), 6) FROM an", *_ANN, _HITS, "an AS (SELECT coalesce(feature, 'intergenic') AS annotation, meth_diff FROM results LEFT JOIN (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY chrom, pos ORDER BY priority, gene_id, \"start\") = 1) USING (chrom, pos))")
def numeric_by_annotation(spark, d):
    return rounded(A.numeric_by_annotation(_annotated(spark, d), "meth_diff"))


@query("SELECT combination, count(*) AS n FROM (SELECT chrom, pos, string_agg(s, '&' ORDER BY s) AS combination FROM (SELECT DISTINCT chrom, pos, k.s FROM results, (SELECT unnest(['a', 'b', 'c']) AS s) k WHERE (k.s = 'a' AND pvalue < 0.5) OR (k.s = 'b' AND pos % 300 = 0) OR (k.s = 'c' AND meth_diff > 0)) GROUP BY ALL) GROUP BY combination", S_, D_)
def overlap_sets(spark, d):
    r = V.results(spark, d)
    return A.overlap_sets({"a": r.where("pvalue < 0.5"), "b": r.where("pos % 300 = 0"), "c": r.where("meth_diff > 0")}, ("chrom", "pos"))


# --- read level --------------------------------------------------------------------

_ENT = """n AS (SELECT *, row_number() OVER (PARTITION BY sample, chrom ORDER BY pos) AS site FROM (SELECT DISTINCT sample, chrom, pos FROM calls)),
c AS (SELECT DISTINCT calls.*, site FROM calls JOIN n USING (sample, chrom, pos)),
w AS (SELECT sample, chrom, read_id, pos AS s, site, status || '' AS p0, lead(status, 1) OVER v || '' AS p1, lead(status, 2) OVER v || '' AS p2, lead(status, 3) OVER v || '' AS p3, lead(site, 3) OVER v AS z, lead(pos, 3) OVER v AS e FROM c WINDOW v AS (PARTITION BY sample, chrom, read_id ORDER BY site)),
p AS (SELECT sample, chrom, s, e, p0 || p1 || p2 || p3 AS pattern, count(*) AS k FROM w WHERE z - site = 3 GROUP BY ALL)"""


@query("SELECT sample, chrom, s AS \"start\", e + 1 AS \"end\", CAST(sum(k) AS BIGINT) AS n_reads, count(*) AS n_patterns, round(greatest(log2(sum(k)) - sum(k * log2(k)) / sum(k), 0.0), 6) AS entropy, round(greatest(log2(sum(k)) - sum(k * log2(k)) / sum(k), 0.0) / 4, 6) AS normalized_entropy FROM p GROUP BY ALL HAVING sum(k) >= 10", C_, _ENT)
def entropy_windows(spark, d):
    return rounded(reads.entropy(V.calls(spark, d)))


_ASM = "SELECT sample, chrom, pos, count(*) FILTER (WHERE hap = 0 AND status = 1) AS meth_0, count(*) FILTER (WHERE hap = 0 AND status = 0) AS unmeth_0, count(*) FILTER (WHERE hap = 1 AND status = 1) AS meth_1, count(*) FILTER (WHERE hap = 1 AND status = 0) AS unmeth_1 FROM calls JOIN (SELECT sample, read_id, min(h) AS hap FROM alleles WHERE h IS NOT NULL GROUP BY ALL HAVING min(h) = max(h)) USING (sample, read_id) GROUP BY sample, chrom, pos HAVING count(*) FILTER (WHERE hap = 0) >= 10 AND count(*) FILTER (WHERE hap = 1) >= 10"


@query(_ASM, C_, L_)
def asm_counts(spark, d):
    return reads.asm_counts(V.calls(spark, d), reads.phase_reads(V.alleles(spark, d)))


@query("SELECT * EXCLUDE (beta_0, beta_1, meth_diff, pvalue, q), round(beta_0, 6) AS beta_0, round(beta_1, 6) AS beta_1, round(meth_diff, 6) AS meth_diff, round(pvalue, 6) AS pvalue, round(q, 6) AS qvalue, coalesce(q <= 0.05, false) AS is_asm FROM "
    + T.bh(f"(SELECT *, beta_0 - beta_1 AS meth_diff, {T.fisher_doubled('meth_0', 'unmeth_0', 'meth_1', 'unmeth_1')} AS pvalue FROM (SELECT *, meth_0 / (meth_0 + unmeth_0) AS beta_0, meth_1 / (meth_1 + unmeth_1) AS beta_1 FROM ({_ASM})))", "pvalue", drop=True), C_, L_)
def asm(spark, d):
    return rounded(reads.allele_specific(V.calls(spark, d), V.alleles(spark, d)))


# --- profiles and exports ------------------------------------------------------------


@query("SELECT chrom, CAST(pos // 5000 AS INTEGER) AS bin, round(avg(CAST(meth_diff AS DOUBLE)), 6) AS value, count(*) AS n FROM results GROUP BY chrom, pos // 5000", S_, D_)
def karyogram_bins(spark, d):
    return rounded(P.karyogram(V.results(spark, d), bin_size=5000))


@query("SELECT sample, CAST(CASE WHEN strand = '+' THEN (pos - \"start\") // 200 ELSE (\"end\" - 1 - pos) // 200 END AS INTEGER) AS bin, round(avg(n_meth / CAST(coverage AS DOUBLE)), 6) AS beta, count(*) AS n FROM (SELECT s.sample, s.pos, s.n_meth, s.coverage, w.* FROM sites s JOIN (SELECT chrom AS c, t - 2000 AS \"start\", t + 2000 AS \"end\", strand FROM (SELECT chrom, strand, CASE WHEN strand = '+' THEN \"start\" ELSE \"end\" - 1 END AS t FROM genes)) w ON s.chrom = w.c AND s.pos >= w.\"start\" AND s.pos < w.\"end\" WHERE s.coverage > 0) GROUP BY ALL", S_, G_)
def tss_profile(spark, d):
    return rounded(P.tss_profile(V.sites(spark, d), V.genes(spark, d)))


@query("SELECT sample, zone, bin, round(avg(beta), 6) AS beta, count(*) AS n FROM (SELECT s.sample, n_meth / CAST(coverage AS DOUBLE) AS beta, CASE WHEN r < 0 THEN 'upstream' WHEN r >= len THEN 'downstream' ELSE 'body' END AS zone, CAST(CASE WHEN r < 0 THEN (r + 1000) * 10 // 1000 WHEN r >= len THEN (r - len) * 10 // 1000 ELSE r * 20 // len END AS INTEGER) AS bin FROM (SELECT s.sample, s.n_meth, s.coverage, g.\"end\" - g.\"start\" AS len, CASE WHEN g.strand = '+' THEN s.pos - g.\"start\" ELSE g.\"end\" - 1 - s.pos END AS r FROM sites s JOIN genes g ON s.chrom = g.chrom AND s.pos >= g.\"start\" - 1000 AND s.pos < g.\"end\" + 1000 WHERE s.coverage > 0 AND g.\"end\" - g.\"start\" >= 500) s) GROUP BY ALL", S_, G_)
def gene_body_profile(spark, d):
    return rounded(P.gene_body_profile(V.sites(spark, d), V.genes(spark, d)))


@query("SELECT chrom, size, CAST(coalesce(sum(size + 10000000) OVER (ORDER BY chrom ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM (SELECT chrom, max(pos) AS size FROM results GROUP BY chrom)", S_, D_)
def manhattan_offsets(spark, d):
    return P.chromosome_offsets(V.results(spark, d))


@query("SELECT chrom, pos, round(-log10(pvalue), 6) AS neg_log10_p, qvalue < 0.2 AND abs(meth_diff) >= CAST(0.1 AS FLOAT) AND meth_diff > 0 AS is_hyper, qvalue < 0.2 AND abs(meth_diff) >= CAST(0.1 AS FLOAT) AND meth_diff < 0 AS is_hypo FROM results", S_, D_)
def volcano_masks(spark, d):
    return rounded(P.volcano(V.results(spark, d), 0.2, 0.1))


@query("SELECT chrom, pos, round(CAST(meth_diff AS DOUBLE), 6) AS meth_diff, round(pvalue, 6) AS pvalue FROM results ORDER BY pvalue, chrom, pos LIMIT 50", S_, D_)
def top_dmcs(spark, d):
    return rounded(P.top_sites(V.results(spark, d), 50).select("chrom", "pos", "meth_diff", "pvalue"))


@query("SELECT chrom, pos, pos + o AS x, round(-log10(pvalue), 6) AS neg_log10_p, qvalue < 0.05 AS is_hit FROM results JOIN (SELECT chrom, coalesce(sum(size + 10000000) OVER (ORDER BY chrom ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o FROM (SELECT chrom, max(pos) AS size FROM results GROUP BY chrom)) USING (chrom)", S_, D_)
def manhattan(spark, d):
    return rounded(P.manhattan(V.results(spark, d)))


_MEANS = "mr AS (SELECT r.*, CAST(pvalue AS FLOAT) AS mean_beta_case, CAST(1 - pvalue AS FLOAT) AS mean_beta_control FROM results r)"


@query("SELECT chrom, pos, round((CAST(mean_beta_case AS DOUBLE) + CAST(mean_beta_control AS DOUBLE)) / 2, 6) AS mean_beta, round(CAST(meth_diff AS DOUBLE), 6) AS meth_diff, qvalue < 0.2 AND abs(meth_diff) >= CAST(0.1 AS FLOAT) AND meth_diff > 0 AS is_hyper, qvalue < 0.2 AND abs(meth_diff) >= CAST(0.1 AS FLOAT) AND meth_diff < 0 AS is_hypo FROM mr", S_, D_, _MEANS)
def mean_difference(spark, d):
    r = V.results(spark, d).withColumns({"mean_beta_case": F.col("pvalue").cast("float"), "mean_beta_control": (1 - F.col("pvalue")).cast("float")})
    return rounded(P.mean_difference(r, 0.2, 0.1))


@query("SELECT count(*) AS n_sites, count(pvalue) AS n_tested, count(*) FILTER (WHERE qvalue < 0.2) AS n_significant, count(*) FILTER (WHERE qvalue < 0.2 AND abs(meth_diff) >= CAST(0.1 AS FLOAT) AND meth_diff > 0) AS n_hyper, count(*) FILTER (WHERE qvalue < 0.2 AND abs(meth_diff) >= CAST(0.1 AS FLOAT) AND meth_diff < 0) AS n_hypo FROM results", S_, D_)
def hit_counts(spark, d):
    return P.hit_counts(V.results(spark, d), 0.2, 0.1)


_RQ = "rq AS (SELECT *, ((\"start\" % 97) + 1) / 100.0 AS qvalue, CASE WHEN \"start\" % 3 = 0 THEN 'hyper' WHEN \"start\" % 3 = 1 THEN 'hypo' ELSE 'mixed' END AS dmr_type FROM regions)"


def _regions(spark, d):
    return V.regions(spark, d).withColumns({"qvalue": F.expr("((start % 97) + 1) / 100.0D"), "dmr_type": F.expr("element_at(array('hyper', 'hypo', 'mixed'), cast(start % 3 as int) + 1)")})


@query("SELECT chrom, \"start\", \"end\", region_id, dmr_type FROM rq ORDER BY qvalue, chrom, \"start\" LIMIT 20", R_, _RQ)
def top_dmrs(spark, d):
    return P.top_regions(_regions(spark, d), 20).select("chrom", "start", "end", "region_id", "dmr_type")


@query("SELECT dmr_type, count(*) AS n, round(min(qvalue), 6) AS low, round(quantile_cont(CAST(qvalue AS DOUBLE), 0.25), 6) AS q1, round(quantile_cont(CAST(qvalue AS DOUBLE), 0.5), 6) AS median, round(quantile_cont(CAST(qvalue AS DOUBLE), 0.75), 6) AS q3, round(max(qvalue), 6) AS high FROM rq GROUP BY dmr_type", R_, _RQ)
def region_spread(spark, d):
    return rounded(P.region_spread(_regions(spark, d), "qvalue"))


@query("SELECT chrom, pos, " + ", ".join(f"round(max(n_meth / CAST(nullif(coverage, 0) AS DOUBLE)) FILTER (WHERE sample = '{s}'), 6) AS {s}" for s in V.SAMPLES) + " FROM sites JOIN (SELECT chrom, pos FROM results ORDER BY abs(meth_diff) DESC, chrom, pos LIMIT 40) USING (chrom, pos) GROUP BY chrom, pos", S_, D_)
def site_heatmap(spark, d):
    return rounded(P.site_heatmap(V.sites(spark, d), V.results(spark, d), V.SAMPLES, 40))


_IN = "FROM sites s JOIN (SELECT DISTINCT chrom, \"start\", \"end\" FROM regions) r ON r.chrom = s.chrom AND s.pos >= r.\"start\" AND s.pos < r.\"end\" WHERE coverage > 0"


@query("SELECT r.chrom, r.\"start\", r.\"end\", " + ", ".join(f"round(avg(n_meth / CAST(coverage AS DOUBLE)) FILTER (WHERE sample = '{s}'), 6) AS {s}" for s in V.SAMPLES) + f" {_IN} GROUP BY ALL", S_, R_)
def region_matrix(spark, d):
    return rounded(P.region_matrix(V.sites(spark, d), V.regions(spark, d), V.SAMPLES))


@query(f"SELECT r.chrom, r.\"start\", r.\"end\", sample, round(sum(n_meth) / CAST(sum(coverage) AS DOUBLE), 6) AS beta, count(*) AS n_sites {_IN} GROUP BY ALL", S_, R_)
def region_levels(spark, d):
    return rounded(P.region_levels(V.sites(spark, d), V.regions(spark, d)))


@query("SELECT count(*) FILTER (WHERE a AND NOT b) AS only_a, count(*) FILTER (WHERE b AND NOT a) AS only_b, count(*) FILTER (WHERE a AND b) AS both FROM (SELECT pvalue < 0.5 AS a, pos % 300 = 0 AS b FROM results)", S_, D_)
def two_sets(spark, d):
    r = V.results(spark, d)
    return P.two_sets(r.where("pvalue < 0.5"), r.where("pos % 300 = 0"), ("chrom", "pos"))


@query("SELECT annotation, bin, n, round(n / (sum(n) OVER (PARTITION BY annotation) * 0.05), 6) AS density FROM (SELECT annotation, CAST(least(floor((v + 0.5) / 0.05), 19) AS INTEGER) AS bin, count(*) AS n FROM (SELECT chrom AS annotation, CAST(meth_diff AS DOUBLE) AS v FROM results) WHERE v BETWEEN -0.5 AND 0.5 GROUP BY ALL)", S_, D_)
def value_histogram(spark, d):
    x = V.results(spark, d).select(F.col("chrom").alias("annotation"), F.col("meth_diff").cast("double").alias("value"))
    return rounded(P.histogram(x, -0.5, 0.5, 20))


@query("SELECT a, b, n, round(n / CAST(own AS DOUBLE), 6) AS share FROM co JOIN (SELECT a, n AS own FROM co WHERE a = b) USING (a)", *_ANN, _HITS, "co AS (SELECT a, b, count(*) AS n FROM (SELECT DISTINCT chrom, pos, feature AS a FROM hits) JOIN (SELECT DISTINCT chrom, pos, feature AS b FROM hits) USING (chrom, pos) GROUP BY a, b)")
def coannotation_shares(spark, d):
    return rounded(P.row_shares(A.coannotation(A.all_features(V.results(spark, d), _index(spark, d)))))


@query("SELECT s.* FROM sites s WHERE EXISTS (SELECT 1 FROM genes g WHERE g.chrom = s.chrom AND s.pos >= CASE WHEN g.strand = '+' THEN g.\"start\" ELSE g.\"end\" - 1 END - 2000 AND s.pos < CASE WHEN g.strand = '+' THEN g.\"start\" ELSE g.\"end\" - 1 END + 2000)", S_, G_)
def sites_near_genes(spark, d):
    return P.near_genes(V.sites(spark, d), V.genes(spark, d))


@query("SELECT sample, n_sites, round(intermediate, 6) AS intermediate FROM (SELECT sample, count(*) AS n_sites, avg(CASE WHEN n_meth / CAST(coverage AS DOUBLE) > 0.2 AND n_meth / CAST(coverage AS DOUBLE) < 0.8 THEN 1 ELSE 0 END) AS intermediate FROM sites WHERE coverage >= 10 GROUP BY sample) ORDER BY intermediate DESC, sample LIMIT 3", S_)
def worst_samples(spark, d):
    return rounded(P.worst_samples(qc.contamination(V.sites(spark, d))))


@query("SELECT chrom, pos, row_number() OVER (ORDER BY chrom, pos) - 1 AS site FROM (SELECT chrom, pos FROM sites GROUP BY chrom, pos HAVING count(DISTINCT sample) = 8)", S_)
def matrix_site_axis(spark, d):
    return store.site_axis(V.sites(spark, d), "intersect", 8)


@query("SELECT CAST(substring(sample, 2) AS INTEGER) AS sample, site, round(n_meth / CAST(coverage AS DOUBLE), 6) AS value FROM sites JOIN (SELECT chrom, pos, row_number() OVER (ORDER BY chrom, pos) - 1 AS site FROM (SELECT DISTINCT chrom, pos FROM sites)) USING (chrom, pos) WHERE coverage > 0", S_)
def matrix_entries(spark, d):
    s = V.sites(spark, d)
    return rounded(store.matrix_entries(s, store.site_axis(s), V.SAMPLES))


@query("SELECT chrom, pos, strand, context, CAST(CASE WHEN b IS NULL THEN n_meth ELSE least(greatest(round_even(b * coverage, 0), 0), coverage) END AS INTEGER) AS n_meth, CAST(coverage - CASE WHEN b IS NULL THEN n_meth ELSE least(greatest(round_even(b * coverage, 0), 0), coverage) END AS INTEGER) AS n_unmeth, coverage, sample FROM (SELECT *, CASE WHEN pos % 700 <> 0 THEN (pos % 1300) / CAST(1000.0 AS DOUBLE) END AS b FROM sites)", S_)
def smoothed_pseudo_counts(spark, d):
    s = V.sites(spark, d)
    return store.smoothed_counts(s, s.where("pos % 700 <> 0").select("sample", "chrom", "pos", F.expr("(pos % 1300) / 1000.0D").alias("smoothed")))


@query("SELECT chrom, pos, round(CAST(meth_diff AS DOUBLE), 6) AS meth_diff, round(pvalue, 6) AS pvalue, round(qvalue, 6) AS qvalue FROM results", S_, D_)
def result_store(spark, d):
    """Stored by chromosome, one of them rewritten, and read back."""
    at = store.ResultStore.create(V.results(spark, d), scratch(spark))
    at.update_chrom("chr1", V.results(spark, d).where("chrom = 'chr1'"))
    return rounded(store.ResultStore.open(spark, at.path).to_dataframe())


@query("SELECT s.sample, treatment, n_sites, round(methylation, 6) AS methylation, round(intermediate, 6) AS intermediate FROM (SELECT sample, CASE WHEN sample < 's4' THEN 1 ELSE 0 END AS treatment, count(*) AS n_sites, sum(n_meth) / CAST(sum(coverage) AS DOUBLE) AS methylation, avg(CASE WHEN n_meth / CAST(coverage AS DOUBLE) > 0.2 AND n_meth / CAST(coverage AS DOUBLE) < 0.8 THEN 1.0 ELSE 0 END) FILTER (WHERE coverage >= 10) AS intermediate FROM sites GROUP BY sample) s", S_)
def samples_with_quality(spark, d):
    f = MethylFrame(V.sites(spark, d), V.CASE, V.CONTROL)
    return rounded(f.qc(contamination=True).select("sample", "treatment", "n_sites", "methylation", "intermediate"))


@query("SELECT chrom, pos, CASE (pos // 100) % 3 WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE '*' END AS strand, 'CpG' AS context, n_meth, n_unmeth, coverage, sample FROM sites", S_)
def strands_from_bases(spark, d):
    s = V.sites(spark, d)
    bases = s.select("chrom", "pos").distinct().withColumn("base", F.expr("element_at(array('c', 'G', 'T'), cast(pmod(pos div 100, 3) + 1 as int))"))
    return readers.infer_strand(s, bases).select("chrom", "pos", "strand", "context", "n_meth", "n_unmeth", "coverage", "sample")


def _sequences(spark, d):
    """Sequence text of the chromosomes of sites, a line for each part: its kind of base, then nothing known."""
    part = V.table(spark, d, "part").select(F.expr("concat('chr', p_partkey % 5)").alias("c"), F.expr("p_partkey div 5").alias("k"), F.expr("concat(element_at(array('c', 'G', 'T', 'C'), cast(p_partkey % 4 + 1 as int)), repeat('N', 99))").alias("line"))
    heads = spark.createDataFrame([(f"chr{i}", -1, f">chr{i} made of parts") for i in range(5)], part.schema)
    path = scratch(spark) + "/sequences"
    part.unionByName(heads).repartitionByRange("c").sortWithinPartitions("c", "k").select("line").write.text(path)
    return path


PARTS_ = """stranded AS (SELECT sites.* REPLACE (CASE (pos // 100 * 5 + CAST(substring(chrom, 4) AS INTEGER)) % 4 WHEN 1 THEN '-' WHEN 2 THEN '*' ELSE '+' END AS strand) FROM sites)"""


@query("SELECT 'chr' || (p_partkey % 5) AS chrom, min(p_partkey // 5) * 100 AS first_base, max(p_partkey // 5 + 1) * 100 AS length, count(*) AS n_parts FROM part GROUP BY ALL")
def sequence_lengths(spark, d):
    x = fasta.read_fasta(spark, _sequences(spark, d), partition_bytes=10_007)
    return x.groupBy("chrom").agg(F.min("start").alias("first_base"), F.max("end").alias("length"), F.sum(F.length(F.regexp_replace("bases", "N", ""))).alias("n_parts"))


@query("SELECT chrom, pos, strand, context, n_meth, n_unmeth, coverage, sample FROM stranded", S_, PARTS_)
def strands_from_sequence(spark, d):
    return readers.stranded(V.sites(spark, d), fasta.read_fasta(spark, _sequences(spark, d), partition_bytes=50_000), merge=False).select("chrom", "pos", "strand", "context", "n_meth", "n_unmeth", "coverage", "sample")


@query(
    """SELECT sample, chrom, p AS pos, '+' AS strand, min(context) AS context, CAST(sum(n_meth) AS INTEGER) AS n_meth, CAST(sum(n_unmeth) AS INTEGER) AS n_unmeth, CAST(sum(coverage) AS INTEGER) AS coverage
    FROM (SELECT *, CASE WHEN strand = '-' THEN pos - 1 ELSE pos END AS p FROM stranded WHERE strand <> '*') GROUP BY sample, chrom, p""", S_, PARTS_,
)
def converted_with_sequence(spark, d):
    return readers.stranded(V.sites(spark, d), fasta.read_fasta(spark, _sequences(spark, d))).select("sample", "chrom", "pos", "strand", "context", "n_meth", "n_unmeth", "coverage")


@query("SELECT chrom, pos AS \"start\", pos + 1 AS \"end\", round(n_meth / CAST(coverage AS DOUBLE), 6) AS value FROM sites WHERE sample = 's1' AND coverage > 0", S_)
def bedgraph_rows(spark, d):
    return rounded(sinks.bedgraph_rows(V.sites(spark, d), "s1"))


@query(
    """SELECT chrom, bases, min(pos) AS "start", max(pos) + 1 AS "end", count(*) AS n, round(min(v), 6) AS low, round(max(v), 6) AS high, round(sum(v), 6) AS total, round(sum(v * v), 6) AS squares
    FROM (SELECT chrom, pos, n_meth / CAST(coverage AS DOUBLE) AS v FROM sites WHERE sample = 's1' AND coverage > 0), (SELECT unnest([1000, 4000]) AS bases) GROUP BY chrom, bases, pos // bases""", S_,
)
def track_zoom_levels(spark, d):
    rows = sinks.bedgraph_rows(V.sites(spark, d), "s1").withColumnRenamed("chrom", "c").withColumns({"start": F.col("start").cast("long"), "end": F.col("end").cast("long")})
    fine = bigwig.zoom_records(rows, 1000)
    both = fine.withColumn("bases", F.lit(1000)).unionByName(bigwig.zoom_records(fine, 4000).withColumn("bases", F.lit(4000)))
    return rounded(both.withColumnRenamed("c", "chrom"))


@query(
    """SELECT chrom || '.' || pos AS "chrBase", chrom AS chr, CAST(pos AS BIGINT) AS base, strand, CAST(coverage AS BIGINT) AS coverage FROM sites
    WHERE coverage > 0 AND sample = 's2' AND chrom = 'chr3' AND pos >= 700 AND pos < 30000""", S_,
)
def methylkit_region(spark, d):
    """Written with position indexes, and a region of one sample looked up."""
    path = scratch(spark)
    sinks.write_methylkit(V.sites(spark, d), path)
    c = F.split("value", "\t")
    got = indexed.read_region(spark, path, "s2", ("chr3", 700, 30_000))
    return got.select(c[0].alias("chrBase"), c[1].alias("chr"), c[2].cast("long").alias("base"), c[3].alias("strand"), c[4].cast("long").alias("coverage"))


@query("SELECT chrom, max(pos) + 1 AS size FROM sites GROUP BY chrom", S_)
def chromosome_sizes(spark, d):
    return sinks.chromosome_sizes(V.sites(spark, d))


@query("SELECT sample, chrom || '.' || pos AS \"chrBase\", chrom AS chr, pos AS base, '+' AS strand, coverage, printf('%.6f', 100 * CAST(n_meth AS DOUBLE) / coverage) AS \"freqC\", printf('%.6f', 100 - 100 * CAST(n_meth AS DOUBLE) / coverage) AS \"freqT\" FROM sites WHERE coverage > 0", S_)
def methylkit_rows(spark, d):
    return sinks.methylkit_rows(V.sites(spark, d))


@query("SELECT chrom, pos AS \"start\", pos + 1 AS \"end\", 'dmc_' || row_number() OVER (ORDER BY chrom, pos) AS name, CAST(floor(1000 * (1 - qvalue)) AS INTEGER) AS score, CASE WHEN meth_diff > 0 THEN '+' ELSE '-' END AS strand FROM results WHERE qvalue < 0.3", S_, D_)
def dmc_bed_rows(spark, d):
    return sinks.dmc_bed_rows(V.results(spark, d), 0.3)


@query("SELECT chrom, \"start\", \"end\", 'dmr_' || row_number() OVER (ORDER BY chrom, \"start\") AS name, CAST(floor(least(1000.0, -100 * log10(((\"start\" % 97) + 1) / 100.0))) AS INTEGER) AS score, CASE WHEN \"start\" % 3 = 0 THEN '+' WHEN \"start\" % 3 = 1 THEN '-' ELSE '.' END AS strand FROM regions", R_)
def dmr_bed_rows(spark, d):
    r = V.regions(spark, d).withColumn("combined_qvalue", F.expr("((start % 97) + 1) / 100.0D")).withColumn("dmr_type", F.expr("element_at(array('hyper', 'hypo', 'mixed'), cast(start % 3 as int) + 1)"))
    return sinks.dmr_bed_rows(r)


# --- sequence and sample models --------------------------------------------------------


@query("SELECT s.sample, round(0.5 + sum(k * coalesce(beta, mb)), 6) AS age, count(beta) AS n_found FROM (SELECT DISTINCT sample FROM sites) s CROSS JOIN (SELECT id, k, avg(beta) AS mb FROM b GROUP BY ALL) p LEFT JOIN b USING (sample, id, k) GROUP BY s.sample", S_, "pn AS (SELECT DISTINCT 'c' || pos || chrom AS id, chrom, pos, (pos % 700) / 1000.0 - 0.3 AS k FROM sites)", "b AS (SELECT sample, id, k, sum(n_meth) / CAST(sum(coverage) AS DOUBLE) AS beta FROM sites JOIN pn USING (chrom, pos) GROUP BY ALL)")
def age_clock(spark, d):
    s = V.sites(spark, d)
    p = s.select("chrom", "pos").distinct().withColumn("cpg_id", F.concat(F.lit("c"), F.col("pos").cast("string"), "chrom"))
    return rounded(models.age_clock(s, p.select("cpg_id", F.expr("(pos % 700) / 1000.0D - 0.3D").alias("coefficient")), p, 0.5))


@query()
def deconvolve(spark, d):
    s = V.sites(spark, d)
    p = s.select("chrom", "pos").distinct().withColumn("cpg_id", F.concat(F.lit("c"), F.col("pos").cast("string"), "chrom"))
    ref = p.select("cpg_id", F.expr("(pos % 700) / 700.0D").alias("t1"), F.expr("(pos % 1100) / 1100.0D").alias("t2"), F.expr("(pos % 1300) / 1300.0D").alias("t3"))
    return rounded(models.deconvolve(s, ref, p, ["t1", "t2", "t3"]))


@query()
def hmm_states(spark, d):
    x = V.sites(spark, d).where("coverage > 0").select("sample", "chrom", "pos", (F.col("n_meth") / F.col("coverage")).alias("beta"))
    return rounded(sequence.hmm_states(x, ["sample", "chrom"], "beta", [0.15, 0.65], 0.85))


@query()
def pmd(spark, d):
    return rounded(sequence.pmd(V.sites(spark, d), min_length=2000))


@query()
def hmr_lmr(spark, d):
    return rounded(sequence.hmr(V.sites(spark, d), 0.5))


@query()
def dmr_hmm(spark, d):
    return rounded(sequence.dmr_hmm(V.results(spark, d), alpha=0.9, delta=0.05))


@query()
def smooth_gaussian(spark, d):
    return rounded(sequence.smooth(V.sites(spark, d), "gaussian"))


@query()
def smooth_bsmooth(spark, d):
    return rounded(sequence.smooth(V.sites(spark, d), "bsmooth"))


_KNN = (
    "cells AS (SELECT p.chrom, p.pos, n.sample, s.n_meth / CAST(nullif(s.coverage, 0) AS DOUBLE) AS beta FROM (SELECT DISTINCT chrom, pos FROM sites) p CROSS JOIN (SELECT DISTINCT sample FROM sites) n LEFT JOIN sites s USING (chrom, pos, sample)), "
    "near AS (SELECT m.chrom, m.pos, m.sample, h.beta, abs(h.pos - m.pos) AS d, row_number() OVER (PARTITION BY m.chrom, m.pos, m.sample ORDER BY abs(h.pos - m.pos), h.pos) AS k FROM cells m JOIN cells h ON h.chrom = m.chrom AND h.sample = m.sample AND h.beta IS NOT NULL AND h.pos BETWEEN m.pos - 10000 AND m.pos + 10000 WHERE m.beta IS NULL), "
    "filled AS (SELECT chrom, pos, sample, sum(beta / (d + 1)) / sum(1.0 / (d + 1)) AS v FROM near WHERE k <= 5 GROUP BY ALL)"
)


@query("SELECT chrom, pos, " + ", ".join(f"round(max(v) FILTER (WHERE sample = '{s}'), 6) AS {s}" for s in V.SAMPLES) + " FROM (SELECT c.chrom, c.pos, c.sample, coalesce(c.beta, f.v) AS v FROM cells c LEFT JOIN filled f USING (chrom, pos, sample)) GROUP BY chrom, pos", S_, _KNN)
def knn_impute(spark, d):
    return rounded(sequence.knn_impute(V.sites(spark, d), V.SAMPLES))


@query(
    """SELECT chrom, pos, s, round(v, 6) AS beta FROM (SELECT chrom, pos, list(n_meth / CAST(coverage AS DOUBLE) ORDER BY sample) AS vs FROM sites WHERE coverage > 0 GROUP BY chrom, pos HAVING count(*) = 8
    ORDER BY md5('7:' || chrom || ':' || pos) LIMIT 40), LATERAL (SELECT unnest(range(8)) AS s, unnest(vs) AS v)""", S_,
)
def sampled_site_matrix(spark, d):
    m = matrix.sample_site_matrix(V.sites(spark, d), V.SAMPLES, 40, 7)
    return rounded(m.select("chrom", "pos", F.posexplode("row").alias("s", "beta")).withColumn("s", F.col("s").cast("long")))


@query("SELECT sample, chrom, pos, coverage FROM sites ORDER BY md5('3:' || sample || ':' || chrom || ':' || pos) LIMIT 500", S_)
def sampled_coverage(spark, d):
    return matrix.coverage_sample(V.sites(spark, d), 500, 3)


@query()
def pca(spark, d):
    return rounded(sequence.pca(V.sites(spark, d), V.SAMPLES))


_ALL_SITES = S_.replace("sites AS (", "unfiltered AS (", 1)
_KEPT = (
    "caps AS (SELECT sample, CAST(min(coverage) AS INTEGER) AS cap FROM (SELECT sample, coverage, row_number() OVER (PARTITION BY sample ORDER BY coverage) - 1 AS i, count(*) OVER (PARTITION BY sample) AS n FROM unfiltered) WHERE i >= floor(0.999 * (n - 1) + 0.5) GROUP BY sample), "
    "kept AS (SELECT u.* FROM unfiltered u JOIN caps USING (sample) WHERE coverage >= 5 AND coverage <= cap), sites AS (SELECT * FROM kept WHERE (chrom, pos) IN (SELECT (chrom, pos) FROM kept GROUP BY chrom, pos HAVING count(DISTINCT sample) = 8))"
)


@query(f"SELECT chrom, pos, {_effects('pi')}, round(phi, 6) AS phi, round(pvalue, 6) AS pvalue, round(q, 6) AS qvalue, coalesce(q <= 0.05, false) AS reject FROM {T.bh('tested', 'pvalue')}", _ALL_SITES, _KEPT, _ACC, _DISP, _RAW, _quasi("lr_raw", _EB))
def flagship(spark, d):
    """Coverage filter, intersection, likelihood-ratio test and q-values of all sites."""
    s = S.filter_coverage(V.sites(spark, d), 5, 99.9)
    x = s.join(S.unite(s, "intersect", 8).select("chrom", "pos"), ["chrom", "pos"], "left_semi")
    r = fdr.adjust(tests.quasi_binomial(x, is_case(), "lr", "eb"))
    return rounded(r.select("chrom", "pos", "mean_beta_case", "mean_beta_control", "meth_diff", "log2_odds_ratio", "phi", "pvalue", "qvalue", "reject"))
