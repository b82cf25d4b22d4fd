"""Every registered query against its SQL, on the smallest tables."""

import glob
import math
import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from cytoframe.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v


def sortable(row):
    return tuple((x is not None, str(x)) for x in row)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=sortable)
    if name not in catalog.SQL:  # held against brute force in test_models
        assert got
        return
    o = duck.execute(catalog.SQL[name])
    names = [x[0] for x in o.description]
    assert sorted(names) == cols
    at = sorted(range(len(names)), key=names.__getitem__)
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in o.fetchall()), key=sortable)


def test_dvc_where_variances_are_equal(spark, tmp_path):
    """The statistic is 0 there, but for rounding; a p-value of 0 instead of 1 would move the q-values of all other sites."""
    rng = np.random.default_rng(3)
    rows = []
    for part in range(1200):
        other = rng.permutation(4) if part % 3 else None  # a third of the sites have their own counts in both groups
        counts = rng.integers(1, 50, (4, 2)).tolist()
        for i in range(4):
            for supplier, (m, u) in ((i, counts[i]), (4 + i, counts[other[i]] if part % 3 else rng.integers(1, 50, 2).tolist())):
                rows += [(part, supplier, float(m), "R"), (part, supplier, float(u), "A")]
    spark.createDataFrame(rows, "l_partkey bigint, l_suppkey bigint, l_quantity double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    o = c.execute(f"SELECT chrom, pos, var_log_ratio, p_var, q_var, p_mean, is_dvc FROM ({catalog.SQL['dvc']})").fetchall()
    got = catalog.QUERIES["dvc"](spark, str(tmp_path)).collect()
    assert sorted(tuple(map(plain, r)) for r in got) == sorted(tuple(map(plain, r)) for r in o)
    assert sum(r["p_var"] == 1 for r in got) >= 800


def test_entry(spark):
    assert entry.entry(spark).count() > 100
    assert set(entry.oracle_sql()) <= set(entry.queries())
