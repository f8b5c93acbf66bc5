"""Every query of the catalog against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from kinweave import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(df):
    df = df.reindex(sorted(df.columns), axis=1)
    for c in df.columns:
        kind = df[c].dtype.kind
        df[c] = df[c].map(lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)) if kind in "fO" else df[c].astype(str)
    return sorted(map(tuple, df.to_numpy().tolist()))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, duck, name):
    got, want = catalog.queries()[name](spark, SF).toPandas(), duck.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    for c in got.columns:
        if got[c].dtype.kind in "if" and want[c].dtype.kind in "if":
            got[c], want[c] = got[c].astype(float), want[c].astype(float)
    assert canonical(got) == canonical(want)


def test_queries_without_sql(spark):
    labels = {r["id"]: r["label"] for r in catalog.queries()["hdbscan"](spark, SF).collect()}
    truth = {r["vec_id"]: r["label"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "label").collect()}
    groups = {}
    for i, x in labels.items():
        if x >= 0:
            groups.setdefault(x, set()).add(truth[i])
    assert len(groups) >= 10 and all(len(g) == 1 for g in groups.values())
    split = {r["id"]: r["label"] for r in catalog.queries()["split_clusters"](spark, SF).collect()}
    parts = {}
    for i, x in split.items():
        parts.setdefault(x, []).append(truth[i])
    assert all(len(set(p)) == 1 and len(p) >= 2 for p in parts.values()) and len(parts) > 10
    dispatched = catalog.queries()["cluster_dispatch"](spark, SF).collect()
    assert len(dispatched) == len(truth) and all(0 <= r["probability"] <= 1 for r in dispatched)
    grid = catalog.queries()["calibration_grid"](spark, SF).collect()
    assert [(r["min_cluster_size"], r["min_samples"]) for r in grid] == [(a, b) for a in (2, 3, 5) for b in (1, 2, 3)] and all(0 <= r["f1"] <= 1 for r in grid)
