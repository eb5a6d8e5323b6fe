import random

import numpy as np
import pytest

from tidepanel.operators import audit, profile
from tidepanel.operators.quantiles import exact_quantiles


@pytest.mark.parametrize("accuracy", [10, 100, 10_000])
def test_quantiles_of_skewed_groups(spark, accuracy):
    rng = random.Random(1)
    rows = [("hot", 7.0)] * 3000 + [("hot", rng.lognormvariate(0, 3)) for _ in range(3000)]
    rows += [("cold", float(i)) for i in range(17)] + [("one", 5.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(7)
    shares = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = {r["g"]: r for r in exact_quantiles(df, ["x"], shares, ["g"], accuracy).collect()}
    assert set(got) == {"hot", "cold", "one"}
    for group in got:
        values = [x for g, x in rows if g == group]
        expected = np.quantile(values, shares)
        assert [got[group][f"q_{i}"] for i in range(len(shares))] == pytest.approx(expected.tolist(), rel=1e-12)
        assert got[group]["n"] == len(values)


def test_quantiles_without_groups(spark):
    df = spark.range(1001).selectExpr("cast(id as double) as a", "cast(id * id as double) as b")
    got = {r["column"]: r for r in exact_quantiles(df, ["a", "b"]).collect()}
    assert got["a"]["q_1"] == 500.0 and got["b"]["q_0"] == 250.0**2
    with pytest.raises(ValueError):
        exact_quantiles(df, ["a"], [0.5, 0.2])


def test_histogram_counts_everything(spark):
    df = spark.createDataFrame([(float(i % 10),) for i in range(100)] + [(None,)], "x double")
    rows = profile.histogram(df, "x", 5).orderBy("bin").collect()
    assert [r["n"] for r in rows] == [20] * 5 and rows[-1]["bin_end"] == 9.0
    constant = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert sum(r["n"] for r in profile.histogram(constant, "x", 4).collect()) == 2


def test_density_integrates_to_one_and_matches_exact(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(rng.gauss(0, 1),) for _ in range(2000)], "x double")
    binned = profile.density(df, "x").orderBy("point").collect()
    exact = profile.density_exact(df, "x").orderBy("point").collect()
    step = binned[1]["x"] - binned[0]["x"]
    assert sum(r["density"] for r in exact) * step == pytest.approx(1.0, abs=2e-3)
    assert max(abs(a["density"] - b["density"]) for a, b in zip(binned, exact)) < 1e-3


def test_box_outliers(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 10)] + [(100.0,)], "x double")
    row = profile.box_stats(df, ["x"]).first()
    assert row["n_outliers"] == 1 and row["whisker_high"] == 9.0 and row["whisker_low"] == 1.0


def test_box_fences_equal_sql_to_the_last_bit(spark):
    duckdb = pytest.importorskip("duckdb")
    rng = np.random.default_rng(5)
    rows = [(g, float(v)) for g in range(300) for v in rng.integers(-10**6, 10**8, 4 + g % 8) / 100]
    df = spark.createDataFrame(rows, "g long, x double")
    con = duckdb.connect()
    con.execute("CREATE TABLE t (g BIGINT, x DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", rows)
    sql = "SELECT g, quantile_cont(x, 0.25), quantile_cont(x, 0.5), quantile_cont(x, 0.75) FROM t GROUP BY g ORDER BY g"
    got = profile.box_stats(df, ["x"], ["g"]).orderBy("g").select("g", "q25", "median", "q75").collect()
    assert [tuple(r) for r in got] == con.execute(sql).fetchall()


def test_audit_counts(spark):
    df = spark.createDataFrame([(1, "a", None), (1, None, 2.0), (None, "b", 3.0)], "ROW_ID long, k string, v double")
    counts = {r["column"]: r["nb_missing"] for r in audit.null_counts(df).collect()}
    assert counts == {"ROW_ID": 1, "k": 1, "v": 1}
    assert tuple(audit.duplicate_keys(df).first()) == (3, 2, 1)
    assert {r["column"]: r["n_distinct"] for r in audit.distinct_counts(df, ["ROW_ID", "k"]).collect()} == {"ROW_ID": 1, "k": 2}
    assert {r["column"]: r["n_distinct"] for r in audit.distinct_counts(df, ["k"], approximate=True).collect()} == {"k": 2}
    assert audit.value_counts(df, "k").count() == 2
    other = spark.createDataFrame([(1,), (2,)], "ROW_ID long")
    report = audit.key_alignment(df, other).first()
    assert (report["n_missing"], report["n_surplus"], report["n_repeated"], report["aligned"]) == (1, 0, 1, False)
    assert audit.same_columns(df, df.select("v", "k", "ROW_ID")) and not audit.same_columns(df, other)


def test_quantiles_of_many_distinct_values_and_at_the_short_limit(spark):
    from tidepanel.operators.quantiles import exact_quantiles

    for n, accuracy in ((1_000_000, 1000), (2000, 1000), (2001, 1000), (20, 10), (21, 10)):
        df = spark.range(n).selectExpr("cast(pmod(id * 7919, %d) as double) * id / id + 0.5 * (id %% 2) as v" % n, "id").where("id > 0")
        values = sorted(r["v"] for r in df.collect()) if n <= 2001 else None
        row = exact_quantiles(df, ["v"], (0.25, 0.5), accuracy=accuracy).first()
        if values:
            for q, p in ((row["q_0"], 0.25), (row["q_1"], 0.5)):
                at = p * (len(values) - 1)
                low = values[int(at)]
                assert q == pytest.approx(low + (values[min(int(at) + 1, len(values) - 1)] - low) * (at - int(at)))
        else:
            assert row["q_1"] == pytest.approx(n / 2, abs=2) and row["n"] == n - 1


def test_density_of_a_heavy_tail_keeps_its_bandwidth(spark):
    df = spark.range(1, 3001).selectExpr("if(id = 3000, 1e9, id / 3000.0) as v")
    binned = profile.density(df, "v").orderBy("point").collect()
    exact = profile.density_exact(df, "v").orderBy("point").collect()
    highest = max(e["density"] for e in exact)
    # a value is moved by a sixteenth of the bandwidth at most; the steepest kernel slope is 0.61 of its height per bandwidth
    assert [b["density"] for b in binned] == pytest.approx([e["density"] for e in exact], abs=0.61 / 16 * highest)
