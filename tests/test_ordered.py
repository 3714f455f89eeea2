import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cityflow.operators import ordered, sampling


def folded(spark, rows):
    df = spark.createDataFrame(rows, "k STRING, v DOUBLE")
    return df.groupBy("k", "v").agg(F.count("*").alias("n"))


@pytest.fixture(scope="module")
def skewed():
    """One key with most rows and many values, one constant key, one tiny key, and rows without a key."""
    rng = random.Random(7)
    rows = [("hot", round(rng.lognormvariate(3, 2), 3)) for _ in range(6000)]
    rows += [("flat", 5.0)] * 900 + [("tiny", 1.0), ("tiny", 4.0)]
    rows += [("mixed", float(rng.randint(-50, 50))) for _ in range(999)]
    rows += [(None, float(rng.randint(0, 9))) for _ in range(77)]
    return rows


def test_quantiles_match_brute_force(spark, skewed):
    probs = {"q10": 0.1, "median": 0.5, "q90": 0.9, "low": 0.0, "high": 1.0}
    found = ordered.exact_quantiles(folded(spark, skewed), ["k"], "v", "n", probs)
    got = {r.k: r for r in found.collect()}
    for key in {k for k, _ in skewed}:
        values = [v for k, v in skewed if k == key]
        for name, p in probs.items():
            assert got[key][name] == pytest.approx(np.quantile(values, p), rel=1e-12)


def test_running_counts_match_brute_force(spark, skewed):
    rows = ordered.running_counts(folded(spark, skewed), ["k"], "v", ["n"]).collect()
    for key in {k for k, _ in skewed}:
        values = np.array(sorted(v for k, v in skewed if k == key))
        mine = sorted((r for r in rows if r.k == key), key=lambda r: r.v)
        assert [r.v for r in mine] == sorted(set(values.tolist()))
        assert [r.n_upto for r in mine] == [int((values <= r.v).sum()) for r in mine]
        assert all(r.n_total == len(values) for r in mine)
        assert [r.next_value for r in mine] == [r.v for r in mine[1:]] + [None]


@pytest.mark.parametrize("spread", [1.0, 1e-9, 1e9])
def test_a_hot_key_is_cut_into_many_ranges(spark, skewed, spread):
    rows = [(k, 1e3 + v * spread if spread < 1 else v * spread) for k, v in skewed]
    ranged = ordered.with_range(folded(spark, rows), "v")
    ranges = ranged.filter("k = 'hot'").groupBy("_range").agg(F.count("*").alias("n"), F.min("v"), F.max("v")).collect()
    assert len(ranges) > 100
    assert max(r.n for r in ranges) < (0.25 if spread < 1 else 0.05) * sum(r.n for r in ranges)
    ranges.sort(key=lambda r: r._range)
    assert all(a[3] < b[2] for a, b in zip(ranges, ranges[1:]))
    assert len(ranges) <= ordered.RANGES + 2 * ordered._BINS


def test_odd_values_keep_their_order(spark):
    values = [None, float("-inf"), -1e308, -2.5, -5e-324, 0.0, 5e-324, 1e-300, 1.0, 1.0000001, 1e308, float("inf"), float("nan")]
    rows = ordered.with_range(spark.createDataFrame([(v,) for v in values], "v DOUBLE"), "v").orderBy("v").collect()
    assert [r._range for r in rows] == sorted(r._range for r in rows) and rows[0]._range == -1
    assert len({r._range for r in rows}) >= len(values) - 2


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.integers(-5, 5).map(float), min_size=1, max_size=40), p=st.floats(0, 1))
def test_any_quantile(spark, values, p):
    rows = folded(spark, [("a", v) for v in values])
    got = ordered.exact_quantiles(rows, ["k"], "v", "n", {"q": p}).first()
    assert got.q == pytest.approx(np.quantile(values, p), abs=1e-9)


def test_values_that_many_keys_share_are_spread(spark):
    shared = spark.range(300 * 400).select((F.col("id") % 300).alias("k"), (F.floor(F.col("id") / 300) * 1.0).alias("v"))
    sizes = [r["count"] for r in ordered.with_range(shared, "v").groupBy("_range").count().collect()]
    assert max(sizes) < 0.05 * sum(sizes)


@pytest.mark.parametrize("spacing", [1, 7, 10**15])
def test_every_nth(spark, spacing):
    keys = [k * spacing for k in sorted(random.Random(3).sample(range(5000), 400))]
    rows = spark.createDataFrame([(k,) for k in keys], "id BIGINT").repartition(5)
    got = sorted(r.id for r in sampling.every_nth(rows, "id", 6).collect())
    assert got == keys[::6]


def test_rows_read_in_order_are_not_moved(spark, tmp_path):
    keys = sorted(random.Random(5).sample(range(10**6), 5000))
    for i in range(4):  # later files are longer, and named against the order
        part = keys[i * i * 312 : (i + 1) ** 2 * 312 if i < 3 else None]
        spark.createDataFrame([(k, k % 5) for k in part], "id BIGINT, v INT").coalesce(1).write.parquet(f"{tmp_path}/t/f={9 - i}")
    rows = spark.read.parquet(f"{tmp_path}/t").where("v <> 2")
    got = sampling.every_nth(rows, "id", 7)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "rangepartitioning" not in plan and "Window" not in plan
    assert sorted(r.id for r in got.collect()) == [k for k in keys if k % 5 != 2][::7]
    shuffled = rows.repartition(3)
    assert sampling.placed_as_read(shuffled, "id", "p") is None
    mixed = spark.createDataFrame([(k,) for k in (3, 1, 2)], "id BIGINT").coalesce(1)
    assert sampling.placed_as_read(mixed, "id", "p") is None


def test_every_row_counts_those_without_a_key_first(spark):
    rows = spark.createDataFrame([(None,), (4,), (2,)], "id BIGINT")
    assert sampling.every_nth(rows, "id", 1).count() == 3
    assert {r.id for r in sampling.every_nth(rows, "id", 2).collect()} == {None, 4}


def test_seeded_sample_does_not_depend_on_partitions(spark):
    ids = spark.range(3000)
    one = {r.id for r in sampling.seeded_sample(ids.repartition(1), "id", 200).collect()}
    many = {r.id for r in sampling.seeded_sample(ids.repartition(9), "id", 200).collect()}
    other = {r.id for r in sampling.seeded_sample(ids, "id", 200, seed=7).collect()}
    assert one == many and len(one) == 200 and other != one
