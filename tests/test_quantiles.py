"""Exact quantiles by selection against numpy, and what one task reads of a group of all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelmill.operators import quantiles as Q

SHARES = [0.0, 0.005, 0.1, 0.5, 0.98, 0.995, 1.0]


@pytest.mark.parametrize("held", [1, 50, 1 << 22])
def test_against_numpy(spark, held):
    """Groups of all kinds: null key, ties, wide spreads, one value, one row, nulls and NaN among them."""
    rng = np.random.default_rng(0)
    groups = {
        "even": rng.random(400), "tied": rng.integers(0, 3, 300).astype(float), "wide": np.exp(rng.normal(0, 12, 500)), "signed": rng.normal(size=333) * 1e6,
        "one": np.array([4.5]), "two": np.array([1.0, 2.0]), "same": np.full(200, 7.25), None: rng.random(260), "near": 1 + np.arange(300) * 1e-15,
    }
    rows = [(k, i % 2 if k == "even" else 0, float(v)) for k, x in groups.items() for i, v in enumerate(x)]
    rows += [("even", 0, None), ("even", 1, float("nan")), ("empty", 0, None)]
    frame = spark.createDataFrame(rows, "g string, h int, v double").repartition(5)
    got = {(r["g"], r["h"]): r["_q"] for r in Q.exact_quantiles(frame, ["g", "h"], "v", SHARES, held=held).collect()}
    want = {(k, h): x for k, values in groups.items() for h, x in (((0, values[::2]), (1, values[1::2])) if k == "even" else ((0, values),))}
    assert set(got) == set(want)
    for key, x in want.items():
        assert got[key] == pytest.approx(np.quantile(x, SHARES).tolist(), rel=1e-12, abs=0), key


def test_without_keys(spark):
    frame = spark.range(1000).select((F.col("id") * F.col("id")).alias("v"))
    for held in (10, 1 << 22):
        assert Q.exact_quantiles(frame, [], "v", [0.25], held=held).first()["_q"] == pytest.approx([np.quantile(np.arange(1000.0) ** 2, 0.25)])
    assert Q.exact_quantiles(frame.limit(0), [], "v", [0.25], held=10).count() == 0


def test_a_group_of_all_rows_is_read_in_parts(spark, monkeypatch):
    """One group of 200,000 distinct values: what is counted value by value has no more rows than `held` allows."""
    frame = spark.range(200_000, numPartitions=8).select(F.lit("all").alias("g"), F.hash("id").cast("double").alias("v"))
    seen, marked = [], Q._marked
    monkeypatch.setattr(Q, "_marked", lambda rows, keys, state: seen.append((state, marked(rows, keys, state))) or seen[-1][1])
    got = Q.exact_quantiles(frame, ["g"], "v", [0.1, 0.9], held=2000).first()["_q"]
    values = np.array([r["v"] for r in frame.collect()])
    assert got == pytest.approx(np.quantile(values, [0.1, 0.9]).tolist())
    assert len(seen) == 2 and seen[0][1].count() == 4 * 200_000
    assert seen[-1][1].groupBy("_rank").count().agg(F.max("count")).first()[0] <= 2000
