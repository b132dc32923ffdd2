import math
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import HealthCheck
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spotframe.llm import quantiles

f32 = lambda x: struct.unpack("f", struct.pack("f", x))[0]
EDGE = [0.0, -0.0, 1.0, -1.0, 2.0**-149, -(2.0**-149), 2.0**-126, 3.4028234663852886e38, 0.1, 1.9999999, 2.0, 8388609.0, -7.5]


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False, width=32), min_size=1, max_size=40))
def test_numbers_keep_order_and_value(spark, xs):
    xs = [f32(x) for x in xs + EDGE]
    df = spark.createDataFrame([(x,) for x in xs], "x float")
    rows = df.select("x", quantiles.ordered_bits(F.col("x")).alias("n")).withColumn("back", quantiles.value_of(F.col("n"))).collect()
    assert all(r.back == r.x for r in rows)
    assert [r.x for r in sorted(rows, key=lambda r: r.n)] == sorted(r.x for r in rows)


@pytest.mark.parametrize("bits", [16, 11])
def test_exact_percentiles_at_every_level(spark, bits):
    rng = np.random.default_rng(2)
    rows = [(g, d, f32(x)) for g, d, x in zip(rng.choice(["a", "b", None], 400, p=[0.7, 0.2, 0.1]).tolist(), rng.integers(0, 6, 400).tolist(), np.round(rng.lognormal(size=400), 1).tolist())]
    df = spark.createDataFrame(rows, "g string, d int, x float")
    fine, coarse = quantiles.percentiles(df, [["g", "d"], ["g"]], "x", [0, 5, 50, 90, 100], bits=bits)
    for out, key in ((fine, lambda r: (r[0], r[1])), (coarse, lambda r: r[0])):
        groups = {}
        for r in rows:
            groups.setdefault(key(r), []).append(r[2])
        got = {((r.g, r.d) if "d" in out.columns else r.g, r.pct): r.value for r in out.collect()}
        assert len(got) == 5 * len(groups)
        for (k, p), v in got.items():
            assert v == pytest.approx(np.percentile(np.array(groups[k], "float64"), p), abs=1e-9)


def test_days_add_up_to_the_whole(spark):
    df = spark.createDataFrame([("d1", 1.0), ("d1", 2.0), ("d2", 2.0)], "d string, x float").withColumn("n", quantiles.ordered_bits(F.col("x")))
    day = quantiles.interval_counts(df, ["d"], "n", 0)
    whole = quantiles.add_counts(day.withColumn("all", F.lit(1)), ["all"])
    assert sorted(r.n for r in whole.collect()) == [1, 2]


def test_one_value_ties_and_empty(spark):
    df = spark.createDataFrame([("a", 3.0)] * 5 + [("b", 1.0)], "g string, x float")
    out = quantiles.percentiles(df, [["g"]], "x", [50, 90])[0]
    assert {(r.g, r.pct, r.value, r["size"]) for r in out.collect()} == {("a", 50, 3.0, 5), ("a", 90, 3.0, 5), ("b", 50, 1.0, 1), ("b", 90, 1.0, 1)}
    assert quantiles.percentiles(df.limit(0), [["g"]], "x", [50])[0].count() == 0
    assert not math.isnan(1.0)
