"""Sums and bounds of the bootstrap against plain formulas."""

import datetime
import math

import numpy as np
import pyarrow as pa
import pytest

from tidebar.operators import validation
from tidebar.operators.validation import POISSON_CUTS, PRIME


def test_sums_equal_the_formula_also_where_the_remainder_is_zero():
    m1 = 48271 + 11
    # h1 * m(1) + h2 = PRIME exactly, and 0: both weigh as remainder 0
    h1 = [0, PRIME // m1, 2**28 - 1, 12345, 777]
    h2 = [0, PRIME - PRIME // m1 * m1, 2**28 - 1, 2**28 - 1, 5]
    r, keys = [1.0, 2.0, -4.0, 8.0, 16.0], ["a", "a", "b", "b", "a"]
    batch = pa.RecordBatch.from_arrays([pa.array(keys), pa.array(r), pa.array(h1), pa.array(h2)], ["key", "r", "h1", "h2"])
    found = {x["key"]: x for b in validation.replicate_sums(50)([batch]) for x in b.to_pylist()}
    for key in "ab":
        for k in range(50):
            w = {j: sum((h1[j] * (((k + 1) * 48271 + 11) % PRIME) + h2[j]) % PRIME >= c for c in POISSON_CUTS) for j in range(5) if keys[j] == key}
            assert found[key]["weight"][k] == sum(w.values())
            assert found[key]["total"][k] == sum(r[j] * w[j] for j in w)


def test_no_row_per_replicate_is_shuffled(spark):
    day = datetime.date(2020, 1, 1)
    rows = [(s, day + datetime.timedelta(days=n), math.sin(n * (1 + len(s)))) for s in ("x", "yy") for n in range(40)]
    out = validation.bootstrap(spark.createDataFrame(rows, "symbol string, date date, r double").repartition(3), 101)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
    got = {r["symbol"]: r for r in out.collect()}
    for s in ("x", "yy"):
        assert got[s]["ci_lo"] < got[s]["ci_hi"] and 0 <= got[s]["pos_rate"] <= 1


@pytest.mark.parametrize("p", [0.05, 0.5, 0.95])
def test_quantiles_equal_those_of_numpy(spark, p):
    from pyspark.sql import functions as F

    for values in ([3.0], [1.0, 2.0], [float(x * x) for x in range(38)]):
        got = spark.range(1).select(validation.quantile(F.array(*map(F.lit, values)), p)).first()[0]
        assert got == pytest.approx(np.quantile(values, p))
    assert spark.range(1).select(validation.quantile(F.array().cast("array<double>"), p)).first()[0] is None
