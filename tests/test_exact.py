"""Order-free exact sums against math.fsum."""

import math
import random
import struct

import pytest
from boxlake.functions import exact
from pyspark.sql import functions as F


def doubles(seed, n):
    r = random.Random(seed)
    out = []
    while len(out) < n:
        v = struct.unpack("<d", struct.pack("<Q", r.getrandbits(64)))[0]
        if math.isfinite(v) and abs(v) < 1e300:
            out.append(v)
    return out


EDGE = [0.0, -0.0, 5e-324, -5e-324, 2.0**-1056, 2.0**-1057 * 3, 2.2250738585072014e-308, 1.0, -1.0, 2.0**32, 2.0**32 - 1, math.nextafter(2.0**32, 0), math.nextafter(2.0**64, 0), 1e308, -1e308, 0.1, 1 / 3]
CASES = {"edge": EDGE, "wide": doubles(1, 400), "cancels": [1e16, 1.0, -1e16, 1e-300, 3.0, -3.0] * 7, "latency": [random.Random(3).random() * 1000 for _ in range(500)], "none": []}


def test_sums_equal_fsum_under_any_partitioning(spark):
    rows = [(name, v) for name, vs in CASES.items() for v in vs] + [("nulls", None)]
    df = spark.createDataFrame(rows, "key string, v double")
    found = []
    for n in (1, 7):
        got = {r.key: (r.v_total, r.v_mean) for r in exact.means(df.repartition(n), {"v": F.col("v")}, ["key"]).collect()}
        found.append({k: tuple(map(float.hex, v)) for k, v in got.items()})
    assert found[0] == found[1]
    for name, vs in CASES.items():
        if vs:
            assert found[0][name] == (math.fsum(vs).hex(), (math.fsum(vs) / len(vs)).hex()), name


def test_partial_sums_merge(spark):
    vs = CASES["wide"] + CASES["cancels"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vs)], "i int, v double")
    parts = [exact.partial_sums(df.where(F.col("i") % 3 == k), {"v": F.col("v")}, []) for k in range(3)]
    row = exact.totals(exact.merged(parts[0].unionByName(parts[1]), []).unionByName(parts[2]), []).first()
    assert (row.n, row.total) == (len(vs), math.fsum(vs))


@pytest.mark.parametrize("vs, total", (([math.inf, 1.0], math.inf), ([math.inf, -math.inf], math.nan), ([math.nan], math.nan), ([1e308] * 3, math.inf)))
def test_what_is_no_number(spark, vs, total):
    found = exact.means(spark.createDataFrame([(v,) for v in vs], "v double"), {"v": F.col("v")}, []).first()
    assert found.v_total == total or math.isnan(found.v_total) and math.isnan(total)
