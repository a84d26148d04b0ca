import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspark.functions.selection import exact_quantiles, exact_quantiles_of
from shelfspark.functions.semantics import nearest
from shelfspark.functions.texts import say
from shelfspark.plans import config


def doubles(n):
    rng = random.Random(1)
    out = [0.0, -0.0, 0.5, 1.5, 2.5, -2.5, 0.125, 2.675, 1.005, -1.005, 0.045, 1e15 + 0.5, 2.0**52 + 1, 1e17, 1e300, 5e-324, math.inf, -math.inf]
    out += [rng.randrange(10**6) / 8 for _ in range(n // 8)]
    out += [round(rng.uniform(0, 1000), 3) for _ in range(n // 4)]
    out += [rng.randrange(10**7) / 1000 + 0.0005 for _ in range(n // 4)]
    out += [rng.uniform(-1, 1) * 10 ** rng.randint(-8, 12) for _ in range(n // 4)]
    while len(out) < n:
        x = struct.unpack("<d", struct.pack("<Q", rng.getrandbits(64)))[0]
        if not math.isnan(x):
            out.append(x)
    return out


def test_rounding_equals_python(spark):
    values = doubles(100_000)
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i long, x double").repartition(8)
    got = rows.select("i", *[nearest(F.col("x"), k).alias(f"r{k}") for k in (0, 1, 2, 4)]).toPandas().sort_values("i")
    for k in (0, 1, 2, 4):
        want = [x if math.isinf(x) else round(x, k) for x in values]
        assert got[f"r{k}"].tolist() == want
    other = spark.createDataFrame([(None,), (math.nan,)], "x double").select(nearest(F.col("x"), 2).alias("r")).collect()
    assert other[0].r is None
    assert math.isnan(other[1].r)


def test_sentences_round_as_python(spark):
    rows = spark.createDataFrame([(0.25, 2.675, 7), (0.35, -0.004, 8), (1234567.5, 1e-9, 9)], "a double, b double, c int")
    got = [r[0] for r in rows.select(say("%.1f %% of %d is %.2f, %.0f", F.col("a"), F.col("c"), F.col("b"), F.col("a"))).collect()]
    assert got == [f"{a:.1f} % of {c} is {b:.2f}, {a:.0f}" for a, b, c in ((0.25, 2.675, 7), (0.35, -0.004, 8), (1234567.5, 1e-9, 9))]


@pytest.mark.parametrize("few", [1, 50, 10_000])
def test_quantiles_are_exact(spark, few):
    rng = np.random.default_rng(5)
    fractions = [0.0, 0.05, 0.1, 0.5, 0.777, 0.95, 1.0]
    for values in (rng.normal(0, 1, 4001), rng.integers(0, 3, 3000).astype(float), 10 ** rng.uniform(-300, 300, 2500), np.array([7.0]), np.array([1.0, 2.0]), np.concatenate((np.zeros(3000), [1e308, -1e308]))):
        df = spark.createDataFrame([(float(x),) for x in values] + [(None,), (math.nan,)], "x double").repartition(3)
        got = exact_quantiles(df, "x", fractions, few)
        ordered = np.sort(values)
        for f, q in zip(fractions, got, strict=True):
            at = f * (len(values) - 1)
            low, high = ordered[math.floor(at)], ordered[math.ceil(at)]
            assert q == low + (high - low) * (at - math.floor(at))
    assert exact_quantiles(df.limit(0), "x", [0.5]) == [None]


def test_quantiles_of_several_columns_come_from_the_same_scans(spark):
    rng = np.random.default_rng(6)
    parts = {"a": rng.normal(0, 1, 5000), "b": rng.integers(-2, 3, 5000).astype(float), "c": np.append(rng.exponential(1e-9, 4998), (math.inf, -math.inf))}
    df = spark.createDataFrame([tuple(map(float, r)) + (None,) for r in zip(*parts.values(), strict=True)], "a double, b double, c double, d double")
    got = exact_quantiles_of(df, {"a": [0.1, 0.5], "b": [0.3], "c": [0.25, 0.0, 1.0], "d": [0.5]}, few=10)
    for c, fractions in (("a", [0.1, 0.5]), ("b", [0.3]), ("c", [0.25])):
        ordered = np.sort(parts[c])
        for f, q in zip(fractions, got[c], strict=False):
            at = f * 4999
            low, high = ordered[math.floor(at)], ordered[math.ceil(at)]
            assert q == low + (high - low) * (at - math.floor(at))
    assert got["c"][1:] == [-math.inf, math.inf]
    assert got["d"] == [None]


def test_env_file(tmp_path):
    (tmp_path / ".env").write_text("# folders\nDATA_DIR=/d  # the data\nexport ARTIFACTS_DIR=\"/a b/\\\"x\\\"\"\nMODELS_DIR='/m # no comment'\nnonsense\n\nREPORTS_DIR =\n")
    base = str(tmp_path)
    assert config.read_env(f"{base}/.env") == {"DATA_DIR": "/d", "ARTIFACTS_DIR": '/a b/"x"', "MODELS_DIR": "/m # no comment", "REPORTS_DIR": ""}
    assert config.folders(base, {"DATA_DIR": "/e"}) == config.Folders("/e", '/a b/"x"', "/m # no comment", '/a b/"x"/reports')
    assert config.read_env(f"{base}/none") == {}
