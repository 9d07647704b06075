"""PRJ7: the exact binary value decides, ties go to even."""

import random

import pytest

from moodspark.functions import scores as SC

GOLDEN = [(2.675, 2, 2.67), (2.665, 2, 2.67), (0.125, 2, 0.12), (0.375, 2, 0.38), (1.005, 2, 1.0), (0.285, 2, 0.28),
          (2.5, 0, 2.0), (3.5, 0, 4.0), (-2.5, 0, -2.0), (-0.125, 2, -0.12), (1234.56785, 4, 1234.5678), (0.0, 3, 0.0)]


@pytest.mark.parametrize("x,places,want", GOLDEN)
def test_golden(spark, x, places, want):
    assert spark.range(1).select(SC.round_exact(_lit(x), places)).first()[0] == want


def test_random_and_ties(spark):
    rnd = random.Random(1)
    values = [rnd.uniform(-1000, 1000) for _ in range(500)] + [k / 16 for k in range(-200, 200)] + [round(rnd.random(), 3) + 0.0005 for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for places in (0, 2, 3, 4):
        got = [r[0] for r in df.select(SC.round_exact("x", places)).collect()]
        assert got == [round(v, places) if places else float(round(v)) for v in values]


def _lit(x):
    from pyspark.sql import functions as F
    return F.lit(x)
