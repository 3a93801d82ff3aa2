"""Rounding that agrees with SQL on doubles."""

import math

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import assembly


def test_rounded_zero_keeps_its_sign(spark):
    got = [r.y for r in spark.createDataFrame([(-1e-9,), (1e-9,), (-0.0,), (0.0000005,), (-0.0000005,), (None,)], "x double").select(T.rounded(F.col("x"), 6).alias("y")).collect()]
    assert got == [0.0, 0.0, 0.0, 1e-6, -1e-6, None]
    assert [math.copysign(1, y) for y in got[:3]] == [-1, 1, -1]


def test_support_attributes_keep_the_sign(spark):
    s = spark.createDataFrame([(1, 0, "a", -1e-12, 0.5, None, 0, None)], "doc_id int, sent_idx int, cid string, logit double, prob_cal double, dense double, dense_rank int, sparse_rank int")
    (row,) = assembly.support_edges(s, 1).collect()
    assert row.attrs == [0.0, 0.5, 0.0, 1.0, 0.0] and [math.copysign(1, x) for x in row.attrs] == [-1, 1, 1, 1, 1]
