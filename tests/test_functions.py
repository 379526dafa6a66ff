"""Column functions against Python."""

import datetime
import hashlib
import math

import pytest
from pyspark.sql import functions as F

from memweave import functions as fn


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(expr.alias("x")).first().x


def test_hash_trims_every_javascript_space_and_lowers(spark):
    text = "﻿ 　\t User LOVES Postgres \r\n "
    assert one(spark, fn.content_hash("t"), t=text) == hashlib.sha256(b"user loves postgres").hexdigest()
    assert one(spark, fn.js_trim("t"), t="\t  ") == ""


def test_present_counts_blanks_but_not_empty(spark):
    df = spark.createDataFrame([(" ",), ("",), (None,)], "t string").select(fn.present("t").alias("x"))
    assert [r.x for r in df.collect()] == [True, False, False]


def test_slices_count_utf16_units(spark):
    text = "a😀bcd"
    assert one(spark, fn.utf16_slice("t", F.lit(3), F.lit(5)), t=text) == "bc"
    assert one(spark, fn.utf16_slice("t", F.lit(0), F.lit(0)), t=text) == ""


def test_cosine_distance_range_nulls_and_zero(spark):
    rows = [([1.0, 0.0], [0.0, 2.0]), ([1.0, 1.0], [2.0, 2.0]), ([1.0, 0.0], [-3.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0, 0.0])]
    got = [r.x for r in spark.createDataFrame(rows, "a array<float>, b array<float>").select(fn.cosine_distance("a", "b").alias("x")).collect()]
    assert [round(x, 9) for x in got[:3]] == [1, 0, 2] and math.isnan(got[3]) and got[4] is None


def test_dimension_mismatch_is_an_error(spark):
    with pytest.raises(Exception, match="different dimensions"):
        one(spark, fn.cosine_distance("a", "b"), a=[1.0, 2.0], b=[1.0])
    with pytest.raises(Exception, match="expected 3 dimensions"):
        one(spark, fn.checked_dimension("a", 3), a=[1.0])
    assert one(spark, fn.vector_from_json("j"), j="[0.5, 1]") == [0.5, 1.0]


@pytest.mark.parametrize("text, want", [
    ("1700000000", datetime.datetime(2023, 11, 14, 22, 13, 20)), ("2024-02-29", datetime.datetime(2024, 2, 29)),
    ("2024-02-29T10:00:00Z", datetime.datetime(2024, 2, 29, 10)), ("yesterday", None),
])
def test_event_times(spark, text, want):
    assert one(spark, F.date_format(fn.parse_event_time("t"), "yyyy-MM-dd HH:mm:ss"), t=text) == (want and want.strftime("%Y-%m-%d %H:%M:%S"))


def test_structured_attributes(spark):
    df = spark.createDataFrame([(datetime.datetime(2024, 3, 30, 5),)], "ts timestamp_ntz").select(*fn.structured_attributes("ts"))
    assert tuple(df.first()) == (30, 3, 2024, 1, 6, True)


def test_ids_tell_null_from_empty_and_parts_apart(spark):
    df = spark.createDataFrame([("a", "b"), ("a|1:b", None), ("a", None), ("a", "")], "x string, y string").select(fn.deterministic_id("k", "x", "y").alias("i"))
    assert len({r.i for r in df.collect()}) == 4


def test_templates(spark):
    df = spark.createDataFrame([("u1", "", None, "Ann"), ("u2", "a@b.c", "Bo", "")], "id string, email string, n string, m string")
    got = df.select(fn.default_email(F.col("id"), F.col("email")).alias("e"), fn.user_name(F.col("n"), "Someone").alias("n"), fn.org_name(F.col("m")).alias("o")).collect()
    assert [tuple(r) for r in got] == [("u1@clerk.local", "Someone", "Ann's Org"), ("a@b.c", "Bo", "My Org")]
