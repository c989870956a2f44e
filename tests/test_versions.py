from itertools import pairwise

import pytest
from pyspark.sql import functions as F

from siftline.functions import versions as v


@pytest.mark.parametrize(
    "ascending",
    [
        ["1-alpha-1", "1-alpha2", "1-beta", "1-milestone", "1-rc", "1-SNAPSHOT", "1", "1-sp", "1-xyz", "1-1", "1.1"],
        ["4.1.110.Final", "4.1.133.Final", "4.1.140.Final"],
        ["5.7.0", "5.7.25", "5.8", "5.10", "6.3.18"],
        ["2.0-RC1", "2.0-RC2", "2.0", "2.0.1", "10.0"],
        ["1.0-RC1", "1.0", "1.0.1"],
    ],
)
def test_order(ascending):
    assert all(v.maven_key(a) < v.maven_key(b) for a, b in pairwise(ascending))


@pytest.mark.parametrize(
    "same",
    [["1", "1.0", "1.0.0", "1-ga", "1.final", "1.0-RELEASE", "1-0"], ["1-cr1", "1-rc1", "1-RC-1"], ["1.0-a1", "1-alpha-1", "1alpha1"], ["2.5.Final", "2.5.0.GA"]],
)
def test_equals(same):
    assert len({v.maven_key(x) for x in same}) == 1


def test_jumps_and_parts(spark):
    rows = [
        ("3.2.1", "3.2.12", "PATCH"), ("3.1.5", "3.2.12", "MINOR"), ("2.7.18", "3.0.0", "MAJOR"), ("1.0-RC1", "1.0.1", "PATCH"),
        ("1.0", "1.0-RC1", "UNKNOWN"), ("1.10", "1.10.1", "PATCH"), ("${v}", "1", "UNKNOWN"), (None, "1", "UNKNOWN"), ("", "2", "UNKNOWN"),
        ("5.3.18", "5.3.18.RELEASE", "UNKNOWN"), ("2", "1", "UNKNOWN"),
    ]
    df = v.with_version_keys(spark.createDataFrame(rows, "a string, b string, want string"), ka="a", kb="b")
    got = df.select("want", v.jump_class(v.numeric_parts(F.col("a")), v.numeric_parts(F.col("b")), F.col("kb") > F.col("ka")).alias("got"))
    assert all(r.want == r.got for r in got.collect()) and got.count() == len(rows)
    majors = spark.createDataFrame([("5.2.20.RELEASE", 5), ("v2-x", 2), ("abc", -1), ("", -1), ("2023.0.3", 2023), (None, -1)], "v string, want int")
    assert all(r.want == r.m for r in majors.select("want", v.major(F.col("v")).alias("m")).collect())


def test_range_text(spark):
    rows = [("1", None, None, "2", ">= 1, < 2"), (None, "1", "2", None, "> 1, <= 2"), ("1", None, None, None, ">= 1, "), (None, None, None, "", "(버전 제한 없음)"), (None, None, "3", None, "<= 3")]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, want string")
    assert all(r.want == r.got for r in df.select("want", v.range_text(*map(F.col, "abcd")).alias("got")).collect())
