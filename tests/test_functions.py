import itertools
import random

import pytest
from pyspark.sql import functions as F

from quarrymill.functions import advisories as A
from quarrymill.functions import ecosystems as E
from quarrymill.functions import versions as V


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_normalize_version(spark):
    known = {
        "1.2.3": 1002003000, "2.9.13-6.el9": 2009013006, "0.1.15-2.gitabcdef": 1015002, "1:2.9.13-6.el9": 2009013006, "8.0 U3d": 8000003004,
        "2.0.0-beta.1": 1999999999, "9999999.0.0": None, "5": 5000000000, "not-a-version": 0, "6_update_4": 6004000000, "1.2.1000": 1003000000, "1.5.0_21": 1005021000,
    }
    assert column(spark, list(known), V.normalize_version) == list(known.values())
    assert column(spark, [None, ""], V.normalize_version) == [None, 0]


@pytest.mark.parametrize("a,b", [("1.9", "1.10"), ("1.a", "1.0"), ("1.0", "1.0.1"), ("0:9.0-1", "1:1.0-1"), ("7.76.1-23.el9", "7.76.1-26.el9_3.3")])
def test_rpm_order(spark, a, b):
    assert spark.range(1).select(V.compare(V.rpm_evr(F.lit(a)), V.rpm_evr(F.lit(b)))).first()[0] == -1


def test_rpm_leading_zeros(spark):
    assert spark.range(1).select(V.compare(V.rpm_key(F.lit("01.02")), V.rpm_key(F.lit("1.2")))).first()[0] == 0


@pytest.mark.parametrize("a,b", [("1.0~beta1", "1.0"), ("1.0~~", "1.0~"), ("1.0a", "1.0+"), ("1.0", "1.0.0"), ("2.9.2-r1~rc1", "2.9.2-r1")])
def test_dpkg_order(spark, a, b):
    assert spark.range(1).select(V.compare(V.dpkg_evr(F.lit(a)), V.dpkg_evr(F.lit(b)))).first()[0] == -1


def by_hand_dpkg(a, b):
    """Compare run by run, as the policy manual words it."""
    def weight(ch):
        return -1 if ch == "~" else 0 if ch is None else ord(ch) if ch.isalpha() else ord(ch) + 256

    i = j = 0
    while i < len(a) or j < len(b):
        while i < len(a) and not a[i].isdigit() or j < len(b) and not b[j].isdigit():
            x, y = (a[i] if i < len(a) and not a[i].isdigit() else None), (b[j] if j < len(b) and not b[j].isdigit() else None)
            if weight(x) != weight(y):
                return -1 if weight(x) < weight(y) else 1
            i, j = i + (x is not None), j + (y is not None)
        x = "".join(itertools.takewhile(str.isdigit, a[i:]))
        y = "".join(itertools.takewhile(str.isdigit, b[j:]))
        if int(x or 0) != int(y or 0):
            return -1 if int(x or 0) < int(y or 0) else 1
        i, j = i + len(x), j + len(y)
    return 0


def test_dpkg_against_rules(spark):
    rng = random.Random(3)
    pairs = [tuple("".join(rng.choice("01 9az~+.".replace(" ", "")) for _ in range(rng.randint(0, 6))) for _ in range(2)) for _ in range(800)]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", V.compare(V.dpkg_key(F.col("a")), V.dpkg_key(F.col("b"))).alias("c"))
    wrong = [(r.a, r.b, r.c) for r in df.collect() if r.c != by_hand_dpkg(r.a, r.b)]
    assert not wrong


def test_ranges(spark):
    rows = [("1.5.0", "1.0.0", "2.0.0", None, True), ("2.0.0", "1.0.0", "2.0.0", None, False), ("0.9.0", "1.0.0", None, None, False), ("2.0.0", None, None, "2.0.0", True), ("bad", "9999999.0.0", None, None, False)]
    df = spark.createDataFrame(rows, "v string, i string, f string, l string, want boolean")
    assert df.where(V.version_in_range(F.col("v"), F.col("i"), F.col("f"), F.col("l")) != F.col("want")).count() == 0
    rows = [("1", ["1"], None, None, None, True), ("1", [], None, None, None, False), ("1.0", [], "", None, None, True), ("1.0~rc1", [], "1.0", None, None, False), ("1.0", None, None, "1.0a", None, True)]
    df = spark.createDataFrame(rows, "v string, li array<string>, i string, f string, l string, want boolean")
    assert df.where(V.dpkg_row_matches(F.col("v"), F.col("li"), F.col("i"), F.col("f"), F.col("l")) != F.col("want")).count() == 0
    rows = [("1.0-1", None, "1.0-2", True), ("1.0-2", None, "1.0-2", False), ("1.0-1", None, None, False), ("1.0-1", "1.1", "2", False)]
    df = spark.createDataFrame(rows, "v string, s string, e string, want boolean")
    assert df.where(V.rpm_range_matches(F.col("v"), F.col("s"), F.col("e")) != F.col("want")).count() == 0


def test_floors(spark):
    row = spark.range(1).select(
        V.module_floor(F.lit("20"), F.lit("20.8.1-1.module+el9")), V.module_floor(F.lit("8.4"), F.lit("8.4.9")), V.module_floor(F.lit("201801"), F.lit("3.0.0-21")),
        V.bare_floor(F.lit("postgresql"), F.lit("9.6.20-1")), V.bare_floor(F.lit("httpd"), F.lit("2.4.62-1")), V.bare_floor(F.lit("mysql-selinux"), F.lit("1.0.1")),
    ).first()
    assert list(row) == ["20.0", "8.4", None, "9.6", "2.4", None]


def test_cpe_and_routes(spark):
    names = ["cpe:2.3:a:apache:httpd:2.4.58:*:*:*:*:*:*:*", "cpe:2.3:a:apache:httpd:*", "cpe:2.3:a:*:httpd:1", "cpe:2.3:a:apache:-:1", "cpe:2.3:a"]
    got = column(spark, names, E.parse_cpe)
    assert got[0].version == "2.4.58" and got[1].version is None and got[2:] == [None] * 3
    assert column(spark, ["composer", "Red Hat:9", "Red Hat", "Ubuntu", "Debian:12", "Rocky:9", None], E.route) == ["language", "rpm", "other", "other", "dpkg", "list", "default"]


def test_event_fold(spark):
    schema = "e array<struct<introduced: string, fixed: string, last_affected: string>>"
    lists = [[("0", None, None), (None, "1", None), ("2", None, None)], [("0", None, None), ("1", None, None)], [(None, "3", None)], [(None, None, "4"), ("5", None, None), (None, None, "6")], []]
    got = [[tuple(r) for r in x[0]] for x in spark.createDataFrame([(x,) for x in lists], schema).select(A.event_ranges(F.col("e"))).collect()]
    assert got == [[("0", "1", None), ("2", None, None)], [("0", None, None), ("1", None, None)], [(None, "3", None)], [(None, None, "4"), ("5", None, "6")], []]


def test_small_parsers(spark):
    assert column(spark, ["CVE-2024-1, CVE-2024-22 CVE-2024-1"], A.cve_ids) == [["CVE-2024-1", "CVE-2024-22"]]
    assert column(spark, ["Important", "odd"], A.severity) == ["HIGH", "ODD"]
    assert [tuple(x) for x in column(spark, ["1.3.0-1.29.4, 2.0"], A.dashed_ranges)[0]] == [("1.3.0", None, "1.29.4"), ("2.0", None, "2.0")]
    got = column(spark, ["9.0.71 to 9.0.73", "2.4.0 before 2.4.66", "Below 9.1", "8.5 and earlier", "junk"], A.spoken_range)
    assert [x and tuple(x) for x in got] == [("9.0.71", None, "9.0.73"), ("2.4.0", "2.4.66", None), (None, "9.1", None), (None, None, "8.5"), None]
    assert tuple(column(spark, ["bash is earlier than 0:5.1-2"], A.fixed_comment)[0]) == ("bash", "0:5.1-2")
