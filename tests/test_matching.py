import itertools

import pytest
from pyspark.sql import functions as F

from quarrymill.functions import versions as V
from quarrymill.operators import matching

REQUESTS = [(n, f"p{n % 2}", v) for n, v in enumerate([f"{m}.{k}.0" for m in range(20) for k in (0, 5)] * 2 + ["1234567.0", "8.0", None, "8.0"])] + [(None, "p0", "8.0"), (3, "p1", "4.0")]
ENDS = [None, *range(0, 20, 3)]
ROWS = [(k, f"p{k % 2}", lo, hi) for k, (lo, hi) in enumerate(itertools.product(ENDS, ENDS))]


def tables(spark):
    text = lambda x: None if x is None else f"{x}.1.0"
    rows = [(k, k % 7, p, "npm", text(lo), text(hi), None) for k, p, lo, hi in ROWS] + [(900, 1, "p0", "npm", "2.0", None, "3.5"), (901, 1, "p0", "npm", "9.0", "2.0", None)]
    affected = spark.createDataFrame(rows, "row_id long, vuln_no long, package_name string, ecosystem string, introduced_version string, fixed_version string, last_affected_version string")
    return spark.createDataFrame(REQUESTS, "request_id long, package_name string, version string"), affected


def got(df):
    return sorted(map(tuple, df.select("request_id", "row_id").collect()), key=str)


def plans(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def hashed_once(df):
    """No row of the large table is sorted or written more than once."""
    plan = plans(df)
    return "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and "RoundRobin" not in plan and plan.count("Generate explode") == 0


@pytest.mark.parametrize("evr", [V.dpkg_evr, V.rpm_evr])
def test_keyed_ranges_meet_near_versions_alone(spark, evr):
    r, a = tables(spark)
    df = matching.match_keyed(r, a, evr)
    k = evr(F.col("version"))
    want = r.join(a, "package_name").where(F.col("fixed_version").isNotNull() & (k < evr(F.col("fixed_version"))) & (F.col("introduced_version").isNull() | (k >= evr(F.col("introduced_version")))))
    assert got(df) == got(want) and df.count() > 500
    assert hashed_once(matching.match_keyed(r.where("version <> ''"), a, evr))


def test_semver_ranges_meet_near_versions_alone(spark):
    r, a = tables(spark)
    a = matching.with_integer_bounds(a)
    df = matching.match_semver(r, a)
    v = V.normalize_version(F.col("version"))
    want = r.join(a, "package_name").where(v.isNull() | V.range_matches(v, F.col("introduced_int"), F.col("fixed_int"), F.col("last_affected_int")))
    assert got(df) == got(want) and df.count() > 500
    assert {x.request_id for x in df.where("approximate").collect()} == {80, 82}
    assert hashed_once(matching.match_semver(r.where("version like '%.0'").where("version not like '1234567%'"), a))


def merged(df):
    return sorted(map(tuple, df.select("request_id", "vuln_no", "n_rows", "fixed_version", "ecosystems").collect()), key=str)


def test_merged_where_rows_lie(spark):
    r, a = tables(spark)
    more = [(5, 1, "p0", "PyPI", None, "", None), (5, 1, "p0", "Debian:12", "1.0", "2.0-2", None), (5, 1, "p0", "npm", "1.0", "2.0-1", None), (None, None, "p1", None, "3.0", None, None), (7, 2, "p1", None, "x", "9.9", "1.0"), (8, 2, None, "npm", None, None, None)]
    a = matching.with_integer_bounds(a.unionByName(spark.createDataFrame(more, a.schema)))
    single = r.groupBy("request_id").count().where("count = 1").select("request_id")
    for asked in (r, r.join(single, "request_id")):
        want = matching.merge_results(matching.match_semver(asked, a))
        df = matching.search_merged(asked, a)
        assert merged(df) == merged(want) and df.count() > 300
        few = matching.search_merged(asked, a, 3)
        assert sorted(map(tuple, few.collect()), key=str) == sorted(map(tuple, matching.first_per_request(want, 3).select("request_id", "vuln_no", "n_rows").collect()), key=str)
    assert "Aggregate" not in plans(df).split("FlatMapCoGroups")[0]
    assert matching.search_merged(r.where("false"), a).count() == 0 == matching.search_merged(r, a.where("false")).count()


def test_equal_questions_are_searched_once(spark):
    from quarrymill.operators import search

    rows = [(n, "a", v, e) for n, (v, e) in enumerate([("1.5.0", "npm"), ("1.5.0", "npm"), (None, None), ("9.0", "npm"), (None, None), ("1.5.0", "npm")])] + [(9, "a", "1.5.0", "npm"), (9, "a", "9.0", "npm"), (9, "a", "9.0", "npm"), (None, "a", "1.5.0", "npm")]
    requests = spark.createDataFrame(rows, "request_id long, package_name string, version string, ecosystem string")
    asked, members = search.questions(requests)
    assert sorted((r.request_id if r.request_id is not None else -1, r.version) for r in asked.collect()) in ([(0, "1.5.0"), (2, None), (3, "9.0"), (9, "1.5.0"), (9, "9.0")], [(-1, "1.5.0"), (2, None), (3, "9.0"), (9, "1.5.0"), (9, "9.0")])
    ints = {n: F.lit(None).cast("bigint") for n in ("fixed_int", "last_affected_int")}
    osv = spark.createDataFrame([("O1", "a", "npm", "SEMVER", 1, "1.0.0", None, None, ["9.0"]), ("O2", "a", "npm", "SEMVER", None, "1.2.0", None, None, []), ("O3", "a", "npm", "versions", 1, None, None, None, ["9.0"])],
                                "own_id string, package_name string, ecosystem string, kind string, master_no long, introduced_version string, fixed_version string, last_affected_version string, versions array<string>")
    osv = osv.withColumns({"introduced_int": V.normalize_version(F.col("introduced_version"))} | ints)
    nvd = osv.where("false").select("own_id", "package_name", "ecosystem", "master_no", "fixed_version", "introduced_int", *ints)
    adv = osv.where("false").select("own_id", "package_name", "master_no", "versions", F.lit("v").alias("vendor"), *(F.lit(None).cast("string").alias(n) for n in ("version_start", "version_end", "fixed_version")), *(F.lit(None).cast("bigint").alias(n) for n in ("version_start_int", "version_end_int", "last_affected_int")))
    masters = spark.createDataFrame([(1, "CVE-1", None, None)], "master_no long, cve_id string, osv_id string, advisory_id string")
    show = lambda df: sorted(((r.request_id, r.id, r.external_id, sorted(r.aliases)) for r in df.collect()), key=str)
    got = search.search_all(requests, osv, nvd, adv, masters)
    assert show(got) == show(search.search_questions(requests, osv, nvd, adv, masters)) and got.count() == 16
    # A row leaves its partition once, however many keys it has.
    once = search.search_osv(search.prepared(requests), osv)
    assert "Generate explode(keys" not in plans(once) and "ShuffledHashJoin" in plans(once)


def test_a_platform_name_is_searched_once(spark):
    from quarrymill.operators import search

    cpe = lambda product, v: f"cpe:2.3:a:acme:{product}:{v}:*:*:*:*:*:*:*"
    names = spark.createDataFrame([(1, cpe("kit", "1.5.0")), (2, cpe("kit", "1.5.0")), (3, cpe("kit", "*")), (4, cpe("kit", "1.5.0")), (4, cpe("tool", "*")), (5, cpe("none", "*"))], "request_id long, cpe string")
    rows = spark.createDataFrame([(f"N{n}", n, "acme", "kit" if n % 3 else "tool", n * 1_000_000_000 if n > 2 else None) for n in range(8)], "own_id string, row_id long, vendor string, package_name string, introduced_int long")
    rows = rows.withColumns({n: F.lit(None).cast("bigint") for n in ("fixed_int", "last_affected_int")})
    df = search.search_cpe(names, rows, limit=2, offset=1)
    assert sorted(map(tuple, df.collect())) == [(1, "N2", 2), (2, "N2", 2), (3, "N2", 2), (3, "N4", 4), (4, "N1", 1), (4, "N2", 2)]
    assert "asked_by" in plans(df).split("Window")[0]
