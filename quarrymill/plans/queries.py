"""Queries over the fixture views, and the same results stated otherwise in SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import advisories as A
from ..functions import ecosystems as E
from ..functions import products as P
from ..functions import versions as V
from ..operators import master as M
from ..operators import matching as S
from ..operators import resolve as R
from ..sources import nvd as N
from .fixtures import FIXTURES

TABLES = ("lineitem", "part", "orders", "supplier", "customer", "events")
c = F.col


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A SELECT over fixture names and tables, read from ``sf_dir`` under names of this call's own."""
    for name, text in FIXTURES.items():
        sql = re.sub(rf"\b{name}\b", f"({text}) {name}", sql)
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"\b{t}\b", sql)}
    for t in frames:
        sql = re.sub(rf"(\bFROM|\bJOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **frames)


def fx(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return view(spark, sf_dir, f"SELECT * FROM {name}")


def _int(text: str) -> str:
    """SQL: integer form of a plain x.y.z version."""
    part = lambda k: f"CAST(split_part({text}, '.', {k}) AS BIGINT)"
    return f"({part(1)} * 1000000000 + {part(2)} * 1000000 + {part(3)} * 1000)"


def with_fixtures(sql: str) -> str:
    used = [n for n in FIXTURES if re.search(rf"\b{n}\b", sql)]
    head = ", ".join(f"{n} AS ({FIXTURES[n]})" for n in used)
    return f"WITH {head}, {sql[5:]}" if sql.startswith("WITH ") else f"WITH {head} {sql}"


_HIT = f"""a.package_name = r.package_name AND {_int('introduced_version')} <= {_int('version')}
  AND CASE WHEN fixed_version IS NOT NULL THEN {_int('fixed_version')} > {_int('version')}
           WHEN last_affected_version IS NOT NULL THEN {_int('last_affected_version')} >= {_int('version')} ELSE true END"""


def range_join(spark, d):
    return S.match_semver(fx(spark, d, "fx_installed"), S.with_integer_bounds(fx(spark, d, "fx_affected"))).select("request_id", "row_id", "vuln_no")


def search_dedup(spark, d):
    return S.search_merged(fx(spark, d, "fx_installed"), S.with_integer_bounds(fx(spark, d, "fx_affected")))


def search_batch(spark, d):
    return S.search_merged(fx(spark, d, "fx_installed"), S.with_integer_bounds(fx(spark, d, "fx_affected")), 500)


def _keyed(evr):
    def run(spark, d):
        return S.match_keyed(fx(spark, d, "fx_installed"), fx(spark, d, "fx_affected"), evr)

    return run


_KEYED_SQL = f"""SELECT r.request_id, a.vuln_no, a.row_id FROM fx_installed r JOIN fx_affected a ON a.package_name = r.package_name
  AND fixed_version IS NOT NULL AND {_int('introduced_version')} <= {_int('version')} AND {_int('fixed_version')} > {_int('version')}"""


def normalize(spark, d):
    rows = fx(spark, d, "fx_affected")
    return rows.select("row_id", V.normalize_version(c("introduced_version")).alias("lo"), V.normalize_version(F.concat(F.lit("1:"), c("fixed_version"), F.lit("-6.el9"))).alias("hi"))


def pairs(spark, d, evr):
    """Versions of known numbers in several spellings, compared as text keys."""
    p = view(spark, d, "SELECT p_partkey AS id, p_size AS x, p_partkey%13 AS y, p_partkey%5 AS z FROM part")
    a = F.concat(c("x"), F.lit("."), F.lpad(c("y").cast("string"), 3, "0"), F.lit("-"), c("z"), F.lit(".el9"))
    b = F.concat(c("z"), F.lit(":"), c("y"), F.lit("."), c("x"), F.lit("-1.el9"))
    return p.select("id", V.compare(evr(a), evr(F.concat(c("y"), F.lit("."), c("x"), F.lit("-3.el9")))).alias("plain"), V.compare(evr(a), evr(b)).alias("epoch"))


_PAIRS_SQL = """SELECT p_partkey AS id,
  CASE WHEN p_size <> p_partkey%13 THEN sign(p_size - p_partkey%13) ELSE sign(p_partkey%5 - 3) END AS plain,
  CASE WHEN p_partkey%5 > 0 THEN -1 WHEN p_size <> p_partkey%13 THEN sign(p_size - p_partkey%13) ELSE sign(p_partkey%5 - 1) END AS epoch FROM part"""


def dpkg_tilde(spark, d):
    p = view(spark, d, "SELECT p_partkey AS id, p_size AS x FROM part")
    base = F.concat(F.lit("1."), c("x"))
    order = [F.concat(base, F.lit(s)) for s in ("~rc1", "", "a", "+b")]
    return p.select("id", *(V.compare(V.dpkg_evr(a), V.dpkg_evr(b)).alias(f"c{i}") for i, (a, b) in enumerate(zip(order, order[1:], strict=False))))


def routes(spark, d):
    return fx(spark, d, "fx_affected").select("row_id", E.route(c("ecosystem")).alias("route"), E.base_ecosystem(c("ecosystem")).alias("base"), E.rpm_vendor(c("ecosystem")).alias("vendor"))


def cpes(spark, d):
    p = view(spark, d, "SELECT s_suppkey AS id, CASE s_suppkey%3 WHEN 0 THEN '*' WHEN 1 THEN 'redhat' ELSE 'Node' END AS vendor, CASE s_suppkey%4 WHEN 0 THEN '-' ELSE CAST(s_suppkey AS varchar(10)) END AS ver FROM supplier")
    got = E.parse_cpe(F.concat(F.lit("cpe:2.3:a:"), c("vendor"), F.lit(":tool:"), c("ver"), F.lit(":*:*:*:*:*:*:*")))
    return p.select("id", got["vendor"].alias("vendor"), got["product"].alias("product"), got["version"].alias("version"), E.vendor_ecosystem(got["vendor"]).alias("eco"))


def stats(spark, d):
    m = fx(spark, d, "fx_master")
    return m.groupBy("severity").agg(F.count(F.lit(1)).alias("n"), F.count_if(c("cve_id").isNull()).alias("without_cve"))


def distinct_by_ecosystem(spark, d):
    return fx(spark, d, "fx_affected").groupBy(E.base_ecosystem(c("ecosystem")).alias("base")).agg(F.countDistinct("vuln_no").alias("n_vulns"), F.countDistinct("package_name").alias("n_packages"))


def latest_jobs(spark, d):
    return M.latest(fx(spark, d, "fx_jobs"), "source", F.desc("completed_at"), F.desc("job_id")).select("source", "job_id", "status")


def cursors(spark, d):
    return M.delta_cursor(fx(spark, d, "fx_jobs"))


def kev(spark, d):
    return M.apply_kev(fx(spark, d, "fx_master"), fx(spark, d, "fx_kev")).select("vuln_no", "cve_id", "is_kev")


def kev_missing(spark, d):
    return M.not_found(fx(spark, d, "fx_master"), fx(spark, d, "fx_kev")).select("cve_id")


def epss(spark, d):
    return M.apply_epss(fx(spark, d, "fx_master"), fx(spark, d, "fx_epss")).select("vuln_no", "score_milli")


def snapshot(spark, d):
    m = fx(spark, d, "fx_master").select("vuln_no", "severity")
    return M.upsert(m.where("vuln_no % 3 <> 0"), m.where("vuln_no % 2 = 0").withColumn("severity", F.lit("NEW")), "vuln_no")


def three_strikes(spark, d):
    m = fx(spark, d, "fx_master").select("vuln_no", (c("vuln_no") % 3).cast("int").alias("missing_runs"))
    return M.prune(m, m.where("vuln_no % 2 = 0"), "vuln_no", True)


def sweep(spark, d):
    a = fx(spark, d, "fx_affected").select("package_name", "row_id", "vuln_no")
    return M.evaluate(a.where("row_id % 3 <> 0"), a.where("row_id % 5 <> 0"), "package_name", "vuln_no").select("package_name", "tp", "fp", "fn")


def bumps(spark, d):
    i = fx(spark, d, "fx_installed")
    return i.select("request_id", V.bump_patch(c("version"), 1).alias("up"), V.bump_patch(c("version"), -1).alias("down"), V.bump_last_component(c("version")).alias("nxt"))


def floors(spark, d):
    i = view(spark, d, "SELECT p_partkey AS id, CASE p_partkey%3 WHEN 0 THEN 'httpd' WHEN 1 THEN 'nodejs' ELSE 'other' END AS product, CAST(p_size AS varchar(10)) AS x, CAST(p_partkey%9 AS varchar(10)) AS y FROM part")
    end = F.concat(c("x"), F.lit("."), c("y"), F.lit(".1-2.el9"))
    return i.select("id", V.bare_floor(c("product"), end).alias("bare"), V.module_floor(c("y"), end).alias("module"))


def score_bands(spark, d):
    return view(spark, d, "SELECT c_custkey AS id, CAST(c_custkey%101 AS double)/10 AS s FROM customer").select("id", A.severity_from_score(c("s")).alias("severity"))


def cves_in_text(spark, d):
    t = view(spark, d, "SELECT o_orderkey AS id, 'fixes CVE-2024-' || CAST(1000+o_orderkey%50 AS varchar(10)) || ', CVE-2023-' || CAST(2000+o_orderkey%7 AS varchar(10)) || ' and CVE-2024-' || CAST(1000+o_orderkey%50 AS varchar(10)) AS t FROM orders")
    return t.select("id", F.array_join(A.cve_ids(c("t")), ",").alias("cves"))


def folds(spark, d):
    """Event lists of three shapes."""
    rows = fx(spark, d, "fx_affected")
    ev = lambda i, f, x: F.struct(i.alias("introduced"), f.alias("fixed"), x.alias("last_affected"))
    none = F.lit(None).cast("string")
    events = F.array(ev(c("introduced_version"), none, none), ev(none, c("fixed_version"), c("last_affected_version")), ev(F.lit("99.0.0"), none, none))
    return rows.select("row_id", F.posexplode(A.event_ranges(events)).alias("pos", "r")).select("row_id", "pos", c("r.introduced").alias("introduced"), c("r.fixed").alias("fixed"), c("r.last_affected").alias("last_affected"))


def spoken(spark, d):
    t = view(spark, d, "SELECT p_partkey AS id, p_partkey%4 AS k, CAST(p_size AS varchar(10)) || '.1' AS a, CAST(p_size+1 AS varchar(10)) || '.0.2' AS b FROM part")
    text = F.when(c("k") == 0, F.concat(c("a"), F.lit(" to "), c("b"))).when(c("k") == 1, F.concat(F.lit("Below "), c("b"))).when(c("k") == 2, F.concat(c("b"), F.lit(" and earlier"))).otherwise(F.concat(c("a"), F.lit(" before "), c("b")))
    r = A.spoken_range(text)
    return t.select("id", r["start"].alias("lo"), r["end"].alias("hi"), r["last"].alias("last"))


def boundary_points(spark, d):
    a = fx(spark, d, "fx_affected").where("fixed_version is not null")
    pts = F.array_compact(F.array(c("fixed_version"), V.bump_patch(c("fixed_version"), -1), V.bump_patch(c("fixed_version"), 1)))
    return a.select("package_name", F.explode(pts).alias("point")).groupBy("package_name", "point").agg(F.count(F.lit(1)).alias("n"))


def page_of_results(spark, d):
    return search_dedup(spark, d).orderBy("request_id", "vuln_no").offset(20).limit(30).select("request_id", "vuln_no")


_F = "split_part(fixed_version, '.', 1) || '.' || split_part(fixed_version, '.', 2) || '.'"
_Z = "CAST(split_part(fixed_version, '.', 3) AS BIGINT)"
_SEARCH = f"SELECT request_id, vuln_no, count(*) AS n_rows, struct_extract(min(struct_pack(r := row_id, f := fixed_version)) FILTER (WHERE fixed_version <> ''), 'f') AS fixed_version, string_agg(DISTINCT ecosystem, ',' ORDER BY ecosystem) AS ecosystems FROM fx_installed r JOIN fx_affected a ON {_HIT} GROUP BY 1, 2"

def alias_names(spark, d):
    p = view(spark, d, "SELECT p_partkey AS id, CASE p_partkey%4 WHEN 0 THEN 'Java' WHEN 1 THEN 'k8s' WHEN 2 THEN 'httpd' ELSE p_name END AS term FROM part")
    return p.select("id", F.explode(P.product_names(c("term"))).alias("product"))


_NVD_JSON = """{"id": "CVE-2024-@", "descriptions": [{"lang": "es", "value": "no"}, {"lang": "en", "value": "about @"}],
 "metrics": {"cvssMetricV2": [{"cvssData": {"baseScore": 5.0, "vectorString": "v2"}, "baseSeverity": "MEDIUM"}] #},
 "configurations": [{"nodes": [{"operator": "OR", "negate": false,
  "cpeMatch": [{"vulnerable": true, "criteria": "cpe:2.3:a:acme:tool@:*:*:*:*:*:*:*:*", "versionStartExcluding": "1.0.0", "versionEndExcluding": "2.@.0"},
               {"vulnerable": true, "criteria": "cpe:2.3:a:acme:point:3.@.1:*:*:*:*:*:*:*"}],
  "children": [{"operator": "AND", "negate": true, "cpeMatch": [
   {"vulnerable": true, "criteria": "cpe:2.3:a:acme:kit:1.5.0:update_@:*:*:*:*:*:*", "versionStartIncluding": "1.5.0", "versionEndIncluding": "1.5.0"},
   {"vulnerable": false, "criteria": "cpe:2.3:o:acme:base:-:*:*:*:*:*:*:*"}]}]}]}]}"""


def nvd_records(spark, d):
    text = F.replace(F.lit(_NVD_JSON), F.lit("@"), c("k").cast("string"))
    newer = F.when(c("k") % 2 == 0, F.lit(', "cvssMetricV31": [{"cvssData": {"baseScore": 9.1, "vectorString": "v31", "baseSeverity": "CRITICAL"}}]')).otherwise(F.lit(""))
    rows = view(spark, d, "SELECT s_suppkey AS k FROM supplier").select(F.from_json(F.replace(text, F.lit("#"), newer), N.SCHEMA).alias("r"))
    return rows.select("r.*")


def nvd_affected(spark, d):
    return N.affected(nvd_records(spark, d)).select("id", "package_name", "start_including", "start_excluding", "end_including", "end_excluding", "introduced_int", "fixed_int")


def nvd_scores(spark, d):
    got = N.cvss(c("metrics"))
    return nvd_records(spark, d).select("id", got["score"].alias("score"), got["vector"].alias("vector"), got["severity"].alias("severity"), N.english(c("descriptions")).alias("summary"))


def _sources(spark, d):
    m = fx(spark, d, "fx_master").withColumn("modified_at", c("published_at")).withColumn("summary", F.concat(F.lit("s"), c("vuln_no")))
    osv = m.where("vuln_no % 2 = 0").withColumn("source_id", c("osv_id"))
    nvd = m.where("cve_id is not null and vuln_no % 5 = 0").withColumn("source_id", c("cve_id")).withColumn("summary", F.lit(None).cast("string"))
    adv = m.where("vuln_no % 3 = 0").withColumn("source_id", F.concat(F.lit("ADV-"), c("vuln_no"))).withColumn("severity", F.lit("LOW"))
    return [x.select(*R.COLUMNS) for x in (osv, nvd, adv)]


def masters(spark, d):
    return R.resolve(*_sources(spark, d)).select("master_key", "cve_id", "osv_id", "advisory_id", "severity", "summary", "n_records")


def lost_masters(spark, d):
    osv, nvd, adv = _sources(spark, d)
    before = R.resolve(osv.withColumn("cve_id", F.lit(None).cast("string")), nvd, adv)
    return R.orphans(before, R.resolve(osv, nvd, adv)).select("master_key")


# A master has at most one record of a source here, except that one without a CVE id is a master for each source id.
_MASTERS = """WITH b AS (SELECT *, CAST(vuln_no%2 = 0 AS INT) AS o, CAST(vuln_no%5 = 0 AND cve_id IS NOT NULL AS INT) AS n, CAST(vuln_no%3 = 0 AS INT) AS a FROM fx_master),
      r AS (SELECT *, cve_id AS master_key, o + n + a AS k FROM b WHERE cve_id IS NOT NULL AND o + n + a > 0
        UNION ALL SELECT * REPLACE (0 AS a), osv_id, 1 FROM b WHERE cve_id IS NULL AND o = 1
        UNION ALL SELECT * REPLACE (0 AS o), 'ADV-' || vuln_no, 1 FROM b WHERE cve_id IS NULL AND a = 1)"""

#: name → (query, SQL)
QUERIES = {
    "range_join_semver": (range_join, f"SELECT r.request_id, a.row_id, a.vuln_no FROM fx_installed r JOIN fx_affected a ON {_HIT}"),
    "search_dedup": (search_dedup, _SEARCH),
    "search_batch_topk": (search_batch, f"WITH s AS ({_SEARCH}) SELECT request_id, vuln_no, n_rows FROM s QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY vuln_no) <= 500"),
    "search_page": (page_of_results, f"WITH s AS ({_SEARCH}) SELECT request_id, vuln_no FROM s ORDER BY 1, 2 LIMIT 30 OFFSET 20"),
    "range_join_rpm": (_keyed(V.rpm_evr), _KEYED_SQL),
    "range_join_dpkg": (_keyed(V.dpkg_evr), _KEYED_SQL),
    "normalize_version": (normalize, f"SELECT row_id, {_int('introduced_version')} AS lo, {_int('fixed_version')} + 6 AS hi FROM fx_affected"),
    "rpm_compare": (lambda s, d: pairs(s, d, V.rpm_evr), _PAIRS_SQL),
    "dpkg_compare": (lambda s, d: pairs(s, d, V.dpkg_evr), _PAIRS_SQL),
    "dpkg_tilde_order": (dpkg_tilde, "SELECT p_partkey AS id, -1 AS c0, -1 AS c1, -1 AS c2 FROM part"),
    "ecosystem_route": (routes, """SELECT row_id, CASE p WHEN 'npm' THEN 'language' WHEN 'PyPI' THEN 'language' WHEN 'Debian' THEN 'dpkg' WHEN 'Ubuntu' THEN 'dpkg' WHEN 'Red Hat' THEN 'rpm' ELSE 'list' END AS route,
      p AS base, CASE WHEN p = 'Red Hat' THEN 'red-hat' END AS vendor FROM (SELECT row_id, regexp_extract(ecosystem, '^[^:]*') AS p FROM fx_affected)"""),
    "cpe_parse": (cpes, """SELECT s_suppkey AS id, CASE s_suppkey%3 WHEN 1 THEN 'redhat' WHEN 2 THEN 'Node' END AS vendor, CASE WHEN s_suppkey%3 > 0 THEN 'tool' END AS product,
      CASE WHEN s_suppkey%3 > 0 AND s_suppkey%4 > 0 THEN CAST(s_suppkey AS varchar) END AS version, CASE s_suppkey%3 WHEN 1 THEN 'Red Hat' WHEN 2 THEN 'npm' END AS eco FROM supplier"""),
    "stats_by_severity": (stats, "SELECT severity, count(*) AS n, count(*) - count(cve_id) AS without_cve FROM fx_master GROUP BY severity"),
    "count_distinct_ecosystem": (distinct_by_ecosystem, "SELECT split_part(ecosystem, ':', 1) AS base, count(DISTINCT vuln_no) AS n_vulns, count(DISTINCT package_name) AS n_packages FROM fx_affected GROUP BY 1"),
    "latest_job_per_source": (latest_jobs, "SELECT source, job_id, status FROM fx_jobs j WHERE NOT EXISTS (SELECT 1 FROM fx_jobs k WHERE k.source = j.source AND (k.completed_at > j.completed_at OR k.completed_at = j.completed_at AND k.job_id > j.job_id))"),
    "delta_cursor": (cursors, "SELECT source, max(CASE WHEN status = 'completed' THEN completed_at END) AS cursor FROM fx_jobs GROUP BY source"),
    "kev_apply": (kev, "SELECT vuln_no, cve_id, coalesce(cve_id IN (SELECT cve_id FROM fx_kev), false) AS is_kev FROM fx_master"),
    "kev_not_found": (kev_missing, "SELECT cve_id FROM fx_kev WHERE cve_id NOT IN (SELECT cve_id FROM fx_master WHERE cve_id IS NOT NULL)"),
    "epss_apply": (epss, "SELECT m.vuln_no, e.score_milli FROM fx_master m LEFT JOIN fx_epss e ON m.cve_id = e.cve_id"),
    "snapshot_upsert": (snapshot, """SELECT vuln_no, CASE WHEN vuln_no%2 = 0 THEN 'NEW' ELSE severity END AS severity,
      CASE WHEN vuln_no%2 = 1 THEN 'kept' WHEN vuln_no%3 = 0 THEN 'inserted' ELSE 'updated' END AS disposition FROM fx_master WHERE vuln_no%3 <> 0 OR vuln_no%2 = 0"""),
    "prune_three_strikes": (three_strikes, "SELECT vuln_no, CAST(CASE WHEN vuln_no%2 = 0 THEN 0 ELSE vuln_no%3 + 1 END AS INTEGER) AS missing_runs FROM fx_master WHERE vuln_no%2 = 0 OR vuln_no%3 < 2"),
    "sweep_counts": (sweep, """WITH e AS (SELECT DISTINCT package_name, vuln_no FROM fx_affected WHERE row_id%3 <> 0), a AS (SELECT DISTINCT package_name, vuln_no FROM fx_affected WHERE row_id%5 <> 0),
      n AS (SELECT package_name, vuln_no, sum(e) AS e, sum(a) AS a FROM (SELECT *, 1 AS e, 0 AS a FROM e UNION ALL SELECT *, 0, 1 FROM a) GROUP BY 1, 2)
      SELECT package_name, CAST(sum(e * a) AS BIGINT) AS tp, CAST(sum(a - e * a) AS BIGINT) AS fp, CAST(sum(e - e * a) AS BIGINT) AS fn FROM n GROUP BY 1"""),
    "version_bumps": (bumps, """SELECT p_partkey AS request_id, v || CAST(p_partkey%7 + 1 AS varchar) AS up, CASE WHEN p_partkey%7 > 0 THEN v || CAST(p_partkey%7 - 1 AS varchar) END AS down, v || CAST(p_partkey%7 + 1 AS varchar) AS nxt
      FROM (SELECT p_partkey, CAST(p_size%8 AS varchar) || '.' || CAST(p_partkey%25 AS varchar) || '.' AS v FROM part)"""),
    "version_floors": (floors, """SELECT p_partkey AS id, CASE p_partkey%3 WHEN 0 THEN CAST(p_size AS varchar) || '.' || CAST(p_partkey%9 AS varchar) WHEN 1 THEN CAST(p_size AS varchar) || '.0' END AS bare,
      CASE WHEN p_partkey%9 <= p_size THEN CAST(p_partkey%9 AS varchar) || '.0' END AS module FROM part"""),
    "severity_from_score": (score_bands, "SELECT c_custkey AS id, CASE WHEN t >= 90 THEN 'CRITICAL' WHEN t >= 70 THEN 'HIGH' WHEN t >= 40 THEN 'MEDIUM' WHEN t > 0 THEN 'LOW' END AS severity FROM (SELECT c_custkey, c_custkey%101 AS t FROM customer)"),
    "extract_cves": (cves_in_text, "SELECT o_orderkey AS id, 'CVE-2024-' || CAST(1000 + o_orderkey%50 AS varchar) || ',CVE-2023-' || CAST(2000 + o_orderkey%7 AS varchar) AS cves FROM orders"),
    "osv_event_fold": (folds, """WITH x AS (SELECT *, fixed_version IS NOT NULL OR last_affected_version IS NOT NULL AS closed FROM fx_affected)
      SELECT row_id, CAST(0 AS INTEGER) AS pos, introduced_version AS introduced, fixed_version AS fixed, CASE WHEN fixed_version IS NULL THEN last_affected_version END AS last_affected FROM x
      UNION ALL SELECT row_id, CAST(1 AS INTEGER), '99.0.0', NULL, NULL FROM x"""),
    "range_text": (spoken, """SELECT p_partkey AS id, CASE WHEN k IN (0, 3) THEN a END AS lo, CASE WHEN k IN (1, 3) THEN b END AS hi, CASE WHEN k IN (0, 2) THEN b END AS last
      FROM (SELECT p_partkey, p_partkey%4 AS k, CAST(p_size AS varchar) || '.1' AS a, CAST(p_size + 1 AS varchar) || '.0.2' AS b FROM part)"""),
    "alias_names": (alias_names, """SELECT p_partkey AS id, unnest(CASE p_partkey%4 WHEN 0 THEN ['jre', 'jdk'] WHEN 1 THEN ['kubernetes'] WHEN 2 THEN ['httpd', 'http_server'] ELSE [p_name] END) AS product FROM part"""),
    "nvd_affected": (nvd_affected, """WITH s AS (SELECT CAST(s_suppkey AS varchar) AS k, CAST(s_suppkey AS BIGINT) AS n FROM supplier)
      SELECT 'CVE-2024-' || k AS id, 'tool' || k AS package_name, NULL AS start_including, '1.0.0' AS start_excluding, NULL AS end_including, '2.' || k || '.0' AS end_excluding, 1000000000 AS introduced_int, 2000000000 + n * 1000000 AS fixed_int FROM s
      UNION ALL SELECT 'CVE-2024-' || k, 'point', '3.' || k || '.1', NULL, '3.' || k || '.1', NULL, 3000001000 + n * 1000000, NULL FROM s
      UNION ALL SELECT 'CVE-2024-' || k, 'kit', '1.5.0_' || k, NULL, '1.5.0_' || k, NULL, 1005000000 + n * 1000, NULL FROM s"""),
    "nvd_scores": (nvd_scores, """SELECT 'CVE-2024-' || CAST(s_suppkey AS varchar) AS id, CAST(CASE s_suppkey%2 WHEN 0 THEN 9.1 ELSE 5.0 END AS DOUBLE) AS score, CASE s_suppkey%2 WHEN 0 THEN 'v31' ELSE 'v2' END AS vector,
      CASE s_suppkey%2 WHEN 0 THEN 'CRITICAL' ELSE 'MEDIUM' END AS severity, 'about ' || CAST(s_suppkey AS varchar) AS summary FROM supplier"""),
    "master_resolve": (masters, f"""{_MASTERS} SELECT master_key, max(cve_id) AS cve_id, max(CASE WHEN o = 1 THEN osv_id END) AS osv_id, max(CASE WHEN a = 1 AND cve_id IS NULL THEN 'ADV-' || vuln_no END) AS advisory_id,
      max(CASE WHEN n = 1 OR o = 1 AND severity IS NOT NULL THEN severity WHEN a = 1 THEN 'LOW' END) AS severity, max(CASE WHEN n = 0 THEN 's' || vuln_no END) AS summary, CAST(sum(k) AS BIGINT) AS n_records FROM r GROUP BY 1"""),
    "master_orphans": (lost_masters, "SELECT osv_id AS master_key FROM fx_master WHERE vuln_no%2 = 0 AND cve_id IS NOT NULL"),
    "boundary_points": (boundary_points, f"""SELECT package_name, point, count(*) AS n FROM (SELECT package_name, {_F} || CAST({_Z} + d AS varchar) AS point
      FROM fx_affected, (VALUES (-1), (0), (1)) t(d) WHERE fixed_version IS NOT NULL AND {_Z} + d >= 0) GROUP BY 1, 2"""),
}


def _all() -> dict:
    from .documents import QUERIES as documents
    from .landed import QUERIES as landed
    from .more import QUERIES as more
    from .sweeps import QUERIES as sweeps

    return QUERIES | more | documents | landed | sweeps


def queries() -> dict:
    return {name: q for name, (q, _) in _all().items()}


def oracle_sql() -> dict:
    return {name: with_fixtures(sql) if "fx_" in sql else sql for name, (_, sql) in _all().items()}
