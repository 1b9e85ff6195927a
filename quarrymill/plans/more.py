"""Queries over searches, pages and record keeping, and the same results stated otherwise in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pages as G
from ..operators import master as M
from ..operators import records as R
from ..operators import search as S
from ..sources import feeds
from .queries import view

c = F.col

# Rows with numbers beside the texts, so that SQL can compare numbers where Spark compares texts.
REQUESTS = """SELECT p_partkey AS request_id, 'pkg' || CAST(p_partkey%200 AS varchar(10)) AS package_name,
  CASE p_partkey%7 WHEN 0 THEN 'npm' WHEN 2 THEN 'Debian:12' WHEN 3 THEN 'Red Hat:9' WHEN 4 THEN 'AlmaLinux:9' WHEN 5 THEN 'oracle-linux' WHEN 6 THEN 'other' END AS ecosystem,
  CASE WHEN p_partkey%11=0 THEN NULL WHEN p_partkey%13=0 THEN '1234567.0' ELSE
    CAST(p_size%8 AS varchar(10)) || '.' || CAST(p_partkey%25 AS varchar(10)) || '.' || CAST(p_partkey%7 AS varchar(10)) END AS version,
  CASE WHEN p_partkey%11=0 OR p_partkey%13=0 THEN NULL ELSE (p_size%8)*1000000 + (p_partkey%25)*1000 + p_partkey%7 END AS n FROM part"""
OSV = """SELECT 'OSV-' || CAST(o_orderkey AS varchar(10)) AS own_id, 'pkg' || CAST(o_custkey%200 AS varchar(10)) AS package_name,
  CASE o_orderkey%5 WHEN 0 THEN 'versions' ELSE 'SEMVER' END AS kind, CASE o_custkey%4 WHEN 0 THEN 'npm' WHEN 1 THEN 'Debian:12' WHEN 2 THEN 'AlmaLinux:9' ELSE 'Hex' END AS ecosystem,
  CASE WHEN o_orderkey%9=0 THEN NULL ELSE CAST(o_orderkey%1000 AS bigint) END AS master_no, CAST(o_orderkey%6 AS varchar(10)) || '.0.0' AS introduced_version, (o_orderkey%6)*1000000 AS lo,
  CASE WHEN o_orderkey%7=0 THEN NULL ELSE CAST(o_orderkey%6+2 AS varchar(10)) || '.' || CAST(o_orderkey%10 AS varchar(10)) || '.0' END AS fixed_version,
  CASE WHEN o_orderkey%7=0 THEN NULL ELSE (o_orderkey%6+2)*1000000 + (o_orderkey%10)*1000 END AS hi, CAST(NULL AS varchar(10)) AS last_affected_version,
  CAST(o_orderkey%8 AS varchar(10)) || '.' || CAST(o_custkey%25 AS varchar(10)) || '.' || CAST(o_custkey%7 AS varchar(10)) AS listed,
  CASE o_orderkey%3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'LOW' END AS severity, CAST(o_orderkey%10 AS double) AS score, 'about ' || CAST(o_orderkey AS varchar(10)) AS summary FROM orders"""
NVD = """SELECT 'N-' || CAST(c_custkey AS varchar(10)) AS own_id, c_custkey AS row_id, 'acme' AS vendor, 'pkg' || CAST(c_custkey%200 AS varchar(10)) AS package_name, CAST(NULL AS varchar(10)) AS ecosystem,
  CAST(c_custkey%1000 AS bigint) AS master_no, CAST(NULL AS varchar(10)) AS fixed_version, (c_custkey%5)*1000000 AS lo, (c_custkey%5+1)*1000000 AS hi, CASE c_custkey%3 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'LOW' END AS severity, CAST(c_custkey%10 AS double) AS score, 'about ' || CAST(c_custkey AS varchar(10)) AS summary FROM customer"""
ADVISORY = """SELECT 'ADV-' || CAST(c_custkey AS varchar(10)) AS own_id, 'pkg' || CAST(c_custkey%200 AS varchar(10)) AS package_name,
  CASE c_custkey%3 WHEN 0 THEN 'red-hat' WHEN 1 THEN 'oracle-linux' ELSE 'pan' END AS vendor, CASE WHEN c_custkey%17=0 THEN NULL ELSE CAST((c_custkey*3)%1000 AS bigint) END AS master_no,
  CASE WHEN c_custkey%6=0 THEN NULL ELSE CAST(c_custkey%4 AS varchar(10)) || '.0.0' END AS version_start, CASE WHEN c_custkey%6=0 THEN NULL ELSE (c_custkey%4)*1000000 END AS lo,
  CAST(c_custkey%4+2 AS varchar(10)) || '.0.1' || CASE WHEN c_custkey%5=0 THEN '.module+el9' ELSE '' END AS version_end, (c_custkey%4+2)*1000000+1 AS hi, c_custkey%5=0 AS modular,
  CAST(c_custkey%8 AS varchar(10)) || '.' || CAST(c_custkey%25 AS varchar(10)) || '.' || CAST(c_custkey%7 AS varchar(10)) AS listed, CASE c_custkey%3 WHEN 0 THEN 'MEDIUM' WHEN 1 THEN 'LOW' END AS severity, CAST(c_custkey%10 AS double) AS score, 'about ' || CAST(c_custkey AS varchar(10)) AS summary FROM customer"""
MASTERS = """SELECT CAST(p_partkey AS bigint) AS master_no, CASE WHEN p_partkey%3<>0 THEN 'CVE-2024-' || CAST(p_partkey AS varchar(10)) END AS cve_id,
  CASE WHEN p_partkey%2=0 THEN 'OSV-' || CAST(p_partkey AS varchar(10)) END AS osv_id, CASE WHEN p_partkey%5=0 THEN 'ADV-' || CAST(p_partkey AS varchar(10)) END AS advisory_id,
  CASE p_size%3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'LOW' END AS severity, CASE WHEN p_partkey%4<>0 THEN CAST(p_partkey%90 AS double)/10 END AS score, 'CVSS:3.1/' || CAST(p_partkey AS varchar(10)) AS vector,
  'master ' || CAST(p_partkey AS varchar(10)) AS summary, p_partkey%8=0 AS is_kev, CASE WHEN p_partkey%3=0 THEN CAST(p_partkey%100 AS double)/100 END AS epss FROM part"""


def _whole(n):
    """The integer form of a version whose numbers make up n."""
    return (F.col(n) * 1000).cast("bigint")


def _found(spark, d):
    osv = view(spark, d, OSV).withColumns({"introduced_int": _whole("lo"), "fixed_int": _whole("hi"), "last_affected_int": F.lit(None).cast("bigint"), "versions": F.array("listed")})
    nvd = view(spark, d, NVD).withColumns({"introduced_int": _whole("lo"), "fixed_int": _whole("hi"), "last_affected_int": F.lit(None).cast("bigint")})
    adv = view(spark, d, ADVISORY).withColumns({"version_start_int": _whole("lo"), "version_end_int": _whole("hi"), "last_affected_int": F.lit(None).cast("bigint"), "versions": F.array("listed"), "fixed_version": c("version_end")})
    asked, members = S.questions(view(spark, d, REQUESTS).drop("n"))
    return S.search_questions(asked, osv, nvd, adv, view(spark, d, MASTERS)), members


def search_all(spark, d):
    found, members = _found(spark, d)
    shown = found.select(
        "request_id", "id", "external_id", "source", F.array_join("sources", ",").alias("sources"), F.array_join(F.array_sort("aliases"), ",").alias("aliases"), "fixed_version", "approximate", *_TOLD
    )
    return S.answered(shown, members)


_TOLD = ("severity", "score", "vector", "summary", "is_kev", "epss")


def single(spark, d):
    """The second page of ten results of each request."""
    found, members = _found(spark, d)
    return S.answered(S.paged(found, 10, 10).select("request_id", "id", "external_id", *_TOLD, c("nth").cast("long").alias("nth")), members)


def batch(spark, d):
    """At most 500 results of each package, in one list each."""
    found, members = _found(spark, d)
    lists = S.paged(found, 500).groupBy("request_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "external_id"))), lambda x: x["external_id"]), ",").alias("ids"))
    return S.answered(lists, members)


def search_by_source(spark, d):
    found, members = _found(spark, d)
    return S.answered(S.found_by(found, "advisory").groupBy("request_id").agg(F.count(F.lit(1)).alias("n_ids"), F.min("external_id").alias("least")), members)


_SEARCH = f"""WITH r AS (SELECT *, coalesce(ecosystem IN ('Debian:12', 'Red Hat:9', 'AlmaLinux:9', 'oracle-linux'), false) AS distro FROM ({REQUESTS})), o AS ({OSV}), n AS ({NVD}), a AS ({ADVISORY}), m AS ({MASTERS}),
  hits AS (
    SELECT request_id, 1 AS rank, 'osv' AS source, master_no, own_id, fixed_version, NOT distro AND r.n IS NULL AS approximate, severity, score, summary FROM r JOIN o ON r.package_name = o.package_name
      AND CASE WHEN r.ecosystem IS NULL THEN o.ecosystem IN ('npm', 'Hex') ELSE r.ecosystem = o.ecosystem END
      AND CASE WHEN version IS NULL THEN true WHEN r.ecosystem = 'Debian:12' THEN listed = version OR CASE WHEN r.n IS NULL THEN hi IS NULL ELSE lo <= r.n AND (hi IS NULL OR r.n < hi) END
        WHEN distro THEN listed = version WHEN r.n IS NULL THEN true WHEN kind = 'versions' THEN listed = version ELSE lo <= r.n AND (hi IS NULL OR r.n < hi) END
    UNION ALL SELECT request_id, 2, 'nvd', master_no, own_id, fixed_version, r.n IS NULL, severity, score, summary FROM r JOIN n ON r.package_name = n.package_name AND r.ecosystem IS NULL AND (r.n IS NULL OR lo <= r.n AND r.n < hi)
    UNION ALL SELECT request_id, 3, 'advisory', master_no, own_id, version_end, NOT distro AND version IS NOT NULL AND r.n IS NULL, severity, score, summary FROM r JOIN a ON r.package_name = a.package_name AND (
      r.ecosystem IN ('Red Hat:9', 'oracle-linux') AND vendor = CASE r.ecosystem WHEN 'Red Hat:9' THEN 'red-hat' ELSE 'oracle-linux' END
        AND (version IS NULL OR r.n IS NOT NULL AND (lo IS NULL OR lo <= r.n) AND (r.n < hi OR modular AND r.n = hi))
      OR (r.ecosystem IS NULL OR r.ecosystem = 'other') AND NOT modular AND (version IS NULL OR listed = version OR r.n IS NOT NULL AND (lo IS NULL OR lo <= r.n) AND r.n < hi))),
  found AS (SELECT request_id, coalesce('m' || CAST(master_no AS varchar), own_id) AS id, max(master_no) AS master_no, list(DISTINCT own_id) AS owns, string_agg(DISTINCT source, ',' ORDER BY source DESC) AS by_name,
      min(rank) AS rank, first(source ORDER BY rank, own_id) AS one, first(own_id ORDER BY rank, own_id) AS own, first(severity ORDER BY rank, own_id) AS own_severity, first(score ORDER BY rank, own_id) AS own_score, first(summary ORDER BY rank, own_id) AS own_summary, first(approximate ORDER BY rank, own_id) AS approximate, first(fixed_version ORDER BY rank, own_id) FILTER (WHERE fixed_version <> '') AS fixed_version FROM hits GROUP BY 1, 2),
  res AS (SELECT request_id, id, coalesce(cve_id, osv_id, advisory_id, own) AS external_id, CASE WHEN cve_id IS NOT NULL THEN 'nvd' WHEN osv_id IS NOT NULL THEN 'osv' ELSE one END AS source,
      concat_ws(',', CASE WHEN contains(by_name, 'osv') THEN 'osv' END, CASE WHEN contains(by_name, 'nvd') THEN 'nvd' END, CASE WHEN contains(by_name, 'advisory') THEN 'advisory' END) AS sources,
      array_to_string(list_sort(list_distinct(list_filter(list_concat(owns, [cve_id, osv_id, advisory_id]), lambda x: x IS NOT NULL))), ',') AS aliases, fixed_version, approximate,
      CASE WHEN vector IS NULL THEN own_severity ELSE severity END AS severity, CASE WHEN vector IS NULL THEN own_score ELSE score END AS score, vector, CASE WHEN vector IS NULL THEN own_summary ELSE summary END AS summary,
      coalesce(is_kev, false) AS is_kev, epss, row_number() OVER (PARTITION BY request_id ORDER BY rank, own, id) AS nth FROM found LEFT JOIN m USING (master_no))"""


def cpe_page(spark, d):
    names = view(spark, d, REQUESTS).select(
        "request_id", F.concat(F.lit("cpe:2.3:a:acme:"), c("package_name"), F.lit(":"), F.coalesce("version", F.lit("*")), F.lit(":*:*:*:*:*:*:*")).alias("cpe")
    )
    nvd = view(spark, d, NVD).withColumns({"introduced_int": _whole("lo"), "fixed_int": _whole("hi"), "last_affected_int": F.lit(None).cast("bigint")})
    return S.search_cpe(names, nvd, limit=3, offset=1)


def detail(spark, d):
    asked = view(spark, d, "SELECT CASE p_partkey%4 WHEN 0 THEN 'CVE-2024-' || CAST(p_partkey AS varchar(10)) WHEN 1 THEN 'ADV-' || CAST(p_partkey AS varchar(10)) WHEN 2 THEN 'OSV-' || CAST(p_partkey AS varchar(10)) ELSE 'no-' || CAST(p_partkey AS varchar(10)) END AS ident FROM part")
    adv, osv = (view(spark, d, x).select(c("own_id").alias("external_id"), "master_no") for x in (ADVISORY, OSV))
    return S.lookup(asked, view(spark, d, MASTERS), adv, osv)


_CHILDREN = "SELECT CAST(l_orderkey AS bigint) AS vuln, l_linenumber AS nth, 'old' AS state FROM lineitem"


def children(spark, d):
    old = view(spark, d, _CHILDREN)
    touched = view(spark, d, "SELECT CAST(o_orderkey AS bigint) AS vuln FROM orders").where("vuln % 3 = 0")
    new = touched.where("vuln % 2 = 0").select("vuln", F.lit(1).alias("nth"), F.lit("new").alias("state"))
    return R.replace_children(old, new, touched, "vuln")


def cascade(spark, d):
    parents = view(spark, d, "SELECT CAST(o_orderkey AS bigint) AS vuln FROM orders")
    kept = R.without(parents, parents.where("vuln % 5 = 0"), "vuln", view(spark, d, _CHILDREN))
    return kept[0].join(kept[1].groupBy("vuln").agg(F.count(F.lit(1)).alias("n")), "vuln", "full")


def defaults(spark, d):
    known = view(spark, d, "SELECT 'job-' || CAST(s_suppkey AS varchar(10)) AS source, false AS enabled FROM supplier")
    return R.with_defaults(known.where("CAST(substring(source, 5) AS int) % 3 = 0").withColumn("enabled", F.lit(True)), known, "source")


def json_rows(spark, d):
    return R.as_json(view(spark, d, "SELECT CAST(s_suppkey AS bigint) AS id, CASE WHEN s_suppkey%2=0 THEN s_nationkey END AS nation, s_name AS name FROM supplier"))


def kth(spark, d):
    return R.every_kth(view(spark, d, "SELECT l_partkey AS product, l_orderkey*10+l_linenumber AS point FROM lineitem"), "product", "point", 5)


def affects(spark, d):
    p = view(spark, d, """SELECT p_partkey AS id, CASE p_partkey%6 WHEN 0 THEN CAST(p_size AS varchar(10)) || '.0.1 – ' || CAST(p_size AS varchar(10)) || '.0.9' WHEN 1 THEN CAST(p_size AS varchar(10)) || '.4.4-' || CAST(p_size AS varchar(10)) || '.4.*'
      WHEN 2 THEN CAST(p_size AS varchar(10)) || '.0' WHEN 3 THEN '-' WHEN 4 THEN 'MSI pkg. (29.oct.22 - 2.dec.22)' ELSE ' ' || CAST(p_size AS varchar(10)) || '.1-' || CAST(p_size AS varchar(10)) || '.2 ' END AS t FROM part""")
    got = G.affects_entry(c("t"))
    return p.select("id", got["start"].alias("lo"), got["end"].alias("hi"), got["last"].alias("last"), got["exact"].alias("exact"))


def named(spark, d):
    p = view(spark, d, """SELECT p_partkey AS id, CASE p_partkey%5 WHEN 0 THEN 'Acme Cloud >=' || CAST(p_size AS varchar(10)) || '.6.0|<=' || CAST(p_size AS varchar(10)) || '.6.4' WHEN 1 THEN 'Acme ' || CAST(p_size AS varchar(10)) || '.2 all versions'
      WHEN 2 THEN 'Acme Cloud-' || CAST(p_size AS varchar(10)) || '.1.2' WHEN 3 THEN 'Other 1.2' ELSE 'Acme/' || CAST(p_size AS varchar(10)) || '.0.3' END AS t FROM part""")
    name = G.longest_name(c("t"), F.array(F.lit("Acme"), F.lit("Acme Cloud"), F.lit("Else")))
    got = G.named_versions(c("t"), name)
    fixed = F.array(*(F.concat(F.regexp_extract("t", r"(\d+)", 1), F.lit(x)) for x in (".6.2", ".6.10", ".2.7", ".9.1")))
    return p.select("id", name.alias("product"), got["start"].alias("lo"), got["end"].alias("hi"), got["last"].alias("last"), got["exact"].alias("exact"), G.fixed_in_branch(got["start"], fixed).alias("fix"))


def comparisons(spark, d):
    p = view(spark, d, "SELECT p_partkey AS id, CASE p_partkey%4 WHEN 0 THEN '< ' WHEN 1 THEN '<= ' WHEN 2 THEN '>=' ELSE 'about ' END || CAST(p_size AS varchar(10)) || '.1' AS t FROM part")
    got, tail = G.comparison(c("t")), G.trailing_comparison(F.concat(F.lit("PAN-OS "), c("t")))
    return p.select("id", got["end"].alias("hi"), got["last"].alias("last"), got["fixed"].alias("fixed"), tail["op"].alias("op"), tail["version"].alias("version"), G.next_minor(F.regexp_extract("t", r"([\d.]+)", 1)).alias("nxt"))


def table_rows(spark, d):
    p = view(spark, d, "SELECT p_partkey AS id, p_partkey%3 AS k, CAST(p_size AS varchar(10)) AS x FROM part")
    row = F.concat(
        F.lit('<tr><td class="a" label="Affected Product">Acme Server '), c("x"), F.lit(".2<br/>Acme &amp; Co<br>"), F.when(c("k") == 0, "Third").otherwise(""), F.lit('</td><td label="Fixed Versions"><b>'), c("x"),
        F.lit(".2.5</b><br />2.0</td>\n<td label='none'>z</td><td label=\"Affected Versions\">Below "), c("x"), F.lit(".2.5<br/>"), F.when(c("k") == 1, "Not affected").otherwise("1.0 to 1.9"), F.lit("</td></tr>"),
    )
    rows = p.select("id", F.posexplode(G.branch_rows(row)).alias("pos", "r"))
    return rows.select("id", "pos", c("r.product").alias("product"), c("r.range.start").alias("lo"), c("r.range.end").alias("hi"), c("r.range.last").alias("last"), c("r.fixed").alias("fixed"))


def headings(spark, d):
    """Entries of a page under the heading nearest before them, grouped by id."""
    p = view(spark, d, "SELECT s_suppkey AS id, CAST(s_suppkey%9 AS varchar(10)) AS x FROM supplier")
    html = F.concat(
        F.lit("<p>CVE-2024-1 low</p><h3>Fixed in "), c("x"), F.lit(".0.2</h3><p>CVE-2024-2 unknown</p><p>CVE-2024-3 high</p><h3>Fixed in "), c("x"), F.lit(".0.1</h3><p>CVE-2024-2 moderate</p>")
    )
    blocks = p.select("id", F.posexplode(G.headed(html, "<h3>")).alias("block", "b")).withColumn("fixed", F.nullif(F.regexp_extract("b", "Fixed in ([0-9.]+)", 1), F.lit("")))
    hit = r"<p>(CVE-\d{4}-\d+ \w+)</p>"
    entries = blocks.select("id", "fixed", "block", F.posexplode(F.regexp_extract_all("b", F.lit(hit), 1)).alias("nth", "e"))
    entries = entries.select("id", "fixed", (c("block") * 100 + c("nth")).alias("pos"), F.split_part("e", F.lit(" "), F.lit(1)).alias("cve"), F.split_part("e", F.lit(" "), F.lit(2)).alias("word"))
    keyed = entries.withColumn("key", F.concat_ws("/", "id", "cve"))
    first = keyed.groupBy("key").agg(R.first_known("word", "pos").alias("word"))
    lists = R.grouped(keyed, "key", "pos", "fixed").select("key", F.array_join(F.transform("entries", lambda e: F.coalesce(e["fixed"], F.lit("none"))), ",").alias("fixed"))
    return lists.join(first, "key")


def page_fields(spark, d):
    p = view(spark, d, "SELECT s_suppkey AS id, CAST(s_suppkey AS varchar(10)) AS x, s_suppkey%2 AS k FROM supplier")
    t = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    score = G.score_and_vector(t(F.when(c("k") == 0, "7.5").otherwise("n"), "/CVSS:3.1/AV:", c("x")))
    return p.select(
        "id",
        G.strip_tags(t("<b>A&nbsp;", c("x"), "</b><br/>&lt;i&gt;  &quot;z&quot; ")).alias("plain"),
        F.array_join(G.html_versions(t("<p>", c("x"), ".1.2</p>&nbsp;", c("x"), ".1.2 and 7.0.1.", c("x"), " or 1.2")), ",").alias("versions"),
        G.known_severity(F.when(c("k") == 0, "High").otherwise("Severe")).alias("severity"),
        score["score"].alias("score"), score["vector"].alias("vector"),
        G.module_label(t("Module nodejs:", c("x"), F.when(c("k") == 0, " is enabled").otherwise(" is disabled"))).alias("module"),
        G.advisory_number(t("vmsa-2024-", c("x"), ": a product")).alias("advisory"),
        F.array_join(G.listed_products(t("Tool ", c("x"), ", ab, Kit, Cut sh...")), "|").alias("products"),
        G.page_address(t("https://acme.test/de-de/security-advisories/", c("x"))).alias("address"),
        G.per_cve(t("ADV-", c("x")), F.when(c("k") == 0, t("CVE-2024-", c("x")))).alias("part_id"),
        G.mend_comments(t('<c comment="a ', c("x"), '\n<d/>')).alias("mended"),
        G.fix_after(t("1.", c("x"), ".3"), G.not_vulnerable(t("1.", c("x"), ".4+, 2.0.1+, none"))).alias("fix"),
    )


def time_labels(spark, d):
    p = view(spark, d, "SELECT p_partkey AS id, CAST(p_partkey AS bigint) * 977 AS ms FROM part")
    now = F.lit("2024-06-01 00:00:00").cast("timestamp")
    then = F.when(c("id") % 10 > 0, F.timestamp_millis(F.unix_millis(now) - c("ms") * 100))
    return p.select("id", G.duration(F.when(c("id") % 10 > 0, c("ms"))).alias("took"), G.time_ago(then, now).alias("ago"))


def max_score(spark, d):
    rows = view(spark, d, "SELECT l_orderkey AS advisory, l_linenumber*1000000+l_partkey AS pos, CAST(l_quantity AS int)%11 AS score, 'v' || CAST(l_partkey AS varchar(10)) AS vector FROM lineitem")
    return R.highest(rows, "advisory", "pos", "score", "vector")


def import_counters(spark, d):
    return R.counters(view(spark, d, "SELECT CASE o_orderkey%4 WHEN 0 THEN 'inserted' WHEN 1 THEN 'failed' WHEN 2 THEN 'skipped' ELSE 'updated' END AS outcome FROM orders"), "inserted", "updated", "failed", "skipped")


def source_coverage(spark, d):
    found = view(spark, d, "SELECT c_mktsegment AS source, count(*) AS found FROM customer WHERE c_custkey%9<>0 AND c_mktsegment<>'BUILDING' GROUP BY c_mktsegment")
    return R.coverage(view(spark, d, "SELECT c_mktsegment AS source, count(*) AS expected FROM customer GROUP BY c_mktsegment"), found, "source", 0.89).select("source", "expected", "found", "short")


def source_map(spark, d):
    n = view(spark, d, "SELECT c_mktsegment AS source FROM customer").groupBy("source").count()
    return n.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "count"))))).alias("by_source"))


def preferred(spark, d):
    rows = view(spark, d, "SELECT p_partkey AS id, 'csaf' AS form FROM part")
    return R.prefer(rows.where("id % 2 = 0"), rows.where("id % 3 = 0").withColumn("form", F.lit("cvrf")), key="id")


def _advisories(spark, d):
    p = view(spark, d, "SELECT s_suppkey AS n, CAST(s_suppkey AS varchar(10)) AS x, CAST(s_suppkey%500 AS varchar(10)) AS y FROM supplier")
    t = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    some = lambda test, *parts: F.when(test, t(*parts)).otherwise("")
    fix = t('<criterion comment="nodejs is earlier than 1:20.', c("y"), '.0"/>')
    text = t(
        '<definition id="oval:com.redhat.rhsa:def:2024', c("x"), '" class="patch"><metadata><title>Fix ', c("x"), '</title><reference source="CVE" ref_id="none"/>',
        some(c("n") % 2 == 0, '<reference source="RHSA" ref_id="RHSA-2024:9', c("x"), '" ref_url="https://acme.test/', c("x"), '"/>'),
        "<advisory><severity>", F.when(c("n") % 4 == 0, "Important").otherwise("Odd"), "</severity>", some(c("n") % 3 != 0, '<cve cvss3="7.5/CVSS:3.1/AV:', c("x"), '">CVE-2024-', c("x"), "</cve>"),
        some(c("n") % 3 == 2, "<cve>CVE-2023-", c("x"), "</cve><cve>other</cve>"), '</advisory></metadata><criteria><criterion comment="Module nodejs:18 is enabled"/>',
        some(c("n") % 5 != 0, '<criteria><criterion comment="curl is earlier than ', c("y"), '.1"/></criteria>', fix, fix), "</criteria>",
    )
    return feeds.oval_advisories(p.select(t("oval:com.redhat.rhsa:def:2024", c("x")).alias("id"), text.alias("text")), "red-hat")


def oval_rows(spark, d):
    return _advisories(spark, d).withColumn("products", F.array_join(F.transform("products", lambda p: p["product"]), ","))


def oval_ranges(spark, d):
    return feeds.advisory_ranges(_advisories(spark, d)).select("external_id", "vendor", "product", "version_start", "version_end", "version_start_int", "version_end_int")


_ADVISORIES = """d AS (SELECT s_suppkey AS n, CAST(s_suppkey AS varchar) AS x, s_suppkey%500 AS y FROM supplier WHERE s_suppkey%5 <> 0),
  v AS (SELECT n, NULL AS cve_id, NULL AS score, NULL AS vector FROM d WHERE n%3 = 0 UNION ALL SELECT n, 'CVE-2024-' || x, 7.5, 'CVSS:3.1/AV:' || x FROM d WHERE n%3 <> 0 UNION ALL SELECT n, 'CVE-2023-' || x, NULL, NULL FROM d WHERE n%3 = 2),
  o AS (SELECT *, CASE n%2 WHEN 0 THEN 'RHSA-2024:9' ELSE 'RHSA-2024:' END || x || coalesce('/' || cve_id, '') AS external_id FROM d JOIN v USING (n))"""


def _by_vuln(spark, d):
    rows = view(spark, d, "SELECT l_partkey AS product, l_orderkey AS vuln, l_linenumber AS k FROM lineitem")
    return M.evaluate(rows.where("k % 3 <> 0"), rows.where("k % 4 <> 0"), "product", "vuln")


def sweep_totals(spark, d):
    return M.totals(_by_vuln(spark, d)).select("versions", "tp", "fp", "fn", "passed", "failed", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round("f1", 6).alias("f1"))


def cve_split(spark, d):
    named = view(spark, d, "SELECT CASE o_orderkey%3 WHEN 0 THEN 'cve-2024-' WHEN 1 THEN 'ADV-' END || CAST(o_orderkey AS varchar(10)) AS external_id FROM orders")
    cves, others = M.split_cves(named)
    return cves.agg(F.count(F.lit(1)).alias("cves")).crossJoin(others.agg(F.count(F.lit(1)).alias("others")))


_X = "CAST(p_size AS varchar)"
_MS = "p_partkey * 977"

#: name → (query, SQL)
QUERIES = {
    "search_all": (search_all, f"{_SEARCH} SELECT * EXCLUDE (nth) FROM res"),
    "search_single": (single, f"{_SEARCH} SELECT request_id, id, external_id, severity, score, vector, summary, is_kev, epss, nth FROM res WHERE nth BETWEEN 11 AND 20"),
    "search_batch": (batch, f"{_SEARCH} SELECT request_id, count(*) AS n, string_agg(external_id, ',' ORDER BY nth) AS ids FROM res WHERE nth <= 500 GROUP BY 1"),
    "search_by_source": (search_by_source, f"{_SEARCH} SELECT request_id, count(DISTINCT upper(external_id)) AS n_ids, min(upper(external_id)) AS least FROM res WHERE contains(sources, 'advisory') GROUP BY 1"),
    "cpe_search_paged": (cpe_page, f"""WITH h AS (SELECT request_id, own_id, row_id, row_number() OVER (PARTITION BY request_id ORDER BY own_id, row_id) AS k FROM ({REQUESTS}) r JOIN ({NVD}) n ON r.package_name = n.package_name
      WHERE (r.n IS NULL OR lo <= r.n AND r.n < hi)) SELECT request_id, own_id, row_id FROM h WHERE k BETWEEN 2 AND 4"""),
    "detail_lookup": (detail, f"""WITH m AS ({MASTERS}), q AS (SELECT p_partkey AS k, CASE p_partkey%4 WHEN 0 THEN 'CVE-2024-' WHEN 1 THEN 'ADV-' WHEN 2 THEN 'OSV-' ELSE 'no-' END || CAST(p_partkey AS varchar) AS ident FROM part),
      w AS (SELECT ident, (SELECT min(master_no) FROM m WHERE ident IN (cve_id, osv_id, advisory_id)) AS a, (SELECT min(master_no) FROM ({ADVISORY}) x WHERE own_id = ident) AS b, (SELECT min(master_no) FROM ({OSV}) y WHERE own_id = ident) AS o FROM q)
      SELECT ident, coalesce(a, b, o) AS master_no, CAST(CASE WHEN a IS NOT NULL THEN 1 WHEN b IS NOT NULL THEN 2 WHEN o IS NOT NULL THEN 3 END AS INTEGER) AS way FROM w"""),
    "replace_children": (children, f"SELECT vuln, nth, state FROM ({_CHILDREN}) WHERE vuln%3 <> 0 UNION ALL SELECT o_orderkey, 1, 'new' FROM orders WHERE o_orderkey%6 = 0"),
    "cascade_delete": (cascade, "SELECT CAST(o_orderkey AS bigint) AS vuln, n FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_orderkey%5 <> 0"),
    "config_defaults": (defaults, "SELECT 'job-' || CAST(s_suppkey AS varchar) AS source, s_suppkey%3 = 0 AS enabled FROM supplier"),
    "json_rows": (json_rows, """SELECT '{"id":"' || s_suppkey || '","nation":' || CASE WHEN s_suppkey%2 = 0 THEN CAST(s_nationkey AS varchar) ELSE 'null' END || ',"name":"' || s_name || '"}' AS json FROM supplier"""),
    "sample_every_kth": (kth, """SELECT product, point FROM (SELECT l_partkey AS product, l_orderkey*10+l_linenumber AS point, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey*10+l_linenumber) - 1 AS i, count(*) OVER (PARTITION BY l_partkey) AS n FROM lineitem)
      WHERE i % ((n + 4) // 5) = 0"""),
    "affects_entries": (affects, f"""SELECT p_partkey AS id, CASE p_partkey%6 WHEN 0 THEN {_X} || '.0.1' WHEN 1 THEN {_X} || '.4.4' WHEN 5 THEN {_X} || '.1' END AS lo, CASE p_partkey%6 WHEN 1 THEN {_X} || '.5.0' END AS hi,
      CASE p_partkey%6 WHEN 0 THEN {_X} || '.0.9' WHEN 5 THEN {_X} || '.2' END AS last, CASE p_partkey%6 WHEN 2 THEN {_X} || '.0' END AS exact FROM part"""),
    "longest_prefix_product": (named, f"""SELECT p_partkey AS id, CASE WHEN k IN (0, 2) THEN 'Acme Cloud' WHEN k IN (1, 4) THEN 'Acme' END AS product, CASE k WHEN 0 THEN x || '.6.0' WHEN 1 THEN x || '.2.0' END AS lo, CASE k WHEN 1 THEN x || '.3.0' END AS hi,
      CASE k WHEN 0 THEN x || '.6.4' END AS last, CASE k WHEN 2 THEN x || '.1.2' WHEN 4 THEN x || '.0.3' END AS exact, CASE k WHEN 0 THEN x || '.6.10' WHEN 1 THEN x || '.2.7' END AS fix FROM (SELECT p_partkey, p_partkey%5 AS k, {_X} AS x FROM part)"""),
    "version_comparisons": (comparisons, f"""SELECT p_partkey AS id, CASE k WHEN 0 THEN v END AS hi, CASE k WHEN 1 THEN v END AS last, CASE k WHEN 2 THEN v END AS fixed, CASE k WHEN 2 THEN '>=' END AS op, CASE k WHEN 2 THEN v END AS version, x || '.2' AS nxt
      FROM (SELECT p_partkey, p_partkey%4 AS k, {_X} AS x, {_X} || '.1' AS v FROM part)"""),
    "table_rows": (table_rows, f"""SELECT p_partkey AS id, CAST(0 AS INTEGER) AS pos, 'Acme Server' AS product, NULL AS lo, {_X} || '.2.5' AS hi, NULL AS last, {_X} || '.2.5' AS fixed FROM part
      UNION ALL SELECT p_partkey, 1, 'Acme & Co', CASE WHEN p_partkey%3 <> 1 THEN '1.0' END, NULL, CASE WHEN p_partkey%3 <> 1 THEN '1.9' END, CASE WHEN p_partkey%3 <> 1 THEN '2.0' END FROM part"""),
    "nearest_heading": (headings, """SELECT CAST(s_suppkey AS varchar) || '/CVE-2024-' || k AS key, CASE k WHEN 1 THEN 'none' WHEN 2 THEN x || '.0.2,' || x || '.0.1' ELSE x || '.0.2' END AS fixed, CASE k WHEN 1 THEN 'low' WHEN 2 THEN 'moderate' ELSE 'high' END AS word
      FROM (SELECT s_suppkey, CAST(s_suppkey%9 AS varchar) AS x FROM supplier), (VALUES (1), (2), (3)) t(k)"""),
    "page_fields": (page_fields, """SELECT s_suppkey AS id, 'A ' || x || ' ' || chr(10) || '<i> "z"' AS plain, x || '.1.2,7.0.1.' || x AS versions, CASE k WHEN 0 THEN 'HIGH' END AS severity, CAST(CASE k WHEN 0 THEN 7.5 END AS DOUBLE) AS score, CASE k WHEN 0 THEN 'CVSS:3.1/AV:' || x END AS vector,
      CASE k WHEN 0 THEN x END AS module, 'VMSA-2024-' || x AS advisory, 'Tool ' || x || '|Kit' AS products, 'https://acme.test/en-us/security-advisories/' || x AS address, 'ADV-' || x || CASE k WHEN 0 THEN '/CVE-2024-' || x ELSE '' END AS part_id,
      '<c comment="a ' || x || '"/>' || chr(10) || '<d/>' AS mended, '1.' || x || '.4' AS fix FROM (SELECT s_suppkey, CAST(s_suppkey AS varchar) AS x, s_suppkey%2 AS k FROM supplier)"""),
    "time_labels": (time_labels, f"""SELECT p_partkey AS id, CASE WHEN p_partkey%10 = 0 THEN '-' WHEN s >= 3600 THEN (s//3600) || 'h ' || (s%3600//60) || 'm' WHEN s >= 60 THEN (s//60) || 'm ' || (s%60) || 's' ELSE s || 's' END AS took,
      CASE WHEN p_partkey%10 = 0 THEN '-' WHEN m < 1 THEN 'just now' WHEN m < 60 THEN m || 'm ago' WHEN m < 1440 THEN (m//60) || 'h ago' ELSE (m//1440) || 'd ago' END AS ago
      FROM (SELECT p_partkey, CAST(({_MS} + 500)//1000 AS BIGINT) AS s, CAST({_MS}*100//60000 AS BIGINT) AS m FROM part)"""),
    "max_cvss_argmax": (max_score, """SELECT advisory, score, vector FROM (SELECT l_orderkey AS advisory, CAST(l_quantity AS int)%11 AS score, 'v' || CAST(l_partkey AS varchar) AS vector,
      row_number() OVER (PARTITION BY l_orderkey ORDER BY CAST(l_quantity AS int)%11 DESC, l_linenumber*1000000+l_partkey) AS k FROM lineitem) WHERE k = 1"""),
    "import_counters": (import_counters, "SELECT count(*) AS total, count(*) FILTER (o_orderkey%4 = 0) AS inserted, count(*) FILTER (o_orderkey%4 = 3) AS updated, count(*) FILTER (o_orderkey%4 = 1) AS failed, count(*) FILTER (o_orderkey%4 = 2) AS skipped FROM orders"),
    "source_coverage": (source_coverage, """SELECT source, expected, found, found < 0.89 * expected AS short FROM (SELECT c_mktsegment AS source, count(*) AS expected, count(*) FILTER (c_custkey%9 <> 0 AND c_mktsegment <> 'BUILDING') AS found FROM customer GROUP BY 1)"""),
    "source_map": (source_map, """SELECT '{' || string_agg('"' || s || '":' || n, ',' ORDER BY s) || '}' AS by_source FROM (SELECT c_mktsegment AS s, count(*) AS n FROM customer GROUP BY 1)"""),
    "oval_advisories": (oval_rows, f"""WITH {_ADVISORIES} SELECT external_id, cve_id, CAST(score AS DOUBLE) AS score, vector, 'Fix ' || x AS summary, CASE n%4 WHEN 0 THEN 'HIGH' ELSE 'ODD' END AS severity,
      CASE n%2 WHEN 0 THEN 'https://acme.test/' || x END AS url, 'nodejs,curl' AS products FROM o"""),
    "advisory_ranges": (oval_ranges, f"""WITH {_ADVISORIES} SELECT external_id, 'red-hat' AS vendor, 'nodejs' AS product, '18.0' AS version_start, '20.' || y || '.0' AS version_end, CAST(18000000000 AS BIGINT) AS version_start_int, CAST(20000000 + y*1000 AS BIGINT)*1000 AS version_end_int FROM o
      UNION ALL SELECT external_id, 'red-hat', 'curl', CASE WHEN y >= 18 THEN '18.0' END, y || '.1', CASE WHEN y >= 18 THEN 18000000000 END, CAST(y*1000000 + 1000 AS BIGINT)*1000 FROM o"""),
    "sweep_totals": (sweep_totals, """WITH k AS (SELECT l_partkey AS product, l_orderkey AS vuln, max(CASE WHEN l_linenumber%3 <> 0 THEN 1 ELSE 0 END) AS e, max(CASE WHEN l_linenumber%4 <> 0 THEN 1 ELSE 0 END) AS a FROM lineitem GROUP BY 1, 2),
      n AS (SELECT product, sum(e*a) AS tp, sum(a - e*a) AS fp, sum(e - e*a) AS fn FROM k WHERE e + a > 0 GROUP BY 1), t AS (SELECT count(*) AS versions, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, count(*) FILTER (fp + fn = 0) AS passed FROM n)
      SELECT versions, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, passed, versions - passed AS failed, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2*tp / (2*tp + fp + fn), 6) AS f1 FROM t"""),
    "cve_split": (cve_split, "SELECT count(*) FILTER (o_orderkey%3 = 0) AS cves, count(*) FILTER (o_orderkey%3 <> 0) AS others FROM orders"),
    "preferred_form": (preferred, "SELECT p_partkey AS id, CASE WHEN p_partkey%2 = 0 THEN 'csaf' ELSE 'cvrf' END AS form FROM part WHERE p_partkey%2 = 0 OR p_partkey%3 = 0"),
}
