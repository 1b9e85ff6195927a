"""Queries over advisory documents in JSON and XML, and the same results stated otherwise in SQL.

Each document is made of one order and its lines, and nested one to eighteen levels deep.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import csaf, cvrf, sitemap, vendor_pages
from .queries import view

c = F.col

LINES = "SELECT l_orderkey AS o, l_linenumber AS ln, max(l_partkey%7) AS fam, max(CAST(l_quantity AS int)) AS q FROM lineitem GROUP BY l_orderkey, l_linenumber"
_DEPTH = "(o % 18 + 1)"


def fill(template: str) -> Column:
    """Text with the columns that it names in braces."""
    parts = template.replace("}", "{").split("{")
    return F.concat(*(F.lit(p) if i % 2 == 0 else F.expr(p).cast("string") for i, p in enumerate(parts) if i % 2 or p))


def _nested(text: Column, before: str, after: str) -> Column:
    return F.concat(F.expr(f"repeat('{before}', {_DEPTH})"), text, F.expr(f"repeat('{after}', {_DEPTH})"))


def _per_order(spark, d, sep: str = ",", **templates: str) -> DataFrame:
    """A row per order with, for each template, its lines' texts in order."""
    lines = view(spark, d, LINES)
    made = [F.array_sort(F.collect_list(F.struct("ln", fill(t).alias("t")))).alias(n) for n, t in templates.items()]
    return lines.groupBy("o").agg(*made).select("o", *(F.array_join(F.transform(n, lambda x: x["t"]), sep).alias(n) for n in templates))


def _quoted(s: str) -> str:
    return s.replace("'", '"')


def _json(rows: DataFrame, *status: str) -> Column:
    family = _quoted("{'category':'product_family','name':'f','branches':[")
    listed = F.concat(*(F.concat(F.lit(("," if i else "") + f'"{s}":['), s, F.lit("]")) for i, s in enumerate(status)))
    head = fill(_quoted("<'document':<'title':'t','tracking':<'id':'{o}','initial_release_date':'2024-05-01T00:00:00Z'>>,'product_tree':<'branches':["))
    vuln = fill(_quoted("]>,'vulnerabilities':[<'cve':'CVE-2024-{o}','notes':[<'category':'summary','text':' about {o} '>],'scores':[<'cvss_v3':<'baseScore':{o % 10},'baseSeverity':'high','vectorString':'v{o}'>>],'product_status':<"))
    braces = lambda x: F.translate(x, "<>", "{}")
    return F.concat(braces(head), _nested(c("tree"), family, "]}"), braces(vuln), listed, F.lit("}}]}"))


def _ranged(spark, d) -> DataFrame:
    tree = _quoted("<'category':'product_name','name':'Tool {fam}','branches':[<'category':'product_version_range','name':'vers:generic/~{ln}.{q}','product':<'name':'x','product_id':'P{ln % 3}'>>,"
                   "<'category':'product_version_range','name':'vers:generic/^={ln}.{q}','product':<'name':'x','product_id':'F{ln}'>>]>")  # fmt: skip
    rows = _per_order(spark, d, tree=tree, known_affected='"P{ln % 3}"', fixed='"F{ln}"').withColumn("tree", F.translate(F.translate("tree", "<>", "{}"), "~^", "<>"))
    return rows.select(c("o").cast("string").alias("id"), _json(rows, "known_affected", "fixed").alias("text"))


def product_map(spark, d):
    return csaf.range_map(csaf.product_nodes(csaf.read_csaf(_ranged(spark, d)), paths=False)).select(c("id").cast("bigint").alias("o"), "product_id", "family", "op", "version")


def _joined(products="products"):
    show = lambda p: F.concat_ws(":", p["product"], *(F.coalesce(p[n], F.lit("")) for n in ("version_start", "version_end", "last_affected", "version_fixed")), F.array_join(p["versions"], "+"), p["patch_available"].cast("string"))
    return F.array_join(F.transform(products, show), ";").alias("products")


_HEAD = ("external_id", "cve_id", "summary", "severity", "score", "vector")


def ranged(spark, d):
    return csaf.csaf_advisories(_ranged(spark, d), "paloalto").select(*_HEAD, _joined())


def named(spark, d):
    tree = _quoted("<'category':'product','name':'Wall'>,<'category':'product','name':'Wall Cloud'>")
    affected = '"{CASE ln % 3 WHEN 0 THEN concat("Wall >=", ln, ".", q, ".0|<=", ln, ".", q, ".9") WHEN 1 THEN concat("Wall Cloud ", ln, ".", q, " all versions") ELSE concat("Wall ", ln, ".", q, ".1") END}"'
    rows = _per_order(spark, d, known_affected=affected, known_not_affected='"Wall-{ln}.{q}.5"').withColumn("tree", F.translate(F.lit(tree), "<>", "{}"))
    docs = rows.select(c("o").cast("string").alias("id"), _json(rows, "known_affected", "known_not_affected").alias("text"))
    return csaf.csaf_advisories(docs, "fortinet").select("external_id", "score", _joined())


def _xml(spark, d) -> DataFrame:
    tree = '<Branch Name="Tool {fam}" Type="Product Name"><Branch Name="{ln}.{q}" Type="Product Version"><FullProductName ProductID="P{ln % 3}">x</FullProductName></Branch></Branch>'
    entries = '<Vulnerability><CVE>CVE-2023-{ln % 2}</CVE><ProductStatuses><Status Type="Known Affected"><ProductID>P{ln % 3}</ProductID></Status></ProductStatuses><CVSSScoreSets><ScoreSet><BaseScore>{q % 10}.5</BaseScore><Vector>v{ln}</Vector></ScoreSet></CVSSScoreSets></Vulnerability>'
    rows = _per_order(spark, d, sep="", tree=tree, entries=entries)
    text = F.concat(F.lit('<cvrf:cvrfdoc xmlns:cvrf="http://c/1.1"><ProductTree>'), _nested(c("tree"), '<Branch Name="f" Type="Product Family">', "</Branch>"), F.lit("</ProductTree>"), "entries", F.lit("</cvrf:cvrfdoc>"))
    return rows.select("o", F.concat(F.lit("cpu"), c("o").cast("string")).alias("id"), text.alias("text"))


def xml_map(spark, d):
    return cvrf.product_map(_xml(spark, d).drop("o")).select(F.substring("id", 4, 20).cast("bigint").alias("o"), "product_id", "product", "version")


def collections(spark, d):
    tree = _quoted("<'category':'product','name':'x','product':<'name':'Oracle Tool {fam} {ln}.{q}','product_id':'P{ln % 3}'>>")
    new = _per_order(spark, d, tree=tree, known_affected='"P{ln % 3}"').withColumn("tree", F.translate("tree", "<>", "{}"))
    new = new.where("o % 2 = 0").select(F.concat(F.lit("cpu"), c("o").cast("string")).alias("id"), _json(new, "known_affected").alias("text"))
    old = _xml(spark, d).where("o % 3 = 0").drop("o")
    links = view(spark, d, "SELECT 'https://v.test/security-alerts/cpu' || CAST(o_orderkey AS varchar(12)) || '.html' AS link FROM orders")
    rows, failed = cvrf.cpu_advisories(links, new, old)
    lost = failed.select(F.concat("id", F.lit("-failed")).alias("external_id"), *(F.lit(None).alias(n) for n in (*_HEAD[1:], "products")))
    return rows.select(*_HEAD, _joined()).unionByName(lost)


_LISTED = "SELECT CAST(o_orderkey AS bigint) AS o, o_orderkey%2=0 AS listed, o_orderkey%3=0 AS fresh, o_orderkey%5<>0 AS landed FROM orders"


def sitemap_items(spark, d):
    """Every second order is listed, every third is in the feed, and most have a page: all subsets occur."""
    rows = view(spark, d, _LISTED)
    put = lambda test, text: rows.where(test).groupBy(F.floor(c("o") / 200)).agg(F.array_join(F.collect_list(fill(text)), "").alias("text"))
    listed = sitemap.sitemap_ids(put("listed", "<loc>https://v.test/security-advisories/sophos-sa-{o}</loc>").select("text"))
    item = "<item><guid>sophos-sa-{o}</guid><title>Resolved flaw in Sophos Tool {o} (CVE-2024-{o + 1000})</title><description>&lt;strong&gt;Severity:&lt;/strong&gt; {CASE WHEN o % 4 = 0 THEN 'High' ELSE 'Odd' END}</description></item>"
    feed = put("fresh", item).select(F.concat(F.lit("<rss><channel>"), "text", F.lit("</channel></rss>")).alias("text"))
    page = fill("<title>Flaw in Sophos Kit {o} | Sophos</title><p>{CASE WHEN o % 7 = 0 THEN concat('CVE-2023-', o + 1000, ' CVE-2022-', o + 1000) ELSE 'none' END}</p>")
    found, failed = sitemap.advisories(listed, sitemap.rss_items(feed), rows.where("landed").select(fill("sophos-sa-{o}").alias("ident"), page.alias("html")))
    kept = found.select("external_id", "cve_id", "summary", "severity", "product", "patch_available")
    return kept.unionByName(failed.select(F.concat("ident", F.lit("-failed")).alias("external_id"), *(F.lit(None).alias(n) for n in kept.columns[1:])))


def _pages(spark, d, template: str):
    """Pages of the entries of fifty orders each."""
    rows = view(spark, d, "SELECT CAST(o_orderkey AS bigint) AS o FROM orders").select("o", F.floor(c("o") / 50).alias("page"), fill(template).alias("html"))
    return rows.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "html"))), lambda x: x["html"]), "").alias("html"))


def _shown(found):
    show = lambda p: F.concat_ws(":", p["introduced"], p["last_affected"], F.coalesce(p["version_fixed"], F.lit("-")))
    return found.select("cve_id", "severity", "page", F.array_join(F.transform("products", show), ";").alias("products"))


def sections(spark, d):
    """Entries under the section nearest before them; one of five has no readable range."""
    template = """{CASE WHEN o % 4 = 0 THEN concat('<h3 id="Fixed_in_Apache_Tomcat_9.0.', o % 90, '">x</h3>') ELSE '' END}<p><strong>{CASE o % 3 WHEN 0 THEN 'Low' WHEN 1 THEN 'Important' ELSE 'Odd' END}: title</strong> <a>CVE-2024-{o % 997 + 1000}</a></p><p>as CVE-1999-1234</p><p>Affects: {CASE WHEN o % 5 = 0 THEN 'see notes' ELSE concat('9.0.', o % 7, ' to 9.0.', o % 7 + o % 11) END}</p>"""
    return _shown(vendor_pages.by_cve(vendor_pages.sectioned_entries(_pages(spark, d, template))))


def lists(spark, d):
    template = """<li>CVE-2023-{o % 997 + 1000} <br>Severity: {CASE o % 3 WHEN 0 THEN 'unknown' WHEN 1 THEN 'high' ELSE 'odd' END}<br>Not vulnerable: 1.{o % 9}.{o % 8 + 1}+, 2.0.0+<br>Vulnerable: 1.{o % 9}.0-1.{o % 9}.{o % 8}, {CASE WHEN o % 2 = 0 THEN '1.5.10' ELSE 'none' END}</li>"""
    return _shown(vendor_pages.by_cve(vendor_pages.list_entries(_pages(spark, d, template))))


_MAPPED = f"""l AS ({LINES}), p AS (SELECT o, ln%3 AS k, max(ln) AS ln, min(ln) AS pos FROM l GROUP BY 1, 2), m AS (SELECT p.o, p.k, p.pos, l.fam, CAST(l.ln AS varchar) || '.' || l.q AS v FROM p JOIN l ON l.o = p.o AND l.ln = p.ln)"""

#: name → (query, SQL)
QUERIES = {
    "csaf_product_map": (product_map, f"""WITH {_MAPPED} SELECT o, 'P' || k AS product_id, 'Tool ' || fam AS family, '<' AS op, v AS version FROM m
      UNION ALL SELECT o, 'F' || ln, 'Tool ' || fam, '>=', CAST(ln AS varchar) || '.' || q FROM l"""),
    "csaf_advisories": (ranged, f"""WITH {_MAPPED}, f AS (SELECT o, fam, min(ln) AS ln FROM l GROUP BY 1, 2), x AS (SELECT m.*, CAST(f.ln AS varchar) || '.' || l.q AS fix FROM m JOIN f ON f.o = m.o AND f.fam = m.fam JOIN l ON l.o = f.o AND l.ln = f.ln)
      SELECT CAST(o AS varchar) AS external_id, 'CVE-2024-' || o AS cve_id, 'about ' || o AS summary, 'high' AS severity, CAST(o%10 AS DOUBLE) AS score, 'v' || o AS vector, string_agg('Tool ' || fam || '::' || v || '::' || fix || '::true', ';' ORDER BY pos) AS products FROM x GROUP BY o"""),
    "csaf_named_products": (named, f"""WITH l AS ({LINES}), x AS (SELECT o, ln, ln || '.' || q AS b, ln%3 AS k, q FROM l) SELECT CAST(o AS varchar) AS external_id, CAST(o%10 AS DOUBLE) AS score,
      string_agg(CASE k WHEN 0 THEN 'Wall:' || b || '.0::' || b || '.9:' || b || '.5::true' WHEN 1 THEN 'Wall Cloud:' || b || '.0:' || ln || '.' || (q + 1) || '.0::' || b || '.5::true' ELSE 'Wall:::::' || b || '.1:true' END, ';' ORDER BY ln) AS products FROM x GROUP BY o"""),
    "cvrf_product_map": (xml_map, f"WITH {_MAPPED} SELECT o, 'P' || k AS product_id, 'Tool ' || fam AS product, v AS version FROM m"),
    "page_sections": (sections, """WITH o AS (SELECT CAST(o_orderkey AS BIGINT) AS o, CAST(o_orderkey//50 AS BIGINT) AS page FROM orders),
      e AS (SELECT *, 'CVE-2024-' || (o%997 + 1000) AS cve_id, CASE o%3 WHEN 0 THEN 'LOW' WHEN 1 THEN 'HIGH' END AS severity, o%7 AS a, o%7 + o%11 AS b, last_value(CASE WHEN o%4 = 0 THEN o%90 END IGNORE NULLS) OVER (PARTITION BY page ORDER BY o) AS fix FROM o),
      k AS (SELECT * FROM e WHERE o%5 <> 0), u AS (SELECT cve_id, a, b, min(o) AS first_at, arg_min(coalesce('9.0.' || fix, '-'), o) AS fix FROM k GROUP BY 1, 2, 3)
      SELECT cve_id, severity, page, products FROM (SELECT cve_id, min(page) AS page, arg_min(severity, o) FILTER (severity IS NOT NULL) AS severity FROM k GROUP BY 1)
        JOIN (SELECT cve_id, string_agg('9.0.' || a || ':9.0.' || b || ':' || fix, ';' ORDER BY first_at) AS products FROM u GROUP BY 1) USING (cve_id)"""),
    "page_lists": (lists, """WITH o AS (SELECT CAST(o_orderkey AS BIGINT) AS o, CAST(o_orderkey//50 AS BIGINT) AS page, 'CVE-2023-' || (o_orderkey%997 + 1000) AS cve_id FROM orders),
      r AS (SELECT cve_id, o*2 AS pos, '1.' || (o%9) || '.0' AS s, '1.' || (o%9) || '.' || (o%8) AS t, '1.' || (o%9) || '.' || (o%8 + 1) AS fix FROM o UNION ALL SELECT cve_id, o*2 + 1, '1.5.10', '1.5.10', '-' FROM o WHERE o%2 = 0),
      u AS (SELECT cve_id, s, t, min(pos) AS first_at, arg_min(fix, pos) AS fix FROM r GROUP BY 1, 2, 3)
      SELECT cve_id, CASE WHEN word = 1 THEN 'HIGH' END AS severity, page, products FROM (SELECT cve_id, min(page) AS page, arg_min(o%3, o) FILTER (o%3 <> 0) AS word FROM o GROUP BY 1)
        JOIN (SELECT cve_id, string_agg(s || ':' || t || ':' || fix, ';' ORDER BY first_at) AS products FROM u GROUP BY 1) USING (cve_id)"""),
    "sophos_items": (sitemap_items, f"""WITH t AS ({_LISTED} WHERE o_orderkey%2 = 0), x AS (SELECT *, 'sophos-sa-' || o AS i, unnest(CASE WHEN fresh THEN ['CVE-2024-' || (o + 1000)] WHEN landed AND o%7 = 0 THEN ['CVE-2023-' || (o + 1000), 'CVE-2022-' || (o + 1000)] ELSE [NULL] END) AS cve FROM t)
      SELECT CASE WHEN NOT fresh AND NOT landed THEN i || '-failed' ELSE i || coalesce('/' || cve, '') END AS external_id, cve AS cve_id, CASE WHEN fresh THEN 'Resolved flaw in Sophos Tool ' || o || ' (CVE-2024-' || (o + 1000) || ')' WHEN landed THEN 'Flaw in Sophos Kit ' || o END AS summary,
        CASE WHEN fresh AND o%4 = 0 THEN 'HIGH' END AS severity, CASE WHEN fresh THEN 'Sophos Tool ' || o WHEN landed THEN 'Sophos Kit ' || o END AS product, CASE WHEN fresh OR landed THEN fresh END AS patch_available FROM x"""),
    "cpu_advisories": (collections, f"""WITH {_MAPPED}, n AS (SELECT l.o, l.ln%2 AS k, min(ln) AS pos, m.fam, m.v FROM l JOIN m ON m.o = l.o AND m.k = l.ln%3 GROUP BY 1, 2, m.fam, m.v),
      s AS (SELECT o, ln%2 AS k, q%10 + 0.5 AS score, ln, row_number() OVER (PARTITION BY o, ln%2 ORDER BY q%10 DESC, ln) AS r FROM l)
      SELECT 'cpu' || o || '-CVE-2024-' || o AS external_id, 'CVE-2024-' || o AS cve_id, 'about ' || o AS summary, 'HIGH' AS severity, CAST(o%10 AS DOUBLE) AS score, 'v' || o AS vector, string_agg('Tool ' || fam || ':::::' || v || ':true', ';' ORDER BY pos) AS products FROM m WHERE o%2 = 0 GROUP BY o
      UNION ALL SELECT 'cpu' || n.o || '-CVE-2023-' || n.k, 'CVE-2023-' || n.k, 'CPU' || n.o || ': CVE-2023-' || n.k, CASE WHEN score >= 9 THEN 'CRITICAL' WHEN score >= 7 THEN 'HIGH' WHEN score >= 4 THEN 'MEDIUM' ELSE 'LOW' END, CAST(score AS DOUBLE), 'v' || s.ln,
        string_agg('Tool ' || fam || ':::::' || v || ':true', ';' ORDER BY pos) FROM n JOIN s ON s.o = n.o AND s.k = n.k AND s.r = 1 WHERE n.o%2 = 1 AND n.o%3 = 0 GROUP BY n.o, n.k, score, s.ln
      UNION ALL SELECT 'cpu' || o_orderkey || '-failed', NULL, NULL, NULL, NULL, NULL, NULL FROM orders WHERE o_orderkey%2 = 1 AND o_orderkey%3 <> 0 OR o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)"""),
}
