import json

from quarrymill.sources import csaf, cvrf

TEXTS = "id string, text string"


def branch(category, name, ident=None, product=None, below=()):
    out = {"category": category, "name": name}
    if ident:
        out["product"] = {"product_id": ident, "name": product or name}
    return out | ({"branches": list(below)} if below else {})


def document(branches, *vulnerabilities):
    return json.dumps({"document": {"title": "t", "tracking": {"id": "x", "initial_release_date": "2024-05-01T00:00:00Z"}}, "product_tree": {"branches": branches}, "vulnerabilities": list(vulnerabilities)})


def deep(depth, *leaves):
    for n in range(depth):
        leaves = [branch("product_family", f"level {n}", below=leaves)]
    return list(leaves)


def products(df):
    return {r["external_id"]: [tuple(p) for p in r["products"]] for r in df.collect()}


def texts(spark, **docs):
    return spark.createDataFrame(list(docs.items()), TEXTS)


def test_product_trees_of_any_depth(spark):
    leaf = lambda k: branch("product_name", f"Tool {k}", below=[branch("product_version_range", f"vers:generic/<{k}.1", f"P{k}"), branch("product_version", "Tool All", "Q")])
    docs = texts(spark, a=document(deep(4, leaf(1), leaf(2))), b=document(deep(18, leaf(3))), c=document(deep(8, leaf(4))), none=document([]), bad="{")
    nodes = csaf.product_nodes(csaf.read_csaf(docs))
    assert {r["id"]: r["count"] for r in nodes.groupBy("id").count().collect()} == {"a": 10, "b": 21, "c": 11}
    paths = [r["path"] for r in nodes.where("id = 'b'").collect()]
    assert max(map(len, paths)) == 20
    got = {(r["id"], r["product_id"]): (r["family"], r["op"], r["version"]) for r in csaf.range_map(nodes).collect()}
    assert got == {
        ("a", "P1"): ("Tool 1", "<", "1.1"), ("a", "P2"): ("Tool 2", "<", "2.1"), ("a", "Q"): ("Tool 2", None, None),
        ("b", "P3"): ("Tool 3", "<", "3.1"), ("b", "Q"): ("Tool 3", None, None), ("c", "P4"): ("Tool 4", "<", "4.1"), ("c", "Q"): ("Tool 4", None, None),
    }


def test_ranges_of_the_tree(spark):
    tree = [
        branch("product_name", "Agent", below=[branch("product_version", "Agent All", "A-1"), branch("product_version_range", "vers:generic/>=5.2", "A-2"), branch("product_version_range", "vers:generic/>=6.0", "A-3")]),
        branch("product_name", "Box", below=[branch("product_version_range", "vers:generic/Box<=3.4", "B-1"), branch("vendor", "no version", "B-2")]),
    ]
    first = {"cve": "CVE-2024-1", "product_status": {"known_affected": ["A-1", "B-1", "B-2", "A-1", "zz"], "fixed": ["A-3"], "known_not_affected": ["A-2", "B-1"]},
             "notes": [{"category": "other", "text": "no"}, {"category": "description", "text": " told \n"}], "scores": [{"cvss_v4": {"baseScore": 5.0, "baseSeverity": "MEDIUM", "vectorString": "v4"}}]}
    second = {"product_status": {"known_affected": ["A-1"]}, "scores": [{"cvss_v3": {"baseScore": 7.5, "baseSeverity": "HIGH", "vectorString": "v3"}}, {"cvss_v3": {"baseScore": 7.5, "vectorString": "later"}}]}
    df = csaf.csaf_advisories(texts(spark, ADV=document(tree, first, second), EMPTY=document(tree)), "paloalto")
    row = df.collect()[0].asDict()
    assert [tuple(p) for p in row.pop("products")] == [("Agent", None, None, None, "5.2", [], True), ("Box", None, None, "3.4", None, [], False)]
    assert (row["external_id"], row["cve_id"], row["summary"], row["severity"], row["score"], row["vector"], row["url"]) == ("ADV", "CVE-2024-1", "told", "HIGH", 7.5, "v3", "https://security.paloaltonetworks.com/ADV")
    assert df.count() == 1


def test_older_ids_hold_versions(spark):
    tree = [branch("product_name", "OS", below=[branch("product_version", "OS 9", None)])]
    vuln = {"cve": "CVE-2024-2", "product_status": {"known_affected": ["OS 11.1.0", "OS 9.0", "OS", "Other < 3.1", "OS <= 2.0"], "known_not_affected": ["OS 11.1.4", "OS none"], "fixed": ["OS 11.1.3"]}}
    got = products(csaf.csaf_advisories(texts(spark, A=document(tree, vuln)), "paloalto"))
    # 'Other < 3.1' has no known name, so its last word alone counts as the version.
    assert got == {"A": [("OS", "11.1.0", "11.1.4", None, "11.1.4", [], True), ("OS", "9.0", "9.1", None, None, [], False), ("OS", None, None, None, None, [], True), ("Other <", "3.1", "3.2", None, None, [], False), ("OS", None, None, "2.0", None, [], True)]}


def test_versions_in_ids(spark):
    tree = deep(2, branch("product", "Wall"), branch("product", "Wall Cloud"))
    affected = ["Wall >=7.6.0|<=7.6.1", "Wall Cloud 7.4 all versions", "Wall 6.2.0", "Wall", "Nothing 1.0", "Wall 6.2.0"]
    vuln = {"cve": "CVE-2024-3", "product_status": {"known_affected": affected, "known_not_affected": ["Wall-7.6.3", "Wall-7.6.10", "Wall Cloud-7.5"]}, "notes": [{"title": "Workarounds", "text": "N/A"}], "remediations": [{"category": "vendor_fix", "details": "Upgrade"}]}
    df = csaf.csaf_advisories(texts(spark, F=document(tree, vuln)), "fortinet")
    assert products(df) == {"F": [("Wall", "7.6.0", None, "7.6.1", "7.6.10", [], True), ("Wall Cloud", "7.4.0", "7.5.0", None, None, [], False), ("Wall", None, None, None, None, ["6.2.0"], True)]}
    assert (df.first()["workaround"], df.first()["solution"]) == (None, "Upgrade")


def test_listed_advisories(spark):
    tree = deep(9, branch("service_pack", "x", "1", "IOS"), branch("service_pack", "y", "2", "IOS XE"))
    vuln = {"product_status": {"known_affected": ["IOS XE 17.3.1", "IOS-15", "IOSX 1"], "known_not_affected": ["IOS XE-17.3.4"]}, "scores": [{"cvss_v3": {"baseScore": 8.0, "vectorString": "vec"}}]}
    cols = "advisoryId string, advisoryTitle string, summary string, sir string, cves array<string>, cvssBaseScore string, publicationUrl string, workarounds string, firstPublished string, affectedProducts string"
    rows = [("c1", "T", "S", "High", ["CVE-1", "CVE-2"], "8.1", "u", "No workarounds available", "2024-01-01T00:00:00Z", "text"), ("c2", "T", "S", "odd", None, "NA", "u", "w", None, "text"), ("c3", "T", "S", "low", None, None, None, None, None, None)]
    df = csaf.cisco_advisories(spark.createDataFrame(rows, cols), texts(spark, c1=document(tree, vuln)))
    assert products(df) == {"c1": [("IOS XE", "17.3.1", None, None, "17.3.4", [], True), ("IOS", "15", None, None, None, [], False)], "c2": [("cisco", None, None, None, None, [], False)], "c3": []}
    assert {r["external_id"]: (r["cve_id"], r["severity"], r["score"], r["vector"], r["workaround"]) for r in df.collect()} == {"c1": ("CVE-1", "HIGH", 8.1, "vec", None), "c2": (None, "ODD", None, None, "w"), "c3": (None, "LOW", None, None, None)}


CVRF = """<?xml version="1.0"?><cvrf:cvrfdoc xmlns="http://c/1.1" xmlns:cvrf="http://c/1.1"><DocumentTracking><InitialReleaseDate>2020-07-14T13:00:00Z</InitialReleaseDate></DocumentTracking>
<ProductTree xmlns="http://p/1.1"><Branch Name="V" Type="Vendor">{tree}</Branch></ProductTree>{vulns}</cvrf:cvrfdoc>"""


def named(name, *below):
    return f'<Branch Name="{name}" Type="Product Name">{"".join(below)}</Branch>'


def version(v, *idents):
    return f'<Branch Name="{v}" Type="Product Version">' + "".join(f'<FullProductName ProductID="{i}">x &amp; y</FullProductName>' for i in idents) + "</Branch>"


def entry(cve, *idents, score="", kind="Known Affected", details=""):
    ids = "".join(f"<ProductID>{i}</ProductID>" for i in idents)
    return f'<Vulnerability><Notes><Note Type="General">g</Note><Note Type="Details">{details}</Note></Notes>{f"<CVE>{cve}</CVE>" if cve else ""}<ProductStatuses><Status Type="{kind}">{ids}</Status></ProductStatuses><CVSSScoreSets>{score}</CVSSScoreSets></Vulnerability>'


def scored(s, vector):
    return f"<ScoreSet><BaseScore>  {s}</BaseScore><Vector>{vector}</Vector></ScoreSet>"


def test_cvrf_product_trees():
    tree = named("A", version("07.20", "p1", "p2"), '<FullProductName ProductID="p1">later, but first of its branch</FullProductName>', named("B", version("3", "p3"), '<FullProductName ProductID="p4"/>')) + version("9", "lost")
    tree = "".join(f'<Branch Name="L{k}" Type="Product Family">' for k in range(30)) + tree + "</Branch>" * 30
    got = cvrf.collect_products(CVRF.format(tree=tree, vulns='<FullProductName ProductID="outside">x</FullProductName>'))
    assert got == [("p1", "A", None), ("p1", "A", "07.20"), ("p2", "A", "07.20"), ("p4", "B", None), ("p3", "B", "3")]
    assert cvrf.collect_products("<a><b></a>") == []


def test_cvrf_advisories(spark):
    tree = named("A", version("1.0", "a1"), version("2.0", "a2")) + named("B", version("6.10", "b"))
    vulns = entry("CVE-1", "a2", "a1", score=scored(5.0, "V1")) + entry("CVE-1", "b", "a1", score=scored("9.1", "V2") + scored(9.1, "V3"), details=" told ") + entry(None, "a1") + entry("CVE-2", "zz") + entry("CVE-3", "a1", kind="Fixed") + entry("CVE-4", "b")
    df = cvrf.cvrf_advisories(texts(spark, cpujul2020=CVRF.format(tree=tree, vulns=vulns), bad="<x"))
    one = lambda p, v: (p, None, None, None, None, [v], True)
    assert products(df) == {"cpujul2020-CVE-1": [one("A", "2.0"), one("A", "1.0"), one("B", "6.10")], "cpujul2020-CVE-4": [one("B", "6.10")]}
    rows = {r["cve_id"]: r for r in df.collect()}
    assert [rows["CVE-1"][k] for k in ("summary", "severity", "score", "vector")] == ["told", "CRITICAL", 9.1, "V2"]
    assert [rows["CVE-4"][k] for k in ("summary", "severity", "score", "vector")] == ["CPUJUL2020: CVE-4", None, None, None]
    assert str(rows["CVE-1"]["published_at"]) == "2020-07-14 13:00:00"


def test_collections_prefer_the_newer_format(spark):
    tree = [branch("vendor", "V", below=[branch("product", "x", "p", "Oracle Server Version 8.0.1"), branch("product", "x", "q", "Oracle Kit 8.0.2"), branch("product", "x", "r", "Oracle Server 8.0.1")])]
    new = document(tree, {"cve": "CVE-1", "product_status": {"known_affected": ["p", "q", "q", "r"]}, "scores": [{"cvss_v3": {"baseScore": 6.5, "baseSeverity": "medium", "vectorString": "v"}}]})
    old = CVRF.format(tree=named("A", version("1", "a")), vulns=entry("CVE-2", "a"))
    links = spark.createDataFrame([(f"https://v.test/security-alerts/{n}.html",) for n in ("cpuboth", "cpuold", "cpulost", "alert-cve")], "link string")
    rows, failed = cvrf.cpu_advisories(links, texts(spark, cpuboth=new, cpuold="{", cpuother=new), texts(spark, cpuboth=old, cpuold=old, cpulost="<"))
    assert {k: [p[0] for p in v] for k, v in products(rows).items()} == {"cpuboth-CVE-1": ["Server", "Kit"], "cpuold-CVE-2": ["A"]}
    assert [r["id"] for r in failed.collect()] == ["cpulost"]


def test_sitemap_rss_and_titles(spark):
    from quarrymill.sources import sitemap

    names = ["sophos-sa-1", "sophos-sa-2", "sophos-sa-cve-2020-9363", "sophos-sa-4", "sophos-sa-5", "sophos-sa-6", "sophos-sa-7"]
    listed = spark.createDataFrame([("".join(f"<loc>https://v.test/security-advisories/{n}</loc>" for n in [*names, names[0]]),)], "text string")
    item = lambda guid, title, text: f'<item><guid isPermaLink="false">{guid}</guid><title>{title}</title><link>https://v.test/de-de/security-advisories/{guid}</link><pubDate>Tue, 02 Jan 2024 10:00:00 GMT</pubDate><description><![CDATA[{text}]]></description></item>'
    feed = "<rss><channel><title>t</title>" + item("sophos-sa-1", "old", "") + item("sophos-sa-1", "Resolved RCE in Sophos Firewall Software (CVE-2024-1)", "<strong>Severity:</strong> High <p>CVE-2024-2, CVE-2024-1</p>") + item("sophos-sa-9", "not listed", "") + "</channel></rss>"
    pages = [("sophos-sa-2", "<title>Flaw in Sophos Home | Sophos</title><p>CVE-2023-5 and CVE-2023-6</p><script>CVE-2000-1</script>"), ("sophos-sa-cve-2020-9363", "<title>CVE-2021-1 told | Sophos</title>"), ("sophos-sa-4", "<title>No ids</title>"), ("sophos-sa-5", None), ("sophos-sa-6", "<p>nothing</p>"), ("sophos-sa-1", "<title>CVE-1999-1</title>")]
    items = sitemap.rss_items(spark.createDataFrame([(feed,)], "text string"))
    rows, failed = sitemap.advisories(sitemap.sitemap_ids(listed), items, spark.createDataFrame(pages, "ident string, html string"))
    got = {r.external_id: (r.cve_id, r.summary, r.severity, r["product"], r.patch_available) for r in rows.collect()}
    title = "Resolved RCE in Sophos Firewall Software (CVE-2024-1)"
    assert got == {
        "sophos-sa-1/CVE-2024-1": ("CVE-2024-1", title, "HIGH", "Sophos Firewall", True), "sophos-sa-1/CVE-2024-2": ("CVE-2024-2", title, "HIGH", "Sophos Firewall", True),
        "sophos-sa-2/CVE-2023-5": ("CVE-2023-5", "Flaw in Sophos Home", None, "Sophos Home", False), "sophos-sa-2/CVE-2023-6": ("CVE-2023-6", "Flaw in Sophos Home", None, "Sophos Home", False),
        "sophos-sa-cve-2020-9363/CVE-2020-9363": ("CVE-2020-9363", "CVE-2021-1 told", None, "Sophos", False), "sophos-sa-4": (None, "No ids", None, "Sophos", False),
    }
    assert sorted(r.ident for r in failed.collect()) == ["sophos-sa-5", "sophos-sa-7"]
    first = rows.where("external_id = 'sophos-sa-1/CVE-2024-1'").first()
    assert (first.url, str(first.published_at)) == ("https://v.test/en-us/security-advisories/sophos-sa-1", "2024-01-02 10:00:00")


def test_pages_in_sections(spark):
    from quarrymill.sources import vendor_pages as V

    entry = lambda head, text, line: f"<p><strong>{head}</strong> <a>x</a></p><p>{text}</p><p>Affects: {line}</p>"
    page = (
        entry("Low: early CVE-2024-1", "", "9.0.0.M1 to 9.0.5") + '<h3 id="Fixed_in_Apache_Tomcat_9.0.8">x</h3>' + entry("Important: two CVE-2024-2 CVE-2024-1", "as CVE-1999-9", "Apache Tomcat 9.0.1 to 9.0.7")
        + entry("Odd CVE-2024-3", "", "see the notes") + entry("no id", "CVE-1999-8", "9.0.1") + '<h3 id="Fixed_in_Apache_Tomcat_9.0.2"></h3>' + entry("Moderate: CVE-2024-2", "", "9.0.1 to 9.0.7")
    )
    pages = spark.createDataFrame([(9, page), (10, entry("Critical: CVE-2024-1", "", "10.0.1")), (11, "nothing"), (12, None)], "page int, html string")
    got = {r.cve_id: (r.severity, r.page, [tuple(p) for p in r.products]) for r in V.by_cve(V.sectioned_entries(pages)).collect()}
    assert got == {
        "CVE-2024-1": ("LOW", 9, [("9.0.0.M1", "9.0.5", None), ("9.0.1", "9.0.7", "9.0.8"), ("10.0.1", "10.0.1", None)]),
        "CVE-2024-2": ("HIGH", 9, [("9.0.1", "9.0.7", "9.0.8")]),
    }


def test_pages_as_lists(spark):
    from quarrymill.sources import vendor_pages as V

    page = """<li>A CVE-2024-1 <br>Severity: unknown<br>Not vulnerable: 1.31.3+, 1.30.4+<br>Vulnerable: 1.3.0-1.31.2, 0.6-1.30.4, 1.5.10, none, 1.0-x</li>
    <li>B CVE-2024-1 CVE-2024-2 Severity: medium<br>Vulnerable: 1.5.10</li><li>CVE-2024-3 Not vulnerable: 1.2.3+</li><li>no id Vulnerable: 1.2</li>"""
    pages = spark.createDataFrame([(1, page)], "page int, html string")
    got = {r.cve_id: (r.severity, [tuple(p) for p in r.products]) for r in V.by_cve(V.list_entries(pages)).collect()}
    assert got == {
        "CVE-2024-1": ("MEDIUM", [("1.3.0", "1.31.2", "1.31.3"), ("0.6", "1.30.4", None), ("1.5.10", "1.5.10", None), ("1.0-x", "1.0-x", None)]),
        "CVE-2024-2": ("MEDIUM", [("1.5.10", "1.5.10", None)]),
    }


def test_branches_in_one_walk():
    odd = branch("product_name", 5, below=[{"name": 1.50, "category": True, "product": {"product_id": "", "name": {"a": [1.5, None, "x"]}}}, "no branch", branch("product_name", None, "P")])
    assert list(csaf.collect_branches(json.dumps({"branches": [odd, branch("x", "second", "Q")]}))) == [
        ((0,), "product_name", "5", None, None, "5"), ((0, 0), "true", "1.5", None, '{"a":[1.5,null,"x"]}', "5"), ((0, 1), None, None, None, None, "5"),
        ((0, 2), "product_name", None, "P", None, None), ((1,), "x", "second", "Q", "second", None),
    ]
    assert len(list(csaf.collect_branches(json.dumps({"branches": deep(300, branch("x", "y"))})))) == 301
    assert not any(any(csaf.collect_branches(t)) for t in (None, "", "5", "[]", '{"branches": {}}'))


def test_named_products_are_not_sent_through_the_driver(spark):
    tree = [branch("product", "Wall")]
    docs = texts(spark, **{f"F{n}": document(tree, {"cve": "C", "product_status": {"known_affected": ["Wall 1.0.0"], "known_not_affected": ["Wall-1.0.1"]}}) for n in range(3)})
    df = csaf.csaf_advisories(docs, "fortinet")
    assert df.count() == 3 and "BroadcastHashJoin" not in df._jdf.queryExecution().sparkPlan().toString()


def test_ranges_of_trees_are_not_sent_through_the_driver(spark):
    tree = [branch("product_name", "Agent", below=[branch("product_version_range", "vers:generic/<5.2", "A"), branch("product_version_range", "vers:generic/>=5.2", "B")])]
    new = document(tree, {"cve": "C", "product_status": {"known_affected": ["A"], "fixed": ["B"]}})
    old = document(tree, {"cve": "C", "product_status": {"known_affected": ["Agent 5.0.1"], "known_not_affected": ["Agent 5.0.2"]}})
    df = csaf.csaf_advisories(texts(spark, N=new, O=old), "paloalto")
    assert products(df) == {"N": [("Agent", None, "5.2", None, "5.2", [], True)], "O": [("Agent", "5.0.1", "5.0.2", None, "5.0.2", [], True)]}
    assert "BroadcastHashJoin" not in df._jdf.queryExecution().sparkPlan().toString()


def test_nodes_without_paths(spark):
    parsed = csaf.read_csaf(texts(spark, a=document(deep(4, branch("product_name", "x", "P"), branch("product", "y", "Q")))))
    short = csaf.product_nodes(parsed, paths=False)
    assert "path" not in short.columns
    assert sorted(map(tuple, short.collect()), key=str) == sorted(map(tuple, csaf.product_nodes(parsed).drop("path").collect()), key=str)
