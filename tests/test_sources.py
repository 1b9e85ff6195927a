import json

from pyspark.sql import functions as F

from quarrymill.sources import feeds
from quarrymill.streaming.snapshots import follow, merge, read_table


def test_osv(spark, tmp_path):
    record = {
        "id": "GHSA-1", "modified": "2024-02-01", "affected": [
            {"package": {"ecosystem": "npm", "name": "x"}, "ranges": [{"type": "SEMVER", "events": [{"introduced": "0"}, {"fixed": "1.2.0"}]}, {"type": "GIT", "events": []}]},
            {"package": {"ecosystem": "npm", "name": "y"}, "versions": ["1.0.0"]}],
    }
    (tmp_path / "a.json").write_text(json.dumps(record))
    (tmp_path / "b.json").write_text("{broken")
    (tmp_path / "c.txt").write_text("skipped")
    rows = feeds.read_osv(spark, str(tmp_path)).cache()
    assert rows.where("_corrupt_record is not null").count() == 1
    got = {(r.package_name, r.kind, r.introduced, r.fixed) for r in feeds.osv_ranges(rows.where("id is not null")).collect()}
    assert got == {("x", "semver", "0", "1.2.0"), ("y", "versions", None, None)}
    assert feeds.modified_since(rows, "2024-03-01").where("id is not null").count() == 0


def test_scores(spark, tmp_path):
    (tmp_path / "e.csv").write_text("#model\ncve,epss,percentile\nCVE-1-1,0.5,0.9\nCVE-1-2,bad,0\nother,0.1,0\n")
    assert [r.cve_id for r in feeds.read_epss(spark, str(tmp_path / "e.csv")).collect()] == ["CVE-1-1"]
    (tmp_path / "k.json").write_text(json.dumps({"vulnerabilities": [{"cveID": "CVE-1-1", "product": "p"}]}))
    assert feeds.read_kev(spark, str(tmp_path / "k.json")).first().cve_id == "CVE-1-1"


def test_oval(spark, tmp_path):
    one = '<definition id="d1" class="patch"><metadata><title>t</title><advisory><severity>Low</severity><cve cvss3="7/x">CVE-1-1</cve></advisory></metadata><criteria><criterion comment="a is earlier than 1"/></criteria></definition>'
    (tmp_path / "o.xml").write_text(f"<oval><definitions>{one}{one.replace('patch', 'other')}</definitions></oval>")
    rows = feeds.read_oval(spark, str(tmp_path / "o.xml")).collect()
    assert len(rows) == 1 and rows[0].criteria.criterion[0]._comment == "a is earlier than 1"


def test_oval_criteria_at_any_depth(spark, tmp_path):
    fix = lambda name, end: f'<criteria operator="AND"><criterion comment="{name} is earlier than {end}"/></criteria>'
    module = '<criterion comment="Module nodejs:22 is enabled" />'
    two = fix("nodejs", "1:22.23.1-2.module+el9") + fix("nodejs-devel", "1:22.23.1-2.module+el9")
    # The reference's shape: the label on level 3, the packages on level 5; the label does not hold for the sibling.
    deep = f"<criteria><criteria><criteria><criteria>{two}</criteria>{module}</criteria>{fix('rsync', '0:3.2.5-3')}{fix('rsync', '0:3.2.5-3')}</criteria></criteria>"
    deepest = "<criteria>" * 40 + fix("curl", "7-1") + '<criterion comment="bad is\n' + "</criteria>" * 40
    head = '<definition id="%s" class="%s"><metadata><title>t</title></metadata>'
    bodies = [head % ("d1", "patch") + deep, head % ("d2", "patch") + deepest, head % ("d3", "other") + deep, head % ("d4", "patch")]
    (tmp_path / "o.xml").write_text("<oval><definitions>" + "\n".join(b + "</definition>" for b in bodies) + "</definitions></oval>")
    got = sorted(tuple(r) for r in feeds.oval_fixes(spark, str(tmp_path / "o.xml")).select("id", "package", "version_end", "module", "version_start").collect())
    assert got == [
        ("d1", "nodejs", "22.23.1-2.module+el9", "22", "22.0"),
        ("d1", "nodejs-devel", "22.23.1-2.module+el9", "22", "22.0"),
        ("d1", "rsync", "3.2.5-3", None, None),
        ("d2", "curl", "7-1", None, None),
    ]


def test_oval_advisories(spark):
    fix = '<criteria><criterion comment="openssl is earlier than 1:3.0.7-1"/></criteria>'
    head = lambda ident, body: f'<definition id="{ident}" class="patch"><metadata><title>T</title>{body}</metadata>'
    elsa = "oval:com.oracle.elsa:def:20241"
    rows = [
        (elsa, head(elsa, "<advisory><severity>LOW</severity><cve cvss3='x/y'>CVE-1-1</cve></advisory>") + fix),  # the id from the definition's
        ("d2", head("d2", '<reference source="elsa" ref_id="ELSA-7" ref_url="u"/>') + fix),  # no CVE
        ("d3", head("d3", "") + fix),  # no id
        ("d4", head("d4", '<reference source="elsa" ref_id="ELSA-8"/>') + "<criteria/>"),  # no package
        ("d5", '<definition id="d5" class="patch">' + fix),  # no metadata
    ]
    made = feeds.oval_advisories(spark.createDataFrame(rows, "id string, text string"), "oracle-linux")
    got = sorted((r.external_id, r.cve_id, r.score, r.severity, r.url, [(p.vendor, p.product, p.version_end) for p in r.products]) for r in made.collect())
    product = [("oracle-linux", "openssl", "3.0.7-1")]
    assert got == [("ELSA-2024-1/CVE-1-1", "CVE-1-1", None, "LOW", None, product), ("ELSA-7", None, None, None, "u", product)]
    none = spark.createDataFrame([], "id string, text string")
    assert feeds.advisory_ranges(feeds.oval_advisories(none, "red-hat")).count() == 0
    fixed = made.limit(1).withColumn("products", F.transform("products", lambda p: p.withField("version_end", F.lit(None).cast("string")).withField("version_fixed", F.lit("2.0"))))
    assert feeds.advisory_ranges(fixed).first().version_end_int == 2_000_000_000


def test_totals_of_nothing(spark):
    from quarrymill.operators import master

    got = master.totals(spark.createDataFrame([], "product string, tp long, fp long, fn long")).first()
    assert (got.versions, got.tp, got.precision, got.recall, got.f1, got.passed, got.failed) == (0, 0, 1.0, 1.0, 1.0, 0, 0)
    worst = master.totals(spark.createDataFrame([("a", 0, 1, 1), ("b", 0, 0, 0)], "product string, tp long, fp long, fn long")).first()
    assert (worst.precision, worst.recall, worst.f1, worst.passed, worst.failed) == (0.0, 0.0, 0.0, 1, 1)


def test_follow(spark, tmp_path):
    src, table = tmp_path / "in", str(tmp_path / "t")
    src.mkdir()
    (src / "1.json").write_text('{"id": "a", "v": 1}\n{"id": "b", "v": 1}\n')
    args = (spark, str(src), "id string, v int", "id", table, str(tmp_path / "c"))
    follow(*args)
    (src / "2.json").write_text('{"id": "b", "v": 2}\n{"id": "c", "v": 2}\n')
    follow(*args)
    assert {tuple(r) for r in read_table(spark, table).select("id", "v").collect()} == {("a", 1), ("b", 2), ("c", 2)}


def test_a_batch_rewrites_only_its_buckets(spark, tmp_path):
    table = str(tmp_path / "t")
    rows = lambda ids, v: spark.createDataFrame([(f"k{i}", v, v) for i in ids], "id string, modified int, v int")
    have = lambda: {r.id: r.v for r in read_table(spark, table).collect()}
    files = lambda n: {f.parent.name: f.stat().st_mtime_ns for f in (tmp_path / "t" / f"v{n}").glob("bucket=*/*.parquet")}
    merge(spark, table, rows(range(400), 1), 0, "id", "modified", buckets=16)
    first = files(0)
    assert len(first) == 16 and len(have()) == 400
    merge(spark, table, rows([3, 7, 3], 2), 1, "id", "modified", buckets=16)
    assert 1 <= len(files(1)) <= 2 and files(0) == first
    assert have() == {f"k{i}": 2 if i in (3, 7) else 1 for i in range(400)}
    # An older record changes nothing; a repeated batch gives the same table.
    merge(spark, table, rows([7], 0).unionByName(rows([500], 3)), 2, "id", "modified", buckets=16)
    again = have()
    assert again["k7"] == 2 and again["k500"] == 3 and len(again) == 401
    merge(spark, table, rows([7], 0).unionByName(rows([500], 3)), 2, "id", "modified", buckets=16)
    assert have() == again
    assert {r.id for r in read_table(spark, table, before=2).collect()} == {f"k{i}" for i in range(400)}
    # A batch that was stopped before its commit is not seen.
    rows([1], 9).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{table}/v3")
    assert have() == again
    assert read_table(spark, str(tmp_path / "none")) is None


def test_nvd_records(spark):
    from quarrymill.sources import nvd

    low = '{"vulnerable": true, "criteria": "cpe:2.3:a:v:deep:%s:%s:*:*:*:*:*:*"%s}'
    match = [low % ("1.0", "rc3", ', "versionStartIncluding": "1.0", "versionEndIncluding": "1.0"'), low % ("2.0", "*", ""), low % ("3.0", "rc", ', "versionEndExcluding": "3.0"'), '{"vulnerable": true, "criteria": "cpe:2.3:a:*:x"}']
    text = '{"id": "A", "configurations": [{"nodes": [{"children": [{"children": [{"cpeMatch": [%s]}]}]}]}, {"nodes": null}]}' % ", ".join(match)
    rows = spark.createDataFrame([(text,), ('{"id": "B"}',)], "t string").selectExpr(f"from_json(t, '{nvd.SCHEMA}') r").select("r.*")
    got = sorted((r.start_including or "", r.end_including or "", r.end_excluding or "") for r in nvd.affected(rows).collect())
    assert got == [("", "", "3.0"), ("1.0-rc3", "1.0-rc3", ""), ("2.0", "2.0", "")]
    assert [tuple(r) for r in rows.select(nvd.cvss(rows.metrics).isNull(), nvd.english(rows.descriptions).isNull()).collect()] == [(True, True)] * 2


def test_masters_from_all_sources(spark):
    from quarrymill.operators import resolve

    def of(*rows):
        return spark.createDataFrame(rows, "source_id string, cve_id string, severity string, summary string, published_at timestamp, modified_at timestamp")

    osv = of(("O2", "C1", "HIGH", "two", None, None), ("O1", "C1", None, "one", None, None), ("O3", None, "LOW", None, None, None))
    nvd = of(("C2", "C2", None, "n", None, None))
    adv = of(("A1", "C1", "LOW", "adv", None, None), ("A1", None, "LOW", "x", None, None), ("A1", None, "LOW", "y", None, None), ("A2", "C2", "LOW", "z", None, None))
    got = {r.master_key: (r.osv_id, r.advisory_id, r.severity, r.summary, r.n_records) for r in resolve.resolve(osv, nvd, adv).collect()}
    assert got == {"C1": ("O1", None, "HIGH", "one", 3), "C2": (None, None, None, "n", 2), "O3": ("O3", None, "LOW", None, 1), "A1": (None, "A1", "LOW", "x", 2)}
    assert resolve.resolve(of(), of(), of()).count() == 0


def test_newest_record_wins(spark):
    from quarrymill.streaming.snapshots import newest

    rows = spark.createDataFrame([("a", 2, "old"), ("a", 3, "new"), ("b", None, "x"), ("b", 1, "y"), ("c", 5, "z")], "id string, modified int, v string")
    assert {r.id: r.v for r in newest(rows, "id", "modified").collect()} == {"a": "new", "b": "y", "c": "z"}


def test_scores_of_repeated_and_lost_ids(spark):
    from quarrymill.operators import master

    m = spark.createDataFrame([(1, "C1", 5), (2, "C2", 6), (3, None, None)], "no int, cve_id string, score_milli int")
    e = spark.createDataFrame([("C1", 7), ("C1", 3)], "cve_id string, score_milli int")
    assert {r.no: r.score_milli for r in master.apply_epss(m, e).collect()} == {1: 7, 2: 6, 3: None}


def test_batch_cap(spark):
    from quarrymill.operators import matching

    rows = spark.createDataFrame([(k % 2, k) for k in range(10)], "request_id int, vuln_no int")
    assert sorted(tuple(r) for r in matching.first_per_request(rows, 2).collect()) == [(0, 0), (0, 2), (1, 1), (1, 3)]


def test_names_of_a_feed(spark):
    from quarrymill.functions import ecosystems as E

    rows = spark.createDataFrame([("cpe:2.3:h:acme:box:1:*",), ("cpe:2.3:o:acme:-:1:*",), ("cpe:2.3:a:*:x:1:*",), ("cpe:2.3:a:acme:x:-:*",)], "c string")
    got = [r.p and (r.p.product, r.p.version) for r in rows.select(E.parse_listed_cpe(rows.c).alias("p")).collect()]
    assert got == [None, ("-", "1"), None, ("x", None)]


def test_long_numbers(spark):
    from pyspark.sql import functions as F

    from quarrymill.functions import versions as V

    r = spark.range(1).select(
        V.bump_patch(F.lit("1.2.12345678901"), 1).alias("a"), V.bump_last_number(F.lit("v" + "9" * 20 + "x"), 1).alias("b"),
        V.compare(V.rpm_evr(F.lit("1" + "0" * 18 + ":1")), V.rpm_evr(F.lit("9" * 18 + ":1"))).alias("c"), V.compare(V.rpm_key(F.lit("9" * 1000)), V.rpm_key(F.lit("9" * 200))).alias("d"),
    ).first()
    assert tuple(r) == ("1.2.12345678902", "v1" + "0" * 20 + "x", 1, 1)
