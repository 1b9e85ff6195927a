import json
import random

import pytest
from pyspark.sql import functions as F

from quarrymill.functions import constraints as C
from quarrymill.functions.versions import normalize_version
from quarrymill.operators import jobs, resolve, sweeps

c = F.col


def sets(spark, parse, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", parse(c("t")).alias("s")).orderBy("i").collect()
    low = lambda x: None if x == C.LEAST else x / 1e9
    high = lambda x: None if x == C.MOST else x / 1e9
    return [r.s and [(low(x.lo), high(x.hi)) for x in r.s] for r in rows]


def test_npm_constraints(spark):
    texts = ["20.x || 18.x", "^20.11.1 || ^18.20.1", "^0.2.3", "^0.0.3", "~1.2.3", "~1", ">=1.2 <2", "1.2.3", "*", "", "1.2 - 2.3", ">1.2", "latest", None, "1.x || >=1.5 <3 || 2.9.9", ">3 <2", "1.2.3 || nonsense 4"]
    assert sets(spark, C.npm_intervals, *texts) == [
        [(18.0, 19.0), (20.0, 21.0)], [(18.020001, 19.0), (20.011001, 21.0)], [(0.002003, 0.003)], [(0.000003, 0.000004)], [(1.002003, 1.003)], [(1.0, 2.0)], [(1.002, 2.0)], [(1.002003, 1.002003001)],
        [(None, None)], [(None, None)], [(1.002, 2.004)], [(1.003, None)], [], [], [(1.0, 3.0)], [], [(1.002003, 1.002003001)],
    ]


def test_vers_constraints(spark):
    texts = ["vers:npm/>=1.0|<2.0|!=1.5|3.1", "vers:g/<12.1.4", "vers:g/>=11.2.10", "vers:g/*", "vers:g/!=1.0", "vers:g/<1|>=2|<3|>4", "vers:g/2.0|1.0", "nope", "vers:g/>=1234567.0", "vers:g/>=1|>=2|<3", None]
    assert sets(spark, C.vers_intervals, *texts) == [
        [(1.0, 1.005), (1.005000001, 2.0), (3.001, 3.001000001)], [(None, 12.001004)], [(11.00201, None)], [(None, None)], [(None, 1.0), (1.000000001, None)], [(None, 1.0), (2.0, 3.0), (4.000000001, None)],
        [(1.0, 1.000000001), (2.0, 2.000000001)], None, None, [(1.0, 3.0)], None,
    ]


def test_interval_algebra(spark):
    rng = random.Random(1)
    some = lambda: [(a, a + rng.randint(0, 6)) for a in (rng.randint(0, 40) for _ in range(rng.randint(0, 5)))]
    rows = [(i, some(), some()) for i in range(60)]
    df = spark.createDataFrame(rows, f"i int, a {C.TYPE}, b {C.TYPE}").select("i", "a", "b", C.union(c("a")).alias("u"), C.union(c("b")).alias("v"))
    got = df.select("i", C.union(c("a"), c("b")).alias("union"), C.intersection(c("u"), c("v")).alias("both"), C.difference(c("u"), c("v")).alias("less"), C.covers(c("u"), c("v")).alias("covers"), C.holds(c("u"), F.lit(7)).alias("seven")).collect()
    points = lambda x: {p for lo, hi in x for p in range(max(lo, -5), min(hi, 60))}
    for r in got:
        a, b = map(points, rows[r.i][1:])
        assert points(r.union) == a | b and points(r.both) == a & b and points(r.less) == a - b
        assert r.covers == (b <= a) and r.seven == (7 in a)
        for s in (r.union, r.both, r.less):
            assert all(x.hi < y.lo for x, y in zip(s, s[1:], strict=False)) and all(x.lo < x.hi for x in s)


INDEX = "cve array<string>, vulnerable string, patched string"


def test_releases(spark):
    index = spark.createDataFrame(
        [(["CVE-1", "cve-2"], "20.x || 18.x || 99.x", "^20.11.1 || ^18.20.1 || ^20.11.3"), (["CVE-3"], "16.x || 20.x", None), ([], "20.x", None), (["CVE-4"], None, "^20.1.0"), (["CVE-5"], ">=20", "^20.1.0"), (["CVE-6"], "18.x", "^20.1.0")], INDEX
    )
    entries = sweeps.release_entries(index, [16, 18, 20])
    assert sorted(map(tuple, entries.collect()), key=str) == sorted([("CVE-1", 18, "18.20.1"), ("CVE-1", 20, "20.11.3"), ("cve-2", 18, "18.20.1"), ("cve-2", 20, "20.11.3"), ("CVE-3", 16, None), ("CVE-3", 20, None), ("CVE-6", 18, None)], key=str)
    points = sweeps.release_points(entries)
    assert {r.version for r in points.collect()} == {"16.0.0", "18.0.0", "20.0.0", "18.20.1", "18.20.0", "20.11.3", "20.11.2"}
    truth = sweeps.release_truth(points, entries)
    found = {(r.version, r.cve_id) for r in truth.collect()}
    assert {v for v, i in found if i == "CVE-1"} == {"18.0.0", "18.20.0", "20.0.0", "20.11.2"} and ("16.0.0", "CVE-3") in found and ("20.11.2", "CVE-2") in found
    # Sets of intervals say the same.
    ranges = sweeps.release_ranges(entries)
    again = points.crossJoin(ranges).where(C.holds(c("affected"), normalize_version(c("version"))))
    assert {(r.version, r.cve_id) for r in again.collect()} == found


def test_first_range_decides(spark):
    ranges = spark.createDataFrame(
        [("A", 0, "1234567.0", "9.0", []), ("A", 1, "1.0", "2.0", []), ("A", 2, "1.5", None, ["0.1-odd"]), ("B", 0, None, "1.0", ["3.3"]), ("B", 1, "1.0", "1234567.0", [])], "cve_id string, pos int, introduced string, last_affected string, listed array<string>"
    )
    versions = spark.createDataFrame([("1.0",), ("1.7",), ("5.0",), ("0.1-odd",), ("odd",), ("3.3",), (None,)], "version string")
    got = {(r.version, r.cve_id): r.pos for r in sweeps.first_range_decides(versions, ranges).collect()}
    assert got == {("1.0", "A"): 1, ("1.7", "A"): 1, ("5.0", "A"): 2, ("3.3", "A"): 2, ("0.1-odd", "A"): 2, ("1.0", "B"): 1, ("1.7", "B"): 1, ("5.0", "B"): 1, ("3.3", "B"): 0}
    opened = {(r.version, r.cve_id): r.pos for r in sweeps.first_range_decides(versions, ranges, open_start=True).collect()}
    assert opened[("1.7", "A")] == 0 and opened[("1.0", "B")] == 0 and opened[("5.0", "A")] == 0


def test_segments(spark):
    pages = spark.createDataFrame([(1, "head Affects: 1 middle Affects: 2 end"), (2, "none"), (3, "Affects: 3"), (4, None)], "id int, html string")
    got = [(r.id, r.nth, r.before, r.hit) for r in sweeps.segments(pages, "Affects:").orderBy("id", "nth").collect()]
    assert got == [(1, 0, "head ", "Affects: 1 middle "), (1, 1, "Affects: 1 middle ", "Affects: 2 end"), (3, 0, "", "Affects: 3")]


def test_distro_sample(spark):
    cols = "row_id long, ecosystem string, package_name string, id string, versions array<string>, introduced_version string, fixed_version string, last_affected_version string"
    rows = [(k, "Debian:12" if k % 3 else "npm", f"p{k}", f"V{k}" if k % 5 else None, ["1.0", "2.0"] if k % 2 else [], "0", None if k % 4 else f"1.{k}", "3.9" if k % 8 == 2 else None) for k in range(100)]
    affected = spark.createDataFrame(rows, cols).repartition(5)
    points = sweeps.distro_points(affected, "Debian", size=10)
    listed = [r for r in rows if r[1] == "Debian:12" and r[4]][:10]
    ranged = [r for r in rows if r[1] == "Debian:12" and not r[4]][:10]
    want = [(r[0], "1.0", True) for r in listed if r[3]]
    for r in ranged:
        if r[3] and r[6]:
            want += [(r[0], r[6], False), *([(r[0], f"1.{r[0] - 1}", True)] if r[0] else [])]
        elif r[3] and r[7]:
            want += [(r[0], "3.9", True), (r[0], "3.10", False)]
    assert sorted((p.row_id, p.version, p.expected) for p in points.collect()) == sorted(want)
    checked = sweeps.check_points(points, affected)
    assert checked.where("fp + fn > 0").count() == 0 and checked.count() == len(want)
    assert tuple(sweeps.totals(checked, "ecosystem").first())[1:] == (len(want), sum(e for *_, e in want), 0, 0)
    assert sweeps.check_points(points, affected.where("package_name <> 'p1'")).agg(F.sum("fn")).first()[0] == 1


def event(source, ts, job, kind, message=None, **counts):
    return (source, ts, ts * 10 + job, job, kind, message, *(counts.get(n) for n in jobs.COUNTERS))


STORY = [
    event("osv", 10, 1, "start"), event("osv", 12, 2, "start"), event("osv", 15, 1, "finish", fetched=7, inserted=3, fetch_failed=1), event("osv", 16, 2, "finish"), event("osv", 20, 3, "start"), event("osv", 22, 3, "fail", "no route"),
    event("nvd", 5, 4, "start"), event("nvd", 150, 5, "start"), event("nvd", 151, 4, "finish"), event("nvd", 152, 5, "cancel"), event("kev", 140, 6, "start"), event("epss", 1, 7, "start"), event("epss", 2, 7, "odd"),
]


def told(df):
    return sorted(((r.source, r.job_id, r.status, r.started, r.completed, r.error and r.error[:8], r.fetched, r.inserted, r.fetch_failed) for r in df.collect()), key=str)


def test_job_runs(spark):
    runs = jobs.runs(spark.createDataFrame(STORY, jobs.EVENTS).repartition(3), limit=100)
    assert told(runs) == sorted([
        ("osv", 1, "completed", 10, 15, None, 7, 3, 1), ("osv", 2, "skipped", 12, 12, None, 0, 0, 0), ("osv", 3, "failed", 20, 22, "no route", 0, 0, 0), ("nvd", 4, "timed_out", 5, 105, "no end w", 0, 0, 0),
        ("nvd", 5, "cancelled", 150, 152, None, 0, 0, 0), ("kev", 6, "running", 140, None, None, 0, 0, 0), ("epss", 7, "timed_out", 1, 101, "no end w", 0, 0, 0),
    ], key=str)
    now = {r.source: (r.job_id, r.status, r.completed, r.failed, r.skipped, r.total_fetched) for r in jobs.current(runs).collect()}
    assert now == {"osv": (3, "failed", 1, 1, 1, 7), "nvd": (5, "cancelled", 0, 0, 0, 0), "kev": (6, "running", 0, 0, 0, 0), "epss": (7, "timed_out", 0, 0, 0, 0)}
    assert jobs.runs(spark.createDataFrame([], jobs.EVENTS), 5).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_job_runs_in_a_stream(spark, tmp_path, seed):
    rng = random.Random(seed)
    events = STORY if seed == 1 else sorted((event(rng.choice("abc"), t, rng.randrange(9), rng.choice(["start", "start", "finish", "fail", "cancel"]), fetched=t) for t in range(200)), key=lambda e: e[1])
    events = sorted(events, key=lambda e: e[1])
    size, landed = len(events) // 3, tmp_path / "events"
    landed.mkdir()
    stream = spark.readStream.schema(jobs.EVENTS).json(f"file://{landed}")
    for k in range(0, len(events), size):
        rows = [dict(zip([x.split()[0] for x in jobs.EVENTS.split(", ")], e, strict=True)) for e in events[k : k + size]]
        (landed / f"{k:03d}.json").write_text("\n".join(map(json.dumps, rows)))
        q = jobs.follow_runs(stream, 30).writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start(f"file://{tmp_path}/out")
        q.awaitTermination()
    batch = jobs.runs(spark.createDataFrame(events, jobs.EVENTS), 30)
    last = {e[0]: e[1] for e in events}
    # What ends after a source's last event only the batch can know.
    ended = [r for r in told(batch) if r[2] != "running" and not (r[2] == "timed_out" and r[4] > last[r[0]])]
    assert told(spark.read.parquet(f"file://{tmp_path}/out")) == ended


def test_chains_of_renames(spark):
    renames = spark.createDataFrame([("a", "b", 1), ("b", "c", 2), ("c", "d", 3), ("d", "e", 4), ("x", "y", 9), ("y", "x", 5), ("b", "z", 8), *((f"n{k}", f"n{k + 1}", 100 + k) for k in range(20))], "old string, new string, seq long")
    links = spark.createDataFrame([("1", "a", 0), ("2", "a", 1), ("3", "b", 1), ("4", "b", 2), ("5", "c", 5), ("6", "x", 0), ("7", "y", 0), ("8", "q", 0), ("9", "n0", 0), ("10", "n5", 104)], "child string, master string, seq long")
    got = {r.child: r.end for r in resolve.follow_renames(links, renames).collect()}
    assert got == {"1": "e", "2": "a", "3": "e", "4": "z", "5": "c", "6": "y", "7": "y", "8": "q", "9": "n20", "10": "n20"}


ARRIVALS = "seq long, kind string, source string, source_id string, cve_id string, severity string, score double, vector string, summary string, published_at long, modified_at long"


def masters_by_hand(rows):
    """Records imported one by one."""
    masters, link = {}, {}
    for _, kind, source, own, cve, severity, score, vector, summary, published, modified in rows:
        key, m = cve or own, masters.get(cve or own)
        if kind == "nvd":
            masters[key] = {"severity": severity, "score": score, "vector": vector, "summary": summary, "published": m["published"] if m else published, "modified": modified}
            continue
        new = {"severity": severity, "score": score, "vector": vector if kind == "advisory" else None, "summary": summary, "published": published, "modified": modified if kind == "osv" else None}
        if m is None:
            masters[key] = new
        elif kind == "osv" and cve:
            m |= {k: new[k] if m[k] is None else m[k] for k in ("severity", "score", "summary", "published")}
            m["modified"] = max((x for x in (m["modified"], modified) if x is not None), default=None)
        elif not cve:
            masters[key] = new | ({"published": m["published"]} if kind == "osv" else {})
        before = link.get((source, own))
        if cve and before and before != key and not before.startswith("CVE"):
            for k in [k for k, v in link.items() if v == before]:
                link[k] = key
            masters.pop(before, None)
        link[source, own] = key
    return {k: tuple(v.values()) for k, v in masters.items()}, link


def test_masters_in_order_of_arrival(spark):
    rng = random.Random(6)
    pick = lambda *x: rng.choice([*x, None])
    for _ in range(4):
        rows = []
        for seq in range(300):
            kind = rng.choice(["nvd", "osv", "osv", "advisory", "advisory"])
            cve = f"CVE-{rng.randrange(6)}" if kind == "nvd" or rng.random() < 0.5 else None
            # Several vendors use one advisory id, so they share its master.
            own = cve if kind == "nvd" else f"{kind}-{rng.randrange(8)}"
            rows.append((seq, kind, f"{kind}{rng.randrange(2)}" if kind == "advisory" else kind, own, cve, pick("HIGH", "LOW"), pick(1.0, 2.0), pick("v", "w"), pick("s", "t"), pick(1, 2, 3), pick(7, 8, 9)))
        arrivals = spark.createDataFrame(rows, ARRIVALS)
        want, link = masters_by_hand(rows)
        got = {r.master_key: (r.severity, r.score, r.vector, r.summary, r.published_at, r.modified_at) for r in resolve.masters_in_order(arrivals).collect()}
        assert got == want
        last = {(r[2], r[3]): (r[4] or r[3], r[0]) for r in rows if r[1] != "nvd"}
        links = spark.createDataFrame([(f"{s}|{i}", m, q) for (s, i), (m, q) in last.items()], "child string, master string, seq long")
        ends = {r.child: r.end for r in resolve.follow_renames(links, resolve.renames_of(arrivals.where("kind <> 'nvd'"))).collect()}
        assert ends == {f"{s}|{i}": m for (s, i), m in link.items()}


def test_release_counts_make_no_pairs(spark):
    from pyspark.sql import functions as F

    from quarrymill.operators import sweeps

    rows = [("cve-1", 20, "20.5.0"), ("CVE-1", 20, "20.11.1"), ("CVE-2", 20, None), ("CVE-2", 20, "20.1.0"), ("CVE-3", 20, "20.2.0"), ("CVE-1", 18, "18.0.1"), ("CVE-3", 18, None)]
    entries = spark.createDataFrame(rows, "cve_id string, major int, patched string")
    versions = spark.createDataFrame([("20.3.0",), ("20.3.0",), ("20.11.1",), ("18.0.0",), ("16.0.0",)], "version string")
    truth = sweeps.release_truth(versions, entries)
    assert sorted(map(tuple, truth.collect())) == [("18.0.0", "CVE-1"), ("18.0.0", "CVE-3"), ("20.11.1", "CVE-2"), ("20.3.0", "CVE-1"), ("20.3.0", "CVE-2")]
    want = truth.groupBy("version").agg(F.count(F.lit(1)).alias("n_cves"), F.min("cve_id").alias("least"))
    assert sorted(map(tuple, sweeps.release_counts(versions, entries).collect())) == sorted(map(tuple, want.collect()))
