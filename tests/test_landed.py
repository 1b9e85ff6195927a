import io
import json
import zipfile
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from quarrymill.sources import archives, nvd, nvd_pages


def land(folder, start, idents, total):
    at = folder / f"start={start}"
    at.mkdir(parents=True, exist_ok=True)
    (at / "page.json").write_text(json.dumps({"totalResults": total, "startIndex": start, "vulnerabilities": [{"cve": {"id": i, "descriptions": [{"lang": "en", "value": i}]}} for i in idents]}))


def ms(text):
    return nvd_pages.millis(datetime.fromisoformat(text).replace(tzinfo=UTC))


def test_windows():
    date = lambda t: datetime.fromisoformat(t).replace(tzinfo=UTC)
    got = nvd_pages.windows(date("2024-01-01"), date("2024-09-01"))
    assert [str(a)[:23] for a, _ in got] == ["2024-01-01 00:00:00+00:", "2024-04-30 00:00:00.001", "2024-08-28 00:00:00.002"]
    assert got[-1][1] == date("2024-09-01")
    assert nvd_pages.windows(date("2024-01-01"), date("2024-01-01")) == []


def test_retry():
    calls = []

    def get(errors):
        calls.append(1)
        if errors:
            raise errors.pop(0)
        return "page"

    assert nvd_pages.with_retry(lambda e=[TimeoutError(), ConnectionResetError()]: get(e), wait=0) == "page"
    assert len(calls) == 3
    with pytest.raises(TimeoutError):
        nvd_pages.with_retry(lambda e=[TimeoutError()] * 3: get(e), wait=0)
    with pytest.raises(KeyError):
        nvd_pages.with_retry(lambda e=[KeyError("a"), None]: get(e), wait=0)
    assert len(calls) == 7


def test_pages_of_windows(spark, tmp_path):
    first, second = tmp_path / f"window={ms('2024-01-01')}", tmp_path / f"window={ms('2024-04-30') + 1}"
    land(first, 0, ["A", "B"], 5)
    land(first, 2, ["C", "D"], 5)
    land(first, 4, ["E"], 5)
    land(second, 0, ["F"], 1)
    read = lambda end: nvd_pages.read_windows(spark, f"file://{tmp_path}", "2024-01-01", end)
    rows = read("2024-12-01")  # the third window has no page
    assert sorted((r.id, r.start_index) for r in rows.collect()) == [("A", 0), ("B", 1), ("C", 2), ("D", 3), ("E", 4), ("F", 0)]
    assert rows.rdd.getNumPartitions() == 3
    assert read("2024-02-01").count() == 5
    assert read("2023-01-01").count() == 0
    assert sorted(r.summary for r in nvd_pages.records(rows).select(nvd.english(F.col("descriptions")).alias("summary")).collect()) == list("ABCDEF")
    (first / "start=4" / "page.json").unlink()
    with pytest.raises(Exception, match="start=4"):
        read("2024-02-01").count()


def test_lost_connections(spark, tmp_path):
    class Flaky(nvd_pages.NvdPages):
        @classmethod
        def name(cls):
            return "flaky_pages"

        def open_page(self, index, window):
            tries = tmp_path / f"try-{index}"
            n = len(tries.read_text()) if tries.exists() else 0
            tries.write_text("x" * (n + 1))
            if n < 2:
                raise ConnectionResetError
            return {"totalResults": 2, "vulnerabilities": [{"cve": {"id": str(index)}}]}

    spark.dataSource.register(Flaky)
    rows = spark.read.format("flaky_pages").option("path", "file:///none").option("start", "2024-01-01").option("end", "2024-02-01").option("wait", "0").load()
    assert sorted(r.id for r in rows.collect()) == ["0", "1"]


def test_stopped_reads_go_on(spark, tmp_path):
    pages, target, checkpoint = tmp_path / "pages", f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint"
    follow = lambda: nvd_pages.follow_pages(spark, f"file://{pages}", target, checkpoint, page_size=3)
    have = lambda: sorted((r.start_index, r.id) for r in spark.read.parquet(target).collect())
    land(pages, 0, ["a", "b", "c"], 8)
    land(pages, 3, ["d"], 8)
    follow()
    assert have() == list(enumerate("abcd"))
    land(pages, 3, ["d", "e", "f"], 8)  # the page has grown since
    land(pages, 9, ["j"], 10)  # a page that nothing leads to yet
    follow()
    assert have() == list(enumerate("abcdef"))
    follow()
    land(pages, 6, ["g", "h", "i"], 10)
    (pages / "start=3" / "page.json").write_text("not read again")
    follow()
    assert have() == list(enumerate("abcdefghij"))


def test_a_failed_batch_is_read_again(spark, tmp_path):
    pages, seen = tmp_path / "pages", []
    for start in (0, 2, 4):
        land(pages, start, [str(start), str(start + 1)], 6)
    spark.dataSource.register(nvd_pages.NvdPages)

    def sink(batch, _):
        rows = [r.id for r in batch.collect()]
        if not seen:
            seen.append("failed")
            raise RuntimeError("stopped")
        seen.extend(rows)

    def run():
        rows = spark.readStream.format("nvd_pages").option("path", f"file://{pages}").option("pageSize", 2).load()
        rows.writeStream.foreachBatch(sink).option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()

    with pytest.raises(Exception, match="stopped"):
        run()
    run()
    assert sorted(seen[1:]) == list("012345")


def test_nodes_of_any_depth(spark):
    node = {"cpeMatch": [{"vulnerable": True, "criteria": "cpe:2.3:a:v:deep:1.0:*:*:*:*:*:*:*"}, {"vulnerable": False, "criteria": "cpe:2.3:a:v:no:1.0:*:*:*:*:*:*:*"}]}
    for k in range(19):
        node = {"operator": "AND", "children": [node, {"cpeMatch": [{"vulnerable": True, "criteria": f"cpe:2.3:a:v:p{k}:{k}.0:*:*:*:*:*:*:*"}]}]}
    text = json.dumps({"id": "X", "configurations": [{"nodes": [node]}, {"nodes": [node]}, {}]})
    rows = spark.createDataFrame([(text,), ('{"id": "Y"}',), ('{"id": "Z", "configurations": []}',)], "t string").selectExpr(f"from_json(t, '{nvd.SCHEMA}') r").select("r.*")
    got = sorted((r.id, r.package_name, r.end_including) for r in nvd.affected(rows).collect())
    assert got == sorted([("X", "deep", "1.0"), *(("X", f"p{k}", f"{k}.0") for k in range(19))] * 2)


def record(ident, modified=None, name="p"):
    return json.dumps({"id": ident, "affected": [{"package": {"ecosystem": "npm", "name": name}}]} | ({"modified": modified} if modified else {}))


def test_archives(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archives, "GROUP_BYTES", 200)
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for k in range(40):
            z.writestr(f"A-{k}.json", record(f"A-{k}", f"2024-01-{k % 28 + 1:02d}T00:00:00Z", f"p{k % 2}"))
        z.writestr("notes.txt", "skipped")
        z.writestr("bad.json", '{"id": ')
        z.writestr("latin.json", b'{"id": "\xff"}')
        z.writestr("no-id.json", "{}")
        z.writestr("undated.json", record("U"))
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr(archives.MALWARE + "npm/M-1.json", record("M-1", "2024-03-01T00:00:00Z"))
        z.writestr("other/M-2.json", record("M-2"))
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("crc.json", record("broken"))
        z.writestr("fine.json", record("fine"))
    damaged = raw.getvalue().replace(b"broken", b"BROKEN", 1)
    (tmp_path / "c.zip").write_bytes(damaged)
    (tmp_path / "d.zip").write_bytes(b"no archive")
    entries = archives.zip_entries(spark, f"file://{tmp_path}/*.zip")
    counts = lambda *a: tuple(archives.archive_counts(*a).first())
    assert counts(entries) == (49, 44, 0, 5)
    assert counts(entries, "2024-01-27T00:00:00Z") == (49, 5, 39, 5)
    got = archives.archive_records(entries)
    assert sorted(r.id for r in got.collect()) == sorted(["M-1", "M-2", "U", "fine", *(f"A-{k}" for k in range(40))])
    assert [r.id for r in archives.by_id(got, "A-7").collect()] == ["A-7"]
    assert archives.by_package(got, "npm", "p1").count() == 20
    assert archives.by_package(got, "npm").count() == 44
    malware = archives.zip_entries(spark, f"file://{tmp_path}/*.zip", prefix=archives.MALWARE)
    assert [(r.id, r.modified) for r in archives.archive_records(malware, "2024-02-01T00:00:00Z").collect()] == [("M-1", "2024-03-01T00:00:00Z")]
    assert counts(malware) == (2, 1, 0, 1)
