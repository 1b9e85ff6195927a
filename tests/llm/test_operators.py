import gc
import gzip
import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from quarrymill.llm import bpe, decontaminate, divergence, frequent, gru_lm, hnsw, html_text, id_files, jaccard, line_dedup, quality, ranked_search, sharding, warc
from quarrymill.llm.shingles import ascii_words, shingle_set

BPE = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, n_lines string, key string"


def docs_of(spark, rows):
    """Documents with columns whose names clash with those of results or of inner steps."""
    return spark.createDataFrame([(i, t, None, "clash", "clash") for i, t in rows], DOCS)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# 1: line dedup


def dedup_by_hand(rows, min_docs=5):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 40:
                holders[key(line)].add(i)
    gone = {k: max(v) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or key(x) not in gone or gone[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def dedup(spark, rows):
    out = line_dedup.dedup_lines(docs_of(spark, rows)).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256))
    return [tuple(r) for r in out.collect()]


def test_line_dedup(spark):
    rng = random.Random(1)
    hot, warm = "A very common line that is long enough to COUNT here", "é" * 39 + " x"
    pool = [hot, "  " + hot.lower() + "\t", warm, "short", "", "y" * 40, "Z" * 39]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 9)))) for i in range(300)]
    rows += [(None, hot), (400, None), (401, ""), (5, rows[5][1]), (402, "\n".join([hot] * 3000)), (403, "w" * 300_000)]
    assert Counter(dedup(spark, rows)) == Counter(dedup_by_hand(rows))
    assert dedup(spark, []) == []


def test_line_dedup_below_five(spark):
    line = "q" * 50
    rows = [(i, line) for i in range(4)] + [(3, line)]
    assert Counter(dedup(spark, rows)) == Counter(dedup_by_hand(rows))


def test_line_runs_cut_anywhere():
    """Partitions cut within a hot run give the same drops as one partition."""
    import pyarrow as pa

    rows = sorted([(h, 0, d, 0, p, 9) for h in range(4) for d in range(12 if h == 2 else 3 + h) for p in range(2)], key=lambda r: (r[0], -r[2], r[4]))
    names = ["h1", "h2", "doc", "ver", "pos", "n_lines"]
    batch = lambda part: pa.RecordBatch.from_pydict({n: np.array([r[k] for r in part], np.int32 if n in ("pos", "n_lines") else np.int64) for k, n in enumerate(names)})
    want = {(h, d, p) for h, _, d, _, p, _ in rows if len({r[2] for r in rows if r[0] == h}) >= 5 and d != max(r[2] for r in rows if r[0] == h)}
    for a in range(2, len(rows), 4):
        for b in range(a, len(rows) + 1, 6):
            out = []
            for part in (rows[:a], rows[a:b], rows[b:]):
                out += [r for o in line_dedup._decide(5)(batch(part[k : k + 3]) for k in range(0, len(part), 3)) for r in o.to_pylist()]
            docs, top = Counter(), defaultdict(int)
            for r in out:
                if r["kind"] == line_dedup.SUMMARY:
                    docs[r["h1"]] += r["docs"]
                    top[r["h1"]] = max(top[r["h1"]], r["doc"])
            got = {(r["h1"], r["doc"], r["pos"]) for r in out if r["kind"] == line_dedup.DROP}
            got |= {(r["h1"], r["doc"], r["pos"]) for r in out if r["kind"] == line_dedup.OPEN and docs[r["h1"]] >= 5 and r["doc"] != top[r["h1"]]}
            assert got == want


# 2: WARC


def test_warc(spark, tmp_path):
    big = "<p>ü" + "x" * 200
    rows = [(1, "u", big), (2, None, big), (3, "u\nv", "small"), (4, "u", "small"), (5, "u", None), (6, "", ""), (None, "u", big), (7, "u", "y" * 200_000), (2, "u", big)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, archive string")
    root = f"file://{tmp_path}/w"
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_pages(pages, root).collect())
    want = Counter()
    for i, _, h in rows:
        h = h or ""
        again = h == big and i != 1
        want[i, len(h.encode()), sha(h), "revisit" if again else "response", 1 if again else None] += 1
    assert got == want
    name = next((tmp_path / "w").glob("*.warc.gz"))
    offset, size, _ = __import__("json").loads((tmp_path / "w" / f"{name.name}.idx").read_text().splitlines()[-1])
    assert gzip.decompress(name.read_bytes()[offset : offset + size]).startswith(b"WARC/1.1\r\n")
    assert offset + size == name.stat().st_size
    assert warc.archive_pages(pages.where("false")).count() == 0


def test_warc_tasks_can_be_repeated(spark, tmp_path):
    raw_root, root = f"file://{tmp_path}/raw", f"file://{tmp_path}"
    pages = spark.createDataFrame([(k, "u", "<p>" + "x" * 300) for k in range(5)], "page_id long, url string, html string").coalesce(1)
    raw = pages.mapInArrow(warc._write_raw(raw_root), warc._RAW).toPandas()
    raw["refers_to"] = [None, 0, 0, 0, 0]
    first = warc._normalise(raw_root, root)(raw)
    name = tmp_path / first["archive"][0]
    before = name.read_bytes()
    assert warc._normalise(raw_root, root)(raw).equals(first) and name.read_bytes() == before
    assert {p.name for p in tmp_path.iterdir()} == {"raw", name.name, name.name + ".idx"}


def test_warc_member_layouts():
    records = [warc.record("response", k, None, hashlib.sha256(b"%d" % k).digest(), 9, b"\r\n\r\nWARC/1" + b"%d" % k) for k in range(5)]
    for data in (gzip.compress(b"".join(records)), b"".join(map(gzip.compress, records))):
        import io

        assert [p for _, _, p in warc.Stream(io.BytesIO(data))] == [b"\r\n\r\nWARC/1%d" % k for k in range(5)]


# 3: BPE


def test_cuts_are_certain():
    """Every cut stays one whatever follows: both sides' encodings make up the whole one."""
    tok, rng = bpe.load(BPE), random.Random(5)
    chars = "aZé漢がя09 \n\u3000'!?.,_~。\u0301s"
    for _ in range(3000):
        text = "".join(rng.choice(chars) for _ in range(rng.randint(2, 12)))
        for m in bpe.CUT.finditer(text):
            parts = [tok.encode(x, add_special_tokens=False).ids for x in (text, text[: m.start()], text[m.start() :])]
            assert parts[0] == parts[1] + parts[2], text


def test_long_documents_take_the_tree(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    long = docs.where(F.length("text") > bpe.LONG_CHARS).count()
    tok = bpe.load(BPE)
    seen = []
    real = bpe.materialise
    monkeypatch.setattr(bpe, "materialise", lambda df, name: seen.append(real(df, name)) or seen[-1])
    got = {r.doc_id: r.ids_sha256 for r in bpe.encode_documents(docs, BPE, keep=["doc_id"]).collect()}
    assert seen[0].where("__uid is not null").select("__uid").distinct().count() == long >= 40
    for r in docs.collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids
        assert got[r.doc_id] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_tree_concatenation(monkeypatch):
    tok, rng = bpe.load(BPE), random.Random(2)
    parts = ["abc", "the", "aaaa", "  ", "\n", " ", "'s", "'", "12", "é", "!!", "<|endoftext|>", "漢", "x" * 30, "ion"]
    for _ in range(300):
        some = rng.sample(parts, rng.randint(1, 6))
        text = "".join(rng.choice(some) for _ in range(rng.choice([5, 60, 300])))
        for limit, short in ((7, 2048), (33, 2048), (7, 4), (33, 9)):
            monkeypatch.setattr(bpe, "SHORT_WORD", short)  # words above it are put together from tokens
            assert bpe.encode_tree(tok, text, limit) == tok.encode(text, add_special_tokens=False).ids


def test_bpe_quick_encoder_on_every_code_point():
    """Both libraries split and merge alike, whatever the characters' classes."""
    tok, step = bpe.load(BPE), 4096
    for start in range(0, 0x110000, step):
        chars = [chr(c) for c in range(start, start + step) if not 0xD800 <= c < 0xE000]
        texts = ["".join(f"!{c}a{c}1{c} {c}?\n" for c in chars[i : i + 16]) for i in range(0, len(chars), 16)]
        mine = bpe.encode_texts(BPE, texts)
        assert [i.tolist() for i in mine] == [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
        assert bpe.decode_texts(BPE, mine) == texts


def test_bpe_quick_encoder_on_special_cases():
    tok = bpe.load(BPE)
    texts = ["<|endoftext|>a<|endoftext|>", "", "a" * 40000 + " b", " " * 40000, "<|endoftext", "e\u0301 \U0001f600"]
    mine = bpe.encode_texts(BPE, texts)
    assert [i.tolist() for i in mine] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert bpe.decode_texts(BPE, mine) == texts
    odd = "!\x1c" * 3000 + " ab" * 3000 + "\u3000x"
    assert bpe.encode_tree(tok, odd, 100) == tok.encode(odd, add_special_tokens=False).ids


def test_bpe_documents(spark, monkeypatch):
    tok = bpe.load(BPE)
    rows = [(1, "Hello <|endoftext|> world's"), (2, None), (3, ""), (4, "ab" * 3000 + " end of it " * 50), (4, "q" * 9000), (4, "q" * 9000), (None, "é　x")]
    out = bpe.encode_documents(docs_of(spark, rows), BPE, keep=["doc_id"], with_ids=True, whole_chars=500, segment_chars=100)
    got = Counter((r.doc_id, r.n_tokens, tuple(r.ids), r.ids_sha256, r.decoded_sha256) for r in out.collect())
    want = Counter()
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), tuple(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha(t or "")] += 1
    # A null id matches no row when long texts are put together, but this one is short.
    assert got == want
    assert bpe.encode_documents(docs_of(spark, []), BPE).count() == 0


# 4: quality


def test_quality(spark):
    rng = random.Random(4)
    words = "the of and to in reading water stone under light".split()
    good = [(i, " ".join(rng.choice(words) for _ in range(60)) + ".") for i in range(120)]
    bad = [(i + 200, " | ".join(rng.choice(words).upper() + "!!" for _ in range(60))) for i in range(60)]
    rows = [*good, *bad, (900, None), (901, ""), (900, "again"), (None, "the of")]
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad] + [(900, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.score_documents(docs_of(spark, rows), labels, keep=["doc_id", "lang"]).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    held = [r for r in got if r.doc_id is not None and r.held_out and r.doc_id < 300]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert held and all(r.predicted == (r.doc_id < 200) for r in held)
    kept = quality.keep_good(docs_of(spark, good + bad), labels)
    assert kept.columns == docs_of(spark, []).columns and {r.doc_id for r in kept.collect()} >= {i for i, _ in good}
    none = quality.score_documents(docs_of(spark, rows[:3]), labels.where("false"))
    assert [r.score for r in none.collect()] == [0.5] * 3
    assert quality.score_documents(docs_of(spark, []), labels).count() == 0


def test_quality_votes_by_hand(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(40)]
    rows = [(k, " ".join(rng.choice(words[: 25 + 15 * (k % 2)]) for _ in range(rng.randint(1, 30)))) for k in range(160)]
    rows += [(1000 + k, rows[k % 3][1]) for k in range(60)] + [(2000, None), (2001, ""), (2002, "w1 " * 50_000)]
    labels = spark.createDataFrame([(k, (k * 7 + k // 3) % 2) for k, _ in rows if k % 3], "doc_id long, quality int")
    docs = docs_of(spark, rows)
    model = quality.fit(docs, labels, sample=100)
    assert len(model["y"]) == 100
    got = {r.doc_id: r.score for r in quality.score_documents(docs, labels, keep=["doc_id"], model=model).collect()}
    ties = 0
    for k, text in rows:
        z = quality.Features().row((text or "").encode()) @ model["projection"]
        want = model["prior"]
        if np.linalg.norm(z) > 1e-9:
            cosine = np.round([float(np.dot(z / np.linalg.norm(z), v)) for v in model["vectors"]], 5)
            near = sorted(range(len(cosine)), key=lambda i: (-cosine[i], i))[: quality.NEIGHBOURS]
            ties += sum(c == cosine[near[-1]] for c in cosine) > 1
            weight = [min(1, max(1e-6, cosine[i])) ** quality.POWER for i in near]
            want = sum(w * model["y"][i] for w, i in zip(weight, near)) / sum(weight)
        assert abs(got[k] - want) < 0.02, k
    assert ties
    assert quality.score_documents(docs.where("false"), labels, keep=["doc_id"], model=model).count() == 0


def test_quality_ties_go_to_the_first():
    cosine = np.concatenate((np.linspace(0.9, 0.8, 10), np.full(3990, 0.5)))[None]
    assert sorted(quality._nearest(cosine, 25)[0]) == list(range(25))


# 5: HTML


def test_html():
    page = """<!DOCTYPE html><title>T</title><script>var t="</p>";</script><nav><a href=x>Menu</a></nav><div class="ad">Buy the best of it now</div>
    <article><header>By line</header><h1>Head &amp; line</h1><p><b>It was a long day for the men of the sea and of the hills,
    who had been out.<br>Then <i>it</i> rained&nbsp;on.<p>Short.</p><ul><li><a href=y>one more link</a></li></ul><div id="comments">I liked the text</div></article><footer>&copy; the end</footer>"""
    assert html_text.extract(page) == "Head & line It was a long day for the men of the sea and of the hills, who had been out. Then it rained on. Short."
    plain = "<body><p>Of</p><p>" + "the men of the sea and of the hills " * 3 + "</p><p>" + "<a>home page</a> " * 9 + "</p></body>"
    assert html_text.extract(plain) == "Of " + ("the men of the sea and of the hills " * 3).strip()
    for odd in ("", "<", "<p", "a < b", "<!--", "<script>", "<p class='", "</div>" * 50, "<div>" * 5000):
        html_text.extract(odd)


class Article(HTMLParser):
    """Text of an article's blocks, by the standard library's parser."""

    def __init__(self, page):
        super().__init__()
        self.inside, self.blocks = 0, [""]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.blocks += [""] if tag not in ("b", "br") else []
        self.blocks[-1] += " " if tag == "br" else ""

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        self.blocks += [""] if tag != "b" else []

    def handle_data(self, data):
        self.blocks[-1] += data if self.inside else ""


def labels_by_hand(found):
    """The block rules, looking at every pair of blocks."""
    words = [re.findall(r"[^\W\d_]+", b.text.lower()) for b in found]
    dense = [sum(x in html_text.STOP_WORDS for x in w) / len(w) if w else 0 for w in words]
    first = []
    for b, d in zip(found, dense, strict=True):
        good = d > 0 if b.article else len(b.text) >= 70 and d >= 0.15
        first.append(False if b.links > (0.1 if b.menu else 0.5) else True if good and not b.menu else None)
    side = [(b.article, b.menu) for b in found]
    edges = lambda i, j: sum(side[k] != side[k + 1] for k in range(min(i, j), max(i, j)))
    second = list(first)
    for i, b in enumerate(found):
        if first[i] is not None:
            continue
        own = [j for j in range(len(found)) if not edges(i, j)]
        near = {j: abs(i - j) + 50 * edges(i, j) for j in range(len(found)) if first[j] is not None}
        ahead = min((j for j in near if j > i), default=None)
        least = {first[j] for j in near if near[j] == min(near.values())}
        if b.heading and ahead is not None and near[ahead] < 50:
            second[i] = first[ahead]
        elif b.article and not b.menu and all(first[j] is None for j in own) and len({w for j in own for w in words[j]}) < 150:
            second[i] = True
        else:
            second[i] = False if not least else b.article or dense[i] > 0 if len(least) == 2 else least.pop()
    return first, second


def test_html_rules_by_hand():
    rng = random.Random(8)
    kinds = ["the men of the sea and of the hills " * 3, "xq zv " * 20, "short", "a b", " ".join(f"q{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200))]
    for _ in range(800):
        sides = [(False, True), (False, False), (True, False), (True, True), (True, False), (False, False)]
        found = [html_text.Block(rng.choice(kinds), rng.choice((0.0, 0.0, 0.2, 0.9)), article, menu, rng.random() < 0.2) for article, menu in sides for _ in range(rng.randint(0, 4))]
        first, second = labels_by_hand(found)
        assert html_text.first_pass(found) == first and html_text.second_pass(found, first) == second


def test_html_rules_on_pages(spark, monkeypatch):
    pages = [r[0] or "" for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    articles = [" ".join(" ".join(b.split()) for b in Article(p).blocks if b.split()) for p in pages]
    for page in pages[:50]:
        found = html_text.blocks(page)
        first, second = labels_by_hand(found)
        assert html_text.first_pass(found) == first and html_text.second_pass(found, first) == second
    assert list(map(html_text.extract, pages)) == articles
    # The rules decide: each of them, taken away, changes most pages.
    with monkeypatch.context() as m:
        m.setattr(html_text, "STOP_WORDS", frozenset())
        assert sum(html_text.extract(p) != a for p, a in zip(pages, articles, strict=True)) >= len(pages) // 2
    with monkeypatch.context() as m:
        m.setattr(html_text, "LINKS", 2)
        m.setattr(html_text, "MENU_LINKS", 2)
        assert sum(html_text.extract(p) != a for p, a in zip(pages, articles, strict=True)) >= len(pages) * 0.9
    # Without the article's mark nearly all of the text stays, and nothing of menus, adverts and footers comes in.
    plain = [html_text.extract(re.sub("(</?)article>", r"\1div>", p)) for p in pages]
    assert sum(map(len, plain)) >= 0.95 * sum(map(len, articles))
    assert all(set(x.split()) <= set(a.split()) for x, a in zip(plain, articles, strict=True))


def test_html_marks_are_evidence():
    prose = "<p>" + "the men of the sea and of the hills " * 3 + "</p>"
    foreign = "<p>" + "xq zv jj " * 20 + "</p>"
    links = "<ul>" + "<li><a href=x>one more page</a></li>" * 4 + "</ul>"
    many = "<p>" + " ".join(f"q{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)) + "</p>"
    assert html_text.extract(foreign + "<p>x</p>") == ""
    assert html_text.extract(prose + foreign).endswith("xq zv jj")
    assert html_text.extract(f"<article>{foreign}</article>") != "" == html_text.extract(f"<article>{many}</article>")
    assert html_text.extract(f"<p>Home</p><div class=ad>{prose}</div>") == ""
    # Prose outside an article stays; links, and what stands among them, go even within one.
    assert html_text.extract(f"{prose}<article>{prose}</article>") == " ".join([html_text.extract(prose)] * 2)
    assert html_text.extract(f"<article>{prose}{links}</article>") == html_text.extract(prose)
    assert html_text.extract(f"<article>{prose}{links}<p>xq</p>{links}</article>") == html_text.extract(prose)
    assert html_text.extract(f"<nav>{links}<p>You are here</p></nav><h2>xq</h2>{prose}") == "xq " + html_text.extract(prose)
    for part in ("<div id=comments>", "<aside>", "<div class='cookie-notice'>", "<form>", "<footer>", "<header>", "<div class='site sidebar'>"):
        assert html_text.extract(f"<article>{prose}</article>{part}{prose}") == html_text.extract(prose)


def test_html_takes_linear_time():
    for page in ("<div>" * 40_000 + "</span>" * 40_000, "<!" * 60_000, "<select>" * 40_000, "<b>" * 20_000 + "<p>" * 20_000 + "</b>" * 40_000, "<a '" * 60_000):
        start = time.process_time()
        html_text.extract(page)
        assert time.process_time() - start < 5


def test_html_pages(spark):
    pages = spark.createDataFrame([(1, "u", None, "c"), (None, None, "", "c"), (2, "v", "<article><p>" + "ab " * 100_000 + "</article>", "c"), (2, "v", "<main>x</main>", "c")], "page_id long, url string, html string, text string")
    got = html_text.extract_pages(pages, keep=["page_id", "url", "text"]).collect()
    assert sorted(r.n_chars for r in got) == [0, 0, 1, 299_999] and all(len(r.text) == r.n_chars for r in got)
    assert html_text.extract_pages(pages.where("false")).count() == 0


# 6: nearest neighbours


def test_hnsw(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((700, 8)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(1000 + i, base[0].tolist()) for i in range(60)]
    rows += [(2000, None), (2001, [0.0] * 8), (2002, [float("nan")] * 8), (2003, [None] * 8), (2004, [float("inf")] + [1.0] * 7), (2005, [1.0, 2.0]), (0, base[0].tolist())]
    vectors = spark.createDataFrame([(*r, "c") for r in rows], "vec_id long, embedding array<float>, rank string")
    queries = vectors.where("vec_id % 100 = 0")
    got = defaultdict(list)
    for r in hnsw.nearest(vectors, queries, shard=200).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    known = {i: np.array(v, float) for i, v in rows if v and len(v) == 8 and None not in v and np.isfinite(v).all() and any(v)}
    hit = 0
    asked = [i for i in known if i % 100 == 0]
    assert set(got) == set(asked)
    for q in asked:
        want = sorted((float(np.sqrt(((known[i] - known[q]) ** 2).sum())), i) for i in known if i != q)[:10]
        hit += len({i for _, i in want} & {i for i, _ in got[q]})
        assert all(abs(s - np.sqrt(((known[i] - known[q]) ** 2).sum())) < 1e-12 for i, s in got[q]) and len(got[q]) == 10
    assert hit >= 0.95 * 10 * len(asked)
    assert [i for i, _ in got[0]][:3] == [1000, 1001, 1002]
    assert hnsw.nearest(vectors.where("false"), queries.where("false")).count() == 0


# 7: Jaccard join


def components_by_hand(rows):
    sets = [(i, shingle_set(ascii_words((t or "").encode()))) for i, t in rows]
    up = {i: i for i, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if jaccard.similar(a, b):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return Counter((i, len(s), find(i)) for i, s in sets)


def test_jaccard(spark):
    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(400)]
    rows, shared = [], " ".join(rng.choice(vocabulary) for _ in range(60))
    for g in range(25):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 9, 40, 70, 150, 400]))]
        for _ in range(rng.choice([1, 2, 6])):
            copy = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 60))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(copy) + (" " + shared if g % 2 else "")))
    rows += [(1000, None), (1001, ""), (1002, " \t"), (1003, rows[0][1].upper()), (1004, "one two"), (1005, "One\ttwo"), (1006, "z" * 100_000)]
    rows = [*rows, rows[3]]
    got = Counter(tuple(r) for r in jaccard.similar_documents(docs_of(spark, rows)).collect())
    assert got == components_by_hand(rows)
    out = jaccard.keep_representatives(docs_of(spark, rows))
    assert {r.doc_id for r in out.collect()} == {c for _, _, c in got}
    assert jaccard.similar_documents(docs_of(spark, [])).count() == 0
    assert jaccard.similar_documents(docs_of(spark, [(None, "a b c d e f"), (None, "a b c d e f")])).where("component_id is null").count() == 2


def test_cells_are_shared():
    """Similar sets share a joined cell, whatever the list of frequent shingles."""
    rng = np.random.default_rng(7)
    for n in (1, 4, 5, 40, 63, 64, 79, 80, 81, 255, 256, 320, 700, 1024, 1280, 5000):
        for _ in range(10):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            b = np.concatenate((a[int(0.1 * len(a)) :], rng.integers(0, 2**63, len(a) // 10).astype(np.uint64)))
            b = np.unique(b if rng.random() < 0.5 else np.concatenate((a, rng.integers(0, 2**63, len(a) // 4).astype(np.uint64))))
            frequent = np.unique(a[:: rng.integers(1, 9)])
            for order in ((np.zeros(0, np.uint64), np.zeros(0, np.int64)), (frequent, rng.integers(1, 99, len(frequent)))):
                if jaccard.similar(a, b):
                    assert len(np.intersect1d(jaccard.cells(a, order)[0], jaccard.cells(b, order)[0]))


def test_representatives_of_repeated_rows(spark):
    rng = random.Random(12)
    text = lambda: " ".join(rng.choice("abcdefghij") + str(rng.randint(0, 500)) for _ in range(80))
    near, clean, twice, nameless, other = text(), text(), text(), text(), text()
    rows = [(1, near), (5, near + " end"), (5, clean), (7, twice), (7, twice), (None, nameless), (None, nameless), (None, other), (9, other), (11, "a"), (11, "a"), (12, "a"), (13, ""), (14, "")]
    got = jaccard.keep_representatives(docs_of(spark, rows)).select("doc_id", "text").collect()
    want = {(1, near): 1, (5, clean): 1, (7, twice): 1, (None, nameless): 1, (9, other): 1, (11, "a"): 1, (13, ""): 1, (14, ""): 1}
    assert Counter(map(tuple, got)) == want


# 8: decontamination


def test_decontamination(spark):
    rng = random.Random(8)
    word = lambda: rng.choice(["a", "B", "c1", "é", "漢", "d"])
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([12, 14, 3, 30])] + [(9, None), (10, "!?"), (None, "a"), (3, "zz yy")]
    rows = [(k, "-".join(word() for _ in range(rng.randint(0, 80)))) for k in range(150)] + [(500, None), (501, "x " * 50_000 + "ZZ, yy!"), (501, items[1][1])]
    fold = lambda t: decontaminate.words((t or "").encode())
    want = Counter()
    for i, t in rows:
        w, hit, ids = fold(t), set(), set()
        for k, b in items:
            v = fold(b)
            for s in range(max(1, len(v) - 9)) if v and k is not None else ():
                x = v[s : s + 10]
                for p in range(len(w) - len(x) + 1):
                    if w[p : p + len(x)] == x:
                        hit |= set(range(p, p + len(x)))
                        ids.add(k)
        want[i, len(w), len(hit), len(ids), sha(",".join(sorted(map(str, ids)))), bool(hit)] += 1
    bench = spark.createDataFrame(items, "item_id long, text string")
    for bound in (decontaminate.PATTERN_BYTES, 200):
        out = decontaminate.scan_documents(docs_of(spark, rows), bench, keep=["doc_id"], bound=bound)
        assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out.collect()) == want
    last = out.where("doc_id = 501 and n_words > 1000").first()
    assert [("x " * 50_000 + "ZZ, yy!")[s.start : s.end] for s in last.hit_spans] == ["ZZ, yy"]
    assert decontaminate.scan_documents(docs_of(spark, rows), bench.where("false")).where("contaminated").count() == 0
    assert decontaminate.drop_contaminated(docs_of(spark, rows), bench).columns == docs_of(spark, []).columns


# 9: language model


def test_language_model(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(k, " ".join(("a b c d e f g h".split()[(s + k) % 8]) for s in range(rng.randint(1, 60))) + (f" r{k}" if k % 3 else "")) for k in range(150)]
    rows += [(500, None), (501, ""), (502, "z " * 30_000), (7, rows[7][1])]
    monkeypatch.setattr(gru_lm, "COUNTED", 20)  # rarer words take the join
    monkeypatch.setattr(gru_lm, "HEAD", 8)
    tokens = [(i, [*ascii_words((t or "").encode()), b"\n"]) for i, t in rows]
    c = Counter(w for i, ws in tokens for w in ws if zlib.crc32(str(i).encode()) % 10)
    total, below = sum(c.values()), sum(c.values()) + 0.1 * (len(c) + 1)
    got = {(r.doc_id, r.n_tokens): r for r in gru_lm.score_documents(docs_of(spark, rows)).collect()}
    for i, ws in tokens:
        r = got[i, len(ws)]
        assert r.n_known == sum(w in c for w in ws) and r.train_tokens == total and r.held_out == (zlib.crc32(str(i).encode()) % 10 == 0)
        assert abs(r.base_score - sum(np.log10((c[w] + 0.1) / below) for w in ws)) < 1e-6 * max(1, abs(r.base_score)) and r.score < 0
    assert gru_lm.score_documents(docs_of(spark, [])).count() == 0


def test_model_is_a_distribution():
    model = gru_lm.Model(np.array([50, 20, 10, 5] * 20, np.int64), 30.0)
    states = np.random.default_rng(1).standard_normal((1, model.hidden)).astype(np.float32)
    out, _ = model.output(np.repeat(states, model.head + 1, 0), np.arange(model.head + 1))
    assert abs(np.exp(out).sum() - 1) < 1e-4


def test_model_words_follow_the_corpus(spark, monkeypatch):
    monkeypatch.setattr(gru_lm, "HEAD", 8)
    heads = []

    class Seen(gru_lm.Model):
        def __init__(self, counts, *args, **more):
            heads.append(len(counts))
            super().__init__(counts, *args, **more)

    monkeypatch.setattr(gru_lm, "Model", Seen)
    for n in (100, 400):
        rows = [(k, f"w{k} w{k} v{k % 7} u{k % 11}") for k in range(n)]
        c = Counter(w for i, t in rows for w in [*t.split(), "\n"] if zlib.crc32(str(i).encode()) % 10)
        before = len(heads)
        assert gru_lm.score_documents(docs_of(spark, rows)).count() == n
        size = heads[before]
        shares = np.cumsum(sorted(c.values(), reverse=True)) / sum(c.values())
        assert shares[size - 1] >= gru_lm.SHARE > shares[size - 2]
    assert heads[-1] > 2 * heads[0]


def test_larger_classes_are_a_distribution():
    model = gru_lm.Model(np.arange(5000, 0, -1), 30.0)
    states = np.random.default_rng(1).standard_normal((1, model.hidden)).astype(np.float32)
    out, _ = model.output(np.repeat(states, model.head + 1, 0), np.arange(model.head + 1))
    assert model.side > gru_lm.SIDE and model.parts > model.deep > 0 and abs(np.exp(out).sum() - 1) < 1e-4


def test_windows_carry_whole_documents():
    docs = [(k, np.arange(n) + 1000 * k) for k, n in enumerate([5, 1, 40, 7, 3, 100])]
    seen = defaultdict(list)
    for owner, tokens, first, real, _ in gru_lm.windows(docs, lanes=3, steps=8):
        for lane in range(tokens.shape[1]):
            for t in np.flatnonzero(real[:, lane]):
                assert first[t, lane] == (tokens[t, lane] % 1000 == 0)
                seen[owner[t, lane]].append(tokens[t, lane])
    assert {k: v for k, v in seen.items()} == {k: list(v) for k, v in docs}


def test_long_documents_start_once():
    text = np.arange(5000)
    starts = sum(int(first.sum()) for _, _, first, _, _ in gru_lm.windows([(0, text), (1, text[:3])], lanes=2, steps=8))
    assert starts == 2


def by_token(model, places):
    """Log10 probability of tokens one at a time, every outcome's share written out."""
    w = {k: v.astype(np.float64) for k, v in model.weights().items()}
    hid, side, few = model.hidden, model.side, -(-model.flat // model.side)
    share = lambda x, state: np.exp(v := state @ x[:-1] + x[-1]) / np.exp(v).sum()
    h, before, total = np.zeros(hid), model.head + 1, 0.0
    for t in places:
        x, past = w["g"][before].reshape(3, hid), (h @ w["u"]).reshape(3, hid)
        z, r = 1 / (1 + np.exp(-(x + past)[:2]))
        c = np.tanh((x[2] + r * past[2]) / 2)
        h, before = z * h + (1 - z) * c, t
        if t == model.head:
            p = share(w["top"][0], h)[-1]
        elif t < model.flat:
            p = share(w["top"][0], h)[t // side] * share(w["mid"][t // side], h)[t % side]
        else:
            part, word = divmod(t - model.flat, side)
            node = few + part // side
            p = share(w["top"][0], h)[node] * share(w["mid"][node], h)[part % side] * share(w["low"][part], h)[word]
        total += np.log10(p)
    return total


def test_scores_token_by_token(spark, monkeypatch):
    monkeypatch.setattr(gru_lm, "HEAD", 150)
    monkeypatch.setattr(gru_lm, "COUNTED", 180)  # rarer words take the join
    rng = random.Random(4)
    words = [f"w{int(rng.paretovariate(0.6)) % 400}" for _ in range(4000)]
    rows = [(k, " ".join(words[k * 25 : k * 25 + rng.randint(1, 25)])) for k in range(160)] + [(900, None), (901, "unseen " * 300), (902, " ".join(words[:3000]))]
    docs = docs_of(spark, rows).selectExpr("doc_id AS doc", "text").withColumn("held_out", gru_lm.is_held_out("doc"))
    monkeypatch.setattr(gru_lm, "CHUNK", 700)
    held = gru_lm.chunks(docs)
    vocab = gru_lm.vocabulary(held)
    tokens = gru_lm.look_up(held, vocab)
    weights = gru_lm.learn(tokens, vocab, rounds=2, copy_tokens=1500)
    again = gru_lm.learn(tokens.repartition(7), vocab, rounds=2, copy_tokens=1500)
    assert all(np.array_equal(weights[k], again[k]) for k in weights)  # however the table is stored
    model = gru_lm.Model(vocab["counts"], vocab["rest"], weights=weights)
    assert model.parts and not np.allclose(model.low, gru_lm.Model(vocab["counts"], vocab["rest"]).low)
    counted = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 10 for w in [*ascii_words((t or "").encode()), b"\nend"])
    place = {h: k for k, h in enumerate(vocab["hashes"].view(np.uint64).tolist()[: model.head])}
    rest = sum(counted.values()) - int(vocab["counts"].sum())
    below = rest + 0.1 * (len(counted) - model.head + 1)
    for r in gru_lm.score(tokens, vocab, weights, "doc").collect():
        ws = [*ascii_words((dict(rows)[r.doc] or "").encode()), b"\nend"]
        at = [place.get(xxhash.xxh3_64_intdigest(w), model.head) for w in ws]
        want = by_token(model, at) + sum(np.log10((counted[w] + 0.1) / below) for w, k in zip(ws, at) if k == model.head)
        assert abs(r.score - want) < 1e-3 * max(1, abs(want)), r.doc


def test_most_frequent_words(spark):
    counts = spark.createDataFrame([((k * 0x9E3779B97F4A7C15) % 2**64 - 2**63, 1 + (k % 50 == 0) * 3) for k in range(1, 3000)], "h long, c long")
    by_count = [tuple(r) for r in counts.groupBy("c").count().collect()]
    rows = sorted(((-r.c, r.h) for r in counts.collect()))
    for size in (0, 10, 59, 60, 700, 2999, 5000):
        got = frequent.most_frequent(counts, by_count, size)
        assert [(-c, h) for h, c in zip(got["h"], got["c"])] == rows[:size]


def test_gradient_of_a_window():
    rng = np.random.default_rng(3)
    model = gru_lm.Model(np.arange(90, 0, -1), 5.0, hidden=4)
    for k, v in model.weights().items():
        setattr(model, k, v.astype(np.float64))
    tokens, first = rng.integers(0, 91, (6, 5)), rng.random((6, 5)) < 0.2
    real, h, before = rng.random((6, 5)) < 0.8, np.zeros((5, 4), np.float32), rng.integers(0, 91, 5)
    at = np.flatnonzero(real.ravel())

    def loss():
        _, states, _, _ = model.forward(tokens, first, h, before)
        return -model.output(states.reshape(-1, 5)[at].astype(np.float64), tokens.ravel()[at])[0].astype(np.float64).sum()

    class Keep(gru_lm.Trainer):
        def _step(self, grads, d_u, inputs, d_x, n):
            self.grads = {"u": d_u, "g": np.zeros_like(model.g)}
            np.add.at(self.grads["g"], inputs, np.concatenate(d_x, 1))
            for k, (touched, g) in grads.items():
                self.grads[k] = np.zeros_like(getattr(model, k))
                self.grads[k][touched] = g

    trainer = Keep(model)
    trainer.window(tokens, first, real, h, before)
    for k, g in trainer.grads.items():
        v = getattr(model, k)
        for i in np.argsort(-np.abs(g.ravel()))[:4]:
            kept = v.flat[i]
            v.flat[i] = kept + 2e-2
            up = loss()
            v.flat[i] = kept - 2e-2
            down = loss()
            v.flat[i] = kept
            assert abs((up - down) / 4e-2 - g.flat[i]) < 0.02 + 0.03 * abs(g.flat[i]), k


def test_gradients_of_a_node_in_one_block():
    rng = np.random.default_rng(5)
    model = gru_lm.Model(np.arange(3000, 0, -1), 5.0)
    tokens = np.concatenate((rng.integers(0, 3001, 900), np.full(1500, 7), np.full(37, 2999), np.full(3, 1500)))
    rng.shuffle(tokens)
    states = np.ones((len(tokens), model.hidden + 1), np.float32)
    states[:, :-1] = rng.standard_normal((len(tokens), model.hidden))
    grads = {}
    log, slope = model.output(states, tokens, grads)
    part = (tokens - model.flat) // model.side
    few, low = -(-model.flat // model.side), (tokens >= model.flat) & (tokens < model.head)
    levels = {
        "top": (np.arange(len(tokens)), np.zeros_like(tokens), np.where(tokens < model.flat, tokens // model.side, np.where(low, few + part // model.side, few + model.deep))),
        "mid": (np.flatnonzero(tokens < model.head), np.where(low, few + part // model.side, tokens // model.side), np.where(low, part % model.side, tokens % model.side)),
        "low": (np.flatnonzero(low), part, (tokens - model.flat) % model.side),
    }
    want_log, want_slope = np.zeros(len(tokens)), np.zeros((len(tokens), model.hidden))
    for name, (rows, node, target) in levels.items():
        w, want = getattr(model, name), np.zeros(getattr(model, name).shape)
        for i in rows:
            e = np.exp(states[i].astype(np.float64) @ w[node[i]])
            e /= e.sum()
            want_log[i] += np.log(e[target[i]])
            e[target[i]] -= 1
            want[node[i]] += np.outer(states[i], e)
            want_slope[i] += (w[node[i]] @ e)[:-1]
        touched, got = grads[name]
        assert len(got) == len(touched) == len(set(touched.tolist())) == len(set(node[rows].tolist()))
        whole = np.zeros(w.shape)
        whole[touched] = got
        assert np.allclose(whole, want, atol=1e-3)
    assert np.allclose(log, want_log, atol=1e-4) and np.allclose(slope, want_slope, atol=1e-4)


def test_sums_by_rank():
    rng = np.random.default_rng(6)
    tokens = np.sort(np.concatenate((rng.integers(0, 500, 800), np.full(gru_lm.RANKS, 600), np.full(gru_lm.RANKS + 1, 601), np.full(2000, 602))))
    rows, order = rng.standard_normal((len(tokens), 5)).astype(np.float32), rng.permutation(len(tokens))
    _, starts, sizes = np.unique(tokens, return_index=True, return_counts=True)
    by = np.argsort(-sizes, kind="stable")
    got = gru_lm._sums(rows, order, starts[by], sizes[by])
    assert np.allclose(got, np.add.reduceat(rows[order].astype(np.float64), starts, axis=0)[by], atol=1e-4)
    assert len(gru_lm._sums(rows, order, starts[:1], np.array([1]))) == 1


def test_small_counts_lie_in_few_files(spark):
    rows = [(k, f"w{k} v{k % 7} and more") for k in range(500)]
    own = {"spark.sql.shuffle.partitions": "23", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        held = gru_lm.chunks(docs_of(spark, rows).selectExpr("doc_id AS doc", "text").withColumn("held_out", gru_lm.is_held_out("doc")))
        vocab = gru_lm.vocabulary(held)
        tokens = gru_lm.look_up(held, vocab)
        scored = gru_lm.score(tokens, vocab, gru_lm.Model(vocab["counts"], vocab["rest"]).weights())
        assert len(vocab["table"].inputFiles()) == 1 and scored.rdd.getNumPartitions() == 1 and scored.count() == 500
        assert tokens.count() == 500  # words that are not at hand add no rows
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_chunks_hold_the_words_of_whole_texts(monkeypatch):
    texts = [None, "", "  ", "\x1c a\x1d\x85B\xa0c\u2003d \x00 ", "\tÄa\x0bİ\x0cZz\r\nzz ", "x" * 300, "one", " Two  two\n", *(f"w{k % 9} " * (k % 5) for k in range(60))]
    held = [k % 4 == 0 for k in range(len(texts))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(held), pa.array(texts, pa.string())], names=["doc", "held_out", "text"])
    monkeypatch.setattr(gru_lm, "CHUNK", 50)
    monkeypatch.setattr(gru_lm, "SLICE", 40)
    got, counted = {}, Counter()
    for chunk in gru_lm._chunks([batch.slice(0, 11), batch.slice(11)]):
        x = {k: v[0] for k, v in chunk.to_pydict().items()}
        words, ids = np.frombuffer(x["words"], np.uint64), np.frombuffer(x["ids"], np.uint32)
        assert len(words) == len(set(words.tolist())) == x["distinct"]
        for doc, out, part in zip(x["docs"], x["held"], np.split(ids, np.cumsum(np.frombuffer(x["sizes"], np.int64))[:-1]), strict=True):
            got[doc] = out, words[part].tolist()
        counted.update({w: n for w, n in zip(words.tolist(), np.frombuffer(x["counts"], np.int64).tolist(), strict=True) if n})
    want = {k: (held[k], [*map(xxhash.xxh3_64_intdigest, ascii_words((t or "").encode())), gru_lm.END]) for k, t in enumerate(texts)}
    assert got == want and counted == Counter(w for out, ws in want.values() if not out for w in ws)


# 10: sharding


def jump_by_hand(key, n):
    key, b, j = key % 2**64, -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


def test_sharding(spark):
    rows = [(k, "é" * (k % 7)) for k in range(400)] + [(None, "x"), (5, None), (5, None), (-3, "y" * 100_000)]
    got = sharding.shard_rows(docs_of(spark, rows), 16).collect()
    assert len(got) == len(rows)
    for r in got:
        key = -1 if r.doc_id is None else r.doc_id
        assert r.shard == jump_by_hand(key, 16) and r.grown_shard == jump_by_hand(key, 17) and r.grown_shard in (r.shard, 16)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert {(r["size"], r.text_crc32) for r in got if r.doc_id == 5} == {(len(("é" * 5).encode()) + 1, zlib.crc32(("é" * 5).encode())), (1, 0)}
    assert sharding.shard_rows(docs_of(spark, []), 16).count() == 0


# 11: id files


@pytest.mark.parametrize("top", [1 << 8, 1 << 16, 1 << 24, 1 << 32])
def test_control_bytes(top):
    rng = np.random.default_rng(top)
    for n in (0, 1, 3, 4, 5, 1000):
        numbers = rng.integers(0, top, n).astype(np.uint32)
        control, data = id_files.pack(numbers)
        assert len(control) == -(-n // 4)
        assert id_files.unpack(control, data, n).tolist() == numbers.tolist()
    with pytest.raises(ValueError):
        id_files.unpack(b"\x00", b"abc", 3)


def test_id_files(spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(id_files, "BLOCK_IDS", 50)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rng = random.Random(11)
    rows = [(rng.randrange(10**6) - 500_000, " ".join(rng.choice(["the", "Über", "日本", "\n", "x1", "<|endoftext|>"]) for _ in range(rng.randint(0, 40)))) for _ in range(200)]
    rows += [(7, None), (8, ""), (9, "long text " * 9000), *rows[:3], (rows[0][0], "other"), (None, "no id")]
    tok = Tokenizer.from_file(BPE)
    tok.no_truncation()
    ids = sorted(((i is not None, i or 0, [*tok.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in rows), key=lambda r: (r[:2], np.array(r[2], "<u2").tobytes()))
    want, start = [], 0
    for known, i, x in ids:
        want.append((i if known else None, start, len(x), zlib.crc32(np.array(x, "<u4").tobytes()), x))
        start += len(x)
    root, manifest = id_files.write_files(docs_of(spark, rows), BPE, 2)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = id_files.read_files(spark, root, manifest, with_ids=True).collect()
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == want
    counts = Counter(j for r in want for j in r[4])
    assert id_files._read_ranks(root).tolist() == sorted(counts, key=lambda j: (-counts[j], j))
    assert manifest.count() > 1

    root, manifest = id_files.write_files(docs_of(spark, []), BPE, 2)
    assert id_files.read_files(spark, root, manifest).collect() == []


# 12: source divergence


def divergence_by_hand(rows, min_docs=3, top=200):
    docs, count, total, found = defaultdict(Counter), Counter(), Counter(), []
    for text, lang, source in rows:
        t = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        docs[lang or ""].update(set(t))
        count.update((lang or "", source or "", x) for x in t)
    groups = sorted({(lang or "", source or "") for _, lang, source in rows})
    kept = {lang: sorted(t for t, n in docs[lang].items() if n >= min_docs) for lang, _ in groups}
    total = {(lang, s): sum(count[lang, s, t] for t in kept[lang]) for lang, s in groups}

    def p(lang, sources, t):
        return 1 + 10**9 * (sum(count[lang, s, t] for s in sources) + 1) // (sum(total[lang, s] for s in sources) + len(kept[lang]))

    for lang, s in groups:
        others = [x for g, x in groups if g == lang]
        f = lambda t, q: (p(lang, [s], t) - p(lang, q, t)) ** 2 // p(lang, q, t)  # noqa: E731, B023
        pairs = [(-sum(f(t, [o]) for t in kept[lang]), o) for o in others if o != s]
        terms = [(-f(t, others), t) for t in kept[lang] if count[lang, s, t] and p(lang, [s], t) > p(lang, others, t)]
        for part, some in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
            found += [(lang, s, part, i, -v, n) for n, (v, i) in enumerate(some, 1)]
    return found


LANG_DOCS = "doc_id long, text string, lang string, source string, total long, prefix string"


@pytest.mark.parametrize("small", [False, True])
def test_divergence(spark, monkeypatch, small):
    if small:
        for name, n in {"COUNTS": 50, "LEAVES": 30, "PREFIX": 1, "RANGE_LEAVES": 40, "BLOCK": 7, "TILE": 2}.items():
            monkeypatch.setattr(divergence, name, n)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rng = random.Random(12)
    words = ["the", "The", "then", "thence", "ab1cd", "été", "日本語", "日本", "\U0001f600x", "z" * 3000, "z" * 2999 + "y", *(f"{a}{b}{c}" for a in "pq" for b in "rs" for c in "tuv")]
    rows = [(" ".join(rng.choices(words, k=rng.randint(0, 30))), rng.choice(["en", "en", "en", "de", None]), rng.choice(["a", "a", "b", "c", "d", None])) for _ in range(200)]
    rows += [(None, "en", "e"), ("", "xx", "a"), ("lonely words", "yy", "a"), ("other", "yy", "b"), rows[0], rows[0], ("the " * 5000, "en", "a")]
    docs = spark.createDataFrame([(i, *r, 1, "clash") for i, r in enumerate(rows)], LANG_DOCS)
    got = [tuple(r) for r in divergence.audit_sources(docs).collect()]
    assert sorted(got) == sorted(divergence_by_hand(rows))
    assert divergence.audit_sources(docs.where("doc_id < 0")).collect() == []
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_tries_merge():
    rng = random.Random(5)
    parts, want = [], defaultdict(lambda: [0, Counter()])
    for p in range(4):
        root = divergence.Node()
        for _ in range(200):
            term = "".join(rng.choices("abé", k=rng.randint(1, 7))).encode()
            divergence.insert(root, term, 1, {f"s{p}": 2})
            want[term][0] += 1
            want[term][1][f"s{p}"] += 2
        parts.append(root)
    whole = divergence.Node()
    for root in parts:
        for _, sub in divergence.cut(root, 2):
            divergence.merge(whole, divergence.load(divergence.dump(sub)))
    assert [(t, d, c) for t, d, c in divergence.walk(whole)] == [(t, want[t][0], dict(want[t][1])) for t in sorted(want)]


def test_trie_of_sorted_terms():
    rng = random.Random(13)
    found = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 7))).encode() for _ in range(400)} | {b"a", b"aa", b"aab", "日本".encode()}
    one_by_one = divergence.Node()
    for term in sorted(found):
        divergence.insert(one_by_one, term, len(term), {"s": 1})
    built = divergence.build((t, len(t), {"s": 1}) for t in sorted(found))
    assert divergence.dump(built) == divergence.dump(one_by_one)
    assert divergence.dump(divergence.build([])) == divergence.dump(divergence.Node())


def test_no_search_for_cycles_while_counting():
    seen = []

    def task(batches):
        for batch in batches:
            seen.append(gc.isenabled())
            yield batch

    assert list(divergence._uncollected(task)([1, 2])) == [1, 2] and seen == [False, False] and gc.isenabled()
    left = divergence._uncollected(task)([1, 2])
    next(left)
    left.close()
    assert gc.isenabled()


def test_exact_shares():
    rng = random.Random(6)
    for top in (10, 10**9, 9 * 10**15):
        totals = [rng.randint(1, top) for _ in range(200)]
        counts = [rng.randint(0, t - 1) for t in totals]
        got = divergence.share(np.array(counts), np.array(totals))
        assert got.tolist() == [1 + 10**9 * (c + 1) // t for c, t in zip(counts, totals, strict=True)]


# 13: ranked search


def search_by_hand(rows, items, k=20):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    docs = [(i, Counter(terms(t))) for i, t in rows if terms(t)]
    n, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in set(items):
        found = []
        for i, c in docs:
            m = 75 + 25 * sum(c.values()) * n // total
            score = sum(int(np.floor(1000 * np.log((2 * n + 2) / (2 * df[t] + 1)))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, r, None if z else i, -s) for r, (s, z, i) in enumerate(sorted(found)[:k], 1)]
    return out


@pytest.mark.parametrize("small", [False, True])
def test_ranked_search(spark, monkeypatch, small):
    if small:
        for name, n in {"ITEM_BYTES": 60, "SHARD_POSTINGS": 100, "SHARD_DOCS": 40}.items():
            monkeypatch.setattr(ranked_search, name, n)
    rng = random.Random(13)
    words = ["the", "The", "x1", "über", "日本", *(f"w{i}" for i in range(40))]
    weights = [1 / (i + 1) for i in range(len(words))]
    rows = [(rng.randrange(10**6), ", ".join(rng.choices(words, weights, k=rng.randint(1, 60)))) for _ in range(300)]
    rows += [(None, "x1 w7 w7"), (1, None), (2, ""), (3, "?!"), rows[5], rows[5], (4, "the " * 20_000), (rows[6][0], "w39 x1")]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 9)))) for i in range(12)] + [(1, "w39 w39 nowhere"), (20, None), (21, ""), (22, "nowhere"), (None, "über")]
    asked = spark.createDataFrame([*items, items[0]], "item_id long, text string")
    docs = docs_of(spark, rows)
    got = [tuple(r) for r in ranked_search.search(docs, asked).select("item_id", "rank", "doc_id", "score").collect()]
    assert Counter(got) == Counter(search_by_hand(rows, items))
    assert ranked_search.search(docs.where("doc_id = -1"), asked).collect() == []
    assert ranked_search.search(docs, asked.where("item_id = -1")).collect() == []


def test_search_stops_when_proven():
    """The k best are among the candidates, and far fewer postings than all are processed where few documents match rare terms."""
    rng = np.random.default_rng(3)
    n_docs, vocab = 4000, 50
    df = np.linspace(3800, 4, vocab).astype(int)
    held = [np.sort(rng.choice(n_docs, d, replace=False)) for d in df]
    by_doc = [[] for _ in range(n_docs)]
    for t, docs in enumerate(held):
        for d in docs:
            by_doc[d].append(t)
    widths, at = np.array(list(map(len, by_doc))), np.array([t for x in by_doc for t in x])
    tfs, n = rng.integers(1, 6, len(at)), rng.integers(5, 300, n_docs)
    weights = np.array([ranked_search.weight(n_docs, d) for d in df])
    shard = ranked_search.Shard(n, widths, at, tfs, weights, n_docs, int(n.sum()))
    item, repeats = np.array([0, 1, 2, 47, 48, 49]), np.array([1, 2, 1, 1, 1, 3])
    docs, scores, done = shard.candidates(item, repeats, 5, first=8)
    factors = np.zeros(vocab + 1, np.int64)
    factors[item] = repeats
    whole = shard.complete(np.arange(n_docs), factors)
    assert sorted(scores)[-5:] == sorted(whole)[-5:]
    assert (whole[docs] == scores).all()
    assert done < 0.1 * df[item].sum()


def test_hnsw_recall_over_shards(spark):
    """At least 0.9 of the true neighbours over five shards of 64 dimensions, clustered and with copies."""
    rng = np.random.default_rng(17)
    centres = rng.standard_normal((40, 64))
    base = (centres[rng.integers(0, 40, 5000)] + rng.standard_normal((5000, 64)) * 0.7).astype(np.float32)
    base[4000:4100] = base[0]
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "vec_id long, embedding array<float>")
    got = defaultdict(set)
    for r in hnsw.nearest(vectors, vectors.where("vec_id % 100 = 0"), shard=1000).collect():
        got[r.query_id].add(r.vec_id)
    exact, hit = base.astype(np.float64), 0
    asked = range(0, 5000, 100)
    for q in asked:
        d = np.sqrt(((exact - exact[q]) ** 2).sum(1))
        d[q] = np.inf
        hit += len(got[q] & set(np.lexsort((np.arange(5000), d))[:10].tolist()))
    assert hit >= 0.9 * 10 * len(asked)
