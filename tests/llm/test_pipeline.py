import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
pipeline = pytest.importorskip("corpus_pipeline")

from quarrymill.llm import bpe, jaccard
from quarrymill.llm.decontaminate import scan_documents

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").withColumn("extra", F.lit("kept"))
    columns = docs.columns
    bench = spark.read.parquet(f"{DIR}/benchmark.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    before = {r.doc_id: r.text for r in docs.collect()}
    stages = dict(pipeline.STAGES)

    good = stages["quality_filter"](spark, docs, DIR).cache()
    kept = {r.doc_id for r in good.collect()}
    clean = [i for i, q in labels.items() if q == 1]
    assert good.columns == columns and kept <= set(before) and sum(i in kept for i in clean) >= 0.95 * len(clean)

    lines = stages["line_dedup"](spark, good, DIR).cache()
    assert lines.columns == columns and {r.doc_id for r in lines.collect()} == kept
    assert all(r.n_chars == len(r.text) for r in lines.collect())

    unique = stages["near_duplicates"](spark, lines, DIR).cache()
    groups = jaccard.similar_documents(lines).collect()
    assert unique.columns == columns and {r.doc_id for r in unique.collect()} == {r.component_id for r in groups}

    safe = stages["decontamination"](spark, unique, DIR).cache()
    marked = {r.doc_id: r.contaminated for r in scan_documents(unique, bench, keep=["doc_id"]).collect()}
    assert safe.columns == columns and {r.doc_id for r in safe.collect()} == {i for i, hit in marked.items() if not hit}

    tok = bpe.load(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in safe.collect()}
    want = {i: hashlib.sha256(np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes()).hexdigest() for i, t in texts.items()}
    assert {r.doc_id: r.ids_sha256 for r in stages["bpe"](spark, safe, DIR).collect()} == want
    assert {r.doc_id: r.ids_sha256 for r in pipeline.run(spark, DIR).collect()} == want


def test_stages_on_odd_rows(spark):
    """Nulls, empty and very long texts, ties, repeated rows, clashing columns and the empty table."""
    names = ["doc_id", "text", "lang", "source", "n_lines", "n_dropped", "keep_bitmap", "kept_text", "key", "score", "predicted", "n_hit", "comp", "__own_2"]
    line = "the quick brown fox jumps over the lazy dog again and again " * 2
    texts = [None, "", "a" * 300_000, "word " * 60_000, line + "\none", line + "\none", line + "\ntwo", line, line + "\nthree", line + "\nfour"]
    rows = [(k, t, "en", None, *(f"{c}{k}" for c in names[4:])) for k, t in enumerate(texts)]
    rows += [rows[4], (None, "null id", "en", "s", *names[4:]), (None, None, None, None, *names[4:])]
    docs = spark.createDataFrame(rows, ", ".join(f"`{c}` {'long' if c == 'doc_id' else 'string'}" for c in names))
    for name, stage in pipeline.STAGES:
        for table in (docs, docs.where("false")):
            out = stage(spark, table, DIR)
            got = out.collect()
            if table is not docs:
                assert got == []
            elif name == "bpe":
                assert sorted(r.doc_id for r in got if r.doc_id is not None) == sorted(r[0] for r in rows if r[0] is not None) and len(got) == len(rows)
            else:
                assert out.columns == names and out.schema["n_lines"].dataType.simpleString() == "string"
                mine = {r[4:] for r in rows}
                assert all(tuple(r)[4:] in mine for r in got)
                if name == "line_dedup":
                    assert len(got) == len(rows) and sum(line.strip() in r.text for r in got) == 1
                if name == "near_duplicates":
                    assert sum(r.doc_id == 4 for r in got) == 1


def test_columns_of_any_name(spark):
    """No operator's inner names, dots or backticks in the documents' own columns change a row."""
    import corpus_pipeline
    from quarrymill.llm import bpe, decontaminate, html_text, jaccard, line_dedup, quality
    from quarrymill.llm.queries import tokenizer_path

    names = ["__key", "__n", "__doc", "__ver", "__bits", "__text", "__html", "__k0", "__own_0", "__own_5", "doc", "ver", "id", "key", "n", "comp", "kind", "held_out", "score", "n_hit", "a.b", "a`b", "line `1`.x"]
    line = "a line that many documents repeat, of more than forty characters"
    rows = [(i, f"{line}\nThe text of document number {i} tells of the sea and of the hills.", *(f"{c}{i}" for c in names)) for i in range(8)]
    quote = lambda c: "`" + c.replace("`", "``") + "`"
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{quote(c)} string" for c in names))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(6)], "doc_id long, quality int, toxic int")
    tests = spark.createDataFrame([(1, "no such words here")], "item_id long, text string")
    want = sorted(r[2:] for r in rows)

    def same(df, kept=names):
        at = [names.index(c) for c in kept]
        assert sorted(tuple(r) for r in df.select(*map(quote, kept)).collect()) == sorted(tuple(w[i] for i in at) for w in want)

    same(line_dedup.dedup_lines(docs))
    same(quality.score_documents(docs, labels), [c for c in names if c not in ("held_out", "score")])
    same(html_text.extract_pages(docs.withColumnRenamed("text", "html")))
    same(decontaminate.scan_documents(docs, tests), [c for c in names if c != "n_hit"])
    same(bpe.encode_documents(docs, tokenizer_path()))
    same(jaccard.keep_representatives(docs))
    same(decontaminate.drop_contaminated(docs, tests))
    same(corpus_pipeline.drop_repeated_lines(spark, docs, ""))
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {tuple(r)[2:] for r in kept.collect()} <= set(want)
