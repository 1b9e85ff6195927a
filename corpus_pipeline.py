"""A training-data pipeline: each stage reads what its predecessor kept.

What all stages have in common: an empty table stays empty; texts of any length
are read whole; columns of any name, also of a result or of an inner step, are
handed on unchanged, except ``text`` and ``n_chars`` where a stage cuts lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm import bpe, decontaminate, jaccard, line_dedup, quality
from quarrymill.llm.queries import tokenizer_path
from quarrymill.llm.storage import materialise, quoted, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject.

    Null and empty texts score the share of good labels; repeated rows are judged alike; ties as in ``quality``.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many of them repeat; n_chars counts what is left.

    A null text becomes the empty one; documents with a null id lose no lines; repeated rows lose the same lines;
    a line stays in the largest id that holds it.
    """
    own = {c: f"__own_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    out = line_dedup.dedup_lines(docs.select("doc_id", "text", *(F.col(quoted(c)).alias(o) for c, o in own.items())))
    kept = {"doc_id": F.col("doc_id"), "text": F.col("kept_text")} | {c: F.col(o) for c, o in own.items()}
    if "n_chars" in kept:
        kept["n_chars"] = F.char_length("kept_text").cast(docs.schema["n_chars"].dataType)
    return out.select(*(kept[c].alias(c) for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the least id, and all others.

    Null and empty texts are near nothing, but of repeated rows one stays; a null id comes after all others.
    """
    return jaccard.keep_representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; null and empty texts have none, repeated rows are judged alike."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and digests of every document; null encodes as the empty text, repeated rows each on its own."""
    return bpe.encode_documents(docs, tokenizer_path(), keep=["doc_id"], with_ids=True)


STAGES = [
    ("quality_filter", quality_filter),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

# A classifier and a tokenizer are not expressible in SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
