"""A training-data pipeline: documents of good quality, without exact and near copies, mixed by source, as token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written before the next stage reads it. All but the last
return the columns of ``docs``. Decisions come back to the documents by anti joins: only what goes is joined, broadcast if
it is counted to be few, shuffled otherwise.

Defined cases are those of the operators. Documents with repeated ids: exact dedup tells them apart by their texts; for
the other stages they are one document. Columns of ``docs`` may have any names: helper columns get names that aren't taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieve.llm.bpe import bpe_append
from sieve.llm.common import WORD, cut, table, text_of
from sieve.llm.exact_dedup import exact_dedup
from sieve.llm.jaccard_join import jaccard_components
from sieve.llm.mixing import mix_sources
from sieve.llm.quality import quality_model, score_column
from sieve.llm.queries import tokenizer_path

BROADCAST_ROWS = 300_000
THRESHOLD = 0.3


def _few(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it is counted to be small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _free(docs: DataFrame, *names: str) -> list[str]:
    """The names, longer where a column of docs has them."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
    return out


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, doesn't reject."""
    model, _ = quality_model(docs, table(spark, sf_dir, "labels"))
    return docs.filter(score_column(model) >= THRESHOLD)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    found = cut(exact_dedup(docs), "copies")
    own, digest = _free(docs, "__id", "__sha")
    same_row = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    gone = found.filter(~F.col("kept") & ~same_row).select(F.col("doc_id").alias(own), F.col("text_sha256").alias(digest)).distinct()
    sha = F.sha2(text_of(), 256)
    kept = docs.join(_few(gone), docs["doc_id"].eqNullSafe(F.col(own)) & (sha == F.col(digest)), "left_anti")
    if found.filter(~F.col("kept") & same_row).limit(1).count():  # rows that repeat id and text
        kept = kept.withColumn(digest, sha).dropDuplicates(["doc_id", digest]).drop(digest)
    return kept


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard similarity from 0.8), the document with the smallest id."""
    found = cut(jaccard_components(docs, width=5, percent=80), "near-copies")
    (own,) = _free(docs, "__id")
    gone = found.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(own)).distinct()
    return docs.join(_few(gone), docs["doc_id"].eqNullSafe(F.col(own)), "left_anti")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, as often as the mix begins them: sources near their targets."""
    own, source, words, copies, copy = _free(docs, "__id", "__source", "__size", "__copies", "__copy")
    found = mix_sources(docs).groupBy(F.col("doc_id").alias(own), F.col("source").alias(source), F.col("size").alias(words))
    found = cut(found.agg(F.max("copies").alias(copies)).filter(F.col(copies) > 0), "mix")
    size = F.regexp_count(text_of(), F.lit(WORD)).cast("long")
    same = docs["doc_id"].eqNullSafe(F.col(own)) & docs["source"].eqNullSafe(F.col(source)) & (size == F.col(words))
    joined = docs.join(_few(found), same)
    repeated = joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))))
    return repeated.select(*(docs[c] for c in docs.columns))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, the token ids, their number, and whether decoding them gives the text back."""
    out = bpe_append(docs.select("doc_id", "source", "text"), tokenizer_path(), ids_col="ids", decoded_col="__decoded")
    return out.select("doc_id", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), (F.col("__decoded") == text_of()).alias("round_trip"))


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", without_copies),
    ("n-gram Jaccard join", without_near_copies),
    ("mixing sources to target weights", mixed),
    ("BPE encoding and decoding", encoded),
]

#: SQL cannot express the classifier, the mix's seeded order or the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, f"stage-{k}")
    return docs
