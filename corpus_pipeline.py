"""A training corpus from raw documents in five stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import line_dedup, mixing, near_links, sentencepiece_codec, toxicity
from tidemark.llm.common import crc_mod, durable, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the toxic label is under 0.7; fitted on labelled rows outside the held-out third."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 3) != 1)
    return toxicity.score(docs, model, out="__p").where("__p < 0.7").select(*COLUMNS)


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of repeated runs of lines; n_chars is that of the new text."""
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.when(F.col("__gone") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group joined by a likeness of 0.8 or more in five-word shingles, the document with the smallest id, then text hash. A null id is the smallest."""
    rows = docs.withColumn("th", _text_hash())
    linked = near_links.roots(docs).withColumnRenamed("th", "__h")
    found = rows.select("doc_id", "th").join(linked, F.col("th") == F.col("__h"), "left").select("doc_id", "th", F.coalesce("root", "th").alias("root"))
    # a text stands in one group only, so id and text hash of the kept row tell the group
    best = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("x"), "doc_id", "th")).alias("m")).select(F.col("m.doc_id").alias("__i"), F.col("m.th").alias("__t"))
    kept = rows.join(best, (F.col("th") == F.col("__t")) & F.col("doc_id").eqNullSafe(F.col("__i")))
    return kept.dropDuplicates(["doc_id", "th"]).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, up to twice."""
    m = mixing.mix(docs).groupBy(F.col("doc_id").alias("__i"), F.col("src").alias("__s"), "h2").agg(F.sum("copies").alias("copies"))
    m = durable(m.where("copies > 0"), "mix")
    # of rows that share id, source and text one stands for the copies of all
    rows = docs.dropDuplicates(["doc_id", "source", "text"]).withColumn("__h2", F.xxhash64(F.lit(23), F.coalesce(F.col("text"), F.lit(""))))
    kept = rows.join(m.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__i")) & F.col("source").eqNullSafe(F.col("__s")) & (F.col("__h2") == F.col("h2")))
    return kept.withColumn("__n", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every document."""
    return sentencepiece_codec.encode(docs, ["doc_id", "lang", "source"]).select("doc_id", "lang", "source", "n_ids", "exact", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", cut_repeated_lines),
    ("simhash near-dedup", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("sentencepiece encoding and decoding", tokenize),
]

#: Several stages can't be written in SQL; the tests hold the rows against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = durable(docs, "stage")
    return docs
