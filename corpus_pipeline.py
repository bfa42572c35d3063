"""From raw documents to token ids: toxicity, line dedup, near-duplicates, source mixing, byte-pair encoding.

Every stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame; `run` writes each result as
Parquet below the folder that driver and executors share and reads it again for the next stage. All stages but the last
return the columns of documents. Near duplicates: texts whose fingerprints differ by 3 bits at most, found by the tiles of
`simhash`, and, because these miss most of them, sets of five-word shingles that overlap by 0.8 or more, compared exactly."""
from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourwise.llm import line_dedup, mixing, near_copies, toxicity, trie_bpe
from hourwise.llm.common import free_prefix
from hourwise.llm.queries import TOXIC_SCORE
from hourwise.queries.registry import ship_package
from hourwise.session import shared_folder

ORACLE_SQL = None
NEAR_BITS = 3                # the radius of the fingerprints, as in the operator's own query
ROOT = os.path.dirname(os.path.abspath(__file__))


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored toxic go; learned as in the toxicity query. Null and empty texts are scored as empty ones, equal rows alike;
    an empty table stays empty."""
    ship_package(spark, ROOT)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, "toxic", train=toxicity.bucket_of("doc_id", 3) != 1)
    score = free_prefix(docs.columns) + "score"
    return toxicity.score(docs, model, keep=tuple(docs.columns), name=score).where(F.col(score) < TOXIC_SCORE).drop(score)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of lines are cut out of the texts; n_chars follows. Documents with nothing left but white space go,
    unless they came in so: they were copies as a whole. Null texts stay null; equal rows get one result, the first place's; an empty
    table stays empty."""
    lines, gone = (free_prefix(docs.columns) + n for n in ("lines", "gone"))
    done = line_dedup.dedup_runs(docs, lines=lines, gone=gone)
    whole_copy = (F.col(lines) > 0) & (F.size(gone) == F.col(lines))
    return done.where(~whole_copy).select(*[F.length("text").cast(t).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c, t in docs.dtypes])


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fingerprints and their tiles link texts, and so do shared shingles; one row of every class stays: that with the smallest doc_id (null last), then the smallest hash of the text,
    then of the row; of rows equal in every column one."""
    ship_package(spark, ROOT)
    return near_copies.without_near_copies(docs, radius=NEAR_BITS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it. Documents without a word (null or empty texts) come as often as is certain for
    their source; equal rows are drawn one by one; an empty table stays empty."""
    own = free_prefix(docs.columns)
    marks = size, _, _, copies = tuple(own + n for n in ("size", "source_size", "target", "copies"))
    mixed = mixing.mix(docs, marks=marks)
    return mixed.where(F.col(copies) > 0).withColumn(size, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, the digest of the text that they decode to, and whether that is the text itself (null as empty). Equal
    rows get equal ids; an empty table gives an empty table."""
    ship_package(spark, ROOT)
    coded = trie_bpe.encode_texts(docs, keep=("doc_id", "source", "text"), decode=True)
    return coded.select("doc_id", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
                        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("intact"))


STAGES = [("toxicity", remove_toxic), ("line_dedup", remove_repeated_lines), ("near_duplicates", remove_near_copies), ("source_mix", mix_sources), ("bpe", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the documents of sf_dir."""
    folder, docs = shared_folder(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
