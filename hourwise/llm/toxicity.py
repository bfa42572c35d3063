"""Toxicity: logistic regression by the follow-the-regularised-leader rule over hashed word n-grams and skip-grams.

Features are binary: words, neighbouring pairs and pairs with one or two words between, hashed into 2^20 places. Every place
has its own learning rate (from its summed squared gradients) and a one-norm threshold that leaves most weights exactly
zero, so the model is a short list of (place, weight) that fits any worker.

Training takes at most `most_rows` labelled documents, those with the smallest hash of doc_id; this bound is a parameter.
Of several rows of a doc_id one is learned from: that with the smallest hash of its text.
They are dealt into groups of about `shard_rows`; each runs the rule over its rows several times, and the weights are
averaged on the executors. Scoring is one map over all documents.

Defined results: null and empty texts score as the bias alone; a document without a doc_id counts as held out and is never
learned from; of several labels of a doc_id the highest counts; null labels are left out; without labels every score is 0.5;
columns other than doc_id and text are not looked at."""
from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructType

from hourwise.llm.common import give_back, slices, texts_of, with_columns

BITS = 20
PLACES = 1 << BITS
BIAS = PLACES
TOKEN = re.compile(r"\w+")
MOST_KNOWN = 200_000


class Hashes(dict):
    """Stable 32-bit hash of a word, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > MOST_KNOWN:
            self.clear()
        value = self[word] = zlib.crc32(word.encode())
        return value


_HASHES = Hashes()


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of every n-gram and skip-gram occurrence of the texts."""
    words = [TOKEN.findall(t.lower()) for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    h = np.fromiter((_HASHES[w] for ws in words for w in ws), np.uint64, int(sizes.sum()))
    row = np.repeat(np.arange(len(texts)), sizes)
    h *= np.uint64(0x9E3779B97F4A7C15)
    places, rows = [h >> np.uint64(64 - BITS)], [row]
    for gap, odd in ((1, 0xC2B2AE3D27D4EB4F), (2, 0x165667B19E3779F9), (3, 0x27D4EB2F165667C5)):
        if len(h) > gap:
            pair = (h[:-gap] ^ (h[gap:] >> np.uint64(7))) * np.uint64(odd) + h[gap:]
            same = row[:-gap] == row[gap:]
            places.append(((pair * np.uint64(odd)) >> np.uint64(64 - BITS))[same])
            rows.append(row[:-gap][same])
    return np.concatenate(rows), np.concatenate(places).astype(np.int64)


def ftrl(examples: list[tuple[np.ndarray, float]], passes: int, alpha: float, beta: float, l1: float, l2: float) -> tuple[np.ndarray, np.ndarray]:
    """(places, weights) that are not zero after the passes."""
    z, n = np.zeros(PLACES + 1), np.zeros(PLACES + 1)

    def weights(x):
        zx = z[x]
        return np.where(np.abs(zx) <= l1, 0.0, -(zx - np.sign(zx) * l1) / ((beta + np.sqrt(n[x])) / alpha + l2))
    for _ in range(passes):
        for x, y in examples:
            w = weights(x)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            s = (np.sqrt(n[x] + g * g) - np.sqrt(n[x])) / alpha
            z[x] += g - s * w
            n[x] += g * g
    at = np.flatnonzero((np.abs(z) > l1) & (n > 0))
    return at, weights(at)


def bucket_of(column: str, modulus: int) -> Column:
    """crc32 of the value as text, modulo; null for null."""
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(modulus))


def sampled_labels(labels: DataFrame, label: str, train: Column, most_rows: int) -> DataFrame:
    """doc_id and y of at most `most_rows` labelled rows, those with the smallest hash. A bounded table."""
    return (labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & train).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows))


def sampled_rows(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """doc_id, y and text: one row for each doc_id of `chosen` that `docs` has, however often it repeats."""
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")      # a bounded table of two numbers a row
    found = joined.groupBy("doc_id").agg(F.max("y").alias("y"), F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("one"))
    return found.select("doc_id", "y", F.col("one.text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", train: Column | None = None, most_rows: int = 24_000,
        shard_rows: int = 8_000, passes: int = 6, alpha: float = 4.0, beta: float = 1.0, l1: float = 4.0, l2: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(places, weights); place `BIAS` is the bias. `train`: condition on doc_id for rows that may be learned from."""
    chosen = sampled_labels(labels, label, F.lit(True) if train is None else train, most_rows)
    shards = max(1, -(-chosen.count() // shard_rows))
    rows = sampled_rows(docs, chosen).withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)))

    def examples(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("doc_id")
        order = np.random.default_rng(0).permutation(len(part))
        text, y, found = part["text"].tolist(), part["y"].to_numpy(float), []
        for k in order:
            _, x = grams([text[k] or ""])
            found.append((np.append(np.unique(x), BIAS).astype(np.int32), y[k]))
        at, w = ftrl(found, passes, alpha, beta, l1, l2)
        del found, text, part
        give_back()
        return pd.DataFrame({"place": at, "w": w})
    model = (rows.groupBy("shard").applyInPandas(examples, "place bigint, w double").groupBy("place").agg(F.sum("w").alias("w"), F.count("*").alias("c")))
    used = rows.select("shard").distinct().count()
    held = model.where("w <> 0").toPandas()       # one row per place at most: 2^20 + 1
    if not used or held.empty:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    return held["place"].to_numpy(np.int64), (held["w"].to_numpy() / used).astype(np.float32)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], keep: tuple[str, ...] = ("doc_id",), text: str = "text",
          name: str = "score") -> DataFrame:
    """`keep` and the score, called `name`, of every document, whole texts."""
    keep = list(keep)
    source = docs.select(*keep, F.col(text).alias("__text"))
    schema = StructType([source.schema[c] for c in keep]).add(name, DoubleType())
    arrow, shared = to_arrow_schema(schema), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        places, values = shared.value
        weight = np.zeros(PLACES + 1, np.float32)
        weight[places] = values
        for batch in slices(batches, 128):
            row, place = grams(texts_of(batch, "__text"))
            hit = np.flatnonzero(weight[place])
            once = np.unique(row[hit] * (PLACES + 1) + place[hit])
            total = weight[BIAS] + np.bincount(once // (PLACES + 1), weight[once % (PLACES + 1)], batch.num_rows)
            yield with_columns(batch, keep, arrow, **{name: 1.0 / (1.0 + np.exp(-np.clip(total.astype(float), -35, 35)))})
        give_back()
    return source.mapInArrow(run, schema)
