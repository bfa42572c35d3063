"""Documents drawn to look like a target: hashed n-gram importance weights and a Gumbel draw.

Features are all runs of one and two consecutive words; a feature's bucket is the crc32 of its bytes modulo `buckets`. Corpus and
target counts per bucket give each bucket a gain; the weight of a document is the floored mean gain of its features; with
seeded Gumbel noise added, the highest scores are a draw without replacement.

Newlines separate words, so texts are cut there into lines. For the counts every distinct line of a table is one row with its
occurrences: its features are worked out once and counted that many times. Pairs of words on both sides of a line break are
counted on their own, as are gains of documents: a worker remembers what the lines it met are worth (bounded; the oldest memory
goes as a whole). Line texts are combined before they are shuffled, so a line that a third of all documents share is a row a task.
Only the counts of the buckets come to the driver.

Defined results: null and empty texts and texts without a word have no features, weight 0 and a score, and are never drawn;
very long texts are worked off line by line, whole; a null doc_id hashes like the empty text and comes last among equal scores;
rows that repeat a doc_id are documents of their own, equal ones with one score and ranks in a row; an empty table gives an
empty table, an empty target gain from the corpus alone; other columns, whatever their names, are not looked at."""
from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourwise.llm.common import give_back, slices
from hourwise.operators.numbering import numbered
from hourwise.session import cut_lineage

BUCKETS = 10_000
MOST_WORDS, MOST_LINES, LINE_BYTES = 300_000, 50_000, 400          # what a worker remembers: words, lines, and how long those may be
# letters and digits of ASCII in lower case, newlines and all bytes beyond ASCII stay; the rest separates words
_PLAIN = bytes(b if b >= 128 or b == 10 or chr(b).isalnum() else 32 for b in range(256)).lower()


class _Words(dict):
    """word: (its crc32, a space and the word)."""
    def __missing__(self, word: bytes) -> tuple[int, bytes]:
        if len(self) >= MOST_WORDS:
            self.clear()
        self[word] = known = (crc32(word), b" " + word)
        return known


def features(line: bytes, words: _Words, buckets: int = BUCKETS) -> tuple[list[int], bytes, bytes]:
    """Buckets of the runs of one and two words of a line of plain bytes, its first and its last word."""
    parts = line.split()
    if not parts:
        return [], b"", b""
    known = [words[w] for w in parts]
    single = [c % buckets for c, _ in known]
    double = [crc32(b, a) % buckets for (a, _), (_, b) in zip(known, known[1:])]
    return single + double, parts[0], parts[-1]


def breaks(lines: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """The last word of every line that has one, with the first word of the next line that has one."""
    before = b""
    for line in lines:
        if line and not line.isspace():
            if before:
                yield before, line.split(None, 1)[0]
            before = line.rsplit(None, 1)[-1]


def distinct_lines(texts: DataFrame) -> DataFrame:
    """(line, times) of a table with `text`: every distinct line and how often it stands there."""
    return texts.select(F.explode(F.split("text", "\n", -1)).alias("line")).groupBy("line").agg(F.count("*").alias("times"))


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all texts in each bucket."""
    def of_lines(batches):
        words, held = _Words(), np.zeros(buckets, np.int64)
        for batch in slices(batches, 1024):
            for line, times in zip(batch.column("line").to_pylist(), batch.column("times").to_pylist()):
                found, _, _ = features(line.encode().translate(_PLAIN), words, buckets)
                if found:
                    np.add.at(held, found, times)
        yield _counts(held)

    def of_breaks(batches):
        words, held = _Words(), np.zeros(buckets, np.int64)
        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                found = [crc32(words[b][1], words[a][0]) % buckets for a, b in breaks((text or "").encode().translate(_PLAIN).split(b"\n"))]
                if found:
                    np.add.at(held, found, 1)
        yield _counts(held)
    schema = "bucket int, n bigint"
    both = distinct_lines(texts).mapInArrow(of_lines, schema).unionAll(texts.select("text").mapInArrow(of_breaks, schema))
    return both.groupBy("bucket").agg(F.sum("n").alias("n"))


def _counts(held: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(held)
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(held[at], pa.int64())], names=["bucket", "n"])


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """The gain of every bucket in thousandths, from the counts of both tables."""
    sides = bucket_counts(docs, buckets).withColumn("aim", F.lit(False)).unionAll(bucket_counts(target, buckets).withColumn("aim", F.lit(True)))
    here, aim = [0] * buckets, [0] * buckets
    for row in sides.collect():                       # at most two rows a bucket
        (aim if row["aim"] else here)[row["bucket"]] = row["n"]
    all_here, all_aim = float(sum(here) + buckets), float(sum(aim) + buckets)
    return [math.floor(1000 * math.log((t + 1.0) * all_here / ((s + 1.0) * all_aim))) for s, t in zip(here, aim)]


def noise(seed: int, doc_id) -> int:
    """Gumbel noise in thousandths, from the sha256 of (seed, doc_id)."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gain: list[int], seed: int = 7) -> DataFrame:
    """doc_id, n_features, weight and score of every document."""
    buckets, shared = len(gain), docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches):
        gain, words, lines = shared.value, _Words(), {}
        for batch in slices(batches):
            ids, counts, weights, scores = batch.column("doc_id").to_pylist(), [], [], []
            for doc_id, text in zip(ids, batch.column("text").to_pylist()):
                total, n, before = 0, 0, b""
                for line in (text or "").encode().translate(_PLAIN).split(b"\n"):
                    known = lines.get(line)
                    if known is None:
                        found, first, last = features(line, words, buckets)
                        known = (sum([gain[b] for b in found]), len(found), first, last)
                        if len(line) <= LINE_BYTES:
                            if len(lines) >= MOST_LINES:
                                lines.clear()
                            lines[line] = known
                    worth, size, first, last = known
                    if size:
                        total, n = total + worth, n + size
                        if before:
                            total, n = total + gain[crc32(words[first][1], words[before][0]) % buckets], n + 1
                        before = last
                counts.append(n)
                weights.append(total // n if n else 0)
                scores.append(weights[-1] + noise(seed, doc_id))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (counts, weights, scores))], names=["doc_id", "n_features", "weight", "score"])
        give_back()
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n_features bigint, weight bigint, score bigint")


def draw(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; rank is null for documents that are not drawn.

    Of the documents with at least `least_words` words, `percent` in a hundred are drawn."""
    rows = cut_lineage(weigh(docs, gains(docs, target, buckets), seed))
    long_enough: Column = F.col("n_features") >= 2 * least_words - 1
    drawn = rows.where(long_enough).count() * percent // 100
    # the place of a row in the checkpointed table tells rows apart that are equal in everything
    ranked = numbered(rows.where(long_enough), [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features")], "rank", ties=F.xxhash64(F.monotonically_increasing_id()))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranked.unionByName(rows.where(~long_enough).withColumn("rank", F.lit(None).cast("bigint")))
