"""Near copies by shared shingles: documents whose sets of five-word shingles overlap by 0.8 (Jaccard) or more.

Documents with equal sets are one row before any comparison. BANDS keys of ROWS minima each (MinHash) bring likely pairs together:
two sets with overlap j share no key with odds (1 - j^5)^24, 7 in 100,000 at 0.8. No pair is merged on its keys: the shingle sets
of both are compared. In the first round every set of a group that shares a key meets the first one and the one before it,
sorted by further minima so that like sets are neighbours; that joins most copies. Groups that still hold more than one class are
then compared completely, all pairs of different classes, in blocks; a block returns a spanning forest of its links. Nothing is
left out: every pair that shares a key is compared or in one class already.

With a radius, the fingerprints of `simhash` link too: its tiles find every pair of fingerprints that differ by at most so many
bits, and all texts of linked fingerprints are one class, as in that operator. So classes are joined by either kind of link.

Shingles are of words in lower case (A-Z only) cut at ASCII white space; a text of fewer words is one shingle. Their 64-bit hashes
stand for them. Defined results: null and empty texts and texts without a word are copies of each other. One row of every class
stays: the smallest doc_id (null last), then the smallest hash of the text, then of the whole row; of rows equal in every column one."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourwise.llm.common import give_back, slices, texts_of
from hourwise.llm.components import joined_links
from hourwise.llm.simhash import fingerprint, near_links
from hourwise.session import cut_lineage

SHINGLE, BANDS, ROWS = 5, 24, 5
BLOCK = 512                  # sets of a key group that are compared with as many others at once
MOST_WORDS = 300_000         # word hashes a worker remembers
_NUMBERS = np.random.default_rng(7).integers(0, 2 ** 63, (2, BANDS * ROWS), np.uint64)
TIMES, PLUS = _NUMBERS[0] * 2 + 1, _NUMBERS[1]
STEP = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MOST_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, 42)
        return h


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str, hashes: dict) -> np.ndarray:
    """The sorted distinct hashes of the shingles of a text."""
    words = text.encode().lower().split()
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(SHINGLE, max(1, len(w)))
    h = np.full(max(1, len(w) - size + 1), len(w) if len(w) < SHINGLE else SHINGLE, np.uint64)
    for j in range(size if len(w) else 0):
        h = mixed(h * STEP + w[j:j + len(h)])
    return np.unique(h)


def minima(sets: np.ndarray) -> np.ndarray:
    low = np.full(BANDS * ROWS, 2 ** 64 - 1, np.uint64)
    for at in range(0, len(sets), 4096):
        low = np.minimum(low, (sets[at:at + 4096, None] * TIMES + PLUS).min(0))
    return low


def keys_of(low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A key for each band, and the leading bits of the four minima behind it, by which sets with one key are sorted."""
    bands = low.reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        key = mixed(key * STEP + bands[:, j])
    behind, tail = np.roll(bands, -1, 0), np.zeros(BANDS, np.uint64)
    for j in range(4):
        tail = (tail << np.uint64(16)) | (behind[:, j] >> np.uint64(48))
    return key.view(np.int64), tail.view(np.int64)


def marked(docs: DataFrame) -> DataFrame:
    """Adds the hashes of the text and of the whole row, which together stand for the row."""
    return docs.withColumns({"__th": F.xxhash64("text"), "__rh": F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])})


def sketches(rows: DataFrame, prints: bool = False) -> DataFrame:
    """(doc_id, th, rh, s, n, keys, tails): hash s of the set of every row, its size, its keys and sort numbers; with `prints` also
    fp, the fingerprint of its text."""
    source = rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), "__th", "__rh", "text")
    longs = pa.list_(pa.int64())

    def run(batches):
        hashes = _Hashes()
        for batch in slices(batches):
            texts = texts_of(batch)
            sets = [shingles(t, hashes) for t in texts]
            pairs = [keys_of(minima(x)) for x in sets]
            s = np.array([xxhash.xxh64_intdigest(x.tobytes(), 42) for x in sets], np.uint64).view(np.int64)
            arrays = [batch.column("doc_id"), batch.column("__th"), batch.column("__rh"), pa.array(s), pa.array([len(x) for x in sets], pa.int32()),
                      pa.array([k for k, _ in pairs], longs), pa.array([t for _, t in pairs], longs)]
            if prints:
                arrays.append(pa.array(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)))
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "th", "rh", "s", "n", "keys", "tails", "fp"][:len(arrays)])
        give_back()
    return source.mapInArrow(run, "doc_id bigint, th bigint, rh bigint, s bigint, n int, keys array<bigint>, tails array<bigint>" + ", fp bigint" * prints)


def sets_of(rows: DataFrame) -> DataFrame:
    """(s, set) of rows with s and text."""
    def run(batches):
        hashes = _Hashes()
        for batch in slices(batches, 64):
            yield pa.RecordBatch.from_arrays([batch.column("s"), pa.array([shingles(t, hashes).view(np.int64) for t in texts_of(batch)], pa.list_(pa.int64()))], names=["s", "set"])
        give_back()
    return rows.select("s", "text").mapInArrow(run, "s bigint, set array<bigint>")


def keyed(sets: DataFrame) -> DataFrame:
    """(s, n, key, tail): every set under each of its keys."""
    return sets.select("s", "n", F.inline(F.zip_with("keys", "tails", lambda k, t: F.struct(k.alias("key"), t.alias("tail")))))


def first_pairs(sets: DataFrame) -> DataFrame:
    """(a, b), a < b: every set with the one before it of each group with a common key, and with the group's first."""
    group = Window.partitionBy("key").orderBy("tail", "s")
    mine = F.struct("s", "n")
    others = F.array(F.lag(mine).over(group), F.first(mine).over(group.rowsBetween(Window.unboundedPreceding, 0)))
    met = keyed(sets).select("s", "n", others.alias("others")).select("s", "n", F.explode(F.array_distinct("others")).alias("o"))
    met = met.where("o is not null and s <> o.s and 5 * least(n, o.n) >= 4 * greatest(n, o.n)")
    return met.select(F.least("s", "o.s").alias("a"), F.greatest("s", "o.s").alias("b")).distinct()


def texts_of_sets(wanted: DataFrame, rows: DataFrame, holders: DataFrame) -> DataFrame:
    """(s, set) of the sets named in `wanted`."""
    held = wanted.select("s").distinct().join(holders, "s")
    return sets_of(rows.join(held, ["__th", "__rh"]).dropDuplicates(["s"]))


def overlapping(pairs: DataFrame, rows: DataFrame, holders: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets overlap by 0.8 or more."""
    sets = cut_lineage(texts_of_sets(pairs.select(F.col("a").alias("s")).union(pairs.select("b")), rows, holders))
    a, b = (sets.select(F.col("s").alias(c), F.col("set").alias(f"{c}_set")) for c in "ab")
    both = F.size(F.array_intersect("a_set", "b_set"))
    return pairs.join(a, "a").join(b, "b").where(5 * both >= 4 * (F.size("a_set") + F.size("b_set") - both)).select("a", "b")


def block_links(sets: list[np.ndarray], own: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) of links that join what the pairs of an own set and another one of a different class join, where these
    overlap by 0.8 or more; `group` holds the classes."""
    sizes = np.array([len(x) for x in sets])
    tokens, spot = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(spot, kind="stable")
    holder = np.repeat(np.arange(len(sets)), sizes)[order]
    starts, at = np.searchsorted(spot[order], np.arange(len(tokens) + 1)), np.concatenate([[0], np.cumsum(sizes)])
    label, found = np.unique(group, return_inverse=True)[1], []
    for i in np.flatnonzero(own):
        low, high = starts[spot[at[i]:at[i + 1]]], starts[spot[at[i]:at[i + 1]] + 1]
        reach = np.repeat(high - np.cumsum(high - low), high - low) + np.arange(int((high - low).sum()))
        both = np.bincount(holder[reach], minlength=len(sets))
        for j in np.flatnonzero((5 * both >= 4 * (sizes + sizes[i] - both)) & (label != label[i])):
            if label[i] != label[j]:                       # what is joined here already needs no second link
                found.append((i, j))
                label[label == label[j]] = label[i]
    return np.array([f[0] for f in found], int), np.array([f[1] for f in found], int)


def block_pairs(known: DataFrame, rows: DataFrame, holders: DataFrame) -> DataFrame:
    """(a, b) links between different classes of a key group, from rows (key, s, class).

    Sets of the largest class of a group are compared with those of the others, and those of the others with all: the others are cut into
    blocks by the hash of s, and so are all sets of the group. A task compares one block of the others with one of all, so it
    holds two blocks at most, whatever the size of the group."""
    sizes = known.groupBy("key", "class").agg(F.count("*").alias("c"))
    wide = sizes.groupBy("key").agg(F.sum("c").alias("m"), F.max(F.struct("c", "class")).alias("top"), F.count("*").alias("k")).where("m > 2 and k > 1")
    wide = wide.select("key", F.col("top.class").alias("top"), F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"), F.ceil((F.col("m") - F.col("top.c")) / BLOCK).cast("int").alias("own_blocks"))
    open_ = cut_lineage(known.join(wide, "key"))
    sets = cut_lineage(texts_of_sets(open_, rows, holders))

    def block(n):
        return F.pmod(F.xxhash64("s"), F.col(n)).cast("int")

    def every(n):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = open_.where("class <> top").select("key", block("own_blocks").alias("p"), every("blocks").alias("q"), "s", "class", F.lit(True).alias("own"))
    others = open_.select("key", every("own_blocks").alias("p"), block("blocks").alias("q"), "s", "class", F.lit(False).alias("own"))

    def compare(part):
        import pandas as pd
        i, j = block_links([np.asarray(x, np.int64) for x in part["set"]], part["own"].to_numpy(bool), part["class"].to_numpy())
        s = part["s"].to_numpy()
        return pd.DataFrame({"a": np.minimum(s[i], s[j]), "b": np.maximum(s[i], s[j])}, dtype="int64")
    return own.unionAll(others).join(sets, "s").groupBy("key", "p", "q").applyInPandas(compare, "a bigint, b bigint").distinct()


def fingerprint_links(sketched: DataFrame, radius: int) -> DataFrame:
    """(a, b) links of the sets of texts whose fingerprints are equal or linked by the tiles."""
    prints = cut_lineage(sketched.select("s", "fp").distinct())
    first = cut_lineage(prints.groupBy("fp").agg(F.min("s").alias("first")))
    same = prints.join(first, "fp").where("s <> first").select(F.col("s").alias("a"), F.col("first").alias("b"))
    a, b = (first.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_first")) for c in "ab")
    near = near_links(first.select("fp"), radius).join(a, "a").join(b, "b").select(F.col("a_first").alias("a"), F.col("b_first").alias("b"))
    return same.union(near)


def classes(sketched: DataFrame, rows: DataFrame, radius: int | None = None) -> DataFrame:
    """(s, class) of the sets that have a near copy."""
    sets = cut_lineage(sketched.groupBy("s").agg(F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("tails").alias("tails"), F.min(F.struct("th", "rh")).alias("holder")))
    holders = sets.select("s", F.col("holder.th").alias("__th"), F.col("holder.rh").alias("__rh"))
    links = cut_lineage(overlapping(cut_lineage(first_pairs(sets)), rows, holders))
    if radius is not None:
        links = cut_lineage(links.union(fingerprint_links(sketched, radius)))
    joined = joined_links(links)
    known = keyed(sets).select("s", "key").join(joined.withColumnRenamed("node", "s"), "s", "left").select("s", "key", F.coalesce("component", "s").alias("class"))
    more = block_pairs(known, rows, holders)
    found = joined_links(links.union(more))
    return found.select(F.col("node").alias("s"), F.col("component").alias("class"))


def without_near_copies(docs: DataFrame, radius: int | None = None) -> DataFrame:
    """One row of every class of near copies. `radius`: bits by which linked fingerprints may differ, none without it."""
    rows = marked(docs)
    sketched = cut_lineage(sketches(rows, radius is not None))
    row = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th", "rh")
    smallest = sketched.groupBy("s").agg(F.min(row).alias("row")).join(classes(sketched, rows, radius), "s", "left")
    stays = smallest.groupBy(F.coalesce("class", "s").alias("class")).agg(F.min("row").alias("row")).select(F.col("row.th").alias("__th"), F.col("row.rh").alias("__rh"))
    return rows.join(stays, ["__th", "__rh"], "left_semi").dropDuplicates(["__th", "__rh"]).select(*[F.col(f"`{c}`") for c in docs.columns])
