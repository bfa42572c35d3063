"""SimHash fingerprints and their exact near-duplicate classes by tiled comparison.

Fingerprints are cut into four words of 16 bits; the population counts of the four form the tile of a fingerprint. Two
fingerprints within r differing bits have tiles whose counts differ by r at most in sum, so all other pairs of tiles are
skipped without reading them. Every tile meets itself and the tiles that follow it within that distance (64 of the 128
around it for r = 3): its task gets its own fingerprints and theirs, and compares blocks of them by numpy exclusive-or and
bit counts, skipping blocks whose whole population counts lie further apart.

A task returns a spanning forest of its links, not the links: a dense group of n fingerprints costs n rows. Components come
from the union of the forests. Equal fingerprints are one row before any comparison.

Defined results: null and empty texts and texts without a word have fingerprint zero and are linked like any other; rows
that repeat a doc_id each get their own row; a null doc_id counts as larger than any other for the component id, and a
component of null ids alone has a null id; an empty table gives an empty table; other columns are not looked at."""
from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourwise.llm.common import give_back, slices, texts_of
from hourwise.llm.components import components
from hourwise.session import cut_lineage

WORDS = 4                    # words of 16 bits that a fingerprint is cut into
BLOCK_ROWS, BLOCK_COLUMNS = 256, 2048
SEED = 42


def fingerprint(text: str, shingle: int = 3) -> int:
    """Bit b is set if more than half of the shingle hashes have it set."""
    words = text.encode().lower().split()          # of bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
        starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(joined)]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1:])]
    h = np.array(hashes, "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed number) of every document."""
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")

    def run(batches):
        for batch in slices(batches):
            fp = np.array([fingerprint(t, shingle) for t in texts_of(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])
        give_back()
    return source.mapInArrow(run, "doc_id bigint, fp bigint")


def steps_within(radius: int) -> list[tuple[int, ...]]:
    """Differences of population counts within `radius` in sum: zero, and one of each pair of opposite ones."""
    around = [d for d in product(range(-radius, radius + 1), repeat=WORDS) if sum(map(abs, d)) <= radius]
    return [d for d in around if d >= (0,) * WORDS]


def merged_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of 0..n-1 over the links (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            far = label[label]
            if (far == label).all():
                break
            label = far
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def near_pairs(home: np.ndarray, others: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of home and others within the radius, block by block; both sorted by population count."""
    count_h, count_o = np.bitwise_count(home).astype(int), np.bitwise_count(others).astype(int)
    for i in range(0, len(home), BLOCK_ROWS):
        block = home[i:i + BLOCK_ROWS]
        low, high = count_h[i] - radius, count_h[min(i + BLOCK_ROWS, len(home)) - 1] + radius
        for j in range(int(np.searchsorted(count_o, low)), int(np.searchsorted(count_o, high, "right")), BLOCK_COLUMNS):
            end = min(j + BLOCK_COLUMNS, len(others))
            x, y = np.nonzero(np.bitwise_count(block[:, None] ^ others[None, j:end]) <= radius)
            if len(x):
                yield x + i, y + j


def forest(fps: np.ndarray, own: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Tree links (fingerprint, root) of the near pairs of a tile: own with own, and own with visitors."""
    order = np.lexsort((np.bitwise_count(fps), ~own))              # own first, each part by population count
    fps, own = fps[order], own[order]
    n, h = len(fps), int(own.sum())
    label, held_a, held_b, held = np.arange(n), [], [], 0

    def settle():
        nonlocal label, held_a, held_b, held
        if held:
            a, b = np.concatenate([*held_a, np.arange(n)]), np.concatenate([*held_b, label])
            label, held_a, held_b, held = merged_labels(n, a, b), [], [], 0
    for shift, others in ((0, fps[:h]), (h, fps[h:])):
        for x, y in near_pairs(fps[:h], others, radius):
            y = y + shift
            fresh = label[x] != label[y]
            if fresh.any():
                held_a.append(x[fresh])
                held_b.append(y[fresh])
                held += int(fresh.sum())
                if held > 1_000_000:
                    settle()
    settle()
    at = np.flatnonzero(label != np.arange(n))
    return fps[at], fps[label[at]]


def tile_of(fp: Column) -> list[Column]:
    return [F.bit_count(F.shiftrightunsigned(fp, 16 * k).bitwiseAND(F.lit(0xFFFF).cast("bigint"))).cast("int") for k in range(WORDS)]


def near_links(groups: DataFrame, radius: int = 3) -> DataFrame:
    """Forest links (a, b) between distinct fingerprints fp of `groups`."""
    steps = F.array(*[F.array(*[F.lit(x) for x in d]) for d in steps_within(radius)])
    moved = groups.select("fp", F.array(*tile_of(F.col("fp"))).alias("t"), F.explode(steps).alias("d"))
    # a fingerprint goes to the tile at t - d, so that a tile meets those that follow it
    spot = [F.col("t")[k] - F.col("d")[k] for k in range(WORDS)]
    tile, inside = F.lit(0), F.lit(True)
    for s in spot:
        tile, inside = tile * 17 + s, inside & s.between(0, 16)
    moved = moved.where(inside).select(tile.alias("tile"), "fp", F.forall("d", lambda x: x == 0).alias("own"))

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        own = part["own"].to_numpy(bool)
        if not own.any():
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        a, b = forest(part["fp"].to_numpy().view(np.uint64), own, radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})
    return moved.groupBy("tile").applyInPandas(compare, "a bigint, b bigint")


def near_classes(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id of every document."""
    prints = cut_lineage(fingerprints(docs, shingle))
    groups = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    linked = components(near_links(groups, radius)).withColumnRenamed("node", "fp")
    groups = groups.join(linked, "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    smallest = groups.groupBy("component").agg(F.min("first").alias("component_id"))
    named = groups.join(smallest, "component").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
