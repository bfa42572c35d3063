"""Exact dedup against a history held in minimal perfect hash shards.

History is a table of distinct text digests. It is dealt into shards by the digest; each shard is one row with a minimal
perfect hash: on level k every key left hashes to one of twice as many places, keys alone in their place are settled there,
the others go to level k + 1; the number of settled places before a key's is its slot. A slot holds the full digest, the
doc_id of the winner and how many rows share the text. A looked-up digest lands in some slot always, so its 32 bytes are
checked there.

Arriving rows are first grouped by digest (pre-aggregated before the shuffle, so a text that a third of all rows share is one
row per task). Distinct digests then meet the shards. Members fold into their slot, nonmembers stay groups of their own.

Texts are equal when identical after lower-casing A-Z; the row with the largest doc_id stays (a null doc_id is smaller than
any). Defined results: null counts as the empty text; rows that repeat doc_id and text are all kept or all dropped, as
nothing tells them apart; an empty table gives an empty table; other columns are not looked at."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourwise.llm.common import lower_ascii
from hourwise.session import cut_lineage

SHARD_KEYS = 20_000          # digests a shard holds on average
SLOT = np.dtype([("digest", "V32"), ("keep", "<i8"), ("known", "?"), ("count", "<i8")])
INDEX_SCHEMA = "shard bigint, n bigint, sizes array<bigint>, bits binary, slots binary"
GROUP = ("digest", "keep", "count")


def text_digest(text: Column | str = "text") -> Column:
    """SHA-256 of the text, lower-cased A-Z, in UTF-8; null counts as empty."""
    text = F.col(text) if isinstance(text, str) else text
    return F.unhex(F.sha2(lower_ascii(F.coalesce(text, F.lit(""))).cast("binary"), 256))


def grouped(rows: DataFrame) -> DataFrame:
    """(digest, keep, count): one row per distinct digest of (digest, doc_id) rows."""
    return rows.groupBy("digest").agg(F.max("doc_id").alias("keep"), F.count("*").alias("count"))


def _places(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """Place of each digest on a level; `words` are its four 64-bit words, of which each level takes another."""
    h = words[:, level % 4] ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((h ^ (h >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


def build(digests: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(sizes of the levels, their bits, slot of each digest) for distinct 32-byte digests."""
    words, left = digests.view("<u8").reshape(-1, 4), np.arange(len(digests))
    sizes, bits, slots, before = [], [], np.zeros(len(digests), np.int64), 0
    while len(left):
        size = 2 * len(left)
        at = _places(words[left], len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        settled = alone[at]
        slots[left[settled]] = before + (np.cumsum(alone) - 1)[at[settled]]
        before += int(alone.sum())
        sizes.append(size)
        bits.append(alone)
        left = left[~settled]
    return sizes, np.concatenate(bits) if bits else np.zeros(0, bool), slots


def slots_of(digests: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """The slot of each digest; -1 where no level settles it, and some slot where it is no member."""
    words, left, found = digests.view("<u8").reshape(-1, 4), np.arange(len(digests)), np.full(len(digests), -1, np.int64)
    rank, start = np.cumsum(bits) - 1, 0
    for level, size in enumerate(sizes):
        at = start + _places(words[left], level, size)
        hit = bits[at]
        found[left[hit]] = rank[at[hit]]
        left, start = left[~hit], start + size
        if not len(left):
            break
    return found


def _array(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "V32")


def shard_of(shards: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(shards))


def build_history(history: DataFrame, shards: int) -> DataFrame:
    """The index of `history` (digest, keep, count; distinct digests), one row a shard."""
    def make(part: pd.DataFrame) -> pd.DataFrame:
        digests = _array(part["digest"])
        sizes, bits, slots = build(digests)
        table = np.zeros(len(digests), SLOT)
        table["digest"][slots], table["count"][slots] = digests, part["count"]
        table["keep"][slots], table["known"][slots] = part["keep"].fillna(0).astype("int64"), part["keep"].notna()
        return pd.DataFrame({"shard": part["shard"].iloc[:1].to_numpy(), "n": [len(digests)], "sizes": [sizes], "bits": [np.packbits(bits).tobytes()],
                             "slots": [table.tobytes()]})
    return history.select(shard_of(shards).alias("shard"), *GROUP).groupBy("shard").applyInPandas(make, INDEX_SCHEMA)


def meet(index: DataFrame, arrivals: DataFrame, shards: int) -> DataFrame:
    """(digest, keep, count, member) of every digest of the index and the arrivals (digest, keep, count; distinct digests).

    member is null for history that nothing met, true for repeats of history and false for new texts."""
    def look(held: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        out, told = [], []
        digests = _array(new["digest"])
        keep, known = new["keep"].fillna(0).to_numpy("int64"), new["keep"].notna().to_numpy(bool)
        count, member = new["count"].to_numpy("int64"), np.zeros(len(new), bool)
        if len(held):
            row = held.iloc[0]
            sizes = [int(x) for x in row["sizes"]]
            bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=sum(sizes)).astype(bool)
            table = np.frombuffer(row["slots"], SLOT).copy()
            slot = slots_of(digests, sizes, bits)
            candidate = np.flatnonzero(slot >= 0)
            same = candidate[table["digest"][slot[candidate]] == digests[candidate]]      # all 32 bytes
            member[same] = True
            at = slot[same]
            table["count"][at] += count[same]
            better = known[same] & (~table["known"][at] | (keep[same] > table["keep"][at]))
            table["keep"][at[better]], table["known"][at[better]] = keep[same][better], True
            met = np.zeros(len(table), bool)
            met[at] = True
            out.append(table)
            told += [True if m else None for m in met]
        fresh = np.zeros(int((~member).sum()), SLOT)
        for name, values in (("digest", digests), ("keep", keep), ("known", known), ("count", count)):
            fresh[name] = values[~member]
        out.append(fresh)
        told += [False] * len(fresh)
        rows = np.concatenate(out)
        return pd.DataFrame({"digest": [d.tobytes() for d in rows["digest"]], "keep": pd.arrays.IntegerArray(rows["keep"].astype("int64"), ~rows["known"]),
                             "count": rows["count"], "member": pd.array(told, "boolean")})
    new = arrivals.select(shard_of(shards).alias("shard"), *GROUP)
    return index.groupBy("shard").cogroup(new.groupBy("shard")).applyInPandas(look, "digest binary, keep bigint, count bigint, member boolean")


def dedup(docs: DataFrame, is_history: Column, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and repeats_history of every document.

    Rows where `is_history` holds are indexed, all others arrive and are looked up; the result is the same wherever the line
    is drawn. repeats_history: the text is in both parts."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(is_history, F.lit(False)).alias("old"), text_digest().alias("digest"))
    rows = cut_lineage(rows)                       # 50 bytes a document, read three times
    history = cut_lineage(grouped(rows.where("old")))
    shards = max(1, -(-history.count() // shard_keys))
    groups = meet(build_history(history, shards), grouped(rows.where("not old")), shards)
    named = groups.select("digest", F.col("keep").alias("keep_id"), F.col("count").alias("group_size"), F.coalesce("member", F.lit(False)).alias("repeats_history"))
    return (rows.join(named, "digest")
            .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "repeats_history"))
