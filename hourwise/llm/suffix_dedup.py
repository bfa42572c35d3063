"""Repeated byte strings found by sorting suffixes: bytes covered by a string of `window` bytes of an earlier document go.

Strings of `window` bytes are judged, one for each place of a text. Not every suffix is moved: in each string the leading eight
bytes with the smallest hash (the first of equals) are its anchor. The choice depends on the string alone, so equal strings have
equal anchors at equal places, and only suffixes that start at anchors are sorted. Consecutive places with one anchor are a run,
about one for 22 bytes; a run travels with the bytes that its strings cover, lined up at the anchor.

Suffixes are dealt to buckets by ranges of their leading eight bytes; the splitters come from a bounded sample of anchors, and
a range too large for one bucket is dealt further by the hash of the leading bytes. The sample also names leading bytes that
are too common: strings take them as anchor only where they hold nothing rarer. Sample and splitters balance the work and decide
nothing. A border lies between different leading bytes, so all suffixes that could be equal are in one bucket and nothing is left
to compare across borders.

A bucket is sorted by multikey quicksort, eight bytes a key: all groups that are still equal are sorted by the next key
together, single ones drop out. First whole runs: of equal runs all but those of the smallest doc_id are repeats as a whole.
Then the strings of runs that share a long half with another document are sorted, and a string that an earlier
document holds is a repeat. Equal runs within one batch of documents are settled where they are read, and only the earliest
travels, so a passage that a third of all documents share is one run a batch. Rows equal in doc_id and text travel once a batch.

Defined results: null texts are empty texts, with nothing to remove; texts shorter than the window stay whole; very long texts are
worked off in overlapping chunks; strings in rows with one doc_id do not remove each other; a null doc_id counts as larger than
any other (as 2^63 - 1); an empty table gives an empty table; other columns, whatever their names, are not looked at."""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourwise.llm.common import give_back, slices, texts_of
from hourwise.session import cut_lineage

WINDOW, GRAM = 50, 8
PIECE, BATCH, BUCKET = 1 << 20, 1 << 23, 1 << 22          # bytes of text: hashed at once, read before runs are sent, in a bucket
SAMPLE = 1 << 25                                          # bytes of text sampled for the splitters
SAMPLED_KEYS, MOST_RANGES, HOT_SLOTS = 200_000, 1 << 14, 1 << 16
LEVEL = 6                                                 # of compression of what travels
NO_ID = 2 ** 63 - 1
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Shape:
    """Lengths that follow from the window. A row holds the bytes of a run lined up at the anchor, then two bytes: how many
    bytes before the anchor the run starts, and how many places it has."""

    def __init__(self, window: int = WINDOW):
        if not 2 * GRAM <= window <= 200:
            raise ValueError("window of 16 to 200 bytes")
        self.window, self.left = window, window - GRAM
        self.columns = self.left + window
        self.width = -(-(self.columns + 2) // 8) * 8
        self.half = self.left // 2


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _STEP
    return h ^ (h >> np.uint64(32))


def words_of(rows: np.ndarray, start: int, size: int) -> list[np.ndarray]:
    """Columns start.. of byte rows as keys of eight bytes in byte order; the last one reaches back if need be."""
    spots = [min(s, start + size - 8) for s in range(start, start + size, 8)]
    return [np.ascontiguousarray(rows[:, s:s + 8]).view(">u8").ravel().astype(np.uint64) for s in spots]


def anchors(text: np.ndarray, shape: Shape, hot: np.ndarray | None) -> np.ndarray:
    """The anchor of the string at every place of `text` that leaves room for one."""
    n = len(text) - GRAM + 1
    leading = np.ndarray((n,), ">u8", buffer=text, strides=(1,)).astype(np.uint64)
    h = mixed(leading) & np.uint64(0xFFFFFFFF)
    if hot is not None:
        h = (h >> np.uint64(1)) | (hot[(h & np.uint64(HOT_SLOTS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(31))
    low = (h << np.uint64(32)) | np.arange(n, dtype=np.uint64)
    size, reach = 1, shape.left + 1
    while size < reach:
        step = min(size, reach - size)
        low = np.minimum(low[:-step], low[step:])
        size += step
    return (low & np.uint64(0xFFFFFFFF)).astype(np.int64)


def runs(parts: Sequence[tuple[int, int, bytes]], shape: Shape, hot: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document number, first place, row) of the runs of `parts`: (document number, place of the part, its bytes)."""
    text = np.frombuffer(b"".join(p[2] for p in parts), np.uint8)
    sizes = np.array([len(p[2]) for p in parts])
    starts = np.cumsum(sizes) - sizes
    room = np.maximum(sizes - shape.window + 1, 0)
    total = int(room.sum())
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, shape.width), np.uint8)
    part = np.repeat(np.arange(len(parts)), room)
    place = np.arange(total) - np.repeat(np.cumsum(room) - room, room) + starts[part]
    anchor = anchors(text, shape, hot)[place]
    fresh = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(part, prepend=-1) != 0))
    count = np.diff(fresh, append=total)
    first, anchor, part = place[fresh], anchor[fresh], part[fresh]
    before = anchor - first
    room_around = np.concatenate([np.zeros(shape.left, np.uint8), text, np.zeros(shape.window, np.uint8)])
    rows = np.zeros((len(first), shape.width), np.uint8)
    rows[:, :shape.columns] = np.lib.stride_tricks.sliding_window_view(room_around, shape.columns)[anchor]
    rows[:, shape.columns], rows[:, shape.columns + 1] = before, count
    rows[:, :shape.columns] *= covered(rows[:, shape.columns:shape.columns + 2], shape)
    numbers, offsets = np.array([p[0] for p in parts]), np.array([p[1] for p in parts])
    return numbers[part], first - starts[part] + offsets[part], rows


def alike(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(indices, group numbers) of the entries equal to another one in all keys, by groups."""
    at, group = np.arange(len(keys[0])), np.zeros(len(keys[0]), np.int64)
    for key in keys:
        key = key[at]
        order = np.lexsort((key, group))
        at, key, group = at[order], key[order], group[order]
        number = np.cumsum(np.concatenate([[False], (key[1:] != key[:-1]) | (group[1:] != group[:-1])]) if len(at) else np.zeros(0, bool))
        several = np.bincount(number, minlength=1)[number] > 1
        at, group = at[several], number[several]
    return at, group


def earliest(group: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest and the largest doc of each entry's group; groups are in a row."""
    if not len(group):
        return doc, doc
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    sizes = np.diff(starts, append=len(group))
    return np.repeat(np.minimum.reduceat(doc, starts), sizes), np.repeat(np.maximum.reduceat(doc, starts), sizes)


def joined(keys: list[np.ndarray], start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans that meet or overlap within equal keys made one: (index of a span with the keys, start, end)."""
    if not len(start):
        return np.zeros(0, np.int64), start, end
    order = np.lexsort((start, *keys[::-1]))
    differs = np.zeros(len(order), bool)
    for k in keys:
        differs[1:] |= k[order][1:] != k[order][:-1]
    shift = np.cumsum(differs).astype(np.int64) << 36                 # texts are shorter than 2^36 bytes
    a, reach = start[order] + shift, np.maximum.accumulate(end[order] + shift)
    first = np.flatnonzero(np.concatenate([[True], a[1:] > reach[:-1]]))
    last = np.concatenate([first[1:] - 1, [len(order) - 1]])
    return order[first], a[first] - shift[first], reach[last] - shift[last]


class Runs:
    """Runs of documents: doc (rank), th (hash of the text), first place and row, as arrays of one length."""

    def __init__(self, doc, th, first, rows):
        self.doc, self.th, self.first, self.rows = doc, th, first, rows

    def take(self, at) -> Runs:
        return Runs(self.doc[at], self.th[at], self.first[at], self.rows[at])

    @classmethod
    def joined(cls, parts: Sequence[Runs], shape: Shape) -> Runs:
        empty = cls(*(np.zeros(0, np.int64),) * 3, np.zeros((0, shape.width), np.uint8))
        return cls(*(np.concatenate([getattr(p, n) for p in (empty, *parts)]) for n in ("doc", "th", "first", "rows")))

    def packed(self, shape: Shape) -> bytes:
        """Only the bytes that the strings cover travel; the lengths tell where they belong."""
        ends = self.rows[:, shape.columns:shape.columns + 2]
        body = [*(x.astype(np.int64).tobytes() for x in (self.doc, self.th, self.first)), ends.tobytes(), self.rows[:, :shape.columns][covered(ends, shape)].tobytes()]
        return zstandard.ZstdCompressor(level=LEVEL).compress(b"".join(body))

    @classmethod
    def unpacked(cls, body: bytes, n: int, shape: Shape) -> Runs:
        body = zstandard.ZstdDecompressor().decompress(body)
        rows = np.zeros((n, shape.width), np.uint8)
        rows[:, shape.columns:shape.columns + 2] = ends = np.frombuffer(body, np.uint8, 2 * n, 24 * n).reshape(n, 2)
        rows[:, :shape.columns][covered(ends, shape)] = np.frombuffer(body, np.uint8, offset=26 * n)
        return cls(*(np.frombuffer(body, np.int64, n, 8 * n * k) for k in range(3)), rows)


def covered(ends: np.ndarray, shape: Shape) -> np.ndarray:
    """Which columns of the rows hold bytes of the text."""
    column, begin = np.arange(shape.columns), (shape.left - ends[:, 0].astype(np.int64))[:, None]
    return (column >= begin) & (column < begin + (ends[:, 1].astype(np.int64) + shape.window - 1)[:, None])


def packed_spans(doc, th, start, end) -> bytes:
    return zstandard.ZstdCompressor().compress(np.stack([doc, th, start, end]).astype(np.int64).tobytes())


def unpacked_spans(body: bytes) -> list[np.ndarray]:
    return list(np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.int64).reshape(4, -1))


def settle_whole(held: Runs, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """(repeat, group): which runs equal a whole run of an earlier document, and a number shared by equal runs."""
    at, group = alike(words_of(held.rows, shape.left, 8) + words_of(held.rows, 0, shape.width))
    low, _ = earliest(group, held.doc[at])
    repeat, same = np.zeros(len(held.doc), bool), np.arange(len(held.doc))
    repeat[at] = held.doc[at] > low
    same[at] = len(held.doc) + group
    return repeat, same


def spans_of(held: Runs, at, low, high, shape: Shape) -> list[np.ndarray]:
    """doc, th, start and end of the bytes covered by the places low..high (counted from the run's first one)."""
    return [held.doc[at], held.th[at], held.first[at] + low, held.first[at] + high + shape.window]


def settle(held: Runs, shape: Shape) -> list[np.ndarray]:
    """doc, th, start, end of the bytes of a bucket that an earlier document holds."""
    window, left, half = shape.window, shape.left, shape.half
    at, group = alike(words_of(held.rows, left, GRAM))
    low, high = earliest(group, held.doc[at])
    held = held.take(np.sort(at[low < high]))                         # leading bytes that two documents share
    if not len(held.doc):
        return [np.zeros(0, np.int64)] * 4
    repeat, same = settle_whole(held, shape)
    count = held.rows[:, shape.columns + 1].astype(np.int64)
    found = [spans_of(held, np.flatnonzero(repeat), 0, count[repeat] - 1, shape)]
    open_ = np.flatnonzero(~repeat)                                   # of equal runs those of the earliest document
    held, same, count = held.take(open_), same[open_], count[open_]
    _, one, run = np.unique(same, return_index=True, return_inverse=True)
    rows, doc, before, many = held.rows[one], held.doc[one], held.rows[one, shape.columns].astype(np.int64), count[one]
    # strings with fewer than `half` bytes before the anchor share the bytes behind it, the others those before it
    for least, most, keys in ((0, half - 1, words_of(rows, left, window - half + 1)), (half, left, words_of(rows, left - half, half + GRAM))):
        a, b = np.maximum(before - many + 1, least), np.minimum(before, most)       # bytes before the anchor, of the strings looked at
        inside = np.flatnonzero(a <= b)
        at, group = alike([k[inside] for k in keys]) if len(inside) else (inside, inside)
        at = inside[at]
        first, last = earliest(group, doc[at])
        at = at[first < last]
        if not len(at):
            continue
        sizes = b[at] - a[at] + 1
        row = np.repeat(at, sizes)
        ahead = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(a[at], sizes)
        strings = np.lib.stride_tricks.sliding_window_view(rows, window, axis=1)[row, left - ahead]
        hit, group = alike([ahead.astype(np.uint64), *words_of(strings, 0, window)])
        first, _ = earliest(group, doc[row[hit]])
        hit = hit[doc[row[hit]] > first]
        if not len(hit):
            continue
        # from the strings of distinct runs to all runs that are equal to them
        place = before[row[hit]] - ahead[hit]
        low, high = np.full(len(rows), 255), np.full(len(rows), -1)
        np.minimum.at(low, row[hit], place)
        np.maximum.at(high, row[hit], place)                          # places of a run lie closer than a window: one span
        mine = np.flatnonzero(high[run] >= 0)
        found.append(spans_of(held, mine, low[run][mine], high[run][mine], shape))
    return [np.concatenate(x) for x in zip(*found)]


def _spans_batch(doc, th, start, end) -> pa.RecordBatch:
    at, a, b = joined([doc, th], start, end)
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc[at], th[at], a, b)], names=["doc", "th", "a", "b"])


def _parts(batches, shape: Shape) -> Iterator[list[tuple[int, int, int, bytes]]]:
    """Lists of (doc, th, place, bytes) of at most about BATCH bytes; long texts come in chunks that overlap by a window."""
    held, size = [], 0
    for batch in batches:
        columns = [batch.column(n) for n in ("doc", "th", "text")]
        for i in range(batch.num_rows):
            doc, th, text = columns[0][i].as_py(), columns[1][i].as_py(), columns[2][i].as_py()
            text = (text or "").encode()
            for at in range(0, max(1, len(text) - shape.window + 1), PIECE):
                chunk = text[at:at + PIECE + shape.window - 1]
                held.append((doc, th, at, chunk))
                size += len(chunk)
                if size >= BATCH:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def batch_runs(parts: list[tuple[int, int, int, bytes]], shape: Shape, hot: np.ndarray | None) -> Runs:
    """The runs of a batch; parts equal in doc, th and place are taken once."""
    parts = list({p[:3]: p for p in parts}.values())
    found, at = [], 0
    while at < len(parts):
        end, size = at, 0
        while end < len(parts) and (end == at or size + len(parts[end][3]) <= PIECE):
            size += len(parts[end][3])
            end += 1
        found.append(runs([(k, parts[k][2], parts[k][3]) for k in range(at, end)], shape, hot))
        at = end
    number, first, rows = (np.concatenate(x) for x in zip(*found))
    docs, hashes = np.array([p[0] for p in parts], np.int64), np.array([p[1] for p in parts], np.int64)
    return Runs(docs[number], hashes[number], first, rows)


def leading(rows: np.ndarray, shape: Shape) -> np.ndarray:
    return words_of(rows, shape.left, GRAM)[0]


def marked(docs: DataFrame, text: str = "text"):
    """(doc, th, text): rank and hash that name a text."""
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))


def sampled_keys(source: DataFrame, shape: Shape, hot: np.ndarray | None, share: float) -> np.ndarray:
    """Leading bytes of about `share` of the anchors of a sample."""
    def run(batches):
        for parts in _parts(batches, shape):
            keys = leading(batch_runs(parts, shape, hot).rows, shape)
            keys = keys[mixed(np.arange(len(keys), dtype=np.uint64)) < np.uint64(min(share, 1.0) * (2 ** 64 - 2 ** 12))]
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], names=["k"])
    return source.mapInArrow(run, "k bigint").toPandas()["k"].to_numpy(np.int64).view(np.uint64)


def plan_buckets(source: DataFrame, shape: Shape) -> tuple[np.ndarray, int, np.ndarray | None]:
    """Splitters, buckets to each range, and the slots of leading bytes that are too common (None if there are none)."""
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(source.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // BUCKET)
    ranges = min(buckets, MOST_RANGES)
    sample = cut_lineage(source if size <= SAMPLE else source.where(F.rand(11) < SAMPLE / size))
    share = SAMPLED_KEYS / max(1.0, min(size, SAMPLE) / (shape.left / 2 + 1))
    keys = sampled_keys(sample, shape, None, share)
    slot = (mixed(keys) & np.uint64(HOT_SLOTS - 1)).astype(np.int64)
    hot = np.bincount(slot, minlength=HOT_SLOTS) > max(8, len(keys) / (2 * buckets))
    if hot.any():
        keys = sampled_keys(sample, shape, hot, share)
    keys = np.sort(keys)
    return np.unique(keys[[len(keys) * k // ranges for k in range(1, ranges)]]) if len(keys) else keys, -(-buckets // ranges), hot if hot.any() else None


def removed_spans(docs: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """(doc, th, spans): sorted spans, each once, of the bytes to remove; documents without any are absent. Spans may overlap."""
    shape, source = Shape(window), marked(docs, text).where(F.octet_length("text") >= window)
    splitters, fan, hot = plan_buckets(source, shape)
    buckets = (len(splitters) + 1) * fan
    shared = docs.sparkSession.sparkContext.broadcast((splitters, hot))

    def send(batches):
        splitters, hot = shared.value
        for number, parts in enumerate(_parts(batches, shape)):
            held = batch_runs(parts, shape, hot)
            if not len(held.doc):
                continue
            repeat, _ = settle_whole(held, shape)
            gone = np.flatnonzero(repeat)
            spans = spans_of(held, gone, 0, held.rows[gone, shape.columns + 1].astype(np.int64) - 1, shape)
            at, a, b = joined(spans[:2], *spans[2:])
            held = held.take(np.flatnonzero(~repeat))
            keys = leading(held.rows, shape)
            bucket = np.searchsorted(splitters, keys, "right") * fan + (mixed(keys) >> np.uint64(8)).astype(np.int64) % fan
            order = np.lexsort((held.first, held.doc, keys, bucket))
            held, bucket = held.take(order), bucket[order]
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
            ends = np.append(cuts[1:], len(bucket))
            columns = [bucket[cuts].tolist(), (ends - cuts).tolist(), [False] * len(cuts), [held.take(slice(i, j)).packed(shape) for i, j in zip(cuts, ends)]]
            if len(at):                                               # spans settled here go along, to any bucket
                for column, value in zip(columns, ((number * 7919 + int(spans[0][0])) % buckets, len(at), True, packed_spans(spans[0][at], spans[1][at], a, b))):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.bool_(), pa.binary()))], names=["bucket", "n", "ready", "body"])
        give_back()

    def sort(part: pd.DataFrame) -> pd.DataFrame:
        held = [Runs.unpacked(body, n, shape) for ready, n, body in zip(part["ready"], part["n"], part["body"]) if not ready]
        found = [unpacked_spans(body) for ready, body in zip(part["ready"], part["body"]) if ready]
        found.append(settle(Runs.joined(held, shape), shape))
        return _spans_batch(*(np.concatenate(x) for x in zip(*found))).to_pandas()
    sent = source.mapInArrow(send, "bucket bigint, n bigint, ready boolean, body binary")
    # as many tasks as buckets, so that what a task reads does not grow with the table
    spans = sent.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(sort, "doc bigint, th bigint, a bigint, b bigint")
    return spans.groupBy("doc", "th").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("spans"))


def _pack_texts(batches):
    """Texts meet their spans in a shuffle; compressed ones are a third shorter there than Spark makes them."""
    tool = zstandard.ZstdCompressor(level=3)
    for batch in slices(batches):
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array([tool.compress(t.encode()) for t in texts_of(batch)], pa.binary())],
                                         names=["doc_id", "th", "body"])
    give_back()


def without_repeats(docs: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, spans (maximal removed runs of bytes, end exclusive) and kept (the other bytes) of every document.

    `kept` is binary: a span may end inside a character."""
    found = removed_spans(docs, window, text).withColumnsRenamed({"doc": "s_doc", "th": "s_th"})
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    packed = source.mapInArrow(_pack_texts, "doc_id bigint, th bigint, body binary")
    both = packed.join(found, (F.coalesce("doc_id", F.lit(NO_ID)) == F.col("s_doc")) & (F.col("th") == F.col("s_th")), "left").select("doc_id", "body", "spans")
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece, sizes, spans, kept = batch.slice(at, 256), [], [], []
                for body, held in zip(piece.column("body").to_pylist(), piece.column("spans").to_pylist()):
                    text, whole = zstandard.decompress(body), []
                    for x in held or ():
                        if whole and x["a"] <= whole[-1]["end"]:
                            whole[-1]["end"] = max(whole[-1]["end"], x["b"])
                        else:
                            whole.append({"start": x["a"], "end": x["b"]})
                    edges = [0, *(e for x in whole for e in (x["start"], x["end"])), len(text)]
                    sizes.append(len(text))
                    spans.append(whole)
                    kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(span)), pa.array(kept, pa.binary())],
                                                 names=["doc_id", "n_bytes", "spans", "kept"])
        give_back()
    return both.mapInArrow(run, "doc_id bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")
