"""Token ids in binary shards of directly addressable codes: any id is read without decoding its neighbours.

Shard image, all integers little-endian:

    4 bytes  magic "DAC1"
    u32      chunk width in bits (8), u32 number of levels
    u64      documents, u64 ids
    per document: i64 doc_id (or the smallest i64 for null), u64 ids before its first one in this shard
    per level: u64 entries, the chunks (one byte each), a bit per entry that is 1 if the id goes on in the next level
               (packed, lowest bit first), and per 512 bits the u64 number of ones before them (the rank directory)

The first level holds the lowest 8 bits of every id; level k + 1 holds the next 8 bits of the ids whose bit on level k is
set. To read id i: take chunk i of level 0; if its bit is set, go on at entry rank(i) of the next level.

Documents are range-partitioned by doc_id; each task writes its documents in order, cut into images of bounded size. The
images are stored by Spark's own writer as (part, piece, n_docs, n_ids, image) rows in Parquet, so they live in whatever
store the path names and a lost executor's images are written again.

Defined results: a null or empty text has only the end id; rows that repeat a doc_id are ordered by their text, equal ones
count each for itself; a null doc_id comes first; an empty table gives no shards and no rows; other columns are not looked at."""
from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hourwise.llm.common import objects, slices
from hourwise.llm.library_codes import ClosedWords, pieces_for
from hourwise.llm.trie_bpe import text_slices
from hourwise.session import cut_lineage

MAGIC, WIDTH, BLOCK = b"DAC1", 8, 512
NO_ID = -2 ** 63
IMAGE_IDS = 1_000_000          # an image is closed when it holds so many ids
MOST_WORDS = 1_000_000           # words whose ids a worker remembers
SLICE_BYTES, SLICE_ROWS = 4_000_000, 1024      # texts whose words are looked up together
SMALL_STARTS = 200_000         # images up to which their starts are sent to all executors
SHARD_SCHEMA = "part int, piece int, n_docs bigint, n_ids bigint, image binary"


def pack(ids: np.ndarray, doc_ids: np.ndarray, starts: np.ndarray) -> bytes:
    """The image of a shard."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest >= 1 << WIDTH
        bits = np.packbits(more, bitorder="little")
        ones = np.add.reduceat(more.astype(np.int64), np.arange(0, len(more), BLOCK)) if len(more) else np.zeros(0, np.int64)
        before = np.concatenate([[0], np.cumsum(ones)])[:len(ones)].astype("<u8")
        levels.append(struct.pack("<Q", len(rest)) + (rest & 0xFF).astype(np.uint8).tobytes() + bits.tobytes() + before.tobytes())
        rest = rest[more] >> WIDTH
        if not len(rest):
            break
    head = MAGIC + struct.pack("<IIQQ", WIDTH, len(levels), len(doc_ids), len(ids))
    return b"".join([head, doc_ids.astype("<i8").tobytes(), starts.astype("<u8").tobytes(), *levels])


class Shard:
    """Reads an image: single ids, ranges, or all of it."""

    def __init__(self, image: bytes):
        if image[:4] != MAGIC:
            raise ValueError("not a shard image")
        width, levels, docs, self.n_ids = struct.unpack_from("<IIQQ", image, 4)
        if width != WIDTH:
            raise ValueError(f"unknown chunk width {width}")
        at = 28
        self.doc_ids = np.frombuffer(image, "<i8", docs, at)
        self.starts = np.frombuffer(image, "<u8", docs, at + 8 * docs).astype(np.int64)
        at += 16 * docs
        self.levels = []
        for _ in range(levels):
            (n,) = struct.unpack_from("<Q", image, at)
            chunks = np.frombuffer(image, np.uint8, n, at + 8)
            bits = np.frombuffer(image, np.uint8, (n + 7) // 8, at + 8 + n)
            at += 8 + n + len(bits)
            before = np.frombuffer(image, "<u8", (n + BLOCK - 1) // BLOCK, at)
            at += 8 * len(before)
            self.levels.append((chunks, bits, before))

    def __getitem__(self, i: int) -> int:
        """Id i, by one rank a level."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value = 0
        for k, (chunks, bits, before) in enumerate(self.levels):
            value |= int(chunks[i]) << WIDTH * k
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK
            inside = np.unpackbits(bits[block * BLOCK // 8:(i >> 3) + 1], bitorder="little")[:i - block * BLOCK]
            i = int(before[block]) + int(inside.sum())
        return value

    def all(self) -> np.ndarray:
        """Every id in order."""
        value = np.zeros(0, np.uint32)
        for chunks, bits, _ in reversed(self.levels):
            here = chunks.astype(np.uint32)
            goes_on = np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)
            here[goes_on] |= value << WIDTH
            value = here
        return value

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, ids before it in this shard, its ids) in order."""
        ids, ends = self.all(), np.append(self.starts[1:], self.n_ids)
        for d, a, b in zip(self.doc_ids.tolist(), self.starts.tolist(), ends.tolist()):
            yield None if d == NO_ID else d, a, ids[a:b]


def written(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def text_ids(texts: list[str] | pa.Array, tokenizer: str, end: int) -> list[bytes]:
    """The library's ids of each text and the end id, as little-endian u32. The vocabulary drops white space, so its
    pre-tokens never cross ASCII white space and each run between is encoded once. Null counts as empty."""
    if not len(texts):
        return []
    codes = pieces_for(tokenizer, "ids", written, fold=True, most=MOST_WORDS, form=ClosedWords)
    runs = pc.ascii_split_whitespace(pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts, ""))
    words = runs.flatten().dictionary_encode()          # each distinct word meets the memory once
    [known] = codes.values([objects(words.dictionary.cast(pa.binary()))])
    ids = pa.array(known, pa.large_binary()).take(words.indices)
    _, offsets, data = ids.buffers()
    firsts = runs.offsets.to_numpy() - runs.offsets[0].as_py()
    ends = np.frombuffer(offsets, "<i8", len(ids) + 1, 8 * ids.offset)[firsts].tolist()
    last, data = written([end]), memoryview(data or b"")
    return [b"".join((data[a:b], last)) for a, b in zip(ends, ends[1:])]


def write_shards(docs: DataFrame, path: str, tokenizer: str = "word_bpe_49k.json", end: int = 1, parts: int | None = None,
                 image_ids: int = IMAGE_IDS) -> None:
    """Encode the documents and write their shards below `path`, in ascending doc_id order. `parts`: range partitions, by
    default those of the session's shuffles."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    count = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.repartitionByRange(count, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    schema = pa.schema([("part", pa.int32()), ("piece", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("image", pa.binary())])

    def run(batches):
        part, piece = TaskContext.get().partitionId(), 0
        held, owners, size = [], [], 0

        def close():
            sizes = np.array([len(h) // 4 for h in held], np.int64)
            ids = np.frombuffer(b"".join(held), "<u4")
            image = pack(ids, np.array(owners, np.int64), np.cumsum(sizes) - sizes)
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((part, piece, len(held), len(ids), image), schema.types)], schema=schema)
        for batch in text_slices(batches, "text", SLICE_BYTES, SLICE_ROWS):
            for d, ids in zip(batch.column("doc_id").to_pylist(), text_ids(batch.column("text"), tokenizer, end)):
                held.append(ids)
                owners.append(NO_ID if d is None else d)
                size += len(ids) // 4
                if size >= image_ids:
                    yield close()
                    held, owners, size, piece = [], [], 0, piece + 1
        if held:
            yield close()
    ordered.mapInArrow(run, SHARD_SCHEMA).write.mode("overwrite").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every stored document, from the images.

    The starts of the images come from their counts: one row per image is ordered, never the documents."""
    stored = spark.read.schema(SHARD_SCHEMA).parquet(path)
    # images of one part are few; the totals of parts are one row per range partition
    base = (stored.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("part_start", F.sum("n").over(Window.orderBy("part")) - F.col("n")).select("part", "part_start"))
    inside = stored.select("part", "piece", (F.sum("n_ids").over(Window.partitionBy("part").orderBy("piece")) - F.col("n_ids")).alias("before"))
    starts = cut_lineage(inside.join(base, "part").select("part", "piece", (F.col("part_start") + F.col("before")).alias("first")))
    if starts.count() <= SMALL_STARTS:
        starts = F.broadcast(starts)                   # three numbers an image; the images stay where they are read

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in slices(batches, 1):
            first, rows = batch.column("first")[0].as_py(), []
            for d, a, ids in Shard(batch.column("image")[0].as_py()).documents():
                rows.append((d, first + a, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
    return stored.join(starts, ["part", "piece"]).select("first", "image").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
