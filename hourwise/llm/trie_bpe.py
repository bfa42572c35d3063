"""Byte-pair encoding by a trie of the distinct words that share prefixes, and decoding of the ids.

The merges of a word's prefix end in one token; that last token is the state of the trie node of the prefix. The state of a
node follows from the states of its ancestors: it is the token t that ends the prefix such that the state before t and t
stay apart, i.e. merging the bytes of the two gives just these two. A depth-first walk hands the states down, so a shared
prefix is worked out once, and the ids of a word are read backwards from state to state.

Each task collects the words of a batch of documents that it does not know yet, walks their trie and keeps the ids with the
bytes that they decode to. Known words are bounded in number and forgotten when full; the trie lives for one batch. A text
decodes to the joined bytes of its ids, read as UTF-8 as a whole.

Defined results: a null or empty text has no ids and decodes to the empty text; repeated rows are encoded each for itself;
an empty table gives an empty table; columns other than `keep` and the text are not looked at."""
from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType
from tokenizers.pre_tokenizers import ByteLevel

from hourwise.llm.common import give_back, texts_of, tokenizer_path, with_columns
from hourwise.llm.library_codes import MARK, SPACE, byte_letters, byte_pieces

# The split pattern of the byte-level vocabulary, with its white space spelled out.
SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
OLD = re.compile("[\\x00-\u02ff\u2010-\u2027]+")          # classed alike in all editions of Unicode
LETTERS = re.compile("( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?|]?)")
MOST_WORDS = 900_000                                          # pieces remembered where only digests leave the task
MOST_WORDS_OF_IDS = 150_000                                   # where ids and texts leave it and need room
MOST_PAIRS, MOST_PAIRS_OF_IDS = 1_000_000, 250_000            # two numbers and a truth value each
SLICE_ROWS, SLICE_BYTES = 1024, 1 << 22                       # documents, and bytes of them, that are worked on together
SLICE_BYTES_OF_IDS = 1 << 20


class TrieCoder:
    """Ids of byte words for one vocabulary of ranked merges."""

    def __init__(self, vocabulary: dict[str, int], merges: Iterable[Sequence[str]], special: dict[str, int],
                 most_pairs: int = MOST_PAIRS):
        raw = {letter: b for b, letter in byte_letters().items()}

        def as_bytes(written: str) -> bytes:
            return bytes(raw[c] for c in written)
        self.id_of = {as_bytes(w): i for w, i in vocabulary.items() if w not in special}
        self.rank = {(as_bytes(a), as_bytes(b)): k for k, (a, b) in enumerate(merges)}
        self.bytes_of = [b""] * (1 + max([*self.id_of.values(), *special.values()]))
        for b, i in self.id_of.items():
            self.bytes_of[i] = b
        for s, i in special.items():
            self.bytes_of[i] = s.encode()
        self.special, self.most_pairs = special, most_pairs
        # a token counts only if merging its own bytes gives it back
        self.whole = {b: i for b, i in self.id_of.items() if len(b) == 1 or self.merged(b) == [b]}
        self.length = list(map(len, self.bytes_of))
        self.longest = max(map(len, self.whole))
        self.grown = {self.whole[b[:-1]] << 8 | b[-1]: i for b, i in self.whole.items() if b[:-1] in self.whole}
        self.apart: dict[int, bool] = {}

    @classmethod
    def from_file(cls, name: str, most_pairs: int = MOST_PAIRS) -> TrieCoder:
        with open(tokenizer_path(name), encoding="utf-8") as f:
            held = json.load(f)
        merges = [m.split(" ") if isinstance(m, str) else m for m in held["model"]["merges"]]
        return cls(held["model"]["vocab"], merges, {t["content"]: t["id"] for t in held["added_tokens"]}, most_pairs)

    def merged(self, word: bytes) -> list[bytes]:
        """The merges as defined: always the best ranked neighbouring pair, the leftmost of equals."""
        parts, rank, none = [word[k:k + 1] for k in range(len(word))], self.rank, len(self.rank)
        while len(parts) > 1:
            best, at = none, 0
            for k, pair in enumerate(zip(parts, parts[1:])):
                r = rank.get(pair, none)
                if r < best:
                    best, at = r, k
            if best == none:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stay_apart(self, first: int, second: int) -> bool:
        """Whether merging the bytes of both tokens gives just the two."""
        if len(self.apart) > self.most_pairs:
            self.apart.clear()
        a, b = self.bytes_of[first], self.bytes_of[second]
        known = self.apart[first << 32 | second] = self.merged(a + b) == [a, b]
        return known

    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, list[int]]:
        """Ids of every distinct word.

        The trie is held as its words in order: that is the order of a depth-first walk, in which a word keeps the states
        of the path that it shares with the word before and adds those of its own nodes. Just one token fits a node, so the
        likely ones are tried first: the last token with one byte more, then the shorter ones."""
        length, grown, apart, stay_apart = self.length, self.grown, self.apart, self.stay_apart
        found: dict[bytes, list[int]] = {}
        states, before = [-1], b""                            # states[d]: the last token of the first d bytes of the path
        for word in sorted(words):
            shared = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                shared += 1
            del states[shared + 1:]
            last, n = states[shared], shared
            for byte in word[shared:]:
                n += 1
                token = grown.get(last << 8 | byte) if last >= 0 else None
                if token is not None and (k := n - length[token]):
                    pair = states[k] << 32 | token
                    fits = apart.get(pair)
                    if not (stay_apart(states[k], token) if fits is None else fits):
                        token = None
                last = self._last_token(word, n, states) if token is None else token
                states.append(last)
            back, d = [], n
            while d:
                token = states[d]
                back.append(token)
                d -= length[token]
            back.reverse()
            found[word] = back
            before = word
        return found

    def _last_token(self, word: bytes, n: int, states: list[int]) -> int:
        """The token that ends the first n bytes of the word, from the states before."""
        whole, apart = self.whole, self.apart
        for k in range(n - 1, max(0, n - self.longest) - 1, -1):
            token = whole.get(word[k:n])
            if token is not None:
                if not k:
                    return token
                fits = apart.get(states[k] << 32 | token)
                if self.stay_apart(states[k], token) if fits is None else fits:
                    return token
        raise ValueError(f"no token ends {word[:n]!r}")


def decimals(ids: Sequence[int]) -> str:
    return ",".join(map(str, ids))


def int_bytes(ids: Sequence[int]) -> bytes:
    return array("i", ids).tobytes()


class TextCoder:
    """Ids of whole texts, in a form that is joined piece by piece, and the bytes that these ids decode to.

    Pieces between spaces are remembered with the form of their ids and with what their ids decode to, so that each distinct
    piece is encoded, written and decoded once while it is remembered. `form` is `decimals` or `int_bytes`."""

    def __init__(self, coder: TrieCoder, form: Callable[[Sequence[int]], str | bytes], most: int = MOST_WORDS):
        self.coder, self.form, self.most = coder, form, most
        self.between = "," if form is decimals else b""
        self.plain: dict[str, tuple[str | bytes, bytes]] = {}    # the form of the ids, and what they decode to
        self.spaced: dict[str, tuple[str | bytes, bytes]] = {}
        self.split = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str

    def words(self, piece: str) -> list[str]:
        """The pre-tokens of a piece. Letters that younger editions of Unicode class differently are left to the library."""
        if m := LETTERS.fullmatch(piece):
            return [x for x in m.groups() if x]
        if OLD.fullmatch(piece):
            return SPLIT.findall(piece)
        return [piece[a:b] for _, (a, b) in self.split(piece)]

    def back(self, ids: Sequence[int]) -> bytes:
        """The bytes that ids stand for."""
        return b"".join(map(self.coder.bytes_of.__getitem__, ids))

    def _learn(self, plain: set[str], spaced: set[str]) -> None:
        cut = [(known, piece, [w.encode() for w in self.words(lead + piece)])
               for known, pieces, lead in ((self.plain, plain, ""), (self.spaced, spaced, " ")) for piece in pieces]
        ids = self.coder.encode_words({w for _, _, words in cut for w in words})
        for known, piece, words in cut:
            mine = ids[words[0]] if len(words) == 1 else [i for w in words for i in ids[w]]
            known[piece] = self.form(mine), self.back(mine)

    def code(self, texts: Sequence[str], decode: bool = True) -> tuple[list, list[bytes]]:
        """(ids, decoded bytes) of every text; without `decode` the second list is empty."""
        if len(self.plain) + len(self.spaced) > self.most:
            self.plain.clear()
            self.spaced.clear()
        cut = [[byte_pieces(segment) for segment in text.split(MARK)] for text in texts]
        self._learn({p for segments in cut for a, _ in segments for p in a if p not in self.plain},
                    {p for segments in cut for _, b in segments for p in b if p not in self.spaced})
        mark = [self.coder.special[MARK]]
        between, marked = self.between, (self.form(mark), self.back(mark))
        coded, back = [], []
        for segments in cut:
            pieces: list[tuple] = []
            for k, (a, b) in enumerate(segments):
                if k:
                    pieces.append(marked)
                pieces.extend(map(self.plain.__getitem__, a))
                pieces.extend(map(self.spaced.__getitem__, b))
            coded.append(between.join([ids for ids, _ in pieces]))
            if decode:
                back.append(b"".join([raw for _, raw in pieces]))
        return coded, back


def as_text(decoded: bytes) -> str:
    """What the library makes of decoded bytes."""
    return decoded.decode("utf-8", "replace")


_CODERS: dict[tuple, TextCoder] = {}


def text_coder(name: str, form: Callable[[Sequence[int]], str | bytes] = decimals) -> TextCoder:
    at = (name, form.__name__)
    if at not in _CODERS:
        _CODERS.clear()                                   # a worker remembers the pieces of one coder
        words, pairs = (MOST_WORDS, MOST_PAIRS) if form is decimals else (MOST_WORDS_OF_IDS, MOST_PAIRS_OF_IDS)
        _CODERS[at] = TextCoder(TrieCoder.from_file(name, pairs), form, words)
    return _CODERS[at]


def text_slices(batches: Iterable[pa.RecordBatch], text: str, most: int | None = None, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in slices of bounded number and size; a longer document is a slice of its own."""
    for batch in batches:
        at, sizes = 0, pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        while at < batch.num_rows:
            end, size = at + 1, sizes[at]
            while end < batch.num_rows and end - at < rows and size + sizes[end] <= (most or SLICE_BYTES):
                size += sizes[end]
                end += 1
            yield batch.slice(at, end - at)
            at = end


def encode_texts(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", text: str = "text", keep: Sequence[str] = ("doc_id",),
                 decode: bool = False) -> DataFrame:
    """`keep` and `ids` of every document; with `decode` also `decoded`, the text that the ids give back."""
    keep = list(keep)
    source = docs.select(*keep, docs[text].alias("__text"))
    schema = StructType([source.schema[c] for c in keep]).add("ids", ArrayType(IntegerType()))
    if decode:
        schema = schema.add("decoded", StringType())
    arrow = to_arrow_schema(schema)

    def run(batches):
        coder = text_coder(tokenizer, int_bytes)
        for batch in text_slices(batches, "__text", SLICE_BYTES_OF_IDS):
            coded, back = coder.code(texts_of(batch, "__text"), decode)
            ends = np.cumsum([0, *(len(x) // 4 for x in coded)]).astype(np.int32)
            columns = {"ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(coded), np.int32))).cast(arrow.field("ids").type)}
            if decode:
                columns["decoded"] = [as_text(x) for x in back]
            yield with_columns(batch, keep, arrow, **columns)
        give_back()
    return source.mapInArrow(run, schema)


def code_digests(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """`keep`, n_tokens, ids_sha256 (decimals joined by commas) and decoded_sha256 (UTF-8) of every document.

    The same encoding and decoding as `encode_texts`, digested where it is made, so that no ids are moved."""
    keep = list(keep)
    source = docs.select(*keep, docs[text].alias("__text"))
    schema = StructType([source.schema[c] for c in keep]).add("n_tokens", LongType()).add("ids_sha256", StringType()).add("decoded_sha256", StringType())
    arrow = to_arrow_schema(schema)

    def run(batches):
        coder = text_coder(tokenizer)
        for batch in text_slices(batches, "__text"):
            coded, back = coder.code(texts_of(batch, "__text"))
            yield with_columns(batch, keep, arrow, n_tokens=[x.count(",") + 1 if x else 0 for x in coded],
                               ids_sha256=[hashlib.sha256(x.encode()).hexdigest() for x in coded],
                               decoded_sha256=[hashlib.sha256(as_text(x).encode()).hexdigest() for x in back])
        give_back()
    return source.mapInArrow(run, schema)
