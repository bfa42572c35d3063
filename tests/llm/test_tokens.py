"""Operators that handle token ids, held against the libraries."""
from array import array

import pyarrow as pa

import hashlib
import random
import zlib

import numpy as np
import pytest

from edge_cases import documents_of, edge_documents
from hourwise.llm import binary_ids, library_codes, token_counts, trie_bpe
from hourwise.llm.common import tokenizer_path
from hourwise.llm.library_codes import MARK

Tokenizer = pytest.importorskip("tokenizers").Tokenizer
BYTES, WORDS = (Tokenizer.from_file(tokenizer_path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
SIGNS = [*" \n\t\x0b\x1c\x85\xa0 ab'sé5²!<|>́日՘", MARK, "<|startoftext|>", "'ll", " the", "  ", "İ", "Σς", "word.", "end.\nStart"]


def odd_texts(n, longest=30):
    rnd = random.Random(5)
    return ["".join(rnd.choice(SIGNS) for _ in range(rnd.randint(0, longest))) for _ in range(n)]


def ids_of(tok, text):
    return tok.encode(text, add_special_tokens=False).ids


def test_counts_match_the_library():
    texts = odd_texts(1500)
    assert token_counts.count_texts(texts, "byte_bpe_50k.json") == [len(ids_of(BYTES, t)) for t in texts]


def test_spliced_counts_match_for_any_chunk_and_widen():
    for text in odd_texts(150, 200):
        text = text.replace(MARK, "")
        want = len(ids_of(BYTES, text))
        assert [token_counts.splice_count(BYTES, text, c, o) for c, o in ((7, 1), (40, 3), (1000, 8))] == [want] * 3
    no_border = "x" * 5000                     # no overlap holds a border: it widens to the end
    assert token_counts.splice_count(BYTES, no_border, 100, 10) == len(ids_of(BYTES, no_border))


def test_count_query_edges(spark):
    rows = {r["tag"]: r for r in token_counts.token_counts(edge_documents(spark), keep=["tag"], chunk_chars=5000).collect()}
    for tag, r in rows.items():
        text = dict(edge_documents(spark).select("tag", "text").collect())[tag] or ""
        n = len(ids_of(BYTES, text))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 512)
    assert token_counts.token_counts(documents_of(spark, [])).count() == 0


def test_trie_encodes_and_decodes_as_the_library():
    coder, texts = trie_bpe.text_coder("byte_bpe_50k.json"), odd_texts(1500)
    for text, coded, back in zip(texts, *coder.code(texts), strict=True):
        want = ids_of(BYTES, text)
        assert coded == ",".join(map(str, want)) and trie_bpe.as_text(back) == text == BYTES.decode(want, skip_special_tokens=False)
    numbers = trie_bpe.TextCoder(coder.coder, trie_bpe.int_bytes, most=200)                   # forgets often
    for at in range(0, len(texts), 100):
        for text, coded in zip(texts[at:at + 100], numbers.code(texts[at:at + 100], decode=False)[0], strict=True):
            assert list(array("i", coded)) == ids_of(BYTES, text)


def test_slices_are_bounded_in_rows_and_bytes(monkeypatch):
    monkeypatch.setattr(trie_bpe, "SLICE_BYTES", 10)
    monkeypatch.setattr(trie_bpe, "SLICE_ROWS", 3)
    texts = ["a", "b", None, "c" * 30, "", "dd", "e" * 9, "é" * 5]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"])
    got = [b.column("t").to_pylist() for b in trie_bpe.text_slices([batch.slice(1), batch.slice(0, 0)], "t")]
    assert got == [["b", None], ["c" * 30], ["", "dd"], ["e" * 9], ["é" * 5]]


def test_trie_states_equal_plain_merges():
    coder = trie_bpe.text_coder("byte_bpe_50k.json").coder
    words = {w.encode() for w in ("the", "then", "thence", " thermal", "aaaaaaa", "éclair", "\n\n\n\n", "0123456789")}
    for word, ids in coder.encode_words(words).items():
        assert [coder.bytes_of[i] for i in ids] == coder.merged(word)


def test_code_digests_edges(spark):
    docs = edge_documents(spark)
    texts = dict(docs.select("tag", "text").collect())
    got = trie_bpe.code_digests(docs, keep=["tag"]).collect()
    assert len(got) == docs.count()
    for r in got:
        text = texts[r["tag"]] or ""
        ids = ids_of(BYTES, text)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    full = trie_bpe.encode_texts(docs, keep=["tag"], decode=True).collect()
    assert all(r["ids"] == ids_of(BYTES, texts[r["tag"]] or "") and r["decoded"] == (texts[r["tag"]] or "") for r in full)
    assert trie_bpe.code_digests(documents_of(spark, [])).count() == 0


def test_word_ids_match_the_library():
    texts = odd_texts(1500)
    got = [np.frombuffer(b, "<u4").tolist() for b in binary_ids.text_ids(texts, "word_bpe_49k.json", 1)]
    assert got == [ids_of(WORDS, t) + [1] for t in texts]


def test_shard_image_round_trip_and_direct_access():
    rng = np.random.default_rng(3)
    for ids in (rng.integers(0, 2 ** 32, 3000, np.uint32), rng.integers(0, 300, 1700, np.uint32), np.zeros(0, np.uint32), np.array([5], np.uint32)):
        shard = binary_ids.Shard(binary_ids.pack(ids, np.array([7]), np.array([0])))
        assert (shard.all() == ids).all() and shard.n_ids == len(ids)
        for i in (*range(min(len(ids), 1100)), *range(max(0, len(ids) - 20), len(ids))):
            assert shard[i] == ids[i]
        with pytest.raises(IndexError):
            shard[len(ids)]


def test_shards_read_back(spark, tmp_path):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(odd_texts(120))] + [(None, "of none", "en", "s", 1), (5, "again", "en", "s", 1), (6, None, "en", "s", 1)]
    random.Random(1).shuffle(rows)
    path = str(tmp_path / "shards")
    binary_ids.write_shards(documents_of(spark, rows), path, parts=3, image_ids=300)
    got = sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in binary_ids.read_shards(spark, path).collect()), key=lambda r: r[1])
    start, want = 0, []
    for d, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = ids_of(WORDS, t or "") + [1]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want and spark.read.parquet(path).count() > 3
    empty = str(tmp_path / "empty")
    binary_ids.write_shards(documents_of(spark, []), empty)
    assert binary_ids.read_shards(spark, empty).count() == 0


def test_signs_and_known_pieces_are_asked_for_once():
    asked = []

    class Model:
        def tokenize(self, written):
            asked.append(written)
            return [type("Token", (), {"id": ord(c)}) for c in written]

    class Library:
        model = Model()

        def token_to_id(self, mark):
            return -1
    pieces = library_codes.Pieces(Library(), binary_ids.written, fold=True)
    got = pieces.values([[b"Ab,", b"cd,"], [b"cd,", b"e"], []]) + pieces.values([[b"e", b"Ab,"]])
    assert [[np.frombuffer(x, "<u4").tolist() for x in row] for row in got] == [[list(map(ord, w)) for w in row] for row in (["ab,", "cd,"], ["cd,", "e"], [], ["e", "ab,"])]
    assert sorted(asked) == [",", "ab", "cd", "e"]


def test_new_words_are_merged_many_at_a_time(monkeypatch):
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCÉäößÿ", k=rng.randint(1, 12))) + rng.choice(["", "", "$$$", "&&&", "!?", "'s", "42", "|"]) for _ in range(3000)]
    texts = [rng.choice([" ", "\t", "\n\n"]).join(rng.choices(words, k=20)) for _ in range(400)] + ["", " \r ", "<|endoftext|> a</w>", None]
    monkeypatch.setattr(library_codes, "_LOADED", {})
    pieces = library_codes.pieces_for("word_bpe_49k.json", "ids", binary_ids.written, fold=True, most=500, form=library_codes.ClosedWords)
    calls, merges = [], pieces.merges

    class Counted:
        def encode_batch_fast(self, lines, **how):
            calls.extend(lines)
            return merges.encode_batch_fast(lines, **how)
    pieces.merges = Counted()
    for at in range(0, len(texts), 50):                 # the memory of 500 words is full all the time
        got = binary_ids.text_ids(pa.array(texts, pa.string())[at:at + 50], "word_bpe_49k.json", 1)
        assert [np.frombuffer(b, "<u4").tolist() for b in got] == [ids_of(WORDS, t or "") + [1] for t in texts[at:at + 50]]
    assert 0 < len(calls) < 40 and max(len(line.split()) for line in calls) > 300
    pieces.closing[:] = False                           # marks that do not add up: one piece at a time
    pieces.plain, pieces.older = {}, {}
    assert [np.frombuffer(b, "<u4").tolist() for b in binary_ids.text_ids(texts[:20], "word_bpe_49k.json", 1)] == [ids_of(WORDS, t) + [1] for t in texts[:20]]


def test_half_of_the_known_pieces_stays():
    class Library:
        model = type("Model", (), {"tokenize": staticmethod(lambda w: asked.append(w) or [type("Token", (), {"id": 7})])})

        def token_to_id(self, mark):
            return -1
    asked = []
    pieces = library_codes.Pieces(Library(), binary_ids.written, most=4)
    for some in (["a", "b", "c"], ["d", "a"], ["e", "a"], ["f", "a"]):
        pieces.values([some])
    assert asked.count("a") == 1 and len(pieces.plain) + len(pieces.older) <= 6


def test_ids_for_the_pipeline_are_remembered_within_bounds(monkeypatch):
    monkeypatch.setattr(trie_bpe, "MOST_WORDS_OF_IDS", 50)
    monkeypatch.setattr(trie_bpe, "MOST_PAIRS_OF_IDS", 20)
    monkeypatch.setattr(trie_bpe, "_CODERS", {})
    few = trie_bpe.text_coder("byte_bpe_50k.json", trie_bpe.int_bytes)
    texts = [f"piece{k} of{k * k} textual{k}ness" for k in range(60)]
    got = [few.code([t])[0][0] for t in texts]
    assert len(few.plain) + len(few.spaced) <= 53 and len(few.coder.apart) <= 21
    monkeypatch.setattr(trie_bpe, "_CODERS", {})
    assert [np.frombuffer(x, np.int32).tolist() for x in got] == [list(map(int, x.split(","))) for x in trie_bpe.text_coder("byte_bpe_50k.json").code(texts)[0]]


def test_objects_are_those_of_the_array():
    import pyarrow as pa

    from hourwise.llm.common import objects
    words = ["", "a", "a\0", "straße", "語 言", "😀", None]
    for kind in (pa.string(), pa.large_string()):
        assert objects(pa.array(words, kind)) == words
    coded = [None if w is None else w.encode() for w in words]
    assert objects(pa.array(coded, pa.binary())) == coded
    assert objects(pa.array(coded, pa.binary()).slice(2, 3)) == coded[2:5]
    assert objects(pa.array([], pa.binary())) == []
