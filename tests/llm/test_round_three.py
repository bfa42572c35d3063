"""Suffix dedup, vector codes and the importance draw against brute force and on edge cases."""
import hashlib
import math
import random
import re
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from edge_cases import documents_of, edge_documents
from hourwise.llm import importance, suffix_dedup, vector_codes

# ----------------------------------------------------------------------------- suffix dedup


def rank(doc_id):
    return suffix_dedup.NO_ID if doc_id is None else doc_id


def brute_removed(rows, window):
    """(doc_id, bytes, removed bytes, spans, digest of what is left), from every string of every text."""
    first = {}
    for doc_id, text in rows:
        b = (text or "").encode()
        for p in range(len(b) - window + 1):
            s = b[p:p + window]
            first[s] = min(first.get(s, rank(doc_id)), rank(doc_id))
    out = []
    for doc_id, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - window + 1):
            if first[b[p:p + window]] < rank(doc_id):
                gone[p:p + window] = b"\1" * window
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((doc_id, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def removed(df, window=suffix_dedup.WINDOW):
    found = suffix_dedup.without_repeats(df, window).collect()
    return sorted([(r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in found], key=str)


def patched_texts(seed, letters, n=70):
    rnd = random.Random(seed)
    pool = ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 90))) for _ in range(12)]
    rows = []
    for _ in range(n):
        text = "".join(rnd.choice(pool) for _ in range(rnd.randint(0, 7)))
        if text and rnd.random() < 0.4:
            at = rnd.randrange(len(text))
            text = text[:at] + rnd.choice(letters) + text[at + 1:]
        rows.append((None if rnd.random() < 0.1 else rnd.randint(0, 40), None if rnd.random() < 0.05 else text))
    return rows + rows[:5]


@pytest.mark.parametrize("seed, letters, window", [(1, "ab", 50), (2, "abcdefghé \n", 50), (3, "abcdefghé \n", 24), (4, "a", 50)])
def test_suffix_dedup_equals_brute_force(spark, seed, letters, window):
    rows = patched_texts(seed, letters)
    assert removed(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), window) == brute_removed(rows, window)


def test_a_passage_that_most_documents_share(spark):
    passage = "This very passage stands in most of the documents, word for word, and goes from all but the first of them."
    rows = [(k, f"{random.Random(k).random()} start {k} " + (passage if k % 3 else "") + f" end {k * k}") for k in range(300)]
    found = removed(spark.createDataFrame(rows, "doc_id long, text string").repartition(20))
    assert found == brute_removed(rows, suffix_dedup.WINDOW)
    assert sum(r[3] for r in found) == 199


def test_chunks_of_long_texts_overlap_by_a_window(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 100)
    monkeypatch.setattr(suffix_dedup, "BATCH", 1000)
    shape, text = suffix_dedup.Shape(), bytes(random.Random(0).choices(b"abcd", k=1234)).decode()

    class Batch:
        num_rows = 1

        def column(self, name):
            return [type("Scalar", (), {"as_py": lambda self: {"doc": 3, "th": 4, "text": text}[name]})()]
    parts = [p for held in suffix_dedup._parts([Batch()], shape) for p in held]
    held = suffix_dedup.batch_runs(parts, shape, None)
    places = sorted(f + k for f, n in zip(held.first, held.rows[:, shape.columns + 1]) for k in range(n))
    assert places == list(range(len(text) - shape.window + 1))                       # every string once


def test_runs_survive_packing_and_demoted_anchors():
    shape, rnd = suffix_dedup.Shape(), random.Random(1)
    parts = [(k, 0, 0, bytes(rnd.choices(b"abcdefgh ", k=rnd.randint(0, 400)))) for k in range(30)]
    for hot in (None, np.arange(suffix_dedup.HOT_SLOTS) % 3 == 0):
        held = suffix_dedup.batch_runs(parts, shape, hot)
        again = suffix_dedup.Runs.unpacked(held.packed(shape), len(held.doc), shape)
        assert (again.rows == held.rows).all() and (again.first == held.first).all()
        for doc, first, row in zip(held.doc, held.first, held.rows):
            before, n = int(row[shape.columns]), int(row[shape.columns + 1])
            start = shape.left - before
            assert bytes(row[start:start + n + shape.window - 1]) == parts[doc][3][first:first + n + shape.window - 1]


def test_suffix_dedup_edges(spark):
    df = edge_documents(spark)
    assert removed(df) == brute_removed([(r.doc_id, r.text) for r in df.collect()], suffix_dedup.WINDOW)
    assert suffix_dedup.without_repeats(df.limit(0)).collect() == []


# ----------------------------------------------------------------------------- vector codes

VECTORS = "vec_id long, embedding array<float>, label int, code string, part int"


def brute_codes(rows, parts, entries, rounds):
    """{row number: (code, error)} and the codebooks, by comparing every part with every entry."""
    kept = [(i, r) for i, r in enumerate(rows) if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    dims = max({len(r[1]) for _, r in kept}, key=lambda d: (sum(len(r[1]) == d for _, r in kept), d))
    kept = [(i, r) for i, r in kept if len(r[1]) == dims]
    ints = {i: [math.floor(256 * float(np.float32(x))) for x in r[1]] for i, r in kept}
    order = sorted(kept, key=lambda x: (x[1][0] is None, x[1][0] or 0, [float(np.float32(v)) for v in x[1][1]]))[:entries]
    cuts = vector_codes.bounds(dims, parts)
    books = [[ints[i][a:b] for i, _ in order] for a, b in cuts]

    def nearest(book, x):
        return min((sum((p - q) ** 2 for p, q in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for k, (a, b) in enumerate(cuts):
            mine = {}
            for x in ints.values():
                mine.setdefault(nearest(books[k], x[a:b])[1], []).append(x[a:b])
            books[k] = [[sum(c) // len(c) for c in zip(*mine[e])] if e in mine else old for e, old in enumerate(books[k])]
    found = {}
    for i, x in ints.items():
        best = [nearest(books[k], x[a:b]) for k, (a, b) in enumerate(cuts)]
        found[i] = ("".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best))
    return found, books


def vector_rows(seed=3, n=300, dims=12):
    rng = np.random.default_rng(seed)
    rows = [(k if k % 9 else None, [float(np.float32(x)) for x in rng.normal(0, 0.3, dims)], k % 4 or None) for k in range(n)]
    rows[5] = (5, None, 1)
    rows[6] = (6, [None] * dims, 1)
    rows[7] = (7, [float("nan")] * dims, 1)
    rows[8] = (8, [float("inf")] + [0.0] * (dims - 1), 1)
    rows[10] = (10, [0.5] * (dims + 1), 1)
    rows[11] = (11, [], 1)
    rows[12] = (12, [1e30] + [0.0] * (dims - 1), 1)              # beyond what squared distances can hold
    return rows + [rows[20], rows[20]]


@pytest.mark.parametrize("parts, entries, rounds", [(4, 16, 2), (5, 7, 1), (16, 64, 2)])
def test_vector_codes_equal_brute_force(spark, parts, entries, rounds):
    rows = [r for r in vector_rows() if not r[1] or r[1][0] != 1e30]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS).repartition(5)
    coded, books = vector_codes.compress(df, parts=parts, entries=entries, rounds=rounds)
    found, expected = brute_codes(rows, parts, entries, rounds)
    assert [b.tolist() for b in books] == expected
    label_error = {}
    for i, (_, error) in found.items():
        label_error[rows[i][2]] = label_error.get(rows[i][2], 0) + error
    got = sorted(((r.vec_id, r.label, r.code, r.error, r.label_error) for r in coded.collect()), key=str)
    assert got == sorted(((rows[i][0], rows[i][2], c, e, label_error[rows[i][2]]) for i, (c, e) in found.items()), key=str)


def test_grid_keeps_every_entry_that_can_be_nearest(monkeypatch):
    monkeypatch.setattr(vector_codes, "MOST_CELLS", 40)           # forgotten often
    rng = np.random.default_rng(0)
    entries = rng.integers(-40, 40, (64, 4))
    entries[10] = entries[3]                                      # a tie goes to the lower index
    grid = vector_codes.Grid(entries, 81)
    for _ in range(5):
        points = rng.integers(-90, 90, (700, 4))
        code, distance = grid.nearest(points)
        every = ((points[:, None] - entries) ** 2).sum(2)
        assert (code == every.argmin(1)).all() and (distance == every.min(1)).all()
    assert grid.candidates(np.zeros((1, 4), np.int64)).sum() < 64


def test_grid_compares_all_entries_where_hashes_collide(monkeypatch):
    monkeypatch.setattr(vector_codes, "_STEP", np.uint64(0))      # every cell has one hash
    rng = np.random.default_rng(1)
    entries, points = rng.integers(-40, 40, (20, 3)), rng.integers(-60, 60, (300, 3))
    code, _ = vector_codes.Grid(entries, 64).nearest(points)
    assert (code == ((points[:, None] - entries) ** 2).sum(2).argmin(1)).all()


def test_vector_codes_edges(spark):
    rows = vector_rows()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS)
    coded, _ = vector_codes.compress(df, parts=4, entries=16)
    assert coded.count() == len(rows) - 6
    assert vector_codes.compress(df.limit(0))[0].collect() == []
    few, books = vector_codes.compress(df.where("vec_id in (1, 2)"), parts=3)
    assert few.count() == 2 and {len(b) for b in books} == {2}
    assert vector_codes.compress(df.where("vec_id = 11"))[0].select("code", "error").collect() == [("00" * 16, 0)]
    with pytest.raises(ValueError):
        vector_codes.compress(df, entries=300)


# ----------------------------------------------------------------------------- importance draw


def brute_draw(docs, target, percent=25, least=20, seed=7, buckets=importance.BUCKETS):
    def features(text):
        low = (text or "").translate({ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
        return [crc32(f.encode()) % buckets for f in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]], len(words)
    here, aim = [0] * buckets, [0] * buckets
    for held, texts in ((here, [t for _, t in docs]), (aim, target)):
        for t in texts:
            for b in features(t)[0]:
                held[b] += 1
    gain = [math.floor(1000 * math.log((t + 1) * (sum(here) + buckets) / ((s + 1) * (sum(aim) + buckets)))) for s, t in zip(here, aim)]
    rows = []
    for doc_id, text in docs:
        found, words = features(text)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        rows.append((doc_id, len(found), weight, weight + importance.noise(seed, doc_id), words))
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = len(able) * percent // 100
    return sorted([(*r[:4], k + 1 if k < drawn else None) for k, r in enumerate(able)] + [(*r[:4], None) for r in rows if r[4] < least], key=str)


def drawn(df, target, **kw):
    return sorted([(r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in importance.draw(df, target, **kw).collect()], key=str)


def line_texts(seed=11, n=120):
    rnd = random.Random(seed)
    words = ["alpha", "Beta", "gamma7", "élan", "delta-x", "日本", "a", "Zeta."]
    lines = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 9))) for _ in range(25)] + ["", " . ", "\t"]
    return [(k if k % 13 else None, rnd.choice(["\n", "\r\n", "\n\n"]).join(rnd.choice(lines) for _ in range(rnd.randint(0, 12)))) for k in range(n)]


def test_importance_equals_brute_force(spark):
    docs = [*line_texts(), (500, None), (501, ""), (502, "one two " * 30), (502, "one two " * 30)]
    target = [t for _, t in line_texts(12, 20)] + [None]
    df = spark.createDataFrame([(i, t, "x", 1.0) for i, t in docs], "doc_id long, text string, line string, score double").repartition(4)
    assert drawn(df, spark.createDataFrame([(t,) for t in target], "text string")) == brute_draw(docs, target)


def test_lines_are_counted_once_each(spark):
    df = documents_of(spark, [(k, "same line\nother line" if k % 2 else "same line", None, None, None) for k in range(100)])
    assert {r.line: r.times for r in importance.distinct_lines(df).collect()} == {"same line": 100, "other line": 50}


def test_equal_rows_get_ranks_in_a_row(spark):
    text = " ".join(f"w{k}" for k in range(30))
    df = spark.createDataFrame([(None, text)] * 400, "doc_id long, text string").repartition(7)
    found = importance.draw(df, df.select("text"))
    assert sorted(r["rank"] for r in found.where(F.col("rank").isNotNull()).collect()) == list(range(1, 101))


def test_importance_edges(spark):
    df = edge_documents(spark)
    docs = [(r.doc_id, r.text) for r in df.collect()]
    empty = spark.createDataFrame([], "text string")
    assert drawn(df, df.select("text")) == brute_draw(docs, [t for _, t in docs])
    assert drawn(df, empty) == brute_draw(docs, [])
    assert drawn(df.limit(0), df.select("text")) == []


def test_worker_memory_may_be_forgotten(spark, monkeypatch):
    words = importance._Words()
    monkeypatch.setattr(importance, "MOST_WORDS", 3)
    line = "one two three four five one two".encode()
    assert importance.features(line, words)[0] == importance.features(line, importance._Words())[0]
    assert len(words) <= 3
