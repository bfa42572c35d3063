"""Dedup operators against brute force."""
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from edge_cases import documents_of, edge_documents
from hourwise.llm import exact_dedup, line_dedup, simhash
from hourwise.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# exact dedup

def test_hash_is_minimal_and_perfect():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 500, 5000):
        digests = np.frombuffer(rng.bytes(32 * n), "V32")
        sizes, bits, slots = exact_dedup.build(digests)
        assert sorted(slots.tolist()) == list(range(n))
        if n:
            assert (exact_dedup.slots_of(digests, sizes, bits) == slots).all()
    same_word = np.frombuffer(b"".join(b"\x07" * 8 + bytes([k]) * 24 for k in range(50)), "V32")       # digests that share a word
    assert sorted(exact_dedup.build(same_word)[2].tolist()) == list(range(50))


@pytest.mark.parametrize("line", [0, 3, 100])
def test_exact_dedup_same_wherever_history_ends(spark, line):
    docs = edge_documents(spark)
    got = exact_dedup.dedup(docs, F.col("doc_id") < line, shard_keys=2).toPandas()
    rows = [(r["doc_id"], (r["text"] or "").translate(LOWER)) for r in docs.collect()]
    groups = defaultdict(list)
    for d, t in rows:
        groups[t].append(d)
    want = []
    for d, t in rows:
        known = [x for x in groups[t] if x is not None]
        keep = max(known) if known else None
        want.append((d, keep, len(groups[t]), d == keep, hashlib.sha256(t.encode()).hexdigest()))
    plain = [tuple(None if pd.isna(x) else x for x in r) for r in got[["doc_id", "keep_id", "group_size", "kept", "text_sha256"]].itertuples(index=False)]
    assert Counter(plain) == Counter(want)
    assert exact_dedup.dedup(documents_of(spark, []), F.col("doc_id") < line).count() == 0


def test_members_are_checked_byte_by_byte(spark):
    rows = [(bytes([k]) * 32, k, 1) for k in range(40)]
    history = spark.createDataFrame(rows[:20], "digest binary, keep bigint, count bigint")
    arrivals = spark.createDataFrame(rows[10:], "digest binary, keep bigint, count bigint")
    got = {r["digest"][0]: (r["keep"], r["count"], r["member"]) for r in exact_dedup.meet(exact_dedup.build_history(history, 3), arrivals, 3).collect()}
    assert got == {k: (k, 2 if 10 <= k < 20 else 1, None if k < 10 else k < 20) for k in range(40)}


# SimHash

def brute_print(text, k=3):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(prints, radius=3):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def test_near_classes_match_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(edge_documents(spark).select("doc_id", "text", "lang", "source", "n_chars"))
    rows = docs.select("doc_id", "text").collect()
    prints = [brute_print(t) for _, t in rows]
    ids = defaultdict(list)
    for (d, _), c in zip(rows, classes := brute_classes(prints)):
        ids[c].append(d)
    smallest = {c: min((d for d in ds if d is not None), default=None) for c, ds in ids.items()}
    want = Counter((d, f"{p:016x}", smallest[c]) for (d, _), p, c in zip(rows, prints, classes))
    assert Counter(map(tuple, simhash.near_classes(docs).collect())) == want
    assert simhash.near_classes(documents_of(spark, [])).count() == 0


def test_links_of_dense_groups_and_chains(spark):
    """Random walks of few bits: chains across tiles, and all neighbours of one fingerprint."""
    rnd, prints = random.Random(4), set()
    for _ in range(12):
        p = rnd.getrandbits(64)
        for _ in range(25):
            prints.add(p)
            for b in rnd.sample(range(64), rnd.randint(1, 5)):
                p ^= 1 << b
    centre = rnd.getrandbits(64)
    prints |= {centre ^ (1 << b) for b in range(64)} | {0, 2 ** 64 - 1, 1, 7}
    prints = sorted(prints)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    links = simhash.near_links(spark.createDataFrame([(p,) for p in signed], "fp bigint"))
    got = dict(map(tuple, components(links).collect()))
    classes = brute_classes(prints)
    members = defaultdict(list)
    for s, c in zip(signed, classes):
        members[c].append(s)
    assert {s: got.get(s, s) for s in signed} == {s: min(members[c]) for s, c in zip(signed, classes)}
    assert links.count() < 65 * len(prints)                    # trees, not pairs


def test_components_of_paths_and_hubs(spark):
    path = [(k, k + 1) for k in range(1, 200)]
    hub = [(1000, k) for k in range(1001, 1200)]
    got = dict(map(tuple, components(spark.createDataFrame(path + hub + [(5, 5), (3000, 2999)], "a bigint, b bigint")).collect()))
    assert got == {k: 1 for k in range(1, 201)} | {k: 1000 for k in range(1000, 1200)} | {2999: 2999, 3000: 2999}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# line dedup

def signed_hash(line):
    return int(np.uint64(xxhash.xxh64_intdigest(line.encode(), 42)).view(np.int64))


def lines_of(docs):
    """The lines with a word, and their numbers of words, of each (id, text)."""
    state = {}
    for d, text in docs:
        lines = [x.strip(" \t\r\v\f") for x in (text or "").split("\n")]
        state[d, signed_hash(text) if text is not None else 42] = [(x, len(WORD.findall(x))) for x in lines if x]
    return state


def fold(lines):
    """The engine's hash of an array of line hashes."""
    h = 42
    for x, _ in lines:
        h = int(np.uint64(xxhash.xxh64_intdigest(signed_hash(x).to_bytes(8, "little", signed=True), h & (2 ** 64 - 1))).view(np.int64))
    return h


def brute_prints(lines, k=20, t=50):
    """The windows a..b of one document with the gram each selects, window by window."""
    def reach(i, words, step=1):
        """The last line of the shortest run from i, in the direction of step, with so many words, or None."""
        total = 0
        while 0 <= i < len(lines):
            total += lines[i][1]
            if total >= words:
                return i
            i += step
        return None
    spans = {(a, b) for a in range(len(lines)) if (b := reach(a, t)) is not None} | {(a, b) for b in range(len(lines)) if (a := reach(b, t, -1)) is not None}
    found = set()
    for a, b in spans:
        inside = [s for s in range(a, b + 1) if sum(w for _, w in lines[a:s]) <= t - k]
        assert all(reach(s, k) <= b for s in inside)
        g, p = min((fold(lines[s:reach(s, k) + 1]), s) for s in inside)
        found.add((p, g, a, b, fold(lines[a:b + 1])))
    return found


def made_documents():
    rnd = random.Random(6)
    word = lambda: rnd.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(rnd.randint(0, 400))
    line = lambda lo, hi: " ".join(word() for _ in range(rnd.randint(lo, hi)))
    passages = [[line(3, 40) for _ in range(rnd.randint(1, 9))] for _ in range(14)]
    docs = []
    for d in range(70):
        lines = []
        for _ in range(rnd.randint(0, 5)):
            lines += [line(1, 90) for _ in range(rnd.randint(0, 4))]
            p = rnd.choice(passages)
            a = rnd.randint(0, len(p) - 1)
            lines += p if rnd.random() < 0.5 else p[a:a + rnd.randint(1, 9)]
            if rnd.random() < 0.2:
                lines += ["", "  ", "common head line"]
        docs.append((d, "\n".join(lines)))
    docs.append((70, "\n".join(["over and over again we say it"] * 40)))
    return docs, passages


def test_every_window_selects_its_smallest_gram(spark):
    docs, _ = made_documents()
    state = lines_of(docs)
    got = defaultdict(set)
    for r in line_dedup.fingerprints(line_dedup.numbered_lines(documents_of(spark, [(d, t, "en", "s", 1) for d, t in docs]))).collect():
        assert (r["p"], r["g"], r["a"], r["b"], r["run"]) not in got[r["__id"], r["__th"]]
        got[r["__id"], r["__th"]].add((r["p"], r["g"], r["a"], r["b"], r["run"]))
    assert sum(map(len, got.values())) > 300
    assert {p: got[p] for p in state} == {p: brute_prints(lines) for p, lines in state.items()}


def test_what_is_left_of_a_text(spark):
    docs, _ = made_documents()
    rows = [(d, t, "en", "s", len(t)) for d, t in docs] + [(71, None, None, None, None), (72, "", "en", "s", 0), (None, docs[1][1], "en", "s", 1)]
    texts = {(-1 if d is None else d): t for d, t, *_ in rows}
    state = lines_of(texts.items())
    want = brute_runs(state)
    for r in line_dedup.dedup_runs(documents_of(spark, rows)).collect():
        d = -1 if r["doc_id"] is None else r["doc_id"]
        place = next(p for p in state if p[0] == d)
        assert r["__gone"] == sorted(want.get(place, [])) and r["__lines"] == len(state[place])
        kept, n = [], -1
        for x in (texts[d] or "").split("\n"):
            n += bool(x.strip(" \t\r\v\f"))
            if not (x.strip(" \t\r\v\f") and n in set(r["__gone"])):
                kept.append(x)
        assert r["text"] == (None if texts[d] is None else "\n".join(kept))


def brute_runs(state, t=50):
    """Every run of t words or more at every place, its later copies line by line."""
    gone, first = defaultdict(set), {}
    for place, lines in sorted(state.items()):
        for a in range(len(lines)):
            words = 0
            for b in range(a, len(lines)):
                words += lines[b][1]
                if words >= t:
                    run = tuple(x[0] for x in lines[a:b + 1])
                    if first.setdefault(run, (place, a)) != (place, a):
                        gone[place] |= set(range(a, b + 1))
                if words >= 3 * t + 90:             # longer runs are unions of these
                    break
    return gone


def test_every_line_of_every_later_copy_of_a_run_goes(spark):
    docs, _ = made_documents()
    state = lines_of(docs)
    want = brute_runs(state)
    got = {r["doc_id"]: r["__gone"] for r in line_dedup.dedup_runs(documents_of(spark, [(d, t, "en", "s", len(t)) for d, t in docs])).collect()}
    assert sum(map(len, want.values())) > 100
    assert got == {place[0]: sorted(want.get(place, [])) for place in state}


def test_full_copies_go_whole_after_an_earlier_piece(spark):
    """An earlier document holds one line of 25 words of a passage of 55 to 150: the second full copy goes as a whole. Many
    passages are tried, so that the shared line often holds the selected gram."""
    rows, held = [], []
    for k in range(60):
        sizes, piece = [((25, 30), 0), ((25, 25, 25), 1), ((25,) * 6, 3)][k % 3]
        passage = [" ".join(f"w{k}x{i}x{j}" for j in range(n)) for i, n in enumerate(sizes)]
        own = [" ".join(f"own{k}y{i}y{j}" for j in range(30)) for i in range(2)]
        rows += [(3 * k, "\n".join([own[0], passage[piece], own[1]])), (3 * k + 1, f"first {k}\n" + "\n".join(passage)), (3 * k + 2, f"second {k}\n" + "\n".join(passage) + f"\nend {k}")]
        held.append(len(sizes))
    docs = documents_of(spark, [(d, t, "en", "s", len(t)) for d, t in rows])
    got = {r["doc_id"]: r["__gone"] for r in line_dedup.dedup_runs(docs).collect()}
    for k, n in enumerate(held):
        assert (got[3 * k], got[3 * k + 1], got[3 * k + 2]) == ([], [], list(range(1, n + 1)))


def test_runs_edges(spark):
    docs = edge_documents(spark)
    done = line_dedup.dedup_runs(docs)
    assert done.count() == docs.count() and done.columns == [*docs.columns, "__lines", "__gone"]
    assert line_dedup.dedup_runs(documents_of(spark, [])).count() == 0
    assert not any("Python" in line or "Arrow" in line for line in done._jdf.queryExecution().executedPlan().toString().split("\n"))
    text = "\n".join(f"line {k} of a text that two rows hold" for k in range(9))
    got = line_dedup.dedup_runs(documents_of(spark, [(None, text, "en", "s", 1), (4, text, "en", "s", 1), (4, text, "en", "s", 1), (4, None, "en", "s", 0)])).collect()
    assert sorted((r["doc_id"] is None, len(r["__gone"])) for r in got) == [(False, 0), (False, 9), (False, 9), (True, 0)]


def test_columns_named_like_working_ones(spark):
    names = ["__th", "__wth", "__W_all", "__ends", "__g_id", "h", "run"]
    docs = documents_of(spark, [(d, "\n".join(f"line {k} of one text that two rows hold" for k in range(9)), "en", "s", 1) for d in (1, 2)])
    docs = docs.withColumns({c: F.lit(f"own {c}") for c in names})
    got = line_dedup.dedup_runs(docs, lines="all_lines", gone="gone_lines").collect()
    assert sorted((r["doc_id"], len(r["gone_lines"]), r["all_lines"]) for r in got) == [(1, 0, 9), (2, 9, 9)]
    assert all(r[c] == f"own {c}" for r in got for c in names)


def test_shared_runs_below_50_words_stay_everywhere(spark):
    """One common run of 20 to 49 words in otherwise clean documents of 60 words more: no copy of it goes, one of 50 words does."""
    rows, expect = [], {}
    for k, n in enumerate((20, 30, 49, 50)):
        line = " ".join(f"c{k}x{j}" for j in range(n))
        for d in range(20):
            own = [" ".join(f"o{k}y{d}y{i}y{j}" for j in range(30)) for i in range(2)]
            rows.append((100 * k + d, "\n".join([own[0], line, own[1]])))
            expect[100 * k + d] = [1] if n == 50 and d else []
    docs = documents_of(spark, [(d, t, "en", "s", 1) for d, t in rows])
    assert {r["doc_id"]: r["__gone"] for r in line_dedup.dedup_runs(docs).collect()} == expect
