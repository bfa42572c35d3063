"""Classifiers on held-out rows, repetition rules and mixing against brute force, the pipeline on planted cases."""
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from edge_cases import documents_of, edge_documents
from hourwise.llm import knn_quality, mixing, queries, repetition, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(text):
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    triples = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    inside = {j for i in range(len(words) - 2) if triples[tuple(words[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)]


def brute_share(text, k):
    words = WORD.findall(text)
    n = Counter(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    inside = {j for i in range(len(words) - k + 1) if n[tuple(words[i:i + k])] > 1 for j in range(i, i + k)}
    return sum(len(words[j]) for j in inside) / max(1, sum(map(len, words)))


def test_repetition_measures_match_brute_force():
    rnd = random.Random(2)
    for _ in range(1500):
        text = "".join(rnd.choice(["a", "b", "é", " ", " ", "\n", "\n\n", "\x0b", "|", "#", "a b c", "\x1c", "日本 "]) for _ in range(rnd.randint(0, 70)))
        counts, shares, _ = repetition.measure(text, [2, 5])
        assert counts == brute_counts(text)
        assert shares == pytest.approx([brute_share(text, 2), brute_share(text, 5)])


def test_repetition_verdicts(spark):
    rnd = random.Random(3)
    fresh = " ".join(f"w{rnd.randint(0, 10 ** 9)}" for _ in range(300))
    half = " ".join(f"v{k}" for k in range(60))
    rows = [(0, fresh, "en", "s", 1), (1, half + " " + half, "en", "s", 1), (2, fresh + " " + half[:120] + " x " + half[:120], "en", "s", 1), (3, "short", "en", "s", 1)]
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in repetition.judge(documents_of(spark, rows)).collect()}
    assert got == {0: (False, True), 1: (True, False), 2: (False, True), 3: (True, False)}
    edges = repetition.judge(edge_documents(spark), keep=["tag"]).collect()
    assert len(edges) == edge_documents(spark).count() and all(r["n_words"] >= 0 for r in edges)
    assert repetition.judge(documents_of(spark, [])).count() == 0


def allocated(sizes, weights=(5, 2, 1)):
    """Targets by handing out the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    target, stopped, left = {}, set(), 1.5 * sum(sizes.values())
    while True:
        free = [s for s in names if s not in stopped]
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        above = [s for s in free if share[s] >= 2 * sizes[s]]
        if not above:
            return target | share
        for s in above:
            target[s] = 2.0 * sizes[s]
            stopped.add(s)
        left = 1.5 * sum(sizes.values()) - sum(target.values())
        if len(stopped) == len(names):
            return target


def test_mix_meets_targets(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(edge_documents(spark).select("doc_id", "text", "lang", "source", "n_chars"))
    rows = docs.select("doc_id", "text", "source").collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    target = allocated(sizes)
    got = mixing.mix(docs, keep=["doc_id", "source"]).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in rows)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        assert r["__target"] == pytest.approx(target[r["source"]]) and r["__source_size"] == sizes[r["source"]] and 0 <= r["__copies"] <= 2
        taken[r["source"]] += r["__copies"] * r["__size"]
        largest[r["source"]] = max(largest[r["source"]], r["__size"])
    off = sorted(abs(taken[s] - target[s]) / max(1, target[s]) for s in sizes)
    assert off[len(off) // 2] < 0.02 and all(abs(taken[s] - target[s]) <= max(0.05 * target[s], largest[s]) for s in sizes)
    assert sorted(map(str, mixing.mix(docs.repartition(7), keep=["doc_id", "source"]).collect())) == sorted(map(str, got))
    assert mixing.mix(documents_of(spark, [])).count() == 0


def brute_taken(rows, targets, seed=20):
    """(doc_id, size, words taken) by ordering each source's documents by their Pareto ranks."""
    of_source, out = defaultdict(list), Counter()
    for d, t, s in rows:
        size = len(WORD.findall(t or ""))
        u = (int(hashlib.md5(f"{seed}_{'' if d is None else d}_{t or ''}".encode()).hexdigest()[:13], 16) + 0.5) / 2 ** 52
        of_source[s].append((u / ((1 - u) * size) if size else -1.0, u, size, d))
    for s, docs in of_source.items():
        whole = sum(x[2] for x in docs)
        copies = int(targets[s] // whole) if whole else 0
        rest, filled = targets[s] - copies * whole, 0
        for _, _, size, d in sorted(docs, key=lambda x: x[:3]):
            out[d, size, size * (copies + (size > 0 and filled + size / 2 <= rest))] += 1
            filled += size
    return out


@pytest.mark.parametrize("kind", ["distinct", "null ids", "one id", "equal rows", "half equal rows"])
def test_mix_equals_brute_force_whatever_the_ids(spark, kind):
    rnd, rows = random.Random(3), []
    for s in ("a", "b", None):
        for k in range(400):
            text = " ".join(f"{s}{rnd.randint(0, 999)}" for _ in range(rnd.choice([1, 4, 10, 25])))
            d = len(rows)
            if kind == "equal rows" or kind == "half equal rows" and k % 2:
                d, text = None, "ten equal words of every row in one and all"
            rows.append((None if kind == "null ids" else 7 if kind == "one id" else d, text, s))
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(t.split())
    targets = allocated(sizes)
    docs = documents_of(spark, [(d, t, "en", s, 1) for d, t, s in rows])
    got = mixing.mix(docs.repartition(5), keep=["doc_id", "source"]).collect()
    assert Counter((r["doc_id"], r["__size"], r["__copies"] * r["__size"]) for r in got) == brute_taken(rows, targets)
    with_text = mixing.mix(docs)
    assert Counter((r["doc_id"], r["source"], r["__copies"]) for r in with_text.collect()) == Counter((r["doc_id"], r["source"], r["__copies"]) for r in got)
    taken = defaultdict(int)
    for r in got:
        taken[r["source"]] += r["__copies"] * r["__size"]
    assert all(abs(taken[s] - targets[s]) <= 12.5 for s in sizes)              # half of the longest text


def test_inclusion_odds_grow_with_size(spark):
    """Over many seeds a document of four times the size has four times the odds of its extra copy."""
    rnd = random.Random(5)
    docs = documents_of(spark, [(k, " ".join(f"w{rnd.randint(0, 99)}" for _ in range(4 if k % 2 else 16)), "en", "ab"[k % 4 // 2], 1) for k in range(2000)]).cache()
    drawn = Counter()
    for seed in range(6):
        got = mixing.mix(docs, weights=(1.0, 1.0), total=0.5, seed=seed, keep=["doc_id"])
        drawn.update({(r["__size"], r["__copies"]): r["n"] for r in got.groupBy("__size", "__copies").agg(F.count("*").alias("n")).collect()})
    odds = {s: drawn[s, 1] / drawn[s, 0] for s in (4, 16)}
    assert 3.5 < odds[16] / odds[4] < 4.6


def test_mix_with_columns_named_like_working_ones(spark):
    names = ["__size", "__wkey", "__W_rank", "key", "row", "no", "first", "_spot", "_part"]
    docs = documents_of(spark, [(None, "equal words", "en", f"s{k % 2}", 1) for k in range(30)]).withColumns({c: F.lit(f"own {c}") for c in names})
    got = mixing.mix(docs, marks=("a", "b", "c", "d")).collect()
    assert len(got) == 30 and all(r[c] == f"own {c}" for r in got for c in names) and {r["a"] for r in got} == {2}
    assert sum(r["d"] for r in got) == 45


def test_mix_keeps_clashing_columns(spark):
    docs = edge_documents(spark)
    mixed = mixing.mix(docs)
    assert mixed.columns[:len(docs.columns)] == docs.columns and mixed.where("target = 'z'").count() == docs.count()


def planted(n=900, seed=1):
    """Clean word salads; every third labelled row of an odd id carries a bad word."""
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(600)]
    rows, labels = [], []
    for d in range(n):
        words, bad = [rnd.choice(vocabulary) for _ in range(rnd.randint(20, 80))], d % 3 == 0
        if bad:
            words[rnd.randrange(len(words))] = rnd.choice(["badone", "badtwo", "badthree"])
        rows.append((d, " ".join(words), "en", f"s{d % 4}", 1))
        labels.append((d, 0 if d % 5 == 0 else 1, int(bad)))
        if d % 5 == 0:
            rows[-1] = (d, " ".join(w for w in words[:12] for _ in range(9)) if not bad else rows[-1][1], "en", f"s{d % 4}", 1)
            labels[-1] = (d, 0 if not bad else 1, int(bad))
    return rows, labels


def accuracy(scored, labels, column, line):
    truth = {d: (q, t)[column == "toxic"] for d, q, t in labels}
    return np.mean([(r["score"] >= line) == (truth[r["doc_id"]] == 1) for r in scored])


def test_toxicity_and_quality_on_rows_held_out(spark):
    rows, labels = planted()
    docs, marks = documents_of(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    model = toxicity.fit(docs, marks, train=toxicity.bucket_of("doc_id", 3) != 1)
    assert 0 < len(model[0]) < 5000
    assert accuracy(toxicity.score(documents_of(spark, held), model).collect(), labels, "toxic", 0.5) > 0.95
    quality = knn_quality.fit(docs, marks, train=toxicity.bucket_of("doc_id", 3) != 1)
    assert accuracy(knn_quality.score(documents_of(spark, held), quality).collect(), labels, "quality", 0.3) > 0.95
    again = toxicity.fit(docs.repartition(5), marks.repartition(3), train=toxicity.bucket_of("doc_id", 3) != 1)
    assert dict(zip(*map(np.ndarray.tolist, again))) == dict(zip(*map(np.ndarray.tolist, model)))


def test_a_doc_id_that_repeats_is_learned_from_once(spark):
    """A third of all rows hold one labelled doc_id: the sample has one row of it, and the smallest hash of the text decides."""
    rows, labels = planted(300)
    docs, marks = documents_of(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    chosen = toxicity.sampled_labels(marks, "toxic", F.lit(True), 200)
    hot = chosen.first()["doc_id"]
    many = docs.unionByName(documents_of(spark, [(hot, f"copy {k % 40}", "en", "s", 1) for k in range(150)]))
    got = {r["doc_id"]: r["text"] for r in toxicity.sampled_rows(many, chosen).collect()}
    assert toxicity.sampled_rows(many, chosen).count() == 200 == len(got)
    assert got[hot] == many.where(F.col("doc_id") == hot).orderBy(F.xxhash64("text")).first()["text"]
    assert all(got[r[0]] == r[1] for r in rows if r[0] in got and r[0] != hot)


def test_votes_are_exact_cosines():
    rng = np.random.default_rng(0)
    x, y, labels = knn_quality.unit(rng.normal(size=(40, 8))), knn_quality.unit(rng.normal(size=(100, 8))), rng.integers(0, 2, 100).astype(float)
    for v, s in zip(x, knn_quality.votes(x, y, labels, 7, 3.0)):
        near = sorted(((float(v @ u), k) for k, u in enumerate(y)), reverse=True)[:7]
        w = [max(c, 1e-6) ** 3 for c, _ in near]
        assert s == pytest.approx(sum(a * labels[k] for a, (_, k) in zip(w, near)) / sum(w))


@pytest.mark.parametrize("operator", [toxicity, knn_quality])
def test_classifier_edges(spark, operator):
    docs, none = edge_documents(spark), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    marks = spark.createDataFrame([(0, 1, 0), (1, None, None), (None, 1, 1), (5, 0, 1), (5, 1, 0), (9, 1, 0), (77, 1, 1)], none.schema)
    for labels in (none, marks):
        model = operator.fit(docs, labels)
        got = operator.score(docs, model).collect()
        assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
        assert labels is not none or all(r["score"] == 0.5 for r in got)
        assert operator.score(documents_of(spark, []), model).count() == 0


def test_pipeline_on_planted_cases(spark, tmp_path):
    rows, labels = planted(600, 2)
    rnd = random.Random(9)
    passage = "\n".join(" ".join(f"p{rnd.randint(0, 9999)}" for _ in range(30)) for _ in range(3))
    text = lambda k: " ".join(f"u{k}x{rnd.randint(0, 10 ** 6)}" for _ in range(60))
    rows = [r for r in rows if r[0] % 15]                             # repeated junk makes near copies of its own
    rows += [(2000 + k, text(k) + "\n" + passage + "\n" + text(k), "en", f"s{k % 4}", 1) for k in range(5)]        # a shared passage
    base = " ".join(f"n{rnd.randint(0, 10 ** 6)}" for _ in range(900))
    rows += [(3000, base, "en", "s1", 1), (3001, base + " end", "en", "s1", 1), (3002, base.upper(), "en", "s1", 1)]                  # near copies
    rows += [(4000, None, None, None, None), (4001, "", "en", "s0", 0)]
    folder = str(tmp_path)
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    documents_of(spark, rows).write.parquet(f"{folder}/documents.parquet")
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(path := f"{folder}/{k}")
        docs = spark.read.parquet(path)
        seen.append(docs.collect())
        assert k == 4 or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    toxic = {d for d, _, t in labels if t}
    ids = [[r["doc_id"] for r in rows_] for rows_ in seen]
    first = set(ids[0])
    assert len(first & toxic) < 0.1 * len(toxic & {r[0] for r in rows}) and len({r[0] for r in rows} - toxic - first) <= 5
    texts = {r["doc_id"]: r["text"] for r in seen[1]}
    assert passage in texts[2000] and not any(passage.split("\n")[0] in texts[d] for d in range(2001, 2005))
    assert {3000, 3001, 3002} & set(ids[2]) == {3000} and len(set(ids[2])) == len(ids[2]) and {2000, 2001, 2002} <= set(ids[2])
    assert max(Counter(ids[3]).values()) <= 2 and set(ids[3]) <= set(ids[2])
    assert Counter(ids[4]) == Counter(ids[3]) and all(len(r["ids"]) == r["n_tokens"] for r in seen[4])
    assert corpus_pipeline.run(spark, folder).count() == len(ids[4])


def test_every_query_is_registered():
    assert sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0])) == list(queries.QUERIES) and len(queries.QUERIES) == 13
