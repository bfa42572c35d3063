"""Near copies against brute force over shingle sets."""
import random
import re

from edge_cases import documents_of, edge_documents
from hourwise.llm import near_copies

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_set(text):
    words = WORD.findall((text or "").lower())
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4)))


def brute_stays(rows):
    sets = [brute_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        best[find(i)] = min(best.get(find(i), (True, 0)), (d is None, d or 0))
    return sorted((None if last else d for last, d in best.values()), key=str)


def edited(rnd, words, edits):
    words = list(words)
    for at in rnd.sample(range(len(words)), edits):
        words[at] = f"e{rnd.randint(0, 10 ** 9)}"
    return words


def test_copies_of_overlap_from_08_to_095_go(spark):
    """Edits of 1 to 3 in 100 words and 2 to 12 in 300: some pairs fall below 0.8, most lie above it."""
    rnd, rows, reached = random.Random(5), [], []
    for k in range(120):
        n = (100, 300)[k % 2]
        words = [f"w{rnd.randint(0, 10 ** 6)}" for _ in range(n)]
        other = edited(rnd, words, rnd.randint(1, 3) if n == 100 else rnd.randint(2, 12))
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        a, b = brute_set(rows[-1][1]), brute_set(rows[-2][1])
        reached.append(len(a & b) / len(a | b))
    assert sum(0.8 <= x < 0.95 for x in reached) > 60 and sum(x < 0.8 for x in reached) > 5
    got = sorted((r["doc_id"] for r in near_copies.without_near_copies(documents_of(spark, [(d, t, "en", "s", 1) for d, t in rows])).collect()), key=str)
    assert got == brute_stays(rows)


def test_large_group_of_near_copies_is_one_class(spark):
    rnd = random.Random(8)
    words = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join(edited(rnd, words, 2))) for k in range(300)] + [(1000 + k, f"short {k}") for k in range(5)]
    got = {r["doc_id"] for r in near_copies.without_near_copies(documents_of(spark, [(d, t, "en", "s", 1) for d, t in rows])).collect()}
    assert got == {0, *range(1000, 1005)}


def test_one_row_of_each_class_stays(spark):
    text = " ".join(f"v{k}" for k in range(200))
    rows = [(7, text, "en", "s", 1)] * 3 + [(None, text + " end", "en", "s", 1), (7, text + " tail", "en", "s", 1)]
    rows += [(None, f"only null ids {text[:300]}", "de", "s", 1)] * 2 + [(9, None, None, None, None), (8, "", "en", "s", 0), (9, " \n", "en", "s", 2)]
    got = near_copies.without_near_copies(documents_of(spark, rows)).collect()
    assert sorted((r["doc_id"] for r in got), key=str) == [7, 8, None]
    edges = edge_documents(spark)
    left = near_copies.without_near_copies(edges)
    assert left.columns == edges.columns
    assert sorted((r["doc_id"] for r in left.collect()), key=str) == brute_stays([(r["doc_id"], r["text"]) for r in edges.collect()])
    assert near_copies.without_near_copies(documents_of(spark, [])).count() == 0


def test_heavily_edited_copies_of_one_text_reach_the_classes_of_brute_force(spark):
    """Groups of several classes that share keys: every pair of different classes is compared."""
    rnd = random.Random(3)
    words = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join(edited(rnd, words, 3))) for k in range(400)]
    got = sorted((r["doc_id"] for r in near_copies.without_near_copies(documents_of(spark, [(d, t, "en", "s", 1) for d, t in rows])).collect()), key=str)
    assert got == brute_stays(rows)


def test_near_copies_on_a_shared_template_are_found(spark, monkeypatch):
    """Texts of one template lie at 0.78 to 0.79; the planted pairs among them lie above 0.8."""
    rnd, rows = random.Random(6), []
    template = [f"t{k}" for k in range(400)]
    for k in range(250):
        body = [f"b{rnd.randint(0, 10 ** 9)}" for _ in range(50)]
        rows.append((k, " ".join(template + body)))
        if k % 5 == 0:
            rows.append((1000 + k, " ".join(template + body[:-3] + [f"c{rnd.randint(0, 10 ** 9)}" for _ in range(3)])))
    got = sorted((r["doc_id"] for r in near_copies.without_near_copies(documents_of(spark, [(d, t, "en", "s", 1) for d, t in rows])).collect()), key=str)
    assert got == brute_stays(rows) == sorted(range(250), key=str)


def test_block_links_join_what_all_pairs_join():
    import numpy as np

    from hourwise.llm.components import forest
    rng = np.random.default_rng(2)
    base = rng.integers(0, 10 ** 9, (6, 60))
    sets = [np.unique(np.where(rng.random(60) < 0.06, rng.integers(0, 10 ** 9, 60), base[k % 6])) for k in range(80)]
    group, own = np.arange(80) // 2 * 2, np.arange(80) >= 20
    i, j = near_copies.block_links(sets, own, group)
    linked = [(a, b) for a in range(80) for b in range(80) if own[a] and group[a] != group[b] and len(set(sets[a]) & set(sets[b])) >= 0.8 * len(set(sets[a]) | set(sets[b]))]
    inside = [(k, int(group[k])) for k in range(80)]

    def joined(links):
        a, b = np.array(links + inside).T
        return forest(a, b)[1].tolist()
    assert joined(list(zip(i.tolist(), j.tolist()))) == joined(linked) and len(i) < len(linked)
