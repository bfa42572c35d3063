"""Single stages of the pipeline."""
import hashlib
import random

from pyspark.sql import functions as F

import corpus_pipeline
from edge_cases import documents_of, edge_documents
from hourwise.llm import simhash


def test_encoding_decodes_to_the_text(spark):
    docs = edge_documents(spark).select("doc_id", "text", "lang", "source", "n_chars")
    got = corpus_pipeline.encode(spark, docs, "").collect()
    assert sorted(r["decoded_sha256"] for r in got) == sorted(hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in docs.collect())
    assert all(r["intact"] for r in got)


def test_one_of_repeated_rows_and_null_ids_stays(spark):
    text = " ".join(f"v{k}" for k in range(200))
    rows = [(7, text, "en", "s", 1)] * 3 + [(None, text + " end", "en", "s", 1)] + [(None, f"null ids alone {text[:300]}", "de", "s", 1)] * 2
    got = corpus_pipeline.remove_near_copies(spark, documents_of(spark, rows), "").collect()
    assert sorted((r["doc_id"] is None, r["text"]) for r in got) == [(False, text), (True, rows[-1][1])]


def test_stages_keep_columns_and_take_empty_tables(spark, tmp_path):
    spark.createDataFrame([(0, 1, 0), (5, 0, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = edge_documents(spark).select("doc_id", "text", "lang", "source", "n_chars").withColumn("__wsize", F.lit("own"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, documents_of(spark, []), str(tmp_path)).count() == 0
        got = stage(spark, docs, str(tmp_path))
        assert name == "near_duplicates" or got.columns == docs.columns and {r["__wsize"] for r in got.collect()} == {"own"}


def test_near_duplicates_hold_the_classes_of_the_fingerprints(spark):
    """Texts of few shared five-word shingles whose fingerprints differ by at most three bits are one class; others stay."""
    rnd, words, rows = random.Random(3), [f"w{k}" for k in range(60)], []
    for k in range(400):
        mine = [rnd.choice(words) for _ in range(90)]
        other = list(mine)
        for at in (10, 40, 70):
            other[at] = f"e{rnd.random()}"
        rows += [(2 * k, " ".join(mine)), (2 * k + 1, " ".join(other))]
    prints = [simhash.fingerprint(t) for _, t in rows]
    near = [k for k in range(400) if (prints[2 * k] ^ prints[2 * k + 1]).bit_count() <= 3]
    sets = [frozenset(tuple(t.split()[i:i + 5]) for i in range(86)) for _, t in rows]
    assert near and all(5 * len(sets[2 * k] & sets[2 * k + 1]) < 4 * len(sets[2 * k] | sets[2 * k + 1]) for k in near)
    rows += [(1000, rows[0][1]), (1001, None), (1002, " ")]
    got = {r["doc_id"] for r in corpus_pipeline.remove_near_copies(spark, documents_of(spark, [(d, t, "en", "s", 1) for d, t in rows]), "").collect()}
    assert got == {d for d, _ in rows[:800]} - {2 * k + 1 for k in near} | {1001}
