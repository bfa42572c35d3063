"""Registered queries of the text operators: each applies its operator with production settings to its whole table."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourwise.llm import (binary_ids, exact_dedup, importance, knn_quality, line_dedup, mixing, repetition, simhash, suffix_dedup, token_counts, toxicity,
                          trie_bpe, vector_codes)
from hourwise.llm.common import documents
from hourwise.session import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
# The lines of the contracts of the classifiers.
TOXIC_SCORE, QUALITY_SCORE = 0.7, 0.3


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document, learned from the labelled rows whose crc32 of doc_id leaves no 1 modulo 3."""
    docs = documents(spark, folder)
    model = toxicity.fit(docs, documents(spark, folder, "labels"), "toxic", train=toxicity.bucket_of("doc_id", 3) != 1)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", F.coalesce(toxicity.bucket_of("doc_id", 3) == 1, F.lit(True)).alias("held_out"), "score",
                         (F.col("score") >= TOXIC_SCORE).cast("int").alias("predicted"))


@query("op2_exact_dedup", """WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents),
g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS group_size, count(*) FILTER (doc_id < mid) > 0 AND count(*) FILTER (doc_id >= mid) > 0 AS repeats_history
  FROM d, (SELECT CAST(floor((min(doc_id) + max(doc_id) + 1) / 2) AS BIGINT) AS mid FROM documents) GROUP BY h)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256, repeats_history FROM d JOIN g USING (h)""")
def op2_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """All documents: those below the middle of the doc_ids are the history, the others arrive."""
    docs = documents(spark, folder)
    ends = docs.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).first()
    middle = 0 if ends["a"] is None else (ends["a"] + ends["b"] + 1) // 2
    return exact_dedup.dedup(docs, F.col("doc_id") < middle)


_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"


def _repetition_sql() -> str:
    """The measures from all windows written out as texts."""
    lengths = (3, *repetition.LIMITS)
    parts = [f"""w AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
x AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM w),
l0 AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS j FROM w),
l AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY j) AS k, list_sum(list_transform({_WORDS.format('line')}, lambda q: length(q))) AS c FROM l0 WHERE len({_WORDS.format('line')}) > 0),
ls AS (SELECT doc_id, count(*) FILTER (k > 1) AS n_dup_lines, sum(c) FILTER (k > 1) AS line_chars FROM l GROUP BY doc_id)"""]
    for k in lengths:
        parts += [f"g{k} AS (SELECT doc_id, unnest(range(len(ws) - {k - 1})) AS i, unnest(list_transform(range(1, len(ws) - {k - 2}), lambda p: array_to_string(ws[p:p + {k - 1}], ' '))) AS g FROM w WHERE len(ws) >= {k})",
                  f"r{k} AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g{k}) WHERE c > 1)",
                  f"i{k} AS (SELECT DISTINCT doc_id, unnest(range(i, i + {k})) AS i FROM r{k})",
                  f"s{k} AS (SELECT doc_id, count(*) AS n, sum(length(word)) AS c FROM i{k} JOIN x USING (doc_id, i) GROUP BY doc_id)"]
    joins = " ".join(f"LEFT JOIN s{k} ON s{k}.doc_id = w.doc_id" for k in lengths)
    shares = {f"gram{k}_share": f"coalesce(s{k}.c, 0) / greatest(word_chars, 1)" for k in repetition.LIMITS} | {"line_share": "coalesce(line_chars, 0) / greatest(word_chars, 1)"}
    low = " AND ".join(f"{n} <= {m}" for n, m in zip(shares, (*repetition.LIMITS.values(), repetition.LINE_LIMIT)))
    return f"""WITH {', '.join(parts)}, c AS (SELECT doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda q: length(q))), 0) AS word_chars,
len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols FROM w),
a AS (SELECT w.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
CAST(coalesce(s3.n, 0) AS BIGINT) AS n_repeat_words, {', '.join(f'CAST({e} AS DOUBLE) AS {n}' for n, e in shares.items())} FROM w JOIN c ON c.doc_id = w.doc_id LEFT JOIN ls ON ls.doc_id = w.doc_id {joins}),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a) SELECT *, NOT base_failed AND {low} AS kept FROM b"""


@query("op3_repetition", _repetition_sql())
def op3_repetition(spark: SparkSession, folder: str) -> DataFrame:
    """Repetition rules over every document."""
    return repetition.judge(documents(spark, folder))


@query("op4_trie_bpe")
def op4_trie_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Every document encoded and decoded."""
    return trie_bpe.code_digests(documents(spark, folder))


_MIX_SQL = f"""WITH d AS (SELECT doc_id, coalesce('=' || source, '') AS k, CAST(len({_WORDS.format("coalesce(text, '')")}) AS BIGINT) AS size,
  (CAST(('0x' || substr(md5('20_' || coalesce(CAST(doc_id AS VARCHAR), '') || '_' || coalesce(text, '')), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM documents),
g AS (SELECT k, CAST(sum(size) AS BIGINT) AS s FROM d GROUP BY k),
h AS (SELECT *, CASE (row_number() OVER (ORDER BY k = '', k) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM g),
r AS (SELECT *, sum(s) OVER () AS all_s, sum(w) OVER () - sum(w) OVER o + w AS w_from, 2.0::DOUBLE * (sum(s) OVER o - s) AS before FROM h WINDOW o AS (ORDER BY s / w, k)),
v AS (SELECT *, (1.5::DOUBLE * all_s - before) / w_from AS level FROM r),
t0 AS (SELECT *, max(CASE WHEN w * level < 2.0::DOUBLE * s THEN level END) OVER () AS m FROM v),
t AS (SELECT k, s, CASE WHEN w * level >= 2.0::DOUBLE * s THEN 2.0::DOUBLE * s ELSE w * m END AS target, CASE WHEN w * level >= 2.0::DOUBLE * s OR s = 0 THEN 2.0::DOUBLE ELSE w * m / s END AS rate FROM t0),
p AS (SELECT *, CAST(sum(size) OVER (PARTITION BY k ORDER BY CASE WHEN size > 0 THEN u / ((1 - u) * size) END NULLS FIRST, u ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS filled FROM d)
SELECT doc_id, size, s AS source_size, target, CAST((floor(rate) + CASE WHEN size > 0 AND filled + size / 2.0::DOUBLE <= target - floor(rate) * s THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM p JOIN t USING (k)"""


@query("op5_source_mix", _MIX_SQL)
def op5_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The mix of all documents."""
    mixed = mixing.mix(documents(spark, folder), keep=["doc_id"])
    return mixed.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"),
                        (F.col("__copies") * F.col("__size")).cast("bigint").alias("taken"))


@query("op6_simhash")
def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return simhash.near_classes(documents(spark, folder))


@query("op7_binary_ids")
def op7_binary_ids(spark: SparkSession, folder: str) -> DataFrame:
    """All documents written as shards of codes and read back from them."""
    path = shared_folder(spark, "op7")
    binary_ids.write_shards(documents(spark, folder), path)
    return binary_ids.read_shards(spark, path)


@query("op8_line_dedup")
def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Lines with words, deleted lines and the digest of what is left of every document."""
    done = line_dedup.dedup_runs(documents(spark, folder).select("doc_id", "text"))
    return done.select("doc_id", F.col("__lines").cast("bigint").alias("n_lines"), F.size("__gone").cast("bigint").alias("n_deleted"), F.col("__gone").alias("deleted"),
                       F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


@query("op9_knn_quality")
def op9_knn_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document, learned from the labelled rows whose crc32 of doc_id is no multiple of 5."""
    docs = documents(spark, folder)
    model = knn_quality.fit(docs, documents(spark, folder, "labels"), "quality", train=toxicity.bucket_of("doc_id", 5) != 0)
    return knn_quality.score(docs, model).select("doc_id", F.coalesce(toxicity.bucket_of("doc_id", 5) == 0, F.lit(True)).alias("held_out"), "score",
                                                 (F.col("score") >= QUALITY_SCORE).cast("int").alias("predicted"))


@query("op10_token_counts")
def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document."""
    return token_counts.token_counts(documents(spark, folder))


_SUFFIX_SQL = """WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, p, b[p + 1:p + 50] AS s FROM (SELECT doc_id, b, unnest(range(octet_length(b) - 49)) AS p FROM d WHERE octet_length(b) >= 50)),
f AS (SELECT hash(s) AS h, s, min(doc_id) AS first_doc FROM w GROUP BY s),
r AS (SELECT w.doc_id, w.p FROM w JOIN f ON hash(w.s) = f.h AND w.s = f.s WHERE w.doc_id > f.first_doc),
o AS (SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 50 THEN 0 ELSE 1 END AS fresh FROM r),
i AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM o),
spans AS (SELECT doc_id, k, min(p) AS a, max(p) + 50 AS z FROM i GROUP BY doc_id, k),
gaps AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM spans
  UNION ALL SELECT d.doc_id, coalesce(max(z), 0), octet_length(any_value(b)) FROM d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id),
kept AS (SELECT doc_id, string_agg(hex(b[x + 1:y]), '' ORDER BY x) AS h FROM gaps JOIN d USING (doc_id) GROUP BY doc_id),
n AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(h)) AS kept_sha256 FROM d JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)"""


@query("op11_suffix_dedup", _SUFFIX_SQL)
def op11_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the strings of 50 bytes that earlier documents hold."""
    done = suffix_dedup.without_repeats(documents(spark, folder))
    return done.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"),
                       F.sha2("kept", 256).alias("kept_sha256"))


def _codes_sql(parts: int = vector_codes.PARTS, entries: int = vector_codes.ENTRIES, rounds: int = vector_codes.ROUNDS) -> str:
    """Rounds of assignment and averaging, written out; x holds the vectors by dimension."""
    near = "row_number() OVER (PARTITION BY vec_id, part ORDER BY sum((x.v - c.v) * (x.v - c.v)), e)"
    steps = [f"""k AS (SELECT vec_id, label, embedding, len(embedding) AS dims FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda q: q IS NULL OR NOT isfinite(q))) = 0),
x AS MATERIALIZED (SELECT vec_id, d, d // (dims // {parts}) AS part, CAST(floor({vector_codes.SCALE} * CAST(embedding[d + 1] AS DOUBLE)) AS BIGINT) AS v FROM (SELECT *, unnest(range(dims)) AS d FROM k)),
c0 AS MATERIALIZED (SELECT e, d, part, v FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k ORDER BY vec_id LIMIT {entries}) USING (vec_id))"""]
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, part, e, q FROM (SELECT vec_id, part, e, sum((x.v - c.v) * (x.v - c.v)) AS q, {near} AS place FROM x JOIN c{r} c USING (d, part) GROUP BY vec_id, part, e) WHERE place = 1)")
        if r < rounds:
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT e, d, part, coalesce(m, v) AS v FROM c{r} LEFT JOIN (SELECT e, d, part, CAST(floor(sum(v) / count(*)) AS BIGINT) AS m FROM a{r} JOIN x USING (vec_id, part) GROUP BY e, d, part) USING (e, d, part))")
    return f"""WITH {', '.join(steps)},
s AS (SELECT vec_id, string_agg(lower(lpad(hex(e), 2, '0')), '' ORDER BY part) AS code, CAST(sum(q) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(v, ',' ORDER BY part, e, d)) FROM c{rounds}) AS codebooks_sha256 FROM s JOIN k USING (vec_id)"""


@query("op12_vector_codes", _codes_sql())
def op12_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    """All vectors as codes of 16 parts."""
    coded, books = vector_codes.compress(documents(spark, folder, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.books_digest(books)).alias("codebooks_sha256"))


def _importance_sql(buckets: int = importance.BUCKETS) -> str:
    """Features written out as texts; their crc32 byte by byte from a table made by shifts."""
    crc = "xor(list_reduce(list_transform(range(octet_length(encode(f))), lambda i: CAST('0x' || substr(hex(encode(f)), 2 * i + 1, 2) AS BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"
    return rf"""WITH tab AS MATERIALIZED (SELECT list(list_reduce(range(8), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, n) ORDER BY n) AS t FROM range(256) r(n)),
x AS (SELECT false AS aim, doc_id AS id, text FROM documents UNION ALL SELECT true, item_id, text FROM benchmark),
w AS (SELECT aim, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM x),
f AS (SELECT aim, id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS f FROM w),
g AS MATERIALIZED (SELECT aim, id, f, count(*) AS n FROM f GROUP BY ALL),
b AS MATERIALIZED (SELECT f, CAST({crc} % {buckets} AS BIGINT) AS bucket FROM (SELECT DISTINCT f FROM g), tab),
c AS (SELECT bucket, sum(n) FILTER (NOT aim) AS s, sum(n) FILTER (aim) AS t FROM g JOIN b USING (f) GROUP BY bucket),
z AS (SELECT coalesce(sum(s), 0) AS all_s, coalesce(sum(t), 0) AS all_t FROM c),
v AS (SELECT bucket, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST(all_s + {buckets} AS DOUBLE) / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * CAST(all_t + {buckets} AS DOUBLE)))) AS BIGINT) AS gain FROM c, z),
m AS (SELECT id AS doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(sum(n * gain) / sum(n)) AS BIGINT) AS weight FROM g JOIN b USING (f) JOIN v USING (bucket) WHERE NOT aim GROUP BY id),
e AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) + 0.5) / 4294967296::DOUBLE))) AS BIGINT) AS noise FROM documents LEFT JOIN m USING (doc_id)),
p AS (SELECT *, weight + noise AS score, row_number() OVER (PARTITION BY n_features >= 39 ORDER BY weight + noise DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 39) AS n FROM e)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 39 AND place <= n * 25 // 100 THEN place END AS rank FROM p"""


@query("op13_importance", _importance_sql())
def op13_importance(spark: SparkSession, folder: str) -> DataFrame:
    """A quarter of the documents, drawn to look like the benchmark."""
    return importance.draw(documents(spark, folder), documents(spark, folder, "benchmark").select("text"))
