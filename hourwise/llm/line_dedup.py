"""Line dedup by winnowing over line hashes, with DataFrame functions only.

The lines of a document that hold a word are numbered. Of every run of lines of at least `run_words` words that stands in two
places, all lines of every place but the first (by doc_id, then text, then position) go; shorter runs never match.

A gram is the shortest run of lines from a line on that has at least `gram_words` words; a window is the shortest run from a line
on, or up to a line, that has at least `run_words`. Every window selects the gram with the smallest hash (ties: the first) among
those that start within its first `run_words - gram_words` words, all of which lie inside it. The choice depends on the window's
lines alone, so equal windows select equal grams at equal spots, and every repeated run holds a selected one. A position is a
selected gram in a document with the windows that selected it. Positions meet by gram and window: the first holder of each pair is a
pre-aggregated minimum joined to the later ones, one row per pair, so that a passage that a third of all documents share costs
no pairs of documents. A later position extends to both sides as far as any of its windows stands earlier, from the least first
line to the greatest last one; these lines go. One holder per gram would not do: where the first holder shares only a piece of a
run, the rest of the run stands first elsewhere. A deleted line stands earlier too, and its first place stays.

Lines are equal when equal after trimming spaces, tabs and carriage returns; their 64-bit hashes stand for them, and windows are
equal when the hashes of both the gram and the window are. Defined results: null texts stay null, empty ones empty; lines without a
word stay; very long texts are read whole, their lines are rows; of rows that repeat doc_id and text all get the same result; a
null doc_id comes first; an empty table gives an empty table; extra columns pass unchanged whatever their names, and the names of
the two columns added can be chosen."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourwise.llm.common import free_prefix

GRAM_WORDS, RUN_WORDS = 20, 50
DOC = ["__id", "__th"]


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _trimmed(line: Column) -> Column:
    return F.trim(line, F.lit(" \t\r\v\f"))


def numbered_lines(docs: DataFrame) -> DataFrame:
    """(__id, __th, n, h, w): the lines with a word of each distinct document, their hash and number of words."""
    text = F.col("text")
    one = docs.select(F.col("doc_id").alias("__id"), F.xxhash64(text).alias("__th"), F.posexplode(F.transform(
        F.filter(F.transform(_lines(text), _trimmed), lambda x: x != ""),
        lambda x: F.struct(F.xxhash64(x).alias("h"), F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+")).alias("w")))).alias("n", "x"))
    return one.select(*DOC, "n", "x.h", "x.w").repartition(*DOC).dropDuplicates([*DOC, "n"])


def fingerprints(lines: DataFrame, gram_words: int = GRAM_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """(__id, __th, p, g, a, b, run): the windows a..b of `lines`, each once, with their hash and the gram they select: line p, hash g."""
    doc = Window.partitionBy(*DOC).orderBy("n")
    lines = lines.withColumn("c", F.sum("w").over(doc)).withColumn("o", F.col("c") - F.col("w"))
    by_start, by_end = Window.partitionBy(*DOC).orderBy("o"), Window.partitionBy(*DOC).orderBy("c")
    gram, ahead = by_start.rangeBetween(0, gram_words - 1), by_start.rangeBetween(0, run_words - 1)
    grams = lines.withColumns({"gram": F.when(F.sum("w").over(gram) >= gram_words, F.struct(F.xxhash64(F.collect_list("h").over(gram)).alias("g"), F.col("n").alias("p"))),
                               "ahead": F.collect_list("h").over(ahead), "ahead_w": F.sum("w").over(ahead)})
    picked = grams.withColumn("pick", F.min("gram").over(by_start.rangeBetween(0, run_words - gram_words)))
    # a run up to line n holds the window from its first line on, and with it that window's gram
    back = by_end.rangeBetween(1 - run_words, 0)
    found = picked.select(*DOC, "n", "w", "pick", "ahead", "ahead_w", F.first("pick").over(back).alias("back_pick"),
                          F.collect_list("h").over(back).alias("back"), F.sum("w").over(back).alias("back_w"))

    def window(pick: str, first: Column, last: Column, hashes: str) -> Column:
        return F.struct(F.col(pick)["p"].alias("p"), F.col(pick)["g"].alias("g"), first.alias("a"), last.alias("b"), F.xxhash64(hashes).alias("run"))
    n = F.col("n")
    # a run up to line n that is also the shortest from its first line on is there already
    spans = F.array(F.when(F.col("ahead_w") >= run_words, window("pick", n, n + F.size("ahead") - 1, "ahead")),
                    F.when(F.col("back_w") - F.col("w") >= run_words, window("back_pick", n - F.size("back") + 1, n, "back")))
    return found.select(*DOC, F.inline(F.filter(spans, lambda x: x.isNotNull())))


def extended_matches(prints: DataFrame) -> DataFrame:
    """(__id, __th, p, a, b): the positions whose windows stand earlier, extended to both sides as far as these reach."""
    place = F.struct("__id", "__th", "p")
    first = (prints.groupBy("g", "run").agg(F.min(place).alias("first_place"), F.count("*").alias("times"))
             .where("times > 1").drop("times"))
    later = prints.join(first, ["g", "run"]).where(F.col("first_place") < place)
    return later.select(*DOC, "p", "a", "b").repartition(*DOC).groupBy(*DOC, "p").agg(F.min("a").alias("a"), F.max("b").alias("b"))


def repeated_runs(docs: DataFrame, run_words: int = RUN_WORDS, gram_words: int = GRAM_WORDS) -> DataFrame:
    """(__id, __th, gone): the sorted numbers of the lines that stand in later copies of runs of `run_words` words or more."""
    runs = extended_matches(fingerprints(numbered_lines(docs), gram_words, run_words))
    numbers = F.flatten(F.transform(F.collect_list(F.struct("a", "b")), lambda x: F.sequence(x["a"], x["b"])))
    return runs.groupBy(*DOC).agg(F.sort_array(F.array_distinct(numbers)).alias("gone"))


def dedup_runs(docs: DataFrame, run_words: int = RUN_WORDS, gram_words: int = GRAM_WORDS, lines: str = "__lines", gone: str = "__gone") -> DataFrame:
    """The documents without the later copies of runs in `text`, and two columns: `lines`, how many lines hold a word, and `gone`, the
    numbers of those deleted."""
    repeated, own = repeated_runs(docs, run_words, gram_words), free_prefix(docs.columns)
    th, g_id, g_th, g, every, full, ends = (own + n for n in ("th", "g_id", "g_th", "g", "all", "full", "ends"))
    repeated = repeated.select(F.col("__id").alias(g_id), F.col("__th").alias(g_th), F.col("gone").alias(g))
    marked = docs.withColumn(th, F.xxhash64("text"))
    joined = marked.join(repeated, (F.col(th) == F.col(g_th)) & F.col("doc_id").eqNullSafe(F.col(g_id)), "left")
    # positions of the deleted lines among all lines, with the ends of the text on both sides; what stays are the slices between
    with_word = F.filter(F.transform(_lines(F.col("text")), lambda x, i: F.when(_trimmed(x) != "", i)), lambda i: i.isNotNull())
    spots = F.transform(g, lambda k: F.element_at(F.col(full), k + 1))
    stays = F.flatten(F.transform(F.sequence(F.lit(1), F.size(ends) - 1), lambda k: F.slice(
        F.col(every), F.element_at(F.col(ends), k) + 2, F.element_at(F.col(ends), k + 1) - F.element_at(F.col(ends), k) - 1)))
    changed = F.col(g).isNotNull()
    work = (joined.withColumns({every: _lines(F.col("text")), full: with_word})
            .withColumn(ends, F.when(changed, F.concat(F.array(F.lit(-1)), spots, F.array(F.size(every)))))
            .withColumn("text", F.when(changed, F.array_join(stays, "\n")).otherwise(F.col("text"))))
    plain = [F.col(f"`{c}`") for c in docs.columns]
    return work.select(*plain, F.coalesce(F.size(full), F.lit(0)).alias(lines), F.coalesce(g, F.array().cast("array<int>")).alias(gone))
