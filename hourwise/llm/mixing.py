"""Mixing sources to target weights by Pareto order sampling.

Sources share `total` times all sizes by weight; a target stops at `most` times its source's size and the excess is shared
again by weight. With r = target / size of the source, every document of it is taken floor(r) times for certain. What is left
of the target, `rest` words, is drawn without replacement with unequal odds: a document of size s has inclusion odds t * s, where
t is common to its source. With u its random number, it ranks by random odds divided by inclusion odds,

    (u / (1 - u)) / (t * s)

and the lowest ranks are taken until their words fill `rest`; the last one is taken if more than half of it fits. t moves no document
of a source past another, so ranks are made without it and the cut gives it: a document is in where u / (1 - u) <= t * s. The sample
size is fixed in words, so a source ends within half of one document of its target; long documents, whose halves would
miss it by most, have high odds to be in before the cut. u comes from a hash of (seed, doc_id, text), so reruns agree on any partitioning.

No source is ever ordered as a whole: words are added up per narrow bucket of the logarithm of the rank, the bucket in which
`rest` is reached is found from the sums, and only the ranks in it are ordered. The rows that repeat both doc_id and text share a
rank; where the cut falls among them they are numbered over many tasks and as many of them are taken as fit.

Defined results: null and empty texts have size 0, are taken for certain copies alone and hold no words; very long texts are read
whole; null sources are one source, the last; rows that repeat a doc_id are separate documents; a null doc_id hashes like the
empty text; an empty table gives an empty table; extra columns pass whatever their names, and the names of the columns added can be
chosen (`marks`). All sources are ordered by name in one task: one small row per source."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourwise.llm.common import free_prefix
from hourwise.operators.numbering import numbered
from hourwise.session import cut_lineage

SMALL_PLAN = 50_000          # sources up to which the plan is sent to all executors
BUCKET_DOCS = 20_000         # documents per bucket of an octave of the rank
SPAN = 2 ** 52
MARKS = ("__size", "__source_size", "__target", "__copies")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def random_number(seed: int, text: str) -> Column:
    """52 bits of the md5 of (seed, doc_id, text)."""
    parts = F.concat(F.lit(f"{seed}_"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("_"), F.coalesce(F.col(text), F.lit("")))
    return F.conv(F.substring(F.md5(parts), 1, 13), 16, 10).cast("bigint")


def _marked(docs: DataFrame, own: str, seed: int, text: str, source: str) -> DataFrame:
    """Adds key, size, u and rank, their names behind the prefix `own`. The rank of a document without words is null."""
    u = (F.col(own + "u") + 0.5) / SPAN
    return (docs.withColumn(own + "size", word_count(F.col(text)))
            .withColumns({own + "key": F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")), own + "u": F.coalesce(random_number(seed, text), F.lit(0))})
            .withColumn(own + "rank", F.when(F.col(own + "size") > 0, u / ((1 - u) * F.col(own + "size")))))


def source_targets(sizes: DataFrame, weights: tuple[float, ...], total: float, most: float) -> DataFrame:
    """(key, source_size, target, rate) from (key, source_size): one row per source.

    Sources reach their stop in the order of stop / weight, so the level of the others follows from running sums."""
    by_name = Window.orderBy(F.col("key") == "", "key")
    table = F.array(*[F.lit(float(w)) for w in weights])
    weighted = sizes.withColumn("w", F.element_at(table, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    every, filled = Window.partitionBy(), Window.orderBy(F.col("source_size") / F.col("w"), "key")
    running = (weighted.withColumns({"all_size": F.sum("source_size").over(every), "all_w": F.sum("w").over(every)})
               .withColumns({"w_from": F.col("all_w") - F.sum("w").over(filled) + F.col("w"),
                             "stops_before": most * (F.sum("source_size").over(filled) - F.col("source_size"))})
               .withColumn("level", (total * F.col("all_size") - F.col("stops_before")) / F.col("w_from"))
               .withColumn("stopped", F.col("w") * F.col("level") >= most * F.col("source_size")))
    level = F.max(F.when(~F.col("stopped"), F.col("level"))).over(every)          # it only falls behind the first that does not stop
    return running.select("key", "source_size", F.when(F.col("stopped"), most * F.col("source_size")).otherwise(F.col("w") * level).alias("target"),
                          F.when(F.col("stopped") | (F.col("source_size") == 0), F.lit(float(most))).otherwise(F.col("w") * level / F.col("source_size")).alias("rate"))


def sampling_plan(light: DataFrame, weights: tuple[float, ...], total: float, most: float) -> DataFrame:
    """One row per source: key, source_size, target, certain copies and the cut (cut_rank, cut_u). Ranks below the cut are taken, and
    `fit` of the `ties` rows that share it.

    `light` holds key, size, u and rank of every document."""
    octave = max(64, light.count() // BUCKET_DOCS)
    light = light.withColumn("bucket", F.floor(F.log2("rank") * octave).cast("bigint"))
    counts = cut_lineage(light.groupBy("key", "bucket").agg(F.sum("size").alias("words"), F.max("rank").alias("last")))
    targets = source_targets(counts.groupBy("key").agg(F.sum("words").alias("source_size")), weights, total, most)
    targets = cut_lineage(targets.select("key", "source_size", "target", F.floor("rate").alias("certain"),
                                         (F.col("target") - F.floor("rate") * F.col("source_size")).alias("rest")))
    upto = F.sum("words").over(Window.partitionBy("key").orderBy("bucket"))
    sums = counts.where("bucket IS NOT NULL").withColumn("upto", upto).join(targets.select("key", "rest"), "key")
    whole = sums.where("upto <= rest").groupBy("key").agg(F.max("last").alias("whole_rank"))
    opened = sums.where("upto > rest AND upto - words < rest").select("key", "bucket", "rest", (F.col("upto") - F.col("words")).alias("before"))
    # only the ranks of the bucket in which `rest` is reached are ordered; rows that share a rank are one row here
    groups = light.join(opened, ["key", "bucket"]).groupBy("key", "rank", "u", "size", "rest", "before").agg(F.count("*").alias("ties"))
    words = F.col("size") * F.col("ties")
    start = F.col("before") + F.sum(words).over(Window.partitionBy("key").orderBy("rank", "u", "size")) - words
    room = F.floor((F.col("rest") - (start + F.col("size") / 2)) / F.col("size")) + 1
    cuts = (groups.withColumn("fit", F.greatest(F.lit(0), F.least(F.col("ties"), room))).where("fit > 0")
            .groupBy("key").agg(F.max(F.struct("rank", "u", "fit", "ties")).alias("cut")))
    plan = targets.join(whole, "key", "left").join(cuts, "key", "left")
    return cut_lineage(plan.select("key", "source_size", "target", "certain", F.coalesce("cut.rank", "whole_rank").alias("cut_rank"),
                                   F.coalesce("cut.u", F.lit(SPAN)).alias("cut_u"), F.coalesce("cut.fit", F.lit(0)).alias("fit"), F.coalesce("cut.ties", F.lit(0)).alias("ties")))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), total: float = 1.5, most: float = 2.0, seed: int = 20, text: str = "text",
        source: str = "source", keep: list[str] | None = None, marks: tuple[str, str, str, str] = MARKS) -> DataFrame:
    """`keep` (all columns by default) and `marks`: the size, the source's size and target, and how often the mix takes the document."""
    keep, own = docs.columns if keep is None else keep, free_prefix(docs.columns)
    names = ["key", "size", "u", "rank"]
    marked = _marked(docs, own, seed, text, source)
    mine = [own + n for n in names]
    light = cut_lineage(marked.select(*mine) if text in keep else marked.select(*[F.col(f"`{c}`") for c in keep], *mine))
    plan = sampling_plan(light.select(*[F.col(own + n).alias(n) for n in names]), weights, total, most)
    split = not plan.where("0 < fit AND fit < ties").isEmpty()
    plan = plan.select(*[F.col(c).alias(own + c) for c in plan.columns])
    if plan.count() <= SMALL_PLAN:
        plan = F.broadcast(plan)
    rows = (marked if text in keep else light).join(plan, own + "key")
    rank, u, cut_rank, cut_u, fit, ties = (F.col(own + c) for c in ("rank", "u", "cut_rank", "cut_u", "fit", "ties"))
    inside = F.coalesce((rank < cut_rank) | ((rank == cut_rank) & (u <= cut_u)), F.lit(False))
    if split:                              # some rows that share the rank of a cut are taken and some are not: number them
        shared = F.coalesce((rank == cut_rank) & (u == cut_u) & (fit < ties), F.lit(False))
        packed = rows.where(shared).select(F.col(own + "key").alias("key"), F.struct("*").alias("row"))
        tied = numbered(packed, [F.col("key")], "no", ties=F.monotonically_increasing_id())
        firsts = tied.groupBy("key").agg(F.min("no").alias("first"))           # one row per source
        tied = tied.join(firsts, "key").select("row.*", (F.col("no") - F.col("first") < F.col(f"row.{own}fit")).alias(own + "taken"))
        rows = rows.where(~shared).withColumn(own + "taken", inside).unionByName(tied)
    else:
        rows = rows.withColumn(own + "taken", inside)
    copies = F.col(own + "certain") + F.col(own + "taken").cast("int")
    return rows.select(*[F.col(f"`{c}`") for c in keep], *[F.col(own + c).alias(m) for c, m in zip(("size", "source_size", "target"), marks)], copies.alias(marks[3]))
