"""Mixing sources to target weights by Efraimidis-Spirakis sampling. DataFrame operations only.

Each document draws an exponential key scaled by its quality weight; in the order of the keys a source's documents
are taken until their words fill its budget. What a target has beyond whole passes over its source (epochs) is
filled so. The order is never sorted as a whole: keys are cut into ranges of a few thousand documents, the ranges are
summed, and only the one range in which a source's budget ends is put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

WORD = r"[^\x20\x09-\x0D]+"
EPOCHS = 3
# Documents of a source that share a range of keys, about.
RANGE_ROWS = 4096
# Times the gap left at the end of a budget is filled with documents that still fit.
FILLS = 4


def quality_weight(text: Column) -> Column:
    """1 for plain text, down to 0.1 as the share of marks other than letters, digits, blanks and stops grows."""
    plain = F.length(F.regexp_replace(text, r"[\p{L}\p{N}\s.,;:'!?()\"-]+", ""))
    return F.greatest(F.lit(0.1), 1 - 4.0 * plain / F.greatest(F.length(text), F.lit(1)))


def source_targets(sizes: DataFrame, epochs: int = EPOCHS, weights: tuple[float, ...] = (1.0, 2.0, 3.0), total: float | None = None) -> DataFrame:
    """``source``, ``source_size`` -> the same and ``target``: shares of the total by weight, none above ``epochs`` times its source.

    Sources are weighed in the order of their names (code points, null last), the weights repeating. A source whose
    share exceeds what it has is given that, and the rest is shared among the others: with the sources in the order of
    size by weight, the first ones are full, and the level of the others follows from running sums. One row per
    source is put in order in one task: the list of sources is a catalogue, not data. ``total`` defaults to the sum
    of the sizes.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    value = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", value).withColumn("most", F.col("source_size").cast("double") * epochs)
    s = s.withColumn("all", F.lit(total) if total is not None else F.sum("source_size").over(Window.partitionBy()).cast("double"))
    full = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source")
    s = s.withColumn("before", F.coalesce(F.sum("most").over(full.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("rest", F.sum("weight").over(full.rowsBetween(0, Window.unboundedFollowing)))
    # Full if the level, were it and all after it not, would lie above it.
    level = (F.col("all") - F.col("before")) / F.col("rest")
    first = F.when(level * F.col("weight") < F.col("most"), F.struct((F.col("most") / F.col("weight")).alias("r"), F.col("source").isNull().alias("n"), "source", level.alias("level")))
    s = s.withColumn("level", F.min(first).over(Window.partitionBy())["level"])
    target = F.when(F.col("level").isNull(), F.col("most")).otherwise(F.least(F.col("most"), F.col("level") * F.col("weight")))
    return s.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight: Column | None = None,
        epochs: int = EPOCHS, weights: tuple[float, ...] = (1.0, 2.0, 3.0), total: float | None = None, seed: int = 42) -> DataFrame:
    """Per row of ``docs``: ``id``, ``uid`` (hash of id, source and text), ``size`` (words), ``source``, ``source_size``, ``target`` and
    ``copies``: how often the mix takes the document.

    ``weight`` is a positive number per row (default: quality_weight); null counts as 0.1. Keys depend on the seed, the
    id and the text alone, so reruns agree. Rows without words are taken for none. Rows that repeat in full draw the
    same key and are told apart by their place in the order only.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    w = F.coalesce((quality_weight(text) if weight is None else weight).cast("double"), F.lit(0.1))
    slim = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{source_col}`").cast("string"), text).alias("uid"), w.alias("w"))
    draw = (F.pmod(F.xxhash64(F.lit(seed), F.col("uid")), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    slim = materialise(slim.withColumn("key", -F.log(draw) / F.greatest("w", F.lit(1e-6))).drop("w"))
    per = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    plan = source_targets(per.select("source", "source_size"), epochs, weights, total).join(
        per.select(F.col("source").alias("s_"), "rows"), F.col("source").eqNullSafe(F.col("s_"))).drop("s_")
    whole = F.least(F.floor(F.col("target") / F.greatest("source_size", F.lit(1))), F.lit(epochs)).cast("long")
    plan = materialise(plan.withColumn("whole", whole).withColumn("budget", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
                       .withColumnRenamed("source", "s_"))
    placed = slim.join(plan, F.col("source").eqNullSafe(F.col("s_"))).drop("s_")
    # Keys run from 0 up; this maps them to ranges, in order.
    ranges = F.ceil(F.col("rows") / RANGE_ROWS)
    placed = placed.withColumn("part", F.floor((1 - F.exp(-F.col("key"))) * ranges).cast("long"))
    sums = placed.groupBy("source", "part").agg(F.sum("size").alias("words"), F.max("budget").alias("budget"))
    run = F.sum("words").over(Window.partitionBy("source").orderBy("part"))
    ends = materialise(sums.withColumn("upto", run).where("upto > budget").groupBy("source").agg(
        F.min(F.struct("part", (F.col("upto") - F.col("words")).alias("had"))).alias("e")).select(F.col("source").alias("s_"), F.col("e.part").alias("end"), F.col("e.had").alias("had")))
    placed = placed.join(ends, F.col("source").eqNullSafe(F.col("s_")), "left").drop("s_")
    cols = ["id", "uid", "size", "source", "source_size", "target"]
    sure = placed.where("end is null or part != end").select(*cols, (F.col("whole") + F.when(F.col("end").isNull() | (F.col("part") < F.col("end")), 1).otherwise(0)).alias("copies"))
    last = placed.where("part = end").select(*cols, "key", "whole", (F.col("budget") - F.col("had")).alias("gap"), F.lit(0).alias("taken"))
    by = Window.partitionBy("source", "taken").orderBy("key", "uid", "id")
    for _ in range(FILLS):
        # In order, what is not yet taken and fits the gap: as much as the gap holds.
        fits = (F.col("taken") == 0) & (F.col("size") <= F.col("gap"))
        ran = F.sum(F.when(fits, F.col("size")).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, 0))
        last = last.withColumn("now", F.when(fits & (ran <= F.col("gap")), 1).otherwise(0))
        used = F.sum(F.when(F.col("now") == 1, F.col("size")).otherwise(0)).over(Window.partitionBy("source"))
        last = last.withColumn("gap", F.col("gap") - used).withColumn("taken", F.greatest("taken", "now")).drop("now")
    # The next one in order is taken too if that ends nearer to the target.
    near = F.when(F.col("taken") == 0, F.abs(F.col("size") - F.col("gap")))
    least = F.min(F.struct(near.isNull().alias("none"), near.alias("d"), "key", "uid", "id")).over(Window.partitionBy("source"))
    mine = (F.col("taken") == 0) & (F.col("key") == least["key"]) & (F.col("uid") == least["uid"]) & (near < F.col("gap"))
    last = last.withColumn("pick", mine).withColumn("nth", F.row_number().over(Window.partitionBy("source", "pick").orderBy("key", "uid", "id")))
    taken = F.when((F.col("taken") == 1) | (F.col("pick") & (F.col("nth") == 1)), 1).otherwise(0)
    both = sure.unionByName(last.select(*cols, (F.col("whole") + taken).alias("copies")))
    return both.withColumn("copies", F.when(F.col("size") > 0, F.least("copies", F.lit(epochs).cast("long"))).otherwise(F.lit(0).cast("long")))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """``docs`` with ``copies``: how often the mix takes each row. Rows that repeat in full share out what they are taken."""
    uid = F.xxhash64(F.col(f"row.`{id_col}`"), F.col(f"row.`{source_col}`").cast("string"), F.coalesce(F.col(f"row.`{text_col}`").cast("string"), F.lit("")))
    counts = mix(docs, id_col, text_col, source_col, **how).groupBy("uid", "copies").agg(F.count(F.lit(1)).alias("n"))
    taken = materialise(counts.groupBy("uid").agg(F.collect_list(F.struct("copies", "n")).alias("each"), F.sum("n").alias("rows")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumn("uid", uid)
    alone = rows.join(taken.where("rows = 1"), "uid").select("row.*", F.col("each")[0]["copies"].alias("copies"))
    # Equal rows: one of them is kept and written again as often as needed.
    one = rows.join(taken.where("rows > 1"), "uid").groupBy("uid").agg(F.first("row").alias("row"), F.first("each").alias("each"))
    again = one.select("row", F.explode("each").alias("e")).select("row", F.col("e.copies").alias("copies"), F.explode(F.sequence(F.lit(1).cast("long"), "e.n")).alias("i"))
    return alone.unionByName(again.select("row.*", "copies"))
