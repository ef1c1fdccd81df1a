"""Mixing sources to target weights: capped water-filling, then seeded repetitions.

Only DataFrame functions. Sources weigh by a cycle of weights in code point order. Their
targets share a budget of words; a target is clamped where its source would be repeated too
often, and what is left over goes to the others by weight until none is above its clamp. A
source then takes every document ``floor(target / size)`` times, and once more the first ones
of a seeded order until the target is met as nearly as whole documents allow.

The seeded order is cut without sorting a source: sums per bucket of the order find the bucket
in which the target is met, sums per finer bucket the part of that bucket, and only the rest,
about one document in a million, is added up row by row. No window sees more than 1024 sums of
one source, however many rows it has.

Defined results: a null text has size 0; a null source is a source, last in order. Documents
without words are taken like others, which takes no words; a source without words has target 0
and its documents are taken once. A repeated row is a row like any other; rows that agree in
source, id and text share their place in the order and are told apart by an arbitrary but
stored number. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import global_positions, store

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SEED = 42
#: Buckets of one source at each level of the seeded order.
BUCKETS = 1024


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded_key(doc_id: Column, text: Column, seed: int) -> Column:
    """The place of a document in the seeded order of its source."""
    content = F.md5(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))
    return F.md5(F.concat_ws("/", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), content))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """(source, source_size, target) from rows of (source, size): the water-filling.

    Every round clamps the sources above their limit and spreads the rest of the budget over
    the others. Clamped sources stay clamped, so it ends; only three sums reach the driver.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # Sources are ordered in one go; UTF-8 bytes sort like code points.
    placed = global_positions(totals, [F.col("source").asc_nulls_last()], "sources")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    placed = placed.withColumn("weight", F.get(cycle, (F.col("position") % len(weights)).cast("int")))
    placed = store(placed.withColumn("limit", F.col("source_size") * max_epochs), "source-weights")
    budget = (placed.agg(F.sum("source_size")).first()[0] or 0) * share
    level, before = 0.0, None
    while True:
        clamped = F.col("weight") * level >= F.col("limit")
        taken, left, most = placed.agg(
            F.sum(F.when(clamped, F.col("limit"))),
            F.sum(F.when(~clamped, F.col("weight"))),
            F.sum(F.when(~clamped, F.lit(1))),
        ).first()
        if not most or most == before:
            break
        level, before = (budget - (taken or 0.0)) / left, most
    target = F.when(clamped, F.col("limit")).otherwise(F.col("weight") * level)
    return placed.select("source", "source_size", target.alias("target"))


def mix_plan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = SEED,
) -> DataFrame:
    """One row per document: id, key, size, source, source_size, target, repetitions, taken."""
    rows = store(
        docs.select(
            F.col(id_col).alias("id"),
            F.monotonically_increasing_id().alias("row_no"),
            F.col(source_col).alias("source"),
            word_count(F.col(text_col)).alias("size"),
            seeded_key(F.col(id_col), F.col(text_col), seed).alias("key"),
        ),
        "mix",
    )
    targets = store(source_targets(rows.select("source", "size"), weights, share, max_epochs), "targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(1)
    # Words still to be taken after whole repetitions of everything.
    targets = targets.withColumn("whole", whole.cast("long")).withColumn(
        "rest", F.col("target") - F.col("whole") * F.col("source_size")
    )
    levels = [F.conv(F.substring("key", at, 4), 16, 10).cast("int") % BUCKETS for at in (1, 5)]
    rows = rows.withColumn("coarse", levels[0]).withColumn("fine", levels[1])
    targets = targets.withColumn("id_of_source", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))
    rows = rows.withColumn("id_of_source", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))
    limits = targets.where("rest > 0").select("id_of_source", "rest")

    coarse = _cut(rows, limits, "coarse")
    in_coarse = rows.join(coarse, ["id_of_source", "coarse"])
    fine = _cut(in_coarse.drop("rest"), coarse.select("id_of_source", "rest"), "fine")
    in_fine = in_coarse.drop("rest").join(fine, ["id_of_source", "fine"])
    order = Window.partitionBy("id_of_source").orderBy("key", "row_no").rowsBetween(Window.unboundedPreceding, 0)
    last = in_fine.withColumn("upto", F.sum("size").over(order)).select(
        "row_no", (F.col("upto") - F.col("size") / 2 <= F.col("rest")).alias("once_more_row")
    )
    cuts = coarse.select("id_of_source", F.col("coarse").alias("coarse_cut")).join(
        fine.select("id_of_source", F.col("fine").alias("fine_cut")), "id_of_source", "left"
    )
    cuts = store(targets.join(cuts, "id_of_source", "left").drop("source", "rest"), "cuts")
    last = store(last, "last-rows")
    joined = rows.join(cuts, "id_of_source").join(last, "row_no", "left")
    # Before the cut once more, behind it not; without a cut the target is met by whole repetitions.
    before = F.when(F.col("coarse") != F.col("coarse_cut"), F.col("coarse") < F.col("coarse_cut")).otherwise(
        F.when(F.col("fine") != F.col("fine_cut"), F.col("fine") < F.col("fine_cut")).otherwise(F.col("once_more_row"))
    )
    repetitions = F.col("whole") + F.coalesce(before, F.lit(False)).cast("long")
    return joined.select(
        "id",
        "key",
        "size",
        "source",
        "source_size",
        "target",
        repetitions.alias("repetitions"),
        (repetitions * F.col("size")).alias("taken"),
    )


def _cut(rows: DataFrame, limits: DataFrame, level: str) -> DataFrame:
    """(id_of_source, ``level``, rest): the bucket in which each source meets its limit.

    ``rest`` is what that bucket still has to give. Sizes combine before the shuffle; the
    window runs over the at most 1024 sums of a source.
    """
    sums = store(rows.groupBy("id_of_source", level).agg(F.sum("size").alias("words")), f"sums-{level}")
    order = Window.partitionBy("id_of_source").orderBy(level).rowsBetween(Window.unboundedPreceding, 0)
    upto = sums.join(limits, "id_of_source").withColumn("upto", F.sum("words").over(order))
    found = upto.where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("words") <= F.col("rest")))
    rest = F.col("rest") - (F.col("upto") - F.col("words"))
    return store(found.select("id_of_source", level, rest.alias("rest")), f"cut-{level}")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the columns of ``docs``, each row as often as it is taken.

    ``options`` are those of ``mix_plan``. Decisions are matched by source and by the key
    made of id and text. Rows that agree in all three share out their repetitions.
    """
    id_col, text_col, source_col = (options.get(f"{c}_col", d) for c, d in (("id", "doc_id"), ("text", "text"), ("source", "source")))
    plan = mix_plan(docs, **options)
    plan = plan.groupBy("key", "source").agg(F.sum("repetitions").alias("__vs_times"), F.count("*").alias("__vs_rows"))
    plan = plan.select(F.col("key").alias("__vs_key"), F.col("source").alias("__vs_source"), "__vs_times", "__vs_rows")
    key = seeded_key(F.col(id_col), F.col(text_col), options.get("seed", SEED))
    found = docs.withColumn("__vs_own", key).join(
        plan, (F.col("__vs_own") == F.col("__vs_key")) & F.col(source_col).eqNullSafe(F.col("__vs_source"))
    )
    order = Window.partitionBy("__vs_key", "__vs_source").orderBy("__vs_own")
    nth = F.when(F.col("__vs_nth") <= F.col("__vs_times") % F.col("__vs_rows"), 1).otherwise(0)
    repeated = found.where("__vs_rows > 1").withColumn("__vs_nth", F.row_number().over(order))
    repeated = repeated.withColumn("__vs_times", F.floor(F.col("__vs_times") / F.col("__vs_rows")) + nth)
    both = found.where("__vs_rows = 1").unionByName(repeated.drop("__vs_nth"))
    copies = F.explode(F.array_repeat(F.lit(0), F.col("__vs_times").cast("int"))).alias("__vs_copy")
    return both.select(*docs.columns, copies).select(*docs.columns)
