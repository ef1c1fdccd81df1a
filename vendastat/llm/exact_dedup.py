"""Exact dedup: group by 128-bit content hash, compare bytes inside groups, keep one row each.

Only DataFrame functions. The first pass turns every text into a narrow row of hashes, so a
hot group costs one small row per copy and copies combine before the shuffle. The second pass
compares bytes, and reads only texts that share their hash with another row.

Defined results: a null text counts as empty, and all empty texts are one group. ``doc_id``
may be null or repeated; a null id loses against any other, and of rows that repeat both id
and text one stays. An empty table gives an empty result. Columns other than the id and the
text are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import matching_rows, store, text_or_empty

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A to Z in lower case; every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def as_is(text: Column) -> Column:
    return text


def content_hash(text: Column) -> Column:
    """128 bits as 16 bytes."""
    return F.unhex(F.md5(F.encode(text, "UTF-8")))


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", normalise=as_is
) -> DataFrame:
    """One row per input row: id, row_no, keep_id, group_size, kept, text_sha256.

    ``keep`` says which id of a group stays, the smallest or the largest; among rows with
    that id the first one. ``row_no`` tells repeated rows apart inside this result.
    """
    text = normalise(text_or_empty(text_col))
    narrow = store(
        docs.select(
            F.col(id_col).alias("id"),
            F.monotonically_increasing_id().alias("row_no"),
            content_hash(text).alias("hash"),
            F.sha2(F.encode(text, "UTF-8"), 256).alias("text_sha256"),
        ),
        "exact",
    )
    narrow = narrow.withColumn("part", F.lit(""))
    groups = store(_groups(narrow, keep), "exact-groups")
    differing = _differing(docs.select(text.alias("text")), groups)
    if not differing.isEmpty():
        marked = differing.select("hash", F.lit(True).alias("differs"))
        narrow = narrow.join(marked, "hash", "left").withColumn(
            "part", F.when(F.col("differs"), F.col("text_sha256")).otherwise("")
        )
        groups = store(_groups(narrow, keep), "exact-groups")
    # Groups are stored, so both sides are plain shuffles and a hot one can be split.
    joined = narrow.join(groups, ["hash", "part"], "left")
    alone = F.col("group_size").isNull()
    return joined.select(
        "id",
        "row_no",
        F.when(alone, F.col("id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row_no") == F.abs("best.at"))).alias("kept"),
        "text_sha256",
    )


def _groups(narrow: DataFrame, keep: str) -> DataFrame:
    """Groups of two rows or more, with the row that stays. Copies combine in each task."""
    order, sign = (F.min, 1) if keep == "smallest" else (F.max, -1)
    # The row that stays is first in this order; a null id is last either way.
    rank = F.struct((F.col("id").isNull().cast("int") * sign).alias("absent"), "id", (F.col("row_no") * sign).alias("at"))
    groups = narrow.groupBy("hash", "part").agg(order(rank).alias("best"), F.count("*").alias("group_size"))
    return groups.where("group_size > 1")


def _differing(texts: DataFrame, groups: DataFrame) -> DataFrame:
    """Hashes shared by texts that are not the same; in practice none.

    The smallest and the largest text of a group are compared byte by byte: they agree if and
    only if all texts do. Only texts that share their hash are read on, and they combine
    inside each task first, so a hot group sends a text or two per task.
    """
    shared = groups.select("hash")
    suspects = texts.withColumn("hash", content_hash(F.col("text"))).join(shared, "hash", "left_semi")
    # Another column than the join's, so that this is a shuffle of its own behind a join that can be split.
    suspects = suspects.select(F.base64("hash").alias("key"), "text")
    ends = suspects.groupBy("key").agg(F.min("text").alias("low"), F.max("text").alias("high"))
    return store(ends.where("low <> high").select(F.unbase64("key").alias("hash")), "collisions")


def drop_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", normalise=as_is
) -> DataFrame:
    """The rows that stay, with all columns of ``docs``.

    Rows are matched by hash and id, so a hot text is spread by its ids. Only where a row
    that stays is repeated as a whole are its repetitions dropped in a second step.
    """
    groups = exact_groups(docs, id_col, text_col, keep, normalise)
    stays = groups.where(F.col("id").eqNullSafe(F.col("keep_id")))
    stays = stays.groupBy("id", F.col("text_sha256").alias("hash")).agg(F.count("*").alias("rows"))
    sha = F.sha2(F.encode(normalise(text_or_empty(text_col)), "UTF-8"), 256)
    return matching_rows(docs, stays, id_col, sha)
