"""Conversation structure repair: the cheapest edits that give every conversation a sound shape.

A conversation is sound if it is empty, or an optional system turn followed by one or more pairs of
user and assistant turns. Rows are kept (free), given another role (1) or deleted (2, a must for
blank and duplicate ones), empty turns are inserted (5), and a truncated row that stays costs 5.

Each row becomes a symbol, its role and its fault; equal neighbours are collapsed into runs. What
a symbol does to the four states of the shape is a 4 x 4 matrix over minimum and plus. Going
backward, a run of n rows is passed by the cached powers 1, 2, 4, 8, ... of its matrix, which
gives the cost to go before each run. Going forward, the choices are unrolled row by row: the
smallest letter among those that stay on a cheapest way. As a state and a letter allow one
continuation only, that is the least audit of all.

Rows of a conversation are ordered by turn (nulls first), then by role and the hash of the text. Conversations are
dealt out by their key and streamed in order, one in memory at a time. One above ``giant_bytes``
never meets in one place with its texts: repeats are found by a count per content, its rows are
ordered and stored by range, and only a letter per row goes to the one task that decides the
edits (its result, the audit, is as long). Repaired rows are then made range by range. A digest
of the repaired texts, which is sequential by definition, is fed from a sorted stream.

Defined results: null roles and texts count as one space, null conversation keys are one
conversation, null turns come first and count for no gap. Roles are told by their first
character; one that has none can't be kept. Equal rows are duplicates of the first. Rows marked
as absent only keep their conversation in the result: without other rows it has zeros and an
empty audit. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby
from operator import eq

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, store

SPACES = " \t\n\v\f\r"
ENDS = (".", "!", "?")
SOUND, TRUNCATED, BLANK, DUPLICATE = range(4)
#: First letters of roles with a place in the shape; all others share one number.
ROLES = "sua"
KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 1, 2, 5, 5
#: States of the shape: nothing yet, behind a system turn, behind a user, behind an assistant.
STATES, ACCEPTED = range(4), (0, 3)
NEXT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
NEVER = 1 << 60
#: Text above which a conversation is not held in memory as a whole.
GIANT_BYTES = 16 << 20
FULL_NAME = {"u": "user", "a": "assistant"}
#: Choices: K keep, D delete, U and A another role, u and a an inserted turn. Their letters in the audit:
AUDIT = str.maketrans("UAua", "RRII")

Vector = tuple[int, ...]
Matrix = tuple[Vector, ...]


def symbol(role: str, fault: int) -> int:
    return 4 * ROLES.find(role[:1] or "-") % 16 + fault


def product(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(a[i][k] + b[k][j] for k in STATES) for j in STATES) for i in STATES)


def wanted(state: int) -> str:
    """The role that an inserted or changed turn must have."""
    return "a" if state == 2 else "u"


def _inserts() -> Matrix:
    """Cheapest way from state to state by inserted turns alone."""
    least = tuple(tuple(0 if i == j else INSERT if NEXT[wanted(i)][i] == j else NEVER for j in STATES) for i in STATES)
    return product(product(least, least), product(least, least))


INSERTS = _inserts()
#: Cost to go behind the last row.
AT_END: Vector = tuple(min(INSERTS[i][j] for j in ACCEPTED) for i in STATES)


def moves(code: int, state: int) -> Iterator[tuple[str, int, int]]:
    """What can be done with a row in a state: (choice, cost, next state), by letter of the audit."""
    role, fault = (ROLES + "-")[code // 4], code % 4
    yield "D", DELETE, state
    if fault in (SOUND, TRUNCATED):
        extra = UNFINISHED if fault == TRUNCATED else 0
        if role in NEXT and NEXT[role][state] is not None:
            yield "K", KEEP + extra, NEXT[role][state]
        other = wanted(state)
        yield other.upper(), REROLE + extra, NEXT[other][state]


@lru_cache(maxsize=None)  # 16 symbols, and no more powers than a count has bits
def power(code: int, exponent: int) -> Matrix:
    """The matrix of 2 ** exponent rows of one symbol."""
    if exponent:
        half = power(code, exponent - 1)
        return product(half, half)
    step = [[NEVER] * 4 for _ in STATES]
    for i in STATES:
        for _, cost, j in moves(code, i):
            step[i][j] = min(step[i][j], cost)
    return product(INSERTS, tuple(map(tuple, step)))


@lru_cache(maxsize=1 << 16)
def before_run(code: int, rows: int, after: Vector) -> Vector:
    """Cost to go before ``rows`` rows of one symbol."""
    exponent = 0
    while rows:
        if rows & 1:
            matrix = power(code, exponent)
            after = tuple(min(matrix[i][j] + after[j] for j in STATES) for i in STATES)
        rows >>= 1
        exponent += 1
    return after


def relative(costs: Vector) -> tuple[int, Vector]:
    """The least cost and the others above it, so that equal situations are told to be equal."""
    least = min(costs)
    return least, tuple(c - least for c in costs)


def cheapest(codes: bytes) -> tuple[int, str]:
    """Cost and choices for a conversation of these symbols."""
    runs = [(code, sum(1 for _ in rows)) for code, rows in groupby(codes)]
    total, after, behind = 0, AT_END, []
    for code, rows in reversed(runs):
        behind.append(after)
        least, after = relative(before_run(code, rows, after))
        total += least
    cost = total + after[0]
    out, state = [], 0
    for code, rows in runs:
        after = behind.pop()
        for left in range(rows - 1, -1, -1):
            here, there = before_run(code, left + 1, after), before_run(code, left, after)
            state = _pass_row(code, state, here, there, out)
    while AT_END[state]:
        out.append(wanted(state))
        state = NEXT[wanted(state)][state]
    return cost, "".join(out)


def _pass_row(code: int, state: int, here: Vector, there: Vector, out: list[str]) -> int:
    """Append the choices up to and with one row; the state behind it."""
    while True:
        options = [(c.translate(AUDIT), c, cost + there[to], to, True) for c, cost, to in moves(code, state)]
        new = wanted(state)
        options.append(("I", new, INSERT + here[NEXT[new][state]], NEXT[new][state], False))
        _, choice, _, state, passed = min(o for o in options if o[2] == here[state])
        out.append(choice)
        if passed:
            return state


@lru_cache(maxsize=1 << 14)
def solved(codes: bytes) -> tuple[int, str]:
    return cheapest(codes)


def counts(codes: bytes) -> tuple[int, int, int, int]:
    """Blank, duplicate and truncated rows, and neighbours whose roles can't follow each other."""
    faults = [sum(codes.count(4 * role + fault) for role in STATES) for fault in (BLANK, DUPLICATE, TRUNCATED)]
    initials = bytes(c // 4 for c in codes)
    legal = {(0, 1), (1, 2), (2, 1)}  # numbers in ROLES
    return *faults, sum(pair not in legal for pair in zip(initials, initials[1:], strict=False))


def applied(choices: Iterable[str], rows: Iterator[tuple]) -> Iterator[tuple]:
    """(choice, turn, role, text) of what the choices leave of ``rows`` (turn, role, text) or add."""
    for choice in choices:
        if choice in "ua":
            yield choice, None, FULL_NAME[choice], ""
            continue
        turn, role, text = next(rows)
        if choice != "D":
            yield choice, turn, role if choice == "K" else FULL_NAME[choice.lower()], text


def gaps(turns: list) -> int:
    known = {t for t in turns if t is not None}
    return max(known) - min(known) + 1 - len(known) if known else 0


class Digest:
    """SHA-256 of the lines ``role:text``, fed line by line."""

    def __init__(self) -> None:
        self.sha, self.first = hashlib.sha256(), True

    def add(self, role: str, text: str) -> None:
        self.sha.update(f"{'' if self.first else chr(10)}{role}:{text}".encode())
        self.first = False


def damage(conversations: DataFrame) -> DataFrame:
    """Conversations with planted faults: conv_id, turn, role, text, present.

    A twentieth each by the hash of conversation and turn: dropped (not ``present``), emptied,
    without its sentence ends, repeated, with the role user.
    """
    part = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    rows = conversations.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), kind.alias("kind"))
    text = (
        F.when(F.col("kind") == 1, "")
        .when(F.col("kind") == 2, F.translate("text", "".join(ENDS), ""))
        .otherwise(F.col("text"))
    )
    times = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.withColumn("copy", F.explode(times)).select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        (F.col("kind") != 0).alias("present"),
    )


def _prepared(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, present_col: str | None) -> DataFrame:
    """conv, key (of the conversation, never null), turn, role, text, present, blank, truncated."""
    part = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    solid = F.rtrim(F.col("text"), F.lit(SPACES))
    key = F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit(""))
    return (
        rows.select(
            F.col(conv_col).alias("conv"),
            F.col(turn_col).alias("turn"),
            part(role_col).alias("role"),
            part(text_col).alias("text"),
            (F.col(present_col) if present_col else F.lit(True)).alias("present"),
        )
        .withColumn("key", key)
        .withColumn("blank", solid == "")
        .withColumn("truncated", ~F.right(solid, F.lit(1)).isin(*ENDS))
    )


def _large(rows: DataFrame, giant_bytes: int) -> DataFrame:
    """Keys of conversations above ``giant_bytes``; there are no more of them than that fits in the table."""
    size = F.sum(F.octet_length("text") + F.octet_length("role") + F.lit(64))
    return store(rows.groupBy("key").agg(size.alias("size")).where(F.col("size") > giant_bytes).select("key"), "giants")


_SUMMARY = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
_SUMMARY_FIELDS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
_ROW = "place bigint, edit string, turn {turn}, role string, text string"


def _in_memory(schema: pa.Schema, as_rows: bool):
    """Streams sorted rows, holding one conversation at a time."""

    def finish(conv, turns, roles, texts, faults, out) -> None:
        if any(map(eq, zip(turns, roles, strict=True), zip(turns[1:], roles[1:], strict=True))):
            rows = sorted(
                zip(turns, roles, texts, faults, strict=True),
                key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()),
            )
            turns, roles, texts, faults = map(list, zip(*rows, strict=True))
        seen = set()
        for i, (role, text) in enumerate(zip(roles, texts, strict=True)):
            if faults[i] != BLANK and (role, text) in seen:
                faults[i] = DUPLICATE
            seen.add((role, text))
        codes = bytes(symbol(r, f) for r, f in zip(roles, faults, strict=True))
        cost, choices = solved(codes) if len(codes) <= 64 else cheapest(codes)
        left = applied(choices, zip(turns, roles, texts, strict=True))
        if as_rows:
            out.extend((conv, place, *row) for place, row in enumerate(left))
            return
        digest = Digest()
        for _, _, role, text in left:
            digest.add(role, text)
        audit = choices.translate(AUDIT)
        out.append((conv, gaps(turns), *counts(codes), cost, audit, digest.sha.hexdigest()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, conv, kept, out, held = None, None, ([], [], [], []), [], 0
        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in _STREAMED), strict=True):
                if row[0] != key:
                    if key is not None:
                        finish(conv, *kept, out)
                    key, conv, kept = row[0], row[1], ([], [], [], [])
                if row[5]:
                    for column, value in zip(kept, (*row[2:5], row[6]), strict=True):
                        column.append(value)
                    held += len(row[4])
                if held > 1 << 22 or len(out) >= 10_000:
                    if out:
                        yield _batch(out, schema)
                    out, held = [], 0
        if key is not None:
            finish(conv, *kept, out)
        if out:
            yield _batch(out, schema)

    return run


_STREAMED = ["key", "conv", "turn", "role", "text", "present", "fault"]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema
    )


def _arrow(spark, ddl: str) -> pa.Schema:
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType.fromDDL(ddl))


def _by_key(rows: DataFrame, *within: Column | str) -> DataFrame:
    return rows.repartition(partitions(rows.sparkSession), "key").sortWithinPartitions("key", *within)


def _giants(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored rows of giant conversations with their place, and per range of each its choices and summary."""
    spark = rows.sparkSession
    rows = rows.withColumn("content", F.sha2("text", 256)).withColumn("nth", F.monotonically_increasing_id())
    order = ["key", "turn", "role", "content", "nth"]
    dealt = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).drop("nth")
    dealt = store(dealt.withColumn("place", F.monotonically_increasing_id()), "giant-rows")
    dealt = dealt.withColumn("range", F.shiftright("place", 33))
    there = dealt.where("present")
    firsts = there.where("not blank").groupBy("key", "role", "content").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    firsts = firsts.where("n > 1").drop("n")
    told = dealt.select("key", "conv", "range", "place", "turn", "role", "content", "present", "fault").join(
        firsts, ["key", "role", "content"], "left"
    )
    fault = F.when((F.col("fault") != BLANK) & (F.col("place") > F.col("first")), DUPLICATE).otherwise(F.col("fault"))
    number = F.lit(3)
    for n, initial in enumerate(ROLES):
        number = F.when(F.left("role", F.lit(1)) == initial, n).otherwise(number)
    letter = F.when(F.col("present"), F.char(F.lit(65) + 4 * number + fault)).otherwise("")
    letters = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", letter.alias("l")))), lambda x: x["l"]), "")
    pieces = told.groupBy("key", "range").agg(F.first("conv").alias("conv"), letters.alias("letters"))
    known = there.groupBy("key").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("bigint").alias("gaps")
    )
    conv = dealt.schema["conv"].dataType.simpleString()

    def decide(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values("range").reset_index(drop=True)
        codes = bytes(ord(c) - 65 for c in "".join(pieces["letters"]))
        cost, choices = cheapest(codes)
        at, parts = 0, []
        for rows in pieces["letters"].str.len():
            begin = at
            while rows:
                rows -= choices[at] not in "ua"
                at += 1
            parts.append(choices[begin:at])
        parts[-1] += choices[at:]
        ahead = [sum(c != "D" for c in p) for p in parts]
        out = pieces[["key", "range"]].assign(choices=parts, ahead=[sum(ahead[:i]) for i in range(len(ahead))])
        first = {"cost": cost, "audit": choices.translate(AUDIT)}
        first |= dict(zip(["blank", "duplicate", "truncated", "illegal"], counts(codes), strict=True))
        for name, value in first.items():  # on one row only, as the audit is long
            out[name] = pd.Series([value] + [None] * (len(out) - 1), dtype=object)
        out["conv"] = pieces["conv"]
        return out[["key", "range", "conv", "choices", "ahead", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]]

    schema = (
        f"key string, range bigint, conv {conv}, choices string, ahead bigint, "
        "blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
    )
    decided = store(pieces.groupBy("key").applyInPandas(decide, schema).join(known, "key", "left"), "giant-choices")
    return dealt, decided


def _followed(dealt: DataFrame, decided: DataFrame, *keys: str) -> DataFrame:
    """Rows of giants in order, each range behind a row with its choices."""
    of_rows = dealt.where("present").select(
        "key", "conv", "range", "place", "turn", "role", "text", F.lit(0).cast("bigint").alias("ahead")
    )
    of_choices = decided.select(
        "key", "conv", "range", F.lit(-1).cast("bigint").alias("place"),
        F.lit(None).cast(dealt.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"),
        F.col("choices").alias("text"), "ahead",
    )
    both = of_rows.unionByName(of_choices)
    return both.repartition(partitions(both.sparkSession), *keys).sortWithinPartitions("key", "range", "place")


_FOLLOWED = ["key", "conv", "place", "turn", "role", "text", "ahead"]


def _stream_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(key, conv, place or None, choice, turn, role, text); a range begins with place None."""
    choices, at, place = "", 0, 0

    def inserted():
        nonlocal at, place
        while at < len(choices) and choices[at] in "ua":
            yield place, choices[at], None, FULL_NAME[choices[at]], ""
            at, place = at + 1, place + 1

    key = conv = None
    for batch in batches:
        for row in zip(*(batch.column(n).to_pylist() for n in _FOLLOWED), strict=True):
            if row[2] < 0:
                yield from ((key, conv, *r) for r in inserted())
                key, conv, choices, at, place = row[0], row[1], row[5], 0, row[6]
                yield key, conv, None, "", None, "", ""
                continue
            yield from ((key, conv, *r) for r in inserted())
            choice, at = choices[at], at + 1
            if choice != "D":
                yield key, conv, place, choice, row[3], row[4] if choice == "K" else FULL_NAME[choice.lower()], row[5]
                place += 1
    yield from ((key, conv, *r) for r in inserted())


def _giant_digests(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, Digest()
        for key, _, place, _, _, role, text in _stream_ranges(batches):
            if key != now:
                if now is not None:
                    yield _batch([(now, digest.sha.hexdigest())], schema)
                now, digest = key, Digest()
            if place is not None:
                digest.add(role, text)
        if now is not None:
            yield _batch([(now, digest.sha.hexdigest())], schema)

    return run


def _giant_rows(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for _, conv, place, choice, turn, role, text in _stream_ranges(batches):
            if place is None:
                continue
            out.append((conv, place, choice, turn, role, text))
            held += len(text) + 64
            if held > 1 << 22:
                yield _batch(out, schema)
                out, held = [], 0
        if out:
            yield _batch(out, schema)

    return run


def _split(rows, conv_col, turn_col, role_col, text_col, present_col, giant_bytes) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ordinary conversations, and those of giants where there are any."""
    rows = _prepared(rows, conv_col, turn_col, role_col, text_col, present_col)
    rows = rows.withColumn("fault", F.when(F.col("blank"), BLANK).when(F.col("truncated"), TRUNCATED).otherwise(SOUND))
    large = _large(rows, giant_bytes)
    if large.isEmpty():
        return rows, None
    return rows.join(large, "key", "left_anti"), rows.join(large, "key", "left_semi")


def repair_conversations(
    rows: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    present_col: str | None = None,
    giant_bytes: int = GIANT_BYTES,
) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    spark = rows.sparkSession
    conv = rows.schema[conv_col].dataType.simpleString()
    small, large = _split(rows, conv_col, turn_col, role_col, text_col, present_col, giant_bytes)
    ddl = f"conv_id {conv}, {_SUMMARY}, repaired_sha256 string"
    run = _in_memory(_arrow(spark, ddl), as_rows=False)
    out = _by_key(small.select(*_STREAMED), "turn", "role").mapInArrow(run, ddl)
    if large is None:
        return out
    dealt, decided = _giants(large)
    ddl = "key string, repaired_sha256 string"
    digests = _followed(dealt, decided, "key").select(*_FOLLOWED).mapInArrow(_giant_digests(_arrow(spark, ddl)), ddl)
    summary = decided.where("cost is not null").join(digests, "key")
    summary = summary.withColumn("gaps", F.coalesce("gaps", F.lit(0)))
    return out.unionByName(summary.select(F.col("conv").alias("conv_id"), *_SUMMARY_FIELDS, "repaired_sha256"))


def repaired_rows(
    rows: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    present_col: str | None = None,
    giant_bytes: int = GIANT_BYTES,
) -> DataFrame:
    """The repaired conversations: conv_id, place (0, 1, ...), edit, turn, role, text.

    ``edit`` is K (kept), U or A (another role), u or a (inserted, without a turn).
    """
    spark = rows.sparkSession
    conv, turn = (rows.schema[c].dataType.simpleString() for c in (conv_col, turn_col))
    small, large = _split(rows, conv_col, turn_col, role_col, text_col, present_col, giant_bytes)
    ddl = f"conv_id {conv}, " + _ROW.format(turn=turn)
    schema = _arrow(spark, ddl)
    out = _by_key(small.select(*_STREAMED), "turn", "role").mapInArrow(_in_memory(schema, as_rows=True), ddl)
    if large is None:
        return out
    followed = _followed(*_giants(large), "key", "range").select(*_FOLLOWED)
    return out.unionByName(followed.mapInArrow(_giant_rows(schema), ddl))
