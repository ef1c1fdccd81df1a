"""Equal-sized global tiles (NTILE over the whole table) without a single-task sort.

``ntile`` over a window without PARTITION BY moves every row into one task. Tiles need
less than a full ranking: only the last row of each tile. These cut rows are found for all
scores together, in three passes over the table: one sample of whole rows proposes an interval
around each wanted rank; one aggregate counts exactly how many rows lie before and inside each; the
rows inside, a few percent, are ranked and the cuts read off. The tile of a row is then a
comparison with the cuts: no shuffle at all. The sample only steers the search; every rank is
decided by exact counts. It is a sample of rows and not a sketch of values, as one value may be
shared by most rows, and only the tie-break tells these apart.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vendastat.operators.ranks import global_places
from vendastat.session import materialize, scan_bytes

# Up to this much input, a plain window in one task is cheaper than several passes.
PLAIN_WINDOW_BYTES = 256 * 1024 * 1024
# Rows drawn; an interval no longer than this is sorted in one task, longer ones by ranges.
SAMPLE_ROWS = 50_000
# With fewer, the margin around the wanted rank would span the whole sample.
MIN_SAMPLE_ROWS = 30
_HASH_RANGE = 1 << 40


@dataclass
class _Cut:
    """A wanted row: number ``rank`` of an order; lies in ``(low, high]``, after ``before`` rows."""

    order: str
    rank: int
    size: int
    before: int = 0
    low: Row | None = None
    high: Row | None = None


class _Order:
    """A total order over a table as one comparable struct column.

    Unknown values come last for ascending and first for descending order, NaN is larger than
    any number, and the unique tie-break makes all keys different, so that even a value shared
    by most rows can be cut. The order is that of a plain window. Whole numbers are turned
    round as decimals, as the smallest bigint has no opposite.
    """

    def __init__(self, df: DataFrame, column: str, direction: str, tie_break: str):
        value, kind = F.col(column), df.schema[column].dataType
        unknown, nan = value.isNull(), F.lit(False)
        if isinstance(kind, T.IntegralType):
            value = value.cast("decimal(20,0)")
        elif isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
            nan = F.coalesce(F.isnan(value), F.lit(False))
            value = F.when(nan, 0.0).otherwise(value)
        if direction != "asc":
            value, unknown, nan = -value, ~unknown, ~nan
        dtype = df.select(value.alias("v")).schema["v"].dataType
        self.key = F.struct(
            unknown.alias("u"),
            nan.alias("n"),
            F.coalesce(value, F.lit(0).cast(dtype)).cast(dtype).alias("v"),
            F.col(tie_break).alias("k"),
        )
        self.type: T.StructType = df.select(self.key.alias("key")).schema["key"].dataType

    def literal(self, row: Row) -> Column:
        return F.struct(*[F.lit(row[f.name]).cast(f.dataType).alias(f.name) for f in self.type.fields])

    def inside(self, cut: _Cut) -> Column:
        test = F.lit(True)
        if cut.low is not None:
            test = test & (self.key > self.literal(cut.low))
        if cut.high is not None:
            test = test & (self.key <= self.literal(cut.high))
        return test


def _one_pass(df: DataFrame) -> list[Row]:
    """The few rows of a result that reads the table once."""
    return df.collect()


def _propose(df: DataFrame, orders: dict[str, _Order], cuts: list[_Cut], tie_break: str, n: int, sample_rows: int) -> None:
    """Give every cut two sampled keys expected to lie on either side of it; one sample for all."""
    ticket = F.pmod(F.xxhash64(F.col(tie_break), F.lit(0)), F.lit(_HASH_RANGE))
    drawn = df.where(ticket < F.lit(min(_HASH_RANGE, math.ceil(sample_rows / n * _HASH_RANGE))))
    sample = drawn.agg(*[F.sort_array(F.collect_list(o.key)).alias(name) for name, o in orders.items()])
    bounds = []
    for i, cut in enumerate(cuts):
        keys = F.col(cut.order)
        margin = F.sqrt(F.size(keys).cast("double")) * 2 + 1
        at = F.lit(cut.rank / n) * F.size(keys)
        low, high = F.floor(at - margin).cast("int"), F.ceil(at + margin).cast("int")
        bounds.append(F.when(low >= 1, F.try_element_at(keys, F.greatest(low, F.lit(1)))).alias(f"low{i}"))
        bounds.append(F.try_element_at(keys, F.greatest(high, F.lit(1))).alias(f"high{i}"))
    found = _one_pass(sample.select(*bounds))[0]
    for i, cut in enumerate(cuts):
        cut.low, cut.high = found[f"low{i}"], found[f"high{i}"]


def _narrow(df: DataFrame, orders: dict[str, _Order], cuts: list[_Cut]) -> None:
    """Count the rows up to each proposed key, all in one pass, and keep the part that holds the rank."""
    counts = []
    for i, cut in enumerate(cuts):
        order = orders[cut.order]
        for side, bound in (("low", cut.low), ("high", cut.high)):
            if bound is not None:
                counts.append(F.count_if(order.key <= order.literal(bound)).alias(f"{side}{i}"))
    found = _one_pass(df.agg(*counts))[0].asDict() if counts else {}
    for i, cut in enumerate(cuts):
        below, upto = found.get(f"low{i}", 0), found.get(f"high{i}", cut.size)
        if cut.rank <= below:
            cut.low, cut.high, cut.before, cut.size = None, cut.low, 0, below
        elif cut.rank <= upto:
            cut.before, cut.size = below, upto - below
        else:
            cut.low, cut.high, cut.before, cut.size = cut.high, None, upto, cut.size - upto


def _read_off(df: DataFrame, orders: dict[str, _Order], cuts: list[_Cut], sample_rows: int) -> list[Row]:
    """The wanted rows from those inside the intervals, which are read in one pass."""
    tests = [orders[c.order].inside(c) for c in cuts]
    numbers = F.array_compact(F.array(*[F.when(t, F.lit(i)) for i, t in enumerate(tests)]))
    held = df.where(reduce(Column.__or__, tests)).withColumn("_cut", F.explode(numbers))
    names = list(orders)
    owner = F.array(*[F.lit(names.index(c.order)) for c in cuts])
    # A column per order, of which a row has the one of its cut, as their types differ.
    mine = F.element_at(owner, F.col("_cut") + 1)
    keys = [F.when(mine == k, o.key).alias(name) for k, (name, o) in enumerate(orders.items())]
    held = held.select("_cut", *keys)
    if all(c.size <= sample_rows for c in cuts):
        wanted = F.element_at(F.array(*[F.lit(c.rank - c.before) for c in cuts]), F.col("_cut") + 1)
        sorted_keys = F.sort_array(F.collect_list(F.struct(*names))).alias("keys")
        picked = held.groupBy("_cut").agg(sorted_keys).select(
            "_cut", F.try_element_at("keys", wanted).alias("key"), F.try_element_at("keys", wanted + 1).alias("next")
        )
        rows = {r["_cut"]: (r["key"], r["next"]) for r in _one_pass(picked)}
    else:
        start, places = 0, {}
        for i, cut in enumerate(cuts):
            places[start + cut.rank - cut.before] = i
            start += cut.size
        placed = global_places(held, [F.col("_cut"), *map(F.col, names)], "_place")
        near = placed.where(F.col("_place").isin([p + d for p in places for d in (0, 1)]))
        found = {r["_place"]: r for r in _one_pass(near)}
        rows = {i: (found[p], found.get(p + 1)) for p, i in places.items()}
        rows = {i: (key, after if after and after["_cut"] == i else None) for i, (key, after) in rows.items()}
    out = []
    for i, cut in enumerate(cuts):
        key, after = rows[i]
        if after is not None and key[cut.order] == after[cut.order]:
            raise ValueError("the tie-break column must be unique")
        out.append(key[cut.order])
    return out


def cut_rows(
    df: DataFrame, orders: dict[str, _Order], ranks: list[int], n: int, tie_break: str, sample_rows: int
) -> dict[str, list[Row]]:
    """For each order, its rows at the given ranks (from 1)."""
    cuts = [_Cut(name, rank, n) for name in orders for rank in ranks]
    if n > sample_rows:
        _propose(df, orders, cuts, tie_break, n, sample_rows)
        _narrow(df, orders, cuts)
    found = iter(_read_off(df, orders, cuts, sample_rows)) if cuts else iter(())
    return {name: [next(found) for _ in ranks] for name in orders}


def last_ranks(n: int, tiles: int) -> list[int]:
    """Rank of the last row of every tile but the last; the first tiles take the extra rows."""
    size, extra = divmod(n, tiles)
    return [rank for t in range(1, tiles) if 0 < (rank := t * size + min(t, extra)) < n]


def global_ntile(
    df: DataFrame,
    scores: dict[str, tuple[str, str]],
    tie_break: str,
    tiles: int = 5,
    distributed: bool | None = None,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """``df`` plus one tile number per score.

    ``scores`` maps a new column to (numeric column, "asc" or "desc"); ``tie_break`` must be
    unique. The distributed form, chosen by input size unless ``distributed`` says so, writes
    ``df`` once to the shared folder, because it is read in several passes.
    """
    if sample_rows < MIN_SAMPLE_ROWS:
        raise ValueError(f"sample_rows must be at least {MIN_SAMPLE_ROWS}")
    if distributed is None:
        distributed = scan_bytes(df) > PLAIN_WINDOW_BYTES
    if not distributed:
        one_task = {}
        for name, (column, direction) in scores.items():
            first = F.asc_nulls_last(column) if direction == "asc" else F.desc_nulls_first(column)
            one_task[name] = F.ntile(tiles).over(Window.orderBy(first, tie_break))
        return df.withColumns(one_task)

    df = materialize(df, "tiles")
    n = df.count()  # from the footers of the files
    orders = {name: _Order(df, *score, tie_break) for name, score in scores.items()}
    cuts = cut_rows(df, orders, last_ranks(n, tiles), n, tie_break, sample_rows)
    columns = {}
    for name, order in orders.items():
        above = [F.when(order.key > order.literal(cut), 1).otherwise(0) for cut in cuts[name]]
        columns[name] = reduce(Column.__add__, above, F.lit(1))
    return df.withColumns(columns)
