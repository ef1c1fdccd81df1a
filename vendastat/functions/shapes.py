"""Declared shapes of JSON values, and the column expressions that check them.

A shape is a tree of fields, lists and plain values. ``broken_rules`` walks it once and gives a
single expression, so that every value of a column is checked by built-in functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Text:
    """A text, one of some if these are named."""

    one_of: tuple[str, ...] = ()


@dataclass(frozen=True)
class Whole:
    """A whole number, one of some if these are named."""

    one_of: tuple[int, ...] = ()


@dataclass(frozen=True)
class Items:
    """A list with a number of items, all of one shape."""

    of: Shape
    least: int = 0
    most: int | None = None


class Fields:
    """An object with exactly these fields."""

    def __init__(self, **fields: Shape):
        self.fields = fields


Shape = Text | Whole | Items | Fields

# How Spark describes the types of JSON values.
_TEXT, _WHOLE, _LIST, _OBJECT = "STRING", "BIGINT", "ARRAY", "OBJECT"


def broken_rules(value: Column, shape: Shape) -> Column:
    """What breaks ``shape`` in a VARIANT value, as an array of ``path: what`` in order of the shape.

    Paths begin with ``$``, items count from 0. What is wrong is one of ``malformed`` (no value),
    ``missing`` or ``extra`` (a field), ``type``, ``value`` (not one of those named) and ``size``
    (number of items). A value of the wrong type is looked at no further.
    """
    return F.when(value.isNull(), F.array(F.lit("$: malformed"))).otherwise(_broken(value, shape, F.lit("$")))


def _fault(path: Column, what: str) -> Column:
    return F.concat(path, F.lit(f": {what}"))


def _given(condition: Column, path: Column, what: str) -> Column:
    none = F.array().cast("array<string>")
    return F.when(F.coalesce(condition, F.lit(True)), F.array(_fault(path, what))).otherwise(none)


def _broken(value: Column, shape: Shape, path: Column) -> Column:
    kind = F.schema_of_variant(value)
    if isinstance(shape, Fields):
        return F.when(~kind.startswith(_OBJECT), F.array(_fault(path, "type"))).otherwise(_in_object(value, shape, path))
    if isinstance(shape, Items):
        return F.when(~kind.startswith(_LIST), F.array(_fault(path, "type"))).otherwise(_in_list(value, shape, path))
    wanted, read = (_TEXT, "string") if isinstance(shape, Text) else (_WHOLE, "bigint")
    wrong = _given(~F.try_variant_get(value, "$", read).isin(*shape.one_of), path, "value") if shape.one_of else None
    typed = F.when(kind != wanted, F.array(_fault(path, "type")))
    return typed.otherwise(F.array().cast("array<string>") if wrong is None else wrong)


def _in_object(value: Column, shape: Fields, path: Column) -> Column:
    held = F.try_variant_get(value, "$", "map<string,variant>")
    parts = []
    for name, inner in shape.fields.items():
        here = F.concat(path, F.lit(f".{name}"))
        # A field that is there with null is not missing, but of another type than any named.
        found = F.element_at(held, F.lit(name))
        there = F.map_contains_key(held, F.lit(name))
        parts.append(F.when(there, _broken(F.coalesce(found, F.parse_json(F.lit("null"))), inner, here)).otherwise(
            F.array(_fault(here, "missing"))
        ))
    known = F.array(*[F.lit(n) for n in shape.fields])
    extra = F.sort_array(F.array_except(F.map_keys(held), known))
    parts.append(F.transform(extra, lambda k: F.concat(path, F.lit("."), k, F.lit(": extra"))))
    return F.concat(*parts)


def _in_list(value: Column, shape: Items, path: Column) -> Column:
    items = F.try_variant_get(value, "$", "array<variant>")
    n = F.size(items)
    outside = n < shape.least if shape.most is None else ~n.between(shape.least, shape.most)

    def item(x: Column, i: Column) -> Column:
        here = F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))
        return _broken(F.coalesce(x, F.parse_json(F.lit("null"))), shape.of, here)

    return F.concat(_given(outside, path, "size"), F.flatten(F.transform(items, item)))
