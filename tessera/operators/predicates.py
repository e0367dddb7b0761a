"""Filters written as objects, such as {"lang": "en", "n_chars": {"$gte": 100}}, as one condition that file readers can take over."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _equal(c: Column, v) -> Column:
    return c.isNull() if v is None else c.isNotNull() & (c == F.lit(v))


def _within(c: Column, values) -> Column:
    """Membership; null is a member where the list names it."""
    values = list(values)
    some = [v for v in values if v is not None]
    found = c.isNotNull() & c.isin(some) if some else F.lit(False)
    return found | c.isNull() if len(some) < len(values) else found


def _order(compare: Callable[[Column, Column], Column]) -> Callable[[Column, object], Column]:
    def f(c: Column, v) -> Column:
        if v is None:
            raise ValueError("nothing is above or below null")
        return c.isNotNull() & compare(c, F.lit(v))

    return f


OPERATORS: dict[str, Callable[[Column, object], Column]] = {
    "$eq": _equal,
    "$ne": lambda c, v: c.isNotNull() if v is None else c.isNull() | (c != F.lit(v)),
    "$in": _within,
    "$nin": lambda c, v: ~_within(c, v) if None in v or not v else c.isNull() | ~c.isin(list(v)),
    "$gt": _order(lambda c, v: c > v), "$gte": _order(lambda c, v: c >= v), "$lt": _order(lambda c, v: c < v), "$lte": _order(lambda c, v: c <= v),
}
JOINED = {"$and": lambda a, b: a & b, "$or": lambda a, b: a | b}


def where_object(condition: dict) -> Column:
    """The condition as a column that is true or false, never null.

    {field: value} asks for equality, {field: {operator: value, ...}} for all of its operators; several fields must
    all fit, $and and $or join lists of such objects. A row without the value fits $ne and $nin, and null in $eq or
    $in; it fits no other operator. An empty object fits every row, an empty $in none; an empty $and or $or, an
    unknown operator and any other shape raise ValueError. The columns compare with literals as they are, so Parquet
    reads only what can fit.
    """
    if not isinstance(condition, dict):
        raise ValueError(f"a filter is an object, not {condition!r}")
    parts = []
    for name, value in condition.items():
        if name in JOINED:
            if not isinstance(value, list | tuple) or not value:
                raise ValueError(f"{name} takes a list of filters")
            parts.append(reduce(JOINED[name], map(where_object, value)))
        elif name.startswith("$"):
            raise ValueError(f"unknown operator {name}")
        elif isinstance(value, dict):
            if not value:
                raise ValueError(f"no operator for {name}")
            for op, v in value.items():
                if op not in OPERATORS:
                    raise ValueError(f"unknown operator {op}")
                if op in ("$in", "$nin") and not isinstance(v, list | tuple | set):
                    raise ValueError(f"{op} takes a list")
                parts.append(OPERATORS[op](F.col(name), v))
        elif isinstance(value, list | tuple | set):
            raise ValueError(f"{name}: a list needs $in or $nin")
        else:
            parts.append(_equal(F.col(name), value))
    return reduce(JOINED["$and"], parts) if parts else F.lit(True)
