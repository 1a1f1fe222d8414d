"""Name a sub-expression once and use it many times.

Catalyst inlines a Column wherever it is mentioned, so an expression that uses an
intermediate result four times computes it four times (and nested ones multiply).
Binding it to a lambda variable keeps both the tree and the work linear.

Long expressions are written as Spark SQL text: the session parses one string where the
Column API would make a round trip to the JVM per operator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def let_sql(name: str, value: str, body: str) -> str:
    """SQL text of ``let``: ``body`` may mention ``name``."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def call_sql(body: str, **arguments: Column | str) -> Column:
    """Apply SQL text to columns; in ``body`` an argument ``a`` is written ``arg.a``."""
    packed = F.struct(
        *[(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in arguments.items()]
    )
    mapped = F.call_function("transform", F.array(packed), F.expr(f"arg -> {body}"))
    return F.get(mapped, F.lit(0))


def text(value: str) -> str:
    """A SQL string literal for any text (patterns included)."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def first_per_key(entries: Column, key: str) -> Column:
    """Keep the first array element per ``key`` (elements sort by key, then position).

    ``entries`` is an array of structs whose first two fields are the key and the position.
    Sorting and comparing neighbours costs O(n log n) inside one row and needs no shuffle.
    """
    def is_first(s: Column) -> Callable[[Column, Column], Column]:
        return lambda x, i: (i == 0) | ~x[key].eqNullSafe(F.get(s, i - F.lit(1))[key])

    return let(F.sort_array(entries), lambda s: F.filter(s, is_first(s)))


def compact(items: Column) -> Column:
    """Drop NULL elements."""
    return F.filter(items, lambda x: x.isNotNull())


def explode_rows(df: DataFrame, array: Column | str, item: str, *keep: str | Column,
                 pos: str | None = None) -> DataFrame:
    """One row per element of an array column.

    An inner ``explode`` makes Spark test the array's size first, in a filter it pushes below
    the projection that builds the array, so the array would be computed twice. The outer
    form with a test of the element afterwards computes it once.
    """
    made = F.posexplode_outer(array).alias(pos or "_pos", item)
    out = df.select(*keep, made).where(F.col(item).isNotNull())
    return out if pos else out.drop("_pos")
