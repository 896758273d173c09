"""Naming intermediate values, inside one expression or as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once for use in several places of `body`.

    A lambda over a one-element array does what a projection would, but inside an expression: the value is not
    copied into every use when filters are pushed down, and large rule expressions stay out of generated code,
    where they would make methods too long for the JIT compiler.
    """
    return F.get(F.transform(F.array(value), body), 0)


def staged(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that later steps use many times, evaluated once per row.

    Plain projections are merged and pushed-down filters copy their expressions; a generator is left alone.
    """
    kept = [c for c in rows.columns if c not in columns]
    return rows.select(*kept, F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))
