"""Commutative monoids as pairs of Spark aggregates.

A monoid lifts a value to partial columns with aggregates, merges partial columns with
aggregates, and finishes to one column.  Lifting any split of the rows and merging
in any order gives what one pass over all rows gives, so a table may be kept as
partial results of micro-batches and merged when read.  All parts are built-in
aggregates with map-side combine.

Nulls: a null value is not combined (Count counts rows, whatever the value).  A key all of
whose values are null has a null result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

Aggregate = Callable[[Column], Column]


@dataclass(frozen=True)
class Monoid:
    """parts: (suffix, lift, merge) of each partial column; finish: from the columns by suffix."""

    name: str
    parts: tuple[tuple[str, Aggregate, Aggregate], ...]
    finish: Callable[[dict[str, Column]], Column]

    def lifted(self, value: Column) -> list[Column]:
        return [lift(value).alias(s) for s, lift, _ in self.parts]

    def merged(self) -> list[Column]:
        return [merge(F.col(s)).alias(s) for s, _, merge in self.parts]

    def result(self) -> Column:
        return self.finish({s: F.col(s) for s, _, _ in self.parts})

    @property
    def columns(self) -> list[str]:
        return [s for s, _, _ in self.parts]


def _plain(name: str, lift: Aggregate, merge: Aggregate) -> Monoid:
    return Monoid(name, (("_v", lift, merge),), lambda c: c["_v"])


def wrapped(total: Column, width: int, signed: bool = True) -> Column:
    """A whole number reduced to a fixed width in two's complement."""
    size = F.lit(Decimal(1 << width)).cast("decimal(38,0)")
    low = F.pmod(total.cast("decimal(38,0)"), size)
    if signed:
        low = F.when(low >= F.lit(Decimal(1 << (width - 1))).cast("decimal(38,0)"), low - size).otherwise(low)
    return low.cast("bigint" if signed or width < 64 else "decimal(20,0)")


def Sum(width: int = 64, wrap: bool = False, signed: bool = True) -> Monoid:
    """A whole-number sum: an error beyond 64 bits, or with `wrap` modular in `width` bits."""
    if wrap:
        return Monoid(f"sum{width}", (("_v", lambda v: F.sum(v.cast("decimal(20,0)")).cast("decimal(38,0)"), lambda v: F.sum(v).cast("decimal(38,0)")),), lambda c: wrapped(c["_v"], width, signed))
    return _plain("sum", lambda v: F.sum(v.cast("bigint")), F.sum)


Count = _plain("count", lambda _: F.count(F.lit(1)), F.sum)
Min = _plain("min", F.min, F.min)
Max = _plain("max", F.max, F.max)
All = _plain("all", F.bool_and, F.bool_and)
Any = _plain("any", F.bool_or, F.bool_or)
Product = _plain("product", F.product, F.product)
Mean = Monoid("mean", (("_s", lambda v: F.sum(v.cast("double")), F.sum), ("_n", F.count, F.sum)), lambda c: F.when(c["_n"] > 0, c["_s"] / c["_n"]))


def Pairwise(*fields: str) -> Monoid:
    """Sums of the fields of a struct, as latency statistics have them."""
    parts = tuple((f"_{f}", (lambda f: lambda v: F.sum(v[f]))(f), F.sum) for f in fields)
    return Monoid("pairwise", parts, lambda c: F.struct(*(c[f"_{f}"].alias(f) for f in fields)))


def Tuple(**members: Monoid) -> Monoid:
    """The product of monoids: each takes the field of its name from a struct and gives a field of the result."""
    parts = tuple((f"_{n}{s}", (lambda n, lift: lambda v: lift(v[n]))(n, lift), merge) for n, m in members.items() for s, lift, merge in m.parts)
    return Monoid("tuple", parts, lambda c: F.struct(*(m.finish({s: c[f"_{n}{s}"] for s in m.columns}).alias(n) for n, m in members.items())))
