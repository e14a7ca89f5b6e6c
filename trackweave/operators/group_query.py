"""Queries over request groups: conditions on records, combined by and, or and not, answered in one pass.

A condition holds for a group if any of its records meets it. `record("VCL_Log", "~", "^track ")` compares whole
payloads; `record("Timestamp", ">", 0.5, prefix="Resp", field=2)` the second blank-divided field of
those that begin with `Resp:`. Conditions combine with `&`, `|` and `~`. However many there are, each is a
flag of the same grouping, so the log is shuffled once and never joined with itself.

Defined results: a null payload meets no comparison; a field that is absent, or is no number where numbers
are compared, meets none either; records without a group are in no group and are left out.
"""

from __future__ import annotations

import operator
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_NUMBERS = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
_TEXTS: dict[str, Callable[[Column, str], Column]] = {"~": lambda c, x: c.rlike(x), "!~": lambda c, x: ~c.rlike(x), "eq": lambda c, x: c == x, "ne": lambda c, x: c != x}


@dataclass(frozen=True)
class Query:
    """Conditions on records, made into columns when the query is applied, and how their flags make the truth of a group."""

    conditions: tuple[Callable[[], Column], ...]
    truth: Callable[[list[Column]], Column] = field(repr=False)

    def _with(self, other: Query, how: Callable[[Column, Column], Column]) -> Query:
        n = len(self.conditions)
        return Query(self.conditions + other.conditions, lambda flags: how(self.truth(flags[:n]), other.truth(flags[n:])))

    def __and__(self, other: Query) -> Query:
        return self._with(other, operator.and_)

    def __or__(self, other: Query) -> Query:
        return self._with(other, operator.or_)

    def __invert__(self) -> Query:
        return Query(self.conditions, lambda flags: ~self.truth(flags))


def record(tag: str, compare: str | None = None, value: str | float | None = None, prefix: str | None = None, field: int | None = None, side: str | None = None) -> Query:
    """A group has a record of the tag (in any case of letters) whose payload, or field of it, compares so; without a comparison, has one at all."""
    if compare is not None and compare not in _NUMBERS | _TEXTS:
        raise ValueError(f"no such comparison: {compare}")

    def condition() -> Column:
        holds, text = F.lower("tag") == tag.lower(), F.col("payload")
        if side is not None:
            holds = holds & (F.col("side") == side)
        if prefix is not None:
            holds = holds & F.startswith(F.lower("payload"), F.lit(f"{prefix.lower()}:"))
            text = F.ltrim(F.expr(f"substring(payload, {len(prefix) + 2})"))
        if field is not None:
            text = F.get(F.split(F.trim(text), r"\s+"), F.lit(field - 1))
        if compare in _NUMBERS:
            holds = holds & _NUMBERS[compare](text.try_cast("double"), F.lit(float(value)))
        elif compare is not None:
            holds = holds & _TEXTS[compare](text, value)
        elif field is not None:
            holds = holds & text.isNotNull()
        return F.coalesce(holds, F.lit(False))

    return Query((condition,), lambda flags: flags[0])


def _names(queries: list[Query]) -> list[list[str]]:
    names, at = [], 0
    for q in queries:
        names.append([f"_flag{at + i}" for i in range(len(q.conditions))])
        at += len(q.conditions)
    return names


def filter_groups(log: DataFrame, query: Query) -> DataFrame:
    """All records of the groups for which the query is true."""
    group = Window.partitionBy("group_vxid")
    flags = _names([query])[0]
    marked = log.where("group_vxid is not null").withColumns({n: F.max(c()).over(group) for n, c in zip(flags, query.conditions, strict=True)})
    return marked.where(query.truth([F.col(n) for n in flags])).select(*log.columns)


def match_groups(log: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """One row per group: group_vxid, and for each named query whether it is true."""
    names = _names(list(queries.values()))
    flags = [F.bool_or(c()).alias(n) for own, q in zip(names, queries.values(), strict=True) for n, c in zip(own, q.conditions, strict=True)]
    rows = log.where("group_vxid is not null").groupBy("group_vxid").agg(*flags)
    return rows.select("group_vxid", *[q.truth([F.col(n) for n in own]).alias(name) for (name, q), own in zip(queries.items(), names, strict=True)])
