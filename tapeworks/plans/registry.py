"""The registered queries, each next to an independent SQL statement of the same question."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tapeworks.functions.scan import Cuts, order_cuts
from tapeworks.plans.views_sql import VIEWS
from tapeworks.session import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_SHARED: dict[tuple[str, str, str], DataFrame] = {}


def expand_snap(text: str) -> str:
    """Expand snap(x, d): round to d places after a tiny shift.

    Sums of finite decimals often lie exactly on a rounding border, where the last bit of a
    double would decide; the shift moves the border away from them, alike in both engines.
    """
    while (start := text.find("snap(")) >= 0:
        depth, comma, i = 0, None, start + 4
        while True:
            c = text[i]
            depth += (c == "(") - (c == ")")
            if c == "," and depth == 1:
                comma = i
            if depth == 0:
                break
            i += 1
        x, d = text[start + 5:comma], int(text[comma + 1:i])
        text = f"{text[:start]}round(({x}) + 1.23e-{d + 2}, {d}){text[i + 1:]}"
    return text


def pick(df: DataFrame, *exprs: str) -> DataFrame:
    return df.selectExpr(*[expand_snap(e) for e in exprs])


def with_views(body: str) -> str:
    """Prefix the statement with the view definitions it refers to, in order."""
    needed: set[str] = set()
    todo = [body]
    while todo:
        text = todo.pop()
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                todo.append(VIEWS[name])
    parts = [f"{n} AS ({VIEWS[n]})" for n in VIEWS if n in needed]
    head = "WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else ""
    return expand_snap(head + body.strip())


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn
    return add


def shared(spark: SparkSession, sf: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A frame several queries read, written once per application and input folder."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _SHARED:
        _SHARED[key] = materialize(build(), name)
    return _SHARED[key]


_CUTS: dict[tuple[str, str], Cuts] = {}


def time_cuts(spark: SparkSession, sf: str, base: Callable[[], DataFrame], order: list[str]) -> Cuts:
    """Cuts of the event-time axis of a folder, taken once: all scans in event-time order share
    them, as any cuts give the same result and all their inputs come from the same events."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _CUTS:
        _CUTS[key] = order_cuts(base(), order)
    return _CUTS[key]


def forget_shared() -> None:
    _SHARED.clear()
    _CUTS.clear()
