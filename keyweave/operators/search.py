"""Search over keys or lines by mode, and edit-distance top-k.

Predicates are built-in expressions inside the scan; the two edit modes are one bounded top-k per
task. ``capacity`` is a limit, 0 is unlimited; a limited result of a predicate mode takes the first
matches in key (or line) order, so that it is the same on every run.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyweave.functions import strings as S
from keyweave.model import Status, StatusError
from keyweave.operators.point import KEY
from keyweave.operators.scan import MODES as RANGE_MODES
from keyweave.operators.scan import range_scan

_fold = str.maketrans(S.UPPER, S.LOWER)


def _any(c: Column, patterns: str, one: Callable[[Column, str], Column]) -> Column:
    cond = F.lit(False)
    for p in patterns.split("\n"):
        cond = cond | one(c, p)
    return cond


def _regex(c: Column, pattern: str) -> Column:
    java = S.java_regex(pattern)
    if java is None:
        raise StatusError(Status.INVALID_ARGUMENT, f"bad pattern: {pattern}")
    return c.rlike(java)


PREDICATES: dict[str, Callable[[Column, str], Column]] = {
    "contain": S.contains,
    "begin": S.begins_with,
    "end": S.ends_with,
    "regex": _regex,
    "containcase": lambda c, p: S.contains(S.lower_ascii(c), p.translate(_fold)),
    # A plain search is much faster than the pattern, and most keys fail it.
    "containword": lambda c, p: S.contains(c, p) & c.rlike(S.word_pattern([p])),
    "containcaseword": lambda c, p: S.contains(S.lower_ascii(c), p.translate(_fold)) & S.lower_ascii(c).rlike(S.word_pattern([p], True)),
    "contain*": lambda c, p: _any(c, p, S.contains),
    "containcase*": lambda c, p: _any(S.lower_ascii(c), p.translate(_fold), S.contains),
    "containword*": lambda c, p: _any(c, p, S.contains) & c.rlike(S.word_pattern(p.split("\n"))),
    "containcaseword*": lambda c, p: _any(S.lower_ascii(c), p.translate(_fold), S.contains) & S.lower_ascii(c).rlike(S.word_pattern(p.split("\n"), True)),
}
EDIT_MODES = {"edit": False, "editbin": True}


def search(df: DataFrame, mode: str, pattern: str, capacity: int = 0, key: str = KEY, order: str = "lexical") -> DataFrame:
    """Records whose key matches, by one of 17 modes.

    The edit modes order by distance, then key, and add ``distance``; with capacity 0 they rank all.
    An unknown mode or a bad pattern is an invalid argument. Null keys never match.
    """
    if mode in RANGE_MODES:
        return range_scan(df, mode, pattern, capacity, order, key)
    return _search(df, mode, pattern, capacity, key, [F.col(key)])


def search_text(lines: DataFrame, mode: str, pattern: str, capacity: int = 0, line: str = "line", line_no: str = "line_no") -> DataFrame:
    """Lines that match, by one of 13 modes (no ranges); limits keep the first lines."""
    if mode in RANGE_MODES:
        raise StatusError(Status.INVALID_ARGUMENT, f"no such mode: {mode}")
    return _search(lines, mode, pattern, capacity, line, [F.col(line_no)])


def _search(df: DataFrame, mode: str, pattern: str, capacity: int, col: str, order: list[Column]) -> DataFrame:
    c = F.col(col)
    if mode in EDIT_MODES:
        ranked = df.filter(c.isNotNull()).withColumn("distance", S.edit_distance(c, pattern, EDIT_MODES[mode])).orderBy("distance", c)
        return ranked.limit(capacity) if capacity else ranked
    if mode not in PREDICATES:
        raise StatusError(Status.INVALID_ARGUMENT, f"no such mode: {mode}")
    hits = df.filter(PREDICATES[mode](c, pattern))
    return hits.orderBy(*order).limit(capacity) if capacity else hits


def search_lambda(df: DataFrame, matcher: Callable[[pd.Series], pd.Series], capacity: int = 0, key: str = KEY) -> DataFrame:
    """User predicate on batches of keys; returns a boolean per key."""
    hits = df.filter(F.pandas_udf(matcher, "boolean")(F.col(key)))
    return hits.orderBy(key).limit(capacity) if capacity else hits


def to_lines(df: DataFrame, text: str, doc: str) -> DataFrame:
    """Lines of texts as a line table: ``doc, line_no, line`` (line feeds stripped)."""
    return df.select(F.col(doc), F.posexplode(F.split(F.regexp_replace(text, "\n$", ""), "\n", -1)).alias("line_no", "line"))
