"""Repair of JSON that a model's output broke off: first balanced object, or the rest closed."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def repair_json(raw: str | None) -> str | None:
    """The first object in a text as valid JSON; null if there is none.

    Scans once with a stack of open brackets, noting the places where the text could end: before a
    comma and after an opening bracket. Where it ends early, an open string is closed and the
    brackets in turn; if that leaves a dangling key or colon, the last place that gives valid JSON ends it."""
    if raw is None or (start := raw.find("{")) < 0:
        return None
    stack: list[str] = []
    places: list[tuple[int, str]] = []  # end, closing brackets
    quoted = escaped = False
    text = raw[start:]
    for k, c in enumerate(text):
        if quoted:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
            places.append((k + 1, "".join(reversed(stack))))
        elif c == ",":
            places.append((k, "".join(reversed(stack))))
        elif c in "}]":
            if not stack or stack.pop() != c:
                return None
            if not stack:
                return text[: k + 1] if _valid(text[: k + 1]) else None
    closers = "".join(reversed(stack))
    body = (text[:-1] if escaped else text) + ('"' if quoted else "")
    tries = [body + closers, body.rstrip(",: \n\t") + closers]
    return next((t for t in tries if _valid(t)), None) or next((t for end, close in reversed(places) if _valid(t := text[:end] + close)), None)


def _valid(text: str) -> bool:
    try:
        return isinstance(json.loads(text), dict)
    except ValueError:
        return False


def repaired(column: Column) -> Column:
    """Text as is where it parses; only what does not goes through Python, in Arrow batches."""

    @F.pandas_udf("string")
    def fix(texts: pd.Series) -> pd.Series:
        return texts.map(repair_json, na_action="ignore")

    return F.coalesce(F.when(F.try_parse_json(column).isNotNull(), column), fix(F.when(F.try_parse_json(column).isNull(), column)))
