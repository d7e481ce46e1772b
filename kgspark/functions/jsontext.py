"""Getting usable JSON out of model answers."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns of the repair steps and of the key/value fallback.
CODE_FENCE = r"```[a-zA-Z]*\n?"
OUTER_OBJECT = r"(?s)\{.*\}"
KEY_VALUE = r'"([^"]+)":\s*([^\n,}]+)'

MAP_TYPE = "map<string,string>"


def object_substring(c: Column) -> Column:
    """From the first opening to the last closing brace; null when there is none."""
    return F.nullif(F.regexp_extract(c, OUTER_OBJECT, 0), F.lit(""))


def single_object(c: Column) -> Column:
    """The object when the text has exactly one opening and one closing brace."""
    one = (F.regexp_count(c, F.lit(r"\{")) == 1) & (F.regexp_count(c, F.lit(r"\}")) == 1)
    return F.when(one, F.nullif(F.regexp_extract(c, r"\{[^}]*\}", 0), F.lit("")))


def first_flat_object(c: Column) -> Column:
    """From the first opening brace to the first closing brace after it."""
    return F.nullif(F.regexp_extract(c, r"\{[^}]*\}", 0), F.lit(""))


def last_flat_object(c: Column) -> Column:
    """From the last opening brace to the last closing brace."""
    return F.nullif(F.regexp_extract(c, r"(?s)\{[^{]*\}(?=[^{}]*$)", 0), F.lit(""))


def _balanced_spans(text: str) -> list[tuple[int, int]]:
    """Outermost balanced brace spans, left to right."""
    open_at: list[int] = []
    spans: list[tuple[int, int]] = []
    for m in re.finditer(r"[{}]", text):
        if m.group() == "{":
            open_at.append(m.start())
        elif open_at:
            start = open_at.pop()
            while spans and spans[-1][0] > start:
                spans.pop()
            spans.append((start, m.end()))
    return spans


@F.pandas_udf(T.StructType([T.StructField("first_object", T.StringType()), T.StructField("last_object", T.StringType())]))
def balanced(texts: pd.Series) -> pd.DataFrame:
    """First and last balanced JSON object of a text, from one look at its braces."""
    found = [(t, _balanced_spans(t)) if t is not None else (t, []) for t in texts]
    ends = [(t[slice(*s[0])], t[slice(*s[-1])]) if s else (None, None) for t, s in found]
    return pd.DataFrame(ends, columns=["first_object", "last_object"], dtype=object)


_PIECE = re.compile(r'"(?:[^"\\]|\\.)*"|[\[\]{},]|[^"\[\]{},]+|"', re.S)
_CLOSER = {"{": "}", "[": "]"}
_OPENER = {c: o for o, c in _CLOSER.items()}


def mend_object(text: str | None) -> str | None:
    """The first object of a text, well nested; null without an opening brace.

    One pass with a stack of open brackets. A closing bracket first closes what
    was opened inside and left open, at any depth, and one that closes nothing
    is dropped; so is a comma before a closing bracket. At the end of the text
    all open brackets are closed. Line breaks become blanks.
    """
    if text is None:
        return None
    text = re.sub(CODE_FENCE, "", text)
    begin = text.find("{")
    if begin < 0:
        return None
    out: list[str] = []
    still_open: list[str] = []

    def close(kind: str) -> None:
        while out and (out[-1] == "," or out[-1].isspace()):
            out.pop()
        out.append(_CLOSER[kind])

    for m in _PIECE.finditer(text, begin):
        piece = m[0]
        if piece in _CLOSER:
            still_open.append(piece)
            out.append(piece)
        elif piece in _OPENER:
            if _OPENER[piece] in still_open:
                inner = None
                while inner != _OPENER[piece]:
                    inner = still_open.pop()
                    close(inner)
            if not still_open:
                break
        else:
            out.append(piece)
    for kind in reversed(still_open):
        close(kind)
    return re.sub(r"[\r\n]+", " ", "".join(out)).strip()


@F.pandas_udf(T.StringType())
def repair(texts: pd.Series) -> pd.Series:
    """``mend_object`` of every text."""
    return texts.map(mend_object)


def is_json(c: Column) -> Column:
    """The text parses; repeated keys are allowed."""
    return F.get_json_object(c, "$").isNotNull()


def parse(c: Column, schema: str) -> Column:
    """Struct or map from object text; null when it does not parse as an object."""
    return F.when(is_json(c) & F.startswith(F.trim(c), F.lit("{")), F.from_json(c, schema))


def latest_keys(c: Column) -> Column:
    """Key → text map of an object; the last of equal keys wins.

    Text that is not valid JSON is read pair by pair.
    """
    keys = F.transform(F.regexp_extract_all(c, F.lit(KEY_VALUE), F.lit(1)), lambda k: F.trim(k))
    values = F.transform(
        F.regexp_extract_all(c, F.lit(KEY_VALUE), F.lit(2)), lambda v: F.regexp_replace(F.trim(v), '^"|"$', "")
    )
    pairs = F.map_from_arrays(keys, values)
    # a parsed map may hold a key twice; built anew, the session's LAST_WIN policy keeps the last
    parsed = F.map_from_entries(F.map_entries(F.from_json(c, MAP_TYPE)))
    return F.coalesce(F.when(is_json(c), parsed), pairs)


def typed(value: Column, dtype: str) -> Column:
    """A map value read as the type its feature asks for."""
    if dtype == "boolean":
        return F.lower(value).try_cast("boolean")
    if dtype == "numerical":
        return value.try_cast("double")
    return value


def pick_keys(m: Column, keys: Column) -> Column:
    return F.map_filter(m, lambda k, v: F.array_contains(keys, k))


REPORT_SCHEMA = (
    "title string, summary string, rating double, rating_explanation string, "
    "findings array<struct<summary:string,explanation:string>>"
)


def report_is_valid(c: Column) -> Column:
    """All five report fields are there, with their types."""
    r = parse(c, REPORT_SCHEMA)
    fields = [r["title"], r["summary"], r["rating"], r["rating_explanation"], r["findings"]]
    ok = fields[0].isNotNull()
    for f in fields[1:]:
        ok = ok & f.isNotNull()
    return F.coalesce(ok, F.lit(False))


def feature_list(c: Column, prefix: str = "Augmented_") -> Column:
    """Array from the text of a Python list: prefix dropped, lower case."""
    items = F.from_json(F.replace(c, F.lit("'"), F.lit('"')), "array<string>")
    return F.transform(items, lambda x: F.lower(F.replace(x, F.lit(prefix), F.lit(""))))


def parse_range(c: Column) -> tuple[Column, Column]:
    """Low and high number of a "lo-hi" text, thousands commas allowed."""
    plain = F.replace(c, F.lit(","), F.lit(""))
    number = r"(-?\d+(?:\.\d+)?)\s*(?:-|to)\s*(-?\d+(?:\.\d+)?)"
    low = F.regexp_extract(plain, number, 1).try_cast("double")
    high = F.regexp_extract(plain, number, 2).try_cast("double")
    return low, high


def explode_map(df: DataFrame, column: str, key: str, value: str) -> DataFrame:
    return df.select("*", F.explode(column).alias(key, value)).drop(column)
