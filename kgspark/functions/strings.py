"""Text clean-up and rendering, all as column expressions."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The HTML entities unescaped without Python, and the control characters dropped.
COMMON_ENTITIES = {
    "&lt;": "<",
    "&gt;": ">",
    "&quot;": '"',
    "&#39;": "'",
    "&nbsp;": " ",
    "&amp;": "&",
}
CONTROL_CHARACTERS = r"[\x00-\x1f\x7f-\x9f]"
# Citations of report numbers inside an answer.
REPORT_CITATION = r"\[Data: Reports \(.*?\)\]"


def unescape_common(c: Column) -> Column:
    """Unescape the frequent entities; the ampersand comes last so nothing is unescaped twice."""
    return reduce(lambda acc, kv: F.replace(acc, F.lit(kv[0]), F.lit(kv[1])), COMMON_ENTITIES.items(), c)


@F.pandas_udf(T.StringType())
def unescape_all(texts: pd.Series) -> pd.Series:
    """Unescape every named and numeric HTML entity."""
    return texts.map(lambda t: None if t is None else html.unescape(t))


def unescape(c: Column) -> Column:
    """Every entity unescaped; a text without an ampersand is passed on as null and taken as it is."""
    marked = F.when(F.contains(c, F.lit("&")), c)
    return F.coalesce(unescape_all(marked), c)


@F.pandas_udf(T.StringType())
def compose(texts: pd.Series) -> pd.Series:
    """Unicode NFC form."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def clean_str(c: Column, all_entities: bool = True) -> Column:
    """Trim, unescape, drop control characters. Rows without an ampersand skip the full table of entities."""
    trimmed = F.regexp_replace(c, r"^\s+|\s+$", "")
    plain = unescape(trimmed) if all_entities else unescape_common(trimmed)
    return F.regexp_replace(plain, CONTROL_CHARACTERS, "")


def normalize_name(c: Column) -> Column:
    """Upper case, trimmed, unescaped: the form in which node names are compared."""
    return unescape(F.upper(F.regexp_replace(c, r"^\s+|\s+$", "")))


def strip_symbols(c: Column) -> Column:
    return F.regexp_replace(c, r"[^a-zA-Z0-9\s]", "")


def fold_ascii(c: Column) -> Column:
    """Letters without their marks; what has no ASCII letter under it goes."""
    strip = F.pandas_udf(_without_marks, "string")
    return F.when(F.octet_length(c) == F.char_length(c), c).otherwise(strip(c))


def _without_marks(texts: pd.Series) -> pd.Series:
    # text by text, so that no second form of the whole batch is held
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFD", t).encode("ascii", "ignore").decode("ascii"))


def clean_document(c: Column, compose_unicode: bool = False, ascii_only: bool = False) -> Column:
    """Lower case with single spaces; composed (NFC) or plain ASCII letters on request."""
    base = compose(c) if compose_unicode else c
    base = fold_ascii(base) if ascii_only else base
    return F.regexp_replace(F.regexp_replace(F.lower(base), r"\s+", " "), r"^ | $", "")


def strip_citations(c: Column) -> Column:
    return F.regexp_replace(c, REPORT_CITATION, "")


def csv_field(c: Column, delimiter: str = ",") -> Column:
    """Quote a value when it holds the delimiter, a quote or a line break; null is empty."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    needs = F.contains(text, F.lit(delimiter)) | F.rlike(text, F.lit('["\\r\\n]'))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(needs, quoted).otherwise(text)


def csv_line(columns: Sequence[Column], delimiter: str = ",") -> Column:
    return F.concat_ws(delimiter, *[csv_field(c, delimiter) for c in columns])


def render_csv(rows: Column, fields: Sequence[str], delimiter: str = ",") -> Column:
    """Header and one line per struct of the array ``rows``."""
    lines = F.transform(rows, lambda s: csv_line([s[f] for f in fields], delimiter))
    return F.concat(F.lit(delimiter.join(fields) + "\n"), F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""))


def flags_to_text(flags: dict[str, Column], none_text: str) -> Column:
    """Comma list of the names whose flag is positive."""
    names = F.concat_ws(", ", *[F.when(c > 0, F.lit(n)) for n, c in flags.items()])
    return F.when(names == "", F.lit(none_text)).otherwise(names)


def field_lines(fields: dict[str, Column]) -> Column:
    """One "label: value." line per field that is present."""
    return F.concat_ws("\n", *[
        F.when(c.isNotNull(), F.concat(F.lit(f"{label}: "), c.cast("string"), F.lit("."))) for label, c in fields.items()
    ])


def report_clean(c: Column) -> Column:
    """Keep letters, digits, white space and the marks . : '."""
    return F.regexp_replace(c, r"[^0-9A-Za-z.\s:']", "")


def gender_word(c: Column) -> Column:
    return F.when(c == "F", "Female").when(c == "M", "Male").otherwise(c)
