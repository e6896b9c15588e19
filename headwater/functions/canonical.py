"""Canonical rendering for fingerprints: decimals, JSON lines, Unicode form, attribute maps."""

from __future__ import annotations

import json
import re
import unicodedata
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FINGERPRINT_VERSION = 1


def canonical_decimal(value: Column) -> Column:
    """FN-N05 for decimals and integers: plain digits, no trailing zeros, zero is ``0``."""
    text = value.cast("string")
    plain = F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(value == 0, F.lit("0")).otherwise(plain)


def canonical_integer(value: Column) -> Column:
    """FN-N05 for whole numbers, whose plain text is already canonical."""
    return value.cast("string")


@F.pandas_udf(T.StringType())
def canonical_double(values: pd.Series) -> pd.Series:
    """FN-N05 for doubles (Arrow): shortest digits that read back to the same number.

    The JVM in use does not always print the shortest form, so this one is rendered in
    Python. Null stays null; non-finite numbers have no canonical form and become null.
    """
    def render(number):
        if pd.isna(number) or number in (float("inf"), float("-inf")):
            return None
        if number == 0:
            return "0"
        text = format(Decimal(repr(float(number))), "f")
        return text.rstrip("0").rstrip(".") if "." in text else text

    return values.map(render)


@F.pandas_udf(T.StringType())
def compose_unicode(texts: pd.Series) -> pd.Series:
    """Unicode composed form NFC (Arrow; Spark has no such function)."""
    return texts.map(lambda text: None if text is None else unicodedata.normalize("NFC", text))


# A string of JSON text, quotation marks included.
_STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.DOTALL)


def _composed_string(found: re.Match) -> str:
    quoted = found[0]
    if quoted.isascii() and "\\u" not in quoted:
        return quoted
    try:
        text = unicodedata.normalize("NFC", json.loads(quoted, strict=False))
        text.encode()  # half a surrogate pair has no composed form
    except ValueError:
        return quoted
    return json.dumps(text, ensure_ascii=False)


@F.pandas_udf(T.StringType())
def composed_document(documents: pd.Series) -> pd.Series:
    """JSON text with its strings, names included, in composed form (Arrow); all else stays digit by digit."""
    def composed(body):
        if body is None or (body.isascii() and "\\u" not in body):
            return body
        return _STRING.sub(_composed_string, body)

    return documents.map(composed)


def canonical_text(text: Column) -> Column:
    """A text value in composed form (NFC), for a canonical line.

    Values are composed before they are rendered: in a finished line a mark could join the letter of an escape.
    Text of ASCII alone is composed already; only the rest goes through Arrow, the others as nulls.
    """
    composed = compose_unicode(F.when(F.octet_length(text) != F.char_length(text), text))
    return F.coalesce(composed, text)


def json_line(fields: dict[str, Column]) -> Column:
    """SNK-05: one canonical JSON object, keys sorted, nulls written, newline at the end.

    Values must be rendered already: text (``canonical_text``), booleans, or nested structs built the same way.
    """
    ordered = F.struct(*[fields[name].alias(name) for name in sorted(fields)])
    line = F.to_json(ordered, {"ignoreNullFields": "false"})
    lowered = line
    for digit in "ABCDEF":  # an escape has an odd number of backslashes before its u
        lowered = F.regexp_replace(lowered, rf"((?<!\\)(?:\\\\)*\\u00[01]){digit}", f"$1{digit.lower()}")
    return F.concat(F.when(line.rlike(r"\\u00[01][A-F]"), lowered).otherwise(line), F.lit("\n"))


def header_line(subject: str) -> Column:
    """First line of every sequence digest."""
    return json_line(
        {"fingerprint_version": F.lit(str(FINGERPRINT_VERSION)), "subject": F.lit(subject)}
    )


def merge_attributes(old: Column, new: Column) -> Column:
    """FN-J01: keys of both maps; where both hold a key, the right one wins, null or not."""
    empty = F.create_map().cast("map<string,string>")
    left, right = F.coalesce(old, empty), F.coalesce(new, empty)
    return F.map_concat(
        F.map_filter(left, lambda key, value: ~F.array_contains(F.map_keys(right), key)), right
    )


def attribute_map(fields: dict[str, Column]) -> Column:
    """FN-J02: map of the non-null attributes, values as text."""
    pairs = []
    for name in sorted(fields):
        pairs += [F.lit(name), fields[name].cast("string")]
    return F.map_filter(F.create_map(*pairs), lambda key, value: value.isNotNull())
