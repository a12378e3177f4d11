"""Normalisation tiers and text helpers as native column expressions."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as Python's str.strip and \s see it, in a Java regex.
SPACE = r"[\s\x1c-\x1f]"
#: The column of a row's position in its source.
POS = "__pos"
TIERS = ("raw", "clean", "normalized")


def quoted(name: str) -> str:
    """A column name that may hold dots or blanks, safe for F.col."""
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    return F.col(quoted(name))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^{SPACE}+|{SPACE}+$", "")


def blank_to_null(c: Column) -> Column:
    trimmed = strip(c.cast("string"))
    return F.when(trimmed != "", trimmed)


def raw(c: Column) -> Column:
    return c.cast("string")


def _collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, rf"(?U){SPACE}+", " "))


def clean(c: Column) -> Column:
    """Lower case, without , . ; and : and with hyphens and runs of white space as one blank."""
    bare = F.regexp_replace(F.lower(strip(c.cast("string"))), "[,.;:]+", "")
    return _collapse(F.replace(bare, F.lit("-"), F.lit(" ")))


def _java_literal(text: str) -> str:
    return r"\Q" + text.replace(r"\E", r"\E\\E\Q") + r"\E"


def normalized(c: Column, aliases: Mapping[str, str] | None = None, stopwords: Sequence[str] | None = None) -> Column:
    """clean, then each alias in its order as whole words, then stop words out."""
    out = clean(c)
    for alias, full in (aliases or {}).items():
        out = F.regexp_replace(out, rf"(?U)\b{_java_literal(alias)}\b", re.sub(r"([\\$])", r"\\\1", full))
    if stopwords:
        dropped = F.array(*[F.lit(s) for s in stopwords])
        out = F.array_join(F.filter(F.split(out, " "), lambda t: ~F.array_contains(dropped, t)), " ")
    return _collapse(out)


def tier(name: str, c: Column, aliases=None, stopwords=None) -> Column:
    if name == "raw":
        return raw(c)
    if name == "clean":
        return clean(c)
    if name == "normalized":
        return normalized(c, aliases, stopwords)
    raise ValueError(f"unknown tier {name!r}; known: {', '.join(TIERS)}")


def tier_value(name: str, value: str | None, aliases=None, stopwords=None) -> str | None:
    """The same tiers for one Python string, for small configuration values and Python workers."""
    if value is None or name == "raw":
        return value
    out = re.sub(r"[,.;:]+", "", value.strip().lower()).replace("-", " ")
    out = " ".join(out.split())
    if name == "clean":
        return out
    if name != "normalized":
        raise ValueError(f"unknown tier {name!r}; known: {', '.join(TIERS)}")
    for alias, full in (aliases or {}).items():
        out = re.sub(rf"\b{re.escape(alias)}\b", lambda _, to=full: to, out)
    dropped = set(stopwords or ())
    return " ".join(t for t in out.split() if t not in dropped)


def strip_prefix(c: Column, prefix: str | None) -> Column:
    """Without its leading letters ("alpha") or what an anchored pattern matches at the start."""
    if not prefix:
        return c
    return F.regexp_replace(c, "^[A-Za-z]+" if prefix == "alpha" else f"^(?:{prefix.removeprefix('^')})", "")


#: Sorts after every number: ids that don't parse.
UNPARSED = (1 << 63) - 1


def tie_key(c: Column, prefix: str | None) -> Column:
    """The order of tie-breaking: numbers once a prefix is stripped, else text."""
    if not prefix:
        return c.cast("string")
    return F.coalesce(strip(strip_prefix(c.cast("string"), prefix)).try_cast("bigint"), F.lit(UNPARSED))


def as_number(c: Column) -> Column:
    """A double if the whole text is a number; Spark's own cast would also take 1d or 1f."""
    return F.when(c.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), c.try_cast("double"))


@F.pandas_udf(StringType())
def nfkc(values: pd.Series) -> pd.Series:
    """Unicode compatibility composition; Spark has no such function."""
    return values.str.normalize("NFKC")


def tokens(c: Column, name: str = "raw") -> Column:
    """Split at single blanks, empty ones left out. The profiler's clean keeps hyphens."""
    text = c.cast("string")
    if name == "clean":
        text = F.regexp_replace(F.lower(text), "[,.;:]", "")
    return F.filter(F.split(text, " "), lambda t: t != "")
