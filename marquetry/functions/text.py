"""The text functions that no built-in equals, as Arrow-batched UDFs.

Each works on whole columns: Arrow kernels where they suffice, and a text that needs more is treated once
a batch, however often it stands there.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

_QUALIFIER = re.compile(r"\([^()]*\)|\[[^\[\]]*\]|\b(?:feat|ft|featuring)\b\.?\s.*$", re.IGNORECASE)


def _each(texts: pd.Series, plain: Callable[[pa.Array], pa.Array], other: Callable[[str], str]) -> pd.Series:
    """``plain`` of the ASCII texts as one array, ``other`` once for each distinct text beside them."""
    column = pa.array(texts.tolist(), pa.string(), from_pandas=True)
    simple = pc.string_is_ascii(column)
    rest = pc.if_else(simple, None, column).dictionary_encode()
    formed = pa.array([other(t) for t in rest.dictionary.to_pylist()], pa.string()).take(rest.indices)
    return pc.coalesce(plain(pc.if_else(simple, column, None)), formed).to_pandas()


def _words_of(column: pa.Array) -> pa.Array:
    return pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(column), r"[^0-9a-z]+", " "), " ")


def normalise(text: str | None) -> str:
    """A name for lookups: decomposed, case-folded, without accents; signs become one blank."""
    letters = (c if c.isalnum() else " " for c in unicodedata.normalize("NFKD", text or "").casefold() if not unicodedata.combining(c))
    return " ".join("".join(letters).split())


def fold(text: str) -> str:
    """A title as titles are compared: ``normalise`` without bracketed qualifiers and guests, unless nothing is left."""
    return normalise(_QUALIFIER.sub(" ", text)) or normalise(text)


def ratio(a: str | None, b: str | None) -> float | None:
    """Matching-blocks ratio of two texts in lower case; null when either is null."""
    if a is None or b is None:
        return None
    return SequenceMatcher(None, a.lower().strip(), b.lower().strip()).ratio()


@F.pandas_udf(StringType())
def _normalise(texts: pd.Series) -> pd.Series:
    return _each(texts, _words_of, normalise).fillna("")


@F.pandas_udf(StringType())
def _fold(texts: pd.Series) -> pd.Series:
    seen = {t: fold(t) for t in texts.dropna().unique()}
    return pd.Series([seen.get(t) for t in texts], dtype=object)


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    seen: dict[tuple[str | None, str | None], float | None] = {}
    for pair in zip(a, b):
        if pair not in seen:
            seen[pair] = ratio(*pair)
    return pd.Series([seen[pair] for pair in zip(a, b)], dtype="float64")


def norm_name(text: Column) -> Column:
    """``normalise`` of a column; null gives an empty text."""
    return _normalise(text)


def folded_title(text: Column) -> Column:
    """``fold`` of a column; null stays null, and a title without a letter or digit is none."""
    return F.nullif(_fold(text), F.lit(""))


def fuzzy_ratio(a: Column, b: Column) -> Column:
    """``ratio`` of two columns. Put it above a join on an equality: it is not pushed into joins."""
    return _ratio(a, b)
