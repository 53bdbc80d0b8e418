"""Text and list functions as Column expressions."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

STRINGS = "array<string>"


def clean_text(text: Column) -> Column:
    """Lower case; everything but a-z, 0-9 and space becomes a space; spaces collapse; null stays null."""
    letters = F.regexp_replace(F.lower(text), "[^a-z0-9 ]+", " ")
    return F.trim(F.regexp_replace(letters, r"\s+", " "))


def join_list(values: Column) -> Column:
    """A list's items with spaces between; null gives the empty text."""
    return F.coalesce(F.array_join(values, " "), F.lit(""))


def metadata_text(name: Column, *lists: Column) -> Column:
    """Name and list items as one cleaned text."""
    return clean_text(F.concat_ws(" ", F.coalesce(name, F.lit("")), *(join_list(x) for x in lists)))


def fix_json_list(text: Column) -> Column:
    """A JSON list of strings out of CSV text, its quotes doubled or not; what is no JSON gives its quoted parts."""
    single = F.regexp_replace(text, '""', '"')
    parsed = F.coalesce(F.from_json(text, STRINGS), F.from_json(single, STRINGS))
    quoted = F.regexp_extract_all(single, F.lit('"(.*?)"'), F.lit(1))
    return F.when(text.isNull() | (F.trim(text) == ""), F.array().cast(STRINGS)).otherwise(F.coalesce(parsed, quoted))


def flatten_literal(text: Column) -> Column:
    """The items of a list literal, or the text itself as the one item."""
    return F.coalesce(F.from_json(text, STRINGS), F.when(text.isNotNull(), F.array(text)), F.array().cast(STRINGS))


def strip_outer_quotes(text: Column) -> Column:
    """Without one pair of outer double quotes."""
    return F.regexp_replace(text, r'(?s)^"(.*)"$', "$1")


def clean_name(name: Column) -> Column:
    """A file name: illegal characters go, white space becomes _, outer _ go."""
    legal = F.regexp_replace(name, r'[\\/*?:"<>|]', "")
    return F.call_function("btrim", F.regexp_replace(legal, r"\s+", "_"), F.lit("_"))


def preprocess_title(title: Column) -> Column:
    """A searchable title: _ becomes a space, dots go, spaces collapse."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(title, "_", " "), r"\.", ""), r"\s+", " "))


def version_id(name: Column) -> Column:
    """The number of a leading v<digits>, else null."""
    found = F.regexp_extract(name, r"^v(\d+)", 1)
    return F.when(found != "", found.try_cast("long"))


def path_stem(path: Column) -> Column:
    """File name without directories and last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"(?<=.)\.[^.]*$", "")


def parent_name(path: Column) -> Column:
    """Name of the directory that holds a path."""
    return F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of two texts; null if either is."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def parsed_matrix(text: Column, rows: int, columns: int) -> Column:
    """A matrix from its JSON text, singleton outer lists unwrapped; a wrong shape raises."""
    flat = F.from_json(text, "array<array<double>>")
    deep = F.element_at(F.from_json(text, "array<array<array<double>>>"), 1)
    matrix = F.when(F.size(flat) == rows, flat).otherwise(deep)
    right = (F.size(matrix) == rows) & F.forall(matrix, lambda row: F.size(row) == columns)
    return F.when(F.coalesce(right, F.lit(False)), matrix).otherwise(F.raise_error(F.lit(f"matrix is not {rows} x {columns}")).cast("array<array<double>>"))
