"""Operators on text inputs: feature lists, value lists, share links, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of file ids in share links, first match wins.
FILE_ID_PATTERNS = (
    r"/file/d/([a-zA-Z0-9_-]+)",
    r"id=([a-zA-Z0-9_-]+)",
    r"/d/([a-zA-Z0-9_-]+)/",
    r"/d/([a-zA-Z0-9_-]+)$",
    r"open\?id=([a-zA-Z0-9_-]+)",
)


def parse_kv(line: Column | str, pair_delim: str = " ") -> Column:
    """``KEY=VALUE`` pairs to a map: upper-cased keys, entries without a number dropped.

    A repeated key keeps its last value.
    """
    line = F.col(line) if isinstance(line, str) else line
    sep = r"\s+" if pair_delim == " " else pair_delim
    pairs = F.filter(F.split(F.trim(line), sep), lambda p: p.contains("="))
    items = F.transform(pairs, lambda p: F.struct(
        F.upper(F.trim(F.substring_index(p, "=", 1))).alias("k"),
        F.trim(F.substr(p, F.instr(p, "=") + 1)).try_cast("double").alias("v")))
    valid = F.filter(items, lambda i: i["v"].isNotNull())
    last = F.filter(valid, lambda i, n: ~F.exists(
        F.slice(valid, n + 2, F.greatest(F.size(valid), F.lit(1))), lambda o: o["k"] == i["k"]))
    return F.map_from_entries(last)


def parse_values(line: Column | str) -> Column:
    """A comma-separated list of numbers to an array; entries without a number become NULL."""
    line = F.col(line) if isinstance(line, str) else line
    return F.transform(F.split(line, ","), lambda p: F.trim(p).try_cast("double"))


def file_id(url: Column | str) -> Column:
    """Id of a shared file, NULL if no pattern matches."""
    url = F.col(url) if isinstance(url, str) else url
    return F.coalesce(*[F.nullif(F.regexp_extract(url, p, 1), F.lit("")) for p in FILE_ID_PATTERNS])


def file_name(url: Column | str) -> Column:
    """``name=`` of the query string, else the last part of the path if it has a suffix."""
    url = F.col(url) if isinstance(url, str) else url
    named = F.nullif(F.regexp_extract(url, r"[?&]name=([^&#]+)", 1), F.lit(""))
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    last = F.element_at(F.split(F.regexp_replace(path, r"/view$", ""), "/"), -1)
    return F.coalesce(named, F.when(last.contains("."), last))


def name_contains(name: Column, part: str) -> Column:
    """Case-insensitive substring test."""
    return F.upper(name).contains(part.upper())


def names_overlap(a: Column, b: Column) -> Column:
    """True if either name contains the other, ignoring case."""
    a, b = F.upper(a), F.upper(b)
    return a.contains(b) | b.contains(a)
