"""Scalar functions: encoded attributes, context labels, chromosome sets, small parsers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The chromosomes, and below the patterns and keys by which a label is found.
CANONICAL = [f"chr{x}" for x in [*range(1, 23), "X", "Y", "M"]]


def unquote(text: Column) -> Column:
    """Percent decoding that keeps ``+`` and stray ``%``."""
    safe = F.regexp_replace(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"), "\\+", "%2B")
    return F.coalesce(F.try_url_decode(safe), text)


def parse_attributes(text: Column) -> Column:
    """``k=v;...`` (encoded, <br> for ;) as a map with lower-case keys; of repeated keys the last counts."""
    parts = F.split(F.regexp_replace(unquote(text), "<br>", ";"), ";")
    pairs = F.transform(F.filter(parts, lambda p: F.instr(p, "=") > 0), lambda p: F.struct(F.lower(F.trim(F.regexp_extract(p, "^([^=]*)=", 1))).alias("k"), F.trim(F.regexp_replace(p, "^[^=]*=", "")).alias("v")))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    last = lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"]
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k, last(k))))


EXPERIMENT, CELL = "\\b(SRX\\d+)\\b", "@\\s*([^)]+)\\)"
CELL_KEYS = ["cell line", "cell type", "source_name"]


def context_label(attributes: Column, by: str) -> Column:
    """srx: the first SRX number, in ``id`` before the rest; celltype: ``@ name)`` in ``name``, else the first of the
    cell keys; attribute:X: that key.  Null where there is none; another ``by`` is a ValueError."""
    at = lambda k: F.nullif(F.try_element_at(attributes, F.lit(k)), F.lit(""))
    if by == "srx":
        every = F.concat_ws(" ", at("id"), F.array_join(F.map_values(attributes), " "))
        return F.nullif(F.regexp_extract(every, EXPERIMENT, 1), F.lit(""))
    if by == "celltype":
        named = F.nullif(F.trim(F.regexp_extract(F.coalesce(at("name"), F.lit("")), CELL, 1)), F.lit(""))
        return F.coalesce(named, *map(at, CELL_KEYS))
    if by.startswith("attribute:"):
        return at(by.split(":", 1)[1].lower())
    raise ValueError(f"unknown context: {by}")


def named_path(text: str) -> tuple[str, str]:
    """NAME=PATH."""
    name, sep, path = text.partition("=")
    if not sep or not name or not path:
        raise ValueError(f"expected NAME=PATH, got {text!r}")
    return name, path


def plot_pairs(text: str) -> list[tuple[str, str]]:
    """a,b;c,d; entries that aren't pairs are left out."""
    found = [[x.strip() for x in p.split(",")] for p in text.split(";")]
    return [(p[0], p[1]) for p in found if len(p) == 2 and all(p)]


def threshold_of(key: str) -> float:
    """The number of a p-value key such as p0.0001."""
    return float(key.replace("p", ""))
