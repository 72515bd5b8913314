"""Text helpers as column expressions over whole texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SENTENCE_MARK = "\u0001"


def terms(text: Column) -> Column:
    """Lower-case words; anything but letters and digits separates."""
    words = F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " ")
    return F.filter(words, lambda w: w != "")


def sentences(text: Column) -> Column:
    """Pieces that end in a full stop, question or exclamation mark before white space."""
    marked = F.regexp_replace(text, r"([.!?])\s+", "$1" + SENTENCE_MARK)
    return F.filter(F.split(marked, SENTENCE_MARK), lambda s: s != "")


def fixed_chunks(text: Column, size: int, overlap: int) -> Column:
    """Pieces of ``size`` characters, each starting ``size - overlap`` after the last."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("need size > 0 and 0 <= overlap < size")
    starts = F.transform(
        F.sequence(F.lit(0), chunk_count(F.length(text), size, overlap) - 1), lambda i: i * (size - overlap) + 1
    )
    pieces = F.transform(starts, lambda s: F.substring(text, s, F.lit(size)))
    return F.when(F.length(text) > 0, pieces).otherwise(F.array().cast("array<string>"))


def chunk_count(length: Column, size: int, overlap: int) -> Column:
    """How many fixed chunks a text of this length has, at least one."""
    more = F.ceil((length - size) / F.lit(size - overlap))
    return (F.greatest(more, F.lit(0)) + 1).cast("int")


def recursive_chunks(text: Column, size: int, overlap: int = 0) -> Column:
    """Split at paragraphs, lines, sentences, then by size, only while a piece is too long."""
    def refine(pieces: Column, split) -> Column:
        kept = F.transform(pieces, lambda p: F.when(F.length(p) <= size, F.array(p)).otherwise(split(p)))
        return F.filter(F.flatten(kept), lambda p: p != "")

    out = F.array(text)
    for split in (
        lambda p: F.split(p, "\n\n"), lambda p: F.split(p, "\n"), sentences, lambda p: fixed_chunks(p, size, overlap)
    ):
        out = refine(out, split)
    return out


def pattern_hits(text: Column, patterns: Sequence[str]) -> Column:
    """The patterns found in the text, ignoring case."""
    lowered = F.lower(text)
    found = [F.when(F.contains(lowered, F.lit(p.lower())), F.lit(p)) for p in patterns]
    return F.filter(F.array(*found), lambda p: p.isNotNull())


def render(template: Column, values: Column) -> Column:
    """Fill ``{name}`` places from a map in one pass; null where a name is missing."""
    parts = F.split(template, "[{}]")
    names = F.filter(parts, lambda _, i: i % 2 == 1)
    filled = F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.try_element_at(values, p)).otherwise(p))
    complete = F.forall(names, lambda n: F.map_contains_key(values, n))
    return F.when(complete, F.array_join(filled, "", ""))


def missing_names(template: Column, values: Column) -> Column:
    names = F.filter(F.split(template, "[{}]"), lambda _, i: i % 2 == 1)
    return F.array_distinct(F.filter(names, lambda n: ~F.map_contains_key(values, n)))
