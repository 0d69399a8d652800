"""Cutting texts by a user's separators, in turn, and drawing the pieces together again with an overlap."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions.text import col, strip
from granary.operators.chunking import windows

_CUT = "\x01"


@dataclass(frozen=True)
class Separator:
    """A text or a pattern; what matches stays with the piece before it or after it."""

    pattern: str
    literal: bool = True
    keep: str = "previous"


def split_keeping(text: Column, by: Separator) -> Column:
    """The pieces of a text, matches kept; with `next`, line ends before a match go with it."""
    pattern = re.escape(by.pattern) if by.literal else by.pattern
    marked = F.regexp_replace(text, f"({pattern})", f"$1{_CUT}") if by.keep == "previous" else F.regexp_replace(text, f"([\\r\\n]*(?:{pattern}))", f"{_CUT}$1")
    return F.filter(F.split(marked, _CUT), lambda p: p != "")


def _sliced(text: Column, size: int, overlap: int) -> Column:
    return F.filter(F.transform(windows(text, size, overlap, stop_at_end=True), lambda w: strip(w["content"])), lambda p: p != "")


def merged(segments: Column, size: int, overlap: int) -> Column:
    """Pieces put together while they fit; the next chunk begins with the last `overlap` characters of the one before, if
    the next piece then fits, too. A piece beyond the size is cut into windows."""
    kind = "struct<done:array<string>,open:string>"
    add = lambda done, c: F.when(strip(c) != "", F.array_append(done, strip(c))).otherwise(done)
    state = lambda done, open_: F.struct(done.alias("done"), open_.alias("open")).cast(kind)
    empty = F.array().cast("array<string>")

    def step(a: Column, s: Column) -> Column:
        closed = add(a["done"], a["open"])
        tail = F.when((F.length(a["open"]) > overlap) & (overlap > 0), F.substring(a["open"], -max(overlap, 1), max(overlap, 1))).otherwise("")
        cut = state(F.concat(closed, _sliced(s, size, overlap)), F.lit(""))
        return F.when(F.length(s) > size, cut).when(F.length(a["open"]) + F.length(s) <= size, state(a["done"], F.concat(a["open"], s))).when(F.length(tail) + F.length(s) <= size, state(closed, F.concat(tail, s))).otherwise(cut)

    return F.aggregate(segments, state(empty, F.lit("")), step, lambda a: add(a["done"], a["open"]))


def cut_by_rules(c: Column | str, rules: list[Separator], size: int, overlap: int) -> Column:
    """Chunks of a text: only pieces beyond the size are cut by the next rule, and by windows after the last one."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than size")

    def cut(text: Column, rest: list[Separator]) -> Column:
        if not rest:
            return _sliced(text, size, overlap)
        pieces = F.filter(split_keeping(text, rest[0]), lambda p: strip(p) != "")
        deeper = F.flatten(F.transform(pieces, lambda p: F.when(F.length(strip(p)) <= size, F.array(p)).otherwise(cut(p, rest[1:]))))
        return F.when(F.size(split_keeping(text, rest[0])) <= 1, cut(text, rest[1:])).otherwise(merged(deeper, size, overlap))

    text = col(c)
    return F.when(strip(text) == "", F.array().cast("array<string>")).when(F.length(strip(text)) <= size, F.array(text)).otherwise(cut(text, rules))
