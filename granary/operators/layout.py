"""Elements of pages: lines into paragraphs, columns, headers and footers, tables over page breaks, chunks, and the
elements that chunks came from."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import text
from granary.functions.text import mixed_units, strip

# Ends of paragraphs, beginnings that never go on with one, and how far lines of one may lie apart.
PARAGRAPH_END = r"[。！？?!]$"
NEW_START = r"""^([#{}\[\]"'\-]|\d+\.|\w+\s*[:=])"""
MOST_GAP, MOST_SIZE_CHANGE, MOST_INDENT = 4.0, 0.3, 2.0
# Gap, indent, width ratios and score for each way of joining recognised lines.
PROFILES = {"conservative": (2.5, 1.5, 0.55, 1.60, 3.0), "balanced": (4.0, 2.5, 0.45, 1.90, 2.0), "aggressive": (6.0, 4.0, 0.35, 2.30, 1.0)}
# How an element is found for a line of a chunk, and for a chunk as a whole.
LOOK_AHEAD, LINE_OVERLAP, WHOLE_AHEAD, WHOLE_OVERLAP = 260, 0.72, 360, 0.30
# What a page's text must have.
PAGE_CHARS, PAGE_GARBLED, PAGE_READABLE, PAGE_DENSITY = 50, 0.1, 0.35, 0.01


def _islands(rows: DataFrame, by: str, order: str, joins: Column) -> DataFrame:
    """Adds island: 1, 2, ... along the order; a row goes on with the one before where `joins` says so. `joins` sees the
    row before as the struct `before`."""
    w = Window.partitionBy(by).orderBy(order)
    out = rows.withColumn("before", F.lag(F.struct(*rows.columns)).over(w))
    new = F.when(F.col("before").isNotNull() & F.coalesce(joins, F.lit(False)), 0).otherwise(1)
    return out.withColumn("_new", new).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new", "before")


def paragraphs(lines: DataFrame, by: str, order: str) -> DataFrame:
    """Lines (by, order, content, x0, y0, x1, y1, size) with island: a line goes on with the one before, if that doesn't end a
    sentence, it doesn't begin anew, and gap, size and indent are small."""
    b = F.col("before")
    near = (F.col("y0") - b["y1"] <= MOST_GAP) & (F.abs(F.col("size") - b["size"]) <= MOST_SIZE_CHANGE) & (F.abs(F.col("x0") - b["x0"]) <= MOST_INDENT)
    return _islands(lines, by, order, ~strip(F.col("content")).rlike(NEW_START) & ~strip(b["content"]).rlike(PARAGRAPH_END) & near)


def recognised_paragraphs(lines: DataFrame, by: str, order: str, profile: str = "balanced") -> DataFrame:
    """As `paragraphs` for recognised lines: a score of closeness, indent, width and of how the line begins decides."""
    gap_most, indent_most, narrow, wide, least = PROFILES.get(profile, PROFILES["balanced"])
    b, here = F.col("before"), strip(F.coalesce("content", F.lit("")))
    gone = strip(F.coalesce(b["content"], F.lit("")))
    gap, height = F.col("y0") - b["y1"], F.greatest(b["y1"] - b["y0"], F.lit(1.0))
    widths = F.greatest(b["x1"] - b["x0"], F.lit(0.0)), F.greatest(F.col("x1") - F.col("x0"), F.lit(0.0))
    one = lambda test, yes=1.0, no=0.0: F.when(F.coalesce(test, F.lit(False)), yes).otherwise(no)
    score = one(gap <= height * 0.6) + one(F.abs(F.col("x0") - b["x0"]) <= indent_most, 1.0, -1.0)
    score = score + one((widths[0] > 0) & (widths[1] > 0) & F.try_divide(widths[1], widths[0]).between(narrow, wide)) + one(here.rlike(r"^[\p{Ll}一-鿿，、；：,;:)）]"))
    may = (here != "") & (gone != "") & ~gone.rlike(PARAGRAPH_END) & ~here.rlike(NEW_START) & (gap <= gap_most)
    return _islands(lines, by, order, may & (score >= least))


def two_columns(blocks: DataFrame, page: str, x: str, order: list[str], spread: float) -> DataFrame:
    """Blocks with col (1 or 2, where they spread over more than `spread`) and reading_order, column by column."""
    w = Window.partitionBy(page)
    low, high = F.min(x).over(w), F.max(x).over(w)
    out = blocks.withColumn("col", F.when((high - low > spread) & (F.col(x) >= (high + low) / 2), 2).otherwise(1))
    return out.withColumn("reading_order", F.row_number().over(w.orderBy("col", *order)))


def without_repeated(elements: DataFrame, doc: str, signature: Column, share: float = 0.15, least_pages: int = 3) -> DataFrame:
    """Elements without those whose signature recurs on a large share of the pages, as headers and footers do.

    Counts are made by aggregation and joined, so that one long document is no window in one task."""
    marked = elements.withColumn("_s", signature)
    counts = marked.groupBy(doc, "_s").agg(F.count("*").alias("_n"))
    pages = counts.groupBy(doc).agg(F.sum("_n").alias("_pages"))
    often = counts.join(pages, doc).filter((F.col("_pages") >= least_pages) & (F.col("_n") >= F.floor(share * F.col("_pages")))).select(doc, "_s")
    same = marked[doc].eqNullSafe(often[doc]) & marked["_s"].eqNullSafe(often["_s"])
    return marked.join(often, same, "left_anti").drop("_s")


def body_size(spans: DataFrame, doc: str, size: str, chars: str) -> DataFrame:
    """doc, body_size, chars: the commonest font size of each document, weighted by characters; the smaller of equals."""
    sizes = spans.groupBy(doc, F.round(size, 0).alias("size")).agg(F.sum(chars).alias("chars"))
    return sizes.groupBy(doc).agg(F.max_by("size", F.struct(F.col("chars"), -F.col("size"))).alias("body_size"), F.max("chars").alias("chars"))


def best_readings(readings: DataFrame, bucket: list[str], key: str, confidence: Column) -> DataFrame:
    """Of readings that fall into one bucket the one of best confidence, the last key of equals."""
    rows = readings.withColumn("conf", confidence)
    return rows.groupBy(*bucket).agg(F.max_by(key, F.struct("conf", key)).alias(key), F.max("conf").alias("conf"))


def boxes(elements: DataFrame, page: str) -> DataFrame:
    """The box around all elements (x0, y0, x1, y1) of each page."""
    return elements.groupBy(page).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def rescaled(box: Column, width: Column, height: Column, canvas: Column) -> Column:
    """A box (array of four) on a canvas of equal sides in points of the page; as it is where sizes are unknown."""
    known = (F.size(box) == 4) & (width > 0) & (height > 0) & (canvas > 0)
    scaled = F.array(*(box[i] / canvas * (width if i % 2 == 0 else height) for i in range(4)))
    return F.when(F.coalesce(known, F.lit(False)), scaled).otherwise(box)


def page_quality(content: Column, width: Column, height: Column, chars: Column) -> Column:
    """good, and the first reason against a page's text: short, garbled, unreadable, sparse, no_sentences."""
    n = F.length(content)
    dense = F.regexp_replace(content, r"\s+", "")
    garbled = F.regexp_count(content, F.lit("�")) * 2 + F.regexp_count(content, F.lit("□")) + F.regexp_count(content, F.lit(r"[\x00-\x08\x0b-\x0c\x0e-\x1f]"))
    readable = F.try_divide(F.regexp_count(dense, F.lit("[一-鿿A-Za-z0-9]")), F.length(dense))
    sparse = (chars > 0) & (F.coalesce(F.try_divide(chars, width * height), F.lit(0.0)) < PAGE_DENSITY)
    sentences = content.rlike("[，。！？；：、]") | content.rlike(r"\b[a-zA-Z]{2,}\b")
    reason = F.when(F.length(strip(content)) < PAGE_CHARS, "short").when(garbled > PAGE_GARBLED * n, "garbled").when(F.coalesce(readable < PAGE_READABLE, F.lit(False)), "unreadable").when(sparse, "sparse").when(~sentences, "no_sentences")
    return F.struct(reason.isNull().alias("good"), F.coalesce(reason, F.lit("ok")).alias("reason"))


def joined_tables(tables: DataFrame, by: str, order: str) -> DataFrame:
    """Tables (by, order, header array, rows array of arrays) that follow each other with as many columns, as one: by, island,
    first, parts, header, rows.

    A header equal to the first one is repeated and goes; another is a row, stitched to the row before where its first
    cell is empty and another isn't. The parts of one table are folded in order.
    """
    same = F.size("header") == F.size(F.col("before")["header"])
    marked = _islands(tables, by, order, same)
    parts = F.array_sort(F.collect_list(F.struct(order, "header", "rows"))).alias("parts")
    grouped = marked.groupBy(by, "island").agg(parts)
    rows_type = "array<array<string>>"

    def step(done: Column, p: Column) -> Column:
        head, first = p["header"], F.element_at(F.col("parts"), 1)["header"]
        last = F.try_element_at(done, F.lit(-1))
        cut = last.isNotNull() & (strip(head[0]) == "") & F.exists(F.slice(head, F.lit(2), F.greatest(F.size(head) - 1, F.lit(0))), lambda c: strip(c) != "")
        joined = F.zip_with(last, head, lambda a, c: F.when(strip(c) != "", strip(F.concat(a, F.lit(" "), strip(c)))).otherwise(a))
        grown = F.when(head == first, done).when(cut, F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(done, F.array(head)))
        return F.concat(grown, p["rows"]).cast(rows_type)

    rest = F.slice("parts", F.lit(2), F.greatest(F.size("parts") - 1, F.lit(0)))
    start = F.element_at("parts", 1)["rows"].cast(rows_type)
    return grouped.select(by, "island", F.element_at("parts", 1)[order].alias("first"), F.size("parts").alias("n_parts"), F.element_at("parts", 1)["header"].alias("header"), F.aggregate(rest, start, step).alias("rows"))


#: Kinds of elements whose content is text, least size, most of a size that is overlap.
TEXT_KINDS, LEAST_SIZE, MOST_OVERLAP = ("text", "title", "code", "table", "image"), 80, 0.3


def layout_elements(elements: DataFrame, by: str) -> DataFrame:
    """Elements (by, idx, type, content, page_no, bbox) that chunks are made of, with `place` in reading order: by page, top, left and
    idx. Other kinds, blank contents and elements without page or a box of some extent go; an image stands as a reference."""
    kind, content = F.lower(F.coalesce("type", F.lit(""))), strip(F.coalesce("content", F.lit("")))
    box = F.transform("bbox", lambda v: v.cast("double"))
    sound = (F.size("bbox") == 4) & F.forall("bbox", lambda v: v.isNotNull()) & (F.get(box, F.lit(2)) > F.get(box, F.lit(0))) & (F.get(box, F.lit(3)) > F.get(box, F.lit(1)))
    kept = elements.filter(kind.isin(*TEXT_KINDS) & (content != "") & F.col("page_no").isNotNull() & F.coalesce(sound, F.lit(False)))
    shown = F.when(kind == "image", F.concat(F.lit("![image]("), content, F.lit(")"))).otherwise(content)
    return kept.withColumn("content", shown).withColumn("place", F.struct("page_no", F.get(box, F.lit(1)), F.get(box, F.lit(0)), "idx"))


def with_tail(pieces: Column, size: int, overlap: int, joiner: str) -> Column:
    """Pieces (p: text, n: units) packed to `size`, each chunk beginning with the last pieces of the one before: one, and those before
    it as long as all fit `overlap`. The tail counts towards the chunk, but what follows is added to it even if that is over the size."""
    kind = "struct<done: array<string>, now: array<struct<p: string, n: bigint>>, n: bigint>"
    none = F.array().cast("array<struct<p: string, n: bigint>>")
    total = lambda some: F.aggregate(some, F.lit(0).cast("long"), lambda a, x: a + x["n"])
    joined = lambda some: F.array_join(F.transform(some, lambda x: x["p"]), joiner)

    def tail(some: Column) -> Column:
        ends = F.sequence(F.size(some), F.lit(1), F.lit(-1))
        fits = F.filter(ends, lambda i: (i == F.size(some)) | (total(F.slice(some, i, F.size(some))) <= overlap))
        return F.slice(some, F.array_min(fits), F.size(some)) if overlap > 0 else none

    def step(s: Column, x: Column) -> Column:
        full = (F.size(s["now"]) > 0) & (s["n"] + x["n"] > size)
        kept = F.when(full, tail(s["now"])).otherwise(s["now"])
        done = F.when(full, F.array_append(s["done"], joined(s["now"]))).otherwise(s["done"])
        return F.struct(done.alias("done"), F.array_append(kept, x).alias("now"), (total(kept) + x["n"]).alias("n")).cast(kind)

    start = F.struct(F.array().cast("array<string>").alias("done"), none.alias("now"), F.lit(0).cast("long").alias("n")).cast(kind)
    return F.aggregate(pieces, start, step, lambda s: F.when(F.size(s["now"]) > 0, F.array_append(s["done"], joined(s["now"]))).otherwise(s["done"]))


def layout_chunks(elements: DataFrame, by: str, order: str, size: int, overlap: int = 0) -> DataFrame:
    """by, position, content: elements (by, order, content) in order, packed to `size` units (80 at least), each chunk beginning with the
    last elements of the one before, as far as they come to `overlap` (three tenths of the size at most; always one)."""
    target = max(LEAST_SIZE, size)
    most = max(0, min(overlap, int(target * MOST_OVERLAP)))
    units = F.greatest(F.lit(1).cast("long"), mixed_units("content"))
    filled = elements.filter(strip(F.coalesce("content", F.lit(""))) != "")
    in_order = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_at"), F.col("content").alias("_p"), units.alias("_n"))))
    pieces = F.transform(in_order, lambda x: F.struct(x["_p"].alias("p"), x["_n"].alias("n")))
    docs = filled.groupBy(by).agg(pieces.alias("_pieces"))
    return docs.select(by, F.posexplode(with_tail(F.col("_pieces"), target, most, "\n")).alias("position", "content"))


@dataclass(frozen=True)
class _Element:
    place: int
    norm: str
    words: frozenset


def aligned_elements(chunks: DataFrame, elements: DataFrame, by: str) -> DataFrame:
    """by, chunk, element: which elements (by, place, content) each chunk (by, chunk, content) of a document came from.

    Chunks and elements of a document are walked in order: each line takes the next element that contains it, lies in it
    or shares most of its words; a chunk without any such line takes the most alike one ahead.
    """
    norm = text.match_text("content")
    kind = chunks.schema[by].dataType.simpleString()
    lines = F.filter(F.transform(F.split("content", "\n"), text.match_text), lambda x: F.length(x) >= 2)
    left = chunks.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("chunk", lines.alias("lines"), norm.alias("norm")))).alias("chunks"))
    right = elements.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("place", norm.alias("norm")))).alias("elements"))

    def walked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, parts, known in zip(frame[by], frame["chunks"], frame["elements"], strict=True):
                page, at = [_Element(e["place"], e["norm"], frozenset(e["norm"].split())) for e in known], 0
                for c in parts:
                    found, at = align(list(c["lines"]), c["norm"], page, at)
                    rows += [(key, c["chunk"], page[i].place) for i in found]
            yield pd.DataFrame(rows, columns=[by, "chunk", "element"])

    return left.join(right, by).mapInPandas(walked, f"{by} {kind}, chunk long, element long")


def overlap_score(a: frozenset, b: frozenset) -> float:
    return len(a & b) / min(len(a), len(b)) if a and b else 0.0


def align(lines: list[str], norm: str, page: list[_Element], at: int) -> tuple[list[int], int]:
    """Places of the elements of one chunk from `at` on, and where the next chunk goes on."""
    found, cursor = [], at
    for line in lines:
        words = frozenset(line.split())
        for j in range(cursor, min(len(page), cursor + LOOK_AHEAD)):
            e = page[j]
            if e.norm and (line in e.norm or e.norm in line or overlap_score(words, e.words) >= LINE_OVERLAP):
                found.append(j)
                cursor = j + 1
                break
    if found:
        return sorted(set(found)), found[-1] + 1
    words = frozenset(norm.split())
    ahead = range(at, min(len(page), at + WHOLE_AHEAD))
    best = max(ahead, key=lambda j: (overlap_score(words, page[j].words), -j), default=None)
    if not norm or best is None or overlap_score(words, page[best].words) < WHOLE_OVERLAP:
        return [], at
    return [best], best + 1
