"""Sections of documents: cut by heading rules, drawn together, and cut into section, parent, child and part chunks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.text import col, mixed_units, strip
from granary.operators import markdown
from granary.operators.chunking import packed, packed_sized, recursive_chunks
from granary.sources.scratch import scratch_path

# What counts as a bare heading, from which level siblings are drawn together, and how small chapters must be.
STUB_LINES, STUB_UNITS, SIBLING_LEVEL, SMALL_CHAPTERS = 3, 80, 3, 150
# A section below 1.5 sizes stays whole, from 6 sizes on it gets parents of 4; room kept free under a limit.
WHOLE, LARGE, PARENT, MARGIN = 1.5, 6, 4, 10


@dataclass(frozen=True)
class HeadingRule:
    """A line that matches begins a section of this level; the line itself may be left out of the section."""

    pattern: str
    level: int
    keep: bool = True


def rule_sections(df: DataFrame, key: str, body: str, rules: list[HeadingRule]) -> DataFrame:
    """key, section, level, heading, path (headings above, joined by /), content: sections by configured rules, the first that
    matches a line counts. Lines before the first heading are section 0. Texts without any heading give no row: they
    are for the Markdown rules."""
    lines = df.select(key, F.posexplode(F.split(col(body), r"\r?\n")).alias("line_no", "line"))
    level, keep = F.lit(None).cast("int"), F.lit(True)
    for rule in reversed(rules):
        hit = F.col("line").rlike(rule.pattern)
        level, keep = F.when(hit, rule.level).otherwise(level), F.when(hit, rule.keep).otherwise(keep)
    lines = lines.withColumn("level", level).withColumn("keep", keep)
    so_far = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("section", F.count("level").over(so_far))
    levels = sorted({r.level for r in rules})
    for k in levels:
        last = F.last(F.when(F.col("level") <= k, F.struct("level", strip(F.col("line")).alias("line"))), ignorenulls=True).over(so_far)
        lines = lines.withColumn(f"h{k}", F.when(last["level"] == k, last["line"]))
    kept = F.when(F.col("level").isNull() | F.col("keep"), F.struct("line_no", "line"))
    out = lines.withColumn("path", F.concat_ws("/", *(f"h{k}" for k in levels))).groupBy(key, "section").agg(
        F.coalesce(F.max("level"), F.lit(0)).alias("level"),
        F.coalesce(F.max(F.when(F.col("level").isNotNull(), strip(F.col("line")))), F.lit("")).alias("heading"),
        F.max_by("path", "line_no").alias("path"),
        strip(F.array_join(F.transform(F.array_sort(F.collect_list(kept)), lambda x: x["line"]), "\n")).alias("content"),
    )
    out = out.withColumn("content", F.when(F.col("content") == "", F.col("heading")).otherwise(F.col("content")))
    found = F.max("section").over(Window.partitionBy(key)) > 0
    return out.withColumn("_found", found).filter("_found and content <> ''").drop("_found")


def joined_sections(sections: DataFrame, key: str, limit: int) -> DataFrame:
    """Sections (key, section, level, heading, path, content) with neighbours drawn together, within `limit` units of
    content and path: first bare headings and parents take what follows, then small siblings; until nothing changes.

    Units are counted in the engine; the sections of one document are walked in order by a small function.
    """
    sized = sections.select(key, F.struct("section", "level", "heading", "path", "content", mixed_units("content").alias("units"), mixed_units("path").alias("above")).alias("s"))
    docs = sized.groupBy(key).agg(F.array_sort(F.collect_list("s")).alias("s"))
    kind = sections.schema[key].dataType.simpleString()
    columns = {"level": pa.int32(), "heading": pa.string(), "path": pa.string(), "content": pa.string()}

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, at, rows = [], [], []
            # Field by field, as Arrow makes nested values one by one.
            every, lengths = batch.column("s").flatten(), pc.list_value_length(batch.column("s")).to_pylist()
            names, values = [f.name for f in every.type], zip(*(v.to_numpy(zero_copy_only=False).tolist() if pa.types.is_string(v.type) else v.to_pylist() for v in every.flatten()), strict=True)
            for i, n in enumerate(lengths):
                out = join_neighbours([dict(zip(names, s, strict=True)) for s in islice(values, n)], limit)
                of += [i] * len(out)
                at += range(len(out))
                rows += out
            told = [pa.array(v, t) for v, t in zip(zip(*rows, strict=True), columns.values(), strict=True)] if rows else [pa.array([], t) for t in columns.values()]
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(of, pa.int64())), pa.array(at, pa.int32()), *told], [key, "section", *columns])

    return docs.mapInArrow(walked, f"{key} {kind}, section int, level int, heading string, path string, content string")


def join_neighbours(sections: list[dict], limit: int) -> list[tuple]:
    """(level, heading, path, content) of one document's sections after all merges."""
    for siblings in (False, True):
        while True:
            out, at = [], 0
            while at < len(sections):
                two = sections[at : at + 2]
                if len(two) == 2 and _join(*two, limit, siblings):
                    out.append(_both(*two))
                    at += 2
                else:
                    out.append(two[0])
                    at += 1
            if len(out) == len(sections):
                break
            sections = out
    return [(s["level"], s["heading"], s["path"], s["content"]) for s in sections]


def _join(a: dict, b: dict, limit: int, siblings: bool) -> bool:
    if b["units"] + b["above"] > limit or a["units"] + b["units"] + (b["above"] or a["above"]) > limit:
        return False
    if b["level"] > a["level"] or (b["level"] == a["level"] and is_stub(a)):
        return True
    if not siblings or a["level"] != b["level"]:
        return False
    if a["level"] >= SIBLING_LEVEL:
        return True
    up = [s["path"].split("/")[:-1] for s in (a, b)]
    return a["level"] == 2 and up[0] == up[1] and len(up[0]) > 0 and a["units"] + b["units"] < SMALL_CHAPTERS


def is_stub(s: dict) -> bool:
    """A heading with next to nothing under it."""
    lines = [x for x in s["content"].split("\n") if x.strip()]
    return bool(lines) and lines[0].lstrip().startswith("#") and len(lines) <= STUB_LINES and s["units"] <= STUB_UNITS


def _both(a: dict, b: dict) -> dict:
    return {
        "level": min(a["level"] or 99, b["level"] or 99),
        "heading": b["heading"] or a["heading"],
        "path": b["path"] or a["path"],
        "content": f"{a['content'].rstrip()}\n\n{b['content'].lstrip()}",
        "units": a["units"] + b["units"],
        "above": b["above"] or a["above"],
    }


def _with_tail(pieces: Column, least: int, most: Column) -> Column:
    """The last piece joined to the one before, if it is below `least` and both fit."""
    n = F.size(pieces)
    last, before = F.element_at(pieces, -1), F.try_element_at(pieces, F.lit(-2))
    fits = (n >= 2) & (mixed_units(last) < least) & (mixed_units(before) + mixed_units(last) <= most)
    return F.when(fits, F.concat(F.slice(pieces, F.lit(1), F.greatest(n - 2, F.lit(0))), F.array(F.concat_ws("\n\n", before, last)))).otherwise(pieces)


def _written(rows: DataFrame, name: str) -> DataFrame:
    """rows as a scratch table: worked out once, however many read it."""
    path = scratch_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def section_tree(sections: DataFrame, key: str, size: int, limit: int) -> DataFrame:
    """key, section, role, position, part, vectorize, content: chunks of sections (key, section, path, content).

    A section that is small and fits the model with its path is one chunk. In others plain text is packed to `size` units
    within what the own path leaves of the limit, while tables, lists, code and quotes stand alone; one too large stays, not
    searched, with its parts below it. Short pieces and tails are drawn together, and from six sizes on parents are added.
    """
    units, head = mixed_units("content"), mixed_units("path")
    whole = (units < WHOLE * size) & (units + head <= limit)
    room = F.when(F.lit(limit - MARGIN) - head > 0, F.lit(limit - MARGIN) - head).otherwise(max(1, limit - 50))
    sized = sections.filter(strip(F.col("content")) != "").withColumn("_s", F.struct(key, "section")).select("_s", key, "section", "content", units.alias("units"), whole.alias("whole"), room.cast("long").alias("room"))
    sized = _written(sized, "sections-sized")
    small = sized.filter("whole").select(key, "section", F.lit("section").alias("role"), F.lit(0).alias("position"), F.lit(0).alias("part"), F.lit(True).alias("vectorize"), "content")
    large = sized.filter(~F.col("whole"))
    found = markdown.elements(large.select("_s", "content"), "_s", "content")
    blocks = found.groupBy("_s").agg(F.array_sort(F.collect_list(F.struct("first_line", "kind", "content"))).alias("blocks"))
    cut = large.join(blocks, "_s").withColumn("budget", F.least(F.col("room"), F.lit(size)))
    alone = lambda b: F.array(F.struct(b["content"].alias("p"), (F.col("budget") + 1).alias("n")))
    plain = lambda b: F.transform(packed(recursive_chunks(b["content"], max(1, size)), size, "\n", size=mixed_units), lambda p: F.struct(p.alias("p"), mixed_units(p).alias("n")))
    segments = F.flatten(F.transform("blocks", lambda b: F.when(b["kind"] == "plain", plain(b)).otherwise(alone(b))))
    # Column by column, so that no expression is written out where it is used.
    cut = cut.withColumn("_segments", segments).withColumn("_packed", packed_sized(F.col("_segments"), F.col("budget"), "\n\n"))
    cut = cut.withColumn("children", _with_tail(F.col("_packed"), max(1, size // 4), F.col("room"))).drop("_segments", "_packed")
    protected = F.transform(F.filter("blocks", lambda b: b["kind"] != "plain"), lambda b: F.named_struct(F.lit("text"), b["content"], F.lit("kind"), b["kind"]))
    # Pieces are worked out once: children, their parts and their parents read them.
    cut = _written(cut.select(key, "section", "units", "children", protected.alias("protected")), "section-pieces")
    items = cut.select(key, "section", "protected", F.posexplode("children").alias("position", "content"))
    kind = F.try_element_at(F.transform(F.filter("protected", lambda x: x["text"] == F.col("content")), lambda x: x["kind"]), F.lit(1))
    items = items.withColumn("kind", kind).withColumn("split", F.col("kind").isNotNull() & (mixed_units("content") > size))
    children = items.select(key, "section", F.lit("child").alias("role"), "position", F.lit(0).alias("part"), (~F.col("split")).alias("vectorize"), "content")
    pieces = markdown.split_element(F.col("kind"), F.col("content"), size)
    parts = items.filter("split").select(key, "section", F.lit("part").alias("role"), "position", F.posexplode(pieces).alias("part", "piece")).select(key, "section", "role", "position", (F.col("part") + 1).alias("part"), F.lit(True).alias("vectorize"), F.col("piece").alias("content"))
    above = cut.filter(F.col("units") >= LARGE * size).select(key, "section", F.lit("parent").alias("role"), F.posexplode(markdown.parents(F.col("children"), PARENT * size)).alias("position", "content"))
    above = above.select(key, "section", "role", "position", F.lit(0).alias("part"), F.lit(False).alias("vectorize"), "content")
    return small.unionByName(children).unionByName(parts).unionByName(above)


def hierarchy(df: DataFrame, key: str, body: str, size: int) -> DataFrame:
    """key, level (1 to 3), place, parent, content, is_leaf: texts cut into pieces of four, two and one sizes, each within the
    one above. A piece equal to the one above it is left out, and what is below it hangs there."""
    texts = df.select(key, recursive_chunks(body, 4 * size).alias("a"))
    one = texts.select(key, F.posexplode("a").alias("i", "t1"))
    two = one.select(key, "i", "t1", F.posexplode(recursive_chunks("t1", 2 * size)).alias("j", "t2"))
    three = two.select(key, "i", "j", "t1", "t2", F.posexplode(recursive_chunks("t2", size)).alias("k", "t3"))
    place = lambda *c: F.concat_ws(".", *(F.col(x).cast("string") for x in c))
    same2, same3 = strip(F.col("t2")) == strip(F.col("t1")), strip(F.col("t3")) == strip(F.col("t2"))
    rows1 = one.select(key, F.lit(1).alias("level"), place("i").alias("place"), F.lit(None).cast("string").alias("parent"), F.col("t1").alias("content"))
    rows2 = two.filter(~same2).select(key, F.lit(2), place("i", "j"), place("i"), "t2")
    rows3 = three.filter(~same3).select(key, F.lit(3), place("i", "j", "k"), F.when(same2, place("i")).otherwise(place("i", "j")), "t3")
    nodes = rows1.union(rows2).union(rows3)
    below = nodes.filter("parent is not null").select(key, F.col("parent").alias("place"), F.lit(True).alias("_b")).distinct()
    return nodes.join(below, [key, "place"], "left").withColumn("is_leaf", F.col("_b").isNull()).drop("_b")
