"""Rows of sheets: header, merged cells, cell texts, chunks of wide rows, and what a table's schema adds to a row's text."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.text import strip
from granary.operators import filters
from granary.operators.chunking import packed_sized

SCANNED_ROWS = 10
LEAST_PREFIX, PREFIX_SHARE, LEAST_WINDOW = 32, 0.35, 50

# The words of a row's texts.
SHEET, PLACE, ROW_FIELDS, FIELDS, VALUES, HEADER = "工作表", "行定位", "当前行字段", "当前字段", "筛选值", "表头"
DIMENSIONS, METRICS, IDENTIFIERS, ALIASES = "维度字段", "指标字段", "唯一标识字段", "别名"
VIEW, VIEW_ROW, VIEW_PART = "命中视角", "行", "行片段"
YES, NO = "是", "否"
DIMENSION_ROLES = ("dimension", "entity", "identifier")


def _text(c: Column | str) -> Column:
    return strip(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))


def header_row(cells: DataFrame, sheet: str = "sheet", row: str = "row_no", value: str = "value") -> DataFrame:
    """sheet and its header row: of the first ten (from 0) the first with two cells that aren't blank, else the fullest."""
    filled = F.count(F.when(_text(value) != "", 1)).alias("filled")
    rows = cells.filter(F.col(row) < SCANNED_ROWS).groupBy(sheet, row).agg(filled)
    first = F.min(F.when(F.col("filled") >= 2, F.col(row)))
    return rows.groupBy(sheet).agg(F.coalesce(first, F.max_by(row, F.struct("filled", -F.col(row)))).alias("header_row"))


def with_merged_cells(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """Cells (sheet, row_no, col_no, value) with each merged range (sheet, top, left, bottom, right) filled by its first
    cell's value. Ranges are expanded to the cells that they cover, as cells are few beside a join by range."""
    covered = merges.select("sheet", "top", "left", F.explode(F.sequence("top", "bottom")).alias("row_no"), "right").select("sheet", "top", "left", "row_no", F.explode(F.sequence("left", "right")).alias("col_no"))
    first = cells.select("sheet", F.col("row_no").alias("top"), F.col("col_no").alias("left"), F.col("value").alias("merged"))
    filled = covered.join(first, ["sheet", "top", "left"]).select("sheet", "row_no", "col_no", "merged", F.lit(True).alias("covered"))
    out = cells.join(filled, ["sheet", "row_no", "col_no"], "full")
    return out.select("sheet", "row_no", "col_no", F.when(F.col("covered"), F.col("merged")).otherwise(F.col("value")).alias("value"))


def cell_text(kind: Column, text: Column, number: Column, at: Column, flag: Column) -> Column:
    """A cell as text by its kind: date, bool, number or text. Midnight is a date; errors are empty; 3.0 is 3."""
    when = F.when((F.hour(at) == 0) & (F.minute(at) == 0) & (F.second(at) == 0), F.date_format(at, "yyyy-MM-dd")).otherwise(F.date_format(at, "yyyy-MM-dd HH:mm:ss"))
    plain = strip(text)
    written = F.when(number == F.floor(number), number.cast("long").cast("string")).otherwise(number.cast("string"))
    value = F.when(kind == "date", when).when(kind == "bool", F.when(flag, YES).otherwise(NO)).when(kind == "number", written)
    return F.coalesce(value.otherwise(F.when(plain.startswith("#") & plain.endswith("!"), "").otherwise(plain)), F.lit(""))


def pairs(header: Column, values: Column) -> Column:
    """(name, value) of the cells that aren't blank under a name."""
    zipped = F.transform(F.arrays_zip(header.alias("h"), values.alias("v")), lambda p: F.struct(_text(p["h"]).alias("name"), _text(p["v"]).alias("value")))
    return F.filter(zipped, lambda p: (p["name"] != "") & (p["value"] != ""))


def _named(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda p: F.concat(p["name"], F.lit(": "), p["value"])), "; ")


def filter_fields(items: Column, columns: list[str]) -> Column:
    """The filterable columns' values as a map."""
    return F.map_from_entries(F.filter(items, lambda p: p["name"].isin(*columns)))


def identity_text(sheet: Column, row_no: Column, keys: Column) -> Column:
    """Where a row stands, and its key columns."""
    base = F.concat(F.lit("["), sheet, F.lit("] 第"), row_no.cast("string"), F.lit("行"))
    return F.when(F.size(keys) > 0, F.concat(base, F.lit("; "), _named(keys))).otherwise(base)


def safe_prefix(identity: Column, limit: int) -> Column:
    """What each part of a row begins with: its identity, its place alone, or nothing, as far as a third of the limit allows."""
    room = 2 * max(LEAST_PREFIX, int(limit * PREFIX_SHARE))  # a unit is two characters
    whole, place = F.concat(identity, F.lit("; ")), F.concat(F.element_at(F.split(identity, ";", 2), 1), F.lit("; "))
    return F.when(F.length(whole) <= room, whole).when(F.length(place) <= room, place).otherwise("")


def row_chunks(rows: DataFrame, limit: int, key_columns: list[str], filterable: list[str]) -> DataFrame:
    """Chunks of rows (sheet, row_no, header, values): sheet, row_no, role, part, is_leaf, content, filter_fields.

    A row within `limit` units (two characters each) is one leaf. Others become a parent with a leaf for each group of
    fields that fits, behind a prefix that names the row; a field beyond the limit is cut into windows, each a leaf of its own.
    """
    items = pairs(F.col("header"), F.col("values"))
    r = rows.select("sheet", "row_no", items.alias("items"))
    keys = F.filter("items", lambda p: p["name"].isin(*key_columns)) if key_columns else F.slice("items", 1, 0)
    rest = F.filter("items", lambda p: ~p["name"].isin(*key_columns)) if key_columns else F.col("items")
    r = r.select("*", identity_text(F.col("sheet"), F.col("row_no"), keys).alias("identity"), rest.alias("rest"), filter_fields(F.col("items"), filterable).alias("filter_fields"))
    r = r.withColumn("prefix", safe_prefix(F.col("identity"), limit))
    budget = 2 * limit - F.length("prefix") + 2
    one = lambda p: F.concat(p["name"], F.lit(": "), p["value"])
    fits = lambda p: F.array(F.struct(one(p).alias("p"), (F.length(one(p)) + 2).cast("long").alias("n")))
    room = lambda p: F.greatest(budget - 2 - F.length(p["name"]) - 2, F.lit(LEAST_WINDOW))
    cuts = lambda p: F.transform(F.sequence(F.lit(1), F.length(p["value"]), room(p)), lambda i: F.struct(F.concat(p["name"], F.lit(": "), F.substring(p["value"], i, room(p))).alias("p"), (budget + 1).cast("long").alias("n")))
    sized = F.flatten(F.transform("rest", lambda p: F.when(F.length(one(p)) + 2 <= budget, fits(p)).otherwise(cuts(p))))
    r = r.withColumn("groups", F.transform(packed_sized(sized, budget, "; "), lambda g: F.concat(F.col("prefix"), g)))
    r = r.withColumn("whole", F.size("groups") <= 1).filter(F.size("items") > 0)
    part = lambda role, i, leaf, text: F.struct(F.lit(role).alias("role"), i.alias("part"), leaf.alias("is_leaf"), text.alias("content"))
    single = part("excel_row", F.lit(0), F.lit(True), _named(F.col("items")))
    parent = part("excel_row", F.lit(0), F.lit(False), F.concat_ws("\n", "identity", _named(F.col("items"))))
    several = F.concat(F.array(parent), F.transform("groups", lambda g, i: part("excel_row_fragment", i + 1, F.lit(True), g)))
    return r.select("sheet", "row_no", "filter_fields", F.explode(F.when(F.col("whole"), F.array(single)).otherwise(several)).alias("c")).select("sheet", "row_no", "c.*", "filter_fields")


@dataclass(frozen=True)
class Schema:
    """What a table's columns are for, and how that is said."""

    dimensions: list[str] = field(default_factory=list)
    metrics: list[str] = field(default_factory=list)
    identifiers: list[str] = field(default_factory=list)
    header_text: str = ""
    table_text: str = ""


def schema_of(columns: list[dict]) -> Schema:
    """Dimension, metric and identifier columns of a table's configuration, and the text that names them."""
    named = [c | {"name": str(c.get("name") or "").strip(), "role": str(c.get("role") or "").strip().lower()} for c in columns]
    named = [c for c in named if c["name"]]
    of = lambda test: list(dict.fromkeys(c["name"] for c in named if test(c)))
    aliases = lambda c: [a for a in (str(x).strip() for x in c.get("aliases") or []) if a]
    heads = [c["name"] + (f"（{ALIASES}: {'、'.join(aliases(c)[:4])}）" if aliases(c) else "") for c in named]
    dims, metrics, ids = of(lambda c: c["role"] in DIMENSION_ROLES), of(lambda c: c.get("aggregatable") or c["role"] == "content"), of(lambda c: c["role"] == "identifier")
    header = f"{HEADER}: {'；'.join(heads[:12])}" if heads else ""
    lines = [header, f"{DIMENSIONS}: {'、'.join(dims[:8])}" if dims else "", f"{METRICS}: {'、'.join(metrics[:8])}" if metrics else ""]
    return Schema(dims, metrics, ids, header, "\n".join(x for x in lines if x))


def _line(label: str, body: Column) -> Column:
    return F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit(f"{label}: "), body))


def contextual_text(sheet: Column, identity: Column, fields: Column, values: Column, base: Column, role: Column, schema: Schema) -> Column:
    """What is searched for a row: its place, fields and filter values, the table's schema, and its own text."""
    some = F.transform(F.slice(F.map_entries(values), 1, 8), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    fixed = [(HEADER, schema.header_text.removeprefix(f"{HEADER}: ")), (DIMENSIONS, "、".join(schema.dimensions[:8])), (METRICS, "、".join(schema.metrics[:8])), (IDENTIFIERS, "、".join(schema.identifiers[:8]))]
    lines = [_line(SHEET, sheet), _line(PLACE, identity), _line(FIELDS, F.array_join(F.slice(fields, 1, 12), "、")), _line(VALUES, F.array_join(some, "；"))]
    lines += [F.lit(f"{label}: {body}") for label, body in fixed if body]
    view = F.when(role == "excel_row_fragment", VIEW_PART).otherwise(VIEW_ROW)
    return F.concat_ws("\n", *lines, F.concat(F.lit(f"{VIEW}: "), view), F.when(base != "", base))


def row_group_text(chunks: DataFrame, by: str, schema: Schema) -> DataFrame:
    """The text of a row's chunks (by, chunk_id, sheet, identity, fields, content) in order, under its place and the table's schema."""
    first = F.min_by(F.struct("sheet", "identity", "fields"), "chunk_id").alias("first")
    texts = F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "content"))), lambda x: _text(x["content"])), lambda t: t != ""), "\n")
    out = chunks.groupBy(by).agg(first, texts.alias("_t"), F.min("chunk_id").alias("anchor"))
    lines = [_line(SHEET, F.col("first.sheet")), _line(PLACE, F.col("first.identity")), _line(ROW_FIELDS, F.array_join(F.slice("first.fields", 1, 12), "、"))]
    body = F.concat_ws("\n", *lines, *([F.lit(schema.table_text)] if schema.table_text else []), F.when(F.col("_t") != "", F.col("_t")))
    return out.select(by, "anchor", body.alias("content"))


def list_rows(rows: DataFrame, search: str = "", searchable: tuple[str, ...] = (), equal: dict[str, str] | None = None, deleted: bool = False, page: int = 1, page_size: int = 20) -> DataFrame:
    """A page of a table's rows (sheet, row_no, row_data as JSON, deleted) by sheet and row: those with a text in any searchable
    column (in the whole row where none is named), and with each given column's text in it."""
    tests = [] if deleted else [~F.col("deleted")]
    if search.strip():
        cells = [filters.json_text("row_data", (c,)) for c in searchable] or [F.col("row_data")]
        tests.append(filters.some([F.coalesce(c.ilike(f"%{search.strip()}%"), F.lit(False)) for c in cells]))
    tests += [filters.json_text("row_data", (c,)).ilike(f"%{v.strip()}%") for c, v in (equal or {}).items() if v.strip()]
    return rows.filter(filters.every(tests)).orderBy("sheet", "row_no").offset(max(page - 1, 0) * page_size).limit(page_size)


def row_uids(rows: DataFrame, doc: str, sheet: str, row_no: str) -> DataFrame:
    """rows with row_uid, the same whenever the same row is read again."""
    return rows.withColumn("row_uid", F.sha2(F.concat_ws("|", F.col(doc).cast("string"), sheet, F.col(row_no).cast("string")), 256))


def sheet_root(rows: DataFrame, sheet: str, fields: Column, filterable: list[str]) -> DataFrame:
    """One text a sheet: name, rows, fields, filter columns."""
    parts = [F.concat(F.lit(f"{SHEET}: "), sheet), F.concat(F.lit("行数: "), F.count("*").cast("string")), F.concat(F.lit("字段: "), F.array_join(F.first(fields), "、"))]
    return rows.groupBy(sheet).agg(F.concat_ws("；", *parts, *([F.lit("过滤列: " + "、".join(filterable))] if filterable else [])).alias("content"))


