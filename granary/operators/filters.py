"""Filters: the list query's operators, and filter trees over JSON metadata, ids and tags."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.sources.scratch import scratch_path

MOST_DEPTH, MOST_CHILDREN, MOST_VALUES = 8, 32, 64

COMPARISONS = {
    "eq": lambda c, v: c == v,
    "ne": lambda c, v: c != v,
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
    "like": lambda c, v: c.ilike(f"%{v}%"),
    "in": lambda c, v: c.isin(*v) if isinstance(v, (list, tuple)) else F.lit(True),
    "not_in": lambda c, v: ~c.isin(*v) if isinstance(v, (list, tuple)) else F.lit(True),
    "is_null": lambda c, _: c.isNull(),
    "is_not_null": lambda c, _: c.isNotNull(),
}


def every(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def some(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


@dataclass(frozen=True)
class ListRequest:
    """What a list query asks for. Wildcards in searched text are not escaped; unknown columns are ignored."""

    equal: tuple[tuple[str, Any], ...] = ()
    advanced: tuple[tuple[str, str, Any], ...] = ()
    search: str | None = None
    search_columns: tuple[str, ...] = ()
    sort: tuple[tuple[str, bool], ...] = ()
    tie: str | None = None
    page: int = 1
    page_size: int = 20


def matching(df: DataFrame, request: ListRequest) -> DataFrame:
    tests = [F.col(c) == v for c, v in request.equal if c in df.columns]
    tests += [COMPARISONS[op](F.col(c), v) for c, op, v in request.advanced if c in df.columns and op in COMPARISONS]
    if request.search and request.search_columns:
        tests.append(some([F.col(c).ilike(f"%{request.search}%") for c in request.search_columns]))
    return df.filter(every(tests))


def page(df: DataFrame, request: ListRequest) -> DataFrame:
    """One page: the sort's columns (True: descending), ties by one more column."""
    order = [F.desc_nulls_last(c) if down else F.asc_nulls_first(c) for c, down in request.sort]
    order += [F.asc(request.tie)] if request.tie else []
    found = matching(df, request)
    return (found.orderBy(*order) if order else found).offset((request.page - 1) * request.page_size).limit(request.page_size)


def total(df: DataFrame, request: ListRequest) -> DataFrame:
    return matching(df, request).agg(F.count("*").alias("total"))


# Filter trees


@dataclass(frozen=True)
class Node:
    op: str
    field: str = ""
    path: tuple[str, ...] = ()
    values: tuple[str, ...] = ()
    items: tuple[Node, ...] = ()


def as_text(value: Any) -> str:
    """How a value is compared: booleans as true and false, everything else as its text."""
    return str(value).lower() if isinstance(value, bool) else str(value)


LEAVES = ("eq", "ne", "in", "not_in", "exists", "not_exists")


def parse(raw: Any, depth: int = 1) -> Node | None:
    """A tree of and, or, not and leaves from nested dicts; bad nodes are dropped, and groups of one drawn together."""
    if not isinstance(raw, dict) or depth > MOST_DEPTH:
        return None
    op = str(raw.get("op", "")).lower()
    if op in ("and", "or", "not"):
        items = tuple(n for n in (parse(x, depth + 1) for x in list(raw.get("items") or [])[:MOST_CHILDREN]) if n)
        if not items:
            return None
        if op == "not":
            return Node("not", items=(items[0] if len(items) == 1 else Node("and", items=items),))
        return items[0] if len(items) == 1 else Node(op, items=items)
    if op not in LEAVES or not raw.get("field"):
        return None
    values = raw.get("values", raw.get("value"))
    values = [] if values is None else values if isinstance(values, (list, tuple)) else [values]
    texts = tuple(dict.fromkeys(as_text(v) for v in list(values)[:MOST_VALUES] if v is not None))
    if op in ("eq", "ne", "in", "not_in") and not texts:
        return None
    path = raw.get("path") or ()
    return Node(op, str(raw["field"]), tuple(map(str, path if isinstance(path, (list, tuple)) else str(path).split("."))), texts)


def uses(node: Node | None, fields: set[str]) -> bool:
    """Whether any leaf is over one of the fields."""
    return node is not None and (node.field in fields or any(uses(n, fields) for n in node.items))


def only(node: Node | None, fields: set[str]) -> Node | None:
    """The tree without leaves over other fields. A disjunction or negation that loses a part goes as a whole, as the rest would be stricter."""
    if node is None or not node.items:
        return node if node is None or node.field in fields else None
    kept = [only(n, fields) for n in node.items]
    if node.op == "and":
        left = tuple(n for n in kept if n)
        return left[0] if len(left) == 1 else Node("and", items=left) if left else None
    return Node(node.op, items=tuple(kept)) if all(n is not None and n == m for n, m in zip(kept, node.items, strict=True)) else None


def both(a: Node | None, b: Node | None) -> Node | None:
    """Two trees that must hold together: the second can only tighten."""
    return Node("and", items=(a, b)) if a and b else a or b


def json_text(column: str, path: tuple[str, ...]) -> Column:
    return F.get_json_object(F.col(column), "$" + "".join(f"['{p}']" for p in path))


def predicate(node: Node, value_of) -> Column:
    """The tree as a condition; value_of(node) gives the text that a leaf compares. Unlike `not (eq)`, `ne` and `not_in`
    hold where the value is missing."""
    if node.op == "and":
        return every([predicate(n, value_of) for n in node.items])
    if node.op == "or":
        return some([predicate(n, value_of) for n in node.items])
    if node.op == "not":
        return ~predicate(node.items[0], value_of)
    value = value_of(node)
    if node.op == "exists":
        return value.isNotNull()
    if node.op == "not_exists":
        return value.isNull()
    inside = value.isin(*node.values)
    return inside if node.op in ("eq", "in") else value.isNull() | ~inside


def over_json(node: Node, column: str) -> Column:
    return predicate(node, lambda leaf: json_text(column, leaf.path or (leaf.field,)))


def id_condition(c: Column, op: str, values: list) -> Column:
    """An id in or not in a list; an empty list holds for nothing, or for everything."""
    inside = c.isin(*values) if values else F.lit(False)
    return inside if op in ("eq", "in") else ~inside


def two_sources(a: Column, b: Column, op: str, values: list[str]) -> Column:
    """A leaf over two sources: either may match; a negation needs both to miss."""
    if op in ("eq", "in"):
        return F.coalesce(a.isin(*values), F.lit(False)) | F.coalesce(b.isin(*values), F.lit(False))
    return (a.isNull() | ~a.isin(*values)) & (b.isNull() | ~b.isin(*values))


def tagged_with_all(bindings: DataFrame, target: str, tag: str, tags: list) -> DataFrame:
    """Targets that carry every tag."""
    found = bindings.filter(F.col(tag).isin(*tags)).groupBy(target).agg(F.countDistinct(tag).alias("_n"))
    return found.filter(F.col("_n") >= len(set(tags))).select(target)


def json_paths(rows: DataFrame, column: str, most: int = 20) -> DataFrame:
    """path, n, values: the scalar fields found in JSON objects, nested ones by dotted path however deep, with how many values
    they have and up to `most` of the different values, the least ones. Items of arrays count as values of the array, each."""
    spark = rows.sparkSession
    level, tables = rows.select(F.lit("").alias("above"), F.col(column).alias("json")), []
    while True:
        pairs = level.select("above", F.explode(F.from_json("json", "map<string,string>")).alias("key", "value")).filter("trim(key) <> '' and value is not null")
        # Each level is read from its own table, so that a deep one doesn't parse all above it again.
        path = scratch_path(spark, "json-paths")
        pairs.select(F.concat("above", F.trim("key")).alias("path"), "value").write.parquet(path)
        pairs = spark.read.schema("path string, value string").parquet(path)
        nested, listed = F.col("value").rlike(r"^\s*\{"), F.col("value").rlike(r"^\s*\[")
        items = pairs.filter(listed).select("path", F.explode(F.from_json("value", "array<string>")).alias("value")).filter(~F.col("value").rlike(r"^\s*[\[{]"))
        tables.append(pairs.filter(~nested & ~listed).unionByName(items))
        deeper = pairs.filter(nested)
        if deeper.isEmpty():
            break
        level = deeper.select(F.concat("path", F.lit(".")).alias("above"), F.col("value").alias("json"))
    found = reduce(DataFrame.unionByName, tables).filter("trim(value) <> ''")
    first = F.row_number().over(Window.partitionBy("path").orderBy("value"))
    few = found.distinct().withColumn("_n", first).filter(F.col("_n") <= most).groupBy("path").agg(F.array_sort(F.collect_list("value")).alias("values"))
    return found.groupBy("path").agg(F.count("*").alias("n")).join(few, "path")
