"""Hard filters of a retrieval request, composed into the documents and content groups that may be searched."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.operators import filters, trees
from granary.operators.filters import Node

UUID = r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"
LATEST_DAYS = 90

# The names under which a leaf speaks of each thing.
DOC_FIELDS = ("kb_doc", "kb_doc_id")
FILE_FIELDS = ("document", "document_id")
FOLDER_FIELDS = ("folder", "folder_id")
FOLDER_TAG_FIELDS = ("folder_tag", "folder_tag_id")
TAG_FIELDS = ("tag", "doc_tag", "tag_id")
METADATA_FIELDS = ("metadata", "document_metadata")
UNIT_FIELDS = ("search_unit_metadata",)
QA_KEYS = {"category": "category", "tag": "tag", "tags": "tag"}


def id_list(value: Any, pattern: str = UUID) -> tuple[str, ...]:
    """Ids out of one value or a list: ill-formed ones go, each once, in order."""
    values = value if isinstance(value, (list, tuple, set)) else [] if value is None else [value]
    return tuple(dict.fromkeys(t for t in (str(v).strip() for v in values) if re.fullmatch(pattern, t)))


@dataclass(frozen=True)
class FilterSet:
    """What a request filters by. row_fields and qa_fields are tested on a table's or a question set's rows."""

    kb_doc_ids: tuple[str, ...] = ()
    document_ids: tuple[str, ...] = ()
    content_group_ids: tuple[str, ...] = ()
    folder_ids: tuple[str, ...] = ()
    tag_ids: tuple[str, ...] = ()
    folder_tag_ids: tuple[str, ...] = ()
    document_metadata: tuple[tuple[str, Any], ...] = ()
    row_fields: tuple[tuple[str, Any], ...] = ()
    qa_fields: tuple[tuple[str, Any], ...] = ()
    expression: Node | None = None
    descendants: bool = True
    only_tagged: bool = False
    latest_days: int | None = None


def normalized(raw: Mapping[str, Any] | None, mode: str = "all", pattern: str = UUID) -> FilterSet:
    """A request's filters; mode `latest` keeps 90 days, `tagged` what has any tag."""
    r = dict(raw or {})
    ids = lambda *names: id_list(next((r[n] for n in names if r.get(n)), None), pattern)
    pairs = lambda x: tuple((str(k).strip(), v) for k, v in dict(x or {}).items() if str(k).strip())
    unit = dict(r.get("search_unit_metadata") or {})
    return FilterSet(
        ids("kb_doc_ids"),
        ids("document_ids"),
        ids("content_group_ids"),
        ids("folder_ids", "folder_id"),
        ids("tag_ids", "tag_id"),
        ids("folder_tag_ids", "folder_tag_id"),
        pairs(r.get("metadata") or r.get("document_metadata")),
        pairs(unit.get("filter_fields")),
        pairs(unit.get("qa_fields")),
        filters.parse(r.get("filter_expression") or r.get("expression")),
        bool(r.get("include_descendant_folders", True)),
        mode == "tagged" or bool(r.get("only_tagged", False)),
        LATEST_DAYS if mode == "latest" else None,
    )


def _moved(f: FilterSet, names: Mapping[str, str], into: str) -> FilterSet:
    """Document fields of these names become fields of rows; empty values go."""
    of = dict(getattr(f, into)) | {names[k]: v for k, v in f.document_metadata if k in names and v not in (None, "")}
    left = tuple((k, v) for k, v in f.document_metadata if k not in names)
    return replace(f, document_metadata=left, **{into: tuple(of.items())})


def table_fields(f: FilterSet, filterable: list[str]) -> FilterSet:
    """Filters on a table's filterable columns are tested on its rows."""
    return _moved(f, {c: c for c in filterable}, "row_fields")


def qa_fields(f: FilterSet) -> FilterSet:
    """Filters on category and tag are tested on questions and answers."""
    return _moved(f, QA_KEYS, "qa_fields")


def with_tags(docs: DataFrame, bindings: DataFrame, folder_bindings: DataFrame | None = None) -> DataFrame:
    """Adds tags, and folder_tags, of each document: arrays of text, from (target, tag) of documents and of folder paths."""
    none = F.array().cast("array<string>")
    of = lambda b, key, name: b.groupBy(F.col("target").alias(key)).agg(F.collect_set(F.col("tag").cast("string")).alias(name))
    out = docs.join(of(bindings, "kb_doc_id", "tags"), "kb_doc_id", "left").withColumn("tags", F.coalesce("tags", none))
    if folder_bindings is None:
        return out.withColumn("folder_tags", none)
    return out.join(of(folder_bindings, "folder", "folder_tags"), "folder", "left").withColumn("folder_tags", F.coalesce("folder_tags", none))


def _texts(values) -> Column:
    return F.array(*(F.lit(str(v)) for v in values)).cast("array<string>")


def _in_folders(values, descendants: bool) -> Column:
    return F.arrays_overlap(trees.prefixes("folder"), _texts(values)) if descendants else F.col("folder").isin(*values)


def _overlap(name: str, node: Node) -> Column:
    """A leaf over a document's tags: any of the values; a negation none of them."""
    if node.op in ("exists", "not_exists"):
        any_ = F.size(name) > 0
    else:
        any_ = F.arrays_overlap(name, _texts(node.values))
    return ~any_ if node.op in ("ne", "not_in", "not_exists") else any_


def _metadata(node: Node) -> Column:
    """A leaf over two JSON sources, the document's own and its file's."""
    if not node.path:
        return F.lit(False)
    a, b = filters.json_text("custom", node.path), filters.json_text("info", node.path)
    if node.op in ("exists", "not_exists"):
        either = a.isNotNull() | b.isNotNull()
        return either if node.op == "exists" else ~either
    return filters.two_sources(a, b, node.op, list(node.values))


def expression_condition(node: Node, descendants: bool = True, unit: str | None = None) -> Column:
    """A tree as a condition over documents with tags; leaves over search units read the JSON column `unit`."""
    if node.items:
        parts = [expression_condition(n, descendants, unit) for n in node.items]
        return filters.every(parts) if node.op == "and" else filters.some(parts) if node.op == "or" else ~parts[0]
    ids = lambda c: F.col(c).isNotNull() if node.op == "exists" else F.col(c).isNull() if node.op == "not_exists" else filters.id_condition(F.col(c).cast("string"), node.op, list(node.values))
    if node.field in DOC_FIELDS:
        return ids("kb_doc_id")
    if node.field in FILE_FIELDS:
        return ids("document_id")
    if node.field in FOLDER_FIELDS:
        if node.op in ("exists", "not_exists"):
            return ids("folder")
        inside = F.coalesce(_in_folders(node.values, descendants), F.lit(False))
        return inside if node.op in ("eq", "in") else ~inside
    if node.field in TAG_FIELDS:
        return _overlap("tags", node)
    if node.field in FOLDER_TAG_FIELDS:
        return _overlap("folder_tags", node)
    if node.field in METADATA_FIELDS:
        return _metadata(node)
    if node.field in UNIT_FIELDS and unit:
        return filters.over_json(node, unit) if node.path else F.lit(False)
    raise ValueError(f"no condition for {node.field}")


def signal_conditions(signals: Mapping[str, tuple[str, list[str]]]) -> list[Column]:
    """Detected metadata filters, key -> (mode, values): any value of a key, all keys; without `match_only` a document
    that has no value passes."""
    out = []
    for key, (mode, values) in signals.items():
        texts = [t for t in dict.fromkeys(filters.as_text(v) for v in values) if t.strip()]
        if texts:
            a, b = (filters.json_text(c, (key,)) for c in ("custom", "info"))
            match = filters.two_sources(a, b, "in", texts)
            out.append(match if mode == "match_only" else match | (a.isNull() & b.isNull()))
    return out


def collected_signals(signals: DataFrame) -> DataFrame:
    """Signals (key, value, match_mode) drawn together: key, values, mode; `match_only` wins over the looser mode."""
    only = F.max((F.col("match_mode") == "match_only").cast("int")) == 1
    return signals.filter(F.trim("value") != "").groupBy("key").agg(F.array_sort(F.collect_set("value")).alias("values"), F.when(only, "match_only").otherwise("match_or_missing").alias("mode"))


def candidate_documents(docs: DataFrame, f: FilterSet, now: Column, signals: Mapping[str, tuple[str, list[str]]] | None = None) -> DataFrame:
    """Documents that pass every document-level filter.

    docs: kb_doc_id, document_id, folder (dotted path), status, enabled, custom, info (JSON), parsed_at, updated_at, and
    tags, folder_tags (`with_tags`). An expression with leaves over search units is left to the recall.
    """
    tests = [F.col("status") == "completed", F.col("enabled")]
    if f.kb_doc_ids:
        tests.append(F.col("kb_doc_id").cast("string").isin(*f.kb_doc_ids))
    if f.document_ids:
        tests.append(F.col("document_id").cast("string").isin(*f.document_ids))
    if f.folder_tag_ids:
        tests.append(F.size(F.array_except(_texts(f.folder_tag_ids), F.col("folder_tags"))) == 0)
    if f.folder_ids:
        tests.append(_in_folders(f.folder_ids, f.descendants))
    if f.latest_days is not None:
        since = now - F.expr(f"INTERVAL {max(1, f.latest_days)} DAYS")
        tests.append(F.coalesce(F.col("parsed_at") >= since, F.lit(False)) | F.coalesce(F.col("updated_at") >= since, F.lit(False)))
    for key, value in f.document_metadata:
        tests.append(filters.two_sources(filters.json_text("custom", (key,)), filters.json_text("info", (key,)), "eq", [filters.as_text(value)]))
    if f.expression and not filters.uses(f.expression, set(UNIT_FIELDS)):
        tests.append(expression_condition(f.expression, f.descendants))
    tests += signal_conditions(signals or {})
    if f.tag_ids:
        tests.append(F.size(F.array_except(_texts(f.tag_ids), F.col("tags"))) == 0)
    elif f.only_tagged:
        tests.append(F.size("tags") > 0)
    return docs.filter(filters.every(tests))


def table_groups(rows: DataFrame, docs: DataFrame, f: FilterSet) -> DataFrame:
    """Content groups of table rows (group_id, kb_doc_id, row_data as JSON, deleted) whose cells equal every row field."""
    tests = [filters.json_text("row_data", (k,)) == filters.as_text(v) for k, v in f.row_fields]
    return rows.filter(~F.col("deleted") & filters.every(tests)).join(docs.select("kb_doc_id"), "kb_doc_id", "left_semi").select("group_id")


def qa_groups(rows: DataFrame, docs: DataFrame, f: FilterSet) -> DataFrame:
    """Content groups of questions and answers (group_id, kb_doc_id, category, tags, enabled) of a category and a tag."""
    wanted = {k: str(v).strip() for k, v in f.qa_fields}
    tests = [F.col("category") == wanted["category"]] if wanted.get("category") else []
    tests += [F.array_contains("tags", wanted["tag"])] if wanted.get("tag") else []
    return rows.filter(F.col("enabled") & filters.every(tests)).join(docs.select("kb_doc_id"), "kb_doc_id", "left_semi").select("group_id")


def searchable_units(index: DataFrame, units: DataFrame, chunks: DataFrame, docs: DataFrame, scopes: tuple[str, ...], dimension: int | None = None, expression: Node | None = None) -> DataFrame:
    """Rows of an index joined with their unit, chunk and document, as far as all of them may be searched.

    index: unit_id and what is searched; units: unit_id, chunk_id, scope, active, unit_meta; chunks: chunk_id,
    kb_doc_id, is_leaf, chunk_active; docs: what `candidate_documents` leaves. A whole document's summary needs no leaf.
    """
    if dimension is not None:
        index = index.filter(F.size("embedding") == dimension)
    live = units.filter(F.col("active") & F.col("scope").isin(*scopes))
    parts = chunks.filter("chunk_active")
    out = index.join(live, "unit_id").join(parts, "chunk_id").filter(F.col("is_leaf") | (F.col("scope") == "doc_summary")).join(docs, "kb_doc_id")
    return out.filter(expression_condition(expression, unit="unit_meta")) if expression else out
