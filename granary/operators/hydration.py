"""Filling grouped hits with what is shown and sent on: the unit to show, its context, document, tags and metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.text import strip, truncated
from granary.operators.ranking import numbered

# Labels of the parts of a context.
BEFORE, AFTER, PARENT, HIT = "[前文邻近块]", "[后文邻近块]", "[父块上下文]", "[命中子块]"
QUESTION, WHOLE_ANSWER, PART_OF_ANSWER = "[问题]", "[完整答案]", "[命中答案片段]"
SHEET, PLACE, FIELDS = "工作表", "定位", "字段"
# What is always shown as a complete unit.
COMPLETE_KINDS = ("qa", "table")
COMPLETE_SCOPES = ("row", "row_group", "row_fragment", "answer")
COMPLETE_ROLES = ("excel_row_fragment", "excel_row", "web_table_fragment", "web_table_parent", "web_table_leaf", "qa_answer_fragment", "qa_row")
MOST_FIELDS = 12


def _t(c: Column) -> Column:
    return strip(F.coalesce(c, F.lit("")))


def _filled(c: Column) -> Column:
    return F.when(_t(c) != "", _t(c))


def needs_complete_unit(kind: str, source_type: Column, role: Column, scope: Column) -> Column:
    """Whether a hit is shown as the whole row or the whole answer that it belongs to."""
    low = lambda c: F.lower(_t(c))
    return F.lit(kind.lower() in COMPLETE_KINDS) | (low(source_type) == "table") | low(scope).isin(*COMPLETE_SCOPES) | low(role).isin(*COMPLETE_ROLES)


def with_neighbours(core: Column, previous: Column, following: Column) -> Column:
    """A text between the texts before and after it, under their labels."""
    joined = lambda c: F.array_join(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), _t), lambda x: x != ""), "\n")
    side = lambda label, c: F.when(joined(c) != "", F.concat(F.lit(f"{label}\n"), joined(c)))
    return F.concat_ws("\n", side(BEFORE, previous), _filled(core), side(AFTER, following))


def table_context(sheet: Column, place: Column, fields: Column, extra: Column) -> Column:
    line = lambda label, c: F.when(_t(c) != "", F.concat(F.lit(f"{label}: "), _t(c)))
    names = F.array_join(F.slice(F.filter(F.coalesce(fields, F.array().cast("array<string>")), lambda x: _t(x) != ""), 1, 6), "、")
    return F.concat_ws("\n", line(SHEET, sheet), line(PLACE, place), line(FIELDS, names), _filled(extra))


def context_text(chunk: Column, parent: Column, parent_context: bool) -> Column:
    """What is sent on for a chunk: rows of tables under their place, parts of answers with their question and the whole
    answer, others with their parent, where that is asked for.

    chunk: struct of content, source_type, role, question, sheet, place, fields, extra; parent: struct of content, summary.
    """
    place = table_context(chunk["sheet"], chunk["place"], chunk["fields"], chunk["extra"])
    child = F.when((chunk["source_type"] == "table") & (place != ""), F.concat_ws("\n", place, _filled(chunk["content"]))).otherwise(_t(chunk["content"]))
    above = F.when(_t(parent["summary"]) != "", _t(parent["summary"])).otherwise(_t(parent["content"])) if parent_context else F.lit("")
    question = _t(chunk["question"])
    asked = F.concat(F.lit(f"{QUESTION} "), question, F.lit("\n"))
    answered = F.when(above != "", F.concat(asked, F.lit(f"{WHOLE_ANSWER} "), above)).otherwise(F.concat(asked, F.lit(f"{PART_OF_ANSWER} "), child))
    below = F.when(above != "", F.concat(F.lit(f"{PARENT} "), above, F.lit(f"\n{HIT} "), child)).otherwise(child)
    return F.when((chunk["role"] == "qa_answer_fragment") & (question != ""), answered).otherwise(below)


def group_metadata(hits: DataFrame) -> DataFrame:
    """By group_key, from hits (group_key, seq, sheet, place, context, fields, question, filter_fields): the first of each text
    that isn't empty, the different field names in order, and each filter's first value. A group has a bounded number of hits."""
    first = lambda c: F.min_by(_filled(F.col(c)), F.when(_t(F.col(c)) != "", F.col("seq"))).alias(c)
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("seq", (F.col(c) if isinstance(c, str) else c).alias("x")))), lambda s: s["x"])
    names = F.filter(F.transform(F.flatten(F.filter(in_order("fields"), lambda x: x.isNotNull())), _t), lambda x: x != "")
    entries = F.flatten(F.filter(in_order(F.map_entries("filter_fields")), lambda x: x.isNotNull()))
    good = F.filter(F.transform(entries, lambda e: F.struct(_t(e["key"]).alias("key"), _t(e["value"]).alias("value"))), lambda e: (e["key"] != "") & (e["value"] != ""))
    once = F.transform(F.array_distinct(F.transform(good, lambda e: e["key"])), lambda k: F.struct(k, F.element_at(F.filter(good, lambda e: e["key"] == k), 1)["value"]))
    return hits.groupBy("group_key").agg(first("sheet"), first("place"), first("context"), first("question"), F.slice(F.array_distinct(names), 1, MOST_FIELDS).alias("fields"), F.map_from_entries(once).alias("filter_fields"), F.array_sort(F.collect_set("scope")).alias("scopes"), F.array_sort(F.collect_set("backend")).alias("backends"))


def hydrated(groups: DataFrame, chunks: DataFrame, documents: DataFrame, tags: DataFrame, kind: str, mode: str = "recursive", parent_context: bool = True, window: int = 0, snippet: int = 200) -> DataFrame:
    """Grouped hits (group_key, score, anchor, scope, kb_doc_id, order) with title, shown chunk, unit kind, content, context,
    snippet, tags and rank. Groups whose document is gone go; so do those whose chunk is gone, but for a document's summary.

    chunks: chunk_id, parent_id, kb_doc_id, position, content, summary, role, source_type, question, sheet, place, fields, extra;
    documents: kb_doc_id, title, doc_summary; tags: kb_doc_id, tag. Modes: leaf_only, recursive, auto_merge.
    """
    around = chunks
    if window and mode in ("leaf_only", "recursive"):
        text = F.when(_t(F.col("summary")) != "", F.col("summary")).otherwise(F.col("content"))
        of_doc = Window.partitionBy("kb_doc_id").orderBy("position")
        # Only the documents of the groups are ordered.
        near = chunks.join(groups.select("kb_doc_id").distinct(), "kb_doc_id", "left_semi")
        around = near.withColumn("previous", F.collect_list(text).over(of_doc.rowsBetween(-window, -1))).withColumn("following", F.collect_list(text).over(of_doc.rowsBetween(1, window)))
    else:
        around = chunks.withColumns({c: F.array().cast("array<string>") for c in ("previous", "following")})
    parts = ("chunk_id", "content", "summary", "role", "source_type", "question", "sheet", "place", "fields", "extra")
    hit = around.select(F.col("chunk_id").alias("anchor"), "parent_id", "previous", "following", F.struct(*parts).alias("hit"))
    above = chunks.select(F.col("chunk_id").alias("parent_id"), F.struct(*parts).alias("parent"))
    own = tags.groupBy("kb_doc_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    out = groups.join(documents, "kb_doc_id").join(hit, "anchor", "left").join(above, "parent_id", "left").join(own, "kb_doc_id", "left")
    gone = F.col("hit").isNull()
    out = out.filter(~gone | (F.col("scope") == "doc_summary"))
    has_parent = F.col("parent").isNotNull()
    forced = needs_complete_unit(kind, F.col("hit.source_type"), F.col("hit.role"), F.col("scope")) & has_parent
    promoted = F.lit(mode == "auto_merge") & has_parent & (F.col("hit.role") == "leaf")
    up = F.coalesce(forced | promoted, F.lit(False))
    shown = F.when(up, F.col("parent")).otherwise(F.col("hit"))
    unit = F.when(gone, "doc_summary").when(up, "complete_unit").otherwise("leaf")
    plain = context_text(F.col("hit"), F.col("parent"), parent_context and mode == "recursive")
    context = F.when(gone, _t(F.col("doc_summary"))).when(up, context_text(F.col("parent"), F.lit(None).cast("struct<content:string,summary:string>"), False)).otherwise(with_neighbours(plain, F.col("previous"), F.col("following")))
    out = out.withColumn("unit_kind", unit).withColumn("context", context).withColumn("shown", F.when(~gone, shown["chunk_id"])).withColumn("content", F.when(gone, _t(F.col("doc_summary"))).otherwise(_t(shown["content"])))
    none = F.array().cast(out.schema["tags"].dataType)
    return numbered(out, "rank", "order").select("group_key", "rank", F.round("score", 4).alias("score"), "kb_doc_id", "title", "shown", "unit_kind", "content", "context", truncated(F.col("context"), snippet).alias("snippet"), F.coalesce("tags", none).alias("tags"))


def result_summary(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of results (rank, kb_doc_id, scopes, bonus, boost): how many there are, their documents, how many have a bonus or a
    boost; and how many each scope has."""
    some = lambda c: F.count(F.when(F.coalesce(c, F.lit(0.0)) > 0, 1)).alias(f"with_{c}")
    return items.agg(F.count("*").alias("items"), F.countDistinct("kb_doc_id").alias("documents"), some("bonus"), some("boost")), items.select(F.explode("scopes").alias("scope")).groupBy("scope").agg(F.count("*").alias("items"))
