"""Permissions, bindings, usage, sessions and caches: small tables that are kept in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.operators.trees import closure


def granted(roles: DataFrame, grants: DataFrame, permissions: DataFrame) -> DataFrame:
    """The different enabled permissions of roles (role_id), from grants (role_id, permission_id)."""
    ids = grants.join(roles, "role_id", "left_semi").select("permission_id").distinct()
    return permissions.filter("enabled").join(ids, "permission_id", "left_semi")


def nested(nodes: DataFrame, node: str, parent: str, order: str) -> DataFrame:
    """Nodes with depth (0: root) and path, an array of (order, node) from the root down: sorted by it they stand as in the
    nested tree, children below their parent by `order`. A node whose parent isn't there is a root."""
    there = nodes.select(F.col(node).alias(parent)).distinct()
    links = nodes.select(node, parent).join(there, parent, "left_semi")
    up = closure(links, node, parent)
    keys = nodes.select(F.col(node).alias("ancestor"), F.struct(order, F.col(node).alias("id")).alias("_k"))
    above = up.join(keys, "ancestor").groupBy("node").agg(F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("d"), "_k"))).alias("_a"))
    out = nodes.join(above.withColumnRenamed("node", node), node, "left")
    path = F.concat(F.transform(F.coalesce("_a", F.array().cast(above.schema["_a"].dataType)), lambda x: x["_k"]), F.array(F.struct(order, F.col(node).alias("id"))))
    return out.withColumn("path", path).withColumn("depth", F.size("path") - 1).drop("_a")


def circular(moves: DataFrame, links: DataFrame, node: str, parent: str) -> DataFrame:
    """Moves (node, new_parent) with circular: the new parent is the node itself or lies below it."""
    below = closure(links, node, parent).select(F.col("node").alias("new_parent"), F.col("ancestor").alias(node), F.lit(True).alias("_c"))
    return moves.join(below, [node, "new_parent"], "left").withColumn("circular", F.coalesce("_c", F.lit(False)) | F.col(node).eqNullSafe(F.col("new_parent"))).drop("_c")


def bound_collections(saved: DataFrame, drafts: DataFrame, collections: DataFrame) -> DataFrame:
    """Collections bound to sessions by priority: a session's drafts (session_id, kb_id, role, enabled, priority, position) stand
    for all that is saved for it; the first binding of a collection counts, a draft's missing priority comes from its place."""
    first = F.row_number().over(Window.partitionBy("session_id", "kb_id").orderBy("position"))
    once = drafts.filter("kb_id is not null").withColumn("_n", first).filter("_n = 1").drop("_n")
    role = F.coalesce("role", F.when(F.col("position") == 0, "primary").otherwise("secondary"))
    once = once.withColumn("role", role).withColumn("priority", F.coalesce("priority", 100 + F.col("position")))
    rest = saved.join(drafts.select("session_id").distinct(), "session_id", "left_anti")
    both = once.select("session_id", "kb_id", "role", "enabled", "priority").unionByName(rest.select("session_id", "kb_id", "role", "enabled", "priority"))
    found = both.filter(F.coalesce("enabled", F.lit(True))).join(collections, "kb_id")
    return found.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy("priority", F.col("kb_id").cast("string"))))


def deletable(tags: DataFrame, *usages: DataFrame) -> DataFrame:
    """Tags that nothing uses; usages have a column tag_id."""
    for used in usages:
        tags = tags.join(used.select("tag_id").distinct(), "tag_id", "left_anti")
    return tags


def deduplicated_refs(refs: DataFrame, by: str, order: str) -> DataFrame:
    """Source references of chunks, each once by the key of its kind, in order: pages by url and place, sheet rows by sheet, row
    and element, boxes by page, element and box, others by page and element. References without their key go.

    refs: ref_type, url, canonical_url, dom_index, sheet_name, row_index, page_no, element_index, bbox.
    """
    kind = F.lower(F.trim(F.coalesce("ref_type", F.lit(""))))
    url, sheet = F.trim(F.coalesce("url", F.lit(""))), F.trim(F.coalesce("sheet_name", F.lit("")))
    canonical = F.when(F.trim(F.coalesce("canonical_url", F.lit(""))) != "", F.trim("canonical_url")).otherwise(url)
    text = lambda *c: F.concat_ws("|", *(x.cast("string") for x in c))
    web = F.when((url != "") & F.col("dom_index").isNotNull(), text(F.lit("web"), url, canonical, F.col("dom_index")))
    row = F.when((sheet != "") & F.col("row_index").isNotNull() & F.col("element_index").isNotNull(), text(F.lit("row"), sheet, F.col("row_index"), F.col("element_index")))
    placed = F.col("page_no").isNotNull() & F.col("element_index").isNotNull()
    boxed = F.coalesce(F.size("bbox") == 4, F.lit(False))
    page = F.when(placed & boxed, text(F.lit("box"), F.col("page_no"), F.col("element_index"), F.array_join(F.transform("bbox", lambda x: x.cast("double").cast("string")), ","))).when(placed, text(F.lit("old"), F.col("page_no"), F.col("element_index")))
    key = F.when(kind == "web_anchor", web).when(kind == "excel_row", row).otherwise(page)
    named = F.when(kind.isin("web_anchor", "excel_row"), kind).when(boxed, "pdf_bbox").otherwise("legacy_element")
    first = F.row_number().over(Window.partitionBy(by, "_k").orderBy(order))
    return refs.withColumn("_k", key).filter("_k is not null").withColumn("ref_type", named).withColumn("_n", first).filter("_n = 1").drop("_k", "_n")


def usage_so_far(frames: DataFrame, by: str, order: str) -> DataFrame:
    """Token counts of streams: the latest of each that isn't null; their sum is the total as soon as both are known."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order)))
    out = frames.groupBy(by).agg(last("input_tokens").alias("input_tokens"), last("output_tokens").alias("output_tokens"), last("total_tokens").alias("_t"))
    return out.withColumn("total_tokens", F.coalesce(F.col("input_tokens") + F.col("output_tokens"), "_t")).drop("_t")


def open_leases(leases: DataFrame, scope: str, now: Column, most: int) -> DataFrame:
    """Leases held by scope at a time, and whether another may be taken."""
    held = leases.filter((F.col("taken_at") <= now) & (F.col("expires_at") > now)).groupBy(scope).agg(F.count("*").alias("held"))
    return leases.select(scope).distinct().join(held, scope, "left").withColumn("held", F.coalesce("held", F.lit(0))).withColumn("free", F.col("held") < most)


def orphan_sessions(refresh: DataFrame, access: DataFrame, key: str) -> DataFrame:
    """Refresh sessions without an access token."""
    return refresh.join(access, key, "left_anti")


def unexpired(rows: DataFrame, expires: str, now: Column) -> DataFrame:
    return rows.filter(F.col(expires).isNull() | (F.col(expires) >= now))


def evicted(cache: DataFrame, used: str, key: str, most: int) -> DataFrame:
    """Entries beyond the `most` newest, the oldest of all. Only what is kept is sorted: the `most` newest are bounded."""
    kept = cache.orderBy(F.desc(used), F.desc(key)).limit(most).select(key)
    return cache.join(kept, key, "left_anti")
