"""Filter trees over JSON metadata and tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators import filters
from granary.plans.registry import query
from granary.sources.tables import table

K = "json_extract_string(props, '$.k')"
LEAF = {"field": "k", "path": ["k"]}


def _tree(name: str, raw: dict, sql: str) -> None:
    @query(f"SELECT event_id, event_type FROM events WHERE {sql}", name=name)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        node = filters.parse(raw)
        assert node is not None
        return table(spark, sf_dir, "events").filter(filters.over_json(node, "props")).select("event_id", "event_type")


_tree("json_eq", {"op": "eq", **LEAF, "value": 69}, f"{K} = '69'")
_tree("json_ne_or_missing", {"op": "ne", **LEAF, "value": 69}, f"{K} IS NULL OR {K} <> '69'")
_tree("json_not_eq", {"op": "not", "items": [{"op": "eq", **LEAF, "value": 69}]}, f"NOT ({K} = '69')")
_tree("json_in", {"op": "in", **LEAF, "values": [1, 2, 3, "x"]}, f"{K} IN ('1', '2', '3', 'x')")
_tree("json_not_in", {"op": "not_in", **LEAF, "values": [1, 2, 3]}, f"{K} IS NULL OR {K} NOT IN ('1', '2', '3')")
_tree("json_exists", {"op": "exists", **LEAF}, f"{K} IS NOT NULL")
_tree("json_not_exists", {"op": "not_exists", "field": "none", "path": "none"}, "json_extract_string(props, '$.none') IS NULL")
_tree(
    "json_tree",
    {"op": "and", "items": [{"op": "or", "items": [{"op": "in", **LEAF, "values": list(range(40))}, {"op": "eq", **LEAF, "value": 77}]}, {"op": "not", "items": [{"op": "eq", **LEAF, "value": 7}]}, {"op": "bad"}]},
    f"({K} IN ({', '.join(repr(str(i)) for i in range(40))}) OR {K} = '77') AND NOT ({K} = '7')",
)


@query(f"SELECT event_id FROM events WHERE coalesce({K} IN ('5', '6'), false) OR coalesce(event_type IN ('5', '6', 'view'), false)")
def two_source_leaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value that may be in the metadata or in a column."""
    events = table(spark, sf_dir, "events")
    return events.filter(filters.two_sources(filters.json_text("props", ("k",)), F.col("event_type"), "in", ["5", "6", "view"])).select("event_id")


@query(f"SELECT event_id FROM events WHERE ({K} IS NULL OR {K} NOT IN ('5', '6')) AND (event_type IS NULL OR event_type NOT IN ('5', '6', 'view'))".replace("'5', '6')) AND", "'5', '6', 'view')) AND"))
def two_source_negated_leaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.filter(filters.two_sources(filters.json_text("props", ("k",)), F.col("event_type"), "not_in", ["5", "6", "view"])).select("event_id")


@query("SELECT l_orderkey AS target FROM lineitem WHERE l_linenumber IN (1, 2, 3) GROUP BY 1 HAVING count(DISTINCT l_linenumber) = 3")
def all_tags_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets with all of three tags."""
    bindings = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("target"), F.col("l_linenumber").alias("tag"))
    return filters.tagged_with_all(bindings, "target", "tag", [1, 2, 3])


@query("SELECT l_orderkey AS target FROM lineitem WHERE l_returnflag IN ('A', 'N') GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 2")
def tagged_with_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    bindings = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("target"), F.col("l_returnflag").alias("tag"))
    return filters.tagged_with_all(bindings, "target", "tag", ["A", "N"])


@query(f"SELECT {K} AS value, count(*) AS n FROM events WHERE {K} IS NOT NULL GROUP BY 1")
def json_key_enum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of one metadata key and how many rows have each."""
    value = filters.json_text("props", ("k",))
    return table(spark, sf_dir, "events").filter(value.isNotNull()).groupBy(value.alias("value")).agg(F.count("*").alias("n"))


@query(
    """WITH e AS (SELECT 'k' AS path, json_extract_string(props, '$.k') AS value FROM events UNION ALL SELECT 'at.kind', event_type FROM events UNION ALL SELECT 'at.deep.half', (event_id % 2)::VARCHAR FROM events UNION ALL SELECT 'tags', 't' || event_id % 30 FROM events UNION ALL SELECT 'tags', 'all' FROM events),
    d AS (SELECT DISTINCT path, value FROM e QUALIFY dense_rank() OVER (PARTITION BY path ORDER BY value) <= 20)
    SELECT path, (SELECT count(*) FROM e WHERE e.path = d.path) AS n, string_agg(value, ',' ORDER BY value) AS "values" FROM d GROUP BY 1"""
)
def json_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields found in nested metadata, how many rows have them, and some of their values."""
    key = F.col("event_id")
    deep = F.struct(F.col("event_type").alias("kind"), F.struct((key % 2).alias("half"), F.lit(None).cast("string").alias("none")).alias("deep"))
    doc = F.to_json(F.struct(F.get_json_object("props", "$.k").alias("k"), deep.alias("at"), F.array(F.concat(F.lit("t"), key % 30), F.lit("all")).alias("tags"), F.lit(" ").alias("blank")))
    return filters.json_paths(table(spark, sf_dir, "events").select(doc.alias("doc")), "doc").withColumn("values", F.array_join("values", ","))


@query(
    """SELECT k, mode_only, values FROM (SELECT o_orderpriority AS k, bool_or(o_orderstatus = 'P') AS mode_only, array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS values FROM orders GROUP BY 1)"""
)
def grouped_auto_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter signals by key: values of one key are alternatives, and one strict signal makes the key strict."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("k")).agg(
        F.bool_or(F.col("o_orderstatus") == "P").alias("mode_only"), F.array_join(F.array_sort(F.collect_set("o_orderstatus")), ",").alias("values")
    )
