"""Questions and answers: here a user's turn is a question and the turn after it the answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.operators import qa
from granary.plans.registry import query
from granary.sources.tables import table

SIZE, OVERLAP = 300, 60

# Units are packed in one reduction over strings: chr(1) parts chunks, chr(2) marks a window, which stands alone.
ROWS = r"""n AS (SELECT conv_id, turn, role, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM conversations),
r AS (SELECT conv_id * 100 + turn AS row_id, trim(text, E' \n\t') AS question, trim(coalesce(answer, ''), E' \n\t') AS answer, CASE WHEN turn % 4 = 0 THEN ['again ' || conv_id] ELSE []::VARCHAR[] END AS alike, CASE WHEN conv_id % 2 = 0 THEN 'even' ELSE '' END AS category,
  CASE WHEN conv_id % 3 = 0 THEN ['a', 'b'] ELSE []::VARCHAR[] END AS tags, CASE WHEN conv_id % 5 = 0 THEN 'Sheet' ELSE NULL END AS sheet, turn AS source_row FROM n WHERE role = 'user'),
k AS (SELECT * FROM r WHERE question <> '' AND answer <> ''),
p AS (SELECT *, list_filter(list_transform(regexp_split_to_array(answer, '\n{2,}'), lambda x: trim(x, E' \n\t')), lambda x: x <> '') AS paragraphs FROM k),
u AS (SELECT * EXCLUDE paragraphs, flatten(list_transform(paragraphs, lambda x: CASE WHEN length(x) <= 200 THEN [x] ELSE list_filter(list_transform(string_split(regexp_replace(regexp_replace(x, '([。！？!?；;])', '\1' || chr(4), 'g'), '\.\s+', '.' || chr(4), 'g'), chr(4)), lambda y: trim(y, E' \n\t')), lambda y: y <> '') END)) AS units FROM p),
w AS (SELECT * EXCLUDE units, flatten(list_transform(units, lambda x: CASE WHEN length(x) <= 300 THEN [x] ELSE list_transform(range(1, greatest(length(x) - 60, 1) + 1, 240), lambda i: chr(2) || substr(x, i, 300)) END)) AS units FROM u),
c AS (SELECT * EXCLUDE units, CASE WHEN length(answer) <= 300 THEN [answer] ELSE list_transform(string_split(list_reduce(units, lambda acc, x: CASE WHEN NOT starts_with(x, chr(2)) AND NOT starts_with(string_split(acc, chr(1))[-1], chr(2)) AND length(string_split(acc, chr(1))[-1]) + 1 + length(x) <= 300 THEN acc || chr(10) || x ELSE acc || chr(1) || x END), chr(1)), lambda x: replace(x, chr(2), '')) END AS parts FROM w),
a AS (SELECT *, CASE WHEN source_row > 0 AND sheet IS NOT NULL THEN sheet || '!R' || source_row WHEN source_row > 0 THEN 'R' || source_row ELSE 'qa:' || row_id END AS anchor,
  concat_ws(chr(10) || chr(10), '## 问题' || chr(10) || question, CASE WHEN len(alike) > 0 THEN '## 相似问题' || chr(10) || '- ' || alike[1] END, CASE WHEN category <> '' THEN '## 分类' || chr(10) || category END, CASE WHEN len(tags) > 0 THEN '## 标签' || chr(10) || '- a' || chr(10) || '- b' END) AS head FROM c)"""
TWO = "chr(10) || chr(10)"


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").withColumn("answer", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("role = 'user'")
    pick = lambda test, *items: F.when(test, F.array(*items)).otherwise(F.array().cast("array<string>"))
    return turns.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("row_id"),
        F.col("text").alias("question"),
        "answer",
        pick(F.col("turn") % 4 == 0, F.concat(F.lit(" again "), "conv_id"), F.lit(" ")).alias("similar"),
        F.when(F.col("conv_id") % 2 == 0, "even").alias("category"),
        pick(F.col("conv_id") % 3 == 0, F.lit("a "), F.lit("b"), F.lit("")).alias("tags"),
        F.when(F.col("conv_id") % 5 == 0, "Sheet").alias("sheet"),
        F.col("turn").alias("source_row"),
    )


@query(
    f"""WITH {ROWS} SELECT row_id, 'qa_row' AS role, 0 AS part, CASE WHEN len(parts) = 1 THEN 0 ELSE len(parts) END::INT AS parts, len(parts) = 1 AS is_leaf, len(parts) = 1 AS vectorize, head || {TWO} || '## 答案' || chr(10) || answer AS content, anchor FROM a
    UNION ALL SELECT row_id, 'qa_answer_fragment', i::INT, len(parts)::INT, true, true, '## 问题' || chr(10) || question || {TWO} || '## 答案' || chr(10) || trim(parts[i], E' \\n\\t'), anchor FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM a WHERE len(parts) > 1)"""
)
def qa_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short answers whole, long ones in parts of packed paragraphs and sentences below a parent."""
    return qa.qa_chunks(_rows(spark, sf_dir), SIZE, OVERLAP).select("row_id", "role", "part", "parts", "is_leaf", "vectorize", "content", "anchor")


@query(
    f"""WITH {ROWS} SELECT row_id, 0 AS part, 'question' AS scope, head AS search_text, question AS vector_text, 10 AS priority FROM a
    UNION ALL SELECT row_id, CASE WHEN len(parts) = 1 THEN 0 ELSE i END::INT, 'answer', '## 问题' || chr(10) || question || {TWO} || '## 答案' || chr(10) || trim(parts[i], E' \\n\\t'), '## 问题' || chr(10) || question || {TWO} || '## 答案' || chr(10) || trim(parts[i], E' \\n\\t'), 20 FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM a)"""
)
def qa_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search units of questions, and of answers as they are indexed, too."""
    rows = _rows(spark, sf_dir)
    return qa.qa_units(rows, qa.qa_chunks(rows, SIZE, OVERLAP), {"index_mode": "question_answer"})


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS answer FROM conversations WHERE turn BETWEEN 2 AND 3 GROUP BY 1")
def qa_answer_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer out of blocks: what stands between its heading and the next one. Here turns 2 and 3 stand there."""
    block = F.when(F.col("turn") == 2, F.array(F.lit("## 答案"), F.col("text"))).when(F.col("turn") == 3, F.array(F.col("text"), F.lit("## 标签"))).otherwise(F.array("text"))
    blocks = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))), lambda x: x["b"]))
    out = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(qa.answer_of_blocks(blocks).alias("answer"), F.max("turn").alias("last"))
    return out.filter("last >= 2").drop("last")
