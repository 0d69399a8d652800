"""Questions and answers: chunks of long answers, and their search units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import text
from granary.functions.text import strip
from granary.operators.chunking import PRIORITIES, packed_sized, windows

LONG_PARAGRAPH = 200


def clean_list(c: Column) -> Column:
    return F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: strip(F.coalesce(x, F.lit("")))), lambda x: x != "")


def semantic_units(answer: Column) -> Column:
    """Paragraphs; those of more than 200 characters as sentences."""
    paragraphs = F.filter(F.transform(F.split(answer, r"\n{2,}"), strip), lambda p: p != "")
    sentences = lambda p: F.filter(F.transform(F.split(p, r"(?<=[。！？!?；;])|(?<=\.)\s+"), strip), lambda s: s != "")
    return F.flatten(F.transform(paragraphs, lambda p: F.when(F.length(p) <= LONG_PARAGRAPH, F.array(p)).otherwise(sentences(p))))


def answer_parts(answer: Column, size: int, overlap: int) -> Column:
    """The answer, or units packed line by line to `size` characters; a unit beyond that is cut into windows of its own."""
    body = strip(F.coalesce(answer, F.lit("")))
    alone = lambda u: F.transform(windows(u, size, overlap, stop_at_end=True), lambda w: F.struct(w["content"].alias("p"), F.lit(size + 1).cast("long").alias("n")))
    fits = lambda u: F.array(F.struct(u.alias("p"), (F.length(u) + 1).cast("long").alias("n")))
    sized = F.flatten(F.transform(semantic_units(body), lambda u: F.when(F.length(u) <= size, fits(u)).otherwise(alone(u))))
    return F.when(body == "", F.array().cast("array<string>")).when(F.length(body) <= size, F.array(body)).otherwise(F.filter(packed_sized(sized, size + 1, "\n"), lambda p: strip(p) != ""))


def source_anchor(sheet: Column, row: Column, row_id: Column) -> Column:
    """Where a row comes from: sheet and row, the row alone, or its id."""
    at = F.concat(F.lit("R"), row)
    return F.when((row > 0) & (strip(F.coalesce(sheet, F.lit(""))) != ""), F.concat(sheet, F.lit("!"), at)).when(row > 0, at).when(row_id.isNotNull(), F.concat(F.lit("qa:"), row_id))


def qa_chunks(rows: DataFrame, size: int, overlap: int) -> DataFrame:
    """Chunks of rows (row_id, question, answer, similar, category, tags, sheet, source_row): row_id, role, part, parts,
    depth, is_leaf, vectorize, content, anchor.

    A short answer is one leaf. A long one is a parent that isn't searched, with a leaf for each part of the answer.
    Rows without a question or an answer give none.
    """
    q, a = strip(F.coalesce("question", F.lit(""))), strip(F.coalesce("answer", F.lit("")))
    kept = rows.select("row_id", q.alias("question"), a.alias("answer"), clean_list(F.col("similar")).alias("similar"), strip(F.coalesce("category", F.lit(""))).alias("category"), clean_list(F.col("tags")).alias("tags"), source_anchor(F.col("sheet"), F.col("source_row"), F.col("row_id")).alias("anchor"))
    kept = kept.filter((F.col("question") != "") & (F.col("answer") != "")).withColumn("cut", answer_parts(F.col("answer"), size, overlap))
    none = F.array().cast("array<string>")
    whole = text.qa_markdown(F.col("question"), F.col("answer"), F.col("similar"), F.col("category"), F.col("tags"))
    one = F.size("cut") == 1
    row = F.struct(F.lit("qa_row").alias("role"), F.lit(0).alias("part"), F.lit(0).alias("depth"), one.alias("is_leaf"), one.alias("vectorize"), whole.alias("content"))
    part = lambda p, i: F.struct(F.lit("qa_answer_fragment").alias("role"), (i + 1).alias("part"), F.lit(1).alias("depth"), F.lit(True).alias("is_leaf"), F.lit(True).alias("vectorize"), text.qa_markdown(F.col("question"), p, none, F.lit(""), none).alias("content"))
    chunks = F.concat(F.array(row), F.when(one, F.array().cast("array<struct<role:string,part:int,depth:int,is_leaf:boolean,vectorize:boolean,content:string>>")).otherwise(F.transform("cut", part)))
    return kept.select("row_id", F.when(one, 0).otherwise(F.size("cut")).alias("parts"), "anchor", F.explode(chunks).alias("c")).select("row_id", "c.*", "parts", "anchor")


def question_text(question: Column, similar: Column, category: Column, tags: Column) -> Column:
    """The question's side of a row: question, similar ones, category and tags under headings; empty parts are left out."""
    bullets = lambda c: F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), x)), "\n")
    part = lambda title, body: F.when(body != "", F.concat(F.lit(f"## {title}\n"), body))
    h = text.QA_HEADINGS
    return F.concat_ws("\n\n", part(h["question"], question), part(h["similar"], bullets(similar)), part(h["category"], category), part(h["tags"], bullets(tags)))


def answer_of_blocks(blocks: Column) -> Column:
    """The text between the heading of the answer and the next heading, from blocks of text in order."""
    texts = F.filter(F.transform(blocks, lambda b: strip(F.coalesce(b, F.lit("")))), lambda b: b != "")
    at = F.array_position(texts, f"## {text.QA_HEADINGS['answer']}")
    after = F.slice(texts, (at + 1).cast("int"), F.greatest(F.size(texts) - at, F.lit(0)).cast("int"))
    upto = F.array_position(F.transform(after, lambda b: b.startswith("## ")), F.lit(True))
    body = F.when(upto > 0, F.slice(after, F.lit(1), (upto - 1).cast("int"))).otherwise(after)
    return F.when(at > 0, strip(F.array_join(body, "\n"))).otherwise("")


def retrieval_config(raw: dict | None) -> dict:
    """A question set's settings, weights between 0 and 1 that add to 1; without answers in the index the question has all."""
    cfg = dict(raw or {})
    mode = cfg.get("index_mode") if cfg.get("index_mode") in ("question_only", "question_answer") else "question_only"

    def weight(name: str, default: float) -> float:
        try:
            return max(0.0, min(1.0, float(cfg.get(name))))
        except (TypeError, ValueError):
            return default

    q, a = weight("query_weight", 0.8), weight("answer_weight", 0.2)
    q, a = (1.0, 0.0) if mode == "question_only" else (q / (q + a), a / (q + a)) if q + a > 0 else (0.8, 0.2)
    return {"index_mode": mode, "query_weight": round(q, 4), "answer_weight": round(a, 4)} | {k: cfg.get(k) is not False for k in ("enable_keyword_recall", "enable_category_filter", "enable_tag_filter")}


def qa_units(rows: DataFrame, chunks: DataFrame, config: dict | None = None) -> DataFrame:
    """Search units of chunks (`qa_chunks`) of rows: one of the question a row, and, where answers are indexed, one of each
    leaf: row_id, part, scope, search_text, vector_text, priority. Vectors of questions take the question alone."""
    out = chunks.filter("role = 'qa_row'").select("row_id", "part").join(rows, "row_id")
    similar, tags = clean_list(F.col("similar")), clean_list(F.col("tags"))
    question = strip(F.coalesce("question", F.lit("")))
    units = out.select("row_id", "part", F.lit("question").alias("scope"), question_text(question, similar, strip(F.coalesce("category", F.lit(""))), tags).alias("search_text"), question.alias("vector_text"), F.lit(PRIORITIES["question"]).alias("priority"))
    if retrieval_config(config)["index_mode"] == "question_answer":
        none = F.array().cast("array<string>")
        leaves = chunks.filter("is_leaf").join(rows.select("row_id", question.alias("q"), strip("answer").alias("a")), "row_id")
        text_ = F.when(F.col("role") == "qa_row", text.qa_markdown(F.col("q"), F.col("a"), none, F.lit(""), none)).otherwise(F.col("content"))
        units = units.unionByName(leaves.select("row_id", "part", F.lit("answer").alias("scope"), text_.alias("search_text"), text_.alias("vector_text"), F.lit(20).alias("priority")))
    return units.filter("search_text <> ''")
