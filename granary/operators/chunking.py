"""Cutting texts into chunks, and projecting chunks into search units.

Windows and line rules are expressions. The packers carry a running sum with resets from piece to piece; they fold over
the pieces of one text in an aggregate expression, so that no text leaves the JVM.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.text import col, mixed_units, strip

SENTENCE_END = r"(?<=[.!?。！？])\s*"


def windows(c: Column | str, size: int, overlap: int, stop_at_end: bool = False) -> Column:
    """Windows of `size` characters, each `overlap` into the one before; stop_at_end leaves out those that only repeat the tail."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than size")
    text, step = col(c), size - overlap
    n = F.length(text)
    last = F.greatest(F.lit(0), n - overlap - 1) if stop_at_end else n - 1
    starts = F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(step))
    cut = F.transform(starts, lambda i: F.struct(i.cast("int").alias("start"), F.substring(text, i + 1, F.lit(size)).alias("content")))
    return F.when(n > 0, cut).otherwise(F.array().cast("array<struct<start:int,content:string>>"))


def fixed_chunks(df: DataFrame, body: str, size: int, overlap: int, stop_at_end: bool = False) -> DataFrame:
    """position, start, content of each window; the columns of df stay. Texts without characters give no chunk."""
    return df.select("*", F.posexplode(windows(body, size, overlap, stop_at_end)).alias("position", "_c")).select("*", "_c.start", "_c.content").drop("_c")


def sentences(c: Column | str) -> Column:
    return F.filter(F.transform(F.split(col(c), SENTENCE_END), strip), lambda s: s != "")


def paragraphs(c: Column | str) -> Column:
    return F.filter(F.transform(F.split(col(c), r"\n\s*\n"), strip), lambda p: p != "")


def packed(pieces: Column, budget: int, joiner: str, size=F.length, overlap: int = 0) -> Column:
    """Pieces joined greedily while their sizes stay within the budget; the last `overlap` pieces begin the next one too.

    A piece over the budget stands alone. size(piece) is taken once a piece; joiners don't count.
    """
    return packed_sized(F.transform(pieces, lambda p: F.struct(p.alias("p"), size(p).cast("long").alias("n"))), budget, joiner, overlap)


def packed_sized(sized: Column, budget: int, joiner: str, overlap: int = 0) -> Column:
    """As `packed`, of pieces with their sizes: structs of p and n. Finished chunks are copied only as one is added."""
    kind = "struct<done:array<string>,open:array<struct<p:string,n:bigint>>,sum:bigint>"
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<struct<p:string,n:bigint>>").alias("open"), F.lit(0).cast("long").alias("sum"))
    text = lambda open_: F.array_join(F.transform(open_, lambda x: x["p"]), joiner)
    total = lambda open_: F.aggregate(open_, F.lit(0).cast("long"), lambda a, x: a + x["n"])

    def step(a: Column, x: Column) -> Column:
        fits = (F.size(a["open"]) == 0) | (a["sum"] + x["n"] <= budget)
        grown = F.struct(a["done"].alias("done"), F.array_append(a["open"], x).alias("open"), (a["sum"] + x["n"]).alias("sum"))
        if not overlap:
            begun = F.struct(F.array_append(a["done"], text(a["open"])).alias("done"), F.array(x).alias("open"), x["n"].alias("sum"))
            return F.when(fits, grown).otherwise(begun).cast(kind)
        tail = F.slice(a["open"], F.greatest(F.lit(1), F.size(a["open"]) - overlap + 1), F.lit(overlap))
        carried = F.when(total(tail) + x["n"] <= budget, tail).otherwise(F.array().cast("array<struct<p:string,n:bigint>>"))
        reset = F.struct(F.array_append(a["done"], text(a["open"])).alias("done"), F.array_append(carried, x).alias("open"), (total(carried) + x["n"]).alias("sum"))
        return F.when(fits, grown).otherwise(reset).cast(kind)

    finish = lambda a: F.when(F.size(a["open"]) > 0, F.array_append(a["done"], text(a["open"]))).otherwise(a["done"])
    return F.aggregate(sized, start.cast(kind), step, finish)


def sentence_chunks(c: Column | str, budget: int, overlap: int = 1) -> Column:
    """Sentences packed to a budget of characters, each chunk beginning with the last of the one before."""
    return packed(sentences(c), budget, " ", overlap=overlap)


def paragraph_chunks(c: Column | str, budget: int, overlap: int = 0) -> Column:
    """Paragraphs packed to a budget of mixed units."""
    return packed(paragraphs(c), budget, "\n\n", size=mixed_units, overlap=overlap)


def paragraphs_by(c: Column | str, budget: int, counter: Any, overlap: int = 0) -> Column:
    """Paragraphs packed to a budget of a counter's units: anything whose `sized` gives pieces with sizes, as tokens do."""
    return packed_sized(counter.sized(paragraphs(c)), budget, "\n\n", overlap)


def sentences_by(c: Column | str, budget: int, counter: Any, overlap: int = 1) -> Column:
    """Sentences packed to a budget of a counter's units."""
    return packed_sized(counter.sized(sentences(c)), budget, " ", overlap)


def recursive_chunks(c: Column | str, budget: int) -> Column:
    """Packed lines; a line over the budget as packed sentences, a sentence over it as packed words, a word as windows."""
    by_window = lambda w: F.transform(windows(w, budget, 0), lambda x: x["content"])
    split = lambda units, deeper: F.flatten(F.transform(units, lambda u: F.when(F.length(u) <= budget, F.array(u)).otherwise(deeper(u))))
    words = lambda s: packed(split(F.filter(F.split(s, r"\s+"), lambda w: w != ""), by_window), budget, " ", size=lambda p: F.length(p) + 1)
    of_line = lambda line: packed(split(sentences(line), words), budget, " ", size=lambda p: F.length(p) + 1)
    all_lines = F.filter(F.split(col(c), "\n"), lambda x: strip(x) != "")
    return packed(split(all_lines, of_line), budget, "\n", size=lambda p: F.length(p) + 1)


def is_complex(c: Column | str) -> Column:
    """Long, or with many lines of headings, lists, tables or code."""
    marked = F.regexp_count(col(c), F.lit(r"(?m)^\s*(#{1,6} |[-*+] |\d+[.)] |\||```|>)"))
    return (F.length(col(c)) > 4000) | (marked > 5)


def heading_sections(df: DataFrame, key: str, body: str) -> DataFrame:
    """Markdown sections: key, section, level, heading, path (headings above, joined by >), content.

    A section begins at a heading line; lines before the first one are section 0 of level 0.
    """
    lines = df.select(key, F.posexplode(F.split(col(body), "\n")).alias("line_no", "line"))
    level = F.length(F.regexp_extract("line", r"^(#{1,6}) +\S", 1))
    lines = lines.withColumn("level", F.when(level > 0, level)).withColumn("heading", F.when(level > 0, F.trim(F.regexp_replace("line", r"^#{1,6} +", ""))))
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("section", F.count("level").over(w))
    for k in range(1, 7):
        # A heading of level k holds until the next one of level k or less.
        last = F.last(F.when(F.col("level") <= k, F.struct("level", "heading")), ignorenulls=True).over(w)
        lines = lines.withColumn(f"h{k}", F.when(last["level"] == k, last["heading"]))
    path = F.concat_ws(" > ", *(f"h{k}" for k in range(1, 7)))
    grouped = lines.withColumn("path", path).groupBy(key, "section").agg(
        F.coalesce(F.max("level"), F.lit(0)).alias("level"),
        F.max("heading").alias("heading"),
        F.max_by("path", "line_no").alias("path"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("level").isNull(), F.struct("line_no", "line")))), lambda x: x["line"]), "\n").alias("content"),
    )
    return grouped.filter((F.col("section") > 0) | (strip(F.col("content")) != ""))


def table_row_chunks(rows: DataFrame, key: str, header: str, values: str, row_no: str, per_shard: int = 3000) -> DataFrame:
    """One text a table row, `name: value` for cells that aren't empty, and the shard that the row falls into."""
    pairs = F.filter(F.arrays_zip(F.col(header).alias("h"), F.col(values).alias("v")), lambda p: strip(F.coalesce(p["v"], F.lit(""))) != "")
    body = F.array_join(F.transform(pairs, lambda p: F.concat(p["h"], F.lit(": "), p["v"])), "; ")
    return rows.select(key, row_no, body.alias("content"), F.floor((F.col(row_no) - 1) / per_shard).cast("int").alias("shard"))


def packed_rows(rows: DataFrame, key: str, row_no: str, body: str, header: Column, per_chunk: int) -> DataFrame:
    """Whole rows drawn together, `per_chunk` to a chunk, the header repeated in each."""
    numbered = rows.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(key).orderBy(row_no)) - 1) / per_chunk).cast("int"))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(row_no, body))), lambda x: x[body]), "\n")
    return numbered.groupBy(key, "chunk").agg(F.concat_ws("\n", F.first(header), texts).alias("content"), F.count("*").alias("n_rows"))


# What a search unit's scope is worth among a chunk's.
PRIORITIES = {"question": 10, "default": 20, "row": 20, "answer": 25, "summary": 30, "row_group": 35, "row_fragment": 40, "keyword": 50, "doc_summary": 60}


def search_units(chunks: DataFrame) -> DataFrame:
    """Chunks (chunk_id, content, summary, keywords, questions, vectorize) into typed units: the content, the summary, each question, the keywords.

    Units whose text is blank and chunks that aren't to be searched give none.
    """
    one = lambda scope, text: F.struct(F.lit(scope).alias("search_scope"), text.alias("search_text"))
    units = F.concat(
        F.array(one("default", F.col("content")), one("summary", F.col("summary"))),
        F.transform("questions", lambda q: one("question", q)),
        F.array(one("keyword", F.array_join("keywords", " "))),
    )
    rows = chunks.filter(F.coalesce("vectorize", F.lit(True))).select("chunk_id", F.posexplode(units).alias("unit_no", "u")).select("chunk_id", "unit_no", "u.*")
    rows = rows.filter(strip(F.coalesce("search_text", F.lit(""))) != "")
    pairs = [F.lit(x) for item in PRIORITIES.items() for x in item]
    return rows.withColumn("priority", F.create_map(*pairs)[F.col("search_scope")]).withColumn("search_text_hash", F.sha2("search_text", 256))


def leaf_flags(nodes: DataFrame, node: str = "node_id", parent: str = "parent_id") -> DataFrame:
    """Adds is_leaf: no node has this one as its parent."""
    parents = nodes.filter(F.col(parent).isNotNull()).select(F.col(parent).alias(node), F.lit(False).alias("_leaf")).distinct()
    return nodes.join(parents, node, "left").withColumn("is_leaf", F.coalesce("_leaf", F.lit(True))).drop("_leaf")
