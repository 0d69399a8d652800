"""Web pages: quality gates and chunks of pages; their sections are made in `page_elements`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.text import mixed_units, strip
from granary.operators import markdown
from granary.operators.chunking import packed, packed_sized

# Paragraphs that say nothing.
NOISE_STARTS, NOISE_WORDS = ("导航", "目录", "menu", "navigation", "footer", "版权", "copyright"), ("©", "all rights reserved", "上一篇", "下一篇", "返回顶部")


def try_readability(meaningful: Column, chars: Column, suspicious: Column, link_ratio: Column, page_chars: Column, least: int) -> Column:
    """Whether another reading of the page should be tried: it says too little, or looks like links or like an error page."""
    return ~meaningful & ((chars == 0) | suspicious | (link_ratio >= 0.5) | (chars < max(120, least // 2)) | (page_chars >= max(1000, least * 5)))


def try_browser(meaningful: Column, chars: Column, suspicious: Column, link_ratio: Column, page_chars: Column, paragraphs: Column, least: int) -> Column:
    """Whether the page should be rendered first."""
    return ~meaningful & ((chars < least) | suspicious | (link_ratio >= 0.5) | ((page_chars >= max(1200, least * 6)) & (paragraphs <= 1)))


def is_meaningful(paragraph: Column) -> Column:
    """A paragraph that isn't navigation or a copyright line."""

    def says(low: Column) -> Column:
        noise = F.lit(False)
        for w in NOISE_STARTS:
            noise = noise | low.startswith(w)
        for w in NOISE_WORDS:
            noise = noise | F.contains(low, F.lit(w))
        return (low != "") & ~noise

    # Within an array, so that a paragraph is stripped and lowered once and not for each word.
    return F.exists(F.array(F.lower(strip(F.coalesce(paragraph, F.lit(""))))), says)


def split_html_table(table: Column, budget: int) -> Column:
    """Rows of an HTML table packed to a budget of units, the header rows in each part."""
    is_head = lambda r: r.rlike(r"(?is)<th\b") & ~r.rlike(r"(?is)<td\b")

    def parts(rows: Column, n_head: Column) -> Column:
        body = F.slice(rows, n_head + 1, F.greatest(F.size(rows) - n_head, F.lit(0)))
        whole = lambda head: F.transform(packed(body, budget, "", size=mixed_units), lambda p: F.concat(F.lit("<table>"), head, p, F.lit("</table>")))
        return markdown.let(F.array_join(F.slice(rows, F.lit(1), n_head), ""), whole)

    def cut(rows: Column) -> Column:
        body_at = F.array_position(F.transform(rows, lambda r: ~is_head(r)), F.lit(True))
        n_head = markdown.let(body_at, lambda at: F.when(at > 0, at - 1).otherwise(0).cast("int"))
        return F.when(F.size(rows) <= 1, F.array(table)).otherwise(markdown.let(n_head, lambda n: parts(rows, n)))

    return markdown.let(F.regexp_extract_all(table, F.lit(r"(?is)<tr\b.*?</tr>"), F.lit(0)), cut)


def page_chunks(sections: DataFrame, key: str, size: int) -> DataFrame:
    """key, section_no, role, position, content: chunks of sections (`page_sections`). Each section has a root that isn't
    searched; the texts between two tables are packed to `size` units under the title, which stands for the headings; each
    table is a leaf, or a parent with its parts."""
    head = F.when(F.col("title") != "", F.concat(F.lit("# "), "title", F.lit("\n")))
    root = sections.select(key, "section_no", F.lit("web_root").alias("role"), F.lit(0).alias("position"), F.lit(0).alias("part"), F.lit(False).alias("vectorize"), F.col("markdown").alias("content"))
    is_table = lambda b: b["type"] == "table"
    tables_before = lambda i: F.size(F.filter(F.slice("blocks", F.lit(1), i), is_table))
    texts = F.transform("blocks", lambda b, i: F.struct(b["type"].alias("type"), b["text"].alias("p"), mixed_units(b["text"]).alias("n"), tables_before(i).alias("run")))
    said = F.filter(texts, lambda b: ~b["type"].isin("table", "heading") & is_meaningful(b["p"]))
    run = lambda j: F.transform(F.filter("_said", lambda b: b["run"] == j), lambda b: F.struct(b["p"], b["n"]))
    runs = F.transform(F.sequence(F.lit(0), F.size(F.filter("blocks", is_table))), lambda j: packed_sized(run(j), size, "\n\n"))
    leaves = sections.withColumn("_said", said).select(key, "section_no", "title", F.posexplode(F.flatten(runs)).alias("position", "p"))
    leaves = leaves.select(key, "section_no", F.lit("web_text").alias("role"), "position", F.lit(0).alias("part"), F.lit(True).alias("vectorize"), F.concat_ws("", head, "p").alias("content"))
    tables = sections.select(key, "section_no", F.posexplode(F.filter("blocks", lambda b: b["type"] == "table")).alias("position", "b")).select(key, "section_no", "position", F.col("b.text").alias("text"), F.col("b.format").alias("format"))
    small = mixed_units("text") <= size
    whole = tables.select(key, "section_no", F.when(small, "web_table_leaf").otherwise("web_table_parent").alias("role"), "position", F.lit(0).alias("part"), small.alias("vectorize"), F.col("text").alias("content"))
    cut = F.when(F.col("format") == "markdown", markdown.split_table(F.col("text"), size)).otherwise(split_html_table(F.col("text"), size))
    parts = tables.filter(~small).select(key, "section_no", F.lit("web_table_fragment").alias("role"), "position", F.posexplode(cut).alias("part", "p")).select(key, "section_no", "role", "position", (F.col("part") + 1).alias("part"), F.lit(True).alias("vectorize"), F.col("p").alias("content"))
    return root.unionByName(leaves).unionByName(whole).unionByName(parts)
