"""Web pages: sections, chunks and quality gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import text
from granary.operators import page_elements, web
from granary.plans.registry import query
from granary.sources.tables import table


@query()
def page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections with typed blocks of each page's main part."""
    return page_elements.page_sections(table(spark, sf_dir, "pages"), "page_id")


@query()
def page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots, texts and tables of pages; articles only."""
    pages = page_elements.with_selector(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id", "html", "article")
    return web.page_chunks(page_elements.page_sections(pages, "page_id"), "page_id", 120)


@query("SELECT doc_id, i AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents) WHERE trim(p, E' \\t\\r') <> '' AND NOT regexp_matches(lower(trim(p, E' \\t\\r')), '^(导航|目录|menu|navigation|footer|版权|copyright)|©|all rights reserved|上一篇|下一篇|返回顶部')")
def meaningful_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that aren't navigation or copyright."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "p"))
    return lines.filter(web.is_meaningful(F.col("p"))).select("doc_id", F.col("line").cast("long").alias("line"))


ORDER_TABLE = "SELECT l_orderkey, '<table><tr><th>no</th><th>part</th></tr>' AS head, list('<tr><td>' || l_linenumber || '</td><td>part ' || l_partkey || '</td></tr>' ORDER BY l_linenumber, l_partkey) AS rows FROM lineitem GROUP BY 1"


@query(
    f"""WITH t AS ({ORDER_TABLE}), p AS (SELECT l_orderkey, head, rows, unnest(range(len(rows))) AS i FROM t),
    c AS (SELECT l_orderkey, i // 2 AS part, head || string_agg(rows[i + 1], '' ORDER BY i) || '</table>' AS content FROM p GROUP BY l_orderkey, i // 2, head)
    SELECT l_orderkey, part::INT AS part, content FROM c"""
)
def split_html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HTML tables in parts of two rows, which 60 units hold, with their header."""
    row = F.concat(F.lit("<tr><td>"), "l_linenumber", F.lit("</td><td>part "), "l_partkey", F.lit("</td></tr>"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", row.alias("r")))), lambda x: x["r"])
    tables = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.concat(F.lit("<table><tr><th>no</th><th>part</th></tr>"), F.array_join(rows, ""), F.lit("</table>")).alias("html"), F.count("*").alias("n"))
    cut = F.when(F.col("n") > 0, web.split_html_table(F.col("html"), 50))
    return tables.select("l_orderkey", F.posexplode(cut).alias("part", "content"))


@query(
    """WITH q AS (SELECT doc_id, length(text) % 900 AS chars, doc_id % 11 = 0 AS suspicious, (doc_id % 4) / 4 AS ratio, length(text) AS page, doc_id % 3 AS paragraphs, doc_id % 5 = 0 AS good FROM documents)
    SELECT doc_id, NOT good AND (chars = 0 OR suspicious OR ratio >= 0.5 OR chars < 120 OR page >= 1000) AS readability, NOT good AND (chars < 200 OR suspicious OR ratio >= 0.5 OR (page >= 1200 AND paragraphs <= 1)) AS browser FROM q"""
)
def extraction_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a page is read another way, and whether it is rendered first."""
    key, page = F.col("doc_id"), F.length("text")
    good, chars, odd, ratio = key % 5 == 0, page % 900, key % 11 == 0, (key % 4) / 4
    return table(spark, sf_dir, "documents").select("doc_id", web.try_readability(good, chars, odd, ratio, page, 200).alias("readability"), web.try_browser(good, chars, odd, ratio, page, key % 3, 200).alias("browser"))


#: A page's visible text by patterns alone, as SQL can say it: what the quality counts.
PLAIN = r"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?>.*?</script>', ' ', 'g'), '(?is)<style.*?>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g')"


@query(
    rf"""WITH d AS (SELECT page_id, html, trim(regexp_replace({PLAIN}, '\s{{2,}}', ' ', 'g'), E' \n\t') AS t FROM pages), b AS (SELECT page_id, length(regexp_replace(t, '[^0-9A-Za-z一-鿿]', '', 'g')) AS page FROM d)
    SELECT page_id, page AS chars, CASE WHEN page >= 20 THEN 1 ELSE 0 END AS paragraphs, (CASE WHEN page >= 100 THEN 1 ELSE 0 END + CASE WHEN page >= 200 THEN 2 ELSE 0 END + CASE WHEN page >= 500 THEN 1 ELSE 0 END + CASE WHEN page < 50 THEN -2 ELSE 0 END)::INT AS score FROM b"""
)
def page_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of a page's whole text in one paragraph: characters, paragraphs and score."""
    # Behind a bar, so that digits at the beginning are no list mark.
    letters = F.concat(F.lit("|"), F.regexp_replace(text.strip_html("html"), r"[^0-9A-Za-z一-鿿 ]", " "))
    quality = text.extraction_quality(letters, F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", quality["chars"].alias("chars"), quality["paragraphs"].alias("paragraphs"), quality["score"].alias("score"))


#: What an end tag ends, in pages whose containers are written out: all that stands between them.
_SAID = "length(regexp_replace({t}, '[^0-9A-Za-z一-鿿]', '', 'g'))"
_BARE = r"regexp_replace(replace(replace(replace(replace(replace(regexp_replace({t}, '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&copy;', ''), '&middot;', ''), '&quot;', ''), '&(amp|nbsp|apos|#39);', '', 'g')"


@query(
    rf"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<(script)\b[^>]*>.*?</script\s*>', '', 'g'), '(?is)<(style)\b[^>]*>.*?</style\s*>|<!--.*?-->', '', 'g') AS h FROM pages),
    c AS (SELECT page_id, 'body' AS tag, regexp_extract(h, '(?s)<body>(.*)', 1) AS t FROM p UNION ALL SELECT page_id, 'article', regexp_extract(h, '(?s)<article>(.*)</article>', 1) FROM p)
    SELECT page_id, tag, round({_SAID.format(t=_BARE.format(t="t"))} - 0.4 * {_SAID.format(t=_BARE.format(t="array_to_string(regexp_extract_all(t, '(?s)<a [^>]*>.*?</a>'), '')"))} + 40 * len(regexp_extract_all(t, '<h[123]>')), 4)::DOUBLE AS score FROM c"""
)
def container_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the containers of pages say, less their links, more for headings."""
    tokens = page_elements.page_tokens(table(spark, sf_dir, "pages"), "page_id", "html")
    return page_elements.container_scores(tokens, "page_id").select("page_id", "tag", "score")


@query(
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS i FROM lineitem)
    SELECT l_orderkey, l_orderkey % 5 <> 2 AS simple, CASE WHEN l_orderkey % 5 <> 2 THEN '| no | part |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || l_linenumber || ' | p\\|' || l_partkey || ' <b |', chr(10) ORDER BY i) END AS markdown FROM r GROUP BY 1""".replace("\\\\", "\\")
)
def page_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of pages, with rows and cells that nothing ends, as Markdown where they are simple; some have a span."""
    row = lambda x: F.concat(F.lit("<tr><td>"), x["l_linenumber"], F.lit("<td> <b>p|"), x["l_partkey"], F.lit("</b>  &lt;b"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), row)
    head = F.when(F.col("l_orderkey") % 5 == 2, "<tr><th>no</th><th colspan=1>part</th></tr>").otherwise("<tr><th>no<th>part")
    # In a fixed number of parts: by their few bytes alone Spark would read the pages in too few tasks.
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_orderkey")
    pages = lines.groupBy("l_orderkey").agg(F.array_join(rows, "").alias("rows"))
    pages = pages.select("l_orderkey", F.concat(F.lit("<p>text<table>"), head, "rows", F.lit("</table><p>more")).alias("html"))
    return page_elements.page_tables(pages, "l_orderkey", "html").select("l_orderkey", "simple", "markdown")
