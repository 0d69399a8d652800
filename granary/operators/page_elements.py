"""Elements of pages as rows: tags in order, depth by a running sum, each element an interval of positions; containers scored by
running sums, texts of blocks by joins over intervals. Two walks over one page's tokens in order are small Arrow functions: what
puts its tags right, and what reads its tables, whose tokens so stay in their page's row."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from granary.operators.markdown import VOID_TAGS
from granary.sources.scratch import scratch_path

# Tags whose content isn't read, and what ends where another element begins.
UNREAD = ("script", "style", "noscript", "template")
ENDS = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
# Where a page's own text may stand, and what counts for it.
CONTAINERS = ("main", "article", "section", "body")
LINK_SHARE, TABLE_SCORE, HEADING_SCORE, HEADINGS = 0.4, 80, 40, ("h1", "h2", "h3")
# Tables that become Markdown.
MOST_COLUMNS, MOST_CELL = 8, 120
#: Named characters that are written out; numbers are not, others stay as they are.
NAMED = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&copy;": "©", "&middot;": "·", "&amp;": "&"}
_BLANKS, _SPANS = re.compile(r"[ \t\n\x0b\f\r]{2,}"), re.compile(r"[ \t\n\x0b\f\r](?ai:rowspan|colspan)\b")


def _name(token: Column) -> Column:
    return F.lower(F.regexp_extract(token, r"^</?([A-Za-z][A-Za-z0-9:-]*)", 1))


#: A token, whether it is an end tag, and its tag's name.
_TOKENS = re.compile(r"(?s)(<!--.*?-->|<(/?)([A-Za-z][A-Za-z0-9:-]*)[^>]*>|<![^>]*>|[^<]+|<)")
_TEXT, _OPENS, _ENDS, _STANDS = range(4)


def _kind(token: str, end: str, name: str) -> int:
    """What a token is: a text, a start tag, an end tag, or an element that has no end."""
    return _TEXT if not name else _ENDS if end else _STANDS if token.endswith("/>") or name in VOID_TAGS else _OPENS


def _balanced(html: str) -> list[tuple[str, str, int]]:
    """Tokens in order, each with its name and kind, with what tags end and what is open at the end written out."""
    out, open_ = [], []
    close = lambda name: out.append((f"</{name}>", name, _ENDS))
    for token, end, name in _TOKENS.findall(html):
        name = name.lower()
        if not name:
            if not token.startswith("<!"):
                out.append((token, "", _TEXT))
        elif name == "html":
            continue
        elif end:
            if name in open_:
                while (last := open_.pop()) != name:
                    close(last)
                close(name)
        else:
            # What `name` ends at the top of what is open is closed before it.
            while open_ and open_[-1] in ENDS.get(name, ()):
                close(open_.pop())
            kind = _kind(token, end, name)
            out.append((token, name, kind))
            if kind == _OPENS:
                open_.append(name)
    for name in reversed(open_):
        close(name)
    return out


@pandas_udf(T.ArrayType(T.StringType()))
def _all_balanced(html: pd.Series) -> pd.Series:
    return pd.Series([[token for token, _, _ in _balanced(x)] for x in html], dtype=object)


def _read(html: Column) -> Column:
    return F.regexp_replace(F.coalesce(html, F.lit("")), rf"(?is)<({'|'.join(UNREAD)})\b[^>]*>.*?</\1\s*>", "")


def balanced_tokens(html: Column) -> Column:
    """Tags and texts in order, each element with its end: start tags that end others before them, end tags that end what is open inside,
    end tags that nothing opened, and what is open at the end are put right. Comments, declarations and unread elements go. A text is
    read as HTML has it: a mark that begins no tag is text."""
    return _all_balanced(_read(html))


def page_tokens(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, pos, token, tag (empty for texts), level (how deep an element is), opens and ends."""
    rows = pages.select(key, F.posexplode(balanced_tokens(F.col(html))).alias("pos", "token"))
    rows = rows.withColumn("tag", _name(F.col("token")))
    ends = F.col("token").startswith("</") & (F.col("tag") != "")
    alone = F.col("token").rlike(r"/>$") | F.col("tag").isin(*VOID_TAGS)
    rows = rows.withColumn("ends", ends).withColumn("opens", (F.col("tag") != "") & ~ends & ~alone)
    so_far = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    depth = F.sum(F.col("opens").cast("int") - F.col("ends").cast("int")).over(so_far)
    return rows.withColumn("level", depth + F.col("ends").cast("int"))


def page_elements(tokens: DataFrame, key: str) -> DataFrame:
    """key, begin, end, level, tag, token (the start tag): elements of `page_tokens` as intervals of positions; those without an end have none."""
    own = Window.partitionBy(key, "level").orderBy("pos")
    edges = tokens.filter("opens or ends").withColumn("end", F.lead("pos").over(own)).filter("opens")
    return edges.select(key, F.col("pos").alias("begin"), "end", "level", "tag", "token")


def page_texts(tokens: DataFrame, key: str) -> DataFrame:
    """key, pos, text: the texts of `page_tokens`, named characters written out."""
    text = F.col("token")
    for name, sign in NAMED.items():
        text = F.replace(text, F.lit(name), F.lit(sign))
    return tokens.filter("tag = ''").select(key, "pos", text.alias("text"))


def said(text: Column) -> Column:
    """Letters, digits and ideographs."""
    return F.length(F.regexp_replace(text, "[^0-9A-Za-z一-鿿]", ""))


def _inside(outer: DataFrame, inner: DataFrame, key: str, at: str) -> DataFrame:
    """Rows of `inner` with the elements of the same page that they lie in."""
    o = outer.select(F.col(key).alias("_k"), F.col("begin").alias("of_begin"), F.col("end").alias("of_end"))
    return inner.join(o, (F.col(key) == F.col("_k")) & (F.col(at) > F.col("of_begin")) & (F.col(at) < F.col("of_end"))).drop("_k", "of_end")


def measured_elements(tokens: DataFrame, key: str) -> DataFrame:
    """`page_elements` with what each holds: n (what its texts say), links (what links say of that), gain (its tables and headings), tables
    in it and around it. Running sums over the page, taken at both ends, give them: no element meets its texts in a join."""
    so_far = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    text = F.col("token")
    for name, sign in NAMED.items():
        text = F.replace(text, F.lit(name), F.lit(sign))
    turn = F.col("opens").cast("int") - F.col("ends").cast("int")
    deep = lambda tag: F.sum(F.when(F.col("tag") == tag, turn).otherwise(0)).over(so_far)
    begun = lambda test: F.when(F.col("opens") & test, 1).otherwise(0)
    rows = tokens.select(
        "*",
        F.when(F.col("tag") == "", said(text)).otherwise(0).alias("_n"),
        deep("a").alias("_in_links"),
        (deep("table") - F.when(F.col("tag") == "table", F.col("opens").cast("int")).otherwise(0)).alias("around"),
        begun(F.col("tag") == "table").alias("_table"),
        (TABLE_SCORE * begun(F.col("tag") == "table") + HEADING_SCORE * begun(F.col("tag").isin(*HEADINGS))).alias("_gain"),
    )
    sums = {"n": F.col("_n"), "links": F.col("_n") * F.col("_in_links"), "gain": F.col("_gain"), "tables": F.col("_table")}
    rows = rows.select("*", *(F.sum(c).over(so_far).alias(f"_{name}_so_far") for name, c in sums.items())).filter("opens or ends")
    own = Window.partitionBy(key, "level").orderBy("pos")
    inside = (F.coalesce(F.lead(f"_{name}_so_far").over(own) - F.col(f"_{name}_so_far"), F.lit(0)).alias(name) for name in sums)
    out = rows.select(key, F.col("pos").alias("begin"), F.lead("pos").over(own).alias("end"), "level", "tag", "token", "opens", "around", *inside)
    return out.filter("opens").drop("opens")


def _scored_containers(measured: DataFrame, key: str) -> DataFrame:
    role = F.lower(F.regexp_extract("token", r"""(?i)\srole\s*=\s*["']?([^"'\s>]+)""", 1))
    found = measured.filter(F.col("tag").isin(*CONTAINERS) | ((F.col("tag") == "div") & (role == "main")))
    return found.select(key, "begin", "end", "level", "tag", F.round(F.col("n") - LINK_SHARE * F.col("links") + F.col("gain"), 4).alias("score"))


def container_scores(tokens: DataFrame, key: str) -> DataFrame:
    """key, begin, tag, score: how much each container of a page says, less its links, more for its tables and headings."""
    return _scored_containers(measured_elements(tokens, key), key).select(key, "begin", "tag", "score")


def _main_of(measured: DataFrame, key: str) -> DataFrame:
    best = F.max(F.struct("score", (-F.col("begin")).alias("first"), "begin", "end", "level", "tag")).alias("b")
    return _scored_containers(measured, key).groupBy(key).agg(best).select(key, "b.begin", "b.end", "b.level", "b.tag", "b.score")


def main_containers(tokens: DataFrame, key: str) -> DataFrame:
    """key, begin, tag, score: the container of the best score of each page, the first of equals."""
    return _main_of(measured_elements(tokens, key), key).select(key, "begin", "tag", "score")


def _cell_text(texts: list[str]) -> str:
    text = "".join(texts)
    return _BLANKS.sub(" ", text.strip(" \t\n\r"))


def _markdown_of(rows: list[list[tuple[list[str], bool]]]) -> str | None:
    """A table of rows of cells (texts, whether a head), where it is simple."""
    lines = [([_cell_text(texts) for texts, _ in row], any(head for _, head in row)) for row in rows]
    lines = [(line, head) for line, head in lines if any(line)]
    width = len(lines[0][0]) if lines else 0
    fit = all(len(line) == width and all(len(t) <= MOST_CELL and "\n" not in t for t in line) for line, _ in lines)
    if len(lines) < 2 or sum(head for _, head in lines) > 1 or not 2 <= width <= MOST_COLUMNS or not fit:
        return None
    bars = ["| " + " | ".join(t.replace("|", "\\|") for t in line) + " |" for line, _ in lines]
    return "\n".join([bars[0], "| " + " | ".join(["---"] * width) + " |", *bars[1:]])


def _tables_in(tokens: Iterable[tuple[str, str, int]]) -> list[dict]:
    """begin, simple, markdown of each table that lies in no other, from balanced tokens with their names and kinds."""
    found: list[dict] = []
    rows, spanned, depth = [], False, None  # of the table that is open, and how deep it is
    open_: list[tuple[list | None, bool]] = []  # a row's cells, whether a cell
    cells: list[list[str]] = []  # the texts of the cells that are open
    for pos, (token, name, kind) in enumerate(tokens):
        if kind == _TEXT:
            if cells:
                if "&" in token:
                    for sign, plain in NAMED.items():
                        token = token.replace(sign, plain)
                for texts in cells:
                    texts.append(token)
        elif kind == _ENDS:
            if open_.pop()[1]:
                cells.pop()
            if len(open_) == depth:
                markdown = None if spanned else _markdown_of(rows)
                found[-1] |= {"simple": markdown is not None, "markdown": markdown}
                depth = None
        elif kind == _OPENS:
            row, cell = None, False
            if depth is not None:
                spanned = spanned or (len(token) > len(name) + 2 and _SPANS.search(token) is not None)
                if name == "tr":
                    row = []
                    rows.append(row)
                elif name in ("td", "th") and open_[-1][0] is not None:
                    cell = True
                    cells.append([])
                    open_[-1][0].append((cells[-1], name == "th"))
            elif name == "table":
                rows, spanned, depth = [], False, len(open_)
                found.append({"begin": pos})
            open_.append((row, cell))
    return found


_TABLES = T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("simple", T.BooleanType()), T.StructField("markdown", T.StringType())]))


@pandas_udf(_TABLES)
def _tables_of_pages(html: pd.Series) -> pd.Series:
    return pd.Series([_tables_in(_balanced(x)) for x in html], dtype=object)


@pandas_udf(_TABLES)
def _tables_of_tokens(tokens: pd.Series) -> pd.Series:
    named = lambda token: (token, *_TOKENS.match(token).groups(default="")[1:])
    kinds = lambda token, end, name: (token, name.lower(), _kind(token, end, name.lower()))
    return pd.Series([_tables_in(kinds(*named(x)) for x in page) for page in tokens], dtype=object)


def page_tables(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, begin, simple, markdown of each table that lies in no other: simple ones have two rows at least, no spans, one header row at
    most and two to eight equal columns of short cells; others, and tables of fewer than two rows with a text, have no Markdown."""
    return pages.select(key, F.inline(_tables_of_pages(_read(F.col(html)))))


# How much a section must say, tags that are blocks, words that tell a section's kind.
LEAST_SECTION = 30
BLOCK_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
BLOCK_TAGS = (*BLOCK_HEADINGS, "p", "li", "dt", "dd", "table")
SIDE_TITLES, CONTENT_TITLES = ("咨询", "contact", "help", "服务窗口"), ("流程", "步骤", "guide", "faq", "常见问题")
SUMMARY_WORDS = ("在线办理", "立即办理", "查看评价", "下载办事指南")


def _inline(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, r"\s{2,}", " "), F.lit(" \t\n\r\x0b\x0c"))


def _stored(rows: DataFrame, name: str) -> DataFrame:
    """Written once, as several joins read it."""
    path = scratch_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _joined_in_order(rows: DataFrame, keys: list[str], at: str, text: str, name: str) -> DataFrame:
    parts = F.transform(F.array_sort(F.collect_list(F.struct(at, text))), lambda x: x[text])
    return rows.groupBy(*keys).agg(F.array_join(parts, "").alias(name))


def _texts_of(elements: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """key, begin, t: the text within each element, blanks drawn together."""
    inside = _inside(elements, texts, key, "pos").withColumnRenamed("of_begin", "begin")
    return _joined_in_order(inside, [key, "begin"], "pos", "text", "t").withColumn("t", _inline(F.col("t")))


def section_type(tag: Column, title: Column, body: Column) -> Column:
    has = lambda c, words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(c), w))
    table = F.contains(F.lower(body), F.lit("<table")) | F.contains(body, F.lit("\n| "))
    named = F.when(has(title, SIDE_TITLES), "sidebar").when(has(title, CONTENT_TITLES), "content_section").when(has(body, SUMMARY_WORDS), "summary").otherwise("section")
    return F.when(tag == "aside", "sidebar").when(table, "table_section").otherwise(named)


def page_sections(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key, section_no, section_type, title, markdown, blocks (block_no, type, text, format): the sections of each page's main part.

    A section is an element right below the main container that says enough or holds a table; where there is none, the container. Its
    blocks are headings, paragraphs, list items and tables in order; a section without any is one block of text. Pages without
    text have no sections. Keys must be unique."""
    tokens = _stored(page_tokens(pages, key, html), "page-tokens")
    elements = _stored(measured_elements(tokens, key), "page-elements")
    texts = page_texts(tokens, key)
    main = _main_of(elements, key).select(key, F.col("begin").alias("m_begin"), F.col("end").alias("m_end"), F.col("level").alias("m_level"), F.col("tag").alias("m_tag"))
    whole = tokens.groupBy(key).agg((F.max("pos") + 1).alias("_last")).join(main, key, "left")
    main = whole.select(key, F.coalesce("m_begin", F.lit(-1)).alias("m_begin"), F.coalesce("m_end", "_last").alias("m_end"), F.coalesce("m_level", F.lit(0)).alias("m_level"), F.coalesce("m_tag", F.lit("")).alias("m_tag"))
    below = elements.join(main, key).filter("level = m_level + 1 and begin > m_begin and begin < m_end")
    enough = below.filter((F.col("n") >= LEAST_SECTION) | (F.col("tag") == "table") | (F.col("tables") > 0))
    enough = enough.select(key, "begin", "end", "tag")
    alone = main.join(enough.select(key).distinct(), key, "left_anti").select(key, F.col("m_begin").alias("begin"), F.col("m_end").alias("end"), F.col("m_tag").alias("tag"))
    number = F.row_number().over(Window.partitionBy(key).orderBy("begin"))
    roots = _stored(enough.unionByName(alone).withColumn("section_no", number), "page-roots")

    # Blocks, but those within tables; a section that is a block itself has no other.
    outer = elements.filter("tag = 'table' and around = 0")
    candidates = elements.filter(F.col("tag").isin(*BLOCK_TAGS) & (F.col("around") == 0)).select(key, F.col("begin").alias("at"), F.col("end").alias("at_end"), F.col("tag").alias("block_tag"))
    single = F.col("tag").isin("p", "table", *BLOCK_HEADINGS)
    blocks = candidates.join(roots, key).filter(F.when(single, F.col("at") == F.col("begin")).otherwise((F.col("at") > F.col("begin")) & (F.col("at") < F.col("end"))))
    blocks = blocks.select(key, "section_no", "at", "at_end", "block_tag")
    found = _texts_of(candidates.select(key, F.col("at").alias("begin"), F.col("at_end").alias("end")), texts, key).withColumnRenamed("begin", "at")
    # Tables are few: only pages that have any are gathered again.
    gathered = tokens.join(outer.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("_t"))
    markdown = gathered.select(key, F.inline(_tables_of_tokens(F.col("_t.token")))).select(key, F.col("begin").alias("at"), "markdown")
    spelt = tokens.withColumn("shown", F.col("token")).select(key, "pos", "shown")
    raw = _inside(outer.select(key, (F.col("begin") - 1).alias("begin"), (F.col("end") + 1).alias("end")), spelt, key, "pos").withColumn("at", F.col("of_begin") + 1)
    raw = _joined_in_order(raw, [key, "at"], "pos", "shown", "raw").withColumn("raw", _inline(F.col("raw")))
    blocks = blocks.join(found, [key, "at"], "left").join(markdown, [key, "at"], "left").join(raw, [key, "at"], "left")
    tag, t = F.col("block_tag"), F.coalesce("t", F.lit(""))
    heading = tag.isin(*BLOCK_HEADINGS)
    marked = F.when(heading, F.concat(F.repeat(F.lit("#"), F.substring(tag, 2, 1).cast("int")), F.lit(" "), t)).when(tag == "li", F.concat(F.lit("- "), t)).when(tag == "dd", F.concat(F.lit("  "), t)).otherwise(t)
    text = F.when(tag == "table", F.coalesce("markdown", "raw")).otherwise(marked)
    kept = blocks.filter((tag == "table") | (t != "")).select(
        key,
        "section_no",
        "at",
        F.when(tag == "table", "table").when(heading, "heading").otherwise("text").alias("type"),
        text.alias("text"),
        F.when(tag == "table", F.when(F.col("markdown").isNotNull(), "markdown").otherwise("html")).alias("format"),
        F.when(heading, t).alias("title"),
    )
    kept = _stored(kept, "page-blocks")
    empty = roots.join(kept.select(key, "section_no").distinct(), [key, "section_no"], "left_anti")
    plain = _texts_of(empty.select(key, "begin", "end"), texts, key).join(empty, [key, "begin"]).filter("t <> ''")
    none = F.lit(None).cast("string")
    every = kept.unionByName(plain.select(key, "section_no", F.col("begin").alias("at"), F.lit("text").alias("type"), F.col("t").alias("text"), none.alias("format"), none.alias("title")))
    every = every.withColumn("block_no", F.row_number().over(Window.partitionBy(key).orderBy("section_no", "at")) - 1)
    grouped = every.groupBy(key, "section_no").agg(
        F.array_sort(F.collect_list(F.struct("block_no", "type", "text", "format"))).alias("blocks"),
        F.coalesce(F.min_by("title", F.when(F.col("title").isNotNull(), F.col("at"))), F.lit("")).alias("title"),
    )
    body = F.btrim(F.regexp_replace(F.array_join(F.transform("blocks", lambda b: b["text"]), "\n\n"), r"\n{3,}", "\n\n"), F.lit(" \t\n\r\x0b\x0c"))
    out = grouped.withColumn("markdown", body).join(roots.select(key, "section_no", "tag"), [key, "section_no"])
    return out.select(key, "section_no", section_type(F.col("tag"), F.col("title"), F.col("markdown")).alias("section_type"), "title", "markdown", "blocks")


_PART = r"^([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+)*)$"


def _matches(part: str) -> Column:
    """Whether an element is what one part of a selector says: tag, classes, id."""
    tag, marks = re.match(_PART, part).groups()
    of = lambda name: F.regexp_extract("token", rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", 0)
    value = lambda name: F.regexp_replace(F.regexp_replace(of(name), rf"(?is)^\s{name}\s*=\s*", ""), "^[\"']|[\"']$", "")
    test = F.lit(True) if tag in (None, "", "*") else F.col("tag") == tag.lower()
    for m in re.findall(r"[.#][\w-]+", marks):
        test = test & (F.array_contains(F.split(value("class"), r"\s+"), m[1:]) if m[0] == "." else value("id") == m[1:])
    return test


def with_selector(pages: DataFrame, key: str, html: str, selector: str) -> DataFrame:
    """Pages with only the elements that a selector of tags, classes, ids and descent finds, in one div; a page in which it finds nothing
    stays whole, and so do all where it is ill-formed. Elements that have no end, as images, are not sought."""
    parts = selector.split()
    if not parts or not all(re.match(_PART, p) for p in parts):
        return pages
    tokens = _stored(page_tokens(pages, key, html), "page-tokens")
    elements = page_elements(tokens, key)
    found = elements.filter(_matches(parts[0]))
    for part in parts[1:]:
        inner = elements.filter(_matches(part))
        found = _inside(found, inner, key, "begin").select(*inner.columns).distinct()
    around = found.select(key, (F.col("begin") - 1).alias("begin"), (F.col("end") + 1).alias("end"))
    spelt = _joined_in_order(_inside(around, tokens.select(key, "pos", "token"), key, "pos"), [key, "of_begin"], "pos", "token", "one")
    whole = _joined_in_order(spelt, [key], "of_begin", "one", "_cut")
    out = pages.join(whole, key, "left")
    return out.withColumn(html, F.when(F.col("_cut").isNotNull(), F.concat(F.lit("<div>"), "_cut", F.lit("</div>"))).otherwise(F.col(html))).select(*pages.columns)
