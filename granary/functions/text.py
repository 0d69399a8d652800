"""Text functions as column expressions. Null texts give what empty texts give unless a function says otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Punctuation that lexical normalisation turns into blanks.
LEXICAL_PUNCTUATION = "，。；：！？、（）【】《》“”‘’`~!@#$%^&*+=|\\/<>{}[],;:?\"'()"
# Words that make a keyword too general.
GENERIC_KEYWORDS = ("介绍", "说明", "相关内容", "内容", "文本", "文档", "资料", "信息", "问题", "答案", "总结", "摘要")
# Questions too vague to index.
VAGUE_QUESTIONS = ("它是什么", "这个问题如何处理", "这是什么", "如何处理这个问题")
# Summaries that say nothing, and openings that say nothing in short ones.
EMPTY_SUMMARIES = ("暂无摘要", "无", "未知", "未提及")
EMPTY_OPENINGS = ("本文介绍了", "这段内容介绍了", "主要介绍了", "这是关于")
# Words that tell what a question wants.
QUESTION_WORDS = ("如何", "怎么", "为什么", "原因", "是否", "能否", "哪些", "什么")
ANSWER_WORDS = ("步骤", "处理", "解决", "配置", "设置", "排查", "修复", "原因", "办法")
TABLE_WORDS = ("统计", "汇总", "合计", "平均", "同比", "环比", "筛选", "地区", "年份", "产品")

# Headings of a question-and-answer row.
QA_HEADINGS = {"question": "问题", "similar": "相似问题", "category": "分类", "tags": "标签", "answer": "答案"}


def col(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where `value` is worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Column) -> Column:
    """Without blanks at either end, wide ones included."""
    return F.regexp_replace(c, r"^[\s　]+|[\s　]+$", "")


def collapse(c: Column) -> Column:
    """Runs of blanks as one blank, none at the ends."""
    return F.btrim(F.regexp_replace(c, r"[\s\u3000]+", " "), F.lit(" "))


def _unmarked(c: Column | str) -> Column:
    return F.translate(F.lower(col(c)), LEXICAL_PUNCTUATION, " " * len(LEXICAL_PUNCTUATION))


def normalize_lexical(c: Column | str) -> Column:
    """Lower case, punctuation and line ends as blanks, blanks drawn together."""
    return collapse(_unmarked(c))


def lexical_tokens(c: Column | str) -> Column:
    """The distinct words of the normalised text."""
    return F.array_remove(F.array_distinct(F.split(_unmarked(c), r"[\s\u3000]+")), "")


def ascii_terms(c: Column | str) -> Column:
    """Distinct terms of at least two letters, digits or joining marks, in order of appearance."""
    found = F.regexp_extract_all(normalize_lexical(c), F.lit(r"([A-Za-z0-9][A-Za-z0-9_./:-]*)"), F.lit(1))
    bare = F.transform(found, lambda t: F.btrim(t, F.lit(".:/-_")))
    return F.array_distinct(F.filter(bare, lambda t: F.length(t) >= 2))


def cjk_terms(c: Column | str) -> Column:
    """Runs of ideographs and their two-letter windows, in order of appearance, distinct."""
    runs = F.filter(F.regexp_extract_all(normalize_lexical(c), F.lit(r"([㐀-䶿一-鿿]+)"), F.lit(1)), lambda r: F.length(r) >= 2)
    windows = F.transform(runs, lambda r: F.concat(F.array(r), F.when(F.length(r) > 2, F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))))
    return F.array_distinct(F.flatten(windows))


def without_stopwords(terms: Column, stopwords: list[str]) -> Column:
    """Terms that aren't stopwords as a whole."""
    return F.array_except(terms, F.array(*map(F.lit, stopwords)).cast("array<string>"))


def index_text(c: Column | str) -> Column:
    """What the lexical index stores: the normalised text, then its terms that differ from it."""
    text = normalize_lexical(c)
    return F.concat_ws(" ", text, F.array_join(F.array_except(F.array_union(ascii_terms(c), cjk_terms(c)), F.array(text)), " "))


def mixed_units(c: Column | str) -> Column:
    """Length of a text in units: an ideograph 1, a word 1 up to 8 characters and a quarter of its length beyond, any other mark 1."""
    pattern = r"([一-鿿㐀-䶿　-〿＀-￯]|[\p{L}\p{N}_]+|[^\s])"

    def counted(pieces: Column) -> Column:
        # Few words are long: all pieces count one, and the fold goes over what long ones have beyond that.
        long = F.filter(pieces, lambda p: F.length(p) > 8)
        return F.aggregate(long, F.size(pieces).cast("long"), lambda a, p: a + F.shiftright(F.length(p) + 3, 2) - 1)

    return let(F.regexp_extract_all(col(c), F.lit(pattern), F.lit(1)), counted)


def bigrams(c: Column) -> Column:
    """Distinct two-letter windows of the collapsed lower-case text; a single letter stands for itself."""
    text = collapse(F.lower(col(c)))
    n = F.length(text)
    windows = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2)))
    return F.when(n == 0, F.array().cast("array<string>")).when(n == 1, F.array(text)).otherwise(F.array_distinct(windows))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def overlap_coefficient(a: Column, b: Column) -> Column:
    """Shared terms over the size of the smaller set."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / least)


def terms(c: Column | str) -> Column:
    """Distinct words of the lower-case text."""
    return F.array_distinct(F.filter(F.split(F.lower(col(c)), r"\s+"), lambda t: t != ""))


def contained_share(query_terms: Column, text: Column) -> Column:
    """Share of the terms that the text contains."""
    n = F.size(query_terms)
    return F.when(n == 0, 0.0).otherwise(F.size(F.filter(query_terms, lambda t: F.contains(text, t))) / n)


def summary_score(query: Column, title: Column | str, summary: Column | str) -> Column:
    """How a document's title and summary fit a query: three parts of shared bigrams, one of contained terms."""
    text = F.concat_ws(" ", col(title), col(summary))
    return F.least(F.lit(1.0), 0.75 * jaccard(bigrams(query), bigrams(text)) + 0.25 * contained_share(terms(query), F.lower(text)))


def truncated(c: Column | str, most: int) -> Column:
    text = collapse(col(c))
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, max(0, most - 3))), F.lit("...")))


def lexical_score(raw: Column) -> Column:
    """An open-ended rank drawn into 0 to 1."""
    return F.when(raw <= 0, 0.0).otherwise(F.round(raw / (raw + 0.8), 4))


def question_match(query: Column, question: Column) -> Column:
    """How well a query fits a stored question: equal, contained, shared bigrams, shared terms."""
    q, s = normalize_lexical(query), normalize_lexical(question)
    asked, stored = F.array_union(ascii_terms(query), cjk_terms(query)), F.array_union(ascii_terms(question), cjk_terms(question))
    shared = F.when(F.size(asked) == 0, 0.0).otherwise(F.size(F.array_intersect(asked, stored)) / F.size(asked))
    score = F.when(q == s, 0.45).otherwise(0.0) + F.when(F.contains(s, q) | F.contains(q, s), 0.2).otherwise(0.0) + 0.25 * jaccard(bigrams(q), bigrams(s)) + 0.1 * shared
    return F.when((q == "") | (s == ""), 0.0).otherwise(F.least(F.lit(1.0), score))


def any_of(c: Column, words: tuple[str, ...]) -> Column:
    return c.rlike("|".join(words))


def query_traits(c: Column | str) -> Column:
    """short_query, question_like, answer_like, table_like."""
    text = normalize_lexical(c)
    flags = {"question_like": QUESTION_WORDS, "answer_like": ANSWER_WORDS, "table_like": TABLE_WORDS}
    return F.struct((F.length(text) <= 18).alias("short_query"), *(any_of(text, words).alias(name) for name, words in flags.items()))


# Web pages


def normalize_newlines(c: Column) -> Column:
    out = F.regexp_replace(c, r"\r\n?", "\n")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    return strip(F.regexp_replace(out, r"[ \t]{2,}", " "))


def strip_html(c: Column | str) -> Column:
    """A page's text: no scripts, styles or tags."""
    out = F.regexp_replace(col(c), r"(?is)<script.*?>.*?</script>", " ")
    out = F.regexp_replace(out, r"(?is)<style.*?>.*?</style>", " ")
    return strip(F.regexp_replace(F.regexp_replace(out, r"<[^>]+>", " "), r"\s{2,}", " "))


def markdown_to_plain(c: Column | str) -> Column:
    out = F.regexp_replace(col(c), r"!\[([^\]]*)\]\([^)]+\)", "$1")
    out = F.regexp_replace(out, r"\[([^\]]+)\]\([^)]+\)", "$1")
    out = F.regexp_replace(out, r"`{1,3}([^`]*)`{1,3}", "$1")
    out = F.regexp_replace(out, r"(?m)^[>#*\-\d.)\s]+", "")
    return normalize_newlines(F.regexp_replace(out, r"[*_~#]+", ""))


def meaningful_chars(c: Column | str) -> Column:
    return F.length(F.regexp_replace(col(c), r"[^0-9A-Za-z一-鿿]", ""))


def lines(c: Column | str) -> Column:
    """Lines that aren't blank, without blanks at their ends."""
    return F.filter(F.transform(F.split(col(c), r"\r\n|\n|\r"), strip), lambda x: x != "")


def link_lines(c: Column | str) -> Column:
    """Number of lines that are mostly links."""

    def linked(line: Column) -> Column:
        links, urls, n = F.regexp_count(line, F.lit(r"\[[^\]]+\]\([^)]+\)")), F.regexp_count(line, F.lit(r"(?i)https?://")), meaningful_chars(line)
        return (links >= 2) | ((links >= 1) & (n <= 40)) | ((urls >= 1) & (n <= 30))

    return F.size(F.filter(lines(c), linked))


def extraction_quality(text: Column, html: Column, least: int = 200) -> Column:
    """chars, paragraphs, link_ratio and the whole-number score of an extracted text against its page."""
    plain = markdown_to_plain(text)
    chars, page = meaningful_chars(plain), meaningful_chars(normalize_newlines(strip_html(html)))
    paragraphs = F.size(F.filter(lines(plain), lambda x: meaningful_chars(x) >= 20))
    all_lines = F.size(lines(plain))
    ratio = F.when(all_lines == 0, 0.0).otherwise(link_lines(text) / all_lines)
    one = lambda test, points=1: F.when(test, points).otherwise(0)
    score = one(chars >= max(80, least // 2)) + one(chars >= least, 2) + one(chars >= max(500, least * 2)) + one(paragraphs >= 2) + one(paragraphs >= 4)
    score = score + one(chars < 50, -2) + one(ratio >= 0.5, -2) + one((page >= max(800, least * 4)) & (chars < max(120, least // 2)), -2)
    return F.struct(chars.alias("chars"), paragraphs.alias("paragraphs"), ratio.alias("link_ratio"), score.alias("score"))


def normalize_url(c: Column | str) -> Column:
    """Lower-case scheme (https where none is given) and host, no fragment, no slash at the end of the path, the query kept."""
    url = strip(col(c))
    url = F.when(url.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://"), url).otherwise(F.concat(F.lit("https://"), url))
    bare = F.regexp_replace(url, "#.*$", "")
    head, rest = F.regexp_extract(bare, r"^([^:]+://[^/?]*)", 1), F.regexp_replace(bare, r"^[^:]+://[^/?]*", "")
    path, query = F.regexp_extract(rest, r"^([^?]*)", 1), F.regexp_extract(rest, r"(\?.*)$", 1)
    return F.when(strip(col(c)) == "", "").otherwise(F.concat(F.lower(head), F.regexp_replace(path, "/+$", ""), query))


# Cells, questions and keywords


def match_text(c: Column | str) -> Column:
    """Lower case, everything but letters, digits and underscores as one blank."""
    return F.trim(F.regexp_replace(F.lower(col(c)), r"[^\p{L}\p{N}_]+", " "))


def split_list(c: Column | str, separators: str) -> Column:
    """Parts between separators (a character class), trimmed, distinct, none empty."""
    return F.array_distinct(F.filter(F.transform(F.split(col(c), separators), strip), lambda x: x != ""))


def tags_of(c: Column | str) -> Column:
    return split_list(c, "[，,；;\n]")


def similar_questions(c: Column | str) -> Column:
    return split_list(c, r"\|\|")


def looks_like_datetime(c: Column) -> Column:
    return c.rlike(r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2})?)?$") | c.rlike(r"^\d{1,2}[-/]\d{1,2}[-/]\d{4}$") | c.rlike(r"^\d{4}年\d{1,2}月\d{1,2}日$")


def value_type(c: Column | str) -> Column:
    """bool, datetime, int, float or text."""
    v = strip(col(c))
    truth = F.lower(v).isin("true", "false", "yes", "no", "1", "0", "是", "否")
    return F.when(truth, "bool").when(looks_like_datetime(v), "datetime").when(v.rlike(r"^[+-]?\d+$"), "int").when(v.rlike(r"^[+-]?(\d+\.\d*|\.\d+|\d+)([eE][+-]?\d+)?$"), "float").otherwise("text")


def keywords(values: Column, most: int) -> Column:
    """Keywords without general, long, single foreign or sentence-like ones; the first of each spelling, at most `most`."""
    bare = F.transform(values, lambda v: F.btrim(collapse(col(v)), F.lit(" ,;:|/\\-")))
    good = F.filter(
        bare,
        lambda k: (k != "") & ~k.isin(*GENERIC_KEYWORDS) & ~((F.length(k) == 1) & k.rlike(r"[^\x00-\x7f]")) & (F.length(k) <= 40) & ~k.rlike("[。！？；\n\r]"),
    )
    return F.slice(first_of_each(good, F.lower), 1, most)


def questions(values: Column, most: int) -> Column:
    """Questions of at least six characters, none of the vague ones, each with a question mark, distinct but for case."""
    bare = F.filter(F.transform(values, lambda v: collapse(col(v))), lambda q: (F.length(q) >= 6) & ~any_of(q, VAGUE_QUESTIONS))
    marked = F.transform(bare, lambda q: F.when(q.rlike("[?？]$"), q).otherwise(F.concat(q, F.lit("？"))))
    return F.slice(first_of_each(marked, F.lower), 1, most)


def first_of_each(values: Column, key) -> Column:
    """The first value of each key, in order."""
    keys = F.transform(values, key)
    return F.filter(values, lambda v, i: F.array_position(keys, key(v)) == i + 1)


def low_value_summary(c: Column | str) -> Column:
    text = collapse(col(c))
    opening = text.rlike("^(" + "|".join(EMPTY_OPENINGS) + ")") & (F.length(text) <= 18)
    return (F.length(text) < 8) | text.isin(*EMPTY_SUMMARIES) | opening


def strip_json_fence(c: Column | str) -> Column:
    text = strip(col(c))
    inner = strip(F.regexp_replace(text, "^`+|`+$", ""))
    return F.when(text.startswith("```"), strip(F.regexp_replace(inner, "(?i)^json", ""))).otherwise(text)


def numeric_density(c: Column | str) -> Column:
    """Digits over characters that aren't blank."""
    solid = F.length(F.regexp_replace(col(c), r"\s", ""))
    return F.when(solid == 0, 0.0).otherwise(F.length(F.regexp_replace(col(c), r"[^0-9]", "")) / solid)


def row_hash(row: Column) -> Column:
    """SHA-256 of a map of strings as JSON with sorted keys and blanks after separators."""
    keys = F.array_sort(F.map_keys(row))
    quoted = lambda s: F.concat(F.lit('"'), F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    pair = lambda k: F.concat(quoted(k), F.lit(": "), F.coalesce(quoted(F.element_at(row, k)), F.lit("null")))
    return F.sha2(F.concat(F.lit("{"), F.array_join(F.transform(keys, pair), ", "), F.lit("}")), 256)


def qa_markdown(question: Column, answer: Column, similar: Column, category: Column, tags: Column) -> Column:
    """A question-and-answer row as Markdown; parts that are empty are left out, but for the question and the answer."""
    bullets = lambda c: F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), x)), "\n")
    part = lambda name, body: F.concat(F.lit(f"## {QA_HEADINGS[name]}\n"), body)
    filled = lambda name, body: F.when(F.coalesce(body, F.lit("")) != "", part(name, body))
    return strip(F.concat_ws("\n\n", part("question", strip(col(question))), filled("similar", bullets(similar)), filled("category", category), filled("tags", bullets(tags)), part("answer", strip(col(answer)))))


def content_hash(columns: dict[str, Column]) -> Column:
    """SHA-256 of named values as compact JSON with sorted keys; nulls are kept."""
    return F.sha2(F.to_json(F.struct(*(columns[k].alias(k) for k in sorted(columns))), {"ignoreNullFields": "false"}), 256)


def embedding_text(vector_text: Column, search_text: Column) -> Column:
    """What a search unit's vector is made of: its own text for that, else what is searched; an error where both are blank."""
    filled = lambda c: F.when(strip(F.coalesce(c, F.lit(""))) != "", strip(c))
    return F.coalesce(filled(vector_text), filled(search_text), F.raise_error(F.lit("a search unit has no text")).cast("string"))


def lenient_json(c: Column | str) -> Column:
    """The JSON object in a model's answer, bare, fenced or between other words; null where there is none."""
    bare = strip_json_fence(c)
    inner = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    whole = lambda x: F.when(F.try_parse_json(x).isNotNull() & x.rlike(r"^\s*\{"), x)
    return F.coalesce(whole(bare), whole(inner))
