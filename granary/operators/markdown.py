"""Markdown elements, and splitting them within a budget so that every part stands by itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.text import col, let, mixed_units, strip
from granary.operators.chunking import packed

KINDS = ("code", "table", "list", "quote", "html", "plain")


def _kind(line: Column) -> Column:
    """What a line outside of code is."""
    return (
        F.when(line.rlike(r"^\s*\|"), "table")
        .when(line.rlike(r"^\s*([-*+]|\d+[.)]) "), "list")
        .when(line.rlike(r"^\s*>"), "quote")
        .when(line.rlike(r"^\s*</?[a-zA-Z]"), "html")
        .otherwise("plain")
    )


def _kinds(lines: Column) -> Column:
    """The kind of each line. Every second fence ends what the one before began; the last may be open."""
    n = F.size(lines)
    fences = F.filter(F.sequence(F.lit(1), n), lambda i: F.get(lines, i - 1).rlike(r"^\s*```"))

    def stretch(at: Column, k: Column) -> Column:
        """What lies between two codes, and the code behind it."""
        before, begin, end = F.when(k == 0, 0).otherwise(F.get(at, 2 * k - 1)), F.coalesce(F.get(at, 2 * k), n + 1), F.coalesce(F.get(at, 2 * k + 1), n)
        return F.concat(F.transform(F.slice(lines, before + 1, begin - before - 1), _kind), F.array_repeat(F.lit("code"), end - begin + 1))

    return let(fences, lambda at: F.flatten(F.transform(F.sequence(F.lit(0), F.shiftright(F.size(at), 1)), lambda k: stretch(at, k))))


def elements(df: DataFrame, key: str, body: str) -> DataFrame:
    """key, element, kind, first_line, content: runs of lines of one kind. A fence and all up to its end are code.

    Lines stay in their row: each is looked at by its place, so that none is sorted or sent and a text costs what its length does."""

    def runs(lines: Column, kinds: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: (i == 1) | (F.get(kinds, i - 1) != F.get(kinds, i - 2)))

        def run(starts: Column, start: Column, j: Column) -> Column:
            text = F.array_join(F.slice(lines, start, F.coalesce(F.get(starts, j + 1), F.size(lines) + 1) - start), "\n")
            return F.struct((j + 1).cast("long").alias("element"), F.get(kinds, start - 1).alias("kind"), (start - 1).alias("first_line"), text.alias("content"))

        return let(starts, lambda starts: F.transform(starts, lambda start, j: run(starts, start, j)))

    found = let(F.split(col(body), "\n"), lambda lines: let(_kinds(lines), lambda kinds: runs(lines, kinds)))
    return df.select(key, F.explode(found).alias("_e")).select(key, "_e.*").filter(strip(F.col("content")) != "")


def _lines(c: Column) -> Column:
    return F.filter(F.split(c, "\n"), lambda x: strip(x) != "")


def split_table(c: Column, budget: int) -> Column:
    """Rows packed to a budget of units, each part with the table's header; a row over the budget is a part of its own."""

    def cut(rows: Column, n_head: Column) -> Column:
        head = F.array_join(F.slice(rows, F.lit(1), n_head), "\n")
        body = F.slice(rows, n_head + 1, F.greatest(F.size(rows) - n_head, F.lit(0)))
        return let(head, lambda h: F.transform(packed(body, budget, "\n", size=mixed_units), lambda p: F.concat_ws("\n", h, p)))

    def parts(rows: Column) -> Column:
        ruled = F.coalesce(F.try_element_at(rows, F.lit(2)).rlike(r"^[\s|:-]+$"), F.lit(False))
        n_head = F.when(ruled, 2).otherwise(F.least(F.size(rows), F.lit(1)))
        return let(n_head, lambda n: F.when(F.size(rows) <= n, F.array(F.array_join(rows, "\n"))).otherwise(cut(rows, n)))

    return let(_lines(c), parts)


def split_wide_table(c: Column, columns: int) -> Column:
    """A table cut into groups of columns, the first column in each."""
    rows = F.transform(_lines(c), lambda r: F.transform(F.split(F.regexp_replace(r, r"^\s*\||\|\s*$", ""), r"\|"), lambda x: F.trim(x)))
    line = lambda r, at: F.concat(F.lit("| "), F.array_join(F.concat(F.slice(r, 1, 1), F.slice(r, at, F.lit(max(1, columns - 1)))), " | "), F.lit(" |"))

    def parts(rows: Column, width: Column) -> Column:
        starts = F.sequence(F.lit(2), F.greatest(width, F.lit(2)), F.lit(max(1, columns - 1)))
        return F.when(width <= columns, F.array(c)).otherwise(F.transform(starts, lambda at: F.array_join(F.transform(rows, lambda r: line(r, at)), "\n")))

    return let(rows, lambda rows: let(F.size(F.try_element_at(rows, F.lit(1))), lambda width: parts(rows, width)))


def split_header_heavy_table(c: Column, budget: int) -> Column:
    """A table whose header takes more than the budget allows, cut by columns and then by rows: columns are dealt in order into
    groups whose header takes half of the budget at most (one column at least), the first column, the key, stands in each, and
    the rows of each group are packed as `split_table` does."""
    # A cell takes its text, its rule below and the bars beside both.
    cost = lambda cell: mixed_units(cell) + 5
    kind = "struct<done: array<array<int>>, now: array<int>, n: bigint>"
    none = F.array().cast("array<int>")
    start = F.struct(F.array().cast("array<array<int>>").alias("done"), none.alias("now"), F.lit(0).cast("long").alias("n")).cast(kind)

    def groups(costs: Column) -> Column:
        room = F.greatest(F.lit(budget // 2).cast("long") - costs[0], F.lit(1).cast("long"))

        def step(s: Column, i: Column) -> Column:
            full = (F.size(s["now"]) > 0) & (s["n"] + F.get(costs, i) > room)
            grown = F.struct(s["done"].alias("done"), F.array_append(s["now"], i).alias("now"), (s["n"] + F.get(costs, i)).alias("n"))
            begun = F.struct(F.array_append(s["done"], s["now"]).alias("done"), F.array(i).alias("now"), F.get(costs, i).alias("n"))
            return F.when(full, begun.cast(kind)).otherwise(grown.cast(kind))

        return F.aggregate(F.sequence(F.lit(1), F.size(costs) - 1), start, step, lambda s: F.array_append(s["done"], s["now"]))

    def parts(rows: Column) -> Column:
        cell = lambda r, i: F.coalesce(F.get(r, i), F.lit(""))
        line = lambda r, group: F.concat(F.lit("| "), F.array_join(F.transform(F.concat(F.array(F.lit(0)), group), lambda i: cell(r, i)), " | "), F.lit(" |"))
        table = lambda group: F.array_join(F.transform(rows, lambda r: line(r, group)), "\n")
        costs = F.transform(F.get(rows, F.lit(0)), cost)
        return F.flatten(F.transform(let(costs, groups), lambda g: split_table(table(g), budget)))

    cells = F.transform(_lines(c), lambda r: F.transform(F.split(F.regexp_replace(r, r"^\s*\||\|\s*$", ""), r"(?<!\\)\|"), lambda x: F.trim(x)))
    return let(cells, lambda rows: F.when(F.size(F.get(rows, F.lit(0))) <= 2, split_table(c, budget)).otherwise(parts(rows)))


def header_units(c: Column) -> Column:
    """What the header of a table takes."""
    return mixed_units(F.array_join(F.slice(_lines(c), 1, 2), "\n"))


# Tags that have no end.
VOID_TAGS = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")


def split_html(c: Column, budget: int) -> Column:
    """HTML cut to a budget of units so that each part is balanced: what is open at a cut is closed before it and opened again behind.

    Cuts come between words, and never right before an end tag or after a start tag. An end tag ends what is open within its
    element, too; one that nothing opened is left out. The texts of the parts together are that of the whole. A part is
    over the budget only where the tags around one word are.
    """
    tokens = F.regexp_extract_all(c, F.lit(r"(?s)<!--.*?-->|</?[A-Za-z][^>]*>|<![^>]*>|[^<\s]+\s*|\s+|<"), F.lit(0))
    tag = "struct<name: string, tag: string>"
    kind = f"struct<done: array<string>, now: string, n: bigint, said: boolean, open: array<{tag}>>"
    closers = lambda open_: F.array_join(F.transform(F.reverse(open_), lambda t: F.concat(F.lit("</"), t["name"], F.lit(">"))), "")
    openers = lambda open_: F.array_join(F.transform(open_, lambda t: t["tag"]), "")
    tail = lambda open_: 4 * F.size(open_)  # noqa: E731  an end tag takes four units

    def step(s: Column, x: Column) -> Column:
        name = F.lower(F.regexp_extract(x, r"^</?([A-Za-z][A-Za-z0-9:-]*)", 1))
        ends, begins = x.startswith("</"), x.rlike(r"^<[A-Za-z]") & ~x.rlike(r"/>$") & ~name.isin(*VOID_TAGS)
        units = mixed_units(x)
        # A start tag is put off with what follows it: it never ends a part.
        full = s["said"] & ~ends & (s["n"] + units + tail(s["open"]) > budget)
        done = F.when(full, F.array_append(s["done"], F.concat(s["now"], closers(s["open"])))).otherwise(s["done"])
        now = F.when(full, openers(s["open"])).otherwise(s["now"])
        n = F.when(full, mixed_units(openers(s["open"]))).otherwise(s["n"])
        said = F.when(full, False).otherwise(s["said"])
        at = F.array_max(F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.size(s["open"]), F.lit(1))), lambda i: F.coalesce(F.try_element_at(s["open"], i)["name"] == name, F.lit(False))), lambda i: i))
        kept = F.slice(s["open"], F.lit(1), F.greatest(F.coalesce(at, F.lit(1)) - 1, F.lit(0)))
        inner = F.slice(s["open"], F.coalesce(at, F.lit(1)) + 1, F.greatest(F.size(s["open"]) - F.coalesce(at, F.lit(1)), F.lit(0)))
        text = F.when(ends, F.when(at.isNotNull(), F.concat(closers(inner), F.lit("</"), name, F.lit(">"))).otherwise("")).otherwise(x)
        open_ = F.when(ends & at.isNotNull(), kept).when(begins, F.array_append(s["open"], F.struct(name.alias("name"), x.alias("tag")))).otherwise(s["open"])
        return F.struct(done.alias("done"), F.concat(now, text).alias("now"), (n + F.when(ends & at.isNull(), 0).otherwise(units)).alias("n"), (said | ~(ends | begins)).alias("said"), open_.alias("open")).cast(kind)

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(0).cast("long").alias("n"), F.lit(False).alias("said"), F.array().cast(f"array<{tag}>").alias("open")).cast(kind)
    return F.aggregate(tokens, start, step, lambda s: F.when(s["now"] != "", F.array_append(s["done"], F.concat(s["now"], closers(s["open"])))).otherwise(s["done"]))


def split_list(c: Column, budget: int) -> Column:
    """Items packed to a budget of units; lines that go on with an item stay with it."""
    items = F.filter(F.split(c, r"\n(?=\s*(?:[-*+]|\d+[.)]) )"), lambda x: strip(x) != "")
    return packed(items, budget, "\n", size=mixed_units)


def split_code(c: Column, budget: int) -> Column:
    """Lines of code packed to a budget, each part within fences of the same language."""
    head = F.regexp_extract(c, r"^\s*(```[^\n]*)", 1)
    inner = F.regexp_replace(F.regexp_replace(c, r"^\s*```[^\n]*\n?", ""), r"\n?\s*```\s*$", "")
    parts = packed(F.split(inner, "\n"), budget, "\n", size=lambda x: mixed_units(x) + 1)
    return F.transform(parts, lambda p: F.concat_ws("\n", F.when(head != "", head), p, F.when(head != "", F.lit("```"))))


def split_quote(c: Column, budget: int) -> Column:
    return packed(_lines(c), budget, "\n", size=mixed_units)


def split_lines(c: Column, budget: int, least: int = 5) -> Column:
    """Parts of equally many lines, as many as fit the budget at the mean length of a line, at least `least`."""
    lines = F.split(c, "\n")
    mean = F.greatest(mixed_units(c) / F.size(lines), F.lit(1.0))
    n = F.greatest(F.floor(F.lit(budget) / mean), F.lit(least)).cast("int")
    return F.transform(F.sequence(F.lit(1), F.size(lines), n), lambda i: F.array_join(F.slice(lines, i, n), "\n"))


def split_element(kind: Column, c: Column, budget: int) -> Column:
    """The parts of an element that is over the budget; others stay whole."""
    table = F.when(header_units(c) >= budget, split_header_heavy_table(c, budget)).otherwise(split_table(c, budget))
    parts = F.when(kind == "table", table).when(kind == "html", split_html(c, budget)).when(kind == "list", split_list(c, budget)).when(kind == "code", split_code(c, budget)).when(kind == "quote", split_quote(c, budget)).otherwise(split_lines(c, budget))
    return F.when(mixed_units(c) <= budget, F.array(c)).otherwise(parts)


def merge_small(pieces: Column, least: int, most: int, joiner: str = "\n\n") -> Column:
    """Neighbours drawn together when either is below `least` and both fit `most`; a short tail so goes to what is before it."""
    kind = "array<struct<p:string,n:bigint>>"
    sized = F.transform(pieces, lambda p: F.struct(p.alias("p"), mixed_units(p).alias("n")))

    def step(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        fits = last.isNotNull() & ((last["n"] < least) | (x["n"] < least)) & (last["n"] + x["n"] <= most)
        joined = F.struct(F.concat_ws(joiner, last["p"], x["p"]).alias("p"), (last["n"] + x["n"]).alias("n"))
        return F.when(fits, F.array_append(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), joined)).otherwise(F.array_append(done, x)).cast(kind)

    return F.transform(F.aggregate(sized, F.array().cast(kind), step), lambda x: x["p"])


def parents(children: Column, target: int) -> Column:
    """Children drawn together greedily into parents of at most `target` units."""
    return packed(children, target, "\n\n", size=mixed_units)
