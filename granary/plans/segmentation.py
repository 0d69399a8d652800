"""Dictionary segmentation: texts without blanks in ideographs, a dictionary of all words of the documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators import segmentation
from granary.plans.registry import query
from granary.sources.tables import table

LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: One ideograph a letter: the given tables hold none.
SIGNS = "".join(chr(0x4E00 + 7 * i) for i in range(26))


def unspaced(c: str) -> Column:
    """A text in ideographs, its blanks taken out."""
    return F.translate(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[ \t]+", ""), LETTERS, SIGNS)


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word"))
    counted = words.filter(F.length("word").between(1, 16)).groupBy("word").agg(F.count("*").alias("n"))
    parts = table(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("word")).distinct()
    signs = F.translate("word", LETTERS, SIGNS)
    return segmentation.weighted_dictionary(counted.select(signs.alias("word"), "n"), parts.select(signs.alias("word")))


#: Words of all documents with their counts, and those of the parts' names as the collection's own; sums are taken of whole millionths.
_DICTIONARY = f"""
counted AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) WHERE length(word) <= 16 GROUP BY word),
own AS (SELECT DISTINCT word FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS word FROM part)),
merged AS (SELECT coalesce(o.word, c.word) AS word, o.word IS NOT NULL AS own, CASE WHEN o.word IS NOT NULL THEN {segmentation.OWN_FREQUENCY} ELSE n END AS n FROM counted c FULL JOIN own o ON c.word = o.word),
dict AS MATERIALIZED (SELECT translate(word, '{LETTERS}', '{SIGNS}') AS word, own, length(word)::INT AS size, round((ln(n) - ln((SELECT sum(n) FROM merged))) * 1000000)::BIGINT AS weight FROM merged)
"""

#: The paths of all runs at once, letter by letter from the end; `best` holds (sum, size) of the letters behind.
_PATHS = """
runs AS MATERIALIZED (SELECT key, (unnest(range(len(r))))::INT AS run_no, unnest(r) AS run FROM (
  SELECT key, regexp_extract_all(translate(regexp_replace(lower(coalesce(body, '')), '[ \\t]+', '', 'g'), '{letters}', '{signs}'), '[㐀-䶿一-鿿]+') AS r FROM source)),
spots AS (SELECT key, run_no, run, unnest(range(1, length(run) + 1))::INT AS pos FROM runs),
edges AS (SELECT key, run_no, pos, list({{'weight': weight, 'size': size}}) AS words FROM (
  SELECT s.key, s.run_no, s.pos, d.size, d.weight FROM (SELECT *, unnest(range(1, 17)) AS n FROM spots) s JOIN dict d ON d.word = substring(s.run, s.pos, s.n) AND d.size = s.n) GROUP BY ALL),
nodes AS MATERIALIZED (SELECT s.key, s.run_no, s.pos, list_concat(coalesce(e.words, []), CASE WHEN len(list_filter(coalesce(e.words, []), lambda x: x.size = 1)) = 0
  THEN [{{'weight': (SELECT round(-ln(sum(n)) * 1000000)::BIGINT FROM merged), 'size': 1::INT}}] ELSE [] END) AS words FROM spots s LEFT JOIN edges e USING (key, run_no, pos)),
walk AS (SELECT key, run_no, length(run)::INT + 1 AS pos, [{{'sum': 0::BIGINT, 'size': 0::INT}}] AS best FROM runs
  UNION ALL SELECT w.key, w.run_no, n.pos, list_prepend(list_max(list_transform(n.words, lambda x: {{'sum': x.weight + w.best[x.size].sum, 'size': x.size}})), w.best) FROM walk w JOIN nodes n ON n.key = w.key AND n.run_no = w.run_no AND n.pos = w.pos - 1),
cut AS (SELECT key, run_no, 1 AS pos, best FROM walk WHERE pos = 1 UNION ALL SELECT key, run_no, pos + best[pos].size, best FROM cut WHERE best[pos].size > 0),
found AS (SELECT c.key, c.run_no, r.run, list(substring(r.run, c.pos, c.best[c.pos].size) ORDER BY c.pos) AS words FROM cut c JOIN runs r USING (key, run_no) WHERE c.best[c.pos].size > 0 GROUP BY ALL)
""".format(letters=LETTERS, signs=SIGNS)


@query(f"WITH RECURSIVE source AS (SELECT item_id AS key, text AS body FROM benchmark),{_DICTIONARY},{_PATHS} SELECT key AS item_id, run_no, array_to_string(words, ' ') AS words FROM found")
def segmented_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without blanks, cut into words of the dictionary."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", unspaced("text").alias("body"))
    found = segmentation.segmented(rows, "item_id", "body", dictionary(spark, sf_dir))
    return found.select("item_id", "run_no", F.array_join("words", " ").alias("words"))


@query(
    f"""WITH RECURSIVE source AS (SELECT p_partkey AS key, p_name || ' and ' || p_brand || ' ' || p_type AS body FROM part),{_DICTIONARY},{_PATHS},
    w AS (SELECT key, run_no, i, words[i] AS word, d.own FROM (SELECT *, unnest(range(1, len(words) + 1)) AS i FROM found) LEFT JOIN dict d ON d.word = words[i]),
    s AS (SELECT w.key, w.run_no, w.i, n, b, substring(w.word, b, n) AS word FROM w, (SELECT unnest([2, 3]) AS n), (SELECT unnest(range(1, 17)) AS b) WHERE length(w.word) > n AND b + n - 1 <= length(w.word) AND substring(w.word, b, n) IN (SELECT word FROM dict)
      UNION ALL SELECT key, run_no, i, 99, 1, word FROM w),
    o AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY part, run_no, i, n, b) AS place, word FROM (SELECT 0 AS part, key, run_no, i, 0 AS n, 0 AS b, word FROM w UNION ALL SELECT 1, * FROM s) WHERE length(word) >= 2),
    u AS (SELECT key, word, min(place) AS place FROM o GROUP BY ALL),
    stops AS (SELECT translate(unnest(['red', 'and', 'an']), '{LETTERS}', '{SIGNS}') AS word),
    t AS (SELECT u.key, list(u.word || ':' || CASE WHEN d.own THEN '1.0' ELSE '0.94' END ORDER BY place) AS terms FROM u JOIN dict d USING (word) WHERE u.word NOT IN (SELECT word FROM stops) GROUP BY u.key),
    g AS (SELECT key, list(DISTINCT word) AS ignored FROM u WHERE word IN (SELECT word FROM stops) GROUP BY key)
    SELECT key AS p_partkey, array_to_string(list_concat(coalesce(terms, []), list_transform(list_filter(regexp_extract_all(body, '[0-9]+'), lambda x: length(x) >= 2), lambda x: x || ':1.0')), ' ') AS terms, array_to_string(list_sort(coalesce(ignored, [])), ' ') AS ignored
    FROM source LEFT JOIN t USING (key) LEFT JOIN g USING (key)"""
)
def analyzed_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms that an index keeps of texts without blanks, with scores; stopwords are ignored."""
    name = F.concat("p_name", F.lit(" and "), "p_brand", F.lit(" "), "p_type")
    rows = table(spark, sf_dir, "part").select("p_partkey", name.alias("name")).select("p_partkey", unspaced("name").alias("body"))
    stops = [w.translate(str.maketrans(LETTERS, SIGNS)) for w in ("red", "and", "an")]
    found = segmentation.analyzed(rows, "p_partkey", "body", dictionary(spark, sf_dir), stops)
    terms = F.transform("terms", lambda t: F.concat(t["text"], F.lit(":"), t["score"].cast("string")))
    return found.select("p_partkey", F.array_join(terms, " ").alias("terms"), F.array_join(F.array_sort("ignored"), " ").alias("ignored"))
