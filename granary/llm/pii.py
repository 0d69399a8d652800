"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

Everything is a column expression; no text leaves the JVM.
Null texts count as empty. Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Each pattern finds the same leftmost non-overlapping matches as the plain form in its comment. A match may only
#: start at the head of its run of characters or where the previous match ended, and the quantifiers keep what they
#: take, so that a long run costs linear time and no deep recursion.
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    # [0-9]([\x20-]?[0-9])+ of at least 12 digits; a shorter run of digits is never valid
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # added by the method
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
}
#: A text without this character has no match, and is not searched.
NEEDED = {"email": "@", "phone": "+"}
BASE_KINDS = ("email", "ip", "card", "phone")
CONTEXT = {
    "email": "mail|contact|reply|write to|address",
    "ip": r"\bip\b|host|server|login|address",
    "card": "card|visa|master|amex|payment|credit|debit",
    "phone": "phone|tel|call|mobile|fax|contact|whatsapp",
    "iban": "iban|account|bank|konto|compte|cuenta",
}
PRIOR = {"email": 0.85, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9}
CONTEXT_CHARS = 48
CHUNK = 512


def luhn_valid(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def step(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = d * 2
        doubled = F.when(twice > 9, twice - 9).otherwise(twice)
        return total + F.when((n - i) % 2 == 1, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step) % 10 == 0


def mod97_valid(iban: Column) -> Column:
    """Whether an account number without blanks leaves 1 modulo 97 (letters count 10 to 35, the first four go last)."""
    moved = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, F.lit(1), F.lit(4)))

    def step(rest: Column, i: Column) -> Column:
        code = F.ascii(F.substring(moved, i, F.lit(1)))
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), step) == 1


def _confirmed(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return match.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.when(n.between(12, 19), luhn_valid(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(9, 15)
    if kind == "iban":
        plain = F.regexp_replace(match, " ", "")
        return F.when(F.length(plain).between(15, 34), mod97_valid(plain)).otherwise(F.lit(False))
    return F.lit(True)


SPAN = "struct<start:int,kind_no:int,kind:string,end:int,score:double>"


def _spans(kind: str, text: Column, matches: Column) -> Column:
    """The confirmed spans of one kind, from its matches and what lies between them."""
    between = F.split(text, PATTERNS[kind], -1)
    pairs = F.arrays_zip(F.slice(between, F.lit(1), F.size(matches)).alias("gap"), matches.alias("hit"))

    def place(done: Column, pair: Column, base: Column) -> Column:
        last = F.coalesce(F.try_element_at(done, F.lit(-1))["end"], base)
        start = last + F.length(pair["gap"])
        return F.array_append(done, F.struct(start.alias("start"), (start + F.length(pair["hit"])).alias("end"), pair["hit"].alias("hit")))

    # A fold copies what it has gathered at each step: it runs over chunks of matches, from where each chunk begins.
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / CHUNK).cast("int")), lambda i: F.slice(pairs, i * CHUNK + 1, F.lit(CHUNK)))
    lengths = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda n, x: n + F.length(x["gap"]) + F.length(x["hit"])))
    bases = F.aggregate(lengths, F.array(F.lit(0)), lambda done, n: F.array_append(done, F.element_at(done, -1) + n))
    empty = F.array().cast("array<struct<start:int,end:int,hit:string>>")
    spans = F.zip_with(chunks, F.slice(bases, F.lit(1), F.size(chunks)), lambda c, base: F.aggregate(c, empty, lambda done, x: place(done, x, base)))
    placed = F.flatten(spans)
    valid = F.filter(placed, lambda x: _confirmed(kind, x["hit"]))

    def scored(x: Column) -> Column:
        start = x["start"]
        from_ = F.greatest(start - CONTEXT_CHARS, F.lit(0))
        near = F.lower(F.substring(text, from_ + 1, start - from_))
        score = F.lit(PRIOR[kind]) + F.when(near.rlike(CONTEXT[kind]), 0.1).otherwise(0.0)
        return F.struct(start.alias("start"), F.lit(list(PATTERNS).index(kind)).alias("kind_no"), F.lit(kind).alias("kind"), x["end"].alias("end"), score.alias("score"))

    return F.transform(valid, scored)


def find_personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds `spans`: array of (start, kind_no, kind, end, score), by start, then kind; code points, end exclusive.

    Confirmed matches only. A null or empty text has none; the columns of docs stay (a column named spans is replaced).
    """
    others = [c for c in docs.columns if c != "spans"]
    out = docs.select(F.struct(*others).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    none = F.array().cast("array<string>")
    for kind, pattern in PATTERNS.items():
        found = F.regexp_extract_all(F.col("text"), F.lit(pattern), F.lit(0))
        out = out.withColumn(f"m_{kind}", F.when(F.contains(F.col("text"), F.lit(NEEDED[kind])), found).otherwise(none) if kind in NEEDED else found)
    for kind in PATTERNS:
        out = out.withColumn(f"s_{kind}", F.when(F.size(f"m_{kind}") > 0, _spans(kind, F.col("text"), F.col(f"m_{kind}"))).otherwise(F.array().cast(f"array<{SPAN}>")))
    return out.select("row.*", F.array_sort(F.concat(*(F.col(f"s_{k}") for k in PATTERNS))).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, the number of base spans of each kind, the hash of the base spans, and all spans as one string."""
    base = F.filter("spans", lambda x: x["kind_no"] < len(BASE_KINDS))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), F.round(F.array_max(F.transform("spans", lambda x: x["score"])), 3).alias("top_score"))


def op3_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digest(find_personal_data(docs))
