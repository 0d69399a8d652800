import hashlib
import re

from granary.llm.pii import digest, find_personal_data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TEXTS = [
    None,
    "",
    "mail a.b@c.de_x@y.org, also @x.y and a@b and a@b..c",
    "host 10.0.0.1 1.2.3.4.5.6.7.8 300.1.1.1 1.2.3.45.6 0001.002.3.4",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112, 12 34 5678",
    "call +49 (0)30 1234567 or +1 2 or +123456789012345678 é +44 20 7946 0958.",
    "é" * 50 + " 4111111111111111 x@y.zz",
    "account DE89 3704 0044 0532 0130 00, not DE88370400440532013000",
    "7" * 70_000 + " " + "a" * 70_000 + " " + "1 " * 30_000,
    "x@y.zz " * 300,
    "x@y.zz  é 1.2.3.4 " * 20_000,
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            valid = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if valid:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [s for *_, s in sorted(out)]


def test_base_spans_equal_the_plain_patterns(documents):
    found = {r.doc_id: r for r in digest(find_personal_data(documents(TEXTS))).collect()}
    for i, text in enumerate(TEXTS):
        spans = plain_spans(text or "")
        assert found[i].base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest(), i
        assert found[i].n_email == sum(s.startswith("email") for s in spans)
        assert set(spans) <= set(found[i].spans.split(",")) | {""}


def test_checksums_and_context(documents):
    rows = {r.doc_id: r.spans for r in find_personal_data(documents(["account DE89 3704 0044 0532 0130 00", "xx DE88 3704 0044 0532 0130 00", "zz DE89370400440532013000"])).collect()}
    assert [s.kind for s in rows[0] if s.kind == "iban"] == ["iban"]
    assert not [s for s in rows[1] if s.kind == "iban"]
    assert [s.score for s in rows[0] if s.kind == "iban"][0] > [s.score for s in rows[2] if s.kind == "iban"][0]


def test_empty_table_and_clashing_columns(documents, spark):
    docs = documents(["x@y.zz"])
    assert digest(find_personal_data(docs.limit(0))).count() == 0
    found = find_personal_data(docs.withColumnRenamed("lang", "spans").withColumnsRenamed({"source": "row", "n_chars": "m_email"}))
    assert found.columns == ["doc_id", "text", "row", "m_email", "spans"] and found.first().row == "s0"
    assert digest(found).first().n_email == 1
