"""Each stage of the pipeline against a plain version of it, on what the stage before kept."""

import collections
import random

import corpus_pipeline
from granary.llm import catalog, toxicity
from granary.llm.common import DOCUMENT_COLUMNS
from granary.llm.mixing import mix_counts
from granary.llm.packing import MODEL
from granary.llm.token_counts import tokenizer_path
from tokenizers import Tokenizer

from tests.llm.test_line_dedup import plain as plain_lines
from tests.llm.test_near_duplicates import plain as plain_groups


def corpus():
    random.seed(8)
    words = ["".join(random.choice("abcdefgh") for _ in range(random.randint(2, 7))) for _ in range(400)]
    rows, labels = [], []
    for i in range(400):
        text = [random.choice(words) for _ in range(random.randint(20, 120))]
        if i % 5 == 0:
            text[3:6] = ["scum", "trash", "vermin"]
        lines = [" ".join(text[k : k + 12]) for k in range(0, len(text), 12)]
        if i % 3 == 0:
            lines.append("this line stands on very many sites")
        if i % 10 == 7 and rows:
            lines = rows[-1][1].split("\n")
            lines[0] += " changed"
        rows.append((i, "\n".join(lines), f"s{i % 6}"))
        labels.append((i, 1, int(i % 5 == 0)))
    return [*rows, (400, None, "s1"), (401, "", None)], labels


def test_stages(spark, documents, tmp_path):
    rows, labels = corpus()
    documents(rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    sf = str(tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "near_duplicates", "mix", "packing"]

    def step(name, docs):
        out = stages[name](spark, docs, sf)
        if name != "packing":
            assert tuple(out.columns) == DOCUMENT_COLUMNS
        out.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    clean = step("toxicity", docs)
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert {r.doc_id for r in clean.collect()} == {i for i, t, _ in rows if model.score(t or "") < toxicity.THRESHOLD}
    assert sum(1 for r in clean.collect() if "scum" in (r.text or "")) < 8 and clean.count() > 300

    cut = step("line_dedup", clean)
    want = plain_lines([(r.doc_id, r.text, r.source) for r in clean.collect()])
    assert {r.doc_id: r.text for r in cut.collect()} == {i: t for i, (_, _, t) in want.items()}

    single = step("near_duplicates", cut)
    ordered = sorted((r.doc_id, r.text) for r in cut.collect() if r.text is not None) + [(r.doc_id, None) for r in cut.collect() if r.text is None]
    groups = plain_groups([t for _, t in ordered])
    assert {r.doc_id for r in single.collect()} == {ordered[i][0] for i, (_, group) in groups.items() if i == group}

    mixed = step("mix", single)
    taken = collections.Counter()
    for r in mixed.collect():
        taken[r.doc_id] += len(r.text.split())
    assert {r.doc_id: r.taken for r in mix_counts(single).collect() if r.taken} == dict(taken)

    pieces = step("packing", mixed).collect()
    library = Tokenizer.from_file(tokenizer_path(MODEL))
    tokens = collections.Counter()
    for r in mixed.collect():
        tokens[r.doc_id] += len(library.encode(r.text, add_special_tokens=False).ids) + 1
    packed = collections.Counter()
    for r in pieces:
        packed[r.doc_id] += r.length
    assert packed == tokens
    whole = collections.Counter()
    for r in corpus_pipeline.run(spark, sf).collect():
        whole[r.doc_id] += r.length
    assert whole == packed


def test_the_whole_pipeline_on_odd_tables(spark, documents, tmp_path):
    """No documents, no labels, ids and texts that are null: every stage runs, and what has words is packed."""
    rows = [(None, "some words of a text without an id", "a"), (None, "some words of a text without an id", "a"), (3, None, None), (3, "other words stand here for the third", None), (None, None, "b")]
    for name, kept, labels in (("none", [], []), ("unlabelled", rows, []), ("null_labels", rows, [(None, 1, 1), (3, None, None)])):
        sf = str(tmp_path / name)
        documents(rows).limit(len(kept)).write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
        out = corpus_pipeline.run(spark, sf).collect()
        assert {r.doc_id for r in out} == ({None, 3} if kept else set())
        assert len({r.doc_tokens for r in out}) == (2 if kept else 0) or not kept


def test_registered_names():
    assert [f"op{n}_" for n in range(1, 14)] == [name[: len(f"op{n}_")] for n, name in enumerate(sorted(catalog.queries(), key=lambda x: int(x[2:].split("_")[0])), 1)]
