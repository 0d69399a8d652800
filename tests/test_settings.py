from datetime import datetime

import pytest
from granary.functions import udfs
from granary.operators import candidates, lexical, qa, settings, table_rows, upserts
from pyspark.sql import functions as F


def test_scopes():
    assert settings.vector_scopes("qa") == ["question"] and settings.vector_scopes("qa", None, {"index_mode": "question_answer"}) == ["question", "answer"]
    assert settings.vector_scopes("table", ["default"]) == ["row"] and settings.vector_scopes("web", ["keyword", "default", "doc_summary"]) == ["default"]
    assert settings.vector_scopes("general") == list(settings.VECTOR_SCOPES)
    assert settings.lexical_scopes("qa", None, {"enable_keyword_recall": False}) == ["question"] and settings.lexical_scopes("qa")[-1] == "keyword"
    assert settings.lexical_scopes("general", ["doc_summary"]) == ["doc_summary"] and "row_group" in settings.lexical_scopes("table")


def test_layers():
    lexicon = settings.merged_lexicon([{"term": "Go", "aliases": ["golang", " "], "weight": 1.5}, {"term": " "}], [{"term": "go", "aliases": ["golang", "g"], "weight": 1, "enabled": False}])
    assert lexicon == [{"term": "go", "aliases": ["golang", "g"], "weight": 1.5, "source": "custom", "is_phrase": True, "enabled": False}]
    base = {"auto_filter_mode": "rule", "metadata_fields": [{"key": "a"}], "retrieval_stopwords": ["x"], "other": 1}
    out = settings.query_settings(base, {"extra_metadata_fields": [{"key": "b"}]}, stopwords=["w", "x"])
    assert out["auto_filter_mode"] == "rule" and [f["key"] for f in out["metadata_fields"]] == ["a", "b"] and out["retrieval_stopwords"] == ["w", "x"] and "other" not in out
    assert settings.query_settings(base, {"override_metadata_fields": [{"key": "c"}], "auto_filter_mode": "llm"})["metadata_fields"] == [{"key": "c"}]
    summaries = lambda request, persistent: settings.query_settings(base, request, persistent=persistent).get("enable_doc_summary_retrieval")
    assert summaries({}, {"enable_doc_summary_retrieval": False}) is False and summaries({"enable_doc_summary_retrieval": True}, {"enable_doc_summary_retrieval": False}) is True
    assert summaries({}, None) is None and summaries({}, {"other": 1}) is None
    chat = settings.chat_settings({"retrieval_test": {"top_k": 5, "w": {"a": 1, "b": 2}}}, {"top_k": 8, "w": {"b": 3}}, {"retrieval": {"w": {"a": 9}}})
    assert chat == {"top_k": 8, "w": {"a": 9, "b": 3}}
    assert qa.retrieval_config({"index_mode": "question_answer", "query_weight": 3, "answer_weight": "x"})["query_weight"] == round(1 / 1.2, 4)
    assert qa.retrieval_config({"index_mode": "question_answer", "query_weight": 0, "answer_weight": 0})["answer_weight"] == 0.2
    assert qa.retrieval_config(None) == {"index_mode": "question_only", "query_weight": 1.0, "answer_weight": 0.0, "enable_keyword_recall": True, "enable_category_filter": True, "enable_tag_filter": True}


def test_request_filters():
    good = "0b5c7a1e-1111-4222-8333-444455556666"
    f = candidates.normalized({"tag_id": good, "folder_ids": [good, "x", good], "metadata": {" k ": 1, "": 2}, "include_descendant_folders": False}, "tagged")
    assert f.tag_ids == (good,) and f.folder_ids == (good,) and f.document_metadata == (("k", 1),) and f.only_tagged and not f.descendants
    assert candidates.normalized(None, "latest").latest_days == 90 and candidates.id_list(None) == ()
    moved = candidates.qa_fields(candidates.normalized({"metadata": {"tags": "a", "category": "", "x": 1}}))
    assert moved.qa_fields == (("tag", "a"),) and moved.document_metadata == (("x", 1),)


def test_query_plans(spark):
    plan = lexical.query_plan("如何配置 VPN-2 网络？", stopwords=["如何"], synonyms=["tunnel"], weights={"vpn-2": 1.5}, priority_terms=["VPN-2"])
    assert plan.strict == ("如何配置", "vpn-2", "网络", "tunnel") and plan.terms == (("vpn-2", 1.5), ("tunnel", 1.0))
    assert plan.fallback == ("如何配置", "配置", "网络") and lexical.query_plan(" ， ") == lexical.QueryPlan()
    assert lexical.windows("如何配置网络", ["如何"]) == ["如何配置网络", "配置", "置网", "网络"]
    rows = spark.createDataFrame([(1, "配置网络 vpn-2 tunnel"), (2, "网络"), (3, "other"), (4, None)], "doc_id int, text string")
    found = lexical.recall(rows, plan, 5).collect()
    assert [r.doc_id for r in found] == [1, 2] and lexical.recall(rows, lexical.QueryPlan(), 5).count() == 0
    texts = ["如何配置网络", "如何", "网络如何 and 配置", "a", None]
    out = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", lexical.unstopped_windows("t", ["如何"]).alias("w")).orderBy("i").collect()
    assert [r.w for r in out] == [lexical.windows(t, ["如何"]) for t in texts]
    assert lexical.lexical_query("Red ring", "ring Crimson", [("ruby", ["gem", "red"])], ["gem"]) == "ring Crimson Red ruby"
    terms, phrases, weights = lexical.priority_hints([{"term": "go", "matched_text": "golang", "weight": 1.5, "is_phrase": True}, {"term": "go", "matched_text": "go", "weight": 0.5}], ["term", "ab", "x"])
    assert terms == ["go", "golang", "term", "ab"] and phrases == ["go", "golang", "term"] and weights["go"] == 1.5
    assert lexical.merged_stopwords(["A", "# note", "b"], ["a", "c "]) == ["a", "b", "c"]


def test_cron():
    at = datetime(2024, 2, 28, 23, 59, 30)
    assert udfs.next_cron("0 12 29 2 *", at) == datetime(2024, 2, 29, 12) and udfs.next_cron("0 12 29 2 *", datetime(2024, 3, 1)) == datetime(2028, 2, 29, 12)
    assert udfs.next_cron("5-10/5 0 * * 1,7", at) == datetime(2024, 3, 3, 0, 5)  # a Sunday
    assert udfs.next_cron("0 0 1 * 5", at) == datetime(2024, 3, 1) and udfs.next_cron("0 0 30 2 *", at) is None
    for bad in ("* * * *", "61 * * * *", "5-1 * * * *"):
        with pytest.raises(ValueError):
            udfs.next_cron(bad, at)


def test_registries_and_writers(spark, tmp_path):
    assert udfs.VECTOR_BACKENDS.get().__name__ == "vector_recall" and udfs.ANALYZERS.get("rules") is lexical.query_plan
    with pytest.raises(ValueError, match="no parser none"):
        udfs.PARSERS.get("none")
    path = str(tmp_path / "rows")
    rows = lambda *items: table_rows.row_uids(spark.createDataFrame(items, "doc long, sheet string, row_no int"), "doc", "sheet", "row_no")
    upserts.replace_partitions(rows((1, "a", 1), (1, "a", 2), (2, "b", 1)), path, "doc")
    upserts.replace_partitions(rows((1, "a", 2), (1, "a", 3)), path, "doc")
    out = spark.read.parquet(path).select(F.col("doc").cast("int"), "row_no", "row_uid").collect()
    assert sorted((r.doc, r.row_no) for r in out) == [(1, 2), (1, 3), (2, 1)] and len({r.row_uid for r in out}) == 3
