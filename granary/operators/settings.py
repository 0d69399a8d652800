"""Settings of a retrieval, resolved on the driver: scopes that may be searched, and layers that override each other."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.operators.rules import merged_config

# What is searched where nothing is said.
VECTOR_SCOPES = ("default", "summary", "question", "answer", "row", "page_body")
LEXICAL_SCOPES = ("default", "summary", "doc_summary", "question", "keyword", "answer", "row", "row_fragment", "page_body")
TABLE_VECTOR_SCOPES = ("row",)
TABLE_LEXICAL_SCOPES = ("row", "row_group", "row_fragment", "keyword")
UNVECTORISED = ("keyword", "doc_summary")
QUERY_KEYS = ("enable_query_rewrite", "enable_synonym_rewrite", "auto_filter_mode", "retrieval_lexicon", "retrieval_stopwords", "llm_candidate_min_confidence", "llm_upgrade_confidence_threshold", "llm_max_upgrade_count")

SUMMARY_KEY = "enable_doc_summary_retrieval"


def vector_scopes(kind: str, asked: list[str] | None = None, qa: dict | None = None) -> list[str]:
    """Scopes recalled by vectors: questions (and answers, if indexed), rows of tables, else what is asked for."""
    if kind == "qa":
        return ["question", "answer"] if (qa or {}).get("index_mode") == "question_answer" else ["question"]
    if kind == "table":
        return list(TABLE_VECTOR_SCOPES)
    return [s for s in asked if s not in UNVECTORISED] if asked else list(VECTOR_SCOPES)


def lexical_scopes(kind: str, asked: list[str] | None = None, qa: dict | None = None) -> list[str]:
    """Scopes recalled by words."""
    if kind == "qa":
        return vector_scopes("qa", None, qa) + (["keyword"] if (qa or {}).get("enable_keyword_recall", True) else [])
    if kind == "table":
        return list(TABLE_LEXICAL_SCOPES)
    return list(asked) if asked else list(LEXICAL_SCOPES)


def default_scope(source_type: Column, role: Column, kind: str) -> Column:
    """The scope of a chunk's own text: rows and their parts, bodies of pages, or the default."""
    row = F.when(F.trim(F.coalesce(role, F.lit(""))) == "excel_row_fragment", "row_fragment").otherwise("row")
    return F.when((source_type == "table") | F.lit(kind == "table"), row).when((source_type == "web") | F.lit(kind == "web"), "page_body").otherwise("default")


def merged_lexicon(*lists: list[dict]) -> list[dict]:
    """Items of several lists, one for each term but for case: the last spelling, all aliases, the greatest weight; of the
    rest what was said last."""
    out: dict[str, dict[str, Any]] = {}
    for item in (x for items in lists for x in items or ()):
        term = str(item.get("term") or "").strip()
        if not term:
            continue
        old = out.get(term.lower(), {})
        aliases = [a for a in (str(x or "").strip() for x in [*old.get("aliases", []), *(item.get("aliases") or [])]) if a]
        last = {k: item.get(k, old.get(k, d)) for k, d in (("is_phrase", True), ("enabled", True))}
        source = str(item.get("source") or old.get("source") or "custom").strip() or "custom"
        out[term.lower()] = {"term": term, "aliases": list(dict.fromkeys(aliases)), "weight": max(float(old.get("weight") or 0), float(item.get("weight") or 0)), "source": source} | last
    return list(out.values())


def query_settings(defaults: dict | None, request: dict | None, lexicon: list[dict] = (), stopwords: list[str] = (), persistent: dict | None = None) -> dict:
    """A request's query settings over a collection's, key by key. Metadata fields: overriding ones alone, else the request's
    (or the collection's) and the extra ones. Lexicon and stopwords are added to the built-in ones. Whether summaries of documents
    are searched comes from the collection's persistent context, unless the request says it."""
    base, out = defaults or {}, dict(request or {})
    out = {k: base[k] for k in QUERY_KEYS if k in base and k not in out} | out
    some = lambda d, k: list(d[k]) if isinstance(d.get(k), list) else []
    out["metadata_fields"] = some(out, "override_metadata_fields") or [*(some(out, "metadata_fields") or some(base, "metadata_fields")), *some(out, "extra_metadata_fields")]
    if SUMMARY_KEY in (persistent or {}):
        out.setdefault(SUMMARY_KEY, persistent[SUMMARY_KEY])
    out["retrieval_lexicon"] = merged_lexicon(list(lexicon), out.get("retrieval_lexicon") or [])
    out["retrieval_stopwords"] = list(dict.fromkeys([*stopwords, *(out.get("retrieval_stopwords") or [])]))
    return out


def chat_settings(collection: dict | None, session: dict | None, binding: dict | None) -> dict:
    """Retrieval settings of a chat: the collection's, over them the session's, over those the binding's."""
    return merged_config((collection or {}).get("retrieval_test") or {}, session or {}, (binding or {}).get("retrieval") or {})
