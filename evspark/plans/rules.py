"""Routing rules as data, and their settings as a small table."""

from __future__ import annotations

#: Conditions in order; the first that holds decides. "any" and "all" nest.
RULES = (
    ("tier-1-def", {"question_type": {"in": ["definition", "factual"]}, "quantitativity": {"lt": 0.45}, "complexity": {"lt": 0.60}}),
    ("tier-2b", {"quantitativity": {"ge": 0.60}, "any": [{"spatial_specificity": {"ge": 0.60}}, {"temporal_specificity": {"ge": 0.60}}]}),
    (
        "tier-3",
        {
            "question_type": {"in": ["mechanism", "method_eval", "comparison"]},
            "any": [
                {"methodological_depth": {"ge": 0.55}},
                {"all": [{"complexity": {"ge": 0.75}}, {"methodological_depth": {"ge": 0.45}}]},
                {"all": [{"question_type": {"in": ["comparison", "method_eval"]}}, {"methodological_depth": {"ge": 0.40}}]},
                {"all": [{"question_type": {"in": ["mechanism"]}}, {"methodological_depth": {"ge": 0.45}}, {"complexity": {"ge": 0.60}}]},
            ],
        },
    ),
    ("tier-2a", {"quantitativity": {"ge": 0.55}, "methodological_depth": {"lt": 0.55}}),
    ("tier-m", {"complexity": {"ge": 0.40}}),
    ("tier-1", {"complexity": {"lt": 0.40}}),
    ("fallback", {"always": True}),
)
CONFIDENCE_FLOOR = 0.6
RESCUE = {"question_type": {"in": ["definition", "factual"]}, "quantitativity": {"lt": 0.45}, "complexity": {"lt": 0.60}}
#: rule, size of model, evidence mode, chunks per document, tokens per document, tokens in all, least documents, draft, output tokens.
CONFIG = (
    ("tier-1-def", "small", "abstracts", 0, 0, 0, 3, True, 2000),
    ("tier-1-def-parse-rescue", "small", "abstracts", 0, 0, 0, 3, True, 2000),
    ("tier-2b", "medium", "excerpts_narrow", 6, 6000, 30000, 6, False, 4000),
    ("tier-3", "large", "excerpts_full", 6, 6000, 35000, 7, False, 4000),
    ("safety-tier3", "large", "excerpts_full", 6, 6000, 35000, 7, False, 4000),
    ("tier-2a", "medium", "excerpts_narrow", 5, 4500, 25000, 6, False, 4000),
    ("tier-m", "medium", "excerpts_narrow", 6, 6000, 30000, 6, False, 4000),
    ("tier-1", "small", "abstracts", 0, 0, 0, 6, True, 2000),
    ("fallback", "small", "abstracts", 0, 0, 0, 6, True, 2000),
)
CONFIG_SCHEMA = (
    "rule_hit string, model_name string, evidence_mode string, top_k_per_doc int, per_doc_budget int, global_budget int, "
    "doc_filter_min_keep int, use_draft boolean, max_output_tokens int"
)
