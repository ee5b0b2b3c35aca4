"""Routing of profiled questions to evidence tiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evspark.plans import rules

PROFILE = ("question_type", "complexity", "quantitativity", "spatial_specificity", "temporal_specificity", "methodological_depth", "confidence")


def condition(tree: dict) -> Column:
    """A rule's condition as a column that is never null; a null field makes its test false."""
    parts = []
    for field, test in tree.items():
        if field == "always":
            parts.append(F.lit(bool(test)))
        elif field in ("any", "all"):
            inner = [condition(t) for t in (test if isinstance(test, list) else [{k: v} for k, v in test.items()])]
            parts.append(reduce((lambda a, b: a | b) if field == "any" else (lambda a, b: a & b), inner))
        else:
            c = F.col(field)
            for op, value in test.items():
                one = {"lt": c < value if op == "lt" else None, "le": c <= value if op == "le" else None, "gt": c > value if op == "gt" else None}.get(op)
                if op == "ge":
                    one = c >= value
                elif op == "in":
                    one = c.isin(value)
                parts.append(F.coalesce(one, F.lit(False)))
    return reduce(lambda a, b: a & b, parts)


def rule_hit(table=rules.RULES) -> Column:
    unsure = F.col("confidence").isNull() | (F.col("confidence") < rules.CONFIDENCE_FLOOR)
    hit = F.when(unsure & condition(rules.RESCUE), "tier-1-def-parse-rescue").when(unsure, "safety-tier3")
    for name, tree in table:
        hit = hit.when(condition(tree), name)
    return hit


def config(spark) -> DataFrame:
    return spark.createDataFrame(list(rules.CONFIG), rules.CONFIG_SCHEMA)


def route(profiles: DataFrame, table=rules.RULES) -> DataFrame:
    """Adds rule_hit and the settings of the rule; the settings are a fixed handful of rows, so broadcast."""
    hit = profiles.withColumn("rule_hit", rule_hit(table))
    return hit.join(F.broadcast(config(profiles.sparkSession)), "rule_hit", "left")


def route_histogram(routed: DataFrame) -> DataFrame:
    """Counts by rule, evidence mode and size of model in one pass; the key's kind is in ``dimension``."""
    sets = routed.groupingSets([["rule_hit"], ["evidence_mode"], ["model_name"]], "rule_hit", "evidence_mode", "model_name")
    out = sets.agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"))
    dimension = F.when(F.col("g") == 3, "rule_hit").when(F.col("g") == 5, "evidence_mode").otherwise("model_name")
    return out.select(dimension.alias("dimension"), F.coalesce("rule_hit", "evidence_mode", "model_name").alias("value"), "n")


def route_health(routed: DataFrame) -> DataFrame:
    """Whether routing is degenerate: rules that fire, share of fallback, rules that mean something."""
    by = routed.groupBy("rule_hit").agg(F.count(F.lit(1)).alias("n"))
    got = by.agg(
        F.count(F.lit(1)).alias("n_rules"),
        F.sum("n").alias("total"),
        F.coalesce(F.sum(F.when(F.col("rule_hit") == "fallback", F.col("n"))), F.lit(0)).alias("n_fallback"),
        F.count_if(~F.col("rule_hit").isin("fallback", "safety-tier3")).alias("n_meaningful"),
    )
    ok = (F.col("n_rules") >= 3) & (F.col("n_fallback") < 0.5 * F.col("total")) & (F.col("n_meaningful") >= 2)
    return got.withColumn("healthy", ok)


def scaled_targets(targets: dict[str, int], n: int | None) -> dict[str, int]:
    """Targets for ``n`` questions in all, rounded half to even; the rest goes to tier-m."""
    total = sum(targets.values())
    if n is None or not total:
        return dict(targets)
    out = {k: round(v * n / total) for k, v in targets.items()}
    out["tier-m"] = max(0, out.get("tier-m", 0) + n - sum(out.values()))
    return out


def tier_sample(routed: DataFrame, targets: dict[str, int], n: int | None = None) -> DataFrame:
    """The first questions of each tier, in row order, as many as its target."""
    scaled = scaled_targets(targets, n)
    want = routed.sparkSession.createDataFrame(list(scaled.items()), "rule_hit string, target int")
    rank = F.row_number().over(W.partitionBy("rule_hit").orderBy("ord", "question_id"))
    most = routed.withColumn("rank", rank).where(F.col("rank") <= max(scaled.values(), default=0))  # a limit by group before the sort
    return most.join(F.broadcast(want), "rule_hit").where(F.col("rank") <= F.col("target")).drop("target")


def probe_sample(questions: DataFrame, *, many: int = 6, few: int = 3) -> DataFrame:
    """The first two questions by ord with ``many`` candidates or more and the first with 1 to ``few``; else the first three.

    ``questions`` has n_candidates; a null counts as none.
    """
    n = F.coalesce("n_candidates", F.lit(0))
    kind = F.when(n >= many, "many").when(n.between(1, few), "few").otherwise("other")
    rank = F.row_number().over(W.partitionBy("probe").orderBy("ord", "question_id"))
    ranked = questions.withColumn("probe", kind).withColumn("rank", rank).where(F.col("rank") <= 3)
    chosen = ((F.col("probe") == "many") & (F.col("rank") <= 2)) | ((F.col("probe") == "few") & (F.col("rank") == 1))
    kept = ranked.withColumn("__some", F.max(chosen).over(W.partitionBy(F.lit(1))))  # at most nine rows
    return kept.where(F.when(F.col("__some"), chosen).otherwise(F.lit(True))).drop("__some")


def route_flags(routed: DataFrame) -> DataFrame:
    """Safety route, borderline confidence, and the bucket of work a tier belongs to."""
    bucket = F.when(F.col("rule_hit").isin("tier-1-def", "tier-1", "fallback", "tier-1-def-parse-rescue"), "small")
    bucket = bucket.when(F.col("rule_hit").isin("tier-3", "safety-tier3"), "large").otherwise("medium")
    return routed.withColumns(
        {
            "is_safety": F.col("rule_hit") == "safety-tier3",
            "is_borderline": F.coalesce(F.col("confidence").between(0.6, 0.7) & (F.col("confidence") < 0.7), F.lit(False)),
            "bucket": bucket,
        }
    )


#: Our wording of the answer rules, in order.
QUALITY_RULES = (
    "Ground every claim in the given passages.",
    "Give each number with its unit, scope and citation.",
    "Repeat numbers exactly as the sources state them.",
    "Name the place that a spatial claim holds for.",
    "Name the period that a temporal claim holds for.",
    "Name each method and its main limits.",
)


def quality_rules(routed: DataFrame) -> DataFrame:
    """The numbered rules that an answer must keep, and the hints for its query."""
    q = F.coalesce("quantitativity", F.lit(0.0))
    numeric = (q >= 0.5) | F.coalesce("needs_numeric_emphasis", F.lit(False))
    tests = (
        F.col("evidence_mode").isin("excerpts_narrow", "excerpts_full"), numeric, numeric,
        F.coalesce("spatial_specificity", F.lit(0.0)) >= 0.5, F.coalesce("temporal_specificity", F.lit(0.0)) >= 0.5, F.coalesce("methodological_depth", F.lit(0.0)) >= 0.6,
    )
    found = F.filter(F.array(*[F.when(t, F.lit(r)) for t, r in zip(tests, QUALITY_RULES, strict=True)]), lambda x: x.isNotNull())
    numbered = F.array_join(F.transform(found, lambda r, i: F.concat((i + 1).cast("string"), F.lit(". "), r)), "\n")
    hint = F.concat_ws(
        " ", F.col("question"), F.when(numeric, F.lit("[numbers]")), F.when(F.coalesce("methodological_depth", F.lit(0.0)) > 0.6, F.lit("[methods]"))
    )
    return routed.withColumns({"answer_rules": numbered, "n_answer_rules": F.size(found), "query_hint": hint})
