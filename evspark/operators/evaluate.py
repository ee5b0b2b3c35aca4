"""Scores of answers: loading, summaries, paired tests, anomalies and run statistics.

Rows with a null measure are left out where all measures are needed, and out of the mean elsewhere; a null message or
status counts as empty or zero; repeated rows count one by one; an empty table gives no rows. Added
columns replace those of the same name; names that begin with two underscores are reserved.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evspark.operators.running import sums_before

#: The eight criteria, and tokens of error messages in the order in which they are tried.
CRITERIA = (
    "scientific_accuracy", "relevance", "completeness", "directness", "quantitative_precision", "response_structure", "scope_awareness", "helpfulness",
)
MEASURES = (*CRITERIA, "overall")
CODE_TOKENS = (
    "nonetype", "subscriptable", "object has no attribute", "attributeerror", "typeerror", "invalid api key", "authentication", "credits", "context length exceeded",
)
TRANSIENT_TOKENS = (
    "429", "rate limit", "too many requests", "timeout", "connection", "service unavailable", "disconnected", "server disconnected",
    "remote protocol", "read error", "broken pipe", "reset by peer", "eof", "incomplete read", "bad gateway", "gateway timeout",
    "overloaded", "capacity", "server error", "internal error", "empty stream", "no available model", "provider returned error",
    "upstream error", "model is currently",
)
END_OF_RUN_TOKENS = (
    "server disconnected", "refinement produced empty", "connection", "timeout", "timed out", "rate limit", "429", "503", "502", "504", "read timeout", "broken pipe",
)


def load_scores(scores: DataFrame) -> DataFrame:
    """Rows with all criteria, and their mean as overall, rounded half to even at 2 places."""
    whole = scores.dropna(subset=list(CRITERIA))
    mean = sum(F.col(c) for c in CRITERIA) / F.lit(8.0)
    return whole.withColumn("overall", F.rint(mean * 100) / 100)


def null_scores(scores: DataFrame) -> DataFrame:
    """(pipeline, n): rows that lack a criterion."""
    lacking = F.lit(False)
    for c in CRITERIA:
        lacking = lacking | F.col(c).isNull()
    return scores.where(lacking).groupBy("pipeline").agg(F.count(F.lit(1)).alias("n"))


def summary(loaded: DataFrame) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("n")]
    for m in MEASURES:
        aggs += [F.round(F.avg(m), 2).alias(f"{m}_mean"), F.round(F.stddev_samp(m), 2).alias(f"{m}_std")]
    return loaded.groupBy("pipeline").agg(*aggs)


def signed_rank_p(w: float, n: int, ties: list[int]) -> float:
    """Two-sided p of the signed-rank statistic: exact for up to 50 untied differences, else normal."""
    if n == 0:
        return 1.0
    if n <= 50 and not ties:
        ways = [1] + [0] * (n * (n + 1) // 2)
        for k in range(1, n + 1):
            for s in range(len(ways) - 1, k - 1, -1):
                ways[s] += ways[s - k]
        return min(1.0, 2 * sum(ways[: int(w) + 1]) / 2**n)
    var = n * (n + 1) * (2 * n + 1) / 24 - sum(t**3 - t for t in ties) / 48
    return math.erfc(abs(w - n * (n + 1) / 4) / math.sqrt(2 * var)) if var > 0 else 1.0


def _p_values(*cols: str) -> Column:
    """signed_rank_p for the few rows of a finished test."""

    @F.pandas_udf("double")
    def each(w: pd.Series, n: pd.Series, ties: pd.Series) -> pd.Series:
        return pd.Series([signed_rank_p(a, int(b), [int(t) for t in c]) for a, b, c in zip(w, n, ties, strict=True)], dtype=float)

    return each(*cols)


def signed_ranks(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Signed-rank test of x against y within each group: n (zeros included), W, effect, means, diff, p, stars.

    Ranks of equal absolute differences are averaged from their counts, so no group is sorted in one task.
    """
    d = F.round(F.col("y") - F.col("x"), 6)
    means = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean_a"), F.avg("y").alias("mean_b"))
    tied = pairs.withColumn("a", F.abs(d)).where(F.col("a") > 0).groupBy(*by, "a").agg(F.count(F.lit(1)).alias("t"), F.count_if(F.col("y") > F.col("x")).alias("up"))
    below = F.coalesce(F.sum("t").over(W.partitionBy(*by).orderBy("a").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = tied.withColumn("rank", below + (F.col("t") + 1) / 2)
    sums = ranked.groupBy(*by).agg(
        F.sum(F.col("rank") * F.col("up")).alias("plus"),
        F.sum(F.col("rank") * (F.col("t") - F.col("up"))).alias("minus"),
        F.sum("t").alias("n_nonzero"),
        F.collect_list(F.when(F.col("t") > 1, F.col("t"))).alias("ties"),
    )
    got = means.join(sums, by, "left")
    w = F.coalesce(F.least("plus", "minus"), F.lit(0.0))
    n = F.col("n")
    got = got.select(*by, "n", w.alias("w"), F.round(1 - 2 * w / (n * (n + 1) / 2), 3).alias("effect_r"), F.round("mean_a", 4).alias("mean_a"), F.round("mean_b", 4).alias("mean_b"), F.round(F.round("mean_b", 4) - F.round("mean_a", 4), 4).alias("diff"), F.coalesce("n_nonzero", F.lit(0)).alias("n_nonzero"), F.coalesce("ties", F.array().cast("array<bigint>")).alias("ties"))
    got = got.withColumn("p_value", _p_values("w", "n_nonzero", "ties")).drop("ties")
    return got.withColumn("sig", F.when(F.col("p_value") < 0.001, "***").when(F.col("p_value") < 0.01, "**").when(F.col("p_value") < 0.05, "*").otherwise("ns"))


def wilcoxon_pairs(loaded: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Signed-rank tests on overall for the listed pairs of pipelines, paired by question."""
    wanted = loaded.sparkSession.createDataFrame(pairs, "pipeline_a string, pipeline_b string")
    a = loaded.select("question_id", F.col("pipeline").alias("pipeline_a"), F.col("overall").alias("x")).join(F.broadcast(wanted), "pipeline_a")
    b = loaded.select("question_id", F.col("pipeline").alias("pipeline_b"), F.col("overall").alias("y"))
    return signed_ranks(a.join(b, ["question_id", "pipeline_b"]), ["pipeline_a", "pipeline_b"])


def wilcoxon_by_criterion(loaded: DataFrame, baseline: str) -> DataFrame:
    """Each other pipeline against the baseline for every measure; blank where the counts differ."""
    long = loaded.select("question_id", "pipeline", *[F.col(m).cast("double").alias(m) for m in MEASURES]).unpivot(["question_id", "pipeline"], list(MEASURES), "criterion", "v")
    base = long.where(F.col("pipeline") == baseline).select("question_id", "criterion", F.col("v").alias("x"))
    rest = long.where(F.col("pipeline") != baseline).withColumnRenamed("v", "y")
    tested = signed_ranks(rest.join(base, ["question_id", "criterion"]), ["pipeline", "criterion"])
    sizes = long.groupBy("pipeline", "criterion").agg(F.count("v").alias("m"))
    own = sizes.where(F.col("pipeline") == baseline).select("criterion", F.col("m").alias("base_m"))
    got = sizes.where(F.col("pipeline") != baseline).join(own, "criterion").join(tested, ["pipeline", "criterion"], "left")
    same = F.col("m") == F.col("base_m")
    cells = [F.when(same, F.col(c)).alias(c) for c in ("n", "w", "effect_r", "mean_a", "mean_b", "diff", "n_nonzero", "p_value")]
    return got.select("pipeline", "criterion", *cells, F.when(same, F.col("sig")).otherwise("ns").alias("sig"))


def validate_summary(computed: DataFrame, expected: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """(pipeline, computed, expected, delta, status) for overall means from both sides."""
    both = computed.select("pipeline", F.col("overall_mean").alias("computed")).join(expected.select("pipeline", F.col("overall_mean").alias("expected")), "pipeline", "full")
    delta = F.round(F.col("computed") - F.col("expected"), 4)
    status = F.when(F.col("computed").isNull(), "missing").when(F.col("expected").isNull(), "new").when(F.abs(delta) > tolerance, "differs").otherwise("ok")
    return both.select("pipeline", "computed", "expected", delta.alias("delta"), status.alias("status"))


def score_distribution(loaded: DataFrame) -> DataFrame:
    """Quartiles of overall for each pipeline (exact, by counting equal scores) and the mean of each measure."""
    q = [F.percentile("overall", p).alias(name) for name, p in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75))]
    means = [F.round(F.avg(m), 4).alias(f"{m}_mean") for m in MEASURES]
    return loaded.groupBy("pipeline").agg(F.min("overall").alias("least"), *q, F.max("overall").alias("most"), *means)


def worst_cases(loaded: DataFrame, k: int = 10) -> DataFrame:
    """The k lowest of each pipeline with what was wrong; ties go to the smaller question."""
    rank = F.row_number().over(W.partitionBy("pipeline").orderBy("overall", "question_id"))
    issue = F.concat_ws("; ", *[F.when(F.col(c) <= 4, F.lit(t)) for c, t in (("quantitative_precision", "Low quantitative precision"), ("directness", "Low directness"), ("scope_awareness", "Low scope awareness"))])
    got = loaded.withColumn("rank", rank).where(F.col("rank") <= k)
    return got.select("pipeline", "question_id", "overall", "rank", F.coalesce(F.nullif(issue, F.lit("")), F.lit("Marginal across metrics")).alias("issue"))


def score_anomalies(scores: DataFrame, columns: list[str]) -> DataFrame:
    """Adds valid and severity from five scores of 1 to 5; the first rule that fires decides."""
    good = F.filter(F.array(*[F.col(c) for c in columns]), lambda s: s.between(1, 5))
    n = F.size("__s")
    mean = F.aggregate("__s", F.lit(0.0), lambda a, x: a + x) / n
    var = F.aggregate("__s", F.lit(0.0), lambda a, x: a + (x - F.col("__m")) * (x - F.col("__m"))) / 4
    got = scores.withColumn("__s", good).withColumn("__m", F.when(n == 5, mean)).withColumn("std", F.when(n == 5, F.sqrt(var)))
    fives = F.forall("__s", lambda s: s == 5)
    severity = F.when(n != 5, "high").when(F.col("std") > 1.5, "medium").when((F.col("std") < 0.5) & fives, "info").when(F.col("std") < 0.5, "low")
    severity = severity.when(F.abs(F.col("__m") - 3) > 1.5, "medium").otherwise("none")
    got = got.withColumn("severity", severity).withColumn("valid", F.col("severity").isin("info", "none"))
    return got.withColumn("std", F.round("std", 4)).drop("__s", "__m")


def judge_overall(scores: DataFrame, columns: list[str]) -> DataFrame:
    """Adds overall_score: the mean of the given scores, the mark of failure -1 included; 1.0 if there are none."""
    given = F.filter(F.array(*[F.col(c) for c in columns]), lambda s: s.isNotNull())
    total = F.aggregate(given, F.lit(0.0), lambda a, x: a + x)
    return scores.withColumn("overall_score", F.when(F.size(given) == 0, 1.0).otherwise(F.round(total / F.size(given), 4)))


def metric_quality(scores: DataFrame, metrics: list[str], *, fallbacks: bool = True) -> DataFrame:
    """Adds filled values, and quality: the mean of the metrics of 0 or more, else -1.

    A failed metric (negative) takes the mean of the earlier valid ones of its pipeline (over 0, at most
    1, not 0.5), or 0.5 where there are none; without fallbacks -1. Null metrics stay null and out of the mean.
    """
    valid = {m: (F.col(m) > 0) & (F.col(m) <= 1) & (F.col(m) != 0.5) for m in metrics}
    sums = {f"__{m}_sum": F.when(v, F.col(m)) for m, v in valid.items()} | {f"__{m}_n": F.when(v, F.lit(1)) for m, v in valid.items()}
    got = sums_before(scores, ["pipeline"], ["ord"], sums) if fallbacks else scores
    for m in metrics:
        earlier = F.when(F.col(f"__{m}_n") > 0, F.col(f"__{m}_sum") / F.col(f"__{m}_n")).otherwise(0.5) if fallbacks else F.lit(-1.0)
        got = got.withColumn(f"{m}_filled", F.when(F.col(m) < 0, earlier).otherwise(F.col(m)))
    given = F.filter(F.array(*[F.col(f"{m}_filled") for m in metrics]), lambda v: v >= 0)
    mean = F.aggregate(given, F.lit(0.0), lambda a, x: a + x) / F.size(given)
    return got.withColumn("quality", F.when(F.size(given) == 0, -1.0).otherwise(mean)).drop(*sums)


def metric_switched_off(log: DataFrame, limit: int = 3) -> DataFrame:
    """Adds off: whether the metric was switched off before this row by ``limit`` earlier failures; null is no failure."""
    got = sums_before(log, ["pipeline"], ["ord"], {"__failures": F.col("failed").cast("int")})
    return got.withColumn("off", F.col("__failures") >= limit).drop("__failures")


def run_stats(runs: DataFrame) -> DataFrame:
    """(total, ok, failed, mean_seconds of the successful) for each pipeline."""
    ok = F.col("status") == "ok"
    return runs.groupBy("pipeline").agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"), F.round(F.avg(F.when(ok, F.col("seconds"))), 4).alias("mean_seconds"))


def health_flags(answers: DataFrame) -> DataFrame:
    """Adds flags of context and answer size; a context over 307,200 characters is an error."""
    n, a = F.length(F.coalesce("context", F.lit(""))), F.coalesce("text", F.lit(""))
    flags = {
        "empty_context": n == 0, "thin_context": (n > 0) & (n < 500), "huge_context": n / 4 > 70_000, "over_cap": n > 307_200,
        "short_answer": F.length(a) < 100, "uncited": ~a.rlike(r"\[[0-9]+\]"),
    }
    return answers.withColumns(flags)


def classify_errors(log: DataFrame) -> DataFrame:
    """Adds kind (code, transient, other) and retry_later to rows of message and status."""
    low = F.lower(F.coalesce("message", F.lit("")))
    has = lambda tokens: F.greatest(*[low.contains(t) for t in tokens])
    status = F.coalesce("status", F.lit(0))
    kind = F.when(has(CODE_TOKENS), "code").when((status == 429) | status.between(500, 599) | has(TRANSIENT_TOKENS), "transient").otherwise("other")
    return log.withColumn("kind", kind).withColumn("retry_later", has(END_OF_RUN_TOKENS))
