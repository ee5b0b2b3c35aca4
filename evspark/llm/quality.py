"""Quality rules with robust multivariate outliers, by DataFrame functions only.

Base rules look at single statistics. Beyond them each language and source gets a minimum covariance
determinant estimate of the transformed statistics. Concentration steps start from three estimates (median and
deviations, correlations of hyperbolic tangents, spatial signs); each step takes mean and covariance of the
``share`` of rows that lie nearest, until no determinant falls any more, and the start of least determinant
wins. A group's estimate is drawn towards its language's as if that had ``prior_rows`` rows in it. Rows
beyond ``cutoff`` in squared Mahalanobis distance are rejected; 50 is the chi-square quantile of five degrees
at a tail of 1.4e-9.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evspark.llm.common import checkpoint

#: Fixed character classes of the base statistics.
BLANKS, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
#: (name, least variance) of the transformed statistics. The first two vary in every group; most clean texts have no symbols,
#: repeated lines or repeated words, so that for the last three the floor is the scale on which a departure counts.
FEATURES = (("x0", 0.05), ("x1", 0.02), ("x2", 0.1), ("x3", 0.15), ("x4", 0.15))
P = len(FEATURES)
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
GROUP = ["level", "g0", "g1"]
#: 0.75 over the chance that a chi-square of p + 2 degrees is under the 0.75 quantile of p degrees (p = 5).
CONSISTENCY = 1.412
BINS = 16


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[ \t-\r]+"), "")


def _let(value: Column, body) -> Column:
    """body(value) with the value worked out once."""
    return F.transform(F.array(value), body)[0]


def _repeated(words: Column) -> Column:
    """Words inside a run of three that is found again in the same text."""

    def places(hashes):
        grams = F.transform(
            F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - 2, F.lit(0))),
            lambda h, i: F.struct(F.xxhash64(h, F.get(hashes, i + 1), F.get(hashes, i + 2)).alias("h"), i.alias("i")),
        )
        return _let(F.sort_array(grams), doubled)

    def doubled(grams):
        n = F.size(grams)
        marked = F.transform(
            grams,
            lambda g, k: F.when(
                ((k > 0) & (F.get(grams, k - 1)["h"] == g["h"])) | ((k < n - 1) & (F.get(grams, k + 1)["h"] == g["h"])), g["i"]
            ),
        )
        return _let(F.sort_array(F.filter(marked, lambda i: i.isNotNull())), covered)

    def covered(at):
        steps = F.transform(at, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - i, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    return _let(F.transform(words, lambda w: F.xxhash64(w)), places)


def statistics(docs: DataFrame, id_col: str, text_col: str, group_cols: tuple[str, ...]) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    groups = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"g{i}") for i, c in enumerate(group_cols)]
    base = docs.select(F.col(id_col).alias("key"), *groups, text.alias("text"))
    lines = F.filter(F.split("text", "\n", -1), lambda s: s.rlike("[^ \t-\r]"))
    return base.select(
        "key",
        *[f"g{i}" for i in range(len(group_cols))],
        _let(words_of(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeated(w).alias("n_repeat_words"))).alias("w"),
        F.length(F.translate("text", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    ).select(
        "key",
        *[f"g{i}" for i in range(len(group_cols))],
        F.col("w.n_words").alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.col("w.n_repeat_words").alias("n_repeat_words"),
    )


def _features() -> list[Column]:
    """Logarithm of the words, mean word length, and logarithms of the shares of symbols, repeated lines and words."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return [
        F.log(n.cast("double")).alias("x0"),
        F.least(F.col("word_chars") / n, F.lit(40.0)).alias("x1"),
        F.log1p(200.0 * F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))).alias("x2"),
        F.log1p(10.0 * F.col("n_dup_lines") / F.sqrt(n.cast("double"))).alias("x3"),
        F.log1p(10.0 * F.col("n_repeat_words") / n).alias("x4"),
    ]


def _joined(rows: DataFrame, groups: DataFrame, keys: list[str], small: bool, salts: int = 64) -> DataFrame:
    """rows with their group's figures, where a group may hold most of the rows.

    ``groups`` is broadcast where it is known to be small; beyond that every group's row is repeated for
    each of ``salts`` shares of its rows.
    """
    if small:
        return rows.join(F.broadcast(groups), keys)
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int")).join(salted, [*keys, "salt"]).drop("salt")


def _factored(est: DataFrame) -> DataFrame:
    """Adds the Cholesky factor l.. of the covariance c.. and the logarithm of its determinant."""
    for i, j in PAIRS:
        s = F.col(f"c{i}{j}")
        for k in range(j):
            s = s - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        est = est.withColumn(f"l{i}{j}", F.sqrt(F.greatest(s, F.lit(1e-12))) if i == j else s / F.col(f"l{j}{j}"))
    return est.withColumn("log_det", 2.0 * sum((F.log(F.col(f"l{i}{i}")) for i in range(1, P)), F.log("l00")))


def _with_distance(rows: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance of x.. from m.. by the factor l.. ."""
    for i in range(P):
        y = F.col(f"x{i}") - F.col(f"m{i}")
        for j in range(i):
            y = y - F.col(f"l{i}{j}") * F.col(f"y{j}")
        rows = rows.withColumn(f"y{i}", y / F.col(f"l{i}{i}"))
    d2 = sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(1, P)), F.col("y0") * F.col("y0"))
    return rows.withColumn("d2", d2).drop(*[f"y{i}" for i in range(P)])


def _central(rows: DataFrame, values: list[Column], names: list[str], small: bool) -> DataFrame:
    """Median of each value by group, to a 64th, from counts of bins."""
    each = rows.select(*GROUP, F.posexplode(F.array(*[F.floor(v * 64).cast("long") for v in values])).alias("f", "bin"))
    counts = each.groupBy(*GROUP, "f", "bin").agg(F.count(F.lit(1)).alias("n"))
    of = W.partitionBy(*GROUP, "f")
    below = counts.withColumn("up", F.sum("n").over(of.orderBy("bin"))).withColumn("all", F.sum("n").over(of))
    half = below.where(2 * F.col("up") >= F.col("all"))
    return half.groupBy(*GROUP).agg(*[(F.min(F.when(F.col("f") == i, F.col("bin"))) / 64.0 + 1 / 128).alias(name) for i, name in enumerate(names)])


def _starts(rows: DataFrame, small: bool) -> DataFrame:
    """Three first estimates (start, m.., c..) for each group."""
    x, m = [F.col(f"x{i}") for i in range(P)], [f"m{i}" for i in range(P)]
    mid = _central(rows, x, m, small)
    off = _joined(rows, mid, GROUP, small)
    spread = _central(off, [F.abs(v - F.col(c)) for v, c in zip(x, m, strict=True)], [f"s{i}" for i in range(P)], small)
    centre = mid.join(spread, GROUP)
    centre = centre.select(*GROUP, *m, *[F.sqrt(F.pow(1.4826 * F.col(f"s{i}"), 2) + least).alias(f"s{i}") for i, (_, least) in enumerate(FEATURES)])
    centre = checkpoint(centre)
    z = _joined(rows, centre, GROUP, small).select(*GROUP, *[((F.col(f"x{i}") - F.col(f"m{i}")) / F.col(f"s{i}")).alias(f"z{i}") for i in range(P)])
    norm = F.greatest(F.sqrt(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, P)), F.col("z0") * F.col("z0"))), F.lit(1e-9))
    shapes = {
        "t": lambda i, j: F.covar_pop(F.tanh(f"z{i}"), F.tanh(f"z{j}")),
        "u": lambda i, j: F.avg(F.col(f"z{i}") * F.col(f"z{j}") / (norm * norm)),
    }
    shaped = z.groupBy(*GROUP).agg(*[f(i, j).alias(f"{k}{i}{j}") for k, f in shapes.items() for i, j in PAIRS])
    all_ = centre.join(shaped, GROUP)

    def start(number: int, entry) -> Column:
        c = [(entry(i, j) * F.col(f"s{i}") * F.col(f"s{j}")).alias(f"c{i}{j}") for i, j in PAIRS]
        return F.struct(F.lit(number).alias("start"), *m, *c)

    each = F.array(
        start(0, lambda i, j: F.lit(float(i == j))),
        start(1, lambda i, j: F.col(f"t{i}{j}") + 0.05 * (i == j)),
        start(2, lambda i, j: F.col(f"u{i}{j}") + 0.02 * (i == j)),
    )
    return all_.select(*GROUP, F.explode(each).alias("e")).select(*GROUP, "e.*")


def _concentrated(rows: DataFrame, est: DataFrame, share: float, small: bool) -> DataFrame:
    """The next estimates: of the rows under the group's quantile of distance, from sums over fine bins of distance."""
    near = _with_distance(_joined(rows, est, GROUP, small)).withColumn("bin", F.floor(F.log2(F.col("d2") + 1e-3) * BINS).cast("int"))
    by = [*GROUP, "start"]
    sums = [*[F.sum(f"x{i}").alias(f"m{i}") for i in range(P)], *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"c{i}{j}") for i, j in PAIRS]]
    bins = near.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.max("log_det").alias("before"), *sums)
    of = W.partitionBy(*by)
    below = bins.withColumn("under", F.sum("n").over(of.orderBy("bin")) - F.col("n")).withColumn("all", F.sum("n").over(of))
    kept = below.where(F.col("under") < share * F.col("all"))
    names = ["n", *[f"m{i}" for i in range(P)], *[f"c{i}{j}" for i, j in PAIRS]]
    total = kept.groupBy(*by).agg(*[F.sum(c).alias(c) for c in names], F.max("all").alias("all"), F.max("before").alias("before"))
    mean = [F.col(f"m{i}") / F.col("n") for i in range(P)]
    floor = {i: least for i, (_, least) in enumerate(FEATURES)}
    cov = [(CONSISTENCY * (F.col(f"c{i}{j}") / F.col("n") - mean[i] * mean[j]) + (floor[i] if i == j else 0.0)).alias(f"c{i}{j}") for i, j in PAIRS]
    return total.select(*by, "all", "before", *[mean[i].alias(f"m{i}") for i in range(P)], *cov)


def _kept(est: DataFrame, small: bool) -> DataFrame:
    """The estimates with their factors, written; in one file where they are few."""
    return checkpoint(_factored(est).coalesce(1) if small else _factored(est))


def estimates(rows: DataFrame, small: bool, *, share: float = 0.75, steps: int = 20, settled: float = 1e-2, prior_rows: float = 200.0) -> DataFrame:
    """(g0, g1, m.., c..): the estimate of each group of rows (key, g0, g1, x0..x4), drawn towards its language's.

    Steps end when the determinants' logarithms fall by less than ``settled`` in every group, or after ``steps``.
    ``small`` says that the groups are few enough to be broadcast.
    """
    levels = F.array(F.struct(F.lit(0).alias("level"), "g0", F.lit("").alias("g1")), F.struct(F.lit(1).alias("level"), "g0", "g1"))
    leveled = rows.select("key", F.explode(levels).alias("g"), *[n for n, _ in FEATURES]).select("key", "g.*", *[n for n, _ in FEATURES])
    est = _kept(_starts(leveled, small).withColumns({"all": F.lit(0).cast("long"), "before": F.lit(0.0)}), small)
    for step in range(steps):
        est = _kept(_concentrated(leveled, est, share, small), small)
        fell = est.agg(F.max(F.col("before") - F.col("log_det"))).first()[0]
        if fell is None or (fell < settled and step):
            break
    figures = [*[f"m{i}" for i in range(P)], *[f"c{i}{j}" for i, j in PAIRS]]
    best = est.groupBy(*GROUP).agg(F.min_by(F.struct("all", *figures), F.struct("log_det", "start")).alias("e"))
    own = best.where("level = 1").select("g0", "g1", "e")
    whole = best.where("level = 0").select("g0", F.col("e").alias("w"))
    weight = F.col("e.all") / (F.col("e.all") + prior_rows)
    return own.join(whole, "g0").select("g0", "g1", *[(weight * F.col(f"e.{c}") + (1 - weight) * F.col(f"w.{c}")).alias(c) for c in figures])


def outlier_distance(stats: DataFrame, *, max_broadcast_groups: int = 20_000, **options) -> DataFrame:
    """Adds d2, the squared robust distance of each row within its group.

    ``stats`` has key, g0, g1 and the base statistics. Medians and quantiles come from counts of fine bins and
    covariances from sums over bins, so no group is gathered anywhere; groups' figures are broadcast up to
    ``max_broadcast_groups`` groups and joined in salted shares beyond.
    """
    rows = stats.select(*stats.columns, *_features())
    small = rows.select("g0", "g1").distinct().count() <= max_broadcast_groups
    est = _kept(estimates(rows, small, **options), small).drop("log_det")
    return _with_distance(_joined(rows, est, ["g0", "g1"], small))


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    group_cols: tuple[str, str] = ("lang", "source"),
    *,
    min_words: int = 50,
    max_repeat_percent: int = 50,
    cutoff: float = 50.0,
    **options,
) -> DataFrame:
    """Per document the base statistics, base_failed, d2 (null if base_failed) and kept.

    Null and empty texts have no words and fail the base rules; whole texts are measured; a null
    language or source is a group of its own; repeated rows and null ids are judged row by row; an empty
    table gives no rows; other columns are ignored. Only rows that pass the base rules shape the
    estimates; ``options`` are those of ``estimates``.
    """
    stats = checkpoint(statistics(docs, id_col, text_col, group_cols))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    cols = ["key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    judged = outlier_distance(stats.where(~failed), **options)
    good = judged.select(*cols, F.lit(False).alias("base_failed"), "d2", (F.col("d2") <= cutoff).alias("kept"))
    bad = stats.where(failed).select(*cols, F.lit(True).alias("base_failed"), F.lit(None).cast("double").alias("d2"), F.lit(False).alias("kept"))
    return good.unionByName(bad).withColumnRenamed("key", id_col)
