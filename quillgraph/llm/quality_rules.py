"""Quality rules with robust multivariate outliers, in DataFrame functions only.

Base statistics are column expressions over whole texts. Per language and source the
minimum-covariance-determinant estimate is found by concentration steps: from medians and
median deviations on, the `h` share of rows nearest by Mahalanobis distance gives the next
mean and covariance. Distances are kept as counts by distance class, so a step moves a few
hundred numbers per group whatever the group's size. A row beyond chi-square's 0.999 quantile is
rejected. Rows of a group too small for an estimate of its own are judged by their
language's, or by that of all rows.

Defined results: a null text has no words and fails the base rules; null language or source
is a value of its own; a corpus of fewer than `least` usable rows is judged by the
estimate of all its rows; rows that repeat are judged each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import SPACE, materialize

#: Scale below which a statistic's spread never falls, in the order of VECTOR.
FLOOR = (0.25, 0.25, 0.05, 0.10, 0.10)
#: Median of chi-square with five degrees of freedom.
CHI2_MEDIAN = 4.351
#: Its 0.999 quantile, beyond which a row is an outlier.
CHI2_TAIL = 20.515
#: Name of the group of all rows.
ALL = "all"
CLASSES_PER_E = 16


#: Rows of a table of groups up to which it is sent to all tasks (a row has 22 numbers at most).
MOST_GROUPS = 20_000


def _sized(groups: DataFrame) -> DataFrame:
    """A written table of groups, sent to all tasks where its counted rows are few: rows of a hot group then stay where they are."""
    return F.broadcast(groups) if groups.count() <= MOST_GROUPS else groups


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def _repeated_words(words: Column, n: Column) -> Column:
    """Words inside 3-word windows that stand twice or more in the text."""
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))

    def covered(s: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        twice = F.sort_array(F.transform(F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))
        return _let(twice, lambda p: F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3)))), F.lit(0), lambda a, b: a + b))

    return F.when(n < 3, F.lit(0)).otherwise(_let(F.sort_array(windows), covered))


def text_statistics(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text that is not null."""
    trimmed = F.btrim(text, F.lit(SPACE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    dup_lines = _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))

    def of(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            dup_lines.cast("long").alias("n_dup_lines"),
            F.size(F.split(text, "\n")).cast("long").alias("n_lines"),
            _repeated_words(w, F.size(w)).cast("long").alias("n_repeat_words"),
        )

    return _let(words, of)


#: The transformed statistics.
VECTOR = {
    "x0": "ln(n_words)",
    "x1": "word_chars / n_words",
    "x2": "sqrt(n_symbols / word_chars)",
    "x3": "sqrt(n_dup_lines / n_lines)",
    "x4": "sqrt(n_repeat_words / n_words)",
}


def _cholesky_distance(x: list[Column], mean: list[Column], cov) -> Column:
    """Squared Mahalanobis distance by forward substitution through the Cholesky factor's columns l_ij, all in one row."""
    y: list[Column] = []
    for i in range(len(x)):
        rest = x[i] - mean[i]
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * y[j]
        y.append(rest / F.col(f"l{i}{i}"))
    total = F.lit(0.0)
    for v in y:
        total = total + v * v
    return total


def _with_factor(stats: DataFrame) -> DataFrame:
    """Cholesky factor of the covariance with the variance floor added, one column at a time."""
    d = len(FLOOR)
    for j in range(d):
        rest = F.col(f"c{j}{j}") + F.lit(FLOOR[j] ** 2)
        for k in range(j):
            rest = rest - F.col(f"l{j}{k}") ** 2
        stats = stats.withColumn(f"l{j}{j}", F.sqrt(F.greatest(rest, F.lit(FLOOR[j] ** 2 / 4))))
        for i in range(j + 1, d):
            rest = F.col(f"c{j}{i}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            stats = stats.withColumn(f"l{i}{j}", rest / F.col(f"l{j}{j}"))
    return stats


def _moments(rows: DataFrame) -> DataFrame:
    d = range(len(FLOOR))
    means = [F.avg(f"x{i}").alias(f"m{i}") for i in d]
    covs = [F.coalesce(F.covar_pop(f"x{i}", f"x{j}"), F.lit(0.0)).alias(f"c{i}{j}") for i in d for j in d if i <= j]
    return _with_factor(rows.groupBy("grp").agg(*means, *covs))


def _distances(rows: DataFrame, stats: DataFrame, *more: str) -> DataFrame:
    d = range(len(FLOOR))
    keep = [f"m{i}" for i in d] + [f"l{i}{j}" for i in d for j in range(i + 1)]
    d2 = _cholesky_distance([F.col(f"x{i}") for i in d], [F.col(f"m{i}") for i in d], None)
    return rows.join(_sized(stats.select("grp", *keep, *more)), "grp").withColumn("d2", d2).drop(*keep)


def _class_of(d2: Column) -> Column:
    return F.floor(F.ln(d2 + F.lit(1e-6)) * CLASSES_PER_E).cast("int")


def _quantile_class(rows: DataFrame, share: float) -> DataFrame:
    """Per group the distance class below or in which the share of its rows lies."""
    counts = rows.groupBy("grp", _class_of(F.col("d2")).alias("class")).count()
    w = Window.partitionBy("grp")
    counts = counts.withColumn("upto", F.sum("count").over(w.orderBy("class"))).withColumn("all", F.sum("count").over(w))
    return counts.where(F.col("upto") >= F.col("all") * share).groupBy("grp").agg(F.min("class").alias("cut"))


def mcd_estimates(rows: DataFrame, h: float = 0.75, steps: int = 3) -> DataFrame:
    """Of rows (grp, x0..x4), per group: mean, Cholesky factor and scale, a consistency factor that brings the median distance down to chi-square's.

    The factor is never below 1: where most statistics are constant the floor of the spread
    makes distances small, and stretching them would call small deviations outliers.
    Tables of one row per group are written, so that Spark knows when they are small enough to send.
    """
    d = range(len(FLOOR))
    mids = materialize(rows.groupBy("grp").agg(*[F.percentile_approx(f"x{i}", 0.5, 1000).alias(f"m{i}") for i in d]), "mcd-middle")
    mads = rows.join(_sized(mids), "grp").groupBy("grp").agg(*[F.first(f"m{i}").alias(f"m{i}") for i in d], *[F.percentile_approx(F.abs(F.col(f"x{i}") - F.col(f"m{i}")), 0.5, 1000).alias(f"s{i}") for i in d])
    zero = [F.lit(0.0).alias(f"c{i}{j}") for i in d for j in d if i < j]
    stats = _with_factor(mads.select("grp", *[f"m{i}" for i in d], *[((F.lit(1.4826) * F.col(f"s{i}")) ** 2).alias(f"c{i}{i}") for i in d], *zero))
    stats = materialize(stats, "mcd-start")
    for _ in range(steps):
        far = _distances(rows, stats)
        cut = materialize(_quantile_class(far, h), "mcd-cut")
        near = far.join(_sized(cut), "grp").where(_class_of(F.col("d2")) <= F.col("cut"))
        stats = materialize(_moments(near), "mcd-step")
    middle = _quantile_class(_distances(rows, stats), 0.5).select("grp", F.greatest(F.exp((F.col("cut") + 0.5) / CLASSES_PER_E) / CHI2_MEDIAN, F.lit(1.0)).alias("scale"))
    return materialize(stats.join(middle, "grp"), "mcd-estimates")


def _keys_in_use(rows: DataFrame, least: int) -> DataFrame:
    """(own, grp): for every language and source the group it is judged by: its own, its language or all rows, the first that has `least` rows, else all."""
    sizes = rows.groupBy("own", "wide").count()
    wide = sizes.groupBy("wide").agg(F.sum("count").alias("n_wide"))
    grp = F.when(F.col("count") >= least, F.col("own")).when(F.col("n_wide") >= least, F.col("wide")).otherwise(ALL)
    return materialize(sizes.join(wide, "wide").select("own", grp.alias("grp")), "rule-groups")


def quality_rules(docs: DataFrame, cutoff: float = CHI2_TAIL, h: float = 0.75, least: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, d2 (null where the base rules fail)."""
    lang, source = F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source")
    own, wide = F.concat(F.lit("source "), F.to_json(F.struct(lang, source))), F.concat(F.lit("language "), F.to_json(F.struct(lang)))
    stats = docs.select(F.col(id_col).alias("doc_id"), own.alias("own"), wide.alias("wide"), text_statistics(F.coalesce(F.col(text_col), F.lit(""))).alias("s"))
    rows = materialize(stats.select("doc_id", "own", "wide", "s.*"), "rule-statistics")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    usable = rows.where(~F.col("base_failed")).withColumns({k: F.expr(v) for k, v in VECTOR.items()})
    keys = _keys_in_use(usable, least)
    # A pooled group holds all rows of its language, or all, not those of small groups alone.
    pooled = usable.select(F.explode(F.array(F.col("own"), F.col("wide"), F.lit(ALL))).alias("grp"), *VECTOR)
    groups = materialize(keys.select("grp").distinct(), "rule-groups-in-use")
    estimates = mcd_estimates(materialize(pooled.join(_sized(groups), "grp", "left_semi"), "rule-vectors"), h)
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    far = _distances(usable.join(_sized(keys), "own"), estimates, "scale").withColumn("d2", F.col("d2") / F.col("scale"))
    judged = far.select(*base, (F.col("d2") <= cutoff).alias("kept"), F.col("d2"))
    return judged.unionByName(rows.where("base_failed").select(*base, F.lit(False).alias("kept"), F.lit(None).cast("double").alias("d2")))
