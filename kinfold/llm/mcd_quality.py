r"""Quality rules: base thresholds, then robust multivariate outliers.

Statistics of a text come from one pass over its row.  Texts that pass the base
rules are described by a vector of four transformed statistics, each drawn
toward a usual value as if ``PRIOR`` further characters, words or lines of that
kind had been read, so that short texts do not stand out by chance:

    share of symbols; share of upper-case letters; log of the mean word length;
    share of repeated lines

For every language and source, for every language and for all rows together the
minimum-covariance-determinant location and scatter are estimated.  There are
three starts: medians and median absolute deviations; mean and covariance of all
rows; mean and covariance of the rows that lie near the medians in every
coordinate.  From each, concentration steps keep the ``COVERAGE`` of the rows
with the least Mahalanobis distance and estimate again until the determinant no
longer falls; the start that ends with the least determinant counts, and one
step reweights.  ``FLOOR`` is added to each standard deviation, below which
differences do not matter: most sources have no symbols at all.

A group's estimate is drawn toward that of its language, as if it had
``SHRINK`` rows more that are spread as the language's are, and the language's
toward that of all rows; the scatter of all rows toward ``SPREAD``.  So a group
of any size is judged, the smaller the more by what is usual around it, and no
size switches the rule.  A row is rejected where its squared distance exceeds
the chi-square quantile at 1 - ``ALPHA``.

Everything is DataFrame operations.  Values are integers in units of 1 / UNIT
and distances fall in bounded many levels, so sums do not depend on their order
and reruns agree.  A step aggregates sums by group and level; a group's rows
never meet in a task, and its few parameters are joined back by key.

Cases: null texts have no words and fail the base rules, as any text under ten
words does; null language or source is a value of its own; a text's own
repetition counts, other rows do not, so repeated rows fare alike; very long
texts are read whole, as arrays of their words; an empty table gives an empty
one; extra columns are ignored, and ``keep_clean`` returns them as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5

UNIT = 1024
COVERAGE = 0.75
ALPHA = 1e-6
#: Fall of the logarithm of the determinant below which steps end.
LEAST_FALL = 1e-3
#: Rows that the wider group's estimate counts for.
SHRINK = 50
#: (usual value, weight of it, floor of the standard deviation) of each statistic.
PRIOR = {"symbols": (0.0, 50.0, 0.01), "upper": (0.02, 50.0, 0.02), "length": (5.0, 20.0, 0.05), "lines": (0.0, 3.0, 0.12)}
#: Usual standard deviation of each statistic.
SPREAD = {"symbols": 0.01, "upper": 0.02, "length": 0.1, "lines": 0.1}
_X = tuple(f"x_{k}" for k in PRIOR)
P = len(_X)

_BREAK = r"[\x20\x09-\x0D]+"
_LEVEL = 64
#: Levels that a group's rows fall in, about.
_SUMMED = 300
#: Groups up to which their parameters are broadcast; beyond, they are joined by shuffle.
BROADCAST_GROUPS = 200_000


def chi2_cdf(x: float, k: int) -> float:
    """Chi-square distribution for an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(k // 2))


def chi2_quantile(p: float, k: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, k) < p else (lo, mid)
    return lo


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, key (of language and source) and the statistics of every row, with the row itself as ``whole``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lang, source = F.coalesce(F.concat(F.lit("l"), F.col("lang").cast("string")), F.lit("-")), F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("-"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), F.col("doc_id"), F.to_json(F.array(lang, source)).alias("key"), text.alias("text"), F.array_remove(F.split(text, _BREAK), "").alias("w"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.withColumns({"n": F.size("w"), "lines": lines, "symbols": F.regexp_count("text", F.lit("[#*$%&|<>]")), "upper": F.regexp_count("text", F.lit(r"\p{Lu}"))})
    word = [f"w[i + {j}]" for j in range(WINDOW)]
    rows = rows.withColumn("h", F.expr(f"CASE WHEN n >= {WINDOW} THEN transform(sequence(0, n - {WINDOW}), i -> xxhash64({', '.join(word)})) ELSE cast(array() AS array<bigint>) END"))
    # Only texts in which a window comes again have their windows sorted.
    rows = rows.withColumn("again", F.size("h") > F.size(F.array_distinct("h")))
    rows = rows.withColumn("s", F.expr("CASE WHEN again THEN array_sort(transform(h, (x, i) -> struct(x, i))) ELSE cast(array() AS array<struct<x:bigint,i:int>>) END"))
    places = "array_sort(transform(filter(s, (e, k) -> get(s, k - 1).x <=> e.x OR get(s, k + 1).x <=> e.x), e -> e.i))"
    repeat = f"""aggregate({places}, struct(0L AS c, 0 AS e), (a, p) -> struct(a.c + p + {WINDOW} - greatest(p, a.e) AS c, p + {WINDOW} AS e), a -> a.c)"""
    stats = rows.select(
        "whole", "doc_id", "key",
        F.col("n").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.col("symbols").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(repeat).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.col("upper").cast("long").alias("n_upper"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return stats.withColumn("base_failed", failed)


def _drawn(count: str, total: str, kind: str) -> Column:
    usual, weight, _ = PRIOR[kind]
    return (F.col(count) + F.lit(usual * weight)) / (F.col(total) + F.lit(weight))


def vectors(stats: DataFrame) -> DataFrame:
    """Adds the statistics' vector, in whole units."""
    x = {
        "x_symbols": _drawn("n_symbols", "word_chars", "symbols"),
        "x_upper": _drawn("n_upper", "word_chars", "upper"),
        "x_length": F.log(_drawn("word_chars", "n_words", "length")),
        "x_lines": _drawn("n_dup_lines", "n_lines", "lines"),
    }
    return stats.withColumns({k: F.round(v * UNIT).cast("long") for k, v in x.items()})


def _floor(i: int) -> float:
    return list(PRIOR.values())[i][2] * UNIT


def _squared(mu: list[Column], chol: dict[tuple[int, int], Column]) -> Column:
    """Squared Mahalanobis distance by forward substitution with the Cholesky factor."""
    y: list[Column] = []
    for i in range(P):
        rest = F.col(_X[i]) - mu[i]
        for j in range(i):
            rest = rest - chol[i, j] * y[j]
        y.append(rest / chol[i, i])
    total = y[0] * y[0]
    for v in y[1:]:
        total = total + v * v
    return total


def _distance() -> Column:
    return _squared([F.col(f"m{i}") for i in range(P)], {(i, j): F.col(f"c{i}{j}") for i in range(P) for j in range(i + 1)})


_PAIRS = tuple((i, j) for i in range(P) for j in range(i + 1))
_PARAMETERS = [*(f"m{i}" for i in range(P)), *(f"v{i}{j}" for i, j in _PAIRS)]


def _sums() -> list[Column]:
    return [
        F.count("*").alias("n"), *[F.sum(_X[i]).alias(f"s{i}") for i in range(P)],
        *[F.sum(F.col(_X[i]) * F.col(_X[j])).alias(f"q{i}{j}") for i, j in _PAIRS],
    ]


def _moments(sums: DataFrame, scale: float, *keep: str) -> DataFrame:
    """Means and scatter, floors included, from sums."""
    out = sums.select(*keep, "n", *[(F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in range(P)], *[f"q{i}{j}" for i, j in _PAIRS])
    floor = F.lit(0.0)
    return out.select(*keep, "n", *[f"m{i}" for i in range(P)], *[((F.col(f"q{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")) * F.lit(scale) + (F.lit(_floor(i) ** 2) if i == j else floor)).alias(f"v{i}{j}") for i, j in _PAIRS])


def _factor(moments: DataFrame) -> DataFrame:
    """Adds the scatter's Cholesky factor and the logarithm of its determinant."""
    out = moments
    for i, j in _PAIRS:
        value = F.col(f"v{i}{j}")
        for k in range(j):
            value = value - F.col(f"c{i}{k}") * F.col(f"c{j}{k}")
        out = out.withColumn(f"c{i}{j}", F.sqrt(F.greatest(value, F.lit(_floor(i) ** 2 * 1e-3))) if i == j else value / F.col(f"c{j}{j}"))
    return out.withColumn("logdet", 2 * sum((F.log(F.col(f"c{i}{i}")) for i in range(1, P)), F.log(F.col("c00"))))


def _bounded(table: DataFrame, groups: int) -> DataFrame:
    """A written table of a few rows a group, broadcast where the groups are few."""
    return F.broadcast(table) if groups <= BROADCAST_GROUPS else table


def _levels(rows: DataFrame) -> DataFrame:
    """Each row under its own key, its language's and that of all."""
    by_lang = F.to_json(F.array(F.get(F.from_json("key", "array<string>"), F.lit(0))))
    return rows.select(F.explode(F.array("key", by_lang, F.lit("[]"))).alias("key"), *_X)


def _medians(rows: DataFrame, values: list[Column], name: str) -> DataFrame:
    """key and the median of each of the values, which take bounded many whole numbers: equal ones are counted before they meet."""
    each = rows.select("key", F.posexplode(F.array(*values)).alias("i", "v")).groupBy("key", "i", "v").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("key", "i")
    upto = each.select("key", "i", "v", F.sum("n").over(whole.orderBy("v")).alias("upto"), F.sum("n").over(whole).alias("all"))

    def at(i: int, place: Column) -> Column:
        return F.min(F.when((F.col("i") == i) & (F.col("upto") >= place), F.col("v")))

    return upto.groupBy("key").agg(*[((at(i, F.ceil(F.col("all") / 2)) + at(i, F.floor(F.col("all") / 2) + 1)) / 2).alias(f"{name}{i}") for i in range(len(values))])


def estimate(rows: DataFrame, groups: int) -> DataFrame:
    """key, n and parameters by MCD for every key of ``rows`` (key, statistics), of its language and of all."""
    rows = materialize(_levels(rows), "mcd-levels")
    medians = materialize(_medians(rows, [F.col(x) for x in _X], "d"), "mcd-medians", groups)
    # Twice the distance from a median, which may lie between two values, is a whole number.
    apart = [(2 * F.abs(F.col(x) - F.col(f"d{i}"))).cast("long") for i, x in enumerate(_X)]
    away = _medians(rows.join(_bounded(medians, groups), "key"), apart, "a").join(_bounded(medians, groups), "key")
    away = away.select("key", *[f"d{i}" for i in range(P)], *[(F.col(f"a{i}") / 2 * 1.4826 + F.lit(_floor(i))).alias(f"a{i}") for i in range(P)])
    away = materialize(away, "mcd-away", groups)

    central = F.lit(True)
    for i, x in enumerate(_X):
        central = central & (F.abs(F.col(x) - F.col(f"d{i}")) <= 2 * F.col(f"a{i}"))
    placed = rows.join(_bounded(away, groups), "key").select("key", *_X, F.explode(F.when(central, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("start"))
    zero = away.select("key", F.lit(0).alias("start"), F.lit(1).cast("long").alias("n"), *[F.col(f"d{i}").alias(f"m{i}") for i in range(P)], *[(F.col(f"a{i}") ** 2 if i == j else F.lit(0.0)).alias(f"v{i}{j}") for i, j in _PAIRS])
    now = _factor(zero.unionByName(_moments(placed.groupBy("key", "start").agg(*_sums()), 1.0, "key", "start")))
    # A start's own determinant says nothing: the first step always counts.
    now = materialize(now.withColumn("logdet", F.lit(float("inf"))), "mcd-start", 3 * groups)

    half = chi2_quantile(COVERAGE, P)
    scale = COVERAGE / chi2_cdf(half, P + 2)
    level = F.round(F.log2(1 + _distance()) * _LEVEL).cast("int")
    over, whole = Window.partitionBy("key", "start").orderBy("level"), Window.partitionBy("key", "start")
    ended = None
    while now.head(1):
        met = rows.join(_bounded(now, 3 * groups), "key").select("key", "start", level.alias("level"), *_X)
        sums = met.groupBy("key", "start", "level").agg(*_sums())
        names = [c for c in sums.columns if c not in ("key", "start", "level")]
        upto = sums.select("key", "start", "level", *[F.sum(c).over(over).alias(c) for c in names], F.sum("n").over(whole).alias("all"))
        upto = upto.filter(F.col("n") >= F.ceil(F.col("all") * COVERAGE))
        taken = upto.groupBy("key", "start").agg(F.min_by(F.struct(*names), "level").alias("t")).select("key", "start", "t.*")
        was = now.select("key", "start", F.struct("n", *_PARAMETERS, *[f"c{i}{j}" for i, j in _PAIRS], "logdet").alias("was"))
        step = materialize(_factor(_moments(taken, scale, "key", "start")).join(was, ["key", "start"]), "mcd-step", 3 * groups * _SUMMED)
        falls = (F.col("was.logdet") - F.col("logdet") > LEAST_FALL) | F.col("was.logdet").eqNullSafe(F.lit(float("inf")))
        done = materialize(step.filter(~falls).select("key", "start", "was.*"), "mcd-ended", 3 * groups)
        ended = done if ended is None else ended.unionByName(done)
        now = materialize(step.filter(falls).drop("was"), "mcd-now", 3 * groups)
    if ended is None:
        return rows.groupBy("key").agg(*_sums()).transform(lambda s: _moments(s, 1.0, "key"))
    best = ended.groupBy("key").agg(F.min_by(F.struct(*[c for c in ended.columns if c != "key"]), F.struct("logdet", "start")).alias("b")).select("key", "b.*")
    best = materialize(best, "mcd-best", 3 * groups)
    inner = chi2_quantile(0.975, P)
    near = rows.join(_bounded(best, groups), "key").filter(_distance() <= inner).select("key", *_X)
    return materialize(_moments(near.groupBy("key").agg(*_sums()), 0.975 / chi2_cdf(inner, P + 2), "key"), "mcd-final", groups)


def shrunk(estimates: DataFrame, groups: int) -> DataFrame:
    """key (of language and source), location m* and Cholesky factor c*, drawn toward language and all."""

    def named(table: DataFrame, prefix: str, key: str) -> DataFrame:
        return table.select(F.col("key").alias(key), *[F.col(c).alias(prefix + c) for c in ("n", *_PARAMETERS)])

    level = F.size(F.from_json("key", "array<string>"))
    own, lang, every = (estimates.filter(level == k) for k in (2, 1, 0))
    own = named(own, "o_", "key").withColumn("lang_key", F.to_json(F.array(F.get(F.from_json("key", "array<string>"), F.lit(0))))).withColumn("all_key", F.lit("[]"))
    rows = own.join(_bounded(named(lang, "l_", "lang_key"), groups), "lang_key").join(F.broadcast(named(every, "e_", "all_key")), "all_key")
    spread = [v * UNIT for v in SPREAD.values()]

    def drawn(own: Column, n: str, wide: Column) -> Column:
        return (own * F.col(n) + wide * F.lit(SHRINK)) / (F.col(n) + F.lit(SHRINK))

    out = []
    for name in _PARAMETERS:
        usual = F.col(f"e_{name}")
        if name[0] == "v":
            usual = drawn(usual, "e_n", F.lit(spread[int(name[1])] ** 2 if name[1] == name[2] else 0.0))
        out.append(drawn(F.col(f"o_{name}"), "o_n", drawn(F.col(f"l_{name}"), "l_n", usual)).alias(name))
    return _factor(rows.select("key", *out)).select("key", *[f"m{i}" for i in range(P)], *[f"c{i}{j}" for i, j in _PAIRS])


def _parameters(stats: DataFrame) -> tuple[DataFrame, int]:
    """Parameters of every language and source that rows pass the base rules in, and how many those are."""
    fit = stats.filter(~F.col("base_failed")).select("key", *_X)
    groups = 2 * fit.select("key").distinct().count() + 1
    return materialize(shrunk(estimate(fit, groups), groups), "mcd-parameters", groups), groups


def _judged(stats: DataFrame, parameters: DataFrame, groups: int) -> DataFrame:
    scored = stats.join(_bounded(parameters, groups), "key", "left").withColumn("distance2", _distance())
    # Where a group has no parameters none of its rows passes the base rules.
    return scored.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance2") <= chi2_quantile(1 - ALPHA, P), F.lit(False)))


def judge(docs: DataFrame) -> DataFrame:
    """The statistics of every row with base_failed, distance2 and kept."""
    stats = materialize(vectors(statistics(docs)).drop("whole"), "mcd-stats")
    return _judged(stats, *_parameters(stats)).drop(*[f"m{i}" for i in range(P)], *[f"c{i}{j}" for i, j in _PAIRS])


def keep_clean(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that are not kept: a second pass takes the statistics again and judges each row where it stands."""
    stats = materialize(vectors(statistics(docs)).select("key", "base_failed", *_X), "mcd-stats")
    # Generated columns: the filter below does not repeat the expressions that they are made of.
    again = vectors(statistics(docs)).select("whole", F.inline(F.array(F.struct("key", "base_failed", *_X))))
    return _judged(again, *_parameters(stats)).filter("kept").select("whole.*")
