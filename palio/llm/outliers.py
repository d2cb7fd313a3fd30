"""Quality rules with robust multivariate outliers, in DataFrame functions only.

Word statistics of every text are counted with higher-order functions. Texts that pass the base rules are
judged by a minimum-covariance-determinant estimate per language and source, which is drawn towards its language's and that
towards the corpus' in the measure that it has few rows. From several starts (medians with median
deviations, the noise floors, and plain mean and covariance) concentration steps take mean and covariance of the
share of rows with the least Mahalanobis distances; of a group's results the one of least determinant is kept.
Distances are counted in logarithmic bins per group and start, so a step is one aggregation over rows and the share
ends with the bin that holds its last row. A last step reweights by a chi-square cut.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column

from ._common import DataFrame, F, SparkSession, Window, drop, is_small, let, stored, tables

#: Share of rows the estimate rests on, concentration steps, rows that the wider group's estimate counts as (it has 14 numbers).
SHARE, STEPS, PRIOR_ROWS = 0.75, 4, 50
#: Quantile of the chi-square distribution beyond which a row is an outlier.
CUT = 0.999
#: Smallest standard deviation of each statistic, also given the ones before it: half the rows may share one value.
FLOORS = {"word_length": 0.05, "symbols": 0.03, "dup_lines": 0.05, "repeats": 0.07}
_SPACE = r"[ \t\n\x0b\f\r]+"
#: Bins of distance: 24 per factor of two.
_PER_OCTAVE = 24


def _chi2_cdf(x: float, k: int) -> float:
    """For even degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(k // 2))


def chi2_quantile(q: float, k: int) -> float:
    lo, hi = 0.0, 4.0 * k + 400
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _chi2_cdf(mid, k) < q else (lo, mid)
    return hi


def _repeated(w: Column) -> Column:
    """Words in 3-word windows found twice or more. A window is known by a chained 64-bit hash of its words."""

    def of(h: Column) -> Column:
        marked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            twin = F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]))
            return let(F.sort_array(F.transform(twin, lambda x: x["i"])), lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, b: a + b))

        return F.when(F.size(F.array_distinct(h)) < F.size(h), let(marked, lambda s: F.coalesce(places(s), F.lit(0)))).otherwise(0)

    grams = F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), 1, F.greatest(F.size(w) - 2, F.lit(0)))
    return F.when(F.size(w) >= 4, let(grams, of)).otherwise(0)


def statistics(documents: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long); a null text has none of anything."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    words = F.filter(F.split(t, _SPACE), lambda x: x != "")
    of_words = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), F.char_length(F.array_join(w, "")).cast("long").alias("chars"), _repeated(w).cast("long").alias("repeated")))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^ \t\n\x0b\f\r]"))
    dups = let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    out = documents.withColumns({"_w": of_words, "n_symbols": F.char_length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long"), "n_dup_lines": dups})
    return out.withColumns({"n_words": F.col("_w.n"), "word_chars": F.col("_w.chars"), "n_repeat_words": F.col("_w.repeated")}).drop("_w")


def vector() -> dict[str, Column]:
    """The transformed statistics: log word length, square roots of shares of symbols, repeated lines and words."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "word_length": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
        "symbols": F.sqrt(F.least(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)), F.lit(1.0))),
        "dup_lines": F.sqrt(F.least(F.col("n_dup_lines") / n, F.lit(1.0))),
        "repeats": F.sqrt(F.col("n_repeat_words") / n),
    }


NAMES = list(FLOORS)
P = len(NAMES)


def _inverse_cholesky(cov: dict[tuple[int, int], Column], df: DataFrame, keep: list[str]) -> DataFrame:
    """Columns w_i_j of the inverse of the lower Cholesky factor, one small projection after another."""
    df = df.withColumns({f"c_{i}_{j}": c for (i, j), c in cov.items()})
    for i in range(P):
        for j in range(i + 1):
            rest = F.col(f"c_{i}_{j}")
            for k in range(j):
                rest = rest - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            df = df.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(rest, F.lit(FLOORS[NAMES[i]] ** 2))) if i == j else rest / F.col(f"l_{j}_{j}"))
    for j in range(P):
        for i in range(j, P):
            if i == j:
                df = df.withColumn(f"w_{i}_{j}", 1 / F.col(f"l_{i}_{i}"))
            else:
                s = F.lit(0.0)
                for k in range(j, i):
                    s = s + F.col(f"l_{i}_{k}") * F.col(f"w_{k}_{j}")
                df = df.withColumn(f"w_{i}_{j}", -s / F.col(f"l_{i}_{i}"))
    det = F.lit(0.0)
    for i in range(P):
        det = det + 2 * F.log(F.col(f"l_{i}_{i}"))
    return df.select(*keep, *(f"m_{i}" for i in range(P)), *(f"w_{i}_{j}" for i in range(P) for j in range(i + 1)), det.alias("log_det"))


def _distance() -> Column:
    total = F.lit(0.0)
    for i in range(P):
        y = F.lit(0.0)
        for j in range(i + 1):
            y = y + F.col(f"w_{i}_{j}") * (F.col(NAMES[j]) - F.col(f"m_{j}"))
        total = total + y * y
    return total


def _with_state(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Rows with their group's estimate. States are broadcast if few by count; else the join's skewed parts are split by Spark."""
    return rows.join(F.broadcast(state) if is_small(state, 20_000) else state, "group", "left")


def _starts(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """First estimates by group and start: medians with median deviations (0) or with the floors (1), mean and covariance (2)."""
    mid = [F.percentile_approx(c, 0.5, 2000).alias(f"m_{i}") for i, c in enumerate(NAMES)]
    center, path = stored(rows.groupBy("group").agg(*mid), "center")
    off = _with_state(rows, center)
    mad = [F.percentile_approx(F.abs(F.col(c) - F.col(f"m_{i}")), 0.5, 2000).alias(f"d_{i}") for i, c in enumerate(NAMES)]
    spread = center.join(off.groupBy("group").agg(*mad), "group").withColumn("start", F.lit(0))
    cells = [(i, j) for i in range(P) for j in range(i + 1)]
    diagonal = {(i, j): F.pow(F.col(f"d_{i}") * 1.4826, 2) if i == j else F.lit(0.0) for i, j in cells}
    floors = center.withColumn("start", F.lit(1))
    least = {(i, j): F.lit(FLOORS[NAMES[i]] ** 2 if i == j else 0.0) for i, j in cells}
    plain = rows.groupBy("group").agg(*(F.avg(c).alias(f"m_{i}") for i, c in enumerate(NAMES)), *(F.covar_pop(NAMES[i], NAMES[j]).alias(f"v_{i}_{j}") for i, j in cells)).withColumn("start", F.lit(2))
    own = {(i, j): F.col(f"v_{i}_{j}") for i, j in cells}
    keys = ["group", "start"]
    every = _inverse_cholesky(diagonal, spread, keys).unionByName(_inverse_cholesky(least, floors, keys)).unionByName(_inverse_cholesky(own, plain, keys))
    state, more = stored(every, "state")
    return state, [path, more]


_CELLS = [(i, j) for i in range(P) for j in range(i + 1)]


def _moments(rows: DataFrame, state: DataFrame, share: float | None, limit: float, scale: float) -> DataFrame:
    """Rows, means and scaled covariances (v_i_j) of the rows of least distance: the ``share`` of them, or all within ``limit``."""
    scored = _with_state(rows, state).withColumn("d2", _distance())
    bin_ = F.floor(F.log2(F.greatest(F.col("d2"), F.lit(1e-6))) * _PER_OCTAVE).cast("int")
    sums = [F.count("*").alias("n"), *(F.sum(c).alias(f"s_{i}") for i, c in enumerate(NAMES)), *(F.sum(F.col(NAMES[i]) * F.col(NAMES[j])).alias(f"x_{i}_{j}") for i in range(P) for j in range(i + 1))]
    keys = ["group", "start"]
    bins = scored.withColumn("bin", bin_).groupBy(*keys, "bin").agg(*sums)  # some hundred bins each
    if share is None:
        bins = bins.where(F.col("bin") <= math.floor(math.log2(limit) * _PER_OCTAVE))
    else:
        line = Window.partitionBy(*keys).orderBy("bin")
        bins = bins.withColumn("before", F.sum("n").over(line) - F.col("n")).withColumn("all", F.sum("n").over(Window.partitionBy(*keys))).where(F.col("before") < F.ceil(F.col("all") * share))
    total = bins.groupBy(*keys).agg(F.sum("n").alias("n"), *(F.sum(f"s_{i}").alias(f"s_{i}") for i in range(P)), *(F.sum(f"x_{i}_{j}").alias(f"x_{i}_{j}") for i in range(P) for j in range(i + 1)))
    total = total.withColumns({f"m_{i}": F.col(f"s_{i}") / F.col("n") for i in range(P)})
    cov = {f"v_{i}_{j}": (F.col(f"x_{i}_{j}") / F.col("n") - F.col(f"m_{i}") * F.col(f"m_{j}")) * scale for i, j in _CELLS}
    return total.withColumns(cov).select(*keys, "n", *(f"m_{i}" for i in range(P)), *cov)


def _step(rows: DataFrame, state: DataFrame, share: float) -> DataFrame:
    """Estimates from the ``share`` of rows of least distance."""
    shrink = share / _chi2_cdf(chi2_quantile(share, P), P + 2)  # makes the covariance of the inner share consistent at the normal
    return _inverse_cholesky({(i, j): F.col(f"v_{i}_{j}") for i, j in _CELLS}, _moments(rows, state, share, 0.0, shrink), ["group", "start"])


def estimate(rows: DataFrame, share: float = SHARE, steps: int = STEPS) -> tuple[DataFrame, list[str]]:
    """Per group: n, means (m_i) and covariances (v_i_j). ``rows``: group and the transformed statistics, stored."""
    spark = rows.sparkSession
    state, paths = _starts(rows)
    for _ in range(steps):
        state, path = stored(_step(rows, state, share), "state")
        paths.append(path)
    # the least determinant of every group; equal ones by the first start
    best = state.groupBy("group").agg(F.min_by(F.struct(*state.columns), F.struct("log_det", "start")).alias("s")).select("s.*")
    best, path = stored(best, "state")
    paths.append(path)
    reweight = NormalDist().cdf(2.0)  # all rows within a wide quantile of the raw estimate
    limit = chi2_quantile(reweight, P)
    last, path = stored(_moments(rows, best, None, limit, reweight / _chi2_cdf(limit, P + 2)), "state")
    drop(spark, *paths)
    return last.drop("start"), [path]


def _drawn(own: DataFrame, wide: DataFrame, on: list[str]) -> DataFrame:
    """``own`` estimates drawn towards ``wide`` ones: of n rows with weight n / (n + PRIOR_ROWS). One of no rows is the wide one."""
    names = [*(f"m_{i}" for i in range(P)), *(f"v_{i}_{j}" for i, j in _CELLS)]
    side = wide.select(*on, *(F.col(c).alias(f"_{c}") for c in names))
    both = own.join(side, on)
    share = F.coalesce(F.col("n"), F.lit(0)) / (F.coalesce(F.col("n"), F.lit(0)) + PRIOR_ROWS)
    mixed = {c: share * F.coalesce(c, F.lit(0.0)) + (1 - share) * F.col(f"_{c}") for c in names}
    return both.withColumns(mixed).select(*own.columns)


def judge(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", share: float = SHARE, cut: float = CUT) -> DataFrame:
    """``key``, the five counts, base_failed, kept and distance (squared Mahalanobis; null if not judged).

    Base rules reject texts of under 50 words or with more than half their words in repeated 3-word windows;
    null and empty texts fail. Null languages and sources are groups of their own. Every language and source has an estimate,
    whatever its size: of n rows it is mixed with its language's as if that had ``PRIOR_ROWS``, which is mixed with
    the corpus' the same way. One row per input row; equal rows are judged alike.
    """
    cols = documents.select(F.col(key).alias("k"), F.col(text).alias("t"), F.coalesce(F.col(lang).cast("string"), F.lit("\x00")).alias("lang"), F.coalesce(F.col(source).cast("string"), F.lit("\x00")).alias("source"))
    base, _ = stored(statistics(cols, "t").drop("t").withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))), "statistics")
    passing = base.where("not base_failed")
    own, whole, every = F.concat(F.lit("2"), "lang", F.lit("\x01"), "source"), F.concat(F.lit("1"), "lang"), F.lit("0")
    rows, _ = stored(passing.select(F.explode(F.array(own, whole, every)).alias("group"), *(c.alias(n) for n, c in vector().items())), "vectors")
    state, _ = estimate(rows, share)
    groups, _ = stored(passing.select("lang", "source").distinct(), "groups")
    top = state.where(F.col("group") == "0").withColumn("level", F.lit(0)).drop("group")  # one row, the corpus' estimate
    langs = groups.select("lang").distinct().withColumn("group", whole).join(state, "group", "left").withColumn("level", F.lit(0)).drop("group")
    sources = groups.withColumn("group", own).join(state, "group", "left").drop("group")
    drawn = _drawn(sources, _drawn(langs, top, ["level"]), ["lang"])
    near, _ = stored(_inverse_cholesky({(i, j): F.col(f"v_{i}_{j}") for i, j in _CELLS}, drawn, ["lang", "source"]), "drawn")
    near = F.broadcast(near) if is_small(groups, 20_000) else near
    scored = base.join(near, ["lang", "source"], "left").withColumns(vector()).withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= chi2_quantile(cut, P), F.lit(True))
    return scored.select(F.col("k").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(tables(spark, sf_dir, "documents"))
