"""Tables of results: trials, per-configuration aggregates, leaderboards and comparisons between methods.

Missing values are null, never NaN. ``ord`` columns make "first row" explicit where order decides ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palio.operators import order

METRICS = ("upset_simple", "upset_ratio", "upset_naive")


def no_nan(df: DataFrame) -> DataFrame:
    """NaN becomes null in all floating columns."""
    kinds = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    return df.withColumns({c: F.when(F.isnan(c), None).otherwise(F.col(c)) for c in kinds}) if kinds else df


def aggregate_trials(trials: DataFrame, values: tuple[str, ...] = (*METRICS, "runtime_sec")) -> DataFrame:
    """Mean, population deviation (0 of one value), number of trials and of missing values per dataset, method, config, which."""
    stats = [f(c).alias(f"{c}_{n}") for c in values for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))]
    missing = sum((F.count_if(F.col(c).isNull()) for c in values[:3]), F.lit(0))
    return trials.groupBy("dataset", "method", "config", "which").agg(*stats, F.count("*").alias("num_runs"), missing.alias("num_nans"))


def slim(results: DataFrame) -> DataFrame:
    """dataset, method, config and the means without their suffix, of the best checkpoint."""
    return results.where("which = 'upset'").select("dataset", "method", "config", *(F.col(f"{c}_mean").alias(c) for c in (*METRICS, "runtime_sec")))


def best_config(rows: DataFrame, by: tuple[str, ...] = ("upset_simple", "config")) -> DataFrame:
    """Per dataset and method the first non-null value of each column in the order of ``by`` (nulls last).

    So a missing runtime of the best configuration comes from the next one.
    """
    order = F.struct(*(x for c in by for x in (F.col(c).isNull().alias(f"{c}_n"), F.col(c).alias(f"{c}_v"))))
    first = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c)
    return rows.groupBy("dataset", "method").agg(*(first(c) for c in ("config", *METRICS, "runtime_sec")))


def best_row(rows: DataFrame, by: tuple[str, ...] = ("upset_simple", "upset_ratio", "runtime_sec", "config")) -> DataFrame:
    """Per dataset and method the least row by several keys, nulls last."""
    w = Window.partitionBy("dataset", "method").orderBy(*(F.asc_nulls_last(c) for c in by))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def envelope(rows: DataFrame, by: str = "upset_simple", tie: str = "method", prefix: str = "best_") -> DataFrame:
    """Per dataset the method of least ``by`` (first by ``tie``) with all its values."""
    w = Window.partitionBy("dataset").orderBy(F.asc_nulls_last(by), tie)
    top = rows.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    return top.select("dataset", *(F.col(c).alias(prefix + c) for c in ("method", *METRICS, "runtime_sec")))


def independent_minima(rows: DataFrame) -> DataFrame:
    return rows.groupBy("dataset").agg(*(F.min(c).alias(f"min_{c}") for c in (*METRICS, "runtime_sec")))


def decimal_stats(columns: tuple[str, ...], places: int = 6) -> list[Column]:
    """Median and mean of columns with at most so many decimals, rounded half up to as many.

    Both are worked out in integers, so they don't depend on the order of summation, and halves are exact.
    """
    out = []
    for c in columns:
        unit = f"cast(round(`{c}` * {10**places}) as bigint)"
        mean = F.expr(f"(2 * sum({unit}) + count(`{c}`)) div nullif(2 * count(`{c}`), 0)")
        out += [(F.floor(F.median(F.expr(unit)) + 0.5) / 10**places).alias(f"median_{c}"), (mean.cast("double") / 10**places).alias(f"mean_{c}")]
    return out


def summarize(rows: DataFrame, total: Column | int, keys: tuple[str, ...] = ("method",)) -> DataFrame:
    """Median, mean and count of each metric (of six decimals) per key, with a coverage text "n / N"."""
    stats = decimal_stats((*METRICS, "runtime_sec"))
    n = F.count("upset_simple")
    out = rows.groupBy(*keys).agg(F.count_distinct("dataset").alias("n_datasets"), n.alias("n_valid"), *stats)
    return out.withColumn("coverage", F.concat(F.col("n_valid").cast("string"), F.lit(" / "), F.lit(total).cast("string")))


def in_fixed_order(rows: DataFrame, methods: list[str], value: str = "upset_simple") -> DataFrame:
    """Mean and population deviation over datasets for a list of methods, those without rows included."""
    spark = rows.sparkSession
    names = spark.createDataFrame([(i, m) for i, m in enumerate(methods)], "position int, method string")
    agg = rows.groupBy("method").agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("n"))
    return F.broadcast(names).join(agg, "method", "left").fillna(0, ["n"])


def win_tie_loss(pairs: DataFrame, ours: str, other: str, tolerance: float = 1e-6, keys: tuple[str, ...] = (), strict: bool = False) -> DataFrame:
    """Counts of rows where ours is smaller, as large or larger within a tolerance; a null on either side is skipped."""
    gap = F.col(ours) - F.col(other)
    low = gap < -tolerance
    high = gap > tolerance if not strict else gap >= tolerance
    aggs = [F.count_if(low).alias("wins"), F.count_if(~low & ~high).alias("ties"), F.count_if(high).alias("losses"), F.count(gap).alias("n")]
    return pairs.groupBy(*keys).agg(*aggs) if keys else pairs.agg(*aggs)


def runtime_tie(a: Column, b: Column) -> Column:
    """Runtimes tie within 1e-6, or if both are under a millisecond."""
    return (F.abs(a - b) <= 1e-6) | ((a < 1e-3) & (b < 1e-3))


def gaps(pairs: DataFrame, ours: str, other: str, keys: tuple[str, ...] = (), sign: int = 1) -> DataFrame:
    """Distribution of the gap (ours - other, or the opposite for ``sign`` -1) and of the gap relative to other."""
    gap = (F.col(ours) - F.col(other)) * sign
    rel = F.try_divide(gap, F.when(F.col(other) != 0, F.abs(other)))
    cuts = F.array(*(F.lit(q) for q in (0.25, 0.5, 0.75, 0.9)))
    aggs = [F.percentile(gap, cuts).alias("g"), F.avg(gap).alias("mean_gap"), F.max(gap).alias("max_gap"), F.percentile(rel, cuts).alias("r"), F.avg(rel).alias("mean_rel"), F.max(rel).alias("max_rel"), F.count(gap).alias("n")]
    out = pairs.groupBy(*keys).agg(*aggs) if keys else pairs.agg(*aggs)
    named = [F.col(c)[i].alias(f"{q}_{n}") for c, n in (("g", "gap"), ("r", "rel")) for i, q in enumerate(("p25", "median", "p75", "p90"))]
    return out.select(*keys, "n", *named, "mean_gap", "max_gap", "mean_rel", "max_rel")


def nearest_rank(values: DataFrame, column: str, q: float, keys: tuple[str, ...]) -> DataFrame:
    """The value at index round-half-even(q (n - 1)) of the sorted values.

    Ranks come from a window per key, so no key's values are gathered in one row.
    """
    w = Window.partitionBy(*keys)
    rows = values.where(F.col(column).isNotNull()).withColumns({"_i": F.row_number().over(w.orderBy(column)) - 1, "_n": F.count("*").over(w)})
    return rows.where(F.col("_i") == F.bround(q * (F.col("_n") - 1))).select(*keys, F.col(column).alias(f"p{round(100 * q)}"))


def within_share(ours: Column, best: Column, k: float) -> dict[str, Column]:
    """Three meanings of "within k": relative one-sided (wins count), the same only for a positive best, absolute two-sided."""
    rel = F.try_divide(ours - best, F.when(best != 0, F.abs(best)))
    return {"relative": rel <= k, "guarded": (best > 0) & (F.try_divide(ours - best, F.when(best > 0, best)) <= k), "absolute": F.abs(ours - best) <= k}


def speedups(pairs: DataFrame, ours: str, other: str, keys: tuple[str, ...] = ()) -> DataFrame:
    s = F.when(F.col(ours) > 0, F.col(other) / F.col(ours))
    cuts = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    aggs = [F.count(s).alias("n"), F.percentile(s, cuts).alias("q"), F.avg(s).alias("mean"), *(F.count_if(s >= k).alias(f"ge_{k}x") for k in (10, 50, 100))]
    out = pairs.groupBy(*keys).agg(*aggs) if keys else pairs.agg(*aggs)
    return out.select(*keys, "n", F.col("q")[0].alias("p25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("p75"), "mean", "ge_10x", "ge_50x", "ge_100x")


def pareto_quadrants(pairs: DataFrame, quality: tuple[str, str], runtime: tuple[str, str], tolerance: float = 1e-6) -> DataFrame:
    """Better or worse and faster or slower; ties within the tolerance are left out."""
    g, t = F.col(quality[0]) - F.col(quality[1]), F.col(runtime[0]) - F.col(runtime[1])
    better, worse, fast, slow = g < -tolerance, g > tolerance, t < -tolerance, t > tolerance
    return pairs.agg(F.count_if(better & fast).alias("better_faster"), F.count_if(better & slow).alias("better_slower"), F.count_if(worse & fast).alias("worse_faster"), F.count_if(worse & slow).alias("worse_slower"))


def dominated(ours: DataFrame, others: DataFrame, quality: str = "upset_simple", runtime: str = "runtime_sec") -> DataFrame:
    """Per dataset, whether another method is at least as good and as fast as ours (a semi join on the dataset)."""
    o = others.select("dataset", F.col(quality).alias("_q"), F.col(runtime).alias("_t"))
    hit = ours.join(o, (ours["dataset"] == o["dataset"]) & (o["_q"] <= ours[quality]) & (o["_t"] <= ours[runtime]), "left_semi").select("dataset", F.lit(True).alias("dominated"))
    return ours.join(hit.distinct(), "dataset", "left").withColumn("dominated", F.coalesce("dominated", F.lit(False)))


def coverage_curve(rows: DataFrame, budgets: list[int], keys: tuple[str, ...] = ("method",)) -> DataFrame:
    """Share of runs finished within each budget; a missing runtime isn't."""
    b = F.explode(F.array(*(F.lit(x) for x in budgets)))
    return rows.withColumn("budget", b).groupBy(*keys, "budget").agg(F.avg(F.coalesce((F.col("runtime_sec") <= F.col("budget")).cast("double"), F.lit(0.0))).alias("share"))


def coverage_audit(rows: DataFrame, limit: float = 1800.0) -> DataFrame:
    """Per method: rows, valid metrics and runtimes, timeouts (no runtime or beyond the limit), rows within the limit."""
    late = F.col("runtime_sec").isNull() | (F.col("runtime_sec") > limit)
    missing = F.array_join(F.array_sort(F.collect_set(F.when(F.col("upset_simple").isNull(), F.col("dataset")))), ";")
    return rows.groupBy("method").agg(F.count("*").alias("n_rows"), F.count("upset_simple").alias("n_valid_upset_simple"), F.count("runtime_sec").alias("n_valid_runtime"), F.count_if(late).alias("n_timeout"), F.count_if(F.col("runtime_sec") <= limit).alias("n_within_budget"), missing.alias("missing_datasets"))


def with_fallback(primary: DataFrame, fallback: DataFrame, keys: tuple[str, ...] = ("dataset", "method"), order: str = "ord") -> DataFrame:
    """Primary rows, and of the fallback the first row of each key that the primary hasn't."""
    w = Window.partitionBy(*keys).orderBy(order)
    extra = fallback.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    extra = extra.join(primary.select(*keys).distinct(), list(keys), "left_anti")
    return primary.withColumn("source", F.lit("primary")).unionByName(extra.withColumn("source", F.lit("fallback")), allowMissingColumns=True)


def lookup(keys: DataFrame, primary: DataFrame, fallback: DataFrame, values: tuple[str, ...], on: tuple[str, ...] = ("dataset",)) -> DataFrame:
    """Values of the primary's row if there is one, else of the fallback's: rows are chosen whole, not column by column."""
    p = primary.select(*on, F.struct(*values).alias("_p"))
    f = fallback.select(*on, F.struct(*values).alias("_f"))
    out = keys.join(p, list(on), "left").join(f, list(on), "left").withColumn("_v", F.coalesce("_p", "_f"))
    return out.select(*keys.columns, *(F.col(f"_v.{v}").alias(v) for v in values))


def backfill_runtime(rows: DataFrame, aliases: DataFrame, limit: float = 1800.0) -> DataFrame:
    """A missing runtime of a row with an upset becomes the mean of its alias' rows (dataset, alias); flags timeouts anew."""
    mean = rows.groupBy(F.col("dataset").alias("alias"), "method").agg(F.avg("runtime_sec").alias("_mean"))
    out = rows.join(aliases, "dataset", "left").join(mean, ["alias", "method"], "left")
    fill = F.when(F.col("runtime_sec").isNull() & F.col("upset_simple").isNotNull(), F.col("_mean")).otherwise(F.col("runtime_sec"))
    out = out.withColumn("runtime_sec", fill).drop("alias", "_mean")
    return out.withColumn("timeout_flag", F.col("runtime_sec").isNull() | (F.col("runtime_sec") > limit))


def nearest_value(targets: DataFrame, candidates: DataFrame, value: str, accept: float = 1e-3) -> DataFrame:
    """For each dataset's ``target`` the candidate row of nearest ``value`` (first by config), null if further than ``accept``."""
    both = targets.join(candidates.where(F.col(value).isNotNull()), "dataset")
    near = both.groupBy("dataset", "target").agg(F.min(F.struct(F.abs(F.col(value) - F.col("target")).alias("diff"), "config")).alias("m"))
    return targets.join(near, ["dataset", "target"], "left").select("dataset", "target", F.when(F.col("m.diff") <= accept, F.col("m.config")).alias("config"), F.col("m.diff").alias("diff"))


def first_wins(frames: list[DataFrame], keys: tuple[str, ...]) -> DataFrame:
    """Union in which the first frame that has a key wins (first row by all columns within a frame)."""
    tagged = None
    for i, f in enumerate(frames):
        f = f.withColumn("_p", F.lit(i))
        tagged = f if tagged is None else tagged.unionByName(f, allowMissingColumns=True)
    rest = [c for c in tagged.columns if c not in (*keys, "_p")]
    w = Window.partitionBy(*keys).orderBy("_p", *(F.asc_nulls_last(c) for c in rest))
    return tagged.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_p")


def highlight(rows: DataFrame, value: str, keys: tuple[str, ...], larger: bool = False, digits: int = 2) -> DataFrame:
    """Marks the best and the second-best value per key after rounding; the second only if it differs."""
    v = F.round(F.col(value) * 10**digits)
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(v) if larger else F.asc_nulls_last(v))
    r = F.dense_rank().over(w)
    return rows.withColumn("mark", F.when(v.isNull(), "").when(r == 1, "best").when(r == 2, "second").otherwise(""))


def conclusion(rows: DataFrame, value: str, is_ours: Column, is_baseline: Column, keys: tuple[str, ...], digits: int = 2) -> DataFrame:
    """Code of each own method's place among all methods and among the baselines, by rounded values (smaller is better).

    1 best of all; 2 best against the baselines only; 3 second of all; 4 second against the baselines only; 5 both 2 and
    3; 6 none of these or no value. A place counts as second if it equals the second of the sorted values, so a tie with
    the best baseline is a second place there, and that is asked before the place among all.
    """
    v = F.round(F.col(value) * 10**digits)
    groups = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(v)).alias("_all"), F.array_sort(F.collect_list(F.when(is_baseline, v))).alias("_base"))
    own = rows.where(is_ours).withColumn("_v", v).join(groups, list(keys)).withColumn("_base", F.array_sort(F.array_append("_base", F.col("_v"))))
    at = lambda c, i: F.coalesce(F.get(c, F.lit(i)) == F.col("_v"), F.lit(False))
    second = F.when(at("_base", 0), 5).otherwise(3)
    code = F.when(at("_all", 0), 1).when(at("_base", 1), 4).when(at("_all", 1), second).when(at("_base", 0), 2).otherwise(6)
    return own.select(*keys, "method", code.alias("code"))


def long_stats(one_row: DataFrame, section: str) -> DataFrame:
    """A one-row aggregate as rows (section, metric, value)."""
    pairs = ", ".join(f"'{c}', cast(`{c}` as double)" for c in one_row.columns)
    return one_row.select(F.lit(section).alias("section"), F.expr(f"stack({len(one_row.columns)}, {pairs}) as (metric, value)"))


def regimes(rows: DataFrame, bins: dict[str, Column], margin: str) -> DataFrame:
    """Counts, mean and median of a margin per bin of several attributes; a row counts in a bin of each."""
    tags = F.explode(F.array(*(F.struct(F.lit(k).alias("bin_type"), c.alias("bin_label")) for k, c in bins.items())))
    m = F.col(margin)
    return rows.withColumn("_t", tags).groupBy("_t.bin_type", "_t.bin_label").agg(F.count(m).alias("sample_size"), F.count_if(m < -1e-12).alias("wins"), F.count_if(F.abs(m) <= 1e-12).alias("ties"), F.count_if(m > 1e-12).alias("losses"), F.avg(m).alias("mean_margin"), F.median(m).alias("median_margin"))


def complete(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without a null in any of the columns."""
    return rows.dropna(subset=columns)


def log_scale_valid(rows: DataFrame, metrics: tuple[str, ...] = ("upset_simple", "upset_ratio"), runtime: str = "runtime_sec") -> DataFrame:
    """Rows that a plot over logarithmic runtimes can show."""
    return complete(rows, list(metrics)).where(F.col(runtime) > 0)


def zero_filled(counts: DataFrame, grid: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Counts for every key of ``grid``, 0 where there are none. The grid is a product of a few names."""
    return grid.join(counts, keys, "left").fillna(0, values)


def numbered(rows: DataFrame, by: list[Column], keys: tuple[str, ...], name: str = "position") -> DataFrame:
    """Rows with their place, from 1, in an order inside each key: numbers from range partitions, no window over a key. Give an order without ties."""
    return order.positions(rows, list(keys), by, name, start=1)


def missing_last(value: str, stand_in: float = 1e18) -> Column:
    """A sort key in which a missing value counts as a very large one."""
    return F.coalesce(F.col(value), F.lit(stand_in))


def truncated(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first rows of a report list."""
    return rows.orderBy(*order).limit(most)


def any_key(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Keys that at least one of the frames has."""
    out = frames[0].select(*keys)
    for f in frames[1:]:
        out = out.union(f.select(*keys))
    return out.distinct()
