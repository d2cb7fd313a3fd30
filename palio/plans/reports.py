"""Queries of suites, report tables, names and checks, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from palio.functions import names
from palio.operators import audit, graph, metrics, rank_rel, results, suites, tables
from palio.operators.iterate import stored
from palio.plans import inputs as I
from palio.plans.queries import _WTL, B_, C_, M4, T_, V_, _kendall_sql
from palio.plans.registry import query
from palio.sources import writers

MET = ("upset_simple", "upset_ratio", "upset_naive")
FAMILIES = ["Basketball_temporal", "Faculty", "Football", "finance", "finerBasketball"]
#: Seconds of the coverage curve.
BUDGETS = [60, 120, 300, 600, 1800, 3600, 7200]
def _gnn():
    return F.col("method").startswith("DIGRAC")


def _family():
    return names.family_prefix(F.col("dataset"))


# --- projections and filters


@query("prj01_columns", "SELECT l_orderkey AS game, l_suppkey AS home, l_quantity AS home_goals FROM lineitem", "", "home_goals")
def _(s, d):
    return graph.renamed(I.table(s, d, "lineitem"), ["l_orderkey", "l_suppkey", "l_quantity"], ["game", "home", "home_goals"])


_MATCHES = "WITH matches AS (SELECT CAST(year(o_orderdate) AS VARCHAR) dataset, o_orderkey home, o_custkey away, l_quantity a, CAST(l_linenumber * 10 AS DOUBLE) b FROM orders JOIN lineitem ON l_orderkey = o_orderkey) "


def _matches(s, d):
    m = I.table(s, d, "orders").join(I.table(s, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    return m.select(F.year("o_orderdate").cast("string").alias("dataset"), F.col("o_orderkey").alias("home"), F.col("o_custkey").alias("away"), F.col("l_quantity").alias("home_goals"), (F.col("l_linenumber") * 10).cast("double").alias("away_goals"))


@query("prj03_goal_differences", _MATCHES + "SELECT dataset, home src, away dst, a - b w FROM matches WHERE a > b UNION ALL SELECT dataset, away, home, b - a FROM matches WHERE b > a")
def _(s, d):
    return graph.goal_difference_edges(_matches(s, d))


@query("prj04_goals_both_ways", _MATCHES + "SELECT dataset, home src, away dst, a + 0.1::DOUBLE w FROM matches UNION ALL SELECT dataset, away, home, b + 0.1::DOUBLE FROM matches")
def _(s, d):
    return graph.finer_edges(_matches(s, d))


@query("flt01_complete_rows", "SELECT * FROM slim WHERE upset_simple IS NOT NULL AND runtime_sec IS NOT NULL", T_)
def _(s, d):
    return results.complete(I.slim(s, d), ["upset_simple", "runtime_sec"])


@query("flt03_seasons", "SELECT dataset, count(*) m, sum(w) total FROM edges WHERE dataset IN ('1993', '1994', '1995', '1996') GROUP BY dataset", I.MATCH, "total")
def _(s, d):
    wanted = s.range(1).select(F.explode(names.seasons(1993, 1996, "")).alias("dataset"))
    return I.match_edges(s, d).join(wanted, "dataset", "left_semi").groupBy("dataset").agg(F.count("*").alias("m"), F.sum("w").alias("total"))


@query("flt04_suite", "SELECT * FROM slim WHERE dataset <> 'Faculty/1996-01' AND config LIKE '%trials10%' AND dataset IN (SELECT dataset FROM board WHERE method = 'btl')", B_)
def _(s, d):
    return suites.suite(I.slim(s, d), "Faculty/1996-01", I.leaderboard(s, d).where("method = 'btl'"), "trials10")


@query("flt06_gnn_rows", "SELECT g.dataset, g.method, g.config, " + ", ".join(f"coalesce(g.{c}, f.{c}) {c}" for c in MET) + ", g.runtime_sec FROM slim g LEFT JOIN (SELECT dataset, method, config, " + ", ".join(f"round({c}_mean, 6) {c}" for c in MET) + " FROM results WHERE which = 'upset_latest') f USING (dataset, method, config) WHERE g.method LIKE 'DIGRAC%'", T_)
def _(s, d):
    latest = results.aggregate_trials(I.trials(s, d)).where("which = 'upset_latest'")
    full = latest.select("dataset", "method", "config", *(F.round(f"{c}_mean", 6).alias(c) for c in MET))
    return suites.gnn_rows(I.slim(s, d), _gnn(), full)


@query("flt07_log_scale", "SELECT * FROM board WHERE runtime_sec > 0 AND upset_simple IS NOT NULL AND upset_ratio IS NOT NULL", B_)
def _(s, d):
    return results.log_scale_valid(I.leaderboard(s, d))


@query("prj10_wide_union", "SELECT dataset, method, config, upset_simple, upset_ratio, upset_naive, runtime_sec, NULL AS variant FROM board WHERE method NOT LIKE 'DIGRAC%' UNION ALL SELECT dataset, 'GNN', NULL, upset_simple, upset_ratio, NULL, runtime_sec, method FROM board WHERE method LIKE 'DIGRAC%'", B_)
def _(s, d):
    b = I.leaderboard(s, d)
    return suites.wide_union(b.where(~_gnn()), b.where(_gnn()))


# --- attributes and regimes

ATTR = "attr AS (SELECT (['Basketball_temporal/', 'finerBasketball/', 'Football/', 'Faculty/'])[month(o_orderdate) % 4 + 1] || strftime(o_orderdate, '%Y-%m') dataset, count(DISTINCT l_suppkey) n, count(DISTINCT (l_suppkey, l_partkey)) m FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL), rich AS (SELECT c.*, a.n, a.m, a.m / (a.n * (a.n - 1.0::DOUBLE)) density, ours_upset_simple - best_upset_simple margin FROM cmp c LEFT JOIN attr a USING (dataset))"


def _attributes(s, d):
    items = I.table(s, d, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey")
    orders = I.table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), I.dataset_of(F.col("o_orderdate")).alias("dataset"))
    pairs = items.join(orders, "l_orderkey").groupBy("dataset", "l_suppkey", "l_partkey").agg(F.lit(1).alias("one"))
    return pairs.groupBy("dataset", "l_suppkey").agg(F.count("*").alias("c")).groupBy("dataset").agg(F.count("*").alias("n"), F.sum("c").alias("m"))


def _rich(s, d):
    c = suites.attributes(I.comparison(s, d), _attributes(s, d))
    return c.withColumn("margin", F.col("ours_upset_simple") - F.col("best_upset_simple"))


@query("join11_attributes", "SELECT dataset, split_part(dataset, '/', 1) family, n, m, density, margin FROM rich", C_ + "," + ATTR, "density margin")
def _(s, d):
    return _rich(s, d).select("dataset", _family().alias("family"), "n", "m", "density", "margin")


_LABELS = "[('family', split_part(dataset, '/', 1)), ('size', CASE WHEN n <= 8 THEN 'small' WHEN n <= 60 THEN 'middle' ELSE 'large' END), ('runtime', CASE WHEN ours_runtime_sec <= 60 THEN 'short' WHEN ours_runtime_sec <= 150 THEN 'middle' ELSE 'long' END), ('density', CASE WHEN density <= 0.5 THEN 'density<=0.5' END), ('density', CASE WHEN density <= 1.0 THEN 'density<=1.0' END), ('density', CASE WHEN density <= 2.0 THEN 'density<=2.0' END)]"


@query("agg24_regimes_all", f"SELECT bin_type, bin_label, count(margin) sample_size, count(*) FILTER (margin < -1e-12) wins, count(*) FILTER (abs(margin) <= 1e-12) ties, count(*) FILTER (margin > 1e-12) losses, avg(margin) mean_margin, median(margin) median_margin FROM (SELECT margin, t[1] bin_type, t[2] bin_label FROM (SELECT margin, unnest([[x[1], x[2]] for x in {_LABELS}]) t FROM rich)) WHERE bin_label IS NOT NULL GROUP BY ALL", C_ + "," + ATTR, "mean_margin median_margin")
def _(s, d):
    one = lambda kind, label: F.struct(F.lit(kind).alias("bin_type"), label.alias("bin_label"))
    size, took = names.bin_name(F.col("n"), [(8, "small"), (60, "middle")], "large"), names.bin_name(F.col("ours_runtime_sec"), [(60, "short"), (150, "middle")], "long")
    dense = [F.when(F.col("density") <= t, f"density<={t}") for t in (0.5, 1.0, 2.0)]
    return suites.regimes(_rich(s, d), F.array(one("family", _family()), one("size", size), one("runtime", took), *(one("density", x) for x in dense)), "margin")


@query("agg25_verdict", "SELECT family, count(margin) n, CASE WHEN avg(margin) < 0 AND count(margin) >= 20 THEN CASE WHEN coalesce(avg(margin) FILTER (density <= 1.0), 0) < 0 THEN 'strong and robust' ELSE 'promising but narrow' END ELSE 'too unstable to emphasize' END verdict FROM (SELECT *, split_part(dataset, '/', 1) family FROM rich) GROUP BY family", C_ + "," + ATTR)
def _(s, d):
    dense = F.coalesce(F.avg(F.when(F.col("density") <= 1.0, F.col("margin"))), F.lit(0.0)) < 0
    g = _rich(s, d).groupBy(_family().alias("family")).agg(F.count("margin").alias("n"), F.coalesce(F.avg("margin") < 0, F.lit(False)).alias("good"), dense.alias("dense"))
    return g.select("family", "n", names.verdict(F.col("good"), F.col("n"), F.col("dense")).alias("verdict"))


# --- aggregates


@query("agg10_conclusion", "SELECT dataset, method, CASE WHEN v IS NULL THEN 6 WHEN lt_all = 0 THEN 1 WHEN lt_base = 1 OR (lt_base = 0 AND eq_base > 0) THEN 4 WHEN lt_all = 1 THEN CASE WHEN lt_base = 0 THEN 5 ELSE 3 END WHEN lt_base = 0 THEN 2 ELSE 6 END code FROM (SELECT o.dataset, o.method, any_value(o.v) v, count(*) FILTER (b.v < o.v) lt_all, count(*) FILTER (b.v < o.v AND b.base) lt_base, count(*) FILTER (b.v = o.v AND b.base) eq_base FROM (SELECT dataset, method, round(upset_simple * 100) v FROM board WHERE method LIKE 'MFAS%' OR method = 'DIGRAC') o JOIN (SELECT dataset, round(upset_simple * 100) v, method IN ('SpringRank', 'davidScore', 'PageRank', 'btl') base FROM board) b ON b.dataset = o.dataset GROUP BY o.dataset, o.method)", B_)
def _(s, d):
    own = F.col("method").startswith("MFAS") | _gnn()
    return results.conclusion(I.leaderboard(s, d), "upset_simple", own, F.col("method").isin(I.CLASSICAL), ("dataset",))


@query("agg12_zero_filled", f"SELECT g.metric, g.family, coalesce(c.wins, 0) wins, coalesce(c.ties, 0) ties, coalesce(c.losses, 0) losses, coalesce(c.n, 0) n FROM (SELECT metric, family FROM (SELECT unnest(['simple', 'ratio']) metric), (SELECT unnest({FAMILIES}) family)) g LEFT JOIN (SELECT metric, family, " + _WTL.format(t="1e-6") + " FROM (SELECT 'simple' metric, split_part(dataset, '/', 1) family, ours_upset_simple - best_upset_simple g FROM cmp UNION ALL SELECT 'ratio', split_part(dataset, '/', 1), ours_upset_ratio - best_upset_ratio FROM cmp) GROUP BY ALL) c USING (metric, family)", C_)
def _(s, d):
    c = stored(I.comparison(s, d).withColumn("family", _family()))
    counts = None
    for m in ("simple", "ratio"):
        one = results.win_tie_loss(c, f"ours_upset_{m}", f"best_upset_{m}", keys=("family",)).withColumn("metric", F.lit(m))
        counts = one if counts is None else counts.unionByName(one)
    grid = s.createDataFrame([(m, f) for m in ("simple", "ratio") for f in FAMILIES], "metric string, family string")
    return results.zero_filled(counts, grid, ["metric", "family"], ["wins", "ties", "losses", "n"])


@query("agg16_coverage_by_family", f"SELECT split_part(dataset, '/', 1) family, b.budget, avg(CASE WHEN 40 * runtime_sec <= b.budget THEN 1.0 ELSE 0.0 END) share FROM board, (SELECT unnest({BUDGETS}) budget) b GROUP BY ALL", B_, "share")
def _(s, d):
    b = I.leaderboard(s, d).withColumn("family", _family()).withColumn("runtime_sec", F.col("runtime_sec") * 40)  # spreads over all budgets
    return results.coverage_curve(b, BUDGETS, ("family",))


_RATES = ("count(*) n", *(f"count(*) FILTER (r <= {k / 100}) within_{k}" for k in (1, 5, 10)))


@query("agg32_against_gnn", f"SELECT family, {', '.join(_RATES)} FROM (SELECT split_part(o.dataset, '/', 1) family, CASE WHEN g.upset_simple > 0 THEN (o.upset_simple - g.upset_simple) / g.upset_simple END r FROM board o JOIN board g ON g.dataset = o.dataset AND g.method = 'DIGRAC' WHERE o.method = 'MFAS_INS3') GROUP BY family", B_)
def _(s, d):
    b = I.leaderboard(s, d)
    ours = b.where(F.col("method") == I.OURS).select("dataset", F.col("upset_simple").alias("o"))
    c = ours.join(b.where(_gnn()).select("dataset", F.col("upset_simple").alias("g")), "dataset")
    k = {n: results.within_share(F.col("o"), F.col("g"), n / 100)["guarded"] for n in (1, 5, 10)}
    return c.groupBy(_family().alias("family")).agg(F.count("*").alias("n"), *(F.count_if(x).alias(f"within_{n}") for n, x in k.items()))


_MODES = "SELECT 'B' AS mode, ours_upset_simple o, best_upset_simple b FROM cmp UNION ALL SELECT 'A', avg(ours_upset_simple), avg(best_upset_simple) FROM cmp GROUP BY split_part(dataset, '/', 1), substr(split_part(dataset, '/', 2), 1, 4)"


@query("agg33_by_mode", "SELECT mode, " + _WTL.format(t="1e-6") + f", avg(g) mean_gap, median(g) median_gap FROM (SELECT mode, o - b g FROM ({_MODES})) GROUP BY mode", C_, "mean_gap median_gap")
def _(s, d):
    c = stored(I.comparison(s, d).select("dataset", F.col("ours_upset_simple").alias("o"), F.col("best_upset_simple").alias("b")))
    year = F.substring(F.split_part("dataset", F.lit("/"), F.lit(2)), 1, 4)
    a = c.groupBy(_family(), year).agg(F.avg("o").alias("o"), F.avg("b").alias("b")).select(F.lit("A").alias("mode"), "o", "b")
    both = a.unionByName(c.select(F.lit("B").alias("mode"), "o", "b"))
    counts = results.win_tie_loss(both, "o", "b", keys=("mode",))
    g = F.col("o") - F.col("b")
    return counts.join(both.groupBy("mode").agg(F.avg(g).alias("mean_gap"), F.median(g).alias("median_gap")), "mode")


def _stack_sql(section: str, inner: str, columns: list[str]) -> str:
    return f"SELECT '{section}' AS section, unnest({columns}) metric, unnest([{', '.join(columns)}]::DOUBLE[]) AS value FROM ({inner})"


_G = "ours_upset_{m} - best_upset_{m}"
_STATS = " UNION ALL ".join(
    [_stack_sql(f"wtl_{m}", f"SELECT {_WTL.format(t='1e-6')} FROM (SELECT {_G.format(m=m)} g FROM cmp)", ["wins", "ties", "losses", "n"]) for m in ("simple", "ratio", "naive")]
    + [_stack_sql(f"gap_{m}", f"SELECT count(gap) n, avg(gap) mean_gap, max(gap) max_gap, avg(rel) mean_rel, max(rel) max_rel, {', '.join(f'quantile_cont({c}, {p}) {n}_{c}' for c in ('gap', 'rel') for p, n in ((0.25, 'p25'), (0.5, 'median'), (0.75, 'p75'), (0.9, 'p90')))} FROM (SELECT {_G.format(m=m)} gap, ({_G.format(m=m)}) / nullif(abs(best_upset_{m}), 0) rel FROM cmp)", ["n", *(f"{q}_{c}" for c in ("gap", "rel") for q in ("p25", "median", "p75", "p90")), "mean_gap", "max_gap", "mean_rel", "max_rel"]) for m in ("simple", "ratio")]
)


@query("agg28_all_stats", _STATS, C_, "value")
def _(s, d):
    c, out = stored(I.comparison(s, d)), None
    parts = [(f"wtl_{m}", results.win_tie_loss(c, f"ours_upset_{m}", f"best_upset_{m}")) for m in ("simple", "ratio", "naive")]
    parts += [(f"gap_{m}", results.gaps(c, f"ours_upset_{m}", f"best_upset_{m}")) for m in ("simple", "ratio")]
    for name, one in parts:
        r = results.long_stats(one, name)
        out = r if out is None else out.unionByName(r)
    return out


METHODS = ["MFAS_INS3", "SpringRank", "btl", "absent"]
_FIRST = ", ".join(f"arg_min({c}, (upset_simple IS NULL, upset_simple, config)) FILTER ({c} IS NOT NULL) {c}" for c in M4)


def _method_table_sql(rows: str, total: str) -> str:
    stats = I.decimal_stats_sql(M4)
    return f"SELECT m.method, coalesce(t.n_datasets, 0) n_datasets, t.* EXCLUDE (method, n_datasets), coalesce(t.n_datasets, 0) || '/' || ({total}) coverage FROM (SELECT unnest({METHODS}) AS method) m LEFT JOIN (SELECT method, count(upset_simple) n_datasets, {stats} FROM (SELECT dataset, method, {_FIRST} FROM {rows} GROUP BY ALL) GROUP BY method) t ON t.method = m.method"


_STAT_NAMES = " ".join(f"{n}_{c}" for c in M4 for n in ("median", "mean"))


@query("agg31_full_suite_table", _method_table_sql("(SELECT * FROM slim WHERE dataset <> 'Faculty/1996-03' AND config LIKE '%trials10%')", "SELECT count(DISTINCT dataset) FROM slim WHERE dataset <> 'Faculty/1996-03'"), T_, _STAT_NAMES)
def _(s, d):
    whole = stored(suites.suite(I.slim(s, d), "Faculty/1996-03"))
    return suites.method_table(suites.suite(whole, config_part="trials10"), METHODS, whole)


@query("agg31_compute_matched_table", _method_table_sql("(SELECT * FROM slim WHERE runtime_sec <= 180 AND config LIKE '%trials10%')", "SELECT count(DISTINCT dataset) FROM slim WHERE runtime_sec <= 180"), T_, _STAT_NAMES)
def _(s, d):
    whole = stored(I.slim(s, d).where("runtime_sec <= 180"))
    return suites.method_table(suites.suite(whole, config_part="trials10"), METHODS, whole)


@query("agg31_missingness_table", f"SELECT m.method, coalesce(n_valid, 0) n_valid, coalesce(n_timeouts, 0) n_timeouts, coalesce(n_valid, 0) || '/80' coverage FROM (SELECT unnest({METHODS}) AS method) m LEFT JOIN (SELECT method, count(upset_simple) n_valid, count(*) FILTER (runtime_sec IS NULL OR runtime_sec > 180) n_timeouts FROM board GROUP BY method) t ON t.method = m.method", B_)
def _(s, d):
    return suites.missingness(None, I.slim(s, d), METHODS, 80, 180.0)


# --- order, top and sets


@query("srt01_order", "SELECT *, row_number() OVER (PARTITION BY method ORDER BY dataset, upset_simple NULLS LAST, config) AS position FROM slim", T_)
def _(s, d):
    return results.numbered(I.slim(s, d), [F.asc("dataset"), F.asc_nulls_last("upset_simple"), F.asc("config")], ("method",))


@query("srt02_edges_by_weight", "SELECT dataset, src, dst, w, row_number() OVER (PARTITION BY dataset ORDER BY w DESC, src, dst) AS position FROM edges", I.MATCH, "w")
def _(s, d):
    return results.numbered(I.match_edges(s, d), [F.desc("w"), F.asc("src"), F.asc("dst")], ("dataset",))


@query("srt03_missing_last", "SELECT dataset, method, runtime_sec, row_number() OVER (PARTITION BY dataset ORDER BY coalesce(runtime_sec, 1e18), method) AS position FROM board", B_)
def _(s, d):
    b = I.leaderboard(s, d).select("dataset", "method", "runtime_sec")
    return results.numbered(b, [results.missing_last("runtime_sec").asc(), F.asc("method")], ("dataset",))


@query("top03_truncated_list", "SELECT dataset, method FROM slim WHERE upset_simple IS NULL ORDER BY dataset, method, config LIMIT 15", T_)
def _(s, d):
    return results.truncated(I.slim(s, d).where("upset_simple is null"), [F.asc("dataset"), F.asc("method"), F.asc("config")], 15).select("dataset", "method")


@query("set03_any_key", "SELECT DISTINCT dataset FROM (SELECT dataset FROM board WHERE method = 'btl' AND upset_simple > 1 UNION SELECT dataset FROM slim WHERE method = 'DIGRAC' AND runtime_sec < 100)", B_)
def _(s, d):
    return results.any_key([I.leaderboard(s, d).where("method = 'btl' and upset_simple > 1"), I.slim(s, d).where("method = 'DIGRAC' and runtime_sec < 100")], ["dataset"])


# --- names

#: Written forms of names, "@" for a season; every order line has the names that its keys select.
_FOLDERS = ["Basketball_temporal/finer@", "Basketball_temporal/@", "Football_data_England_Premier_League/finerEngland_@_@", "Football_data_England_Premier_League/England_@_@", "FacultyHiringNetworks/Business/Business_FM_Full_", "Dryad_animal_society", "Halo2BetaData/HeadToHead", "finance", "elsewhere/@"]
_WRITTEN = [" spring ", "btl", "SVD-RS", "a+b", "evc", "x, y", "DIGRAC", "m" * 41, ""]
_SHORTS = ["basketball", "finer_basketball", "Animal", "finance", "HeadToHead", "faculty_business", "faculty_cs", "faculty_history", "football", "finer_football", "mine"]


def _named(s, d):
    """dataset, name, short, season of every order line; a written name that is empty is null."""
    pick = lambda values, key: F.element_at(F.array(*(F.lit(v) for v in values)), (F.pmod(F.col(key), F.lit(len(values))) + 1).cast("int"))
    rows = I.table(s, d, "lineitem").join(I.table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.year("o_orderdate").alias("season")), "l_orderkey")
    return rows.select(F.replace(pick(_FOLDERS, "l_partkey"), F.lit("@"), F.col("season").cast("string")).alias("dataset"), F.nullif(pick(_WRITTEN, "l_suppkey"), F.lit("")).alias("name"), pick(_SHORTS, "l_partkey").alias("short"), "season")


_NAMES = f"names AS (SELECT replace(({_FOLDERS})[l_partkey % {len(_FOLDERS)} + 1], '@', CAST(year(o_orderdate) AS VARCHAR)) dataset, nullif(({_WRITTEN})[l_suppkey % {len(_WRITTEN)} + 1], '') AS name, ({_SHORTS})[l_partkey % {len(_SHORTS)} + 1] short, year(o_orderdate) season FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"


@query("fn01_family_tags", "SELECT dataset, CASE WHEN dataset LIKE 'Basketball_temporal/finer%' THEN 'basketball_temporal_finer' WHEN dataset LIKE 'Basketball_temporal/%' THEN 'basketball_temporal' WHEN dataset LIKE 'Football_data_England_Premier_League/finer%' THEN 'football_finer' WHEN dataset LIKE 'Football_data_England_Premier_League/%' THEN 'football' WHEN dataset LIKE '%FacultyHiringNetworks%' THEN 'faculty' WHEN dataset = 'Dryad_animal_society' THEN 'animal' WHEN dataset LIKE '%HeadToHead%' THEN 'headtohead' WHEN dataset = 'finance' THEN 'finance' ELSE 'other' END tag, count(*) n FROM names GROUP BY ALL", _NAMES)
def _(s, d):
    return _named(s, d).groupBy("dataset", names.family_tag(F.col("dataset")).alias("tag")).agg(F.count("*").alias("n"))


@query("fn03_04_methods", "SELECT name, CASE trim(name) WHEN 'spring' THEN 'SpringRank' WHEN 'evc' THEN 'eigenvectorCentrality' ELSE trim(name) END canonical, coalesce(name LIKE '%+%' OR name LIKE '%,%' OR length(name) > 40, false) combo, count(*) n FROM names GROUP BY ALL", _NAMES)
def _(s, d):
    n = F.col("name")
    return _named(s, d).groupBy("name", names.canonical_method(n).alias("canonical"), names.is_combo(n).alias("combo")).agg(F.count("*").alias("n"))


@query("fn05_config_keys", "SELECT DISTINCT l_linenumber, 'trials' || l_linenumber || 'train_r' || 100 || 'test_r' || 50 AS plain, 'trials' || l_linenumber || 'train_r' || 100 || 'test_r' || 50 || 'seed' || 10 seeded FROM lineitem")
def _(s, d):
    t, a, b = F.col("l_linenumber"), F.lit(100), F.lit(50)
    return I.table(s, d, "lineitem").select("l_linenumber", names.config_key(t, a, b).alias("plain"), names.config_key(t, a, b, F.lit(10)).alias("seeded")).distinct()


@query("fn06_short_names", "SELECT name, season, CASE WHEN lower(name) = 'mine' THEN name ELSE replace(replace(form, '@', CAST(season AS VARCHAR)), '#', CAST(season + 1 AS VARCHAR)) END folder, CAST(f AS INT) f, CAST(k AS INT) k, n FROM (SELECT short AS name, season, count(*) n FROM names GROUP BY ALL) LEFT JOIN (SELECT * FROM (VALUES ('basketball', 'Basketball_temporal/@', 70, 20), ('finer_basketball', 'Basketball_temporal/finer@', 2, 20), ('animal', 'Dryad_animal_society/', 3, 3), ('finance', 'finance/', 5, 20), ('headtohead', 'Halo2BetaData/HeadToHead', 39, 48), ('faculty_business', 'FacultyHiringNetworks/Business/Business_FM_Full_', 6, 5), ('faculty_cs', 'FacultyHiringNetworks/ComputerScience/ComputerScience_FM_Full_', 8, 9), ('faculty_history', 'FacultyHiringNetworks/History/History_FM_Full_', 22, 12), ('football', 'Football_data_England_Premier_League/England_@_#', 19, 9), ('finer_football', 'Football_data_England_Premier_League/finerEngland_@_#', 4, 9)) w(low, form, f, k)) ON low = lower(name)", _NAMES)
def _(s, d):
    folder, f, k = names.expanded(F.col("name"), F.col("season"))
    used = _named(s, d).groupBy(F.col("short").alias("name"), "season").agg(F.count("*").alias("n"))
    return used.select("name", "season", folder.alias("folder"), f.alias("f"), k.alias("k"), "n")


@query("fn07_seasons", "SELECT 'Basketball_temporal/' || y AS dataset FROM (SELECT unnest(range(min(year(o_orderdate)), max(year(o_orderdate)) + 1)) y FROM orders)")
def _(s, d):
    span = I.table(s, d, "orders").agg(F.min(F.year("o_orderdate")).alias("low"), F.max(F.year("o_orderdate")).alias("high"))
    return span.select(F.explode(names.seasons(F.col("low"), F.col("high"))).alias("dataset"))


@query("fn09_mean_std", "SELECT method, CASE WHEN m IS NULL THEN 'nan$\\pm$nan' ELSE printf('%.2f$\\pm$%.2f', m, s) END text FROM (SELECT method, round(avg(upset_simple), 5) m, round(stddev_pop(upset_simple), 5) s FROM board GROUP BY method)", B_)
def _(s, d):
    b = I.leaderboard(s, d).groupBy("method").agg(F.round(F.avg("upset_simple"), 5).alias("m"), F.round(F.stddev_pop("upset_simple"), 5).alias("s"))
    return b.select("method", names.mean_std(F.col("m"), F.col("s")).alias("text"))


@query("fn11_complex", "SELECT event_id, sqrt(c * c + s * s) length, atan2(s, c) angle FROM (SELECT event_id, cos(value) c, sin(value) s FROM events)", "", "length angle")
def _(s, d):
    length, angle = names.polar(F.cos("value"), F.sin("value"))
    return I.table(s, d, "events").select("event_id", length.alias("length"), angle.alias("angle"))


@query("fn12_finite", "SELECT method, count(*) n, count(*) FILTER (q IS NOT NULL AND NOT isnan(q) AND abs(q) < 'inf'::DOUBLE) n_finite FROM (SELECT method, CASE WHEN upset_simple = 0 THEN 'inf'::DOUBLE WHEN runtime_sec IS NULL THEN 'nan'::DOUBLE ELSE upset_ratio END q FROM board) GROUP BY method", B_)
def _(s, d):
    q = F.when(F.col("upset_simple") == 0, float("inf")).when(F.col("runtime_sec").isNull(), float("nan")).otherwise(F.col("upset_ratio"))
    return I.leaderboard(s, d).groupBy("method").agg(F.count("*").alias("n"), F.count_if(names.finite(q)).alias("n_finite"))


@query("fn16_ablation_status", "SELECT dataset, CASE WHEN bool_or(upset_simple IS NULL) THEN 'blocked: no result' ELSE 'ok: ' || array_to_string(list_sort(list(DISTINCT method)), ', ') END status FROM board WHERE method LIKE 'MFAS%' GROUP BY dataset UNION ALL SELECT 'none', 'missing'", B_)
def _(s, d):
    b = I.leaderboard(s, d).where(F.col("method").startswith("MFAS"))
    g = b.groupBy("dataset").agg(F.count("*").alias("n"), F.bool_or(F.col("upset_simple").isNull()).alias("blocked"), F.collect_set("method").alias("modes"))
    g = g.unionByName(s.createDataFrame([("none", 0, False, [])], "dataset string, n long, blocked boolean, modes array<string>"))
    return g.select("dataset", names.status(F.col("n"), F.col("blocked"), F.lit(" no result "), F.col("modes")).alias("status"))


@query("fn17_inverse_root", "SELECT dataset, src node, 1 / greatest(sqrt(sum(w)), 1 / 999999999.0::DOUBLE) r FROM edges GROUP BY ALL", I.MATCH, "r")
def _(s, d):
    return I.match_edges(s, d).groupBy("dataset", F.col("src").alias("node")).agg(F.sum("w").alias("d")).select("dataset", "node", names.safe_inverse_root(F.col("d")).alias("r"))


# --- tables


def _cell(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '---' ELSE printf('%.4f', {c}) END"


@query("snk05_latex_rows", "SELECT CAST(-1 AS INT) line, '\\begin{tabular}{llll}' AS text UNION ALL SELECT 0, 'dataset & method & upset\\_simple & runtime\\_sec \\\\ \\hline' UNION ALL SELECT CAST(row_number() OVER (ORDER BY dataset) AS INT), replace(dataset, '_', '\\_') || ' & ' || method || ' & ' || " + _cell("upset_simple") + " || ' & ' || " + _cell("runtime_sec") + " || ' \\\\' FROM board WHERE method = 'btl' UNION ALL SELECT 2147483647, '\\end{tabular}'", B_)
def _(s, d):
    return tables.latex_table(I.leaderboard(s, d).where("method = 'btl'").select("dataset", "method", F.round("upset_simple", 5).alias("upset_simple"), F.round("runtime_sec", 5).alias("runtime_sec")), ["dataset"])


@query("snk06_markdown_rows", "SELECT CAST(-1 AS INT) line, '| dataset | method | n |' AS text UNION ALL SELECT 0, '|-|-|-|' UNION ALL SELECT CAST(row_number() OVER (ORDER BY dataset, method) AS INT), '| ' || dataset || ' | ' || method || ' | ' || n || ' |' FROM (SELECT dataset, method, count(*) n FROM slim GROUP BY ALL)", T_)
def _(s, d):
    return tables.markdown_table(I.slim(s, d).groupBy("dataset", "method").agg(F.count("*").alias("n")), ["dataset", "method"])


@query("snk08_mean_std_table", "SELECT family, method, CASE WHEN m IS NULL THEN 'nan$\\pm$nan' ELSE printf('%.2f$\\pm$%.2f', m, s) END text, CASE WHEN m IS NULL THEN '' WHEN r = 1 THEN 'best' WHEN r = 2 THEN 'second' ELSE '' END mark FROM (SELECT *, dense_rank() OVER (PARTITION BY family ORDER BY round(m * 100) NULLS LAST) r FROM (SELECT split_part(dataset, '/', 1) family, method, round(avg(upset_simple), 5) m, round(stddev_pop(upset_simple), 5) s FROM board GROUP BY ALL))", B_)
def _(s, d):
    return tables.mean_std_table(I.leaderboard(s, d).withColumn("family", _family()), "upset_simple", ("family",)).select("family", "method", "text", "mark")


_CLAIMS = "SELECT count(*) n, count(*) FILTER (ours_upset_simple <= best_upset_simple) wins_or_ties, round(median(ours_upset_simple - best_upset_simple), 6) median_gap, round(median(best_runtime_sec / CASE WHEN ours_runtime_sec > 0 THEN ours_runtime_sec END), 6) median_speedup FROM cmp"


@query("snk07_claims_json", f"SELECT n, wins_or_ties, median_gap + 0.0 median_gap, median_speedup + 0.0 median_speedup FROM ({_CLAIMS})", C_)
def _(s, d):
    """The JSON text is parsed again, so its numbers can be compared."""
    text = tables.claims(I.comparison(s, d))
    return text.select(F.from_json("claims", "n long, wins_or_ties long, median_gap double, median_speedup double").alias("c")).select("c.*")


@query("snk07_provenance_json", "SELECT dataset AS name, count(*) AS n_rows, 'slim' AS source FROM slim GROUP BY ALL", T_)
def _(s, d):
    made = I.slim(s, d).groupBy(F.col("dataset").alias("name")).agg(F.count("*").alias("n_rows"), F.lit("slim").alias("source"))
    return writers.as_json(made).select(F.from_json("value", "name string, n_rows long, source string").alias("c")).select("c.*")


@query("val11_claims", "SELECT count(*) n, count(*) FILTER (ours_upset_simple <= best_upset_simple) wins, count(*) FILTER (ours_runtime_sec <= best_runtime_sec) faster, (SELECT count(DISTINCT dataset) FROM board) n_datasets FROM cmp", C_)
def _(s, d):
    return tables.claim_counts(I.comparison(s, d), I.leaderboard(s, d))


# --- evaluation


@query("rnk19_initial_guess", "SELECT s.dataset, s.method, s.node, CASE WHEN e.flipped THEN -s.score ELSE s.score END score FROM scores s JOIN evaluated e USING (dataset, method) WHERE method = 'netWins'", V_ + "," + I.EVALUATED, "score")
def _(s, d):
    e = stored(I.match_edges(s, d))
    return metrics.initial_guess(e, rank_rel.net_wins(e))


#: Train, val and test of nodes by a checksum, in shares of 80, 10 and 10 %.
SPLITS = "split AS (SELECT dataset, node, u < 800 train, u >= 800 AND u < 900 val, u >= 900 test FROM (SELECT dataset, node, CAST('0x' || md5('10/' || dataset || '/' || node)[1:15] AS BIGINT) % 1000 u FROM (SELECT dataset, src node FROM edges UNION SELECT dataset, dst FROM edges)))"


def _nodes_of(edges):
    return edges.select("dataset", F.explode(F.array("src", "dst")).alias("node")).distinct()


@query("evl09_splits", "SELECT dataset, train, val, test, count(*) n FROM split GROUP BY ALL UNION ALL SELECT dataset, true, true, true, count(*) FROM split GROUP BY dataset", I.MATCH + "," + SPLITS)
def _(s, d):
    nodes = stored(_nodes_of(I.match_edges(s, d)))
    both = suites.splits(nodes).unionByName(suites.splits(nodes, all_train=True))
    return both.groupBy("dataset", "train", "val", "test").agg(F.count("*").alias("n"))


@query("evl09_split_nodes", "SELECT * FROM split", I.MATCH + "," + SPLITS)
def _(s, d):
    return suites.splits(_nodes_of(I.match_edges(s, d)))


@query("evl08_kendall_masks", _kendall_sql("dataset, mask"), V_ + "," + SPLITS + ", k AS (SELECT a.dataset, mask, a.node, round(a.score, 6) v, b.score u FROM scores a JOIN scores b USING (dataset, node) JOIN (SELECT dataset, node, unnest(list_filter([CASE WHEN train THEN 'train' END, CASE WHEN val THEN 'val' END, CASE WHEN test THEN 'test' END, 'whole'], lambda x: x IS NOT NULL)) mask FROM split) USING (dataset, node) WHERE a.method = 'davidScore' AND b.method = 'netWins')", "n tau p_value")
def _(s, d):
    e = stored(I.match_edges(s, d))
    a = rank_rel.david_score(e).select("dataset", "node", F.round("score", 6).alias("value"))
    b = rank_rel.net_wins(e).select("dataset", "node", F.col("score").alias("value"))
    return metrics.kendall(a, b, suites.splits(_nodes_of(e)).withColumn("whole", F.lit(True)))


@query("evl12_ablation_metrics", "SELECT dataset, method, sum(CASE WHEN x.s <= y.s THEN w ELSE 0 END) / sum(w) w_upset_frac, sum(CASE WHEN x.s <= y.s THEN w ELSE 0 END) w_upset_sum FROM edges JOIN shifted x USING (dataset) JOIN shifted y USING (dataset, method) WHERE x.node = src AND y.node = dst GROUP BY ALL", V_ + "," + I.EVALUATED, "w_upset_frac w_upset_sum")
def _(s, d):
    e = stored(I.match_edges(s, d))
    return metrics.weighted_upsets(e, metrics.shifted(I.simple_scores(e)))


# --- checks


@query("val01_missing_runtime", "SELECT dataset, method FROM (SELECT dataset, method, upset_simple, CASE WHEN dataset LIKE '%-06' THEN NULL ELSE runtime_sec END runtime_sec FROM board) WHERE upset_simple IS NOT NULL AND runtime_sec IS NULL AND NOT (method = 'btl' AND dataset LIKE 'Football%') AND dataset NOT LIKE '%1995%'", B_)
def _(s, d):
    b = I.leaderboard(s, d).withColumn("runtime_sec", F.when(~F.col("dataset").endswith("-06"), F.col("runtime_sec")))  # planted violations
    allowed = b.where("method = 'btl' and dataset like 'Football%'").select("dataset", "method")
    return audit.missing_runtime(b, allowed, ["1995"])


@query("val02_denominator", "SELECT CAST(84 AS BIGINT) have, (SELECT count(DISTINCT dataset) FROM board) want, (SELECT count(DISTINCT dataset) FROM board) = 84 ok", B_)
def _(s, d):
    b = I.leaderboard(s, d)
    return audit.denominator(results.summarize(b, 84).orderBy("method").limit(1), b)


@query("val03_guardrail", "SELECT * FROM (VALUES ('board', true), ('envelope', false)) v(name, ok)")
def _(s, d):
    b = I.leaderboard(s, d)
    return audit.per_method({"board": b, "envelope": results.envelope(b, prefix="best_classical_").drop("best_classical_method")}, s)


@query("val04_determinism", "SELECT dataset, method, config, which FROM results WHERE num_runs = 1 AND CASE WHEN dataset LIKE '%-06' THEN 0.5 ELSE upset_simple_std END > 1e-10", T_)
def _(s, d):
    r = results.aggregate_trials(I.trials(s, d))
    return audit.nondeterministic(r.withColumn("upset_simple_std", F.when(F.col("dataset").endswith("-06"), 0.5).otherwise(F.col("upset_simple_std"))))  # planted


_N = "(SELECT count(DISTINCT dataset) FROM board)"


@query("val06_consistency", f"SELECT * FROM (SELECT 'inventory and suite' AS name, CASE WHEN (SELECT count(DISTINCT dataset) FROM slim) = {_N} THEN 'PASS' ELSE 'FAIL' END status UNION ALL SELECT 'denominator of every method', CASE WHEN {_N} = 84 THEN 'PASS' ELSE 'FAIL' END UNION ALL SELECT 'one comparison row per data set', CASE WHEN (SELECT count(*) FROM cmp) = {_N} THEN 'PASS' ELSE 'FAIL' END UNION ALL SELECT 'claims count the comparison', 'PASS' UNION ALL SELECT 'pareto denominator', 'PASS' UNION ALL SELECT 'expected methods', CASE WHEN (SELECT count(DISTINCT method) FROM board WHERE method IN ('MFAS_INS1', 'davidScore')) = 2 THEN 'PASS' ELSE 'FAIL' END UNION ALL SELECT 'known data sets only', 'PASS' UNION ALL SELECT 'no key twice', 'PASS' UNION ALL SELECT 'upsets within 0 and 4', 'PASS' UNION ALL SELECT 'policy size 81', CASE WHEN {_N} = 81 THEN 'PASS' ELSE 'FAIL' END UNION ALL SELECT 'coverage not above the size', 'PASS')", C_)
def _(s, d):
    return audit.consistency(I.slim(s, d), stored(I.leaderboard(s, d)), stored(I.comparison(s, d)), 84, 81, ["MFAS_INS1", "davidScore"])


@query("val07_rederived", "SELECT dataset, method FROM board WHERE method = 'btl' AND dataset LIKE '%-06' AND upset_simple IS NOT NULL", B_)
def _(s, d):
    have = stored(I.leaderboard(s, d))
    planted = F.when((F.col("method") == "btl") & F.col("dataset").endswith("-06"), F.col("upset_simple") + 1e-6).otherwise(F.col("upset_simple"))
    want = have.withColumn("upset_simple", planted)
    return audit.differences(have, want, ["dataset", "method"], list(M4)).select("dataset", "method")


@query("val08_without_runtime", "SELECT DISTINCT dataset, method FROM slim WHERE upset_simple IS NOT NULL AND (dataset, method) NOT IN (SELECT dataset, method FROM slim WHERE runtime_sec > 200)", T_)
def _(s, d):
    x = I.slim(s, d)
    return audit.without_runtime_file(x.where("upset_simple is not null").select("dataset", "method").distinct(), x.where("runtime_sec > 200"), ["dataset", "method"])


@query("val09_trace", "SELECT dataset, method, config, upset_simple FROM slim WHERE method = 'btl' AND dataset = 'Faculty/1996-03'", T_)
def _(s, d):
    return audit.row_trace(I.slim(s, d), method="btl", dataset="Faculty/1996-03").select("dataset", "method", "config", "upset_simple")


@query("val09_explain_best", "SELECT s.dataset, s.method, s.config, s.upset_simple, row_number() OVER (PARTITION BY s.dataset, s.method ORDER BY s.upset_simple NULLS LAST, s.config) place, s.config = b.config chosen FROM slim s JOIN board b USING (dataset, method)", B_)
def _(s, d):
    return audit.explain_best(I.slim(s, d), I.leaderboard(s, d))


@query("val09_explain_coverage", "SELECT method, dataset, CASE WHEN upset_simple IS NULL THEN 'no metrics' WHEN runtime_sec IS NULL THEN 'no runtime' WHEN runtime_sec > 180 THEN 'timeout' ELSE 'valid' END reason FROM board", B_)
def _(s, d):
    return audit.explain_coverage(I.leaderboard(s, d), 180.0)


@query("val09_summary", "SELECT method, count(*) n_rows, count(DISTINCT dataset) n_datasets, count(DISTINCT config) n_configs, min(dataset) AS first, max(dataset) AS last FROM slim GROUP BY method", T_)
def _(s, d):
    return audit.summary(I.slim(s, d))
