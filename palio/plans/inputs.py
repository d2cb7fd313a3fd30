"""Comparison graphs and result tables derived from the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palio.operators import graph, rank_rel


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def matches(spark: SparkSession, sf_dir: str, period: str = "yyyy") -> DataFrame:
    """The wins that ``match_edges`` adds up: a row for each order and pair of its lines with different suppliers and quantities.

    Lines are gathered per order in one shuffle (an order has a handful of lines), pairs made in the row.
    """
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_suppkey").alias("s"), F.col("l_quantity").alias("q"))).alias("ls"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.date_format("o_orderdate", period).alias("dataset"))
    one = lines.join(orders, "l_orderkey").select("dataset", "ls", F.explode("ls").alias("a")).select("dataset", "a", F.explode("ls").alias("b"))
    won = one.where((F.col("a.s") != F.col("b.s")) & (F.col("a.q") > F.col("b.q")))
    return won.select("dataset", F.col("a.s").alias("src"), F.col("b.s").alias("dst"), (F.col("a.q") - F.col("b.q")).alias("w"))


def match_edges(spark: SparkSession, sf_dir: str, period: str = "yyyy") -> DataFrame:
    """Suppliers that meet in one order; the larger quantity wins by the difference. One graph per year, or other period."""
    return graph.summed(matches(spark, sf_dir, period))


MATCH = """
ln AS (SELECT l_orderkey k, l_suppkey s, l_quantity q FROM lineitem),
edges AS (SELECT CAST(year(o_orderdate) AS VARCHAR) dataset, a.s src, b.s dst, sum(a.q - b.q) w
  FROM ln a JOIN ln b ON a.k = b.k AND a.s <> b.s AND a.q > b.q JOIN orders ON o_orderkey = a.k GROUP BY ALL)"""


def finer_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both suppliers of a pair in an order, by their quantity plus 0.1."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_suppkey").alias("s"), F.col("l_quantity").alias("q"))).alias("ls"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.year("o_orderdate").cast("string").alias("dataset"))
    one = lines.join(orders, "l_orderkey").select("dataset", "ls", F.explode("ls").alias("a")).select("dataset", "a", F.explode("ls").alias("b")).where(F.col("a.s") != F.col("b.s"))
    # sums of quantities are exact; the bonus is added per meeting
    pair = one.groupBy("dataset", F.col("a.s").alias("src"), F.col("b.s").alias("dst")).agg(F.sum("a.q").alias("q"), F.count("*").alias("c"))
    return pair.select("dataset", "src", "dst", (F.col("q") + F.col("c") * F.lit(0.1)).alias("w"))


FINER = """
ln AS (SELECT l_orderkey k, l_suppkey s, l_quantity q FROM lineitem),
edges AS (SELECT CAST(year(o_orderdate) AS VARCHAR) dataset, a.s src, b.s dst, sum(a.q) + count(*) * 0.1::DOUBLE w
  FROM ln a JOIN ln b ON a.k = b.k AND a.s <> b.s JOIN orders ON o_orderkey = a.k GROUP BY ALL)"""


def h2h_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of two events in a row; the larger value (in cents) wins by the gap. A row for each game."""
    rows = table(spark, sf_dir, "events").select(F.lit("events").alias("dataset"), F.floor(F.col("event_id") / 2).alias("game"), "event_id", F.col("user_id").alias("player"), F.round(F.col("value") * 100).cast("long").alias("score"))
    return graph.head_to_head(rows, "event_id").withColumn("w", F.col("w").cast("double"))


def h2h_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The games added up by winner and loser."""
    return graph.summed(h2h_games(spark, sf_dir))


H2H = """
ev AS (SELECT event_id // 2 game, event_id, user_id p, CAST(round(value * 100) AS BIGINT) s, row_number() OVER (PARTITION BY event_id // 2 ORDER BY event_id) r FROM events),
edges AS (SELECT 'events' dataset, CASE WHEN a.s > b.s THEN a.p ELSE b.p END src, CASE WHEN a.s > b.s THEN b.p ELSE a.p END dst, CAST(sum(abs(a.s - b.s)) AS DOUBLE) w
  FROM ev a JOIN ev b ON a.game = b.game AND a.r = 1 AND b.r = 2 WHERE a.s <> b.s AND a.p <> b.p GROUP BY ALL)"""

def all_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The yearly graphs of suppliers and the graph of users together, a data set each."""
    return match_edges(spark, sf_dir).unionByName(h2h_edges(spark, sf_dir))


def all_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ``all_edges`` adds up, for operators that add up pairs themselves."""
    return matches(spark, sf_dir).unionByName(h2h_games(spark, sf_dir))


ALL = (MATCH.replace("edges AS (", "match_edges AS (") + "," + H2H.replace("edges AS (", "h2h_edges AS (")).strip() + ", edges AS (SELECT * FROM match_edges UNION ALL SELECT * FROM h2h_edges)"

#: M = A - A^T in 32-bit floats over ordered pairs, and the pairs' sums.
SKEW = """
both_ways AS (SELECT dataset, src i, dst j, w a, 0.0::DOUBLE b FROM edges UNION ALL SELECT dataset, dst, src, 0.0, w FROM edges),
entries AS (SELECT dataset, i, j, sum(a) a, sum(b) b FROM both_ways WHERE i <> j GROUP BY ALL),
m AS (SELECT dataset, i, j, a, b, CAST(a::FLOAT - b::FLOAT AS DOUBLE) m FROM entries WHERE a::FLOAT - b::FLOAT <> 0)"""


def simple_scores(edges: DataFrame) -> DataFrame:
    """Scores of four relational rankers."""
    return rank_rel.simple(edges).unionByName(rank_rel.david_score(edges))


SCORES = """
ends AS (SELECT dataset, src node, w won, 0.0::DOUBLE lost FROM edges UNION ALL SELECT dataset, dst, 0.0, w FROM edges),
tot AS (SELECT dataset, node, sum(won) won, sum(lost) lost FROM ends GROUP BY ALL),
p AS (SELECT dataset, i, j, a / (a + b) p, b / (a + b) q FROM entries WHERE a + b <> 0),
wl AS (SELECT dataset, i, sum(p) w, sum(q) l FROM p GROUP BY ALL),
wl2 AS (SELECT p.dataset, p.i, sum(p.p * o.w) w2, sum(p.q * o.l) l2 FROM p JOIN wl o ON o.dataset = p.dataset AND o.i = p.j GROUP BY ALL),
david AS (SELECT wl.dataset, 'davidScore' AS method, wl.i node, w + w2 - l - l2 score FROM wl JOIN wl2 USING (dataset, i)),
scores AS (SELECT dataset, 'netWins' AS method, node, won - lost score FROM tot
  UNION ALL SELECT dataset, 'winRatio', node, coalesce(won / nullif(won + lost, 0), 0) FROM tot
  UNION ALL SELECT dataset, 'outWeight', node, won FROM tot UNION ALL SELECT * FROM david)"""

#: Shifted scores, both losses and the metrics after orientation.
EVALUATED = """
lows AS (SELECT dataset, method, min(score) lo FROM scores GROUP BY ALL),
shifted AS (SELECT dataset, method, node, CASE WHEN lo >= 0 THEN score WHEN lo > -1 THEN (score + 1) / 2 ELSE 1 / (1 + exp(-score)) END s FROM scores JOIN lows USING (dataset, method)),
sp AS (SELECT m.*, x.method, x.s si, y.s sj FROM m JOIN shifted x ON x.dataset = m.dataset AND x.node = m.i JOIN shifted y ON y.dataset = m.dataset AND y.node = m.j AND y.method = x.method),
loss AS (SELECT dataset, method, avg(pow(m / (a + b + 1e-8) - (si - sj) / (si + sj + 1e-8), 2)) u, avg(pow(-m / (a + b + 1e-8) - (si - sj) / (si + sj + 1e-8), 2)) v,
  avg(pow(sign(si - sj) - sign(m), 2)) su, avg(pow(-sign(si - sj) - sign(m), 2)) sv, avg(CASE WHEN sign(si - sj) <> sign(m) THEN 1.0 ELSE 0.0 END) nu, avg(CASE WHEN -sign(si - sj) <> sign(m) THEN 1.0 ELSE 0.0 END) nv FROM sp GROUP BY ALL),
evaluated AS (SELECT dataset, method, u > v flipped, CASE WHEN u > v THEN sv ELSE su END upset_simple, least(u, v) upset_ratio, CASE WHEN u > v THEN nv ELSE nu END upset_naive FROM loss)"""

#: Method names of the derived trials.
METHODS = ["SpringRank", "davidScore", "PageRank", "btl", "MFAS_INS1", "MFAS_INS2", "MFAS_INS3", "DIGRAC"]


def dataset_of(date):
    """Name of the data set of an order's month."""
    month = F.date_format(date, "yyyy-MM")
    family = F.element_at(F.array(*(F.lit(x) for x in ("Basketball_temporal/", "finerBasketball/", "Football/", "Faculty/"))), (F.pmod(F.substring(month, 6, 2).cast("int"), F.lit(4)) + 1))
    return F.concat(family, month)


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials of eight methods on a data set per month: metrics are remainders of exact sums, some are missing."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), dataset_of(F.col("o_orderdate")).alias("dataset"), "o_custkey")
    rows = items.join(orders, "l_orderkey")
    method = F.element_at(F.array(*(F.lit(m) for m in METHODS)), (F.pmod("l_suppkey", F.lit(8)) + 1).cast("int"))
    config = F.when(F.pmod("l_partkey", F.lit(2)) == 0, "trials10train_r100test_r100").otherwise("trials2train_r100test_r100")
    which = F.when(F.pmod("o_custkey", F.lit(5)) == 0, "upset_latest").otherwise("upset")
    g = rows.groupBy("dataset", method.alias("method"), config.alias("config"), which.alias("which"), F.pmod("l_linenumber", F.lit(3)).alias("trial")).agg(F.sum("l_quantity").cast("long").alias("q"), F.count("*").alias("c"))
    ok = F.pmod(F.col("q") + F.col("c"), F.lit(7)) != 0
    return g.select(
        "dataset", "method", "config", "which", "trial",
        F.when(ok, F.pmod(F.col("q") * 7 + F.col("c") * 13, F.lit(4000)) / 1000).alias("upset_simple"),
        F.when(ok, F.pmod(F.col("q") * 3 + F.col("c"), F.lit(1000)) / 1000).alias("upset_ratio"),
        F.when(ok, F.pmod(F.col("q") * 7 + F.col("c") * 13, F.lit(4000)) / 4000).alias("upset_naive"),
        F.when(F.pmod(F.col("q"), F.lit(5)) != 0, F.pmod(F.col("q") * 11, F.lit(2500)) / 10.0).alias("runtime_sec"),
    )


TRIALS = f"""
raw_trials AS (SELECT (['Basketball_temporal/', 'finerBasketball/', 'Football/', 'Faculty/'])[month(o_orderdate) % 4 + 1] || strftime(o_orderdate, '%Y-%m') dataset,
  ({METHODS})[l_suppkey % 8 + 1] AS method, CASE WHEN l_partkey % 2 = 0 THEN 'trials10train_r100test_r100' ELSE 'trials2train_r100test_r100' END config,
  CASE WHEN o_custkey % 5 = 0 THEN 'upset_latest' ELSE 'upset' END which, l_linenumber % 3 trial, CAST(sum(l_quantity) AS BIGINT) q, count(*) c
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL),
trials AS (SELECT dataset, method, config, which, trial, CASE WHEN (q + c) % 7 <> 0 THEN (q * 7 + c * 13) % 4000 / 1000.0::DOUBLE END upset_simple,
  CASE WHEN (q + c) % 7 <> 0 THEN (q * 3 + c) % 1000 / 1000.0::DOUBLE END upset_ratio, CASE WHEN (q + c) % 7 <> 0 THEN (q * 7 + c * 13) % 4000 / 4000.0::DOUBLE END upset_naive,
  CASE WHEN q % 5 <> 0 THEN q * 11 % 2500 / 10.0::DOUBLE END runtime_sec FROM raw_trials),
results AS (SELECT dataset, method, config, which, avg(upset_simple) upset_simple_mean, stddev_pop(upset_simple) upset_simple_std, avg(upset_ratio) upset_ratio_mean, stddev_pop(upset_ratio) upset_ratio_std,
  avg(upset_naive) upset_naive_mean, stddev_pop(upset_naive) upset_naive_std, avg(runtime_sec) runtime_sec_mean, stddev_pop(runtime_sec) runtime_sec_std, count(*) num_runs,
  CAST(sum((upset_simple IS NULL)::INT + (upset_ratio IS NULL)::INT + (upset_naive IS NULL)::INT) AS BIGINT) num_nans FROM trials GROUP BY ALL),
slim AS (SELECT dataset, method, config, round(upset_simple_mean, 6) upset_simple, round(upset_ratio_mean, 6) upset_ratio, round(upset_naive_mean, 6) upset_naive, round(runtime_sec_mean, 6) runtime_sec FROM results WHERE which = 'upset')"""


def decimal_stats_sql(columns: tuple[str, ...]) -> str:
    """Median and mean of columns of six decimals, half up, in integers."""
    unit = "CAST(round({c} * 1000000) AS BIGINT)"
    mean = "CAST(CAST(2 * sum(" + unit + ") + count({c}) AS BIGINT) // nullif(2 * count({c}), 0) AS DOUBLE) / 1000000"
    return ", ".join(f"floor(median({unit}) + 0.5) / 1000000 median_{{c}}, {mean} mean_{{c}}".format(c=c) for c in columns)


def slim(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palio.operators import results

    s = results.slim(results.aggregate_trials(trials(spark, sf_dir)))
    return s.withColumns({c: F.round(c, 6) for c in ("upset_simple", "upset_ratio", "upset_naive", "runtime_sec")})


def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best configuration per data set and method."""
    from palio.operators import results

    return results.best_config(slim(spark, sf_dir))


def _first(c: str) -> str:
    return f"arg_min({c}, (upset_simple IS NULL, upset_simple, config)) FILTER ({c} IS NOT NULL) {c}"


LEADERBOARD = f"""
board AS (SELECT dataset, method, {", ".join(_first(c) for c in ("config", "upset_simple", "upset_ratio", "upset_naive", "runtime_sec"))} FROM slim GROUP BY ALL)"""

OURS, CLASSICAL = "MFAS_INS3", ["SpringRank", "davidScore", "PageRank", "btl"]


def comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own method against the best classical one per data set: ours_*, best_*."""
    from palio.operators import results

    b = leaderboard(spark, sf_dir)
    ours = b.where(F.col("method") == OURS).select("dataset", *(F.col(c).alias(f"ours_{c}") for c in ("upset_simple", "upset_ratio", "upset_naive", "runtime_sec")))
    return ours.join(results.envelope(b.where(F.col("method").isin(CLASSICAL))), "dataset")


COMPARISON = """
env AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY upset_simple ASC NULLS LAST, method) r FROM board WHERE method IN ('SpringRank', 'davidScore', 'PageRank', 'btl')) WHERE r = 1),
cmp AS (SELECT o.dataset, o.upset_simple ours_upset_simple, o.upset_ratio ours_upset_ratio, o.upset_naive ours_upset_naive, o.runtime_sec ours_runtime_sec, e.method best_method, e.upset_simple best_upset_simple, e.upset_ratio best_upset_ratio, e.upset_naive best_upset_naive, e.runtime_sec best_runtime_sec
  FROM board o JOIN env e ON e.dataset = o.dataset WHERE o.method = 'MFAS_INS3')"""
