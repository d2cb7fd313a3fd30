"""Rankers as relational plans. Each takes edges and gives dataset, method, node, score (larger is better)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palio.operators import graph
from palio.operators.iterate import is_small, stored


def _ends(edges: DataFrame) -> DataFrame:
    """dataset, node, w, out (1 at the winner's end, 0 at the loser's)."""
    e = F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("out")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("out")))
    return edges.select("dataset", "w", F.explode(e).alias("e")).select("dataset", "e.node", "e.out", "w")


def _named(df: DataFrame, method: str) -> DataFrame:
    return df.select("dataset", F.lit(method).alias("method"), "node", F.col("score").cast("double").alias("score"))


def _won_lost(edges: DataFrame) -> DataFrame:
    won = F.sum(F.when(F.col("out") == 1, F.col("w")).otherwise(0.0))
    return _ends(edges).groupBy("dataset", "node").agg(won.alias("won"), F.sum(F.when(F.col("out") == 0, F.col("w")).otherwise(0.0)).alias("lost"))


#: Scores that follow from the weights won and lost.
_SIMPLE = {"netWins": "won - lost", "winRatio": "coalesce(try_divide(won, won + lost), 0.0)", "outWeight": "won"}


def simple(edges: DataFrame, methods: tuple[str, ...] = tuple(_SIMPLE)) -> DataFrame:
    """Several simple scores from one pass over the edges."""
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("method"), F.expr(_SIMPLE[m]).cast("double").alias("score")) for m in methods)))
    return _won_lost(edges).select("dataset", "node", each.alias("e")).select("dataset", "e.method", "node", "e.score")


def net_wins(edges: DataFrame) -> DataFrame:
    return simple(edges, ("netWins",))


def win_ratio(edges: DataFrame) -> DataFrame:
    return simple(edges, ("winRatio",))


def out_weight(edges: DataFrame) -> DataFrame:
    return simple(edges, ("outWeight",))


def david_score(edges: DataFrame) -> DataFrame:
    """w + P w - l - P^T l with P = A / (A + A^T), w and l its row and column sums."""
    share = F.try_divide(F.col("a"), F.col("a") + F.col("b"))
    p = graph.pairs(edges).where("a + b <> 0").withColumn("p", share)
    both = F.array(F.struct("i", "j", F.col("p").alias("p"), (1 - F.col("p")).alias("q")), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), (1 - F.col("p")).alias("p"), F.col("p").alias("q")))
    rows = p.select("dataset", F.explode(both).alias("e")).select("dataset", "e.i", "e.j", "e.p", "e.q")
    sums = rows.groupBy("dataset", "i").agg(F.sum("p").alias("w"), F.sum("q").alias("l"))
    rival = sums.select("dataset", F.col("i").alias("j"), F.col("w").alias("wj"), F.col("l").alias("lj"))
    # row i of P times w, and column i of P (q is its entry at j) times l
    second = rows.join(rival, ["dataset", "j"]).groupBy("dataset", "i").agg(F.sum(F.col("p") * F.col("wj")).alias("w2"), F.sum(F.col("q") * F.col("lj")).alias("l2"))
    out = sums.join(second, ["dataset", "i"])
    return _named(out.select("dataset", F.col("i").alias("node"), (F.col("w") + F.col("w2") - F.col("l") - F.col("l2")).alias("score")), "davidScore")


def _scaled(now: DataFrame, total: Column) -> DataFrame:
    """A stored node table with ``v``, its ``x`` over the data set's ``total``: an aggregate with a row per data set, joined back."""
    whole = now.groupBy("dataset").agg(total.alias("_total"))
    return now.join(whole, "dataset").withColumn("v", F.col("x") / F.col("_total")).drop("_total")


def page_rank(edges: DataFrame, damping: float = 0.8, tolerance: float = 1e-12, rounds: int = 200) -> DataFrame:
    """Score flows from losers to winners along column-normalised weights; L1-normalised each round.

    Runs until the largest L2 change of any dataset is within ``tolerance``, or ``rounds``. A round joins the edges
    with the scores at their losers, without a shuffle of edges while the node table is small, and writes its node
    table: the next round reads it twice, so it must not be recomputed.
    """
    e = graph.summed(edges)
    lost = e.groupBy("dataset", "dst").agg(F.sum("w").alias("_all"))
    m = stored(e.join(lost, ["dataset", "dst"]).select("dataset", "src", "dst", F.coalesce(F.try_divide("w", "_all"), F.lit(0.0)).alias("m")))
    nodes = stored(edges.select("dataset", F.explode(F.array("src", "dst")).alias("node")).distinct())
    n = nodes.groupBy("dataset").agg(F.count("*").cast("double").alias("n"))
    now = stored(nodes.join(n, "dataset").select("dataset", "node", "n", F.lit(1.0).alias("x"), F.lit(0.0).alias("old")))
    near = is_small(nodes)
    for _ in range(rounds):
        whole = now.groupBy("dataset").agg(F.sum("x").alias("all"))  # a row per data set; Spark broadcasts it by its size
        side = now.select("dataset", F.col("node").alias("dst"), F.col("x").alias("v"))
        got = m.join(F.broadcast(side) if near else side, ["dataset", "dst"]).groupBy("dataset", F.col("src").alias("node")).agg(F.sum(F.col("m") * F.col("v")).alias("in"))
        got = F.broadcast(got) if near else got
        x = damping * F.coalesce("in", F.lit(0.0)) / F.col("all") + (1 - damping) / F.col("n")
        now = stored(now.join(got, ["dataset", "node"], "left").join(whole, "dataset").select("dataset", "node", "n", x.alias("x"), (F.col("x") / F.col("all")).alias("old")))
        if tolerance > 0:
            gap = _scaled(now, F.sum("x")).groupBy("dataset").agg(F.sqrt(F.sum(F.pow(F.col("v") - F.col("old"), 2))).alias("g")).agg(F.max("g")).first()[0]
            if gap is None or gap <= tolerance:
                break
    return _named(_scaled(now, F.sum("x")).select("dataset", "node", F.col("v").alias("score")), "PageRank")


def power_centrality(edges: DataFrame, rounds: int = 200, tolerance: float = 1e-12, shift: float = 1e-6) -> DataFrame:
    """Dominant right eigenvector of A + shift (every entry) by power iteration, of unit length and positive."""
    e = stored(graph.summed(edges))
    length = F.sqrt(F.sum(F.col("x") * F.col("x")))
    nodes = edges.select("dataset", F.explode(F.array("src", "dst")).alias("node")).distinct()
    now = stored(nodes.select("dataset", "node", F.lit(1.0).alias("x"), F.lit(0.0).alias("old")))
    near = is_small(now)
    for _ in range(rounds):
        v = _scaled(now, length)
        side = v.select("dataset", F.col("node").alias("dst"), "v")
        side = F.broadcast(side) if near else side
        got = e.join(side, ["dataset", "dst"]).groupBy("dataset", F.col("src").alias("node")).agg(F.sum(F.col("w") * F.col("v")).alias("in"))
        every = v.groupBy("dataset").agg(F.sum("v").alias("all"))
        x = F.coalesce("in", F.lit(0.0)) + shift * F.col("all")
        now = stored(v.join(every, "dataset").join(got, ["dataset", "node"], "left").select("dataset", "node", x.alias("x"), F.col("v").alias("old")))
        gap = _scaled(now, length).agg(F.max(F.abs(F.col("v") - F.col("old")))).first()[0]
        if gap is None or gap <= tolerance:
            break
    return _named(_scaled(now, length).select("dataset", "node", F.col("v").alias("score")), "eigenvectorCentrality")


def bradley_terry_steps(edges: DataFrame, rounds: int = 3) -> DataFrame:
    """Bradley-Terry strengths after some Jacobi minorisation-maximisation rounds from equal strengths, L1-normalised each round."""
    p = graph.pairs(edges).where("a + b <> 0")
    both = F.array(F.struct("i", "j", (F.col("a") + F.col("b")).alias("n"), F.col("a").alias("won")), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), (F.col("a") + F.col("b")).alias("n"), F.col("b").alias("won")))
    games = stored(p.select("dataset", F.explode(both).alias("e")).select("dataset", "e.i", "e.j", "e.n", "e.won"))
    now = stored(games.groupBy("dataset", "i").agg(F.sum("won").alias("wins"), F.lit(1.0).alias("x")))
    near = is_small(now)
    for _ in range(rounds):
        v = _scaled(now, F.sum("x"))
        own, rival = v.select("dataset", "i", F.col("v").alias("g")), v.select("dataset", F.col("i").alias("j"), F.col("v").alias("gj"))
        own, rival = (F.broadcast(own), F.broadcast(rival)) if near else (own, rival)
        part = games.join(own, ["dataset", "i"]).join(rival, ["dataset", "j"]).groupBy("dataset", "i").agg(F.sum(F.col("n") / (F.col("g") + F.col("gj"))).alias("d"))
        now = stored(now.join(part, ["dataset", "i"]).select("dataset", "i", "wins", ((F.col("wins") + 1e-6) / F.col("d")).alias("x")))
    return _named(_scaled(now, F.sum("x")).select("dataset", F.col("i").alias("node"), F.col("v").alias("score")), "btlJacobi")


def serial_similarity(edges: DataFrame, compat: bool = True) -> DataFrame:
    """S = C C^T / 2 with C the sign of A^T - A; n / 2 is added to entries that aren't zero (``compat``) or to all pairs that share a rival."""
    c = graph.skew(edges).select("dataset", F.col("i").alias("src"), F.col("j").alias("dst"), (-F.signum("m")).alias("w"))
    s = graph.products(c, graph.transposed(c)).withColumn("w", F.col("w") / 2)
    n = c.select("dataset", "src").distinct().groupBy("dataset").agg(F.count("*").alias("n"))  # a row per data set; Spark broadcasts it by its size
    if compat:
        s = s.where("w <> 0")
    return s.join(n, "dataset").select("dataset", "src", "dst", (F.col("w") + F.col("n") / 2).alias("w"))


def from_order(order: DataFrame) -> DataFrame:
    """Scores max(1, n - position) of an order (dataset, method, node, position from 0)."""
    n = F.count("*").over(Window.partitionBy("dataset", "method"))
    return order.select("dataset", "method", "node", F.greatest(F.lit(1), n - F.col("position")).cast("double").alias("score"))
