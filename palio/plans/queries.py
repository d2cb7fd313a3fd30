"""Queries over derived graphs and result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palio.functions import names
from palio.operators import audit, gnn, graph, metrics, rank_dense, rank_iter, rank_rel, results, spectral, suites, walks
from palio.operators.iterate import small_side, stored
from palio.plans import inputs as I
from palio.plans.registry import query, rounded
from palio.sources import generate

M4 = ("upset_simple", "upset_ratio", "upset_naive", "runtime_sec")


E_, S_, V_ = I.MATCH, I.MATCH + "," + I.SKEW, I.MATCH + "," + I.SKEW + "," + I.SCORES
T_ = I.TRIALS
B_, C_ = I.TRIALS + "," + I.LEADERBOARD, I.TRIALS + "," + I.LEADERBOARD + "," + I.COMPARISON

# --- graphs


@query("prj03_match_edges", "SELECT * FROM edges", E_, "w")
def _(s, d):
    return I.match_edges(s, d)


@query("prj04_finer_edges", "SELECT * FROM edges", I.FINER, "w")
def _(s, d):
    return I.finer_edges(s, d)


@query("prj08_head_to_head", "SELECT * FROM edges", I.H2H, "w")
def _(s, d):
    return I.h2h_edges(s, d)


@query("prj02_symmetrize", "SELECT 'orders' dataset, o_orderkey team, o_custkey rival, l_quantity scored, l_linenumber conceded, 0 side FROM orders JOIN lineitem ON l_orderkey = o_orderkey UNION ALL SELECT 'orders', o_custkey, o_orderkey, l_linenumber, l_quantity, 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey", "", "scored conceded")
def _(s, d):
    m = I.table(s, d, "orders").join(I.table(s, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    return graph.symmetrize(m.select(F.lit("orders").alias("dataset"), F.col("o_orderkey").alias("home"), F.col("o_custkey").alias("away"), F.col("l_quantity").alias("home_goals"), F.col("l_linenumber").cast("double").alias("away_goals")))


@query("prj05_07_weights", "SELECT l_orderkey, l_linenumber, abs(l_quantity - 25) absolute, greatest(l_quantity - 25, 0) clipped, CAST(l_quantity AS FLOAT) single FROM lineitem WHERE l_quantity - 25 <> 0", "", "absolute clipped")
def _(s, d):
    e = I.table(s, d, "lineitem").withColumn("w", F.col("l_quantity") - 25).where("w <> 0")
    e = graph.absolute(e.withColumn("v", F.col("w"))).withColumnRenamed("w", "absolute").withColumnRenamed("v", "w")
    return graph.clipped(e).select("l_orderkey", "l_linenumber", "absolute", F.col("w").alias("clipped"), F.col("l_quantity").cast("float").alias("single"))


@query("grf01_numbered_nodes", "SELECT dataset, name, row_number() OVER (PARTITION BY dataset ORDER BY side, o) - 1 node FROM (SELECT dataset, name, arg_min(side, (side, o)) side, arg_min(o, (side, o)) o FROM (SELECT 'all' dataset, src AS name, 0 side, src * 100000000 + dst o FROM edges UNION ALL SELECT 'all', dst, 1, src * 100000000 + dst FROM edges) GROUP BY ALL)", I.H2H)
def _(s, d):
    e = I.h2h_edges(s, d).withColumn("dataset", F.lit("all")).withColumn("ord", F.col("src") * 100000000 + F.col("dst"))
    return graph.numbered(e)[0]


@query("grf03_asymmetry", "SELECT dataset, sum(abs(a - b)) asymmetry FROM entries GROUP BY dataset", S_, "asymmetry")
def _(s, d):
    return graph.skew_total(I.match_edges(s, d))


_REACH = "RECURSIVE " + I.MATCH.strip() + ", links AS (SELECT dataset, src x, dst y FROM edges UNION SELECT dataset, dst, src FROM edges), reach(dataset, x, y) AS (SELECT dataset, x, x FROM links UNION SELECT r.dataset, r.x, l.y FROM reach r JOIN links l ON l.dataset = r.dataset AND l.x = r.y), comp AS (SELECT dataset, x node, min(y) component FROM reach GROUP BY dataset, x)"


@query("grf04_components", f"WITH {_REACH} SELECT * FROM comp")
def _(s, d):
    return graph.components(I.matches(s, d))  # links needn't be added up


@query("grf04_largest_component", f"WITH {_REACH}, top AS (SELECT dataset, component FROM (SELECT dataset, component, row_number() OVER (PARTITION BY dataset ORDER BY c DESC, component) r FROM (SELECT dataset, component, count(*) c FROM comp GROUP BY dataset, component)) WHERE r = 1) SELECT e.dataset, e.src, e.dst, round(e.w, 6) + 0.0 w FROM edges e JOIN comp c ON c.dataset = e.dataset AND c.node = e.src JOIN top t ON t.dataset = c.dataset AND t.component = c.component")
def _(s, d):
    return graph.largest_component(stored(I.match_edges(s, d)))


_MONTHS = I.MATCH.strip().replace("CAST(year(o_orderdate) AS VARCHAR)", "strftime(o_orderdate, '%Y-%m')")


@query("rnk13b_strong_components", f"WITH RECURSIVE {_MONTHS}, nodes AS (SELECT dataset, src x FROM edges UNION SELECT dataset, dst FROM edges), reach(dataset, x, y) AS (SELECT dataset, x, x FROM nodes UNION SELECT r.dataset, r.x, e.dst FROM reach r JOIN edges e ON e.dataset = r.dataset AND e.src = r.y) SELECT a.dataset, a.x node, min(a.y) component FROM reach a JOIN reach b ON b.dataset = a.dataset AND b.x = a.y AND b.y = a.x GROUP BY ALL")
def _(s, d):
    return graph.strong_components(stored(I.match_edges(s, d, "yyyy-MM")))


def _trim_sql(k: int, rounds: int) -> str:
    out, last = [], "e0"
    for i in range(1, rounds + 1):
        out.append(f"n{i} AS (SELECT dataset, node FROM (SELECT dataset, src node FROM {last} UNION ALL SELECT dataset, dst FROM {last}) GROUP BY ALL HAVING count(*) >= {k}), e{i} AS (SELECT e.* FROM {last} e SEMI JOIN n{i} a ON a.dataset = e.dataset AND a.node = e.src SEMI JOIN n{i} b ON b.dataset = e.dataset AND b.node = e.dst)")
        last = f"e{i}"
    return ", ".join(out)


@query("grf05_trim", "SELECT * FROM e10", I.H2H + ", e0 AS (SELECT * FROM edges)," + _trim_sql(20, 10), "w")
def _(s, d):
    return graph.trim(I.h2h_edges(s, d), 20, 10)


@query("grf06_profile", "SELECT dataset, n, m, m / (n * (n - 1.0::DOUBLE)) density, reciprocal, 100.0::DOUBLE * reciprocal / m reciprocal_percent FROM (SELECT dataset, count(*) m FROM edges GROUP BY ALL) JOIN (SELECT dataset, count(DISTINCT v) n FROM (SELECT dataset, src v FROM edges UNION ALL SELECT dataset, dst FROM edges) GROUP BY ALL) USING (dataset) JOIN (SELECT dataset, count(*) FILTER (a > 0 AND b > 0) reciprocal FROM entries GROUP BY ALL) USING (dataset)", S_, "density reciprocal_percent")
def _(s, d):
    return graph.profile(stored(I.match_edges(s, d)))


@query("grf07_skew", "SELECT dataset, i, j, m FROM m", I.FINER + "," + I.SKEW, "m")
def _(s, d):
    return graph.skew(I.finer_edges(s, d))


@query("grf08_normalized", "SELECT dataset, src, dst, w / (sum(w) OVER (PARTITION BY dataset, src) + 1) w FROM edges", E_, "w")
def _(s, d):
    return graph.normalized(I.match_edges(s, d))


@query("grf09_second_order", "SELECT b.dataset, b.src, b.dst, b.w / sqrt(x.d * y.d) w FROM two b JOIN deg x ON x.node = b.src JOIN deg y ON y.node = b.dst", I.H2H + ", nodes AS (SELECT src node FROM edges UNION SELECT dst FROM edges), al AS (SELECT src, dst, sum(w) w FROM (SELECT src, dst, w FROM edges UNION ALL SELECT node, node, 1.0 FROM nodes) GROUP BY ALL), pp AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) w FROM al), ins AS (SELECT a.dst src, b.dst dst, sum(a.w * b.w) w FROM pp a JOIN pp b ON a.src = b.src GROUP BY ALL), outs AS (SELECT a.src src, b.src dst, sum(a.w * b.w) w FROM pp a JOIN pp b ON a.dst = b.dst GROUP BY ALL), two AS (SELECT 'events' dataset, i.src, i.dst, (i.w + o.w) / 2 w FROM ins i JOIN outs o USING (src, dst)), deg AS (SELECT src node, sum(w) d FROM two GROUP BY ALL)", "w")
def _(s, d):
    return graph.second_order(I.h2h_edges(s, d))


@query("grf10_undirected", "SELECT h.dataset, h.src, h.dst, h.w / sqrt(x.d * y.d) w FROM half h JOIN deg x ON x.node = h.src JOIN deg y ON y.node = h.dst", I.H2H + ", nodes AS (SELECT src node FROM edges UNION SELECT dst FROM edges), half AS (SELECT 'events' dataset, src, dst, sum(w) / 2 w FROM (SELECT src, dst, w FROM edges UNION ALL SELECT dst, src, w FROM edges UNION ALL SELECT node, node, 2.0 FROM nodes) GROUP BY ALL), deg AS (SELECT src node, sum(w) d FROM half GROUP BY ALL)", "w")
def _(s, d):
    return graph.undirected(I.h2h_edges(s, d))


def _walk_sql(rounds: int) -> str:
    """Stationary shares of the walk with self loops that jumps with chance 0.1, by plain rounds, and its symmetric entries."""
    return (
        "RECURSIVE " + I.ALL + ", nn AS (SELECT dataset, src node FROM edges UNION SELECT dataset, dst FROM edges), cnt AS (SELECT dataset, count(*)::DOUBLE n FROM nn GROUP BY ALL), "
        "al AS (SELECT dataset, src, dst, sum(w)::DOUBLE w FROM (SELECT dataset, src, dst, w FROM edges UNION ALL SELECT dataset, node, node, 1.0::DOUBLE FROM nn) GROUP BY ALL), "
        "pm AS MATERIALIZED (SELECT dataset, src, dst, w / sum(w) OVER (PARTITION BY dataset, src) p, n FROM al JOIN cnt USING (dataset)), "
        "v(k, dataset, node, x) AS (SELECT 0, dataset, node, 1 / n FROM nn JOIN cnt USING (dataset) UNION ALL SELECT v.k + 1, v.dataset, pm.dst, 0.9::DOUBLE * sum(v.x * pm.p) + 0.1::DOUBLE / any_value(pm.n) "
        f"FROM v JOIN pm ON pm.dataset = v.dataset AND pm.src = v.node WHERE v.k < {rounds} GROUP BY v.k, v.dataset, pm.dst), "
        f"root AS (SELECT dataset, node, n, sqrt(x) s FROM v JOIN cnt USING (dataset) WHERE k = {rounds}), "
        "half AS (SELECT pm.dataset, src, dst, p * a.s / b.s / 2 w FROM pm JOIN root a ON a.dataset = pm.dataset AND a.node = src JOIN root b ON b.dataset = pm.dataset AND b.node = dst), "
        "lap AS (SELECT dataset, src, dst, sum(w) w FROM (SELECT * FROM half UNION ALL SELECT dataset, dst, src, w FROM half) GROUP BY ALL), "
        "deg AS (SELECT dataset, src node, sum(w) d FROM lap GROUP BY ALL), "
        "jump AS (SELECT dataset, node, n, s, 0.9::DOUBLE * d + 0.1::DOUBLE / n * (s * sum(1 / s) OVER (PARTITION BY dataset) + sum(s) OVER (PARTITION BY dataset) / s) / 2 d FROM root JOIN deg USING (dataset, node))"
    )


@query("grf10_personal_adjacency", "SELECT l.dataset, l.src, l.dst, l.w / sqrt(a.d * b.d) w FROM lap l JOIN deg a ON a.dataset = l.dataset AND a.node = l.src JOIN deg b ON b.dataset = l.dataset AND b.node = l.dst", _walk_sql(200), "w")
def _(s, d):
    return walks.personal_adjacency(stored(I.all_edges(s, d)))


@query("grf10_page_rank_adjacency", "SELECT l.dataset, l.src, l.dst, (0.9::DOUBLE * l.w + 0.1::DOUBLE / a.n * (a.s / b.s + b.s / a.s) / 2) / sqrt(a.d * b.d) w FROM lap l JOIN jump a ON a.dataset = l.dataset AND a.node = l.src JOIN jump b ON b.dataset = l.dataset AND b.node = l.dst", _walk_sql(200), "w")
def _(s, d):
    return walks.page_rank_adjacency(stored(I.all_edges(s, d)))


_FALLS = I.MATCH.strip().replace("edges AS (", "match_edges AS (").replace("CAST(year(o_orderdate) AS VARCHAR)", "strftime(o_orderdate, '%Y-%m')") + "," + I.H2H.replace("edges AS (", "h2h_edges AS (") + ", edges AS (SELECT * FROM match_edges UNION ALL SELECT * FROM h2h_edges), nets AS (SELECT dataset, node, sum(w) net FROM (SELECT dataset, src node, w FROM edges UNION ALL SELECT dataset, dst, -w FROM edges) GROUP BY ALL), falls AS (SELECT e.dataset, e.src, e.dst FROM edges e JOIN nets a ON a.dataset = e.dataset AND a.node = e.src JOIN nets b ON b.dataset = e.dataset AND b.node = e.dst WHERE a.net > b.net OR (a.net = b.net AND a.node < b.node))"


def falling_edges(s: SparkSession, d: str) -> DataFrame:
    """Edges of the monthly graphs and the users' graph that run down in net wins (equal ones: up in id), so they have no cycle."""
    edges = stored(I.match_edges(s, d, "yyyy-MM").unionByName(I.h2h_edges(s, d)))
    net = edges.select("dataset", F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("w").alias("w")), F.struct(F.col("dst").alias("node"), (-F.col("w")).alias("w")))).alias("e"))
    net = small_side(stored(net.groupBy("dataset", "e.node").agg(F.sum("e.w").alias("net"))))
    both = edges.join(net.withColumnsRenamed({"node": "src", "net": "x"}), ["dataset", "src"]).join(net.withColumnsRenamed({"node": "dst", "net": "y"}), ["dataset", "dst"])
    return both.where((F.col("x") > F.col("y")) | ((F.col("x") == F.col("y")) & (F.col("src") < F.col("dst")))).select("dataset", "src", "dst", "w")


@query("rnk13a_topological_layers", f"WITH RECURSIVE {_FALLS}, lay(dataset, node, layer) AS (SELECT dataset, node, 0 FROM (SELECT dataset, src node FROM falls UNION SELECT dataset, dst FROM falls) UNION SELECT l.dataset, f.dst, l.layer + 1 FROM lay l JOIN falls f ON f.dataset = l.dataset AND f.src = l.node) SELECT dataset, node, max(layer) layer FROM lay GROUP BY ALL")
def _(s, d):
    return walks.topological_order(falling_edges(s, d)).drop("position")


@query("rnk13a_topological_order")
def _(s, d):
    return walks.topological_order(falling_edges(s, d))


@query("grf11_hermitian_features")
def _(s, d):
    return rank_iter.hermitian_features(I.all_games(s, d), 2)


@query("grf12_spectral_gaps")
def _(s, d):
    return rank_iter.spectral_gaps(I.all_games(s, d), 8)


@query("grf13_flow", "SELECT g.dataset, g.k, g.l, coalesce(w.w / nullif(coalesce(w.w, 0) + coalesce(v.w, 0), 0), CASE WHEN v.w > 0 THEN 0 ELSE 0.5 END) flow, coalesce(w.w / nullif(coalesce(w.w, 0) + coalesce(v.w, 0), 0), CASE WHEN v.w > 0 THEN 0 ELSE 0.5 END) > 0.55 strong FROM (SELECT DISTINCT a.dataset, a.k, b.k l FROM (SELECT DISTINCT dataset, src % 4 k FROM edges) a JOIN (SELECT DISTINCT dataset, src % 4 k FROM edges) b USING (dataset)) g LEFT JOIN (SELECT dataset, src % 4 k, dst % 4 l, sum(w) w FROM edges GROUP BY ALL) w USING (dataset, k, l) LEFT JOIN (SELECT dataset, dst % 4 k, src % 4 l, sum(w) w FROM edges GROUP BY ALL) v USING (dataset, k, l)", E_, "flow")
def _(s, d):
    e = stored(I.match_edges(s, d))
    c = e.select("dataset", F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("cluster", F.pmod("node", F.lit(4)))
    return graph.flow(e, c, 0.55)


@query("grf13_kmeans_flow")
def _(s, d):
    return spectral.cluster_flow(I.h2h_edges(s, d), 3)


@query("src16_ero_graphs")
def _(s, d):
    return generate.ero(s, [(60, 0.2, 0.1, "uniform", 10), (60, 0.2, 0.1, "gamma", 20)])[0]


# --- rankers


@query("rnk02_david_score", "SELECT * FROM david", V_, "score")
def _(s, d):
    return rank_rel.david_score(I.match_edges(s, d))


@query("rnk00_simple_scores", "SELECT * FROM scores", V_, "score")
def _(s, d):
    return I.simple_scores(I.match_edges(s, d))


def _rank_sql(rounds: int) -> str:
    out = "mm AS (SELECT dataset, src, dst, w / sum(w) OVER (PARTITION BY dataset, dst) m FROM edges), nodes AS (SELECT DISTINCT dataset, node FROM (SELECT dataset, src node FROM edges UNION ALL SELECT dataset, dst FROM edges)), v0 AS (SELECT dataset, node, 1.0::DOUBLE / count(*) OVER (PARTITION BY dataset) v, count(*) OVER (PARTITION BY dataset) n FROM nodes)"
    for i in range(1, rounds + 1):
        out += f", v{i} AS MATERIALIZED (SELECT dataset, node, x / sum(x) OVER (PARTITION BY dataset) v, n FROM (SELECT p.dataset, p.node, p.n, 0.8::DOUBLE * coalesce(g.g, 0) + 0.2::DOUBLE / p.n x FROM v{i - 1} p LEFT JOIN (SELECT m.dataset, m.src node, sum(m.m * q.v) g FROM mm m JOIN v{i - 1} q ON q.dataset = m.dataset AND q.node = m.dst GROUP BY ALL) g USING (dataset, node)))"
    return out


@query("rnk03_page_rank_15", "SELECT dataset, 'PageRank' AS method, node, v score FROM v15", E_ + "," + _rank_sql(15), "score")
def _(s, d):
    return rank_rel.page_rank(stored(I.match_edges(s, d)), rounds=15, tolerance=0.0)


@query("rnk03_page_rank", "SELECT dataset, 'PageRank' AS method, node, v score FROM v60", E_ + "," + _rank_sql(60), "score")
def _(s, d):
    return rank_rel.page_rank(stored(I.match_edges(s, d)))


def _btl_sql(rounds: int) -> str:
    out = "gm AS (SELECT dataset, i, j, a + b n, a won FROM entries WHERE a + b <> 0), g0 AS (SELECT dataset, i, wins, 1.0::DOUBLE / count(*) OVER (PARTITION BY dataset) g FROM (SELECT dataset, i, sum(won) wins FROM gm GROUP BY ALL))"
    for r in range(1, rounds + 1):
        out += f", g{r} AS MATERIALIZED (SELECT dataset, i, wins, x / sum(x) OVER (PARTITION BY dataset) g FROM (SELECT p.dataset, p.i, any_value(p.wins) wins, (any_value(p.wins) + 1e-6::DOUBLE) / sum(gm.n / (p.g + q.g)) x FROM gm JOIN g{r - 1} p ON p.dataset = gm.dataset AND p.i = gm.i JOIN g{r - 1} q ON q.dataset = gm.dataset AND q.i = gm.j GROUP BY p.dataset, p.i))"
    return out


@query("rnk04_btl_jacobi_3", "SELECT dataset, 'btlJacobi' AS method, i node, g score FROM g3", S_ + "," + _btl_sql(3), "score")
def _(s, d):
    return rank_rel.bradley_terry_steps(I.match_edges(s, d), 3)


@query("rnk07_serial_matrix", "SELECT s.dataset, s.src, s.dst, s.w + n.n / 2.0::DOUBLE w FROM (SELECT a.dataset, a.i src, b.i dst, sum(a.c * b.c) / 2 w FROM c a JOIN c b ON a.dataset = b.dataset AND a.j = b.j GROUP BY ALL) s JOIN (SELECT dataset, count(DISTINCT i) n FROM c GROUP BY ALL) n ON n.dataset = s.dataset WHERE s.w <> 0", I.H2H + ", both_ways AS (SELECT dataset, src i, dst j, w a, 0.0::DOUBLE b FROM edges UNION ALL SELECT dataset, dst, src, 0.0, w FROM edges), entries AS (SELECT dataset, i, j, sum(a) a, sum(b) b FROM both_ways WHERE i <> j GROUP BY ALL), c AS (SELECT dataset, i, j, -sign(a::FLOAT - b::FLOAT) c FROM entries WHERE a::FLOAT - b::FLOAT <> 0)", "w")
def _(s, d):
    return rank_rel.serial_similarity(I.h2h_edges(s, d))


def _power_sql(rounds: int) -> str:
    """Power iteration of A plus a small constant, of unit length each round."""
    out = "nodes AS (SELECT DISTINCT dataset, node FROM (SELECT dataset, src node FROM edges UNION ALL SELECT dataset, dst FROM edges)), v0 AS (SELECT dataset, node, 1.0::DOUBLE v FROM nodes)"
    for i in range(1, rounds + 1):
        out += f", v{i} AS MATERIALIZED (SELECT dataset, node, x / sqrt(sum(x * x) OVER (PARTITION BY dataset)) v FROM (SELECT p.dataset, p.node, coalesce(g.g, 0) + 1e-6::DOUBLE * sum(p.v) OVER (PARTITION BY p.dataset) x FROM v{i - 1} p LEFT JOIN (SELECT e.dataset, e.src node, sum(e.w * q.v) g FROM edges e JOIN v{i - 1} q ON q.dataset = e.dataset AND q.node = e.dst GROUP BY ALL) g USING (dataset, node)))"
    return out


@query("rnk05_eigenvector_centrality", "SELECT dataset, 'eigenvectorCentrality' AS method, node, v score FROM v60", I.ALL + "," + _power_sql(60), "score")
def _(s, d):
    return rank_rel.power_centrality(stored(I.all_edges(s, d)))


@query("rnk05_power_centrality", "SELECT dataset, 'eigenvectorCentrality' AS method, node, v score FROM v30", E_ + "," + _power_sql(30), "score")
def _(s, d):
    return rank_rel.power_centrality(stored(I.match_edges(s, d)), rounds=30, tolerance=1e-9)


def _spring_sql(rounds: int) -> str:
    """Conjugate gradients on the spring system, the score of the last node moved to 0."""
    out = """both_ways AS (SELECT dataset, src i, dst j, w a, 0.0::DOUBLE b FROM edges UNION ALL SELECT dataset, dst, src, 0.0, w FROM edges),
lap AS (SELECT dataset, i, j, sum(a) + sum(b) t, sum(a) - sum(b) m FROM both_ways WHERE i <> j GROUP BY ALL),
s0 AS (SELECT dataset, i, sum(t) d, 0.0::DOUBLE x, sum(m) r, sum(m) / sum(t) p FROM lap GROUP BY ALL), z AS (SELECT dataset, sum(r * r / d) z FROM s0 GROUP BY dataset)"""
    for k in range(1, rounds + 1):
        out += f""", q{k} AS MATERIALIZED (SELECT s.*, s.d * s.p - g.g ap FROM s{k - 1} s JOIN (SELECT l.dataset, l.i, sum(l.t * o.p) g FROM lap l JOIN s{k - 1} o ON o.dataset = l.dataset AND o.i = l.j GROUP BY ALL) g USING (dataset, i)),
a{k} AS MATERIALIZED (SELECT dataset, CASE WHEN sum(r * r / d) > 1e-24 * any_value(z) THEN sum(r * r / d) / sum(p * ap) ELSE 0 END al, sum(r * r / d) rz FROM q{k} JOIN z USING (dataset) GROUP BY dataset),
t{k} AS MATERIALIZED (SELECT dataset, i, d, x + al * p x, r - al * ap r, p, rz FROM q{k} JOIN a{k} USING (dataset)),
s{k} AS MATERIALIZED (SELECT dataset, i, d, x, r, r / d + p * coalesce(sum(r * r / d) OVER (PARTITION BY dataset) / nullif(rz, 0), 0) p FROM t{k})"""
    return out


@query("rnk01_spring_rank", "SELECT s.dataset, 'SpringRank' AS method, s.i node, s.x - l.x score FROM s40 s JOIN (SELECT dataset, arg_max(x, i) x FROM s40 GROUP BY dataset) l ON l.dataset = s.dataset", I.ALL + "," + _spring_sql(40), "score")
def _(s, d):
    return rank_iter.spring_rank(stored(I.all_edges(s, d)))


def _sync_sql(rounds: int) -> str:
    """Power iteration of the normalised synchronisation matrix, places by angle and the cost of every cyclic shift."""
    out = """both_ways AS (SELECT dataset, src i, dst j, w a, 0.0::DOUBLE b FROM edges UNION ALL SELECT dataset, dst, src, 0.0, w FROM edges),
c AS (SELECT dataset, i, j, -sign(sum(a) - sum(b)) c FROM both_ways WHERE i <> j GROUP BY ALL HAVING sum(a) <> sum(b)),
nodes AS (SELECT dataset, node, row_number() OVER (PARTITION BY dataset ORDER BY node) - 1 k, count(*) OVER (PARTITION BY dataset) n FROM (SELECT DISTINCT dataset, i node FROM both_ways)),
deg AS (SELECT dataset, i, count(*) d FROM c GROUP BY ALL),
h AS MATERIALIZED (SELECT c.dataset, c.i, c.j, cos(pi() / greatest(n - 1, 1)) / d re, c * sin(pi() / greatest(n - 1, 1)) / d im FROM c JOIN deg USING (dataset, i) JOIN nodes o ON o.dataset = c.dataset AND o.node = c.i),
v0 AS (SELECT dataset, node, 1.0::DOUBLE x, 0.0::DOUBLE y FROM nodes)"""
    for k in range(1, rounds + 1):
        out += f""", v{k} AS MATERIALIZED (SELECT p.dataset, p.node, coalesce(g.x, 0) x, coalesce(g.y, 0) y FROM v{k - 1} p LEFT JOIN (SELECT h.dataset, h.i node, sum(re * x - im * y) x, sum(re * y + im * x) y FROM h JOIN v{k - 1} q ON q.dataset = h.dataset AND q.node = h.j GROUP BY ALL) g USING (dataset, node))"""
    return out + f""", top AS (SELECT dataset, arg_max(x, (round(sqrt(x * x + y * y), 9), -node)) tx, arg_max(y, (round(sqrt(x * x + y * y), 9), -node)) ty FROM v{rounds} GROUP BY dataset),
ang AS MATERIALIZED (SELECT v.dataset, v.node, k, n, atan2(y * tx - x * ty, x * tx + y * ty) angle FROM v{rounds} v JOIN top USING (dataset) JOIN nodes USING (dataset, node)),
pl AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY round(angle, 10), k) place FROM ang),
cost AS (SELECT e.dataset, s.k, sum(w) FILTER ((q.place + s.k - 2 + q.n) % q.n < (p.place + s.k - 2 + p.n) % p.n) cost FROM edges e JOIN pl p ON p.dataset = e.dataset AND p.node = e.src JOIN pl q ON q.dataset = e.dataset AND q.node = e.dst JOIN nodes s ON s.dataset = e.dataset WHERE e.src <> e.dst GROUP BY ALL),
best AS (SELECT dataset, arg_min(k, (round(coalesce(cost, 0), 6), k)) shift FROM cost GROUP BY dataset)"""


@query("rnk08_sync_rank", "SELECT dataset, 'syncRank' AS method, node, CAST(-((place + shift - 2 + n) % n + 1) AS DOUBLE) score FROM pl JOIN best USING (dataset)", I.ALL + "," + _sync_sql(40), "score")
def _(s, d):
    return rank_iter.sync_rank(stored(I.all_edges(s, d)))


@query("rnk09_sync_rank_angle", "SELECT p.dataset, 'syncRank_angle' AS method, p.node, p.angle - b.angle score FROM pl p JOIN best USING (dataset) JOIN pl b ON b.dataset = p.dataset AND b.k = shift", I.ALL + "," + _sync_sql(40), "score")
def _(s, d):
    return rank_iter.sync_rank_angle(stored(I.all_edges(s, d)))


@query("rnk10_svd_rs")
def _(s, d):
    return rank_iter.svd_rs(I.all_games(s, d))


@query("rnk11_svd_nrs")
def _(s, d):
    return rank_iter.svd_nrs(I.all_games(s, d))


@query("rnk07_serial_rank")
def _(s, d):
    return rank_iter.serial_rank(stored(I.all_edges(s, d)))


@query("rnk07_serial_rank_free")
def _(s, d):
    return rank_iter.serial_rank(stored(I.all_edges(s, d)), compat=False)


def _dense(name: str, methods: list[str]) -> None:
    @query(name)
    def _(s, d):
        return rank_dense.rank(I.h2h_edges(s, d), methods).drop("runtime_sec")


for _n, _m in {
    "rnk04_btl": ["btl"], "rnk06_rank_centrality": ["rankCentrality"],
    "rnk12_minimum_violations": ["mvr"], "rnk20_preset_baselines": ["baselines_shorter"],
}.items():
    _dense(_n, _m)


@query("rnk13_mfas")
def _(s, d):
    return rank_dense.acyclic(I.h2h_edges(s, d))


@query("rnk13_mfas_report")
def _(s, d):
    return rank_dense.mfas_report(I.h2h_edges(s, d), passes=3)


@query("rnk13e_scores_from_order", "SELECT dataset, 'byName' AS method, node, CAST(greatest(1, n - p) AS DOUBLE) score FROM (SELECT dataset, node, row_number() OVER (PARTITION BY dataset ORDER BY node) - 1 p, count(*) OVER (PARTITION BY dataset) n FROM (SELECT DISTINCT dataset, src node FROM edges))", E_)
def _(s, d):
    from pyspark.sql import Window

    n = I.match_edges(s, d).select("dataset", F.col("src").alias("node")).distinct()
    return rank_rel.from_order(n.withColumn("method", F.lit("byName")).withColumn("position", F.row_number().over(Window.partitionBy("dataset").orderBy("node")) - 1))


@query("rnk13f_weighted_upsets", "SELECT dataset, method, sum(CASE WHEN x.score <= y.score THEN w ELSE 0 END) w_upset_sum, sum(CASE WHEN x.score <= y.score THEN w ELSE 0 END) / sum(w) w_upset_frac FROM edges JOIN scores x USING (dataset) JOIN scores y USING (dataset, method) WHERE x.node = src AND y.node = dst GROUP BY ALL", V_, "w_upset_sum w_upset_frac")
def _(s, d):
    e = stored(I.match_edges(s, d))
    return metrics.weighted_upsets(e, I.simple_scores(e))


@query("rnk13h_pairs", "SELECT dataset, i, j, a, b, (a - b) / (a + b + 1e-12) m3 FROM entries WHERE i < j", S_, "a b m3")
def _(s, d):
    return graph.pairs(I.match_edges(s, d)).withColumn("m3", (F.col("a") - F.col("b")) / (F.col("a") + F.col("b") + 1e-12))


@query("rnk13i_pair_ratio_loss", "SELECT dataset, method, avg(pow((a - b) / (a + b + 1e-12) - (x.s - y.s) / (x.s + y.s + 1e-12), 2)) pair_ratio_loss FROM entries JOIN shifted x USING (dataset) JOIN shifted y USING (dataset, method) WHERE i < j AND x.node = i AND y.node = j GROUP BY ALL", V_ + "," + I.EVALUATED, "pair_ratio_loss")
def _(s, d):
    e = stored(I.match_edges(s, d))
    return metrics.pair_ratio_loss(e, metrics.shifted(I.simple_scores(e)))


#: Epochs of the published runs; training stops early after 200 without a better loss.
EPOCHS = 1000


@query("rnk14_dimpa_forward")
def _(s, d):
    return gnn.dimpa_forward(I.h2h_edges(s, d))


@query("rnk17_train_digrac")
def _(s, d):
    return gnn.train(I.h2h_edges(s, d), "DIGRAC", epochs=EPOCHS).select("dataset", "method", "node", "score")


def _inductive(s, d):
    """A model that is trained on one year's graph (train nodes fit, val nodes choose the epoch) scores every graph."""
    e = stored(I.match_edges(s, d))
    first = e.agg(F.min("dataset")).first()[0]
    masks = suites.splits(e.select("dataset", F.explode(F.array("src", "dst")).alias("node")).distinct())
    return e, gnn.apply(e, stored(gnn.fit(e, first, masks, epochs=EPOCHS)))


@query("rnk18_inductive_scores")
def _(s, d):
    return _inductive(s, d)[1]


@query("rnk18_inductive_evaluated")
def _(s, d):
    e, scores = _inductive(s, d)
    return metrics.evaluated(e, stored(scores))


@query("rnk15_train_ib")
def _(s, d):
    return gnn.train(I.h2h_edges(s, d), "ib", epochs=EPOCHS).select("dataset", "method", "node", "score")


# --- evaluation


@query("evl01_04_upsets", "SELECT dataset, method, avg(pow(sign(si - sj) - sign(m), 2)) upset_simple, avg(CASE WHEN sign(si - sj) <> sign(m) THEN 1.0 ELSE 0.0 END) upset_naive, avg(pow(m / (a + b + 1e-8) - (si - sj) / (si + sj + 1e-8), 2)) upset_ratio, avg((m + abs(m)) * greatest(0, sj - si + 0.01)) upset_margin FROM sp GROUP BY ALL", V_ + "," + I.EVALUATED, "upset_simple upset_naive upset_ratio upset_margin")
def _(s, d):
    e = stored(I.match_edges(s, d))
    return metrics.upsets(e, metrics.shifted(I.simple_scores(e)))


@query("evl05_evaluated", "SELECT * FROM evaluated", V_ + "," + I.EVALUATED, "upset_simple upset_ratio upset_naive")
def _(s, d):
    e = stored(I.match_edges(s, d))
    return metrics.evaluated(e, I.simple_scores(e))


@query("evl06_min_rank", "SELECT dataset, method, node, score, rank() OVER (PARTITION BY dataset, method ORDER BY score DESC) rank FROM scores WHERE method = 'netWins'", V_, "score")
def _(s, d):
    return metrics.ranked(rank_rel.net_wins(I.match_edges(s, d)))


@query("evl07_average_rank", "SELECT *, CAST(floor(average_rank) AS BIGINT) ordinal FROM (SELECT dataset, method, node, score, rank() OVER (PARTITION BY dataset, method ORDER BY score) + (count(*) OVER (PARTITION BY dataset, method, score) - 1) / 2.0::DOUBLE - 1 average_rank FROM scores WHERE method = 'netWins')", V_, "score average_rank")
def _(s, d):
    return metrics.average_rank(rank_rel.net_wins(I.match_edges(s, d)))


def _kendall_sql(keys: str = "dataset") -> str:
    same = " AND ".join(f"x.{k} = y.{k}" for k in keys.split(", "))
    both = f"SELECT {', '.join('x.' + k for k in keys.split(', '))}, sum(sign(x.v - y.v) * sign(x.u - y.u)) s FROM k x JOIN k y ON {same} AND x.node < y.node GROUP BY ALL"
    tie = "SELECT {k}, sum(t * (t - 1) / 2) {c}0, sum(t * (t - 1) * (t - 2)) {c}1, sum(t * (t - 1) * (2 * t + 5)) {c}2 FROM (SELECT {k}, count(*)::DOUBLE t FROM k GROUP BY {k}, {v}) GROUP BY {k}"
    z = "abs(s) / nullif(sqrt((n * (n - 1) * (2 * n + 5) - x2 - y2) / 18 + 2 * x0 * y0 / nullif(n * (n - 1), 0) + coalesce(x1 * y1 / nullif(9 * n * (n - 1) * (n - 2), 0), 0)), 0) / sqrt(2.0::DOUBLE)"
    q = f"SELECT {keys}, n, s / nullif(sqrt((n * (n - 1) / 2 - x0) * (n * (n - 1) / 2 - y0)), 0) tau, {z} z FROM (SELECT {keys}, count(*)::DOUBLE n FROM k GROUP BY ALL) LEFT JOIN ({both}) USING ({keys}) JOIN ({tie.format(c='x', v='v', k=keys)}) USING ({keys}) JOIN ({tie.format(c='y', v='u', k=keys)}) USING ({keys})"
    return f"SELECT {keys}, n, tau, t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-z * z) p_value FROM (SELECT *, 1 / (1 + 0.3275911 * z) t FROM ({q}))"


@query("evl08_kendall", _kendall_sql(), V_ + ", k AS (SELECT a.dataset, a.node, round(a.score, 6) v, b.score u FROM scores a JOIN scores b USING (dataset, node) WHERE a.method = 'davidScore' AND b.method = 'netWins')", "n tau p_value")
def _(s, d):
    e = stored(I.match_edges(s, d))
    a = rank_rel.david_score(e).select("dataset", "node", F.round("score", 6).alias("value"))
    b = rank_rel.net_wins(e).select("dataset", "node", F.col("score").alias("value"))
    return metrics.kendall(a, b)


@query("evl13_phase_ablation")
def _(s, d):
    r = rank_dense.mfas_reports(I.h2h_edges(s, d), {"A": {"add_back": False, "refine_ratio": False}, "A+B": {"refine_ratio": False}, "A+B+C": {}})
    return r.select(F.col("variant").alias("phases"), "dataset", "cycles", "kept_final", "stop")


@query("evl14_pass_equivalence")
def _(s, d):
    return metrics.pass_equivalence(stored(rank_dense.acyclic(I.h2h_edges(s, d), (2, 3))), "MFAS_INS2", "MFAS_INS3")


# --- results


@query("agg01_trials", "SELECT * FROM results", T_, " ".join(f"{c}_{n}" for c in M4 for n in ("mean", "std")))
def _(s, d):
    return results.aggregate_trials(I.trials(s, d))


@query("prj09_slim", "SELECT * FROM slim", T_)
def _(s, d):
    return I.slim(s, d)


@query("agg04_best_config", "SELECT * FROM board", B_)
def _(s, d):
    return I.leaderboard(s, d)


@query("agg05_best_row", "SELECT dataset, method, config, upset_simple, upset_ratio, upset_naive, runtime_sec FROM (SELECT *, row_number() OVER (PARTITION BY dataset, method ORDER BY upset_simple NULLS LAST, upset_ratio NULLS LAST, runtime_sec NULLS LAST, config) r FROM slim) WHERE r = 1", T_)
def _(s, d):
    return results.best_row(I.slim(s, d))


@query("agg02_minima", "SELECT dataset, min(upset_simple) min_upset_simple, min(upset_ratio) min_upset_ratio, min(upset_naive) min_upset_naive, min(runtime_sec) min_runtime_sec FROM board GROUP BY ALL", B_)
def _(s, d):
    return results.independent_minima(I.leaderboard(s, d))


@query("agg03_envelope", "SELECT dataset, method AS best_method, upset_simple best_upset_simple, upset_ratio best_upset_ratio, upset_naive best_upset_naive, runtime_sec best_runtime_sec FROM env", C_)
def _(s, d):
    return results.envelope(I.leaderboard(s, d).where(F.col("method").isin(I.CLASSICAL)))


@query("agg06_summary", "SELECT method, count(DISTINCT dataset) n_datasets, count(upset_simple) n_valid, " + I.decimal_stats_sql(M4) + ", count(upset_simple) || ' / 84' coverage FROM board GROUP BY method", B_, " ".join(f"{n}_{c}" for c in M4 for n in ("median", "mean")))
def _(s, d):
    return results.summarize(I.leaderboard(s, d), 84)


@query("agg06_summary_by_config", "SELECT method, config, count(DISTINCT dataset) n_datasets, count(upset_simple) n_valid, " + I.decimal_stats_sql(M4) + ", count(upset_simple) || ' / 84' coverage FROM slim GROUP BY method, config", T_, " ".join(f"{n}_{c}" for c in M4 for n in ("median", "mean")))
def _(s, d):
    return results.summarize(I.slim(s, d), 84, ("method", "config"))


@query("agg07_fixed_order", "SELECT n.position, n.m AS method, avg(upset_simple) mean, stddev_pop(upset_simple) std, count(upset_simple) n FROM (SELECT * FROM (VALUES (0, 'MFAS_INS3'), (1, 'absent'), (2, 'btl')) v(position, m)) n LEFT JOIN board ON method = n.m GROUP BY ALL", B_, "mean std")
def _(s, d):
    return results.in_fixed_order(I.leaderboard(s, d), ["MFAS_INS3", "absent", "btl"])


@query("agg08_distinct", "SELECT method, count(DISTINCT dataset) n, array_to_string(list_sort(list(DISTINCT config)), ';') configs FROM slim GROUP BY method", T_)
def _(s, d):
    return I.slim(s, d).groupBy("method").agg(F.count_distinct("dataset").alias("n"), F.array_join(F.array_sort(F.collect_set("config")), ";").alias("configs"))


_WTL = "count(*) FILTER (g < -{t}) wins, count(*) FILTER (g >= -{t} AND g <= {t}) ties, count(*) FILTER (g > {t}) losses, count(g) n"


@query("agg11_win_tie_loss", "SELECT " + _WTL.format(t="1e-6") + " FROM (SELECT ours_upset_simple - best_upset_simple g FROM cmp)", C_)
def _(s, d):
    return results.win_tie_loss(I.comparison(s, d), "ours_upset_simple", "best_upset_simple")


@query("agg11_win_tie_loss_1e3", "SELECT " + _WTL.format(t="1e-3") + " FROM (SELECT ours_upset_ratio - best_upset_ratio g FROM cmp)", C_)
def _(s, d):
    return results.win_tie_loss(I.comparison(s, d), "ours_upset_ratio", "best_upset_ratio", 1e-3)


@query("agg12_win_tie_loss_by_family", "SELECT family, " + _WTL.format(t="1e-6") + " FROM (SELECT split_part(dataset, '/', 1) family, ours_upset_simple - best_upset_simple g FROM cmp) GROUP BY family", C_)
def _(s, d):
    c = I.comparison(s, d).withColumn("family", names.family_prefix(F.col("dataset")))
    return results.win_tie_loss(c, "ours_upset_simple", "best_upset_simple", keys=("family",))


def _gap_sql(keys: str = "") -> str:
    q = ", ".join(f"quantile_cont({c}, {p}) {n}_{c}" for c in ("gap", "rel") for p, n in ((0.25, "p25"), (0.5, "median"), (0.75, "p75"), (0.9, "p90")))
    return f"SELECT {keys} count(gap) n, {q}, avg(gap) mean_gap, max(gap) max_gap, avg(rel) mean_rel, max(rel) max_rel FROM (SELECT split_part(dataset, '/', 1) family, ours_upset_simple - best_upset_simple gap, (ours_upset_simple - best_upset_simple) / nullif(abs(best_upset_simple), 0) rel FROM cmp)"


_GAPS = " ".join(f"{n}_{c}" for c in ("gap", "rel") for n in ("p25", "median", "p75", "p90", "mean", "max"))


@query("agg13_gaps", _gap_sql(), C_, _GAPS)
def _(s, d):
    return results.gaps(I.comparison(s, d), "ours_upset_simple", "best_upset_simple")


@query("agg33_gaps_by_family", _gap_sql("family,") + " GROUP BY family", C_, _GAPS)
def _(s, d):
    c = I.comparison(s, d).withColumn("family", names.family_prefix(F.col("dataset")))
    return results.gaps(c, "ours_upset_simple", "best_upset_simple", ("family",))


@query("agg14_nearest_rank", "SELECT family, x p75 FROM (SELECT split_part(dataset, '/', 1) family, ours_upset_simple x, row_number() OVER (PARTITION BY split_part(dataset, '/', 1) ORDER BY ours_upset_simple) - 1 i, count(*) OVER (PARTITION BY split_part(dataset, '/', 1)) n FROM cmp WHERE ours_upset_simple IS NOT NULL) WHERE i = round_even(0.75 * (n - 1), 0)", C_)
def _(s, d):
    c = I.comparison(s, d).withColumn("family", names.family_prefix(F.col("dataset")))
    return results.nearest_rank(c, "ours_upset_simple", 0.75, ("family",))


@query("agg16_coverage_curve", "SELECT method, b.budget, avg(CASE WHEN runtime_sec <= b.budget THEN 1.0 ELSE 0.0 END) share FROM board, (SELECT unnest([60, 120, 200, 240]) budget) b GROUP BY ALL", B_, "share")
def _(s, d):
    return results.coverage_curve(I.leaderboard(s, d), [60, 120, 200, 240])


@query("agg17_within_share", "SELECT count(*) FILTER ((o - b) / nullif(abs(b), 0) <= 0.05) relative, count(*) FILTER (b > 0 AND (o - b) / b <= 0.05) guarded, count(*) FILTER (abs(o - b) <= 0.05) absolute FROM (SELECT ours_upset_simple o, best_upset_simple b FROM cmp)", C_)
def _(s, d):
    w = results.within_share(F.col("ours_upset_simple"), F.col("best_upset_simple"), 0.05)
    return I.comparison(s, d).agg(*(F.count_if(c).alias(n) for n, c in w.items()))


@query("agg32_competitiveness", "SELECT family, count(*) n, count(*) FILTER (r <= 0.01) within_1, count(*) FILTER (r <= 0.05) within_5, count(*) FILTER (r <= 0.1) within_10 FROM (SELECT split_part(dataset, '/', 1) family, CASE WHEN best_upset_simple > 0 THEN (ours_upset_simple - best_upset_simple) / best_upset_simple END r FROM cmp) GROUP BY family", C_)
def _(s, d):
    c = I.comparison(s, d).withColumn("family", names.family_prefix(F.col("dataset")))
    k = {n: results.within_share(F.col("ours_upset_simple"), F.col("best_upset_simple"), n / 100)["guarded"] for n in (1, 5, 10)}
    return c.groupBy("family").agg(F.count("*").alias("n"), *(F.count_if(x).alias(f"within_{n}") for n, x in k.items()))


_SPEED = "count(s) n, quantile_cont(s, 0.25) p25, quantile_cont(s, 0.5) median, quantile_cont(s, 0.75) p75, avg(s) mean, count(*) FILTER (s >= 10) ge_10x, count(*) FILTER (s >= 50) ge_50x, count(*) FILTER (s >= 100) ge_100x"


@query("agg18_speedups", f"SELECT {_SPEED} FROM (SELECT CASE WHEN ours_runtime_sec > 0 THEN best_runtime_sec / ours_runtime_sec END s FROM cmp)", C_, "p25 median p75 mean")
def _(s, d):
    return results.speedups(I.comparison(s, d), "ours_runtime_sec", "best_runtime_sec")


@query("agg19_pareto_quadrants", "SELECT count(*) FILTER (g < -1e-6 AND t < -1e-6) better_faster, count(*) FILTER (g < -1e-6 AND t > 1e-6) better_slower, count(*) FILTER (g > 1e-6 AND t < -1e-6) worse_faster, count(*) FILTER (g > 1e-6 AND t > 1e-6) worse_slower FROM (SELECT ours_upset_simple - best_upset_simple g, ours_runtime_sec - best_runtime_sec t FROM cmp)", C_)
def _(s, d):
    return results.pareto_quadrants(I.comparison(s, d), ("ours_upset_simple", "best_upset_simple"), ("ours_runtime_sec", "best_runtime_sec"))


@query("agg20_join10_dominated", "SELECT o.dataset, EXISTS (SELECT 1 FROM board b WHERE b.dataset = o.dataset AND b.method <> 'MFAS_INS3' AND b.upset_simple <= o.upset_simple AND b.runtime_sec <= o.runtime_sec) dominated FROM board o WHERE o.method = 'MFAS_INS3'", B_)
def _(s, d):
    b = I.leaderboard(s, d)
    return results.dominated(b.where(F.col("method") == I.OURS), b.where(F.col("method") != I.OURS)).select("dataset", "dominated")


@query("agg21_coverage_audit", "SELECT method, count(*) n_rows, count(upset_simple) n_valid_upset_simple, count(runtime_sec) n_valid_runtime, count(*) FILTER (runtime_sec IS NULL OR runtime_sec > 180) n_timeout, count(*) FILTER (runtime_sec <= 180) n_within_budget, coalesce(array_to_string(list_sort(list(DISTINCT dataset) FILTER (upset_simple IS NULL)), ';'), '') missing_datasets FROM slim GROUP BY method", T_)
def _(s, d):
    return results.coverage_audit(I.slim(s, d), 180.0)


@query("agg22_family_rollup", "SELECT split_part(dataset, '/', 1) family, count(*) n, min(upset_simple) lo, max(upset_simple) hi, sum(runtime_sec) total FROM board GROUP BY ALL", B_, "total")
def _(s, d):
    return I.leaderboard(s, d).groupBy(names.family_prefix(F.col("dataset")).alias("family")).agg(F.count("*").alias("n"), F.min("upset_simple").alias("lo"), F.max("upset_simple").alias("hi"), F.sum("runtime_sec").alias("total"))


@query("agg23_season_modes", "SELECT family, count(*) n, avg(o) ours, avg(b) best, count(*) FILTER (sign(o - b) <> sign(ao - ab)) flips FROM (SELECT split_part(dataset, '/', 1) family, ours_upset_simple o, best_upset_simple b, avg(ours_upset_simple) OVER (PARTITION BY split_part(dataset, '/', 1)) ao, avg(best_upset_simple) OVER (PARTITION BY split_part(dataset, '/', 1)) ab FROM cmp) GROUP BY family", C_, "ours best")
def _(s, d):
    c = I.comparison(s, d).withColumn("family", names.family_prefix(F.col("dataset")))
    mean = c.groupBy("family").agg(F.avg("ours_upset_simple").alias("ao"), F.avg("best_upset_simple").alias("ab"))
    both = c.join(F.broadcast(mean), "family")  # one row per family
    flip = F.signum(F.col("ours_upset_simple") - F.col("best_upset_simple")) != F.signum(F.col("ao") - F.col("ab"))
    return both.groupBy("family").agg(F.count("*").alias("n"), F.avg("ours_upset_simple").alias("ours"), F.avg("best_upset_simple").alias("best"), F.count_if(flip).alias("flips"))


@query("agg24_regimes", "SELECT bin_type, bin_label, count(g) sample_size, count(*) FILTER (g < -1e-12) wins, count(*) FILTER (abs(g) <= 1e-12) ties, count(*) FILTER (g > 1e-12) losses, avg(g) mean_margin, median(g) median_margin FROM (SELECT 'family' bin_type, split_part(dataset, '/', 1) bin_label, ours_upset_simple - best_upset_simple g FROM cmp UNION ALL SELECT 'runtime', CASE WHEN ours_runtime_sec <= 60 THEN 'short' WHEN ours_runtime_sec <= 150 THEN 'middle' ELSE 'long' END, ours_upset_simple - best_upset_simple FROM cmp) GROUP BY ALL", C_, "mean_margin median_margin")
def _(s, d):
    c = I.comparison(s, d).withColumn("margin", F.col("ours_upset_simple") - F.col("best_upset_simple"))
    return results.regimes(c, {"family": names.family_prefix(F.col("dataset")), "runtime": names.bin_name(F.col("ours_runtime_sec"), [(60, "short"), (150, "middle")], "long")}, "margin")


@query("agg09_highlight", "SELECT dataset, method, upset_simple, CASE WHEN upset_simple IS NULL THEN '' WHEN r = 1 THEN 'best' WHEN r = 2 THEN 'second' ELSE '' END mark FROM (SELECT *, dense_rank() OVER (PARTITION BY dataset ORDER BY round(upset_simple * 100) ASC NULLS LAST) r FROM board)", B_)
def _(s, d):
    return results.highlight(I.leaderboard(s, d), "upset_simple", ("dataset",)).select("dataset", "method", "upset_simple", "mark")


@query("agg26_common_median", "SELECT method, median(upset_simple) med, count(*) n FROM board WHERE method LIKE 'MFAS%' AND dataset IN (SELECT dataset FROM board WHERE method LIKE 'MFAS%' AND upset_simple IS NOT NULL GROUP BY dataset HAVING count(DISTINCT method) = 3) GROUP BY method", B_, "med")
def _(s, d):
    b = I.leaderboard(s, d).where(F.col("method").startswith("MFAS"))
    common = b.where("upset_simple is not null").groupBy("dataset").agg(F.count_distinct("method").alias("k")).where("k = 3")
    return b.join(common, "dataset", "left_semi").groupBy("method").agg(F.median("upset_simple").alias("med"), F.count("*").alias("n"))


@query("agg27_before_after", "SELECT b.dataset, b.upset_simple before, a.upset_simple after, a.upset_simple - b.upset_simple delta FROM board b JOIN board a ON a.dataset = b.dataset AND a.method = 'MFAS_INS3' WHERE b.method = 'MFAS_INS1'", B_, "delta")
def _(s, d):
    b = I.leaderboard(s, d)
    old = b.where("method = 'MFAS_INS1'").select("dataset", F.col("upset_simple").alias("before"))
    new = b.where("method = 'MFAS_INS3'").select("dataset", F.col("upset_simple").alias("after"))
    return old.join(new, "dataset").withColumn("delta", F.col("after") - F.col("before"))


@query("agg28_long_stats", f"SELECT 'speed' AS section, unnest(['n', 'p25', 'median', 'p75', 'mean', 'ge_10x', 'ge_50x', 'ge_100x']) metric, unnest([n, p25, median, p75, mean, ge_10x, ge_50x, ge_100x]::DOUBLE[]) AS value FROM (SELECT {_SPEED} FROM (SELECT CASE WHEN ours_runtime_sec > 0 THEN best_runtime_sec / ours_runtime_sec END s FROM cmp))", C_, "value")
def _(s, d):
    return results.long_stats(results.speedups(I.comparison(s, d), "ours_runtime_sec", "best_runtime_sec"), "speed")


@query("agg29_coverage_map", "SELECT method, count(*) n_valid, array_to_string(list_sort(list(dataset || '=' || CASE WHEN upset_simple IS NULL THEN 0 ELSE 1 END)), ';') coverage FROM board GROUP BY method", B_)
def _(s, d):
    e = F.concat("dataset", F.lit("="), F.col("upset_simple").isNotNull().cast("int").cast("string"))
    return I.leaderboard(s, d).groupBy("method").agg(F.count("*").alias("n_valid"), F.array_join(F.array_sort(F.collect_list(e)), ";").alias("coverage"))


@query("agg30_tie_counts", "SELECT split_part(dataset, '/', 1) family, count(*) FILTER (abs(g) <= 1e-6) t6, count(*) FILTER (abs(g) <= 1e-3) t3, count(*) FILTER (abs(g) / nullif(abs(best_upset_simple), 0) <= 0.01) t1 FROM (SELECT *, ours_upset_simple - best_upset_simple g FROM cmp) GROUP BY ALL", C_)
def _(s, d):
    g = F.abs(F.col("ours_upset_simple") - F.col("best_upset_simple"))
    b = F.abs("best_upset_simple")
    return I.comparison(s, d).groupBy(names.family_prefix(F.col("dataset")).alias("family")).agg(F.count_if(g <= 1e-6).alias("t6"), F.count_if(g <= 1e-3).alias("t3"), F.count_if(F.try_divide(g, F.when(b != 0, b)) <= 0.01).alias("t1"))


# --- joins and sets


@query("join05_with_fallback", "SELECT dataset, method, upset_simple, 'primary' source FROM board WHERE method IN ('btl', 'davidScore') AND upset_simple IS NOT NULL UNION ALL SELECT dataset, method, upset_simple, 'fallback' FROM (SELECT *, row_number() OVER (PARTITION BY dataset, method ORDER BY config) r FROM slim WHERE method IN ('btl', 'PageRank')) f WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM board b WHERE b.method IN ('btl', 'davidScore') AND b.upset_simple IS NOT NULL AND b.dataset = f.dataset AND b.method = f.method)", B_)
def _(s, d):
    p = I.leaderboard(s, d).where("method in ('btl', 'davidScore') and upset_simple is not null").select("dataset", "method", "upset_simple")
    f = I.slim(s, d).where("method in ('btl', 'PageRank')").select("dataset", "method", "upset_simple", F.col("config").alias("ord"))
    return results.with_fallback(p, f).select("dataset", "method", "upset_simple", "source")


@query("join06_lookup", "SELECT k.dataset, CASE WHEN p.dataset IS NOT NULL THEN p.upset_simple ELSE f.upset_simple END upset_simple, CASE WHEN p.dataset IS NOT NULL THEN p.runtime_sec ELSE f.runtime_sec END runtime_sec FROM (SELECT DISTINCT dataset FROM board) k LEFT JOIN (SELECT * FROM board WHERE method = 'DIGRAC' AND dataset LIKE '%-0%') p USING (dataset) LEFT JOIN (SELECT * FROM board WHERE method = 'btl') f USING (dataset)", B_)
def _(s, d):
    b = I.leaderboard(s, d)
    return results.lookup(b.select("dataset").distinct(), b.where("method = 'DIGRAC' and dataset like '%-0%'"), b.where("method = 'btl'"), ("upset_simple", "runtime_sec"))


@query("join07_alias_backfill", "SELECT b.dataset, b.method, CASE WHEN b.runtime_sec IS NULL AND b.upset_simple IS NOT NULL THEN m.t ELSE b.runtime_sec END runtime_sec, coalesce(CASE WHEN b.runtime_sec IS NULL AND b.upset_simple IS NOT NULL THEN m.t ELSE b.runtime_sec END > 180, true) timeout_flag FROM board b LEFT JOIN (SELECT dataset, method, avg(runtime_sec) t FROM board GROUP BY ALL) m ON m.dataset = replace(b.dataset, '-12', '-01') AND b.dataset LIKE '%-12' AND m.method = b.method", B_, "runtime_sec")
def _(s, d):
    b = I.leaderboard(s, d)
    a = b.where("dataset like '%-12'").select("dataset", F.replace("dataset", F.lit("-12"), F.lit("-01")).alias("alias")).distinct()
    return results.backfill_runtime(b, a, 180.0).select("dataset", "method", "runtime_sec", "timeout_flag")


@query("join08_nearest_value", "SELECT dataset, target, CASE WHEN diff <= 0.5 THEN config END config, diff FROM (SELECT t.dataset, t.target, c.config, abs(c.upset_simple - t.target) diff, row_number() OVER (PARTITION BY t.dataset, t.target ORDER BY abs(c.upset_simple - t.target), c.config || c.method) r FROM (SELECT dataset, upset_simple target FROM board WHERE method = 'btl' AND upset_simple IS NOT NULL) t LEFT JOIN (SELECT dataset, method, config || method AS config, upset_simple FROM slim WHERE method <> 'btl' AND upset_simple IS NOT NULL) c ON c.dataset = t.dataset) WHERE r = 1", B_, "diff")
def _(s, d):
    t = I.leaderboard(s, d).where("method = 'btl' and upset_simple is not null").select("dataset", F.col("upset_simple").alias("target"))
    c = I.slim(s, d).where("method <> 'btl'").select("dataset", F.concat("config", "method").alias("config"), "upset_simple")
    return results.nearest_value(t, c, "upset_simple", 0.5)


@query("join12_method_pairs", "SELECT a.method AS one, b.method AS other, " + _WTL.format(t="1e-12") + " FROM (SELECT x.method, y.method m2, x.upset_simple - y.upset_simple g FROM board x JOIN board y ON x.dataset = y.dataset AND x.method < y.method) q JOIN (SELECT DISTINCT method FROM board) a ON a.method = q.method JOIN (SELECT DISTINCT method FROM board) b ON b.method = q.m2 GROUP BY ALL", B_)
def _(s, d):
    b = I.leaderboard(s, d)
    x = b.select("dataset", F.col("method").alias("one"), F.col("upset_simple").alias("x"))
    y = b.select("dataset", F.col("method").alias("other"), F.col("upset_simple").alias("y"))
    return results.win_tie_loss(x.join(y, "dataset").where("one < other"), "x", "y", 1e-12, ("one", "other"))


@query("set02_first_wins", "SELECT dataset, method, upset_simple FROM board WHERE method = 'btl' UNION ALL SELECT dataset, method, upset_simple FROM (SELECT *, row_number() OVER (PARTITION BY dataset, method ORDER BY upset_simple NULLS LAST) r FROM slim WHERE method <> 'btl') WHERE r = 1", B_)
def _(s, d):
    one = I.leaderboard(s, d).where("method = 'btl'").select("dataset", "method", "upset_simple")
    return results.first_wins([one, I.slim(s, d).select("dataset", "method", "upset_simple")], ("dataset", "method"))


@query("set04_05_intersect_except", "SELECT 'both' kind, dataset FROM (SELECT dataset FROM board WHERE method = 'btl' INTERSECT SELECT dataset FROM board WHERE upset_simple < 1) UNION ALL SELECT 'only', dataset FROM (SELECT dataset FROM board WHERE method = 'btl' EXCEPT SELECT dataset FROM board WHERE upset_simple < 1)", B_)
def _(s, d):
    b = I.leaderboard(s, d)
    x, y = b.where("method = 'btl'").select("dataset"), b.where("upset_simple < 1").select("dataset")
    return x.intersect(y).select(F.lit("both").alias("kind"), "dataset").unionByName(x.subtract(y).select(F.lit("only").alias("kind"), "dataset"))


@query("top01_largest_gaps", "SELECT dataset, ours_upset_simple - best_upset_simple gap FROM cmp WHERE ours_upset_simple - best_upset_simple IS NOT NULL ORDER BY gap DESC, dataset LIMIT 10", C_, "gap")
def _(s, d):
    return I.comparison(s, d).select("dataset", (F.col("ours_upset_simple") - F.col("best_upset_simple")).alias("gap")).where("gap is not null").orderBy(F.desc("gap"), "dataset").limit(10)


@query("flt05_compute_matched", "SELECT * FROM board WHERE runtime_sec <= 180", B_)
def _(s, d):
    return I.leaderboard(s, d).where("runtime_sec <= 180")


# --- names, tables, checks


@query("fn01_05_names", "SELECT DISTINCT dataset, method, CASE WHEN dataset LIKE 'finerBasketball%' THEN 'Basketball_finer' WHEN dataset LIKE 'Basketball%' THEN 'Basketball_coarse' WHEN dataset LIKE 'Football%' THEN 'Football_coarse' ELSE 'Faculty' END family, CASE WHEN method LIKE 'MFAS%' THEN 'ours' WHEN method = 'DIGRAC' THEN 'gnn' ELSE 'classical' END method_family, CAST(regexp_extract(config, 'trials(\\d+)', 1) AS INT) trials, substr(config, 1, 20) || '...' short FROM slim", T_)
def _(s, d):
    c = F.col("config")
    return I.slim(s, d).select("dataset", "method", names.family(F.col("dataset")).alias("family"), names.method_family(F.col("method")).alias("method_family"), names.config_trials(c).alias("trials"), names.short_config(c).alias("short")).distinct()


@query("fn08_09_formats", "SELECT method, n_ok, n_all, CASE WHEN m IS NULL THEN '---' ELSE printf('%.4f', m) END mean_text, replace(method, '_', '\\_') latex FROM (SELECT method, CAST(split_part(t, ' / ', 1) AS INT) n_ok, CAST(split_part(t, ' / ', 2) AS INT) n_all, m FROM (SELECT method, count(upset_simple) || ' / ' || count(*) t, round(avg(upset_simple), 5) m FROM board GROUP BY method))", B_)
def _(s, d):
    b = I.leaderboard(s, d).groupBy("method").agg(F.concat(F.count("upset_simple").cast("string"), F.lit(" / "), F.count("*").cast("string")).alias("t"), F.round(F.avg("upset_simple"), 5).alias("m"))
    ok, total = names.coverage_parts(F.col("t"))
    return b.select("method", ok.alias("n_ok"), total.alias("n_all"), names.number(F.col("m")).alias("mean_text"), names.latex(F.col("method")).alias("latex"))


@query("val05_checks", "SELECT * FROM (SELECT 'datasets' AS name, CASE WHEN count(DISTINCT dataset) = 84 THEN 'PASS' ELSE 'FAIL' END status FROM board UNION ALL SELECT 'methods', CASE WHEN count(DISTINCT method) = 8 THEN 'PASS' ELSE 'FAIL' END FROM board UNION ALL SELECT 'naive is a quarter of simple', CASE WHEN bool_and(abs(upset_simple / 4 - upset_naive) < 1e-5) THEN 'PASS' ELSE 'FAIL' END FROM slim)", B_)
def _(s, d):
    b = I.leaderboard(s, d)
    return audit.checks({"datasets": b.agg(F.count_distinct("dataset") == 84), "methods": b.agg(F.count_distinct("method") == 8), "naive is a quarter of simple": I.slim(s, d).agg(F.bool_and(F.abs(F.col("upset_simple") / 4 - F.col("upset_naive")) < 1e-5))})


@query("val10_inventory", "SELECT dataset, n, m, CASE WHEN m < 100 THEN 'sparse' ELSE '' END notes FROM (SELECT dataset, count(*) m FROM edges GROUP BY ALL) JOIN (SELECT dataset, count(DISTINCT v) n FROM (SELECT dataset, src v FROM edges UNION ALL SELECT dataset, dst FROM edges) GROUP BY ALL) USING (dataset)", E_)
def _(s, d):
    return audit.inventory(I.match_edges(s, d))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers per season by David's score, and how well the scores explain the season."""
    e = stored(I.match_edges(spark, sf_dir))
    return rounded(metrics.evaluated(e, rank_rel.david_score(e)))
