"""Readers, writers, the runner and the stream on small files."""

import io
import zipfile

import numpy as np

from palio.functions import names
from palio.operators import graph, rank_rel, results, tables
from palio.plans import runner
from palio.sources import readers, writers
from palio.streaming import seasons


def test_matches_to_edges(spark, tmp_path):
    (tmp_path / "m.csv").write_bytes(b"a,b,2,0\rb,c,1,1\rc,a,0,3")
    m = readers.matches(spark, str(tmp_path / "m.csv"), "season")
    assert m.count() == 3
    assert sorted((r["src"], r["dst"], r["w"]) for r in graph.goal_difference_edges(m).collect()) == [("a", "b", 2.0), ("a", "c", 3.0)]
    assert graph.finer_edges(m).count() == 6
    nodes, e = graph.numbered(graph.goal_difference_edges(m).selectExpr("*", "case when dst = 'b' then 0 else 1 end ord"))
    assert {r["name"]: r["node"] for r in nodes.collect()} == {"a": 0, "b": 1, "c": 2}
    assert sorted((r["src"], r["dst"]) for r in e.collect()) == [(0, 1), (0, 2)]


def test_column_files_and_matrix(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("actor.name\tnumber.wins\nx\t3\ny\tNA\n")
    got = readers.tsv_columns(spark, str(tmp_path / "t.tsv"), {"actor": ("actor.name", "string"), "wins": ("number.wins", "int")}).collect()
    assert [(r["actor"], r["wins"]) for r in got] == [("x", 3), ("y", None)]
    (tmp_path / "d.csv").write_text("0,2,-1\n3,0,0\n")
    got = readers.dense_matrix(spark, str(tmp_path / "d.csv"), "m").collect()
    assert sorted((r["src"], r["dst"], r["w"]) for r in got) == [(0, 1, 2.0), (1, 0, 3.0)]


def test_missing_result_file_is_empty(spark, tmp_path):
    schema = "dataset string, upset_simple double"
    assert readers.results_csv(spark, str(tmp_path / "no.csv"), schema).count() == 0
    (tmp_path / "r.csv").write_text("dataset,upset_simple\na,0.5\nb,nan\nc,\n")
    assert [r["upset_simple"] for r in readers.results_csv(spark, str(tmp_path / "r.csv"), schema).orderBy("dataset").collect()] == [0.5, None, None]


def npz(rows):
    raw = io.BytesIO()
    np.savez(raw, data=np.array([r[2] for r in rows]), indices=np.array([r[1] for r in rows]), indptr=np.array([0, 2, 3]), shape=np.array([2, 2]), format=np.array(b"csr"))
    return raw.getvalue()


def test_archives(spark, tmp_path):
    rows = [(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0)]
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "adj.npz").write_bytes(npz(rows))
    assert zipfile.is_zipfile(tmp_path / "g" / "adj.npz")
    assert sorted(tuple(r)[1:] for r in readers.npz_edges(spark, str(tmp_path)).collect()) == rows
    assert [tuple(r)[1:] for r in readers.npz_profile(spark, str(tmp_path)).collect()] == [(2, 3)]
    spark.dataSource.register(readers.NpzEdges)
    got = spark.read.format("npz_edges").option("dataset", "x").load(str(tmp_path / "g" / "adj.npz")).collect()
    assert sorted(tuple(r)[1:] for r in got) == rows


def test_result_tensors(spark, tmp_path):
    for which, config in (("upset", "trials10a"), ("runtime", "other")):
        d = tmp_path / "Basketball" / "1985" / which / "btl"
        d.mkdir(parents=True)
        np.save(d / f"{config}.npy", np.array([[0.5, np.nan]]))
    files = readers.result_files(spark, str(tmp_path))
    assert {r["which"] for r in files.collect()} == {"upset", "runtime"}
    both = readers.match_runtimes(files.where("which = 'upset'"), files.where("which = 'runtime'")).collect()
    assert both[0]["runtime_path"].endswith("other.npy")
    assert sorted((tuple(r["index"]), r["value"]) for r in readers.npy_values(spark, str(tmp_path)).collect())[0] == ((0, 0), 0.5)
    assert readers.latest(files).count() == 2


def test_run_logs(spark, tmp_path):
    table = "x_bestMetric/Method  btl other\nupset_simple 0.45$\\pm$0.00\nupset_ratio 0.22$\\pm$0.01\nupset_naive 0.11$\\pm$0.00\nruntime_sec nan$\\pm$nan\n"
    (tmp_path / "log.txt").write_text("noise\n" + table + "y_bestMetric/Method  mvr\nupset_simple 0.4$\\pm$0.0\n")
    got = readers.run_logs(spark, str(tmp_path / "log.txt")).collect()
    assert len(got) == 1 and (got[0]["dataset"], got[0]["method"], got[0]["upset_ratio_std"], got[0]["runtime_sec_mean"]) == ("x", "btl", 0.01, None)


def test_cached_table(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert readers.load_or_build(spark, str(tmp_path / "t"), build).count() == 3
    assert len(calls) == 1


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, None), ("b", 2, 0.5)], "dataset string, x int, y double")
    writers.by_dataset(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    writers.csv(df, str(tmp_path / "c"), ["x"])
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2
    writers.text(tables.latex_table(df, ["x"]), str(tmp_path / "l"))
    assert "a & 1 & --- \\\\" in [r["value"] for r in spark.read.text(str(tmp_path / "l")).collect()]
    writers.json(df, str(tmp_path / "j"))
    assert any("null" in r["value"] for r in spark.read.text(str(tmp_path / "j")).collect())
    assert tables.markdown_table(df, ["x"]).count() == 4
    assert writers.settings({"b": 1, "a": 2}, df).count() == 2


def test_runner(spark):
    e = spark.createDataFrame([("g", 0, 1, 2.0), ("g", 1, 2, 2.0), ("g", 0, 2, 1.0)], "dataset string, src long, dst long, w double")
    got = {r["method"]: r for r in runner.evaluate(e, runner.scores(e, ["davidScore", "SpringRank", "MFAS_INS1"])).collect()}
    assert set(got) == {"davidScore", "SpringRank", "MFAS_INS1"} and all(r["upset_simple"] == 0.0 for r in got.values())


def test_fallback_rules(spark):
    a = spark.createDataFrame([("d", "m", None, 1.0)], "dataset string, method string, upset_simple double, runtime_sec double")
    b = spark.createDataFrame([("d", "m", 0.2, 9.0, 1), ("d", "n", 0.3, 5.0, 2), ("d", "n", 0.1, 4.0, 1)], "dataset string, method string, upset_simple double, runtime_sec double, ord int")
    got = {r["method"]: (r["upset_simple"], r["source"]) for r in results.with_fallback(a, b).collect()}
    assert got == {"m": (None, "primary"), "n": (0.1, "fallback")}


def test_best_config_takes_each_column_from_the_first_that_has_it(spark):
    df = spark.createDataFrame([("d", "m", "a", 0.1, 0.5, 0.1, None), ("d", "m", "b", 0.2, 0.4, 0.2, 7.0)], "dataset string, method string, config string, upset_simple double, upset_ratio double, upset_naive double, runtime_sec double")
    r = results.best_config(df).first()
    assert (r["config"], r["upset_ratio"], r["runtime_sec"]) == ("a", 0.5, 7.0)
    assert results.best_row(df).first()["runtime_sec"] is None


def test_percentiles(spark):
    df = spark.createDataFrame([("k", x) for x in (1.0, 2.0, 4.0, 8.0)], "k string, x double")
    assert results.nearest_rank(df, "x", 0.25, ("k",)).first()["p25"] == 2.0
    g = results.gaps(df.selectExpr("x", "0.0 z"), "x", "z").first()
    assert g["p25_gap"] == 1.75 and g["median_rel"] is None


def test_names(spark):
    df = spark.createDataFrame([("Basketball_temporal/1985", " springrank ", "3 / 80", "x" * 30)], "d string, m string, c string, k string")
    a, b = names.coverage_parts(df["c"])
    r = df.select(names.family(df["d"]), names.canonical_method(df["m"]), a, b, names.short_config(df["k"])).first()
    assert tuple(r) == ("Basketball_coarse", "SpringRank", 3, 80, "x" * 20 + "...")


def test_stream_of_windows(spark, tmp_path):
    rows = spark.sql("select timestamp '2024-01-01' + make_interval(0, 0, 0, cast(id as int)) ts, id % 3 src, (id + 1) % 3 dst, 1.0D w from range(90)")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    got = []
    q = seasons.rank_stream(seasons.windowed_edges(stream, "30 days"), lambda df, epoch: got.extend(df.collect()), rank_rel.net_wins, str(tmp_path / "check"))
    q.processAllAvailable()
    q.stop()
    assert len({r["dataset"] for r in got}) >= 2


def test_npz_round_trip_and_candidate_paths(spark, tmp_path):
    from palio.sources import writers

    e = spark.createDataFrame([("a", 5, 7, 1.5), ("a", 7, 5, 2.0), ("a", 5, 7, 1.0), ("b", 1, 2, 3.0)], "dataset string, src long, dst long, w double")
    writers.npz(e, str(tmp_path))
    got = {(r["dataset"], r["src"], r["dst"]): r["w"] for r in readers.npz_edges(spark, f"file://{tmp_path}").collect()}
    assert got == {("a", 0, 1): 2.5, ("a", 1, 0): 2.0, ("b", 0, 1): 3.0}
    assert (tmp_path / "a" / "nodes.txt").read_text() == "5\n7\n"
    assert readers.first_existing(spark, f"file://{tmp_path}", "a/").endswith("/a/adj.npz")
    assert readers.first_existing(spark, f"file://{tmp_path}", "c") is None
