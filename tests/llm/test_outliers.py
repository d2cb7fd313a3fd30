import numpy as np

from palio.llm import outliers


def test_repeats_alone_and_small_sources_are_judged(spark):
    r = np.random.default_rng(7)

    def words(n):
        return ["".join(r.choice(list("abcdefghij"), r.integers(3, 8))) for _ in range(n)]

    rows = [(i, " ".join(words(120)), "en", "s") for i in range(80)]
    for i in range(5):  # 40 of 110 words in repeated lines, less than the base rule's half
        line = " ".join(words(10))
        rows.append((100 + i, "\n".join([" ".join(words(70)), *[line] * 4]), "en", "small" if i == 4 else "s"))
    got = {x["doc_id"]: x for x in outliers.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert sum(got[i]["kept"] for i in range(80)) >= 78
    assert not any(got[100 + i]["base_failed"] or got[100 + i]["kept"] for i in range(5))


def test_the_least_determinant_of_several_starts_wins(spark):
    """A third of all rows lie in one tight clump far off: the plain covariance is drawn to it, the estimate isn't."""
    import numpy as np

    r = np.random.default_rng(8)
    good = r.normal(0, 0.3, (600, 4)) + [1.5, 0.6, 0.6, 0.6]
    bad = r.normal(0, 0.02, (150, 4)) + [4.0, 3.0, 3.0, 3.0]
    frame = spark.createDataFrame([("g", *map(float, x)) for x in np.concatenate((good, bad))], "group string, word_length double, symbols double, dup_lines double, repeats double")
    rows, _ = outliers.stored(frame, "test")
    starts, _ = outliers._starts(rows)
    assert {x["start"] for x in starts.collect()} == {0, 1, 2}
    state, _ = outliers.estimate(rows)
    got = state.first()
    assert all(abs(got[f"m_{i}"] - m) < 0.1 for i, m in enumerate([1.5, 0.6, 0.6, 0.6]))
    one = outliers._moments(rows, starts.where("start = 2"), outliers.SHARE, 0.0, 1.0).first()
    assert np.linalg.slogdet(covariance(got))[1] < np.linalg.slogdet(covariance(one))[1]


def covariance(row):
    c = np.zeros((outliers.P, outliers.P))
    for i, j in outliers._CELLS:
        c[i, j] = c[j, i] = row[f"v_{i}_{j}"]
    return c


def test_small_groups_have_estimates_of_their_own_drawn_to_wider_ones(spark):
    names = [*(f"m_{i}" for i in range(outliers.P)), *(f"v_{i}_{j}" for i, j in outliers._CELLS)]
    wide = spark.createDataFrame([("en", *[1.0] * len(names)), ("de", *[3.0] * len(names))], "lang string, " + ", ".join(f"{c} double" for c in names))
    rows = [("en", "few", 50, *[6.0] * len(names)), ("en", "none", None, *[None] * len(names)), ("de", "many", 450, *[13.0] * len(names))]
    own = spark.createDataFrame(rows, "lang string, source string, n long, " + ", ".join(f"{c} double" for c in names))
    got = {r["source"]: r for r in outliers._drawn(own, wide, ["lang"]).collect()}
    for source, want in (("few", 0.5 * 6 + 0.5 * 1), ("none", 1.0), ("many", 0.9 * 13 + 0.1 * 3)):
        assert all(abs(got[source][c] - want) < 1e-12 for c in names)


def test_a_source_is_judged_by_itself_when_it_has_rows(spark):
    """Long words are usual in one source and an outlier in the other, both of one language."""
    r = np.random.default_rng(9)

    def text(size):
        return " ".join("".join(r.choice(list("abcdefghijklmnop"), max(2, int(r.normal(size, 1))))) for _ in range(80))

    rows = [(i, text(5), "en", "plain") for i in range(600)] + [(1000 + i, text(12), "en", "long") for i in range(600)]
    rows += [(2000, text(12), "en", "plain"), (2001, text(5), "en", "long"), (2002, text(5), None, None)]
    got = {x["doc_id"]: x["kept"] for x in outliers.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not got[2000] and not got[2001]
    assert sum(got[i] for i in range(600)) > 590 and sum(got[1000 + i] for i in range(600)) > 590
