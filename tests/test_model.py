"""Model operators: rows-only in the oracle, so properties here."""

import inspect

import numpy as np
import pytest
from pyspark.sql import functions as F

from perilscope.config import TARGET
from perilscope.plans import boosting as B
from perilscope.plans import model as M
from perilscope.plans import nodes as N


@pytest.fixture(scope="module")
def frame(spark):
    rows = []
    for c in range(6):
        for p in range(12):
            x1, x2 = (c * 7 + p * 3) % 11 / 10.0, (c + p) % 5 / 4.0
            rows.append((f"c{c}", p, x1, x2, 2.0 * x1 - x2 + 0.1 * (p % 2)))
    return spark.createDataFrame(rows, f"country string, period int, x1 double, "
                                       f"x2 double, {TARGET} double")


def test_search_and_importance(spark, frame):
    train = M.assemble_features(frame, ["x1", "x2"])
    cvm, draws = M.random_search_cv(train, M.forest(), {"n_estimators": [10, 20],
                                                          "max_depth": [3]}, 2,
                                      ["x1", "x2"], sample_rows=None)
    assert len(draws) == 2 and len(cvm.avgMetrics) == 2
    imp = M.feature_importance(spark, cvm.bestModel, ["x1", "x2"]).collect()
    assert abs(sum(r["importance"] for r in imp) - 1.0) < 1e-9
    assert imp[0]["importance"] >= imp[1]["importance"]
    pred = M.predict(cvm.bestModel, train, "yhat").agg(
        F.min("yhat"), F.max("yhat"), F.min(TARGET), F.max(TARGET)).first()
    assert pred[2] - 1e-9 <= pred[0] and pred[1] <= pred[3] + 1e-9


def test_boosted_and_metrics(spark, frame):
    train = M.assemble_features(frame, ["x1", "x2"])
    est = M.boosted()
    model = est.copy(M.boosted_params(est, {
        "n_estimators": 5, "max_depth": 2, "learning_rate": 0.1})).fit(train)
    assert model.getNumTrees == 5
    scored = M.predict(model, train, "yhat")
    m = M.regression_metrics(scored, TARGET, "yhat").first()
    assert m["n"] == 72 and m["rmse"] >= 0 and m["r2"] <= 1.0
    perfect = M.regression_metrics(frame.withColumn("yhat", F.col(TARGET)), TARGET, "yhat").first()
    assert perfect["rmse"] == 0.0 and perfect["r2"] == 1.0


def test_bakeoff_reports_draws_and_parameters(spark, frame):
    got = M.bakeoff(spark, frame.where("period < 9"), frame.where("period >= 9"),
                    ["x1", "x2"], models=("forest",), n_iter=2, partitions=2).collect()
    assert got[0]["draws"] == 2 and "max_depth" in got[0]["best_params"]


def test_layout_does_not_follow_the_row_count(frame):
    small = M.training_rows(M.assemble_features(frame, ["x1", "x2"]).limit(5), 3)
    assert small.rdd.getNumPartitions() == 3
    small.unpersist()


def test_every_grid_entry_changes_the_fit(spark):
    from perilscope import config as C
    for grid in (C.GRID_FOREST_FORECAST, C.GRID_FOREST_BAKEOFF):
        maps = M.param_maps(M.forest(), M.draw_grid(grid, 50))
        assert len({repr(sorted((p.name, str(v)) for p, v in m.items())) for m in maps}) \
            == len(maps)
    for grid in (C.GRID_BOOSTED, C.GRID_BOOSTED_HIST):
        names = {B.SAME.get(k, k) for k in grid}
        assert names <= set(B.DEFAULTS)


def _scores(df, value):
    return [r["s"] for r in df.withColumn("s", value).orderBy("country", "period").collect()]


def test_node_table_of_uncut_ensembles_equals_transform(spark, frame):
    train = M.assemble_features(frame, ["x1", "x2"])
    x = N.features_array()
    est = M.forest()
    model = est.copy(M.forest_params(est, {
        "n_estimators": 7, "max_depth": None, "min_samples_leaf": 1})).fit(train)
    table = N.of_model(spark, model)
    sums = table.sums(spark, x, [(30, None), (2, 1), (30, 1), (0, 1)])
    want = _scores(model.transform(train), F.col("prediction"))
    assert _scores(train, sums[0] / 7) == pytest.approx(want, abs=1e-12)
    # Cut at depth 2: each tree's value is that of its node at depth 2 or above.
    assert len(set(_scores(train, sums[1]))) <= 4 < len(set(_scores(train, sums[2])))
    assert len(set(_scores(train, sums[3]))) == 1
    # The table survives a round trip through a DataFrame.
    back = N.NodeTable.of([r.asDict() for r in table.frame(spark).collect()])
    assert back == table


def test_forest_search_scores_cuts_of_one_fit(spark, frame):
    """A draw's score is that of its cut; draws that name the same number of
    features share their fits."""
    train = M.training_rows(M.contiguous_folds(M.assemble_features(frame, ["x1", "x2"]),
                                               ["country", "period"], 3))
    draws = [{"n_estimators": n, "max_depth": d, "min_samples_leaf": 1, "max_features": f}
             for n in (4, 9) for d in (1, None) for f in ("sqrt", "log2")]
    got = M.forest_search(train, M.forest(), draws, 3)
    for a, b in zip(draws, draws[1:]):
        if {**a, "max_features": 0} == {**b, "max_features": 0} and B.features_per_split(
                a, 2) == B.features_per_split(b, 2):
            assert got[draws.index(a)] == got[draws.index(b)]
    # The largest draw is the fit itself: fold by fold it equals Spark's own score.
    k = draws.index({"n_estimators": 9, "max_depth": None, "min_samples_leaf": 1,
                     "max_features": "sqrt"})
    own = []
    for f in range(3):
        est = M.forest()
        est = est.copy(M.forest_params(est, {
            **draws[k], "max_features": str(B.features_per_split(draws[k], 2))}))
        model = est.fit(train.where(F.col("fold") != f))
        own.append(M.regression_metrics(model.transform(train.where(F.col("fold") == f)),
                                        TARGET, "prediction").first()["r2"])
    assert got[k] == pytest.approx(sum(own) / 3, abs=1e-9)
    train.unpersist()


def _toy(n=200, seed=0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 3)), 1)
    return x, np.sin(2 * x[:, 0]) + x[:, 1] * (x[:, 2] > 0) + 0.1 * rng.normal(size=n)


def _best_split(x, y):
    """Brute force over all splits of all features: the least squared error."""
    best = ((y - y.mean()) ** 2).sum()
    for f in range(x.shape[1]):
        for t in np.unique(x[:, f])[:-1]:
            a, b = y[x[:, f] <= t], y[x[:, f] > t]
            best = min(best, ((a - a.mean()) ** 2).sum() + ((b - b.mean()) ** 2).sum())
    return best


def test_boosting_without_penalties_is_plain_boosting(monkeypatch):
    monkeypatch.setattr(B, "BINS", 1000)
    x, y = _toy()
    plain = {"n_estimators": 1, "learning_rate": 1.0, "max_depth": 1}
    base, trees = B.fit(x, y, plain, 0)
    now = base + B._walk(trees[0], x)
    assert ((y - now) ** 2).sum() == pytest.approx(_best_split(x, y))
    for side in (now == now.min(), now == now.max()):       # leaves hold means
        assert now[side][0] == pytest.approx(y[side].mean())
    same = B.fit(x, y, plain | {"reg_lambda": 0, "reg_alpha": 0, "gamma": 0}, 0)
    assert same == (base, trees)


def test_penalties_shrink_leaves():
    x, y = _toy()
    def leaf(**more):
        base, trees = B.fit(x, y, {"n_estimators": 1, "max_depth": 1, "learning_rate": 1.0} | more, 0)
        return max(abs(n[4]) for n in trees[0] if n[0] < 0), len(trees[0])
    sizes = [leaf(reg_lambda=v)[0] for v in (0, 1, 10, 1000)]
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] < 0.2 * sizes[0]
    assert leaf(reg_alpha=5)[0] < sizes[0] and leaf(reg_alpha=10 ** 6)[0] == 0
    assert leaf(gamma=10 ** 6)[1] == 1                       # no split gains that much


def test_boosting_prefixes_and_node_table(spark):
    """The trees after n of a longer fit are the fit of n; scoring the node table
    in Spark equals walking the trees."""
    x, y = _toy()
    draw = {"n_estimators": 30, "max_depth": 3, "subsample": 0.7, "colsample_bytree": 0.6,
            "learning_rate": 0.2, "reg_lambda": 1, "min_child_weight": 3}
    base, trees = B.fit(x, y, draw, 1)
    assert B.fit(x, y, draw | {"n_estimators": 12}, 1)[1] == trees[:12]
    table = B.node_table(base, trees)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)],
                               "i int, x array<double>")
    got = [r["p"] for r in df.withColumn("p", table.sums(spark, F.col("x"))[0])
           .orderBy("i").collect()]
    assert got == pytest.approx(base + sum(B._walk(t, x) for t in trees), abs=1e-9)


def test_boosting_search_equals_separate_fits(spark):
    x, y = _toy(120)
    sample = (x, y, np.arange(120) // 40)
    draws = [{"n_estimators": n, "max_depth": d, "reg_lambda": 1} for n in (3, 8) for d in (1, 2)]
    got = B.search(spark, sample, draws, 3, 5)
    for d, score in zip(draws, got):
        own = []
        for f in range(3):
            train, valid = sample[2] != f, sample[2] == f
            base, trees = B.fit(x[train], y[train], d, 5)
            own.append(B.r2(y[valid], base + sum(B._walk(t, x[valid]) for t in trees)))
        assert score == pytest.approx(np.mean(own), abs=1e-9)
    model = B.fit_one(spark, sample, draws[0], 5)
    assert model == B.node_table(*B.fit(x, y, draws[0], 5))


def test_forest_draws_in_tasks(spark):
    """Cuts in depth and trees of shared fits equal the cut trees of that fit; a
    forest on all features without a bootstrap would be the best split: here its
    first split must do nearly as well."""
    x, y = _toy(150)
    sample = (x, y, np.arange(150) // 50)
    draws = [{"n_estimators": n, "max_depth": d, "min_samples_leaf": 2, "max_features": "sqrt"}
             for n in (5, 12) for d in (1, 4, None)]
    got = B.search(spark, sample, draws, 3, 7, forest=True)
    for d, score in zip(draws, got):
        own = []
        for f in range(3):
            train, valid, trees = sample[2] != f, sample[2] == f, []
            B.fit_forest(x[train], y[train], draws[-1], 7, lambda k, t: trees.append(t))
            cut = [B._walk(t, x[valid], [d["max_depth"] or 30]) for t in trees[:d["n_estimators"]]]
            own.append(B.r2(y[valid], np.mean(cut, axis=0)))
        assert score == pytest.approx(np.mean(own), abs=1e-9)
    assert got[-1] > 0.5 and got[-1] > got[0]
    trees = []
    B.fit_forest(x, y, {"n_estimators": 40, "max_depth": 1}, 1, lambda k, t: trees.append(t))
    mean = np.mean([B._walk(t, x) for t in trees], axis=0)
    assert ((y - mean) ** 2).sum() < 1.1 * _best_split(x, y)


def test_nodes_split_on_features_of_their_own():
    x, y = _toy(300)
    trees = []
    B.fit_forest(x, y, {"n_estimators": 30, "max_depth": 1, "max_features": "all"}, 3,
                 lambda k, t: trees.append(t))
    x2 = np.hstack([x, x])
    more = []
    B.fit_forest(x2, y, {"n_estimators": 60, "max_depth": 1, "max_features": "log2"}, 3,
                 lambda k, t: more.append(t))
    assert {t[0][2] for t in more} >= {0, 3} and all(len(t) == 3 for t in trees)


def test_training_sample_is_bounded_and_stable(frame):
    x, y, _ = B.training_sample(frame, ["x1", "x2"], TARGET, rows=10)
    again = B.training_sample(frame.repartition(7), ["x1", "x2"], TARGET, rows=10)
    assert x.shape == (10, 2) and (x == again[0]).all() and (y == again[1]).all()


def test_constant_features_give_one_leaf():
    base, trees = B.fit(np.ones((5, 2)), np.arange(5.0), {"n_estimators": 2}, 0)
    assert base == 2.0 and all(len(t) == 1 and abs(t[0][4]) < 1e-12 for t in trees)


def test_draw_grid_is_seeded_subset():
    grid = {"a": [1, 2, 3], "b": ["x", "y"]}
    d1, d2 = M.draw_grid(grid, 3, 42), M.draw_grid(grid, 3, 42)
    assert d1 == d2 and len(d1) == 3 and all(d in M.draw_grid(grid, 99) for d in d1)


def test_registered_bakeoffs_try_all_draws(spark, monkeypatch):
    """The queries leave the draws at the default of 20, 20 and 50."""
    from perilscope import queries as Qs
    tried, full = [], M.bakeoff

    def record(*args, **options):
        call = inspect.signature(full).bind(*args, **options)
        call.apply_defaults()
        tried.append({m: call.arguments["n_iter"][m] for m in call.arguments["models"]})
        return len(tried)
    monkeypatch.setattr(M, "bakeoff", record)
    monkeypatch.setattr(Qs, "_bakeoff_frames", lambda *a, **k: (None, None))
    monkeypatch.setattr(Qs, "_BAKEOFFS", {}, raising=False)
    for _ in range(2):
        assert (Qs.q_bakeoff(spark, "d"), Qs.q_model_comparison(spark, "d")) == (1, 2)
    assert tried == [{"forest": 20, "boosted": 20, "boosted_hist": 50},
                     {"forest": 20, "boosted": 20}]


def test_penalised_boosting_query_scores_every_test_row(spark, monkeypatch):
    """the registered query fits with the seed of the other learners."""
    from perilscope import queries as Qs
    from perilscope.config import FEATURES_BINNED
    rows = [(f"c{c}", p, *[float((c * 7 + p * 3 + j) % 11) for j in range(len(FEATURES_BINNED))],
             float((c + p) % 5)) for c in range(5) for p in range(16)]
    df = spark.createDataFrame(rows, "country string, period int, " + ", ".join(
        f"{c} double" for c in FEATURES_BINNED) + f", {TARGET} double")
    monkeypatch.setattr(Qs, "_bakeoff_frames", lambda *a, **k: (
        df.where("period < 12"), df.where("period >= 12")))
    got = Qs.QUERIES["boosted_hist_predict"](spark, "d").collect()
    assert len(got) == 20 and all(r["prediction"] is not None for r in got)
    assert {r["prediction"] for r in got} == {
        r["prediction"] for r in Qs.QUERIES["boosted_hist_predict"](spark, "d").collect()}


def test_forecast_plan_stays_small(spark):
    """the imputed rows are a table of their own, so that filters
    above them do not multiply the constraints that Catalyst keeps."""
    from perilscope.config import CLI_WEIGHTS, FEATURES_IMPROVED, HAZARDS
    from perilscope.plans import features as FE
    rows = [(f"c{c}", y, 1.0 + (c * y) % 3 if (c + y) % 4 else None, 0.5 * c, 10.0 + y % 5, 1.0 * c)
            for c in range(4) for y in range(1990, 2002)]
    df = spark.createDataFrame(rows, "country string, period int, climate_impact_index double, "
                                     "impact_rebased double, total_affected double, total_deaths double")
    df = df.withColumns({f"{h}_impact": F.col("climate_impact_index") for h in HAZARDS})
    df = df.withColumns({"hazard_count": F.lit(4), "economic_damage_pct_gdp": F.lit(0.0)})
    ft = FE.feature_table(df, 1999, excluded=[])
    stats = FE.component_stats(ft, 1999)
    pin = FE.prediction_input(FE.apply_components(ft, stats, CLI_WEIGHTS), 1999, 1998, 2001)
    plan = pin._jdf.queryExecution().optimizedPlan()
    assert "Relation" in plan.toString() and "Project" not in plan.toString()
    ready = M.assemble_features(pin, FEATURES_IMPROVED, None).drop("features", *FE.COMPONENTS, "CLI")
    scored = FE.score_latest(ready, stats, [])
    assert scored._jdf.queryExecution().optimizedPlan().constraints().size() < 500
    assert scored.count() == 4


@pytest.mark.parametrize("most", [10, 71, 72])
def test_search_leaves_no_row_out(spark, frame, monkeypatch, most):
    """The draws are scored on all rows, below the bound in tasks and
    above it by Spark's forests."""
    train = M.assemble_features(frame, ["x1", "x2"])
    grid = {"n_estimators": [4, 9], "max_depth": [2, None]}
    draws = M.draw_grid(grid, 4)
    seen, search = [], B.search
    monkeypatch.setattr(B, "search", lambda s, table, *a, **k: (
        seen.append(len(table[1])), search(s, table, *a, **k))[1])
    got, _ = M.random_search_cv(train, M.forest(), grid, 4, ["x1", "x2"], sample_rows=most)
    data = M.training_rows(M.contiguous_folds(train, ["country", "period"], 3))
    if most < 72:
        est = M.forest()
        want = M.forest_search(data, est.copy({est.maxBins: M.bins_for(72)}), draws, 3)
    else:
        rows = sorted(data.select("country", "period", "x1", "x2", TARGET, "fold").collect())
        want = search(spark, (np.array([r[2:4] for r in rows]), np.array([r[4] for r in rows]),
                              np.array([r[5] for r in rows])), draws, 3, M.SEED, forest=True)
    data.unpersist()
    assert seen == ([72] if most == 72 else [])
    assert got.avgMetrics == pytest.approx(want, abs=1e-9)
    assert got.bestIndex == max(range(4), key=lambda i: want[i])


def test_training_table_has_every_row_in_order(frame):
    """rows of equal keys stay, whatever the layout."""
    twice = frame.union(frame)
    for df in (twice, twice.repartition(5)):
        x, y, fold = B.training_table(df, ["x1", "x2"], TARGET)
        rows = sorted(tuple(r) for r in twice.collect())
        assert x.tolist() == [[r[2], r[3]] for r in rows]
        assert y.tolist() == [r[4] for r in rows] and not fold.any()


@pytest.mark.parametrize("least, rounded, few", [(1, 0, 0), (1, 1, 0), (1, 1, 1 << 15), (4, 1, 0)])
def test_every_split_is_the_best_of_its_node(monkeypatch, least, rounded, few):
    """all rows of a node count, however many nodes a level has and whatever is
    held at once."""
    monkeypatch.setattr(B, "FEW_CELLS", few, raising=False)
    rng = np.random.default_rng(least)
    x, y = np.round(rng.normal(size=(90, 3)), rounded), rng.normal(size=90)
    edges, binned = B._binned(x)
    nodes = B._tree(binned, edges, -y, B.DEFAULTS | {"max_depth": 30, "min_rows": least},
                    np.arange(3))
    own, deep = {0: np.arange(90)}, 0
    for k, (left, right, feature, threshold, value) in enumerate(nodes):
        rows = own[k]
        assert value == pytest.approx(y[rows].mean())
        best = {(f, t): sum(((s - s.mean()) ** 2).sum() for s in (y[rows][a], y[rows][~a]))
                for f in range(3) for t in edges[f] if (a := x[rows, f] <= t).sum() >= least
                and (~a).sum() >= least}
        if left < 0:
            assert not best or min(best.values()) == pytest.approx(((y[rows] - value) ** 2).sum())
            continue
        assert best[feature, threshold] == pytest.approx(min(best.values()))
        a = x[rows, feature] <= threshold
        own[left], own[right], deep = rows[a], rows[~a], deep + 1
    assert deep > 10


def test_trees_do_not_follow_what_is_held_at_once(monkeypatch):
    x, y = _toy(400)
    grown = []
    for cells, few in ((1, 0), (300, 0), (1 << 20, 0), (1 << 20, 1 << 15)):
        monkeypatch.setattr(B, "CELLS", cells)
        monkeypatch.setattr(B, "FEW_CELLS", few)
        trees = []
        B.fit_forest(x, y, {"n_estimators": 3, "max_features": "sqrt"}, 5,
                     lambda k, t: trees.append(t))
        grown.append(trees)
    assert all(trees == grown[0] for trees in grown) and len(grown[0][0]) > 100


def test_memory_of_a_tree_follows_its_rows():
    """a level of thousands of nodes does not hold every bin of every feature of
    each."""
    import tracemalloc
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(20_000, 18)), rng.normal(size=20_000)
    edges, binned = B._binned(x)
    tracemalloc.start()
    nodes = B._tree(binned, edges, -y, B.DEFAULTS | {"max_depth": 30}, np.arange(18))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(nodes) > 20_000 and peak < 80 << 20


def test_thresholds_come_from_all_rows():
    """Spark's learner finds its thresholds on a sample of bins x bins rows."""
    for rows in [*range(3000), 65_536, 65_537, 200_000, 10 ** 6, 123_456_789]:
        bins = M.bins_for(rows)
        assert bins ** 2 >= rows
        assert rows > 65_536 or bins == max(32, min(256, rows // 8))
