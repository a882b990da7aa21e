"""What large tables, many components, wide vectors and many batch keys need: the same numbers in bounded pieces."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from mixweave.estimator import GaussianMixture
from mixweave.functions import numeric
from mixweave.functions.params import TYPES, Mixture
from mixweave.operators import density, em, initialize, keyed, stats
from tests.test_mixture import direct_logits, frame, mixture_of

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sampling_has_no_single_task_stage(spark, monkeypatch):
    x = np.random.default_rng(0).normal(size=(500, 2))
    plans = []
    kept = initialize.least_draws
    monkeypatch.setattr(initialize, "least_draws", lambda *a: plans.append(kept(*a)) or plans[-1])
    rows = initialize.sample(frame(spark, x), 40, 3)
    assert len(rows) == 40 and len(plans) == 1
    assert "SinglePartition" not in plan_of(plans[0]) and "Sort" not in plan_of(plans[0]) and "Window" not in plan_of(plans[0])
    np.testing.assert_array_equal(rows, initialize.sample(frame(spark, x, parts=9), 40, 3))
    assert not np.array_equal(rows, initialize.sample(frame(spark, x), 40, 4))


def test_draws_of_copies_are_order_statistics():
    """A vector with n copies has the n least values of n uniform draws, in order."""
    rng = np.random.default_rng(1)
    least, third = [], []
    for h in range(4000):
        n, u = 7, rng.random()
        draws = initialize.further_draws(h, n, -math.expm1(math.log1p(-u) / n), 1.0, 50, 5)
        assert len(draws) == n and (np.diff(draws) >= 0).all() and 0 <= draws[0] and draws[-1] <= 1
        least.append(draws[0])
        third.append(draws[2])
    assert abs(np.mean(least) - 1 / 8) < 0.01 and abs(np.mean(third) - 3 / 8) < 0.015
    assert (initialize.further_draws(3, 10**12, 1e-13, 1e-9, 100, 5) < 1e-9).all()


@pytest.mark.parametrize("kind", TYPES)
@pytest.mark.parametrize("tile", [1, 7, 23])
def test_component_tiles_give_the_same(spark, monkeypatch, kind, tile):
    rng = np.random.default_rng(2)
    m, x = mixture_of(kind, rng, k=23, d=3), rng.normal(size=(120, 3)) * 2
    logits, terms = direct_logits(m, x), numeric.Terms(m)
    np.testing.assert_allclose(numeric.log_probs(terms.tiles(x, tile)), np.log(np.exp(logits).sum(axis=1)), atol=1e-9)
    np.testing.assert_array_equal(numeric.labels(terms.tiles(x, tile)), logits.argmax(axis=1))
    at, kept = numeric.top_components(terms.tiles(x, tile), 4)
    np.testing.assert_array_equal(at, np.sort(np.argsort(-logits, axis=1, kind="stable")[:, :4], axis=1))
    np.testing.assert_allclose(kept, np.take_along_axis(logits, at, axis=1), atol=1e-9)
    for mode, top in (("soft", None), ("soft", 5), ("hard", None)):
        want, total = numeric.responsibilities(logits, mode, top)
        tiles, got = numeric.tiled_responsibilities(terms, x, mode, top, tile)
        np.testing.assert_allclose(np.concatenate([r for _, r in tiles], axis=1), want, atol=1e-9)
        assert got == pytest.approx(total)
    if tile == 7:  # through Spark, in tiles of rows and record batches as well
        for module, name, value in ((numeric, "TILE", 7), (density, "ROWS", 11), (density, "MOST_VALUES", 100)):
            monkeypatch.setattr(module, name, value)
        df = frame(spark, x).union(spark.createDataFrame([(900, [1.0]), (901, None)], "row_id long, features array<double>"))
        for plain, column in ((density.with_logits, "logits"), (density.predict_proba, "proba"), (density.assign, "label"), (density.score_samples, "log_prob")):
            got = {r.row_id: r[column] for r in plain(df, m, strategy="arrow").collect()}
            assert got.pop(900) is None and got.pop(901) is None
            norm = np.log(np.exp(logits).sum(axis=1, keepdims=True))
            want = {"logits": logits, "proba": np.exp(logits - norm), "label": logits.argmax(axis=1), "log_prob": norm[:, 0]}[column]
            np.testing.assert_allclose(np.array([got[i] for i in range(len(x))]), want, atol=1e-9)
        top = {r.row_id: [(t.k, t.logit) for t in r.top] for r in density.best_components(frame(spark, x), m, 3, strategy="arrow").collect()}
        written = {r.row_id: [(t.k, t.logit) for t in r.top] for r in density.best_components(frame(spark, x), m, 3, strategy="columns").collect()}
        assert all([k for k, _ in top[i]] == [k for k, _ in written[i]] for i in top) and len(top) == len(x)
        resp, total = numeric.responsibilities(logits, "soft", 5)
        np.testing.assert_allclose(stats.soft(frame(spark, x), m, top_k=5)[0].sum_x, resp.T @ x, atol=1e-8)


def test_ties_in_tiles_go_to_the_lower_component():
    tiles = lambda width: ((lo, np.array([[1.0, 3, 3, 2, 3, 3]])[:, lo : lo + width]) for lo in range(0, 6, width))
    for width in (1, 2, 4, 6):
        assert numeric.labels(tiles(width)).tolist() == [1]
        assert numeric.top_components(tiles(width), 3)[0].tolist() == [[1, 2, 4]]


def test_vectors_are_summed_in_a_tree(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x, batch = rng.normal(size=(300, 3)), [f"b{i % 5}" for i in range(300)]
    m = Mixture("full", np.full((1, 2), 0.5), rng.normal(size=(1, 2, 3)), np.tile(np.eye(3), (1, 2, 1, 1)))
    want = stats.soft(frame(spark, x), m)[0]
    monkeypatch.setattr(stats, "FAN_IN", 3)
    monkeypatch.setattr(stats, "CHUNK", 4)  # each vector in several pieces
    monkeypatch.setattr(stats, "DIRECT", 0)
    monkeypatch.setattr(stats, "HELD", 30)  # tasks pass on what they have again and again
    packed = stats.pack(frame(spark, x, parts=40))
    for data in (packed, frame(spark, x, parts=40)):
        got = stats.soft(data, m)[0]
        for name in ("n", "log_likelihood", "nk", "sum_x", "second"):
            np.testing.assert_allclose(getattr(got, name), getattr(want, name), atol=1e-9)
    assert stats.levels(40, 10) == [14, 5, 2, 1] and stats.levels(1, 10) == []
    found = stats.moments(frame(spark, x, batch, parts=40), 3, "batch_id", n_keys=5)
    for key in set(batch):
        mine = x[[b == key for b in batch]]
        assert found[key][0] == len(mine)
        np.testing.assert_allclose(found[key][2], np.cov(mine.T, bias=True), atol=1e-9)
    packed.frame.unpersist()


def test_labelled_sums_match_one_hot():
    rng = np.random.default_rng(4)
    x, label = rng.normal(size=(200, 3)), rng.integers(0, 6, 200)
    label[label == 2] = 3
    for kind in TYPES:
        total = np.zeros(stats.Stats.width(kind, 6, 3))
        for part in np.array_split(np.arange(200), 4):
            stats.add_labelled(total, x[part], label[part], 6, kind)
        np.testing.assert_allclose(total, stats.add_up(x, np.eye(6)[label], 0.0, kind), atol=1e-9)


def test_second_moments_of_wide_vectors(spark, monkeypatch):
    rng = np.random.default_rng(5)
    d, n = 2048, 40
    x, label = rng.normal(size=(n, d)), rng.integers(0, 2, n)
    rows = [([*map(float, r)], int(k), "a" if k else None) for r, k in zip(x, label, strict=True)] + [(None, 0, "a"), ([float("nan")] + [0.0] * (d - 1), 0, "a")]
    df = spark.createDataFrame(rows, "features array<double>, label int, g string").repartition(4)
    tiles = stats.second_moments(df, "label", "g", tile=512)
    assert "SinglePartition" not in plan_of(tiles)
    found = tiles.collect()
    assert len(found) == 2 * 10 and all(len(r.stats) == 512 * 512 * 8 and r.i <= r.j for r in found)
    for r in found:
        mine = x[label == r.label]
        assert r.batch == ("a" if r.label else None)
        np.testing.assert_allclose(np.frombuffer(r.stats).reshape(512, 512), mine[:, r.i * 512 : r.i * 512 + 512].T @ mine[:, r.j * 512 : r.j * 512 + 512], atol=1e-8)
    monkeypatch.setattr(stats, "HELD", 60)  # a task holds a few tiles only
    small = df.select(F.slice("features", 1, 10).alias("features"), "label")
    cells = {(r.i, r.j): r.value for r in stats.moment_cells(stats.second_moments(small, tile=4), 4).collect()}
    assert len(cells) == 55
    np.testing.assert_allclose([cells[i, j] for i in range(10) for j in range(i, 10)], (x[:, :10].T @ x[:, :10])[np.triu_indices(10)], atol=1e-9)
    with pytest.raises(Exception, match="one length"):
        stats.second_moments(spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "features array<double>").coalesce(1)).collect()


def cost(x, centres):
    return sum(((x[lo : lo + 4096, None] - centres[None]) ** 2).sum(axis=2).min(axis=1).sum() for lo in range(0, len(x), 4096))


def test_parallel_kmeans_is_as_good_as_plus_plus(spark):
    folder = SF if os.path.isdir(SF) else pytest.skip("no test tables")
    rows = spark.read.parquet(f"{folder}/lineitem.parquet").select(F.array(F.col("l_quantity") / 10, F.col("l_extendedprice") / 10000, F.col("l_discount") * 10).alias("features"))
    x = np.array([r.features for r in rows.collect()], float)
    packed = stats.pack(rows)
    ours = np.mean([cost(x, initialize.parallel_centres(packed, 20, seed)[None]) for seed in range(3)])
    plain = np.mean([cost(x, initialize.plus_plus(x, 20, np.random.default_rng(seed))) for seed in range(3)])
    assert ours <= 1.1 * plain
    packed.frame.unpersist()
    few = stats.pack(spark.createDataFrame([([1.0],), ([2.0],)] * 50, "features array<double>"))
    assert initialize.parallel_centres(few, 3, 0)[None] is None
    assert sorted(initialize.parallel_centres(few, 2, 0)[None].ravel()) == [1.0, 2.0]
    few.frame.unpersist()


def test_many_centres_are_compared_exactly():
    rng = np.random.default_rng(6)
    centres = np.concatenate([rng.integers(-3, 4, (60, 2)).astype(float)] * 2)  # each twice, and many ties
    x = rng.integers(-3, 4, (500, 2)) + rng.choice([0.0, 0.5], (500, 2))
    want = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
    np.testing.assert_array_equal(initialize.nearest(x, centres), want)
    np.testing.assert_array_equal(initialize.nearest(x, centres[:5]), ((x[:, None] - centres[None, :5]) ** 2).sum(axis=2).argmin(axis=1))


def batches(rng):
    x, keys = [], []
    for b, n in enumerate((3000, 40, 25, 7, 3, 1)):
        x.append(rng.normal(size=(n, 2)) + rng.choice([-4.0, 4.0], (n, 1)) + 10 * b)
        keys += [f"k{b}"] * n
    return np.concatenate(x), keys


@pytest.mark.parametrize("kind", TYPES)
def test_keyed_fit_equals_the_drivers(spark, monkeypatch, kind):
    monkeypatch.setattr(keyed, "SALT_ROWS", 300)  # k0 has ten salts
    monkeypatch.setattr(keyed, "MOST_HOT", 5)
    monkeypatch.setattr(stats, "PACK_ROWS", 100)
    x, keys = batches(np.random.default_rng(7))
    x, keys = x[:-4], keys[:-4]  # the last keys have fewer rows than components
    df = frame(spark, x, keys)
    means = keyed.first_means(df, "batch_id", 2, ["row_id"])
    start = np.stack([x[[i for i, k in enumerate(keys) if k == key][:2]] for key in sorted(set(keys))])
    for options in ({}, {"em_mode": "hard"}, {"top_k": 1})[: 3 if kind == "diag" else 1]:
        want = em.fit(df, 2, kind, 3, 0.0, batch="batch_id", init_means=start, **options)
        got = keyed.fit(df, 2, kind, "batch_id", 3, 0.0, init_means=means, **options)
        np.testing.assert_allclose(got.lower_bound_history, want.lower_bound_history, rtol=1e-9)
        assert (got.n_rows, got.n_keys, got.n_iter) == (len(x), 4, 3)
        m = Mixture.from_frame(got.model, kind)
        assert m.keys == want.mixture.keys
        for name in ("weights", "means", "covariances"):
            np.testing.assert_allclose(getattr(m, name), getattr(want.mixture, name), rtol=1e-6, atol=1e-8)
    scored = keyed.predict(df, got, "batch_id", ("label", "log_prob", "proba"))
    label = {r.row_id: r.label for r in density.assign(df, want.mixture, "batch_id").collect()}
    score = {r.row_id: r.log_prob for r in density.score_samples(df, want.mixture, "batch_id").collect()}
    for r in scored.collect():
        assert r.label == label[r.row_id] and r.log_prob == pytest.approx(score[r.row_id], abs=1e-6) and sum(r.proba) == pytest.approx(1.0)


def test_keyed_step_moves_parameters_only(spark):
    x, keys = batches(np.random.default_rng(8))
    rows = frame(spark, x, keys).select(F.col("batch_id").alias("batch"), "features")
    sizes = rows.groupBy("batch").agg(F.count("*").alias("n"))
    blocks = keyed.packed_by_key(rows, sizes, len(x))
    blocks.count()
    params = keyed.with_salts(spark.createDataFrame([("k0", 3000, 0.0, b"")], "batch string, n long, log_likelihood double, params binary"))
    plan = plan_of(keyed.step(blocks, params, "diag", 2, 2, 1e-6, "soft", None)).split("ShuffledHashJoin")[1]
    left, right = plan.split("InMemoryTableScan")[0], plan
    assert "Exchange" not in left and right.count("Exchange hashpartitioning(batch") >= 1
    blocks.unpersist()


def test_keyed_starts_and_errors(spark, monkeypatch):
    x, keys = batches(np.random.default_rng(9))
    df = frame(spark, x, keys)
    monkeypatch.setattr(keyed, "START_ROWS", 200)  # k0 is sampled, the others are taken whole
    for kind in ("spherical", "tied", "full"):
        fits = [keyed.fit(df.repartition(n), 2, kind, "batch_id", 4, 0.0, seed=1) for n in (2, 5)]
        np.testing.assert_allclose(fits[0].lower_bound_history, fits[1].lower_bound_history, rtol=1e-7)
        assert fits[0].lower_bound_history[-1] >= fits[0].lower_bound_history[0]
        model = {(r.batch_id, r.k): r for r in fits[0].model.collect()}
        assert len(model) == 12 and all(np.isfinite(r.mean).all() and np.isfinite(r.cov).all() for r in model.values())
    spread = sorted(np.array(model["k0", k].mean).mean() for k in (0, 1))
    assert abs(spread[0] + 4) < 0.5 and abs(spread[1] - 4) < 0.5
    assert keyed.fit(df, 2, "diag", "batch_id", 50, 1e9, init="random").n_iter == 2
    with pytest.raises(Exception, match="lacks a batch key"):
        keyed.predict(df.withColumn("batch_id", F.lit("none")), fits[0], "batch_id").collect()
    nulls = keyed.predict(df.limit(1).withColumn("features", F.lit(None).cast("array<double>")), fits[0], "batch_id").collect()
    assert nulls[0].label is None and nulls[0].log_prob is None
    for bad in (df.withColumn("batch_id", F.lit(None).cast("string")), df.where("false"), df.union(df.limit(1).withColumn("features", F.array(F.lit(1.0)))), df.withColumn("features", F.lit(None).cast("array<double>"))):
        with pytest.raises(ValueError):
            keyed.fit(bad, 2, "diag", "batch_id")


def test_estimator_takes_many_keys_and_refuses_unknown_ones(spark, monkeypatch):
    x, keys = batches(np.random.default_rng(10))
    df = frame(spark, x, keys)
    driver = GaussianMixture(k=2, batch_col="batch_id", max_iter=3, tol=0.0).fit(df)
    monkeypatch.setattr(em, "DRIVER_SUMS", 10)
    model = GaussianMixture(k=2, batch_col="batch_id", max_iter=3, tol=0.0).fit(df)
    assert model.keyed_ is not None and model.mixture_ is None and model.n_iter_ == 3 and model.labels_.count() == len(x)
    assert model.score(df) > driver.score(df) - 0.3 and math.isfinite(model.bic(df)) and model.aic(df) - model.bic(df) == pytest.approx(model._parameters() * (2 - math.log(len(x))))
    for fitted in (driver, model):
        assert fitted.predict_proba(df).select(F.size("proba").alias("n")).distinct().collect()[0].n == 2
        for key in ("none", None):
            with pytest.raises(Exception, match="lacks"):
                fitted.predict(df.withColumn("batch_id", F.lit(key).cast("string"))).collect()
    with pytest.raises(ValueError, match="batch keys"):
        GaussianMixture(k=2, batch_col="batch_id").fit(df, init_means=np.zeros((6, 2, 2)))
    with pytest.raises(ValueError):
        em.fit(df.withColumn("batch_id", F.lit(None).cast("string")), 2, batch="batch_id")


def test_large_full_mixtures_are_allowed():
    k, d = 3, 900
    assert Mixture("full", np.full((1, k), 1 / k), np.zeros((1, k, d)), np.broadcast_to(np.eye(d), (1, k, d, d))).free_parameters() > 2_000_000 / 2
