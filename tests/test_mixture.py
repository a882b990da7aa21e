"""The mixture engine against direct formulas in numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mixweave.estimator import GaussianMixture
from mixweave.functions import numeric
from mixweave.functions.params import TYPES, Mixture
from mixweave.operators import density, em, finalize, initialize, stats
from mixweave.plans import queries
from mixweave.sources import datasets, features, models
from mixweave.streaming import scoring


def frame(spark, x, batch=None, parts=3):
    rows = [(i, [float(v) for v in r], *([] if batch is None else [str(batch[i])])) for i, r in enumerate(x)]
    schema = "row_id long, features array<double>" + (", batch_id string" if batch is not None else "")
    return spark.createDataFrame(rows, schema).repartition(parts)


def mixture_of(kind, rng, k=3, d=3):
    a = rng.normal(size=(k, d, d))
    spd = a @ np.swapaxes(a, 1, 2) / d + 0.5 * np.eye(d)
    cov = {"spherical": rng.uniform(0.5, 1.5, k), "diag": rng.uniform(0.5, 1.5, (k, d)), "tied": spd[0], "full": spd}[kind]
    w = rng.uniform(0.5, 1, k)
    return Mixture(kind, (w / w.sum())[None], rng.normal(size=(1, k, d)) * 2, cov[None])


def direct_logits(m, x):
    """Joint log-densities from the definition, one row and component at a time."""
    _, k, d = m.shape
    out = np.empty((len(x), k))
    for j in range(k):
        cov = {"spherical": lambda: np.eye(d) * m.covariances[0, j], "diag": lambda: np.diag(m.covariances[0, j]), "tied": lambda: m.covariances[0], "full": lambda: m.covariances[0, j]}[m.kind]()
        diff = x - m.means[0, j]
        out[:, j] = math.log(m.weights[0, j]) - 0.5 * (np.einsum("nd,de,ne->n", diff, np.linalg.inv(cov), diff) + d * math.log(2 * math.pi) + np.linalg.slogdet(cov)[1])
    return out


def collected(df, column):
    return np.array([r[0] for r in df.orderBy("row_id").select(column).collect()])


@pytest.mark.parametrize("kind", TYPES)
@pytest.mark.parametrize("strategy", ["columns", "arrow"])
def test_inference(spark, kind, strategy):
    rng = np.random.default_rng(1)
    m, x = mixture_of(kind, rng), rng.normal(size=(60, 3)) * 2
    want = direct_logits(m, x)
    df = frame(spark, x)
    np.testing.assert_allclose(collected(density.with_logits(df, m, strategy=strategy), "logits"), want, atol=1e-9)
    assert (collected(density.assign(df, m, strategy=strategy), "label") == want.argmax(axis=1)).all()
    lse = np.log(np.exp(want).sum(axis=1))
    np.testing.assert_allclose(collected(density.score_samples(df, m, strategy=strategy), "log_prob"), lse, atol=1e-9)
    proba = collected(density.predict_proba(df, m, strategy=strategy), "proba")
    np.testing.assert_allclose(proba, np.exp(want - lse[:, None]), atol=1e-9)


@pytest.mark.parametrize("kind", TYPES)
@pytest.mark.parametrize(("mode", "top_k"), [("soft", None), ("hard", None), ("soft", 2)])
def test_statistics_agree_between_strategies(spark, kind, mode, top_k):
    rng = np.random.default_rng(2)
    m, x = mixture_of(kind, rng), rng.normal(size=(80, 3))
    df = frame(spark, x)
    resp, total = numeric.responsibilities(direct_logits(m, x), mode, top_k)
    want = stats.Stats.unpack(stats.add_up(x, resp, total, kind), kind, 3, 3)
    for strategy in ("columns", "arrow"):
        got = stats.soft(df, m, mode=mode, top_k=top_k, strategy=strategy)[0]
        for name in ("n", "log_likelihood", "nk", "sum_x", "second"):
            if getattr(want, name) is not None:
                np.testing.assert_allclose(getattr(got, name), getattr(want, name), atol=1e-8, err_msg=name)


def test_top_components_take_the_lower_of_equal_ones(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0, 2.0],)], "logit array<double>")
    top = df.select(density.top_components(F.col("logit"), 3)).first()[0]
    assert [(t.k, t.logit) for t in top] == [(1, 3.0), (2, 3.0), (3, 2.0)]
    np.testing.assert_array_equal(np.isfinite(numeric.kept_top(np.array([[1.0, 3, 3, 3]]), 2)), [[False, True, True, False]])
    assert density.label(F.col("logit")) is not None and df.select(density.label(F.col("logit"))).first()[0] == 1


def test_finalize_keeps_an_empty_component():
    s = stats.Stats(5, 0.0, np.array([5.0, 0]), np.array([[10.0, 20], [0, 0]]), np.array([[60.0, 90], [0, 0]]))
    old = Mixture("diag", [[0.5, 0.5]], [[[0, 0], [99, 99]]], [[[1, 1], [42, 42]]])
    new = finalize.update(old, [s], 1e-6)
    np.testing.assert_allclose(new.means[0], [[2, 4], [99, 99]])
    np.testing.assert_allclose(new.covariances[0], [[8, 2], [42, 42]])
    np.testing.assert_allclose(new.weights[0], [1, 1e-8], rtol=1e-6)


def test_finalize_clamps_and_full_keeps_old():
    one = stats.Stats(1, 0.0, np.array([1.0]), np.array([[1.0, 1]]), np.array([[1.0, 1]]))
    assert (finalize.update(Mixture("diag", [[1]], [[[0, 0]]], [[[1, 1]]]), [one], 1e-3).covariances == 1e-3).all()
    d = 4
    s = stats.Stats(2, 0.0, np.array([1.0, 0, 1]), np.zeros((3, d)), np.stack([5 * np.eye(d), np.zeros((d, d)), 5 * np.eye(d)]))
    old = Mixture("full", [[1 / 3] * 3], np.full((1, 3, d), 99.0), np.tile(42 * np.eye(d), (1, 3, 1, 1)))
    new = finalize.update(old, [s], 1e-6)
    assert (new.means[0, 1] == 99).all() and (new.covariances[0, 1] == 42 * np.eye(d)).all()
    half = stats.Stats(2, 0.0, np.array([0.5, 1.5]), np.array([[0.5, 0], [0, 1.5]]), None)
    got = finalize.update(Mixture("tied", [[0.5, 0.5]], np.zeros((1, 2, 2)), np.eye(2)[None]), [half], 1e-6, {None: np.eye(2)})
    np.testing.assert_allclose(got.means[0], [[1, 0], [0, 1]])
    np.testing.assert_allclose(got.weights[0], [0.25, 0.75])


@pytest.mark.parametrize("kind", TYPES)
def test_fit_improves_and_doesnt_depend_on_partitions(spark, kind):
    data = datasets.anisotropic_blobs(spark, 400, 3, 3, seed=3)
    means = np.array([r[0] for r in data.orderBy("row_id").limit(3).select("features").collect()])
    one = em.fit(data.repartition(1), 3, kind, max_iter=6, tol=0.0, init_means=means)
    many = em.fit(data.repartition(7), 3, kind, max_iter=6, tol=0.0, init_means=means, strategy="columns")
    assert one.init_source == "user" and one.n_iter == 6
    assert all(b >= a - 1e-9 for a, b in zip(one.lower_bound_history, one.lower_bound_history[1:], strict=False))
    np.testing.assert_allclose(one.mixture.means, many.mixture.means, atol=1e-8)
    np.testing.assert_allclose(one.mixture.covariances, many.mixture.covariances, atol=1e-8)
    np.testing.assert_allclose(one.lower_bound_history, many.lower_bound_history, atol=1e-9)


def test_hard_isnt_soft_and_early_stop(spark):
    x = np.random.default_rng(4).normal(size=(200, 2))
    df, means = frame(spark, x), x[:3]
    soft, hard = (em.fit(df, 3, max_iter=5, tol=0.0, init_means=means, em_mode=m) for m in em.MODES)
    assert np.abs(soft.mixture.means - hard.mixture.means).max() > 1e-3
    assert em.fit(df, 3, tol=1e9, init_means=means).n_iter == 2
    assert em.fit(df, 3, max_iter=1, tol=1e9, init_means=means).n_iter == 1


def test_batches_fit_alone_and_stop_together(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(90, 2)), rng.normal(size=(40, 2)) + 50])
    batch = ["a"] * 90 + ["b"] * 40
    means = np.stack([x[:2], x[90:92]])
    both = em.fit(frame(spark, x, batch), 2, max_iter=4, tol=0.0, batch="batch_id", init_means=means)
    for b, rows in ((0, x[:90]), (1, x[90:])):
        alone = em.fit(frame(spark, rows), 2, max_iter=4, tol=0.0, init_means=means[b])
        np.testing.assert_allclose(both.mixture.means[b], alone.mixture.means[0], atol=1e-8)
    scored = density.score_samples(frame(spark, x, batch).withColumn("batch_id", F.when(F.col("row_id") < 3, "none").otherwise(F.col("batch_id"))), both.mixture, "batch_id")
    assert scored.where("log_prob is null").count() == 3


def test_estimator_finds_blobs(spark):
    data = datasets.blobs(spark, 600, 3, 3, seed=9, spread=8.0)
    for kind in TYPES:
        model = GaussianMixture(n_components=3, covariance_type=kind, random_state=1, max_iter=20)
        got = model.fit_predict(data)
        table = got.groupBy("component", "label").count().collect()
        assert len(table) == 3 and {r["label"] for r in table} == {0, 1, 2}
        assert model.init_source_ == "kmeans" and abs(model.weights_.sum() - 1) < 1e-9
        assert np.isfinite([model.bic(data), model.aic(data), model.score(data)]).all()
    model.set_params(k=2)
    assert model.means_ is None and model.get_params()["n_components"] == 2
    with pytest.raises(RuntimeError):
        model.predict(data)


def test_parameters_are_checked(spark):
    for bad in ({}, {"k": 0}, {"k": 2, "tol": -1}, {"k": 2, "n_components": 3}, {"k": 2, "covariance_type": "x"}, {"k": 2, "init_params": "x"}, {"k": 2, "approx_top_k": 0}, {"k": 2, "nonsense": 1}):
        with pytest.raises(ValueError):
            GaussianMixture(**bad)
    empty = spark.createDataFrame([], "features array<double>")
    ragged = spark.createDataFrame([([1.0, 2.0],), ([1.0],)], "features array<double>")
    holes = spark.createDataFrame([([1.0, None],), (None,)], "features array<double>")
    for data in (empty, ragged, holes):
        with pytest.raises(ValueError):
            GaussianMixture(k=1).fit(data)
    m = Mixture("diag", [[1.0]], [[[0.0, 0.0]]], [[[1.0, 1.0]]])
    for strategy in ("columns", "arrow"):
        assert [r.label for r in density.assign(ragged.union(holes), m, strategy=strategy).collect()] == [0, None, None, None]


def test_edge_shapes(spark):
    same = spark.createDataFrame([([2.0],)] * 5, "features array<double>")
    got = em.fit(same, 1, "diag", init="random", reg_covar=1e-3, max_iter=3)
    assert got.mixture.means[0, 0, 0] == pytest.approx(2.0) and got.mixture.covariances[0, 0, 0] == pytest.approx(1e-3)
    assert em.fit(same.limit(2), 4, init="kmeans", max_iter=2).mixture.shape == (1, 4, 1)
    far = frame(spark, np.random.default_rng(0).normal(size=(100, 2)) + 1e7)
    assert em.fit(far, 2, "full", max_iter=3).mixture.covariances[0, 0, 0, 0] < 10


def test_sample_draws_rows_not_vectors(spark):
    hot = spark.range(12_000).select(F.array(F.when(F.col("id") % 3 == 0, -1.0).otherwise(F.col("id").cast("double"))).alias("features"))
    rows = initialize.sample(hot, 1000, 5)
    assert rows.shape == (1000, 1) and 250 < (rows == -1).sum() < 420
    np.testing.assert_array_equal(rows, initialize.sample(hot.repartition(7), 1000, 5))
    few = spark.range(20_000).select(F.array((F.col("id") % 4).cast("double")).alias("features"))
    counts = np.unique(initialize.sample(few, 4096, 5), return_counts=True)[1]
    assert len(counts) == 4 and counts.min() > 850
    assert len(initialize.sample(few.limit(9), 4096, 5)) == 9


def test_plus_plus_and_lloyd(spark):
    data = datasets.blobs(spark, 300, 2, 4, seed=2, spread=20.0)
    rows = initialize.sample(data, 300, 1)
    centres = initialize.plus_plus(rows, 4, np.random.default_rng(0))
    assert len(np.unique(centres, axis=0)) == 4 and initialize.plus_plus(rows, 400, np.random.default_rng(0)) is None
    moved = initialize.lloyd(data, {None: centres}, 10, 1e-6)[None]
    truth = np.array([r[1] for r in sorted(data.groupBy("component").agg(F.array(F.avg(F.col("features")[0]), F.avg(F.col("features")[1]))).collect())])
    assert max(np.abs(truth - c).sum(axis=1).min() for c in moved) < 1e-6


def test_models_stream_and_scaling(spark, tmp_path):
    rng = np.random.default_rng(6)
    for kind in TYPES:
        m = mixture_of(kind, rng)
        models.save(spark, m, str(tmp_path / kind))
        back = models.load(spark, str(tmp_path / kind))
        np.testing.assert_allclose(back.covariances, m.covariances)
        assert back.free_parameters() == m.free_parameters()
    x = rng.normal(size=(20, 3))
    frame(spark, x).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("row_id long, features array<double>").parquet(str(tmp_path / "in"))
    scoring.write_scored(stream, m, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert (collected(out, "label") == direct_logits(m, x).argmax(axis=1)).all()
    scaled = features.standard_scaled(spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double"), ["a", "b"]).collect()
    assert sorted((r.a, r.b) for r in scaled) == [(-1.0, 0.0), (1.0, 0.0)]


def test_precision_jitter():
    w, logdet = numeric.precision(np.array([[4.0, 0], [0, 1]]))
    np.testing.assert_allclose(w @ w.T, [[0.25, 0], [0, 1]])
    assert logdet == pytest.approx(math.log(4))
    numeric.precision(np.ones((2, 2)))
    with pytest.raises(ValueError):
        numeric.precision(np.array([[1.0, 0], [0, -5]]))


def test_other_widths_and_top_k_are_errors(spark):
    model = GaussianMixture(k=2, max_iter=2).fit(frame(spark, np.random.default_rng(1).normal(size=(30, 2))))
    wide = spark.createDataFrame([([1.0, 2.0, 3.0],)], "features array<double>")
    for predicted in (model.predict, model.predict_proba, model.score_samples):
        with pytest.raises(Exception, match="2 features"):
            predicted(wide).collect()
    none = spark.createDataFrame([(None,)], "features array<double>")
    assert model.predict(none).first().label is None
    for bad in (0, 2, 3):
        with pytest.raises(ValueError):
            stats.soft(wide, Mixture("diag", [[0.5, 0.5]], np.zeros((1, 2, 3)), np.ones((1, 2, 3))), top_k=bad)
    with pytest.raises(ValueError):
        density.top_components(F.col("logits"), 0)


def test_tied_keeps_a_covariance_that_cant_be_factored():
    s = stats.Stats(2, 0.0, np.array([2.0]), np.array([[2.0, 2.0]]), None)
    old = Mixture("tied", [[1.0]], np.zeros((1, 1, 2)), 7 * np.eye(2)[None])
    new = finalize.update(old, [s], 1e-6, {None: np.array([[-50.0, 0], [0, -50.0]])})
    assert (new.covariances[0] == 7 * np.eye(2)).all() and (new.means[0] == 1).all()


def test_hard_statistics_wide_and_plain_agree(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x, label, batch = rng.normal(size=(70, 5)), rng.integers(-1, 4, 70), rng.integers(0, 2, 70)
    df = spark.createDataFrame([([*map(float, r)], int(k), str(b)) for r, k, b in zip(x, label, batch, strict=True)], "features array<double>, label int, g string").repartition(3)
    for kind in TYPES:
        for by in (None, "g"):
            plain = {(r[by] if by else None, r.label): r for r in stats.hard(df, 3, kind, batch=by).collect()}
            with monkeypatch.context() as m:
                m.setattr(stats, "WIDEST_SUMS", 0)
                wide = {(r[by] if by else None, r.label): r for r in stats.hard(df, 3, kind, batch=by).collect()}
            assert plain.keys() == wide.keys() and len(plain) == (6 if by else 3)
            for key, r in plain.items():
                assert r.nk == wide[key].nk
                np.testing.assert_allclose(r.sum_x, wide[key].sum_x, atol=1e-9)
                assert ("second" in r) == (kind != "tied")
                if kind != "tied":
                    np.testing.assert_allclose(r.second, wide[key].second, atol=1e-9)


def rand_index(pairs):
    """Adjusted Rand index of (class, label, n)."""
    two = lambda n: n * (n - 1) / 2
    a, b, total = {}, {}, 0
    for c, k, n in pairs:
        a[c], b[k], total = a.get(c, 0) + n, b.get(k, 0) + n, total + n
    both, left, right = sum(two(n) for _, _, n in pairs), sum(map(two, a.values())), sum(map(two, b.values()))
    mean = left * right / two(total)
    return (both - mean) / ((left + right) / 2 - mean)


def test_quality_gates(spark):
    data = datasets.blobs(spark, 900, 4, 4, seed=11, spread=10.0).persist()  # far apart: a start misses none of them
    got = GaussianMixture(k=4, random_state=3, max_iter=30).fit_predict(data)
    assert rand_index([tuple(r) for r in got.groupBy("component", "label").count().collect()]) >= 0.95
    stretched = datasets.anisotropic_blobs(spark, 900, 4, 3, seed=12, spread=4.0).persist()
    score = {kind: GaussianMixture(k=3, covariance_type=kind, random_state=3, max_iter=30).fit(stretched).score(stretched) for kind in TYPES}
    assert score["full"] > score["spherical"] and score["tied"] > score["spherical"]


def test_starts_of_many_components_and_batches(spark):
    x = np.random.default_rng(2).normal(size=(700, 2))
    rows = initialize.sample(frame(spark, x), 700, 1)
    centres = initialize.plus_plus(rows, 300, np.random.default_rng(0))
    assert len(np.unique(centres, axis=0)) == 300
    batch = [i % 3 for i in range(700)]
    drawn = initialize.samples(frame(spark, x, batch), {"0": 50, "1": 5, "2": 1000}, 4, "batch_id")
    assert {k: len(v) for k, v in drawn.items()} == {"0": 50, "1": 5, "2": 233}
    assert all({tuple(r) for r in v} <= {tuple(x[i]) for i in range(700) if str(batch[i]) == k} for k, v in drawn.items())
    few = em.fit(frame(spark, x[:4]), 6, max_iter=1)
    assert few.init_source == "kmeans_random"


def test_many_partitions_are_summed_in_groups(spark):
    x = np.random.default_rng(8).normal(size=(200, 2))
    m = Mixture("diag", [[1.0]], [[[0.0, 0.0]]], [[[1.0, 1.0]]])
    got = stats.soft(frame(spark, x, parts=50), m)[0]
    assert got.n == 200
    np.testing.assert_allclose(got.sum_x[0], x.sum(axis=0))


def test_start_spreads_lose_no_digits(spark):
    """Spreads around the nearest centre, far from 0 and at a decimal tie."""
    data = spark.createDataFrame([([1e6 + 0.001 * (i % 4)],) for i in range(4000)], "features array<double>")
    centres = np.array([[1e6]])
    found = initialize.nearest_stats(data, {None: centres}, kind="full", around=True)[None]
    _, cov = initialize.label_parameters("tied", found, np.zeros((1, 1)), np.eye(1), 0.0)
    np.testing.assert_allclose(cov, [[3.5e-6]], rtol=1e-6)


def test_start_spread_at_a_decimal_tie(spark):
    """At sf0.01 one spread is 0.9021295 exactly: halves are rounded up, however the sums are split."""
    found = queries.queries()["init_stats_tied"](spark, "/root/testdata/sf0.01")
    assert found.where("part = 'cov' and i = 0 and j = 0").first().value == 0.90213
