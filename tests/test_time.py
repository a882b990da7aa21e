"""As-of joins, runs over time, levels of grouping and event-time streams against plain computations."""

import datetime as dt
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mixweave.functions.params import Mixture
from mixweave.operators import asof, em, keyed, levels, sequences
from mixweave.streaming import stepwise, windows
from tests.test_mixture import direct_logits, frame

START = dt.datetime(2024, 1, 1)
TWO = Mixture("diag", [[0.3, 0.7]], [[[0.0], [3.0]]], [[[1.0], [2.0]]])


def moment(seconds):
    return None if seconds is None else START + dt.timedelta(seconds=seconds)


@pytest.mark.parametrize("salt", [asof.SALT_ROWS, 7])
@pytest.mark.parametrize("by", [(), ("key",)])
def test_as_of_takes_the_last_version(spark, monkeypatch, salt, by):
    monkeypatch.setattr(asof, "SALT_ROWS", salt)
    rng = random.Random(1)
    keys = ["a", "a", "a", "b", None, "none"]
    rows = [(i, rng.choice(keys), moment(rng.choice([None, *range(50)])), "clash") for i in range(200)] + [(5, "a", moment(7), "clash")] * 3
    versions = [(rng.choice(["a", "b", None, "c"]), moment(rng.choice([None, *range(0, 50, 3)])), v) for v in range(30)]
    got = asof.as_of(spark.createDataFrame(rows, "id long, key string, at timestamp, value string").repartition(4), spark.createDataFrame(versions, "key string, since timestamp, value long"), "at", "since", by)
    want = []
    for i, key, at, _ in rows:
        valid = [(since, value) for k, since, value in versions if since is not None and at is not None and since <= at and (not by or k == key)]
        want.append((i, key, at, None if not valid else max(valid)[1]))
    if by:
        assert sorted(((r.id, r.key, r.at, r.version and r.version.value) for r in got.collect()), key=str) == sorted(want, key=str)
    else:  # without keys, of versions at one time the greatest row counts
        best = {(i, at): max(((s, k or "", v) for k, s, v in versions if s is not None and at is not None and s <= at), default=None, key=lambda x: x[0]) for i, _, at, _ in rows}
        assert all((r.version is None) == (best[r.id, r.at] is None) and (r.version is None or r.version.since == best[r.id, r.at][0]) for r in got.collect())
    assert got.count() == len(rows) and got.columns == ["id", "key", "at", "value", "version"]
    with pytest.raises(ValueError):
        asof.as_of(got, got, "at", "at")


def test_as_of_without_rows_or_versions(spark):
    rows, none = spark.createDataFrame([(1, moment(3))], "id long, at timestamp"), spark.createDataFrame([], "since timestamp, value long")
    assert asof.as_of(rows, none, "at", "since").first().version is None
    assert asof.as_of(rows.where("false"), none, "at", "since").count() == 0


def test_dated_mixtures(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(60, 2)), rng.normal(size=(60, 2)) + 5])
    df = frame(spark, x, ["old"] * 60 + ["new"] * 60)
    fitted = keyed.fit(df, 2, "diag", "batch_id", 3, 0.0, init_means=keyed.first_means(df, "batch_id", 2, ["row_id"]))
    m = Mixture.from_frame(fitted.model, "diag")
    since = spark.createDataFrame([("old", moment(10)), ("new", moment(20))], "batch string, since timestamp")
    rows = df.select("row_id", "features", F.timestamp_add("SECOND", (F.col("row_id") % 30).cast("int"), F.lit(START)).alias("at"))
    for r in asof.score_dated(rows, fitted, since, "at").collect():
        second = r.row_id % 30
        if second < 10:
            assert r.version is None and r.label is None and r.log_prob is None
            continue
        assert r.version == ("old" if second < 20 else "new")
        b = m.keys.index(r.version)
        one = Mixture("diag", m.weights[b][None], m.means[b][None], m.covariances[b][None])
        want = direct_logits(one, x[[r.row_id]])[0]
        assert r.label == want.argmax() and r.log_prob == pytest.approx(np.log(np.exp(want).sum()), abs=1e-8)


@pytest.mark.parametrize("rollup", [False, True])
def test_every_level_of_grouping(spark, rollup):
    rng = np.random.default_rng(3)
    x, a, b = rng.normal(size=(150, 1)) * 3, rng.choice(["u", "v", ""], 150), rng.integers(0, 3, 150)
    rows = [([float(v)], str(i) or None, int(j)) for (v,), i, j in zip(x, a, b, strict=True)]
    df = spark.createDataFrame([*rows, (None, "u", 1), ([float("nan")], "u", 1)], "features array<double>, a string, b int").repartition(3)
    logits = direct_logits(TWO, x)
    lp = np.log(np.exp(logits).sum(axis=1))
    want = {}
    for level in (0, 1, 3) if rollup else range(4):  # bit 2 for a, bit 1 for b
        groups = {}
        for i, (_, ka, kb) in enumerate(rows):
            groups.setdefault((None if level & 2 else ka, None if level & 1 else kb), []).append(i)
        want |= {(level, *key): at for key, at in groups.items()}
    got = {(r.level, r.a, r.b): r for r in levels.fit_by_level(df, TWO, ["a", "b"], rollup).collect()}
    assert got.keys() == want.keys()
    for key, at in want.items():
        r, n = got[key], len(at)
        assert r.n == n and r.log_likelihood == pytest.approx(lp[at].sum())
        assert r.aic == pytest.approx(-2 * lp[at].sum() + 10) and r.bic == pytest.approx(-2 * lp[at].sum() + 5 * np.log(n))
        np.testing.assert_allclose(r.shares, np.exp(logits[at] - lp[at, None]).mean(axis=0))
    assert levels.fit_by_level(df.where("false"), TWO, ["a", "b"]).count() == 0


def runs_by_hand(rows):
    out = []
    for key in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == key and r[1] is not None), key=lambda r: (r[1], r[2]))
        before = None
        for run, (label, group) in enumerate(itertools.groupby(mine, key=lambda r: r[3]), 1):
            group = list(group)
            scores = [r[4] for r in group if r[4] is not None]
            mean = sum(scores) / len(scores) if scores else None
            change = None if mean is None or before is None else round(mean - before, 8)
            out.append((key, run, label, group[0][2], group[-1][2], len(group), int((group[-1][1] - group[0][1]).total_seconds() * 1e6), None if mean is None else round(mean, 8), change))
            before = mean
    return sorted(out, key=str)


@pytest.mark.parametrize("slice_rows, slices", [(sequences.SLICE_ROWS, 256), (20, 2), (20, 9), (1, 40)])
def test_label_runs(spark, monkeypatch, slice_rows, slices):
    monkeypatch.setattr(sequences, "SLICE_ROWS", slice_rows)
    monkeypatch.setattr(sequences, "SLICES", slices)
    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", "b", None]), moment(rng.choice([None, *range(60)])), i, rng.choice([0, 0, 0, 1, None]), rng.choice([None, rng.random(), rng.random()])) for i in range(300)]
    rows += [("calm", moment(i * i), 1000 + i, 7, 0.5) for i in range(50)]  # one run through all slices
    df = spark.createDataFrame(rows, "user string, at timestamp, id long, label int, log_prob double").repartition(4)
    got = [(*r[:7], None if r.mean_score is None else round(r.mean_score, 8), None if r.change is None else round(r.change, 8)) for r in sequences.label_runs(df, "user", "at", "id").collect()]
    assert sorted(map(tuple, got), key=str) == runs_by_hand(rows)
    assert sequences.label_runs(df.where("false"), "user", "at", "id").count() == 0


def land(spark, rows, path):
    spark.createDataFrame(rows, "ts timestamp, features array<double>").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema("ts timestamp, features array<double>").parquet(path)


def test_windows_of_a_stream_with_late_rows(spark, tmp_path):
    where = {n: str(tmp_path / n) for n in ("in", "out", "ck")}
    first = [(moment(s), [float(s % 5)]) for s in range(0, 300, 10)] + [(None, [1.0]), (moment(5), None)]
    late = [(moment(290), [2.0]), (moment(30), [9.0]), (moment(700), [1.0])]  # 30 is over the 60 s behind 290, so its window is final
    last = [(moment(1000), [0.0])]
    for rows in (first, late, last):
        windows.write_windows(land(spark, rows, where["in"]), TWO, "ts", "100 seconds", "60 seconds", where["out"], where["ck"]).awaitTermination(120)
    got = {int((r.window_start - START).total_seconds()): r for r in spark.read.parquet(where["out"]).collect()}
    kept = [(s, x) for rows in (first, late, last) for s, x in rows if s and x and (s, x[0]) != (moment(30), 9.0)]
    final = [w for w in (0, 100, 200, 700, 1000) if w + 100 <= 1000 - 60]
    assert sorted(got) == final
    for w in final:
        x = np.array([v for s, v in kept if w <= (s - START).total_seconds() < w + 100])
        logits = direct_logits(TWO, x)
        lp = np.log(np.exp(logits).sum(axis=1))
        assert got[w].n == len(x) and got[w].log_likelihood == pytest.approx(lp.sum()) and got[w].mean_score == pytest.approx(lp.mean())
        assert got[w].label_counts == [int((logits.argmax(axis=1) == k).sum()) for k in (0, 1)]
    batch = windows.window_fit(spark.createDataFrame(first, "ts timestamp, features array<double>"), TWO, "ts", "100 seconds", slide="50 seconds")
    assert {int((r.window_start - START).total_seconds()): r.n for r in batch.collect()} == {-50: 5, 0: 10, 50: 10, 100: 10, 150: 10, 200: 10, 250: 5}


@pytest.mark.parametrize("kind", ["spherical", "diag"])
def test_stepwise_em_forgets_and_resumes(spark, tmp_path, kind):
    rng = np.random.default_rng(5)
    start = Mixture(kind, [[0.5, 0.5]], [[[0.0, 0.0], [4.0, 4.0]]], [[1.0, 1.0]] if kind == "spherical" else [[[1.0, 1.0]] * 2])
    where = {n: str(tmp_path / n) for n in ("in", "steps", "ck")}
    batches = [rng.normal(size=(40, 2)) + rng.choice([0, 4], (40, 1)) + i for i in range(3)]
    m, state = start, None
    for i, x in enumerate(batches):
        rows = [(moment(i), [*map(float, v)]) for v in x] + [(moment(i), None), (moment(i), [1.0]), (moment(i), [float("nan"), 0.0])]
        model = stepwise.StepwiseEM(start, where["steps"], 0.3)  # a new process each time: all it knows is in the folder
        stream = land(spark, [(t, v) for t, v in rows], where["in"])
        model.follow(stream, where["ck"]).awaitTermination(120)
        r = np.exp(direct_logits(m, x))
        r /= r.sum(axis=1, keepdims=True)
        now = [r.mean(axis=0), r.T @ x / 40, r.T @ (x * x) / 40]
        state = now if state is None else [0.7 * a + 0.3 * b for a, b in zip(state, now, strict=True)]
        means = state[1] / state[0][:, None]
        var = state[2] / state[0][:, None] - means**2
        m = Mixture(kind, (state[0] / state[0].sum())[None], means[None], (var.mean(axis=1) if kind == "spherical" else var)[None])
        for name in ("weights", "means", "covariances"):
            np.testing.assert_allclose(getattr(model.mixture, name), getattr(m, name), atol=1e-8)
    model.update(spark.createDataFrame([([9.0, 9.0],)], "features array<double>"), 2)  # the step was taken already
    np.testing.assert_allclose(model.mixture.means, m.means, atol=1e-8)
    model.update(spark.createDataFrame([(None,)], "features array<double>"), 3)
    np.testing.assert_allclose(model.mixture.means, m.means, atol=1e-8)
    again = stepwise.StepwiseEM(start, where["steps"])
    again.restore(spark)
    assert again.step == 3 and np.allclose(again.mixture.means, m.means)
    for bad in ({"rate": 0.0}, {"start": Mixture("tied", [[1.0]], [[[0.0]]], [[[1.0]]])}):
        with pytest.raises(ValueError):
            stepwise.StepwiseEM(**({"start": start, "path": where["steps"]} | bad))


def test_fits_of_one_week_at_rate_one_are_em_steps(spark, tmp_path):
    x = np.random.default_rng(6).normal(size=(80, 1)) * 2
    df, means = frame(spark, x), x[:2]
    want = em.fit(df, 2, "diag", 2, 0.0, init_means=means)
    model = stepwise.StepwiseEM(Mixture("diag", [[0.5, 0.5]], means[None], np.full((1, 2, 1), x.var())), str(tmp_path / "s"), 1.0)
    for step in range(2):
        model.update(df, step)
    np.testing.assert_allclose(model.mixture.means, want.mixture.means, atol=1e-6)
