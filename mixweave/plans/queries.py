"""The registered queries: each applies operators of the engine to a whole fixture."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixweave.functions.params import TYPES, Mixture, long_frame
from mixweave.operators import asof, density, em, finalize, initialize, keyed, levels, sequences, stats
from mixweave.plans.fixtures import FIXTURES, REG, data, first_rows, user_start
from mixweave.sources import datasets
from mixweave.sources.features import standard_scaled, vector
from mixweave.sources.tables import shared_folder, written
from mixweave.streaming import stepwise, windows

DIGITS = 6
EXACT = 12  # digits that sums of squared differences have right
ITERATIONS = 3
TOP_K = 2
WIDE = {"spherical": "emb64", "diag": "emb64", "tied": "li2", "full": "li2"}
FITTED = {"spherical": "li4", "diag": "li4", "tied": "li2", "full": "li2"}

Query = Callable[[SparkSession, str], DataFrame]


def rounded(column) -> F.Column:
    return F.round(column, DIGITS) + 0.0


# posexplode_outer throughout: posexplode makes Spark infer a filter on the array, which computes it twice


def per_component(rows: DataFrame, name: str, values: str, alias: str) -> DataFrame:
    return rows.select(*FIXTURES[name].keys, F.posexplode_outer(values).alias("k", "v")).select(*FIXTURES[name].keys, "k", rounded("v").alias(alias))


def logits(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    name = WIDE[kind]
    rows = data(spark, sf_dir, name)
    return per_component(density.with_logits(rows, user_start(rows, name, kind)), name, "logits", "logit")


def assign(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    rows = data(spark, sf_dir, WIDE[kind])
    return density.assign(rows, user_start(rows, WIDE[kind], kind)).select(*FIXTURES[WIDE[kind]].keys, "label")


def score_samples(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    rows = data(spark, sf_dir, WIDE[kind])
    return density.score_samples(rows, user_start(rows, WIDE[kind], kind)).select(*FIXTURES[WIDE[kind]].keys, rounded("log_prob").alias("log_prob"))


def predict_proba(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    rows = data(spark, sf_dir, WIDE[kind])
    return per_component(density.predict_proba(rows, user_start(rows, WIDE[kind], kind)), WIDE[kind], "proba", "p")


def criteria(spark: SparkSession, sf_dir: str, kind: str, what: str) -> DataFrame:
    rows = data(spark, sf_dir, WIDE[kind])
    mixture = user_start(rows, WIDE[kind], kind)
    sums = density.score_samples(rows, mixture).agg(F.sum("log_prob").alias("s"), F.count("log_prob").alias("n"))
    p = float(mixture.free_parameters())
    value = {"score": F.col("s") / F.col("n"), "aic": -2 * F.col("s") + 2 * p, "bic": -2 * F.col("s") + p * F.log("n")}[what]
    return sums.select(rounded(value).alias(what))


def stats_frame(spark: SparkSession, found: stats.Stats, log_likelihood: bool = True) -> DataFrame:
    parts = {"nk": found.nk, "sum_x": found.sum_x} | ({"second": found.second} if found.second is not None else {}) | ({"log_likelihood": np.array(found.log_likelihood)} if log_likelihood else {})
    return long_frame(spark, [None], {n: v[None] for n, v in parts.items()}, digits=DIGITS).drop("batch_id")


def soft_stats(spark: SparkSession, sf_dir: str, kind: str, top_k: int | None = None, name: str = "", strategy: str = "arrow") -> DataFrame:
    name = name or FITTED[kind]
    rows = data(spark, sf_dir, name)
    return stats_frame(spark, stats.soft(rows, user_start(rows, name, kind), top_k=top_k, strategy=strategy)[0])


def xx_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_frame(spark, [None], {"xx": stats.total_xx(data(spark, sf_dir, "li2"), 2)[None][None]}, {"xx"}, DIGITS).drop("batch_id", "k")


def weighted_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics under given responsibilities, here those of the start, as a column."""
    f, rows = FIXTURES["li4"], data(spark, sf_dir, "li4")
    given = density.predict_proba(rows, user_start(rows, "li4", "spherical")).withColumnRenamed("proba", "resp")
    return stats_frame(spark, stats.weighted(given, "spherical", f.k, f.d)[None], False)


def hard_stats(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    name = WIDE[kind]
    rows = data(spark, sf_dir, name)
    found = stats.hard(density.assign(rows, user_start(rows, name, kind)), FIXTURES[name].k, kind)
    flat = found.select("label", F.posexplode_outer(F.concat(F.array("nk"), "sum_x", "second")).alias("pos", "v"))
    return flat.select("label", "pos", rounded("v").alias("value"))


def params_frame(spark: SparkSession, mixture) -> DataFrame:
    return mixture.to_long(spark, DIGITS)


def finalized(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Parameters from hard statistics in which component 0 is emptied: it keeps its own."""
    name = FITTED[kind]
    f, rows = FIXTURES[name], data(spark, sf_dir, name)
    start = user_start(rows, name, kind)
    labelled = density.assign(rows, start).where("label > 0")
    one_hot = F.transform(F.sequence(F.lit(0), F.lit(f.k - 1)), lambda i: (i == F.col("label")).cast("double"))
    found = stats.weighted(labelled.withColumn("resp", one_hot), kind, f.k, f.d)
    xx = stats.total_xx(labelled, f.d) if kind == "tied" else None
    return params_frame(spark, finalize.update(start, [found[None]], REG, xx))


def global_moments(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return params_frame(spark, user_start(data(spark, sf_dir, FITTED[kind]), FITTED[kind], kind))


def init_stats(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Weights and spreads of the rows nearest to the first rows."""
    name = FITTED[kind]
    f, rows = FIXTURES[name], data(spark, sf_dir, name)
    centres = first_rows(rows, f)[1][0]
    found = initialize.nearest_stats(rows, {None: centres}, kind="full" if kind == "tied" else kind, around=True)[None]
    weights, cov = initialize.label_parameters(kind, found, np.zeros_like(centres), stats.moments(rows, f.d)[None][2], REG)
    # the features are decimals, so a spread may lie halfway between two of 6 digits: the last bits of a sum must not decide
    return long_frame(spark, [None], {"weight": weights[None], "cov": np.round(cov, EXACT)[None]}, {"cov"} if kind == "tied" else set(), DIGITS)


def topk_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = data(spark, sf_dir, "emb64")
    found = density.best_components(rows, user_start(rows, "emb64", "diag"), TOP_K)
    return found.select("vec_id", F.posexplode_outer("top").alias("place", "t")).select("vec_id", "place", F.col("t.k").alias("k"), rounded("t.logit").alias("logit"))


def fitted(rows: DataFrame, name: str, kind: str, **options) -> em.FitReport:
    f = FIXTURES[name]
    means = first_rows(rows, f)[1]
    return em.fit(rows, f.k, kind, batch="batch_id" if f.batch else None, init_means=means, reg_covar=REG, **({"max_iter": ITERATIONS, "tol": 0.0} | options))


def em_params(spark: SparkSession, sf_dir: str, kind: str, name: str = "", **options) -> DataFrame:
    name = name or FITTED[kind]
    return params_frame(spark, fitted(data(spark, sf_dir, name), name, kind, **options).mixture)


def user_fit(spark: SparkSession, sf_dir: str, kind: str) -> tuple[DataFrame, keyed.KeyedFit]:
    """The events and a mixture for each user, fitted on the executors from the user's first events."""
    f, rows = FIXTURES["ev1u"], data(spark, sf_dir, "ev1u")
    means = keyed.first_means(rows, "batch_id", f.k, list(f.keys))
    return rows, keyed.fit(rows, f.k, kind, "batch_id", ITERATIONS, 0.0, reg_covar=REG, init_means=means)


def em_keyed_users(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    model = user_fit(spark, sf_dir, kind)[1].model
    number = lambda part, value, i: F.struct(F.lit(part).alias("part"), value.alias("value"), i.cast("int").alias("i"))
    mean = F.transform("mean", lambda v, i: number("mean", v, i))
    cov = F.transform("cov", lambda v, i: number("cov", v, F.lit(-1) if kind == "spherical" else i))
    cells = F.concat(F.array(number("weight", F.col("weight"), F.lit(-1))), mean, cov)
    return model.select("batch_id", "k", F.explode(cells).alias("c")).select("batch_id", "c.part", "k", "c.i", F.lit(-1).alias("j"), rounded("c.value").alias("value"))


def score_keyed_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's label and log-density under the mixture of its user."""
    rows, fitted = user_fit(spark, sf_dir, "diag")
    return keyed.predict(rows, fitted, "batch_id").select("event_id", "label", rounded("log_prob").alias("log_prob"))


MANY = 8192


def many_components(rows: DataFrame) -> Mixture:
    """8192 spherical components around the table's first vectors by id and, where these are fewer, the same turned by one place, two places and so on."""
    base = np.array([r.features for r in rows.orderBy("vec_id").limit(MANY).select("features").collect()])
    k = np.arange(MANY)
    turned = (np.arange(base.shape[1]) + (k // len(base))[:, None]) % base.shape[1]
    weights = 1.0 + k % 7
    return Mixture("spherical", (weights / weights.sum())[None], np.take_along_axis(base[k % len(base)], turned, axis=1)[None], (0.01 + k % 5 / 500)[None])


def assign_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and log-densities under 8192 components, tile after tile."""
    rows = data(spark, sf_dir, "emb64")
    mixture = many_components(rows)
    return density.score_samples(density.assign(rows, mixture), mixture).select("vec_id", "label", rounded("log_prob").alias("log_prob"))


def topk_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = data(spark, sf_dir, "emb64")
    found = density.best_components(rows, many_components(rows), 3)
    return found.select("vec_id", F.posexplode_outer("top").alias("place", "t")).select("vec_id", "place", F.col("t.k").alias("k"), rounded("t.logit").alias("logit"))


def topk_stats_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the 3 best of 8192 components; the components that are among them."""
    rows = data(spark, sf_dir, "emb64")
    return stats_frame(spark, stats.soft(rows, many_components(rows), top_k=3)[0]).where("value <> 0")


def second_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of products of features by label, as tiles of 16 x 16 features."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("embedding").cast("array<double>").alias("features"), "label")
    found = stats.moment_cells(stats.second_moments(rows, "label", tile=16), 16)
    return found.select("label", "i", "j", rounded("value").alias("value"))


def parallel_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centres of k-means|| are rows of the table, all different."""
    rows, k = data(spark, sf_dir, "li4"), 20
    packed = stats.pack(rows)
    centres = initialize.parallel_centres(packed, k, 7)[None]
    packed.frame.unpersist()
    return drawn_rows(spark, rows, centres)


def score_dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order under the mixture that was fitted to the last full year before it."""
    f, rows = FIXTURES["ord1y"], data(spark, sf_dir, "ord1y")
    fitted = keyed.fit(rows, f.k, "diag", "batch_id", ITERATIONS, 0.0, reg_covar=REG, init_means=keyed.first_means(rows, "batch_id", f.k, list(f.keys)))
    versions = rows.select(F.col("batch_id").alias("batch")).distinct().withColumn("since", F.make_timestamp(F.col("batch") + 1, *[F.lit(v) for v in (1, 1, 0, 0, 0)]))
    found = asof.score_dated(rows.select("o_orderkey", "at", "features"), fitted, versions, "at")
    return found.select("o_orderkey", F.col("version").cast("int").alias("model_year"), "label", rounded("log_prob").alias("log_prob"))


def fit_levels(spark: SparkSession, sf_dir: str, rollup: bool = False) -> DataFrame:
    """Count, log-likelihood, BIC and shares of one mixture for each group of return flag and line status, alone, together and in all."""
    f, rows = FIXTURES["li4"], data(spark, sf_dir, "li4")
    mixture = user_start(rows, "li4", "diag")
    flags = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", "l_linestatus", vector(F.col("l_quantity") / 10, F.col("l_extendedprice") / 10000, F.col("l_discount") * 10, F.col("l_tax") * 10).alias("features"))
    found = levels.fit_by_level(flags, mixture, ["l_returnflag", "l_linestatus"], rollup)
    shares = [rounded(F.get("shares", F.lit(i))).alias(f"share_{i}") for i in range(f.k)]
    return found.select("l_returnflag", "l_linestatus", "level", "n", rounded("log_likelihood").alias("log_likelihood"), rounded("aic").alias("aic"), rounded("bic").alias("bic"), *shares)


def label_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one component in each user's events by time, and how the mean log-density changes from run to run."""
    rows = data(spark, sf_dir, "ev1")
    mixture = user_start(rows, "ev1", "diag")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts", vector("value").alias("features"))
    found = sequences.label_runs(density.score_samples(density.assign(events, mixture), mixture), "user_id", "ts", "event_id")
    return found.select("user_id", "run", "label", "first", "last", "n", "micros", rounded("mean_score").alias("mean_score"), rounded("change").alias("change"))


WEEK = 7 * 86_400


def weeks_of_events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[int]]:
    """The events with their features and week, written apart by week, and the weeks in order."""
    instant = F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("ts")).cast("timestamp")  # the table's times have no zone; they count as UTC
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", instant.alias("ts"), "event_type", F.array(F.col("value").cast("double") / 100).alias("features"))
    events = written(events.withColumn("week", F.floor(F.unix_seconds("ts") / WEEK)), "weeks")
    return events, [r.week for r in events.select("week").distinct().orderBy("week").collect()]


def first_events(events: DataFrame, k: int = 3) -> Mixture:
    """Start parameters: the values of the first events by id, unit variances."""
    means = np.array([r.features for r in events.orderBy("event_id").limit(k).select("features").collect()])
    return Mixture("diag", np.full((1, k), 1.0 / k), means[None], np.ones((1, k, 1)))


def arriving(spark: SparkSession, events: DataFrame, weeks: list[int], follow) -> None:
    """Replays the events: week after week lands in a folder, and follow(stream) takes in what is new there."""
    folder = f"{shared_folder(spark)}/mixweave/arriving-{uuid.uuid4().hex}"
    for week in weeks:
        events.where(F.col("week") == week).drop("week").write.mode("append").parquet(folder)
        follow(spark.readStream.schema(events.drop("week").schema).parquet(folder)).awaitTermination()


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A replay of the events, scored by event-time windows of a day; those that are final one day after their end."""
    events, weeks = weeks_of_events(spark, sf_dir)
    mixture, out = first_events(events), f"{shared_folder(spark)}/mixweave/windows-{uuid.uuid4().hex}"
    arriving(spark, events, weeks, lambda stream: windows.write_windows(stream, mixture, "ts", "1 day", "1 day", out, f"{out}-checkpoint", by=("event_type",)))
    found = spark.read.parquet(out)
    counts = [F.get("label_counts", F.lit(i)).alias(f"n_{i}") for i in range(3)]
    return found.select("event_type", F.unix_seconds("window_start").alias("window_start"), "n", rounded("log_likelihood").alias("log_likelihood"), rounded("mean_score").alias("mean_score"), *counts)


def stream_stepwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stepwise EM over a replay of the events, a week at a time: the parameters after the last."""
    events, weeks = weeks_of_events(spark, sf_dir)
    path = f"{shared_folder(spark)}/mixweave/stepwise-{uuid.uuid4().hex}"
    start = first_events(events)
    arriving(spark, events, weeks, lambda stream: stepwise.StepwiseEM(start, path, 0.5, REG).follow(stream, f"{path}-checkpoint"))
    last = stepwise.StepwiseEM(start, path, 0.5, REG)
    last.restore(spark)
    return params_frame(spark, last.mixture).drop("batch_id")


def em_history(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    report = fitted(data(spark, sf_dir, "li4"), "li4", "spherical", **options)
    return spark.createDataFrame([(i + 1, v) for i, v in enumerate(report.lower_bound_history)], "iteration int, lower_bound double").withColumn("lower_bound", rounded("lower_bound"))


def fit_predict(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    name = FITTED[kind]
    rows = data(spark, sf_dir, name)
    return density.assign(rows, fitted(rows, name, kind).mixture).groupBy("label").agg(F.count("*").alias("n"))


def lloyd_fixed_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = data(spark, sf_dir, "emb64")
    centres = initialize.lloyd(rows, {None: first_rows(rows, FIXTURES["emb64"])[1][0]}, ITERATIONS, 0.0)[None]
    return long_frame(spark, [None], {"mean": centres[None]}, digits=DIGITS)


def drawn_rows(spark: SparkSession, rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """What must hold of drawn centres: (k, is_row, distinct), whether a row of the table is the centre, and how many centres are the same."""
    drawn = F.broadcast(spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "k int, features array<double>"))
    met = rows.select("features").join(drawn, "features").groupBy("k").agg(F.count("*").alias("n"))
    same = drawn.groupBy("features").agg(F.count("*").alias("same"))
    return drawn.join(met, "k", "left").join(same, "features").select("k", F.col("n").isNotNull().alias("is_row"), "same")


def random_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random starting means are rows of the table; weights are equal."""
    f, rows = FIXTURES["li4"], data(spark, sf_dir, "li4")
    mixture, _ = initialize.start(rows, "diag", f.k, stats.moments(rows, f.d), [None], "random", 7, REG)
    weights = spark.createDataFrame([(k, float(w)) for k, w in enumerate(mixture.weights[0])], "k int, weight double")
    return drawn_rows(spark, rows, mixture.means[0]).join(weights, "k").select("k", "is_row", rounded("weight").alias("weight"))


def plus_plus_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centres of k-means++ are rows of the table, all different."""
    rows, k = data(spark, sf_dir, "emb64"), FIXTURES["emb64"].k
    drawn = initialize.sample(rows, initialize.sample_size(rows.count(), k), 7)
    return drawn_rows(spark, rows, initialize.plus_plus(drawn, k, np.random.default_rng(7)))


def kmeans_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of a k-means start: components, their weights' sum, finite numbers, and squared distances in all less than a quarter of those to the mean of all rows."""
    f, rows = FIXTURES["li4"], data(spark, sf_dir, "li4")
    packed = stats.pack(rows)
    moments = stats.moments(packed, f.d)
    mixture, source = initialize.start(rows, "spherical", f.k, moments, [None], "kmeans", 7, REG, packed=packed)
    packed.frame.unpersist()
    within = float((mixture.covariances[0] * mixture.weights[0]).sum()) * f.d
    facts = (f.k, float(mixture.weights.sum()), bool(np.isfinite(mixture.means).all() and (mixture.covariances > 0).all()), bool(within < np.trace(moments[None][2]) / 4), source)
    return spark.createDataFrame([facts], "components int, weights double, sound boolean, tight boolean, source string").withColumn("weights", rounded("weights"))


def blob_facts(spark: SparkSession, sf_dir: str, make) -> DataFrame:
    """Rows of each component of generated blobs, and whether their mean lies at the centre."""
    k, d = 3, 4
    rows = make(spark, 3000, d, k, seed=5)
    means = rows.groupBy("component").agg(F.count("*").alias("n"), F.array(*[F.avg(F.get("features", F.lit(i))) for i in range(d)]).alias("mean"))
    centres = spark.createDataFrame([(j, c.tolist()) for j, c in enumerate(datasets.centres_of(5, k, d, 5.0))], "component int, centre array<double>")
    away = F.array_max(F.zip_with("mean", "centre", lambda a, b: F.abs(a - b)))
    return means.join(F.broadcast(centres), "component").select("component", "n", (away < 0.5).alias("at_centre"))


def scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = FIXTURES["li4"].keys
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*keys, "l_quantity", "l_discount")
    found = standard_scaled(rows.withColumns({c: F.col(c).cast("double") for c in ("l_quantity", "l_discount")}), ["l_quantity", "l_discount"])
    return found.select(*keys, rounded("l_quantity").alias("z_quantity"), rounded("l_discount").alias("z_discount"))


def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(spark, sf_dir, "spherical").groupBy("label").agg(F.count("*").alias("n"))


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for kind in TYPES:
        found |= {f"{f.__name__}_{kind}": partial(f, kind=kind) for f in (logits, assign, score_samples, predict_proba, global_moments, init_stats, fit_predict)}
        found |= {f"finalize_{kind}": partial(finalized, kind=kind), f"em_{kind}": partial(em_params, kind=kind), f"em_topk_{kind}": partial(em_params, kind=kind, top_k=TOP_K)}
        found |= {f"{what}_{kind}": partial(criteria, kind=kind, what=what) for what in ("aic", "bic")}
    for kind in ("spherical", "diag", "full"):
        found |= {f"soft_stats_{kind}": partial(soft_stats, kind=kind), f"hard_stats_{kind}": partial(hard_stats, kind=kind)}
    found |= {
        "soft_stats_columns": partial(soft_stats, kind="diag", strategy="columns"),
        "score_mean": partial(criteria, kind="diag", what="score"),
        "assign_counts": label_counts,
        "xx_total": xx_total,
        "weighted_update": weighted_update,
        "topk_components": topk_components,
        "topk_stats": partial(soft_stats, kind="diag", top_k=TOP_K, name="emb64"),
        "em_lower_bound_history": em_history,
        "em_early_stop": partial(em_history, tol=1e6, max_iter=100),
        "em_hard_spherical": partial(em_params, kind="spherical", em_mode="hard"),
        "em_hard_diag": partial(em_params, kind="diag", em_mode="hard"),
        "em_batched_spherical": partial(em_params, kind="spherical", name="li4b"),
        "em_events": partial(em_params, kind="diag", name="ev1"),
        "em_keyed_spherical": partial(em_keyed_users, kind="spherical"),
        "em_keyed_diag": partial(em_keyed_users, kind="diag"),
        "score_keyed": score_keyed_users,
        "lloyd_fixed_start": lloyd_fixed_start,
        "standard_scaled": scaled,
        "random_init": random_start,
        "sampled_init": kmeans_start,
        "kmeanspp_init": plus_plus_start,
        "kmeans_parallel_init": parallel_start,
        "assign_many": assign_many,
        "topk_many": topk_many,
        "topk_stats_many": topk_stats_many,
        "second_moments": second_moments,
        "score_dated": score_dated,
        "fit_cube": fit_levels,
        "fit_rollup": partial(fit_levels, rollup=True),
        "label_runs": label_runs,
        "stream_windows": stream_windows,
        "stream_stepwise": stream_stepwise,
        "blobs": partial(blob_facts, make=datasets.blobs),
        "anisotropic_blobs": partial(blob_facts, make=datasets.anisotropic_blobs),
    }
    return found
