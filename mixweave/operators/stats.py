"""Sufficient statistics of a mixture: one pass over the rows, one small result.

Each task adds its rows up in numpy as record batches come in and sends one vector per batch key, as bytes. Rows that are read often are
packed first: a cached row then holds the matrix of a whole record batch, which goes to numpy as it is. Vectors are summed in a tree,
level after level of at most FAN_IN of them, down to one row for each key; only where all of them together are small (DIRECT numbers, checked) the
driver adds them itself. Wide vectors travel in chunks. Small models on small rows may use plain aggregates instead ("columns").

Components are taken in tiles (see functions.numeric), so a task holds the sums and one tile of responsibilities. Second moments that
are wider than a task should hold come as a table of tiles, see second_moments.

Layouts by covariance type: nk (K), sum_x (K, D), and second: (K) for spherical, (K, D) for diag, (K, D, D) for full;
tied needs none, as the total of x xᵀ doesn't change between iterations (see total_xx).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixweave.functions import numeric
from mixweave.functions.numeric import Terms
from mixweave.functions.params import Mixture
from mixweave.operators import density

FAN_IN = 32
PACK_ROWS = 4096  # at most, in a block
HELD = 1 << 24  # sums of all its batch keys that a task holds before it passes them on
TILE_WIDTH = 256  # features on each side of a tile of second moments
CHUNK = 1 << 20  # numbers in a row on the way to the driver
DIRECT = 1 << 19  # numbers that the driver adds up itself
WIDEST_SUMS = 2000  # plain aggregates in one query
PART_SCHEMA = "part long, batch string, chunk int, stats binary"
BLOCK_SCHEMA = "batch string, n long, lo int, hi int, bad long, block binary"


@dataclass
class Stats:
    """Sums over the rows of one batch key."""

    n: float
    log_likelihood: float
    nk: np.ndarray
    sum_x: np.ndarray
    second: np.ndarray | None

    @staticmethod
    def width(kind: str, k: int, d: int) -> int:
        return 2 + k + k * d + {"spherical": k, "diag": k * d, "tied": 0, "full": k * d * d}[kind]

    @classmethod
    def unpack(cls, flat: np.ndarray, kind: str, k: int, d: int) -> Stats:
        second = flat[2 + k + k * d :]
        shape = {"spherical": (k,), "diag": (k, d), "full": (k, d, d)}.get(kind)
        return cls(flat[0], flat[1], flat[2 : 2 + k], flat[2 + k : 2 + k + k * d].reshape(k, d), second.reshape(shape) if shape else None)


def add_tiles(total: np.ndarray, x: np.ndarray, tiles: Iterator[tuple[int, np.ndarray]], k: int, log_likelihood: float, kind: str) -> None:
    """Adds the statistics of a row matrix to a flat vector, from its responsibilities in tiles of components."""
    d = x.shape[1]
    total[0] += len(x)
    total[1] += log_likelihood
    into = Stats.unpack(total, kind, k, d)
    squares = x * x if kind in ("spherical", "diag") else None
    for lo, resp in tiles:
        mine = slice(lo, lo + resp.shape[1])
        into.nk[mine] += resp.sum(axis=0)
        into.sum_x[mine] += resp.T @ x
        if kind == "spherical":
            into.second[mine] += resp.T @ squares.sum(axis=1)
        elif kind == "diag":
            into.second[mine] += resp.T @ squares
        elif kind == "full":
            for j, r in enumerate(resp.T):
                into.second[lo + j] += (x * r[:, None]).T @ x


def add_labelled(total: np.ndarray, x: np.ndarray, label: np.ndarray, k: int, kind: str) -> None:
    """Adds the statistics of rows that belong to one component each: sums over rows sorted by label, no matrix of responsibilities."""
    if not len(x):
        return
    order = np.argsort(label, kind="stable")
    x, label = x[order], label[order]
    starts = np.flatnonzero(np.append(True, label[1:] != label[:-1]))
    at, into = label[starts], Stats.unpack(total, kind, k, x.shape[1])
    total[0] += len(x)
    into.nk[at] += np.diff(np.append(starts, len(x)))
    into.sum_x[at] += np.add.reduceat(x, starts, axis=0)
    if kind == "spherical":
        into.second[at] += np.add.reduceat((x * x).sum(axis=1), starts)
    elif kind == "diag":
        into.second[at] += np.add.reduceat(x * x, starts, axis=0)
    elif kind == "full":
        for j, lo, hi in zip(at, starts, np.append(starts[1:], len(x)), strict=True):
            into.second[j] += x[lo:hi].T @ x[lo:hi]


def add_up(x: np.ndarray, resp: np.ndarray, log_likelihood: float, kind: str) -> np.ndarray:
    """The statistics of a row matrix under its responsibilities, as one flat vector."""
    total = np.zeros(Stats.width(kind, resp.shape[1], x.shape[1]))
    add_tiles(total, x, iter([(0, resp)]), resp.shape[1], log_likelihood, kind)
    return total


def matrix(column: pa.Array) -> np.ndarray:
    """A list<double> column without nulls as rows of a matrix."""
    return np.asarray(column.flatten()).reshape(len(column), -1)


@dataclass
class Packed:
    """Feature rows as blocks of doubles (BLOCK_SCHEMA); shift is subtracted from each row where it is used."""

    frame: DataFrame
    parts: int
    shift: np.ndarray | None = None

    def moved(self, shift: np.ndarray) -> Packed:
        return Packed(self.frame, self.parts, shift)


def pack(data: DataFrame, batch: str | None = None) -> Packed:
    """The feature vectors of data in blocks, cached. A block with vectors that aren't finite arrays of one length counts them as bad and is empty."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for lo in range(0, rows.num_rows, PACK_ROWS):
                part = rows.slice(lo, PACK_ROWS)
                keys = part.column(1).to_numpy(zero_copy_only=False)
                for key in dict.fromkeys(keys):
                    mine = part.filter(pa.array(keys == key)).column(0)
                    width = pc.list_value_length(mine)
                    bounds = pc.min_max(width).as_py()
                    x = np.asarray(mine.flatten(), float)  # a null element becomes NaN
                    good = not mine.null_count and bounds["min"] == bounds["max"] and np.isfinite(x).all()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([v], t) for v, t in ((key, pa.string()), (len(mine), pa.int64()), (bounds["min"], pa.int32()), (bounds["max"], pa.int32()), (0 if good else len(mine), pa.int64()), (x.tobytes() if good else b"", pa.binary()))],
                        names=["batch", "n", "lo", "hi", "bad", "block"],
                    )

    frame = _columns(data, batch).mapInArrow(task, BLOCK_SCHEMA)
    parts, wanted = frame.rdd.getNumPartitions(), data.sparkSession.sparkContext.defaultParallelism
    if parts < wanted:  # a small table in few files: its blocks are dealt out to all cores once
        frame, parts = frame.repartition(wanted), wanted
    return Packed(frame.persist(StorageLevel.MEMORY_AND_DISK), parts)


def features_of(packed: Packed, d: int | None) -> int:
    """The length of the feature vectors, from the first block; checked is what looks at all of them."""
    first = packed.frame.select("lo").first()
    if first is None:
        raise ValueError("no rows to fit")
    return d if d is not None else first.lo if first.lo is not None and first.lo >= 0 else 0


def refuse(packed: Packed, d: int | None) -> None:
    lengths = sorted(map(str, {w for r in packed.frame.select("lo", "hi").distinct().limit(9).collect() for w in r}))
    raise ValueError(f"features must be finite arrays of one length{'' if d is None else f' {d}'}; found lengths {lengths}")


def levels(n_parts: int | None, width: int) -> list[int]:
    """Numbers of groups, level after level, in which vectors are summed; each group has about FAN_IN of them. Without a number of parts, small vectors take two levels."""
    n, found = n_parts or (FAN_IN**2 if width < 1 << 14 else FAN_IN**3), []
    while n > 1:
        n = -(-n // FAN_IN)
        found.append(n)
    return found


def merged(parts: DataFrame, keys: list[str], groups: list[int], together: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """Rows of parts, merged by keys through levels of groups of parts."""
    for n in groups:
        parts = parts.withColumn("part", F.pmod("part", F.lit(n))).groupBy("part", *keys).applyInArrow(together, parts.schema)
    return parts


def added(parts: DataFrame, keys: list[str], groups: list[int]) -> DataFrame:
    """The column stats (doubles as bytes), summed by keys through levels of groups of parts."""

    def together(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v.as_buffer()) for chunk in table["stats"].chunks for v in chunk)
        return table.slice(0, 1).set_column(table.schema.get_field_index("stats"), "stats", pa.array([total.tobytes()], pa.binary()))

    return merged(parts, keys, groups, together)


def summed(parts: DataFrame, n_parts: int | None, width: int, n_keys: int) -> dict[str | None, np.ndarray]:
    """The vectors of all parts, summed by batch."""
    if n_parts is None or n_parts * width * n_keys > DIRECT:
        parts = added(parts, ["batch", "chunk"], levels(n_parts, width))
    found: dict[str | None, np.ndarray] = {}
    for r in parts.select("batch", "chunk", "stats").toLocalIterator() if n_keys * width > 16 * CHUNK else parts.select("batch", "chunk", "stats").collect():
        total = found.setdefault(r.batch, np.zeros(width))
        part = np.frombuffer(r.stats)
        total[r.chunk * CHUNK : r.chunk * CHUNK + len(part)] += part
    return found


def map_stats(data: DataFrame | Packed, measure, width: int, batch: str | None, extra: str | None = None, n_keys: int = 1) -> dict[str | None, np.ndarray]:
    """Runs measure(total, key, row matrix, extra column), which adds to a vector of width numbers, on all rows, in record batches or blocks; the vectors are summed by batch key (None without batch).

    n_keys says how many keys there are about: with few small vectors the driver adds them up itself.
    """
    packed = data if isinstance(data, Packed) else None

    def matrices(rows: pa.RecordBatch) -> Iterator[tuple]:
        if packed is not None:
            for key, n, block in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), rows.column(2), strict=True):
                x = np.frombuffer(block.as_buffer(), float).reshape(n, -1) if len(block.as_buffer()) else np.empty((n, 0))
                yield key if batch else None, x if shift is None else x - shift, None
        elif not batch:
            yield None, matrix(rows.column(0)), rows.column(2) if extra else None
        else:
            keys = rows.column(1).to_numpy(zero_copy_only=False)
            for key in dict.fromkeys(keys):
                mine = rows.filter(pa.array(keys == key))
                yield key, matrix(mine.column(0)), mine.column(2) if extra else None

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        total: dict[str | None, np.ndarray] = {}

        def sent() -> Iterator[pa.RecordBatch]:
            for key, vector in total.items():
                for c, lo in enumerate(range(0, width, CHUNK)):
                    yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([key], pa.string()), pa.array([c], pa.int32()), pa.array([vector[lo : lo + CHUNK].tobytes()], pa.binary())], names=["part", "batch", "chunk", "stats"])
            total.clear()

        for rows in batches:
            for key, x, more in matrices(rows) if rows.num_rows else ():
                if key not in total:
                    if (len(total) + 1) * width > HELD:
                        yield from sent()
                    total[key] = np.zeros(width)
                measure(total[key], key, x, more)
        yield from sent()

    if packed is not None:
        shift, rows, n_parts = packed.shift, packed.frame.select("batch", "n", "block"), packed.parts
        packed = Packed(None, n_parts, shift)  # tasks get no DataFrame
    else:
        rows = _columns(data, batch, *([extra] if extra else []))
        shift, n_parts = None, None
    return summed(rows.mapInArrow(task, PART_SCHEMA), n_parts, width, n_keys)


def _columns(data: DataFrame, batch: str | None, *extra: str) -> DataFrame:
    key = F.col(batch).cast("string") if batch else F.lit("")
    return data.select("features", key.alias("batch"), *extra)


def soft(data: DataFrame | Packed, mixture: Mixture, batch: str | None = None, mode: str = "soft", top_k: int | None = None, strategy: str = "arrow") -> list[Stats]:
    """The statistics of one E-step, for each batch key of the mixture. mode "hard" counts each row for its best component only; top_k keeps a row's best components only."""
    _, k, d = mixture.shape
    if top_k is not None and not 0 < top_k < k:
        raise ValueError(f"top_k must lie between 0 and the {k} components")
    if strategy == "columns":
        return _soft_columns(data, mixture, batch, mode, top_k)
    terms = {None if key is None else str(key): Terms(mixture, b) for b, key in enumerate(mixture.keys)}
    width = Stats.width(mixture.kind, k, d)

    def measure(total, key, x, _):
        for lo in range(0, len(x), density.ROWS):
            some = x[lo : lo + density.ROWS]
            tiles, likelihood = numeric.tiled_responsibilities(terms[key], some, mode, top_k)
            add_tiles(total, some, tiles, k, likelihood, mixture.kind)

    found = map_stats(data, measure, width, batch, n_keys=len(terms))
    return [Stats.unpack(found.get(key, np.zeros(width)), mixture.kind, k, d) for key in terms]


def _soft_columns(data: DataFrame, mixture: Mixture, batch: str | None, mode: str, top_k: int | None) -> list[Stats]:
    _, k, d = mixture.shape
    rows = _columns(data, batch).withColumn("logits", density.logits(mixture, "features", "batch" if batch else None, "columns"))
    logit = F.col("logits")
    if mode == "hard":
        resp = F.transform(logit, lambda _, i: (i == density.label(logit)).cast("double"))
        rows = rows.select("features", "batch", density.log_prob(logit).alias("ll"), resp.alias("resp"))
    elif top_k and top_k < k:
        rows = rows.withColumn("top", density.top_components(logit, top_k))
        norm = density.log_prob(F.transform("top", lambda s: s["logit"]))
        held = F.transform(logit, lambda x, i: F.when(F.exists("top", lambda s: s["k"] == i), F.exp(x - F.col("ll"))).otherwise(0.0))
        rows = rows.withColumn("ll", norm).select("features", "batch", "ll", held.alias("resp"))
    else:
        rows = rows.withColumn("ll", density.log_prob(logit)).select("features", "batch", "ll", F.transform(logit, lambda x: F.exp(x - F.col("ll"))).alias("resp"))
    x = [F.get("features", F.lit(i)) for i in range(d)]
    r = [F.get("resp", F.lit(i)) for i in range(k)]
    sums = [F.count("*").cast("double"), F.sum("ll"), *[F.sum(a) for a in r], *[F.sum(a * b) for a in r for b in x]]
    if mixture.kind == "spherical":
        norm = sum((b * b for b in x[1:]), x[0] * x[0])
        sums += [F.sum(a * norm) for a in r]
    elif mixture.kind == "diag":
        sums += [F.sum(a * b * b) for a in r for b in x]
    elif mixture.kind == "full":
        sums += [F.sum(a * b * c) for a in r for b in x for c in x]
    found = {row[0]: np.array([v or 0.0 for v in row[1:]]) for row in rows.groupBy("batch").agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).collect()}
    width = Stats.width(mixture.kind, k, d)
    return [Stats.unpack(found.get(str(key) if batch else "", np.zeros(width)), mixture.kind, k, d) for key in mixture.keys]


def hard(data: DataFrame, k: int, kind: str = "spherical", label: str = "label", batch: str | None = None) -> DataFrame:
    """Counts, sums and second moments by given labels, as columns nk, sum_x and second (tied has none, see total_xx); a row for each label that occurs.

    One hash aggregate with partial sums; with more than WIDEST_SUMS sums, in numpy.
    """
    d = data.select(F.size("features")).first()[0]
    data = data.where(F.col(label).between(0, k - 1))
    n_sums = 1 + d + {"spherical": 1, "diag": d, "tied": 0, "full": d * d}[kind]
    if n_sums > WIDEST_SUMS:
        return _hard_wide(data, k, d, kind, label, batch)
    x = [F.get("features", F.lit(i)) for i in range(d)]
    sums = [F.count("*").cast("double").alias("nk"), F.array(*[F.sum(a) for a in x]).alias("sum_x")]
    if kind == "spherical":
        sums.append(F.array(F.sum(sum((a * a for a in x[1:]), x[0] * x[0]))).alias("second"))
    elif kind == "diag":
        sums.append(F.array(*[F.sum(a * a) for a in x]).alias("second"))
    elif kind == "full":
        sums.append(F.array(*[F.sum(a * b) for a in x for b in x]).alias("second"))
    return data.groupBy(*([batch] if batch else []), label).agg(*sums)


def _hard_wide(data: DataFrame, k: int, d: int, kind: str, label: str, batch: str | None) -> DataFrame:
    def measure(total, _, x, labels):
        add_labelled(total, x, labels.to_numpy(), k, kind)

    found = map_stats(data, measure, Stats.width(kind, k, d), batch, label)
    rows = []
    for key, flat in found.items():
        s = Stats.unpack(flat, kind, k, d)
        second = [] if s.second is None else [s.second.reshape(k, -1).tolist()]
        rows += [(*([key] if batch else []), j, float(s.nk[j]), s.sum_x[j].tolist(), *[x[j] for x in second]) for j in range(k) if s.nk[j]]
    kept = ([f"`{batch}` string"] if batch else []) + [f"`{label}` int", "nk double", "sum_x array<double>"] + ([] if kind == "tied" else ["second array<double>"])
    return data.sparkSession.createDataFrame(rows, ", ".join(kept))


def weighted(data: DataFrame, kind: str, k: int, d: int, resp: str = "resp", batch: str | None = None) -> dict[str | None, Stats]:
    """Statistics under given responsibilities, an array of K for each row."""

    def measure(total, _, x, r):
        add_tiles(total, x, iter([(0, matrix(r))]), k, 0.0, kind)

    found = map_stats(data, measure, Stats.width(kind, k, d), batch, resp)
    return {key: Stats.unpack(v, kind, k, d) for key, v in found.items()}


def moments(data: DataFrame | Packed, d: int, batch: str | None = None, kind: str = "full", n_keys: int = 1) -> dict[str | None, tuple[float, np.ndarray, np.ndarray]]:
    """Rows, mean and biased covariance for each batch key; for spherical and diag only the variances of the features. Blocks that were packed with bad or other vectors raise ValueError."""
    wide = kind in ("tied", "full")

    def measure(total, _, x, __):
        if x.shape[1] != d:
            total[1] += len(x)
            return
        total[0] += len(x)
        total[2 : 2 + d] += x.sum(axis=0)
        total[2 + d :] += (x.T @ x).ravel() if wide else (x * x).sum(axis=0)

    found = map_stats(data, measure, 2 + d + (d * d if wide else d), batch, n_keys=n_keys)
    if any(v[1] for v in found.values()):
        if isinstance(data, Packed):
            refuse(data, d)
        raise ValueError(f"features must have length {d}")
    out = {}
    for key, v in found.items():
        mean = v[2 : 2 + d] / v[0]
        second = v[2 + d :] / v[0]
        out[key] = (float(v[0]), mean, second.reshape(d, d) - np.outer(mean, mean) if wide else np.maximum(second - mean * mean, 0.0))
    return out


def total_xx(data: DataFrame | Packed, d: int, batch: str | None = None) -> dict[str | None, np.ndarray]:
    """The sum of x xᵀ for each batch key: what tied covariances need, once."""

    def measure(total, _, x, __):
        total += (x.T @ x).ravel()

    found = map_stats(data, measure, d * d, batch)
    return {key: v.reshape(d, d) for key, v in found.items()}


def second_moments(data: DataFrame, label: str | None = None, batch: str | None = None, tile: int = TILE_WIDTH) -> DataFrame:
    """(batch, label, i, j, rows, columns, stats): the sums of x xᵀ by batch key and label (null without), as tiles of tile x tile features with i <= j; the others are their transposes.

    For vectors so wide that D x D numbers for each label are too much for one task: a task holds HELD numbers at most, tiles are summed
    by key in a tree, and the result is a table; the driver gets none of it. Rows with a null or bad vector are left out, vectors of several lengths raise an error.
    """
    by = F.col(label).cast("int") if label else F.lit(None).cast("int")
    rows = data.select("features", (F.col(batch).cast("string") if batch else F.lit(None).cast("string")).alias("batch"), by.alias("label")).where("features IS NOT NULL")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held, d = TaskContext.get().partitionId(), {}, None

        def sent() -> Iterator[pa.RecordBatch]:
            for (key, name, i, j), sums in held.items():
                values = [(part, pa.int64()), (key, pa.string()), (name, pa.int32()), (i, pa.int32()), (j, pa.int32()), (sums.shape[0], pa.int32()), (sums.shape[1], pa.int32()), (sums.tobytes(), pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in values], names=["part", "batch", "label", "i", "j", "rows", "columns", "stats"])
            held.clear()

        for batch_rows in batches:
            widths = pc.unique(pc.list_value_length(batch_rows.column(0))).to_pylist()
            if len({*widths, *([d] if d is not None else [])}) > 1:
                raise ValueError(f"features must have one length, found {sorted(widths)}")
            d = widths[0] if widths else d
            x = matrix(batch_rows.column(0)).astype(float)
            finite = np.isfinite(x).all(axis=1)
            groups: dict[tuple, list[int]] = {}
            for at, key in enumerate(zip(batch_rows.column(1).to_pylist(), batch_rows.column(2).to_pylist(), strict=True)):
                if finite[at]:
                    groups.setdefault(key, []).append(at)
            for (key, name), at in groups.items():
                mine = x[at]
                for i in range(0, d, tile):
                    for j in range(i, d, tile):
                        found = mine[:, i : i + tile].T @ mine[:, j : j + tile]
                        place = (key, name, i // tile, j // tile)
                        if place not in held and (len(held) + 1) * tile * tile > HELD:
                            yield from sent()
                        held[place] = held[place] + found if place in held else found
        yield from sent()

    parts = rows.mapInArrow(task, "part long, batch string, label int, i int, j int, rows int, columns int, stats binary")
    return added(parts, ["batch", "label", "i", "j"], levels(None, tile * tile)).drop("part")


def moment_cells(tiles: DataFrame, tile: int = TILE_WIDTH) -> DataFrame:
    """(batch, label, i, j, value): the numbers of second_moments for features i <= j."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                sums = np.frombuffer(r["stats"]).reshape(r["rows"], r["columns"])
                i, j = np.triu_indices(len(sums)) if r["i"] == r["j"] else np.indices(sums.shape).reshape(2, -1)
                places = [pa.array((at + first * tile).astype(np.int32)) for at, first in ((i, r["i"]), (j, r["j"]))]
                yield pa.RecordBatch.from_arrays([pa.array([r["batch"]] * len(i), pa.string()), pa.array([r["label"]] * len(i), pa.int32()), *places, pa.array(sums[i, j])], names=["batch", "label", "i", "j", "value"])

    return tiles.mapInArrow(task, "batch string, label int, i int, j int, value double")
