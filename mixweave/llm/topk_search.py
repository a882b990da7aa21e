"""Exact top-k search by inner product: Fagin's threshold algorithm over sorted lists, one for each dimension.

Vectors are dealt out by hash into parts, queries into groups; each task has one part and one group, so the work is spread over
(parts x groups) tasks of bounded size, and a query travels once to each part. In a task each dimension is a list of the part's vectors by
value. A query walks the lists from the end that its own component favours, all to the same depth, and scores each new
vector whole. No vector below that depth in all lists can score more than the sum of the query's components times the values at that
depth; a query stops when its k best beat this bound (a tie goes on, as it may have a smaller id). Depths double, and the queries of a group walk
together: a vector that one of them meets is scored for all that haven't stopped, by one matrix product. The parts' best meet in a ranking for each query.

Copies, rows with the same id and vector, are one row with a count until the end. Rows with one id and different vectors are vectors of
their own; a query's own row never is its partner, another copy of it is. Vectors that are null or have a component that is null, NaN or infinite take
no part. Of vectors of different lengths, the shorter one counts as filled up with zeros. A null id is a partner like any
other and comes last among equal scores; it can't be a query. Scores that don't fit a long wrap around. Other columns are ignored, an empty table
gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mixweave.llm.shared import materialize

SCALE = 256
PARTS, LEAST_ROWS, MOST_ROWS = 64, 256, 65_536  # parts wanted, and rows of a part
GROUP_ROWS = 16_384  # queries of a group
FIRST_DEPTH = 16
FOUND_SCHEMA = "query_id long, query_key long, query_copies long, vec_id long, score long, copies long"


def whole(values: Column) -> Column:
    """floor(SCALE * x) for each component; null for vectors that take no part."""
    finite = F.forall(values, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    return F.when(finite, F.transform(values, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double"))))


def rows_of(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of longs as rows of a matrix, filled up with zeros."""
    lists = column.combine_chunks()
    width = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    values, wide = lists.flatten().to_numpy(zero_copy_only=False), int(width.max(initial=0))
    if (width == wide).all():
        return values.reshape(len(width), wide)
    out = np.zeros((len(width), wide), np.int64)
    out[np.arange(wide) < width[:, None]] = values
    return out


def widened(a: np.ndarray, width: int) -> np.ndarray:
    return np.pad(a, ((0, 0), (0, width - a.shape[1])))


def best_of(vectors: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score) of each query's k best vectors; of equal scores the vector that comes first. By the threshold algorithm, exact."""
    n, d = vectors.shape
    k = min(k, n)
    limit = float(np.abs(vectors).max(initial=0)) * float(np.abs(queries).max(initial=0)) * d
    if limit >= 2**53 or limit * n >= 2**62:  # too large for exact products of doubles: every vector is scored in longs
        scores = queries @ vectors.T
        at = np.argsort(~scores, axis=1, kind="stable")[:, :k]  # ~ turns the order around and can't overflow
        return np.repeat(np.arange(len(queries)), k), at.ravel(), np.take_along_axis(scores, at, axis=1).ravel()
    x, q = vectors.astype(float), queries.astype(float)
    lists = np.argsort(vectors, axis=0, kind="stable")
    up, down = np.maximum(q, 0.0), np.minimum(q, 0.0)
    best = np.full((len(q), k), np.iinfo(np.int64).min)  # score and place in one number: score * n + (n - 1 - place)
    seen, alive, depth = np.zeros(n, bool), np.arange(len(q)), 0
    while len(alive) and depth < n:
        ahead = min(n, max(FIRST_DEPTH, 2 * depth))
        high, low = (up[alive] > 0).any(axis=0), (down[alive] < 0).any(axis=0)
        met = np.zeros(n, bool)
        met[lists[n - ahead : n - depth, high]] = True
        met[lists[depth:ahead, low]] = True
        if ahead == n:
            met[:] = True  # a query of zeros walks no list
        new = np.flatnonzero(met & ~seen)
        seen |= met
        depth = ahead
        if len(new):
            keys = (q[alive] @ x[new].T).astype(np.int64) * n + (n - 1 - new)
            both = np.concatenate([best[alive], keys], axis=1)
            best[alive] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
        top, bottom = x[lists[n - depth], np.arange(d)], x[lists[depth - 1], np.arange(d)]
        bound = up[alive] @ top + down[alive] @ bottom
        kth = best[alive].min(axis=1)
        alive = alive[(kth == np.iinfo(np.int64).min) | (kth // n <= bound)]
    return np.repeat(np.arange(len(q)), k), n - 1 - best.ravel() % n, best.ravel() // n


def _search(k: int):
    def task(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        names = [f.split()[0] for f in FOUND_SCHEMA.split(", ")]
        if not vectors.num_rows or not queries.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        vectors = vectors.sort_by("vec_id")  # nulls come last
        x, q = rows_of(vectors["vector"]), rows_of(queries["vector"])
        width = max(x.shape[1], q.shape[1])
        x, q = widened(x, width), widened(q, width)
        who, at, score = best_of(x, q, k + 1)  # one more, as a query's own row may be among them
        ids, query_ids = vectors["vec_id"].combine_chunks(), queries["vec_id"].combine_chunks().to_numpy()
        known, plain = ids.is_valid().to_numpy(zero_copy_only=False), pc.fill_null(ids, 0).to_numpy()
        own = known[at] & (plain[at] == query_ids[who]) & (vectors["key"].to_numpy()[at] == queries["key"].to_numpy()[who]) & (x[at] == q[who]).all(axis=1)
        copies = np.minimum(vectors["copies"].to_numpy()[at] - own, k)
        some = np.flatnonzero(copies > 0)
        who, at = who[some], pa.array(at[some])
        values = [query_ids[who], queries["key"].to_numpy()[who], queries["copies"].to_numpy()[who], ids.take(at), score[some], copies[some]]
        return pa.table([pa.array(v, pa.int64()) for v in values], names=names)

    return task


def search(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of vectors (vec_id long, vector array<long>) that is_query, its k highest inner products with other rows; ties go to the smaller vec_id."""
    rows = vectors.where(F.col("vector").isNotNull()).groupBy("vec_id", "vector").agg(F.count("*").alias("copies"))
    rows = materialize(rows.withColumn("key", F.xxhash64("vec_id", "vector")), "vectors")
    asked = F.coalesce(is_query, F.lit(False)) & F.col("vec_id").isNotNull()
    n, m = rows.agg(F.count("*"), F.count_if(asked)).first()
    parts = max(1, math.ceil(n / min(MOST_ROWS, max(LEAST_ROWS, n // PARTS))))
    groups = max(1, math.ceil(m / GROUP_ROWS))
    every = lambda size: F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    dealt = rows.withColumn("part", F.pmod("key", F.lit(parts)).cast("int")).withColumn("group", every(groups))
    sent = rows.where(asked).withColumn("group", F.pmod(F.xxhash64(F.lit(1), "key"), F.lit(groups)).cast("int")).withColumn("part", every(parts))
    found = dealt.groupBy("part", "group").cogroup(sent.groupBy("part", "group")).applyInArrow(_search(k), FOUND_SCHEMA)
    place = F.row_number().over(Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    ranked = each.withColumn("rank", place).where(F.col("rank") <= k)
    return ranked.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("query_copies").cast("int")))).select("query_id", "rank", "vec_id", "score")
