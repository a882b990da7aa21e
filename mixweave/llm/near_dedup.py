"""Near-duplicate classes by DartMinHash signatures and a banded join.

Elements are five-word shingles. Each element owns a strip of the plane of weights and ranks; darts fall on the strips
as a Poisson process that is a function of hashes alone, so all documents see the same darts. A dart hits a document
if its weight lies below the weight of its element there. Each dart belongs to one of k coordinates, and a signature holds the
hit of least rank for each coordinate: two signatures agree in a coordinate with the weighted Jaccard similarity as
the probability. Only darts of small rank are made, about k ln k for each document however long it is; a document
that leaves a coordinate empty throws further. With weighting="count" a shingle weighs as often as it occurs, and the similarity is that of
the weighted sets; "set" makes all weights one.

Copies of a text have one representative (copies are signed too, as that costs less than moving all texts to find out which
are; what they signed is dropped at once). Equal bands of ROWS coordinates put representatives into
buckets. A bucket never makes its pairs: its members are compared to one leader, the member that shares most
buckets overall, which is the centre of a family of copies. Candidates are then verified on whole texts. In further
rounds, a bucket whose members are still in several components compares one member of each to one of another, drawn
anew in each round. What is left then is exact: a bucket that still has several components compares all pairs of
members of different ones on their whole shingle sets, block by block inside a task, so that no table of pairs is
made; every pair that shares a bucket is in one component or was compared. Links make components by label propagation over tables. A pair
at the threshold shares a band with probability 1 - (1 - 0.8^4)^24, all but 3e-6.

Defined cases. Null text counts as empty. Equal texts are one class, the empty ones too; otherwise documents without
words link to nothing. Texts of one to four words have one shingle, all their words. Repeated rows: one row each, of one class; any one of
them is kept by deduplicate. Rows with one doc_id and different texts are documents of their own. A null
doc_id takes no part: its class is null, and it is kept. Class ids are the least doc_id of the class; of its texts with that id,
the one whose digest is least stays. Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixweave.llm.shared import materialize, text_slices

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 4
BROADCAST_CLASHES = 1_000_000
PAIR_ROWS = 512  # of one leader that are compared in a row
ROUNDS = 2  # further rounds of candidates between components of a bucket
SLICE_BYTES = 4 << 20
PART_ROWS, PART_BYTES = 1024, 4 << 20  # about the members of a block in the exact comparison

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1] from the upper 53 bits."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places start, start + 1 ... of all runs, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def word_hashes(texts: pa.Array, normal: Callable[[str], str] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The number of words of each text, and the hashes of all words in order. Each distinct word is normalised and hashed once."""
    texts = pc.ascii_trim_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    lists = pc.ascii_split_whitespace(texts)
    at = np.asarray(lists.offsets)
    coded = lists.values.slice(at[0], at[-1] - at[0]).dictionary_encode()
    words = coded.dictionary.to_pylist()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(normal(w) if normal else w) for w in words), np.uint64, len(words))
    counts = np.where(pc.binary_length(texts).to_numpy() > 0, np.diff(at), 0)
    codes = coded.indices.to_numpy()
    if (empty := np.diff(at) != counts).any():  # an empty text is split into one empty word
        codes = codes[np.repeat(~empty, np.diff(at))]
    return counts, hashes[codes] if len(codes) else np.zeros(0, np.uint64)


def shingles(texts: pa.Array, size: int = SHINGLE, normal: Callable[[str], str] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text number, shingle hash) of all shingles in order; a text of fewer words has one shingle of all its words."""
    counts, hashes = word_hashes(texts, normal)
    starts = np.cumsum(counts) - counts
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(len(counts)), n)
    place = ragged(starts, n)
    left = np.minimum(counts, size)[doc]
    made = np.zeros(len(doc), np.uint64)
    for i in range(size):
        word = hashes[np.minimum(place + i, max(len(hashes) - 1, 0))] if len(doc) else made
        made = np.where(i < left, (made ^ mixed(word + np.uint64(i + 1))) * GOLDEN, made)
    return doc, mixed(made)


def weigh(doc: np.ndarray, element: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (doc, element) with the number of occurrences as weight."""
    order = np.lexsort((element, doc))
    doc, element = doc[order], element[order]
    first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (element[1:] != element[:-1]))) if len(doc) else np.zeros(0, int)
    return doc[first], element[first], np.diff(np.append(first, len(doc))).astype(np.float64)


def throw(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, rank, dart) of all darts below each element's weight and its document's rank limit.

    Weights are cut into cells [0, 1), [1, 2), [2, 4) and so on; in a cell, ranks arrive with a rate of its width, and
    each dart has a uniform place in it.
    """
    found = []
    start, width, cell = 0.0, 1.0, 1
    while len(doc):
        d, e, w, rank = doc, mixed(element + np.uint64(cell * int(GOLDEN) % 2**64)), weight, np.zeros(len(doc))
        while len(d):
            e = mixed(e + GOLDEN)
            rank = rank - np.log(uniform(e)) / width
            below = rank <= limit[d]
            d, e, w, rank = d[below], e[below], w[below], rank[below]
            dart = mixed(e ^ np.uint64(0xD6E8FEB86659FD93))
            hit = start + uniform(dart) * width <= w
            found.append((d[hit], rank[hit], mixed(dart)[hit]))
        start, width, cell = start + width, max(1.0, start + width), cell + 1
        more = weight > start
        doc, element, weight = doc[more], element[more], weight[more]
    return tuple(map(np.concatenate, zip(*found, strict=True))) if found else (np.zeros(0, int), np.zeros(0), np.zeros(0, np.uint64))


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int) -> np.ndarray:
    """An n x k array of darts; rows of documents without elements stay zero."""
    total = np.bincount(doc, weights=weight, minlength=n)
    limit = np.divide(k * (np.log(k) + 2), total, out=np.zeros(n), where=total > 0)
    made, open_docs = np.zeros(n * k, np.uint64), total > 0
    while open_docs.any():
        mine = open_docs[doc]
        d, rank, dart = throw(doc[mine], element[mine], weight[mine], limit)
        slot = d * k + (dart % np.uint64(k)).astype(np.int64)
        least = np.full(n * k, np.inf)
        np.minimum.at(least, slot, rank)
        first = rank == least[slot]
        made[slot[first]] = dart[first]
        whole = np.isfinite(least).reshape(n, k).all(axis=1)
        open_docs &= ~whole
        limit *= 2
    return made.reshape(n, k)


def band_keys(docs: DataFrame, weighting: str, bands: int, rows: int) -> DataFrame:
    """(doc_id, key) for every band of every document with words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 1, SLICE_BYTES):
            doc, element = shingles(batch.column(1))
            doc, element, weight = weigh(doc, element) if weighting == "count" else (doc, element, np.ones(len(doc)))
            signed = signatures(doc, element, weight, batch.num_rows, bands * rows).reshape(-1, bands, rows)
            keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * GOLDEN, signed.shape[:2]).copy()
            for r in range(rows):
                keys = mixed(keys ^ signed[:, :, r]) + GOLDEN
            has = np.bincount(doc, minlength=batch.num_rows) > 0
            row = np.repeat(np.flatnonzero(has), bands)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(keys[has].reshape(-1).view(np.int64))], names=["doc_id", "key"])

    return docs.select("doc_id", "text").mapInArrow(sign, "doc_id long, key long")


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sets given as sorted elements and their weights."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    union = a[1].sum() + b[1].sum() - both
    return float(both / union) if union else 0.0


def verified(pairs: DataFrame, texts: DataFrame, weighting: str, threshold: float) -> DataFrame:
    """Those pairs (a, b) whose whole texts are similar enough; pairs is a table.

    The text of a leader b travels once for PAIR_ROWS of its pairs and stands before them, so it is neither repeated in each pair nor
    is a hot leader's family one task's work.
    """
    parts = pairs.groupBy("b").agg(F.ceil(F.count("*") / PAIR_ROWS).cast("int").alias("parts"))
    read = texts.select("doc_id", "text")
    heads = parts.join(read.withColumnRenamed("doc_id", "b"), "b").select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("a"), "text")
    busy = parts.where("parts > 1")  # at most one in PAIR_ROWS pairs
    part = F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1))).cast("int").alias("part")
    mine = pairs.join(busy, "b", "left").select("b", part, "a").join(read.withColumnRenamed("doc_id", "a"), "a").select("b", "part", "a", "text")
    rows = heads.unionByName(mine).repartition("b", "part").sortWithinPartitions("b", "part", F.asc_nulls_first("a"))

    def elements(text: str) -> tuple[np.ndarray, np.ndarray]:
        found, n = np.unique(shingles(pa.array([text], pa.large_string()))[1], return_counts=True)
        return found, n if weighting == "count" else np.ones(len(found), np.int64)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader = None
        for batch in text_slices(batches, 3, SLICE_BYTES):
            good = []
            for a, text in zip(batch.column(2), batch.column(3), strict=True):
                if a.is_valid:
                    good.append(similarity(elements(text.as_py()), leader) >= threshold)
                else:
                    leader = elements(text.as_py())
                    good.append(False)
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(0)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return rows.mapInArrow(compare, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(doc_id, label) of all documents with links (a, b); the label is the least id of the component.

    In each round a node takes the least label of its neighbours and then that label's own, so chains shorten by half;
    each round is a table in the shared folder, and rounds end when no label falls.
    """
    both = materialize(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("doc_id"), F.least("a", "least").alias("label")), "labels")
    while True:
        heard = both.join(labels.select(F.col("doc_id").alias("b"), "label"), "b").groupBy(F.col("a").alias("doc_id")).agg(F.min("label").alias("heard"))
        step = labels.join(heard, "doc_id").select("doc_id", F.col("label").alias("old"), F.least("label", "heard").alias("new"))
        after = step.join(labels.select(F.col("doc_id").alias("new"), F.col("label").alias("next")), "new", "left").select("doc_id", "old", F.least(F.col("new"), F.coalesce("next", "new")).alias("label"))
        after = materialize(after, "labels")
        if after.where("label < old").isEmpty():
            return after.select("doc_id", "label")
        labels = after.select("doc_id", "label")


def leaders(shared: DataFrame) -> DataFrame:
    """Pairs (a, b) of bucket members and their bucket's leader."""
    fame = shared.groupBy("doc_id").agg(F.sum("n").alias("fame"))
    chosen = shared.join(fame, "doc_id").groupBy("key").agg(F.max(F.struct("fame", -F.col("doc_id"))).alias("top")).select("key", (-F.col("top.col2")).alias("b"))
    return shared.join(chosen, "key").where("doc_id <> b").select(F.col("doc_id").alias("a"), "b").distinct()


def between(shared: DataFrame, labels: DataFrame, number: int) -> DataFrame:
    """Pairs (a, b) of one member for each component of a bucket and one member of a component drawn in it; for buckets with several components."""
    marked = shared.join(labels, "doc_id", "left").select("key", "doc_id", F.coalesce("label", "doc_id").alias("label"))
    drawn = marked.groupBy("key", "label").agg(F.min(F.struct(F.xxhash64(F.lit(number), "key", "doc_id").alias("h"), "doc_id")).alias("m")).select("key", "label", F.col("m.doc_id").alias("a"))
    pivot = drawn.groupBy("key").agg(F.count("*").alias("parts"), F.min(F.struct(F.xxhash64(F.lit(number), "key", "label").alias("h"), F.col("a"))).alias("m")).where("parts > 1").select("key", F.col("m.a").alias("b"))
    return drawn.join(pivot, "key").where("a <> b").select("a", "b").distinct()


def rest_blocks(shared: DataFrame, labels: DataFrame, texts: DataFrame) -> DataFrame:
    """(key, left, right, block, doc_id, label): members of buckets with several components, once for each two blocks to compare.

    A large component of a bucket has blocks of its own, which are not compared with each other; the others are dealt
    out by label. Of buckets with the same members one stays.
    """
    sizes = texts.select("doc_id", F.octet_length("text").alias("bytes"))
    marked = shared.where("n > 2").select("key", "doc_id").join(labels, "doc_id", "left").select("key", "doc_id", F.coalesce("label", "doc_id").alias("label"))
    parts = marked.groupBy("key", "label").agg(F.count("*").alias("members"), F.sum(F.xxhash64("doc_id").cast("decimal(20,0)")).alias("h"), F.bit_xor(F.xxhash64(F.lit(1), "doc_id")).alias("x"))
    whole = parts.groupBy("key").agg(F.count("*").alias("parts"), F.sum("members").alias("n"), F.sum("h").alias("h"), F.bit_xor("x").alias("x")).where("parts > 1")
    kept = materialize(whole.groupBy("n", "h", "x").agg(F.min("key").alias("key")).select("key"), "rest")
    marked = materialize(marked.join(kept, "key", "left_semi").join(sizes, "doc_id"), "rest")
    cuts = lambda n, size: F.ceil(F.greatest(n / PART_ROWS, size / PART_BYTES)).cast("long")
    parts = marked.groupBy("key", "label").agg(cuts(F.count("*"), F.sum("bytes")).alias("cuts"), F.count("*").alias("members"), F.sum("bytes").alias("size"))
    large = (F.col("members") * 2 > PART_ROWS) | (F.col("size") * 2 > PART_BYTES)
    small = parts.where(~large).groupBy("key").agg(cuts(F.sum("members"), F.sum("size")).alias("small_cuts"))
    parts = parts.join(small, "key", "left").select("key", "label", F.when(large, F.col("label")).alias("pure"), F.when(large, F.col("cuts")).otherwise(F.col("small_cuts")).alias("cuts"))
    dealt = F.when(F.col("pure").isNotNull(), F.xxhash64("pure", F.pmod(F.xxhash64("doc_id"), F.col("cuts")))).otherwise(F.pmod(F.xxhash64("label"), F.col("cuts")))
    members = materialize(marked.join(parts, ["key", "label"]).select("key", "doc_id", "label", "pure", dealt.alias("block")), "members")
    blocks = members.select("key", "pure", "block").distinct()
    other = blocks.select("key", F.col("pure").alias("other"), F.col("block").alias("right"))
    met = blocks.withColumnRenamed("block", "left").join(other, "key").where("left <= right and not coalesce(pure = other, false)").select("key", "left", "right")
    sides = met.select("*", F.explode(F.array_distinct(F.array("left", "right"))).alias("block"))
    return members.drop("pure").join(sides, ["key", "block"])


def linked(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, label: np.ndarray, side: np.ndarray | None, threshold: float) -> list[tuple[int, int]]:
    """Links (i, j) that join different labels: all pairs, or those across sides, whose similarity reaches the threshold. doc, element, weight are sorted by doc."""
    n = len(label)
    total, top = np.bincount(doc, weights=weight, minlength=n), {v: v for v in label.tolist()}

    def root(v: int) -> int:
        while top[v] != v:
            top[v] = v = top[top[v]]
        return v

    if side is None:
        names, counts = np.unique(label, return_counts=True)
        probes, stored = np.flatnonzero(label != names[counts.argmax()]), np.ones(n, bool)
    else:
        stored = side != (0 if (side == 0).sum() <= (side == 1).sum() else 1)
        probes = np.flatnonzero(~stored)
    rank = np.unique(element, return_inverse=True)[1]
    mine = np.flatnonzero(stored[doc])
    mine = mine[np.argsort(rank[mine], kind="stable")]
    begin = np.searchsorted(rank[mine], np.arange(rank.max() + 2 if len(rank) else 1))
    owner, heft = doc[mine], weight[mine]
    first = np.searchsorted(doc, np.arange(n + 1))
    found = []
    for i in probes:
        own = slice(first[i], first[i + 1])
        runs = np.diff(begin)[rank[own]] if own.stop - own.start > len(begin) else begin[rank[own] + 1] - begin[rank[own]]
        place = ragged(begin[rank[own]], runs)
        both = np.bincount(owner[place], weights=np.minimum(heft[place], np.repeat(weight[own], runs)), minlength=n)
        union = total[i] + total - both
        for j in np.flatnonzero((both > 0) & (both / np.maximum(union, 1) >= threshold) & (label != label[i])):
            a, b = root(int(label[i])), root(int(label[j]))
            if a != b:
                top[max(a, b)] = min(a, b)
                found.append((int(i), int(j)))
    return found


def rest(shared: DataFrame, labels: DataFrame, texts: DataFrame, weighting: str, threshold: float) -> DataFrame:
    """Links (a, b) between the components of each bucket, from all pairs of members of different ones."""
    rows = rest_blocks(shared, labels, texts).join(texts.select("doc_id", "text"), "doc_id").select("key", "left", "right", "block", "doc_id", "label", "text")

    def compare(table: pa.Table) -> pa.Table:
        ids, label, block = (table.column(c).to_numpy() for c in ("doc_id", "label", "block"))
        doc, element, weight = weigh(*shingles(table.column("text").combine_chunks()))
        if weighting != "count":
            weight = np.ones(len(weight))
        side = None if table.column("left")[0] == table.column("right")[0] else (block == table.column("right")[0].as_py()).astype(int)
        found = np.array(linked(doc, element, weight, label, side, threshold), np.int64).reshape(-1, 2)
        return pa.table({"a": ids[found[:, 0]], "b": ids[found[:, 1]]})

    return rows.groupBy("key", "left", "right").applyInArrow(compare, "a long, b long").distinct()


def classified(docs: DataFrame, id_col: str, text_col: str, threshold: float, weighting: str, bands: int, rows: int, rounds: int) -> DataFrame:
    """One row per document: doc_id, digest of the text, class_id and kept."""
    rows_in = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    copies = materialize(rows_in.select("doc_id", F.sha2("text", 256).alias("digest")), "digests")
    firsts = copies.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("least"))
    clashes = materialize(firsts.groupBy(F.col("least").alias("clash")).agg(F.count("*").alias("n")).where("n > 1").select("clash"), "clashes")
    n_clashes = clashes.count()
    # texts are told apart by their least id; those that share it, by a hash of id and digest
    named = lambda df, of: df.join(F.broadcast(clashes) if n_clashes <= BROADCAST_CLASHES else clashes, F.col(of) == F.col("clash"), "left") if n_clashes else df.withColumn("clash", F.lit(None).cast("long"))
    node = lambda of, digest: F.when(F.col("clash").isNull(), F.col(of)).otherwise(F.xxhash64(F.col(of), digest))
    firsts = materialize(named(firsts, "least").select("digest", "least", node("least", F.col("digest")).alias("rep")), "copies")
    marked = named(rows_in.where("doc_id is not null"), "doc_id").select(node("doc_id", F.sha2("text", 256)).alias("doc_id"), "text")
    originals = marked.join(firsts.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")

    signed = materialize(band_keys(marked, weighting, bands, rows), "bands")
    signed = signed.join(firsts.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").distinct()
    full = signed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialize(signed.join(full, "key"), "buckets")
    texts = materialize(originals.join(shared.select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "texts")
    tried = materialize(leaders(shared), "pairs")
    links = materialize(verified(tried, texts, weighting, threshold), "links")
    labels = components(links)
    for number in range(rounds):
        pairs = between(shared, labels, number).join(tried, ["a", "b"], "left_anti").join(tried.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"], "left_anti")
        pairs = materialize(pairs, "pairs")
        more = materialize(verified(pairs, texts, weighting, threshold), "links")
        tried = tried.union(pairs)
        if more.isEmpty():
            continue
        links = links.union(more)
        labels = components(links)
    more = materialize(rest(shared, labels, texts, weighting, threshold), "links")
    if not more.isEmpty():
        labels = components(links.union(more))
    named_texts = firsts.join(labels.withColumnRenamed("doc_id", "rep"), "rep", "left").select("digest", "least", F.coalesce("label", "rep").alias("label"))
    heads = named_texts.groupBy("label").agg(F.min(F.struct("least", "digest")).alias("head"))
    found = copies.where("doc_id is not null").join(named_texts.join(heads, "label").select("digest", "head"), "digest")
    found = found.select("doc_id", "digest", F.col("head.least").alias("class_id"), ((F.col("doc_id") == F.col("head.least")) & (F.col("digest") == F.col("head.digest"))).alias("kept"))
    return found.unionByName(copies.where("doc_id is null").select("doc_id", "digest", F.lit(None).cast("long").alias("class_id"), F.lit(True).alias("kept")))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, weighting: str = "count", bands: int = BANDS, rows: int = ROWS, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: doc_id, class_id (the least doc_id of its class) and kept (whether it is the document that stays)."""
    return classified(docs, id_col, text_col, threshold, weighting, bands, rows, rounds).drop("digest")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, weighting: str = "count", bands: int = BANDS, rows: int = ROWS, rounds: int = ROUNDS) -> DataFrame:
    """The documents with all their columns, one of each class; documents with a null id are all kept."""
    kept = classified(docs, id_col, text_col, threshold, weighting, bands, rows, rounds).where("kept and doc_id is not null").select("doc_id", "digest").distinct()
    own = docs.where(F.col(id_col).isNotNull()).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("digest"))
    own = own.join(kept, ["doc_id", "digest"], "left_semi").dropDuplicates(["doc_id", "digest"])
    return own.select("row.*").unionByName(docs.where(F.col(id_col).isNull()))
