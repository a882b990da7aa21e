"""Source divergence audit: how the sources of each language differ in the frequencies of its terms.

Terms are maximal runs of ASCII letters and characters beyond ASCII, with A-Z lower-cased; language and source are columns, null counts as ''.

1. First pass: exact document frequencies. Each task counts the distinct terms of its documents by language; the counts are summed. A language keeps the terms of at least
   FEWEST_DOCS of its documents.
2. Second pass: the kept terms, with a delimiter on both sides, go into an Aho-Corasick automaton for each language, which counts their occurrences in
   the folded texts by source. Kept terms are broadcast in slices of at most about SLICE_TERMS terms and SLICE_CHARS bytes, one pass
   each, so a task's automaton is bounded whatever the vocabulary; all slices together hold every kept term.
3. Postings (language, source, term, count) are sparse: a term that a source lacks has the source's least frequency. Tiles of postings, of bounded
   numbers of terms and sources, give partial distances of pairs of sources, which are summed; terms that no source of a tile has are added by their number.

Frequencies are whole numbers, 1 + floor(10^9 (count + 5) / (N + 5 V)), and all arithmetic is exact. A hot source is summed
in the tasks that read it: later steps have a row for each source and term at most. Null or empty texts have no terms, but their source
counts as occurring. Rows with the same id are documents of their own; other columns are ignored; a text of any length is taken whole; an empty table gives an empty table. A language without
kept terms has distance 0 for each pair and no term rows. Of equal values the item that comes first in UTF-8 has the lower rank.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mixweave.llm.shared import materialize

FEWEST_DOCS, TOP_TERMS = 30, 50
HELD = 250_000  # counts that a task holds before it passes them on
SLICE_TERMS, SLICE_CHARS = 200_000, 4 << 20
TILE_TERMS, TILE_SOURCES = 1024, 128
BILLION = "cast(1000000000 as decimal(20, 0))"

_is_letter = np.r_[65:91, 97:123, 128:256]
_folded = np.full(256, 0x20, np.uint8)
_folded[_is_letter] = _is_letter
_folded[65:91] += 32
FOLD = _folded.tobytes()  # what each byte of a text becomes: itself, a lower-case letter, or a space

_automata: dict[str, dict] = {}  # of the last slice that this worker met


def _texts(batch: pa.RecordBatch, *keys: int) -> Iterator[tuple]:
    """(key..., folded text) of each document."""
    columns = [batch.column(i).to_pylist() for i in keys]
    for *key, text in zip(*columns, batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist(), strict=True):
        yield *key, text.translate(FOLD)


def document_counts(docs: DataFrame) -> DataFrame:
    """(lang, term, n): partial numbers of documents that have the term."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = defaultdict(Counter)
        held = 0

        def emptied() -> Iterator[pa.RecordBatch]:
            for lang, found in counts.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(list(found), pa.binary()).cast(pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "term", "n"])
            counts.clear()

        for batch in batches:
            for lang, text in _texts(batch, 0):
                before = len(counts[lang])
                counts[lang].update(set(text.split()))
                held += len(counts[lang]) - before
                if held > HELD:
                    yield from emptied()
                    held = 0
        yield from emptied()

    return docs.select("lang", "text").mapInArrow(task, "lang string, term string, n long")


def _built(token: str, terms: dict[str, list[str]]) -> dict:
    """The automata of a slice, made once in each worker. Bytes are taken as Latin-1 characters, so that the automaton walks UTF-8."""
    import ahocorasick

    if token not in _automata:
        made = {}
        for lang, found in terms.items():
            made[lang] = ahocorasick.Automaton()
            for i, term in enumerate(found):
                made[lang].add_word(f" {term.encode().decode('latin-1')} ", i)
            made[lang].make_automaton()
        _automata.clear()
        _automata[token] = made
    return _automata[token]


def occurrences(docs: DataFrame, terms: dict[str, list[str]]) -> DataFrame:
    """(lang, source, term, n): partial numbers of occurrences of the given terms of each language."""
    shared, token = docs.sparkSession.sparkContext.broadcast(terms), uuid.uuid4().hex

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, Counter] = defaultdict(Counter)
        held = 0

        def emptied() -> Iterator[pa.RecordBatch]:
            for (lang, source), found in counts.items():
                names = [shared.value[lang][i] for i in found]
                yield pa.RecordBatch.from_arrays([pa.array([v] * len(found), pa.string()) for v in (lang, source)] + [pa.array(names, pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "source", "term", "n"])
            counts.clear()

        for batch in batches:
            automata = _built(token, shared.value)
            for lang, source, text in _texts(batch, 0, 1):
                if lang in automata:
                    before = len(counts[lang, source])
                    counts[lang, source].update(i for _, i in automata[lang].iter(f" {text.decode('latin-1')} "))
                    held += len(counts[lang, source]) - before
                    if held > HELD:
                        yield from emptied()
                        held = 0
        yield from emptied()

    return docs.select("lang", "source", "text").mapInArrow(task, "lang string, source string, term string, n long")


def postings(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, term, n) for all kept terms that occur in a source."""
    n, size = kept.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
    slices = max(1, math.ceil(n / SLICE_TERMS), math.ceil(size / SLICE_CHARS))
    found = []
    for i in range(slices):
        terms: dict[str, list[str]] = defaultdict(list)
        for r in kept.where(F.pmod(F.xxhash64("lang", "term"), F.lit(slices)) == i).collect():  # a bounded slice
            terms[r.lang].append(r.term)
        counted = occurrences(docs, dict(terms)).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))
        found.append(materialize(counted, "postings"))
    return reduce(DataFrame.unionByName, found)


def frequency(count: str, total: str, kept: str) -> Column:
    return F.expr(f"1 + ({BILLION} * ({count} + 5)) div ({total} + 5 * {kept})")


def _tile(table: pa.Table) -> pa.Table:
    """Partial distances of the pairs of sources of two tiles over some terms. Rows without a term give a source's least frequency."""
    lang, lo, hi = (table[c][0].as_py() for c in ("lang", "lo", "hi"))
    sources = table["source"].combine_chunks().dictionary_encode()
    terms = table["term"].combine_chunks().dictionary_encode()
    at, p = sources.indices.to_numpy(), table["p"].to_numpy()
    least, has = terms.indices.is_null().to_numpy(zero_copy_only=False), terms.indices.is_valid().to_numpy(zero_copy_only=False)
    names, wide = sources.dictionary, len(terms.dictionary)
    tile, floor = np.empty(len(names), np.int64), np.empty(len(names), np.int64)
    tile[at], floor[at[least]] = table["tile"].to_numpy(), p[least]
    dense = np.repeat(floor[:, None], max(wide, 1), axis=1)
    dense[at[has], terms.indices.drop_null().to_numpy()] = p[has]
    apart = np.stack([np.abs(dense - row).sum(axis=1) for row in dense])
    a, b = np.nonzero(tile[:, None] != tile[None, :]) if lo != hi else np.nonzero(~np.eye(len(names), dtype=bool))
    return pa.table([pa.array([lang] * len(a), pa.string()), names.take(pa.array(a)), names.take(pa.array(b)), pa.array(apart[a, b]), pa.array(np.full(len(a), wide))], names=["lang", "source", "item", "value", "known"])


def pair_distances(found: DataFrame, sources: DataFrame) -> DataFrame:
    """(lang, source, item, value): the distance of each ordered pair of sources of a language over all its kept terms.

    found has lang, source, term, p and v (terms of the language); sources has lang, source, least, v and size (sources of the language).
    """
    tiles, slices = F.expr(f"cast(ceil(size / {TILE_SOURCES}) as int)"), F.expr(f"cast(ceil(v / {TILE_TERMS}) as int)")
    here = F.pmod(F.xxhash64("source"), tiles).cast("int").alias("tile")
    rows = found.select("lang", "source", "term", "p", F.pmod(F.xxhash64("term"), slices).cast("int").alias("slice"), here, tiles.alias("tiles"))
    least = sources.where("v > 0").select("lang", "source", F.lit(None).cast("string").alias("term"), F.col("least").alias("p"), F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"), here, tiles.alias("tiles"))
    each = rows.unionByName(least).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    each = each.select("lang", "source", "term", "p", "slice", "tile", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"))
    parts = each.groupBy("lang", "slice", "lo", "hi").applyInArrow(_tile, "lang string, source string, item string, value long, known long")
    sums = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("known").alias("known"))
    mine = sources.select("lang", "source", "least", "v")
    others = sources.select("lang", F.col("source").alias("item"), F.col("least").alias("other_least"))
    rest = (F.col("v") - F.coalesce("known", F.lit(0))) * F.abs(F.col("least") - F.col("other_least"))
    value = F.when(F.col("v") > 0, F.coalesce("value", F.lit(0)) + rest).otherwise(0)
    return mine.join(others, "lang").where(F.col("source") != F.col("item")).join(sums, ["lang", "source", "item"], "left").select("lang", "source", "item", value.cast("long").alias("value"))


def audit(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank): part pair has each other source of the language by distance, part term the TOP_TERMS kept terms that a source has more often than its language."""
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    kept = document_counts(docs).groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= FEWEST_DOCS).select("lang", "term")
    kept = materialize(kept, "vocabulary")
    counts = postings(docs, kept)
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    every = docs.groupBy("lang", "source").agg(F.lit(1).alias("one")).drop("one")
    sources = every.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").fillna(0, ["total", "v"])
    sources = materialize(sources.join(every.groupBy("lang").agg(F.count("*").alias("size")), "lang").withColumn("least", F.when(F.col("v") > 0, frequency("0", "total", "v")).otherwise(0)), "sources")
    whole = sources.groupBy("lang").agg(F.sum("total").alias("all"))
    overall = counts.groupBy("lang", "term").agg(F.sum("n").alias("everywhere"))
    found = counts.join(sources, ["lang", "source"]).withColumn("p", frequency("n", "total", "v"))
    more = found.join(overall, ["lang", "term"]).join(whole, "lang").select("lang", "source", F.col("term").alias("item"), (F.col("p") - frequency("everywhere", "`all`", "v")).alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    terms = more.where("value > 0").withColumn("rank", place).where(F.col("rank") <= TOP_TERMS)
    pairs = pair_distances(found, sources).withColumn("rank", place)
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return columns(pairs, "pair").unionByName(columns(terms, "term"))
