"""License scans: MinHash bands over overlapping text windows retrieve templates, and exact shingle containment verifies them.

Words are compared in lower case without the punctuation around them, in shingles of three. Shingle positions are cut
into blocks; windows of 2, 4, 8 ... blocks overlap by half, so a template of up to half a window lies whole in one of
them. A window's MinHash values are the minima of its halves', so each size is made from the one below. A band is one
MinHash value: a window that contains 80 per cent of a template of a quarter to a half of its length shares a band with a
probability above 1 - (1 - 0.19)^44, all but 1e-4. Templates of up to TINY shingles, which are too small a part of any
window for that, are found by one of their shingles instead, as all of them must be there. There are as many window sizes as the longest
template needs. Windows that share no band with any template of their size are
dropped in place (the bank of templates is a parameter of at most MAX_TEMPLATES); the others are joined to the template
bands, and each distinct (window, template) is verified by exact containment of shingles. Bands and shingles of templates are
broadcast apart, each only within BROADCAST_BYTES; beyond it they are joined by a shuffle. Every template that reaches the
threshold is reported, whatever else its window holds. Only versions of one notice are told apart: templates of one level
where the text of one alone brings the other to the threshold. A match that has less than half of the shingles by
which its template differs from a version is dropped where that version matches too and has more of its own
differing shingles, at the place of the match.

Defined cases. Null or blank text: no match. Texts shorter than a template's shingles: no match unless they contain enough of
them. A template without a shingle is an error. Repeated rows share the matches of their id. A null doc_id gets no match. Ties for the best
template go to the first name. Empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixweave.llm.near_dedup import GOLDEN, mixed, ragged, shingles
from mixweave.llm.shared import materialize, text_slices

SHINGLE, BLOCK, BANDS = 3, 8, 44
TINY = 2  # shingles
CONTAINMENT = 0.8
MAX_TEMPLATES = 10_000
BROADCAST_BYTES = 64 << 20
SLICE_BYTES = 2 << 20
PUNCTUATION = ".,;:!?\"'()[]{}<>*#%$&|/\\-_=+~`"  # fixed values
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def normal(word: str) -> str:
    return word.lower().strip(PUNCTUATION)


def level_of(n_shingles: int) -> int:
    """The smallest window size (2^(level + 1) blocks) that is twice as long as a template."""
    return max(0, (-(-n_shingles // BLOCK) - 1).bit_length())


def permuted(hashes: np.ndarray, band: int) -> np.ndarray:
    x = (hashes ^ (np.full(1, band + 1, np.uint64) * GOLDEN)) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def bank(templates: dict[str, str]) -> dict[str, tuple[int, np.ndarray, np.ndarray]]:
    """For each template its level, distinct shingles and band values; a tiny one has a further value, one of its shingles."""
    if not 0 < len(templates) <= MAX_TEMPLATES:
        raise ValueError(f"1 to {MAX_TEMPLATES} templates are needed")
    made = {}
    for name, text in templates.items():
        found = np.unique(shingles(pa.array([text]), SHINGLE, normal)[1])
        if not len(found):
            raise ValueError(f"template {name} is empty")
        made[name] = level_of(len(found)), found, np.array([*(permuted(found, b).min() for b in range(BANDS)), *found[: len(found) <= TINY]], np.uint64)
    return made


def band_table(spark: SparkSession, made: dict) -> DataFrame:
    rows = [(name, level, b, int(v.view(np.int64))) for name, (level, _, values) in made.items() for b, v in enumerate(values)]
    return spark.createDataFrame(rows, "template string, level int, band int, value long")


def shingle_table(spark: SparkSession, made: dict) -> DataFrame:
    return spark.createDataFrame([(name, found.view(np.int64).tolist()) for name, (_, found, _) in made.items()], "template string, template_shingles array<long>")


def bounded(table: DataFrame, size: int) -> DataFrame:
    return F.broadcast(table) if size <= BROADCAST_BYTES else table


def version_table(spark: SparkSession, made: dict, containment: float) -> DataFrame:
    """(template, rival, own, rival_own): for each template the versions whose text alone brings it to the threshold, and the shingles by which the two differ."""
    holders: dict[tuple[int, int], list] = {}
    for name, (level, found, _) in made.items():
        for x in found.tolist():
            holders.setdefault((level, x), []).append(name)
    rows = []
    for name, (level, found, _) in made.items():
        met = Counter(other for x in found.tolist() for other in holders[level, x] if other != name)
        for other, both in met.items():
            theirs = made[other][1]
            if containment * len(found) <= both < min(len(found), len(theirs)):
                rows.append((name, other, np.setdiff1d(found, theirs).view(np.int64).tolist(), np.setdiff1d(theirs, found).view(np.int64).tolist()))
    return spark.createDataFrame(rows, "template string, rival string, own array<long>, rival_own array<long>")


def without_versions(good: DataFrame, versions: DataFrame) -> DataFrame:
    """The matches (doc_id, level, start, template, containment, shingles, template_shingles) that no version at their place explains better."""
    places = lambda wanted: F.filter(F.transform("shingles", lambda x, i: F.when(F.array_contains(wanted, x), F.col("start") + i)), lambda p: p.isNotNull())
    share = lambda wanted: F.size(F.array_intersect("shingles", wanted)) / F.size(wanted)
    named = ["doc_id", "level", "start", "template"]
    at, missing = places(F.col("template_shingles")), F.round((1 - F.col("containment")) * F.size("template_shingles"))
    versions = materialize(versions, "versions")
    heavy = versions.agg(F.sum(8 * (F.size("own") + F.size("rival_own")) + 200)).first()[0] or 0
    weak = good.join(bounded(versions, heavy), "template").withColumn("part", share(F.col("own"))).where("part < 0.5")
    weak = weak.select(*named, "rival", "part", (F.array_min(at) - missing).alias("lo"), (F.array_max(at) + missing).alias("hi"))
    sides = versions.select(F.col("rival").alias("template"), F.col("template").alias("other"), "rival_own")
    strong = good.join(bounded(sides, heavy), "template").select("doc_id", F.col("template").alias("rival"), F.col("other").alias("template"), share(F.col("rival_own")).alias("rival_part"), places(F.col("rival_own")).alias("rival_at"))
    beaten = weak.join(strong, ["doc_id", "template", "rival"]).where((F.col("rival_part") > F.col("part")) & F.exists("rival_at", lambda p: p.between(F.col("lo"), F.col("hi"))))
    return good.join(beaten.select(*named).distinct(), named, "left_anti")


def candidate_windows(docs: DataFrame, made: dict) -> DataFrame:
    """(doc_id, level, start, bands, shingles): windows that share a band value with a template of their level, and their shingles in order."""
    levels = 1 + max(level for level, _, _ in made.values())
    by_level = [[v for lv, _, v in made.values() if lv == level] for level in range(levels)]
    wanted = [np.array([[v[b] for v in values] for b in range(BANDS)], np.uint64) for values in by_level]
    tiny = np.unique(np.array([v[BANDS] for _, _, v in made.values() if len(v) > BANDS], np.uint64))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = BLOCK << (levels - 1)
        for batch in text_slices(batches, 1, SLICE_BYTES):
            doc, hashes = shingles(batch.column(1), SHINGLE, normal)
            n = np.bincount(doc, minlength=batch.num_rows)
            padded = -(-n // unit) * unit
            begin = np.cumsum(padded) - padded
            place = ragged(begin, n)
            total = int(padded.sum())
            own = np.repeat(np.arange(batch.num_rows), padded // BLOCK)
            hits: dict[tuple[int, int], list] = {}
            filled = np.full(total, NONE)
            for b in range(BANDS):
                filled[place] = permuted(hashes, b)
                half = filled.reshape(-1, BLOCK).min(axis=1)
                for level in range(levels):
                    owner = own[:: 1 << level]
                    after = np.append(half[1:], NONE)
                    after[np.append(owner[1:] != owner[:-1], True)] = NONE
                    window = np.minimum(half, after)
                    for at in np.flatnonzero(np.isin(window, wanted[level][b])) if wanted[level].size else ():
                        hits.setdefault((level, int(at)), []).append((b, int(window[at : at + 1].view(np.int64)[0])))
                    if level < levels - 1:
                        half = np.minimum(half[0::2], half[1::2])
            rows = []
            raw = np.full(total, NONE)
            raw[place] = hashes
            real = np.zeros(total, bool)
            real[place] = True
            for at in np.flatnonzero(np.isin(raw, tiny) & real) if len(tiny) else ():
                block = int(at) // BLOCK
                for first in {block, block - 1} if block and own[block - 1] == own[block] else {block}:
                    hits.setdefault((0, first), []).append((BANDS, int(raw[at : at + 1].view(np.int64)[0])))
            for (level, at), bands in hits.items():
                lo = (at * BLOCK) << level
                d = int(own[lo // BLOCK])
                hi = min(lo + (2 * BLOCK << level), int(begin[d] + padded[d]))
                inside = raw[lo:hi][real[lo:hi]]
                rows.append((batch.column(0)[d].as_py(), level, lo - int(begin[d]), [{"band": b, "value": v} for b, v in bands], inside.view(np.int64).tolist()))
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.struct([("band", pa.int32()), ("value", pa.int64())])), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "level", "start", "bands", "shingles"])

    return docs.mapInArrow(scan, "doc_id long, level int, start long, bands array<struct<band: int, value: long>>, shingles array<long>")


def matches(docs: DataFrame, templates: dict[str, str], id_col: str = "doc_id", text_col: str = "text", containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, template, containment, start): verified matches, the best window of each template in a document; start counts words."""
    made = bank(templates)
    bands = band_table(docs.sparkSession, made)
    found = candidate_windows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), made)
    met = found.select("doc_id", "level", "start", "shingles", F.explode("bands").alias("b")).select("doc_id", "level", "start", "shingles", "b.band", "b.value")
    entries = sum(len(values) for _, _, values in made.values())
    widest = max(len(name.encode()) for name in made)
    pairs = met.join(bounded(bands, entries * (40 + widest)), ["level", "band", "value"]).dropDuplicates(["doc_id", "level", "start", "template"])
    pairs = pairs.join(bounded(shingle_table(docs.sparkSession, made), sum(8 * len(found) + 40 + widest for _, found, _ in made.values())), "template")
    share = F.size(F.array_intersect("shingles", "template_shingles")) / F.size("template_shingles")
    good = pairs.select("doc_id", "level", "start", "template", share.alias("containment"), "shingles", "template_shingles").where(F.col("containment") >= containment)
    good = without_versions(materialize(good, "matches"), version_table(docs.sparkSession, made, containment))
    best = good.groupBy("doc_id", "template").agg(F.max(F.struct("containment", -F.col("start"))).alias("m"))
    return best.select("doc_id", "template", F.col("m.containment").alias("containment"), (-F.col("m.col2")).alias("start"))


def scan_licenses(docs: DataFrame, templates: dict[str, str], id_col: str = "doc_id", text_col: str = "text", containment: float = CONTAINMENT) -> DataFrame:
    """One row per document: doc_id, n_licenses, licenses (names in order, comma-separated), best_template and best_containment."""
    found = materialize(matches(docs, templates, id_col, text_col, containment), "licenses")
    per_doc = found.groupBy("doc_id").agg(F.count("*").alias("n_licenses"), F.array_join(F.sort_array(F.collect_set("template")), ",").alias("licenses"), F.min(F.struct(-F.col("containment"), F.col("template"))).alias("best"))
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    return ids.join(per_doc, "doc_id", "left").select("doc_id", F.coalesce("n_licenses", F.lit(0)).alias("n_licenses"), F.coalesce("licenses", F.lit("")).alias("licenses"), F.col("best.template").alias("best_template"), F.coalesce(-F.col("best.col1"), F.lit(0.0)).alias("best_containment"))
