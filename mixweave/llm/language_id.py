"""Language identification by rank-order profiles of character n-grams.

Training counts all n-grams (one to three letters, a word's edge counting as a character) of all training documents:
counts are added up in each task before the shuffle, and the `top` n-grams of each language, most frequent first, are its
profile. A document's own most frequent n-grams are compared with each profile: the out-of-place distance adds the difference of
ranks, and `top` for an n-gram that the profile lacks. The least distance wins. Profiles are collected: at most
MAX_LANGUAGES times `top` rows, checked.

Defined cases. Null text or text without letters: `und`, score 0. Ties between languages go to the first in
alphabetical order; ties between n-grams go to the smaller code points. Documents with null lang, text or id train
nothing; a null id is not held out. Without any training document, all predictions are `und` with score 0. Repeated rows
count as often as they occur. Very long texts are read whole. Empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mixweave.llm.shared import materialize, text_slices

TOP = 400
MAX_LANGUAGES = 1000
HELD_OUT_OF, HELD_OUT = 3, 1
FLUSH_GRAMS = 2_000_000  # distinct n-grams of a language that a task adds up before it sends them on
SLICE_BYTES = 8 << 20
BITS = np.int64(21)  # of a code point
SALTS = 64

PREDICTED_SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def letters() -> np.ndarray:
    """For each code point, itself plus one if it is a letter, and one (a word's edge) if not."""
    return np.fromiter((c + 1 if chr(c).isalpha() else 1 for c in range(0x110000)), np.int64, 0x110000)


def grams(text: str, table: np.ndarray) -> np.ndarray:
    """All 1- to 3-grams of a text as integers, with repetitions; none if it has no letters."""
    c = table[np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), np.uint32)]
    edge = c == 1
    c = c[~edge | np.append(True, ~edge[:-1])]
    if len(c) < 2:
        return np.zeros(0, np.int64)
    two = (c[:-1] << BITS) | c[1:]
    inner = c[1:-1] > 1
    return np.concatenate([c[c > 1], two, ((two[:-1] << BITS) | c[2:])[inner]])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT_OF == HELD_OUT, F.lit(False))


def profiles(docs: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, gram, place) of the most frequent n-grams of each language; docs has text and lang, both non-null."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = letters(), {}

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, (keys, n) in seen.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(n)], names=["lang", "gram", "n"])
            seen.clear()

        for batch in text_slices(batches, 1, SLICE_BYTES):
            mine: dict[str, list] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                mine.setdefault(lang, []).append(np.unique(grams(text, table), return_counts=True))
            for lang, found in mine.items():
                keys, n = map(np.concatenate, zip(*found, *([seen[lang]] if lang in seen else []), strict=True))
                distinct, inverse = np.unique(keys, return_inverse=True)
                total = np.zeros(len(distinct), np.int64)
                np.add.at(total, inverse, n)
                seen[lang] = (distinct, total)
            if sum(len(k) for k, _ in seen.values()) > FLUSH_GRAMS:
                yield from rows()
        yield from rows()

    counted = docs.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = (F.col("n").desc(), F.col("gram"))
    part = counted.withColumn("salt", F.pmod(F.xxhash64("gram"), F.lit(SALTS)))
    part = part.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best))).where(F.col("place") <= top)
    return part.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(*best)) - 1).where(F.col("place") < top).select("lang", "gram", "place")


def predict(docs: DataFrame, learned: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each document; the score is one less the mean distance of an n-gram over top."""
    rows = learned.limit(MAX_LANGUAGES * top + 1).collect()
    if len(rows) > MAX_LANGUAGES * top:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    langs = sorted({r.lang for r in rows})
    known = np.unique(np.array([r.gram for r in rows], np.int64))
    places = np.full((len(langs), len(known)), -1, np.int64)
    for r in rows:
        places[langs.index(r.lang), np.searchsorted(known, r.gram)] = r.place

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = letters()

        def one(text: str | None) -> tuple[str, float]:
            found, n = np.unique(grams(text or "", table), return_counts=True)
            if not len(found) or not langs:
                return "und", 0.0
            mine = found[np.lexsort((found, -n))[:top]]
            at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
            theirs = np.where(known[at] == mine, places[:, at], -1)
            distance = np.where(theirs >= 0, np.abs(theirs - np.arange(len(mine))), top).sum(axis=1)
            least = int(distance.argmin())
            return langs[least], 1.0 - float(distance[least]) / (top * len(mine))

        for batch in text_slices(batches, 2, SLICE_BYTES):
            lang, score = zip(*map(one, batch.column(2).to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    doc_id = F.col(id_col).cast("long")
    return docs.select(doc_id.alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text")).mapInArrow(classify, PREDICTED_SCHEMA)


def identify(docs: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learns profiles from the documents that aren't held out and predicts all."""
    train = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & ~held_out(F.col(id_col)))
    learned = materialize(profiles(train.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")), top), "profiles")
    return predict(docs, learned, top, id_col, text_col)
