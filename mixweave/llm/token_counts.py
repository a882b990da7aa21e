"""Token counts under a sentencepiece BPE model, without tokenizing each text anew.

A text falls into pre-tokens that no piece spans (a run of spaces and the word after it; a line break ends one too).
Each Arrow batch keeps its distinct pre-tokens as one ragged numpy array of symbols and merges all of them in
rounds: in a round every pre-token applies its own lowest-rank pair, at all places where it stands, to all
pre-tokens at once; finished pre-tokens leave the array with the number of their surviving symbols. Where a piece ranks
behind the pieces it is made of, a merge never brings up a lower rank, and rounds give what merging one pair at a time
gives; a piece for which that fails (found when the model is read) is merged at its leftmost place only. Counts of short pre-tokens are kept between batches, up to a bound.

Defined cases. Null or empty text: 0 bytes and 0 tokens. Repeated rows each count. Null ids stay null. A very long
pre-token is first cut between characters that stand side by side in no piece. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixweave.llm.shared import text_slices

TOKEN_LIMIT = 4096
SLICE_BYTES = 8 << 20
CACHE_WORDS = 1_000_000  # distinct pre-tokens whose counts a worker keeps between batches
CACHED_CHARS = 48  # a longer pre-token isn't kept
LONG_CHARS = 256  # a longer pre-token is cut where no piece can span
MARK = "▁"
NEVER = np.iinfo(np.int32).max

COUNT_SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


class MergeRanks:
    """The model as arrays: a symbol for each character and piece, and the rank and result of each pair that merges."""

    def __init__(self, model_path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(model_path, "rb") as f:
            model.ParseFromString(f.read())
        kinds, norm, spec = {p.type for p in model.pieces}, model.normalizer_spec, model.trainer_spec
        plain = pb.ModelProto.SentencePiece
        if spec.model_type != pb.TrainerSpec.BPE or not spec.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or kinds - {plain.NORMAL, plain.UNKNOWN, plain.CONTROL, plain.BYTE}:
            raise ValueError(f"{model_path} isn't an identity-normalised BPE model with byte fallback")
        pieces = {p.piece: p.score for p in model.pieces if p.type == plain.NORMAL}
        order = {s: i for i, s in enumerate(sorted(set(pieces.values()), reverse=True))}
        chars = sorted({c for p in pieces for c in p})
        ids = {c: i + 1 for i, c in enumerate(chars)}  # 0: a character of no piece
        for p in pieces:
            ids.setdefault(p, len(ids) + 1)
        pairs, uneven = [], set()
        for p, score in pieces.items():
            for i in range(1, len(p)):
                a, b = p[:i], p[i:]
                if a in ids and b in ids:
                    pairs.append((ids[a], ids[b], order[score], ids[p]))
                    uneven.update(ids[x] for x in (a, b) if len(x) > 1 and order[pieces[x]] >= order[score])
        pairs.sort()
        table = np.array(pairs, np.int64).reshape(-1, 4)
        self.width = len(ids) + 1
        self.keys, self.ranks, self.made = table[:, 0] * self.width + table[:, 1], table[:, 2].astype(np.int32), table[:, 3].astype(np.int32)
        self.uneven = np.zeros(self.width, bool)  # pieces inside one that ranks before them
        self.uneven[list(uneven)] = True
        self.symbol = np.zeros(0x110000, np.int32)
        self.tokens = np.ones(0x110000, np.int8)  # of a character that stays alone: its bytes, if it is no piece
        self.tokens[0x80:], self.tokens[0x800:], self.tokens[0x10000:] = 2, 3, 4
        for c in chars:
            self.symbol[ord(c)] = ids[c]
            if c in pieces:
                self.tokens[ord(c)] = 1
        beside = {(ord(p[i]) << 21) | ord(p[i + 1]) for p in pieces for i in range(len(p) - 1)}
        self.beside = np.array(sorted(beside), np.int64)
        self.breaks_lines = not self.symbol[ord("\n")]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece spans two words")

    def pair_at(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The place of each pair in the table, or -1."""
        key = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, -1)

    def counts(self, words: list[str]) -> np.ndarray:
        """Tokens of each pre-token, all merged together in rounds."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words)), lengths)
        starts_at = np.cumsum(lengths) - lengths
        first = np.zeros(len(points), bool)
        first[starts_at[lengths > 0]] = True
        if len(words) and lengths.max() > LONG_CHARS:
            spans = (points[:-1].astype(np.int64) << 21) | points[1:]
            long = lengths[word[1:]] > LONG_CHARS
            first[1:][long] |= ~np.isin(spans[long], self.beside)
        total = np.zeros(len(words), np.int64)
        sym, weight = self.symbol[points], self.tokens[points].astype(np.int64)
        last = np.append(first[1:], True) if len(points) else first
        at = np.full(len(points), -1)
        inner = np.flatnonzero(~last)
        at[inner] = self.pair_at(sym[inner], sym[inner + 1])
        rank = np.where(at >= 0, self.ranks[at], NEVER)
        while len(sym):
            starts = np.flatnonzero(first)
            sizes = np.diff(np.append(starts, len(sym)))
            lowest = np.minimum.reduceat(rank, starts)
            going = np.repeat(lowest != NEVER, sizes)
            if not going.all():  # finished sequences leave with what survives of them
                np.add.at(total, word[~going], weight[~going])
                sym, weight, rank, at, first, word = (x[going] for x in (sym, weight, rank, at, first, word))
                lowest, sizes = lowest[lowest != NEVER], sizes[lowest != NEVER]
                if not len(sym):
                    break
            here = np.flatnonzero(rank == np.repeat(lowest, sizes))
            run = np.cumsum(np.append(True, np.diff(here) != 1))  # overlapping places: every second one, from the left
            into = np.arange(len(here)) - np.searchsorted(run, run)
            here = here[into % 2 == 0]
            if (alone := self.uneven[self.made[at[here]]]).any():  # its merge may bring up a lower rank: the leftmost place only
                seq = np.repeat(np.arange(len(sizes)), sizes)[here]
                here = here[~alone | np.append(True, seq[1:] != seq[:-1])]
            sym[here], weight[here] = self.made[at[here]], 1
            keep = np.ones(len(sym), bool)
            keep[here + 1] = False
            place = np.cumsum(keep) - 1
            sym, weight, rank, at, first, word = (x[keep] for x in (sym, weight, rank, at, first, word))
            here = place[here]
            ends = np.append(first[1:], True)
            rank[here], at[here] = NEVER, -1
            redo = np.concatenate([here, here[~first[here]] - 1])
            redo = redo[~ends[redo]]
            at[redo] = self.pair_at(sym[redo], sym[redo + 1])
            rank[redo] = np.where(at[redo] >= 0, self.ranks[at[redo]], NEVER)
        return total


class TokenCounter:
    def __init__(self, model_path: str):
        self.model = MergeRanks(model_path)
        self.cache: dict[str, int] = {}

    def of_words(self, words: list[str]) -> np.ndarray:
        """Counts of pre-tokens, from the cache or by merging."""
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        known = list(map(self.cache.get, words))
        new = [i for i, n in enumerate(known) if n is None]
        for i, n in zip(new, self.model.counts([words[i] for i in new]).tolist(), strict=True):
            known[i] = n
            if len(words[i]) <= CACHED_CHARS:
                self.cache[words[i]] = n
        return np.array(known, np.int64)

    def of_texts(self, texts: pa.Array) -> np.ndarray:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        marked = pc.replace_substring(texts, MARK, " ")
        if self.model.breaks_lines:  # a word after a line break has no mark before it
            marked = pc.replace_substring(marked, "\n", " \n")
        lists = pc.split_pattern(marked, " ")
        bounds = np.asarray(lists.offsets)
        coded = lists.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        parts, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        odd = np.fromiter((not p for p in parts), bool, len(parts))  # a run of spaces, or one at an end
        each = self.of_words([p if p[:1] == "\n" and self.model.breaks_lines else MARK + p for p in parts])
        doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
        found = np.bincount(doc, weights=each[codes], minlength=len(texts)).astype(np.int64)
        for d in np.unique(doc[odd[codes]]).tolist():
            text = texts[d].as_py()
            words = re.findall(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n" if self.model.breaks_lines else f"{MARK}*[^{MARK}]+|{MARK}+", MARK + text.replace(" ", MARK)) if text else []
            distinct = list(dict.fromkeys(words))
            n = dict(zip(distinct, self.of_words(distinct).tolist(), strict=True))
            found[d] = sum(n[w] for w in words)
        return found


def token_counts(docs: DataFrame, model_path: str, limit: int = TOKEN_LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes of its UTF-8, n_tokens, and whether they are over the limit. A map: nothing is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(model_path)
        for batch in text_slices(batches, 1, SLICE_BYTES):
            n = counter.of_texts(batch.column(1))
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(count, COUNT_SCHEMA)
