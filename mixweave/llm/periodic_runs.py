"""Periodic runs of words: every stretch that repeats itself four times or more, and texts with the repeats cut.

A run is a stretch of words with smallest period q (words q apart are the same), of at least FEWEST words and EXPONENT * q,
that no neighbouring word extends. Documents are independent, so nothing is shuffled: each task takes slices of documents.
A slice is one array of word numbers, and its steps are those of the LPF-based variant:

1. A suffix array by prefix doubling, the document as first key; ties alone are sorted again. The ranks of each doubling stay as tables: two
   blocks of 2^h words are the same where their ranks of level h are. So common extensions to the right and to the left cost one look at each level and are exact.
2. Longest previous factors from the suffix array and its LCP values: positions leave a linked list from the last to the first.
3. LZ blocks from the factors; a block is the longest earlier factor (which may overlap it), or one new word.
4. A run that touches a border of blocks has a period under a third of the two blocks around it, because of its exponent, and one of the
   two windows of a period's length left and right of the border repeats. Main's extensions around such borders find these runs.
5. Any other run lies inside a block and is a copy of an earlier one: runs in buckets by start are copied along with blocks, from left to right.

Null or blank text: no words, no runs, an empty collapsed text. Rows with the same doc_id are documents of their own. A null
doc_id stays null. Other columns, whatever their names, are ignored. An empty table gives an empty table. A text of any length is taken whole: memory grows with the longest
text (some 4 bytes a word for each doubling of its longest repeated passage, and 100 more), not with the table.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixweave.llm.shared import SPACE_CHARS, text_slices

FEWEST, EXPONENT = 6, 4
SLICE_BYTES = 4 << 20
RUNS = "array<struct<start: long, length: long, period: long>>"
RUN_SCHEMA = f"doc_id long, n_words long, runs {RUNS}, collapsed string"

IN_WORD = np.ones(256, bool)
IN_WORD[[ord(c) for c in SPACE_CHARS]] = False


class Words:
    """The words of some texts: their bytes, their numbers (the same for the same word), and the first word of each text."""

    def __init__(self, texts: pa.Array):
        joined = [t or b"" for t in texts.cast(pa.binary()).to_pylist()]
        self.data = np.frombuffer(b" ".join([*joined, b""]), np.uint8)  # a space ends each text
        inside = IN_WORD[self.data]
        change = np.diff(inside.view(np.int8), prepend=np.int8(0))
        self.begins, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
        self.lengths = ends - self.begins
        sizes = np.fromiter(map(len, joined), np.int64, len(joined)) + 1
        self.first = np.searchsorted(self.begins, np.concatenate([[0], np.cumsum(sizes)]))
        offsets = np.concatenate([[0], np.cumsum(self.lengths)])
        packed = pa.Array.from_buffers(pa.large_binary(), len(self.lengths), [None, pa.py_buffer(offsets), pa.py_buffer(self.data[inside])])
        self.number = packed.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) if len(packed) else np.zeros(0, np.int64)

    def joined(self, order: np.ndarray, first: np.ndarray) -> pa.Array:
        """For each text, words joined by spaces; text t has the words order[first[t]:first[t + 1]]."""
        long = self.lengths[order] + 1
        ends = np.cumsum(long)
        at = np.repeat(self.begins[order] - (ends - long), long) + np.arange(ends[-1] if len(ends) else 0)
        out = self.data[at]
        out[ends - 1] = 0x20
        some = first[1:] > first[:-1]
        bounds = np.concatenate([[0], ends])[first]
        out = np.delete(out, bounds[1:][some] - 1)
        offsets = bounds - np.concatenate([[0], np.cumsum(some)])
        return pa.Array.from_buffers(pa.large_string(), len(some), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out)]).cast(pa.string())


class Suffixes:
    """The suffix array of texts laid end to end, and the rank tables of its doublings; no block reaches into another text."""

    def __init__(self, number: np.ndarray, first: np.ndarray):
        n = len(number)
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        self.end = first[1:][text]
        key = text * (number.max(initial=0) + 1) + number
        self.order = np.argsort(key, kind="stable")
        rank, slots = np.empty(n + 1, np.int32), np.arange(n)
        rank[n] = -1
        self.levels: list[np.ndarray] = []
        placed, step = key[self.order], 1
        mine = self.order
        while len(slots):
            new = np.concatenate([[True], placed[1:] != placed[:-1]])
            start = np.flatnonzero(new)
            rank[mine] = np.repeat(slots[start], np.diff(np.append(start, len(slots))))
            self.levels.append(rank.copy())
            tied = ~new | np.append(~new[1:], False)
            slots, mine = slots[tied], mine[tied]
            after = mine + step
            second = np.where(after < self.end[mine], rank[np.minimum(after, n)] + 1, 0).astype(np.int64)
            placed = rank[mine].astype(np.int64) * (n + 2) + second
            sort = np.argsort(placed, kind="stable")
            placed, mine = placed[sort], mine[sort]
            self.order[slots] = mine
            step *= 2

    def right(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from a on are those from b on (a and b differ)."""
        at, ahead = a.copy(), b - a
        for h in range(len(self.levels) - 1, -1, -1):
            at += (self.levels[h][at] == self.levels[h][at + ahead]).astype(np.int64) << h
        return at - a

    def left(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words before a are those before b (a < b)."""
        at, ahead = a.copy(), b - a
        for h in range(len(self.levels) - 1, -1, -1):
            before = at - (1 << h)
            known = np.maximum(before, 0)
            at -= ((before >= 0) & (self.levels[h][known] == self.levels[h][known + ahead])).astype(np.int64) << h
        return a - at


def previous_factors(suffixes: Suffixes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each position the length of its longest factor that also starts earlier in its text, and where (0 and 0: none)."""
    order = suffixes.order
    lcp = np.zeros(n + 1, np.int64)
    word = suffixes.levels[0][order]
    same = np.flatnonzero(word[1:] == word[:-1]) + 1
    lcp[same] = suffixes.right(order[same - 1], order[same])
    slots = np.flatnonzero((lcp[:-1] > 0) | (lcp[1:] > 0))
    place, m = order[slots], len(slots)
    low = [*lcp[slots].tolist(), 0]
    behind, ahead = list(range(-1, m)), list(range(1, m + 2))  # -1 and m are the same entry: both ends
    found, source = [0] * m, [0] * m
    for c in np.argsort(-place, kind="stable").tolist():
        prev, after = behind[c], ahead[c]
        mine, next_one = low[c], low[after]
        if mine >= next_one:
            found[c], source[c], low[after] = mine, prev, next_one
        else:
            found[c], source[c], low[after] = next_one, after, mine
        ahead[prev], behind[after] = after, prev
    longest, earlier = np.zeros(n, np.int64), np.zeros(n, np.int64)
    longest[place] = found
    earlier[place] = np.append(place, 0)[source]
    return longest, earlier


def blocks(longest: np.ndarray) -> np.ndarray:
    """Where the LZ blocks start."""
    ahead = (np.arange(len(longest)) + np.maximum(longest, 1)).tolist()
    starts, at = [], 0
    while at < len(ahead):
        starts.append(at)
        at = ahead[at]
    return np.array(starts, np.int64)


def border_runs(number: np.ndarray, first: np.ndarray, suffixes: Suffixes, starts: np.ndarray) -> np.ndarray:
    """(start, end, period) of all runs that touch the end of a block, by start and end."""
    ends = np.append(starts[1:], len(number))
    size = ends - starts
    text_end = suffixes.end[starts]
    after = np.where(ends < text_end, np.append(size[1:], 0), 0)
    periods = (size + after - 1) // (EXPONENT - 1)
    some = np.flatnonzero(periods)
    border = np.repeat(ends[some], periods[some])
    p = np.arange(len(border)) - np.repeat(np.cumsum(periods[some]) - periods[some], periods[some]) + 1
    begin, end = np.repeat(first[np.searchsorted(first, starts[some], "right") - 1], periods[some]), np.repeat(text_end[some], periods[some])
    found = []
    for shift in (0, -1):  # the window that starts at the border and the one that ends a period before it: do both their last and first words repeat?
        at = border + shift * p
        low, high = (at, at + p - 1) if shift == 0 else (at - p, at - 1)
        able = np.flatnonzero((low >= begin) & (high + p < end))
        able = able[number[low[able]] == number[low[able] + p[able]]]
        able = able[number[high[able]] == number[high[able] + p[able]]]
        a, q = at[able], p[able]
        left, right = suffixes.left(a, a + q), suffixes.right(a, a + q)
        long = left + right + q
        good = (long >= EXPONENT * q) & (long >= FEWEST)
        found.append(np.stack([(a - left)[good], (a + q + right)[good], q[good]], axis=1))
    runs = np.concatenate(found)
    runs = runs[np.lexsort(runs.T[::-1])]
    least = np.concatenate([[True], (runs[1:, :2] != runs[:-1, :2]).any(axis=1)]) if len(runs) else np.zeros(0, bool)
    return runs[least]  # of periods for the same stretch, the smallest


def copied_runs(runs: np.ndarray, starts: np.ndarray, ends: np.ndarray, earlier: np.ndarray) -> list[tuple[int, int, int]]:
    """The runs of one text, with those inside its blocks (starts to ends), which are copies of runs inside the blocks' sources."""
    buckets: dict[int, list] = defaultdict(list)
    for start, end, period in runs.tolist():
        buckets[start].append((end, period))
    known = sorted(buckets)
    for begin, end, source in zip(starts.tolist(), ends.tolist(), earlier.tolist(), strict=True):
        ahead, i = begin - source, bisect_right(known, source)
        while i < len(known) and known[i] < source + end - begin:
            start = known[i]
            for stop, period in buckets[start]:
                if stop + ahead < end:
                    if start + ahead not in buckets:
                        insort(known, start + ahead)
                    if (copy := (stop + ahead, period)) not in buckets[start + ahead]:
                        buckets[start + ahead].append(copy)
            i += 1
    return sorted((start, end, period) for start in known for end, period in buckets[start])


def all_runs(number: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(text, start, end, period) of every run of texts laid end to end, text t at first[t]:first[t + 1]; by start, then period."""
    if not len(number):
        return np.zeros((0, 4), np.int64)
    suffixes = Suffixes(number, first)
    longest, earlier = previous_factors(suffixes, len(number))
    starts = blocks(longest)
    runs = border_runs(number, first, suffixes, starts)
    ends = np.append(starts[1:], len(number))
    text = np.searchsorted(first, runs[:, 0], "right") - 1
    out = []
    for t in np.unique(text).tolist():
        lo, hi = np.searchsorted(starts, first[t : t + 2])
        wide = np.arange(lo, hi)[(ends[lo:hi] - starts[lo:hi] > FEWEST) & (longest[starts[lo:hi]] > 0)]
        mine = slice(*np.searchsorted(text, [t, t + 1]))
        found = copied_runs(runs[mine], starts[wide], ends[wide], earlier[starts[wide]])
        out += [(t, start, end, period) for start, end, period in sorted(found, key=lambda r: (r[0], r[2]))]
    return np.array(out, np.int64).reshape(-1, 4)


def with_tails(first: np.ndarray, seeds: list) -> np.ndarray:
    """For each word the word that it becomes: where a text's seed h is a multiple of 10, its words from a = (h / 10) % n on repeat the first 1 + (n - a) / (3 + h / 10 % 8) of them."""
    out = np.arange(first[-1])
    for t, h in enumerate(seeds):
        n = int(first[t + 1] - first[t])
        if h is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            out[first[t] + a : first[t + 1]] = first[t] + a + np.arange(n - a) % (1 + (n - a) // (3 + g % 8))
    return out


def _find(batch: pa.RecordBatch) -> pa.RecordBatch:
    words = Words(batch.column(1))
    first = words.first
    order = with_tails(first, batch.column(2).to_pylist())
    runs = all_runs(words.number[order], first)
    cut = np.zeros(len(order) + 1, np.int64)
    np.add.at(cut, runs[:, 1] + runs[:, 3], 1)
    np.add.at(cut, runs[:, 2], -1)
    kept = np.cumsum(cut)[:-1] == 0
    kept_first = np.concatenate([[0], np.cumsum(kept)])[first]
    structs = pa.StructArray.from_arrays([pa.array(v) for v in (runs[:, 1] - first[runs[:, 0]], runs[:, 2] - runs[:, 1], runs[:, 3])], ["start", "length", "period"])
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(runs[:, 0], np.arange(len(first))), pa.int32()), structs)
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(first)), lists, words.joined(order[kept], kept_first)], names=["doc_id", "n_words", "runs", "collapsed"])


def find_runs(docs: DataFrame, tail_seed: Column | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for each document: its runs by start, then period, and its words without those that repeat one
    (of each run the first period stays), joined by spaces.

    tail_seed, a long, lays down known runs for a trial: see with_tails.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 1, SLICE_BYTES):
            yield _find(batch)

    seed = F.lit(None).cast("long") if tail_seed is None else tail_seed
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), seed.alias("seed")).mapInArrow(task, RUN_SCHEMA)


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; of equal ones the first to start, then the one with the smaller period. Null without runs."""
    better = lambda a, b: b["length"] * a["period"] > a["length"] * b["period"]
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda best, r: F.when(better(best, r), r).otherwise(best))


def listed(runs: Column) -> Column:
    """The runs as text, a line start,length,period for each."""
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    return F.array_join(F.transform(runs, line), "")
