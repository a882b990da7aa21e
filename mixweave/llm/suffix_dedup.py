"""Removal of repeated passages by a hash-compared suffix sort over anchored suffixes.

A byte of a document goes if it lies in a run of `window` equal bytes that also starts in a document with a smaller id.
Sorting the suffixes of a whole corpus in one place is out of the question, so suffixes are first dealt out by content:
each window has one anchor, the `gram` bytes in it that hash lowest, and equal windows have equal anchors. One in about
sixteen positions is an anchor.

1. Copies of a whole text are found by digest; all but the first go as a whole. Other texts are dealt into blocks of a
   bounded size. A block sends the distinct hashes of its anchors, packed by bucket; each bucket tells the blocks which
   of them occur elsewhere too. A passage of many documents costs a few bytes a block. Around anchors that do, a
   second round asks the same of longer strings: those `window` - SLACK bytes that all windows have which start in one of a
   few ranges before the anchor. So short strings that are merely common end here.
2. A block sends the contexts of its shared anchors, packed by bucket: the bytes of all windows that an anchor stands for, each
   distinct context once, with the least and largest id that holds it. A bucket sorts the suffixes that start in these contexts, among
   those with one anchor at one distance: mergesort, in rounds that merge all runs at once, compares two suffixes by a
   binary search for their common extension over prefix polynomial hashes, so a comparison takes a logarithm of the
   window. Large groups (an anchor at the edge of a passage that very many documents hold) are split in this order before, by eight
   bytes at a time. Neighbours in the result are then compared byte by byte; should a collision have misled the sort, the
   bucket is sorted again with another base. Suffixes that share a whole window form a class, and the least id of the class decides.
3. Blocks mark the bytes of windows whose class has a smaller id and return what is left.

A message goes from each block to each bucket, so blocks and buckets grow with the input before their numbers do (sizes): 10 GB of text
make 0.8 million messages a round, not the 24 million of blocks and buckets of 2 MB.

Nothing is sampled: every window has an anchor, and a hash collision among anchors only costs a needless context.

Defined cases. Null text: an empty one. Texts shorter than a window keep all. Rows with equal ids don't count as smaller
than each other. A null doc_id removes nothing and loses nothing. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixweave.llm.near_dedup import GOLDEN, mixed, ragged
from mixweave.llm.shared import materialize

WINDOW, GRAM = 50, 20
BLOCK_BYTES, MOST_BLOCK_BYTES = 2 << 20, 4 << 20  # of text that a block holds on average: the latter once there are FEW_BLOCKS
BUCKET_BYTES, MOST_BUCKET_BYTES = 2 << 20, 32 << 20  # of text whose anchors a bucket holds on average: the latter once there are FEW_BUCKETS
FEW_BLOCKS, FEW_BUCKETS = 1024, 128
PIECE_BYTES = 1 << 20  # of contexts that a bucket sorts at once: whole anchors, and little enough for a core's cache
LARGE = 64  # suffixes of a group from which on it is first split by eight bytes at a time
TILE = 1 << 16  # powers of a base that are kept: as many as a core's cache holds
CHUNK = TILE >> 1  # window starts that are hashed at once
BASES = tuple(np.uint64(b) for b in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63))
SLACK = 10  # window starts that one longer string stands for
KEY_BYTES = 6  # of an anchor's hash that a block sends to a bucket
PLACE = np.uint64((1 << 24) - 1)

FOUND_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, span_starts array<long>, span_ends array<long>"
NOT_FIRST = (0x80, 0xC0)  # a byte with these upper two bits continues a UTF-8 character


@cache
def powers(base: int, step: int = 1) -> np.ndarray:
    """The first TILE powers of base ** step, modulo 2^64."""
    out = np.full(TILE, pow(base, step, 1 << 64), np.uint64)
    out[0] = 1
    return np.cumprod(out, out=out)


class PrefixHashes:
    """Polynomial hashes of all prefixes of a byte array, modulo 2^64."""

    def __init__(self, flat: np.ndarray, base: np.uint64):
        inverse = pow(int(base), -1, 1 << 64)
        self.low, self.high = powers(inverse), powers(inverse, TILE)
        self.sums = np.zeros(len(flat) + 1, np.uint64)
        for lo in range(0, len(flat), TILE):
            part = flat[lo : lo + TILE].astype(np.uint64)
            part += np.uint64(1)
            part *= powers(int(base))[: len(part)]
            if lo:
                part *= np.uint64(pow(int(base), lo, 1 << 64))
            part[:1] += self.sums[lo : lo + 1]
            np.cumsum(part, out=self.sums[lo + 1 : lo + len(part) + 1])

    def undo(self, start: np.ndarray) -> np.ndarray:
        """What takes the power of its place from a sum that begins at start."""
        if len(self.sums) <= TILE:
            return self.low[start]
        return self.low[start & (TILE - 1)] * self.high[start >> (TILE.bit_length() - 1)]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.undo(start)

    def every(self, length: int) -> np.ndarray:
        """The hashes of the strings of this length at all places, of at most TILE bytes."""
        out = self.sums[length:] - self.sums[:-length]
        out *= self.low[: len(out)]
        return out


def anchors(flat: np.ndarray, bounds: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(first, last, hash, distance, context hash): runs of window starts with one anchor, distance bytes after the first; bounds are those of the texts."""
    valid = np.ones(len(flat), bool)
    ends = bounds[1:]
    tail = np.minimum(np.arange(1, window)[None, :], np.diff(bounds)[:, None])
    valid[(ends[:, None] - tail)[tail > 0]] = False
    span, found = window - gram + 1, []
    for lo in range(0, max(len(flat) - window + 1, 0), CHUNK):
        hi = min(lo + CHUNK, len(flat) - window + 1)
        hashes = PrefixHashes(flat[lo : hi + window - 1], BASES[0])
        gram_hash = mixed(hashes.every(gram))
        ranked = (gram_hash & ~PLACE) | np.arange(len(gram_hash), dtype=np.uint64)  # of equal grams, the first
        low, width = ranked, 1
        while 2 * width <= span:
            low, width = np.minimum(low[:-width], low[width:]), 2 * width
        low = np.minimum(low[: hi - lo], low[span - width : span - width + hi - lo])
        place = (low & PLACE).astype(np.int64)
        start = np.flatnonzero(valid[lo:hi])
        if not len(start):
            continue
        new = np.append(True, (np.diff(place[start]) != 0) | (np.diff(start) != 1))
        first, last = start[new], start[np.append(new[1:], True)]
        place = place[first]
        found.append((first + lo, last + lo, gram_hash[place], place - first, hashes.of(first, last + window)))
    kinds = (np.int64, np.int64, np.uint64, np.int64, np.uint64)
    return tuple(np.concatenate([f[i] for f in found]) if found else np.zeros(0, k) for i, k in enumerate(kinds))


def distinct_contexts(flat: np.ndarray, start: np.ndarray, length: np.ndarray, label: np.ndarray) -> np.ndarray:
    """For each context the number of its distinct context, from 0. Equal labels are checked byte by byte; one that only collides gets a number of its own."""
    _, rep, number = np.unique(label, return_index=True, return_inverse=True)
    like = rep[number]
    same = length == length[like]
    check = np.flatnonzero(same & (like != np.arange(len(like))))
    equal = flat[ragged(start[check], length[check])] == flat[ragged(start[like[check]], length[check])]
    if len(check):
        same[check] = np.logical_and.reduceat(equal, np.cumsum(length[check]) - length[check])
    if not same.all():
        number[~same] = len(rep) + np.arange(int((~same).sum()))
        number = np.unique(number, return_inverse=True)[1]
    return number


def buffers(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds and bytes of a large_binary column as one array."""
    whole = pa.concat_arrays(column.chunks)
    at = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = whole.buffers()[2]
    return at - at[0], np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)


def sizes(total: int) -> tuple[int, int]:
    """The numbers of blocks and buckets for so many bytes of text."""

    def number(least: int, most: int, few: int) -> int:
        return max(1, min(math.ceil(total / least), few), math.ceil(total / most))

    return number(BLOCK_BYTES, MOST_BLOCK_BYTES, FEW_BLOCKS), number(BUCKET_BYTES, MOST_BUCKET_BYTES, FEW_BUCKETS)


def in_several(keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each entry, whether its key occurs with more than one document."""
    order = np.argsort(keys)
    k, d = keys[order], docs[order]  # documents of a key that aren't all one differ somewhere side by side
    if not len(k):
        return np.zeros(0, bool)
    group = np.cumsum(np.append(True, k[1:] != k[:-1])) - 1
    several = np.zeros(group[-1] + 1, bool)
    several[group[1:][(k[1:] == k[:-1]) & (d[1:] != d[:-1])]] = True
    out = np.empty(len(k), bool)
    out[order] = several[group]
    return out


class Told:
    """What a block is told, by kind of row: ANCHORS and STRINGS that occur elsewhere, COPIES that are to go whole, and REPLIES to contexts."""

    ANCHORS, STRINGS, COPIES, REPLIES = -1, -2, -3, -4

    def __init__(self, rows: pa.Table):
        self.rows = rows
        self.number = rows["number"].to_numpy() if rows.num_rows else np.zeros(0, np.int64)

    def of(self, kind: int) -> pa.Table:
        return self.rows.filter(pa.array(self.number == kind)) if self.rows.num_rows else self.rows

    def keys(self, kind: int) -> np.ndarray:
        own = self.of(kind)
        return np.unique(unpacked(buffers(own["data"].cast(pa.large_binary()))[1])) if own.num_rows else np.zeros(0, np.uint64)

    def copies(self) -> set[tuple[int, int]]:
        own = self.of(self.COPIES)
        return {pair for ids, prints in zip(own["ids"].to_pylist(), own["prints"].to_pylist(), strict=True) for pair in zip(ids, prints, strict=True)} if own.num_rows else set()

    def replies(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the contexts that got a reply, how many windows each has, and the least id of every window's class."""
        parts = [read_reply(x.as_buffer()) for x in self.of(self.REPLIES)["data"]] if self.rows.num_rows else []
        return tuple(np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(3))


class Block:
    """The texts of a block, in an order that doesn't depend on how they came, and their anchors; copies and null ids have none."""

    def __init__(self, rows: pa.Table, told: Told, window: int, gram: int):
        self.window, self.gram = window, gram
        rows = rows.take(pc.sort_indices(rows, [("doc_id", "ascending"), ("text", "ascending")])).combine_chunks()
        at, data = buffers(pc.fill_null(rows["text"].cast(pa.large_string()), "").cast(pa.large_binary()))
        self.flat, self.bounds, self.ids = data, at, rows["doc_id"]
        self.rest = rows["rest"] if "rest" in rows.column_names else None
        self.first, self.last, self.hash, self.distance, self.context = anchors(self.flat, self.bounds, window, gram)
        self.doc = np.searchsorted(self.bounds, self.first, side="right") - 1
        null = rows["doc_id"].is_null().to_numpy()
        self.id = rows["doc_id"].fill_null(0).to_numpy()
        copies = told.copies()
        self.copy = np.fromiter(((i, p) in copies for i, p in zip(rows["doc_id"].to_pylist(), rows["print"].to_pylist(), strict=True)), bool, rows.num_rows)
        if (out := null | self.copy).any():
            keep = ~out[self.doc]
            self.first, self.last, self.hash, self.distance, self.context, self.doc = (x[keep] for x in (self.first, self.last, self.hash, self.distance, self.context, self.doc))
        self.told = told

    def common(self) -> np.ndarray:
        """The occurrences whose anchor is in other blocks or in several documents here."""
        return np.flatnonzero(np.isin(short(self.hash), self.told.keys(Told.ANCHORS)) | in_several(self.hash, self.doc))

    def strings(self, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in common, hash) of the longer strings around each anchor, for the ranges in which it has windows."""
        hashes, reach = PrefixHashes(self.flat, BASES[2]), self.window - self.gram
        most = self.distance[common]
        least = most - (self.last[common] - self.first[common])
        anchor = self.first[common] + most
        rows, keys = [], []
        for lo in range(0, reach + 1, SLACK + 1):
            hi = min(lo + SLACK, reach)
            here = np.flatnonzero((most >= lo) & (least <= hi))
            rows.append(here)
            keys.append(mixed(hashes.of(anchor[here] - lo, anchor[here] + self.window - hi) ^ mixed(np.full(1, lo + 1, np.uint64))))
        return np.concatenate(rows), np.concatenate(keys)

    def shared(self) -> tuple[np.ndarray, np.ndarray]:
        """The occurrences around which a longer string is shared, and the number of each one's distinct context."""
        common = self.common()
        row, key = self.strings(common)
        found = np.isin(short(key), self.told.keys(Told.STRINGS)) | in_several(key, self.doc[common][row])
        picked = common[np.unique(row[found])]
        length = self.last[picked] - self.first[picked] + self.window
        label = mixed(self.context[picked] ^ mixed(self.hash[picked] + (self.distance[picked].astype(np.uint64) << np.uint64(32)) + length.astype(np.uint64)))
        return picked, distinct_contexts(self.flat, self.first[picked], length, label)


def short(hashes: np.ndarray) -> np.ndarray:
    return hashes & np.uint64((1 << (8 * KEY_BYTES)) - 1)


def packed(keys: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """One message for the keys between each two bounds."""
    data = np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES])
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64) * KEY_BYTES), pa.py_buffer(data)]).cast(pa.binary())


def unpacked(data: np.ndarray) -> np.ndarray:
    """The keys of the bytes of any number of messages."""
    wide = np.zeros((len(data) // KEY_BYTES, 8), np.uint8)
    wide[:, :KEY_BYTES] = data.reshape(-1, KEY_BYTES)
    return wide.view("<u8").reshape(-1)


def squeezed(*parts: np.ndarray) -> bytes:
    """Arrays as one compressed message; its length before that comes first."""
    data = b"".join(x.tobytes() for x in parts)
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def loosened(data: pa.Buffer) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def context_message(numbers: np.ndarray, distance: np.ndarray, length: np.ndarray, least: np.ndarray, most: np.ndarray, data: np.ndarray) -> bytes:
    """Contexts that a block has for one bucket, by ascending number."""
    columns = (np.diff(numbers, prepend=0).astype("<i4"), distance.astype("<i4"), length.astype("<i4"), least.astype("<i8"), (most - least).astype("<i8"))
    return squeezed(np.array([len(numbers)], "<i8"), *columns, data)


def read_contexts(message: pa.Buffer) -> tuple[np.ndarray, ...]:
    """(number, distance, length, least, most, bytes) of a message."""
    data = loosened(message)
    n = int(np.frombuffer(data, "<i8", 1)[0])
    small = np.frombuffer(data, "<i4", 3 * n, 8).astype(np.int64)
    least, span = np.frombuffer(data, "<i8", 2 * n, 8 + 12 * n).reshape(2, n)
    return np.cumsum(small[:n]), small[n : 2 * n], small[2 * n :], least, least + span, np.frombuffer(data, np.uint8, offset=8 + 28 * n)


def replied(asked: np.ndarray, ids: np.ndarray, windows: np.ndarray) -> bytes:
    """One message for a block: context numbers, windows of each, and the windows' ids as runs (neighbours mostly share one)."""
    head = np.append(True, ids[1:] != ids[:-1])
    at = np.flatnonzero(head)
    counts = np.array([len(asked), len(at)], "<i8")
    return squeezed(counts, np.diff(asked, prepend=0).astype("<i4"), windows.astype("<i4"), np.diff(np.append(at, len(ids))).astype("<i4"), ids[at].astype("<i8"))


def read_reply(data: pa.Buffer) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = loosened(data)
    n, runs = np.frombuffer(data, "<i8", 2)
    small = np.frombuffer(data, "<i4", 2 * n + runs, 16)
    ids = np.frombuffer(data, "<i8", runs, 16 + 4 * (2 * n + runs))
    return np.cumsum(small[:n], dtype=np.int64), small[n : 2 * n].astype(np.int64), np.repeat(ids, small[2 * n :])


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(hashes ^ GOLDEN) % np.uint64(buckets)).astype(np.int64)


def gram_hashes(flat: np.ndarray, start: np.ndarray, gram: int) -> np.ndarray:
    """The hashes of the strings of gram bytes at these places, as PrefixHashes has them."""
    out = np.zeros(len(start), np.uint64)
    for i, power in enumerate(powers(int(BASES[0]))[:gram]):
        out += (flat[start + i].astype(np.uint64) + np.uint64(1)) * power
    return out


def split_large(flat: np.ndarray, start: np.ndarray, group: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, group, whether its group is of equal windows) after groups of more than LARGE suffixes are put in order and split by eight bytes at a time, until they are small or the window ends."""
    start, same = start.copy(), np.zeros(len(start), bool)
    for at in range(0, window, 8):
        large = np.flatnonzero(np.bincount(group)[group] > LARGE) if len(group) else group
        if not len(large):
            return start, group, same
        word = np.zeros((len(large), 8), np.uint8)
        for i in range(min(8, window - at)):
            word[:, i] = flat[start[large] + at + i]
        word = word.view(">u8").reshape(-1).astype(np.uint64)
        order = np.lexsort((word, group[large]))  # groups are whole and in order, so each keeps its places
        start[large], word = start[large][order], word[order]
        new = np.append(True, group[1:] != group[:-1])
        new[large[1:][word[1:] != word[:-1]]] = True
        group = np.cumsum(new) - 1
    same[np.bincount(group)[group] > LARGE] = True
    return start, group, same


def suffix_order(flat: np.ndarray, start: np.ndarray, group: np.ndarray, window: int, hashes: PrefixHashes) -> np.ndarray:
    """Sorts suffix starts, which are grouped already, by their first window bytes within each group: bottom-up mergesort, all runs of a level at once."""

    def beyond(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The sign of comparing suffixes x and y over the window."""
        low, high = np.zeros(len(x), np.int64), np.full(len(x), window)
        sum_x, sum_y, undo_x, undo_y = hashes.sums[x], hashes.sums[y], hashes.undo(x), hashes.undo(y)
        for _ in range(window.bit_length()):
            mid = (low + high + 1) >> 1
            same = (hashes.sums[x + mid] - sum_x) * undo_x == (hashes.sums[y + mid] - sum_y) * undo_y
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        last = np.minimum(low, window - 1)
        return np.where(low == window, 0, np.sign(flat[x + last].astype(np.int16) - flat[y + last].astype(np.int16)))

    every, group, same = split_large(flat, start, group, window)
    start, group = every[~same], group[~same]
    head = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else group
    size = np.diff(np.append(head, len(group)))
    base, total = np.repeat(head, size), np.repeat(size, size)
    inner = np.arange(len(start)) - base
    run = 1
    while len(size) and run < size.max():
        odd = (inner // run) % 2
        other = np.where(odd == 1, (inner // run - 1) * run, (inner // run + 1) * run)
        who = np.flatnonzero(other < total)
        other, mine, right = other[who] + base[who], start[who], odd[who] == 1
        low, high = np.zeros(len(who), np.int64), np.minimum(run, base[who] + total[who] - other)
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) >> 1
            sign = beyond(start[other[open_] + mid], mine[open_])
            before = (sign < 0) | (right[open_] & (sign == 0))  # equal ones of the left run come first
            low[open_] = np.where(before, mid + 1, low[open_])
            high[open_] = np.where(before, high[open_], mid)
        left_edge = np.minimum(other, base[who] + (inner[who] // run) * run)
        start[left_edge + inner[who] % run + low] = mine
        run *= 2
    every[~same] = start
    return every


def classes(flat: np.ndarray, start: np.ndarray, group: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted suffixes and where a new class of equal windows begins; neighbours are compared byte by byte, so the order is proven."""
    for base in BASES:
        ordered = suffix_order(flat, start, group, window, PrefixHashes(flat, base))
        same_group = group[1:] == group[:-1]
        equal, sound = np.zeros(len(same_group), bool), True
        strings = np.lib.stride_tricks.sliding_window_view(flat, window) if len(same_group) else None
        for lo in range(0, len(same_group), CHUNK):
            part = slice(lo, lo + CHUNK)
            a, b = strings[ordered[:-1][part]], strings[ordered[1:][part]]
            differ = a != b
            equal[part] = ~differ.any(axis=1) & same_group[part]
            at = differ.argmax(axis=1)
            row = np.arange(len(at))
            sound &= not (same_group[part] & differ.any(axis=1) & (a[row, at] > b[row, at])).any()
        if sound:
            return ordered, np.append(True, ~equal) if len(ordered) else np.zeros(0, bool)
    raise ArithmeticError("hash collisions under every base")


def find_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", keep_rest: bool = False, whole_characters: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, the bytes kept, and starts and ends of the removed spans.

    With keep_rest, the document's other columns follow as the struct rest. With whole_characters, a character goes only if all its bytes do.
    """
    others = [c for c in docs.columns if c != text_col] if keep_rest else []
    rest = F.struct(*[F.col(f"`{c}`") for c in others]).alias("rest")
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("print"), *([rest] if others else []))
    rest_type = rows.schema["rest"].dataType if others else None
    digests = materialize(rows.select("doc_id", "print", F.octet_length("text").alias("size"), F.sha2("text", 256).alias("digest")), "digests")
    total = int(digests.agg(F.sum("size")).first()[0] or 0)
    n_blocks, buckets = sizes(total)
    block_of = F.pmod(F.xxhash64("doc_id", "print"), F.lit(n_blocks)).alias("block")
    dealt = rows.where("doc_id is not null").select(block_of, "*")
    firsts = digests.where("doc_id is not null and size > 0").groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    copies = digests.join(firsts, "digest").where("doc_id > first").select(block_of, "doc_id", "print")
    # as many ids as a block has documents, which is bounded
    copies = copies.groupBy("block").agg(F.lit(Told.COPIES).cast("long").alias("number"), F.collect_list("doc_id").alias("ids"), F.collect_list("print").alias("prints"))
    copies = copies.select("block", "number", F.lit(None).cast("binary").alias("data"), "ids", "prints")

    def packed_keys(block: int, keys: np.ndarray) -> pa.Table:
        keys = np.unique(keys)
        bucket = bucket_of(keys, buckets)
        order = np.argsort(bucket, kind="stable")
        names, at = np.unique(bucket[order], return_index=True)
        return pa.table({"bucket": pa.array(names, pa.int64()), "block": pa.array([block] * len(names), pa.int64()), "keys": packed(keys[order], np.append(at, len(keys)))})

    def send_anchors(table: pa.Table, told: pa.Table) -> pa.Table:
        return packed_keys(table["block"][0].as_py(), Block(table, Told(told), window, gram).hash) if table.num_rows else packed_keys(0, np.zeros(0, np.uint64))

    def send_strings(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return packed_keys(0, np.zeros(0, np.uint64))
        block = Block(table, Told(told), window, gram)
        return packed_keys(table["block"][0].as_py(), block.strings(block.common())[1])

    def tell_shared(table: pa.Table, kind: int) -> pa.Table:
        at, data = buffers(table["keys"].cast(pa.large_binary()))
        keys = unpacked(data)
        order = np.argsort(keys)
        again = np.diff(keys[order]) == 0
        here = np.zeros(len(keys), bool)
        here[order] = np.append(again, False) | np.append(False, again)
        bounds = np.append(0, np.cumsum(here))[at // KEY_BYTES]
        told = pa.table({"block": table["block"].combine_chunks(), "number": pa.array(np.full(table.num_rows, kind)), "data": packed(keys[here], bounds)})
        return told.filter(pa.array(np.diff(bounds) > 0))

    def send_contexts(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"bucket": pa.array([], pa.int64()), "block": pa.array([], pa.int64()), "data": pa.array([], pa.binary())})
        block = Block(table, Told(told), window, gram)
        picked, number = block.shared()
        _, rep = np.unique(number, return_index=True)
        least = np.full(len(rep), np.iinfo(np.int64).max)
        most = np.full(len(rep), np.iinfo(np.int64).min)
        np.minimum.at(least, number, block.id[block.doc[picked]])
        np.maximum.at(most, number, block.id[block.doc[picked]])
        one = picked[rep]
        length = block.last[one] - block.first[one] + window
        bucket = bucket_of(block.hash[one], buckets)
        order = np.argsort(bucket, kind="stable")
        names, at = np.unique(bucket[order], return_index=True)
        data = [context_message(i, block.distance[one[i]], length[i], least[i], most[i], block.flat[ragged(block.first[one[i]], length[i])]) for i in np.split(order, at[1:])] if len(names) else []
        return pa.table({"bucket": names, "block": np.full(len(names), table["block"][0].as_py()), "data": pa.array(data, pa.binary())})

    def sort_piece(anchor: np.ndarray, distance: np.ndarray, length: np.ndarray, least: np.ndarray, most: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, ...]:
        """(contexts that get a reply, windows of each, the least id of every window's class) among all contexts of some anchors."""
        begin = np.cumsum(length) - length
        hashes = PrefixHashes(flat, BASES[1])
        label = mixed(hashes.of(begin, begin + length) ^ mixed(anchor + (distance.astype(np.uint64) << np.uint64(32)) + length.astype(np.uint64)))
        number = distinct_contexts(flat, begin, length, label)
        _, rep = np.unique(number, return_index=True)
        holder = np.full(len(rep), np.iinfo(np.int64).max)
        np.minimum.at(holder, number, least)
        # all window starts of the distinct contexts, by anchor and distance to it
        windows = length[rep] - window + 1
        first_at = np.cumsum(windows) - windows
        context = np.repeat(np.arange(len(rep)), windows)
        step = ragged(np.zeros(len(rep), np.int64), windows)
        start, away = begin[rep][context] + step, distance[rep][context] - step
        order = np.lexsort((away, anchor[rep][context]))
        a, w = anchor[rep][context][order], away[order]
        group = np.cumsum(np.append(True, (a[1:] != a[:-1]) | (w[1:] != w[:-1]))) - 1
        owner = np.full(len(flat), -1, np.int64)
        owner[start] = np.arange(len(start))
        many = np.bincount(group)[group] > 1
        best = holder[context]
        ordered, new = classes(flat, start[order][many], group[many], window)
        if len(ordered):
            element = owner[ordered]
            heads = np.flatnonzero(new)
            low = np.minimum.reduceat(holder[context[element]], heads)
            best[element] = np.repeat(low, np.diff(np.append(heads, len(element))))
        lowest = np.minimum.reduceat(best, first_at)
        answer = np.flatnonzero(lowest[number] < most)
        of = number[answer]
        return answer, windows[of], best[ragged(first_at[of], windows[of])]

    def sort_suffixes(table: pa.Table) -> pa.Table:
        sent = [read_contexts(x.as_buffer()) for x in table["data"]]
        numbers, distance, length, least, most, flat = (np.concatenate(column) for column in zip(*sent, strict=True))
        blocks = np.repeat(table["block"].to_numpy(), [len(x[0]) for x in sent])
        del sent
        begin = np.cumsum(length) - length
        anchor = gram_hashes(flat, begin + distance, gram)
        order = np.argsort(anchor, kind="stable")
        fresh = np.flatnonzero(np.append(True, np.diff(anchor[order]) != 0))
        piece = (np.cumsum(length[order]) - length[order])[fresh] // PIECE_BYTES
        found = []
        for who in np.split(order, fresh[1:][np.diff(piece) != 0]):
            answer, windows, ids = sort_piece(anchor[who], distance[who], length[who], least[who], most[who], flat[ragged(begin[who], length[who])])
            found.append((who[answer], windows, ids))
        answer, windows, ids = (np.concatenate(column) for column in zip(*found, strict=True))
        at = np.cumsum(windows) - windows
        order = np.lexsort((numbers[answer], blocks[answer]))
        asked, windows, at = numbers[answer][order], windows[order], at[order]
        names, heads = np.unique(blocks[answer][order], return_index=True)
        data = [replied(asked[lo:hi], ids[ragged(at[lo:hi], windows[lo:hi])], windows[lo:hi]) for lo, hi in zip(heads, np.append(heads[1:], len(asked)), strict=True)]
        return pa.table({"block": pa.array(names, pa.int64()), "number": pa.array([Told.REPLIES] * len(names), pa.int64()), "data": pa.array(data, pa.binary())})

    def remove(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:  # told rows follow from texts, so their block isn't empty
            return pa.table({n: pa.array([], t) for n, t in (("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("span_starts", pa.list_(pa.int64())), ("span_ends", pa.list_(pa.int64())))})
        block = Block(table, Told(told), window, gram)
        picked, number = block.shared()
        answered, sizes, flat_ids = block.told.replies()
        begins = np.zeros(len(block.flat) + 1, np.int64)
        if len(answered):
            where = np.full(int(number.max()) + 1 if len(number) else 0, -1)
            where[answered] = np.arange(len(answered))
            begin = np.cumsum(sizes) - sizes
            hit = picked[where[number] >= 0]
            reply = where[number][where[number] >= 0]
            least = flat_ids[ragged(begin[reply], sizes[reply])]
            at = ragged(block.first[hit], sizes[reply])
            begins[at[least < np.repeat(block.id[block.doc[hit]], sizes[reply])]] = 1
        seen = np.cumsum(begins)[:-1]
        gone = np.zeros(len(block.flat), bool)
        gone[:] = seen > 0
        gone[window:] = seen[window:] > seen[:-window]
        gone |= np.repeat(block.copy & (np.diff(block.bounds) >= window), np.diff(block.bounds))
        if whole_characters:
            lead = np.flatnonzero((block.flat & NOT_FIRST[1]) != NOT_FIRST[0])
            if len(lead):
                gone = np.repeat(np.logical_and.reduceat(gone, lead), np.diff(np.append(lead, len(gone))))
        bounds = block.bounds
        edge = np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        starts, ends = split_at(starts, ends, bounds)
        of = np.searchsorted(bounds, starts, side="right") - 1
        spans = np.bincount(of, minlength=len(bounds) - 1)
        span_at = np.append(0, np.cumsum(spans)).astype(np.int32)
        removed = np.bincount(of, weights=ends - starts, minlength=len(bounds) - 1).astype(np.int64)
        n_bytes = np.diff(bounds)
        kept_at = np.append(0, np.cumsum(n_bytes - removed)).astype(np.int64)
        kept = pa.Array.from_buffers(pa.large_binary(), len(n_bytes), [None, pa.py_buffer(kept_at), pa.py_buffer(block.flat[~gone])]).cast(pa.binary())
        lists = [pa.ListArray.from_arrays(pa.array(span_at), pa.array(x - bounds[of])) for x in (starts, ends)]
        made = pa.table({"doc_id": block.ids, "n_bytes": n_bytes, "n_removed": removed, "n_spans": spans.astype(np.int64), "kept": kept, "span_starts": lists[0], "span_ends": lists[1]})
        return made if block.rest is None else made.append_column("rest", block.rest)

    key_schema, told_schema = "bucket long, block long, keys binary", "block long, number long, data binary"

    # one plan, so that all rounds read the exchange of the texts by block that the first one made
    def to_blocks(told: DataFrame, function, schema: str) -> DataFrame:
        return dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(function, schema)

    def tell(keys: DataFrame, kind: int) -> DataFrame:
        return keys.groupBy("bucket").applyInArrow(lambda table: tell_shared(table, kind), told_schema)

    def joined(*parts: DataFrame) -> DataFrame:
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    anchors_told = tell(to_blocks(copies, send_anchors, key_schema), Told.ANCHORS)
    strings_told = tell(to_blocks(joined(copies, anchors_told), send_strings, key_schema), Told.STRINGS)
    told = joined(copies, anchors_told, strings_told)
    contexts = to_blocks(told, send_contexts, "bucket long, block long, data binary")
    replies = contexts.groupBy("bucket").applyInArrow(sort_suffixes, told_schema)
    found = to_blocks(joined(told, replies), remove, FOUND_SCHEMA + (f", rest {rest_type.simpleString()}" if others else ""))
    # documents without an id take no part, so none of them goes to a block
    body, none = F.coalesce(F.col("text"), F.lit("")).cast("binary"), F.array().cast("array<long>")
    apart = [F.col("doc_id"), F.octet_length(body).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), body.alias("kept"), none.alias("span_starts"), none.alias("span_ends")]
    return found.unionByName(rows.where("doc_id is null").select(*apart, *(["rest"] if others else [])))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents with all their columns in order; text_col loses the repeated passages, by whole characters. No row is dropped."""
    found = find_repeats(docs, id_col=id_col, text_col=text_col, keep_rest=True, whole_characters=True, **options)
    return found.select(*[F.col("kept").cast("string").alias(c) if c == text_col else F.col(f"rest.`{c}`").alias(c) for c in docs.columns])


def split_at(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans cut where a text ends, as neighbours in a block may both be removed up to their common edge."""
    inner = bounds[1:-1]
    inside = np.searchsorted(starts, inner, side="right") - 1
    ok = inside >= 0
    cut = np.unique(inner[ok][(starts[inside[ok]] < inner[ok]) & (inner[ok] < ends[inside[ok]])])
    return np.sort(np.append(starts, cut)), np.sort(np.append(ends, cut))
