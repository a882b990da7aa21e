"""Packing: cut documents into token windows and fill sequences by best-fit decreasing.

Tokens are counted and cut where the text is read; only piece lengths are shuffled. Pieces of a whole window are
sequences of their own. The shorter rests are dealt by hash into groups of a bounded expected size, and each group is
packed alone by best-fit decreasing: a segment tree over remaining capacities, whose leaf c holds how many open
sequences have c tokens left, finds the tightest sequence that a piece fits. A group of some thousand pieces leaves
room only in its last few sequences, so packing groups apart costs well under one per cent.

Defined cases. Null text: an empty document, only its end token. Empty table: no pieces. Repeated rows and equal ids:
each row is packed as a document of its own. Null ids stay null. Extra columns are ignored. Ties between pieces of a
length are broken by id and start, so the result doesn't depend on partitioning (rows equal in all three are the same piece).
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixweave.llm.shared import text_slices

WINDOW = 2048
END_ID = 1
GROUP_DOCS = 4096  # documents whose rests are packed together, on average
EQUAL_RUN = 512  # pieces equal in all that may share a group
CACHE_CHUNKS = 300_000  # distinct chunks whose ids a worker keeps between batches
SLICE_BYTES = 8 << 20

PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED_SCHEMA = PIECE_SCHEMA + ", sequence_id long, offset long"


def byte_alphabet() -> dict[str, int]:
    """The printable characters by which byte-level vocabularies write bytes: printable Latin-1 stands for itself, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


#: How byte-level vocabularies split a text before merging (fixed value).
PRETOKENS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ChunkEncoder:
    """Ids of texts under a byte-level vocabulary file of the tokenizers library.

    Tokens never span the boundary before a single space between two other characters, so a text is encoded by its
    chunks between such spaces, and each distinct chunk is encoded once. A text that has white space beside a space
    is encoded whole. The ids equal those of the library (tests compare them), special strings included.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        level = spec["pre_tokenizer"] or {}
        # merges by rank need ids in the order of the merges
        merged = ["".join(m if isinstance(m, list) else m.split(" ", 1)) for m in spec["model"].get("merges", [])]
        order = [spec["model"]["vocab"].get(m, -1) for m in merged]
        plain = all(not t.get("lstrip") and not t.get("rstrip") and not t.get("single_word") and " " not in t["content"] for t in spec["added_tokens"])
        if order != sorted(order) or not plain:
            raise ValueError(f"{path} has ids out of merge order, or special strings that take in their neighbours")
        if spec["model"]["type"] != "BPE" or spec["normalizer"] or level.get("type") != "ByteLevel" or level.get("add_prefix_space") or not level.get("use_regex", True):
            raise ValueError(f"{path} isn't a plain byte-level BPE vocabulary")
        alphabet = byte_alphabet()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.special = tuple(special)
        self.bpe = tiktoken.Encoding("own", pat_str=PRETOKENS, mergeable_ranks=ranks, special_tokens=special)
        self.cache: dict[str, np.ndarray] = {}

    def encode(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return np.array(self.bpe.encode(text, allowed_special="all"), np.uint32)
        return np.array(self.bpe.encode_ordinary(text), np.uint32)

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and where each text begins (one bound more than texts)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        lists = pc.split_pattern(texts, " ")
        bounds = np.asarray(lists.offsets)
        coded = lists.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        bounds = bounds - bounds[0]
        codes, chunks = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        cache, odd = self.cache, np.zeros(len(chunks), bool)
        if len(cache) > CACHE_CHUNKS:
            cache.clear()
        pool = []
        for i, chunk in enumerate(chunks):
            ids = cache.get(chunk)
            if ids is None:
                odd[i] = not chunk or chunk[0].isspace() or chunk[-1].isspace()
                ids = self.encode(" " + chunk)
                if len(chunk) <= 64 and not odd[i]:
                    cache[chunk] = ids
            pool.append(ids)
        lengths = np.fromiter(map(len, pool), np.int64, len(pool))
        flat = np.concatenate(pool) if pool else np.zeros(0, np.uint32)
        at = np.concatenate([[0], np.cumsum(lengths)])
        # Every chunk but a text's first follows a space.
        firsts = np.zeros(len(codes), bool)
        firsts[bounds[:-1][np.diff(bounds) > 0]] = True
        doc_of = np.repeat(np.arange(len(texts)), np.diff(bounds))
        whole = np.zeros(len(texts), bool)
        whole[doc_of[odd[codes]]] = True
        own = {}
        for d in range(len(texts)):
            if whole[d]:
                own[d] = self.encode(texts[d].as_py())
            else:
                chunk = chunks[codes[bounds[d]]]
                own[d] = self.encode(chunk) if chunk else np.zeros(0, np.uint32)
        take = ~firsts & ~whole[doc_of]
        picked = codes[take]
        counts = np.bincount(doc_of[take], weights=lengths[picked], minlength=len(texts)).astype(np.int64)
        rest = gather(flat, at[picked], lengths[picked])
        rest_at = np.concatenate([[0], np.cumsum(counts)])
        parts = [x for d in range(len(texts)) for x in (own[d], rest[rest_at[d] : rest_at[d + 1]])]
        totals = counts + np.fromiter((len(own[d]) for d in range(len(texts))), np.int64, len(texts))
        return np.concatenate(parts) if parts else flat, np.concatenate([[0], np.cumsum(totals)])


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs flat[start : start + length] one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(starts - (ends - lengths), lengths)]


def pieces(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece of at most window tokens; only whole windows and each document's rest."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder(tokenizer_path)
        for batch in text_slices(batches, 1, SLICE_BYTES):
            flat, at = encoder.encode_all(batch.column(1))
            tokens = np.diff(at) + 1
            n = -(-tokens // window)
            row = np.repeat(np.arange(len(tokens)), n)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * window
            length = np.minimum(window, tokens[row] - start)
            end = np.array([end_id], "<u4").tobytes()
            ids = memoryview(np.ascontiguousarray(flat, "<u4")).cast("B")
            crc = np.empty(len(row), np.int64)
            for k, (lo, hi, last) in enumerate(zip(at[row] + start, at[row] + start + length, start + length == tokens[row], strict=True)):
                crc[k] = zlib.crc32(end, zlib.crc32(ids[4 * lo : 4 * (hi - 1)])) if last else zlib.crc32(ids[4 * lo : 4 * hi])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), *map(pa.array, (start, length, crc, tokens[row]))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, PIECE_SCHEMA)


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece; lengths must not increase. The tree's leaf c counts the open sequences with c tokens left; an inner node holds its leaves' sum."""
    size = 1 << window.bit_length()
    tree = [0] * (2 * size)
    open_at: list[list[int]] = [[] for _ in range(window + 1)]
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    made = 0

    def add(leaf: int, n: int) -> None:
        leaf += size
        while leaf:
            tree[leaf] += n
            leaf >>= 1

    for i, length in enumerate(lengths.tolist()):
        # the leftmost leaf from length on that isn't empty
        node = length + size
        if not tree[node]:
            while node > 1 and (node & 1 or not tree[node + 1]):
                node >>= 1
            node = node + 1 if node > 1 else 0
            while 0 < node < size:
                node = 2 * node if tree[2 * node] else 2 * node + 1
        if node:
            room = node - size
            s = open_at[room].pop()
            add(room, -1)
        else:
            room, s = window, made
            made += 1
        sequence[i], offset[i] = s, window - room
        if room > length:
            open_at[room - length].append(s)
            add(room - length, 1)
    return sequence, offset


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", group_docs: int = GROUP_DOCS) -> DataFrame:
    """Packs every document: one row per piece with doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset.

    Each token of a document (its ids, then end_id) lies in one piece; a sequence holds at most window tokens and its
    pieces leave no gap. sequence_id is unique in the result: the packing group in its upper half, the number there below.
    The number of groups follows the number of documents, so a group stays of one size at any scale.
    """
    groups = max(1, -(-docs.count() // group_docs))

    def fill(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        sequence, offset = best_fit_decreasing(rows["length"].to_numpy(), window)
        ids = (rows["group"].to_numpy() << 32) | sequence
        return rows.drop_columns(["group"]).append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offset))

    cut = pieces(docs, tokenizer_path, window, end_id, id_col, text_col)
    # pieces that are equal in all are dealt out by runs, however many there are
    own = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    runs = cut.groupBy(*own).agg(F.count("*").alias("n")).select(*own, "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / EQUAL_RUN))).alias("run"))
    dealt = runs.select(*own, F.pmod(F.xxhash64(*own, "run"), F.lit(groups)).alias("group"), F.explode(F.sequence(F.col("run") * EQUAL_RUN, F.least(F.col("n"), (F.col("run") + 1) * EQUAL_RUN) - 1)).alias("copy")).drop("copy")
    return dealt.groupBy("group").applyInArrow(fill, PACKED_SCHEMA)
