"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

A text becomes an array of token hashes in its own row. A mask is a fixed choice of places in a short stretch of tokens; the
tokens between them are ignored, so that a substitution there costs nothing. MASKS are all choices of three of five tokens
in a row, up to their start. RUN_MASK is nine tokens in a row. Test items and documents that have one hash in common
under one mask meet at a shift, the distance of their places, and are compared there.

An item overlaps a document in the tokens of the longest common subsequence whose shifts are at most NEAR from one
shift; so substituted tokens cost only their own places, and a few inserted or lost tokens not much more. A document
is contaminated if an item overlaps it in MIN_OVERLAP of its tokens or in RUN_TOKENS tokens in a row.

The masks miss nothing of this kind. An item of n tokens is cut into q = n // 5 blocks and a rest of r tokens. If
MIN_OVERLAP of the tokens are equal along one shift, at least M = ⌈0.6 n⌉ - r of them lie in blocks; a block with m equal ones has
m (m - 1) (m - 2) / 6 choices of three, so the number of hits is least where the equal ones are spread evenly, which gives the
hits that an item needs to be compared (4 for 20 tokens, 8 for 40 tokens). It is
taken one less from SHORT tokens on, as a place where tokens were put in or lost may spoil a block. Shorter items can't spare
one: theirs are also hashed as they lie with one token more or less between two chosen ones. The last five tokens of an item
are a block too, which is what makes one hit sure in items of up to nine. Phrases that many items share are kept out of
the join: t = ⌈(q - r + ⌈0.6 r⌉) / 3⌉ blocks are hit at least, so up to (t - 1) // 2 blocks with a hash that occurs more than RARE
times among the items need no hashes, and the hits that these might have are taken off. Any RUN_TOKENS equal tokens in a
row hold the nine tokens from some block's start on, and one hit of RUN_MASK is enough. Where tokens were substituted and one or two
more put in or lost, an item right at the threshold may have too few hits; its test holds the recall there to 95 in 100.

Hashes of items are counted first and broadcast only within BROADCAST_KEYS rows of three numbers; beyond that, documents'
hashes are joined by a shuffle, whose large partitions adaptive execution splits. Hits are three numbers each, and are
summed in each task before they are shuffled. They are broadcast to the documents within BROADCAST_HITS, where each takes the
tokens around it along, so that no whole document is shuffled; beyond that, the documents that have hits are joined
by a shuffle.

Defined cases. Items below MIN_ITEM tokens can't tell a leak from chance and match nothing. Null or token-free text: not
contaminated. Null items: no hits. Empty tables: no hits, and one row per document still. Repeated document rows: each gets
the verdict of its id, which is that of all texts with the id together. A null doc_id is an id like any other. Items with
equal ids count as one that overlaps in the best of them. Ties for the best item go to the smallest item_id. Extra columns
are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mixweave.llm.shared import let, materialize

MIN_ITEM = 5
MIN_OVERLAP = 0.6
RUN_TOKENS = 13
BROADCAST_KEYS = 1_000_000
BROADCAST_HITS = 500_000
BROADCAST_TOKENS = 4_000_000
NEAR = 2
BLOCK = 5
RARE = 8
SHORT = 20  # tokens, below which one block may have to do
MASKS = ((0, 1, 2), (0, 1, 3), (0, 1, 4), (0, 2, 3), (0, 2, 4), (0, 3, 4))
RUN_MASK = tuple(range(RUN_TOKENS - BLOCK + 1))


def token_hashes(text: Column) -> Column:
    """Hashes of the lower-case runs of letters, marks and digits."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def masked(number: int, at: Column, places: tuple[int, ...]) -> Column:
    """The hash of the tokens at these places after at as a mask's tokens; null where they reach beyond the tokens."""
    return F.when(at + places[-1] < F.size("tokens"), F.xxhash64(F.lit(number), *[F.get("tokens", at + i) for i in places]))


def seed(number: int, at: Column) -> Column:
    """The hash of the tokens under a mask (the last number: RUN_MASK) from at on."""
    return masked(number, at, (*MASKS, RUN_MASK)[number])


def seed_places() -> list[tuple[tuple[int, ...], tuple[int, ...], tuple[int, ...]]]:
    """(mask, mask in the document, places in the block) of all choices of three of a block's tokens: as they are, and as they lie where one token was lost or put in between two of them."""
    found = []
    for mask in MASKS:
        a, b = mask[1], mask[2] - mask[1]
        moves = {(a + x, b + y) for x, y in ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1))}
        for start in range(BLOCK - mask[-1]):
            found += [(mask, moved, tuple(start + i for i in mask)) for moved in sorted((0, x, x + y) for x, y in moves) if moved in MASKS]
    return found


def with_spare(items: DataFrame) -> DataFrame:
    """Distinct items of at least MIN_ITEM tokens, numbered by item, with spare: how many common blocks may go without hashes."""
    n = F.size("tokens")
    q, r = F.floor(n / BLOCK), n % BLOCK
    sure = F.ceil((q - r + F.ceil(MIN_OVERLAP * r - 1e-9)) / 3)
    return items.where(n >= MIN_ITEM).distinct().withColumns({"item": F.xxhash64("item_id", "tokens"), "spare": F.greatest(F.floor((sure - 1) / 2), F.lit(0)).cast("int")})


def needed(n: Column, left_out: Column) -> Column:
    """The hits of an item of n tokens whose equal ones are spread evenly over its blocks, all of those left out being equal; one less from SHORT on; at least one."""
    q = F.floor(n / BLOCK) - left_out
    equal = F.greatest(F.ceil(MIN_OVERLAP * n - 1e-9) - n % BLOCK - BLOCK * left_out, F.lit(0))
    each, more = F.floor(equal / F.greatest(q, F.lit(1))), equal % F.greatest(q, F.lit(1))
    choices = lambda m: m * (m - 1) * (m - 2) / 6
    return F.greatest((q - more) * choices(each) + more * choices(each + 1) - (n >= SHORT).cast("int"), F.lit(1)).cast("int")


def item_seeds(items: DataFrame) -> DataFrame:
    """(key, item, item_at, needed): the hashes of the items' blocks; needed is how many hits the item needs, and 0 under RUN_MASK, where one is enough."""
    starts = lambda last: F.sequence(F.lit(0), last, F.lit(BLOCK))
    last, size = F.size("tokens") - BLOCK, F.size("tokens")
    blocks = items.select("item", "spare", "tokens", size.alias("size"), F.explode(F.array_distinct(F.concat(starts(last), F.array(last)))).alias("start"))
    made = [F.struct(F.when((F.col("size") < SHORT) | (moved == mask), masked(MASKS.index(moved), F.col("start"), places)).alias("key"), (F.col("start") + places[0]).alias("item_at")) for mask, moved, places in seed_places()]
    spaced = blocks.select("item", "spare", "size", "start", F.inline(F.array(*made))).where("key is not null")
    spaced = spaced.join(spaced.groupBy("key").agg(F.count("*").alias("often")), "key")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("often").desc(), "start"))
    common = spaced.groupBy("item", "spare", "start").agg(F.max("often").alias("often")).withColumn("rank", rank).where((F.col("rank") <= F.col("spare")) & (F.col("often") > RARE))
    left_out = common.groupBy("item").agg(F.count("*").alias("left_out"))
    kept = spaced.join(common.select("item", "start"), ["item", "start"], "left_anti").join(left_out, "item", "left").select("key", "item", "item_at", needed(F.col("size"), F.coalesce("left_out", F.lit(0))).alias("needed"))
    runs = blocks.where(F.col("start") % BLOCK == 0).select(seed(len(MASKS), F.col("start")).alias("key"), "item", F.col("start").alias("item_at"), F.lit(0).alias("needed"))
    return kept.unionByName(runs.where("key is not null"))


def find_hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct (doc_id, item, item_id, item_size, shift) at which enough blocks of an item are hit; docs has doc_id and tokens."""
    seeds = materialize(item_seeds(items), "seeds")
    if seeds.count() <= BROADCAST_KEYS:
        seeds = F.broadcast(seeds)
    # not a filter: it would be pushed below the tokens and compute them twice
    placed = docs.select("doc_id", "tokens", F.explode(F.when(F.size("tokens") >= MIN_ITEM, F.sequence(F.lit(0), F.size("tokens") - 1))).alias("at"))
    keyed = placed.select("doc_id", "at", F.explode(F.array(*[seed(m, F.col("at")) for m in range(len(MASKS) + 1)])).alias("key"))
    met = keyed.join(seeds, "key").groupBy("doc_id", "item", (F.col("at") - F.col("item_at")).alias("shift")).agg(F.count("*").alias("n"), F.min("needed").alias("needed"))
    near = met.select("doc_id", "item", "n", "needed", F.explode(F.sequence(F.col("shift") - NEAR, F.col("shift") + NEAR)).alias("shift"))
    hit = near.groupBy("doc_id", "item", "shift").agg(F.sum("n").alias("n"), F.min("needed").alias("needed")).where(F.col("n") >= F.col("needed"))
    return hit.join(items.select("item", "item_id", F.size("tokens").alias("item_size")), "item").select("doc_id", "item", "item_id", "item_size", "shift")


def verify(pairs: DataFrame) -> DataFrame:
    """Compares pairs token by token, item_tokens with window, the document's tokens from place low on: the overlap within NEAR of the shift and the longest run of equal tokens along it, if either reaches its threshold."""
    names = [f"d{i}" for i in range(2 * NEAR + 1)]

    def same(t: Column, q: Column, i: int) -> Column:
        at = q + F.col("shift") + (i - NEAR) - F.col("low")
        return F.coalesce(F.when(at >= 0, F.get("window", at)) == t, F.lit(False))

    rows = F.transform(F.col("item_tokens"), lambda t, q: F.struct(*[same(t, q, i).alias(n) for i, n in enumerate(names)]))
    zero = F.struct(*[F.lit(0).alias(n) for n in names], F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(a: Column, eq: Column) -> Column:
        # the longest common subsequence, kept for the shifts of the band: the same place, a lost token, an inserted one
        made: list[Column] = []
        for i, n in enumerate(names):
            made.append(F.greatest(a[n] + eq[n].cast("int"), *([a[names[i + 1]]] if i < 2 * NEAR else []), *made[-1:], a[n]))
        run = F.when(eq[names[NEAR]], a["run"] + 1).otherwise(0)
        return F.struct(*[m.alias(n) for m, n in zip(made, names, strict=True)], run.alias("run"), F.greatest(a["best"], run).alias("best"))

    made = lambda m: F.array(F.struct((m[names[-1]] / F.col("item_size")).alias("overlap"), m["best"].alias("run")))
    compared = let(F.aggregate(rows, zero, step), lambda m: F.filter(made(m), lambda x: (x["overlap"] >= MIN_OVERLAP) | (x["run"] >= RUN_TOKENS)))
    # a whole copy in the band needs no comparing by tokens
    begins = [F.col("shift") + (i - NEAR) - F.col("low") + 1 for i in range(2 * NEAR + 1)]
    whole = reduce(lambda a, b: a | b, [F.when(b > 0, F.slice("window", F.greatest(b, F.lit(1)), F.col("item_size")) == F.col("item_tokens")).otherwise(False) for b in begins])
    copy = F.array(F.struct(F.lit(1.0).alias("overlap"), F.col("item_size").alias("run")))
    good = F.when(whole, copy).otherwise(compared)
    return pairs.select("doc_id", "item_id", F.inline(good))  # a generator, as a filter would compute all this twice


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, overlap, run) of each document and item that overlap beyond the thresholds."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), token_hashes(F.col(text_col)).alias("tokens"))
    items = materialize(with_spare(benchmark.select(F.col(item_col).cast("long").alias("item_id"), token_hashes(F.col(item_text_col)).alias("tokens"))), "items")
    hits = materialize(find_hits(rows, items), "hits")
    few = hits.count() <= BROADCAST_HITS
    bounded = lambda df, ok: F.broadcast(df) if ok else df
    wanted = hits.select(F.col("doc_id").alias("hit_id")).distinct()
    picked = rows.join(bounded(wanted, few), F.col("doc_id").eqNullSafe(F.col("hit_id")), "left_semi")
    low = F.greatest(F.col("shift") - NEAR, F.lit(0))
    reach = F.greatest(F.col("shift") + F.col("item_size") + NEAR - low, F.lit(0))
    met = picked.alias("d").join(bounded(hits.alias("h"), few), F.expr("d.doc_id <=> h.doc_id")).select("h.*", low.alias("low"), F.slice("d.tokens", low + 1, reach).alias("window"))
    item_tokens = items.select("item", F.col("tokens").alias("item_tokens"))
    small = (items.agg(F.sum(F.size("tokens"))).first()[0] or 0) <= BROADCAST_TOKENS
    verified = verify(met.join(bounded(item_tokens, small), "item"))
    return verified.groupBy("doc_id", "item_id").agg(F.max("overlap").alias("overlap"), F.max("run").alias("run"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **columns: str) -> DataFrame:
    """One row per document: doc_id, contaminated, n_items, best_item and best_overlap (null and 0.0 if clean)."""
    found = contamination(docs, benchmark, **columns).groupBy("doc_id").agg(F.count("*").alias("n_items"), F.min(F.struct(-F.col("overlap"), F.col("item_id"))).alias("best"))
    ids = docs.select(F.col(columns.get("id_col", "doc_id")).cast("long").alias("doc_id"))
    return ids.alias("d").join(found.alias("f"), F.expr("d.doc_id <=> f.doc_id"), "left").select("d.doc_id", F.col("f.n_items").isNotNull().alias("contaminated"), F.coalesce("f.n_items", F.lit(0)).alias("n_items"), F.col("f.best.item_id").alias("best_item"), F.coalesce(-F.col("f.best.col1"), F.lit(0.0)).alias("best_overlap"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **columns: str) -> DataFrame:
    """The documents with all their columns that no benchmark item contaminates. The ids to drop are counted, and broadcast only within BROADCAST_HITS."""
    bad = materialize(contamination(docs, benchmark, **columns).select(F.col("doc_id").alias("bad_id")).distinct(), "contaminated")
    if bad.count() <= BROADCAST_HITS:
        bad = F.broadcast(bad)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(columns.get("id_col", "doc_id")).cast("long").alias("doc_id"))
    return rows.join(bad, F.col("doc_id").eqNullSafe(F.col("bad_id")), "left_anti").select("row.*")
