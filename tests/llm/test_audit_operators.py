"""Periodic runs, exact top-k search and the source divergence audit against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from mixweave.llm import divergence, periodic_runs, topk_search
from tests.llm.cases import awkward, frame, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def runs_by_search(words):
    """(start, length, period) of all runs, from the stretches of equal words at each distance."""
    n, found = len(words), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            start = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            if i > start and i + p - start >= max(6, 4 * p):
                found.setdefault((start, i + p), p)
            i += i == start
    return sorted(((s, e - s, p) for (s, e), p in found.items()), key=lambda r: (r[0], r[2]))


def repetitive(rng, size):
    words, letters = [], rng.choice((1, 2, 2, 3, 4))
    while len(words) < size:
        if words and rng.random() < 0.5:
            at = rng.randrange(len(words))
            words += words[at : at + rng.randrange(1, 9)] * rng.randrange(1, 7)
        else:
            words.append(rng.randrange(letters))
    return words


def test_all_runs_are_found():
    rng = random.Random(3)
    for _ in range(300):
        texts = [repetitive(rng, rng.randrange(70)) for _ in range(rng.randrange(1, 5))]
        first = np.cumsum([0, *map(len, texts)])
        got = defaultdict(list)
        for t, start, end, period in periodic_runs.all_runs(np.array(sum(texts, []), np.int64), first).tolist():
            got[t].append((start - first[t], end - start, period))
        for t, words in enumerate(texts):
            assert got[t] == runs_by_search(words)


def test_longest_previous_factors_and_blocks():
    words = [0, 0, 1, 0, 1, 0, 0, 0, 1, 2, 0, 1, 2]
    suffixes = periodic_runs.Suffixes(np.array(words), np.array([0, len(words)]))
    longest, earlier = periodic_runs.previous_factors(suffixes, len(words))
    for i in range(len(words)):
        best = max((next((k for k in range(len(words) - i) if words[i + k] != words[j + k]), len(words) - i) for j in range(i)), default=0)
        assert longest[i] == best and words[earlier[i] : earlier[i] + best] == words[i : i + best]
    assert periodic_runs.blocks(longest).tolist() == [0, 1, 2, 3, 6, 9, 10]


def run_cases():
    phrase = "one two three "
    return [*awkward(), (20, "a " * 7), (21, "x " + phrase * 5 + "y"), (22, (phrase * 4 + "q ") * 2), (22, phrase * 4), (23, " b  b" * 9), (24, "k\x0b" * 6 + "\n" + "k j " * 3000)]


def test_runs_and_collapsed_texts(spark):
    rows = run_cases()
    docs = frame(spark, rows).withColumn("runs", F.lit("clash")).withColumn("seed", F.lit(3)).withColumn("part", F.lit(1))
    got = Counter((r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in periodic_runs.find_runs(docs).collect())
    want = Counter()
    for doc_id, text in rows:
        words = WORD.findall(text or "")
        runs = runs_by_search(words) if len(words) < 7000 else []
        dropped = {i for start, length, period in runs for i in range(start + period, start + length)}
        want[(doc_id, len(words), tuple(runs), " ".join(w for i, w in enumerate(words) if i not in dropped))] += 1
    assert got == want
    assert any(len(r[2]) > 1 for r in want)
    assert periodic_runs.find_runs(frame(spark, [])).count() == 0


def test_seeded_tails_and_the_strongest_run(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = frame(spark, [(1, text), (2, text), (3, ""), (4, None)])
    found = periodic_runs.find_runs(docs, F.when(F.col("doc_id") != 2, F.lit(10 * (7 + 8 * 40))).otherwise(11))
    got = {r.doc_id: r for r in found.select("*", periodic_runs.strongest(F.col("runs")).alias("best"), periodic_runs.listed(F.col("runs")).alias("lines")).collect()}
    a, p = 327 % 40, 1 + (40 - 327 % 40) // (3 + 327 % 8)
    assert tuple(got[1].best) == (a, 40 - a, p) and got[1].lines == f"{a},{40 - a},{p}\n"
    assert got[1].collapsed == " ".join(f"w{i}" for i in range(a + p))
    assert got[2].best is None and got[2].lines == "" and got[2].collapsed == text
    assert (got[3].collapsed, got[4].collapsed, got[4].best) == ("", "", None)
    ties = spark.sql("SELECT array(struct(5L AS start, 12L AS length, 3L AS period), struct(9L AS start, 8L AS length, 2L AS period), struct(1L AS start, 400L AS length, 101L AS period)) AS runs")
    assert tuple(ties.select(periodic_runs.strongest(F.col("runs"))).first()[0]) == (5, 12, 3)


def ranked_by_search(rows, k, asks):
    out = []
    for i, (query, q) in enumerate(rows):
        if q is not None and query is not None and asks(query):
            scores = [(-sum(a * b for a, b in zip(q, v, strict=False)), v_id is None, v_id or 0, v_id) for j, (v_id, v) in enumerate(rows) if j != i and v is not None]
            out += [(query, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scores)[:k], 1)]
    return Counter(out)


@pytest.mark.parametrize("size, least, group, top", [(0, 256, 16384, 9), (3, 256, 16384, 9), (150, 256, 16384, 3), (150, 16, 4, 3), (400, 64, 7, 200)])
def test_topk_is_exact(spark, monkeypatch, size, least, group, top):
    monkeypatch.setattr(topk_search, "LEAST_ROWS", least)
    monkeypatch.setattr(topk_search, "GROUP_ROWS", group)
    rng = random.Random(size + top)
    rows = [(rng.randrange(-30, 200), [rng.randrange(-top, top) for _ in range(rng.choice((6, 6, 6, 4)))]) for _ in range(size)]
    rows += rows[: size // 5] + [(None, [1, 1])] * (size > 3) + [(10, None)] * (size > 3) + [(20, [0] * 6), (20, [])] * (size > 3)
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>").withColumn("key", F.lit("clash")).withColumn("part", F.lit(0))
    got = Counter(map(tuple, topk_search.search(df, F.col("vec_id") % 5 == 0, 4).collect()))
    assert got == ranked_by_search(rows, 4, lambda i: i % 5 == 0)


def test_topk_stops_early_and_stays_exact_for_huge_numbers(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(-9, 9, (3000, 3))
    x[:40] *= 100
    q = x[:60]
    who, at, score = topk_search.best_of(x, q, 5)
    want = np.argsort(-(q @ x.T), axis=1, kind="stable")[:, :5]
    assert Counter(zip(who.tolist(), at.tolist(), strict=True)) == Counter((i, j) for i, row in enumerate(want.tolist()) for j in row)
    huge = [(0, [2**31, 1]), (1, [2**30, 5]), (2, [2**30, 7]), (3, [-(2**31), 0])]
    df = spark.createDataFrame(huge, "vec_id long, vector array<long>")
    assert Counter(map(tuple, topk_search.search(df, F.col("vec_id") == 0, 2).collect())) == ranked_by_search(huge, 2, lambda i: i == 0)


def test_vectors_that_take_no_part(spark):
    rows = [(1, [0.5, -0.001]), (2, None), (3, [1.0, None]), (4, [float("nan")]), (5, [float("-inf"), 1.0]), (6, [])]
    got = {r.id: r.v for r in spark.createDataFrame(rows, "id long, x array<float>").select("id", topk_search.whole(F.col("x")).alias("v")).collect()}
    assert got == {1: [128, -1], 2: None, 3: None, 4: None, 5: None, 6: []}


def audit_by_counting(rows, fewest, top):
    docs = [tuple(v or "" for v in r) for r in rows]
    terms = [[re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text)] for _, _, text in docs]
    seen = Counter((d[0], t) for d, found in zip(docs, terms, strict=True) for t in set(found))
    out = []
    for lang in {d[0] for d in docs}:
        kept = sorted(t for (l, t), n in seen.items() if l == lang and n >= fewest)
        counts = {s: Counter() for l, s, _ in docs if l == lang}
        for (l, s, _), found in zip(docs, terms, strict=True):
            if l == lang:
                counts[s].update(t for t in found if t in set(kept))
        shares = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        p, q = {s: shares(c) for s, c in counts.items()}, shares(sum(counts.values(), Counter()))
        for s in counts:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in counts if o != s]
            found = [(q[t] - p[s][t], t.encode(), t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(found)[:top])):
                out += [(lang, s, part, item, -value, rank) for rank, (value, _, item) in enumerate(items, 1)]
    return sorted(out)


def audit_rows():
    rng = random.Random(11)
    rows = [(rng.choice(("en", "en", "de", None)), rng.choice(("a", "a", "a", "b", "é", None, f"s{rng.randrange(12)}")), prose(i, rng.randrange(60)) + rng.choice((" ÉÉ", " x y", "it's A-B_c", "", "\x00nul\x7fDEL İ"))) for i in range(150)]
    return [*rows, ("en", "silent", None), ("en", "silent", ""), ("fr", "f1", "un deux"), ("fr", "f2", None), ("de", "a", "ÉÉ " * 3000), (None, None, None), *rows[:9]]


@pytest.mark.parametrize("slice_terms, tile_terms, tile_sources, held", [(200_000, 1024, 128, 250_000), (7, 5, 2, 20)])
def test_audit_matches_counting(spark, monkeypatch, slice_terms, tile_terms, tile_sources, held):
    for name, value in (("SLICE_TERMS", slice_terms), ("TILE_TERMS", tile_terms), ("TILE_SOURCES", tile_sources), ("HELD", held), ("FEWEST_DOCS", 12), ("TOP_TERMS", 7)):
        monkeypatch.setattr(divergence, name, value)
    rows = audit_rows()
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(3).withColumn("term", F.lit("clash")).withColumn("n", F.lit(1)).withColumn("size", F.lit(None).cast("string"))
    got = sorted(map(tuple, divergence.audit(df).collect()))
    assert got == audit_by_counting(rows, 12, 7)
    assert {r[2] for r in got} == {"pair", "term"} and all(r[4] == 0 for r in got if r[0] == "fr")


def test_audit_of_nothing(spark):
    assert divergence.audit(frame(spark, [])).count() == 0
