"""Packing, token counts, language, license and quality operators against plain computations."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from mixweave.llm import language_id, license_scan, packing, quality_rules, token_counts
from mixweave.llm.license_texts import TEMPLATES
from mixweave.llm.queries import vocabulary
from tests.llm.cases import SCHEMA, awkward, frame, prose

BYTE, PIECE = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, awkward()).withColumn("length", F.lit("clash")).withColumn("start", F.lit(1)).cache()


def test_packing_holds_every_token_once(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTE)
    rows = packing.pack(docs, BYTE, window=256, group_docs=5).collect()
    got = Counter()
    for r in rows:
        got[(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens)] += 1
    want = Counter()
    for doc_id, text in awkward():
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        for at in range(0, len(ids), 256):
            part = ids[at : at + 256]
            want[(doc_id, at, len(part), zlib.crc32(part.tobytes()), len(ids))] += 1
    assert got == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 256
    assert packing.pack(frame(spark, []), BYTE).count() == 0


def test_best_fit_takes_the_tightest_sequence():
    lengths = np.array([7, 6, 3, 2, 1, 1])
    sequence, offset = packing.best_fit_decreasing(lengths, 10)
    assert sequence.tolist() == [0, 1, 0, 1, 1, 1] and offset.tolist() == [0, 0, 7, 6, 8, 9]
    rng = np.random.default_rng(0)
    lengths = np.sort(rng.integers(1, 2048, 3000))[::-1]
    sequence, _ = packing.best_fit_decreasing(lengths, 2048)
    rooms, want = [], []  # by searching all open sequences
    for x in lengths:
        fit = [(room, i) for i, room in enumerate(rooms) if room >= x]
        i = min(fit)[1] if fit else len(rooms)
        if not fit:
            rooms.append(2048)
        rooms[i] -= x
        want.append(rooms[i])
    left = 2048 - np.bincount(sequence, weights=lengths)
    assert sorted(left) == sorted(rooms)
    assert len(left) <= 11 / 9 * -(-lengths.sum() // 2048) + 4  # the proven bound; every second length here is over half a window


def test_token_counts_equal_the_library(spark, docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    got = Counter(map(tuple, token_counts.token_counts(docs, PIECE, limit=100).collect()))
    want = Counter()
    for doc_id, text in awkward():
        n = len(library.encode(text or ""))
        want[(doc_id, len((text or "").encode()), n, n > 100)] += 1
    assert got == want
    assert token_counts.token_counts(frame(spark, []), PIECE).count() == 0


def test_token_counts_of_runs_and_odd_words():
    import pyarrow as pa
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    texts = [" " * i + "q" + " " * (2 * i) for i in range(20)] + ["a" * i for i in range(1, 300, 37)] + ["\n" * i + "b\n c" for i in range(5)] + ["1234-" * 400, "ÄäÖö" * 90, "▁▁x ▁"]
    assert token_counts.TokenCounter(PIECE).of_texts(pa.array(texts)).tolist() == [len(library.encode(t)) for t in texts]


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    at = defaultdict(list)
    for i in range(len(words) - 2):
        at[tuple(words[i : i + 3])].append(i)
    covered = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(3)}
    seen, lines, dup = set(), 0, 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            lines += 1
            seen.add(line)
    n, chars, symbols = len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or "")
    base = n < 50 or 100 * len(covered) > 50 * n
    return n, chars, symbols, lines, dup, len(covered), base, base or symbols > chars / 4 or dup > 0.3 * lines or not 3 * n <= chars <= 10 * n


def test_quality_measures(spark):
    rows = [*awkward(), (20, "a b c a b c d"), (21, "x x x x x"), (22, "l1\nl1\n l1\n\n\nl2 #$%\nl2 #$%"), (23, ("one two three four five six seven " * 20)), (24, "a b c d a b c d e a b")]
    rows += [(30, prose(1, 80) + " #$%&" * 60), (31, "\n".join([prose(2, 60)] + ["same line"] * 5)), (32, " ".join(f"{i}" for i in range(60))), (33, prose(3, 60) + " " + "long" * 200)]
    got = quality_rules.judge(frame(spark, rows).withColumn("host", F.lit("clash")).withColumn("words", F.lit("clash"))).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "rule_failed")
    assert Counter((r.doc_id, *(r[n] for n in names)) for r in got) == Counter((d, *brute_quality(t)) for d, t in rows)
    assert all(r.rule_failed and not r.base_failed for r in got if r.doc_id in (30, 31, 32, 33))
    assert quality_rules.judge(frame(spark, [])).count() == 0


@pytest.mark.parametrize("most", [quality_rules.BROADCAST_HOSTS, 0])
def test_host_verdicts(spark, monkeypatch, most):
    monkeypatch.setattr(quality_rules, "BROADCAST_HOSTS", most)
    good, bad, odd = prose(1, 80), "too short", prose(2, 80) + " #$%&" * 60
    rows = [(i, bad if i % 10 else good, "en", "spam") for i in range(60)] + [(100 + i, good, "en", f"h{i % 6}") for i in range(60)] + [(200, bad, "en", "one"), (201, good, "en", None)]
    rows += [(1000 + i, odd if i == 3 else bad if i == 4 else good, "en", "fine") for i in range(400)] + [(2000 + i, odd if i % 5 == 0 else good, "en", "mixed") for i in range(60)]
    got = {r.doc_id: r for r in quality_rules.judge(frame(spark, rows)).collect()}
    assert not any(got[i].kept for i in range(60)) and {got[i].host_verdict for i in range(60)} == {"rejected"}
    assert all(got[100 + i].kept for i in range(60)) and got[201].kept and not got[200].kept
    assert got[1003].rule_failed and got[1003].kept and got[1003].host_verdict == "trusted" and not got[1004].kept  # the host excuses doubtful rules only
    assert {i: got[2000 + i].kept for i in range(60)} == {i: i % 5 > 0 for i in range(60)} and got[2000].host_verdict == "normal"
    kept = quality_rules.keep_good(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"] and {r.doc_id for r in kept.collect()} == {d for d, r in got.items() if r.kept}
    # the shrunk rates by hand
    hosts = defaultdict(list)
    for r in rows:
        hosts[r[3]].append(brute_quality(r[1])[-1])
    rate = [np.mean(v) for v in hosts.values()]
    mean, spread = np.mean(rate), np.mean(rate) * (1 - np.mean(rate))
    between = np.var(rate) - spread * np.mean([1 / len(v) for v in hosts.values()])
    weight = min(max(spread / between - 1, 0), 1000) if between > 0 else 1000
    limit = mean - quality_rules.TRUST_SPREAD * (spread / (weight + 1)) ** 0.5
    for d, _, _, host in rows:
        assert (got[d].host_verdict == "trusted") == (got[d].host_rate <= 0.02 or got[d].host_rate < limit)
        assert abs(got[d].host_rate - (sum(hosts[host]) + mean * weight) / (len(hosts[host]) + weight)) < 1e-9


def test_the_prior_decides_which_documents_stay(spark, monkeypatch):
    """Sources that fail much alike: a few documents more or less don't make a small one trusted, once the prior has shrunk its rate."""
    good, odd = prose(1, 80), prose(2, 80) + " #$%&" * 60
    rows = [(10_000 * s + i, odd if i * 8 % n < 8 and (s or i) else good, "en", f"s{s}") for s, n in enumerate((40, 400, 400, 400)) for i in range(n)]
    rows += [(90_000 + i, odd if i < 20 else good, "en", "best") for i in range(400)]
    rows = [r if r[3] != "s0" else (r[0], odd if r[0] < 7 else good, "en", "s0") for r in rows]
    judged = lambda: {r.doc_id: r for r in quality_rules.judge(frame(spark, rows)).collect()}
    got = judged()
    kinds = {r[3]: got[r[0]].host_verdict for r in rows}
    assert kinds["best"] == "trusted" and "normal" in kinds.values()
    assert all(got[r[0]].kept for r in rows if r[3] == "best") and not all(g.kept for g in got.values())
    monkeypatch.setattr(quality_rules, "MAX_PRIOR", 0.0)  # raw rates, and a prior without a width of its own
    assert {d: r.kept for d, r in judged().items()} != {d: r.kept for d, r in got.items()}


def test_language_profiles(spark):
    text = {"aa": "abab baba abba", "bb": "xyxy yxyx xyyx", "cc": "mnop ponm"}
    rows = [(i, " ".join([text[lang]] * (1 + i % 3)), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 10)]
    rows += [(100, None, "aa"), (101, "123 !!", "bb"), (102, "yxy", None), (None, "abab abba", "cc"), (103, "abab " * 20000, None)]
    got = {r.doc_id: r for r in language_id.identify(frame(spark, rows).withColumn("score", F.lit("clash"))).collect()}
    for i, lang in enumerate(["aa", "bb", "cc"] * 10):
        assert got[i].lang_pred == lang and 0 <= got[i].score <= 1
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
    assert (got[100].lang_pred, got[100].score) == ("und", 0.0) and got[101].lang_pred == "und"
    assert got[102].lang_pred == "bb" and got[103].lang_pred == "aa" and got[None].lang_pred == "aa" and not got[None].held_out
    assert {r.lang_pred for r in language_id.identify(frame(spark, [(1, "abc", None)])).collect()} == {"und"}
    assert language_id.identify(frame(spark, [])).count() == 0


def test_predictions_are_the_least_out_of_place_distance(spark):
    text = {"aa": "abab baba abba cab", "bb": "xyxy yxyx xyyx cab", "cc": "mnop ponm abx"}
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(rng.choice((text["aa"] + " " + text["bb"] + " " + text["cc"]).split(), int(rng.integers(1, 30)))), str(rng.choice(["aa", "bb", "cc"]))) for i in range(120)]
    rows += [(200, "qq", None), (201, "ab 12 é", None), *awkward()]
    top = 25

    def ranked(texts):
        n = Counter()
        for t in texts:
            for word in "".join(c if c.isalpha() else " " for c in (t or "").lower()).split():
                w = f" {word} "
                n.update([*word, *[w[i : i + 2] for i in range(len(w) - 1)], *[w[i : i + 3] for i in range(len(w) - 2)]])
        # equal counts: the smaller as code points of one, two or three characters, an edge before any letter
        code = lambda g: sum((ord(c) + 1 if c != " " else 1) << (21 * (len(g) - 1 - i)) for i, c in enumerate(g))
        return sorted(n, key=lambda g: (-n[g], code(g)))[:top]

    train = [r for r in rows if r[0] is not None and r[1] is not None and len(r) > 2 and r[2] and zlib.crc32(str(r[0]).encode()) % 3 != 1]
    train += [(d, t, "en") for d, t in awkward() if d is not None and t is not None and zlib.crc32(str(d).encode()) % 3 != 1]
    profile = {lang: ranked([t for _, t, x in train if x == lang]) for lang in sorted({x for _, _, x in train})}
    got = Counter((r.doc_id, r.lang_pred, round(r.score, 9)) for r in language_id.identify(frame(spark, rows), top=top).collect())
    want = Counter()
    for d, t, *_ in rows:
        mine = ranked([t])
        far = {x: sum(abs(p.index(g) - i) if g in p else top for i, g in enumerate(mine)) for x, p in profile.items()}
        best = min(far, key=lambda x: (far[x], x))
        want[(d, best, round(1 - far[best] / (top * len(mine)), 9)) if mine else (d, "und", 0.0)] += 1
    assert got == want


def test_profiles_count_all_training_text(spark):
    rows = [(i, prose(i, 50), "en" if i % 2 else "fr") for i in range(12)]
    table = language_id.letters()
    counts = {}
    for _, text, lang in rows:
        counts.setdefault(lang, Counter()).update(language_id.grams(text, table).tolist())
    for r in language_id.profiles(frame(spark, rows).select("lang", "text"), 30).collect():
        want = sorted(counts[r.lang], key=lambda g: (-counts[r.lang][g], g))
        assert want[r.place] == r.gram


def test_license_scan_keeps_other_notices_of_a_window(spark):
    changed = TEMPLATES["MIT-permission"].split()
    for i in (5, 40):
        changed[i] = "changed"
    gpl = TEMPLATES["GPL-2.0-line"] + " ", TEMPLATES["GPL-3.0-line"] + " "
    rows = [(1, " ".join(changed) + " " + TEMPLATES["Apache-2.0-header"]), (2, prose(4, 60) + " " + gpl[0]), (3, gpl[1] + prose(5, 40)), (4, gpl[0] + gpl[1]), (5, gpl[1] + prose(6, 30) + " " + gpl[0])]
    got = {r.doc_id: set(r.licenses.split(",")) for r in license_scan.scan_licenses(frame(spark, rows), TEMPLATES).collect()}
    assert {"MIT-permission", "Apache-2.0-header"} <= got[1]
    assert got[2] == {"GPL-2.0-line"} and got[3] == {"GPL-3.0-line"} and got[4] == got[5] == {"GPL-2.0-line", "GPL-3.0-line"}


def brute_containment(text, template):
    """The largest share of the template's shingles in one of the windows of its size."""
    words = [w for w in map(license_scan.normal, (text or "").split())]
    gram = lambda w: [tuple(w[i : i + 3]) for i in range(len(w) - 2)] or ([tuple(w)] if w else [])
    wanted = set(gram([license_scan.normal(w) for w in template.split()]))
    half, own = license_scan.BLOCK << license_scan.level_of(len(wanted)), gram(words)
    return max((len(wanted & set(own[i : i + 2 * half])) / len(wanted) for i in range(0, len(own), half)), default=0.0)


def test_license_matches_are_all_windows_by_all_templates(spark):
    bank = {f"t{i}": prose(500 + i, n) for i, n in enumerate([1, 2, 3, 4, 5, 9, 20, 60, 150, 400, 2500])}
    rng = np.random.default_rng(3)
    rows = list(awkward())
    for i in range(40):
        words = prose(i, int(rng.integers(0, 300))).split()
        for name in rng.choice(sorted(bank), 3, replace=False):
            part = bank[name].split()
            for at in rng.choice(len(part), int(len(part) * rng.choice([0, 0, 0.02, 0.06, 0.1])), replace=False):
                part[at] = f"new{i}"
            words = words + part + prose(90 + i, int(rng.integers(0, 40))).split()
        rows.append((100 + i, " ".join(words)))
    rows += [(200, bank["t2"]), (200, bank["t2"]), (201, bank["t3"] + " " + bank["t5"])]
    got = {(r.doc_id, r.template): round(r.containment, 9) for r in license_scan.matches(frame(spark, rows).withColumn("template", F.lit("clash")), bank).collect()}
    found = {(d, name): round(brute_containment(text, t), 9) for d, text in rows if d is not None for name, t in bank.items()}
    assert got == {k: v for k, v in found.items() if v >= license_scan.CONTAINMENT} and len(got) > 80
    per_doc = Counter(r.doc_id for r in license_scan.scan_licenses(frame(spark, rows), bank).collect())
    assert per_doc == Counter(d for d, _ in rows)


def test_license_scan_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(license_scan, "BROADCAST_BYTES", 0)
    rows = [(1, prose(1, 30) + " " + TEMPLATES["GPL-header"] + " " + TEMPLATES["MIT-line"]), (2, prose(2, 90))]
    assert {r.doc_id: r.licenses for r in license_scan.scan_licenses(frame(spark, rows), TEMPLATES).collect()} == {1: "GPL-header,MIT-line", 2: ""}


def test_license_scan(spark):
    def inside(seed, name, before, after):
        return prose(seed, before) + "\n" + TEMPLATES[name] + "\n" + prose(seed + 1, after)

    changed = TEMPLATES["MIT-permission"].split()
    for i in (5, 40):
        changed[i] = "changed"
    rows = [(i, inside(i, name, 7 * i, 90 - i)) for i, name in enumerate(sorted(TEMPLATES))]
    rows += [(50, " ".join(changed)), (51, prose(3, 400)), (52, None), (53, ""), (54, "MIT License"), (55, TEMPLATES["MIT-line"].upper()), (56, inside(1, "MIT-line", 20000, 3) + TEMPLATES["GPL-2.0-line"])]
    got = {r.doc_id: r for r in license_scan.scan_licenses(frame(spark, rows).withColumn("level", F.lit("clash")), TEMPLATES).collect()}
    for i, name in enumerate(sorted(TEMPLATES)):
        assert name in got[i].licenses.split(",") and got[i].best_containment == 1.0, name
    assert got[50].licenses == "MIT-permission" and 0.8 <= got[50].best_containment < 1
    assert all(got[i].n_licenses == 0 and got[i].best_template is None for i in (51, 52, 53, 54))
    assert got[55].licenses == "MIT-line" and got[56].licenses == "GPL-2.0-line,MIT-line"
    assert license_scan.scan_licenses(frame(spark, []), TEMPLATES).count() == 0
    with pytest.raises(ValueError):
        license_scan.bank({"x": " "})
    assert SCHEMA.startswith("doc_id")
