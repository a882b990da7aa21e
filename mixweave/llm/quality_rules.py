"""Quality rules with host verdicts, in DataFrame functions only.

Each text is measured in its own row (no word leaves it): words, symbols, repeated lines, and words in 3-word windows
that occur twice or more. A document fails the base rules if it is short or mostly repeats itself; it fails the doubtful
ones if symbols make up much of its words, many of its lines repeat, or its words are unusually short or long. The measures,
a few numbers per document, are written once to the shared folder, since the host statistics and the result both need
them. Documents that fail any rule are summed per domain before the shuffle. The failure rates of all domains give a
beta prior by the method of moments, which shrinks the rate of a domain with few documents towards the common rate.

The shrunk rate decides the verdict on a domain, which goes back to its documents. "rejected", above max_host_rate: all
its documents go. "trusted", up to trusted_host_rate: documents that fail doubtful rules only are excused. "normal": they go too.
Nothing excuses a failed base rule. The table of rates is broadcast only if its counted rows are within BROADCAST_HOSTS;
beyond it, an ordinary join is used, whose large partitions adaptive execution splits.

Defined cases. Null or blank text: no words, so the document fails. Documents with a null domain form one domain of
their own. Repeated rows each count. No documents: no rows. All domains at one rate, or a single one: no variance is
left to fit, and the prior is the common rate with a weight of MAX_PRIOR documents. A rate at a threshold is not above it. Extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixweave.llm.shared import SPACE_CHARS, let, materialize, word_array

MIN_WORDS = 50
MAX_REPEAT_SHARE = 50  # per cent of words in repeated windows
MAX_SYMBOL_SHARE = 25  # per cent of the characters of words
MAX_DUP_LINES = 30  # per cent of the lines with a word
MIN_MEAN_WORD, MAX_MEAN_WORD = 3, 10  # characters
MAX_HOST_RATE, TRUSTED_HOST_RATE = 0.5, 0.02
TRUST_SPREAD = 0.1  # of the prior's standard deviation
MAX_PRIOR = 1000.0
SYMBOLS = "#*$%&|<>"  # fixed values
BROADCAST_HOSTS = 100_000


def repeated_words(words: Column) -> Column:
    """How many words lie in a 3-word window that occurs at least twice. Windows are told apart by a 64-bit hash."""
    size = F.size(words)

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)))

    def covered(hashes: Column) -> Column:
        # (hash, place) in order; a place counts if a neighbour has its hash
        tagged = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        again = let(tagged, lambda t: F.filter(t, lambda x, k: F.get(t, k - 1)["h"].eqNullSafe(x["h"]) | F.get(t, k + 1)["h"].eqNullSafe(x["h"])))
        places = F.sort_array(F.transform(again, lambda x: x["i"]))
        # each place covers three words, less what the next one covers too
        return let(places, lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, b: a + b))

    return F.when(size < 4, F.lit(0)).otherwise(let(words, lambda w: let(windows(w), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))))).cast("long")


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", keep_rows: bool = False) -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed and rule_failed (any rule, base or doubtful) of each document; with keep_rows, also the whole row as a struct."""
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if keep_rows else []
    carried = ["row"] if keep_rows else []
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *row)
    text = F.col("text")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACE_CHARS, "") != "")
    found = rows.select(
        "doc_id",
        "host",
        *carried,
        word_array(text).alias("words"),
        F.length(F.translate(text, SPACE_CHARS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("all"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
    )
    found = found.select("doc_id", "host", *carried, F.size("words").cast("long").alias("n_words"), "word_chars", "n_symbols", F.col("lines.all").alias("n_lines"), F.col("lines.dup").alias("n_dup_lines"), repeated_words(F.col("words")).alias("n_repeat_words"))
    found = found.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_SHARE * F.col("n_words")))
    doubtful = (100 * F.col("n_symbols") > MAX_SYMBOL_SHARE * F.col("word_chars")) | (100 * F.col("n_dup_lines") > MAX_DUP_LINES * F.col("n_lines"))
    doubtful = doubtful | (F.col("word_chars") < MIN_MEAN_WORD * F.col("n_words")) | (F.col("word_chars") > MAX_MEAN_WORD * F.col("n_words"))
    return found.withColumn("rule_failed", F.col("base_failed") | doubtful)


def host_rates(measured: DataFrame) -> DataFrame:
    """One row per host: documents, failures, the failure rate shrunk by the prior that all hosts give, and the rate below which that prior has a host trusted."""
    hosts = materialize(measured.groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("rule_failed").cast("long")).alias("n_failed")), "rates")
    rate = F.col("n_failed") / F.col("n_docs")
    prior = hosts.agg(F.avg(rate).alias("mean"), F.var_pop(rate).alias("var"), F.avg(1 / F.col("n_docs")).alias("inverse"))
    # the variance between hosts, less what drawing n_docs documents alone brings
    spread = F.col("mean") * (1 - F.col("mean"))
    between = F.col("var") - spread * F.col("inverse")
    weight = F.when(between > 0, F.least(F.greatest(spread / between - 1, F.lit(0.0)), F.lit(MAX_PRIOR))).otherwise(F.lit(MAX_PRIOR))
    mean, weight = prior.select("mean", weight).first()  # two numbers: an aggregate without a key
    shrunk = (F.col("n_failed") + F.lit(mean) * F.lit(weight)) / (F.col("n_docs") + F.lit(weight))
    trusted = F.lit(mean) - TRUST_SPREAD * F.sqrt(F.lit(mean) * (1 - F.lit(mean)) / (F.lit(weight) + 1))
    return hosts.select("host", "n_docs", "n_failed", shrunk.alias("host_rate"), trusted.alias("trusted_below"))


def verdicts(measured: DataFrame, max_host_rate: float, trusted_host_rate: float) -> DataFrame:
    """The rows of a materialised table of measures with host_rate, host_verdict and kept."""
    rates = materialize(host_rates(measured).select("host", "host_rate", (F.col("host_rate") < F.col("trusted_below")).alias("better")), "hosts")
    if rates.count() <= BROADCAST_HOSTS:
        rates = F.broadcast(rates)
    joined = measured.alias("m").join(rates.alias("r"), F.expr("m.host <=> r.host"), "left").select("m.*", "r.host_rate", "r.better")
    verdict = F.when(F.col("host_rate") > max_host_rate, "rejected").when((F.col("host_rate") <= trusted_host_rate) | F.col("better"), "trusted").otherwise("normal")
    joined = joined.withColumn("host_verdict", verdict)
    excused = ~F.col("rule_failed") | (F.col("host_verdict") == "trusted")
    return joined.withColumn("kept", ~F.col("base_failed") & (F.col("host_verdict") != "rejected") & excused).drop("host", "better")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_host_rate: float = MAX_HOST_RATE, trusted_host_rate: float = TRUSTED_HOST_RATE) -> DataFrame:
    """The measures of each document with the rate and verdict of its host, and kept: false if base_failed, else what the host's verdict leaves."""
    return verdicts(materialize(measures(docs, id_col, text_col, host_col), "quality"), max_host_rate, trusted_host_rate)


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_host_rate: float = MAX_HOST_RATE, trusted_host_rate: float = TRUSTED_HOST_RATE) -> DataFrame:
    """The rows of docs that are kept. They are written once beside their measures, so no text is shuffled and none is measured twice."""
    measured = materialize(measures(docs, id_col, text_col, host_col, keep_rows=True), "quality")
    return verdicts(measured, max_host_rate, trusted_host_rate).where("kept").select("row.*")
