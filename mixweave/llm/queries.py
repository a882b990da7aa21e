"""The queries of the corpus operators, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixweave.llm import decontam, divergence, language_id, license_scan, near_dedup, oracles, packing, periodic_runs, quality_rules, suffix_dedup, token_counts, topk_search, url_filters, warc
from mixweave.llm.license_texts import TEMPLATES
from mixweave.llm.shared import read_table, scratch

#: Dated events of the url lists that op6 applies: list, kind, key, action, day (fixed values).
URL_EVENTS = (
    ("spam", "domain", "spam-farm.example.com", "add", "2024-01-10"),
    ("spam", "domain", "spam-farm.example.com", "remove", "2024-05-01"),
    ("spam", "domain", "spam-farm.example.com", "add", "2024-08-15"),
    ("spam", "domain", "cheap-pills.example.com", "add", "2023-11-01"),
    ("gambling", "domain", "casino-win.example.com", "add", "2024-02-01"),
    ("gambling", "domain", "free-bets.example.com", "add", "2023-06-01"),
    ("gambling", "domain", "free-bets.example.com", "remove", "2024-10-01"),
    ("tracking", "domain", "ads-track.example.com", "add", "2023-01-01"),
    ("tracking", "domain", "ads-track.example.com", "remove", "2024-03-01"),
    ("tracking", "domain", "ads-track.example.com", "add", "2024-03-20"),
    ("adult", "domain", "adult-x.example.net", "add", "2024-04-01"),
    ("review", "prefix", "blog.tionsh.example.com/es", "add", "2024-06-01"),
    ("review", "prefix", "www.spam-farm.example.com/en", "add", "2024-03-01"),
)
#: Beside them, a list made from the pages' own hosts: of every third host by hash, up to five events in the 450 days after this one, add and remove in turn.
LISTED_FROM, LISTED_DAYS = "2023-10-01", 450
#: Pages carry no fetch time: page p counts as fetched p mod FETCH_DAYS days after FETCH_START.
FETCH_START, FETCH_DAYS = "2024-01-01", 366


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(read_table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write_archive(read_table(spark, sf_dir, "pages"), path)
    return warc.index(spark, path)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.find_repeats(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def url_events(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """The log of URL_EVENTS and of the list made from the hosts of pages, as rows list_name, kind, key, action, at."""
    rows = [F.struct(*[F.lit(v).alias(n) for n, v in zip(("list_name", "kind", "key", "action", "day"), e, strict=True)]) for e in URL_EVENTS]
    named = spark.range(1).select(F.inline(F.array(*rows))).withColumn("at", F.to_timestamp("day")).drop("day")
    hosts = pages.select(url_filters.host_of(F.col("url")).alias("key")).where("key <> ''").distinct()
    hosts = hosts.withColumn("h", F.conv(F.substring(F.md5(F.col("key").cast("binary")), 1, 6), 16, 10).cast("long")).where("h % 3 = 0")
    events = hosts.select("key", "h", F.explode(F.sequence(F.lit(0), F.expr("cast(h div 3 % 5 as int)"))).alias("j"))
    day = F.timestamp_add("DAY", ((F.col("h") + F.col("j") * 97) % LISTED_DAYS).cast("int"), F.to_timestamp(F.lit(LISTED_FROM)))
    made = events.select(F.lit("hosts").alias("list_name"), F.lit("domain").alias("kind"), "key", F.when(F.col("j") % 2 == 0, "add").otherwise("remove").alias("action"), day.alias("at"))
    return named.unionByName(made)


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetch_time", F.timestamp_add("DAY", F.pmod("page_id", F.lit(FETCH_DAYS)).cast("int"), F.to_timestamp(F.lit(FETCH_START))))
    return url_filters.evaluate(captures, url_events(spark, pages)).select("page_id", "blocked", "n_entries", "lists")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read_table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(read_table(spark, sf_dir, "documents"), TEMPLATES)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read_table(spark, sf_dir, "documents")).withColumn("host_rate", F.round("host_rate", 6))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(read_table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string").cast("binary")))
    found = found.withColumn("best", periodic_runs.strongest(F.col("runs")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(periodic_runs.listed(F.col("runs")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), topk_search.whole(F.col("embedding")).alias("vector"))
    return topk_search.search(vectors, F.col("vec_id") % 50 == 0, 5)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (op1_packing, op2_token_counts, op3_near_dedup, op4_warc, op5_suffix_dedup, op6_url_filters, op7_language_id, op8_license_scan, op9_quality_rules, op10_decontamination, op11_periodic_runs, op12_exact_topk, op13_source_divergence)
    return {q.__name__: q for q in made}


def oracle_sql() -> dict[str, str]:
    return {"op4_warc": oracles.OP4, "op6_url_filters": oracles.op6(URL_EVENTS, LISTED_FROM, LISTED_DAYS, FETCH_START, FETCH_DAYS), "op9_quality_rules": oracles.OP9, "op12_exact_topk": oracles.OP12, "op13_source_divergence": oracles.OP13}
