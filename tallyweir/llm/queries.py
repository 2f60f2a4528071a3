"""The registered queries opN_<name>: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweir.llm import bpe, decontamination, interpolation, near_dedup, pii, quality, quality_rules, sharding, toxicity, url_rules
from tallyweir.llm.common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document by the machine that the labels outside the held-out fold train."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.judged(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document by the machine that the labels outside the held-out fold train."""
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


#: The host rules of the contract come first, then patterns of our own.
HOST_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
SUBJECTS = ["casino", "bets", "pills", "track", "adult", "porn", "poker", "loan", "replica", "diet", "crack", "warez", "clicks", "popup", "spyware", "lottery", "jackpot", "escort", "dating", "horoscope"]
FORMS = ["^{0}-{1}^", "^{1}-{0}^", "^{0}.{1}.", "/{0}/{1}/", "|{0}{1}.", "^{0}={1}^"]
QUALIFIERS = ["free", "cheap", "best", "online", "live", "hot", "win", "fast", "instant", "bonus", "deal", "offer", "secure", "vip", "extra", "mega", "super", "ultra", "easy", "daily"]


def url_rule_set() -> list[url_rules.Rule]:
    """The host rules, one pattern for each subject, and one for each subject, qualifier and form: over two thousand."""
    out = [url_rules.Rule("||" + name, verdict, name, 1) for name, verdict in HOST_RULES]
    out += [url_rules.Rule(f"^{s}-", "block") for s in SUBJECTS]
    return out + [url_rules.Rule(form.format(s, q), "block") for form in FORMS for s in SUBJECTS for q in QUALIFIERS]


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url: the longest host rule that fits, else the patterns'."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judge(pages, url_rule_set()).select("page_id", "host", "path", "rule", "verdict")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document contains, item by item."""
    return decontamination.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen shards of near equal bytes."""
    placed = sharding.sharded(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document by the interpolated model of the documents outside the held-out fold."""
    return interpolation.scores(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: base counts and digest, and all spans."""
    return pii.digests(table(spark, sf_dir, "documents"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents of three-word shingle sets with a similarity of 0.85 or more."""
    return near_dedup.judged(table(spark, sf_dir, "documents"), threshold=0.85, n=3)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base figures, score and verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    trusted = quality_rules.trusted_buckets(docs, labels)
    ratios = quality_rules.log_ratios(docs, labels, trusted=trusted)
    return quality_rules.judged(docs, ratios, quality_rules.threshold(docs, labels, ratios, trusted=trusted))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of ids and of decoded texts; see ``bpe`` for the defined cases."""
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from tallyweir.llm import oracles

    return {name: sql for name, sql in vars(oracles).items() if name.startswith("op")}
