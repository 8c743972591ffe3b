"""Queries of problems 8 and 9: containers and mixes, by tokens of a public tokenizer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.llm.mixing import mix
from earshot.llm.packing import pack
from earshot.llm.token_counts import TOKENIZER, n_tokens
from earshot.session import cut
from earshot.sources.tables import table


def p8_containers(spark: SparkSession, folder: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """The container of every text or piece, for each kind of container, and the space left in it."""
    capacities = {r.pack_name: r.max_tokens for r in table(spark, folder, "pack_capacities").collect()}
    sizes = table(spark, folder, "documents").select("doc_id", n_tokens(F.col("text"), tokenizer).alias("n_tokens"))
    return pack(spark, cut(sizes, "sizes"), "doc_id", "n_tokens", capacities)


def p9_mix(spark: SparkSession, folder: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """How often each text is used, so that every source comes as close as it can to its share."""
    targets = {r.source: (r.target_share, r.max_repeats) for r in table(spark, folder, "source_targets").collect()}
    docs = table(spark, folder, "documents").select("doc_id", "source", "text", n_tokens(F.col("text"), tokenizer).alias("n_tokens"))
    return mix(spark, docs, targets)


def p8_placed(spark: SparkSession, folder: str) -> DataFrame:
    """(pack_name, doc_id) of the texts that lie in containers as they should: all pieces there, none split without need, no container overfull."""
    rows = cut(p8_containers(spark, folder), "containers")
    caps = table(spark, folder, "pack_capacities").select("pack_name", F.col("max_tokens").alias("cap"))
    fill = rows.groupBy("pack_name", "container").agg(F.sum("tokens").alias("fill"), F.min("unused").alias("lo"), F.max("unused").alias("hi"))
    fine = fill.join(F.broadcast(caps), "pack_name").where("fill + lo = cap and lo = hi and lo >= 0")  # a few rows of capacities
    size = table(spark, folder, "documents").select("doc_id", n_tokens(F.col("text")).alias("size"))
    texts = rows.join(fine.select("pack_name", "container", "cap").hint("merge"), ["pack_name", "container"])
    texts = texts.groupBy("pack_name", "doc_id", "cap").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("pieces"), F.max("piece").alias("last"))
    whole = texts.join(size, "doc_id").where("tokens = size and pieces = ceil(size / cap) and last = pieces - 1")
    return whole.select("pack_name", "doc_id")


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """(source, target_share, reached, capped): whether a source gives its target share of all tokens used, to within the longest text, and no text is used too often."""
    rows = cut(p9_mix(spark, folder), "mixed")
    targets = table(spark, folder, "source_targets")
    used = rows.where("times > 0").groupBy("source").agg(F.sum(F.col("times") * F.col("n_tokens")).alias("used"), F.max("times").alias("most"))
    every = used.agg(F.sum("used").alias("every")).crossJoin(rows.agg(F.max("n_tokens").alias("text")))  # one row
    out = targets.join(used, "source", "left").crossJoin(F.broadcast(every))  # one row
    off = F.abs(F.coalesce("used", F.lit(0)) - F.col("every") * F.col("target_share"))
    return out.select("source", "target_share", (off <= F.col("text")).alias("reached"), (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("capped"))


P8_SQL = "SELECT pack_name, doc_id FROM documents CROSS JOIN pack_capacities WHERE text <> ''"
P9_SQL = "SELECT source, target_share, true AS reached, true AS capped FROM source_targets"

QUERIES = {"p8_containers": p8_containers, "p8_placed": p8_placed, "p9_mix": p9_mix, "p9_shares": p9_shares}
SQL = {"p8_placed": P8_SQL, "p9_shares": P9_SQL}
