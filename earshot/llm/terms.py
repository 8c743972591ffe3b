"""Counts of every term, kept up by signed changes; and how characteristic a term is of a passage."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from earshot.functions.text import counted_tokens, tokens
from earshot.session import cut, owned
from earshot.sources.store import delete_folder, list_folder, read_file, replace_file

#: The row of a state that counts the records themselves; no token is empty.
RECORDS = ""
#: Into how many parts a new state is divided: a parameter, kept with the state.
BUCKETS = 32


def term_changes(changes: DataFrame, text: str = "text", sign: str = "sign", by: tuple[str, ...] = ()) -> DataFrame:
    """Changes of the counts: (*by, term, n_total, n_records), from records with ``sign`` +1 (added) or -1 (taken away).

    A changed record is its old text with -1 and its new one with +1. Only the records given are read. The row of the
    empty term counts records whose text is neither null nor empty. Every task adds up its own terms before the shuffle,
    so a term that occurs in every record costs one row per task. Terms whose changes cancel out are left out.
    """
    rows = changes.where(F.col(text).isNotNull() & (F.col(text) != "")).select(*by, tokens(F.col(text)).alias("t"), F.col(sign).alias("s"))
    itself = F.array(F.struct(F.lit(RECORDS).alias("term"), F.lit(1).cast("long").alias("first")))
    rows = rows.select(*by, F.col("s").cast("long").alias("s"), F.inline(F.concat(counted_tokens(F.col("t")), itself)))
    sums = rows.groupBy(*by, "term").agg(
        F.sum(F.col("s") * (1 - F.col("first"))).alias("n_total"), F.sum(F.col("s") * F.col("first")).alias("n_records")
    )
    return sums.where("n_total <> 0 or n_records <> 0")


class TermCounts:
    """Counts of all terms, kept in a folder: parts by a hash of the term, and a pointer file that says which files hold them.

    ``merge`` reads and replaces only the parts that a batch touches, then moves the pointer; until then readers see the
    old state, and a failed or repeated attempt leaves it as it was. A batch is merged once: its name is kept with the
    state, and a second call with that name changes nothing. There may be many readers but one writer. Terms whose counts
    fall to zero are dropped. ``vacuum`` deletes files that no part uses any more. Opening the folder again goes on with
    what is there. Without ``folder`` the state lives as long as the application.
    """

    SCHEMA = "term string, n_total long, n_records long"

    def __init__(self, spark: SparkSession, folder: str | None = None, *, buckets: int = BUCKETS):
        self.spark = spark
        self.folder = (folder or owned(spark, "terms")).rstrip("/")
        self.buckets = self._state()["buckets"] or buckets

    def _state(self) -> dict:
        text = read_file(self.spark, f"{self.folder}/CURRENT")
        return json.loads(text) if text else {"buckets": None, "parts": {}, "batches": []}

    def _read(self, parts: list[str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(*[f"{self.folder}/{p}" for p in parts])

    def read(self) -> DataFrame:
        """(term, n_total, n_records) of the current state."""
        return self._read(sorted(self._state()["parts"].values()))

    def merge(self, changes: DataFrame, batch: str | None = None) -> DataFrame:
        """Add the rows of ``term_changes`` to the counts, as the batch of that name; returns the new state."""
        state = self._state()
        if batch is not None and batch in state["batches"]:
            return self.read()
        bucket = F.pmod(F.hash("term"), F.lit(self.buckets)).alias("bucket")
        changes = cut(changes.select("term", "n_total", "n_records", bucket), "term-changes")
        touched = [r.bucket for r in changes.select("bucket").distinct().collect()]  # at most as many as there are parts
        old = self._read([state["parts"][str(b)] for b in touched if str(b) in state["parts"]])
        rows = old.select("term", "n_total", "n_records", bucket).unionByName(changes)
        # one task and one file per part
        rows = rows.repartition(self.buckets, "bucket").groupBy("bucket", "term").agg(F.sum("n_total").alias("n_total"), F.sum("n_records").alias("n_records"))
        version = f"v{uuid.uuid4().hex}"
        rows.where("n_total <> 0 or n_records <> 0").write.partitionBy("bucket").parquet(f"{self.folder}/{version}")
        written = list_folder(self.spark, f"{self.folder}/{version}")
        for b in touched:
            state["parts"].pop(str(b), None)
            if f"bucket={b}" in written:
                state["parts"][str(b)] = f"{version}/bucket={b}"
        state["buckets"] = self.buckets
        state["batches"] += [batch] if batch is not None else []
        replace_file(self.spark, f"{self.folder}/CURRENT", json.dumps(state))
        return self.read()

    def vacuum(self) -> int:
        """Delete the files that the current state doesn't use, once no reader is at an older one; returns how many folders went."""
        used, gone = set(self._state()["parts"].values()), 0
        for version in list_folder(self.spark, self.folder):
            if version.startswith("v"):
                mine = [f"{version}/{b}" for b in list_folder(self.spark, f"{self.folder}/{version}")]
                for part in [version] if not used & set(mine) else [p for p in mine if p not in used and "bucket=" in p]:
                    delete_folder(self.spark, f"{self.folder}/{part}")
                    gone += 1
        return gone


def marked_terms(state: DataFrame, *, rare: int = 2, common: float = 0.2) -> DataFrame:
    """(term, n_total, n_records, mark) of a state: 'rare' up to ``rare`` records, 'common' above the share, else 'useful'."""
    n = state.where(F.col("term") == RECORDS).agg(F.coalesce(F.sum("n_records"), F.lit(0)).alias("n"))
    mark = F.when(F.col("n_records") <= rare, "rare").when(F.col("n_records") > F.col("n") * F.lit(common), "common").otherwise("useful")
    terms = state.where(F.col("term") != RECORDS).crossJoin(F.broadcast(n))  # n is one row
    return terms.select("term", "n_total", "n_records", mark.alias("mark"))


def record_changes(feed: DataFrame, key: str, text: str, version: str, batch: Column, batches: int) -> DataFrame:
    """(batch, text, sign): a feed of record versions, which came in ``batches`` batches, as signed records.

    ``batch`` says in which one, from 0, a row came. In every batch that brings a record, what was known of it goes out
    with -1 and the latest version known by then comes in with +1. A record that comes again unchanged does both, and
    the two cancel; one whose text becomes null is deleted. Of equal versions the larger text wins, a null version is the
    oldest, null keys are left out. A row of no batch counts to batch 0.
    """
    arrived = F.coalesce(batch.cast("int"), F.lit(0))
    one = F.struct(F.col(version).alias("v"), F.col(text).alias("t"))
    kept = feed.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.max(F.when(arrived == i, one)).alias(f"b{i}") for i in range(batches)])
    signed, known = [], None
    row = lambda i, state, sign: F.struct(F.lit(i).alias("batch"), state["t"].alias("text"), F.lit(sign).alias("sign"))
    for i in range(batches):
        came = F.col(f"b{i}")
        now = came if known is None else F.greatest(known, came)
        if known is not None:
            signed.append(F.when(came.isNotNull() & known.isNotNull(), row(i, known, -1)))
        signed.append(F.when(came.isNotNull(), row(i, now, 1)))
        known = now
    return kept.select(F.inline(F.filter(F.array(*signed), lambda x: x.isNotNull())))


def term_counts(
    spark: SparkSession, feed: DataFrame, key: str, text: str, version: str, *, batch: Column | None = None, batches: int = 1, folder: str | None = None
) -> DataFrame:
    """The state of all term counts after a feed whose batches are merged one after the other."""
    signed = record_changes(feed, key, text, version, F.lit(0) if batch is None else batch, batches)
    changes = cut(term_changes(signed, by=("batch",)), "batch-changes")
    state = TermCounts(spark, folder)
    for i in range(batches):
        state.merge(changes.where(F.col("batch") == i), f"batch {i}")
    return state.read()


def distinctive_terms(
    records: DataFrame,
    key: str,
    text: str,
    *,
    wanted: DataFrame | None = None,
    prior: float = 5.0,
    continuity: float = 0.5,
    heavy_share: float = 0.0005,
) -> DataFrame:
    """(key, term, observed, expected, score) for every term of every record: how characteristic it is of that record.

    The score is the residual of correspondence analysis: observed minus expected count over the square root of the
    expectation, with the variance adjusted by what the row and the column margin leave over. The expectation comes from
    the margins over all records. Two corrections keep a word that was misspelt once from beating a rare word that
    returns: ``continuity`` is taken from the observed excess, as usual for counts, and ``prior`` occurrences are added to
    each column margin.

    ``records`` has one row per key. ``wanted`` (a column ``key``) limits the rows that are scored, never the margins.
    Null or empty texts have no terms and give no row; the order of equal scores is by term.

    Terms that hold at least ``heavy_share`` of all occurrences, of which there can't be more than 1 / heavy_share, are
    joined by broadcast; all others by their key. So no term is hot in the join.
    """
    rows = records.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), tokens(F.col(text)).alias("t"))
    margins = rows.select(F.explode("t").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("tj"))
    margins = cut(margins, "term-margins")
    total = margins.agg(F.coalesce(F.sum("tj"), F.lit(0)).cast("double").alias("n"), F.count(F.lit(1)).cast("double").alias("v"))
    if wanted is not None:
        rows = rows.join(wanted.select(F.col(key).alias("k")).distinct(), "k", "left_semi")
    cells = rows.select("k", F.size("t").cast("double").alias("ni"), F.explode("t").alias("term"))
    cells = cells.groupBy("k", "ni", "term").agg(F.count(F.lit(1)).cast("double").alias("o"))
    all_terms = margins.crossJoin(F.broadcast(total))  # one row
    is_heavy = F.col("tj") >= F.col("n") * heavy_share
    heavy = all_terms.where(is_heavy).select("term", F.col("tj").alias("htj"), F.col("n").alias("hn"), F.col("v").alias("hv"))
    marked = cells.join(F.broadcast(heavy), "term", "left")
    light = marked.where("htj is null").drop("htj", "hn", "hv").join(all_terms.where(~is_heavy), "term")
    heavy = marked.where("htj is not null").withColumnsRenamed({"htj": "tj", "hn": "n", "hv": "v"})
    cells = light.unionByName(heavy)
    mass = F.col("n") + F.lit(prior) * F.col("v")
    column = (F.col("tj") + F.lit(prior)) / mass
    row = F.col("ni") / F.col("n")
    expected = F.col("ni") * column
    excess = F.col("o") - expected
    excess = F.signum(excess) * F.greatest(F.abs(excess) - continuity, F.lit(0.0))
    variance = expected * F.greatest(1 - row, F.lit(1e-12)) * F.greatest(1 - column, F.lit(1e-12))
    return cells.select(
        F.col("k").alias(key), "term", F.col("o").cast("long").alias("observed"), expected.alias("expected"), (excess / F.sqrt(variance)).alias("score")
    )


def leading_terms(scores: DataFrame, key: str) -> DataFrame:
    """(key, term): the term of the highest score of each record, the first by name among equals."""
    by = Window.partitionBy(key).orderBy(F.col("score").desc(), F.col("term"))
    return scores.withColumn("r", F.row_number().over(by)).where("r = 1").select(key, "term")
