"""How good search results are, against labelled intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earshot.functions.text import label_reference, quote

CUTS = (1, 3, 5, 10)


def covers(h: str, label: str, tolerance: float) -> Column:
    """Whether an interval ``h`` overlaps an interval ``label`` of the same file, give or take the tolerance."""
    at = lambda t, c: F.col(f"{t}.{c}")
    return (
        (at(h, "file_id") == at(label, "file_id"))
        & (at(h, "start_sec") <= at(label, "end_sec") + tolerance)
        & (at(h, "end_sec") >= at(label, "start_sec") - tolerance)
    )


def labels_of(queries: DataFrame) -> DataFrame:
    """(query_id, n, file_id, start_sec, end_sec, grade, quote): one row per label."""
    return queries.select("query_id", F.posexplode("relevant").alias("n", "r")).select("query_id", "n", "r.*")


def covering_hits(hits: DataFrame, labels: DataFrame, *, tolerance: float = 5.0) -> DataFrame:
    """(query_id, n, hit_id, rank): each label with the hits that cover it."""
    near = (F.col("h.query_id") == F.col("l.query_id")) & covers("h", "l", tolerance)
    return hits.alias("h").join(labels.alias("l"), near).select("l.query_id", "n", "hit_id", "rank")


def of_split(queries: DataFrame, split: str = "all") -> DataFrame:
    """The labelled queries of one split, or all of them."""
    return queries if split == "all" else queries.where(F.col("split") == split)


def scores(queries: DataFrame, hits: DataFrame, *, tolerance: float = 5.0, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """One row for all queries (category 'ALL') and one per category: counters and ratios, null where nothing is to divide.

    match_p and related_p are the shares of confident and of related hits that cover a label; recall_k counts the labels
    covered by the first k hits, best_k how many could have been; mrr is the mean reciprocal rank of the first hit that
    covers a label.
    """
    labels = labels_of(queries)
    pairs = covering_hits(hits, labels, tolerance=tolerance)
    good = pairs.select("query_id", "hit_id").distinct().withColumn("ok", F.lit(1))
    per_hit = hits.join(good, ["query_id", "hit_id"], "left").groupBy("query_id").agg(
        *[F.sum(F.when(F.col("related") == r, 1).otherwise(0)).alias(n) for r, n in ((False, "n_match"), (True, "n_related"))],
        *[F.sum(F.when((F.col("related") == r) & F.col("ok").isNotNull(), 1).otherwise(0)).alias(n) for r, n in ((False, "ok_match"), (True, "ok_related"))],
        F.min(F.when(F.col("ok").isNotNull(), F.col("rank"))).alias("first"),
    )
    per_label = pairs.groupBy("query_id", "n").agg(F.min("rank").alias("at")).groupBy("query_id").agg(
        *[F.sum(F.when(F.col("at") <= k, 1).otherwise(0)).alias(f"found_{k}") for k in cuts]
    )
    n = F.size(F.coalesce("relevant", F.array()))
    per_query = queries.select("query_id", "category", n.alias("labels"), *[F.least(F.lit(k), n).alias(f"best_{k}") for k in cuts])
    rows = per_query.join(per_hit, "query_id", "left").join(per_label, "query_id", "left")
    counters = ["n_match", "n_related", "ok_match", "ok_related", "labels", *[f"{x}_{k}" for k in cuts for x in ("found", "best")]]
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in counters]
    reciprocal = F.sum(F.coalesce(F.try_divide(F.lit(1.0), F.col("first").cast("double")), F.lit(0.0)))
    by = rows.withColumn("category", F.coalesce("category", F.lit("none"))).rollup("category").agg(F.count(F.lit(1)).alias("queries"), reciprocal.alias("rr"), *sums)
    ratio = lambda a, b: F.round(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), 6)
    return by.select(
        F.coalesce("category", F.lit("ALL")).alias("category"),
        "queries",
        *counters,
        ratio("ok_match", "n_match").alias("match_p"),
        ratio("ok_related", "n_related").alias("related_p"),
        *[ratio(f"found_{k}", "labels").alias(f"recall_{k}") for k in cuts],
        *[ratio(f"best_{k}", "labels").alias(f"best_recall_{k}") for k in cuts],
        ratio("rr", "queries").alias("mrr"),
    )


def merge_close(labels: DataFrame, *, gap_sec: float = 10.0, longest: int = 240) -> DataFrame:
    """Labels (query_id, file_id, start_sec, end_sec, grade, quote) of a query less than ``gap_sec`` apart as one.

    The end and the grade are the largest, the quotes are joined by ' [...] ' and cut to ``longest`` characters.
    """
    order = Window.partitionBy("query_id", "file_id").orderBy("start_sec", "end_sec", "quote")
    reach = F.max("end_sec").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = labels.withColumn("__new", F.when(F.col("start_sec") - reach < gap_sec, 0).otherwise(1))
    rows = rows.withColumn("__run", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    quotes = F.transform(F.array_sort(F.collect_list(F.struct("start_sec", "end_sec", "quote"))), lambda x: x["quote"])
    merged = rows.groupBy("query_id", "file_id", "__run").agg(
        F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec"), F.max("grade").alias("grade"),
        F.array_join(quotes, " [...] ").alias("quote"), F.count(F.lit(1)).alias("__n"),
    )
    cut = F.when(F.col("__n") > 1, F.substring("quote", 1, longest)).otherwise(F.col("quote"))
    return merged.withColumn("quote", cut).drop("__run", "__n")


def resolve_labels(refs: DataFrame, utterances: DataFrame, *, digits: int = 2) -> DataFrame:
    """(query_id, ref, file_id, start_sec, end_sec, grade, quote, error) of references 'file:a-b@grade' (query_id, ref).

    Times are rounded to ``digits`` places; ``error`` says what is wrong with a reference that can't be resolved: another form,
    or utterances out of bounds.
    """
    rows = refs.select("query_id", "ref", label_reference(F.col("ref")).alias("r"))
    u = utterances.select(F.col("file_id").alias("f"), "idx", "start_sec", "end_sec", "text")
    inside = (F.col("f") == F.col("r.file")) & (F.col("idx") >= F.col("r.a")) & (F.col("idx") <= F.col("r.b"))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]), " ")
    got = rows.join(u, inside, "left").groupBy("query_id", "ref", "r").agg(
        F.count("idx").alias("n"), F.min_by("start_sec", "idx").alias("s"), F.max_by("end_sec", "idx").alias("e"), said.alias("q")
    )
    whole = F.col("n") == F.col("r.b") - F.col("r.a") + 1
    error = F.when(F.col("r").isNull(), "bad reference").when(~whole, "utterance range out of bounds")
    return got.select(
        "query_id", "ref", F.col("r.file").alias("file_id"), F.round("s", digits).alias("start_sec"), F.round("e", digits).alias("end_sec"),
        F.col("r.grade").alias("grade"), quote(F.col("q")).alias("quote"), error.alias("error"),
    )


def keep_frozen(new: DataFrame, frozen: DataFrame) -> DataFrame:
    """``new`` (query_id, ..., relevant) with the labels of ``frozen`` (query_id, relevant) where a query has any there."""
    old = frozen.select("query_id", F.col("relevant").alias("__old"), F.lit(True).alias("__is"))
    rows = new.join(old, "query_id", "left")
    return rows.withColumn("relevant", F.when(F.col("__is"), F.col("__old")).otherwise(F.col("relevant"))).drop("__old", "__is")
