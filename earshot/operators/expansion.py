"""Spoken words that a query word may stand for: neighbours in spelling and sound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earshot.operators.search import if_small
from earshot.session import cut


def trigrams(word: Column) -> Column:
    """The distinct groups of three characters of a word, with two blanks before it and one after."""
    padded = F.concat(F.lit("  "), word, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(word) + 1), lambda i: F.substring(padded, i, F.lit(3))))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams of two words."""
    both = F.size(F.array_intersect(trigrams(a), trigrams(b))).cast("double")
    return both / F.size(F.array_union(trigrams(a), trigrams(b)))


def shared_run(tok: Column, term: Column) -> Column:
    """The length of the longest common run of characters, as a share of ``tok``."""
    n = F.length(tok)
    holds = lambda size: F.exists(
        F.sequence(F.lit(1), n - size + 1), lambda i: F.contains(term, F.substring(tok, i, size))
    )
    lengths = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), holds)
    return F.coalesce(F.array_max(lengths), F.lit(0)).cast("double") / n


def policies(words: DataFrame, vocabulary: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(tok, policy) for query words (tok) that are looked up more widely.

    A word of at least four letters that nobody has spoken is 'open' to any neighbour, or 'strict' (same sound only) if the
    ``lexicon`` (term) knows it as common; a word spoken in at most two passages that the lexicon doesn't know is 'strict'.
    """
    w = words.select("tok").distinct().where((F.length("tok") >= 4) & F.col("tok").rlike("^[a-z]+$"))
    v = vocabulary.select(F.col("term").alias("tok"), F.col("df").alias("__df"))
    known = lexicon.select(F.col("term").alias("tok"), F.lit(True).alias("__known")).distinct()
    rows = w.join(v, "tok", "left").join(known, "tok", "left")
    common = F.coalesce("__known", F.lit(False))
    policy = (
        F.when(F.col("__df").isNull(), F.when(common, "strict").otherwise("open"))
        .when((F.col("__df") <= 2) & ~common, "strict")
    )
    return rows.select("tok", policy.alias("policy")).where("policy is not null")


def neighbours(words: DataFrame, vocabulary: DataFrame, *, least_similar: float = 0.3) -> DataFrame:
    """(tok, term, trgm, lev, mph, dm): spoken words near each query word, itself excluded.

    ``words`` (tok, metaphone, dmetaphone, dmetaphone_alt), ``vocabulary`` (term, df and the same codes). A word is near if
    its trigrams are similar enough, a code is equal, or it contains the query word but for its last letter. Instead of
    comparing every pair, each of these is a join on equal keys: equal codes, and shared trigrams, whose number gives the
    similarity. Words too short or too long to be similar are dropped in that join, unless they contain the query word.
    """
    w = words.select("tok", F.col("metaphone").alias("qm"), F.col("dmetaphone").alias("qd"), F.col("dmetaphone_alt").alias("qa"))
    w = if_small(cut(w, "looked-up"), 96)
    grams = lambda c, n: (F.col(c), F.size(trigrams(F.col(c))).alias(n), F.explode(trigrams(F.col(c))).alias("g"))
    inside = (F.length("tok") >= 5) & F.contains(F.col("term"), F.expr("left(tok, length(tok) - 1)"))
    alike = (F.col("nv") >= F.col("nq") * least_similar) & (F.col("nq") >= F.col("nv") * least_similar)
    shared = w.select(*grams("tok", "nq")).join(vocabulary.select(*grams("term", "nv")), "g").where((alike | inside) & (F.col("tok") != F.col("term")))
    shared = shared.groupBy("tok", "term", "nq", "nv").agg(F.count(F.lit(1)).cast("double").alias("both"))
    shared = shared.select("tok", "term", (F.col("both") / (F.col("nq") + F.col("nv") - F.col("both"))).alias("trgm")).where((F.col("trgm") >= least_similar) | inside)
    by_sound = w.join(vocabulary, F.col("qm") == F.col("metaphone")).select("tok", "term")
    by_double = w.join(vocabulary, F.col("qd") == F.col("dmetaphone")).select("tok", "term")
    heard = by_sound.unionByName(by_double).where("tok <> term").distinct().withColumn("trgm", similarity(F.col("term"), F.col("tok")))
    pairs = shared.unionByName(heard).groupBy("tok", "term").agg(F.max("trgm").alias("trgm"))
    rows = pairs.join(w, "tok").join(vocabulary, "term")
    mph = F.col("metaphone") == F.col("qm")
    two = lambda q: (F.col(q) == F.col("dmetaphone")) | (F.col(q) == F.col("dmetaphone_alt"))
    return rows.select("tok", "term", "trgm", F.levenshtein("term", "tok").alias("lev"), mph.alias("mph"), (two("qd") | two("qa")).alias("dm"))


def expansions(near: DataFrame, policy: DataFrame, *, most: int = 3) -> DataFrame:
    """(tok, term, score, place): the best ``most`` neighbours of each word that its policy accepts.

    The score is the closer of trigram and edit similarity, lifted to 0.70 where one word contains nearly all of the
    other, then raised for an equal sound. 'open' words take scores from 0.62, 'strict' ones the same sound from 0.80.
    """
    longest = F.greatest(F.length("tok"), F.length("term"))
    spelling = F.greatest(F.col("trgm"), 1 - F.col("lev") / longest)
    inside = (F.length("tok") >= 5) & (shared_run(F.col("tok"), F.col("term")) >= 0.85)
    spelling = F.when(inside, F.greatest(spelling, F.lit(0.70))).otherwise(spelling)
    alike = F.least(F.lit(1.0), F.greatest(F.col("ortho"), F.lit(0.55)) + 0.25)
    score = F.when(F.col("mph"), alike).when(F.col("dm"), F.least(F.lit(1.0), F.col("ortho") + 0.12)).otherwise(F.col("ortho"))
    rows = near.where(~(F.col("dm") & ~F.col("mph") & (F.col("trgm") < 0.25))).withColumn("ortho", spelling)
    rows = rows.withColumn("exact", score).join(policy, "tok")
    fine = F.when(F.col("policy") == "open", F.col("exact") >= 0.62).otherwise(F.col("mph") & (F.col("exact") >= 0.80))
    rows = rows.where(fine).withColumn("score", F.round("exact", 3))
    order = Window.partitionBy("tok").orderBy(F.col("score").desc(), "term")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("tok", "term", "score", "place")


def stand_ins(expanded: DataFrame, stems: DataFrame, seen: DataFrame, *, weight: float = 0.9) -> DataFrame:
    """(query_id, lexeme, w, unit): lexemes that stand in for a query word's own at ``weight`` times their score.

    ``expanded`` (query_id, tok, term, score, place), ``stems`` (term, lexeme), ``seen`` (query_id, lexeme). A lexeme that
    the query has already, or that an earlier expansion gave, is left out.
    """
    own = stems.select(F.col("term").alias("tok"), F.col("lexeme").alias("own"))
    rows = expanded.join(stems, "term").join(own, "tok", "left")
    rows = rows.select("query_id", "lexeme", (F.col("score") * weight).alias("w"), F.coalesce("own", "tok").alias("unit"), "tok", "place")
    rows = rows.join(seen, ["query_id", "lexeme"], "left_anti")
    first = Window.partitionBy("query_id", "lexeme").orderBy("tok", "place")
    return rows.withColumn("r", F.row_number().over(first)).where("r = 1").select("query_id", "lexeme", "w", "unit")
