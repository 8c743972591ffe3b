"""The inverted index of a collection of passages, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.functions.text import content_tokens, tokens
from earshot.session import cut


def postings(passages: DataFrame, terms=tokens) -> DataFrame:
    """(id, lexeme, tf): how often each lexeme occurs in each passage. ``terms`` turns a text column into lexemes.

    Passages (id, text) of null or empty text have no postings.
    """
    return passages.select("id", F.explode(terms(F.col("text"))).alias("lexeme")).groupBy("id", "lexeme").agg(F.count(F.lit(1)).alias("tf"))


def positional_postings(passages: DataFrame, stop: list[str], stems) -> tuple[DataFrame, DataFrame]:
    """(id, lexeme, tf, places) and (lexeme, stem): the stems of each passage with their places, and the stem of every word.

    Words of ``stop`` are left out but keep their places, so a phrase knows how far apart its words are. ``stems`` turns a
    column of words into stems; it sees every distinct word once.
    """
    words = passages.select("id", F.posexplode(tokens(F.col("text"))).alias("at", "lexeme")).where(~F.col("lexeme").isin(stop))
    words = cut(words, "passage-words")  # few repeat within a passage, so they are gathered by stem alone
    table = words.select("lexeme").distinct()
    table = cut(table.select("lexeme", stems(F.col("lexeme")).alias("stem")), "stems")
    post = words.join(table, "lexeme").groupBy("id", F.col("stem").alias("lexeme")).agg(F.array_sort(F.collect_list("at")).alias("places"))
    return post.select("id", "lexeme", F.size("places").cast("long").alias("tf"), "places"), table


def doc_lengths(passages: DataFrame, post: DataFrame) -> DataFrame:
    """(id, doc_len): the number of lexemes of each passage, 0 for one without any."""
    sums = post.groupBy("id").agg(F.sum("tf").alias("n"))
    return passages.select("id").join(sums, "id", "left").select("id", F.coalesce("n", F.lit(0)).cast("long").alias("doc_len"))


def lexeme_frequencies(post: DataFrame) -> DataFrame:
    """(lexeme, df): the number of passages with each lexeme."""
    return post.groupBy("lexeme").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row (n, avg_len): passages and their mean length."""
    return lengths.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg(F.col("doc_len").cast("double")).alias("avg_len"))


def vocabulary(passages: DataFrame) -> DataFrame:
    """(term, df): the content words of all passages and the number of passages with them."""
    terms = passages.select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    # what a content word is depends on the word alone, so each is judged once; with df in it, the condition stays behind the count
    return terms.where(F.when(F.col("df") > 0, F.size(content_tokens(F.array("term")))) > 0)


def inverse_frequency(n, df):
    """ln(1 + (n - df + 0.5) / (df + 0.5)), all in doubles."""
    n, df = n.cast("double"), df.cast("double")
    return F.ln(1.0 + (n - df + 0.5) / (df + 0.5))
