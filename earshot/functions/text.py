"""Tokens of a text, as column expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9; a typographic apostrophe counts as ', a possessive 's is dropped, other ' are removed.

    Null stays null, a text without such characters gives an empty array.
    """
    flat = F.replace(F.lower(text), F.lit("’"), F.lit("'"))
    flat = F.regexp_replace(flat, r"'s(?![\p{L}\p{N}_])", "")
    return F.regexp_extract_all(F.replace(flat, F.lit("'"), F.lit("")), F.lit("([a-z0-9]+)"), F.lit(1))


#: Words that carry no meaning of their own.
STOP_WORDS = """
a about above after again against all am an and any are as at be because been before being
below between both but by can could did do does doing down during each few for from further had
has have having he her here hers herself him himself his how i if in into is it its itself just
let me more most my myself no nor not now of off on once only or other our ours ourselves out
over own same she should so some such than that the their theirs them themselves then there
these they this those through to too under until up very was we were what when where which
while who whom why will with would you your yours yourself yourselves also yeah okay oh um uh
like really got get gets going go know think thing things lot kind sort well right mean
actually
""".split()


#: The English stop words of full-text search, whose places in a text still count. As tokens, without apostrophes.
SEARCH_STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself
they them their theirs themselves what which who whom this that these those am is are was were be been being have has had
having do does did doing a an the and but if or because as until while of at by for with about against between into through
during before after above below to from up down in out on off over under again further then once here there when where why how
all any both each few more most other some such no nor not only own same so than too very s t can will just don should now
""".split()


def content_tokens(toks: Column) -> Column:
    """Of an array of tokens, those of at least 3 characters that are neither stop words nor bare numbers."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(toks, lambda t: (F.length(t) >= 3) & ~F.array_contains(stop, t) & ~t.rlike("^[0-9]+$"))


def counted_tokens(toks: Column) -> Column:
    """Array of (term, first): every token with ``first`` 0, and once more every distinct token with ``first`` 1.

    So one pass counts both occurrences and rows, without a shuffle by (row, term).
    """
    mark = lambda n: lambda t: F.struct(t.alias("term"), F.lit(n).cast("long").alias("first"))
    return F.concat(F.transform(toks, mark(0)), F.transform(F.array_distinct(toks), mark(1)))


def minutes(seconds: Column) -> Column:
    """Seconds as MM:SS.s, rounded to a tenth before the minutes are split off (59.96 is 01:00.0). Null stays null."""
    t = F.round(seconds.cast("double"), 1)
    whole = F.floor(t / 60).cast("int")
    return F.when(t.isNotNull(), F.format_string("%02d:%04.1f", whole, t - whole * 60))


def is_question(text: Column) -> Column:
    """Whether a text ends with a question mark, blanks aside. Null counts as no."""
    return F.coalesce(F.rtrim(text).endswith("?"), F.lit(False))


#: Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = """
dr. mr. mrs. ms. st. jr. sr. prof. vs. etc. e.g. i.e. u.s. u.k. a.m. p.m. no. approx. inc. co. lt. col. gen. sgt.
""".split()


def ends_sentence(word: Column) -> Column:
    """Whether a word ends a sentence: . ? or ! before closing quotes or brackets, abbreviations and initials apart."""
    low = F.lower(word)
    short = low.isin(ABBREVIATIONS) | low.rlike(r"^(?:[a-z]\.){2,}$")
    return F.coalesce(~short & word.rlike(r"""[.?!]["')\]]*$"""), F.lit(False))


def quote(text: Column, longest: int = 240) -> Column:
    """A text of at most ``longest`` characters; a longer one is cut and ends in '...'."""
    return F.when(F.length(text) > longest, F.concat(F.substring(text, 1, longest - 3), F.lit("..."))).otherwise(text)


def file_slug(name: Column) -> Column:
    """A safe id from a file's name: its stem, lower case, other characters than a-z and 0-9 as '_', 48 characters at most."""
    base = F.regexp_replace(F.regexp_replace(name, r"^.*/", ""), r"(?<=.)\.[^.]*$", "")
    base = F.regexp_replace(F.lower(base), "[^a-z0-9]+", "_")
    base = F.substring(F.regexp_replace(base, "^_+|_+$", ""), 1, 48)
    return F.when(base == "", "recording").otherwise(base)


def label_reference(ref: Column) -> Column:
    """Struct (file, a, b, grade) of 'file:a-b@grade'; b defaults to a, grade to 2. Null if it has another form."""
    # fixed format
    form = r"^([a-z0-9_]+):(\d+)(?:-(\d+))?(?:@([12]))?$"
    part = lambda i: F.regexp_extract(F.trim(ref), form, i)
    number = lambda c: F.when(c != "", c).cast("int")
    a = number(part(2))
    struct = F.struct(part(1).alias("file"), a.alias("a"), F.coalesce(number(part(3)), a).alias("b"), F.coalesce(number(part(4)), F.lit(2)).alias("grade"))
    return F.when(part(1) != "", struct)


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """The length two intervals share, as a share of the shorter one."""
    shared = F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))
    return shared / F.greatest(F.least(a1 - a0, b1 - b0), F.lit(1e-6))
