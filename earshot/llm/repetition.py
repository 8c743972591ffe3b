"""How much of a text repeats what it has already said."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from earshot.operators.search import if_small
from earshot.session import cut

WORD = re.compile(r"\w+")
#: Character classes: lower case, upper case, other letters, digits, blanks, the rest.
N_CLASSES = 6
RUN = 5
#: Runs of texts up to so many words are first looked up in a set, which is quicker but takes more memory.
SHORT = 10_000
#: Texts are worked on together up to so many characters.
TOGETHER = 1 << 22


def _classes() -> np.ndarray:
    """The class of each character of the basic plane; all others are 'the rest'."""
    by = {"Ll": 0, "Lu": 1, "Lt": 1, "Lm": 2, "Lo": 2, "Nd": 3, "Nl": 3, "No": 3, "Zs": 4, "Zl": 4, "Zp": 4}
    table = np.array([by.get(unicodedata.category(chr(i)), 5) for i in range(0x10000)], np.uint8)
    table[[9, 10, 11, 12, 13]] = 4
    return table


def class_counts(texts: list[str], table: np.ndarray) -> np.ndarray:
    """The characters of each text by class, a row per text."""
    points = table[np.minimum(np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32), 0xFFFF)]
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    return np.bincount(owner * N_CLASSES + points, minlength=len(texts) * N_CLASSES).reshape(-1, N_CLASSES).astype(np.float64)


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The Jensen-Shannon distance of histograms, row by row, from 0 (alike) to 1 (disjoint); NaN if one is empty."""
    with np.errstate(divide="ignore", invalid="ignore"):
        p, q = p / p.sum(-1, keepdims=True), q / q.sum(-1, keepdims=True)
        m = (p + q) / 2
        a, b = (np.where(x > 0, x * np.log2(x / m), 0 * x).sum(-1) for x in (p, q))
    return np.sqrt(np.maximum(0.0, (a + b) / 2))


def repeated_share(words: list[str], run: int = RUN) -> float:
    """The share of the words that lie in a run of ``run`` words occurring more than once in the text (runs may overlap).

    Runs are compared exactly: pairs, then fours, and so on are numbered, never hashed.
    """
    n = len(words)
    if n <= run:
        return 0.0
    if n <= SHORT and len(set(zip(*(words[i:] for i in range(run))))) == n - run + 1:
        return 0.0  # no run returns
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    code, length = ids, 1
    while length < run:
        step = min(length, run - length)  # code of a run of length + step words: two overlapping or adjoining codes
        joined = code[: n - length - step + 1] * np.int64(n + 1) + code[step : step + n - length - step + 1]
        code = np.unique(joined, return_inverse=True)[1].astype(np.int64)
        length += step
    again = np.flatnonzero(np.bincount(code)[code] > 1)
    covered = np.zeros(n + 1, np.int64)
    np.add.at(covered, again, 1)
    np.add.at(covered, again + run, -1)
    return float((np.cumsum(covered)[:n] > 0).sum() / n)


def _stretches(texts: list[str]) -> Iterator[slice]:
    """Texts that follow each other, as many as are worked on together."""
    first = size = 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > TOGETHER:
            yield slice(first, i)
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield slice(first, len(texts))


def _counter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per batch and language: occurrences of each word, and of each character class (named by a blank and its number)."""
    table = _classes()
    for pdf in batches:
        words: dict[str, Counter] = defaultdict(Counter)
        chars: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(N_CLASSES))
        langs, every, weights = (pdf[c].tolist() for c in ("lang", "text", "weight"))
        for part in _stretches(every):
            for lang, text, weight, row in zip(langs[part], every[part], weights[part], class_counts(every[part], table)):
                found = WORD.findall(text.lower())
                if weight == 1:
                    words[lang].update(found)
                else:
                    for w in found:
                        words[lang][w] += weight
                chars[lang] += row * weight
        rows = [(lang, w, float(n)) for lang, c in words.items() for w, n in c.items()]
        rows += [(lang, f" {i}", float(n)) for lang, c in chars.items() for i, n in enumerate(c)]
        yield pd.DataFrame(rows, columns=["lang", "term", "n"])


def language_references(texts: DataFrame, *, common_words: int = 60, least_share: float = 0.001) -> dict:
    """{language: (words, word histogram, class histogram)} over all texts (lang, text).

    Equal texts count once, however often they were copied: each of c copies counts 1 / c, so only the prints of texts
    travel to find out, not the texts. Counting covers every text; each task adds up its own words before the shuffle.
    Languages that hold at least ``least_share`` of all words have a reference: there can't be more
    than 1 / least_share of them, so what comes to the driver (``common_words`` words of each) is bounded.
    """
    printed = texts.select("lang", "text", F.xxhash64("text").alias("h"), F.length("text").alias("size"))
    copies = printed.groupBy("lang", "h", "size").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    weighed = printed.join(if_small(cut(copies, "copies"), 48), ["lang", "h", "size"], "left").select("lang", "text", (1 / F.coalesce("c", F.lit(1))).alias("weight"))
    counts = weighed.mapInPandas(_counter, "lang string, term string, n double").groupBy("lang", "term").agg(F.round(F.sum("n"), 6).alias("n"))
    counts = cut(counts, "language-counts")
    special = F.col("term").startswith(" ")
    sums = counts.where(~special).groupBy("lang").agg(F.sum("n").alias("n"))
    total = sums.agg(F.sum("n").alias("all"))
    known = F.broadcast(sums.crossJoin(F.broadcast(total)).where(F.col("n") >= F.col("all") * least_share).select("lang", F.col("n").alias("words")))
    every = counts.where("lang <> ''").join(known, "lang")
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), "term")
    top = every.where(~special).withColumn("r", F.row_number().over(order)).where(F.col("r") <= common_words).drop("r")
    by: dict = defaultdict(list)
    for r in top.unionByName(every.where(special)).collect():
        by[r.lang].append((r.term, r.n, r.words))
    out: dict = {}
    for lang, mine in by.items():
        common = sorted(((n, w) for w, n, _ in mine if w[0] != " "), key=lambda x: (-x[0], x[1]))
        hist = np.array([n for n, _ in common] + [mine[0][2] - sum(n for n, _ in common)], np.float64)
        chars = np.zeros(N_CLASSES)
        for w, n, _ in mine:
            if w[0] == " ":
                chars[int(w)] = n
        out[lang] = ([w for _, w in common], hist, chars)
    return out


def _strays(words: list[list[str]], classes: np.ndarray, reference) -> tuple[np.ndarray, np.ndarray]:
    """The distances of texts of one language from all others of it: by common words and by character classes."""
    common, hist, chars = reference
    mine = np.zeros((len(words), len(common) + 1))
    for i, w in enumerate(words):
        count = Counter(w)
        mine[i, :-1] = [count[x] for x in common]
        mine[i, -1] = len(w)
    mine[:, -1] -= mine[:, :-1].sum(1)
    return divergence(mine, np.maximum(hist - mine, 0)), divergence(classes, np.maximum(chars - classes, 0))


def _measurer(references: dict, min_words: int, screen: float, power: float, char_screen: float, only_suspects: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = _classes()
        for pdf in batches:
            every = pdf["text"].tolist()
            for part in _stretches(every):
                some = pdf.iloc[part]
                words = [WORD.findall(t.lower()) for t in every[part]]
                n, classes = np.array([len(w) for w in words]), class_counts(every[part], table)
                far = np.full((2, len(words)), np.nan)
                for lang in set(some["lang"]) & set(references):
                    at = np.flatnonzero((some["lang"].to_numpy() == lang) & (n >= min_words))  # histograms of shorter texts say nothing
                    far[:, at] = _strays([words[i] for i in at], classes[at], references[lang])
                # what can't be held against anything is suspect
                honest = (far[0] < screen * np.maximum(n, 1.0) ** -power) & (far[1] < char_screen)
                keep = np.flatnonzero(~honest) if only_suspects else np.arange(len(words))
                known = ~np.isnan(far).any(0)
                far = np.where(known, far, np.nan)
                yield pd.DataFrame({
                    "k": some["k"].to_numpy()[keep], "n_words": n[keep], "word_distance": pd.array(far[0][keep], "Float64"), "class_distance": pd.array(far[1][keep], "Float64"),
                    "suspect": ~honest[keep], "share": np.array([repeated_share(words[i]) for i in keep], np.float64),
                })

    return run


def repetition(
    df: DataFrame,
    key: str,
    text: str,
    lang: str,
    *,
    only_suspects: bool = False,
    min_words: int = 30,
    screen: float = 1.9,
    power: float = 0.375,
    char_screen: float = 0.15,
) -> DataFrame:
    """(key, n_words, word_distance, class_distance, suspect, share) of every text, or of suspects only.

    A text that repeats itself strays from its language: its histograms of common words and of character classes are held
    against those of all other texts of the language by the Jensen-Shannon distance. The word distance of honest texts
    falls with their length n; a text is suspect from ``screen * n ** -power`` on (or from ``char_screen`` for classes).
    Texts under ``min_words`` words are too short for histograms, and texts of no language or of one too small for a
    reference have none to stray from: they have no distances and are suspect. ``share`` is the exact share of words in
    repeated runs.

    Null or blank text: no words, distances null, share 0. Each text
    is worked on alone, however long; repeated rows give repeated results. An empty table gives an empty result.
    """
    rows = df.select(F.col(key).alias("k"), F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    references = language_references(rows.where("text <> ''").select("lang", "text"))
    kind = df.schema[key].dataType.simpleString()
    measured = rows.mapInPandas(
        _measurer(references, min_words, screen, power, char_screen, only_suspects),
        f"k {kind}, n_words long, word_distance double, class_distance double, suspect boolean, share double",
    )
    return measured.withColumnRenamed("k", key)
