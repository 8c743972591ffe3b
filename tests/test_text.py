"""Column functions against plain Python on generated data."""

import random
import re
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from earshot.functions import queries as q
from earshot.functions import text as t
from earshot.functions.phonetics import double_metaphone, metaphone, stem
from earshot.operators import expansion, library, moments, search


def each(spark, column, values, kind="string"):
    """The column function of every value, in order."""
    df = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    return [r.v for r in df.select("i", column(F.col("x")).alias("v")).orderBy("i").collect()]


def strings(seed, n, parts):
    rng = random.Random(seed)
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(n)]


def plain_tokens(s):
    s = s.lower().replace("’", "'")
    return re.findall("[a-z0-9]+", re.sub(r"'s(?!\w)", "", s).replace("'", ""))


def test_tokens_equal_the_plain_rule(spark):
    texts = [*strings(1, 400, ["'s", "'", "’s", "’", " ", "-", "Ab", "x9", "s", "É", "ñ", ".", "the", "really", "77", "_"]), "", " "]
    assert each(spark, t.tokens, texts) == [plain_tokens(x) for x in texts]
    want = [[w for w in plain_tokens(x) if len(w) > 2 and w not in t.STOP_WORDS and not w.isdigit()] for x in texts]
    assert each(spark, lambda c: t.content_tokens(t.tokens(c)), texts) == want
    assert each(spark, t.tokens, [None]) == [None]
    counted = each(spark, lambda c: t.counted_tokens(t.tokens(c)), texts[:50])
    assert [[(x.term, x.first) for x in r] for r in counted] == [[(w, 0) for w in plain_tokens(x)] + [(w, 1) for w in dict.fromkeys(plain_tokens(x))] for x in texts[:50]]


def test_minutes_are_rounded_before_they_are_split(spark):
    rng = random.Random(2)
    values = [rng.randrange(0, 720_000) / 100 for _ in range(200)] + [119.99, 3599.96, None]

    def want(x):
        tenths = int((Decimal(str(x)) * 10).quantize(Decimal(1), ROUND_HALF_UP))
        return f"{tenths // 600:02d}:{tenths % 600 // 10:02d}.{tenths % 10}"

    assert each(spark, t.minutes, values, "double") == [None if x is None else want(x) for x in values]


def test_sentence_ends(spark):
    closers = ["", '"', "')", "]", '")]']
    ends = [w + e + c for w in ("rain", "X1", "é") for e in ".?!" for c in closers]
    opens = [*t.ABBREVIATIONS, *map(str.upper, t.ABBREVIATIONS), *(".".join(x) + "." for x in ("ab", "xyz")), "rain", "rain,", "rain.x", "", None]
    assert each(spark, t.ends_sentence, ends) == [True] * len(ends)
    assert each(spark, t.ends_sentence, opens) == [False] * len(opens)
    asks = ["so?", "so?  ", "so? no", "", None]
    assert each(spark, t.is_question, asks) == [True, True, False, False, False]


def test_slugs_and_new_ids_agree(spark):
    names = [x + e for x in strings(3, 150, ["A", "z", "7", " ", "__", "-", "ü", "/", "..", "(2)", "longer_piece_"]) for e in (".wav", ".tar.gz")]
    slugs = each(spark, t.file_slug, names)
    assert all(re.fullmatch("[a-z0-9]+(_[a-z0-9]+)*_?", s) and len(s) <= 48 for s in slugs)
    taken = set()
    for n in ["one two.wav"] * 4:
        taken.add(library.new_file_id(n, taken))
    assert taken == {"one_two", "one_two_2", "one_two_3", "one_two_4"}
    assert library.new_file_id("///???.wav", ()) == each(spark, t.file_slug, ["///???.wav"])[0]


def test_label_references_are_read_back(spark):
    rng = random.Random(4)
    parts = [(f"rec_{rng.randrange(99)}", a := rng.randrange(500), a + rng.randrange(1, 9), rng.choice([1, 2])) for _ in range(40)]
    refs = [f"{f}:{a}-{b}@{g}" for f, a, b, g in parts] + [f"{f}:{a}" for f, a, _, _ in parts]
    assert [tuple(x) for x in each(spark, t.label_reference, refs)] == parts + [(f, a, a, 2) for f, a, _, _ in parts]
    assert each(spark, t.label_reference, ["Up:1", "x:1@3", "x:-2", "x", "", None]) == [None] * 6
    quotes = ["y" * n for n in (0, 239, 240, 241, 600)]
    assert [len(x) for x in each(spark, t.quote, quotes)] == [0, 239, 240, 240, 240]


def test_overlap_counts_shared_steps(spark):
    rng = random.Random(5)
    rows = [(a := rng.randrange(30), a + rng.randrange(1, 20), b := rng.randrange(30), b + rng.randrange(1, 20)) for _ in range(100)]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "i int, a0 double, a1 double, b0 double, b1 double")
    got = [r.v for r in df.select("i", t.overlap(*map(F.col, ("a0", "a1", "b0", "b1"))).alias("v")).orderBy("i").collect()]
    want = [len(set(range(a, b)) & set(range(c, d))) / min(b - a, d - c) for a, b, c, d in rows]
    assert got == pytest.approx(want)


def test_queries_are_taken_apart_as_they_were_put_together(spark):
    rng = random.Random(6)
    vocabulary = ["copper", "lantern", "ridge", "kiln", "the", "of", "what", "explain", "42"]
    built = []
    for i in range(120):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 6))]
        phrase = " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 4))) if rng.random() < 0.3 else None
        role = rng.choice([None, None, "host", "guest"])
        raw = "  ".join(words) + (f' "{phrase}"' if phrase else "") + ("?" if rng.random() < 0.2 else "")
        raw = f"ROLE:{role.upper()} {raw}" if role and i % 2 else raw + (f" role:{role}" if role else "")
        built.append((raw, words, phrase, role, rng.choice([None, None, "guest"])))
    df = spark.createDataFrame([(i, b[0], b[4]) for i, b in enumerate(built)], "i int, s string, r string")
    rows = df.select("i", *[c.alias(n) for n, c in q.parsed(F.col("s"), F.col("r")).items()])
    rows = rows.select("*", q.intent(*map(F.col, ("text", "phrases", "toks", "content"))).alias("intent")).orderBy("i").collect()
    for r, (raw, words, phrase, role, given) in zip(rows, built):
        toks = plain_tokens(" ".join(words) + " " + (phrase or ""))
        assert r.toks == toks and r.phrases == ([phrase] if phrase else []) and r.role == (given or role)
        assert '"' not in r.text and "  " not in r.text and "role" not in r.text.lower()
        content = [w for w in toks if len(w) > 2 and w not in t.STOP_WORDS and not w.isdigit()]
        asks = r.text.endswith("?") or toks[0] in q.QUESTION_WORDS
        want = "phrase" if phrase else "question" if asks else "keyword" if len(content) <= 2 and len(toks) <= 3 else "topic"
        assert r.intent == want and r.content == content
    empty = spark.createDataFrame([(None,)], "s string").select(*[c.alias(n) for n, c in q.parsed(F.col("s")).items()]).first()
    assert empty.text == "" and empty.phrases == [] and empty.toks == []
    asked = each(spark, lambda c: q.encoder_input(c, is_query=True), ["kiln"])
    assert asked == [q.QUERY_PREFIX + "kiln"] and each(spark, lambda c: q.encoder_input(c, is_query=False), ["kiln"]) == ["kiln"]


def test_phrases_stand_side_by_side(spark):
    rng = random.Random(7)
    pairs = [([rng.choice(["a", "ab", "b"]) for _ in range(8)], [rng.choice(["a", "ab", "b"]) for _ in range(rng.randrange(4))]) for _ in range(150)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<string>, b array<string>")
    got = [r.v for r in df.select("i", search.contains_phrase(F.col("a"), F.col("b")).alias("v")).orderBy("i").collect()]
    assert got == [bool(b) and any(a[k : k + len(b)] == b for k in range(len(a))) for a, b in pairs]


def test_phrases_of_stems_keep_the_gaps_of_stop_words(spark):
    from earshot.operators import index
    from earshot.plans import search as plan

    rng = random.Random(8)
    words = ["rod", "rods", "fuel", "of", "the", "fueling", "tower"]
    texts = {f"p{i}": [rng.choice(words) for _ in range(12)] for i in range(60)}
    asks = {f"q{i}": [[rng.choice(words) for _ in range(rng.randrange(1, 4))] for _ in range(rng.choice([1, 1, 2]))] for i in range(40)} | {"stop": [["of", "the"]]}
    p = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "id string, text string")
    post, _ = index.positional_postings(p, t.SEARCH_STOP_WORDS, plan.stemmed)
    asked = spark.createDataFrame([(i, [" ".join(x) for x in xs]) for i, xs in asks.items()], "query_id string, phrases array<string>")
    _, got = plan._phrases({"postings": post}, asked)

    def holds(text, phrase):
        want = [(k, stem(w)) for k, w in enumerate(phrase) if w not in t.SEARCH_STOP_WORDS]
        at = lambda i: stem(text[i]) if 0 <= i < len(text) and text[i] not in t.SEARCH_STOP_WORDS else None
        return bool(want) and any(all(at(b + k) == s for k, s in want) for b in range(-3, len(text)))

    want = {(i, d) for i, xs in asks.items() for d, text in texts.items() if all(holds(text, x) for x in xs)}
    assert {(r.query_id, r.id) for r in got.collect()} == want and want


def test_stems_and_sounds():
    # from the published sample vocabulary of the stemmer
    sample = """consign consign, consigned consign, consigning consign, consignment consign, consist consist, consisted consist, consistency consist,
    consistent consist, consistently consist, consolation consol, console consol, consoling consol, knack knack, knackeries knackeri, knaves knave,
    knavish knavish, kneaded knead, kneel kneel, knees knee, knightly knight, knitting knit, knots knot"""
    for pair in sample.split(","):
        word, want = pair.split()
        assert stem(word) == want
    for a, b in (("ph", "f"), ("kn", "n"), ("wr", "r"), ("gn", "n")):
        for rest in ("otal", "imer", "ester", "ovel"):
            assert metaphone(a + rest) == metaphone(b + rest)
    assert double_metaphone("Schmidt") == ("XMT", "SMT")
    assert metaphone("") == "" and double_metaphone("7") == ("", "") and stem("ab") == "ab"
    rng = random.Random(9)
    for _ in range(500):  # anything may be spoken
        w = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(1, 14)))
        assert stem(w) and len(metaphone(w)) <= 12 and all(len(c) <= 4 for c in double_metaphone(w))


def test_spelling_measures_equal_the_plain_rules(spark):
    rng = random.Random(10)
    pairs = [("".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))), "".join(rng.choice("abc") for _ in range(rng.randrange(1, 9)))) for _ in range(120)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    rows = df.select("i", expansion.shared_run(F.col("a"), F.col("b")).alias("run"), expansion.similarity(F.col("a"), F.col("b")).alias("sim")).orderBy("i").collect()
    grams = lambda w: {f"  {w} "[k : k + 3] for k in range(len(w) + 1)}
    for r, (a, b) in zip(rows, pairs):
        longest = max((n for n in range(1, len(a) + 1) for k in range(len(a) - n + 1) if a[k : k + n] in b), default=0)
        assert r.run == pytest.approx(longest / len(a)) and r.sim == pytest.approx(len(grams(a) & grams(b)) / len(grams(a) | grams(b)))


def test_highlights_and_match_time(spark):
    rng = random.Random(11)
    rows = []
    for i in range(60):
        said = [rng.choice(["(", "", "“"]) + rng.choice(["clay", "glaze", "Kiln", "the", "..."]) + rng.choice(["", ",", "!)", "."]) for _ in range(rng.randrange(6))]
        rows.append((i, [(w, 2.0 * k, 2.0 * k + 1) for k, w in enumerate(said)], rng.sample(["clay", "kiln", "the"], rng.randrange(3)), -1.0))
    df = spark.createDataFrame(rows, "i int, w array<struct<tok:string,start_sec:double,end_sec:double>>, q array<string>, s double")
    spans = moments.highlights(F.col("w"), F.col("q"), t.tokens)
    got = df.select("i", spans.alias("h"), moments.match_time(F.col("w"), spans, F.col("s")).alias("m")).orderBy("i").collect()
    for r, (_, ws, wanted, start) in zip(got, rows):
        text, want, at = " ".join(w for w, *_ in ws), [], 0
        for k, (w, a, _) in enumerate(ws):
            core = re.search(r"[^\W_]+", w)
            if core and core[0].lower() in wanted:
                want.append((at + core.start(), at + core.end(), a))
            at += len(w) + 1
        assert [tuple(x) for x in r.h] == [x[:2] for x in want] and r.m == (want[0][2] if want else start)
        assert all(text[a:b].lower() in wanted for a, b in r.h)


def test_marks_become_spans(spark):
    rng = random.Random(12)
    marked, want = [], []
    for _ in range(60):
        line, spans, at = "", [], 0
        for _ in range(rng.randrange(6)):
            piece = "x" * rng.randrange(4)
            inside = rng.random() < 0.5
            line += f"\x02{piece}\x03" if inside else piece
            spans += [(at, at + len(piece))] if inside and piece else []
            at += len(piece)
        marked.append(line)
        want.append(spans)
    assert [[tuple(x) for x in r] for r in each(spark, moments.spans_of_marks, marked)] == want


def test_functions_can_be_called_from_sql(spark):
    from earshot.functions.registered import register

    assert len(register(spark)) == 4
    r = spark.sql("SELECT english_stem('knitting') AS a, metaphone('knots') AS b, dmetaphone('Schmidt') AS c, dmetaphone_alt('Schmidt') AS d, english_stem(NULL) AS e").first()
    assert tuple(r) == (stem("knitting"), metaphone("knots"), *double_metaphone("Schmidt"), None)
