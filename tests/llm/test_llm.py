import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from compare import duck_rows, plain
from earshot.llm import fusion, mixing, nearest, neighbours, packing, queries, repetition, terms, token_counts, turns

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_and_sql_agree(spark, name):
    con = duckdb.connect()
    for p in Path(FOLDER).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = queries.QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    names, want = duck_rows(con, queries.SQL[name])
    assert cols == names and Counter(tuple(plain(v) for v in r) for r in df.select(*cols).collect()) == want


# nearest in time

LEFT = "h long, file string, at double, idx2 string"
RIGHT = "file string, start double, idx int, at string"


def near(spark, left, right, **more):
    a, b = spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT)
    got = nearest.nearest_in_time(a, b, entity="file", left_time="at", right_time="start", right_id="idx", **more)
    return Counter((r.h, r.idx, r.distance_us) for r in got.collect())


def brute_near(left, right, tol=2_000_000):
    out = Counter()
    for h, f, t, _ in left:
        c = [(abs(round(s * 1e6) - round(t * 1e6)), i) for g, s, i, _ in right if None not in (f, t, s, i) and f == g and s == s and t == t]
        c = [x for x in c if x[0] <= tol]
        if c:
            out[h, min(c)[1], min(c)[0]] += 1
    return out


@pytest.mark.parametrize("first", [0.25, 2.0, 0.001])
def test_nearest_equals_brute_force(spark, first):
    rng = random.Random(1)
    left = [(i, rng.choice("ab"), round(rng.random() * 60, 2), "x") for i in range(150)]
    right = [(rng.choice("abc"), round(rng.random() * 60, 3), i, "y") for i in range(60)]
    left += [(900, "a", None, None), (901, None, 1.0, None), (902, "a", float("nan"), None), (903, "hot", 10.0, None), left[0]]
    right += [("a", None, 1, None), (None, 2.0, 2, None), ("a", 3.0, None, None), ("hot", 8.0, 7, None), ("hot", 12.0, 5, None), ("hot", 12.0, 6, None), right[0]]
    assert near(spark, left, right, first_ring_sec=first) == brute_near(left, right)


def test_nearest_of_nothing(spark):
    assert not near(spark, [], [("a", 1.0, 1, None)]) and not near(spark, [(1, "a", 1.0, None)], [])


# turns


def labelled(spark, utts, speakers):
    u = spark.createDataFrame(utts, "file_id string, idx int, speaker string, start_sec double, end_sec double, text string, words array<struct<tok:string,start_sec:double,end_sec:double>>, ingested_at timestamp")
    s = spark.createDataFrame(speakers, "file_id string, label string, role string, name string")
    return turns.with_turns(turns.labelled_utterances(u, s), shard_sec=7.0)


PEOPLE = [("f", "SPEAKER_00", "host", "Ann Lee"), ("f", "SPEAKER_01", "guest", "Bo Cy"), ("f", "SPEAKER_02", "guest", None), ("f", "SPEAKER_00", "host", "Ann Lee")]


def utt(i, who, text, at=None, words=None):
    return ("f", i, who, float(i if at is None else at), i + 0.9, text, words, None)


@pytest.mark.parametrize(
    "who,text,label",
    [
        ("SPEAKER_01", "Yes.", "SPEAKER_01"), (" speaker-01 ", "Yes.", "SPEAKER_01"), ("Speaker 1", "Yes.", "SPEAKER_01"), ("S1", "Yes.", "SPEAKER_01"), ("SPK1:", "Yes.", "SPEAKER_01"),
        ("Lee, Ann", "Yes.", "SPEAKER_00"), ("ANN LEE", "Yes.", "SPEAKER_00"), ("Lee", "Yes.", "SPEAKER_00"), ("HOST:", "Yes.", "SPEAKER_00"), ("guest", "Yes.", "unknown"),
        ("?", "Yes.", "unknown"), (None, "Yes.", "unknown"), ("UNKNOWN", "[00:00:01] >> Bo Cy: Yes.", "SPEAKER_01"), ("", "[SPEAKER_02]: Yes.", "SPEAKER_02"),
        ("", "Ann - Yes.", "SPEAKER_00"), ("SPEAKER_00", "Bo: Yes.", "SPEAKER_00"), ("SPEAKER_09", "Yes.", "unknown"), ("", "host: Yes.", "SPEAKER_00"),
    ],
)
def test_who_speaks(spark, who, text, label):
    r = labelled(spark, [utt(0, who, text)], PEOPLE).collect()
    assert [(x.label, x.text) for x in r] == [(label, "Yes.")]


@pytest.mark.parametrize("text", ["[laughter]", "((inaudible))", "♪ ♪", "♪ theme ♪", "Uh... [pause]", "Erm, uh.", "UH.", "00:01:02 Hmm.", "<00:00:26.000> Um.", "", "  ", "HOST: {breath}", "*coughs* >> Ann Lee:"])
def test_nothing_spoken(spark, text):
    assert labelled(spark, [utt(0, "SPEAKER_00", text)], PEOPLE).count() == 0


def test_runs_cross_shards_and_words_count_where_text_is_null(spark):
    w = [("Well,", 1.0, 1.2), ("uh,", 1.3, 1.4), ("fine.", 1.5, 1.9)]
    us = [utt(0, "S0", "One."), utt(2, "S0", None, at=20, words=w), utt(1, "S0", "Two.", at=9), utt(3, None, "Hm? Three.", at=30), utt(4, "?", "Four.", at=41), utt(5, "S1", None, at=50), utt(6, "S0", "Last.", at=60)]
    rows = labelled(spark, [*us, us[0]], PEOPLE)
    got = sorted((r.first_idx, r.last_idx, r.label, r.n_utterances) for r in turns.speaker_turns(rows).collect())
    assert got == [(0, 2, "SPEAKER_00", 3), (3, 4, "unknown", 2), (6, 6, "SPEAKER_00", 1)]
    assert {r.text for r in turns.turn_texts(rows).where("turn = 1").collect()} == {"One.", "Two.", "Well, fine."}
    assert turns.speaker_turns(labelled(spark, [], PEOPLE)).count() == 0 and labelled(spark, [utt(0, "S0", "Hi.")], []).first().label == "unknown"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-50, 50), max_size=12))
def test_isotonic_is_the_best_fit(ys):
    y = np.array(ys, float)
    fit = turns.isotonic(y)
    assert len(fit) == len(y) and (np.diff(fit) >= -1e-9).all()
    best = [max(min(y[a : b + 1].mean() for b in range(i, len(y))) for a in range(i + 1)) for i in range(len(y))]
    assert np.allclose(fit, best)


def brute_clock(rows, reset):
    """Segments by drops, isotonic fit of each whole segment; (segment, fixed start) by idx."""
    seg, last, out, by = 0, None, {}, defaultdict(list)
    for i, v in sorted(rows):
        if v is not None and last is not None and v < last - reset:
            seg += 1
        last = v if v is not None else last
        by[seg].append((i, v))
    for g, mine in by.items():
        fit = iter(turns.isotonic(np.array([v for _, v in mine if v is not None], float)).tolist())
        near = None
        for i, v in mine:
            near = next(fit) if v is not None else near
            out[i] = (g, near)
    return out


@pytest.mark.parametrize("seed,parts", [(1, 1), (2, 3), (3, 9), (4, 40)])
def test_repaired_clock_equals_the_fit_of_whole_segments(spark, seed, parts):
    rng = random.Random(seed)
    data, at = [], 0.0
    for i in range(400):
        at += rng.choice([0.5, 1.0, 3.0])
        if rng.random() < 0.02:
            at = max(0.0, at - 200)
        v = round(at + (rng.choice([-8.0, -3.0, 5.0]) if rng.random() < 0.15 else 0), 2)
        data.append(("f", 3 * i, None if rng.random() < 0.05 and i else v, rng.choice([None, v + 1, v - 1, float("nan")]), "x"))
    data += [("g", 0, None, None, "x"), ("h", 0, float("nan"), 2.0, "x"), ("h", 1, 1.0, 0.0, "x")]
    df = spark.createDataFrame(data, "file_id string, idx int, start_sec double, end_sec double, level string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = {(r.file_id, r.idx): r for r in turns.repaired_clock(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = brute_clock([(i, v) for f, i, v, *_ in data if f == "f"], 60.0)
    assert len(got) == len(data) and len({g for g, _ in want.values()}) > 1
    for i, (seg, fixed) in want.items():
        r = got["f", i]
        assert r.segment == seg and r.fixed_end >= r.fixed_start
        if dict((j, v) for _, j, v, *_ in data)[i] is not None:
            assert r.fixed_start == pytest.approx(fixed)
    assert got["g", 0].fixed_start is None and got["h", 0].fixed_start == 1.0 and got["h", 1].fixed_end == 1.0
    assert turns.repaired_clock(df.limit(0)).count() == 0


def test_turns_follow_the_repaired_clock(spark):
    """Within a segment by recorded start; a clock that begins anew comes after what was said before."""
    us = [utt(0, "S0", "One.", at=100), utt(1, "S1", "Three.", at=108), utt(2, "S0", "Two.", at=104), utt(3, "S1", "Four.", at=3), utt(4, "S0", "Five.", at=5)]
    rows = labelled(spark, us, PEOPLE)
    got = [(r.first_idx, r.last_idx, r.label) for r in turns.speaker_turns(rows).orderBy("turn").collect()]
    assert got == [(0, 2, "SPEAKER_00"), (1, 3, "SPEAKER_01"), (4, 4, "SPEAKER_00")]


# terms

FEED = "id string, text string, v int, term string"


def counted(df):
    return {r.term: (r.n_total, r.n_records) for r in df.collect() if r.term}


def brute_terms(texts):
    total, docs = Counter(), Counter()
    for x in texts:
        w = re.findall("[a-z0-9]+", re.sub(r"'s\b", "", (x or "").lower().replace("’", "'")).replace("'", ""))
        total.update(w)
        docs.update(set(w))
    return {t: (total[t], docs[t]) for t in total}


def test_changes_and_removals_keep_the_counts_right(spark):
    feed = [("a", "Don't stop, don’t!", 1, "x"), ("a", "don't go", 2, "x"), ("b", "go go go", 1, "x"), ("b", "go go go", 5, "x"), ("c", None, 1, "x"), ("d", "", 1, "x"), (None, "lost", 1, "x"), ("e", "now here", None, "x"), ("e", None, 3, "x")]
    df = spark.createDataFrame(feed, FEED)
    for batch, n in ((F.lit(0), 1), (F.when(F.col("v") > 1, 1), 2), (F.col("v") - 1, 5)):
        state = terms.term_counts(spark, df, "id", "text", "v", batch=batch, batches=n)
        assert counted(state) == brute_terms(["don't go", "go go go"])
    signed = sorted((r.batch, r.text, r.sign) for r in terms.record_changes(df, "id", "text", "v", F.when(F.col("v") > 1, 1), 2).where("text is not null").collect())
    assert [x for x in signed if x[2] < 0] == [(1, "Don't stop, don’t!", -1), (1, "go go go", -1), (1, "now here", -1)]
    keep = terms.TermCounts(spark)
    add = lambda rows: keep.merge(terms.term_changes(spark.createDataFrame(rows, "text string, sign int")))
    add([("one two", 1), ("two", 1), (None, 1), ("", 1)])
    assert counted(add([("one two", -1), ("two three", 1)])) == brute_terms(["two", "two three"])
    marks = {r.term: r.mark for r in terms.marked_terms(keep.read(), rare=1, common=0.9).collect()}
    assert marks == {"two": "common", "three": "rare"}
    assert terms.marked_terms(terms.term_counts(spark, spark.createDataFrame([], FEED), "id", "text", "v")).count() == 0


def test_counts_outlive_their_object(spark, tmp_path):
    """A state is closed and opened again, a batch merged twice counts once, and only the parts touched are replaced."""
    folder = f"file://{tmp_path}/counts"
    change = lambda rows: terms.term_changes(spark.createDataFrame(rows, "text string, sign int"))
    rng = random.Random(4)
    texts, live = [" ".join(f"w{rng.randrange(60)}" for _ in range(8)) for _ in range(40)], Counter()
    for i in range(6):
        old = [t for t in live if live[t] > 0 and rng.random() < 0.4]
        new = rng.sample(texts, 6)
        terms.TermCounts(spark, folder, buckets=5).merge(change([(t, -1) for t in old] + [(t, 1) for t in new]), f"b{i}")
        live.update(new)
        live.subtract(old)
    again = terms.TermCounts(spark, folder, buckets=99)
    want = brute_terms(live.elements())
    assert again.buckets == 5 and counted(again.read()) == want
    before = again._state()
    assert counted(again.merge(change([("w1 w2", 1)]), "b3")) == want and again._state() == before
    again.merge(change([("single", 1)]), "one term")
    changed = {b for b, p in again._state()["parts"].items() if before["parts"].get(b) != p}
    assert 1 <= len(changed) <= 2  # the part of the term and the part that counts the records
    assert again.vacuum() > 0 and counted(terms.TermCounts(spark, folder).read()) == {**want, "single": (1, 1)}


def test_a_rare_returning_word_leads(spark):
    texts = [f"the cat and the dog number{i} went zzyzx{'' if i else ' zzyzx zzyzx'}" for i in range(6)] + ["the mispelt word and the cat", None, ""]
    df = spark.createDataFrame([(str(i), x, "t", 1.0) for i, x in enumerate(texts)], "id string, text string, term string, score double")
    lead = {r.id: r.term for r in terms.leading_terms(terms.distinctive_terms(df, "id", "text"), "id").collect()}
    assert lead["0"] == "zzyzx" and set(lead) == {str(i) for i in range(7)}
    few = terms.distinctive_terms(df, "id", "text", wanted=df.where("id in ('0', '9')").select("id"))
    every = terms.distinctive_terms(df, "id", "text", heavy_share=0.05)
    pick = lambda d: {(r.id, r.term): round(r.score, 9) for r in d.where("id = '0'").collect()}
    assert pick(few) == pick(every)
    assert terms.distinctive_terms(df.limit(0), "id", "text").count() == 0


# neighbours


def brute_neighbours(ids, x, k=3, least=0.9):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    out = set()
    for i in range(len(ids)):
        c = sorted((-round(s[i, j], 6), ids[j]) for j in range(len(ids)) if ids[j] != ids[i] and s[i, j] >= least)
        out |= {(ids[i], b) for _, b in c[:k]}
    return out


def test_similar_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((150, 16))
    x = np.vstack([base, base[:60] + 0.15 * rng.standard_normal((60, 16)), np.repeat(base[:1], 30, 0) * 2])
    ids = [f"v{i:03d}" for i in range(len(x))]
    x = x.astype(np.float32)
    data = [(i, v.tolist(), "o") for i, v in zip(ids, x)]
    odd = [("n", None, "o"), ("e", [], "o"), ("z", [0.0] * 16, "o"), ("s", [1.0] * 3, "o"), ("f", [float("nan")] * 16, "o"), (None, [1.0] * 16, "o"), data[5]]
    df = spark.createDataFrame(data + odd, "key string, vec array<float>, other string")
    got = {(r.id, r.other) for r in neighbours.most_similar(df, "key", "vec", dim=16, min_cosine=0.9).collect()}
    want = brute_neighbours(ids, x.astype(np.float64))
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)
    assert Counter(a for a, _ in got)["v215"] == 3
    assert neighbours.most_similar(df.limit(0), "key", "vec", dim=16).count() == 0


# fusion


def brute_borda(scores, items):
    out = []
    groups = {g for g, _ in items if g}
    for g in groups:
        mine = sorted({i for h, i in items if h == g and i is not None})
        total = dict.fromkeys(mine, 0.0)
        for m in {m for h, _, m, _ in scores if h == g}:
            v = {}
            for h, i, n, x in scores:
                if h == g and n == m and x is not None and x == x and i in total:
                    v[i] = min(x, v.get(i, x))
            for i in mine:
                if i in v:
                    total[i] += sum(y < v[i] for y in v.values()) + (sum(y == v[i] for y in v.values()) + 1) / 2
                elif v:
                    total[i] += (len(v) + 1 + len(mine)) / 2
        out += [(g, i, p) for p, i in enumerate(sorted(mine, key=lambda i: (round(total[i], 6), i)), 1)]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_borda_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    items = [(g, i) for g in ("a", "b", "hot") for i in range(40 if g == "hot" else 6)] + [("a", None), (None, 3), ("a", 1)]
    scores = [(g, i, m, rng.choice([0.0, 1.0, 2.5, float(rng.random()), None, float("nan")])) for g, i in items for m in ("s", "c1", "c2")]
    s = spark.createDataFrame(scores, "group string, item long, metric string, value double")
    it = spark.createDataFrame(items, "group string, item long")
    assert sorted((r.group, r.item, r.place) for r in fusion.borda(s, it).collect()) == brute_borda(scores, items)
    assert fusion.borda(s.limit(0), it.limit(0)).count() == 0


# packing


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 40), max_size=10), st.integers(30, 40))
def test_every_item_is_packed_once(histogram, capacity):
    patterns = packing.pack_lengths(histogram, capacity)
    assert all(sum(n * c for n, c in p) <= capacity for _, p in patterns)
    packed = Counter()
    for copies, p in patterns:
        for n, c in p:
            packed[n] += copies * c
    assert packed == Counter(histogram)
    rows = packing.places(patterns, capacity)
    for n in histogram:
        spans = sorted((a, b) for m, a, b, *_ in rows if m == n)
        assert [a for a, _ in spans] == [0, *[b for _, b in spans[:-1]]] and spans[-1][1] == histogram[n]


def test_containers(spark):
    sizes = {i: s for i, s in enumerate([5, 5, 5, 0, None, 25, 10, 3, 3, 3, 1])}
    df = spark.createDataFrame([(i, s, 7) for i, s in sizes.items()], "doc int, n long, container int")
    got = packing.pack(spark, df, "doc", "n", {"s": 10, "l": 100}).collect()
    fill = defaultdict(int)
    for r in got:
        fill[r.pack_name, r.container] += r.tokens
    for r in got:
        assert r.unused == {"s": 10, "l": 100}[r.pack_name] - fill[r.pack_name, r.container] >= 0
    parts = defaultdict(list)
    for r in got:
        parts[r.pack_name, r.doc].append((r.piece, r.tokens))
    assert sorted(parts["s", 5]) == [(0, 10), (1, 10), (2, 5)] and parts["l", 5] == [(0, 25)]
    assert all(sum(t for _, t in p) == sizes[d] for (_, d), p in parts.items()) and len(parts) == 2 * 9
    assert len({c for n, c in fill if n == "s"}) <= 7
    assert packing.pack(spark, df.limit(0), "doc", "n", {"s": 10}).count() == 0


def test_similar_vectors_of_a_crowded_region(spark):
    rng = np.random.default_rng(11)
    crowd = rng.normal(size=64) / 8 + rng.normal(size=(700, 64)) * 0.23 / 8
    x = np.vstack([crowd, rng.normal(size=(1400, 64))]).astype(np.float32)
    df = spark.createDataFrame([(f"{i:05d}", v.tolist()) for i, v in enumerate(x)], "key string, vec array<float>")
    got = {(r.id, r.other) for r in neighbours.most_similar(df, "key", "vec", dim=64, min_cosine=0.9).collect()}
    y = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    sim = y @ y.T
    np.fill_diagonal(sim, -1)
    want = {(f"{i:05d}", f"{j:05d}") for i in range(len(x)) for j in np.argsort(-sim[i])[:3] if sim[i, j] >= 0.9}
    assert len(want) > 2000 and len(got & want) / len(want) > 0.999 and len(got) == len(want)


def all_neighbours(x, k=3):
    y = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    sim = y @ y.T
    np.fill_diagonal(sim, -2)
    return {(f"{i:05d}", f"{j:05d}"): sim[i, j] for i in range(len(x)) for j in np.argsort(-sim[i])[:k]}


@pytest.mark.parametrize("parts", [2, 60])
@pytest.mark.parametrize("groups,size,noise", [(20, 90, 0.23), (300, 6, 0.2)])
def test_similar_vectors_at_any_partitioning(spark, parts, groups, size, noise):
    """Crowded and sparse groups, whatever the number of partitions; without a threshold every vector has three."""
    rng = np.random.default_rng(5)
    x = (np.repeat(rng.normal(size=(groups, 64)), size, 0) + rng.normal(size=(groups * size, 64)) * noise).astype(np.float32)
    df = spark.createDataFrame([(f"{i:05d}", v.tolist()) for i, v in enumerate(x)], "key string, vec array<float>")
    before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
        near = {(r.id, r.other) for r in neighbours.most_similar(df, "key", "vec", dim=64, min_cosine=0.9).collect()}
        every = {(r.id, r.other) for r in neighbours.most_similar(df, "key", "vec", dim=64).collect()} if parts == 2 else None
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    want = all_neighbours(x)
    above = {p for p, c in want.items() if c >= 0.9}
    assert len(above & near) >= 0.99 * len(above)
    if every is not None:
        assert len(every) == 3 * len(x) and len(every & set(want)) >= 0.95 * len(want)


def brute_shared(a, b, length):
    return next((i for i in range(length) if (a ^ b) >> (length - 1 - i) & 1), length)


@pytest.mark.parametrize("seed", range(6))
def test_descent_and_ascent_equal_brute_force(seed):
    rng = np.random.default_rng(seed)
    n, length, trees = 40, 14, 3
    codes = rng.integers(0, 1 << length, (n, trees)) & rng.choice([0x3FFF, 0x3F00, 0x3000], (n, 1))
    steps = np.zeros((n, trees), np.int64)
    for t in range(trees):
        order = np.argsort(codes[:, t], kind="stable")
        deep = neighbours.descents(np.full(n, t), codes[order, t], length)
        shared = np.array([[brute_shared(int(a), int(b), length) for b in codes[:, t]] for a in codes[:, t]])
        for j in range(neighbours.STEPS):
            want = np.sort(shared, axis=1)[:, -(2 << j)] if (2 << j) <= n else np.zeros(n)
            assert (deep[np.argsort(order), j] == want).all()
        steps[:, t] = (deep << (neighbours.LEVEL_BITS * np.arange(neighbours.STEPS))).sum(1)[np.argsort(order)]
    got = neighbours.ascent(steps, trees, 12)
    for i in range(n):
        size = lambda x: sum(1 << int(np.log2(m)) for t in range(trees) if (m := sum(brute_shared(int(codes[i, t]), int(c), length) >= x for c in codes[:, t])) > 1)  # noqa: B023, E731
        # a node of one row holds only the vector itself and adds nothing
        want = max((x for x in range(length + 1) if size(x) - sum(1 for t in range(trees) if sum(brute_shared(int(codes[i, t]), int(c), length) >= x for c in codes[:, t]) > 1) >= 12), default=0)
        assert got[i] == want


# mixing


def mixed(spark, docs, targets, **more):
    df = spark.createDataFrame(docs, "doc_id long, source string, text string, n_tokens long")
    return {r.doc_id: r for r in mixing.mix(spark, df, targets, **more).collect()}


def test_shares_are_met_within_the_caps(spark):
    rng = random.Random(2)
    docs = [(i, "big", f"b{i}", rng.randrange(5, 15)) for i in range(800)] + [(1000 + i, "small", f"s{i}", rng.randrange(5, 15)) for i in range(60)]
    docs += [(2000, "big", "both", 10), (2001, "small", "both", 10), (2002, "small", "both", 10), (3000, None, "x", 5), (3001, "other", "y", 5), (3002, "big", None, 0), (3003, "small", "", 0)]
    got = mixed(spark, docs, {"big": (0.75, 1), "small": (0.25, 3)})
    assert len(got) == len(docs)
    use = Counter()
    for r in got.values():
        use[r.source] += r.times * r.n_tokens
        assert r.times <= {"big": 1, "small": 3}.get(r.source, 0)
    assert abs(use["small"] / sum(use.values()) - 0.25) < 0.01 and use["small"] > 2.8 * 60 * 9
    assert got[2000].times + got[2001].times <= 1 and got[2002].times == 0 and got[3000].times == got[3003].times == 0
    again = mixed(spark, docs[::-1], {"big": (0.75, 1), "small": (0.25, 3)})
    assert {k: r.times for k, r in got.items()} == {k: r.times for k, r in again.items()}


def test_a_stated_total_and_nothing_at_all(spark):
    docs = [(i, "ab"[i % 2], f"t{i}", 10) for i in range(40)]
    got = mixed(spark, docs, {"a": (0.5, 1), "b": (0.5, 1)}, total=200)
    assert sum(r.times for r in got.values()) == 20
    short = mixed(spark, docs, {"a": (0.9, 1), "b": (0.1, 1)}, total=400)
    assert sum(r.times for r in short.values() if r.source == "a") == 20 and sum(r.times for r in short.values() if r.source == "b") == 4
    assert mixed(spark, [], {"a": (1.0, 1)}) == {}


def test_a_source_without_texts_does_not_bound_the_mix(spark):
    docs = [(i, "ab"[i % 2], f"t{i}", 10) for i in range(40)]
    got = mixed(spark, docs, {"a": (0.48, 1), "b": (0.48, 1), "c": (0.04, 1)})
    assert sum(r.times for r in got.values() if r.source == "a") == sum(r.times for r in got.values() if r.source == "b") == 20


# repetition


def brute_share(w):
    g = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    c = Counter(g)
    cov = {i + k for i, x in enumerate(g) if c[x] > 1 for k in range(5)}
    return len(cov) / len(w) if w else 0.0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=40))
def test_repeated_share_is_exact(w):
    assert repetition.repeated_share(w) == pytest.approx(brute_share(w))


def test_repetition_of_odd_texts(spark):
    say = " ".join(f"w{i}" for i in range(60))
    docs = [(1, say, "en", 0.1), (2, " ".join(["so much noise again please"] * 50), "en", 0.1), (3, None, "en", 0.1), (4, "   ", None, 0.1), (5, "ab_c ÄÖ ab_c ÄÖ", None, 0.1), (6, say + " " + say, "xx", 0.1), (7, "x " * 200_000, "en", 0.1), (2, " ".join(["so much noise again please"] * 50), "en", 0.1)]
    got = {r.doc: r for r in repetition.repetition(spark.createDataFrame(docs, "doc long, text string, lang string, share double"), "doc", "text", "lang").collect()}
    assert got[2].share == got[6].share == got[7].share == 1.0 and got[3].share == got[4].share == got[5].share == got[1].share == 0.0
    assert repetition.repetition(spark.createDataFrame([], "doc long, text string, lang string"), "doc", "text", "lang").count() == 0


def test_texts_that_repeat_themselves_stray_from_their_language(spark):
    """Every share is given and exact; the divergence alone drops most honest texts and none that repeats itself much."""
    rng = np.random.default_rng(8)
    tongue = {lang: ([f"{lang}{i}" for i in range(3000)], 1 / np.arange(1, 3001) ** 0.9) for lang in ("en", "de")}
    docs = []
    for i in range(700):
        lang = "en" if i % 3 else "de"
        vocabulary, weight = tongue[lang]
        w = rng.choice(vocabulary, rng.integers(60, 300), p=weight / weight.sum()).tolist()
        if i % 10 == 0:
            part = w[: len(w) // 4]
            w = part * int(rng.integers(4, 7)) + w[len(part) :]
        docs.append((i, " ".join(w), lang))
    docs += [(1000, docs[10][1], "xx"), (1001, docs[10][1], None), (1002, "a b c d e " * 4, "en"), (1003, "only text of its kind", "yy")]
    df = spark.createDataFrame(docs, "doc long, text string, lang string")
    got = {r.doc: r for r in repetition.repetition(df, "doc", "text", "lang").collect()}
    want = {i: brute_share(t.split()) for i, t, _ in docs}
    assert all(got[i].share == pytest.approx(want[i]) for i in want)
    assert {i for i in want if want[i] >= 0.4} <= {i for i in got if got[i].suspect}
    honest = [i for i in range(700) if want[i] < 0.4]
    assert sum(not got[i].suspect for i in honest) > 0.6 * len(honest)
    some = {r.doc: r.share for r in repetition.repetition(df, "doc", "text", "lang", only_suspects=True).collect()}
    assert some == {i: r.share for i, r in got.items() if r.suspect}


def test_divergence():
    a, b = np.array([1.0, 0.0]), np.array([0.0, 3.0])
    assert repetition.divergence(a, b) == pytest.approx(1.0) and repetition.divergence(a, a) == 0.0


@pytest.mark.skipif(not Path(token_counts.TOKENIZER).exists(), reason="needs the tokenizer")
def test_token_counts(spark):
    df = spark.createDataFrame([("hello world",), (None,), ("",), ("<|endoftext|>",)], "text string")
    assert [r.n for r in df.select(token_counts.n_tokens(F.col("text")).alias("n")).collect()][:3] == [2, 0, 0]
