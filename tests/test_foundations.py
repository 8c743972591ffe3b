"""The operators that other operators rest on."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from earshot.operators import diarization, intervals, moments, ranking, segments, versions
from earshot.sources import store



def test_running_totals_and_numbers_over_a_hot_group(spark, rows):
    data = [("hot", i, i % 7) for i in range(3000)] + [("b", 5, 1), ("c", 1, 2)]
    df = spark.createDataFrame(data, "k string, o int, v int").repartition(7)
    got = {(r.k, r.o): r.t for r in ranking.running_total(df, ["k"], [F.col("o").asc()], F.col("v"), "t").collect()}
    want, s = {}, 0
    for k, o, v in sorted(data[:3000]):
        s += v
        want[k, o] = s
    assert got == {**want, ("b", 5): 1, ("c", 1): 2}
    numbered = ranking.row_numbers(df, ["k"], [F.col("o").desc()], "n")
    assert numbered.where("k = 'hot' and n = 1").first().o == 2999
    assert ranking.row_numbers(df.limit(0), ["k"], [F.col("o").asc()], "n").count() == 0


def test_latest_version_is_independent_of_order(spark, rows):
    df = spark.createDataFrame([(1, 1, "a"), (1, 3, "c"), (1, 2, "b"), (2, None, "x"), (None, 1, "n")], "k int, v int, t string")
    assert rows(versions.latest(df, ["k"], "v", ["t"])) == sorted([(1, "c"), (2, "x"), (None, "n")], key=repr)


def brute_periods(data, join=500, sitting=3_600_000):
    out, by = [], {}
    for k, s, e in data:
        if k is not None and s is not None and e is not None and e > s:
            by.setdefault(k, []).append((round(s * 1000), round(e * 1000)))
    for k, iv in by.items():
        merged = []
        for s, e in sorted(iv):
            if merged and s <= merged[-1][1] + join:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out += [(k, "period", s, e) for s, e in merged]
        out += [(k, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:]) if b[0] - a[1] <= sitting]
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_periods_equal_brute_force_for_any_shard(spark, rows, seed):
    rng = random.Random(seed)
    data = [(rng.choice("ab"), s := rng.randrange(0, 90_000) / 10, s + rng.choice([0.1, 3, 40, 900, -1])) for _ in range(200)]
    data += [("a", 3.0, None), (None, 1.0, 2.0), ("a", float("nan"), 2.0), ("long", 0.0, 9_000_000.0), ("long", 5.0, 6.0), ("long", 9_000_700.0, 9_000_800.0)]
    data += data[:20]
    df = spark.createDataFrame([(k, s, e, "x") for k, s, e in data], "k string, s double, e double, kind string")
    want = brute_periods([d for d in data if d[1] == d[1]])
    for shard in (7_000, 600_000):
        assert rows(intervals.periods_and_gaps(df, ["k"], "s", "e", shard_ms=shard)) == sorted(want, key=repr)


def test_periods_of_an_empty_table(spark):
    df = spark.createDataFrame([], "k string, s double, e double")
    assert intervals.periods_and_gaps(df, ["k"], "s", "e").count() == 0


def greedy(ms, gap=10.0):
    kept = []
    for m in sorted(ms):
        def near(k):
            _, f, i, s, a, b = k
            lap = max(0.0, min(b, m[5]) - max(a, m[4])) / max(min(b - a, m[5] - m[4]), 1e-6)
            return f == m[1] and (i == m[2] or abs(s - m[3]) < gap or lap > 0.5)
        if not any(map(near, kept)):
            kept.append(m)
    return sorted(k[0] for k in kept)


@pytest.mark.parametrize("seed", range(3))
def test_near_duplicates_in_time_equal_the_greedy_rule(spark, seed):
    rng = random.Random(seed)
    ms = [(r, rng.choice("ab"), s := rng.randrange(0, 400), float(s), s - rng.random() * 30, s + rng.random() * 40) for r in range(1, 60)]  # an utterance has one start
    df = spark.createDataFrame([("q", *m) for m in ms], "query_id string, rank int, file_id string, idx int, start_sec double, p_start double, p_end double")
    assert sorted(r.rank for r in moments.distinct_moments(df).collect()) == greedy(ms)


def test_store_shows_whole_versions_only(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/ix")
    with pytest.raises(LookupError):
        s.read("t")
    first = s.rebuild({"t": spark.range(3)})
    s.rebuild({"t": spark.range(5)})
    assert s.counts(["t"]) == {"t": 5} and s.read("t", first).count() == 3


def test_stream_of_sessions_and_landing(spark, tmp_path):
    from earshot.streaming import sessions

    spark.sql("SELECT 1L AS user_id, timestamp'2024-01-01 00:00:00' AS ts UNION ALL SELECT 1L, timestamp'2024-01-01 00:10:00' UNION ALL SELECT 1L, timestamp'2024-01-02'").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("user_id long, ts timestamp").parquet(f"{tmp_path}/in")
    seen = []
    sessions.refresh_on_landing(stream, lambda df, i: seen.append(sessions.activity_sessions(df).count()), f"{tmp_path}/cp").awaitTermination()
    assert sum(seen) == 2


def test_written_tables_can_be_released(spark, tmp_path):
    from pathlib import Path

    from earshot import session

    kept, session._WRITTEN[:] = list(session._WRITTEN), []
    try:
        df = session.cut(spark.range(3), "short")
        path = Path(df.inputFiles()[0].removeprefix("file://")).parent
        assert df.count() == 3 and path.exists()
        other = session.cut(df.withColumn("x", F.lit(1)), "made-of-it")
        session.discard(df)
        assert not path.exists() and other.count() == 3
        assert session.release(spark) == 1 and not Path(other._written_to.removeprefix("file://")).exists()
    finally:
        session._WRITTEN[:] = kept


def test_blocks_of_words_are_decoded_as_one_recording(spark):
    rng = np.random.default_rng(3)
    data = []
    for f in ("a", "b"):
        p = np.clip(0.5 + np.cumsum(rng.normal(0, 0.1, 200)) % 1 - 0.5, 0.05, 0.95)
        # numbers with gaps, as those of words by utterance
        data += [(f, i * 10_000 + i % 7, float(np.log(x)), float(np.log(1 - x)), bool(rng.random() < 0.1)) for i, x in enumerate(p)]
    rows = spark.createDataFrame(data, "file_id string, idx long, l0 double, l1 double, boundary boolean")
    for block in (1, 7, 50, 50_000):
        got = {(r.file_id, r.idx): r.path for r in segments.viterbi(rows, block=block).collect()}
        for f in ("a", "b"):
            own = [d for d in data if d[0] == f]
            assert [got[f, d[1]] for d in own] == segments.best_path([d[2:4] for d in own], [d[4] for d in own])


def test_voices_keep_their_places_over_a_long_recording(spark):
    rng = np.random.default_rng(5)
    voices, who = rng.normal(size=(2, 16)), rng.integers(0, 2, 240)
    emb = voices[who] + 0.9 * rng.normal(size=(240, 16))
    data = [("f", i, i * 1.0, i + 1.0, e.tolist()) for i, e in enumerate(emb)]
    rows = spark.createDataFrame(data, "file_id string, n int, start_sec double, end_sec double, embedding array<double>")
    whole, parts = ([r.p0 for r in diarization.window_posteriors(rows, most=m).orderBy("n").collect()] for m in (4000, 40))
    assert np.allclose(whole, parts, atol=1e-6) or np.allclose(whole, 1 - np.array(parts), atol=1e-6)


def test_neighbours_of_passages_numbered_beyond_four_digits(spark, tmp_path):
    from earshot.plans import text_queries

    ids = [f"f_c{n:04d}" for n in (999, 1000, 1001, 1426, 9998, 9999, 10000, 14259, 14260)]
    data = [(x, "f", 10.0 * i, 10.0 * i + 12) for i, x in enumerate(ids)]
    c = spark.createDataFrame(data, "id string, file_id string, start_sec double, end_sec double")
    c.withColumn("ingested_at", F.lit("2024-01-01").cast("timestamp")).write.parquet(f"{tmp_path}/chunks.parquet")
    got = {(r.id, r.next_id) for r in text_queries.passage_overlap(spark, str(tmp_path)).collect()}
    near = [(999, 1000), (1000, 1001), (9998, 9999), (9999, 10000), (14259, 14260)]
    assert got == {(f"f_c{a:04d}", f"f_c{b:04d}") for a, b in near}


@pytest.mark.parametrize("parts", [1, 3, 25])
def test_measures_along_an_order_equal_the_plain_loop(spark, parts):
    rng = random.Random(parts)
    data = [(k, i, rng.choice([None, rng.randrange(100)])) for k, n in (("hot", 300), ("b", 7), ("c", 1)) for i in range(n)]
    df = spark.createDataFrame(rng.sample(data, len(data)), "k string, o int, v int")
    v = F.col("v")
    outs = {f"{how}_{int(inc)}{int(back)}": ranking.Along(how, v, inc, back) for how in ("sum", "max", "min", "last") for inc in (True, False) for back in (True, False)}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        placed = ranking.placed(df, ["k"], [F.col("o").asc()])
        got = {(r.k, r.o): r for r in ranking.carried(placed, ["k"], ["o"], outs).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == len(data)
    for key in ("hot", "b", "c"):
        line = [x for k, _, x in data if k == key]
        for i in range(len(line)):
            for n, o in outs.items():
                seen = (line[i + (not o.inclusive) :][::-1] if o.backward else line[: i + o.inclusive])
                known = [x for x in seen if x is not None]
                want = sum(known) if o.how == "sum" else None if not known else known[-1] if o.how == "last" else max(known) if o.how == "max" else min(known)
                assert got[key, i][n] == want, (n, key, i)
    with pytest.raises(ValueError):
        ranking.placed(placed, ["k"], [F.col("o").asc()])


def test_a_cluster_has_to_name_its_shared_folder(spark):
    from types import SimpleNamespace

    from earshot import session

    unnamed = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=SimpleNamespace(master=master))
    with pytest.raises(ValueError):
        session.shared_dir(unnamed("spark://host:7077"))
    assert session.shared_dir(unnamed("local[2]")).startswith("file:///")


def test_pointers_are_replaced_whole(spark, tmp_path):
    path = f"file://{tmp_path}/state/CURRENT"
    assert store.read_file(spark, path) is None and store.list_folder(spark, f"file://{tmp_path}/none") == []
    for text in ("one", "two longer", "3"):
        store.replace_file(spark, path, text)
        assert store.read_file(spark, path) == text
    assert [n for n in store.list_folder(spark, f"file://{tmp_path}/state") if not n.startswith(".")] == ["CURRENT"]


def test_sessions_on_a_stream_are_those_of_the_table(spark, tmp_path):
    from earshot.streaming import sessions

    rng = random.Random(6)
    events = [(u, f"2024-03-0{rng.randrange(1, 6)} {rng.randrange(24):02d}:{rng.randrange(60):02d}:00") for u in range(3) for _ in range(60)]
    df = spark.createDataFrame(events, "user_id int, ts string").selectExpr("user_id", "to_timestamp(ts) AS ts")
    df.repartition(5).write.parquet(f"{tmp_path}/in")  # a session may be spread over several files
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    sessions.sessions_so_far(stream, f"{tmp_path}/out", f"{tmp_path}/cp", gap="45 minutes").awaitTermination()
    plain = lambda d: sorted(map(tuple, d.collect()))
    assert plain(spark.read.parquet(f"{tmp_path}/out")) == plain(sessions.activity_sessions(df, gap="45 minutes"))
