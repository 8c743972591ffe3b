"""Sources, sinks, the library and the way from recordings to an index."""

import io
import json
import random
import sys
import wave
from pathlib import Path

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from earshot.operators import library, models
from earshot.plans import ingest
from earshot.sources import html, transcripts
from earshot.sources.store import Store


def test_pages_give_back_their_turns(spark):
    """Pages are written from turns, with headings, stage directions and a preface that must not come back."""
    rng = random.Random(1)
    pages, want = [], []
    for i in range(60):
        turns, body = [], ""
        for _ in range(rng.randrange(6)):
            who = rng.choice(["Ida Stone", "Per Olsen", "Q"])
            said = [f"Line {rng.randrange(99)} & <more>.", "It ended well!"][: rng.randrange(1, 3)]
            tag, mark = rng.choice(["p", "h3"]), rng.choice(["", ":", " (Host)"])
            body += f"<{tag}><strong>{who}{mark}</strong></{tag}>" + rng.choice(["", "<p>[applause]</p>"])
            body += "".join(f"<p>{s.replace('&', '&amp;').replace('<', '&lt;').replace('>', '&gt;')}</p>" for s in said)
            if turns and turns[-1][0] == who:
                turns[-1] = (who, turns[-1][1] + " " + " ".join(said))
            else:
                turns.append((who, " ".join(said)))
        pages.append((i, f"<h1>Show</h1><p>A preface.</p><h2><strong>Transcript</strong></h2>{body}" if i % 9 else f"<p>{body}</p>"))
        want.append(turns if i % 9 else [])
    got = {}
    for r in html.html_turns(spark.createDataFrame([*pages, (99, None)], "page_id int, html string")).collect():
        got.setdefault(r.page_id, []).append((r.turn, r.speaker, r.text))
    assert [[x[1:] for x in sorted(got.get(i, []))] for i, _ in pages] == want and 99 not in got


def test_transcripts_come_back_as_they_were_written(spark, tmp_path):
    rng = random.Random(2)
    utts = [(f"f{f}", i, rng.choice(["S", None]), float(i), rng.choice([None, i + 0.5]), rng.choice([None, 'Zoë said "so\\n"', ""]), [(f"w{k}", k / 8, None) for k in range(rng.randrange(4))]) for f in range(5) for i in range(rng.randrange(6))]
    u = spark.createDataFrame(utts, f"file_id string, idx int, speaker string, start_sec double, end_sec double, text string, words array<{transcripts.WORD}>")
    s = spark.createDataFrame([("f0", "S", "host", None, 0.75, 12, 0.5)], "file_id string, label string, role string, name string, confidence double, n_words long, question_rate double")
    a = spark.createDataFrame([(f"f{f}", f * 1.5) for f in range(5)], "file_id string, duration_sec double")
    transcripts.write_transcripts(transcripts.nested(u, s, a), f"{tmp_path}/out")
    # one document per file, as a reader of single documents wants them
    for k, line in enumerate(x for p in sorted(Path(f"{tmp_path}/out").glob("*.json")) for x in p.read_text(encoding="utf-8").splitlines()):
        (tmp_path / f"doc{k}.json").write_text(json.dumps(json.loads(line), indent=1), encoding="utf-8")
        assert "\\u" not in line
    back = transcripts.transcript_tables(transcripts.read_transcripts(spark, f"{tmp_path}/doc*.json"))
    for name, df in (("utterances", u), ("speakers", s), ("audio_files", a)):
        mine = back[name].select(*df.columns)
        assert sorted(map(repr, mine.collect())) == sorted(map(repr, df.collect()))


def test_responses_are_asked_for_once(spark, tmp_path):
    (tmp_path / "x.asr.json").write_text(json.dumps({"text": "hay", "words": [{"word": "hay", "start": 0.0, "end": 1.0}], "segments": []}))
    cached = transcripts.read_responses(spark, f"{tmp_path}/*.json")
    wanted = spark.createDataFrame([("x", "/x"), ("y", "/y")], "file_id string, path string")
    got = {r.file_id: r.text for r in transcripts.recognise(wanted, cached, lambda path: {"text": f"asked {path}", "words": [], "segments": []}).collect()}
    assert got == {"x": "hay", "y": "asked /y"}
    with pytest.raises(Exception, match="not cached"):
        transcripts.recognise(wanted, cached).collect()


def wav(x, rate, width=2, channels=1):
    """A tone as the bytes of a file."""
    top = 2 ** (8 * width - 1)
    n = np.round(np.repeat(x[:, None], channels, 1) * (top - 1)).astype(np.int64).ravel()
    raw = (n + 128).astype(np.uint8).tobytes() if width == 1 else b"".join(int(v).to_bytes(width, "little", signed=True) for v in n)
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels), w.setsampwidth(width), w.setframerate(rate)
        w.writeframes(raw)
    return out.getvalue()


def test_audio_is_read_at_one_rate(spark, tmp_path):
    tone = lambda rate: 0.6 * np.sin(np.arange(rate // 2) * 2 * np.pi * 440 / rate)
    kinds = [(16_000, 2, 1), (8_000, 2, 2), (44_100, 3, 1), (48_000, 4, 2), (22_050, 1, 1)]
    for rate, width, channels in kinds:
        (tmp_path / f"tone{rate}.wav").write_bytes(wav(tone(rate), rate, width, channels))
    got = {r.file_id: np.array(r.samples) for r in transcripts.read_audio(spark, f"{tmp_path}/*.wav").collect()}
    assert set(got) == {f"tone{r}" for r, *_ in kinds}
    for name, x in got.items():
        assert len(x) == 8_000 and np.abs(x - tone(16_000))[200:-200].max() < (0.02 if name == "tone22050" else 0.005), name
    high = np.sin(np.arange(24_000) * 2 * np.pi * 15_000 / 48_000)  # what a lower rate can't hold is left out
    assert np.abs(transcripts.resampled(high, 48_000, 16_000)[100:-100]).max() < 0.01


def test_manifests_keep_their_head(spark, tmp_path):
    yaml = pytest.importorskip("yaml")
    rng = random.Random(3)
    files = [{"file_id": f"t{i}"} | ({"title": f"Title {i}"} if i % 2 else {}) | ({"speakers": {"guest": f"G{i}"}} if i % 3 == 0 else {}) for i in range(7)]
    head = "".join(f"# line {rng.randrange(9)}\n" for _ in range(3))
    path = tmp_path / "list.yaml"
    path.write_text(head + yaml.safe_dump({"files": files}))
    assert [tuple(r) for r in transcripts.read_manifest(spark, str(path)).collect()] == [(f["file_id"], f.get("title", f["file_id"]), None, f.get("speakers", {}).get("guest")) for f in files]
    transcripts.edit_manifest(str(path), lambda d: d["files"].pop())
    assert path.read_text().startswith(head) and len(yaml.safe_load(path.read_text())["files"]) == 6
    transcripts.edit_manifest(str(path), lambda d: d["files"].append({"file_id": "t1"}))
    with pytest.raises(ValueError, match="t1"):
        transcripts.read_manifest(spark, str(path))


def test_labelled_queries_come_back(spark, tmp_path):
    pytest.importorskip("yaml")
    rows = [("q1", "tar pits", "topic", "dev", None, "n", [("f", 1.0, 2.5, 2, "so"), ("g", 3.0, 4.0, 1, None)]), ("q2", "ü", None, "test", "host", None, [])]
    kinds = "query_id string, query_text string, category string, split string, role string, notes string, relevant array<struct<file_id:string,start_sec:double,end_sec:double,grade:int,quote:string>>"
    df = spark.createDataFrame(rows, kinds)
    transcripts.write_labelled_queries(df, str(tmp_path / "q.yaml"), tolerance_sec=3.0)
    back, tolerance = transcripts.read_labelled_queries(spark, str(tmp_path / "q.yaml"))
    assert tolerance == 3.0 and sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))


def test_uploads_land_whole_or_not_at_all(tmp_path):
    for size, most in ((1, 1), (10, 100)):
        target = transcripts.land(str(tmp_path / "in"), f"../../a{size}.mp3", b"z" * size, most_bytes=most)
        assert target.parent == tmp_path / "in" and target.stat().st_size == size
    for data, error in ((b"", ValueError), (b"zz", OverflowError)):
        with pytest.raises(error):
            transcripts.land(str(tmp_path / "in"), "b.mp3", data, most_bytes=1)
    assert {p.name for p in (tmp_path / "in").iterdir()} == {"a1.mp3", "a10.mp3"}


def test_listing_equals_the_loop(spark):
    rng = random.Random(4)
    ids = [f"r{i}" for i in range(40)]
    manifest = {i: f"T{i}" if rng.random() < 0.8 else None for i in ids if rng.random() < 0.7}
    audio = {i: rng.random() for i in ids if rng.random() < 0.5}
    jobs = {i: rng.choice(["queued", "failed: x"]) for i in ids if rng.random() < 0.3}
    got = library.listing(
        spark.createDataFrame(list(manifest.items()), "file_id string, title string"), spark.createDataFrame(list(audio.items()), "file_id string, duration_sec double"),
        spark.createDataFrame([(i, f"J{i}", s) for i, s in jobs.items()], "file_id string, title string, status string"),
    )
    want = {i: (t or i, audio.get(i), jobs.get(i) or ("ready" if i in audio else "not indexed")) for i, t in manifest.items()}
    want |= {i: (f"J{i}", None, s) for i, s in jobs.items() if i not in manifest}
    assert {r.file_id: (r.title, r.duration, r.status) for r in got.collect()} == want


def test_a_library_changes_one_recording_at_a_time():
    lib, seen = library.Library({"kept": "Kept"}), []

    def work(fid, tell=None):
        seen.append(fid)
        if tell:
            tell("working")
            with pytest.raises(library.Busy):
                lib.remove(fid, work)

    fid = lib.add("New take!.flac", None, work)
    assert fid == "new_take" and lib.manifest[fid] == "New take!" and not lib.jobs
    lib.remove(fid, work)
    assert seen == [fid, fid] and set(lib.manifest) == {"kept"}

    def broken(fid, tell=None):
        raise OSError("disk full")

    bad = lib.add("kept.wav", "Again", broken)
    assert bad == "kept_2" and lib.jobs[bad] == {"title": "Again", "status": "failed: disk full"}
    lib.remove(bad, work)  # a failed job is only forgotten
    assert not lib.jobs and seen == [fid, fid]
    lib.remove("kept", broken)
    assert lib.jobs["kept"]["status"] == "failed: disk full" and "kept" not in lib.manifest
    with pytest.raises(LookupError):
        lib.remove("unknown", work)


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the models below travel to the executors


class Loudness:
    """A voice is how its sound swings: told by the signs and steps of a wave."""

    def encode(self, waves):
        spectrum = np.abs(np.fft.rfft(waves, axis=1))[:, :2400]
        return spectrum.reshape(len(waves), 40, -1).sum(2)


class Letters:
    def encode(self, texts):
        return np.array([[t.count(c) for c in "abcd"] for t in texts], float)

    def predict(self, pairs):
        return [len(a) / (len(a) + len(b)) for a, b in pairs]


class LettersOfTokens:
    def encode(self, texts):
        return [Letters().encode(t.split()) for t in texts]


def test_models_are_fed_in_batches(spark):
    texts = ["abc", None, "dd a", "", "b"] * 9
    df = spark.createDataFrame([(i, t, "xy") for i, t in enumerate(texts)], "i int, t string, p string").repartition(3)
    vector, matrix, judge = models.text_vectors(Letters, batch=4), models.token_matrices(LettersOfTokens, batch=4), models.judged(Letters, batch=4)
    for r in df.select("t", vector(F.col("t"), 4).alias("v"), matrix(F.col("t"), 4).alias("m"), judge(F.col("t"), F.col("p")).alias("j")).collect():
        if r.t is None:
            assert r.v is None and r.m is None
            continue
        v = Letters().encode([r.t])[0]
        assert np.allclose(r.v, v / max(np.linalg.norm(v), 1e-12)) and np.frombuffer(r.m, np.float16).tolist() == Letters().encode(r.t.split()).ravel().tolist() and r.j == len(r.t) / (len(r.t) + 2)


def talk(f, turns=6, seed=5):
    """Two voices of different pitch in turns: the samples, and what a recogniser makes of them."""
    rate, rng, sound, words, at = ingest.RATE, np.random.default_rng(seed), [], [], 0.0
    for turn in range(turns):
        words += [{"word": f"{'high' if turn % 2 else 'low'}{f}{turn}", "start": at + 0.5 * k, "end": at + 0.5 * k + 0.5} for k in range(6)]
        t = np.arange(3 * rate) / rate
        sound += [0.5 * np.sin(2 * np.pi * (700 if turn % 2 else 200) * t) + 0.01 * rng.normal(size=len(t)), np.zeros(rate)]
        at += 4.0
    text = " ".join(w["word"] + ("." if i % 6 == 5 else "") for i, w in enumerate(words))
    return np.concatenate(sound), {"text": text, "words": words, "segments": [{"end": at}]}


def test_recordings_become_transcripts(spark):
    """Who speaks is told by the voices, who leads by the roles."""
    audio, responses = [], []
    for f in ("one", "two"):
        sound, said = talk(f)
        audio.append((f, sound.astype(np.float32).tolist()))
        responses.append((f, said["text"], said["words"], said["segments"]))
    a = spark.createDataFrame(audio, "file_id string, samples array<float>")
    r = spark.createDataFrame(responses, f"file_id string, {transcripts.RESPONSE}")
    names = spark.createDataFrame([("one", "Host One", "Guest One")], "file_id string, host string, guest string")
    flat = transcripts.transcript_tables(ingest.build_transcripts(r, a, Loudness, names))
    got = sorted((x.file_id, x.idx, x.speaker, x.text) for x in flat["utterances"].collect())
    assert got == [(f, k, f"SPEAKER_0{k % 2}", " ".join([f"{'high' if k % 2 else 'low'}{f}{k}"] * 6) + ".") for f in ("one", "two") for k in range(6)]
    assert {x.file_id: x.duration_sec for x in flat["audio_files"].collect()} == pytest.approx({"one": 24.0, "two": 24.0})
    assert {(x.file_id, x.label, x.role) for x in flat["speakers"].collect()} == {(f, f"SPEAKER_0{k}", ("host", "guest")[k]) for f in ("one", "two") for k in (0, 1)}


def test_a_library_follows_its_uploads(spark, tmp_path):
    """Added recordings can be found, removed ones can't, failed ones leave nothing behind, and a lost index is built again."""
    from earshot.plans import recordings
    from earshot.plans import search as plan

    said = {f: talk(f, turns=4) for f in ("one", "two")}

    def recognise(path):
        name = Path(path).stem
        if name not in said:
            raise ValueError("nothing is said")
        return said[name][1]

    lib = recordings.Recordings(spark, str(tmp_path / "lib"), recognise, Loudness, target=8, stride=4)
    for f in said:
        assert lib.add(f"{f}.wav", wav(said[f][0], ingest.RATE), title=f"Talk {f}") == f and not lib.library.jobs
    find = lambda ix, text: [(h.file_id, h.speaker, h.title) for h in plan.search_one(ix, text).orderBy("rank").collect()]
    assert find(lib.index(), "hightwo3")[0] == ("two", "SPEAKER_01", "Talk two")
    bad = lib.add("noise.wav", wav(np.zeros(16_000), ingest.RATE))
    assert "nothing is said" in lib.library.jobs[bad]["status"] and not (tmp_path / "lib/audio/noise").exists()
    assert [(f, s.split(":")[0]) for f, _, _, s in lib.listing()] == [("noise", "failed"), ("one", "ready"), ("two", "ready")]
    lib.remove(bad)
    lib.remove("two")
    assert {r.file_id for r in lib.index()["passages"].collect()} == {"one"} and (tmp_path / "lib/removed/audio/two").exists()
    with pytest.raises(LookupError):
        lib.remove("two")
    again = recordings.Recordings(spark, str(tmp_path / "lib"), recognise, Loudness, target=8, stride=4)
    assert again.library.manifest == {"one": "Talk one"} and not again.start()
    (tmp_path / "lib/index/CURRENT").unlink()
    assert again.start() and [f for f, *_ in again.listing()] == ["one"]
