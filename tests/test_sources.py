import datetime
import os

import pytest
from pyspark.sql import functions as F

from tonelake.plans import incremental
from tonelake.sources import files, tables
from tonelake.streaming import events as stream


def test_discovery(spark, tmp_path):
    for name in ("a/kick.WAV", "a/.hidden.wav", "b/snare.flac", "skip/x.wav", "b/readme.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    found = files.discover(spark, str(tmp_path), files.SOUNDS, exclude=("SKIP",), content=True)
    assert sorted(r.relative_path for r in found.collect()) == ["a/kick.WAV", "b/snare.flac"]
    assert files.hashed(found).where("relative_path = 'a/kick.WAV'").first().hash == __import__("hashlib").sha256(b"a/kick.WAV").hexdigest()
    listed = files.discover(spark, str(tmp_path), files.SOUNDS)
    before = spark.createDataFrame(listed.collect(), listed.schema)
    (tmp_path / "b/snare.flac").write_bytes(b"other and longer")
    assert {r.relative_path for r in files.unchanged(before, files.discover(spark, str(tmp_path), files.SOUNDS)).collect()} == {"a/kick.WAV", "skip/x.wav"}
    os.remove(tmp_path / "skip/x.wav")
    now = files.discover(spark, str(tmp_path), files.SOUNDS)
    assert [r.relative_path for r in files.gone(before, now, "relative_path").collect()] == ["skip/x.wav"]
    with pytest.raises(ValueError):
        files.gone(before, now.limit(0), "relative_path")
    with pytest.raises(ValueError):
        files.gone(before, now.limit(1), "relative_path")


def test_links_and_vocabulary(spark, tmp_path):
    (tmp_path / "links.csv").write_text("﻿location,link\na.xm,https://x.y/a\nb.xm,nothing\nc.xm,https://x.y/c\nc.xm,https://x.y/d\n,https://x.y\n")
    good, bad = files.read_links(spark, str(tmp_path / "links.csv"))
    assert [tuple(r) for r in good.collect()] == [("a.xm", "https://x.y/a")]
    assert sorted((r.location or "", r.reason) for r in bad.collect()) == [("", "no location"), ("b.xm", "no web address"), ("c.xm", "location twice"), ("c.xm", "location twice")]
    (tmp_path / "v.txt").write_text("# all\nSNARE\n\nKICK # low\nSNARE\n")
    assert [r.entry for r in files.read_vocabulary(spark, str(tmp_path / "v.txt")).orderBy("place").collect()] == ["SNARE", "KICK"]


def test_annotations_round_trip_and_strictness(spark, tmp_path):
    rows = spark.createDataFrame([("a", 3), ("b", None)], "hash string, rating int")
    files.write_annotations(rows, str(tmp_path / "out"), ["hash"])
    assert sorted(map(tuple, files.read_annotations(spark, str(tmp_path / "out"), "hash string, rating int").collect()), key=str) == [("a", 3), ("b", None)]
    (tmp_path / "bad.json").write_text('{"hash": "a", "rating": "high"}\n')
    with pytest.raises(Exception):
        files.read_annotations(spark, str(tmp_path / "bad.json"), "hash string, rating int").collect()


def test_tables_on_disk(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.create_if_absent(spark, path, "k int, v string")
    tables.append(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), path)
    tables.create_if_absent(spark, path, "k int")
    tables.replace_table(spark.read.parquet(path).where("k > 1"), path)
    assert [tuple(r) for r in spark.read.parquet(path).collect()] == [(2, "b")]
    tables.truncate(spark, path)
    assert spark.read.parquet(path).count() == 0
    tables.set_pointer(spark, str(tmp_path / "p"), "version", "v1")
    tables.set_pointer(spark, str(tmp_path / "p"), "version", "v2")
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "p")).collect()] == [(0, "v2")]
    with pytest.raises(ValueError):
        tables.write_csv(spark.createDataFrame([], "k int"), str(tmp_path / "c"))
    gone = spark.createDataFrame([(1,)], "m int")
    left = tables.cascade({"a": spark.createDataFrame([(1, 2), (3, 4)], "m int, x int"), "b": spark.createDataFrame([(9,)], "y int")}, gone, "m")
    assert [tuple(r) for r in left["a"].collect()] == [(3, 4)] and left["b"].count() == 1


def test_pass_runs_once_per_input(spark, tmp_path):
    memo, state, ran = str(tmp_path / "memo"), {"n": 3}, []
    digest = lambda: incremental.input_digest(spark.range(state["n"]), "id")
    go = lambda work: incremental.run_if_changed(spark, memo, "pairs", digest, work)
    assert go(lambda: ran.append(1)) and not go(lambda: ran.append(2))
    state["n"] = 4
    assert go(lambda: state.update(n=5)), "the input moves meanwhile, so nothing is recorded"
    assert go(lambda: ran.append(3)) and not go(lambda: ran.append(4))
    assert ran == [1, 3]
    assert incremental.versioned_path("r", "k", "1:2") == incremental.versioned_path("r", "k", "1:2") != incremental.versioned_path("r", "k", "1:3")


def test_repeated_batches_replace_themselves(spark, tmp_path):
    write = incremental.batches(str(tmp_path / "b"), "id")
    for number in (0, 1, 1):
        write(spark.range(number * 3, number * 3 + 3), number)
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "b")).collect()) == list(range(6))


def _events(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    rows = [(i, t0 + datetime.timedelta(minutes=7 * i), i % 3, "ab"[i % 2], float(i)) for i in range(40)]
    df = spark.createDataFrame(rows + rows[:5], "event_id long, ts timestamp, user_id long, event_type string, value double")
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    return spark.read.parquet(str(tmp_path / "in"))


@pytest.mark.parametrize("slide", [None, "30 minutes"])
def test_windows_give_the_batch_rows(spark, tmp_path, slide):
    batch = _events(spark, tmp_path)
    live = stream.read_stream(spark, str(tmp_path / "in"), batch.schema)
    count = lambda df: stream.tumbling(df, "1 hour", "event_type", "value", slide=slide)
    out = stream.drain(count(live), str(tmp_path / "out"), str(tmp_path / "cp"), mode="complete")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(out) == rows(count(batch)) and out.count() > 4


def test_sessions_repeats_and_latest(spark, tmp_path):
    batch = _events(spark, tmp_path)
    assert stream.once_each(batch, "event_id").count() == 40
    live = stream.read_stream(spark, str(tmp_path / "in"), batch.schema)
    out = stream.drain(stream.once_each(live, "event_id", late="100 days"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(r.event_id for r in out.collect()) == list(range(40))
    assert stream.sessions(batch, "10 minutes", "event_type").count() == 40
    assert stream.sessions(batch, "15 minutes", "event_type").count() == 2
    got = {r.user_id: r.value for r in stream.latest(batch, "user_id", ["ts", "event_id"], ["value"]).collect()}
    assert got == {0: 39.0, 1: 37.0, 2: 38.0}
    live = stream.latest(stream.read_stream(spark, str(tmp_path / "in"), batch.schema), "user_id", ["ts", "event_id"], ["value"])
    assert {r.user_id: r.value for r in stream.drain(live, str(tmp_path / "o2"), str(tmp_path / "c2"), mode="complete").collect()} == got


def test_wav_files(spark, tmp_path):
    import wave

    import numpy as np

    from tonelake.sources import audio

    def write(name, width, channels, whole):
        with wave.open(str(tmp_path / name), "wb") as f:
            f.setnchannels(channels)
            f.setsampwidth(width)
            f.setframerate(8000)
            f.writeframes(whole.tobytes())

    tone = (np.sin(np.arange(600) / 9) * 20000).astype("<i2")
    write("a.wav", 2, 1, tone)
    write("b.wav", 2, 2, tone)
    write("c.wav", 1, 1, ((tone >> 8) + 128).astype(np.uint8))
    write("d.wav", 4, 1, tone.astype("<i4") << 16)
    write("e.wav", 2, 1, tone[:0])
    (tmp_path / "f.wav").write_bytes(b"no sound")
    found = files.discover(spark, str(tmp_path), ("wav",), content=True)
    rows = {r.path[-5:]: r for r in audio.decode(found).collect()}
    assert rows["a.wav"].frames == 600 and rows["b.wav"].frames == 300 and rows["c.wav"].depth == 8
    assert rows["a.wav"].hash == rows["d.wav"].hash != rows["b.wav"].hash
    assert rows["e.wav"].problem == "no frames" and rows["f.wav"].problem and rows["f.wav"].samples is None
    assert np.allclose(rows["a.wav"].samples, tone / 32768)
    counts = {r.path[-5:]: r.frames for r in audio.frame_counts(found).collect()}
    assert counts == {"a.wav": 600, "b.wav": 300, "c.wav": 600, "d.wav": 600, "e.wav": 0, "f.wav": None}
    good = audio.decode(found).where("problem is null and depth = 16")
    again = good.select("path", audio.encode(F.col("samples"), F.col("depth"), F.col("channels")).alias("content"))
    assert {r.path[-5:]: r.hash for r in audio.decode(again).collect()} == {k: rows[k].hash for k in ("a.wav", "b.wav", "d.wav")}
    objects = good.select("hash", F.lit(b"x").alias("content"))
    assert audio.store(objects, objects.limit(0)).count() == 2 and audio.store(objects, objects).count() == 0
    assert audio.named(objects.dropDuplicates(["hash"]), objects.where(F.col("hash") == rows["b.wav"].hash)).count() == 1


def test_roots_that_overlap_list_a_file_once(spark, tmp_path):
    for name in ("a/kick.wav", "a/b/snare.wav", "c/hat.wav"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    roots = [str(tmp_path / r) for r in ("a/b", "a", "c", "a/")]
    assert sorted(r.relative_path for r in files.discover(spark, roots, files.SOUNDS).collect()) == ["hat.wav", "kick.wav", "snare.wav"]
    assert sorted(r.relative_path for r in files.discover(spark, roots[1:], files.SOUNDS).collect()) == ["b/snare.wav", "hat.wav", "kick.wav"]


def test_link_headers(spark, tmp_path):
    def write(text, name="l.csv"):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    good, bad = files.read_links(spark, write("note,link,location\nx,https://x.y/a,a.xm\ny,,b.xm\nz,https://x.y/c\n"))
    assert [tuple(r) for r in good.collect()] == [("a.xm", "https://x.y/a")]
    assert sorted((r.location, r.reason) for r in bad.collect()) == [("", "not 3 columns"), ("b.xm", "no web address")]
    with pytest.raises(files.Refused, match="no column location and no column link"):
        files.read_links(spark, write("place,page\na.xm,https://x.y/a\n"))
    with pytest.raises(files.Refused, match="no column link"):
        files.read_links(spark, write("location\na.xm\n"))
    with pytest.raises(files.Refused, match="no header"):
        files.read_links(spark, write(""))
    (tmp_path / "two").mkdir()
    write("location,link\na.xm,https://x.y/a\n", "two/1.csv")
    write("link,location\nhttps://x.y/b,b.xm\n", "two/2.csv")
    with pytest.raises(files.Refused, match="different headers"):
        files.read_links(spark, str(tmp_path / "two"))


@pytest.mark.parametrize("line", ['{"hash": "a", "rating": 1, "rating": 2}', '{"hash": "a", "extra": 1}', "[1]", "no json", '{"hash": "a", "rating": {}}'])
def test_annotation_lines_that_are_refused(spark, tmp_path, line):
    (tmp_path / "a.jsonl").write_text('{"hash": "b"}\n\n' + line + "\n")
    with pytest.raises(Exception, match="a line|Malformed|MALFORMED"):
        files.read_annotations(spark, str(tmp_path / "a.jsonl"), "hash string, rating int").collect()
    (tmp_path / "b.jsonl").write_text('{"rating": 2, "hash": "b"}\n\n')
    assert [tuple(r) for r in files.read_annotations(spark, str(tmp_path / "b.jsonl"), "hash string, rating int").collect()] == [("b", 2)]


def test_a_failed_replacement_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.append(spark.range(5), path)
    with pytest.raises(Exception):
        tables.replace_table(spark.read.parquet(path).select(F.raise_error(F.lit("broken")).cast("long").alias("id")), path)
    assert spark.read.parquet(path).count() == 5 and sorted(os.listdir(tmp_path)) == ["t"]
    os.rename(path, path + ".old")  # where a driver may be lost
    assert tables.recover(spark, path) and spark.read.parquet(path).count() == 5 and not tables.recover(spark, path)
    tables.replace_table(spark.read.parquet(path).where("id > 2"), path)
    assert spark.read.parquet(path).count() == 2 and sorted(os.listdir(tmp_path)) == ["t"]


def test_run_log(spark, tmp_path):
    from tonelake.plans import runlog

    stages = [("even", lambda df: df.where("id % 2 = 0")), ("keys", lambda df: df.select((F.col("id") % 3).alias("k")).distinct())]
    out = runlog.run(spark.range(10), stages, str(tmp_path / "log"), "one", {"total": F.sum("id")})
    assert sorted(r.k for r in out.collect()) == [0, 1, 2]
    with pytest.raises(Exception):
        runlog.run(spark.range(3), [("all", lambda df: df), ("broken", lambda df: df.select(F.raise_error(F.lit("stop")).cast("long").alias("id")))], str(tmp_path / "log"), "two")
    rows = {(r.run, r.number): (r.stage, r["rows"], r.marks, bool(r.problem)) for r in runlog.lines(spark, str(tmp_path / "log")).collect()}
    assert rows == {("one", 0): ("even", 5, {"total": 20.0}, False), ("one", 1): ("keys", 3, {}, False), ("two", 0): ("all", 3, {}, False), ("two", 1): ("broken", None, None, True)}
