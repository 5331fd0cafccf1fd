"""Readers, writers, jobs and streams on files that the tests write."""

import io
import json
import struct
import tarfile
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace import schemas
from millrace.plans import jobs
from millrace.sources import archives, files, framed, sinks
from millrace.streaming import watch


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(path)


def test_manifests(spark, tmp_path):
    rows = [{"clip_id": "a", "text": "x", "split": "train", "duration_seconds": 1.5, "extra": 1}, {"clip_id": "b", "text": None, "split": "validation"}]
    p = put(tmp_path / "m.json", json.dumps(rows))
    assert [r.clip_id for r in files.manifest(spark, p, "train").collect()] == ["a"]
    assert files.manifest(spark, p).count() == 2 and "extra" in files.raw_manifest(spark, p).columns


def test_sample_lists_and_transcripts(spark, tmp_path):
    t = put(tmp_path / "a.tsv", "/root\ntrain/x.flac\t16000\n\n  \ntrain/y.flac\t24000\n")
    w = put(tmp_path / "a.wrd", "one\n\nthree four\n")
    assert [tuple(r) for r in files.sample_list(spark, t).orderBy("ordinal").collect()] == [(0, "train/x.flac", 16000), (1, "train/y.flac", 24000)]
    assert [tuple(r) for r in files.transcripts(spark, w).orderBy("ordinal").collect()] == [(0, "one"), (1, ""), (2, "three"), (3, "four")]
    with pytest.raises(Exception, match="not two fields"):
        files.sample_list(spark, put(tmp_path / "b.tsv", "/r\nno tab here\n")).collect()


def test_keyed_documents(spark, tmp_path):
    p = put(tmp_path / "i.json", json.dumps({"c1": {"text": "t", "duration_seconds": 3.2, "sample_rate": 1, "split": "train", "codec_revision": "v1"}}))
    assert files.cache_index(spark, p).first().clip_id == "c1" and files.cache_index(spark, p + "x").count() == 0
    s = put(tmp_path / "s.json", json.dumps({"0": ["a", "b"], "2": []}))
    assert sorted((r.ordinal, r.names) for r in files.speakers(spark, s).collect()) == [(0, ["a", "b"]), (2, [])]
    assert files.speakers(spark, s + "x").count() == 0 and files.progress(spark, s + "x").count() == 0
    sinks.progress(spark, spark.createDataFrame([(3,), (1,), (3,)], "shard_index int"), f"{tmp_path}/p.json")
    assert json.loads((tmp_path / "p.json").read_text()) == {"completed_shard_indices": [1, 3]}
    assert sorted(r[0] for r in files.progress(spark, f"{tmp_path}/p.json").collect()) == [1, 3]


def test_metadata_round_trip(spark, tmp_path):
    p = f"{tmp_path}/metadata.json"
    sinks.run_metadata(spark, p, {"global_step": 5, "best_val_loss": float("inf"), "dataset": "base"}, {"dataset": "arch"}, {"dataset": "extra", "last_val_loss": 1.0})
    row = files.metadata(spark, p).first()
    assert row.dataset == "extra" and row.best_val_loss == float("inf") and row.global_step == 5
    assert files.metadata(spark, p, checkpoint=f"{tmp_path}/none") is None and files.metadata(spark, p + "x") is None
    assert files.first_existing(spark, (p, p + "x"), (p,)) == (p,)
    assert files.discover(spark, f"{tmp_path}/*.json").endswith("metadata.json") and files.discover(spark, f"{tmp_path}/*.no", "f") == "f"


def test_tensors_archives_and_audio(spark, tmp_path):
    d = tmp_path / "d"
    d.mkdir()
    np.save(d / "c1.npy", np.arange(6).reshape(2, 3))
    assert files.code_tensors(spark, str(d)).first().codes == [[0, 1, 2], [3, 4, 5]]
    with tarfile.open(d / "t.tar", "w") as t:
        info = tarfile.TarInfo("in/x.txt")
        info.size = 2
        t.addfile(info, io.BytesIO(b"hi"))
    assert [(r.member, bytes(r.content)) for r in archives.tar_members(spark, str(d)).collect()] == [("in/x.txt", b"hi")]
    with wave.open(str(d / "w.wav"), "wb") as w:
        w.setnchannels(2), w.setsampwidth(2), w.setframerate(8000)
        w.writeframes(struct.pack("<4h", 16384, 0, -16384, 0))
    row = files.wav_files(spark, str(d)).first()
    assert row.sample_rate == 8000 and row.channels == [[0.5, -0.5], [0.0, 0.0]]


@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_wav_files_of_all_widths(spark, tmp_path, width):
    top = 1 << (8 * width - 1)
    samples = [0, 1, -1, top - 1, -top, top // 3]
    raw = b"".join((x + top).to_bytes(1) if width == 1 else x.to_bytes(width, "little", signed=True) for x in samples)
    with wave.open(f"{tmp_path}/x.wav", "wb") as w:
        w.setnchannels(2), w.setsampwidth(width), w.setframerate(16000)
        w.writeframes(raw)
    row = files.wav_files(spark, str(tmp_path)).first()
    assert row.channels == [[x / top for x in samples[c::2]] for c in (0, 1)]


def _message(number, body):
    return bytes([number << 3 | 2, len(body)]) + body


def test_packed_sentences(spark, tmp_path):
    sentence = _message(1, "ខ្ញុំ".encode()) + _message(3, _message(1, bytes([5, 0x96, 0x01]))) + _message(3, bytes([8, 7]))
    items = [_message(1, b"src") + _message(4, sentence) + _message(4, _message(1, b"no codes")), b""]
    put(tmp_path / "x" / "a.protos", b"".join(struct.pack("<I", len(i)) + i for i in items))
    got = framed.packed_sentences(spark, str(tmp_path))
    assert [len(r.sentences) for r in got.orderBy("item").collect()] == [2, 0]
    (row,) = files.with_codes(got, 5).collect()
    assert row.texts == ["ខ្ញុំ"] and [s["values"] for s in row.semantics] == [[5, 150], [7]]
    assert jobs.count_sentences(spark, str(tmp_path)).first().n_sentences == 2
    assert tuple(jobs.spot_check(spark, str(tmp_path), 3).first()) == (1, 1, 0)
    put(tmp_path / "y" / "b.protos", struct.pack("<I", 9) + b"ab")
    with pytest.raises(Exception, match="cut off"):
        framed.packed_sentences(spark, str(tmp_path / "y")).collect()


def test_settings(tmp_path):
    put(tmp_path / "base.json", json.dumps({"a": {"x": 1}, "learning_rate": {"lora": 1, "emb": 2}}))
    child = put(tmp_path / "sub" / "c.json", json.dumps({"extends": "../base.json", "a": {"y": 2}, "learning_rate": {"emb": 3}}))
    assert files.load_config(child) == {"a": {"y": 2}, "learning_rate": {"lora": 1, "emb": 3}}
    assert files.rank_environment({}) == (0, 0, 1) and files.rank_environment({"RANK": "1", "LOCAL_RANK": "1", "WORLD_SIZE": "2"}) == (1, 1, 2)
    with pytest.raises(ValueError):
        files.rank_environment({"RANK": "5", "WORLD_SIZE": "2"})


def test_verified_writes(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "a int")
    sinks.verified(df, f"{tmp_path}/t")
    assert sinks.save_best(spark, df, f"{tmp_path}/t", 2.0, 1.0) == 1.0 and sinks.save_best(spark, df.unionAll(df), f"{tmp_path}/t", 0.5, 1.0) == 0.5
    assert spark.read.parquet(f"{tmp_path}/t").count() == 2
    with pytest.raises(ValueError):
        sinks.verified(df, f"{tmp_path}/t", ("b",))
    assert sinks.remove(spark, f"{tmp_path}/t") and not sinks.remove(spark, f"{tmp_path}/t")


def test_a_replacement_that_broke_off(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "a int")
    sinks.verified(df, f"{tmp_path}/t")
    (tmp_path / "t").rename(tmp_path / "t.old")
    assert sinks.restored(spark, f"{tmp_path}/t") and spark.read.parquet(f"{tmp_path}/t").count() == 1
    sinks.verified(df.unionAll(df), f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 2 and not sinks.restored(spark, f"{tmp_path}/none")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["t"]


def test_documents_are_replaced(spark, tmp_path):
    for value in (1, 2):
        sinks.write_document(spark, f"{tmp_path}/d.json", {"v": value})
        assert json.loads((tmp_path / "d.json").read_text()) == {"v": value}
    assert not [p for p in tmp_path.iterdir() if p.name.endswith(".tmp")]
    index = spark.createDataFrame([("b", "t", 1.5, 16000, "train", "v1"), ("a", None, 2.0, 16000, "train", "v1")], schemas.CACHE_INDEX)
    sinks.cache_index_document(index, f"{tmp_path}/i.json")
    data = json.loads((tmp_path / "i.json").read_text())
    assert list(data) == ["a", "b"] and "clip_id" not in data["b"] and data["b"]["text"] == "t"
    assert sorted(map(tuple, files.cache_index(spark, f"{tmp_path}/i.json").select("clip_id", "duration_seconds").collect())) == [("a", 2.0), ("b", 1.5)]


def test_audio_round_trip_and_transfer(spark, tmp_path):
    clips = [("a", 8000, [[0.5, -0.5, 0.25]]), ("b", 16000, [[0.0, 1.0], [-1.0, 0.125]])]
    rows = spark.createDataFrame(clips, "clip_id string, sample_rate int, channels array<array<double>>")
    made = sinks.wav_files(rows, f"file://{tmp_path}/in").collect()
    assert sorted((r.clip_id, r.file, (tmp_path / "in" / r.file).stat().st_size == r.bytes) for r in made) == [("a", "a.wav", True), ("b", "b.wav", True)]
    back = {r.sample_rate: r.channels for r in files.wav_files(spark, f"{tmp_path}/in").collect()}
    assert back == {8000: [[0.5, -0.5, 0.25]], 16000: [[0.0, 32767 / 32768], [-1.0, 0.125]]}
    put(tmp_path / "in" / "deep" / "c.txt", "hi")
    listed = spark.createDataFrame([("a.wav",), ("b.wav",), ("deep/c.txt",), ("a.wav",)], "file string")
    for _ in range(2):
        got = sorted(map(tuple, sinks.transferred(listed, f"file://{tmp_path}/in", f"file://{tmp_path}/out", per_task=1).collect()))
        assert got == [(n, (tmp_path / "in" / n).stat().st_size) for n in ("a.wav", "b.wav", "deep/c.txt")]
        assert all((tmp_path / "in" / n).read_bytes() == (tmp_path / "out" / n).read_bytes() for n, _ in got)


def test_file_order(spark):
    rows = spark.createDataFrame([("b.proto",), ("c.protos",), ("a.proto",), ("d.protos",)], "f string")
    assert [r.f for r in rows.orderBy(*files.listed_order(F.col("f"))).collect()] == ["c.protos", "d.protos", "a.proto", "b.proto"]


def test_an_endless_stream(spark, tmp_path):
    seen = []
    query = watch.watch(watch.endless(spark, spark.range(3)), f"{tmp_path}/log", lambda batch, n: seen.append((n, batch.count(), batch.select("round").distinct().count())), every="0 seconds")
    import time

    for _ in range(300):
        if len(seen) >= 3:
            break
        time.sleep(0.1)
    query.stop()
    assert [x[1:] for x in seen[:3]] == [(3, 1)] * 3


def test_jobs(spark, tmp_path, capsys):
    put(tmp_path / "m.json", json.dumps([{"clip_id": f"c{i}", "text": "t" * (600 * (i % 2) + 1), "audio_path": "a", "duration_seconds": 2.0, "sample_rate": 24000} for i in range(40)]))
    assert sum(r.n for r in jobs.make_splits(spark, f"{tmp_path}/m.json", f"{tmp_path}/s", 0.3).collect()) == 40
    assert jobs.validate_manifest(spark, f"{tmp_path}/m.json").first().report == "20/40 samples passed validation.\n  text_too_long: 20"
    assert jobs.plan_precompute(spark, f"{tmp_path}/m.json", 20, f"{tmp_path}/none").count() == 1
    put(tmp_path / "e.json", json.dumps([{"id": "e1", "text": "5", "category": "short"}, {"id": "e2", "text": "x"}]))
    assert jobs.make_template(spark, f"{tmp_path}/e.json", ["E1", "E2"], f"{tmp_path}/csv").count() == 8
    back = files.scores(spark, f"{tmp_path}/csv")
    assert back.count() == 8 and back.where("pronunciation is null or category is null").count() == 0
    assert jobs.summarize(spark, f"{tmp_path}/csv").count() == 2
    assert {r.normalized for r in jobs.normalize_sentences(spark, f"{tmp_path}/e.json", f"{tmp_path}/n").collect()} == {"ប្រាំ", "x"}
    assert jobs.main(["normalize-line", "7 x"]) == 0 and "ប្រាំពីរ x" in capsys.readouterr().out


def test_conversion_job(spark, tmp_path):
    for split, n in (("train", 3), ("dev", 2)):
        put(tmp_path / f"{split}.tsv", "/r\n" + "".join(f"{split}/u{i}.wav\t{16000 + i * 8}\n" for i in range(n)))
        put(tmp_path / f"{split}.wrd", "".join(f"text {i}\n" for i in range(n)))
        for i in range(n):
            if (split, i) != ("train", 1):
                put(tmp_path / "audio" / split / f"u{i}.wav", b"x")
    put(tmp_path / "data" / "ddd_speaker_ids.json", json.dumps({"0": ["s"]}))
    totals = jobs.convert_manifest(spark, f"{tmp_path}", f"{tmp_path}/out", 16000, "src").first()
    assert (totals.clips, totals.train, totals.validation, totals.with_speaker) == (4, 2, 2, 2)


def test_streams_resume_and_skip(spark, tmp_path):
    source, out, log = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/log"
    write = lambda rows: spark.createDataFrame(rows, "run string, step bigint, at bigint").coalesce(1).write.mode("append").parquet(source)
    write([("r", 0, 0), ("r", 5, 1), ("r", 5, 2), ("r", 6, 3)])
    stream = lambda: watch.new_steps(watch.folder_stream(spark, source, "run string, step bigint, at bigint"), "run", "step", "at")
    watch.run_available(stream(), log, watch.idempotent(out))
    write([("r", 6, 4), ("r", 7, 5)])
    watch.run_available(stream(), log, watch.idempotent(out))
    watch.run_available(stream(), log, watch.idempotent(out))
    assert sorted(r.step for r in spark.read.parquet(out).collect()) == [5, 6, 7]


def test_count_batches(spark, tmp_path):
    """Values count by their order column, whatever order the shuffle brings them in; a rest waits for the next trigger."""
    write = lambda rows: spark.createDataFrame(rows, "k string, v double, at bigint").repartition(3).write.mode("append").parquet(f"{tmp_path}/in")
    rows = [(k, float(i * 10), i) for k in "kl" for i in (5, 0, 3, 6, 1, 4, 2)]
    write(rows)
    run = lambda: watch.run_available(watch.count_batches(watch.folder_stream(spark, f"{tmp_path}/in", "k string, v double, at bigint"), "k", "v", 3, "at"), f"{tmp_path}/log", watch.idempotent(f"{tmp_path}/out"))
    run()
    write([("k", 90.0, 8), ("k", 80.0, 7)])
    run()
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("k", "micro_batch", "mean").collect()) == [("k", 0, 10.0), ("k", 1, 40.0), ("k", 2, 230 / 3), ("l", 0, 10.0), ("l", 1, 40.0)]
    assert watch.cycled(spark, spark.range(3), 2).count() == 6


def test_a_busy_sink_skips():
    import threading

    gate, seen = threading.Event(), []
    sink = watch.SkipIfBusy(lambda x: (gate.wait(5), seen.append(x)))
    assert sink(1) and not sink(2)
    gate.set()
    sink.wait()
    assert seen == [1] and sink(3)
    sink.wait()
    failing = watch.SkipIfBusy(lambda: 1 / 0)
    failing()
    failing.wait()
    assert len(failing.errors) == 1


def test_log_lines(spark, tmp_path):
    sinks.log_lines(spark.createDataFrame([(5,)], "step int"), f"{tmp_path}/log", "concat('step ', step)")
    assert spark.read.text(f"{tmp_path}/log").first().value.endswith("Z  step 5")
    assert spark.range(1).select(F.lit(1)).count() == 1


def test_tasks_follow_bytes_not_blocks(spark, tmp_path):
    """Many small blocks go together, and bytes beyond a task's share keep every core busy."""
    from millrace.sources import json_arrays, ranges

    cores, schema = spark.sparkContext.defaultParallelism, spark.sql("SELECT 1 AS i").schema
    (tmp_path / "a.json").write_text("[" + ",".join(f'{{"i": {i}}}' for i in range(3000)) + "]")
    found = json_arrays.records(spark, str(tmp_path), schema, block_bytes=64)
    assert found.rdd.getNumPartitions() <= 4 * cores
    assert sorted(r.i for r in found.collect()) == list(range(3000))
    pieces = spark.range(100).selectExpr("'f' AS file", "id * 10 AS at", "10L AS size")
    assert ranges.dealt(pieces, 900).rdd.getNumPartitions() >= cores
