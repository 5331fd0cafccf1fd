"""Operators on small literal inputs, with their errors."""

import pytest
from pyspark.sql import functions as F

from millrace import schemas
from millrace.functions import arrays, numeric, tokens
from millrace.operators import batches, cache, checkpoints, conversion, metrics, scores, shards, splits, validate


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_validation_cases(spark):
    rows = [
        ("c1", "ខ្ញុំសុខសប្បាយទេ។", "a.wav", 3.0, 24000), ("c2", "", "b.wav", None, None), ("c3", "hello", None, None, None), ("c4", "x" * 501, "d.wav", None, None),
        ("c5", "ok", "e.wav", 0.05, None), ("c6", "", None, None, None), ("c7", "ok", "f", 0.3, None), ("c8", "ok", "f", 30.0, 24000), ("c9", "ok", "f", 30.1, None), (None, " \xa0　", "f", 1.0, 24000), ("d1", "ok", "f", 1.0, 16000),
    ]
    m = spark.createDataFrame(rows, "clip_id string, text string, audio_path string, duration_seconds double, sample_rate int")
    got = {r.clip_id: r.reason for r in validate.validate(m).collect()}
    assert got == {"c1": None, "c2": "empty_text", "c3": "missing_audio_path", "c4": "text_too_long", "c5": "audio_too_short", "c6": "missing_audio_path", "c7": None, "c8": None, "c9": "audio_too_long", "<unknown>": "empty_text", "d1": "unexpected_sample_rate_16000"}
    first = validate.validate(m.limit(5))
    assert validate.report(first).first().report.startswith("1/5 samples passed validation.\n")
    ids = F.array(F.lit(1), F.lit(99))
    assert validate.validate(m.where("clip_id = 'c1'"), ids=ids, vocab_size=50).first().reason == "invalid_token_id_range"
    assert validate.validate(m.where("clip_id = 'c1'"), ids=F.slice(ids, 1, 0), vocab_size=50).first().reason == "empty_token_ids"
    assert validate.validate(m.where("clip_id = 'c1'"), found=F.lit(False)).first().reason == "audio_file_not_found"


def test_split_threshold_is_truncated(spark):
    assert int(0.0003 * 10_000) == 2
    ids = spark.range(5000).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("clip_id"))
    import hashlib

    for share in (0.0003, 0.02, 0.5):
        got = {r.clip_id: r.split for r in splits.assign_splits(ids, share).collect()}
        assert got == {c: "validation" if int(hashlib.sha256(c.encode()).hexdigest()[:8], 16) % 10_000 < int(share * 10_000) else "train" for c in got}
    assert values(splits.split_counts(splits.assign_splits(ids.limit(0), 0.5))) == [("train", 0), ("validation", 0)]


@pytest.mark.parametrize("size", [7, 50, 1000])
def test_shards_over_partitions(spark, size):
    """Any number of range partitions packs like one pass over the order."""
    import hashlib

    rows = [(f"clip_{i:04d}", float(i % 9)) for i in range(300)]
    got = {r.clip_id: r.shard for r in shards.plan_shards(spark.createDataFrame(rows, "clip_id string, duration_seconds double"), 20, 1.0, partition_clips=size).collect()}
    want, used, shard, held = {}, 0, 0, False
    for c, d in sorted(rows, key=lambda x: hashlib.sha256(x[0].encode()).hexdigest()):
        if used + int(d) > 20 and held:
            shard, used = shard + 1, 0
        want[c], used, held = shard, used + int(d), True
    assert got == want


def test_shard_errors_and_progress(spark):
    with pytest.raises(Exception, match="exceeds the shard budget"):
        shards.plan_shards(spark.createDataFrame([("a", 50.0)], "clip_id string, duration_seconds double"), 20, 1.0).collect()
    assert shards.plan_shards(spark.createDataFrame([], "clip_id string, duration_seconds double"), 20, 1.0).count() == 0
    assert numeric.available_bytes(20 * 1024**3) == 14 * 1024**3
    with pytest.raises(ValueError):
        numeric.available_bytes(6 * 1024**3)
    done = spark.createDataFrame([(2,), (0,)], "shard_index int")
    assert [r[0] for r in shards.complete(done, done).collect()] == [0, 2]


def test_extended_ids(spark):
    one = spark.createDataFrame([(0,), (7999,)], "i int")
    ext = one.select(tokens.to_extended(F.col("i"), 32_000).alias("e"))
    assert values(ext) == [(32000,), (39999,)]
    assert values(ext.select(tokens.from_extended(F.col("e"), 32_000))) == [(0,), (7999,)]
    assert values(ext.limit(1).select(tokens.is_extended(F.lit(32_000), 32_000), tokens.is_extended(F.lit(31_999), 32_000))) == [(True, False)]
    assert tokens.vocabulary_total(32_000) == 40_000 and tokens.no_collision(32_000)
    for bad in (tokens.to_extended(F.lit(8000), 32_000), tokens.from_extended(F.lit(40_000), 32_000), tokens.from_extended(F.lit(5), 32_000), tokens.checked_ids(F.array(F.lit(-1)), 10)[0]):
        with pytest.raises(Exception, match="id"):
            one.select(bad).collect()
    assert values(spark.range(1).select(F.transform(tokens.drop_reserved(F.array(*map(F.lit, (0, 4, 5, 1, 9)))), lambda i: i + 32_000))) == [([32005, 32009],)]


def test_mixed_texts_round_trip(spark):
    texts = [(0, "ខ្ញុំ ok ស"), (1, "plain"), (2, ""), (3, "៛5។ok")]
    rows = spark.createDataFrame(texts, "i int, t string")
    vocab = tokens.char_vocabulary(rows.select("i", F.explode(tokens.script_runs(F.col("t"))).alias("r")).where("r.kind = 'khmer'").select("i", F.col("r.chunk").alias("t")), "t", "i")
    both = vocab.agg(F.map_from_entries(F.collect_list(F.struct("char", "id"))).alias("enc"), F.map_from_entries(F.collect_list(F.struct("id", "char"))).alias("dec"))
    enc = rows.crossJoin(both).select("i", "t", "dec", tokens.encode_mixed(F.col("t"), F.col("enc"), 32_000).alias("ids"))
    got = enc.select("i", tokens.decode_mixed(F.col("ids"), F.col("dec"), 32_000).alias("t"), tokens.ids_in_range("ids", 40_000).alias("ok"))
    assert values(got) == [(i, t, True) for i, t in texts]
    assert [(r["kind"], r["chunk"]) for r in rows.where("i = 3").select(tokens.script_runs(F.col("t")).alias("r")).first().r] == [("khmer", "៛"), ("other", "5"), ("khmer", "។"), ("other", "ok")]


def test_padding(spark):
    pad = lambda xs, m: spark.createDataFrame([(x,) for x in xs], "n int").agg(arrays.padded_length(F.max("n"), m).alias("p")).first().p
    assert (pad([3, 2, 4], 1), pad([3, 2, 4], 8), pad([], 4)) == (4, 8, 0)
    rows = spark.createDataFrame([(0, [1, 2, 3], [1, 2, 3]), (0, [4], [4]), (1, [], [])], "b int, ids array<int>, labels array<int>")
    got = batches.pad_batches(rows, "b", "ids", "labels", multiple=2, most=2).select("b", "input_ids", "padded_labels", "attention_mask")
    assert values(got) == [(0, [1, 2], [1, 2], [1, 1]), (0, [4, 0], [4, -100], [1, 0]), (1, [], [], [])]


def test_learning_rates(spark):
    stages = spark.createDataFrame([("E", "lora", 2000, 10000, 35000, 5e-5, 1e-4, 1e-5), ("E", "none", 0, 0, 0, 5e-5, 1e-4, 1e-5)], schemas.SCHEDULE)
    steps = spark.createDataFrame([(s,) for s in (0, 1000, 2000, 10000, 20000, 35000, 40000)], "step int")
    got = {(r.param_group, r.step): r.lr for r in steps.crossJoin(stages).select("param_group", "step", numeric.learning_rate(F.col("step")).alias("lr")).collect()}
    for step, lr in ((0, 5e-5), (2000, 1e-4), (10000, 1e-4), (35000, 1e-5), (40000, 1e-5)):
        assert abs(got["lora", step] - lr) < 1e-12
    assert got["lora", 1000] < got["lora", 2000] and got["lora", 20000] < got["lora", 10000] and got["none", 0] == 1e-4
    with pytest.raises(ValueError):
        numeric.check_schedule(5, 4, 6)


def test_durations_round_by_their_binary_value(spark):
    """Every half millisecond up to 20 seconds at three rates, and lengths between them."""
    values_ = [(k * r // 2000, r) for r in (16_000, 24_000, 48_000) for k in range(1, 40_001, 2)] + [(n, r) for r in (16_000, 22_050, 44_100) for n in range(0, 200_000, 97)] + [(0, 16_000), (10**12 + 8, 16_000)]
    rows = spark.createDataFrame(values_, "n bigint, r int")
    got = rows.select("n", "r", numeric.duration_seconds(F.col("n"), F.col("r")).alias("d")).collect()
    assert [x for x in got if x.d != round(x.n / x.r, 3)] == []


def test_cache(spark):
    old = spark.createDataFrame([("a", "v1", 1), ("b", "v1", 2)], "clip_id string, codec_revision string, n int")
    new = spark.createDataFrame([("b", "v1", 3), ("c", "v2", 4)], "clip_id string, codec_revision string, n int")
    merged = cache.upsert(old, new)
    assert values(merged) == [("a", "v1", 1), ("b", "v1", 3), ("c", "v2", 4)]
    ask = lambda *k: spark.createDataFrame([(x,) for x in k], "clip_id string")
    assert cache.lookup(ask("a", "b"), merged, "v1").count() == 2
    for key, what in (("z", "not cached"), ("c", "another revision")):
        with pytest.raises(Exception, match=what):
            cache.lookup(ask(key), merged, "v1").collect()


def test_metadata(spark):
    row = dict(architecture_version="a", base_model="b", tokenizer="t", dataset="d", vocab_size=1)
    make = lambda **k: spark.createDataFrame([{**row, **k}])
    checkpoints.check_compatible(make(), make())
    with pytest.raises(ValueError, match="architecture_version: 'a' and 'z'"):
        checkpoints.check_compatible(make(), make(architecture_version="z"))


def test_conversion_errors_and_stems(spark):
    rows = spark.createDataFrame([(p,) for p in ("a/b.c.flac", ".flac", "x/y", "z.wav")], "p string")
    assert [r.s for r in rows.select(conversion.stem(F.col("p")).alias("s")).collect()] == ["b.c", ".flac", "y", "z"]
    a = spark.createDataFrame([("train", i, f"{i}.wav", 5) for i in range(3)], "split string, ordinal int, relpath string, num_samples int")
    b = spark.createDataFrame([("train", i, "t") for i in range(2)], "split string, ordinal int, text string")
    with pytest.raises(Exception, match="differ in number"):
        conversion.zipped(a, b).collect()


def test_scores(spark):
    cell = ("4", "4", "4", "1")
    rows = [("s", "c", "E1", "l", *cell, ""), ("s", "c", "E1", "l", "4.0", "3.8", "3.8", "1", ""), ("s", "c", "E2", "l", "", "", "", "", ""), ("s", "c", "E3", "l", "5", "5", "5", "0", "")]
    got = {r.experiment_id: r for r in scores.summarize(spark.createDataFrame(rows, schemas.SCORE)).collect()}
    assert got["E1"].passes_release_gate and got["E1"].n_scored == 2
    assert got["E2"].n_scored == 0 and got["E2"].pronunciation == 0 and got["E2"].failed_gates == ["pronunciation", "naturalness", "english_preservation"]
    assert got["E3"].failed_gates == [] and not got["E3"].passes_release_gate and got["E3"].severe_artifact_count == 1


def test_metrics(spark):
    v = spark.createDataFrame([(i, x) for i, x in enumerate((3.0, 2.0, 2.0, float("nan"), 1.0))], "i int, v double")
    assert [r.improved for r in metrics.best_so_far(v, "v", "i").orderBy("i").collect()] == [True, True, False, False, True]
    r = spark.createDataFrame([(0, 1.0), (1, 2.0), (1, 4.0), (1, 6.0)], "rank int, v double")
    assert metrics.mean_of_means(r, "rank", "v").first().mean == 2.5
    assert metrics.capped_mean(r.limit(0), "v", "rank").first().mean == 0.0
    s = spark.createDataFrame([(i, x) for i, x in enumerate((0, 5, 5, 6, 5, 0, 5))], "i int, step int")
    assert [x.i for x in metrics.new_steps(s, "step", "i").orderBy("i").collect()] == [1, 3, 4]
    codes = spark.createDataFrame([([[1, 2], [3]],), ([[1], [2]],), ([],)], "codes array<array<int>>")
    assert tuple(metrics.codec_tally(codes).first()) == (2, 1, 1)
    audio = spark.createDataFrame([([0.0, 0.0],), ([1.0, float("nan")],), ([0.5, -0.5],)], "x array<double>")
    assert [(r.finite, r.silent) for r in metrics.audio_check(audio, "x").collect()] == [(True, True), (False, False), (True, False)]
    assert metrics.trainable_parameters(spark.createDataFrame([], "name string, n bigint")).first().percent == 0.0


def test_global_ordinals(spark):
    rows = spark.range(500).select(((F.col("id") * 7919) % 500).alias("v"))
    assert values(batches.ordinals(rows, "v")) == [(i, i) for i in sorted(range(500), key=lambda i: repr((i, i)))]


def test_global_order_with_other_columns(spark):
    """A million rows with a payload: each place once, in order; the same for what is carried over ranges."""
    rows = spark.range(1_000_000, numPartitions=16).select((F.xxhash64("id") % 1_000_003).alias("v"), F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("payload"))
    placed = batches.ordinals(rows, "v", "k")
    got = placed.agg(F.count_distinct("ordinal").alias("n"), F.min("ordinal").alias("lo"), F.max("ordinal").alias("hi"), F.count_if(F.sha2(F.col("k").cast("string"), 256) != F.col("payload")).alias("torn")).first()
    assert tuple(got) == (1_000_000, 0, 999_999, 0) and placed.columns == ["v", "k", "payload", "ordinal"]
    assert placed.orderBy("ordinal").limit(50).select("v").collect() == rows.orderBy("v", "k").limit(50).select("v").collect()
    few = spark.range(3000).select("id", (F.floor(F.col("id") / 700) % 3).alias("step"), F.when(F.col("id") % 5 == 0, float("nan")).otherwise(F.abs(F.col("id") - 1500).cast("double")).alias("v"), F.timestamp_seconds(F.col("id") * F.col("id")).alias("ts"))
    everything = few.withColumn("all", F.lit(0))
    for find in (lambda d, *by: metrics.best_so_far(d, "v", "id", *by), lambda d, *by: metrics.new_steps(d, "step", "id", *by), lambda d, *by: metrics.elapsed(d, "ts", *by)):
        assert values(find(few).drop("v", "ts")) == values(find(everything, "all").drop("all", "v", "ts"))


def test_encoder_slots(spark):
    texts = [(0, "ខ្ញុំ ok ស"), (1, "plain"), (2, ""), (3, "៛5។ok"), (4, None)]
    rows = spark.createDataFrame(texts, "i int, t string")
    base, added = tokens.python_encoder(lambda t: [7 + ord(c) for c in t]), tokens.python_encoder(lambda t: [1] + [ord(c) - 6000 for c in t])
    enc = rows.select("i", tokens.encode_with(F.col("t"), base, added, 32_000).alias("ids"))
    khmer = lambda c: "\u1780" <= c <= "\u17ff" or "\u19e0" <= c <= "\u19ff"
    assert values(enc) == [(i, None if t is None else [32_000 + ord(c) - 6000 if khmer(c) else 7 + ord(c) for c in t]) for i, t in texts]
    back = spark.createDataFrame(enc.collect(), enc.schema).select("i", tokens.decode_with(F.col("ids"), lambda r: "".join(chr(i - 7) for i in r), lambda r: "".join(chr(i + 6000) for i in r), 32_000))
    assert values(back) == texts
    mixed = rows.select("i", tokens.encode_with(F.col("t"), tokens.byte_encoder(32_000), added, 32_000).alias("ids")).where("i = 3").first().ids
    assert mixed == [32_000 + ord("៛") - 6000, 3 + ord("5"), 32_000 + ord("។") - 6000, 3 + ord("o"), 3 + ord("k")]


def test_collating_slot(spark):
    rows = spark.createDataFrame([(0, 5), (0, 7), (1, 9)], "batch int, n int")
    assert values(batches.collated(rows, "batch", lambda d: d.groupby("batch", as_index=False).agg(longest=("n", "max")), "batch int, longest int")) == [(0, 7), (1, 9)]


def test_id_runs_of_long_arrays(spark):
    import time

    began = time.time()
    rows = spark.range(2).select(F.transform(F.sequence(F.lit(0), F.lit(63_999)), lambda i: (i * 7919 % 40_000).cast("int")).alias("ids"))
    got = rows.select(tokens.id_runs(F.col("ids"), 32_000).alias("r")).select(F.size("r").alias("n"), F.aggregate("r", F.lit(0), lambda s, x: s + F.size(x["ids"])).alias("total")).collect()
    ids = [i * 7919 % 40_000 >= 32_000 for i in range(64_000)]
    assert [tuple(x) for x in got] == [(1 + sum(a != b for a, b in zip(ids, ids[1:])), 64_000)] * 2
    assert time.time() - began < 30


def test_samples_of_a_shard(spark):
    shard = spark.createDataFrame([(0, ["b", "a", "x"]), (1, ["c"])], "index int, clip_ids array<string>")
    samples = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "clip_id string, n int")
    names = spark.createDataFrame([("a", "train"), ("b", "validation")], "clip_id string, split string")
    assert values(shards.shard_samples(shard, samples, names).select("index", "place", "clip_id", "n", "split")) == [(0, 0, "b", 2, "validation"), (0, 1, "a", 1, "train")]


def test_a_missing_schedule_is_an_error(spark):
    stages = spark.createDataFrame([("E", "lora", 2000, 10000, 35000, 5e-5, 1e-4, 1e-5)], schemas.SCHEDULE)
    steps = spark.createDataFrame([("E", "lora", 2000), ("F", "lora", 5)], "experiment_id string, param_group string, step int")
    plan = metrics.scheduled_rates(steps.limit(1), stages)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    assert metrics.scheduled_rates(steps.limit(1), stages).first().lr == 1e-4
    with pytest.raises(Exception, match="no schedule for F, lora"):
        metrics.scheduled_rates(steps, stages).collect()


def test_later_outcomes_of_validation(spark):
    m = spark.createDataFrame([("c", "text", "a", 3.0, 24000)], "clip_id string, text string, audio_path string, duration_seconds double, sample_rate int")
    one = lambda **k: validate.validate(m, **k).first().reason
    assert one(normalized=F.lit(None).cast("string"), ids=F.array()) == "normalize_failed"
    assert one(normalized=F.col("text"), ids=F.lit(None).cast("array<int>")) == "tokenizer_failed"
    assert one(ids=F.array(F.lit(5), F.lit(-1)), base_size=32_000) == "vocabulary_collision"
    assert one(ids=F.array(F.lit(5), F.lit(33_000)), vocab_size=40_000, base_size=32_000) is None


def test_ranks_are_disjoint(spark):
    rows = spark.range(100).withColumnRenamed("id", "k")
    parts = [{r.k for r in batches.rank_rows(rows, "k", 3, i, seed=1, epoch=2).collect()} for i in range(3)]
    assert sum(map(len, parts)) == 100 and set.union(*parts) == set(range(100))
    assert [r.k for r in batches.epoch_order(rows, "k", 1, 0).collect()] != [r.k for r in batches.epoch_order(rows, "k", 1, 1).collect()]


def test_planning_arithmetic():
    assert numeric.sentences_per_item(400) == 20 and numeric.effective_batch(2, 8, 2) == 32 and numeric.rank_seed(42, 3) == 45
    assert numeric.sessions_needed(40_000, 1.5, 30_000) == 2.0


def test_ties_of_reasons_stand_in_the_order_of_the_manifest(spark, tmp_path):
    """z, without a text, comes first and a, without a path, second: both once."""
    import json

    from millrace.sources import files

    rows = [{"clip_id": "z", "text": "", "audio_path": "p"}, {"clip_id": "a", "text": "t"}, {"clip_id": "b", "text": "t", "audio_path": "p", "duration_seconds": 0.1}]
    (tmp_path / "m.json").write_text(json.dumps(rows))
    found = validate.validate(files.manifest(spark, f"{tmp_path}/m.json", place="place", block_bytes=16), place="place")
    assert validate.report(found, "place").first().report == "0/3 samples passed validation.\n  empty_text: 1\n  missing_audio_path: 1\n  audio_too_short: 1"
    assert [r.reason for r in validate.summary(found, "place").collect()] == ["empty_text", "missing_audio_path", "audio_too_short"]


def plain_places(n, seed, epoch):
    """The permutation over all ordinals, by its own loop."""
    import numpy as np

    a, b, keys = batches.permutation_keys(n, seed, epoch)
    todo, places = np.arange(n), np.arange(n)
    steps = 0
    while len(todo):
        x = places[todo]
        left, right = x // b, x % b
        for k, (u, v, w) in enumerate(keys):
            hashed = lambda y: (y * u + v) % (2**31 - 1) * w % (2**31 - 19)  # noqa: B023, E731
            left, right = ((left + hashed(right)) % a, right) if k % 2 == 0 else (left, (right + hashed(left)) % b)
        places[todo] = left * b + right
        todo = todo[places[todo] >= n]
        steps += 1
    return places, steps


def test_every_size_is_permuted():
    import numpy as np

    for n in range(1, 5001):
        places, steps = plain_places(n, n % 7, n % 3)
        assert steps <= batches._WALKS and (np.bincount(places, minlength=n) == 1).all()


@pytest.mark.parametrize("n", [1, 2, 3, 10, 17, 1000, 4093])
def test_the_expression_is_that_permutation(spark, n):
    got = spark.range(n).select("id", batches.shuffled_place(F.col("id"), n, 4, 2).alias("p")).collect()
    want, _ = plain_places(n, 4, 2)
    assert {r.id: r.p for r in got} == dict(enumerate(want.tolist()))
    other = spark.range(n).select(batches.shuffled_place(F.col("id"), n, 4, 3).alias("p")).collect()
    assert n < 10 or [r.p for r in other] != want.tolist()


@pytest.mark.parametrize("n,ranks", [(0, 3), (1, 4), (10, 1), (10, 3), (5, 13), (100, 8)])
def test_ranks_get_equal_shares(spark, n, ranks):
    got = batches.rank_shares(spark.range(n), "id", n, ranks, 1, 1)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    rows = got.collect()
    each = -(-n // ranks)
    assert sorted((r["rank"], r.step) for r in rows) == [(k, i) for k in range(ranks) for i in range(each)]
    assert {r.id for r in rows} == set(range(n)) and len(rows) - n < ranks


def test_chains_inside_a_part():
    import numpy as np

    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 50, 400):
        sizes = rng.integers(0, 21, n)
        begun, used = shards.chains(sizes, 20)
        for j in range(n):
            starts = shards.next_fit(sizes[j:], 20)
            assert (begun[j], used[j]) == (len(starts) + 1, sizes[j + (starts[-1] if starts else 0) :].sum())


def test_many_parts_equal_one_walk(spark):
    """Parts of a few shards each, also very uneven ones."""
    import hashlib
    import random

    rng = random.Random(9)
    for rows in ([(f"c{i}", float(rng.choice([0, 1, 2, 3, 19, 20]))) for i in range(3000)], [(f"c{i}", 20.0 if i % 500 == 0 else 0.0) for i in range(3000)]):
        want, used, shard = {}, 0, 0
        for c, d in sorted(rows, key=lambda x: hashlib.sha256(x[0].encode()).hexdigest()):
            if used + d > 20:
                shard, used = shard + 1, 0
            want[c], used = shard, used + d
        got = {r.clip_id: r.shard for r in shards.plan_shards(spark.createDataFrame(rows, "clip_id string, duration_seconds double"), 20, 1.0, partition_clips=40).collect()}
        assert got == want
