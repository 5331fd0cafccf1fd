"""Declared schemas of the tables that jobs read and write."""

from __future__ import annotations

from pyspark.sql import types as T

MANIFEST = T.StructType([
    T.StructField("clip_id", T.StringType(), False),
    T.StructField("text", T.StringType()),
    T.StructField("split", T.StringType()),
    T.StructField("audio_path", T.StringType()),
    T.StructField("duration_seconds", T.DoubleType()),
    T.StructField("sample_rate", T.IntegerType()),
    T.StructField("speaker", T.StringType()),
    T.StructField("source", T.StringType()),
])
RAW_MANIFEST = T.StructType([f for f in MANIFEST if f.name != "split"])
CACHE_RECORD = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("duration_seconds", T.DoubleType()),
    T.StructField("sample_rate", T.IntegerType()),
    T.StructField("split", T.StringType()),
    T.StructField("codec_revision", T.StringType()),
])
CACHE_INDEX = T.StructType([T.StructField("clip_id", T.StringType(), False), *CACHE_RECORD])
SEMANTIC_CODES = T.StructType([T.StructField("clip_id", T.StringType(), False), T.StructField("codes", T.ArrayType(T.ArrayType(T.ShortType())))])
SHARD = T.StructType([T.StructField("index", T.IntegerType(), False), T.StructField("clip_ids", T.ArrayType(T.StringType())), T.StructField("total_audio_bytes", T.LongType())])
PROGRESS = T.StructType([T.StructField("completed_shard_indices", T.ArrayType(T.IntegerType()))])
SENTENCE = T.StructType([T.StructField("texts", T.ArrayType(T.StringType())), T.StructField("semantics", T.ArrayType(T.StructType([T.StructField("values", T.ArrayType(T.IntegerType()))])))])
EVAL_SENTENCE = T.StructType([T.StructField("id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("category", T.StringType())])
RUBRIC = ("pronunciation", "naturalness", "english_preservation", "no_severe_artifacts")
SCORE = T.StructType([T.StructField(c, T.StringType()) for c in ("sentence_id", "category", "experiment_id", "listener", *RUBRIC, "notes")])
SCHEDULE = T.StructType([
    T.StructField("experiment_id", T.StringType()), T.StructField("param_group", T.StringType()),
    T.StructField("warmup_end", T.IntegerType()), T.StructField("stable_end", T.IntegerType()), T.StructField("decay_end", T.IntegerType()),
    T.StructField("start_lr", T.DoubleType()), T.StructField("peak_lr", T.DoubleType()), T.StructField("end_lr", T.DoubleType()),
])
METADATA = T.StructType([
    T.StructField("project", T.StringType()), T.StructField("architecture_version", T.StringType()), T.StructField("global_step", T.LongType()), T.StructField("epoch", T.LongType()),
    T.StructField("best_val_loss", T.DoubleType()), T.StructField("latest_checkpoint", T.StringType()), T.StructField("best_checkpoint", T.StringType()),
    T.StructField("checkpoint_interval", T.LongType()), T.StructField("validation_interval", T.LongType()), T.StructField("experiment_id", T.StringType()), T.StructField("last_checkpoint_time", T.StringType()),
    T.StructField("base_model", T.StringType()), T.StructField("tokenizer", T.StringType()), T.StructField("dataset", T.StringType()), T.StructField("vocab_size", T.LongType()), T.StructField("hidden_dim", T.LongType()),
    T.StructField("lora", T.MapType(T.StringType(), T.StringType())), T.StructField("last_val_loss", T.DoubleType()),
])
