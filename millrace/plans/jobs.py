"""Batch jobs: ``python -m millrace.plans.jobs JOB ...``.

Each job reads its inputs through Spark, applies the operators and writes one
result.  Paths may be in any store that the session reaches.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import numeric, text
from millrace.operators import conversion, metrics, scores, shards, splits, validate
from millrace.sources import files, framed, sinks


def make_splits(spark: SparkSession, manifest: str, out: str, validation_share: float = 0.02) -> DataFrame:
    """A manifest with a split column, and the counts by split."""
    assigned = splits.assign_splits(files.raw_manifest(spark, manifest), validation_share)
    sinks.manifest(assigned, out)
    return splits.split_counts(files.manifest(spark, out, schema=assigned.schema))


def convert_manifest(spark: SparkSession, root: str, out: str, sample_rate: int, source: str, speakers: str = "data/ddd_speaker_ids.json") -> DataFrame:
    """Sample lists and transcripts below ``root`` as one manifest, and its totals; ``speakers`` is a file below ``root`` and may be missing."""
    samples, lines = None, None
    for name in conversion.SPLIT_NAMES:
        s = files.sample_list(spark, f"{root}/{name}.tsv").withColumn("split", F.lit(name))
        t = files.transcripts(spark, f"{root}/{name}.wrd").withColumn("split", F.lit(name))
        samples, lines = (s, t) if samples is None else (samples.unionByName(s), lines.unionByName(t))
    audio_root = f"{root}/audio"
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(audio_root).select(F.regexp_extract("path", r".*/audio/(.*)", 1).alias("relpath"))
    rows = conversion.convert(samples, lines, files.speakers(spark, f"{root}/{speakers}"), listed, audio_root, sample_rate, source)
    sinks.manifest(rows, out)
    return splits.manifest_totals(files.manifest(spark, out, schema=rows.schema))


def plan_precompute(spark: SparkSession, manifest: str, disk_gb: float, progress: str) -> DataFrame:
    """Shards that are still to do under a disk budget."""
    budget = numeric.available_bytes(int(disk_gb * 1024**3))
    planned = shards.plan_shards(files.manifest(spark, manifest), budget)
    return shards.pending(shards.shard_clips(planned), files.progress(spark, progress)).orderBy("index")


def validate_manifest(spark: SparkSession, manifest: str, split: str | None = None) -> DataFrame:
    rows = files.manifest(spark, manifest, split, place="place")
    return validate.report(validate.validate(rows, place="place"), order="place")


def normalize_sentences(spark: SparkSession, sentences: str, out: str) -> DataFrame:
    rows = scores.generation_inputs(spark, files.eval_sentences(spark, sentences))
    sinks.inputs(rows, out)
    return rows


def make_template(spark: SparkSession, sentences: str, experiments: list[str], out: str) -> DataFrame:
    rows = scores.template(files.eval_sentences(spark, sentences), experiments)
    sinks.scoring_template(rows, out)
    return rows


def summarize(spark: SparkSession, scored: str) -> DataFrame:
    return scores.summarize(files.scores(spark, scored)).orderBy("experiment_id")


def count_sentences(spark: SparkSession, path: str) -> DataFrame:
    return framed.sentence_counts(spark, path).agg(F.coalesce(F.sum("n_sentences"), F.lit(0)).alias("n_sentences"))


def spot_check(spark: SparkSession, path: str, samples: int) -> DataFrame:
    """Raggedness of the first sentences that have codes."""
    found = files.with_codes(framed.packed_sentences(spark, path), samples)
    return metrics.codec_tally(found.select(F.transform("semantics", lambda s: s["values"]).alias("codes")))


def normalize_line(spark: SparkSession, line: str) -> DataFrame:
    return spark.createDataFrame([(line,)], "text string").select(text.normalize(F.col("text")).alias("normalized"))


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="millrace.plans.jobs")
    jobs = parser.add_subparsers(dest="job", required=True)
    add = lambda name, *args: [p := jobs.add_parser(name), [p.add_argument(a, **k) for a, k in args]]
    add("make-splits", ("manifest", {}), ("out", {}), ("--validation-share", {"type": float, "default": 0.02}))
    add("convert-manifest", ("root", {}), ("out", {}), ("--sample-rate", {"type": int, "default": 16_000}), ("--source", {"default": "asr"}), ("--speakers", {"default": "data/ddd_speaker_ids.json"}))
    add("plan-precompute", ("manifest", {}), ("--disk-gb", {"type": float, "default": 20.0}), ("--progress", {"default": "progress.json"}))
    add("validate-manifest", ("manifest", {}), ("--split", {}))
    add("normalize-sentences", ("sentences", {}), ("out", {}))
    add("make-template", ("sentences", {}), ("out", {}), ("--experiments", {"nargs": "+", "required": True}))
    add("summarize", ("scored", {}))
    add("count-sentences", ("path", {}))
    add("spot-check", ("path", {}), ("--samples", {"type": int, "default": 10}))
    add("normalize-line", ("line", {}))
    args = vars(parser.parse_args(argv))
    job = globals()[args.pop("job").replace("-", "_")]
    spark = SparkSession.builder.appName("millrace").getOrCreate()
    for row in job(spark, **args).toLocalIterator():
        print(json.dumps(row.asDict(recursive=True), ensure_ascii=False, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
