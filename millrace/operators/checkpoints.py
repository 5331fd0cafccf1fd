"""Run metadata: what must agree before a run resumes, and what is written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The fields that must agree.
CRITICAL = ("architecture_version", "base_model", "tokenizer", "dataset", "vocab_size", "hidden_dim")


def differences(saved: DataFrame, current: DataFrame, *by: str) -> DataFrame:
    """Critical fields that differ between two metadata tables, as text; missing on both sides is equal."""
    long = lambda df, name: df.select(*by, F.explode(F.array(*(F.struct(F.lit(k).alias("field"), (F.col(k) if k in df.columns else F.lit(None)).cast("string").alias(name)) for k in CRITICAL))).alias("x")).select(*by, "x.*")
    return long(saved, "saved").join(long(current, "current"), [*by, "field"], "full").where(~F.col("saved").eqNullSafe(F.col("current")))


def check_compatible(saved: DataFrame, current: DataFrame) -> None:
    """Raises with every critical field that differs."""
    rows = differences(saved, current).orderBy("field").collect()
    if rows:
        raise ValueError("incompatible metadata: " + "; ".join(f"{r.field}: {r.saved!r} and {r.current!r}" for r in rows))


def merged_metadata(base, architecture, extra):
    """Maps merged so that ``extra`` overrides ``architecture``, which overrides ``base``; the first of a repeated key goes."""
    without = lambda a, b: F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k))
    upper = F.map_concat(without(architecture, extra), extra)
    return F.map_concat(without(base, upper), upper)
