"""Resampling and masked losses against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import signal
from millrace.operators import losses


def plain(x, old, new):
    """Each output sample over all input samples, from the definition."""
    band = min(old, new) * signal.ROLLOFF
    out = []
    for j in range(-(-len(x) * new // old)):
        t = (np.arange(len(x)) / old - j / new) * band
        near = np.abs(t) < signal.ZERO_CROSSINGS
        w = np.sinc(t) * np.cos(t * np.pi / 2 / signal.ZERO_CROSSINGS) ** 2 * band / old
        out.append(float((np.asarray(x) * np.where(near, w, 0)).sum()))
    return out


@pytest.mark.parametrize("old,new", [(16000, 24000), (44100, 24000), (24000, 16000), (8000, 48000), (3, 2), (7, 7), (48000, 8000)])
def test_equals_the_definition(spark, old, new):
    rng = np.random.default_rng(old + new)
    rows = [(i, rng.normal(size=n).tolist()) for i, n in enumerate([0, 1, 2, 5, 147, 300])] + [(99, None)]
    got = {r.i: r.y for r in spark.createDataFrame(rows, "i int, x array<float>").select("i", signal.resampled(F.col("x"), old, new).alias("y")).collect()}
    for i, x in rows:
        if x is None:
            assert got[i] is None
        else:
            want = np.float32(x).tolist() if old == new else plain(np.float32(x).astype(float), *signal.ratio(old, new))
            assert len(got[i]) == len(want) and np.allclose(got[i], want, atol=1e-12)


def test_a_tone_keeps_its_pitch(spark):
    n = 1600
    tone = [math.sin(2 * math.pi * 440 * i / 16000) for i in range(n)]
    (y,) = spark.createDataFrame([(tone,)], "x array<double>").select(signal.resampled(F.col("x"), 16000, 24000)).first()
    want = [math.sin(2 * math.pi * 440 * i / 24000) for i in range(len(y))]
    assert len(y) == 2400 and np.abs(np.array(y) - want)[50:-50].max() < 0.02


def test_an_expression_without_python(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    plan = rows.select(signal.resampled(F.col("embedding"), 16000, 24000))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
    with pytest.raises(ValueError, match="positive"):
        signal.ratio(0, 3)


def entropy(z, y):
    z = np.asarray(z, float)
    return float(z.max() + np.log(np.exp(z - z.max()).sum()) - z[y])


def test_masked_losses(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(60):
        label = -100 if i % 4 == 0 else int(rng.integers(0, 10))
        rows.append((i % 2, (rng.normal(size=10) * 1e4).tolist(), label, rng.normal(size=(3, 6)).tolist(), [int(rng.integers(0, 6)), -100, int(rng.integers(0, 6))]))
    df = spark.createDataFrame(rows, "g int, token_logits array<double>, label int, codebook_logits array<array<double>>, codebook_labels array<int>").repartition(5)
    got = {r.g: r for r in losses.masked_loss(df, 3, 7, "g").collect()}
    for g in (0, 1):
        base = [entropy(z, y) for k, z, y, *_ in rows if k == g and y != -100]
        codes = [entropy(c, d) for k, _, y, cs, ds in rows if k == g and 3 <= y <= 7 for c, d in zip(cs, ds) if d != -100]
        assert (got[g].n_tokens, got[g].n_codes) == (len(base), len(codes))
        assert got[g].base_loss == pytest.approx(np.mean(base)) and got[g].semantic_loss == pytest.approx(np.mean(codes)) and got[g].loss == pytest.approx(np.mean(base) + np.mean(codes))
        assert math.isfinite(got[g].loss)


def test_means_over_nothing_and_bad_labels(spark):
    kind = "token_logits array<double>, label int, codebook_logits array<array<double>>, codebook_labels array<int>"
    none = losses.masked_loss(spark.createDataFrame([([1.0, 2.0], -100, [[1.0]], [0]), ([1.0, 2.0], None, [[1.0]], [0])], kind), 0, 1).first()
    assert (none.n_tokens, none.n_codes) == (0, 0) and math.isnan(none.base_loss) and math.isnan(none.semantic_loss) and math.isnan(none.loss)
    huge = losses.masked_loss(spark.createDataFrame([([1e308, -1e308], 0, [[1e4, 0.0]], [1])], kind), 0, 1).first()
    assert huge.base_loss == 0.0 and huge.semantic_loss == 1e4
    assert math.isnan(losses.masked_loss(spark.createDataFrame([], kind), 0, 1).first().loss)
    with pytest.raises(Exception, match="no logit for label 2"):
        losses.masked_loss(spark.createDataFrame([([1.0, 2.0], 2, [[1.0]], [0])], kind), 0, 1).collect()
