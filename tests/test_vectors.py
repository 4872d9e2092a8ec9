from __future__ import annotations

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from pentarank.functions import vectors
from pentarank.operators import metrics

A, B, C, TIE = [0.9, 0.7, 0.5, 0.3, 0.1], [0.2, 0.9, 0.4, 0.6, 0.1], [0.1, 0.3, 0.5, 0.7, 0.9], [0.5, 0.5, 0.2, 0.1, 0.0]
GOLD = [2, 0, 1, 4, 3]


@pytest.fixture(scope="module")
def abc(spark):
    return spark.createDataFrame([("A", A), ("B", B), ("C", C)], "name string, scores array<double>").cache()


def value(df):
    return df.first()[0]


def scores_frame(spark, *rows):
    return spark.createDataFrame([(r,) for r in rows], "scores array<double>")


def test_argmax_and_ties(spark):
    df = scores_frame(spark, A, B, C, TIE)
    assert [r[0] for r in df.select(vectors.argmax("scores")).collect()] == [0, 1, 4, 0]


def test_argsort_is_stable_and_puts_nan_first(spark):
    nan = float("nan")
    df = scores_frame(spark, TIE, [1.0, nan, 2.0], [0.0, -0.0, 0.0])
    down = [r[0] for r in df.select(vectors.argsort("scores")).collect()]
    assert down == [[0, 1, 2, 3, 4], [1, 2, 0], [0, 1, 2]]
    assert value(df.select(vectors.argsort("scores", descending=False))) == [4, 3, 2, 0, 1]
    assert df.select(vectors.argmax("scores")).collect()[1][0] == 1


def test_spearman_golden(spark, abc):
    per_row = {r[0]: r[1] for r in abc.select("name", vectors.spearman("scores")).collect()}
    assert per_row == pytest.approx({"A": 1.0, "B": 0.3, "C": -1.0})
    assert value(metrics.evaluate(abc, [metrics.spearman()])) == pytest.approx(0.1)
    assert value(scores_frame(spark, TIE).select(vectors.spearman("scores"))) == pytest.approx(1.0)


def test_spearman_with_given_gold(spark, abc):
    row_b = abc.filter("name = 'B'")
    assert value(row_b.select(vectors.spearman("scores", GOLD))) == pytest.approx(-0.1)
    assert value(row_b.select(vectors.spearman("scores", GOLD, "ranks"))) == pytest.approx(0.4)
    per_row = row_b.withColumn("gold", F.array(*[F.lit(g) for g in GOLD]))
    assert value(per_row.select(vectors.spearman("scores", "gold"))) == pytest.approx(-0.1)
    with pytest.raises(ValueError):
        vectors.spearman("scores", method="kendall")


def test_spearman_against_textbook_for_all_permutations(spark):
    rows = [[float(x) for x in p] for p in itertools.permutations(range(4))]
    df = scores_frame(spark, *rows).select(
        "scores", vectors.spearman("scores").alias("p"), vectors.spearman("scores", method="ranks").alias("r")
    )
    for scores, permutation, ranks in df.collect():
        by_score = sorted(range(4), key=lambda i: -scores[i])
        rank = [by_score.index(i) for i in range(4)]
        expected = 1 - 6 * sum((rank[i] - i) ** 2 for i in range(4)) / 60
        assert ranks == pytest.approx(expected)
        assert permutation == pytest.approx(expected)
        assert -1 <= permutation <= 1


def test_spearman_of_short_rows_is_null(spark):
    df = scores_frame(spark, [0.4], [])
    assert [r[0] for r in df.select(vectors.spearman("scores")).collect()] == [None, None]
    assert value(metrics.evaluate(df, [metrics.spearman()])) is None


def test_top_accuracy_labels(abc):
    both = metrics.evaluate(
        abc, [metrics.top_image_accuracy(), metrics.top_image_accuracy(label=0, name="first")]
    ).first()
    assert tuple(both) == pytest.approx((1 / 3, 1 / 3))
    labeled = abc.withColumn("label", F.lit(4))
    assert value(metrics.evaluate(labeled, [metrics.top_image_accuracy(label=F.col("label"))])) == pytest.approx(1 / 3)


def test_pairwise_loss_golden(abc):
    both = metrics.evaluate(
        abc, [metrics.pairwise_loss(), metrics.pairwise_loss(weights=None, name="plain")]
    ).first()
    assert tuple(both) == pytest.approx((0.868851041021520, 0.702882486806667))
    only_a = metrics.evaluate(abc.filter("name = 'A'"), [metrics.pairwise_loss()])
    assert value(only_a) == pytest.approx(0.728981747058815)


def test_pairwise_loss_is_stable_and_keeps_every_pair(spark):
    extreme = scores_frame(spark, [1000.0, -1000.0, 1000.0])
    losses = value(extreme.select(vectors.pairwise_losses("scores")))
    assert losses == pytest.approx([0.0, 2000.0])
    with pytest.raises(Exception, match="INVALID_ARRAY_INDEX"):
        scores_frame(spark, [0.0] * 7).select(vectors.pairwise_losses("scores", [1.0, 1.0])).collect()
    short = scores_frame(spark, [0.3], [])
    assert [r[0] for r in short.select(vectors.pairwise_losses("scores", [1.5])).collect()] == [[], []]


def test_cosine_golden(spark):
    df = spark.createDataFrame(
        [([3.0, 4.0], [[3.0, 4.0], [4.0, 3.0], [1.0, 0.0], [0.0, 1.0], [-3.0, -4.0], [0.0, 0.0]])],
        "t array<float>, c array<array<float>>",
    )
    scores = value(df.select(vectors.cosine_scores("t", "c")))
    assert scores[:5] == pytest.approx([1, 0.96, 0.6, 0.8, -1])
    assert math.isnan(scores[5])


def test_cosine_against_brute_force(spark):
    rng = random.Random(3)
    rows = [
        ([rng.gauss(0, 1) for _ in range(9)], [[rng.gauss(0, 3) for _ in range(9)] for _ in range(5)])
        for _ in range(20)
    ]
    df = spark.createDataFrame(rows, "t array<double>, c array<array<double>>")
    for (text, candidates), row in zip(rows, df.select(vectors.cosine_scores("t", "c")).collect()):
        expected = [
            sum(a * b for a, b in zip(text, c)) / (math.hypot(*text) * math.hypot(*c)) for c in candidates
        ]
        assert row[0] == pytest.approx(expected)


LOGITS = [
    (1, 0, [1.0, 2.0, 3.0], 2),
    (1, 1, [0.0, 0.0, 0.0], 1),
    (1, 2, [5.0, -5.0, 0.0], -100),
    (2, 0, [0.0, 100.0, 0.0], -100),
    (2, 1, [2.0, 1.0, 0.0], 0),
    (2, 2, [0.0, 0.0, 1.0], 2),
    (3, 0, [0.0, 100.0, 0.0], 0),
]


@pytest.fixture(scope="module")
def logit_rows(spark):
    return spark.createDataFrame(LOGITS, "seq_id long, pos int, logits array<double>, target int").cache()


def perplexity(rows, **options):
    means = metrics.sequence_log_probs(rows, **options)
    return value(metrics.evaluate(means, [metrics.perplexity()]))


def test_perplexity_golden(logit_rows):
    means = dict(metrics.sequence_log_probs(logit_rows).collect())
    assert means == pytest.approx({1: -0.753109126556245, 2: -0.479525339188216, 3: -20.723265836946410})
    assert perplexity(logit_rows.filter("seq_id < 3")) == pytest.approx(1.852094633410250)
    assert perplexity(logit_rows) == pytest.approx(1508.141586225237)


def test_fully_padded_sequence(spark, logit_rows):
    padded = spark.createDataFrame([(9, 0, [1.0, 2.0], -100)], logit_rows.schema)
    both = logit_rows.filter("seq_id < 3").unionByName(padded)
    assert math.isnan(perplexity(both))
    assert perplexity(both, skip_empty=True) == pytest.approx(1.852094633410250)


def test_target_outside_classes_raises(spark, logit_rows):
    wrong = spark.createDataFrame([(9, 0, [1.0, 2.0], 2)], logit_rows.schema)
    with pytest.raises(Exception, match="INVALID_ARRAY_INDEX"):
        wrong.select(vectors.target_log_prob("logits", "target")).collect()


def test_shift_takes_the_next_target(logit_rows):
    shifted = metrics.shift_targets(logit_rows)
    got = {(r.seq_id, r.pos): r.target for r in shifted.collect()}
    assert got == {(1, 0): 1, (1, 1): -100, (2, 0): 0, (2, 1): 2}


@pytest.mark.parametrize("shift", [False, True])
def test_sequences_in_rows_score_like_long_form(logit_rows, shift):
    rows = logit_rows.groupBy("seq_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", "logits", "target"))).alias("r")
    )
    whole = rows.select("seq_id", vectors.mean_log_prob("r.logits", "r.target", shift))
    long = metrics.shift_targets(logit_rows) if shift else logit_rows
    expected = dict(metrics.sequence_log_probs(long).collect())
    got = dict(whole.collect())
    assert got.keys() - expected.keys() == ({3} if shift else set())
    assert {k: got[k] for k in expected} == pytest.approx(expected, nan_ok=True)
    assert not shift or math.isnan(got[3])


def test_gaps_in_a_sequence_raise(spark):
    rows = [(1, p, [0.0, 1.0], 1) for p in (0, 1, 3)]
    long = spark.createDataFrame(rows, "seq_id int, pos int, logits array<double>, target int")
    with pytest.raises(Exception, match="not dense"):
        metrics.shift_targets(long).collect()
    assert metrics.shift_targets(long.filter("pos < 2")).count() == 1


def test_pairs_with_a_null_score_count_nowhere(spark):
    df = spark.createDataFrame([([0.9, 0.7, 0.1],), ([0.9, None, 0.1],), ([0.3, None],), (None,)], "scores array<double>")
    both = [metrics.pairwise_loss(), metrics.pairwise_loss(weights=None, name="plain")]
    good = df.filter("scores[1] is not null")
    want = metrics.evaluate(good, both).first()
    assert tuple(metrics.evaluate(df, both).first()) == pytest.approx(tuple(want))
    parts = metrics.merge_partials(metrics.partials(df.withColumn("part", F.monotonically_increasing_id()), both, ["part"]), both)
    assert dict(parts.collect()) == pytest.approx(want.asDict())
