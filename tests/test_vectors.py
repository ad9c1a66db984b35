import math

import pytest
from footreach.functions import scalars as S
from footreach.functions import vectors as V
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

QUICK = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
logits = st.lists(st.lists(st.floats(-50, 50), min_size=8, max_size=8), min_size=2, max_size=6)


def frame(spark, rows, names="z"):
    return spark.createDataFrame([(r,) for r in rows], f"{names} array<double>")


@QUICK
@given(rows=logits)
def test_softmax_and_divergences(spark, rows):
    df = frame(spark, rows).withColumn("p", V.softmax("z")).withColumn("q", V.distance_softmax(F.transform("z", lambda x: F.abs(x) * 100)))
    for r in df.select("p", "q", V.vsum("p").alias("sp"), V.vsum("q").alias("sq"), V.kl("p", "q").alias("kl"), V.kl("p", "p").alias("self"),
                       V.kl_loss("z", "p").alias("fit"), V.entropy("p").alias("h"), V.argmax_class("p").alias("c")).collect():
        assert r.sp == pytest.approx(1) and r.sq == pytest.approx(1)
        assert r.kl >= -1e-6 and abs(r.self) < 1e-12 and abs(r.fit) < 1e-4
        assert -1e-9 <= r.h <= math.log(8) + 1e-9
        assert r.p[r.c] == max(r.p) and r.p.index(max(r.p)) == r.c


@QUICK
@given(rows=st.lists(st.lists(st.floats(-1e6, 1e6), min_size=33, max_size=33), min_size=1, max_size=4))
def test_clamps(spark, rows):
    for r in frame(spark, rows).select(V.clamp_features("z").alias("v")).collect():
        assert all(x >= 0 for i, x in enumerate(r.v) if i != 1) and -3 <= r.v[1] <= 3
        assert all(r.v[i] <= 1 + 1e-6 for i in [*range(2, 17), 31, 32]) and r.v[19] <= 20 and r.v[30] <= 500


def test_far_distances_do_not_divide_by_zero(spark):
    p = frame(spark, [[1e6] * 8]).select(V.distance_softmax("z").alias("p")).first().p
    assert p == [0.125] * 8


def test_penalty_prefers_near(spark):
    p = frame(spark, [[0.0, 200.0] + [2400.0] * 6]).select(V.distance_softmax("z").alias("p")).first().p
    assert p[0] / p[1] == pytest.approx(math.e)


def test_vector_shapes(spark):
    df = frame(spark, [[1.0, float("nan"), float("inf")]])
    r = df.select(V.fit_length("z", 5).alias("a"), V.fit_length("z", 2).alias("b"), V.finite_or_zero("z").alias("c"), V.check_vector("z").alias("d"),
                  V.check_vector(F.array_repeat(F.lit(0.1), 8)).alias("e")).first()
    assert len(r.a) == 5 and r.a[3:] == [0.0, 0.0] and len(r.b) == 2
    assert r.c == [1.0, 0.0, 0.0] and "expected 8" in r.d and r.e is None


def test_top_k_ties(spark):
    r = frame(spark, [[0.2, 0.5, 0.5, 0.1]]).select(V.top_k("z", 3).alias("k"), V.argmax_class("z").alias("c"),
                                                   V.top_k_hit("z", F.array(*map(F.lit, [0.9, 0.0, 0.0, 0.1])), 1).alias("h1"),
                                                   V.top_k_hit("z", F.array(*map(F.lit, [0.9, 0.0, 0.0, 0.1])), 3).alias("h3")).first()
    assert (r.k, r.c, r.h1, r.h3) == ([1, 2, 0], 1, False, True)


def test_three_divergences_differ_when_saturated(spark):
    df = spark.createDataFrame([([500.0] + [0.0] * 7, [0.0, 1.0] + [0.0] * 6)], "z array<double>, p array<double>")
    r = df.select(V.kl("p", V.softmax("z")).alias("a"), V.kl_loss("z", "p").alias("b"), V.kl_from_logits("z", "p").alias("c")).first()
    assert r.a == pytest.approx(-math.log(1e-8), rel=1e-3) and r.c == pytest.approx(500, rel=1e-6) and r.b == pytest.approx(500, rel=1e-3)


def test_losses(spark):
    z, p = [0.0, 1.0, 2.0, 3.0, 0.0, 0.0, 0.0, 0.0], [0.3, 0.2, 0.1, 0.1, 0.1, 0.1, 0.05, 0.05]
    df = spark.createDataFrame([(z, p)], "z array<double>, p array<double>")
    e = [math.exp(x) for x in z]
    q = [x / sum(e) for x in e]
    terms = [a * (math.log(a) - math.log(b)) for a, b in zip(p, q)]
    h = -sum(x * math.log(x) for x in q)
    r = df.select(V.kl_loss("z", "p").alias("plain"), V.sample_loss("z", "p", entropy_weight=0.1, min_entropy=2.0).alias("lin"),
                  V.sample_loss("z", "p", entropy_weight=0.2, min_entropy=2.0, penalty_kind="quadratic", gamma=2.0, class_weights=[2.0] * 8, maxsup_weight=0.5).alias("full"),
                  V.vsum(V.smooth("p", 0.2)).alias("s")).first()
    assert r.plain == pytest.approx(sum(terms)) and r.s == pytest.approx(1)
    assert r.lin == pytest.approx(sum(terms) + 0.1 * max(0, 2 - h))
    assert r.full == pytest.approx(sum(t * (1 - b) ** 2 * 2 for t, b in zip(terms, q)) + 0.2 * max(0, 2 - h) ** 2 + 0.5 * 3)


def test_scalars(spark):
    df = spark.sql("SELECT 1D a, 0D b, CAST(NULL AS double) c, 'x' d, ' 075 ' e, 'La Chapelle' f")
    r = df.select(S.safe_ratio("a", "b").alias("r0"), S.safe_ratio("a", "c").alias("r1"), S.to_number("d").alias("n"), S.norm_code("e").alias("e"),
                  S.norm_name("f").alias("f"), S.norm_15min(F.lit(1200.0)).alias("q"), S.walk_minutes(F.lit(1000.0)).alias("m"), S.fmt_pct(F.lit(0.123)).alias("p")).first()
    assert (r.r0, r.r1, r.n, r.e, r.f, r.q, r.m, r.p) == (0.0, 0.0, None, "075", "la_chapelle", 1.0, 12.0, "12.3%")
    with pytest.raises(Exception, match="negative"):
        df.select(S.norm_15min(F.lit(-1.0))).collect()


def test_uniform_and_normal(spark):
    r = spark.range(4000).select(S.uniform(1, "id").alias("u"), S.normal(1, "id").alias("z")).agg(
        F.min("u"), F.max("u"), F.avg("u"), F.avg("z"), F.stddev("z")).first()
    assert 0 <= r[0] < 0.01 and 0.99 < r[1] < 1 and abs(r[2] - 0.5) < 0.02 and abs(r[3]) < 0.05 and abs(r[4] - 1) < 0.05
