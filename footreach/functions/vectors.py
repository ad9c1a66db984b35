"""Array and probability-vector expressions (native higher-order functions, no Python UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from footreach.constants import DISTANCE_TEMPERATURE, N_CATEGORIES, N_FEATURES, feature_bounds


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lit_array(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def vsum(v) -> Column:
    return F.aggregate(_col(v), F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def dot(a, b) -> Column:
    return vsum(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")))


def as_double(v) -> Column:
    return _col(v).cast("array<double>")


# ---- classes and ranks ---------------------------------------------------------------------------

def argmax_class(v) -> Column:
    """Index of the largest element, the first one on ties."""
    v = _col(v)
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def top_k(v, k: int) -> Column:
    """Indices of the k largest elements, larger first, lower index first on ties."""
    ranked = F.array_sort(F.transform(_col(v), lambda x, i: F.struct((-x).alias("neg"), i.alias("i"))))
    return F.transform(F.slice(ranked, 1, k), lambda s: s["i"])


def sets_overlap(a, b) -> Column:
    return F.size(F.array_intersect(_col(a), _col(b))) > 0


def top_k_hit(p, q, k: int) -> Column:
    return sets_overlap(top_k(p, k), top_k(q, k))


def array_range(v) -> Column:
    return F.array_max(_col(v)) - F.array_min(_col(v))


# ---- shape and cleaning --------------------------------------------------------------------------

def fit_length(v, n: int = N_FEATURES) -> Column:
    """Pad with zeros, or cut, to exactly n elements."""
    v = as_double(v)
    return F.slice(F.concat(v, F.array_repeat(F.lit(0.0), n)), 1, n)


def is_finite(x: Column) -> Column:
    return ~(x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))


def finite_or_zero(v) -> Column:
    return F.transform(as_double(v), lambda x: F.when(is_finite(x), x).otherwise(F.lit(0.0)))


def clamp_features(v) -> Column:
    """Clamp each of the 33 features to its own range."""
    low, high = feature_bounds()
    raised = F.zip_with(as_double(v), lit_array(low), lambda x, lo: F.greatest(x, lo))
    return F.zip_with(raised, lit_array(high), lambda x, hi: F.least(x, hi))


def check_vector(v, n: int = N_CATEGORIES) -> Column:
    """Null when the vector has n elements, else a message saying what is wrong."""
    v = _col(v)
    return F.when(v.isNull(), F.lit("missing vector")).when(
        F.size(v) != n, F.concat(F.lit(f"expected {n} elements, got "), F.size(v).cast("string"))
    )


def same_shape(a, b) -> Column:
    return F.size(_col(a)) == F.size(_col(b))


# ---- probabilities -------------------------------------------------------------------------------

def _softmax_of(z: Column) -> Column:
    top = F.array_max(z)
    exps = F.transform(z, lambda x: F.exp(x - top))
    total = vsum(exps)
    return F.transform(exps, lambda e: e / total)


def softmax(z) -> Column:
    return _softmax_of(as_double(z))


def log_softmax(z) -> Column:
    z = as_double(z)
    top = F.array_max(z)
    log_total = F.log(vsum(F.transform(z, lambda x: F.exp(x - top))))
    return F.transform(z, lambda x: x - top - log_total)


def distance_softmax(d, tau: float = DISTANCE_TEMPERATURE) -> Column:
    """exp(-d / tau), normalised; shifted by the least distance so that far locations do not become 0 / 0."""
    d = as_double(d)
    return _softmax_of(F.transform(d, lambda x: -x / F.lit(float(tau))))


def normalise(v) -> Column:
    """Scale to sum 1; uniform when the sum is not positive."""
    v = as_double(v)
    total = vsum(v)
    return F.transform(v, lambda x: F.when(total > 0, x / total).otherwise(F.lit(1.0) / F.size(v)))


def smooth(p, a: float, n: int = N_CATEGORIES) -> Column:
    return F.transform(as_double(p), lambda x: x * F.lit(1.0 - a) + F.lit(a / n))


def entropy(p, eps: float = 0.0) -> Column:
    """-sum p ln(p + eps); with eps = 0 a zero element adds nothing."""
    def term(x):
        return F.when(x + F.lit(eps) > 0, -x * F.log(x + F.lit(eps))).otherwise(F.lit(0.0))
    return vsum(F.transform(as_double(p), term))


def entropy_penalty(p, minimum: float, kind: str = "linear") -> Column:
    deficit = F.greatest(F.lit(float(minimum)) - entropy(p), F.lit(0.0))
    return deficit * deficit if kind == "quadratic" else deficit


def max_logit_penalty(z, threshold: float = 0.0) -> Column:
    top = F.array_max(as_double(z))
    return F.when(top > F.lit(float(threshold)), top).otherwise(F.lit(0.0)) if threshold > 0 else top


# ---- divergences ---------------------------------------------------------------------------------

def kl(p, q, eps: float = 1e-8) -> Column:
    """KL(p || q) with eps added inside both logarithms."""
    e = F.lit(eps)
    return vsum(F.zip_with(as_double(p), as_double(q), lambda a, b: a * (F.log(a + e) - F.log(b + e))))


def _clamped_target(p, eps: float) -> Column:
    c = F.transform(as_double(p), lambda x: F.least(F.greatest(x, F.lit(eps)), F.lit(1.0)))
    total = vsum(c)
    return F.transform(c, lambda x: x / total)


def kl_terms(z, p, eps: float = 1e-9) -> Column:
    """Per-category terms of the loss form of KL: target clamped and renormalised, log-softmax prediction."""
    return F.zip_with(_clamped_target(p, eps), log_softmax(z), lambda t, lq: t * (F.log(t) - lq))


def kl_loss(z, p, eps: float = 1e-9) -> Column:
    return vsum(kl_terms(z, p, eps))


def kl_from_logits(z, p, eps: float = 1e-8) -> Column:
    """Per-sample KL with log-softmax; eps only on the target side."""
    return vsum(F.zip_with(as_double(p), log_softmax(z), lambda a, lq: a * (F.log(a + F.lit(eps)) - lq)))


def focal(terms, q, gamma: float, class_weights=None) -> Column:
    """Weight per-category terms by (1 - q)^gamma and, if given, by a weight per category."""
    out = _col(terms)
    if gamma > 0:
        out = F.zip_with(out, as_double(q), lambda t, x: t * F.pow(F.lit(1.0) - x, F.lit(float(gamma))))
    if class_weights is not None:
        w = lit_array(class_weights) if isinstance(class_weights, (list, tuple)) else _col(class_weights)
        out = F.zip_with(out, w, lambda t, x: t * x)
    return out


def distance_alignment(q, d, tau: float = DISTANCE_TEMPERATURE) -> Column:
    """KL between the distance distribution and the predicted one."""
    return kl(distance_softmax(d, tau), q)


def sample_loss(z, p, *, smoothing=0.0, gamma=0.0, class_weights=None, entropy_weight=0.1, min_entropy=1.0,
                penalty_kind="linear", maxsup_weight=0.0, maxsup_threshold=0.0, eps=1e-9) -> Column:
    """Whole per-row training loss; every switch is an explicit argument."""
    target = smooth(p, smoothing) if smoothing > 0 else as_double(p)
    loss = vsum(focal(kl_terms(z, target, eps), softmax(z), gamma, class_weights))
    if entropy_weight > 0:
        loss = loss + F.lit(float(entropy_weight)) * entropy_penalty(softmax(z), min_entropy, penalty_kind)
    if maxsup_weight > 0:
        loss = loss + F.lit(float(maxsup_weight)) * max_logit_penalty(z, maxsup_threshold)
    return loss


def logit_norm(z, norm: float = 1.0, temperature: float = 1.0) -> Column:
    """Scale the logits to a constant L2 norm, then divide by the temperature."""
    z = as_double(z)
    length = F.sqrt(dot(z, z)) + F.lit(1e-8)
    return F.transform(z, lambda x: x / length * F.lit(float(norm)) / F.lit(float(temperature)))


def edge_attr(dx, dy, euclidean, network, scale: float = 1000.0) -> Column:
    s = F.lit(float(scale))
    return F.array(*[_col(c).cast("double") / s for c in (dx, dy, euclidean, network)])
