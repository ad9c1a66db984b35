"""Scalar expressions and column helpers: ratios, text and code clean-up, seeded randomness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footreach.constants import QUARTER_HOUR_M


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_ratio(a, b) -> Column:
    """a / b, and 0 when the denominator is 0 or either side is null."""
    return F.coalesce(F.try_divide(_col(a).cast("double"), _col(b).cast("double")), F.lit(0.0))


def to_number(c) -> Column:
    """Text to double; text that is no number becomes null instead of failing the job."""
    return _col(c).try_cast("double")


def norm_name(c) -> Column:
    return F.replace(F.lower(_col(c)), F.lit(" "), F.lit("_"))


def norm_code(c) -> Column:
    return F.trim(_col(c).cast("string"))


def norm_15min(m) -> Column:
    m = _col(m)
    return F.when(m < 0, F.raise_error(F.lit("distance cannot be negative"))).otherwise(m / F.lit(QUARTER_HOUR_M))


def walk_minutes(m, kmh: float = 5.0) -> Column:
    m = _col(m)
    return F.when(m < 0, F.raise_error(F.lit("distance cannot be negative"))).otherwise(
        m / F.lit(1000.0) / F.lit(float(kmh)) * F.lit(60.0)
    )


def fmt_pct(x, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", _col(x) * F.lit(100.0))


def fmt_coord(lat, lon) -> Column:
    return F.format_string("%.4f, %.4f", _col(lat), _col(lon))


def elapsed_s(a, b) -> Column:
    """Seconds from a to b, with fractions."""
    return (F.unix_micros(_col(b).cast("timestamp")) - F.unix_micros(_col(a).cast("timestamp"))) / F.lit(1e6)


def iso_stamp(ts) -> Column:
    return F.date_format(_col(ts), "yyyy-MM-dd'T'HH:mm:ss")


def row_bytes(n_neighbors, n_features: int = 33, n_categories: int = 8) -> Column:
    """Estimated bytes of one star at 4 bytes a number: node features, 2 edge ends, 4 edge numbers, target vector."""
    n = _col(n_neighbors)
    return (n + 1) * (4 * n_features) + n * (2 * 4 + 4 * 4) + 4 * n_categories


def drawn(text) -> Column:
    """First 8 hex digits of a text's md5; as texts they are in the order of `uniform`, where only the order counts."""
    return F.substring(F.md5(text), 1, 8)


def uniform(seed, *keys) -> Column:
    """Deterministic uniform in [0, 1): first 8 hex digits of md5('key|...|seed') over 2^32."""
    text = F.concat_ws("|", *[_col(k).cast("string") for k in keys], F.lit(str(seed)))
    return F.conv(drawn(text), 16, 10).cast("double") / F.lit(4294967296.0)


def normal(seed, *keys) -> Column:
    """Deterministic standard normal by Box-Muller over two seeded uniforms."""
    u1 = F.greatest(uniform(f"{seed}a", *keys), F.lit(1e-10))
    u2 = uniform(f"{seed}b", *keys)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * 3.141592653589793) * u2)


# ---- planning-time column resolvers ---------------------------------------------------------------

def resolve_name(df: DataFrame, candidates, substrings=()) -> str | None:
    """First existing candidate (ignoring case), else the first column holding one of the substrings."""
    lowered = {}
    for c in df.columns:
        lowered.setdefault(c.lower(), c)
    for cand in candidates:
        if cand.lower() in lowered:
            return lowered[cand.lower()]
    for sub in substrings:
        for c in df.columns:
            if sub.lower() in c.lower():
                return c
    return None


def resolve_col(df: DataFrame, candidates, substrings=(), numeric: bool = False) -> Column:
    """As `resolve_name`, as a column; a typed null when nothing matches."""
    name = resolve_name(df, candidates, substrings)
    if name is None:
        return F.lit(None).cast("double" if numeric else "string")
    return to_number(F.col(f"`{name}`")) if numeric else F.col(f"`{name}`")


def cols_like(df: DataFrame, patterns, match: str = "prefix") -> list[str]:
    """Columns that start with (or contain) one of the patterns, in table order."""
    def hit(c):
        return any(c.startswith(p) if match == "prefix" else p.lower() in c.lower() for p in patterns)
    return [c for c in df.columns if hit(c)]
