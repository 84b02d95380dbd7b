"""Column functions: numeric transforms, kernels, hashes of coordinates and name parsing. No actions."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """The value, or null where it is NaN or infinite (null stays null)."""
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) < INF), c)


def both_finite(a: Column | str, b: Column | str) -> Column:
    return F.coalesce(finite(a).isNotNull() & finite(b).isNotNull(), F.lit(False))


def all_finite(*cols: str) -> Column:
    return reduce(lambda x, y: x & y, [finite(c).isNotNull() for c in cols])


def clip_low(c, low: float = 0.0) -> Column:
    return F.greatest(col(c), F.lit(low))


def clip(c, low, high) -> Column:
    return F.least(F.greatest(col(c), F.lit(low) if not isinstance(low, Column) else low), F.lit(high) if not isinstance(high, Column) else high)


def log_eps(c, eps: float = 1e-10) -> Column:
    return F.ln(col(c) + eps)


def exp_eps(c, eps: float = 1e-10) -> Column:
    return F.exp(col(c)) - eps


def log1p_clipped(c) -> Column:
    return F.log1p(clip_low(c))


def ratio(a, b) -> Column:
    """a / b, null where b is zero or null."""
    a, b = col(a), col(b)
    return F.try_divide(a.cast("double"), b.cast("double"))


def minmax_255(c, low, high) -> Column:
    """To 0..255; a constant gives 0."""
    low, high = col(low), col(high)
    return F.coalesce(ratio(col(c) - low, F.nullif(high - low, F.lit(0.0))) * 255.0, F.lit(0.0))


def robust_unit(c, p_low, p_high, low, high) -> Column:
    """To 0..1 between two percentiles, clipped; between minimum and maximum where these coincide; else 0."""
    by_rank = ratio(col(c) - col(p_low), F.nullif(col(p_high) - col(p_low), F.lit(0.0)))
    by_range = ratio(col(c) - col(low), F.nullif(col(high) - col(low), F.lit(0.0)))
    return F.coalesce(clip(by_rank, 0.0, 1.0), clip(by_range, 0.0, 1.0), F.lit(0.0))


def gamma_colour(c, gamma: float) -> Column:
    return F.pow(clip(c, 0.0, 1.0), F.lit(gamma))


def heat(d2, bandwidth: float | Column) -> Column:
    b = col(bandwidth) if isinstance(bandwidth, (Column, str)) else F.lit(float(bandwidth))
    return F.exp(-col(d2) / (4 * b * b))


def gaussian(d2, scale: float) -> Column:
    return F.exp(-col(d2) / (2 * scale * scale))


def median_affinity(d2, median) -> Column:
    return F.exp(-ratio(d2, median))


def bump(x, support: float, decay: float) -> Column:
    """Compact support: exp(decay / (x^2 - support^2)) scaled to 1 at 0, and 0 from `support` on."""
    x = F.abs(col(x))
    inside = F.exp(F.try_divide(F.lit(decay), x * x - support * support) + decay / (support * support))
    return F.when(x < support, inside).otherwise(F.lit(0.0))


def matern(d, scale: float, nu: float) -> Column:
    """Correlation of smoothness 1/2, 3/2 or 5/2."""
    d = F.abs(col(d)) / scale
    if nu == 0.5:
        return F.exp(-d)
    root = d * math.sqrt(2 * nu)
    if nu == 1.5:
        return (1 + root) * F.exp(-root)
    if nu == 2.5:
        return (1 + root + root * root / 3) * F.exp(-root)
    raise ValueError("nu is 0.5, 1.5 or 2.5")


def spectral_density(eigenvalue, scale: float, nu: float, kappa: float = 1.0) -> Column:
    return F.pow(2 * nu / (scale * scale) + kappa * col(eigenvalue), F.lit(-nu))


def fold_at(c, mid: float) -> Column:
    return F.abs(col(c) - mid)


def relative_error(y, p, least: float = 1e-8) -> Column:
    y, p = col(y), col(p)
    return F.abs(y - p) / F.when(F.abs(y) < least, F.lit(least)).otherwise(F.abs(y))


def rmse_from_r2(r2) -> Column:
    return F.sqrt(F.greatest(1 - col(r2), F.lit(0.0)))


def erfc(x) -> Column:
    """Complementary error function for x >= 0 by the rational approximation of Abramowitz and Stegun 7.1.26 (error under 1.5e-7)."""
    # The published coefficients.
    p, a = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    x = col(x)
    t = 1 / (1 + p * x)
    poly = F.lit(0.0)
    for k in reversed(a):
        poly = (poly + k) * t
    return poly * F.exp(-x * x)


def slug(c) -> Column:
    """Colons to hyphens, other characters outside [A-Za-z0-9._-] to underscores, underscores trimmed at the ends."""
    clean = F.regexp_replace(F.regexp_replace(col(c), ":", "-"), r"[^A-Za-z0-9._-]+", "_")
    return F.regexp_replace(clean, r"^_+|_+$", "")


def fold_token(c) -> Column:
    """The number after the first FOLD token, or null."""
    found = F.regexp_extract(F.upper(col(c)), r"FOLD[-_]?([0-9]+)", 1)
    return F.when(found != "", found.cast("int"))


def without_fold(c) -> Column:
    return F.regexp_replace(col(c), r"(?i)^FOLD[-_]?[0-9]+[-_]?|[-_]FOLD[-_]?[0-9]+", "")


def by_rules(c, rules: Sequence[tuple[str, str]], otherwise: str) -> Column:
    """The label of the first rule whose token the lower-cased value contains."""
    value, out = F.lower(col(c)), None
    for token, label in rules:
        hit = value.contains(token.lower())
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(otherwise)


def by_prefix(c, rules: Sequence[tuple[str, str]], otherwise: str) -> Column:
    out = None
    for prefix, label in rules:
        hit = col(c).startswith(prefix)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(otherwise)


def block_name(c) -> Column:
    """The head of a feature's name without trailing digits: hess1_0.2mm is hess."""
    return F.regexp_replace(F.substring_index(col(c), "_", 1), r"[0-9]+$", "")


def squared_distance(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def correlation_distance(a, b) -> Column:
    cos = ratio(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    return F.sqrt(F.greatest(2 * (1 - cos), F.lit(0.0)))


def diffuse(phi, eigenvalues, time: float) -> Column:
    return F.zip_with(col(phi), col(eigenvalues), lambda p, lam: p * F.exp(-time * lam))


def softplus(c) -> Column:
    return F.ln(1 + F.exp(col(c)))


def flat_key(a, b, c, size_b: int, size_c: int) -> Column:
    return (col(a) * size_b + col(b)) * size_c + col(c)


def unflat(key, size_b: int, size_c: int) -> tuple[Column, Column, Column]:
    key = col(key)
    div = lambda x, n: F.floor(x / n).cast("long")
    return div(div(key, size_c), size_b), F.pmod(div(key, size_c), F.lit(size_b)), F.pmod(key, F.lit(size_c))


def spatial_hash(coords: Sequence, primes: Sequence[int], size: int) -> Column:
    """xor of coordinates times primes, modulo the table's size."""
    mixed = reduce(lambda x, y: x.bitwiseXOR(y), [col(c).cast("long") * p for c, p in zip(coords, primes, strict=True)])
    return F.pmod(mixed, F.lit(size))


def sum_kl(mean, log_var) -> Column:
    """KL divergence of a normal from the standard normal."""
    return 0.5 * (F.exp(col(log_var)) + col(mean) * col(mean) - 1 - col(log_var))


def gaussian_nll(y, mean, log_var) -> Column:
    return 0.5 * (math.log(2 * math.pi) + col(log_var) + F.pow(col(y) - col(mean), F.lit(2)) / F.exp(col(log_var)))


def portable_hash(seed: int, *cols: str) -> Column:
    """32 hex digits that any engine with md5 gives for the same values; order by it to sample."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[col(c).cast("string") for c in cols]))


def portable_uniform(seed: int, *cols: str) -> Column:
    """A number in [0, 1) from the first eight hex digits of portable_hash."""
    return F.conv(F.substring(portable_hash(seed, *cols), 1, 8), 16, 10).cast("double") / 4294967296.0


def softmax(logits) -> Column:
    """An array of numbers as weights that sum to one."""
    a = col(logits)
    e = F.transform(a, lambda v: F.exp(v - F.array_max(a)))
    return F.transform(F.array(e), lambda w: F.transform(w, lambda v: v / F.aggregate(w, F.lit(0.0), lambda s, u: s + u)))[0]


def mixture(predictions, logits) -> Column:
    """The experts' predictions weighted by the softmax of their gates."""
    return F.aggregate(F.zip_with(col(predictions), softmax(logits), lambda p, w: p * w), F.lit(0.0), lambda s, v: s + v)


def minibatch_kl_weight(batch: int, rows: int) -> float:
    """Share of the divergence term that a minibatch carries, so that an epoch carries it once."""
    return batch / max(1, rows)
