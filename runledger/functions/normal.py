"""The normal law and logarithms of factorials as SQL text, so that any engine evaluates the same formulas.

Arguments are SQL expressions, evaluated several times: give columns.
"""

from __future__ import annotations

from collections.abc import Sequence

#: Rational approximation of the upper tail of the normal law, highest power first.
_TAIL = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_TAIL_BELOW = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
#: Rational approximations of the normal quantile (AS 241) near the middle, in the tails and far out,
#: highest power first.
_MIDDLE = (2.5090809287301226727e3, 3.3430575583588128105e4, 6.7265770927008700853e4, 4.5921953931549871457e4, 1.3731693765509461125e4, 1.9715909503065514427e3, 1.3314166789178437745e2, 3.3871328727963666080)
_MIDDLE_BELOW = (5.2264952788528545610e3, 2.8729085735721942674e4, 3.9307895800092710610e4, 2.1213794301586595867e4, 5.3941960214247511077e3, 6.8718700749205790830e2, 4.2313330701600911252e1, 1.0)
_OUTER = (7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258, 3.64784832476320460504, 5.76949722146069140550, 4.63033784615654529590, 1.42343711074968357734)
_OUTER_BELOW = (1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1, 6.89767334985100004550e-1, 1.67638483018380384940, 2.05319162663775882187, 1.0)
_FAR = (2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3, 2.65321895265761230930e-2, 2.96560571828504891230e-1, 1.78482653991729133580, 5.46378491116411436990, 6.65790464350110377720)
_FAR_BELOW = (2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5, 7.86869131145613259100e-4, 1.48753612908506148525e-2, 1.36929880922735805310e-1, 5.99832206555887937690e-1, 1.0)


def _number(x: float) -> str:
    # With an exponent a literal is a double everywhere.
    return f"{x:.20e}"


def _polynomial(x: str, coefficients: Sequence[float]) -> str:
    out = _number(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {x} + {_number(c)})"
    return out


def _ratio(x: str, above: Sequence[float], below: Sequence[float]) -> str:
    return f"({_polynomial(x, above)} / {_polynomial(x, below)})"


def normal_cdf(x: str) -> str:
    """P(Z <= x), good to 1e-15."""
    a = f"abs({x})"
    far = f"({a} + 1e0 / ({a} + 2e0 / ({a} + 3e0 / ({a} + 4e0 / ({a} + 6.5e-1)))))"
    tail = f"CASE WHEN {a} > 37e0 THEN 0e0 WHEN {a} < 7.07106781186547e0 THEN exp(-{x} * {x} / 2e0) * {_ratio(a, _TAIL, _TAIL_BELOW)} ELSE exp(-{x} * {x} / 2e0) / {far} / 2.506628274631e0 END"
    return f"(CASE WHEN {x} > 0e0 THEN 1e0 - ({tail}) ELSE ({tail}) END)"


def normal_quantile(p: str) -> str:
    """x with P(Z <= x) = p for 0 < p < 1; null else."""
    q = f"({p} - 5e-1)"
    middle = f"{q} * {_ratio(f'(1.80625e-1 - {q} * {q})', _MIDDLE, _MIDDLE_BELOW)}"
    r = f"sqrt(-ln(CASE WHEN {p} < 5e-1 THEN {p} ELSE 1e0 - {p} END))"
    outer = f"CASE WHEN {r} <= 5e0 THEN {_ratio(f'({r} - 1.6e0)', _OUTER, _OUTER_BELOW)} ELSE {_ratio(f'({r} - 5e0)', _FAR, _FAR_BELOW)} END"
    return f"(CASE WHEN {p} <= 0e0 OR {p} >= 1e0 THEN NULL WHEN abs({q}) <= 4.25e-1 THEN {middle} WHEN {p} < 5e-1 THEN -({outer}) ELSE ({outer}) END)"


def log_factorial(n: str) -> str:
    """ln(n!) by Stirling's series from n + 8 on, divided down to n; good to 1e-12."""
    m = f"({n} + 8e0)"
    series = f"(({m} + 5e-1) * ln({m}) - {m} + 9.1893853320467274178e-1 + 1e0 / (12e0 * {m}) - 1e0 / (360e0 * power({m}, 3e0)) + 1e0 / (1260e0 * power({m}, 5e0)) - 1e0 / (1680e0 * power({m}, 7e0)) + 1e0 / (1188e0 * power({m}, 9e0)))"
    return f"({series} - ln({' * '.join(f'({n} + {k}e0)' for k in range(1, 9))}))"
