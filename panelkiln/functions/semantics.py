"""Scalar functions with the missing-value rules of the panel algebra, as SQL text for Spark or for DuckDB.

Missing is NULL, never NaN. Infinities are legal between operators. Operands of functions that name one twice must be atoms (columns or
numbers); the compiler sees to that."""

from __future__ import annotations


def number(v: float) -> str:
    s = repr(float(v))
    return s if "e" in s or "inf" in s else f"{s}E0"


def infinity(dialect: str, sign: str = "") -> str:
    return f"double('{sign}Infinity')" if dialect == "spark" else f"CAST('{sign}Infinity' AS DOUBLE)"


def sdiv(d: str, a: str, b: str) -> str:
    """IEEE division: x/0 is an infinity of x's sign, 0/0 missing."""
    return f"(CASE WHEN {b} <> 0 THEN {a} / {b} WHEN {b} = 0 AND {a} > 0 THEN {infinity(d)} WHEN {b} = 0 AND {a} < 0 THEN {infinity(d, '-')} END)"


def slog(d: str, x: str) -> str:
    """Logarithm: of 0 minus infinity, of less missing. Snapped, as mathematics libraries differ in the last bit."""
    return f"(CASE WHEN {x} > 0 THEN {snapped(d, f'ln({x})', f'abs(ln({x}))')} WHEN {x} = 0 THEN {infinity(d, '-')} END)"


def spow(d: str, b: str, e: str) -> str:
    """Power: 1 ** missing and missing ** 0 are 1."""
    return f"(CASE WHEN {b} = 1 THEN {number(1)} WHEN {e} = 0 THEN {number(1)} ELSE pow({b}, {e}) END)"


def signedpower(d: str, x: str, e: str) -> str:
    """sign(x) * abs(x) ** e."""
    return f"({sign(d, x)} * {spow(d, f'abs({x})', e)})"


def sign(d: str, x: str) -> str:
    return f"signum({x})" if d == "spark" else f"CAST(sign({x}) AS DOUBLE)"


def compare(d: str, op: str, a: str, b: str) -> str:
    """Comparisons with missing are false."""
    return f"coalesce({a} {op} {b}, false)"


def extreme(d: str, name: str, a: str, b: str) -> str:
    """Maximum or minimum; missing if either is."""
    return f"(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN {name}({a}, {b}) END)"


def number_or_null(d: str, x: str) -> str:
    return f"(CASE WHEN NOT isnan({x}) THEN {x} END)"


def finite_or_null(d: str, x: str) -> str:
    return f"(CASE WHEN abs({x}) < {infinity(d)} THEN {x} END)"


def nonzero(d: str, x: str) -> str:
    return f"nullif({x}, {number(0)})"


def indicator(d: str, c: str) -> str:
    return f"(CASE WHEN {c} THEN {number(1)} ELSE {number(0)} END)"


def decimals(d: str, x: str, digits: int) -> str:
    """x to so many decimals, for a result that is compared; no minus zero."""
    scale = f"1E{digits}"
    whole = f"rint({x} * {scale})" if d == "spark" else f"round_even({x} * {scale}, 0)"
    return f"({whole} / {scale} + {number(0)})"


#: Binary places that a value keeps below the magnitude it came from: some ten decimal digits.
PLACES = 33


def snapped(d: str, x: str, of: str) -> str:
    """x to a grid that is PLACES binary places finer than the magnitude `of` of what it was formed from, so that ties don't hang on the order
    in which a sum was formed, however small or large its terms are. The step is a power of 2, so the grid is exact; no minus zero."""
    step = f"pow(2E0, floor(log2({of})) - {PLACES}E0)"
    round_ = "rint({})" if d == "spark" else "round_even({}, 0)"
    return f"(CASE WHEN {of} > 1E-290 AND {of} < 1E290 THEN {round_.format(f'{x} / {step}')} * {step} + {number(0)} ELSE {x} END)"
