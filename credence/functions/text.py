"""Generic scalar helpers (Column -> Column) with Python-compatible text semantics.

Spark's regex ``\\s`` is ASCII-only and ``trim`` removes only U+0020, while the
pipeline's rules were defined over Python strings (``str.strip``, ``float()``,
``int()``). The helpers below spell the Python whitespace set out explicitly so
the same pattern text runs in Java regex and in RE2 (used by the SQL oracle).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.isspace() accepts (the \s class of a str regex).
PY_WS = (
    r"[\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)

# Python float() grammar: digits may be grouped by single underscores; inf/infinity/nan.
_DIGITS = r"[0-9](?:_?[0-9])*"
_EXP = rf"(?:[eE][+-]?{_DIGITS})"
FLOAT_PATTERN = (
    rf"^[+-]?(?:(?:{_DIGITS})?\.{_DIGITS}{_EXP}?|{_DIGITS}\.?{_EXP}?"
    r"|(?i:inf|infinity|nan))$"
)
INT_PATTERN = rf"^[+-]?{_DIGITS}$"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# The same whitespace set as characters, for btrim (scans only the two ends of the text).
PY_WS_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(
    chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000"


def py_strip(c) -> Column:
    """``str.strip()``: remove leading/trailing Python whitespace."""
    return F.btrim(col_(c), F.lit(PY_WS_CHARS))


def safe_float(c) -> Column:
    """``float(x)`` or NULL when it would raise. NaN and +-inf (any case, optional sign) are kept."""
    s = py_strip(col_(c).cast("string"))
    return (F.when(s.rlike(r"^[+-]?(?i:nan)$"), F.lit(float("nan")))
            .when(s.rlike(r"^\+?(?i:inf|infinity)$"), F.lit(float("inf")))
            .when(s.rlike(r"^-(?i:inf|infinity)$"), F.lit(float("-inf")))
            .when(s.rlike(FLOAT_PATTERN), F.regexp_replace(s, "_", "").try_cast("double")))


def safe_int(c, strict: bool = True) -> Column:
    """``int(x)`` on a string or NULL when it would raise.

    ``strict=True`` keeps Python's rule that ``"1.0"`` is not an int. ``strict=False``
    accepts any finite float text and truncates it toward zero.
    """
    s = py_strip(col_(c).cast("string"))
    exact = F.when(s.rlike(INT_PATTERN), F.regexp_replace(s, "_", "").try_cast("bigint"))
    if strict:
        return exact
    f = safe_float(c)
    loose = F.when(~F.isnan(f) & (F.abs(f) < F.lit(9.2e18)), f.cast("bigint"))
    return F.coalesce(exact, loose)


def flatten_newlines(c) -> Column:
    """``text.replace('\\n', ' ').strip()``."""
    return py_strip(F.replace(col_(c), F.lit("\n"), F.lit(" ")))


def split_words(c) -> Column:
    """``text.split()``: split on runs of whitespace, dropping empty ends."""
    s = py_strip(col_(c))
    return F.when(s == F.lit(""), F.array().cast("array<string>")).otherwise(F.split(s, f"{PY_WS}+"))


def ratio_or_zero(num, den) -> Column:
    """``num / den if den > 0 else 0`` with a NULL numerator treated as 0."""
    num, den = col_(num), col_(den)
    return F.when(den > 0, F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))).otherwise(
        F.lit(0.0)
    )


def content_hash(c) -> Column:
    """Hex SHA-256 of the UTF-8 text; a missing value hashes as the empty string."""
    return F.sha2(F.coalesce(col_(c), F.lit("")), 256)


def seeded_key(seed: int, key) -> Column:
    """Deterministic pseudo-random order key ``md5('<seed>:<key>')`` (portable to SQL)."""
    return F.md5(F.concat(F.lit(f"{seed}:"), col_(key).cast("string")))


def seeded_uniform(seed: int, key, salt: str = "") -> Column:
    """Deterministic uniform double in [0, 1) from ``md5('<seed>:<salt><key>')``."""
    h = F.md5(F.concat(F.lit(f"{seed}:{salt}"), col_(key).cast("string")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def seeded_int(seed: int, key, n, salt: str = "") -> Column:
    """Deterministic integer in [0, n) from ``md5('<seed>:<salt><key>')``."""
    h = F.md5(F.concat(F.lit(f"{seed}:{salt}"), col_(key).cast("string")))
    n = n if isinstance(n, Column) else F.lit(n)
    return F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint"), n.cast("bigint"))
