"""Text and token-array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values. Pre-tokeniser: runs of letters, runs of digits, runs of anything else that is
# not a letter, digit, space, tab, CR or LF. Applied to the lower-cased text.
TOKEN_PATTERN = r"[\p{L}]+|[\p{N}]+|[^\p{L}\p{N} \n\t\r]+"

# Fixed values. Characters removed at both ends of a line by the line scan (the whitespace
# set of Python's str.strip: ASCII whitespace, 0x1c-0x1f, NEL, NBSP and the Unicode spaces).
STRIP_CLASS = (
    "[ \\t\\n\\r\\x{0B}\\x{0C}\\x{1C}\\x{1D}\\x{1E}\\x{1F}\\x{85}\\x{A0}\\x{1680}"
    "\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
)
LINE_BREAK = "\\r\\n|\\r|\\n"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def token_array(text) -> Column:
    """ARRAY<STRING> of tokens of the whole text."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(TOKEN_PATTERN), F.lit(0))


def strip_ws(s) -> Column:
    return F.regexp_replace(_c(s), F.lit(f"^{STRIP_CLASS}+|{STRIP_CLASS}+$"), F.lit(""))


def split_lines(text) -> Column:
    return F.split(_c(text), LINE_BREAK)


def range1(n) -> Column:
    """[1..n] as an array; empty when n < 1 (Spark's sequence would count down)."""
    n = _c(n)
    return F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: i <= n)


def next_pairs_array(arr) -> Column:
    """[(t_i, t_{i+1})] for i in 1..n-1 as ARRAY<STRUCT<pos, t, nxt>> - no shuffle needed. Shifted slices are zipped:
    a lambda over positions takes several times as long."""
    a = _c(arr)
    n = F.greatest(F.size(a) - 1, F.lit(0))
    at = F.slice(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(1), n)
    return F.arrays_zip(at.alias("pos"), F.slice(a, F.lit(1), n).alias("t"), F.slice(a, F.lit(2), n).alias("nxt"))


def kgram_array(arr, k: int, include_current: bool = True, pad=0) -> Column:
    """For every position i (1-based) the window of k tokens ending at i (inclusive) or at i-1
    (exclusive), left-padded with ``pad``."""
    a = _c(arr)
    shift = 0 if include_current else 1

    def ctx(i):
        return F.transform(
            F.sequence(F.lit(k - 1 + shift), F.lit(shift), F.lit(-1)),
            lambda j: F.when(i - j >= 1, F.element_at(a, F.greatest(i - j, F.lit(1)))).otherwise(F.lit(pad)),
        )

    return F.transform(range1(F.size(a)), lambda i: F.struct(i.alias("pos"), ctx(i).alias("ctx")))


def blocks_array(arr, block: int) -> Column:
    """Whole sequence cut into consecutive pieces of at most ``block`` items (nothing dropped)."""
    a = _c(arr)
    return F.transform(
        range1(F.ceil(F.size(a) / F.lit(block)).cast("int")),
        lambda b: F.slice(a, (b - 1) * block + 1, block),
    )


def truncate(arr, n: int) -> Column:
    """Keep the first n items (the reference's block_size cut)."""
    return F.slice(_c(arr), 1, n)


def tail(arr, n: int) -> Column:
    """Keep the last n items (rolling context)."""
    a = _c(arr)
    return F.slice(a, F.greatest(F.size(a) - n + 1, F.lit(1)), n)


def ids_string(arr) -> Column:
    """Stable text form of an integer array, e.g. '0,7,8'."""
    return F.array_join(F.transform(_c(arr), lambda x: x.cast("string")), ",")
