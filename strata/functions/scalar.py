"""Scalar column functions (P3-P10, P13-P21, P24). All are built-in expressions, so they
stay inside whole-stage codegen; none is a Python UDF."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c: Column | str) -> Column:
    """Trim all leading/trailing whitespace (Python ``str.strip``), not only spaces."""
    return F.regexp_replace(_c(c), r"^\s+|\s+$", "")


def clean_category(c: Column | str, missing: str | None = "ND") -> Column:
    """Trim + upper-case; blank or missing → ``missing`` (or the text ``NAN`` when
    ``missing`` is None, as a plain ``astype(str)`` would give)."""
    t = F.upper(strip_ws(_c(c)))
    if missing is None:
        return F.coalesce(t, F.lit("NAN"))
    return F.when(t.isNull() | t.isin("", "NAN"), F.lit(missing)).otherwise(t)


def clean_name(c: Column | str) -> Column:
    """P5: drop single quotes, trim, squeeze inner whitespace to one space."""
    return F.regexp_replace(strip_ws(F.regexp_replace(_c(c), "'", "")), r"\s+", " ")


def ratio_clip(a: Column | str, b: Column | str, lo: float = 0.0, hi: float = 1.5) -> Column:
    """A / b with b = 0 → missing, clipped to [lo, hi], missing → 0."""
    q = F.try_divide(_c(a), F.when(_c(b) != 0, _c(b)))
    return F.least(F.greatest(F.coalesce(q, F.lit(0.0)), F.lit(lo)), F.lit(hi))


def log1p(c: Column | str) -> Column:
    """P7."""
    return F.log1p(_c(c))


def per_unit(a: Column | str, k: Column | str) -> Column:
    """Amount per unit; a zero count gives missing instead of an error."""
    return F.try_divide(_c(a).cast("double"), F.when(_c(k) != 0, _c(k)).cast("double"))


def ordinal_map(c: Column | str, mapping: dict[str, int], default: int = 1) -> Column:
    """Ordered labels → integers, unknown or missing → default."""
    e = None
    for k, v in mapping.items():
        e = (F.when(_c(c) == k, F.lit(v)) if e is None else e.when(_c(c) == k, F.lit(v)))
    return e.otherwise(F.lit(default)).cast("int")


def flag(cond: Column) -> Column:
    """Predicate as 0/1 integer (missing → 0, like a pandas comparison)."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def cut_bins(c: Column | str, edges: Sequence[float], labels: Sequence | None = None) -> Column:
    """Right-closed bins (e_i, e_{i+1}]; outside → missing. Labels default to the
    interval text. Not ``Bucketizer`` (left-closed)."""
    x = _c(c)
    labels = list(labels) if labels is not None else [f"({edges[i]}, {edges[i + 1]}]" for i in range(len(edges) - 1)]
    e = None
    for i in range(len(edges) - 1):
        cond = (x > F.lit(edges[i])) & (x <= F.lit(edges[i + 1]))
        e = F.when(cond, F.lit(labels[i])) if e is None else e.when(cond, F.lit(labels[i]))
    return e


def count_below(c: Column | str, edges: Sequence[float]) -> Column:
    """Number of (sorted) literal edges strictly below the value: the index of the
    right-closed bin, as a CASE chain that stays in whole-stage codegen. Missing → NULL."""
    x = _c(c)
    e = None
    for i, edge in enumerate(edges):
        cond = x <= F.lit(float(edge))
        e = F.when(cond, F.lit(i)) if e is None else e.when(cond, F.lit(i))
    res = F.lit(len(edges)) if e is None else e.otherwise(F.lit(len(edges)))
    return F.when(x.isNotNull(), res)


def clip_upper(c: Column | str, hi: float) -> Column:
    """Cap a value; missing stays missing (``least`` alone would turn it into ``hi``)."""
    return F.when(_c(c).isNotNull(), F.least(_c(c), F.lit(hi)))


def clip_range(c: Column | str, lo: float, hi: float) -> Column:
    """Keep a value inside [lo, hi], missing stays missing."""
    return F.when(_c(c).isNotNull(), F.least(F.greatest(_c(c), F.lit(lo)), F.lit(hi)))


def row_signature(cols: Sequence[Column | str], sep: str = "|", null_text: str = "nan") -> Column:
    """48-bit integer id from the md5 of the joined attribute texts.

    Missing cells are replaced by ``null_text`` first, because ``concat_ws`` would skip
    them and two different vectors could collide."""
    txt = F.concat_ws(sep, *[F.coalesce(_c(c).cast("string"), F.lit(null_text)) for c in cols])
    return F.conv(F.substring(F.md5(txt), 1, 12), 16, 10).cast("long")


def conditional_label(cond: Column, yes: str = "Yes", no: str = "No") -> Column:
    """P19."""
    return F.when(F.coalesce(cond, F.lit(False)), F.lit(yes)).otherwise(F.lit(no))


def round_half_even(c: Column | str, digits: int) -> Column:
    """P20: numpy / pandas rounding: scale, round half-to-even on the binary value
    (``rint``), scale back. ``bround`` would round the decimal text instead and differ
    on values such as 0.545."""
    f = float(10 ** digits)
    return F.rint(_c(c) * F.lit(f)) / F.lit(f)


def strip_prefix(c: Column | str, pattern: str = r"^\d+b?[.\-]\s*") -> Column:
    """Remove an ordinal prefix such as ``4-`` or ``2b. ``."""
    return F.regexp_replace(_c(c), pattern, "")


def set_to_text(arr: Column | str, sep: str = " + ") -> Column:
    """Sorted members joined with a separator."""
    return F.array_join(F.array_sort(_c(arr)), sep)


def format_pct(c: Column | str, digits: int = 1) -> Column:
    """0.1234 → '12.3%'."""
    return F.concat(F.format_number(_c(c) * 100, digits), F.lit("%"))


def format_thousands(c: Column | str, digits: int = 0) -> Column:
    """1234567.8 → '1,234,568'."""
    return F.format_number(_c(c), digits)
