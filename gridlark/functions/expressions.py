"""Scalar expressions: identifiers, tolerant casts, missing values, bands and stars."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# First digit of a firm code to its exchange, relation codes, and the bands of a ranking's quality.
EXCHANGES = {"0": ".SZ", "3": ".SZ", "6": ".SH", "4": ".BJ", "8": ".BJ"}
RELATIONS = ["E1_HOLDS_BY", "E2_LEGAL_REP", "E3_MANAGER", "E4_CO_INVEST", "E5_CO_MGR"]
BANDS = [(0.55, "none"), (0.60, "weak")]
STARS = [(0.001, "***"), (0.01, "**"), (0.05, "*")]


def zfill(c: Column, width: int = 6) -> Column:
    """Zeros on the left up to the width; longer strings stay whole, which lpad alone would cut."""
    return F.lpad(c, F.greatest(F.length(c), F.lit(width)), F.lit("0"))


def firm_of(ts_code: Column) -> Column:
    return zfill(F.substring_index(ts_code, ".", 1))


def exchange_suffix(firm_id: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in EXCHANGES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.substring(firm_id, 1, 1)), F.lit(".SZ"))


def ts_code(firm_id: Column) -> Column:
    return F.concat(zfill(firm_id), exchange_suffix(zfill(firm_id)))


def party_type(node_id: Column) -> Column:
    return F.when(node_id.startswith("PID:"), "related_party").when(node_id.startswith("NM:"), "related_party_named").otherwise("unknown")


def number(c: Column, kind: str = "double") -> Column:
    """A number, or null for what isn't one (and for NaN)."""
    x = c.try_cast(kind)
    return F.nanvl(x.cast("double"), F.lit(None)).cast(kind)


def filled(c: Column, value: float = 0.0) -> Column:
    """Null and NaN as a value."""
    return F.coalesce(F.nanvl(c.cast("double"), F.lit(None)), F.lit(value))


def banded(auc: Column) -> Column:
    out = F.lit("signal")
    for limit, name in reversed(BANDS):
        out = F.when(auc < limit, name).otherwise(out)
    return out


def stars(p: Column) -> Column:
    out = F.lit("")
    for limit, mark in reversed(STARS):
        out = F.when(p < limit, mark).otherwise(out)
    return out
