"""Unit normalisation, sub-indices, composite index and index bands.

Functions take column names and build one SQL expression each: the breakpoint and band
tables expand into CASE branches that stay inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K

def _text(value: str) -> str:
    return "'" + value.replace("'", "\\'") + "'"


def _number(value: float) -> str:
    return f"{float(value)!r}D"


def _names(values) -> str:
    return ", ".join(_text(v) for v in values)


def molar_mass_sql(parameter: str) -> str:
    """Converted units per ppb (or ppm) need a molar mass; null for other pollutants."""
    cases = " ".join(f"WHEN {_text(gas)} THEN {_number(mass)}" for gas, mass in K.MOLAR_MASS.items())
    return f"CASE lower({parameter}) {cases} END"


def by_molar_mass(value: str, parameter: str) -> Column:
    """ppb to ug/m3, and equally ppm to mg/m3, at 25 degrees C and one atmosphere; null for
    a pollutant without a molar mass."""
    return F.expr(f"{value} * {molar_mass_sql(parameter)} / {_number(K.MOLAR_VOLUME)}")


def normalize_value(parameter: str, value: str, unit: str) -> Column:
    """A raw numeric sensor value in the canonical unit of its pollutant.

    Null exactly where the raw value is null or NaN. Unit texts match by what they contain,
    whatever their case and blanks.
    """
    name, v = f"lower({parameter})", f"nullif(CAST({value} AS DOUBLE), double('NaN'))"
    u = f"replace(lower(coalesce({unit}, '')), ' ', '')"
    converted = f"{v} * {molar_mass_sql(parameter)} / {_number(K.MOLAR_VOLUME)}"

    def per_volume(*units: str) -> str:
        return "(" + " OR ".join(f"contains({u}, '{x}/m{three}')" for x in units for three in ("3", "³")) + ")"

    # Only gases look at the unit at all, and most of them only for ppb.
    return F.expr(f"""CASE
        WHEN {name} IN ({_names(K.PPB_GASES)}) THEN CASE WHEN contains({u}, 'ppb') THEN {converted} ELSE {v} END
        WHEN {name} IS DISTINCT FROM 'co' THEN {v}
        WHEN contains({u}, 'ppb') THEN {converted} / 1000.0D
        WHEN contains({u}, 'ppm') THEN {converted}
        WHEN {per_volume('mg')} THEN {v}
        WHEN {per_volume('ug', 'µg')} THEN {v} / 1000.0D
        ELSE {v} END""")


def canonical_unit(parameter: str, raw_unit: str) -> Column:
    cases = " ".join(f"WHEN {_text(p)} THEN {_text(unit)}" for p, unit in K.CANONICAL_UNIT.items())
    return F.expr(f"CASE {parameter} {cases} ELSE {raw_unit} END")


def sub_index_sql(pollutant: str, v: str, strict: bool = True) -> str:
    cases = []
    for low, high, index_low, index_high in K.BREAKPOINTS[pollutant]:
        slope = (index_high - index_low) / (high - low)
        start = _number(low) if strict else _number(0)
        cases.append(f"WHEN {v} BETWEEN {start} AND {_number(high)} "
                     f"THEN {_number(slope)} * ({v} - {_number(low)}) + {_number(index_low)}")
    top = K.BREAKPOINTS[pollutant][-1]
    # NaN sorts above every number, and has no index.
    cases.append(f"WHEN {v} > {_number(top[1])} AND NOT isnan({v}) THEN {_number(top[3])}")
    return f"CASE {' '.join(cases)} END"


def sub_index(pollutant: str, value: str, strict: bool = True) -> Column:
    """Linear sub-index of a numeric column between breakpoints.

    With ``strict`` the ranges are closed at both ends and leave gaps: a value in a gap,
    or below zero, has no index. Otherwise a gap belongs to the range above it.
    """
    return F.expr(sub_index_sql(pollutant, value, strict))


def sub_index_of(parameter: str, value: str, strict: bool = True) -> Column:
    """Sub-index of long-format rows, by the pollutant each row names."""
    cases = " ".join(f"WHEN {_text(p)} THEN {sub_index_sql(p, value, strict)}" for p in K.BREAKPOINTS)
    return F.expr(f"CASE {parameter} {cases} END")


def composite_index(columns, strict: bool = True) -> Column:
    """The largest sub-index of the pollutant columns present; null when none has one."""
    parts = [sub_index_sql(c, c, strict) for c in columns if c in K.BREAKPOINTS]
    return F.expr(parts[0] if len(parts) == 1 else f"greatest({', '.join(parts)})")


def _bands(value: str, bands: tuple) -> str:
    cases = " ".join(f"WHEN {value} <= {bound} THEN {_text(text)}" for bound, text in bands if bound is not None)
    return f"{cases} ELSE {_text(bands[-1][1])} END"


def advisory(index: str) -> Column:
    """Health advice for an index value."""
    return F.expr(f"CASE WHEN {index} IS NULL THEN NULL {_bands(index, K.ADVISORIES)}")


def category(index: str) -> Column:
    """Serving category; Unknown without an index."""
    return F.expr(f"CASE WHEN {index} IS NULL THEN 'Unknown' {_bands(index, K.SERVING_BANDS)}")


def profile_category(index: str) -> Column:
    """Reporting category over right-closed bins; null outside them."""
    edges = list(zip(K.PROFILE_EDGES, K.PROFILE_EDGES[1:], K.PROFILE_LABELS))
    cases = " ".join(f"WHEN {index} > {low} AND {index} <= {high} THEN {_text(text)}" for low, high, text in edges)
    return F.expr(f"CASE {cases} END")


def primary_pollutant(columns) -> Column:
    """Display name of the largest headline pollutant; missing counts as 0, first wins ties."""
    named = [(f"coalesce(nullif({p}, double('NaN')), 0.0D)", label) for p, label in K.HEADLINE_POLLUTANTS if p in columns]
    largest = f"greatest({', '.join(v for v, _ in named)})" if len(named) > 1 else named[0][0]
    cases = " ".join(f"WHEN {v} = {largest} THEN {_text(label)}" for v, label in named)
    return F.expr(f"CASE {cases} END")


def forecast_array(values: list[str] | Column, horizon: int = K.N_AHEAD) -> Column:
    """Non-negative half-even integers, cut or padded with the last value to ``horizon``."""
    raw = values if isinstance(values, Column) else F.expr(f"array({', '.join(values)})")
    whole = F.transform(raw, lambda v: F.greatest(F.lit(0), F.rint(v).cast("int")))
    last = F.try_element_at(whole, F.lit(-1))
    return F.slice(F.concat(whole, F.array_repeat(last, horizon)), 1, horizon)
