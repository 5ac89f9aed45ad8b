"""Length and voltage units."""

from __future__ import annotations

import math
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Metres in a unit, volts in a unit.
LENGTHS = {"Gm": 1e9, "Mm": 1e6, "km": 1e3, "m": 1.0, "mm": 1e-3, "µm": 1e-6, "nm": 1e-9, "Å": 1e-10, "pm": 1e-12, "fm": 1e-15}
VOLTAGES = {"kV": 1e3, "V": 1.0, "mV": 1e-3, "µV": 1e-6, "nV": 1e-9}
# Other spellings.
SPELLINGS = {"μm": "µm", "um": "µm", "A": "Å", "Å": "Å", "Angstrom": "Å", "angstrom": "Å", "microns": "µm", "μV": "µV", "uV": "µV"}
ASCII = {"µm": "um", "Å": "A"}


class UnitError(ValueError):
    """Units of different kinds, or unknown ones."""


def canonical(unit: str) -> str:
    unit = unit.strip()
    return SPELLINGS.get(unit, unit)


def to_ascii(unit: str) -> str:
    unit = canonical(unit)
    return ASCII.get(unit, unit)


def conversion_factor(source: str, target: str) -> float:
    """What values in source are multiplied with to be in target."""
    a, b = canonical(source), canonical(target)
    for known in (LENGTHS, VOLTAGES):
        if a in known and b in known:
            return known[a] / known[b]
    raise UnitError(f"{source} can't be converted to {target}")


def is_length_unit(unit: str) -> bool:
    return canonical(unit) in LENGTHS


def find_length_unit(text: str) -> str | None:
    """The first length unit named in a text, longer names first."""
    for word in text.replace("(", " ").replace(")", " ").replace("[", " ").replace("]", " ").split():
        if is_length_unit(word):
            return canonical(word)
    return None


def suggest_length_unit(scale: str, low: float, high: float) -> str:
    """The unit in which low..high (metres) read best; scale 'linear' looks at the larger, 'log' at the geometric middle."""
    if scale not in ("linear", "log"):
        raise ValueError(f"scale {scale!r}: neither linear nor log")
    top = max(abs(low), abs(high)) if scale == "linear" else math.sqrt(abs(low) * abs(high))
    if top == 0 or not math.isfinite(top):
        return "m"
    power = 3 * math.floor(math.log10(top) / 3 + 1e-12)
    known = {-15: "fm", -12: "pm", -9: "nm", -6: "µm", -3: "mm", 0: "m", 3: "km", 6: "Mm", 9: "Gm"}
    return known[min(max(power, -15), 9)]


def suggest_length_unit_for_data(scale: str, data: DataFrame, column: str, unit: str) -> str:
    """suggest_length_unit for the values of a column in unit: one aggregate. Infinite values keep the unit; no values at all are an error."""
    c = F.col(column)
    low, high, wild = data.where(c.isNotNull() & ~F.isnan(c)).agg(F.min(c), F.max(c), F.max(F.abs(c) == float("inf"))).first()
    if low is None:
        raise ValueError("no values")
    f = conversion_factor(unit, "m")
    return unit if wild else suggest_length_unit(scale, f * low, f * high)


def factor_column(source: Column, target: Column | str) -> Column:
    """conversion_factor as an expression; null where a unit is unknown or the kinds differ."""
    target = F.lit(target) if isinstance(target, str) else target
    spell = F.create_map(*map(F.lit, chain(*SPELLINGS.items())))
    out = None
    for known in (LENGTHS, VOLTAGES):
        m = F.create_map(*map(F.lit, chain(*known.items())))
        a, b = (F.try_element_at(m, F.coalesce(F.try_element_at(spell, F.trim(c)), F.trim(c))) for c in (source, target))
        out = a / b if out is None else F.coalesce(out, a / b)
    return out


def to_unit(points: DataFrame, source: str, target: str, columns: tuple[str, ...] = ("h", "x", "y", "sx", "sy")) -> DataFrame:
    """Heights, positions and sizes, as far as they are there, in another unit."""
    f = conversion_factor(source, target)
    return points.withColumns({c: F.col(c) * F.lit(f) for c in columns if c in points.columns})


def curves_to_unit(curves: DataFrame, target: str, powers: dict[str, float], unit: str = "unit") -> DataFrame:
    """Columns of curves, each row in the length unit that its column `unit` names, in one unit; that column then holds the target.

    powers: of the length in each column, for instance {"q": -1, "psd": 3}. A row whose unit is unknown, null or no length fails the job.
    """
    if not is_length_unit(target):
        raise UnitError(f"{target} is no length unit")
    f = F.coalesce(factor_column(F.col(unit), target), F.raise_error(F.concat(F.lit("UnitError: no conversion of "), F.coalesce(unit, F.lit("null")), F.lit(f" to {target}"))).cast("double"))
    c = curves.withColumn("_f", f)
    return c.withColumns({k: F.col(k) * F.pow("_f", F.lit(float(v))) for k, v in powers.items()}).withColumn(unit, F.lit(canonical(target))).drop("_f")
