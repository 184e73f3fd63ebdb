"""Length units: SI prefixes, names and factors."""

from __future__ import annotations

# Powers of ten of the SI prefixes, and metres to a unit's name.
SI_POWERS = {
    "EXA": 18, "PETA": 15, "TERA": 12, "GIGA": 9, "MEGA": 6, "KILO": 3, "HECTO": 2, "DECA": 1,
    "DECI": -1, "CENTI": -2, "MILLI": -3, "MICRO": -6, "NANO": -9, "PICO": -12, "FEMTO": -15, "ATTO": -18,
}
METRES = {"m": 1.0, "mm": 0.001, "cm": 0.01, "dm": 0.1, "ft": 0.3048, "in": 0.0254, "km": 1000.0}


def length_scale(prefix: str | None) -> float:
    """Metres for an SI prefix of the metre."""
    return 10.0 ** SI_POWERS[prefix] if prefix else 1.0


def factor(unit: str | float, native: float = 1.0) -> float:
    """What metres are multiplied by to be in a unit: a name, `native` for the model's own, or a number as it is."""
    if not isinstance(unit, str):
        return float(unit)
    if unit == "native":
        return 1.0 / native
    if unit not in METRES:
        raise ValueError(f"unknown unit {unit!r}; known: native, {', '.join(METRES)}")
    return 1.0 / METRES[unit]


def name_of(scale: float | None) -> str:
    """A scale's unit name, within 1e-9; unknown if there is none."""
    return next((n for n, s in METRES.items() if scale is not None and abs(s - scale) < 1e-9), "unknown")
