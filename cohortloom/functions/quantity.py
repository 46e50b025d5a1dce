"""Quantities in text: a small grammar for unit expressions, with dimensions as exponent vectors.

    expression := factor { ("*" | "." | "/" | "per") factor }      factor := [prefix] symbol [ ["^"] integer ]

A unit is (exponents over ``BASES``, scale, offset): value in canonical units = value * scale + offset.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

#: The base dimensions, and the days of a mean Gregorian month and year.
BASES = ("time", "length", "mass", "temperature", "amount", "count")
YEAR_DAYS = 365.25
MONTH_DAYS = YEAR_DAYS / 12


class Unit(NamedTuple):
    dims: tuple[int, ...]
    scale: float
    offset: float = 0.0
    name: str = ""


def _u(base: str, scale: float, offset: float = 0.0, name: str = "") -> Unit:
    return Unit(tuple(int(b == base) for b in BASES), scale, offset, name)


#: Spellings of units (English, German), by their canonical name. Canonical scales: days, metres, grams, kelvins, moles.
SPELLINGS = {
    "seconds": ("s", "sec", "secs", "second", "seconds", "sekunde", "sekunden"),
    "minutes": ("min", "mins", "minute", "minutes", "minuten"),
    "hours": ("h", "hr", "hrs", "hour", "hours", "stunde", "stunden", "std"),
    "days": ("d", "dy", "dys", "day", "days", "tag", "tage", "tagen"),
    "weeks": ("w", "wk", "wks", "week", "weeks", "woche", "wochen"),
    "months": ("mo", "mos", "mon", "mons", "mth", "mths", "mnth", "mnths", "month", "months", "monat", "monate", "monaten"),
    "years": ("y", "yr", "yrs", "year", "years", "a", "j", "jahr", "jahre", "jahren"),
    "metres": ("m", "metre", "metres", "meter", "meters"),
    "inches": ("in", "inch", "inches"),
    "grams": ("g", "gram", "grams", "gramm"),
    "litres": ("l", "litre", "litres", "liter", "liters"),
    "kelvins": ("k", "kelvin"),
    "celsius": ("°c", "degc", "celsius"),
    "fahrenheit": ("°f", "degf", "fahrenheit"),
    "moles": ("mol", "mole", "moles"),
    "percent": ("%", "percent", "prozent"),
}
_BASIC = {
    "seconds": _u("time", 1 / 86400), "minutes": _u("time", 1 / 1440), "hours": _u("time", 1 / 24), "days": _u("time", 1.0), "weeks": _u("time", 7.0), "months": _u("time", MONTH_DAYS), "years": _u("time", YEAR_DAYS),
    "metres": _u("length", 1.0), "inches": _u("length", 0.0254), "grams": _u("mass", 1.0), "litres": Unit((0, 3, 0, 0, 0, 0), 1e-3), "kelvins": _u("temperature", 1.0), "celsius": _u("temperature", 1.0, 273.15),
    "fahrenheit": _u("temperature", 5 / 9, 459.67 * 5 / 9), "moles": _u("amount", 1.0), "percent": Unit((0,) * 6, 0.01),
}
_BY_SPELLING = {s: _BASIC[n]._replace(name=n) for n, ss in SPELLINGS.items() for s in ss}
_PREFIXES = {"k": 1e3, "d": 1e-1, "c": 1e-2, "m": 1e-3, "µ": 1e-6, "u": 1e-6, "n": 1e-9}
_PREFIXED = {"metres", "grams", "litres", "moles", "seconds"}
_TOKEN = re.compile(r"\s*(?:(per\b|[*/·])|(°?[a-zäöüµ%]+)\.?\s*\^?(-?\d+)?)\s*")


@lru_cache(maxsize=4096)
def parse_unit(text: str) -> Unit | None:
    """The unit that an expression names; None if it names none. ``mg/l``, ``mo.``, ``kg*m^2`` and ``°C`` are such."""
    text, at, sign, first = text.strip().strip("()[]").strip().lower(), 0, 1, True
    dims, scale, offset, name = [0] * len(BASES), 1.0, 0.0, ""
    if not text:
        return None
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            return None
        at = m.end()
        if m[1]:
            if first or at >= len(text):
                return None
            sign = -1 if m[1] in ("/", "per") else 1
            continue
        unit, factor = _BY_SPELLING.get(m[2]), 1.0
        if unit is None and m[2][:1] in _PREFIXES and (unit := _BY_SPELLING.get(m[2][1:])) is not None:
            if unit.name not in _PREFIXED:
                return None
            factor, unit = _PREFIXES[m[2][0]], unit._replace(name="")
        if unit is None:
            return None
        power = sign * int(m[3] or 1)
        dims = [a + power * b for a, b in zip(dims, unit.dims, strict=True)]
        scale *= (factor * unit.scale) ** power
        offset, name = (unit.offset, unit.name) if first and power == 1 and factor == 1 else (0.0, "")
        first, sign = False, 1
    return None if first else Unit(tuple(dims), scale, offset, name)


def to_canonical(value: float, unit: Unit) -> float:
    return value * unit.scale + unit.offset


def convert(value: float, source: Unit, target: Unit) -> float:
    """``value`` in ``target``; units of different dimensions raise ValueError."""
    if source.dims != target.dims:
        raise ValueError("the units differ in dimension")
    return (to_canonical(value, source) - target.offset) / target.scale
