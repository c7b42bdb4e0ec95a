"""Durations as text, such as 1m30s or 1.5h."""

from __future__ import annotations

import re
from fractions import Fraction

#: Nanoseconds of each unit.
UNITS = {"ns": 1, "us": 10**3, "µs": 10**3, "μs": 10**3, "ms": 10**6, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9}

_TERM = re.compile(r"([0-9]*)(?:\.([0-9]*))?(ns|us|µs|μs|ms|s|m|h)")


def parse(text: str) -> int:
    """Nanoseconds. A sign, then terms of a number and a unit; a bare 0 is zero."""
    body = text[1:] if text[:1] in ("+", "-") else text
    if body == "0":
        return 0
    total, at = Fraction(0), 0
    while at < len(body):
        m = _TERM.match(body, at)
        if not m or not (m[1] or m[2]):
            raise ValueError(f"invalid duration {text!r}")
        total += Fraction(f"{m[1] or 0}.{m[2] or 0}") * UNITS[m[3]]
        at = m.end()
    if not body or total >= 1 << 63:
        raise ValueError(f"invalid duration {text!r}")
    return -int(total) if text[0] == "-" else int(total)


def show(ns: int) -> str:
    """Hours, minutes and seconds, the units above the largest one left out; below a second one smaller unit."""
    if ns == 0:
        return "0s"
    sign, ns = ("-", -ns) if ns < 0 else ("", ns)
    if ns < 10**9:
        unit = next(u for u in ("ms", "µs", "ns") if ns >= UNITS[u])
        return f"{sign}{_decimal(ns, UNITS[unit])}{unit}"
    hours, rest = divmod(ns, UNITS["h"])
    minutes, rest = divmod(rest, UNITS["m"])
    seconds = _decimal(rest, UNITS["s"]) + "s"
    if hours:
        return f"{sign}{hours}h{minutes}m{seconds}"
    return f"{sign}{minutes}m{seconds}" if minutes else f"{sign}{seconds}"


def _decimal(n: int, unit: int) -> str:
    whole, rest = divmod(n, unit)
    digits = f"{rest:0{len(str(unit)) - 1}d}".rstrip("0") if rest else ""
    return f"{whole}.{digits}" if digits else str(whole)
