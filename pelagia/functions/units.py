"""Unit conversion and unit names."""

from __future__ import annotations

import re
import unicodedata
import warnings

from pyspark.sql import Column
from pyspark.sql import functions as F

# What one unit is in the canonical unit of its quantity, and what is added.
TO_CANONICAL = {
    "g": ("accel", 1.0, 0.0), "m/s2": ("accel", 1 / 9.80665, 0.0), "mg": ("accel", 1e-3, 0.0),
    "rad/s": ("gyro", 1.0, 0.0), "deg/s": ("gyro", 0.017453292519943295, 0.0), "mrad/s": ("gyro", 1e-3, 0.0),
    "uT": ("mag", 1.0, 0.0), "nT": ("mag", 1e-3, 0.0), "mG": ("mag", 0.1, 0.0),
    "m": ("depth", 1.0, 0.0), "dbar": ("depth", 0.9945, 0.0), "bar": ("depth", 9.945, 0.0), "ft": ("depth", 0.3048, 0.0),
    "C": ("temp", 1.0, 0.0), "F": ("temp", 5 / 9, -160 / 9), "K": ("temp", 1.0, -273.15),
    "m/s": ("speed", 1.0, 0.0), "km/h": ("speed", 1 / 3.6, 0.0), "knot": ("speed", 0.514444, 0.0), "mph": ("speed", 0.44704, 0.0),
    "Hz": ("rate", 1.0, 0.0),
}
CANONICAL = {"accel": "g", "gyro": "rad/s", "mag": "uT", "depth": "m", "temp": "C", "speed": "m/s", "rate": "Hz"}


def linear(source: str, target: str | None = None) -> tuple[float, float] | None:
    """Factor and offset from `source` to `target` (the canonical unit if None); None for an unknown pair."""
    if source not in TO_CANONICAL:
        return None
    kind, a, b = TO_CANONICAL[source]
    target = target or CANONICAL[kind]
    if target not in TO_CANONICAL or TO_CANONICAL[target][0] != kind:
        return None
    _, c, d = TO_CANONICAL[target]
    return a / c, (b - d) / c


def convert(value: Column, source: str, target: str | None = None) -> Column:
    """`value` in another unit; an unknown pair warns and passes through."""
    found = linear(source, target)
    if found is None:
        warnings.warn(f"no conversion from {source} to {target}; values are left as they are", stacklevel=2)
        return value
    factor, offset = found
    return value * F.lit(factor) + F.lit(offset)


def normalise_header(name: str) -> str:
    """A column header without case, spaces and the variants of degree, micro and superscript signs."""
    text = unicodedata.normalize("NFKC", name.encode("utf-8", "replace").decode("utf-8", "replace")).strip().lower()
    text = text.replace("º", "deg").replace("°", "deg").replace("μ", "u").replace("µ", "u").replace("−", "-").replace("^", "")
    return re.sub(r"[\s_]+", " ", text)


# Sensor tokens and the channels that they stand for.
TOKENS = {"accel": ["ax", "ay", "az"], "gyro": ["gx", "gy", "gz"], "mag": ["mx", "my", "mz"]}


def expand_tokens(tokens: list[str]) -> list[str]:
    """Channels of families and channel names, without repeats, in order."""
    return list(dict.fromkeys(c for t in tokens for c in TOKENS.get(t, [t])))


def families_of(channels: list[str]) -> list[str]:
    """Families that have at least one of the channels; other channels stay as they are."""
    back = {c: f for f, cs in TOKENS.items() for c in cs}
    return list(dict.fromkeys(back.get(c, c) for c in channels))
