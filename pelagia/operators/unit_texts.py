"""Quantities in different units: read the units from texts, check them against the readings, convert.

A multi-pattern automaton finds all aliases of units in a file's header and note; the longest match at a
place wins and the field in front of it (accelerometer, gyroscope, magnetometer) resolves what an alias
alone leaves open ("mG" is milli-g behind an accelerometer and milligauss behind a magnetometer). The claimed
unit is the hypothesis. Texts can be silent or wrong, so the readings confirm or refute it: each unit's
likelihood is taken from the median and the upper decile of the size of the recorded vectors, converted to the
common unit and held against what a tag feels (gravity, the Earth's field, an animal's turning). The claim
enters as prior odds (`TRUST`), so it stands unless the readings speak clearly against it, and decides where
they are ambiguous or absent. `decided_by` tells which route a file took.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Spellings of each unit, by family of channels.
ALIASES = {
    "ax": {
        "g": ["g", "gee", "g0", "g-units", "g units", "gravities"],
        "mg": ["mg", "milli-g", "millig", "10^-3 g", "mg (acc)"],
        "m/s2": ["m/s2", "m/s^2", "m/s²", "m s-2", "ms-2", "ms⁻²", "m s⁻²", "m.s-2"],
    },
    "gx": {
        "rad/s": ["rad/s", "rad s-1", "rad s⁻¹", "radians per second", "rad/sec"],
        "mrad/s": ["mrad/s", "mrad s-1", "mrad s⁻¹", "millirad/s", "milliradians per second"],
        "deg/s": ["deg/s", "°/s", "º/s", "dps", "degrees/sec", "degrees per second", "deg s-1"],
    },
    "mx": {
        "uT": ["ut", "µt", "μt", "microtesla"],
        "nT": ["nt", "nanotesla", "ntesla"],
        "mG": ["mg", "mgauss", "milligauss"],
    },
}
# Words that name a family of channels.
FIELDS = {
    "ax": ["acceleration", "accelerometer", "accel", "acc", "ax", "ay", "az", "a"],
    "gx": ["gyroscope", "gyro", "gyr", "angvel", "gx", "gy", "gz", "wx", "wy", "wz", "g"],
    "mx": ["magnetometer", "mag", "field", "compass", "mx", "my", "mz", "bx", "by", "bz", "m"],
}
#: One unit in the common unit of its family (g, rad/s, µT).
FACTORS = {("ax", "g"): 1.0, ("ax", "mg"): 1e-3, ("ax", "m/s2"): 1 / 9.80665, ("gx", "rad/s"): 1.0, ("gx", "mrad/s"): 1e-3, ("gx", "deg/s"): 0.017453292519943295, ("mx", "uT"): 1.0, ("mx", "nT"): 1e-3, ("mx", "mG"): 0.1}
#: What a tag feels, in common units, as log-normal laws (centre, spread of the logarithm) of the vectors' median and upper decile.
FELT = {"ax": ((1.0, 0.35), (1.2, 0.5)), "gx": ((0.4, 0.6), (0.7, 0.7)), "mx": ((45.0, 0.4), (48.0, 0.5))}
#: The same for the largest single axis, where no whole vector is recorded: it says less.
FELT_AXIS = {"ax": ((0.6, 0.9), (0.9, 1.0)), "gx": ((0.25, 1.0), (0.5, 1.1)), "mx": ((30.0, 0.9), (35.0, 1.0))}
#: The share of texts that are taken to be right before the readings are looked at, and the log-odds from which the readings alone are clear.
TRUST, CLEAR = 0.95, 3.0
COMMON = {"ax": "g", "gx": "rad/s", "mx": "uT"}


def automaton():
    """The automaton over all aliases and field names; a match carries what it may stand for."""
    import ahocorasick

    found: dict[str, list] = {}
    for family, units in ALIASES.items():
        for unit, names in units.items():
            for name in names:
                found.setdefault(name.lower(), []).append(("unit", family, unit))
    for family, names in FIELDS.items():
        for name in names:
            found.setdefault(name, []).append(("field", family, ""))
    machine = ahocorasick.Automaton()
    for word, meanings in found.items():
        machine.add_word(word, (word, meanings))
    machine.make_automaton()
    return machine


def claimed_units(text: str | None, machine) -> dict[str, str]:
    """The unit that `text` claims for each family, by longest match behind the nearest field name.

    A family that the text does not mention, or for which it gives different units, is left out.
    """
    if not text:
        return {}
    low = text.lower().replace("_", " ")
    hits = []
    for end, (word, meanings) in machine.iter(low):
        begin = end - len(word) + 1
        before, after = low[begin - 1 : begin], low[end + 1 : end + 2]
        if (before.isalnum() and word[0].isalnum()) or (after.isalnum() and word[-1].isalnum()) or after == "^":
            continue
        hits.append((begin, end + 1, meanings))
    hits.sort(key=lambda h: (h[0], h[0] - h[1]))
    taken, chosen = 0, []
    for begin, stop, meanings in hits:
        if begin >= taken:
            chosen.append((begin, stop, meanings))
            taken = stop
    out: dict[str, set[str]] = {}
    field, since = None, 0
    for begin, stop, meanings in chosen:
        units = {f: u for kind, f, u in meanings if kind == "unit"}
        names = [f for kind, f, _ in meanings if kind == "field"]
        if field and field in units and not re.search(r"[|;\t\n]", low[since:begin]) and low[since:begin].count(",") == 0:
            out.setdefault(field, set()).add(units[field])
        elif names:
            field, since = names[0], stop
        elif len(units) == 1 and field is None:
            (only,) = units.items()
            out.setdefault(only[0], set()).add(only[1])
        elif len(units) == 1 and next(iter(units)) != field:  # a list of units without field names
            ((family, unit),) = units.items()
            out.setdefault(family, set()).add(unit)
    return {f: next(iter(u)) for f, u in out.items() if len(u) == 1}


def _claims(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    machine = automaton()
    for batch in batches:
        header, note = batch.column("header").to_pylist(), batch.column("note").to_pylist()
        cols: dict[str, list] = {f: [] for f in ALIASES}
        for h, n in zip(header, note):
            first, second = claimed_units(h, machine), claimed_units(n, machine)
            for f in cols:
                cols[f].append(first.get(f) or second.get(f))
        yield pa.RecordBatch.from_arrays([batch.column("ID"), batch.column("file_no"), *[pa.array(cols[f], pa.string()) for f in ALIASES]], ["ID", "file_no", *[f"said_{f}" for f in ALIASES]])


def factor_by_size(family: str, sizes):
    """The factor to the common unit that the readings alone suggest, from columns of median and upper decile (1 without
    sizes). Squared distances on a log scale are compared; their difference between two units is linear in the sizes."""
    laws = FELT[family]
    weight = sum(1 / spread**2 for _, spread in laws)
    lean = sum((F.log(F.greatest(size, F.lit(1e-12))) - math.log(centre)) / spread**2 for size, (centre, spread) in zip(sizes, laws)) / weight
    # The best factor x makes log(x) + lean nearest to zero, so the borders lie half-way between the logarithms of the factors.
    factors = sorted((x for (f, _), x in FACTORS.items() if f == family), reverse=True)
    out = F.lit(factors[-1])
    for low, high in reversed(list(zip(factors[1:], factors[:-1]))):
        out = F.when(lean < -(math.log(low) + math.log(high)) / 2, F.lit(high)).otherwise(out)
    return F.when(sizes[0].isNotNull(), out).otherwise(F.lit(1.0))


def file_units(data: DataFrame, files: DataFrame) -> DataFrame:
    """Rows ``ID, file_no, channel, unit, said, decided_by`` for every channel of every file that has values.

    The three axes of a family stand together. `said` is the unit that the texts claim (NULL if none); `decided_by`
    is ``both`` (the readings alone clearly confirm the claim), ``text`` (the readings are not clear or absent, the
    claim holds), ``readings`` (no claim, or the claim is refuted) or ``none`` (neither: the common unit). NaN is no
    value. Files without a row in `files` are judged by their readings alone. Repeated rows of `files` count once
    (the first claim in text order). Empty tables give an empty result.
    """
    value = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for f in ALIASES for c in (f[0] + "x", f[0] + "y", f[0] + "z")}
    ends = F.array(F.lit(0.5), F.lit(0.9))
    aggregates = []
    for f in ALIASES:
        axes = [value[f[0] + a] for a in "xyz"]
        aggregates += [
            F.percentile_approx(F.sqrt(axes[0] ** 2 + axes[1] ** 2 + axes[2] ** 2), ends, 100).alias(f"norm_{f}"),
            F.percentile_approx(F.greatest(*[F.abs(a) for a in axes]), ends, 100).alias(f"axis_{f}"),
            F.count(F.coalesce(*axes)).alias(f"n_{f}"),
        ]
    seen = data.where("ID is not null and file_no is not null").groupBy("ID", F.col("file_no").cast("bigint").alias("file_no")).agg(*aggregates)
    claims = files.select("ID", F.col("file_no").cast("bigint").alias("file_no"), "header", "note").where("ID is not null and file_no is not null").mapInArrow(_claims, "ID string, file_no bigint, " + ", ".join(f"said_{f} string" for f in ALIASES)).groupBy("ID", "file_no").agg(*[F.min(f"said_{f}").alias(f"said_{f}") for f in ALIASES])
    both = seen.join(claims, ["ID", "file_no"], "left")
    rows = [F.struct(F.lit(f).alias("channel"), F.col(f"said_{f}").alias("said"), F.col(f"n_{f}").alias("n"), *[F.get(F.coalesce(F.col(f"norm_{f}"), F.col(f"axis_{f}")), F.lit(k)).alias(f"size{k}") for k in (0, 1)], F.col(f"norm_{f}").isNull().alias("axis")) for f in ALIASES]
    asked = both.select("ID", "file_no", F.explode(F.array(*rows)).alias("x")).select("ID", "file_no", "x.*").where("n > 0").drop("n")
    return asked.mapInArrow(_decide, "ID string, file_no bigint, channel string, unit string, said string, decided_by string")


def decide(family: str, said: str | None, sizes: tuple[float | None, float | None], axis: bool) -> tuple[str, str]:
    """The unit of a channel and how it was decided, from the claimed unit and the recorded sizes (median, upper decile)."""
    units = [u for f, u in FACTORS if f == family]
    seen = sizes[0] is not None
    if not seen and said is None:
        return COMMON[family], "none"
    shown = dict.fromkeys(units, 0.0)
    for size, (centre, spread) in zip(sizes, (FELT_AXIS if axis else FELT)[family]) if seen else ():
        for u in units:
            shown[u] -= 0.25 * ((math.log(max(size, 1e-12)) + math.log(FACTORS[family, u] / centre)) / spread) ** 2
    held = {u: shown[u] + (0.0 if said is None else math.log(TRUST if u == said else (1 - TRUST) / (len(units) - 1))) for u in units}
    best = max(units, key=held.get)
    if said is None or best != said:
        return best, "readings"
    first, second = sorted(shown.values(), reverse=True)[:2]
    return best, "both" if shown[best] == first and first - second >= CLEAR else "text"


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        family, said, low, high, axis = (batch.column(c).to_pylist() for c in ("channel", "said", "size0", "size1", "axis"))
        found = [decide(*row) for row in zip(family, said, zip(low, high), axis)]
        yield pa.RecordBatch.from_arrays([batch.column("ID"), batch.column("file_no"), batch.column("channel"), pa.array([u for u, _ in found], pa.string()), batch.column("said"), pa.array([d for _, d in found], pa.string())], ["ID", "file_no", "channel", "unit", "said", "decided_by"])


def units_to_convert(data: DataFrame, files: DataFrame) -> DataFrame:
    """The channels of files that are not in the common unit: ``ID, file_no, channel, unit``."""
    other = " or ".join(f"(channel = '{f}' and unit <> '{u}')" for f, u in COMMON.items())
    return file_units(data, files).where(other).select("ID", "file_no", "channel", "unit")


def to_common_units(data: DataFrame, files: DataFrame) -> DataFrame:
    """`data` with all axes in g, rad/s and µT; other columns are kept, missing readings stay missing."""
    spark = data.sparkSession
    factors = spark.createDataFrame([(f, u, x) for (f, u), x in FACTORS.items()], "channel string, unit string, factor double")
    # The factor table is fixed in this module (nine rows), so it may be broadcast.
    of = file_units(data, files).join(F.broadcast(factors), ["channel", "unit"]).groupBy("ID", "file_no").agg(*[F.max(F.when(F.col("channel") == f, F.col("factor"))).alias(f"__{f}") for f in ALIASES])
    axes = {f[0] + a: f"__{f}" for f in ALIASES for a in "xyz"}
    joined = data.withColumn("file_no", F.col("file_no").cast("bigint")).join(of, ["ID", "file_no"], "left")
    return joined.select(*[(F.col(c) * F.coalesce(F.col(axes[c]), F.lit(1.0))).alias(c) if c in axes else F.col(c) for c in data.columns])
