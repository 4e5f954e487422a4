"""Timestamps as text, of many forms, precisions and zones, to UTC instants.

Texts are read once, in Arrow batches (as expressions of the planner the many patterns outgrow generated code),
and what they state is kept in the shared folder; everything behind that is built-in. What a text leaves open is settled in this order:

* day or month first: per (ID, log_file), by any part above 12, else by the order that gives the shorter
  record, else by the one nearer to the deployment;
* the zone: in the text, else the line's zone column, else the deployment's zone, else an estimate for the log: of
  all constant offsets and all offset histories of named zones the one that puts the fewest lines before their
  predecessor, behind their successor or behind their time of ingestion, then the one that fits these closest;
* local times that occur twice (clocks set back): candidate offset histories of the log are compared along
  the line numbers. A history is the line at which the offset changes; the one with the fewest steps back in
  time wins, then the one with the most even steps. Only the lines around such an hour take part,
  grouped by (ID, log_file, day), so a large log is never sorted as a whole.
"""

from __future__ import annotations

import datetime
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pelagia.grouped import numbers, over_sorted_groups
from pelagia.runtime import cut

# Month names by their first letters, in the languages that loggers are set to.
MONTHS = {
    1: ["jan", "ene", "gen", "janv"], 2: ["feb", "fév", "fev", "fevr"], 3: ["mar", "mär", "mrz", "maa", "mrt"], 4: ["apr", "abr", "avr"],
    5: ["may", "mai", "mei", "maj", "mag"], 6: ["jun", "juin", "giu"], 7: ["jul", "juil", "lug"], 8: ["aug", "ago", "aoû", "aou"],
    9: ["sep", "set", "sept"], 10: ["oct", "okt", "out", "ott"], 11: ["nov"], 12: ["dec", "dez", "dic", "déc", "des"],
}
# Minutes east of Greenwich of zone abbreviations.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "AZOT": -60, "AZOST": 0, "NST": -210, "NDT": -150, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300,
    "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600, "IST": 330, "JST": 540,
    "AWST": 480, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780, "SAST": 120,
}

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
_WORD = r"([^\W\d_]{3,})\.?"
#: The forms of a text, each with the names of its groups in order.
_FORMS = [
    ("compact", re.compile(r"(\d{4})(\d{2})(\d{2})[T ]?(\d{2})(\d{2})(\d{2})(?:[.,](\d{1,9}))?(?=$|[ Z+\[-])(.*)"), "y mo d h mi s f rest"),
    ("ymd", re.compile(r"(\d{4})([-/.])(\d{1,2})\2(\d{1,2})[T ] ?" + _TIME + "(.*)"), "y - mo d h mi s f rest"),
    ("open", re.compile(r"(\d{1,2})([-/.])(\d{1,2})\2(\d{4})[T ,] ?" + _TIME + "(.*)"), "a - b y h mi s f rest"),
    ("worded", re.compile(r"(?:[^\W\d_]{2,},? )?(\d{1,2})[ -]" + _WORD + r"[ -](\d{4})[T ,] ?" + _TIME + "(.*)"), "d word y h mi s f rest"),
    ("first", re.compile(_TIME + r" (\d{1,2})[ -]" + _WORD + r"[ -](\d{4})(.*)"), "h mi s f d word y rest"),
]
_FORMS = [(kind, form, names.split()) for kind, form, names in _FORMS]
_EPOCH = re.compile(r"(\d{9,10})(?:[.,](\d{1,9}))?$|(\d{12,13})$|(\d{15,16})$")
_HALF = re.compile(r" ?([AP])\.?M\b\.?", re.IGNORECASE)
_OFFSET = re.compile(r"(?:UTC|GMT)?\s*([+-])(\d{1,2})(?::?(\d{2}))?$", re.IGNORECASE)
_DAY = 86_400_000_000


def zone_of(text: str | None, known: frozenset[str]) -> tuple[int | None, str | None]:
    """Minutes east of Greenwich, or the name of a zone; neither if `text` states none."""
    text = (text or "").strip(" []()")
    if not text:
        return None, None
    if m := _OFFSET.match(text):
        hours, rest = int(m[2]), int(m[3] or 0)
        if hours <= 18 and rest < 60:
            size = hours * 60 + rest
            return (-size if m[1] == "-" else size), None
    if text.upper() in ABBREVIATIONS:
        return ABBREVIATIONS[text.upper()], None
    return (None, text) if text in known else (None, None)


def _days(y: int, mo: int | None, d: int) -> int | None:
    """Days since the epoch; None if there is no such date."""
    try:
        return datetime.date(y, mo or 0, d).toordinal() - 719_163 if y >= 1970 else None
    except ValueError:
        return None


def read_time(text: str | None) -> tuple[int | None, int | None, int | None, str]:
    """What `text` states: microseconds since the epoch, or local microseconds with the day first and with
    the month first (the same unless the text leaves it open), and the text of its zone."""
    t = " ".join((text or "").strip(" \t\r\n\"'\u00a0\ufeff").split())
    if m := _EPOCH.match(t):
        if m[1]:
            return int(m[1]) * 1_000_000 + int(((m[2] or "") + "000000")[:6]), None, None, ""
        return (int(m[3]) * 1000 if m[3] else int(m[4])), None, None, ""
    for kind, form, names in _FORMS:
        if not (m := form.match(t)):
            continue
        g = dict(zip(names, m.groups()))
        hour, rest = int(g["h"]), g["rest"]
        if half := _HALF.match(rest):
            if not 1 <= hour <= 12:
                return None, None, None, ""
            hour, rest = hour % 12 + 12 * (half[1] in "Pp"), rest[half.end() :]
        minute, second = int(g["mi"]), int(g["s"] or 0)
        if hour > 23 or minute > 59 or second > 60:
            return None, None, None, ""
        clock = ((hour * 60 + minute) * 60 + second) * 1_000_000 + int(((g["f"] or "") + "000000")[:6])
        y = int(g["y"])
        if kind == "open":
            a, b = int(g["a"]), int(g["b"])
            days = _days(y, b, a), _days(y, a, b)
        else:
            month = int(g["mo"]) if "mo" in g else _month_of(g["word"])
            days = (_days(y, month, int(g["d"])),) * 2
        first, second_ = (None if n is None else n * _DAY + clock for n in days)
        return None, first, second_, rest
    return None, None, None, ""


def _month_of(word: str) -> int | None:
    low = unicodedata.normalize("NFC", word).lower()
    return next((n for size in (4, 3) for n, names in MONTHS.items() if low[:size] in names), None)


def _parser(known: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}

        def zone(text):
            if text not in seen:
                seen[text] = zone_of(text, known)
            return seen[text]

        for batch in batches:
            epoch, dmy, mdy, minutes, name = [], [], [], [], []
            for text, tz, home in zip(*(batch.column(c).to_pylist() for c in ("text", "tz", "home"))):
                e, first, second, rest = read_time(text)
                m, n = next((z for z in map(zone, (rest, tz, home)) if z != (None, None)), (None, None)) if e is None and (first is not None or second is not None) else (None, None)
                for column, value in ((epoch, e), (dmy, first), (mdy, second), (minutes, m), (name, n)):
                    column.append(value)
            kept = [batch.column(c) for c in ("raw_id", "ID", "log_file", "line_no", "dt", "received")]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(x, pa.int64()) for x in (epoch, dmy, mdy, minutes)), pa.array(name, pa.string())], ["raw_id", "ID", "log_file", "line_no", "dt", "received", "epoch", "dmy", "mdy", "minutes", "name"])

    return run


def _settle(data: pa.Table, starts: np.ndarray) -> pa.Table:
    """For each group in line order, where the clock was set back."""
    line, base, shift, rid = (numbers(data, c) for c in ("line_no", "u", "shift", "raw_id"))
    base, shift = base.astype(np.int64), shift.astype(np.int64)
    ends, late = np.r_[starts[1:], len(line)], np.zeros(len(line), bool)
    for a, b in zip(starts.tolist(), ends.tolist()):
        unclear = np.flatnonzero(shift[a:b] > 0)
        if not len(unclear):
            continue
        _, first, back = np.unique(line[a:b], return_index=True, return_inverse=True)
        u, s = base[a:b][first].astype(float) / 1e6, shift[a:b][first] / 1e6
        n = len(u)
        ways = [(u[1:] - u[:-1]), (u[1:] + s[1:] - u[:-1]), (u[1:] + s[1:] - u[:-1] - s[:-1])]  # before, at and after the change
        wrong = [(w < 0).astype(float) for w in ways]
        uneven = [np.where(w < 0, 0, w * w) for w in ways]

        def total(parts, n=n):
            before = np.r_[0, np.cumsum(parts[0])]  # of the first k - 1 steps
            behind = np.r_[np.cumsum(parts[2][::-1])[::-1], 0]
            out = np.empty(n + 1)
            out[0], out[n] = behind[0], before[n - 1]
            if n > 1:
                out[1:n] = before[: n - 1] + parts[1] + behind[1:]
            return out

        bad, rough = total(wrong), total(uneven)
        best = int(np.lexsort((-np.arange(n + 1), rough, bad))[0])
        late[a:b] = (back >= best) & (shift[a:b] > 0)
    hit = shift > 0
    return pa.table({"raw_id": pa.array(rid[hit].astype(np.int64)), "utc_us": pa.array((base + np.where(late, shift, 0))[hit])})


def _histories(zones: list[str]):
    """A kernel that chooses, per log, the offset history that violates the fewest bounds of its quarter days."""
    import zoneinfo

    constants = np.arange(-12 * 60, 14 * 60 + 1, 15)

    def kernel(data: pa.Table, starts: np.ndarray) -> pa.Table:
        day, lo, hi, n = (numbers(data, c).astype(float) for c in ("day", "lo", "hi", "n"))
        tables = [zoneinfo.ZoneInfo(z) for z in zones]
        minutes: list[int | None] = []
        names: list[str | None] = []
        for a, b in zip(starts.tolist(), np.r_[starts[1:], len(day)].tolist()):
            times = [datetime.datetime(1970, 1, 1) + datetime.timedelta(hours=6 * int(d)) for d in day[a:b]]
            times = [*times, *(t + datetime.timedelta(hours=6) for t in times)]  # begin and end of each quarter
            seen: dict[tuple, str | None] = {}
            for z, table in zip(zones, tables):
                history = tuple(table.utcoffset(t).total_seconds() / 60 for t in times)
                if len(set(history)) > 1:  # a zone that does not change in these days is a constant offset
                    seen.setdefault(history, z)
            ways = np.array([[c] * len(times) for c in constants.tolist()] + [list(h) for h in seen], float)
            early, late = ways[:, : b - a], ways[:, b - a :]
            low, high = lo[a:b] / 60e6, hi[a:b] / 60e6
            bad = (n[a:b] * ((np.maximum(early, late) < low - 1) | (np.minimum(early, late) > high + 1))).sum(axis=1)
            middle = np.where(np.isnan(low), high, np.where(np.isnan(high), low, (low + high) / 2))
            far = (n[a:b] * np.minimum(np.abs(early - middle), np.abs(late - middle))).sum(axis=1) / n[a:b].sum()
            best = int(np.lexsort((np.arange(len(ways)), np.round(far, 1), bad))[0])
            minutes.append(int(ways[best][0]) if best < len(constants) else None)
            names.append(None if best < len(constants) else list(seen.values())[best - len(constants)])
        return pa.table({"ID": data.column("ID").take(pa.array(starts)), "log_file": data.column("log_file").take(pa.array(starts)), "est_minutes": pa.array(minutes, pa.int64()), "est_name": pa.array(names, pa.string())})

    return kernel


def estimated_zones(timed: DataFrame, zones: list[str], block: int = 4096) -> DataFrame:
    """``ID, log_file, est_minutes, est_name`` for logs with lines without any zone, from bounds on their instants.

    `timed` has ID, log_file, line_no, local, received and `u` (NULL: unknown). A line comes behind the last known instant
    before it in line order and not behind the next one, nor behind its time of ingestion. Neighbours are looked for in
    blocks of `block` lines, so no log is sorted in one task; bounds are kept per log and quarter of a day (the tightest ones).
    Logs without any bound have no row.
    """
    logs = timed.where("u is null and local is not null").select("ID", "log_file").distinct()
    near = timed.join(logs.select(F.col("ID").alias("i"), F.col("log_file").alias("f")), F.col("ID").eqNullSafe(F.col("i")) & F.col("log_file").eqNullSafe(F.col("f")), "left_semi")
    near = near.withColumn("block", F.expr(f"line_no div {block}"))
    w = Window.partitionBy("ID", "log_file", "block")
    known = F.when(F.col("line_no").isNotNull(), F.col("u"))
    before = F.last(known, True).over(w.orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1))
    behind = F.last(known, True).over(w.orderBy(F.desc("line_no")).rowsBetween(Window.unboundedPreceding, -1))
    bounds = near.withColumn("after", before).withColumn("until", F.least(behind, F.col("received"))).where("u is null and local is not null and (after is not null or until is not null)")
    days = bounds.groupBy("ID", "log_file", F.expr(f"floor(local / {_DAY // 4})").cast("bigint").alias("day")).agg(F.max(F.col("local") - F.col("until")).alias("lo"), F.min(F.col("local") - F.col("after")).alias("hi"), F.count(F.lit(1)).alias("n"))
    return over_sorted_groups(days, ["ID", "log_file"], ["day"], _histories(zones), "ID string, log_file string, est_minutes bigint, est_name string")


def to_instants(lines: DataFrame, deployments: DataFrame, received: str | None = None) -> DataFrame:
    """Rows ``raw_id, utc_us`` for every line whose text states a time.

    `lines` has raw_id, ID, log_file, line_no, datetime, tz; `deployments` has ID, dt, timezone. Texts that
    are NULL, blank, no time or an impossible date (``0000-00-00``, 31 June) have no row. Missing seconds
    and parts of a second are zero, digits beyond a microsecond are cut. Numbers alone are seconds,
    milliseconds or microseconds since the epoch by their length. A local time that the clock skips is
    taken with the offset before the skip. An unknown zone name counts as none. Lines without any zone get the
    log's estimated one (see `estimated_zones`; `received` names a timestamp column of ingestion times, if there is
    one); where nothing bounds it the line is UTC. Repeated lines get the same instant. Extra columns are ignored.
    """
    known = frozenset(lines.sparkSession._jvm.java.time.ZoneId.getAvailableZoneIds())
    own = deployments.where("ID is not null").groupBy("ID").agg(F.min("timezone").alias("home"), F.unix_micros(F.min("dt")).alias("dt"))
    base = lines.select(F.col("raw_id").cast("bigint"), "ID", "log_file", F.col("line_no").cast("bigint").alias("line_no"), F.col("datetime").cast("string").alias("text"), "tz", (F.lit(None).cast("bigint") if received is None else F.unix_micros(received)).alias("received")).join(own, "ID", "left")
    read = cut(base.mapInArrow(_parser(known), "raw_id bigint, ID string, log_file string, line_no bigint, dt bigint, received bigint, epoch bigint, dmy bigint, mdy bigint, minutes bigint, name string").where("coalesce(epoch, dmy, mdy) is not null"))
    unclear = read.where("epoch is null and not (dmy <=> mdy)")
    order = unclear.groupBy("ID", "log_file").agg(
        F.count_if(F.col("mdy").isNull()).alias("only_dmy"), F.count_if(F.col("dmy").isNull()).alias("only_mdy"),
        (F.max("dmy") - F.min("dmy")).alias("span_dmy"), (F.max("mdy") - F.min("mdy")).alias("span_mdy"),
        F.abs(F.min("dmy") - F.min("dt")).alias("far_dmy"), F.abs(F.min("mdy") - F.min("dt")).alias("far_mdy"),
    )
    day_first = F.when(F.col("only_dmy") != F.col("only_mdy"), F.col("only_dmy") > F.col("only_mdy")).when(F.col("span_dmy") != F.col("span_mdy"), F.col("span_dmy") < F.col("span_mdy")).when(F.col("far_dmy") != F.col("far_mdy"), F.col("far_dmy") < F.col("far_mdy")).otherwise(True)
    order = order.select(F.col("ID").alias("i"), F.col("log_file").alias("f"), day_first.alias("day_first"))
    timed = read.join(order, F.col("ID").eqNullSafe(F.col("i")) & F.col("log_file").eqNullSafe(F.col("f")), "left").drop("i", "f")
    timed = timed.withColumn("local", F.when(F.coalesce(F.col("day_first"), F.lit(True)), F.col("dmy")).otherwise(F.col("mdy")))
    if not read.where("epoch is null and minutes is null and name is null").isEmpty():
        placed = F.when(F.col("epoch").isNotNull(), F.col("epoch")).when(F.col("minutes").isNotNull(), F.col("local") - F.col("minutes") * 60_000_000).when(F.col("name").isNotNull(), F.unix_micros(F.to_utc_timestamp(F.timestamp_micros("local"), F.col("name"))))
        zones = sorted(z for z in known if "/" in z and not z.startswith(("Etc/", "SystemV/")))
        est = estimated_zones(timed.withColumn("u", placed), zones).withColumnsRenamed({"ID": "i", "log_file": "f"})
        lost = F.col("minutes").isNull() & F.col("name").isNull() & F.col("epoch").isNull()
        timed = timed.join(est, F.col("ID").eqNullSafe(F.col("i")) & F.col("log_file").eqNullSafe(F.col("f")), "left")
        timed = timed.withColumn("name", F.when(lost, F.col("est_name")).otherwise(F.col("name"))).withColumn("minutes", F.when(lost, F.col("est_minutes")).otherwise(F.col("minutes"))).drop("i", "f", "est_name", "est_minutes")
    early = F.when(F.col("epoch").isNotNull(), F.col("epoch")).when(F.col("name").isNull(), F.col("local") - F.coalesce(F.col("minutes"), F.lit(0)) * 60_000_000).otherwise(F.unix_micros(F.to_utc_timestamp(F.timestamp_micros("local"), F.col("name"))))
    timed = timed.withColumn("u", early).where("u is not null")
    shift = F.lit(0).cast("bigint")
    for minutes_back in (120, 30, 60):
        again = F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(F.col("u") + minutes_back * 60_000_000), F.col("name"))) == F.col("local")
        shift = F.when(F.col("epoch").isNull() & F.col("name").isNotNull() & again, F.lit(minutes_back * 60_000_000).cast("bigint")).otherwise(shift)
    hour, day = 3_600_000_000, 24 * 3_600_000_000

    def offset(hours: int):
        moved = F.col("u") + hours * hour
        return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(moved), F.col("name"))) - moved

    # What may settle an hour that occurs twice: lines near a change of their zone, and lines that state their offset.
    near = F.col("name").isNull() | (offset(-60) > offset(60))
    timed = timed.select("raw_id", "ID", "log_file", "line_no", "u", shift.alias("shift"), near.alias("near"))
    plain = timed.where("shift = 0 or line_no is null").select("raw_id", F.col("u").alias("utc_us"))
    # The hour that occurs twice may cross midnight UTC; all of its lines meet on the day on which it begins.
    d, into = F.expr(f"cast(floor(u / {day}) as bigint)"), F.expr(f"u - floor(u / {day}) * {day}")
    around = F.when(into < 6 * hour, F.array(d, d - 1, d - 2)).when(into >= 18 * hour, F.array(d, d + 1, d - 1)).otherwise(F.array(d, d - 1))
    days = F.when(F.col("shift") > 0, F.array(F.expr(f"cast(floor((u - {hour}) / {day}) as bigint)"))).otherwise(around)
    context = timed.where("line_no is not null and (shift > 0 or near)").select("raw_id", "ID", "log_file", "line_no", "u", "shift", F.explode(days).alias("day"))
    settled = over_sorted_groups(context, ["ID", "log_file", "day"], ["line_no", "u"], _settle, "raw_id bigint, utc_us bigint")
    return plain.unionByName(settled)
