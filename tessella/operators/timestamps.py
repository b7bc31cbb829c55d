"""Mixed timestamp notations and time zones, brought to one UTC instant.

Method: a text becomes a shape mask (digits turn into ``9``, letters are lowered), each distinct mask is
compiled once per worker into a plan that says at which positions the fields stand, and all rows of one mask
are then converted together with array arithmetic. Local times go through zone transition tables that the
driver builds once, stamps with the version of the zone data, and ships to the workers, so that every worker
reads the same rules whatever its own host has installed.

Reading rules
* null, blank, words, impossible dates and times, counts of an unknown length: null;
* a time without zone stands in the row's home zone (null or unknown zone: UTC);
* day and month follow the row's order (``mdy``, anything else is ``dmy``) unless only one reading is possible;
* an ambiguous local time is the first one, a skipped one takes the offset before the change;
* a date without time is 00:00 UTC, a missing day or month is the first, two-digit years are 20xx;
* bare counts of 9-10, 13, 15-16 and 18-19 digits are seconds, milli-, micro- and nanoseconds since 1970 UTC;
* digits beyond microseconds are cut off.
"""

from __future__ import annotations

import importlib.metadata
import re
import unicodedata
from collections.abc import Iterable
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone
from functools import lru_cache, reduce
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError, available_timezones

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

SECOND = 1_000_000
LONGEST = 120  # characters of the longest notation; what is longer denotes no time and makes no mask
CYCLE = 146_097 * 86_400  # seconds of 400 years

# Month names of the notations in use (English, German, French, Spanish, Italian, Portuguese, Dutch).
MONTH_NAMES = [
    "january jan januar janvier enero gennaio janeiro januari jänner janv ene gen",
    "february feb februar février fevrier febrero febbraio fevereiro februari févr fév",
    "march mar märz maerz mars marzo março marco maart mär mrz mrt",
    "april apr avril abril aprile avr abr",
    "may mai mayo maggio maio mei mag",
    "june jun juni juin junio giugno junho giu",
    "july jul juli juillet julio luglio julho juil lug",
    "august aug août aout agosto augustus ago",
    "september sep sept septembre septiembre settembre setembro set",
    "october oct oktober octobre octubre ottobre outubro okt ott out",
    "november nov novembre noviembre novembro",
    "december dec dezember décembre decembre diciembre dicembre dezembro dez déc dic",
]
MONTH = {name: number for number, names in enumerate(MONTH_NAMES, 1) for name in names.split()}

# Zone abbreviations and their offset from UTC in minutes.
ABBREVIATIONS = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "eet": 120, "eest": 180, "msk": 180,
    "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600,
    "nst": -210, "ndt": -150, "ast": -240, "adt": -180, "ist": 330, "npt": 345, "jst": 540, "kst": 540, "aest": 600, "aedt": 660, "acst": 570, "acdt": 630, "awst": 480, "nzst": 720, "nzdt": 780,
}

_WORDS = "|".join(sorted(MONTH, key=lambda w: (-len(w), w)))
_DAY_NAME = r"(?:(?:mon|tues?|wed(?:nes)?|thu(?:rs?)?|fri|sat(?:ur)?|sun)(?:day)?\.?,? +)?"
_ORDINAL = r"(?:st|nd|rd|th|er|º)?"
_DATES = [
    r"(?P<y>9999)(?P<sep>[-/.])(?P<m>99?)(?P=sep)(?P<d>99?)",
    r"(?P<y>9999)[-/.](?P<m>99?)",
    r"(?P<y>9999)-?(?P<doy>999)",
    r"(?P<y>9999)-?w(?P<week>99)(?:-?(?P<dow>9))?",
    r"(?P<y>9999)",
    r"(?P<y>9999)(?P<m>99)(?P<d>99)",
    r"(?P<a>99?)(?P<sep>[-/.])(?P<b>99?)(?P=sep)(?P<y>9999|99)",
    r"(?P<m>99?)[-/.](?P<y>9999)",
    rf"(?P<d>99?){_ORDINAL}\.?[ /.-]*(?:de |of )?(?P<mon>{_WORDS})\.?,?[ /.-]*(?:de |del )?(?P<y>9999|99)",
    rf"(?P<mon>{_WORDS})\.? +(?P<d>99?){_ORDINAL},? +(?P<y>9999)",
    rf"(?P<y>9999),?[ /.-](?P<mon>{_WORDS})\.?(?:[ /.-]+(?P<d>99?))?",
    rf"(?P<mon>{_WORDS})\.?,?[ /.-]+(?:de |of )?(?P<y>9999)",
]
_TIME = r"(?P<H>99?)(?:[:.](?P<M>99)(?:[:.](?P<S>99)(?:[.,](?P<f>9+))?)?(?: ?(?P<ap>[ap])\.?m\.?)?|(?P<M2>99)(?:(?P<S2>99)(?:[.,](?P<f2>9+))?)?| ?(?P<ap2>[ap])\.?m\.?)"
_ZONE = r" ?(?:(?P<name>[a-z]+)|(?:utc|gmt)?(?P<sign>[+-])(?P<zh>99?)(?::?(?P<zm>99))?)(?: ?\[[^\]]*\])?"
_REGION = r"(?: ?\[(?P<region>[^\]]+)\]| (?P<region2>[a-z]+/[a-z_/]+))"
_CTIME = re.compile(rf"(?:[a-z]{{2,9}}\.?,? +)?(?P<mon>{_WORDS}) +(?P<d>99?) +{_TIME}(?:{_ZONE})? +(?P<y>9999)")
_FULL = [re.compile(rf"{_DAY_NAME}{date}(?:(?:t|,? +at +|,? +){_TIME}(?:{_ZONE}|{_REGION})?)?") for date in _DATES]
_COUNTS = {9: SECOND, 10: SECOND, 13: 1000, 15: 1, 16: 1, 18: -1000, 19: -1000}
_DIGITS = {ord(c): "9" for c in "0123456789"}
_LOOKALIKE = {ord(a): b for a, b in {"−": "-", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "’": "'"}.items()} | {c: None for c in (0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0x200E, 0x200F, 0xAD)}


@dataclass
class Plan:
    """Where the fields of one mask stand, and what its literal parts say."""

    spans: dict[str, tuple[int, int]] = field(default_factory=dict)
    month: int = 0
    half_day: str = ""
    offset: int | None = None
    sign: int = 0
    region: str = ""
    count: int = 0


def _tidy(text: str) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).translate(_LOOKALIKE)
    return " ".join(text.split()).lower()


@lru_cache(maxsize=100_000)
def compile_mask(mask: str) -> Plan | None:
    """The plan of a mask, or None if texts of this shape denote no time."""
    if m := re.fullmatch(r"(-?)(9+)(?:\.(9+))?", mask):
        n = len(m[2])
        if n in _COUNTS and not m[1] and (not m[3] or n in (9, 10)):
            return Plan({"n": m.span(2)} | ({"f": m.span(3)} if m[3] else {}), count=_COUNTS[n])
        if n == 14 and not m[3] and not m[1]:
            return Plan({k: (i, j) for k, i, j in (("y", 0, 4), ("m", 4, 6), ("d", 6, 8), ("H", 8, 10), ("M", 10, 12), ("S", 12, 14))})
        if n == 12 and not m[3] and not m[1]:
            return Plan({k: (i, j) for k, i, j in (("y", 0, 4), ("m", 4, 6), ("d", 6, 8), ("H", 8, 10), ("M", 10, 12))})
    for pattern in (*_FULL, _CTIME):
        if m := pattern.fullmatch(mask):
            got = m.groupdict()
            plan = Plan({k[0] if k in ("M2", "S2", "f2") else k: m.span(k) for k, v in got.items() if v and k[0] not in "nr" and k not in ("mon", "ap", "ap2", "sign", "sep")})
            plan.month, plan.half_day = MONTH.get(got.get("mon") or "", 0), got.get("ap") or got.get("ap2") or ""
            if got.get("name"):
                if got["name"] not in ABBREVIATIONS:
                    return None
                plan.offset = ABBREVIATIONS[got["name"]]
            plan.sign = {"+": 1, "-": -1}.get(got.get("sign") or "", 0)
            plan.region = got.get("region") or got.get("region2") or ""
            return plan
    return None


class ZoneTables:
    """Transition tables of the named zones: for local times the boundaries and the offsets between them.

    They reach from before the first entry of the zone data to a whole cycle of the calendar (400 years, after which
    days of the month fall on the same weekdays) past its last one; later times are looked up a cycle earlier.
    """

    def __init__(self, names: Iterable[str], first_year: int = 1840, last_year: int = 2037 + 400) -> None:
        try:
            self.version = importlib.metadata.version("tzdata")
        except importlib.metadata.PackageNotFoundError:
            self.version = "host"
        self.tables: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self.end = int(datetime(last_year, 1, 1, tzinfo=timezone.utc).timestamp())
        for name in {*names, "UTC"}:
            try:
                self.tables[name.lower()] = self._build(ZoneInfo(name), first_year, last_year)
            except (ZoneInfoNotFoundError, ValueError, OSError):
                continue

    @staticmethod
    def _build(zone: ZoneInfo, first_year: int, last_year: int) -> tuple[np.ndarray, np.ndarray]:
        def offset(second: int) -> int:
            return int((datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=second)).astimezone(zone).utcoffset().total_seconds())

        start, end = (int(datetime(y, 1, 1, tzinfo=timezone.utc).timestamp()) for y in (first_year, last_year))
        at, offsets, step = [], [offset(start)], 7 * 86400
        for t in range(start, end, step):
            if offset(t + step) != offsets[-1]:
                low, high = t, t + step
                while high - low > 1:
                    mid = (low + high) // 2
                    low, high = (mid, high) if offset(mid) == offsets[-1] else (low, mid)
                at.append(high + max(offsets[-1], offset(high)))
                offsets.append(offset(high))
        return np.array(at, dtype=np.int64), np.array(offsets, dtype=np.int64)

    def offsets(self, zone: str, local_seconds: np.ndarray) -> np.ndarray:
        """Seconds to subtract from local times: the first of two readings, the offset before the change in a gap."""
        at, offsets = self.tables.get(zone.lower(), self.tables["utc"])
        later = np.maximum(0, -(-(local_seconds - self.end) // CYCLE))
        return offsets[np.searchsorted(at, local_seconds - later * CYCLE, side="right")]


def _number(codes: np.ndarray, span: tuple[int, int], most: int = 18) -> np.ndarray:
    out = np.zeros(len(codes), dtype=np.int64)
    for i in range(span[0], min(span[1], span[0] + most)):
        out = out * 10 + (codes[:, i] - 48)
    return out


def _fraction(codes: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    digits = min(6, span[1] - span[0])
    return _number(codes, span, 6) * 10 ** (6 - digits)


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Days since 1970 and whether the date exists."""
    ok = (y >= 1) & (m >= 1) & (m <= 12) & (d >= 1)
    month = np.where(ok, (y - 1970) * 12 + m - 1, 0).astype("M8[M]")
    first, after = month.astype("M8[D]").astype(np.int64), (month + 1).astype("M8[D]").astype(np.int64)
    return first + d - 1, ok & (d <= after - first)


def _convert(plan: Plan, codes: np.ndarray, zones: np.ndarray, mdy: np.ndarray, tables: ZoneTables) -> tuple[np.ndarray, np.ndarray]:
    at, n = plan.spans, len(codes)
    if plan.count:
        value = _number(codes, at["n"], 19)
        value = value // -plan.count if plan.count < 0 else value * plan.count
        return value + (_fraction(codes, at["f"]) if "f" in at else 0), np.ones(n, dtype=bool)
    y = _number(codes, at["y"])
    if at["y"][1] - at["y"][0] == 2:
        y = y + 2000
    one = np.ones(n, dtype=np.int64)
    if "doy" in at:
        doy = _number(codes, at["doy"])
        first, _ = _days(y, one, one)
        year_end, _ = _days(y + 1, one, one)
        days, ok = first + doy - 1, (doy >= 1) & (doy <= year_end - first)
    elif "week" in at:
        week, dow = _number(codes, at["week"]), _number(codes, at["dow"]) if "dow" in at else one

        def monday(year: np.ndarray) -> np.ndarray:
            fourth, _ = _days(year, one, one * 4)
            return fourth - (fourth + 3) % 7

        start = monday(y)
        days, ok = start + (week - 1) * 7 + dow - 1, (week >= 1) & (week * 7 <= monday(y + 1) - start) & (dow >= 1) & (dow <= 7)
    else:
        if "a" in at:
            a, b = _number(codes, at["a"]), _number(codes, at["b"])
            month_first = np.where((a > 12) & (b <= 12), False, np.where((b > 12) & (a <= 12), True, mdy))
            m, d = np.where(month_first, a, b), np.where(month_first, b, a)
        else:
            m = one * plan.month if plan.month else _number(codes, at["m"]) if "m" in at else one
            d = _number(codes, at["d"]) if "d" in at else one
        days, ok = _days(y, m, d)
    if "H" not in at:
        return days * 86400 * SECOND, ok
    h, mi, s = (_number(codes, at[k]) if k in at else one * 0 for k in ("H", "M", "S"))
    if plan.half_day:
        ok = ok & (h >= 1) & (h <= 12)
        h = h % 12 + (12 if plan.half_day == "p" else 0)
    ok = ok & (mi <= 59) & (s <= 60) & ((h <= 23) | ((h == 24) & (mi == 0) & (s == 0)))
    local = days * 86400 + h * 3600 + mi * 60 + s
    if plan.offset is not None:
        shift: np.ndarray | int = plan.offset * 60
    elif plan.sign:
        zh, zm = _number(codes, at["zh"]), _number(codes, at["zm"]) if "zm" in at else one * 0
        shift, ok = plan.sign * (zh * 3600 + zm * 60), ok & (zh <= 18) & (zm <= 59)
    elif plan.region:
        if plan.region not in tables.tables:
            return local, np.zeros(n, dtype=bool)
        shift = tables.offsets(plan.region, local)
    else:
        shift = np.zeros(n, dtype=np.int64)
        for zone in set(zones):
            rows = zones == zone
            shift[rows] = tables.offsets(zone, local[rows])
    return (local - shift) * SECOND + (_fraction(codes, at["f"]) if "f" in at else 0), ok


def parse_batch(texts: Iterable[str | None], zones: Iterable[str | None], mdy: Iterable[bool | None], tables: ZoneTables) -> tuple[np.ndarray, np.ndarray]:
    """UTC microseconds of a batch and which of them are valid."""
    tidy = [_tidy(t) if t else "" for t in texts]
    zone = np.array([z if isinstance(z, str) else "UTC" for z in zones], dtype=object)
    month_first = np.array([bool(x) if x is not None else False for x in mdy], dtype=bool)
    out, ok = np.zeros(len(tidy), dtype=np.int64), np.zeros(len(tidy), dtype=bool)
    by_mask: dict[str, list[int]] = {}
    for i, text in enumerate(tidy):
        if text:
            by_mask.setdefault(text.translate(_DIGITS) if len(text) <= LONGEST else "", []).append(i)
    for mask, rows in by_mask.items():
        if plan := compile_mask(mask):
            codes = np.array([tidy[i] for i in rows], dtype=f"U{len(mask)}").view(np.uint32).reshape(len(rows), -1).astype(np.int64)
            at = np.array(rows)
            out[at], ok[at] = _convert(plan, codes, zone[at], month_first[at], tables)
    return out, ok


def utc_micros(text: Column, zone: Column, order: Column, tables: ZoneTables) -> Column:
    """Column of UTC microseconds since 1970 (bigint, null where the text denotes no time)."""

    @F.pandas_udf(LongType())
    def convert(texts: pd.Series, zones: pd.Series, orders: pd.Series) -> pd.Series:
        micros, ok = parse_batch(texts, zones, orders == "mdy", tables)
        return pd.Series(pd.arrays.IntegerArray(micros, ~ok))

    return convert(text, zone, order)


def regions_named(df: DataFrame, column: str) -> DataFrame:
    """(zone): distinct region names that the texts of a column end with."""
    found = F.regexp_extract(F.lower(column), r"(?:\[|\s)([a-z]+(?:/[a-z0-9_+-]+)+)\]?\s*$", 1)
    return df.select(found.alias("zone")).where("zone <> ''").distinct()


def zone_tables(*dimensions: DataFrame, column: str = "home_zone", texts: dict[str, DataFrame] | None = None) -> ZoneTables:
    """Tables for the zones named in dimension tables and those that texts name themselves (``texts``: column -> rows).

    What reaches the driver are distinct names of zones that the zone database has, so at most as many as it has.
    """
    known = {z.lower(): z for z in available_timezones()}
    asked = [d.select(F.lower(column).alias("zone")).distinct() for d in dimensions] + [regions_named(df, c) for c, df in (texts or {}).items()]
    if not asked:
        return ZoneTables([])
    names = reduce(lambda a, b: a.unionByName(b), asked).where(F.col("zone").isin(list(known))).distinct().collect()
    return ZoneTables(known[r[0]] for r in names)


def normalise_timestamps(df: DataFrame, column: str, dimension: DataFrame, key: str, tables: ZoneTables, out: str = "utc_micros", version: str | None = None) -> DataFrame:
    """Add ``out`` and, if a name is given for it, the version of the zone data that was read: the UTC microseconds of ``column``, read with the zone and order of the row's ``key`` in ``dimension``.

    ``dimension`` has ``key``, home_zone and date_order; keys are compared without case, outer blanks and the
    kind of word separator. The key need not exist: unknown rows read as UTC and day first. Clashing column
    names in ``df`` are kept, since the lookup's columns get private names and are dropped again.
    """
    norm = lambda c: F.regexp_replace(F.lower(F.trim(F.regexp_replace(c, r"^[\s ]+|[\s ]+$", ""))), r"[\s_-]+", "_")
    dim = dimension.select(norm(F.col(key)).alias("__key"), F.col("home_zone").alias("__zone"), F.col("date_order").alias("__order")).where("__key is not null").groupBy("__key").agg(F.min("__zone").alias("__zone"), F.min("__order").alias("__order"))
    joined = df.withColumn("__key", norm(F.col(key))).join(dim, "__key", "left")
    done = joined.withColumn(out, utc_micros(F.col(column), F.col("__zone"), F.col("__order"), tables)).drop("__key", "__zone", "__order")
    return done.withColumn(version, F.lit(tables.version)) if version else done
