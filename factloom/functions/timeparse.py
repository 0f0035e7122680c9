"""Readings of one time string: every valid parse, each as (label, instant).

Labels name what had to be decided: `dmy`/`mdy` for the order of a numeric date (years of two digits are those
of 1969 to 2068), `z:<name>:<minutes>` for a zone abbreviation with several meanings, `first`/`second` for a local time that occurs
twice, `s`/`ms`/`us`/`ns` for the unit of a bare number, else `fixed`.
"""

from __future__ import annotations

import re
import unicodedata
from datetime import date, datetime, timedelta
from functools import lru_cache
from zoneinfo import ZoneInfo

# Month names of the languages of the corpus, by their first letters.
MONTHS = {
    "en": "january february march april may june july august september october november december",
    "de": "januar februar märz april mai juni juli august september oktober november dezember",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    "ru": "января февраля марта апреля мая июня июля августа сентября октября ноября декабря",
}
# Zone abbreviations and their offsets in minutes; several where the letters have several meanings.
ABBREVIATIONS = {
    "UTC": [0], "GMT": [0], "Z": [0], "UT": [0], "WET": [0], "WEST": [60], "CET": [60], "CEST": [120], "MEZ": [60], "MESZ": [120],
    "EET": [120], "EEST": [180], "MSK": [180], "MSD": [240], "EST": [-300], "EDT": [-240], "CST": [-360, 480], "CDT": [-300, -240],
    "MST": [-420], "MDT": [-360], "PST": [-480], "PDT": [-420], "AKST": [-540], "AKDT": [-480], "HST": [-600], "BRT": [-180],
    "BRST": [-120], "ART": [-180], "BST": [60, 360], "IST": [330, 60, 120], "NPT": [345], "JST": [540], "KST": [540], "SGT": [480],
    "HKT": [480], "AEST": [600], "AEDT": [660], "ACST": [570], "ACDT": [630], "AWST": [480], "NZST": [720], "NZDT": [780], "SAST": [120],
}

MONTH: dict[str, int] = {}
for _names in MONTHS.values():
    for _i, _w in enumerate(_names.split(), 1):
        for _n in {_w, _w[:3], _w[:4]} if len(_w) > 3 else {_w}:
            MONTH.setdefault(_n, _i)
MONTH |= {"sept": 9, "juin": 6, "juil": 7, "jul": 7, "jun": 6, "mai": 5, "mär": 3, "maerz": 3, "июнь": 6, "июль": 7, "май": 5, "fevrier": 2, "aout": 8, "decembre": 12}

_T = r"(?P<h>\d{1,2})(?:[:h](?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d{1,9}))?)?)\s*(?P<ap>[ap]\.?\s?m(?![^\W\d])\.?)?(?:\s*Uhr)?"
_Z = r"(?:\s*(?P<z>Z|(?:GMT|UTC)?[+-]\d{1,2}(?::?\d{2})?|[A-Za-z_]+/[A-Za-z_/+-]+|[A-Z]{2,5}))?(?:\s*\[(?P<zz>[^\]]+)\])?"
_SEP = r"(?:\s*,\s*|\s+(?:at|à|um|в|a las)\s+|\s*T\s*|\s+)"
_CLOCK = rf"(?:{_SEP}{_T}{_Z})?"
_I = re.IGNORECASE
FORMS = [
    ("iso", re.compile(rf"(?P<y>\d{{4}})([-/.])(?P<m>\d{{1,2}})\2(?P<d>\d{{1,2}}){_CLOCK}", _I)),
    ("week", re.compile(rf"(?P<y>\d{{4}})-?W(?P<w>\d{{2}})-?(?P<wd>[1-7]){_CLOCK}", _I)),
    ("ordinal", re.compile(rf"(?P<y>\d{{4}})-(?P<yd>\d{{3}}){_CLOCK}", _I)),
    ("basic", re.compile(rf"(?P<y>\d{{4}})(?P<m>\d{{2}})(?P<d>\d{{2}})(?:T(?P<h>\d{{2}})(?P<mi>\d{{2}})(?:(?P<s>\d{{2}})(?:[.,](?P<f>\d{{1,9}}))?)?{_Z})?", _I)),
    ("numeric", re.compile(rf"(?P<a>\d{{1,2}})([-/.])(?P<b>\d{{1,2}})\2(?P<y>\d{{4}}|\d{{2}}){_CLOCK}", _I)),
    ("month_first", re.compile(rf"(?:[^\W\d]{{2,12}}\.?,?\s+)?(?P<mon>[^\W\d]{{3,12}})\.?\s+(?P<d>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?P<y>\d{{4}}){_CLOCK}", _I)),
    ("day_first", re.compile(rf"(?:[^\W\d]{{2,12}}\.?,?\s+)?(?P<d>\d{{1,2}})(?:er|\.)?\s+(?:de\s+)?(?P<mon>[^\W\d]{{3,12}})\.?,?\s+(?:de\s+)?(?P<y>\d{{4}})(?:\s*г\.?)?{_CLOCK}", _I)),
    ("ctime", re.compile(rf"[^\W\d]{{2,12}}\s+(?P<mon>[^\W\d]{{3,12}})\s+(?P<d>\d{{1,2}})\s+{_T}{_Z}\s+(?P<y>\d{{4}})", _I)),
]
_EPOCH = re.compile(r"(-?\d{9,19})(?:\.(\d{1,9}))?")
_JSON_DATE = re.compile(r"/?Date\((-?\d{10,16})(?:[+-]\d{4})?\)/?", _I)
_UNITS = {"s": 1_000_000, "ms": 1_000, "us": 1}
#: Bare numbers are read as instants of these years only.
_YEARS = (1990, 2100)
_EPOCH0 = datetime(1970, 1, 1)


@lru_cache(maxsize=2048)
def _zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except Exception:  # unknown names are no zones
        return None


def _us(t: datetime) -> int:
    d = t - _EPOCH0
    return (d.days * 86400 + d.seconds) * 1_000_000 + d.microseconds


def _local(t: datetime, zone: ZoneInfo | None) -> int:
    """Wall time to instant: the earlier of two, and in a gap the offset before the change (fold=0 is both)."""
    if zone is None:
        return _us(t)
    return _us(t) - round(t.replace(tzinfo=zone, fold=0).utcoffset().total_seconds() * 1_000_000)


def _locals(t: datetime, zone: ZoneInfo | None, twice: bool) -> list[tuple[str, int]]:
    """(label, instant) of a wall time: two where the clock shows it twice, if asked for."""
    first = _local(t, zone)
    if zone is None or not twice:
        return [("", first)]
    second = _us(t) - round(t.replace(tzinfo=zone, fold=1).utcoffset().total_seconds() * 1_000_000)
    return [("first", first), ("second", second)] if second > first else [("", first)]


def readings(value: str | None, tz: str | None = None, twice: bool = False) -> tuple[str, list[tuple[str, int]]]:
    """(status, [(label, microseconds since 1970 UTC)]). status: `null`, `none` (no date), `day` (names a day only),
    `invalid` (a date or clock that doesn't exist) or `time`. A value without zone is local to tz (None: UTC). twice: a
    local time that occurs twice gives both instants, else the earlier one."""
    if value is None:
        return "null", []
    v = unicodedata.normalize("NFKC", value).translate({0x2212: "-", 0x200B: None, 0x200E: None, 0x200F: None, 0xFEFF: None})
    v = re.sub(r"\s+", " ", v).strip()
    if v.lower().startswith("le "):
        v = v[3:]
    if m := _JSON_DATE.fullmatch(v):
        return "time", [("fixed", int(m[1]) * 1000)]
    if m := _EPOCH.fullmatch(v):
        return _number(m)
    for form, pattern in FORMS:
        if m := pattern.fullmatch(v):
            return _read(form, m.groupdict(), tz, twice)
    return "none", []


def _number(m: re.Match) -> tuple[str, list[tuple[str, int]]]:
    digits, n = m[2] or "", int(m[1])
    out = []
    for unit, us in (*_UNITS.items(), ("ns", 0)):
        if digits and unit != "s":
            continue
        t = n // 1000 if unit == "ns" else n * us + (int(digits.ljust(6, "0")[:6]) if digits else 0)
        if (_YEARS[0] - 1970) * 31_556_952_000_000 < t < (_YEARS[1] - 1970) * 31_556_952_000_000 and (unit == "s") == (len(m[1]) <= 11):
            out.append((unit, t))
    return ("time", out) if out else ("invalid", [])


def _read(form: str, g: dict, tz: str | None, twice: bool) -> tuple[str, list[tuple[str, int]]]:
    y = int(g["y"])
    if len(g["y"]) == 2:
        y += 2000 if y <= 68 else 1900
    days: list[tuple[str, date]] = []
    try:
        if form == "week":
            days = [("", date.fromisocalendar(y, int(g["w"]), int(g["wd"])))]
        elif form == "ordinal":
            if not 1 <= int(g["yd"]) <= 366 or (d := date(y, 1, 1) + timedelta(int(g["yd"]) - 1)).year != y:
                return "invalid", []
            days = [("", d)]
        elif form == "numeric":
            a, b = int(g["a"]), int(g["b"])
            for label, mo, d in (("dmy", b, a), ("mdy", a, b)):
                try:
                    days.append((label, date(y, mo, d)))
                except ValueError:
                    pass
        else:
            month = int(g["m"]) if g.get("m") else MONTH.get(g["mon"].lower()) or MONTH.get(g["mon"].lower()[:3])
            if month is None:
                return "none", []
            days = [("", date(y, month, int(g["d"])))]
    except ValueError:
        return "invalid", []
    if not days:
        return "invalid", []
    if g.get("h") is None:
        return "day", []
    h, mi, s = int(g["h"]), int(g["mi"]), int(g["s"] or 0)
    if ap := (g.get("ap") or "").lower()[:1]:
        if not 1 <= h <= 12:
            return "invalid", []
        h = h % 12 + 12 * (ap == "p")
    if h > 23 or mi > 59 or s > 59:
        return "invalid", []
    us = int((g["f"] or "0").ljust(6, "0")[:6])
    zones = _offsets(g.get("z"), g.get("zz"))
    if zones is None:
        return "invalid", []
    out = []
    for label, d in days:
        t = datetime(d.year, d.month, d.day, h, mi, s, us)
        try:
            for name, z in zones or [("", _zone(tz) if tz else None)]:
                for fold, us_ in [("", _us(t) - z * 60_000_000)] if isinstance(z, int) else _locals(t, z, twice):
                    out.append((",".join(x for x in (label, name, fold) if x) or "fixed", us_))
        except OverflowError:
            pass
    return ("time", out) if out else ("invalid", [])


def _offsets(z: str | None, zz: str | None) -> list[tuple[str, int | ZoneInfo]] | None:
    """Meanings of the written zone: [] without one, None for one that is unknown."""
    if not z:
        if not zz:
            return []
        z = zz
    up = z.upper()
    if up in ABBREVIATIONS:
        many = ABBREVIATIONS[up]
        return [(f"z:{up}:{x}" if len(many) > 1 else "", x) for x in many]
    if m := re.fullmatch(r"(?:GMT|UTC)?([+-])(\d{1,2})(?::?(\d{2}))?", up):
        x = int(m[2]) * 60 + int(m[3] or 0)
        return [("", -x if m[1] == "-" else x)] if x <= 18 * 60 else None
    zone = _zone(z)
    return [("", zone)] if zone else None
