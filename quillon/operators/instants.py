"""One unambiguous stretch of UTC time for values in many notations and zones.

Raw strings are deduplicated together with the zone and the locale that decide
their meaning into a dictionary table; each entry is parsed once, exhaustively,
and kept; a later update parses the new entries only. Rows get their stretch by
joining the dictionary back.

A readable value has one stretch, or two where its local time occurred twice.
Defined cases: null is no value (no row comes out); empty or blank text, skipped
local times, impossible dates, placeholders and times that need a zone where the
pack has none are ``unreadable``; whitespace around and no-break spaces inside do
not matter; repeated rows come out repeated.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from datetime import date, datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon import runtime as rt

# Month names of the six corpus languages in the forms dates use, by month.
MONTHS = {
    1: "january jan januar jänner janvier janv enero ene январь января янв січень січня січ",
    2: "february feb februar février fevrier févr fév febrero февраль февраля фев февр лютий лютого лют",
    3: "march mar märz maerz mär mrz mars marzo март марта мар березень березня бер",
    4: "april apr avril avr abril abr апрель апреля апр квітень квітня квіт кві",
    5: "may mai mayo май мая травень травня трав тра",
    6: "june jun juni juin junio июнь июня июн червень червня черв чер",
    7: "july jul juli juillet juil julio июль июля июл липень липня лип",
    8: "august aug août aout agosto ago август августа авг серпень серпня серп сер",
    9: "september sep sept septembre septiembre setiembre сентябрь сентября сен сент вересень вересня вер",
    10: "october oct oktober okt octobre octubre октябрь октября окт жовтень жовтня жовт жов",
    11: "november nov novembre noviembre ноябрь ноября ноя нояб листопад листопада лист лис",
    12: "december dec dezember dez décembre decembre déc diciembre dic декабрь декабря дек грудень грудня груд гру",
}
MONTH_OF = {name: number for number, names in MONTHS.items() for name in names.split()}
# Minutes east of UTC of zone abbreviations, used where the pack's own zone does not use the abbreviation.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "UT": 0, "Z": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "MEZ": 60, "CEST": 120, "MESZ": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "MSD": 240, "SAMT": 240, "YEKT": 300, "IST": 330, "JST": 540, "KST": 540,
    "AWST": 480, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
}
# Locales that write the month first, and languages that write the year first.
MONTH_FIRST = {"en-US", "en-PH", "en-PR", "es-PR", "en-GU", "en-VI", "en-AS", "en-UM"}
YEAR_FIRST = {"zh", "ja", "ko", "hu", "lt", "mn"}
UNIT_S = {"day": 86400, "hour": 3600, "minute": 60, "second": 1}

TIME = r"(?P<h>\d{1,2}):(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d{1,9}))?)?(?:\s*(?P<ap>[AaPp])\.?[Mm]\.?)?"
ZONE = r"(?:\s*(?P<z>[Zz]|[+\-−]\d{2}(?::?\d{2})?)(?:\[(?P<br>[^\]]+)\])?|\s+(?P<zn>[A-Z][A-Za-z]+(?:/[A-Za-z0-9_+\-]+)+|[A-Z]{2,5}))?"
CLOCK = rf"(?:(?:\s*[Tt]\s*|,\s*|\s+(?:(?:at|um|à|a las|в|о)\s+)?){TIME}{ZONE})?"
ISO = re.compile(rf"(?P<y>\d{{4}})(?:(?P<sep>[-/.])(?P<m>\d{{1,2}})(?:(?P=sep)(?P<d>\d{{1,2}}){CLOCK})?)?$")
ISO_WEEK = re.compile(rf"(?P<y>\d{{4}})-?[Ww](?P<w>\d{{2}})(?:-?(?P<wd>[1-7]){CLOCK})?$")
ISO_DAY = re.compile(rf"(?P<y>\d{{4}})-(?P<yd>\d{{3}}){CLOCK}$")
COMPACT = re.compile(rf"(?P<y>\d{{4}})(?P<m>\d{{2}})(?P<d>\d{{2}})(?:[Tt ]?(?P<h>\d{{2}})(?P<mi>\d{{2}})(?:(?P<s>\d{{2}})(?:[.,](?P<f>\d{{1,9}}))?)?{ZONE})?$")
NUMERIC = re.compile(rf"(?P<a>\d{{1,2}})(?P<sep>[./-])(?P<b>\d{{1,2}})(?P=sep)(?P<c>\d{{4}}|\d{{2}})(?:\s*(?:г|р)\.?)?{CLOCK}$")
WEEKDAY = r"(?:[^\W\d_]{2,12}\.?,?\s+)?"
DAY_NAME = re.compile(rf"{WEEKDAY}(?P<d>\d{{1,2}})(?:\.|er|st|nd|rd|th|-го|º)?\s*[ -]\s*(?:de\s+|of\s+)?(?P<mn>[^\W\d_]{{3,12}})\.?,?\s*[ -]\s*(?:de\s+|del\s+)?(?P<y>\d{{4}})(?:\s*(?:г|р|года|року)\b\.?)?{CLOCK}$")
NAME_DAY = re.compile(rf"{WEEKDAY}(?P<mn>[^\W\d_]{{3,12}})\.?\s+(?P<d>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?P<y>\d{{4}}){CLOCK}$")
NAME_YEAR = re.compile(r"(?P<mn>[^\W\d_]{3,12})\.?,?\s+(?:de\s+|del\s+)?(?P<y>\d{4})(?:\s*(?:г|р|года|року)\b\.?)?$")
EPOCH = {10: 0, 13: 3, 16: 6}
EPOCH0 = datetime(1970, 1, 1)

Instant = tuple[int, int]  # seconds and nanoseconds since 1970 UTC
Stretch = tuple[Instant, Instant]  # from, and the first instant after it


@lru_cache(maxsize=2048)
def zone_of(name: str | None) -> ZoneInfo | None:
    try:
        return ZoneInfo(name) if name else None
    except (KeyError, ValueError, OSError):
        return None


def seconds(local: datetime) -> int:
    return (local - EPOCH0) // timedelta(seconds=1)


def local_instants(local: datetime, zone: ZoneInfo | timezone) -> list[int]:
    """The seconds since 1970 at which clocks in the zone show this time: none if skipped, two if repeated."""
    out = []
    for fold in (0, 1):
        offset = local.replace(tzinfo=zone, fold=fold).utcoffset()
        at = local - offset
        if at.replace(tzinfo=timezone.utc).astimezone(zone).replace(tzinfo=None) == local and seconds(at) not in out:
            out.append(seconds(at))
    return out


def day_start(day: date, zone: ZoneInfo | timezone) -> int:
    """The first instant of a day; where midnight was skipped, the first instant after it."""
    local = datetime(day.year, day.month, day.day)
    at = local_instants(local, zone)
    if at:
        return at[0]
    return seconds(local - local.replace(tzinfo=zone, fold=0).utcoffset())


def whole_days(first: date, last_excluded: date, zone: ZoneInfo | timezone) -> list[Stretch]:
    return [((day_start(first, zone), 0), (day_start(last_excluded, zone), 0))]


def fixed_offset(text: str) -> timezone | None:
    if text in "Zz":
        return timezone.utc
    digits = text[1:].replace(":", "")
    minutes = int(digits[:2]) * 60 + int(digits[2:] or 0)
    if minutes > 18 * 60 or int(digits[2:] or 0) > 59:
        return None
    return timezone(timedelta(minutes=-minutes if text[0] in "-−" else minutes))


def named_zone(name: str, local: datetime, pack_zone: ZoneInfo | None) -> ZoneInfo | timezone | None:
    if "/" in name:
        return zone_of(name)
    if pack_zone is not None and name not in ("UTC", "GMT", "UT", "Z"):
        for fold in (0, 1):
            at = local.replace(tzinfo=pack_zone, fold=fold)
            if at.tzname() == name:
                return timezone(at.utcoffset())
    minutes = ABBREVIATIONS.get(name)
    return None if minutes is None else timezone(timedelta(minutes=minutes))


def with_clock(day: date, part: dict, pack_zone: ZoneInfo | None) -> tuple[str, list[Stretch]] | None:
    hour, minute = int(part["h"]), int(part["mi"])
    second = int(part["s"]) if part.get("s") else 0
    if part.get("ap"):
        if not 1 <= hour <= 12:
            return None
        hour = hour % 12 + (12 if part["ap"] in "Pp" else 0)
    next_day = hour == 24 and minute == 0 and second == 0 and not part.get("f")
    if minute > 59 or second > 59 or hour > 23 and not next_day:
        return None
    local = datetime(day.year, day.month, day.day) + timedelta(hours=hour, minutes=minute, seconds=second)
    unit = "second" if part.get("s") else "minute"
    nanos, width = 0, (UNIT_S[unit], 0)
    if part.get("f"):
        digits = part["f"]
        unit, nanos, width = "fraction", int(digits.ljust(9, "0")), (0, 10 ** (9 - len(digits)))
    if part.get("z"):
        zone = fixed_offset(part["z"])
    elif part.get("zn"):
        zone = named_zone(part["zn"], local, pack_zone)
    else:
        zone = pack_zone
    if zone is None:
        return None
    out = []
    for at in local_instants(local, zone):
        end = nanos + width[1]
        out.append(((at, nanos), (at + width[0] + end // 10**9, end % 10**9)))
    return (unit, out) if out else None


def full_year(text: str) -> int:
    return int(text) if len(text) == 4 else 2000 + int(text)


def numeric_order(a: str, b: str, c: str, locale: str | None) -> tuple[int, int, int]:
    """(year, month, day) of a numeric date in the order of the locale."""
    language = re.split(r"[-_]", locale or "")[0].lower()
    if language in YEAR_FIRST and len(c) == 2:
        return full_year(a.zfill(2)), int(b), int(c)
    if (locale or "").replace("_", "-") in MONTH_FIRST:
        return full_year(c), int(a), int(b)
    return full_year(c), int(b), int(a)


def month_after(year: int, month: int) -> date:
    return date(year + month // 12, month % 12 + 1, 1)


def parse(raw: str, zone_name: str | None, locale: str | None) -> tuple[str, list[Stretch]] | None:
    """Last written unit and the possible stretches of a value; None if it is unreadable."""
    text = re.sub(r"[\s   ]+", " ", raw).strip()
    zone = zone_of(zone_name)
    try:
        return _parse(text, zone, locale)
    except (ValueError, OverflowError):
        return None  # an impossible date


def _parse(text: str, zone: ZoneInfo | None, locale: str | None) -> tuple[str, list[Stretch]] | None:
    if text.isascii() and text.isdigit() and len(text) in EPOCH:
        places = EPOCH[len(text)]
        value = int(text)
        at, nanos = divmod(value * 10 ** (9 - places), 10**9)
        end = nanos + 10 ** (9 - places)
        return ("second" if places == 0 else "fraction", [((at, nanos), (at + end // 10**9, end % 10**9))]) if value else None
    if m := ISO.match(text):
        p = m.groupdict()
        if p["m"] is None:
            year = int(p["y"])
            return ("year", whole_days(date(year, 1, 1), date(year + 1, 1, 1), zone)) if zone and len(text) == 4 else None
        if p["d"] is None:
            first = date(int(p["y"]), int(p["m"]), 1)
            return ("month", whole_days(first, month_after(first.year, first.month), zone)) if zone else None
        return dated(date(int(p["y"]), int(p["m"]), int(p["d"])), p, zone)
    if m := ISO_WEEK.match(text):
        p = m.groupdict()
        if p["wd"] is None:
            first = date.fromisocalendar(int(p["y"]), int(p["w"]), 1)
            return ("week", whole_days(first, first + timedelta(7), zone)) if zone else None
        return dated(date.fromisocalendar(int(p["y"]), int(p["w"]), int(p["wd"])), p, zone)
    if m := ISO_DAY.match(text):
        p = m.groupdict()
        day = date(int(p["y"]), 1, 1) + timedelta(int(p["yd"]) - 1)
        return dated(day, p, zone) if day.year == int(p["y"]) and int(p["yd"]) > 0 else None
    if m := COMPACT.match(text):
        p = m.groupdict()
        return dated(date(int(p["y"]), int(p["m"]), int(p["d"])), p, zone)
    if m := NUMERIC.match(text):
        p = m.groupdict()
        return dated(date(*numeric_order(p["a"], p["b"], p["c"], locale)), p, zone)
    for pattern in (DAY_NAME, NAME_DAY):
        if m := pattern.match(text):
            p = m.groupdict()
            month = MONTH_OF.get(p["mn"].lower())
            return dated(date(int(p["y"]), month, int(p["d"])), p, zone) if month else None
    if m := NAME_YEAR.match(text):
        month = MONTH_OF.get(m["mn"].lower())
        if month and zone:
            return "month", whole_days(date(int(m["y"]), month, 1), month_after(int(m["y"]), month), zone)
    return None


def dated(day: date, part: dict, zone: ZoneInfo | None) -> tuple[str, list[Stretch]] | None:
    if part.get("h") is not None:
        return with_clock(day, part, zone)
    return ("day", whole_days(day, day + timedelta(1), zone)) if zone else None


INSTANT = T.StructType([T.StructField("s", T.LongType()), T.StructField("n", T.IntegerType())])
STRETCH = T.StructType([T.StructField("start", INSTANT), T.StructField("stop", INSTANT)])
ENTRY = T.StructType([
    T.StructField("raw", T.StringType()), T.StructField("zone", T.StringType()), T.StructField("locale", T.StringType()),
    T.StructField("unit", T.StringType()), T.StructField("stretches", T.ArrayType(STRETCH)),
])
KEYS = ["raw", "zone", "locale"]
_instant = pa.struct([("s", pa.int64()), ("n", pa.int32())])
_stretches = pa.list_(pa.struct([("start", _instant), ("stop", _instant)]))


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raws, zones, locales = (c.to_pylist() for c in batch.columns)
        units, found = [], []
        for raw, zone, locale in zip(raws, zones, locales, strict=True):
            read = parse(raw, zone or None, locale or None)
            units.append(read[0] if read else None)
            found.append([{"start": {"s": a[0], "n": a[1]}, "stop": {"s": b[0], "n": b[1]}} for a, b in read[1]] if read else None)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(units, pa.string()), pa.array(found, _stretches)], names=[*KEYS, "unit", "stretches"]
        )


class InstantDictionary:
    """A persisted table of parsed distinct values; ``update`` adds what it does not hold yet.

    Opened on the path of an earlier one it goes on with its entries. A session that names a folder in
    ``spark.quillon.instants`` keeps one dictionary there for all its queries and for later sessions; otherwise every
    dictionary begins empty. Each update is one folder, which counts once its marker is written; should two writers
    have added a value at once, it is read once.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or spark.conf.get("spark.quillon.instants", None) or rt.new_path(spark, "instants")

    def _parts(self) -> list[str]:
        return rt.names_in(self.spark, f"{self.path}/complete")

    def read(self) -> DataFrame:
        parts = self._parts()
        if not parts:
            return self.spark.createDataFrame([], ENTRY)
        rows = self.spark.read.schema(ENTRY).parquet(*[f"{self.path}/entries/{p}" for p in parts])
        return rows if len(parts) == 1 else rows.dropDuplicates(KEYS)

    def update(self, values: DataFrame) -> None:
        """values: (raw, zone, locale) of any rows, nulls in zone and locale written as ''."""
        new = values.where("raw is not null").dropDuplicates(KEYS).select(KEYS)
        if self._parts():
            new = new.join(self.read(), KEYS, "left_anti")
        part = uuid.uuid4().hex
        new.mapInArrow(_parse_batches, ENTRY).write.parquet(f"{self.path}/entries/{part}")
        if self._parts() and self.spark.read.schema(ENTRY).parquet(f"{self.path}/entries/{part}").isEmpty():
            rt.drop_path(self.spark, f"{self.path}/entries/{part}")
        else:
            rt.touch(self.spark, f"{self.path}/complete/{part}")


def document_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document_order, field, raw, zone, locale): the non-null time values of the documents."""
    docs = rt.table(spark, sf_dir, "lnote_documents", "document_order", "pack_id", "effective_from", "source_json")
    packs = rt.table(spark, sf_dir, "catalog", F.col("id").alias("pack_id"), "time_zone", "locale")
    each = F.array(
        F.struct(F.lit("date").alias("field"), F.get_json_object("source_json", "$.date").alias("raw")),
        F.struct(F.lit("effective_from").alias("field"), F.col("effective_from").alias("raw")),
        F.struct(F.lit("publishedAt").alias("field"), F.get_json_object("source_json", "$.publishedAt").alias("raw")),
    )
    return (
        docs.join(packs, "pack_id", "left")
        .select(
            "document_order", F.inline(each),
            F.coalesce("time_zone", F.lit("")).alias("zone"), F.coalesce("locale", F.lit("")).alias("locale"),
        )
        .where("raw is not null")
        .select("document_order", "field", "raw", "zone", "locale")
    )


def resolve(values: DataFrame, dictionary: InstantDictionary) -> DataFrame:
    """values with unit and stretches from the dictionary, brought up to date first."""
    dictionary.update(values)
    return rt.skew_join(values, dictionary.read(), KEYS, "left")


def as_timestamp(instant: Column) -> Column:
    return F.timestamp_micros(instant["s"] * 1_000_000 + F.floor(instant["n"] / 1000))


def normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value with its stretch: UTC start and stop (and the second possibility where the local time occurred twice)."""
    rows = resolve(document_values(spark, sf_dir), InstantDictionary(spark))
    first, second = F.get("stretches", F.lit(0)), F.get("stretches", F.lit(1))
    return rows.select(
        "document_order", "field", "raw", F.col("stretches").isNotNull().alias("readable"), "unit",
        as_timestamp(first["start"]).alias("starts_at"), as_timestamp(first["stop"]).alias("stops_at"),
        as_timestamp(second["start"]).alias("or_starts_at"), as_timestamp(second["stop"]).alias("or_stops_at"),
    )


def meet(a: Column, b: Column) -> Column:
    """Whether any stretch of a and any of b have a common instant; null if either is null."""
    return F.exists(a, lambda x: F.exists(b, lambda y: (x["start"] < y["stop"]) & (y["start"] < x["stop"])))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of fields of a document whose readable values have no common instant: (document_order, field_a, field_b)."""
    rows = resolve(document_values(spark, sf_dir), InstantDictionary(spark)).where("stretches is not null")
    fields = ["date", "effective_from", "publishedAt"]
    wide = rows.groupBy("document_order").agg(*[F.max(F.when(F.col("field") == f, F.col("stretches"))).alias(f) for f in fields])
    pairs = [(a, b) for i, a in enumerate(fields) for b in fields[i + 1 :]]
    apart = [
        F.when(~meet(F.col(a), F.col(b)), F.struct(F.lit(a).alias("field_a"), F.lit(b).alias("field_b")))
        for a, b in pairs
    ]
    return wide.select("document_order", F.inline(F.filter(F.array(*apart), lambda p: p.isNotNull())))
