"""Instants written in many notations and zones, brought to one UTC instant.

Every text is read under each notation that fits it (all in JVM expressions).  The only readings that can compete for
one text are orders of day and month and, for twelve bare digits, milliseconds against packed calendar digits.  Which one
holds is decided per source by expectation-maximisation over the mixture of notations, see :func:`format_posteriors`.
A site's documented order of day and month rules the other one out, as the statement of the data requires; with
``site_rule=False`` it is a weak prior that the values themselves can overrule.

Defined results
---------------
null, empty and blank texts, texts of no known notation, dates that do not exist, days without a time: ``undetermined``
with the reason in ``status``.  Wall clocks of an unknown site: ``no_site``; wall clocks that the zone shows twice or
never: ``ambiguous_wall`` and ``skipped_wall``.  Readings between which the posterior stays below ``certainty``:
``ambiguous_format``.  Repeated rows stay repeated rows; extra columns are carried along.
"""

from __future__ import annotations

import zoneinfo

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.session import materialise

# Month names as written in en, de, fr, es and pt (fixed values); abbreviations are their first three letters or more.
MONTHS = {
    1: "january januar janvier enero janeiro jan ene janv",
    2: "february februar février fevrier febrero fevereiro feb fev févr fevr",
    3: "march märz maerz mars marzo março marco mar mär mrz",
    4: "april avril abril apr avr abr",
    5: "may mai mayo maio",
    6: "june juni juin junio junho jun",
    7: "july juli juillet julio julho jul juil",
    8: "august août aout agosto aug ago aoû",
    9: "september septembre septiembre setembro sep sept set",
    10: "october oktober octobre octubre outubro oct okt out",
    11: "november novembre noviembre novembro nov",
    12: "december dezember décembre decembre diciembre dezembro dec dez déc dic",
}
# Zone abbreviations in minutes east of UTC (fixed values).
ZONES = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "MET": 60, "CEST": 120, "MEST": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "IST": 330, "KST": 540, "JST": 540, "AWST": 480, "ACST": 570, "ACDT": 630,
    "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420,
    "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600, "BRT": -180, "ART": -180,
}
CANONICAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"
READINGS = ("dmy", "mdy", "fixed", "count", "packed")
#: Seconds (1985 to 2100) outside which a reading is unlikely: the files were not written then.
PLAUSIBLE = (473_385_600, 4_102_444_800)
UNLIKELY = 0.01

_ZONE = (
    r"(?:(Z|[A-Z]{2,5})(?:00'?:?00'?)?|(?:UTC|GMT)?([+-])(\d{2})[:']?(\d{2})'?)?"
    r"(?:\[[A-Za-z_/+-]+\d*\])?"
)
_ISO = r"^(D:)?(\d{4})([-/.]?)(\d{2})\3(\d{2})(?:[T ]?(\d{2})[:]?(\d{2})(?:[:]?(\d{2}))?(?:[.,]\d+)?\s*" + _ZONE + ")?$"
_NUM = r"^(\d{1,2})([/.-])(\d{1,2})\2(\d{4})(?:,?\s+(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d+)?)?\s*([AaPp])?\.?(?:[Mm]\.?)?\s*" + _ZONE + ")?$"
_NAMED = (
    r"^(?:\p{L}{2,}\.?,\s*)?(\d{1,2})(?:\.|st|nd|rd|th|er)?\s+(?:de\s+)?(\p{L}{3,})\.?\s+(?:de\s+)?(\d{4}),?\s+(?:à\s+|às\s+|a las\s+|um\s+)?"
    r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d+)?)?(?:\s*Uhr)?\s*" + _ZONE + "$"
)
_ASC = r"^(?:\p{L}{3},?\s+)(\p{L}{3})\s+(\d{1,2})\s+(\d{1,2}):(\d{2}):(\d{2})\s+" + _ZONE + r"\s*(\d{4})$"
_CJK = (
    r"^(\d{4})\s*[年년]\s*(\d{1,2})\s*[月월]\s*(\d{1,2})\s*[日일]\s*(오전|오후|午前|午後)?\s*(\d{1,2})\s*[時시:]\s*"
    r"(\d{1,2})\s*(?:[分분:]\s*(?:(\d{1,2})\s*[秒초]?)?)?$"
)
_COUNT = r"^(?:/Date\()?(-?\d{9,10}|-?\d{12,13})(?:[+-]\d{4})?(?:\)/)?$"
_SERIAL = r"^(\d{5})(?:[.,](\d+))$"


def _days(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a Gregorian date, by integer arithmetic only, so that no invalid date can raise."""
    yy = y - F.when(m <= 2, 1).otherwise(0)
    era = F.floor(yy / 400).cast("long")
    yoe = yy - era * 400
    doy = F.floor((153 * (m + F.when(m > 2, -3).otherwise(9)) + 2) / 5).cast("long") + d - 1
    doe = yoe * 365 + F.floor(yoe / 4).cast("long") - F.floor(yoe / 100).cast("long") + doy
    return era * 146097 + doe - 719468


def _exists(y: Column, m: Column, d: Column) -> Column:
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    longest = F.when(m.isin(4, 6, 9, 11), 30).when(m == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    return (y >= 1) & m.between(1, 12) & (d >= 1) & (d <= longest)


def _wall(y: Column, m: Column, d: Column, hh: Column, mm: Column, ss: Column) -> Column:
    """Seconds of the wall clock as if it were UTC; null when the date or time does not exist."""
    ss = F.coalesce(ss, F.lit(0))
    ok = _exists(y, m, d) & hh.between(0, 23) & mm.between(0, 59) & ss.between(0, 59)
    return F.when(ok, _days(y, m, d) * 86400 + hh * 3600 + mm * 60 + ss)


def _month(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for n, names in MONTHS.items() for w in names.split() for x in (w, n)])
    return F.try_element_at(table, F.lower(name))


# Per notation: its pattern and which group of it holds y, m, d, hour, minute, second, half of the day, zone name, zone
# sign, zone hours, zone minutes (0: the notation has none).
_SHAPES = {
    "iso": (_ISO, (2, 4, 5, 6, 7, 8, 0, 9, 10, 11, 12)),
    "num": (_NUM, (4, 3, 1, 5, 6, 7, 8, 9, 10, 11, 12)),
    "named": (_NAMED, (3, 2, 1, 4, 5, 6, 0, 7, 8, 9, 10)),
    "asc": (_ASC, (10, 1, 2, 3, 4, 5, 0, 6, 7, 8, 9)),
    "cjk": (_CJK, (1, 2, 3, 5, 6, 7, 4, 0, 0, 0, 0)),
}


def with_readings(values: DataFrame, text: str, to: str = "_r") -> DataFrame:
    """Add a struct `to`: ``shape`` (notation), ``day_only``, ``zone`` (minutes east, null without one), ``bad_zone``, and
    for each of READINGS the seconds of that reading (null where it is none).  ``count`` is an instant, the others are
    wall clocks counted as if they were UTC.

    Each text meets one regular expression per notation until one fits; its groups are taken out together in one
    replacement, and the calendar arithmetic is shared by all notations.
    """
    t = F.col("_t")
    df = values.withColumn("_t", F.trim(F.regexp_replace(F.col(text), "[\\u00a0\\u2007\\u2009\\u202f\\u3000]", " ")))
    # Twelve digits may be a count or a date and time; both are read.
    shape = F.when(t.rlike(r"^\d{12}$") & t.rlike(_ISO), "iso").when(t.rlike(_COUNT), "count").when(t.rlike(_SERIAL), "serial")
    for name, (pattern, _) in _SHAPES.items():
        shape = shape.when(t.rlike(pattern), name)
    df = df.withColumn("_shape", shape)
    taken = F.lit(None).cast("string")
    for name, (pattern, groups) in _SHAPES.items():
        to_text = "|".join(f"${k}" if k else "" for k in groups)
        taken = F.when(F.col("_shape") == name, F.regexp_replace(t, pattern, to_text)).otherwise(taken)
    df = df.withColumn("_f", F.split(taken, "\\|"))
    part = lambda k: F.when(F.size("_f") == 11, F.col("_f")[k])
    number = lambda k: F.when(part(k).rlike("^[0-9]{1,4}$"), part(k).cast("int"))
    table = F.create_map(*[F.lit(x) for k, v in ZONES.items() for x in (k, v)])
    half = F.lower(part(6))
    noon = F.when(half.isin("p", "오후", "午後"), 12).otherwise(0)
    hour = F.when(half == "", number(3)).when(number(3).between(0, 12), number(3) % 12 + noon)
    offset = F.when(part(8) == "-", -1).otherwise(1) * (number(9) * 60 + number(10))
    df = df.select(
        *[c for c in df.columns if c != "_f"],
        number(0).alias("_y"),
        F.coalesce(number(1), _month(part(1))).alias("_m"),
        number(2).alias("_d"),
        hour.alias("_hh"),
        number(4).alias("_mm"),
        number(5).alias("_ss"),
        F.when(part(8) != "", offset).when(part(7) != "", F.try_element_at(table, part(7))).alias("_zone"),
        F.coalesce(part(7) != "", F.lit(False)).alias("_named"),
        F.when(t.rlike(_COUNT), F.regexp_replace(t, _COUNT, "$1").cast("long")).alias("_n"),
    )
    clock = (F.col("_hh"), F.col("_mm"), F.col("_ss"))
    serial = F.round((F.regexp_replace(t, ",", ".").cast("decimal(30,15)") - 25569) * 86400, 0).cast("long")
    df = df.withColumn("_ymd", _wall(F.col("_y"), F.col("_m"), F.col("_d"), *clock)).withColumn(
        "_ydm", F.when(F.col("_shape") == "num", _wall(F.col("_y"), F.col("_d"), F.col("_m"), *clock))
    )
    digits, kind = t.rlike(r"^\d+$"), F.col("_shape")
    packed = (kind == "iso") & digits
    reading = F.struct(
        kind.alias("shape"),
        (kind.isin(*_SHAPES) & F.col("_hh").isNull() & F.col("_mm").isNull()).alias("day_only"),
        F.col("_zone").alias("zone"),
        (F.col("_zone").isNull() & F.col("_named")).alias("bad_zone"),
        F.when(kind == "num", F.col("_ymd")).alias("dmy"),
        F.col("_ydm").alias("mdy"),
        # Day numbers count from 1899-12-30, which is 25569 days before 1970-01-01.
        F.when(kind == "serial", serial).when((kind != "num") & ~packed, F.col("_ymd")).alias("fixed"),
        F.when(F.length(F.abs("_n").cast("string")) >= 12, F.floor(F.col("_n") / 1000)).otherwise(F.col("_n")).cast("long").alias("count"),
        F.when(packed, F.col("_ymd")).alias("packed"),
    )
    return df.withColumn(to, reading).drop("_t", "_shape", "_y", "_m", "_d", "_hh", "_mm", "_ss", "_zone", "_named", "_n", "_ymd", "_ydm")


def masks(reading: str = "_r") -> Column:
    """The readings of a value in one number: bit k where ``READINGS[k]`` is valid, and bit k + len(READINGS) where it is valid
    but outside PLAUSIBLE."""
    bits = F.lit(0)
    for k, name in enumerate(READINGS):
        at = F.col(f"{reading}.{name}")
        bits = bits + at.isNotNull().cast("int") * (1 << k) + F.when(~at.between(*PLAUSIBLE), 1 << (k + len(READINGS))).otherwise(0)
    return bits


def format_posteriors(patterns: DataFrame, order_weight: float = 5.0, rounds: int = 500, tolerance: float = 1e-10, site_rule: bool = True) -> DataFrame:
    """Expectation-maximisation over the mixture of notations of each source.

    ``patterns``: (source string, site_order string?, mask int, n long), one row for each source and mask (see
    :func:`masks`), so a source has a bounded number of rows however many values it holds.  A value has likelihood 1 under
    a valid reading, UNLIKELY under one outside PLAUSIBLE and 0 under others; the mixture weights are the format shares of
    the source.  The order of day and month that a site is documented to use enters as ``order_weight`` pseudo-observations
    and, under ``site_rule``, excludes the other order.  Returns (source, mask, choice string?, posterior double): the
    likeliest reading and its posterior probability for values with that mask.
    """
    count = len(READINGS)

    def em(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        seen = rows["mask"].to_numpy(np.int64)
        valid = (seen[:, None] >> np.arange(count)) & 1
        like = valid * np.where((seen[:, None] >> np.arange(count, 2 * count)) & 1, UNLIKELY, 1.0)
        order = next((o for o in rows["site_order"] if isinstance(o, str)), None)
        prior = np.full(count, 0.5)
        if order in ("dmy", "mdy"):
            prior[READINGS.index(order)] += order_weight
            if site_rule:
                like[:, READINGS.index("mdy" if order == "dmy" else "dmy")] = 0.0
        n = rows["n"].to_numpy(float)[:, None]
        share = prior / prior.sum()
        for _ in range(rounds):
            joint = like * share
            total = joint.sum(1, keepdims=True)
            post = np.divide(joint, total, out=np.zeros_like(joint), where=total > 0)
            new = prior + (post * n).sum(0)
            new /= new.sum()
            done = np.abs(new - share).max() < tolerance
            share = new
            if done:
                break
        best = post.argmax(1)
        return pd.DataFrame({"source": rows["source"], "mask": rows["mask"], "choice": [READINGS[k] if p[k] > 0 else None for k, p in zip(best, post)], "posterior": post.max(1)})

    return patterns.groupBy("source").applyInPandas(em, "source string, mask int, choice string, posterior double")


def _local_to_utc(wall: Column, zone: Column) -> tuple[Column, Column]:
    """(number of instants at which the zone's clocks show `wall`, the earliest of them), in seconds.

    The zone's offsets a day before and a day after the wall clock are the only candidates around one change.
    """
    shift = lambda s: F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(s), zone)) - s
    before, after = wall - shift(wall - 86400), wall - shift(wall + 86400)
    ok_b, ok_a = shift(before) + before == wall, (shift(after) + after == wall) & (after != before)
    return ok_b.cast("int") + ok_a.cast("int"), F.when(ok_b, before).when(ok_a, after)


def normalise_timestamps(
    values: DataFrame,
    sites: DataFrame,
    text: str = "value",
    source: str = "source",
    site: str = "site_id",
    certainty: float = 0.95,
    site_rule: bool = True,
) -> DataFrame:
    """Add ``utc_seconds`` (long?), ``utc`` (string?), ``status``, ``reading`` (string?) and ``posterior`` to `values`.

    `sites` has one row a site: site_id, tz (IANA), date_order.  It is a dimension table; Spark broadcasts it if its
    size allows and shuffles it otherwise.  Repeated site rows are reduced to one; unknown zones count as no site.
    """
    known = F.col("tz").isin(sorted(zoneinfo.available_timezones()))
    place = (
        sites.select(F.col("site_id").alias("_site"), F.when(known, F.col("tz")).alias("_tz"), F.lower("date_order").alias("_order"))
        .where(F.col("_site").isNotNull())
        .groupBy("_site").agg(F.min_by("_tz", F.struct("_tz", "_order")).alias("_tz"), F.min_by("_order", F.struct("_tz", "_order")).alias("_order"))
    )
    read = with_readings(values, text)
    read = read.join(place, read[site] == place["_site"], "left").drop("_site")
    # Filters on computed columns would be pushed below their whole definition; a written table keeps the plan small and
    # the parse is done once for the statistics and the values.
    # Different notations of one source do not inform each other's readings beyond the mixture weights kept per source.
    read = read.withColumn("_source", F.concat_ws("\u001f", F.col(source), F.coalesce(F.col(site).cast("string"), F.lit("?"))))
    read = materialise(read, "readings").withColumn("_mask", masks())
    patterns = (
        read.where("_mask > 0")
        .groupBy(F.col("_source").alias("source"), F.col("_mask").alias("mask"))
        .agg(F.min("_order").alias("site_order"), F.count(F.lit(1)).alias("n"))
    )
    # Written as well, so that Spark knows how small it is: the values are not moved to meet it unless it is large.
    post = materialise(format_posteriors(patterns, site_rule=site_rule), "posteriors")
    post = post.select(F.col("source").alias("_source"), F.col("mask").alias("_mask"), F.col("choice").alias("_choice"), "posterior")
    both = read.join(post, ["_source", "_mask"], "left")
    wall = F.coalesce(*[F.when(F.col("_choice") == name, F.col(f"_r.{name}")) for name in READINGS if name != "count"])
    zone = F.col("_r.zone")
    ways, first = _local_to_utc(wall, F.col("_tz"))
    both = both.withColumn("_wall", wall).withColumn(
        "_local", F.when(F.col("_wall").isNotNull() & F.col("_tz").isNotNull() & zone.isNull(), F.struct(ways.alias("n"), first.alias("at")))
    )
    blank = F.col(text).isNull() | (F.trim(F.col(text)) == "")
    status = (
        F.when(blank, "blank")
        .when(F.col("_r.shape").isNull(), "no_instant")
        .when(F.col("_r.day_only"), "day_only")
        .when(F.col("_choice").isNull(), "no_such_date")
        .when(F.col("posterior") < certainty, "ambiguous_format")
        .when(F.col("_choice") == "count", "ok")
        .when(F.col("_r.bad_zone"), "unknown_zone")
        .when(zone.isNotNull(), "ok")
        .when(F.col("_tz").isNull(), "no_site")
        .when(F.col("_local.n") == 0, "skipped_wall")
        .when(F.col("_local.n") > 1, "ambiguous_wall")
        .otherwise("ok")
    )
    seconds = F.when(F.col("_choice") == "count", F.col("_r.count")).when(zone.isNotNull(), F.col("_wall") - zone * 60).otherwise(F.col("_local.at"))
    out = both.withColumn("status", status).withColumn("utc_seconds", F.when(F.col("status") == "ok", seconds))
    utc = F.date_format(F.timestamp_seconds("utc_seconds"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return out.withColumn("utc", utc).withColumnRenamed("_choice", "reading").drop("_r", "_mask", "_source", "_wall", "_local", "_tz", "_order")


def field_values(pdf_documents: DataFrame, pptx_files: DataFrame) -> DataFrame:
    """(file_kind, file_id, site_id, field_name, value, source) of the four fields, each distinct value of a file once."""
    parts = []
    for kind, df, key, fields in (
        ("pdf", pdf_documents, "pdf_id", ("creation_date", "modification_date")),
        ("pptx", pptx_files, "pptx_id", ("created", "modified")),
    ):
        pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in fields])).alias("p")
        parts.append(df.select(F.lit(kind).alias("file_kind"), F.col(key).alias("file_id"), "site_id", pairs).select("file_kind", "file_id", "site_id", "p.*"))
    values = parts[0].unionByName(parts[1]).where(F.col("value").isNotNull()).distinct()
    return values.withColumn("source", F.concat_ws("/", "file_kind", "field_name"))


def found_instants(pdf_documents: DataFrame, pptx_files: DataFrame, sites: DataFrame) -> DataFrame:
    """(file_kind, file_id, field_name, utc) of every value that names one instant and is not yet in canonical form."""
    # A filter on the status would be pushed below its whole definition and repeat it; it reads the written result instead.
    done = materialise(normalise_timestamps(field_values(pdf_documents, pptx_files), sites), "instants")
    return (
        done.where((F.col("status") == "ok") & ~F.trim(F.col("value")).rlike(CANONICAL))
        .select("file_kind", "file_id", "field_name", "utc").distinct()
    )


def inferred_orders(values: DataFrame) -> DataFrame:
    """(file_kind, field_name, site_id, n_values, n_dmy, n_mdy, order, posterior) of the sources with dates in figures: the
    order of day and month as the values alone tell it.  ``order`` is null where the posterior stays below 0.95."""
    read = materialise(with_readings(values.select("file_kind", "field_name", "site_id", "value"), "value").drop("value"), "orders")
    read = read.select("file_kind", "field_name", "site_id", masks().alias("mask"), F.col("_r.shape").alias("shape"), F.col("_r.dmy").isNotNull().alias("dmy"), F.col("_r.mdy").isNotNull().alias("mdy"))
    read = read.where("shape = 'num' and (dmy or mdy)")
    key = F.concat_ws("/", "file_kind", "field_name", F.coalesce(F.col("site_id").cast("string"), F.lit("?"))).alias("source")
    patterns = read.groupBy("file_kind", "field_name", "site_id", "mask").agg(F.count(F.lit(1)).alias("n"), F.first("dmy").alias("dmy"), F.first("mdy").alias("mdy"))
    post = format_posteriors(patterns.select(key, F.lit(None).cast("string").alias("site_order"), "mask", "n"))
    told = patterns.withColumn("source", key).join(post, ["source", "mask"])
    only = lambda a, b: F.sum(F.when(F.col(a) & ~F.col(b), F.col("n")).otherwise(0))
    both = F.col("dmy") & F.col("mdy")
    got = told.groupBy("file_kind", "field_name", "site_id").agg(
        F.sum("n").alias("n_values"), only("dmy", "mdy").alias("n_dmy"), only("mdy", "dmy").alias("n_mdy"), F.max(F.when(both, F.struct("posterior", "choice"))).alias("top")
    )
    return got.select(
        "file_kind", "field_name", "site_id", "n_values", "n_dmy", "n_mdy", F.when(F.col("top.posterior") >= 0.95, F.col("top.choice")).alias("order"), F.round("top.posterior", 4).alias("posterior")
    )
