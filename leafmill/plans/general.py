"""Queries of the general data-cleaning operators (problem 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators.timestamps import MONTHS, ZONES, field_values, found_instants, inferred_orders, normalise_timestamps
from leafmill.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_instants(table(spark, sf_dir, "pdf_documents"), table(spark, sf_dir, "pptx_files"), table(spark, sf_dir, "sites"))


def p2_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per field how many of its distinct values there are and how many name one instant."""
    values = field_values(table(spark, sf_dir, "pdf_documents"), table(spark, sf_dir, "pptx_files"))
    done = normalise_timestamps(values, table(spark, sf_dir, "sites"))
    return done.groupBy("file_kind", "field_name").agg(F.count(F.lit(1)).alias("n_values"), F.count("utc").alias("n_settled"))


def p2_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of day and month of each field and site, inferred from the values without the documented order."""
    return inferred_orders(field_values(table(spark, sf_dir, "pdf_documents"), table(spark, sf_dir, "pptx_files")))


QUERIES = {"p2_found": p2_found, "p2_status": p2_status, "p2_orders": p2_orders}

# The SQL reads the notations one by one and looks for the instants of a wall clock at the zone's offsets a day before and
# a day after; it shares nothing with the operator but the tables of month names and zones.
_ZONE_TEXT = r"((?:Z(?:00''?00''?)?|[A-Z]{3,4}|[+-]\d{2}[:'']?\d{2}''?)?)(?:\[[^\]]*\])?"
_PATTERNS = {
    "iso": (rf"^(?:D:)?(\d{{4}})[-/]?(\d{{2}})[-/]?(\d{{2}})[T ]?(\d{{2}}):?(\d{{2}})(?::?(\d{{2}}))?(?:\.\d+)?\s*{_ZONE_TEXT}$", "y m d hh mm ss zone"),
    "num": (r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4}) (\d{1,2}):(\d{2}):(\d{2})(?: ([AP])M)?$", "a b y hh mm ss half"),
    "named": (rf"^(?:[A-Za-z]{{3}}, )?(\d{{1,2}})\.? (\p{{L}}+) (\d{{4}}),? (?:à )?(\d{{1,2}}):(\d{{2}})(?::(\d{{2}}))?(?: Uhr)?\s*{_ZONE_TEXT}$", "d name y hh mm ss zone"),
    "asc": (r"^[A-Za-z]{3} ([A-Za-z]{3})\s+(\d{1,2}) (\d{2}):(\d{2}):(\d{2}) (\d{4})$", "name d hh mm ss y"),
    "cjk": (r"^(\d{4})[年년] ?(\d{1,2})[月월] ?(\d{1,2})[日일] ?(오전|오후)? ?(\d{1,2})[時:](\d{1,2})[分]?(\d{0,2})秒?$", "y m d half hh mm ss"),
}


def _parts() -> str:
    names = {w: n for n, words in MONTHS.items() for w in words.split()}
    months = "map([" + ", ".join(f"'{w}'" for w in names) + "], [" + ", ".join(map(str, names.values())) + "])"
    out = []
    for shape, (pattern, groups) in _PATTERNS.items():
        have = groups.split()
        get = lambda k: f"r.{k}" if k in have else "''"  # noqa: E731, B023
        month = "CASE WHEN date_order = 'mdy' THEN r.a ELSE r.b END" if shape == "num" else f"{months}[lower(r.name)]::VARCHAR" if "name" in have else "r.m"
        day = "CASE WHEN date_order = 'mdy' THEN r.b ELSE r.a END" if shape == "num" else "r.d"
        known = "AND date_order IN ('dmy', 'mdy')" if shape == "num" else ""
        fields = ", ".join(f"'{g}'" for g in have)
        out.append(
            f"""SELECT file_kind, file_id, field_name, value, tz, r.y AS y, {month} AS m, {day} AS d, r.hh AS hh, r.mm AS mm, {get('ss')} AS ss, {get('half')} AS half, {get('zone')} AS zone
            FROM (SELECT *, regexp_extract(t, '{pattern}', [{fields}]) AS r FROM v WHERE regexp_matches(t, '{pattern}') AND NOT regexp_matches(t, '^[0-9]+$')) WHERE true {known}"""
        )
    return " UNION ALL ".join(out)


_ABBREVIATIONS = "map([" + ", ".join(f"'{z}'" for z in ZONES) + "], [" + ", ".join(map(str, ZONES.values())) + "])"
_LOCAL = "epoch(timezone(tz, to_timestamp({0})))::BIGINT"
_TEXTS = " UNION ".join(
    f"SELECT '{kind}' AS file_kind, {key} AS file_id, '{field}' AS field_name, site_id, {field} AS value FROM {name}"
    for kind, name, key, fields in (("pdf", "pdf_documents", "pdf_id", ("creation_date", "modification_date")), ("pptx", "pptx_files", "pptx_id", ("created", "modified")))
    for field in fields
)
_INSTANTS = f"""WITH v AS (SELECT file_kind, file_id, site_id, field_name, value, trim(value) AS t, tz, date_order FROM ({_TEXTS}) LEFT JOIN sites USING (site_id) WHERE value IS NOT NULL),
        w AS (SELECT *, epoch(try_cast(printf('%04d-%02d-%02d %02d:%02d:%02d', y::INT, m::INT, d::INT, CASE WHEN half = '' THEN hh::INT WHEN half IN ('P', '오후') THEN hh::INT % 12 + 12 ELSE hh::INT % 12 END, mm::INT,
            CASE WHEN ss = '' THEN 0 ELSE ss::INT END) AS TIMESTAMP))::BIGINT AS wall FROM ({_parts()}) WHERE m IS NOT NULL),
        z AS (SELECT *, CASE WHEN zone = '' THEN NULL WHEN regexp_matches(zone, '^[+-]') THEN CASE WHEN zone[1] = '-' THEN -1 ELSE 1 END * (zone[2:3]::INT * 60 + regexp_replace(zone, '[^0-9+-]', '', 'g')[4:5]::INT)
            ELSE {_ABBREVIATIONS}[regexp_replace(zone, '^Z.*', 'Z')] END AS east FROM w),
        s AS (SELECT file_kind, file_id, field_name, value, tz, round((try_cast(t AS DECIMAL(30, 15)) - 25569) * 86400)::BIGINT AS wall FROM v WHERE regexp_matches(t, '^[0-9]{{5}}[.][0-9]+$')),
        l AS (SELECT *, wall - ({_LOCAL.format('wall - 86400')} - (wall - 86400)) AS c1, wall - ({_LOCAL.format('wall + 86400')} - (wall + 86400)) AS c2
            FROM (SELECT file_kind, file_id, field_name, value, tz, wall FROM z WHERE zone = '' UNION ALL SELECT * FROM s) WHERE tz IS NOT NULL AND wall IS NOT NULL),
        u AS (SELECT file_kind, file_id, field_name, value, wall - east * 60 AS moment FROM z WHERE zone <> ''
            UNION ALL SELECT file_kind, file_id, field_name, value, CASE WHEN ok1 THEN c1 ELSE c2 END FROM (SELECT *, {_LOCAL.format('c1')} = wall AS ok1, {_LOCAL.format('c2')} = wall AND c1 <> c2 AS ok2 FROM l)
                WHERE ok1 <> ok2
            UNION ALL SELECT file_kind, file_id, field_name, value, CASE WHEN length(n) > 11 THEN try_cast(n AS BIGINT) // 1000 ELSE try_cast(n AS BIGINT) END FROM (SELECT *, regexp_extract(t, '^(?:/Date[(])?([0-9]{{10}}|[0-9]{{13}})(?:[+-][0-9]{{4}}[)]/)?$', 1) AS n FROM v)
                WHERE n <> '')"""  # noqa: E501
_DIGITS = r"^(\d{1,2})[/.-](\d{1,2})[/.-]\d{4},? +\d{1,2}:\d{2}"
SQL: dict[str, str] = {
    "p2_found": f"""{_INSTANTS}
        SELECT DISTINCT file_kind, file_id, field_name, strftime(make_timestamp(moment * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS utc FROM u
        WHERE moment IS NOT NULL AND NOT regexp_matches(trim(value), '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}Z$')""",
    "p2_status": f"""{_INSTANTS}
        SELECT file_kind, field_name, count(*) AS n_values, count(moment) AS n_settled FROM (SELECT DISTINCT file_kind, file_id, site_id, field_name, value FROM v)
        LEFT JOIN (SELECT DISTINCT file_kind, file_id, field_name, value, moment FROM u WHERE moment IS NOT NULL) USING (file_kind, file_id, field_name, value) GROUP BY ALL""",
    # Where values of two readings share their weight in proportion, the fixed point of expectation and maximisation has a closed form.
    "p2_orders": f"""WITH d AS (SELECT file_kind, field_name, site_id, regexp_extract(trim(value), '{_DIGITS}', 1)::INT AS a, regexp_extract(trim(value), '{_DIGITS}', 2)::INT AS b
            FROM ({_TEXTS}) WHERE regexp_matches(trim(value), '{_DIGITS}')),
        c AS (SELECT file_kind, field_name, site_id, count(*) AS n_values, count(*) FILTER (b > 12) AS n_mdy, count(*) FILTER (a > 12) AS n_dmy, count(*) FILTER (a <= 12 AND b <= 12) AS n_both
            FROM d WHERE least(a, b) BETWEEN 1 AND 12 GROUP BY ALL),
        p AS (SELECT *, (0.5 + n_dmy) / (1.0 + n_dmy + n_mdy) AS dmy FROM c)
        SELECT file_kind, field_name, site_id, n_values, n_dmy::BIGINT AS n_dmy, n_mdy::BIGINT AS n_mdy, CASE WHEN n_both = 0 OR greatest(dmy, 1 - dmy) < 0.95 THEN NULL WHEN dmy > 0.5 THEN 'dmy' ELSE 'mdy' END AS "order",
            CASE WHEN n_both > 0 THEN round(greatest(dmy, 1 - dmy), 4) END AS posterior FROM p""",
}
