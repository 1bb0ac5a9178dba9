import datetime as dt
from zoneinfo import ZoneInfo

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.operators import timestamps as t

SITES = [(1, "Asia/Seoul", "ymd"), (2, "Europe/Berlin", "dmy"), (4, "America/New_York", "mdy"), (9, "Nowhere/Land", "dmy"), (13, "UTC", "ymd")]
CASES = [
    # site, text, utc or None, status
    (1, "D:20240101000000", "2023-12-31T15:00:00Z", "ok"),
    (1, "D:202401010000", "2023-12-31T15:00:00Z", "ok"),
    (None, "D:20240101000000", None, "no_site"),
    (9, "2024-01-01 10:00:00", None, "no_site"),
    (2, "D:20240330235641+00'00'", "2024-03-30T23:56:41Z", "ok"),
    (2, "D:20240330235641-04'30", "2024-03-31T04:26:41Z", "ok"),
    (2, "D:20240126121144Z00'00'", "2024-01-26T12:11:44Z", "ok"),
    (2, "2021-04-06T02:10:00Z", "2021-04-06T02:10:00Z", "ok"),
    (2, "2024-07-11T15:14:41.607Z", "2024-07-11T15:14:41Z", "ok"),
    (2, "2022-07-02T22:04:03+09:00[Asia/Seoul]", "2022-07-02T13:04:03Z", "ok"),
    (2, "Mon, 30 Aug 2021 01:07:17 +0200", "2021-08-29T23:07:17Z", "ok"),
    (2, "29 Mar 2020 00:46:36 CET", "2020-03-28T23:46:36Z", "ok"),
    (2, "1 Oct 2022 19:19:43 QQT", None, "unknown_zone"),
    (2, "Wed Nov  6 22:00:14 2024", "2024-11-06T21:00:14Z", "ok"),
    (4, "07/27/2024 6:51:59 AM", "2024-07-27T10:51:59Z", "ok"),
    (4, "07/27/2024 12:00:01 AM", "2024-07-27T04:00:01Z", "ok"),
    (4, "07/27/2024 12:00:01 PM", "2024-07-27T16:00:01Z", "ok"),
    (4, "27/07/2024 10:00:00", None, "no_such_date"),
    (2, "03/04/2024 13:49:35", "2024-04-03T11:49:35Z", "ok"),
    (2, "27.10.2024 02:45:44", None, "ambiguous_wall"),
    (2, "31.03.2024 02:30:00", None, "skipped_wall"),
    (2, "13. September 2024, 08:18 Uhr", "2024-09-13T06:18:00Z", "ok"),
    (2, "19 janvier 2020 à 08:15:33", "2020-01-19T07:15:33Z", "ok"),
    (1, "2023년 1월 12일 오전 12:05", "2023-01-11T15:05:00Z", "ok"),
    (1, "2021년 7월 26일 오후 5:49", "2021-07-26T08:49:00Z", "ok"),
    (1, "2025年6月18日 23時39分47秒", "2025-06-18T14:39:47Z", "ok"),
    (None, "1665552232", "2022-10-12T05:23:52Z", "ok"),
    (None, "1760995798156", "2025-10-20T21:29:58Z", "ok"),
    (None, "/Date(1682133188000+0200)/", "2023-04-22T03:13:08Z", "ok"),
    (13, "45559.4228703704", "2024-09-24T10:08:56Z", "ok"),
    (13, "45559.9999999999", "2024-09-25T00:00:00Z", "ok"),
    (13, "2023-04-30", None, "day_only"),
    (13, "2023-02-30T10:15:00Z", None, "no_such_date"),
    (13, "2022-13-04 09:00", None, "no_such_date"),
    (13, "2024-02-29 23:59:59", "2024-02-29T23:59:59Z", "ok"),
    (13, "2100-02-29 00:00:00", None, "no_such_date"),
    (13, "2024-01-01 24:00:00", None, "no_such_date"),
    (13, "N/A", None, "no_instant"),
    (13, "", None, "blank"),
    (13, "  ", None, "blank"),
    (13, None, None, "blank"),
    (13, "x" * 100_000, None, "no_instant"),
]


@pytest.fixture(scope="module")
def sites(spark):
    return spark.createDataFrame(SITES + SITES[:1], "site_id int, tz string, date_order string")


def test_cases(spark, sites):
    rows = [(k, s, v, "src", "extra") for k, (s, v, _, _) in enumerate(CASES)]
    got = {r["k"]: r for r in t.normalise_timestamps(spark.createDataFrame(rows, "k int, site_id int, value string, source string, tz string"), sites).collect()}
    for k, (_, v, utc, status) in enumerate(CASES):
        assert (got[k]["utc"], got[k]["status"]) == (utc, status), v and v[:40]
        assert got[k]["tz"] == "extra"


def test_empty(spark, sites):
    empty = spark.createDataFrame([], "site_id int, value string, source string")
    assert t.normalise_timestamps(empty, sites).count() == 0


def test_wall_clocks_against_zoneinfo(spark):
    """Every half hour around the changes of several zones, by brute force over all offsets."""
    zones = ["Europe/Berlin", "America/New_York", "Australia/Lord_Howe", "America/Sao_Paulo", "Asia/Kolkata"]
    rows, want = [], {}
    for z in zones:
        for day in ("2024-03-31", "2024-10-27", "2024-03-10", "2024-11-03", "2024-04-07", "2024-10-06", "2018-11-04", "2018-02-18"):
            base = dt.datetime.fromisoformat(day) - dt.timedelta(hours=6)
            for k in range(48):
                wall = base + dt.timedelta(minutes=30 * k)
                seconds = int((wall - dt.datetime(1970, 1, 1)).total_seconds())
                found = {s for off in range(-15 * 3600, 15 * 3600, 900) if dt.datetime.fromtimestamp(s := seconds - off, ZoneInfo(z)).replace(tzinfo=None) == wall}
                rows.append((z, seconds))
                want[z, seconds] = (len(found), min(found) if len(found) == 1 else None)
    df = spark.createDataFrame(rows, "z string, s long").distinct()
    n, first = t._local_to_utc(df["s"], df["z"])
    for r in df.select("z", "s", n.alias("n"), first.alias("first")).collect():
        ways, at = want[r["z"], r["s"]]
        assert r["n"] == ways, r
        if ways == 1:
            assert r["first"] == at, r


def test_twelve_digits_are_read_by_their_source(spark, sites):
    """Milliseconds and packed digits compete; the year speaks, and where both years are likely, the rest of the source."""
    rows = [(1, "202401011230", "a"), (2, "1704110000000", "a"), (3, "202401321230", "a")]
    rows += [(10 + k, "700000000000", "b") for k in range(3)] + [(20 + k, f"202401{k + 10}123000", "b") for k in range(18)]
    rows += [(90, "198512011230", "c"), (91, "701210112233", "d")] + [(100 + k, f"17041{k:02}000000", "d") for k in range(40)]
    df = spark.createDataFrame([(k, v, s, 2) for k, v, s in rows], "k int, value string, source string, site_id int")
    got = {r["k"]: r for r in t.normalise_timestamps(df, sites).collect()}
    assert (got[1]["utc"], got[1]["reading"], got[1]["status"]) == ("2024-01-01T11:30:00Z", "packed", "ok") and 0.95 < got[1]["posterior"] < 1
    assert got[2]["reading"] == "count" and got[3]["reading"] == "count"  # no 32nd of January: one reading is left
    assert got[10]["reading"] == "count" and got[20]["reading"] == "packed"
    assert got[91]["reading"] == "count" and got[91]["status"] == "ok"


def test_inferred_order_reaches_the_instant(spark, sites):
    """A site without a documented order: the mixture of its values decides, and a source that tells nothing stays open."""
    place = spark.createDataFrame([(1, "UTC", None), (2, "UTC", None), (3, "UTC", "dmy")], "site_id int, tz string, date_order string")
    rows = [(k, 1, f"12/{k + 13}/2024 10:00:00") for k in range(15)] + [(50, 1, "03/04/2024 10:00:00"), (60, 2, "03/04/2024 10:00:00"), (70, 3, "03/04/2024 10:00:00")]
    rows += [(80 + k, 3, f"12/{k + 13}/2024 10:00:00") for k in range(15)]
    df = spark.createDataFrame([(*r, "s") for r in rows], "k int, site_id int, value string, source string")
    got = {r["k"]: (r["utc"], r["status"]) for r in t.normalise_timestamps(df, place, certainty=0.9).collect()}
    assert got[50] == ("2024-03-04T10:00:00Z", "ok") and got[60] == (None, "ambiguous_format")
    assert got[70] == ("2024-04-03T10:00:00Z", "ok") and got[80] == (None, "no_such_date")  # the site's order is a rule
    free = {r["k"]: (r["utc"], r["status"]) for r in t.normalise_timestamps(df, place, certainty=0.7, site_rule=False).collect()}
    assert free[70] == ("2024-03-04T10:00:00Z", "ok") and free[80][1] == "ok"  # unless it is only a prior


def test_order_is_learnt_where_no_site_tells(spark):
    """Without a documented order the mixture weights of the source decide, and without evidence nothing does."""
    mdy = 1 << t.READINGS.index("mdy")
    dmy = 1 << t.READINGS.index("dmy")
    rows = [("a", None, mdy, 500), ("a", None, dmy | mdy, 300), ("b", None, dmy | mdy, 40), ("c", "dmy", dmy | mdy, 5), ("c", "dmy", mdy, 5)]
    got = {(r["source"], r["mask"]): r for r in t.format_posteriors(spark.createDataFrame(rows, "source string, site_order string, mask int, n long")).collect()}
    assert got["a", dmy | mdy]["choice"] == "mdy" and got["a", dmy | mdy]["posterior"] > 0.95
    assert got["b", dmy | mdy]["posterior"] < 0.95
    assert got["c", dmy | mdy]["choice"] == "dmy" and got["c", mdy]["choice"] is None


@settings(max_examples=5, deadline=None)
@given(st.lists(st.datetimes(dt.datetime(1950, 1, 1), dt.datetime(2120, 1, 1)), min_size=1, max_size=20))
def test_packed_and_named_forms_agree(spark, sites, instants):
    rows = []
    for k, x in enumerate(instants):
        x = x.replace(microsecond=0)
        for form in ("%Y-%m-%dT%H:%M:%S+00:00", "D:%Y%m%d%H%M%SZ", "%d %b %Y %H:%M:%S UTC", "%a, %d %b %Y %H:%M:%S +0000"):
            rows.append((k, x.strftime(form), x.strftime("%Y-%m-%dT%H:%M:%SZ"), 2, form))
    got = t.normalise_timestamps(spark.createDataFrame(rows, "k int, value string, want string, site_id int, source string"), sites).collect()
    assert all(r["utc"] == r["want"] for r in got)
