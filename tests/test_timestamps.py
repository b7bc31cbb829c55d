from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.operators.timestamps import ZoneTables, normalise_timestamps, parse_batch, zone_tables

ZONES = ["Asia/Singapore", "America/Toronto", "Europe/Rome", "Europe/Berlin", "America/New_York", "America/St_Johns", "Asia/Kathmandu", "Australia/Sydney"]
TABLES = ZoneTables(ZONES)


def read(text, zone="UTC", order="dmy"):
    micros, ok = parse_batch([text], [zone], [order == "mdy"], TABLES)
    return datetime.fromtimestamp(micros[0] / 1e6, timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f") if ok[0] else None


@pytest.mark.parametrize(
    ("text", "zone", "order", "want"),
    [
        ("2024-09-16", "Asia/Kathmandu", "dmy", "2024-09-16 00:00:00.000000"),
        ("2020", "UTC", "dmy", "2020-01-01 00:00:00.000000"),
        ("06/2021", "UTC", "mdy", "2021-06-01 00:00:00.000000"),
        ("03/04/2021", "UTC", "mdy", "2021-03-04 00:00:00.000000"),
        ("03/04/2021", "UTC", "dmy", "2021-04-03 00:00:00.000000"),
        ("12/25/2015", "UTC", "dmy", "2015-12-25 00:00:00.000000"),
        ("31/11/2022", "UTC", "dmy", None),
        ("2021-02-30", "UTC", "dmy", None),
        ("0000-00-00", "UTC", "dmy", None),
        ("forthcoming", "UTC", "dmy", None),
        ("to appear", "UTC", "dmy", None),
        ("", "UTC", "dmy", None),
        (None, "UTC", "dmy", None),
        ("2023-279", "UTC", "dmy", "2023-10-06 00:00:00.000000"),
        ("2023-366", "UTC", "dmy", None),
        ("2022-W02-2", "UTC", "dmy", "2022-01-11 00:00:00.000000"),
        ("2021-W53-1", "UTC", "dmy", None),
        ("15 de junio de 2020", "UTC", "dmy", "2020-06-15 00:00:00.000000"),
        ("4. März 2022", "UTC", "dmy", "2022-03-04 00:00:00.000000"),
        ("Wed Apr  2 13:05:42 2025", "UTC", "dmy", "2025-04-02 13:05:42.000000"),
        ("Wed, 29 Jul 2020 02:05:54 -0230", "UTC", "dmy", "2020-07-29 04:35:54.000000"),
        ("May 20, 2022 at 12:39 AM UTC+02:00", "UTC", "dmy", "2022-05-19 22:39:00.000000"),
        ("20220614T060455Z", "UTC", "dmy", "2022-06-14 06:04:55.000000"),
        ("1603072554730", "UTC", "dmy", "2020-10-19 01:55:54.730000"),
        ("1743265195.5106039", "UTC", "dmy", "2025-03-29 16:19:55.510603"),
        ("2013-03-19T12:28:10.210112984", "UTC", "dmy", "2013-03-19 12:28:10.210112"),
        ("2022-03-23T06:15:06+05:30[Asia/Kolkata]", "UTC", "dmy", "2022-03-23 00:45:06.000000"),
        ("2016-03-23 19:45:52 PDT", "Europe/Berlin", "dmy", "2016-03-24 02:45:52.000000"),
        ("2020-10-25 02:30:00", "Europe/Berlin", "dmy", "2020-10-25 00:30:00.000000"),
        ("2021-03-28 02:30:00", "Europe/Berlin", "dmy", "2021-03-28 01:30:00.000000"),
        ("27.08.15 08:15:36", "Australia/Sydney", "dmy", "2015-08-26 22:15:36.000000"),
        ("2024-13-01", "UTC", "dmy", None),
        ("2024-01-01 25:00:00", "UTC", "dmy", None),
        ("x" * 5000, "UTC", "dmy", None),
        ("2024-01-01 10:00 Asia/Singapore", "UTC", "dmy", "2024-01-01 02:00:00.000000"),
        ("2024-01-01 10:00 [America/Toronto]", "UTC", "dmy", "2024-01-01 15:00:00.000000"),
        ("2024-07-01 10:00 [Europe/Rome]", "UTC", "dmy", "2024-07-01 08:00:00.000000"),
        ("1943-07-01 12:00", "Europe/Berlin", "dmy", "1943-07-01 10:00:00.000000"),
        ("2070-07-01 12:00", "Europe/Berlin", "dmy", "2070-07-01 10:00:00.000000"),
        ("3050-07-01 12:00", "Europe/Berlin", "dmy", "3050-07-01 10:00:00.000000"),
    ],
)
def test_notations(text, zone, order, want):
    assert read(text, zone, order) == want


@settings(max_examples=300, deadline=None)
@given(st.datetimes(datetime(1990, 1, 1), datetime(2035, 1, 1)), st.sampled_from(ZONES))
def test_local_times_agree_with_the_zone_database(local, zone):
    local = local.replace(microsecond=0)
    want = local.replace(tzinfo=ZoneInfo(zone), fold=0).astimezone(timezone.utc)
    assert read(local.strftime("%Y-%m-%d %H:%M:%S"), zone) == want.strftime("%Y-%m-%d %H:%M:%S.%f")


def test_rows_keep_their_columns_and_unknown_keys_read_as_utc(spark):
    dim = spark.createDataFrame([("a_b", "Europe/Berlin", "dmy"), (None, "Asia/Tokyo", "mdy")], "source string, home_zone string, date_order string")
    rows = spark.createDataFrame([(1, " A-B ", "2024-01-01 01:00", "x"), (2, None, "2024-01-01 01:00", "y"), (3, "zz", None, "z")], "id int, source string, t string, home_zone string")
    out = normalise_timestamps(rows, "t", dim, "source", TABLES).orderBy("id").collect()
    assert [r["utc_micros"] for r in out] == [1704067200000000, 1704070800000000, None]
    assert [r["home_zone"] for r in out] == ["x", "y", "z"]
    assert normalise_timestamps(rows.where(F.lit(False)), "t", dim, "source", TABLES).count() == 0


def test_tables_hold_every_region_that_texts_name(spark):
    rows = spark.createDataFrame([("2024-01-01 10:00 Asia/Singapore",), ("x [America/Argentina/Ushuaia]",), ("no/where",), (None,)], "t string")
    dim = spark.createDataFrame([("Europe/Rome",), (None,)], "home_zone string")
    assert set(zone_tables(dim, texts={"t": rows}).tables) == {"utc", "europe/rome", "asia/singapore", "america/argentina/ushuaia"}
