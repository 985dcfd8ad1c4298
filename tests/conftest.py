"""Small hand-worked event tables and one local session for all tests."""

from __future__ import annotations

import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from stepwell import events_from_rows, get_spark  # noqa: E402

MONDAY = datetime(2026, 1, 5)


def at(text: str) -> datetime:
    """``"05 10:00"`` -> that day and time in January 2026."""
    return datetime.strptime(f"2026-01-{text}", "%Y-%m-%d %H:%M")


def hours(value: float) -> datetime:
    return MONDAY + timedelta(hours=value)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    warehouse = tmp_path_factory.mktemp("warehouse")
    session = get_spark(
        "tests",
        master="local[4]",
        spark__sql__shuffle__partitions="4",
        spark__sql__warehouse__dir=str(warehouse),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def table(spark):
    """Make an event table from ``(user, time, name[, channel[, platform]])`` rows."""

    def make(*rows):
        defaults = ("organic", "web")
        return events_from_rows(spark, [(*r, *defaults[len(r) - 3 :]) for r in rows])

    return make


#: Three weeks of sign-ups without any in the middle one; user -> (sign-up, lessons), month-day hour.
MEMBERS = {
    "ann": ("02-17 08", ["02-17 20", "02-24 07", "03-03 07"]),
    "ben": ("02-18 12", ["03-04 12"]),
    "cat": ("02-22 23", ["02-23 01"]),  # two hours, but the next week
    "dan": ("02-19 15", []),
    "eve": ("03-02 00", ["03-02 18", "03-10 09"]),
    "fay": ("03-08 22", []),
}

RETENTION_ROWS = [
    (user, datetime.strptime(f"2026-{text}", "%Y-%m-%d %H"), name)
    for user, (joined, lessons) in MEMBERS.items()
    for name, text in [("signup", joined), *(("lesson_start", x) for x in lessons)]
]

SHOP = ["visit", "basket", "order"]
#: shopper -> (channel, what they did at which hour); each has a story of their own.
SHOPPERS = {
    "ada": ("email", "visit 0, basket 3, order 7"),
    "bo": ("email", "visit 10, basket 60, order 61"),  # slow in the middle
    "cy": ("search", "visit 20, order 22, basket 25, order 200"),  # orders before and long after
    "dee": ("search", "basket 1, visit 30, basket 36"),  # a basket on either side of the visit
    "eli": ("search", "order 5"),  # never visits
    "flo": ("search", "visit 40, visit 44"),
    "gus": ("email", "visit 50, basket 50, order 51"),  # a basket at the instant of the visit
}

FUNNEL_ROWS = [
    (user, hours(int(event.split()[1])), event.split()[0], channel)
    for user, (channel, story) in SHOPPERS.items()
    for event in story.split(", ")
]


@pytest.fixture(scope="session")
def retention_events(table):
    return table(*RETENTION_ROWS).cache()


@pytest.fixture(scope="session")
def funnel_events(table):
    return table(*FUNNEL_ROWS).cache()


def column(df, name: str) -> list:
    return [row[name] for row in df.collect()]
