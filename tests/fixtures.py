"""Lines and expected counts the tests share. Times are on 2018-03-12, seven hours behind UTC."""

from __future__ import annotations

import datetime as dt

HEADER = "_time,type,incoming_url,microservice"
CUSTOMERS = "/api-gateway/v3/customers/"
LOGS = "/api-gateway/v2/logs"
SERVICE = "API-Gateway"


def time_text(clock: str) -> str:
    if "." not in clock:
        clock += ".000"
    return f"2018-03-12T{clock}-0700"


def line(clock: str, method: str = "GA.GET", url: str = CUSTOMERS, service: str = SERVICE) -> str:
    return f"{time_text(clock)},{method},{url},{service}"


def instant(clock: str) -> dt.datetime:
    return dt.datetime.strptime(time_text(clock), "%Y-%m-%dT%H:%M:%S.%f%z")


def report(key: str, end: int, count: int) -> str:
    return f"Key - {key} Window: {end} -- count: {count}"


FILTER_INPUT = [HEADER, line("17:26:04")]

TWO_WINDOWS = [line("17:26:04"), line("17:29:42", "GA.POST", LOGS)]

PER_MINUTE = [
    HEADER,
    line("17:26:04"),
    line("17:26:04", "GA.POST", LOGS),
    line("17:29:42", "GA.POST", LOGS),
    line("17:29:38", "GA.POST", LOGS),
]

FIVE_MINUTES = [
    HEADER,
    line("17:26:04"),
    line("17:26:04", "GA.POST", LOGS),
    line("17:29:42", "GA.POST", LOGS),
    line("17:40:23", "GA.POST", LOGS),
    line("17:43:02", "GA.GET", "/api-gateway/v3/vehicles/3012"),
]

# (lines, report, rows of a stream, further rows of a batch run)
GOLDEN = {
    "two_windows": (
        TWO_WINDOWS,
        "countOfAPIPerMinute",
        [report(SERVICE, 1520900820000, 1)],
        [report(SERVICE, 1520901000000, 1)],
    ),
    "per_minute": (
        PER_MINUTE,
        "countOfAPIPerMinute",
        [report(SERVICE, 1520900820000, 2)],
        [report(SERVICE, 1520901000000, 2)],
    ),
    "five_minutes": (
        FIVE_MINUTES,
        "countOfAPIPer5MinutesByHttpMethods",
        [
            report("API-Gateway:GA.GET", 1520901000000, 1),
            report("API-Gateway:GA.POST", 1520901000000, 2),
        ],
        [
            report("API-Gateway:GA.GET", 1520901900000, 1),
            report("API-Gateway:GA.POST", 1520901900000, 1),
        ],
    ),
    # By service over five minutes, and by method per minute.
    "five_minutes_by_service": (
        FIVE_MINUTES,
        "countOfAPIPer5Minutes",
        [report(SERVICE, 1520901000000, 3)],
        [report(SERVICE, 1520901900000, 2)],
    ),
    "per_minute_by_method": (
        PER_MINUTE,
        "countOfAPIPerMinuteByHttpMethods",
        [
            report("API-Gateway:GA.GET", 1520900820000, 1),
            report("API-Gateway:GA.POST", 1520900820000, 1),
        ],
        [report("API-Gateway:GA.POST", 1520901000000, 2)],
    ),
}
