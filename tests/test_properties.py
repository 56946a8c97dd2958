"""Random lines against a plain Python account of what the reports should say."""

from __future__ import annotations

import datetime as dt
from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gatetally.operators import malformed_rows, parse_gateway_logs
from gatetally.plans import REPORTS, all_report_lines, report_lines
from gatetally.sources import lines_from

MILLIS = {"1 minute": 60_000, "5 minutes": 300_000}


def expected(lines: list[str]) -> tuple[list[tuple], list[str]]:
    """Records as (epoch ms, url, type, microservice), and malformed lines."""
    records, malformed = [], []
    for text in lines:
        if "_time" in text:
            continue
        fields = text.split(",")
        while fields and fields[-1] == "":
            fields.pop()
        try:
            if len(fields) < 4 or len(fields[0]) != 28:
                raise ValueError
            time = dt.datetime.strptime(fields[0], "%Y-%m-%dT%H:%M:%S.%f%z")
        except ValueError:
            malformed.append(text)
        else:
            epoch = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
            ms = (time - epoch) // dt.timedelta(milliseconds=1)
            records.append((ms, fields[2], fields[1], fields[3]))
    return records, malformed


def counted(records: list[tuple], keys: tuple[str, ...], duration: str) -> list[str]:
    width = MILLIS[duration]
    counts = Counter()
    for ms, _, method, service in records:
        values = {"microservice": service, "type": method}
        counts[tuple(values[k] for k in keys), (ms // width + 1) * width] += 1
    return sorted(
        f"Key - {':'.join(key)} Window: {end} -- count: {n}" for (key, end), n in counts.items()
    )


moments = st.datetimes(dt.datetime(1965, 1, 1), dt.datetime(2035, 1, 1)) | st.datetimes(
    dt.datetime(2018, 3, 11, 9, 55), dt.datetime(2018, 3, 11, 10, 10)
)
offsets = st.sampled_from(["+0000", "-0700", "+0545", "-0330", "+1400"])
words = st.text(alphabet="ab:. -_é", max_size=3)
good_times = st.builds(
    lambda t, o: f"{t:%Y-%m-%dT%H:%M:%S}.{t.microsecond // 1000:03d}{o}", moments, offsets
)
bad_times = st.sampled_from(
    [
        "",
        "2018-13-01T00:00:00.000+0000",
        "2018-03-12",
        "x",
        "2018-03-12T17:26:04.5-0700",
        "2018-03-12T17:26:04.05-0700",
        "+12018-03-12T17:26:04.0-0700",
    ]
)
times = st.one_of(good_times, good_times, good_times, bad_times)
separators = st.text(alphabet=",", max_size=2)
log_lines = st.builds(
    lambda time, rest, tail: ",".join([time, *rest]) + tail,
    times,
    st.lists(words, min_size=1, max_size=5),
    separators,
)
complete_lines = st.builds(
    lambda time, method, service: f"{time},{method},/u,{service}",
    good_times,
    st.sampled_from(["GA.GET", "GA.POST"]),
    st.sampled_from(["a", "b"]),
)
headers = st.sampled_from(["_time,type,incoming_url,microservice", "x_time"])
inputs = st.lists(st.one_of(complete_lines, log_lines, headers), max_size=40)
few = settings(
    max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)


@few
@given(lines=inputs)
def test_parsing(spark, lines):
    records, malformed = expected(lines)
    frame = lines_from(spark, lines)
    logs = parse_gateway_logs(frame, mode="quarantine")
    got = logs.select(F.unix_millis("timestamp"), "apiUrl", "type", "microservice").collect()
    assert sorted(tuple(row) for row in got) == sorted(records)
    assert sorted(row.value for row in malformed_rows(frame).collect()) == sorted(malformed)


@few
@given(lines=inputs)
def test_reports(spark, lines):
    records, malformed = expected(lines)
    frame = lines_from(spark, [text for text in lines if text not in malformed])
    logs = parse_gateway_logs(frame)
    joint = all_report_lines(logs).collect()
    for report in REPORTS:
        wanted = counted(records, report.keys, report.duration)
        assert sorted(row.value for row in joint if row.report == report.name) == wanted
    report = REPORTS[len(lines) % len(REPORTS)]
    single = sorted(row.value for row in report_lines(logs, report).collect())
    assert single == counted(records, report.keys, report.duration)
