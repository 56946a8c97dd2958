"""The user's own functions over whole windows: batch, stream, late records, restarts, hot keys."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from fixtures import line
from gatetally.functions.busiest import busiest_seconds
from gatetally.operators import apply_to_windows, parse_gateway_logs
from gatetally.sinks.streams import AVAILABLE_NOW, start_batches
from gatetally.sources import lines_from, read_lines
from test_streaming import add_file


def busiest(logs, duration="1 minute", seconds=60):
    logs = logs.withColumn("millis", F.unix_millis("timestamp"))
    found = apply_to_windows(logs, duration, ["microservice"], busiest_seconds(seconds), ["millis"])
    end = F.unix_millis("window_end").alias("end_ms")
    return found.select("microservice", end, "second", "calls")


def plain(lines, seconds=60):
    counts = Counter()
    for text in lines:
        clock, _, _, service = text.split(",")
        h, m, s = clock[11:23].split(":")
        second = int(h) * 3600 + int(m) * 60 + int(float(s))
        counts[service, second // seconds, second % seconds] += 1
    most = Counter()
    for (service, window, _), n in counts.items():
        most[service, window] = max(most[service, window], n)
    # 2018-03-12T00:00:00-0700 and the end of the window in it.
    start = 1520838000000
    return sorted(
        (service, start + (window + 1) * seconds * 1000, second, n)
        for (service, window, second), n in counts.items()
        if n == most[service, window]
    )


CLOCKS = ["17:26:04", "17:26:04.900", "17:26:05", "17:26:59.999", "17:27:00", "17:27:30", "17:29:42", "17:29:42.001"]


def test_batch(spark):
    lines = [line(clock, service=s) for clock in CLOCKS for s in ("a", "b")] + [line("17:26:05", service="a")]
    logs = parse_gateway_logs(lines_from(spark, lines))
    assert sorted(map(tuple, busiest(logs).collect())) == plain(lines)
    assert sorted(map(tuple, busiest(logs, "5 minutes", 300).collect())) == plain(lines, 300)


def test_null_key_and_no_rows(spark):
    logs = parse_gateway_logs(lines_from(spark, [line("17:26:04", service="a"), line("17:26:04", service="b")]))
    logs = logs.withColumn("microservice", F.when(F.col("microservice") == "a", "a"))
    assert {r.microservice for r in busiest(logs).collect()} == {None, "a"}
    assert busiest(logs.limit(0)).collect() == []


def test_keys_have_to_be_text(spark):
    logs = parse_gateway_logs(lines_from(spark, [line("17:26:04")])).withColumn("microservice", F.lit(1))
    with pytest.raises(ValueError, match="have to be text"):
        busiest(logs)


def run(spark, folder, **options):
    """Run over what is there; all rows written so far."""
    lines = read_lines(spark, f"{folder}/in", streaming=True, **options)

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{folder}/out/{number}")

    query = start_batches(busiest(parse_gateway_logs(lines)), write, f"{folder}/c", AVAILABLE_NOW)
    query.awaitTermination()
    return sorted(map(tuple, spark.read.option("recursiveFileLookup", True).parquet(f"{folder}/out").collect())), query


def test_stream_with_restart_and_late_records(spark, folder):
    first = ["17:26:04", "17:26:05", "17:26:05.500", "17:27:02"]
    for number, clock in enumerate(first):
        add_file(f"{folder}/in", number, [line(clock), line(clock, service="other")])
    found, _ = run(spark, folder, maxFilesPerTrigger=1)
    assert found == []  # 17:27:02 less 3.5 seconds isn't the end of the first window

    # The open windows' states are there after a restart; 17:26:06 is in time, 17:26:07 is not.
    for number, clock in enumerate(["17:26:06", "17:30:00", "17:26:07", "17:31:00"], len(first)):
        add_file(f"{folder}/in", number, [line(clock)])
    found, query = run(spark, folder, maxFilesPerTrigger=1)
    counted = [line(c, service=s) for c in first for s in ("API-Gateway", "other")]
    assert found == plain(counted)
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] > 0


def test_hot_key_sends_a_state_per_part(spark):
    """A service with nearly all rows: what is shuffled are states, one per window, key and batch of rows."""
    times = "concat('2018-03-12T17:26:', lpad(cast(id % 7 as string), 2, '0'), '.000-0700,GA.GET,/,'"
    texts = spark.range(20_000, numPartitions=4).selectExpr(f"{times}, if(id % 100 = 0, 'rare', 'hot')) as value")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        found = busiest(parse_gateway_logs(texts))
        rows = {(r.microservice, r.second): r.calls for r in found.collect()}
        counts = Counter((("rare" if i % 100 == 0 else "hot"), i % 7) for i in range(20_000))
        for service in ("rare", "hot"):
            most = max(n for (s, _), n in counts.items() if s == service)
            assert {k: n for k, n in rows.items() if k[0] == service} == {
                k: n for k, n in counts.items() if k[0] == service and n == most
            }
        node, sent = found._jdf.queryExecution().executedPlan(), None
        while sent is None:
            if node.nodeName() == "Exchange":
                sent = node.metrics().apply("shuffleRecordsWritten").value()
            node = node.children().apply(0)
        assert sent == 4 * 2
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
