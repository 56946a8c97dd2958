"""

``entry(spark)`` is the smoke check. Each ``queries()[name]`` reads the given tables and is compared
with ``oracle_sql()[name]``. The queries use the ``events`` table, written as gateway log lines, so
that each of them filters and parses real lines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatetally.constants import (
    COUNT_PER_5_MINUTES,
    COUNT_PER_5_MINUTES_BY_METHOD,
    COUNT_PER_MINUTE,
    COUNT_PER_MINUTE_BY_METHOD,
    FIVE_MINUTES,
    ONE_MINUTE,
)
from gatetally.functions import epoch_millis
from gatetally.functions.busiest import busiest_seconds
from gatetally.operators import (
    aggregate_by_window,
    apply_to_windows,
    count_by_window,
    drop_headers,
    malformed_rows,
    parse_gateway_logs,
)
from gatetally.plans import (
    REPORTS,
    all_report_lines,
    report_lines,
    report_named,
    run_batch,
)
from gatetally.session import SETTINGS, STATE_STORE
from gatetally.sinks import start_batches, start_text
from gatetally.sinks.streams import AVAILABLE_NOW
from gatetally.sources import gateway_lines, read_lines, with_header
from gatetally.streaming import run_stream
from gatetally.workspace import shared_folder

Query = Callable[[SparkSession, str], DataFrame]

# The training-data operators are a part that can be taken away; nothing else depends on them.
try:
    import corpus_pipeline
    from gatetally.llm.oracles import ORACLES as LLM_ORACLES
    from gatetally.llm.queries import QUERIES as LLM_QUERIES
except ModuleNotFoundError as error:
    if not (error.name or "").startswith(("corpus_pipeline", "gatetally.llm")):
        raise
    LLM_QUERIES: dict[str, Query] = {}
    LLM_ORACLES: dict[str, str] = {}
else:
    LLM_QUERIES = LLM_QUERIES | {"pipeline": corpus_pipeline.run}
    if corpus_pipeline.ORACLE_SQL is not None:
        LLM_ORACLES = LLM_ORACLES | {"pipeline": corpus_pipeline.ORACLE_SQL}


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_header(gateway_lines(_events(spark, sf_dir)))


def _logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_gateway_logs(_lines(spark, sf_dir))


def _lines_with_malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines with those of error events malformed: without a service, or with tenths of a second.

    The latter are those whose service has an odd number.
    """
    without_service = F.regexp_replace("value", "svc-[0-9]+$", "")
    tenths = F.regexp_replace("value", "(\\.[0-9])[0-9]{2}\\+", "$1+")
    is_error = F.col("value").contains(",GA.ERROR,")
    is_odd = F.col("value").rlike("svc-[0-9]*[13579]$")
    value = F.when(is_error & is_odd, tenths).when(is_error, without_service)
    value = value.otherwise(F.col("value"))
    return _lines(spark, sf_dir).select(value.alias("value"))


def _streaming_session(spark: SparkSession) -> SparkSession:
    """A session whose queries keep their state in one partition per core.

    The state is a row per open window and key, so more partitions would hold next to nothing.
    """
    session = spark.newSession()
    session.conf.set("spark.sql.shuffle.partitions", spark.sparkContext.defaultParallelism)
    return session


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of lines; a stream cannot be joined by a static header line.

    The pattern matches the one table, be it a file or a directory of them: a streamed path has to be a
    directory or a pattern.
    """
    schema = _events(spark, sf_dir).schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    return gateway_lines(events)


def header_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_headers(_lines(spark, sf_dir))


def parsed_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _logs(spark, sf_dir).select(
        epoch_millis(F.col("timestamp")).alias("ts_ms"), "apiUrl", "type", "microservice"
    )


def malformed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return malformed_rows(_lines_with_malformed(spark, sf_dir))


def report(name: str) -> Query:
    """A report over all lines, in batch."""
    return lambda spark, sf_dir: report_lines(_logs(spark, sf_dir), report_named(name))


def report_without_malformed(name: str) -> Query:
    """A report over the readable lines, in batch."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        lines = _lines_with_malformed(spark, sf_dir)
        return report_lines(parse_gateway_logs(lines, mode="quarantine"), report_named(name))

    return run


def report_append(name: str) -> Query:
    """A report over the stream of lines; windows the watermark hasn't passed stay open."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder = shared_folder(spark, "append")
        events = _stream(_streaming_session(spark), sf_dir)
        lines = report_lines(parse_gateway_logs(events), report_named(name))
        start_text(
            lines, f"{folder}/lines", f"{folder}/checkpoint", AVAILABLE_NOW
        ).awaitTermination()
        return spark.read.text(f"{folder}/lines")

    return run


def window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per service, method and minute as columns."""
    counts = count_by_window(_logs(spark, sf_dir), ONE_MINUTE, ["microservice", "type"])
    start, end = epoch_millis(F.col("window_start")), epoch_millis(F.col("window_end"))
    return counts.select("microservice", "type", start.alias("start_ms"), end.alias("end_ms"), "n")


def calls_per_minute_own_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream's micro-batches handed to a function of ours, which writes a table of them."""
    folder = shared_folder(spark, "own_sink")
    events = _stream(_streaming_session(spark), sf_dir)
    lines = report_lines(parse_gateway_logs(events), report_named(COUNT_PER_MINUTE))

    def write(batch: DataFrame, number: int) -> None:
        # A repeated batch replaces its first try.
        batch.write.mode("overwrite").parquet(f"{folder}/lines/batch={number}")

    start_batches(lines, write, f"{folder}/checkpoint", AVAILABLE_NOW).awaitTermination()
    return spark.read.schema("value string").parquet(f"{folder}/lines").select("value")


def watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The watermark after the stream has been read."""
    folder = shared_folder(spark, "watermark")
    events = _stream(_streaming_session(spark), sf_dir)
    lines = report_lines(parse_gateway_logs(events), report_named(COUNT_PER_5_MINUTES))
    query = start_text(lines, f"{folder}/lines", f"{folder}/checkpoint", AVAILABLE_NOW)
    query.awaitTermination()
    # Without any record there is none: Spark leaves it out or says 0, where it starts.
    progress = query.lastProgress
    reached = progress["eventTime"].get("watermark") if progress else None
    watermark_ms = epoch_millis(F.to_timestamp(F.lit(reached))).alias("watermark_ms")
    return spark.range(1).select(watermark_ms).filter("watermark_ms <> 0")


def late_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls per minute when all error events arrive after all others have been read."""
    folder = shared_folder(spark, "late")
    report = report_named(COUNT_PER_MINUTE)
    lines = _lines(spark, sf_dir)
    is_error = F.col("value").contains(",GA.ERROR,")
    for arriving in (lines.filter(~is_error), lines.filter(is_error)):
        arriving.write.mode("append").text(f"{folder}/logs")
        read = read_lines(_streaming_session(spark), f"{folder}/logs", streaming=True)
        counts = report_lines(parse_gateway_logs(read), report)
        start_text(
            counts, f"{folder}/lines", f"{folder}/checkpoint", AVAILABLE_NOW
        ).awaitTermination()
    return spark.read.text(f"{folder}/lines")


def all_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_report_lines(_logs(spark, sf_dir))


def _written_reports(spark: SparkSession, output: str) -> DataFrame:
    written = [
        spark.read.text(f"{output}/{r.name}").select(F.lit(r.name).alias("report"), "value")
        for r in REPORTS
    ]
    result = written[0]
    for lines in written[1:]:
        result = result.unionAll(lines)
    return result


def batch_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log files in, four report directories out."""
    folder = shared_folder(spark, "batch_job")
    _lines(spark, sf_dir).write.text(f"{folder}/logs")
    run_batch(spark, f"{folder}/logs", f"{folder}/reports")
    return _written_reports(spark, f"{folder}/reports")


def batch_job_with_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch job over lines of which some are malformed; those as a fifth output."""
    folder = shared_folder(spark, "batch_job")
    _lines_with_malformed(spark, sf_dir).write.text(f"{folder}/logs")
    bad = f"{folder}/malformed"
    run_batch(spark, f"{folder}/logs", f"{folder}/reports", bad)
    malformed = spark.read.text(bad).select(F.lit("malformed").alias("report"), "value")
    return _written_reports(spark, f"{folder}/reports").unionAll(malformed)


def stream_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log files in, four reports out, by one streaming query."""
    folder = shared_folder(spark, "stream_job")
    _lines(spark, sf_dir).write.text(f"{folder}/logs")
    run_stream(
        _streaming_session(spark),
        f"{folder}/logs",
        f"{folder}/reports",
        f"{folder}/checkpoints",
        trigger=AVAILABLE_NOW,
    )
    written = spark.read.schema("value string, report string").text(f"{folder}/reports")
    return written.select("report", "value")


def service_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several aggregates per service and 5 minutes: calls, methods, first and last call."""
    millis = epoch_millis(F.col("timestamp"))
    activity = aggregate_by_window(
        _logs(spark, sf_dir),
        FIVE_MINUTES,
        ["microservice"],
        F.count(F.lit(1)).alias("calls"),
        F.countDistinct("type").alias("methods"),
        F.min(millis).alias("first_ms"),
        F.max(millis).alias("last_ms"),
    )
    end = epoch_millis(F.col("window_end")).alias("end_ms")
    return activity.select("microservice", end, "calls", "methods", "first_ms", "last_ms")


def _busiest(logs: DataFrame) -> DataFrame:
    """The seconds with the most calls of each service and minute: a function of ours over whole windows."""
    logs = logs.withColumn("millis", epoch_millis(F.col("timestamp")))
    found = apply_to_windows(logs, ONE_MINUTE, ["microservice"], busiest_seconds(60), ["millis"])
    return found.select("microservice", epoch_millis(F.col("window_end")).alias("end_ms"), "second", "calls")


def busiest_seconds_by_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _busiest(_logs(spark, sf_dir))


def busiest_seconds_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same on a stream, in state that the function builds up; finished windows only."""
    folder = shared_folder(spark, "busiest")
    session = _streaming_session(spark)
    # Arbitrary state needs this store, whatever the session that is given has.
    session.conf.set(STATE_STORE, SETTINGS[STATE_STORE])
    found = _busiest(parse_gateway_logs(_stream(session, sf_dir)))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    start_batches(found, write, f"{folder}/checkpoint", AVAILABLE_NOW).awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{folder}/rows").select(found.columns)


def entry(spark: SparkSession) -> DataFrame:
    """All four reports on /root/testdata/sf0.001."""
    return all_reports(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Query]:
    return {
        "header_filter": header_filter,
        "parse_gateway_logs": parsed_logs,
        "malformed_lines": malformed_lines,
        "calls_per_minute": report(COUNT_PER_MINUTE),
        "calls_per_5_minutes": report(COUNT_PER_5_MINUTES),
        "calls_per_minute_by_method": report(COUNT_PER_MINUTE_BY_METHOD),
        "calls_per_5_minutes_by_method": report(COUNT_PER_5_MINUTES_BY_METHOD),
        "calls_per_minute_without_malformed": report_without_malformed(COUNT_PER_MINUTE),
        "window_counts": window_counts,
        "all_reports": all_reports,
        "calls_per_minute_append": report_append(COUNT_PER_MINUTE),
        "calls_per_5_minutes_append": report_append(COUNT_PER_5_MINUTES),
        "calls_per_minute_by_method_append": report_append(COUNT_PER_MINUTE_BY_METHOD),
        "calls_per_5_minutes_by_method_append": report_append(COUNT_PER_5_MINUTES_BY_METHOD),
        "calls_per_minute_own_sink": calls_per_minute_own_sink,
        "watermark": watermark,
        "late_records": late_records,
        "batch_job": batch_job,
        "batch_job_with_quarantine": batch_job_with_quarantine,
        "stream_job": stream_job,
        "service_activity": service_activity,
        "busiest_seconds": busiest_seconds_by_minute,
        "busiest_seconds_append": busiest_seconds_append,
        **LLM_QUERIES,
    }


# The log time is cut to milliseconds, so epoch_us(ts) // 1000 is used: epoch_ms(ts) rounds.
_LOGS = """WITH logs AS (
  SELECT epoch_us(ts) // 1000 AS ms, '/users/' || user_id AS "apiUrl",
         'GA.' || upper(event_type) AS type, 'svc-' || (user_id % 8) AS microservice
  FROM events)
"""

_LINE = (
    "strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || '+0000,GA.' || upper(event_type) "
    "|| ',/users/' || user_id || ',' || {service}"
)

_BY_SERVICE = ("microservice", "microservice")
_BY_METHOD = ("microservice || ':' || type", "microservice, type")


def _report_sql(
    keys: tuple[str, str], millis: int, where: str = "", append: bool = False, name: str = ""
) -> str:
    text, columns = keys
    end = f"(ms // {millis} + 1) * {millis}"
    return (
        "SELECT "
        + (f"'{name}' AS report, " if name else "")
        + f"'Key - ' || {text} || ' Window: ' || ({end}) || ' -- count: ' || count(*) AS value\n"
        + f"FROM logs {where} GROUP BY {columns}, ms // {millis}"
        + (f"\nHAVING {end} <= (SELECT max(ms) - 3500 FROM logs)" if append else "")
    )


def _all_reports_sql(append: bool = False, where: str = "") -> str:
    each = (
        (_BY_SERVICE, 60000, COUNT_PER_MINUTE),
        (_BY_SERVICE, 300000, COUNT_PER_5_MINUTES),
        (_BY_METHOD, 60000, COUNT_PER_MINUTE_BY_METHOD),
        (_BY_METHOD, 300000, COUNT_PER_5_MINUTES_BY_METHOD),
    )
    return _LOGS + "\nUNION ALL\n".join(
        _report_sql(keys, millis, where, append, name) for keys, millis, name in each
    )


def _busiest_sql(finished: str = "") -> str:
    return (
        _LOGS
        + """, counts AS (
  SELECT microservice, ms // 60000 AS minute, (ms // 1000 % 60)::INT AS second, count(*) AS calls
  FROM logs GROUP BY ALL),
ranked AS (
  SELECT *, max(calls) OVER (PARTITION BY microservice, minute) AS most FROM counts)
SELECT microservice, (minute + 1) * 60000 AS end_ms, second, calls FROM ranked WHERE calls = most """
        + finished
    )


def oracle_sql() -> dict[str, str]:
    whole_line = _LINE.format(service="'svc-' || (user_id % 8)")
    short_line = _LINE.format(service="''")
    tenths = f"regexp_replace({whole_line}, '(\\.[0-9])[0-9][0-9]\\+', '\\1+')"
    malformed = f"CASE WHEN user_id % 2 = 1 THEN {tenths} ELSE {short_line} END"
    return {
        "header_filter": f"SELECT {whole_line} AS value FROM events",
        "parse_gateway_logs": _LOGS + 'SELECT ms AS ts_ms, "apiUrl", type, microservice FROM logs',
        "malformed_lines": f"SELECT {malformed} AS value FROM events WHERE event_type = 'error'",
        "calls_per_minute": _LOGS + _report_sql(_BY_SERVICE, 60000),
        "calls_per_5_minutes": _LOGS + _report_sql(_BY_SERVICE, 300000),
        "calls_per_minute_by_method": _LOGS + _report_sql(_BY_METHOD, 60000),
        "calls_per_5_minutes_by_method": _LOGS + _report_sql(_BY_METHOD, 300000),
        "calls_per_minute_without_malformed": _LOGS
        + _report_sql(_BY_SERVICE, 60000, where="WHERE type <> 'GA.ERROR'"),
        "window_counts": _LOGS
        + "SELECT microservice, type, ms // 60000 * 60000 AS start_ms, "
        "(ms // 60000 + 1) * 60000 AS end_ms, count(*) AS n "
        "FROM logs GROUP BY microservice, type, ms // 60000",
        "all_reports": _all_reports_sql(),
        "calls_per_minute_append": _LOGS + _report_sql(_BY_SERVICE, 60000, append=True),
        "calls_per_5_minutes_append": _LOGS + _report_sql(_BY_SERVICE, 300000, append=True),
        "calls_per_minute_by_method_append": _LOGS + _report_sql(_BY_METHOD, 60000, append=True),
        "calls_per_5_minutes_by_method_append": _LOGS
        + _report_sql(_BY_METHOD, 300000, append=True),
        "calls_per_minute_own_sink": _LOGS + _report_sql(_BY_SERVICE, 60000, append=True),
        "watermark": _LOGS + "SELECT max(ms) - 3500 AS watermark_ms FROM logs",
        "late_records": _LOGS
        + _report_sql(
            _BY_SERVICE,
            60000,
            where="WHERE type <> 'GA.ERROR' OR (ms // 60000 + 1) * 60000 > "
            "(SELECT max(ms) - 3500 FROM logs WHERE type <> 'GA.ERROR')",
            append=True,
        ),
        "batch_job": _all_reports_sql(),
        "stream_job": _all_reports_sql(append=True),
        "batch_job_with_quarantine": _all_reports_sql(where="WHERE type <> 'GA.ERROR'")
        + f"\nUNION ALL SELECT 'malformed' AS report, {malformed} AS value "
        "FROM events WHERE event_type = 'error'",
        "service_activity": _LOGS
        + "SELECT microservice, (ms // 300000 + 1) * 300000 AS end_ms, count(*) AS calls, "
        "count(DISTINCT type) AS methods, min(ms) AS first_ms, max(ms) AS last_ms "
        "FROM logs GROUP BY microservice, ms // 300000",
        "busiest_seconds": _busiest_sql(),
        "busiest_seconds_append": _busiest_sql("AND (minute + 1) * 60000 <= (SELECT max(ms) - 3500 FROM logs)"),
        **LLM_ORACLES,
    }
