"""Values that fix the input format, the report definitions and the output text."""

from pyspark.sql import types as T

# Results are only right when these are exactly as given.
HEADER_MARKER = "_time"
FIELD_SEPARATOR = ","
TIME_PATTERN = "yyyy-MM-dd'T'HH:mm:ss.SSSZ"
TIME_LENGTH = 28
HEADER_LINE = "_time,type,incoming_url,microservice"
WATERMARK_DELAY = "3500 milliseconds"
RESCAN_INTERVAL = "100 milliseconds"
ONE_MINUTE = "1 minute"
FIVE_MINUTES = "5 minutes"
COUNT_PER_MINUTE = "countOfAPIPerMinute"
COUNT_PER_5_MINUTES = "countOfAPIPer5Minutes"
COUNT_PER_MINUTE_BY_METHOD = "countOfAPIPerMinuteByHttpMethods"
COUNT_PER_5_MINUTES_BY_METHOD = "countOfAPIPer5MinutesByHttpMethods"
LINE_KEY = "Key - "
LINE_KEY_SEPARATOR = ":"
LINE_WINDOW = " Window: "
LINE_COUNT = " -- count: "

# Positions of the fields in an input line.
TIME_FIELD, TYPE_FIELD, URL_FIELD, SERVICE_FIELD = 0, 1, 2, 3
FIELD_COUNT = 4

LINES = T.StructType([T.StructField("value", T.StringType())])

GATEWAY_LOG = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType(), False),
        T.StructField("apiUrl", T.StringType(), False),
        T.StructField("type", T.StringType(), False),
        T.StructField("microservice", T.StringType(), False),
    ]
)
