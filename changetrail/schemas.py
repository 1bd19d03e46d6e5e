"""Schemas of the log and of the raw event sources."""

from pyspark.sql import types as T

LOG_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("page", T.StringType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("action", T.StringType()),
    T.StructField("ip_address", T.StringType()),
    T.StructField("user_agent", T.StringType()),
    # Wall-clock UTC: a day partition must not depend on the session time zone.
    T.StructField("event_time", T.TimestampNTZType()),
    T.StructField("post", T.StringType()),
    T.StructField("object_data", T.StringType()),
])

STORED_SCHEMA = (T.StructType(list(LOG_SCHEMA.fields))
                 .add("event_date", T.DateType())
                 .add("batch", T.StringType()))

USER_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("username", T.StringType()),
])

# One web request. `params` is the JSON object of all request parameters.
WEB_REQUEST_SCHEMA = T.StructType([
    T.StructField("req_id", T.LongType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_time", T.TimestampNTZType()),
    T.StructField("script_name", T.StringType()),
    T.StructField("has_post", T.BooleanType()),
    T.StructField("xff", T.StringType()),
    T.StructField("http_xff", T.StringType()),
    T.StructField("remote_addr", T.StringType()),
    T.StructField("user_agent", T.StringType()),
    T.StructField("params", T.StringType()),
])

# A web request with the parameters that steer admission already in columns of their own.
REQUEST_SCHEMA = (T.StructType(list(WEB_REQUEST_SCHEMA.fields))
                  .add("req_action", T.StringType())
                  .add("mode_arg", T.StringType())
                  .add("drp_action", T.StringType())
                  .add("purge_continue", T.BooleanType())
                  .add("has_items", T.BooleanType())
                  .add("selected_items", T.ArrayType(T.LongType())))

CLI_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("argv", T.ArrayType(T.StringType())),
    T.StructField("host_ip", T.StringType()),
    T.StructField("os_user", T.StringType()),
    T.StructField("event_time", T.TimestampNTZType()),
])

# One raw record of either kind: a web request, or a command run, which has an ``argv``.
RAW_SCHEMA = (T.StructType(list(WEB_REQUEST_SCHEMA.fields))
              .add("argv", T.ArrayType(T.StringType()))
              .add("host_ip", T.StringType())
              .add("os_user", T.StringType()))
