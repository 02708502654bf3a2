"""Table schemas (T1-T10).  Analytic columns are text, as in the source data
model; typed timestamps are derived where computation needs them.

FIXED VALUES: table and column names must equal the source application's."""

from pyspark.sql import types as T

S = T.StringType()

RESUME_COLUMNS = [
    "sysname", "log_dataset", "pre_ipl", "shutdown_begin", "shutdown_end",
    "ipl_begin", "ipl_end", "post_ipl", "last_ipl", "elapsed_before_shutdown",
    "elapsed_after_shutdown", "elapsed_btn_shut_ipl", "elapsed_ipl",
    "elapsed_after_ipl", "total_elapsed",
]
# T4 / T5: resume CSV and the raw results table, all text
RESUME = T.StructType([T.StructField(c, S, True) for c in RESUME_COLUMNS])

# Detail rows as written to the ';' CSV (9 named columns)
DETAIL_COLUMNS = ["log_name", "log_id", "date", "time", "system", "type",
                  "error", "last_ipl", "msg"]

# Result tables (storage surrogate id omitted)
DONE_COLUMNS = ["sysname", "ipl_date", "log_dataset", "shutdown_begin",
                "shutdown_end", "ipl_begin", "ipl_end", "pre_ipl", "pos_ipl",
                "shutdown_duration", "poweroff_duration", "load_ipl",
                "total_duration"]
FAIL_COLUMNS = ["sysname", "log_dataset", "shutdown_begin", "shutdown_end",
                "ipl_begin", "ipl_end", "pre_ipl", "pos_ipl"]
GARB_COLUMNS = FAIL_COLUMNS
LAST_IPL_COLUMNS = ["sysname", "log_dataset", "last_ipl"]

DONE = T.StructType([T.StructField(c, S, True) for c in DONE_COLUMNS])
FAIL = T.StructType([T.StructField(c, S, True) for c in FAIL_COLUMNS])
GARB = FAIL
LAST_IPL = T.StructType([T.StructField(c, S, True) for c in LAST_IPL_COLUMNS])
