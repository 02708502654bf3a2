"""cyclewise: Spark-native analytics for system-restart (IPL) cycle durations.

Raw system logs are read as DataFrames, restart messages are recognised in
several record layouts, every log dataset is reduced to ordered phase
boundaries with a skew-safe parallel prefix scan, phase durations are
computed exactly, and rows are routed to done / fail / garbage / last-IPL
tables with idempotent anti-join ingest.  Everything runs as DataFrame /
SQL plans; no Python UDF sits on the data path.
"""

__version__ = "0.1.0"
