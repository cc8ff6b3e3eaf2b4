"""Queries over change feeds, queues and skewed keys, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyweave.operators import changefeed, chunking, incremental
from keyweave.session import kept_path, table

#: Share of all keyed rows above which a key counts as heavy.
HEAVY_SHARE = 0.01

_FEED = dict(scope=["server_id", "dbm_index"], key="rec_key", seq="seq", op="op_type")


def p1_found(spark, d):
    state = changefeed.apply_changes(table(spark, d, "update_log"), **_FEED)
    return state.select("server_id", "dbm_index", "rec_key", "seq")


def p1_state(spark, d):
    state = changefeed.apply_changes(table(spark, d, "update_log"), fields=["rec_value"], **_FEED)
    return state.select("server_id", "dbm_index", "rec_key", F.coalesce("rec_value", F.lit("")).alias("rec_value"), "seq")


def _unread(spark, d):
    """Takes in what is new in the folder of messages since the application's last run over it, then
    diffs the readers' versions against the stored one."""
    store = incremental.message_store(spark, kept_path(spark, "messages", f"{d}/log_messages.parquet"))
    incremental.take_in(store, f"{d}/log_messages.parquet")
    return incremental.unread_messages(store, table(spark, d, "mq_reader_runs"))


def p3_found(spark, d):
    return _unread(spark, d).select("reader_id", "file_id", "file_offset")


def p3_backlog(spark, d):
    return _unread(spark, d).groupBy("reader_id").agg(
        F.count(F.lit(1)).alias("n_messages"), F.min("ts").alias("oldest_ms"), F.max("ts").alias("newest_ms")
    )


def p5_found(spark, d):
    keyed = table(spark, d, "update_log").filter("rec_key IS NOT NULL")
    return chunking.heavy_keys(keyed, ["rec_key", "dbm_index"], "log_id", HEAVY_SHARE).select("rec_key", "dbm_index")


def p5_profile(spark, d):
    log = table(spark, d, "update_log")
    return chunking.ordered_profile(log, ["rec_key", "dbm_index"], "log_id", "rec_value")


QUERIES = {f.__name__: f for f in (p1_found, p1_state, p3_found, p3_backlog, p5_found, p5_profile)}

_OP = """CASE WHEN upper(trim(op_type, ' \t\r\n')) IN ('SET', 'OP_SET', '1') THEN 'SET'
              WHEN upper(trim(op_type, ' \t\r\n')) IN ('REMOVE', 'OP_REMOVE', '2') THEN 'REMOVE'
              WHEN upper(trim(op_type, ' \t\r\n')) IN ('CLEAR', 'OP_CLEAR', '3') THEN 'CLEAR' END"""

_STATE = f"""
WITH c AS (SELECT DISTINCT server_id, dbm_index, seq, rec_key, rec_value, {_OP} AS op FROM update_log),
     cleared AS (SELECT server_id, dbm_index, max(seq) AS at FROM c WHERE op = 'CLEAR' GROUP BY ALL),
     last AS (SELECT *, row_number() OVER (PARTITION BY server_id, dbm_index, rec_key ORDER BY seq DESC) AS rn
              FROM c WHERE op IN ('SET', 'REMOVE') AND rec_key IS NOT NULL)
SELECT l.server_id, l.dbm_index, l.rec_key, {{value}} l.seq
FROM last l LEFT JOIN cleared x ON x.server_id = l.server_id AND x.dbm_index = l.dbm_index
WHERE l.rn = 1 AND l.op = 'SET' AND l.seq > coalesce(x.at, -1)"""

_UNREAD = """
WITH m AS (SELECT queue_prefix, file_id, file_offset, max(timestamp_ms) AS ts FROM log_messages GROUP BY ALL),
     ok AS (SELECT reader_id, max((run_no, attempt, file_id_, file_offset_)) AS p FROM mq_reader_runs
            WHERE lower(trim(run_status, ' \t\r\n')) = 'ok' AND file_id_ IS NOT NULL GROUP BY reader_id),
     r AS (SELECT x.reader_id, max(x.queue_prefix) AS q, coalesce(max(x.min_timestamp), -1) AS t,
                  coalesce(max(ok.p[3]), -1) AS f, coalesce(max(ok.p[4]), -1) AS o
           FROM mq_reader_runs x LEFT JOIN ok USING (reader_id) GROUP BY x.reader_id),
     u AS (SELECT r.reader_id, m.file_id, m.file_offset, m.ts FROM r JOIN m ON m.queue_prefix = r.q
           WHERE m.ts >= r.t AND (m.file_id > r.f OR (m.file_id = r.f AND m.file_offset >= r.o)))
"""

SQL = {
    "p1_found": _STATE.format(value=""),
    "p1_state": _STATE.format(value="coalesce(l.rec_value, '') AS rec_value,"),
    "p3_found": _UNREAD + "SELECT reader_id, file_id, file_offset FROM u",
    "p3_backlog": _UNREAD
    + "SELECT reader_id, count(*) AS n_messages, min(ts) AS oldest_ms, max(ts) AS newest_ms FROM u GROUP BY reader_id",
    "p5_found": f"""
SELECT rec_key, dbm_index FROM update_log WHERE rec_key IS NOT NULL GROUP BY ALL
HAVING count(*) > {HEAVY_SHARE} * (SELECT count(rec_key) FROM update_log)""",
    "p5_profile": """
WITH x AS (SELECT rec_key, dbm_index, log_id, rec_value, row_number() OVER w AS rn, lag(rec_value) OVER w AS prev
           FROM update_log WINDOW w AS (PARTITION BY rec_key, dbm_index ORDER BY log_id))
SELECT rec_key, dbm_index, count(*) AS n, min(log_id) AS first_order, max(log_id) AS last_order,
       max(struct_pack(o := log_id, v := rec_value)).v AS last_value,
       count(*) FILTER (WHERE rn > 1 AND rec_value IS DISTINCT FROM prev) AS n_switches
FROM x GROUP BY ALL""",
}
