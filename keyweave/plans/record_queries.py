"""Queries of the record, scan, search, reduce, index, log and cache operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from keyweave.functions import codecs, hashes, strings, times
from keyweave.model import sort_keys
from keyweave.operators import cache, changelog, index, point, reduce, scan, search, shard
from keyweave.plans import byte_sql
from keyweave.session import spread, table
from keyweave.sources import records

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


def _orders(spark, d):
    return point.kv(table(spark, d, "orders"), "o_orderkey", "o_orderstatus")


def _customers(spark, d):
    return point.kv(table(spark, d, "customer"), "c_custkey", "c_mktsegment")


def _parts(spark, d):
    return table(spark, d, "part").select(F.col("p_name").alias("key")).distinct()


def _texts(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text"))


def _keys(spark, d, name="lineitem", col="l_orderkey"):
    return table(spark, d, name).select(F.col(col).alias("key"))


# Records


@query("SELECT DISTINCT o_orderkey AS key, o_orderstatus AS value FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def get_multi(spark, d):
    return point.get_multi(_orders(spark, d), _keys(spark, d))


@query("""SELECT k AS key, o_orderstatus AS value, o_orderkey IS NOT NULL AS found,
  CASE WHEN o_orderkey IS NULL THEN 'NOT_FOUND_ERROR' ELSE 'SUCCESS' END AS status
  FROM (SELECT DISTINCT event_id * 7 AS k FROM events) LEFT JOIN orders ON o_orderkey = k""")
def get_missing(spark, d):
    keys = table(spark, d, "events").select((F.col("event_id") * 7).alias("key"))
    return point.get_multi_status(_orders(spark, d), keys)


@query("""SELECT k AS key, CASE WHEN o_orderkey IS NULL THEN '-' ELSE o_orderstatus END AS value
  FROM (SELECT DISTINCT event_id * 7 AS k FROM events) LEFT JOIN orders ON o_orderkey = k""")
def get_simple(spark, d):
    keys = table(spark, d, "events").select((F.col("event_id") * 7).alias("key"))
    return point.get_simple(_orders(spark, d), keys, "-")


def _event_sets(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("event_type").alias("value"))


@query("""WITH n AS (SELECT user_id AS key, arg_max(event_type, event_id) AS value FROM events WHERE user_id IS NOT NULL GROUP BY 1)
  SELECT c_custkey AS key, c_mktsegment AS value FROM customer WHERE c_custkey NOT IN (SELECT key FROM n) UNION ALL SELECT * FROM n""")
def set_overwrite(spark, d):
    return point.set_multi(_customers(spark, d), _event_sets(spark, d))


@query("""WITH n AS (SELECT user_id AS key, arg_min(event_type, event_id) AS value FROM events WHERE user_id IS NOT NULL GROUP BY 1)
  SELECT c_custkey AS key, c_mktsegment AS value FROM customer UNION ALL SELECT * FROM n WHERE key NOT IN (SELECT c_custkey FROM customer)""")
def set_if_absent(spark, d):
    return point.set_multi(_customers(spark, d), _event_sets(spark, d), overwrite=False)


@query("""SELECT e.user_id AS key, e.event_id AS seq, c.c_custkey IS NOT NULL OR e.rn > 1 AS existed, c.c_mktsegment AS old_value,
  CASE WHEN c.c_custkey IS NOT NULL OR e.rn > 1 THEN 'DUPLICATION_ERROR' ELSE 'SUCCESS' END AS status
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) e LEFT JOIN customer c ON c_custkey = user_id""")
def set_status(spark, d):
    return point.set_status(_customers(spark, d), _event_sets(spark, d), overwrite=False)


@query("""SELECT o_orderkey AS key, o_orderstatus AS value FROM orders
  WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem UNION ALL SELECT event_id * 7 FROM events)""")
def remove_multi(spark, d):
    """Every order key of lineitem, and keys from events of which most are missing."""
    more = table(spark, d, "events").select((F.col("event_id") * 7).alias("key"))
    return point.remove_multi(_orders(spark, d), _keys(spark, d).unionByName(more))


@query("""SELECT k AS key, o_orderstatus AS old_value, CASE WHEN o_orderkey IS NULL THEN 'NOT_FOUND_ERROR' ELSE 'SUCCESS' END AS status
  FROM (SELECT DISTINCT event_id * 7 AS k FROM events) LEFT JOIN orders ON o_orderkey = k""")
def remove_status(spark, d):
    keys = table(spark, d, "events").select((F.col("event_id") * 7).alias("key"))
    return point.remove_status(_orders(spark, d), keys)


@query("""SELECT coalesce(c_custkey, k) AS key, concat_ws(',', c_mktsegment, v) AS value FROM customer
  FULL JOIN (SELECT user_id AS k, string_agg(event_type, ',' ORDER BY event_id) AS v FROM events GROUP BY 1) ON c_custkey = k""")
def append_multi(spark, d):
    return point.append_multi(_customers(spark, d), _event_sets(spark, d), ",")


@query("""SELECT coalesce(c_custkey, k) AS key, CAST(CASE WHEN k IS NULL THEN c_nationkey ELSE coalesce(c_nationkey, 100) + v END AS BIGINT) AS value
  FROM customer FULL JOIN (SELECT user_id AS k, count(*) AS v FROM events GROUP BY 1) ON c_custkey = k""")
def increment(spark, d):
    ops = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.lit(1).alias("value"))
    return point.increment_multi(point.kv(table(spark, d, "customer"), "c_custkey", "c_nationkey"), ops, 100)


@query("""SELECT coalesce(c_custkey, k) AS key, printf('%016X', CAST(CASE WHEN k IS NULL THEN c_nationkey ELSE coalesce(c_nationkey, 100) + v END AS BIGINT)) AS value
  FROM customer FULL JOIN (SELECT user_id AS k, count(*) AS v FROM events GROUP BY 1) ON c_custkey = k""")
def increment_bytes(spark, d):
    ops = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.lit(1).alias("value"))
    base = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), codecs.int_to_big_endian(F.col("c_nationkey")).alias("value"))
    return point.increment_bytes(base, ops, 100).select("key", F.hex("value").alias("value"))


def _exchanges(spark, d):
    return table(spark, d, "orders").select(
        F.when(F.col("o_orderkey") % 5 == 0, -F.col("o_orderkey") - 1).otherwise(F.col("o_orderkey")).alias("key"),
        F.when(F.col("o_orderkey") % 5 == 0, "absent").when(F.col("o_orderkey") % 5 == 1, "any").otherwise("value").alias("expected_kind"),
        F.lit("O").alias("expected"),
        F.when(F.col("o_orderkey") % 3 == 0, "remove").when(F.col("o_orderkey") % 3 == 1, "noop").otherwise("value").alias("desired_kind"),
        F.lit("X").alias("desired"),
    )


_EXCHANGE = """
WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_orderkey % 5 = 1 OR (o_orderkey % 5 > 1 AND o_orderstatus = 'O') AS hit FROM orders WHERE o_orderkey % 5 <> 0)
"""


@query(_EXCHANGE + """SELECT k AS key, CASE WHEN hit AND k % 3 = 2 THEN 'X' ELSE s END AS value FROM a WHERE NOT (hit AND k % 3 = 0)
  UNION ALL SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 5 = 0
  UNION ALL SELECT -o_orderkey - 1, 'X' FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey % 3 = 2""")
def compare_exchange(spark, d):
    return point.compare_exchange(_orders(spark, d), _exchanges(spark, d))


@query(_EXCHANGE + """SELECT k AS key, true AS found, s AS actual, CASE WHEN hit THEN 'SUCCESS' ELSE 'INFEASIBLE_ERROR' END AS status FROM a
  UNION ALL SELECT -o_orderkey - 1, false, NULL, 'SUCCESS' FROM orders WHERE o_orderkey % 5 = 0""")
def compare_exchange_status(spark, d):
    return point.compare_exchange_status(_orders(spark, d), _exchanges(spark, d))


@query("SELECT o_orderkey AS key, o_orderstatus AS value FROM orders")
def compare_exchange_multi_fails(spark, d):
    return point.compare_exchange_multi(_orders(spark, d), _exchanges(spark, d))


@query("SELECT o_orderkey AS key, CASE WHEN o_orderstatus = 'O' THEN 'X' ELSE o_orderstatus END AS value FROM orders")
def compare_exchange_multi(spark, d):
    ops = table(spark, d, "orders").filter("o_orderstatus = 'O'").select(
        F.col("o_orderkey").alias("key"), F.lit("value").alias("expected_kind"), F.lit("O").alias("expected"), F.lit("value").alias("desired_kind"), F.lit("X").alias("desired")
    )
    return point.compare_exchange_multi(_orders(spark, d), ops)


@query("""WITH o AS (SELECT user_id AS k, event_id AS q, event_type AS v, ['set', 'append', 'add', 'remove', 'append'][event_id % 5 + 1] AS op FROM events),
  last AS (SELECT k, max(q) FILTER (WHERE op IN ('set', 'remove')) AS q FROM o GROUP BY k),
  head AS (SELECT l.k, CASE WHEN l.q IS NULL THEN c.c_custkey IS NOT NULL ELSE s.op = 'set' END AS there,
             CASE WHEN l.q IS NULL THEN c.c_mktsegment WHEN s.op = 'set' THEN s.v END AS v, coalesce(l.q, -1) AS q
           FROM last l LEFT JOIN o s ON s.k = l.k AND s.q = l.q LEFT JOIN customer c ON c.c_custkey = l.k),
  tail AS (SELECT h.k, h.there, h.v AS hv, o.q, o.v, o.op, row_number() OVER (PARTITION BY h.k ORDER BY o.q) AS rn
           FROM head h JOIN o ON o.k = h.k AND o.q > h.q),
  parts AS (SELECT k, there, v, -1 AS q FROM head WHERE there UNION ALL
            SELECT k, there, v, q FROM tail WHERE op = 'append' OR (NOT there AND rn = 1))
  SELECT k AS key, string_agg(v, '|' ORDER BY q) AS value FROM parts GROUP BY k
  UNION ALL SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT k FROM o)""")
def process_multi(spark, d):
    kinds = F.array(*[F.lit(x) for x in ("set", "append", "add", "remove", "append")])
    ops = _event_sets(spark, d).withColumn("op", kinds[(F.col("seq") % 5).cast("int")])
    return point.process_multi(_customers(spark, d), ops, "|")


@query("SELECT c_custkey AS key, lower(c_mktsegment) AS value FROM customer WHERE c_acctbal >= 0")
def process_each(spark, d):
    base = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("value"), "c_acctbal")
    return point.process_each(base, F.lower("value"), F.col("c_acctbal") >= 0)


@query("SELECT c_custkey AS key, upper(substr(c_mktsegment, 1, 3)) AS value FROM customer")
def process_user(spark, d):
    return point.process(_customers(spark, d), lambda pdf: pdf.assign(value=pdf.value.str[:3].str.upper()))


_REKEY_LOG = """WITH base AS (SELECT log_id AS k, op_type AS v FROM update_log),
  ops AS (SELECT msg_id * 17 AS a, CASE WHEN msg_id % 4 = 0 THEN msg_id * 17 + 1 ELSE -msg_id END AS b FROM log_messages),
  st AS (SELECT a, b, CASE WHEN a NOT IN (SELECT k FROM base) THEN 'NOT_FOUND_ERROR' WHEN b IN (SELECT k FROM base) THEN 'DUPLICATION_ERROR' ELSE 'SUCCESS' END AS s FROM ops) """


def _log_rekeys(spark, d):
    """One operation per message: most to free keys, a quarter to taken ones, the last of missing keys."""
    n = F.col("msg_id")
    ops = table(spark, d, "log_messages").select((n * 17).alias("old_key"), F.when(n % 4 == 0, n * 17 + 1).otherwise(-n).alias("new_key"))
    return point.kv(table(spark, d, "update_log"), "log_id", "op_type"), ops


@query(_REKEY_LOG + """SELECT k AS key, v AS value FROM base WHERE k NOT IN (SELECT a FROM st WHERE s = 'SUCCESS')
  UNION ALL SELECT b, v FROM st JOIN base ON a = k WHERE s = 'SUCCESS'""")
def rekey(spark, d):
    return point.rekey(*_log_rekeys(spark, d), overwrite=False)


@query(_REKEY_LOG + "SELECT a AS old_key, b AS new_key, s AS status FROM st")
def rekey_status(spark, d):
    return point.rekey_status(*_log_rekeys(spark, d), overwrite=False)


@query("SELECT c_custkey AS key, c_mktsegment AS value FROM customer ORDER BY c_custkey LIMIT 3")
def pop_first(spark, d):
    return point.pop_first(_customers(spark, d), 3)[0]


@query("SELECT c_custkey AS key, c_mktsegment AS value FROM customer ORDER BY c_custkey OFFSET 3")
def pop_first_rest(spark, d):
    return point.pop_first(_customers(spark, d), 3)[1]


@query("""WITH n AS (SELECT epoch_us(date_trunc('day', ts)) * 100 AS n, event_id, event_type FROM events),
  i AS (SELECT *, row_number() OVER (ORDER BY n, event_id) AS i FROM n)
  SELECT printf('%016X', CAST(i + max(n - i) OVER (ORDER BY n, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT)) AS key, event_type AS value FROM i""")
def push_last(spark, d):
    ev = table(spark, d, "events")
    pushes = ev.select((F.unix_micros(F.date_trunc("day", "ts").cast("timestamp")) / 1e6).alias("wtime"), F.col("event_id").alias("seq"), F.col("event_type").alias("value"))
    empty = spark.createDataFrame([], "key binary, value string")
    return point.push_last(empty, pushes).select(F.hex("key").alias("key"), "value")


@query("SELECT count(*) AS count FROM orders")
def count(spark, d):
    return point.count(_orders(spark, d))


@query("SELECT c_custkey AS key, c_mktsegment AS value FROM customer ORDER BY c_custkey LIMIT 1 OFFSET 41")
def get_by_index(spark, d):
    return point.get_by_index(_customers(spark, d), 41)


@query("SELECT log_id AS key, op_type AS value FROM update_log ORDER BY log_id LIMIT 1 OFFSET 12345")
def get_by_far_index(spark, d):
    """Beyond the bounded top-k; a table with fewer records has none."""
    return point.get_by_index(point.kv(table(spark, d, "update_log"), "log_id", "op_type"), 12345)


@query("""SELECT unnest(['num_records', 'key_bytes', 'value_bytes']) AS name, unnest([count(*), CAST(sum(strlen(n_name)) AS BIGINT), CAST(sum(strlen(CAST(n_regionkey AS VARCHAR))) AS BIGINT)]) AS value FROM nation""")
def inspect(spark, d):
    return point.inspect(point.kv(table(spark, d, "nation"), "n_name", "n_regionkey"))


@query("""SELECT k AS key, arg_max(v, r) AS value FROM (SELECT o_orderkey AS k, o_orderstatus AS v, 0 AS r FROM orders
  UNION ALL SELECT o_orderkey, o_orderpriority, 1 FROM orders WHERE o_totalprice > 200000 UNION ALL SELECT c_custkey, c_name, 2 FROM customer) GROUP BY k""")
def export_merge(spark, d):
    o = table(spark, d, "orders")
    tables = [_orders(spark, d), point.kv(o.filter("o_totalprice > 200000"), "o_orderkey", "o_orderpriority"), point.kv(table(spark, d, "customer"), "c_custkey", "c_name")]
    return point.export_merge(tables)


@query("""SELECT count(*) AS num_records, count(*) - count(user_id) AS null_keys,
  (SELECT count(*) FROM (SELECT user_id FROM events WHERE user_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1)) AS repeated_keys FROM events""")
def validate(spark, d):
    return point.validate(point.kv(table(spark, d, "events"), "user_id", "event_type"))


@query("""SELECT n_name || chr(9) || CAST(n_regionkey AS VARCHAR) AS value FROM nation""")
def tsv_export(spark, d):
    return records.tsv_lines(point.kv(table(spark, d, "nation"), "n_name", "n_regionkey"))


@query("""SELECT split_part(v, chr(9), 1) AS key, substr(v, strpos(v, chr(9)) + 1) AS value
  FROM (SELECT value_ptr AS v FROM tiny_records) WHERE contains(v, chr(9))""")
def tsv_import(spark, d):
    return records.parse_tsv(table(spark, d, "tiny_records").select(F.col("value_ptr").alias("value")))


# Ranges and search


def _ranges():
    for mode, cond, direction in (("upper", ">", "ASC"), ("upperinc", ">=", "ASC"), ("lower", "<", "DESC"), ("lowerinc", "<=", "DESC")):

        def run(spark, d, mode=mode):
            return scan.range_scan(_parts(spark, d), mode, "m", 20)

        QUERIES[f"range_{mode}"] = run
        SQL[f"range_{mode}"] = f"""SELECT key, CAST(row_number() OVER (ORDER BY key {direction}) AS INTEGER) AS rank FROM
            (SELECT DISTINCT p_name AS key FROM part WHERE p_name {cond} 'm') ORDER BY rank LIMIT 20"""


_ranges()


@query("SELECT key FROM (SELECT DISTINCT p_name AS key FROM part) ORDER BY key LIMIT 5")
def scan_first(spark, d):
    return scan.first(_parts(spark, d), 5)


@query("SELECT key FROM (SELECT DISTINCT p_name AS key FROM part) ORDER BY key DESC LIMIT 5")
def scan_last(spark, d):
    return scan.last(_parts(spark, d), 5)


@query("SELECT key, lag(key) OVER (ORDER BY key) AS previous, lead(key) OVER (ORDER BY key) AS next FROM (SELECT DISTINCT p_name AS key FROM part)")
def scan_neighbours(spark, d):
    return scan.neighbours(_parts(spark, d))


@query("SELECT key, CAST(row_number() OVER (ORDER BY key) AS INTEGER) AS rank FROM (SELECT DISTINCT p_name AS key FROM part WHERE p_name >= 'b') ORDER BY rank LIMIT 4")
def scan_jump(spark, d):
    return scan.jump(_parts(spark, d), "b", 4)


_WORD = "regexp_matches({c}, '(^|[^0-9A-Za-z])({p})([^0-9A-Za-z]|$)')"
_SEARCHES = {
    "contain": ("road", "contains(key, 'road')"),
    "begin": ("The ", "starts_with(key, 'The ')"),
    "end": ("you.", "suffix(key, 'you.')"),
    "regex": ("[Bb]ridge[s]? .* river", "regexp_matches(key, '[Bb]ridge[s]? .* river')"),
    "containcase": ("MINISTRY", "contains(translate(key, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'ministry')"),
    "containword": ("road", _WORD.format(c="key", p="road")),
    "containcaseword": ("Road", _WORD.format(c="lower(key)", p="road")),
    "contain*": ("writ\nlease", "(contains(key, 'writ') OR contains(key, 'lease'))"),
    "containcase*": ("WRIT\nLease", "(contains(lower(key), 'writ') OR contains(lower(key), 'lease'))"),
    "containword*": ("writ\nlease", _WORD.format(c="key", p="writ|lease")),
    "containcaseword*": ("Writ\nlease", _WORD.format(c="lower(key)", p="writ|lease")),
}


def _searches():
    for mode, (pattern, cond) in _SEARCHES.items():
        name = "search_" + mode.replace("*", "_batch")

        def run(spark, d, mode=mode, pattern=pattern):
            lines = search.to_lines(_texts(spark, d), "text", "doc_id").withColumnRenamed("line", "key")
            return search.search(lines, mode, pattern)

        QUERIES[name] = run
        SQL[name] = f"""WITH l AS (SELECT doc_id, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS s FROM documents),
            x AS (SELECT doc_id, CAST(unnest(generate_series(0, len(s) - 1)) AS INTEGER) AS line_no, unnest(s) AS key FROM l)
            SELECT doc_id, line_no, key FROM x WHERE {cond}"""


_searches()


def _edit(binary):
    def run(spark, d):
        return search.search(_parts(spark, d), "editbin" if binary else "edit", "blue lace", 15)

    return run


for _name, _bin in (("search_edit", False), ("search_editbin", True)):
    QUERIES[_name] = _edit(_bin)
    SQL[_name] = """SELECT key, CAST(levenshtein(key, 'blue lace') AS INTEGER) AS distance FROM (SELECT DISTINCT p_name AS key FROM part) ORDER BY distance, key LIMIT 15"""


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents),
  x AS (SELECT doc_id, unnest(generate_series(0, len(s) - 1)) AS n, unnest(s) AS line FROM l)
  SELECT doc_id, CAST(n AS INTEGER) AS line_no, line FROM x WHERE contains(line, 'harbour') ORDER BY doc_id * 100000 + n LIMIT 25""")
def search_text_limit(spark, d):
    lines = search.to_lines(table(spark, d, "documents"), "text", "doc_id").withColumn("at", F.col("doc_id") * 100000 + F.col("line_no"))
    return search.search_text(lines, "contain", "harbour", 25, "line", "at").drop("at")


# Reduce


def _runs(spark, d):
    ev = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("event_type").alias("value"))
    pending = ev.withColumn("op", F.when(F.col("seq") % 11 == 0, "REMOVE").otherwise("SET"))
    return reduce.merge_runs(_customers(spark, d), pending)


_RUNS = """WITH r AS (SELECT c_custkey AS key, 0 AS rank, 0 AS seq, c_mktsegment AS value, 'SET' AS op FROM customer
  UNION ALL SELECT user_id, 1, event_id, event_type, CASE WHEN event_id % 11 = 0 THEN 'REMOVE' ELSE 'SET' END FROM events),
  dead AS (SELECT key, max(seq) AS dead_seq FROM r WHERE op = 'REMOVE' GROUP BY 1),
  live AS (SELECT r.*, row_number() OVER (PARTITION BY r.key ORDER BY rank, seq) AS rn FROM r LEFT JOIN dead USING (key)
           WHERE op = 'SET' AND (dead_seq IS NULL OR (rank = 1 AND seq > dead_seq)))
"""


def _reducers():
    made = {
        "first": "arg_min(value, rn)", "last": "arg_max(value, rn)", "second": "arg_max(value, rn) FILTER (WHERE rn <= 2)",
        "concat": "string_agg(value, '' ORDER BY rn)", "concattab": "string_agg(value, chr(9) ORDER BY rn)",
        "concatline": "string_agg(value, chr(10) ORDER BY rn)", "concatnull": "string_agg(value, chr(0) ORDER BY rn)",
    }
    for name, expr in made.items():

        def run(spark, d, name=name):
            return reduce.reduce_rows(reduce.drop_removed(_runs(spark, d)), name)

        QUERIES[f"reduce_{name}"] = run
        SQL[f"reduce_{name}"] = _RUNS + f"SELECT key, {expr} AS value FROM live GROUP BY key"


_reducers()


@query(_RUNS + "SELECT key, value FROM live")
def reduce_remove(spark, d):
    return reduce.reduce_rows(_runs(spark, d), "remove")


@query(r"""WITH v AS (SELECT rec_key, regexp_extract(rec_value, '^[\x00- ]*([-+]?)[\x00- ]*[0-9]', 1) AS s,
    ltrim(regexp_extract(rec_value, '^[\x00- ]*[-+]?[\x00- ]*([0-9]+)', 1), '0') AS digits FROM update_log WHERE rec_key IS NOT NULL),
  n AS (SELECT rec_key, s, CASE WHEN length(digits) > 19 THEN 10000000000000000000::HUGEINT ELSE coalesce(TRY_CAST(digits AS HUGEINT), 0) END AS n FROM v)
  SELECT rec_key AS key, CAST(sum(CASE WHEN s = '-' THEN greatest(-n, -9223372036854775808::HUGEINT) ELSE least(n, 9223372036854775807::HUGEINT) END) AS VARCHAR) AS value
  FROM n GROUP BY 1""")
def reduce_total(spark, d):
    """Totals of whatever integers the values begin with."""
    return reduce.synchronize(point.kv(table(spark, d, "update_log"), "rec_key", "rec_value"), None, "total")


@query("""SELECT CAST(l_orderkey AS BIGINT) AS key, printf('%016X', CAST(sum(l_linenumber) AS BIGINT)) AS value FROM lineitem GROUP BY 1""")
def reduce_total_big_endian(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), codecs.int_to_big_endian(F.col("l_linenumber"), 4).alias("value"))
    return reduce.synchronize(rows, None, "totalbe").select("key", F.hex("value").alias("value"))


@query("""SELECT k AS key, arg_max(v, r) AS value FROM (SELECT event_id AS k, 'm' || event_type AS v, 0 AS r FROM events
  UNION ALL SELECT o_orderkey, 'b' || o_orderstatus, 1 FROM orders UNION ALL SELECT c_custkey, 'n' || c_mktsegment, 2 FROM customer) GROUP BY k""")
def merge_last(spark, d):
    def run(name, key, value, mark):
        return table(spark, d, name).select(F.col(key).cast("long").alias("key"), F.concat(F.lit(mark), value).alias("value"))

    base, new = run("orders", "o_orderkey", "o_orderstatus", "b"), run("customer", "c_custkey", "c_mktsegment", "n")
    return reduce.synchronize(base, new, "last", [run("events", "event_id", "event_type", "m")])


@query(r"""SELECT w AS key, count(*) AS value FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{M}\p{N}]+')) AS w FROM documents) WHERE w <> '' GROUP BY w""")
def wordcount(spark, d):
    return reduce.word_count(spread(table(spark, d, "documents").select("text")), "text")


# Indices


def _by_nation(spark, d):
    return index.build(table(spark, d, "customer"), "c_nationkey", "c_custkey")


@query("SELECT c_custkey AS pkey FROM customer WHERE c_nationkey = 7 ORDER BY 1 LIMIT 10")
def index_get_values(spark, d):
    return index.get_values(_by_nation(spark, d), 7, 10)


@query("""SELECT c_nationkey AS ikey, c_custkey AS pkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS INTEGER) AS rank
  FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) QUALIFY rank <= 5""")
def index_get_values_multi(spark, d):
    keys = table(spark, d, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("ikey"))
    return index.get_values_multi(_by_nation(spark, d), keys, 5)


@query("SELECT c_nationkey AS ikey, c_custkey, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2")
def index_join(spark, d):
    keys = table(spark, d, "nation").filter("n_regionkey = 2").select(F.col("n_nationkey").alias("ikey"))
    return index.join_primary(_by_nation(spark, d), table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", keys)


@query("""SELECT DISTINCT e.value_key AS ikey, e.user_id AS pkey, c.c_custkey IS NOT NULL AS found
  FROM (SELECT event_id % 25 AS value_key, user_id FROM events) e LEFT JOIN customer c ON c_custkey = user_id AND c_nationkey = value_key""")
def index_check(spark, d):
    asked = table(spark, d, "events").select((F.col("event_id") % 25).alias("ikey"), F.col("user_id").alias("pkey"))
    return index.check(_by_nation(spark, d), asked)


@query("""SELECT DISTINCT CAST(k AS BIGINT) AS ikey, CAST(p AS BIGINT) AS pkey FROM (SELECT c_nationkey AS k, c_custkey AS p FROM customer UNION ALL SELECT event_id % 25, user_id FROM events)""")
def index_add(spark, d):
    more = table(spark, d, "events").select((F.col("event_id") % 25).alias("ikey"), F.col("user_id").alias("pkey"))
    return index.add(_by_nation(spark, d).select(F.col("ikey").cast("long").alias("ikey"), "pkey"), more)


@query("SELECT c_nationkey AS ikey, c_custkey AS pkey FROM customer EXCEPT SELECT CAST(event_id % 25 AS INTEGER), user_id FROM events")
def index_remove(spark, d):
    gone = table(spark, d, "events").select((F.col("event_id") % 25).alias("ikey"), F.col("user_id").alias("pkey"))
    return index.remove(_by_nation(spark, d), gone)


@query("""SELECT c_nationkey AS ikey, c_custkey AS pkey FROM customer WHERE (c_nationkey, c_custkey) >= (3, 100) ORDER BY 1, 2 LIMIT 12""")
def index_jump(spark, d):
    return index.jump(_by_nation(spark, d), 3, 100, 12)


@query("SELECT DISTINCT CASE WHEN c_acctbal < 0 THEN 99 ELSE c_nationkey END AS ikey, c_custkey AS pkey FROM customer")
def index_refresh(spark, d):
    before = table(spark, d, "customer")
    after = before.withColumn("c_nationkey", F.when(F.col("c_acctbal") < 0, 99).otherwise(F.col("c_nationkey")))
    return index.refresh(index.build(before, "c_nationkey", "c_custkey"), before, after, "c_nationkey", "c_custkey")


_INVERTED = r"WITH i AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{M}\p{N}]+')) AS ikey, doc_id AS pkey FROM documents) "


@query(r"""SELECT * FROM (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{M}\p{N}]+')) AS ikey, doc_id AS pkey FROM documents) WHERE ikey <> ''""")
def inverted_index(spark, d):
    return index.build_inverted(_texts(spark, d), "text", "doc_id")


@query(_INVERTED + "SELECT pkey FROM i WHERE ikey IN ('road', 'ferry', 'bread') GROUP BY pkey HAVING count(*) = 3")
def postings_and(spark, d):
    return index.search_all(index.build_inverted(_texts(spark, d), "text", "doc_id"), ["Road", "ferry", "bread"])


@query(_INVERTED + "SELECT DISTINCT pkey FROM i WHERE ikey IN ('writ', 'lease')")
def postings_or(spark, d):
    return index.search_any(index.build_inverted(_texts(spark, d), "text", "doc_id"), ["writ", "lease"])


# Logs and queues


def _log(spark, d):
    return table(spark, d, "events").select(
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_id") % 997 == 0, "CLEAR").when(F.col("event_id") % 7 == 0, "REMOVE").otherwise("SET").alias("op"),
        (F.col("event_id") % 3).cast("int").alias("server_id"),
        (F.col("event_id") % 2).cast("int").alias("dbm_index"),
        F.col("user_id").alias("key"),
        F.col("event_type").alias("value"),
    )


def _replay_sql(where: str) -> str:
    return f"""WITH l AS (SELECT event_id AS q, user_id AS k, event_type AS v,
      CASE WHEN event_id % 997 = 0 THEN 'CLEAR' WHEN event_id % 7 = 0 THEN 'REMOVE' ELSE 'SET' END AS op FROM events WHERE {where}),
    c AS (SELECT max(q) AS q FROM l WHERE op = 'CLEAR'),
    a AS (SELECT c_custkey AS k, -1 AS q, c_mktsegment AS v, 'SET' AS op FROM customer UNION ALL SELECT k, q, v, op FROM l WHERE op <> 'CLEAR'),
    x AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY q DESC) AS rn FROM a)
    SELECT k AS key, v AS value FROM x, c WHERE rn = 1 AND op = 'SET' AND x.q > coalesce(c.q, -2)"""


@query(_replay_sql("true"))
def changelog_replay(spark, d):
    return changelog.replay(_customers(spark, d), _log(spark, d))


@query(_replay_sql("event_id % 3 = 1"))
def changelog_replay_server(spark, d):
    return changelog.replay(_customers(spark, d), _log(spark, d), server_id=1)


@query(_replay_sql("event_id % 3 <> 1 AND event_id % 2 = 0"))
def changelog_replay_excluded(spark, d):
    return changelog.replay(_customers(spark, d), _log(spark, d), server_id=-1, dbm_index=0)


@query("""SELECT event_id AS seq, CASE WHEN event_id % 3 = 1 THEN 'SUCCESS' ELSE 'INFEASIBLE_ERROR' END AS status FROM events""")
def changelog_status(spark, d):
    return changelog.apply_status(_log(spark, d), server_id=1)


@query("""SELECT CASE WHEN a.k IS NULL THEN 'REMOVE' ELSE 'SET' END AS op, coalesce(a.k, b.k) AS key, a.v AS value
  FROM (SELECT c_custkey AS k, c_mktsegment AS v FROM customer) b
  FULL JOIN (SELECT user_id AS k, arg_max(event_type, event_id) AS v FROM events WHERE user_id IS NOT NULL GROUP BY 1) a ON a.k = b.k
  WHERE a.k IS NULL OR b.k IS NULL OR a.v IS DISTINCT FROM b.v""")
def changelog_capture(spark, d):
    none = spark.createDataFrame([], "key long, value string")
    return changelog.capture(_customers(spark, d), point.set_multi(none, _event_sets(spark, d)))


@query(byte_sql.ENTRIES)
def changelog_parse(spark, d):
    """Entries of the queues' messages, decoded."""
    m = table(spark, d, "log_messages").select("msg_id", changelog.parse_entries(F.col("message")).alias("e"))
    return m.select("msg_id", "e.status", "e.op", "e.server_id", "e.dbm_index", F.hex("e.key").alias("key"), F.hex("e.value").alias("value"))


@query("SELECT msg_id, file_id, file_offset, timestamp_ms FROM log_messages WHERE timestamp_ms >= 1741000000000")
def queue_since(spark, d):
    from keyweave.streaming.queues import since

    return since(table(spark, d, "log_messages"), 1741000000000).select("msg_id", "file_id", "file_offset", "timestamp_ms")


@query("""WITH f AS (SELECT queue_prefix, file_id, max(timestamp_ms) AS t FROM log_messages GROUP BY ALL),
  g AS (SELECT *, max(file_id) OVER (PARTITION BY queue_prefix) AS latest FROM f)
  SELECT queue_prefix, file_id, t AS last_ms FROM g WHERE t < 1742000000000 AND file_id < latest""")
def queue_retention(spark, d):
    from keyweave.streaming.queues import old_files

    return old_files(table(spark, d, "log_messages"), 1742000000000)


@query("""WITH m AS (SELECT queue_prefix, file_id, file_offset, max(timestamp_ms) AS ts FROM log_messages GROUP BY ALL)
  SELECT queue_prefix, file_id, count(*) AS n_messages, min(file_offset) AS first_offset, max(file_offset) AS last_offset, max(ts) AS last_ms FROM m GROUP BY ALL""")
def queue_files(spark, d):
    from keyweave.streaming.queues import file_stats

    return file_stats(table(spark, d, "log_messages"))


# Cache and shards


@query("""WITH l AS (SELECT user_id, max(event_id) AS last_seq, CAST(user_id % 32 AS INTEGER) AS slot FROM events WHERE user_id IS NOT NULL GROUP BY user_id)
  SELECT slot, user_id, last_seq, CAST(row_number() OVER (PARTITION BY slot ORDER BY last_seq DESC) AS INTEGER) AS rank FROM l QUALIFY rank <= 4""")
def lru_retain(spark, d):
    return cache.lru_retain(table(spark, d, "events"), "user_id", "event_id", 100, F.pmod("user_id", F.lit(32)).cast("int"))


@query(byte_sql.SHARDS)
def shard_counts(spark, d):
    rows = shard.with_shard(table(spark, d, "customer").select(F.col("c_name").alias("key")), 8)
    return rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))


@query(byte_sql.BUCKETS)
def bucket_counts(spark, d):
    rows = shard.with_bucket(table(spark, d, "customer").select(F.col("c_name").alias("key")), 101)
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


# Orders


def _ordered(name: str, sql_order: str, key: str, second: str | None = None) -> None:
    """A query ranking customers within their nation, so that no window holds more than a nation."""

    def run(spark, d):
        c = table(spark, d, "customer").select("c_custkey", "c_nationkey", F.expr(key).alias("k"), F.expr(second or "null").alias("s"))
        by = [*sort_keys(name, F.col("k"), F.col("s") if second else None), F.col("c_custkey")]
        return c.select("c_custkey", "c_nationkey", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(*by)).alias("rank"))

    QUERIES[f"order_{name}"] = run
    SQL[f"order_{name}"] = f"""SELECT c_custkey, c_nationkey,
        CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY {sql_order}, c_custkey) AS INTEGER) AS rank FROM customer"""


_ordered("lexical", "c_mktsegment", "c_mktsegment")
_ordered("lexicalcase", "lower(c_mktsegment)", "IF(c_custkey % 2 = 0, lower(c_mktsegment), c_mktsegment)")
_ordered("decimal", "c_custkey % 1000", "concat(' ', cast(c_custkey % 1000 as string), 'x')")
_ordered("hexadecimal", "c_custkey % 1000", "concat('0x', lower(hex(c_custkey % 1000)))")
_ordered("realnumber", "c_acctbal", "cast(c_acctbal as string)")
_ordered("signedbigendian", "c_custkey % 100 - 50", "unhex(right(lpad(hex(c_custkey % 100 - 50), 16, '0'), 4))")
_ordered("pairlexical", "c_mktsegment, c_name", "c_mktsegment", "c_name")
_ordered("pairlexicalcase", "lower(c_mktsegment), c_name", "c_mktsegment", "c_name")
_ordered("pairdecimal", "c_custkey % 10, c_mktsegment", "cast(c_custkey % 10 as string)", "c_mktsegment")
_ordered("pairhexadecimal", "c_custkey % 20, c_mktsegment", "hex(c_custkey % 20)", "c_mktsegment")
_ordered("pairrealnumber", "round(c_acctbal), c_mktsegment", "cast(round(c_acctbal) as string)", "c_mktsegment")
_ordered("pairsignedbigendian", "c_custkey % 10 - 5, c_mktsegment", "unhex(right(lpad(hex(c_custkey % 10 - 5), 16, '0'), 2))", "c_mktsegment")


@query("SELECT c_custkey, c_nationkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS INTEGER) AS rank FROM customer")
def order_floatbigendian(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", codecs.float_to_big_endian(F.col("c_acctbal")).alias("k"))
    by = [*sort_keys("floatbigendian", F.col("k")), F.col("c_custkey")]
    return c.select("c_custkey", "c_nationkey", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(*by)).alias("rank"))


@query("SELECT c_custkey, c_nationkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_mktsegment, c_custkey) AS INTEGER) AS rank FROM customer")
def order_pairfloatbigendian(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", codecs.float_to_big_endian(F.col("c_acctbal")).alias("k"))
    by = [*sort_keys("pairfloatbigendian", F.col("k"), F.col("c_mktsegment")), F.col("c_custkey")]
    return c.select("c_custkey", "c_nationkey", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(*by)).alias("rank"))


# Scalar functions over whole tables


@query(r"""SELECT log_id, string_split(rec_key, ':') AS parts, replace(rec_key, '00', '<0>') AS replaced, translate(rec_key, 'aeiou', 'AEI') AS mapped,
  translate(rec_key, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered, CAST(strpos(rec_key, 'ss') - 1 AS INTEGER) AS found_at,
  contains(rec_key, ':0') AS has, starts_with(rec_key, 'rate') AS begins, suffix(rec_key, 'root') AS ends,
  regexp_replace(rec_key, '^[\x00- ]+|[\x00- ]+$', '', 'g') AS stripped, lower(hex(encode(rec_key))) AS hexed
  FROM update_log WHERE rec_key IS NOT NULL""")
def string_functions(spark, d):
    k = F.col("rec_key")
    return table(spark, d, "update_log").filter("rec_key IS NOT NULL").select(
        "log_id", strings.split_on(k, ":").alias("parts"), strings.replace(k, "00", "<0>").alias("replaced"),
        strings.replace_characters(k, "aeiou", "AEI").alias("mapped"), strings.lower_ascii(k).alias("lowered"),
        strings.case_search(k, "ss").alias("found_at"), strings.contains(k, ":0").alias("has"), strings.begins_with(k, "rate").alias("begins"),
        strings.ends_with(k, "root").alias("ends"), strings.strip(k).alias("stripped"), F.lower(F.hex(k.cast("binary"))).alias("hexed"),
    )


@query(r"""WITH v AS (SELECT log_id, rec_value, regexp_extract(rec_value, '^[\x00- ]*([-+]?)[\x00- ]*[0-9]', 1) AS s,
    ltrim(regexp_extract(rec_value, '^[\x00- ]*[-+]?[\x00- ]*([0-9]+)', 1), '0') AS digits FROM update_log),
  n AS (SELECT *, CASE WHEN length(digits) > 19 THEN 10000000000000000000::HUGEINT ELSE coalesce(TRY_CAST(digits AS HUGEINT), 0) END AS n FROM v)
  SELECT log_id, CAST(CASE WHEN rec_value IS NULL THEN NULL WHEN s = '-' THEN greatest(-n, -9223372036854775808::HUGEINT)
    ELSE least(n, 9223372036854775807::HUGEINT) END AS BIGINT) AS as_int FROM n""")
def to_int_values(spark, d):
    """Every row: numbers beyond 64 bits saturate, null values give null."""
    return table(spark, d, "update_log").select("log_id", strings.to_int(F.col("rec_value")).alias("as_int"))


@query(r"""WITH k AS (SELECT log_id, rec_value, string_split(url_encode(rec_key), '%') AS p FROM update_log)
  SELECT log_id, base64(encode(rec_value)) AS b64,
    list_aggregate(list_transform(p, lambda x, i: CASE WHEN i = 1 THEN x ELSE '%' || lower(left(x, 2)) || substr(x, 3) END), 'string_agg', '') AS url FROM k""")
def encoded_values(spark, d):
    """Null where the key or value is null."""
    return table(spark, d, "update_log").select(
        "log_id", strings.encode_base64(F.col("rec_value").cast("binary")).alias("b64"), strings.encode_url(F.col("rec_key")).alias("url")
    )


@query("""SELECT o_orderkey, printf('%016X', o_orderkey) AS be, o_orderkey AS back FROM orders""")
def big_endian_numbers(spark, d):
    be = codecs.int_to_big_endian(F.col("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey", F.hex(be).alias("be"), codecs.big_endian_to_int(be).alias("back"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d %H:%M:%S') AS simple, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS w3c,
  strftime(o_orderdate, '%a, %d %b %Y %H:%M:%S GMT') AS mail, CAST(dayofweek(o_orderdate) AS INTEGER) AS weekday, CAST(epoch(o_orderdate) AS DOUBLE) AS parsed FROM orders""")
def time_formats(spark, d):
    t = F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6
    w3c = times.format_w3c(t)
    return table(spark, d, "orders").select(
        "o_orderkey", times.format_simple(t).alias("simple"), w3c.alias("w3c"), times.format_rfc1123(t).alias("mail"),
        times.calendar(t)["weekday"].alias("weekday"), times.parse_date(w3c).alias("parsed"),
    )


@query(r"""WITH v AS (SELECT log_id, rec_value, regexp_extract(rec_value, '^[\x00- ]*([-+]?)[\x00- ]*[0-9.]', 1) AS s,
    regexp_extract(rec_value, '^[\x00- ]*[-+]?[\x00- ]*([0-9]*)', 1) AS whole,
    regexp_extract(rec_value, '^[\x00- ]*[-+]?[\x00- ]*[0-9]*\.([0-9]+)', 1) AS part,
    lower(regexp_extract(rec_value, '^[\x00- ]*[-+]?[\x00- ]*(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)[\x00- ]*([kKmMgGtTpPeE]i?)', 1)) AS unit FROM update_log),
  n AS (SELECT *, CAST(coalesce(nullif(ltrim(whole, '0'), ''), '0') AS HUGEINT) AS w,
    CAST(rpad(left(part, 9), 9, '0') AS HUGEINT) AS f,
    CAST(pow(CASE WHEN suffix(unit, 'i') THEN 1024 ELSE 1000 END, strpos('kmgtpe', left(unit, 1)) * (unit <> '')::INT) AS HUGEINT) AS m FROM v)
  SELECT log_id, CAST(CASE WHEN rec_value IS NULL THEN NULL ELSE greatest(least(
    CASE WHEN s = '-' THEN -1 ELSE 1 END * (w * m + f * m // 1000000000), 9223372036854775807::HUGEINT), -9223372036854775808::HUGEINT) END AS BIGINT) AS metric FROM n""")
def to_metric_values(spark, d):
    """Every row, whatever its spelling; null values give null."""
    return table(spark, d, "update_log").select("log_id", strings.to_int_metric(F.col("rec_value")).alias("metric"))


def _searched(rows):
    k = F.col("rec_key")
    return rows.select(
        "log_id", strings.word_search(k, "lease").alias("word_at"), F.size(strings.search_whole(k, "0")).cast("long").alias("zeros"),
        strings.edit_distance(k, "sess/harbour-46", True).alias("distance"),
    )


@query(r"""SELECT log_id, CAST(CASE WHEN regexp_matches(rec_key, '(^|[^0-9A-Za-z])lease([^0-9A-Za-z]|$)') THEN
    strlen(regexp_extract(rec_key, '(?s)^(.*?(?:^|[^0-9A-Za-z]))lease([^0-9A-Za-z]|$)', 1)) ELSE -1 END AS INTEGER) AS word_at,
  strlen(rec_key) - strlen(replace(rec_key, '0', '')) AS zeros, CAST(levenshtein(rec_key, 'sess/harbour-46') AS INTEGER) AS distance
  FROM update_log WHERE rec_key IS NOT NULL""")
def search_functions(spark, d):
    return _searched(table(spark, d, "update_log").filter("rec_key IS NOT NULL"))


@query(byte_sql.CODECS)
def codec_round_trips(spark, d):
    """Bytes of the codecs and what they read back, over the whole feed."""
    k, n = F.col("rec_key"), F.col("seq")
    pair = codecs.serialize_list(F.array(k.cast("binary"), F.coalesce("rec_value", F.lit("")).cast("binary")))
    return table(spark, d, "update_log").filter(k.isNotNull()).select(
        "log_id", F.hex(codecs.int_to_varint(n)).alias("varint"), F.hex(pair).alias("pair"), codecs.first_of_pair(pair).cast("string").alias("first"),
        strings.unescape_c(strings.escape_c(k)).alias("unescaped"), strings.decode_url(strings.encode_url(k)).alias("unquoted"),
    )


@query(byte_sql.HASHES)
def hash_functions(spark, d):
    k = F.col("rec_key")
    return spread(table(spark, d, "update_log").filter(k.isNotNull()).select("log_id", "rec_key")).select(
        "log_id", hashes.hash_murmur(k).alias("murmur"), hashes.hash_fnv(k).alias("fnv"), hashes.crc(k, 32).alias("crc32"),
        hashes.crc(k, 16).alias("crc16"), hashes.crc(k, 8).alias("crc8"), hashes.adler(k, 32).alias("adler32"), hashes.checksum(k, 8).alias("checksum8"),
    )
