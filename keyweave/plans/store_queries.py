"""Queries through stored tables, indices and files, and over the less common functions, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from keyweave.functions import codecs, hashes, strings, times
from keyweave.operators import point, search
from keyweave.plans import byte_sql
from keyweave.session import kept_path, table
from keyweave.sharded import ShardedTable
from keyweave.sources import records
from keyweave.stored_index import StoredIndex
from keyweave.table import KINDS, open_table, restore

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(fn):
        QUERIES[fn.__name__], SQL[fn.__name__] = fn, sql
        return fn

    return add


def _place(spark, label: str) -> str:
    return kept_path(spark, label, uuid.uuid4().hex)


# Stored tables: customers, overwritten by events, less the customers of orders, some appended to.

_HELD = """WITH e AS (SELECT user_id AS k, arg_max(event_type, event_id) AS v FROM events WHERE user_id IS NOT NULL GROUP BY 1),
  s AS (SELECT c_custkey AS k, c_mktsegment AS v FROM customer WHERE c_custkey NOT IN (SELECT k FROM e) UNION ALL SELECT * FROM e),
  r AS (SELECT * FROM s WHERE k NOT IN (SELECT o_custkey FROM orders)),
  a AS (SELECT CAST(s_suppkey AS BIGINT) AS k, s_name AS v FROM supplier)
"""
_FILLED = _HELD + "SELECT coalesce(r.k, a.k) AS key, concat_ws('|', r.v, a.v) AS value FROM r FULL JOIN a ON a.k = r.k"


def _fill(spark, d, t):
    events = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("event_type").alias("value"))
    one = F.lit(0).cast("long").alias("seq")
    t.set_multi(point.kv(table(spark, d, "customer"), "c_custkey", "c_mktsegment").withColumn("seq", one))
    t.set_multi(events)
    t.remove_multi(table(spark, d, "orders").select(F.col("o_custkey").alias("key")))
    t.append_multi(table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("key"), F.col("s_name").alias("value"), one), "|")
    return t


def _tables():
    for kind in KINDS:

        def run(spark, d, kind=kind):
            return _fill(spark, d, open_table(spark, _place(spark, kind), "key long, value string", dbm=kind, cap_rec_num=1 << 40)).df()

        QUERIES[f"table_{kind}"], SQL[f"table_{kind}"] = run, _FILLED


_tables()


@query(_FILLED)
def table_sharded(spark, d):
    return _fill(spark, d, ShardedTable(spark, _place(spark, "shards"), "key long, value string", 2)).df()


@query(_FILLED)
def table_restored(spark, d):
    path = _place(spark, "damaged")
    _fill(spark, d, open_table(spark, path, "key long, value string"))
    return restore(spark, path, "key long, value string")


@query(_FILLED)
def table_rebuilt(spark, d):
    t = _fill(spark, d, open_table(spark, _place(spark, "rebuilt"), "key long, value string", dbm="tree"))
    t.rebuild(4)
    path = _place(spark, "copy")
    t.copy(path)
    return spark.read.parquet(path)


@query("""WITH r AS (SELECT c_custkey AS k, c_mktsegment AS v, 0 AS q, 0 AS n FROM customer UNION ALL SELECT user_id, event_type, 1, event_id FROM events WHERE user_id IS NOT NULL)
  SELECT k AS key, string_agg(v, chr(9) ORDER BY q, n) AS value FROM r GROUP BY k""")
def table_synchronized(spark, d):
    t = open_table(spark, _place(spark, "skip"), "key long, value string", dbm="skip")
    t.set_multi(point.kv(table(spark, d, "customer"), "c_custkey", "c_mktsegment").withColumn("seq", F.lit(0)))
    t.insert(table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("event_type").alias("value")))
    t.synchronize("concattab")
    return t.df()


@query("SELECT c_nationkey AS ikey, c_custkey AS pkey FROM customer EXCEPT SELECT CAST(event_id % 25 AS INTEGER), user_id FROM events")
def index_stored(spark, d):
    x = StoredIndex(spark, _place(spark, "index"), ("int", "long"))
    x.add_multi(table(spark, d, "customer").select(F.col("c_nationkey").alias("ikey"), F.col("c_custkey").alias("pkey")))
    x.remove_multi(table(spark, d, "events").select((F.col("event_id") % 25).cast("int").alias("ikey"), F.col("user_id").alias("pkey")))
    return x.df()


@query("SELECT o_orderkey AS key, o_orderstatus AS value FROM orders WHERE o_orderkey = 7")
def get_one(spark, d):
    return point.get(point.kv(table(spark, d, "orders"), "o_orderkey", "o_orderstatus"), 7)


# Files


@query("SELECT hex(encode(p_name)) AS key, hex(encode(p_brand)) AS value FROM part")
def flat_round_trip(spark, d):
    path = _place(spark, "flat")
    records.export_flat(point.kv(table(spark, d, "part"), "p_name", "p_brand"), path)
    return records.import_flat(spark, path).select(F.hex("key").alias("key"), F.hex("value").alias("value"))


@query(r"""SELECT regexp_replace(rec_key, '[\x00- \x7f]', ' ', 'g') AS key, max(regexp_replace(coalesce(rec_value, ''), '[\x00-\x08\x0a- \x7f]', ' ', 'g')) AS value
  FROM (SELECT rec_key, max(rec_value) AS rec_value FROM update_log WHERE rec_key IS NOT NULL GROUP BY 1) GROUP BY 1""")
def tsv_round_trip(spark, d):
    """Keys that become equal in a TSV file are one record; here the greatest of their values."""
    path = _place(spark, "tsv")
    log = table(spark, d, "update_log").filter("rec_key IS NOT NULL").groupBy(F.col("rec_key").alias("key")).agg(F.max("rec_value").alias("value"))
    lines = records.tsv_lines(log)
    lines.orderBy("value").coalesce(1).write.text(path)
    return records.import_tsv(spark, path)


@query("SELECT c_name AS line, row_number() OVER (ORDER BY c_name) - 1 AS line_no FROM customer")
def line_numbers(spark, d):
    path = _place(spark, "lines")
    names = table(spark, d, "customer").select(F.col("c_name").alias("key"))
    records.export_key_lines(names.repartitionByRange(4, "key").sortWithinPartitions("key"), path)
    return records.read_lines(spark, path)


# Functions


@query(r"""SELECT log_id, CAST(CASE WHEN rec_key IS NULL THEN NULL WHEN regexp_matches(rec_key, '[0-9]+') THEN strlen(regexp_extract(rec_key, '(?s)^(.*?)[0-9]', 1)) ELSE -1 END AS INTEGER) AS digits_at,
  CASE WHEN rec_key IS NOT NULL THEN -2 END AS bad_pattern, CAST(CASE WHEN strpos(rec_key, '+') > 0 THEN strlen(left(rec_key, strpos(rec_key, '+') - 1)) ELSE CASE WHEN rec_key IS NOT NULL THEN -1 END END AS INTEGER) AS plus_at,
  regexp_replace(rec_key, '([0-9])([0-9])', '\2\1', 'g') AS swapped FROM update_log""")
def regex_functions(spark, d):
    k = F.col("rec_key")
    return table(spark, d, "update_log").select(
        "log_id", strings.search_regex(k, "[0-9]+").alias("digits_at"), strings.search_regex(k, "(?P<x>a)").alias("bad_pattern"),
        strings.search_regex(k, "(?b)+").alias("plus_at"), strings.replace_regex(k, "([0-9])([0-9])", "$2$1").alias("swapped"),
    )


@query(r"""SELECT log_id, translate(rec_key, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS uppered, regexp_replace(rec_key, '[\r\n]+$', '') AS line,
  regexp_replace(regexp_replace(rec_key, '([\x00- ])[\x00- ]+', '\1', 'g'), '^[\x00- ]+|[\x00- ]+$', '', 'g') AS squeezed, regexp_replace(rec_key, '[\x00- \x7f]', ' ', 'g') AS trimmed,
  CAST(CASE WHEN f < 'session' THEN -1 WHEN f > 'session' THEN 1 ELSE 0 END AS INTEGER) AS compared,
  list_transform(string_split(rec_key, ''), lambda x: unicode(x)) AS points, hex(encode(rec_key)) AS decoded,
  list_transform([':', 'r', 'ö'], lambda p: CAST(CASE WHEN strpos(rec_key, p) > 0 THEN strlen(left(rec_key, strpos(rec_key, p) - 1)) ELSE -1 END AS INTEGER)) AS found,
  array_to_string(string_split(rec_key, ':'), '/') AS joined, regexp_split_to_array(rec_key, '[:/-]') AS parts
  FROM (SELECT log_id, rec_key, translate(rec_key, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS f FROM update_log) WHERE rec_key <> ''""")
def more_string_functions(spark, d):
    k = F.col("rec_key")
    return table(spark, d, "update_log").filter("rec_key <> ''").select(
        "log_id", strings.upper_ascii(k).alias("uppered"), strings.strip_line(k).alias("line"), strings.squeeze_and_strip(k).alias("squeezed"),
        strings.trim_for_tsv(k).alias("trimmed"), strings.case_compare(k, "Session").alias("compared"), strings.to_ucs4(k).alias("points"),
        F.hex(strings.decode_base64(strings.encode_base64(k))).alias("decoded"), strings.search_batch(k, [":", "r", "ö"]).alias("found"),
        strings.join(strings.split_on(k, ":"), "/").alias("joined"), strings.split_any(k, ":/-").alias("parts"),
    )


@query("""SELECT DISTINCT p_name AS line, CAST(levenshtein(p_name, 'blue lace') AS INTEGER) AS distance FROM part ORDER BY distance, line LIMIT 15""")
def search_text_edit(spark, d):
    lines = table(spark, d, "part").select(F.col("p_name").alias("line")).distinct().withColumn("line_no", F.lit(0))
    return search.search_text(lines, "edit", "blue lace", 15).select("line", "distance")


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '\n$', ''), chr(10))) AS line FROM documents)
  SELECT doc_id, count(*) AS n FROM l WHERE regexp_matches(line, '[Hh]arbour|[Ff]erry') GROUP BY 1""")
def search_text_regex(spark, d):
    lines = search.to_lines(table(spark, d, "documents").select("doc_id", "text"), "text", "doc_id")
    return search.search_text(lines, "regex", "[Hh]arbour|[Ff]erry").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


_N = "(log_id * 7919 - 1000000000)"


@query(f"""SELECT log_id, {byte_sql.varint(f"(CASE WHEN {_N} >= 0 THEN 2 * {_N} ELSE -2 * {_N} - 1 END)")} AS zigzag, {_N} AS back,
  {byte_sql.varint("strlen(rec_key)")} || hex(encode(rec_key)) || {byte_sql.varint("strlen(coalesce(rec_value, ''))")} || hex(encode(coalesce(rec_value, ''))) AS map,
  coalesce(rec_value, '') AS value, lpad(printf('%X', log_id), 6, '0') AS short FROM update_log WHERE rec_key IS NOT NULL""")
def number_codecs(spark, d):
    n, k, v = F.col("log_id") * 7919 - 1_000_000_000, F.col("rec_key"), F.coalesce("rec_value", F.lit(""))
    packed = codecs.serialize_map(F.create_map(k, v.cast("binary")))
    zigzag = codecs.int_to_varint(n, True)
    return table(spark, d, "update_log").filter("rec_key IS NOT NULL").select(
        "log_id", F.hex(zigzag).alias("zigzag"), codecs.varint_to_int(zigzag, True).alias("back"), F.hex(packed).alias("map"),
        F.element_at(codecs.deserialize_map(packed), k.cast("binary")).cast("string").alias("value"), F.hex(codecs.int_to_big_endian(F.col("log_id"), 3)).alias("short"),
    )


@query("SELECT log_id, rec_value AS plain, rec_value AS zlib, rec_value AS zstd, rec_value AS lz4, rec_value AS lzma, rec_value AS aes FROM update_log")
def compressed_values(spark, d):
    v, key = F.col("rec_value"), b"0123456789abcdef"
    back = lambda c: codecs.decompress(codecs.compress(v, c), c).cast("string")
    return table(spark, d, "update_log").select(
        "log_id", back("none").alias("plain"), *[back(c).alias(c) for c in ("zlib", "zstd", "lz4", "lzma")],
        codecs.decrypt(codecs.encrypt(v, key), key).cast("string").alias("aes"),
    )


_SUM, _WEIGHTED = "coalesce(list_sum(b), 0)", "coalesce(list_sum(list_transform(b, lambda x, i: CAST(x AS BIGINT) * (len(b) - i + 1))), 0)"


def _small_adler(modulus: int, half: int) -> str:
    return f"CAST((len(b) + {_WEIGHTED}) % {modulus} * {1 << half} + (1 + {_SUM}) % {modulus} AS BIGINT)"


@query(f"""WITH k AS (SELECT log_id, {byte_sql.bytes_of('h')} AS b FROM (SELECT log_id, hex(encode(rec_key)) AS h FROM update_log WHERE rec_key IS NOT NULL))
  SELECT log_id, {_small_adler(7, 3)} AS adler6, {_small_adler(13, 4)} AS adler8, {_small_adler(251, 8)} AS adler16, CAST({byte_sql.crc('b', 4)} AS BIGINT) AS crc4,
    CAST({_SUM} % 61 AS BIGINT) AS checksum6, CAST(2 * {_SUM} % 61 AS BIGINT) AS pair6 FROM k""")
def small_hashes(spark, d):
    k = F.col("rec_key")
    return table(spark, d, "update_log").filter("rec_key IS NOT NULL").select(
        "log_id", hashes.adler(k, 6).alias("adler6"), hashes.adler(k, 8).alias("adler8"), hashes.adler(k, 16).alias("adler16"), hashes.crc(k, 4).alias("crc4"),
        hashes.checksum(k, 6).alias("checksum6"), hashes.checksum_pair(k, k, 6).alias("pair6"),
    )


@query("""SELECT event_id, unnest(['simple', 'mail', 'w3c', 'ahead', 'hexed', 'seconds', 'day']) AS form,
  unnest([e, e, e, e, e, e, CAST(epoch(date_trunc('day', ts)) AS DOUBLE)]) AS parsed FROM (SELECT event_id, ts, CAST(floor(epoch(ts)) AS DOUBLE) AS e FROM events)""")
def parsed_dates(spark, d):
    """Times written in every form and read back."""
    t = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("double")
    whole = t.cast("long")
    forms = {
        "simple": times.format_simple(t), "mail": times.format_rfc1123(t), "w3c": times.format_w3c(t), "ahead": times.format_w3c(t, 3600),
        "hexed": F.concat(F.lit("0x"), F.hex(whole)), "seconds": whole.cast("string"), "day": F.date_format(F.timestamp_seconds(t), "yyyy-MM-dd"),
    }
    each = table(spark, d, "events").select("event_id", F.explode(F.array(*[F.struct(F.lit(n).alias("form"), c.alias("text")) for n, c in forms.items()])).alias("x"))
    return each.select("event_id", "x.form", times.parse_date(F.col("x.text")).alias("parsed"))


@query("""SELECT event_id, e AS digits, CAST(e * 1000 AS BIGINT) - 7200000 AS earlier FROM (SELECT event_id, CAST(floor(epoch(ts)) AS DOUBLE) AS e FROM events)""")
def relative_times(spark, d):
    t = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("double")
    return table(spark, d, "events").select(
        "event_id", times.parse_digits(times.format_simple(t)).alias("digits"), times.parse_relative(F.lit("-2H"), t.cast("long") * 1000).alias("earlier")
    )
