"""SQL texts that work on bytes: hashes, variable-length numbers and log entries, step by step."""

from __future__ import annotations

_TWO64 = 1 << 64


def bytes_of(hexed: str) -> str:
    """List of the bytes (as UBIGINT) of a hex string."""
    digit = lambda at: f"(strpos('0123456789ABCDEF', substr({hexed}, {at}, 1)) - 1)"
    return f"list_transform(range(0, length({hexed}) // 2), lambda i: CAST(16 * {digit('2 * i + 1')} + {digit('2 * i + 2')} AS UBIGINT))"


def signed(x: str) -> str:
    return f"CAST(CASE WHEN {x} >= {_TWO64 // 2} THEN CAST({x} AS HUGEINT) - {_TWO64} ELSE {x} END AS BIGINT)"


def _times(x: str, factor: int) -> str:
    return f"CAST(CAST({x} AS UHUGEINT) * {factor} % {_TWO64} AS UBIGINT)"


def fnv(b: str) -> str:
    # Basis and factor.
    start, step = "CAST(14695981039346656037 AS UBIGINT)", _times("xor(h, x)", 109951162811)
    return f"list_reduce(list_prepend({start}, {b}), lambda h, x: {step})"


def murmur(b: str) -> str:
    # Seed, factor and shift.
    factor, mix = 14313749767032793493, lambda x: f"xor({x}, {x} >> 47)"
    word = lambda at, n: f"CAST(list_sum(list_transform(range(0, {n}), lambda j: CAST({b}[8 * {at} + j + 1] AS HUGEINT) * CAST(pow(256, j) AS HUGEINT))) AS UBIGINT)"
    words = f"list_transform(range(0, len({b}) // 8), lambda w: {word('w', 8)})"
    start = f"xor(CAST(19780211 AS UBIGINT), {_times(f'len({b})', factor)})"
    mixed = _times(mix(_times("x", factor)), factor)
    whole = f"list_reduce(list_prepend({start}, {words}), lambda h, x: xor({_times('h', factor)}, {mixed}))"
    rest = word(f"(len({b}) // 8)", f"len({b}) % 8")
    tail = f"list_reduce([{whole}] || CASE WHEN len({b}) % 8 > 0 THEN [{rest}] ELSE [] END, lambda h, x: {_times('xor(h, x)', factor)})"
    last = f"list_transform([{tail}], lambda h: {_times(mix('h'), factor)})"
    return f"list_transform({last}, lambda h: {mix('h')})[1]"


def folded(h: str, n: int) -> str:
    """Place among ``n`` of a 64-bit hash: its halves xor-ed, then rotated by 16 of 32 bits."""
    halves = f"list_transform([{h}], lambda h: xor(h >> 32, h & 4294967295))"
    return f"list_transform({halves}, lambda x: ((x >> 16) | ((x & 65535) << 16)) % {n})[1]"


def _table(bits: int, poly: int, reflected: bool) -> str:
    out = []
    for c in range(256):
        c = c if reflected else c << bits - 8
        for _ in range(8):
            c = (c >> 1 ^ (poly if c & 1 else 0)) if reflected else (c << 1 & (1 << bits) - 1) ^ (poly if c >> bits - 1 else 0)
        out.append(c)
    return "CAST([" + ", ".join(map(str, out)) + "] AS UBIGINT[])"


def crc(b: str, bits: int) -> str:
    # Polynomials.
    if bits == 32:
        step = f"xor(c >> 8, {_table(32, 0xEDB88320, True)}[CAST(xor(c, x) & 255 AS INTEGER) + 1])"
        return f"xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), {b}), lambda c, x: {step}), CAST(4294967295 AS UBIGINT))"
    if bits == 16:
        step = f"xor((c << 8) & 65535, {_table(16, 0x1021, False)}[CAST(xor(c >> 8, x) AS INTEGER) + 1])"
    elif bits == 4:
        step = f"{_table(4, 0xC, True)}[CAST(xor(c, x) AS INTEGER) + 1]"
    else:
        step = f"{_table(8, 0x07, False)}[CAST(xor(c, x) AS INTEGER) + 1]"
    return f"list_reduce(list_prepend(CAST(0 AS UBIGINT), {b}), lambda c, x: {step})"


def adler32(b: str) -> str:
    total = f"coalesce(list_sum({b}), 0)"
    weighted = f"coalesce(list_sum(list_transform({b}, lambda x, i: CAST(x AS BIGINT) * (len({b}) - i + 1))), 0)"
    return f"((len({b}) + {weighted}) % 65521 * 65536 + (1 + {total}) % 65521)"


def varint(x: str) -> str:
    """Hex of a number in groups of seven bits, the highest first, all but the last marked."""
    groups = f"range((length(bin({x})) + 6) // 7 - 1, -1, -1)"
    return f"list_aggregate(list_transform({groups}, lambda j: printf('%02X', CAST((({x} >> (7 * j)) & 127) + CASE WHEN j > 0 THEN 128 ELSE 0 END AS INTEGER))), 'string_agg', '')"


HASHES = f"""WITH k AS (SELECT log_id, {bytes_of('h')} AS b FROM (SELECT log_id, hex(encode(rec_key)) AS h FROM update_log WHERE rec_key IS NOT NULL))
SELECT log_id, {signed(murmur('b'))} AS murmur, {signed(fnv('b'))} AS fnv, CAST({crc('b', 32)} AS BIGINT) AS crc32, CAST({crc('b', 16)} AS BIGINT) AS crc16,
  CAST({crc('b', 8)} AS BIGINT) AS crc8, CAST({adler32('b')} AS BIGINT) AS adler32, CAST(coalesce(list_sum(b), 0) % 251 AS BIGINT) AS checksum8 FROM k"""

_NAMES = f"WITH k AS (SELECT {bytes_of('h')} AS b FROM (SELECT hex(encode(c_name)) AS h FROM customer)) "
SHARDS = _NAMES + f"SELECT CAST({folded(fnv('b'), 8)} AS INTEGER) AS shard, count(*) AS n FROM k GROUP BY 1"
BUCKETS = _NAMES + f"SELECT CAST({folded(murmur('b'), 101)} AS BIGINT) AS bucket, count(*) AS n FROM k GROUP BY 1"

CODECS = f"""WITH k AS (SELECT log_id, seq, rec_key, coalesce(rec_value, '') AS v FROM update_log WHERE rec_key IS NOT NULL)
SELECT log_id, {varint('seq')} AS varint, {varint('strlen(rec_key)')} || hex(encode(rec_key)) || {varint('strlen(v)')} || hex(encode(v)) AS pair,
  rec_key AS first, rec_key AS unescaped, rec_key AS unquoted FROM k"""


def _number(i: str) -> str:
    """The i-th varint of an entry: its bytes lie between the ends of the one before and its own."""
    return f"list_reduce(list_prepend(CAST(0 AS UBIGINT), list_slice(b, CASE WHEN {i} = 1 THEN 2 ELSE ends[{i} - 1] + 1 END, ends[{i}])), lambda n, x: n * 128 + (x & 127))"


ENTRIES = f"""WITH m AS (SELECT msg_id, hex(message) AS h, {bytes_of('hex(message)')} AS b FROM log_messages),
e AS (SELECT *, CASE b[1] WHEN 161 THEN 'SET' WHEN 162 THEN 'REMOVE' WHEN 163 THEN 'CLEAR' END AS kind,
  CASE b[1] WHEN 161 THEN 4 WHEN 162 THEN 3 WHEN 163 THEN 2 END AS n, list_filter(range(2, len(b) + 1), lambda i: b[i] < 128) AS ends FROM m),
v AS (SELECT *, len(b) >= 3 AND kind IS NOT NULL AND len(ends) >= n AS whole FROM e),
f AS (SELECT *, CASE WHEN whole THEN {_number('1')} END AS s, CASE WHEN whole THEN {_number('2')} END AS d,
  CASE WHEN whole AND n > 2 THEN {_number('3')} END AS ks, CASE WHEN whole AND n > 3 THEN {_number('4')} END AS vs FROM v),
g AS (SELECT *, coalesce(whole AND (n = 2 OR CAST(ks AS HUGEINT) + coalesce(vs, 0) = len(b) - ends[n]), false) AS ok FROM f)
SELECT msg_id, CASE WHEN ok THEN 'SUCCESS' ELSE 'BROKEN_DATA_ERROR' END AS status, CASE WHEN ok THEN kind END AS op,
  CASE WHEN ok THEN CAST(s AS INTEGER) END AS server_id, CASE WHEN ok THEN CAST(d AS INTEGER) END AS dbm_index,
  CASE WHEN ok AND n > 2 THEN substr(h, 2 * ends[n] + 1, CAST(2 * ks AS BIGINT)) END AS key,
  CASE WHEN ok AND n > 3 THEN substr(h, 2 * (ends[n] + CAST(ks AS BIGINT)) + 1, CAST(2 * vs AS BIGINT)) END AS value FROM g"""
