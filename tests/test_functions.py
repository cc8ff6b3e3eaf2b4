"""Golden values of the scalar functions."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from keyweave.functions import codecs as C
from keyweave.functions import hashes as H
from keyweave.functions import strings as S
from keyweave.functions import times as T

HELLO, WORLD = "Hello World", "こんにちは世界"


def one(spark, fn, values, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    return [r[0] for r in df.select(fn(F.col("x"))).collect()]


STRINGS = [
    (lambda c: S.to_int(c), {"": 0, "a": 0, "01": 1, " - 10 ": -10, "1230abc": 1230, "+5": 5, "9" * 30: 2**63 - 1, "-" + "9" * 25: -(2**63), None: None}),
    (lambda c: S.to_int(c, -7), {"x": -7, "-": -7}),
    (lambda c: S.to_int_metric(c), {"1k": 1000, "1ki": 1024, "0.5k": 500, "-.25k": -250, "2 M": 2_000_000, "9007199254740993": 9007199254740993, "x": 0, "20E": 2**63 - 1}),
    (lambda c: S.to_int_oct(c), {"17": 15, " 7x": 7, "9": 0}),
    (lambda c: S.to_int_hex(c), {"0xff": 255, "FF": 255, "ffffffffffffffff": -1, "g": 0, "0x": 0}),
    (lambda c: S.to_double(c), {"1.5": 1.5, " - 2.25x": -2.25, "1e3": 1000.0, ".5": 0.5, "-inf": -math.inf, "x": 0.0, "12.": 12.0, "5e-1": 0.5}),
    (lambda c: S.to_bool(c), {" TRUE ": True, "y": True, "No": False, "maybe": False, None: None}),
    (lambda c: S.to_int_or_bool(c), {"yes": 1, "f": 0, "12": 12}),
    (lambda c: S.double_to_string(c.cast("double")), {"1.5": "1.5", "2": "2", "0.1234567": "0.123457", "-100": "-100"}),
    (lambda c: S.upper_ascii(c), {"aébc": "AéBC"}),
    (lambda c: S.lower_ascii(c), {"AÉBC": "aÉbc"}),
    (lambda c: S.split_on(c, ","), {"": [""], "a,,b,": ["a", "", "b", ""]}),
    (lambda c: S.split_on(c, ",", True), {"": [], "a,,b,": ["a", "b"]}),
    (lambda c: S.split_on(c, "::"), {"a::b": ["a", "b"]}),
    (lambda c: S.split_any(c, ",-]"), {"a,b-c]d": ["a", "b", "c", "d"]}),
    (lambda c: S.split_map(c, ",", "="), {"a=1,b=2=3,c,a=9": {"a": "1", "b": "2=3"}, "": {}}),
    (lambda c: S.replace(c, "aa", "b"), {"aaaaa": "bba"}),
    (lambda c: S.replace(c, "", "b"), {"x": "x"}),
    (lambda c: S.replace_characters(c, "abc", "x"), {"aabbccd": "xxd"}),
    (lambda c: S.strip(c), {" \t a b \n": "a b"}),
    (lambda c: S.strip_line(c), {"ab\r\n\n": "ab"}),
    (lambda c: S.squeeze_and_strip(c), {"  a \t b  ": "a b", "a\t \tb": "a\tb"}),
    (lambda c: S.trim_for_tsv(c), {"a\tb\nc\x7f": "a b c "}),
    (lambda c: S.trim_for_tsv(c, True), {"a\tb\nc": "a\tb c"}),
    (lambda c: S.search(c, "世"), {"こ世": 3, "abc": -1}),
    (lambda c: S.case_search(c, "ABC"), {"xaBc": 1}),
    (lambda c: S.search_whole(c, "aa"), {"aaaa": [0, 1, 2], "b": [], "": []}),
    (lambda c: S.search_whole(c, "aa", 2), {"aaaa": [0, 1]}),
    (lambda c: S.search_whole(c, ""), {"abc": [0, 1, 2], None: None}),
    (lambda c: S.search_whole(c, "本本"), {"日本本本": [3, 6]}),
    (lambda c: S.search_batch(c, ["b", "z"]), {"abc": [1, -1]}),
    (lambda c: S.word_search(c, "hop"), {"hop step jump": 0, "hops": -1, "a-hop_": 2}),
    (lambda c: S.word_search(c, " step "), {"hop step jump": 3}),
    (lambda c: S.word_search(c, "ste"), {"hop step jump": -1}),
    (lambda c: S.case_word_search(c, "STEP"), {"hop Step jump": 4}),
    (lambda c: S.search_regex(c, "(?i)B+"), {"abb": 1, "x": -1}),
    (lambda c: S.search_regex(c, "("), {"abb": -2, None: None}),
    (lambda c: S.search_regex(c, "(?P<x>a)"), {"abb": -2}),
    (lambda c: S.search_regex(c, "abc"), {"日本語abc": 9, "äbc": -1, None: None}),
    (lambda c: S.search_regex(c, "語."), {"日本語abc": 6}),
    (lambda c: S.search_regex(c, "(?b)a+b"), {"aab": -1, "xa+b": 1}),
    (lambda c: S.search_regex(c, r"(?b)\(a\{2\}\)|*"), {"xaa|": 1, "xa|": -1, "aa|||": 0}),
    (lambda c: S.search_regex(c, r"(?b)[]\x]"), {"ab": -1, "a]": 1, "a\\": 1}),
    (lambda c: S.search_regex(c, "(?l)q\nb+"), {"abb": 1, "x": -1}),
    (lambda c: S.search_regex(c, "[[:digit:]]+[[:xdigit:]]"), {"ab12f": 2}),
    (lambda c: S.replace_regex(c, "(b)(c)", "$2$1"), {"abcd": "acbd"}),
    (lambda c: S.replace_regex(c, "(", ""), {"x": ""}),
    (lambda c: S.edit_distance(c, "abc"), {"abxc": 1, "": 3}),
    (lambda c: S.edit_distance(c, "x", True), {"あ": 3}),
    (lambda c: S.encode_base64(c), {"Hello": "SGVsbG8=", "x" * 60: "eHh4" * 20}),
    (lambda c: S.decode_base64(c).cast("string"), {"SGVs bG8=": "Hello", "": ""}),
    (lambda c: S.encode_url(c), {"a b~*/あ": "a%20b~%2a%2f%e3%81%82", "": ""}),
    (lambda c: S.decode_url(c), {"a%20b+c%e3%81%82": "a b cあ", "%4z": "\x04", "%": "", "a\nb": "ab"}),
    (lambda c: S.escape_c(c), {"a\tb\\\x01\0": "a\\tb\\\\\\x01\\0", "\x007": "\\x007", "é": "é"}),
    (lambda c: S.escape_c(c, True), {"é": "\\xc3\\xa9"}),
    (lambda c: S.unescape_c(c), {"a\\tb\\\\\\x41\\101\\": "a\tb\\AA", "\\q": "q"}),
    (lambda c: S.from_ucs4(S.to_ucs4(c)), {WORLD: WORLD, "": ""}),
    (lambda c: S.case_compare(c, "ABC"), {"abc": 0, "abd": 1, "ab": -1}),
]


@pytest.mark.parametrize("i", range(len(STRINGS)))
def test_strings(spark, i):
    fn, want = STRINGS[i]
    assert one(spark, fn, list(want)) == list(want.values())


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(blacklist_categories=["Cs"]), max_size=20), min_size=1, max_size=20))
def test_escape_round_trip(spark, texts):
    assert one(spark, lambda c: S.unescape_c(S.escape_c(c)), texts) == texts
    assert one(spark, lambda c: S.decode_url(S.encode_url(c)), texts) == texts


def cyclic(n):
    return bytes(i % 256 for i in range(n))


# Known results for two texts.
HASHES = {
    ("murmur", 64): (0x15941D6097FA1378, 0x4C6A0FFD2F090C3A), ("fnv", 64): (0x9AA143013F1E405F, 0x8609C402DAD8A1EF),
    ("checksum", 6): (0x0F, 0x04), ("checksum", 8): (0x30, 0x96), ("adler", 6): (0x13, 0x14), ("adler", 8): (0x60, 0x2C),
    ("adler", 16): (0x8331, 0x9B97), ("adler", 32): (0x180B041D, 0x9D7B0E51), ("crc", 4): (0x9, 0xE), ("crc", 8): (0x25, 0xB7),
    ("crc", 16): (0x992A, 0xF802), ("crc", 32): (0x4A17B156, 0x75197186),
}


@pytest.mark.parametrize("name,bits", list(HASHES))
def test_hashes(spark, name, bits):
    fn = {
        "murmur": lambda c: C.unsigned(H.hash_murmur(c)), "fnv": lambda c: C.unsigned(H.hash_fnv(c)),
        "checksum": lambda c: H.checksum(c, bits), "adler": lambda c: H.adler(c, bits), "crc": lambda c: H.crc(c, bits),
    }[name]
    got = one(spark, fn, [HELLO, None, WORLD, "", "x" * 70_000])
    assert (int(got[0]), int(got[2])) == HASHES[name, bits] and got[1] is None


def test_hash_batches_mix_lengths():
    values = [cyclic(n) for n in (0, 1, 7, 8, 9, 15, 16, 17, 63, 64, 65, 1000)]
    assert H.murmur(values).tolist() == [int(H.murmur([v])[0]) for v in values]
    assert H.fnv(values).tolist() == [int(H.fnv([v])[0]) for v in values]


def test_places(spark):
    assert int(one(spark, lambda c: C.unsigned(H.bucket_of(c, 2**64 - 1)), ["abc"])[0]) == 16973900370012003622
    assert one(spark, lambda c: H.shard_of(c, 2**64 - 1), ["abc"]) == [1765794342254572867]
    assert one(spark, lambda c: H.shard_of(c, 2**32 - 1), ["abc"]) == [702176507]


LONGS = [0, 1, -1, 127, 128, 300, -300, 2**40, 2**63 - 1, -(2**63), None]


def test_codecs(spark):
    assert one(spark, lambda c: F.hex(C.int_to_big_endian(c)), [1, -1], "long") == ["0000000000000001", "F" * 16]
    assert one(spark, lambda c: C.big_endian_to_int(C.int_to_big_endian(c)), LONGS, "long") == LONGS
    assert one(spark, lambda c: C.big_endian_to_int(c), [b"", b"\x01\x00"], "binary") == [0, 256]
    for z in (False, True):
        assert one(spark, lambda c: C.varint_to_int(C.int_to_varint(c, z), z), LONGS, "long") == LONGS
    doubles = [0.0, -1.5, math.inf, None]
    for size in (8, 16):
        assert one(spark, lambda c: C.big_endian_to_float(C.float_to_big_endian(c, size)), doubles, "double") == doubles
    wide = one(spark, lambda c: F.hex(C.float_to_big_endian(c, 16)), [1.0, -2.5, 5e-324, 0.0, math.inf], "double")
    assert wide == ["0" * 12 + x for x in ("3FFF8000000000000000", "C000A000000000000000", "3BCD8000000000000000", "0" * 20, "7FFF8000000000000000")]
    lists = [["a", "", WORLD], [], None]
    got = one(spark, lambda c: F.transform(C.deserialize_list(C.serialize_list(c)), lambda b: b.cast("string")), lists, "array<string>")
    assert got == lists
    maps = [{"b": "2", "a": "1"}, {}, None]
    back = one(spark, lambda c: F.transform(F.map_entries(C.deserialize_map(C.serialize_map(c))), lambda e: F.concat(e["key"].cast("string"), e["value"].cast("string"))), maps, "map<string,string>")
    assert back == [["a1", "b2"], [], None]
    numbers = [[1, -2, 2**40], [], None]
    assert one(spark, lambda c: C.deserialize_numbers(C.serialize_numbers(c)), numbers, "array<long>") == numbers
    assert one(spark, lambda c: C.deserialize_varints(C.serialize_varints(c, True), True), numbers, "array<long>") == numbers
    pair = one(spark, lambda c: C.deserialize_pair(C.serialize_pair(c, F.lit("z"))), ["k"])
    assert (bytes(pair[0].first), bytes(pair[0].second)) == (b"k", b"z")


@pytest.mark.parametrize("codec", ["none", "zlib", "zstd", "lz4", "lzma"])
def test_compression(spark, codec):
    values = [b"", b"abc" * 1000, None]
    got = one(spark, lambda c: C.decompress(C.compress(c, codec), codec), values, "binary")
    assert [g if g is None else bytes(g) for g in got] == values
    assert one(spark, lambda c: C.decompress(c, codec), [b"broken data"], "binary") == [None]


def test_varint_bytes():
    assert C.put_varint(0) == b"\x00" and C.put_varint(127) == b"\x7f" and C.put_varint(128) == b"\x81\x00"
    assert C.get_varint(b"\x81") == (0, 0) and C.get_varint(b"x\x81\x00", 1) == (128, 3)


def test_times(spark):
    def fmt(fn, v):
        return one(spark, fn, [v], "double")[0]

    assert fmt(lambda c: T.format_simple(c), 0.0) == "1970/01/01 00:00:00"
    assert fmt(lambda c: T.format_simple(c, 32400, 4), 256037405.25) == "1978/02/11 18:30:05.2500"
    assert fmt(lambda c: T.format_w3c(c), 0.0) == "1970-01-01T00:00:00Z"
    assert fmt(lambda c: T.format_w3c(c, 32400, 4), 256037405.25) == "1978-02-11T18:30:05.2500+09:00"
    assert fmt(lambda c: T.format_rfc1123(c), 0.0) == "Thu, 01 Jan 1970 00:00:00 GMT"
    assert fmt(lambda c: T.format_rfc1123(c, 32400), 256037405.0) == "Sat, 11 Feb 1978 18:30:05 +0900"
    assert fmt(lambda c: T.day_of_week(F.lit(1978), F.lit(2), F.lit(12)), 0.0) == 0
    cal = fmt(lambda c: T.calendar(c, 32400), 256037405.0)
    assert (cal.year, cal.month, cal.day, cal.hour, cal.weekday) == (1978, 2, 11, 18, 6)
    assert [one(spark, T.relative_expr, [v], "double")[0] for v in (-172800.0, 5400.0, 90.0, 1.5)] == ["-2.0 days", "1.5 hours", "1.5 minutes", "1.5 seconds"]


# Dates and their seconds.
DATES = {
    "0x123": 0x123, " 0XABCD": 0xABCD, " -0123": -123, "10 s ": 10, "-10 m": -600, "10.5h": 37800, "10d": 864000, "1970-01-01T00:00:00": 0,
    "1970-01-01T10:10:10": 36610, "1970-01-01T09:10:10+09:10": 10, "1970-01-01T00:00:00-12:30": 45000, "1970/01/01 01:01:06.75": 3666.75,
    "1978/02/11 18:30:05.2500+09:00": 256037405.25, "Thu, 01 Jan 1970": 0, "Sat, 11 Feb 1978": 256003200, "Thu, 01 Jan 1970 00:00:00 GMT": 0,
    "Thu, 01 Jan 1970 00:00:00 JST": -32400, "Thu, 01 Jan 1970 00:00:00 PST": 28800, "Sat, 11 Feb 1978 18:30:05 +0900": 256037405,
}


def test_parse_dates(spark):
    assert one(spark, T.parse_date, list(DATES)) == pytest.approx([float(v) for v in DATES.values()])
    assert all(math.isnan(v) for v in one(spark, T.parse_date, ["", "hello", "1970-13-01", "Thu, 01 Foo 1970"]))
    assert one(spark, T.parse_digits, ["1970-01-01 00:00:10", "1978", "19780211"]) == [10.0, 252460800.0, 256003200.0]
    assert math.isnan(one(spark, T.parse_digits, ["12"])[0])
    base = F.lit(1632552223000)
    assert one(spark, lambda c: T.parse_relative(c, base), ["-7D", "+0.5H", "1000", "5s"]) == [1631947423000, 1632554023000, 1000, 5000]


def metric(text):
    """Brute force, one character at a time, in whole numbers."""
    if text is None:
        return None
    i, whole, frac, sign = 0, "", "", 1

    def blanks(i):
        while i < len(text) and text[i] <= " ":
            i += 1
        return i

    i = blanks(0)
    if text[i : i + 1] in ("-", "+"):
        sign, i = (-1 if text[i] == "-" else 1), i + 1
    i = blanks(i)
    while text[i : i + 1] and text[i] in "0123456789":
        whole, i = whole + text[i], i + 1
    if text[i : i + 1] == ".":
        i += 1
        while text[i : i + 1] and text[i] in "0123456789":
            frac, i = frac + text[i], i + 1
    if not whole and not frac:
        return 0
    i = blanks(i)
    unit = "kmgtpe".find(text[i : i + 1].lower()) + 1 if text[i : i + 1] else 0
    power = (1024 if text[i + 1 : i + 2] in ("i", "I") else 1000) ** unit
    n = int((whole + frac) or "0") * power // 10 ** len(frac)
    return max(-(2**63), min(2**63 - 1, sign * n))


def test_metric_numbers_of_all_spellings(spark):
    numbers = ["7", "0", "2404.06", "1.001", "2.3", "0.001", ".5", "12.", "3036401066", "0009", "9007199254740993", "9223372036854775807", "9223372036854775808", "9" * 25, "0.999999999999999999", "", "."]
    units = ["", *[b + i for b in "kmgtpeKMGTPE" for i in ("", "i", "I")], "x", "i", ":1"]
    values = [None, *[f"{sign}{n}{gap}{u}" for sign in ("", "-", "+", " - ", "\t") for n in numbers for gap in ("", " ") for u in units]]
    for v, got in zip(values, one(spark, S.to_int_metric, values)):
        assert got == metric(v), repr(v)


def test_metric_query_runs_over_every_row(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/update_log.parquet").select("log_id", "rec_value").collect()
    got = {r.log_id: r.metric for r in entry.queries()["to_metric_values"](spark, "/root/testdata/sf0.01").collect()}
    assert got == {r.log_id: metric(r.rec_value) for r in rows}
    assert len(got) == len(rows) and any(r.rec_value and "." in r.rec_value for r in rows)


def test_search_query_counts_bytes_of_every_key(spark, tmp_path):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    def word_at(b, word=b"lease"):
        alnum = lambda x: x.isalnum()  # noqa: E731 (ASCII, on bytes)
        free = lambda i: not (alnum(b[i - 1 : i]) or alnum(b[i + len(word) : i + len(word) + 1]))
        return next((i for i in range(len(b)) if b[i:].startswith(word) and free(i)), -1)

    keys = ["größe:22251", "größe lease:100", "éléase lease", "leaseé", "élease", "größe:leases", "sess/härbour-46", "sess/harbour-46", "世界 0 lease 00", "lease", "", None]
    spark.createDataFrame(list(enumerate(keys)), "log_id long, rec_key string").coalesce(1).write.parquet(f"{tmp_path}/update_log.parquet")
    got = {r.log_id: (r.word_at, r.zeros, r.distance) for r in entry.queries()["search_functions"](spark, str(tmp_path)).collect()}
    b = {i: k.encode() for i, k in enumerate(keys) if k is not None}
    assert got == {i: (word_at(k), k.count(b"0"), distance(k, b"sess/harbour-46")) for i, k in b.items()}


def test_int_query_keeps_every_row(spark, tmp_path):
    import oracle

    want = {" - 10 ": -10, "+ 7x": 7, "9" * 19: 2**63 - 1, "-" + "9" * 40: -(2**63), str(2**63 - 1): 2**63 - 1, "-" + str(2**63): -(2**63), "0" * 30 + "5": 5, "-": 0, "x1": 0, "": 0, "42.5": 42, None: None}
    spark.createDataFrame(list(enumerate(want)), "log_id long, rec_value string").coalesce(1).write.parquet(f"{tmp_path}/update_log.parquet")
    got = entry.queries()["to_int_values"](spark, str(tmp_path)).orderBy("log_id").collect()
    assert [r.as_int for r in got] == list(want.values())
    assert oracle.check(spark, "to_int_values", tmp_path) == len(want)
