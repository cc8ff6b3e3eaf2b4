"""String functions as Spark expressions; ASCII rules and byte offsets where those are meant.

Null input gives null everywhere, unless a default is asked for. All run inside code generation
but the few at the end, which need byte-wise rewriting and are Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from itertools import islice

import pandas as pd
from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

LOWER = "abcdefghijklmnopqrstuvwxyz"
UPPER = LOWER.upper()
_GAP = r"^[\x00-\x20]*"
# Spellings of truth values.
TRUE_WORDS = ("true", "t", "yes", "y", "1")
FALSE_WORDS = ("false", "f", "no", "n", "0")
# Multipliers of metric suffixes; with an i they are powers of 1024.
METRIC = {"k": 1, "m": 2, "g": 3, "t": 4, "p": 5, "e": 6}

I64_MIN, I64_MAX = -(2**63), 2**63 - 1


def lit(x: Column | str) -> Column:
    return F.lit(x) if isinstance(x, str) else x


def lower_ascii(s: Column) -> Column:
    return F.translate(s, UPPER, LOWER)


def upper_ascii(s: Column) -> Column:
    return F.translate(s, LOWER, UPPER)


def byte_view(s: Column) -> Column:
    """A string with one character per UTF-8 byte: offsets and distances on it count bytes."""
    return F.decode(s.cast("binary"), "ISO-8859-1")


# Numbers and truth values


def _saturate(n: Column) -> Column:
    return F.when(n > F.lit(I64_MAX), F.lit(I64_MAX)).when(n < F.lit(I64_MIN), F.lit(I64_MIN)).otherwise(n.try_cast("long"))


def to_int(s: Column, default: int = 0) -> Column:
    """Leading decimal integer; blanks may stand before and after the sign. No digits: default;
    beyond 64 bits: the nearest 64-bit integer."""
    p = _GAP + r"([-+]?)[\x00-\x20]*([0-9]+)"
    digits = F.regexp_replace(F.regexp_extract(s, p, 2), "^0+(?=.)", "")
    n = F.when(F.length(digits) > 19, F.lit("9" * 20)).otherwise(digits).try_cast("decimal(20,0)")
    n = F.when(F.regexp_extract(s, p, 1) == "-", -n).otherwise(n)
    return F.when(s.isNotNull(), F.coalesce(_saturate(n), F.lit(default).cast("long")))


def to_int_metric(s: Column, default: int = 0) -> Column:
    """As :func:`to_int`, with a fraction and a suffix k, m, g, t, p or e (1000) or ki, mi ... (1024).

    Exact, cut off towards zero; of a fraction the first 18 digits count, which is all of it that
    can matter to suffixes of 1000."""
    p = _GAP + r"([-+]?)[\x00-\x20]*([0-9]*)(?:\.([0-9]*))?[\x00-\x20]*([kKmMgGtTpPeE]?)([iI]?)"
    whole, frac = F.regexp_extract(s, p, 2), F.coalesce(F.regexp_extract(s, p, 3), F.lit(""))
    unit, binary = F.lower(F.regexp_extract(s, p, 4)), F.regexp_extract(s, p, 5) != ""
    power = F.lit(1)
    for u, e in METRIC.items():
        power = F.when(unit == u, F.when(binary, F.lit(1024**e)).otherwise(F.lit(1000**e))).otherwise(power)
    power = power.cast("decimal(19,0)")
    digits = F.regexp_replace(whole, "^0+", "")
    n = F.when(F.length(digits) > 19, F.lit("9" * 19)).when(digits == "", F.lit("0")).otherwise(digits).cast("decimal(19,0)") * power
    part = F.concat(F.lit("0."), F.left(frac, F.lit(18)), F.lit("0")).cast("decimal(18,18)") * power
    number = n + F.floor(part)
    signed = F.when(F.regexp_extract(s, p, 1) == "-", -number).otherwise(number)
    value = F.when((whole == "") & (frac == ""), F.lit(default).cast("long")).otherwise(_saturate(signed))
    return F.when(s.isNotNull(), value)


def to_int_oct(s: Column, default: int = 0) -> Column:
    """Leading octal digits; of more than 21 the last 21."""
    d = F.regexp_extract(s, _GAP + "([0-7]+)", 1)
    return F.when(s.isNotNull(), F.when(d == "", F.lit(default)).otherwise(F.conv(F.right(d, F.lit(21)), 8, -10).try_cast("long")))


def to_int_hex(s: Column, default: int = 0) -> Column:
    """Leading hexadecimal digits after an optional 0x, as a 64-bit pattern (the last 16 digits)."""
    d = F.regexp_extract(s, _GAP + "(?:0[xX])?([0-9a-fA-F]+)", 1)
    return F.when(s.isNotNull(), F.when(d == "", F.lit(default)).otherwise(F.conv(F.right(d, F.lit(16)), 16, -10).try_cast("long")))


def to_double(s: Column, default: float = 0.0) -> Column:
    """Leading real number, ``inf`` or ``nan`` in any case."""
    word = F.lower(F.regexp_extract(s, "(?i)" + _GAP + r"[-+]?(inf|nan)", 1))
    p = _GAP + r"([-+]?)[\x00-\x20]*([0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][\x00-\x20]*([-+]?)[\x00-\x20]*([0-9]+))?"
    sign = F.when(F.regexp_extract(s, _GAP + r"(-)", 1) == "-", -1.0).otherwise(1.0)
    exp = F.coalesce(F.nullif(F.regexp_extract(s, p, 4), F.lit("")), F.lit("0"))
    text = F.concat(F.regexp_extract(s, p, 2), F.lit("e"), F.coalesce(F.regexp_extract(s, p, 3), F.lit("")), exp)
    value = F.when(word == "inf", sign * F.lit(float("inf"))).when(word == "nan", F.lit(float("nan"))).otherwise(sign * text.try_cast("double"))
    return F.when(s.isNotNull(), F.coalesce(value, F.lit(float(default))))


def to_bool(s: Column, default: bool = False) -> Column:
    w = lower_ascii(strip(s))
    return F.when(w.isin(*TRUE_WORDS), True).when(w.isin(*FALSE_WORDS), False).when(s.isNotNull(), F.lit(default))


def to_int_or_bool(s: Column, default: int = 0) -> Column:
    w = lower_ascii(strip(s))
    return F.when(w.isin(*TRUE_WORDS), 1).when(w.isin(*FALSE_WORDS), 0).otherwise(to_int(s, default))


def double_to_string(x: Column) -> Column:
    """Six decimals without trailing zeros."""
    return F.regexp_replace(F.format_string("%.6f", x), r"\.?0+$", "")


# Taking apart and joining


def split_on(s: Column, delim: str, skip_empty: bool = False) -> Column:
    """Split at a delimiter; an empty one splits into characters. "" gives one empty element."""
    parts = F.split(s, "" if delim == "" else re.escape(delim), -1)
    if delim == "":
        parts = F.filter(parts, lambda x: x != "")
    return F.filter(parts, lambda x: x != "") if skip_empty else parts


def split_any(s: Column, chars: str, skip_empty: bool = False) -> Column:
    parts = F.split(s, "[" + re.escape(chars) + "]", -1)
    return F.filter(parts, lambda x: x != "") if skip_empty else parts


def split_map(s: Column, delim_records: str = ",", delim_kv: str = "=") -> Column:
    """Map of key and value; the first delimiter of a record counts, records without one are
    dropped, and of equal keys the first stays."""
    n = len(delim_kv)
    pairs = F.transform(
        F.filter(split_on(s, delim_records, True), lambda r: F.instr(r, delim_kv) > 0),
        lambda r: F.struct(F.substring(r, F.lit(1), F.instr(r, delim_kv) - 1).alias("k"), F.substring(r, F.instr(r, delim_kv) + n, F.length(r)).alias("v")),
    )
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.filter(pairs, lambda p: p["k"] == k)[0]["v"]))


def search_map(m: Column, key: str | Column, default: str | Column = "") -> Column:
    """The value of a key of a map, or the default; a null map has no keys."""
    return F.coalesce(F.try_element_at(m, lit(key)), lit(default))


def join(parts: Column, delim: str = ",") -> Column:
    return F.array_join(parts, delim)


# Replacing and trimming


def replace(s: Column, before: str, after: str) -> Column:
    return F.replace(s, F.lit(before), F.lit(after)) if before else s


def replace_characters(s: Column, before: str, after: str) -> Column:
    return F.translate(s, before, after)


def strip(s: Column) -> Column:
    return F.regexp_replace(s, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def strip_line(s: Column) -> Column:
    return F.regexp_replace(s, r"[\r\n]+$", "")


def squeeze_and_strip(s: Column) -> Column:
    return strip(F.regexp_replace(s, r"([\x00-\x20])[\x00-\x20]+", "$1"))


def trim_for_tsv(s: Column, keep_tab: bool = False) -> Column:
    return F.regexp_replace(s, r"[\x00-\x08\x0a-\x20\x7f]" if keep_tab else r"[\x00-\x20\x7f]", " ")


# Searching


def contains(s: Column, pattern: str) -> Column:
    return s.contains(F.lit(pattern))


def begins_with(s: Column, pattern: str) -> Column:
    return s.startswith(F.lit(pattern))


def ends_with(s: Column, pattern: str) -> Column:
    return s.endswith(F.lit(pattern))


def case_compare(a: Column, b: Column) -> Column:
    x, y = lower_ascii(a), lower_ascii(lit(b))
    return F.when(x < y, -1).when(x > y, 1).when(x == y, 0)


def search(s: Column, pattern: str) -> Column:
    """Byte offset of the first occurrence, or -1."""
    return F.instr(byte_view(s), byte_view(F.lit(pattern))) - 1


def case_search(s: Column, pattern: str) -> Column:
    return search(lower_ascii(s), pattern.translate(str.maketrans(UPPER, LOWER)))


def search_whole(s: Column, pattern: str, max_results: int = 0) -> Column:
    """Byte offsets of all occurrences, overlapping ones too; an empty pattern is everywhere but at the
    end. Linear in the text: one pass per value inside Arrow batches."""
    wanted = re.compile(b"(?s)(?=" + re.escape(pattern.encode()) + (b")" if pattern else b".)"))

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[int] | None:
            found = None if text is None else (m.start() for m in wanted.finditer(text.encode()))
            return None if found is None else list(islice(found, max_results or None))

        return texts.map(one)

    return run(s)


def search_batch(s: Column, patterns: Sequence[str]) -> Column:
    return F.array(*[search(s, p) for p in patterns])


def word_pattern(words: Sequence[str], fold: bool = False) -> str:
    """Java pattern of any of the words; an end matches unless both it and its neighbour outside
    are ASCII letters or digits."""
    any_of = "|".join(re.escape(w.translate(str.maketrans(UPPER, LOWER)) if fold else w) for w in words)
    return f"(?:(?<![0-9A-Za-z])|(?=[^0-9A-Za-z]))(?:{any_of})(?:(?![0-9A-Za-z])|(?<=[^0-9A-Za-z]))"


def word_search(s: Column, pattern: str) -> Column:
    return F.regexp_instr(byte_view(s), F.lit(word_pattern([pattern.encode().decode("latin-1")]))) - 1


def case_word_search(s: Column, pattern: str) -> Column:
    return word_search(lower_ascii(s), pattern.translate(str.maketrans(UPPER, LOWER)))


_BRACKET = re.compile(r"\[(\^?)(\]?)((?:\[:\w+:\]|[^\]])*)\]")
_CLASS = re.compile(r"\[:(\w+):\]")


def _named_class(m: re.Match) -> str:
    return "\\p{XDigit}" if m[1] == "xdigit" else f"\\p{{{m[1].capitalize()}}}"


def _from_basic(body: str) -> str:
    """A pattern of the basic POSIX grammar in Java's: groups and counts are escaped there, plus, question
    mark, bar, braces and parentheses are plain characters, as is a leading star, and so is a backslash
    between brackets."""
    out, at = [], 0
    while at < len(body):
        c = body[at]
        bracket = _BRACKET.match(body, at) if c == "[" else None
        if bracket:
            inner = re.sub(r"\[:\w+:\]|[\\\[&]", lambda m: m[0] if len(m[0]) > 1 else "\\" + m[0], bracket[3])
            out.append(f"[{bracket[1]}{'\\]' if bracket[2] else ''}{inner}]")
            at = bracket.end()
            continue
        if c == "\\" and at + 1 < len(body):
            out.append(body[at + 1] if body[at + 1] in "(){}" else body[at : at + 2])
            at += 2
            continue
        leading = not out or out[-1] in ("(", "^")
        out.append("\\" + c if c in "+?|(){}" or (c == "*" and leading) else c)
        at += 1
    return "".join(out)


def _compiles(pattern: str) -> bool:
    """Whether the engine that will run the pattern takes it: Java's, if a session is up."""
    context = SparkContext._active_spark_context
    try:
        if context is None:
            re.compile(pattern)
        else:
            context._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception:
        return False
    return True


def java_regex(pattern: str) -> str | None:
    """The pattern for Spark, its leading flags translated; None if it is bad.

    ``(?i...)`` folds the case of ASCII letters. Flavours: ``b`` is the basic POSIX grammar; ``a`` and
    ``e`` are read like the common one, of which the extended grammar is a part; in ``l`` a line feed
    parts alternatives."""
    m = re.match(r"\(\?([abeil]+)\)", pattern)
    body, flags = (pattern[m.end() :], m[1]) if m else (pattern, "")
    if "b" in flags:
        body = _from_basic(body)
    if "l" in flags:
        body = "|".join(body.split("\n"))
    java = ("(?i)" if "i" in flags else "") + _CLASS.sub(_named_class, body)
    return java if _compiles(java) else None


def search_regex(s: Column, pattern: str) -> Column:
    """Byte offset of the first match, -1 without one, -2 for a bad pattern. Text and pattern are
    matched byte by byte, so a dot is one byte."""
    java = java_regex(pattern)
    if java is None:
        return F.when(s.isNotNull(), F.lit(-2))
    return F.regexp_instr(byte_view(s), F.lit(java.encode().decode("latin-1"))) - 1


def replace_regex(s: Column, pattern: str, replacement: str) -> Column:
    """``$1`` and ``$&`` style replacement; a bad pattern gives ""."""
    java = java_regex(pattern)
    return F.lit("") if java is None else F.regexp_replace(s, java, replacement.replace("$&", "$0"))


def edit_distance(a: Column, b: Column | str, as_bytes: bool = False) -> Column:
    b = lit(b)
    return F.levenshtein(byte_view(a), byte_view(b)) if as_bytes else F.levenshtein(a, b)


# Encodings


def encode_base64(b: Column) -> Column:
    return F.regexp_replace(F.base64(b.cast("binary")), r"[\r\n]", "")


def decode_base64(s: Column) -> Column:
    """Bytes; characters outside the alphabet are skipped, all after the first padding is ignored;
    a cut-off group gives null."""
    return F.try_to_binary(F.regexp_extract(F.regexp_replace(s, "[^A-Za-z0-9+/=]", ""), "^[A-Za-z0-9+/]*=*", 0), F.lit("base64"))


def encode_url(s: Column) -> Column:
    """All but letters, digits and ``_-.~`` as lower-case hex escapes."""
    form = F.url_encode(s)
    for made, meant in (("+", "%20"), ("*", "%2a"), ("%7E", "~")):
        form = F.replace(form, F.lit(made), F.lit(meant))
    parts = F.split(form, "%", -1)
    lowered = F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lower(F.substring(p, 1, 2)), F.substring(p, F.lit(3), F.length(p)))))
    return F.array_join(lowered, "%")


def to_ucs4(s: Column) -> Column:
    """Code points."""
    return F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.ascii(c))


_HEX = b"0123456789abcdefABCDEF"
# One-letter escapes of control characters.
ESCAPES = {0x07: "a", 0x08: "b", 0x09: "t", 0x0A: "n", 0x0B: "v", 0x0C: "f", 0x0D: "r"}


def _escaped(text: str, non_ascii: bool) -> str:
    def one(m: re.Match) -> str:
        c = m[0]
        if c == "\\":
            return "\\\\"
        if c == "\0":
            return "\\x00" if m.end() < len(text) and text[m.end()] in "01234567" else "\\0"
        if ord(c) in ESCAPES:
            return "\\" + ESCAPES[ord(c)]
        return "".join(f"\\x{b:02x}" for b in c.encode())

    return re.sub(r"[\x00-\x1f\x7f\\]" + (r"|[^\x00-\x7f]" if non_ascii else ""), one, text)


_LETTERS = {v.encode(): bytes([k]) for k, v in ESCAPES.items()}


def _unescaped(text: str) -> str:
    def one(m: re.Match) -> bytes:
        e = m[1]
        if not e:
            return b""
        if e in _LETTERS:
            return _LETTERS[e]
        if e[:1] in b"xX":
            return bytes([int(e[1:] or b"0", 16)])
        if e[:1] in b"012345678":
            n = 0
            for d in e:
                n = n * 8 + d - 48
            return bytes([n & 255])
        return e

    return re.sub(rb"(?s)\\([xX][0-9a-fA-F]{0,2}|[0-8][0-7]{0,2}|.|\Z)", one, text.encode()).decode(errors="replace")


def _unquoted(text: str) -> str:
    def one(m: re.Match) -> bytes:
        e = m[0]
        if e == b"+":
            return b" "
        if e[:1] != b"%" or len(e) < 3:
            return b""
        high = int(e[1:2], 16) if e[1:2] in _HEX else 0
        return bytes([(high * 16 + int(e[2:3], 16)) & 255 if e[2:3] in _HEX else high])

    return re.sub(rb"(?s)%..|%.?|\+|[\x00-\x20\x7f-\xff]", one, text.encode()).decode(errors="replace")


def _mapped(fn, *args):
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else fn(x, *args))

    return run


def escape_c(s: Column, non_ascii: bool = False) -> Column:
    """Control characters and backslashes as C escapes, other than ASCII on request."""
    return _mapped(_escaped, non_ascii)(s)


def unescape_c(s: Column) -> Column:
    """Bytes that are no UTF-8 afterwards become replacement characters."""
    return _mapped(_unescaped)(s)


def decode_url(s: Column) -> Column:
    """``+`` is a blank; raw control and non-ASCII bytes are dropped; a malformed hex digit is 0."""
    return _mapped(_unquoted)(s)


def from_ucs4(points: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda p: None if p is None else "".join(map(chr, p)))

    return run(points)
