"""VBA operators and intrinsics as column expressions. Null stands for a value that stays unresolved."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SMALL = (-32768, 32767)


def small(c: Column) -> Column:
    """An integer result; unresolved outside 16 bits."""
    return F.when(c.between(*SMALL), c)


def add(a: Column, b: Column) -> Column:
    return small(a + b)


def subtract(a: Column, b: Column) -> Column:
    return small(a - b)


def multiply(a: Column, b: Column) -> Column:
    return small(F.try_multiply(a, b))


def exact_divide(a: Column, b: Column) -> Column:
    """The backslash operator, resolved only where it leaves no remainder."""
    safe = F.when(b != 0, b)
    return small(F.when(F.pmod(F.abs(a), F.abs(safe)) == 0, F.floor(a / safe).cast("long")))


def mod(a: Column, b: Column) -> Column:
    """Mod of a left side that isn't negative and a positive right one."""
    return F.when((a >= 0) & (b > 0), a % F.when(b > 0, b))


def bool_rank(b: Column) -> Column:
    """True is -1, so that False > True."""
    return F.when(b, -1).when(~b, 0)


def logical_imp(a: Column, b: Column) -> Column:
    return ~a | b


def logical_eqv(a: Column, b: Column) -> Column:
    return a == b


def logical_xor(a: Column, b: Column) -> Column:
    return a != b


def bitwise(op: str, a: Column, b: Column) -> Column:
    x = a.bitwiseXOR(b)
    return {"and": a.bitwiseAND(b), "or": a.bitwiseOR(b), "xor": x, "eqv": F.bitwise_not(x), "imp": F.bitwise_not(a).bitwiseOR(b)}[op]


def like_regex(pattern: str) -> str | None:
    """Java and RE2 regular expression of a Like pattern; None where the pattern isn't valid.

    ? is any character, # a digit, * any text, [list] and [!list] one character of a list with ranges; an
    empty list matches nothing and takes nothing.
    """
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "[":
            end = pattern.find("]", i + 1)
            if end < 0:
                return None
            body = pattern[i + 1 : end]
            if body:
                no, body = (body[0] == "!" and len(body) > 1), body[1:] if body[0] == "!" and len(body) > 1 else body
                out.append("[" + ("^" if no else "") + re.sub(r"([\\\[\]^&])", r"\\\1", body) + "]")
            i = end
        else:
            out.append({"?": ".", "#": "[0-9]", "*": ".*"}.get(c) or re.escape(c))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def like(c: Column, pattern: str) -> Column:
    found = like_regex(pattern)
    return F.lit(None).cast("boolean") if found is None else c.rlike(found.replace("$", r"\z") if found.endswith("$") else found)


def utf16_len(s: Column) -> Column:
    """Len: UTF-16 units."""
    return (F.octet_length(F.encode(s, "UTF-16LE")) / 2).cast("long")


def lenb(s: Column) -> Column:
    return F.octet_length(F.encode(s, "UTF-16LE")).cast("long")


def instr(start: Column, text: Column, find: Column) -> Column:
    """InStr with a binary comparison: an empty text gives 0, an empty find the start, a start past the end 0."""
    n = F.length(text)
    return F.when(start < 1, None).when(n == 0, 0).when(find == "", F.when(start <= n, start)).when(start > n, 0).otherwise(F.call_function("locate", find, text, start.cast("int"))).cast("long")


def instrrev(text: Column, find: Column, start: Column | None = None) -> Column:
    """InStrRev with a binary comparison; without a start, or with -1, from the end."""
    n = F.length(text)
    start = F.lit(-1) if start is None else start
    head = F.when(start == -1, text).when(start >= 1, F.left(text, start))
    back = F.call_function("locate", F.reverse(find), F.reverse(head))
    at = F.when(back > 0, F.length(head) - back - F.length(find) + 2).otherwise(0)
    return F.when(head.isNull(), None).when(n == 0, 0).when(start > n, 0).when(find == "", F.length(head)).otherwise(at).cast("long")


def left(s: Column, n: Column) -> Column:
    return F.when(n >= 0, F.left(s, n))


def right(s: Column, n: Column) -> Column:
    return F.when(n >= 0, F.right(s, n))


def mid(s: Column, start: Column, n: Column | None = None) -> Column:
    """Mid; a start below 1 or a negative length stays unresolved."""
    n = F.length(s) if n is None else n
    return F.when((start >= 1) & (n >= 0), F.substr(s, start, n))


def trim(s: Column) -> Column:
    return F.regexp_replace(s, "^ +| +$", "")


def ltrim(s: Column) -> Column:
    return F.regexp_replace(s, "^ +", "")


def rtrim(s: Column) -> Column:
    return F.regexp_replace(s, " +$", "")


def replace(s: Column, find: Column, to: Column, most: int = 16384) -> Column:
    """Replace; results of over `most` bytes stay unresolved."""
    out = F.when(find == "", s).otherwise(F.replace(s, find, to))
    return F.when(F.octet_length(out) <= most, out)


def hex_(n: Column) -> Column:
    return F.when(n >= 0, F.hex(n.cast("long")))


def oct_(n: Column) -> Column:
    return F.when(n >= 0, F.conv(n.cast("string"), 10, 8))


def chr_(n: Column) -> Column:
    return F.when(n.between(0, 127), F.chr(n))


def asc(s: Column) -> Column:
    return F.when(s != "", F.ascii(s))


def val(s: Column) -> Column:
    """Val of a leading decimal integer, 0 without one."""
    return F.coalesce(F.try_to_number(F.regexp_extract(s, r"^ *([+-]?[0-9]{1,9})", 1), F.lit("S999999999")).cast("long"), F.lit(0))


def bankers(x: Column) -> Column:
    """CInt, CLng: to the nearest integer, halves to the even one."""
    f = F.floor(x)
    d = x - f
    return F.when(d < 0.5, f).when(d > 0.5, f + 1).otherwise(f + F.pmod(f, F.lit(2))).cast("long")


def cint(x: Column) -> Column:
    return small(bankers(x))


def fix(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("long")


def int_(x: Column) -> Column:
    return F.floor(x).cast("long")


def sgn(x: Column) -> Column:
    return F.signum(x).cast("int")


def exact_sqrt(n: Column) -> Column:
    """Sqr of a perfect square; others stay unresolved."""
    r = F.round(F.sqrt(F.when(n >= 0, n))).cast("long")
    return F.when(r * r == n, r)


def date_serial(year: Column, month: Column, day: Column) -> Column:
    """DateSerial: years 100 to 9999, days 1 to 31; months are normalised and days spill into the next month."""
    first = F.add_months(F.make_date(year, F.lit(1), F.lit(1)), (month - 1).cast("int"))
    return F.when(year.between(100, 9999) & day.between(1, 31), F.date_add(first, (day - 1).cast("int")))


def ole_date(serial: Column) -> Column:
    """Date of a serial number of days since 1899-12-30."""
    return F.date_add(F.lit("1899-12-30").cast("date"), F.floor(serial).cast("int"))


def date_diff(interval: str, a: Column, b: Column) -> Column:
    """DateDiff of timestamps. Quarters and years are whole thirds and twelfths of the month difference."""
    secs = F.unix_timestamp(b) - F.unix_timestamp(a)
    day = lambda t: F.datediff(t, F.lit("1899-12-30").cast("date"))
    months = (F.year(b) * 12 + F.month(b)) - (F.year(a) * 12 + F.month(a))
    week = lambda t: F.floor((day(t) + 6) / 7)
    out = {"s": secs, "n": F.floor(secs / 60), "h": F.floor(secs / 3600), "d": day(b) - day(a), "ww": week(b) - week(a), "m": months, "q": F.floor(months / 3), "yyyy": F.floor(months / 12)}
    return out[interval].cast("long")


def fnv1a64(data: Column) -> Column:
    """FNV-1a 64 of bytes as 16 hex digits: a fold over two halves of 32 bits, so that nothing overflows."""
    hexed = F.hex(data)
    byte = F.transform(F.when(F.length(hexed) > 0, F.sequence(F.lit(1), F.length(hexed), F.lit(2))).otherwise(F.array().cast("array<int>")), lambda i: F.conv(F.substr(hexed, i, F.lit(2)), 16, 10).cast("long"))
    m32 = 0xFFFFFFFF
    prime_hi, prime_lo = 0x100, 0x1B3

    def step(acc, b):
        hi, lo = acc["hi"], acc["lo"].bitwiseXOR(b)
        low = lo * prime_lo
        high = hi * prime_lo + lo * prime_hi + F.shiftright(low, 32)
        return F.struct(high.bitwiseAND(F.lit(m32)).alias("hi"), low.bitwiseAND(F.lit(m32)).alias("lo"))

    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("hi"), F.lit(0x84222325).cast("long").alias("lo"))
    return F.aggregate(byte, start, step, lambda a: F.concat(F.lpad(F.hex(a["hi"]), 8, "0"), F.lpad(F.hex(a["lo"]), 8, "0")))
