"""Worksheet functions as column expressions, by family. Domain errors give null (an error value).

Arrays are rows of values (array<double>), matrices arrays of rows. Functions that Spark has under the same
name and meaning (ABS, SIN, EXP, ...) are used as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

D = lambda x: F.lit(float(x))


def _fold(values: Column, start, step, finish=None) -> Column:
    return F.aggregate(values, start, step, finish) if finish else F.aggregate(values, start, step)


def _range(a: Column, b: Column) -> Column:
    """a..b, empty if a > b."""
    return F.when(a <= b, F.sequence(a.cast("long"), b.cast("long"))).otherwise(F.array().cast("array<long>"))


# Text
def clean(s):
    return F.regexp_replace(s, r"[\x00-\x1F]", "")


def squeeze(s):
    """TRIM: no spaces at the ends, single ones inside."""
    return F.regexp_replace(F.regexp_replace(s, "^ +| +$", ""), " +", " ")


def rept(s, n):
    return F.when((n >= 0) & (F.length(s) * n <= 32767), F.repeat(s, n))


def find(needle, s, start=1):
    p = F.call_function("locate", needle, s, F.lit(start))
    return F.when(p > 0, p)


def search(needle, s, start=1):
    return find(F.lower(needle), F.lower(s), start)


def textbefore(s, d):
    return F.when(F.contains(s, d), F.call_function("substring_index", s, d, F.lit(1)))


def textafter(s, d):
    p = F.call_function("locate", d, s)
    return F.when(p > 0, F.substr(s, p + F.length(d)))


def textjoin(sep: str, values, skip_empty=True):
    v = F.filter(values, lambda x: x.isNotNull() & (x != "")) if skip_empty else F.transform(values, lambda x: F.coalesce(x, F.lit("")))
    return F.array_join(v, sep)


def encodeurl(s):
    return F.replace(F.replace(F.url_encode(s), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~"))


def numbervalue(s, decimal=".", group=","):
    t = F.replace(F.replace(F.regexp_replace(s, " ", ""), F.lit(group), F.lit("")), F.lit(decimal), F.lit("."))
    pct = F.length(t) - F.length(F.replace(t, F.lit("%"), F.lit("")))
    return F.when(t == "", 0.0).otherwise(F.replace(t, F.lit("%"), F.lit("")).try_cast("double") / F.pow(D(100), pct))


# Radix and bits
def dec2(n, base: int, digits=None):
    """DEC2HEX, DEC2BIN, DEC2OCT: two's complement of ten digits for negative numbers."""
    bits = {2: 10, 8: 30, 16: 40}[base]
    ok = (n >= -(2 ** (bits - 1))) & (n < 2 ** (bits - 1))
    s = F.conv(F.when(n < 0, n + 2**bits).otherwise(n).cast("string"), 10, base)
    return F.when(ok, s if digits is None else F.when(n < 0, s).when(F.length(s) <= digits, F.lpad(s, digits, "0")))


def to_dec(s, base: int):
    """HEX2DEC, BIN2DEC, OCT2DEC of at most ten digits."""
    bits = {2: 10, 8: 30, 16: 40}[base]
    valid = {2: "^[01]{1,10}$", 8: "^[0-7]{1,10}$", 16: "^[0-9A-Fa-f]{1,10}$"}[base]
    v = F.conv(F.when(s.rlike(valid), s), base, 10).cast("long")
    return F.when(v >= 2 ** (bits - 1), v - 2**bits).otherwise(v)


def base_text(n, base: int, least: int = 0):
    s = F.conv(F.when((n >= 0) & (n < 2**53), n).cast("string"), 10, base)
    return F.when(F.length(s) < least, F.lpad(s, least, "0")).otherwise(s) if least else s


def bit(op: str, a, b):
    ok = a.between(0, 2**48 - 1) & b.between(0, 2**48 - 1)
    return F.when(ok, {"and": a.bitwiseAND(b), "or": a.bitwiseOR(b), "xor": a.bitwiseXOR(b)}[op])


def bitshift(a, n: int):
    out = F.shiftleft(a, n) if n >= 0 else F.shiftright(a, -n)
    return F.when(a.between(0, 2**48 - 1) & (out < 2**48), out)


def roman(n):
    parts = ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))
    out, rest = F.lit(""), n
    for value, sign in parts:
        times = F.floor(rest / value).cast("int")
        out, rest = F.concat(out, F.repeat(F.lit(sign), times)), rest % value
    return F.when(n.between(0, 3999), out)


# Rounding
def trunc(x, n: int = 0):
    k = 10.0**n
    return F.when(x < 0, F.ceil(x * k)).otherwise(F.floor(x * k)) / D(k)


def roundup(x, n: int = 0):
    k = 10.0**n
    return F.signum(x) * F.ceil(F.abs(x) * k) / D(k)


def ceiling(x, step):
    return F.when(step == 0, 0.0).otherwise(F.ceil(x / step) * step).cast("double")


def floor(x, step):
    return F.when(step != 0, F.floor(x / step) * step).cast("double")


def even(x):
    return F.signum(x) * F.ceil(F.abs(x) / 2) * 2


def odd(x):
    up = F.ceil((F.abs(x) + 1) / 2) * 2 - 1
    return F.when(x < 0, -up).otherwise(up).cast("double")


def mround(x, step):
    return F.when(step == 0, 0.0).when(x * step >= 0, F.floor(F.abs(x / step) + 0.5) * F.abs(step) * F.signum(x)).cast("double")


def mod(a, b):
    return F.when(b != 0, a - b * F.floor(a / b))


def quotient(a, b):
    return trunc(a / F.when(b != 0, b)).cast("long")


# Trigonometry without a namesake
def acot(x):
    return D(math.pi / 2) - F.atan(x)


def acoth(x):
    return F.when(F.abs(x) > 1, 0.5 * F.log((x + 1) / (x - 1)))


def atan2(x, y):
    """Excel's order of arguments is (x, y)."""
    return F.when((x != 0) | (y != 0), F.atan2(y, x))


# Combinatorics
def fact(n):
    return F.when(n >= 0, _fold(_range(F.lit(1), F.floor(n)), D(1), lambda a, k: a * k))


def factdouble(n):
    first = F.when(F.pmod(F.floor(n), F.lit(2)) == 0, 2).otherwise(1)
    seq = F.when(n >= first, F.sequence(first.cast("long"), F.floor(n).cast("long"), F.lit(2).cast("long"))).otherwise(F.array().cast("array<long>"))
    return F.when(n >= -1, _fold(seq, D(1), lambda a, k: a * k))


def combin(n, k):
    """n over k, multiplied up so that each step is a whole number."""
    seq = _range(F.lit(1), F.floor(k))
    return F.when((n >= 0) & (k >= 0) & (k <= n), _fold(seq, D(1), lambda a, i: F.round(a * (F.floor(n) - F.floor(k) + i) / i)))


def combina(n, k):
    return combin(n + k - 1, k)


def permut(n, k):
    return F.when((n >= 0) & (k >= 0) & (k <= n), _fold(_range(F.floor(n) - F.floor(k) + 1, F.floor(n)), D(1), lambda a, i: a * i))


def permutationa(n, k):
    return F.pow(n.cast("double"), k)


def gcd(a, b):
    """By Euclid; 92 steps are enough for 64 bits."""
    end = F.aggregate(F.sequence(F.lit(1), F.lit(92)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), lambda s, _: F.struct(F.when(s["b"] == 0, s["a"]).otherwise(s["b"]).alias("a"), F.when(s["b"] == 0, F.lit(0).cast("long")).otherwise(s["a"] % F.when(s["b"] == 0, F.lit(1)).otherwise(s["b"])).alias("b")))
    return F.when((a >= 0) & (b >= 0), end["a"])


def lcm(a, b):
    g = gcd(a, b)
    return F.when(g == 0, 0).otherwise(a / F.when(g == 0, 1).otherwise(g) * b).cast("long")


# Sums over arrays
def sumproduct(x, y):
    return _fold(F.zip_with(x, y, lambda a, b: a * b), D(0), lambda a, v: a + v)


def sumx2my2(x, y):
    return _fold(F.zip_with(x, y, lambda a, b: a * a - b * b), D(0), lambda a, v: a + v)


def sumx2py2(x, y):
    return _fold(F.zip_with(x, y, lambda a, b: a * a + b * b), D(0), lambda a, v: a + v)


def sumxmy2(x, y):
    return _fold(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), D(0), lambda a, v: a + v)


def sumsq(x):
    return _fold(x, D(0), lambda a, v: a + v * v)


def seriessum(x, n, m, coefficients):
    return _fold(F.transform(coefficients, lambda c, i: c * F.pow(x, n + i * m)), D(0), lambda a, v: a + v)


# Array shapes
def take(x, n: int):
    return F.slice(x, 1, n) if n >= 0 else F.when(F.size(x) > -n, F.slice(x, n, -n)).otherwise(x)


def drop(x, n: int):
    return F.when(F.size(x) > n, F.slice(x, F.lit(n + 1), F.size(x) - n)).otherwise(F.slice(x, 1, 0))


def wraprows(x, n: int):
    starts = F.sequence(F.lit(0), F.floor((F.size(x) - 1) / n).cast("int"))
    return F.transform(starts, lambda i: F.slice(x, i * n + 1, F.lit(n)))


def transpose(m):
    return F.transform(F.sequence(F.lit(1), F.size(m[0])), lambda j: F.transform(m, lambda r: F.element_at(r, j)))


def sequence(rows: int, start=1, step=1):
    return F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda i: i * step + start)


# Lookup in arrays
def match_exact(x, values):
    p = F.array_position(values, x)
    return F.when(p > 0, p)


def match_below(x, values):
    """Place of the last of ascending values that isn't above x."""
    n = F.size(F.filter(values, lambda v: v <= x))
    return F.when(n > 0, n)


def index(values, i):
    return F.try_element_at(values, i.cast("int"))


# Distributions
def binom_pmf(k, n, p):
    return combin(n, k) * F.pow(p, k) * F.pow(1 - p, n - k)


def poisson_pmf(k, mean):
    return F.exp(-mean) * F.pow(mean, k) / fact(k)


def hypgeom_pmf(k, n, successes, population):
    return combin(successes, k) * combin(population - successes, n - k) / combin(population, n)


def norm_pdf(x, mean, sd):
    return F.exp(-((x - mean) * (x - mean)) / (2 * sd * sd)) / (sd * math.sqrt(2 * math.pi))


def expon_cdf(x, rate):
    return F.when(x >= 0, 1 - F.exp(-rate * x))


def weibull_cdf(x, shape, scale):
    return F.when(x >= 0, 1 - F.exp(-F.pow(x / scale, shape)))


def standardize(x, mean, sd):
    return F.when(sd > 0, (x - mean) / sd)


# Finance
def sln(cost, salvage, life):
    return (cost - salvage) / F.when(life != 0, life)


def syd(cost, salvage, life, per):
    return (cost - salvage) * (life - per + 1) * 2 / (life * (life + 1))


def pv(rate, nper, pmt):
    q = F.pow(1 + rate, nper)
    return F.when(rate == 0, -pmt * nper).otherwise(-pmt * (q - 1) / (F.when(rate == 0, 1.0).otherwise(rate) * q))


def fv(rate, nper, pmt, start=0.0):
    q = F.pow(1 + rate, nper)
    return F.when(rate == 0, -(start + pmt * nper)).otherwise(-(start * q + pmt * (q - 1) / F.when(rate == 0, 1.0).otherwise(rate)))


def pmt(rate, nper, value):
    q = F.pow(1 + rate, nper)
    return F.when(rate == 0, -value / nper).otherwise(-value * F.when(rate == 0, 1.0).otherwise(rate) * q / F.when(rate == 0, 1.0).otherwise(q - 1))


def ipmt(rate, per, nper, value):
    return fv(rate, per - 1, pmt(rate, nper, value), value) * rate


def ppmt(rate, per, nper, value):
    return pmt(rate, nper, value) - ipmt(rate, per, nper, value)


def npv(rate, flows):
    return _fold(F.transform(flows, lambda v, i: v / F.pow(1 + rate, i + 1)), D(0), lambda a, v: a + v)


def effect(nominal, npery):
    return F.when((nominal > 0) & (npery >= 1), F.pow(1 + nominal / npery, npery) - 1)


def nominal(effective, npery):
    return F.when((effective > 0) & (npery >= 1), (F.pow(1 + effective, 1 / npery) - 1) * npery)


def fvschedule(value, rates):
    return _fold(rates, value, lambda a, r: a * (1 + r))


def mirr(flows, finance, reinvest):
    n = F.size(flows)
    plus = _fold(F.transform(flows, lambda v, i: F.when(v > 0, v * F.pow(1 + reinvest, n - 1 - i)).otherwise(0.0)), D(0), lambda a, v: a + v)
    minus = _fold(F.transform(flows, lambda v, i: F.when(v < 0, v / F.pow(1 + finance, i)).otherwise(0.0)), D(0), lambda a, v: a + v)
    return F.when((plus > 0) & (minus < 0), F.pow(plus / -minus, D(1) / (n - 1)) - 1)


def disc(days, price, redemption):
    return (redemption - price) / redemption * 360 / days


def tbill_price(days, discount):
    return F.when(days.between(1, 366), 100 * (1 - discount * days / 360))


def tbill_yield(days, price):
    return (100 - price) / price * 360 / days


def dollarde(x, fraction: int):
    whole = trunc(x)
    return whole + (x - whole) * 10.0 ** math.ceil(math.log10(fraction)) / fraction


def dollarfr(x, fraction: int):
    whole = trunc(x)
    return whole + (x - whole) * fraction / 10.0 ** math.ceil(math.log10(fraction))


# Cell addresses
def column_label(n):
    """A..XFD of a column's number from 1, and on beyond a sheet's columns."""
    # The digit of 26**k stands from the number on whose digits all are A; 14 digits are those of a long.
    n, out = n.cast("long"), []
    for k in reversed(range(14)):
        least = (26 ** (k + 1) - 1) // 25
        digit = F.pmod(F.call_function("div", n - least, F.lit(26**k)), F.lit(26))
        out.append(F.when(n >= least, F.chr(F.lit(65) + digit)).otherwise(""))
    return F.when(n >= 1, F.concat(*out))


def column_number(label):
    """The number of a label of any length, null where it is beyond a long."""
    letters = F.transform(F.split(F.upper(label), ""), lambda c: F.ascii(c) - 64)
    return F.when(label.rlike("^[A-Za-z]+$"), _fold(letters, F.lit(0).cast("long"), lambda acc, v: F.when(v > 0, F.try_add(F.try_multiply(acc, F.lit(26)), v)).otherwise(acc)))
