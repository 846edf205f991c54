"""Queries of the scalar functions: VBA operators and intrinsics, worksheet functions by family."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamarack.functions import excel as X
from tamarack.functions import vba as V

INTS = (-40000, -7, -1, 0, 1, 2, 3, 7, 10, 255, 32767)
PAIRS = ", ".join(f"({a}, {b})" for a in INTS for b in (-3, 0, 2, 5, 12))


def _pairs(spark, sf_dir):
    """Pairs of chosen integers, and of part and line of each line item."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_partkey") * 37 - 900).alias("a"), (F.col("l_linenumber") - 3).cast("long").alias("b"))
    return spark.createDataFrame([(a, b) for a in INTS for b in (-3, 0, 2, 5, 12)], "a long, b long").unionAll(lines)


def integer_operators(spark, sf_dir):
    """Arithmetic in 16 bits, bitwise operators and rounding; unresolved results are -99999."""
    a, b = F.col("a"), F.col("b")
    n = lambda c: F.coalesce(c.cast("long"), F.lit(-99999))
    return _pairs(spark, sf_dir).select(
        "a", "b", n(V.add(a, b)).alias("add_"), n(V.multiply(a, b)).alias("mul"), n(V.exact_divide(a, b)).alias("div_"), n(V.mod(a, b)).alias("mod_"), *[n(V.bitwise(o, a, b)).alias("b" + o) for o in ("and", "or", "xor", "eqv", "imp")],
        n(V.cint(a / 2.0)).alias("cint_"), n(V.fix(a / 4.0)).alias("fix_"), n(V.int_(a / 4.0)).alias("int_"), n(V.sgn(a)).alias("sgn_"), n(V.exact_sqrt(a)).alias("sqr_"),
    )


_INTEGER = f"""
WITH v(a, b) AS (SELECT a::BIGINT, b::BIGINT FROM (VALUES {PAIRS}) t(a, b) UNION ALL SELECT l_partkey * 37 - 900, l_linenumber - 3 FROM lineitem)
SELECT a, b, coalesce(CASE WHEN a + b BETWEEN -32768 AND 32767 THEN a + b END, -99999)::BIGINT AS add_, coalesce(CASE WHEN a * b BETWEEN -32768 AND 32767 THEN a * b END, -99999)::BIGINT AS mul,
 coalesce(CASE WHEN b <> 0 AND a % nullif(b, 0) = 0 AND a // nullif(b, 0) BETWEEN -32768 AND 32767 THEN a // nullif(b, 0) END, -99999)::BIGINT AS div_, coalesce(CASE WHEN a >= 0 AND b > 0 THEN a % nullif(b, 0) END, -99999)::BIGINT AS mod_,
 a & b AS band, a | b AS bor, xor(a, b) AS bxor, ~xor(a, b) AS beqv, (~a) | b AS bimp,
 coalesce(CASE WHEN round_even(a / 2.0, 0) BETWEEN -32768 AND 32767 THEN round_even(a / 2.0, 0) END, -99999)::BIGINT AS cint_, trunc(a / 4.0)::BIGINT AS fix_, floor(a / 4.0)::BIGINT AS int_, sign(a)::BIGINT AS sgn_,
 coalesce(CASE WHEN a >= 0 AND round(sqrt(abs(a)))::BIGINT * round(sqrt(abs(a)))::BIGINT = a THEN round(sqrt(abs(a)))::BIGINT END, -99999)::BIGINT AS sqr_ FROM v"""


def three_valued_logic(spark, sf_dir):
    """And, Or, Xor, Eqv, Imp over true, false and null, and the order False > True; null is -9."""
    vals = [None, True, False]
    d = spark.createDataFrame([(p, q) for p in vals for q in vals], "p boolean, q boolean")
    n = lambda c: F.coalesce(c.cast("int"), F.lit(-9))
    p, q = F.col("p"), F.col("q")
    return d.select(n(p).alias("p"), n(q).alias("q"), n(p & q).alias("and_"), n(p | q).alias("or_"), n(V.logical_xor(p, q)).alias("xor_"), n(V.logical_eqv(p, q)).alias("eqv_"), n(V.logical_imp(p, q)).alias("imp_"), n(V.bool_rank(p) < V.bool_rank(q)).alias("lt_"))


_LOGIC = """
WITH v(x) AS (VALUES (NULL::BOOLEAN), (true), (false))
SELECT coalesce(p::INT, -9) AS p, coalesce(q::INT, -9) AS q, coalesce((p AND q)::INT, -9) AS and_, coalesce((p OR q)::INT, -9) AS or_, coalesce((p <> q)::INT, -9) AS xor_, coalesce((p = q)::INT, -9) AS eqv_, coalesce((NOT p OR q)::INT, -9) AS imp_, CASE WHEN p IS NULL OR q IS NULL THEN -9 ELSE (p AND NOT q)::INT END AS lt_
FROM (SELECT a.x AS p, b.x AS q FROM v a, v b)"""


def like_operator(spark, sf_dir):
    """Like patterns over part names."""
    name = F.col("p_name")
    pats = ("*a*", "?[aeiou]*", "[!a-m]*", "*#*", "*[ -]*")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", *[V.like(name, p).alias(f"like_{k}") for k, p in enumerate(pats)])


_LIKE = "SELECT p_partkey, regexp_full_match(p_name, '(?s).*a.*') AS like_0, regexp_full_match(p_name, '(?s).[aeiou].*') AS like_1, regexp_full_match(p_name, '(?s)[^a-m].*') AS like_2, regexp_full_match(p_name, '(?s).*[0-9].*') AS like_3, regexp_full_match(p_name, '(?s).*[ -].*') AS like_4 FROM part"


def string_intrinsics(spark, sf_dir):
    """Len, LenB, InStr, InStrRev, Left, Right, Mid, Trim, Replace over part names."""
    s = F.concat(F.lit("  "), F.col("p_name"), F.lit(" "))
    n = F.lit(3)
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(
        "p_partkey", V.utf16_len(s).alias("len_"), V.lenb(s).alias("lenb_"), V.instr(n, s, F.lit("a")).alias("instr_"), V.instr(n, s, F.lit("")).alias("instr_empty"), V.instrrev(s, F.lit("e")).alias("instrrev_"), V.left(s, F.lit(5)).alias("left_"), V.right(s, F.lit(4)).alias("right_"),
        V.mid(s, F.lit(3), F.lit(4)).alias("mid_"), V.trim(s).alias("trim_"), V.ltrim(s).alias("ltrim_"), V.rtrim(s).alias("rtrim_"), V.replace(s, F.lit("e"), F.lit("EE")).alias("replace_"), F.coalesce(V.left(s, F.lit(-1)), F.lit("?")).alias("left_bad"), F.coalesce(V.mid(s, F.lit(0), F.lit(1)), F.lit("?")).alias("mid_bad"),
    )


_STRINGS = """
WITH v AS (SELECT p_partkey, '  ' || p_name || ' ' AS s FROM part)
SELECT p_partkey, length(s)::BIGINT AS len_, (2 * length(s))::BIGINT AS lenb_, CASE WHEN instr(s[3:], 'a') = 0 THEN 0 ELSE instr(s[3:], 'a') + 2 END::BIGINT AS instr_, CASE WHEN length(s) >= 3 THEN 3 END::BIGINT AS instr_empty,
 CASE WHEN instr(reverse(s), 'e') = 0 THEN 0 ELSE length(s) - instr(reverse(s), 'e') + 1 END::BIGINT AS instrrev_, left(s, 5) AS left_, right(s, 4) AS right_, substr(s, 3, 4) AS mid_, trim(s) AS trim_, ltrim(s) AS ltrim_, rtrim(s) AS rtrim_, replace(s, 'e', 'EE') AS replace_, '?' AS left_bad, '?' AS mid_bad FROM v"""


def date_intrinsics(spark, sf_dir):
    """DateSerial, DateAdd, DateDiff and serials over order dates."""
    d = F.col("o_orderdate").cast("timestamp")
    far = F.lit("1999-12-31 23:59:59").cast("timestamp")
    txt = lambda c: F.date_format(c, "yyyy-MM-dd")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        "o_orderkey", txt(V.date_serial(F.year(d), F.month(d) + 13, F.lit(31))).alias("serial_"), *[V.date_diff(i, d, far).alias(f"diff_{i}") for i in ("s", "n", "h", "d", "ww", "m", "q", "yyyy")], txt(V.ole_date(F.datediff(d, F.lit("1899-12-30").cast("date")))).alias("ole_"), txt(F.add_months(d, 1)).alias("edate_"),
    )


_DATES = """
WITH v AS (SELECT o_orderkey, o_orderdate AS d, TIMESTAMP '1999-12-31 23:59:59' AS f FROM orders),
x AS (SELECT *, epoch(date_trunc('second', f))::BIGINT - floor(epoch(d))::BIGINT AS s, (year(f) * 12 + month(f)) - (year(d) * 12 + month(d)) AS m, d::DATE - DATE '1899-12-30' AS nd, f::DATE - DATE '1899-12-30' AS nf FROM v)
SELECT o_orderkey, strftime(make_date(year(d), 1, 1) + to_months((month(d) + 12)::INT) + INTERVAL 30 DAY, '%Y-%m-%d') AS serial_, s::BIGINT AS diff_s, floor(s / 60)::BIGINT AS diff_n, floor(s / 3600)::BIGINT AS diff_h, (nf - nd)::BIGINT AS diff_d,
 (floor((nf + 6) / 7) - floor((nd + 6) / 7))::BIGINT AS diff_ww, m::BIGINT AS diff_m, floor(m / 3)::BIGINT AS diff_q, floor(m / 12)::BIGINT AS diff_yyyy, strftime(d, '%Y-%m-%d') AS ole_, strftime(d + INTERVAL 1 MONTH, '%Y-%m-%d') AS edate_ FROM x"""


def radix_bit(spark, sf_dir):
    """Hex, Oct, Chr, Asc and the worksheet's radix and bit functions over keys."""
    k = F.col("p_partkey") + 1
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(
        k.alias("p_partkey"), V.hex_(k).alias("hex_"), V.oct_(k).alias("oct_"), V.chr_(k % 60 + 60).alias("chr_"), V.asc(F.col("p_name")).cast("long").alias("asc_"), X.dec2(-k, 16).alias("dec2hex"), X.to_dec(X.dec2(-k, 16), 16).alias("hex2dec"), X.base_text(k, 2, 12).alias("base_"),
        X.bit("and", k, F.lit(170)).alias("band"), X.bit("or", k, F.lit(170)).alias("bor"), X.bit("xor", k, F.lit(170)).alias("bxor"), X.bitshift(k, 4).alias("bl"), X.bitshift(k, -2).alias("br"), X.column_label(k).alias("col_"), X.column_number(X.column_label(k)).cast("long").alias("coln_"),
    )


_RADIX = """
WITH c AS (SELECT p_partkey + 1 AS k, p_name FROM part)
SELECT k AS p_partkey, printf('%X', k) AS hex_, printf('%o', k) AS oct_, chr((k % 60 + 60)::INT) AS chr_, ascii(p_name)::BIGINT AS asc_, printf('%X', 1099511627776 - k) AS dec2hex, -k AS hex2dec, lpad(bin(k), 12, '0') AS base_, k & 170 AS band, k | 170 AS bor, xor(k, 170) AS bxor, k * 16 AS bl, k // 4 AS br,
 CASE WHEN k <= 26 THEN chr((64 + k)::INT) WHEN k <= 702 THEN chr((64 + (k - 1) // 26)::INT) || chr((65 + (k - 1) % 26)::INT) ELSE chr((65 + ((k - 703) // 676) % 26)::INT) || chr((65 + ((k - 27) // 26) % 26)::INT) || chr((65 + (k - 1) % 26)::INT) END AS col_, k AS coln_ FROM c"""


def xl_text(spark, sf_dir):
    """Worksheet text functions over part names and page URLs."""
    s = F.concat(F.lit(" "), F.col("p_name"), F.lit("  x"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(
        "p_partkey", X.squeeze(s).alias("trim_"), F.upper(s).alias("upper_"), X.rept(F.lit("ab"), F.col("p_size")).alias("rept_"), F.coalesce(X.find(F.lit("e"), s), F.lit(-1)).cast("long").alias("find_"), F.coalesce(X.search(F.lit("A"), s), F.lit(-1)).cast("long").alias("search_"), X.textjoin("-", F.array(F.col("p_name"), F.lit(""), F.lit("z"))).alias("join_"),
        F.coalesce(X.textbefore(F.col("p_name"), F.lit(" ")), F.lit("?")).alias("before_"), F.coalesce(X.textafter(F.col("p_name"), F.lit(" ")), F.lit("?")).alias("after_"), X.numbervalue(F.concat(F.col("p_size"), F.lit(",000%"))).alias("number_"), X.encodeurl(F.concat(F.col("p_name"), F.lit(" ~&"))).alias("url_"), F.length(X.clean(F.concat(F.lit("a\tb"), F.col("p_name")))).cast("long").alias("clean_"), X.roman(F.col("p_size")).alias("roman_"),
    )


_TEXT = r"""
WITH v AS (SELECT *, ' ' || p_name || '  x' AS s FROM part)
SELECT p_partkey, regexp_replace(trim(s), ' +', ' ', 'g') AS trim_, upper(s) AS upper_, repeat('ab', p_size) AS rept_, CASE WHEN instr(s, 'e') = 0 THEN -1 ELSE instr(s, 'e') END::BIGINT AS find_, CASE WHEN instr(lower(s), 'a') = 0 THEN -1 ELSE instr(lower(s), 'a') END::BIGINT AS search_, p_name || '-z' AS join_,
 CASE WHEN contains(p_name, ' ') THEN split_part(p_name, ' ', 1) ELSE '?' END AS before_, CASE WHEN contains(p_name, ' ') THEN substr(p_name, instr(p_name, ' ') + 1) ELSE '?' END AS after_, (p_size * 1000 / 100)::DOUBLE AS number_, replace(p_name, ' ', '%20') || '%20~%26' AS url_, (length(p_name) + 2)::BIGINT AS clean_,
 (['', 'X', 'XX', 'XXX', 'XL', 'L'])[p_size // 10 + 1] || (['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'])[p_size % 10 + 1] AS roman_ FROM v"""


def _r(c, n=6):
    return F.round(c.cast("double"), n)


def xl_rounding(spark, sf_dir):
    """Worksheet rounding over order totals."""
    x = F.col("c_acctbal") / F.lit(7.0)
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", _r(X.trunc(x, 1)).alias("trunc_"), _r(X.roundup(x, 0)).alias("roundup_"), _r(X.ceiling(x, F.lit(5.0))).alias("ceil_"), _r(X.floor(x, F.lit(5.0))).alias("floor_"), _r(X.even(x)).alias("even_"), _r(X.odd(x)).alias("odd_"), X.quotient(x, F.lit(3.0)).alias("quot_"), _r(X.mod(x, F.lit(3.0)), 4).alias("mod_"), _r(X.mround(F.abs(x), F.lit(4.0))).alias("mround_"))


_ROUNDING = """
WITH v AS (SELECT c_custkey, c_acctbal / 7.0::DOUBLE AS x FROM customer)
SELECT c_custkey, round(trunc(x * 10) / 10, 6) + 0 AS trunc_, round(sign(x) * ceil(abs(x)), 6) + 0 AS roundup_, round(ceil(x / 5.0::DOUBLE) * 5, 6) + 0 AS ceil_, round(floor(x / 5.0::DOUBLE) * 5, 6) + 0 AS floor_, round(sign(x) * ceil(abs(x) / 2) * 2, 6) + 0 AS even_,
 round(CASE WHEN x < 0 THEN -(ceil((abs(x) + 1) / 2) * 2 - 1) ELSE ceil((abs(x) + 1) / 2) * 2 - 1 END, 6) + 0 AS odd_, trunc(x / 3.0::DOUBLE)::BIGINT AS quot_, round(x - 3.0::DOUBLE * floor(x / 3.0::DOUBLE), 4) AS mod_, round(floor(abs(x) / 4.0::DOUBLE + 0.5) * 4, 6) + 0 AS mround_ FROM v"""


def xl_combinatorics(spark, sf_dir):
    """FACT, COMBIN, PERMUT, GCD, LCM and their kin over part sizes."""
    n, k = F.col("p_size"), F.col("p_partkey") % 7
    g = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", n.alias("n"), k.alias("k"))
    n, k = F.col("n"), F.col("k")
    return g.select("p_partkey", X.fact(k).alias("fact_"), X.factdouble(n % 12).alias("fd_"), F.coalesce(X.combin(n, k), F.lit(-1.0)).alias("combin_"), F.coalesce(X.permut(n, k), F.lit(-1.0)).alias("permut_"), X.gcd(n * 6, k * 4).alias("gcd_"), X.lcm(n, k + 1).alias("lcm_"))


_COMBIN = """
WITH v AS (SELECT p_partkey, p_size::BIGINT AS n, p_partkey % 7 AS k FROM part)
SELECT p_partkey, factorial(k::INT)::DOUBLE AS fact_, list_product(list_concat([1.0::DOUBLE], list_transform(range(CASE WHEN n % 12 % 2 = 0 THEN 2 ELSE 1 END, n % 12 + 1, 2), lambda i: i::DOUBLE))) AS fd_,
 CASE WHEN k <= n THEN list_product(list_concat([1::HUGEINT], list_transform(range(k), lambda i: (n - i)::HUGEINT)))::HUGEINT // factorial(k::INT) ELSE -1 END::DOUBLE AS combin_, CASE WHEN k <= n THEN list_product(list_concat([1::HUGEINT], list_transform(range(k), lambda i: (n - i)::HUGEINT))) ELSE -1 END::DOUBLE AS permut_, gcd(n * 6, k * 4)::BIGINT AS gcd_, lcm(n, k + 1)::BIGINT AS lcm_ FROM v"""


def xl_arrays(spark, sf_dir):
    """SUMPRODUCT and kin, MATCH, TAKE, DROP, SORT, UNIQUE over the line items of an order."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    g = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_discount"))).alias("a")).select("l_orderkey", F.col("a.l_quantity").alias("q"), F.col("a.l_discount").alias("d"))
    q, d = F.col("q"), F.col("d")
    return g.select(
        "l_orderkey", _r(X.sumproduct(q, d)).alias("sumproduct_"), _r(X.sumx2my2(q, d)).alias("x2my2"), _r(X.sumx2py2(q, d)).alias("x2py2"), _r(X.sumxmy2(q, d)).alias("xmy2"), _r(X.sumsq(q)).alias("sumsq_"), F.coalesce(X.match_exact(F.array_max(q), q), F.lit(-1)).cast("long").alias("match_"), F.coalesce(X.match_below(F.lit(25.0), F.array_sort(q)), F.lit(-1)).cast("long").alias("below_"),
        F.array_join(X.take(q, 2).cast("array<int>").cast("array<string>"), ",").alias("take_"), F.array_join(X.drop(q, 1).cast("array<int>").cast("array<string>"), ",").alias("drop_"), F.array_join(F.array_sort(F.array_distinct(q)).cast("array<int>").cast("array<string>"), ",").alias("unique_"), F.size(X.wraprows(q, 2)).cast("long").alias("wrap_"),
    )


_ARRAYS = """
WITH v AS (SELECT l_orderkey, list(l_quantity ORDER BY l_linenumber, l_quantity, l_discount) AS q, list(l_discount ORDER BY l_linenumber, l_quantity, l_discount) AS d FROM lineitem GROUP BY 1), w AS (SELECT *, list_zip(q, d) AS z FROM v)
SELECT l_orderkey, round(list_sum(list_transform(z, lambda p: p[1] * p[2])), 6) AS sumproduct_, round(list_sum(list_transform(z, lambda p: p[1] * p[1] - p[2] * p[2])), 6) AS x2my2, round(list_sum(list_transform(z, lambda p: p[1] * p[1] + p[2] * p[2])), 6) AS x2py2, round(list_sum(list_transform(z, lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6) AS xmy2, round(list_sum(list_transform(q, lambda p: p * p)), 6) AS sumsq_,
 list_position(q, list_max(q))::BIGINT AS match_, CASE WHEN len(list_filter(q, lambda p: p <= 25)) = 0 THEN -1 ELSE len(list_filter(q, lambda p: p <= 25)) END::BIGINT AS below_, array_to_string(q[1:2]::INT[], ',') AS take_, array_to_string(q[2:]::INT[], ',') AS drop_, array_to_string(list_sort(list_distinct(q))::INT[], ',') AS unique_, ceil(len(q) / 2.0)::BIGINT AS wrap_ FROM w"""


def _m(c, n):
    """Rounded, off the ties that two engines may round apart."""
    return F.round(c.cast("double") + F.lit(3.1e-6), n)


def xl_finance(spark, sf_dir):
    """SLN, SYD, PV, FV, PMT, IPMT, NPV, EFFECT, NOMINAL, DISC and T-bills over orders."""
    p, r, n = F.col("o_totalprice"), F.lit(0.004) + (F.col("o_orderkey") % 5) * 0.001, F.lit(12) + F.col("o_orderkey") % 12
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", p.alias("p"), r.alias("r"), n.cast("double").alias("n"))
    p, r, n = F.col("p"), F.col("r"), F.col("n")
    return o.select("o_orderkey", _m(X.sln(p, F.lit(1.0), n), 4).alias("sln_"), _m(X.syd(p, F.lit(1.0), n, F.lit(3.0)), 4).alias("syd_"), _m(X.pv(r, n, F.lit(10.0)), 4).alias("pv_"), _m(X.fv(r, n, F.lit(10.0)), 4).alias("fv_"), _m(X.pmt(r, n, p), 4).alias("pmt_"), _m(X.ipmt(r, F.lit(1.0), n, p), 4).alias("ipmt_"), _m(X.npv(r, F.array(p, p, p)), 4).alias("npv_"), _m(X.effect(r, F.lit(12.0)), 8).alias("effect_"), _m(X.fvschedule(p, F.array(r, r)), 4).alias("fvs_"), _m(X.disc(n * 10, p, p + 5.0), 8).alias("disc_"), _m(X.tbill_price(n, r), 6).alias("tbill_"))


_FINANCE = """
WITH v AS (SELECT o_orderkey, o_totalprice AS p, 0.004::DOUBLE + (o_orderkey % 5) * 0.001::DOUBLE AS r, (12 + o_orderkey % 12)::DOUBLE AS n FROM orders), w AS (SELECT *, pow(1 + r, n) AS q FROM v)
SELECT o_orderkey, round((p - 1) / n + 3.1e-6::DOUBLE, 4) AS sln_, round((p - 1) * (n - 2) * 2 / (n * (n + 1)) + 3.1e-6::DOUBLE, 4) AS syd_, round(-10 * (q - 1) / (r * q) + 3.1e-6::DOUBLE, 4) AS pv_, round(-10 * (q - 1) / r + 3.1e-6::DOUBLE, 4) AS fv_, round(-p * r * q / (q - 1) + 3.1e-6::DOUBLE, 4) AS pmt_, round(-p * r + 3.1e-6::DOUBLE, 4) AS ipmt_, round(p / (1 + r) + p / pow(1 + r, 2) + p / pow(1 + r, 3) + 3.1e-6::DOUBLE, 4) AS npv_, round(pow(1 + r / 12, 12) - 1 + 3.1e-6::DOUBLE, 8) AS effect_, round(p * (1 + r) * (1 + r) + 3.1e-6::DOUBLE, 4) AS fvs_, round((p + 5 - p) / (p + 5) * 360 / (n * 10) + 3.1e-6::DOUBLE, 8) AS disc_, round(100 * (1 - r * n / 360) + 3.1e-6::DOUBLE, 6) AS tbill_ FROM w"""


def xl_statistics(spark, sf_dir):
    """Binomial, Poisson, normal, exponential and Weibull over quantities."""
    k = (F.col("l_quantity") % 10).cast("double")
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", k.alias("k"))
    k = F.col("k")
    return li.select("l_orderkey", "l_linenumber", _r(X.binom_pmf(k, F.lit(10.0), F.lit(0.3)), 10).alias("binom_"), _r(X.poisson_pmf(k, F.lit(4.0)), 10).alias("poisson_"), _r(X.norm_pdf(k, F.lit(5.0), F.lit(2.0)), 10).alias("norm_"), _r(X.expon_cdf(k, F.lit(0.5)), 10).alias("expon_"), _r(X.weibull_cdf(k, F.lit(1.5), F.lit(3.0)), 10).alias("weibull_"), _r(X.standardize(k, F.lit(5.0), F.lit(2.0)), 10).alias("z_"))


_STATISTICS = """
WITH v AS (SELECT l_orderkey, l_linenumber, l_quantity % 10 AS k FROM lineitem)
SELECT l_orderkey, l_linenumber, round((factorial(10) // (factorial(k::INT) * factorial((10 - k)::INT)))::DOUBLE * pow(0.3::DOUBLE, k) * pow(0.7::DOUBLE, 10 - k), 10) AS binom_, round(exp(-4) * pow(4, k) / factorial(k::INT)::DOUBLE, 10) AS poisson_, round(exp(-(k - 5) * (k - 5) / 8) / (2 * sqrt(2 * pi())), 10) AS norm_, round(1 - exp(-0.5::DOUBLE * k), 10) AS expon_, round(1 - exp(-pow(k / 3, 1.5::DOUBLE)), 10) AS weibull_, round((k - 5) / 2, 10) AS z_ FROM v"""


def crc32_fnv_fingerprint(spark, sf_dir):
    """CRC-32 and FNV-1a of whole texts of the benchmark."""
    b = F.col("text").cast("binary")
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.crc32(b).alias("crc"), V.fnv1a64(b).alias("fnv"))


QUERIES = {f.__name__: f for f in (integer_operators, three_valued_logic, like_operator, string_intrinsics, date_intrinsics, radix_bit, xl_text, xl_rounding, xl_combinatorics, xl_arrays, xl_finance, xl_statistics, crc32_fnv_fingerprint)}
ORACLES = {"integer_operators": _INTEGER, "three_valued_logic": _LOGIC, "like_operator": _LIKE, "string_intrinsics": _STRINGS, "date_intrinsics": _DATES, "radix_bit": _RADIX, "xl_text": _TEXT, "xl_rounding": _ROUNDING, "xl_combinatorics": _COMBIN, "xl_arrays": _ARRAYS, "xl_finance": _FINANCE, "xl_statistics": _STATISTICS}
