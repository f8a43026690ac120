"""Numbers as text, correctly rounded from their binary value.

The JVM's formatter rounds the shortest decimal form of a DOUBLE. That differs from the binary value
only where the short form is a tie, or has fewer digits than asked for because the number is subnormal.
Both cases are decided here by whole-number arithmetic on lists of 30-bit digits, the lowest first;
all others take the formatter's digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

BITS = 30
DIGITS = 6             # of C's %g
SMALLEST_NORMAL = 2.2250738585072014e-308


def _long(value: int) -> Column:
    return F.lit(value).cast("bigint")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _times(number: Column, factor: Column) -> Column:
    """``number`` times a factor below 2^30."""
    start = F.struct(F.array().cast("array<bigint>").alias("a"), _long(0).alias("c"))
    step = lambda acc, x: _let(x * factor + acc["c"], lambda t: F.struct(
        F.array_append(acc["a"], t.bitwiseAND(_long(2**BITS - 1))).alias("a"), F.shiftright(t, BITS).alias("c")))
    return F.aggregate(number, start, step, lambda acc: F.array_append(acc["a"], acc["c"]))


def _times_power(number: Column, base: int, chunk: int, exponent: Column) -> Column:
    """``number`` times ``base ** exponent`` (1 for exponents below 1), ``base ** chunk`` below 2^30."""

    def raised(n: Column) -> Column:
        whole = F.slice(F.sequence(F.lit(1), F.lit(1100 // chunk)), F.lit(1), F.floor(exponent / chunk).cast("int"))
        many = F.aggregate(whole, n, lambda acc, _: _times(acc, _long(base**chunk)))
        return F.when(exponent > 0, _times(many, F.pow(F.lit(base), exponent % chunk).cast("bigint"))).otherwise(n)

    return _let(number, raised)


def _digits(value: Column) -> Column:
    """A whole number below 2^60."""
    return F.array(value.bitwiseAND(_long(2**BITS - 1)), F.shiftright(value, BITS))


def _sign_of_difference(a: Column, b: Column) -> Column:
    """Of two numbers of at most 200 digits."""
    high_first = lambda x: F.reverse(F.slice(F.concat(x, F.array_repeat(_long(0), 200)), 1, 200))
    return _let(F.struct(high_first(a).alias("a"), high_first(b).alias("b")), lambda x: F.when(
        x["a"] == x["b"], 0).when(x["a"] > x["b"], 1).otherwise(-1))


def _power_of_two(exponent: Column) -> Column:
    return F.pow(F.lit(2.0), exponent)


def _binary(x: Column) -> tuple[Column, Column]:
    """``m, e`` with x = m 2^e, m a whole number below 2^56, for a normal x > 0."""
    e = F.floor(F.log2(x)).cast("int") - 54
    half = F.floor(-e / 2).cast("int")
    return (x * _power_of_two(half) * _power_of_two(-e - half)).cast("bigint"), e


def _exponent(text: Column) -> Column:
    return F.substring_index(text, "e", -1).cast("int")


def _mantissa(text: Column) -> Column:
    return F.replace(F.substring_index(text, "e", 1), F.lit("."), F.lit("")).cast("bigint")


def _found(digits: Column, exponent: Column) -> Column:
    return F.struct(digits.alias("digits"), exponent.cast("int").alias("exponent"))


def _tie(x: Column, k: Column, exponent: Column) -> Column:
    """The rounding of x, whose short form is k 10^p with seven digits, the last of them 5."""
    p = exponent - DIGITS
    m, e = _binary(x)
    a = _times_power(_times_power(_digits(m), 2, 29, e), 10, 9, -p)
    b = _times_power(_times_power(_digits(k), 10, 9, p), 2, 29, -e)
    low = ((k - 5) / 10).cast("bigint")
    return _let(_sign_of_difference(a, b), lambda sign: F.when(
        (sign > 0) | ((sign == 0) & (low % 2 == 1)), low + 1).otherwise(low))


def _subnormal(x: Column, exponent: Column) -> Column:
    """The six digits of a subnormal x, ``round(x 10^(5 - exponent))``, half to even."""
    m = (x * _power_of_two(F.lit(537)) * _power_of_two(F.lit(537))).cast("bigint")

    def divided(v: Column) -> Column:    # by 2^1074, which ends 24 bits into digit 35
        digit = lambda k: F.coalesce(F.get(v, F.lit(k)), _long(0))
        low = F.shiftright(digit(35), 24) + F.shiftleft(digit(36), 6) + F.shiftleft(digit(37), 36)
        half = F.shiftright(digit(35), 23) % 2 == 1
        more = (digit(35) % 2**23 != 0) | F.exists(F.slice(v, 1, 35), lambda d: d != 0)
        return low + F.when(half & (more | (low % 2 == 1)), _long(1)).otherwise(_long(0))

    return _let(_times_power(_digits(m), 10, 9, F.lit(DIGITS - 1) - exponent), divided)


def _shown(exponent: Column, text: Column) -> Column:
    bare = lambda t: F.regexp_replace(F.regexp_replace(t, r"0+$", ""), r"\.$", "")
    mantissa = bare(F.concat(F.substring(text, 1, 1), F.lit("."), F.substring(text, 2, DIGITS)))
    scientific = F.concat(mantissa, F.when(exponent < 0, F.lit("e-")).otherwise(F.lit("e+")),
                          F.format_string("%02d", F.abs(exponent)))
    whole = bare(F.concat(F.substring(text, F.lit(1), exponent + 1), F.lit("."),
                          F.substring(text, exponent + 2, F.lit(DIGITS))))
    part = bare(F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), text))
    return F.when((exponent < -4) | (exponent >= DIGITS), scientific).when(exponent < 0, part).otherwise(whole)


def general(col: Column | str) -> Column:
    """A DOUBLE as C's ``%g`` prints it, as an expression."""
    value = F.col(col) if isinstance(col, str) else col

    def rounded(v: Column) -> Column:
        x, six, seven = v["x"], v["six"], v["seven"]
        power, k = _exponent(six), _mantissa(seven)
        # a subnormal's short form may name the wrong power of ten
        near = lambda first: F.when(first >= 10**DIGITS, power + 1).when(first < 10**(DIGITS - 1), power - 1).otherwise(power)
        tiny = _let(_let(_subnormal(x, power), near), lambda right: _found(_subnormal(x, right), right))
        return F.when(x < SMALLEST_NORMAL, tiny).when(
            (k % 10 == 5) & (seven.cast("double") == x), _found(_tie(x, k, _exponent(seven)), _exponent(seven))).otherwise(
            _found(_mantissa(six), power))

    def shown(x: Column) -> Column:
        made = _let(F.struct(x.alias("x"), F.format_string(f"%.{DIGITS - 1}e", x).alias("six"),
                             F.format_string(f"%.{DIGITS}e", x).alias("seven")), rounded)
        # 999999.5 and more is one of the next power
        return _let(made, lambda f: F.when(f["digits"] >= 10**DIGITS, _shown(f["exponent"] + 1, F.lit("1" + "0" * (DIGITS - 1))))
                    .otherwise(_shown(f["exponent"], f["digits"].cast("string"))))

    def named(v: Column) -> Column:
        x = F.abs(v)
        minus = F.when(v.cast("string").startswith("-"), F.lit("-")).otherwise(F.lit(""))
        return F.when(v.isNull(), F.lit(None).cast("string")).when(F.isnan(v), F.lit("nan")).otherwise(F.concat(
            minus, F.when(x == 0, F.lit("0")).when(x == float("inf"), F.lit("inf")).otherwise(_let(x, shown))))

    return _let(value.cast("double"), named)
