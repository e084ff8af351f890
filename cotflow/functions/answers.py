"""Final-answer extraction and number normalization as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from cotflow.functions.lambdas import let

# The two answer patterns and the marker for "no answer".
STRICT_PATTERN = r"#### (\-?[0-9,]+\.?[0-9]*)\s*$"
LOOSE_PATTERN = r"####\s*([0-9,.-]+)"
INVALID = "[invalid]"

# m: $ matches at every line end; d: only \n ends a line; U: \s covers Unicode spaces.
_STRICT = "(?mdU)" + STRICT_PATTERN
_NUMBER = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"


def final_answer_strict(text: Column) -> Column:
    """First marked number that ends its line, commas removed; ``[invalid]`` if none.

    A marker followed by commas only gives '' rather than ``[invalid]``.
    """
    found = F.replace(F.regexp_extract(text, _STRICT, 1), F.lit(","), F.lit(""))
    return F.when(text.rlike(_STRICT), found).otherwise(F.lit(INVALID))


def final_answer_loose(text: Column) -> Column:
    """First run of digits, commas, dots and dashes after a marker, commas removed; else NULL."""
    found = F.replace(F.regexp_extract(text, LOOSE_PATTERN, 1), F.lit(","), F.lit(""))
    return F.when(text.rlike(LOOSE_PATTERN), found)


def _large_whole(number: Column) -> Column:
    """All digits of a whole double between 2**62 and 2**115: its high bits times a power of two."""

    def digits(x: Column) -> Column:
        power = F.pow(F.lit(2.0), F.floor(F.log2(x)) - 53)
        high = (x / power).try_cast("bigint").cast("decimal(18,0)")
        return (high * power.try_cast("bigint").cast("decimal(19,0)")).cast("string")

    return F.concat(F.when(number < 0, "-").otherwise(""), let(F.abs(number), digits))


def _six_decimals(number: Column) -> Column:
    """Six decimals of the double's exact value, ties to even.

    A double minus its whole part is exact. Of the fraction, the product with 10**7 and what its
    rounding lacks, both in doubles, tell on which side of a tie at the seventh place it lies.
    """

    def rounded(x: Column) -> Column:
        whole = F.floor(x)
        part = x - whole
        product, wide = part * 1e7, part * 134217729.0
        high = wide - (wide - part)
        rest = (high * 1e7 - product) + (part - high) * 1e7
        n = F.rint(product).try_cast("bigint")
        off = (product - n) + rest
        units, digit = F.floor(n / 10).cast("bigint"), n % 10
        up = (digit > 5) | ((digit == 5) & ((off > 0) | ((off == 0) & (units % 2 == 1))))

        def text(sixth: Column) -> Column:
            carried = whole.try_cast("bigint") + F.when(sixth == 1000000, 1).otherwise(0)
            return F.concat(carried.cast("string"), F.lit("."), F.lpad((sixth % 1000000).cast("string"), 6, "0"))

        return let(units + up.cast("bigint"), text)

    return F.concat(F.when(number < 0, "-").otherwise(""), let(F.abs(number), rounded))


def normalize_number(value: Column) -> Column:
    """Canonical decimal text of a number; '' for anything that is not one.

    The number is a double. Whole numbers print all digits of that double (up to 2**115; beyond,
    their shortest decimal form), others at most six decimals, rounded by the double's exact value
    and ties to even.
    """
    bare = F.trim(F.replace(F.replace(value, F.lit(","), F.lit("")), F.lit(" "), F.lit("")))
    number = F.when(
        bare.rlike(_NUMBER), F.replace(bare, F.lit("_"), F.lit("")).try_cast("double")
    )
    whole = (
        F.when(F.abs(number) < F.lit(9.0e18), number.cast("bigint").cast("string"))
        .when(F.abs(number) < F.lit(2.0**115), _large_whole(number))
        .otherwise(F.format_string("%.0f", number))
    )
    fraction = F.regexp_replace(_six_decimals(number), r"\.?0+$", "")
    special = F.lower(bare).rlike(r"^[+-]?(inf|infinity|nan)$")
    special_text = F.regexp_replace(
        F.regexp_replace(F.lower(bare), "infinity", "inf"), r"^\+|^[+-]?(?=nan)", ""
    )
    return (
        F.when(value.isNull() | (value == "") | (value == INVALID), F.lit(""))
        .when(special, special_text)
        .when(number.isNull(), F.lit(""))
        .when(number == 0, F.lit("0"))
        .when(number == F.rint(number), whole)
        .otherwise(fraction)
    )


def answers_match(predicted: Column, truth: Column) -> Column:
    """Predictions without an answer are wrong; others compare by normalized number."""
    return F.coalesce(predicted != INVALID, F.lit(False)) & (
        normalize_number(predicted) == normalize_number(truth)
    )
