"""Numbers as they are written: value, precision, percent, scale. Decimal arithmetic, never floating point, where equality matters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A number that no letter or dash touches, with sign, thousands, fraction, exponent (e5 or typeset times ten to the five), and one of percent, scale letter.
NUMBER = r"(?<![A-Za-z0-9.,_-])[+−-]?(?:\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+\.\d+|\.\d+|\d+)(?:[eE][+-]?\d{1,2}|\s?(?:×|x|\\times)\s?10\^\{?[+−-]?\d{1,2}\}?)?(?:\s?%|[KMBT](?![A-Za-z]))?(?![A-Za-z0-9_]|[.,]\d)"
TIMES_TEN = r"\s?(?:×|x|\\times)\s?10\^\{?([+−-]?\d{1,2})\}?"
#: Powers of ten of the scale letters.
SCALES = {"K": 3, "M": 6, "B": 9, "T": 12}
VALUE = "decimal(38,18)"


def parse_decimal(text: Column) -> Column:
    """A literal with a typeset minus, thousands and a leading point; null if it is none."""
    bare = F.replace(F.replace(F.trim(text), F.lit("−"), F.lit("-")), F.lit(","), F.lit(""))
    return F.when(bare.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)$"), bare.try_cast("decimal(38,12)"))


def find_numbers(text: Column, skip_years: bool = True) -> Column:
    """array<struct<raw, value decimal(38,18), decimals, is_percent>> of a text, in order; bare years are left out if asked.

    The value is null where it doesn't fit: 10 ** 20 or more, or not zero but too small to be written with 18 places.
    """

    def parts(raw: Column) -> Column:
        short = F.when(raw.contains("10^"), F.regexp_replace(raw, TIMES_TEN, "e$1")).otherwise(raw)
        return F.struct(raw.alias("raw"), F.lower(F.translate(short, "−,+% KMBT", "-")).alias("bare"))

    def read(n: Column) -> Column:
        mantissa = F.substring_index(n["bare"], "e", 1)
        scale = F.coalesce(*[F.when(n["raw"].endswith(k), F.lit(f"e{v}")) for k, v in SCALES.items()], F.lit(""))
        value = F.concat(n["bare"], F.when(n["bare"].contains("e"), F.lit("")).otherwise(scale)).try_cast(VALUE)
        lost = (value == 0) & (F.translate(mantissa, "-.0", "") != "")
        decimals = F.when(mantissa.contains("."), F.length(F.substring_index(mantissa, ".", -1))).otherwise(0)
        return F.struct(n["raw"].alias("raw"), F.when(~lost, value).alias("value"), decimals.alias("decimals"), n["raw"].endswith("%").alias("is_percent"))

    raws = F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))
    if skip_years:
        raws = F.filter(raws, lambda raw: ~raw.rlike(r"^(?:19|20)\d\d$"))
    return F.transform(F.transform(raws, parts), read)


def fraction(value: Column, is_percent: Column) -> Column:
    return F.when(is_percent, value / 100).otherwise(value)


def tolerance(decimals: Column) -> Column:
    """Half of the last written digit."""
    return F.lit(0.5) * F.pow(F.lit(10.0), -decimals)


def rounded(value: Column, places: int) -> Column:
    """A double to places in binary arithmetic, halves away from zero, as SQL engines do; round() goes by the digits that are printed and can differ in the last one."""
    scale = 10.0**places
    return F.signum(value) * F.floor(F.abs(value) * scale + 0.5) / scale


def rounds_to(exact: Column, reported: Column, decimals: Column) -> Column:
    """Whether an exact value, written at the reported precision, may read as reported."""
    return F.abs(exact - reported) <= tolerance(decimals) + 1e-12


def cell_number(text: Column) -> Column:
    """The number of a table cell: one only, and nothing but decoration beside it; else null."""
    found = F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))
    rest = F.regexp_replace(F.regexp_replace(text, NUMBER, ""), r"[\s()\[\]*†‡±~%$]+|\\(?:textbf|mathbf|underline|pm)|[{}]", "")
    return F.when((F.size(found) == 1) & (rest == ""), F.get(find_numbers(text, skip_years=False), F.lit(0)))


def wilson(hits: Column, n: Column, z: float = 1.96) -> Column:
    """struct<low, high> of the score interval, (0, 0) without trials."""
    p = hits / F.nullif(n, F.lit(0))
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z / (1 + z * z / n) * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    clamp = lambda v: F.round(F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), v)), F.lit(0.0)), 6)
    return F.when(n == 0, F.struct(F.lit(0.0).alias("low"), F.lit(0.0).alias("high"))).otherwise(F.struct(clamp(centre - half).alias("low"), clamp(centre + half).alias("high")))
