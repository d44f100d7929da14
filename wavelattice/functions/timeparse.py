"""Column expressions that read written times of many layouts into parts, JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month words of the written languages, by month number.
MONTH_WORDS = {
    1: ("january", "janv", "janvier", "ene", "enero", "jan", "januar", "jän", "gen", "gennaio"),
    2: ("february", "févr", "fevr", "février", "fevrier", "feb", "febrero", "fév", "februar"),
    3: ("march", "mars", "mar", "marzo", "mär", "märz", "mrz"),
    4: ("april", "avr", "avril", "abr", "abril", "apr"),
    5: ("may", "mai", "mayo", "maggio"),
    6: ("june", "juin", "jun", "junio", "juni"),
    7: ("july", "juil", "juillet", "jul", "julio", "juli"),
    8: ("august", "août", "aout", "ago", "agosto", "aug"),
    9: ("september", "sept", "septembre", "sep", "septiembre", "set"),
    10: ("october", "oct", "octobre", "octubre", "okt", "oktober"),
    11: ("november", "nov", "novembre", "noviembre"),
    12: ("december", "déc", "dec", "décembre", "decembre", "dic", "diciembre", "dez", "dezember"),
}

# Zone abbreviations and their offsets from UTC in minutes.
ZONE_WORDS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "IST": 330, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300,
    "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
}

_ZONE = r"(?:\s*(Z|[+-]\d{2}:?\d{2}|[+-]\d{2}|[A-Za-z]{2,4}))?(?:\s*\[?([A-Za-z]+/[A-Za-z_/+-]+)\]?)?"
_CLOCK = r"(?:[T ,]+(\d{1,2})[:hH](\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?\s*([AaPp][Mm])?)?"
#: year, month, day, hour, minute, second, fraction, half of the day, zone, zone name
CANONICAL = rf"^[MD](\d{{4}})-(\d{{1,2}}|\p{{L}}{{3,10}})-(\d{{1,2}}){_CLOCK}{_ZONE}$"

# The other layouts and their order of parts, after a mark M (month first) or D.
LAYOUTS = (
    (r"^([MD])[A-Za-z]{3,9}, (?=\d)", "$1"),
    (r"^([MD])(\d{1,2})[ -](\p{L}{3,10})\.?[ -](\d{4})(?!\d)", "$1$4-$3-$2"),
    (r"^([MD])(\p{L}{3,10})\.? (\d{1,2}), (\d{4})(?!\d)", "$1$4-$2-$3"),
    (r"^D(\d{1,2})([/.-])(\d{1,2})\2(\d{4})(?!\d)", "D$4-$3-$1"),
    (r"^D(\d{1,2})([/.-])(\d{1,2})\2(\d{2})(?!\d)", "D20$4-$3-$1"),
    (r"^M(\d{1,2})([/.-])(\d{1,2})\2(\d{4})(?!\d)", "M$4-$1-$3"),
    (r"^M(\d{1,2})([/.-])(\d{1,2})\2(\d{2})(?!\d)", "M20$4-$1-$3"),
    (r"^([MD])(\d{4})[/.](\d{1,2})[/.](\d{1,2})(?!\d)", "$1$2-$3-$4"),
    (r"^([MD])(\d{4})(\d{2})(\d{2})(?:T?(\d{2})(\d{2})(\d{2}))(?!\d)", "$1$2-$3-$4 $5:$6:$7"),
    (r"^([MD])(\d{4})(\d{2})(\d{2})(?:T?(\d{2})(\d{2}))(?!\d)", "$1$2-$3-$4 $5:$6"),
    (r"^([MD])(\d{4})(\d{2})(\d{2})$", "$1$2-$3-$4"),
)


def _months() -> Column:
    pairs = [F.lit(x) for n, words in MONTH_WORDS.items() for w in dict.fromkeys(words) for x in (w, f"{n:02d}")]
    return F.create_map(*pairs)


def _zones() -> Column:
    return F.create_map(*[F.lit(x) for pair in ZONE_WORDS.items() for x in pair])


def tidy(raw: Column) -> Column:
    """Without surrounding blanks of any kind and quotes, inner blanks single."""
    inner = F.regexp_replace(raw, "[\\s   ﻿\"']+$|^[\\s   ﻿\"']+", "")
    return F.regexp_replace(inner, "[\\s   ]+", " ")


def split_time(text: Column, month_first: Column) -> Column:
    """The ten written parts of ``CANONICAL`` as an array of strings, or one string where it is no time.

    All-numeric dates that do not start with the year are day first, or month first where
    ``month_first`` holds; years of two digits are 20xx.  Named months are read in
    English, French, Spanish and German, with or without full stop and weekday.  Each
    step rewrites the one before, so that the expression grows linearly.
    """
    t = F.concat(F.when(month_first, "M").otherwise("D"), text)
    for pattern, to in LAYOUTS:
        t = F.regexp_replace(t, pattern, to)
    return F.split(F.regexp_replace(t, CANONICAL, "$1|$2|$3|$4|$5|$6|$7|$8|$9|$10"), "[|]", -1)


def epoch_micros(text: Column) -> Column:
    """Instant of an all-digit epoch of 10 (s), 13 (ms), 16 (us) or 19 (ns) digits, else null."""
    digits = text.rlike(r"^\d+$")
    number = F.expr("null").cast("bigint")
    for width, scale in ((10, 1_000_000), (13, 1_000), (16, 1)):
        number = F.when(digits & (F.length(text) == width), text.try_cast("bigint") * scale).otherwise(number)
    nanos = F.when(digits & (F.length(text) == 19), F.floor(text.try_cast("decimal(20,0)") / 1000).cast("bigint"))
    fraction = F.when(text.rlike(r"^\d{10}[.,]\d{1,9}$"), F.floor(F.regexp_replace(text, ",", ".").try_cast("decimal(28,9)") * 1_000_000).cast("bigint"))
    return F.coalesce(number, nanos, fraction)


def parts(cut: Column) -> Column:
    """Struct of the parts in the array of ``split_time``; null where it holds no time.

    ``y, mo, d, h, mi`` int, ``s`` decimal(16,6) (fractions cut at microseconds),
    ``offset_min`` int (null without zone information), ``zone`` string (a named zone).
    """
    g = lambda i: F.get(cut, F.lit(i - 1))
    num = lambda i: F.when(g(i) == "", F.lit(0)).otherwise(g(i).try_cast("int"))
    month = F.coalesce(g(2).try_cast("int"), F.try_element_at(_months(), F.lower(g(2))))
    half = F.upper(g(8))
    hour = F.when(half == "", num(4)).when(num(4).between(1, 12), (num(4) % 12) + F.when(half == "PM", 12).otherwise(0))
    second = F.concat(F.when(g(6) == "", "0").otherwise(g(6)), F.lit("."), F.rpad(F.substring(g(7), 1, 6), 6, "0")).try_cast("decimal(16,6)")
    z = F.upper(g(9))
    digits = F.rpad(F.regexp_replace(z, "[^0-9]", ""), 4, "0")
    minutes = F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int")
    offset = F.when(z.startswith("+"), minutes).when(z.startswith("-"), -minutes).otherwise(F.try_element_at(_zones(), z))
    return F.when(
        (F.size(cut) == 10) & ((z == "") | offset.isNotNull()),
        F.struct(
            num(1).alias("y"),
            month.alias("mo"),
            num(3).alias("d"),
            hour.alias("h"),
            num(5).alias("mi"),
            second.alias("s"),
            offset.alias("offset_min"),
            F.when(g(10) == "", F.lit(None).cast("string")).otherwise(g(10)).alias("zone"),
        ),
    )
