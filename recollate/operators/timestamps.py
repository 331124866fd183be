"""Mixed timestamp notations to one UTC instant.

An ordered cascade of anchored patterns: each family rewrites a matching value into one canonical
``y|mo|d|h|mi|s|fraction|zone|am/pm`` string, whose parts are then checked strictly and turned into
microseconds by integer arithmetic. All of it is built-in expressions, so it runs inside code generation.

Policies
* a value without zone lies in the zone given for its source (``tz``); unknown or missing zone: null
* skipped and repeated local times take the offset before the change
* a zone abbreviation is its own fixed offset; an unknown abbreviation: null
* a date alone is local midnight; a missing second is 0; fractions are cut after six digits
* bare numbers are Unix time: below 1e11 seconds, below 1e14 milliseconds, below 1e17 microseconds
* null, blank, non-times and impossible dates: null
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Offsets of zone abbreviations in minutes.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180,
    "MSK": 180, "IST": 330, "HKT": 480, "SGT": 480, "AWST": 480, "JST": 540, "KST": 540, "ACST": 570, "ACDT": 630,
    "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300,
    "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}
_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec"
_MONTH = "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
_ZONE = r"(?: ?(z|[+-]\d{2}:?\d{2}|[a-z]{2,5}))?"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,12}))?)?(?: ?([ap]m))?"
#: (pattern, replacement); the order of the cascade. Slashed dates keep their order open: a|b are settled by date_order.
CASCADE = (
    (r"(?i)^(\d{4})-(\d{2})-(\d{2})(?:[t ](\d{2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,12}))?)?" + _ZONE + ")?$", "$1|$2|$3|$4|$5|$6|$7|$8|"),
    (r"(?i)^(\d{4})(\d{2})(\d{2})t(\d{2})(\d{2})(\d{2})?(?:[.,](\d{1,12}))?" + _ZONE + "$", "$1|$2|$3|$4|$5|$6|$7|$8|"),
    (r"(?i)^(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,? )?(\d{1,2})[ -](" + _MONTH + r")[ -](\d{4})(?:,? " + _CLOCK + _ZONE + ")?$", "$3|$2|$1|$4|$5|$6|$7|$9|$8"),
    (r"(?i)^(\d{1,2})/(\d{1,2})/(\d{4})(?:,? " + _CLOCK + _ZONE + ")?$", "$3/|$1|$2|$4|$5|$6|$7|$9|$8"),
    (r"^(\d{4})年(\d{1,2})月(\d{1,2})日(?: ?(\d{1,2})[:时](\d{2})(?:[:分](\d{2})秒?|分)?)?$", "$1|$2|$3|$4|$5|$6|||"),
)
_NUMBER = r"^-?\d{1,17}(\.\d{1,12})?$"


def _int(text: Column) -> Column:
    return text.try_cast("int")


def _days(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 in the proleptic Gregorian calendar, by arithmetic only (no exception on bad input)."""
    shifted = F.when(m > 2, y).otherwise(y - 1)
    era = F.floor(shifted / 400)
    of_era = shifted - era * 400
    of_year = F.floor((F.lit(153) * F.when(m > 2, m - 3).otherwise(m + 9) + 2) / 5) + d - 1
    return (era * 146097 + of_era * 365 + F.floor(of_era / 4) - F.floor(of_era / 100) + of_year - 719468).cast("long")


def _bind(df: DataFrame, keep: list[str], prefix: str, **named: Column) -> DataFrame:
    """df's ``keep`` columns with the named expressions (under a prefix), each evaluated once.

    A generator over a one-element array is a boundary that neither projection collapsing nor filter
    pushdown crosses; plain projections would inline the cascade into each of its many uses.
    """
    return df.select(*[F.col(f"`{c}`") for c in keep], F.inline(F.array(F.struct(*[e.alias(prefix + n) for n, e in named.items()]))))


def known_zones(df: DataFrame) -> list[str]:
    """Zone names of the JVM (a fixed list of some 600), so that a misspelt zone gives null instead of a failure."""
    zones = df.sparkSession._jvm.java.time.ZoneId.getAvailableZoneIds().toString()
    return sorted(zones.strip("[]").split(", "))


def with_instant(df: DataFrame, value: str, tz: str, date_order: str, out: str = "epoch_us") -> DataFrame:
    """df with ``out``: the instant of column ``value`` in microseconds since 1970-01-01 UTC, or null.

    ``tz`` names the column with the source's IANA zone, ``date_order`` the one with DMY or MDY (other or
    null: such slashed dates denote nothing). Helper columns never clash with those of df.
    """
    cols = df.columns
    x = "__"
    while any(c.startswith(x) for c in cols):
        x += "_"
    v = F.trim(F.col(value))
    norm = F.lit(None).cast("string")
    for pattern, layout in reversed(CASCADE):
        norm = F.when(v.rlike(pattern), F.regexp_replace(v, pattern, layout)).otherwise(norm)
    base = _bind(df, cols, x, p=F.split(F.lower(norm), r"\|"), n=F.when(v.rlike(_NUMBER), v.cast("decimal(38,12)")))
    p = [F.col(x + "p")[i] for i in range(9)]
    month_at = F.instr(F.lit(_MONTHS), F.substring(p[1], 1, 3))
    order = F.upper(F.trim(F.col(date_order)))
    slashed = p[0].endswith("/")
    first, second = _int(p[1]), _int(p[2])
    clock = F.coalesce(_int(p[3]), F.lit(0))
    half = p[8]
    hour = F.when(half == "", clock).when(clock.between(1, 12), clock % 12 + F.when(half == "pm", 12).otherwise(0)).otherwise(99)
    zone = F.upper(p[7])
    signed = zone.rlike(r"^[+-]")
    digits = F.regexp_replace(zone, r"[^0-9]", "")
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    offset_h, offset_m = _int(F.substring(digits, 1, 2)), _int(F.substring(digits, 3, 2))
    table = F.create_map(*[F.lit(v) for kv in ABBREVIATIONS.items() for v in kv])
    offset = F.when(signed & (offset_h <= 18) & (offset_m <= 59), sign * (offset_h * 60 + offset_m)).when(~signed, F.try_element_at(table, zone))
    month = (
        F.when(slashed & (order == "MDY"), first)
        .when(slashed & (order == "DMY"), second)
        .when(slashed, None)
        .when(month_at > 0, ((month_at + 3) / 4).cast("int"))
        .otherwise(first)
    )
    day = F.when(slashed & (order == "DMY"), first).when(slashed & ~F.coalesce(order == "MDY", F.lit(False)), None).otherwise(second)
    parts = _bind(
        base,
        [*cols, x + "n"],
        x,
        y=_int(F.regexp_replace(p[0], "/", "")),
        m=month,
        d=day,
        h=hour,
        i=F.coalesce(_int(p[4]), F.lit(0)),
        s=F.coalesce(_int(p[5]), F.lit(0)),
        f=F.coalesce(_int(F.rpad(F.substring(p[6], 1, 6), 6, "0")), F.lit(0)),
        zoned=zone != "",
        o=offset,
    )
    y, m, d = F.col(x + "y"), F.col(x + "m"), F.col(x + "d")
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    last = F.when(m.isin(4, 6, 9, 11), 30).when(m == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    valid = m.between(1, 12) & (d >= 1) & (d <= last) & (y >= 1) & (F.col(x + "h") <= 23) & (F.col(x + "i") <= 59) & (F.col(x + "s") <= 59)
    seconds = _days(y, m, d) * F.lit(86400).cast("long") + F.col(x + "h") * 3600 + F.col(x + "i") * 60 + F.col(x + "s")
    wall = F.when(valid, seconds * F.lit(1000000).cast("long") + F.col(x + "f"))
    walled = _bind(parts, [*cols, x + "n", x + "zoned", x + "o"], x, w=wall, tz=F.when(F.col(tz).isin(known_zones(df)), F.col(tz)))
    n = F.col(x + "n")
    size = F.abs(n)
    number = F.when(size < 10**11, n * 1000000).when(size < 10**14, n * 1000).when(size < 10**17, n)
    local = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(x + "w"), F.col(x + "tz")))
    instant = F.when(n.isNotNull(), number.cast("long")).when(F.col(x + "zoned"), F.col(x + "w") - F.col(x + "o").cast("long") * 60000000).otherwise(local)
    return _bind(walled, [c for c in cols if c != out], "", **{out: instant})
