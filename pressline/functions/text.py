"""Text helpers: trimming, truthiness, number text, titles, key hash."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pressline.functions.once import let

# The characters the reference trims (space, tab, newline, return, NUL, vertical tab).
TRIM_CHARS = " \t\n\r\u0000\u000b"

# Fixed value: leading agency tag of a title.
AGENCY_PREFIX = r"(?U)^POL-[A-ZÄÖÜ]{1,5}:\s*"

# Fixed value: label in front of a listed place.
EVENT_LOCATION_PREFIX = r"(?i)^Ereignisort:\s*"


def rx(pattern: str, fold: str | None = None) -> str:
    """Pattern with a case-folding flag: ``ascii``, ``unicode`` or none."""
    return {None: "", "ascii": "(?i)", "unicode": "(?iu)"}[fold] + pattern


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(TRIM_CHARS))


def squeeze(c: Column) -> Column:
    """Runs of white space become one space, ends trimmed."""
    return trimmed(F.regexp_replace(c, r"\s+", " "))


def is_falsy(c: Column) -> Column:
    """Text that counts as missing: null, empty or ``0``."""
    return c.isNull() | c.isin("", "0")


def is_falsy_number(c: Column) -> Column:
    return c.isNull() | (c == 0)


def truthy(c: Column) -> Column:
    """The text itself, null where it counts as missing."""
    return F.when(~is_falsy(c), c)


def clean_title(c: Column) -> Column:
    """Trimmed title without the agency tag in front."""
    return F.regexp_replace(trimmed(c), AGENCY_PREFIX, "")


def default_title(c: Column, placeholder: str, zero_is_empty: bool = True) -> Column:
    """Placeholder for a missing title; ``zero_is_empty`` treats the text ``0`` as missing too."""
    empty = ["", "0"] if zero_is_empty else [""]
    return F.when(c.isNull() | c.isin(*empty), F.lit(placeholder)).otherwise(c)


def event_location(c: Column) -> Column:
    """Listed place without its label; missing text is null."""
    return truthy(trimmed(F.regexp_replace(c, EVENT_LOCATION_PREFIX, "")))


def parse_float_prefix(c: Column) -> Column:
    """Longest numeric prefix of a text as a double, null where there is none."""
    number = r"^\s*([+-]?(?:Infinity|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?))"
    return F.regexp_extract(c, number, 1).try_cast("double")


def _expanded(text: Column) -> Column:
    """Browser form of a double that Java prints with an exponent."""
    def digits_of(t: Column) -> Column:
        mantissa = F.regexp_replace(F.regexp_replace(t, r"E.*$", ""), r"[-.]", "")
        return F.regexp_replace(mantissa, r"0+$", "")

    def form(p: Column) -> Column:
        digits, e, n = p["digits"], p["e"], F.length(p["digits"])
        head, tail = F.substring(digits, 1, 1), F.substring(digits, F.lit(2), n)
        mantissa = F.when(n > 1, F.concat(head, F.lit("."), tail)).otherwise(digits)
        return F.concat(
            p["sign"],
            F.when((e < 0) & (e >= -6), F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits))
            .when((e >= 0) & (e < 21) & (n <= e + 1), F.rpad(digits, e + 1, F.lit("0")))
            .when((e >= 0) & (e < 21), F.concat(F.substring(digits, F.lit(1), e + 1), F.lit("."), F.substring(digits, e + 2, n)))
            .otherwise(F.concat(mantissa, F.when(e > 0, F.lit("e+")).otherwise(F.lit("e")), e.cast("string"))),
        )

    parts = F.struct(
        F.when(F.startswith(text, F.lit("-")), F.lit("-")).otherwise(F.lit("")).alias("sign"),
        digits_of(text).alias("digits"),
        F.regexp_extract(text, r"E(-?\d+)$", 1).cast("int").alias("e"),
    )
    return let(parts, form)


def _shortest(c: Column, text: Column) -> Column:
    """Text of a double with as few digits as still give it back; the JVM may print one too many."""
    def fewer(digits: int) -> Column:
        short = F.format_string(f"%.{digits - 1}e", c)
        return F.when(short.cast("double") == c, F.regexp_replace(short, r"e\+?(-?)0*(\d+)$", "E$1$2"))

    return F.when(F.length(text) >= 17, F.coalesce(fewer(15), fewer(16), text)).otherwise(text)


def js_number_text(c: Column) -> Column:
    """A double as a browser prints it: no ``.0``, plain digits from 1e-6 up to 1e21."""
    return let(
        let(c.cast("string"), lambda t: _shortest(c, t)),
        lambda t: F.when(t.isin("0.0", "-0.0"), F.lit("0"))
        .when(F.contains(t, F.lit("E")), _expanded(t))
        .otherwise(F.regexp_replace(t, r"\.0$", "")),
    )


def key_hash(c: Column) -> Column:
    """Polynomial hash (factor 31) of a text, wrapped to a signed 32-bit number."""
    folded = F.aggregate(
        F.transform(F.split(c, ""), lambda ch: F.ascii(ch).cast("long")),
        F.lit(0).cast("long"),
        lambda h, code: (h * 31 + code).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")),
    )
    # 2^31 is added, the low 32 bits are kept, and 2^31 is taken away again.
    return (folded + 2**31).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")) - 2**31
