"""Column functions for X12 text. All are built-in expressions, so they stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that Unicode text processing treats as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Remittance status code -> claim status. Other codes leave the claim as it is.
STATUS_BY_CODE = {"1": "paid", "2": "paid", "3": "paid", "4": "denied",
                  "19": "paid", "20": "paid", "22": "void"}

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_ZERO = r"^[+-]?[0.]+([eE][+-]?[0-9]+)?$"


# Any character but visible ASCII: a quick test that covers all white space.
_UNUSUAL = "[^\\x21-\\x7e]"

# Names that need no change of case, which is slow for so short a text.
_COMMON_NAMES = ("AMT", "CAS", "CLM", "CLP", "DTM", "DTP", "HI", "HL", "LQ", "LX", "N1", "NM1", "REF", "SV1",
                 "SVC")

_PUNCTUATION = list("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def strip(c: Column) -> Column:
    """Drop white space of every kind, line ends included, from both ends."""
    # Most texts begin and end with visible ASCII, which two comparisons of one character tell.
    usual = F.substring(c, 1, 1).between("!", "~") & F.substring(c, -1, 1).between("!", "~")
    return F.when(usual, c).otherwise(F.btrim(c, F.lit(WHITESPACE)))


def is_blank(c: Column) -> Column:
    """Whether ``strip`` leaves nothing. Reads no further than the first character that stays."""
    return F.ltrim(c, F.lit(WHITESPACE)) == ""


def split_on(c: Column, separator: Column) -> Column:
    """Split on a one-character separator held in a column.

    A backslash before a punctuation character is a literal, and the JVM splits on that form
    without compiling a pattern per row.
    """
    pattern = F.when(separator.isin(_PUNCTUATION), F.concat(F.lit("\\"), separator)).otherwise(
        F.concat(F.lit("\\Q"), separator, F.lit("\\E")))
    return F.split(c, pattern, -1)


def elements_of(segment: Column, separator: Column) -> Column:
    """Elements of a segment, each stripped; element 0 is the name."""
    parts = split_on(segment, separator)
    return F.when(segment.rlike(_UNUSUAL), F.transform(parts, strip)).otherwise(parts)


def safe_element(elements: Column, i: int | Column, default: str | None = "") -> Column:
    """Element ``i`` of ``elements_of``, or ``default`` when it is out of range or blank."""
    found = F.get(elements, F.lit(i) if isinstance(i, int) else i)
    if default == "":
        return F.coalesce(found, F.lit(""))
    return F.coalesce(F.nullif(found, F.lit("")), F.lit(default))


def is_decimal(c: Column) -> Column:
    """Whether stripped text is a plain or scientific decimal number; null counts as no."""
    return F.coalesce(c.rlike(_NUMBER), F.lit(False))


def is_zero(c: Column) -> Column:
    """Whether stripped text is a number equal to zero, before any rounding."""
    return F.coalesce(c.rlike(_ZERO), F.lit(False)) & is_decimal(c)


def safe_decimal(c: Column, precision: int = 12, scale: int = 2) -> Column:
    """Decimal of stripped text, rounded half up; null when it is no number or does not fit."""
    return F.when(is_decimal(c), c.try_cast(f"decimal({precision},{scale})"))


def overflows(c: Column, precision: int = 12, scale: int = 2) -> Column:
    """A number in the text that the column type cannot hold."""
    # A number with no more characters than the type has integer digits fits, unless by an exponent.
    maybe = (F.length(c) > precision - scale) | F.contains(c, F.lit("e")) | F.contains(c, F.lit("E"))
    return maybe & is_decimal(c) & c.try_cast(f"decimal({precision},{scale})").isNull()


def safe_date(c: Column) -> Column:
    """Date from exactly eight digits CCYYMMDD, else null."""
    # The cast reads yyyy-MM-dd; a date pattern would take ten times as long.
    dashed = F.concat_ws("-", F.substring(c, 1, 4), F.substring(c, 5, 2), F.substring(c, 7, 2))
    return F.when(c.rlike("^[0-9]{8}$") & ~c.startswith("0000"), dashed.try_cast("date"))


def split_composite(c: Column, separator: Column) -> Column:
    """Parts of a composite, not stripped; an empty composite has no parts."""
    return F.when(c == "", F.array().cast("array<string>")).otherwise(split_on(c, separator))


def segment_name(elements: Column) -> Column:
    name = F.get(elements, F.lit(0))
    return F.when(name.isin(*_COMMON_NAMES), name).otherwise(F.upper(name))


def claim_status_for(code: Column) -> Column:
    """Claim status for a remittance status code; null for codes that change nothing."""
    out = F.lit(None).cast("string")
    for value, status in STATUS_BY_CODE.items():
        out = F.when(code == value, F.lit(status)).otherwise(out)
    return out


def as_of(as_of_date: str | None) -> Column:
    """The date that stands for "today"."""
    return F.current_date() if as_of_date is None else F.lit(as_of_date).cast("date")


def entity_id(upload_seq: Column, position: Column) -> Column:
    """Id that sorts in upload order, then file order. Needs ``upload_seq`` below 2**31."""
    return F.shiftleft(upload_seq.cast("long"), 31) + position.cast("long")


def position_of(entity: Column) -> Column:
    """The segment position inside an ``entity_id``."""
    return entity.bitwiseAND(F.lit((1 << 31) - 1)).cast("int")


def diagnosis_entries(elements: Column, component: Column) -> Column:
    """Diagnoses of one HI segment, in order; blank composites and blank codes are left out."""
    def entry(x):
        parts = split_composite(x, component)
        return F.struct(F.coalesce(F.get(parts, F.lit(0)), F.lit("")).alias("diagnosis_type"),
                        F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("diagnosis_code"))
    composites = F.slice(elements, F.lit(2), F.greatest(F.size(elements) - 1, F.lit(0)))
    entries = F.transform(composites, entry)
    return F.filter(entries, lambda d: d["diagnosis_code"] != "")


def adjustment_entries(elements: Column) -> Column:
    """Reason / amount pairs of one CAS segment.

    Triplets start at element 2. The first blank reason ends the scan, and a bad amount drops
    its own triplet only. Amounts stay text so that the caller can tell overflow from no number.
    """
    starts = F.when(F.size(elements) > 2, F.sequence(F.lit(2), F.size(elements) - 1, F.lit(3)))
    triplets = F.transform(starts, lambda i: F.struct(
        safe_element(elements, i).alias("reason"),
        safe_element(elements, i + 1).alias("amount"),
        i.cast("int").alias("at")))
    stop = F.array_position(F.transform(triplets, lambda t: t["reason"]), F.lit(""))
    kept = F.when(stop > 0, F.slice(triplets, F.lit(1), stop.cast("int") - 1)).otherwise(triplets)
    return F.filter(kept, lambda t: is_decimal(t["amount"]))
