"""Text keys and label cleaning as native Column expressions.

Every function takes and returns a ``Column`` so it stays inside whole-stage
codegen; none is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's for identical results.
# Whitespace stripped by the name keys (Python str.strip() on ASCII text).
WHITESPACE = " \t\n\r\x0b\x0c"
# Words dropped from service names before the price lookup.
SERVICE_STOP_WORDS = ["package", "laser", "add", "rabu", "dj", "5x", "3x"]
# Month abbreviations expanded in sheet labels; absent ones pass through.
MONTH_ABBREVIATIONS = {
    "jan": "january",
    "feb": "february",
    "mar": "march",
    "apr": "april",
    "jun": "june",
    "jul": "july",
    "agst": "august",
    "sept": "september",
    "okt": "october",
    "nov": "november",
    "des": "desember",
}
# Values treated as unknown in profile text columns.
UNKNOWN_TOKENS = ["nan", "", "None"]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Strip leading/trailing ASCII whitespace (``str.strip``)."""
    return F.btrim(_col(c), F.lit(WHITESPACE))


def name_key(c) -> Column:
    """Null -> '', strip, lower.  The customer join key."""
    return F.lower(strip_ws(F.coalesce(_col(c), F.lit(""))))


def name_key_nan(c) -> Column:
    """Like X1 but a null name becomes the literal ``'nan'``."""
    return F.lower(strip_ws(F.coalesce(_col(c).cast("string"), F.lit("nan"))))


def service_key(c) -> Column:
    """Lower, non-alphanumerics to space, drop stop words, squeeze spaces."""
    s = F.lower(F.coalesce(_col(c), F.lit("")))
    s = F.regexp_replace(s, r"[^a-z0-9\s]", " ")
    s = F.regexp_replace(s, r"\b(" + "|".join(SERVICE_STOP_WORDS) + r")\b", "")
    s = F.regexp_replace(s, r"\s+", " ")
    return strip_ws(s)


# The two-digit years whose glued labels get a space.
LABEL_YEARS = ("24", "25")


def month_label_spacing(c, years=LABEL_YEARS) -> Column:
    """lower/strip the label and put a space before a glued year suffix
    (reference: 24 and 25)."""
    s = F.lower(strip_ws(_col(c)))
    return F.regexp_replace(s, r"^(|.*\S)(" + "|".join(years) + r")$", "$1 $2")


def _month_map() -> Column:
    kv = []
    for k, v in MONTH_ABBREVIATIONS.items():
        kv += [F.lit(k), F.lit(v)]
    return F.create_map(*kv)


def expand_month(c) -> Column:
    """Expand a month abbreviation, keeping a two-digit year.

    Labels that do not look like ``word [yy]`` are returned unchanged; null
    stays null (the reference writes the text 'nan').
    """
    s = _col(c)
    pat = r"^([a-z]+)\s*(\d{2})?$"
    abbr = F.regexp_extract(s, pat, 1)
    yr = F.regexp_extract(s, pat, 2)
    full = F.coalesce(F.try_element_at(_month_map(), abbr), abbr)
    expanded = F.when(yr != "", F.concat_ws(" ", full, yr)).otherwise(full)
    return F.when(s.rlike(pat), expanded).otherwise(s)


def clean_month_label(c, years=LABEL_YEARS) -> Column:
    """X4 then X5."""
    return expand_month(month_label_spacing(c, years))


def vip_level(c) -> Column:
    """The number in ``(VIP n)``, '' when absent."""
    return F.regexp_extract(F.coalesce(_col(c), F.lit("nan")), r"(?i)\(VIP\s*(\d+)\)", 1)


def bracket_details(c) -> Column:
    """Bracketed notes other than ``VIP n``, joined by '; '."""
    parts = F.regexp_extract_all(F.coalesce(_col(c), F.lit("nan")), F.lit(r"\((.*?)\)"), F.lit(1))
    kept = F.filter(parts, lambda p: ~p.rlike(r"(?i)^VIP\s*\d+"))
    return F.array_join(kept, "; ")


def strip_brackets(c) -> Column:
    """Drop every bracketed part, then strip."""
    return strip_ws(F.regexp_replace(F.coalesce(_col(c), F.lit("nan")), r"\s*\(.*?\)", ""))


def strip_admin_prefix(c, prefix: str = "Kecamatan") -> Column:
    """Drop a leading administrative prefix word."""
    return F.regexp_replace(_col(c), "^" + prefix + r"\s+", "")


def is_address_continuation(c) -> Column:
    """X10 (test): a first-column cell starting ``*address``."""
    return F.coalesce(F.lower(strip_ws(_col(c))).startswith("*address"), F.lit(False))


def continuation_text(c) -> Column:
    """X10 (value): stripped text after the first ':'; '' when there is none."""
    return F.coalesce(strip_ws(F.get(F.split(_col(c), ":", 2), 1)), F.lit(""))


def blank_to_null(c) -> Column:
    """X11: whitespace-only or empty text becomes null."""
    s = _col(c)
    return F.when(s.rlike(r"^\s*$"), F.lit(None).cast("string")).otherwise(s)


def title_case(c) -> Column:
    """Python ``str.title`` — capitalise every letter run, lower the rest."""
    runs = F.regexp_extract_all(_col(c), F.lit("([A-Za-z]+|[^A-Za-z]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.initcap(r)), "")


def canonical_unknown(c) -> Column:
    """Null, 'nan', '', 'None' (after strip) -> 'Unknown'."""
    s = strip_ws(_col(c).cast("string"))
    return F.when(s.isNull() | s.isin(*UNKNOWN_TOKENS), F.lit("Unknown")).otherwise(s)


def canonical_yes_no(c) -> Column:
    """P10: case-insensitive 'yes' -> 'Yes', anything else (null too) -> 'No'."""
    return F.when(F.lower(strip_ws(_col(c).cast("string"))) == "yes", F.lit("Yes")).otherwise(F.lit("No"))
