"""Cell cleaning as pure column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters that count as white space in a cell.
WS_CHARS = (
    "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
WS_CLASS = "[\\s\\u000b\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"
# What a number looks like once separators are gone.
NUMBER_RE = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
# Texts read as true.
TRUE_WORDS = ("1", "true", "yes", "y", "是")
KEY_MODES = ("trim", "trim_lower", "trim_collapse_ws")
CASES = ("keep", "lower", "upper", "title")
# Day zero of a serial date, and the further text patterns accepted for dates.
EPOCH = "1899-12-30"
DATE_PATTERNS = ("M/d/yyyy", "d MMM yyyy", "MMM d, yyyy", "d-MMM-yyyy")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_ws(c: Column | str) -> Column:
    return F.btrim(_col(c), F.lit(WS_CHARS))


def collapse_ws(c: Column | str) -> Column:
    return F.btrim(F.regexp_replace(_col(c), WS_CLASS + "+", " "), F.lit(" "))


def is_blank(c: Column | str) -> Column:
    c = _col(c)
    return c.isNull() | (trim_ws(c.cast("string")) == "")


def title_words(c: Column | str) -> Column:
    """Every run of ASCII letters capitalised, everything else untouched."""
    parts = F.regexp_extract_all(_col(c), F.lit("([A-Za-z]+|[^A-Za-z]+)"), F.lit(1))
    cap = F.transform(
        parts,
        lambda x: F.when(
            x.rlike("^[A-Za-z]"), F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substr(x, F.lit(2))))
        ).otherwise(x),
    )
    return F.array_join(cap, "")


def normalize_text(c: Column | str, case: str = "title") -> Column:
    """Collapsed white space, then the requested letter case; NULL becomes empty text."""
    if case not in CASES:
        raise ValueError(f"case must be one of {', '.join(CASES)}")
    s = F.coalesce(collapse_ws(_col(c).cast("string")), F.lit(""))
    if case == "lower":
        return F.lower(s)
    if case == "upper":
        return F.upper(s)
    return title_words(s) if case == "title" else s


def number_to_plain_text(c: Column | str) -> Column:
    """A number as plain digits: no grouping, no exponent, no trailing zeros."""
    s = _col(c).cast("string")
    wide = F.regexp_replace(s.try_cast("decimal(38,18)").cast("string"), r"\.?0+$", "")
    short = F.when(s.contains("."), F.regexp_replace(s, r"\.?0+$", "")).otherwise(s)
    return F.when(s.rlike("[eE]"), F.coalesce(wide, s)).otherwise(short)


def cell_text(c: Column | str, dtype: T.DataType) -> Column:
    """A cell as the text a person would see (numbers without exponent or trailing zeros)."""
    c = _col(c)
    if isinstance(dtype, T.StringType):
        return c
    if isinstance(dtype, (T.DoubleType, T.FloatType, T.DecimalType)):
        return number_to_plain_text(c)
    return c.cast("string")


def normalize_key(c: Column | str, mode: str = "trim", dtype: T.DataType | None = None) -> Column:
    """One part of a matching key; NULL becomes empty text."""
    if mode not in KEY_MODES:
        raise ValueError(f"key mode must be one of {', '.join(KEY_MODES)}")
    text = cell_text(c, dtype or T.StringType())
    if isinstance(dtype or T.StringType(), T.StringType):
        text = trim_ws(text)
        if mode == "trim_collapse_ws":
            text = F.regexp_replace(text, WS_CLASS + "+", " ")
    if mode == "trim_lower":
        text = F.lower(text)
    return F.coalesce(text, F.lit(""))


def key_of(df: DataFrame, names: list[str], mode: str = "trim") -> Column:
    """Composite key text: normalised parts joined by the unit separator."""
    return F.concat_ws("\x1f", *[normalize_key(F.col(f"`{n}`"), mode, df.schema[n].dataType) for n in names])


def _number_text(c: Column, currency: bool) -> Column:
    drop = ",¥$€" if currency else ","
    return F.translate(trim_ws(c), drop, "")


def _parse_number(s: Column) -> Column:
    return F.when(s.rlike(NUMBER_RE), s.try_cast("double"))


def to_number(c: Column | str, dtype: T.DataType | None = None, currency: bool = False) -> Column:
    """Text to DOUBLE; commas (and currency signs) dropped, anything else unparsable becomes NULL."""
    c = _col(c)
    if isinstance(dtype, T.NumericType):
        return c
    if isinstance(dtype, T.BooleanType):
        return c.cast("double")
    return _parse_number(_number_text(c.cast("string"), currency))


def number_kind(c: Column | str, dtype: T.DataType | None = None, currency: bool = False) -> Column:
    """``same`` (already a number, or empty), ``converted`` or ``blanked``."""
    c = _col(c)
    if isinstance(dtype, T.NumericType):
        return F.lit("same")
    s = c.cast("string")
    return (
        F.when(s.isNull() | (s == ""), "same")
        .when(to_number(c, dtype, currency).isNotNull(), "converted")
        .otherwise("blanked")
    )


def _ymd(y: Column, m: Column, d: Column) -> Column:
    return F.concat_ws("-", y, m, d).try_cast("date")


def serial_to_date(n: Column | str) -> Column:
    """Spreadsheet serial day to DATE, rounded to the nearest day."""
    return F.date_add(F.lit(EPOCH).cast("date"), F.floor(_col(n) + 0.5).cast("int"))


def _number_to_date(v: Column) -> Column:
    v = v.cast("double")
    n = F.floor(v).cast("string")
    return F.when(
        v.between(19000101, 20991231), _ymd(F.substring(n, 1, 4), F.substring(n, 5, 2), F.substring(n, 7, 2))
    ).when(v.between(1, 60000), serial_to_date(v))


def to_date(c: Column | str, dtype: T.DataType | None = None) -> Column:
    """Serial day, yyyymmdd, ISO-like text or one of ``DATE_PATTERNS`` to DATE; else NULL."""
    c = _col(c)
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return c.cast("date")
    if isinstance(dtype, T.NumericType):
        return _number_to_date(c)
    if isinstance(dtype, T.BooleanType):
        return F.lit(None).cast("date")
    s = trim_ws(c)
    lead = r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})"
    prefix = _ymd(*[F.regexp_extract(s, lead, i) for i in (1, 2, 3)])
    other = F.coalesce(*[F.try_to_timestamp(s, F.lit(p)).cast("date") for p in DATE_PATTERNS])
    return (
        F.when(s.rlike(r"^\d{8}$"), _ymd(F.substring(s, 1, 4), F.substring(s, 5, 2), F.substring(s, 7, 2)))
        .when(s.rlike(lead), prefix)
        .when(s.rlike("[A-Za-z/]"), other)
    )


def date_kind(c: Column | str, dtype: T.DataType | None = None) -> Column:
    c = _col(c)
    s = c.cast("string")
    return (
        F.when(s.isNull() | (s == ""), "same").when(to_date(c, dtype).isNotNull(), "converted").otherwise("blanked")
    )


def day_to_iso(n: Column | str) -> Column:
    return F.date_format(serial_to_date(n), "yyyy-MM-dd")


def to_text(c: Column | str, dtype: T.DataType | None = None) -> Column:
    return F.coalesce(trim_ws(cell_text(c, dtype or T.StringType())), F.lit(""))


def to_bool(c: Column | str) -> Column:
    return F.coalesce(F.lower(trim_ws(_col(c).cast("string"))).isin(*TRUE_WORDS), F.lit(False))


def to_id_text(value: Column | str, dtype: T.DataType | None = None, shown: Column | None = None) -> Column:
    """Identifier as text: the displayed text unless that is in exponent form, else plain digits."""
    value = _col(value)
    plain = to_text(value, dtype)
    if shown is None:
        return plain
    text = F.coalesce(trim_ws(shown), F.lit(""))
    return F.when((text != "") & ~text.rlike(r"[eE][+-]?\d+$"), text).otherwise(plain)


def normalize_sku(c: Column | str) -> Column:
    return F.lower(trim_ws(c))


def flag_bad_amount(c: Column | str) -> Column:
    """True where a non-empty amount does not parse; such rows stay but are left out of sums."""
    return number_kind(c, None, currency=True) == "blanked"


def safe_ratio(num: Column | str, den: Column | str) -> Column:
    """NULL when the denominator is 0 or missing."""
    return F.try_divide(_col(num).cast("double"), _col(den).cast("double"))
