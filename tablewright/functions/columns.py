"""Column expressions for parsing, cleaning and counting.

Each helper returns a ``Column`` built only from ``pyspark.sql.functions`` so it stays inside
whole-stage codegen.  The SQL twins used by the DuckDB oracle live next to the Spark form so
both engines apply the same rule.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- fixed values -------------------------------------------------------------------------
# A numeric-looking string: optional sign, digits with optional fraction (or a bare
# fraction), optional exponent, surrounding whitespace allowed.  Used in both engines so that
# forms one engine accepts and the other rejects ('1.0d', '1_000', 'nan') are treated alike.
NUMERIC_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

# Date/time formats tried in order (Spark pattern, DuckDB strptime pattern).
DATETIME_FORMATS = [
    ("yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S"),
    ("yyyy-MM-dd'T'HH:mm:ss", "%Y-%m-%dT%H:%M:%S"),
    ("yyyy-MM-dd", "%Y-%m-%d"),
    ("yyyy/MM/dd", "%Y/%m/%d"),
    ("MM/dd/yyyy", "%m/%d/%Y"),
    ("dd.MM.yyyy", "%d.%m.%Y"),
]

# Every format above starts with digits, separator, digits, separator, digits; values without
# that shape cannot parse, so they skip the (exception-driven) parser attempts.
DATE_SHAPE = r"^[+-]?\d+[-/.]\d+[-/.]\d+"

# Characters stripped by the two quote-stripping steps.
QUOTE_CHARS = "'\""
# -------------------------------------------------------------------------------------------

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)
DATETIME_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)
NESTED_TYPES = (T.ArrayType, T.MapType, T.StructType)


def base_family(dtype: T.DataType) -> str:
    """Storage family of a Spark type: numeric, boolean, datetime, string, nested, other."""
    if isinstance(dtype, NUMERIC_TYPES):
        return "numeric"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, DATETIME_TYPES):
        return "datetime"
    if isinstance(dtype, T.StringType):
        return "string"
    if isinstance(dtype, NESTED_TYPES):
        return "nested"
    return "other"


def clean_value(c: str, dtype: T.DataType) -> Column:
    """The column with NaN folded into NULL (pandas counts NaN as missing, Spark does not)."""
    col = F.col(c)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(col), col)
    return col


def value_as_string(c: str, dtype: T.DataType) -> Column:
    """A string image of a value for distinct counting; nested values become JSON."""
    if isinstance(dtype, NESTED_TYPES):
        return F.to_json(F.col(c))
    return clean_value(c, dtype).cast("string")


def strip_ws(col: Column) -> Column:
    """Strip leading and trailing whitespace (``trim`` only removes spaces)."""
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def numeric_like(col: Column) -> Column:
    return col.rlike(NUMERIC_PATTERN)


def guarded_double(col: Column) -> Column:
    """Parse a numeric-looking string to double; anything else is NULL."""
    return F.when(numeric_like(col), strip_ws(col).try_cast("double"))


def parse_datetime(col: Column) -> Column:
    """First successful parse over ``DATETIME_FORMATS``; NULL when none applies."""
    return F.when(col.rlike(DATE_SHAPE),
                  F.coalesce(*[F.try_to_timestamp(col, F.lit(fmt)) for fmt, _ in DATETIME_FORMATS]))


def word_count(col: Column) -> Column:
    """Number of whitespace-separated tokens (0 for an empty string)."""
    return F.regexp_count(col, F.lit(r"\S+"))


def strip_quotes(col: Column) -> Column:
    """Strip quote characters from both ends, then whitespace."""
    return strip_ws(F.regexp_replace(col, r"^['\"]+|['\"]+$", ""))


def strip_quotes_fill(col: Column) -> Column:
    """Null to empty string, strip quotes and spaces from both ends, then whitespace."""
    return strip_ws(F.regexp_replace(F.coalesce(col, F.lit("")), r"^['\" ]+|['\" ]+$", ""))


def strip_label(col: Column) -> Column:
    """Class label image: quote characters and spaces stripped together from both ends."""
    return F.regexp_replace(col, r"^['\" ]+|['\" ]+$", "")


def finite_or_null(col: Column) -> Column:
    """The number as a double; NaN and infinities are missing values."""
    x = col.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def nonfinite_to_zero(col: Column) -> Column:
    return F.when(F.isnan(col) | (F.abs(col) == F.lit(float("inf"))), F.lit(0.0)).otherwise(col)


# ---- SQL twins for the DuckDB oracle -------------------------------------------------------

def sql_guarded_double(expr: str) -> str:
    return (f"CASE WHEN regexp_matches({expr}, '{NUMERIC_PATTERN}') "
            f"THEN TRY_CAST(regexp_replace({expr}, '^\\s+|\\s+$', '', 'g') AS DOUBLE) END")


def sql_parse_datetime(expr: str) -> str:
    parts = ", ".join(f"try_strptime({expr}, '{d}')" for _, d in DATETIME_FORMATS)
    return f"coalesce({parts})"


def sql_word_count(expr: str) -> str:
    return f"len(regexp_extract_all({expr}, '\\S+'))"


def sql_strip_quotes(expr: str) -> str:
    inner = f"regexp_replace({expr}, '^[''\"]+|[''\"]+$', '', 'g')"
    return f"regexp_replace({inner}, '^\\s+|\\s+$', '', 'g')"


def sql_strip_label(expr: str) -> str:
    return f"regexp_replace({expr}, '^[''\" ]+|[''\" ]+$', '', 'g')"


def sql_strip_quotes_fill(expr: str) -> str:
    inner = f"regexp_replace(coalesce({expr}, ''), '^[''\" ]+|[''\" ]+$', '', 'g')"
    return f"regexp_replace({inner}, '^\\s+|\\s+$', '', 'g')"
