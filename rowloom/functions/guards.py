"""Coercion and missing-value rules shared by all operators.

``df.schema`` decides which expression is used, so a numeric column is never
sent through the text parser and an already typed column costs nothing.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW = "_row_index"

# Words read as true or false.
TRUE_WORDS = ("true", "1", "yes", "y", "t")
FALSE_WORDS = ("false", "0", "no", "n", "f")

# Texts that count as a number (blanks around it allowed), and the
# blank characters of a text other than the space.
NUMBER_PATTERN = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))\s*$"
ODD_BLANKS = "\t\n\u000b\f\r\u001c\u001d\u001e\u001f\u0085  " + "".join(
    chr(c) for c in (*range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
)

# Shapes of times and date-times, each with the layout that reads it.
TIME_LAYOUTS = (
    (r"^\d{1,2}:\d{2}$", "H:mm"),
    (r"^\d{1,2}:\d{2}:\d{2}$", "H:mm:ss"),
    (r"^\d{1,2}:\d{2} [AP]M$", "h:mm a"),
    (r"^\d{1,2}:\d{2}:\d{2} [AP]M$", "h:mm:ss a"),
)
DATETIME_LAYOUTS = (
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$", "yyyy-M-d H:m:s"),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}$", "yyyy-M-d H:m"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}:\d{1,2}$", "M/d/yyyy H:m:s"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}$", "M/d/yyyy H:m"),
)


class ParameterError(ValueError):
    """A step was called with parameters that do not fit the table."""


def quoted(name: str) -> Column:
    """Column by its literal name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def data_columns(df: DataFrame) -> list[str]:
    """All columns but the row index."""
    return [c for c in df.columns if c != ROW]


def hashable(df: DataFrame) -> list[Column]:
    """Columns in a form that hashes: maps and variants as JSON text."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        out.append(F.to_json(F.struct(quoted(f.name))) if "map<" in kind or "variant" in kind else quoted(f.name))
    return out


def type_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def require(df: DataFrame, name: str | None, role: str = "column") -> str:
    if not name or name not in df.columns:
        raise ParameterError(f"{role} {name!r} is not in the table")
    return name


def require_free(df: DataFrame, name: str, allowed: Iterable[str] = ()) -> str:
    if name in df.columns and name not in set(allowed):
        raise ParameterError(f"column {name!r} already exists")
    return name


def require_batch(df: DataFrame, what: str) -> None:
    if df.isStreaming:
        raise ParameterError(f"{what} needs the whole table or its row order; it cannot run on a stream")


def is_floating(t: T.DataType) -> bool:
    return isinstance(t, (T.FloatType, T.DoubleType))


def is_number(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def is_time_point(t: T.DataType) -> bool:
    return isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType))


def missing(df: DataFrame, name: str) -> Column:
    """NULL, or NaN for floating columns."""
    c = quoted(name)
    return (c.isNull() | F.isnan(c)) if is_floating(type_of(df, name)) else c.isNull()


def present(df: DataFrame, name: str) -> Column:
    """The value with NaN turned into NULL."""
    c = quoted(name)
    return F.when(~F.isnan(c), c) if is_floating(type_of(df, name)) else c


def nan_to_null(df: DataFrame) -> DataFrame:
    floating = [f.name for f in df.schema.fields if is_floating(f.dataType)]
    return df.withColumns({c: present(df, c) for c in floating}) if floating else df


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(" " + ODD_BLANKS))


def squeeze(c: Column, ends: bool = True) -> Column:
    """Blank runs as one space and, with ``ends``, none at the ends."""
    spaced = F.regexp_replace(F.translate(c, ODD_BLANKS, " " * len(ODD_BLANKS)), "  +", " ")
    return F.trim(spaced) if ends else spaced


def text_to_number(c: Column) -> Column:
    return F.when(c.rlike(NUMBER_PATTERN), c.try_cast("double"))


def number(df: DataFrame, name: str) -> Column:
    """The column as double; anything that is not a number becomes NULL."""
    t = type_of(df, name)
    if is_floating(t):
        return present(df, name).cast("double")
    if is_number(t) or isinstance(t, T.BooleanType):
        return quoted(name).cast("double")
    if isinstance(t, T.StringType):
        return text_to_number(quoted(name))
    return F.lit(None).cast("double")


def text(df: DataFrame, name: str) -> Column:
    """The column as string, NaN as NULL."""
    return present(df, name).cast("string")


def text_to_bool(token: Column) -> Column:
    word = F.lower(token)
    return F.when(word.isin(*TRUE_WORDS), F.lit(True)).when(word.isin(*FALSE_WORDS), F.lit(False))


def parse_bool(df: DataFrame, name: str) -> Column:
    if isinstance(type_of(df, name), T.BooleanType):
        return quoted(name)
    return text_to_bool(strip(quoted(name).cast("string")))


def _by_shape(token: Column, layouts: tuple[tuple[str, str], ...]) -> Column:
    """Parse with the one layout whose shape fits, so that no row is tried on
    layouts it must fail."""
    (shape, layout), *rest = layouts
    out = F.when(token.rlike(shape), F.try_to_timestamp(token, F.lit(layout)))
    for shape, layout in rest:
        out = out.when(token.rlike(shape), F.try_to_timestamp(token, F.lit(layout)))
    return out


def text_to_time(c: Column, stripped: bool = False) -> Column:
    """``HH:mm:ss`` text of a 24-hour or AM/PM clock reading."""
    token = F.upper(c if stripped else strip(c))
    return F.date_format(_by_shape(token, TIME_LAYOUTS), "HH:mm:ss")


def parse_time(df: DataFrame, name: str) -> Column:
    if is_time_point(type_of(df, name)):
        return F.date_format(quoted(name), "HH:mm:ss")
    return text_to_time(quoted(name).cast("string"))


def text_to_timestamp(c: Column, stripped: bool = False) -> Column:
    """ISO form first, then the fixed layouts; each row is read on its own."""
    token = c if stripped else strip(c)
    iso = F.when(token.rlike(r"^\d{4}-\d{2}-\d{2}"), token.try_cast("timestamp_ntz"))
    other = _by_shape(token, DATETIME_LAYOUTS).cast("timestamp_ntz")
    return F.when(token.rlike(r"^\d{1,4}[-/]"), F.coalesce(iso, other))


def timestamp(df: DataFrame, name: str) -> Column:
    """The column as a zone-free timestamp; unreadable values become NULL."""
    t = type_of(df, name)
    if isinstance(t, T.TimestampNTZType):
        return quoted(name)
    if is_time_point(t):
        return quoted(name).cast("timestamp_ntz")
    if isinstance(t, T.StringType):
        return text_to_timestamp(quoted(name))
    return F.lit(None).cast("timestamp_ntz")


def text_is_json(c: Column, stripped: bool = False) -> Column:
    """True for text that opens with a brace or bracket and parses as JSON."""
    token = c if stripped else strip(c)
    opens = F.substring(token, 1, 1).isin("{", "[")
    return F.coalesce(opens & F.try_parse_json(token).isNotNull(), F.lit(False))


def place_after(df: DataFrame, source: str, added: dict[str, Column]) -> DataFrame:
    """Set ``added`` columns; the new ones stand right behind ``source``."""
    replaced = {n: c for n, c in added.items() if n in df.columns}
    fresh = {n: c for n, c in added.items() if n not in df.columns}
    out = []
    for name in df.columns:
        out.append(replaced[name].alias(name) if name in replaced else quoted(name))
        if name == source:
            out.extend(c.alias(n) for n, c in fresh.items())
    return df.select(*out)
