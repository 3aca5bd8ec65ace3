"""Scalar text and number functions, as expressions of Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dims


def mib(x: Column, places: int = 2) -> Column:
    return F.round(x / F.lit(float(dims.MIB)), places)


def bits_per_pixel(size: Column, width: Column, height: Column) -> Column:
    """Bits per pixel at 5 places; null without a positive size of the picture."""
    return F.when((width > 0) & (height > 0), F.round(8.0 * size / (width.cast("double") * height), 5))


def human_size(n: Column) -> Column:
    """Bytes as B, KB, MB or GB of 1024, one place beyond B."""
    k, m, g = (float(1 << s) for s in (10, 20, 30))
    return F.when(n.isNull(), None).when(n < k, F.format_string("%d B", n.cast("long"))).when(n < m, F.format_string("%.1f KB", n / k)).when(n < g, F.format_string("%.1f MB", n / m)).otherwise(F.format_string("%.2f GB", n / g))


def size_label(n: Column) -> Column:
    """Whole KB below 10 MiB, whole MB from there."""
    return F.when(n < 10 * dims.MIB, F.concat(F.floor(n / 1024).cast("string"), F.lit("KB"))).otherwise(F.concat(F.floor(n / dims.MIB).cast("string"), F.lit("MB")))


def file_name(prefix: Column, number: Column, fmt: Column, width: Column, height: Column, size: Column, extension: Column) -> Column:
    """prefix_00001_FORMAT_WxH_12KB.ext; the dimensions only where they are known."""
    shape = F.when(width > 0, F.format_string("_%dx%d", width.cast("long"), height.cast("long"))).otherwise("")
    return F.concat(prefix, F.lit("_"), padded(number), F.lit("_"), fmt, shape, F.lit("_"), size_label(size), F.lit("."), extension)


def camera_name(prefix: Column, number: Column, extension: Column) -> Column:
    """PRE00001.EXT"""
    return F.concat(prefix, padded(number), F.lit("."), F.upper(extension))


def padded(number: Column, width: int = 5) -> Column:
    """Number with leading zeros to `width`; longer numbers stay whole."""
    text = number.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def parse_size(text: Column) -> Column:
    """'1280x720' -> struct(w, h), case-blind; null if it isn't one or a side is 0."""
    pattern = r"^\s*(\d+)\s*[xX]\s*(\d+)\s*$"
    w, h = (F.regexp_extract(text, pattern, i).try_cast("int") for i in (1, 2))
    return F.when((w > 0) & (h > 0), F.struct(w.alias("w"), h.alias("h")))


def parse_sizes(text: Column) -> Column:
    """The distinct sizes of a comma-separated list, without what isn't one."""
    return F.array_distinct(F.filter(F.transform(F.split(text, ","), parse_size), lambda x: x.isNotNull()))


def collapsed(text: Column) -> Column:
    """Each run of white space (of any script) as one blank, trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def preview(text: Column, n: int) -> Column:
    """collapsed(), cut to n - 3 characters (1 at least) and '...' if longer than n."""
    flat = collapsed(text)
    return F.when(F.length(flat) <= n, flat).otherwise(F.concat(F.substring(flat, 1, max(n - 3, 1)), F.lit("...")))


def snippet(text: Column, n: int = 240) -> Column:
    """The first n characters, with '…' if there are more."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def first_text(*values: Column) -> Column:
    """The first value that isn't blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(v), F.lit("")) for v in values])


def first_number(*values: Column) -> Column:
    """The first number that is finite."""
    return F.coalesce(*[F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v) for v in values])


# Amounts of parameters, as they are stated and as they stand in ids.
STATED_AMOUNT = r"(?i)(\d+(?:\.\d+)?)\s*([bm])"
AMOUNT_IN_ID = r"(?i)(?:^|[^\d])(\d+(?:\.\d+)?)\s*([bm])(?:$|[^\w])"


def _amount(text: Column, pattern: str) -> Column:
    value = F.regexp_extract(text, pattern, 1).try_cast("double")
    return value * F.when(F.lower(F.regexp_extract(text, pattern, 2)) == "b", 1e9).otherwise(1e6)


def parse_params(text: Column) -> Column:
    """'7B', '350 m' -> 7e9, 3.5e8; null if there is no such amount."""
    return _amount(F.trim(text), STATED_AMOUNT)


def infer_params(text: Column) -> Column:
    """As parse_params inside an id, where neither a digit stands before nor a word character after the amount."""
    return _amount(text, AMOUNT_IN_ID)


def pretty_id(name: Column) -> Column:
    """The part after the last '/', with blanks for runs of '-' and '_'."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.substring_index(name, "/", -1), r"[-_]+", " "), r"\s+", " "))


def compact_number(x: Column) -> Column:
    """131072 -> '131.1K': one place at most, none if it is 0."""
    scaled = lambda unit, sign: F.concat(F.regexp_replace(F.format_string("%.1f", x / unit), r"\.0$", ""), F.lit(sign))
    return F.when(x.isNull(), None).when(x < 999.95, scaled(1.0, "")).when(x < 999_950.0, scaled(1e3, "K")).when(x < 999_950_000.0, scaled(1e6, "M")).otherwise(scaled(1e9, "B"))


def without_trailing_slashes(text: Column) -> Column:
    return F.regexp_replace(text, "/+$", "")


def one_of(text: Column, allowed: list[str], default: str) -> Column:
    """The lower-cased, trimmed value if it is allowed, else the default."""
    value = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(value.isin(*allowed), value).otherwise(default)


def parse_bool(text: Column, default: bool = True) -> Column:
    """False only for 0, false, no and off; null and blank give the default."""
    value = F.lower(F.trim(text))
    return F.when(value.isNull() | (value == ""), default).otherwise(~value.isin("0", "false", "no", "off"))


def iso_date(text: Column) -> Column:
    """Dates as yyyy-MM-dd, other text as it is."""
    return F.coalesce(F.date_format(F.try_to_timestamp(text), "yyyy-MM-dd"), text)


def month_name(month: Column) -> Column:
    return F.try_element_at(F.array(*map(F.lit, dims.MONTHS)), month)


def period_label(service: Column, year: Column, month: Column) -> Column:
    """'NAME 2024-03'"""
    return F.format_string("%s %d-%02d", service, year.cast("int"), month.cast("int"))


def path_parts(path: Column) -> dict[str, Column]:
    """Top folder, file name, stem and suffix (with its dot) of a relative path."""
    name = F.substring_index(path, "/", -1)
    suffix = F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)
    return {"top": F.substring_index(path, "/", 1), "name": name, "suffix": suffix, "stem": F.substring(name, F.lit(1), F.length(name) - F.length(suffix))}


def is_unsafe_path(path: Column) -> Column:
    """Absolute, or with a '..' part."""
    return path.startswith("/") | F.array_contains(F.split(path, "/"), "..")


def sorted_keys(json: Column) -> Column:
    """Names of a JSON object, sorted."""
    return F.array_sort(F.json_object_keys(json))


def elapsed_ms(start: Column, end: Column) -> Column:
    """Milliseconds between two timestamps at 2 places."""
    return F.round((F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1000.0, 2)
