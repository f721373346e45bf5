"""Column functions: safe casts, stable keys, hashes and bits."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def clean_double(value: Column, default: float | None = None) -> Column:
    """The value as a double; what is no finite number becomes the default."""
    v = value.try_cast("double")
    finite = F.when(F.abs(v) < F.lit(float("inf")), v)
    return finite if default is None else F.coalesce(finite, F.lit(default))


def clean_int(value: Column, default: int = 0) -> Column:
    """Rounded half to even."""
    return F.bround(clean_double(value, float(default))).cast("int")


def stable_path(path: Column, root: str = "Directory_") -> Column:
    """The path from its first component that starts with root on; else its last component."""
    inside = F.regexp_extract(path, rf"(?:^|/)({root}.*)$", 1)
    return F.coalesce(F.nullif(inside, F.lit("")), F.element_at(F.split(path, "/"), -1))


def safe_name(name: Column) -> Column:
    """Separators become two underscores, blanks one."""
    return F.replace(F.replace(F.replace(name, F.lit("/"), F.lit("__")), F.lit("\\"), F.lit("__")), F.lit(" "), F.lit("_"))


def item_token(subject: Column, series: Column, path: Column, digits: int = 20) -> Column:
    return F.concat_ws("__", subject, safe_name(series), F.substring(F.sha2(path, 256), 1, digits))


def group_key(series: Column, path: Column) -> Column:
    """Items of one series in one folder belong together."""
    return F.concat(series, F.lit("::"), F.regexp_extract(path, "^(.*)/", 1))


def natural_key(path: Column, width: int = 20) -> Column:
    """An array that sorts runs of digits by value and other text without case."""
    parts = F.regexp_extract_all(path, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.transform(parts, lambda x: F.when(x.rlike(r"^\d+$"), F.lpad(x, width, "0")).otherwise(F.lower(x)))


def normal_target(value: Column) -> Column:
    """Upper case; the ways to say that there is none become empty."""
    v = F.upper(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(v.isin("", "UNLABELED", "NONE", "NAN"), F.lit("")).otherwise(v)


def hash_order(*parts: Column | str) -> Column:
    """A reproducible order: SHA-256 of the parts, joined by bars."""
    return F.sha2(F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(p) for p in parts]), 256)


def hash_long(hex16: Column) -> Column:
    """16 hex digits as a signed long, also with the top bit set."""
    return F.conv(hex16, 16, -10).cast("long")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def sign_bits(vector: Column, n: int = 64) -> Column:
    """The signs of the first n numbers as the bits of a long, the first one highest."""
    bit = lambda k: F.when(F.get(vector, F.lit(k)) > 0, F.lit(1 << (63 - k) if k else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long"))
    out = bit(0)
    for k in range(1, n):
        out = out.bitwiseOR(bit(k))
    return out


def reasons(*rules: tuple[str, Column]) -> Column:
    """Names of the rules that hold, in order, joined by semicolons; null counts as no."""
    return F.concat_ws(";", *[F.when(holds, F.lit(name)) for name, holds in rules])


def elapsed(seconds: Column) -> Column:
    s = F.greatest(F.lit(0), seconds).cast("int")
    return F.format_string("%dh %02dm %02ds", (s / 3600).cast("int"), ((s % 3600) / 60).cast("int"), s % 60)


def median(value: Column) -> Column:
    return F.percentile(value, F.lit(0.5))
