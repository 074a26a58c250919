"""Names and tokens of runs and files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_token(v: Column) -> Column:
    """Letters and digits of a name, everything else as single underscores, none at the ends."""
    return F.regexp_replace(F.regexp_replace(v, "[^0-9A-Za-z]+", "_"), "^_+|_+$", "")


def decimal_token(x: float) -> str:
    """A number for a file name: 0.5 is 0p5, whole numbers have no fraction, minus is m."""
    text = f"{x:.6f}".rstrip("0").rstrip(".")
    return text.replace("-", "m").replace(".", "p")


def int_list_token(values: list[int]) -> str:
    return "-".join(str(int(v)) for v in values)


#: Variables with a unit: their names (upper case, blanks and dashes as underscores), the name shown instead if any, and
#: the unit (fixed values).
UNITS = [
    (("TMI", "MAG"), None, "nT"),
    (("RADIOMETRIC_U", "RAD_U", "RAD_EU", "EU", "U"), "eU", "ppm"),
]


def label_with_unit(name: Column, units=UNITS) -> Column:
    """Display label of a variable: its name, or the one shown instead, with its unit in brackets; others stay as they are."""
    key, out = F.regexp_replace(F.upper(F.trim(name)), "[ -]", "_"), name
    for names, shown, unit in units:
        out = F.when(key.isin(*names), F.concat(F.lit(shown) if shown else name, F.lit(f" ({unit})"))).otherwise(out)
    return out


def component_index(v: Column) -> Column:
    """Zero-based index of a component name such as PC3; plain numbers are indices already. Others are null."""
    digits = F.regexp_extract(v, r"(?i)^\s*pc\s*([0-9]+)\s*$", 1)
    plain = F.regexp_extract(v, r"^\s*([0-9]+)\s*$", 1)
    return F.when(digits != "", digits.cast("int") - 1).when(plain != "", plain.cast("int"))


def parse_case(path: Column) -> Column:
    """Struct of a run folder's name: dep=3/method=concat_alpha/k=2-8/alpha=0p503 in any order; missing parts are null."""
    part = lambda key, pattern: F.nullif(F.regexp_extract(path, rf"(?:^|/){key}=({pattern})(?:/|$)", 1), F.lit(""))
    alpha = F.regexp_replace(F.regexp_replace(part("alpha", "[^/]+"), "m", "-"), "p", ".")
    return F.struct(part("dep", "[0-9]+").cast("int").alias("dep_id"), part("method", "[^/]+").alias("method"), F.transform(F.split(part("k", "[0-9-]+"), "-"), lambda k: k.cast("int")).alias("ks"), alpha.try_cast("double").alias("alpha"))


def safe_number(v: Column) -> Column:
    """A number from text; null where it isn't one."""
    return F.trim(v).try_cast("double")
