"""Names of files, slides and channels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions that name a slide or an image; two-part ones come first.
SLIDE_EXTENSIONS = ("ome.tiff", "ome.tif", "tiff", "tif", "svs", "ndpi", "czi", "png", "jpg")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def slide_name(path: Column) -> Column:
    """A file's name without the extension of a slide."""
    ends = "|".join(e.replace(".", r"\.") for e in SLIDE_EXTENSIONS)
    return F.regexp_replace(base_name(path), rf"(?i)\.({ends})$", "")


def natural_key(name: Column) -> Column:
    """A string that sorts names with their runs of digits in the order of the numbers, however long: a run goes
    without leading zeros, behind its length."""
    parts = F.regexp_extract_all(name, F.lit(r"([0-9]+|[^0-9]+)"), 1)
    bare = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    number = lambda p: F.concat(F.lpad(F.length(bare(p)).cast("string"), 6, "0"), bare(p))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), number(p)).otherwise(p)), "")


def padded(names: list[str], side: str = "right") -> list[str]:
    """Names filled up with blanks to the length of the longest."""
    most = max(map(len, names), default=0)
    return [n.ljust(most) if side == "right" else n.rjust(most) for n in names]


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance; 0 from an empty first name."""
    return F.when(F.length(a) == 0, 0).otherwise(F.levenshtein(a, b))


def elapsed(seconds: Column) -> Column:
    """struct(value, unit): seconds, minutes from 60 s, hours from 3600 s, to three places."""
    value = F.when(seconds < 60, seconds).when(seconds < 3600, seconds / 60).otherwise(seconds / 3600)
    unit = F.when(seconds < 60, "seconds").when(seconds < 3600, "minutes").otherwise("hours")
    return F.struct(F.round(value, 3).alias("value"), unit.alias("unit"))


def hex_to_rgb(text: Column) -> Column:
    """struct(r, g, b) of #rrggbb."""
    part = lambda k: F.conv(F.substring(text, k, 2), 16, 10).cast("int")
    return F.struct(part(2).alias("r"), part(4).alias("g"), part(6).alias("b"))


def distinct_names(name: Column, nth: Column, total: Column) -> Column:
    """Equal names told apart by a zero-padded number; a name that occurs once stays."""
    return F.when(total > 1, F.concat(name, F.lit("_"), F.lpad((nth - 1).cast("string"), F.length(total.cast("string")), F.lit("0")))).otherwise(name)
