"""String functions of the panels, exporters and importers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellumetry.operators.model import MEDIA_TYPES


#: White space of any kind, the separators of ASCII too.
SPACES = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\p{Z}]+"


def basename(path: Column) -> Column:
    """What follows the last slash or backslash; null stays null."""
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def suffix(path: Column) -> Column:
    """File name ending in lower case, empty if there is none."""
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def media_type(path: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in MEDIA_TYPES.items() for x in kv))
    return F.when(path.isNotNull(), F.coalesce(F.element_at(known, suffix(path)), F.lit(next(iter(MEDIA_TYPES.values())))))


def accepted(path: Column) -> Column:
    return F.coalesce(suffix(path).isin(*MEDIA_TYPES), F.lit(False))


def data_url(content: Column, path: Column) -> Column:
    """A file's bytes as a data URL."""
    return F.concat(F.lit("data:"), media_type(path), F.lit(";base64,"), F.base64(content))


def safe_name(name: Column) -> Column:
    """White space to _, then only letters, digits, _ and - of ASCII."""
    return F.regexp_replace(F.regexp_replace(name, r"\s+", "_"), "[^a-zA-Z0-9_-]", "")


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def percent(share: Column) -> Column:
    """Whole percent, halves upward."""
    return F.floor(share * 100 + 0.5).cast("bigint")


def word_count(text: Column) -> Column:
    """Words between white space of any kind; 0 for null and blank texts."""
    return F.coalesce(F.size(F.filter(F.split(text, SPACES), lambda w: w != "")), F.lit(0)).cast("bigint")


def percent_box(x: Column, y: Column, w: Column, h: Column) -> Column:
    """A box in whole percent, as the list of regions shows it."""
    part = lambda share: F.concat(percent(share).cast("string"), F.lit("%"))
    return F.concat(part(x), F.lit(","), part(y), F.lit(" "), part(w), F.lit("×"), part(h))


def confidence_band(share: Column, high: float = 0.8, middle: float = 0.6) -> Column:
    return F.when(share > high, "high").when(share > middle, "mid").otherwise("low")
