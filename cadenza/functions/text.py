"""Text expressions: normalisation, keyword families, privacy patterns, array fields in text lines."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "<missing>"

# Keyword families in order of precedence, each with the substrings that name it.
FAMILIES = {
    "indoor_virtual_cycling": [
        "virtualride", "trainer", "kickr", "zwift", "rolle", "rullo", "rodillo", "tacx", "bkool", "indoor", "turbo",
        "spinning", "ftp"],
    "swimming": ["swim", "natacion", "nataci", "plavan", "pool"],
    "skiing": ["ski", "sci fondo", "nordic", "langlauf", "randonee"],
    "walking_hiking": ["walk", "hike", "hiking", "caminata", "caminar", "mountaineer", "snowshoe"],
    "running": ["run", "running", "carrera", "corsa", "corsetta", "trail run", "jog", "orienteer"],
    "strength_cross_training": [
        "weight", "strength", "kraft", "fuerza", "gym", "yoga", "cross train", "elliptical", "stairstepper",
        "core stability", "circuit training", "aerobic", "pilates", "stair clim"],
    "outdoor_cycling": [
        "bike", "cycling", "cycli", "ride", "ciclismo", "ciclista", "giro", "pedal", "rennrad", "mtb", "enduro",
        "commute", "biker", "bicycle", "cycle"],
}
#: Whole labels that name a family only after all keywords failed.
WHOLE_LABELS = {"road": "outdoor_cycling", "tt": "outdoor_cycling"}
OTHER = "other_unknown"

#: Paths that give away a person or machine (fixed values).
PRIVATE_PATHS = [
    ("windows_path", r"(?<![A-Za-z0-9_])[A-Za-z]:[\\/]"),
    ("unc_path", r"(?<![\\])\\\\[A-Za-z0-9_.\-$]+[\\/]"),
    ("posix_home", r"(?<![A-Za-z0-9_])/(?:home|Users|mnt)/[A-Za-z0-9_.\-]+/"),
    ("file_uri", r"(?i)\bfile://"),
]
#: Column names, once normalised, that must not be published, and endings that betray one (fixed values).
PRIVATE_NAMES = [
    "activity_id", "athlete_id", "byte_offset", "csv_local_datetime", "csv_relative_path", "end_timestamp", "file_path", "gender",
    "latitude", "longitude", "metadata_ride_index", "metadata_utc_datetime", "origin_time", "record_index", "session_id", "session_key",
    "source_key", "source_path", "start_timestamp", "timestamp", "user_id", "user_index",
]
PRIVATE_ENDINGS = ["_activity_id", "_athlete_id", "_session_id", "_user_id"]


def _decomposed(x: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)).lower()


def plain_text(x: Column) -> Column:
    """Compatibility decomposition without combining marks, in lower case; null stays null.

    Spark has no Unicode normalisation, so this is a vectorised UDF that only works on values beyond ASCII."""

    @F.pandas_udf("string")
    def plain(values: pd.Series) -> pd.Series:
        return values.map(lambda v: v if v is None else v.lower() if v.isascii() else _decomposed(v))

    return plain(x)


def keyword_family(label: Column) -> Column:
    """First family with a keyword in the label; null, blank, missing and unknown labels are OTHER."""
    text = plain_text(label)
    rule = F.when(label.isNull() | (label == MISSING) | (F.trim(text) == ""), F.lit(OTHER))
    for family, keywords in FAMILIES.items():
        rule = rule.when(text.rlike("|".join(keywords)), F.lit(family))
    for whole, family in WHOLE_LABELS.items():
        rule = rule.when(F.trim(text) == whole, F.lit(family))
    return rule.otherwise(F.lit(OTHER))


def field_name(x: Column) -> Column:
    """Lower case without a byte order mark, runs of anything but letters and digits as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def private_paths(x: Column) -> Column:
    """Names of the privacy patterns that the text matches, in order."""
    return F.array_compact(F.array(*[F.when(x.rlike(p), F.lit(n)) for n, p in PRIVATE_PATHS]))


def array_field(line: Column, name: str) -> Column:
    """Body of `'name': [ ... ]` in a line; empty if there is none."""
    return F.regexp_extract(line, rf"'{name}': \[([^\]]*)\]", 1)


def numbers(body: Column) -> Column:
    """The numbers in a comma-separated body; blanks, None, nan and what can't be cast are left out."""
    cells = F.transform(F.split(body, ","), lambda x: F.trim(x))
    cells = F.filter(cells, lambda x: ~F.lower(x).isin("", "none", "nan"))
    return F.filter(F.transform(cells, lambda x: x.try_cast("double")), lambda x: x.isNotNull())


def scalar_field(line: Column, name: str) -> Column:
    """Value of `'name': value` or `'name': 'value'`; MISSING if there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(line, rf"'{name}': '?([^',}}\]]+)'?", 1), F.lit("")), F.lit(MISSING))


def true_text(x: Column) -> Column:
    """true/1/yes and false/0/no in any case as booleans; anything else is null."""
    t = F.lower(F.trim(x.cast("string")))
    return F.when(t.isin("true", "1", "yes"), True).when(t.isin("false", "0", "no"), False)
