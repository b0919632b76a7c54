"""Key normalisation and tolerant column lookup."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from swelter.functions.dates import strip

# Header spellings accepted in a ZIP centroid file.
ZIP_NAMES = ("zip", "zipcode", "zip_code", "zip5", "zcta", "zcta5", "postal code", "postalcode")
LAT_NAMES = ("lat", "latitude")
LON_NAMES = ("lon", "lng", "long", "longitude")


def normalize_zip(value: Column, width: int = 5) -> Column:
    """Trim, drop a trailing ``.0`` and zero-fill; longer codes are left as they are."""
    z = F.regexp_replace(strip(value.cast("string")), r"\.0$", "")
    signed = F.substring(z, 1, 1).isin("+", "-")
    filled = F.when(
        signed, F.concat(F.substring(z, 1, 1), F.lpad(F.substring(z, 2, width), width - 1, "0"))
    ).otherwise(F.lpad(z, width, "0"))
    return F.when(F.length(z) < width, filled).otherwise(z)


def find_column(columns: Sequence[str], candidates: Iterable[str]) -> str | None:
    """First candidate that names a column, ignoring case, then ignoring punctuation too."""

    def squash(name: str) -> str:
        return re.sub(r"[^a-z0-9]", "", name.lower())

    for wanted in candidates:
        for key in (lambda s: s.strip().lower(), squash):
            hits = [c for c in columns if key(c) == key(wanted)]
            if hits:
                return hits[-1]
    return None
