"""Times as reports write them: ISO 8601 in UTC."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

_ISO = r"^\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])T(?:[01]\d|2[0-3]):[0-5]\d(?::[0-5]\d(?:\.\d+)?)?Z$"


def iso_now() -> str:
    return datetime.now(UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")


def is_iso(text: Column) -> Column:
    """Whether the text is a time of that form on a day that exists."""
    return text.rlike(_ISO) & F.try_to_timestamp(text.substr(1, 10), F.lit("yyyy-MM-dd")).isNotNull()
