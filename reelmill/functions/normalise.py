"""Free spellings in records to the fixed values of presence, identity and execution status."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings by the value they stand for, and the statuses that are errors.
PRESENCE = {
    "present": ("present", "visible", "found", "exist", "exists"),
    "absent": ("absent", "not_present", "invisible", "not_found"),
    "uncertain": ("uncertain", "unknown", "unsure"),
}
IDENTITY = {
    "same": ("same", "match", "matched", "positive"),
    "different": ("different", "not_same", "mismatch", "negative"),
    "uncertain": ("uncertain", "unknown"),
    "not_applicable": ("not_applicable", "n/a", "na", "none"),
}
ERRORS = ("api_error", "image_error", "model_error", "parse_error", "runtime_error", "internal_error", "exception", "error", "failed")


def _word(x: Column) -> Column:
    return F.translate(F.lower(F.trim(x)), " -", "__")


def _one_of(word: Column, spellings: dict[str, tuple[str, ...]]) -> Column:
    found = F.lit(None).cast("string")
    for value, words in reversed(spellings.items()):
        found = F.when(word.isin(*words), F.lit(value)).otherwise(found)
    return found


def presence(x: Column) -> Column:
    """present, absent or uncertain; null for what is none of their spellings."""
    return _one_of(_word(x), PRESENCE)


def identity(x: Column) -> Column:
    """same, different, uncertain or not_applicable; null for other words."""
    return _one_of(_word(x), IDENTITY)


def flag(x: Column, yes: str, no: str) -> Column:
    """What a boolean stands for."""
    return F.when(x, F.lit(yes)).when(~x, F.lit(no))


def execution_status(candidates: list[Column], skipped: Column, error_type: Column) -> Column:
    """The first status given; else skipped, else internal_error where an error has a type, else ok."""
    given = F.coalesce(*[F.nullif(_word(c), F.lit("")) for c in candidates]) if candidates else F.lit(None).cast("string")
    return F.coalesce(given, F.when(F.coalesce(skipped, F.lit(False)), "skipped").when(error_type.isNotNull(), "internal_error").otherwise("ok"))


def is_error(status: Column) -> Column:
    """Whether an execution status stands for an error."""
    return F.coalesce(status.isin(*ERRORS) | status.endswith("_error"), F.lit(False))
