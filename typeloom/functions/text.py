"""Text expressions over file names, labels and checkpoint keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY_PREFIXES = ("model.", "module.", "net.", "_orig_mod.")


def safe_label(label: Column) -> Column:
    """Everything but ASCII letters, digits, ``_`` and ``-`` becomes ``_``, runs as one; at most 64 characters."""
    return F.substring(F.regexp_replace(label, "[^A-Za-z0-9_-]+", "_"), 1, 64)


def stem(path: Column) -> Column:
    """The file name without folders and extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"\.[^.]*$", "")


def stem_label(name: Column) -> Column:
    """What stands before the last ``_``; the whole stem if there is none."""
    return F.regexp_extract(name, r"^(.*?)(?:_[^_]*)?$", 1)


def stem_id(name: Column) -> Column:
    """The number after the last ``_``; null if that is no number."""
    return F.regexp_extract(name, r"_(\d+)$", 1).try_cast("bigint")


def strip_key_prefixes(key: Column, prefixes: tuple[str, ...] = KEY_PREFIXES) -> Column:
    """Each prefix is taken off at most once, in the order given."""
    for prefix in prefixes:
        key = F.when(key.startswith(prefix), F.substring(key, len(prefix) + 1, 1 << 30)).otherwise(key)
    return key


def blank(text: Column) -> Column:
    return text.isNull() | (F.trim(text) == "")


def match_status(truth: Column, top: Column, ranked: Column) -> Column:
    """``exact`` if the first label is the truth, ``contained`` if a later one is, else ``miss``; null without a truth."""
    return F.when(truth.isNull(), F.lit(None)).when(truth == top, "exact").when(F.array_contains(ranked, truth), "contained").otherwise("miss")


def confidence_flags(p1: Column, p2: Column, ok: float = 0.55, low: float = 0.30, margin: float = 0.05) -> Column:
    """Flags of a prediction from its two largest probabilities."""
    level = F.when(p1 >= ok, "OK").when(p1 >= low, "LOW_CONF")
    return F.array_compact(F.array(F.when(p1 >= low, level).otherwise("LOW_CONF"), F.when(p1 < low, "VERY_LOW"), F.when(p1 - p2 < margin, "AMBIGUOUS")))
