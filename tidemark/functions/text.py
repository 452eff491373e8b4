"""Word sets, masking and content rules as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word characters are letters, numbers and underscore of any script.
WORD_PATTERN = r"([\p{L}\p{N}_]+)"

# Masking patterns, applied in this order.
EMAIL_PATTERN = r"\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
CARD_PATTERN = r"\b\d{10,16}\b"
PHONE_PATTERN = r"\b\d{3}[-.\s]?\d{3}[-.\s]?\d{4}\b"

# Content rules.
FORBIDDEN_PHRASES = ("unlimited free trial", "100% money-back guarantee")
GROUNDED_TERMS = ("discount", "offer", "product", "cart")
PERCENT_PATTERN = r"([0-9]+)\s*%|%\s*([0-9]+)"


def word_set(text: Column) -> Column:
    """Distinct lower-case words of the whole text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), F.lit(1)))


def mask_pii(text: Column) -> Column:
    """Replace e-mail addresses, long digit runs and phone numbers.

    ``(?U)`` makes word boundaries and digits cover every script.
    """
    masked = F.regexp_replace(text, "(?iU)" + EMAIL_PATTERN, "[EMAIL]")
    masked = F.regexp_replace(masked, "(?U)" + CARD_PATTERN, "[CARD]")
    return F.regexp_replace(masked, "(?U)" + PHONE_PATTERN, "[PHONE]")


def percentages(text: Column) -> Column:
    """Every number written as ``60%`` or ``%60``, as doubles."""
    before = F.regexp_extract_all(text, F.lit(PERCENT_PATTERN), F.lit(1))
    after = F.regexp_extract_all(text, F.lit(PERCENT_PATTERN), F.lit(2))
    return F.transform(
        F.zip_with(before, after, lambda a, b: F.when(F.length(a) > 0, a).otherwise(b)),
        lambda s: s.cast("double"),
    )


def contains_any(text: Column, terms: Sequence[str]) -> Column:
    lowered = F.lower(text)
    found = F.lit(False)
    for term in terms:
        found = found | F.contains(lowered, F.lit(term.lower()))
    return found


def whole_number(value: Column) -> Column:
    """Rounded to no decimals, half to even, without grouping."""
    return F.call_function("format_number", value, F.lit("0"))
