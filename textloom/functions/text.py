"""Text functions as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of word characters, or of other characters that are not white space, by Unicode classes.
WORD_PATTERN = r"(?U)\w+|[^\w\s]+"


def words(text: Column) -> Column:
    """The pieces that a white-space pre-tokenizer gives."""
    return F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))


def word_count(text: Column) -> Column:
    """Their number; null of null, which is unknown and not 0."""
    return F.when(text.isNotNull(), F.size(words(text)))


def has_words(text: Column) -> Column:
    """Whether there is a piece; null of null."""
    return text.rlike(r"(?U)\S")


def fill_template(template: str, text: Column, slot: str = "{text}") -> Column:
    """The template with the text in its slot; the slot must occur."""
    if slot not in template:
        raise ValueError(f"the template has no {slot}")
    before, after = template.split(slot, 1)
    return F.concat(F.lit(before), text, F.lit(after))


def expand_placeholder(text: Column, placeholder: str, times: Column) -> Column:
    """The text with its first placeholder repeated `times` times; as it is for 0 times, and an error if there is none."""
    at = F.locate(placeholder, text)
    out = F.concat(F.substring(text, F.lit(1), at - 1), F.repeat(F.lit(placeholder), times), F.substring(text, at + len(placeholder), F.length(text)))
    return F.when(times < 1, text).when(text.isNull() | (at > 0), out).otherwise(F.raise_error(F.lit(f"expected one {placeholder} at least")).cast("string"))
