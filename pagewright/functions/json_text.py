"""Strict JSON out of model replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .semantics import browser_trim

# Where the text of a chat reply sits, by provider family.
ENVELOPE_PATHS = {
    "gemini": "$.candidates[0].content.parts[0].text",
    "openai": "$.choices[0].message.content",
    "custom": "$.choices[0].message.content",
    "deepseek": "$.choices[0].message.content",
}
FENCE = "```"
# First and last character of the JSON value kinds.
JSON_ENDS = r"""(?s)^[ \t\n\r]*(\{.*\}|\[.*\]|".*"|[-0-9tfn].*)[ \t\n\r]*\z"""


def strict_json(text: Column) -> Column:
    """The text as a variant, or null if it is not exactly one JSON value.

    The parser tolerates junk after a value, so the text must also hold up as
    the only element of a list and as the value of a field. A look at both ends
    comes first, since a failed parse is far more costly than a regular one.
    """
    as_element = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    as_field = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.when(text.rlike(JSON_ENDS) & as_element.isNotNull(), F.try_variant_get(as_field, "$.v", "variant"))


def without_fence(text: Column) -> Column:
    """Drop a leading code fence (with or without a json tag) and the closing one."""
    for opening in (FENCE + "json", FENCE):
        body = F.substring(text, F.lit(len(opening) + 1), F.length(text))
        stripped = browser_trim(F.regexp_replace(body, FENCE + r"\z", ""))
        if opening == FENCE:
            return F.when(text.startswith(FENCE + "json"), tagged).when(text.startswith(opening), stripped).otherwise(text)
        tagged = stripped


def with_json(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the JSON inside `text` as a variant, null when nothing parses.

    First of: the text, the unfenced text, first { to last }, first [ to last ].
    The bracket step only runs where a brace span exists and is no JSON. The
    spans are columns of their own, so each is computed once per row.
    """
    spans = (df.withColumn("_text", browser_trim(F.col(text)))
             .withColumn("_plain", without_fence(F.col("_text")))
             .withColumn("_braces", F.regexp_extract("_plain", r"(?s)(\{.*\})", 1)))
    braces = F.col("_braces")
    brackets = F.regexp_extract("_plain", r"(?s)(\[.*\])", 1)
    value = F.coalesce(
        strict_json(F.col("_text")), F.when(F.col("_plain") != F.col("_text"), strict_json(F.col("_plain"))),
        F.when(braces != "", strict_json(braces)), F.when(braces != "", strict_json(brackets)))
    return spans.withColumn(out, value).drop("_text", "_plain", "_braces")


def envelope_text(envelope: Column, provider: str) -> Column:
    """Reply text of a chat answer; null or empty means an empty response."""
    return F.get_json_object(envelope, ENVELOPE_PATHS[provider])


def array_of(value: Column, key: str) -> Column:
    """Field `key` as an array of variants; null if it is missing or no array."""
    return F.try_variant_get(value, f"$.{key}", "array<variant>")


def field_text(item: Column, key: str) -> Column:
    return F.try_variant_get(item, f"$.{key}", "string")


def field_number(item: Column, key: str) -> Column:
    """A number, or a text that reads as one."""
    return field_text(item, key).try_cast("double")
