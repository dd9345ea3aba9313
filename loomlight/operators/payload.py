"""Rows for one payload of bounded size: attributes are cut only if the whole doesn't fit, and never silently."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters of a payload, and of an attribute once it must be cut.
BUDGET, CAP = 360_000, 1_200


class PayloadTooLarge(ValueError):
    """The payload doesn't fit even with all attributes cut."""


def rendered(rows: DataFrame) -> int:
    """Characters of all rows as a JSON array."""
    n, chars = rows.agg(F.count("*"), F.coalesce(F.sum(F.length(F.to_json(F.struct(*rows.columns)))), F.lit(0))).first()
    return chars + max(n - 1, 0) + 2


def capped_attribute(value: Column, cap: int) -> Column:
    """An attribute (variant) whose JSON is longer than the cap: the head of a text, with how much was cut, or a note in place of anything else."""
    json = F.to_json(value)
    text = F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))
    note = F.concat(F.lit("[omitted non-string attribute: "), F.length(json).cast("string"), F.lit(" JSON chars]"))
    cut = F.concat(F.substring(text, 1, cap), F.lit("…[truncated "), (F.length(text) - cap).cast("string"), F.lit(" chars]"))
    return F.when(F.length(json) <= cap, value).otherwise(F.coalesce(cut, note).cast("variant"))


def budgeted(rows: DataFrame, attributes: str = "attributes", budget: int = BUDGET, cap: int = CAP) -> tuple[DataFrame, dict]:
    """The rows, and how they are delivered: cap (null if nothing was cut) and chars.

    attributes: map of variants. The size of all rows is summed first; only if it exceeds the
    budget is every attribute held to the cap, and if that is still too much it is an error.
    """
    chars = rendered(rows)
    if chars <= budget:
        return rows, {"cap": None, "chars": chars}
    cut = rows.withColumn(attributes, F.transform_values(attributes, lambda _, v: capped_attribute(v, cap)))
    chars = rendered(cut)
    if chars > budget:
        raise PayloadTooLarge(f"{chars} characters even with attributes of {cap}; the budget is {budget}")
    return cut, {"cap": cap, "chars": chars}
