"""Column functions for labels and numbers as reports write them; all stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented letters and what they fold to.
ACCENTED = "áàâãäéèêëíìîïóòôõöúùûüçñ"
PLAIN = "aaaaaeeeeiiiiooooouuuucn"


def fold_label(c: Column) -> Column:
    """Lower case without accents, blanks squashed; null stays null."""
    return F.trim(F.regexp_replace(F.translate(F.lower(c), ACCENTED, PLAIN), r"[\s\u00a0]+", " "))


def parse_locale_number(c: Column) -> Column:
    """With both marks the point groups thousands; a comma alone is decimal. Empty text, ``-`` and words give null."""
    text = F.trim(c)
    return (
        F.when(text.contains(",") & text.contains("."), F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(text.contains(","), F.replace(text, F.lit(","), F.lit(".")))
        .otherwise(text)
        .try_cast("double")
    )


def parse_simple_number(c: Column) -> Column:
    """A comma becomes a point and nothing else, so ``1.234,5`` gives null."""
    return F.replace(F.trim(c), F.lit(","), F.lit(".")).try_cast("double")


def safe_float(c: Column, default: float = 0.0) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(default))


def unit_price(cost: Column, quantity: Column) -> Column:
    """Null where the quantity is null, zero or negative."""
    return F.when(quantity > 0, cost / quantity)
