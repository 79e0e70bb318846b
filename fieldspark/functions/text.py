"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented Spanish letters and the plain letters they are replaced by.
ACCENTED = "áéíóúüñÁÉÍÓÚÜÑ"
PLAIN = "aeiouunAEIOUUN"


def joined(*parts: Column | str) -> Column:
    """Parts run together, nulls left out. Strings are literals."""
    return F.concat_ws("", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def block_key(desarrollo: Column, blocknumber: Column) -> Column:
    """Key of a block within a crop cycle."""
    return joined(desarrollo, blocknumber)


def link(label: Column, *target: Column | str) -> Column:
    """`[label](target)`; a null label or target part is left out."""
    return joined("[", label, "](", *target, ")")


def underscored(text: Column) -> Column:
    return F.replace(text, F.lit(" "), F.lit("_"))


def spaced(text: Column) -> Column:
    """Inverse of `underscored`, except that underscores of the original also become spaces."""
    return F.replace(text, F.lit("_"), F.lit(" "))


def plain_text(text: Column) -> Column:
    """Text with every `[label](target)` reduced to its label; the target may hold parentheses in
    pairs."""
    return F.regexp_replace(text, r"\[([^\]]*)\]\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)", "$1")


def fold_accents(text: Column) -> Column:
    return F.translate(text, ACCENTED, PLAIN)


def lot_of_block(bloque: Column) -> Column:
    """Lot digits of a block key: its third and fourth characters."""
    return F.substring(bloque, 3, 2)


def labelled(label: Column, text: Column) -> Column:
    """`label:text`, null when either is null."""
    return F.concat(label, F.lit(":"), text)
