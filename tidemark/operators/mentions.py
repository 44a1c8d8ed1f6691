"""Which entities a text mentions, by an ordered dictionary of aliases.

An alias is found as a substring, as whole words, or (`requires_context`) as a substring of a text that also has some
indicator: any alias of weight 0.85 or more that needs no context itself, as a substring. Of an entity's aliases the
first in the dictionary's order that is found counts, whatever its weight.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

#: Fixed values.
INDICATOR_WEIGHT = 0.85
MODES = ("substring", "word_boundary", "requires_context")


@dataclass(frozen=True)
class Alias:
    string: str
    mode: str = "substring"
    weight: float = 1.0

    def __post_init__(self):
        if self.mode not in MODES or not 0 <= self.weight <= 1 or not self.string:
            raise ValueError(f"not an alias: {self}")


@dataclass(frozen=True)
class Entity:
    id: str
    aliases: tuple[Alias, ...]
    display_name: str = ""
    role: str = ""
    affiliation: str = ""
    status: str = ""
    notes: str | None = None


def indicators(entities: Sequence[Entity]) -> list[str]:
    return sorted({a.string.lower() for e in entities for a in e.aliases if a.weight >= INDICATOR_WEIGHT and a.mode != "requires_context"})


#: A letter, number or underscore; Java's own word boundary would also count combining marks.
_WORD = r"[\p{L}\p{N}_]"


def _edge(char: str, side: str) -> str:
    """A word boundary beside a character of the needle."""
    return f"(?{side}!{_WORD})" if char.isalnum() or char == "_" else f"(?{side}={_WORD})"


def _found(lowered: Column, gate: Column, alias: Alias) -> Column:
    needle = alias.string.lower()
    if alias.mode == "word_boundary":
        # a search for the substring first spares most texts the pattern
        return lowered.contains(needle) & lowered.rlike(_edge(needle[0], "<") + r"\Q" + needle.replace(r"\E", r"\E\\E\Q") + r"\E" + _edge(needle[-1], ""))
    return lowered.contains(needle) & gate if alias.mode == "requires_context" else lowered.contains(needle)


def mentions_of(text: Column, entities: Sequence[Entity]) -> Column:
    """array<struct<character_id, alias_matched, weight>> in the dictionary's order; built-in expressions only."""

    def bound(lowered: Column) -> Column:
        gate = F.exists(F.array(*[F.lit(i) for i in indicators(entities)]).cast("array<string>"), lambda i: lowered.contains(i))

        def of(entity: Entity, gate: Column) -> Column:
            cases = [F.when(_found(lowered, gate, a), F.struct(F.lit(entity.id).alias("character_id"), F.lit(a.string).alias("alias_matched"), F.lit(float(a.weight)).alias("weight"))) for a in entity.aliases]
            return F.coalesce(*cases)

        def all_of(gate: Column) -> Column:
            return F.filter(F.array(*[of(e, gate) for e in entities if e.aliases]), lambda m: m.isNotNull())

        return F.get(F.transform(F.array(gate), all_of), F.lit(0))

    kind = "array<struct<character_id: string, alias_matched: string, weight: double>>"
    if not any(e.aliases for e in entities):
        return F.array().cast(kind)
    return F.get(F.transform(F.array(F.lower(F.coalesce(text, F.lit("")))), bound), F.lit(0)).cast(kind)


def with_mentions(df: DataFrame, text: Column, entities: Sequence[Entity]) -> DataFrame:
    """A row for each mention, with character_id, alias_matched and mention_weight."""
    return df.withColumn("__m", F.explode(mentions_of(text, entities))).select(*df.columns, "__m.character_id", "__m.alias_matched", F.col("__m.weight").alias("mention_weight"))


def reference_mentions(text: str, entities: Sequence[Entity]) -> list[tuple[str, str, float]]:
    """The rules in plain Python, for tests."""
    low = text.lower()
    gate, out = any(i in low for i in indicators(entities)), []
    for e in entities:
        for a in e.aliases:
            n = a.string.lower()
            if (re.search(rf"\b{re.escape(n)}\b", low) is not None) if a.mode == "word_boundary" else n in low and (a.mode == "substring" or gate):
                out.append((e.id, a.string, a.weight))
                break
    return out
