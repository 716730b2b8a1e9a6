"""Instructions to queries: keywords, entities, expansion.

Stands in for a tagger and entity recogniser that aren't available offline, and says so: words outside a stop list are keywords, as
they are written; runs of capitalised words are entities of type name. Results are sorted. Any function of the same shape can replace either.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

STOP = tuple(
    "a an and are as at be but by for from has have how i in into is it its of on or our so such that the their them then there these they this to was we were what when where which who will with you your about all any can do does find get give me more my no not please show some than want".split()
)
EXPANSIONS = {
    "react": tuple("react jsx component hook props state".split()),
    "web_dev": tuple("html css javascript frontend backend api".split()),
    "sql": tuple("database query table select insert update".split()),
}


@dataclass(frozen=True)
class Query:
    keywords: list[str]
    entities: dict[str, list[str]] = field(default_factory=dict)
    instructions_summary: str = ""


def keywords(text: Column) -> Column:
    """Different words of at least three signs outside the stop list, lower case, sorted."""
    parts = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.array_sort(F.array_distinct(F.filter(parts, lambda w: (F.length(w) >= 3) & ~w.isin(*STOP))))


def entities(text: Column) -> Column:
    """Map of name to the runs of capitalised words that follow another word, lower case, sorted; empty if there are none."""
    found = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?<=[\p{L}\p{N},] )(\p{Lu}[\p{L}\p{N}]+(?: \p{Lu}[\p{L}\p{N}]+)*)"), F.lit(1)), F.lower)))
    return F.when(F.size(found) > 0, F.create_map(F.lit("name"), found)).otherwise(F.create_map().cast("map<string,array<string>>"))


def expanded(text: Column, given: Column) -> Column:
    """Keywords with the terms of every category that the text names, or of which it holds a term; sorted."""
    low, out = F.lower(text), given
    for name, terms in EXPANSIONS.items():
        hit = F.contains(low, F.lit(name))
        for t in terms:
            hit = hit | F.contains(low, F.lit(t))
        out = F.concat(out, F.when(hit, F.array(*map(F.lit, terms))).otherwise(F.array().cast("array<string>")))
    return F.array_sort(F.array_distinct(out))


def query(instructions: str) -> Query:
    """The same for one instruction, on the driver."""
    found = sorted({w for w in re.split(r"[\W_]+", instructions.lower()) if len(w) >= 3 and w not in STOP})
    names = sorted({m.lower() for m in re.findall(r"(?<=[\w,] )([A-Z]\w+(?: [A-Z]\w+)*)", instructions)})
    return Query(found, {"name": names} if names else {}, instructions)


def expanded_keywords(q: Query) -> list[str]:
    low = q.instructions_summary.lower()
    more = [t for name, terms in EXPANSIONS.items() if any(x in low for x in (name, *terms)) for t in terms]
    return sorted({*q.keywords, *more})
