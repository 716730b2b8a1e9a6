"""Relevance scores. All are double sums, added in a fixed order, as thresholds sit on exact values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from weblode.functions.text import W, any_of, first_words, holding, let, sub_tokens, with_word_numbers

KEYWORDS = ["data", "license", "state", "the", "tion"]
ENTITIES = {"org": ["mit", "apache"], "product": ["token"]}
TECH = tuple("function class import const react component hook jsx sql query table select".split())
PATH_BOOST = tuple("blog article tutorial guide doc react javascript sql".split())
SEED_PATHS = ("/blog/", "/articles/", "/tutorials/", "/react", "/javascript", "/sql", "/web-development")
CODE_LIKE = (rf"(?U)\b[{W}]+\s*\(\s*\)", "<[^>]+>", rf"\{{\s*[{W}\-]+\s*:", rf"(?i)(select|insert|update|create)\s+[{W}]+")
#: For each of these signs that a match must hold, or words of which it must hold one, in lower case: they are found much faster.
CODE_SIGNS = (("(", ")"), ("<", ">"), ("{", ":"), (("select", "insert", "update", "create"),))


def _hits(text: Column, terms: list[str], each: float) -> Column:
    """each for every term in text, added one after another."""
    out = F.lit(0.0)
    for t in terms:
        out = out + F.when(F.contains(text, F.lit(t.lower())), F.lit(each)).otherwise(F.lit(0.0))
    return out


def _if(condition: Column, value: float) -> Column:
    return F.when(condition, F.lit(value)).otherwise(F.lit(0.0))


def quick(text: Column, keywords: list[str]) -> Column:
    def score(low: Column) -> Column:
        base = _hits(low, keywords, 0.3) + _if(any_of(low, TECH), 0.2)
        return with_word_numbers(text, lambda n, d: base + _if(n > 50, 0.1) + _if(d / (n + 1) > 0.4, 0.1))

    return F.when(text == "", F.lit(0.0)).otherwise(F.least(F.lit(1.0), let(F.lower(text), score)))


def content(text: Column, keywords: list[str]) -> Column:
    def score(low: Column) -> Column:
        out = _hits(low, keywords, 2.0) / float(len(keywords) + 1)
        for pattern, signs in zip(CODE_LIKE, CODE_SIGNS, strict=True):
            out = out + _if(holding(low, signs) & text.rlike(pattern), 0.2)
        return with_word_numbers(text, lambda n, d: out + _if(n > 50, 0.1) + _if(F.coalesce(F.try_divide(d, n.cast("double")), F.lit(0.0)) > 0.4, 0.1))

    return F.when(text == "", F.lit(0.0)).otherwise(F.least(F.lit(1.0), let(F.lower(text), score)))


def semantic(text: Column, keywords: list[str], entities: dict[str, list[str]], counter: Callable[[Column], Column] = sub_tokens) -> Column:
    """Keywords, entities and length in sub-word tokens of the first 200 words; not capped."""
    names = [e for values in entities.values() for e in values]
    by_keyword = lambda low: _hits(low, keywords, 2.0) / float(len(keywords) + 1)
    by_entity = lambda low: _hits(low, names, 1.0) / float(len(names) + 1)
    by_length = F.lit(0.2) * (counter(first_words(text)).cast("double") / 100.0)
    return F.when(text == "", F.lit(0.0)).otherwise(let(F.lower(text), lambda low: F.lit(0.5) * by_keyword(low) + F.lit(0.3) * by_entity(low)) + by_length)


def mentions(text: Column, keywords: list[str], entities: dict[str, list[str]]) -> Column:
    low = F.lower(text)
    score = _hits(low, keywords, 0.3)
    for e in (e for values in entities.values() for e in values):
        score = score + _if(F.contains(low, F.lit(e.lower())), 0.2)
    return F.when(text == "", F.lit(0.0)).otherwise(F.least(F.lit(1.0), score))


def url(address: Column, link_text: Column, context: Column, keywords: list[str]) -> Column:
    path = F.lower(F.coalesce(F.try_parse_url(address, F.lit("PATH")), F.lit("")))
    score = _hits(path, keywords, 0.3)
    for k in keywords:
        score = score + _if(F.contains(F.lower(link_text), F.lit(k)), 0.4) + _if(F.contains(F.lower(context), F.lit(k)), 0.2)
    return F.least(F.lit(1.0), score + _if(any_of(path, PATH_BOOST), 0.2))


def seed_link(href: Column, link_text: Column, context: Column, keywords: list[str]) -> Column:
    return _if(any_of(F.lower(href), SEED_PATHS), 0.3) + _if(any_of(F.lower(link_text), keywords), 0.4) + _if(any_of(F.lower(context), keywords), 0.2)


def ranked_mean(score: Column, rank: Column) -> Column:
    """An aggregate: mean of scores weighted by 1 / rank, at most 1; null for none."""
    return F.least(F.lit(1.0), F.sum(score / rank) / F.sum(F.lit(1.0) / rank))
