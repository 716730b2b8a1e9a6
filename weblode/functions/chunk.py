"""Sentences and word-bounded chunks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weblode.functions.text import W, groups_of_words, word_count

#: After a stop before a capital, after ; or } before a word, after a line end before a capital. Nothing but white space is lost.
#: The sign before is looked at once, ahead of the alternatives, as at most places there is none.
BOUNDS = rf"(?<=[;}}!.?\n])(?:(?<=;)\s+(?=[{W}])|(?<=\}})\s*(?=[{W}])|(?<=[!.?])\s+(?=[A-Z])|(?<=[\n])\s*(?=[A-Z]))"


def sentences(text: Column) -> Column:
    parts = F.transform(F.split(text, BOUNDS), lambda s: F.btrim(s, F.lit(" \t\n\x0b\f\r")))
    return F.filter(parts, lambda s: s != "")


def semantic_chunks(text: Column, budget: int = 1000) -> Column:
    """Sentences packed in order into chunks of at most budget words; a longer sentence ends the chunk before it and is cut into groups of words."""
    empty = F.array().cast("array<string>")
    state = F.struct(empty.alias("done"), empty.alias("held"), F.lit(0).alias("size"))
    flushed = lambda s: F.when(F.size(s["held"]) > 0, F.concat(s["done"], F.array(F.array_join(s["held"], " ")))).otherwise(s["done"])

    def step(s: Column, counted: Column) -> Column:
        sentence, n = counted["s"], counted["n"]
        cut = F.struct(F.concat(flushed(s), groups_of_words(sentence, budget)).alias("done"), empty.alias("held"), F.lit(0).alias("size"))
        fresh = F.struct(flushed(s).alias("done"), F.array(sentence).alias("held"), n.alias("size"))
        more = F.struct(s["done"].alias("done"), F.concat(s["held"], F.array(sentence)).alias("held"), (s["size"] + n).alias("size"))
        return F.when(n > budget, cut).when(s["size"] + n > budget, fresh).otherwise(more)

    counted = F.transform(sentences(text), lambda s: F.struct(s.alias("s"), word_count(s).alias("n")))
    return F.aggregate(counted, state, step, flushed)
