"""Column functions over text: words, cleaning, slicing, hashing. \\w of the query language is Unicode: letters, digits, underscore."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Members of a character class that stand for one word character.
W = r"\p{L}\p{N}_"
BOILERPLATE = ("cookie policy", "privacy policy", "terms of service", "accept cookies", "advertisement")


def collapse(text: Column) -> Column:
    """White space runs to one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"\s+"), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once: what a lambda captures is otherwise computed again for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_count(text: Column) -> Column:
    return F.size(words(text))


def has_words(text: Column, n: int) -> Column:
    """Whether there are at least n words; nothing after them is split."""
    return F.size(F.array_remove(F.split(text, r"\s+", n + 2), "")) >= n


def clean_code(text: Column) -> Column:
    """Drop boilerplate phrases (case-sensitive), keep signs that code needs, other signs to a space."""
    out = collapse(text)
    for phrase in BOILERPLATE:
        out = F.replace(out, F.lit(phrase), F.lit(""))
    return collapse(F.regexp_replace(out, rf"""[^{W}\s\-.,!?(){{}}\[\]<>=+*/'":]""", " "))


def clean_plain(text: Column) -> Column:
    """Keep words, white space and plain punctuation; other signs vanish."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\s+", " "), rf"[^{W}\s\-.,?!]", ""))


def diversity(text: Column, smoothed: bool) -> Column:
    """Different words over words, or over words + 1; null for no words if not smoothed."""
    w = words(text)
    different = F.size(F.array_distinct(w)).cast("double")
    return different / (F.size(w) + 1) if smoothed else F.try_divide(different, F.size(w).cast("double"))


def with_word_numbers(text: Column, body: Callable[[Column, Column], Column]) -> Column:
    """body(number of words, number of different words) of text, which is split once; body may use the second once."""
    return let(words(text), lambda w: body(F.size(w), F.size(F.array_distinct(w)).cast("double")))


def first_words(text: Column, n: int = 200) -> Column:
    # what follows the words wanted stays in one piece: an empty first part and the rest are two more
    return F.array_join(F.slice(F.array_remove(F.split(text, r"\s+", n + 2), ""), 1, n), " ")


def _stretches(text: Column, n: int, step: int) -> Column:
    def cut(w: Column) -> Column:
        starts = F.when(F.size(w) > 0, F.sequence(F.lit(0), F.size(w) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(w, i + 1, n), " "))

    return let(words(text), cut)


def groups_of_words(text: Column, n: int) -> Column:
    """Consecutive groups of n words, joined; none for no words."""
    return _stretches(text, n, n)


def context_windows(text: Column, n: int = 50) -> Column:
    """Windows of n words, each starting half a window later; short ones at the end stay."""
    return _stretches(text, n, n // 2)


def char_windows(text: Column, n: int = 512) -> Column:
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(n))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(text, i + 1, F.lit(n)))


def content_id(text: Column) -> Column:
    return F.md5(text)


def any_of(text: Column, terms: list[str] | tuple[str, ...]) -> Column:
    """Whether text contains any of the terms."""
    found = F.lit(False)
    for t in terms:
        found = found | F.contains(text, F.lit(t))
    return found


def holding(text: Column, signs: tuple[str | tuple[str, ...], ...]) -> Column:
    """Whether text contains all the signs, and any of those in a tuple: what a pattern can't match without."""
    found = F.lit(True)
    for s in signs:
        found = found & any_of(text, s if isinstance(s, tuple) else (s,))
    return found


def sub_tokens(text: Column, slice_chars: int = 512) -> Column:
    """Approximate number of sub-word tokens: per slice the runs of letters and digits, each punctuation sign, and two marks, at most slice_chars.

    Stands for a tokenizer that isn't available offline; pass another counter to the scores to replace it.
    """
    count = lambda s: F.least(F.lit(slice_chars), F.regexp_count(s, F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]")) + 2)
    return F.aggregate(F.transform(let(text, lambda t: char_windows(t, slice_chars)), count), F.lit(0), lambda a, n: a + n)
