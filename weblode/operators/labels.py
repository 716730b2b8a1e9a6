"""Token labels: majority vote and spans."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weblode.functions import score
from weblode.functions.text import char_windows, first_words, let

#: A model of token labels: texts of a batch to a list of (token, label) each. It is called on the executors, batch by batch.
Model = Callable[[list[str]], list[list[tuple[str, str]]]]


def vote(a: Column, b: Column, c: Column) -> Column:
    """The label that two of three give, else the first."""
    return F.when((a == b) | (a == c), a).when(b == c, b).otherwise(a)


def labelled(docs: DataFrame, models: tuple[Model, Model, Model], slice_chars: int = 512, key: str = "doc_id") -> DataFrame:
    """(key, pos, token, label) of docs (key, text): every slice of slice_chars goes to three models, whose labels are put side by side and voted on.

    Tokens are the first model's; a slice has as many as the model with the fewest. Null or empty text: no tokens.
    """
    kind = docs.schema[key].dataType.simpleString()
    cut = docs.select(key, F.posexplode(char_windows(F.col("text"), slice_chars)).alias("slice", "part"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for k, part, *found in zip(f[key], f["slice"], *(m(f["part"].tolist()) for m in models), strict=True):
                out += [(k, part, n, a[0], a[1], b[1], c[1]) for n, (a, b, c) in enumerate(zip(*found, strict=False))]
            yield pd.DataFrame(out, columns=[key, "slice", "n", "token", "a", "b", "c"])

    each = cut.mapInPandas(run, f"`{key}` {kind}, slice int, n int, token string, a string, b string, c string")
    place = F.row_number().over(Window.partitionBy(key).orderBy("slice", "n")) - 1
    return each.select(key, place.alias("pos"), "token", vote(F.col("a"), F.col("b"), F.col("c")).alias("label"))


def spans(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, type, entity) of tokens (key, pos, token, label), or of texts (key, tokens) with these as an array in order.

    B- opens a span, I- goes on with it whatever its type, anything else ends it. A span that lasts to the end of the text is kept.
    """
    return _texts(tokens, key).select(key, F.explode(spans_in(F.col("tokens"))).alias("s")).select(key, "s.*")


def _texts(tokens: DataFrame, key: str) -> DataFrame:
    """(key, tokens): a row a text. Rows of tokens meet in one aggregate, not in a sort for each window."""
    if "tokens" in tokens.columns:
        return tokens
    return tokens.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "token", "label"))).alias("tokens"))


def spans_in(tokens: Column) -> Column:
    """The spans of an array of structs (pos, token, label), as structs (start, type, entity). Tokens without a label belong to no span and end none."""

    def cut(t: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(t)), lambda i: ~F.startswith(t[i - 1]["label"], F.lit("I-")))
        return let(F.concat(starts, F.array(F.size(t) + 1)), lambda at: named(t, at))

    def named(t: Column, at: Column) -> Column:
        pieces = F.transform(F.slice(at, 1, F.size(at) - 1), lambda i, k: F.struct(t[i - 1].alias("head"), F.slice(t, i, at[k + 1] - i).alias("of")))
        opened = F.filter(pieces, lambda p: F.startswith(p["head"]["label"], F.lit("B-")))
        entity = lambda p: F.array_join(F.transform(F.filter(p["of"], lambda x: x["label"].isNotNull()), lambda x: x["token"]), " ")
        return F.transform(opened, lambda p: F.struct(p["head"]["pos"].alias("start"), F.substring(p["head"]["label"], 3, 1 << 20).alias("type"), entity(p).alias("entity")))

    return let(tokens, lambda t: F.when(F.size(t) > 0, cut(t)))


def with_context(sections: DataFrame, labelled: DataFrame) -> DataFrame:
    """Spans of labelled tokens (as in spans) of the sections' first 200 words, with the section's context and a confidence; sections: (doc_id, content, context)."""
    confidence = F.lit(0.5) * (F.lit(2.0) / F.lit(2.0)) + F.lit(0.2) * (score.sub_tokens(first_words(F.col("entity"))).cast("double") / 100.0)
    texts = _texts(labelled, "doc_id").select("doc_id", spans_in(F.col("tokens")).alias("spans"))
    # a text goes through the join as one row; exploding the bare column would have its spans made again for a filter on their number
    found = texts.join(sections.select("doc_id", "context"), "doc_id").select("doc_id", F.explode(F.filter("spans", lambda s: s["start"].isNotNull() | s["start"].isNull())).alias("s"), "context")
    return found.select("doc_id", "s.*", "context").withColumn("confidence", confidence)


def tokens(docs: DataFrame, n: int = 200) -> DataFrame:
    """(doc_id, pos, token) of the first n words."""
    return docs.select("doc_id", F.posexplode(first_tokens(F.col("text"), n)).alias("pos", "token"))


def first_tokens(text: Column, n: int = 200) -> Column:
    return F.slice(F.array_remove(F.split(text, r"\s+", n + 2), ""), 1, n)
