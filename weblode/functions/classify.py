"""Labels of chunks: kind, technical indicators, keywords found, code language."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weblode.functions.text import W, any_of, holding, let

KINDS = (
    ("code_function", rf"function\s+[{W}]+\s*\(.*\)"),
    ("code_class", rf"class\s+[{W}]+"),
    ("code_import", rf"import\s+[{W}\s,{{}}]+\s+from"),
    ("code_variable", rf"const\s+[{W}]+\s*="),
    ("code_markup", "<[^>]+>"),
    ("code_sql", r"select\s+.*\s+from"),
)
#: What each of these can't match without, in lower case.
KIND_SIGNS = (("function", "(", ")"), ("class",), ("import", "from"), ("const", "="), ("<", ">"), ("select", "from"))
TECHNICAL = tuple("api function method parameter return component props state hook effect query database table column".split())
EXAMPLE = ("example:", "for example", "sample", "tutorial", "step 1", "first,", "here's how")
INDICATORS = {
    "react": tuple("component props state hook jsx".split()),
    "javascript": tuple("function const let var async".split()),
    "sql": tuple("select from where join table".split()),
    "api": tuple("endpoint request response http api".split()),
    "data": tuple("array object string number boolean".split()),
}
LANGUAGES = (
    ("python", rf"def\s+[{W}]+\s*\(|import\s+[{W}]+|from\s+[{W}]+\s+import"),
    ("javascript", rf"function\s+[{W}]+\s*\(|const\s+[{W}]+\s*=|let\s+[{W}]+\s*="),
    ("html", r"</?[a-z][\s\S]*>"),
    ("css", rf"\{{\s*[{W}\-]+\s*:"),
    ("sql", r"select\s+|insert\s+into|create\s+table"),
    ("react", rf"function\s+[{W}]+\s*\(\)\s*\{{\s*return\s*<|class\s+[{W}]+\s+extends\s+react"),
)


def chunk_type(text: Column) -> Column:
    """The first code pattern that matches, else technical_content, example or text."""
    return let(F.lower(text), lambda low: _kind(text, low))


def _kind(text: Column, low: Column) -> Column:
    out = None
    for (name, pattern), signs in zip(KINDS, KIND_SIGNS, strict=True):
        hit = holding(low, signs) & text.rlike("(?i)" + pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.when(any_of(low, TECHNICAL), "technical_content").when(any_of(low, EXAMPLE), "example").otherwise("text")


def indicators(text: Column) -> Column:
    return let(F.lower(text), _indicators)


def _indicators(low: Column) -> Column:
    return F.filter(F.array(*[F.when(any_of(low, terms), F.lit(name)) for name, terms in INDICATORS.items()]), lambda x: x.isNotNull())


def keywords_found(text: Column, keywords: list[str]) -> Column:
    return let(F.lower(text), lambda low: _keywords(low, keywords))


def _keywords(low: Column, keywords: list[str]) -> Column:
    return F.filter(F.array(*[F.when(F.contains(low, F.lit(k.lower())), F.lit(k)) for k in keywords]).cast("array<string>"), lambda x: x.isNotNull())


def labels(text: Column, keywords: list[str]) -> Column:
    """chunk_type, keywords_found and indicators as one struct: of a text put into lower case once."""
    return let(F.lower(text), lambda low: F.struct(_kind(text, low).alias("chunk_type"), _keywords(low, keywords).alias("keywords_found"), _indicators(low).alias("technical_indicators")))


def code_language(text: Column, classes: Column | None = None) -> Column:
    """The language that a class names (language-x, lang-x), else the first pattern that matches, else unknown."""
    out = None
    if classes is not None:
        named = F.filter(classes, lambda c: F.startswith(c, F.lit("language-")) | F.startswith(c, F.lit("lang-")))
        out = F.when(F.size(named) > 0, F.split(named[0], "-")[1])
    for name, pattern in LANGUAGES:
        hit = text.rlike("(?i)" + pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("unknown")
