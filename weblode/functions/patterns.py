"""Technical patterns in text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from weblode.functions.text import W, context_windows, holding, let, words

_B = rf"(?<![{W}])", rf"(?![{W}])"


def _word(alternatives: str) -> str:
    """Any of the alternatives as whole words."""
    return f"{_B[0]}(?:{alternatives}){_B[1]}"


SYNTAX = {
    "function_definition": rf"{_B[0]}[{W}]+\s*[(][^)]*[)]\s*[{{]",
    "type_definition": rf"{_word('class|interface|enum')}\s+[{W}]+",
    "import_statement": rf"{_word('import|include|require')}.*?[\n;]",
    "variable_declaration": rf"{_word('const|let|var|def|val')}\s+[{W}]+\s*=",
    "markup_tag": rf"[</>][{W}\-]*>",
    "style_declaration": rf"[{W}\-]+\s*:\s*[{W}\-]+\s*;",
    "sql_query": rf"{_word('select|insert|update|delete')}.*?{_word('from|into|where')}",
    "decorator_annotation": rf"@[{W}]+",
    "async_pattern": _word("async|await|yield|return"),
    "error_handling": _word("try|catch|finally|throw"),
}
#: An opener with a closer after it: the same truth value as matching the nested structure, without its backtracking.
STRUCTURED = {
    "nested_structure": r"[\[{][^\[{\]}\n]*[\]}]|[\[{](?s:.*)[\]}]",
    "json_like": rf'"[{W}]+"\s*:',
    "xml_like": rf"<[{W}]+>.*?</[{W}]+>",
    "key_value": rf"""{_B[0]}[{W}]+\s*=\s*['"].+?['"]""",
    "measurement": rf"{_B[0]}\p{{Nd}}+(?:\.\p{{Nd}}+)?(?:(?:px|em|rem){_B[1]}|%(?=[{W}]))",
    "url": rf"{_B[0]}(?:www\.|https?://)\S+",
}
#: What each of these can't match without, in lower case; of a tuple any one. They are found much faster, and few texts hold them.
SIGNS = {
    "function_definition": ("(", ")", "{"),
    "type_definition": (("class", "interface", "enum"),),
    "import_statement": (("import", "include", "require"), ("\n", ";")),
    "variable_declaration": (("const", "let", "var", "def", "val"), "="),
    "markup_tag": (">",),
    "style_declaration": (":", ";"),
    "sql_query": (("select", "insert", "update", "delete"), ("from", "into", "where")),
    "decorator_annotation": ("@",),
    "async_pattern": (("async", "await", "yield", "return"),),
    "error_handling": (("try", "catch", "finally", "throw"),),
    "nested_structure": (("[", "{"), ("]", "}")),
    "json_like": ('"', ":"),
    "xml_like": ("<", "</"),
    "key_value": ("=", ("'", '"')),
    "measurement": (("px", "em", "rem", "%"),),
    "url": (("www.", "http"),),
}
COMPOUND = rf"{_B[0]}[{W}]+(?:[-_][{W}]+)+{_B[1]}"
CAMEL = rf"{_B[0]}([A-Z][0-9a-z]+){{2,}}{_B[1]}"
CONSTANT = rf"{_B[0]}[A-Z][A-Z0-9_]+{_B[1]}"
PHRASE = tuple("implementation framework library api function method class object interface protocol service database query server client".split())
DOMAINS = {"web_api": "api|rest|http|endpoint", "database": "database|sql|query|table", "web_development": "html|css|javascript|dom", "react": "react|component|props|state"}


def _labels(text: Column, patterns: dict[str, str], flags: str) -> Column:
    found = let(F.lower(text), lambda low: F.array(*[F.when(holding(low, SIGNS[n]) & text.rlike(flags + p), F.lit(n)) for n, p in patterns.items()]))
    return F.array_sort(F.filter(found, lambda x: x.isNotNull()))


def syntax(text: Column) -> Column:
    return _labels(text, SYNTAX, "(?im)")


def structured(text: Column) -> Column:
    return _labels(text, STRUCTURED, "(?m)")


def technical_terms(text: Column) -> Column:
    """Compound, camel-case and constant-case terms, and three words in a row of which one is technical or compound; sorted."""
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in (COMPOUND, CAMEL, CONSTANT)]

    def phrases(w: Column) -> Column:
        likely = F.transform(w, lambda x: x.isin(*PHRASE) | F.contains(x, F.lit("-")) | F.contains(x, F.lit("_")))
        starts = F.when(F.size(w) >= 3, F.sequence(F.lit(1), F.size(w) - 2)).otherwise(F.array().cast("array<int>"))
        hits = let(likely, lambda l: F.filter(starts, lambda i: F.element_at(l, i) | F.element_at(l, i + 1) | F.element_at(l, i + 2)))
        return F.transform(hits, lambda i: F.array_join(F.slice(w, i, 3), " "))

    phrases = let(words(F.lower(text)), phrases)
    return F.array_sort(F.array_distinct(F.concat(*found, phrases)))


def has_context(text: Column) -> Column:
    """Whether there is a technical term or a syntax pattern."""
    low = F.lower(text)
    many = F.size(words(text)) >= 3
    phrase = many & F.exists(words(low), lambda x: x.isin(*PHRASE) | F.contains(x, F.lit("-")) | F.contains(x, F.lit("_")))
    found = text.rlike(COMPOUND) | text.rlike(CAMEL) | text.rlike(CONSTANT) | phrase
    return found | let(low, lambda low: _any([holding(low, SIGNS[n]) & text.rlike("(?im)" + p) for n, p in SYNTAX.items()]))


def _any(conditions: list[Column]) -> Column:
    found = F.lit(False)
    for c in conditions:
        found = found | c
    return found


def domains(text: Column) -> Column:
    """Domains named in windows that have technical context; sorted."""

    def named(windows: Column) -> Column:
        return F.filter(F.array(*[F.when(F.exists(windows, _matcher("(?i)" + _word(p))), F.lit(n)) for n, p in DOMAINS.items()]), lambda x: x.isNotNull())

    hinted = F.filter(context_windows(text), _matcher("(?i)" + _word("|".join(DOMAINS.values()))))
    return F.array_sort(let(F.filter(hinted, has_context), named))  # has_context is the dearer test


def _matcher(pattern: str) -> Callable[[Column], Column]:
    return lambda w: w.rlike(pattern)


def analyse(text: Column) -> Column:
    """All four sets of a text as one struct: syntax, terms, structured and domains."""
    return F.struct(syntax(text).alias("syntax"), technical_terms(text).alias("terms"), structured(text).alias("structured"), domains(text).alias("domains"))
