"""DuckDB SQL for the engine's own queries. Word characters are [\\p{L}\\p{N}_]; that engine has no lookaround, so borders are spelled as neighbours."""

from __future__ import annotations

from weblode.functions import classify, patterns, score
from weblode.functions.text import BOILERPLATE, W
from weblode.operators.prompt import EXPANSIONS, STOP

KW = score.KEYWORDS
PRE, POST = rf"(?:^|[^{W}])", rf"(?:$|[^{W}])"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def words(t: str) -> str:
    return rf"list_filter(string_split_regex({t}, '\s+'), lambda w: w <> '')"


def collapse(t: str) -> str:
    return rf"trim(regexp_replace({t}, '\s+', ' ', 'g'))"


def clean_code(t: str) -> str:
    out = collapse(t)
    for p in BOILERPLATE:
        out = f"replace({out}, {q(p)}, '')"
    return collapse(f"regexp_replace({out}, {q(_KEEP)}, ' ', 'g')")


_KEEP = rf"""[^{W}\s\-.,!?(){{}}\[\]<>=+*/'":]"""


def clean_plain(t: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({t}, '\s+', ' ', 'g'), '[^{W}\s\-.,?!]', '', 'g'))"


def any_of(t: str, terms) -> str:
    return "(" + " OR ".join(f"contains({t}, {q(x)})" for x in terms) + ")"


def hits(t: str, terms, each: float) -> str:
    return "(0.0::DOUBLE" + "".join(f" + CASE WHEN contains({t}, {q(x.lower())}) THEN {each}::DOUBLE ELSE 0.0::DOUBLE END" for x in terms) + ")"


def when(c: str, value: float) -> str:
    return f"(CASE WHEN {c} THEN {value}::DOUBLE ELSE 0.0::DOUBLE END)"


def groups(w: str, n: int, step: int | None = None) -> str:
    """Groups of n words; the words are bound once, as a list of one list."""
    return f"list_transform([{w}], lambda ws: list_transform(range(0, len(ws), {step or n}), lambda i: array_to_string(ws[i + 1 : i + {n}], ' ')))[1]"


def sentences(t: str) -> str:
    out = t
    for p in (r"([.!?])\s+([A-Z])", rf"(;)\s+([{W}])", rf"(\}})\s*([{W}])", r"(\n)\s*([A-Z])"):
        out = f"regexp_replace({out}, {q(p)}, {q(chr(92) + '1' + chr(1) + chr(92) + '2')}, 'g')"
    return rf"list_filter(list_transform(string_split({out}, chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"


def quick(t: str) -> str:
    low, w = f"lower({t})", words(t)
    return f"least(1.0::DOUBLE, {hits(low, KW, 0.3)} + {when(any_of(low, score.TECH), 0.2)} + {when(f'len({w}) > 50', 0.1)} + {when(f'len(list_distinct({w}))::DOUBLE / (len({w}) + 1) > 0.4::DOUBLE', 0.1)})"


def content(t: str) -> str:
    w = words(t)
    tests = [rf"{PRE}[{W}]+\s*\(\s*\)", "<[^>]+>", rf"\{{\s*[{W}\-]+\s*:", rf"(?i)(select|insert|update|create)\s+[{W}]+"]
    out = f"{hits(f'lower({t})', KW, 2.0)} / {len(KW) + 1}.0::DOUBLE"
    for p in tests:
        out += f" + {when(f'regexp_matches({t}, {q(p)})', 0.2)}"
    out += f" + {when(f'len({w}) > 50', 0.1)} + {when(f'len({w}) > 0 AND len(list_distinct({w}))::DOUBLE / len({w}) > 0.4::DOUBLE', 0.1)}"
    return f"CASE WHEN {t} = '' THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, {out}) END"


def sub_tokens(t: str) -> str:
    piece = rf"least(512, len(regexp_extract_all(substring({t}, i + 1, 512), '[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}\s]')) + 2)"
    return f"coalesce(list_sum(list_transform(range(0, length({t}), 512), lambda i: {piece})), 0)"


def semantic(t: str) -> str:
    names = [e for v in score.ENTITIES.values() for e in v]
    low = f"lower({t})"
    return f"0.5::DOUBLE * ({hits(low, KW, 2.0)} / {len(KW) + 1}.0::DOUBLE) + 0.3::DOUBLE * ({hits(low, names, 1.0)} / {len(names) + 1}.0::DOUBLE) + 0.2::DOUBLE * ({sub_tokens('sample')}::DOUBLE / 100.0::DOUBLE)"


def mentions(t: str) -> str:
    names = [e for v in score.ENTITIES.values() for e in v]
    low = f"lower({t})"
    return f"CASE WHEN {t} = '' THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, {hits(low, KW, 0.3)}" + "".join(f" + {when(f'contains({low}, {q(e)})', 0.2)}" for e in names) + ") END"


def chunk_type(t: str) -> str:
    cases = "".join(f" WHEN regexp_matches({t}, {q('(?i)' + p)}) THEN {q(n)}" for n, p in classify.KINDS)
    return f"CASE{cases} WHEN {any_of(f'lower({t})', classify.TECHNICAL)} THEN 'technical_content' WHEN {any_of(f'lower({t})', classify.EXAMPLE)} THEN 'example' ELSE 'text' END"


def code_language(t: str) -> str:
    return "CASE" + "".join(f" WHEN regexp_matches({t}, {q('(?i)' + p)}) THEN {q(n)}" for n, p in classify.LANGUAGES) + " ELSE 'unknown' END"


def listed(pairs) -> str:
    """A list of the names whose conditions hold."""
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {q(n)} END" for n, c in pairs) + "]::VARCHAR[], lambda x: x IS NOT NULL)"


def indicators(t: str) -> str:
    return listed((n, any_of(f"lower({t})", v)) for n, v in classify.INDICATORS.items())


def bordered(p: str) -> str:
    """A pattern with lookaround borders, respelled for one that only answers whether it matches."""
    return p.replace(patterns._B[0], PRE).replace(patterns._B[1], POST)


def _syntax_tests() -> dict[str, str]:
    w = lambda x: rf"{PRE}(?:{x})"
    tests = {n: bordered(p) for n, p in patterns.SYNTAX.items()}
    tests["type_definition"] = rf"{w('class|interface|enum')}\s+[{W}]+"
    tests["variable_declaration"] = rf"{w('const|let|var|def|val')}\s+[{W}]+\s*="
    tests["import_statement"] = rf"{w('import|include|require')}(?:[\n;]|[^{W}\n][^\n]*?[\n;])"
    tests["sql_query"] = rf"{w('select|insert|update|delete')}[^{W}\n](?:[^\n]*?[^{W}\n])??(?:from|into|where){POST}"
    return tests


def syntax(t: str) -> str:
    return listed((n, f"regexp_matches({t}, {q('(?im)' + p)})") for n, p in sorted(_syntax_tests().items()))


def structured(t: str) -> str:
    tests = {n: bordered(p) for n, p in patterns.STRUCTURED.items()}
    tests["measurement"] = rf"{PRE}\p{{Nd}}+(?:\.\p{{Nd}}+)?(?:(?:px|em|rem){POST}|%[{W}])"
    return listed((n, f"regexp_matches({t}, {q('(?m)' + p)})") for n, p in sorted(tests.items()))


def _terms(t: str) -> list[str]:
    """Whole runs of word characters (and marks) that a term pattern takes in full; equal to the bordered search for these three patterns."""
    runs = rf"regexp_extract_all({t}, '[{W}]+(?:[-][{W}]+)*')"
    compound = f"list_filter({runs}, lambda x: regexp_full_match(x, {q(rf'[{W}]+(?:[-_][{W}]+)+')}))"
    single = f"regexp_extract_all({t}, '[{W}]+')"
    camel = f"list_filter({single}, lambda x: regexp_full_match(x, '([A-Z][0-9a-z]+){{2,}}'))"
    constant = f"list_filter({single}, lambda x: regexp_full_match(x, '[A-Z][A-Z0-9_]+'))"
    return [compound, camel, constant]


def likely(x: str) -> str:
    return f"({x} IN ({', '.join(map(q, patterns.PHRASE))}) OR contains({x}, '-') OR contains({x}, '_'))"


def technical_terms(t: str) -> str:
    w = words(f"lower({t})")
    phrases = f"list_transform([{w}], lambda ws: list_transform(list_filter(range(1, len(ws) - 1), lambda i: {likely('ws[i]')} OR {likely('ws[i + 1]')} OR {likely('ws[i + 2]')}), lambda i: array_to_string(ws[i : i + 2], ' ')))[1]"
    return "list_sort(list_distinct(" + " || ".join([*_terms(t), phrases]) + "))"


def has_context(x: str) -> str:
    w = words(f"lower({x})")
    terms = " OR ".join(f"len({t}) > 0" for t in _terms(x))
    marks = " OR ".join(f"regexp_matches({x}, {q('(?im)' + p)})" for p in _syntax_tests().values())
    return f"({terms} OR (len({w}) >= 3 AND len(list_filter({w}, lambda v: {likely('v')})) > 0) OR {marks})"


KEYWORD_SQL = "[" + ", ".join(map(q, KW)) + "]"
STOP_SQL = ", ".join(map(q, STOP))


def keywords(t: str) -> str:
    return rf"list_sort(list_distinct(list_filter(string_split_regex(lower({t}), '[^\p{{L}}\p{{N}}]+'), lambda w: length(w) >= 3 AND w NOT IN ({STOP_SQL}))))"


def expanded(t: str) -> str:
    more = " || ".join(f"CASE WHEN {any_of(f'lower({t})', (n, *v))} THEN [{', '.join(map(q, v))}] ELSE []::VARCHAR[] END" for n, v in EXPANSIONS.items())
    return f"list_sort(list_distinct({keywords(t)} || {more}))"


def decoded(t: str) -> str:
    for a, b in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&amp;", "&")):
        t = f"replace({t}, {q(a)}, {q(b)})"
    return t


ARTICLE = r"regexp_extract(html, '(?s)<article>(.*?)</article>', 1)"


def stripped(markup: str) -> str:
    """Text of markup without script, style or comments: strings stripped and joined."""
    return decoded(rf"array_to_string(list_transform(string_split_regex({markup}, '<[^>]*>'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), '')")


def body_without(markup: str) -> str:
    return rf"regexp_replace({markup}, '(?s)<script>.*?</script>|<style>.*?</style>|<!--.*?-->|<!DOCTYPE[^>]*>', '', 'g')"


LINKS = r"""links AS (
  SELECT page_id, url, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)', 1) AS origin, unnest(regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1)) AS href,
    unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) AS raw, generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1), 1) - 1 AS ord
  FROM pages
), anchors AS (SELECT page_id, url, origin, CAST(ord AS INTEGER) AS ord, """ + decoded("href") + """ AS href, trim(""" + decoded("raw") + """) AS text FROM links),
resolved AS (SELECT *, origin || href AS dst FROM anchors)"""


def url_score() -> str:
    path = r"lower(regexp_extract(dst, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1))"
    out = hits(path, KW, 0.3)
    for k in KW:
        out += f" + {when(f'contains(lower(text), {q(k)})', 0.4)} + {when(f'contains(lower(text), {q(k)})', 0.2)}"
    return f"least(1.0::DOUBLE, {out} + {when(any_of(path, score.PATH_BOOST), 0.2)})"


def seed_score() -> str:
    return f"{when(any_of('lower(href)', score.SEED_PATHS), 0.3)} + {when(any_of('lower(text)', KW), 0.4)} + {when(any_of('lower(text)', KW), 0.2)}"
