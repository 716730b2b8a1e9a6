"""Licence scans by sentence rules: normalised sentences become identifiers, and ordered rules match the sequence of identifiers.

A text is cut to sentences at full stops, question and exclamation marks before white space and at line ends; a line that plainly goes on in the next
one is joined to it, once indents and comment marks are gone. A sentence in lower case, with every run of other signs than a-z and 0-9 as one space, is looked up among the known sentences.
The identifiers of a text, in order, are its sequence (sentences that aren't known leave no trace in it). A rule is an ordered list of identifiers
and matches where these follow one another. Longer rules come first, and what a rule has matched is used up, so the sentences of a notice that another
notice contains name the longer one alone. Both tables are constants of this module, so the lookup is an expression on the row: no join, no shuffle.
Texts without any of TRIGGERS, one of which every known sentence contains, skip the work.

Defined results. Null, empty or blank text: empty sequence, no licence. Very long texts: the whole text is cut, in the row. Null doc_id: kept. Repeated rows
and copies: each row has its result. A rule that matches twice is named once. Empty table: no rows. Other columns are not read and stay, but for sentence_ids
and licences, which are replaced.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weblode.llm.common import table

SENTENCES: dict[str, tuple[str, ...]] = {
    "ref-mit": ("Released under the MIT License", "Licensed under the MIT License", "This project is licensed under the MIT License", "The MIT License", "MIT License", "The MIT License (MIT)"),
    "ref-apache-2": ("Licensed under the Apache License, Version 2.0", "Released under the Apache License, Version 2.0", "Apache License, Version 2.0", "This work is licensed under the Apache License, Version 2.0"),
    "ref-gpl-3": ("This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License, version 3", "Released under the GNU General Public License, version 3", "GNU General Public License, version 3"),
    "ref-gpl-2": ("This work is licensed under the GNU General Public License, version 2", "Licensed under the GNU General Public License, version 2", "Released under the GNU General Public License, version 2"),
    "ref-lgpl-3": ("Licensed under the GNU Lesser General Public License, version 3", "This work is licensed under the GNU Lesser General Public License, version 3"),
    "ref-mpl-2": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License, Version 2.0"),
    "ref-bsd-3": ("Licensed under the 3-Clause BSD License", "Licensed under the BSD 3-Clause License", "Released under the BSD 3-Clause License"),
    "ref-bsd-2": ("Licensed under the BSD 2-Clause License", "Released under the BSD 2-Clause License"),
    "ref-cc-by-4": ("Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    "ref-cc-by-sa-4": ("Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "ref-cc-by-nc-4": ("Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "ref-cc0": ("Licensed under CC0 1.0", "Released under the CC0 1.0 Universal Public Domain Dedication license"),
    "all-rights": ("All rights reserved under copyright law", "Copyright, all rights reserved"),
    "mit-grant": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    ),
    "mit-notice": ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",),
    "as-is-mit": ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',),
    "isc-grant": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",),
    "as-is-isc": ('THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS',),
    "bsd-grant": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",),
    "bsd-source": ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",),
    "bsd-binary": ("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",),
    "bsd-names": ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",),
    "apache-use": ("you may not use this file except in compliance with the License",),
    "apache-obtain": ("You may obtain a copy of the License at",),
    "gpl-free": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",),
    "gpl-warranty": ("This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",),
    "gpl-details": ("See the GNU General Public License for more details",),
    "gpl2-free": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version"),
    "lgpl-free": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",),
    "lgpl-warranty": ("This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",),
    "title-apache": ("Apache License",),
    "title-gpl": ("GNU General Public License",),
    "title-lgpl": ("GNU Lesser General Public License",),
    "dated-apache-2": ("Version 2.0, January 2004", "Version 2.0, January 2004 http://www.apache.org/licenses/", "Version 2.0, January 2004 https://www.apache.org/licenses/"),
    "dated-gpl-3": ("Version 3, 29 June 2007",),
    "dated-gpl-2": ("Version 2, June 1991",),
    "dated-lgpl-21": ("Version 2.1, February 1999",),
    "title-mpl-2": ("Mozilla Public License Version 2.0", "Mozilla Public License, version 2.0"),
    "title-bsd-3": ("BSD 3-Clause License", "The 3-Clause BSD License"),
    "title-bsd-2": ("BSD 2-Clause License", "The 2-Clause BSD License"),
    "title-isc": ("ISC License", "The ISC License"),
    "unlicense": ("This is free and unencumbered software released into the public domain",),
}
#: Licence and the identifiers that must follow one another.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("MIT", ("ref-mit",)),
    ("MIT", ("mit-grant", "mit-notice")),
    ("Apache-2.0", ("ref-apache-2",)),
    ("Apache-2.0", ("apache-use", "apache-obtain")),
    ("GPL-3.0", ("ref-gpl-3",)),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-warranty")),
    ("GPL-3.0", ("title-gpl", "dated-gpl-3")),
    ("GPL-2.0", ("ref-gpl-2",)),
    ("GPL-2.0", ("title-gpl", "dated-gpl-2")),
    ("GPL-2.0-or-later", ("gpl2-free", "gpl-warranty")),
    ("LGPL-3.0", ("title-lgpl", "dated-gpl-3")),
    ("LGPL-2.1", ("title-lgpl", "dated-lgpl-21")),
    ("LGPL-2.1-or-later", ("lgpl-free", "lgpl-warranty")),
    ("Apache-2.0", ("title-apache", "dated-apache-2")),
    ("MPL-2.0", ("title-mpl-2",)),
    ("BSD-3-Clause", ("title-bsd-3",)),
    ("BSD-2-Clause", ("title-bsd-2",)),
    ("ISC", ("title-isc",)),
    ("LGPL-3.0", ("ref-lgpl-3",)),
    ("MPL-2.0", ("ref-mpl-2",)),
    ("ISC", ("isc-grant", "as-is-isc")),
    ("BSD-2-Clause", ("ref-bsd-2",)),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD-3-Clause", ("ref-bsd-3",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("CC-BY-4.0", ("ref-cc-by-4",)),
    ("CC-BY-SA-4.0", ("ref-cc-by-sa-4",)),
    ("CC-BY-NC-4.0", ("ref-cc-by-nc-4",)),
    ("CC0-1.0", ("ref-cc0",)),
    ("Unlicense", ("unlicense",)),
    ("Proprietary", ("all-rights",)),
)
TRIGGERS = ("licens", "copyright", "warrant", "permission", "redistribut", "gnu general public", "public domain")

WRAPPED, SHOUTED = r"([^.!?:;\n])\n([a-zà-ÿ])", r"([A-ZÀ-Þ,])\n([A-ZÀ-Þ][A-ZÀ-Þ])"
#: Blanks at line ends; indents and comment marks; lines that go on after a small word, inside a name, before a bracket or quote, before a number; "v. 2.0".
REPAIRS = (
    (r"[ \t\r]+(?=\n)", ""),
    (r"(?m)^[ \t]*(?:(?:/\*+|\*+/?|//+|#+|;+|--+|%+|>+)[ \t]*)?", ""),
    (r"\b(of|the|or|and|a|an|to|in|for|by|under|with|this|from|as|is|are|any)\n(?=[a-z]|MERCHANTABILITY|FITNESS|(?:GNU|General|Free|Mozilla|Software|License)\b)", "$1 "),
    (r"\b(GNU|Mozilla|Lesser|General|Public|Free|Software|Apache|MIT|BSD)\n(?=(?:Lesser|General|Public|License|Software|Foundation)\b)", "$1 "),
    (r"([^.!?:;\n])\n(?=[(\"])", "$1 "),
    (r"(?i)\b(version)\n(?=[0-9])", "$1 "),
    (r"(?i)\bv\.\s+(?=[0-9])", "v "),
)
CUT, OTHER = r"[.!?]+[ \t\r\n]+|\n+", "[^a-z0-9]+"


def normalised(sentence: str) -> str:
    return re.sub(OTHER, " ", sentence.lower()).strip()


KEYS = {normalised(s): name for name, found in SENTENCES.items() for s in found}
#: Further sentences of official notices, as they read once REPAIRS are made.
NOTICES = KEYS | {
    normalised('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License'): "apache-use",
}
#: Rules in the order in which they match.
ORDERED = sorted(RULES, key=lambda r: -len(r[1]))
assert all(any(all(any(t in s for t in TRIGGERS) for s, i in NOTICES.items() if i == name) for name in rule) for _, rule in RULES)


def identifiers(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    for sign, other in REPAIRS:
        text = F.regexp_replace(text, sign, other)
    joined = F.regexp_replace(F.regexp_replace(text, WRAPPED, "$1 $2"), SHOUTED, "$1 $2")
    plain = F.transform(F.split(joined, CUT), lambda s: F.trim(F.regexp_replace(F.lower(s), OTHER, " ")))
    known = F.create_map(*[F.lit(x) for pair in NOTICES.items() for x in pair])
    return F.filter(F.transform(plain, lambda s: F.try_element_at(known, s)), lambda x: x.isNotNull())


def matched(ids: Column) -> Column:
    """Names of the licences whose rules match, sorted: each rule's identifiers are replaced by =name=, longer rules first."""
    sequence = F.array_join(F.transform(ids, lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "")
    for name, rule in ORDERED:
        sequence = F.replace(sequence, F.lit("".join(f"<{i}>" for i in rule)), F.lit(f"={name}="))
    return F.array_sort(F.array_distinct(F.regexp_extract_all(sequence, F.lit("=([^=<>]+)="), F.lit(1))))


def scanned(docs: DataFrame) -> DataFrame:
    """docs with sentence_ids and licences (arrays of strings); columns of these names are replaced."""
    marked = F.lower("text").rlike("|".join(TRIGGERS))
    none = F.array().cast("array<string>")
    out = docs.withColumn("sentence_ids", F.when(marked, identifiers(F.col("text"))).otherwise(none))
    return out.withColumn("licences", F.when(F.size("sentence_ids") > 0, matched(F.col("sentence_ids"))).otherwise(none))


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scanned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.size("sentence_ids").alias("n_sentences"), F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licences", ",").alias("licences"))


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    keys, names = ", ".join(map(quote, KEYS)), ", ".join(map(quote, KEYS.values()))
    sequence = "array_to_string(list_transform(ids, lambda i: '<' || i || '>'), '')"
    for name, rule in ORDERED:
        sequence = f"replace({sequence}, {quote(''.join(f'<{i}>' for i in rule))}, {quote(f'={name}=')})"
    return f"""
WITH cut AS (
  SELECT doc_id, string_split_regex(regexp_replace(regexp_replace(text, {quote(WRAPPED)}, '\\1 \\2', 'g'), {quote(SHOUTED)}, '\\1 \\2', 'g'), {quote(CUT)}) AS parts FROM documents
), known AS (
  SELECT doc_id, list_filter(list_transform(coalesce(parts, []::VARCHAR[]), lambda s: [{names}][list_position([{keys}], trim(regexp_replace(lower(s), {quote(OTHER)}, ' ', 'g')))]), lambda x: x IS NOT NULL) AS ids FROM cut
)
SELECT doc_id, CAST(len(ids) AS INTEGER) AS n_sentences, array_to_string(ids, ',') AS sentence_ids,
  array_to_string(list_sort(list_distinct(regexp_extract_all({sequence}, '=([^=<>]+)=', 1))), ',') AS licences
FROM known"""


QUERIES = {"op4_licences": op4_licences}
ORACLE_SQL = {"op4_licences": _sql()}
