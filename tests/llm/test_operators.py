"""The corpus operators against brute force, and on nulls, empty and repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from weblode.llm import bytespans, common, decontaminate, lines, licences, mixing, passages, sharding, simhash, suffixes, toxicity, vectors

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = "ba ke li mo nu ta re si do fe gu ha jo ka le mi".split()


def word(rng):
    return "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4)))


def prose(rng, n):
    return " ".join(word(rng) for _ in range(n))


def corpus(seed=1):
    """Documents with shared passages, near and exact copies, nulls, empty texts and repeated rows."""
    rng = random.Random(seed)
    passage, texts = prose(rng, 90), [prose(rng, rng.randint(1, 200)) for _ in range(40)]
    texts += [f"{prose(rng, 30)} {passage} {prose(rng, 20)}" for _ in range(6)]
    texts += [texts[3]] * 4 + [texts[5] + " end"] + [" ".join(passage.split()[10:75])] + ["é" * 150 + passage + "é" * 150, "a " * 300, "a " * 260]
    rows = [(k, t, "en", f"s{k % 5}" if k % 7 else None, len(t)) for k, t in enumerate(texts)]
    return rows + [(100, None, None, None, None), (101, "", "de", "s1", 0), (102, " \n\t ", "de", "s1", 4), (None, texts[4], "en", "s2", 1), rows[6], rows[6]]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_suffixes_and_common_prefixes(tmp_path, monkeypatch):
    rng = np.random.default_rng(1)
    for k in range(60):
        monkeypatch.setattr(suffixes, "BLOCK", 7 if k % 2 else 1 << 17)
        monkeypatch.setattr(suffixes, "RANGE", 5 if k % 2 else 1 << 12)
        body = rng.integers(1, int(rng.integers(2, 6)), int(rng.integers(1, 120)))
        text = np.append(np.concatenate([body, body]) if k % 3 == 0 else body, 0).astype(np.uint8)
        cap, out, values = (1, 3, 200)[k % 3], [], []
        suffixes.scan_suffixes(text, 7, cap, str(tmp_path / str(k)), lambda p, v, _: (out.append(p.copy()), values.append(v.copy())), held=20 if k % 4 == 0 else 1 << 20)
        order, found, raw = np.concatenate(out)[::-1].tolist(), np.concatenate(values)[::-1], text.tobytes()
        assert order == sorted(range(len(text) - 1), key=lambda i: raw[i:])
        for i in range(len(order) - 1):
            n = 0
            while n < cap and max(order[i], order[i + 1]) + n < len(raw) and raw[order[i] + n] == raw[order[i + 1] + n]:
                n += 1
            assert found[i] == n


def test_bytespans(docs, rows):
    count = {}
    raw = [(i, (t or "").encode()) for i, t, *_ in rows]
    for _, t in raw:
        for k in range(len(t) - 199):
            count[t[k : k + 200]] = count.get(t[k : k + 200], 0) + 1
    want = []
    for i, t in raw:
        gone = bytearray(len(t))
        for k in range(len(t) - 199):
            if count[t[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        spans = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        want.append((i, len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    got = [tuple(r) for r in bytespans.repeated_bytes(docs.sparkSession, docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(w[2] for w in want) > 0


def test_passages(docs, rows):
    first = {}
    for i, t, *_ in rows:
        w = words_of(t)
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    want = []
    for i, t, *_ in rows:
        w = words_of(t)
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if i is not None and first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        want.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    got = [tuple(r) for r in passages.repeated_words(docs.sparkSession, docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(w[2] for w in want) > 0


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 4]), 42) for k in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, rows):
    fps = [brute_fingerprint(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                root[find(a)] = find(b)
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[find(k)] = min(least.get(find(k), r[0]), r[0])
    want = [(r[0], f"{fps[k]:016x}", least.get(find(k))) for k, r in enumerate(rows)]
    got = [tuple(r) for r in simhash.near_duplicates(docs.sparkSession, docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = simhash.distinct_documents(docs.sparkSession, docs).collect()
    assert len(kept) == len({w[2] for w in want})
    assert kept[0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars"}


def test_simhash_clusters_of_many_near_copies(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    fps = np.unique(np.concatenate([np.concatenate([[b], b ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64))]) for b in base]))
    each = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    found = simhash.links(each, len(fps)).collect()
    assert len(found) <= len(fps)
    root = {int(f): int(f) for f in fps.view(np.int64)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in found:
        root[find(a)] = find(b)
    assert len({find(x) for x in root}) == 3


def test_toxicity_learns_insults_with_gaps(spark):
    rng = random.Random(5)
    bad = ["stupidface", "worthless", "idiotic"]
    rows, marks = [], []
    for k in range(400):
        w = [word(rng) for _ in range(rng.randint(5, 60))]
        toxic = k % 4 == 0
        if toxic:
            w.insert(rng.randint(0, len(w)), rng.choice(bad))
        rows.append((k, " ".join(w) + ".", "en", "s", 1))
        marks.append((k, 1, int(toxic)))
    docs, labels = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    extra = [(1000, "ba ke stupxidface li", "en", "s", 1), (1001, "mo w-o-r-t-h-l-e-s-s nu", "en", "s", 1), (1002, "mo i d i o t i c nu", "en", "s", 1), (1003, None, None, None, None), (1004, "", None, None, 0), (1005, "ba ke li " * 5000, None, None, 0), (1005, "ba ke li " * 5000, None, None, 0), (1006, "ba ke stxupidfxace li", "en", "s", 1), (1007, "ba ke st5pidface li", "en", "s", 1), (1008, "ba ke " * 15 + "s t u p i d f a c e li", "en", "s", 1), (1009, "ba " * 40_000 + "worthlzess", None, None, 1)]
    from pyspark.sql import functions as F

    out = {r["doc_id"]: r for r in toxicity.scored(docs.unionByName(spark.createDataFrame(extra, SCHEMA)).withColumn("score", F.lit("x")), model).collect()}
    held = [k for k in range(400) if zlib.crc32(str(k).encode()) % 3 == 1]
    assert sum(out[k]["predicted"] == (k % 4 == 0) for k in held) >= 0.95 * len(held)
    assert [out[k]["predicted"] for k in range(1000, 1010)] == [1, 1, 1, 0, 0, 0, 1, 1, 1, 1]
    assert all(0 <= r["score"] <= 1 for r in out.values())
    assert "doc_id" in toxicity.civil(docs, labels).columns
    none = toxicity.train(docs, labels.where("toxic = 0"))
    assert none is None and {r["score"] for r in toxicity.scored(docs, none).collect()} == {0.0}


def test_subsequence_kernel():
    """The kernel of short words against the sum over all pairs of subsequences, and the Nystroem map against the kernel of its landmarks."""
    words, decay = ["abcab", "stupid", "stxupid", "aab", "idiotic", "1d1otic", "zzzz"], 0.85

    def raw(a, b):
        def feats(w):
            out = {}
            for i in range(len(w)):
                for j in range(i + 1, len(w)):
                    for k in range(j + 1, len(w)):
                        if k - i < toxicity.SPAN:
                            key = tuple("#" if c.isdigit() else c for c in (w[i], w[j], w[k]))
                            out[key] = out.get(key, 0) + decay ** (k - i + 1)
            return out

        x, y = feats(a), feats(b)
        return sum(v * y.get(c, 0) for c, v in x.items())

    got = toxicity.Landmarks(words, decay).values(words)
    want = np.array([[raw(a, b) / (raw(a, a) * raw(b, b)) ** 0.5 for b in words] for a in words])
    assert np.allclose(got, want, atol=1e-5)
    own, vectors = np.linalg.eigh(got**3)
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(own, 1e-6))) @ vectors.T
    assert np.allclose((got**3 @ root) @ (got**3 @ root).T, got**3, atol=1e-4)


def test_working_set_solves_for_all_rows():
    rng = np.random.default_rng(3)
    toxic, clean = rng.normal(1, 0.6, (40, 5)), rng.normal(-1, 0.6, (3000, 5))
    toxic[:, -1] = clean[:, -1] = 3.0
    w = toxicity._working_set(toxic, clean, 40)
    side = np.concatenate([np.ones(40), -np.ones(3000)])
    full = toxicity._svm(np.concatenate([toxic, clean]), side, np.where(side > 0, 10.0, 10.0 * min(1.0, 160 / 3000)), 60)
    assert np.mean(np.sign(clean @ w) == np.sign(clean @ full)) > 0.995 and (clean @ w > 0).mean() < 0.02


def test_decontaminate(spark):
    rng = random.Random(8)
    items = [prose(rng, rng.randint(14, 50)) + ". " + prose(rng, 6) + "." for _ in range(12)]
    bench = spark.createDataFrame([*enumerate(items), (90, None), (91, ""), (92, items[0])], "item_id long, text string")
    rows, want = [], {}
    for k in range(60):
        w = prose(rng, rng.randint(0, 150)).split()
        if k % 3 == 0:
            it = k // 3 % 12
            part = items[it].split()
            if k % 2:
                part[len(part) // 2] = "changed"
            at = rng.randint(0, len(w))
            w = w[:at] + part + w[at:]
            want[k] = it
        rows.append((k, " ".join(w), "en", "s", 1))
    rows += [(100, None, None, None, None), (101, "", None, None, None), rows[0], (None, rows[3][1], None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept, found = decontaminate.leaks(spark, docs, bench)
    got = {}
    for r in found.join(kept, "rid").select("doc.doc_id", "item_id").collect():
        got.setdefault(r[0], set()).add(r[1])
    assert got.pop(None) == {1}
    assert set(got) == set(want) and all(want[k] in got[k] for k in want)
    assert 92 in got[0]
    clean = decontaminate.clean(spark, docs, bench)
    assert clean.count() == len(rows) - len(want) - 2 and clean.columns == docs.columns
    assert decontaminate.clean(spark, docs, bench.where("false")).count() == len(rows)
    for block in (5,):
        again = decontaminate.leaks(spark, docs, bench, block)[1].select("item_id").distinct().count()
        assert again >= 12


@pytest.mark.parametrize("others", [0, 3000])
def test_decontaminate_finds_replaced_words_and_short_items(spark, others):
    rng = random.Random(15)
    items = [" ".join(f"i{k}w{rng.randrange(400)}" for _ in range(n)) for k, n in enumerate([30] * 12 + [2, 4, 5, 8, 9, 11])]
    rows, want = [], set()
    for k, item in enumerate(items):
        for part in (0.0, 0.2, 0.3, 0.4):
            w = item.split()
            if part and len(w) < 30:
                continue
            for at in rng.sample(range(len(w)), int(part * len(w))):
                w[at] = f"foreign{rng.randrange(10**6)}"
            assert brute_lcs(w, item.split()) >= 0.6 * len(w)
            doc = [f"before{rng.randrange(10**6)}" for _ in range(rng.randrange(40))] + w + [f"after{rng.randrange(10**6)}" for _ in range(30)]
            want.add((len(rows), k))
            rows.append((len(rows), " ".join(doc)))
    rows += [(len(rows) + k, " ".join(f"other{rng.randrange(10**6)}" for _ in range(20))) for k in range(others)]
    # the answer, an item without full stops, is the whole item
    bench = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    kept, found = decontaminate.leaks(spark, spark.createDataFrame(rows, "doc_id long, text string"), bench)
    assert {tuple(r) for r in found.join(kept, "rid").select("doc.doc_id", "item_id").collect()} == want


def brute_lcs(a, b):
    table = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for k, y in enumerate(b):
            last, table[k + 1] = table[k + 1], last + 1 if x == y else max(table[k + 1], table[k])
    return table[-1]


def test_decontaminate_takes_small_arrow_batches(spark, monkeypatch):
    """What a worker holds of the texts must not follow the number of rows: an executor's memory was overrun by batches of 10,000 rows."""
    seen, tokens = [], decontaminate.tokens

    def watched(docs, items):
        sizes = docs.mapInArrow(lambda frames: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in frames), "n long")
        seen.extend(r["n"] for r in sizes.collect())
        return tokens(docs, items)

    monkeypatch.setattr(decontaminate, "tokens", watched)
    docs = spark.range(12000).selectExpr("id as doc_id", "repeat(concat('word', id, ' '), 200) as text")
    kept, found = decontaminate.leaks(spark, docs.coalesce(1), spark.createDataFrame([(1, "some few words of an item")], "item_id long, text string"))
    assert kept.count() == 12000 and found.count() == 0
    assert max(seen) <= 2 * decontaminate.BATCH < sum(seen)


def test_decontaminate_searches_documents_at_once_as_one_by_one():
    """Documents side by side are held against brute force over each alone, with items that repeat words and reach over the ends."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 60, n)) for n in (3, 7, 10, 14, 30, 45)] + ["again again again w1 again w2"]
    items = decontaminate.Items(list(range(len(texts))), texts)
    search = decontaminate.Search(items, np.concatenate([[0.0], np.ones(items.many - 1)]), np.random.default_rng(6).standard_normal((items.many, 64)))
    search.least = -1.0  # every window is near every piece
    docs = []
    for k in range(80):
        row = items.rows[k % len(texts)].copy()
        row[rng.random(len(row)) < 0.3] = 0
        docs.append(np.concatenate([rng.integers(0, items.many, rng.integers(0, 20)), row, rng.integers(0, items.many, rng.integers(0, 20))]) if k % 9 else row[:0])
    at = np.concatenate([[0], np.cumsum([len(x) for x in docs])])
    together = search(np.concatenate(docs).astype(np.int32), at)
    alone = [(r, i, x) for r, ids in enumerate(docs) for _, i, x in search(ids.astype(np.int32), np.array([0, len(ids)]))]
    assert sorted(together) == sorted(alone)
    want = set()
    for r, ids in enumerate(docs):
        for item, row in enumerate(items.rows):
            slack = int(search.slack[item])
            starts = {s - int(o) for size, pieces in search.classes for o in search.offsets[pieces[search.of[pieces] == item]] for s in range(0, max(1, len(ids) - size + decontaminate._step(size)), decontaminate._step(size)) if ids[s : s + size].any()}
            for begin in starts:
                part = ids[max(0, begin - slack) : max(0, begin + len(row) + slack)]
                if brute_lcs(row.tolist(), part.tolist()) >= 0.6 * len(row) and brute_lcs(items.answers[item].tolist(), part.tolist()) >= 0.5 * len(items.answers[item]):
                    want.add((r, item))
    assert {(r, i) for r, i, _ in together} == want and len(want) > 30


def test_subsequence():
    rng = np.random.default_rng(4)
    for _ in range(50):
        a, b = rng.integers(0, 5, rng.integers(1, 30)), rng.integers(0, 5, rng.integers(0, 40))
        assert decontaminate.subsequence(a, b) == brute_lcs(a.tolist(), b.tolist())


def test_licences(spark):
    mit = "\n".join(["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and", 'associated documentation files (the "Software"), to deal in the Software without restriction, including', "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell", "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the", "following conditions:", "", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."])
    texts = ["Prose here. Released under the MIT License.\nMore.", mit, "Licensed under the Apache License, Version 2.0. Licensed under CC BY-NC 4.0.", "The licence is long gone.", None, ""]
    rows = [(k, t, None, None, None) for k, t in enumerate(texts)] + [(None, texts[0], None, None, None), (0, texts[0], None, None, None)]
    from pyspark.sql import functions as F

    out = licences.scanned(spark.createDataFrame(rows, SCHEMA).withColumn("licences", F.lit(1))).collect()
    assert [r["licences"] for r in out] == [["MIT"], ["MIT"], ["Apache-2.0", "CC-BY-NC-4.0"], [], [], [], ["MIT"], ["MIT"]]
    assert out[1]["sentence_ids"] == ["mit-grant", "mit-notice"]


def test_licences_official_notices(spark):
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/."
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.\n\nThis program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\nGNU General Public License for more details."
    apache = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution."
    want = {mpl: "MPL-2.0", gpl: "GPL-3.0-or-later", apache: "Apache-2.0", bsd: "BSD-2-Clause"}
    want["Prose that ends in\nLicensed under CC BY-NC 4.0."] = "CC-BY-NC-4.0"
    marks = ["", "    ", "# ", " * ", "// "]
    rows = [(mark + text.replace("\n", "\n" + mark), name) for text, name in want.items() for mark in marks]
    out = licences.scanned(spark.createDataFrame(rows, "text string, name string")).collect()
    assert [(r["name"], r["licences"]) for r in out if r["licences"] != [r["name"]]] == []


GPL = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version {} of the License, or\n(at your option) any later version.\n\nThis program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
BSD2 = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution."
BSD3 = BSD2 + "\n\n3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission."
MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of\nthis software and associated documentation files (the "Software"), to deal in\nthe Software without restriction, including without limitation the rights to\nuse, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of\nthe Software, and to permit persons to whom the Software is furnished to do so,\nsubject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.'
ISC = 'Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES\nWITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF\nMERCHANTABILITY AND FITNESS.'
LGPL = "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.\n\nThis library is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
#: What each text must give, written by hand: at least one for each rule.
LICENCES = [
    ("Released under the MIT License.", "MIT"), (MIT, "MIT"), ("MIT License\n\nCopyright (c) 2020 Someone\n\n" + MIT, "MIT"),
    ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"), ("                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS", "Apache-2.0"),
    ('Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at', "Apache-2.0"),
    ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"), (GPL.format(3), "GPL-3.0-or-later"), (GPL.format(2), "GPL-2.0-or-later"),
    ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Everyone is permitted to copy", "GPL-3.0"), ("GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991\n", "GPL-2.0"),
    ("Licensed under the GNU General Public License, version 2.", "GPL-2.0"), ("Licensed under the GNU Lesser General Public License, version 3.", "LGPL-3.0"), ("GNU LESSER GENERAL PUBLIC LICENSE\n  Version 3, 29 June 2007", "LGPL-3.0"),
    ("GNU LESSER GENERAL PUBLIC LICENSE\n  Version 2.1, February 1999", "LGPL-2.1"), (LGPL, "LGPL-2.1-or-later"),
    ("Licensed under the Mozilla Public License, Version 2.0.", "MPL-2.0"), ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy", "MPL-2.0"), ("Mozilla Public License Version 2.0\n====", "MPL-2.0"),
    (ISC, "ISC"), ("ISC License\n\n" + ISC, "ISC"), ("Licensed under the BSD 2-Clause License.", "BSD-2-Clause"), (BSD2, "BSD-2-Clause"), ("BSD 2-Clause License\n\n" + BSD2, "BSD-2-Clause"),
    ("Licensed under the BSD 3-Clause License.", "BSD-3-Clause"), (BSD3, "BSD-3-Clause"), ("BSD 3-Clause License\n\nCopyright (c) 2021, Someone\n\n" + BSD3, "BSD-3-Clause"),
    ("Licensed under CC BY 4.0.", "CC-BY-4.0"), ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0"), ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), ("Licensed under CC0 1.0.", "CC0-1.0"),
    ("This is free and unencumbered software released into the public domain.", "Unlicense"), ("Copyright, all rights reserved.", "Proprietary"),
    (BSD3 + "\n\nReleased under the MIT License.", "BSD-3-Clause,MIT"), (BSD2 + "\n" + BSD3, "BSD-2-Clause,BSD-3-Clause"), ("The license of the sea is wide.", ""), ("Permission is hereby granted, free of charge.", ""),
]


def test_licences_every_rule(spark):
    marks = ["", "    ", "# ", " * ", "// "]
    rows = [(mark + text.replace("\n", "\n" + mark), name, mark) for text, name in LICENCES for mark in marks]
    out = licences.scanned(spark.createDataFrame(rows, "text string, name string, mark string")).collect()
    assert [(r["name"], r["mark"], r["licences"], r["sentence_ids"]) for r in out if ",".join(r["licences"]) != r["name"]] == []
    seen = {",".join(f"<{i}>" for i in rule) for _, rule in licences.RULES} - {",".join(f"<{i}>" for i in rule) for _, rule in licences.RULES for r in out if "".join(f"<{i}>" for i in rule) in "".join(f"<{i}>" for i in r["sentence_ids"])}
    assert not seen


def test_vectors(spark):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((30, 64))
    x = np.concatenate([base, base[:10] + 0.02 * rng.standard_normal((10, 64)), base[:3] + 0.3 * rng.standard_normal((3, 64)), base[:5], np.repeat(base[7:8], 40, 0) + 0.01 * rng.standard_normal((40, 64))]).astype(np.float32).tolist()
    rows = [(k, v, k % 2 if k < 80 else 1) for k, v in enumerate(x)]
    rows += [(200, None, 1), (201, [0.0] * 64, 1), (202, [float("nan")] * 64, 1), (203, x[0], None), (204, [None, 1.0], 1), (205, [1.0, 2.0], 1), rows[4], (206, [], 1), (207, [float("inf"), 1.0], 0)]
    got = vectors.near_vectors(spark, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    unit = [None if not v or any(c is None or not np.isfinite(c) for c in v) or not any(v) or la is None else np.array(v, float) / np.linalg.norm(np.array(v, float)) for _, v, la in rows]
    near = [[j for j in range(len(rows)) if j != i and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and rows[i][2] == rows[j][2] and unit[i] @ unit[j] >= 0.98] for i in range(len(rows))]
    comp = list(range(len(rows)))
    for _ in rows:
        for i, js in enumerate(near):
            for j in js:
                comp[i] = comp[j] = min(comp[i], comp[j], key=lambda c: rows[c][0])
    want = sorted((rows[i][0], len(near[i]), rows[comp[i]][0], rows[i][0] == rows[comp[i]][0]) for i in range(len(rows)))
    assert sorted(map(tuple, got)) == want
    assert sum(w[1] for w in want) > 800


@pytest.mark.parametrize("dim", [3, 16, 64, 300])
def test_vectors_recall_of_projections(dim):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((300, dim))
    y = np.concatenate([x + s * rng.standard_normal(x.shape) for s in (0.05, 0.15, 0.2, 0.25)])
    ux, uy = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y))
    want = {(i, j) for i, j in zip(*np.nonzero(ux @ uy.T >= 0.98), strict=True)}
    got = set(zip(*vectors.linked(x, y, False), strict=True))
    assert got <= want and len(got) >= 0.999 * len(want) and len(want) > 400


@pytest.mark.parametrize("dim", [8, 64])
def test_vectors_in_cells(spark, dim):
    """Large labels, cut to cells and blocks: nothing counted twice, and the recall that was calibrated."""
    rng = np.random.default_rng(10)
    base = rng.standard_normal((1500, dim))
    near = base[:500] + 0.19 * rng.standard_normal((500, dim))
    hot = base[7] + 0.05 * rng.standard_normal((120, dim))
    x = np.concatenate([base, near, hot])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(k, v, 1) for k, v in enumerate(x.tolist())] + [(9000 + k, [1.0] * (k + 1), 1) for k in range(1100)]
    out = {r["vec_id"]: r for r in vectors.near_vectors(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), cell=100, block=64).collect()}
    close = u @ u.T >= 0.98
    np.fill_diagonal(close, False)
    want, got = close.sum(axis=1), np.array([out[k]["n_links"] for k in range(len(x))])
    assert (got <= want).all() and want.sum() > 10000 and got.sum() >= 0.99 * want.sum()
    assert all(out[9000 + k]["n_links"] == 0 or k + 1 == dim for k in range(1100))


def test_vectors_effort_grows_slowly(spark):
    n = spark.createDataFrame([(10**k,) for k in range(3, 11)], "n long")
    from pyspark.sql import functions as F

    rows = [tuple(r) for r in n.select("n", *vectors.effort(F.col("n"))).collect()]
    assert rows[0][1:] == (0, 1)
    for (n0, _, t0), (n1, _, t1) in zip(rows[1:], rows[2:], strict=False):
        assert t1 / t0 <= (n1 / n0) ** 0.3


def brute_lines(rows, c=lines.SHINGLE):
    at, sets = [], []
    for n, (i, t, *_) in enumerate(rows):
        for k, line in enumerate((t or "").split("\n") if t else []):
            if line.strip(" \t\r\x0b\x0c"):
                at.append((i, k, n))
                sets.append({line[p : p + c] for p in range(max(1, len(line) - c + 1))})
    root = list(range(len(at)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(at)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    groups = {}
    for k in range(len(at)):
        groups.setdefault(find(k), []).append(at[k])
    return at, {at[k]: min(groups[find(k)]) for k in range(len(at))}


def test_lines(spark):
    rng = random.Random(12)
    shared = [prose(rng, 40) for _ in range(5)]
    near = [s.replace("ba", "be", 1) for s in shared]
    rows = []
    for k in range(60):
        body = [prose(rng, rng.randint(1, 40)) for _ in range(rng.randint(1, 4))] + ([rng.choice(shared)] if k % 3 == 0 else []) + ([rng.choice(near)] if k % 4 == 0 else []) + ["", "  "]
        rng.shuffle(body)
        rows.append((k, "\n".join(body)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, rows[0][1]), (104, prose(rng, 3000))]
    out = lines.line_components(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    at, first = brute_lines(rows)
    full = [r for r in out if r["first_doc"] is not None]
    assert len(full) == len(at) and all((r["first_doc"], r["first_line"]) == first[(r["doc_id"], r["line_no"], next(n for n, x in enumerate(rows) if x[0] == r["doc_id"]))][:2] for r in full)
    assert sum(r["kept"] for r in full) == len({first[a] for a in at})
    assert all(r["kept"] for r in out if r["first_doc"] is None) and any(not r["kept"] for r in full)
    assert len(out) == sum(len(t.split("\n")) for _, t in rows if t)


def test_lines_recall_near_the_threshold(spark):
    """Pairs of lines at 0.80 to 0.85, made by changing letters here and there."""
    rng, rows, want = random.Random(31), [], 0
    letters, shingles = "abcdefghijklmnopqrstuvwxyz ", lambda t: {t[k : k + lines.SHINGLE] for k in range(max(1, len(t) - lines.SHINGLE + 1))}
    while want < 250:
        base = "".join(rng.choice(letters) for _ in range(rng.randint(30, 400)))
        near = list(base)
        for at in rng.sample(range(len(near)), max(1, len(near) // 45)):
            near[at] = rng.choice(letters)
        near = "".join(near)
        x, y = shingles(base), shingles(near)
        if 0.8 <= len(x & y) / len(x | y) < 0.85:
            rows += [(2 * want, base), (2 * want + 1, near)]
            want += 1
    out = {r["doc_id"]: r["first_doc"] for r in lines.line_components(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(out[2 * k + 1] == 2 * k for k in range(want)) >= 0.99 * want


def test_lines_links_short_near_copies(spark):
    base = "The quick brown fox jumps over the lazy dog near the old stone bridge at dawn, 1234 people saw it."
    near = [base.replace("quick", "quack"), base.replace("1234", "1235"), base.replace("stone", "brick")]
    short = "a line of sixty letters, or so, that differs in one letter"
    rows = [*enumerate([base, *near, short, short.replace("sixty", "sixti"), "something else, that is like none of the others here"])]
    out = lines.line_components(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["first_doc"] for r in out} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 4, 6: 6}


def test_lines_reads_few_texts_of_pairs_that_are_not_alike(spark, monkeypatch):
    """Lines of one pattern with other words changed meet in buckets; bitmaps tell nearly all their pairs apart, and lose none that is alike."""
    rng, verified, read = random.Random(41), lines.verified, []
    base = prose(rng, 60).split()
    rows = []
    for k in range(40):
        words = [word(rng) if rng.random() < 0.2 else w for w in base]
        rows.append((2 * k, " ".join(words)))
        rows.append((2 * k + 1, " ".join(words) + "x"))

    def counted(scratch, pairs, *rest):
        read.extend((min(p), max(p)) for p in pairs.collect())
        return verified(scratch, pairs, *rest)

    monkeypatch.setattr(lines, "verified", counted)
    out = lines.line_components(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    at, first = brute_lines(rows)
    assert {r["doc_id"]: r["first_doc"] for r in out} == {a[0]: first[a][0] for a in at}
    assert len(read) <= 4 * len(rows)


def test_bitmaps_pass_over_no_pair_that_is_alike(spark):
    rng, texts = random.Random(43), []
    for n in [0, 1, 4, 5, 6, 15, 16, 17, 60, 200, 400, 900, 3000]:
        base = "".join(rng.choice("abcdeé𝄞 ") for _ in range(n))
        for edits in (0, 1, n // 45, n // 30, n // 8):
            near = list(base)
            for place in rng.sample(range(n), min(n, edits)):
                near[place] = rng.choice("xyz")
            texts.append("".join(near))
    units = [[t.encode("utf-16-be")[k : k + 2] for k in range(0, len(t.encode("utf-16-be")), 2)] for t in texts]
    sets = [{b"".join(u[k : k + lines.SHINGLE]) for k in range(max(1, len(u) - lines.SHINGLE + 1))} for u in units]
    pairs = [(a, b) for a in range(len(texts)) for b in range(a)]
    sketches = lines.sketched(spark.createDataFrame(list(enumerate(texts)), "lid long, line string"), lines.SHINGLE)
    kept = {tuple(r) for r in lines.fitting(spark.createDataFrame(pairs, "a long, b long"), sketches, 0.8).collect()}
    alike = {(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert alike <= kept and len(alike) > 20 and len(kept) < len(pairs) / 2


def test_mixing(spark, docs, rows):
    slim = mixing.sized(docs)
    out = mixing.mixed(spark, slim).collect()
    assert sorted(r["size"] for r in out) == sorted(len(words_of(r[1])) for r in rows)
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(words_of(r[1]))
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = dict(zip(names, [5, 2, 1] * len(names), strict=False))
    target, full = {}, set()
    for _ in names:
        rest = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        target = {s: 2.0 * sizes[s] if s in full else rest * weight[s] / sum(weight[x] for x in open_) for s in names}
        over = {s for s in open_ if target[s] > 2 * sizes[s]}
        if not over:
            break
        full |= over
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6 * max(1, target[r["source"]])
        assert 0 <= r["copies"] <= 2
    for s in names:
        taken = sum(r["copies"] * r["size"] for r in out if r["source"] == s)
        largest = max(r["size"] for r in out if r["source"] == s)
        assert abs(taken - target[s]) <= 2 * largest
    again = mixing.mixed(spark, slim.repartition(2)).collect()
    key = lambda r: (str(r["doc_id"]), r["size"], r["copies"])
    assert sorted(map(key, out)) == sorted(map(key, again))
    whole = mixing.mix(spark, docs)
    assert whole.columns == docs.columns and whole.count() == sum(r["copies"] for r in out)


def test_sharding(spark, docs, rows):
    from pyspark.sql import functions as F

    out = sharding.kd_shards(spark, sharding.described(docs), 8).collect()
    assert len(out) == len(rows)
    assert sorted((r["size"], r["text_crc32"]) for r in out) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, *_ in rows)
    total, largest = sum(r["size"] for r in out), max(r["size"] for r in out)
    shards = {}
    for r in out:
        shards.setdefault((r["size"], r["text_crc32"]), set()).add(r["shard"])
    assert all(len(found) == 1 for found in shards.values())
    for s in range(8):
        mine = [r for r in out if r["shard"] == s]
        assert sorted(r["slot"] for r in mine) == list(range(len(mine)))
        assert abs(sum(r["size"] for r in mine) - total / 8) <= 4 * largest
    whole = sharding.shard(spark, docs.withColumn("slot", F.lit("x")), 3)
    assert whole.count() == len(rows) and {r[0] for r in whole.select("shard").distinct().collect()} == {0, 1, 2}


def test_sharding_keeps_large_groups_whole(spark):
    rng = random.Random(4)
    copy, huge = prose(rng, 900), prose(rng, 4000)
    rows = [(k, prose(rng, rng.randint(1, 300)), "en", f"s{k % 3}", 1) for k in range(300)] + [(1000 + k, copy, "de", None, 1) for k in range(12)] + [(2000 + k, huge, "en", "s1", 1) for k in range(40)]
    out = sharding.kd_shards(spark, sharding.described(spark.createDataFrame(rows, SCHEMA)), 8).collect()
    total, group = sum(r["size"] for r in out), 40 * (len(huge.encode()) + 1)
    assert group > total / 8 > 12 * len(copy)
    sizes = [sum(r["size"] for r in out if r["shard"] == s) for s in range(8)]
    assert max(sizes) - min(sizes) <= 2 * 12 * (len(copy.encode()) + 1)
    # more bytes than a shard should have: several shards; anything less: one
    assert len({r["shard"] for r in out if r["doc_id"] >= 2000}) > 1
    assert len({r["shard"] for r in out if 1000 <= r["doc_id"] < 2000}) == 1


@pytest.mark.parametrize("bits", [0, 3, 10])
def test_simhash_shuffles_in_proportion(spark, bits):
    rng = np.random.default_rng(8)
    fps = np.unique(rng.integers(0, 1 << 63, 600, dtype=np.uint64))
    fps = np.unique(np.concatenate([fps, fps[:50] ^ np.uint64(0b1011), fps[50:60] ^ np.uint64(1 << 40)]))
    each = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    blobs = each.repartition(2).mapInArrow(simhash.emitter(2, bits), "part int, fps binary, counts binary, keys binary").collect()
    assert sum(len(r["keys"]) for r in blobs) == 3 * 2081 * len(fps)
    assert all(0 < len(r["fps"]) // 8 <= len(r["keys"]) // 3 and 0 not in np.frombuffer(r["counts"], np.uint16) for r in blobs)
    assert sum(len(r["fps"]) + len(r["counts"]) + len(r["keys"]) for r in blobs) <= 13 * 2081 * len(fps)
    want = {(min(a, b), max(a, b)) for k, a in enumerate(fps.view(np.int64).tolist()) for b in fps.view(np.int64)[:k].tolist() if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4}
    got = {(min(r), max(r)) for r in simhash.links(each, len(fps), bits=bits).collect()}
    assert got == want and len(want) == 60


def test_empty_tables(spark, nothing):
    assert bytespans.repeated_bytes(spark, nothing).count() == 0
    assert passages.repeated_words(spark, nothing).count() == 0
    assert simhash.near_duplicates(spark, nothing).count() == 0
    assert lines.line_components(spark, nothing.select("doc_id", "text")).count() == 0
    assert mixing.mix(spark, nothing).count() == 0
    assert sharding.shard(spark, nothing).count() == 0
    assert licences.scanned(nothing).count() == 0
    bench = spark.createDataFrame([(1, "some words of an item that is there")], "item_id long, text string")
    assert decontaminate.clean(spark, nothing, bench).count() == 0
    assert vectors.near_vectors(spark, spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    model = toxicity.train(nothing, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert toxicity.scored(nothing, model).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(0, 50)] + [(rng.randint(60, 90), rng.randint(60, 90)) for _ in range(20)] + [(200, k) for k in range(201, 300)]
    out = dict(map(tuple, common.components(common.Scratch(spark, "t"), spark.createDataFrame(edges, "a long, b long")).collect()))
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert out == {x: r for x, r in root.items() if any(x in e and e[0] != e[1] for e in edges)}
