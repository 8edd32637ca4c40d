import hashlib
import math
import pickle
import random
import re
import textwrap

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import licenses
from tesserae.llm.decontaminate import decontaminate
from tesserae.llm.language import fit_language_models, fit_models, held_out, identify, plain
from tesserae.llm.licenses import license_scan

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))


def brute(docs, items, width):
    out = set()
    windows = []
    for item, text in items:
        w = split(text)
        windows += [(item, w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
    for i, text in docs:
        w, hit, found = split(text), set(), set()
        for item, g in windows:
            for p in range(len(w) - len(g) + 1):
                if w[p : p + len(g)] == g:
                    hit |= set(range(p, p + len(g)))
                    found.add(str(item))
        out.add((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("block_bytes", [16 << 20, 400])
def test_decontaminate(spark, block_bytes):
    rng = random.Random(2)
    vocabulary = ["the", "a", "Of", "é", "naïve", "x1", "longer", "日本", "and", "thing"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", " - "]) for _ in range(n))
    items = [(i, text(rng.randrange(11, 30))) for i in range(20)] + [(90, "a"), (91, "Naïve x1"), (92, None), (93, "!!"), (1, "the the"), (94, "é")]
    docs = [(i, text(rng.randrange(0, 200))) for i in range(40)]
    docs += [(100 + i, text(20) + items[i][1] + text(20)) for i in range(20)]
    docs += [(200, None), (201, ""), (202, "..."), (203, items[3][1].upper()), (204, "a" * 9000), (205, "a " * 9000), (206, "xa ax a")]
    d = spark.createDataFrame([(i, t, "s") for i, t in docs], "doc_id long, text string, n_words string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r)[:6] for r in decontaminate(d, b, block_bytes=block_bytes).collect()}
    assert got == brute(docs, items, 10)
    assert decontaminate(d.limit(0), b).count() == 0
    assert decontaminate(d, b.limit(0)).filter("contaminated").count() == 0


def test_decontaminate_with_repeats_null_ids_and_cut_items(spark):
    rng = random.Random(8)
    words = [f"w{rng.randrange(50)}" for _ in range(900)]
    items = [("a", " ".join(words)), ("b", " ".join(words[300:340])), (None, " ".join(words[5:20])), ("a", " ".join(words[880:]))]
    texts = [" ".join(words[i : i + 9 + i % 17] + ["x"]) for i in range(0, 880, 40)] + ["clean words only", None]
    docs = [(i, t, "s") for i, t in enumerate(texts)]
    d = spark.createDataFrame([*docs, *docs, (None, texts[0], "s"), (None, None, "s")], "doc_id long, text string, spans string")
    b = spark.createDataFrame(items, "item_id string, text string")
    want = brute(docs_of(d), items, 10)
    for more in ({}, {"piece_words": 40}, {"piece_words": 40, "block_bytes": 900}):
        got = decontaminate(d, b, **more).collect()
        assert len(got) == d.count() and {tuple(r)[:6] for r in got} == want
        flat = [list(zip(r.hit_spans[::2], r.hit_spans[1::2])) for r in got]
        assert all(sum(z - a for a, z in f) == r.n_hit and all(x[1] < y[0] for x, y in zip(f, f[1:])) for f, r in zip(flat, got))


def docs_of(d):
    return [(r.doc_id, r.text) for r in d.collect()]


def test_a_large_benchmark_goes_block_by_block(spark):
    rng = random.Random(9)
    vocabulary = [f"{rng.randrange(16**5):x}" for _ in range(3000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=400))) for i in range(2000)]  # 4.6 MB
    docs = [(i, " ".join(rng.choices(vocabulary, k=300))) for i in range(300)]
    docs += [(1000 + i, docs[i][1] + " " + " ".join(t.split()[50 : 50 + 9 + i % 3])) for i, t in items[:60]]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for i, t in items:
        w = t.split()
        for k in range(len(w) - 9):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    want = {}
    for i, t in docs:
        w = t.split()
        at = [k for k in range(len(w) - 9) if tuple(w[k : k + 10]) in windows]
        found = {n for k in at for n in windows[tuple(w[k : k + 10])]}
        want[i] = (len({p for k in at for p in range(k, k + 10)}), ",".join(sorted(found)))
    out = decontaminate(d, b, block_bytes=1 << 20)
    assert {r.doc_id: (r.n_hit, r.items_sha256) for r in out.collect()} == {i: (n, hashlib.sha256(x.encode()).hexdigest()) for i, (n, x) in want.items()}
    assert sum(n > 0 for n, _ in want.values()) == 40
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_every_known_sentence_has_a_mark_and_is_normal():
    for s in licenses.SENTENCES.values():
        assert any(m in s for m in licenses.MARKS) and re.fullmatch("[a-z0-9]+( [a-z0-9]+)*", s)
    assert all(any(m in s for m in licenses.MARKS) for s in licenses.SLOTS.values()) and not set(licenses.SENTENCES) & {37, 52, 56}
    assert {i for _, r in licenses.RULES for i in r} <= set(licenses.SENTENCES) | set(licenses.SLOTS) | set(licenses.SLOTS_ENDORSE)


def test_license_scan(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."
    docs = [
        (1, "Some text.\nLicensed under the Apache License, Version 2.0.\nMore."), (2, "Released under the MIT license! all rights reserved"),
        (3, None), (4, ""), (5, "not licensed under the mit license really"), (6, (mit.upper() + " ") * 2), (None, "Licensed under CC BY-NC 4.0."),
        (7, "x. " * 20000 + "All rights reserved."), (8, "Licensed under the MIT License\nLicensed under the MIT License"),
        (9, "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n"),
    ]
    got = {r.doc_id: (r.licenses, r.permissive) for r in license_scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1] == (["Apache-2.0"], True)
    assert got[2] == (["MIT", "LicenseRef-all-rights-reserved"], False)
    assert got[3] == got[4] == got[5] == ([], False)
    assert got[6] == (["MIT"], True) and got[8] == (["MIT"], True)
    assert got[7] == (["LicenseRef-all-rights-reserved"], False) and got[None] == (["CC-BY-NC-4.0"], False)
    assert got[9] == (["Apache-2.0"], True)


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this
software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED."""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software is distributed on an "AS IS" BASIS."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""


LGPL = """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as
published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY."""
GPL2ONLY = """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as
published by the Free Software Foundation."""
EPL = """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at
https://www.eclipse.org/legal/epl-2.0/"""
ZERO = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, for any purpose, and by any means."""


def test_license_tags_and_odd_tables(spark):
    docs = [
        (1, "// SPDX-License-Identifier: MIT\nint x;"), (2, "/* SPDX-License-Identifier: GPL-2.0-or-later */"), (3, "# spdx-license-identifier: Apache-2.0"),
        (4, "SPDX-License-Identifier: MIT OR Apache-2.0"), (5, "MIT\nApache-2.0"), (6, "SPDX-License-Identifier: Unknown-1.0"), (1, "// SPDX-License-Identifier: MIT\nint x;"),
    ]
    table = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "1 rest", "'x' hits", "null sentence_ids")
    got = sorted((r.doc_id, r.licenses, r.permissive) for r in license_scan(table).collect())
    assert got == [(1, ["MIT"], True), (1, ["MIT"], True), (2, ["GPL-2.0-or-later"], False), (3, ["Apache-2.0"], True), (4, ["MIT", "Apache-2.0"], True), (5, [], False), (6, [], False)]
    assert license_scan(table.limit(0)).count() == 0


@pytest.mark.parametrize("width", [40, 72, 79, 10_000])
def test_license_scan_of_wrapped_notices(spark, width):
    notices = [
        ("MIT", MIT, [7, 8, 9]), ("BSD-3-Clause", BSD, [18, 19, 20, 21]), ("GPL-3.0-or-later", GPL, [11, 12, 13]), ("Apache-2.0", APACHE, [2, 3, 4]),
        ("ISC", ISC, [35]), ("MPL-2.0", MPL, [22]), ("GPL-2.0-or-later", GPL.replace("version 3", "version 2"), [11, 12, 25]),
        ("BSD-2-Clause", BSD.replace(BSD[BSD.index("3. Neither") : BSD.index("THIS SOFTWARE")], ""), [18, 19, 20]), ("LGPL-2.1-or-later", LGPL, [30, 27, 29]),
        ("LGPL-3.0-or-later", GPL.replace("GNU General", "GNU Lesser General"), [11, 27, 13]), ("AGPL-3.0-or-later", GPL.replace("GNU General", "GNU Affero General"), [11, 28, 13]),
        ("GPL-2.0-only", GPL2ONLY, [11, 31]), ("EPL-2.0", EPL, [33]), ("0BSD", ZERO, [26]), ("Unlicense", UNLICENSE, [23]), ("MIT", MIT.upper(), [7, 8, 9]),
    ]
    styles = [("", "\n"), (" * ", "\n"), ("# ", "\r\n")]
    docs, want = [], {}
    for name, text, ids in notices:
        for mark, end in styles:
            blocks = [textwrap.wrap(" ".join(b.split()), width) for b in text.split("\n\n")]
            lines = [x for b in blocks for x in [*b, ""]]
            want[len(docs)] = ([name], ids)
            docs.append((len(docs), end.join(mark + x for x in ["A title", "Copyright (c) 2020 Somebody", "", *lines, "some code"])))
    got = license_scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.licenses, r.sentence_ids) for r in got} == want


def clause(three):
    return BSD[: BSD.index("3. Neither")] + three + "\n\n" + BSD[BSD.index("THIS SOFTWARE") :]


END = "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
OTHER_NOTICES = [  # what each is, by hand
    (clause("3. Neither the name of Google Inc. " + END), ["BSD-3-Clause"]),
    (clause("3. Neither the name of the University " + END), ["BSD-3-Clause"]),
    (clause("* Neither the name of the <organization>, Foo & Co. Ltd., " + END), ["BSD-3-Clause"]),
    (clause("3. The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission."), ["BSD-3-Clause"]),
    (clause("3. Nobody's name may in any way help to endorse or promote products made with this."), ["LicenseRef-BSD-endorsement"]),
    (clause(""), ["BSD-2-Clause"]),
    (clause("3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software "
            "developed by the organization.\n\n4. Neither the name of the organization " + END), ["BSD-4-Clause"]),
    ("Apache License\n\nVersion 2.0, January 2004\n\nhttp://www.apache.org/licenses/", []),  # a blank line parts the head
    ("Apache License Version 2.0, January 2004\n\nTERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION", ["Apache-2.0"]),
    ("GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007\n\nCopyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>", ["GPL-3.0-only"]),
    ("GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", ["LGPL-2.1-only"]),
    ("This software is provided 'as-is', without any express or implied warranty.\n\nPermission is granted to anyone to use this software for any purpose, including "
     "commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin must not be misrepresented.", ["Zlib"]),
    ("Boost Software License - Version 1.0 - August 17th, 2003\n\nPermission is hereby granted", ["BSL-1.0"]),
    ("Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt)", ["BSL-1.0"]),
    ("Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", ["LicenseRef-BSD-style"]),
    ("To the extent possible under law, Jane Q. Public has waived all copyright and related or neighboring rights to This Work.", ["CC0-1.0"]),
    ("SPDX-License-Identifier: Apache-2.0 OR MIT", ["Apache-2.0", "MIT"]),
    ("SPDX-License-Identifier: (MIT AND BSD-3-Clause)", ["MIT", "BSD-3-Clause"]),
    ("SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0", ["GPL-2.0-only"]),
    ("The apache helicopter has a license and the mit has a lab. Neither the name of the rose nor the names of its friends matter.", []),
    ("We do not endorse or promote products. This software is not licensed to anyone.", []),
    ("To the extent possible under law, we will waive fees.", []),
]


@pytest.mark.parametrize("width", [50, 79, 10_000])
def test_other_notices_have_the_licence_that_they_state(spark, width):
    docs, want = [], {}
    for text, names in OTHER_NOTICES:
        for mark in ("", " * ", "// "):
            blocks = [textwrap.wrap(" ".join(b.split()), width) for b in text.split("\n\n")]
            if text.startswith("SPDX"):
                blocks = [[text]]  # a tag stands on one line
            want[len(docs)] = names
            docs.append((len(docs), "\n".join(mark + x for b in blocks for x in [*b, ""])))
    got = {r.doc_id: r.licenses for r in license_scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_license_scan_does_not_join_over_blank_lines_or_within_sentences(spark):
    docs = [
        (1, "released under\n\nthe mit license"), (2, "it is not\nreleased under the mit license or so"), (3, "all\nrights\nreserved"),
        (4, "x\x01released under the mit license"), (5, "all rights reserved\nreleased under the\nmit license\nmore"), (6, "." * 50_000 + "x"),
    ]
    got = {r.doc_id: r.sentence_ids for r in license_scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: [], 2: [], 3: [24], 4: [], 5: [24, 5], 6: []}


def kneser_ney(words, text):
    """Bits of a word by interpolated Kneser-Ney with one discount an order, from dictionaries of strings."""
    order = 4
    counts = [{} for _ in range(order)]
    before = [{} for _ in range(order)]
    for w, times in words:
        w = f" {w} "
        for i in range(1, len(w)):
            for k in range(order):
                if i < max(k, 1):
                    continue
                g = w[i - k : i + 1]
                if k == order - 1 or (k and i == k):
                    counts[k][g] = counts[k].get(g, 0) + times
                if k < order - 1 and i > k:
                    before[k].setdefault(g, set()).add(w[i - k - 1])
    for k in range(order - 1):
        for g, x in before[k].items():
            counts[k][g] = counts[k].get(g, 0) + len(x)
    out = 0.0
    text = f" {text} "
    for i in range(1, len(text)):
        p = None
        for k in range(min(order - 1, i) + 1):
            c, values = counts[k], list(counts[k].values())
            ones, twos = values.count(1), values.count(2)
            d = min(0.95, max(0.05, ones / max(1, ones + 2 * twos)))
            context = text[i - k : i]
            own = [v for g, v in c.items() if g[:-1] == context]
            if own:
                low = d * len(own) / sum(own) * (p if k else 1 / ALPHABET)
                g = context + text[i]
                p = low + ((c[g] - d) / sum(own) if g in c else 0)
        out -= math.log2(p)
    return out


ALPHABET = 1 + len(set("aàbcdeghilmnoprstuv "))


def test_bits_equal_a_direct_kneser_ney():
    words = {
        "x": [("the", 5), ("then", 2), ("other", 1), ("bathe", 1), ("a", 7), ("cat", 1), ("hat", 2)],
        "y": [("alla", 3), ("palla", 1), ("della", 4), ("àgli", 1), ("uva", 2), ("mese", 1), ("rosa", 1)],
    }
    models = fit_models({x: ([w for w, _ in t], np.array([n for _, n in t], dtype=float)) for x, t in words.items()})
    assert set("".join(w for t in words.values() for w, _ in t) + " ") == set("aàbcdeghilmnoprstuv ")
    asked = ["the", "th", "heat", "alla", "q", "zzz", "àà", "rosathe"]
    bits, n = models.bits(asked)
    assert n.tolist() == [len(w) + 1 for w in asked]
    for w, row in zip(asked, bits):
        assert row == pytest.approx([kneser_ney(words[x], w) for x in models.langs], rel=1e-9)


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet").cache()


@pytest.fixture(scope="module")
def models(labelled):
    return fit_language_models(labelled)


def test_language_of_held_out_documents(labelled, models):
    held = labelled.filter(held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    got = identify(held, models).join(held.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(got) > 100 and sum(r.lang == r.lang_pred for r in got) >= 0.99 * len(got)
    assert sum(r.rejected for r in got) <= 0.005 * len(got)


def test_language_odd_input(spark, labelled, models):
    extra = spark.createDataFrame(
        [(None, None), (5001, ""), (5002, "123 !!"), (5003, "Zażółć gęślą jaźń wszystkie dzieci śpią kołdrą żyrafy i źrebięta" * 20), (5004, "qxzj vkpw " * 200), (5005, "the and of " * 20000)],
        "doc_id long, text string",
    )
    by = {r.doc_id: r for r in identify(extra, models).collect()}
    assert all(by[i].lang_pred == "und" and by[i].rejected and by[i].score == 0 for i in (None, 5001, 5002))
    assert by[5003].rejected and by[5004].rejected and not by[5005].rejected
    assert all(0 <= r.score <= 1 for r in by.values())
    assert fit_language_models(labelled.limit(0)) is None
    assert identify(labelled.limit(0), models).count() == 0
    assert {r.doc_id: (r.lang_pred, r.rejected) for r in identify(extra, None).collect()} == {i: ("und", i in (None, 5001, 5002)) for i in by}
    twice = extra.union(extra).selectExpr("doc_id", "text", "'x' lang_pred", "1 rejected")
    assert sorted(map(str, identify(twice, models).collect())) == sorted(str(r) for r in by.values() for _ in (0, 1))
    assert b"tesserae" not in pickle.dumps(plain(models))


def test_whole_languages_and_scripts_left_out_are_rejected(spark, labelled):
    some = labelled.filter("length(text) > 400")
    models = fit_language_models(some.filter("lang != 'de'"))
    out = identify(some.filter("lang = 'de'"), models).select("rejected").collect()
    assert sum(r.rejected for r in out) >= 0.95 * len(out)
    greek = spark.createDataFrame([(1, "Πρόκειται για κείμενο σε άλλη γραφή που κανείς δεν έμαθε. " * 6)], "doc_id long, text string")
    assert identify(greek, models).first().rejected


def test_rare_labels_are_learned_and_reject_unseen_scripts(spark, labelled):
    rare = [(9000 + i, f"kuva talo {'järvi sauna ' * 3} mies nainen lapsi koira kissa {i}", "fi") for i in range(3)] + [(9100, "só um texto", "pt")]
    models = fit_language_models(labelled.select("doc_id", "text", "lang").union(spark.createDataFrame(rare, "doc_id long, text string, lang string")))
    assert {"fi", "de", "en"} <= set(models.langs) and np.isfinite(models.centre).all()
    asked = [(1, "järvi sauna talo mies nainen lapsi"), (2, "Πρόκειται για κείμενο σε άλλη γραφή που κανείς δεν έμαθε. " * 6)]
    got = {r.doc_id: r for r in identify(spark.createDataFrame(asked, "doc_id long, text string"), models).collect()}
    assert got[1].lang_pred == "fi" and not got[1].rejected and got[2].rejected
