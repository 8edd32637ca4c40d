"""License scans: sentences to identifiers, identifier sequences to licences, in DataFrame operations only."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import id_and_text

# Known licence sentences, normalised (lower case, runs of other characters as one space).
SENTENCES = {
    1: "licensed under the apache license version 2 0",
    2: "licensed under the apache license version 2 0 the license",
    3: "you may not use this file except in compliance with the license",
    4: "you may obtain a copy of the license at",
    5: "released under the mit license",
    6: "licensed under the mit license",
    7: "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    8: "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    9: "the software is provided as is without warranty of any kind express or implied",
    10: "this work is licensed under the gnu general public license version 3",
    11: "this program is free software",
    12: "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    13: "either version 3 of the license or at your option any later version",
    14: "licensed under cc by nc 4 0",
    15: "licensed under cc by 4 0",
    16: "licensed under cc by sa 4 0",
    17: "this work is licensed under a creative commons attribution 4 0 international license",
    18: "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    19: "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    20: "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    21: "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    22: "this source code form is subject to the terms of the mozilla public license v 2 0",
    23: "this is free and unencumbered software released into the public domain",
    24: "all rights reserved",
    25: "either version 2 of the license or at your option any later version",
    26: "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    27: "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    28: "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation",
    29: "either version 2 1 of the license or at your option any later version",
    30: "this library is free software",
    31: "you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    32: "you can redistribute it and or modify it under the terms of the gnu general public license version 3 as published by the free software foundation",
    33: "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    34: "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0 which is available at https www eclipse org legal epl 2 0",
    35: "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    36: "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    41: "apache license version 2 0 january 2004",
    42: "gnu general public license version 3 29 june 2007",
    43: "gnu general public license version 2 june 1991",
    44: "gnu lesser general public license version 3 29 june 2007",
    45: "gnu lesser general public license version 2 1 february 1999",
    46: "gnu affero general public license version 3 19 november 2007",
    47: "mozilla public license version 2 0",
    48: "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    49: "boost software license version 1 0 august 17th 2003",
    50: "distributed under the boost software license version 1 0",
    51: "cc0 1 0 universal",
    53: "use of this source code is governed by a bsd style license that can be found in the license file",
    54: "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    55: "use of this source code is governed by an mit style license that can be found in the license file",
}

# Sentences with a place for a name, which may hold sentence ends (Inc.); what stands there is any run of words.
SLOTS = {
    21: "neither the names? of {} nor the names? of (?:(?:its|their|other|any|the) )?contributors may be used to endorse or promote products derived from this software without (?:specific )?prior written permission",
    37: "the names? of {} may not be used to endorse or promote products derived from this software without (?:specific )?prior written permission",
    52: "to the extent possible under law {} (?:has|have) waived all copyright and related or neighboring rights to {}",
}
NAME = "[a-z0-9 \n\x01]{1,160}?"
# Any other clause about endorsement: what has it is no BSD-2-Clause notice, whatever its words.
ENDORSE = "endorse"  # a word of it, since lines may break anywhere
SLOTS_ENDORSE = {56: "(?:{} )?endorse or promote products(?: {})?"}
CLAUSE = "[a-z0-9 \n]{1,300}"

# Identifiers that a tag line names; the tag and the identifier are one sentence.
TAG = "spdx-license-identifier:"
TAGGED = (
    "MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "0BSD", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "MPL-2.0", "EPL-2.0",
    "Zlib", "BSL-1.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later",
)
SENTENCES |= {101 + i: "spdx license identifier " + re.sub("[^a-z0-9]+", " ", name.lower()) for i, name in enumerate(TAGGED)}

# Licence rules in order. An earlier rule takes its sentences before a later one sees them.
RULES = [
    ("Apache-2.0", (2, 3, 4)),
    ("Apache-2.0", (2,)),
    ("Apache-2.0", (1,)),
    ("MIT", (7, 8, 9)),
    ("MIT", (7,)),
    ("MIT", (5,)),
    ("MIT", (6,)),
    ("GPL-3.0-or-later", (11, 12, 13)),
    ("GPL-2.0-or-later", (11, 12, 25)),
    ("GPL-3.0-only", (10,)),
    *(("BSD-4-Clause", (18, 19, 20, 54, last)) for last in (21, 37, 56)),
    ("LicenseRef-BSD-advertising", (18, 19, 20, 54)),
    *(("BSD-3-Clause", (18, 19, 20, last)) for last in (21, 37)),
    ("LicenseRef-BSD-endorsement", (18, 19, 20, 56)),
    ("BSD-2-Clause", (18, 19, 20)),
    ("Apache-2.0", (41,)),
    ("GPL-3.0-only", (42,)),
    ("GPL-2.0-only", (43,)),
    ("LGPL-3.0-only", (44,)),
    ("LGPL-2.1-only", (45,)),
    ("AGPL-3.0-only", (46,)),
    ("MPL-2.0", (47,)),
    ("Zlib", (48,)),
    ("BSL-1.0", (49,)),
    ("BSL-1.0", (50,)),
    ("CC0-1.0", (51,)),
    ("CC0-1.0", (52,)),
    ("LicenseRef-BSD-style", (53,)),
    ("MIT", (55,)),
    ("CC-BY-NC-4.0", (14,)),
    ("CC-BY-SA-4.0", (16,)),
    ("CC-BY-4.0", (15,)),
    ("CC-BY-4.0", (17,)),
    ("MPL-2.0", (22,)),
    ("Unlicense", (23,)),
    ("ISC", (35,)),
    ("ISC", (36,)),
    ("0BSD", (26,)),
    ("LGPL-2.1-or-later", (30, 27, 29)),
    ("LGPL-3.0-or-later", (30, 27, 13)),
    ("LGPL-3.0-or-later", (11, 27, 13)),
    ("AGPL-3.0-or-later", (11, 28, 13)),
    ("GPL-2.0-only", (11, 31)),
    ("GPL-3.0-only", (11, 32)),
    ("EPL-2.0", (33,)),
    ("EPL-2.0", (34,)),
    *((name, (101 + i,)) for i, name in enumerate(TAGGED)),
    ("LicenseRef-all-rights-reserved", (24,)),
]

# Sentences of published notices that go on after a known one or hold several, and the identifiers they stand for.
PUBLISHED = {
    SENTENCES[7] + " the software to deal in the software without restriction including without limitation the rights to use copy modify merge "
    "publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
    "subject to the following conditions": (7,),
    SENTENCES[9] + " including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": (9,),
} | {f"{SENTENCES[terms]} {SENTENCES[version]}": (terms, version) for terms in (12, 27, 28) for version in (13, 25, 29)}

# Every known sentence holds one of these.
MARKS = ("licen", "permission", "warranty", "copyright", "reserved", "domain", "redistribut", "software", "cc0")
END = r"(?<![.!?;:])(?:[!?;:]|(?<!\bv)\.|\.(?![^a-z0-9]+[0-9]))[.!?;:]*+(?:\s+|$)"  # ends a sentence; 'v. 2.0' does not
STOP = "\x01"
PERMISSIVE = ("Apache-2.0", "MIT", "BSD-3-Clause", "BSD-2-Clause", "CC-BY-4.0", "Unlicense", "ISC", "0BSD", "CC0-1.0", "Zlib", "BSL-1.0", "LicenseRef-BSD-style")


TAG_WORDS = "spdx license identifier "


def _one_tag() -> str:
    return "|".join(sorted((re.sub("[^a-z0-9]+", " ", n.lower()) for n in TAGGED), key=len, reverse=True))


def _tag_pattern() -> str:
    """A tag with several identifiers that `or` or `and` joins, or with an exception."""
    return f"{TAG_WORDS}(?:{_one_tag()})(?: (?:or|and) (?:{_one_tag()})| with [a-z0-9 ]{{1,60}}? exception(?: [0-9 ]+)?)+"


def _words(sentence: str, name: str) -> str:
    """A pattern for a sentence with places for names, whose words stand on one line or several; a name may end in a full stop."""
    parts = [p.replace(" ", r"[ \n]") for p in sentence.split(" {} ")]
    return rf"[ \n\x01]{name}[ \n\x01]".join(parts).replace("{}", name)


def license_scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    sentences: dict[int, str] | None = None,
    rules: list[tuple[str, tuple[int, ...]]] | None = None,
) -> DataFrame:
    """One row per document: doc_id, sentence_ids, licenses, permissive.

    Sentences end after . ! ? ; : before white space. A known sentence counts where it fills whole lines, one or several wrapped
    ones, between sentence ends, line ends and blank lines; it becomes its identifiers, the longest first, and what lies between
    drops out. Some sentences have a place for a holder's name, and a clause about endorsement that is not known word by word still
    counts as one, so that no notice with such a clause passes for one without. A tag that names an identifier is one sentence
    with it; tags with several, joined by `or` or `and`, name all of them, and all must be permissive. Comment marks at the ends of lines do not matter. Rules are tried in order on what is left of the identifier sequence: a rule whose
    identifiers stand there side by side adds its licence and takes all such places. `licenses` has distinct names in rule
    order; `permissive` is true if there are some and all are permissive. All of it is one projection of the scan.

    Null, empty and sentence-free texts have no identifiers. Repeated rows each get a row; empty tables stay empty.
    """
    known = SENTENCES if sentences is None else sentences
    ordered = RULES if rules is None else rules
    spelled = {s: (k,) for k, s in known.items()} | (PUBLISHED if sentences is None else {})
    table = F.create_map(*[x for s, ids in spelled.items() for x in (F.lit(s), F.array(*map(F.lit, ids)))])
    longest = sorted(spelled, key=len, reverse=True)
    exact = "|".join(r"[ \n]".join(map(re.escape, s.split(" "))) for s in longest)
    named = {k: _words(v, NAME) for k, v in SLOTS.items()}
    other = {k: _words(v, CLAUSE) for k, v in SLOTS_ENDORSE.items()}
    free = f"{_tag_pattern()}|" + "|".join(named.values()) + "|" if sentences is None else ""
    low = F.replace(F.lower("text"), F.lit(TAG), F.lit(TAG[:-1] + " "))
    plain = F.regexp_replace(F.translate(low, STOP, " "), END, STOP)
    plain = F.regexp_replace(F.concat(F.lit(STOP), plain, F.lit(STOP)), rf"[^a-z0-9\n{STOP}]+", " ")
    plain = F.regexp_replace(plain, rf" ?([\n{STOP}]) ?", "$1")

    def found(pattern: str) -> Column:
        return F.regexp_extract_all(plain, F.lit(rf"(?<=[\n{STOP}])(?:{pattern})(?=[\n{STOP}])"), F.lit(0))

    def identifiers(s: Column) -> Column:
        exactly = table[F.translate(s, "\n", " ")]
        if sentences is not None:
            return exactly
        tags = F.create_map(*[x for i, n in enumerate(TAGGED) for x in (F.lit(re.sub("[^a-z0-9]+", " ", n.lower())), F.lit(101 + i))])
        names = F.regexp_extract_all(s, F.lit(rf"\b(?:{_one_tag()})\b"), F.lit(0))
        several = F.when(F.startswith(s, F.lit(TAG_WORDS)), F.transform(names, lambda n: tags[n]))
        for k, v in (named | other).items():
            several = several.when(F.rlike(s, F.lit(f"^(?:{v})$")), F.array(F.lit(k)))
        return F.coalesce(exactly, several)

    where = found(free + exact)
    if sentences is None:  # few texts have such a clause, and its pattern looks far
        where = F.when(F.contains(low, F.lit(ENDORSE)), found(free + exact + "|" + "|".join(other.values()))).otherwise(where)
    ids = F.flatten(F.transform(where, identifiers))
    if sentences is None:  # most texts hold no word that a known sentence must have
        may = reduce(or_, [F.contains(F.lower("text"), F.lit(m)) for m in MARKS])
        ids = F.when(may, ids).otherwise(F.array().cast("array<int>"))
    out = id_and_text(docs, id_col, text_col).select("doc_id", ids.alias("sentence_ids"))
    rest = F.concat_ws("", F.transform("sentence_ids", lambda i: F.concat(F.lit("<"), i.cast("string"), F.lit(">"))))
    out = out.withColumns({"rest": rest, "hits": F.array().cast("array<string>")})
    for name, sequence in ordered:
        word = F.lit("".join(f"<{i}>" for i in sequence))
        out = out.select(
            "doc_id",
            "sentence_ids",
            F.when(F.contains("rest", word), F.concat("hits", F.array(F.lit(name)))).otherwise(F.col("hits")).alias("hits"),
            F.replace("rest", word, F.lit("|")).alias("rest"),
        )
    licenses = F.array_distinct("hits")
    allowed = F.array(*[F.lit(x) for x in PERMISSIVE])
    permissive = (F.size(licenses) > 0) & (F.size(F.array_except(licenses, allowed)) == 0)
    return out.select("doc_id", "sentence_ids", licenses.alias("licenses"), permissive.alias("permissive"))
