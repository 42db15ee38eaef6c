"""Licence texts found by the digest of their canonical form; DataFrame functions only.

Texts are brought to one spelling: lower case, copyright and rights lines gone, equivalent words alike, everything but
letters and digits one space. Two texts with the same canonical form have the same SHA-256 digest, so whole texts are looked up by
a join of digests. Each line is looked up the same way as a text of its own, which finds notices in longer texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.llm.tables import written

#: Steps in order: marks of which a text holds one if the step may change it, and patterns with replacements. The dialect is
#: common to Java and RE2. `a-z0-9` says nothing that the classes do not; it is their quick way for most characters.
CANONICAL_STEPS = (
    (
        ("copyright", "(c)", "©", "all rights reserved"),
        (
            (r"(?m)^[^\p{L}\p{N}\n]*(copyright|\(c\)|©)[^\n]*$", ""),
            (r"(?m)^[^\p{L}\p{N}\n]*all rights reserved[^\p{L}\p{N}\n]*$", ""),
        ),
    ),
    ((), ((r"[^a-z0-9\p{L}\p{N}]+", " "),)),
    (
        ("licen", "non commercial", "merchantib", "organisation", "favour", "creative commons"),
        (
            (r"(^| )licence", "$1license"),
            (r"(^| )sub license", "$1sublicense"),
            (r"(^| )non commercial", "$1noncommercial"),
            (r"(^| )merchantibility", "$1merchantability"),
            (r"(^| )organisation", "$1organization"),
            (r"(^| )favour", "$1favor"),
            (r"(^| )creative commons ", "$1cc "),
            (r"(^| )gnu general public license", "$1gnu gpl"),
        ),
    ),
    ((), ((r"(^| )(version |ver |v)([0-9])", "$1$3"),)),
)

#: Names that notices give to licences.
NOTICE_NAMES = {
    "MIT": "MIT License",
    "Apache-2.0": "Apache License, Version 2.0",
    "GPL-2.0": "GNU General Public License, version 2",
    "GPL-3.0": "GNU General Public License, version 3",
    "LGPL-3.0": "GNU Lesser General Public License, version 3",
    "AGPL-3.0": "GNU Affero General Public License, version 3",
    "MPL-2.0": "Mozilla Public License, version 2.0",
    "BSD-2-Clause": "BSD 2-Clause License",
    "BSD-3-Clause": "BSD 3-Clause License",
    "ISC": "ISC License",
    "CC0-1.0": "CC0 1.0",
    "CC-BY-4.0": "CC BY 4.0",
    "CC-BY-SA-4.0": "CC BY-SA 4.0",
    "CC-BY-NC-4.0": "CC BY-NC 4.0",
    "CC-BY-ND-4.0": "CC BY-ND 4.0",
    "CC-BY-NC-SA-4.0": "CC BY-NC-SA 4.0",
    "CC-BY-NC-ND-4.0": "CC BY-NC-ND 4.0",
}
NOTICE_FORMS = (
    "Licensed under {the}{name}.",
    "Released under {the}{name}.",
    "Distributed under {the}{name}.",
    "This work is licensed under {the}{name}.",
    "This file is licensed under {the}{name}.",
    "This project is licensed under {the}{name}.",
    "SPDX-License-Identifier: {key}",
)

#: Public licence texts.
LICENSE_TEXTS = {
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR
ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS
ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR
ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS
ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to
do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE
FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION
WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
}


#: Digests of the canonical forms of longer public licence texts, whole and, of those that end in instructions for their
#: use, up to the end of the terms; of the BSD licences with and without their name as a heading.
LICENSE_DIGESTS = (
    ("Apache-2.0", "77a58bfc0cf6615316cf1a166023a128540b85fcb550f7cf34c29bcf859fd45b"),
    ("Apache-2.0", "85090353ee35df63fd83871a1a59a49d291d0bebeaf14811a3860a17c2366119"),
    ("GPL-2.0", "dd7a3dc14bd5b8881a49c09f9333b66fed3805d2d37f8174f36cf39ae7acf3cf"),
    ("GPL-2.0", "0e5fd2e3978efdd0e63168374f9abf1d3941ed5ce6b54da1645625e1456d273e"),
    ("GPL-3.0", "89a33ed2e569902a72e75536a0c1c12a05ffb075264ac505f84811d4f9260b19"),
    ("GPL-3.0", "f7990fe97489ef47294746ac08d67dfa07b313f2de1103d7dd0f00749c9139c4"),
    ("LGPL-3.0", "c15236b1a2318d6cdd819a5f6152950e890090bca8f0fed682a24765bb8b467a"),
    ("MPL-2.0", "becb265374b9355696544094202debbc9caaf03fb1e0c3a5729fef97fa32b9ea"),
    ("CC0-1.0", "bcf1ca6bfc638eb154167518097e0e35e99b24f6b9bb4b2a6cb9b919bfda843a"),
    ("BSD-3-Clause", "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"),
    ("BSD-2-Clause", "a56fee4b2f66331ed54da4950ef9c9391453fd1490b4d8ea202bc29683bcbd30"),
    ("BSD-2-Clause", "447686a56472ea2e9713ca89034ee666e6646bd1a33eba38690cb875708663e2"),
    ("BSD-3-Clause", "9b83d3dee0616d07b82a272dd9bf5134a9f402b750f5ee6188458073b0a32ff2"),
    ("BSD-3-Clause", "cc65957a28f15bbcef5b0c23770aae3bd8462cb25904250f77a812ab3b2efe15"),
)


def _step(marks: tuple[str, ...], rules: tuple[tuple[str, str], ...]):
    def apply(text: Column) -> Column:
        changed = text
        for pattern, replacement in rules:
            changed = F.regexp_replace(changed, F.lit(pattern), F.lit(replacement))
        if not marks:
            return changed
        held = F.lit(False)
        for m in marks:
            held |= F.contains(text, F.lit(m))
        return F.when(held, changed).otherwise(text)

    return apply


def canonical(text: Column) -> Column:
    """The canonical form; a step's patterns run only on texts that hold one of its marks."""
    out = F.lower(text)
    for marks, rules in CANONICAL_STEPS:
        out = F.transform(F.array(out), _step(marks, rules))[0]  # names the text, so that it is made once
    return F.trim(out)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_texts() -> list[tuple[str, str]]:
    """(license_id, text) of the built-in licences and notices; a few hundred short rows whatever the corpus."""
    notices = [
        (key, form.format(name=name, key=key, the=the))
        for key, name in NOTICE_NAMES.items()
        for form in NOTICE_FORMS
        for the in ("the ", "")
    ]
    headed = [(k, f"{NOTICE_NAMES[k]}\n{t}") for k, t in LICENSE_TEXTS.items() if k in NOTICE_NAMES]
    return list(dict.fromkeys([*LICENSE_TEXTS.items(), *headed, *notices]))


def known_digests(spark: SparkSession, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, license_id), one row a digest; of licences with the same canonical text the first in order of name.

    Without `texts`: the built-in ones and `LICENSE_DIGESTS`. Written as a table, so that its size is known where it is joined.
    """
    rows = spark.createDataFrame(known_texts() if texts is None else texts, "license_id string, text string")
    digests = rows.select(digest(F.col("text")).alias("digest"), "license_id")
    if texts is None:
        digests = digests.unionByName(spark.createDataFrame(LICENSE_DIGESTS, "license_id string, digest string"))
    found = digests.groupBy("digest").agg(F.min("license_id").alias("license_id"))
    return written(found.coalesce(1), "license-digests")


def license_scan(docs: DataFrame, known: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, text_digest, license_id of the whole text (null if unknown), notices (sorted licences of its lines).

    A null or empty text has the digest of the empty text; texts or lines without letters and digits match nothing. Rows
    that repeat an id each get the notices of all rows with it; a null id gets none. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    known = known.where(F.col("digest") != F.sha2(F.lit(""), 256)).groupBy("digest").agg(F.min("license_id").alias("license_id"))
    whole = rows.select("id", digest(F.col("text")).alias("text_digest"))
    lines = rows.where("id is not null").select("id", F.explode(F.split("text", "\n")).alias("line"))
    lines = lines.select("id", digest(F.col("line")).alias("digest"))
    notices = lines.join(known, "digest").groupBy("id").agg(F.sort_array(F.collect_set("license_id")).alias("notices"))
    found = whole.join(known.withColumnRenamed("digest", "text_digest"), "text_digest", "left").join(notices, "id", "left")
    none = F.array().cast("array<string>")
    return found.select(F.col("id").alias(id_column), "text_digest", "license_id", F.coalesce("notices", none).alias("notices"))
