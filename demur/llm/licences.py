"""Licence scan: whole texts, and their single lines, looked up by the digest of a canonical form.

The canonical form lower-cases, drops lines of a copyright notice, turns everything but letters and digits into single spaces
and replaces equivalent spellings. Two texts that differ in layout, quotes, case or holder names alone have one digest.
Known licences are a small fixed table; its digests are computed by the same expression and joined.

Rows: a null or empty text, and one without letters or digits, matches nothing; every document gives one row; repeated
documents give repeated rows; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Spellings that mean the same, after lower-casing and spacing; each is a whole word or words.
SPELLINGS = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "sub license": "sublicense", "sub licence": "sublicense",
    "non commercial": "noncommercial", "organisation": "organization", "favour": "favor", "merchantibility": "merchantability",
    "copyright holder": "copyright owner", "copyright holders": "copyright owners", "https": "http", "gnu gpl": "gnu general public license",
    "v 2": "version 2", "v2": "version 2", "v3": "version 3", "per cent": "percent", "whilst": "while",
}

# Licences by SPDX name with the notices or whole texts that stand for them.
NOTICES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT", """
        Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
        publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
        subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
        substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT
        NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
        COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
        OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Released under the Apache License, Version 2.0.",
                   "SPDX-License-Identifier: Apache-2.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License v3.",
                "SPDX-License-Identifier: GPL-3.0-only"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under CC BY-SA 4.0."],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "ISC": ["Released under the ISC License.", "SPDX-License-Identifier: ISC", """
        Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
        the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL
        WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE
        LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
        WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
        SOFTWARE."""],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}

#: A line that names a holder: "copyright", "(c)" or the sign, then a year somewhere in the line.
COPYRIGHT_LINE = r"(?m)^[ \t#*/;-]*(?:[Cc]opyright|COPYRIGHT|\([cC]\)|©)[^\n]*[0-9]{4}[^\n]*$"
NOT_WORD, NOT_WORD_IN_LINE = r"[^\p{L}\p{N}]+", r"[^\p{L}\p{N}\n]+"


def _words(text: Column, not_word: str) -> Column:
    """Lower-case words without holder lines; two spaces between words, so that neighbours can both be replaced."""
    return F.regexp_replace(F.lower(F.regexp_replace(text, COPYRIGHT_LINE, " ")), not_word, "  ")


def _spelled(body: Column) -> Column:
    body = F.concat(F.lit(" "), body, F.lit(" "))
    for other, usual in SPELLINGS.items():
        body = F.replace(body, F.lit(spaced(other)), F.lit(spaced(usual)))
    return body


def spaced(words: str) -> str:
    return f" {words.replace(' ', '  ')} "


def canonical(text: Column) -> Column:
    return F.trim(_spelled(_words(text, NOT_WORD)))


def canonical_lines(text: Column) -> Column:
    """Canonical forms of the lines, made for the whole text at once."""
    return F.transform(F.split(_spelled(F.replace(_words(text, NOT_WORD_IN_LINE), F.lit("\n"), F.lit(" \n "))), "\n"), lambda line: F.trim(line))


def digest(form: Column) -> Column:
    """Digest of a canonical form; null where nothing is left."""
    return F.when(form != "", F.sha2(form.cast("binary"), 256))


def known_licences(spark: SparkSession, notices: dict[str, list[str]] = NOTICES) -> DataFrame:
    """digest, spdx, and a short key of the form; as many rows as the fixed table has texts."""
    rows = [(spdx, text) for spdx, texts in notices.items() for text in texts]
    table = spark.createDataFrame(rows, "spdx string, notice string").select("spdx", canonical(F.col("notice")).alias("form"))
    return table.groupBy(digest(F.col("form")).alias("digest"), F.xxhash64("form").alias("key")).agg(F.min("spdx").alias("spdx"))


def scan_licences(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Per document: the licence its whole text is, and the licences that single lines of it state, sorted.

    The fixed table is broadcast; a table ``known`` (digest, spdx, key) of the caller is joined as Spark finds best for its size. Lines are met by
    the short key first, so that only lines with a licence's key are digested.
    """
    small = F.broadcast(known_licences(docs.sparkSession)) if known is None else known
    whole = docs.select("doc_id", digest(canonical(F.col("text"))).alias("digest"))
    forms = docs.select("doc_id", F.explode(canonical_lines(F.col("text"))).alias("form")).where(F.col("form") != "")
    lines = (forms.select("doc_id", "form", F.xxhash64("form").alias("key")).join(small, "key").where(digest(F.col("form")) == F.col("digest"))
             .groupBy("doc_id").agg(F.sort_array(F.collect_set("spdx")).alias("line_licences"), F.count(F.lit(1)).alias("n_lines")))
    found = whole.join(small.select("digest", F.col("spdx").alias("text_licence")), "digest", "left")
    return found.join(lines, "doc_id", "left").select(
        "doc_id", "digest", "text_licence", F.coalesce(F.array_join("line_licences", ","), F.lit("")).alias("line_licences"),
        F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_licence_lines"))
