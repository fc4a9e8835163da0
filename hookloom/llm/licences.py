"""Licence scans: parts of a text against licence templates by the Dice coefficient.

The parts of a text are the whole of it, its paragraphs (between empty lines), its
lines, and windows of running text. Each is normalised to lower-case letters and digits between single spaces and becomes
the set of its word bigrams. A part of n bigrams can reach the Dice coefficient t with a
template of m only if ``m t / (2 - t) <= n <= m (2 - t) / t``; an equi-join on n with the
sizes that each template allows finds the candidate templates, and only for these the common
bigrams are counted. DataFrame functions only.

Windows are as many words as the template has and start at one of its bigrams. As many of a template's
bigrams as the lower bound says must occur in a text, so texts with fewer have no windows looked at; nearly all do.
So many bigrams can not do without some words of the template (`needed_words`): a text with none of them is not even
cut into bigrams.
A text that spreads a licence over paragraphs, or sets it into a longer one, is thus found.

Defined cases: null and empty texts and parts of fewer than two words match nothing. A text
that repeats a part counts it once. Repeated rows get equal results.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hookloom.llm.common import broadcast_if_small, let, lower_ascii, positions, whole_text
from hookloom.session import stage_table

THRESHOLD = 0.8

# Wordings of licences and of the usual notices that name them.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."
    ),
    "mit-notice": "Released under the MIT License.",
    "mit-notice-licensed": "Licensed under the MIT License.",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF "
        "ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR "
        "A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE "
        "FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING "
        "FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE "
        "FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS "
        "OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING "
        "OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
        "(at your option) any later version. This program is distributed in the hope that it will be useful, but "
        "WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU General Public License for more details."
    ),
    "mpl-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "cc-by-4.0-sentence": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License."
    ),
    "all-rights-reserved": "All rights reserved. No part of this text may be reproduced without permission.",
}


# Frequent words, which tell little about whether a text holds a template. They decide speed only.
FREQUENT = frozenset(
    "a all an and any as at be but by for from if in is it may no not of on or other out part shall so such text that "
    "the this to under use version was will with without work you 0 1 2 3 4".split()
)


def normalised(text: Column) -> Column:
    """Lower-case words between single spaces; line breaks stay."""
    return F.regexp_replace(lower_ascii(text), r"[^\p{L}\p{M}\p{N}\n]+", " ")


def parts_of(text: Column) -> Column:
    """The distinct parts of a text, as words between single spaces."""

    def parts(plain: Column) -> Column:
        whole = F.array(plain)
        paragraphs = F.split(plain, r"\n ?\n")
        lines = F.split(plain, "\n")
        return F.array_distinct(F.transform(
            F.concat(whole, paragraphs, lines), lambda part: F.trim(F.regexp_replace(part, r"[\n ]+", " "))
        ))

    return let(normalised(whole_text(text)), parts)


def bigram_hashes(part: Column) -> Column:
    """Distinct hashes of a part's word bigrams."""
    return F.array_distinct(let(F.split(part, " "), lambda words: F.transform(
        positions(F.size(words) - 1), lambda at: F.xxhash64(words[at], words[at + 1])
    )))


def plain_template(wording: str) -> str:
    lowered = wording.translate(str.maketrans(ascii_uppercase, ascii_lowercase))
    return " ".join(re.sub(r"[^a-z0-9]+", " ", lowered).split())


def needed_words(wording: str, threshold: float) -> set[str]:
    """Words of a plain template of which a text must hold at least one to reach the threshold.

    Without them fewer of its bigrams are left than the lower bound asks for. One word will do or else
    the longest, frequent ones last.
    """
    words = wording.split()
    left = set(zip(words, words[1:]))
    least = max(1, math.ceil(len(left) * threshold / (2 - threshold) - 1e-9))
    ranked = sorted(set(words), key=lambda word: (word in FREQUENT, -len(word), word))
    single = next((word for word in ranked if sum(word not in pair for pair in left) < least), None)
    if single is not None and single not in FREQUENT:
        return {single}
    needed = set()
    for word in ranked:
        if len(left) < least:
            break
        if any(word in pair for pair in left):
            needed.add(word)
            left = {pair for pair in left if word not in pair}
    return needed


def holds_any(text: Column, words: set[str]) -> Column:
    """Whether a text may hold one of some words of ASCII letters and digits, in any case."""
    if not words:
        return F.lit(False)
    initials = "".join(sorted({word[0] for word in words}))
    pattern = rf"(?<![a-z0-9])(?=[{initials}])(?:{'|'.join(sorted(words))})(?![a-z0-9])"
    return F.lower(whole_text(text)).rlike(pattern)


def window_matches(text: Column, templates: list[tuple[str, list[int], int]], threshold: float) -> Column:
    """Licences that a window of running text may match, each with the largest coefficient of its windows.

    ``templates`` are names, bigram hashes and word counts; they are literals of the expression.
    """
    ratio = threshold / (2 - threshold)
    known = F.lit(sorted({gram for _, grams, _ in templates for gram in grams}))
    wanted = F.array(*(
        F.struct(F.lit(name).alias("licence"), F.lit(grams).alias("grams"), F.lit(words - 1).alias("length"),
                 F.lit(max(1, math.ceil(len(grams) * ratio - 1e-9))).alias("least"))
        for name, grams, words in templates
    ))

    def running(plain: Column) -> Column:
        words = F.split(F.trim(F.regexp_replace(plain, r"[\n ]+", " ")), " ")
        return let(words, lambda each: F.transform(
            positions(F.size(each) - 1), lambda at: F.xxhash64(each[at], each[at + 1])
        ))

    def best(grams: Column, template: Column) -> Column:
        starts = F.filter(positions(F.size(grams)), lambda at: F.array_contains(template["grams"], grams[at]))
        return F.array_max(F.transform(starts, lambda at: let(
            F.array_distinct(F.slice(grams, at + 1, template["length"])),
            lambda own: 2 * F.size(F.array_intersect(own, template["grams"])) / (F.size(own) + F.size(template["grams"])),
        )))

    def matches(grams: Column) -> Column:
        return let(F.array_intersect(grams, known), lambda hits: F.transform(
            F.filter(wanted, lambda one: F.size(F.array_intersect(hits, one["grams"])) >= one["least"]),
            lambda one: F.struct(one["licence"].alias("licence"), best(grams, one).alias("dice")),
        ))

    return let(normalised(whole_text(text)), lambda plain: let(running(plain), matches))


def template_sizes(docs: DataFrame, templates: Mapping[str, str], threshold: float) -> DataFrame:
    """A row per template and part size within its bounds: ``n``, ``licence``, ``grams`` and ``m``."""
    table = docs.sparkSession.createDataFrame(
        [(name, plain_template(wording)) for name, wording in templates.items()], "licence string, wording string"
    )
    ratio = threshold / (2 - threshold)
    return table.select("licence", bigram_hashes(F.col("wording")).alias("grams")) \
        .withColumn("m", F.size("grams")) \
        .withColumn("n", F.explode(F.sequence(
            F.ceil(F.col("m") * ratio - 1e-9).cast("int"), F.floor(F.col("m") / ratio + 1e-9).cast("int")
        )))


def find_licences(
    docs: DataFrame, carry: list[str], templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD,
    text: str = "text", doc_id: str = "doc_id",
) -> DataFrame:
    """One row per document: ``row`` (the carried columns), ``id`` and ``found``, its licences by name,
    each with the largest coefficient any part reaches.
    """
    sizes = stage_table(template_sizes(docs, templates, threshold), "licence-sizes")
    longest = max(len(plain_template(wording).split()) for wording in templates.values())
    # A part has at least as many words as bigrams, so this bound only drops what cannot match.
    shortest = min(len(set(zip(words, words[1:]))) for words in (plain_template(w).split() for w in templates.values()))
    ratio = threshold / (2 - threshold)
    keyed = docs.select(F.col(f"`{doc_id}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("tk"),
                        F.explode(parts_of(F.col(f"`{text}`"))).alias("part"))
    spaces = F.length("part") - F.length(F.translate("part", " ", ""))
    keyed = keyed.filter(spaces >= int(shortest * ratio))
    # A part holds at least one bigram less than distinct words, and no more than the longest template allows.
    most = longest / ratio
    keyed = keyed.filter((spaces <= most) | (F.size(F.array_distinct(F.split("part", " "))) <= most + 1))
    grams = keyed.select("id", "tk", bigram_hashes(F.col("part")).alias("own")).withColumn("n", F.size("own"))
    common = F.size(F.array_intersect("own", "grams"))
    matches = grams.join(broadcast_if_small(sizes), "n").select(
        "id", "tk", "licence", (2 * common / (F.col("n") + F.col("m"))).alias("dice")
    ).filter(F.col("dice") >= threshold)
    wordings = [
        (row["licence"], row["grams"], len(plain_template(templates[row["licence"]]).split()))
        for row in sizes.select("licence", "grams").distinct().orderBy("licence").collect()  # a row per template
    ]
    needed = {word for wording in templates.values() for word in needed_words(plain_template(wording), threshold)}
    windows = docs.filter(holds_any(F.col(f"`{text}`"), needed)).select(
        F.col(f"`{doc_id}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("tk"),
        F.inline(window_matches(F.col(f"`{text}`"), wordings, threshold)),
    ).filter(F.col("dice") >= threshold)
    matches = matches.unionByName(windows)
    best = matches.groupBy("id", "tk", "licence").agg(F.max("dice").alias("dice"))
    found = best.groupBy("id", "tk").agg(
        F.array_sort(F.collect_list(F.struct("licence", "dice"))).alias("found")
    ).withColumnsRenamed({"id": "s_id", "tk": "s_tk"})
    found = broadcast_if_small(stage_table(found, "licence-found"))
    rows = docs.select(
        F.struct(*(F.col(f"`{name}`") for name in carry)).alias("row"),
        F.col(f"`{doc_id}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("tk"),
    )
    return rows.join(
        found, F.col("id").eqNullSafe(F.col("s_id")) & (F.col("tk") == F.col("s_tk")), "left"
    ).select("row", "id", F.coalesce("found", F.array().cast("array<struct<licence:string,dice:double>>")).alias("found"))


def licence_report(docs: DataFrame) -> DataFrame:
    """The licences of every document, by name, and the best coefficient."""
    found = find_licences(docs, ["doc_id"])
    return found.select(
        F.col("id").alias("doc_id"), F.size("found").cast("long").alias("n_licences"),
        F.array_join("found.licence", ",").alias("licences"), F.round(F.array_max("found.dice"), 6).alias("best_dice"),
    )


_SQL_TEMPLATES = ",\n    ".join(f"('{name}', '{plain_template(wording)}')" for name, wording in TEMPLATES.items())

OP9_SQL = rf"""
WITH templates(licence, wording) AS (VALUES
    {_SQL_TEMPLATES}
),
plain AS (
    SELECT doc_id, md5(coalesce(text, '')) AS tk, regexp_replace(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\p{{L}}\p{{M}}\p{{N}}\n]+', ' ', 'g') AS body
    FROM documents
),
parts AS (
    SELECT DISTINCT doc_id, tk, trim(regexp_replace(part, '[\n ]+', ' ', 'g')) AS part FROM (
        SELECT doc_id, tk, unnest(list_concat([body], regexp_split_to_array(body, '\n ?\n'),
            string_split(body, chr(10)))) AS part FROM plain
    )
),
grams AS (
    SELECT doc_id, tk, list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS own
    FROM (SELECT doc_id, tk, string_split(part, ' ') AS words FROM parts)
    WHERE len(words) > 1
),
wanted AS (
    SELECT licence, list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS grams
    FROM (SELECT licence, string_split(wording, ' ') AS words FROM templates)
),
scored AS (
    SELECT doc_id, tk, licence, 2.0 * len(list_intersect(own, grams)) / (len(own) + len(grams)) AS dice
    FROM grams, wanted WHERE len(own) BETWEEN len(grams) / 2 AND len(grams) * 2
),
running AS (
    SELECT DISTINCT doc_id, tk, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) AS own
    FROM (SELECT doc_id, tk, string_split(trim(regexp_replace(body, '[\n ]+', ' ', 'g')), ' ') AS words FROM plain)
),
sized AS (
    SELECT w.*, len(string_split(t.wording, ' ')) AS words FROM wanted w JOIN templates t USING (licence)
),
starts AS (
    SELECT doc_id, tk, licence, own, grams, words, unnest(list_filter(range(1, len(own) + 1), lambda i: list_contains(grams, own[i]))) AS pos
    FROM running, sized WHERE len(list_intersect(own, grams)) >= len(grams) * {THRESHOLD} / (2 - {THRESHOLD}) - 1e-9
),
windows AS (
    SELECT doc_id, tk, licence, 2.0 * len(list_intersect(part, grams)) / (len(part) + len(grams)) AS dice
    FROM (SELECT doc_id, tk, licence, grams, list_distinct(own[pos:pos + words - 2]) AS part FROM starts)
),
best AS (
    SELECT doc_id, tk, licence, max(dice) AS dice FROM (
        SELECT doc_id, tk, licence, dice FROM scored UNION ALL SELECT doc_id, tk, licence, dice FROM windows)
    WHERE dice >= {THRESHOLD} GROUP BY doc_id, tk, licence
),
found AS (
    SELECT doc_id, tk, count(*) AS n_licences, string_agg(licence, ',' ORDER BY licence) AS licences, max(dice) AS dice
    FROM best GROUP BY doc_id, tk
)
SELECT p.doc_id, coalesce(f.n_licences, 0) AS n_licences, coalesce(f.licences, '') AS licences, round(f.dice, 6) AS best_dice
FROM plain p LEFT JOIN found f ON p.doc_id = f.doc_id AND p.tk = f.tk
"""
