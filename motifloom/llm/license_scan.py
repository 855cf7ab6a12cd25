"""License scans: normalised text against licence templates by Dice coefficient over word bigrams.

A text is compared as a whole, by paragraphs (parted by blank lines, whatever white space they hold), by lines and by
runs of paragraphs. A run begins at each paragraph that has ``threshold / 2`` of its bigrams in the head of a template (a
worse first paragraph only lowers a coefficient, and a licence that lacks its first third is below 0.8) and is taken to
the paragraph ends just below and just above that template's size. A licence that no line, paragraph or whole text
matches but a run counts as one match. A notice of fewer than ``WINDOW_WORDS`` words is also looked for inside the text:
where its first three words stand, as many words as it has are a window, across ends of lines as well, which is compared
with templates of that size only; windows count as runs do. Each of these units is normalised
(lower case; words are runs of letters and digits) and taken as the bag of its word bigrams: the coefficient is twice the
common bigrams over the bigrams of both. A coefficient of t needs sizes within a factor of (2 - t) / t of each other. A
unit's size is its number of words less one (the bounds leave room for rounding, the coefficient decides), so units outside the bounds of all templates are dropped before a bigram
is built, and a bigram meets only templates whose bounds hold its unit's size. A unit that reaches t has a share of
t / (2 - t) of its bigrams in templates, so units below that share are dropped before their bigrams become rows.

Templates are one-line notices, SPDX identifier lines, notices of several sentences and whole licences (files in ``licenses``). AGPL-3.0,
CC-BY-4.0 and CC-BY-NC-4.0 were made from the texts of GPL-3.0 and CC-BY-SA-4.0 by the known differences.

DataFrame functions only. The templates' bigrams are a small table (its size is checked) that is broadcast; what is
shuffled are matching bigrams alone, counted in each task first. Words are split once, for lines and whole texts alike.

Null and empty texts match nothing. Ties go to the larger template, then to the one named first. Rows that share a
doc_id share one result; a null doc_id is one like others. Texts of any length are scanned as wholes, inside the JVM and
in the task that reads them. An empty table gives an empty table. Other columns of docs are not read, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

THRESHOLD = 0.8
MAX_TEMPLATE_BIGRAMS = 100_000

#: Whole licences, a file each, named by SPDX identifier.
WHOLE = tuple((p.name.removesuffix(".txt"), p.read_text("ascii")) for p in sorted((Path(__file__).parent / "licenses").glob("*.txt")))
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details."
)

#: Fixed texts: notices and licence texts by SPDX identifier; several texts may share one.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    (
        "BSD-3-Clause",
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    ),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    (
        "ISC",
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("GPL-2.0", _GNU.format("General Public License", "2")),
    ("AGPL-3.0", _GNU.format("Affero General Public License", "3")),
    ("LGPL-2.1", _GNU.format("Lesser General Public License", "2.1")),
    ("LGPL-3.0", _GNU.format("Lesser General Public License", "3")),
    *WHOLE,
)


def _identifiers(names: Iterable[str]) -> Iterable[tuple[str, str]]:
    """The SPDX lines of licences; those of the GNU ones may say which versions."""
    for name in sorted(set(names)):
        for end in ("", "-only", "-or-later") if "GPL-" in name else ("",):
            yield name, f"SPDX-License-Identifier: {name}{end}"


TEMPLATES += tuple(_identifiers(name for name, _ in TEMPLATES))
#: Templates of fewer words are looked for inside longer lines.
WINDOW_WORDS = 50

_SEPARATORS = r"[^\p{L}\p{N}]+"
_BLANK_LINES = r"\n(?:[ \t\r\f\x0B]*\n)+"
#: A run of paragraphs begins in this part of a template.
HEAD = 0.4
_PAIRS = "zip_with(slice({0}, 1, size({0}) - 1), slice({0}, 2, size({0}) - 1), (a, b) -> concat(a, ' ', b))"


def template_bigrams(text: str) -> Counter[str]:
    """The word bigrams of a template (ASCII text) and how often each occurs."""
    words = _template_words(text)
    return Counter(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))


def template_table(templates: tuple[tuple[str, str], ...] = TEMPLATES) -> list[tuple[str, int, int, str, int]]:
    """Rows of license, template (its number), template_size, bigram and how often the template has it."""
    rows = [(name, i, own.total(), b, n) for i, (name, text) in enumerate(templates) for own in (template_bigrams(text),) for b, n in sorted(own.items())]
    if not rows:
        raise ValueError("no template has a bigram")
    if len(rows) > MAX_TEMPLATE_BIGRAMS:
        raise ValueError(f"more than {MAX_TEMPLATE_BIGRAMS} template bigrams to broadcast")
    return rows


def _words(unit: Column) -> Column:
    return F.array_remove(F.split(unit, _SEPARATORS), "")


def units(text: str, least: float, most: float) -> Column:
    """Words of lines, of paragraphs where there are several, and of the whole where it has several lines; array<array<string>>.

    Units with fewer bigrams than least or more than most become empty.
    """
    whole = F.lower(F.coalesce(F.col(text), F.lit("")))
    none = F.array().cast("array<array<string>>")
    lines = F.transform(F.split(whole, "\n"), _words)
    parts = F.split(whole, _BLANK_LINES)
    paragraphs = F.when(F.size(parts) > 1, F.transform(parts, _words)).otherwise(none)

    def with_whole(found: Column) -> Column:
        total = F.aggregate(found, F.lit(0), lambda n, x: n + F.size(x))
        joined = F.when((F.size(found) > 1) & (total - 1 <= most), F.array(F.flatten(found))).otherwise(none)
        return F.concat(found, joined)

    # a one-element transform holds the lines, so that both uses read the same words
    both = F.flatten(F.transform(F.array(lines), with_whole))
    return F.transform(F.concat(both, paragraphs), lambda u: F.when((F.size(u) - 1 >= least) & (F.size(u) - 1 <= most), u).otherwise(F.array().cast("array<string>")))


def _bounds(threshold: float) -> tuple[float, float]:
    """The least and largest size of a unit, as shares of a template's, with room for rounding."""
    return threshold / (2 - threshold) - 1e-9, (2 - threshold) / threshold + 1e-9


def _byte(table: bytearray, at: str) -> str:
    """SQL: the byte (0 to 127, so that it is a character) at a place of a table, which is one literal."""
    return f"ascii(string(substring(X'{table.hex()}', int({at}) + 1, 1)))"


def _among(unit: str, known: Iterable[str], share: float) -> str:
    """SQL: the unit has that share of its bigrams among the known ones, or of such that collide with them in a bitmap."""
    known = set(known)
    slots = 1 << (8 * len(known)).bit_length()
    held = bytearray(slots // 7 + 1)
    for bigram in known:
        slot = zlib.crc32(bigram.encode()) % slots
        held[slot // 7] |= 1 << slot % 7
    found = f"bit_get({_byte(held, f'crc32(x) % {slots} div 7')}, int(crc32(x) % {slots} % 7)) = 1"
    # one bigram of slack keeps rounding out of the comparison
    return f"(size({unit}) > 1 and size(filter({_PAIRS.format(unit)}, x -> {found})) + 1 >= {share!r}D * (size({unit}) - 1))"


def _likely(column: str, known: Iterable[str], share: float) -> str:
    """SQL: the units with those emptied that have less than the share of their bigrams among the known ones."""
    return f"transform({column}, u -> case when {_among('u', known, share)} then u else cast(array() as array<string>) end)"


def _template_words(text: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", text.lower()) if w]


def _head_sizes(unit: str, templates: tuple[tuple[str, str], ...], share: float) -> str:
    """SQL: the sizes (in words) of the templates whose heads have that share of the unit's bigrams. A bigram is looked up once, for the set of sizes."""
    sizes: dict[str, set[int]] = {}
    for _, t in templates:
        if len(words := _template_words(t)) > 1:
            for bigram in template_bigrams(" ".join(words[: int(HEAD * len(words)) + 2])):
                sizes.setdefault(bigram, set()).add(len(words))
    slots = 1 << (2 * len(sizes)).bit_length()
    held: dict[int, frozenset[int]] = {}
    for bigram, own in sizes.items():
        slot = zlib.crc32(bigram.encode()) % slots
        held[slot] = held.get(slot, frozenset()) | own
    sets = {kinds: i for i, kinds in enumerate(sorted(set(held.values()), key=sorted), 1)}
    high, low = bytearray(slots), bytearray(slots)
    for slot, kinds in held.items():
        high[slot], low[slot] = divmod(sets[kinds], 128)
    members = f"split('|{'|'.join(','.join(map(str, sorted(k))) for k in sets)}', '[|]')"
    codes = f"filter(transform({_PAIRS.format(unit)}, x -> {_byte(high, f'crc32(x) % {slots}')} * 128 + {_byte(low, f'crc32(x) % {slots}')}), c -> c > 0)"
    met = f"flatten(transform({codes}, c -> cast(split({members}[c], ',') as array<int>)))"
    every = f"array({', '.join(map(str, sorted(set().union(*sets))))})"
    return f"flatten(transform(array({met}), met -> filter({every}, n -> size(filter(met, y -> y = n)) + 1 >= {share!r}D * (size({unit}) - 1))))"


def _windows(text: str, templates: tuple[tuple[str, str], ...]) -> Column:
    """The words of the windows that begin like short templates; array<array<string>>."""
    short = [w for w in (_template_words(t) for _, t in templates) if 3 < len(w) < WINDOW_WORDS]
    none = F.array().cast("array<array<string>>")
    if not short:
        return none
    heads = sorted({tuple(w[:3]) for w in short})
    whole = F.lower(F.coalesce(F.col(text), F.lit("")))
    may = F.lit(False)
    for rare in sorted({max(head, key=len) for head in heads}):
        may = may | whole.contains(rare)
    anchors = "|".join(_SEPARATORS.join(head) for head in heads)
    most = max(map(len, short))
    # a look-ahead, as windows may overlap
    pattern = rf"(?<![\p{{L}}\p{{N}}])(?=((?:{anchors})(?![\p{{L}}\p{{N}}])(?:{_SEPARATORS}[\p{{L}}\p{{N}}]+){{0,{most - 3}}}))"
    found = F.transform(F.regexp_extract_all(whole, F.lit(pattern), F.lit(1)), _words)
    cut = F.flatten(F.transform(found, lambda w: F.array(*(F.slice(w, 1, n) for n in sorted(set(map(len, short)))))))
    return F.when(may, F.array_distinct(cut)).otherwise(none)


def _with_runs(docs: DataFrame, text: str, templates: tuple[tuple[str, str], ...], known: Iterable[str], threshold: float) -> DataFrame:
    """Adds _runs: the words of runs of two paragraphs or more (not the whole) that may match a template; and _windows."""
    low, high = _bounds(threshold)
    parts = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), _BLANK_LINES)
    several = F.when(F.size(parts) > 2, F.transform(parts, _words)).otherwise(F.array().cast("array<array<string>>"))
    d = docs.withColumn("_parts", F.filter(several, lambda p: F.size(p) > 0))
    # _at: the paragraph of each word; _starts: the first word of each paragraph, and the end
    d = d.withColumn("_all", F.flatten("_parts")).withColumn("_at", F.flatten(F.transform("_parts", lambda p, i: F.array_repeat(i, F.size(p)))))
    d = d.withColumn("_starts", F.expr("case when size(_all) > 0 then filter(sequence(0, size(_all)), k -> k = 0 or k = size(_all) or _at[k] <> _at[k - 1]) else cast(array() as array<int>) end"))
    sizes = _head_sizes("p", templates, threshold / 2)
    d = d.withColumn("_wanted", F.expr(f"transform(_parts, p -> case when {_among('p', known, threshold / 2)} then {sizes} else cast(array() as array<int>) end)"))
    end = "_starts[_at[least(_starts[i] + n, size(_all)) - 1] + {0}]"
    one = "named_struct('s', _starts[i], 'e', {0}, 'n', n)"
    runs = f"flatten(transform(_wanted, (w, i) -> flatten(transform(w, n -> array({one.format(end.format(0))}, {one.format(end.format(1))})))))"
    d = d.withColumn("_spans", F.expr(f"""array_distinct(transform(filter({runs}, (r, k) -> r.e - r.s - 1 between {low!r}D * (r.n - 1) and {high!r}D * (r.n - 1)
        and _at[r.e - 1] > _at[r.s] and r.e - r.s < size(_all)), r -> named_struct('s', r.s, 'e', r.e)))"""))
    runs = F.expr("transform(_spans, r -> slice(_all, r.s + 1, r.e - r.s))")
    return d.withColumn("_runs", runs).withColumn("_windows", _windows(text, templates))


def matches(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Units that reach the threshold: doc_id, unit (number), run (of paragraphs, or a window), size, license, template, template_size, dice."""
    spark: SparkSession = docs.sparkSession
    table = template_table(templates)
    low, high = _bounds(threshold)
    sizes = [row[2] for row in table]
    known = F.broadcast(spark.createDataFrame(table, "license string, template int, template_size int, known string, times long"))
    bigrams = {row[3] for row in table}
    u = docs.select(F.col(doc_id).alias("_id"), F.monotonically_increasing_id().alias("_row"), F.col(text).alias("_text"))
    u = _with_runs(u, "_text", templates, bigrams, threshold).select("_id", "_row", units("_text", low * min(sizes), high * max(sizes)).alias("_units"), "_runs", "_windows")
    u = u.select("_id", "_row", F.size("_units").alias("_plain"), (F.size("_units") + F.size("_runs")).alias("_cut"), F.concat("_units", "_runs", "_windows").alias("_units"))
    u = u.select("_id", "_row", "_plain", "_cut", F.posexplode(F.expr(_likely("_units", bigrams, low))).alias("unit", "words")).where(F.size("words") > 1)
    u = u.withColumn("run", F.col("unit") >= F.col("_plain")).withColumn("_cut", F.col("unit") >= F.col("_cut"))
    n = F.size("words")
    pairs = F.zip_with(F.slice("words", 1, n - 1), F.slice("words", 2, n - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    own = u.select("_id", "_row", "unit", "run", "_cut", (n - 1).alias("size"), F.explode(pairs).alias("bigram"))
    fits = (F.col("size") >= low * F.col("template_size")) & (F.col("size") <= high * F.col("template_size")) & (~F.col("_cut") | (F.col("size") == F.col("template_size")))
    unit = ("_id", "_row", "unit", "run", "size", "license", "template", "template_size")
    hits = own.join(known, (F.col("bigram") == F.col("known")) & fits).groupBy(*unit, "bigram", "times").agg(F.count("*").alias("n"))
    common = hits.groupBy(*unit).agg(F.sum(F.least("n", "times")).alias("common"))
    dice = 2 * F.col("common") / (F.col("size") + F.col("template_size"))
    reached = 2 * F.col("common") >= F.lit(threshold) * (F.col("size") + F.col("template_size"))
    return common.where(reached).select(F.col("_id").alias(doc_id), "unit", "run", "size", "license", "template", "template_size", dice.alias("dice"))


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row of docs: doc_id, license (null if none), dice (0 if none), n_matches (units that match; of a licence's runs and windows one, if nothing else of the text matches it)."""
    best = F.max(F.struct("dice", "template_size", F.expr("-template").alias("t"), "license")).alias("best")
    found = matches(docs, templates, threshold, text, doc_id).groupBy(F.col(doc_id).alias("_found")).agg(best, F.countDistinct(F.when(~F.col("run"), F.col("unit"))).alias("plain"), F.collect_set("license").alias("all"), F.collect_set(F.when(~F.col("run"), F.col("license"))).alias("seen"))
    found = found.select("_found", "best", (F.col("plain") + F.size(F.array_except("all", "seen"))).alias("n"))
    rows = docs.select(doc_id).join(found, F.col(doc_id).eqNullSafe(F.col("_found")), "left")
    return rows.select(doc_id, F.col("best.license").alias("license"), F.coalesce("best.dice", F.lit(0.0)).alias("dice"), F.coalesce("n", F.lit(0)).cast("long").alias("n_matches"))


def oracle(templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The scan as one DuckDB statement over documents; without runs of paragraphs and windows; paragraphs it parts at empty lines only."""
    values = ", ".join("('{}', {}, {}, '{}', {})".format(*row) for row in template_table(templates))
    low, high = _bounds(threshold)
    words = "list_filter(regexp_split_to_array(x, '[^\\p{L}\\p{N}]+'), lambda y: y <> '')"
    return f"""
        with t(license, template, template_size, bigram, times) as (values {values}),
        l as (select doc_id, string_split(lower(coalesce(text, '')), chr(10)) as lines, string_split(lower(coalesce(text, '')), chr(10) || chr(10)) as paragraphs, lower(coalesce(text, '')) as whole from documents),
        u as (select doc_id, lines || (case when len(lines) > 1 then [whole] else [] end) || (case when len(paragraphs) > 1 then paragraphs else [] end) as raws from l),
        e as (select doc_id, unnest(range(len(raws))) as unit, unnest(raws) as x from u),
        w as (select doc_id, unit, {words} as words from e),
        b as (select doc_id, unit, len(words) - 1 as size, unnest([words[i] || ' ' || words[i + 1] for i in range(1, len(words))]) as bigram from w where len(words) > 1),
        h as (select doc_id, unit, size, license, template, template_size, bigram, times, count(*) as n from b join t using (bigram)
              where size >= {low!r}::double * template_size and size <= {high!r}::double * template_size group by all),
        c as (select doc_id, unit, size, license, template, template_size, sum(least(n, times)) as common from h group by all),
        m as (select *, (2 * common)::double / (size + template_size) as dice from c where 2 * common >= {threshold!r}::double * (size + template_size)),
        r as (select *, row_number() over (partition by doc_id order by dice desc, template_size desc, template) as k from m),
        n as (select doc_id, count(distinct unit) as n from m group by 1)
        select d.doc_id, r.license, coalesce(r.dice, 0.0::double) as dice, coalesce(n.n, 0) as n_matches
        from documents d left join r on r.doc_id = d.doc_id and r.k = 1 left join n on n.doc_id = d.doc_id
    """
