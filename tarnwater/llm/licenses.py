"""Licence scans by the Dice coefficient over word bigrams.

A text is lower-cased and cut into runs of letters and digits.  It is compared to
each template in spans of the template's own number of bigrams, shorter ones only
where the text ends: ``2 * common / (span's + template's)``, with common counted as
bags.  Words are all that counts, so a notice may be wrapped over lines, stand amid
other sentences, or be a whole licence in a longer file.

Pruning, all of it exact.  A likeness of ``LEAST`` or more needs sizes within
``(2 - LEAST) / LEAST`` of each other, so a text that is too short for a template is
never compared to it, and needs all but a third of the template's bigrams.  So many
of these touch the template's longest words (:func:`markers`) that a text without
any such word matches nothing and goes no further.  Bigrams of the others meet a
table of the templates' bigrams; a span is compared only if it begins with one of
them and holds as many as the likeness needs.  Of spans of one template that
overlap, a better one hides the others (the earlier one of two equal ones).

The templates' table has a row for each bigram of a template and is broadcast, so it
is bounded by the caller's own list of templates; only bigrams that it holds are
shuffled.

Defined cases: null and empty texts have no match; texts of one word have no bigram
and match nothing; ties between templates give a row each; repeated rows each give
theirs.  Only doc_id and text are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwater.llm.common import read_table

LEAST = 0.8
#: Public notices and licence texts, without names and years.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("bsd-3-clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("mit", "Released under the MIT License."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "apache-2.0-header",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
        See the License for the specific language governing permissions and limitations under the License.""",
    ),
    (
        "gpl-3.0-header",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
        the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
        This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
        MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
        You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    ),
    (
        "mpl-2.0-header",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.
        If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    ),
    (
        "mit-text",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
        publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
        subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE
        FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION
        WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "isc-text",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
        above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY
        DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
        ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "bsd-2-clause-text",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
        LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
        COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
        (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
        HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
        ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    (
        "bsd-3-clause-text",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution.
        3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from
        this software without specific prior written permission.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
        LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
        COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
        (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
        HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
        ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    (
        "zlib-text",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
        arising from the use of this software.
        Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute
        it freely, subject to the following restrictions:
        1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this
        software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
        2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
        3. This notice may not be removed or altered from any source distribution.""",
    ),
    (
        "unlicense-text",
        """This is free and unencumbered software released into the public domain.
        Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled
        binary, for any purpose, commercial or non-commercial, and by any means.
        In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the
        software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and
        successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software
        under copyright law.""",
    ),
]


def normalise(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def _bag(words: list[str]) -> Counter:
    return Counter(zip(words, words[1:], strict=False))


def needed(n: int, least: float) -> int:
    """The fewest bigrams that any span has in common with a template of n at the likeness ``least``."""
    return math.ceil(n * least / (2 - least) - 1e-9)


def markers(templates: list[tuple[str, str]], least: float = LEAST) -> list[str]:
    """Words of which every text with a match has one: of each template its longest, until they touch more bigrams than a match may lack."""
    found: set[str] = set()
    for _, text in templates:
        words = normalise(text)
        bag = _bag(words)
        own: set[str] = set()
        for word in sorted(set(words), key=lambda w: (-len(w), w)):
            own.add(word)
            if sum(k for pair, k in bag.items() if own & set(pair)) > len(words) - 1 - needed(len(words) - 1, least):
                break
        found |= own
    return sorted(found)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _table(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    """license, n (its bigrams), a, b (a bigram) and copies (how often it has it)."""
    rows = [f"({_quoted(name)}, {len(words) - 1}, {_quoted(a)}, {_quoted(b)}, {k})" for name, text in templates for words in [normalise(text)] for (a, b), k in sorted(_bag(words).items())]
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(license, n, ta, tb, copies)")


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, least: float = LEAST) -> DataFrame:
    """doc_id, word (the span's first, from 0), words (its number), license and dice of each span that is like a template."""
    templates = [t for t in templates or TEMPLATES if len(normalise(t[1])) > 1]
    table = _table(docs.sparkSession, templates).withColumn("key", F.xxhash64("ta", "tb"))
    marks = ", ".join(map(_quoted, markers(templates, least)))
    texts = docs.selectExpr("doc_id", "split(trim(regexp_replace(lower(text), '[^\\\\p{L}\\\\p{N}]+', ' ')), ' ') AS w").where(f"size(w) > 1 AND arrays_overlap(w, array({marks}))")
    pairs = texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "w").selectExpr("row", "doc_id", "w", "size(w) - 1 AS own", "explode(sequence(0, size(w) - 2)) AS p")
    pairs = pairs.selectExpr("row", "doc_id", "own", "p", "w[p] AS a", "w[p + 1] AS b", "xxhash64(w[p], w[p + 1]) AS at")
    fits = f"at = key AND a = ta AND b = tb AND 2D * own >= {least}D * (own + n)"
    hits = pairs.join(F.broadcast(table), F.expr(fits)).groupBy("row", "doc_id", "license", "n", "own").agg(F.array_sort(F.collect_list(F.struct("p", "key", "copies"))).alias("hits"))
    size = "least(n, own - hits[i].p)"  # bigrams of the span that begins with the hit i
    need = f"cast(ceil({least}D * ({size} + n) / 2 - 1e-9D) AS int)"
    starts = hits.withColumn("starts", F.expr(f"filter(sequence(0, size(hits) - 1), i -> i + {need} <= size(hits) AND hits[i + {need} - 1].p < hits[i].p + n)")).where("size(starts) > 0")
    inside = "filter(slice(hits, i + 1, n), y -> y.p < hits[i].p + n)"
    spans = starts.withColumn("spans", F.expr(f"transform(starts, i -> named_struct('p', hits[i].p, 'size', {size}, 'bag', {inside}))"))
    once = "size(array_distinct(transform(filter(s.bag, y -> y.copies = 1), y -> y.key)))"
    more = "transform(filter(s.bag, y -> y.copies > 1), y -> struct(y.key, y.copies))"
    common = f"aggregate(array_distinct({more}), {once}, (k, x) -> k + least(x.copies, size(filter(s.bag, y -> y.key = x.key))))"
    alike = spans.withColumn("found", F.expr(f"filter(transform(spans, s -> named_struct('p', s.p, 'size', s.size, 'dice', 2D * {common} / (s.size + n))), f -> f.dice >= {least}D)"))
    better = "y.p < x.p + x.size AND x.p < y.p + y.size AND (y.dice > x.dice OR (y.dice = x.dice AND y.p < x.p))"
    near = "slice(found, greatest(1, i + 1 - n), 2 * n + 1)"  # spans that overlap begin within n places
    best = alike.withColumn("best", F.expr(f"filter(found, (x, i) -> NOT exists({near}, y -> {better}))"))
    return best.select("doc_id", "license", F.explode("best").alias("f")).selectExpr(
        "doc_id", "cast(f.p AS bigint) AS word", "cast(f.size + 1 AS bigint) AS words", "license", "round(f.dice, 9) AS dice"
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


_VALUES = ", ".join("('{}', '{}')".format(name, " ".join(normalise(text))) for name, text in TEMPLATES)
ORACLE = f"""
WITH t AS (SELECT name, string_split(norm, ' ') AS w FROM (VALUES {_VALUES}) v(name, norm)),
tb AS (SELECT name, len(w) - 1 AS n, w[i] || ' ' || w[i + 1] AS b FROM (SELECT *, unnest(range(1, len(w))) AS i FROM t)),
tc AS (SELECT name, n, b, count(*) AS copies FROM tb GROUP BY ALL),
d AS (SELECT row_number() OVER () AS r, doc_id, string_split(trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT r, doc_id, len(w) - 1 AS own, i - 1 AS p, w[i] || ' ' || w[i + 1] AS b FROM (SELECT *, unnest(range(1, len(w))) AS i FROM d)),
h AS (SELECT r, doc_id, own, p, name, n, b, copies FROM g JOIN tc USING (b) WHERE 2.0::DOUBLE * own >= {LEAST}::DOUBLE * (own + n)),
c AS (SELECT s.r, s.name, s.p, y.b, least(count(*), any_value(y.copies)) AS k FROM h s JOIN h y ON s.r = y.r AND s.name = y.name AND y.p >= s.p AND y.p < s.p + s.n GROUP BY s.r, s.name, s.p, y.b),
k AS (SELECT r, name, p, sum(k)::BIGINT AS common FROM c GROUP BY ALL),
f AS (SELECT r, doc_id, name, n, p, least(n, own - p) AS size, 2.0::DOUBLE * common / (least(n, own - p) + n) AS dice FROM h JOIN k USING (r, name, p)),
m AS (SELECT * FROM f WHERE dice >= {LEAST}::DOUBLE)
SELECT doc_id, p::BIGINT AS word, (size + 1)::BIGINT AS words, name AS license, round(dice, 9) AS dice FROM m x
WHERE NOT EXISTS (SELECT 1 FROM m y WHERE y.r = x.r AND y.name = x.name AND y.p < x.p + x.size AND x.p < y.p + y.size AND (y.dice > x.dice OR (y.dice = x.dice AND y.p < x.p)))
"""

QUERIES = {"op7_license_scan": op7_license_scan}
ORACLES = {"op7_license_scan": ORACLE}
