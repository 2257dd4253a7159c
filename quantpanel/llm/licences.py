"""Licence scans (5): normalised text against licence templates by the Dice coefficient of word bigrams. DataFrame only.

Units of a text are its lines, the text as a whole, and regions: runs of segments (sentences and lines) that read like a
licence, so that a text or notice is found that wraps over lines, spans paragraphs or stands among other prose. A segment
reads like a licence if KNOWN tenths of its words stand in some template; blank ones part nothing. Regions are sought in
texts that hold one of MARKS. Only units that read like a licence are compared.

Bounds prune before bigrams are built: a set of n bigrams can reach a coefficient t with a template of m only if
t / (2 - t) * m <= n <= (2 - t) / t * m; a unit of w words has at most w - 1 distinct bigrams, and at least one less than
it has distinct words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Texts, headers and short notices of common licences.
TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "AGPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-2-Clause text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "BSD-3-Clause text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0 header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "ISC": "Released under the ISC License.",
    "ISC text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MPL-2.0 header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
LEAST = 0.8
#: Tenths of a segment's words that stand in some template if it reads like a licence.
KNOWN = 7
#: Parts of words of which each template holds one; a text without any is compared by lines and as a whole only.
MARKS = "licen[cs]e|copyright|warrant|public domain|redistribut|permission"
#: Templates that a scan takes at most.
MOST = 2000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str) -> str:
    """A-Z lower-cased, runs of what is no letter, digit, dot within or hyphen taken as blanks; non-ASCII stays."""
    clean = f"regexp_replace(translate({text}, '{_UPPER}', '{_LOWER}'), '[\\\\x00-\\\\x2c\\\\x2f\\\\x3a-\\\\x60\\\\x7b-\\\\x7f]+|[.](?![0-9])', ' ')"
    return f"filter(split({clean}, ' '), w -> w <> '')"


def _bigrams(words: str) -> str:
    return f"array_distinct(zip_with(slice({words}, 1, greatest(size({words}) - 1, 0)), slice({words}, 2, greatest(size({words}) - 1, 0)), (a, b) -> concat(a, ' ', b)))"


def templates(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(list(TEMPLATES.items()), "licence string, notice string")
    return rows.selectExpr("licence", f"{_words('notice')} as words").selectExpr("licence", f"{_bigrams('words')} as grams")


def _with(value: str, name: str, body: str) -> str:
    """body with name bound to value once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def scan_licences(docs: DataFrame, least: float = LEAST, known: DataFrame | None = None) -> DataFrame:
    """(doc_id, licence, dice, n_units) for each row of docs (doc_id, text).

    licence is the template with the largest coefficient of at least `least` over the units of the text, the first by
    name on ties, null if none is; n_units counts the different units that reach `least` with some template. Null, empty
    and one-word texts have none. Rows that repeat a doc_id each get the result of their own text. Other columns are
    ignored; an empty table gives no rows, and with no templates nothing is found. known: (licence, grams), bounded like
    TEMPLATES.
    """
    spark = docs.sparkSession
    known = templates(spark) if known is None else known
    # one row for each licence, at most MOST of them: they become literals of the plan
    held = sorted((r[0], sorted(r[1])) for r in known.limit(MOST + 1).collect() if r[1])
    if len(held) > MOST:
        raise ValueError(f"more than {MOST} templates")
    if not held:
        return docs.selectExpr("doc_id", "cast(null as string) as licence", "cast(null as double) as dice", "0L as n_units")
    low, high = min(len(g) for _, g in held), max(len(g) for _, g in held)
    quoted = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    table = "array(" + ", ".join(f"named_struct('licence', {quoted(n)}, 'grams', array({', '.join(map(quoted, g))}))" for n, g in held) + ")"
    words = ", ".join(map(quoted, sorted({w for _, g in held for x in g for w in x.split(" ")})))
    lo, hi = least / (2 - least) * low, (2 - least) / least * high
    like = f"10 * size(filter(w, x -> x in ({words}))) >= {KNOWN} * size(w)"
    fits = f"size(w) - 1 >= {lo} and size(array_distinct(w)) - 1 <= {hi}"
    lines = "split(text, '\\n')"
    segments = "split(regexp_replace(text, '([.;:])[ \\\\t]+', '$1\\n'), '\\n')"
    marked = f"array_join(transform({segments}, s -> {_with(_words('s'), 'w', f'if({like}, s, char(1))')}), '\\n')"
    regions = f"if(text rlike '(?i){MARKS}', split({marked}, char(1)), array())"
    # scanned within the row: units that pass the bounds, their bigrams, the templates that they reach
    units = f"filter(array_distinct(transform(concat({lines}, array(text), {regions}), u -> {_words('u')})), w -> {fits} and {like})"
    rows = docs.select("doc_id", "text").selectExpr("doc_id", f"transform({units}, w -> {_bigrams('w')}) as units")
    rows = rows.selectExpr("doc_id", f"filter(units, g -> size(g) between {lo} and {hi}) as units")
    met = rows.select("*", F.expr(table).alias("known"))
    dice = "2.0D * size(array_intersect(g, k.grams)) / (size(g) + size(k.grams))"
    near = f"size(k.grams) >= {least} / (2 - {least}) * size(g) and size(g) >= {least} / (2 - {least}) * size(k.grams)"
    scores = f"transform(units, g -> array_min(transform(filter(known, k -> {near}), k -> struct(-({dice}) as d, k.licence as licence))))"
    met = met.selectExpr("doc_id", f"filter({scores}, s -> s.d <= -{least}) as found")
    return met.selectExpr("doc_id", "array_min(found).licence as licence", "round(-array_min(found).d, 6) as dice", "cast(greatest(size(found), 0) as long) as n_units")
