"""Licences of files by TF-IDF cosine to templates, and by inheritance from directories; DataFrame functions only.

Templates are licence texts, the headers that source files carry, and one-line notices. What is compared with them are
every line of a file, every paragraph of several lines (so wrapped notices, comment headers and texts inside longer files
are seen whole; comment marks are no words), and the whole of a file that is named as a licence file. Term weights are
counts times ``ln((1 + files) / (1 + files with the term)) + 1``, frequencies being taken over all files; words that no
template has count as seen in no file, so other text lowers the cosine. Only what has two words of the templates is
weighed, and of that only what has one of a template's heavy terms: those without which the threshold cannot be reached,
so nothing is lost. A file's own licence is its best match of cosine ``threshold`` (0.8) or more; of equal cosines the first
licence name, then lines before paragraphs before the whole, then the first of them. A file of which the match is at least
``share`` (0.3) of all words, or whose name is that of a licence file, stands for its directory; of several the best match,
then the smallest path. A file without a licence of its own inherits from the nearest directory above it that has one, by a
join of all its ancestors with the directories' licences.

Cases: a NULL or empty text has no notice but may inherit. A NULL path is no directory's and inherits nothing; its text is still scanned. Rows that
repeat a path are judged one by one. Without templates no file has a licence. Empty tables give empty results. The key, and columns of
other names than the result's, are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millwright.llm.common import written
from millwright.llm.decontamination import words

_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
    "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
    "persons to whom the Software is furnished to do so, subject to the following conditions:"
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution."
)
_BSD_NAME = (
    " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission."
)
_BSD_AS_IS = (
    ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
    "License. You may obtain a copy of the License at"
)
_APACHE_REST = (
    " http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
    'distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either '
    "express or implied. See the License for the specific language governing permissions and limitations under the License."
)


def _gnu(what: str, name: str, version: str) -> tuple[str, str]:
    """A GNU header: its first paragraph, and all of it."""
    first = (
        f"This {what} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by "
        f"the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
    )
    rest = (
        f" This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
        f"warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details. You should have "
        f"received a copy of the {name} along with this {what}. If not, see <https://www.gnu.org/licenses/>."
    )
    return first, first + rest


_GNU = {
    "AGPL-3.0": _gnu("program", "GNU Affero General Public License", "3"),
    "GPL-2.0": _gnu("program", "GNU General Public License", "2"),
    "GPL-3.0": _gnu("program", "GNU General Public License", "3"),
    "LGPL-2.1": _gnu("library", "GNU Lesser General Public License", "2.1"),
    "LGPL-3.0": _gnu("library", "GNU Lesser General Public License", "3"),
}

#: Fixed texts: licences, headers, and short notices as authors write them: (name, text). Names are SPDX identifiers.
TEMPLATES = [
    *[(name, text) for name, both in _GNU.items() for text in both],
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", _APACHE + _APACHE_REST),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", _BSD + _BSD_AS_IS),
    ("BSD-3-Clause", _BSD + _BSD_NAME + _BSD_AS_IS),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0 Universal."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("MIT", _MIT),
    (
        "MIT",
        _MIT + " The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software. " + _AS_IS,
    ),
    ("MIT", "Released under the MIT License."),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
        "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software. Permission is granted to anyone to use this software "
        "for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the "
        "following restrictions:",
    ),
]
LICENSE_FILE = r"(?i)(^|/)(licen[sc]e|copying|unlicense)(\.[a-z]+)?$"
THRESHOLD, SHARE = 0.8, 0.3
OWN = ("license", "origin", "license_path", "cosine")


#: Lines that end a paragraph.
GAP = r"\n[ \t\r]*\n"


def _units(files: DataFrame, known: Column, decisive: Column) -> DataFrame:
    """(row, kind, place, w): words of lines (0), of paragraphs of several lines (1), of whole licence files (2) that may match.

    Files without a decisive word are left out as a whole; of the others each unit is split into words once.
    """

    def unit(kind: int, place: Column, raw: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), place.alias("place"), words(raw).alias("w"))

    lines = F.transform(F.split("text", "\n", -1), lambda x, i: unit(0, i, x))
    several = F.transform(F.split("text", GAP, -1), lambda x, i: F.when(F.contains(x, F.lit("\n")), unit(1, i, x)))
    whole = F.array(F.when(F.col("is_license_file"), unit(2, F.lit(0), F.col("text"))))
    able = F.filter(
        F.concat(lines, several, whole),
        lambda u: u.isNotNull() & F.arrays_overlap(u["w"], decisive) & (F.size(F.array_intersect(u["w"], known)) >= 2),
    )
    some = files.where(F.arrays_overlap(words("text"), decisive))
    return some.select("row", F.explode(able).alias("u")).select("row", "u.kind", "u.place", "u.w")


def notices(files: DataFrame, templates: list[tuple[str, str]], threshold: float = THRESHOLD) -> DataFrame:
    """(row, license, kind, place, cosine, n_words of the match): the best match of each file that has one.

    ``files`` has (row, text, is_license_file).
    """
    spark = files.sparkSession
    numbered = [(i, *t) for i, t in enumerate(templates)]
    texts = spark.createDataFrame(numbered, "t int, license string, template string")
    terms = texts.select("t", "license", F.explode(words("template")).alias("term")).groupBy("t", "license", "term").agg(F.count("*").alias("tf"))
    vocabulary = sorted({r.term for r in terms.select("term").distinct().collect()})  # as many as the templates have
    known = F.array(*[F.lit(t) for t in vocabulary]).cast("array<string>")
    n_files = files.count()
    seen = files.select(F.explode(F.array_intersect(words("text"), known)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((F.lit(1.0) + n_files) / (F.lit(1.0) + F.coalesce("df", F.lit(0)))) + 1
    rare = F.log(F.lit(1.0 + n_files)) + 1
    weights = written(
        terms.select("term").distinct().join(seen, "term", "left").select("term", idf.alias("idf")), "idf"
    )
    weighed = terms.join(F.broadcast(weights), "term").withColumn("w", F.col("tf") * F.col("idf"))
    norms = weighed.groupBy("t").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    unit = written(weighed.join(F.broadcast(norms), "t").select("t", "license", "term", (F.col("w") / F.col("norm")).alias("unit")), "units")

    # Of each template the terms of most weight, until what is left of it is below the threshold.
    square = F.col("unit") * F.col("unit")
    before = Window.partitionBy("t").orderBy(F.desc("unit"), "term").rowsBetween(Window.unboundedPreceding, -1)
    heavy = unit.withColumn("before", F.coalesce(F.sum(square).over(before), F.lit(0.0))).where(1 - F.col("before") >= (threshold - 1e-6) ** 2)
    heaviest = sorted({r.term for r in heavy.select("term").distinct().collect()})
    decisive = F.array(*[F.lit(t) for t in heaviest]).cast("array<string>")

    near = written(_units(files, known, decisive).dropDuplicates(["row", "kind", "place"]), "near")
    name = ["row", "kind", "place"]
    counted = near.select(*name, F.explode("w").alias("term")).groupBy(*name, "term").agg(F.count("*").alias("tf"))
    # A term meets all templates in one row, however many have it; a template without it adds nothing to the sum.
    wide = weights.join(
        unit.groupBy("term").agg(F.map_from_entries(F.collect_list(F.struct("t", "unit"))).alias("units")), "term", "left"
    )
    counted = counted.join(F.broadcast(wide), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", rare))
    dots = [F.sum(F.col("w") * F.element_at("units", F.lit(i))).alias(f"dot_{i}") for i, *_ in numbered]
    sums = counted.groupBy(*name).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.sum("tf").alias("n_words"), *dots)
    cosines = F.array(*[
        F.struct(F.lit(license).alias("license"), F.round(F.col(f"dot_{i}") / F.col("norm"), 6).alias("cosine")) for i, license, _ in numbered
    ]).cast("array<struct<license:string,cosine:double>>")
    good = sums.select(*name, "n_words", F.explode(F.filter(cosines, lambda c: c["cosine"] >= threshold)).alias("c"))
    good = good.select(*name, "n_words", "c.license", "c.cosine")
    first = F.min(F.struct((-F.col("cosine")).alias("minus"), "license", "kind", "place", "n_words", "cosine")).alias("b")
    return good.groupBy("row").agg(first).select("row", "b.license", "b.kind", "b.place", "b.cosine", "b.n_words")


def _directories(path) -> Column:
    """The directory of a path and all above it, the root being the empty name, with their depths."""
    parts = F.split(path, "/")
    return F.transform(
        F.sequence(F.lit(0), F.size(parts) - 1),
        lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("directory")),
    )


def scan(
    files: DataFrame, path: str = "path", text: str = "text", templates: list[tuple[str, str]] | None = None,
    threshold: float = THRESHOLD, share: float = SHARE, license_file: str = LICENSE_FILE,
) -> DataFrame:
    """``files`` without the text, with license, origin (own or inherited), license_path and cosine."""
    rest = [c for c in files.columns if c != text and c not in OWN]
    # A row is known by hashes of its path and text (128 bits), so texts are neither shuffled nor written.
    row = F.struct(F.xxhash64(path, text).alias("h1"), F.xxhash64(F.lit(1), text, path).alias("h2")).alias("row")
    is_license_file = F.coalesce(F.col(path).rlike(license_file), F.lit(False)).alias("is_license_file")
    scanned = files.select(row, F.col(text).alias("text"), is_license_file)
    best = written(notices(scanned, TEMPLATES if templates is None else templates, threshold), "notices")
    held = files.select(row, *[F.col(c).alias(f"_{c}") for c in rest], F.size(words(text)).alias("n_all"))
    named = written(held.join(best, "row", "left").withColumn("path", F.col(f"_{path}")), "named")
    stands = (F.col("n_words") >= share * F.col("n_all")) | F.col("path").rlike(license_file)
    directory = F.regexp_replace("path", r"/?[^/]*$", "")
    grounds = (
        named.where(F.col("license").isNotNull() & F.col("path").isNotNull() & stands)
        .groupBy(directory.alias("directory"))
        .agg(F.min(F.struct((-F.col("cosine")).alias("minus"), "path", "license", "cosine")).alias("b"))
        .select("directory", F.col("b.license").alias("given"), F.col("b.path").alias("given_path"), F.col("b.cosine").alias("given_cosine"))
    )
    above = named.where("license is null and path is not null").select("path").distinct()
    above = above.select("path", F.explode(_directories(F.col("path"))).alias("d"))
    nearest = (
        above.select("path", "d.depth", "d.directory").join(grounds, "directory")
        .groupBy("path").agg(F.max(F.struct("depth", "given", "given_path", "given_cosine")).alias("g"))
        .select("path", "g.given", "g.given_path", "g.given_cosine")
    )
    own = F.col("license").isNotNull()
    return named.join(nearest, "path", "left").select(
        *[F.col(f"_{c}").alias(c) for c in rest],
        F.coalesce("license", "given").alias("license"),
        F.when(own, "own").when(F.col("given").isNotNull(), "inherited").alias("origin"),
        F.when(own, F.col(f"_{path}")).otherwise(F.col("given_path")).alias("license_path"),
        F.coalesce("cosine", "given_cosine").alias("cosine"),
    )


def report(docs: DataFrame) -> DataFrame:
    """The registered query: documents as files source/language/thousand/number.txt."""
    path = F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 1000).cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return scan(docs.select("doc_id", path.alias("path"), "text"))


_WORDS = r"[x FOR x IN string_split_regex(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> '']"
_VALUES = ", ".join("({}, '{}', '{}')".format(i, n, t.replace("'", "''")) for i, (n, t) in enumerate(TEMPLATES))
#: The same for DuckDB.
ORACLE_SQL = f"""
WITH f AS (
  SELECT doc_id, source || '/' || lang || '/' || (doc_id // 1000) || '/' || doc_id || '.txt' AS path, text, {_WORDS.format('text')} AS w FROM documents),
t(t, license, template) AS (VALUES {_VALUES}),
tt AS (SELECT t, license, term, count(*) AS tf FROM (SELECT t, license, unnest({_WORDS.format('template')}) AS term FROM t) GROUP BY ALL),
v AS (SELECT DISTINCT term FROM tt),
n AS (SELECT count(*) AS n FROM f),
i AS (
  SELECT v.term, ln((1.0 + n) / (1.0 + coalesce(df, 0))) + 1 AS idf
  FROM n, v LEFT JOIN (SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(w) AS term FROM f) GROUP BY term) d ON d.term = v.term),
tn AS (SELECT t, sqrt(sum(tf * idf * tf * idf)) AS norm FROM tt JOIN i USING (term) GROUP BY t),
u AS (SELECT t, license, term, tf * idf / norm AS unit FROM tt JOIN i USING (term) JOIN tn USING (t)),
raw AS (
  SELECT doc_id, 0 AS kind, pos - 1 AS place, ls[pos] AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM f), range(1, len(ls) + 1) r(pos)
  UNION ALL
  SELECT doc_id, 1, pos - 1, ps[pos] FROM (SELECT doc_id, string_split_regex(text, '\\n[ \\t\\r]*\\n') AS ps FROM f), range(1, len(ps) + 1) r(pos)
  WHERE contains(ps[pos], chr(10))),
l AS (SELECT doc_id, kind, place, {_WORDS.format('raw')} AS w FROM raw),
c AS (SELECT doc_id, kind, place, term, count(*) AS tf FROM (SELECT doc_id, kind, place, unnest(w) AS term FROM l) GROUP BY ALL),
cw AS (SELECT c.*, idf, tf * coalesce(idf, ln(1.0 + n) + 1) AS cw FROM n, c LEFT JOIN i USING (term)),
near AS (SELECT doc_id, kind, place, sqrt(sum(cw * cw)) AS norm, sum(tf) AS n_words FROM cw GROUP BY ALL HAVING count(idf) >= 2),
g AS (
  SELECT doc_id, kind, place, license, t, n_words, round(sum(cw * unit) / any_value(norm), 6) AS cosine
  FROM cw JOIN near USING (doc_id, kind, place) JOIN u USING (term) GROUP BY doc_id, kind, place, license, t, n_words),
b AS (SELECT * FROM g WHERE cosine >= 0.8 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, license, kind, place) = 1),
dir AS (
  SELECT regexp_replace(path, '/?[^/]*$', '') AS directory, license, path, cosine FROM b JOIN f USING (doc_id)
  WHERE n_words >= 0.3 * len(w) QUALIFY row_number() OVER (PARTITION BY directory ORDER BY cosine DESC, path) = 1),
up AS (
  SELECT f.doc_id, dir.license, dir.path, dir.cosine FROM f JOIN dir ON starts_with(f.path, dir.directory || '/') ANTI JOIN b ON b.doc_id = f.doc_id
  QUALIFY row_number() OVER (PARTITION BY f.doc_id ORDER BY length(directory) DESC) = 1)
SELECT f.doc_id, f.path, coalesce(b.license, up.license) AS license,
  CASE WHEN b.license IS NOT NULL THEN 'own' WHEN up.license IS NOT NULL THEN 'inherited' END AS origin,
  CASE WHEN b.license IS NOT NULL THEN f.path ELSE up.path END AS license_path, coalesce(b.cosine, up.cosine) AS cosine
FROM f LEFT JOIN b ON b.doc_id = f.doc_id LEFT JOIN up ON up.doc_id = f.doc_id
"""
