"""License scans: MinHash bands over overlapping windows find templates, exact shingle containment confirms them.

In built-in expressions only. Words are runs of a-z and 0-9 of the lower-cased text; a shingle is WORDS words (a
template with fewer words is one shingle of its own length). A window is a run of shingles. A window's MinHash for
band b is the least of (shingle xor c_b), which falls in what two windows share with a chance of their Jaccard
similarity; a band has one row.

* A template of up to SHORT shingles must be contained whole (SHARE of up to four is all), so text windows have its
  length, at every shingle, and an occurrence is a window equal to it: one band finds it for certain.
* A longer template is cut in windows of WIDTH shingles, STEP apart, as is the text. The nearest text window is at
  most STEP / 2 off, so 6 of 10 shingles are shared and BANDS bands miss with a chance of 0.4**8 = 0.0007 for each of
  the template's windows.

A band value that text and template share tells which template it is and where it would begin. The window of the template's
length there, or up to STEP shingles to either side, must hold SHARE or more of its shingles. Hits, places and shares are
arrays within the text's row, of which only what is confirmed is exploded: memory grows with the text, not with its square,
also where a text is one license after the other. Shingles are compared by 64-bit hashes. The templates are a small table whose
bands are inlined; texts as long as whole licenses may be given as templates too.

Nulls: a null text has no words and no license; null ids are one id. Repeated rows get equal values; rows that share an
id get the licenses of all of them. Of equally good places the first is told. A long text is scanned as a whole, in one
row. An empty table gives an empty result; only the id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm.common import table

WORDS = 5
SHARE = 0.8
SHORT, WIDTH, STEP, BANDS = 4, 8, 4, 8
_BSD_TERMS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    " 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    " 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the"
    " documentation and/or other materials provided with the distribution."
)
_BSD_DISCLAIMER = (
    ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,'
    " THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS"
    " BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE"
    " GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT"
    " LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
# License texts (of long ones the first paragraphs or the notice) and short statements by which texts name a license.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance'
        " with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless"
        " required by applicable law or agreed to in writing, software distributed under the License is distributed on"
        ' an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for'
        " the specific language governing permissions and limitations under the License."
    ),
    "bsd-2-clause": _BSD_TERMS + _BSD_DISCLAIMER,
    "bsd-3-clause": (
        _BSD_TERMS + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from"
        " this software without specific prior written permission." + _BSD_DISCLAIMER
    ),
    "bsl-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered"
        ' by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the'
        " Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software"
        " and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the"
        " Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of"
        " machine-executable object code generated by a source language processor."
    ),
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free"
        " Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be"
        " useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public"
        " License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see"
        " <https://www.gnu.org/licenses/>."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above"
        ' copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD'
        " TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,"
        " INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE"
        " OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "mit": "Released under the MIT License.",
    "mit-text": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to'
        " deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or"
        " sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright"
        " notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT"
        " WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND"
        " NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF"
        " CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "mpl-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can"
        " obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "reserved": "All rights reserved.",
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this"
        " software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that"
        " recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make"
        " this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act"
        " of relinquishment in perpetuity of all present and future rights to this software under copyright law."
    ),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the"
        " use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and"
        " redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you"
        " wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not"
        " required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may"
        " not be removed or altered from any source distribution."
    ),
}
_MASKS = [(0x9E3779B97F4A7C15 * (b + 1) ** 3 + 0x5851F42D4C957F2D) % 2**64 - 2**63 for b in range(BANDS)]


def _let(value: Column, body) -> Column:
    """``body`` of a value that is made once; as a column it could be inlined into a lambda and made for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def split_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")


def shingles(words: Column, n: int) -> Column:
    """Hashes of all runs of n words."""

    def hashed(w: Column) -> Column:
        runs = F.sequence(F.lit(0), F.size(w) - n)
        out = F.transform(runs, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)]))
        return F.when(F.size(w) >= n, out).otherwise(F.array().cast("array<bigint>"))

    return _let(words, hashed)


def template_table(spark: SparkSession, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """license, n (words of a shingle), and its shingles; as many rows as templates."""
    rows = spark.createDataFrame(list(templates.items()), "license string, body string").withColumn("words", split_words(F.col("body")))
    rows = rows.withColumn("n", F.least(F.size("words"), F.lit(WORDS)))
    cases = [(n, shingles(F.col("words"), n)) for n in range(1, WORDS + 1)]
    chosen = F.when(F.col("n") == cases[0][0], cases[0][1])
    for n, made in cases[1:]:
        chosen = chosen.when(F.col("n") == n, made)
    return rows.select("license", "n", chosen.alias("own")).where(F.size("own") > 0)


def template_bands(templates: list[tuple[int, list[int]]]) -> dict[tuple[int, int], list[dict[int, list[int]]]]:
    """For each class (n, length of short templates or 0) and band: the templates' MinHashes, each with where it is found, as
    numbers that ``_packed`` makes of the template's number and the shingle."""
    out: dict[tuple[int, int], list[dict[int, list[int]]]] = {}
    for number, (n, own) in enumerate(templates):
        short = len(own) <= SHORT
        bands = out.setdefault((n, len(own) if short else 0), [{} for _ in range(1 if short else BANDS)])
        for a in [0] if short else [a for a in range(0, max(len(own) - WIDTH, 0) + STEP, STEP) if a < len(own)]:
            for band, found in enumerate(bands):
                found.setdefault(min(x ^ _MASKS[band] for x in own[a : a + (SHORT if short else WIDTH)]), []).append(_packed(number, -a))
    return out


_BITS, _ZERO = 40, 1 << 32  # a place in the low bits, counted from _ZERO so that it may be in front of the text


def _packed(template: int, place: int) -> int:
    return (template << _BITS) + _ZERO + place


def _least(window: Column, band: int) -> Column:
    return F.array_min(F.transform(window, lambda x: x.bitwiseXOR(F.lit(_MASKS[band]))))


def _none() -> Column:
    return F.array().cast("array<bigint>")


def _constant(values: list, kind: str) -> Column:
    """A constant of many numbers. Written as one text, which Spark reads once as it plans; as a tree of literals it would take long."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def _map(band: dict[int, list[int]]) -> Column:
    keys = sorted(band)
    return F.map_from_arrays(_constant(keys, "array<bigint>"), _constant([band[k] for k in keys], "array<array<bigint>>"))


def _hits(own: Column, width: int, step: int, bands: list[dict[int, list[int]]]) -> Column:
    """Starts of the windows that share a band with a template."""

    def shared(window: Column) -> Column:
        found = _least(window, 0).isin(sorted(bands[0]))
        for band in range(1, len(bands)):
            found = found | _least(window, band).isin(sorted(bands[band]))
        return found

    last = F.size(own) - (1 if step > 1 else width)  # the last windows of a grid may be short
    found = F.filter(F.sequence(F.lit(0), last, F.lit(step)), lambda i: _let(F.slice(own, i + 1, width), shared))
    return F.when(last >= 0, found).otherwise(F.array().cast("array<int>"))


def _places(own: Column, hits: Column, width: int, bands: list[dict[int, list[int]]]) -> Column:
    """Templates and their beginnings, packed, that windows' bands point to; each once."""

    def told(i: Column) -> Column:
        each = lambda w: F.flatten(F.array(*[F.coalesce(F.try_element_at(_map(band), _least(w, b)), _none()) for b, band in enumerate(bands)]))
        return F.transform(_let(F.slice(own, i + 1, width), each), lambda e: e + i)

    return F.array_distinct(F.flatten(F.transform(hits, told)))


def _confirmed(own: Column, places: Column, templates: list[tuple[int, list[int]]], reach: int) -> Column:
    """(template, at, containment) of the places around which a window of the template's length holds SHARE of it or more."""
    lists = _constant([own for _, own in templates], "array<array<bigint>>")
    sizes = _constant([len(set(own)) for _, own in templates], "array<bigint>")

    def share(place: Column) -> Column:
        number, begin = F.shiftright(place, _BITS).cast("int"), (place.bitwiseAND(F.lit((1 << _BITS) - 1)) - _ZERO).cast("int")

        def best(wanted: Column) -> Column:
            def held(d: Column) -> Column:
                first = begin + d
                window = F.slice(own, F.greatest(first, F.lit(0)) + 1, F.greatest(F.size(wanted) + F.least(first, F.lit(0)), F.lit(0)))
                return F.size(F.array_intersect(wanted, window))

            return F.array_max(F.transform(F.sequence(F.lit(-reach), F.lit(reach)), held))

        found = _let(F.get(lists, number), best) / F.get(sizes, number)
        return F.struct(number.alias("number"), F.greatest(begin, F.lit(0)).alias("at"), found.alias("containment"))

    return F.filter(F.transform(places, share), lambda x: x["containment"] >= SHARE)


def license_matches(df: DataFrame, key: str, text: str, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """doc, license, at (shingle where it begins), containment: one row for each license found."""
    known = [(r["license"], r["n"], list(r["own"])) for r in template_table(df.sparkSession, templates).collect()]  # a small table
    shingled = [(n, own) for _, n, own in known]
    classes = sorted(template_bands(shingled).items())
    sizes = sorted({n for (n, _), _ in classes})
    docs = df.select(F.col(key).alias("doc"), split_words(F.col(text)).alias("_words"))
    docs = docs.select("doc", *[shingles(F.col("_words"), n).alias(f"_s{n}") for n in sizes])
    hits, found = {}, []
    for (n, length), bands in classes:
        own, name = F.col(f"_s{n}"), f"_h{n}_{length}"
        width = length or WIDTH
        hits[name] = _hits(own, width, 1 if length else STEP, bands)
        if length:  # few texts have any shingle of a short template: look before going over all windows
            some = sorted({x for m, shingle in shingled if m == n and len(shingle) == length for x in shingle})
            hits[name] = F.when(F.arrays_overlap(own, _constant(some, "array<bigint>")), hits[name]).otherwise(F.array().cast("array<int>"))
        found.append((own, F.col(name), width, bands, 0 if length else STEP))
    docs = docs.withColumns(hits)
    docs = docs.withColumns({f"_p{k}": _places(own, at, width, bands) for k, (own, at, width, bands, _) in enumerate(found)})
    lists = [_confirmed(own, F.col(f"_p{k}"), shingled, reach) for k, (own, *_, reach) in enumerate(found)]
    each = docs.select("doc", F.explode(F.flatten(F.array(*lists))).alias("x"))
    names = F.array(*[F.lit(name) for name, *_ in known])
    return each.groupBy("doc", F.get(names, F.col("x.number")).alias("license")).agg(F.min("x.at").alias("at"), F.max("x.containment").alias("containment"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = license_matches(docs, "doc_id", "text").groupBy("doc").agg(
        F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"),
        F.count(F.lit(1)).alias("n_licenses"),
        F.min("containment").alias("least_containment"),
    )
    joined = docs.select("doc_id").join(found, docs["doc_id"].eqNullSafe(found["doc"]), "left")
    return joined.select(
        "doc_id", F.coalesce("n_licenses", F.lit(0)).alias("n_licenses"), F.coalesce("licenses", F.lit("")).alias("licenses"),
        F.round("least_containment", 6).alias("least_containment"),
    )
