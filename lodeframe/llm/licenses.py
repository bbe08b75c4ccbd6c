"""License scans in DataFrame functions only: MinHash bands over overlapping windows retrieve templates, exact
shingle containment verifies them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: License statements and notices looked for, as (license, text).
TEMPLATES = (
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("Proprietary", "All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("BSD-2-Clause", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following"),
)
#: Statements of fewer than SHINGLE words, each one shingle of its own length; numbered after the templates.
SHORT = (("Proprietary", "All rights reserved"),)
SHINGLE, CONTAINMENT = 5, 0.8
#: Hash functions, each a band of one row: two sets of similarity J share a band with chance 1 - (1 - J) ** BANDS.
BANDS = 24
#: Words of a text whose windows are made together; rows of bands that are broadcast, at most.
CHUNK, MOST_BANDS = 4096, 100_000
_WORD = re.compile(r"[a-z0-9]+")
_SQL_WORD = "[a-z0-9]+"


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def window_sizes(lengths: list[int]) -> dict[int, int]:
    """Template length -> window length: the smallest of 8, 12, 18, 27, ... whose overlap of two thirds
    still holds the template whole, so that it fills half of some window or more."""
    sizes, w = {}, 8
    for n in sorted(set(lengths)):
        while w - stride(w) + 1 < n:
            w = w * 3 // 2
        sizes[n] = w
    return sizes


def stride(w: int) -> int:
    return max(1, w // 3)


def anchors(shingles: list[str], containment: float) -> set[str]:
    """Words, the longest first, such that more than 1 - containment of the shingles would be missing from any
    text that holds none of them; a text without one of them cannot match."""
    left, out = list(shingles), set()
    while len(left) >= containment * len(shingles):
        longest = max({w for s in left for w in s.split()} - out, key=lambda w: (len(w), w))
        out.add(longest)
        left = [s for s in left if longest not in s.split()]
    return out


def _own(n: int, k: int) -> int:
    """Words in a shingle of a statement of ``n`` words."""
    return min(k, n)


def _sizes(templates, k: int) -> dict[int, int]:
    """Template length -> window length; a statement shorter than ``k`` is its own window, at every word."""
    lengths = [len(words(t)) for _, t in templates]
    return window_sizes([n for n in lengths if n >= k]) | {n: n for n in lengths if n < k}


def _shingles(tokens: Column, k: Column) -> Column:
    n = F.size(tokens) - k + 1
    made = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(tokens, i, k), " "))
    return F.when(n >= 1, F.array_distinct(made)).otherwise(F.array().cast("array<string>"))


def _bands(shingles: Column) -> Column:
    base = F.transform(shingles, lambda s: F.xxhash64(s))
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.array_min(F.transform(base, lambda h: F.xxhash64(h, b))))


def template_table(spark: SparkSession, templates=TEMPLATES + SHORT, k: int = SHINGLE) -> DataFrame:
    """``template, license, width, shingles``; its size is that of the fixed list of templates."""
    sizes = _sizes(templates, k)
    rows = []
    for i, (name, text) in enumerate(templates):
        w = words(text)
        if not w:
            raise ValueError(f"a template has no words: {text}")
        own = _own(len(w), k)
        rows.append((i, name, sizes[len(w)], list(dict.fromkeys(" ".join(w[j : j + own]) for j in range(len(w) - own + 1)))))
    return spark.createDataFrame(rows, "template int, license string, width int, shingles array<string>")


def _parts(templates, k: int) -> list[tuple[int, int, list[str], list[str]]]:
    """Short statements that a longer template of the same license holds: (statement, template, the two words
    before it there, the two after it)."""
    out = []
    for i, (name, short) in enumerate(templates):
        s = words(short)
        for j, (other, long) in enumerate(templates):
            w = words(long)
            if len(s) < k <= len(w) and name == other:
                out += [(i, j, w[max(0, at - 2) : at], w[at + len(s) : at + len(s) + 2]) for at in range(len(w) - len(s) + 1) if w[at : at + len(s)] == s]
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES + SHORT, k: int = SHINGLE, containment: float = CONTAINMENT) -> DataFrame:
    """``doc_id, license, template, containment, n_windows, first_word``: each document and template of which some
    window holds at least ``containment`` of the distinct shingles of ``k`` words; ``first_word`` is where the
    first such window starts, in words from 0.

    Words are lower-cased runs of a-z and 0-9. A template lies whole in some window of its width (two
    thirds overlap), where its similarity is 0.25 or more even at the least containment, so that some
    band meets with a chance of 0.999. A statement of fewer than ``k`` words is found wherever its words
    follow each other, but for places where it is part of a longer template of its license that the
    document holds. Templates are statements, notices and the short licenses whole, not the long texts of Apache,
    GPL, MPL and CC; BSD-3-Clause holds the conditions of BSD-2-Clause. Null and empty texts and null ids match nothing; repeated rows
    of an id give one row; an empty table gives an empty result; other columns are not read.

    Documents without any anchor word of any template cannot hold enough shingles and are passed over
    before windows are made, as are windows without an anchor of a template of their width; both are exact. Words are taken in
    chunks, so no row holds all windows of a long text. Windows whose bands are in no template of their width go; the
    others meet the table of bands in a join, and exact containment decides.
    """
    spark = docs.sparkSession
    table = template_table(spark, templates, k)
    sizes = _sizes(templates, k)
    tokens_of = [words(t) for _, t in templates]
    width_of, own_of = [sizes[len(w)] for w in tokens_of], [_own(len(w), k) for w in tokens_of]
    index = table.select("template", "license", "width", F.col("shingles").alias("wanted"), F.posexplode(_bands(F.col("shingles"))).alias("band", "value"))
    keys: dict[int, list[int]] = {}
    for r in index.select("width", F.xxhash64("band", "value").alias("key")).collect():  # of the given list of templates
        keys.setdefault(r.width, []).append(r.key)
    anchors_of: dict[int, set[str]] = {}
    for w, width, own in zip(tokens_of, width_of, own_of, strict=True):
        anchors_of.setdefault(width, set()).update(anchors(list(dict.fromkeys(" ".join(w[j : j + own]) for j in range(len(w) - own + 1))), containment))
    every = sorted(set().union(*anchors_of.values()))
    kinds = F.array(*[
        F.struct(F.lit(w).alias("width"), F.lit(stride(w) if w >= k else 1).alias("stride"), F.lit(min(w, k)).alias("k"), F.array(*[F.lit(x) for x in sorted(anchors_of[w])]).alias("anchors"), F.array(*[F.lit(x) for x in sorted(keys[w])]).alias("keys"))
        for w in sorted(keys)
    ])
    low = F.lower(F.col(text_col))
    src = docs.where(F.col(id_col).isNotNull() & low.rlike("(?<![a-z0-9])(?:" + "|".join(every) + ")(?![a-z0-9])"))
    src = src.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.regexp_extract_all(low, F.lit(_SQL_WORD), F.lit(0)).alias("tokens"))
    lead, reach = 2, max(keys) + 2
    starts = F.transform(F.sequence(F.lit(0), F.floor((F.size("tokens") - 1) / CHUNK).cast("int")), lambda c: F.struct((c * CHUNK).alias("base"), F.least(c * CHUNK, F.lit(lead)).alias("skip"), F.slice("tokens", c * CHUNK - F.least(c * CHUNK, F.lit(lead)) + 1, F.lit(CHUNK + reach + lead)).alias("part")))
    src = src.where(F.size("tokens") > 0).select("doc_id", "row", F.explode(starts).alias("c")).select("doc_id", "row", "c.*")
    listed = F.array(*[F.lit(x) for x in every])
    spots = F.filter(F.sequence(F.lit(0), F.size("part") - 1), lambda i: F.array_contains(listed, F.get("part", i)))
    src = src.withColumn("spots", spots).where(F.size("spots") > 0)

    def windows_of(x):
        # the starts of this width's windows that lie in the chunk and cover a spot of theirs
        own = F.filter("spots", lambda i: F.array_contains(x["anchors"], F.get("part", i)))
        at = F.flatten(F.transform(own, lambda i: F.transform(F.sequence(F.greatest(F.lit(0), F.floor((i + F.col("base") - F.col("skip") - x["width"]) / x["stride"]).cast("int") + 1), F.floor((i + F.col("base") - F.col("skip")) / x["stride"]).cast("int")), lambda j: j * x["stride"])))
        at = F.filter(F.array_distinct(at), lambda a: (a >= F.col("base")) & (a < F.col("base") + CHUNK))

        def window(a):
            i = a - F.col("base") + F.col("skip")
            short = x["k"] < k
            around = lambda at, n: F.when(short, F.slice("part", at, n)).otherwise(F.array().cast("array<string>"))
            return F.struct(x["width"].alias("width"), a.alias("first_word"), _shingles(F.slice("part", i + 1, x["width"]), x["k"]).alias("shingles"), around(F.greatest(i - lead, F.lit(0)) + 1, F.least(i, F.lit(lead))).alias("before"), around(i + x["width"] + 1, F.lit(lead)).alias("after"))

        made = F.transform(F.transform(at, window), lambda w: F.struct(w.alias("w"), F.transform(_bands(w["shingles"]), lambda v, b: F.struct(b.alias("band"), v.alias("value"))).alias("bands")))
        return F.filter(made, lambda m: (F.size(m["w"]["shingles"]) > 0) & F.arrays_overlap(F.transform(m["bands"], lambda b: F.xxhash64(b["band"], b["value"])), x["keys"]))

    met = src.select("doc_id", "row", F.explode(F.flatten(F.transform(kinds, windows_of))).alias("m")).select("doc_id", "row", "m.w.*", F.explode("m.bands").alias("b"))
    met = met.select("doc_id", "row", "width", "first_word", "shingles", "before", "after", F.col("b.band").alias("band"), F.col("b.value").alias("value"))
    met = met.join(F.broadcast(index) if len(templates) * BANDS <= MOST_BANDS else index, ["width", "band", "value"])
    share = F.size(F.array_intersect("shingles", "wanted")) / F.size("wanted")
    found = met.select("doc_id", "row", "template", "license", "first_word", share.alias("containment"), "before", "after").where(F.col("containment") >= containment)
    found = found.groupBy("doc_id", "row", "template", "license", "first_word").agg(F.max("containment").alias("containment"), F.first("before").alias("before"), F.first("after").alias("after"))
    inside = F.lit(False)
    for i, j, before, after in _parts(templates, k):
        # the part of a longer template that the document holds: the words around it are those of the template
        held = F.coalesce(F.max(F.when(F.col("template") == j, True)).over(Window.partitionBy("row")), F.lit(False))
        around = [F.get("before", F.size("before") - len(before) + n) == w for n, w in enumerate(before)] + [F.get("after", F.lit(n)) == w for n, w in enumerate(after)]
        there = (F.col("template") == i) & held
        for x in around:
            there = there & F.coalesce(x, F.lit(False))
        inside = inside | there
    found = found.withColumn("_inside", inside).where(~F.col("_inside"))
    return found.groupBy("doc_id", "template", "license").agg(F.max("containment").alias("containment"), F.count("*").alias("n_windows"), F.min("first_word").cast("bigint").alias("first_word")).select("doc_id", "license", "template", "containment", "n_windows", "first_word")
