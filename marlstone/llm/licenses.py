"""License scan, on DataFrame functions only.

Words are runs of a-z and 0-9 after lower-casing; shingles are five words; a template of three or four words is one
shingle of its own length. Two kinds of windows over a text retrieve templates. Long templates: overlapping windows of
`window` shingles, each with `bands` MinHash values of one row; a template of at least `window + stride - 1` shingles
that stands unaltered in a text wholly holds one of the text's windows, and windows of it start at every shingle, so
they collide surely; at Jaccard similarity s of the two windows the chance is 1 - (1 - s) ** bands, 0.998 at s = 0.8
with the four bands here. Short templates: windows of one shingle, where a MinHash value is the shingle itself.

The shingle behind a shared MinHash value stands at a known place in the text and at known ones in the template, so it
says where the template would begin. There the candidate is verified: the share of the template's distinct shingles that
stand from a quarter of its length before to a quarter behind must be at least `contains`. Begins closer than half a
template are one occurrence; it has the begin at which most shingles stand in their own place, the first of these.

The template table is a constant of the job (some thousand rows of keys), so it is broadcast; documents are not
shuffled, only verified candidates are grouped. Documents that share a key with a template are cut into overlapping
pieces of some thousand words, and only the words around a hit go with it, so a row's size does not follow a text's.

Edge cases: null and short texts match nothing; rows with the same id and the same text are one document, whatever
their other columns; rows that share an id, or have none, but differ in text are different documents; a template cut off
at the start of a text begins at word 0; templates of fewer than three words are refused; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHINGLE = 5
#: Words of the shortest template.
LEAST = 3
#: Words of a piece of a document, a multiple of every stride in use.
PIECE = 4096

#: Names and wording of public licence notices.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "mit-notice": "Released under the MIT License.",
    "mit-notice-2": "This project is licensed under the MIT License",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "mit-warranty": (
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice "
        "and this permission notice appear in all copies."
    ),
    "isc-warranty": (
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
        "Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be "
        "useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        "See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program."
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free "
        "Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be "
        "useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        "See the GNU Lesser General Public License for more details."
    ),
    "agpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free "
        "Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution."
    ),
    "bsd-3-clause": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission."
    ),
    "bsd-warranty": (
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES "
        "OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
        "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
        "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
        "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
        "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "boost-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "Licensed under CC BY 4.0",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
}

def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def shingles(of: Column, width: int = SHINGLE) -> Column:
    """Hashes of the runs of `width` words, in order; none for fewer."""
    last = F.size(of) - (width - 1)
    each = lambda i: F.xxhash64(*(F.get(of, i + k) for k in range(width)))
    return F.when(last >= 1, F.transform(F.sequence(F.lit(0), last - 1), each)).otherwise(F.array().cast("array<bigint>"))


def let(value: Column, body) -> Column:
    """`body` of a value that is worked out once, however often and at whatever depth the body uses it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def _banded(hashes: Column, band: int) -> Column:
    return F.transform(hashes, lambda h: F.xxhash64(h, F.lit(band)))


def _lowest(values: Column, window: int, stride: int) -> Column:
    """The least value of each window, windows in order; none for fewer values than a window."""
    starts = F.sequence(F.lit(1), F.size(values) - (window - 1), F.lit(stride))
    lows = F.transform(starts, lambda i: F.array_min(F.slice(values, i, window)))
    return F.when(F.size(values) >= window, lows).otherwise(F.array().cast("array<bigint>"))


def template_tables(spark, templates: dict[str, str], window: int, stride: int, bands: int) -> tuple[DataFrame, DataFrame]:
    """Templates with their shingles in order and the distinct ones, and the places of the shingles behind their keys."""
    given = spark.createDataFrame(sorted(templates.items()), "license string, _text string").coalesce(1)
    rows = given.select("license", F.col("_text"), words(F.col("_text")).alias("_w"))
    #: a template of fewer words than a shingle is one of its own length
    whole = F.array(F.xxhash64(*(F.get("_w", F.lit(k)) for k in range(SHINGLE))))
    rows = rows.withColumn("_h", F.when(F.size("_w") < SHINGLE, whole).otherwise(shingles(F.col("_w"))))
    rows = rows.select("license", F.size("_w").alias("_n"), F.array_distinct("_h").alias("_set"), "_h")
    is_long = F.size("_h") >= window + stride - 1
    placed = rows.where(~is_long).select("license", F.posexplode("_h").alias("_at", "key"))
    for b in range(1, bands + 1):
        banded = _banded(F.col("_h"), b)
        least = rows.where(is_long).select("license", let(banded, lambda v: _lowest(v, window, 1)).alias("_lows"), F.posexplode(banded).alias("_at", "key"))
        placed = placed.union(least.where(F.array_contains("_lows", F.col("key"))).select("license", "_at", "key"))
    return rows, placed


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES, contains: float = 0.8, window: int = 8, stride: int = 4, bands: int = 4) -> DataFrame:
    """One row for each place of a template in a document: id, license, first_word, n_words, containment."""
    lengths = {k: len(re.findall("[a-z0-9]+", v.lower())) for k, v in templates.items()}
    short = [k for k, n in lengths.items() if n < LEAST]
    if short:
        raise ValueError(f"templates of fewer than {LEAST} words: {short}")
    slack_of = lambda n: F.greatest(F.ceil(n / 4), F.lit(2)).cast("int")
    #: words before and behind a hit that hold the template, in whole strides
    reach = -(-(max(lengths.values(), default=0) * 5 // 4 + SHINGLE + window + 2) // stride) * stride
    #: shingles of five words, and of the length of each shorter template
    widths = [SHINGLE, *sorted({n for n in lengths.values() if n < SHINGLE})]
    sets, places = template_tables(docs.sparkSession, templates, window, stride, bands)
    #: the optimiser folds this to one constant array
    wanted = F.split(F.lit(",".join(str(r[0]) for r in places.select("key").distinct().collect())), ",").cast("array<bigint>")
    lows = lambda h: [let(_banded(h, b), lambda v: _lowest(v, window, stride)) for b in range(1, bands + 1)]
    keys_of = lambda w: let(shingles(w), lambda h: F.concat(h, *lows(h), *(shingles(w, k) for k in widths[1:])))
    read = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_mark"), words(F.col(text_col)).alias("_w")).where(F.size("_w") >= min(widths))
    held = read.where(F.arrays_overlap(let(F.col("_w"), keys_of), wanted))
    cut = F.transform(F.sequence(F.lit(0), F.size("_w") - 1, F.lit(PIECE)), lambda s: let(F.greatest(s - reach, F.lit(0)), lambda a: F.struct(a.alias("from"), F.slice("_w", a + 1, s - a + PIECE + reach).alias("w"))))
    pieces = held.select("_id", "_mark", F.explode(cut).alias("_c")).select("_id", "_mark", F.col("_c.from").alias("_from"), F.col("_c.w").alias("_w"))

    def hit(p: Column, key: Column) -> Column:
        """The place, band and surrounding words of the p-th key of a piece."""
        count = lambda k: F.greatest(F.size("_w") - (k - 1), F.lit(0))
        singles = count(SHINGLE)
        windows = F.greatest(F.floor((singles - window) / stride) + 1, F.lit(0)).cast("int")
        upto, many = singles + bands * windows, F.greatest(windows, F.lit(1))
        band = F.when((p >= singles) & (p < upto), F.floor((p - singles) / many) + 1).otherwise(0).cast("int")
        place = F.when(p < singles, p).when(p < upto, (p - singles) % many * stride)
        for k in widths[1:]:
            place = place.when(p < upto + count(k), p - upto)
            upto = upto + count(k)
        return let(place, lambda at: let(F.greatest(at - reach, F.lit(0)), lambda a: F.struct(key.alias("key"), band.alias("band"), (at - a).alias("place"), a.alias("from"), F.slice("_w", a + 1, at - a + reach).alias("words"))))

    #: only keys of templates become rows
    own = lambda ks: let(F.array_intersect(ks, wanted), lambda few: F.filter(F.transform(ks, lambda k, i: F.struct(i.alias("p"), k.alias("key"))), lambda x: F.array_contains(few, x["key"])))
    hits = F.transform(let(let(F.col("_w"), keys_of), own), lambda x: hit(x["p"], x["key"]))
    probes = pieces.select("_id", "_mark", "_from", F.explode(hits).alias("_k")).select("_id", "_mark", (F.col("_from") + F.col("_k.from")).alias("_from"), "_k.key", "_k.band", "_k.place", "_k.words")
    found = probes.join(F.broadcast(places.join(sets, "license")), "key")
    runs = shingles(F.col("words"))
    for k in widths[1:]:
        runs = F.when(F.col("_n") == k, shingles(F.col("words"), k)).otherwise(runs)
    found = found.withColumn("_runs", runs)
    #: the least value of a band is that of one shingle in the window
    inside = F.when(F.col("band") > 0, F.array_position(F.transform(F.slice("_runs", F.col("place") + 1, window), lambda h: F.xxhash64(h, F.col("band"))), F.col("key")) - 1).otherwise(0)
    found = found.withColumn("_begin", (F.col("place") + inside - F.col("_at")).cast("int"))
    first, slack = F.greatest("_begin", F.lit(0)), slack_of(F.col("_n"))
    around = F.greatest(F.col("_begin") - slack, F.lit(0))
    upto = F.col("_begin") + F.size("_h") + slack
    shared = F.size(F.array_intersect(F.slice("_runs", around + 1, F.greatest(upto - around, F.lit(0))), "_set"))
    same = F.zip_with(F.slice("_runs", first + 1, F.size("_h")), F.slice("_h", first - F.col("_begin") + 1, F.size("_h")), lambda x, y: x == y)
    near = found.select("_id", "_mark", "license", "_n", F.greatest(F.col("_from") + F.col("_begin"), F.lit(0)).alias("_begin"), shared.alias("_hits"), F.size("_set").alias("_of"), F.size(F.filter(same, lambda x: x)).alias("_same"))
    kept = near.where(F.col("_hits") >= F.lit(contains) * F.col("_of"))
    begins = kept.groupBy("_id", "_mark", "license", "_n", "_begin").agg(F.max(F.struct("_same", F.col("_hits") / F.col("_of"))).alias("_best"))
    order = Window.partitionBy("_id", "_mark", "license").orderBy("_begin")
    apart = F.col("_begin") - F.lag("_begin").over(order) > F.col("_n") / 2
    spots = begins.withColumn("_apart", F.when(apart, 1).otherwise(0)).withColumn("_spot", F.sum("_apart").over(order))
    best = spots.groupBy("_id", "_mark", "license", "_n", "_spot").agg(F.max(F.struct(F.col("_best._same").alias("same"), F.col("_best.col2").alias("share"), (-F.col("_begin")).alias("begin"))).alias("_top"))
    return best.select(
        F.col("_id").alias(id_col),
        "license",
        (-F.col("_top.begin")).cast("long").alias("first_word"),
        F.col("_n").cast("long").alias("n_words"),
        F.col("_top.share").alias("containment"),
    )
