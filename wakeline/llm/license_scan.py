"""Licence scans with DataFrame functions only.

Each line and each block of consecutive lines of a whole text (headers), and each whole
text (a licence file), is a sparse TF-IDF vector over all its terms; its cosine to licence
templates decides what it declares.  Rows without a licence of their own inherit that of
the nearest ancestor directory with a licence file, by joins on directory paths.

1. One pass counts the documents of every term, summed before the shuffle.
2. A second pass finds the templates' terms in each line; blocks and whole texts are sums
   of lines.  Every weight is 1 at least, so other terms add at least their number to the
   squared norm: units whose cosine cannot reach the threshold go here.
3. Only the others meet the weights of all their terms, which give their exact norms.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .base import cut, discard, small_side

# Notices, standard headers and texts of common licences, by SPDX identifier.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."),
    ("ISC", "Released under the ISC License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]
#: Words left out of all vectors.
STOP = ["a", "an", "and", "any", "are", "as", "at", "be", "but", "by", "either", "for", "from", "if", "in", "into", "is", "it", "its", "may", "not", "of", "on", "one", "or", "other", "see", "shall", "that", "the", "these", "this", "to", "under", "use", "used", "we", "which", "will", "with", "without", "work", "you"]
#: What separates blocks of lines.
BLANK_LINES = r"\n[\x20\x09-\x0D]*\n"


def templates() -> list[tuple[str, str]]:
    """(licence, text) of all templates: those above, and the tag of each identifier."""
    return TEMPLATES + [(x, f"SPDX-License-Identifier: {x}") for x in sorted({x for x, _ in TEMPLATES})]


def terms(text: Column) -> Column:
    """The words of a text in order, without stop words."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+", -1), lambda x: ~x.isin("", *STOP))


def _template_terms() -> list[tuple[int, str, str, int]]:
    """(tid, licence, term, count) of the templates."""
    words = [(i, x, [w for w in re.split("[^a-z0-9]+", t.lower()) if w and w not in STOP]) for i, (x, t) in enumerate(templates())]
    return [(i, x, w, ws.count(w)) for i, x, ws in words for w in dict.fromkeys(ws)]


def scan(docs: DataFrame, path: Column, header_min: float = 0.8, file_min: float = 0.5, is_licence_file: Column | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, path, license, how, score, license_dir.

    how is ``file`` (the whole text is a licence: cosine of at least ``file_min``),
    ``header`` (its best line or block of lines has at least ``header_min``),
    ``inherited`` (from license_dir, the nearest ancestor directory with a licence file)
    or ``none``.  A licence file is a row with how ``file``, or for which
    ``is_licence_file`` holds and a header was found; its directory's best score wins,
    then the smallest licence.  Ties between templates go to the smallest identifier.
    Null or empty texts declare nothing but inherit; a null path has no directory, a path
    without one lies in the root, whose licence file grants to all; null ids are judged
    as any other, rows of equal id and text once; every row comes back; repeated rows
    count as documents each; no rows give no rows.
    """
    spark = docs.sparkSession
    flag = F.coalesce(is_licence_file, F.lit(False)) if is_licence_file is not None else F.lit(False)
    key = F.to_json(F.struct(F.col(doc_id).alias("d")))
    base = docs.select(F.col(doc_id).alias("doc_id"), key.alias("k"), path.alias("path"), flag.alias("named"), F.xxhash64(text).alias("h"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    n = docs.count()
    df = base.select(F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    df = cut(df, "terms")
    idf = F.log((F.lit(n) + 1.0) / (F.coalesce("df", F.lit(0)) + 1)) + 1
    template = spark.createDataFrame(_template_terms(), "tid int, license string, term string, tf int")
    vocabulary = sorted({t[2] for t in _template_terms()})
    weighted = template.join(F.broadcast(df.filter(F.col("term").isin(vocabulary))), "term", "left").withColumn("w", F.col("tf") * idf)
    weighted = cut(weighted.select("tid", "license", "term", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("tid")))).alias("tw"), idf.alias("idf")), "templates")

    # the templates' terms in each line, block of lines (line -1) and whole text (block -1)
    split = F.transform(F.split("text", BLANK_LINES, -1), lambda b: F.transform(F.split(b, "\n", -1), lambda x: terms(x)))
    in_block = lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + F.size(x))
    blocks = base.select("k", "h", split.alias("blocks")).withColumn("n_doc", F.aggregate("blocks", F.lit(0), lambda n, b: n + in_block(b)))
    lines = blocks.select("k", "h", "n_doc", F.posexplode("blocks").alias("block", "lines")).select("k", "h", "n_doc", "block", in_block(F.col("lines")).alias("n_block"), F.posexplode("lines").alias("line", "words"))
    words = lines.select("k", "h", "n_doc", "block", "n_block", "line", F.size("words").alias("n_line"), F.explode("words").alias("term")).filter(F.col("term").isin(vocabulary))
    # rows of equal id and text say the same, so one of them counts
    held = words.groupBy("k", "h", "n_doc", "block", "n_block", "line", "n_line", "term").agg(F.count(F.lit(1)).alias("tf"))
    copies = base.groupBy("k", "h").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    held = cut(held.join(small_side(cut(copies, "copies"), 64), ["k", "h"], "left").withColumn("tf", (F.col("tf") / F.coalesce("copies", F.lit(1))).cast("long")).drop("copies"), "held")
    none = F.lit(-1)
    unit = F.explode(F.array(
        F.struct(F.col("block").alias("block"), F.col("line").alias("line"), F.col("n_line").alias("n")),
        F.struct(F.col("block").alias("block"), none.alias("line"), F.col("n_block").alias("n")),
        F.struct(none.alias("block"), none.alias("line"), F.col("n_doc").alias("n")),
    )).alias("u")
    at = ["k", "h", "block", "line"]
    units = held.select("k", "h", "term", "tf", unit).groupBy("k", "h", "u.block", "u.line", "u.n", "term").agg(F.sum("tf").alias("tf"))
    met = units.join(F.broadcast(weighted), "term").withColumn("w", F.col("tf") * F.col("idf"))
    dots = met.groupBy(*at, "license", "tid").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    # other terms weigh 1 at least
    weights = weighted.select("term", "idf").distinct()
    room = units.join(F.broadcast(weights), "term").groupBy(*at, "n").agg((F.sum((F.col("tf") * F.col("idf")) ** 2) + F.col("n") - F.sum("tf")).alias("room"))
    least = F.when(F.col("block") < 0, file_min).otherwise(header_min)
    could = cut(dots.join(room.drop("n"), at).filter(F.col("dot") / F.sqrt("room") >= least - 1e-5).select(*at, "license", "tid", "dot"), "could")

    # all terms of the units that could reach the threshold, for their exact norms
    asked = cut(could.select(*at).distinct(), "asked")
    whose = small_side(cut(asked.select("k", "h").distinct(), "whose"), 64)
    again = blocks.join(whose, ["k", "h"], "left_semi").dropDuplicates(["k", "h"]).select("k", "h", F.posexplode("blocks").alias("block", "lines"))
    again = again.select("k", "h", "block", F.posexplode("lines").alias("line", "words")).select("k", "h", "block", "line", F.explode("words").alias("term"))
    of_unit = again.select("k", "h", "term", F.explode(F.array(F.struct("block", "line"), F.struct(F.col("block"), none.alias("line")), F.struct(none.alias("block"), none.alias("line")))).alias("u"))
    tf = of_unit.select("k", "h", "u.block", "u.line", "term").join(small_side(asked, 72), at, "left_semi").groupBy(*at, "term").agg(F.count(F.lit(1)).alias("tf"))
    tf = cut(tf, "units")
    known = df.join(small_side(cut(tf.select("term").distinct(), "known"), 24), "term", "left_semi").select("term", idf.alias("idf"))
    norms = tf.join(small_side(cut(known, "weights"), 32), "term").groupBy(*at).agg(F.sqrt(F.sum((F.col("tf") * F.col("idf")) ** 2)).alias("norm"))
    hits = could.join(norms, at).withColumn("score", F.round(F.col("dot") / F.col("norm"), 6)).filter(F.col("score") >= least)
    best = lambda whole: F.max(F.when((F.col("block") < 0) == whole, F.struct("score", (-F.col("tid")).alias("t"), "license")))
    own = hits.groupBy("k", "h").agg(best(True).alias("f"), best(False).alias("l"))
    own = own.select(F.col("k").alias("_k"), F.col("h").alias("_h"), F.coalesce("f.license", "l.license").alias("license"), F.coalesce("f.score", "l.score").alias("score"), F.when(F.col("f").isNotNull(), "file").otherwise("header").alias("how"))
    own = cut(own, "declared")
    rows = base.drop("text").join(small_side(own, 80), (F.col("k") == F.col("_k")) & (F.col("h") == F.col("_h")), "left")
    rows = cut(rows.select("doc_id", "path", "named", "license", "score", "how", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir")), "own")
    discard(df, held, could, asked, tf, own)

    granting = (
        rows.filter("license is not null and dir is not null and (how = 'file' or named)")
        .groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "license"))["license"].alias("gl"))
    )
    granting = cut(granting.select(F.col("dir").alias("gdir"), "gl"), "grants")
    # ancestors of distinct directories, so that a crowded directory joins once
    dirs = rows.filter("license is null and dir is not null").select("dir").distinct()
    parts = F.split("dir", "/", -1)
    above = dirs.select("dir", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")))).alias("up"))
    nearest = cut(above.join(small_side(granting, 100), F.col("up") == F.col("gdir")).groupBy("dir").agg(F.max_by(F.struct("gdir", "gl"), F.length("up")).alias("g")).select(F.col("dir").alias("nd"), "g"), "nearest")
    out = rows.join(small_side(nearest, 200), (F.col("dir") == F.col("nd")) & F.col("license").isNull(), "left")
    return out.select(
        "doc_id", "path", F.coalesce("license", F.col("g.gl")).alias("license"),
        F.coalesce("how", F.when(F.col("g").isNotNull(), "inherited"), F.lit("none")).alias("how"),
        "score", F.col("g.gdir").alias("license_dir"),
    )
