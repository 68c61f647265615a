"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import ascii_lower

#: Public license notices by SPDX identifier, or a family (BSD, GPL) where the words tell no version. Neighbours share under 80 % of a
#: template's shingles, as each template is short around the words that tell them apart.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("AGPL-3.0", "the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("AGPL-3.0", "GNU Affero General Public License, version 3"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-2-Clause", "materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS"),
    ("BSD-3-Clause", "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("CC0-1.0", "CC0 1.0 Universal Public Domain Dedication"),
    ("CC0-1.0", "has waived all copyright and related or neighboring rights"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("GPL-2.0", "the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("GPL-2.0", "GNU General Public License, version 2"),
    ("GPL-3.0", "the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-3.0", "GNU General Public License, version 3"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("LGPL-2.1", "the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License"),
    ("LGPL-2.1", "GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", "the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("LGPL-3.0", "GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MIT-0", "to whom the Software is furnished to do so. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-4-Clause", "All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."),
    ("0BSD", "without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\""),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("WTFPL", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-1.1", "The end-user documentation included with the redistribution, if any, must include the following acknowledgment: \"This product includes software developed by the Apache Software Foundation"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("EPL-1.0", "are made available under the terms of the Eclipse Public License v1.0"),
    ("CDDL-1.0", "Common Development and Distribution License, Version 1.0"),
    ("CDDL-1.0", "The contents of this file are subject to the terms of the Common Development and Distribution License"),
    ("EUPL-1.2", "Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL"),
    ("OFL-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
    ("Artistic-2.0", "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble This license establishes the terms under which a given free software Package may be copied, modified, distributed, and/or redistributed."),
    ("PostgreSQL", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted"),
    ("NCSA", "University of Illinois/NCSA Open Source License"),
    ("MS-PL", "This license governs use of the accompanying software. If you use the software, you accept this license."),
    ("Python-2.0", "PYTHON SOFTWARE FOUNDATION LICENSE VERSION 2"),
    ("GFDL-1.3", "under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation"),
    ("CC-BY-3.0", "This work is licensed under a Creative Commons Attribution 3.0 Unported License."),
    ("CC-BY-SA-3.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
)
SHINGLE = 5
#: Shingles of a text window, and from one window to the next: every place is in eight windows.
WINDOW, STRIDE = 16, 2
#: Bands of a window's one-permutation MinHash: a shingle's band is its hash modulo this.
BANDS = 512


def word_hashes(text: Column) -> Column:
    """Hashes of the lower-cased words: ASCII letters and digits, and every character beyond ASCII."""
    return F.transform(F.split(text, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), lambda w: F.when(w != "", F.xxhash64(w)))


def with_shingles(docs: DataFrame) -> DataFrame:
    """Replace text by _s, the hashes of its five consecutive words; a text of fewer has one shingle, of none none."""
    hashed = docs.withColumn("_w", word_hashes(ascii_lower(F.coalesce("text", F.lit(""))))).drop("text")
    # a text that starts or ends between words has an empty first or last part
    first, last = F.get("_w", F.lit(0)).isNull().cast("int"), F.element_at("_w", -1).isNull().cast("int")
    cut = F.slice("_w", first + 1, F.greatest(F.size("_w") - first - last, F.lit(0)))
    words = hashed.withColumn("_w", cut)
    five = F.transform("_w", lambda w, i: F.xxhash64(w, *[F.get("_w", i + k) for k in range(1, SHINGLE)]))
    return words.withColumn("_s", F.slice(five, F.lit(1), F.when(F.size("_w") == 0, 0).otherwise(F.greatest(F.size("_w") - SHINGLE + 1, F.lit(1))))).drop("_w")


def shown(places: Column) -> Column:
    """Of the shingles at these places those that are the minimum of their band in a window around: what the windows' MinHash shows."""

    def hidden(start: Column, place: Column, own: Column) -> Column:
        """Whether a smaller shingle of the window is in the place's band."""
        others = F.slice("_s", start + 1, F.lit(WINDOW))
        return F.exists(others, lambda x: (x < own) & (F.pmod(x, F.lit(BANDS)) == F.pmod(own, F.lit(BANDS))))

    def in_some_window(place: Column) -> Column:
        last = place - F.pmod(place, F.lit(STRIDE))
        own = F.get("_s", place)
        return reduce(or_, [(start >= 0) & ~hidden(start, place, own) for start in (last - k * STRIDE for k in range(WINDOW // STRIDE))])

    return F.filter(places, in_some_window)


def template_bands(spark: SparkSession, templates) -> DataFrame:
    """Rows (band_min, t, license, held, n, reach) for the minima that the windows of each template show; held are its n distinct shingles."""
    table = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)], "t int, license string, text string")
    found = with_shingles(table).withColumn("_p", F.sequence(F.lit(0), F.size("_s") - 1)).withColumn("_at", shown(F.col("_p")))
    held = F.array_distinct("_s")
    minima = F.explode(F.array_distinct(F.transform("_at", lambda i: F.get("_s", i)))).alias("band_min")
    return found.select("t", "license", held.alias("held"), F.size(held).alias("n"), (F.size(held) + WINDOW).alias("reach"), minima)


def scan_licenses(docs: DataFrame, templates=TEMPLATES, least: float = 0.8) -> DataFrame:
    """Find license notices in whole texts.

    In: text and any other columns; those named like a result are left out. Out: for each input row and license found, the
    input's columns without text, license, containment (the largest, of its templates) and word (the first place of a
    retrieved shingle of the best match).

    A text's five-word shingles are cut into windows of 16, every two. A window's one-permutation MinHash has 512
    bands, each the least hash of the window's shingles that fall into it; a template is retrieved where a band's minimum is one that its own windows show.
    A shared shingle is hidden from a window only by a smaller one in its band, with a probability of at most 15 / 1024, and is lost only if all eight windows hide it, which takes
    its one neighbour in all of them or one before and one behind it: 1 / 1024 + (14 / 1024) ** 2, under 0.2 %. So a one-shingle notice is retrieved with 99.8 %, and one of more misses only
    if all it shares are hidden. A retrieved template is verified exactly: the share of its distinct shingles in the text around the place, as far as the
    template and a window reach, ``least`` or more.

    Null or empty text has no words and no matches; repeated rows each have their matches; an empty table gives an
    empty table; a very long text is one row of array functions. The templates are a table of a row per band minimum, broadcast: it has at most as many rows as the templates have words,
    whatever the corpus. Minima that no template has are left out before they become rows. DataFrame functions only; matches alone are shuffled.
    """
    if "text" not in docs.columns:
        raise ValueError("docs need a text column")
    docs = docs.drop("license", "containment", "word", "_w", "_s", "_p", "_at", "_m", "_i")
    bands = template_bands(docs.sparkSession, templates)
    listed = bands.agg(F.array_sort(F.collect_set("band_min")).alias("all"), F.max("reach").alias("reach")).first()
    others = [c for c in docs.columns if c != "text"]
    places = F.filter(F.transform("_s", lambda s, i: F.when(s.isin(*listed["all"]), i)), lambda i: i.isNotNull())
    docs = docs.withColumn("_i", F.monotonically_increasing_id())
    found = with_shingles(docs).withColumn("_p", places).withColumn("_at", shown(F.col("_p")))
    first = lambda i: F.greatest(i - listed.reach, F.lit(0))
    match = lambda i: F.struct(i.alias("place"), F.get("_s", i).alias("band_min"), first(i).alias("from"), F.slice("_s", first(i) + 1, F.lit(2 * listed.reach)).alias("around"))
    # explode_outer, since Spark would repeat an array's computation to leave out rows that explode to nothing
    rows = found.select("_i", F.struct(*[F.col(c) for c in others], F.lit(0).alias("_")).alias("_row"), F.explode_outer(F.transform("_at", match)).alias("_m"))
    rows = rows.filter(F.col("_m").isNotNull()).select("_i", "_row", "_m.*").join(F.broadcast(bands), "band_min")
    start = F.greatest(F.col("place") - F.col("reach"), F.lit(0))
    near = F.slice("around", start - F.col("from") + 1, F.col("place") + F.col("reach") - start)
    share = F.size(F.array_intersect(near, "held")) / F.col("n").cast("double")
    verified = rows.select("_i", "_row", "license", share.alias("containment"), F.col("place").cast("long").alias("word")).filter(F.col("containment") >= least)
    best = verified.groupBy("_i", "license").agg(F.first("_row").alias("_row"), F.max(F.struct("containment", (-F.col("word")).alias("back"))).alias("_b"))
    return best.select(*[F.col("_row").getField(c).alias(c) for c in others], "license", F.col("_b.containment").alias("containment"), (-F.col("_b.back")).alias("word"))
