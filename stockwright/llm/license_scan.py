"""License scans: MinHash bands over overlapping windows, then containment.

Texts and templates are cut into words (lower case, runs of letters and
digits) and shingles of five words, each hashed once. Templates are put into
classes of length, powers of two: class C has the templates of more than C / 2
and at most C shingles. Its windows have 2 C shingles and start at every C / 2-th
one, so a run of 3 C / 2 shingles lies whole in one of them wherever it stands: a
template with insertions of up to half its length does.

Windows and templates get MinHash signatures of ``BANDS`` bands of one value. A
window that shares a band with a template of its class is a candidate, and exact
containment decides: at least 80 % of the template's distinct shingles stand in
the window. Band settings: such a window has a Jaccard similarity of 0.8 T over
2 C + 0.2 T or more, above 0.19 for the shortest T of a class, so it shares a
band with probability 1 - (1 - 0.19)^64 or more, above 0.999998.

Which windows must be signed follows from the bands: a window's minimum equals
a template's only where the template's minimal shingle of that band stands in
it. The templates' minimal shingles (``anchors``, at most ``BANDS`` a template) are a
table, and only windows around one of them are built; all others share no band.
Signing every window (``every``) finds the same and costs far more. Texts
without an anchor are told by one pass that hashes each text and moves none.

Everything is DataFrame functions. Results: one row per (row of docs, template
found): doc_id, license, containment (of the best window), first_shingle (start
of the first such window), n_windows. Null and empty texts and texts under five
words match nothing; templates under five words neither; repeated rows give
repeated results (rows are told apart by a row number); other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch
from .filters import candidates

SHINGLE = 5
CONTAINMENT = 0.8
BANDS = 64
#: Templates up to which their bands are broadcast (a row of 24 bytes a band).
BROADCAST = 20_000

# Notices as they are printed in files, from the public licence texts.
TEMPLATES: dict[str, str] = {
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."
    ),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the "
        "License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License "
        "for the specific language governing permissions and limitations under the License."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in "
        "the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE."
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."
    ),
    "MIT-notice": "Licensed under the MIT License.",
    "MIT-line": "This project is licensed under the terms of the MIT license.",
    "Apache-2.0-line": "This project is licensed under the Apache License 2.0.",
    "Apache-2.0-terms": "distributed under the terms of the Apache License, Version 2.0",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-line": "Released under the GNU General Public License.",
    "LGPL": "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "LGPL-line": "Licensed under the GNU Lesser General Public License.",
    "AGPL": "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "AGPL-line": "Licensed under the GNU Affero General Public License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "MPL-line": "Licensed under the Mozilla Public License, version 2.0.",
    "BSD-line": "Licensed under the BSD 3-Clause License.",
    "BSD-2-line": "Licensed under the BSD 2-Clause License.",
    "BSD-style": "Use of this source code is governed by a BSD-style license",
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies."
    ),
    "ISC": "Licensed under the ISC License.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "CC0-line": "Licensed under CC0 1.0 Universal.",
    "CC-BY-line": "Licensed under CC BY 4.0.",
    "CC-BY-SA-line": "Licensed under CC BY-SA 4.0.",
    "CC-BY-SA-4.0": "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC-BY-NC-long": "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "CC-BY-ND-line": "Licensed under CC BY-ND 4.0.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "Boost-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "WTFPL": "Do What The Fuck You Want To Public License",
    "Artistic-2.0": "Licensed under the Artistic License 2.0.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "all-rights-reserved": "All rights reserved. No part of this publication may be reproduced",
}


def shingle_hashes(text: Column) -> Column:
    """Hashes of the five-word shingles of a text, in order."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), "")
    # the array is bound once, so that each shingle reads five places of it
    return F.transform(F.array(words), lambda w: F.transform(F.slice(w, 1, F.greatest(F.size(w) - (SHINGLE - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, SHINGLE)])))[0]


def _least(hashes: Column, band: int) -> Column:
    """(value, shingle) of a set of shingle hashes: its minimum in one band."""
    return F.array_min(F.transform(hashes, lambda h: F.struct(F.xxhash64(h, F.lit(band)).alias("value"), h.alias("shingle"))))


def _values(hashes: Column) -> Column:
    """Array of the band values of a set of shingle hashes."""

    def value(band: int) -> Column:
        return F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, F.lit(band))))

    return F.array(*[value(k) for k in range(BANDS)])


def _anchors(shingles: Column) -> Column:
    """The shingles whose hashes are a set's band values."""
    return F.array_distinct(F.array(*[_least(shingles, k)["shingle"] for k in range(BANDS)]))


def template_table(spark: SparkSession, texts: Mapping[str, str] | DataFrame) -> DataFrame:
    """(license, shingles, class): distinct shingle hashes of each template and
    its class of length. Texts are a mapping or a table (license, text)."""
    rows = texts if isinstance(texts, DataFrame) else spark.createDataFrame(list(texts.items()), "license string, text string")
    hashed = rows.select("license", shingle_hashes(F.col("text")).alias("all")).where(F.size("all") > 0)
    power = F.ceil(F.log2(F.size("all").cast("double"))).cast("int")
    return hashed.select("license", F.array_distinct("all").alias("shingles"), F.call_function("shiftleft", F.lit(1), power).alias("class"))


def _windows(position: Column, size: Column, step: Column) -> Column:
    """Numbers of the windows that a place lies in."""
    first = F.greatest(F.floor((position - size + step) / step).cast("int"), F.lit(0))
    return F.sequence(first, F.floor(position / step).cast("int"))


def scan(docs: DataFrame, texts: Mapping[str, str] | DataFrame = TEMPLATES, id_col: str = "doc_id", text_col: str = "text", every: bool = False) -> DataFrame:
    """Licences found in each row of docs."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "license")
    known = scratch.keep(template_table(spark, texts), "templates")
    small = F.broadcast if known.count() <= BROADCAST else (lambda df: df)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if every:
        holders = scratch.keep(rows.select("doc_id", shingle_hashes(F.col("text")).alias("hashes"), F.monotonically_increasing_id().alias("row")), "holders")
        near = holders.select("row", F.posexplode("hashes").alias("at", "shingle")).join(small(known.select("class").distinct()))
    else:
        anchors = scratch.keep(known.select("class", F.explode(_anchors(F.col("shingles"))).alias("shingle")).distinct(), "anchors")
        keyed = rows.withColumn("digest", F.xxhash64("text"))
        seen = keyed.select("digest", F.explode(shingle_hashes(F.col("text"))).alias("shingle")).join(small(anchors.select("shingle").distinct()), "shingle", "left_semi")
        held = candidates(scratch, keyed, scratch.keep(seen.select("digest").distinct(), "seen"))
        # a table, so that row numbers are settled
        holders = scratch.keep(held.select("doc_id", shingle_hashes(F.col("text")).alias("hashes"), F.monotonically_increasing_id().alias("row")), "holders")
        near = holders.select("row", F.posexplode("hashes").alias("at", "shingle")).join(small(anchors), "shingle")
    size, step = 2 * F.col("class"), F.greatest(F.shiftright("class", 1), F.lit(1))
    windows = near.select("row", "class", F.explode(_windows(F.col("at"), size, step)).alias("n")).distinct()
    windows = windows.join(holders, "row").select("row", "doc_id", "class", (F.col("n") * step).alias("start"), F.array_distinct(F.slice("hashes", F.col("n") * step + 1, size)).alias("window"))
    banded = small(known.select("license", "shingles", "class", F.posexplode(_values(F.col("shingles"))).alias("band", "value")))
    # the window's own values once, then a row per band; what matched is compared once per template
    signed = windows.where(F.size("window") > 0).select("*", F.posexplode(_values(F.col("window"))).alias("band", "value"))
    found = signed.join(banded, ["class", "band", "value"]).dropDuplicates(["row", "class", "start", "license"])
    part = F.size(F.array_intersect("shingles", "window")) / F.size("shingles")
    found = found.select("row", "doc_id", "license", "start", part.alias("containment")).where(F.col("containment") >= CONTAINMENT)
    best = F.min(F.struct((-F.col("containment")).alias("c"), "start")).alias("best")
    out = found.groupBy("row", "doc_id", "license").agg(best, F.count(F.lit(1)).alias("n_windows"))
    return out.select("doc_id", "license", (-F.col("best.c")).alias("containment"), F.col("best.start").alias("first_shingle"), "n_windows")
