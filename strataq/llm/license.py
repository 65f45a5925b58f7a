"""License scans: the Dice coefficient over word bigrams, of stretches of a text with each template.

Texts are normalised to lower-case words, so line breaks, comment signs and wrapping don't count. Of a stretch
with ``a`` bigrams and a template with ``b``, that share ``m`` (repeats counted as often as both have them), Dice
is ``2 m / (a + b)``. A template's score in a text is the best over all stretches of the text, whatever stands
around them and however long the text is.

As m is at most min(a, b), the threshold t can be reached only with ``t b / (2 - t) <= a <= b (2 - t) / t`` and
``m >= t b / (2 - t)``. These bounds say which templates a text is held against (those of which it has so many
bigrams), where a stretch can begin (where so many follow within the longest stretch) and where it must end. A
text must also hold some of the templates' rarer words, so most texts are passed over by one pattern, and bigrams
that no template has are dropped before anything is shuffled. Built-in functions only.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle

THRESHOLD = 0.8
#: What rounding may take from a bound, so that a stretch just at the threshold passes.
SLACK = 1e-6

#: Notices and license texts by SPDX identifier (fixed values: the wording in public use). Some have several.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'),
    ("BSD-3-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("proprietary", "All rights reserved."),
)


def normal_words(text: Column) -> Column:
    """Lower case; words are runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def bigrams(words: Column) -> Column:
    """Pairs of neighbouring words in order; a single word is a pair with nothing."""

    def pairs(w: Column) -> Column:  # of words computed once
        made = F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat(F.get(w, i - 1), F.lit(" "), F.get(w, i)))
        return F.when(F.size(w) > 1, made).otherwise(w)

    return F.transform(F.array(words), pairs)[0]


def needed(b: int, threshold: float) -> int:
    """Bigrams of a template with ``b`` that a stretch at the threshold shares, at least."""
    return max(1, math.ceil(threshold * b / (2 - threshold) - SLACK))


def longest(b: int, threshold: float) -> int:
    """Bigrams of a stretch that can reach the threshold with a template of ``b``, at most."""
    return math.floor(b * (2 - threshold) / threshold + SLACK)


def notice_pairs(notice: str) -> Counter[tuple[str, ...]]:
    words = re.findall(r"[^\W_]+", notice.lower())
    return Counter(zip(words, words[1:], strict=False)) or Counter([tuple(words)])


def template_table(spark: SparkSession, templates: tuple[tuple[str, str], ...], threshold: float) -> DataFrame:
    """gram, times (in the template), template, license, b, need, most: a row for each bigram, from literals."""
    rows = []
    for k, (name, notice) in enumerate(templates):
        pairs = notice_pairs(notice)
        b = sum(pairs.values())
        grams = F.array(*[F.struct(F.lit(" ".join(p)).alias("gram"), F.lit(n).alias("times")) for p, n in pairs.items()])
        rows.append(F.struct(F.lit(k).alias("template"), F.lit(name).alias("license"), F.lit(b).alias("b"), F.lit(needed(b, threshold)).alias("need"), F.lit(longest(b, threshold)).alias("most"), grams.alias("grams")))
    each = spark.range(1).select(F.explode(F.array(*rows)).alias("t")).select("t.*")
    return each.withColumn("g", F.explode("grams")).select("g.gram", "g.times", "template", "license", "b", "need", "most")


def anchors(templates: tuple[tuple[str, str], ...], threshold: float) -> list[str]:
    """Words of which every text has one, in lower case, that reaches the threshold with some template.

    A stretch shares ``needed`` bigrams of b. So if words cover one bigram more than it may miss, the text holds
    one of those words. They are chosen greedily over all templates, long words first, which are rare elsewhere.
    """
    open_pairs: list[tuple[int, Counter]] = []
    for _, notice in templates:
        pairs = notice_pairs(notice)
        b = sum(pairs.values())
        open_pairs.append((b - needed(b, threshold) + 1, pairs))
    chosen: list[str] = []
    while any(n > 0 for n, _ in open_pairs):
        gain: dict[str, float] = {}
        for n, pairs in open_pairs:
            for w in {w for p in pairs for w in p} if n > 0 else ():
                rare = 1.0 if len(w) >= 7 else 0.3 if len(w) >= 5 else 0.02
                gain[w] = gain.get(w, 0) + rare * min(n, sum(c for p, c in pairs.items() if w in p))
        best = max(gain, key=lambda w: (gain[w], w))
        chosen.append(best)
        open_pairs = [(n - sum(c for p, c in pairs.items() if best in p), Counter({p: c for p, c in pairs.items() if best not in p})) for n, pairs in open_pairs]
    return [w for w in chosen if not any(o != w and o in w for o in chosen)]


def holds_any(text: Column, words: list[str]) -> Column:
    """Whether the text, in lower case, has one of the words as a part."""
    return F.transform(F.array(F.lower(text)), lambda t: reduce(lambda a, w: a | F.contains(t, F.lit(w)), words[1:], F.contains(t, F.lit(words[0]))))[0]


def _best_stretch(hits: Column, b: Column, need: Column, most: Column) -> Column:
    """(dice, first, last) of the best stretch; ``hits`` (pos, before) in order: places of the template's bigrams
    in a text, and where the bigram stood so many times before that within one stretch it counts no more.

    A best stretch begins and ends with a hit. From each beginning that ``need`` hits follow closely enough, the
    hits within ``most`` places are gone through, and the best end is kept. Equal scores: the earliest.
    """
    nothing = F.struct(F.lit(0.0).alias("dice"), F.lit(0).alias("first"), F.lit(0).alias("last"))

    def ends(start: Column, i: Column, best: Column) -> Column:
        state = F.struct(F.lit(0).alias("m"), best.alias("best"))

        def end(acc: Column, x: Column) -> Column:
            m = acc["m"] + F.when(x["before"] < start, 1).otherwise(0)
            dice = F.lit(2.0) * m / (x["pos"] - start + 1 + b)
            inside = x["pos"] < start + most
            here = F.struct(dice.alias("dice"), start.alias("first"), x["pos"].alias("last"))
            return F.struct(m.alias("m"), F.when(inside & (dice > acc["best"]["dice"]), here).otherwise(acc["best"]).alias("best"))

        return F.aggregate(F.slice(hits, i + 1, most), state, end, lambda acc: acc["best"])

    def begin(best: Column, i: Column) -> Column:
        start = F.get(hits, i)["pos"]
        dense = (F.get(hits, i + need - 1)["pos"] < start + most) & (best["dice"] < 1)
        return F.when(dense, ends(start, i, best)).otherwise(best)

    return F.aggregate(F.sequence(F.lit(0), F.size(hits) - need), nothing, begin)


def scan(docs: DataFrame, threshold: float = THRESHOLD, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """(doc_id, text_key, license, dice, first, last): each license of which a stretch of the text reaches the
    threshold with a template, its best score, and the stretch as places of bigrams in the normalised text.

    A license whose best stretch meets that of another with a better score is left out (a notice of the LGPL is
    not one of the GPL, though most of its words are).
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    held = docs.filter(holds_any(text, anchors(templates, threshold)))
    keyed = held.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), F.posexplode(bigrams(normal_words(text))).alias("pos", "gram"))
    # the templates are literals of this module or of the caller: a bounded side
    met = keyed.join(F.broadcast(template_table(docs.sparkSession, templates, threshold)), "gram")
    per = met.groupBy("doc_id", "text_key", "template", "license", "b", "need", "most").agg(F.collect_set(F.struct("gram", "pos", "times")).alias("hits"))
    per = per.filter(F.size("hits") >= F.col("need"))
    # where the bigram stood ``times`` times before: of the hits by bigram, so many places earlier
    def before(h: Column, i: Column, hits: Column) -> Column:
        earlier = F.get(hits, i - h["times"])
        return F.struct(h["pos"].alias("pos"), F.when((i >= h["times"]) & (earlier["gram"] == h["gram"]), earlier["pos"]).otherwise(-1).alias("before"))

    ready = per.withColumn("hits", F.transform(F.array(F.sort_array("hits")), lambda hits: F.sort_array(F.transform(hits, lambda h, i: before(h, i, hits))))[0])
    found = ready.withColumn("best", _best_stretch(F.col("hits"), F.col("b"), F.col("need"), F.col("most"))).filter(F.col("best.dice") >= threshold)
    each = found.groupBy("doc_id", "text_key", "license").agg(F.max(F.struct("best.dice", (-F.col("best.first")).alias("early"), "best.last")).alias("s"))
    together = each.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("license", "s.dice", (-F.col("s.early")).alias("first"), "s.last")).alias("all"))  # a license each, at most

    def beaten(x: Column) -> Column:
        return F.exists("all", lambda y: (y["dice"] > x["dice"]) & (y["first"] <= x["last"]) & (x["first"] <= y["last"]))

    return together.select("doc_id", "text_key", F.explode(F.filter("all", lambda x: ~beaten(x))).alias("x")).select("doc_id", "text_key", "x.*")


def licenses(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of ``docs``: doc_id, license (of the best match, null if none), score, n_matches
    (licenses found), licenses (all found, sorted, comma-joined, null if none).

    Equal scores: the license first by name. Null and empty texts match nothing. Repeated rows each get the
    same answer. An empty table gives an empty result; other columns are ignored.
    """
    found = scan(docs, threshold).groupBy("doc_id", "text_key").agg(
        F.min(F.struct((-F.col("dice")).alias("minus"), "license")).alias("best"), F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("license")), ",").alias("names")
    )
    found = settle(found).withColumnsRenamed({"doc_id": "_id", "text_key": "_key"})
    key = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"))
    joined = base.join(found, base["doc_id"].eqNullSafe(found["_id"]) & (F.col("key") == F.col("_key")), "left")
    return joined.select("doc_id", F.col("best.license").alias("license"), (-F.col("best.minus")).alias("score"), F.coalesce("n", F.lit(0)).alias("n_matches"), F.col("names").alias("licenses"))
