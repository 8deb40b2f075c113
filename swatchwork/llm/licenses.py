"""License scans by diagonal voting, with DataFrame functions alone.

Every pair of neighbouring words of a text is joined to the places where it stands in a template. A hit votes for the
diagonal text position minus template position. Votes are summed by diagonal; neighbouring diagonals, which words put in
or left out bring about, are merged; and a merged span is verified by how much of its template it covers in how many
words. Short phrases must stand word for word, on one diagonal.

Templates are a small fixed table, so the join of all the corpus's word pairs needs no shuffle, and only hits move.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from swatchwork.llm import common

#: Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Further phrases, word for word as well.
MORE_PHRASES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "all rights reserved": "proprietary",
}
#: Sentences of license texts and headers, which may be worn.
TEXTS = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis": "apache",
    "this program is free software you can redistribute it and or modify it under the terms of the": "gpl",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
#: Whole license texts and headers, by name and label.
WHOLE = {
    ("MIT", "mit"): """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
        in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
        and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included
        in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
        WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR
        OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ("BSD-2-Clause", "bsd"): """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must
        reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
        SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
        INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE
        USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ("BSD-3-Clause, third", "bsd"): """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software
        without specific prior written permission.""",
    ("ISC", "isc"): """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and
        this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER
        RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
        PERFORMANCE OF THIS SOFTWARE.""",
    ("Zlib", "zlib"): """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this
        software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the
        following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a
        product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be
        misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
    ("Apache-2.0 header", "apache"): """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a
        copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is
        distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
        limitations under the License.""",
    ("GPL header", "gpl"): """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
        Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
        without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy
        of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    ("MPL-2.0 header", "mpl"): """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can
        obtain one at https://mozilla.org/MPL/2.0/.""",
    ("Unlicense", "unlicense"): """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this
        software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws,
        the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at
        large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this
        software under copyright law.""",
    ("BSL-1.0", "boost"): """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this
        license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit
        third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above
        license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software,
        unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.""",
}
#: Word pairs of two such words stand in any text and cast no vote for longer texts.
PLAIN = set("a above all an and any are as at be by for free in is it may of on or shall that the this to under use with without you".split())
COVERAGE, STRETCH, NEIGHBOURS = 0.6, 1.6, 4
_WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_STOP = " "


def templates(spark: SparkSession) -> DataFrame:
    """(kind, template, label, pairs, words, place, first, second): a row for each voting word pair of each template; bounded by the tables above."""
    rows = []
    given = [(kind, text, label, text) for kind, table in (("base", PHRASES), ("phrase", MORE_PHRASES), ("text", TEXTS)) for text, label in table.items()]
    given += [("text", name, label, text) for (name, label), text in WHOLE.items()]
    for kind, name, label, text in given:
        words = [w for w in re.split(_WORD_BREAK, text.lower()) if w]
        pairs = [(k, a, b) for k, (a, b) in enumerate(zip(words, words[1:], strict=False)) if kind != "text" or not {a, b} <= PLAIN]
        rows += [f"('{kind}', '{name}', '{label}', {len(pairs)}, {len(words)}, {k}, '{a}', '{b}')" for k, a, b in pairs]
    rows.append(f"('end', '', '', 1, 0, 0, '{_STOP}', '{_STOP}')")
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(kind, template, label, pairs, words, place, first, second)")


def license_scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans), a row for each row of ``docs`` (doc_id, text).

    Words are runs of letters and digits, A-Z lower-cased. ``n_base`` counts places of PHRASES, with their first and
    last start; ``labels`` adds those of the other templates. ``score`` is the best coverage of a template that was
    found, ``spans`` has (label, template, begin, end, coverage) of all of them. Null and empty texts have no words, no
    labels (an empty string) and score 0. Whole texts are read; repeated rows give repeated results; other columns are
    not looked at; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    words = F.array_remove(F.split(F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), _WORD_BREAK), "")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.concat(words, F.array(F.lit(_STOP), F.lit(_STOP))).alias("w"))
    pairs = rows.select("doc_id", "row", F.posexplode(F.arrays_zip(F.col("w").alias("a"), F.slice("w", F.lit(2), F.size("w")).alias("b"))).alias("at", "pair"))
    pairs = pairs.select("doc_id", "row", "at", F.col("pair.a").alias("a"), F.col("pair.b").alias("b"), F.xxhash64("pair.a", "pair.b").alias("h"))
    known = templates(spark).withColumn("h", F.xxhash64("first", "second"))
    hits = pairs.join(F.broadcast(known), "h").where("a = first and b = second")
    # votes of each diagonal; the end of a text is a template of its own and tells its length
    key = ["doc_id", "row", "kind", "template", "label", "pairs", "words"]
    diagonals = hits.groupBy(*key, (F.col("at") - F.col("place")).alias("diagonal")).agg(F.count("*").alias("votes"), F.min("at").alias("lo"), F.max("at").alias("hi"), F.collect_set("place").alias("places"))
    # neighbouring diagonals of a template, where they stand near each other too
    line = Window.partitionBy(*key).orderBy("diagonal")
    apart = (F.col("diagonal") - F.lag("diagonal").over(line) > NEIGHBOURS) | (F.abs(F.col("lo") - F.lag("hi").over(line)) > F.col("words")) | (F.col("kind") != "text")
    runs = diagonals.withColumn("run", F.sum(F.when(apart, 1).otherwise(0)).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy(*key, "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.flatten(F.collect_list("places")).alias("places"))
    coverage = F.size(F.array_distinct("places")) / F.col("pairs")
    runs = runs.withColumn("coverage", coverage)
    whole = F.when(F.col("kind") == "text", (F.col("coverage") >= COVERAGE) & (F.col("hi") - F.col("lo") + 2 <= F.col("words") * STRETCH)).otherwise(F.col("coverage") == 1)
    span = F.struct("label", "template", F.col("lo").cast("long").alias("begin"), (F.col("hi") + 2).cast("long").alias("end"), "coverage")
    base, found = F.col("kind") == "base", F.col("kind") != "end"
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    return (
        runs.where(whole)
        .groupBy("doc_id", "row")
        .agg(
            F.max(F.when(~found, F.col("lo"))).cast("long").alias("n_words"),
            F.count(F.when(base, 1)).alias("n_base"),
            F.min(F.when(base, F.col("lo"))).cast("long").alias("first_word"),
            F.max(F.when(base, F.col("lo"))).cast("long").alias("last_word"),
            joined(F.collect_set(F.when(base, F.col("label")))).alias("base_labels"),
            joined(F.collect_set(F.when(found, F.col("label")))).alias("labels"),
            F.coalesce(F.max(F.when(found, F.col("coverage"))), F.lit(0.0)).alias("score"),
            F.array_sort(F.collect_list(F.when(found, span))).alias("spans"),
        )
        .drop("row")
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(common.table(spark, sf_dir, "documents")).drop("spans")
