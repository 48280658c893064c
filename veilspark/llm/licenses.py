"""Licence scan: sparse TF-IDF cosine of header lines and licence files to templates, then inheritance along paths.

Every line of a text is searched for headers: each window of a line that is as long as a template is compared with it, so a notice
inside a long line counts in full.  A file whose name says so is also compared as a whole with the full texts.  Terms weigh
``tf * log(1 + N / df)``, where N counts all lines of all files and df those that hold the term; terms that no template has weigh as
much as a term of one line.  A window's best template counts from ``least`` on.

A window can only reach ``least`` if it holds one of the template's *strong* terms: without them, the weights that are left are too
small for any window (``strong_terms``).  So lines without strong terms are passed over, which loses nothing.

A file without a licence of its own takes that of the nearest ancestor directory (its own first) that holds a
licence file: one by name, or one whose characters are mostly in windows that match.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, bounded_batches

# fixed values: usual short notices of public licences
NOTICES = [
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("ISC", "Released under the ISC License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("Proprietary", "All rights reserved"),
]
# fixed values: texts of licence files
FULL = [
    ("MIT", """MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """ISC License. Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
]
NAMES = sorted({n for n, _ in [*NOTICES, *FULL]} - {"Proprietary"})
HEADERS = [*NOTICES, *[(n, f"SPDX-License-Identifier: {n}") for n in NAMES]]
FILE_NAME = r"(?i)(^|/)(licen[sc]e|copying|notice|unlicense)(\.[a-z]+)?$"
_TERM = re.compile(r"[^\W_]+(?:[.\-]+[^\W_]+)*")


def terms(text: str) -> list[str]:
    """Runs of letters and digits in lower case, with dots and hyphens between them."""
    return _TERM.findall(text.lower())


VOCABULARY = sorted({t for _, text in [*HEADERS, *FULL] for t in terms(text)})


class Scorer:
    """Cosines to the templates, for given counts of lines: ``df`` of the vocabulary's terms among ``n`` lines."""

    def __init__(self, n: int, df: dict[str, int], least: float):
        self.least, self.idf, self.other = least, {t: math.log1p(n / max(1, df.get(t, 0))) for t in VOCABULARY}, math.log1p(max(1, n))
        self.headers = [(name, *self._template(text)) for name, text in HEADERS]
        self.full = [(name, *self._template(text)) for name, text in [*HEADERS, *FULL]]
        self.strong: dict[str, list[int]] = {}
        for k, (_, weights, norm, _) in enumerate(self.headers):
            for t in self.strong_terms(weights, norm):
                self.strong.setdefault(t, []).append(k)
        self.keys = frozenset(self.strong)

    def _template(self, text: str) -> tuple[dict[str, float], float, int]:
        found = terms(text)
        weights = {t: c * self.idf[t] for t, c in Counter(found).items()}
        return weights, math.sqrt(sum(w * w for w in weights.values())), len(found)

    def strong_terms(self, weights: dict[str, float], norm: float) -> list[str]:
        """The fewest heaviest terms without which no text reaches ``least``: the cosine is at most the share of the other weights."""
        rest, out = norm * norm, []
        for t in sorted(weights, key=lambda t: (-weights[t], t)):
            if rest < (self.least * norm) ** 2 * (1 - 1e-9):
                break
            out.append(t)
            rest -= weights[t] ** 2
        return out

    def cosine(self, tf: dict[str, int], weights: dict[str, float], norm: float) -> float:
        own = math.sqrt(sum((c * self.idf.get(t, self.other)) ** 2 for t, c in tf.items()))
        return sum(c * self.idf[t] * weights[t] for t, c in tf.items() if t in weights) / (own * norm) if own and norm else 0.0

    def line(self, text: str) -> tuple[float, str, float] | None:
        """The best (cosine, licence, share of the line's terms) of the windows of a line; ties go to the smaller name."""
        found = terms(text)
        if self.keys.isdisjoint(found):
            return None
        tries: dict[int, set[int]] = {}
        for i, t in enumerate(found):
            for k in self.strong.get(t, ()):
                size = self.headers[k][3]
                tries.setdefault(k, set()).update(range(max(0, i - size + 1), min(i, max(0, len(found) - size)) + 1))
        best = None
        for k, starts in tries.items():
            name, weights, norm, size = self.headers[k]
            for i in starts:
                got = self.cosine(Counter(found[i : i + size]), weights, norm)
                if got >= self.least and (best is None or (-got, name) < (-best[0], best[1])):
                    best = (got, name, min(1.0, size / len(found)))
        return best

    def whole(self, text: str) -> tuple[float, str] | None:
        tf = Counter(terms(text))
        got = min(((-self.cosine(tf, weights, norm), name) for name, weights, norm, _ in self.full), default=None)
        return (-got[0], got[1]) if got and -got[0] >= self.least else None

    def file(self, text: str | None, named: bool, known: dict) -> tuple[str | None, float | None, float]:
        """(best licence, its cosine, share of the characters that are in licence lines' windows)."""
        best, chars, inside = None, 0, 0
        for line in (text or "").split("\n"):
            size = len(line) - sum(map(line.count, " \t\r"))
            chars += size
            if line not in known:
                if len(known) > 20_000:
                    known.clear()
                known[line] = self.line(line)
            if (got := known[line]) is not None:
                inside += size * got[2]
                best = got if best is None or (-got[0], got[1]) < (-best[0], best[1]) else best
        if named and (got := self.whole(text or "")) is not None:
            best = got if best is None or (-got[0], got[1]) < (-best[0], best[1]) else best
        return (best[1] if best else None), (best[0] if best else None), inside / max(1, chars)


def line_counts(files: DataFrame) -> tuple[int, dict[str, int]]:
    """Lines with terms in all files, and how many of them hold each term of the vocabulary."""
    bounded_batches(files.sparkSession)

    def work(batches):
        wanted, total, df = frozenset(VOCABULARY), 0, Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for line in (text or "").split("\n"):
                    found = terms(line)
                    total += bool(found)
                    df.update(wanted.intersection(found))
        yield pa.record_batch([pa.array(["", *df], pa.string()), pa.array([total, *df.values()], pa.int64())], names=["term", "n"])

    counts = {r.term: r.n for r in files.select("text").mapInArrow(work, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return counts.pop("", 0), counts


def scan_licenses(spark: SparkSession, files: DataFrame, least: float = 0.6, mostly: float = 0.5) -> DataFrame:
    """``files(doc_id, path, text)`` to ``(doc_id, path, own, cosine, license, origin)``, one row for each row.

    own and cosine: the file's best licence and its cosine, or null; license: own, or the inherited one; origin: ``header``,
    ``file``, the directory that it comes from, or null.  Null and blank texts hold no licence but inherit; a null path is a
    file in no directory.  Ties: the larger cosine, then the smaller licence name; between files of one directory, those by name
    first.  Repeated rows give repeated rows, an empty table none; further columns play no part.
    """
    scratch = Scratch(spark)
    files = files.select("doc_id", "path", "text", F.coalesce(F.col("path").rlike(FILE_NAME), F.lit(False)).alias("named"))
    scorer = spark.sparkContext.broadcast(Scorer(*line_counts(files), least))  # a few hundred terms
    kind = files.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, path string, named boolean, own string, cosine double, share double"

    def work(batches):
        known: dict = {}
        for batch in batches:
            got = [scorer.value.file(t, n, known) for t, n in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            own, cosine, share = zip(*got, strict=True) if got else ((), (), ())
            columns = [batch.column(0), batch.column(1), batch.column(3), pa.array(own, pa.string()), pa.array(cosine, pa.float64()), pa.array(share, pa.float64())]
            yield pa.record_batch(columns, names=["doc_id", "path", "named", "own", "cosine", "share"])

    scored = scratch.save(files.mapInArrow(work, schema), "scored")
    # path joins: a directory's licence is that of its best licence file; a file meets all its ancestors, the deepest wins
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    is_file = F.col("own").isNotNull() & F.col("path").isNotNull() & (F.col("named") | (F.col("share") >= mostly))
    folders = scored.where(is_file).withColumn("folder", folder).groupBy("folder").agg(F.min(F.struct((~F.col("named")).alias("k"), (-F.col("cosine")).alias("c"), F.col("own").alias("license"))).alias("b")).select("folder", F.col("b.license").alias("theirs"))
    # a directory's ancestors are joined once, not once a file
    places = scored.where("path is not null").select(folder.alias("place")).distinct()
    above = F.expr("transform(sequence(0, size(split(place, '/'))), k -> array_join(slice(split(place, '/'), 1, k), '/'))")
    nearest = places.withColumn("folder", F.explode(F.array_distinct(above))).join(folders, "folder").groupBy("place").agg(F.max(F.struct(F.length("folder").alias("k"), "folder", "theirs")).alias("b"))
    out = scored.withColumn("place", folder).join(nearest, "place", "left")
    origin = F.when(F.col("own").isNotNull(), F.when(F.col("named"), F.lit("file")).otherwise(F.lit("header"))).otherwise(F.col("b.folder"))
    return out.select("doc_id", "path", "own", F.round("cosine", 6).alias("cosine"), F.coalesce("own", "b.theirs").alias("license"), origin.alias("origin"))
