"""Operator 10: licence scans by TF-IDF cosine, with inheritance along directories.

Texts are compared with licence templates by the cosine of sparse TF-IDF vectors, in
an order of precedence; the first step that finds one decides:

1. the title: one of a text's first two blocks, of at most ``TITLE_WORDS`` words, that
   has all terms of a licence's title, so a whole licence that speaks of its relatives
   is not named after one of them;
2. the whole text;
3. its lines, its blocks, and its runs of lines made up mostly of template terms (by
   weight), between which lines without words don't count, so a wrapped header is
   compared as one;
4. the same with the reservations of rights in ``WEAK``, which stand in licences too.

Blocks are the maximal runs of adjoining lines with words.  A unit counts if it
shares a word of ``KEYS`` or at least ``SHARED`` different terms with the templates; a
line "4.0" is no notice.  No cosine is worked out where the weight of a unit's
template terms shows that it can't reach ``LEAST``.  An SPDX template counts only where all
its terms are there, as the tag's own words don't tell which licence it names.  Whole
licence texts (``LONG`` and the parameter ``more``) are compared in steps 2 and 3 and need
``LONG_LEAST``, as licences share much wording.  The document frequencies of
the templates' terms are counted over all texts; other terms get the frequency of a
term seen once.

A licence file (by its name, or by its title, by its first line or block with a word
being a notice, or by its whole text being a whole licence) gives
its licence to its directory.  Files without their own take that of the nearest
ancestor directory: the distinct directories are joined with their ancestors'
licences by path, and files with their directory.

Defined cases: null text has no licence of its own; a null path lies in the root;
several licence files of a directory: the highest cosine, then the least path;
equal cosines in a step: the first template in the list; repeated rows repeat.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import common as C

LEAST, LONG_LEAST = 0.5, 0.8
TITLE_WORDS = 40
#: Different template terms that a notice shares if it has none of KEYS.
SHARED = 3
#: Words of which one is enough.
KEYS = (b"license", b"licensed", b"licence", b"licenced", b"copyright", b"rights", b"spdx", b"unlicense", b"cc0", b"warranty", b"redistribution")
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction. The Software is provided as is, without warranty of any kind."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or any later version."),
    ("LGPL-2.1", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or any later version."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the conditions are met."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Released under the ISC License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Unlicense."),
    ("Proprietary", "All rights reserved."),
    ("Proprietary", "Copyright. All rights reserved. Unauthorized copying is prohibited."),
)
SPDX = ("MIT", "Apache-2.0", "GPL-3.0", "GPL-2.0", "LGPL-3.0", "LGPL-2.1", "AGPL-3.0", "BSD-3-Clause", "BSD-2-Clause", "MPL-2.0", "ISC", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC-BY-ND-4.0", "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-4.0", "CC0-1.0", "Unlicense")
TAGS = tuple((n, f"SPDX-License-Identifier: {n}{end}") for n in SPDX for end in (("", "-only", "-or-later") if "GPL" in n else ("",)))
TITLES = (
    ("GPL-1.0", "GNU General Public License Version 1, February 1989"),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("LGPL-2.0", "GNU Library General Public License Version 2, June 1991"),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("GFDL-1.1", "GNU Free Documentation License Version 1.1, March 2000"),
    ("GFDL-1.2", "GNU Free Documentation License Version 1.2, November 2002"),
    ("GFDL-1.3", "GNU Free Documentation License Version 1.3, 3 November 2008"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("MPL-1.1", "Mozilla Public License Version 1.1"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("Artistic-1.0", "The Artistic License"),
    ("Artistic-2.0", "The Artistic License 2.0"),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("CC-BY-4.0", "Attribution 4.0 International"),
    ("CC-BY-SA-4.0", "Attribution-ShareAlike 4.0 International"),
    ("CC-BY-NC-4.0", "Attribution-NonCommercial 4.0 International"),
    ("CC-BY-ND-4.0", "Attribution-NoDerivatives 4.0 International"),
    ("CC-BY-NC-SA-4.0", "Attribution-NonCommercial-ShareAlike 4.0 International"),
    ("CC-BY-NC-ND-4.0", "Attribution-NonCommercial-NoDerivatives 4.0 International"),
)
_NO_WARRANTY = " is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage."
_BSD = "Copyright (c). All rights reserved. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
LONG = (
    ("MIT", "MIT License. Copyright (c). Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software."),
    ("BSD-2-Clause", _BSD + "This software" + _NO_WARRANTY),
    ("BSD-3-Clause", _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. This software" + _NO_WARRANTY),
    ("ISC", "ISC License. Copyright (c). Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. The software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. In no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software."),
)
#: Found in the texts of other licences too; they count where nothing else is found.
WEAK = ("Proprietary",)
#: Letters, digits and all bytes of other scripts.
INSIDE = np.array([chr(b).isalnum() and b < 0x80 or b >= 0x80 for b in range(256)])
NAME = r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)[^/]*$"


class Templates:
    """All templates, their terms, and which of them the steps use."""

    def __init__(self, more: Sequence[tuple[str, str]] = ()) -> None:
        kinds = (TEMPLATES, TAGS, TITLES, (*LONG, *more))
        self.kind = np.repeat(np.arange(4), [len(k) for k in kinds])
        self.all = [x for k in kinds for x in k]
        self.names = np.array([n for n, _ in self.all], object)
        self.words = [_words(t) for _, t in self.all]
        self.vocab = sorted({w for ws in self.words for w in ws} | set(KEYS))
        self.title, self.short, self.whole = self.kind == 2, self.kind <= 1, self.kind != 2
        self.weak = np.isin(self.names, WEAK)
        self.least = np.where(self.kind == 3, LONG_LEAST, LEAST)

    def matrix(self, idf: np.ndarray) -> np.ndarray:
        """Unit TF-IDF vectors of the templates, a column each."""
        at = {w: i for i, w in enumerate(self.vocab)}
        m = np.zeros((len(at), len(self.all)))
        for t, ws in enumerate(self.words):
            for w in ws:
                m[at[w], t] += idf[at[w]]
        return m / np.maximum(np.linalg.norm(m, axis=0), 1e-12)


def _words(text: str) -> list[bytes]:
    data, off = C.text_bytes(pa.array([text]))
    w = C.Words(C.LOWER[data], off, inside=INSIDE)
    return [w.vocab[i].as_py() for i in w.ids.tolist()]


def term_shares(docs: DataFrame, text_col: str, terms: list[bytes]) -> np.ndarray:
    """Inverse document frequency of each term of the templates, then of a term seen once."""
    vocab = pa.array(terms, pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(vocab) + 1, np.int64)
        for b in C.slices(batches, "text"):
            data, off = C.text_bytes(b.column(0))
            w = C.Words(C.LOWER[data], off, inside=INSIDE)
            known = _find(w.vocab, vocab)[w.ids]
            pairs = np.unique((w.docs() * len(vocab) + known)[known >= 0])
            df += np.append(np.bincount(pairs % len(vocab), minlength=len(vocab)), b.num_rows)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(df))), pa.array(df)], names=["i", "df"])

    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "i long, df long").groupBy("i").agg(F.sum("df").alias("df")).collect()
    df = np.zeros(len(vocab) + 1)
    for r in rows:
        df[r["i"]] = r["df"]
    return np.log((1 + df[-1]) / (1 + np.append(df[:-1], 1))) + 1


def _find(values: pa.Array, vocab: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.index_in(values, vocab), -1).to_numpy(zero_copy_only=False)


def own_licenses(docs: DataFrame, id_col: str, text_col: str, path_col: str, more: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """doc_id, path, license, score, first_line (it is a licence file by its text)."""
    of_all = Templates(more)
    idf = term_shares(docs, text_col, of_all.vocab)
    matrix = of_all.matrix(idf)
    vocab = pa.array(of_all.vocab, pa.binary())
    keys = np.isin(np.array(of_all.vocab, object), np.array(KEYS, object))
    need = (matrix > 0).astype(float)
    need[:, (of_all.kind != 1) & (of_all.kind != 2)] = 0
    terms = need.sum(0)

    def best(unit: np.ndarray, ids: np.ndarray, known: np.ndarray, n_ids: int, use: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Units that may reach LEAST with the templates ``use``, their cosine and template; and for every unit if it is mostly their terms."""
        n = int(unit[-1]) + 1 if len(unit) else 0
        pair, tf = np.unique(unit * n_ids + ids, return_counts=True)
        u, term = pair // n_ids, known[pair % n_ids]
        weight = tf * idf[np.where(term >= 0, term, len(idf) - 1)]
        square = np.bincount(u, weight**2, n)
        hit = (term >= 0) & ((matrix[:, use] > 0).any(1) | keys)[term]
        u, term, weight = u[hit], term[hit], weight[hit]
        mostly = np.bincount(u, weight**2, n) >= LEAST**2 * square * (1 - 1e-9)
        some = np.flatnonzero(mostly & ((np.bincount(u, minlength=n) >= SHARED) | (np.bincount(u, keys[term], n) > 0)))
        at = np.full(n, -1)
        at[some] = np.arange(len(some))
        u = at[u]
        u, term, weight = u[u >= 0], term[u >= 0], weight[u >= 0]
        dot, have = np.zeros((len(some), matrix.shape[1])), np.zeros((len(some), matrix.shape[1]))
        np.add.at(dot, u, weight[:, None] * matrix[term])
        np.add.at(have, u, need[term])
        cos = dot / np.sqrt(np.maximum(square[some], 1e-24))[:, None]
        cos = np.where((have >= terms) & use & (cos >= of_all.least), cos, 0)
        strong = np.where(of_all.weak, 0, cos)
        top = np.where(strong.any(1), strong.argmax(1), cos.argmax(1))
        return some, cos[np.arange(len(some)), top], top, mostly

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches, "text"):
            n = b.num_rows
            data, off = C.text_bytes(b.column(1))
            w = C.Words(C.LOWER[data], off, inside=INSIDE)
            known = _find(w.vocab, vocab)
            doc = w.docs()
            line = np.searchsorted(np.sort(np.concatenate((np.flatnonzero(data == 10), off[:-1] - 1))), w.starts, "right")
            score, top, first = np.zeros(n), np.full(n, -1), np.zeros(n, bool)
            every = np.arange(len(doc))
            of, cosines, which, ranks = [], [], [], []

            def compare(sel: np.ndarray, new: np.ndarray, use: np.ndarray, rank: int, opens: bool = True) -> np.ndarray:
                """Score the units of the words ``sel``, which begin where ``new``."""
                unit = np.cumsum(new) - 1
                some, cos, t, mostly = best(unit, w.ids[sel], known, len(w.vocab), use)
                start = sel[np.flatnonzero(new)[some]]
                of.append(doc[start])
                cosines.append(cos)
                which.append(t)
                ranks.append(np.where(of_all.weak[t], 0, rank))
                licence = of_all.title[t] | (of_all.kind[t] == 3) & (rank == 2)
                first[doc[start][(licence | (start == w.offsets[doc[start]]) & opens) & (cos > 0)]] = True
                return mostly[unit]

            if len(doc):
                other = np.append(True, doc[1:] != doc[:-1])
                step = np.append(0, np.diff(line))
                mostly = compare(every, other | (step > 0), of_all.short, 1)
                new = other | (step > 1)
                compare(every, new, of_all.short, 1)
                block = np.cumsum(new) - 1
                place = block - block[w.offsets[doc]]
                sel = np.flatnonzero((place < 2) & (np.bincount(block)[block] <= TITLE_WORDS))
                if len(sel):
                    compare(sel, new[sel], of_all.title, 3)
                compare(every, other, of_all.whole, 2, False)
                sel = every[mostly]
                if len(sel):
                    # words between two of the selection are of a line that isn't mostly template terms
                    compare(sel, other[sel] | np.append(True, np.diff(sel) > 1), of_all.whole, 1)
                of, cos, t, rank = (np.concatenate(x) for x in (of, cosines, which, ranks))
                of, cos, t, rank = (x[cos > 0] for x in (of, cos, t, rank))
                o = np.lexsort((t, -cos, -rank, of))
                o = o[np.append(True, of[o][1:] != of[o][:-1])] if len(o) else o
                score[of[o]], top[of[o]] = cos[o], t[o]
            found = top >= 0
            name = np.where(found, of_all.names[top], None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(name.tolist(), pa.string()), pa.array(np.where(found, score, 0.0)), pa.array(first)], names=["doc_id", "path", "license", "score", "first_line"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"))
    return rows.mapInArrow(run, "doc_id long, path string, license string, score double, first_line boolean")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "path", more: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """doc_id, path, license, score, origin ("own", "inherited" or "none"), inherited_from.

    ``more`` holds further whole licence texts as (name, text), a few hundred at most.
    """
    own = C.checkpoint(own_licenses(docs, id_col, text_col, path_col, more).withColumn("dir", F.regexp_replace("path", r"/?[^/]*$", "")))
    files = own.where(F.col("license").isNotNull() & (F.col("path").rlike(NAME) | F.col("first_line")))
    of_dir = C.checkpoint(files.groupBy("dir").agg(F.min_by("license", F.struct(-F.col("score"), F.col("path"), F.col("license"))).alias("dir_license")).withColumnRenamed("dir", "ancestor"))
    dirs = own.where("license is null").select("dir").distinct()
    steps = F.split("dir", "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda i: F.array_join(F.slice(steps, F.lit(1), i), "/"))
    above = dirs.select("dir", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), ancestors, F.array("dir")))).alias("ancestor"))
    nearest = above.join(C.few(of_dir), "ancestor").groupBy("dir").agg(F.max_by(F.struct("dir_license", "ancestor"), F.length("ancestor")).alias("near"))
    # directories, not files: one with most of the files is one row
    rows = own.join(C.few(C.checkpoint(nearest)), "dir", "left")
    mine = F.col("license").isNotNull()
    return rows.select("doc_id", "path", F.coalesce("license", "near.dir_license").alias("license"), "score", F.when(mine, "own").when(F.col("near").isNotNull(), "inherited").otherwise("none").alias("origin"), F.when(~mine, F.col("near.ancestor")).alias("inherited_from"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files source/lang/thousands/id.txt."""
    docs = C.table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.expr("cast(doc_id div 1000 as string)"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return scan(docs.withColumn("path", path))
