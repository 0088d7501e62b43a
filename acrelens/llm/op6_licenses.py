"""License scan: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

A template of n shingles belongs to the class of the least power of two w with n <= w (2 at least). Documents are
read in windows of 1.5 w shingles with a stride of w / 2, so each place where the template may stand lies whole in
one window. There, with a containment of c, the Jaccard similarity is at least c n / (1.5 w + (1 - c) n); the
number of bands, of one minimum each, is chosen so that such a window shares a band with the template
with a probability of at least 1 - MISS.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acrelens.llm.shared import table

WIDTH, CONTAINED, MISS = 5, 0.8, 1e-6  # words of a shingle, containment of a match, chance that bands miss one
PIECE = 1 << 16  # shingles that are read at a time
#: Short statements, the opening or defining passages of common licenses, and the full texts of short ones.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0-line": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "mit-line": "Released under the MIT License.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "boost-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of any bytes beyond ASCII, A-Z lower-cased."""
    return (text or "").encode().translate(_LETTERS).split()


def shingle_hashes(words: list[bytes], width: int = WIDTH) -> np.ndarray:
    """Hash of each run of `width` words; none for a text with fewer words."""
    import xxhash

    if len(words) < width:
        return np.zeros(0, np.uint64)
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[i:j]) for i, j in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())], np.uint64)


def class_of(n: int) -> int:
    return max(2, 1 << (n - 1).bit_length())


def band_count(n: int, contained: float = CONTAINED, miss: float = MISS) -> int:
    """Bands that a template of n shingles needs, see the module's docstring."""
    similarity = contained * n / (1.5 * class_of(n) + (1 - contained) * n)
    return math.ceil(math.log(miss) / math.log(1 - similarity))


class Index:
    """Templates by class, and for each class a table from (band, minimum) to the templates that have it.

    A table's marks, by the low bits of band and minimum, tell for nearly all windows that no template has theirs.
    """

    def __init__(self, templates: dict[str, str], width: int = WIDTH, contained: float = CONTAINED, miss: float = MISS):
        rng = np.random.default_rng(12)
        self.width, self.contained = width, contained
        self.templates: dict[int, list[tuple]] = {}
        self.tables: dict[int, dict[tuple[int, int], list[int]]] = {}
        self.marks: dict[int, np.ndarray] = {}
        found = {name: np.unique(shingle_hashes(words_of(text), width)) for name, text in templates.items()}
        found = {name: h for name, h in found.items() if len(h)}
        most = max((band_count(len(h), contained, miss) for h in found.values()), default=1)
        self.factors = rng.integers(0, 1 << 31, most, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        for name, h in sorted(found.items()):
            bands, size = band_count(len(h), contained, miss), class_of(len(h))
            own = self.templates.setdefault(size, [])
            table, marks = self.tables.setdefault(size, {}), self.marks.setdefault(size, np.zeros(1 << 16, bool))
            values = self.minima(h).min(1)[:bands]
            for band, value in enumerate(values.tolist()):
                table.setdefault((band, value), []).append(len(own))
            marks[self.mark(values[:, None])[:, 0]] = True
            own.append((name, h, bands))

    def minima(self, hashes: np.ndarray) -> np.ndarray:
        """Each band's value of each shingle."""
        low = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
        with np.errstate(over="ignore"):
            mixed = low[None, :] * self.factors[:, None]
            mixed ^= mixed >> np.uint32(15)
            mixed *= np.uint32(0x2C1B3C6D)
        return mixed

    def mark(self, values: np.ndarray) -> np.ndarray:
        """16 bits of each band's (row's) values."""
        low = np.ascontiguousarray(values, "<u4").view("<u2")[:, ::2]
        return low + (np.arange(len(values)) * 40503 & 0xFFFF).astype(np.uint16)[:, None]

    def candidates(self, hashes: np.ndarray) -> Iterator[tuple]:
        """(name, shingles, first, last) of templates and windows of the hashes that share a band."""
        values = self.minima(hashes)
        size = 1
        for w in range(1, max(self.templates, default=1).bit_length()):
            half = (1 << w) // 2
            while size < half:  # minima of blocks of half a window's class
                if values.shape[1] % 2:
                    values = np.concatenate([values, values[:, -1:]], 1)
                values, size = np.minimum(values[:, ::2], values[:, 1::2]), size * 2
            own = self.templates.get(1 << w)
            if not own:
                continue
            pad = np.concatenate([values, values[:, -1:], values[:, -1:]], 1)
            pad = pad[: max(bands for _, _, bands in own)]
            windows = np.minimum(np.minimum(pad[:, :-2], pad[:, 1:-1]), pad[:, 2:])
            band, place = np.nonzero(self.marks[1 << w].take(self.mark(windows)))
            table = self.tables[1 << w]
            hits = {(t, j) for b, j, v in zip(band.tolist(), place.tolist(), windows[band, place].tolist()) for t in table.get((b, v), ())}
            for t, j in sorted(hits):
                yield own[t][0], own[t][1], j * half, min(len(hashes), (j + 3) * half)

    def scan(self, text: str | None) -> list[tuple[str, int, int, float]]:
        """(template, first word, words, containment) of each match, in the order of their places.

        Matching windows of a template that overlap are one match; it spans the template's shingles in them and
        has the largest of their containments.
        """
        words = words_of(text)
        hashes = shingle_hashes(words, self.width)
        reach = 3 * max(self.templates, default=4) // 2
        spans: dict[str, list[list]] = {}
        for at in range(0, len(hashes), PIECE):
            part = hashes[at : at + PIECE + reach]
            for name, h, i, j in self.candidates(part):
                inside = np.isin(part[i:j], h)
                share = len(np.unique(part[i:j][inside])) / len(h)
                if share < self.contained - 1e-12:
                    continue
                hit = np.flatnonzero(inside)
                spans.setdefault(name, []).append([at + i + int(hit[0]), at + i + int(hit[-1]) + self.width, share])
        out = []
        for name, own in spans.items():
            own.sort()
            merged = [own[0]]
            for s in own[1:]:
                if s[0] < merged[-1][1]:
                    merged[-1][1], merged[-1][2] = max(merged[-1][1], s[1]), max(merged[-1][2], s[2])
                else:
                    merged.append(s)
            out += [(name, a, b - a, share) for a, b, share in merged]
        return sorted(out, key=lambda m: (m[1], m[0]))


def scan_licenses(docs: DataFrame, text_col: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """(row, license, first_word, n_words, containment): one row for each match in each row of `docs`, which is kept as a struct.

    Words are letters and digits, compared without case and punctuation. Texts without a match, with under WIDTH words or
    null give no rows; repeated rows give theirs each. Templates with under WIDTH words never match. The whole text is
    scanned; only windows that share a band with a template are verified, by the exact set of shingles.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Index(TEMPLATES if templates is None else templates))

    @F.pandas_udf("array<struct<license: string, first_word: long, n_words: long, containment: double>>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"license": a, "first_word": b, "n_words": c, "containment": d} for a, b, c, d in sent.value.scan(t)] for t in texts], dtype=object)

    found = docs.select(F.struct("*").alias("row"), run(F.col(text_col)).alias("m"))
    return found.select("row", F.explode("m").alias("m")).select("row", "m.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "license", "first_word", "n_words", "containment")
