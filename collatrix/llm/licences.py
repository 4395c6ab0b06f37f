"""Licence scans: notices, headers and texts by TF-IDF cosine to templates, then inheritance from the nearest directory.

Every line of a file is compared with the notices and titles as a sparse TF-IDF
vector; document frequencies of the templates' terms are counted over all files.
A line whose cosine reaches ``LEAST`` is a notice, and the file's licence is that
of its best line. A line that holds no key term of a template cannot reach that
(key terms are taken until what is left of the template's vector is under
``LEAST``, which bounds the cosine), so only lines with a key term are weighed.

Notices, headers and full texts are also compared, however they are wrapped, with
each run of as many terms of the file as the template has (all of it where it has
fewer), term counts damped by 1 + ln. A file can reach ``LEAST`` only if it holds
terms with that share of the template's vector, so only such files are run over.
Short templates must be met with the names and versions they hold. An
SPDX-License-Identifier is read, not compared: it scores 1.

A licence file speaks for its directory: the licence that most of a directory's
licence files name (ties: by name). A file without a notice inherits from the
nearest directory above it that has one, by joins on directory paths.

Defined cases: a null text has no notice; a null path has no directory, so
nothing is inherited; notices that tie go to the first name, then line; rows that
repeat are scanned each; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from collatrix.llm.store import documents, materialize, small_batches

#: Short notices of common licences (fixed values).
TEMPLATES = {
    "AGPL-3.0": "This program is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Licensed under the BSD 2-Clause Simplified License.",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "CC-BY-4.0": "This work is licensed under the Creative Commons Attribution 4.0 International License, CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has dedicated this work to the public domain, CC0 1.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Released under the ISC License.",
    "LGPL-2.1": "This library is licensed under the GNU Lesser General Public License, version 2.1.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
#: Titles and other notices that stand in a line of their own.
LINES = [
    ("MIT", "MIT License"),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "Licensed under the MIT license. See LICENSE in the project root."),
    ("MIT", "Licensed under the MIT License. See LICENSE file in the project root for full license information."),
    ("MIT", "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("Apache-2.0", "Apache License, Version 2.0, January 2004"),
    ("Apache-2.0", "Apache License 2.0"),
    ("Apache-2.0", "This project is licensed under the terms of the Apache License 2.0."),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("ISC", "ISC License"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Unlicense", "The Unlicense"),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International"),
]
_GNU = """{this} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published
by the Free Software Foundation, either version {v} of the License, or (at your option) any later version.
{this} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind}General Public License for more details.
You should have received a copy of the GNU {kind}General Public License along with {this}. """
_GNU_ENDS = ["If not, see <https://www.gnu.org/licenses/>.", "If not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."]
_GNU_KINDS = [("GPL-2.0", "This program", "", "2"), ("GPL-3.0", "This program", "", "3"), ("AGPL-3.0", "This program", "Affero ", "3"), ("LGPL-2.1", "This library", "Lesser ", "2.1"), ("LGPL-3.0", "This library", "Lesser ", "3")]
#: Header blocks and titles of several lines.
HEADERS = [
    *[(name, _GNU.format(this=this, kind=kind, v=v) + end) for name, this, kind, v in _GNU_KINDS for end in _GNU_ENDS],
    *[(name, _GNU.format(this=this, kind=kind, v=v).split("\n" + this)[0]) for name, this, kind, v in _GNU_KINDS],
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    *[(name, f"GNU {kind} PUBLIC LICENSE Version {date}") for name, kind, date in [
        ("GPL-2.0", "GENERAL", "2, June 1991"), ("GPL-3.0", "GENERAL", "3, 29 June 2007"), ("AGPL-3.0", "AFFERO GENERAL", "3, 19 November 2007"),
        ("LGPL-2.1", "LESSER GENERAL", "2.1, February 1999"), ("LGPL-3.0", "LESSER GENERAL", "3, 29 June 2007"),
    ]],
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and limitations under the License."""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.
If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF
OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF
OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
]
#: Full texts, a file each.
TEXTS = Path(__file__).parent / "licence_texts"
#: Templates of up to SHORT terms must be met with all of NAMES that they hold (mit alone is a German word), and with none of KINDS that they do not.
SHORT = 200
KINDS = frozenset({"lesser", "affero", "nc", "sa", "nd", "noncommercial", "sharealike", "noderivatives"})
NAMES = KINDS | {"license", "mit", "apache", "bsd", "isc", "mozilla", "gnu", "cc", "cc0", "creative", "unlicense", "2", "3", "2.0", "2.1", "1.0", "4.0"}
TAG = re.compile(r"SPDX-License-Identifier:[ \t]*(\(*[A-Za-z0-9][\w.+-]*\)*(?:[ \t]+(?:AND|OR|WITH)[ \t]+\(*[A-Za-z0-9][\w.+-]*\)*)*)", re.IGNORECASE)
LICENCE_FILE = r"(?i)(^|/)(un)?(licen[cs]e|copying|notice)([.-][^/]*)?$"
LEAST = 0.75
BROADCAST_DIRECTORIES = 100_000
TERM = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")


def terms(line: str) -> list[str]:
    return TERM.findall(line.lower())


def blocks() -> list[tuple[str, str]]:
    """(licence, text) of what is looked for in any run of terms: notices, headers, full texts."""
    return [*TEMPLATES.items(), *HEADERS, *((p.name.removesuffix(".txt"), p.read_text()) for p in sorted(TEXTS.glob("*.txt")))]


def tagged(line: str) -> str | None:
    """The licence or expression that an SPDX tag names, GNU names without only, or-later and +."""
    found = TAG.search(line)
    if not found:
        return None
    known = {name.lower(): name for name in [*TEMPLATES, "LGPL-3.0"]}

    def plain(part: re.Match) -> str:
        name = re.sub(r"(?i)^((?:A|L)?GPL-[0-9.]+?)(?:-only|-or-later|\+)$", r"\1", part[0])
        return known.get(name.lower(), name)

    out = re.sub(r"[\w.+-]+", plain, found[1])
    if out.count("(") != out.count(")"):
        out = re.sub(r"[()]", "", out)
    elif out.startswith("(") and out.find(")") == len(out) - 1:
        out = out[1:-1]
    return None if out.upper() in ("NONE", "NOASSERTION") else out


class BlockModel:
    """Finds templates of any length in runs of a file's terms."""

    def __init__(self, templates: Sequence[tuple[str, str]], df: Mapping[str, int], n: int, least: float = LEAST):
        self.least, self.rare = least, math.log(1.0 + n) + 1.0
        self.idf = {t: math.log((1 + n) / (1 + df.get(t, 0))) + 1.0 for _, x in templates for t in terms(x)}
        self.blocks: list[tuple[str, int, dict[str, float], frozenset[str], frozenset[str]]] = []
        for name, text in templates:
            counts = Counter(terms(text))
            m = counts.total()
            raw = {t: (1 + math.log(k)) * self.idf[t] for t, k in counts.items()}
            norm = math.sqrt(sum(v * v for v in raw.values()))
            short = m <= SHORT
            self.blocks.append((name, m, {t: v / norm for t, v in raw.items()}, NAMES.intersection(raw) if short else frozenset(), KINDS.difference(raw) if short else frozenset()))
        self.damp = [0.0, *(1 + math.log(k) for k in range(1, max((b[1] for b in self.blocks), default=0) + 1))]

    def can_reach(self, present: set[str] | frozenset[str]) -> bool:
        """Whether any template can be near enough to a run of a file that holds these of its terms."""
        return any(must <= present and self.mass(vector, present) >= (self.least - 1e-9) ** 2 for _, _, vector, must, _ in self.blocks)

    @staticmethod
    def mass(vector: Mapping[str, float], present: set[str] | frozenset[str]) -> float:
        if len(present) > len(vector):
            return sum(w * w for t, w in vector.items() if t in present)
        return sum(vector[t] ** 2 for t in present if t in vector)

    def find(self, found: list[str], present: set[str]) -> list[tuple[float, str, int, int]]:
        """(cosine, name, first term, end) of the best run for each template that is near enough to one."""
        out = []
        for name, m, vector, must, never in self.blocks:
            if must <= present and self.mass(vector, present) >= (self.least - 1e-9) ** 2:
                score, start = self.slide(found, m, vector, must, never)
                if score >= self.least:
                    out.append((score, name, start, min(start + m, len(found))))
        return out

    def slide(self, found: list[str], m: int, vector: Mapping[str, float], must: frozenset[str], never: frozenset[str]) -> tuple[float, int]:
        held: Counter[str] = Counter()
        dot = norm = best = 0.0
        at, last = 0, min(m, len(found)) - 1
        damp, idf, rare = self.damp, self.idf, self.rare
        for i, t in enumerate(found):
            if i >= m:
                old = found[i - m]
                k, w = held[old], idf.get(old, rare)
                held[old] = k - 1
                dot -= (damp[k] - damp[k - 1]) * w * vector.get(old, 0.0)
                norm -= (damp[k] ** 2 - damp[k - 1] ** 2) * w * w
            k, w = held[t], idf.get(t, rare)
            held[t] = k + 1
            dot += (damp[k + 1] - damp[k]) * w * vector.get(t, 0.0)
            norm += (damp[k + 1] ** 2 - damp[k] ** 2) * w * w
            if i >= last and dot > (best + 1e-9) * math.sqrt(norm) and all(held[x] for x in must) and not any(held[x] for x in never):
                best, at = dot / math.sqrt(norm), i - last
        return round(best, 9), at


class NoticeModel:
    """Template vectors under the corpus' document frequencies."""

    def __init__(self, templates: Mapping[str, str], df: Mapping[str, int], n: int, least: float = LEAST, lines: Sequence[tuple[str, str]] = (), runs: Sequence[tuple[str, str]] = ()):
        self.n, self.least = n, least
        listed = {name: (name, x) for name, x in sorted(templates.items())} | {f"{name} {i}": (name, x) for i, (name, x) in enumerate(lines)}
        self.idf = {t: math.log((1 + n) / (1 + df.get(t, 0))) + 1.0 for _, x in listed.values() for t in terms(x)}
        self.rare = math.log(1.0 + n) + 1.0
        self.vectors = {label: self._unit(x) for label, (_, x) in listed.items()}
        self.names = {label: (name, NAMES.intersection(self.vectors[label])) for label, (name, _) in listed.items()}
        self.runs = BlockModel(runs, df, n, least)
        self.vocabulary = frozenset([*self.idf, *self.runs.idf, "spdx"])
        self.by_term: dict[str, list[tuple[str, float]]] = {}
        keys: set[str] = set()
        for name, vector in self.vectors.items():
            rest = 1.0
            for t, w in sorted(vector.items(), key=lambda x: (-x[1], x[0])):
                self.by_term.setdefault(t, []).append((name, w))
                if rest >= (least - 1e-9) ** 2:
                    keys.add(t)
                    rest -= w * w
        self.key_terms = keys
        self.any_key = re.compile("|".join(map(re.escape, sorted(keys))), re.IGNORECASE)

    def _unit(self, line: str) -> dict[str, float]:
        raw = {t: k * self.idf.get(t, self.rare) for t, k in Counter(terms(line)).items()}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        return {t: v / norm for t, v in raw.items()}

    def best(self, line: str) -> tuple[float, str] | None:
        """Cosine and name of the template nearest to a line, if it is near enough."""
        found = terms(line)
        if not self.key_terms.intersection(found):
            return None
        scores: Counter[str] = Counter()
        for t, v in self._unit(line).items():
            for name, w in self.by_term.get(t, ()):
                scores[name] += v * w
        held = set(found)
        near = [(round(s, 9), self.names[label]) for label, s in scores.items() if round(s, 9) >= self.least]
        fit = [(s, name) for s, (name, must) in near if must <= held and held.isdisjoint(KINDS - must)]
        return max(fit, key=lambda x: (x[0], [-ord(c) for c in x[1]]), default=None)

    def scan(self, text: str | None) -> tuple[str | None, float | None, int | None, int, int]:
        """(licence, score, line number from 0, terms in notices, terms) of a text."""
        text = text or ""
        total = text.count(" ") + text.count("\n") + 1
        present = self.vocabulary.intersection(TERM.findall(text.lower()))
        if not present:
            return None, None, None, 0, total
        near: list[tuple[float, str, int]] = []
        noticed, whole = 0, set()
        lines = text.split("\n")
        if "spdx" in present or not self.key_terms.isdisjoint(present):
            for i, line in enumerate(lines):
                name = tagged(line) if "spdx" in present else None
                found = (1.0, name) if name else self.best(line) if self.any_key.search(line) else None
                if found:
                    near.append((*found, i))
                    noticed += line.count(" ") + 1
                    whole.add(i)
        if self.runs.can_reach(present):
            found, at = [], []
            for i, line in enumerate(lines):
                own = terms(line)
                found += own
                at += [i] * len(own)
            covered = set()
            for score, name, start, end in self.runs.find(found, set(found)):
                near.append((score, name, at[start]))
                covered.update(range(start, end))
            noticed += sum(at[k] not in whole for k in covered)
        if not near:
            return None, None, None, 0, total
        score, name, line = min(near, key=lambda x: (-x[0], x[1], x[2]))
        return name, score, line, noticed, total


def document_frequencies(files: DataFrame, text: str, templates: Sequence[str]) -> tuple[dict[str, int], int]:
    """How many of all files hold each of the templates' terms, and the number of files."""
    vocabulary = frozenset(t for x in templates for t in terms(x))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[str] = Counter()
        n = 0
        for batch in batches:
            n += len(batch)
            for x in batch["text"]:
                if x is not None:
                    seen.update(vocabulary.intersection(TERM.findall(x.lower())))
        yield pd.DataFrame({"term": [*seen, None], "n": [*seen.values(), n]})

    counted = files.select(F.col(text).alias("text")).mapInPandas(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    rows = {r["term"]: r["n"] for r in counted.collect()}
    return rows, rows.pop(None, 0)


def parent(path: Column) -> Column:
    """The directory of a path: ``""`` at the top."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def scan_licences(files: DataFrame, key: str, path: Column, text: str = "text", is_licence: Column | None = None, templates: Mapping[str, str] = TEMPLATES, lines: Sequence[tuple[str, str]] = tuple(LINES), runs: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """Per row its key, path, licence, score, line, origin (own, inherited, none) and from_dir.

    ``is_licence`` tells licence files from others, by the columns path, licence, noticed and
    words; their names do by default. ``lines`` and ``runs`` (``blocks()`` by default) are more templates.
    """
    small_batches(files.sparkSession)
    runs = blocks() if runs is None else runs
    df, n = document_frequencies(files, text, [*templates.values(), *(x for _, x in [*lines, *runs])])
    model = files.sparkSession.sparkContext.broadcast(NoticeModel(templates, df, n, lines=lines, runs=runs))

    @F.pandas_udf("licence string, score double, line long, noticed long, words long")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = pd.DataFrame([model.value.scan(x) for x in batch], columns=["licence", "score", "line", "noticed", "words"])
            yield found.astype({"score": "float64", "line": "Int64", "noticed": "int64", "words": "int64"})

    rows = files.select(F.col(key).alias("key"), path.alias("path"), scan(F.col(text)).alias("x")).select("key", "path", "x.*")
    rows = materialize(rows, "licences").withColumn("dir", parent(F.col("path")))
    named = F.col("path").rlike(LICENCE_FILE) if is_licence is None else is_licence
    votes = rows.where(named & F.col("licence").isNotNull() & F.col("path").isNotNull()).groupBy("dir", "licence").agg(F.count("*").alias("n"))
    ranked = votes.withColumn("rank", F.row_number().over(W.partitionBy("dir").orderBy(F.desc("n"), "licence")))
    declared = ranked.where("rank = 1").select(F.col("dir").alias("above"), F.col("licence").alias("dir_licence"))
    dirs = rows.where("dir IS NOT NULL").select("dir").distinct()
    up = F.split("dir", "/")
    levels = F.transform(F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(up))), lambda i: F.array_join(F.slice(up, F.lit(1), i), "/"))
    above = dirs.select("dir", F.posexplode(levels).alias("depth", "above")).join(declared, "above")
    nearest = above.groupBy("dir").agg(F.max(F.struct("depth", "above", "dir_licence")).alias("near"))
    # Few directories are broadcast, which leaves the files where they are; else the join is shuffled, and adaptive execution splits large directories.
    nearest = materialize(nearest, "directories")
    nearest = F.broadcast(nearest) if nearest.count() <= BROADCAST_DIRECTORIES else nearest
    out = rows.join(nearest, "dir", "left")
    own = F.col("licence").isNotNull()
    return out.select(
        F.col("key").alias(key),
        "path",
        F.coalesce("licence", "near.dir_licence").alias("licence"),
        "score",
        "line",
        F.when(own, "own").when(F.col("near").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(~own, F.col("near.above")).alias("from_dir"),
    )


def document_path() -> Column:
    """Documents have no path: a source is a repository, a language a directory in it."""
    return F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))


#: A document is its directory's licence file if at least this share of its words is notices.
LICENCE_SHARE = 0.25


def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    mostly = F.col("noticed") >= LICENCE_SHARE * F.col("words")
    return scan_licences(documents(spark, sf_dir), "doc_id", document_path(), is_licence=mostly)


QUERIES = {"op9_licence_scan": op9_licence_scan}
ORACLE: dict[str, str] = {}
