"""Operator 6: licence scan by sparse TF-IDF cosine, and inheritance along paths.

Every line of every file is compared with short licence templates: terms are
weighted by the templates' inverse document frequencies (a term in no template
has the largest), and a line's licence is the template of the highest cosine,
if that reaches ``least``. By Cauchy-Schwarz a line reaches it only with a
term from a template's heavy end, so a text without any of those few terms is
passed over after one pattern test; the lines of the rest are weighed within
their row, so no term is shuffled.

A notice that is wrapped over lines, or a whole licence file, is found by
sliding over the whole text: stretches as long as a template of ``WHOLE``
(source headers and openings of licence files), beginning at every term, are
compared with that template in the same way. A text is read in pieces of
``PIECE`` characters and the next ``OVERLAP``, so a notice within ``OVERLAP``
characters lies whole in one piece wherever it stands; parts of a piece without
enough of a template's rarer terms are passed over. The higher cosine of both
wins.

A file named like a licence (``LICENSE``, ``COPYING``, ``NOTICE`` with any
ending) speaks for its folder. Distinct folders, not files, are expanded to
their ancestors and joined with the folders that have a licence; the nearest
wins. A file's own licence comes before an inherited one.

Only DataFrame functions are used. Defined results: a null text has no licence
of its own and inherits; a null path, or one without a folder, inherits the
licence of the top folder '' if there is one; ties go to the smaller licence
name; repeated rows are returned each.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markspark.llm.common import ascii_lower, stored

#: Public licence notices, shortened to their identifying sentence.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted.",
    "Proprietary": "All rights reserved.",
}
_GNU = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as "
        "published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. This program "
        "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY "
        "or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0}General Public License for more details.")
_GNU_FILE = ("GNU {0}GENERAL PUBLIC LICENSE Version {1} Copyright (C) {2} Free Software Foundation, Inc. Everyone is permitted to copy and "
             "distribute verbatim copies of this license document, but changing it is not allowed.")
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution.")
#: (licence, text): source headers and openings of licence files, compared with stretches of a text.
WHOLE = (
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
                   "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
                   'law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES '
                   "OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
                   "limitations under the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND "
                   'DISTRIBUTION 1. Definitions. "License" shall mean the terms and conditions for use, reproduction, and distribution as '
                   "defined by Sections 1 through 9 of this document."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files '
            '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, '
            "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
            "furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included "
            "in all copies or substantial portions of the Software."),
    ("BSD-2-Clause", _BSD),
    ("BSD-3-Clause", _BSD + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
                            "products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("GPL-3.0", _GNU.format("", "3")),
    ("GPL-2.0", _GNU.format("", "2")),
    ("LGPL-3.0", _GNU.format("Lesser ", "3")),
    ("AGPL-3.0", _GNU.format("Affero ", "3")),
    ("GPL-3.0", _GNU_FILE.format("", "3, 29 June 2007", "2007")),
    ("GPL-2.0", _GNU_FILE.format("", "2, June 1991", "1989, 1991")),
    ("LGPL-3.0", _GNU_FILE.format("LESSER ", "3, 29 June 2007", "2007")),
    ("AGPL-3.0", _GNU_FILE.format("AFFERO ", "3, 19 November 2007", "2007")),
)
#: Characters of a text cut into terms at once, and those of the next piece read with them.
PIECE, OVERLAP = 8_192, 4_096
_TERM = "[^a-z0-9.]+"
_FILE = r"(^|/)(LICEN[CS]E|COPYING|NOTICE)[^/]*$"


def terms(text: str) -> list[str]:
    return [t.strip(".") for t in re.split(_TERM, text.lower()) if t.strip(".")]


def weights(templates: dict[str, str]) -> tuple[dict[str, dict[str, float]], dict[str, float], float]:
    """(template -> term -> unit weight, term -> idf, idf of any other term)."""
    n = len(templates)
    df = Counter(t for x in templates.values() for t in set(terms(x)))
    idf = {t: math.log((1 + n) / (1 + d)) + 1 for t, d in df.items()}
    unit = {}
    for name, x in templates.items():
        w = {t: c * idf[t] for t, c in Counter(terms(x)).items()}
        length = math.sqrt(sum(v * v for v in w.values()))
        unit[name] = {t: v / length for t, v in w.items()}
    return unit, idf, math.log(1 + n) + 1


#: Everyday words and short numbers, passed over first (in this order) when the necessary terms are chosen.
#: The choice only saves work: any choice finds the same lines.
COMMON = ("and", "the", "of", "in", "is", "this", "with", "a", "or", "are", "by", "all", "mit", "under", "3", "use", "work", "general",
          "public")


#: Everyday words of the long templates, not among the terms by which a stretch is passed over (that only saves work too).
EVERYDAY = {"and", "the", "of", "in", "is", "this", "with", "a", "or", "are", "by", "to", "any", "for", "not", "be", "as", "that", "but", "on", "an"}


def fewest(unit: dict[str, float], least: float) -> tuple[list[str], int]:
    """(terms, k): terms reach ``least`` with a template only with k or more of these (Cauchy-Schwarz over the shared terms)."""
    rare = sorted((v * v for t, v in unit.items() if t not in EVERYDAY), reverse=True)
    need, k = least * least - 1e-9 - sum(v * v for t, v in unit.items() if t in EVERYDAY), 0
    while need > 0:
        need -= rare[k]
        k += 1
    return sorted(set(unit) - EVERYDAY), k


def heavy_terms(unit: dict[str, dict[str, float]], least: float) -> list[str]:
    """Terms of which a line needs one: the others of a template together stay under ``least``."""
    heavy = set()
    for w in unit.values():
        light = 0.0
        for t, v in sorted(w.items(), key=lambda x: (COMMON.index(x[0]) if x[0] in COMMON else len(COMMON), x[1], x[0])):
            if math.sqrt(light + v * v) >= least - 1e-9:
                heavy.add(t)
            else:
                light += v * v
    return sorted(heavy)


def cut(text):
    """The terms of a text, as :func:`terms` finds them."""
    return F.filter(F.transform(F.split(ascii_lower(text), _TERM, -1), lambda t: F.btrim(t, F.lit("."))), lambda t: t != "")


def line_licence(text, templates: dict[str, str], least: float):
    """struct(c, licence) of the best template over the lines of ``text``, c being minus the cosine; null under ``least``.

    One projection, no shuffle: a line's dot products are sums over its template terms, its squared length adds
    2 r - 1 squared weights for the r-th of equal terms in sorted order, which makes tf squared in all.
    """
    unit, idf, other = weights(templates)
    heavy = heavy_terms(unit, least)
    # one case-blind test of the raw text; lines are made only from what passes
    whole = "(?i)(^|[^a-z0-9.])(" + "|".join(map(re.escape, heavy)) + ")[.]*($|[^a-z0-9.])"
    known = sorted(idf)

    def look_up(values: dict[str, float]):
        return F.create_map(*[F.lit(x) for t, v in sorted(values.items()) for x in (t, float(v))])

    def weight(t):
        return F.when(t.isin(known), F.element_at(look_up(idf), t)).otherwise(F.lit(other))

    def step(state, t):
        rank = F.when(t == state["term"], state["rank"] + 1).otherwise(F.lit(1.0))
        w = weight(t)
        return F.struct(t.alias("term"), rank.alias("rank"), (state["sum"] + (2 * rank - 1) * w * w).alias("sum"))

    def vector(found):
        start = F.struct(F.lit("").alias("term"), F.lit(0.0).alias("rank"), F.lit(0.0).alias("sum"))
        return F.struct(F.sort_array(F.filter(found, lambda t: t.isin(known))).alias("known"),
                        F.aggregate(F.sort_array(found), start, step, lambda s: F.sqrt(s["sum"])).alias("length"))

    def dot(name, v):
        table = {t: idf[t] * u for t, u in unit[name].items()}
        return F.aggregate(v["known"], F.lit(0.0), lambda a, t: a + F.when(t.isin(sorted(table)), F.element_at(look_up(table), t)).otherwise(F.lit(0.0)))

    def best(v):
        return F.array_min(F.array(*[F.struct((-F.round(dot(n, v) / v["length"], 6)).alias("c"), F.lit(n).alias("licence")) for n in unit]))

    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(whole))
    top = F.array_min(F.transform(F.transform(F.transform(lines, cut), vector), best))
    return F.when(text.rlike(whole), F.when(top["c"] <= -least, top))


def whole_weights(whole: tuple[tuple[str, str], ...]):
    """:func:`weights` of templates by number, each term counted once: in long texts everyday words would outweigh the others."""
    return weights({str(i): " ".join(dict.fromkeys(terms(x))) for i, (_, x) in enumerate(whole)})


def pieces(text):
    """The whole text in pieces of ``PIECE`` characters, each with the first ``OVERLAP`` of the next, cut into terms."""
    parts = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    joined = F.transform(parts, lambda p, i: F.concat(p, F.coalesce(F.substring(F.get(parts, i + 1), 1, OVERLAP), F.lit(""))))
    return F.transform(F.when(F.length(text) > PIECE, joined).otherwise(F.array(text)), cut)


def stretch_licence(text, whole: tuple[tuple[str, str], ...], least: float):
    """struct(c, licence) as :func:`line_licence` has it, of the best template of ``whole`` over stretches of the whole text.

    Of a piece, ``span`` stretch starts at a time are tested together: if the terms they can reach hold fewer than ``k`` of
    a template's rarer terms, none of their stretches can reach ``least``.
    """
    unit, idf, other = whole_weights(whole)
    rows = []
    for i, (name, x) in enumerate(whole):
        rare, k = fewest(unit[str(i)], least)
        n = len(terms(x))
        rows.append({"licence": name, "n": n, "span": max(1, n // 4), "rare": rare, "k": k,
                     "weight": {t: idf[t] * v for t, v in unit[str(i)].items()}})
    # constants, so that the plan holds one comparison for all templates
    table = F.from_json(F.lit(json.dumps(rows)), "array<struct<licence: string, n: int, span: int, rare: array<string>, k: int, "
                                                 "weight: map<string, double>>>")
    squares = F.from_json(F.lit(json.dumps({t: v * v for t, v in idf.items()})), "map<string, double>")
    known = F.split(F.lit(" ".join(sorted(idf))), " ")
    some = F.split(F.lit(" ".join(sorted({t for r in rows for t in r["rare"]}))), " ")

    def cosine(found, row):
        shared = F.array_intersect(found, known)
        length = F.aggregate(shared, (F.size(found) - F.size(shared)) * F.lit(other * other), lambda s, t: s + F.element_at(squares, t))
        dot = F.aggregate(shared, F.lit(0.0), lambda s, t: s + F.coalesce(F.try_element_at(row["weight"], t), F.lit(0.0)))
        return F.struct((-F.round(dot / F.sqrt(length), 6)).alias("c"), row["licence"].alias("licence"))

    def enough(found, row):
        return F.size(F.array_intersect(found, row["rare"])) >= row["k"]

    def starts(found, row):
        spans = F.filter(F.sequence(F.lit(1), F.size(found), row["span"]), lambda a: enough(F.slice(found, a, row["span"] + row["n"] - 1), row))
        return F.flatten(F.transform(spans, lambda a: F.sequence(a, F.least(a + row["span"] - 1, F.size(found)))))

    def best(found):
        near = F.filter(table, lambda r: enough(found, r))
        return F.array_min(F.flatten(F.transform(near, lambda r: F.transform(
            starts(found, r), lambda a: cosine(F.array_distinct(F.slice(found, a, r["n"])), r)))))

    mixed = F.filter(pieces(text), lambda t: F.size(F.array_intersect(t, some)) >= min(r["k"] for r in rows))
    top = F.array_min(F.array_compact(F.transform(mixed, best)))
    return F.when(top["c"] <= -least, top)


def own_licence(text, templates: dict[str, str], least: float, whole: tuple[tuple[str, str], ...] = WHOLE):
    """struct(c, licence): the better of a text's best line and its best stretch, c being minus the cosine; null under ``least``."""
    return F.array_min(F.array_compact(F.array(line_licence(text, templates, least), stretch_licence(text, whole, least))))


def folder(path):
    """The path's folder ('' at the top)."""
    return F.regexp_extract(F.coalesce(path, F.lit("")), "^(.*)/[^/]*$", 1)


def inherited(folders: DataFrame, licensed: DataFrame) -> DataFrame:
    """(folder, licence, from_folder): the licence of the nearest ancestor (or the folder itself) in ``licensed(at, licence)``."""
    up = folders.select("folder", F.explode(F.concat(F.array(F.lit("")), F.when(F.col("folder") != "", F.transform(
        F.sequence(F.lit(1), F.size(F.split("folder", "/", -1))),
        lambda i: F.call_function("substring_index", F.col("folder"), F.lit("/"), i))).otherwise(F.array().cast("array<string>")))).alias("at")).distinct()
    hit = up.join(licensed, "at")
    near = hit.groupBy("folder").agg(F.max_by(F.struct("licence", "at"), F.length("at")).alias("n"))
    return near.select("folder", "n.licence", F.col("n.at").alias("from_folder"))


def scan(files: DataFrame, templates: dict[str, str] | None = None, least: float = 0.75, carry: tuple[str, ...] = ()) -> DataFrame:
    """(carry.., path, licence, cosine, own, from_folder) for every row of ``files(path, text)``; ``carry`` names columns to keep."""
    own = own_licence(F.col("text"), templates or TEMPLATES, least)
    # the texts are read once; what follows has paths and licences only
    all_ = stored(files.select(*[F.col(c).alias(f"__{c}") for c in carry], "path", folder(F.col("path")).alias("folder"), own.alias("best")), "licences")
    licensed = (all_.filter(F.col("best").isNotNull() & F.col("path").rlike(_FILE))
                .groupBy(F.col("folder").alias("at")).agg(F.min("best").alias("b")).select("at", "b.licence"))
    near = inherited(all_.select("folder").distinct(), licensed).withColumnRenamed("licence", "folder_licence")
    return all_.join(near, "folder", "left").select(
        *[F.col(f"__{c}").alias(c) for c in carry], "path", F.coalesce("best.licence", "folder_licence").alias("licence"), (-F.col("best.c")).alias("cosine"),
        F.col("best").isNotNull().alias("own"), F.when(F.col("best").isNull(), F.col("from_folder")).alias("from_folder"))
