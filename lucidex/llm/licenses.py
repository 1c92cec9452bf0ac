"""Licence scan of paragraphs (DataFrame functions only on the tables' path).

A multinomial logistic regression over the presence of word 1- to 3-grams,
kept sparse by an L1 penalty, gives each paragraph a posterior over licence
families and `unknown`.  It is trained here, once per process, on names and
paragraphs of licence texts, on sentences made by rule from names, and on
sentences that speak of licences but grant none.  A paragraph may name several
families: each is held against `unknown` alone.  The threshold is calibrated on
sentences whose frames or fillers the training never saw: the smallest
posterior that at most FALSE_POSITIVES of them reach (a template must agree
besides).  A prediction counts when
its posterior reaches the threshold and a template of the family is found in
the paragraph: MIN_SIMILARITY of the template's pairs of neighbouring words
stand there as neighbours (a template of one word stands there itself).  Of
templates of different families that share half their pairs the more similar
one counts, so the notice of one licence isn't that of its sister too.

Only n-grams with a positive weight for a family can move a paragraph away
from `unknown`; paragraphs without any are told apart by one regular
expression, which changes no result.

A paragraph is a line.  Notices wrapped over several lines are found in joins
of neighbouring lines: each line with those after it, up to a blank line or
as many words as the longest template has.  Of joins that start on successive
lines and find the same family the last counts, and none counts that holds a
line which names the family by itself; so wrapped notices of one family that
follow each other without a blank line can count as one.

Defined cases: null text has no paragraph; empty paragraphs are none; very
long paragraphs are scored whole; repeated rows give a row each; empty tables
give no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
import json
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "unknown"
MIN_SIMILARITY = 0.8
FALSE_POSITIVES = 0.05
# A heading "License:" that opens a line is a word of its own, as in "License: MIT".
WORD = r"(?<![a-z0-9.+-])(?<![a-z0-9.+-] )license:|[a-z0-9]+(?:[.+-][a-z0-9]+)*"

# Names of licence families, and openings of their notices.
FAMILIES = {
    "AGPL": ["GNU Affero General Public License", "AGPL-3.0", "AGPLv3", "GNU AGPL"],
    "Apache": ["Apache License", "Apache-2.0", "Apache 2.0 license", "Apache Software License"],
    "BSD": ["BSD License", "BSD-3-Clause", "BSD-2-Clause", "3-Clause BSD License", "New BSD License"],
    "CC-BY": ["CC BY 4.0", "CC BY 3.0", "CC-BY-4.0", "CC-BY-3.0", "CC-BY", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License"],
    "CC-BY-NC": ["CC BY-NC 4.0", "CC-BY-NC-4.0", "CC BY-NC", "CC-BY-NC", "CC BY-NC-SA", "CC-BY-NC-SA", "CC BY-NC-ND", "CC-BY-NC-ND", "Creative Commons Attribution-NonCommercial License"],
    "CC-BY-SA": ["CC BY-SA 4.0", "CC-BY-SA-4.0", "CC BY-SA", "CC-BY-SA", "Creative Commons Attribution-ShareAlike License"],
    "CC0": ["CC0", "CC0 1.0", "CC0-1.0", "CC0 Public Domain Dedication"],
    "EPL": ["Eclipse Public License", "EPL-2.0"],
    "GPL": ["GNU General Public License", "GPL-3.0", "GPL-2.0", "GPLv3", "GPLv2", "GNU GPL"],
    "ISC": ["ISC License"],
    "LGPL": ["GNU Lesser General Public License", "GNU Library General Public License", "LGPL-2.1", "LGPL-3.0", "LGPLv3", "GNU LGPL"],
    "MIT": ["MIT License", "MIT/X11 License", "Expat License", "the MIT licence"],
    "MPL": ["Mozilla Public License", "MPL-2.0", "MPL 2.0"],
    "Unlicense": ["the Unlicense", "Unlicense"],
}
NOTICES = {
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ],
    "GPL": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "You should have received a copy of the GNU General Public License along with this program"],
    "MIT": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at mozilla.org"],
    "AGPL": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "You should have received a copy of the GNU Affero General Public License along with this program"],
    "LGPL": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "You should have received a copy of the GNU Lesser General Public License along with this library"],
    "EPL": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License"],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"],
    "Apache": [
        "You may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org", "You may not use this file except in compliance with the License",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted"],
    "Unlicense": ["This is free and unencumbered software released into the public domain", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose"],
}
# Short names that mean a licence only beside the words of SHORT_FORMS.
SHORT = {"AGPL": ["AGPL"], "Apache": ["Apache", "Apache 2.0"], "BSD": ["BSD"], "EPL": ["EPL"], "GPL": ["GPL"], "ISC": ["ISC"], "LGPL": ["LGPL"], "MIT": ["MIT"], "MPL": ["MPL"]}
SHORT_FORMS = ["licensed under {}", "licensed under the {}", "released under {}", "available under {}", "distributed under {}", "{} licensed", "{} license", "{} licenses", "License: {}", "SPDX-License-Identifier: {}"]
FRAMES = [
    "{}", "The {}.", "Licensed under {}.", "Licensed under the {}.", "Released under the {}.", "Distributed under the terms of the {}.", "This work is licensed under the {}.",
    "This work is licensed under {}.", "This software is available under the {}.", "This project is provided under the {}, version 2.0.", "Licensed under the {}, version 3.",
    "SPDX-License-Identifier: {}", "You may use this file under the terms of the {}.", "See the {} for details.", "All content is published under {} unless stated otherwise.", "License: {}", "Available under {}", "The code is {} licensed.",
]
OTHER = [
    "All rights reserved.", "Licensed under the terms agreed between the parties.", "This work is licensed under a commercial agreement.", "Released under the new name in the spring.",
    "You need a driving license to rent a car.", "The license fee is due every year.", "The institute in Massachusetts published a study.", "The apache helicopter landed.", "He spoke of general public opinion.",
    "Wir fahren mit dem Zug und kommen mit dem Rad zurück.", "Die Lizenz wurde erteilt.", "La licence de pêche est valable un an.", "El permiso se concede por un año.", "She cc'd the manager by mistake at 4.0.",
    "The attribution of the painting is unknown.", "Version 2.0 of the software was released in March.", "Permission to enter was granted by the guard.", "Free software is software that you can change.",
    "The MIT faculty renewed the library license for another year.", "Students of the MIT asked for a license.", "A public license to fish in the lake is free of charge.", "The foundation published a general report on free software.",
    "You may not use this room except in compliance with the house rules.", "Redistribution of the seats was permitted under certain conditions.", "The terms of the treaty were published.", "This program is on television tonight.", "See the appendix for details.", "The public domain of science grows.", "Mozilla and Eclipse are names of programs.",
]

# Sentences about licences that grant none: frames and what fills them; training has the even places of both, calibration the odd ones.
IDLE_FRAMES = [
    "She asked the {} for a license.", "The {} renewed its license last year.", "A license of the {} costs forty euros.", "The {} was released under pressure.", "Students of the {} met under the old terms.", "The {} published a general report.",
    "They were licensed under the rules of the {}.", "The {} made its public archive available under supervision.", "Permission was granted by the {}, free of charge.", "The notice of the {} shall be included in all letters.", "Die Lizenz der {} ist abgelaufen.",
    "La licence de la {} est valable un an.", "The software of the {} is sold as a product.", "Copies of the report were distributed under the {}.", "The {} may not use this room except in compliance with the rules.", "License fees of the {} rose.",
    "The foundation gave the {} a copy of its work.", "Redistribution of income was the aim of the {}.", "The conditions of the {} are met.", "No {} holds a patent for it.",
]
IDLE = [
    "MIT faculty", "MIT rowing team", "Apache nation", "Apache helicopter", "Berkeley office", "Berkeley choir", "Mozilla office", "Mozilla team", "Eclipse festival", "Eclipse watchers", "GNU herd", "GNU keeper", "ISC conference", "ISC tribunal",
    "creative class", "common council", "general public", "general assembly", "public library", "software vendor", "affero mill", "attribution study", "school board", "city council",
]


def normal(text: str) -> str:
    return text.lower().replace("licenc", "licens")


def words(text: str) -> list[str]:
    return re.findall(WORD, normal(text))


def grams(tokens: list[str]) -> set[str]:
    return {" ".join(tokens[i : i + n]) for n in (1, 2, 3) for i in range(len(tokens) - n + 1)}


def phrases(family: str) -> list[str]:
    """Names, short names beside words that make them licences, and notices of a family: its templates."""
    return [*FAMILIES[family], *[form.format(x) for x in SHORT.get(family, []) for form in SHORT_FORMS], *NOTICES.get(family, [])]


def idle() -> list[tuple[str, bool]]:
    """Sentences without a licence, and whether calibration has them: every second frame with every second filler, so it shares neither with training."""
    return [(frame.format(x), i % 2 == 1) for i, frame in enumerate(IDLE_FRAMES) for j, x in enumerate(IDLE) if i % 2 == j % 2]


def examples() -> list[tuple[str, str]]:
    made = [(family, frame.format(name)) for family, names in FAMILIES.items() for name in names for frame in FRAMES]
    made += [(family, x) for family in FAMILIES for x in phrases(family)]
    blank = ["new plan", "old agreement", "terms below", "house rules", "first edition", "editor's name", "committee", "city council", "school license", "general license", "public license office", "GNU project", "by 4.0 percent"]
    return made + [(UNKNOWN, s) for s in OTHER] + [(UNKNOWN, frame.format(x)) for frame in FRAMES for x in blank] + [(UNKNOWN, s) for s, held in idle() if not held]


class Model:
    """Sparse weights by n-gram and family, the intercepts, the temperature and the threshold."""

    def __init__(self, steps: int = 400, l1: float = 1e-4):
        import numpy as np

        self.families = [UNKNOWN, *FAMILIES]
        # Plain sentences without a licence are few, and so are notices: each counts several times in training.
        notices = {x for own in NOTICES.values() for x in own}
        rows = [(self.families.index(y), grams(words(t)), 4 if t in OTHER else 6 if t in notices else 1) for y, t in dict.fromkeys(examples())]
        fit = [(k, own) for k, own, often in rows for _ in range(often)]
        often: dict[str, int] = {}
        for _, own in fit:
            for g in own:
                often[g] = often.get(g, 0) + 1
        vocabulary = sorted(g for g, n in often.items() if n > 1)
        at = {g: i for i, g in enumerate(vocabulary)}

        def matrix(part):
            x = np.zeros((len(part), len(vocabulary)))
            for i, (_, own) in enumerate(part):
                x[i, [at[g] for g in own if g in at]] = 1
            return x, np.array([y for y, _ in part])

        x, y = matrix(fit)
        seen = np.eye(len(self.families))[y]
        w, b = np.zeros((len(vocabulary), len(self.families))), np.zeros(len(self.families))
        z, zb, t = w, b, 1.0
        v = np.ones(x.shape[1])
        for _ in range(30):  # the largest eigenvalue, by power iteration
            v = x.T @ (x @ (v / np.linalg.norm(v)))
        step = 1.8 * len(x) / (np.linalg.norm(v) + len(x))
        for _ in range(steps):  # proximal gradient with momentum
            s = x @ z + zb
            p = np.exp(s - s.max(1, keepdims=True))
            e = (p / p.sum(1, keepdims=True) - seen) / len(x)
            new = z - step * (x.T @ e)
            new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
            nb = zb - step * e.sum(0)
            nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
            z, zb = new + (t - 1) / nt * (new - w), nb + (t - 1) / nt * (nb - b)
            w, b, t = new, nb, nt
        keep = np.abs(w).max(1) > 1e-3
        self.weights = {g: [round(float(v), 6) for v in w[i]] for g, i in at.items() if keep[i]}
        self.bias = [round(float(v), 6) for v in b]
        reached = sorted((max(self.against_unknown(grams(words(t)))) for t, held in idle() if held), reverse=True)
        self.threshold = round(reached[int(FALSE_POSITIVES * len(reached))] + 1e-6, 6)

    def scores(self, own: set[str]) -> list[float]:
        return [b + sum(self.weights[g][k] for g in own if g in self.weights) for k, b in enumerate(self.bias)]

    def posterior(self, own: set[str]) -> list[float]:
        z = self.scores(own)
        e = [math.exp(v - max(z)) for v in z]
        return [v / sum(e) for v in e]

    def against_unknown(self, own: set[str]) -> list[float]:
        """Posterior of each family, were it or `unknown` the only classes."""
        unknown, *z = self.scores(own)
        return [1 / (1 + math.exp(unknown - v)) for v in z]

    def predict(self, paragraph: str) -> tuple[str, bool]:
        """Likeliest family and whether a template confirms it, by plain Python, for tests."""
        z = self.scores(grams(words(paragraph)))
        k = max(range(len(z)), key=lambda k: (z[k], -k))
        if not k or 1 / (1 + math.exp(z[0] - z[k])) < self.threshold:
            return UNKNOWN, False
        return self.families[k], self.families[k] in self.families_of(paragraph)

    def families_of(self, paragraph: str) -> list[str]:
        """Confirmed families, sorted, by plain Python, for tests."""
        p = self.against_unknown(grams(words(paragraph)))
        own = set(pairs(words(paragraph)))
        found = [(len(own & set(t)) / len(t), p[k], -k, f, set(t)) for k, f in enumerate(self.families[1:]) if p[k] >= self.threshold for t in templates()[f] if len(own & set(t)) >= MIN_SIMILARITY * len(t)]
        return sorted({x[3] for x in found if not any(y[3] != x[3] and y[:3] > x[:3] and 2 * len(x[4] & y[4]) >= min(len(x[4]), len(y[4])) for y in found)})


@functools.cache
def model() -> Model:
    return Model()


def pairs(tokens: list[str]) -> list[str]:
    """Pairs of neighbouring words, and the single words."""
    return [*tokens, *(f"{a} {b}" for a, b in zip(tokens, tokens[1:], strict=False))]


def templates() -> dict[str, list[list[str]]]:
    """Distinct pairs of neighbouring words of each family's names and notices; the word itself where there is one."""
    return {f: [list(t) for t in dict.fromkeys(tuple(sorted(set(pairs(t)[len(t) :] or t))) for t in map(words, phrases(f)))] for f in FAMILIES}


def possible(low: Column) -> Column:
    """Whether a lower-case text has words enough for a template to be found in it.

    Of a template of n pairs, n - ceil(MIN_SIMILARITY * n) may be missing, and
    no more words, as each missing word breaks a pair of its own (one more for
    each pair that the template repeats): if none may, all are looked for, the
    longest first; else one of so many and one more.  A text without them has
    no confirmed prediction.
    """
    needed: set[tuple[str, ...]] = set()
    for own in {x for f in FAMILIES for x in phrases(f)}:
        every = pairs(words(own))[len(words(own)) :] or words(own)
        n = len(set(every))
        missing = n + math.floor(-MIN_SIMILARITY * n) + len(every) - n
        by_length = sorted(set(words(own)), key=lambda w: (-len(w), w))
        needed |= {(w,) for w in by_length[: missing + 1]} if missing else {tuple(by_length)}
    # A word that is enough by itself spares all that need a word around it; the others are parted by their longest word.
    enough = {w for w, *more in needed if not more}
    needed = {own for own in needed if not any(x in w and own != (x,) for x in enough for w in own)}
    by_first: dict[str, list[tuple[str, ...]]] = {}
    for first, *more in sorted(needed):
        by_first.setdefault(first, []).append(tuple(more))
    some = lambda xs: functools.reduce(lambda a, b: a | b, xs)
    every_of = lambda xs: functools.reduce(lambda a, b: a & b, [F.contains(low, F.lit(w)) for w in xs])
    return F.coalesce(some([F.contains(low, F.lit(first)) & (F.lit(True) if () in rest else some(map(every_of, rest))) for first, rest in by_first.items()]), F.lit(False))


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda p: F.trim(p) != "")


def _let(value: Column, body) -> Column:
    """body of value, evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def low(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("licenc"), F.lit("licens"))


def rivals() -> list[tuple[int, list[str], list[int]]]:
    """(family's place from 1, pairs, numbers from 0 of the templates of other families that share half the pairs) of all templates."""
    every = [(k, t) for k, f in enumerate(FAMILIES, 1) for t in templates()[f]]
    return [(k, t, [i for i, (j, u) in enumerate(every) if j != k and 2 * len(set(t) & set(u)) >= min(len(t), len(u))]) for k, t in every]


def score(line: Column) -> Column:
    """struct(family, posterior, similarity, confirmed, families) of one paragraph.

    The first four are the likeliest family's; families is an array of
    struct(family, posterior, similarity) of all confirmed ones, each with its
    posterior against `unknown`.
    """
    m = model()
    array = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    # Given as JSON, which the optimizer folds into one literal, instead of a call for each number.
    weights = F.from_json(F.lit(json.dumps(m.weights)), "map<string,array<double>>")
    table = F.from_json(F.lit(json.dumps([{"i": i, "k": k, "t": t, "rivals": others} for i, (k, t, others) in enumerate(rivals())])), "array<struct<i:int,k:int,t:array<string>,rivals:array<int>>>")
    names = F.array(*[F.lit(f) for f in m.families])

    def runs(single: Column, n: int) -> Column:
        """Runs of n words."""
        ahead = lambda i: F.slice(single, F.lit(1 + i), F.greatest(F.size(single) - (n - 1), F.lit(0)))
        out = ahead(0)
        for i in range(1, n):
            out = F.zip_with(out, ahead(i), lambda a, b: F.concat_ws(" ", a, b))
        return out

    def sums(single: Column) -> Column:
        # Membership is looked up by hash; only the few known grams go through the map.
        known = F.filter(F.array_distinct(F.concat(single, runs(single, 2), runs(single, 3))), lambda g: g.isin(list(m.weights)))
        return F.aggregate(known, array(m.bias), lambda acc, g: F.zip_with(acc, F.element_at(weights, g), lambda a, b: a + b))

    def better(x: Column, y: Column) -> Column:
        """Whether y is the likelier of two templates: more similar, then of higher posterior, then of the earlier family."""
        key = lambda v: F.struct(v["similarity"], v["posterior"], -v["k"])
        return key(y) > key(x)

    def confirmed(z: Column, own: Column) -> Column:
        against = lambda k: 1 / (1 + F.exp(F.element_at(z, F.lit(1)) - F.element_at(z, k + 1)))
        likely = F.filter(table, lambda t: against(t["k"]) >= m.threshold)
        rated = F.transform(likely, lambda t: F.struct(t["i"].alias("i"), t["k"].alias("k"), t["rivals"].alias("rivals"), against(t["k"]).alias("posterior"), (F.size(F.array_intersect(t["t"], own)) / F.size(t["t"])).alias("similarity")))
        return F.filter(rated, lambda t: t["similarity"] >= MIN_SIMILARITY)

    def kept(found: Column) -> Column:
        best = F.filter(found, lambda x: ~F.exists(found, lambda y: F.array_contains(x["rivals"], y["i"]) & better(x, y)))
        families = lambda k: F.array_max(F.transform(F.filter(best, lambda x: x["k"] == k), lambda x: F.struct(x["similarity"].alias("similarity"), x["posterior"].alias("posterior"))))
        ks = F.array_sort(F.array_distinct(F.transform(best, lambda x: x["k"])))
        return F.transform(ks, lambda k: _let(families(k), lambda x: F.struct(F.element_at(names, k + 1).alias("family"), x["posterior"].alias("posterior"), x["similarity"].alias("similarity"))))

    def judged(z: Column, own: Column) -> Column:
        best = F.array_position(z, F.array_max(z)).cast("int")
        posterior = 1 / F.aggregate(F.transform(z, lambda v: F.exp(v - F.array_max(z))), F.lit(0.0), lambda a, v: a + v)
        sure = 1 / (1 + F.exp(F.element_at(z, F.lit(1)) - F.element_at(z, best))) >= m.threshold
        family = F.when((best > 1) & sure, F.element_at(names, best)).otherwise(F.lit(UNKNOWN))
        alike = F.array_max(F.transform(F.filter(table, lambda t: t["k"] == best - 1), lambda t: F.size(F.array_intersect(t["t"], own)) / F.size(t["t"])))
        return _let(
            F.struct(family.alias("family"), posterior.alias("posterior"), alike.alias("similarity"), _let(confirmed(z, own), kept).alias("families")),
            lambda r: F.struct(r["family"].alias("family"), r["posterior"].alias("posterior"), r["similarity"].alias("similarity"), F.exists(r["families"], lambda x: x["family"] == r["family"]).alias("confirmed"), r["families"].alias("families")),
        )

    found = F.regexp_extract_all(low(line), F.lit(f"({WORD})"), F.lit(1))
    return _let(found, lambda own: _let(sums(own), lambda z: _let(F.concat(own, runs(own, 2)), lambda both: judged(z, both))))


def longest_template() -> int:
    return max(len(words(x)) for f in FAMILIES for x in phrases(f))


def joined(lines: Column, i: Column) -> Column:
    """Line i (from 0) with the lines after it, up to a blank line or the words of the longest template."""
    n = longest_template()
    ahead = F.array_join(F.slice(lines, i + 1, F.lit(n + 1)), "\n")
    block = F.regexp_replace(ahead, r"\n[ \t\r]*(?:\n[\s\S]*|$)", "")
    return F.regexp_extract(block, rf"^[^\n]*(?:\s+(?:[^\sA-Za-z0-9]+\s+)*+\S*[A-Za-z0-9]\S*){{0,{n}}}+", 0)


def hits(text: Column) -> Column:
    """array of struct(i, paragraph, s): confirmed licences of a text, by their first line."""
    blank = lambda x: F.trim(x) == ""

    # A join that starts on a line without a word of a notice is found from a later line too.
    starts = "|".join(sorted({re.escape(w) for own in NOTICES.values() for x in own for w in words(x) if len(w) > 3}))

    def confirmed(lines: Column) -> Column:
        one = F.transform(lines, lambda x, i: F.struct(i.alias("i"), F.lit(1).alias("k"), x.alias("t")))
        some = F.filter(F.transform(one, lambda x: F.when(F.rlike(low(x["t"]), F.lit(starts)), _let(joined(lines, x["i"]), lambda t: F.struct(x["i"].alias("i"), F.size(F.split(t, "\n")).alias("k"), t.alias("t"))))), lambda x: x["k"] > 1)
        tried = F.filter(F.concat(one, some), lambda x: ~blank(x["t"]) & _let(low(x["t"]), possible))
        return F.flatten(F.transform(tried, lambda x: F.transform(score(x["t"])["families"], lambda s: F.struct(x["i"].alias("i"), x["k"].alias("k"), s.alias("s")))))

    def counted(found: Column) -> Column:
        same = lambda x, y: x["s"]["family"] == y["s"]["family"]
        single = lambda x, y: (y["k"] == 1) & (y["i"] >= x["i"]) & (y["i"] < x["i"] + x["k"])
        later = lambda x, y: (y["k"] > 1) & (y["i"] == x["i"] + 1)
        # First joins without a line that says it alone, then the last of each run of them.
        alone = F.filter(found, lambda x: (x["k"] == 1) | ~F.exists(found, lambda y: same(x, y) & single(x, y)))
        return _let(alone, lambda left: F.filter(left, lambda x: (x["k"] == 1) | ~F.exists(left, lambda y: same(x, y) & later(x, y))))

    none = F.array().cast("array<struct<i:int,paragraph:int,s:struct<family:string,posterior:double,similarity:double>>>")
    number = lambda lines, i: F.size(F.filter(F.slice(lines, F.lit(1), i), lambda p: ~blank(p)))
    found = _let(F.split(text, "\n"), lambda lines: F.transform(_let(confirmed(lines), counted), lambda x: F.struct(x["i"].alias("i"), number(lines, x["i"]).alias("paragraph"), x["s"].alias("s"))))
    return F.when(_let(low(text), possible), F.array_sort(found)).otherwise(none)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, paragraph, family, posterior, similarity) of each paragraph, or join of some by its first, with a confirmed licence, a row for each family in it; narrow."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where(_let(low(F.col("text")), possible))
    return rows.select("key", F.explode(hits(F.col("text"))).alias("x")).select(F.col("key").alias(key), "x.paragraph", "x.s.family", "x.s.posterior", "x.s.similarity")


def document_table(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_paragraphs, n_licences, families) for every document row; narrow.

    n_licences counts paragraphs, and wrapped notices, with a confirmed
    licence, once for each family in them; families lists their families, sorted and joined by commas.
    """
    rows = docs.select(F.col(key).alias("key"), F.size(paragraphs(F.col(text))).cast("long").alias("n_paragraphs"), F.transform(hits(F.col(text)), lambda x: x["s"]["family"]).alias("found"))
    return rows.select(F.col("key").alias(key), "n_paragraphs", F.size("found").cast("long").alias("n_licences"), F.array_join(F.array_sort(F.array_distinct("found")), ",").alias("families"))
