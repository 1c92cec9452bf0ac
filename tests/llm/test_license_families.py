"""Licence scan: short names, several families in a paragraph, sisters, and texts that no frame made."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lucidex.llm import licenses

TEXTS = Path("/usr/share/common-licenses")

CASES = {
    "MIT License": "MIT", "The MIT License (MIT)": "MIT", "SPDX-License-Identifier: MIT": "MIT", "Licensed under MIT.": "MIT", "License: MIT": "MIT", "* License:  MIT": "MIT", "This code is MIT licensed.": "MIT", "This code is MIT-licensed, mostly.": "",
    "Released under the MIT Licence.": "MIT", "Available under CC-BY-SA 3.0": "CC-BY-SA", "This content is in the public domain under CC0.": "CC0", "you may not use this file except in compliance with the License.": "Apache",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.": "BSD", "BSD-3-Clause OR Apache-2.0": "Apache,BSD", "Dual licensed under the MIT and GPL licenses.": "GPL,MIT",
    "Released under the MIT License and the Apache License, Version 2.0.": "Apache,MIT", "You should have received a copy of the GNU Affero General Public License along with this program.": "AGPL",
    "You should have received a copy of the GNU Lesser General Public License along with this library.": "LGPL", "You should have received a copy of the GNU General Public License along with this program.": "GPL",
    "Eine freie License mit vielen Regeln.": "", "He got a license: mit einem Hund.": "", "The MIT faculty met.": "", "BSD": "", "Apache": "", "!!! ...": "", "licensed under " * 5000: "", "x" * 100000: "",
}

# Frames that the training doesn't have.
NEW_FRAMES = ["Our code may be reused by anyone, thanks to the {} it carries.", "{} applies to every file in this folder.", "Text and figures: {}", "We chose the {} for this package.", "Copyright 2019 the authors, {}.", "Covered by the {}; see LICENSE.txt"]


def found(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["families"] for r in licenses.document_table(rows).orderBy("doc_id").collect()]


def test_short_names_and_several_families(spark):
    assert dict(zip(CASES, found(spark, CASES), strict=True)) == CASES


def test_families_match_plain_python(spark):
    m = licenses.model()
    lines = [t for _, t in licenses.examples()][::11] + [t for t, _ in licenses.idle()][::9] + list(CASES)
    rows = spark.createDataFrame(list(enumerate(lines)), "i int, line string").select("i", licenses.score(F.col("line"))["families"].alias("f")).orderBy("i").collect()
    for x, r in zip(lines, rows, strict=True):
        assert sorted(f["family"] for f in r["f"]) == m.families_of(x)
        p = m.against_unknown(licenses.grams(licenses.words(x)))
        assert all(abs(f["posterior"] - p[m.families.index(f["family"]) - 1]) < 1e-9 and f["posterior"] >= m.threshold for f in r["f"])


def test_calibration_shares_no_frame_and_no_filler_with_training():
    trained = {t for y, t in licenses.examples()}
    held = [t for t, h in licenses.idle() if h]
    m = licenses.model()
    assert len(held) >= 100 and not trained & set(held)
    reached = [max(m.against_unknown(licenses.grams(licenses.words(t)))) >= m.threshold for t in held]
    assert sum(reached) <= licenses.FALSE_POSITIVES * len(held)


def test_recall_on_frames_that_training_never_saw():
    m = licenses.model()
    cases = [(f, frame.format(x)) for f, names in licenses.FAMILIES.items() for x in names for frame in NEW_FRAMES]
    missed = [(f, t) for f, t in cases if f not in m.families_of(t)]
    wrong = [(f, t) for f, t in cases if set(m.families_of(t)) - {f}]
    assert len(missed) <= 0.05 * len(cases), missed[:20]
    assert len(wrong) <= 0.01 * len(cases), wrong[:20]


@pytest.mark.skipif(not TEXTS.is_dir(), reason="no licence texts on this machine")
def test_whole_licence_texts(spark):
    names = {"Apache-2.0": "Apache", "BSD": "BSD", "CC0-1.0": "CC0", "GPL-2": "GPL", "GPL-3": "GPL", "LGPL-2.1": "LGPL", "LGPL-3": "LGPL", "MPL-2.0": "MPL"}
    names = {n: f for n, f in names.items() if (TEXTS / n).exists()}
    for (n, f), own in zip(names.items(), found(spark, [(TEXTS / n).read_text() for n in names]), strict=True):
        assert f in own.split(","), (n, own)
