"""Best matches between the sentences of documents, with exact bounds.

A sentence that the other side has as it is needs no ratio.  The others are
compared with the sentences of the same document whose length a ratio of at
least MATCH allows, for many documents at once and in blocks of bounded size.
Every sentence has two bitmaps,
of its letters and of its bigrams, each dealt into bins and a bit for every
further one in its bin.  A bit that one sentence has and the other lacks stands
for at least one letter or bigram that isn't shared, which bounds the ratio
from above, by bit counts only.  Bitmaps serve both directions.

Ratios are made from the highest bound down until no bound reaches the best
(and, where a search ends at the first close match, for earlier ones that may
be close).  No bound is below the ratio, so the result is that of comparing
all pairs.  A document's sentences stand in its row, so nothing is shuffled.

A prefix of bigrams is no key: a ratio of 0.8 allows two fifths of all bigrams
to go, so nearly all sentences of one language share a prefix of theirs.
"""

from __future__ import annotations

import math
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import folds

# Least ratio of a match, ratio that ends a search, length gate, matches that an order needs.
MATCH, EARLY, LENGTH_GAP, MIN_MATCHED = 0.80, 0.95, 0.5, 3

#: What rounding may take off a bound.
SLACK = 1e-9
#: Bins of each of the two bitmaps, and the bits of a bin.
BINS = ((64, 8), (256, 2))
#: Pairs of sentences in a block, about, and letters whose bins are counted at once.
PAIRS, LETTERS = 1 << 14, 1 << 20


def bitmaps(texts: list[str]):
    """A row of longs for each text: bits of its letters' bins, then of its bigrams' bins."""
    import numpy as np

    out, sizes = [np.zeros((0, 16), np.uint64)], np.array([len(t) for t in texts], np.int64)
    if not texts:
        return out[0]
    for part in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(np.cumsum(sizes) // LETTERS)) + 1):
        points = np.frombuffer("".join(texts[i] for i in part).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        owner = np.repeat(np.arange(len(part)), sizes[part])
        inside = owner[1:] == owner[:-1]
        bigrams = (points[1:] * np.uint64(1 << 21) + points[:-1])[inside]
        rows = []
        for tokens, whose, (bins, bits) in ((points, owner, BINS[0]), (bigrams, owner[1:][inside], BINS[1])):
            bin_of = ((tokens * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % bins
            counts = np.bincount(whose * bins + bin_of, minlength=len(part) * bins).reshape(len(part), bins, 1)
            rows.append(np.packbits((counts > np.arange(bits)).reshape(len(part), -1), axis=1).view(np.uint64))
        out.append(np.concatenate(rows, axis=1))
    return np.concatenate(out)


def near_all(docs: list[tuple[list[str], list[str]]]):
    """For every needle with some, of documents (needles, sentences): their number and its own, the numbers of the document's sentences whose ratio may be MATCH or more (rising), and what each is at most."""
    import numpy as np

    row: dict[str, int] = {}
    sides = []
    for side in (0, 1):
        own = [(d, i, row.setdefault(t, len(row))) for d, doc in enumerate(docs) for i, t in enumerate(doc[side]) if t]
        sides.append(np.array(own, np.int64).reshape(-1, 3).T)
    if not row:
        return
    bits, sizes = bitmaps(list(row)), np.array([len(t) for t in row], np.int64)
    ones = [np.bitwise_count(x).sum(1, dtype=np.int64) for x in (bits[:, :8], bits[:, 8:])]
    (doc, number, left), (its, place, right) = sides
    # Sentences by document and length: lengths x and y allow at most 2 min(x, y) / (x + y).
    over = 2 * sizes.max() + 3
    keys = its * over + sizes[right]
    by = np.argsort(keys, kind="stable")
    keys, place, right = keys[by], place[by], right[by]
    start = np.searchsorted(keys, doc * over + np.maximum((sizes[left] * MATCH / (2 - MATCH)).astype(np.int64) - 1, 0))
    many = np.searchsorted(keys, doc * over + np.minimum((sizes[left] * (2 - MATCH) / MATCH).astype(np.int64) + 1, over - 1), "right") - start
    ends = np.cumsum(many)
    for block in np.split(np.arange(len(doc)), np.flatnonzero(np.diff(ends // PAIRS)) + 1):
        own = np.repeat(block, many[block])
        at = np.arange(len(own)) - np.repeat(ends[block] - many[block] - (ends[block[0]] - many[block[0]]), many[block]) + start[own]
        bound = np.ones(len(own))
        for k, words in enumerate((slice(0, 8), slice(8, 16))):
            x, y = left[own], right[at]
            n, m = sizes[x], sizes[y]
            both = np.bitwise_count(bits[x, words] & bits[y, words]).sum(1, dtype=np.int64)
            shared, total = np.minimum(n - k - (ones[k][x] - both), m - k - (ones[k][y] - both)), n + m
            # m matched letters stand in at most total - 2 m + 1 blocks, so at least 3 m - total - 1 bigrams are shared.
            bound = np.minimum(bound, 2 / 3 * (shared + total + 1) / total if k else 2 * shared / total)
            may = (bound >= MATCH - SLACK) & (2 * np.minimum(n, m) >= MATCH * total - SLACK) & (abs(n - m) <= n * LENGTH_GAP)
            own, at, bound = own[may], at[may], bound[may]
        by = np.lexsort((place[at], own))
        own, at, bound = own[by], at[by], bound[by]
        cuts = np.flatnonzero(np.diff(own, prepend=-1, append=-1))
        for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield int(doc[own[x]]), int(number[own[x]]), place[at[x:y]], bound[x:y]


def near(needles: list[str], sentences: list[str]):
    """near_all() of one document."""
    return ((i, places, bounds) for _, i, places, bounds in near_all([(needles, sentences)]))


def search(needle: str, sentences: list[str], places, bounds, known: dict[tuple[str, str], float]) -> tuple[float | None, int | None]:
    """Its best ratio of MATCH or more, and the first place of the best sentence; nulls without a match.

    known has ratios of pairs (sentence, needle) that are the same both ways, and gets new ones.

    The search for the ratio ends at the first sentence of EARLY or more; that for the place doesn't.
    """
    places, bounds = places.tolist(), bounds.tolist()
    rated: dict[int, float] = {}

    def rate(k: int) -> float:
        if k not in rated:
            s = sentences[places[k]]
            rated[k], same = (known[s, needle], False) if (s, needle) in known else folds.gestalt_both(needle, s, min(best, EARLY))
            if same:
                known[needle, s] = rated[k]
        return rated[k]

    best, place = MATCH, None
    for k in sorted(range(len(bounds)), key=bounds.__getitem__, reverse=True):
        if bounds[k] < best - SLACK:
            break
        if (r := rate(k)) > best or (r == best and (place is None or places[k] < place)):
            best, place = r, places[k]
    if place is None:
        return None, None
    early = (rate(k) for k, x in enumerate(bounds) if x >= EARLY - SLACK) if best >= EARLY else ()
    return next((r for r in early if r >= EARLY), best), place


def first_places(sentences: list[str]) -> dict[str, int]:
    """The first place of every sentence."""
    out: dict[str, int] = {}
    for k, s in enumerate(sentences):
        if s is not None:
            out.setdefault(s, k)
    return out


def best_of(docs: list[tuple[dict[str, int], dict[str, int]]]) -> list[dict[str, tuple[float, int]]]:
    """(ratio, place) of the needles of each document's (needles, sentences) that have a match: 1 and the first place for one that is there, else those of search()."""
    found = [{s: (1.0, there[s]) for s in own if s in there} for own, there in docs]
    rest = [[s for s in own if s and s not in there] for own, there in docs]
    # Of equal sentences the first is the one to find.
    left = [(needles, list(there) if needles else []) for needles, (_, there) in zip(rest, docs, strict=True)]
    known: dict[tuple[str, str], float] = {}
    for d, i, places, bounds in near_all(left):
        needles, sentences = left[d]
        ratio, k = search(needles[i], sentences, places, bounds, known)
        if k is not None:
            found[d][needles[i]] = ratio, docs[d][1][sentences[k]]
    return found


def matches(extracted: Column, reference: Column) -> Column:
    """Of two arrays of sentences: the sums of the ratios of the reference's sentences and of the extracted ones, each at its best in the other, and the places of the former's matches, in their order.

    Documents are compared in groups of about LETTERS letters.
    """

    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        out, group, letters = [], [], 0
        rows = [[[] if x is None else list(x) for x in row] for row in zip(a, b, strict=True)]
        for n, (e, r) in enumerate(rows):
            group.append((e, r))
            letters += sum(len(s) for s in e if s) + sum(len(s) for s in r if s)
            if letters < LETTERS and n + 1 < len(rows):
                continue
            first = [(first_places(e), first_places(r)) for e, r in group]
            found = best_of([(r, e) for e, r in first] + first)
            for (e, r), to_e, to_r in zip(group, found[: len(group)], found[len(group) :], strict=True):
                # The sums are exact, so that their rounding doesn't hang on the order.
                total, back = (math.fsum(to[s][0] for s in own if s in to) for own, to in ((r, to_e), (e, to_r)))
                out.append((total, back, [to_e[s][1] for s in r if s in to_e]))
            group, letters = [], 0
        return pd.DataFrame(out, columns=["recalled", "precise", "places"])

    return F.pandas_udf(run, "recalled double, precise double, places array<int>")(extracted, reference)


def sentences_of(df: DataFrame, key: str, column: str) -> DataFrame:
    """(doc, n, s) of an array of sentences, n its place."""
    return df.select(F.col(f"`{key}`").alias("doc"), F.posexplode(F.col(f"`{column}`")).alias("n", "s"))


def pairs(needles: DataFrame, sentences: DataFrame) -> DataFrame:
    """needles (doc, n, s) with place, t and bound: sentences of their document whose ratio may be MATCH or more, and what it is at most."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([[(i, int(p), float(x)) for i, places, bounds in near(list(s), list(t)) for p, x in zip(places, bounds, strict=True)] for s, t in zip(a, b, strict=True)])

    listed = lambda df, name: df.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("n", "s"))).alias(name))
    both = listed(needles, "x").join(listed(sentences, "y"), "doc")
    found = both.select("doc", "x", "y", F.explode(F.pandas_udf(run, "array<struct<i:int,p:int,bound:double>>")(F.col("x.s"), F.col("y.s"))).alias("f"))
    x, y = F.col("x")[F.col("f.i")], F.col("y")[F.col("f.p")]
    return found.select("doc", x["n"].alias("n"), x["s"].alias("s"), y["n"].alias("place"), y["s"].alias("t"), "f.bound")


def fuzzy_scores(df: DataFrame, key: str, extracted: str, reference: str) -> DataFrame:
    """df (unique keys) with recall, precision and order of two arrays of sentences.

    recall is the sum of the matched ratios over all reference sentences, 1
    where there are none; precision the same over extracted ones, 0 where
    either side has none; order is the share of matched pairs in rising order
    times the share of matched sentences, null under MIN_MATCHED sentences or
    matches.
    """
    e, r = F.col(f"`{extracted}`"), F.col(f"`{reference}`")
    share = lambda total, own: F.when(F.size(own) > 0, F.round(total / F.size(own), 4))
    scored = df.withColumn("_found", matches(e, r))
    places = F.col("_found.places")
    sizes = F.least(F.size(r), F.size(e), F.size(places))
    rising = folds.udf(folds.rising_share, "double")(places)
    order = F.when(sizes >= MIN_MATCHED, F.round(rising * F.size(places) / F.size(r), 4))
    out = {"recall": F.coalesce(share(F.col("_found.recalled"), r), F.lit(1.0)), "precision": F.coalesce(share(F.col("_found.precise"), e), F.lit(0.0)), "order": order}
    return scored.withColumns(out).drop("_found")


# Functions travel inside the tasks, so workers need not import this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
