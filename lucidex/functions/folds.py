"""Text functions whose next step depends on all steps before, one Arrow batch at a time.

Each is plain Python over one text; udf() makes it a vectorised column
function.  Null text gives null.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Callable
from difflib import SequenceMatcher

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F

EARLY = 0.95

#: Most pieces of a text whose places in another are looked up one by one.
PIECES = 16

_BLANK = re.compile(r"\n\s*\n")

# Marks of list items and tables; names of layout rests.
_LIST = re.compile(r"[-*]\s+|\d+\.\s")
_TABLE = re.compile(r"table\s+\d+\b", re.I)
LAYOUT_NAMES = ("ScienceDirect", "Review")


def udf(f: Callable, kind: str):
    """f(text, ...) as an Arrow-batched column function; made when it is applied, so importing needs no session."""

    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([None if row[0] is None else f(*row) for row in zip(*columns, strict=True)])

    def one(a: pd.Series) -> pd.Series:
        return run(a)

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return run(a, b)

    return lambda *columns: F.pandas_udf(one if len(columns) == 1 else two, kind)(*columns)


class Block:
    """A paragraph-like block with what stitching asks of it."""

    def __init__(self, text: str):
        self.text = text
        rows = [x.strip() for x in text.splitlines() if x.strip()]
        table = bool(rows) and (all(r.startswith("|") for r in rows) or bool(_TABLE.match(rows[0])))
        layout = text.startswith("<!--") and text.endswith("-->") or text.splitlines()[0].strip() in LAYOUT_NAMES
        self.interrupts = text.splitlines()[0].strip().startswith("#") or table or layout
        self.body = not self.interrupts and not _LIST.match(text) and len(text.split()) >= 12

    @property
    def unfinished(self) -> bool:
        return self.text.rstrip()[-1:] not in tuple(".!?;:)”’]")

    @property
    def continues(self) -> bool:
        return self.body and self.text.lstrip()[:1].islower()


def split_blocks(text: str) -> list[str]:
    return [b for b in map(str.strip, _BLANK.split(text)) if b]


def stitch_paragraphs(text: str, reach: int = 8) -> str:
    """Join an unfinished body paragraph with the one that continues it behind figures, tables or headings."""
    blocks = [Block(b) for b in split_blocks(text)]
    gone: set[int] = set()
    for i, block in enumerate(blocks):
        if i in gone or not block.body or not block.unfinished:
            continue
        ahead = (j for j in range(i + 1, min(len(blocks), i + 1 + reach)) if j not in gone and blocks[j].body)
        j = next(ahead, None)
        if j is not None and blocks[j].continues:
            block.text = f"{block.text.rstrip()} {blocks[j].text.lstrip()}"
            gone.add(j)
    return "\n\n".join(b.text for i, b in enumerate(blocks) if i not in gone)


def common_start(a: str, b: str) -> int:
    """How many letters both begin with, by halving."""
    if a[:1] != b[:1]:
        return 0
    least, over = 0, min(len(a), len(b))
    if a[:over] == b[:over]:
        return over
    while over - least > 1:
        middle = (least + over) // 2
        if a[least:middle] == b[least:middle]:
            least = middle
        else:
            over = middle
    return least


def common_end(a: str, b: str) -> int:
    return common_start(a[::-1], b[::-1]) if a[-1:] == b[-1:] else 0


def longest_block(a: str, b: str) -> tuple[int, int, int, bool]:
    """(i, j, size, alone) of the longest part of a that b has too: the first of them in a, at its first place in b; alone only if it is the only one or all of a or b.

    A common start or end gives a size to reach.  A part of a that does holds
    one of a's pieces of half that size, so all places of these pieces in b,
    with what is equal around them, show it.  Where there would be many pieces,
    whether there is a part of a given size is asked of the set of b's parts.
    """
    start, end, most = common_start(a, b), common_end(a, b), min(len(a), len(b))
    size = max(start, end)
    if size == most:
        return a.find(b[:most]) if len(b) == most else 0, b.find(a[:most]) if len(a) == most else 0, size, True
    piece = max(1, (size + 1) // 2)
    if len(a) <= PIECES * piece:
        found = {at for at, n in (((0, 0), start), ((len(a) - end, len(b) - end), end)) if n == size}
        for i in range(0, len(a) - piece + 1, piece):
            own = a[i : i + piece]
            j = b.find(own)
            while j >= 0:
                if not (i == j and i + piece <= start or len(a) - i == len(b) - j <= end):  # else it is known
                    before = common_end(a[:i], b[:j])
                    n = before + piece + common_start(a[i + piece :], b[j + piece :])
                    if n > size:
                        found, size = {(i - before, j - before)}, n
                    elif n == size:
                        found.add((i - before, j - before))
                j = b.find(own, j + 1)
        return *min(found), size, len(found) == 1

    def first(size: int) -> int:
        parts = {b[j : j + size] for j in range(len(b) - size + 1)}
        return next((i for i in range(len(a) - size + 1) if a[i : i + size] in parts), -1)

    at, step = (0 if start and start >= end else -1), 1
    while size < most and (found := first(min(size + step, most))) >= 0:
        at, size, step = found, min(size + step, most), 2 * step
    over = min(size + step, most + 1)
    while over - size > 1:
        middle = (size + over) // 2
        found = first(middle)
        at, size, over = (found, middle, over) if found >= 0 else (at, size, middle)
    if not size:
        return 0, 0, 0, False
    at = at if at >= 0 else first(size)
    return at, b.index(a[at : at + size]), size, False


def subsequence(a: str, b: str) -> int:
    """Letters of the longest common subsequence; a bit of the number is a letter of a, unset once it is in use."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    free = every = (1 << len(a)) - 1
    for c in b:
        if at := free & places.get(c, 0):
            free = free + at | free - at
    return len(a) - (free & every).bit_count()


def rare_block(a: str, b: str) -> Callable:
    """block(left, right, low, high) for a[left:right] and b[low:high] as the matcher finds it in a long b: the longest run of letters that are rare in b, with what is equal around it."""
    least = len(b) // 100 + 1
    places: dict[str, list[int]] = {c: [] for c in set(b) if b.count(c) <= least}
    for j, c in enumerate(b):
        if c in places:
            places[c].append(j)
    rare = [(i, places[c]) for i, c in enumerate(a) if c in places]

    def block(left: int, right: int, low: int, high: int) -> tuple[int, int, int, bool]:
        i, j, size, ends, last = left, low, 0, {}, -1
        for k in range(bisect_left(rare, (left,)), len(rare)):
            x, ys = rare[k]
            if x >= right:
                break
            before, ends = ends if last == x - 1 else {}, {}
            for y in ys:
                if low <= y < high:
                    n = ends[y] = before.get(y - 1, 0) + 1
                    if n > size:
                        i, j, size = x - n + 1, y - n + 1, n
            last = x
        before = common_end(a[left:i], b[low:j])
        return i - before, j - before, before + size + common_start(a[i + size : right], b[j + size : high]), False

    return block


def gestalt(a: str, b: str, least: float = 0.0) -> float:
    """SequenceMatcher(None, a, b).ratio(); one under least may come out higher, but under least."""
    return gestalt_both(a, b, least)[0]


def gestalt_both(a: str, b: str, least: float = 0.0) -> tuple[float, bool]:
    """gestalt(), and whether it is that of b and a too for certain: where no block had to be chosen among equals."""
    if not a or not b:
        return float(a == b), True
    total, shared, room, parts, same = len(a) + len(b), 0, min(len(a), len(b)), [(0, len(a), 0, len(b))], max(len(a), len(b)) < 200
    if len(b) >= 200:  # from here on the matcher leaves letters out
        block = rare_block(a, b)
    else:
        if least and 4 * (common_start(a, b) + common_end(a, b)) < len(a):
            # Likely unlike: no blocks have more letters than the longest common subsequence.
            bound = 2.0 * subsequence(a, b) / total
            if bound < least:
                return bound, False

        def block(left: int, right: int, low: int, high: int) -> tuple[int, int, int, bool]:
            i, j, size, alone = longest_block(a[left:right], b[low:high])
            return left + i, low + j, size, alone

    while parts:
        left, right, low, high = parts.pop()
        if a[left:right] == b[low:high]:
            shared += right - left
            continue
        i, j, size, alone = block(left, right, low, high)
        shared += size
        same = same and (alone or not size)
        # All that can still be shared: the shorter side of every part.
        before, after = min(i - left, j - low), min(right - i, high - j) - size
        room -= min(right - left, high - low) - (before + size + after if size else 0)
        if 2.0 * room / total < least:
            return 2.0 * room / total, False
        if size:
            parts += [p for p in ((left, i, low, j), (i + size, right, j + size, high)) if p[0] < p[1] and p[2] < p[3]]
    return 2.0 * shared / total, same


def window_bounds(hay: str, own: str, step: int):
    """For the window of own's length at every step, what its ratio is at most: the share of letters that both have."""
    import numpy as np

    try:
        points = np.frombuffer(hay.encode("latin-1"), np.uint8)
    except UnicodeEncodeError:
        points = np.frombuffer(hay.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = len(hay) - len(own) + 1
    shared, upto = np.zeros(len(range(0, ends, step)), np.int32), np.zeros(len(hay) + 1, np.int32)
    for letter, n in Counter(own).items():
        if letter in hay:
            np.cumsum(points == ord(letter), out=upto[1:])
            inside = upto[len(own) :: step] - upto[:ends:step]
            shared += np.minimum(inside, n, out=inside)
    return 2.0 * shared / (2 * len(own))


def fuzzy_ratio(haystack: str, needle: str) -> float:
    """1 for a substring in any case, else the ratio of the first window (of the needle's length) of EARLY or more, else the best one.

    Ratios are made from the highest bound down, until no bound is above the best.
    """
    hay, own = haystack.lower(), needle.lower()
    if own in hay:
        return 1.0
    if len(own) > len(hay):
        return 0.0
    step = max(1, len(own) // 4)
    bounds = window_bounds(hay, own, step)
    rated = lambda k: gestalt(own, hay[k * step : k * step + len(own)])
    best = 0.0
    for k in (bounds >= EARLY).nonzero()[0].tolist():
        best = max(best, rated(k))
        if best >= EARLY:
            return round(best, 3)
    bounds[bounds >= EARLY] = 0.0
    likely = int(bounds.argmax())
    if bounds[likely] > best:
        best = max(best, rated(likely))
        bounds[likely] = 0.0
    rest = (bounds > best).nonzero()[0]
    for k in rest[(-bounds[rest]).argsort(kind="stable")].tolist():
        if bounds[k] <= best:
            break
        best = max(best, rated(k))
    return round(best, 3)


def gestalt_ratio(reference: str, extracted: str) -> float:
    return round(SequenceMatcher(None, reference, extracted).ratio(), 4)


def fuzzy_ratios(text: str, wanted: list[str]) -> list[float]:
    return [0.0 if x is None else fuzzy_ratio(text, x) for x in wanted]


def rising_share(places: list[int]) -> float | None:
    """Share of pairs in rising order, by insertion into a sorted list; null under two."""
    if len(places) < 2:
        return None
    seen: list[int] = []
    rising = 0
    for p in places:
        rising += bisect_left(seen, p)
        insort(seen, p)
    return rising / (len(places) * (len(places) - 1) / 2)


def move_labelled_footnotes(text: str, notes: list[str], markdown: bool = True) -> str:
    """Labelled footnotes that occur in the text at its end; longest first, equal lengths in order."""
    moved = []
    for note in sorted(dict.fromkeys(n.strip() for n in notes if n and n.strip()), key=len, reverse=True):
        forms = sorted({note, note.replace("_", r"\_"), note.replace(r"\_", "_")}, key=lambda f: (-len(f), f))
        if any(f in text for f in forms):
            moved.append(note)
            for f in forms:
                text = text.replace(f, "")
    if len(notes):
        text = re.sub(r"\n{3,}", "\n\n", text).strip()
    return "\n\n".join([text, "# Footnotes" if markdown else "Footnotes", *moved]) if moved else text


# Functions travel inside the tasks, so workers need not import this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
