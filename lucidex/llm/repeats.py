"""Removal of repeated passages through longest-previous-factor arrays.

A position's longest previous factor (LPF) is the length of the longest string
there that also starts earlier.  In suffix order it is found at the previous
or next suffix with a smaller position.  Each byte covered by a string of
LENGTH bytes whose LPF is at least LENGTH goes; the first occurrence stays.
Documents are ordered by id; matches never cross documents.

One suffix array over a large corpus fits in no task, so suffixes are first
brought together by content:

1. Anchors.  Every LENGTH-byte window picks the smallest hash among its GRAM-
   byte strings, its anchor, so equal windows pick equal anchors at equal
   offsets.  Neighbouring windows share an anchor and make one context: about
   one row for 36 bytes.
2. Contexts are grouped by anchor.  One that is wholly equal to an earlier
   context has LPF >= LENGTH in all its windows.  An anchor that occurs once
   is done.  Only anchors with different contexts need their windows.
3. For those, the bytes of the contexts are brought together by anchor, and
   blocks of whole anchor groups get a suffix array (prefix doubling up to
   LENGTH bytes), the common prefixes of neighbours in it, and from the previous
   and next smaller positions the LPF array, cut at LENGTH.
4. An anchor with more than CROWD different contexts is too large for a block:
   its contexts get LPF arrays where they are, and each block's first
   occurrence of a window goes on under 128 bits of XXH3 of the window; the
   first of all stays.
5. Per document the removed windows merge to spans.

Equal contexts and windows inside one batch are settled before the shuffle, so
a passage in a third of all documents sends one row for each batch.  Between
batches contexts are equal if their anchors' hashes and 64 bits of XXH3 of all
their bytes are.

Defined cases: null text is empty; texts under LENGTH bytes lose nothing; rows
that repeat an id and a text are one document and get equal results; of rows
with equal ids and other texts, one comes first by a hash of the row; a null
id comes last; empty tables give no rows; extra columns are ignored by spans()
and kept by remove().
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, by_value, fresh, materialize, repeated_ids, text_bytes

LENGTH = 100
GRAM = 32

#: Different contexts of an anchor that are held together in one block.
CROWD = 4096

#: Bytes hashed at a time; positions in a block take POSITION_BITS bits.
POSITION_BITS = 20
BLOCK = 1 << POSITION_BITS

_ODD = 0x9E3779B97F4A7C15
_NO_ID = (1 << 63) - 1


def _splitmix(n: int) -> list[int]:
    out, x = [], 0
    for _ in range(n):
        x = (x + _ODD) & (2**64 - 1)
        z = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & (2**64 - 1)
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & (2**64 - 1)
        out.append(z ^ (z >> 31))
    return out


class Hasher:
    """Polynomial hashes modulo 2**64 of all substrings of a block."""

    def __init__(self):
        import numpy as np

        base = _splitmix(1)[0] | 1
        self.value = np.array(_splitmix(257)[1:], np.uint64)
        self.up = np.concatenate([np.ones(1, np.uint64), np.full(BLOCK, base, np.uint64)]).cumprod(dtype=np.uint64)
        self.down = np.concatenate([np.ones(1, np.uint64), np.full(BLOCK, pow(base, -1, 1 << 64), np.uint64)]).cumprod(dtype=np.uint64)

    def sums(self, data):
        import numpy as np

        return np.concatenate([np.zeros(1, np.uint64), (self.value[data] * self.up[: len(data)]).cumsum(dtype=np.uint64)])

    def of(self, sums, start, end):
        return (sums[end] - sums[start]) * self.down[start]


def mixed(h):
    import numpy as np

    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def contexts(hasher: Hasher, data, ends):
    """(anchor hash, context hash, first window, last window) of a block.

    data: bytes of whole documents or pieces, one after the other; ends: where
    each ends.  Windows that cross an end are left out.
    """
    import numpy as np
    from xxhash import xxh3_64_intdigest as xxh3

    n = len(data) - LENGTH + 1
    if n <= 0:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
    sums = hasher.sums(data)
    h = mixed((sums[GRAM:] - sums[:-GRAM]) * hasher.down[: len(data) - GRAM + 1])
    low = h >> np.uint64(POSITION_BITS) << np.uint64(POSITION_BITS) | np.arange(len(h), dtype=np.uint64)
    width, reach = LENGTH - GRAM + 1, 1
    while 2 * reach <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    low = np.minimum(low[:n], low[width - reach : width - reach + n])
    anchor = (low & np.uint64(BLOCK - 1)).astype(np.int64)
    inside = np.ones(n, bool)
    for end in ends:
        inside[max(0, end - LENGTH + 1) : end] = False
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = (anchor[1:] != anchor[:-1]) | ~inside[:-1]
    start = np.flatnonzero(new & inside)
    stop = np.r_[np.flatnonzero(new[1:] | ~inside[1:]), n - 1]
    last = stop[np.searchsorted(stop, start)]
    whole = data.tobytes()
    ctx = np.fromiter((xxh3(whole[a:b]) for a, b in zip(start.tolist(), (last + LENGTH).tolist(), strict=True)), np.uint64, len(start))
    return h[anchor[start]], ctx, start, last


def pieces(texts: list[bytes]):
    """Blocks of (data, [(text number, offset in the text, start, end)]): whole texts, long ones in overlapping pieces."""
    import numpy as np

    def block(own):
        out, at, made = [], 0, []
        for i, off, part in own:
            made.append((i, off, at, at + len(part)))
            out.append(part)
            at += len(part)
        return np.frombuffer(b"".join(out), np.uint8), made

    own, size, step = [], 0, BLOCK - LENGTH
    for i, t in enumerate(texts):
        for off in range(0, max(1, len(t) - LENGTH + 1), step):
            part = t[off : off + step + LENGTH - 1] if len(t) > step else t
            if own and size + len(part) > BLOCK:
                yield block(own)
                own, size = [], 0
            own.append((i, off, part))
            size += len(part)
            if len(t) <= step:
                break
    if own:
        yield block(own)


def suffix_ranks(data, length: int = LENGTH):
    """{reach: ranks} of data's substrings of 1, 2, 4, ... and length bytes in their order; equal ranks are equal strings.

    Prefix doubling: a rank of twice the reach comes from two neighbouring
    ranks; the last step takes two overlapping halves that add up to length.
    """
    import numpy as np

    rank, reach = data.astype(np.uint64), 1
    ranks = {1: rank}
    while reach < length and len(rank) > (step := min(reach, length - reach)):
        if reach < 8 and step == reach:
            # Up to eight bytes the bytes themselves are the rank.
            rank = (rank[:-step] << np.uint64(8 * step)) | rank[step:]
        else:
            rank = np.unique(rank, return_inverse=True)[1].astype(np.uint64) if reach <= 8 else rank
            rank = np.unique(rank[:-step] * np.uint64(len(data) + 1) + rank[step:], return_inverse=True)[1].astype(np.uint64)
        reach += step
        ranks[reach] = rank
    return ranks


def common_prefix(ranks, a, b, length: int = LENGTH):
    """Length of the common prefixes of suffixes a and b, cut at length; both have that many bytes."""
    import numpy as np

    whole = ranks[length][a] == ranks[length][b]
    found = np.where(whole, length, 0)
    open_ = np.flatnonzero(~whole)
    x, y, at = a[open_], b[open_], np.zeros(len(open_), np.int64)
    for reach in sorted((r for r in ranks if r & (r - 1) == 0), reverse=True):
        own, i, j = ranks[reach], x + at, y + at
        inside = (i < len(own)) & (j < len(own))
        equal = np.zeros(len(at), bool)
        equal[inside] = own[i[inside]] == own[j[inside]]
        at += reach * equal
    found[open_] = at
    return found


def nearest_smaller(position, lcp):
    """Common prefix with the nearest suffix before, in suffix order, that has a smaller position; 0 where there is none.

    lcp[i]: common prefix of suffixes i - 1 and i.  A suffix with a greater
    position is passed over to where its own search has come, all at once.
    """
    import numpy as np

    n = len(position)
    at, low = np.arange(-1, n - 1), lcp.copy()
    going = np.flatnonzero(at >= 0)
    while len(going := going[position[at[going]] > position[going]]):
        via = at[going]
        low[going] = np.minimum(low[going], low[via])
        at[going] = at[via]
        # Nothing shares a prefix any longer, or nothing is left before.
        stop = (at[going] < 0) | (low[going] == 0)
        low[going[at[going] < 0]] = 0
        going = going[~stop]
    return low


def longest_previous_factors(data, starts, length: int = LENGTH):
    """LPF, cut at length, of each window start; starts ascend in order of precedence and have length bytes.

    The longest string at a position that also starts earlier is shared with
    the nearest suffix of a smaller position before or after it in suffix order.
    """
    import numpy as np

    if not len(starts):
        return np.zeros(0, np.int64)
    ranks = suffix_ranks(data, length)
    order = np.argsort(ranks[length][starts], kind="stable")
    lcp = np.zeros(len(order), np.int64)
    lcp[1:] = common_prefix(ranks, starts[order[:-1]], starts[order[1:]], length)
    back = np.r_[0, lcp[1:][::-1]] if len(lcp) > 1 else np.zeros(len(lcp), np.int64)
    before, after = nearest_smaller(order, lcp), nearest_smaller(order[::-1], back)[::-1]
    out = np.zeros(len(order), np.int64)
    out[order] = np.maximum(before, after)
    return out


def _signed(x):
    import numpy as np

    return x.astype(np.uint64).view(np.int64)


def _runs(numbers, lows, highs):
    """Merge adjacent or overlapping [low, high] of the same number; input in order."""
    import numpy as np

    if not len(numbers):
        return numbers, lows, highs
    top = np.maximum.accumulate(highs + numbers * (1 << 40))
    new = np.r_[True, lows[1:] + numbers[1:] * (1 << 40) > top[:-1] + 1]
    at = np.flatnonzero(new)
    return numbers[at], lows[at], top[np.r_[at[1:] - 1, len(numbers) - 1]] - numbers[at] * (1 << 40)


_ANCHORS = T.StructType([T.StructField("done", T.BooleanType()), T.StructField("anchor", T.LongType()), T.StructField("context", T.LongType()), T.StructField("doc", T.LongType()), T.StructField("row", T.LongType()), T.StructField("lo", T.IntegerType()), T.StructField("hi", T.IntegerType())])


def _batch(columns: dict, schema: T.StructType):
    import pyarrow as pa

    kinds = {"long": pa.int64(), "integer": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], kinds[f.dataType.typeName()]) for f in schema.fields], names=schema.names)


def _anchors(parts):
    """Contexts that are first in their batch; the repeated ones as done spans."""
    import numpy as np

    hasher = Hasher()
    for part in parts:
        doc, row = (part.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "row"))
        by = np.lexsort((row, doc))
        texts = text_bytes(part.column("text"))
        found = [[] for _ in range(5)]
        for data, made in pieces([texts[i] for i in by]):
            a, c, lo, hi = contexts(hasher, data, [end for *_, end in made])
            piece = np.searchsorted(np.array([end for *_, end in made]), lo, side="right")
            shift = np.array([off - start for _, off, start, _ in made])[piece]
            for own, x in zip(found, (a, c, np.array([i for i, *_ in made])[piece], lo + shift, hi + shift), strict=True):
                own.append(x)
        if not found[0]:
            continue
        a, c, i, lo, hi = map(np.concatenate, found)
        order = np.lexsort((c, a))
        again = np.r_[False, (a[order][1:] == a[order][:-1]) & (c[order][1:] == c[order][:-1])] if len(order) else np.zeros(0, bool)
        # Rows that repeat an id and a text are one document: only another place is an earlier one.
        first = np.maximum.accumulate(np.where(again, 0, np.arange(len(order))))
        f = order[first]
        same = (doc[by][i[order]] == doc[by][i[f]]) & (row[by][i[order]] == row[by][i[f]]) & (lo[order] == lo[f])
        repeat = np.zeros(len(order), bool)
        repeat[order] = again & ~same
        n, l, h = _runs(i[repeat], lo[repeat], hi[repeat])
        yield _batch({"done": np.r_[np.zeros((~repeat).sum(), bool), np.ones(len(n), bool)], "anchor": np.r_[_signed(a[~repeat]), doc[by][n]], "context": np.r_[_signed(c[~repeat]), l], "doc": doc[by][np.r_[i[~repeat], n]], "row": row[by][np.r_[i[~repeat], n]], "lo": np.r_[lo[~repeat], l], "hi": np.r_[hi[~repeat], h]}, _ANCHORS)


_CONTEXT, _WINDOW, _DONE = 0, 1, 2
_OPEN = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("doc", T.LongType()), T.StructField("row", T.LongType()), T.StructField("lo", T.IntegerType()), T.StructField("hi", T.IntegerType()), T.StructField("data", T.BinaryType())])
_GONE = T.StructType([f for f in _OPEN.fields if f.name in ("doc", "row", "lo", "hi")])


def _open_contexts(parts):
    """Bytes of contexts by anchor; of crowded anchors the first windows of each block, and repeated ones as done."""
    import numpy as np
    from xxhash import xxh3_128_digest as xxh3_128

    for part in parts:
        doc, row = (part.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "row"))
        by = np.lexsort((row, doc))
        texts = text_bytes(part.column("text"))
        spans = part.column("spans").to_pylist()
        out: dict[str, list] = {c: [] for c in _OPEN.names}
        crowded, last = [], None
        for i in by:
            if last == (doc[i], row[i]):
                continue  # the same document once more
            last = (doc[i], row[i])
            taken = -1
            for s in sorted(spans[i], key=lambda s: s["lo"]):
                if s["lo"] == taken:
                    continue  # a repeated row's
                taken = s["lo"]
                data = texts[i][s["lo"] : s["hi"] + LENGTH]
                if s["crowd"]:
                    crowded.append((i, s["lo"], data))
                else:
                    for c, x in zip(_OPEN.names, (_CONTEXT, s["anchor"], doc[i], row[i], s["lo"], s["hi"], data), strict=True):
                        out[c].append(x)
        yield _batch(out, _OPEN)
        for data, made in pieces([t for *_, t in crowded]):
            starts, number, lo, repeat = _decided(data, made, [at for _, at, _ in crowded])
            own = np.array([i for i, *_ in crowded])
            first, whole = starts[~repeat], data.tobytes()
            digests = [xxh3_128(whole[x : x + LENGTH]) for x in first.tolist()]
            n, l, h = _runs(number[repeat], lo[repeat], lo[repeat])
            at = np.r_[own[number[~repeat]], own[n]].astype(np.int64)
            kinds = np.r_[np.full(len(first), _WINDOW), np.full(len(n), _DONE)]
            yield _batch({"kind": kinds, "key": np.r_[np.array([int.from_bytes(x[:8], "little", signed=True) for x in digests], np.int64), np.zeros(len(n), np.int64)], "doc": doc[at], "row": row[at], "lo": np.r_[lo[~repeat], l], "hi": np.r_[lo[~repeat], h], "data": [*digests, *[None] * len(n)]}, _OPEN)


def _decided(data, made, at):
    """Window starts of a block of cut contexts, the context and the place of each, and whether it has an earlier equal."""
    import numpy as np

    starts = np.concatenate([np.arange(start, end - LENGTH + 1) for _, _, start, end in made])
    piece = np.repeat(np.arange(len(made)), [end - start - LENGTH + 1 for _, _, start, end in made])
    number = np.array([j for j, *_ in made])[piece]
    lo = starts + np.array([at[j] + off - start for j, off, start, _ in made])[piece]
    return starts, number, lo, longest_previous_factors(data, starts) >= LENGTH


def _grouped(parts):
    """Removed windows of contexts that come sorted by (key, doc, row, lo); a block holds whole groups."""
    import numpy as np

    def decide(rows):
        ends = np.cumsum([len(r[4]) for r in rows]).tolist()
        made = [(j, 0, end - len(r[4]), end) for j, (r, end) in enumerate(zip(rows, ends, strict=True))]
        _, number, lo, repeat = _decided(np.frombuffer(b"".join(r[4] for r in rows), np.uint8), made, [r[3] for r in rows])
        n, l, h = _runs(number[repeat], lo[repeat], lo[repeat])
        return _batch({"doc": [rows[j][1] for j in n], "row": [rows[j][2] for j in n], "lo": l, "hi": h}, _GONE)

    held, size = [], 0  # whole groups, and the group that still comes in
    start = 0  # where that group starts in held
    for part in parts:
        columns = [part.column(c).to_pylist() for c in ("key", "doc", "row", "lo", "data")]
        for r in zip(*columns, strict=True):
            if held and r[0] != held[-1][0]:
                if size >= BLOCK // 2:
                    yield decide(held)
                    held, size = [], 0
                start = len(held)
            elif held and r[:4] == held[-1][:4]:
                continue  # the same document once more
            held.append(r)
            size += len(r[4])
            if size > BLOCK - 256 and start:
                yield decide(held[:start])
                held, start = held[start:], 0
                size = sum(len(x[4]) for x in held)
    if held:
        yield decide(held)


def _id(key: Column) -> Column:
    return F.coalesce(key.cast("long"), F.lit(_NO_ID))


def _row_hash(key: Column, text: Column, repeated: bool) -> Column:
    """0 where ids are unique, so that it costs nothing in a shuffle."""
    return F.xxhash64(key.cast("long"), F.coalesce(text, F.lit(""))) if repeated else F.lit(0).cast("long")


def _rows(docs: DataFrame, key: str, text: str, repeated: bool) -> DataFrame:
    """(doc, row, text): the id to order by, a hash of id and text if ids repeat, and the text."""
    return docs.select(_id(F.col(f"`{key}`")).alias("doc"), _row_hash(F.col(f"`{key}`"), F.col(f"`{text}`"), repeated).alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))


def spans(docs: DataFrame, key: str, text: str, repeated: bool) -> DataFrame:
    """(doc, row, spans): the removed windows of each document that has some, as merged [lo, hi] of window starts."""
    batches(docs.sparkSession)
    rows = _rows(docs, key, text, repeated)
    places = ["doc", "row", "lo"]
    found = rows.where(F.octet_length("text") >= LENGTH).mapInArrow(_anchors, _ANCHORS).repartition("done", "anchor")
    nth = F.dense_rank().over(Window.partitionBy("done", "anchor", "context").orderBy(*places))
    group = Window.partitionBy("done", "anchor")
    judged = found.withColumn("nth", nth).withColumn("differ", F.min("context").over(group) != F.max("context").over(group)).withColumn("crowd", F.count(F.when(F.col("nth") == 1, 1)).over(group) > CROWD)
    # A context equal to an earlier one is done; the first of each goes on if its anchor has other contexts too.
    judged = materialize(judged.select((F.col("done") | (F.col("nth") > 1)).alias("done"), "differ", "crowd", "anchor", "doc", "row", "lo", "hi").where("done or differ"), "contexts")
    open_spans = judged.where("not done").groupBy("doc", "row").agg(F.collect_list(F.struct("lo", "hi", "anchor", "crowd")).alias("spans"))
    opened = materialize(rows.join(open_spans.hint("shuffle_hash"), ["doc", "row"]).mapInArrow(_open_contexts, _OPEN), "open-contexts")
    grouped = opened.where(F.col("kind") == _CONTEXT).select("key", *places, "data").repartition("key").sortWithinPartitions("key", *places).mapInArrow(_grouped, _GONE)
    later = F.dense_rank().over(Window.partitionBy("key", "data").orderBy(*places))
    crowded = opened.where(F.col("kind") == _WINDOW).select("key", "data", *places, "hi").withColumn("nth", later).where("nth > 1").select(*places, "hi")
    windows = grouped.union(crowded).union(opened.where(F.col("kind") == _DONE).select(*places, "hi"))
    gone = judged.where("done").select("doc", "row", "lo", "hi").union(windows.select("doc", "row", "lo", "hi"))
    order = Window.partitionBy("doc", "row").orderBy("lo", "hi")
    island = F.sum(F.when(F.col("lo") <= F.col("before") + 1, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    merged = gone.withColumn("before", F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn("island", island)
    merged = merged.groupBy("doc", "row", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return materialize(merged.groupBy("doc", "row").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("spans")), "repeats")


def removed_bytes(found: list[dict] | None) -> list[tuple[int, int]]:
    """Byte runs [start, end) covered by windows; touching runs are one."""
    out: list[list[int]] = []
    for s in found or ():
        a, b = s["lo"], s["hi"] + LENGTH
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def kept(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for a, b in runs:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def _with_spans(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, str]:
    """docs with a column of spans, and its name; the spans are the side that is held in memory."""
    repeated = repeated_ids(docs, key)
    d, r, doc, row, own = fresh(docs, "own_doc", "own_row", "span_doc", "span_row", "spans")
    found = spans(docs, key, text, repeated).select(F.col("doc").alias(doc), F.col("row").alias(row), F.col("spans").alias(own))
    placed = docs.withColumns({d: _id(F.col(f"`{key}`")), r: _row_hash(F.col(f"`{key}`"), F.col(f"`{text}`"), repeated)})
    return placed.join(found.hint("shuffle_hash"), (F.col(d) == F.col(doc)) & (F.col(r) == F.col(row)), "left").drop(d, r, doc, row), own


def digest_table(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Bytes, removed bytes, removed runs and the digest of what is left, per document row."""
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    schema = T.StructType([T.StructField("key", rows.schema["key"].dataType), *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")], T.StructField("kept_sha256", T.StringType())])

    def run(parts):
        import pyarrow as pa

        for part in parts:
            out = []
            for t, s in zip(text_bytes(part.column("text")), part.column(own).to_pylist(), strict=True):
                runs = removed_bytes(s)
                out.append((len(t or b""), sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept(t or b"", runs)).hexdigest()))
            numbers = [pa.array([x[j] for x in out], pa.int64()) for j in range(3)]
            yield pa.RecordBatch.from_arrays([part.column("key"), *numbers, pa.array([x[3] for x in out], pa.string())], names=schema.names)

    joined, own = _with_spans(rows, "key", "text")
    return joined.mapInArrow(run, schema).withColumnRenamed("key", key)


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with later copies of LENGTH-byte passages cut out; characters cut in part go whole."""
    joined, own = _with_spans(docs, key, text)

    def run(parts):
        import pyarrow as pa

        for part in parts:
            out = []
            for t, s in zip(text_bytes(part.column(text)), part.column(own).to_pylist(), strict=True):
                out.append(None if t is None else kept(t, removed_bytes(s)).decode("utf-8", "ignore"))
            at = part.schema.get_field_index(text)
            yield part.set_column(at, part.schema.field(at), pa.array(out, part.schema.field(at).type))

    return joined.mapInArrow(run, joined.schema).select(*[F.col(f"`{c}`") for c in docs.columns])


by_value(__name__)
