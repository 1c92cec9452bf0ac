"""Benchmark decontamination by a broadcast hash set of test n-grams.

Texts are lower-cased in A-Z; a word is a run of digits, letters a-z and
non-ASCII characters.  A window is WINDOW consecutive words of an item (the
whole item if it has fewer, but not none).  Windows are found through a
rolling hash of word numbers and verified word by word; every document word
inside an occurrence is hit.

The n-grams go to the executors as a broadcast only in blocks of a checked
size (BLOCK_BYTES of item text): a larger benchmark is scanned in several
blocks over the same documents, whose results are merged, so it stays exact.

Defined cases: null text has no words; an item with null text or no word has
no window; an item with a null id makes hits but isn't counted among the
items; equal ids count once; repeated document rows give a row each; empty
tables give no hits or no rows; extra columns are ignored by flag_table() and
kept by remove().
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, by_value, fresh, materialize, share, shared, text_bytes

WINDOW = 10

#: Bytes of benchmark text in one broadcast block; its windows take about ten times as much memory.
BLOCK_BYTES = 8 << 20

#: Columns that scan() adds.
NAMES = ("_n_words", "_spans", "_items")

_WORD = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
#: Lower-cases A-Z and turns every byte that is in no word into a space.
TO_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _WORD else 0x20 for b in range(256))
_BASE = 0x9E3779B97F4A7C15


class GramSet:
    """Windows of one block of items in arrays: by length their hashes in order, their word numbers, and their items."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW):
        import numpy as np

        self.ids: dict[bytes, int] = {}
        self.names = [i for i, _ in items]
        by: dict[int, list] = {}
        for place, (_, text) in enumerate(items):
            words = text.translate(TO_WORDS).split()
            if words:
                n = min(window, len(words))
                numbers = np.array([self.ids.setdefault(w, len(self.ids)) for w in words], dtype=np.int32)
                rows = np.lib.stride_tricks.sliding_window_view(numbers, n)
                by.setdefault(n, []).append((rows, np.full(len(rows), place, np.int32)))
        self.levels = {}
        for n, parts in by.items():
            rows = np.ascontiguousarray(np.concatenate([r for r, _ in parts]))
            owners = np.concatenate([o for _, o in parts])
            _, first, which = np.unique(rows.view(f"V{4 * n}").ravel(), return_index=True, return_inverse=True)
            hashes = _rolled(rows[first])
            order = np.argsort(hashes, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            both = np.unique(place[which] * len(items) + owners)
            starts = np.searchsorted(both // len(items), np.arange(len(order) + 1))
            self.levels[n] = (hashes[order], rows[first][order], starts, (both % len(items)).astype(np.int32))

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged spans [start, end) of hit words, and the ids of items with an occurring window."""
        import numpy as np

        get = self.ids.get
        numbers = np.array([get(w, -1) for w in words], dtype=np.int32)
        known = np.flatnonzero(numbers >= 0)
        spans, found = [], set()
        if not len(known):
            return spans, found
        breaks = np.flatnonzero(np.diff(known) > 1)
        runs = list(zip(known[np.r_[0, breaks + 1]], known[np.r_[breaks, len(known) - 1]] + 1, strict=True))
        for n, (hashes, grams, starts, owners) in self.levels.items():
            for start, end in runs:
                if end - start < n:
                    continue
                rows = np.lib.stride_tricks.sliding_window_view(numbers[start:end], n)
                own = _rolled(rows)
                at = np.searchsorted(hashes, own)
                for i in np.flatnonzero(hashes[np.minimum(at, len(hashes) - 1)] == own):
                    k = at[i]
                    while k < len(hashes) and hashes[k] == own[i]:
                        if (grams[k] == rows[i]).all():
                            found.update(self.names[o] for o in owners[starts[k] : starts[k + 1]] if self.names[o] is not None)
                            spans.append((int(start + i), int(start + i + n)))
                        k += 1
        return merged(spans), found


def _rolled(rows):
    import numpy as np

    out = np.zeros(len(rows), dtype=np.uint64)
    for j in range(rows.shape[1]):
        out = out * np.uint64(_BASE) + rows[:, j].astype(np.uint64) + np.uint64(1)
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def item_blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> list[DataFrame]:
    """The items in as many hash blocks as keep a block near block_bytes."""
    rows = benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    return [rows] if n == 1 else [rows.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k) for k in range(n)]


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, names: tuple[str, str, str] = NAMES) -> DataFrame:
    """docs with number of words, hit word spans and ids of occurring items in columns of the given names; no shuffle."""
    spark = docs.sparkSession
    batches(spark)
    own = T.StructType([T.StructField(names[0], T.LongType()), T.StructField(names[1], T.ArrayType(T.ArrayType(T.IntegerType()))), T.StructField(names[2], T.ArrayType(T.StringType()))])
    kept = [f for f in docs.schema.fields if f.name not in own.names]
    df = docs.select(*[F.col(f"`{f.name}`") for f in kept])
    blocks = item_blocks(benchmark, item_id, item_text, block_bytes)
    for k, block in enumerate(blocks):
        items = [(r["id"], r["text"].encode()) for r in block.collect()]  # at most about block_bytes
        df = df.mapInArrow(_scanner(share(spark, GramSet(items, window)), text, bool(k), names), T.StructType([*kept, *own.fields]))
        if k + 1 < len(blocks):
            df = materialize(df, "decontaminate")
    return df


def _scanner(broadcast, text: str, again: bool, names: tuple[str, str, str]):
    def run(parts):
        import pyarrow as pa

        grams = shared(broadcast)
        for part in parts:
            n_words, spans, items = [], [], []
            before = part.select(list(names[1:])).to_pylist() if again else None
            for i, raw in enumerate(text_bytes(part.column(text))):
                words = (raw or b"").translate(TO_WORDS).split()
                own, ids = grams.scan(words)
                if before:
                    own = merged([*own, *map(tuple, before[i][names[1]])])
                    ids = ids | set(before[i][names[2]])
                n_words.append(len(words))
                spans.append([list(x) for x in own])
                items.append(sorted(ids))
            columns = [(n, c) for n, c in zip(part.schema.names, part.columns, strict=True) if n not in names]
            columns += list(zip(names, (pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int32()))), pa.array(items, pa.list_(pa.string()))), strict=True))
            yield pa.RecordBatch.from_arrays([c for _, c in columns], names=[n for n, _ in columns])

    return run


def flag_table(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per document row: words, hit words, items found, their digest, contaminated or not."""
    found = scan(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")), benchmark, **options)
    hit = F.aggregate("_spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return found.select(
        F.col("key").alias(key), F.col("_n_words").alias("n_words"), hit.alias("n_hit"), F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"), (F.size("_spans") > 0).alias("contaminated"),
    )


def remove(docs: DataFrame, benchmark: DataFrame, text: str = "text", what: str = "documents", **options) -> DataFrame:
    """docs without contaminated documents, or with the hit word spans cut out of their texts.

    what: "documents" drops each document with a hit; "spans" keeps every row
    and cuts from the first to the last byte of each hit span.
    """
    if what not in ("documents", "spans"):
        raise ValueError(f"what: {what}")
    names = tuple(fresh(docs, *NAMES))
    found = scan(docs, benchmark, text=text, names=names, **options)
    if what == "documents":
        return found.where(F.size(names[1]) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
    return found.mapInArrow(_cutter(text, names[1]), found.schema).select(*[F.col(f"`{c}`") for c in docs.columns])


def _cutter(text: str, own: str):
    def run(parts):
        import re

        import pyarrow as pa

        for part in parts:
            out = []
            for raw, spans in zip(text_bytes(part.column(text)), part.column(own).to_pylist(), strict=True):
                if raw and spans:
                    at = [m.span() for m in re.finditer(rb"\S+", raw.translate(TO_WORDS))]
                    for a, b in reversed(spans):
                        raw = raw[: at[a][0]] + raw[at[b - 1][1] :]
                out.append(None if raw is None else raw.decode())
            k = part.schema.get_field_index(text)
            yield part.set_column(k, part.schema.field(k), pa.array(out, part.schema.field(k).type))

    return run


by_value(__name__)
