"""Language identification by prediction by partial matching (PPM).

Each language has byte contexts of order 0 to ORDER with their symbol counts
(a context tree kept as sorted tables).  A symbol unseen in a context costs
the escape of method C, distinct / (total + distinct), and is coded in the
next shorter context, down to a uniform 1/256.  After training the counts are
frozen: a text's code length in a language is the exact sum over all its
bytes, and the shortest wins (ties: the smaller language name).

Training takes a sample of labelled rows, spread over all languages: different
(id, text) rows in the order of a hash, at most SAMPLE_DOCS a language and, by
a running sum, at most SAMPLE_BYTES of them or the language's share of
TOTAL_BYTES if that is less; of a text at most TEXT_CHARS characters are
learned.  Rows are picked by narrow columns before any text moves, and their
(ORDER + 1)-grams are counted on Spark, so only counts come to the driver.
Prediction covers every byte.

Each language's counts are sparse tables.  Code lengths of the most frequent
grams are tabulated for all languages, TABLE_ENTRIES numbers at most; other
grams are coded by the same rule when they occur.

Defined cases: null text and text without a letter is `und` with score 0, as
is everything when there is no training row; null languages aren't learned;
repeated rows count as often as they occur; empty tables give no rows; extra
columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, by_value, share, shared, text_bytes

ORDER = 3
SAMPLE_DOCS = 600
SAMPLE_BYTES = 2 << 20
TOTAL_BYTES = 16 << 20
TEXT_CHARS = 1 << 16

#: Parts in which a language's rows are first picked, and rows of each: a third more than three times the even share of SAMPLE_DOCS.
SALTS = 64
SALT_DOCS = 40

#: Numbers in the table of code lengths (four bytes each).
TABLE_ENTRIES = 8 << 20

#: Bytes scored at a time.
BLOCK = 4 << 20

UNDETERMINED = "und"
_PAD = b"\n" * ORDER
_ASCII_LETTER = re.compile(rb"[A-Za-z]")
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or (not text.isascii() and bool(_LETTER.search(text.decode("utf-8", "replace"))))


def grams(data, n: int):
    """The n-gram that ends at each byte from the n-th on, big-endian in a uint32."""
    import numpy as np

    out = np.zeros(len(data) - n + 1, np.uint32)
    for j in range(n):
        out = (out << np.uint32(8)) | data[j : len(data) - n + 1 + j]
    return out

def gram_counts(texts: list[bytes]):
    """Different (ORDER + 1)-grams that end at a byte of the texts, in ascending order, and their counts."""
    import numpy as np

    data = np.frombuffer(b"".join(_PAD + t for t in texts), np.uint8)
    inside = np.concatenate([np.r_[np.zeros(ORDER, bool), np.ones(len(t), bool)] for t in texts])
    return np.unique(grams(data, ORDER + 1)[inside[ORDER:]], return_counts=True)


class Tree:
    """Frozen context statistics of one language."""

    def __init__(self, grams, n):
        """grams: different (ORDER + 1)-grams in ascending order; n: their counts."""
        import numpy as np

        self.levels = []
        for k in range(ORDER, -1, -1):
            keys, back = np.unique(grams & np.uint32((1 << 8 * (k + 1)) - 1), return_inverse=True)
            counts = np.bincount(back, n, len(keys))
            contexts, first, distinct = np.unique(keys >> np.uint32(8), return_index=True, return_counts=True)
            self.levels.insert(0, (keys, counts, contexts, np.add.reduceat(counts, first), distinct.astype(np.float64)))

    @classmethod
    def of(cls, texts: list[bytes]) -> Tree:
        return cls(*gram_counts(texts))

    def cost(self, g):
        """Bits of the last byte of each (ORDER + 1)-gram after the bytes before it."""
        import numpy as np

        bits = np.zeros(len(g))
        open_at = np.arange(len(g))
        for k in range(ORDER, -1, -1):
            keys, counts, contexts, totals, distinct = self.levels[k]
            own = g[open_at] & np.uint32((1 << 8 * (k + 1)) - 1)
            c = np.minimum(np.searchsorted(contexts, own >> np.uint32(8)), len(contexts) - 1)
            there = contexts[c] == own >> np.uint32(8)
            i = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            seen = keys[i] == own
            whole = totals[c] + distinct[c]
            bits[open_at] += np.where(seen, -np.log2(counts[i] / whole), np.where(there, -np.log2(distinct[c] / whole), 0.0))
            open_at = open_at[~seen]
        bits[open_at] += 8.0
        return bits


class Model:
    """All languages' trees and the table of code lengths of every gram seen in training."""

    def __init__(self, counts: dict[str, tuple]):
        """counts: grams and their counts by language."""
        import numpy as np

        self.languages = sorted(k for k, (g, _) in counts.items() if len(g))
        self.trees = [Tree(*counts[k]) for k in self.languages]
        if not self.trees:
            return
        keys, back = np.unique(np.concatenate([counts[k][0] for k in self.languages]), return_inverse=True)
        total = np.bincount(back, np.concatenate([counts[k][1] for k in self.languages]))
        room = max(1, TABLE_ENTRIES // len(self.trees))
        if len(keys) > room:
            keys = np.sort(keys[np.argsort(-total, kind="stable")[:room]])
        self.shift = np.uint32(32 - max(12, min(22, int(np.log2(len(keys))) + 4)))
        slots = self._slot(keys)
        self.slot_key = np.zeros(1 << (32 - int(self.shift)), np.uint32)
        self.slot_row = np.full(len(self.slot_key), -1, np.int32)
        self.slot_key[slots] = keys
        self.slot_row[slots] = np.arange(len(keys))
        self.costs = np.stack([t.cost(keys) for t in self.trees], 1).astype(np.float32)

    @classmethod
    def of(cls, texts: dict[str, list[bytes]]) -> Model:
        return cls({k: gram_counts(v) for k, v in texts.items() if v})

    def _slot(self, g):
        import numpy as np

        return (g * np.uint32(2654435761)) >> self.shift

    def costs_of(self, g):
        """Code lengths (grams x languages)."""
        import numpy as np

        slot = self._slot(g)
        row = np.where(self.slot_key[slot] == g, self.slot_row[slot], -1)
        out = self.costs[row]
        miss = np.flatnonzero(row < 0)
        if len(miss):
            rest, back = np.unique(g[miss], return_inverse=True)
            out[miss] = np.stack([t.cost(rest) for t in self.trees], 1).astype(np.float32)[back]
        return out

    def code_lengths(self, text: bytes):
        """Bits of the whole text in each language."""
        import numpy as np

        total = np.zeros(len(self.trees))
        for at in range(0, len(text), BLOCK):
            head = _PAD if at == 0 else text[at - ORDER : at]
            total += self.costs_of(grams(np.frombuffer(head + text[at : at + BLOCK], np.uint8), ORDER + 1)).sum(0, dtype=np.float64)
        return total

    def many(self, texts: list[bytes]):
        """code_lengths of many texts, put together in blocks."""
        import numpy as np

        out, block, size = [], [], 0
        for t in [*texts, None]:
            if block and (t is None or size + len(t) > BLOCK):
                data = np.frombuffer(b"".join(_PAD + x for x in block), np.uint8)
                costs = self.costs_of(grams(data, ORDER + 1))
                ends = np.cumsum([len(x) + ORDER for x in block]) - ORDER
                for x, end in zip(block, ends, strict=True):
                    out.append(costs[end - len(x) : end].sum(0, dtype=np.float64))
                block, size = [], 0
            if t is not None and len(t) > BLOCK:
                out.append(self.code_lengths(t))
            elif t is not None:
                block.append(t)
                size += len(t)
        return out

    def predict(self, texts: list[bytes | None]) -> list[tuple[str, float]]:
        import numpy as np

        scored = [i for i, t in enumerate(texts) if t and self.trees and has_letter(t)]
        out = [(UNDETERMINED, 0.0)] * len(texts)
        for i, bits in zip(scored, self.many([texts[i] for i in scored]), strict=True):
            best = int(np.argmin(bits))
            out[i] = (self.languages[best], float(1 / np.exp2(np.maximum(bits[best] - bits, -1000.0)).sum()))
        return out


def remainder(key: Column) -> Column:
    return F.pmod(F.coalesce(F.crc32(key.cast("string").cast("binary")), F.lit(0)), F.lit(4))


def sample(labelled: DataFrame, key: str, text: str, language: str) -> DataFrame:
    """(lang, text): the bounded training texts."""
    rows = labelled.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), F.col(f"`{language}`").cast("string").alias("lang")).where("text is not null and lang is not null")
    mark = F.xxhash64("key", F.lit(0), "text")
    part = F.least(F.octet_length("text"), F.lit(4 * TEXT_CHARS)).cast("long")
    picked = rows.select("lang", mark.alias("mark"), part.alias("bytes")).groupBy("lang", "mark").agg(F.min("bytes").alias("bytes"))
    languages = picked.select("lang").distinct().count()
    room = min(SAMPLE_BYTES, TOTAL_BYTES // max(1, languages))
    picked = picked.withColumn("salt", F.pmod(F.xxhash64("mark", F.lit("salt")), F.lit(SALTS)))
    for by, most in ((["lang", "salt"], SALT_DOCS), (["lang"], SAMPLE_DOCS)):
        order = Window.partitionBy(*by).orderBy(F.xxhash64("mark"), "mark")
        picked = picked.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most)
        before = F.coalesce(F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        picked = picked.withColumn("before", before).where(F.col("before") < room)
    # Different texts of one mark are as good as impossible; of repeated rows one is learned.
    found = rows.withColumn("mark", mark).join(picked.select("lang", "mark"), ["lang", "mark"]).groupBy("lang", "mark").agg(F.first(F.substring("text", 1, TEXT_CHARS)).alias("text"))
    return found.select("lang", "text")


def counted(texts: DataFrame) -> dict[str, tuple]:
    """Grams and counts by language of a bounded sample."""
    import numpy as np

    def run(parts):
        import pyarrow as pa

        for part in parts:
            by: dict[str, list[bytes]] = {}
            for own, t in zip(part.column("lang").to_pylist(), text_bytes(part.column("text")), strict=True):
                if t:
                    by.setdefault(own, []).append(t)
            for own, found in by.items():
                g, n = gram_counts(found)
                yield pa.RecordBatch.from_arrays([pa.array([own] * len(g), pa.string()), pa.array(g.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    # At most TOTAL_BYTES different rows.
    table = texts.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    lang, gram, n = np.array(table.column("lang").to_pylist(), object), table.column("gram").to_numpy(), table.column("n").to_numpy()
    out = {}
    for own in sorted(set(lang.tolist())):
        at = np.flatnonzero(lang == own)
        at = at[np.argsort(gram[at])]
        out[own] = (gram[at].astype(np.uint32), n[at].astype(np.float64))
    return out


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred and score; narrow."""
    spark = docs.sparkSession
    batches(spark)
    own = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    kept = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score")]
    broadcast = share(spark, model)  # tables of at most TOTAL_BYTES grams, and TABLE_ENTRIES numbers

    def run(parts):
        import pyarrow as pa

        m = shared(broadcast)
        for part in parts:
            found = m.predict(text_bytes(part.column(text)))
            columns = {n: part.column(n) for n in part.schema.names}
            columns |= {"lang_pred": pa.array([x for x, _ in found], pa.string()), "score": pa.array([x for _, x in found], pa.float64())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return docs.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, T.StructType([*kept, *own]))


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", language: str = "lang") -> Model:
    batches(labelled.sparkSession)
    return Model(counted(sample(labelled, key, text, language)))


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", language: str = "lang") -> DataFrame:
    """Learn from rows whose id isn't held out and predict every row."""
    model = fit(docs.where(remainder(F.col(f"`{key}`")) != 2), key, text, language)
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    return predict(rows, model, "text").select(F.col("key").alias(key), (remainder(F.col("key")) == 2).alias("held_out"), "lang_pred", "score")


by_value(__name__)
