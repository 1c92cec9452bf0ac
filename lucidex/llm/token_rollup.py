"""Token totals kept by signed deltas, by source, language and tokenizer version.

A change feed says what happened to documents: insert, delete, or revise with
a new text.  Each change becomes signed numbers (documents, tokens, bytes):
an insert adds the new counts, a delete takes the old ones away, a revision
adds the difference.  A batch is summed by source, language and tokenizer
version and committed under its id; totals are the sum over all batches, so
they are additive and never recount old documents.

Commits are idempotent: a batch has one folder, named by a digest of its id,
which one atomic rename of a finished draft puts in place.  Committing an id
again does nothing, of two writers the first wins, and a commit that was cut
short leaves a draft that doesn't count.

compact() folds what counts into one base table with the list of batches that
it covers, which still aren't accepted again.  Bases are numbered, each takes
the place of the one before, and readers take the highest: of two compactors
that started from one base only the first can put the next number in place,
so nothing is ever counted twice.  vacuum() removes what a base covers.  On a
store whose rename of a folder isn't atomic, writers of one rollup must take
turns.

Tokens are counted with a public byte-level BPE vocabulary, whose file is a
parameter and goes to the executors as a broadcast of MAX_VOCABULARY bytes at
most.

Defined cases: null or empty text has no tokens and no bytes but is a
document; null source or language is a group of its own; repeated changes add
up as often as they occur in a batch; an empty batch commits and changes
nothing; groups whose totals come to zero documents and tokens are left out;
extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, by_value, materialize, text_bytes

#: The vocabulary's name is the tokenizer version in the totals.
TOKENIZER = "byte_bpe_50k"
MAX_VOCABULARY = 32 << 20

GROUP = ("source", "lang", "tokenizer")
SUMS = ("n_docs", "n_tokens", "n_bytes")


def vocabulary(name: str = TOKENIZER, path: str | None = None) -> tuple[bytes, str]:
    """Contents and splitting pattern of a tiktoken vocabulary file, default from the public tokenizers."""
    import public_tokenizers as public

    with open(path or public.path(f"{name}.tiktoken"), "rb") as f:
        data = f.read(MAX_VOCABULARY + 1)
    if len(data) > MAX_VOCABULARY:
        raise ValueError(f"the vocabulary {name} has more than {MAX_VOCABULARY} bytes")
    return data, public.PATTERN


def counter(data: bytes, pattern: str):
    """A function from UTF-8 bytes to a number of tokens."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def count(text: bytes | None) -> int:
        return len(encoding.encode_ordinary(text.decode("utf-8", "replace"))) if text else 0

    return count


def with_tokens(df: DataFrame, columns: dict[str, str], name: str = TOKENIZER, path: str | None = None) -> DataFrame:
    """df with a token count for each text column, {text column: count column}; equal texts of a row are encoded once."""
    batches(df.sparkSession)
    broadcast = df.sparkSession.sparkContext.broadcast(vocabulary(name, path))
    kept = [f for f in df.schema.fields if f.name not in columns.values()]

    def run(parts):
        import pyarrow as pa

        count = counter(*broadcast.value)
        for part in parts:
            texts = {c: text_bytes(part.column(c)) for c in columns}
            counts: dict[str, list[int]] = {c: [] for c in columns}
            for own in zip(*texts.values(), strict=True):
                known: dict[bytes | None, int] = {}
                for c, t in zip(columns, own, strict=True):
                    if t not in known:
                        known[t] = count(t)
                    counts[c].append(known[t])
            out = {n: part.column(n) for n in part.schema.names} | {columns[c]: pa.array(x, pa.int64()) for c, x in counts.items()}
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return df.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, T.StructType([*kept, *[T.StructField(c, T.LongType()) for c in columns.values()]]))


def signed_deltas(changes: DataFrame) -> DataFrame:
    """Rows of signed sums for each change: the old counts taken from the old group, the new ones added to the new group.

    changes: source, lang, tokenizer, op (insert, delete, revise), and the
    counts old_tokens, old_bytes, new_tokens, new_bytes, of which an insert
    has no old and a delete no new ones.  Columns old_source, old_lang and
    old_tokenizer, where given, name the group that a revised document leaves.
    Another op is an error.
    """
    none = F.raise_error(F.concat(F.lit("no such change: "), F.coalesce("op", F.lit("null"))))
    op = F.when(F.col("op").isin("insert", "delete", "revise"), F.col("op")).otherwise(none)
    known = changes.select("*", op.alias("checked_op"))

    def side(sign: int, prefix: str) -> Column:
        group = [F.col(f"old_{c}" if sign < 0 and f"old_{c}" in changes.columns else c).cast("string").alias(c) for c in GROUP]
        return F.struct(*group, F.lit(sign).cast("long").alias("n_docs"), *[(sign * F.coalesce(f"{prefix}_{c}", F.lit(0))).cast("long").alias(f"n_{c}") for c in ("tokens", "bytes")])

    own = {f"old_{c}": F.when(F.col("checked_op") == "revise", F.col(f"old_{c}")).otherwise(F.col(c)) for c in GROUP if f"old_{c}" in changes.columns}
    rows = F.when(F.col("checked_op") == "insert", F.array(side(1, "new"))).when(F.col("checked_op") == "delete", F.array(side(-1, "old"))).otherwise(F.array(side(-1, "old"), side(1, "new")))
    return known.withColumns(own).select(F.explode(rows).alias("x")).select("x.*") if own else known.select(F.explode(rows).alias("x")).select("x.*")


def summed(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy(*GROUP).agg(*[F.sum(c).alias(c) for c in SUMS])


class Rollup:
    """Committed batches of signed sums below a folder that driver and executors share."""

    SCHEMA = T.StructType([*[T.StructField(c, T.StringType()) for c in GROUP], *[T.StructField(c, T.LongType()) for c in SUMS]])

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _folder(self, batch_id: str) -> str:
        return f"{self.path}/batch-{hashlib.sha256(batch_id.encode()).hexdigest()[:32]}"

    def _there(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def _names(self) -> list[str]:
        fs, p = self._fs(self.path)
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def _move(self, draft: str, place: str) -> bool:
        """One atomic rename; False where something is in the place already."""
        sc = self.spark.sparkContext
        options = sc._gateway.new_array(sc._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        fs, old = self._fs(draft)
        new = sc._jvm.org.apache.hadoop.fs.Path(place)
        try:
            sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), fs.getConf()).rename(old, new, options)
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception) and not self._there(place):
                raise
            fs.delete(old, True)
            return False
        return True

    @staticmethod
    def _base(generation: int) -> str:
        return f"base-{generation:010d}"

    def _covers(self, generation: int) -> DataFrame:
        """(folder): names of the batches that a base holds."""
        reader = self.spark.read.schema("folder string")
        return reader.parquet(f"{self.path}/{self._base(generation)}/covers") if generation else self.spark.createDataFrame([], "folder string")

    def listed(self) -> tuple[int, list[str]]:
        """(number of the highest base or 0, names of the folders that count)."""
        names = self._names()
        generation = max((int(n[5:]) for n in names if n.startswith("base-")), default=0)
        own = [n for n in names if n.startswith("batch-") and self._there(f"{self.path}/{n}/_SUCCESS")]
        if generation and own:
            known = self.spark.createDataFrame([(n,) for n in own], "folder string")
            gone = {r["folder"] for r in known.join(self._covers(generation), "folder", "left_semi").collect()}
            own = [n for n in own if n not in gone]
        return generation, [self._base(generation)] * bool(generation) + own

    def committed(self, batch_id: str) -> bool:
        folder = self._folder(batch_id)
        if self._there(f"{folder}/_SUCCESS"):
            return True
        generation, _ = self.listed()
        return bool(self._covers(generation).where(F.col("folder") == folder.rpartition("/")[2]).take(1))

    def commit(self, batch_id: str, deltas: DataFrame) -> bool:
        """Add a batch once; False if its id was committed before."""
        if self.committed(batch_id):
            return False
        draft = f"{self.path}/.draft-{uuid.uuid4().hex}"
        summed(deltas).write.parquet(draft)
        if self._there(self._folder(batch_id)) and not self.committed(batch_id):
            fs, rest = self._fs(self._folder(batch_id))
            fs.delete(rest, True)  # a folder without a marker is no batch
        # Of two writers of one id the first to rename wins.
        return self._move(draft, self._folder(batch_id))

    def _rows(self, names: list[str]) -> DataFrame:
        paths = [f"{self.path}/{n}" + "/data" * n.startswith("base-") for n in names]
        return self.spark.read.schema(self.SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], self.SCHEMA)

    def totals(self) -> DataFrame:
        """Sums over all batches, without groups that have come to nothing."""
        return summed(self._rows(self.listed()[1])).where("n_docs <> 0 or n_tokens <> 0 or n_bytes <> 0")

    def compact(self, listed: tuple[int, list[str]] | None = None) -> bool:
        """Fold what counts (as it was listed) into the next base; False where there is nothing to fold or another made that base first."""
        generation, names = listed or self.listed()
        if len(names) < 2:
            return False
        draft = f"{self.path}/.draft-{uuid.uuid4().hex}"
        summed(self._rows(names)).write.parquet(f"{draft}/data")
        new = self.spark.createDataFrame([(n,) for n in names if n.startswith("batch-")], "folder string")
        new.union(self._covers(generation)).write.parquet(f"{draft}/covers")
        return self._move(draft, f"{self.path}/{self._base(generation + 1)}")

    def vacuum(self) -> None:
        """Remove bases that another took the place of, and batches that the highest base covers."""
        generation, names = self.listed()
        for name in self._names():
            if name not in names and (name.startswith("base-") or name.startswith("batch-") and self._there(f"{self.path}/{name}/_SUCCESS")):
                fs, p = self._fs(f"{self.path}/{name}")
                fs.delete(p, True)


def clean(text: Column) -> Column:
    """Text with white space runs as one space, trimmed: what a revision stores."""
    return F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))


def replay(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", tokenizer: str = TOKENIZER, vocabulary_path: str | None = None) -> DataFrame:
    """Totals of a corpus whose life is replayed through the rollup below path.

    First all documents are inserted; then those that change when white space
    is normalised are revised, and those that are left empty are deleted.
    Both batches are committed twice, as after a restart; the second time
    changes nothing.
    """
    rows = docs.select(F.col(source).cast("string").alias("source"), F.col(lang).cast("string").alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("old"))
    rows = with_tokens(rows.withColumn("new", clean(F.col("old"))), {"old": "old_tokens", "new": "new_tokens"}, tokenizer, vocabulary_path)
    counted = materialize(
        rows.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), "old_tokens", "new_tokens", F.octet_length("old").cast("long").alias("old_bytes"), F.octet_length("new").cast("long").alias("new_bytes"), (F.col("old") != F.col("new")).alias("changed")),
        "token-counts",
    )
    inserts = counted.select(*GROUP, F.lit("insert").alias("op"), F.lit(0).alias("old_tokens"), F.lit(0).alias("old_bytes"), F.col("old_tokens").alias("new_tokens"), F.col("old_bytes").alias("new_bytes"))
    edits = counted.withColumn("op", F.when(F.col("new_bytes") == 0, "delete").when(F.col("changed"), "revise")).where("op is not null")
    rollup = Rollup(docs.sparkSession, path)
    for _ in range(2):
        rollup.commit("inserts", signed_deltas(inserts))
        rollup.commit("white-space", signed_deltas(edits))
    return rollup.totals()


by_value(__name__)
