"""Fill-in-middle transformation on ropes.

A text is cut into units, its lines with their line feed.  Two hash draws of
the document's id name two unit ranks; what stands before the smaller is the
prefix, between them the middle, after them the suffix.  The output puts a
sentinel before each part, as prefix-suffix-middle or suffix-prefix-middle, or
leaves the text plain.

The text is held as a rope: a height-balanced tree whose leaves are slices of
the text and whose nodes cache how many units end in them and how many code
points they have.  The tree is split at the two unit ranks, the subtrees are
concatenated in the new order with sentinel leaves between, and restore()
finds the sentinels in the output's own rope, splits it at their code-point
ranks and concatenates prefix, middle and suffix again.  Every split or
concatenation touches a path of the tree, whatever the text's length.

Each row is transformed alone: there is no shuffle, draws depend on the id and
the seed only, and a task that is run again gives the same rows.

Defined cases: null text counts as empty, and an empty text is plain with 0
units; a text that contains a sentinel is plain, so an output always has one
way back; a null id is drawn for as an empty string; repeated rows get equal
outputs; a line of any length is cut into several leaves and ends in one;
empty tables give no rows; extra columns are kept, and names of added columns
that are taken get underscores.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_value, fresh

# Sentinels of prefix, suffix and middle; the seed and the shares (in a hundred) of transformed texts and of these as spm.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, FIM_RATE, SPM_RATE = 7, 100, 50

#: Code points in a leaf.
LEAF = 2048
#: Code points of text that a worker holds as ropes at once, besides one text.
BLOCK = 4 << 20

NAMES = ("n_units", "form", "prefix_chars", "middle_chars", "output")
#: Order of the parts (0 prefix, 1 middle, 2 suffix) in each form.
ORDERS = {"psm": (0, 2, 1), "spm": (2, 0, 1)}
SENTINELS = (PREFIX, MIDDLE, SUFFIX)


class Rope:
    """A leaf with its text or a node with two subtrees; units counts the units that end inside."""

    __slots__ = ("text", "left", "right", "units", "chars", "height")

    def __init__(self, text: str = "", units: int = 0, left: Rope | None = None, right: Rope | None = None):
        self.text, self.left, self.right = text, left, right
        if left is None:
            self.units, self.chars, self.height = units, len(text), 0
        else:
            self.units, self.chars, self.height = left.units + right.units, left.chars + right.chars, 1 + max(left.height, right.height)

    def leaves(self) -> Iterator[str]:
        todo = [self]
        while todo:
            node = todo.pop()
            if node.left is None:
                yield node.text
            else:
                todo += (node.right, node.left)

    def __str__(self) -> str:
        return "".join(self.leaves())


def rope(text: str) -> Rope | None:
    """A balanced rope; a unit ends at its line feed or at the end of the text."""
    parts = []
    for at in range(0, len(text), LEAF):
        piece = text[at : at + LEAF]
        parts.append(Rope(piece, piece.count("\n") + (at + LEAF >= len(text) and piece[-1] != "\n")))

    def over(start: int, end: int) -> Rope:
        mid = (start + end) // 2
        return parts[start] if end - start == 1 else Rope(left=over(start, mid), right=over(mid, end))

    return over(0, len(parts)) if parts else None


def node(left: Rope, right: Rope) -> Rope:
    """Both subtrees under one node, rotated where one is two levels higher."""
    if left.height > right.height + 1:
        if left.left.height >= left.right.height:
            return Rope(left=left.left, right=Rope(left=left.right, right=right))
        mid = left.right
        return Rope(left=Rope(left=left.left, right=mid.left), right=Rope(left=mid.right, right=right))
    if right.height > left.height + 1:
        if right.right.height >= right.left.height:
            return Rope(left=Rope(left=left, right=right.left), right=right.right)
        mid = right.left
        return Rope(left=Rope(left=left, right=mid.left), right=Rope(left=mid.right, right=right.right))
    return Rope(left=left, right=right)


def concat(*parts: Rope | None) -> Rope | None:
    """The parts one after the other; costs the difference of their heights."""
    out = None
    for part in parts:
        out = part if out is None else out if part is None else _joined(out, part)
    return out


def _joined(a: Rope, b: Rope) -> Rope:
    if a.height > b.height + 1:
        return node(a.left, _joined(a.right, b))
    if b.height > a.height + 1:
        return node(_joined(a, b.left), b.right)
    return Rope(left=a, right=b)


def split_units(tree: Rope | None, rank: int) -> tuple[Rope | None, Rope | None]:
    """What ends with unit number rank (counted from 1), and the rest."""
    if tree is None or rank == 0:
        return None, tree
    if tree.left is None:
        at = -1
        for _ in range(rank):
            at = tree.text.find("\n", at + 1)
            if at < 0:  # the last unit has no line feed
                return tree, None
        return _cut(tree, at + 1, rank)
    # Text behind the left side's last unit belongs to a unit that ends on the right.
    if rank <= tree.left.units:
        a, b = split_units(tree.left, rank)
        return a, concat(b, tree.right)
    a, b = split_units(tree.right, rank - tree.left.units)
    return concat(tree.left, a), b


def split_chars(tree: Rope | None, rank: int) -> tuple[Rope | None, Rope | None]:
    """The first rank code points, and the rest."""
    if tree is None or rank <= 0:
        return None, tree
    if rank >= tree.chars:
        return tree, None
    if tree.left is None:
        return _cut(tree, rank, tree.text.count("\n", 0, rank))
    if rank <= tree.left.chars:
        a, b = split_chars(tree.left, rank)
        return a, concat(b, tree.right)
    a, b = split_chars(tree.right, rank - tree.left.chars)
    return concat(tree.left, a), b


def _cut(leaf: Rope, at: int, units: int) -> tuple[Rope | None, Rope | None]:
    if at >= leaf.chars:
        return leaf, None
    return Rope(leaf.text[:at], units), Rope(leaf.text[at:], leaf.units - units)


def find(tree: Rope, token: str) -> int:
    """Code-point rank of the token's first occurrence, also across leaves; -1 without one."""
    seen, tail = 0, ""
    for piece in tree.leaves():
        at = (tail + piece).find(token)
        if at >= 0:
            return seen - len(tail) + at
        seen += len(piece)
        tail = (tail + piece)[-(len(token) - 1) :]
    return -1


def arrange(text: str | None, draws: tuple[int, int, int, int], fim_rate: int = FIM_RATE, spm_rate: int = SPM_RATE) -> tuple:
    """(units, form, code points of the prefix, of the middle, output) of one text."""
    text = text or ""
    tree = rope(text)
    n = tree.units if tree else 0
    if not text or re.search("<[PSM]>", text) or draws[2] % 100 >= fim_rate:
        return n, "plain", None, None, text
    form = "spm" if draws[3] % 100 < spm_rate else "psm"
    first, second = sorted(d % (n + 1) for d in draws[:2])
    head, suffix = split_units(tree, second)
    prefix, middle = split_units(head, first)
    parts = (prefix, middle, suffix)
    output = concat(*[x for i in ORDERS[form] for x in (Rope(SENTINELS[i]), parts[i])])
    return n, form, prefix.chars if prefix else 0, middle.chars if middle else 0, str(output)


def rebuild(output: str | None, form: str) -> str | None:
    """The exact text behind an output of the given form."""
    if form == "plain" or output is None:
        return output
    rest, parts = rope(output), {}
    for i in reversed(ORDERS[form]):
        at = find(rest, SENTINELS[i])
        rest, part = split_chars(rest, at)
        parts[i] = split_chars(part, len(SENTINELS[i]))[1]
    return str(concat(parts[0], parts[1], parts[2]) or "")


def pieces(batch, column: str) -> Iterator:
    """Row ranges of an Arrow batch with about BLOCK code points of text, a row at least."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.utf8_length(batch[column]), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > BLOCK:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(size)
    if start < len(sizes):
        yield batch.slice(start)


def draws(key: Column, seed: int = SEED) -> Column:
    """Four unsigned 32-bit draws of an id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)])


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, fim_rate: int = FIM_RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """docs with n_units, form, prefix_chars, middle_chars and output."""
    added = fresh(docs, *NAMES)
    (drawn,) = fresh(docs, "_draws")
    kinds = ("long", "string", "long", "long", "string")
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, T._parse_datatype_string(k)) for n, k in zip(added, kinds, strict=True)]])

    def run(batches_: Iterator) -> Iterator:
        import pyarrow as pa

        arrow = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        for whole in batches_:
            for batch in pieces(whole, text):
                rows = [arrange(t, d, fim_rate, spm_rate) for t, d in zip(batch[text].to_pylist(), batch[drawn].to_pylist(), strict=True)]
                own = [c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != drawn]
                new = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), arrow, strict=True)]
                yield pa.RecordBatch.from_arrays([*own, *new], names=[n for n in batch.schema.names if n != drawn] + added)

    return docs.withColumn(drawn, draws(F.col(f"`{key}`"), seed)).mapInArrow(run, schema)


def restore(rows: DataFrame, output: str = "output", form: str = "form", out: str = "restored") -> DataFrame:
    """rows with the exact texts behind their outputs in a new column."""
    (name,) = fresh(rows, out)
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.StringType())])

    def run(batches_: Iterator) -> Iterator:
        import pyarrow as pa

        for whole in batches_:
            for batch in pieces(whole, output):
                texts = [rebuild(o, f) for o, f in zip(batch[output].to_pylist(), batch[form].to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, name])

    return rows.mapInArrow(run, schema)


def digest_table(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Form, sizes and digests per row; the texts go back through restore()."""
    own = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    back = restore(transform(own).drop("text"))
    return back.select("doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


by_value(__name__)
