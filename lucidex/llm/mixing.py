"""Mixing sources to target weights by soft membership.

A multinomial logistic regression, trained on the labelled table, gives each
document a posterior over domains.  Nonnegative document rates r are then
fitted so that the expected domain token totals sum(r_i * tokens_i * p_i) come
as close as possible, in least squares, to the targets.  Residuals are
measured in the metric of the domains' Gram matrix over the documents whose
rate isn't held at zero, so a step of size one meets the targets but for the
rates that it makes zero.  Each gradient step needs one distributed sum per
domain and pair of domains; the projection sets negative rates to zero.

Starting from rates of one, a step changes a document's rate by the same
combination of its posteriors whatever its length, so documents with equal
posteriors (rounded to POSTERIOR_STEP) share their rate: the steps run on the
token totals of these cells, of which there are at most
(1 / POSTERIOR_STEP) ** (domains - 1), however large the corpus.

Domains: "toxic" (toxic = 1), else "clean" (quality = 1) or "low" (quality =
0).  The classifier learns from at most SAMPLE_DOCS different labelled rows per
domain, of those whose documents are there, in the order of a hash of the row
(of a text at most TEXT_CHARS characters).  It knows words by HASH_BITS bits of
their CRC-32, and descends to a gradient of TOLERANCE.

mix() gives each row the whole part of its rate in copies, and one more with
the probability of the rest, drawn from a hash of the row; so the expected
totals are those of the rates.

Defined cases: null text has no tokens and the posterior of an empty text; a
label row without a usable quality and toxic value isn't learned; of several
labels of one document each is learned; without labels all posteriors are
equal; without tokens all rates are one; repeated rows share a rate; empty
tables give no rows; extra columns are ignored by rates() and kept by mix().
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterable
from zlib import crc32

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, by_value, fresh, materialize, share, shared, text_bytes

DOMAINS = ("clean", "low", "toxic")

#: Token totals wanted, as multiples of each domain's expected total in the input.
TARGET_WEIGHTS = {"clean": 1.1, "low": 0.5, "toxic": 0.0}

SAMPLE_DOCS = 2000
TEXT_CHARS = 1 << 16

#: Parts in which a domain's rows are first picked, and rows of each: twice the even share of SAMPLE_DOCS.
SALTS = 64
SALT_DOCS = 64
HASH_BITS = 18
TOLERANCE = 1e-5
L2 = 1e-6
POSTERIOR_STEP = 0.001

#: The gradient on rates ends when the totals are off by CLOSE of all tokens, or PATIENCE steps in a row brought them no nearer (targets that no rates
#: reach); the steps up to the nearest count.  The given tables take 1 to 15 steps; STEPS is a guard, and what is missed is reported either way.
CLOSE = 1e-5
PATIENCE = 12
STEPS = 60
CELL_FILES = 4
#: Share of all tokens from which mix() warns that targets were missed.
MISSED = 0.01

#: Shape features beside the words: shares of distinct words and of words with a symbol, in tenths.
_SYMBOLS = frozenset(b"#*$%&|<>")


def features(text: bytes | None) -> tuple[int, list[int]]:
    """Number of tokens (white-space words), and the numbers of present features in ascending order."""
    words = (text or b"").lower().split()
    present = set(words)
    if words:
        marked = sum(1 for w in present if w[-1] in _SYMBOLS)
        present |= {b"\x00distinct%d" % (10 * len(present) // len(words)), b"\x00marked%d" % (10 * marked // len(present)), b"\x00length%d" % len(words).bit_length()}
    return len(words), sorted({crc32(w) & ((1 << HASH_BITS) - 1) for w in present})


class Classifier:
    """Multinomial logistic regression over the presence of features."""

    def __init__(self, rows: Iterable[tuple[int, Iterable[int]]], domains: tuple[str, ...] = DOMAINS):
        """rows: domain number and features of each labelled document."""
        import numpy as np

        self.domains = domains
        k, size = len(domains), 1 << HASH_BITS
        self.bias, self.weights, self.gradient = np.zeros(k), np.zeros((size, k)), 0.0
        rows = list(rows)
        n = len(rows)
        if not n:
            return
        seen = np.eye(k)[[y for y, _ in rows]]
        r = np.repeat(np.arange(n), [len(x) for _, x in rows])
        c = np.concatenate([np.asarray(x, np.int64) for _, x in rows])
        used, c = np.unique(c, return_inverse=True)
        # A feature counts as far as it goes with a domain: the root of its chi-square against the domains' shares.
        counts = np.stack([np.bincount(c, seen[r, j], len(used)) for j in range(k)], 1)
        m = counts.sum(1, keepdims=True)
        wanted = m * seen.sum(0) / n
        scale = np.sqrt(np.where(wanted > 0, (counts - wanted) ** 2 / np.maximum(wanted * (1 - m / (n + 1)), 1e-12), 0).sum(1) / n)

        def loss(x):
            """Mean loss with the L2 term, and its gradient, at weights (features then bias) x."""
            z = np.tile(x[-1], (n, 1))
            for j in range(k):
                z[:, j] += np.bincount(r, (scale * x[:-1, j])[c], n)
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            e = (p - seen) / n
            g = np.empty_like(x)
            for j in range(k):
                g[:-1, j] = scale * np.bincount(c, e[r, j], len(used)) + L2 * x[:-1, j]
            g[-1] = e.sum(0)
            return -np.log(np.maximum((p * seen).sum(1), 1e-300)).mean() + L2 / 2 * (x[:-1] ** 2).sum(), g

        x = np.zeros((len(used) + 1, k))
        x[-1] = np.log((seen.sum(0) + 1) / (n + k))
        x, self.gradient = descend(loss, x, TOLERANCE)
        self.weights[used], self.bias = scale[:, None] * x[:-1], x[-1]

    def load(self, used: bytes, weights: bytes, bias: bytes, gradient: float) -> None:
        """Take over what was learned elsewhere: numbers of features, their rows of weights, the bias and the last gradient."""
        import numpy as np

        self.weights[np.frombuffer(used, np.int64)] = np.frombuffer(weights).reshape(-1, len(self.domains))
        self.bias, self.gradient = np.frombuffer(bias), gradient

    def posterior(self, present: list[int]) -> list[float]:
        import numpy as np

        z = self.bias + self.weights[present].sum(0)
        p = np.exp(z - z.max())
        return (p / p.sum()).tolist()


def descend(loss, x, tolerance: float, most: int = 500, memory: int = 10):
    """Limited-memory quasi-Newton descent until no part of the gradient exceeds tolerance; the point and its gradient."""
    import numpy as np

    value, g = loss(x)
    steps: list[tuple] = []
    for _ in range(most):
        if np.abs(g).max() <= tolerance:
            break
        d, parts = g.copy(), []
        for s, y, rho in reversed(steps):
            parts.append(a := rho * (s * d).sum())
            d -= a * y
        if steps:
            s, y, rho = steps[-1]
            d /= rho * (y * y).sum()
        for (s, y, rho), a in zip(steps, reversed(parts), strict=True):
            d += (a - rho * (y * d).sum()) * s
        slope, size = (g * d).sum(), 1.0 if steps else 1.0 / max(1.0, np.abs(g).sum())
        while (new := loss(x - size * d))[0] > value - 1e-4 * size * slope and size > 1e-10:
            size /= 2
        if size <= 1e-10:
            break
        s, y = -size * d, new[1] - g
        if (sy := (s * y).sum()) > 1e-14:
            steps = [*steps[1 - memory :], (s, y, 1 / sy)]
        x, (value, g) = x + s, new
    return x, float(np.abs(g).max())


def domain(quality: Column, toxic: Column) -> Column:
    """Number of a label row's domain, or null."""
    return F.when(toxic == 1, 2).when((toxic == 0) & (quality == 1), 0).when((toxic == 0) & (quality == 0), 1)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> Classifier:
    """The classifier, from a bounded sample of labelled rows."""
    batches(docs.sparkSession)
    own = labels.select(F.col(f"`{key}`").alias("key"), domain(F.col("quality"), F.col("toxic")).alias("y")).where("y is not null and key is not null").distinct()
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).where("text is not null")
    mark = F.xxhash64("key", F.lit(0), "text")
    # First in SALTS parts of a domain, then among the parts' picks, so no task gets a whole domain.
    picked = rows.select("key", mark.alias("mark")).join(own, "key").select("y", "mark").distinct().withColumn("salt", F.pmod(F.xxhash64("mark", F.lit("salt")), F.lit(SALTS)))
    for by, most in ((["y", "salt"], SALT_DOCS), (["y"], SAMPLE_DOCS)):
        picked = picked.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy(F.xxhash64("mark"), "mark"))).where(F.col("nth") <= most)
    # At most SAMPLE_DOCS rows a domain: the bound makes the broadcast safe.
    found = rows.withColumn("mark", mark).join(F.broadcast(picked.select("mark", "y")), "mark").select("y", "mark", F.substring("text", 1, TEXT_CHARS).alias("text"))

    def run(parts):
        import pyarrow as pa

        for part in parts:
            numbers = [features(t)[1] for t in text_bytes(part.column("text"))]
            yield pa.RecordBatch.from_arrays([part.column("y"), part.column("mark"), pa.array(numbers, pa.list_(pa.int32()))], names=["y", "mark", "present"])

    def fit(parts):
        import numpy as np
        import pyarrow as pa

        rows = [(mark, y, x.values.to_numpy()) for part in parts for mark, y, x in zip(part.column("mark").to_pylist(), part.column("y").to_pylist(), part.column("present"), strict=True)]
        model = Classifier((y, x) for _, y, x in sorted(rows, key=lambda r: r[:2]))
        used = np.flatnonzero(model.weights.any(1))
        values = [used.tobytes(), model.weights[used].tobytes(), model.bias.tobytes(), model.gradient]
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names=["used", "weights", "bias", "gradient"])

    # Repeated rows are one; at most SAMPLE_DOCS of a domain, of TEXT_CHARS characters each, meet in one task; the driver gets the weights only.
    out = found.mapInArrow(run, "y int, mark long, present array<int>").groupBy("mark", "y").agg(F.first("present").alias("present"))
    model = Classifier(())
    for r in out.repartition(1).mapInArrow(fit, "used binary, weights binary, bias binary, gradient double").collect():
        model.load(r["used"], r["weights"], r["bias"], r["gradient"])
    return model


def with_posteriors(docs: DataFrame, model: Classifier, text: str = "text", names: tuple[str, str] = ("_tokens", "_p")) -> DataFrame:
    """docs with its tokens and posteriors (on the grid of POSTERIOR_STEP, summing to one) in columns of the given names."""
    batches(docs.sparkSession)
    broadcast = share(docs.sparkSession, model)  # 2 ** HASH_BITS rows of weights
    own = [T.StructField(names[0], T.LongType()), T.StructField(names[1], T.ArrayType(T.DoubleType()))]
    kept = [f for f in docs.schema.fields if f.name not in names]

    def run(parts):
        import pyarrow as pa

        m = shared(broadcast)
        for part in parts:
            tokens, ps = [], []
            for t in text_bytes(part.column(text)):
                n, present = features(t)
                tokens.append(n)
                ps.append(on_grid(m.posterior(present)))
            columns = {n: part.column(n) for n in part.schema.names} | {names[0]: pa.array(tokens, pa.int64()), names[1]: pa.array(ps, pa.list_(pa.float64()))}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return docs.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, T.StructType([*kept, *own]))


def on_grid(p: list[float]) -> list[float]:
    """p in whole steps, by largest remainders, still summing to one."""
    steps = round(1 / POSTERIOR_STEP)
    whole = [math.floor(x * steps) for x in p]
    for j in sorted(range(len(p)), key=lambda j: (whole[j] - p[j] * steps, j))[: steps - sum(whole)]:
        whole[j] += 1
    return [x / steps for x in whole]


def fit_rates(scored: DataFrame, targets: dict[str, float], steps: int = STEPS) -> tuple[list[list[float]], dict]:
    """The gradient of each step; totals before, wanted and after, and how far off the furthest is, of all tokens.  scored has _tokens and _p."""
    import numpy as np

    k = len(DOMAINS)
    # The number of cells is bounded, so a few files hold them and each step's sum is one small job.
    cells = materialize(scored.groupBy("_p").agg(F.sum("_tokens").cast("double").alias("t")).repartition(CELL_FILES), "cells")
    p = [F.element_at("_p", j + 1) for j in range(k)]

    def sums(gradients: list[list[float]]) -> tuple:
        """Totals under the rates, and the Gram matrix of the cells whose rate isn't held at zero."""
        r = rate(F.col("_p"), gradients)
        free = F.when(r > 0, F.col("t")).otherwise(0.0)
        x = cells.agg(*[F.sum(free * p[i] * p[j]).alias(f"m{i}_{j}") for i in range(k) for j in range(k)], *[F.sum(F.col("t") * p[j] * r).alias(f"s{j}") for j in range(k)]).first()
        return np.array([x[f"s{j}"] or 0.0 for j in range(k)]), np.array([[x[f"m{i}_{j}"] or 0.0 for j in range(k)] for i in range(k)])

    totals, gram = sums([])
    wanted = totals * np.array([targets[d] for d in DOMAINS])
    every = max(1.0, totals.sum())
    gradients: list[list[float]] = []
    now, best, idle = totals, (np.abs(totals - wanted).max() / every, 0, totals), 0
    while totals.sum() and best[0] > CLOSE and idle < PATIENCE and len(gradients) < steps:
        # Cells at zero don't answer to a step, so the metric is that of the others.
        step = np.linalg.pinv(gram, rcond=1e-9, hermitian=True) @ (now - wanted)
        gradients.append([round(float(x), 12) for x in step])
        now, gram = sums(gradients)
        off = np.abs(now - wanted).max() / every
        idle = 0 if off < best[0] else idle + 1
        if not idle:
            best = (off, len(gradients), now)
    off, n, now = best
    named = lambda v: dict(zip(DOMAINS, v.tolist(), strict=True))
    return gradients[:n], {"before": named(totals), "wanted": named(wanted), "after": named(now), "off": float(off)}


def rate(p: Column, gradients: list[list[float]]) -> Column:
    """Projected gradient steps from a rate of one."""
    r: Column = F.lit(1.0)
    for g in gradients:
        r = F.greatest(F.lit(0.0), r - sum((F.element_at(p, j + 1) * F.lit(x) for j, x in enumerate(g)), F.lit(0.0)))
    return r


def rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, p_<domain>..., rate, targets_off) for every document row; targets_off is how far the furthest domain total is off, of all tokens."""
    model = train(docs, labels, key, text)
    scored = materialize(with_posteriors(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")), model, "text").drop("text"), "posteriors")
    gradients, info = fit_rates(scored, targets or TARGET_WEIGHTS)
    return scored.select(F.col("key").alias(key), F.col("_tokens").alias("n_tokens"), *[F.element_at("_p", j + 1).alias(f"p_{d}") for j, d in enumerate(DOMAINS)], F.round(rate(F.col("_p"), gradients), 6).alias("rate"), F.lit(round(info["off"], 6)).alias("targets_off"))


def copies(of: Column, key: Column, text: Column) -> Column:
    """Whole copies for a rate: its whole part, and one more where a hash of the row falls below the rest."""
    drawn = F.pmod(F.xxhash64(key, F.lit("mix"), text), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return F.floor(of).cast("int") + (drawn < of - F.floor(of)).cast("int")


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of docs as often as their rates say (see copies).

    The posteriors are computed twice, once for the totals and once for the
    decision, so that no text is written or shuffled.
    """
    model = train(docs, labels, key, text)
    sums = with_posteriors(docs.select(F.col(f"`{text}`").alias("text")), model, "text").select("_tokens", "_p")
    gradients, info = fit_rates(sums, targets or TARGET_WEIGHTS)
    if info["off"] > MISSED:
        warnings.warn(f"the rates miss their targets by {info['off']:.2%} of all tokens: {info}", stacklevel=2)
    tokens, p, copy = fresh(docs, "tokens", "posteriors", "copy")
    own = with_posteriors(docs, model, text, (tokens, p))
    n = copies(rate(F.col(p), gradients), F.col(f"`{key}`"), F.col(f"`{text}`"))
    return own.withColumn(copy, F.explode(F.array_repeat(F.lit(0), n))).select(*[F.col(f"`{c}`") for c in docs.columns])


by_value(__name__)
