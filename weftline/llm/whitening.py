"""Operator 12: whitening of embeddings from an exact scatter matrix.

Each component c, as double, becomes the whole number x = floor(64 * c) +
1,000,000. The distinct x-vectors are the fit list. A task takes a block of
them, shifts every dimension by its least value in the block, packs each of the
shifted dimension's bits across rows into 64-bit words (a *plane*), and counts
the ones of the AND of every two planes; weighted by their powers of two these
counts are the exact cross products of the shifted values. Undoing the shift
gives exact sums and products of x - 1,000,000, which Spark adds up entry by
entry. The driver gets one d x d matrix for each length of vectors, whatever
the number of rows; it centres it in whole numbers (n * products - sum * sum)
and only then turns it to doubles for ``eigh``.

Rows whose vector is null or holds null or non-finite entries go. Vectors of
different lengths are fitted apart, each length with its own n and components.
Where floor(64 * c) lies beyond 2**62 it is held there. Rows stay whatever
their id: repeated and null ids each give their rows. A component whose
eigenvalue is no more than rounding noise of the greatest (fewer distinct
vectors than dimensions, constant dimensions) can't be scaled: its whitened
value is null; so is explained where all vectors are the same. Empty vectors
have no component and no rows. An empty table gives an empty result. Columns
besides ``vec_id`` and ``embedding`` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import exchange as X

SCALE, OFFSET, EDGE = 64, 1_000_000, 1 << 62
#: Rows of a block whose planes are counted at once, components kept, rows of the result in a batch.
BLOCK_ROWS, COMPONENTS, BATCH_ROWS = 1 << 14, 16, 1 << 14
#: Eigenvalues under this share of the greatest are rounding noise.
NOISE = 1e-13
LIMB = 1 << 64


def usable(embedding: Column) -> Column:
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return embedding.isNotNull() & ~F.coalesce(bad, F.lit(True))


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id, dim and x of the usable rows; x: the vector's x - 1,000,000 in the
    narrowest of 2, 4 and 8 bytes that holds all of them, so equal vectors are
    equal bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e = batch.column("e")
            size = np.asarray(e.value_lengths()).astype(np.int64)
            with np.errstate(over="ignore"):  # beyond the greatest double is beyond EDGE too
                floor = np.floor(SCALE * np.asarray(e.flatten(), dtype=np.float64))
            flat = np.clip(floor, -float(EDGE), float(EDGE)).astype(np.int64)
            upto = np.concatenate([[0], np.cumsum(size)])
            most = np.zeros(len(size), dtype=np.int64)
            filled = np.flatnonzero(size)
            if len(filled):
                most[filled] = np.maximum.reduceat(np.where(flat < 0, ~flat, flat), upto[filled])
            kinds = np.where(most < 1 << 15, "<i2", np.where(most < 1 << 31, "<i4", "<i8"))
            data = [flat[a:b].astype(k).tobytes() for a, b, k in zip(upto[:-1].tolist(), upto[1:].tolist(), kinds.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(size, pa.int32()), pa.array(data, pa.binary())], ["vec_id", "dim", "x"])

    double = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    return double.filter(usable(F.col("e")) & (F.size("e") > 0)).mapInArrow(pack, "vec_id long, dim int, x binary")


def matrices(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """dim, places in the batch, and the x - 1,000,000 of the rows of each length and width."""
    dim = np.asarray(batch.column("dim")).astype(np.int64)
    data = batch.column("x")
    width = np.asarray(pc.binary_length(data)).astype(np.int64) // dim
    for d, w in sorted(set(zip(dim.tolist(), width.tolist(), strict=True))):
        rows = np.flatnonzero((dim == d) & (width == w))
        own = b"".join(data.take(pa.array(rows)).to_pylist())
        yield d, rows, np.frombuffer(own, f"<i{w}").reshape(len(rows), d).astype(np.int64)


def planes(shifted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bit planes of the dimensions (columns) of unsigned rows: dimension and
    bit of each plane, and its words, in which a row is a bit."""
    bits = [int(x).bit_length() for x in shifted.max(axis=0, initial=0)]
    dims = np.repeat(np.arange(shifted.shape[1]), bits)
    bit = np.concatenate([np.arange(b) for b in bits]) if bits else np.zeros(0, np.int64)
    words = np.zeros((len(dims), -(-len(shifted) // 64) * 8), dtype=np.uint8)
    for k, (j, b) in enumerate(zip(dims.tolist(), bit.tolist(), strict=True)):
        ones = np.packbits(((shifted[:, j] >> np.uint64(b)) & np.uint64(1)).astype(bool))
        words[k, : len(ones)] = ones
    return dims, bit, words.view(np.uint64)


def popcounts(words: np.ndarray) -> np.ndarray:
    """Ones of the AND of every two planes (the upper triangle)."""
    out = np.zeros((len(words), len(words)), dtype=np.int64)
    for k in range(len(words)):
        out[k, k:] = np.bitwise_count(words[k] & words[k:]).sum(axis=1, dtype=np.int64)
    return out


def block_moments(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums and cross products of the columns of x, as Python's whole numbers."""
    n, d = x.shape
    low = x.min(axis=0)
    shifted = x.view(np.uint64) - low.view(np.uint64)  # modulo 2**64, so any two longs are right
    dims, bit, words = planes(shifted)
    counts = popcounts(words)
    counts = counts + np.triu(counts, 1).T
    own = np.diag(counts)
    if 2 * (int(bit.max(initial=0)) + 1) + n.bit_length() < 63:  # all weighted sums fit a long
        weight = np.zeros((len(dims), d), dtype=np.int64)
        weight[np.arange(len(dims)), dims] = np.int64(1) << bit.astype(np.int64)
        sums, products = (weight.T @ own).astype(object), (weight.T @ counts @ weight).astype(object)
    else:
        weight = np.zeros((len(dims), d), dtype=object)
        weight[np.arange(len(dims)), dims] = [1 << b for b in bit.tolist()]
        sums, products = weight.T.dot(own.astype(object)), weight.T.dot(counts.astype(object)).dot(weight)
    base = low.astype(object)  # undo the shift
    products = products + np.outer(base, sums) + np.outer(sums, base) + n * np.outer(base, base)
    return sums + n * base, products


def _decimals(values: list[int]) -> pa.Array:
    return pa.array([Decimal(v) for v in values], pa.decimal128(38, 0))


ENTRY = "dim int, i int, j int, high decimal(38,0), low decimal(38,0)"


def moments(fit: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Exact moments of the distinct vectors (dim, x): per length, the entry (-1, -1)
    counts them, (-1, j) sums dimension j, (i, j) with i <= j sums products. A
    value is high * 2**64 + low."""

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        total: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}

        def add(d: int) -> None:
            x = np.concatenate(held.pop(d))
            sums, products = block_moments(x)
            n, s, p = total.get(d, (0, 0, 0))
            total[d] = (n + len(x), s + sums, p + products)

        for batch in batches:
            for d, _, x in matrices(batch):
                for at in range(0, len(x), block_rows):
                    held.setdefault(d, []).append(x[at : at + block_rows])
                    if sum(map(len, held[d])) >= block_rows:
                        add(d)
        for d in list(held):
            add(d)
        for d, (n, sums, products) in total.items():
            i, j = np.triu_indices(d)
            values = [n, *sums.tolist(), *products[i, j].tolist()]
            i, j = np.concatenate([np.full(d + 1, -1), i]), np.concatenate([[-1], np.arange(d), j])
            for at in range(0, len(values), BATCH_ROWS):
                part = values[at : at + BATCH_ROWS]
                high, low = zip(*(divmod(v, LIMB) for v in part), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([d] * len(part), pa.int32()), pa.array(i[at : at + BATCH_ROWS], pa.int32()), pa.array(j[at : at + BATCH_ROWS], pa.int32()), _decimals(list(high)), _decimals(list(low))], ["dim", "i", "j", "high", "low"])

    parts = fit.select("dim", "x").mapInArrow(scatter, ENTRY)
    return parts.groupBy("dim", "i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))


class Model:
    """What whitens the vectors of one length: n, sums of x - 1,000,000 (exact),
    components (columns, by falling eigenvalue), eigenvalues, share of the trace."""

    def __init__(self, n: int, sums: list[int], products: list[list[int]], components: int):
        d = len(sums)
        self.n, self.sums = n, sums
        exact = [[n * products[i][j] - sums[i] * sums[j] for j in range(d)] for i in range(d)]  # n * n * covariance
        covariance = np.array([[v / (n * n) for v in row] for row in exact], dtype=np.float64)  # whole numbers: rounded once
        values, vectors = np.linalg.eigh(covariance)
        order = np.argsort(-values, kind="stable")[:components]
        self.values, self.vectors = values[order], np.ascontiguousarray(vectors[:, order])
        trace = sum(exact[i][i] for i in range(d)) / (n * n)
        self.live = (self.values > NOISE * max(float(values.max()), 0.0)) & (trace > 0)
        self.explained = self.values / trace if trace else np.full(len(self.values), np.nan)
        self.scale = np.where(self.live, 1 / np.sqrt(np.where(self.live, self.values, 1)), np.nan)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums of whole rows: longs where all fit, else Python's whole numbers."""
        most = int(np.abs(x).max(initial=0)) * self.n + max(abs(s) for s in self.sums)
        if most < 1 << 62:
            return x * self.n - np.array(self.sums, dtype=np.int64)
        return x.astype(object) * self.n - np.array(self.sums, dtype=object)

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return (centred / self.n).astype(np.float64) @ self.vectors * self.scale

    def deviation(self, centred: np.ndarray) -> list[int]:
        """Sum of squares over the dimensions, exact."""
        if centred.dtype != object and int(np.abs(centred).max(initial=0)) ** 2 * centred.shape[1] < 1 << 63:
            return (centred * centred).sum(axis=1).tolist()
        whole = centred.astype(object)
        return (whole * whole).sum(axis=1).tolist()


def models(entries: DataFrame, components: int = COMPONENTS) -> dict[int, Model]:
    """The model of each length. The rows that the driver gets are d * d / 2 for
    each length d of vectors, however many vectors there are."""
    found: dict[int, dict[tuple[int, int], int]] = {}
    for r in entries.collect():
        found.setdefault(r["dim"], {})[r["i"], r["j"]] = int(r["high"]) * LIMB + int(r["low"])
    out = {}
    for d, at in found.items():
        products = [[at[min(i, j), max(i, j)] for j in range(d)] for i in range(d)]
        out[d] = Model(at[-1, -1], [at[-1, j] for j in range(d)], products, components)
    return out


def identity_errors(fit: DataFrame, known: dict[int, Model]) -> dict[int, float]:
    """Per length, the largest absolute entry of the covariance of the whitened
    fit list minus the identity, from the whitened vectors themselves."""
    shared = fit.sparkSession.sparkContext.broadcast(known)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for d, _, x in matrices(batch):
                model = shared.value[d]
                y = model.whitened(model.centred(x))[:, model.live]
                s, p = total.get(d, (0.0, 0.0))
                total[d] = (s + y.sum(axis=0), p + y.T @ y)
        for d, (s, p) in total.items():
            k = len(s)
            i, j = np.divmod(np.arange(k * k), max(k, 1))
            i, j, v = np.concatenate([np.full(k, -1), i]), np.concatenate([np.arange(k), j]), np.concatenate([s, p.reshape(-1)])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), d), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(v)], ["dim", "i", "j", "v"])

    rows = fit.select("dim", "x").mapInArrow(products, "dim int, i int, j int, v double").groupBy("dim", "i", "j").agg(F.sum("v").alias("v")).collect()
    out = {}
    for d, model in known.items():
        own = {(r["i"], r["j"]): r["v"] for r in rows if r["dim"] == d}
        mean = {j: v / model.n for (i, j), v in own.items() if i < 0}
        out[d] = max((abs(v / model.n - mean[i] * mean[j] - (i == j)) for (i, j), v in own.items() if i >= 0), default=float("nan"))
    return out


RESULT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = COMPONENTS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and
    identity_error of every usable row (vec_id, embedding) and component.
    deviation is null where it has more than 38 digits."""
    rows = quantised(vectors)
    fit = X.cut(rows.select("dim", "x").distinct())
    known = models(moments(fit, block_rows), components)
    errors = identity_errors(fit, known)
    shared = vectors.sparkSession.sparkContext.broadcast((known, errors))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, error = shared.value
        for batch in batches:
            for d, at, x in matrices(batch):
                model, k = held[d], len(held[d].values)
                step = max(1, BATCH_ROWS // k)
                for a in range(0, len(at), step):
                    centred = model.centred(x[a : a + step])
                    deviation = [v if v < 10**38 else None for v in model.deviation(centred)]
                    m = len(deviation)
                    ids = batch.column("vec_id").take(pa.array(np.repeat(at[a : a + step], k)))
                    exact = pa.array([None if v is None else Decimal(v) for v in deviation], pa.decimal128(38, 0)).take(pa.array(np.repeat(np.arange(m), k)))
                    number = lambda v: pa.array(v, mask=~np.isfinite(v))
                    columns = [pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, model.n), pa.int64()), exact]
                    columns += [number(model.whitened(centred).reshape(-1)), number(np.tile(model.explained, m)), number(np.full(m * k, error[d]))]
                    yield pa.RecordBatch.from_arrays([ids, *columns], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(apply, RESULT)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    fits = F.col("deviation") <= F.lit((1 << 63) - 1)
    return made.withColumn("deviation", F.when(fits, F.col("deviation")).cast("long"))
