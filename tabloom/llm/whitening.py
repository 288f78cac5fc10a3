"""Whitening of embeddings by the exact characteristic polynomial of their integer scatter.

Entries become whole numbers, so the scatter of the distinct vectors is an exact integer matrix. Its characteristic
polynomial is found modulo many primes by Hessenberg reduction and put together by Chinese remaindering; its largest roots
are isolated in whole-number arithmetic, and inverse iteration in long decimals gives the components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal, localcontext
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm.storage import forget, stored

#: Roots are known to this many bits below the largest one; closer ones count as one root of higher multiplicity.
ROOT_BITS = 160
#: Digits of the inverse iteration: twice those of a root, and as many again as a double has.
_DIGITS = 120
#: Primes reduced together in one task.
_PRIMES_AT_ONCE = 8
#: Components are kept as multiples of 2 ** -_UNIT. Doubles project well while every eigenvalue is above this share of the trace.
_UNIT = 200
_NARROW = 1e-12
_LIMB = 2**64


@dataclass
class Components:
    """The fit: ``n`` distinct vectors with sums ``sums``, and the largest eigenvalues of their covariance.

    ``values`` are the positive ones in falling order, ``vectors`` their unit eigenvectors as columns of whole multiples of
    2 ** -_UNIT, ``explained`` their shares of the total variance. ``size`` is the number of dimensions.
    """

    size: int
    n: int
    sums: list[int]
    values: list[float]
    vectors: np.ndarray
    explained: list[float]


def whole_vectors(rows: DataFrame, id_col: str, vec_col: str, scale: int) -> tuple[DataFrame, int]:
    """(id, x) of the usable rows, with x the entries times ``scale`` rounded down, and the number of dimensions.

    A row is usable if its vector and all entries are there and finite. Where lengths differ, the most frequent one
    counts (of several the largest) and vectors of another length go.
    """
    vector = F.col(vec_col)
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < math.inf))
    x = F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("long"))
    usable = rows.where(vector.isNotNull() & finite).select(F.col(id_col).alias("vec_id"), x.alias("x"))
    lengths = usable.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("c"))
    first = lengths.where("d > 0").orderBy(F.desc("c"), F.desc("d")).head()
    size = first["d"] if first else 0
    return usable.where((F.size("x") == size) & (F.size("x") > 0)), size


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)


def _exact_product(x: np.ndarray) -> np.ndarray:
    """The products of all columns of whole numbers, as Python numbers; through doubles where these are exact."""
    largest = max(int(x.max()), -int(x.min())) if x.size else 0
    if largest * largest * len(x) < 2**53:
        one = x.astype(float)
        return (one.T @ one).astype(np.int64).astype(object)
    wide = x.astype(object)
    return wide.T @ wide


def _moments(size: int):
    """Per task the exact sums of all entries and products, each as two limbs that Spark can add up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(size, object), np.zeros((size, size), object)
        for batch in batches:
            x = _matrix(batch.column("x"), size)
            n += len(x)
            sums += x.astype(object).sum(axis=0) if len(x) else 0
            products += _exact_product(x)
        if not n:
            return
        cells = [(-1, -1, n), *((i, -1, sums[i]) for i in range(size))]
        cells += [(i, j, products[i, j]) for i in range(size) for j in range(i, size)]
        kind = pa.decimal128(38, 0)
        yield pa.RecordBatch.from_pydict({
            "i": pa.array([c[0] for c in cells], pa.int32()), "j": pa.array([c[1] for c in cells], pa.int32()),
            "high": pa.array([Decimal(int(c[2]) // _LIMB) for c in cells], kind),
            "low": pa.array([Decimal(int(c[2]) % _LIMB) for c in cells], kind),
        })

    return run


def integer_scatter(fit: DataFrame, size: int) -> tuple[int, list[int], list[list[int]]]:
    """(n, sums, n * products - sums * sums) of the vectors ``x``: n squared times their covariance, exact.

    A task sends one number per pair of dimensions, whatever its rows, and so does the sum to the driver.
    """
    parts = fit.select("x").mapInArrow(_moments(size), "i int, j int, high decimal(38,0), low decimal(38,0)")
    totals = parts.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    cell = {(r["i"], r["j"]): int(r["high"]) * _LIMB + int(r["low"]) for r in totals}
    n = cell.get((-1, -1), 0)
    sums = [cell.get((i, -1), 0) for i in range(size)]
    scatter = [
        [n * cell.get((min(i, j), max(i, j)), 0) - sums[i] * sums[j] for j in range(size)] for i in range(size)
    ]
    return n, sums, scatter


def _is_prime(n: int) -> bool:
    """Miller-Rabin with bases that decide every number below 2 ** 32."""
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if x in (1, n - 1):
            continue
        if not any((x := x * x % n) == n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_for(bits: int) -> list[int]:
    """The largest primes below 2 ** 31 whose product has more than ``bits`` bits."""
    out, product, at = [], 1, 2**31 - 1
    while product.bit_length() <= bits + 1:
        if _is_prime(at):
            out.append(at)
            product *= at
        at -= 2
    return out


def polynomial_residues(matrix: list[list[int]], primes: list[int]) -> np.ndarray:
    """Coefficients of the characteristic polynomial modulo each prime, from the constant one up, for all at once."""
    d, p = len(matrix), np.array(primes, np.int64)
    a = np.stack([np.array([[v % q for v in row] for row in matrix], np.int64).reshape(d, d) for q in primes])
    each, p1, p2 = np.arange(len(primes)), p[:, None], p[:, None, None]
    for k in range(d - 2):
        # a similar matrix with zeros below the subdiagonal in column k
        pivot = np.argmax(a[:, k + 1 :, k] != 0, axis=1) + k + 1
        rows = a[each, pivot].copy()
        a[each, pivot], a[each, k + 1] = a[each, k + 1].copy(), rows
        columns = a[each, :, pivot].copy()
        a[each, :, pivot], a[each, :, k + 1] = a[each, :, k + 1].copy(), columns
        inverse = np.array([pow(int(v), -1, int(q)) if v else 0 for v, q in zip(a[:, k + 1, k], primes, strict=True)], np.int64)
        factor = a[:, k + 2 :, k] * inverse[:, None] % p1
        a[:, k + 2 :] = (a[:, k + 2 :] - factor[:, :, None] * a[:, k + 1, None, :] % p2) % p2
        a[:, :, k + 1] = (a[:, :, k + 1] + (a[:, :, k + 2 :] * factor[:, None, :] % p2).sum(axis=2)) % p1
    # polynomials of the leading blocks, each from all smaller ones
    blocks = np.zeros((len(primes), d + 1, d + 1), np.int64)
    blocks[:, 0, 0] = 1
    below = np.ones((len(primes), 0), np.int64)
    for k in range(d):
        new = np.zeros((len(primes), d + 1), np.int64)
        new[:, 1:] = blocks[:, k, :-1]
        if k:
            below = np.concatenate([below, np.ones((len(primes), 1), np.int64)], axis=1) * a[:, k, k - 1][:, None] % p1
        weights = np.concatenate([a[:, :k, k] * below % p1, a[:, k, k][:, None]], axis=1)
        taken = (weights[:, :, None] * blocks[:, : k + 1] % p2).sum(axis=1)
        blocks[:, k + 1] = (new - taken) % p1
    return blocks[:, d]


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Exact coefficients of det(x - matrix) for a positive semidefinite matrix, from the constant one up.

    Coefficients are sums of products of eigenvalues, which the trace bounds; that fixes the number of primes. Primes
    are reduced in tasks of their own, and only residues reach the driver.
    """
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    most = max(math.comb(d, k) * trace**k // d**k for k in range(d + 1))
    primes = primes_for(most.bit_length() + 2)
    tasks = -(-len(primes) // _PRIMES_AT_ONCE)
    shared = spark.sparkContext.broadcast(matrix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine = batch.column("p").to_pylist()
            for at in range(0, len(mine), _PRIMES_AT_ONCE):
                part = mine[at : at + _PRIMES_AT_ONCE]
                yield pa.RecordBatch.from_pydict({
                    "p": pa.array(part, pa.int64()),
                    "residues": pa.array(polynomial_residues(shared.value, part).tolist(), pa.list_(pa.int64())),
                })

    listed = spark.createDataFrame([(p,) for p in primes], "p long").repartition(tasks)
    found = {r["p"]: r["residues"] for r in listed.mapInArrow(run, "p long, residues array<long>").collect()}
    values, product = [0] * (d + 1), 1
    for p in primes:
        inverse = pow(product, -1, p)
        values = [v + product * ((r - v) * inverse % p) for v, r in zip(values, found[p], strict=True)]
        product *= p
    return [v - product if v > product // 2 else v for v in values]


def _roots_above(polynomial: list[int], at: int, shift: int) -> int:
    """How many roots lie above at / 2 ** shift, for a polynomial whose roots are all real.

    Then the sign changes of the polynomial moved there are as many as its positive roots, with multiplicity.
    """
    d = len(polynomial) - 1
    c = [v << (shift * (d - k)) for k, v in enumerate(polynomial)]
    for i in range(d):
        for k in range(d - 1, i - 1, -1):
            c[k] += at * c[k + 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def _value(polynomial: list[int], at: int, shift: int) -> int:
    """The polynomial at at / 2 ** shift, times a power of two."""
    total, d = 0, len(polynomial) - 1
    for k in range(d, -1, -1):
        total = total * at + (polynomial[k] << (shift * (d - k)))
    return total


def largest_roots(polynomial: list[int], wanted: int, bits: int = ROOT_BITS) -> list[tuple[Fraction, int]]:
    """(root, multiplicity) of the largest positive roots in falling order, at least ``wanted`` if there are as many.

    All roots must be real and none negative. Intervals are halved until each holds one root, or several that agree to
    ``bits`` bits of the largest one, and then until the root is known as well.
    """
    zeros = next(k for k, v in enumerate(polynomial) if v)
    poly = polynomial[zeros:]
    d = len(poly) - 1
    if d == 0:
        return []
    top = -poly[d - 1] + 1
    shift = max(0, bits + 2 - top.bit_length())
    top_bits = top.bit_length()
    # whole multiples of 2 ** -shift; the sum of all roots bounds them
    out, found = [], 0
    parts = [(0, 1 << (top_bits + shift), d, 0)]
    while parts and found < wanted:
        low, high, above_low, above_high = parts.pop()
        count = above_low - above_high
        if not count:
            continue
        if count > 1 and high - low > 1:
            middle = (low + high) // 2
            inside = _roots_above(poly, middle, shift)
            parts += [(low, middle, above_low, inside), (middle, high, inside, above_high)]
            continue
        if count == 1:
            # the sign changes at the root alone; a root at ``high`` counts as below it
            sign = _value(poly, low, shift) > 0
            while high - low > 1:
                middle = (low + high) // 2
                value = _value(poly, middle, shift)
                if value and (value > 0) == sign:
                    low = middle
                else:
                    high = middle
        exact = _value(poly, high, shift) == 0
        out.append((Fraction(high if exact else 2 * low + 1, 1 << shift if exact else 2 << shift), count))
        found += count
    return out


def null_vectors(matrix: list[list[int]], root: Fraction, count: int) -> np.ndarray:
    """Orthonormal columns that span the null space of ``matrix - root``, by inverse iteration in long decimals.

    The matrix is factored once with pivots; a pivot that vanishes is replaced by a tiny one, which inverse iteration
    allows. Entries are whole multiples of 2 ** -_UNIT; the largest one of a column is positive.
    """
    d = len(matrix)
    with localcontext() as context:
        context.prec = _DIGITS
        centre = Decimal(root.numerator) / Decimal(root.denominator)
        a = np.array([[Decimal(v) for v in row] for row in matrix], object).reshape(d, d)
        for i in range(d):
            a[i, i] -= centre
        norm = max((abs(v) for v in a.flat), default=Decimal(1)) or Decimal(1)
        tiny = norm * Decimal(10) ** (-_DIGITS // 2)
        order = list(range(d))
        for k in range(d):
            pivot = k + max(range(d - k), key=lambda i: abs(a[k + i, k]))
            if pivot != k:
                a[[k, pivot]] = a[[pivot, k]]
                order[k], order[pivot] = order[pivot], order[k]
            if abs(a[k, k]) < tiny:
                a[k, k] = tiny
            if k + 1 < d:
                a[k + 1 :, k] = a[k + 1 :, k] / a[k, k]
                a[k + 1 :, k + 1 :] -= np.outer(a[k + 1 :, k], a[k, k + 1 :])
        draw = np.random.default_rng(d)
        block = [[Decimal(int(v)) for v in draw.integers(1, 1000, d)] for _ in range(count)]
        for _ in range(3):
            solved: list[np.ndarray] = []
            for vector in block:
                x = np.array([vector[i] for i in order], object)
                for k in range(1, d):
                    x[k] -= a[k, :k] @ x[:k]
                for k in range(d - 1, -1, -1):
                    x[k] = (x[k] - (a[k, k + 1 :] @ x[k + 1 :] if k + 1 < d else 0)) / a[k, k]
                x = x / max(abs(v) for v in x)
                for _ in range(2):
                    for other in solved:
                        x = x - other * (other @ x)
                solved.append(x / (x @ x).sqrt())
            block = [list(x) for x in solved]
        out = np.array([[int((v * 2**_UNIT).to_integral_value()) for v in x] for x in block], object).reshape(count, d)
    largest = [max(row, key=abs) for row in out]
    return np.array([[-v for v in row] if most < 0 else list(row) for row, most in zip(out, largest, strict=True)], object).T


def fitted(fit: DataFrame, size: int, components: int) -> Components:
    """The largest ``components`` eigenvalues and unit eigenvectors of the covariance of the vectors ``x`` of ``fit``."""
    spark = fit.sparkSession
    n, sums, scatter = integer_scatter(fit, size)
    common = math.gcd(*(v for row in scatter for v in row)) if n else 0
    if not common:
        return Components(size, n, sums, [], np.zeros((size, 0), object), [])
    matrix = [[v // common for v in row] for row in scatter]
    roots = largest_roots(characteristic_polynomial(spark, matrix), components)
    shared = spark.sparkContext.broadcast(matrix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, root, count in zip(*(batch.column(c).to_pylist() for c in ("at", "root", "count")), strict=True):
                vectors = null_vectors(shared.value, Fraction(root), count)
                yield pa.RecordBatch.from_pydict({
                    "at": pa.array([at], pa.int32()), "vectors": pa.array([[[str(v) for v in x] for x in vectors.T]], pa.list_(pa.list_(pa.string()))),
                })

    listed = spark.createDataFrame([(i, str(r), c) for i, (r, c) in enumerate(roots)], "at int, root string, count int")
    found = {
        r["at"]: r["vectors"]
        for r in listed.repartition(len(roots), "at").mapInArrow(run, "at int, vectors array<array<string>>").collect()
    }
    vectors = np.array([[int(v) for v in x] for i in range(len(roots)) for x in found[i]], object).T[:, :components]
    values = [root for root, count in roots for _ in range(count)][:components]
    trace = sum(matrix[i][i] for i in range(size))
    return Components(
        size, n, sums, [float(v * common / n**2) for v in values], vectors, [float(v / trace) for v in values],
    )


def _projected(model: Components):
    n, size, roots = model.n, model.size, np.sqrt(np.array(model.values, float))
    narrow = all(v > _NARROW for v in model.explained)
    unit = np.array([[v / 2**_UNIT for v in row] for row in model.vectors], float).reshape(size, len(roots))
    most = max((abs(s) for s in model.sums), default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), size)
            bound = n * max(int(x.max()), -int(x.min()), 1) + most if x.size else 0
            if narrow and bound * bound * size < 2**62:
                moved = n * x - np.array(model.sums, np.int64)
                squares, white = (moved * moved).sum(axis=1).tolist(), moved / float(n) @ unit / roots
            else:
                # far-off values would swamp small components in doubles, so the projection is of whole numbers too
                wide = n * x.astype(object) - np.array(model.sums, object)
                squares = [int(v) if v < 10**38 else None for v in (wide * wide).sum(axis=1)] if len(x) else []
                shares = [[v / (n << _UNIT) for v in row] for row in wide @ model.vectors]
                white = np.array(shares, float).reshape(len(x), len(roots)) / roots
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id"), pa.array([None if s is None else Decimal(s) for s in squares], pa.decimal128(38, 0)),
                pa.array(white.tolist(), pa.list_(pa.float64())),
            ], names=["vec_id", "deviation", "whitened"])

    return run


def projected(rows: DataFrame, model: Components) -> DataFrame:
    """(vec_id, deviation, whitened) of rows (vec_id, x), with one entry of ``whitened`` per positive eigenvalue."""
    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.select("vec_id", "x").mapInArrow(
        _projected(model), f"vec_id {kind}, deviation decimal(38,0), whitened array<double>"
    )


def identity_error(fit: DataFrame, model: Components) -> float:
    """The largest entry of the covariance of the whitened fit list minus the identity, measured on its vectors."""
    k = len(model.values)
    if not k:
        return 0.0
    rows = projected(fit.select(F.lit(0).alias("vec_id"), "x"), model)
    entry = [F.get("whitened", F.lit(i)) for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    got = rows.agg(
        *[F.sum(entry[i]).alias(f"s{i}") for i in range(k)], *[F.sum(entry[i] * entry[j]).alias(f"p{i}_{j}") for i, j in pairs]
    ).head()
    mean = [got[f"s{i}"] / model.n for i in range(k)]
    return max(abs(got[f"p{i}_{j}"] / model.n - mean[i] * mean[j] - (i == j)) for i, j in pairs)


def whitened(
    rows: DataFrame, components: int = 4, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256,
) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): one row per usable row and component.

    Vectors become whole numbers ``floor(scale * c)``; each distinct one counts once in the fit of ``n`` vectors.
    ``component`` runs from 1 by falling eigenvalue up to ``components`` or the number of dimensions. ``deviation`` is
    the exact squared length of ``n * x - sums`` (null beyond 38 digits), ``whitened`` the centred vector on the
    component over the root of its eigenvalue, ``explained`` the share of the variance, and ``identity_error`` measures the
    covariance of ``whitened`` over the fit list.

    Rows are read twice and shuffled once, to find the distinct vectors; tasks send one number per pair of dimensions.
    The driver holds matrices of the number of dimensions alone.

    Rows whose vector is null, empty, of another length than most, or holds a null or a number that is not finite are
    dropped; numbers beyond 64 bits count as the largest there. A null id stays, repeated rows give repeated results. A
    component without variance has null in ``whitened`` and explains 0. An empty table gives no rows. Other columns are
    ignored.
    """
    usable, size = whole_vectors(rows, id_col, vec_col, scale)
    fit = stored(usable.select("x").distinct(), "whitening-fit")
    model = fitted(fit, size, components) if size else Components(0, 0, [], [], np.zeros((0, 0), object), [])
    error = identity_error(fit, model)
    forget(fit)
    names = F.array(*[F.struct(
        F.lit(i + 1).alias("component"),
        F.lit(model.explained[i] if i < len(model.explained) else 0.0).alias("explained"),
    ) for i in range(max(min(components, size), 1))])
    out = projected(usable, model) if size else usable.select(
        "vec_id", F.lit(None).cast("decimal(38,0)").alias("deviation"), F.array().cast("array<double>").alias("whitened")
    )
    return out.select("vec_id", "deviation", "whitened", F.explode(names).alias("c")).select(
        F.col("vec_id").alias(id_col), "c.component", F.lit(model.n).cast("long").alias("n"), "deviation",
        F.get("whitened", F.col("c.component") - 1).alias("whitened"), "c.explained", F.lit(error).alias("identity_error"),
    )
