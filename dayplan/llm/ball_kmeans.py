"""Vectors as product-quantisation codes, trained by Ball k-means (operator 11).

A vector's components become integers and are cut into four consecutive parts.  Every part
position has a codebook of up to 256 entries.  All distances are squared integers, so that
the results are exact and the same wherever and in whatever order they are computed.

An assignment pass never compares every part with every entry.  Each part carries the entry
it had before, its *ball*.  From that entry's other entries only those matter that lie within
twice the ball's radius: the *neighbours*.  A part that is nearer to its own entry than half
the way to the nearest neighbour is in the ball's *stable core* and is skipped.  The others
are in the *ring* between half the distances to two successive neighbours, and only the
neighbours up to that ring are compared, exactly.

The vectors with their codes are written to the shared folder after each pass, and the table
of the pass before is deleted; sums by entry are gathered with map-side combine.  What reaches
the driver is the codebooks: 4 x 256 entries, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dayplan.sources.staging import new_path

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Scaled components beyond this have squared distances that a 64-bit integer may not hold.
LARGEST = 1 << 24
#: Components compared at once.
AT_ONCE = 4_000_000

SUMS = "part int, entry int, place int, total bigint, n bigint, far bigint"
CODED = ("code", "error", "label_error", "codebooks_sha256")


@dataclass
class Balls:
    """The entries of one part position and the geometry of their balls."""

    entries: np.ndarray
    #: Other entries by distance from each entry, the entry itself first.
    order: np.ndarray
    #: Their squared distances.
    away: np.ndarray
    #: How many of them can be nearest to something in the ball, the entry itself included.
    reach: np.ndarray

    @classmethod
    def around(cls, entries: np.ndarray, radii: np.ndarray) -> Balls:
        """``radii``: no part of a ball is farther from its entry than this."""
        away = np.array([((entries - entry) ** 2).sum(axis=1) for entry in entries], np.int64).reshape(len(entries), -1)
        order = np.argsort(away, axis=1, kind="stable").astype(np.int64)
        # An entry comes first in its own list, before its equals.
        for own, row in enumerate(order):
            at = int(np.flatnonzero(row == own)[0])
            row[1 : at + 1], row[0] = row[:at].copy(), own
        away = np.take_along_axis(away, order, axis=1)
        within = np.array([np.searchsorted(row, 4 * radius * radius, side="right") for row, radius in zip(away, radii, strict=True)])
        return cls(entries, order, away, np.maximum(within, 1))


def squares(rows: np.ndarray) -> np.ndarray:
    return np.einsum("...s,...s->...", rows, rows)


def to_all(parts: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all parts from all entries, exact in either arithmetic."""
    most = max(int(np.abs(parts).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * most * most * parts.shape[1] < 1 << 53:
        near, entries = parts.astype(np.float64), entries.astype(np.float64)
    else:
        near = parts
    return (squares(near)[:, None] - 2 * (near @ entries.T) + squares(entries)[None]).astype(np.int64)


def nearest(parts: np.ndarray, before: np.ndarray, balls: Balls) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest entry of each part (ties: the lower), its squared distance, distances computed."""
    entries, size = balls.entries, len(balls.entries)
    found, far = before.copy(), squares(parts - entries[before])
    made = len(parts)
    if size == 1 or not len(parts):
        return found, far, made
    active = np.flatnonzero(4 * far >= balls.away[before, 1])
    if not len(active):
        return found, far, made
    active = active[np.argsort(before[active], kind="stable")]
    owners, firsts = np.unique(before[active], return_index=True)
    rings = np.empty(len(active), np.int64)
    for owner, first, last in zip(owners, firsts, [*firsts[1:], len(active)], strict=True):
        rings[first:last] = np.searchsorted(balls.away[owner, : balls.reach[owner]], 4 * far[active[first:last]], side="right")
    width = 1
    while width < size:
        low, width = width, min(2 * width, size)
        band = active[(rings > low) & (rings <= width)]
        step = max(1, AT_ONCE // (width * parts.shape[1]))
        for first in range(0, len(band), step):
            rows = band[first : first + step]
            if width == size:
                candidates = np.broadcast_to(np.arange(size), (len(rows), size))
                away = to_all(parts[rows], entries)
            else:
                candidates = balls.order[before[rows], :width]
                away = squares(entries[candidates] - parts[rows][:, None])
            least = away.min(axis=1)
            found[rows] = np.where(away == least[:, None], candidates, size).min(axis=1)
            far[rows] = least
            made += away.size
    return found, far, made


def integers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A list column without nulls and of one length as a matrix."""
    values = batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return values.reshape(batch.num_rows, -1)


def codes_of(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(batch.num_rows, PARTS)


def assigner(model) -> Callable:
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = np.split(integers(batch, "ints"), PARTS, axis=1)
            before = codes_of(batch).astype(np.int64)
            pairs = [nearest(part, before[:, p], balls)[:2] for p, (part, balls) in enumerate(zip(parts, model.value, strict=True))]
            codes = np.stack([found for found, _ in pairs], axis=1).astype(np.uint8)
            errors = np.stack([far for _, far in pairs], axis=1)
            new = {
                "codes": pa.array([row.tobytes() for row in codes], pa.binary()),
                "errors": pa.FixedSizeListArray.from_arrays(errors.ravel(), PARTS).cast(pa.list_(pa.int64())),
            }
            yield pa.RecordBatch.from_arrays([new.get(name, batch.column(name)) for name in batch.schema.names], batch.schema.names)

    return assign


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums, counts and greatest distances by entry over the rows of a task."""
    totals = counts = far = None
    for batch in batches:
        if not batch.num_rows:
            continue
        parts, codes = np.split(integers(batch, "ints"), PARTS, axis=1), codes_of(batch)
        errors = integers(batch, "errors")
        if totals is None:
            totals = np.zeros((PARTS, ENTRIES, parts[0].shape[1]), np.int64)
            counts, far = np.zeros((PARTS, ENTRIES), np.int64), np.zeros((PARTS, ENTRIES), np.int64)
        for p, part in enumerate(parts):
            counts[p] += np.bincount(codes[:, p], minlength=ENTRIES)
            np.maximum.at(far[p], codes[:, p], errors[:, p])
            for place in range(part.shape[1]):
                # Sums of a batch are far below 2 to the 53rd, so these doubles are whole numbers.
                totals[p, :, place] += np.bincount(codes[:, p], part[:, place], ENTRIES).astype(np.int64)
    if totals is not None:
        p, entry = np.nonzero(counts)
        width = totals.shape[2]
        columns = [np.repeat(p, width), np.repeat(entry, width), np.tile(np.arange(width), len(p)), totals[p, entry].ravel()]
        columns += [np.repeat(counts[p, entry], width), np.repeat(far[p, entry], width)]
        kinds = [pa.int32()] * 3 + [pa.int64()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(k.to_pandas_dtype())) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in SUMS.split(", ")])


def finite(vector: Column) -> Column:
    high = F.lit(float("inf"))
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (x < high) & (x > -high))


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """``(vec_id, label, ints)`` of the rows whose vector has only finite components."""
    kept = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v")).filter(finite(F.col("v")))
    clipped = lambda x: F.greatest(F.least(F.floor(x * SCALE), F.lit(LARGEST + 1)), F.lit(-LARGEST - 1)).cast("int")
    return kept.select("vec_id", "label", F.transform("v", clipped).alias("ints"))


def usual_size(rows: DataFrame) -> int:
    """The commonest length of a vector (ties: the shorter) among those that four divides."""
    sizes = rows.groupBy(F.size("ints").alias("size")).agg(F.count("*").alias("n")).filter(f"size > 0 and size % {PARTS} = 0")
    best = sizes.agg(F.max_by("size", F.struct("n", -F.col("size"))).alias("size")).first()
    return best.size or 0


def moved(books: list[np.ndarray], sums: list) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The entries after a round, and how far the parts of each ball may be from its new entry."""
    new = [book.copy() for book in books]
    far = [np.zeros(len(book)) for book in books]
    for row in sums:
        new[row.part][row.entry, row.place] = row.total // row.n
        far[row.part][row.entry] = row.far
    radii = [np.sqrt(f) + np.sqrt(squares(b - a).astype(np.float64)) for f, a, b in zip(far, books, new, strict=True)]
    return new, [r * (1 + 1e-9) + 1 for r in radii]


def fingerprint(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()


def written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def train(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """``(vec_id, label, codes, errors)`` of all kept vectors, and the codebooks.

    ``codes`` is one byte for each part, ``errors`` the squared distances.  Both are NULL for
    a vector that has no code: one of another length than the commonest that four divides,
    or with a component of 16,384 or more.  Such vectors do not train.
    """
    spark = vectors.sparkSession
    kept, kept_path = written(whole_numbers(vectors), "vectors")
    size = usual_size(kept)
    fits = (F.size("ints") == size) & F.forall("ints", lambda x: F.abs(x) <= LARGEST) if size else F.lit(False)
    rest = kept.filter(~fits).select("vec_id", "label", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("array<bigint>").alias("errors"))
    coded = kept.filter(fits)
    # At most 256 rows: the first codebooks.
    first = coded.orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(ENTRIES).select("ints").collect()
    if not first:
        return rest, []
    books = np.split(np.array([row.ints for row in first], np.int64), PARTS, axis=1)
    radii = [np.full(len(book), 2.0 * LARGEST * size) for book in books]  # one ball holds everything
    state = coded.withColumns({"codes": F.lit(bytes(PARTS)), "errors": F.lit(None).cast("array<bigint>")})
    path = None
    for turn in range(rounds + 1):
        model = spark.sparkContext.broadcast([Balls.around(book, r) for book, r in zip(books, radii, strict=True)])
        state, new = written(state.mapInArrow(assigner(model), state.schema), "vector-codes")
        model.unpersist()
        if path:
            delete(spark, path)
        path = new
        if turn < rounds:
            partial = state.select("ints", "codes", "errors").mapInArrow(summed, SUMS)
            sums = partial.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"), F.max("far").alias("far"))
            books, radii = moved(books, sums.collect())  # 256 entries of every part at most
    return state.drop("ints").unionByName(rest), books


def compress(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row per kept vector: vec_id, code, error, label_error, codebooks_sha256.

    ``vectors`` has vec_id, embedding and label; other columns are not read, whatever their
    names.  Rows with a missing vector, or a NULL or non-finite component, are left out.
    Repeated rows are vectors of their own.  A missing vec_id comes last; equal vec_ids are
    ordered by their components.  Missing labels count as one label.  An empty table, or one
    of vectors without a code (see ``train``), gives no codes; ``label_error`` is the sum over
    the vectors of a label that have a code, NULL if none has.
    """
    rows, books = train(vectors, rounds)
    total = F.aggregate("errors", F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    rows = rows.select("vec_id", "label", F.lower(F.hex("codes")).alias("code"), total.alias("error"))
    labels = rows.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    joined = rows.join(labels, F.col("label").eqNullSafe(F.col("_label")))
    sha = fingerprint(books) if books else None
    return joined.select("vec_id", "code", "error", "label_error", F.lit(sha).cast(T.StringType()).alias("codebooks_sha256"))
