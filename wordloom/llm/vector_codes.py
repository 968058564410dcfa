"""Short codes for vectors: a codebook for each part of a vector, by active-entry Lloyd rounds.

A part keeps its entry and its exact distance to it from round to round. If its entry
stayed where it was, no entry that stayed can have become nearer, so the part is compared
with the entries that moved only; other parts are compared with all. Equal distances go to
the lower entry, as a full scan would have it.

Vectors travel in blocks: one row holds some thousand of them with their entries and
distances, and the sums that the next codebook needs. A round reads and writes the blocks
where they are and shuffles sums alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.llm.columns import struct
from wordloom.session import Rounds, checkpoint

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
# Whole components beyond this count as this, so that squares and sums stay exact in 64 bits.
LARGEST = 1 << 26
# Components of a block.
BLOCK = 1 << 18


@dataclass(frozen=True)
class Codes:
    """``rows``: ``vec_id, label, code, error``; ``books``: entries by part, entry and place."""

    rows: DataFrame
    books: np.ndarray


def whole_vectors(vectors: DataFrame, column: str, label: str) -> DataFrame:
    """``vec_id, wl_label, wl_v``: usable vectors with whole components."""
    usable = F.col(column).isNotNull() & F.forall(column, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    bounded = lambda x: F.greatest(F.least(x.cast("double") * SCALE, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))
    return vectors.where(usable).select("vec_id", F.col(label).alias("wl_label"), F.transform(column, lambda x: F.floor(bounded(x)).cast("int")).alias("wl_v"))


def distances(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all points to all entries, exact."""
    out = np.empty((len(points), len(entries)), np.int64)
    for e, entry in enumerate(entries):
        apart = points - entry
        out[:, e] = np.einsum("ij,ij->i", apart, apart)
    return out


def full_scan(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of every point and the distance to it."""
    far = distances(points, entries)
    near = far.argmin(axis=1)
    return near, far[np.arange(len(points)), near]


def active_scan(
    points: np.ndarray, entries: np.ndarray, moved: np.ndarray, near: np.ndarray, apart: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """The same as ``full_scan``, from the entries ``near`` and distances ``apart`` before ``moved`` entries moved."""
    near, apart = near.copy(), apart.copy()
    lost = moved[near]
    active = np.flatnonzero(moved)
    if len(active):
        held = np.flatnonzero(~lost)
        best, far = full_scan(points[held], entries[active])
        entry = active[best]
        better = (far < apart[held]) | ((far == apart[held]) & (entry < near[held]))
        near[held[better]], apart[held[better]] = entry[better], far[better]
        rest = np.flatnonzero(lost)
        near[rest], apart[rest] = full_scan(points[rest], entries)
    return near, apart


def part_sums(points: np.ndarray, near: np.ndarray, entries: int) -> np.ndarray:
    """For each entry the number of its points and their sums."""
    out = np.zeros((entries, points.shape[1] + 1), np.int64)
    for e in np.unique(near):
        own = points[near == e]
        out[e, 0] = len(own)
        out[e, 1:] = own.sum(axis=0)
    return out


BLOCK_FIELDS = struct(wl_points=T.BinaryType(), wl_near=T.BinaryType(), wl_apart=T.BinaryType(), wl_sums=T.BinaryType())
FIELD_NAMES = BLOCK_FIELDS.names


def one_block(points: np.ndarray, near: list[np.ndarray], apart: list[np.ndarray], entries: int) -> list[bytes]:
    """The binary fields of a block; ``points`` by vector, part and place."""
    sums = np.stack([part_sums(points[:, p], near[p], entries) for p in range(points.shape[1])])
    return [points.astype(np.int32).tobytes(), np.stack(near).astype(np.uint8).tobytes(), np.stack(apart).tobytes(), sums.tobytes()]


def first_blocks(whole: DataFrame, books: np.ndarray) -> DataFrame:
    """Blocks of vectors, each part at its nearest entry."""
    parts, entries, width = books.shape
    ids, labels = T.ArrayType(whole.schema["vec_id"].dataType), T.ArrayType(whole.schema["wl_label"].dataType)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = max(1, BLOCK // (parts * width))
        for batch in batches:
            for at in range(0, len(batch), size):
                part = batch.slice(at, size)
                points = part.column("wl_v").flatten().to_numpy().astype(np.int64).reshape(-1, parts, width)
                scans = [full_scan(points[:, p], books[p]) for p in range(parts)]
                fields = one_block(points, [s[0] for s in scans], [s[1] for s in scans], entries)
                ends = pa.array([0, len(part)], pa.int32())
                lists = [pa.ListArray.from_arrays(ends, part.column(name)) for name in ("vec_id", "wl_label")]
                yield pa.RecordBatch.from_arrays([*lists, *[pa.array([f], pa.binary()) for f in fields]], names=["wl_ids", "wl_labels", *FIELD_NAMES])

    schema = T.StructType([T.StructField("wl_ids", ids), T.StructField("wl_labels", labels), *BLOCK_FIELDS.fields])
    return whole.mapInArrow(build, schema)


def read_block(row: dict, parts: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    points = np.frombuffer(row["wl_points"], np.int32).astype(np.int64).reshape(-1, parts, width)
    near = np.frombuffer(row["wl_near"], np.uint8).astype(np.int64).reshape(parts, -1)
    return points, near, np.frombuffer(row["wl_apart"], np.int64).reshape(parts, -1)


def next_blocks(blocks: DataFrame, books: np.ndarray, moved: np.ndarray) -> DataFrame:
    """The blocks after the entries ``moved`` have moved to their places in ``books``."""
    parts, entries, width = books.shape

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields = []
            for row in batch.select(FIELD_NAMES[:3]).to_pylist():
                points, near, apart = read_block(row, parts, width)
                scans = [active_scan(points[:, p], books[p], moved[p], near[p], apart[p]) for p in range(parts)]
                fields.append(one_block(points, [s[0] for s in scans], [s[1] for s in scans], entries))
            kept = [batch.column("wl_ids"), batch.column("wl_labels")]
            columns = [pa.array([f[k] for f in fields], pa.binary()) for k in range(len(FIELD_NAMES))]
            yield pa.RecordBatch.from_arrays([*kept, *columns], names=["wl_ids", "wl_labels", *FIELD_NAMES])

    return blocks.mapInArrow(build, blocks.schema)


def moved_books(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after every entry that has parts became their mean, rounded down.

    Each task adds up its blocks; what reaches the driver is one number for each count and
    each component of an entry.
    """
    parts, entries, width = books.shape
    numbers = parts * entries * (width + 1)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(numbers, np.int64)
        for batch in batches:
            for sums in batch.column("wl_sums"):
                total += np.frombuffer(sums.as_py(), np.int64)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], names=["place", "total"])

    totals = blocks.select("wl_sums").mapInArrow(add, "place int, total long").groupBy("place").agg(F.sum("total").alias("total"))
    flat = np.zeros(numbers, np.int64)
    for row in totals.collect():
        flat[row["place"]] = row["total"]
    sums = flat.reshape(parts, entries, width + 1)
    count = sums[:, :, :1]
    return np.where(count > 0, sums[:, :, 1:] // np.maximum(count, 1), books)


def coded_rows(blocks: DataFrame, vectors: DataFrame, label: str, parts: int, width: int) -> DataFrame:
    """``vec_id, label, code, error`` of the vectors in blocks; ``code`` holds one byte a part."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                one = batch.slice(at, 1)
                _, near, apart = read_block(one.select(FIELD_NAMES[:3]).to_pylist()[0], parts, width)
                code = pa.array([row.tobytes() for row in np.ascontiguousarray(near.T.astype(np.uint8))], pa.binary())
                lists = [one.column("wl_ids").flatten(), one.column("wl_labels").flatten()]
                yield pa.RecordBatch.from_arrays([*lists, code, pa.array(apart.sum(axis=0))], names=["vec_id", "label", "code", "error"])

    fields = [T.StructField("vec_id", vectors.schema["vec_id"].dataType), T.StructField("label", vectors.schema[label].dataType)]
    schema = T.StructType([*fields, T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())])
    return blocks.mapInArrow(rows, schema)


def vector_codes(
    vectors: DataFrame,
    column: str = "embedding",
    label: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> Codes:
    """Codes of all usable vectors and the codebooks that they point into.

    ``vectors`` needs ``vec_id``, the array ``column`` and ``label``; others are not read.
    A component x counts as floor(4096 * x), beyond 2^26 as that. A row whose vector is
    null, empty or holds null or non-finite components is dropped; so is one whose vector
    does not have the length of the smallest kept ``vec_id`` or cannot be cut into equal
    parts. The ``entries`` rows with the smallest ids (null ids last, equal ids by their
    vectors) start the codebooks; fewer rows give smaller ones. Rows that repeat are coded
    each. An empty table gives no rows and empty codebooks.

    The rounds write the blocks anew; only the last ones stay. Rounds end early when no
    entry moves, as later ones would change nothing.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte a part, so up to 256 entries")
    order = [F.col("vec_id").asc_nulls_last(), "wl_v"]
    whole = whole_vectors(vectors, column, label).where((F.size("wl_v") > 0) & (F.size("wl_v") % parts == 0))
    first = whole.orderBy(*order).limit(1).select(F.size("wl_v")).first()
    if first is None:
        empty = whole.select("vec_id", F.col("wl_label").alias("label"), F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error"))
        return Codes(empty.limit(0), np.zeros((parts, 0, 0), np.int64))
    whole = whole.where(F.size("wl_v") == first[0])
    start = np.array([row["wl_v"] for row in whole.orderBy(*order).limit(entries).select("wl_v").collect()], np.int64)
    books = np.ascontiguousarray(start.reshape(len(start), parts, -1).transpose(1, 0, 2))
    with Rounds() as state:
        blocks = state.write(first_blocks(whole, books))
        for _ in range(rounds):
            after = moved_books(blocks, books)
            moved = (after != books).any(axis=2)
            if not moved.any():
                break
            books = after
            blocks = state.write(next_blocks(blocks, books, moved))
    return Codes(coded_rows(blocks, vectors, label, parts, books.shape[2]), books)


def decoded(code: bytes, books: np.ndarray) -> np.ndarray:
    """The vector that a code stands for, in components divided by the scale again."""
    return np.concatenate([books[p, entry] for p, entry in enumerate(code)]) / SCALE


def books_digest(books: np.ndarray) -> str:
    """sha256 of all components, by part, entry and place, with commas between."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def codes_digest(vectors: DataFrame) -> DataFrame:
    """Codes as hex, errors, and the error summed over rows of equal labels, nulls together."""
    found = vector_codes(vectors)
    rows = checkpoint(found.rows)
    totals = rows.groupBy(F.col("label").alias("wl_label")).agg(F.sum("error").alias("label_error"))
    joined = rows.join(totals, F.col("label").eqNullSafe(F.col("wl_label")))
    return joined.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books_digest(found.books)).alias("codebooks_sha256"))
