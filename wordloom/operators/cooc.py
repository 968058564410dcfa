"""Co-occurrence of vocabulary terms: the product of the term-document matrix with itself.

The matrix is cut into tiles. Tasks add documents into tiles and send whole tiles on, each as
one binary value: every cell, or only those that are not 0 where these are few. Tiles of
one place are added up by groups of tasks first and then over the groups; cells become
rows when their sums are done.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.operators.terms import counted, vocab_index
from wordloom.session import checkpoint

# Documents per dense block inside a task, documents whose terms are looked up at a time,
# terms per side of a tile, and the tiles that a task holds (256 MB of them). With more tiles
# than that a task holds postings instead, so many at a time, and works out one tile after the other.
BLOCK_DOCS = 512
LOOKUP_DOCS = 4 * BLOCK_DOCS
TILE_TERMS = 512
TASK_TILES = 128
TASK_POSTINGS = 1 << 22

# Groups of tasks that tiles are first added up by.
TASK_GROUPS = 256

# Below this, sums of products of counts are exact in doubles.
EXACT_DOUBLE = 2.0**53

TILE_SCHEMA = "row int, column int, part int, places binary, weights binary"


def packed(tile: np.ndarray) -> tuple[bytes, bytes]:
    """Places and weights of a tile's cells; no places if all cells are there."""
    flat = tile.ravel()
    held = np.flatnonzero(flat)
    kind = np.int32 if len(held) and flat.max() < 1 << 31 else np.int64
    if 2 * len(held) > len(flat):
        return b"", flat.astype(kind).tobytes()
    return held.astype(np.int32).tobytes(), flat[held].astype(kind).tobytes()


def add_packed(tile: np.ndarray, places: bytes, weights: bytes) -> None:
    """Add the cells of a packed tile to a flat one."""
    if not weights:
        return
    at = np.frombuffer(places, np.int32) if places else slice(None)
    cells = len(places) // 4 or len(tile)
    tile[at] += np.frombuffer(weights, np.int32 if len(weights) == 4 * cells else np.int64)


def tile_batch(row: int, column: int, part: int, tile: np.ndarray) -> pa.RecordBatch:
    arrays = [pa.array([n], pa.int32()) for n in (row, column, part)]
    arrays += [pa.array([value], pa.binary()) for value in packed(tile)]
    return pa.RecordBatch.from_arrays(arrays, names=["row", "column", "part", "places", "weights"])


def summed_tiles(tiles: DataFrame, *keys: str) -> DataFrame:
    """Tiles of equal ``keys`` added up; a group's tiles are read one after the other."""

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(TILE_TERMS * TILE_TERMS, np.int64)
        for batch in batches:
            for places, weights in zip(batch.column("places"), batch.column("weights"), strict=True):
                add_packed(total, places.as_py(), weights.as_py())
        row, column, *part = [k.as_py() for k in key]
        yield tile_batch(row, column, part[0] if part else 0, total)

    return tiles.groupBy(*keys).applyInArrow(add, TILE_SCHEMA)


def tile_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells ``(i, j, weight)`` on and above the diagonal of the whole matrix."""
    for batch in batches:
        for row, column, places, weights in zip(*[batch.column(name) for name in ("row", "column", "places", "weights")], strict=True):
            row, column = row.as_py(), column.as_py()
            tile = np.zeros(TILE_TERMS * TILE_TERMS, np.int64)
            add_packed(tile, places.as_py(), weights.as_py())
            tile = tile.reshape(TILE_TERMS, TILE_TERMS)
            i, j = np.nonzero(np.triu(tile) if row == column else tile)
            weights = tile[i, j]
            ends = [i + row * TILE_TERMS, j + column * TILE_TERMS]
            arrays = [*[pa.array(end.astype(np.int32)) for end in ends], pa.array(weights)]
            yield pa.RecordBatch.from_arrays(arrays, names=["i", "j", "weight"])


class Postings:
    """The postings of some documents: numbers of documents and terms, and counts, by document."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, counts: np.ndarray):
        self.rows, self.cols, self.counts = rows, cols, counts
        self.strips = cols // TILE_TERMS

    def blocks(self) -> Iterator[Postings]:
        """The same by blocks of documents."""
        first = self.rows - self.rows % BLOCK_DOCS
        ends = np.flatnonzero(np.append(first[1:] != first[:-1], True)) + 1 if len(first) else []
        start = 0
        for end in ends:
            part = slice(start, end)
            yield Postings(self.rows[part], self.cols[part], self.counts[part])
            start = end

    def matrix(self, strip: int) -> np.ndarray:
        """Counts by document of the block and term of the strip; whole numbers where doubles would not be exact."""
        kind = np.float64 if np.square(self.counts.astype(float)).sum() < EXACT_DOUBLE else np.int64
        at = np.flatnonzero(self.strips == strip)
        block = np.zeros((BLOCK_DOCS, TILE_TERMS), kind)
        block[self.rows[at] % BLOCK_DOCS, self.cols[at] - strip * TILE_TERMS] = self.counts[at]
        return block


def tile_products(postings: Iterator[Postings], strips: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Tiles of the product of the postings with themselves, on and above the diagonal.

    If all tiles are few each comes once; else each comes once for every ``TASK_POSTINGS``
    postings, and one is held at a time.
    """
    places = [(row, column) for row in range(strips) for column in range(row, strips)]
    if len(places) <= TASK_TILES:
        tiles: dict[tuple[int, int], np.ndarray] = {}
        for some in postings:
            for block in some.blocks():
                matrices = {int(strip): block.matrix(strip) for strip in np.unique(block.strips)}
                for row, column in places:
                    if row in matrices and column in matrices:
                        tile = tiles.setdefault((row, column), np.zeros((TILE_TERMS, TILE_TERMS), np.int64))
                        tile += (matrices[row].T @ matrices[column]).astype(np.int64)
        for place, tile in tiles.items():
            yield *place, tile
        return
    for some in postings:
        blocks = [(block, set(np.unique(block.strips).tolist())) for block in some.blocks()]
        for row in range(strips):
            left = [block.matrix(row) if row in held else None for block, held in blocks]
            for column in range(row, strips):
                tile = np.zeros((TILE_TERMS, TILE_TERMS), np.int64)
                for (block, held), matrix in zip(blocks, left, strict=True):
                    if matrix is not None and column in held:
                        tile += (matrix.T @ block.matrix(column)).astype(np.int64)
                if tile.any():
                    yield row, column, tile


def known_postings(batches: Iterator[pa.RecordBatch], lookup: pa.Array, binary: bool, most: int | None = None) -> Iterator[Postings]:
    """Postings of known terms, ``most`` (``TASK_POSTINGS``) or somewhat more at a time; counts are 1 if ``binary``.

    Terms are looked up for some documents of a batch after the other, and what is held until
    there are enough of them is numbers, no wider than they must be.
    """
    most = TASK_POSTINGS if most is None else most
    held: list[tuple[np.ndarray, ...]] = []
    size = docs = 0
    for batch in batches:
        for start in range(0, len(batch), LOOKUP_DOCS):
            lists = batch.column(0).slice(start, LOOKUP_DOCS)
            postings = lists.flatten()
            rows = np.repeat(np.arange(docs, docs + len(lists), dtype=np.int32), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
            found = pc.index_in(postings.field("term"), value_set=lookup)
            valid = found.is_valid().to_numpy(zero_copy_only=False)
            counts = postings.field("tf").to_numpy()[valid]
            kind = np.int32 if not len(counts) or counts.max() < 1 << 31 else np.int64
            held.append((rows[valid], found.drop_null().to_numpy(), np.ones_like(counts, kind) if binary else counts.astype(kind)))
            size += len(held[-1][0])
            docs += len(lists)
            if size >= most:
                some, held, size, docs = Postings(*map(np.concatenate, zip(*held, strict=True))), [], 0, 0
                yield some
                del some
    if size:
        yield Postings(*map(np.concatenate, zip(*held, strict=True)))


def cooccurrence(docs: DataFrame, vocab: DataFrame, binary: bool = False, min_token_len: int = 2) -> DataFrame:
    """Cells ``(src, dst, weight)`` with ``src <= dst`` and a weight above 0.

    ``weight`` sums, over all documents, the product of both terms' counts; with
    ``binary`` each term counts once a document. Cells with ``src = dst`` hold the
    terms' own strengths.

    Every task multiplies its documents by themselves and sends whole tiles on; no
    document's pairs are listed. A vocabulary of up to about 7,500 terms has so few tiles
    that a task sends each once; a larger one is not limited, only sent in parts. The
    vocabulary, as large as its parameter says, goes to the tasks by a broadcast variable.
    """
    spark = docs.sparkSession
    numbers = checkpoint(vocab_index(vocab.select("term")))
    terms = [row["term"] for row in numbers.orderBy("idx").collect()]
    known = spark.sparkContext.broadcast(terms)
    strips = -(-len(terms) // TILE_TERMS)
    # With few tiles a task adds documents into them as they come.
    most = 1 if strips * (strips + 1) // 2 <= TASK_TILES else TASK_POSTINGS

    def partial_products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = None
        postings = known_postings(batches, pa.array(known.value, pa.string()), binary, most)
        for row, column, tile in tile_products(postings, strips):
            if part is None:
                part = xxhash.xxh3_64_intdigest(tile.tobytes()) % TASK_GROUPS
            yield tile_batch(row, column, part, tile)

    tiles = counted(docs, min_token_len).select("terms").mapInArrow(partial_products, TILE_SCHEMA)
    sums = summed_tiles(summed_tiles(tiles, "row", "column", "part"), "row", "column")
    cells = sums.mapInArrow(tile_cells, "i int, j int, weight long")
    src = numbers.select(F.col("idx").alias("i"), F.col("term").alias("src"))
    dst = numbers.select(F.col("idx").alias("j"), F.col("term").alias("dst"))
    return cells.join(src, "i").join(dst, "j").select("src", "dst", "weight")


def edges_above(cells: DataFrame, min_count: int = 0) -> DataFrame:
    """Edges between different terms with a weight above ``min_count``."""
    return cells.where((F.col("src") < F.col("dst")) & (F.col("weight") > min_count))


def node_weights(cells: DataFrame) -> DataFrame:
    """Strength of each term scaled to 0..1 over the vocabulary: ``(term, strength, weight)``.

    The weight is null if all terms are equally strong.
    """
    strengths = cells.where(F.col("src") == F.col("dst")).select(F.col("src").alias("term"), F.col("weight").alias("strength"))
    low = strengths.agg(F.min("strength")).scalar()
    high = strengths.agg(F.max("strength")).scalar()
    return strengths.select("term", "strength", F.try_divide(F.col("strength") - low, high - low).alias("weight"))


def endpoints(edges: DataFrame) -> DataFrame:
    """Distinct terms that have an edge: ``(term)``."""
    return edges.select(F.explode(F.array("src", "dst")).alias("term")).distinct()


def drop_isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that have at least one edge."""
    return nodes.join(endpoints(edges), "term", "left_semi")
