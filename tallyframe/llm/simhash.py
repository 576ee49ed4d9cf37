"""SimHash near-dedup by exact tiled comparison.

Every text gets a 64-bit fingerprint of its word shingles. Distinct fingerprints are dealt to blocks of like
population counts, each pair of blocks near enough is one task, and inside a task tiles sorted by population count are compared with exclusive-or
and bit counts; pairs of tiles whose counts (of the four 16-bit quarters) differ by more than the radius are
skipped. A task returns a spanning forest of its links, never the links themselves, and components are then
found by alternating large-star and small-star steps.

Defined results: null or empty text has fingerprint zero and is linked like any other; equal fingerprints
are one node; repeated rows keep their rows; a null id takes part and is the smallest only where there is no other;
other columns are ignored by `components` and kept by `dedup`; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, read

SHINGLE, RADIUS, SEED = 4, 4, 42
TILE = 256
#: Tasks over which the members of one component are spread.
_SALTS = 16
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_SPACE = bytes.maketrans(b"\t\n\v\f\r", b"     ")


def fingerprint(text: bytes, k: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes."""
    words = text.lower().translate(_SPACE).split(b" ")
    words = [w for w in words if w]
    if not words:
        return 0
    joined = b" ".join(words)
    end = np.cumsum([len(w) + 1 for w in words]) - 1
    if len(words) <= k:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        start = np.concatenate([[0], end[:-1] + 1])[: len(words) - k + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(start, end[k - 1 :].tolist())]
    raw = np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8)
    # counts of each byte's values, then of its bits
    sums = np.concatenate([np.bincount(raw[:, j], minlength=256) @ _BITS for j in range(8)])
    return int.from_bytes(np.packbits(2 * sums > len(hashes)).tobytes(), "big")


def _fingerprints(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            prints = np.array([fingerprint(t.as_py() or b"", k) for t in texts], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(prints.view(np.int64))], names=["doc_id", "text_hash", "print"])

    return run


class _Forest:
    """Union-find over positions, smaller root wins."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, a: int) -> int:
        up = self.up
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _join_dense(forest: _Forest, hit: np.ndarray, a: int, b: int) -> None:
    """Join a tile's many links by breadth-first steps over whole rows and columns."""
    left = hit.any(axis=1)
    while left.any():
        row = int(np.argmax(left))
        rows = np.zeros(len(hit), bool)
        rows[row] = True
        cols = hit[row].copy()
        while True:
            more = hit[:, cols].any(axis=1)
            cols_more = hit[more].any(axis=0)
            if (more == rows).all() and (cols_more == cols).all():
                break
            rows, cols = more, cols_more
        for r in np.flatnonzero(rows).tolist():
            forest.join(a + row, a + r)
        for c in np.flatnonzero(cols).tolist():
            forest.join(a + row, b + c)
        left &= ~rows


def _tiles(prints: np.ndarray, offset: int):
    """Order by the quarters' counts, and for each tile its bounds."""
    quarters = np.bitwise_count((prints[:, None] >> (np.arange(4, dtype=np.uint64) * np.uint64(16))) & np.uint64(0xFFFF)).astype(np.int16)
    order = np.lexsort(quarters.T[::-1])
    prints, quarters = prints[order], quarters[order]
    at = range(0, len(prints), TILE)
    return order, [(offset + i, prints[i : i + TILE], quarters[i : i + TILE].min(axis=0), quarters[i : i + TILE].max(axis=0)) for i in at]


def _spanning(radius: int):
    def run(group: pa.Table) -> pa.Table:
        prints = group.column("print").to_numpy().view(np.uint64)
        side = group.column("side").to_numpy()
        first, second = prints[side == 0], prints[side == 1]
        order, tiles = _tiles(first, 0)
        nodes, others = first[order], None
        if len(second):
            order, others = _tiles(second, len(first))
            nodes = np.concatenate([nodes, second[order]])
        forest = _Forest(len(nodes))
        low, high = (np.array([t[i] for t in (others or tiles)]) for i in (2, 3))
        for n, (a, x, lo, hi) in enumerate(tiles):
            # the least number of bits by which any two members of the tiles must differ
            apart = np.maximum(0, np.maximum(low - hi, lo - high)).sum(axis=1)
            near = np.flatnonzero(apart <= radius)
            if others is None:
                near = near[near >= n]
            for m in near.tolist():
                b, y = (others or tiles)[m][:2]
                hit = np.bitwise_count(x[:, None] ^ y[None, :]) <= radius
                if others is None and m == n:
                    np.fill_diagonal(hit, False)
                links = int(np.count_nonzero(hit))
                if links > 4 * TILE:
                    _join_dense(forest, hit, a, b)
                elif links:
                    for r, c in zip(*(v.tolist() for v in np.nonzero(hit))):
                        forest.join(a + r, b + c)
        roots = np.array([forest.root(i) for i in range(len(nodes))], dtype=np.int64)
        moved = np.flatnonzero(roots != np.arange(len(nodes)))
        return pa.table({"a": nodes[moved].view(np.int64), "b": nodes[roots[moved]].view(np.int64)})

    return run


def _quarters(cells: np.ndarray) -> np.ndarray:
    """The four quarters' population counts of packed cells."""
    return np.stack([cells >> 15 & 31, cells >> 10 & 31, cells >> 5 & 31, cells & 31], axis=1)


def _boxes(cells: np.ndarray, counts: np.ndarray, most: int) -> list[np.ndarray]:
    """Places of cells in boxes of at most `most` prints, or of one cell: split at the median of the widest quarter."""
    quarters, done, todo = _quarters(cells), [], [np.arange(len(cells))]
    while todo:
        own = todo.pop()
        if len(own) == 1 or counts[own].sum() <= most:
            done.append(own)
            continue
        spread = quarters[own].max(axis=0) - quarters[own].min(axis=0)
        values = quarters[own, int(np.argmax(spread))]
        order = np.argsort(values, kind="stable")
        upto = np.cumsum(counts[own][order])
        cut = values[order][int(np.searchsorted(upto, upto[-1] / 2))]
        left = values < cut if (values < cut).any() else values <= cut
        todo += [own[left], own[~left]]
    return done


def _targets(cells: np.ndarray, counts: np.ndarray, most: int, radius: int) -> pa.Table:
    """(cell, base, parts, near): each cell's own blocks, and all blocks that can hold a print within the radius.

    A box of one cell with more than `most` prints has several blocks, among which its prints are dealt.
    """
    quarters, boxes = _quarters(cells), _boxes(cells, counts, most)
    parts = np.array([max(1, math.ceil(counts[own].sum() / most)) for own in boxes])
    base = np.cumsum(parts) - parts
    low, high = (np.array([f(quarters[own], axis=0) for own in boxes]) for f in (np.min, np.max))
    own_box = np.empty(len(cells), np.int64)
    for i, own in enumerate(boxes):
        own_box[own] = i
    near = []
    for q in quarters:
        apart = np.maximum(0, np.maximum(low - q, q - high)).sum(axis=1)
        near.append(np.concatenate([np.arange(base[i], base[i] + parts[i]) for i in np.flatnonzero(apart <= radius)]).tolist())
    return pa.table({"cell": pa.array(cells, pa.int32()), "base": pa.array(base[own_box], pa.int32()), "parts": pa.array(parts[own_box], pa.int32()), "near": pa.array(near, pa.list_(pa.int32()))})


def links(prints: DataFrame, radius: int = RADIUS, block: int = 1 << 18) -> DataFrame:
    """(a, b): a forest that joins all distinct values of `print` that are linked, directly or by others.

    block: most fingerprints, about, in one block. Blocks are boxes in the space of the four quarters' population
    counts (at most 17^4 cells, which the driver sees), and a print is sent to those alone that can hold a partner.
    """
    quarter = lambda i: F.bit_count(F.shiftrightunsigned("print", 48 - 16 * i).bitwiseAND(F.lit(0xFFFF)))
    cell = reduce(lambda a, i: a * 32 + quarter(i), range(1, 4), quarter(0)).cast("int")
    placed = prints.withColumn("cell", cell)
    found = placed.groupBy("cell").agg(F.count("*").alias("n")).orderBy("cell").collect()
    n = sum(r.n for r in found)
    blocks = max(math.ceil(n / block), min(16, math.ceil(n / 4096)), 1)
    table = _targets(np.array([r.cell for r in found], np.int64), np.array([r.n for r in found], np.int64), math.ceil(n / blocks), radius) if found else None
    if table is None:
        return prints.select(F.col("print").alias("a"), F.col("print").alias("b"))
    targets = F.broadcast(prints.sparkSession.createDataFrame(table))  # a row for each cell
    dealt = placed.join(targets, "cell").withColumn("own", (F.col("base") + F.pmod(F.xxhash64("print"), F.col("parts"))).cast("int"))
    dealt = dealt.select("print", "own", F.explode("near").alias("other"))
    dealt = dealt.select("print", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    return dealt.groupBy("i", "j").applyInArrow(_spanning(radius), "a long, b long")


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with a link; root is the smallest node of its component."""
    edges = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        # large star: larger neighbours go to the least neighbour
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: smaller neighbours and the node itself go to the least
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()
        edges = checkpoint(small)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def _members(docs: DataFrame, id_col: str, text_col: str, k: int, radius: int, block: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, print) of every input row; (print, root, least) of every print: its component and that one's first row."""
    id_type = docs.schema[id_col].dataType.simpleString()
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    rows = checkpoint(given.mapInArrow(_fingerprints(k), f"doc_id {id_type}, text_hash long, print long"))
    # null ids come last
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")).alias("first")
    nodes = checkpoint(rows.groupBy("print").agg(first))
    joined = connected(links(nodes.select("print"), radius, block))
    members = nodes.join(joined, nodes["print"] == joined["node"], "left").select("print", "first", F.coalesce("root", "print").alias("root"))
    least = members.groupBy("root").agg(F.min("first").alias("least"))
    # a component may hold a large share of all prints: its members are spread over several tasks
    least = least.withColumn("salt", F.explode(F.array(*map(F.lit, range(_SALTS)))))
    named = members.withColumn("salt", F.pmod(F.xxhash64("print"), F.lit(_SALTS)).cast("int")).join(least, ["root", "salt"])
    return rows, named.select("print", "root", "least")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, radius: int = RADIUS, block: int = 1 << 18) -> DataFrame:
    """(doc_id, print, component_id) for every input row."""
    rows, named = _members(docs, id_col, text_col, k, radius, block)
    return rows.join(named, "print").select("doc_id", "print", F.col("least.doc_id").alias("component_id"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, radius: int = RADIUS, block: int = 1 << 18) -> DataFrame:
    """The input without all but one row of each component: the one with the smallest id, and of equal ids with the smallest text hash.

    Rows without id come last; of rows equal in id and text one stays. Rows of one id and different components all stay.
    """
    _, named = _members(docs, id_col, text_col, k, radius, block)
    kept = named.select(F.col("least.doc_id").alias("kept_id"), F.col("least.text_hash").alias("kept_hash")).distinct()
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("row_id"), F.xxhash64(text_col).alias("row_hash"))
    found = given.join(kept, F.expr("row_id <=> kept_id AND row_hash = kept_hash"), "left_semi").dropDuplicates(["row_id", "row_hash"])
    return found.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = components(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
