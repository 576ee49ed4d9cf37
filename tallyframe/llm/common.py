"""Shared parts: table reading, checkpoints, and vectorised tokenising of Arrow batches.

Words are split on raw UTF-8 bytes: a lookup table maps each byte to itself, to its lower-case
form, or to 0 (separator). Word identity is a 64-bit polynomial hash mixed at the end.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text tokenised at a time; bounds the memory of the vectorised passes.
CHUNK_BYTES = 1 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named in spark.checkpoint.dir; a temporary one only where none is set and Spark runs on this machine alone."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ckpt"))


def shared_folder(spark: SparkSession) -> str:
    """The folder, seen by all machines, for tables between steps."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()


def release_memory() -> None:
    """Give back what earlier tasks of this worker have freed; Python and Arrow would keep it for themselves."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where there is no glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def row_key(id_col: str = "doc_id", text_col: str = "text") -> list:
    """Columns naming a row by content, so that repeated or null ids do not mix different texts."""
    return [F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash")]


def _lut(keep: np.ndarray, lower: bool) -> np.ndarray:
    lut = np.where(keep, np.arange(256), 0).astype(np.uint8)
    if lower:
        lut[65:91] = np.arange(97, 123)
    return lut


_b = np.arange(256)
#: Words of everything but ASCII white space; case kept or A-Z lower-cased.
SPACE_WORDS = _lut(~np.isin(_b, [32, 9, 10, 11, 12, 13]), False)
SPACE_WORDS[0] = 255  # NUL is a word byte here and 0 marks separators; 255 never occurs in UTF-8
SPACE_WORDS_LOWER = SPACE_WORDS.copy()
SPACE_WORDS_LOWER[65:91] = np.arange(97, 123)
#: Words of ASCII digits, letters (lower-cased) and all bytes from 0x80.
ALNUM_WORDS = _lut(((_b >= 48) & (_b <= 57)) | ((_b >= 97) & (_b <= 122)) | (_b >= 128), False)
ALNUM_WORDS[65:91] = np.arange(97, 123)

_table = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_K = np.uint64(0xC2B2AE3D27D4EB4F)
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _power(n: int, base: np.uint64, name: str) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 4 * CHUNK_BYTES:
            _powers[name] = have
    return have[:n]


def byte_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of rows of about `size` bytes; a longer row stands alone."""
    if not len(column):
        return
    raw, at = byte_column(column)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


class Words:
    """Start and end bytes, row number and 64-bit hash of every word of a run of rows."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, lut: np.ndarray, hashes: bool = True):
        self.at, self.n_rows = at, len(at) - 1
        b = lut[raw]
        self.bytes = b
        w = b != 0
        before = np.empty(len(w), bool)
        after = np.empty(len(w), bool)
        if len(w):
            before[0], after[-1] = False, False
            before[1:], after[:-1] = w[:-1], w[1:]
            inner = at[(at > 0) & (at < len(w))]
            before[inner], after[inner - 1] = False, False
        self.start = np.flatnonzero(w & ~before)
        self.end = np.flatnonzero(w & ~after) + 1
        self.row = np.searchsorted(at, self.start, "right") - 1
        self.count = np.bincount(self.row, minlength=self.n_rows)
        #: Index of the first word of each row.
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        if hashes:
            self.hash = span_hash(b, self.start, self.end)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of all runs of k words inside one row."""
        n = len(self.start)
        if n < k:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        g = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            g = g * _K + self.hash[j : n - k + 1 + j]
        whole = np.flatnonzero(self.row[: n - k + 1] == self.row[k - 1 :])
        return whole, mix(g[whole])


def span_hash(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hash of b[start:end] for many spans at once."""
    n = len(b)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_table[b] * _power(n, _P, "p"), out=total[1:])
    return mix((total[end] - total[start]) * _power(n + 1, _P_INV, "inverse")[start] + (end - start).astype(np.uint64))


def text_hash(words: list[bytes]) -> np.ndarray:
    """The same hash for separate words."""
    raw = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum([len(w) for w in words]).astype(np.int64)
    start = np.concatenate([[0], end[:-1]]).astype(np.int64)
    return span_hash(raw, start, end) if len(words) else np.zeros(0, np.uint64)
