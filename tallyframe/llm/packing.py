"""Lexical retrieval packing.

Documents are tokenised and laid out by what they say: by the leaf of a tree of token vectors (fitted on a bounded
sample), then by the two least hashes of their longer words, so that documents of like words lie together wherever
they were read. Runs of this order form shards; each shard
has a BM25 inverted index over its documents' tokens, weighted by document frequencies of the whole corpus. A seed
document takes the unused documents that score highest for its tokens until its window is full; what does not fit
goes on as the next seed. The last, unfilled window of a partition is cut at powers of two, which need no padding.

The token ids are written once, in the shared folder, and then dealt by ranges of that order; equal places are split by
the rows' own ids, so a group of copies of any size fills as many partitions as it needs. Rows are sorted before they
are packed: a lost task packs the same rows in the same order again. `shards` tells which shard holds a document.

Defined results: null or empty text is the end id alone; repeated rows are packed each by itself; a null id
is kept; other columns of the input are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_column, chunks, read, release_memory, shared_folder, span_hash

WINDOW, END_ID = 2048, 1
#: Token ids in one BM25 shard, and in one partition of shards (of a small table: as many as keep all cores busy).
SHARD_IDS, PART_IDS = 1 << 19, 1 << 26
#: Text whose distinct words are looked up at once, and parts of words whose ids a worker keeps (about 25 bytes each).
ENCODE_BYTES, KEPT_WORDS = 4 << 20, 3_000_000
#: Documents (and first characters of each) that the order of documents is fitted on, and levels of its tree.
FIT_DOCS, FIT_CHARS, TREE_DEPTH = 2048, 8192, 8
#: Words of fewer bytes make a document's key only where it has no longer ones.
KEY_BYTES = 5

#: Kinds of bytes (1 letters, 2 marks, 0 others) and their lower-case forms; letters of two bytes are found apart.
_KIND = np.array([1 if chr(i).isascii() and chr(i).isalpha() else 2 if 32 < i < 127 and not chr(i).isdigit() else 0 for i in range(256)], np.int8)
_LOWER = np.array([i + 32 if 65 <= i <= 90 else i for i in range(256)], np.uint8)


class _Encoder:
    """Ids of white-space separated words.

    The vocabulary's pre-tokeniser never joins across white space, nor letters with marks that end a word; so a
    text's ids are those of its words, and a plain word's those of its lower-case letters and of its marks. Ids of
    letters, marks and other words are kept under 64-bit hashes until there are too many.
    Texts that might hold a special token's string are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.dtype = _id_type(self.size)
        self.ends = np.zeros(self.size, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self._forget()

    def _forget(self) -> None:
        self.keys, self.place, self.length = np.zeros(1, np.uint64), np.zeros(1, np.int32), np.zeros(1, np.int32)  # 0: no part
        self.flat, self.used = np.zeros(1 << 16, self.dtype), 0

    def _known(self, raw: np.ndarray, begin: np.ndarray, end: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each part's ids lie in `flat`, and how many they are; parts not kept are encoded."""
        hashes = np.where(end > begin, span_hash(raw, begin, end) | np.uint64(1), np.uint64(0))
        kinds, one, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) + len(kinds) > KEPT_WORDS:
            self._forget()
        at = np.minimum(np.searchsorted(self.keys, kinds), len(self.keys) - 1)
        new = np.flatnonzero(self.keys[at] != kinds)
        if len(new):
            plain = letters[one[new]]
            size = np.zeros(len(new), np.int32)
            place = np.zeros(len(new), np.int32)
            for own, encode in ((np.flatnonzero(plain), self._letters), (np.flatnonzero(~plain), self._singly)):
                if len(own):
                    ids, size[own] = encode(_strings(raw, begin[one[new[own]]], end[one[new[own]]]).to_pylist())
                    while self.used + len(ids) > len(self.flat):
                        self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), self.dtype)])
                    self.flat[self.used : self.used + len(ids)] = ids
                    place[own] = self.used + np.cumsum(size[own]) - size[own]
                    self.used += len(ids)
            spot = np.searchsorted(self.keys, kinds[new])
            self.keys, self.place, self.length = (np.insert(x, spot, y) for x, y in ((self.keys, kinds[new]), (self.place, place), (self.length, size)))
            at = np.searchsorted(self.keys, kinds)
        at = at[back]
        return self.place[at], self.length[at]

    def _singly(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.concatenate(ids), np.array([len(x) for x in ids], np.int32)

    def _letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words of letters alone, many to a string: a word's ids end with the first that ends a word."""
        joined = [" ".join(words[i : i + 4096]) for i in range(0, len(words), 4096)]
        ids = np.concatenate([np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)])
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words):
            raise ValueError("the vocabulary's word ends do not mark the ends of words")
        return ids, np.diff(ends, prepend=0).astype(np.int32)

    def _words(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in `flat` the ids of both parts of distinct words lie, and how many they are."""
        # plain words: Latin letters, then marks
        lead = np.flatnonzero(raw[:-1] == 0xC3)
        wide = lead[(raw[lead + 1] != 0x97) & (raw[lead + 1] != 0xB7)]  # but for two signs, all that 0xC3 leads are letters
        kind = _KIND[raw]
        kind[wide] = kind[wide + 1] = 1
        n_letters, n_marks = _counts(kind == 1, at), _counts(kind == 2, at)
        turned = np.zeros(len(raw), bool)  # letters after marks, inside words
        turned[1:] = (kind[1:] == 1) & (kind[:-1] == 2)
        first = at[:-1][at[:-1] < len(raw)]
        turned[first] = kind[first] == 2
        plain = (n_letters > 0) & (n_letters + n_marks == np.diff(at)) & (_counts(turned, at) == 0)
        low = raw.copy()
        lower = np.repeat(plain, np.diff(at))  # other words go to the tokenizer as they are
        low[lower] = _LOWER[raw[lower]]
        capital = wide[lower[wide] & (raw[wide + 1] < 0x9F)] + 1
        low[capital] += 0x20
        cut = at[:-1] + np.where(plain, n_letters, np.diff(at))
        # first the words' letters (or whole words), then their marks
        begin, size = self._known(low, np.concatenate([at[:-1], cut]), np.concatenate([cut, at[1:]]), np.concatenate([plain, np.zeros(len(plain), bool)]))
        return begin.reshape(2, -1).T, size.reshape(2, -1).T

    def encode(self, texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """The ids of each text, and its lexical keys."""
        lists = pc.ascii_split_whitespace(texts)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        offsets = offsets - offsets[0]
        raw, at = byte_column(coded.dictionary)
        first, second = _keys(raw, at, words, offsets)
        begin, size = self._words(raw, at)
        per_part = size[words].ravel()
        upto = np.concatenate([[0], np.cumsum(per_part)])
        every = self.flat[np.repeat(begin[words].ravel() - upto[:-1], per_part) + np.arange(upto[-1])]
        bounds = upto[2 * offsets]
        out = [every[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        special = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(special):
            out[i] = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, self.dtype)
        return out, first, second


def _counts(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    upto = np.zeros(len(flags) + 1, np.int32)
    np.cumsum(flags, out=upto[1:])
    return (upto[at[1:]] - upto[at[:-1]]).astype(np.int64)


def _strings(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """raw[begin:end] of many places as strings."""
    size = end - begin
    upto = np.concatenate([[0], np.cumsum(size)])
    held = raw[np.repeat(begin - upto[:-1], size) + np.arange(upto[-1])]
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(upto.astype(np.int32).tobytes()), pa.py_buffer(held.tobytes()))


def _keys(raw: np.ndarray, at: np.ndarray, words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and second least hash of each text's words; -1 for texts without words."""
    n = len(offsets) - 1
    first, second = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    if not len(words):
        return first, second
    hashes = (span_hash(raw, at[:-1], at[1:]) >> np.uint64(2)).astype(np.int64)
    hashes[np.diff(at) < KEY_BYTES] |= 1 << 62
    held = np.diff(offsets) > 0
    each, begin = hashes[words], offsets[:-1][held]
    first[held] = np.minimum.reduceat(each, begin)
    each[each == np.repeat(first[held], np.diff(offsets)[held])] = np.iinfo(np.int64).max
    second[held] = np.minimum.reduceat(each, begin)
    return first, second


class _Tree:
    """A tree of two-means splits of documents as weighted token vectors; near leaves hold documents of like tokens.

    Fitted on a bounded sample; it only lays the documents out, all of which are then indexed. Tokens are hashed to
    `dims` places. A node's row is the difference of its halves' centres.
    """

    def __init__(self, sample: list[np.ndarray], size: int, dims: int = 4096, depth: int = TREE_DEPTH, least: int = 16):
        self.place, self.depth = (np.arange(size, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(52)).astype(np.int32) % dims, depth
        self.planes = np.zeros((1 << depth, dims), np.float32)
        found = [np.unique(x, return_counts=True) for x in sample]
        df = np.bincount(np.concatenate([np.zeros(0, np.int64), *[t for t, _ in found]]).astype(np.int64), minlength=size)
        n = max(1, len(sample))
        self.idf = np.where(2 * df <= n, np.log((n + 1) / (df + 1)), 0).astype(np.float32)
        x = np.zeros((len(sample), dims), np.float32)
        for row, (tokens, tf) in zip(x, found):
            np.add.at(row, self.place[tokens], self.idf[tokens] * (1 + np.log(tf)))
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        nodes = [(1, np.arange(len(x)))]
        for node, rows in nodes:
            if len(rows) >= least and node < 1 << depth:
                right = self._split(x[rows])
                self.planes[node] = x[rows[right]].mean(axis=0) - x[rows[~right]].mean(axis=0) if right.any() and not right.all() else 0
                nodes += [(2 * node, rows[~right]), (2 * node + 1, rows[right])]

    @staticmethod
    def _split(x: np.ndarray, steps: int = 10) -> np.ndarray:
        """Which rows lie nearer to the second of two centres, which start at the row farthest from the mean and the one farthest from it."""
        a = x[np.argmin(x @ x.mean(axis=0))]
        b, right = x[np.argmin(x @ a)], np.zeros(len(x), bool)
        for _ in range(steps):
            now = x @ (b - a) > 0
            if (now == right).all() or now.all() or not now.any():
                break
            right = now
            a, b = (c / max(np.linalg.norm(c), 1e-9) for c in (x[~right].mean(axis=0), x[right].mean(axis=0)))
        return right

    def leaves(self, found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The leaf of each document, given as its distinct tokens and their counts."""
        node = np.ones(len(found), np.int64)
        size = np.array([len(t) for t, _ in found])
        if not size.sum():
            return node
        tokens, tf = (np.concatenate(x) for x in zip(*found))
        doc, place, weight = np.repeat(np.arange(len(found)), size), self.place[tokens], self.idf[tokens] * (1 + np.log(tf))
        for _ in range(self.depth):
            side = np.bincount(doc, self.planes[np.minimum(node, len(self.planes) - 1)[doc], place] * weight, len(found))
            node = 2 * node + (side > 0)
        return node


class _Bm25:
    """Inverted index: for each token the documents that hold it, with their BM25 weights; rarity is that of the whole corpus."""

    def __init__(self, ids: list[np.ndarray], idf: np.ndarray, mean: float, k1: float = 1.2, b: float = 0.75):
        self.n = len(ids)
        found = [np.unique(x, return_counts=True) for x in ids]
        self.doc_at = np.concatenate([[0], np.cumsum([len(t) for t, _ in found])])
        doc = np.repeat(np.arange(self.n), np.diff(self.doc_at))
        token = np.concatenate([t for t, _ in found])
        tf = np.concatenate([c for _, c in found]).astype(np.float32)
        length = np.array([len(x) for x in ids], np.float32)
        weight = idf[token] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[doc] / mean))
        order = np.argsort(token, kind="stable")
        self.doc, self.weight = doc[order], weight[order].astype(np.float32)
        first = np.flatnonzero(np.diff(token[order], prepend=-1))
        df = np.diff(np.append(first, len(order)))
        # of each document's tokens the postings, but for those that no other document here holds or that are common everywhere
        row = np.empty(len(order), np.int64)
        row[order] = np.repeat(np.arange(len(first)), df)
        self.begin, self.count = first[row], np.where(idf[token] > 0, df[row], 0)
        self.count[self.count == 1] = 0

    def scores(self, seed: int) -> np.ndarray:
        own = slice(self.doc_at[seed], self.doc_at[seed + 1])
        begin, count = self.begin[own], self.count[own]
        upto = np.cumsum(count)
        if not len(upto) or not upto[-1]:
            return np.zeros(self.n, np.float32)
        where = np.repeat(begin - upto + count, count) + np.arange(upto[-1])
        return np.bincount(self.doc[where], self.weight[where], self.n)


class _Packer:
    """Fills one window after another with pieces of documents."""

    def __init__(self, window: int, sequence: int):
        self.window, self.sequence, self.open, self.used = window, sequence, [], 0
        self.done: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray, start: int, total: int) -> int:
        """Put in what fits; returns how many ids that is."""
        n = min(len(ids), self.window - self.used)
        if n:
            self.done.append((doc_id, start, n, total, self.sequence, self.used, ids[:n]))
            self.used += n
            if self.used == self.window:
                self.sequence, self.used = self.sequence + 1, 0
        return n

    def take(self) -> list[tuple]:
        """Pieces of full windows; those of the open one stay."""
        out = [p for p in self.done if p[4] != self.sequence]
        self.done = [p for p in self.done if p[4] == self.sequence]
        return out

    def close(self) -> list[tuple]:
        """Cut the open window at powers of two."""
        out, left, size = [], self.used, 1 << max(0, self.used.bit_length() - 1)
        pieces = list(reversed(self.done))
        while left:
            while size > left:
                size >>= 1
            offset = 0
            while offset < size:
                doc_id, start, n, total, _, _, ids = pieces.pop()
                now = min(n, size - offset)
                out.append((doc_id, start, now, total, self.sequence, offset, ids[:now]))
                if now < n:
                    pieces.append((doc_id, start + now, n - now, total, 0, 0, ids[now:]))
                offset += now
            left -= size
            self.sequence += 1
        self.done, self.used = [], 0
        return out


def _batch(pieces: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset"]
    columns = list(zip(*pieces)) if pieces else [[]] * 7
    arrays = [pa.array(columns[0], id_type), *(pa.array(columns[i], pa.int64()) for i in range(1, 6))]
    arrays.append(pa.array([p[6].astype("<u4").tobytes() for p in pieces], pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, names=[*names, "ids"])


def fill(packer: _Packer, doc_ids: list, ids: list[np.ndarray], index: _Bm25) -> None:
    """Pack a shard's documents: seeds in order, each with the best unused neighbours of its words."""
    unused = np.ones(len(ids), bool)
    seed, low = 0, 0
    while seed is not None:
        unused[seed] = False
        at, total = 0, len(ids[seed])
        while at < total:
            at += packer.add(doc_ids[seed], ids[seed][at:], at, total)
        next_seed = None
        if packer.used and unused.any():
            scores = np.where(unused, index.scores(seed), -1.0)
            for d in _descending(scores):
                unused[d] = False
                at, size = 0, len(ids[d])
                while at < size:  # what the window does not take opens the next ones, with this document as seed
                    if at:
                        next_seed = d
                    at += packer.add(doc_ids[d], ids[d][at:], at, size)
                if next_seed is not None or not packer.used:
                    break
        if next_seed is not None and packer.used:
            ids[next_seed], seed = ids[next_seed][:0], next_seed
        else:
            while low < len(unused) and not unused[low]:
                low += 1
            seed = low if low < len(unused) else None


def _descending(scores: np.ndarray) -> Iterator[int]:
    """Positions of scores of 0 or more, best first, ties by position; the first few are found without a full sort."""
    few = min(32, len(scores))
    cut = np.partition(scores, len(scores) - few)[len(scores) - few]
    top = np.flatnonzero(scores > cut)
    top = top[np.argsort(-scores[top], kind="stable")]
    yield from top[scores[top] >= 0].tolist()
    rest = np.flatnonzero((scores <= cut) & (scores >= 0))
    yield from rest[np.argsort(-scores[rest], kind="stable")].tolist()


#: A worker's encoders, kept from task to task.
_encoders: dict[str, _Encoder] = {}
_ENCODED = "ids binary, n_ids int, leaf long, first long, second long, held array<struct<token:int,n:bigint>>"


def _id_type(size: int) -> np.dtype:
    return np.dtype("<u2" if size <= 1 << 16 else "<u4")


def _encoder(path: str) -> _Encoder:
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = _Encoder(path)
    return _encoders[path]


def _encode_sample(path: str):
    """(ids, size): the ids of each text, and how many tokens the vocabulary has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            encoder = _encoder(path)
            for lo, hi, _, _ in chunks(batch.column(0), ENCODE_BYTES):
                ids = encoder.encode(batch.column(0).slice(lo, hi - lo))[0]
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([encoder.size] * len(ids), pa.int32())], names=["ids", "size"])

    return run


def _encode(path: str, end_id: int, tree):
    """(doc_id, ids, n_ids, leaf, first, second) of each document; and in a task's last row how many documents hold each token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        encoder = _encoder(path)
        df, held_type = np.zeros(max(encoder.size, end_id + 1), np.int64), pa.list_(pa.struct([("token", pa.int32()), ("n", pa.int64())]))
        names, id_type = ["doc_id", "ids", "n_ids", "leaf", "first", "second", "held"], pa.int64()
        for batch in batches:
            id_type = batch.schema.field(0).type
            for lo, hi, raw, _ in chunks(batch.column(1), ENCODE_BYTES):
                del raw
                ids, first, second = encoder.encode(batch.column(1).slice(lo, hi - lo).fill_null(""))
                ids = [np.append(x, encoder.dtype.type(end_id)) for x in ids]
                found = [np.unique(x, return_counts=True) for x in ids]
                for tokens, _ in found:
                    df[tokens] += 1
                columns = [batch.column(0).slice(lo, hi - lo), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([len(x) for x in ids], pa.int32()), pa.array(tree.value.leaves(found)), pa.array(first), pa.array(second), pa.nulls(hi - lo, held_type)]
                yield pa.RecordBatch.from_arrays(columns, names=names)
        own = np.flatnonzero(df)
        held = pa.array([list(zip(own.tolist(), df[own].tolist()))], held_type)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, id_type), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int32()), *[pa.nulls(1, pa.int64())] * 3, held], names=names)

    return run


def _in_shards(batches: Iterator[pa.RecordBatch], dtype: str, shard_ids: int) -> Iterator[tuple[list, list[np.ndarray], pa.DataType]]:
    """Document ids and token ids of runs of at most `shard_ids` tokens, which end with a leaf once half full; a longer document stands alone."""
    names, ids, size, last, id_type = [], [], 0, None, pa.int64()
    for batch in batches:
        id_type = batch.schema.field(0).type
        for name, raw, leaf in zip(*(c.to_pylist() for c in batch.columns)):
            own = np.frombuffer(raw, dtype)
            if names and (size + len(own) > shard_ids or leaf != last and 2 * size >= shard_ids):
                yield names, ids, id_type
                names, ids, size = [], [], 0
            names.append(name)
            ids.append(own)
            size, last = size + len(own), leaf
    if names:
        yield names, ids, id_type


def _pack(statistics, dtype: str, window: int, shard_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        idf, mean = statistics.value
        packer, id_type = _Packer(window, TaskContext.get().partitionId() << 36), pa.int64()
        for names, ids, id_type in _in_shards(batches, dtype, shard_ids):
            fill(packer, names, ids, _Bm25(ids, idf, mean))
            yield _batch(packer.take(), id_type)
        yield _batch(packer.close(), id_type)

    return run


def _number(dtype: str, shard_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 36
        for names, _, id_type in _in_shards(batches, dtype, shard_ids):
            yield pa.RecordBatch.from_arrays([pa.array(names, id_type), pa.array([shard] * len(names), pa.int64())], names=["doc_id", "shard"])
            shard += 1

    return run


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Laid:
    """Encoded documents in the order of their keys, and the statistics of the corpus."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, vocabulary: str | None, end_id: int, part_ids: int):
        spark, path = docs.sparkSession, vocabulary or default_vocabulary()
        self.id_type = docs.schema[id_col].dataType.simpleString()
        given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
        share = min(1.0, FIT_DOCS / max(1, docs.count()))
        drawn = given.sample(share, seed=7).select(F.substring(F.coalesce(F.col("text").cast("string"), F.lit("")), 1, FIT_CHARS).alias("text"))
        # about FIT_DOCS rows; the first row's size tells how many tokens the vocabulary has
        drawn = drawn.mapInArrow(_encode_sample(path), "ids binary, size int").limit(2 * FIT_DOCS).toArrow()
        size = max([0, *drawn.column("size").to_pylist()])
        self.dtype, size = _id_type(size).str, max(size, end_id + 1)
        tree = spark.sparkContext.broadcast(_Tree([np.frombuffer(x, self.dtype) for x in drawn.column("ids").to_pylist()], size))  # 4096 numbers for each of its nodes
        folder = f"{shared_folder(spark)}/packing-{uuid.uuid4().hex}"
        given.mapInArrow(_encode(path, end_id, tree), f"doc_id {self.id_type}, {_ENCODED}").write.option("compression", "zstd").parquet(folder)
        written = spark.read.parquet(folder)
        n, total = written.where("ids IS NOT NULL").agg(F.count("*"), F.coalesce(F.sum("n_ids"), F.lit(0))).first()
        df = np.zeros(max(size, end_id + 1))
        # as many rows as the vocabulary has tokens
        for token, count in written.where("held IS NOT NULL").select(F.inline("held")).groupBy("token").agg(F.sum("n")).collect():
            df[token] = count
        idf = np.where(2 * df <= n, np.log(1 + (n - df + 0.5) / (df + 0.5)), 0.0).astype(np.float32)
        self.statistics = (idf, max(1.0, total / max(n, 1)))
        parts = max(math.ceil(total / part_ids), min(4 * spark.sparkContext.defaultParallelism, math.ceil(total / (4 * SHARD_IDS))), 1)
        order = ["leaf", "first", "second", "doc_id", "ids"]
        self.rows = written.where("ids IS NOT NULL").select("doc_id", "ids", "leaf", "first", "second").repartitionByRange(parts, *order[:4]).sortWithinPartitions(*order)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, window: int = WINDOW, end_id: int = END_ID, shard_ids: int = SHARD_IDS, part_ids: int = PART_IDS) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset and ids (little-endian uint32).

    vocabulary: path of a tokenizers file, the same on every machine. shard_ids: tokens in one BM25 shard.
    part_ids: tokens that one task packs, at most about.
    """
    laid = _Laid(docs, id_col, text_col, vocabulary, end_id, part_ids)
    schema = f"doc_id {laid.id_type}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    statistics = docs.sparkSession.sparkContext.broadcast(laid.statistics)  # a number for each token of the vocabulary
    return laid.rows.select("doc_id", "ids", "leaf").mapInArrow(_pack(statistics, laid.dtype, window, shard_ids), schema)


def shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = END_ID, shard_ids: int = SHARD_IDS, part_ids: int = PART_IDS) -> DataFrame:
    """(doc_id, shard): the index shard that `pack` would look for each document's neighbours in."""
    laid = _Laid(docs, id_col, text_col, vocabulary, end_id, part_ids)
    return laid.rows.select("doc_id", "ids", "leaf").mapInArrow(_number(laid.dtype, shard_ids), f"doc_id {laid.id_type}, shard long")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(read(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
