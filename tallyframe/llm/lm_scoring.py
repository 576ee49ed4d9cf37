"""LM scoring with sharded Elias-Fano n-gram tries.

The model is a trigram model: absolute discounting with exact back-off weights over a bigram model, which is
interpolated with a discounted unigram one, whose freed mass is spread evenly over all distinct words of the table,
learnt from or not, and one more for any other word. Its tries are dealt over shards by a hash of the first word
(common words over four shards each, by the second), so neither building nor asking needs the model in one place.
Texts stay where they are read: a chunk of documents sends each shard its distinct n-grams with their training counts,
the shard adds them up, builds its trie in memory-mapped levels and answers each chunk's questions by successor search
relative to the context, and the chunk sums up its documents' scores. So the exchanges carry distinct n-grams of
chunks, and what they carry grows with the corpus.

A level's sorted numbers, and the pointers from a context to its successors, are Elias-Fano coded: low bits packed, high
bits as a unary bit vector. The trigram level's payloads are quantised discounted probabilities, its contexts' are
quantised back-off weights. The bigram level's are quantised counts, interpolated with a fixed weight where they are
asked for, because the successors of a common word lie in several shards. Levels are mapped from files without a name,
which a worker builds and uses within one task.

Defined results: null or empty text is the end token alone; a null id's text is empty for the split; repeated
rows keep their rows; other columns of the input are ignored; an empty table gives no rows; without training
tokens every token is unknown. Scores are log10 probabilities: after each context the words' add up to at most one.
The table is read twice and must give its rows in the same order; else the query raises an error.
"""

from __future__ import annotations

import math
import pickle
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_WORDS_LOWER, Words, chunks, read, release_memory

#: Text whose distinct n-grams are asked for at once, text whose n-grams make a shard, and weight of the bigram part.
CHUNK_TEXT, SHARD_TEXT, WEIGHT = 8 << 20, 16 << 20, 0.3
#: Steps of a payload per decade: of bigrams' counts, and of trigrams' probabilities and back-off weights.
STEPS, FINE_STEPS = 4096, 32
_END = np.uint64(0x5BD1E995A7C3F1)
_SPREAD = 4


def _squeeze(*parts) -> bytes:
    """Arrays packed with the bytes of equal rank together, which compresses."""
    out = [(a.dtype.str, a.view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b"") for a in map(np.ascontiguousarray, parts)]
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(out))


def _expand(blob: bytes) -> list[np.ndarray]:
    out = []
    for kind, data in pickle.loads(zstandard.ZstdDecompressor().decompress(blob)):
        width = np.dtype(kind).itemsize
        out.append(np.frombuffer(np.frombuffer(data, np.uint8).reshape(width, -1).T.tobytes(), kind))
    return out


class EliasFano:
    """Sorted numbers below `universe`, in a memory-mapped file without a name."""

    def __init__(self, values: np.ndarray, universe: int):
        self.n = len(values)
        self.low_bits = max(0, min(56, int(math.floor(math.log2(max(1, universe) / max(1, self.n))))))
        b = self.low_bits
        low = (values[:, None] >> np.arange(b, dtype=np.uint64)) & np.uint64(1) if b and self.n <= 4096 else None
        if low is not None:
            packed = np.packbits(low.astype(np.uint8).ravel(), bitorder="little")
        else:
            packed = np.concatenate([np.packbits(((values[i : i + 65536, None] >> np.arange(b, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little") for i in range(0, self.n, 65536)]) if b and self.n else np.zeros(0, np.uint8)
        high = (values >> np.uint64(b)).astype(np.int64)
        bits = np.zeros(self.n + (int(high[-1]) if self.n else 0) + 2, np.uint8)
        bits[high + np.arange(self.n)] = 1
        self.low, self.high = _mapped(np.concatenate([packed, np.zeros(8, np.uint8)])), _mapped(np.packbits(bits, bitorder="little"))
        # select directory: how many numbers lie before each bucket's end
        zeros = np.flatnonzero(bits == 0)
        self.upto = (zeros - np.arange(len(zeros))).astype(np.int32)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The i-th numbers: the place of the i-th set bit gives the high part."""
        if not hasattr(self, "ones"):
            whole = np.zeros(-(-len(self.high) // 8) * 8, np.uint8)
            whole[: len(self.high)] = self.high
            self.units = _mapped(whole).view("<u8")
            self.ones = np.concatenate([[0], np.cumsum(np.bitwise_count(self.units))]).astype(np.int32)
        unit = np.searchsorted(self.ones, i, "right") - 1
        left, rest, at = i - self.ones[unit], self.units[unit], np.zeros(len(i), np.int64)
        for half in (32, 16, 8, 4, 2, 1):
            held = np.bitwise_count(rest & np.uint64((1 << half) - 1)).astype(np.int64)
            later = left >= held
            left = np.where(later, left - held, left)
            rest = np.where(later, rest >> np.uint64(half), rest)
            at += np.where(later, half, 0)
        high = (unit * 64 + at - i).astype(np.uint64)
        return ((high << np.uint64(self.low_bits)) | self.lows(i)).astype(np.int64)

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i * self.low_bits
        words = np.ndarray(shape=(len(self.low) - 7,), dtype="<u8", buffer=self.low, strides=(1,))
        return (words[at >> 3] >> (at & 7).astype(np.uint64)) & np.uint64((1 << self.low_bits) - 1)

    def find(self, wanted: np.ndarray, begin: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """Places of the wanted numbers, within [begin, end) where given; -1 for those that are not there."""
        if not self.n or not len(wanted):
            return np.full(len(wanted), -1, np.int64)
        bucket = (wanted >> np.uint64(self.low_bits)).astype(np.int64)
        there = bucket < len(self.upto)
        bucket = np.where(there, bucket, 0)
        lo = np.where(bucket > 0, self.upto[np.maximum(bucket - 1, 0)], 0).astype(np.int64)
        hi = np.where(there, self.upto[bucket], 0).astype(np.int64)
        if begin is not None:
            lo, hi = np.maximum(lo, begin), np.minimum(hi, end)
        hi_all, target = hi.copy(), wanted & np.uint64((1 << self.low_bits) - 1)
        while len(left := np.flatnonzero(lo < hi)):
            mid = (lo[left] + hi[left]) >> 1
            less = self.lows(mid) < target[left]
            lo[left] = np.where(less, mid + 1, lo[left])
            hi[left] = np.where(less, hi[left], mid)
        ok = there & (lo < hi_all)
        ok[ok] = self.lows(lo[ok]) == target[ok]
        return np.where(ok, lo, -1)


def _mapped(data: np.ndarray) -> np.ndarray:
    with tempfile.TemporaryFile() as f:
        f.write(data.tobytes())
        f.flush()
        return np.memmap(f, dtype=data.dtype, mode="r", shape=data.shape) if len(data) else data


class Trie:
    """Words with counts; contexts; their successors (bigrams); and theirs (trigrams), each level found by pointers of the one before."""

    def __init__(self, words, counts, contexts, successors, pair_counts, prefix, thirds, triple_counts):
        """contexts, successors, pair_counts: a row for each counted bigram, repeated ones too; prefix, thirds, triple_counts: of each counted trigram the row of its bigram."""
        self.words, self.counts = EliasFano(words, 1 << 56), _mapped(counts.astype(np.uint32))
        names, rank = np.unique(contexts, return_inverse=True)
        self.contexts = EliasFano(names, 1 << 40)
        kinds, pair = np.unique((rank.astype(np.uint64) << np.uint64(32)) | successors, return_inverse=True)
        total = np.bincount(pair, pair_counts, len(kinds))
        self.pairs = EliasFano(kinds, max(1, len(names)) << 32)
        self.to_pairs = _pointers(kinds, len(names))
        self.weights = _mapped(np.floor(np.log10(np.maximum(total, 1)) * STEPS).astype(np.uint16) + np.uint16(1))
        triples, back = np.unique((pair[prefix].astype(np.uint64) << np.uint64(32)) | thirds, return_inverse=True)
        times = np.bincount(back, triple_counts, len(triples))
        self.triples = EliasFano(triples, max(1, len(kinds)) << 32)
        self.to_triples = _pointers(triples, len(kinds))
        of = (triples >> np.uint64(32)).astype(np.int64)
        whole, followers = np.bincount(of, times, len(kinds)), np.bincount(of, minlength=len(kinds))
        ones, twos = int((times == 1).sum()), int((times == 2).sum())
        off = ones / (ones + 2 * twos) if ones and twos else 0.5
        self.shares = _mapped(_quantised((times - off) / whole[of]))
        self.backs = _mapped(np.where(whole > 0, _quantised(off * followers / np.maximum(whole, 1)), 0).astype(np.uint8))

    def count(self, words: np.ndarray) -> np.ndarray:
        at = self.words.find(words)
        return np.where(at >= 0, self.counts[np.maximum(at, 0)] if self.words.n else 0, 0)

    def ask(self, contexts: np.ndarray, per: np.ndarray, successors: np.ndarray, per3: np.ndarray, thirds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of bigrams, `per` of them for each context, quantised counts and back-off weights; of trigrams, `per3` for each bigram, quantised probabilities; 0 for unseen ones."""
        weight, back, share = np.zeros(len(successors), np.uint16), np.zeros(len(successors), np.uint8), np.zeros(len(thirds), np.uint8)
        pair = self._below(self.pairs, self.to_pairs, np.repeat(self.contexts.find(contexts), per), successors)
        seen = pair >= 0
        weight[seen], back[seen] = self.weights[pair[seen]], self.backs[pair[seen]]
        triple = self._below(self.triples, self.to_triples, np.repeat(pair, per3), thirds)
        share[triple >= 0] = self.shares[triple[triple >= 0]]
        return weight, back, share

    @staticmethod
    def _below(level: EliasFano, pointers: EliasFano, parent: np.ndarray, child: np.ndarray) -> np.ndarray:
        """Places of children among their parents' successors; -1 where there is no parent or no such child."""
        out = np.full(len(child), -1, np.int64)
        known = np.flatnonzero(parent >= 0)
        if len(known):
            up = parent[known]
            out[known] = level.find((up.astype(np.uint64) << np.uint64(32)) | child[known], pointers.get(up), pointers.get(up + 1))
        return out


def _pointers(keys: np.ndarray, parents: int) -> EliasFano:
    """Where each parent's successors begin, and the end."""
    at = np.searchsorted(keys, np.arange(parents + 1, dtype=np.uint64) << np.uint64(32)).astype(np.uint64)
    return EliasFano(at, len(keys) + 1)


def _quantised(p: np.ndarray) -> np.ndarray:
    """Probabilities as one byte, rounded down: 1 is 1, each step FINE_STEPS-th of a decade less; below the last step the last."""
    return np.minimum(np.ceil(-np.log10(np.clip(p, 1e-30, 1)) * FINE_STEPS) + 1, 255).astype(np.uint8)


def _restored(q: np.ndarray) -> np.ndarray:
    return 10 ** ((1 - q.astype(float)) / FINE_STEPS)


class _Chunk:
    """A chunk's tokens as numbers of its sorted distinct words, and its distinct bigrams and trigrams."""

    def __init__(self, texts: pa.Array):
        hashes, sizes = [], []
        for _, _, raw, at in chunks(texts):
            w = Words(raw, at, SPACE_WORDS_LOWER)
            rows = np.concatenate([w.row, np.arange(w.n_rows)])
            order = np.argsort(rows, kind="stable")
            hashes.append(np.concatenate([w.hash >> np.uint64(8), np.full(w.n_rows, _END)])[order])
            sizes.append(w.count + 1)
        self.sizes = np.concatenate(sizes).astype(np.int64)
        self.words, ids = np.unique(np.concatenate([*hashes, [_END]]), return_inverse=True)
        self.ids = ids[:-1].astype(np.int64)
        self.check = int(self.words.sum(dtype=np.uint64) ^ np.uint64(len(self.ids))) & ((1 << 62) - 1)

    @staticmethod
    def grams(ids: np.ndarray, sizes: np.ndarray, end_id: int, n: int):
        """Distinct bigrams and each token's; distinct trigrams (bigram before, word) and each later token's; which tokens are a text's first."""
        first = np.cumsum(sizes) - sizes
        before = np.empty_like(ids)
        before[1:] = ids[:-1]
        before[first] = end_id
        pairs, pair = np.unique(before * n + ids, return_inverse=True)
        later = np.ones(len(ids), bool)
        later[first] = False
        triples, triple = np.unique(pair[np.flatnonzero(later) - 1] * n + ids[later], return_inverse=True)
        return pairs, pair, triples, triple, later


def _shard_of(kind: np.ndarray, before: np.ndarray, after: np.ndarray, shards: int) -> np.ndarray:
    return (kind[before].astype(np.int64) + 7919 * (kind[after].astype(np.int64) % _SPREAD)) % shards


class _Dealt:
    """How a chunk's words, bigrams and trigrams lie in the requests to the shards; the same when answers come back."""

    def __init__(self, pairs: np.ndarray, triples: np.ndarray, kind: np.ndarray, shards: int):
        n = len(kind)
        self.before, self.after = pairs // n, pairs % n
        shard = _shard_of(kind, self.before, self.after, shards)
        self.word_shard = kind % shards
        order = np.argsort(shard, kind="stable")
        self.pairs = np.split(order, np.searchsorted(shard[order], np.arange(1, shards)))
        # a bigram's trigrams follow each other
        self.prefix, self.third = triples // n, triples % n
        of = shard[self.prefix]
        order = np.argsort(of, kind="stable")
        self.triples = np.split(order, np.searchsorted(of[order], np.arange(1, shards)))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, int, int]]:
    """Chunks under numbers that come from the number of the table's partition."""
    n = 0
    for batch in batches:
        for lo, hi, _, _ in chunks(batch.column(1), CHUNK_TEXT):
            yield (batch.column(3)[0].as_py() << 24) + n, batch, lo, hi
            n += 1


_STATE = ["dest", "chunk", "blob", "verify", "doc_ids"]


def _ask(shards: int, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        for chunk, batch, lo, hi in _numbered(batches):
            c = _Chunk(batch.column(1).slice(lo, hi - lo))
            train = np.repeat(~batch.column(2).slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(bool), c.sizes)
            n = len(c.words)
            pairs, pair, triples, triple, later = c.grams(c.ids, c.sizes, int(np.searchsorted(c.words, _END)), n)
            counts = np.bincount(c.ids[train], minlength=n)
            pair_counts, triple_counts = np.bincount(pair[train], minlength=len(pairs)), np.bincount(triple[train[later]], minlength=len(triples))
            kind = (c.words & np.uint64(0xFFFF)).astype(np.uint16)
            dealt = _Dealt(pairs, triples, kind, shards)
            short, blobs = (c.words >> np.uint64(24)).astype(np.uint32), []
            per_pair = np.bincount(dealt.prefix, minlength=len(pairs))
            for s in range(shards):
                own, mine, tri = dealt.word_shard == s, dealt.pairs[s], dealt.triples[s]
                contexts, per = np.unique(dealt.before[mine], return_counts=True)
                blobs.append(_squeeze(
                    np.diff(c.words[own], prepend=np.uint64(0)), counts[own].astype(np.uint32), np.diff(c.words[contexts] >> np.uint64(16), prepend=np.uint64(0)), per.astype(np.uint32), short[dealt.after[mine]], pair_counts[mine].astype(np.uint32),
                    per_pair[mine].astype(np.uint32), short[dealt.third[tri]], triple_counts[tri].astype(np.uint32),
                ))
            doc_ids = pa.nulls(shards, pa.list_(id_type))
            yield pa.RecordBatch.from_arrays([pa.array(range(shards), pa.int32()), pa.array([chunk] * shards), pa.array(blobs, pa.binary()), pa.array([c.check] * shards), doc_ids], names=_STATE)

    return run


def _keep(id_type: pa.DataType):
    """What a chunk needs to sum up its answers: read and numbered once more, so that it is sent once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        for chunk, batch, lo, hi in _numbered(batches):
            c = _Chunk(batch.column(1).slice(lo, hi - lo))
            held = batch.column(2).slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(np.uint8)
            kind = (c.words & np.uint64(0xFFFF)).astype(np.uint16)
            state = _squeeze(c.ids.astype(np.uint32), kind, c.sizes.astype(np.uint32), np.array([np.searchsorted(c.words, _END)]), held)
            doc_ids = pa.array([batch.column(0).slice(lo, hi - lo).to_pylist()], pa.list_(id_type))
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([chunk]), pa.array([state], pa.binary()), pa.array([c.check]), doc_ids], names=_STATE)

    return run


def _answer(group: pa.Table) -> pa.Table:
    """A shard's group: build the trie of all its requests and answer each."""
    requests = []
    for blob in group.column("blob"):
        words, counts, contexts, *rest = _expand(blob.as_py())
        requests.append((np.cumsum(words, dtype=np.uint64), counts, np.cumsum(contexts, dtype=np.uint64), *rest))
    words, inverse = np.unique(np.concatenate([r[0] for r in requests]), return_inverse=True)
    counts = np.bincount(inverse, np.concatenate([r[1] for r in requests]), len(words)).astype(np.int64)
    known = counts > 0
    pair_counts, per3, triple_counts = (np.concatenate([r[i] for r in requests]) for i in (5, 6, 8))
    seen, times = pair_counts > 0, triple_counts > 0
    contexts = np.concatenate([np.repeat(r[2], r[3]) for r in requests])[seen]
    successors = np.concatenate([r[4] for r in requests])[seen].astype(np.uint64)
    row = np.cumsum(seen) - 1  # a counted trigram's bigram is counted
    prefix = row[np.repeat(np.arange(len(seen)), per3)[times]]
    thirds = np.concatenate([r[7] for r in requests])[times].astype(np.uint64)
    trie = Trie(words[known], counts[known], contexts, successors, pair_counts[seen], prefix, thirds, triple_counts[times])
    own = counts[known]
    stats = np.array([own.sum(), len(own), (own == 1).sum(), (own == 2).sum(), len(words)], np.int64)
    del contexts, successors, seen, inverse, row, prefix, thirds, times, pair_counts, per3, triple_counts
    blobs = [_squeeze(trie.count(r[0]).astype(np.uint32), *trie.ask(r[2], r[3], r[4].astype(np.uint64), r[6], r[7].astype(np.uint64)), stats) for r in requests]
    return pa.table([group.column("dest"), group.column("chunk"), pa.array(blobs, pa.binary()), group.column("verify"), group.column("doc_ids")], names=_STATE)


def _sum_up(shards: int, weight: float):
    def run(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("dest").to_numpy(), kind="stable").tolist()
        blob, doc_ids = group.column("blob"), group.column("doc_ids")[order[0]]
        if len(order) != shards + 1 or len(set(group.column("verify").to_pylist())) != 1:
            raise ValueError("the table gave other rows, or rows in another order, when it was read again; write it first")
        ids, kind, sizes, (end_id,), held = _expand(blob[order[0]].as_py())
        ids, sizes, n = ids.astype(np.int64), sizes.astype(np.int64), len(kind)
        pairs, pair, triples, triple, later = _Chunk.grams(ids, sizes, int(end_id), n)
        dealt = _Dealt(pairs, triples, kind, shards)
        count, quantised, back, share, stats = np.zeros(n), np.zeros(len(pairs), np.uint16), np.zeros(len(pairs), np.uint8), np.zeros(len(triples), np.uint8), np.zeros(5)
        for s, i in enumerate(order[1:]):
            c, q, b, t, st = _expand(blob[i].as_py())
            count[dealt.word_shard == s] = c
            quantised[dealt.pairs[s]], back[dealt.pairs[s]], share[dealt.triples[s]] = q, b, t
            stats += st
        total, kinds, ones, twos, vocabulary = (float(x) for x in stats)
        off = ones / (ones + 2 * twos) if ones and twos else 0.5
        even = (off * kinds / total if total else 1.0) / (vocabulary + 1)
        single = np.maximum(count - off, 0) / max(total, 1) + even
        context = count[dealt.before]
        seen = np.where(quantised > 0, 10 ** ((quantised.astype(float) - 1) / STEPS) / np.maximum(context, 1), 0.0)
        p2 = np.where(context > 0, weight * np.minimum(seen, 1) + (1 - weight) * single[dealt.after], single[dealt.after])
        p = p2[pair]
        # a later token: its trigram's share and, weighed by the context, its bigram's probability
        own = back[dealt.prefix[triple]]
        p[later] = np.where(own > 0, np.where(share[triple] > 0, _restored(share[triple]), 0) + _restored(own) * p[later], p[later])
        rows = np.repeat(np.arange(len(sizes)), sizes)
        by_row = lambda v: np.bincount(rows, v, len(sizes))
        base = np.log10((count + 1) / (total + kinds + 1))
        return pa.table(
            {
                "doc_id": doc_ids.values, "held_out": pa.array(held.astype(bool)), "n_tokens": pa.array(sizes), "n_known": pa.array(by_row(count[ids] > 0).astype(np.int64)),
                "train_tokens": pa.array(np.full(len(sizes), int(total))), "base_score": pa.array(by_row(base[ids])), "score": pa.array(by_row(np.log10(p))),
            }
        )

    return run


def score_texts(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None, weight: float = WEIGHT) -> DataFrame:
    """One row per input row: tokens, known tokens, base and model log10 probabilities.

    held_out: boolean column of rows to score but not to learn from. shards: parts of the model, by default one for
    each SHARD_TEXT bytes of text. weight: of the bigram part.
    """
    id_type = docs.schema[id_col].dataType
    name = id_type.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    if shards is None:
        size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col))), F.lit(0))).first()[0]
        shards = max(2 * docs.sparkSession.sparkContext.defaultParallelism, math.ceil(size / SHARD_TEXT))
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"), F.spark_partition_id().cast("long").alias("part"))
    shape = f"dest int, chunk long, blob binary, verify long, doc_ids array<{name}>"
    asked = given.mapInArrow(_ask(shards, to_arrow_type(id_type)), shape)
    answered = asked.groupBy("dest").applyInArrow(_answer, shape)
    kept = given.mapInArrow(_keep(to_arrow_type(id_type)), shape)
    return answered.unionByName(kept).groupBy("chunk").applyInArrow(_sum_up(shards, weight), f"doc_id {name}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    return score_texts(read(spark, sf_dir, "documents"), held).withColumn("score_per_token", F.col("score") / F.col("n_tokens"))
