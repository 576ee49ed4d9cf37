"""Benchmark decontamination with a generalised suffix automaton.

The normalised test items form one automaton over words. Training text is streamed through it, the longest
matching length is tracked after every word, and the words of every window (13 item words, or a whole
shorter item) are marked. Only runs of words that occur in some item enter the automaton.

Defined results: null text has no words; an item without words is never found; a null item id is written as
an empty string; repeated rows keep their rows; other columns of the input are ignored by `find` and kept by
`decontaminate`; an empty benchmark marks nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM_WORDS, Words, chunks, read

WINDOW = 13


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences, with the items of each window."""

    def __init__(self, items: list[tuple[str, list[int]]], window: int):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, words in items:
            last = 0
            for word in words:
                last = self._extend(last, word)
        self.window_items: dict[int, set[str]] = {}
        self.short_items: dict[int, dict[int, set[str]]] = {}
        for name, words in items:
            state = 0
            for i, word in enumerate(words):
                state = self.next[state][word]
                if i + 1 >= window:
                    state = self._shortened(state, window)
                    self.window_items.setdefault(state, set()).add(name)
            if 0 < len(words) < window:
                self.short_items.setdefault(state, {}).setdefault(len(words), set()).add(name)
        self.chains: dict[int, tuple] = {}

    def _shortened(self, state: int, size: int) -> int:
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def _clone(self, p: int, q: int, word: int) -> int:
        copy = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, word: int) -> int:
        if (q := self.next[last].get(word)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, word)
        new = len(self.next)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, word)
        return new

    def chain(self, state: int) -> tuple:
        """What may end where `state` is reached: its window state's items, and (length, items) of short items."""
        if (known := self.chains.get(state)) is None:
            window = self.window_items.get(self._shortened(state, self.window)) if self.length[state] >= self.window else None
            short, at = [], state
            while at > 0:
                short += self.short_items.get(at, {}).items()
                at = self.link[at]
            self.chains[state] = known = (window, tuple(short))
        return known

    def run(self, words: list[int]):
        """(last word, window length, items) of every window found in a run of known words."""
        state, size = 0, 0
        nexts, link, length, window = self.next, self.link, self.length, self.window
        for i, word in enumerate(words):
            while state and word not in nexts[state]:
                state = link[state]
                size = length[state]
            if (to := nexts[state].get(word)) is None:
                state = size = 0
                continue
            state, size = to, size + 1
            found, short = self.chain(state)
            if size >= window and found:
                yield i, window, found
            for k, items in short:
                if k <= size:
                    yield i, k, items


def _find(shared, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, items, window = shared.value
        automaton = SuffixAutomaton(items, window)
        least = min([window, *(len(w) for _, w in items if w)])
        for batch in batches:
            for lo, hi, raw, at in chunks(batch.column(1)):
                n = hi - lo
                w = Words(raw, at, ALNUM_WORDS)
                spans: list[list] = [[] for _ in range(n)]
                found: list[set] = [set() for _ in range(n)]
                if len(vocabulary) and len(w.hash):
                    ids = np.minimum(np.searchsorted(vocabulary, w.hash), len(vocabulary) - 1)
                    known = vocabulary[ids] == w.hash
                    # runs of known words inside one row
                    edge = np.ones(len(known), bool)
                    edge[1:] = (known[1:] != known[:-1]) | (w.row[1:] != w.row[:-1])
                    begin = np.flatnonzero(edge)
                    end = np.concatenate([begin[1:], [len(known)]])
                    for b, e in zip(*(x[known[begin] & (end - begin >= least)].tolist() for x in (begin, end))):
                        row = w.row[b]
                        for i, k, names in automaton.run(ids[b:e].tolist()):
                            found[row] |= names
                            s, t = b + i - k + 1, b + i + 1
                            if spans[row] and spans[row][-1][1] >= s:
                                spans[row][-1][1] = t
                                while len(spans[row]) > 1 and spans[row][-2][1] >= min(s, spans[row][-1][0]):
                                    spans[row][-2][1] = t
                                    spans[row].pop()
                                spans[row][-1][0] = min(spans[row][-1][0], s)
                            else:
                                spans[row].append([s, t])
                out_spans, prior_spans, prior_items = [], batch.column(3).slice(lo, n).to_pylist(), batch.column(4).slice(lo, n).to_pylist()
                for r in range(n):
                    own = [{"first": s - int(w.first[r]), "last": t - 1 - int(w.first[r]), "from_byte": int(w.start[s] - at[r]), "to_byte": int(w.end[t - 1] - at[r])} for s, t in spans[r]]
                    out_spans.append(_merged(own + (prior_spans[r] or [])))
                    found[r] |= set(prior_items[r] or [])
                text = batch.column(1).slice(lo, n) if keep_text else pa.nulls(n, pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, n), text, batch.column(2).slice(lo, n), pa.array(out_spans, _SPANS), pa.array([sorted(x) for x in found], pa.list_(pa.string())), pa.array(w.count.astype(np.int64))],
                    names=["doc_id", "text", "rest", "spans", "items", "n_words"],
                )

    return run


_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("from_byte", pa.int64()), ("to_byte", pa.int64())]))


def _merged(spans: list[dict]) -> list[dict]:
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: (s["first"], s["last"])):
        if out and s["first"] <= out[-1]["last"] + 1 and s["first"] <= out[-1]["last"]:
            if s["last"] > out[-1]["last"]:
                out[-1] |= {"last": s["last"], "to_byte": s["to_byte"]}
        else:
            out.append(dict(s))
    return out


def _shards(benchmark: DataFrame, item_col: str, text_col: str, limit: int) -> Iterator[list[tuple[str, np.ndarray]]]:
    """The items' word hashes in groups of at most `limit` words, so that each automaton is bounded."""
    group, size = [], 0
    for row in benchmark.select(F.col(item_col).cast("string"), F.col(text_col).cast("string")).toLocalIterator():
        raw = np.frombuffer((row[1] or "").encode(), np.uint8)
        words = Words(raw, np.array([0, len(raw)]), ALNUM_WORDS).hash
        if group and size + len(words) > limit:
            yield group
            group, size = [], 0
        group.append((row[0] or "", words))
        size += len(words)
    yield group


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, shard_words: int = 1_000_000, keep: str | None = None, keep_text: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_words, merged hit spans (words and bytes) and the items found.

    shard_words: item words in one automaton; a larger benchmark is applied in several passes. keep: a
    column carried along as `rest`.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    rest_type = docs.schema[keep].dataType.simpleString() if keep else "int"
    spans = "array<struct<first:bigint,last:bigint,from_byte:bigint,to_byte:bigint>>"
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), (F.col(keep) if keep else F.lit(0)).alias("rest"), F.lit(None).cast(spans).alias("spans"), F.lit(None).cast("array<string>").alias("items"))
    groups = list(_shards(benchmark, item_col, item_text_col, shard_words))
    for i, group in enumerate(groups):
        vocabulary = np.unique(np.concatenate([h for _, h in group])) if group else np.zeros(0, np.uint64)
        items = [(name, np.searchsorted(vocabulary, h).tolist()) for name, h in group]
        shared = spark.sparkContext.broadcast((vocabulary, items, window))
        schema = f"doc_id {id_type}, text string, rest {rest_type}, spans {spans}, items array<string>, n_words long"
        out = out.select("doc_id", "text", "rest", "spans", "items").mapInArrow(_find(shared, keep_text or i < len(groups) - 1), schema)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    return out.withColumn("n_hit", n_hit)


def contaminated(min_share: int = 20):
    return (F.col("n_hit") > 0) & (min_share * F.col("n_hit") >= F.col("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_share: int = 20) -> DataFrame:
    """The input's columns: documents over the coverage limit go, and from the others the hit spans are cut."""
    packed = docs.withColumn("__row", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]))
    found = find(packed, benchmark, id_col, text_col, keep="__row", keep_text=True).where(~contaminated(min_share))
    raw = F.encode("text", "UTF-8")
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform("spans", lambda s: s["to_byte"]))
    ends = F.concat(F.transform("spans", lambda s: s["from_byte"]), F.array(F.octet_length("text").cast("long")))
    parts = F.zip_with(starts, ends, lambda a, b: F.decode(F.substring(raw, (a + 1).cast("int"), (b - a).cast("int")), "UTF-8"))
    text = F.when(F.size("spans") > 0, F.array_join(parts, "")).otherwise(F.col("text"))
    return found.select(*[(text if c == text_col else F.col(f"rest.`{c}`")).alias(c) for c in docs.columns])


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort("items"), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), contaminated().alias("contaminated"))
