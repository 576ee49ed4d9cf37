"""Packing against the tokenizer, and its shards against BM25 over the whole table."""

import zlib

import numpy as np
import pytest

pytest.importorskip("tallyframe.llm.queries")
from tallyframe.llm import packing  # noqa: E402

ODD = [None, "", "  lead  trail ", "It's we'll rock' n' ÀÉ. Ñ,, a<|endoftext|> <| no", "ΑΣ σ İstanbul ﬁ 12a3 a1 -- --x 'tis 'S a'S \x00 nul\x1cx é É́", "Straße! (paren) [x] {y} ~~ a~ ~a ×÷a", "same", "same", "word " * 9000]


@pytest.fixture(scope="module")
def pieces(spark):
    rows = [(i if t != "same" else 70, t, "clash", 5) for i, t in enumerate(ODD)] + [(None, "no id", "x", 1)]
    return rows, packing.pack(spark.createDataFrame(rows, "doc_id long, text string, ids string, n_ids int")).collect()


def test_ids_are_the_tokenizers(pieces):
    from tokenizers import Tokenizer

    rows, got = pieces
    whole = Tokenizer.from_file(packing.default_vocabulary())
    for doc_id in {r[0] for r in rows}:
        own = sorted(t or "" for i, t, *_ in rows if i == doc_id)
        want = sorted(tuple(whole.encode(t, add_special_tokens=False).ids) + (1,) for t in own)
        mine = sorted((r for r in got if r.doc_id == doc_id), key=lambda r: r.start)
        assert sum(r.length for r in mine) == sum(map(len, want)) and all(len(r.ids) == 4 * r.length for r in mine)
        if len(own) == 1:
            assert tuple(np.frombuffer(b"".join(r.ids for r in mine), "<u4")) == want[0]
            assert all(r.doc_tokens == len(want[0]) for r in mine)
    assert zlib.crc32(b"") == 0


def test_sequences_have_no_gaps(pieces):
    by = {}
    for r in pieces[1]:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at <= 2048 and (at == 2048 or at & (at - 1) == 0)


def test_same_rows_in_any_order_give_the_same_pieces(spark):
    rows = [(i, " ".join(f"w{(i * 7 + j * j) % 300}" for j in range(150))) for i in range(200)]
    cut = lambda r, parts: sorted(map(tuple, packing.pack(spark.createDataFrame(r, "doc_id long, text string").repartition(parts)).collect()))
    assert cut(rows, 1) == cut(rows[::-1], 3)


def topics(n_topics: int, per_topic: int, seed: int = 3) -> list[tuple[int, str]]:
    """Documents of topics: each has common words, words of its topic, and a few of its own."""
    rng, rows = np.random.default_rng(seed), []
    for i in range(n_topics * per_topic):
        words = [f"common{chr(97 + w)}" for w in rng.integers(0, 20, 60)] + [f"topic{chr(97 + i % n_topics % 26)}{chr(97 + i % n_topics // 26)}{chr(97 + w)}" for w in rng.integers(0, 12, 80)]
        words += [f"own{chr(97 + a)}{chr(97 + b)}{chr(97 + c)}" for a, b, c in rng.integers(0, 26, (10, 3))]
        rows.append((i, " ".join(rng.permutation(words))))
    return [rows[i] for i in rng.permutation(len(rows))]


def best_neighbours(texts: list[str], k1: float = 1.2, b: float = 0.75) -> np.ndarray:
    """Of every text the BM25 neighbour of highest score in the whole table, by brute force."""
    encoder = packing._Encoder(packing.default_vocabulary())
    import pyarrow as pa

    ids = encoder.encode(pa.array(texts))[0]
    tf = np.zeros((len(texts), encoder.size), np.float32)
    for i, x in enumerate(ids):
        np.add.at(tf[i], x, 1)
    df, length = (tf > 0).sum(axis=0), np.array([len(x) + 1 for x in ids])
    idf = np.where(2 * df <= len(texts), np.log(1 + (len(texts) - df + 0.5) / (df + 0.5)), 0)
    weight = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[:, None] / length.mean()))
    scores = (tf > 0).astype(np.float32) @ weight.T
    np.fill_diagonal(scores, -1)
    return scores.argmax(axis=1)


def test_shards_hold_the_best_neighbours(spark):
    rows = topics(60, 20)
    best = best_neighbours([t for _, t in rows])
    # shards of a tenth of the table
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    shard = {r.doc_id: r.shard for r in packing.shards(df, shard_ids=60_000).collect()}
    assert len(set(shard.values())) >= 8
    recall = np.mean([shard[rows[i][0]] == shard[rows[j][0]] for i, j in enumerate(best)])
    print("recall", recall, len(set(shard.values())))
    assert recall >= 0.9
