"""The sharded tries against plain dictionaries, and Elias-Fano sequences against lists."""

import math
import random
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("tallyframe.llm.queries")
from pyspark.sql import functions as F  # noqa: E402

from tallyframe.llm import lm_scoring  # noqa: E402


def test_elias_fano_gets_and_finds():
    rng = np.random.default_rng(1)
    for n, universe in ((0, 10), (1, 5), (7, 9), (5000, 1 << 40), (3000, 3000), (4000, 100)):
        values = np.sort(rng.integers(0, universe, n).astype(np.uint64))
        ef = lm_scoring.EliasFano(values, universe)
        if n:
            assert (ef.get(np.arange(n)) == values.astype(np.int64)).all()
        distinct = np.unique(values)
        ef = lm_scoring.EliasFano(distinct, universe)
        asked = np.concatenate([distinct, rng.integers(0, universe, 500).astype(np.uint64)])
        place = {int(v): i for i, v in enumerate(distinct)}
        assert ef.find(asked).tolist() == [place.get(int(v), -1) for v in asked]


def brute(texts, held):
    """p(word | two words before) of the same model, from dictionaries."""
    tokens = [[*(t or "").lower().split(), ""] for t in texts]
    train = [t for t, h in zip(tokens, held) if not h]
    one, two, three = Counter(), Counter(), Counter()
    for t in train:
        one.update(t)
        two.update(zip(["", *t], t))
        three.update(zip(["", *t], t, t[1:]))
    total, vocabulary = sum(one.values()), len({w for t in tokens for w in t})

    def discount(c):
        n1, n2 = (sum(n == k for n in c.values()) for k in (1, 2))
        return n1 / (n1 + 2 * n2) if n1 and n2 else 0.5

    off = discount(one)
    whole, kinds = Counter(), Counter()
    for (u, v, _), n in three.items():
        whole[u, v] += n
        kinds[u, v] += 1
    off3 = discount(three)

    def p(w, v, u=None):
        single = max(one[w] - off, 0) / max(total, 1) + (off * len(one) / total if total else 1) / (vocabulary + 1)
        pair = 0.3 * two[v, w] / one[v] + 0.7 * single if one[v] else single
        if u is None or not whole[u, v]:
            return pair
        return max(three[u, v, w] - off3, 0) / whole[u, v] + off3 * kinds[u, v] / whole[u, v] * pair

    return tokens, p


def test_scores_are_those_of_dictionaries(spark):
    r = random.Random(7)
    texts = [" ".join(r.choice("abcdefgh") * r.randint(1, 2) for _ in range(r.randint(0, 30))) for _ in range(120)] + [None, "", "new words only", "  A a\tB  "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = [i % 7 == 2 for i in range(len(texts))]
    tokens, p = brute(texts, held)
    # one shard, so that its discount is that of all trigrams
    for got in lm_scoring.score_texts(df, F.col("doc_id") % 7 == 2, shards=1).collect():
        t = tokens[got.doc_id]
        want = [math.log10(p(w, t[i - 1] if i else "", (t[i - 2] if i > 1 else "") if i else None)) for i, w in enumerate(t)]
        assert got.held_out == held[got.doc_id] and got.n_tokens == len(t)
        assert got.score <= sum(want) + 1e-6 and got.score == pytest.approx(sum(want), abs=0.04 * len(t))
    many = {x.doc_id: x for x in lm_scoring.score_texts(df.repartition(5), F.col("doc_id") % 7 == 2, shards=9).collect()}
    assert len(many) == len(texts) and all(many[i].n_tokens == len(t) for i, t in enumerate(tokens))


def test_probabilities_add_up_to_at_most_one(spark):
    _, p = brute(["a b c", "a b d a b c", "b a", "c"], [False] * 4)
    words = ["a", "b", "c", "d", ""]
    for u, v in (("", "a"), ("a", "b"), ("b", "c"), ("x", "y")):
        assert 0.5 < sum(p(w, v, u) for w in words) <= 1
    # the same of the operator: all texts that go on from "a b", over the probability of "a b"
    seen = ["a b c", "a b d a b c", "b a", "c"]
    asked = [f"a b {w}".strip() for w in (*"abcd", *(f"new{i}" for i in range(30)))]
    rows = [*enumerate(seen), *((100 + i, t) for i, t in enumerate(asked)), (999, "a b")]
    score = {r.doc_id: r.score for r in lm_scoring.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") >= 100, shards=3).collect()}
    assert all(-40 < s < 0 for s in score.values()) and score[102] > score[100]


def test_model_beats_base_and_prefers_repeated_texts(spark):
    r = random.Random(8)
    vocabulary = ["".join(r.choice("abcdefghijkl") for _ in range(5)) for _ in range(400)]
    texts = [" ".join(r.choice(vocabulary) for _ in range(40)) for _ in range(100)]
    rows = list(enumerate(texts)) + [(200 + i, t) for i, t in enumerate(texts[:10])] + [(300 + i, " ".join(r.choice(vocabulary) for _ in range(40))) for i in range(10)]
    got = {x.doc_id: x for x in lm_scoring.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") >= 200).collect()}
    assert min(got[200 + i].score for i in range(10)) > max(got[300 + i].score for i in range(10)) + 20
    assert sum(got[200 + i].score - got[200 + i].base_score for i in range(10)) > 0
