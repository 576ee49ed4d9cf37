"""Perplexity against a plain model, and bands that reject planted junk at both edges."""

import math
import random
from collections import Counter

import pytest

pytest.importorskip("tallyframe.llm.queries")
from tallyframe.llm import quality_rules  # noqa: E402

SHAPE = "doc_id long, text string, lang string, perplexity string, model string"


def prose(r, n):
    """Words of syllables, often the same few."""
    common = ["the", "of", "and", "to", "in", "was", "that"]
    syllable = ["ba", "ro", "ti", "len", "sho", "mar", "ke", "ul", "dis", "ver"]
    return " ".join(r.choice(common) if r.random() < 0.4 else "".join(r.choice(syllable) for _ in range(r.randint(1, 4))) for _ in range(n))


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, "clash", "clash") for i, t, lang in rows], SHAPE)


def test_both_edges_reject_junk(spark):
    r = random.Random(4)
    rows = [(i, prose(r, r.randint(60, 400)), "xx") for i in range(300)]
    rows += [(1000 + i, " ".join(w + "%%%" for w in prose(r, 200).split()), "xx") for i in range(10)]
    rows += [(2000 + i, " ".join("".join(r.choice("qzjxvwk0379") for _ in range(6)) for _ in range(120)), "xx") for i in range(10)]
    rows += [(3000 + i, " ".join(r.choice(["the", "of", "and", "to", "in", "was", "that"]) for _ in range(300)), "xx") for i in range(10)]
    rows += [(4000 + i, prose(r, 80) + " token = 9f8a7b6c5d4e3f2a1b0c9d8e7f6a5b4c 4929 1234 " + prose(r, 40), "xx") for i in range(20)]
    got = {r.doc_id: r for r in quality_rules.apply_rules(rows_of(spark, rows)).collect()}
    assert not any(x.base_failed for i, x in got.items() if i < 3000 or i >= 4000)
    high = [i for i, x in got.items() if not x.base_failed and not x.kept and x.perplexity > x.upper_band]
    low = [i for i, x in got.items() if not x.base_failed and not x.kept and x.perplexity < x.lower_band]
    assert set(high) == set(range(1000, 1010)) | set(range(2000, 2010))
    assert set(low) == {i for i in range(3000, 3010) if not got[i].base_failed} and low
    kept = {r.doc_id for r in quality_rules.keep(rows_of(spark, rows)).collect()}
    assert kept == {i for i, x in got.items() if x.kept}
    few = {r.doc_id: r for r in quality_rules.apply_rules(rows_of(spark, rows), model_rows=100).collect()}
    assert few == got


def brute(texts, other):
    """log10 probabilities of a plain modified Kneser-Ney trigram model of `texts`, of `other`'s characters."""
    tri = Counter(("\0\0" + t)[i : i + 3] for t in texts for i in range(len(t)))
    two, one = Counter(g[1:] for g in tri), None
    one = Counter(g[1:] for g in two)
    levels = {3: tri, 2: two, 1: one}

    def discounts(c):
        t = [sum(n == k for n in c.values()) for k in (1, 2, 3, 4)]
        y = t[0] / max(1, t[0] + 2 * t[1])
        return [max(0.05, min(i - 0.05, i - (i + 1) * y * t[i] / max(1, t[i - 1]))) if t[i - 1] and t[0] else i * 0.5 for i in (1, 2, 3)]

    off = {k: discounts(c) for k, c in levels.items()}

    def p(g):
        k = len(g)
        lower = p(g[1:]) if k > 1 else 1 / (len(one) + 1)
        of = {h: n for h, n in levels[k].items() if h[:-1] == g[:-1]}
        total = sum(of.values())
        if not total:
            return lower
        gamma = sum(off[k][min(n, 3) - 1] for n in of.values()) / total
        n = levels[k][g]
        return (max(0, (n - off[k][min(n, 3) - 1]) / total) if n else 0) + gamma * lower

    return [math.log10(p(("\0\0" + other)[i : i + 3])) for i in range(len(other))]


def test_perplexity_is_that_of_a_plain_model(spark):
    from pyspark.sql import functions as F

    r = random.Random(5)
    texts = [prose(r, r.randint(3, 14)) for _ in range(16)] + ["é ü new çharacters", "one"]
    df = rows_of(spark, [(i, t, None) for i, t in enumerate(texts)])
    half = {r.doc_id: r.h for r in df.select("doc_id", F.pmod(F.xxhash64("text"), F.lit(2)).alias("h")).collect()}
    for got in quality_rules.apply_rules(df).collect():
        own = texts[got.doc_id]
        logs = brute([t for i, t in enumerate(texts) if half[i] != half[got.doc_id]], own)
        words, at = [], 0
        for w in own.split(" "):
            words.append(-sum(logs[at : at + len(w) + 1]) / len(logs[at : at + len(w) + 1]))
            at += len(w) + 1
        words.sort()
        cut = len(words) // 4
        middle = words[cut : len(words) - cut]
        assert got.perplexity == pytest.approx(sum(middle) / len(middle), abs=1e-4)


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "", "xx"), (3, "   ", "xx"), (4, "a lonely language of its own with more than ten words here", "zz"), (4, "a lonely language of its own with more than ten words here", "zz"), (None, "x", "y/z"), (6, "long " * 30000, "xx")]
    got = sorted(quality_rules.apply_rules(rows_of(spark, rows)).collect(), key=lambda r: str(r.doc_id))
    assert [(r.doc_id, r.n_words, r.base_failed, r.kept) for r in got] == [(1, 0, True, False), (2, 0, True, False), (3, 0, True, False), (4, 12, False, True), (4, 12, False, True), (6, 30000, True, False), (None, 1, True, False)]
    assert quality_rules.keep(rows_of(spark, rows)).columns == ["doc_id", "text", "lang", "perplexity", "model"]
    assert quality_rules.keep(rows_of(spark, [])).count() == 0
