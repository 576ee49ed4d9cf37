"""Classifier posteriors by hand and on held-out rows; identifiers that only learnt contexts show; spans of base patterns."""

import hashlib
import random
import re

import pytest

pytest.importorskip("tallyframe.llm.queries")
from pyspark.sql import functions as F  # noqa: E402

from tallyframe.llm import pii, quality_classifier  # noqa: E402


def prose(r, n):
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def classified(spark):
    r, rows, labels, truth = random.Random(6), [], [], {}
    rates = {"a": 0.95, "b": 0.9, "c": 0.1, "d": 0.05, None: 0.5}
    for i in range(600):
        host = r.choice(list(rates))
        truth[i] = int(r.random() < rates[host])
        # a weak sign: bad texts are shouted a little more often
        text = prose(r, 40) + (" !!" if r.random() < (0.25 if truth[i] else 0.45) else "")
        rows.append((i, text, r.choice(["en", "de"]), host, "clash"))
        if i % 5 < 2:
            labels.append((i, truth[i]))
    labels += [(0, truth[0]), (1, None), (None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, label string")
    got = quality_classifier.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    return got, {i: q for i, q in labels if i is not None and q is not None}, truth


def test_posteriors_help_on_rows_without_labels(classified):
    got, labels, truth = classified
    rest = [x for x in got if x.doc_id not in labels]
    hit = lambda of: sum((of(x) >= 0.5) == truth[x.doc_id] for x in rest) / len(rest)
    assert len(got) == 600 and hit(lambda x: x.score) > hit(lambda x: x.evidence) + 0.1 and hit(lambda x: x.score) > 0.75


def test_posteriors_by_hand(classified):
    got, labels, _ = classified
    value = {x.doc_id: labels.get(x.doc_id, x.evidence) for x in got}
    paths, hosts = {}, {}
    for x in got:
        for d, k in ((paths, (x.host, x.lang)), (hosts, x.host)):
            n, good = d.get(k, (0, 0.0))
            d[k] = (n + 1, good + value[x.doc_id])
    mean = sum(g for _, g in paths.values()) / sum(n for n, _ in paths.values())

    def strength(groups):  # (n, rate, target)
        total = sum(n for n, *_ in groups)
        between = sum(n * (r - t) ** 2 for n, r, t in groups) / total
        within = sum(t * (1 - t) for *_, t in groups) / len(groups)
        noise = sum(t * (1 - t) for *_, t in groups) / total
        return max(1.0, min(1e4, within / max(between - noise, 1e-6) - 1))

    k_host = strength([(n, g / n, mean) for n, g in hosts.values()])
    whole = {h: (k_host * mean + g) / (k_host + n) for h, (n, g) in hosts.items()}
    k_path = strength([(n, g / n, whole[h]) for (h, _), (n, g) in paths.items()])
    for x in got:
        n, g = hosts[x.host]
        host = (k_host * mean + g - value[x.doc_id]) / (k_host + n - 1)
        n, g = paths[x.host, x.lang]
        assert x.host_rate == pytest.approx(host) and x.path_rate == pytest.approx((k_path * host + g - value[x.doc_id]) / (k_path + n - 1))


def test_contexts_find_unseen_identifiers(spark):
    r, rows, planted = random.Random(7), [], {}
    for i in range(300):
        text = prose(r, 30)
        if i % 3 == 0:
            text += f" customer mail: c{i}@shop.example and " + prose(r, 5)
        elif i % 3 == 1:
            code = f"KX{r.randint(10**6, 10**7 - 1)}"
            planted[i] = (len(text) + len(" customer mail: "), code)
            text += f" customer mail: {code} and " + prose(r, 5)
        else:  # numbers that are no identifiers, behind words that often stand alone
            text += f" sold about {r.randint(10**5, 10**6)} of them and sold about as many more"
        rows.append((i, text))
    rows += [(1000, "sold about " * 40000 + "x@y.org"), (1001, None), (1002, ""), (1001, None)]
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string"), floor=0.1).select("doc_id", F.filter("spans", lambda s: s["rank"] == pii.ORDER.index("id")).alias("more")).collect()
    got = {(x.doc_id, s.start, s.end) for x in found for s in x.more}
    want = {(i, at, at + len(code)) for i, (at, code) in planted.items()}
    recall, precision = len(got & want) / len(want), len(got & want) / max(1, len(got))
    assert len(found) == len(rows) and recall >= 0.95 and precision >= 0.95


def test_base_spans(spark):
    texts = ["a@b.c", "x a.b+c@d-e.f.g, 1.2.3.4 and 256.1.1.1 1.2.3.4.5.6.7.8", "4111 1111 1111 1111 or 4111-1111-1111-1112, +1 (415) 555-0100.", "é 😀 me@ex.org", "+12 3", None, "@ @@ a@b", "0.0.0.0001 000.1.2.255", "card 4242424242424242 " * 3]

    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    def spans(t):
        out = []
        digits = lambda m: re.sub("[^0-9]", "", m)
        for k, p, ok in (
            ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
            ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
        ):
            out += [(m.start(), pii.ORDER.index(k), k, m.end()) for m in re.finditer(p, t or "") if ok(m[0])]
        return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    base = F.array_sort(F.concat(*[F.col(f"at_{k}") for k in list(pii.KINDS)[:4]]))
    got = {x.doc_id: x.s for x in pii.find(df).select("doc_id", pii._written(base).alias("s")).collect()}
    assert got == {i: spans(t) for i, t in enumerate(texts)}
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
