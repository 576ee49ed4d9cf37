"""Small fixtures with nulls, empty and long texts, repeats and ties, against brute force."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

pytest.importorskip("tallyframe.llm.queries")
from tallyframe.llm import chat_format, decontaminate, html_extract, license_scan, lm_scoring, packing, pii, quality_classifier, quality_rules, simhash  # noqa: E402

SHAPE = "doc_id long, text string, lang string, source string, grams string"
LONG = " ".join(f"word{i % 97}x{i}" for i in range(9000))
TEXTS = [None, "", "   ", "one", "a b c d", "Released under the MIT License.", "x\x00y x\x01y", LONG, LONG + " tail", "same line\nsame line\nother", "the quick brown fox jumps over it " * 4, "mail a@b.org now", "ties ties ties ties"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 3 else None, "s", "g") for i, t in enumerate(TEXTS)] + [(3, "one", "en", None, "g"), (None, "no id", "en", "s", "g")]
    return spark.createDataFrame(rows, SHAPE)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_empty_tables(spark):
    none = spark.createDataFrame([], SHAPE)
    items = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    from pyspark.sql import functions as F

    assert license_scan.scan(none).count() == quality_rules.apply_rules(none).count() == simhash.components(none).count() == packing.pack(none).count() == 0
    assert decontaminate.find(none, items).count() == lm_scoring.score_texts(none, F.lit(False)).count() == pii.find(none).count() == quality_classifier.classify(none, labels).count() == 0
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_license(docs):
    got = license_scan.scan(docs).collect()
    assert len(got) == docs.count()
    r = next(r for r in got if r.doc_id == 5)
    assert (r.n_words, r.n_base, r.first_word, r.base_labels) == (5, 1, 3, "mit") and r.score > 0.9


def test_license_bodies(spark):
    from importlib.resources import files

    whole = {f.name.split(".")[0]: f.read_text("utf-8") for f in files("tallyframe.llm").joinpath("licenses").iterdir()}
    parts = {
        "mit": "some code\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "bsd": "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "gpl": "A compilation of a covered work with other separate and independent works, which are not by their nature extensions of the covered work, and which are not combined with it such as to form a larger program, in or on a volume of a storage or distribution medium, is called an \"aggregate\" if the compilation and its resulting copyright are not used to limit the access or legal rights of the compilation's users beyond what the individual works permit.",
    }
    rows = [(k, v) for k, v in [*whole.items(), *((f"{k} part", v) for k, v in parts.items()), ("none", "plain words of no license at all " * 5)]]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert {"apache", "gpl", "lgpl", "agpl", "mit", "isc", "bsd", "cc0", "mpl"} <= set(whole)
    for k in whole:
        assert k in got[k].labels.split(",") and got[k].score == 1
    assert {k: got[f"{k} part"].labels for k in parts} == {k: k for k in parts}
    assert got["none"].labels == "" and got["none"].score == 0


def test_quality_rules(docs):
    got = quality_rules.apply_rules(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id in (8, 9, 10):
            w = re.findall(r"[^\x20\x09-\x0D]+", TEXTS[r.doc_id])
            c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
            hit = {i + j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(5)}
            assert (r.n_words, r.n_repeat_words) == (len(w), len(hit))
    assert next(r for r in got if r.doc_id == 9).n_dup_lines == 1


def test_simhash(docs):
    got = simhash.components(docs).collect()
    prints = {}
    for i, t in enumerate(TEXTS):
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        h = [xxhash.xxh64_intdigest(" ".join(w[j : j + 4]).encode(), seed=42) for j in range(max(1, len(w) - 3))] if w else []
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    for r in got:
        if r.doc_id is not None:
            assert r.print & (2**64 - 1) == prints[r.doc_id]
    comp = {r.doc_id: r.component_id for r in got}
    assert comp[1] == comp[2] == comp[0] == 0 and comp[8] == 7


def test_simhash_dense_group(spark):
    rng = np.random.default_rng(1)
    base = int(rng.integers(1 << 62))
    values = sorted({base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 62, (900, 2)) if a != b} | {int(v) for v in rng.integers(0, 1 << 62, 300)})
    edges = simhash.links(spark.createDataFrame([(v,) for v in values], "print long"), 4, 256)
    roots = {r.node: r.root for r in simhash.connected(edges).collect()}
    a = np.array(values, dtype=np.uint64)
    near = np.bitwise_count(a[:, None] ^ a[None, :]) <= 4
    want = {}
    for i in range(len(values)):
        if i in want:
            continue
        todo = [i]
        want[i] = i
        while todo:
            for j in np.flatnonzero(near[todo.pop()]).tolist():
                if j not in want:
                    want[j] = i
                    todo.append(j)
    assert all(roots.get(v, v) == values[want[i]] for i, v in enumerate(values))


def test_decontaminate(spark):
    item = " ".join(f"w{i}" for i in range(20))
    items = spark.createDataFrame([(1, item), (2, "only three words"), (3, None), (4, "")], "item_id long, text string")
    rows = [(0, "x " + item + " y"), (1, " ".join(item.split()[:12])), (2, "has Only THREE words!"), (3, None), (4, " ".join(item.split()[2:15]) + " z" * 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_hit, r["items"]) for r in decontaminate.find(docs, items).collect()}
    assert got == {0: (20, ["1"]), 1: (0, []), 2: (3, ["2"]), 3: (0, []), 4: (13, ["1"])}
    kept = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, items).collect()}
    assert set(kept) == {1, 3, 4} and "w5" not in kept[4]
    several = {r.doc_id: (r.n_hit, r["items"]) for r in decontaminate.find(docs, items, shard_words=4).collect()}
    assert several == got


def test_pii(docs, spark):
    r = next(r for r in pii.find(docs).collect() if r.doc_id == 11)
    assert len(r.at_email) == 1 and r.at_email[0].start == 5
    rows = [(i, f"my member: {100000 + i * 7} and mail: u{i}@ex.org or mail: tag-{9000 + i} ok") for i in range(9)]
    out = pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).first().text
    assert out == "my member: 100000 and mail: [EMAIL] or mail: [ID] ok"


def test_pii_found_identifiers_show_new_patterns(spark):
    texts = [f"and mail: u{i}@ex.org ok" for i in range(150)]
    texts += [f"{label} tag-{9000 + i} ok" for i in range(30) for label in ("and mail:", "my badge:")]  # badge: never before a seed
    texts += [f"{label} bdg-{7000 + i} ok" for i in range(6) for label in ("my badge:", "at desk:")]  # desk: only before badges
    texts += ["at desk: dsk-5551 ok", *[f"room no {400000 + i} ok" for i in range(9)]]
    out = [r.text for r in pii.redact(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert out[150:] == ["and mail: [ID] ok", "my badge: [ID] ok"] * 30 + ["my badge: [ID] ok", "at desk: [ID] ok"] * 6 + ["at desk: [ID] ok", *texts[-9:]]


def test_packing(docs):
    rows = packing.pack(docs).collect()
    total = Counter()
    for r in rows:
        total[r.doc_id] += r.length
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048 and (at == 2048 or at & (at - 1) == 0)
    assert total[0] == 1


def test_chat(spark):
    rows = [(1, 0, "user", "a\\l<|end|>\n"), (1, 1, "assistant", "\\e<"), (1, 1, "assistant", "\\e<"), (2, None, None, None), (None, 0, "user", "x")]
    turns = chat_format.turns_of_table(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), "conv_id")
    out = {r.conv_id: r.t for r in chat_format.format_turns(turns).select("conv_id", chat_format.read_back(chat_format.F.col("formatted")).alias("t")).collect()}
    assert [(t.role, t.text) for t in out[1]] == [("user", "a\\l<|end|>\n"), ("assistant", "\\e<"), ("assistant", "\\e<")]
    assert [(t.role, t.text) for t in out[2]] == [("", "")] and len(out[None]) == 1


def test_html(spark):
    page = "<html><body><nav><a href=x>menu</a></nav><div class='ad'>buy</div><article><h1>Title&amp;</h1><p>One\n two <b>three</b><div class=comments>no</div></article><footer>f</footer></body></html>"
    rows = [(1, "http://a.example/x", page), (2, None, None), (3, "u", ""), (4, "http://b.example/", "plain <i>text</i>")]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "Title&\nOne two three", 2: "", 3: "", 4: "plain text"}


def test_lm_beats_base_on_held_out(spark):
    from pyspark.sql import functions as F

    rows = [(i, "the cat sat on the mat and " + f"name{i} ran") for i in range(60)]
    out = lm_scoring.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") % 7 == 2)
    r = out.where("held_out").agg(F.sum("base_score"), F.sum("score"), F.max("train_tokens")).first()
    assert r[1] > r[0] and r[2] == 10 * sum(i % 7 != 2 for i in range(60))


def test_classifier(docs, spark):
    labels = spark.createDataFrame([(0, 0), (1, 0), (7, 1), (8, 1), (10, 1), (3, None), (None, 1)], "doc_id long, quality int")
    got = quality_classifier.classify(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)


def test_simhash_blocks_lose_no_link(spark):
    rng = np.random.default_rng(5)
    values = [int(v) for v in rng.integers(0, 1 << 62, 3000)]
    values += [v ^ sum(1 << int(b) for b in rng.choice(62, 4, replace=False)) for v in values[:700]]
    values = sorted(set(values))
    a = np.array(values, dtype=np.uint64)
    want = {v: v for v in values}
    for i, j in zip(*np.nonzero(np.triu(np.bitwise_count(a[:, None] ^ a[None, :]) <= 4, 1))):
        x, y = want[values[i]], want[values[j]]
        if x != y:
            want = {k: min(x, y) if r in (x, y) else r for k, r in want.items()}
    edges = simhash.links(spark.createDataFrame([(v,) for v in values], "print long"), 4, 128)
    roots = {r.node: r.root for r in simhash.connected(edges).collect()}
    assert {v: roots.get(v, v) for v in values} == want


def test_dedup_keeps_one_row_of_each_component(spark):
    long = " ".join(f"word{i}" for i in range(60))
    rows = [(1, long, "a"), (1, "quite another text of seven words", "b"), (2, long, "c"), (2, long, "d"), (3, None, "e"), (4, "", "f"), (None, long, "g"), (None, "only without an id here", "h")]
    got = sorted(map(tuple, simhash.dedup(spark.createDataFrame(rows, "doc_id long, text string, print string")).collect()), key=str)
    assert got == sorted([rows[0], rows[1], rows[4], rows[7]], key=str)
    assert simhash.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_chat_layouts(spark):
    from pyspark.sql import functions as F

    records = [
        (1, '{"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo", "x": 1}], "id": 5}'),
        (2, '{"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": null}]}'),
        (3, '{"instruction": "do", "input": "", "output": "done", "prompt": "ignored"}'),
        (4, '{"instruction": "do", "output": "done"}'),
        (5, '{"system": "s", "prompt": "p", "response": "r"}'),
        (6, '{"other": 1}'), (7, None), (8, "not json"), (9, '{"messages": []}'),
    ]
    got = {}
    for r in chat_format.turns_of_json(spark.createDataFrame(records, "id long, record string"), "id", "record").orderBy("conv_id", "turn").collect():
        got.setdefault((r.conv_id, r.layout), []).append((r.role, r.text))
    assert got == {
        (1, "messages"): [("user", "hi"), ("assistant", "yo")], (2, "conversations"): [("user", "a"), ("assistant", "")], (3, "instruction_input"): [("user", "do"), ("assistant", "done")],
        (4, "instruction"): [("user", "do"), ("assistant", "done")], (5, "system_prompt_response"): [("system", "s"), ("user", "p"), ("assistant", "r")],
        (6, None): [(None, None)], (7, None): [(None, None)], (8, None): [(None, None)], (9, None): [(None, None)],
    }
    # the hash in the plan is the one that selects a table's mapping
    paths = ["messages[].role", "b", "a"]
    assert spark.range(1).select(chat_format._hash(F.array(*map(F.lit, paths)))).first()[0] == chat_format.fingerprint(paths)
    rows = spark.createDataFrame([(1, 0, "user", "a", "x", "y")], "conv_id long, turn int, role string, text string, prompt string, instruction string")
    assert chat_format.mapping_of(rows.schema).name == "turn_rows" and chat_format.turns_of_table(rows, "conv_id").columns == ["conv_id", "turn", "role", "text"]
    nested = spark.createDataFrame([(1, [("user", "q", 1), ("assistant", "a", 2)], "extra"), (2, None, None), (3, [], "")], "id long, messages array<struct<role:string,content:string,n:int>>, turn string")
    assert [tuple(r) for r in chat_format.turns_of_table(nested, "id").orderBy("turn").collect()] == [(1, 0, "user", "q"), (1, 1, "assistant", "a")]
    flat = spark.createDataFrame([(1, "p", "r"), (2, None, None)], "id long, prompt string, response string")
    assert sorted(tuple(r) for r in chat_format.turns_of_table(flat, "id").collect()) == [(1, 0, "user", "p"), (1, 1, "assistant", "r"), (2, 0, "assistant", "")]
    with pytest.raises(ValueError):
        chat_format.turns_of_table(spark.range(1), "id")


def test_license_votes_merge_over_gaps(spark):
    words = [f"lic{i}" for i in range(40)]
    templates = [("long", " ".join(words)), ("short", "five words make this notice")]
    changed = [*words[:12], "new", "words", *words[12:25], *words[28:]]  # two words in, three out
    rows = [
        (1, "before " + " ".join(changed) + " after"),
        (2, " ".join(words[:20])),  # half of it
        (3, " ".join(w for i, w in enumerate(words) if i % 4)),  # no four words in a row
        (4, "five words make this"), (5, "Five words, make THIS notice."), (6, " ".join(words) + " gap " * 50 + " ".join(changed)),
        (7, " ".join(words[20:] + words[:20])), (8, None),
    ]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), templates=templates).collect()}
    # no diagonal alone covers enough of the first text
    assert max(12, 13, 12) < 0.6 * 40
    span = got[1].spans[0]
    assert got[1].labels == "long" and (span.from_word, span.to_word) == (1, 39) and span.cover == (12 + 13 + 12) / 40
    assert [got[i].labels for i in (2, 3, 4, 5, 7, 8)] == ["", "", "", "short", "", ""]
    assert [(s.from_word, s.to_word) for s in got[6].spans] == [(0, 39), (90, 128)]
    assert got[5].base_labels == "" and got[5].n_base == 0 and got[5].score == 1
