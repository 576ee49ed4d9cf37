"""The pipeline's stages on a table of odd rows, against plain code."""

import random
import re

import pytest

pytest.importorskip("tallyframe.llm.queries")
import corpus_pipeline  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

SHAPE = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["more", "prompt", "n", "text_hash", "__id", "spans", "ids", "row", "print", "kept", "perplexity"]


def prose(r, n):
    syllables = ["ba", "ro", "ti", "len", "sho", "mar", "ke", "ul", "dis", "ver"]
    return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    r, folder = random.Random(9), str(tmp_path_factory.mktemp("sf"))
    items = [prose(r, 30) for _ in range(3)] + [None, ""]
    texts = {i: prose(r, r.randint(60, 200)) for i in range(40)}
    texts |= {50: None, 51: "", 52: "too short", 53: "again and again and again " * 20, 54: texts[3], 55: texts[3], 56: texts[4] + " end"}
    texts |= {60: items[0], 61: prose(r, 900) + " " + " ".join(items[1].split()[:13]) + " " + prose(r, 30), 62: prose(r, 60) + " mail me@site.org now " + prose(r, 20), 63: prose(r, 60000)}
    rows = [(i, t, None if i % 11 == 0 else "en", None if i % 5 == 0 else "s", len(t or "")) for i, t in texts.items()]
    rows += [rows[1], rows[1], (1, prose(r, 80), "en", "other", 1), (None, prose(r, 90), "en", "s", 2)]
    spark.createDataFrame(rows, SHAPE).withColumns({c: F.lit("clash") for c in CLASHING}).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, items


def words(t):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())


def test_each_stage(spark, table):
    folder, rows, items = table
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    named = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "packing":
            assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        path = f"{folder}/{name}"
        out.write.parquet(path)
        docs = named[name] = spark.read.parquet(path)
    kept = {k: [(r.doc_id, r.text) for r in df.collect()] for k, df in named.items() if k != "packing"}

    def base_ok(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        hit = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)} if len(w) < 500 else ()
        return len(w) >= 10 and 100 * len(hit) <= 20 * len(w)

    want = sorted(((i, t) for i, t, *_ in rows if base_ok(t)), key=str)
    assert sorted(kept["quality_rules"], key=str) == want  # nothing here is junk beyond the base rules
    first = {}
    for i, t in want:
        first[t] = min(first.get(t, (True, 0)), (i is None, i or 0))
    once = {(None if none else i, t) for t, (none, i) in first.items()}
    once -= {(56, t) for _, t in once}  # the near copy
    assert sorted(kept["simhash_near_dedup"], key=str) == sorted(once, key=str)
    assert {i for i, _ in kept["decontamination"]} == {i for i, _ in once} - {60}
    cleaned = dict(kept["decontamination"])
    assert " ".join(items[1].split()[:13]) not in cleaned[61] and len(words(cleaned[61])) == 930 and cleaned[63] == dict(once)[63]
    final = dict(kept["pii"])
    assert "[EMAIL]" in final[62] and "me@site.org" not in final[62] and {i for i, _ in kept["pii"]} == {i for i, _ in kept["decontamination"]}
    size = {}
    for p in named["packing"].collect():
        size[p.doc_id] = size.get(p.doc_id, 0) + p.length
        assert p.length * 4 == len(p.ids)
    assert set(size) == {i for i, _ in kept["pii"]}
    assert set(CLASHING) <= set(named["pii"].columns)


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], SHAPE).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
