"""License scans by diagonal voting.

All rolling word k-gram hashes of the texts are joined to the positions of license templates; hits are
counted by offset diagonal (text position minus template position), neighbouring diagonals are merged,
and a span is verified by the share of the template's words that its grams cover exactly. Templates are the
paragraphs of whole license texts (licenses/<label>.<version>.txt), so that a part of a license is found too,
and the notices below. A paragraph that several licenses share word by word is labelled with all of them,
joined by a bar; a span within another license's span of higher cover is left out, as a likeness of it.

Defined results: null or empty text has no words (n_words 0, no labels, null positions); repeated rows each
keep their row; a null id is kept; other columns of the input are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from importlib.resources import files

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ALNUM_WORDS, Words, chunks, read, text_hash

#: Phrases of the contract and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Opening sentences of well-known public licenses and notices.
TEMPLATES = [
    ("apache", "licensed under the apache license version 2.0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4.0 international license"),
    ("cc-by", "licensed under cc by nc 4.0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4.0 international license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("public-domain", "this is free and unencumbered software released into the public domain"),
]
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def _words(text: str) -> list[bytes]:
    return _WORD.findall(text.encode().lower())


@cache
def license_templates(min_words: int = 12) -> list[tuple[str, str]]:
    """(label, text) of every paragraph and numbered clause of the license texts; those of fewer words go on into the next."""
    labels: dict[bytes, set] = {}
    for path in sorted(files(__package__).joinpath("licenses").iterdir(), key=lambda f: f.name):
        parts: list[list[bytes]] = [[]]
        for words in map(_words, re.split(r"\n\s*\n|\n(?=\s*\(?[0-9a-z]{1,2}[.)]\s)", path.read_text("utf-8"))):
            if len(parts[-1]) >= min_words:
                parts.append([])
            parts[-1] += words
        if len(parts) > 1 and len(parts[-1]) < min_words:
            parts[-2:] = [parts[-2] + parts[-1]]
        for words in parts:
            labels.setdefault(b" ".join(words), set()).add(path.name.split(".")[0])
    return [("|".join(sorted(of)), text.decode()) for text, of in labels.items()]


def templates_table(spark: SparkSession, templates, k: int) -> DataFrame:
    """(gram, template, label, t_pos, t_words): one row per k-gram; its size is that of the template list."""
    rows = []
    for i, (label, text) in enumerate(templates):
        words = _words(text)
        k_here = min(k, len(words))
        if k_here < k:
            raise ValueError(f"a template needs {k} words: {text}")
        raw = np.frombuffer(b" ".join(words), np.uint8)
        _, grams = Words(raw, np.array([0, len(raw)]), ALNUM_WORDS).grams(k)
        rows += [(int(g.astype(np.int64)), i, label, j, len(words)) for j, g in enumerate(grams)]
    return spark.createDataFrame(rows, "gram long, template int, label string, t_pos int, t_words int")


def _tokens(k: int, phrases: dict[str, str]):
    targets = [(_words(p), label) for p, label in phrases.items()]
    n_max = max((len(t) for t, _ in targets), default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = [(text_hash(t), label) for t, label in targets]
        for batch in batches:
            for lo, hi, raw, at in chunks(batch.column(1)):
                w = Words(raw, at, ALNUM_WORDS)
                n = hi - lo
                n_base, first, last = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
                labels: list[set] = [set() for _ in range(n)]
                for t, label in hashed if n_max else ():
                    m = len(t)
                    if len(w.hash) < m:
                        continue
                    ok = w.row[: len(w.row) - m + 1] == w.row[m - 1 :]
                    for j in range(m):
                        ok = ok & (w.hash[j : len(w.hash) - m + 1 + j] == t[j])
                    at_word = np.flatnonzero(ok)
                    rows = w.row[at_word]
                    pos = at_word - w.first[rows]
                    np.add.at(n_base, rows, 1)
                    np.minimum.at(first, rows, pos)
                    np.maximum.at(last, rows, pos)
                    for r in set(rows.tolist()):
                        labels[r].add(label)
                start, grams = w.grams(k)
                per = np.bincount(w.row[start], minlength=n)
                offsets = np.concatenate([[0], np.cumsum(per)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, n),
                        batch.column(2).slice(lo, n),
                        pa.array(w.count.astype(np.int64)),
                        pa.array(n_base),
                        pa.array(np.where(n_base > 0, first, 0), mask=n_base == 0),
                        pa.array(np.where(n_base > 0, last, 0), mask=n_base == 0),
                        pa.array([",".join(sorted(x)) for x in labels]),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(grams.view(np.int64))),
                    ],
                    names=["doc_id", "text_hash", "n_words", "n_base", "first_word", "last_word", "base_labels", "grams"],
                )

    return run


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, slack: int = 3, min_cover: float = 0.6, min_words: int = 8, phrases=None, templates=None) -> DataFrame:
    """One row per input row with phrase counts, labels, the best template's cover and the verified spans.

    Spans are (label, first word, last word, cover). k: words in a gram. slack: how far diagonals may lie
    apart to be merged (words inserted or left out). min_cover: share of template words to be covered. min_words: and how
    many at least, or all of a shorter template.
    """
    spark = docs.sparkSession
    phrases, templates = PHRASES if phrases is None else phrases, [*TEMPLATES, *license_templates()] if templates is None else templates
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, text_hash long, n_words long, n_base long, first_word long, last_word long, base_labels string, grams array<bigint>"
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    tokens = given.mapInArrow(_tokens(k, phrases), schema)
    table = templates_table(spark, templates, k)
    # the template list is a fixed, small table: its side of the join is broadcast
    hits = tokens.select("doc_id", "text_hash", F.posexplode("grams").alias("pos", "gram")).join(F.broadcast(table), "gram")
    votes = hits.groupBy("doc_id", "text_hash", "template", "label", "t_words", (F.col("pos") - F.col("t_pos")).alias("diagonal")).agg(
        F.collect_set("t_pos").alias("t_at"), F.min("pos").alias("from_word"), F.max("pos").alias("to_word")
    )
    by = W.partitionBy("doc_id", "text_hash", "template").orderBy("diagonal")
    merged = votes.withColumn("new", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(by) > slack).cast("int"), F.lit(1)))
    merged = merged.withColumn("cluster", F.sum("new").over(by)).groupBy("doc_id", "text_hash", "template", "label", "t_words", "cluster").agg(
        F.array_distinct(F.flatten(F.collect_list("t_at"))).alias("t_at"), F.min("from_word").alias("from_word"), (F.max("to_word") + k - 1).alias("to_word")
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("t_at", lambda p: F.sequence(p, p + k - 1)))))
    # so few words as a short notice has must all be there
    least = F.greatest(F.ceil(min_cover * F.col("t_words")), F.least("t_words", F.lit(min_words)))
    spans = merged.withColumn("covered", covered).where(F.col("covered") >= least).withColumn("cover", F.col("covered") / F.col("t_words"))
    none = F.lit(None)
    found = spans.select("doc_id", "text_hash", F.struct("label", "from_word", "to_word", "cover").alias("span"), F.lit(0).alias("copies"), *[none.cast(t).alias(c) for c, t in (("n_words", "long"), ("n_base", "long"), ("first_word", "long"), ("last_word", "long"), ("base_labels", "string"))])
    rows = tokens.select("doc_id", "text_hash", F.lit(None).cast("struct<label:string,from_word:int,to_word:int,cover:double>").alias("span"), F.lit(1).alias("copies"), "n_words", "n_base", "first_word", "last_word", "base_labels")
    out = rows.unionByName(found).groupBy("doc_id", "text_hash").agg(
        F.sum("copies").alias("copies"),
        *[F.max(c).alias(c) for c in ("n_words", "n_base", "first_word", "last_word", "base_labels")],
        F.array_sort(F.collect_set("span")).alias("spans"),
    )
    within = lambda s, o: (o["from_word"] <= s["from_word"] + slack) & (o["to_word"] >= s["to_word"] - slack)
    likeness = lambda s: F.exists("spans", lambda o: (o["label"] != s["label"]) & (o["cover"] > s["cover"]) & within(s, o))
    out = out.withColumn("spans", F.filter("spans", lambda s: ~likeness(s)))
    base = F.filter(F.split("base_labels", ","), lambda x: x != "")
    out = out.withColumn("labels", F.array_join(F.array_sort(F.array_distinct(F.concat(base, F.transform("spans", lambda s: s["label"])))), ","))
    out = out.withColumn("score", F.greatest(F.lit(0.0), F.when(F.col("n_base") > 0, F.lit(0.5)), F.array_max(F.transform("spans", lambda s: s["cover"]))))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copy", "copies", "text_hash")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.to_json("spans").alias("spans"))
