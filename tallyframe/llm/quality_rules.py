"""Quality rules with n-gram perplexity.

Character trigrams are counted per language by Spark, smoothed by interpolated modified Kneser-Ney in
DataFrame operations, and stored with their back-off weights in arrays sorted by hash. A document whose perplexity
lies outside its language's lower or upper band, or which fails the base rules, is rejected.

A text is scored by the model of the other half of its language's texts (halves by a hash of the text), so no text
is judged by what it taught. Its perplexity is the mean over the middle half of its words of the log10 perplexity of
a word's characters, so that a few odd words (a secret, an address, a quotation) do not decide for the whole. The band
is the language's median plus or minus `width` robust deviations of one word over the root of the number of words.

Characters rather than words: README has the figures of both.

Defined results: null or empty text has no words and fails the base rules; a null language counts as "und"; where the
other half of a language has no text, or a language too few for a band, the base rules alone decide; repeated rows keep their rows; other columns of the
input are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_WORDS, Words, checkpoint, chunks, mix, read, span_hash

#: Rows of models held in a worker at once; more are applied in several passes, each to the languages of its models.
MODEL_ROWS = 4_000_000
#: Kinds of a model's rows: log10 probabilities of trigrams, bigrams and characters, back-off weights of contexts of two and of one, and the unseen character.
P3, P2, P1, BACK2, BACK1, UNSEEN = range(6)
_SYMBOLS = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>"])
_BITS = np.uint64(21)


def base_counts(raw: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each row."""
    n = len(at) - 1
    w = Words(raw, at, SPACE_WORDS)

    def per_row(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return (total[at[1:]] - total[at[:-1]]).astype(np.int64)

    out = {"n_words": w.count.astype(np.int64)}
    out["word_chars"] = per_row((w.bytes != 0) & ((raw & 0xC0) != 0x80))
    out["n_symbols"] = per_row(_SYMBOLS[raw])
    # lines with a word: those that hold the first word of a row or one after a line end
    line_no = np.cumsum(raw == 10)
    word_line = line_no[w.start] if len(w.start) else np.zeros(0, np.int64)
    new = np.ones(len(w.start), bool)
    new[1:] = (word_line[1:] != word_line[:-1]) | (w.row[1:] != w.row[:-1])
    firsts, rows = w.start[new], w.row[new]
    breaks = np.flatnonzero(raw == 10)
    k = np.searchsorted(breaks, firsts)
    begin = np.maximum(np.where(k > 0, breaks[np.maximum(k - 1, 0)] + 1, 0) if len(breaks) else np.zeros(len(firsts), np.int64), at[rows])
    end = np.minimum(np.where(k < len(breaks), breaks[np.minimum(k, len(breaks) - 1)], len(raw)) if len(breaks) else np.full(len(firsts), len(raw)), at[rows + 1])
    lines = mix(span_hash(raw, begin, end) + rows.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    _, index = np.unique(lines, return_index=True)
    out["n_dup_lines"] = (np.bincount(rows, minlength=n) - np.bincount(rows[index], minlength=n)).astype(np.int64)
    start, grams = w.grams(5)
    grams = mix(grams + w.row[start].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    _, inverse, times = np.unique(grams, return_inverse=True, return_counts=True)
    twice = start[times[inverse] > 1] if len(start) else start
    marks = np.zeros(len(w.start) + 6, np.int64)
    np.add.at(marks, twice, 1)
    np.add.at(marks, twice + 5, -1)
    covered = np.cumsum(marks)[: len(w.start)] > 0
    out["n_repeat_words"] = np.bincount(w.row[covered], minlength=n).astype(np.int64)
    return out


def _trigrams(raw: np.ndarray, at: np.ndarray):
    """Character codes of a run of rows, each row led by two zeros: codes, starts, and the distinct trigrams of dense ids."""
    chars = (raw & 0xC0) != 0x80
    before = np.concatenate([[0], np.cumsum(chars)])[at]
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.int64)
    n = len(at) - 1
    rows = np.repeat(np.arange(n), np.diff(before))
    padded = np.zeros(len(points) + 2 * n, np.int64)
    place = np.arange(len(points)) + 2 * (rows + 1)
    padded[place] = points
    return padded, place, rows, before


def _dense(padded: np.ndarray, place: np.ndarray, group: np.ndarray, groups: int):
    """For each character its trigram's number; and the distinct (group, exact packed trigram)."""
    seen = np.zeros(0x110001, bool)
    seen[padded] = True
    alphabet = np.flatnonzero(seen)
    small = np.zeros(0x110001, np.int64)
    small[alphabet] = np.arange(len(alphabet))
    ids = small[padded]
    m = len(alphabet)
    code = ((group * m + ids[place - 2]) * m + ids[place - 1]) * m + ids[place]
    if groups * m**3 <= 1 << 23:
        counts = np.bincount(code, minlength=0)
        kinds = np.flatnonzero(counts)
        number = np.zeros(len(counts), np.int32)
        number[kinds] = np.arange(len(kinds))
        index, counts = number[code], counts[kinds]
    else:
        kinds, index, counts = np.unique(code, return_inverse=True, return_counts=True)
    c, rest = alphabet[kinds % m], kinds // m
    b, rest = alphabet[rest % m], rest // m
    a, g = alphabet[rest % m], rest // m
    return index, counts, g, (a << 42) | (b << 21) | c


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, list] = {}
    for batch in batches:
        model = np.array(batch.column(0).to_pylist(), dtype=object)
        for lo, hi, raw, at in chunks(batch.column(1)):
            padded, place, rows, _ = _trigrams(raw, at)
            names, group = np.unique(model[lo:hi].astype(str), return_inverse=True)
            _, counts, g, keys = _dense(padded, place, group[rows], len(names))
            for i, name in enumerate(names):
                here = g == i
                total.setdefault(name, []).append((keys[here], counts[here]))
        for name, parts in list(total.items()):
            keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            total[name] = [(keys, np.bincount(inverse, np.concatenate([c for _, c in parts]), len(keys)).astype(np.int64))]
            if len(keys) > 1_000_000:
                yield _counted(name, *total.pop(name)[0])
    for name, [(keys, counts)] in total.items():
        yield _counted(name, keys, counts)


def _counted(name, keys, counts):
    return pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys), pa.array(counts)], names=["model", "key", "n"])


def _discounts(counts: DataFrame) -> DataFrame:
    """Modified Kneser-Ney discounts of each model for counts 1, 2 and 3 or more."""
    d = counts.groupBy("model").agg(*[F.count_if(F.col("n") == i).alias(f"t{i}") for i in (1, 2, 3, 4)])
    y = F.col("t1") / F.greatest(F.col("t1") + 2 * F.col("t2"), F.lit(1))
    return d.select("model", *[F.when((F.col(f"t{i}") > 0) & (F.col("t1") > 0), F.greatest(F.lit(0.05), F.least(F.lit(i - 0.05), i - (i + 1) * y * F.col(f"t{i + 1}") / F.greatest(F.col(f"t{i}"), F.lit(1))))).otherwise(F.lit(i * 0.5)).alias(f"d{i}") for i in (1, 2, 3)])


def _level(counts: DataFrame) -> DataFrame:
    """(model, key, context, share, gamma): the discounted share of each n-gram and the mass its context leaves to the lower order."""
    d = _discounts(counts)
    context = counts.groupBy("model", "context").agg(F.sum("n").alias("total"), F.count_if(F.col("n") == 1).alias("k1"), F.count_if(F.col("n") == 2).alias("k2"), F.count_if(F.col("n") > 2).alias("k3"))
    context = context.join(d, "model").withColumn("gamma", (F.col("d1") * F.col("k1") + F.col("d2") * F.col("k2") + F.col("d3") * F.col("k3")) / F.col("total"))
    off = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    return counts.join(context, ["model", "context"]).select("model", "key", "context", F.greatest(F.lit(0.0), (F.col("n") - off) / F.col("total")).alias("share"), "gamma")


def kneser_ney(trigrams: DataFrame) -> DataFrame:
    """(model, kind, key, value): log10 probabilities of counted n-grams and log10 back-off weights of their contexts."""
    low, char = (1 << 42) - 1, (1 << 21) - 1
    three = trigrams.select("model", "key", "n", F.shiftright("key", 21).alias("context"))
    two = trigrams.groupBy("model", F.col("key").bitwiseAND(F.lit(low)).alias("key")).agg(F.count("*").alias("n")).withColumn("context", F.shiftright("key", 21))
    one = two.groupBy("model", F.col("key").bitwiseAND(F.lit(char)).alias("key")).agg(F.count("*").alias("n")).withColumn("context", F.lit(0).cast("long"))
    size = one.groupBy("model").agg((F.count("*") + 1).alias("v"))
    s1 = checkpoint(_level(one).join(size, "model").select("model", "key", "context", (F.col("share") + F.col("gamma") / F.col("v")).alias("p"), (F.col("gamma") / F.col("v")).alias("unseen")))
    p1 = s1.select("model", F.col("key").alias("k1"), F.col("p").alias("p1"))
    s2 = checkpoint(_level(two).withColumn("k1", F.col("key").bitwiseAND(F.lit(char))).join(p1, ["model", "k1"]).select("model", "key", "context", (F.col("share") + F.col("gamma") * F.col("p1")).alias("p"), "gamma"))
    p2 = s2.select("model", F.col("key").alias("k2"), F.col("p").alias("p2"))
    s3 = checkpoint(_level(three).withColumn("k2", F.col("key").bitwiseAND(F.lit(low))).join(p2, ["model", "k2"]).select("model", "key", "context", (F.col("share") + F.col("gamma") * F.col("p2")).alias("p"), "gamma"))
    row = lambda kind, key, value: [F.lit(kind).alias("kind"), F.col(key).alias("key"), F.log10(value).alias("value")]
    parts = [s.select("model", *row(kind, "key", "p")) for kind, s in ((P3, s3), (P2, s2), (P1, s1))]
    parts += [s.select("model", *row(kind, "context", "gamma")).distinct() for kind, s in ((BACK2, s3), (BACK1, s2))]
    parts.append(s1.select("model", *row(UNSEEN, "context", "unseen")).distinct())
    return reduce(DataFrame.unionByName, parts)


def _hash(model: np.ndarray, kind, keys: np.ndarray) -> np.ndarray:
    """model: hashes of models' names."""
    return mix(mix(keys.astype(np.uint64) ^ model) + (np.atleast_1d(kind).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


class _Model:
    """Values of models' rows in an array sorted by hash."""

    def __init__(self, hashes: np.ndarray, values: np.ndarray):
        self.hashes, self.values = hashes, values

    def find(self, model: np.ndarray, kind: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and whether they are there."""
        if not len(self.hashes):
            return np.zeros(len(keys)), np.zeros(len(keys), bool)
        wanted = _hash(model, kind, keys)
        at = np.minimum(np.searchsorted(self.hashes, wanted), len(self.hashes) - 1)
        return self.values[at].astype(float), self.hashes[at] == wanted

    def log_p(self, model: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of packed trigrams, and whether there is such a model."""
        out, seen = self.find(model, P3, keys)
        rest = np.flatnonzero(~seen)
        value, known = np.zeros(len(rest)), np.ones(len(rest), bool)
        if len(rest):
            m, k = model[rest], keys[rest]
            back2, has = self.find(m, BACK2, k >> 21)
            p2, seen2 = self.find(m, P2, k & ((1 << 42) - 1))
            back1, has1 = self.find(m, BACK1, (k >> 21) & ((1 << 21) - 1))
            p1, seen1 = self.find(m, P1, k & ((1 << 21) - 1))
            unseen, known = self.find(m, UNSEEN, np.zeros(len(k), np.int64))
            value = np.where(has, back2, 0) + np.where(seen2, p2, np.where(has1, back1, 0) + np.where(seen1, p1, unseen))
        out[rest] = value
        there = np.ones(len(keys), bool)
        there[rest] = known
        return out, there


def _middle(values: np.ndarray, raw: np.ndarray, at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Mean over the middle half of each row's words of their characters' mean value; a word goes with the white space after it."""
    out = np.full(n, np.nan)
    if not len(values):
        return out
    space = np.isin(raw[(raw & 0xC0) != 0x80], (32, 9, 10, 11, 12, 13))
    start = np.ones(len(values), bool)
    start[1:] = space[:-1] & ~space[1:] | (rows[1:] != rows[:-1])
    word = np.cumsum(start) - 1
    means = np.bincount(word, values) / np.bincount(word)
    row = rows[start]
    means = means[np.lexsort((means, row))]
    count = np.bincount(row, minlength=n)
    place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    cut = np.repeat(count // 4, count)
    inner = (place >= cut) & (place < np.repeat(count, count) - cut)
    held = count > 0
    # summed row by row, so that the value does not depend on the rows beside it
    out[held] = (np.bincount(row[inner], means[inner], n) / np.maximum(np.bincount(row[inner], minlength=n), 1))[held]
    return out


def _score(shared, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _Model(*shared.value)
        for batch in batches:
            asked = batch.column(3).to_numpy().view(np.uint64)
            for lo, hi, raw, at in chunks(batch.column(2)):
                n = hi - lo
                padded, place, rows, before = _trigrams(raw, at)
                names, group = np.unique(asked[lo:hi], return_inverse=True)
                index, _, g, keys = _dense(padded, place, group[rows], len(names))
                value, there = model.log_p(names[g], keys)
                perplexity = _middle(-value[index], raw, at, rows, n)
                if not there.all():
                    perplexity[np.unique(rows[~there[index]])] = np.nan
                counted = base_counts(raw, at)
                cols = [batch.column(0).slice(lo, n), batch.column(1).slice(lo, n), *map(pa.array, counted.values()), pa.array(perplexity, mask=np.isnan(perplexity)), pa.array(np.diff(before).astype(np.int64))]
                names_out = ["doc_id", "lang", *counted, "perplexity", "n_chars"]
                if keep_text:
                    cols, names_out = [*cols, batch.column(2).slice(lo, n)], [*names_out, "text"]
                yield pa.RecordBatch.from_arrays(cols, names=names_out)

    return run


def _small(languages: DataFrame, limit: int = 100_000) -> DataFrame:
    """A table with a row for each language: broadcast, so that a common language is no hot key, while it has at most `limit` rows."""
    return F.broadcast(languages) if languages.count() <= limit else languages


class Rules:
    """The models and the bands learnt from all of `docs`; `verdicts` applies them.

    width: robust deviations from the median to a band's edge. floor: least robust deviation of a word. min_docs:
    a language of fewer scored texts has no band. model_rows:
    rows of models that the driver and a worker hold at once; one language's models are never parted.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_words: int = 10, max_repeat: float = 0.2, width: float = 4.5, floor: float = 0.02, min_docs: int = 50, model_rows: int = MODEL_ROWS):
        self.columns, self.min_words, self.max_repeat, self.width = (id_col, text_col, lang_col), min_words, max_repeat, width
        spark = docs.sparkSession
        taught = docs.select(self._model(F.col(lang_col), F.col(text_col), 0).alias("model"), F.col(text_col).alias("text"))
        trigrams = taught.mapInArrow(_count, "model string, key long, n long").groupBy("model", "key").agg(F.sum("n").alias("n"))
        model = checkpoint(kneser_ney(checkpoint(trigrams)).withColumn("name", F.xxhash64("model")).withColumn("language", F.substring_index("model", "/", 1)))
        self.passes = max(1, math.ceil(model.count() / model_rows))
        self.parts = []
        for i in range(self.passes):
            part = model.where(self._pass(F.col("language")) == i).select("name", "kind", "key", F.col("value").cast("float").alias("value")).toArrow()
            name, kind, key, value = (part.column(c).to_numpy() for c in part.column_names)
            hashes = _hash(name.view(np.uint64), kind, key)
            order = np.argsort(hashes)
            self.parts.append(spark.sparkContext.broadcast((hashes[order], value[order].astype(np.float32))))
            del part, name, kind, key, value, hashes, order
        self.scored = checkpoint(self._scored(docs, False))
        known = self.scored.where("perplexity IS NOT NULL").select("lang", "perplexity", "n_words")
        quartiles = lambda x, q: F.percentile(F.round(x, 4), F.lit(q))
        middle = checkpoint(known.groupBy("lang").agg(quartiles(F.col("perplexity"), [0.5])[0].alias("middle"), F.count("*").alias("texts")).where(F.col("texts") >= min_docs).drop("texts"))
        off = (F.col("perplexity") - F.col("middle")) * F.sqrt("n_words")
        spread = known.join(_small(middle), "lang").groupBy("lang", "middle").agg(quartiles(off, [0.25, 0.75]).alias("q"))
        self.bands = checkpoint(spread.select(F.col("lang").alias("band_lang"), "middle", F.greatest(F.lit(floor), (F.col("q")[1] - F.col("q")[0]) / 1.349).alias("spread")))

    @staticmethod
    def _model(lang: Column, text: Column, other: int) -> Column:
        """The name of the model that a text teaches, or (other 1) is scored by."""
        half = (F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(2)) + other) % 2
        return F.concat(F.replace(F.coalesce(lang.cast("string"), F.lit("und")), F.lit("/"), F.lit("_")), F.lit("/"), half.cast("string"))

    def _pass(self, language: Column) -> Column:
        return F.pmod(F.xxhash64(language), F.lit(self.passes))

    def _scored(self, docs: DataFrame, keep_text: bool) -> DataFrame:
        id_col, text_col, lang_col = self.columns
        id_type = docs.schema[id_col].dataType.simpleString()
        name = self._model(F.col(lang_col), F.col(text_col), 1)
        given = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(name).alias("model"), F.substring_index(name, "/", 1).alias("language"))
        shape = f"doc_id {id_type}, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, perplexity double, n_chars long" + ", text string" * keep_text
        parts = [(given.where(self._pass(F.col("language")) == i) if self.passes > 1 else given).drop("language").mapInArrow(_score(part, keep_text), shape) for i, part in enumerate(self.parts)]
        return reduce(DataFrame.unionByName, parts)

    def _judged(self, scored: DataFrame) -> DataFrame:
        out = scored.join(_small(self.bands), F.col("lang") == F.col("band_lang"), "left")  # a row for each language
        half = self.width * F.col("spread") / F.sqrt(F.greatest("n_words", F.lit(1)))
        out = out.withColumns({"lower_band": F.col("middle") - half, "upper_band": F.col("middle") + half})
        out = out.withColumn("base_failed", (F.col("n_words") < self.min_words) | (F.col("n_repeat_words") > self.max_repeat * F.col("n_words")))
        inside = F.coalesce(F.col("perplexity").between(F.col("lower_band"), F.col("upper_band")), F.lit(True))
        return out.withColumn("kept", ~F.col("base_failed") & inside).drop("band_lang", "middle", "spread")

    def verdicts(self) -> DataFrame:
        """One row per input row: base counts, log10 perplexity, band, verdict."""
        return self._judged(self.scored)

    def keep(self, docs: DataFrame) -> DataFrame:
        """The input's rows, whole, that the rules keep. They are scored once more, so that no text is shuffled."""
        id_col, text_col, lang_col = self.columns
        packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("__row"), F.col(text_col).alias("__text"), F.col(lang_col).alias("__lang"))
        judged = Rules._judged(self, self._renamed("__row", "__text", "__lang")._scored(packed, True)).where("kept")
        return judged.select(*[(F.col("text") if c == text_col else F.col(f"doc_id.`{c}`")).alias(c) for c in docs.columns])

    def _renamed(self, *columns: str) -> Rules:
        out = object.__new__(Rules)
        out.__dict__.update(self.__dict__, columns=columns)
        return out


def apply_rules(docs: DataFrame, **rules) -> DataFrame:
    """Verdicts of rules learnt from the same rows; see Rules for the parameters."""
    return Rules(docs, **rules).verdicts()


def keep(docs: DataFrame, **rules) -> DataFrame:
    """The input's rows, whole, that rules learnt from them keep."""
    return Rules(docs, **rules).keep(docs)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = apply_rules(read(spark, sf_dir, "documents"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = out.withColumn("kept", F.col("kept") & ~failed).withColumn("base_failed", failed)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("perplexity", 6).alias("perplexity"), "lower_band", "upper_band")
