"""Unicode ranges, embeddings and bags of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranges of code points, both ends included.
UNICODE_RANGES = {
    "emoticon": (0x1F600, 0x1F64F), "control": (0x00, 0x1F), "digits": (0x30, 0x39), "latin-upper": (0x41, 0x5A),
    "latin-lower": (0x61, 0x7A), "basic-latin": (0x00, 0x7F), "extended-latin": (0x0080, 0x02AF),
}


def nfd(c: Column) -> Column:
    """Canonical decomposition; SQL has no function for it."""
    import unicodedata

    import pandas as pd

    def decompose(s):
        return s.map(lambda x: unicodedata.normalize("NFD", x), na_action="ignore")

    decompose.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(decompose, "string")(c)


def unicode_columns(text: Column, ranges: dict = UNICODE_RANGES, lower: bool = True, normalize: bool = False) -> dict[str, Column]:
    """How many characters of each range, of none (UNKNOWN), and in all (string_length) a text has."""
    x = F.lower(nfd(text) if normalize else text) if lower else nfd(text) if normalize else text

    def outside(lo, hi):
        return rf"[^\x{{{lo:x}}}-\x{{{hi:x}}}]"

    known = "".join(rf"\x{{{lo:x}}}-\x{{{hi:x}}}" for lo, hi in ranges.values())
    counts = {name: F.length(F.regexp_replace(x, outside(lo, hi), "")) for name, (lo, hi) in ranges.items()}
    return {**counts, "UNKNOWN": F.length(F.regexp_replace(x, f"[{known}]", "")), "string_length": F.length(text)}


def unicode_counts(df: DataFrame, column: str, ranges: dict = UNICODE_RANGES, lower: bool = True, normalize: bool = False) -> DataFrame:
    """The frame with a column for each range, UNKNOWN and string_length."""
    return df.withColumns(unicode_columns(F.col(column), ranges, lower, normalize))


def embedding_distances(df: DataFrame, column: str, references: dict[str, list[float]], metric: str = "euclidean") -> DataFrame:
    """The frame with {label}_distance for each reference vector and the closest label."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    x = F.transform(F.col(column), lambda v: v.cast("double"))
    out = {}
    for label, vector in references.items():
        r = F.array(*[F.lit(float(v)) for v in vector])
        if metric == "euclidean":
            out[f"{label}_distance"] = F.sqrt(total(F.zip_with(x, r, lambda a, b: (a - b) * (a - b))))
        else:
            norm = F.sqrt(total(F.transform(x, lambda a: a * a))) * F.sqrt(total(F.transform(r, lambda a: a * a)))
            out[f"{label}_distance"] = 1 - total(F.zip_with(x, r, lambda a, b: a * b)) / norm
    df = df.withColumns(out)
    least = F.least(*[F.col(f"`{n}`") for n in out]) if len(out) > 1 else F.col(f"`{next(iter(out))}`")
    closest = F.coalesce(*[F.when(F.col(f"`{label}_distance`") == least, F.lit(label)) for label in references])
    return df.withColumn("closest", closest)


def reference_vectors(df: DataFrame, column: str, k: int, seed: int = 0, components: int | None = None) -> list[list[float]]:
    """k-means centres as reference vectors; with `components`, found in the space of that many principal components and brought back."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    vectors = df.select(array_to_vector(F.transform(F.col(column), lambda v: v.cast("double"))).alias("v"))
    if components is None:
        return [c.tolist() for c in KMeans(k=k, seed=seed, featuresCol="v").fit(vectors).clusterCenters()]
    pca = PCA(k=components, inputCol="v", outputCol="p").fit(vectors)
    axes = pca.pc.toArray()
    return [(axes @ c).tolist() for c in KMeans(k=k, seed=seed, featuresCol="p").fit(pca.transform(vectors)).clusterCenters()]


def class_centroids(df: DataFrame, column: str, label: str) -> dict[str, list[float]]:
    """The mean vector of each label; labels come to the driver, so there should be few."""
    rows = df.select(F.col(label).cast("string").alias("label"), F.posexplode(column).alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    lists = rows.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda v: v["x"]).alias("v"))
    return {r.label: list(r.v) for r in lists.orderBy("label").collect()}


def embedding_profile_columns(df: DataFrame, column: str, references: dict[str, list[float]], metric: str = "euclidean") -> DataFrame:
    """Distances and closest label as sub-metric columns column/embedding.<name>, for `profile`."""
    out = embedding_distances(df.select(F.col(column)), column, references, metric).drop(column)
    return out.toDF(*[f"{column}/embedding.{c}" for c in out.columns])


def document_lengths(df: DataFrame, column: str) -> DataFrame:
    """The frame with doc_length (terms) and term_length (mean characters of a term) of each text."""
    terms = F.filter(F.split(F.lower(F.col(column)), r"\s+"), lambda t: t != "")
    size = F.when(F.col(column).isNotNull(), F.size(terms))
    return df.withColumns({"doc_length": size, "term_length": F.when(size > 0, F.aggregate(F.transform(terms, F.length), F.lit(0), lambda a, n: a + n) / size)})


class Lsi:
    """Latent semantic indexing of texts: singular vectors of hashed term counts, and how much of a text they do not explain.

    The Gram matrix of `terms` hashed term counts is summed on the executors (terms^2 numbers, whatever the corpus) and
    decomposed on the driver. `update` adds more texts, older ones fading by `decay`.
    """

    def __init__(self, terms: int = 256, rank: int = 16, decay: float = 1.0):
        self.terms, self.rank, self.decay, self.gram = terms, rank, decay, None

    def _pairs(self, df: DataFrame, column: str) -> DataFrame:
        place = F.transform(F.filter(F.split(F.lower(F.col(column)), r"\s+"), lambda t: t != ""), lambda t: F.pmod(F.xxhash64(t), F.lit(self.terms)).cast("int"))
        distinct = F.array_distinct(place)
        return df.select("*", F.transform(distinct, lambda i: F.struct(i.alias("i"), F.size(F.filter(place, lambda p: p == i)).cast("double").alias("n"))).alias("__v"))

    def update(self, df: DataFrame, column: str) -> Lsi:
        import numpy as np

        one = self._pairs(df.select(column), column).select("__v", F.explode_outer("__v").alias("a")).where("a IS NOT NULL")
        sums = one.select("a", F.explode("__v").alias("b")).where("a.i <= b.i").groupBy("a.i", "b.i").agg(F.sum(F.col("a.n") * F.col("b.n")).alias("s")).toDF("i", "j", "s")
        gram = np.zeros((self.terms, self.terms))
        for i, j, s in sums.collect():
            gram[i, j] = gram[j, i] = s
        self.gram = gram if self.gram is None else self.decay * self.gram + gram
        values, vectors = np.linalg.eigh(self.gram)
        self.axes = vectors[:, np.argsort(-values)[: self.rank]]
        return self

    def residuals(self, df: DataFrame, column: str) -> DataFrame:
        """The frame with `lsi_residual`: the share of a text's counts outside the axes (0 to 1); null without terms."""
        axes = [F.array(*[F.lit(float(x)) for x in self.axes[:, r]]) for r in range(self.axes.shape[1])]
        v = self._pairs(df, column)
        norm = F.aggregate("__v", F.lit(0.0), lambda a, e: a + e["n"] * e["n"])
        along = lambda x: F.aggregate("__v", F.lit(0.0), lambda a, e: a + e["n"] * F.get(x, e["i"]))
        held = sum((F.pow(along(x), F.lit(2)) for x in axes), F.lit(0.0))
        return v.withColumn("lsi_residual", F.when(norm > 0, F.sqrt(F.greatest(F.lit(0.0), 1 - held / norm)))).drop("__v")


def text_profile(df: DataFrame, column: str, lsi: Lsi | None = None, plan=None) -> DataFrame:
    """The profile of a text column's sub-metrics: bag-of-words lengths and, where given, LSI residuals."""
    from .profile import profile

    out = document_lengths(df, column)
    names = {"doc_length": f"{column}/bag_of_words.doc_length", "term_length": f"{column}/bag_of_words.term_length"}
    if lsi is not None:
        out, names["lsi_residual"] = lsi.residuals(out, column), f"{column}/lsi.residual"
    return profile(out.withColumnsRenamed(names), plan, columns=list(names.values()))


def bag_of_words(df: DataFrame, column: str) -> DataFrame:
    """(term, n) over all texts, split on white space."""
    return df.select(F.explode(F.split(F.lower(column), r"\s+")).alias("term")).where("term <> ''").groupBy("term").agg(F.count("*").alias("n"))
