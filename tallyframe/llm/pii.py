r"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Base entities (mail addresses, network addresses, card and phone numbers) and long hexadecimal secrets are
seeds. The words before an identifier-like token are its lexical patterns: the last two, or one that ends in
a label sign. A pattern's confidence is the share of all its places in the corpus that identifiers follow,
weighted by the identifiers' own confidence (below a floor it counts as none); an identifier's is that of its patterns taken together.
Spark scores this graph in turns; a pattern enters a turn once enough seeds and identifiers trusted in the turn
before follow it, so that found identifiers show new patterns, one generation a turn. Patterns above the threshold
in the last turn give spans to tokens that no base pattern knows.

Regular expressions start at word or run boundaries and use possessive repeats, so long junk costs linear time;
a text is found and cut by the same expression, which gives positions without a row for each character.

Defined results: null or empty text has no spans; repeated rows keep their rows; a null id is kept; other
columns are ignored by `find` and kept by `redact`; an empty table gives no rows; without seeds no pattern
is learnt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpoint, read

#: The contract's patterns, without needless backtracking.
_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
KINDS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "secret": r"(?<![0-9A-Za-z])[0-9a-f]{32,64}+(?![0-9A-Za-z])",
}
ORDER = [*KINDS, "id"]
#: A seed's place in a masked text: private-use characters, one for each kind.
_MARK = {k: chr(0xE001 + i) for i, k in enumerate(KINDS)}
_SEED = "".join(_MARK.values())
#: Identifier-like tokens: words that hold a digit, an at sign or a seed.
_TOKEN = rf"(?<!\S)[^\s0-9@{_SEED}]*+[0-9@{_SEED}]\S*+"
#: The last two words of a piece, found from words' starts only.
_LAST_WORDS = r"(?<!\S)(?:\S++\s++)?+\S++\s*+$"
_LABEL = r"[:=#]$"
#: Upper ends of the slices, of the last one's many, in which a pattern's places are counted.
SLICES = (1, 8, 64)
SPAN = "array<struct<start:int,rank:int,end:int>>"


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        bare = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(F.split(m, r"\."), lambda p: (F.length(bare(p)) < 3) | (F.length(bare(p)) == 3) & (bare(p) <= "255"))
    if kind == "card":
        backwards = F.split(F.reverse(digits), "")
        values = F.transform(F.filter(backwards, lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
        return F.length(digits).between(14, 19) & (F.aggregate(values, F.lit(0), lambda a, v: a + v) % 10 == 0)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "secret":
        return F.regexp_like(m, F.lit("[0-9]")) & F.regexp_like(m, F.lit("[a-f]"))
    return F.lit(True)


def _may_hold(kind: str, text: Column) -> Column:
    return F.contains(text, F.lit({"email": "@", "phone": "+"}[kind])) if kind in ("email", "phone") else F.regexp_like(text, F.lit("[0-9]"))


def _cut(text: Column, pattern: str) -> tuple[Column, Column]:
    """The pieces between matches, and the matches."""
    return F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _spans(kind: str, text: Column) -> Column:
    """(start, rank, end) of a kind's matches, in code points."""
    pieces, matches = _cut(text, KINDS[kind])
    rank = ORDER.index(kind)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["0"])
        end = begin + F.length(x["1"])
        found = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(_valid(kind, x["1"]), F.concat(acc["spans"], F.array(found))).otherwise(acc["spans"]).alias("spans"))

    zipped = F.zip_with(F.slice(pieces, F.lit(1), F.size(matches)), matches, lambda p, m: F.struct(p.alias("0"), m.alias("1")))
    return F.when(_may_hold(kind, text), F.aggregate(zipped, start, step)["spans"]).otherwise(F.array().cast(SPAN))


def _replaced(kind: str, text: Column, by) -> Column:
    """The text with each valid match of a kind replaced by by(match)."""
    pieces, matches = _cut(text, KINDS[kind])
    joined = F.array_join(F.zip_with(pieces, matches, lambda p, m: F.concat(p, F.when(m.isNull(), "").when(_valid(kind, m), by(m)).otherwise(m))), "")
    return F.when(_may_hold(kind, text), joined).otherwise(text)


def _with_base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    given = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    return given.withColumns({f"at_{k}": _spans(k, F.col("text")) for k in KINDS})


def _tokens(given: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n, gap, patterns, token): identifier-like tokens of masked texts, the length of the piece before each and its patterns."""
    some = given.where(F.regexp_like("text", F.lit("[0-9@]"))).select("doc_id", "text_hash", F.col("text").alias("masked"))
    for kind in KINDS:  # a step each: the column is used several times
        some = some.withColumn("masked", _masked(kind, F.col("masked")))
    pieces, matches = _cut(F.col("masked"), _TOKEN)
    last = lambda p: F.lower(F.regexp_extract(p, _LAST_WORDS, 0))
    parts = F.zip_with(F.slice(pieces, F.lit(1), F.size(matches)), matches, lambda p, m: F.struct(F.length(p).alias("gap"), last(p).alias("before"), m.alias("token")))
    out = some.select("doc_id", "text_hash", F.posexplode(parts).alias("n", "t")).select("doc_id", "text_hash", "n", "t.gap", _patterns(F.col("t.before")).alias("patterns"), "t.token")
    # equal rows hold equal tokens: one copy of each
    return out.dropDuplicates(["doc_id", "text_hash", "n"])


def _masked(kind: str, text: Column) -> Column:
    return _replaced(kind, text, lambda m: F.repeat(F.lit(_MARK[kind]), F.length(m)))


def _patterns(before: Column) -> Column:
    """The lexical patterns that a left context ends in, as 64-bit hashes of their words."""
    words = F.filter(F.split(before, r"\s+"), lambda w: w != "")
    n = F.size(words)
    two = F.when(n >= 2, F.xxhash64(F.get(words, n - 2), F.get(words, n - 1)))
    one = F.when(n >= 1, F.when(F.get(words, n - 1).rlike(_LABEL), F.xxhash64(F.get(words, n - 1))))
    return F.filter(F.array(two, one), lambda p: p.isNotNull())


def _places(given: DataFrame, candidates: DataFrame, floor: float) -> DataFrame:
    """(pattern, places) of the candidates (pattern, most) that can reach the confidence `floor`: how often each stands before anything.

    Places are counted in a small slice of the documents, then in larger ones. Counts only grow, so a pattern that
    already stands in more places than `most / floor` is certain to stay below, and is counted no further: what is
    counted in the last slice is in proportion to the identifiers and not to the commonest words of the corpus.
    """
    slot = F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(SLICES[-1]))
    words = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")
    pairs = F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1)))
    labels = F.transform(F.filter(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))), lambda w: F.regexp_like(w, F.lit(_LABEL))), lambda w: F.xxhash64(w))
    every = F.concat(F.when(F.size("w") >= 3, pairs).otherwise(F.array().cast("array<bigint>")), labels)
    left = candidates.withColumn("places", F.lit(0).cast("long"))
    for low, high in zip((0, *SLICES), SLICES):
        stood = given.where((slot >= low) & (slot < high)).select(words.alias("w")).select(F.explode(every).alias("pattern"))
        stood = stood.join(_sized(left.select("pattern")), "pattern", "left_semi").groupBy("pattern").agg(F.count("*").alias("more"))
        left = left.join(stood, "pattern", "left").select("pattern", "most", (F.col("places") + F.coalesce("more", F.lit(0))).alias("places"))
        left = checkpoint(left.where(F.col("most") >= floor * (F.col("places") + 1)))
    return left.select("pattern", "places")


def _learn(given: DataFrame, tokens: DataFrame, rounds: int, min_seeds: int, threshold: float, floor: float) -> tuple[DataFrame, DataFrame]:
    """Good patterns with their confidence, and the edges (row, n, pattern, instance)."""
    is_seed = F.regexp_like("token", F.lit(f"[{_SEED}]"))
    bare = F.regexp_replace("token", r"^[\p{P}\p{S}]+|[\p{P}\p{S}]+$", "")
    like = (F.length(bare) >= 6) & ((F.length(F.regexp_replace(bare, "[^0-9]", "")) >= 4) | F.contains(bare, F.lit("@")))
    instance = F.when(is_seed, F.concat_ws(":", F.lit("seed"), "doc_id", "text_hash")).otherwise(bare)
    edges = tokens.where(is_seed | like).select("doc_id", "text_hash", "n", is_seed.alias("seed"), F.xxhash64(instance).alias("instance"), F.explode("patterns").alias("pattern"))
    graph = checkpoint(edges.groupBy("pattern", "instance", "seed").agg(F.count("*").alias("times")))
    # what the turns below can reach at most, were every identifier of a pattern trusted
    seeds = graph.where("seed").select("instance")
    reached = seeds
    for _ in range(rounds):
        able = graph.join(reached.distinct(), "instance", "left_semi").groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= min_seeds)
        able = checkpoint(able.select("pattern"))
        reached = seeds.union(graph.join(able, "pattern", "left_semi").select("instance"))
    most = graph.join(able, "pattern", "left_semi").groupBy("pattern").agg(F.sum("times").alias("most"))
    placed = _places(given, checkpoint(most), floor)
    graph = checkpoint(graph.join(placed, "pattern"))
    # the first round trusts seeds alone; each later one also what the round before found
    score = graph.select("instance", "seed").distinct().withColumn("trust", F.when(F.col("seed"), 1.0).otherwise(0.0))
    for _ in range(rounds):
        weighted = graph.join(score.select("instance", "trust"), "instance")
        patterns = weighted.groupBy("pattern").agg(F.sum(F.col("times") * F.col("trust")).alias("good"), F.sum("times").alias("all"), F.count_if(F.col("trust") >= threshold).alias("support"), F.max("places").alias("places"))
        confidence = F.col("good") / (F.greatest("all", "places") + 1)
        patterns = checkpoint(patterns.where(F.col("support") >= min_seeds).select("pattern", confidence.alias("confidence")).where(F.col("confidence") >= floor))
        against = F.sum(F.ln(1 - F.least(F.col("confidence"), F.lit(0.999))))
        score = checkpoint(graph.join(patterns, "pattern", "left").groupBy("instance", "seed").agg((1 - F.exp(F.coalesce(against, F.lit(0.0)))).alias("found")).select("instance", "seed", F.when(F.col("seed"), 1.0).otherwise(F.col("found")).alias("trust")))
    return patterns.where(F.col("confidence") >= threshold), edges


def _sized(names: DataFrame, limit: int = 200_000) -> DataFrame:
    """Broadcast the patterns' hashes (8 bytes each) while they are at most `limit`; beyond, they are joined by shuffling."""
    return F.broadcast(names) if names.count() <= limit else names


def discovered(given: DataFrame, rounds: int = 3, min_seeds: int = 3, threshold: float = 0.6, floor: float = 0.1) -> DataFrame:
    """(doc_id, text_hash, more): spans of identifiers that only a learnt pattern shows.

    floor: a pattern of less confidence counts as knowing nothing.
    """
    tokens = checkpoint(_tokens(given.select("doc_id", "text_hash", "text")))
    good, edges = _learn(given, tokens, rounds, min_seeds, threshold, floor)
    hits = edges.where(~F.col("seed")).join(good, "pattern", "left_semi").select("doc_id", "text_hash", "n").distinct()
    rows = hits.select("doc_id", "text_hash").distinct()
    by = W.partitionBy("doc_id", "text_hash").orderBy("n")
    placed = tokens.alias("t").join(rows.alias("r"), F.expr("t.doc_id <=> r.doc_id AND t.text_hash = r.text_hash"), "left_semi")
    placed = placed.withColumn("stop", F.sum(F.col("gap") + F.length("token")).over(by))
    lead = F.length(F.regexp_extract("token", r"^[\p{P}\p{S}]+", 0))
    size = F.length(F.regexp_replace("token", r"^[\p{P}\p{S}]+|[\p{P}\p{S}]+$", ""))
    begin = F.col("stop") - F.length("token") + lead
    span = F.struct(begin.cast("int").alias("start"), F.lit(ORDER.index("id")).alias("rank"), (begin + size).cast("int").alias("end"))
    found = placed.alias("t").join(hits.alias("h"), F.expr("t.doc_id <=> h.doc_id AND t.text_hash = h.text_hash AND t.n = h.n"), "left_semi")
    return found.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(span)).alias("more"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **learning) -> DataFrame:
    """One row per input row: doc_id, text_hash, spans of each base kind (at_<kind>) and all spans, by start and kind."""
    given = _with_base(docs, id_col, text_col)
    more = discovered(given, **learning)
    more = more.select(F.col("doc_id").alias("found_id"), F.col("text_hash").alias("found_hash"), "more")
    out = given.drop("text").join(more, F.expr("doc_id <=> found_id AND text_hash = found_hash"), "left")
    every = F.array_sort(F.concat(*[F.col(f"at_{k}") for k in KINDS], F.coalesce("more", F.array().cast(SPAN))))
    return out.select("doc_id", "text_hash", *[f"at_{k}" for k in KINDS], every.alias("spans"))


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, ORDER))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ",")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **learning) -> DataFrame:
    """The input's columns, with every span replaced by its kind in brackets; of overlapping spans the first to start names it."""
    # the input's columns travel in one struct, so that no name of theirs meets one of ours
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text = F.coalesce(F.col(f"row.`{text_col}`"), F.lit(""))
    given = given.select("row", F.col(f"row.`{id_col}`").alias("row_id"), F.xxhash64(text).alias("row_hash"))
    more = discovered(_with_base(docs, id_col, text_col), **learning)
    joined = given.join(more, F.expr("row_id <=> doc_id AND row_hash = text_hash"), "left")
    spans = F.array_sort(F.concat(*[_spans(k, text) for k in KINDS], F.coalesce("more", F.array().cast(SPAN))))
    joined = joined.select("row", spans.alias("spans"))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in ORDER])
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        piece = F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.get(names, s["rank"]))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], F.concat(acc["parts"], F.array(piece))).otherwise(acc["parts"]).alias("parts"))

    cleaned = F.aggregate("spans", start, step, lambda a: F.concat(F.array_join(a["parts"], ""), F.substring(text, a["at"] + 1, F.length(text))))
    return joined.select(*[(F.when(F.size("spans") > 0, cleaned).otherwise(F.col(f"row.`{c}`")) if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(read(spark, sf_dir, "documents"))
    base = F.array_sort(F.concat(*[F.col(f"at_{k}") for k in list(KINDS)[:4]]))
    return found.select("doc_id", *[F.size(f"at_{k}").cast("long").alias(f"n_{k}") for k in list(KINDS)[:4]], F.sha2(_written(base), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
