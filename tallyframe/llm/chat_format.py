"""Chat formatting by schema fingerprints, in DataFrame functions only.

The nested field paths of a record (or of a table's schema) that a mapping names are hashed; where that fingerprint is
the mapping's own, the mapping turns the layout into canonical turns. Mappings of more paths come first. Turns are then
written with marks around each, and the spans of the assistant texts form the loss mask. Inside roles and texts a
backslash is written as \\e and a "<" as \\l, so no text can hold a mark, and reading back is exact.

A conversation is one string in the result, so its turns meet in one task, whatever their number.

Defined results: null texts and roles are empty; rows of one conversation are ordered by turn, then role and
text, nulls first; repeated rows are turns of their own; a null conversation id is a conversation; fields that
no mapping names, or that belong to a mapping not chosen, are ignored; a record that no mapping fits has no turns, a
table that none fits raises ValueError; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read

OPEN, CLOSE = "<|turn|>", "<|end|>\n"
#: Names of speakers in public layouts and their canonical roles.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Mapping:
    """paths: the field paths that must be there. turns: where roles and texts are found.

    A list layout names its list, role and text fields; a flat one gives (role, field) in order; `rows` is a
    table with a row for each turn.
    """

    name: str
    paths: tuple[str, ...]
    items: tuple[str, str, str] | None = None
    flat: tuple[tuple[str, str], ...] = ()
    rows: tuple[str, str, str] | None = None


MAPPINGS = (
    Mapping("turn_rows", ("role", "text", "turn"), rows=("turn", "role", "text")),
    Mapping("messages", ("messages", "messages[].content", "messages[].role"), items=("messages", "role", "content")),
    Mapping("conversations", ("conversations", "conversations[].from", "conversations[].value"), items=("conversations", "from", "value")),
    Mapping("instruction_input", ("input", "instruction", "output"), flat=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("instruction", ("instruction", "output"), flat=(("user", "instruction"), ("assistant", "output"))),
    Mapping("prompt_completion", ("completion", "prompt"), flat=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("prompt_response", ("prompt", "response"), flat=(("user", "prompt"), ("assistant", "response"))),
    Mapping("system_prompt_response", ("prompt", "response", "system"), flat=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
)


def schema_paths(schema: T.DataType, prefix: str = "") -> list[str]:
    """Nested field paths of a type, those of list elements after []."""
    if isinstance(schema, T.StructType):
        return [p for f in schema.fields for p in (f"{prefix}{f.name}", *schema_paths(f.dataType, f"{prefix}{f.name}."))]
    if isinstance(schema, T.ArrayType):
        return schema_paths(schema.elementType, prefix[:-1] + "[].")
    return []


def fingerprint(paths: list[str] | tuple[str, ...]) -> int:
    """Hash of a set of field paths, as `_hash` gives it."""
    value = xxhash.xxh64_intdigest(",".join(sorted(set(paths))).encode(), 42)
    return value - (1 << 64) if value >> 63 else value


#: The mappings by their fingerprints, those of more paths first.
_BY_FINGERPRINT = {fingerprint(m.paths): m for m in sorted(MAPPINGS, key=lambda m: -len(m.paths))}


def _hash(paths: Column) -> Column:
    return F.xxhash64(F.array_join(F.array_sort(F.array_distinct(paths)), ","))


def json_paths(record: Column) -> Column:
    """Field paths of a JSON record, with those inside the first elements of its lists that mappings know."""
    top = F.coalesce(F.json_object_keys(record), F.array().cast("array<string>"))
    return F.concat(top, *[_inner_paths(record, name) for name in sorted({m.items[0] for m in MAPPINGS if m.items})])


def json_fingerprint(record: Column) -> Column:
    """Hash of all field paths of a JSON record."""
    return _hash(json_paths(record))


def _inner_paths(record: Column, name: str) -> Column:
    keys = F.coalesce(F.json_object_keys(F.get_json_object(record, f"$.{name}[0]")), F.array().cast("array<string>"))
    return F.transform(keys, lambda k: F.concat(F.lit(f"{name}[]."), k))


def _list_turns(record: str, name: str, role: str, text: str) -> Column:
    parsed = F.from_json(F.get_json_object(record, f"$.{name}"), f"array<struct<`{role}`:string,`{text}`:string>>")
    return F.transform(parsed, lambda x: F.struct(_role(x[role]).alias("role"), F.coalesce(x[text], F.lit("")).alias("text")))


def _role(role: Column) -> Column:
    out = F.coalesce(role, F.lit(""))
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv]), out), out)


def _flat_turns(fields: list[tuple[str, Column]]) -> Column:
    """Turns of a flat layout; empty ones are left out but for the assistant's."""
    turns = F.array(*[F.struct(F.lit(role).alias("role"), F.coalesce(text, F.lit("")).alias("text")) for role, text in fields])
    return F.filter(turns, lambda x: (x["text"] != "") | (x["role"] == "assistant"))


def turns_of_json(records: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(conv_id, fingerprint, layout, turn, role, text) of JSON records of any mixture of layouts."""
    given = records.select(F.col(id_col).alias("conv_id"), F.col(json_col).alias("record"))
    given = given.withColumn("paths", json_paths(F.col("record"))).withColumn("fingerprint", _hash(F.col("paths")))
    turns, layout = F.lit(None).cast("array<struct<role:string,text:string>>"), F.lit(None).cast("string")
    for own, m in reversed(_BY_FINGERPRINT.items()):  # the first mappings are asked first
        if m.rows:
            continue
        here = _hash(F.array_intersect("paths", F.array(*map(F.lit, m.paths)))) == own
        value = _list_turns("record", *m.items) if m.items else _flat_turns([(r, F.get_json_object("record", f"$.{f}")) for r, f in m.flat])
        turns, layout = F.when(here, value).otherwise(turns), F.when(here, F.lit(m.name)).otherwise(layout)
    return given.select("conv_id", "fingerprint", layout.alias("layout"), F.posexplode_outer(turns).alias("turn", "t")).select("conv_id", "fingerprint", "layout", F.col("turn").cast("long"), "t.role", "t.text")


def mapping_of(schema: T.StructType) -> Mapping:
    """The mapping whose fingerprint the paths of a table's schema have, among the paths that the mapping names."""
    have = set(schema_paths(schema))
    for own, m in _BY_FINGERPRINT.items():
        if fingerprint(have & set(m.paths)) == own:
            return m
    raise ValueError(f"no mapping for a table with the fields {sorted(have)}")


def turns_of_table(df: DataFrame, id_col: str) -> DataFrame:
    """(conv_id, turn, role, text) of a table whose schema's fingerprint selects a mapping."""
    m, text_of = mapping_of(df.schema), lambda c: F.coalesce(c.cast("string"), F.lit(""))
    conv = F.col(f"`{id_col}`").alias("conv_id")
    if m.rows:
        turn, role, text = m.rows
        return df.select(conv, F.col(turn).alias("turn"), text_of(F.col(role)).alias("role"), text_of(F.col(text)).alias("text"))
    if m.items:
        name, role, text = m.items
        turns = F.transform(F.col(name), lambda x: F.struct(_role(x[role].cast("string")).alias("role"), text_of(x[text]).alias("text")))
    else:
        turns = _flat_turns([(r, F.col(f).cast("string")) for r, f in m.flat])
    return df.select(conv, F.posexplode(turns).alias("turn", "t")).select("conv_id", F.col("turn").cast("long"), "t.role", "t.text")


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\e")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\e"), F.lit("\\"))


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans): each conversation as one string, and where it counts for the loss.

    loss_spans are (start, end) in code points, end exclusive: the escaped assistant texts.
    """
    role = F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\n"))
    head = F.concat(F.lit(OPEN), role, F.lit("\n"))
    body = escape(F.col("text"))
    part = F.concat(head, body, F.lit(CLOSE))
    order = [F.col("turn"), F.col("role"), F.col("text")]
    by = W.partitionBy("conv_id").orderBy(*order)
    rows = turns.withColumns({"part": part, "skip": F.length(head), "size": F.length(body)})
    rows = rows.withColumn("n", F.row_number().over(by)).withColumn("at", F.sum(F.length("part")).over(by.rowsBetween(W.unboundedPreceding, -1)))
    begin = F.coalesce(F.col("at"), F.lit(0)) + F.col("skip")
    rows = rows.select("conv_id", F.struct("n", "part", (F.col("role") == "assistant").alias("loss"), begin.alias("start"), (begin + F.col("size")).alias("end")).alias("t"))
    out = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    spans = F.transform(F.filter("t", lambda t: t["loss"]), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))
    return out.select("conv_id", F.array_join(F.transform("t", lambda t: t["part"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    parts = F.filter(F.split(formatted, r"<\|end\|>\n"), lambda p: p != "")
    begin = len(OPEN) + 1

    def turn(p: Column) -> Column:
        cut = F.instr(p, F.lit("\n"))
        role = F.replace(F.substring(p, F.lit(begin), cut - begin), F.lit("\\n"), F.lit("\n"))
        return F.struct(unescape(role).alias("role"), unescape(F.substring(p, cut + 1, F.length(p))).alias("text"))

    return F.transform(parts, turn)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = spark.sql("SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    turns = turns_of_table(read(spark, sf_dir, "conversations"), "conv_id")
    out = format_turns(turns.unionByName(turns_of_table(planted, "conv_id")))
    out = out.withColumn("turns", read_back(F.col("formatted")))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
    out = out.withColumn("loss", loss)
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


OP7_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(17 + length(role) + length(text) + length(text) - length(replace(text, '\', '')) + length(text) - length(replace(text, '<', ''))
    + length(role) - length(replace(role, '\', '')) + length(role) - length(replace(role, '<', '')) + length(role) - length(replace(role, chr(10), ''))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
