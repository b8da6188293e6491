"""Chat formatting: schema fingerprints choose declarative mappings to canonical turns, then one reversible template.

A record's own structure, its nested field names with arrays and objects, is read from the parsed record, freed of fields and
subtrees that no layout names, and hashed. The hash selects a mapping, which is only data: which fields hold the turns, roles
and texts. A table's columns select a mapping in the same way. Everything is DataFrame functions; nothing runs in Python.

Template, one turn after the other::

    ### {role}: {text}</turn>\\n

Inside roles and texts a backslash is doubled, ``</turn`` becomes ``<\\/turn`` and ``###`` loses its form as ``#\\##``, so that
neither control string can come from data. A role's ``:`` becomes ``\\:``. Dropping one backslash before any character undoes it.

Cases: a null role or text counts as empty; a null key is a key; rows of a conversation are ordered by turn (null first), then
role and text, so ties and repeated rows give one defined output; a record of an unknown layout, or that is
no JSON, is one row without a turn and with ``layout`` null, beside its fingerprint, so that nothing is lost unseen.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalmill.llm.common import let, table

END = "</turn>\n"

#: Layout: required paths, optional paths, turns. A turn is (fixed role, path) or (role path, text path) inside an array.
LAYOUTS = {
    "messages": (("messages[].role", "messages[].content"), ("system",), [("system", "system"), ("messages", "role", "content")]),
    "message_parts": (("messages[].role", "messages[].content[].text"), ("system", "messages[].content[].type"), [("system", "system"), ("parts", "role", "content")]),
    "from_value": (("conversations[].from", "conversations[].value"), ("system",), [("system", "system"), ("conversations", "from", "value")]),
    "instruction": (("instruction", "output"), ("input", "system"), [("system", "system"), ("user", "instruction", "input"), ("assistant", "output")]),
    "prompt_response": (("prompt", "response"), ("system",), [("system", "system"), ("user", "prompt"), ("assistant", "response")]),
    "prompt_completion": (("prompt", "completion"), ("system",), [("system", "system"), ("user", "prompt"), ("assistant", "completion")]),
    "question_answer": (("question", "answer"), ("system",), [("system", "system"), ("user", "question"), ("assistant", "answer")]),
    "turn_rows": (("conv_id", "turn", "role", "text"), (), None),
}

#: Role names of layouts with their own, fixed values.
ROLE_NAMES = {"human": "user", "gpt": "assistant"}


#: Names that layouts use; other fields don't matter.
NAMES = sorted({n.removesuffix("[]") for need, may, _ in LAYOUTS.values() for path in (*need, *may) for n in path.split(".")})


def structure(paths) -> str:
    """The canonical text of the nested fields that paths like ``a[].b`` name: objects and arrays of V, fields in order of name."""
    tree: dict = {}
    for path in paths:
        node = tree
        for name in path.split("."):
            node = node.setdefault(name, {})
    text = lambda node: "OBJECT<" + ", ".join(f"{n.removesuffix('[]')}: " + ("ARRAY<" * n.endswith("[]") + (text(sub) if sub else "V") + ">" * n.endswith("[]")) for n, sub in sorted(node.items())) + ">"
    return text(tree)


def fingerprint(paths) -> str:
    return hashlib.sha256(structure(paths).encode()).hexdigest()


def registry() -> dict[str, str]:
    """Fingerprint of each layout with each choice of its optional paths -> layout."""
    return {fingerprint((*need, *chosen)): name for name, (need, may, _) in LAYOUTS.items() for n in range(len(may) + 1) for chosen in combinations(may, n)}


def frame_layout(df: DataFrame) -> str | None:
    """The layout that a DataFrame's own columns have; columns that no layout names are ignored.

    Rows of turns are known by their four columns alone: a further column may have any name, one of the vocabulary's too.
    """
    flat = {c for c in df.columns if c in NAMES}
    rows = [name for name, (need, _, how) in LAYOUTS.items() if how is None and flat.issuperset(need)]
    return rows[0] if rows else registry().get(fingerprint(flat))


def record_structure(record: Column) -> Column:
    """The canonical text of a JSON record's own nested fields, without what no layout names; null if it is no JSON object."""
    known, name = "|".join(NAMES), r"(?:`(?:[^`]|``)*`|[A-Za-z0-9_]+)"
    own = F.schema_of_variant(F.try_parse_json(record))
    own = F.regexp_replace(own, r": (?:STRING|BIGINT|BOOLEAN|DOUBLE|FLOAT|DATE|TIMESTAMP_NTZ|TIMESTAMP|BINARY|UUID|DECIMAL\(\d+,\d+\))", ": V")
    own = F.regexp_replace(own, r"ARRAY<(?:STRING|BIGINT|BOOLEAN|DOUBLE|VOID|VARIANT|DECIMAL\(\d+,\d+\))>", "ARRAY<V>")
    # Fields that hold nothing, and fields of other names; from the inside out, so that subtrees of other names vanish too.
    for _ in range(4):
        own = F.regexp_replace(own, rf"{name}: (?:VOID|OBJECT<>|ARRAY<OBJECT<>>)(?:, )?", "")
        own = F.regexp_replace(own, rf"(?<![A-Za-z0-9_`])(?!(?:{known}): ){name}: (?:V|ARRAY<V>|VARIANT)(?:, )?", "")
        own = F.regexp_replace(own, r", >", ">")
        # An object of an unknown name whose fields have names that layouts use is no part of a layout either.
        own = F.regexp_replace(own, rf"(?<![A-Za-z0-9_`])(?!(?:{known}): ){name}: (?:ARRAY<OBJECT<[^<>]*>>|OBJECT<[^<>]*>)(?:, )?", "")
        own = F.regexp_replace(own, r", >", ">")
    return F.when(own.startswith("OBJECT<"), own)


def record_fingerprint(record: Column) -> Column:
    return F.sha2(record_structure(record), 256)


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _renamed(names: Column, role: str, text: str):
    return lambda x: _turn(F.coalesce(names[x[role]], x[role]), x[text])


def _mapped(record: Column, turns: list) -> Column:
    parts = []
    for spec in turns:
        head, *paths = spec
        if head in ("messages", "conversations"):
            rows = F.from_json(F.get_json_object(record, f"$.{head}"), f"array<struct<`{paths[0]}`: string, `{paths[1]}`: string>>")
            names = F.create_map(*[F.lit(x) for pair in ROLE_NAMES.items() for x in pair])
            parts.append(F.coalesce(F.transform(rows, _renamed(names, *paths)), F.array().cast("array<struct<role:string,text:string>>")))
        elif head == "parts":
            rows = F.from_json(F.get_json_object(record, "$.messages"), f"array<struct<`{paths[0]}`: string, `{paths[1]}`: array<struct<text: string>>>>")
            said = lambda x: _turn(x[paths[0]], F.array_join(F.transform(x[paths[1]], lambda p: F.coalesce(p["text"], F.lit(""))), ""))  # noqa: B023, E731
            parts.append(F.coalesce(F.transform(rows, said), F.array().cast("array<struct<role:string,text:string>>")))
        else:
            first = F.get_json_object(record, f"$.{paths[0]}")
            more = [F.nullif(F.get_json_object(record, f"$.{p}"), F.lit("")) for p in paths[1:]]
            parts.append(F.when(first.isNotNull(), F.array(_turn(F.lit(head), F.concat_ws("\n\n", first, *more)))).otherwise(F.array().cast("array<struct<role:string,text:string>>")))
    return F.concat(*parts)


def record_turns(records: DataFrame, key: str, record: str) -> DataFrame:
    """Heterogeneous JSON records -> rows (key, layout, fingerprint, turn, role, text), the layout chosen for each record by fingerprint.

    A record of no known layout is one row with layout, turn, role and text null; one without any turn has its layout and no turn.
    """
    layouts = F.create_map(*[F.lit(x) for pair in registry().items() for x in pair])
    known = records.select(key, record, record_fingerprint(F.col(record)).alias("fingerprint")).withColumn("layout", layouts[F.col("fingerprint")])
    turns = F.coalesce(*[F.when(F.col("layout") == name, _mapped(F.col(record), how)) for name, (_, _, how) in LAYOUTS.items() if how])
    opened = known.select(key, "layout", "fingerprint", F.posexplode_outer(turns).alias("turn", "t"))
    return opened.select(key, "layout", "fingerprint", F.col("turn").cast("long"), "t.role", "t.text")


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), r"</turn", r"<\\/turn"), r"#(?=##)", r"#\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turns(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """Rows (key, turn, role, text) -> (key, formatted, loss_spans): each conversation's text and its assistant spans.

    A span is (start, length) in code points of ``formatted``, over an assistant text as escaped there.
    """
    turns = rows.select(key, F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    grouped = turns.groupBy(key).agg(F.sort_array(F.collect_list("t")).alias("turns"))
    one = lambda t: F.struct(F.concat(F.lit("### "), F.replace(escape(t["role"]), F.lit(":"), F.lit("\\:")), F.lit(": ")).alias("head"), escape(t["text"]).alias("body"), (t["role"] == "assistant").alias("loss"))
    marked = grouped.select(key, F.transform("turns", one).alias("marked"))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    step = lambda a, t: let(
        F.struct((a["at"] + F.length(t["head"])).alias("start"), F.length(t["body"]).alias("length")),
        lambda s: F.struct((s["start"] + s["length"] + len(END)).alias("at"), F.when(t["loss"], F.concat(a["spans"], F.array(s))).otherwise(a["spans"]).alias("spans")),
    )
    return marked.select(key, F.array_join(F.transform("marked", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "").alias("formatted"), F.aggregate("marked", empty, step)["spans"].alias("loss_spans"))


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order and with nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")


def read_back(formatted: Column) -> Column:
    """Formatted text -> array of (role, text), the inverse of the template."""
    blocks = F.split(formatted, END, -1)
    part = lambda b, n: F.regexp_extract(b, r"(?s)^### ((?:[^\\:]|\\.)*+): (.*)$", n)
    return F.transform(F.slice(blocks, F.lit(1), F.size(blocks) - 1), lambda b: F.struct(unescape(part(b, 1)).alias("role"), unescape(part(b, 2)).alias("text")))


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    if frame_layout(conversations) != "turn_rows":
        raise ValueError(f"no mapping for the columns {conversations.columns}")
    said = r"\### Assistant: </turn> ok"
    extra = spark.range(1).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.to_json(F.struct(F.array(*[F.struct(F.lit(r).alias("role"), F.lit(said).alias("content")) for r in ("user", "assistant")]).alias("messages"))).alias("record"),
    )
    names = ["conv_id", "turn", "role", "text"]
    rows = conversations.select(*names).unionByName(record_turns(extra, "conv_id", "record").filter("layout IS NOT NULL AND turn IS NOT NULL").select(*names))
    back = format_turns(rows).select("conv_id", "formatted", "loss_spans", read_back(F.col("formatted")).alias("turns"))
    loss = masked_text(F.col("formatted"), F.col("loss_spans"))
    return back.select("conv_id", "formatted", "turns", loss.alias("loss")).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP1_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), s AS (
  SELECT *, length(text) + length(regexp_replace(text, '[^\\]+', '', 'g'))
    + (length(text) - length(replace(text, '</turn', ''))) // 6
    + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda x: length(x) - 2)), 0)
    + length(role) + 4 + 2 + 8 AS chars
  FROM t
), g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss, sum(chars) AS formatted_chars
  FROM s GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM g
"""
