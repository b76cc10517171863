"""Chat formatting by schema fingerprints, in native operations.

Each record is a VARIANT. The paths of its nested fields are hashed (``fingerprint``); the hash selects one of
the declarative ``LAYOUTS``, which says where roles and texts are. A record whose hash is unknown takes the layout with the most fields among those
whose fields it has besides others; one that has none becomes a turn without a role that holds the record as JSON, so nothing is lost. ``canonical`` turns records into rows
(conv, ord, seq, role, text, layout), and ``format_chats`` writes one string per conversation:

    <turn>role<text>text</turn>\n     for each turn, `&` and `<` inside escaped as `&amp;` and `&lt;`

so no text can hold a marker. The loss mask is an array of (turn, start, chars): code points of the formatted
string, escaped, one span for each assistant text. ``read_back`` undoes all of it from the output alone.

Null roles and texts count as empty. Turns stand by (ord, seq), nulls first; ties by role, then text; repeated rows
are turns of their own. Null conversation ids form one conversation. Null records, and records with an empty list of messages, give no turns.
``unknown_layouts`` lists the layouts that no hash stands for. A conversation is one row of the output, so it has to fit a task; its rows are
escaped and measured before they meet. Only the named columns are read, so other names can't clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Layout:
    """``paths``: as ``field_paths`` writes them. ``turns``: (role, path) for texts at fixed places. ``role``/``text``: one message, or, below the
    array at ``items``, many. ``aliases``: other names for roles."""

    name: str
    paths: tuple[str, ...]
    turns: tuple[tuple[str, str], ...] = ()
    items: str = ""
    role: str = ""
    text: str = ""


# The layouts that are known, and the names of roles in them.
LAYOUTS = [
    Layout("row", ("OBJECT<role, text>",), role="role", text="text"),
    Layout("message", ("OBJECT<content, role>",), role="role", text="content"),
    Layout("share", ("OBJECT<from, value>",), role="from", text="value"),
    Layout("prompt", ("OBJECT<completion, prompt>",), turns=(("user", "prompt"), ("assistant", "completion"))),
    Layout("response", ("OBJECT<prompt, response>",), turns=(("user", "prompt"), ("assistant", "response"))),
    Layout("question", ("OBJECT<answer, question>",), turns=(("user", "question"), ("assistant", "answer"))),
    Layout("system_prompt", ("OBJECT<prompt, response, system>",), turns=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("instruction", ("OBJECT<instruction, output>",), turns=(("user", "instruction"), ("assistant", "output"))),
    Layout("instruction_input", ("OBJECT<input, instruction, output>",), turns=(("user", "instruction+input"), ("assistant", "output"))),
    Layout("messages", ("OBJECT<messages: ARRAY<OBJECT<content, role>>>", "OBJECT<messages: ARRAY>"), items="messages", role="role", text="content"),
    Layout("conversations", ("OBJECT<conversations: ARRAY<OBJECT<from, value>>>", "OBJECT<conversations: ARRAY>"), items="conversations", role="from", text="value"),
]
ALIASES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
_SCALAR = r"(STRING|VOID|BOOLEAN|BIGINT|DOUBLE|FLOAT|DATE|TIMESTAMP_NTZ|TIMESTAMP|BINARY|UUID|DECIMAL\(\d+,\d+\))"


def field_paths(record: Column) -> Column:
    """The nested fields of a VARIANT without the types of scalars, e.g. ``OBJECT<messages: ARRAY<OBJECT<content, role>>>``."""
    typed = F.schema_of_variant(record)
    return F.regexp_replace(F.regexp_replace(typed, f": {_SCALAR}(?=[,>])", ""), f"ARRAY<{_SCALAR}>", "ARRAY")


def fingerprint(record: Column) -> Column:
    return F.xxhash64(field_paths(record))


def _has(record: Column, x: Layout) -> Column:
    """Whether the record has the fields that the layout reads."""
    if x.items:
        first = F.element_at(F.try_variant_get(record, f"$.{x.items}", f"array<struct<{x.role}: string, {x.text}: string>>"), 1)
        return F.coalesce(first[x.role].isNotNull() & first[x.text].isNotNull(), F.lit(False))
    fields = [x.role, x.text] if x.role else [f for _, path in x.turns for f in path.split("+")]
    has = F.lit(True)
    for f in fields:
        has = has & F.try_variant_get(record, f"$.{f}", "string").isNotNull()
    return has


def _layout(record: Column) -> Column:
    """Place in ``LAYOUTS``: by the fingerprint, else by the fields it has; null for none."""
    case = F
    for i, x in enumerate(LAYOUTS):
        case = case.when(F.col("__print").isin([F.xxhash64(F.lit(p)) for p in x.paths]), F.lit(i))
    for i, x in sorted(enumerate(LAYOUTS), key=lambda y: (-max(p.count(",") for p in y[1].paths), y[0])):
        case = case.when(_has(record, x), F.lit(i))
    return case


def _turns(record: Column, x: Layout) -> Column:
    get = lambda path: F.coalesce(F.variant_get(record, f"$.{path}", "string"), F.lit(""))
    turn = lambda role, text: F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    if x.items:
        of = F.variant_get(record, f"$.{x.items}", f"array<struct<{x.role}: string, {x.text}: string>>")
        return F.coalesce(F.transform(of, lambda m: turn(_role(m[x.role]), m[x.text])), F.array().cast("array<struct<role:string,text:string>>"))
    if x.role:
        role = get(x.role)
        return F.array(turn(_role(role) if x.role == "from" else role, get(x.text)))

    def text(path: str) -> Column:
        first, _, more = path.partition("+")
        return F.concat(get(first), F.when(get(more) != "", F.concat(F.lit("\n\n"), get(more))).otherwise("")) if more else get(first)

    return F.array(*(turn(F.lit(role), text(path)) for role, path in x.turns))


def _role(role: Column) -> Column:
    case = F
    for other, name in ALIASES.items():
        case = case.when(role == other, F.lit(name))
    return case.otherwise(role)


def canonical(records: DataFrame, conv: str, order: str, record: str) -> DataFrame:
    """conv, ord, seq, role, text, layout (its name; null if none fits): the turns of each record."""
    v = records.select(F.col(conv).alias("conv"), F.col(order).alias("ord"), F.col(record).alias("__v")).filter(F.col("__v").isNotNull()).withColumn("__print", fingerprint(F.col("__v")))
    v = v.withColumn("__at", _layout(F.col("__v")))
    turns, name = F, F
    for i, x in enumerate(LAYOUTS):
        turns, name = turns.when(F.col("__at") == i, _turns(F.col("__v"), x)), name.when(F.col("__at") == i, F.lit(x.name))
    whole = F.array(F.struct(F.lit("").alias("role"), F.to_json("__v").alias("text")))
    return v.select("conv", "ord", name.alias("layout"), F.posexplode(turns.otherwise(whole)).alias("seq", "__m")).select("conv", "ord", "seq", F.col("__m.role").alias("role"), F.col("__m.text").alias("text"), "layout")


def unknown_layouts(records: DataFrame, record: str) -> DataFrame:
    """paths and count of the records that no layout covers."""
    known = [p for x in LAYOUTS for p in x.paths]
    paths = records.select(field_paths(F.col(record)).alias("paths"))
    return paths.filter(~F.col("paths").isin(known) | F.col("paths").isNull()).groupBy("paths").agg(F.count(F.lit(1)).alias("n"))


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


TURN, TEXT, END = "<turn>", "<text>", "</turn>\n"


def format_chats(turns: DataFrame) -> DataFrame:
    """conv, formatted, loss array<struct<turn int, start long, chars long>>. turns: as ``canonical`` gives them."""
    order = [F.col(c).asc_nulls_first() for c in ("ord", "seq", "role", "text")]
    chunks = turns.select(
        "conv", "ord", "seq", "role", "text",
        F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(TEXT), escaped(F.col("text")), F.lit(END)).alias("chunk"),
        (F.length(escaped(F.col("role"))) + len(TURN) + len(TEXT)).alias("lead"),
    )
    by = Window.partitionBy("conv").orderBy(*order)
    placed = chunks.withColumn("n", F.row_number().over(by) - 1).withColumn("at", F.coalesce(F.sum(F.length("chunk")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    span = F.when(
        F.col("role") == "assistant",
        F.struct(F.col("n").alias("turn"), (F.col("at") + F.col("lead")).cast("long").alias("start"), (F.length("chunk") - F.col("lead") - len(END)).cast("long").alias("chars")),
    )
    whole = placed.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("n", "chunk"))).alias("__c"), F.sort_array(F.collect_list(span)).alias("loss"))
    return whole.select("conv", F.array_join(F.transform("__c", lambda x: x["chunk"]), "").alias("formatted"), "loss")


def read_back(formatted: DataFrame) -> DataFrame:
    """conv, turns array<struct<role, text>>, loss_text: from ``formatted`` and ``loss`` alone."""
    chunks = formatted.select("conv", "formatted", "loss", F.filter(F.split("formatted", f"(?<={END})", -1), lambda x: x != "").alias("__c"))
    starts = chunks.withColumn("__len", F.transform("__c", lambda x: F.length(x)))
    parts = starts.withColumn("__p", F.transform("__c", lambda x: F.split(F.substring(x, len(TURN) + 1, F.length(x) - len(TURN) - len(END)), TEXT, 2)))
    # A span lies in its turn's chunk, so it is cut out of that chunk, at its distance from the chunk's end of markers.
    covered = F.transform("loss", lambda s: F.substring(F.get("__c", s["turn"]), (F.get("__len", s["turn"]) - len(END) - s["chars"] + 1).cast("int"), s["chars"].cast("int")))
    return parts.select(
        "conv", "formatted",
        F.transform("__p", lambda x: F.struct(unescaped(F.get(x, F.lit(0))).alias("role"), unescaped(F.get(x, F.lit(1))).alias("text"))).alias("turns"),
        unescaped(F.array_join(covered, "")).alias("loss_text"),
    )


def chat_digest(back: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of what ``read_back`` found."""
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(
        F.col("conv").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
