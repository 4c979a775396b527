"""Chat formatting by schema fingerprints.

A record is a JSON text in any of many layouts.  Its nested field paths, without their scalar types, are hashed to a
fingerprint; the fingerprint selects a declarative mapping, which says in SQL how the layout's fields become canonical
turns (role, text).  Parsing, fingerprints and mappings all run in the JVM.
"""

from __future__ import annotations

import itertools
import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import fresh, table

TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """A layout: an example with all required fields, optional fields with examples, and the mapping.

    ``schema`` is what ``from_json`` reads, as ``r``; ``turns`` an SQL expression over ``r`` that gives an array of
    (role, text), in which nulls are left out.
    """

    name: str
    example: dict
    schema: str
    turns: str
    optional: dict = field(default_factory=dict)

    def examples(self) -> list[tuple[dict, bool]]:
        """The example with each subset of the optional fields, and each of these with empty lists, marked True."""
        keys = list(self.optional)
        some = [self.example | {k: self.optional[k] for k in ks} for n in range(len(keys) + 1) for ks in itertools.combinations(keys, n)]
        return [(e, False) for e in some] + [({k: [] if isinstance(v, list) else v for k, v in e.items()}, True) for e in some if any(isinstance(v, list) for v in e.values())]


_META = {"id": "x", "source": "x"}
_SYSTEM = "named_struct('role', 'system', 'text', r.system)"

LAYOUTS = [
    Layout("messages", {"messages": [{"role": "x", "content": "x"}]}, "struct<messages:array<struct<role:string,content:string>>>", "transform(r.messages, m -> named_struct('role', m.role, 'text', m.content))", _META),
    Layout("parts", {"messages": [{"role": "x", "content": [{"text": "x", "type": "text"}]}]}, "struct<messages:array<struct<role:string,content:array<struct<type:string,text:string>>>>>", "transform(r.messages, m -> named_struct('role', m.role, 'text', array_join(transform(filter(m.content, p -> p.type = 'text'), p -> p.text), '')))", _META),
    Layout("from_value", {"conversations": [{"from": "x", "value": "x"}]}, "struct<system:string,conversations:array<struct<`from`:string,value:string>>>", f"concat(array({_SYSTEM}), transform(r.conversations, m -> named_struct('role', m.`from`, 'text', m.value)))", _META | {"system": "x"}),
    Layout("dialogue", {"dialogue": {"turns": [{"speaker": "x", "utterance": "x"}]}}, "struct<dialogue:struct<turns:array<struct<speaker:string,utterance:string>>>>", "transform(r.dialogue.turns, m -> named_struct('role', m.speaker, 'text', m.utterance))", _META),
    Layout("history", {"history": [["x", "x"]], "query": "x"}, "struct<system:string,history:array<array<string>>,query:string,response:string>", f"concat(array({_SYSTEM}), flatten(transform(r.history, h -> array(named_struct('role', 'user', 'text', h[0]), named_struct('role', 'assistant', 'text', h[1])))), array(named_struct('role', 'user', 'text', r.query), named_struct('role', 'assistant', 'text', r.response)))", {"response": "x", "system": "x"} | _META),
    Layout("instruction", {"instruction": "x", "output": "x"}, "struct<system:string,instruction:string,input:string,output:string>", f"array({_SYSTEM}, named_struct('role', 'user', 'text', concat(r.instruction, if(coalesce(r.input, '') = '', '', concat('\\n', r.input)))), named_struct('role', 'assistant', 'text', r.output))", {"input": "x", "system": "x"} | _META),
    Layout("prompt", {"prompt": "x", "completion": "x"}, "struct<prompt:string,completion:string>", "array(named_struct('role', 'user', 'text', r.prompt), named_struct('role', 'assistant', 'text', r.completion))", _META),
    Layout("question", {"question": "x", "answer": "x"}, "struct<system:string,question:string,answer:string>", f"array({_SYSTEM}, named_struct('role', 'user', 'text', r.question), named_struct('role', 'assistant', 'text', r.answer))", {"system": "x"} | _META),
]

_ROLES = {"user": ("user", "human", "prompter", "customer", "instruction"), "assistant": ("assistant", "gpt", "bot", "model", "chatbot", "ai"), "system": ("system", "developer")}


def field_paths(raw: Column | str) -> Column:
    """The nested field paths of a JSON text as one text, without scalar types; null if it isn't JSON."""
    shape = F.schema_of_variant(F.try_parse_json(raw))
    return F.regexp_replace(shape, "\\b(STRING|VOID|BIGINT|DOUBLE|FLOAT|BOOLEAN|DATE|TIMESTAMP_NTZ|TIMESTAMP|BINARY|DECIMAL\\([0-9]+,[0-9]+\\))(?=[,>]|$)", "~")


def fingerprint(raw: Column | str) -> Column:
    """A 64-bit hash of the field paths; null if the text isn't JSON."""
    paths = field_paths(raw)
    return F.when(paths.isNotNull(), F.xxhash64(paths))


def mappings(spark: SparkSession, layouts: list[Layout]) -> dict[int, str]:
    """Layout names by fingerprint, of all the layouts' examples; two layouts with one fingerprint are an error.

    Where layouts differ in nothing but the contents of an empty list, the first of them stands for all.
    """
    rows = sorted(((x.name, json.dumps(e), empty) for x in layouts for e, empty in x.examples()), key=lambda r: r[2])
    found: dict[int, str] = {}
    for name, empty, fp in spark.createDataFrame(rows, "name string, raw string, empty boolean").select("name", "empty", fingerprint("raw")).collect():
        if found.setdefault(fp, name) != name and not empty:
            raise ValueError(f"layouts {found[fp]} and {name} can't be told apart")
    return found


def canonical(records: DataFrame, raw: str = "raw", layouts: list[Layout] = LAYOUTS, into: str = "turns") -> DataFrame:
    """``records`` with ``layout``, ``fingerprint`` and ``into``, an array of (role, text).

    Roles are trimmed, lower-cased and mapped to user, assistant and system; other names stay; a null role is 'unknown'.
    Turns whose text is null are left out, empty texts stay.  Texts that aren't JSON have a null fingerprint; those and
    unknown layouts have null layout and turns, and keep their row.  Fields that a mapping doesn't name, but that no
    example has either, make an unknown layout: its fingerprint tells which mapping to declare.  Columns with the names of
    the three new ones are replaced, all others kept.  Repeated records are rows each; texts are whole, however long; an empty table stays empty.
    """
    known = mappings(records.sparkSession, layouts)
    named = F.create_map(*[F.lit(x) for fp, n in known.items() for x in (fp, n)])
    fp, name = fresh(records, "fp"), fresh(records, "name")
    df = records.withColumn(fp, fingerprint(raw)).withColumn(name, F.try_element_at(named, F.col(fp)))
    turns: Column | None = None
    for x in layouts:
        # one parse a record: the branch of its layout
        e = F.expr(f"element_at(transform(array(from_json({_q(raw)}, '{x.schema}')), r -> {x.turns}), 1)").cast(TURNS)
        turns = F.when(F.col(name) == x.name, e) if turns is None else turns.when(F.col(name) == x.name, e)

    def clean(t: Column) -> Column:
        r = F.lower(F.trim(t["role"]))
        out = F.when(r.isNull(), F.lit("unknown"))
        for name, aliases in _ROLES.items():
            out = out.when(r.isin(*aliases), F.lit(name))
        return F.struct(out.otherwise(r).alias("role"), t["text"].alias("text"))

    made = F.transform(F.filter(turns, lambda t: t["text"].isNotNull()), clean)
    return df.withColumn(into, made).withColumn("layout", F.col(name)).withColumn("fingerprint", F.col(fp)).drop(fp, name)


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def as_collected(conversations: DataFrame) -> DataFrame:
    """(conv_id, raw): each conversation as one JSON record in the layout of one of seven publishers.

    The publisher comes from the id's hash; layouts that can only hold some sequences of roles are used where they can
    hold this one, else the record has ``messages``.  Turns are in the order of (turn, role, text).
    """
    by = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    roles = F.array_join(F.transform("t", lambda t: F.substring(F.coalesce(t["role"], F.lit("x")), 1, 1)), "")
    whole = ~F.exists("t", lambda t: t["text"].isNull() | ~F.coalesce(t["role"], F.lit("")).isin("user", "assistant", "system"))
    kind = F.pmod(F.xxhash64("conv_id"), F.lit(7))
    b = by.select("conv_id", "t", kind.alias("k"), F.when(whole, roles).otherwise("").alias("s"))

    def record(**fields: Column) -> Column:
        return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]), {"ignoreNullFields": "false"})

    other = {"user": "human", "assistant": "gpt"}

    def renamed(r: Column) -> Column:
        return F.when(r == "user", other["user"]).when(r == "assistant", other["assistant"]).otherwise(r)

    n = F.when(F.col("s").startswith("s"), 1).otherwise(0)
    system = F.when(n == 1, F.element_at("t", 1)["text"])
    rest = F.slice("t", n + 1, F.size("t"))
    pairs = F.expr("transform(sequence(1, cast(size(rest) div 2 as int)), i -> array(rest[2 * i - 2].text, rest[2 * i - 1].text))")
    b = b.withColumn("rest", rest).withColumn("system", system)
    shown = F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))
    raw = (
        F.when(F.col("k") == 1, record(conversations=F.transform("t", lambda t: F.struct(renamed(t["role"]).alias("from"), t["text"].alias("value")))))
        .when(F.col("k") == 2, record(dialogue=F.struct(F.transform("t", lambda t: F.struct(t["role"].alias("speaker"), t["text"].alias("utterance"))).alias("turns"))))
        .when((F.col("k") == 3) & ~F.exists("t", lambda t: t["text"].isNull()), record(messages=F.transform("t", lambda t: F.struct(t["role"].alias("role"), F.array(F.struct(F.lit("text").alias("type"), t["text"].alias("text"))).alias("content")))))
        .when((F.col("k") == 4) & F.col("s").rlike("^s?(ua)+u$"), record(system=F.col("system"), history=pairs, query=F.element_at("rest", -1)["text"]))
        .when((F.col("k") == 5) & F.col("s").rlike("^s?ua$"), record(system=F.col("system"), instruction=F.col("rest")[0]["text"], input=F.lit(""), output=F.col("rest")[1]["text"]))
        .when((F.col("k") == 6) & (F.col("s") == "ua"), record(prompt=F.col("rest")[0]["text"], completion=F.col("rest")[1]["text"]))
        .otherwise(record(messages=shown))
    )
    return b.select("conv_id", raw.alias("raw"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, collected in seven layouts, as canonical turns again: (conv_id, turn, role, text)."""
    records = as_collected(table(spark, sf_dir, "conversations"))
    return canonical(records).select("conv_id", F.posexplode("turns").alias("turn", "t")).select("conv_id", "turn", "t.role", "t.text")


OP5_SQL = """SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1)::INTEGER AS turn,
  CASE WHEN role IS NULL THEN 'unknown' WHEN lower(trim(role)) IN ('human', 'prompter', 'customer', 'instruction') THEN 'user'
    WHEN lower(trim(role)) IN ('gpt', 'bot', 'model', 'chatbot', 'ai') THEN 'assistant' WHEN lower(trim(role)) = 'developer' THEN 'system' ELSE lower(trim(role)) END AS role, text
FROM conversations WHERE text IS NOT NULL"""
