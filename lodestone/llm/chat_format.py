"""Operator 4, chat formatting [native]: schema fingerprints choose declarative mappings to canonical turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, END = "<|im_start|>", "<|im_end|>"
#: Strings that chat templates or tokenizers read as control marks; inside texts they are escaped.
CONTROL = (TURN, END, "<|endoftext|>", "</s>", "<s>", "[INST]", "[/INST]", "<</SYS>>", "<<SYS>>")
TURNS = "array<struct<role:string,text:string>>"

#: Layout name -> (nested field paths that identify it, canonical turns as SQL over a VARIANT ``_chat_v``).
LAYOUTS: dict[str, tuple[tuple[str, ...], str]] = {
    "messages": (("messages[].content", "messages[].role"), "transform(cast(variant_get(_chat_v,'$.messages','array<struct<role:string,content:string>>') as array<struct<role:string,content:string>>), m -> named_struct('role', m.role, 'text', m.content))"),
    "conversations": (("conversations[].from", "conversations[].value"), "transform(variant_get(_chat_v,'$.conversations','array<struct<from:string,value:string>>'), m -> named_struct('role', case m.from when 'human' then 'user' when 'gpt' then 'assistant' else m.from end, 'text', m.value))"),
    "instruction_input": (("input", "instruction", "output"), "array(named_struct('role','user','text',concat(coalesce(variant_get(_chat_v,'$.instruction','string'),''), case when coalesce(variant_get(_chat_v,'$.input','string'),'') = '' then '' else concat('\\n\\n', variant_get(_chat_v,'$.input','string')) end)), named_struct('role','assistant','text',variant_get(_chat_v,'$.output','string')))"),
    "instruction": (("instruction", "output"), "array(named_struct('role','user','text',variant_get(_chat_v,'$.instruction','string')), named_struct('role','assistant','text',variant_get(_chat_v,'$.output','string')))"),
    "prompt_response": (("prompt", "response"), "array(named_struct('role','user','text',variant_get(_chat_v,'$.prompt','string')), named_struct('role','assistant','text',variant_get(_chat_v,'$.response','string')))"),
    "prompt_completion": (("completion", "prompt"), "array(named_struct('role','user','text',variant_get(_chat_v,'$.prompt','string')), named_struct('role','assistant','text',variant_get(_chat_v,'$.completion','string')))"),
    "rows_text": (("rows[].role", "rows[].text"), "variant_get(_chat_v,'$.rows','array<struct<role:string,text:string>>')"),
    "rows_content": (("rows[].content", "rows[].role"), "transform(variant_get(_chat_v,'$.rows','array<struct<role:string,content:string>>'), m -> named_struct('role', m.role, 'text', m.content))"),
    "rows_value": (("rows[].from", "rows[].value"), "transform(variant_get(_chat_v,'$.rows','array<struct<from:string,value:string>>'), m -> named_struct('role', case m.from when 'human' then 'user' when 'gpt' then 'assistant' else m.from end, 'text', m.value))"),
}
#: Fields that hold arrays of turns.
ARRAYS = ("messages", "conversations", "rows")


def fingerprint(paths: Column) -> Column:
    """Hash of the sorted distinct nested field paths."""
    return F.xxhash64(F.array_join(F.array_sort(F.array_distinct(paths)), "|"))


def selects(paths: Column, known: tuple[str, ...]) -> Column:
    """Whether the paths choose the mapping of the ``known`` ones: the hash of those it knows is its own; others do not matter."""
    known = F.array(*map(F.lit, known))
    return fingerprint(F.array_intersect(paths, known)) == fingerprint(known)


def variant_paths() -> Column:
    """Nested field paths of the VARIANT objects in ``_chat_v`` that LAYOUTS knows: top-level keys and keys of objects in arrays.

    The two levels are read with JVM functions; a value that is no object has no paths. All elements of an
    array count; an empty array has all the paths known below it, one with anything but objects and nulls none.
    """
    empty = F.array().cast("array<string>")
    top = F.coalesce(F.expr("map_keys(try_variant_get(_chat_v, '$', 'map<string,variant>'))"), empty)

    def nested(k):
        items = F.expr(f"try_variant_get(_chat_v, '$.{k}', 'array<map<string,variant>>')")
        keys = F.flatten(F.transform(F.filter(items, lambda m: m.isNotNull()), F.map_keys))
        known = sorted({p for paths, _ in LAYOUTS.values() for p in paths if p.startswith(f"{k}[].")})
        return F.when(F.size(items) == 0, F.array(*map(F.lit, known))).otherwise(F.transform(keys, lambda x: F.concat(F.lit(f"{k}[]."), x)))

    parts = [F.coalesce(nested(k), empty) for k in ARRAYS]
    return F.concat(F.filter(top, lambda k: ~k.isin(*ARRAYS)), *parts)


def uniform(known: tuple[str, ...]) -> Column:
    """Whether each element of the array that the ``known`` paths lie in has one of them; true for paths of no array.

    An array that mixes layouts is read by no mapping, so that no element is lost.
    """
    root, array, _ = known[0].partition("[].")
    if not array:
        return F.lit(True)
    keys = ", ".join(f"'{p.removeprefix(root + '[].')}'" for p in known)
    return F.expr(f"coalesce(forall(try_variant_get(_chat_v, '$.{root}', 'array<map<string,variant>>'), m -> m is null or arrays_overlap(map_keys(m), array({keys}))), true)")


def canonical_turns(records: DataFrame, json: str = "record") -> DataFrame:
    """Adds ``layout`` and ``turns`` (role, text) to rows of records of mixed layouts, JSON strings or VARIANTs.

    The mapping is picked per row by the fingerprint of its nested field paths, restricted to those that the
    mapping knows; further keys are ignored, and of several mappings the first in LAYOUTS is taken. Records
    that match no mapping or mix several in one array, null and malformed JSON stay with layout null and null turns; see ``unmatched``.
    """
    parsed = F.col(f"`{json}`") if records.schema[json].dataType.typeName() == "variant" else F.expr(f"try_parse_json(`{json}`)")
    rows = records.drop("layout", "turns").withColumn("_chat_v", parsed)
    rows = rows.withColumn("_chat_paths", variant_paths())
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for name, (paths, sql) in reversed(LAYOUTS.items()):
        hit = selects(F.col("_chat_paths"), paths) & uniform(paths)
        layout, turns = F.when(hit, F.lit(name)).otherwise(layout), F.when(hit, F.expr(sql).cast(TURNS)).otherwise(turns)
    return rows.withColumn("layout", layout).withColumn("turns", turns).drop("_chat_v", "_chat_paths")


def unmatched(canonical: DataFrame) -> DataFrame:
    """The rows of ``canonical_turns`` that no mapping reads, as they came, to be written out and looked at."""
    return canonical.where("layout is null").drop("layout", "turns")


#: Column layouts of tables with one row per turn: sorted field paths -> (conversation, order, role, text) columns.
TABLES = {
    ("conv_id", "role", "text", "turn"): ("conv_id", "turn", "role", "text"),
    ("conversation_id", "message_index", "role", "content"): ("conversation_id", "message_index", "role", "content"),
    ("dialog", "from", "position", "value"): ("dialog", "position", "from", "value"),
}


def turns_from_table(df: DataFrame) -> DataFrame:
    """``(conv_id, turns)`` from a table with a row per turn.

    The fingerprint of the table's fields chooses the columns that hold conversation and order; each
    conversation becomes a record with its turns under their own field names, and the fingerprint of the
    record's nested paths chooses the mapping to canonical turns, as in ``canonical_turns``. Turns are ordered by turn (nulls first), then role, then text; repeated rows stay. Null role or text is
    empty; rows with a null id form one conversation; further columns are ignored.
    """
    # all rows of a table have the same paths, so one lookup serves them all
    paths = F.array(*map(F.lit, df.columns))
    hits = df.sparkSession.range(1).select(*(selects(paths, fields).alias(str(i)) for i, fields in enumerate(TABLES))).first()
    chosen = [columns for columns, hit in zip(TABLES.values(), hits, strict=True) if hit]
    if not chosen:
        raise ValueError(f"no mapping for the fields {sorted(df.columns)}")
    conv, order, role, text = chosen[0]
    row = F.struct(F.col(order).alias("o"), F.coalesce(role, F.lit("")).alias(role), F.coalesce(text, F.lit("")).alias(text))
    rows = df.select(F.col(conv).alias("conv_id"), row.alias("r")).groupBy("conv_id").agg(F.sort_array(F.collect_list("r")).alias("rs"))
    bare = F.transform("rs", lambda r: F.struct(r[role].alias(role), r[text].alias(text)))
    records = rows.select("conv_id", F.to_variant_object(F.struct(bare.alias("rows"))).alias("record"))
    return canonical_turns(records).select("conv_id", "turns")


def escape(text: Column) -> Column:
    """Doubles backslashes and puts one behind the first character of every control string; ``unescape`` reverts it."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chat(df: DataFrame, turns: str = "turns", loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Adds ``formatted`` (one string) and ``loss_mask`` (per turn: masked text or not) to canonical turns.

    Template per turn: ``<|im_start|>`` role ``\\n`` text ``<|im_end|>\\n``. Roles are URL-encoded and texts
    escaped, so any string can be read back. Null turns give null; no turns give an empty string.
    """
    piece = lambda t: F.concat(F.lit(TURN), F.url_encode(F.coalesce(t["role"], F.lit(""))), F.lit("\n"), escape(F.coalesce(t["text"], F.lit(""))), F.lit(END + "\n"))
    mask = F.transform(turns, lambda t: F.coalesce(t["role"], F.lit("")).isin(*loss_roles))
    return df.withColumn("formatted", F.array_join(F.transform(turns, piece), "")).withColumn("loss_mask", mask)


def read_chat(df: DataFrame, formatted: str = "formatted") -> DataFrame:
    """Adds ``turns_read`` (role, text), parsed from the formatted string alone."""
    bare = F.regexp_replace(F.col(formatted), r"\Q" + END + r"\E\n\z", "")
    parts = F.when(F.length(formatted) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, r"\Q" + END + r"\E\n", -1))

    def turn(p):
        head = F.regexp_extract(p, r"\A\Q" + TURN + r"\E([^\n]*)\n", 1)
        return F.struct(F.url_decode(head).alias("role"), unescape(F.substr(p, F.length(head) + len(TURN) + 2)).alias("text"))

    return df.withColumn("turns_read", F.transform(parts, turn))


def op4_chat_formatting(spark, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted and read back; see the column names."""
    said = "</s>[INST] ok [/INST]"
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.sql("select -7L conv_id, i turn, if(i = 0, 'user', 'assistant') role, '" + said + "' text from (select explode(array(0L, 1L)) i)")
    done = read_chat(format_chat(turns_from_table(rows.union(extra))))
    whole = F.array_join(F.transform("turns_read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.expr("array_join(transform(filter(arrays_zip(turns_read, loss_mask), x -> x.loss_mask), x -> x.turns_read.text), '')")
    done = done.select("conv_id", F.size("turns_read").cast("bigint").alias("n_turns"), whole.alias("w"), loss.alias("l"), F.length("formatted").cast("bigint").alias("formatted_chars"))
    digest = lambda c: F.sha2(F.encode(F.col(c), "UTF-8"), 256)
    return done.select("conv_id", "n_turns", digest("w").alias("turns_sha256"), F.length("l").cast("bigint").alias("loss_chars"), digest("l").alias("loss_sha256"), "formatted_chars")


def _oracle() -> str:
    quote = lambda s: "'" + s + "'"
    e = r"replace(t, '\', '\\')"
    for c in CONTROL:
        e = f"replace({e}, {quote(c)}, {quote(c[0] + chr(92) + c[1:])})"
    return f"""
with rows_ as (select conv_id, turn, coalesce(role,'') r, coalesce(text,'') t from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]')
select conv_id, count(*)::bigint n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' order by turn nulls first, r, t)) turns_sha256,
  coalesce(sum(case when r = 'assistant' then length(t) end), 0)::bigint loss_chars,
  sha256(coalesce(string_agg(t, '' order by turn nulls first, r, t) filter (r = 'assistant'), '')) loss_sha256,
  sum({len(TURN) + len(END) + 2} + length(r) + length({e}))::bigint formatted_chars
from rows_ group by conv_id"""


QUERIES = {"op4_chat_formatting": op4_chat_formatting}
ORACLES = {"op4_chat_formatting": _oracle()}
