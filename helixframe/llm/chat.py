"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs, sorted by turn, merged where neighbours share a role,
and concatenated. The template, with its control strings:

    <s>                                       opens a conversation
    <|role:NAME|>TEXT<|sep|>TEXT</s>          one block of merged turns; ``<|sep|>`` parts the turns in it

A text or role is escaped so that no control string can occur inside: every ``<``, ``[`` and ``\\`` (in a role ``|`` too) gets a backslash
before it. All control strings start with an unescaped ``<``, so nothing in a text can look like one, whatever
it says (``</s>[INST]`` included). The loss mask is a list of (start, length) spans of the formatted string,
in characters (code points), that cover the escaped text of each assistant turn and nothing else.

A conversation may hold very many turns, so turns are collected in two steps: first by conversation and
block of ``CHUNK`` turns, then by conversation over slices of those chunks; the work is linear in the turns. What is formatted is one string,
so a conversation may have no more than 2 GB.

Edge cases: null text is empty; a null role is the empty role; null turn sorts first; equal turns are ordered
by role, then text; repeated rows each count; a null conv_id is a conversation of its own; a table that holds conv_id -1 itself has the rows of
``with_probe`` added to that conversation; other columns of the input are ignored; an empty table gives no conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 64
#: Characters of a window in which loss spans are looked up.
READ = 4096
OPEN, SEP, CLOSE = "<s>", "<|sep|>", "</s>"
HEAD_L, HEAD_R = "<|role:", "|>"
LOSS_ROLE = "assistant"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\<")), F.lit("["), F.lit("\\["))


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("|"), F.lit("\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def sorted_slices(rows: DataFrame) -> DataFrame:
    """conv_id, chunk, slice and turns: an array of at most CHUNK (role, text) in order; slices follow each other by (chunk, slice)."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    turn = F.col("turn").cast("long")
    chunks = (
        rows.select("conv_id", F.floor(turn / CHUNK).alias("chunk"), F.struct(turn.alias("turn"), role.alias("role"), text.alias("text")).alias("t"))
        .groupBy("conv_id", "chunk")
        .agg(F.sort_array(F.collect_list("t")).alias("turns"))
    )
    starts = F.sequence(F.lit(0), F.floor((F.size("turns") - 1) / CHUNK).cast("int"))
    cut = F.transform(starts, lambda k: F.transform(F.slice("turns", k * CHUNK + 1, CHUNK), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))
    return chunks.select("conv_id", "chunk", F.posexplode(cut).alias("slice", "turns"))


def formatted(rows: DataFrame) -> DataFrame:
    """conv_id, ``formatted`` and ``loss_spans`` (array of start and length, from 0).

    Neighbours of one role are merged by array aggregation: a turn opens a block where its role differs from the
    turn before. The pieces of a slice are laid one after another, the running sum of
    their lengths gives the spans; where a slice begins follows from the running sum over the slices before. So work grows with the number of turns.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("chunk").asc_nulls_first(), "slice")
    slices = sorted_slices(rows).withColumn("before", F.lag(F.element_at("turns", -1)["role"]).over(order))
    previous = lambda i: F.when(i == 0, F.col("before")).otherwise(F.get("turns", F.when(i > 0, i - 1))["role"])
    head = lambda t, i: F.concat(F.when(previous(i).isNull(), F.lit(OPEN)).otherwise(F.lit(CLOSE)), F.lit(HEAD_L), escaped_role(t["role"]), F.lit(HEAD_R))
    laid = slices.select(
        "conv_id", "chunk", "slice",
        F.transform(
            "turns",
            lambda t, i: F.struct(
                F.when(previous(i).isNull() | (previous(i) != t["role"]), head(t, i)).otherwise(F.lit(SEP)).alias("mark"),
                escaped(t["text"]).alias("body"),
                (t["role"] == LOSS_ROLE).alias("loss"),
            ),
        ).alias("turns"),
    )
    size = lambda t: (F.length(t["mark"]) + F.length(t["body"])).cast("long")
    laid = laid.select("*", F.aggregate("turns", F.lit(0).cast("long"), lambda n, t: n + size(t)).alias("n"))
    laid = laid.withColumn("at", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    # A slice has CHUNK turns at most, so its own running sums may be made anew for each turn.
    begin = lambda i: F.aggregate(F.slice("turns", F.lit(1), i), F.col("at"), lambda n, x: n + size(x))
    spans = F.transform("turns", lambda t, i: F.struct((begin(i) + F.length(t["mark"])).alias("start"), F.length(t["body"]).cast("long").alias("length"), t["loss"].alias("loss")))
    spans = F.transform(F.filter(spans, lambda x: x["loss"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["mark"], t["body"])), "")
    pieces = laid.select("conv_id", F.struct("at", text.alias("text"), spans.alias("spans")).alias("p"))
    whole = pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list("p")).alias("p"))
    return whole.select("conv_id", F.concat(F.array_join("p.text", ""), F.lit(CLOSE)).alias("formatted"), F.flatten("p.spans").alias("loss_spans"))


def parsed(chats: DataFrame) -> DataFrame:
    """Read formatted strings back: conv_id, turns (role, text) and the unescaped text under the loss mask."""
    # An unescaped "<" opens a control string. Possessive repeats keep the matcher off the stack on long texts.
    role, body = r"<\|role:((?:[^|\\]|\\.)*+)\|>", r"(?:[^<\\]|\\.)*+"
    blocks = F.regexp_extract_all("formatted", F.lit(rf"(?s){role}(?:[^<\\]|\\.|<\|sep\|>)*+"), F.lit(0))
    texts = lambda b: F.regexp_extract_all(F.regexp_replace(b, f"(?s)^{role}", SEP), F.lit(rf"(?s)<\|sep\|>({body})"), F.lit(1))
    # A block's role is read once, not for each of its turns.
    read_blocks = F.transform(blocks, lambda b: F.struct(unescaped(F.regexp_extract(b, f"(?s)^{role}", 1)).alias("role"), texts(b).alias("texts")))
    split = F.transform(read_blocks, lambda b: F.transform(b["texts"], lambda t: F.struct(b["role"].alias("role"), unescaped(t).alias("text"))))
    # Spans are read from windows of the string, so none is searched for from its beginning.
    windows = F.regexp_extract_all("formatted", F.lit(f"(?s).{{1,{READ}}}"), F.lit(0))
    # Behind a generator the windows are made once, not inside the expression that reads them.
    cut = chats.select("conv_id", "formatted", "loss_spans", F.explode(F.array(windows)).alias("windows"))

    def read(s: Column) -> Column:
        stop = s["start"] + s["length"]
        at = F.sequence(F.floor(s["start"] / READ), F.floor((stop - 1) / READ))
        part = lambda w: F.substring(F.get("windows", w.cast("int")), (F.greatest(s["start"] - w * READ, F.lit(0)) + 1).cast("int"), (F.least(stop, (w + 1) * READ) - F.greatest(s["start"], w * READ)).cast("int"))
        return F.when(s["length"] > 0, F.array_join(F.transform(at, part), "")).otherwise("")

    loss = F.array_join(F.transform("loss_spans", lambda s: unescaped(read(s))), "")
    return cut.select("conv_id", F.flatten(split).alias("turns"), loss.alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))


def digest(chats: DataFrame) -> DataFrame:
    """What a reader gets back from formatted conversations, as counts and digests."""
    back = parsed(chats)
    listed = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(listed, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


#: A conversation whose texts imitate control strings of other templates.
PROBE = "</s>[INST] ok [/INST]"


def with_probe(rows: DataFrame) -> DataFrame:
    probe = rows.sparkSession.range(1).select(
        F.explode(F.array(F.struct(F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role")), F.struct(F.lit(1).cast("long").alias("turn"), F.lit("assistant").alias("role")))).alias("t")
    )
    return rows.select("conv_id", "turn", "role", "text").unionByName(probe.select(F.lit(-1).cast("long").alias("conv_id"), "t.turn", "t.role", F.lit(PROBE).alias("text")))


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
m AS (
  SELECT *, coalesce(lag(role) OVER w <> role, true) AS opens, row_number() OVER w AS k,
         length(replace(replace(replace(text, '\', '\\'), '<', '\<'), '[', '\[')) AS n,
         length(replace(replace(replace(replace(role, '\', '\\'), '<', '\<'), '[', '\['), '|', '\|')) AS r
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       cast(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS bigint) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       cast(3 + sum(n + CASE WHEN opens THEN 9 + r + 4 ELSE 7 END) AS bigint) AS formatted_chars
FROM m GROUP BY conv_id
"""
