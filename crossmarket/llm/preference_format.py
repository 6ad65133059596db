"""Preference formatting, in Spark expressions alone.

A chosen and a rejected conversation share their leading turns as far as role and text are equal. That
prefix is rendered once as the prompt; what follows in either is its completion, with the spans of the
assistant's words (and their end mark) that count for the loss. Everything else is masked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

END = "<|end|>\n"


def conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                  text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id and its turns (role, text) in order.

    Turns without a conversation id are left out. A missing role is `user`, a missing text empty. Turns are
    ordered by number, then role and text; rows that repeat a turn exactly count once. A conversation is
    one output row, so its turns meet in one task.
    """
    turn = F.struct(F.col(f"`{turn_col}`").alias("turn"),
                    F.coalesce(F.col(f"`{role_col}`"), F.lit("user")).alias("role"),
                    F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return (turns.select(F.col(f"`{id_col}`").alias("conv_id"), turn.alias("t")).where("conv_id is not null")
            .groupBy("conv_id").agg(F.sort_array(F.collect_set("t")).alias("t"))
            .select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
                    .alias("turns")))


def _rendered(turn: Column) -> Column:
    """Marks of its own inside a role or text are broken up, so that they cannot pass for a turn's."""
    def plain(c: Column) -> Column:
        return F.replace(c, F.lit("<|"), F.lit("< |"))

    return F.concat(F.lit("<|"), plain(turn["role"]), F.lit("|>\n"), plain(turn["text"]), F.lit(END))


def _completion(turns: Column, start: Column) -> Column:
    """(text, spans) of the turns from number `start` on; spans are start:end in code points, comma-joined."""
    rest = F.slice(turns, start + 1, F.greatest(F.size(turns) - start, F.lit(0)))
    parts = F.transform(rest, lambda t: F.struct(_rendered(t).alias("s"), t["role"].alias("role")))

    def marked(parts: Column) -> Column:
        from_zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

        def step(done: Column, part: Column) -> Column:
            size = F.char_length(part["s"])
            head = F.char_length(part["role"]) + 5  # the mark before the text
            span = F.concat_ws(":", (done["at"] + head).cast("string"), (done["at"] + size).cast("string"))
            return F.struct((done["at"] + size).alias("at"),
                            F.when(part["role"] == "assistant", F.array_append(done["spans"], span))
                            .otherwise(done["spans"]).alias("spans"))

        return F.struct(F.array_join(F.transform(parts, lambda p: p["s"]), "").alias("text"),
                        F.aggregate(parts, from_zero, step, lambda done: F.array_join(done["spans"], ",")).alias("spans"))

    return F.element_at(F.transform(F.array(parts), marked), 1)


def format_pairs(pairs: DataFrame) -> DataFrame:
    """(chosen_id, rejected_id, chosen_turns, rejected_turns) -> prompt and masked completions.

    Equal conversations give their whole text as prompt and empty completions. A missing conversation is one
    without turns.
    """
    nothing = F.array().cast("array<struct<role:string,text:string>>")
    pairs = pairs.select("chosen_id", "rejected_id", F.coalesce("chosen_turns", nothing).alias("chosen_turns"),
                         F.coalesce("rejected_turns", nothing).alias("rejected_turns"))
    equal = F.zip_with("chosen_turns", "rejected_turns", lambda a, b: F.coalesce(
        (a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    first = F.array_position(equal, False)
    common = F.when(first == 0, F.size("chosen_turns")).otherwise(first - 1).cast("int")
    shared = pairs.withColumn("n_prompt_turns", common)
    return (shared.select(
        "chosen_id", "rejected_id", F.col("n_prompt_turns").cast("bigint").alias("n_prompt_turns"),
        F.array_join(F.transform(F.slice("chosen_turns", F.lit(1), F.col("n_prompt_turns")), _rendered), "").alias("prompt"),
        _completion(F.col("chosen_turns"), F.col("n_prompt_turns")).alias("c"),
        _completion(F.col("rejected_turns"), F.col("n_prompt_turns")).alias("r"))
        .select("chosen_id", "rejected_id", "n_prompt_turns", "prompt", F.col("c.text").alias("chosen"),
                F.col("r.text").alias("rejected"), F.col("c.spans").alias("chosen_spans"),
                F.col("r.spans").alias("rejected_spans")))


def derived_pairs(turns: DataFrame) -> DataFrame:
    """Pairs from plain conversations, for tables that carry no preference.

    Conversations with the same first turn answer the same prompt: the one with the most assistant
    characters (then the smallest id) is chosen, each other one is rejected against it. A conversation
    alone with its first turn is chosen against itself with the last reply replaced by its first one, or,
    if that is the same, by an empty reply. The chosen one is found by pre-aggregated maxima and joined
    back, so a first turn that very many conversations share is not gathered.
    """
    def replies(t: Column) -> Column:
        return F.filter(t, lambda x: x["role"] == "assistant")

    whole = conversations(turns).select(
        "conv_id", "turns", F.sha2(F.concat_ws("\n", F.get("turns", F.lit(0))["role"], F.get("turns", F.lit(0))["text"]), 256)
        .alias("opening"),
        F.aggregate(replies(F.col("turns")), F.lit(0), lambda n, x: n + F.char_length(x["text"])).alias("weight"))
    best = whole.groupBy("opening").agg(
        F.min(F.struct((-F.col("weight")).alias("lightness"), "conv_id")).alias("best"), F.count("*").alias("n"))
    best = best.select("opening", F.col("best.conv_id").alias("chosen_id"), "n")
    placed = whole.drop("weight").join(best, "opening")
    others = placed.where("n > 1 and conv_id <> chosen_id").select(
        "chosen_id", F.col("conv_id").alias("rejected_id"), F.col("turns").alias("rejected_turns"))
    chosen = placed.where("n > 1 and conv_id = chosen_id").select("chosen_id", F.col("turns").alias("chosen_turns"))
    shared = others.join(chosen, "chosen_id").select("chosen_id", "rejected_id", "chosen_turns", "rejected_turns")

    last = F.aggregate(F.transform("turns", lambda x, i: F.when(x["role"] == "assistant", i).otherwise(-1)), F.lit(-1),
                       lambda a, b: F.greatest(a, b))
    first_reply = F.get(replies(F.col("turns")), F.lit(0))["text"]
    alone = placed.where("n = 1").withColumn("_last", last).withColumn("_reply", first_reply)
    replaced = F.transform("turns", lambda x, i: F.when(
        i == F.col("_last"), F.struct(x["role"].alias("role"), F.when(x["text"] == F.col("_reply"), F.lit(""))
                                      .otherwise(F.col("_reply")).alias("text"))).otherwise(x))
    own = alone.select(F.col("conv_id").alias("chosen_id"), F.col("conv_id").alias("rejected_id"),
                       F.col("turns").alias("chosen_turns"), replaced.alias("rejected_turns"))
    return shared.unionByName(own)


ORACLE_SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text
           FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i, role, text FROM t),
o AS (SELECT conv_id, max(role || chr(10) || text) FILTER (WHERE i = 1) AS opening,
             coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS weight,
             max(i) FILTER (WHERE role = 'assistant') AS last, min(i) FILTER (WHERE role = 'assistant') AS first
      FROM n GROUP BY conv_id),
b AS (SELECT *, first_value(conv_id) OVER (PARTITION BY opening ORDER BY weight DESC, conv_id) AS chosen_id,
             count(*) OVER (PARTITION BY opening) AS m FROM o),
p AS (SELECT chosen_id, conv_id AS rejected_id, m FROM b WHERE m = 1 OR conv_id <> chosen_id),
c AS (SELECT chosen_id, rejected_id, i, role, text FROM p JOIN n ON n.conv_id = p.chosen_id),
r AS (SELECT p.chosen_id, p.rejected_id, n.i, n.role,
             CASE WHEN p.m = 1 AND n.i = b.last THEN CASE WHEN f.text = n.text THEN '' ELSE f.text END ELSE n.text END AS text
      FROM p JOIN n ON n.conv_id = p.rejected_id JOIN b ON b.conv_id = p.rejected_id
      LEFT JOIN n AS f ON f.conv_id = p.rejected_id AND f.i = b.first),
x AS (SELECT chosen_id, rejected_id, min(i) AS differs FROM
      (SELECT coalesce(c.chosen_id, r.chosen_id) AS chosen_id, coalesce(c.rejected_id, r.rejected_id) AS rejected_id,
              coalesce(c.i, r.i) AS i, c.role = r.role AND c.text = r.text AS same
       FROM c FULL JOIN r ON c.chosen_id = r.chosen_id AND c.rejected_id = r.rejected_id AND c.i = r.i)
      WHERE same IS NOT TRUE GROUP BY ALL),
s AS (SELECT 1 AS side, * FROM c UNION ALL SELECT 2 AS side, * FROM r),
q AS (SELECT s.*, coalesce(x.differs, 1000000000) AS differs,
             '<|' || replace(role, '<|', '< |') || '|>' || chr(10) || replace(text, '<|', '< |') || '<|end|>' || chr(10) AS part
      FROM s LEFT JOIN x USING (chosen_id, rejected_id)),
z AS (SELECT *, sum(length(part)) OVER (PARTITION BY side, chosen_id, rejected_id ORDER BY i) AS upto FROM q WHERE i >= differs),
done AS (SELECT side, chosen_id, rejected_id, string_agg(part, '' ORDER BY i) AS text,
                string_agg(CASE WHEN role = 'assistant' THEN (upto - length(part) + 14) || ':' || upto END, ',' ORDER BY i) AS spans
         FROM z GROUP BY ALL),
pre AS (SELECT chosen_id, rejected_id, count(*) AS n_prompt_turns, string_agg(part, '' ORDER BY i) AS prompt
        FROM q WHERE side = 1 AND i < differs GROUP BY ALL)
SELECT p.chosen_id, p.rejected_id, coalesce(n_prompt_turns, 0) AS n_prompt_turns, coalesce(prompt, '') AS prompt,
       coalesce(d1.text, '') AS chosen, coalesce(d2.text, '') AS rejected, coalesce(d1.spans, '') AS chosen_spans,
       coalesce(d2.spans, '') AS rejected_spans
FROM p LEFT JOIN pre USING (chosen_id, rejected_id)
LEFT JOIN done AS d1 ON d1.side = 1 AND d1.chosen_id = p.chosen_id AND d1.rejected_id = p.rejected_id
LEFT JOIN done AS d2 ON d2.side = 2 AND d2.chosen_id = p.chosen_id AND d2.rejected_id = p.rejected_id"""
