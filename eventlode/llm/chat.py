"""Chat formatting: one training text per conversation, with a loss mask, from Spark expressions only.

Turns are collected per conversation as structs, sorted, adjacent turns of one role are merged, and
the pieces concatenated. A merged turn keeps its parts apart by a control string, so the formatted
text can be read back turn by turn. Control strings that occur inside a text or a role are escaped
reversibly: a backslash goes in after their first character (and one more where some stand already).

Defined results: a null text or role is empty; rows are ordered by turn (null first), then role and
text; repeated rows are repeated turns; a null conversation id is a conversation of its own; an empty
table gives an empty result. The largest unit in one task is one conversation, as one text holds it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template's own marks.
START, END, PART = "<|im_start|>", "<|im_end|>", "<|im_part|>"
#: Also escaped in texts: marks of other common templates, which a tokenizer may treat as special.
FOREIGN = ["<s>", "</s>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "[INST]", "[/INST]"]

_REST = "|".join(sorted((m[1:].replace("|", "\\|").replace("]", "\\]") for m in [START, END, PART, *FOREIGN]), key=len, reverse=True))
ESCAPE = rf"([<\[])(\\*)({_REST})"
UNESCAPE = rf"([<\[])\\(\\*)({_REST})"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, r"$1$2$3")


def _role_out(role: Column) -> Column:
    """A role stands on the mark's line, so its line ends are written as %0A."""
    return escaped(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _role_in(role: Column) -> Column:
    return F.replace(F.replace(unescaped(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def format_chats(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = "assistant") -> DataFrame:
    """conv, formatted, segments (array of text and loss flag that make up formatted), n_merged.

    A segment under the loss mask is the escaped text of one turn of `loss_role`, without marks.
    """
    rows = df.select(
        F.col(conv).alias("_c"),
        F.struct(F.col(turn).alias("t"), F.coalesce(F.col(role), F.lit("")).alias("r"), F.coalesce(F.col(text), F.lit("")).alias("x")).alias("_t"),
    )
    turns = rows.groupBy("_c").agg(F.sort_array(F.collect_list("_t")).alias("_t"))
    # where a run of one role starts; a run's end is the next run's start
    first = lambda i: (i == 0) | (F.get("_t", i - 1)["r"] != F.get("_t", i)["r"])
    runs = turns.select("_c", "_t", F.filter(F.sequence(F.lit(0), F.size("_t") - 1), first).alias("_s"))

    def run(s: Column, k: Column) -> Column:
        until = F.coalesce(F.get("_s", k + 1), F.size("_t"))
        return F.struct(F.get("_t", s)["r"].alias("r"), F.transform(F.slice("_t", s + 1, until - s), lambda t: t["x"]).alias("xs"))

    merged = runs.select("_c", F.transform("_s", run).alias("_m"))

    def segment(x: Column, loss: Column) -> Column:
        return F.struct(x.alias("text"), loss.alias("loss"))

    def pieces(m: Column) -> Column:
        loss = m["r"] == loss_role
        body = F.flatten(F.transform(m["xs"], lambda x, j: F.array(segment(F.when(j == 0, F.concat(F.lit(START), _role_out(m["r"]), F.lit("\n"))).otherwise(F.lit(PART)), F.lit(False)), segment(escaped(x), loss))))
        return F.concat(body, F.array(segment(F.lit(END + "\n"), F.lit(False))))

    out = merged.select("_c", F.size("_m").alias("n_merged"), F.flatten(F.transform("_m", pieces)).alias("segments"))
    return out.select(F.col("_c").alias(conv), F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments", "n_merged")


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted text, as they were before formatting."""
    merged = F.filter(F.split(formatted, F.lit(r"<\|im_start\|>")), lambda x: x != "")

    def turns(m: Column) -> Column:
        role = _role_in(F.substring_index(m, "\n", 1))
        body = F.regexp_replace(m, r"(?s)^[^\n]*\n(.*)<\|im_end\|>\n\z", "$1")
        return F.transform(F.split(body, F.lit(r"<\|im_part\|>")), lambda x: F.struct(role.alias("role"), unescaped(x).alias("text")))

    return F.flatten(F.transform(merged, turns))


def digests(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """What can be read back from formatted texts and their masks, as lengths and digests."""
    read = formatted.select(
        F.col(conv),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.col("n_merged").cast("long").alias("n_merged"),
        read_turns(F.col("formatted")).alias("_turns"),
        F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"])), "").alias("_loss"),
    )
    return read.select(
        conv,
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("_loss"), 256).alias("loss_sha256"),
        "formatted_chars",
        "n_merged",
    )


#: The conversation that the query adds: a user, then an assistant row, both with marks of another template.
TEST_TEXT = "</s>[INST] ok [/INST]"


def oracle() -> str:
    esc = f"regexp_replace({{}}, '{ESCAPE}', '\\1\\\\\\2\\3', 'g')"
    rest = {"t": esc.format("t"), "r": esc.format("replace(replace(r, '%', '%25'), chr(10), '%0A')")}
    return f"""
    WITH a AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
      UNION ALL SELECT -7, 0, 'user', '{TEST_TEXT}' UNION ALL SELECT -7, 1, 'assistant', '{TEST_TEXT}'),
    b AS (SELECT *, row_number() OVER w AS k, coalesce(lag(r) OVER w <> r, true) AS starts FROM a WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, t)),
    c AS (SELECT *, length({rest['t']}) + CASE WHEN starts THEN {len(START) + 1 + len(END) + 1} + length({rest['r']}) ELSE {len(PART)} END AS n FROM b)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY k)) AS turns_sha256,
      coalesce(sum(CASE WHEN r = 'assistant' THEN length(t) END), 0)::BIGINT AS loss_chars,
      sha256(coalesce(string_agg(CASE WHEN r = 'assistant' THEN t END, '' ORDER BY k), '')) AS loss_sha256,
      sum(n)::BIGINT AS formatted_chars, count(*) FILTER (WHERE starts) AS n_merged
    FROM c GROUP BY conv_id"""
