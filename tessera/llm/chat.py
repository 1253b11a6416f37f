"""Chat formatting in Spark expressions only: turns are collected and sorted, adjacent turns of a role merge into a block, and
blocks are concatenated.

A block is  <s>[INST]role[/INST]text<sep>text...</s>  with a text for each of its turns. Inside roles and texts a backslash
doubles and a control string gets one after its first character, so no control string is left and every text comes back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

OPEN, HEAD, END, SEPARATOR, CLOSE = "<s>", "[INST]", "[/INST]", "<sep>", "</s>"
CONTROLS = (OPEN, CLOSE, HEAD, END, SEPARATOR)


def escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def formatted(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_mask array<struct<chars, loss>>) of rows (conv_id, turn, role, text).

    Null roles and texts are empty; a null conv_id is a conversation of its own; turns go by turn (null first), and of equal
    turns by role and text; repeated rows are turns each. The mask's runs cover the formatted text, none of them empty; the
    texts of loss_role, and nothing of the template, are under the loss."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    talks = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    kept_apart = F.transform("turns", lambda t: F.struct(escaped(t["role"]).alias("role"), escaped(t["text"]).alias("text")))
    talks = talks.select("conv_id", kept_apart.alias("turns"))
    n = F.size("turns")
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda k: (k == 0) | (F.get("turns", k)["role"] != F.get("turns", k - 1)["role"]))
    begun = talks.select("conv_id", "turns", starts.alias("starts"))
    block = lambda s, k: F.struct(
        F.get("turns", s)["role"].alias("role"),
        F.transform(F.slice("turns", s + 1, F.coalesce(F.get("starts", k + 1), n) - s), lambda t: t["text"]).alias("texts"),
    )
    merged = begun.select("conv_id", F.transform("starts", block).alias("blocks"))
    as_text = lambda b: F.concat(F.lit(OPEN + HEAD), b["role"], F.lit(END), F.array_join(b["texts"], SEPARATOR), F.lit(CLOSE))
    run = lambda chars, loss: F.struct(chars.cast("long").alias("chars"), loss.alias("loss"))

    def runs(b: Column) -> Column:
        ours = b["role"] == loss_role
        inner = F.flatten(F.transform(b["texts"], lambda t, k: F.when(k == 0, F.array(run(F.length(t), ours))).otherwise(F.array(run(F.lit(len(SEPARATOR)), F.lit(False)), run(F.length(t), ours)))))
        head = run(F.length(b["role"]) + len(OPEN + HEAD + END), F.lit(False))
        return F.concat(F.array(head), inner, F.array(run(F.lit(len(CLOSE)), F.lit(False))))

    mask = F.filter(F.flatten(F.transform("blocks", runs)), lambda r: r["chars"] > 0)
    return merged.select("conv_id", F.array_join(F.transform("blocks", as_text), "").alias("formatted"), mask.alias("loss_mask"))


def read_back(out: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role, text>>, loss string, formatted) of formatted conversations: turns are cut out of the
    text alone, the loss text is what the mask covers."""
    blocks = F.filter(F.split("formatted", CLOSE), lambda b: b != "")
    role = lambda b: unescaped(F.substring_index(F.replace(b, F.lit(OPEN + HEAD), F.lit("")), END, 1))
    texts = lambda b: F.split(F.element_at(F.split(b, r"\[/INST\]", -1), 2), SEPARATOR, -1)
    turns = F.flatten(F.transform("blocks", lambda b: F.transform(texts(b), lambda t: F.struct(role(b).alias("role"), unescaped(t).alias("text")))))
    # The runs of the mask begin and end at control strings.
    cut = F.split("formatted", r"(?=</s>)|(?<=</s>)|(?<=\[/INST\])|(?=<sep>)|(?<=<sep>)", -1)
    rows = out.select("conv_id", "formatted", "loss_mask", blocks.alias("blocks"), F.filter(cut, lambda p: p != "").alias("cut"))
    pairs = F.arrays_zip("cut", "loss_mask")
    fits = F.forall(pairs, lambda p: F.coalesce(F.length(p["cut"]) == p["loss_mask"]["chars"], F.lit(False)))
    covered = F.transform(F.filter(pairs, lambda p: p["loss_mask"]["loss"]), lambda p: unescaped(p["cut"]))
    loss = F.when(fits, F.array_join(covered, "")).otherwise(F.raise_error(F.lit("the loss mask does not fit the text")))
    return rows.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss"))


def digests(turns: DataFrame) -> DataFrame:
    """What op4 returns, of rows (conv_id, turn, role, text)."""
    back = read_back(formatted(turns))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per conversation, and conversation -1, what is read back from its formatted text. Null roles and texts are empty; a null
    conv_id is a conversation; ties go as in formatted(); without rows -1 alone is left."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return digests(rows.unionByName(extra))


_TURNS = """turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')"""
_ESCAPE = "replace({x}, '\\', '\\\\')"
for _c in CONTROLS:
    _ESCAPE = f"replace({_ESCAPE}, '{_c}', '{_c[0]}\\{_c[1:]}')"

#: The same from the rows; the formatted length adds up what the template writes.
OP4_SQL = f"""WITH {_TURNS}, marked AS (
    SELECT *, row_number() OVER w AS place, coalesce(lag(role) OVER w <> role, true) AS begins,
        length({_ESCAPE.format(x="role")}) AS role_chars, length({_ESCAPE.format(x="text")}) AS text_chars
    FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(text_chars + CASE WHEN begins THEN role_chars + {len(OPEN + HEAD + END + CLOSE)} ELSE {len(SEPARATOR)} END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id"""
