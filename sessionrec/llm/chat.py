"""Chat formatting: cumulative snapshots collapse to maximal conversations (built-in functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sessionrec.llm.common import Scratch

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def turns_with_prefixes(rows: DataFrame) -> DataFrame:
    """conv_id, i, n, role, text, a, b: each turn with its place, its conversation's length and the hash of the turns up to it.

    Turns follow turn, then role, then text (nulls last); equal rows count once; null roles and
    texts are empty. The hash after turn i combines, by running bits, the hashes of each turn with
    its place: twice 64 bits, in time linear in the turns, without holding a conversation.
    """
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    conversation = Window.partitionBy("conv_id")
    order = conversation.orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    rows = rows.withColumn("i", F.row_number().over(order)).withColumn("n", F.count(F.lit(1)).over(conversation))
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select("conv_id", "i", "n", "role", "text", *[F.bit_xor(h).over(so_far).alias(c) for c, h in zip("ab", turn_hashes(F.col("i")))])


def turn_hashes(place: Column) -> tuple[Column, Column]:
    return F.xxhash64(place, "role", "text"), F.xxhash64("text", "role", place, F.lit(7))


def rendered(role: Column, text: Column) -> Column:
    """A turn between markers; markers inside it are broken up."""
    plain = lambda c: F.replace(F.replace(c, F.lit(OPEN), F.lit("<| im_start|>")), F.lit(CLOSE), F.lit("<| im_end|>"))
    return F.concat(F.lit(OPEN), plain(role), F.lit("\n"), plain(text), F.lit(CLOSE + "\n"))


def maximal_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, n_turns, copies, formatted: a row for each conversation that no other one extends.

    Of equal conversations the smallest conv_id stays (null last) and copies counts them. A
    conversation that is a turn prefix of a longer one goes. Equal ones are gathered before
    the anti-join, so each hash is there once on either side; texts of conversations that go are
    not gathered. A row without conv_id is a conversation of one turn, as nothing tells what it
    belongs to. A very long conversation is sorted by one task and rendered as one text, which is
    its result. An empty table gives no rows; other columns are not used.
    """
    scratch = Scratch(rows.sparkSession, "chat")
    rows = rows.select("conv_id", "turn", "role", "text")
    turns = scratch.write(turns_with_prefixes(rows.where("conv_id is not null")), "turns")
    alone = rows.where("conv_id is null").groupBy(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).agg(F.count(F.lit(1)).alias("times"))
    alone = scratch.write(alone.select("role", "text", "times", *[h.alias(c) for c, h in zip("ab", turn_hashes(F.lit(1)))]), "without_id")
    whole = turns.where("i = n").select("conv_id", "n", "a", "b", F.lit(1).cast("long").alias("times"))
    whole = whole.unionByName(alone.select(F.lit(None).cast(rows.schema["conv_id"].dataType).alias("conv_id"), F.lit(1).cast("long").alias("n"), "a", "b", "times"))
    kept = whole.groupBy("n", "a", "b").agg(F.min("conv_id").alias("kept_id"), F.sum("times").alias("copies"))
    shorter = turns.where("i < n").select(F.col("i").cast("long").alias("n"), "a", "b").distinct()
    kept = scratch.write(kept.join(shorter, ["n", "a", "b"], "left_anti"), "kept")
    one = rendered(F.col("role"), F.col("text"))
    texts = turns.join(kept.select("kept_id", "copies"), F.col("conv_id") == F.col("kept_id")).groupBy("conv_id", "n", "copies").agg(F.array_sort(F.collect_list(F.struct("i", one.alias("turn")))).alias("turns"))
    out = texts.select("conv_id", F.col("n").alias("n_turns"), "copies", F.array_join(F.transform("turns", lambda x: x["turn"]), "").alias("formatted"))
    single = alone.join(kept.where("kept_id is null"), ["a", "b"]).select(F.col("kept_id").alias("conv_id"), F.col("n").alias("n_turns"), "copies", one.alias("formatted"))
    return out.unionByName(single)


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maximal_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP8_SQL = """
with t as (
  select distinct conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null
), c as (
  select conv_id, list({'r': role, 't': text} order by turn asc nulls last, role, text) as ts from t group by conv_id
  union all select null, [{'r': coalesce(role, ''), 't': coalesce(text, '')}] from conversations where conv_id is null
), k as (
  select ts, min(conv_id) as conv_id, count(*) as copies from c group by ts
), p as (
  select distinct ts[1:i] as ts from (select ts, unnest(range(1, len(ts))) as i from k)
)
select conv_id, len(ts)::bigint as n_turns, copies,
  array_to_string(list_transform(ts, lambda x: '<|im_start|>' || replace(replace(x.r, '<|im_start|>', '<| im_start|>'), '<|im_end|>', '<| im_end|>')
    || chr(10) || replace(replace(x.t, '<|im_start|>', '<| im_start|>'), '<|im_end|>', '<| im_end|>') || '<|im_end|>' || chr(10)), '') as formatted
from k where not exists (select 1 from p where p.ts = k.ts)
"""

QUERIES = {"op8_chat_format": op8_chat_format}
SQL = {"op8_chat_format": OP8_SQL}
