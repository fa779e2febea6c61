"""Audit of how filters interact: what each of them removes in every order of application."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionrec.llm.common import Scratch, read_documents, small_batches, texts_of

FILTERS = "ABCDE"
MIN_WORDS = 200
ORDERS = ["".join(p) for p in permutations(FILTERS)]
OUTCOMES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
#: Bits of a field: counts are below 2**63, so that no field runs over into the next.
BITS = 64
_CAPITALS, _SIGNS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"


def own_failures(text: str | None) -> tuple[int, bytes]:
    """(filters A to D that a whole text fails, as bits; what tells texts apart, 128 bits and the length)."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()  # words end at exactly \\x20 and \\x09-\\x0D
    mask = (len(words) < MIN_WORDS) + 2 * (100 * len(set(words)) < 50 * len(words))
    mask += 4 * (100 * (len(data) - len(data.translate(None, _CAPITALS))) > 2 * len(text or "")) + 8 * (len(data) != len(data.translate(None, _SIGNS)))
    return mask, hashlib.blake2b(data, digest_size=16).digest() + len(data).to_bytes(8, "big")


def packed_outcomes() -> dict[tuple[int, int, int], int]:
    """For each (mask of failed filters, good, toxic) one integer, with a field for each outcome of each step of each order.

    A document in it counts 1 in each field that holds for it; so sums of such integers are sums of all fields at once.
    Field k has the bits from BITS * k on; fields stand in the order of steps(), with the OUTCOMES of a step side by side.
    """
    found = {}
    for mask in range(2 ** len(FILTERS)):
        for good in (0, 1):
            for toxic in (0, 1):
                field = value = 0
                for order in ORDERS:
                    gone = False
                    for letter in order:
                        fails = bool(mask >> FILTERS.index(letter) & 1)
                        removed, gone_before, gone = fails and not gone, gone, gone or fails
                        only = fails and mask.bit_count() == 1
                        for holds in (not gone, removed, fails and gone_before, only, removed and good, removed and toxic):
                            value |= bool(holds) << BITS * field
                            field += 1
                found[mask, good, toxic] = value
    return found


def steps() -> list[tuple[str, int]]:
    return [(order, k + 1) for order in ORDERS for k in range(len(FILTERS))]


def unpacked(value: int) -> list[list[int]]:
    """The counts of OUTCOMES for each of steps()."""
    n = len(OUTCOMES)
    data = value.to_bytes(BITS // 8 * n * len(ORDERS) * len(FILTERS), "little")
    fields = [int.from_bytes(data[k : k + BITS // 8], "little") for k in range(0, len(data), BITS // 8)]
    return [fields[k : k + n] for k in range(0, len(fields), n)]


ROW_ARROW = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("own", pa.int32()), ("key", pa.binary())])
ROW_SCHEMA = "doc_id long, part string, own int, key binary"
OUT_SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
OUT_ARROW = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *((c, pa.int64()) for c in (*OUTCOMES, "shapley"))])


def measured(batches: Iterator) -> Iterator:
    for batch, texts in texts_of(batches):
        own, key = zip(*map(own_failures, texts)) if texts else ((), ())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(own, type=pa.int32()), pa.array(key, type=pa.binary())], schema=ROW_ARROW)


def summed(outcomes: dict[tuple[int, int, int], int]):
    """Rows of one part (a mask's documents each, some 128 at most) to the part's 600 rows."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        counts = unpacked(sum(outcomes[r["mask"], r["good"], r["toxic"]] * r["n"] for r in rows))
        removed = OUTCOMES.index("removed")
        shapley = dict.fromkeys(FILTERS, 0)
        for (order, step), values in zip(steps(), counts):
            shapley[order[step - 1]] += values[removed]
        out = [(rows[0]["part"], order, step, *values, shapley[order[step - 1]]) for (order, step), values in zip(steps(), counts)]
        return pa.table([pa.array(c, type=f.type) for c, f in zip(zip(*out), OUT_ARROW)], schema=OUT_ARROW)

    return run


def audit_filters(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """Columns as in op13's contract: 600 rows for each value of `part`, zeros included.

    Texts are read once and go to a mask of their own failures and a key of 24 bytes; equal rows are counted before
    anything moves. A document fails E if its text's least doc_id is below its own: rows meet that least doc_id by the text's key
    and the doc_id together, so a text that a third of all documents share is no hot key. Masks are counted by part,
    with map-side sums, so a hot part moves 128 rows a task; each part's counts times the masks' packed integers are summed to one
    integer, whose fields are all outcomes of all steps.

    Null texts are empty ones, and equal to those; a null part and an empty one are one part, named ''. A row without
    doc_id is no copy and makes none, and has no labels; rows that repeat are documents of their own, and as none has a smaller doc_id,
    none of them is a copy of the others. Of several labels of a doc_id the greatest holds; null labels are 0. Very
    long texts are hashed whole. Other columns are not used. An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "audit")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), "text").mapInArrow(measured, ROW_SCHEMA)
    rows = scratch.write(rows.groupBy("doc_id", "key", "part", "own").agg(F.count(F.lit(1)).alias("n")), "rows")
    known = rows.where("doc_id is not null")
    firsts = known.groupBy(F.col("key").alias("_key")).agg(F.min("doc_id").alias("_first"))
    flags = labels.groupBy(F.col("doc_id").cast("long").alias("_doc")).agg(*[F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))])
    first = F.col("_first").isNotNull() | F.col("doc_id").isNull()
    found = rows.join(firsts, (F.col("key") == F.col("_key")) & (F.col("doc_id") == F.col("_first")), "left").join(flags, F.col("doc_id") == F.col("_doc"), "left")
    found = found.select("part", (F.col("own") + F.when(first, 0).otherwise(16)).alias("mask"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")], "n")
    counts = found.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))
    return counts.groupBy("part").applyInArrow(summed(packed_outcomes()), OUT_SCHEMA)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


#: The same by subsets: a step keeps the documents that fail none of the filters so far.
OP13_SQL = r"""
with d as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents
), w as (
  select doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws from d
), l as (
  select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels where doc_id is not null group by doc_id
), firsts as (
  select t, min(doc_id) as first_id from d group by t
), f as (
  select w.part,
    case when len(ws) < 200 then 1 else 0 end + case when 100 * len(list_distinct(ws)) < 50 * len(ws) then 2 else 0 end
    + case when 100 * len(regexp_replace(w.t, '[^A-Z]', '', 'g')) > 2 * length(w.t) then 4 else 0 end
    + case when regexp_matches(w.t, '[#$%&*|]') then 8 else 0 end + case when w.doc_id > first_id then 16 else 0 end as mask,
    coalesce(l.good, 0) as good, coalesce(l.toxic, 0) as toxic
  from w join firsts on w.t = firsts.t left join l on w.doc_id = l.doc_id
), m as (
  select part, mask, count(*) as n, sum(good) as good, sum(toxic) as toxic from f group by part, mask
), letters as (
  select unnest(['A', 'B', 'C', 'D', 'E']) as x, unnest([1, 2, 4, 8, 16]) as bit
), orders as (
  select a.x || b.x || c.x || d.x || e.x as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits
  from letters a, letters b, letters c, letters d, letters e
  where a.bit + b.bit + c.bit + d.bit + e.bit = 31 and len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), s as (
  select filter_order, k as step, bits[k] as bit, coalesce(list_sum(bits[1:k - 1]), 0)::int as before
  from orders, (select unnest(range(1, 6)) as k)
), found as (
  select part, filter_order, step, s.bit,
    sum(case when mask & (bit | before) = 0 then n else 0 end) as kept,
    sum(case when mask & bit <> 0 and mask & before = 0 then n else 0 end) as removed,
    sum(case when mask & bit <> 0 and mask & before <> 0 then n else 0 end) as redundant,
    sum(case when mask = bit then n else 0 end) as unique_fails,
    sum(case when mask & bit <> 0 and mask & before = 0 then good else 0 end) as good_lost,
    sum(case when mask & bit <> 0 and mask & before = 0 then toxic else 0 end) as toxic_lost
  from m, s group by part, filter_order, step, s.bit
)
select part, filter_order, step::int as step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails,
  good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, bit))::bigint as shapley
from found
"""

QUERIES = {"op13_filter_audit": op13_filter_audit}
SQL = {"op13_filter_audit": OP13_SQL}
