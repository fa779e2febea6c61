"""Sharding by a weighted hash tree of regions, racks and shards."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sessionrec.llm.common import Scratch, read_documents, text_or_empty

#: Rows of a shard are numbered in so many parts, each by a task of its own.
SLOT_PARTS = 4096


@dataclass(frozen=True)
class Shard:
    region: str
    rack: str
    number: int
    weight: float = 1.0


def even_tree(shards: int) -> list[Shard]:
    """Shards in pairs by rack and racks in pairs by region. A tree that isn't full has the rest in regions of one shard.

    So one more shard opens a region of its own, and the regions before it keep their weights.
    """
    full = shards // 4 * 4
    return [Shard(f"r{i // 4}", f"k{i // 2 % 2}", i) if i < full else Shard(f"s{i}", "k0", i) for i in range(shards)]


def grown_tree(tree: list[Shard]) -> list[Shard]:
    """One more shard of weight 1 in a region of its own: only that region's weight changes."""
    number = max((s.number for s in tree), default=-1) + 1
    return [*tree, Shard(f"s{number}", "k0", number)]


def draw(key: Column, node: str, weight: float) -> Column:
    """An exponential draw of that rate for a key at a node: the least of some draws falls on each by its weight."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"/{node}"))), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / float(2**52)) / weight


def placed(rows: DataFrame, key: Column, tree: list[Shard], out: str) -> DataFrame:
    """Adds the number of the shard: the region with the least draw, then its rack, then the shard there.

    A subtree's weight is the sum of its shards'. A draw depends on the key, the node's path and
    the node's weight alone; so when weights change, keys move only between a subtree whose
    weight changes and the others on its level, and inside subtrees whose weights change.
    """
    def choice(nodes: list[tuple[str, float]]) -> Column:
        return F.array(*[draw(key, path, weight) for path, weight in nodes])

    by: dict[str, dict[str, list[Shard]]] = {}
    for s in tree:
        by.setdefault(s.region, {}).setdefault(s.rack, []).append(s)
    regions = sorted(by)
    mass = lambda shards: sum(s.weight for s in shards)
    least = lambda c: F.array_position(c, F.array_min(c)).cast("int") - 1
    rows = rows.withColumn("_d", choice([(r, sum(map(mass, by[r].values()))) for r in regions])).withColumn("_region", least(F.col("_d")))
    rows = rows.withColumn("_d", _cases("_region", len(regions), lambda i: choice([(f"{regions[i]}/{k}", mass(by[regions[i]][k])) for k in sorted(by[regions[i]])]))).withColumn("_rack", least(F.col("_d")))
    racks = [(i, j, sorted(by[r])[j]) for i, r in enumerate(regions) for j in range(len(by[r]))]
    at = F.lit(None).cast("array<double>")
    numbers = F.lit(None).cast("array<int>")
    for i, j, k in racks:
        here, shards = (F.col("_region") == i) & (F.col("_rack") == j), by[regions[i]][k]
        at = F.when(here, choice([(f"{regions[i]}/{k}/{s.number}", s.weight) for s in shards])).otherwise(at)
        numbers = F.when(here, F.array(*[F.lit(s.number) for s in shards])).otherwise(numbers)
    rows = rows.withColumn("_d", at).withColumn("_n", numbers)
    return rows.withColumn(out, F.get("_n", least(F.col("_d")))).drop("_d", "_n", "_region", "_rack")


def _cases(column: str, n: int, value) -> Column:
    out = value(n - 1)
    for i in range(n - 1):
        out = F.when(F.col(column) == i, value(i)).otherwise(out)
    return out


def numbered(rows: DataFrame, shard: str, key: Column) -> DataFrame:
    """Adds slot, gapless from 0 in each shard, without gathering a shard in one task.

    Rows go to SLOT_PARTS parts by a hash of their key and text (so that rows of one key, as null,
    don't meet in one part). The parts' counts (SLOT_PARTS rows a
    shard at most, whatever the input) give each part its first slot.
    """
    rows = rows.withColumn("_part", F.substring(F.md5(F.concat(key, F.lit("/"), F.col("text_crc32").cast("string"), F.lit("/slot"))), 1, 3))
    rows = (scratch := Scratch(rows.sparkSession, "sharding")).write(rows, "placed")
    counts = rows.groupBy(shard, "_part").count()
    first = counts.select(shard, "_part", (F.sum("count").over(Window.partitionBy(shard).orderBy("_part")) - F.col("count")).alias("_first"))
    first = scratch.write(first, "parts")
    order = Window.partitionBy(shard, "_part").orderBy("doc_id", "text_crc32", "size")
    return rows.withColumn("_rank", F.row_number().over(order)).join(first, [shard, "_part"]).withColumn("slot", F.col("_first") + F.col("_rank") - 1).drop("_part", "_first", "_rank")


def shard_documents(docs: DataFrame, tree: list[Shard]) -> DataFrame:
    """doc_id, size, text_crc32, law ('key'), shard, slot, grown_shard: doc_id and the tree alone decide the shard.

    Null texts have size 1 and the CRC of no bytes. A null doc_id is a key of its own; repeated
    rows get the same shard and slots of their own, in the order of doc_id, CRC and size, where
    ties are equal in all that is returned. Very long texts are one row like others. Other columns
    are not used. An empty table gives no rows.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    text = text_or_empty(F.col("text"))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"))
    rows = placed(placed(rows, key, tree, "shard"), key, grown_tree(tree), "grown_shard")
    return numbered(rows, "shard", key).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op6_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read_documents(spark, sf_dir), even_tree(8))


def _sql_tree() -> str:
    u = lambda path: f"-ln((('0x' || substr(md5(k || '/' || {path}), 1, 13))::ubigint::double + 0.5) / 4503599627370496.0)"
    return f"""
with d as (
  select doc_id, coalesce(doc_id::varchar, 'null') as k, coalesce(text, '') as t from documents
), r as (
  select *, {u("'r0'")} / 4 as a, {u("'r1'")} / 4 as b, {u("'s8'")} as c from d
), g as (
  select *, case when a <= b then 'r0' else 'r1' end as rg, c < least(a, b) as moved from r
), e as (
  select *, case when {u("rg || '/k0'")} <= {u("rg || '/k1'")} then 0 else 1 end as rk from g
), f as (
  select *, (case when rg = 'r0' then 0 else 4 end) + 2 * rk as s0 from e
), s as (
  select *, case when {u("rg || '/k' || rk || '/' || s0")} <= {u("rg || '/k' || rk || '/' || (s0 + 1)")} then s0 else s0 + 1 end as shard from f
), tab as (
  select list(list_reduce([i::ubigint, 0, 0, 0, 0, 0, 0, 0, 0]::ubigint[], lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384::ubigint) else x >> 1 end) order by i) as crc
  from range(256) q(i)
), z as (
  select s.*, xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda h: ('0x' || h)::ubigint)),
    lambda x, y: xor(x >> 8, tab.crc[((xor(x, y)) & 255)::bigint + 1])), 4294967295::ubigint)::bigint as text_crc32
  from s cross join tab
)
select doc_id, (strlen(t) + 1)::bigint as size, text_crc32, 'key' as law, shard::int as shard,
  row_number() over (partition by shard order by substr(md5(k || '/' || text_crc32 || '/slot'), 1, 3), doc_id, text_crc32, strlen(t)) - 1 as slot,
  (case when moved then 8 else shard end)::int as grown_shard
from z
"""


QUERIES = {"op6_hash_tree_shards": op6_hash_tree_shards}
SQL = {"op6_hash_tree_shards": _sql_tree()}
