"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sessionrec.llm.common import WORD, Scratch, packed, read_documents, text_or_empty

WEIGHTS = (5.0, 2.0, 1.0)
MOST_COPIES = 3
#: Documents of a first group, and groups that one group of the next level combines.
GROUP, FAN_IN = 2048, 64
#: A document is large if it holds one in LARGE of its source's words; a source has at most LARGE of those.
LARGE = 4096
#: Up to this share of its source's target, a document that the rest can't make up for is drawn all the same.
NEAR = 0.01
#: The last documents of a source without small ones, of which all subsets are looked at.
LAST = 10
#: Source rows are copied so often for the join back, so that a hot source meets so many tasks.
SALTS = 32


def word_count(text: Column) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """_source, sid, source_size, target: a row for each source.

    Sources in the order of their code points (null last) weigh weights[0], weights[1], ... in
    turn and share the sum of all sizes. A target is the lesser of `most` times its source's size
    and a level times its weight; the level is the one at which the targets add up, as after
    resharing what is above again and again. The rows that meet in one task are the sources'.
    """
    by_source = sizes.groupBy("_source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    names = Window.orderBy(F.col("_source").asc_nulls_last())
    listed = by_source.withColumn("sid", F.row_number().over(names) - 1)
    listed = listed.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod("sid", F.lit(len(weights))).cast("int") + 1))
    listed = listed.withColumn("cap", most * F.col("source_size").cast("double"))
    every, filling = Window.partitionBy(), Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    listed = listed.withColumn("rest", F.sum(F.col("source_size").cast("double")).over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    listed = listed.withColumn("level", F.col("rest") / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    open_ = F.when(F.col("level") * F.col("weight") < F.col("cap"), F.struct(F.row_number().over(filling).alias("i"), F.col("level")))
    listed = listed.withColumn("first", F.min(open_).over(every)["level"])
    target = F.least(F.col("cap"), F.coalesce(F.col("first"), F.lit(0.0)) * F.col("weight"))
    return listed.select("_source", "sid", "docs", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def uniform(*keys: Column) -> Column:
    return (F.pmod(F.xxhash64(*keys), F.lit(2**52)) + 0.5) / float(2**52)


def pivot(p: np.ndarray, w: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Pivotal rounding of probabilities p of documents of sizes w > 0; u: a draw for each.

    Two fractional documents at a time trade words, so the sum of p * w stays, until one of them
    is 0 or 1; which of the two ways is drawn so that no expectation changes. One document at
    most stays fractional.
    """
    p, held = p.tolist(), -1
    w, u = w.tolist(), u.tolist()
    for i in range(len(p)):
        if not 0.0 < p[i] < 1.0:
            continue
        if held < 0:
            held = i
            continue
        a, b = held, i
        ratio = w[b] / w[a]
        up, down = min(1.0 - p[a], p[b] * ratio), min(p[a], (1.0 - p[b]) * ratio)
        if u[i] * (up + down) < down:
            full = 1.0 - p[a] <= p[b] * ratio
            p[a], p[b] = (1.0, p[b] - (1.0 - p[a]) / ratio) if full else (p[a] + p[b] * ratio, 0.0)
        else:
            empty = p[a] <= (1.0 - p[b]) * ratio
            p[a], p[b] = (0.0, p[b] + p[a] / ratio) if empty else (p[a] - (1.0 - p[b]) * ratio, 1.0)
        if min(p[a], 1 - p[a]) < 1e-12:
            p[a] = round(p[a])
        if min(p[b], 1 - p[b]) < 1e-12:
            p[b] = round(p[b])
        held = a if 0.0 < p[a] < 1.0 else b if 0.0 < p[b] < 1.0 else -1
    return np.array(p, dtype=float)


def settled(sizes: np.ndarray, q: float, pool: float, u: np.ndarray) -> np.ndarray:
    """Rounds the large documents of a source, by falling size, against the pool of all its smaller ones.

    All documents of a source have the same probability q, and pool is their words, theirs included. A document and
    the pool of all smaller ones are the pair that trades: the document gets 1 with probability q, else 0, and the pool's q takes
    up its words, which moves all of its documents' probabilities alike and keeps every expectation. Where the
    pool is too small for that either way, the two trade as in pivot() and the document may stay fractional, to be
    drawn; but if it is more than NEAR of the target, it goes the one way that the pool can make up for. Where a
    source has large documents only, the LAST of them are drawn together, from those of their subsets that are near what is left to take.
    """
    out, near = np.zeros(len(sizes)), NEAR * q * pool
    last = max(0, len(sizes) - LAST) if sizes.sum() >= pool else len(sizes)
    for i, w in enumerate(sizes.tolist()):
        if i == last:
            subsets = (np.arange(2 ** (len(sizes) - i))[:, None] >> np.arange(len(sizes) - i)) & 1
            miss = np.abs(subsets @ sizes[i:] - q * pool)
            fine = np.flatnonzero(miss <= max(miss.min(), min(near, miss.min() + sizes[-1])))
            out[i:] = subsets[fine[int(u[i] * len(fine))]]
            break
        rest = pool - w
        if q <= 0.0 or q >= 1.0:
            out[i] = round(q)
        else:
            can_rise, can_fall = (1 - q) * w <= q * rest, q * w <= (1 - q) * rest
            if can_rise != can_fall and w > near:
                out[i] = float(can_rise)
            elif can_rise and can_fall:
                out[i] = float(u[i] < q)
            else:
                up, down = min(1 - q, q * rest / w), min(q, (1 - q) * rest / w)
                limit = down / (up + down) if up + down > 0 else 0.0
                moved, again = (q + up, u[i] / limit) if u[i] < limit else (q - down, (u[i] - limit) / (1 - limit))
                after = (q * pool - moved * w) / rest if rest > 0 else 0.0
                out[i], q, pool = float(again < moved), min(1.0, max(0.0, after)), rest
                continue
        q, pool = (min(1.0, max(0.0, (q * pool - out[i] * w) / rest)) if rest > 0 else 0.0), rest
    return out


TREE = "sid int, part long, doc_id long, row long, tie int, size long, whole long, p double, u double"
BIG = TREE + ", source_size long"


def large_rounded(table: pa.Table) -> pa.Table:
    """The large documents of a source, LARGE at most, with 0 or 1 for p."""
    size, u, row, tie = (table[c].to_numpy() for c in ("size", "u", "row", "tie"))
    table = table.take(pa.array(np.lexsort((tie, row, u, -size))))
    p = settled(table["size"].to_numpy().astype(float), table["p"][0].as_py(), float(table["source_size"][0].as_py()), table["u"].to_numpy())
    return table.set_column(table.schema.get_field_index("p"), "p", pa.array(p))


def combined(table: pa.Table) -> pa.Table:
    """A group after rounding. By falling size, a document trades with one of about its size."""
    size, u, row, tie = (table[c].to_numpy() for c in ("size", "u", "row", "tie"))
    table = table.take(pa.array(np.lexsort((tie, row, u, -size))))
    p = pivot(table["p"].to_numpy(), table["size"].to_numpy().astype(float), table["u"].to_numpy())
    return table.set_column(table.schema.get_field_index("p"), "p", pa.array(p))


def row_key(source: str) -> Column:
    """What tells rows apart: doc_id, source and text. Rows equal in these are interchangeable."""
    return F.xxhash64("doc_id", F.col(source), "text")


def with_tie(rows: DataFrame, order: Column) -> DataFrame:
    """Adds tie: 1, 2, ... among rows of one key; only rows with equal ids, sources and texts meet."""
    return rows.withColumn("tie", F.row_number().over(Window.partitionBy("row").orderBy(order)))


def copies(docs: DataFrame, scratch: Scratch, source: str = "source", seed: int = 20) -> tuple[DataFrame, DataFrame]:
    """(a row for each document with its copies, a row for each source with its target).

    A document of a source gets target / source_size copies on average: the whole part for sure,
    and by pivotal rounding one more or none. A source's large documents are settled first, each against the pool of all
    smaller ones (settled()), so that what one of them takes too much or too little is spread over all of those.
    Groups of about GROUP other documents of a source, dealt by hash, then round in tasks of their own; each leaves one
    fractional document at most, and FAN_IN of those go to a group of the next level, up to one group for each source.
    The last one there is drawn. So a source takes its target to within one document that is not large, wherever
    its rows lie; a source of few documents, to within one of its smaller ones.
    """
    columns = ["doc_id", F.col(source).alias("_source"), word_count(F.col("text")).alias("size"), row_key(source).alias("row")]
    sizes = scratch.write(with_tie(docs.select(*columns), F.col("row")), "sizes")
    targets = scratch.write(source_targets(sizes), "targets")
    salted = targets.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # A document without words has no share: taking it would take nothing.
    share = F.when((F.col("source_size") > 0) & (F.col("size") > 0), F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = sizes.withColumn("_salt", F.pmod(F.xxhash64("row", "tie"), F.lit(SALTS)).cast("int")).alias("d").join(
        salted.alias("t"), F.col("d._source").eqNullSafe(F.col("t._source")) & (F.col("d._salt") == F.col("t._salt")),
    )
    rows = rows.select(
        "sid", F.pmod(F.xxhash64("row", "tie", F.lit(seed)), F.ceil(F.col("docs") / GROUP)).alias("part"), "d.doc_id", "row", "tie", "size",
        F.floor(share).cast("long").alias("whole"), (share - F.floor(share)).alias("p"), uniform(F.col("row"), F.col("tie"), F.lit(seed + 1)).alias("u"), "source_size", F.col("d._salt").alias("_salt"),
    )
    rows = scratch.write(rows, "rows")
    is_large = (F.col("size") > 0) & (F.col("size") * LARGE >= F.col("source_size"))
    large = scratch.write(rows.where(is_large).drop("_salt").groupBy("sid").applyInArrow(large_rounded, BIG), "large")
    # What large documents took sets the probability of all others of their source.
    took = large.groupBy("sid").agg(F.sum("size").alias("_large"), F.sum(F.col("size") * F.col("p")).alias("_took")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.where(~is_large).join(took, ["sid", "_salt"], "left")
    left = (F.col("p") * F.col("source_size") - F.col("_took")) / (F.col("source_size") - F.col("_large"))
    p = F.when(F.col("_took").isNull() | (F.col("size") == 0), F.col("p")).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), left)))
    rows = rows.withColumn("p", p).select(*[c.split()[0] for c in TREE.split(", ")])
    levels, most = 1, -(-(targets.agg(F.max("docs")).first()[0] or 1) // GROUP)
    while most > 1:
        levels, most = levels + 1, -(-most // FAN_IN)
    found = [large.drop("source_size")]
    for level in range(levels):
        rows = scratch.write(rows.groupBy("sid", "part").applyInArrow(combined, TREE), f"level{level}")
        fractional = (F.col("p") > 0) & (F.col("p") < 1)
        found.append(rows.where(~fractional))
        rows = rows.where(fractional).withColumn("part", F.floor(F.col("part") / FAN_IN))
    found.append(rows.withColumn("p", F.when(F.col("u") < F.col("p"), 1.0).otherwise(0.0)))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select("sid", "doc_id", "row", "tie", "size", (F.col("whole") + F.col("p").cast("long")).alias("copies")), targets


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies: a row for each document.

    Null and empty texts have size 0 and are taken zero words; a null source is a source of its
    own, and a null doc_id is kept; rows that repeat are documents of their own. Reruns agree,
    since draws depend on doc_id, source and text (and a tie among rows equal in these) alone. A
    very long text is one document, counted whole, which no other trade can cut. Other columns are
    not used. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    found, targets = copies(docs, scratch)
    salted = targets.select("sid", "source_size", "target", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    found = found.withColumn("_salt", F.pmod(F.xxhash64("row", "tie"), F.lit(SALTS)).cast("int")).join(salted, ["sid", "_salt"])
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mix_documents(docs: DataFrame) -> DataFrame:
    """The documents, each as often as the mix takes it, with all their columns, whatever those are called.

    A document without words goes (null and empty texts too), as the mix takes words. Null ids and
    sources are like others. Rows equal in doc_id, source and text are told apart by their other
    columns' hash; documents of one size trade in the order of their draws. A very long text is taken
    whole, as often as its size allows. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    found, _ = copies(docs, scratch)
    repeated = scratch.write(found.where("tie > 1").select(F.col("row").alias("_row")).distinct(), "repeated")
    found = scratch.write(found.where("copies > 0").select(F.col("row").alias("_row"), "tie", "copies"), "wanted")
    keyed = docs.select(packed(docs).alias("doc"), row_key("source").alias("row"))
    # Texts are dealt once, by their key; only rows that repeat need a number.
    wanted = found.join(repeated, "_row", "left_anti").hint("merge")  # grows with the documents: not broadcast at any size
    out = keyed.join(wanted, F.col("row") == F.col("_row")).select("doc", "copies")
    if not repeated.isEmpty():
        several = with_tie(keyed.join(repeated, F.col("row") == F.col("_row"), "left_semi"), F.xxhash64("doc"))
        wanted = found.select("_row", F.col("tie").alias("_tie"), "copies")
        out = out.unionByName(several.join(wanted, (F.col("row") == F.col("_row")) & (F.col("tie") == F.col("_tie"))).select("doc", "copies"))
    return out.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("doc.*")


def op4_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(read_documents(spark, sf_dir))


QUERIES = {"op4_pivotal_mix": op4_pivotal_mix}
SQL: dict[str, str] = {}
