"""Quality rules with verdicts by host (built-in functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionrec.llm.common import SPACE, Scratch, paired_hashes, read_documents, text_or_empty, words_column

#: Base rules: least words, most percent of words in repeated windows, window length.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
#: A host is rejected when its failure rate is surely (SURE posterior deviations) above RATIO times that of all documents, or above MOST.
RATIO, MOST, SURE = 3.0, 0.5, 3.0
#: Bounds of the prior's strength in documents, for hosts that are all alike or all different.
PRIOR_LEAST, PRIOR_MOST = 1.0, 10_000.0
#: Host rows are copied so often for the join back; a host with a third of all documents meets so many tasks.
SALTS = 32


def with_repeated_words(rows: DataFrame, out: str) -> DataFrame:
    """Adds the words inside WINDOW-word windows that occur twice or more, by _hashes, one for each window.

    Each step is a column, so that none is made twice; most texts have no repeated window and skip all of them.
    """
    hashes = F.col("_hashes")
    none = F.array().cast("array<bigint>")
    rows = rows.withColumn("_hashes", F.when(F.size(hashes) == F.size(F.array_distinct(hashes)), none).otherwise(hashes))
    some = F.size(hashes) > 0
    places = F.arrays_zip(hashes.alias("h"), F.sequence(F.lit(0), F.size(hashes) - 1).alias("i"))
    rows = rows.withColumn("_sorted", F.when(some, F.array_sort(places)))
    pairs = F.zip_with(F.slice("_sorted", 1, F.size("_sorted") - 1), F.slice("_sorted", 2, F.size("_sorted") - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    rows = rows.withColumn("_starts", F.when(some, F.array_sort(F.array_distinct(F.flatten(F.filter(pairs, lambda x: x.isNotNull()))))))
    steps = F.zip_with(F.slice("_starts", 1, F.size("_starts") - 1), F.slice("_starts", 2, F.size("_starts") - 1), lambda a, b: F.least(b - a, F.lit(WINDOW)))
    found = F.aggregate(steps, F.lit(WINDOW).cast("bigint"), lambda n, x: n + x)
    return rows.withColumn(out, F.when(some, found).otherwise(F.lit(0).cast("bigint")))


def measures(docs: DataFrame, *keep: str) -> DataFrame:
    """The base figures of each document, over its whole text (null: empty). Without shuffle.

    keep: columns to carry along; texts are dropped here.
    """
    text = text_or_empty(F.col("text"))
    plain = F.translate(text, SPACE, "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, SPACE, "") != "")
    base = docs.select(
        *keep,
        words_column(F.col("text")).alias("_words"),
        F.length(plain).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
    )
    words = F.col("_words")
    # Runs of 1, 2, 4 and 8 words, a column each, so that none is made twice.
    base = base.withColumn("_hashes", F.transform(words, lambda w: F.xxhash64(w)))
    for lag in (1, 2, 4):
        base = base.withColumn("_hashes", paired_hashes(F.col("_hashes"), F.col("_hashes"), lag))
    base = base.select(
        *keep,
        F.size(words).cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        "_hashes",
    )
    return with_repeated_words(base, "n_repeat_words").select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def host_verdicts(failed: DataFrame, host: str = "source") -> DataFrame:
    """Per host: documents, failures, the failure rate shrunk by an empirical beta prior, and whether the host is rejected.

    The prior's mean is the rate m over all documents. Its strength comes from how far the hosts' rates lie apart beyond
    what draws of documents alone make of it: with N documents in K hosts of n each and a share r of m (1 - m) between hosts, the sum of
    n (rate - m)^2 is m (1 - m) times (K - 1) (1 - r) + r (N - sum of n^2 / N) on average, which is solved for r; the strength
    is 1 / r - 1. Hosts that lie no farther apart than by chance get the greatest strength. A host is rejected if its shrunk rate less
    SURE posterior deviations is above the limit, so a small host needs more than a few failures. The only rows that
    meet in one task are partial sums of hosts; one-row tables are broadcast.
    """
    hosts = failed.groupBy(host).agg(F.count(F.lit(1)).alias("host_docs"), F.count_if("base_failed").alias("host_failed"))
    n = F.col("host_docs").cast("double")
    total = hosts.agg((F.sum("host_failed") / F.greatest(F.sum(n), F.lit(1.0))).alias("mean"))
    hosts = hosts.crossJoin(F.broadcast(total))
    off = F.col("host_failed") / n - F.col("mean")
    sums = hosts.agg(F.first("mean").alias("_m"), F.sum(n * off * off).alias("_s"), F.sum(n).alias("_n"), F.sum(n * n).alias("_n2"), F.count(F.lit(1)).cast("double").alias("_k"))
    spread = F.try_divide(F.col("_s"), F.col("_m") * (1 - F.col("_m"))) - (F.col("_k") - 1)
    share = F.try_divide(spread, F.col("_n") - F.col("_n2") / F.col("_n") - (F.col("_k") - 1))
    strength = F.when(share > 0, F.least(F.greatest(1 / share - 1, F.lit(PRIOR_LEAST)), F.lit(PRIOR_MOST))).otherwise(F.lit(PRIOR_MOST))
    prior = sums.select(strength.alias("strength"))
    weight = n + F.col("strength")
    hosts = hosts.crossJoin(F.broadcast(prior)).withColumn("host_rate", (F.col("host_failed") + F.col("mean") * F.col("strength")) / weight)
    sure = F.col("host_rate") - SURE * F.sqrt(F.col("host_rate") * (1 - F.col("host_rate")) / (weight + 1))
    return hosts.select(host, "host_docs", "host_failed", "host_rate", (sure > F.least(RATIO * F.col("mean"), F.lit(MOST))).alias("host_rejected"))


def quality_rules(docs: DataFrame, host: str = "source") -> DataFrame:
    """Base figures, base verdict and the verdict with the host's: columns as in op10's contract, and host_rate.

    Null texts count as empty, a null doc_id is kept, a null host is a host of its own, repeated rows
    stay repeated; a bound at the limit keeps its host; a very long text is one row, and its windows
    are sorted within it; an empty table gives no rows. Columns beside doc_id, text and the host are not used.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    found = scratch.write(measures(docs.select("doc_id", "text", F.col(host).alias("_host")), "doc_id", "_host").withColumn("base_failed", base_failed()), "measures")
    hosts = host_verdicts(found, "_host").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # By place in the written table: rows of one doc_id are spread too.
    salted = found.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).alias("d")
    joined = salted.join(hosts.alias("h"), F.col("d._host").eqNullSafe(F.col("h._host")) & (F.col("d._salt") == F.col("h._salt")))
    return joined.select(
        "d.doc_id", "d.n_words", "d.word_chars", "d.n_symbols", "d.n_dup_lines", "d.n_repeat_words", "d.base_failed",
        (~F.col("d.base_failed") & ~F.col("h.host_rejected")).alias("kept"),
        F.round("h.host_rate", 6).alias("host_rate"),
    )


def op10_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read_documents(spark, sf_dir))


OP10_SQL = r"""
with d as (
  select doc_id, source, coalesce(text, '') as t from documents
), w as (
  select doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws from d
), b as (
  select doc_id, source, ws, len(ws) as n_words,
    coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) as word_chars,
    length(t) - length(translate(t, '#*$%&|<>', '')) as n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls
  from w
), wins as (
  select doc_id, i, array_to_string(ws[i:i + 7], ' ') as win
  from (select doc_id, ws, unnest(range(1, len(ws) - 6)) as i from b where len(ws) >= 8)
), dup as (
  select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, win) as c from wins) where c > 1
), rep as (
  select doc_id, sum(least(8, coalesce(nx - i, 8))) as r
  from (select doc_id, i, lead(i) over (partition by doc_id order by i) as nx from dup) group by doc_id
), m as (
  select b.doc_id, source, n_words, word_chars, n_symbols,
    len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(r, 0) as n_repeat_words
  from b left join rep using (doc_id)
), f as (
  select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from m
), h as (
  select source, count(*)::double as n, count(*) filter (where base_failed)::double as fl from f group by source
), p as (
  select sum(fl) / sum(n) as mean, sum(fl * fl / n) - sum(fl) * sum(fl) / sum(n) as s, sum(n) as n, sum(n * n) as n2, count(*)::double as k from h
), q as (
  select mean, case when mean > 0 and mean < 1 and n - n2 / n - k + 1 <> 0 then (s / (mean * (1 - mean)) - k + 1) / (n - n2 / n - k + 1) else 0 end as r from p
), g as (
  select mean, case when r > 0 then least(greatest(1 / r - 1, 1), 10000) else 10000 end as strength from q
), v as (
  select source, mean, n + strength as weight, (fl + mean * strength) / (n + strength) as rate from h cross join g
)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
  n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, base_failed,
  (not base_failed and rate - 3.0 * sqrt(rate * (1 - rate) / (weight + 1)) <= least(3.0 * mean, 0.5)) as kept, round(rate, 6) as host_rate
from f join v on f.source is not distinct from v.source
"""

QUERIES = {"op10_host_quality": op10_host_quality}
SQL = {"op10_host_quality": OP10_SQL}
