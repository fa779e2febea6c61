"""Similarity join on word shingles: a grouped prefix join."""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sessionrec.llm.common import SIMILARITY, Scratch, WordHash, lower_words, packed, read_documents, runs, shingles, small_batches, texts_of
from sessionrec.llm.components import components

#: Shingles that a task gathers into a block.
BLOCK = 250_000
#: Groups near in a list, by size, that each is compared to at once; longer lists are gone through again.
NEAR = 8
#: Pairs of members up to which two groups are compared in full at once; rows of a list that one task sorts.
GROUP, LIST_PART = 64, 1024
#: Sets of a chunk that is compared at once, and their shingles.
CHUNK, CHUNK_SHINGLES = 512, 400_000
#: Documents to a bucket of the block table, and the most buckets that a table has.
BUCKET_DOCS, MOST_BUCKETS = 40_000, 100_000

NUM, DEN = SIMILARITY


def alike(shared: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return DEN * shared >= NUM * (a + b - shared)


def least_shared(n: np.ndarray | int):
    """The least intersection of a set of n with any set that is alike."""
    return -(-NUM * n // DEN)


def pack48(values: np.ndarray) -> bytes:
    """48-bit numbers in 6 bytes each."""
    return values.astype("<u4").tobytes() + (values >> np.uint64(32)).astype("<u2").tobytes()


def unpack48(data: bytes) -> np.ndarray:
    n = len(data) // 6
    return np.frombuffer(data, "<u4", n).astype(np.uint64) | (np.frombuffer(data, "<u2", n, 4 * n).astype(np.uint64) << np.uint64(32))


def class_id(tokens: np.ndarray) -> int:
    """Identity of a set of shingles; equal sets, equal ids."""
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8, key=b"%d" % len(tokens)).digest(), "little", signed=True)


BLOCKS = pa.schema([("doc_id", pa.int64()), ("dk", pa.int64()), ("class", pa.int64()), ("n", pa.int64()), ("block", pa.int64()), ("classes", pa.binary()), ("sizes", pa.binary()), ("tokens", pa.binary())])
BLOCK_SCHEMA = "doc_id long, dk long, class long, n long, block long, classes binary, sizes binary, tokens binary"


def blocks(batches: Iterator) -> Iterator:
    """Documents to a row each (doc_id, dk, class, n) and, for every BLOCK shingles or so, a row with the sets of the block's classes.

    Documents' rows have a block below 0, which spreads them over the buckets of the table too.
    """
    table, task, number = WordHash(), TaskContext.get().partitionId(), 0
    docs: tuple[list, ...] = ([], [], [], [])
    held: dict[int, np.ndarray] = {}
    size = 0

    def flush() -> Iterator:
        nonlocal number, size
        here = (task << 32) + number
        none = [None] * len(docs[0])
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((*docs, [-1 - here] * len(docs[0]), none, none, none), BLOCKS)], schema=BLOCKS)
        for x in docs:
            x.clear()
        if held:
            sets = list(held.values())
            row = (None, None, None, None, here, np.array(list(held), dtype="<i8").tobytes(), np.array([len(s) for s in sets], dtype="<u4").tobytes(), pack48(np.concatenate(sets)))
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, BLOCKS)], schema=BLOCKS)
            held.clear()
        number, size = number + 1, 0

    for batch, texts in texts_of(batches):
        for doc, dk, text in zip(batch.column("doc_id").to_pylist(), batch.column("dk").to_pylist(), texts):
            found = shingles(table.of(lower_words(text)))
            docs[0].append(doc)
            docs[1].append(dk)
            docs[3].append(len(found))
            if not len(found):
                docs[2].append(None)
                continue
            tokens = np.unique(found >> np.uint64(16))
            c = class_id(tokens)
            docs[2].append(c)
            if c not in held:
                held[c] = tokens
                size += len(tokens)
        if size >= BLOCK or len(docs[0]) >= 20_000:
            yield from flush()
    yield from flush()


TOKENS = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("tokens", pa.binary()), ("times", pa.binary())])


def block_tokens(buckets: int):
    """A block's distinct shingles and in how many of its sets each is, dealt to ranges of the hash: a shingle that is in a third of all documents sends one record a block."""
    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("tokens").to_pylist()):
                tokens, times = np.unique(unpack48(data), return_counts=True)
                bucket = (tokens * np.uint64(buckets) >> np.uint64(48)) if buckets < 2**16 else tokens % np.uint64(buckets)
                starts, _ = runs(bucket)
                bounds = list(zip(starts.tolist(), [*starts[1:].tolist(), len(tokens)]))
                out = (bucket[starts].astype(np.int32), [block] * len(bounds), [delta(tokens[a:b]) for a, b in bounds], [times[a:b].astype("<u4").tobytes() for a, b in bounds])
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, TOKENS)], schema=TOKENS)

    return run


def delta(sorted_values: np.ndarray) -> bytes:
    """Sorted numbers by their differences, which are small where they are many."""
    return pack48(np.diff(sorted_values, prepend=np.uint64(0)))


def undelta(data: bytes) -> np.ndarray:
    return np.cumsum(unpack48(data), dtype=np.uint64)


def frequencies(pdf: pd.DataFrame) -> pd.DataFrame:
    """A bucket's shingles: in how many sets each is. Given back to the blocks where that is two or more."""
    parts = [undelta(x) for x in pdf["tokens"]]
    tokens, times = np.concatenate(parts), np.frombuffer(b"".join(pdf["times"]), "<u4")
    order = np.argsort(tokens, kind="stable")
    starts, run_of = runs(tokens[order])
    total = np.bincount(run_of, weights=times[order], minlength=1)
    count = np.empty(len(tokens), dtype=np.int64)
    count[order] = total[run_of]
    out, at = [], 0
    for block, part in zip(pdf["block"], parts):
        mine = count[at : at + len(part)]
        at += len(part)
        shared = mine > 1
        if shared.any():
            out.append((block, delta(part[shared]), np.minimum(mine[shared], 2**32 - 1).astype("<u4").tobytes()))
    return pd.DataFrame(out, columns=["block", "shared", "sets"])


CANDIDATES = pa.schema([("class", pa.int64()), ("n", pa.int64()), ("prefix_group", pa.int64()), ("prefix", pa.list_(pa.int64())), ("tokens", pa.binary())])
CANDIDATE_SCHEMA = "class long, n long, prefix_group long, prefix array<long>, tokens binary"


def prefixes(batches: Iterator) -> Iterator:
    """Sets to their prefixes in the order of rising frequency, without shingles that no other set has.

    Of a set of n, any set that is alike has the same among the first n - least_shared(n) + 1.
    Sets whose prefix has no shared shingle have no partner and go. Sets of one size and one
    prefix are in one prefix_group.
    """
    for batch in batches:
        for classes, sizes, data, shared, sets in zip(*(batch.column(c).to_pylist() for c in ("classes", "sizes", "tokens", "shared", "sets"))):
            known = np.concatenate([undelta(x) for x in shared])
            count = np.frombuffer(b"".join(sets), "<u4").astype(np.int64)
            order = np.argsort(known, kind="stable")
            known, count = known[order], count[order]
            tokens = unpack48(data)
            at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
            frequency = np.where(known[at] == tokens, count[at], 1)
            size = np.frombuffer(sizes, "<u4").astype(np.int64)
            ends = np.cumsum(size)
            alone = np.add.reduceat(frequency == 1, ends - size)
            length = size - least_shared(size) + 1
            rows = []
            for i in np.flatnonzero(alone < length):
                mine, often = tokens[ends[i] - size[i] : ends[i]], frequency[ends[i] - size[i] : ends[i]]
                several = often > 1
                order = np.lexsort((mine[several], often[several]))[: length[i] - alone[i]]
                prefix = mine[several][order]
                c = int.from_bytes(classes[8 * i : 8 * i + 8], "little", signed=True)
                rows.append((c, int(size[i]), class_id(np.append(prefix, np.uint64(size[i]))) if not alone[i] else c, prefix.astype(np.int64), pack48(mine)))
            columns = zip(*rows) if rows else [[] for _ in CANDIDATES]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(columns, CANDIDATES)], schema=CANDIDATES)


def verified(batches: Iterator) -> Iterator:
    """Pairs of sets that are alike."""
    for batch in batches:
        a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        keep = []
        for i, (x, y) in enumerate(zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist())):
            x, y = unpack48(x), unpack48(y)
            both = np.sort(np.concatenate([x, y]), kind="stable")
            if alike(np.count_nonzero(both[1:] == both[:-1]), len(x), len(y)):
                keep.append(i)
        yield pa.RecordBatch.from_arrays([pa.array([v[i] for i in keep], pa.int64()) for v in (a, b)], names=["a", "b"])


def size_fits(a: Column, b: Column) -> Column:
    return (DEN * F.least(a, b) >= NUM * F.greatest(a, b))


def near_pairs(postings: DataFrame) -> DataFrame:
    """Pairs of groups with a shingle in both prefixes: each with the list's first one, and with the NEAR next by size.

    A list is sorted in parts of about LIST_PART, so a shingle of very many prefixes meets more
    than one task; the pairs with the list's first one hold the parts together.
    """
    lists = postings.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("g", "n")).alias("pivot")).where("m > 1")
    rows = postings.join(lists, "token").withColumn("part", F.pmod(F.xxhash64("g"), F.ceil(F.col("m") / LIST_PART)))
    order = Window.partitionBy("token", "part").orderBy("n", "g")
    here = F.struct("g", "n")
    others = F.array(F.col("pivot"), *[F.lead(here, k).over(order) for k in range(1, NEAR + 1)])
    pairs = rows.select("g", "n", others.alias("others")).select("g", "n", F.explode("others").alias("o")).where("o is not null")
    pairs = pairs.where((F.col("g") != F.col("o.g")) & size_fits(F.col("n"), F.col("o.n")))
    return pairs.select(F.least("g", "o.g").alias("ga"), F.greatest("g", "o.g").alias("gb")).distinct()


def intersections(sets: list[np.ndarray], rows: int, columns: int) -> np.ndarray:
    """How many shingles each of the first sets shares with each of the last ones."""
    size = np.array([len(s) for s in sets])
    owner, tokens = np.repeat(np.arange(len(sets)), size), np.concatenate(sets)
    order = np.argsort(tokens, kind="stable")
    owner = owner[order]
    starts, _ = runs(tokens[order])
    lengths = np.diff(np.append(starts, len(tokens)))
    low = len(sets) - columns
    shared = np.zeros((rows, columns), dtype=np.float32)
    often = np.flatnonzero(lengths > 32)
    for at in range(0, len(often), 2048):  # shingles of many sets: products of 0/1 columns
        part = often[at : at + 2048]
        m = np.zeros((len(sets), len(part)), dtype=np.float32)
        for j, k in enumerate(part):
            m[owner[starts[k] : starts[k] + lengths[k]], j] = 1
        shared += m[:rows] @ m[low:].T
    for k in range(2, 33):  # shingles of few sets: their pairs
        here = starts[lengths == k]
        if len(here):
            group = owner[here[:, None] + np.arange(k)]
            for i in range(k):
                for j in range(k):
                    if i != j:
                        inside = (group[:, i] < rows) & (group[:, j] >= low)
                        np.add.at(shared, (group[inside, i], group[inside, j] - low), 1)
    return shared


def by_chunk(rows: DataFrame, families: list[str], scratch: Scratch, name: str) -> DataFrame:
    """Deals the sets of each family (class, n and other columns) to the pairs (i, j) of chunks that can have links.

    A family's sets are parted by size: sets that are alike are in the same or in adjoining steps of
    a factor of 4/3 (one over the similarity). Each step has chunks by hash of about CHUNK sets and
    CHUNK_SHINGLES shingles at most. side is a row's own chunk. A row goes to each pair that its chunk is in.
    """
    rows = rows.withColumn("_step", F.floor(F.log(F.col("n").cast("double")) / math.log(DEN / NUM)).cast("long"))
    counts = rows.groupBy(*families, "_step").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("m"))
    chunks = F.greatest(F.ceil(F.col("k") / CHUNK), F.ceil(F.col("m") / CHUNK_SHINGLES))
    steps = counts.groupBy(*families).agg(F.map_from_entries(F.collect_list(F.struct("_step", chunks.alias("c")))).alias("_steps"))
    steps = scratch.write(steps.select(*[F.col(f).alias(f"_{f}") for f in families], "_steps"), name)
    on = [F.col(f).eqNullSafe(F.col(f"_{f}")) for f in families]
    rows = rows.join(steps, on).drop(*[f"_{f}" for f in families])
    chunk = lambda step, k: F.shiftleft(step, 32) + k
    around = lambda step: F.transform(F.sequence(F.lit(0).cast("long"), F.coalesce(F.try_element_at("_steps", step), F.lit(0).cast("long"))), lambda k: chunk(step, k))
    all_but_last = lambda c: F.slice(c, 1, F.size(c) - 1)
    others = F.concat(*[all_but_last(around(F.col("_step") + d)) for d in (-1, 0, 1)])
    rows = rows.withColumn("side", chunk(F.col("_step"), F.pmod(F.xxhash64("class"), F.element_at("_steps", F.col("_step")))))
    rows = rows.withColumn("_other", F.explode(others))
    return rows.withColumn("i", F.least("side", "_other")).withColumn("j", F.greatest("side", "_other")).drop("_other", "_step", "_steps")


def chunk_sides(pdf: pd.DataFrame) -> tuple[pd.DataFrame, int, int]:
    """The sets of a pair of chunks, those of the first before those of the second, and how many each has; of one chunk, twice the same."""
    pdf = pdf.sort_values("side", kind="stable")
    if pdf["i"].iat[0] == pdf["j"].iat[0]:
        return pdf, len(pdf), len(pdf)
    rows = int((pdf["side"] == pdf["i"]).sum())
    return pdf, rows, len(pdf) - rows


def compare_chunks(pdf: pd.DataFrame) -> pd.DataFrame:
    """The sets of one chunk, or of one with those of another: a link for each two components that have sets that are alike."""
    pdf, rows, columns = chunk_sides(pdf)
    low = len(pdf) - columns
    ids, comp = pdf["class"].to_numpy(), pdf["comp"].to_numpy()
    sets = [unpack48(x) for x in pdf["tokens"]]
    size = np.array([len(s) for s in sets])
    shared = intersections(sets, rows, columns)
    # Row by row, so that no further matrices are made.
    found = [low + np.flatnonzero(alike(shared[k].astype(np.int64), size[k], size[low:]) & (comp[low:] != comp[k])) for k in range(rows)]
    a, b = np.repeat(np.arange(rows), [len(f) for f in found]), np.concatenate([np.empty(0, dtype=np.int64), *found])
    links = pd.DataFrame({"a": ids[a], "b": ids[b], "ca": np.minimum(comp[a], comp[b]), "cb": np.maximum(comp[a], comp[b])})
    return links.drop_duplicates(["ca", "cb"])[["a", "b"]]


def linked_documents(pdf: pd.DataFrame) -> pd.DataFrame:
    """As compare_chunks(): for each class, the documents of the classes that are alike."""
    pdf, rows, columns = chunk_sides(pdf)
    copies, n = pdf["copies"].to_numpy(), len(pdf)
    low = n - columns
    sets = [unpack48(x) for x in pdf["tokens"]]
    size = np.array([len(s) for s in sets])
    shared = intersections(sets, rows, columns)
    links = np.zeros(n, dtype=np.int64)
    for k in range(rows):
        ok = alike(shared[k].astype(np.int64), size[k], size[low:])
        if not low:
            ok[k] = False
        else:
            links[low:] += ok * copies[k]
        links[k] += copies[low:][ok].sum()
    return pd.DataFrame({"class": pdf["class"].to_numpy(), "linked": links})


def shingle_links(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, dk, class, n for each row; links a, b between classes; class, n, tokens of the classes that may have links).

    dk is the hash of doc_id and text. A class is all documents of one set of shingles; a group is
    all classes of one prefix and size, and stands in the prefix lists once, however large it is.
    Links connect just the classes that links of similarity connect; of links between components
    that are connected already not all are listed.
    """
    spark = docs.sparkSession
    small_batches(spark)
    parts, count = int(spark.conf.get("spark.sql.shuffle.partitions")), docs.count()
    buckets = max(parts, -(-count // 4000))
    listed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("dk"), "text").mapInArrow(blocks, BLOCK_SCHEMA)
    # Bucketed by block, so that the sets need not be moved again when the frequencies come back.
    table = f"shingle_blocks_{uuid.uuid4().hex}"
    try:
        listed.write.option("compression", "snappy").bucketBy(min(max(parts, -(-count // BUCKET_DOCS)), MOST_BUCKETS), "block").option("path", scratch.path("blocks")).saveAsTable(table)
        listed = spark.table(table)
        members = scratch.write(listed.where("block < 0").select("doc_id", "dk", "class", "n"), "members")
        stored = listed.where("block >= 0").select("block", "classes", "sizes", "tokens")
        shared = stored.select("block", "tokens").mapInArrow(block_tokens(buckets), "bucket int, block long, tokens binary, times binary").groupBy("bucket").applyInPandas(frequencies, "block long, shared binary, sets binary")
        shared = shared.groupBy("block").agg(F.collect_list("shared").alias("shared"), F.collect_list("sets").alias("sets"))
        found = stored.join(shared.hint("merge"), "block").select("classes", "sizes", "tokens", "shared", "sets").mapInArrow(prefixes, CANDIDATE_SCHEMA)
        found = scratch.write(found, "found")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        scratch.drop("blocks")

    sets = scratch.write(found.select("class", "n", "tokens").dropDuplicates(["class"]), "sets")
    whole = found.select("class", "n", F.col("prefix_group").alias("g"), "prefix")
    postings = scratch.write(whole.select("g", "n", "prefix").dropDuplicates(["g"]).select(F.explode("prefix").alias("token"), "g", "n"), "postings")
    member = scratch.write(whole.select("g", "class", "n").distinct(), "groups")
    groups = scratch.write(member.groupBy("g").agg(F.count(F.lit(1)).alias("k"), F.min("class").alias("first")), "group_sizes")
    scratch.drop("found")
    pairs = candidate_pairs(postings, member, groups)
    pairs = pairs.join(sets.select(F.col("class").alias("a"), F.col("tokens").alias("ta")), "a").join(sets.select(F.col("class").alias("b"), F.col("tokens").alias("tb")), "b")
    links = scratch.write(pairs.select("a", "b", "ta", "tb").mapInArrow(verified, "a long, b long"), "links")

    # Lists that were not compared in full and still hold several components are compared whole.
    roots = scratch.write(components(links, scratch, "first"), "roots")
    comps = scratch.write(member.join(roots, F.col("class") == F.col("node"), "left").select("g", "class", "n", F.coalesce("root", "class").alias("comp")), "comps")
    large = groups.where(F.col("k") > 1).select(F.col("g").alias("_g"), "k")
    sizes = postings.join(large, F.col("g") == F.col("_g"), "left").groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.max("k").alias("k"))
    in_part = sizes.where((F.col("m") > NEAR + 1) | (F.col("k") > 1)).select("token")
    by_list = postings.join(in_part, "token").join(comps.select("g", "comp").distinct(), "g").groupBy("token", "comp").agg(F.count(F.lit(1)).alias("c"))
    open_lists = by_list.groupBy("token").agg(F.count(F.lit(1)).alias("comps"), F.max(F.struct("c", "comp"))["comp"].alias("family")).where("comps > 1").select("token", "family")
    open_groups = scratch.write(postings.join(open_lists, "token").select("family", "g").distinct(), "open_groups")
    family = scratch.write(open_groups.join(comps, "g").select("family", "class", "n", "comp").distinct(), "family")
    dealt = by_chunk(family, ["family"], scratch, "family_steps").join(sets.select("class", "tokens"), "class")
    more = dealt.groupBy("family", "i", "j").applyInPandas(compare_chunks, "a long, b long")
    return members, scratch.write(links.unionByName(more), "all_links"), sets


def candidate_pairs(postings: DataFrame, member: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs of classes (a, b) to verify: pairs of groups near in a list, and of a group's own classes, expanded.

    Two groups of at most GROUP pairs of classes are expanded to all of those. Of larger ones each
    class meets the other group's first; inside a large group each meets the first one and the next
    ones in order. So a group's size counts once, not squared.
    """
    pairs = near_pairs(postings)
    a = groups.select(F.col("g").alias("ga"), F.col("k").alias("ka"), F.col("first").alias("first_a"))
    b = groups.select(F.col("g").alias("gb"), F.col("k").alias("kb"), F.col("first").alias("first_b"))
    pairs = pairs.join(a, "ga").join(b, "gb").withColumn("full", F.col("ka") * F.col("kb") <= GROUP)
    in_a, in_b = member.select(F.col("g").alias("ga"), F.col("class").alias("a")), member.select(F.col("g").alias("gb"), F.col("class").alias("b"))
    across = pairs.where("full").join(in_a, "ga").join(in_b, "gb").select("a", "b")
    to_first = pairs.where("not full").join(in_a, "ga").select("a", F.col("first_b").alias("b"))
    from_first = pairs.where("not full").join(in_b, "gb").select(F.col("first_a").alias("a"), "b")
    small = member.join(groups.where((F.col("k") > 1) & (F.col("k") * F.col("k") <= GROUP)).select("g"), "g")
    inside = small.select("g", F.col("class").alias("a")).join(small.select("g", F.col("class").alias("b")), "g").where("a < b").select("a", "b")
    large = member.join(groups.where(F.col("k") * F.col("k") > GROUP).select("g"), "g").select(F.col("g").alias("token"), F.col("class").alias("g"), "n")
    inside_large = near_pairs(large).select(F.col("ga").alias("a"), F.col("gb").alias("b"))
    every = across.unionByName(to_first).unionByName(from_first).unionByName(inside).unionByName(inside_large)
    return every.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def link_counts(members: DataFrame, roots: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """class, n_links: the other documents that a document of the class links to.

    Classes that are alike are in one component, so each component's classes of about one size are
    compared to each other, all of them: a large one in chunks, small ones many in a task. Tasks give sums, no pairs.
    """
    copies = scratch.write(members.where("class is not null").groupBy("class").agg(F.count(F.lit(1)).alias("copies")), "copies")
    size = scratch.write(roots.groupBy("root").agg(F.count(F.lit(1)).alias("k")), "component_sizes")
    tasks = max(1, -(-roots.count() // CHUNK))
    large = F.col("k") > CHUNK // 8
    dealt = roots.join(size, "root").select(F.when(large, F.col("root")).alias("family"), F.when(~large, F.pmod(F.xxhash64("root"), F.lit(tasks))).alias("task"), F.col("node").alias("class"))
    dealt = by_chunk(dealt.join(sets.select("class", "n"), "class"), ["family", "task"], scratch, "root_steps").join(copies, "class").join(sets.select("class", "tokens"), "class")
    linked = dealt.groupBy("family", "task", "i", "j").applyInPandas(linked_documents, "class long, linked long").groupBy("class").agg(F.sum("linked").alias("linked"))
    return copies.join(linked, "class", "left").select("class", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links: a row for each document.

    Words are whole texts' runs without white space, A-Z in lower case; a set has the distinct
    5-word shingles (fewer words: one shingle of all). Two documents link where
    100 * intersection >= 75 * union. component_id is the smallest doc_id that links lead to.
    n_links is the number of other rows that the document links to, those of an equal set included.

    Null and empty texts link to nothing; rows of equal sets are one class; repeated rows stay
    repeated; a null doc_id counts as no id (its component has another one, or null); a very long
    text is one set, taken whole; ties can't change the result; other columns are not used; an
    empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    members, links, sets = shingle_links(docs, scratch)
    roots = scratch.write(components(links, scratch, "last"), "last_roots")
    counts = link_counts(members, roots, sets, scratch)
    found = by_class(members, roots, scratch).join(counts.select(F.col("class").alias("_k"), "n_links"), F.col("_c") == F.col("_k"), "left").drop("_k")
    out = members.join(found, F.col("class") == F.col("_c"), "left")
    component = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("least.doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


#: Rows of a component's least document are copied so often for the join to its classes.
SALTS = 16


def by_class(members: DataFrame, roots: DataFrame, scratch: Scratch) -> DataFrame:
    """_c, least: for each class the first row of its component, in the order of doc_id (null last) and dk.

    Rows are gathered by class, then by component, before anything is joined back; a component of
    very many classes meets SALTS tasks there, and a class of very many rows is a skewed side of
    the join to the rows, which Spark splits as it runs.
    """
    row = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "dk")
    classes = members.where("class is not null").groupBy("class").agg(F.min(row).alias("least"))
    classes = scratch.write(classes.join(roots, F.col("class") == F.col("node"), "left").select("class", "root", "least"), "classes")
    alone, linked = classes.where("root is null"), classes.where("root is not null")
    least = linked.groupBy("root").agg(F.min("least").alias("first")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    linked = linked.withColumn("_salt", F.pmod(F.xxhash64("class"), F.lit(SALTS)).cast("int")).join(scratch.write(least, "least"), ["root", "_salt"])
    return alone.select(F.col("class").alias("_c"), "least").unionByName(linked.select(F.col("class").alias("_c"), F.col("first").alias("least")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents without near copies: of each component one row stays, the one with the smallest doc_id; all columns.

    Rows are told apart by doc_id and text, so of rows with one doc_id and unlike texts each is
    judged by its own text. Of rows of one doc_id in a component the one with the least hash of
    its text stays; of rows equal in both, one stays (the one whose columns have the least hash).
    A null doc_id comes after all others. Rows without words stay, however often they are there. A very
    long text is one set of shingles, over all of its words. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    members, links, _ = shingle_links(docs, scratch)
    first = by_class(members, scratch.write(components(links, scratch, "last"), "last_roots"), scratch)
    rows = members.join(first, F.col("class") == F.col("_c"))
    stays = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("dk") == F.col("least.dk"))
    # Rows that go (stays: false), and rows that stay but are there several times.
    found = rows.groupBy(F.col("doc_id").alias("_id"), F.col("dk").alias("_dk"), stays.alias("_stays")).agg(F.count(F.lit(1)).alias("_times"))
    found = scratch.write(found.where("not _stays or _times > 1"), "found_rows")
    keyed = docs.select(packed(docs).alias("row"), F.xxhash64("doc_id", "text").alias("_key"))
    same = (F.col("_key") == F.col("_dk")) & F.col("row.doc_id").eqNullSafe(F.col("_id"))
    out = keyed.join(found.select("_id", "_dk"), same, "left_anti").select("row")
    repeated = found.where("_stays")
    if not repeated.isEmpty():
        several = keyed.join(repeated, same).groupBy("_id", "_dk").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
        out = out.unionByName(several.select("row"))
    return out.select("row.*")


def op5_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_documents(spark, sf_dir))


QUERIES = {"op5_prefix_join": op5_prefix_join}
SQL: dict[str, str] = {}
