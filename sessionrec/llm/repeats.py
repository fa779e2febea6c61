"""Repeated passages by sparse suffix arrays."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionrec.llm.common import OTHER_MULTIPLIER, SPACE, Scratch, WordHash, mixed, packed, read_documents, runs, small_batches, texts_of, window_hashes, words

#: A passage is repeated if it has so many words, each equal, in two places at least.
PASSAGE = 50
#: Suffixes are kept where a run of GRAM words has the least hash of SPREAD runs in a row.
GRAM, SPREAD = 8, 20
#: Any PASSAGE words hold such a position with so many of them from it on: SPREAD - 1 before it at most.
PREFIX = PASSAGE - (SPREAD - 1)
#: A suffix is compared by codes of so many runs of words, one after another.
CODES = 3
#: Records that a task sorts at a time before it deals them out.
BLOCK = 250_000
NO_ID = 2**63 - 1


def kept_positions(hashes: np.ndarray) -> np.ndarray:
    """Where the suffixes of a text are kept: they follow from SPREAD + GRAM - 1 words around alone, so equal passages have equal ones."""
    grams = window_hashes(hashes, GRAM)
    if len(grams) < SPREAD:
        return np.empty(0, dtype=np.int64)
    least = sliding_window_view(grams, SPREAD).argmin(axis=1) + np.arange(len(grams) - SPREAD + 1)
    return np.unique(least)


def codes(hashes: np.ndarray, at: np.ndarray, words_: int) -> tuple[np.ndarray, np.ndarray]:
    """The words_ words from each place on as CODES codes of 32 bits, for runs of words one after another, in a 64-bit and a 32-bit number.

    In the order of (high, low) suffixes are sorted by their first words, then by further ones; two
    neighbours have as many runs in common as codes. Equal suffixes agree in 96 bits. Runs use
    their own multiplier each, so that no two codes come from one hash.
    """
    ends = [words_ * k // CODES for k in range(CODES + 1)]
    parts = []
    for k in range(CODES):
        step = window_hashes(hashes, ends[k + 1] - ends[k], OTHER_MULTIPLIER + 2 * k)
        parts.append(step[at + ends[k]] >> np.uint64(32))
    return (parts[0] << np.uint64(32)) | parts[1], parts[2].astype("<u4")


def same_as_before(*sorted_keys: np.ndarray) -> np.ndarray:
    """Of sorted records, those equal to the one before in all keys."""
    out = np.zeros(len(sorted_keys[0]), dtype=bool)
    out[1:] = True
    for key in sorted_keys:
        out[1:] &= key[1:] == key[:-1]
    return out


def run_numbers(repeats: np.ndarray) -> np.ndarray:
    """The run of each record, from what same_as_before() says."""
    return np.cumsum(~repeats) - 1


def by_document(dk: np.ndarray, values: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Values of each document as bytes."""
    order = np.lexsort((values, dk))
    dk, values = dk[order], values[order]
    starts, _ = runs(dk)
    ends = [*starts[1:].tolist(), len(dk)] if len(dk) else []
    return dk[starts].tolist(), [values[a:b].astype("<u4").tobytes() for a, b in zip(starts.tolist(), ends)]


SUFFIXES = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("high", pa.binary()), ("low", pa.binary()), ("dks", pa.binary()), ("at", pa.binary())])
SUFFIX_SCHEMA = "bucket int, part int, high binary, low binary, dks binary, at binary"


def suffixes(buckets: int):
    """Texts to sparse suffixes by the codes of their first PREFIX words, sorted in blocks.

    A block gives one suffix of equal ones to their bucket. Suffixes that are repeated within the
    block are given as found at once (dk, found); so a passage that stands in a third of all
    documents sends one record a block to its bucket.
    """
    def run(batches: Iterator) -> Iterator:
        table, held = WordHash(), []

        def flush() -> Iterator:
            if not held:
                return
            high, low, dks, at = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.lexsort((low, high))
            high, low, dks, at = high[order], low[order], dks[order], at[order]
            equal = same_as_before(high, low)
            twice = equal | np.append(equal[1:], False)  # equal to a neighbour
            yield dealt("part", dks[twice], {"dks": dks[twice], "at": at[twice].astype("<u4")}, buckets, SUFFIXES)
            one = ~equal
            yield dealt("bucket", mixed(high[one]), {"high": high[one], "low": low[one], "dks": dks[one], "at": at[one].astype("<u4")}, buckets, SUFFIXES)

        size = 0
        for batch, texts in texts_of(batches):
            for dk, text in zip(batch.column("dk").to_pylist(), texts):
                h = table.of(words(text))
                if len(h) < PASSAGE:
                    continue
                p = kept_positions(h)
                p = p[p <= len(h) - PREFIX]
                held.append((*codes(h, p, PREFIX), np.full(len(p), dk, dtype=np.int64), p))
                size += len(p)
                if size >= BLOCK:
                    yield from flush()
                    size = 0
        yield from flush()

    return run


def dealt(name: str, keys: np.ndarray, columns: dict[str, np.ndarray], parts: int, schema: pa.Schema) -> pa.RecordBatch:
    """One row for each of the parts that some of the keys fall to, with the columns as bytes; other columns of the schema are null."""
    part = (keys.astype(np.uint64) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    part = part[order]
    starts, _ = runs(part)
    bounds = list(zip(starts.tolist(), [*starts[1:].tolist(), len(part)])) if len(part) else []
    out = {name: part[starts].tolist() if len(part) else []} | {n: [c[order][a:b].tobytes() for a, b in bounds] for n, c in columns.items()}
    return pa.RecordBatch.from_arrays([pa.array(out.get(f.name, [None] * len(bounds)), f.type) for f in schema], schema=schema)


def joined(table: pa.Table, column: str, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(table[column].to_pylist()), dtype=dtype)


def neighbours(parts: int):
    """A bucket's suffixes, sorted; those that have their first PREFIX words in common with a neighbour are found and dealt by document."""
    def run(table: pa.Table) -> pa.Table:
        high, low, dks, at = (joined(table, c, t) for c, t in (("high", "<u8"), ("low", "<u4"), ("dks", "<i8"), ("at", "<u4")))
        order = np.lexsort((low, high))
        equal = same_as_before(high[order], low[order])
        twice = order[equal | np.append(equal[1:], False)] if len(order) else order
        return pa.Table.from_batches([dealt("part", dks[twice], {"dks": dks[twice], "at": at[twice]}, parts, FOUND)])

    return run


FOUND = pa.schema([("part", pa.int32()), ("dks", pa.binary()), ("at", pa.binary())])


def found_by_document(table: pa.Table) -> pa.Table:
    ids, found = by_document(joined(table, "dks", "<i8"), joined(table, "at", "<u4"))
    return pa.table({"dk": pa.array(ids, pa.int64()), "found": pa.array(found, pa.binary())})


#: What a passage is: the first one, one after it in the same document, or one whose first is in another document.
FIRST, AGAIN, ELSEWHERE = 0, 1, 2
PASSAGES = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("high", pa.binary()), ("low", pa.binary()), ("ords", pa.binary()), ("dks", pa.binary()), ("at", pa.binary()), ("several", pa.binary()), ("kind", pa.binary())])
PASSAGE_SCHEMA = "bucket int, part int, high binary, low binary, ords binary, dks binary, at binary, several binary, kind binary"


def extended(buckets: int):
    """Matched suffixes, extended left and right to each stretch of PASSAGE words that holds them, sorted by the codes of all its words.

    As in suffixes(), a block gives each stretch only as it stands in the first document that has
    it to its bucket, and whether others have it; those others are given as found at once.
    """
    def run(batches: Iterator) -> Iterator:
        table, held = WordHash(), []

        def flush() -> Iterator:
            if not held:
                return
            high, low, ords, dks, at = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.lexsort((at, dks, ords, low, high))
            order = order[~same_as_before(high[order], low[order], dks[order], at[order])]  # rows that repeat are one document
            high, low, ords, dks, at = high[order], low[order], ords[order], dks[order], at[order]
            equal = same_as_before(high, low)
            number = run_numbers(equal)
            first = np.flatnonzero(~equal)
            other = dks != dks[first][number]
            yield dealt("part", dks[other], {"dks": dks[other], "at": at[other].astype("<u4"), "kind": np.full(other.sum(), ELSEWHERE, dtype=np.uint8)}, buckets, PASSAGES)
            own = ~other
            several = np.bincount(number)[number] > 1 if len(number) else other
            yield dealt("bucket", mixed(high[own]), {"high": high[own], "low": low[own], "ords": ords[own], "dks": dks[own], "at": at[own].astype("<u4"), "several": several[own]}, buckets, PASSAGES)

        size = 0
        for batch, texts in texts_of(batches):
            for dk, order, found, text in zip(batch.column("dk").to_pylist(), batch.column("ord").to_pylist(), batch.column("found").to_pylist(), texts):
                h = table.of(words(text))
                p = np.unique(np.frombuffer(found, dtype="<u4")).astype(np.int64)
                last = len(h) - PASSAGE
                change = np.zeros(len(h) + 1, dtype=np.int64)
                np.add.at(change, np.maximum(p - (SPREAD - 1), 0), 1)
                np.add.at(change, p + 1, -1)
                starts = np.flatnonzero(np.cumsum(change)[: last + 1] > 0)
                held.append((*codes(h, starts, PASSAGE), np.full(len(starts), order, dtype=np.int64), np.full(len(starts), dk, dtype=np.int64), starts))
                size += len(starts)
                if size >= BLOCK:
                    yield from flush()
                    size = 0
        yield from flush()

    return run


def first_and_later(parts: int):
    """A bucket's stretches that stand in two places or more, dealt by document with their kinds: the first is by doc_id and place."""
    def run(table: pa.Table) -> pa.Table:
        high, low, ords, dks, at, several = (joined(table, c, t) for c, t in (("high", "<u8"), ("low", "<u4"), ("ords", "<i8"), ("dks", "<i8"), ("at", "<u4"), ("several", "?")))
        order = np.lexsort((at, dks, ords, low, high))
        high, low, dks, at, several = high[order], low[order], dks[order], at[order], several[order]
        # A row that repeats in another block is the same document; whether others have a stretch is kept.
        number = run_numbers(same_as_before(high, low))
        known = np.bincount(number, weights=several, minlength=1) > 0
        once = ~same_as_before(high, low, dks, at)
        high, low, dks, at, number = high[once], low[once], dks[once], at[once], number[once]
        repeated = (known | (np.bincount(number, minlength=1) > 1))[number] if len(number) else once
        equal = same_as_before(high, low)
        kind = np.where(dks == dks[~equal][number], AGAIN, ELSEWHERE) if len(number) else np.empty(0)
        kind[~equal] = FIRST
        return pa.Table.from_batches([dealt("part", dks[repeated], {"dks": dks[repeated], "at": at[repeated], "kind": kind[repeated].astype(np.uint8)}, parts, MARKS)])

    return run


MARKS = pa.schema([("part", pa.int32()), ("dks", pa.binary()), ("at", pa.binary()), ("kind", pa.binary())])


def spans_by_document(table: pa.Table) -> pa.Table:
    """The documents of a part with their repeated spans and those to remove.

    Words of stretches whose first is in another document go, whatever else they are part of: each
    such word stands at an earlier place too, and there at an earlier one yet or for good. Of
    stretches that repeat within a document, words go that are in no first stretch.
    """
    dks, at, kind = joined(table, "dks", "<i8"), joined(table, "at", "<u4").astype(np.int64), joined(table, "kind", "u1")
    order = np.lexsort((at, dks))
    dks, at, kind = dks[order], at[order], kind[order]
    starts, _ = runs(dks)
    rows = []
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(dks)]):
        first, again, elsewhere = (np.unique(at[a:b][kind[a:b] == k]) for k in (FIRST, AGAIN, ELSEWHERE))
        rows.append((int(dks[a]), spans_of(np.unique(at[a:b])), union(spans_of(elsewhere), without(spans_of(again), spans_of(first)))))
    column = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    dicts = [pa.array([[{"start": x, "end": y} for x, y in r[i]] for r in rows], column) for i in (1, 2)]
    return pa.table({"dk": pa.array([r[0] for r in rows], pa.int64()), "repeated": dicts[0], "removed": dicts[1]})


def union(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans of what is in either; overlapping and adjoining ones are one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted([*a, *b]):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def spans_of(starts: np.ndarray) -> list[tuple[int, int]]:
    """Passages by their starts as spans [from, to) of words; overlapping and adjoining ones are one."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > PASSAGE)
    return list(zip(starts[np.concatenate([[0], cut + 1])].tolist(), (starts[np.concatenate([cut, [len(starts) - 1]])] + PASSAGE).tolist()))


def without(spans: list[tuple[int, int]], kept: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What of the sorted spans is in none of the sorted kept ones."""
    out, k = [], 0
    for a, b in spans:
        while k < len(kept) and kept[k][1] <= a:
            k += 1
        at, j = a, k
        while j < len(kept) and kept[j][0] < b:
            if kept[j][0] > at:
                out.append((at, kept[j][0]))
            at = max(at, kept[j][1])
            j += 1
        if at < b:
            out.append((at, b))
    return out


SPANS = "dk long, repeated array<struct<start:int,end:int>>, removed array<struct<start:int,end:int>>"


def repeated_spans(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """dk, repeated, removed: for each document with a repeated passage all its spans, and those to remove.

    dk is xxhash64(doc_id, text), the identity of a row; equal rows are one document. Removed
    words are in passages whose first occurrence, by doc_id and place, is elsewhere (see spans_by_document).
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = docs.select(F.xxhash64("doc_id", "text").alias("dk"), F.coalesce("doc_id", F.lit(NO_ID)).alias("ord"), "text")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // 4000))
    # Each table goes as soon as the next one is written.
    listed = scratch.write(known.select("dk", "text").mapInArrow(suffixes(buckets), SUFFIX_SCHEMA), "suffixes")
    by_bucket = listed.where("bucket is not null").select("bucket", "high", "low", "dks", "at").groupBy("bucket").applyInArrow(neighbours(buckets), "part int, dks binary, at binary")
    matched = scratch.write(listed.where("part is not null").select("part", "dks", "at").unionByName(by_bucket).groupBy("part").applyInArrow(found_by_document, "dk long, found binary"), "matched")
    scratch.drop("suffixes")
    texts = known.join(matched.hint("merge"), "dk")  # grows with the documents: not broadcast at any size
    passages = scratch.write(texts.select("dk", "ord", "found", "text").mapInArrow(extended(buckets), PASSAGE_SCHEMA), "passages")
    scratch.drop("matched")
    ranked = passages.where("bucket is not null").select("bucket", "high", "low", "ords", "dks", "at", "several").groupBy("bucket").applyInArrow(first_and_later(buckets), "part int, dks binary, at binary, kind binary")
    marks = passages.where("part is not null").select("part", "dks", "at", "kind").unionByName(ranked)
    spans = scratch.write(marks.groupBy("part").applyInArrow(spans_by_document, SPANS), "spans")
    scratch.drop("passages")
    return spans


def words_in(spans_column: str) -> Column:
    return F.aggregate(spans_column, F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])


def repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, repeated_words, removed_words, repeated, removed: a row for each document with a passage of PASSAGE or more words that stands elsewhere too (or twice in it).

    Spans count words from 0. Null, empty and short texts have no passage; equal rows are one document
    and give a row each; rows of one doc_id and unlike texts are documents of their own, in the order
    of their hash; a null doc_id comes last in the order of occurrences; a very long text fills a
    block of its own; an empty table gives no rows; other columns are not used.
    """
    found = repeated_spans(docs, Scratch(docs.sparkSession, "repeats"))
    keys = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("dk"))
    return keys.join(found, "dk").select("doc_id", words_in("repeated").alias("repeated_words"), words_in("removed").alias("removed_words"), "repeated", "removed")


_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_GAPS = re.compile(r"[\x20\x09-\x0D]*")


def cut_text(text: str, removed: list[dict]) -> str:
    """The text without the removed spans of words and the white space after each."""
    bounds = [m.span() for m in _WORDS.finditer(text)]
    out, at = [], 0
    for span in removed:
        start, end = bounds[span["start"]][0], bounds[span["end"] - 1][1]
        out.append(text[at:start])
        at = _GAPS.match(text, end).end()
    return "".join([*out, text[at:]])


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with each repeated passage left at its first occurrence only, with all their columns.

    n_chars, where there, is counted anew for changed texts. A document that had words and has none
    left goes; null, empty and short texts stay. Equal rows are one document, so each keeps or loses
    the same words; null ids come last in the order of occurrences. A very long text is cut in one row, by
    spans that may be anywhere in it. An empty table gives no rows.
    """
    found = repeated_spans(docs, Scratch(docs.sparkSession, "repeats")).where(F.size("removed") > 0).select("dk", "removed")
    keyed = docs.select(packed(docs).alias("row"), F.xxhash64("doc_id", "text").alias("_dk"))
    kept = keyed.join(found.hint("merge"), F.col("_dk") == F.col("dk"), "left")  # as above

    @F.pandas_udf("string")
    def cut(text: pd.Series, removed: pd.Series) -> pd.Series:
        return pd.Series([cut_text(t, list(r)) for t, r in zip(text, removed)], dtype=object)

    changed = F.col("removed").isNotNull()
    # Only changed rows pass through Python.
    same = kept.where(~changed).select("row.*")
    new = kept.where(changed).select("row", cut("row.text", "removed").alias("cut")).where(F.translate("cut", SPACE, "") != "")
    row = F.col("row").withField("text", F.col("cut"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("cut").cast(docs.schema["n_chars"].dataType))
    return same.unionByName(new.select(row.alias("row")).select("row.*"))


def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(read_documents(spark, sf_dir))


QUERIES = {"op7_repeated_passages": op7_repeated_passages}
SQL: dict[str, str] = {}
