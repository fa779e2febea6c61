"""Packing documents into token windows by non-negative least squares over length combinations."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sessionrec.llm.common import Scratch, held_by_worker, read_documents, small_batches, texts_of

WINDOW = 1024
#: Longest combination of lengths that the solver considers.
DEPTH = 3
END = b"\0\0\0\0"


class Ids(dict):
    """Token ids of texts as little-endian 32-bit bytes, by the `tokenizers` library and its vocabulary file.

    The file's pre-tokenizer cuts a text into pieces (a word with the space before it, a number,
    other signs, white space) and no merge crosses pieces, so a piece's ids are those that the
    library gives for the piece alone. Pieces repeat, so their ids are kept, up to LIMIT of them.
    The pieces are cut here for texts of code points below U+0250, where the pattern's classes are
    listed in full (tests hold them against the library for each code point), and go to the library's
    model. A text with any other code point or a special token's string goes to the library whole.
    special: whether such strings count as special tokens; else they are plain text.
    """

    LIMIT, LONGEST = 800_000, 48
    #: The letters, digits and white space below U+0250.
    _L = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
    _N = r"0-9\xb2\xb3\xb9\xbc-\xbe"
    _S = r"\t-\r \x85\xa0"
    PIECE = re.compile(rf"'(?:[sdmt]|ll|ve|re)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")

    def __init__(self, path: str, special: bool = True) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kind = spec.get("pre_tokenizer") or {}
        plain = kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not kind.get("add_prefix_space") and not spec.get("normalizer")
        strings = [re.escape(t["content"]) for t in spec["added_tokens"]] if special else []
        # Other tokenizers than byte-level ones get all texts whole.
        self.whole = re.compile("|".join(["[^\\x00-\\u024f]", *strings]) if plain else "")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.model = self.tokenizer.model
        # The model takes bytes as characters: printable ones stand for themselves, the others for code points from 256 on.
        printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        self.characters = {b: chr(b) if b in printable else chr(256 + sum(x not in printable for x in range(b))) for b in range(256)}

    def encoded(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def piece_ids(self, piece: str) -> list[int]:
        as_bytes = piece.encode().decode("latin1").translate(self.characters)
        return [token.id for token in self.model.tokenize(as_bytes)]

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.piece_ids(piece), dtype="<u4").tobytes()
        if len(piece) <= self.LONGEST:
            if len(self) >= self.LIMIT:
                self.clear()
            self[piece] = ids
        return ids

    def of(self, text: str) -> bytes:
        if self.whole.search(text):
            return self.encoded(text)
        return b"".join(map(self.__getitem__, self.PIECE.findall(text)))


CUT_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task long, number long, rank long, ids binary"


def cut_documents(path: str, window: int = WINDOW):
    """Arrow batches of (doc_id, text) to pieces: whole windows, and a tail that keeps its ids.

    task and number tell pieces apart; rank counts the tails of a length in this task.
    """
    def run(batches: Iterator) -> Iterator:
        ids, task, number, seen = held_by_worker(path, lambda: Ids(path)), TaskContext.get().partitionId(), 0, np.zeros(window, dtype=np.int64)
        for batch, texts in texts_of(batches, key=path):
            rows: list[tuple] = []
            docs = batch.column("doc_id").to_pylist()
            for doc, text in zip(docs, texts):
                data = ids.of(text or "") + END
                total = len(data) // 4
                for at in range(0, total, window):
                    piece = data[4 * at : 4 * (at + window)]
                    n, number = len(piece) // 4, number + 1
                    rows.append((doc, at, n, zlib.crc32(piece), total, task, number, seen[n % window], piece if n < window else None))
                    seen[n % window] += 1
            yield batch_of(rows, CUT_ARROW)

    return run


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


CUT_ARROW = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "number", "rank")] + [("ids", pa.binary())])
OUT_ARROW = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
OUT_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def combinations(window: int = WINDOW) -> np.ndarray:
    """All ways to fill a window with two or three lengths, in ascending order; 0: no third."""
    a = np.arange(1, window // 2 + 1)
    pairs = np.stack([np.zeros_like(a), a, window - a], axis=1)
    found = [pairs]
    for x in range(1, window // DEPTH + 1) if DEPTH > 2 else ():
        y = np.arange(x, (window - x) // 2 + 1)
        found.append(np.stack([np.full_like(y, x), y, window - x - y], axis=1))
    return np.concatenate(found)


def solve_repeats(histogram: np.ndarray, combos: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Repeat counts x >= 0 that bring sum(x of the combinations with a length) near the histogram.

    Least squares by accelerated projected gradient steps; columns are the combinations, each
    with at most three entries, so a step costs their number.
    """
    n = len(histogram)
    real = combos > 0

    def lengths(x: np.ndarray) -> np.ndarray:
        return np.bincount(combos.ravel(), weights=(x[:, None] * real).ravel(), minlength=n)[:n]

    v = np.ones(len(combos))
    for _ in range(20):
        v = (lengths(v)[combos] * real).sum(axis=1)
        v /= np.linalg.norm(v)
    step = 1 / np.linalg.norm((lengths(v)[combos] * real).sum(axis=1))
    x = z = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        after = np.maximum(0, z - step * ((lengths(z) - histogram)[combos] * real).sum(axis=1))
        t_after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z = after + (t - 1) / t_after * (after - x)
        x, t = after, t_after
    return x


def rounded(x: np.ndarray, combos: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """Whole repeat counts that use no length more often than it is there: first to the nearest, then up."""
    left, counts = histogram.astype(np.int64).copy(), np.zeros(len(x), dtype=np.int64)
    order = np.argsort(-x, kind="stable")
    for up in (0.5, 1.0):
        for c in order[x[order] > 1e-3]:
            want = int(x[c] + up) - int(counts[c])
            if want <= 0:
                continue
            need: dict[int, int] = {}
            for length in combos[c]:
                if length:
                    need[int(length)] = need.get(int(length), 0) + 1
            got = min(want, *(int(left[k]) // m for k, m in need.items()))
            if got > 0:
                counts[c] += got
                for k, m in need.items():
                    left[k] -= got * m
    return counts


class Plan:
    """Which tail of a length, by its rank, goes to which window and offset. Its size is bounded by the combinations'."""

    def __init__(self, histogram: np.ndarray, window: int = WINDOW) -> None:
        combos = combinations(window)
        counts = rounded(solve_repeats(histogram, combos), combos, histogram)
        used, first = np.flatnonzero(counts), 0
        self.taken = np.zeros(window, dtype=np.int64)
        segments: dict[int, list[tuple[int, int, int]]] = {}
        for c in used:
            offset = 0
            for length in map(int, combos[c]):
                if length:
                    segments.setdefault(length, []).append((int(self.taken[length]), first, offset))
                    self.taken[length] += counts[c]
                    offset += length
            first += int(counts[c])
        self.segments = {k: tuple(np.array(s, dtype=np.int64).T) for k, s in segments.items()}

    def place(self, length: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, firsts, offsets = self.segments[length]
        at = np.searchsorted(starts, ranks, side="right") - 1
        return firsts[at] + ranks - starts[at], offsets[at]


#: The low two bits of a sequence_id tell its kind: a whole window, a combination, a residual.
WHOLE, COMBINED, RESIDUAL = 0, 1, 2


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = WINDOW) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most `window` tokens.

    A document's ids and one id 0 are cut into whole windows and a tail. The tails' histogram by
    length (window - 1 numbers) is matched by repeat counts of length combinations that fill a
    window exactly; tails get their places by their rank within their length. Tails beyond the
    rounded counts are packed greedily: each goes into the open window, is cut where that is full,
    and its rest opens the next one, so only the last sequence of all has padding. Ranks and running
    sums are made of counts by task, so no length and no document group meets in one task.

    Null texts are empty (one id 0); a null doc_id is kept as it is; repeated rows are packed each,
    and equal lengths in the order in which tasks read them; very long texts (long white space and
    long words included) are cut into windows like others, one text at a time; other columns are not
    used; an empty table gives no rows. ids_crc32 is of a piece's ids as unsigned little-endian 32 bits.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "packing")
    pieces = scratch.write(docs.select("doc_id", "text").mapInArrow(cut_documents(tokenizer_path, window), CUT_SCHEMA), "pieces")
    whole = pieces.where(F.col("length") == window).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        ((F.shiftleft("task", 40) + F.col("number")) * 4 + WHOLE).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
    tails = pieces.where(F.col("length") < window)
    counts = scratch.write(tails.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram = np.zeros(window, dtype=np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():
        histogram[length] = n
    plan = Plan(histogram, window)

    by_length = Window.partitionBy("length").orderBy("task")
    before = counts.select(F.col("task").alias("_task"), F.col("length").alias("_length"), (F.sum("n").over(by_length) - F.col("n")).alias("before"))
    ranked = tails.join(before, (F.col("task") == F.col("_task")) & (F.col("length") == F.col("_length"))).withColumn("rank", F.col("rank") + F.col("before")).drop("before", "_task", "_length")
    taken = F.element_at(F.array(*[F.lit(int(n)) for n in plan.taken]), F.col("length").cast("int") + 1)
    ranked = scratch.write(ranked.withColumn("left", F.col("rank") >= taken), "ranked")

    def combined(batches: Iterator) -> Iterator:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            length, rank = t["length"].to_numpy(), t["rank"].to_numpy()
            seq, off = np.empty(len(length), dtype=np.int64), np.empty(len(length), dtype=np.int64)
            for k in np.unique(length):
                at = length == k
                seq[at], off[at] = plan.place(int(k), rank[at])
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in OUT_ARROW.names[:5]), pa.array(seq * 4 + COMBINED), pa.array(off)], schema=OUT_ARROW)

    placed = ranked.where(~F.col("left")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInArrow(combined, OUT_SCHEMA)

    rest = ranked.where("left").drop("left", "rank")
    sums = rest.groupBy("task").agg(F.sum("length").alias("n"))
    firsts = sums.select(F.col("task").alias("_task"), (F.sum("n").over(Window.orderBy("task")) - F.col("n")).alias("first"))  # a row for each task that cut documents
    running = F.sum("length").over(Window.partitionBy("task").orderBy("number")) - F.col("length")
    rest = rest.withColumn("at", running).join(firsts, F.col("task") == F.col("_task")).withColumn("at", F.col("at") + F.col("first"))

    def residual(batches: Iterator) -> Iterator:
        for batch in batches:
            rows = []
            for doc, start, crc, total, ids, at in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "start", "ids_crc32", "doc_tokens", "ids", "at"))):
                n, done = len(ids) // 4, 0
                while done < n:
                    take = min(n - done, window - (at + done) % window)
                    part = ids[4 * done : 4 * (done + take)]
                    rows.append((doc, start + done, take, crc if take == n else zlib.crc32(part), total, (at + done) // window * 4 + RESIDUAL, (at + done) % window))
                    done += take
            yield batch_of(rows, OUT_ARROW)

    filled = rest.select("doc_id", "start", "ids_crc32", "doc_tokens", "ids", "at").mapInArrow(residual, OUT_SCHEMA)
    return whole.unionByName(placed).unionByName(filled)


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_documents(spark, sf_dir), vocabulary())


QUERIES = {"op1_pack_sequences": op1_pack_sequences}
SQL: dict[str, str] = {}
