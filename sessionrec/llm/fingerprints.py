"""Document fingerprints by consistent weighted sampling."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sessionrec.llm.common import Scratch, lower_words, mixed, read_documents, small_batches, texts_of

#: Samples of a fingerprint; each is kept as 16 bits.
SAMPLES = 64


class Sampler:
    """Consistent weighted samples of weighted terms.

    For each term and sample there are draws r and c from Gamma(2, 1) and b from (0, 1), all made
    of the term's hash. A weight w is rounded to y = exp(r * (floor(ln w / r + b) - b)), and the
    term with the least c / (y * exp(r)) is sampled, together with its floor. Two documents agree
    in a sample with a probability of their generalised Jaccard similarity, the sum of the lesser
    weights over the sum of the greater ones.

    A term's draws are kept in tables that are emptied at `most` terms. For weight 1 the floor
    is 0, so one table has the final values.
    """

    def __init__(self, samples: int = SAMPLES, most: int = 120_000) -> None:
        self.samples, self.most = samples, most
        self.rows: dict[bytes, int] = {}
        self.hash = np.zeros(most, dtype=np.uint64)
        self.one, self.r, self.b, self.log_c = (np.zeros((most, samples), dtype=np.float32) for _ in range(4))
        self.steps = mixed(np.arange(1, 3 * samples + 1, dtype=np.uint64)).reshape(3, 1, samples)

    def _draws(self, hashes: np.ndarray) -> tuple[np.ndarray, ...]:
        bits = mixed(hashes[None, :, None] ^ self.steps)
        high = ((bits >> np.uint64(32)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-32)
        low = ((bits & np.uint64(0xFFFFFFFF)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-32)
        logs_high, logs_low = np.log(np.minimum(high[:2], np.float32(0.9999999))), np.log(np.minimum(low[:2], np.float32(0.9999999)))
        return -(logs_high[0] + logs_low[0]), np.log(-(logs_high[1] + logs_low[1])), np.minimum(high[2], np.float32(0.9999999))

    def learn(self, terms: set[bytes]) -> None:
        """Makes room for these terms and draws for those that are new."""
        import xxhash

        new = [t for t in terms if t not in self.rows]
        if len(self.rows) + len(new) > self.most:
            self.rows, new = {}, list(terms)
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            first = len(self.rows)
            hashes = np.array([xxhash.xxh64_intdigest(t) for t in part], dtype=np.uint64)
            r, log_c, b = self._draws(hashes)
            here = slice(first, first + len(part))
            self.hash[here], self.r[here], self.log_c[here], self.b[here] = hashes, r, log_c, b
            self.one[here] = log_c + r * b - r
            self.rows.update(zip(part, range(first, first + len(part))))

    def sample(self, weights: dict[bytes, int]) -> np.ndarray:
        """16-bit samples of a document; without terms all are 0."""
        if not weights:
            return np.zeros(self.samples, dtype=np.uint16)
        if len(weights) > self.most // 4:  # longer than the tables: in parts, since the least of parts' least is the least
            items = list(weights.items())
            parts = [self._least(dict(items[i : i + self.most // 4])) for i in range(0, len(items), self.most // 4)]
        else:
            parts = [self._least(weights)]
        best = np.argmin(np.stack([p[0] for p in parts]), axis=0)
        at = np.arange(self.samples)
        hashes, floors = np.stack([p[1] for p in parts])[best, at], np.stack([p[2] for p in parts])[best, at]
        return (mixed(hashes ^ mixed(floors.astype(np.int64).astype(np.uint64) + np.uint64(1))) >> np.uint64(48)).astype(np.uint16)

    def _least(self, weights: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self.learn(weights.keys())
        rows = np.fromiter(map(self.rows.__getitem__, weights), dtype=np.int64, count=len(weights))
        w = np.fromiter(weights.values(), dtype=np.float32, count=len(weights))
        single = rows[w == 1]
        many, log_w = rows[w != 1], np.log(w[w != 1])[:, None]
        found = []
        at = np.arange(self.samples)
        if len(single):
            values = self.one[single]
            best = np.argmin(values, axis=0)
            found.append((values[best, at], self.hash[single[best]], np.zeros(self.samples, dtype=np.float32)))
        if len(many):
            r, b = self.r[many], self.b[many]
            floors = np.floor(log_w / r + b)
            values = self.log_c[many] - r * (floors - b) - r
            best = np.argmin(values, axis=0)
            found.append((values[best, at], self.hash[many[best]], floors[best, at]))
        if len(found) == 1:
            return found[0]
        first = found[0][0] <= found[1][0]
        return tuple(np.where(first, x, y) for x, y in zip(*found))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.mean(a == b))


def edited_text(text: str, after: str) -> str:
    """The last quarter of the code points (rounded down) replaced by the first as many, or all, of the next text."""
    k = len(text) // 4
    return text[: len(text) - k] + after[:k]


def as_hex(samples: np.ndarray) -> str:
    return samples.astype(">u2").tobytes().hex()


FOUND = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
    ("near_edited", pa.float64()), ("near_next", pa.float64()), ("task", pa.int64()), ("edge", pa.string()), ("text", pa.string()),
])
FOUND_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, task long, edge string, text string"
RESULT = [f.name for f in FOUND][:7]


class Follower:
    """Compares each document to the next one."""

    def __init__(self) -> None:
        self.sampler = Sampler()

    def own(self, text: str) -> np.ndarray:
        return self.sampler.sample(Counter(lower_words(text)))

    def row(self, doc: int, text: str, own: np.ndarray, after: str, after_own: np.ndarray) -> tuple:
        edited = edited_text(text, after)
        other = self.own(edited)
        return (doc, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), as_hex(own), as_hex(other), likeness(own, other), likeness(own, after_own))


def follow(batches: Iterator) -> Iterator:
    """Sorted documents of a task, compared to their next. The first and the last are given with their texts too."""
    f, held, task = Follower(), None, TaskContext.get().partitionId()
    for batch, texts in texts_of(batches):
        rows = []
        for doc, text in zip(batch.column("doc_id").to_pylist(), texts):
            text = text or ""
            own = f.own(text)
            if held is None:
                rows.append((doc, None, None, None, None, None, None, task, "first", text))
            else:
                rows.append((*f.row(*held, text, own), task, None, None))
            held = (doc, text, own)
        yield rows_to_batch(rows)
    if held is not None:
        yield rows_to_batch([(held[0], None, None, None, None, None, None, task, "last", held[1])])


def rows_to_batch(rows: list[tuple], schema: pa.Schema = FOUND) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, type=x.type) for c, x in zip(columns, schema)], schema=schema)


RESULT_ARROW = pa.schema(list(FOUND)[:7])


def close(batches: Iterator) -> Iterator:
    """The last document of each task, compared to the first of the next."""
    f = Follower()
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("doc_id", "text", "after"))
        yield rows_to_batch([f.row(doc, text, f.own(text), after, f.own(after)) for doc, text, after in zip(*columns)], RESULT_ARROW)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of all documents and of their edited texts: op2's contract. Terms are the words
    of the whole text with A-Z in lower case, weighted by their counts.

    Documents are sorted by doc_id once, over ranges; within a range each meets its next one as
    rows pass by. Only the last document of each range still lacks its next one: those rows, one
    or two a task, are joined afterwards. The last document of all is followed by the first.

    Null texts are empty; a null doc_id comes before the others; rows of one doc_id follow one
    another by their texts' hash, each with a row of its own (ties there are equal texts); a single
    row follows itself; a very long text is sampled whole, in parts of its terms; an empty table
    gives no rows; other columns are not used.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "fingerprints")
    # Ranges of both, so that rows of one doc_id (as null) may fill several.
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("_h")).repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h").drop("_h")
    found = scratch.write(rows.mapInArrow(follow, FOUND_SCHEMA), "found")
    tasks = found.where(F.col("edge") == "first").select("task")  # a row for each task
    following = tasks.select(F.col("task").alias("_task"), F.coalesce(F.lead("task").over(Window.orderBy("task")), F.min("task").over(Window.partitionBy())).alias("_next"))
    firsts = found.where(F.col("edge") == "first").select(F.col("task").alias("_next"), F.col("text").alias("after"))
    lasts = found.where(F.col("edge") == "last").select("doc_id", "text", F.col("task").alias("_task"))
    closing = lasts.join(following, "_task").join(firsts, "_next").select("doc_id", "text", "after").mapInArrow(close, ", ".join(FOUND_SCHEMA.split(", ")[:7]))
    return found.where(F.col("edge").isNull()).select(*RESULT).unionByName(closing)


def op2_weighted_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(read_documents(spark, sf_dir))


QUERIES = {"op2_weighted_samples": op2_weighted_samples}
SQL: dict[str, str] = {}
