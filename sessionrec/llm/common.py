"""Helpers shared by the corpus operators: reading, scratch tables, word and shingle hashes."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that ends a word, as in the pattern [^\x20\x09-\x0D]+ of a word.
SPACE = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"
SHINGLE = 5
SIMILARITY = (75, 100)

_MULTIPLIER = 0x9E3779B97F4A7C15
OTHER_MULTIPLIER = 0xD1B54A32D192ED03


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of whole texts stay small: a text may have 100 kB and more.

    Frames are lazy, so the session's setting must still hold when a result is computed: it stays lowered.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


class Scratch:
    """Tables in the folder that the cluster shares for checkpoints.

    A table cuts the lineage: what is read again comes from the written files, so an executor
    that is lost costs only its running tasks. The folder is the session's
    spark.checkpoint.dir. Where none is set, a local run gets a temporary one; a cluster gets an
    error, since its executors would each write to a disk of their own. Workers get the place of
    this library, for drivers that were started elsewhere.

    Results are lazy and read these tables, so an operator can't delete what its result needs;
    clear() does, once results are written or collected. owned() tells which tables are whose: those that
    operators make inside it, in this thread, and no others.
    """

    _made: dict[str, list[str]] = {}
    _owned = threading.local()

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        context = spark.sparkContext
        context.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
        base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
        if not base:
            if context.master.split("[")[0] != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
            context.setCheckpointDir(base)
        self.base = f"{base}/{name}-{uuid.uuid4().hex}"
        self.made(spark).append(self.base)
        for owner in getattr(self._owned, "by", []):
            owner.append(self.base)

    @classmethod
    def made(cls, spark: SparkSession) -> list[str]:
        """The folders of this application's operators so far."""
        return cls._made.setdefault(spark.sparkContext.applicationId, [])

    @classmethod
    @contextmanager
    def owned(cls) -> Iterator[list[str]]:
        """A list that gets the folders of operators that this thread calls inside."""
        mine: list[str] = []
        by = cls._owned.by = [*getattr(cls._owned, "by", []), mine]
        try:
            yield mine
        finally:
            cls._owned.by = [x for x in by if x is not mine]

    @classmethod
    def clear(cls, spark: SparkSession, bases: Iterable[str] | None = None) -> None:
        """Deletes folders of this application's operators: those given, or all of them."""
        made = cls.made(spark)
        for base in list(made) if bases is None else [b for b in bases if b in made]:
            _delete(spark, base)
            made.remove(base)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(self.path(name))
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Deletes tables that no later job reads."""
        for name in names:
            _delete(self.spark, self.path(name))


def _delete(spark: SparkSession, place: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def packed(docs: DataFrame) -> Column:
    """All columns as one, so that no name of theirs can clash with those of an operator."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words_column(text: Column) -> Column:
    """The words of a text as an array, by built-in functions."""
    inner = F.btrim(text_or_empty(text), F.lit(SPACE))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, "[\\x20\\x09-\\x0D]+"))


def paired_hashes(a: Column, b: Column, lag: int) -> Column:
    """Hashes of each value of a with the value of b that stands lag after it."""
    n = F.greatest(F.size(b) - lag, F.lit(0))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, lag + 1, n), lambda x, y: F.xxhash64(x, y))


def words(text: str | None) -> list[bytes]:
    """Words in UTF-8. bytes.split() ends words at exactly \\x20 and \\x09-\\x0D."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def lower_words(text: str | None) -> list[bytes]:
    """As words(), with A-Z in lower case; bytes.lower() changes nothing else."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class WordHash(dict):
    """64-bit hashes of words; repeated words are looked up. It is emptied when it gets large."""

    LIMIT = 250_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), dtype=np.uint64, count=len(found))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finish of 64-bit values, so that any bits of them may be used."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def window_hashes(hashes: np.ndarray, k: int, multiplier: int = _MULTIPLIER) -> np.ndarray:
    """Hash of each run of k word hashes: a polynomial in an odd multiplier, mod 2**64."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    if k <= 16:
        out = np.zeros(n, dtype=np.uint64)
        for j in range(k):
            out = out * np.uint64(multiplier) + hashes[j : j + n]
        return mixed(out)
    up = powers(multiplier, len(hashes))
    sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * up, dtype=np.uint64, out=sums[1:])
    return mixed((sums[k:] - sums[:-k]) * powers(pow(multiplier, -1, 2**64), n))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0, base**1, ... mod 2**64; the longest so far is kept."""
    held = _POWERS.get(base)
    if held is None or len(held) < n:
        held = np.full(max(n, 4096), base, dtype=np.uint64)
        held[0] = 1
        held = _POWERS[base] = np.multiply.accumulate(held)
    return held[:n]


def shingles(hashes: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct k-word shingle hashes; fewer words count as one shingle; none, none."""
    if not len(hashes):
        return np.empty(0, dtype=np.uint64)
    if len(hashes) < k:
        return mixed(window_hashes(hashes, len(hashes)) + np.uint64(len(hashes)))
    return np.unique(window_hashes(hashes, k))


def runs(order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted keys: the first place of each run of equal ones, and the run of each place."""
    first = np.ones(len(order), dtype=bool)
    first[1:] = order[1:] != order[:-1]
    return np.flatnonzero(first), np.cumsum(first) - 1


#: What a Python worker holds for its next tasks, by key.
_HELD: dict = {}


def held_by_worker(key: str, make: Callable):
    """What make() gives, held for the tasks that a worker runs one after another, until one reads texts without this key."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def texts_of(batches: Iterator, column: str = "text", key: str | None = None) -> Iterator:
    """Arrow batches with the texts as Python strings. What earlier tasks left in the worker goes, but for the key's."""
    if key not in _HELD:
        _HELD.clear()
    for batch in batches:
        yield batch, batch.column(batch.schema.get_field_index(column)).to_pylist()
