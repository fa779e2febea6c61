"""Token counts by a tokenizer compiled to a finite-state transducer."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate
from operator import attrgetter, getitem

import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionrec.llm.common import Scratch, held_by_worker, read_documents, small_batches, text_or_empty, texts_of
from sessionrec.llm.packing import batch_of, vocabulary

LIMIT = 1024
#: Code points of a chunk; longer texts are cut, and the chunks go to tasks of their own.
CHUNK = 65_536
#: Chunk maps that one group of a level of the scan composes.
FAN_IN = 64

LETTER, NUMBER, SPACE, OTHER = "letter", "number", "space", "other"
#: The white space of the pre-tokenizer's pattern.
SPACES = "\t\n\x0b\x0c\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: White space after anything else always starts a piece: what comes before no longer counts.
SYNC = regex.compile(f"(?<=[^{SPACES}])[{SPACES}]")
#: What the pattern takes as one piece after an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


class Arc(dict):
    """A transition that was taken: the tokens it emits and the state it leads to. As a mapping it has the
    arcs from there by symbol; one that is missing is compiled when it is first taken."""

    __slots__ = ("emitted", "state", "machine")

    def __init__(self, machine: Transducer, state: tuple, emitted: int) -> None:
        self.machine, self.state, self.emitted = machine, state, emitted

    def __missing__(self, symbol: str) -> Arc:
        arc = self[symbol] = self.machine.arc(self.state, symbol)
        return arc


class Transducer:
    """A deterministic transducer from code points to numbers of tokens, for a byte-level BPE vocabulary.

    Its states have two parts. The first is that of the pre-tokenizer's pattern: at a piece's start, in a
    run of letters, numbers or other signs, in white space (whose last sign is held back, since it may
    belong to the next piece), after an apostrophe. The second is that of the merges inside a piece: the
    longest suffix with which an entry of the vocabulary can still go on, and for each place in it the last
    token of the piece up to there and its distance in tokens. A sequence of tokens is what the merges
    give if each neighbouring pair is, so exactly one entry fits after those last tokens at the next byte.
    Entries have a greatest length, so there are finitely many states; those that texts reach are compiled
    as they are met, and all are dropped when there are more than LIMIT.

    A transition emits the change in the number of tokens of the text so far; the sum over a text is its
    number of tokens. A special token's string is one symbol.
    """

    LIMIT = 300_000

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kind, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not kind.get("add_prefix_space") and not spec.get("normalizer")
        odd = model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        if not plain or odd or any(t[k] for t in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word")):
            raise ValueError("only plain byte-level BPE vocabularies can be compiled")
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        # The model takes bytes as characters: printable ones stand for themselves, the others for code points from 256 on.
        printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        self.characters = {b: chr(b) if b in printable else chr(256 + sum(x not in printable for x in range(b))) for b in range(256)}
        self.entries = set(model["vocab"]) - set(self.special)
        self.open = {e[:k] for e in self.entries for k in range(1, len(e))}
        self.classes: dict[str, str] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.ends: dict[str, tuple[list[tuple[int, str]], int]] = {}
        self.reset()

    def reset(self) -> None:
        self.arcs: dict[tuple, Arc] = {}
        self.pairs.clear()
        self.ends.clear()
        self.start = Arc(self, ("start",), 0)

    def symbols(self, text: str) -> Iterable[str]:
        """The code points of a text, with the strings of special tokens as one symbol each."""
        if self.cut is None or not self.cut.search(text):
            return text
        return [s for k, part in enumerate(self.cut.split(text)) for s in ([part] if k % 2 else part)]

    def count(self, text: str) -> int:
        if len(self.arcs) > self.LIMIT:
            self.reset()
        return sum(map(attrgetter("emitted"), accumulate(self.symbols(text), getitem, initial=self.start)))

    # Compilation of transitions

    def arc(self, state: tuple, symbol: str) -> Arc:
        state, emitted = self.step(state, symbol)
        found = self.arcs.get((state, emitted))
        if found is None:
            found = self.arcs[state, emitted] = Arc(self, state, emitted)
        return found

    def class_of(self, symbol: str) -> str:
        """The pattern's class of a code point, as the library's pre-tokenizer cuts it."""
        found = self.classes.get(symbol)
        if found is None:
            together = lambda x: len(self.tokenizer.pre_tokenizer.pre_tokenize_str(x)) == 1
            found = SPACE if symbol in SPACES else LETTER if together("a" + symbol) else NUMBER if together("1" + symbol) else OTHER
            self.classes[symbol] = found
        return found

    def fits(self, last: str, entry: str) -> bool:
        """Whether the merges leave two entries side by side as they are."""
        known = self.pairs.get((last, entry))
        if known is None:
            known = self.pairs[last, entry] = [t.value for t in self.model.tokenize(last + entry)] == [last, entry]
        return known

    #: The merges' state at the start of a piece.
    EMPTY = ("", ((None, 0),))

    def merged(self, merges: tuple, symbol: str) -> tuple[tuple, int]:
        """The merges' state after a code point, and the change in tokens."""
        change = 0
        for byte in symbol.encode("utf-8", "surrogatepass"):
            suffix, places = merges
            suffix += self.characters[byte]
            fitting, kept = self.ends.get(suffix) or self.ends_of(suffix)
            for k, entry in fitting:  # the longest first; places[k] is where it would start
                last, behind = places[k]
                if last is None or self.fits(last, entry):
                    break
            else:
                raise ValueError(f"no entry fits at byte {byte}")
            step = behind + 1
            places = (*places[kept:], (entry, step))
            merges = suffix[kept:], tuple([(last, behind - step) for last, behind in places]) if step else places
            change += step
        return merges, change

    def ends_of(self, suffix: str) -> tuple[list[tuple[int, str]], int]:
        """The entries that end a string, by where they start, and from where on it can still be continued."""
        n = len(suffix)
        fitting = [(k, suffix[k:]) for k in range(n) if suffix[k:] in self.entries]
        found = self.ends[suffix] = fitting, next((k for k in range(n) if suffix[k:] in self.open), n)
        return found

    def opened(self, *symbols: str) -> tuple[tuple, int]:
        """The merges' state and tokens of a piece of these code points."""
        merges, tokens = self.EMPTY, 0
        for s in symbols:
            merges, more = self.merged(merges, s)
            tokens += more
        return merges, tokens

    def begun(self, symbol: str, space: str = "") -> tuple[tuple, int]:
        """State and tokens of a piece that starts with a code point, or with a space before it."""
        kind = self.class_of(symbol)
        if kind == SPACE:
            return ("space", None, symbol), self.opened(symbol)[1]
        if symbol == "'" and not space:
            return ("apostrophe", ""), 1
        merges, tokens = self.opened(*space, symbol)
        return ("run", kind, merges), tokens

    def step(self, state: tuple, symbol: str) -> tuple[tuple, int]:
        if symbol in self.special:
            return ("start",), 1
        kind = self.class_of(symbol)
        if state[0] == "run" and state[1] == kind:
            merges, change = self.merged(state[2], symbol)
            return ("run", kind, merges), change
        if state[0] == "apostrophe":
            # What follows may be an ending, which is one piece with the apostrophe.
            so_far = state[1] + symbol
            if so_far in ENDINGS:
                tokens = self.opened("'", *so_far)[1]
                return ("start",), tokens - self.apart(state[1])
            if any(e.startswith(so_far) for e in ENDINGS):
                return ("apostrophe", so_far), self.apart(so_far) - self.apart(state[1])
            if not state[1] and kind == OTHER:
                merges, tokens = self.opened("'", symbol)
                return ("run", kind, merges), tokens - 1
            if state[1] and kind == LETTER:
                merges, tokens = self.opened(*so_far)
                return ("run", kind, merges), 1 + tokens - self.apart(state[1])
        if state[0] == "space":
            before, held = state[1:]
            if kind == SPACE:
                before = self.merged(before or self.EMPTY, held)[0]
                return ("space", before, symbol), self.merged(before, symbol)[1]
            # The last white space leaves the run before it: a space goes to the next piece, another sign is one by itself.
            tokens = self.merged(before or self.EMPTY, held)[1]
            after, more = self.begun(symbol, " ") if held == " " else self.begun(symbol)
            return after, more + (0 if held == " " else self.opened(held)[1]) - tokens
        return self.begun(symbol)

    def apart(self, letters: str) -> int:
        """Tokens of an apostrophe and a piece of letters after it."""
        return 1 + (self.opened(*letters)[1] if letters else 0)

    # State maps of chunks

    def state_map(self, chunk: str) -> StateMap:
        found = SYNC.search(chunk)
        if found is None:
            return StateMap(chunk, None, "")
        last = found
        for last in SYNC.finditer(chunk, found.start()):
            pass
        return StateMap(chunk[: found.start()], self.count(chunk[found.start() :]), chunk[last.start() :])

    def composed(self, f: StateMap, g: StateMap) -> StateMap:
        """f, then g. It is associative."""
        if f.tokens is None:
            return StateMap(f.head + g.head, g.tokens, g.tail)
        tokens = f.tokens + self.count(f.tail + g.head) - self.count(f.tail)
        if g.tokens is None:
            return StateMap(f.head, tokens, f.tail + g.head)
        return StateMap(f.head, tokens + g.tokens, g.tail)

    def scan(self, maps: list[StateMap]) -> list[StateMap]:
        """Inclusive prefix scan in log2(n) steps, each of independent compositions."""
        step = 1
        while step < len(maps):
            maps = [m if k < step else self.composed(maps[k - step], m) for k, m in enumerate(maps)]
            step *= 2
        return maps

    def total(self, m: StateMap) -> int:
        """The map's tokens from the start state."""
        return self.count(m.head) + (m.tokens or 0)


@dataclass(frozen=True)
class StateMap:
    """A chunk as a map from the state before it to the state after it and the tokens it emits.

    White space after anything else brings all states to one. So the map runs `head`, which is before the first
    such place, from whatever state comes in; from there on it is constant: `tokens`, and the state to which
    `tail` (from the last such place on) leads from the start state. tokens is None where there is no such place.
    """

    head: str
    tokens: int | None
    tail: str


COUNT_SCHEMA = "doc_id long, n_bytes long, n_tokens long"
COUNT_ARROW = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_bytes", "n_tokens")])
KEY = [(c, pa.int64()) for c in ("doc_id", "n_bytes", "task", "number", "part")]
CHUNK_ARROW = pa.schema([*KEY, ("chunk", pa.string())])
CHUNK_SCHEMA = "doc_id long, n_bytes long, task long, number long, part long, chunk string"
MAP_ARROW = pa.schema([*KEY, ("head", pa.string()), ("tokens", pa.int64()), ("tail", pa.string())])
MAP_SCHEMA = "doc_id long, n_bytes long, task long, number long, part long, head string, tokens long, tail string"


def cuts(text: str, special: list[str], chunk: int = CHUNK) -> Iterator[str]:
    """A text in chunks; the string of a special token stays in one of them."""
    at = 0
    while at < len(text):
        to = min(at + chunk, len(text))
        for s in special:
            found = text.find(s, max(at, to - len(s) + 1), to + len(s) - 1)
            to = found + len(s) if 0 <= found < to else to
        yield text[at:to]
        at = to


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: a row for each document, counted over its whole text.

    Texts up to `chunk` code points are counted where they are read, without a shuffle. Longer ones
    are cut at any code point; their chunks are dealt evenly over all tasks, which make state maps of them, and
    the maps of a text are composed by a prefix scan in groups of FAN_IN, level by level. So no task holds more
    of a long text than its chunks, and a group holds heads and tails: a few words, or the chunks themselves
    where a text has no white space at all.

    Null texts count as empty, with no bytes and tokens; a null doc_id is kept; repeated rows are counted each;
    other columns are not used; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "tokens")
    held = f"transducer {tokenizer_path}"
    machine = lambda: held_by_worker(held, lambda: Transducer(tokenizer_path))

    def whole(batches: Iterator) -> Iterator:
        m = machine()
        for batch, texts in texts_of(batches, key=held):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(map(m.count, texts), type=pa.int64())], schema=COUNT_ARROW)

    def cut(batches: Iterator) -> Iterator:
        special, task, number = machine().special, TaskContext.get().partitionId(), 0
        for batch, texts in texts_of(batches, key=held):
            for doc, n, text in zip(batch.column("doc_id").to_pylist(), batch.column("n_bytes").to_pylist(), texts):
                yield batch_of([(doc, n, task, number, part, c) for part, c in enumerate(cuts(text, special, chunk))], CHUNK_ARROW)
                number += 1

    def mapped(batches: Iterator) -> Iterator:
        m = machine()
        for batch, chunks in texts_of(batches, "chunk", held):
            maps = [m.state_map(c) for c in chunks]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(KEY)], pa.array([x.head for x in maps]), pa.array([x.tokens for x in maps], type=pa.int64()), pa.array([x.tail for x in maps])], schema=MAP_ARROW)

    def scanned(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        last = machine().scan([StateMap(r["head"], r["tokens"], r["tail"]) for r in rows])[-1]
        first = {name: [rows[0][name]] for name, _ in KEY}
        return pa.table({**first, "part": [rows[0]["part"] // FAN_IN], "head": [last.head], "tokens": [last.tokens], "tail": [last.tail]}, schema=MAP_ARROW)

    def applied(batches: Iterator) -> Iterator:
        m = machine()
        for batch in batches:
            totals = [m.total(StateMap(h, n, "")) for h, n in zip(batch.column("head").to_pylist(), batch.column("tokens").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(totals, type=pa.int64())], schema=COUNT_ARROW)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(F.col("text")).alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    counted = rows.where(F.char_length("text") <= chunk).mapInArrow(whole, COUNT_SCHEMA)
    # Written once: numbers of rows hold for all later steps, whatever executors are lost.
    chunks = scratch.write(rows.where(F.char_length("text") > chunk).mapInArrow(cut, CHUNK_SCHEMA).repartition("task", "number", "part"), "chunks")
    most = chunks.agg(F.max("part")).first()[0]
    if most is not None:
        maps = chunks.mapInArrow(mapped, MAP_SCHEMA)
        while most > 0:
            maps = maps.groupBy("task", "number", F.floor(F.col("part") / FAN_IN).alias("group")).applyInArrow(scanned, MAP_SCHEMA)
            most //= FAN_IN
        counted = counted.unionByName(maps.select("doc_id", "n_bytes", "head", "tokens").mapInArrow(applied, COUNT_SCHEMA))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_documents(spark, sf_dir), vocabulary())


QUERIES = {"op11_token_counts": op11_token_counts}
SQL: dict[str, str] = {}
