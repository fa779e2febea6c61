"""Alignment of two tokenizers' tokens by the byte places where both end."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import accumulate, count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionrec.llm.common import Scratch, held_by_worker, read_documents, small_batches, texts_of
from sessionrec.llm.packing import Ids, batch_of, vocabulary
from sessionrec.llm.token_counts import SPACES

#: Links of a block of documents, about: each id pair of a block goes to the corpus-wide counts once.
BLOCK = 1_500_000
#: Pairs that hold at least one in HOT of all links go to all tasks; there can't be more than HOT of them.
HOT = 65_536
#: Documents of an Arrow batch.
BATCH = 200


class Pieces:
    """Token ids by the `sentencepiece` library and its model file."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(k) for k in range(self.library.get_piece_size())]
        #: The model merges neighbours only if the whole is a piece; where no piece has a space after another sign, texts may be cut there.
        self.cuts = not any(re.search("[^\u2581]\u2581", p) for p in pieces)
        self.space = self.library.piece_to_id("\u2581")

    def entries(self) -> list[bytes]:
        """The bytes for which each id stands. Ids that stand for no text have none."""
        sp, out = self.library, []
        for k in range(sp.get_piece_size()):
            piece = sp.id_to_piece(k)
            nothing = sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k)
            out.append(b"" if nothing else bytes([int(piece[3:-1], 16)]) if sp.is_byte(k) else piece.replace("\u2581", " ").encode())
        return out

    def of(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts that each start with the space which the model adds."""
        found = self.library.encode([t[1:] for t in texts], num_threads=1) if texts else []
        return [ids if len(t) > 1 else [self.space] for t, ids in zip(texts, found)]


class Numbers(dict):
    """Numbers 0, 1, ... for keys by the order in which they are first asked for."""

    def __missing__(self, key: int) -> int:
        number = self[key] = len(self)
        return number


class Aligner(dict):
    """What is known of segments of texts: (groups as text, ids of A, ids of B, number of groups, links), or None where the ids don't give the segment back.

    A text is cut before each space that follows something other than white space. There a piece of A's
    pre-tokenizer ends, and no merge of B crosses, so both tokenizers end a token and a segment's ids are those
    of the segment alone. Segments repeat, so what is known of them is kept; new ones are learned together, a batch of texts
    at a time. Links are indexes into `pairs`, the id pairs (a * 2**32 + b) met so far.
    """

    LIMIT, LONGEST = 500_000, 64

    def __init__(self, path_a: str, path_b: str) -> None:
        self.a, self.b = Ids(path_a, special=False), Pieces(path_b)
        byte_of = {c: b for b, c in self.a.characters.items()}
        entries = self.a.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (max(entries.values()) + 1)
        for entry, k in entries.items():
            self.bytes_a[k] = bytes(byte_of[c] for c in entry) if all(c in byte_of for c in entry) else b""
        self.bytes_b = self.b.entries()
        space = SPACES.replace(" ", "")
        self.segment = re.compile(f"[ {space}]*[^ {space}]+(?:[{space}][ {space}]*[^ {space}]+)*(?:[{space}][ {space}]*\\Z)?|[ {space}]+" if self.b.cuts else "(?s:.+)")
        self.pairs = Numbers()

    def __missing__(self, segment: str) -> tuple | None:
        self.learn([segment])
        return self[segment] if len(segment) <= self.LONGEST else self.pop(segment)

    def ids_a(self, segment: str) -> list[int]:
        if self.a.whole.search(segment):
            return np.frombuffer(self.a.encoded(segment), dtype="<u4").tolist()
        return [k for piece in self.a.PIECE.findall(segment) for k in self.a.piece_ids(piece)]

    def learn(self, segments: list[str]) -> None:
        """Aligns segments that are not known, one behind the other: both tokenizers end a token at each one's end.

        Cumulative ends of both go to dictionaries of their indexes; the sorted ends that both hold slice the id lists into
        groups. In a slice no two ends meet before the last, so each stretch between two ends of either tokenizer is one link.
        """
        ids = list(zip(segments, map(self.ids_a, segments), self.b.of(segments)))
        fine = []
        for segment, a, b in ids:
            whole = segment.encode("utf-8", "surrogatepass")
            if b"".join([self.bytes_b[k] for k in b]) == whole == b"".join([self.bytes_a[k] for k in a]):
                fine.append((segment, a, b))
            else:
                self[segment] = None
        if not fine:
            return
        a, b = ([k for x in fine for k in x[side]] for side in (1, 2))
        ends_a, ends_b = (list(accumulate([len(entries[k]) for k in x])) for x, entries in ((a, self.bytes_a), (b, self.bytes_b)))
        index_a, index_b = dict(zip(ends_a, count())), dict(zip(ends_b, count()))
        common = sorted(index_a.keys() & index_b.keys())
        last_a, last_b = [index_a[end] for end in common], [index_b[end] for end in common]
        groups, i, j = [], 0, 0
        for to_i, to_j in zip(last_a, last_b):
            if i == to_i and j == to_j:
                groups.append(f"{a[i]}|{b[j]}")
            else:
                groups.append(f"{','.join(map(str, a[i : to_i + 1]))}|{','.join(map(str, b[j : to_j + 1]))}")
            i, j = to_i + 1, to_j + 1
        ends = np.union1d(ends_a, ends_b)
        linked = (np.array(a, dtype=np.int64)[np.searchsorted(ends_a, ends)] << 32) + np.array(b, dtype=np.int64)[np.searchsorted(ends_b, ends)]
        links = np.fromiter(map(self.pairs.__getitem__, linked.tolist()), dtype=np.uint32, count=len(linked))
        # Where each segment's tokens, groups and links end.
        lasts = np.cumsum([len(x[1]) for x in fine]) - 1
        of_ends = np.array(ends_a)[lasts]
        to_group, to_link = np.searchsorted(common, of_ends) + 1, np.searchsorted(ends, of_ends) + 1
        g = k = 0
        for (segment, x, y), to_g, to_k in zip(fine, to_group.tolist(), to_link.tolist()):
            self[segment] = ";".join(groups[g:to_g]), len(x), len(y), to_g - g, links[k:to_k].tobytes()
            g, k = to_g, to_k

    def texts(self, texts: list[str | None]) -> Iterator[tuple[str, int, int, int, np.ndarray]]:
        """Texts one after another, as document() gives them."""
        cut = [self.segment.findall(" " + t) if t else [] for t in texts]
        new = [s for s in set().union(*cut) if s not in self]
        self.learn(new)
        for segments in cut:
            yield self.document(segments)
        for s in new:
            if len(s) > self.LONGEST:
                self.pop(s, None)

    def document(self, segments: list[str]) -> tuple[str, int, int, int, np.ndarray]:
        """What is known of a whole text by its segments."""
        found = [self[s] for s in segments]
        if not found or None in found:
            return "", 0, 0, 0, np.empty(0, dtype=np.uint32)
        groups, n_a, n_b, n, links = zip(*found)
        return ";".join(groups), sum(n_a), sum(n_b), sum(n), np.frombuffer(b"".join(links), dtype=np.uint32)

    def full(self) -> bool:
        return max(len(self), len(self.pairs)) > self.LIMIT

    def forget(self) -> None:
        """Lets go of everything; no links may be held then."""
        self.clear()
        self.pairs.clear()


_NUMBERS = ("n_a", "n_b", "n_groups", "n_links")
BLOCK_ARROW = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in _NUMBERS), ("groups", pa.string()), ("links", pa.binary()), ("pair", pa.int64()), ("n", pa.int64())])
BLOCK_SCHEMA = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, links binary, pair long, n long"
OUT_SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
OUT_ARROW = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in (*_NUMBERS, "n_best", "count_sum")), ("groups_sha256", pa.string())])


def blocks_of(path_a: str, path_b: str, block: int, digest: bool):
    """Arrow batches of (doc_id, text) to blocks: a row for each document, whose links are indexes into the block's sorted id pairs, and a row for each of those."""
    key = f"aligner {path_a} {path_b}"

    def run(batches: Iterator) -> Iterator:
        aligner, number = held_by_worker(key, lambda: Aligner(path_a, path_b)), TaskContext.get().partitionId() << 32
        rows, held, n = [], [], 0

        def closed() -> Iterator:
            """The block's distinct pairs in ascending order, and each document's links as indexes into those."""
            links = np.concatenate([*held, np.empty(0, dtype=np.uint32)])
            counts = np.bincount(links, minlength=len(aligner.pairs))
            used = np.flatnonzero(counts)
            pairs = np.fromiter(aligner.pairs, dtype=np.int64, count=len(aligner.pairs))[used]
            order = np.argsort(pairs)
            place = np.zeros(len(counts), dtype="<u4")
            place[used[order]] = np.arange(len(used))
            for k in range(0, len(rows), BATCH):
                yield batch_of([(number, *row, place[x].tobytes(), None, None) for row, x in zip(rows[k : k + BATCH], held[k : k + BATCH])], BLOCK_ARROW)
            if len(used):
                columns = {"block": pa.array(np.full(len(used), number)), "pair": pa.array(pairs[order]), "n": pa.array(counts[used[order]])}
                yield pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(len(used), f.type)) for f in BLOCK_ARROW], schema=BLOCK_ARROW)

        for batch, texts in texts_of(batches, key=key):
            if aligner.full():
                yield from closed()
                rows, held, n, number = [], [], 0, number + 1
                aligner.forget()
            for doc, (groups, n_a, n_b, n_groups, links) in zip(batch.column("doc_id").to_pylist(), aligner.texts(texts)):
                rows.append((doc, n_a, n_b, n_groups, len(links), hashlib.sha256(groups.encode()).hexdigest() if digest and n_a else groups))
                held.append(links)
                n += len(links)
                if n >= block:
                    yield from closed()
                    rows, held, n, number = [], [], 0, number + 1
        yield from closed()

    return run


def summed(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """A block's documents with the sums of their links' counts. Sorted pairs stand at the indexes that links hold."""
    order = np.argsort(pairs["pair"].to_numpy())
    count, best = pairs["count"].to_numpy()[order], pairs["best"].to_numpy()[order]
    links = [np.frombuffer(x, dtype="<u4") for x in docs["links"].to_pylist()]
    sums = {"n_best": [int(best[x].sum()) for x in links], "count_sum": [int(count[x].sum()) for x in links], "groups_sha256": docs["groups"]}
    return pa.table([sums.get(f.name, docs[f.name] if f.name in docs.column_names else None) for f in OUT_ARROW], schema=OUT_ARROW)


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str, block: int = BLOCK, hot: int = HOT, digest: bool = True) -> DataFrame:
    """Columns as in op12's contract, a row for each document: how a byte-level BPE's tokens (A) of space and text
    and a sentencepiece model's tokens (B) of the text meet. digest: groups as their SHA-256; else as text.

    Documents are tokenized and aligned where they are read, in blocks of about `block` links, which are written: a document's
    links as indexes into its block's distinct id pairs. Pairs are counted over all blocks. The counts go back to the
    blocks by a join; pairs that hold one in `hot` of all links or more, at most `hot` of them, by a broadcast, so no
    key of the join has more than that share of its rows. The greatest count of each B id is broadcast as well:
    it has a row for each entry of B's vocabulary at most. A block meets its counts in one group, whose size is
    `block` links and one document.

    Null, empty and undecodable texts have no tokens: zeros and ''. A null doc_id is kept; repeated rows count each; a very
    long text is a block of its own, larger than others; other columns are not used; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "alignment")
    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(blocks_of(path_a, path_b, block, digest), BLOCK_SCHEMA)
    made = scratch.write(made, "blocks")
    pairs = made.where("pair is not null").select("block", "pair", "n")
    counts = scratch.write(pairs.groupBy("pair").agg(F.sum("n").alias("count")), "counts")
    b = F.col("pair").bitwiseAND(F.lit(2**32 - 1))
    highest = counts.groupBy(b.alias("_b")).agg(F.max("count").alias("_highest"))  # a row for each id of B at most
    total = counts.agg(F.sum("count").alias("_total"))  # one row
    known = counts.join(F.broadcast(highest), b == F.col("_b")).crossJoin(F.broadcast(total))
    known = known.select("pair", "count", (F.col("count") == F.col("_highest")).alias("best"), (F.col("count") * hot >= F.col("_total")).alias("hot"))
    known = scratch.write(known, "known")
    many = F.broadcast(known.where("hot").select("pair", "count", "best"))  # `hot` rows at most
    few = known.where(~F.col("hot")).select("pair", "count", "best").hint("merge")  # grows with the corpus
    pairs = pairs.select(F.col("block").alias("home"), "pair")
    rest = pairs.join(many.select("pair"), "pair", "left_anti").join(few, "pair")
    returned = pairs.join(many, "pair").unionByName(rest).select("home", "pair", "count", "best")
    rows = made.where("pair is null").drop("pair", "n")
    return rows.groupBy("block").cogroup(returned.groupBy("home")).applyInArrow(summed, OUT_SCHEMA)


def op12_align_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(read_documents(spark, sf_dir), vocabulary(), vocabulary("piece_bpe_32k.model"))


QUERIES = {"op12_align_tokenizers": op12_align_tokenizers}
SQL: dict[str, str] = {}
