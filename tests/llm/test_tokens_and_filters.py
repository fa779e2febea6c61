"""Token counts, tokenizer alignment and the filter audit against plain versions."""

import hashlib
import random
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from sessionrec.llm import alignment, filter_audit, token_counts
from sessionrec.llm.packing import vocabulary

BPE, PIECES = vocabulary(), vocabulary("piece_bpe_32k.model")
BITS = ["'s", "'re", "'r", "'", "'ll", " ", "  ", "\n", " \n", "\t", "a", "The", "hello", "wörld", "日本語", "1", "23", "!", "??", " ", "\xa0", "\U0001f600", "<|endoftext|>", "<|endo", "x" * 30, "ing", "\x1c", "\x85", "²", "Ⅷ", "́", "<s>", "<0x41>", "ﷺ", "\x00"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, task int, part int, key string, pair long, block int, n long"


def texts(seed, n, longest=25):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randrange(longest))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


@pytest.fixture(scope="module")
def machine():
    return token_counts.Transducer(BPE)


@pytest.fixture(scope="module")
def corpus():
    words = " ".join(f"word{k}" for k in range(30_000))
    every = [*texts(1, 300), None, "", " \t\n ", words, "y" * 150_000, " " * 70_000, "word <|endoftext|> " * 9000, "one two", "one two"]
    return [(k if k != 5 else None, t) for k, t in enumerate(every)] + [(7, "one two"), (7, "one two")]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    # Columns whose names operators use too.
    rows = [(i, t, "en", None if (i or 0) % 5 == 0 else f"s{(i or 0) % 3}", 0, 1, 2, "k", 3, 4, 5) for i, t in corpus]
    return spark.createDataFrame(rows, SCHEMA).repartition(6)


def test_transducer_counts_as_the_library(machine, library):
    for t in texts(2, 4000):
        assert machine.count(t) == len(library.encode(t, add_special_tokens=False).ids), repr(t)


def test_transducer_takes_any_code_point(machine, library):
    rng = random.Random(3)
    for _ in range(1500):
        t = "".join(chr(rng.choice([rng.randrange(0x250), rng.randrange(0x250, 0xD800), rng.randrange(0xE000, 0x30000)])) for _ in range(20))
        assert machine.count(t) == len(library.encode(t, add_special_tokens=False).ids), repr(t)


def test_state_maps_compose_in_any_way(machine):
    rng = random.Random(4)
    for t in filter(None, texts(5, 800)):
        parts = list(token_counts.cuts(t, machine.special, rng.randrange(1, 9)))
        assert "".join(parts) == t
        maps = [machine.state_map(p) for p in parts]
        prefixes = machine.scan(maps)
        assert [machine.total(m) for m in prefixes] == [machine.count("".join(parts[: k + 1])) for k in range(len(parts))]
        at = rng.randrange(len(maps))
        if 0 < at < len(maps) - 1:
            whole = machine.composed(machine.composed(prefixes[at - 1], maps[at]), machine.scan(maps[at + 1 :])[-1])
            assert machine.total(whole) == machine.count(t)


def test_few_states_are_kept(library):
    small = token_counts.Transducer(BPE)
    small.LIMIT = 50
    for t in texts(6, 300):
        assert small.count(t) == len(library.encode(t, add_special_tokens=False).ids)
        assert len(small.arcs) <= 50 + 1000


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        token_counts.Transducer(vocabulary("word_bpe_49k.json"))


@pytest.mark.parametrize("chunk", [50, token_counts.CHUNK])
def test_token_counts(docs, corpus, library, chunk):
    found = token_counts.count_tokens(docs, BPE, chunk=chunk)
    assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = Counter()
    for i, t in corpus:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want[i, len((t or "").encode()), n, n > 1024] += 1
    assert Counter(map(tuple, found.collect())) == want
    assert token_counts.count_tokens(docs.limit(0), BPE).count() == 0


def plain_alignment(corpus):
    """Every pair of tokens is looked at; short texts only."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(BPE), SentencePieceProcessor(model_file=PIECES)
    a.encode_special_tokens = True
    aligner = alignment.Aligner(BPE, PIECES)
    docs, counts = [], Counter()
    for i, t in corpus:
        ids_a, ids_b = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        spans = []
        for ids, entries in ((ids_a, aligner.bytes_a), (ids_b, aligner.bytes_b)):
            ends = [0]
            for k in ids:
                ends.append(ends[-1] + len(entries[k]))
            spans.append(list(zip(ids, ends, ends[1:])))
        back = [b"".join(e[k] for k in ids) for ids, e in ((ids_a, aligner.bytes_a), (ids_b, aligner.bytes_b))]
        if not t or back != [(" " + t).encode()] * 2:
            docs.append((i, 0, 0, 0, [], ""))
            continue
        links = [(x, y) for x, s, e in spans[0] for y, s2, e2 in spans[1] if s < e2 and s2 < e]
        common = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups = [",".join(str(x) for x, _, e in spans[0] if lo < e <= hi) + "|" + ",".join(str(y) for y, _, e in spans[1] if lo < e <= hi) for lo, hi in zip([0, *common], common)]
        counts.update(links)
        docs.append((i, len(ids_a), len(ids_b), len(groups), links, ";".join(groups)))
    highest = defaultdict(int)
    for (_, y), n in counts.items():
        highest[y] = max(highest[y], n)
    return Counter((i, n_a, n_b, n, len(ls), sum(counts[x] == highest[x[1]] for x in ls), sum(counts[x] for x in ls), hashlib.sha256(g.encode()).hexdigest() if g else "") for i, n_a, n_b, n, ls, g in docs)


@pytest.mark.parametrize("block, hot", [(40, 4), (10**6, alignment.HOT)])
def test_alignment(spark, corpus, block, hot):
    short = [(i, t) for i, t in corpus if len(t or "") < 1000] + [(900, "a ▁ b"), (901, "▁"), (902, "\n a\n  b \n")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, 1, 2, "k", 3, 4, 5) for i, t in short], SCHEMA).repartition(3)
    found = alignment.align_tokenizers(docs, BPE, PIECES, block=block, hot=hot)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(map(tuple, found.collect())) == plain_alignment(short)
    assert alignment.align_tokenizers(docs.limit(0), BPE, PIECES).count() == 0


def test_alignment_of_long_texts(docs, corpus, library):
    """Groups as text give both lists of ids back."""
    library.encode_special_tokens = True
    found = {(r.doc_id, r.n_links): r for r in alignment.align_tokenizers(docs, BPE, PIECES, digest=False).where("n_a > 2000").collect()}
    assert len(found) == 4
    for r in found.values():
        text = dict(corpus)[r.doc_id]
        left = [int(x) for g in r.groups_sha256.split(";") for x in g.split("|")[0].split(",")]
        assert left == library.encode(" " + text, add_special_tokens=False).ids and len(left) == r.n_a
        assert r.n_links == r.n_a + r.n_b - r.n_groups
    library.encode_special_tokens = False


def plain_audit(docs, labels):
    """Each order is applied to each document, one filter after another."""
    parts, shapley = defaultdict(Counter), Counter()
    good, toxic = ({i for i, *v in labels if v[k] == 1 and i is not None} for k in (0, 1))
    for i, t, source in docs:
        w, part = (t or "").encode().split(), source or ""
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t or "") > 2 * len(t or ""),
            "D": any(c in "#$%&*|" for c in t or ""), "E": i is not None and any(j is not None and j < i and (u or "") == (t or "") for j, u, _ in docs),
        }
        for order in map("".join, permutations("ABCDE")):
            gone = False
            for k, x in enumerate(order, 1):
                c = parts[part, order, k]
                c["redundant"] += fails[x] and gone
                c["unique_fails"] += fails[x] and sum(fails.values()) == 1
                if fails[x] and not gone:
                    c["removed"] += 1
                    c["good_lost"] += i in good
                    c["toxic_lost"] += i in toxic
                    shapley[part, x] += 1
                gone = gone or fails[x]
                c["kept"] += not gone
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    return sorted((p, o, k, *(c[n] for n in names), shapley[p, o[k - 1]]) for (p, o, k), c in parts.items())


def test_filter_audit(spark):
    rng = random.Random(8)
    kinds = [
        lambda: " ".join(rng.choice("abcdefgh") for _ in range(rng.choice([5, 250]))), lambda: " ".join(f"w{k}" for k in range(rng.choice([199, 200, 300]))),
        lambda: "AB" + "c" * rng.choice([97, 98, 99]), lambda: "x # y", lambda: None, lambda: "", lambda: "same text", lambda: "ÉÉÉ ok",
    ]
    rows = [(rng.choice([None, *range(150)]) if rng.random() < 0.1 else k, rng.choice(kinds)(), rng.choice([None, "", "a", "b"])) for k in range(200)]
    rows += [rows[3], rows[3]]
    labels = [(rng.randrange(200), rng.choice([0, 1, None]), rng.choice([0, 1])) for _ in range(150)] + [(None, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, source string, part int, mask int, good int").repartition(5)
    labels_df = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = filter_audit.audit_filters(docs, labels_df)
    assert found.columns[:3] == ["part", "filter_order", "step"]
    assert sorted(map(tuple, found.collect())) == plain_audit(rows, labels)
    assert filter_audit.audit_filters(docs.limit(0), labels_df).count() == 0
    none = filter_audit.audit_filters(docs, labels_df.limit(0))
    assert none.agg(F.sum("good_lost"), F.sum("toxic_lost")).first() == (0, 0)


def test_packed_fields_do_not_run_over():
    outcomes = filter_audit.packed_outcomes()
    n = 2**63 - 1
    for key in ((31, 1, 1), (0, 0, 0), (5, 1, 0)):
        assert filter_audit.unpacked(outcomes[key] * n) == [[v * n for v in row] for row in filter_audit.unpacked(outcomes[key])]
