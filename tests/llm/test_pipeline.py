"""The pipeline from end to end, and its stages on odd rows, against plain versions."""

import random
import threading
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from sessionrec.llm import mixing, packing
from sessionrec.llm.common import Scratch
from test_results import edited, plain_one_of_each, plain_repeats, text

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """documents and labels: toxic ones, copies, near copies, a shared passage, repeated and null doc_ids, null texts."""
    rng, folder = random.Random(21), tmp_path_factory.mktemp("tables")
    texts = [text(rng, rng.randrange(60, 200)) for _ in range(260)]
    rows = [(i, t) for i, t in enumerate(texts)]
    toxic = {i for i in range(260) if i % 5 == 0}
    rows = [(i, f"{t} vile rotten {t[:20]} vile" if i in toxic else t) for i, t in rows]
    rows += [(300 + k, edited(rng, rows[1][1], 0.004 * (k % 3))) for k in range(6)] + [(310, rows[2][1])] * 2
    passage = text(rng, 64)
    rows += [(400 + k, f"{text(rng, 50)} {passage} {text(rng, 50)}") for k in range(5)] + [(7, text(rng, 80)), (None, text(rng, 90)), (None, rows[3][1]), (500, None), (501, "")]
    documents = [(i, t, "en", f"s{k % 3}", len(t) if t is not None else None) for k, (i, t) in enumerate(rows)]
    spark.createDataFrame(documents, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"file://{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(0, 260)], "doc_id long, quality int, toxic int").write.parquet(f"file://{folder}/labels.parquet")
    return f"file://{folder}", rows, toxic


def plain_stages(rows, toxic):
    """What is left before the mix, as (doc_id, words)."""
    rows = [(i, t) for i, t in rows if i not in toxic or "vile" not in (t or "")]
    rows = plain_one_of_each(rows)
    # Keys in the order of doc_id, null last; ids are distinct but for those of unlike texts.
    keys = {(i is None, i or 0, k): t or "" for k, (i, t) in enumerate(rows)}
    removed = {k: gone for k, (_, gone) in plain_repeats(keys).items()}
    left = [(None if k[0] else k[1], [w for n, w in enumerate(t.split()) if n not in removed.get(k, ())], bool(t.split())) for k, t in keys.items()]
    return [(i, tuple(w)) for i, w, had in left if w or not had]


def test_run(spark, tables):
    from tokenizers import Tokenizer

    folder, rows, toxic = tables
    left = plain_stages(rows, toxic)
    scratch = Scratch(spark, "test")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = scratch.write(stage(spark, docs, folder), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert Counter((r.doc_id, tuple((r.text or "").split())) for r in docs.collect()) == Counter(left)

    mixed = scratch.write(corpus_pipeline.STAGES[3][1](spark, docs, folder), "mixed")
    report, taken = mixing.mix_report(docs).collect(), Counter()
    for r in report:
        taken[r.doc_id, r.size] += r.copies
    found = mixed.collect()
    assert Counter((r.doc_id, len(r.text.split())) for r in found) == +Counter({k: n for k, n in taken.items() if k[1]})
    assert max(Counter((r.doc_id, r.text) for r in found).values()) <= 3

    tokenizer = Tokenizer.from_file(packing.vocabulary())
    pieces = corpus_pipeline.run(spark, folder).collect()
    tokens = Counter()
    for r in found:
        tokens[r.doc_id] += len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1
    assert tokens == Counter({i: n for i, n in ((i, sum(r.length for r in pieces if r.doc_id == i)) for i in {r.doc_id for r in pieces})})
    one = defaultdict(list)
    for r in pieces:
        one[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in s) <= 1024 for s in one.values()) and sum(1 for s in one.values() if sum(n for _, n in s) < 1024) <= 1
    single = next(r for r in found if tokens[r.doc_id] and sum(x.doc_id == r.doc_id for x in found) == 1)
    ids = np.array([*tokenizer.encode(single.text, add_special_tokens=False).ids, 0], dtype="<u4")
    assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in pieces if r.doc_id == single.doc_id)


def test_mix_of_repeated_rows(spark):
    rng = random.Random(5)
    rows = [(1, "a", text(rng, 20))] * 7 + [(None, "b", text(rng, 30)) for _ in range(9)] + [(1, "b", text(rng, 11)), (None, None, "w"), (2, "a", None)]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, source string, text string, tie int").repartition(3)
    report = mixing.mix_report(docs).collect()
    assert len(report) == len(rows)
    wanted = Counter()
    for r in report:
        wanted[r.doc_id, r.size] += r.copies
    found = mixing.mix_documents(docs).collect()
    assert Counter((r.doc_id, len(r.text.split())) for r in found) == +Counter({k: n for k, n in wanted.items() if k[1]})
    assert all(n <= 3 for n in Counter(r.tie for r in found).values())


def test_tables_have_owners(spark):
    """What one thread's operators write in between is not another's to delete."""
    ready, written = threading.Event(), threading.Event()

    def other():
        ready.wait(60)
        found.append(Scratch(spark, "other").write(spark.range(5), "kept"))
        written.set()

    found: list = []
    thread = threading.Thread(target=other)
    thread.start()
    with Scratch.owned() as outer, Scratch.owned() as mine:
        gone = Scratch(spark, "mine")
        gone.write(spark.range(3), "gone")
        ready.set()
        written.wait(60)
    thread.join()
    assert mine == outer == [gone.base]
    Scratch.clear(spark, mine)
    assert found[0].count() == 5 and gone.base not in Scratch.made(spark)


def test_two_pipelines_at_the_same_time(spark):
    """They give what each gives alone."""
    alone = sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "start", "length").collect()))
    found: dict = {}
    threads = [threading.Thread(target=lambda k=k: found.setdefault(k, sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "start", "length").collect())))) for k in (0, 1)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(alone) > 100 and set(found) == {0, 1}
    # A residual's cuts depend on where it comes to lie; tokens of each document don't.
    tokens = lambda rows: sorted(Counter({i: sum(n for j, _, n in rows if j == i) for i in {i for i, _, _ in rows}}).items())
    assert tokens(found[0]) == tokens(found[1]) == tokens(alone)
