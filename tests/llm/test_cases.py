"""Odd inputs: every operator and stage takes them and gives a defined result."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sessionrec.llm import chat, fingerprints, jaccard, licenses, mixing, packing, quality, repeats, sharding, toxicity

LONG = " ".join(f"word{k}" for k in range(30_000))
TEXTS = [(1, None, "a"), (2, "", None), (3, "one two", "a"), (3, "one two", "a"), (4, LONG, "b"), (5, " \t\n ", "b"), (None, "no id here, but some words", None), (6, "É ß 😀 x", "c"), (7, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", s, len(t or "") if t is not None else None, 1, 2, 3, "x", True) for i, t, s in TEXTS]
    # Columns whose names operators use too.
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, class int, dk int, size int, removed string, rejected boolean")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(3, 1, 0), (4, 1, 1), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "packing": lambda d, l: packing.pack_documents(d, packing.vocabulary()),  # noqa: E741
    "fingerprints": lambda d, l: fingerprints.fingerprint_documents(d),  # noqa: E741
    "toxicity": toxicity.severity,
    "mixing": lambda d, l: mixing.mix_report(d),  # noqa: E741
    "jaccard": lambda d, l: jaccard.jaccard_components(d),  # noqa: E741
    "sharding": lambda d, l: sharding.shard_documents(d, sharding.even_tree(8)),  # noqa: E741
    "repeats": lambda d, l: repeats.repeated_passages(d),  # noqa: E741
    "licenses": lambda d, l: licenses.scan_licenses(d),  # noqa: E741
    "quality": lambda d, l: quality.quality_rules(d),  # noqa: E741
}
ONE_ROW_EACH = {"fingerprints", "toxicity", "mixing", "jaccard", "sharding", "quality"}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(docs, labels, name):
    found = OPERATORS[name](docs, labels).collect()
    if name in ONE_ROW_EACH:
        assert sorted(str(r.doc_id) for r in found) == sorted(str(t[0]) for t in TEXTS)
    if name in ("repeats", "licenses"):
        assert found == []  # no passage of 50 words is there twice, no notice either
    if name == "packing":
        assert {str(r.doc_id) for r in found} == {str(t[0]) for t in TEXTS}
        assert sum(r.length for r in found if r.doc_id == 1) == 1


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(docs, labels, name):
    assert OPERATORS[name](docs.limit(0), labels.limit(0)).count() == 0


STAGES = {
    "toxicity": lambda d, l: toxicity.without_toxic(d, l),  # noqa: E741
    "near_duplicates": lambda d, l: jaccard.one_of_each(d),  # noqa: E741
    "repeated_passages": lambda d, l: repeats.without_repeats(d),  # noqa: E741
    "mixing": lambda d, l: mixing.mix_documents(d),  # noqa: E741
}


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_columns(docs, labels, name):
    found = STAGES[name](docs, labels)
    assert found.columns == docs.columns
    assert {r.rejected for r in found.collect()} == {True}
    assert STAGES[name](docs.limit(0), labels).count() == 0


def test_packing_stage(spark, docs):
    found = corpus_pipeline.packing(spark, docs, None).collect()
    assert {str(r.doc_id) for r in found} == {str(t[0]) for t in TEXTS}
    assert corpus_pipeline.packing(spark, docs.limit(0), None).count() == 0


def test_chat_cases(spark):
    schema = "conv_id long, turn int, role string, text string, h int"
    rows = [(1, 0, "user", "hi", 1), (1, 1, "assistant", None, 1), (2, 0, "user", "hi", 1), (3, 0, "user", "hi", 1), (3, 1, "assistant", None, 1), (3, 2, None, "<|im_end|>", 1), (4, 5, "user", "hi", 1), (4, 5, "user", "hi", 1), (5, None, "user", "x", 1)]
    # Rows without conv_id: one extended by conversation 1, two equal ones, one equal to conversation 5.
    rows += [(None, 9, "user", "hi", 1), (None, 1, "user", "y", 1), (None, 2, "user", "y", 1), (None, 3, "user", "x", 1)]
    found = {(r.conv_id, r.n_turns, r.copies, r.formatted) for r in chat.maximal_conversations(spark.createDataFrame(rows, schema)).collect()}
    three = "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n<|im_start|>\n<| im_end|><|im_end|>\n"
    assert found == {(3, 3, 1, three), (5, 1, 2, "<|im_start|>user\nx<|im_end|>\n"), (None, 1, 2, "<|im_start|>user\ny<|im_end|>\n")}
    assert chat.maximal_conversations(spark.createDataFrame([], schema)).count() == 0


def test_very_long_conversation(spark):
    rows = spark.range(20_000).selectExpr("1L as conv_id", "cast(id as int) as turn", "'user' as role", "concat('t', id) as text")
    rows = rows.unionByName(rows.where("turn < 9000").withColumn("conv_id", rows.conv_id + 1))
    (found,) = chat.maximal_conversations(rows).collect()
    assert (found.conv_id, found.n_turns, found.formatted.count("<|im_start|>")) == (1, 20_000, 20_000)
    assert found.formatted.endswith("t19999<|im_end|>\n")


def test_copies_of_conversations(spark):
    rows = [(k, t, "user", f"t{t}") for k in (9, 7, 8) for t in range(2)]
    (found,) = chat.maximal_conversations(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()
    assert (found.conv_id, found.copies) == (7, 3)


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeated_passages", "mixing", "packing"]
