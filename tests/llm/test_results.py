"""Results against plain versions on small data."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from sessionrec.llm import components, fingerprints, jaccard, licenses, mixing, packing, quality, repeats, sharding, toxicity
from sessionrec.llm.common import Scratch, lower_words, shingles, window_hashes

WORDS = [f"w{k}" for k in range(400)]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, base, share):
    return " ".join(rng.choice(WORDS) if rng.random() < share else w for w in base.split())


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    base, short = text(rng, 160), text(rng, 12)
    out = [text(rng, rng.randrange(1, 300)) for _ in range(60)]
    out += [edited(rng, base, k / 2500) for k in range(120)]  # near copies, from equal to unlike
    out += [short] * 4 + [short + " end", text(rng, 3), "A B c", "a b C"]
    passage = text(rng, 55)
    out += [f"{text(rng, 30)} {passage} {text(rng, 20)}" for _ in range(10)] + [passage]
    out += [text(rng, 40) + " " + " ".join(["again and again"] * 40)]
    rng.shuffle(out)
    return dict(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame([(i, t, "en", f"s{i % 4}" if i % 7 else None, len(t)) for i, t in corpus.items()], "doc_id long, text string, lang string, source string, n_chars long").repartition(5)


def plain_components(corpus):
    sets = {}
    for i, t in corpus.items():
        w = t.encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("near", "group", "chunk", "part"), [(8, 64, 1024, 1024), (1, 4, 16, 8)])
def test_jaccard(docs, corpus, monkeypatch, near, group, chunk, part):
    for name, value in (("NEAR", near), ("GROUP", group), ("CHUNK", chunk), ("LIST_PART", part)):
        monkeypatch.setattr(jaccard, name, value)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()}
    assert found == plain_components(corpus)


@pytest.mark.parametrize("chunk", [512, 16])
def test_links_are_all_counted(spark, monkeypatch, chunk):
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    rng = random.Random(8)
    base = text(rng, 90)
    texts = [edited(rng, base, k / 1500) for k in range(90)] + [base] * 5 + [text(rng, 40) for _ in range(20)]
    texts += [f"{t} {end}" for t in (text(rng, 30), text(rng, 30)) for end in ("", "x", "y z")] + ["", None]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").split()) else set() for t in texts]
    wanted = {i: sum(100 * len(a & b) >= 75 * len(a | b) for j, b in enumerate(sets) if j != i and a and b) for i, a in enumerate(sets)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert {r.doc_id: r.n_links for r in jaccard.jaccard_components(docs).collect()} == wanted


def test_one_of_each(docs, corpus):
    kept = {r.doc_id for r in jaccard.one_of_each(docs).collect()}
    assert kept == {c for _, c in plain_components(corpus).values()}


def plain_one_of_each(rows):
    """Indices of the rows that stay: one of each component of rows, the first by doc_id (null last)."""
    parts = defaultdict(list)
    for i, (_, c) in plain_components({i: t or "" for i, (_, t) in enumerate(rows)}).items():
        parts[c].append(i)
    kept = []
    for c, found in parts.items():
        kept.append(found if not (rows[c][1] or "").split() else [min(found, key=lambda i: (rows[i][0] is None, rows[i][0] or 0))])
    return [rows[i] for k in kept for i in k]


def test_one_of_each_with_repeated_ids(spark):
    rng = random.Random(9)
    a, b, c = text(rng, 60), text(rng, 60), text(rng, 60)
    near_b = b + " end"
    cases = [
        [(1, a), (2, a), (2, b), (3, near_b), (3, near_b)],
        [(1, a), (1, a)],
        [(None, a), (None, a), (None, b), (4, near_b)],
        [(None, c), (None, c), (5, a), (5, b), (5, near_b), (5, a)],
        [(1, None), (1, None), (None, ""), (2, " "), (7, "one two"), (8, "ONE  two"), (8, "ONE  two")],
    ]
    for rows in cases:
        found = [(r.doc_id, r.text) for r in jaccard.one_of_each(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, dk int")).collect()]
        wanted = plain_one_of_each(rows)
        assert sorted(map(str, (i for i, _ in found))) == sorted(map(str, (i for i, _ in wanted)))
        # One row of each component: as many of each as in the plain version, where near copies count as the same text.
        same = {near_b: b, "ONE  two": "one two"}
        assert Counter(same.get(t, t) for _, t in found) == Counter(same.get(t, t) for _, t in wanted)


def test_few_labels_reject_nothing(spark):
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, f"{text(rng, 30)} {'vile' if i % 2 else ''}") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(6)], "doc_id long, quality int, toxic int")
    found = toxicity.severity(docs, labels).collect()
    assert len(found) == 40 and not any(r.rejected for r in found)
    assert toxicity.without_toxic(docs, labels).count() == 40


def test_labels_with_grades(spark):
    rng = random.Random(6)
    rows = [(i, text(rng, 40) + " vile" * (2 * (i % 3)), i % 3) for i in range(600)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, g) for i, _, g in rows if i < 400], "doc_id long, quality int, toxic int")
    by_grade = defaultdict(list)
    for r in toxicity.severity(docs, labels).collect():
        if r.doc_id >= 400:
            by_grade[r.doc_id % 3].append(r.expected_severity)
    means = [np.mean(by_grade[g]) for g in range(3)]
    assert all(abs(m - g) < 0.25 for g, m in enumerate(means))


def test_ordinal_loss_and_gradient():
    rng = np.random.default_rng(3)
    rows = [(list(map(int, rng.choice(5, k, replace=False))), rng.random(k).tolist()) for k in rng.integers(0, 5, 40)]
    grades, at = rng.integers(0, 4, 40), rng.normal(size=5 + 3)
    value, g = toxicity.ordinal_loss(toxicity.Rows(rows), grades, 5, 3, 0.3)(at)
    plain, thresholds = 0.15 * sum(x * x for x in at[:5]), [at[5], at[5] + np.exp(at[6]), at[5] + np.exp(at[6]) + np.exp(at[7])]
    for (features, values), grade in zip(rows, grades):
        above = [1.0, *(1 / (1 + np.exp(t - sum(at[f] * v for f, v in zip(features, values)))) for t in thresholds), 0.0]
        plain -= np.log(above[grade] - above[grade + 1])
    assert value == pytest.approx(plain)
    for k in range(8):
        step = np.eye(8)[k] * 1e-6
        loss = toxicity.ordinal_loss(toxicity.Rows(rows), grades, 5, 3, 0.3)
        assert g[k] == pytest.approx((loss(at + step)[0] - loss(at - step)[0]) / 2e-6, abs=1e-4)


def test_cut_off():
    assert toxicity.cut_off(np.array([0.9, 0.8, 0.3, 0.1]), np.array([1, 1, 0, 0])) == pytest.approx(0.55)
    assert toxicity.cut_off(np.array([0.2, 0.2, 0.2]), np.array([1, 0, 0])) is None
    assert toxicity.cut_off(np.array([0.9, 0.1, 0.1]), np.array([0, 1, 1])) is None


def test_large_groups_of_one_prefix(spark):
    """Sets of one size and one prefix, of two kinds that are unlike but for that prefix, and near copies among them."""
    rng = random.Random(10)
    head = " ".join(f"h{k}" for k in range(40))
    texts = [f"{head} {text(rng, 30)}" for _ in range(30)]
    texts += [edited(rng, texts[0], k / 900) for k in range(60)] + [edited(rng, texts[1], k / 900) for k in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()}
    assert found == plain_components(dict(enumerate(texts)))


def plain_repeats(corpus):
    """Document: places of repeated words, and of those to remove."""
    places = defaultdict(list)
    first, again, elsewhere = defaultdict(set), defaultdict(set), defaultdict(set)
    for i, t in sorted(corpus.items()):
        w = t.split()
        for k in range(len(w) - repeats.PASSAGE + 1):
            places[tuple(w[k : k + repeats.PASSAGE])].append((i, k))
    for found in places.values():
        for n, (i, k) in enumerate(found if len(found) > 1 else []):
            (first if n == 0 else again if i == found[0][0] else elsewhere)[i].update(range(k, k + repeats.PASSAGE))
    return {i: (first[i] | again[i] | elsewhere[i], elsewhere[i] | (again[i] - first[i])) for i in {*first, *again, *elsewhere}}


def places_of(spans):
    return {k for x in spans for k in range(x.start, x.end)}


@pytest.fixture(scope="module")
def repeating(corpus):
    """The corpus, and near copies that share a passage of an earlier document with their own words around it, and repeats within documents."""
    rng = random.Random(15)
    passage = next(t for t in corpus.values() if len(t.split()) == 55)
    around = [f"{text(rng, 60)} {passage} {text(rng, 60)}" for _ in range(3)]
    twice = text(rng, 70)
    more = [t for a in around for t in (a, edited(rng, a, 0.01), f"{text(rng, 9)} {a}")] + [f"{twice} {text(rng, 20)} {twice}", f"{twice} x {twice} {twice}", " ".join(["on and on"] * 60)]
    return {**corpus, **{1000 + k: t for k, t in enumerate(more)}}


@pytest.mark.parametrize("block", [250_000, 300])
def test_repeats(spark, repeating, monkeypatch, block):
    monkeypatch.setattr(repeats, "BLOCK", block)
    docs = spark.createDataFrame(list(repeating.items()), "doc_id long, text string").repartition(5)
    found = repeats.repeated_passages(docs).collect()
    assert {r.doc_id: (places_of(r.repeated), places_of(r.removed)) for r in found} == plain_repeats(repeating)
    assert all((r.repeated_words, r.removed_words) == (len(places_of(r.repeated)), len(places_of(r.removed))) for r in found)


def test_repeated_rows_are_one_document(spark, repeating):
    some = dict(list(repeating.items())[:40]) | {1000 + k: repeating[1000 + k] for k in range(12)}
    rows = [*some.items(), *list(some.items())[::2], (3000, None), (3000, None), (None, repeating[1000])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    wanted = plain_repeats({**some, 10**9: repeating[1000]})
    found = [(r.doc_id, places_of(r.repeated), places_of(r.removed)) for r in repeats.repeated_passages(docs).collect()]
    times = Counter(i for i, _ in rows)
    assert Counter(i for i, _, _ in found) == Counter({(None if i == 10**9 else i): times.get(None if i == 10**9 else i) for i in wanted})
    assert all(wanted[10**9 if i is None else i] == (a, b) for i, a, b in found)
    alone = spark.createDataFrame([(1, repeating[1009]), (1, repeating[1009]), (2, text(random.Random(1), 60)), (2, text(random.Random(1), 60))], "doc_id long, text string")
    assert {r.doc_id for r in repeats.repeated_passages(alone).collect()} == {1}  # repeats within itself; document 2 doesn't


def test_cut_texts(spark, repeating):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in repeating.items()], "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    removed = {i: gone for i, (_, gone) in plain_repeats(repeating).items()}
    left = repeats.without_repeats(docs).collect()
    wanted = {i: [w for k, w in enumerate(t.split()) if k not in removed.get(i, ())] for i, t in repeating.items()}
    assert {r.doc_id: r.text.split() for r in left} == {i: w for i, w in wanted.items() if w}
    assert all(len(r.text) == r.n_chars for r in left)


def test_packing(docs, corpus):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary())
    ids = {i: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], dtype="<u4") for i, t in corpus.items()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in packing.pack_documents(docs, packing.vocabulary()).collect():
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for spans, total in [(pieces[i], len(ids[i])) for i in ids] + [(s, None) for s in sequences.values()]:
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at == total if total else at <= packing.WINDOW
    padding = sum(packing.WINDOW - sum(n for _, n in s) for s in sequences.values())
    assert padding < packing.WINDOW


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary())
    return lambda t: np.array(tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_token_ids_of_odd_texts(library):
    own = packing.Ids(packing.vocabulary())
    for t in ["a  b", "  x", "a\n\nb ", "\ta", "it's we're", "é l'eau ça", "x\x85y　z", "<|endoftext|> a", "日本 語1234", "😀😀", "", "\x1c\x1d a", "a\xa0b", "x \r\n y", "''s 'll'S"]:
        assert own.of(t) == library(t), t
    rng = random.Random(4)
    alphabet = " \n\t'sdré0½²Ǆʼn_#\x00\x1f\x85\xa0ɏaB"
    for _ in range(3000):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 14)))
        assert own.of(t) == library(t), repr(t)


def test_classes_of_code_points(library):
    """Each code point below U+0250 beside letters, digits, signs and white space is cut as by the library."""
    own = packing.Ids(packing.vocabulary())
    for c in map(chr, range(0x250)):
        t = f"a{c}a 1{c}1 #{c}# {c} {c}{c}x"
        assert own.of(t) == library(t), hex(ord(c))


@pytest.mark.parametrize("t", [" " * 2_000_000 + "x", "\n" * 2_000_000 + "x", "\t" * 2_000_000, "\r\n" * 1_000_000 + "x", "ab" * 500_000, "1" * 1_000_000, "#" * 1_000_000], ids=range(7))
def test_token_ids_of_very_long_runs(library, t):
    assert packing.Ids(packing.vocabulary()).of(t) == library(t)


def test_very_long_runs_are_packed(spark, library):
    texts = [" " * 1_200_000 + "x", "z" * 1_000_000, "\r\n" * 600_000 + "end"]
    rows = packing.pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), packing.vocabulary()).collect()
    for i, t in enumerate(texts):
        ids, at = library(t) + packing.END, 0
        for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start):
            assert r.start == at and zlib.crc32(ids[4 * at : 4 * (at + r.length)]) == r.ids_crc32
            at += r.length
        assert at == len(ids) // 4


def test_fingerprints(docs, corpus):
    found = {r.doc_id: r for r in fingerprints.fingerprint_documents(docs).collect()}
    wrong, prints = [], defaultdict(set)
    for i, t in corpus.items():
        after = corpus[(i + 1) % len(corpus)]
        k = len(t) // 4
        other = t[: len(t) - k] + after[:k]
        r = found[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(other.encode()).hexdigest())
        prints[t].add(r.fingerprint)
        for like, x in ((r.near_edited, other), (r.near_next, after)):
            a, b = Counter(lower_words(t)), Counter(lower_words(x))
            wrong.append(like - sum((a & b).values()) / sum((a | b).values()))
    assert all(len(p) == 1 for p in prints.values())
    assert abs(np.mean(wrong)) < 0.02 and np.std(wrong) < 0.09


def test_mixing(docs, corpus):
    rows = mixing.mix_report(docs).collect()
    assert sorted(rows) == sorted(mixing.mix_report(docs.repartition(2)).collect())  # reruns agree, however rows lie
    source = {i: f"s{i % 4}" if i % 7 else None for i in corpus}
    taken, target = Counter(), {}
    for r in rows:
        assert r.size == len(corpus[r.doc_id].split()) and r.taken <= 3 * r.size
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert sum(target.values()) == pytest.approx(sum(len(t.split()) for t in corpus.values()))
    assert all(abs(taken[s] - target[s]) <= 300 for s in target)


def test_pivot_keeps_expectations():
    rng = np.random.default_rng(1)
    p, w = rng.random(40), rng.integers(1, 30, 40).astype(float)
    draws = np.array([mixing.pivot(p, w, rng.random(40)) for _ in range(3000)])
    assert np.allclose((draws * w).sum(axis=1), (p * w).sum())
    assert ((draws > 0) & (draws < 1)).sum(axis=1).max() <= 1
    assert np.abs(draws.mean(axis=0) - p).max() < 0.05


def settled_one_by_one(sizes, q, u):
    """Every document's probability by itself: what one takes or leaves is shared out by size among all that follow."""
    p = np.full(len(sizes), q)
    for i, w in enumerate(sizes):
        after = float(u[i] < p[i])
        p[i + 1 :] += (p[i] - after) * w * sizes[i + 1 :] / sizes[i + 1 :].sum() / sizes[i + 1 :]
        p[i] = after
    return p


def test_large_documents_trade_with_all_smaller_ones():
    rng = np.random.default_rng(4)
    sizes = np.sort(np.concatenate([[5000.0, 900.0, 800.0], rng.integers(1, 40, 1200).astype(float)]))[::-1]
    large, draws = 3, []
    for _ in range(400):
        u = rng.random(len(sizes))
        found, plain = mixing.settled(sizes[:large], 0.3, sizes.sum(), u[:large]), settled_one_by_one(sizes[: large + 1], 0.3, u[: large + 1])
        assert found[0] == plain[0] and set(found) <= {0.0, 1.0}
        draws.append(found)
        left = (0.3 * sizes.sum() - (found * sizes[:large]).sum()) / sizes[large:].sum()
        assert 0 <= left <= 1  # the rest can make up for all of it
    for k, q in ((1, 0.3), (60, 0.5)):
        explicit = np.concatenate([sizes[:k], np.full(3000, sizes[k:].sum() / 3000)])
        u = rng.random(len(explicit))
        assert mixing.settled(sizes[:k], q, sizes.sum(), u[:k]) == pytest.approx(settled_one_by_one(explicit[: k + 3000], q, u)[:k])
    assert np.abs(np.mean(draws, axis=0) - 0.3).max() < 0.08


def test_small_pools_keep_expectations_up_to_near(monkeypatch):
    monkeypatch.setattr(mixing, "NEAR", 2.0)
    monkeypatch.setattr(mixing, "LAST", 0)
    rng = np.random.default_rng(6)
    sizes = np.array([50.0, 30.0, 9.0, 5.0, 1.0])
    draws = np.array([mixing.settled(sizes, 0.35, sizes.sum(), rng.random(5)) for _ in range(20_000)])
    assert np.abs(draws.mean(axis=0) - 0.35).max() < 0.02
    assert set(np.unique(draws)) <= {0.0, 1.0}


def test_mix_is_near_its_targets_with_heavy_tails(spark):
    """Each source within 1% of its target, or within the smallest of its documents."""
    rng, rows = random.Random(9), []
    for k in range(12):
        n = [300, 900, 2500][k % 3]
        sizes = [min(int(3 * rng.paretovariate(1.1)), 3000) for _ in range(n)]
        sizes[0] = max(sizes[0], sum(sizes[1:]) // 4)  # a fifth of its source
        rows += [(len(rows) + j, "w " * s, f"source{k:02d}") for j, s in enumerate(sizes)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    found = mixing.mix_report(docs).collect()
    taken, target, least = Counter(), {}, {}
    source = {i: s for i, _, s in rows}
    for r in found:
        s = source[r.doc_id]
        assert r.taken <= 3 * r.size
        taken[s] += r.taken
        target[s], least[s] = r.target, min(r.size, least.get(s, r.size))
    assert len(found) == len(rows)
    assert {s: abs(taken[s] - t) <= max(0.01 * t, least[s]) for s, t in target.items()} == dict.fromkeys(target, True)


def test_levels_of_the_tree(docs, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 4)
    monkeypatch.setattr(mixing, "FAN_IN", 2)
    monkeypatch.setattr(mixing, "LARGE", 1)  # no document is large
    rows = mixing.mix_report(docs).collect()
    taken, target = Counter(), {}
    for r in rows:
        source = f"s{r.doc_id % 4}" if r.doc_id % 7 else None
        taken[source] += r.taken
        target[source] = r.target
    assert all(abs(taken[s] - target[s]) <= 300 for s in target) and len(rows) == docs.count()


def test_sharding(docs, corpus):
    rows = sharding.shard_documents(docs, sharding.even_tree(8)).collect()
    slots = defaultdict(list)
    for r in rows:
        assert (r.size, r.text_crc32) == (len(corpus[r.doc_id].encode()) + 1, zlib.crc32(corpus[r.doc_id].encode()))
        assert r.grown_shard in (r.shard, 8)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_weights_move_keys_within_their_subtree(spark):
    keys = spark.range(20_000).selectExpr("cast(id as string) as k")
    tree = sharding.even_tree(8)
    heavier = [sharding.Shard(s.region, s.rack, s.number, 2.0) if s.number == 0 else s for s in tree]
    both = sharding.placed(sharding.placed(keys, keys.k, tree, "a"), keys.k, heavier, "b")
    counts = Counter((r.a, r.b) for r in both.select("a", "b").collect())
    moved = {x: n for x, n in counts.items() if x[0] != x[1]}
    assert all(b < 4 for _, b in moved)  # only into region r0, whose weight rose
    share = sum(n for (_, b), n in counts.items() if b == 0) / 20_000
    assert abs(share - 2 / 9) < 0.02


def test_toxicity_on_held_out_labels(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(1500):
        words, bad = text(rng, rng.randrange(5, 200)).split(), rng.random() < 0.15
        for _ in range(rng.randrange(1, 6) if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["vile", "rotten", "badstem" + rng.choice("abcdef")]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels[:1000], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in toxicity.severity(docs, known).collect()}
    held = labels[1000:]
    assert sum(found[i].rejected == bool(t) for i, _, t in held) / len(held) > 0.97
    assert all(0 <= r.p_severe <= r.p_mild <= 1 for r in found.values())


@pytest.mark.parametrize("written", [1_000_000, 1])
def test_components_of_chains_and_stars(spark, monkeypatch, written):
    monkeypatch.setattr(components, "WRITTEN", written)
    links = [(k, k + 1) for k in range(100, 140)] + [(7, k) for k in range(200, 260)] + [(1, 250), (5, 5)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t"), "c").collect()}
    assert found == {**{k: 100 for k in range(100, 141)}, **{k: 1 for k in [1, 7, *range(200, 260)]}}


def test_licenses_between_other_words(spark):
    lines = [(1, "x " * 50 + "Licensed under the Apache License, Version 2.0. " + "y " * 50), (2, "Licensed to kill"), (3, "RELEASED UNDER THE MIT LICENSE"), (4, "Released under the license of MIT")]
    found = {(r.doc_id, r.license) for r in licenses.scan_licenses(spark.createDataFrame(lines, "doc_id long, text string")).collect()}
    assert found == {(1, "apache-2.0-line"), (3, "mit-line")}
    assert licenses.retrieval_chance() > 0.999


def plain_licenses(docs, templates):
    """Every window of each text."""
    best = {}
    for i, t in docs:
        words = licenses.template_words(t or "")
        for name, length, step, found in licenses.prepared(templates):
            for at in range(0, max(0, len(words) - 4), step):
                share = len(licenses.template_shingles(words[at : at + length]) & set(found)) / len(found)
                if 4 * share >= 3:
                    best[i, name] = max(best.get((i, name), (0, 0)), (share, -at))
    return {(i, name, round(share, 6), -at) for (i, name), (share, at) in best.items()}


def test_licenses_of_any_length(spark):
    rng = random.Random(12)
    long = " ".join(f"t{k}" for k in range(700))
    templates = {**licenses.TEMPLATES, "long": long, "five": "one two three four five", "bare": "anyone is free to copy this work at will and for ever"}
    docs, texts = [], list(templates.values())
    for k in range(60):
        t = licenses.template_words(rng.choice(texts))
        for _ in range(rng.randrange(0, 1 + len(t) // 25)):
            t[rng.randrange(len(t))] = "other"
        docs.append((k, f"{text(rng, rng.randrange(0, 90))} {' '.join(t)} {text(rng, rng.randrange(0, 90))}"))
    docs += [(100, text(rng, 500)), (101, None), (102, "license " * 300), (103, " ".join(["one two three four five x"] * 50))]
    wanted = plain_licenses(docs, templates)
    found = {tuple(r) for r in licenses.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string"), templates).collect()}
    assert found <= wanted and len(found) >= 0.99 * len(wanted)
    assert licenses.retrieval_chance(templates) > 0.999


def test_windows_hold_every_stretch():
    for m in range(5, 2000):
        length, step = licenses.window(m)
        # A stretch of m words from s on lies in the window that starts at the multiple of step before s.
        assert all(s - s // step * step + m <= length for s in range(step))


def test_very_long_text_with_licenses(spark):
    t = " ".join(["license of this software"] * 10_000 + [licenses.TEMPLATES["mit-text"]] * 3)
    found = {r.license for r in licenses.scan_licenses(spark.createDataFrame([(1, t)], "doc_id long, text string")).collect()}
    assert {"mit-text", "mit-grant"} <= found


def test_quality_measures(spark, docs, corpus):
    rows = [*corpus.items(), (900, None), (901, "a b c d e f g h " * 9), (902, "#1 $2\n#1 $2\n \n\n#1 $2"), (903, "x " * 5000)]
    found = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame([(i, t, f"h{i % 5}") for i, t in rows], "doc_id long, text string, source string")).collect()}
    failed = {}
    for i, t in rows:
        t = t or ""
        w, lines, places = t.split(), [x for x in t.split("\n") if x.strip()], defaultdict(list)
        for k in range(len(w) - 7):
            places[tuple(w[k : k + 8])].append(k)
        again = len({k + j for p in places.values() if len(p) > 1 for k in p for j in range(8)})
        r = found[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), again)
        failed[i] = len(w) < 20 or 100 * again > 30 * len(w)
        assert r.base_failed == failed[i]
        assert r.kept == (not failed[i])  # hosts that differ by chance only


def likeliest_strength(hosts):
    """Of the beta priors around the overall rate, the strength under which the hosts' failures are likeliest."""
    mean = sum(f for f, _ in hosts) / sum(n for _, n in hosts)
    beta = lambda a, b: math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)
    score = lambda s: sum(beta(f + mean * s, n - f + (1 - mean) * s) - beta(mean * s, (1 - mean) * s) for f, n in hosts)
    return max((1.05**k for k in range(200)), key=score)


@pytest.mark.parametrize("mean, strength", [(0.15, 25.0), (0.4, 5.0), (0.05, 200.0), (0.1, None)])
def test_host_prior_is_near_the_likeliest(spark, mean, strength):
    """None: all hosts have one rate, so nothing but noise is between them."""
    rng = np.random.default_rng(11)
    n = rng.integers(20, 900, 600)
    f = rng.binomial(n, rng.beta(mean * strength, (1 - mean) * strength, 600) if strength else mean)
    rows = spark.createDataFrame([(k, int(x), int(y)) for k, (x, y) in enumerate(zip(n, f))], "source int, n int, f int")
    rows = rows.selectExpr("source", "f", "explode(sequence(1, n)) as j").selectExpr("source", "j <= f as base_failed")
    found = {r.source: r for r in quality.host_verdicts(rows).collect()}
    m = f.sum() / n.sum()
    # The strength that was used, from the host whose rate was moved the most.
    k = max(found, key=lambda k: abs(found[k].host_rate - m))
    used = (f[k] - n[k] * found[k].host_rate) / (found[k].host_rate - m)
    want = likeliest_strength(list(zip(f.tolist(), n.tolist())))
    assert found[k].host_docs == n[k] and found[k].host_failed == f[k]
    assert used > 2_000 if strength is None else 0.75 < used / want < 1.33


def test_bad_hosts_go_and_small_ones_are_saved(spark):
    good, bad = " ".join(f"w{k}" for k in range(30)), "too short"
    rows = [(f"h{k}", bad if j < 4 else good) for k in range(30) for j in range(60)]
    rows += [("worst", bad if j < 36 else good) for j in range(60)] + [("small", t) for t in (bad, bad, good)]
    docs = spark.createDataFrame([(k, t, s) for k, (s, t) in enumerate(rows)], "doc_id long, text string, source string")
    found = {r.doc_id: r for r in quality.quality_rules(docs).collect()}
    for k, (s, t) in enumerate(rows):
        assert found[k].base_failed == (t == bad)
        assert found[k].kept == (t == good and s != "worst")
    rate = {s: found[k].host_rate for k, (s, _) in enumerate(rows)}
    assert rate["worst"] > 0.5 and rate["small"] < 0.25 < 2 / 3  # moved far towards the rate of all documents


def test_window_hashes():
    h = np.arange(1, 60, dtype=np.uint64) ** np.uint64(7)
    for k in (5, 31):
        w = window_hashes(np.concatenate([h, h]), k)
        assert (w[: 60 - k] == w[59 : 59 + 60 - k]).all() and len(np.unique(w)) == len(h)
    assert len(shingles(h[:3])) == 1 and len(shingles(h[:0])) == 0
