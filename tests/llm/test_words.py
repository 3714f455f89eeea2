"""Operators 11, 12 and 13."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from cityflow.llm import centroids, leaks, queries, variants


def _spellings(rng):
    """Texts of few letters, so that most words have near words, and chains of forms."""
    stems = ["".join(rng.choice("abé") for _ in range(rng.randrange(4, 9))) for _ in range(40)]
    words = [w for w in stems for _ in range(rng.randrange(1, 40))]
    for w in stems:
        for _ in range(rng.randrange(12)):
            i = rng.randrange(len(w))
            words += [rng.choice((w[:i] + w[i + 1 :], w[:i] + rng.choice("aÉz") + w[i + 1 :], w[:i] + "b" + w[i:]))] * rng.randrange(1, 6)
    chain = [("qqqqqq" + "x" * i, 3 * 2**i) for i in range(6)]
    words += [w.upper() if rng.random() < 0.1 else w for w, n in chain for _ in range(n)]
    rng.shuffle(words)
    return [(i, rng.choice((" ", "-", "1 ")).join(words[i::60])) for i in range(60)]


def test_variants_equal_all_pairs(spark, rows, empty):
    every = [(r[0], r[1]) for r in rows] + _spellings(random.Random(3)) + [(None, None), (7, ""), (7, "Aaaaa aaaaa aaaab aaaab aaaab")]
    docs = spark.createDataFrame(every, "doc_id long, text string").withColumn("n", F.lit(1)).repartition(5)
    counts = brute.counted_words(every)
    words = variants.vocabulary(docs, slips=97)
    assert {r.word: r.n for r in words.collect()} == counts and len(counts) > 100
    want = brute.spelling_variants(counts)
    assert max(len([w for w in want if want[w][1] == r]) for r in want) > 5
    for sizes in ((), (64, 128)):  # one pass, and many filters in many passes
        got = variants.grouped(words, 2, *sizes).collect()
        assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == want and len(got) == len(want)
    assert variants.variants(empty).count() == 0
    assert variants.variants(docs.where("text is null or text = ''")).count() == 0


def test_long_chain_of_forms(spark):
    words = [("r" * (5 + i), 3 * 2**i) for i in range(12)] + [("lonely", 3)]
    got = {r.word: (r.form, r.root) for r in variants.grouped(spark.createDataFrame(words, "word string, n long")).collect()}
    assert got["lonely"] == (None, "lonely") and got["r" * 16] == (None, "r" * 16)
    assert all(got["r" * (5 + i)] == ("r" * (6 + i), "r" * 16) for i in range(11))


def test_filters_spare_the_join(spark):
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abcdefghij") for _ in range(9)) for _ in range(4000)})
    table = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    [shards] = variants.passes({9: len(words)})
    blocks = variants.filters(table, shards)
    assert blocks.nbytes <= 2 * len(words) * variants.WORD_BITS // 8 + 64
    codes = variants._matrix(words)
    letters = np.arange(ord("a"), ord("j") + 1)
    some = [(s, h) for s, h, *_ in variants.edits(codes[:300], letters) if s == 9]
    mixed = variants._mixed(np.concatenate([h for _, h in some]))
    at, here = shards.places(9, mixed)
    hit = np.ones(len(mixed), bool)
    for word in range(variants.BLOCK):
        hit &= blocks[at, word] & variants._bits(mixed, word) != 0
    assert here.all() and hit.mean() < 0.005


VECTORS = "vec_id long, embedding array<float>, label int, cluster int, `a.b` string, vector string"


def test_centroids_equal_plain_rounds(spark):
    rng = np.random.default_rng(6)
    near = rng.integers(-3, 4, (30, 8))
    rows = [(int(i), (near[i % 30] + rng.normal(0, 0.2, 8)).astype(float).tolist()) for i in range(150)]
    rows += [(200 + i, [0.5] * 8) for i in range(20)] + [(200, [0.5] * 8), (3, [-0.001] * 8), (None, [1.0] * 8)]
    odd = [(300, None), (301, []), (302, [1.0] * 7), (303, [1.0] * 7 + [None]), (304, [1.0] * 7 + [float("nan")]), (305, [float("-inf")] * 8)]
    clash = (1, 2, "x", "y")
    table = spark.createDataFrame([(k, v, *clash) for k, v in rows + odd], VECTORS).repartition(4)
    floats = [(k, [float(np.float32(x)) for x in v]) for k, v in rows]
    order = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    for k, rounds in ((7, 5), (12, 1), (5, 0), (400, 2)):
        got = sorted((tuple(r) for r in centroids.clustered(table, k, rounds, 8).collect()), key=order)
        assert got == sorted(brute.clusters(floats, k, rounds, 8), key=order)
    assert centroids.clustered(table.where("vec_id >= 300"), 5, 2, 8).count() == 0


def test_far_components_are_exact_or_left_out(spark):
    far = float(centroids.largest(4) // 256 - 1)
    rows = [(0, [far] * 4), (1, [-far] * 4), (2, [1e300, 0.0, 0.0, 0.0]), (3, [0.0] * 4)]
    got = centroids.clustered(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 1, 1, 4).collect()
    assert sorted(r.vec_id for r in got) == [0, 1, 3]
    assert {r.vec_id: r.distance for r in got} == {r[0]: r[2] for r in brute.clusters([rows[i] for i in (0, 1, 3)], 1, 1, 4)}


@pytest.fixture(scope="module")
def benchmark(spark, rows):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcDéß日") for _ in range(rng.randrange(1, 4)))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((25, 10, 3, 1, 40, 11))]
    items += [(6, None), (7, ""), (8, " -- "), (None, "Nobody's item: of a few words"), (9, items[4][1].upper()), (10, items[0][1]), (10, "two words")]
    return items, spark.createDataFrame([(*r, "x", "y") for r in items], "item_id long, text string, item string, piece string")


def test_leaks_equal_plain_search(spark, rows, docs, empty, benchmark):
    items, table = benchmark
    rng = random.Random(10)
    texts = [(r[0], r[1]) for r in rows]
    cut = lambda t, n: " ".join(t.split()[(at := rng.randrange(max(1, len(t.split()) - n))) : at + n])
    for i in range(80):
        item = rng.choice([t for _, t in items if t])
        part = rng.choice((item, cut(item, 12), cut(item, 9), item.lower(), item.replace(" ", "\n, ")))
        texts.append((500 + i, f"Ünd so… {part} {rng.choice(('and more. ', ''))}{cut(item, 11)}; {part}"))
    texts += [(900, items[4][1] * 40), (900, None), (None, "TWO words"), (901, "İ 😀 two  words İ two-words")]
    given = spark.createDataFrame([(*r, 1, "s", "t") for r in texts], "doc_id long, text string, n_words int, row string, items string").repartition(3)
    want = brute.leaked(texts, items)
    assert sum(n > 0 for _, n, _, _ in want) > 60
    for size in (leaks.BLOCK_BYTES, 60):  # one automaton, and several
        found = leaks.marked(given, table, ("w", "h", "i", "s"), block_bytes=size)
        assert found.columns[:5] == given.columns
        key = lambda r: (repr(r[0]), repr(r[1]))
        got = sorted(((r.doc_id, r.text, r.w, r.h, r.i, [tuple(x) for x in r.s]) for r in found.collect()), key=key)
        assert got == sorted(((*t, *w) for t, w in zip(texts, want)), key=key)
    digests = leaks.leak_digests(given, table).collect()
    name = lambda found: hashlib.sha256(",".join(found).encode()).hexdigest()
    rows_of = lambda rs: sorted((repr(a), *b) for a, *b in rs)
    assert rows_of(digests) == rows_of((t[0], n, h, len(f), name(f), h > 0) for t, (n, h, f, _) in zip(texts, want))
    clean = leaks.without_leaks(given, table)
    assert clean.columns == given.columns and clean.count() == sum(h == 0 for _, h, _, _ in want)
    assert leaks.marked(empty, table, ("w", "h", "i", "s")).count() == 0
    assert all(r.n_hit == 0 for r in leaks.leak_digests(given, table.limit(0)).collect())
    assert leaks.without_leaks(docs, table).columns == docs.columns


def test_long_items_are_cut_into_pieces_that_lose_no_window(spark, monkeypatch):
    monkeypatch.setattr(leaks, "PIECE", 3)
    words = [f"w{i}" for i in range(40)]
    pieces = leaks._pieces(iter(spark.createDataFrame([("a", " ".join(words))], "i string, t string").toArrow().to_batches()), 10)
    found = {tuple(p.split()[i : i + 10]) for b in pieces for p in b.column(1).to_pylist() for i in range(len(p.split()) - 9)}
    assert found == {tuple(words[i : i + 10]) for i in range(31)}


def test_registered_keys():
    assert {"op11_variants", "op12_centroids", "op13_leaks"} <= set(queries.QUERIES)
