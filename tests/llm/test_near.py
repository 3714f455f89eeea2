"""Operators 4, 6 and 7, and connected components."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from cityflow.llm import lines, simhash, vectors
from cityflow.llm.common import components


def test_components(spark):
    rng = random.Random(2)
    chain = [(i, i + 1) for i in range(40)]
    star = [(1000, 1000 + i) for i in range(1, 60)]
    some = [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(70)]
    pairs = chain + star + some + [(-5, 7), (3, 3), (-9, -9), (1, 0)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    got = {r.node: r.component for r in components(edges, "test").collect()}
    real = [p for p in pairs if p[0] != p[1]]
    assert got == brute.groups({n for p in real for n in p}, real)
    assert components(edges.where("a is null"), "test").count() == 0


def test_bk_tree_finds_what_a_scan_finds():
    rng = np.random.default_rng(1)
    points = np.unique(rng.integers(0, 2**16, 300).astype(np.uint64))
    points = rng.permutation(points)
    tree = simhash.BKTree(points)
    assert not list(simhash.BKTree(points[:0]).within(points, 2))
    for radius in (0, 2, 5):
        got = sorted((int(p), int(n)) for probe, node in tree.within(points, radius) for p, n in zip(probe, node))
        far = np.bitwise_count(points[:, None] ^ points[None, :])
        assert got == sorted(zip(*(x.tolist() for x in np.nonzero(far <= radius))))


@pytest.fixture(scope="module")
def planted(spark, rows):
    """The common rows and chains of near copies whose prints differ by few bits."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = []
    for _ in range(3):
        tokens = [word() for _ in range(400)]
        for _ in range(25):
            texts.append(" ".join(tokens))
            tokens[rng.randrange(400)] = word()
    every = [(r[0], r[1]) for r in rows] + [(1000 + i, t) for i, t in enumerate(texts)]
    return every, spark.createDataFrame(every, "doc_id long, text string").withColumn("component", F.lit("x"))


def test_simhash_groups(planted, empty):
    rows, docs = planted
    prints = [brute.simhash(t) for _, t in rows]
    nodes = sorted(set(prints))
    near = [(a, b) for i, a in enumerate(nodes) for b in nodes[:i] if (a ^ b).bit_count() <= 2]
    assert len(near) > 30
    of, least = brute.groups(nodes, near), {}
    for (k, _), p in zip(rows, prints):
        if k is not None:
            least[of[p]] = min(k, least.get(of[p], k))
    want = Counter((k, f"{p:016x}", least.get(of[p])) for (k, _), p in zip(rows, prints))
    got = simhash.near_duplicates(docs).select("doc_id", simhash.hex_print("print").alias("p"), "component_id")
    assert Counter(map(tuple, got.collect())) == want
    assert simhash.near_duplicates(empty).count() == 0


def test_large_shards_are_cut_and_lose_nothing(planted, monkeypatch):
    _, docs = planted
    want = Counter(map(tuple, simhash.near_duplicates(docs).collect()))
    monkeypatch.setattr(simhash, "SHARD", 8)  # only the driver plans with it
    assert Counter(map(tuple, simhash.near_duplicates(docs).collect())) == want


def test_similar_documents_keep_one(planted, empty, monkeypatch):
    rows, docs = planted
    distinct = sorted({t or "" for _, t in rows})
    sets = {t: brute.shingles(t) for t in distinct}
    near = [(a, b) for i, a in enumerate(distinct) for b in distinct[:i] if brute.similar(sets[a], sets[b])]
    of, first = brute.groups(distinct, near), {}
    for k, t in rows:
        key = of[t or ""]
        first[key] = min(first.get(key, (True, 0)), (k is None, k or 0))
    for size in (2048, 8):
        monkeypatch.setattr(simhash, "SHARD", size)
        kept = simhash.keep_first(docs)
        assert kept.columns == docs.columns
        assert Counter((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == Counter(first.values())
    assert simhash.keep_first(empty).count() == 0


def test_similar_documents_lose_no_pair(spark, monkeypatch):
    rng = random.Random(21)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts = []
    for _ in range(8):  # equal sets but for few, of unequal repetition
        body, phrase = words(300), words(10)
        texts += [" ".join(body + phrase), " ".join(body + phrase * 30)]
    passage = words(60)
    for i in range(20):  # what shares a passage is not alike, and what is alike stands beside it
        one = words(30 + i) + passage
        texts += [" ".join(one), " ".join(words(1) + one[1:])]
    short = [words(8) for _ in range(40)]
    texts += [" ".join(x) for x in short] + [" ".join(x + words(1)) for x in short]
    sets = [brute.shingles(t) for t in texts]
    near = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if brute.similar(a, b)]
    of = brute.groups(range(len(texts)), near)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for radius in (20, -1):  # also where SimHashes find nothing
        monkeypatch.setattr(simhash, "WIDE", radius)
        assert {r.doc_id for r in simhash.keep_first(frame).collect()} == {*of.values()}
    assert len({*of.values()}) < len(texts) - 60


def test_vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 16))
    rows = []
    for i in range(240):
        v = centres[i % 6] + rng.normal(size=16) * rng.choice([0.05, 0.3, 2])
        rows.append((i, [float(np.float32(x)) for x in v], i % 4 if i % 11 else None))
    rows += [(500 + i, rows[1][1], 1) for i in range(30)]  # copies
    rows += [(600, None, 1), (601, [0.0] * 16, 1), (602, [float("nan")] + [1.0] * 15, 1), (603, [None] + [1.0] * 15, 1), (604, [], 1)]
    rows += [(605, [1.0, 0.0], 1), (606, [float("inf")] * 16, 1), (607, [1.0, 0.0], 1), (608, [2.0, -0.0], 1), (None, rows[1][1], 1), (1, rows[1][1], 1)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, node string")
    good = lambda v: v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    n = len(rows)
    links = [
        (i, j)
        for i in range(n)
        for j in range(i)
        if rows[i][2] == rows[j][2] is not None and good(rows[i][1]) and good(rows[j][1]) and len(rows[i][1]) == len(rows[j][1])
        and np.dot(rows[i][1], rows[j][1]) / np.sqrt(np.dot(rows[i][1], rows[i][1])) / np.sqrt(np.dot(rows[j][1], rows[j][1])) >= 0.93
    ]
    count, of = Counter(x for p in links for x in p), brute.groups(range(n), links)
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            least[of[i]] = min(rows[i][0], least.get(of[i], rows[i][0]))
    want = Counter((r[0], count[i], least.get(of[i]), r[0] is not None and r[0] == least.get(of[i])) for i, r in enumerate(rows))
    assert Counter(map(tuple, vectors.near_vectors(frame).collect())) == want
    assert vectors.near_vectors(frame.where("false")).count() == 0


def test_vectors_equal_their_sql(spark):
    duckdb, queries = pytest.importorskip("duckdb"), pytest.importorskip("cityflow.llm.queries")
    rng = np.random.default_rng(9)
    rows = [(i, (rng.normal(size=6) * 0.25 + (i % 2)).tolist(), i % 3 if i % 10 else None) for i in range(90)]
    rows += [(100, [0.0] * 6, 1), (101, [float("nan")] * 6, 1), (102, None, 1), (103, [float("inf")] * 6, 1)]
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INTEGER)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", rows)
    want = Counter(con.execute(queries.ORACLES["op6_vectors"]).fetchall())
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert Counter(map(tuple, vectors.near_vectors(frame).collect())) == want and any(r[1] > 3 for r in want)


def test_vector_tiles_lose_nothing(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=8) * 0.2 + (i % 3)).tolist(), 0) for i in range(200)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = Counter(map(tuple, vectors.near_vectors(frame).collect()))
    monkeypatch.setattr(vectors, "TILE", 16)
    assert Counter(map(tuple, vectors.near_vectors(frame).collect())) == want


def test_vectors_of_any_size_link(spark):
    size = (1.0, 1e200, 1e-200, 1e308, 5e-324)
    rows = [(2 * i + j, v, i) for i, s in enumerate(size) for j, v in enumerate(([s, s], [min(1.1 * s, 1.7e308), s]))]
    rows += [(20, [1e200, 1e200], 9), (21, [1e-200, 1.05e-200], 9), (22, [1e200, -1e200], 9)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(frame).collect()}
    assert got == {**{i: (1, i - i % 2) for i in range(10)}, 20: (1, 20), 21: (1, 20), 22: (0, 22)}


def test_quantisation_bound_holds():
    rng = np.random.default_rng(5)
    a, b = (vectors.Tile(rng.normal(size=(80, 32)) * 10.0 ** rng.integers(-5, 5, (80, 1))) for _ in range(2))
    exact = (a.full / a.length[:, None]) @ (b.full / b.length[:, None]).T
    near = (a.q.astype(float) @ b.q.T.astype(float)) * a.scale[:, None] * b.scale
    bound = a.error[:, None] * (b.norm + b.error) + a.norm[:, None] * b.error
    assert (np.abs(exact - near) <= bound + 1e-12).all() and bound.max() < 0.1


@pytest.mark.parametrize("most", [1, 2, 3])
def test_banded_edit_distance_and_segments(most):
    rng = random.Random(most)
    pairs = []
    for _ in range(1500):
        a = [rng.choice("ab") for _ in range(rng.randrange(14))]
        b = list(a)
        for _ in range(rng.randrange(5)):
            i = rng.randrange(len(b) + 1)
            b[i : i + rng.randrange(2)] = rng.choice(["", "c", "é", "a"])
        pairs.append(("".join(a), "".join(b)))
    want = [brute.edits(a, b) <= most for a, b in pairs]
    assert lines.within([a for a, _ in pairs], [b for _, b in pairs], most).tolist() == want
    for (a, b), near in zip(pairs, want):
        if near and a != b and min(len(a), len(b)) > most:
            keys = [lines.keys(x, most) for x in (a, b)]
            own = [{k for k, o in x if o} for x in keys]
            assert own[0] & {k for k, _ in keys[1]} or own[1] & {k for k, _ in keys[0]}


def test_lines(spark, rows, empty, monkeypatch):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcd") for _ in range(4))
    stock = [" ".join(word() for _ in range(6)) for _ in range(12)]
    more = []
    for i in range(60):
        text = list("\n".join(rng.choice(stock) for _ in range(3)))
        for _ in range(rng.randrange(4)):
            text[rng.randrange(len(text))] = rng.choice("xyz")
        more.append((1000 + i, "".join(text)))
    every = [(k, t) for k, t, *_ in rows if k != 9] + more
    docs = spark.createDataFrame(every, "doc_id long, text string").withColumn("line", F.lit(1)).withColumn("at", F.lit("q"))
    ordered = sorted(every, key=lambda r: (r[0] is not None, r[0]))
    want = {k: g for (k, _), g in zip(ordered, brute.dropped_lines(ordered))}
    for unit, hot in ((256, 64), (4, 2)):
        monkeypatch.setattr(lines, "UNIT", unit)
        monkeypatch.setattr(lines, "HOT", hot)
        got = lines.drop_repeats(docs).collect()
        assert {r.doc_id: r.gone for r in got} == want and len(got) == len(every)
    assert lines.hot_keys(docs.select("text"), 2, 20)
    texts = dict(every)
    for r in got:
        kept = None if texts[r.doc_id] is None else "\n".join(x for i, x in enumerate(texts[r.doc_id].split("\n")) if i not in r.gone)
        assert (r.text, r.line, r.at) == (kept, 1, "q")
    assert lines.drop_repeats(empty).count() == 0


def test_line_digest_columns(docs):
    got = lines.line_digests(docs)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "dropped", "kept_sha256"]
    assert got.count() == docs.count()


def test_short_lines(spark):
    rng = random.Random(12)
    texts = ["Ietzte.\nJa.\nk\n\n \t", "Ja.\nNee\nk\n\n \t", "Ietzte.\nIetzta.\nSeite 12\nSeite 13"]
    texts += ["Stteen Erachtz.", "Stteen Erachtz", "Stteen Erach.", "x" * 19, "x" * 20, "x" * 21, "x" * 22, "y" * 9, "y" * 10, "y" * 11]
    for _ in range(60):
        line = [rng.choice("ab") for _ in range(rng.randrange(7, 24))]
        texts.append("".join(line))
        line[rng.randrange(len(line))] = rng.choice(["", "c", "ab"])
        texts.append("".join(line) + "\n" + "q" * rng.randrange(4))
    every = list(enumerate(texts))
    split = sorted({x for t in texts for x in t.split("\n") if x.strip()})
    most = lambda a, b: min(2, min(len(a), len(b)) // 10)
    near = [(a, b) for i, a in enumerate(split) for b in split[:i] if abs(len(a) - len(b)) <= 2 and brute.edits(a, b) <= most(a, b)]
    assert {most(a, b) for a, b in near} == {1, 2}
    of, seen, want = brute.groups(split, near), set(), {}
    for k, t in every:
        want[k] = []
        for i, x in enumerate(t.split("\n")):
            if x in of:
                want[k] += [i] * (of[x] in seen)
                seen.add(of[x])
    assert want[0] == [] and want[1] == [0, 2] and want[2] == [0] and want[4] == [0] and want[5] == []
    docs = spark.createDataFrame(every, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.gone for r in lines.drop_repeats(docs, short=True).collect()} == want
    got = {r.doc_id: r.dropped for r in lines.line_digests(docs).collect()}
    assert got == {k: ",".join(map(str, g)) for k, g in want.items()}


def test_lines_of_equal_short_ids_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(lines, "line_id", lambda line: 5)  # as if all ids met
    texts = ["one line that is long enough for all edits", "quite another line with nothing in common"]
    docs = spark.createDataFrame(list(enumerate(texts + texts[:1])), "doc_id long, text string")
    places = docs.selectExpr("doc_id", "1L as mark", "text").toArrow().to_batches()
    keys = [k for b in lines._places(iter(places), 20, True) for k in b.column("line").to_pylist()]
    assert keys[0] == keys[2] != keys[1] and len(keys[0]) == 16
