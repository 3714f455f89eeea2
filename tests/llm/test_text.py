"""Operators 3, 5, 9 and 10."""

import hashlib
import random
import re
import struct
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import brute
from cityflow.llm import language, personal, suffixes, syncmers


def signed(value):
    return value - 2**64 if value >= 2**63 else value


def chained(values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed)
    return signed(seed)


def fingerprint(text):
    units = [signed(xxhash.xxh64_intdigest(u.encode(), 42)) for u in re.findall(r"[^ \t\n\x0b\f\r]{1,8}", text)]
    if not 0 < len(units) < 5:
        inner = [chained(units[i : i + 2]) for i in range(len(units) - 1)]
        places = [i for i in range(len(units) - 4) if min(inner[i : i + 4]) in (inner[i], inner[i + 3])]
        return sorted({chained(units[i : i + 5]) for i in places})[: syncmers.SKETCH]
    return [chained(units)]


def likeness(a, b):
    both = sorted({*a, *b})[: syncmers.SKETCH]
    return sum(c in a and c in b for c in both) / len(both) if both else 1.0


def test_fingerprints_and_edits(docs, rows, empty):
    got = syncmers.edit_prints(docs).collect()
    hexed = lambda codes: "".join(f"{c % 2**64:016x}" for c in codes)
    key = lambda t: (xxhash.xxh64_intdigest(t.encode(), 42) + 2**63) % 2**64
    ordered = sorted(((k, t or "") for k, t, *_ in rows), key=lambda r: (-(2**63) if r[0] is None else r[0], key(r[1])), reverse=True)
    want = []
    for (k, t), (_, following) in zip(ordered, ordered[1:] + ordered[:1]):
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        own, again, other = fingerprint(t), fingerprint(edited), fingerprint(following)
        want.append((k, len(t), hashlib.sha256(edited.encode()).hexdigest(), hexed(own), hexed(again), likeness(own, again), likeness(own, other)))
    assert Counter(map(tuple, got)) == Counter(want)
    assert syncmers.edit_prints(empty).count() == 0


def test_one_document_follows_itself(spark):
    one = spark.createDataFrame([(4, "a b c d e f g h")], "doc_id long, text string")
    (r,) = syncmers.edit_prints(one).collect()
    assert r.edited_sha256 == hashlib.sha256(b"a b c d a b c d").hexdigest()
    assert r.near_next == 1.0


def test_buckets_change_nothing(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(10**6), " ".join(rng.choice("abcdef") * 3 for _ in range(rng.randrange(30)))) for _ in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, r.text): r.next_text for r in syncmers.with_next(frame).collect()}
    ordered = sorted(set(rows), reverse=True)
    if len({k for k, _ in rows}) == len(rows):
        assert all(found[a] == b[1] for a, b in zip(ordered, ordered[1:] + ordered[:1]))


def test_anchors_are_context_free(spark):
    passage = " ".join(f"w{i * 7919 % 1000}" for i in range(60))
    frame = spark.createDataFrame([(1, "x y z " + passage), (2, passage + " q r s t u")], "doc_id long, text string")
    found = syncmers.document_anchors(frame).collect()
    at = {d: {r.code: r.place for r in found if r.doc_id == d} for d in (1, 2)}
    shared = at[1].keys() & at[2].keys()
    assert len(shared) >= 20 and {at[1][c] - at[2][c] for c in shared} == {3}


def test_factors_equal_a_scan():
    rng = random.Random(2)
    for n, letters, depth in ((250, 2, 16), (400, 3, 8), (1, 2, 4), (2, 2, 4), (300, 1, 32)):
        text = [rng.randrange(letters) + 1 for _ in range(n)]

        def shared(i, j, text=text, n=n):
            k = 0
            while max(i, j) + k < n and text[i + k] == text[j + k]:
                k += 1
            return k

        previous, following = suffixes.factors(np.array(text, np.uint16), depth)
        for i in range(n):
            assert min(previous[i], depth) == min(max((shared(i, j) for j in range(i)), default=0), depth)
            assert min(following[i], depth) == min(max((shared(i, j) for j in range(i + 1, n)), default=0), depth)


def test_only_suffixes_still_alike_are_sorted_again(monkeypatch):
    text = np.random.default_rng(3).integers(1, 250, 20_000).astype(np.uint16)
    text[15_000:15_600] = text[2_000:2_600]
    sizes, argsort = [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda key: sizes.append(len(key)) or argsort(key))
    previous, following = suffixes.factors(text, 400)
    assert len(sizes) > 2 and sum(sizes) < 35_000
    assert (np.flatnonzero(previous >= 400) == np.arange(15_000, 15_201)).all()
    assert (np.flatnonzero(following >= 400) == np.arange(2_000, 2_201)).all()
    assert previous[15_300] == following[2_300] == 300


@pytest.mark.parametrize("surroundings", [1500, 2])
def test_repeats(spark, rows, empty, monkeypatch, surroundings):
    monkeypatch.setattr(suffixes, "SURROUNDINGS", surroundings)
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(5))
    passage = " ".join(word() for _ in range(100))
    shared = " ".join(word() for _ in range(50))  # over an anchor, below a window
    texts = [r[1] for r in rows]
    texts += [word() + passage[i : i + 420 + i] + word() for i in range(0, 60, 7)]
    texts += [" ".join(word() for _ in range(30)) + shared + " ".join(word() for _ in range(30)) for _ in range(12)]
    texts += [passage + passage, "a" * 399, "a" * 400, "é" * 200, "ab" * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("anchor", F.lit(1)).repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.remove_repeats(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute.repeated(texts, 400)
    assert sum(g[1] for g in got.values()) > 5000
    if surroundings > 2:
        assert suffixes.remove_repeats(empty).count() == 0


def test_repeat_digests_carry_the_text_that_is_left(spark):
    passage = "é" + "".join(random.Random(2).choice("abcdé ") for _ in range(420))
    texts = ["a" + passage + "Ü", "x" + passage[1:] + "y", "clean ünd short", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id: (bytes(r.kept), r.n_removed) for r in suffixes.remove_repeats(docs).collect()}
    for r in suffixes.repeat_digests(docs).collect():
        left, removed = kept[r.doc_id]
        assert r.kept_sha256 == hashlib.sha256(left).hexdigest() and r.text == left.decode(errors="replace")
        assert (r.text == (texts[r.doc_id] or "")) == (removed == 0)
    assert kept[0][1] > 400 and kept[2][1] == kept[3][1] == 0


def test_repeat_digests_say_which_texts_hold_repeats(spark):
    rng = random.Random(4)
    words = lambda n: " ".join("".join(rng.choice("abcdeé") for _ in range(9)) for _ in range(n))
    long, short = words(60), "in to a be or of " * 9  # 60 and 54 words; the second is under 400 bytes
    texts = [words(30) + long + words(9), words(5) + long, words(40), words(20) + short, words(25) + short, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in suffixes.repeat_digests(docs).collect()}
    assert [got[i].repeated for i in range(6)] == [True, True, False, False, False, False]
    assert all(r.repeated == (r.n_removed > 0) for r in got.values())
    assert [got[i].n_bytes for i in range(6)] == [len((t or "").encode()) for t in texts]


def test_blocks_of_a_long_text(monkeypatch):
    rng = np.random.default_rng(1)
    data = rng.integers(97, 100, 6000).astype(np.uint8)
    room = np.arange(6000) + 400 <= 6000
    whole = suffixes._anchored(data, room, 400)
    assert (whole[4].sum(), whole[2][0]) == (5601, 0)
    assert (whole[2][1:] == (whole[2] + whole[4])[:-1]).all()


HARD = [
    "x@y.com_foo@z.org a@b a@b.c.d@e.f ..@-.-. %+-@a.b", "1.2.3.4.5 256.1.1.1 0000255.1.1.1 1.2.3 01.02.03.04 9.9.9.999",
    "4111111111111111 4111-1111-1111-1111 4111  1111 1111 1111 41111111111111111111111 0000 0000 0000", "1-2-3-4-5-6-7-8-9-0-1-2-3",
    "+1 (212) 555-0101 4111111111111111 +12345678 +123456789 +1234567890123456 ++49 30 123456) +1..2..3", "", "+", "@", "é+49 30 1234567é",
    "a" * 3000, "1" * 3000, "1 " * 2000, "a@" * 1000, "+1(" * 500, "日本 4111111111111111 😀 a@b.c 😀 10.0.0.1",
]


def test_base_spans(spark, docs, rows, empty):
    for texts in ([r[1] for r in rows], HARD):
        frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, base string")
        for r in personal.span_digests(frame).collect():
            want = brute.personal(texts[r.doc_id])
            assert r.base_sha256 == hashlib.sha256(brute.listed(want).encode()).hexdigest(), texts[r.doc_id][:100]
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == i for s in want) for i in range(4)]
            assert {*brute.listed(want).split(",")} <= {*r.spans.split(",")}
    assert personal.span_digests(empty).count() == 0


def test_boosted_trees_add_spans_of_the_same_shape(spark):
    rng = random.Random(3)
    number = lambda n: "".join(rng.choice("123456789") for _ in range(n))
    rows = []
    for i in range(400):
        rows.append((i, f"please call +1 ({number(3)}) 555-{number(4)} today" if i % 2 else f"order {number(9)} of {number(7)} parts"))
    rows.append((1000, "please call 1 (212) 555-0199 today"))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: [(s.start, s.kind, s.end) for s in r.spans] for r in personal.find(frame).collect()}
    assert found[1000] == [(12, 3, 28)]
    assert all(found[i] == [] for i in range(0, 400, 2))


def test_rewritten_data_is_found(spark):
    """Common rewritten forms beside base matches and look-alikes; recall and precision of what is added."""
    rng = random.Random(4)
    digits = lambda n: "".join(rng.choice("23456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 8)))

    def card(sep):
        body = "4" + digits(14)
        total = sum(int(d) if i % 2 else (2 * int(d) - 9 * (int(d) > 4)) for i, d in enumerate(body))
        number = body + str(-total % 10)
        return sep.join(number[i : i + 4] for i in range(0, 16, 4))

    base = (
        lambda: f"write to {word()}@{word()}.org now",
        lambda: f"pay by card {card(' ')} today",
        lambda: f"please call +1 ({digits(3)}) 555-{digits(4)} now",
        lambda: f"the host 10.{rng.randrange(256)}.3.{rng.randrange(256)} is up",
    )
    wrong = (
        lambda: f"order {digits(9)} of {digits(7)} parts",
        lambda: f"pay by card {(c := card('.'))[:-1]}{(int(c[-1]) + 1) % 10} no",
        lambda: f"version {digits(3)}.{digits(3)}.{digits(3)}.{digits(3)} of it",
        lambda: f"the clock 12:34:56:78:{rng.randrange(10, 99)} was",
    )
    hidden = (
        lambda: ("email", f"{word()} at {word()} dot org", "write to {} now"),
        lambda: ("email", f"{word()} (at) {word()} (dot) com", "mail {} now"),
        lambda: ("card", card("."), "pay by card {} today"),
        lambda: ("phone", f"1 ({digits(3)}) 555-{digits(4)}", "please call {} now"),
        lambda: ("ip", ":".join(f"{rng.randrange(4096, 65536):x}" for _ in range(8)), "the host {} is up"),
    )
    texts, planted = [], []
    for i in range(600):
        texts.append(base[i % 4]())
        texts.append(wrong[i % 4]())
        if i % 4 == 0:
            kind, value, around = hidden[i // 4 % 5]()
            at = around.index("{")
            planted.append((len(texts), at, personal.KINDS.index(kind), at + len(value)))
            texts.append(around.format(value))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = personal.find(frame).collect()
    added = {(r.doc_id, *s) for r in rows for s in r.spans if s not in r.base}
    right = added & set(planted)
    assert len(right) >= 0.9 * len(planted) and len(right) >= 0.95 * len(added), (len(right), len(planted), len(added), [(texts[i], k) for i, a, k, b in sorted(added - set(planted))][:6])
    assert all(len(r.base) == (r.doc_id in {i for i, t in enumerate(texts) if brute.personal(t)}) for r in rows)


def test_many_spans_of_a_text_take_no_square(spark):
    text = "1.2.3.4 " * 20_000 + "call 212 555 0199"
    frame = spark.createDataFrame([(1, text), (2, "call +1 212 555 0199")], "doc_id long, text string")
    started = time.monotonic()
    rows = {r.doc_id: r for r in personal.find(frame).collect()}
    assert len(rows[1].base) == 20_000 and time.monotonic() - started < 120


def test_redaction(spark, empty):
    texts = ["mail a@b.org now", None, "", "10.1.2.3 and 10.1.2.3", "no data", "😀 a@b.org"]
    frame = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, spans int")
    got = {r.doc_id: (r.text, r.spans) for r in personal.redact(frame).collect()}
    want = ["mail [EMAIL] now", None, "", "[IP] and [IP]", "no data", "😀 [EMAIL]"]
    assert got == {i: (t, i) for i, t in enumerate(want)}
    assert personal.redact(empty).count() == 0


def profile(texts, ranks):
    count = Counter()
    for t in texts:
        for w in re.findall(r"[^\W\d_]+", t.lower()):
            points = [32, *map(ord, w), 32]
            count.update(points[1:-1])
            for n in (2, 3):
                count.update(sum(p << 21 * (n - 1 - k) for k, p in enumerate(points[i : i + n])) for i in range(len(points) - n + 1))
    return [g for g, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))[:ranks]]


def test_profiles_and_distances(docs, rows, empty):
    ranks = 50
    held = lambda k: k is None or zlib.crc32(str(k).encode()) % 5 == 0
    known = {
        lang: profile([r[1] for r in rows if r[2] == lang and r[1] is not None and not held(r[0])], ranks) for lang in ("en", "fr")
    }
    assert language.learn(docs, ranks) == known
    want = Counter()
    for k, t, *_ in rows:
        own = profile([t or ""], ranks)
        far = {
            lang: sum(abs(p.index(g) - i) if g in p else ranks for i, g in enumerate(own)) / (ranks * len(own))
            for lang, p in known.items() if own
        }
        best = min(sorted(far), key=far.get) if far else "und"
        want[k, held(k), best, round(1 - far[best], 9) if far else 0.0] += 1
    got = language.predictions(docs, ranks).collect()
    assert Counter((r.doc_id, r.held_out, r.lang_pred, round(r.score, 9)) for r in got) == want
    assert language.predictions(empty).count() == 0


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = language.predictions(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.97


def test_unknown_languages_go(spark, docs, empty):
    known = language.learn(docs)
    kept = language.keep_known(docs, known, 0.15)
    assert kept.columns == docs.columns
    gone = {r.text for r in docs.select("text").subtract(kept.select("text")).collect()}
    assert {None, "", "   ", "\n\n", "日本語 テスト 😀 é é"} <= gone
    assert language.keep_known(empty, known, 0.15).count() == 0
