"""Operators 1, 2 and 8."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from cityflow.llm import binids, chunks, packing, pieces, simple8b
from cityflow.session import scratch


@pytest.fixture(scope="module")
def ids_of(words_path):
    tokenizer = Tokenizer.from_file(words_path)
    return lambda t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]


def test_pieces_equal_the_library(docs, rows, empty, pieces_path):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
    got = Counter((r.doc_id, tuple(r.ids), r.decoded) for r in pieces.encode_pieces(docs, pieces_path).collect())
    want = Counter()
    for key, text, *_ in rows:
        ids = library.encode(text or "") + [2]
        want[key, tuple(ids), library.decode(ids)] += 1
    assert got == want
    for r in pieces.piece_digests(docs, pieces_path).where("doc_id = 0").collect():
        ids = library.encode(rows[0][1]) + [2]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert pieces.piece_digests(empty, pieces_path).count() == 0


@pytest.mark.parametrize("kind", ["words", "pieces"])
def test_chunks_equal_the_library_on_random_texts(kind, words_path, pieces_path):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abS  \n\t'.,é日😀<|>/0▁́\x85ΣİA　") for _ in range(rng.randrange(25))) for _ in range(2000)]
    texts += ["a.b. c,. d,. É, é. Ünd.. x.,y ß. K, Å. 'a. a', a.'", "don't we'Re", "<|endoftext|>a", "x" * 5000]
    if kind == "words":
        got = chunks.word_table(words_path).texts(texts)
        want = [e.ids for e in Tokenizer.from_file(words_path).encode_batch(texts, add_special_tokens=False)]
    else:
        got = chunks.piece_table(pieces_path).texts(texts)
        want = sentencepiece.SentencePieceProcessor(model_file=pieces_path).encode(texts)
    assert [x.tolist() for x in got] == want


def test_a_full_table_starts_anew(words_path):
    table = chunks.WordTable(words_path)
    table.limit = 50
    texts = [f"word{i} other{i % 7}, Word{i}." for i in range(300)]
    got = [table.texts([t])[0].tolist() for t in texts]
    assert got == [e.ids for e in Tokenizer.from_file(words_path).encode_batch(texts, add_special_tokens=False)]
    assert len(table.low) <= 50 + 3


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 5000])
def test_simple8b_round_trip(n):
    rng = np.random.default_rng(n)
    cases = [
        rng.integers(0, 49409, n), np.zeros(n), np.full(n, 2**64 - 1, np.uint64), np.full(n, 2**60 - 1, np.uint64),
        rng.integers(0, 2**63, n).astype(np.uint64) >> rng.integers(0, 64, n).astype(np.uint64), (rng.random(n) < 0.02) * 7,
    ]
    for case in cases:
        values = case.astype(np.uint64)
        words, offsets, escaped = simple8b.encode(values)
        assert (simple8b.decode(words, offsets, escaped, n) == values).all()
        assert len(offsets) == -(-n // simple8b.BLOCK)


def test_token_files(spark, docs, rows, empty, words_path, ids_of):
    got = binids.token_file_rows(docs, words_path).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda k: (k is not None, k))
    at = 0
    want = Counter((k, len(ids_of(t)), zlib.crc32(np.array(ids_of(t), "<u4"))) for k, t, *_ in rows)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert binids.token_file_rows(empty, words_path).count() == 0
    path = scratch(spark, "test-files")
    binids.write_token_files(docs, path, words_path)
    whole = Counter((r.doc_id, tuple(r.value)) for r in binids.read_token_files(spark, path).collect())
    assert whole == Counter((k, tuple(ids_of(t))) for k, t, *_ in rows)


def test_files_of_other_kinds_are_refused():
    with pytest.raises(ValueError, match="not a file"):
        list(binids.unpack_frames(b"\0" * 64))


def test_packing(docs, rows, empty, words_path, ids_of, monkeypatch):
    found = packing.pack(docs, words_path).collect()
    ids = defaultdict(list)
    for k, t, *_ in rows:
        ids[k].append(np.array(ids_of(t), "<u4"))
    pieces_of = Counter()
    for r in found:
        # of rows that share an id, each piece is one of theirs
        assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length]) == r.ids_crc32 for x in ids[r.doc_id])
        pieces_of[r.doc_id] += r.length
    assert pieces_of == {k: sum(map(len, x)) for k, x in ids.items()}
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        ends = [0]
        for offset, length in sorted(parts):
            assert offset == ends[-1] and length > 0
            ends.append(offset + length)
        assert ends[-1] == 4096 or ends[-1].bit_count() == 1
    assert packing.pack(empty, words_path).count() == 0


def test_neighbours_share_a_window():
    # two topics in turn: a seed's window holds its own topic as long as it lasts
    rng = np.random.default_rng(0)
    ids = [rng.integers(1000 * (i % 2), 1000 * (i % 2) + 50, 500).astype("<u4") for i in range(32)]
    packer = packing.Packer(0, np.ones(2000), 500.0)
    packer.shard(list(range(32)), ids)
    packer.finish()
    first = defaultdict(set)
    for key, *_, sequence, _ in packer.rows:
        first[sequence].add(key % 2)
    assert first[0] == {0} and {1} in first.values()


def test_token_files_follow_the_numbers_of_parts(spark):
    names = [f"part-{n:05d}-x.txt" for n in (99999, 100000, 7, 123456)]
    rows = spark.createDataFrame([(n,) for n in names], "file string").orderBy(binids.file_number()).collect()
    assert [r.file for r in rows] == [names[2], names[0], names[1], names[3]]
