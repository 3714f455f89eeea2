"""Operator 11: spelling variants of words, by edits probed against length-sharded blocked Bloom filters."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cityflow.llm.common import discard, settle, texts

#: Letters of a run of a text.
LETTERS = r"[A-Za-zÀ-ÿ]+"
#: Bits of a filter for each word, and 64-bit words of one of its blocks (a cache line), each with one bit of a word.
WORD_BITS, BLOCK = 16, 8
#: Bytes of one filter, and of all filters broadcast at once. More filters take more passes.
PART_BYTES, PASS_BYTES = 4 << 20, 32 << 20
#: Words that a task counts before it hands them on, and edits hashed at once.
COUNTED, PROBES = 200_000, 1 << 21

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
_BACK = np.uint64(pow(_BASE, -1, 2**64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _values(codes: np.ndarray) -> np.ndarray:
    """A random 64-bit value of each code point."""
    return _mixed((codes.astype(np.uint64) + np.uint64(1)) * _ODD)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _matrix(words: list[str]) -> np.ndarray:
    """Code points of words of equal length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)


def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """Each length that occurs and the places of its words."""
    lengths = np.array([len(w) for w in words], np.int64)
    order = np.argsort(lengths, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
        if len(part):
            yield int(lengths[part[0]]), part


def hashes(codes: np.ndarray) -> np.ndarray:
    """The sum of value * base**place of each row, before mixing: one edit changes it by one term."""
    return (_values(codes) * _powers(codes.shape[1])).sum(1, dtype=np.uint64)


def edits(codes: np.ndarray, letters: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(length, hash, row, place, letter) of the deletions and upward replacements of each row, in bounded portions.

    ``letter`` is -1 for a deletion; equal neighbours give one deletion. An insertion is the deletion of another word,
    a downward replacement another word's upward one, so each pair of near words is met from one side.
    """
    n, length = codes.shape
    power, value, total = _powers(length), _values(codes), hashes(codes)
    before = np.zeros((n, length + 1), np.uint64)
    np.cumsum(value * power, axis=1, out=before[:, 1:])
    first = np.ones(codes.shape, bool)
    first[:, 1:] = codes[:, 1:] != codes[:, :-1]
    row, place = np.nonzero(first)
    gone = before[row, place] + (total[row] - before[row, place + 1]) * _BACK
    yield length - 1, gone, row, place, np.full(len(row), -1)
    new = _values(letters)
    step = max(1, PROBES // (len(letters) * n))
    for at in range(0, length, step):
        here = slice(at, min(at + step, length))
        row, place, letter = np.nonzero(letters[None, None, :] > codes[:, here, None])
        place += at
        yield length, total[row] + (new[letter] - value[row, place]) * power[place], row, place, letter


@dataclass
class Shards:
    """Where each filter lies: by length its number of filters and of blocks a filter, and the first block of each
    filter of this pass (-1: in another pass)."""

    parts: dict[int, int]
    blocks: dict[int, int]
    starts: dict[int, np.ndarray]
    size: int

    def places(self, length: int, mixed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The block of each hash, and which hashes have a filter in this pass."""
        again, half = _mixed(mixed ^ _ODD), np.uint64(32)
        part = ((again & np.uint64(0xFFFFFFFF)) * np.uint64(self.parts[length])) >> half
        start = self.starts[length][part.astype(np.int64)]
        return start + (((again >> half) * np.uint64(self.blocks[length])) >> half).astype(np.int64), start >= 0


def _bits(mixed: np.ndarray, word: int) -> np.ndarray:
    return np.uint64(1) << ((mixed >> np.uint64(6 * word)) & np.uint64(63))


def passes(counts: dict[int, int], part_bytes: int = PART_BYTES, pass_bytes: int = PASS_BYTES) -> list[Shards]:
    """The filters of words of each length, dealt to passes of at most ``pass_bytes``."""
    per_block = 64 * BLOCK // WORD_BITS
    parts = {n: max(1, -(-c * WORD_BITS // (8 * part_bytes))) for n, c in counts.items()}
    blocks = {n: max(1, -(-c // (parts[n] * per_block))) for n, c in counts.items()}
    out: list[Shards] = []
    for n in sorted(counts):
        for part in range(parts[n]):
            if not out or out[-1].size and (out[-1].size + blocks[n]) * 8 * BLOCK > pass_bytes:
                out.append(Shards(parts, blocks, {m: np.full(parts[m], -1, np.int64) for m in counts}, 0))
            out[-1].starts[n][part] = out[-1].size
            out[-1].size += blocks[n]
    return out


def _filled(batches: Iterator[pa.RecordBatch], shards: Shards) -> Iterator[pa.RecordBatch]:
    """(block, bits of its words) of the filters of a pass, as far as each batch fills them."""
    for batch in batches:
        words = batch.column(0).to_pylist()
        for length, some in _by_length(words):
            mixed = _mixed(hashes(_matrix([words[i] for i in some])))
            place, here = shards.places(length, mixed)
            found, own = np.unique(place[here], return_inverse=True)
            filled = np.zeros((len(found), BLOCK), np.uint64)
            for word in range(BLOCK):
                np.bitwise_or.at(filled[:, word], own, _bits(mixed[here], word))
            columns = [pa.array(found), *[pa.array(filled[:, word].view(np.int64)) for word in range(BLOCK)]]
            yield pa.RecordBatch.from_arrays(columns, ["block", *[f"w{word}" for word in range(BLOCK)]])


def filters(words: DataFrame, shards: Shards) -> np.ndarray:
    """The blocks of a pass, (blocks, BLOCK) values of 64 bits: as many bytes as the pass may have."""
    names = [f"w{word}" for word in range(BLOCK)]
    rows = words.select("word").mapInArrow(lambda it: _filled(it, shards), ", ".join(f"{c} long" for c in ("block", *names)))
    found = rows.groupBy("block").agg(*[F.bit_or(c).alias(c) for c in names]).toArrow()
    out = np.zeros((shards.size, BLOCK), np.uint64)
    if found.num_rows:
        out[found["block"].to_numpy()] = np.stack([found[c].to_numpy().view(np.uint64) for c in names], 1)
    return out


def _positives(batches: Iterator[pa.RecordBatch], shards: Shards, blocks: np.ndarray, letters: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(word, n, other): edits of words that a filter may hold."""
    for batch in batches:
        words, counts = batch.column(0).to_pylist(), batch.column(1).to_numpy()
        for length, some in _by_length(words):
            step = max(1, PROBES // (length * len(letters)))
            for at in range(0, len(some), step):
                own = some[at : at + step]
                codes = _matrix([words[i] for i in own])
                for size, raw, row, place, letter in edits(codes, letters):
                    if size not in shards.parts or not len(raw):
                        continue
                    mixed = _mixed(raw)
                    block, here = shards.places(size, mixed)
                    left = np.flatnonzero(here)
                    for word in range(BLOCK):
                        left = left[blocks[block[left], word] & _bits(mixed[left], word) != 0]
                    if len(left):
                        mine = own[row[left]]
                        others = [
                            words[i][:p] + (chr(letters[c]) if c >= 0 else "") + words[i][p + 1 :]
                            for i, p, c in zip(mine.tolist(), place[left].tolist(), letter[left].tolist())
                        ]
                        columns = [pa.array([words[i] for i in mine]), pa.array(counts[mine]), pa.array(others, pa.string())]
                        yield pa.RecordBatch.from_arrays(columns, ["word", "n", "other"])


def near_pairs(words: DataFrame, part_bytes: int = PART_BYTES, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(word, n, other, other_n) of all ordered pairs of words of (word, n) exactly one insertion, deletion or
    replacement of a code point apart. Words are distinct, not null and not empty.

    Edits of each word are probed against the filters; only what a filter may hold is joined with the
    words themselves. A word has as many near words as it has edits at most, so no group is unbounded.
    """
    spark = words.sparkSession
    counts = {r.length: r.n for r in words.groupBy(F.char_length("word").alias("length")).agg(F.count("*").alias("n")).collect()}
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).distinct().where("letter <> ''")
    alphabet = np.sort(np.array([ord(r.letter) for r in letters.collect()], np.int64))
    found = None
    for shards in passes(counts, part_bytes, pass_bytes):
        shipped = spark.sparkContext.broadcast(filters(words, shards))
        probe = lambda it, s=shards, b=shipped: _positives(it, s, b.value, alphabet)
        some = words.select("word", "n").mapInArrow(probe, "word string, n long, other string")
        found = found.union(some) if found else some
    if found is None:
        return words.select("word", "n", F.col("word").alias("other"), F.col("n").alias("other_n"))
    known = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    pairs = settle(found.join(known, "other").select("word", "n", "other", "other_n"), "variant-pairs")
    return pairs.union(pairs.select("other", "other_n", "word", "n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of rows (word, form), form not null: the last word that following forms leads to.

    Each round joins every word to what the word it has reached has reached, so the steps double. Forms must not
    run in circles.
    """
    reached = settle(forms.select("word", F.col("form").alias("reached")), "variant-forms")
    while True:
        step = reached.select(F.col("word").alias("reached"), F.col("reached").alias("next"))
        moved = reached.select("word", "reached").join(step, "reached", "left")
        end = F.coalesce("next", "reached").alias("reached")
        moved = settle(moved.select("word", end, F.col("next").isNull().alias("there")), "variant-roots")
        discard(reached)
        reached = moved
        if reached.where("not there").isEmpty():
            return reached.select("word", F.col("reached").alias("root"))


def grouped(words: DataFrame, factor: int = 2, part_bytes: int = PART_BYTES, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of (word, n).

    A word's form is its near word (one edit apart) of largest n, ties to the first in code-point order, if that n
    is at least ``factor`` times the word's own (2 or more, so that forms never run in circles); else null, as for
    words without near words (n_near 0). The root follows forms to the last word; a word without form is its own.
    An empty table gives no rows.
    """
    words = settle(words.select("word", F.col("n").cast("long").alias("n")), "variant-words")
    pairs = near_pairs(words, part_bytes, pass_bytes)
    best = F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other").alias("form"))).alias("best")
    near = pairs.groupBy("word").agg(F.count("*").alias("n_near"), best)
    strong = -F.col("best.minus") >= factor * F.col("n")
    rows = words.join(near, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(strong, F.col("best.form")).alias("form"),
        F.when(strong, -F.col("best.minus")).alias("form_n"),
    )
    rows = settle(rows, "variant-near")
    ends = roots(rows.where("form is not null"))
    root = F.coalesce("root", "word").alias("root")
    return rows.join(ends, "word", "left").select("word", "form", root, "n", "n_near", "form_n")


def _misspelt(doc_id: int | None, run: str, base: int, one_in: int) -> str:
    h = zlib.crc32(run.encode(), base)
    if h % one_in:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counted(batches: Iterator[pa.RecordBatch], shortest: int, change: Callable | None) -> Iterator[pa.RecordBatch]:
    """(word, n), summed over as many rows as a task may hold at once."""
    find, held = re.compile(LETTERS).findall, Counter()
    out = lambda: pa.RecordBatch.from_arrays([pa.array(held, pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1)):
            if (text := text.as_py()) is None:
                continue
            runs = Counter(find(text.encode().lower().decode()))  # bytes: A-Z only
            if change:
                runs = change(doc_id.as_py(), runs)
            for word, n in runs.items():
                if len(word) >= max(1, shortest):
                    held[word] += n
            if len(held) > COUNTED:
                yield out()
                held.clear()
    if held:
        yield out()


def _with_slips(one_in: int) -> Callable:
    """A fixed share of the runs, chosen by a checksum of document and run, loses a letter."""

    def change(doc_id: int | None, runs: Counter) -> Counter:
        base, out = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode()), Counter()
        for run, n in runs.items():
            out[_misspelt(doc_id, run, base, one_in)] += n
        return out

    return change


def vocabulary(docs: DataFrame, shortest: int = 5, least: int = 3, slips: int | None = None) -> DataFrame:
    """(word, n): runs of letters of whole texts, A-Z lower-cased, of ``shortest`` code points (at least one) and
    ``least`` occurrences or more. With ``slips`` one distinct run of a document in so many loses a letter first.

    Null and empty texts have none; repeated rows count each; a null doc_id stands for an empty one.
    Words are counted in the tasks before they are shuffled, so a word that is everywhere arrives
    as one row a portion. Other columns are ignored.
    """
    change = _with_slips(slips) if slips else None
    counts = texts(docs).mapInArrow(lambda it: _counted(it, shortest, change), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def variants(docs: DataFrame, shortest: int = 5, least: int = 3, factor: int = 2, slips: int | None = None) -> DataFrame:
    """Words of the documents and the form each is a variant of: ``grouped`` over ``vocabulary``."""
    return grouped(vocabulary(docs, shortest, least, slips), factor)
