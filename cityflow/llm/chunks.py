"""A table of distinct chunks inside a Python worker: each chunk is segmented once, ids are joined back by position."""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from cityflow.llm.rolling import Rolling

#: Chunks a worker remembers, about 50 bytes each; beyond it the table starts anew. Bounds memory, not results.
CHUNKS = 1_200_000
#: Characters of text segmented at once.
STRIDE = 2_000_000

Ids = tuple[np.ndarray, np.ndarray]  # how many ids each chunk has; all ids


def flat_ids(found: Sequence[Sequence[int]]) -> Ids:
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    return lengths, np.fromiter((i for x in found for i in x), np.int32, int(lengths.sum()))


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Runs of values, one behind the other."""
    ends = np.cumsum(lengths, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts - ends + lengths, lengths) + np.arange(total)]


class ChunkTable:
    """Ids of the chunks seen so far in flat arrays, ordered by half of a 128-bit digest of the chunk."""

    def __init__(self, segment: Callable[[list[str]], Ids] | None = None, limit: int = CHUNKS):
        self.segment, self.limit = segment, limit
        self.clear()

    def clear(self) -> None:
        self.low, self.high = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.starts, self.lengths, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)

    @staticmethod
    def digests(chunks: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Two independent 64-bit hashes of each chunk, taken from Arrow's buffers at once."""
        _, offsets, data = chunks.buffers()
        edges = np.frombuffer(offsets, np.int32)[chunks.offset : chunks.offset + len(chunks) + 1].astype(np.int64)
        data = np.frombuffer(data or b"", np.uint8)[edges[0] : edges[-1]]
        begin, end = edges[:-1] - edges[0], edges[1:] - edges[0]
        size = (end - begin).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return tuple(Rolling(data, which).of(begin, end) + size for which in (2, 3))

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Places of digests in the table, -1 for unknown ones."""
        if not len(self.low):
            return np.full(len(low), -1)
        order = np.argsort(low)  # neighbouring look-ups stay in the cache
        at = np.empty(len(low), np.int64)
        at[order] = np.minimum(np.searchsorted(self.low, low[order]), len(self.low) - 1)
        return np.where((self.low[at] == low) & (self.high[at] == high), at, -1)

    def add(self, low: np.ndarray, high: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        starts = len(self.ids) + np.cumsum(lengths) - lengths
        self.ids = np.concatenate([self.ids, ids])
        order = np.argsort(low)
        at = np.searchsorted(self.low, low[order])
        for name, new in (("low", low), ("high", high), ("starts", starts), ("lengths", lengths)):
            setattr(self, name, np.insert(getattr(self, name), at, new[order]))

    def look_up(self, chunks: pa.StringArray, segment: Callable[[list[str]], Ids] | None = None) -> Ids:
        """Ids of distinct chunks; unknown ones are segmented together and remembered."""
        if not len(chunks):
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        low, high = self.digests(chunks)
        place = self.find(low, high)
        new = np.flatnonzero(place < 0)
        if not len(new):
            return self.lengths[place], gather(self.ids, self.starts[place], self.lengths[place])
        got_lengths, got = (segment or self.segment)(chunks.take(pa.array(new)).to_pylist())
        known = np.flatnonzero(place >= 0)
        lengths, starts = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
        lengths[known], starts[known] = self.lengths[place[known]], self.starts[place[known]]
        lengths[new], starts[new] = got_lengths, len(self.ids) + np.cumsum(got_lengths) - got_lengths
        out = gather(np.concatenate([self.ids, got]), starts, lengths)
        if len(self.low) + len(new) > self.limit:
            self.clear()
        self.add(low[new], high[new], got_lengths, got)
        return lengths, out

    def encode(self, split: pa.ListArray) -> list[np.ndarray]:
        """The ids of each text, given the chunks of each text: the distinct chunks are looked up, and their
        ids are put at every position of theirs."""
        offsets = split.offsets.to_numpy().astype(np.int64)
        found = split.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        if not len(found):
            return [np.zeros(0, np.int32)] * len(split)
        lengths, ids = self.look_up(found.dictionary)
        at = found.indices.to_numpy()
        size = lengths[at]
        flat = gather(ids, (np.cumsum(lengths) - lengths)[at], size)
        ends = np.append(0, np.cumsum(size))[offsets - offsets[0]]
        del found, at
        pa.default_memory_pool().release_unused()  # two workers share an executor with the JVM
        return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]


def strides(texts: list[str | None], size: int = STRIDE) -> Iterator[slice]:
    """Slices of consecutive texts of about so many characters; a longer text stands alone."""
    begin = held = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > begin and held + n > size:
            yield slice(begin, i)
            begin, held = i, 0
        held += n
    if begin < len(texts):
        yield slice(begin, len(texts))


# A word of Latin-1 letters with full stops and commas behind it: two pre-tokens at most. Lowered, no
# step of a normaliser changes its letters any more.
PLAIN = "^[A-Za-zÀ-ÖØ-öø-ÿ]+[.,]*$"
JOINED = 512


class WordTable(ChunkTable):
    """Ids of the tokenizers library for a vocabulary with word ends that drops white space, so that words are
    independent of each other. Plain words are lowered and parted from stops behind them first, and encoded many
    at a time: a word's ids end with the one that carries the end mark. All others are encoded one by one."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.is_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.is_end[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _each(self, words: list[str]) -> Ids:
        return flat_ids(self._ids(words))

    def _stems(self, stems: list[str]) -> Ids:
        found = self._ids([" ".join(stems[i : i + JOINED]) for i in range(0, len(stems), JOINED)])
        ids = np.concatenate([np.array(x, np.int32) for x in found])
        ends = np.flatnonzero(self.is_end[ids]) + 1
        return (np.diff(ends, prepend=0), ids) if len(ends) == len(stems) else self._each(stems)

    def look_up(self, chunks: pa.StringArray) -> Ids:
        plain = pc.match_substring_regex(chunks, PLAIN)
        words = chunks.filter(plain)
        stems = pc.utf8_lower(pc.utf8_rtrim(words, characters=".,")).dictionary_encode()
        tails = pc.replace_substring_regex(words, "^[^.,]+", "").dictionary_encode()
        found = [super().look_up(stems.dictionary, self._stems)]
        found += [super(WordTable, self).look_up(x, self._each) for x in (tails.dictionary, chunks.filter(pc.invert(plain)))]
        lengths, ids = (np.concatenate([f[i] for f in found]) for i in (0, 1))
        # each chunk is a stem and a tail, or itself and nothing (a last, empty run of ids)
        first, n = np.arange(len(chunks)), len(stems.dictionary)
        plain = plain.to_numpy(zero_copy_only=False)
        second = np.full(len(chunks), len(lengths))
        first[plain], second[plain] = stems.indices.to_numpy(), tails.indices.to_numpy() + n
        first[~plain] = np.arange((~plain).sum()) + n + len(tails.dictionary)
        lengths, starts = np.append(lengths, 0), np.append(np.cumsum(lengths) - lengths, 0)
        parts = np.stack([first, second], 1)
        return lengths[parts].sum(1), gather(ids, starts[parts].reshape(-1), lengths[parts].reshape(-1))

    def texts(self, texts: list[str] | pa.StringArray) -> list[np.ndarray]:
        return self.encode(pc.ascii_split_whitespace(pa.array(texts, pa.string())))


# A run of spaces and what follows it; at the end of a text a run may stand alone.
MARKED = re.compile(" *[^ ]+| +")


class PieceTable(ChunkTable):
    """Ids of the sentencepiece library for marked words: leading spaces with the word after them.

    The library puts one space before a text, so a chunk is kept without its first space. A lone
    space at the end of a text is then an empty chunk, whose id is that of the mark.
    """

    def __init__(self, path: str):
        self.processor = piece_processor(path)
        self.mark = self.processor.piece_to_id("▁")
        super().__init__(self._segment)

    def _segment(self, chunks: list[str]) -> Ids:
        found = self.processor.encode(chunks, num_threads=1)
        return flat_ids([ids if c else [self.mark] for c, ids in zip(chunks, found)])

    def texts(self, texts: list[str]) -> list[np.ndarray]:
        marked = [t.replace("▁", " ") for t in texts]  # the library's own sign for a space
        even = [bool(t) and "  " not in t and t[0] != " " and t[-1] != " " for t in marked]
        regular = iter(self.encode(pc.split_pattern(pa.array([t for t, e in zip(marked, even) if e], pa.string()), " ")))
        odd = [[c[1:] for c in MARKED.findall(" " + t)] if t else [] for t, e in zip(marked, even) if not e]
        irregular = iter(self.encode(pa.array(odd, pa.list_(pa.string()))))
        return [next(regular if e else irregular) for e in even]


@functools.cache
def word_table(path: str) -> WordTable:
    return WordTable(path)


@functools.cache
def piece_processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@functools.cache
def piece_table(path: str) -> PieceTable:
    return PieceTable(path)
