"""Operator 10: language identification by rank-order profiles of letter n-grams."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cityflow.llm.chunks import ChunkTable, Ids, flat_ids, strides
from cityflow.llm.common import ship, texts

#: Ranks of a profile.
RANKS = 400
FOLDS = 5
UNKNOWN = "und"
#: Quantile of the scores of held-out documents and the share of it that a text must reach, and the least bar of all.
LOW, SHARE, FLOOR = 0.01, 0.65, 0.15
#: Words whose n-grams a worker remembers.
WORDS = 300_000
LETTERS = re.compile(r"[^\W\d_]+")
_STEP = 1 << 21  # above every code point


class Grams:
    """Codes of the 1- to 3-grams of words, kept per worker. A code is up to three code points, 21 bits
    each, behind a word mark where the gram begins or ends a word; it fits a signed long."""

    def __init__(self):
        self.code_of: list[int] = []
        self.id_of: dict[int, int] = {}
        self.table = ChunkTable(self._segment, WORDS)

    def _segment(self, words: list[str]) -> Ids:
        out = []
        for word in words:
            points = [32, *map(ord, word), 32]
            codes = points[1:-1]
            codes += [a * _STEP + b for a, b in zip(points, points[1:])]
            codes += [(a * _STEP + b) * _STEP + c for a, b, c in zip(points, points[1:], points[2:])]
            ids = []
            for code in codes:
                if code not in self.id_of:
                    self.id_of[code] = len(self.code_of)
                    self.code_of.append(code)
                ids.append(self.id_of[code])
            out.append(ids)
        return flat_ids(out)

    def counts(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, counts) of each text's n-grams."""
        words = pa.array([LETTERS.findall(t.lower()) for t in texts], pa.list_(pa.string()))
        for ids in self.table.encode(words):
            count = np.bincount(ids, minlength=1)
            some = np.flatnonzero(count)
            yield some, count[some]


@functools.cache
def grams() -> Grams:
    return Grams()


def _corpus_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one task: n-gram counts by language."""
    own, total = grams(), {}
    for batch in batches:
        labels, words = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for part in strides(words):
            for label, (ids, count) in zip(labels[part], own.counts(words[part])):
                held = total.setdefault(label, np.zeros(0, np.int64))
                if len(ids) and ids[-1] >= len(held):
                    held = total[label] = np.concatenate([held, np.zeros(len(own.code_of) - len(held), np.int64)])
                held[ids] += count
    for label, held in total.items():
        some = np.flatnonzero(held)
        codes = np.array(own.code_of, np.int64)[some]
        columns = [pa.array([label] * len(some), pa.string()), pa.array(codes), pa.array(held[some])]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "gram", "n"])


def profiles(labelled: DataFrame, ranks: int = RANKS) -> dict[str, list[int]]:
    """The most frequent n-grams of each language, best first, over all rows of (lang, text).

    Counts are summed in each task before they are shuffled; ties are ordered by code. The result
    has ``ranks`` numbers for each language.
    """
    rows = labelled.where("lang is not null and text is not null").select("lang", "text")
    counts = rows.mapInArrow(_corpus_counts, "lang string, gram long, n long")
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    best = counts.withColumn("place", place).where(F.col("place") <= ranks).orderBy("lang", "place")
    found: dict[str, list[int]] = {}
    for r in best.collect():
        found.setdefault(r.lang, []).append(r.gram)
    return found


def _predict(
    batches: Iterator[pa.RecordBatch],
    known: dict[str, list[int]],
    ranks: int,
    kept: int,
    added: Sequence[str] = ("lang_pred", "score"),
) -> Iterator[pa.RecordBatch]:
    """The first ``kept`` columns with the prediction for the text in the last one."""
    own, langs = grams(), sorted(known)
    ladder = np.zeros((len(langs), 0), np.int64)
    place = [{g: i for i, g in enumerate(known[lang])} for lang in langs]
    for batch in batches:
        words, best, score = [t or "" for t in batch.column(-1).to_pylist()], [], []
        for part in strides(words):
            for ids, count in own.counts(words[part]):
                if not len(ids) or not langs:
                    best.append(UNKNOWN)
                    score.append(0.0)
                    continue
                if ladder.shape[1] < len(own.code_of):
                    new = own.code_of[ladder.shape[1] :]
                    ladder = np.concatenate([ladder, [[p.get(g, ranks) for g in new] for p in place]], 1)
                    codes = np.array(own.code_of, np.int64)
                top = ids[np.lexsort((codes[ids], -count))[:ranks]]
                there = ladder[:, top]
                # an n-gram that a language's profile lacks is as far out of place as can be
                far = np.where(there < ranks, np.abs(there - np.arange(len(top))), ranks).sum(1)
                i = int(far.argmin())
                best.append(langs[i])
                score.append(1 - far[i] / (ranks * len(top)))
        out = [*batch.columns[:kept], pa.array(best, pa.string()), pa.array(score, pa.float64())]
        yield pa.RecordBatch.from_arrays(out, [*batch.schema.names[:kept], *added])


def identify(docs: DataFrame, known: dict[str, list[int]], ranks: int = RANKS) -> DataFrame:
    """(doc_id, lang_pred, score) of every row: the language whose profile is nearest by out-of-place distance.

    A document's most frequent n-grams are compared with each profile; the score is one minus the
    mean distance by its largest value. ``und`` with score 0 if the text is null or holds no letter,
    or nothing was learned. Equal distances go to the first language in order of names. Broadcast
    with the task: ``ranks`` numbers per language.
    """
    return texts(docs).mapInArrow(
        lambda it: _predict(it, known, ranks, 1), "doc_id long, lang_pred string, score double"
    )


def least_scores(docs: DataFrame, known: dict[str, list[int]], ranks: int = RANKS) -> dict[str, float]:
    """The score that a text must have to be taken as in a language: a share of a low quantile of the scores of all
    held-out documents that are labelled with it and predicted so.

    A language without such documents takes the lowest bar of the others; none is under ``FLOOR``. The
    driver receives counts of scores in thousandths, by language.
    """
    ship(docs.sparkSession)
    rows = docs.where(held_out()).select(F.col("lang").cast("string"), F.col("text").cast("string"))
    rows = rows.where("lang is not null and text is not null")
    found = rows.mapInArrow(lambda it: _predict(it, known, ranks, 1), "lang string, lang_pred string, score double")
    found = found.where("lang = lang_pred and score > 0").groupBy("lang", F.floor(F.col("score") * 1000).alias("at"))
    counts: dict[str, list[tuple[int, int]]] = {}
    for r in found.agg(F.count("*").alias("n")).collect():
        counts.setdefault(r.lang, []).append((r.at, r.n))
    bars = {}
    for lang, held in counts.items():
        at, n = np.array(sorted(held)).T
        low = at[np.searchsorted(np.cumsum(n), LOW * n.sum(), side="right")] / 1000
        bars[lang] = max(FLOOR, float(SHARE * low))
    return {lang: bars.get(lang, min(bars.values(), default=FLOOR)) for lang in known}


def keep_known(docs: DataFrame, known: dict[str, list[int]], least: float | dict[str, float], ranks: int = RANKS) -> DataFrame:
    """The rows, with all their columns, whose language is known with a score of at least ``least``, one number or
    one for each language.

    Texts that are null, hold no letter, or are far from every profile go. No shuffle: whole rows
    pass through the prediction.
    """
    ship(docs.sparkSession)
    # plain names inside: those of the table may be any
    order = [c for c in docs.columns if c != "text"] + ["text"]
    inner = {c: f"c{i}" for i, c in enumerate(order)}
    value = lambda c: F.col(f"`{c}`").cast("string") if c == "text" else F.col(f"`{c}`")
    rows = docs.select(*[value(c).alias(n) for c, n in inner.items()])
    schema = T.StructType([*rows.schema, T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])
    found = rows.mapInArrow(lambda it: _predict(it, known, ranks, len(order), ("lang", "score")), schema)
    bars = least if isinstance(least, dict) else dict.fromkeys(known, least)
    bar = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(x)) for lang, x in bars.items()], F.lit(0.0))
    found = found.where((F.col("lang") != UNKNOWN) & (F.col("score") >= bar))
    return found.select(*[F.col(inner[c]).alias(c) for c in docs.columns])


def held_out(name: str = "doc_id"):
    """Whether a document is kept out of the training rows; one without an id never trains."""
    return F.coalesce(F.pmod(F.crc32(F.col(name).cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(True))


def learn(docs: DataFrame, ranks: int = RANKS) -> dict[str, list[int]]:
    """Profiles from all labelled documents that are not held out."""
    ship(docs.sparkSession)
    rows = docs.where(~held_out()).select(F.col("lang").cast("string"), F.col("text").cast("string"))
    return profiles(rows, ranks)


def predictions(docs: DataFrame, ranks: int = RANKS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learned from the rows that are not held out, predicted for all.

    lang, source and doc_id are no inputs of a prediction. Repeated rows stay, an empty table
    gives no rows, other columns are ignored.
    """
    found = identify(docs, learn(docs, ranks), ranks)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
