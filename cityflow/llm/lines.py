"""Operator 7: near-duplicate lines by an edit-distance join over segment partitions."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cityflow.llm.common import components, settle, texts
from cityflow.llm.simhash import _roots

#: Edits between lines that count as the same, and code points from which a line may have all of them.
EDITS, SHORTEST = 2, 20
#: Lines that share a segment and are verified in one unit, on average.
UNIT = 256
#: Bits of the filter that keeps lines without any candidate out of the shuffle of texts: 8 MB, a fixed size.
FILTER_BITS = 1 << 26
PAIRS = 4096
#: Documents of the sample that finds hot keys, lines of a key that make it hot there, and parts of a hot key.
SAMPLE, HOT, SPREAD = 4096, 64, 512


def line_id(line: str) -> int:
    """Stands for a line among candidates, whose texts are compared before they are linked."""
    return xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")) - 2**63


def line_key(line: str) -> bytes:
    """128 bits by which lines count as equal: wide enough for all lines of a corpus of any size."""
    return xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass"))


def segments(n: int, edits: int) -> list[tuple[int, int]]:
    """(begin, size) of edits + 1 nearly equal segments of a line of n code points; the last ones are the longer."""
    parts = edits + 1
    out, at = [], 0
    for i in range(parts):
        size = n // parts + (i >= parts - n % parts)
        out.append((at, size))
        at += size
    return out


def keys(line: str, edits: int, lengths: range | None = None) -> list[tuple[int, bool]]:
    """(key, own): hashes of the line's own segments, and of its substrings that can equal a segment of a line
    up to ``edits`` shorter or as long.

    If two lines are within the distance, a segment of the shorter one stands unchanged in the longer one, and
    some such segment i is moved by at most i places from the left end, and as few from the right end as
    segments remain: only those places are probed. A key also holds the segment's number and the length. With ``lengths``
    the shorter line has one of these.
    """
    points = line.encode("utf-32-le", "surrogatepass")
    n, digest, out = len(line), xxhash.xxh64_intdigest, []
    for shorter in range(min(edits, n - edits - 1) + 1):
        length = n - shorter
        if lengths is not None and length not in lengths:
            continue
        for i, (begin, size) in enumerate(segments(length, edits)):
            first = max(begin - i, begin + shorter - (edits - i), 0)
            last = min(begin + i, begin + shorter + (edits - i), n - size)
            for at in range(first, last + 1):
                key = digest(points[4 * at : 4 * (at + size)], length * (edits + 1) + i)
                out.append((key - 2**63, shorter == 0 and at == begin))
    return out


def _compared(line: str, shortest: int, short: bool) -> bool:
    """Whether equal lines count as the same: short lines that are not blank do if ``short`` is set."""
    return len(line) >= shortest or (short and not line.isspace() and line != "")


def allowed(n: int, edits: int, shortest: int) -> int:
    """Edits that a pair may have whose shorter line has n code points: below ``shortest`` in proportion."""
    return edits if n >= shortest else n * edits // shortest


def _graded(line: str, edits: int, shortest: int, short: bool) -> list[tuple[int, bool]]:
    """Keys by which the line meets others. Pairs with fewer allowed edits have longer segments and keys of their own:
    a key's number, length * (edits + 1) + segment, lies in another range for each number of edits, since that grows with the length."""
    if not short:
        return keys(line, edits)
    n, out = len(line), []
    for most in range(1, edits + 1):
        from_ = -(-most * shortest // edits)
        lengths = range(from_, n + 1 if most == edits else -(-(most + 1) * shortest // edits))
        if n - most < lengths.stop and n >= from_:
            out += keys(line, most, lengths)
    return out


def _entries(batches: Iterator[pa.RecordBatch], edits: int, shortest: int, short: bool) -> Iterator[pa.RecordBatch]:
    """(key, line, own) of the lines of each batch, equal lines once."""
    for batch in batches:
        lines = {x for t in batch.column(0) for x in (t.as_py() or "").split("\n") if _compared(x, shortest, short)}
        rows: list[tuple] = []
        for line in lines:
            i = line_id(line)
            rows += [(key, i, own) for key, own in _graded(line, edits, shortest, short)]
            if len(rows) > 200_000:
                yield _entry_batch(rows)
                rows = []
        if rows:
            yield _entry_batch(rows)


def _entry_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["key", "line", "own"])


def _filter_bit(i: int) -> int:
    """Spark's own hash of a long, as candidate_texts uses it."""
    return xxhash.xxh64_intdigest(i.to_bytes(8, "little", signed=True), 42) % FILTER_BITS


def _wanted(batches: Iterator[pa.RecordBatch], bits: np.ndarray, shortest: int, short: bool) -> Iterator[pa.RecordBatch]:
    """(line, text) of lines whose bit is set, equal lines of a batch once."""
    for batch in batches:
        found = {}
        for t in batch.column(0):
            for x in (t.as_py() or "").split("\n"):
                if _compared(x, shortest, short):
                    i = line_id(x)
                    h = _filter_bit(i)
                    if bits[h >> 3] >> (h & 7) & 1:
                        found[x] = i
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(found.values(), pa.int64()), pa.array(found, pa.string())], ["line", "text"])


def _codes(lines: list[str], width: int, fill: int) -> np.ndarray:
    out = np.full((len(lines), width), fill, np.uint32)
    for row, line in zip(out, lines):
        row[: len(line)] = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
    return out


def _trimmed(a: str, b: str) -> tuple[str, str]:
    """Two lines without what they share at both ends, the shorter one first; their distance is the same."""
    if len(a) > len(b):
        a, b = b, a
    begin = len(os.path.commonprefix((a, b)))
    a, b = a[begin:], b[begin:]
    end = len(os.path.commonprefix((a[::-1], b[::-1])))
    return a[: len(a) - end], b[: len(b) - end]


def within(a: list[str], b: list[str], edits: int) -> np.ndarray:
    """Whether a[i] and b[i] are at most ``edits`` edits apart, by a bit-parallel edit distance on a band.

    All pairs advance together, a column at a time, over what is left between their common ends. Only
    cells at most ``edits`` off the diagonal are kept, one bit each for a vertical step up or down, so a
    column is a few operations on one word per pair (Myers' recurrences in Hyyro's banded form: the band
    moves down with the column). The score is followed along the band's lower edge and then up the last
    column; a pair leaves as soon as no cell of its band can end within the distance.
    """
    trimmed = [_trimmed(x, y) for x, y in zip(a, b)]
    a, b = [x for x, _ in trimmed], [y for _, y in trimmed]
    m, n = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    result = n <= edits
    rest = np.flatnonzero((n - m <= edits) & ~result)
    if len(rest):
        result[rest] = _banded([a[i] for i in rest], [b[i] for i in rest], m[rest], n[rest], edits)
    return result


def _banded(a: list[str], b: list[str], m: np.ndarray, n: np.ndarray, edits: int) -> np.ndarray:
    band = 2 * edits + 1
    one, top, full = np.uint64(1), np.uint64(1 << (band - 1)), np.uint64((1 << band) - 1)
    width = int(n.max()) + band
    # row r of the text a stands at place r + edits, so that the band of column c begins at place c
    rows = np.full((len(a), width + 2 * edits), 0xFFFFFFFF, np.uint32)
    rows[:, edits : edits + width] = _codes(a, width, 0xFFFFFFFF)
    cols = _codes(b, width, 0xFFFFFFFE)
    # bit i of a column's steps is the row i of the next column's band; in column 0 each step below row 0 adds one
    up, down = np.full(len(a), full & ~np.uint64((1 << edits) - 1)), np.zeros(len(a), np.uint64)
    score = np.full(len(a), edits)  # of the lowest cell of the band
    final = np.full(len(a), edits + 1)
    live = np.arange(len(a))
    for c in range(int(n.max())):
        equal = np.zeros(len(live), np.uint64)
        for i in range(band):
            equal |= (rows[live, c + i] == cols[live, c]).astype(np.uint64) << np.uint64(i)
        vp, vn = up[live], down[live]
        zero = ((((equal & vp) + vp) ^ vp) | equal | vn) & full
        hp, hn = vn | (~(zero | vp) & full), zero & vp
        score[live] += 1 - ((zero & top) > 0)  # along the diagonal of the lowest cell
        shifted = zero >> one
        up[live] = (hn | (~(shifted | hp) & full)) & full
        down[live] = shifted & hp
        ended = live[n[live] == c + 1]
        if len(ended):
            # from the lowest cell (row c + 1 + edits) up to the row m
            value = score[ended].copy()
            climb = c + 1 + edits - m[ended]
            for k in range(band - 1):
                bit = np.uint64(1 << (band - 2 - k))
                step = ((up[ended] & bit) > 0).astype(int) - ((down[ended] & bit) > 0).astype(int)
                value -= np.where(k < climb, step, 0)
            final[ended] = value
        # cells of a column differ by one from row to row, and scores along a diagonal never fall
        live = live[(n[live] > c + 1) & (score[live] - 2 * edits <= edits)]
        if not len(live):
            break
    return final <= edits


def _unit_pairs(rows: list[tuple], edits: int, shortest: int) -> Iterator[tuple[str, str, int, int]]:
    """Pairs (text, text, id, id) of a unit that share its key; at least one of a pair has the segment as its own."""
    seen: set[tuple[int, int]] = set()
    for own, x, i, block, single in rows:
        if not own:
            continue
        for _, y, j, other, _ in rows:
            # a unit of two blocks compares the one with the other, a unit of one with itself
            most = allowed(min(len(x), len(y)), edits, shortest)
            if i != j and (block != other or single) and abs(len(x) - len(y)) <= most and (min(i, j), max(i, j)) not in seen:
                seen.add((min(i, j), max(i, j)))
                yield x, y, i, j


def _verify(batches: Iterator[pa.RecordBatch], edits: int, shortest: int) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by (key, low, high). Pairs of whole units are verified some thousands at a time; of the
    links found together only a spanning forest is returned."""
    held: list[tuple] = []
    pairs: list[tuple[str, str, int, int]] = []
    last = None

    def check() -> pa.RecordBatch:
        most = [allowed(min(len(p[0]), len(p[1])), edits, shortest) for p in pairs]
        kinds = [(e, [p for p, m in zip(pairs, most) if m == e]) for e in set(most)]
        near = [(some, within([p[0] for p in some], [p[1] for p in some], e)) for e, some in kinds]
        number: dict[str, int] = {}
        found = [[number.setdefault(x, len(number)) for x in p[:2]] for some, good in near for p, ok in zip(some, good) if ok]
        place = np.array(found, np.int64).reshape(-1, 2)
        root = _roots(len(number), iter([(place[:, 0], place[:, 1])]))
        linked, texts = np.flatnonzero(root != np.arange(len(number))), list(number)
        sides = [pa.array([line_key(texts[i]) for i in side], pa.binary()) for side in (linked, root[linked])]
        return pa.RecordBatch.from_arrays(sides, ["a", "b"])

    def unit() -> Iterator[pa.RecordBatch]:
        for pair in _unit_pairs(held, edits, shortest):
            pairs.append(pair)
            if len(pairs) == PAIRS:
                yield check()
                pairs.clear()

    for batch in batches:
        for key, low, high, block, own, line, text in zip(*(c.to_pylist() for c in batch.columns)):
            if held and (key, low, high) != last:
                yield from unit()
                held.clear()
            last = (key, low, high)
            held.append((own, text, line, block, low == high))
    if held:
        yield from unit()
    if pairs:
        yield check()


def all_entries(rows: DataFrame, edits: int, shortest: int, short: bool = False) -> DataFrame:
    return rows.mapInArrow(lambda it: _entries(it, edits, shortest, short), "key long, line long, own boolean")


def hot_keys(rows: DataFrame, edits: int, shortest: int, short: bool = False) -> list[int]:
    """Keys that many lines share, as a sample of some thousand documents shows.

    The list only decides how entries are dealt out; with any list the result is the same.
    """
    step = max(1, rows.count() // SAMPLE)
    some = rows.where(F.pmod(F.xxhash64("text", F.lit(3)), F.lit(step)) == 0)
    counts = all_entries(some, edits, shortest, short).groupBy("key").agg(F.countDistinct("line").alias("n"))
    return [r.key for r in counts.where(F.col("n") >= HOT).select("key").collect()]


def shared_entries(rows: DataFrame, edits: int, shortest: int, short: bool = False) -> DataFrame:
    """(key, line, own) of keys that different lines share, one of them with a segment of its own.

    Entries meet by key. Those of a hot key, which is shared for certain, are spread by line and all go on.
    """
    hot = hot_keys(rows, edits, shortest, short)
    entries = all_entries(rows, edits, shortest, short).withColumn("hot", F.col("key").isin(hot) if hot else F.lit(False))
    entries = entries.withColumn("part", F.when(F.col("hot"), F.pmod("line", F.lit(SPREAD))).otherwise(0))
    meet = Window.partitionBy("key", "part")
    lo, hi, own = F.min("line").over(meet), F.max("line").over(meet), F.max("own").over(meet)
    marked = entries.select("key", "line", "own", "hot", lo.alias("lo"), hi.alias("hi"), own.alias("any"))
    return marked.where("hot or (lo <> hi and any)").groupBy("key", "line").agg(F.max("own").alias("own"))


def line_links(docs: DataFrame, edits: int = EDITS, shortest: int = SHORTEST, short: bool = False) -> DataFrame:
    """Links (a, b) between keys of different lines at most ``edits`` edits apart, enough to connect all of them.

    Each distinct line gives the keys of its segments and probes. Keys that different lines share, one of them
    with its own segment, are candidates; their texts are fetched and verified unit by unit. A key that very
    many lines share is cut into blocks, each pair of which is a unit of its own.
    """
    rows = texts(docs).select("text")
    shared = settle(shared_entries(rows, edits, shortest, short), "line-candidates")
    blocks = shared.groupBy("key").agg(F.greatest(F.lit(1), F.round(F.count("*") / UNIT).cast("long")).alias("blocks"))
    text = settle(candidate_texts(rows, shared, shortest, short), "line-texts")
    units = shared.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("line"), F.col("blocks")))
    units = units.select("key", "line", "own", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    units = units.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "own", "line")
    units = units.join(text, "line").select("key", "low", "high", "block", "own", "line", "text")
    dealt = units.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    return dealt.mapInArrow(lambda it: _verify(it, edits, shortest), "a binary, b binary")


def line_classes(links: DataFrame) -> DataFrame:
    """(line, component) of all lines that links (a, b) between line keys connect; lines are numbered for that."""
    names = links.select(F.explode(F.array("a", "b")).alias("line")).distinct()
    names = settle(names.withColumn("node", F.monotonically_increasing_id()), "line-names")
    ends = [names.select(F.col("line").alias(c), F.col("node").alias(f"{c}_node")) for c in ("a", "b")]
    edges = links.join(ends[0], "a").join(ends[1], "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    return components(edges, "line-classes").join(names, "node").select("line", "component")


def candidate_texts(rows: DataFrame, shared: DataFrame, shortest: int, short: bool = False) -> DataFrame:
    """(line, text) of candidate lines. A bit filter of a fixed size spares most other lines the shuffle."""
    lines = shared.select("line").distinct()
    bit = F.pmod(F.xxhash64("line"), F.lit(FILTER_BITS))
    pages = lines.groupBy(F.floor(bit / 32768).alias("page")).agg(F.bitmap_construct_agg(bit % 32768).alias("bits"))
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in pages.toLocalIterator():  # pages of 4 KB, FILTER_BITS bits at most
        page = np.frombuffer(r.bits, np.uint8)
        at = r.page * 4096
        bits[at : at + len(page)] = page
    shipped = rows.sparkSession.sparkContext.broadcast(bits)
    found = rows.mapInArrow(lambda it: _wanted(it, shipped.value, shortest, short), "line long, text string")
    return found.join(lines, "line", "left_semi").distinct()


def _places(batches: Iterator[pa.RecordBatch], shortest: int, short: bool) -> Iterator[pa.RecordBatch]:
    """(doc_id, mark, at, line) of every line that is compared."""
    for batch in batches:
        rows = []
        for key, mark, text in zip(*(c.to_pylist() for c in batch.columns)):
            rows += [(key, mark, at, line_key(x)) for at, x in enumerate(text.split("\n")) if _compared(x, shortest, short)]
        if rows:
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "mark", "at", "line"])


def repeated_lines(docs: DataFrame, edits: int = EDITS, shortest: int = SHORTEST, short: bool = False) -> DataFrame:
    """(doc_id, mark, gone) of documents with lines to drop: their numbers, from 0.

    A class holds the lines that links connect; its first line in order of (doc_id, text hash, line)
    stays wherever it stands first, all others go. Null ids come first.
    """
    links = settle(line_links(docs, edits, shortest, short), "line-links")
    classes = line_classes(links)
    marked = texts(docs).where("text is not null").select("doc_id", F.xxhash64("text").alias("mark"), "text")
    places = marked.mapInArrow(lambda it: _places(it, shortest, short), "doc_id long, mark long, at int, line binary")
    places = settle(places, "line-places")
    own = F.struct("doc_id", "mark", "at")
    lines = places.groupBy("line").agg(F.min(own).alias("lo"), F.max(own).alias("hi"))
    kind = F.coalesce(F.col("component").cast("string"), F.hex("line"))  # a number, or 32 digits
    lines = lines.join(classes, "line", "left").withColumn("class", kind)
    firsts = lines.groupBy("class").agg(F.min("lo").alias("first"), F.max("hi").alias("last")).where("first <> last or first is null")
    verdicts = settle(lines.join(firsts, "class").select("line", "first"), "line-verdicts")
    gone = places.join(verdicts, "line").where(~own.eqNullSafe(F.col("first")))
    return gone.groupBy("doc_id", "mark").agg(F.collect_set("at").alias("gone"))


def drop_repeats(
    docs: DataFrame, edits: int = EDITS, shortest: int = SHORTEST, added: tuple[str, str] = ("n_lines", "gone"), short: bool = False
) -> DataFrame:
    """The documents with ``text`` cut to its first lines, and two added columns: how many lines there
    were, and the numbers of dropped lines.

    Lines of at least ``shortest`` code points that are at most ``edits`` edits apart are linked;
    of what links connect, the line that comes first by (doc_id, text, line number) stays, also
    within one document. Shorter lines always stay, unless ``short`` is set: then equal lines that
    are not blank are linked at any length, and others by edits in proportion to the shorter line's
    length, rounded down (by default one edit from 10 code points on). Lines are split at line feeds and compared as
    they are. A null text stays null and has no lines; an empty one has one empty line. Rows that
    repeat both doc_id and text are one document and are cut alike; a null doc_id comes first. All
    other columns are kept; an empty table gives no rows.
    """
    found = repeated_lines(docs, edits, shortest, short).withColumnsRenamed({"doc_id": "id", "mark": "key"})
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])  # no name of the table meets one used here
    here = docs.select(row.alias("row")).withColumn("text", F.col("row.text").cast("string"))
    same = F.col("row.doc_id").cast("long").eqNullSafe(F.col("id")) & (F.xxhash64("text") == F.col("key"))
    split = F.split("text", "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("gone"))
    pick = lambda xs: F.transform(kept, lambda i: F.get(xs, i))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(
        F.array_join(F.element_at(F.transform(F.array(split), pick), 1), "\n")
    )
    n_lines = F.coalesce(F.when(F.col("text").isNotNull(), F.size(split)), F.lit(0))
    gone = F.coalesce(F.array_sort("gone"), F.expr("cast(array() as array<int>)"))
    columns = [(text if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns]
    return here.join(found, same, "left").select(*columns, n_lines.alias(added[0]), gone.alias(added[1]))


def line_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, dropped, kept_sha256) of every row; dropped lists line numbers, comma-joined."""
    rows = drop_repeats(docs.select("doc_id", "text"), short=True)
    return rows.select(
        F.col("doc_id").cast("long"),
        F.col("n_lines").cast("long"),
        F.size("gone").cast("long").alias("n_dropped"),
        F.array_join(F.col("gone").cast("array<string>"), ",").alias("dropped"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )
