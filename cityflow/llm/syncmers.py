"""Operator 3: document fingerprints from closed syncmers, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cityflow.llm.common import parts_for, texts

#: Units of a k-mer and of its inner substrings; a unit is a run of at most 8 characters without white space.
K, S = 5, 2
UNIT = r"\S{1,8}"
#: Anchor codes of a fingerprint.
SKETCH = 64
#: Bytes of text of one bucket of neighbouring documents, on average.
BUCKET_BYTES = 16 * 1024**2
_LOWEST = -(2**63)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once however often the body reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def anchors(text: Column) -> Column:
    """The closed syncmers of a text: array of (place, code), place counting units from 0.

    Of the k - s + 1 inner substrings of a k-mer the one with the least hash decides: the k-mer is
    an anchor if that is its first or its last one. This depends on the k-mer alone, so equal
    passages have equal anchors wherever they stand. A text with fewer units than a k-mer has one
    anchor, all its units; an empty or null text has none.
    """
    units = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(UNIT), F.lit(0)), lambda u: F.xxhash64(u))

    def of_units(h: Column) -> Column:
        inner = F.transform(F.sequence(F.lit(0), F.size(h) - S), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(S)]))

        def of_inner(m: Column) -> Column:
            def closed(i: Column) -> Column:
                least = F.least(*[F.get(m, i + j) for j in range(K - S + 1)])
                return (F.get(m, i) == least) | (F.get(m, i + (K - S)) == least)

            places = F.filter(F.sequence(F.lit(0), F.size(h) - K), closed)
            code = lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(K)])
            return F.transform(places, lambda i: F.struct(i.alias("place"), code(i).alias("code")))

        whole = F.array(F.struct(F.lit(0).alias("place"), F.xxhash64(h).alias("code")))
        none = F.slice(whole, 1, 0)
        return F.when(F.size(h) >= K, _let(inner, of_inner)).when(F.size(h) > 0, whole).otherwise(none)

    return _let(units, of_units)


def fingerprint(text: Column) -> Column:
    """The least codes of a text's distinct anchors, ascending: array of at most SKETCH longs."""
    codes = F.transform(anchors(text), lambda a: a["code"])
    return F.slice(F.sort_array(F.array_distinct(codes)), 1, SKETCH)


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common anchors, 0 to 1: among the least codes of both together, those in both.

    Two fingerprints without anchors are equal, so 1.
    """

    def of_least(u: Column) -> Column:
        common = F.size(F.array_intersect(F.array_intersect(u, a), b))
        return F.when(F.size(u) == 0, F.lit(1.0)).otherwise(common / F.size(u))

    return _let(F.slice(F.sort_array(F.array_union(a, b)), 1, SKETCH), of_least)


def as_text(codes: Column) -> Column:
    return F.concat_ws("", F.transform(codes, lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))))


def document_anchors(docs: DataFrame) -> DataFrame:
    """(doc_id, place, code) of all anchors of all documents, for positional matching: two documents
    share a passage where equal codes keep an equal difference of places."""
    return texts(docs).select("doc_id", F.inline(anchors(F.col("text"))))


def _bucket(key: Column, bounds: list[int]) -> Column:
    """How many bounds are at most the key, found in two steps over about the root of their number."""
    step = max(1, int(len(bounds) ** 0.5))
    rows = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    if not rows:
        return F.lit(0)
    array = lambda xs: "array(" + ",".join(f"{x}L" for x in xs) + ")"
    table = F.expr("array(" + ",".join(array(r) for r in rows) + ")")
    heads = F.expr(array([r[0] for r in rows]))
    row = F.size(F.filter(heads, lambda b: b <= key))
    inside = F.size(F.filter(F.get(table, row - 1), lambda b: b <= key))
    return F.when(row == 0, F.lit(0)).otherwise((row - 1) * step + inside)


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, print, next_text, next_print): each document beside the next one in descending doc_id.

    After the last comes the first; null ids come last, equal ids are ordered by text; a null text
    is empty. Documents are cut into buckets of neighbouring ids by quantiles, and each bucket also
    gets a copy of the first document of the bucket after it, so no window spans the table and the
    texts are shuffled once. Only one bound per bucket goes through the driver.
    """
    rows = texts(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("_key", F.coalesce("doc_id", F.lit(_LOWEST))).withColumn("_mark", F.xxhash64("text"))
    size, low = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.min("_key")).first()
    n = 4 * parts_for(rows, size, 4 * BUCKET_BYTES)
    cuts = rows.agg(F.percentile_approx("_key", [i / n for i in range(1, n)], 10 * n)).first()[0] or []
    bounds = sorted({b for b in cuts if b > low})
    rows = rows.withColumn("_bucket", _bucket(F.col("_key"), bounds))
    firsts = rows.groupBy("_bucket").agg(F.max(F.struct("_key", "_mark")).alias("_first"))
    firsts = firsts.select("_bucket", "_first._key", "_first._mark")  # one row per bucket, whatever the table holds
    ghosts = rows.join(F.broadcast(firsts), ["_bucket", "_key", "_mark"], "left_semi").dropDuplicates(["_bucket"])
    ghosts = ghosts.withColumn("_bucket", F.pmod(F.col("_bucket") + 1, F.lit(len(bounds) + 1)))
    both = rows.withColumn("_ghost", F.lit(False)).unionByName(ghosts.withColumn("_ghost", F.lit(True)))
    both = both.withColumn("print", fingerprint(F.col("text")))
    order = Window.partitionBy("_bucket").orderBy("_ghost", F.desc("_key"), F.desc("_mark"), F.desc("text"))
    found = both.withColumn("next_text", F.lead("text").over(order)).withColumn("next_print", F.lead("print").over(order))
    return found.where("not _ghost").select("doc_id", "text", "print", "next_text", "next_print")


def edit_prints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The edited text has the last floor(n/2) code points of a text replaced by the first as many of
    the next document, or by all of it. Whole texts are read; a null text is empty; repeated rows
    stay; an empty table gives no rows; other columns are ignored.
    """
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left("text", n - half), F.left("next_text", half))
    rows = with_next(docs).select("doc_id", "print", "next_print", n.alias("n"), edited.alias("edited"))
    own = F.col("print")
    again = _let(
        fingerprint(F.col("edited")),
        lambda e: F.struct(as_text(e).alias("text"), likeness(own, e).alias("near")),
    )
    rows = rows.select(
        "doc_id",
        F.col("n").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(own).alias("fingerprint"),
        again.alias("again"),
        likeness(own, F.col("next_print")).alias("near_next"),
    )
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint",
        F.col("again.text").alias("edited_fingerprint"), F.col("again.near").alias("near_edited"), "near_next",
    )
