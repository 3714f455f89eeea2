"""The operators bound to the given tables with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cityflow.llm import (
    binids,
    centroids,
    language,
    leaks,
    lines,
    packing,
    personal,
    pieces,
    simhash,
    suffixes,
    syncmers,
    variants,
    vectors,
)
from cityflow.llm.common import table
from cityflow.session import pin

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def op1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_digests(table(pin(spark), sf_dir), PIECES)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(pin(spark), sf_dir), WORDS)


def op3_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.edit_prints(table(pin(spark), sf_dir))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(pin(spark), sf_dir), radius=2, words=3)
    return found.select("doc_id", simhash.hex_print("print").alias("fingerprint"), "component_id")


def op5_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeat_digests(table(pin(spark), sf_dir), length=400)


def op6_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(pin(spark), sf_dir, "embeddings"), threshold=0.93)


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_digests(table(pin(spark), sf_dir))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binids.token_file_rows(table(pin(spark), sf_dir), WORDS)


def op9_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.span_digests(table(pin(spark), sf_dir))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predictions(table(pin(spark), sf_dir))


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(table(pin(spark), sf_dir), slips=97)


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(table(pin(spark), sf_dir, "embeddings"), k=40, rounds=5, dims=64)


def op13_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leak_digests(table(pin(spark), sf_dir), table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f for f in (
        op1_pieces,
        op2_packing,
        op3_syncmers,
        op4_simhash,
        op5_suffixes,
        op6_vectors,
        op7_lines,
        op8_token_files,
        op9_personal,
        op10_language,
        op11_variants,
        op12_centroids,
        op13_leaks,
    )
}



def _cluster_sql(k: int = 40, rounds: int = 5, dims: int = 64) -> str:
    """Rounds written out one after the other: nearest_i are the assignments to centroids_i."""
    steps = [
        f"""kept AS MATERIALIZED (
            SELECT row_number() OVER () AS r, vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(x * 256) AS BIGINT)) AS v
            FROM embeddings WHERE len(embedding) = {dims} AND list_count(embedding) = {dims}
              AND len(list_filter(embedding, lambda x: isfinite(x))) = {dims}),
        centroids_0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('2:' || CAST(vec_id AS VARCHAR)) AS h, v FROM kept
            WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT {k}))"""
    ]
    for i in range(rounds + 1):
        steps.append(f"""nearest_{i} AS MATERIALIZED (
            SELECT r, vec_id, k.v, min(struct_pack(d := CAST(list_sum(list_transform(list_zip(k.v, m.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT), c := c)) AS n
            FROM kept k CROSS JOIN centroids_{i} m GROUP BY r, vec_id, k.v)""")
        if i < rounds:
            steps.append(f"""parts_{i} AS (SELECT n.c AS c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM nearest_{i}),
        sums_{i} AS (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM parts_{i} GROUP BY c, i),
        means_{i} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM sums_{i} GROUP BY c),
        centroids_{i + 1} AS MATERIALIZED (SELECT c, coalesce(m.v, o.v) AS v FROM centroids_{i} o LEFT JOIN means_{i} m USING (c))""")
    return f"""WITH {", ".join(steps)}
        SELECT vec_id, CAST(n.c AS INTEGER) AS cluster, n.d AS distance, CAST(sum(n.d) OVER (PARTITION BY n.c) AS BIGINT) AS cluster_inertia,
            CAST(sum(n.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m.v, ',')) AS centroid_sha256
        FROM nearest_{rounds} a JOIN centroids_{rounds} m ON m.c = a.n.c"""


# The other operators need tokenizers, checksums and 64-bit hashes, fitted models or edit distances over all lines, which
# the SQL of the comparison can't say; their tests hold plain versions against them.
ORACLES: dict[str, str] = {
    "op6_vectors": """WITH RECURSIVE sound AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE label IS NOT NULL AND len(embedding) > 0 AND list_count(embedding) = len(embedding)
              AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        pairs AS (
            SELECT a.vec_id AS x, b.vec_id AS y FROM sound a JOIN sound b
            ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93),
        reach AS (SELECT x, y FROM pairs UNION SELECT r.x, p.y FROM reach r JOIN pairs p ON r.y = p.x),
        least_of AS (SELECT x, min(y) AS y FROM reach GROUP BY x),
        links AS (SELECT x, count(*) AS n FROM pairs GROUP BY x)
        SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(g.y, vec_id)) AS component_id,
            vec_id <= coalesce(g.y, vec_id) AS kept
        FROM embeddings LEFT JOIN links l ON l.x = vec_id LEFT JOIN least_of g ON g.x = vec_id""",
    "op12_centroids": _cluster_sql(),
    "op13_leaks": r"""WITH spoken AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        asked AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        starts AS (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM asked WHERE len(w) > 0),
        windows AS MATERIALIZED (SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS g, least(len(w), 10) AS n FROM starts),
        lengths AS (SELECT DISTINCT n FROM windows),
        places AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM spoken, lengths),
        found AS MATERIALIZED (
            SELECT r, i, p.n, item_id FROM places p JOIN windows x ON x.n = p.n AND x.g = array_to_string(p.w[i:i + p.n - 1], ' ')),
        hit AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM found) GROUP BY r),
        named AS (SELECT r, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM found WHERE item_id IS NOT NULL GROUP BY r)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
            sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM spoken LEFT JOIN hit USING (r) LEFT JOIN named USING (r)""",
}
