import random

import corpus_pipeline
from cityflow.llm.common import settle


def test_stages_on_awkward_rows(spark, docs, empty):
    for table in (docs, empty):
        rows = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            rows = settle(stage(spark, rows, ""), f"test-{name}")
            assert rows.columns == table.columns
        final = corpus_pipeline.STAGES[-1][1](spark, rows, "")
        assert {r.doc_id for r in final.select("doc_id").collect()} == {r.doc_id for r in rows.select("doc_id").collect()}


def test_stages_drop_only_what_they_must(spark, docs):
    (_, by_language), (_, by_lines), (_, by_copies), (_, redacted), _ = corpus_pipeline.STAGES
    known = settle(by_language(spark, docs, ""), "test-known")
    assert docs.count() - known.count() >= 5
    first = settle(by_lines(spark, known, ""), "test-first")
    # a copy whose lines all stood before goes; whoever keeps a line stays
    ids = {r.doc_id for r in first.select("doc_id").collect()}
    assert 0 in ids and 3 not in ids
    assert all(r.n_chars == len(r.text) for r in first.collect())
    single = settle(by_copies(spark, known, ""), "test-single")
    assert {0, 3, 200} & {r.doc_id for r in single.collect()} == {0}
    assert redacted(spark, single, "").count() == single.count()


def test_run(spark, sf):
    final = corpus_pipeline.run(spark, sf)
    assert final.count() > 100 and [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "copies", "personal", "packing"]


OTHERS = [
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
    "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler.",
    "Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek ésszel és lelkiismerettel bírnak.",
]


def test_other_languages_and_gibberish_go(spark, sf):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 10)))
    more = OTHERS + [" ".join(word() for _ in range(n)) for n in (10, 30, 200)]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    extra = spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate(more)], docs.schema)
    kept = {r.doc_id for r in corpus_pipeline.known_language(spark, docs.union(extra), sf).select("doc_id").collect()}
    assert not [t for i, t in enumerate(more) if -1 - i in kept]
    labelled = {r.doc_id for r in docs.where("lang is not null and text rlike '[A-Za-z]'").select("doc_id").collect()}
    assert len(labelled) > 100 and len(labelled & kept) >= 0.99 * len(labelled)
