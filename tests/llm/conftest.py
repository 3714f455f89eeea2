import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

# Names that operators use inside; a table may have them too.
SCHEMA = "doc_id long, text string, lang string, node string, component string, n long, line int, print double, `_text` string, n_chars long, "
SCHEMA += "gone string, n_lines int, `_lang` int, `_row` string, row string, id string, a int, key string, base string, `a.b` int"
CLASH = ("g", 7, 8, "r", "s", "i", 9, "k", "b", None)
LONG = "Das ist ein sehr langer Text ohne Ende, number 5 of many. "


def make_rows():
    """Nulls, empty and blank texts, copies, near copies, a repeated row, a null id, a very long text."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
    line = lambda n=9: " ".join(word() for _ in range(n)).capitalize() + "."
    base = "\n".join(line() for _ in range(8))
    passage = line(90)
    near = base.replace(base.split()[20], "zzzz", 1)
    texts = [base, base, near, base + "\n" + line(), None, "", "   ", "\n\n", "x", "Two words", passage]
    texts += [line() + "\n" + passage + "\n" + line(), passage + " " + line()]
    texts += ["日本語 テスト 😀 é é", "a  b   c ", " lead", "don't I'LL.' <|endoftext|> a<s>", "▁ mark", "tab\tvt\x0bff\x0c", "ab" * 900]
    texts += [LONG * 700, "same line that is long enough\nsame line that is long enougt\nshort\nshort", "Same line that is long enough"]
    texts += ["Write to a.b@c.example.org or +1 (212) 555-0101, 10.0.0.255 or 4111 1111 1111 1111. Not 4111 1111 1111 1112, 300.1.1.1"]
    texts += [line(30) for _ in range(12)]
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(None, "a null id"), (9, base + "\n" + texts[3].split("\n")[-1]), (200, base.lower())]
    return [(k, t, ("en", "fr", None)[i % 3], "x", "y", 1, 2, 0.5, "z", len(t or ""), *CLASH) for i, (k, t) in enumerate(rows)]


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def words_path():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


@pytest.fixture(scope="session")
def pieces_path():
    return pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")
