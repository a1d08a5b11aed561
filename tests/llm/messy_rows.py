"""Small documents with every oddity."""

import random

import pytest

SF = "/root/testdata/sf0.001"

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, seeds string, factors int, digest int, label int"


def messy():
    """Documents with nulls, empty, tiny and long texts, copies, near copies, shared passages and clashing columns."""
    r = random.Random(4)
    vocabulary = ["".join(r.choice("abcdefghiéß") for _ in range(r.randint(1, 9))) for _ in range(400)]

    def prose(n):
        return " ".join(r.choice(vocabulary) for _ in range(n))

    base, passage = prose(120), prose(60)
    texts = [None, "", " \n\t ", "one", "One", "one", "a b", "A  b", "!!! 123", passage, passage]
    texts += [base, base, base.upper(), prose(5000), "x" * 3000, "tab\tfeed\x0bword", "it's they're 'll 5's\n\n  end "]
    for _ in range(12):
        words = base.split()
        words[r.randrange(len(words))] = prose(1)
        texts.append(" ".join(words))
    texts += [f"{prose(30)} {passage} {prose(r.randint(0, 40))}" for _ in range(10)]
    texts += ["<|endoftext|>", f"a <|endoftext|> b<|endoftext|>", "漢字かな交じり文 и кириллица"]
    return [(i + 1, t, r.choice(["en", "de", None]), "s", len(t or ""), "x", i, i, i) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(messy(), SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Rows without a doc_id and rows that repeat one."""
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(None, text), (None, None), (7, text), (7, text), (7, "other words"), (9, text), (8, None)]
    return spark.createDataFrame([(i, t, "en", "s", 1, "x", 1, 1, 1) for i, t in rows], SCHEMA)
