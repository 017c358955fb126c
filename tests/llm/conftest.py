import random

import pytest


def prose(seed: int, words: int, vocabulary: int = 400) -> list[str]:
    rng = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyzéß"
    known = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(vocabulary)]
    return [rng.choice(known) for _ in range(words)]


LONG = prose(1, 300)
PASSAGE = " ".join(prose(2, 80))


def corpus() -> list[tuple]:
    """Rows (doc_id, text): nulls, blanks, copies, near copies, a shared passage, a period, a very long text, repeated rows."""
    near = [w if i % 40 else f"new{i}" for i, w in enumerate(LONG)]
    out = [
        (1, " ".join(LONG)),
        (2, " ".join(near)),
        (3, " ".join(LONG)),
        (4, None),
        (5, ""),
        (6, " \n\t "),
        (7, "four words are few"),
        (8, "Four WORDS are few"),
        (9, " ".join(prose(3, 60)) + "\n" + PASSAGE + " " + " ".join(prose(4, 50))),
        (10, PASSAGE + "\n" + " ".join(prose(5, 70))),
        (11, " ".join(prose(6, 30)) + " " + PASSAGE),
        (12, "tick tock " * 300),
        (13, "x" * 700),
        (14, "x" * 400 + " " + PASSAGE),
        (15, " ".join(prose(7, 30000, 3000))),
        (16, "don't  stop 's we'll\n\n\t end…  日本語 <|endoftext|> ½ "),
        (17, " ".join(prose(8, 120))),
        (17, " ".join(prose(8, 120))),
        (None, " ".join(LONG)),
        (None, " ".join(prose(9, 100))),
    ]
    return [*out, *((100 + i, " ".join(prose(8, 120)) + f" number{i}") for i in range(30))]


@pytest.fixture(scope="session")
def docs(spark, tmp_path_factory):
    """The corpus in several files, with columns whose names the operators use inside."""
    path = str(tmp_path_factory.mktemp("docs") / "docs")
    rows = [(i, t, "de", None if n % 3 else "s", n, n / 2) for n, (i, t) in enumerate(corpus())]
    spark.createDataFrame(rows, "doc_id long, text string, sheet string, rest string, rep int, `a b` double").repartition(5, "rep").write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty") / "docs")
    spark.createDataFrame([], "doc_id long, text string").write.parquet(path)
    return spark.read.parquet(path)
