import random

import pytest

# Texts that break careless code: null, empty, blanks only, one word, very long, markup, control strings, other scripts.
AWKWARD = [
    None, "", " \t\n\x0b\x0c\r", "one", "a b c", "word " * 9, "x" * 50_000, "same line\nsame line\nother line here\n\n",
    "<|turn|>system<|end|> \\ \\\\ </s>[INST]", "naïve ﬁ 😀 漢字 　 é nbsp here", "#*$%&|<> " * 4, "\x00 zero", "a  b   c    d",
    "The The the THE of Of", "tab\tseparated\twords and more of the same words and more of the same words",
]
VOCABULARY = "the of and river stone light moves quickly under bridge while birds sing softly near old town walls every day".split()


def prose(rng: random.Random, n: int) -> str:
    words = [rng.choice(VOCABULARY) + str(rng.randrange(40)) if rng.random() < 0.5 else rng.choice(VOCABULARY) for _ in range(n)]
    return " ".join(w + ("\n" if rng.random() < 0.08 else "") for w in words)


def changed(rng: random.Random, text: str, edits: int) -> str:
    words = text.split(" ")
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text) rows with awkward texts, near and exact copies, a hot passage, a null doc_id and a repeated row."""
    rng = random.Random(5)
    texts = list(AWKWARD)
    for _ in range(20):
        base = prose(rng, rng.randrange(12, 160))
        texts += [base, base, changed(rng, base, 1), changed(rng, base, 3), changed(rng, base, 12)]
    passage = prose(rng, 60)
    texts += [passage + " " + prose(rng, rng.randrange(20, 60)) for _ in range(60)]
    texts.append(prose(rng, 9_000))
    ids = list(range(0, 7 * len(texts), 7))
    rng.shuffle(ids)
    rows = list(zip(ids, texts))
    return [*rows, rows[20], rows[20], (None, "a text without its doc_id that is long enough to have shingles")]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with further columns whose names clash with those the operators make or differ in case only."""
    rows = [(i, t, "x", 1, 2.0, None) for i, t in corpus]
    schema = "doc_id long, text string, Text string, score int, k double, slice string"
    return spark.createDataFrame(rows, schema).repartition(6)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture(scope="session")
def nothing(spark):
    """A table whose every column is null."""
    return spark.createDataFrame([(None, None), (None, None)], "doc_id long, text string")
