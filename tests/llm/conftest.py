import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def make_docs(seed=5, n=90):
    """Documents with copies, near copies, shared passages, common lines, junk, odd characters, and benchmark items."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeiounrst") for _ in range(rng.randint(1, 8))) for _ in range(400)] + ["été", "größe", "日本"]
    say = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passage, line, items = say(70), " ".join(say(12)), [(i, " ".join(say(k))) for i, k in enumerate((20, 14, 13, 30, 7, 3))]
    docs = []
    for i in range(n):
        w = say(rng.choice((3, 40, 60, 120, 300)))
        kind = i % 9
        if kind == 1 and i > 9:
            docs.append(rng.choice(docs))
            continue
        if kind == 2 and i > 9:
            w = rng.choice(docs).split()
            w[rng.randrange(len(w))] = "swapped"
        if kind == 3:
            at = rng.randrange(len(w))
            w = w[:at] + passage[rng.randrange(8):] + w[at:]
        if kind == 4:
            at = rng.randrange(len(w))
            w = w[:at] + rng.choice(items)[1].split() + w[at:]
        if kind == 5:
            w = [x + rng.choice(("###", "***", "!!", "")) for x in w]
        if kind == 6:
            w = (w[:9] * 20)[: len(w)]
        text = " ".join(w)
        if kind == 7:
            text = line + "\n" + text + "\n" + line
        if kind == 8:
            text = text.replace(" ", "\t ", 3) + "<|endoftext|> it's we'll  don't x\r\n\n"
        docs.append(text)
    return [(i, t, "en", f"src{i % 4}", len(t)) for i, t in enumerate(docs)], items


@pytest.fixture(scope="session")
def corpus():
    return make_docs()


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus[0], DOCS)


@pytest.fixture(scope="session")
def items(spark, corpus):
    return spark.createDataFrame(corpus[1], "item_id long, text string")


LONG = " ".join(f"w{k % 977}" for k in range(60_000))
SOME = " ".join(f"v{k}" for k in range(80))

#: Nulls in every column, empty and blank texts, a very long text, repeated rows, ties of id, one host null.
EDGES = [
    (None, SOME, None, None, None), (1, None, "en", "a", None), (2, "", None, "a", 0), (3, " \t\n ", "en", None, 4),
    (4, LONG, "en", "b", len(LONG)), (5, SOME, "en", "b", 1), (5, SOME, "en", "b", 1), (5, SOME + " end", "en", "a", 2),
    (6, LONG + " tail", "en", "b", 3), (7, SOME, None, "c", 5), (None, None, None, None, None), (8, "one two", "en", "c", 7),
]
#: Columns whose names the operators use themselves.
CLASHES = ("key", "row", "failed", "node", "size", "text_", "target", "rejected_host", "leaked", "bucket", "epochs", "hits", "n_words", "th", "did")


@pytest.fixture(scope="session")
def edges(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(EDGES, DOCS)
    for c in CLASHES:
        df = df.withColumn(c, F.lit(c))
    return df


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df, *columns):
    """The rows of a frame as sorted tuples, nulls first."""
    got = [tuple(r[c] for c in columns) for r in df.select(*columns).collect()]
    return sorted(got, key=lambda r: [(x is not None, x) for x in r])


def in_order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: [(x is not None, x) for x in r])
