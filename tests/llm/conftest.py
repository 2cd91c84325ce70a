import random

import pytest

WORDS = [a + b for a in ("ba", "ce", "di", "fo", "gu", "Ha", "je", "ki") for b in ("n", "r", "st", "l,", "m.", "x")]


def make_docs(seed=1, n=60):
    """(doc_id, text, lang, source): copies, near copies, shared passages, nulls, blanks, a very long text, repeated rows."""
    r = random.Random(seed)
    text = lambda k: " ".join(r.choice(WORDS) for _ in range(k))
    passage = text(40)
    docs = []
    for i in range(n):
        t = text(r.randint(3, 120))
        kind = i % 10
        if kind == 3 and i > 10:
            t = docs[r.randrange(len(docs))][1]
        elif kind == 5 and i > 10:
            words = (docs[i - 5][1] or "x").split(" ")
            words[len(words) // 2] = "changed"
            t = " ".join(words)
        elif kind == 7:
            t = text(10) + " " + passage + "\n" + text(5)
        docs.append((i, t, "en" if i % 3 else None, f"src{i % 4}" if i % 7 else None))
    long = " ".join(r.choice(WORDS) + str(r.randrange(9)) for _ in range(30000))
    docs += [(100, None, None, None), (101, "", "en", "src1"), (102, " \n\t\x0b\x0c\r ", "en", "src1"), (103, long, "en", "src1"), (104, long[:5000] + " end", "en", "src1"), (105, "one", "en", "src2"), (106, "ONE", "en", "src2"), (107, "one two", "en", "src2"), (108, "é " * 300, "fr", "src3"), (109, "aaaa" * 100, "fr", "src3"), (110, "naïve word \x1c x", "fr", "src3")]
    return docs


@pytest.fixture(scope="session")
def rows():
    return make_docs()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows with extra columns whose names the operators use themselves."""
    more = [(*x, 7, "z", 1.5, "q") for x in rows]
    return spark.createDataFrame(more, "doc_id long, text string, lang string, source string, block int, kept string, score double, rest string").repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null ids and repeated rows."""
    t = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau"
    return spark.createDataFrame([(None, t), (None, t), (5, t), (5, t), (6, None), (6, None)], "doc_id long, text string")
