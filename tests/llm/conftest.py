import random

import pytest

#: Columns besides those of documents, with names that operators use inside.
EXTRA = ("key", "bits", "n", "ids", "words", "spans", "label", "score")


@pytest.fixture(scope="session")
def texts():
    """doc_id and text: null and blank texts, a null doc_id, repeated rows, exact and near copies, shared passages, one very long text."""
    rng = random.Random(11)
    words = [f"w{k}" for k in range(300)] + ["Übung", "naïve", "日本", "mit", "License", "the", "of"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    first, passage = prose(90), prose(60)
    near = first.split()
    near[40] = "changed"
    rows = [(1, first), (2, first), (2, first), (3, " ".join(near)), (4, prose(30) + "\n" + passage + "\n" + prose(30)), (5, prose(20) + " " + passage), (6, None), (7, ""), (8, " \n\t "), (9, "one"), (10, "one two"), (None, "no number " + prose(20)), (11, prose(20_000))]
    rows += [(20 + k, prose(rng.randint(5, 120)) + ("\n" + prose(8)) * rng.randint(0, 3)) for k in range(40)]
    rows += [(70, "MIT License\n\nApache License, Version 2.0 and the GNU General Public License, version 3."), (71, "a" * 50_000), (72, "x y z <|endoftext|> tab\there  two"), (73, "!!! ### $$$")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)
    rows = [(d, t, None if (d or 0) % 9 == 0 else "en", None if (d or 0) % 7 == 0 else "web", len(t or ""), *EXTRA) for d, t in texts]
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
