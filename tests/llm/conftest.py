import random

import pytest

WORDS = "the thonre and keit de la ein und que los oned anea stly wh".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "en", "a", "st"]) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with nulls, blanks, copies, near copies, long texts, repeated rows and odd characters."""
    rng = random.Random(4)
    base = [prose(rng, rng.randint(30, 120)) for _ in range(30)]
    texts = list(base)
    texts += [base[0], base[0], base[1]]  # copies
    for k in range(6):  # near copies
        w = base[2].split()
        w[rng.randrange(len(w))] = f"other{k}"
        texts.append(" ".join(w))
    texts += [None, "", "   \n\t ", "one", "one two three", "İstanbul ½ x² 東京 😀 naïve", "a\x1cb\x85c", "x" * 5000, prose(rng, 9000), "hi <|endoftext|> there <|startoftext|>"]
    shared = "this very line of text is found in many of the documents here"
    texts += [f"{prose(rng, 40)}\n{shared}\n{prose(rng, 30)}", f"{shared.replace('many', 'mony')}\n{prose(rng, 50)}", f"{prose(rng, 25)}\n{shared[:-1]}", "Ha " * 300, "%%% " * 50 + prose(rng, 30)]
    out = [(i, t, ["en", "de", "fr", None][i % 4], None if i == 7 else f"src{i % 3}", len(t) if t else 0) for i, t in enumerate(texts)]
    out += [out[5], out[5], (None, "a text without an id " * 9, "en", "src1", 1)]  # repeated rows, and no id
    return out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def wide(docs):
    """The documents with further columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit(1) for c in ("words", "size", "shard", "key", "d", "l", "rank", "stratum", "ids", "row", "tokens", "n", "kept")})


@pytest.fixture(scope="session")
def labels(spark, rows):
    return spark.createDataFrame([(r[0], 1, 0) for r in rows if r[0] is not None and r[0] < 30], "doc_id long, quality int, toxic int")
