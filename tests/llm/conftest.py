import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, g int, fp string, score string, shard string, tid string, size string, items string"


def sentence(r: random.Random, n: int, vocabulary: list[str]) -> str:
    return " ".join(r.choice(vocabulary) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="session")
def rows():
    """Documents with nulls, empty and long texts, repeated rows, shared passages and near copies."""
    r = random.Random(5)
    words = ["".join(r.choice("abcdefghiklmnoprstuéü") for _ in range(r.randint(1, 8))) for _ in range(400)]
    passage = " ".join(r.choice(words) for _ in range(60))
    out = []
    for i in range(60):
        text = " ".join(sentence(r, r.randint(3, 30), words) for _ in range(r.randint(1, 8)))
        if i % 4 == 0:
            text = text + " " + passage + " " + sentence(r, 5, words)
        out.append([i * 3 + 1, text, ["en", "fr", None][i % 3], [None, "b", "a", "c"][i % 4]])
    base = out[7][1]
    out += [[500 + k, base, "en", "a"] for k in range(6)]
    out += [[600 + k, base + f" tail{k}", "en", "a"] for k in range(4)]
    out += [[700, None, None, None], [701, "", "en", "b"], [702, " \t\n ", "en", "b"], [703, "…", None, "b"], [704, "one two", "fr", "c"], [None, base, "en", "a"], [None, None, None, None]]
    out += [out[3], out[3], [705, "x" * 5000 + " " + "9" * 3000 + " a@" + "b." * 800, "en", "a"], [706, " ".join(r.choice(words) for _ in range(20000)), "fr", "a"], [707, "  word\x1cword\x85 A.B ÀÉ", "fr", "a"]]
    return [tuple(x) for x in out]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame([(*x, None if x[1] is None else len(x[1]), 1, "fp", "s", "h", "t", "z", "i") for x in rows], COLUMNS).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)
