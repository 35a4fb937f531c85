import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from tabloom.llm import spelling


def near(a, b):
    """Exactly one code point inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def expected_words(rows, least=6, count=5):
    found = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= least and n >= count}


def expected(words, ratio=5):
    out, forms = {}, {}
    for w, n in words.items():
        close = [(-m, x) for x, m in words.items() if near(w, x)]
        best = min(close, default=None)
        forms[w] = best[1] if best and -best[0] >= ratio * n else None
        out[w] = [len(close), -best[0] if forms[w] else None]
    for w in words:
        root = w
        while forms[root]:
            root = forms[root]
        out[w] = (w, forms[w], root, words[w], *out[w])
    return sorted(out.values())


def result(df):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect())


def test_words_of_the_fixture(spark, docs, rows):
    assert {r.word: r.n for r in spelling.vocabulary(docs).collect()} == expected_words([(x[0], x[1]) for x in rows])
    assert result(spelling.spelling_groups(docs)) == expected(expected_words([(x[0], x[1]) for x in rows]))


def test_pairs_forms_and_chains(spark):
    """Words of few letters, so that many are near; repeated letters, letters that share a bit, and chains of several steps."""
    r = random.Random(3)
    words = {"".join(r.choice("abcÀàö÷ÿ") for _ in range(r.randint(6, 9))): r.choice([5, 6, 30, 200]) for _ in range(300)}
    base = "chained"
    for k in range(6):  # each five times as frequent as the one before
        words[base] = 5 * 5**k
        base = base[:k] + "z" + base[k + 1 :]
    for w in list(words)[:150]:
        k = r.randrange(len(w))
        words.setdefault(w[:k] + r.choice("abcÀàö") + w[k + r.randint(0, 1) :], r.choice([5, 25, 25, 1000]))
    words = {w: n for w, n in words.items() if len(w) >= 6}
    table = spark.createDataFrame(list(words.items()), "word string, n long").repartition(4)
    want = {(a, b) for a in words for b in words if near(a, b)}
    got = [(x.word, x.near) for x in spelling.near_words(table).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 200
    text = " ".join(w for w, n in words.items() for _ in range(n))
    docs = spark.createDataFrame([(k, text[: len(text)], "w", 1) for k in (None, 5)] + [(9, None, "w", 1), (9, "", "w", 1)], "doc_id long, text string, word string, n int")
    pairs = [(r.doc_id, r.text) for r in docs.collect()]
    found = result(spelling.spelling_groups(docs))
    assert found == expected(expected_words(pairs))
    assert any(f[1] and f[1] != f[2] for f in found)


def test_roots_of_long_chains(spark):
    forms = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(25)] + [("x", "w3")], "word string, form string")
    assert {r.word: r.root for r in spelling.roots(forms, 5**26).collect()} == {f"w{k}": "w25" for k in range(25)} | {"x": "w25"}


def test_masks(spark):
    words = spark.createDataFrame([("aabb",), ("abc",), ("abz",), ("à",)], "word string").select("word", spelling.parity_mask(F.col("word")).alias("m"), F.bit_count(spelling.parity_mask(F.col("word"))).alias("n"))
    got = {r.word: (r.m, r.n) for r in words.collect()}
    assert got["aabb"] == (0, 0) and got["abc"][1] == 3 and bin(got["abc"][0] ^ got["abz"][0]).count("1") == 2 and got["à"][1] == 1


def test_empty_table(spark, no_docs):
    assert spelling.spelling_groups(no_docs).count() == 0
