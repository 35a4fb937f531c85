import hashlib
import random
from collections import defaultdict

import pytest

from tabloom.llm import lines

BLANKS = " \t\n\x0b\x0c\r"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def expected(rows, least, least_docs):
    """By looking at every line: {(doc_id, text): (lines, dropped, kept)}."""
    least_long = -(1 << 63)
    held = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            held[lower(line.strip(BLANKS))].add(least_long if i is None else i)
    out = {}
    for i, text in rows:
        all_ = (text or "").split("\n")
        key = [lower(x.strip(BLANKS)) for x in all_]
        kept = [x for x, k in zip(all_, key) if len(k) < least or len(held[k]) < least_docs or max(held[k]) == (least_long if i is None else i)]
        out[i, text] = (len(all_), len(all_) - len(kept), "\n".join(kept))
    return out


def check(spark, rows, least=20, least_docs=3, parts=5):
    docs = spark.createDataFrame([(i, t, "x", 1, True) for i, t in rows], "doc_id long, text string, h string, slice int, hot boolean").repartition(parts)
    got = lines.without_lines(docs, lines.keep_bitmaps(docs, least, least_docs)).collect()
    want = expected(rows, least, least_docs)
    assert len(got) == len(rows)
    assert sorted(map(str, ((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got))) == sorted(map(str, ((i, *want[i, t]) for i, t in rows)))


def test_lines_of_the_fixture(spark, rows):
    check(spark, [(x[0], x[1]) for x in rows])


@pytest.mark.parametrize("least_docs", [2, 3, 5])
def test_shared_lines(spark, least_docs):
    r = random.Random(least_docs)
    pool = [f"Shared line number {k} of the pool é" for k in range(30)] + ["short", "", "   \t", "EXACTLY TWENTY CHARS", "nineteen characters"]
    rows = []
    for i in range(120):
        picked = [r.choice(["", " ", "\t\x0b"]) + x.upper() * (r.random() < 0.3) + x * 0 if r.random() < 0.2 else x for x in r.choices(pool, k=r.randint(0, 200))]
        rows.append((r.choice([i, i, i, None, 7]), "\n".join(picked) + r.choice(["", "\n", "\n\n"])))
    rows += [(500 + k, "the one line that a third of all documents hold\n" * (1 + k % 3) + f"own line of document number {k}") for k in range(60)]
    check(spark, rows + rows[:5], least_docs=least_docs)


def test_a_long_document_keeps_what_it_should(spark):
    shared = "\n".join(f"a line that three documents share {k}" for k in range(3000))
    mixed = "\n".join(x for k in range(3000) for x in (f"a line of one document only, {k}", f"a line that three documents share {k}"))
    check(spark, [(1, shared), (2, mixed), (3, shared), (4, None), (5, "")])


def test_bitmaps_hold_no_text_and_list_only_words_that_lose_lines(spark):
    docs = spark.createDataFrame([(i, "\n".join(["unshared " + str(i) * 30] * 200 + ["a line shared by all documents here"])) for i in range(4)], "doc_id long, text string")
    found = {r.d: r.keep for r in lines.keep_bitmaps(docs).collect()}
    assert set(found) == {0, 1, 2}  # the largest keeps its line
    assert [(w.word, w.bits) for w in found[0]] == [(200 // 64, ~(1 << 200 % 64))]


def test_empty_table_and_digest(spark, no_docs):
    assert lines.without_lines(no_docs, lines.keep_bitmaps(no_docs)).count() == 0
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in lines.op12_lines(spark, sf).collect()}
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = expected(rows, 20, 3)
    for i, t in rows:
        n, lost, kept = want[i, t]
        assert (got[i].n_lines, got[i].n_dropped, got[i].kept_sha256) == (n, lost, hashlib.sha256(kept.encode()).hexdigest())


def test_only_dataframe_functions_and_one_shuffle_of_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = lines.without_lines(docs, lines.keep_bitmaps(docs))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "MapInPandas" not in plan
