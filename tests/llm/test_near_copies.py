"""Near copies against all pairs."""

import random

from tabloom.llm import near_copies

from .test_exact import slow_components, slow_fingerprint


def edited(r, words, n):
    words = list(words)
    for _ in range(n):
        words[r.randrange(len(words))] = f"new{r.randrange(10**6)}"
    return words


def slow_keep(rows):
    """Rows (doc_id, text) that stay, plainly: one of each component of fingerprints, then one of each component of near copies."""
    first = lambda group: min(group, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    for roots in (lambda: slow_components([slow_fingerprint(t) for _, t in rows]), lambda: copies(rows)):
        groups = {}
        for r, root in zip(rows, roots()):
            groups.setdefault(root, []).append(r)
        rows = [first(g) for g in groups.values()]
    return sorted(rows, key=repr)


def copies(rows):
    sets = [near_copies.shingles((t or "").encode()) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if near_copies.alike(sets[i], sets[j]):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(rows))]


def test_keep_one_leaves_no_near_copies(spark, no_docs):
    r = random.Random(8)
    texts = []
    for _ in range(25):
        base = [f"w{r.randrange(3000)}" for _ in range(200)]
        texts += [" ".join(base)] + [" ".join(edited(r, base, n)) for n in (1, 2, 3, 9)]
    common = [f"w{r.randrange(3000)}" for _ in range(300)]
    texts += [" ".join(edited(r, common, 2)) for _ in range(60)] + ["one two", "One  two", "", None, None]
    rows = list(enumerate(texts)) + [(500, texts[0]), (500, texts[0]), (None, texts[7]), (None, "six words that nobody else has"), (None, "six words that nobody else has")]
    docs = spark.createDataFrame([(i, t, "en", "a", 1, "x") for i, t in rows], "doc_id long, text string, lang string, source string, key long, band string")
    near = slow_components([slow_fingerprint(t) for _, t in rows])
    sets = [near_copies.shingles((t or "").encode()) for _, t in rows]
    assert any(near[i] != near[j] for i in range(len(rows)) for j in range(i) if near_copies.alike(sets[i], sets[j]))  # the fingerprints alone leave some
    got = near_copies.keep_one(docs)
    assert got.columns == docs.columns and sorted(((x.doc_id, x.text) for x in got.collect()), key=repr) == slow_keep(rows)
    assert near_copies.keep_one(no_docs).count() == 0


def test_keep_one_with_shared_and_null_ids(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (1, "v w x y z"), (2, "v w x y z"), (3, "a b c d e"), (None, "a b c d e"), (None, "p q r s t"), (None, "p q r s t"), (None, "P q r s t")]
    got = [tuple(x) for x in near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got[:2] + got[2:], key=repr)[:2] == [(1, "a b c d e"), (1, "v w x y z")] and len(got) == 3 and [i for i, _ in got].count(None) == 1


def test_keep_one_by_shuffle(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(near_copies, "BROADCAST_KEYS", 0)
    got = near_copies.keep_one(docs)
    assert sorted(((x.doc_id, x.text) for x in got.collect()), key=repr) == slow_keep([x[:2] for x in rows])


def test_candidates_among_texts_of_one_template(spark):
    """Texts that share a template, from alike to less than 0.8: every near copy is proposed, and few others are."""
    r = random.Random(2)
    template = [f"w{r.randrange(5000)}" for _ in range(300)]
    texts = [" ".join(edited(r, template, n)) for n in [1, 2, 3, 4, 5, 6, 8, 10, 12, 15] * 12]
    sets = [near_copies.shingles(t.encode()) for t in texts]
    want = {(i, j) for j in range(len(texts)) for i in range(j) if near_copies.alike(sets[i], sets[j])}
    members = spark.createDataFrame([(i, i) for i in range(len(texts))], "key long, c long")
    got = {tuple(x) for x in near_copies.unlike_pairs(members, spark.createDataFrame(list(enumerate(texts)), "key long, text string")).collect()}
    assert want and want <= got and len(got - want) < len(want) / 2 < len(texts) ** 2 / 8
    same = spark.createDataFrame([(i, 7) for i in range(len(texts))], "key long, c long")
    assert near_copies.unlike_pairs(same, spark.createDataFrame(list(enumerate(texts)), "key long, text string")).count() == 0


def test_tables_between_steps_go(spark, monkeypatch):
    """What is written while groups are sought is removed before the documents are returned."""
    from pathlib import Path

    from tabloom.sources.shared import Scratch

    kept, real = [], Scratch.keep

    def keep(self, df):
        out = real(self, df)
        kept.append(Path(self.paths[-1].removeprefix("file:")))
        return out

    monkeypatch.setattr(Scratch, "keep", keep)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*words[:20], f"own{i}", *words[21:]])) for i in range(6)] + [(9, "another text of its own kind")]
    out = near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert len(kept) > 3 and not any(p.exists() for p in kept)
    assert sorted(r[0] for r in out.select("doc_id").collect()) == [0, 9]
