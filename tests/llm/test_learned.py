"""Learned operators: held-out accuracy and defined results."""

import random

from tabloom.llm import language, toxicity

GOOD = ["river", "stone", "window", "garden", "letter", "summer", "bread", "music", "paper", "market", "winter", "lamp"]
BAD = ["vilefool", "nastyrat", "scumhead"]


def labelled(spark, n=400):
    r = random.Random(3)
    docs, labels = [], []
    for i in range(n):
        sentences = [" ".join(r.choice(GOOD) for _ in range(r.randint(3, 9))) + "." for _ in range(r.randint(1, 10))]
        toxic = i % 5 == 0
        if toxic:
            at = r.randrange(len(sentences))
            sentences[at] = f"You {r.choice(BAD)} {r.choice(GOOD)}!"
        docs.append((i, " ".join(sentences), "en", "x", int(toxic)))
        labels.append((i, 1, int(toxic)))
    labels += [(None, 0, 1), (3, 0, None), (7, 0, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, truth int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark, docs, no_docs):
    data, labels = labelled(spark)
    weights = toxicity.fit(data, labels)
    got = toxicity.score_texts(data, weights, ["doc_id", "text", "truth"]).collect()
    assert sum((r.score >= 0.5) == bool(r.truth) for r in got) >= 0.98 * len(got)
    for r in got:
        if r.truth and r.offending:
            words = r.text.split()
            assert any(b in " ".join(words[s["first"] : s["end"]]) for s in r.offending for b in BAD)
    odd = toxicity.score_texts(docs, weights, ["doc_id", "text", "score"]).collect()
    assert all(0 <= r.score <= 1 and (r.text and r.text.split() or r.score == 0) for r in odd)
    assert len({r.score for r in odd if r.doc_id == 10}) == 1
    assert toxicity.score_texts(no_docs, weights, ["doc_id"]).count() == 0
    kept = toxicity.without_toxic(data.withColumnRenamed("truth", "score"), labels)
    assert kept.columns == [*data.columns[:-1], "score"] and abs(kept.count() - 320) < 10


def test_toxicity_without_labels(spark, docs):
    _, labels = labelled(spark, 5)
    weights = toxicity.fit(docs, labels.limit(0))
    assert {r.score for r in toxicity.score_texts(docs, weights, ["doc_id"]).collect()} == {0.0}


def test_language(spark, docs, no_docs):
    r = random.Random(1)
    parts = {"aa": ["tion", "the", "ing", "and"], "bb": ["eaux", "que", "ment", "le"], "cc": ["ung", "sch", "ich", "der"]}
    rows = [(i, " ".join("".join(r.choice(parts[k]) for _ in range(2)) for _ in range(25)), k, "s") for i in range(300) for k in [list(parts)[i % 3]]]
    rows += [(1000, None, "aa", "s"), (1001, "123 ...", "bb", "s"), (1002, "ééé", None, "s"), (1003, "", "cc", "s"), (None, "the and tion", "aa", "s")]
    data = spark.createDataFrame(rows, "doc_id long, text string, lang string, rejected string")
    m = language.fit(data)
    got = language.identify(data, m, ["doc_id", "lang", "text"]).collect()
    assert all(g.lang == g.lang_pred for g in got if g.doc_id is not None and g.doc_id < 300)
    for g in got:
        assert 0 <= g.score <= 1 and (g.lang_pred == "und") == (not language.has_letter((g.text or "").encode()))
    assert language.identify(no_docs, m, ["doc_id"]).count() == 0
    assert {g.lang_pred for g in language.identify(docs, language.fit(no_docs), ["doc_id"]).collect()} == {"und"}


def test_the_sample_is_bounded_however_ids_repeat(spark, monkeypatch):
    from tabloom.llm import language, toxicity

    data, labels = labelled(spark)
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda bags, *_: seen.append(len(bags)))
    toxicity.fit(data.unionByName(data), labels)
    toxicity.fit(data, labels)
    assert seen[0] == seen[1] > 0  # repeated rows are learnt once
    same = data.withColumn("doc_id", data.doc_id % 4)  # many texts of one id
    ids = spark.createDataFrame([(0, 0), (1, 1), (2, 0), (3, 1)], "doc_id long, toxic int")
    toxicity.fit(same, ids, fit_rows=10)
    monkeypatch.setattr(toxicity, "FIT_BYTES", 2000)
    toxicity.fit(data, labels)
    assert 0 < seen[2] <= 30 and 0 < seen[3] < seen[1]
    null = data.withColumn("doc_id", data.doc_id * None)
    assert language.fit(null.unionByName(null), 50)["langs"] == language.fit(null, 50)["langs"]
