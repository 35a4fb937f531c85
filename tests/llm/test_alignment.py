import hashlib
import json
from collections import defaultdict

import pytest
import sentencepiece
from tokenizers import Tokenizer

from tabloom.llm import alignment

A, B = (f"{alignment.TOKENIZERS}/{x}" for x in (alignment.BYTE_BPE, alignment.PIECE_BPE))


@pytest.fixture(scope="module")
def libraries():
    own = Tokenizer.from_file(A)
    own.encode_special_tokens = True
    return own, sentencepiece.SentencePieceProcessor(model_file=B)


def tokens(libraries, text):
    """[(id, bytes)] of both tokenizers, by their own libraries and one by one."""
    own, model = libraries
    letters = alignment.byte_of_letter()
    a = [(i, bytes(letters[c] for c in own.id_to_token(i))) for i in own.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in model.encode(text):
        p = model.id_to_piece(i)
        b.append((i, bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode()))
    return a, b


def expected(libraries, texts):
    found, held = [], defaultdict(set)
    for k, text in enumerate(texts):
        a, b = tokens(libraries, text) if text else ([], [])
        raw = (" " + text).encode() if text else b""
        if b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
            a, b = [], []
        spans = []
        for t in (a, b):
            at, out = 0, []
            for i, x in t:
                out.append((i, at, at + len(x)))
                at += len(x)
            spans.append(out)
        links = [(i, j) for i, s, e in spans[0] for j, s2, e2 in spans[1] if s < e2 and s2 < e]
        cuts = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
        groups, start = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(i) for i, s, e in t if start <= s and e <= c) for t in spans))
            start = c
        found.append((len(a), len(b), groups, links))
        for pair in set(links):
            held[pair].add(k)
    best = defaultdict(int)
    for (i, _), d in held.items():
        best[i] = max(best[i], len(d))
    return [(a, b, len(g), len(ls), sum(len(held[p]) == best[p[0]] for p in ls), sum(len(held[p]) for p in ls), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for a, b, g, ls in found]


TEXTS = ["Hello world, naïve  café", "Hello world", "  two  blanks ", "   ", " ", "tab\tand\nline \n", "日本語 \U0001f600 é́", "a▁b", "<s> </s> <unk> <0x41> <|endoftext|>", "\x00 \x85  ", "x" * 700, "don't we'll they've", "", None, "Hello world", "9" * 400 + "  "]


def result(df):
    return sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


def test_against_every_pair_of_tokens(spark, libraries, rows, monkeypatch):
    texts = TEXTS + [x[1] if not x[1] or len(x[1]) < 3000 else x[1][:3000] for x in rows]
    want = sorted((str(k), *x) for k, x in enumerate(expected(libraries, texts)))
    docs = spark.createDataFrame([(k, t, 1, "p", 2) for k, t in enumerate(texts)], "doc_id long, text string, n_a int, pair string, batch int").repartition(3)
    assert result(alignment.aligned(docs)) == want
    monkeypatch.setattr(alignment, "BATCH_BYTES", 4000)  # many batches
    assert result(alignment.aligned(docs)) == want


def test_rows_without_or_of_one_id_are_documents_of_their_own(spark, libraries):
    texts = ["one two", "one two", "three", "three one"]
    want = expected(libraries, texts)
    docs = spark.createDataFrame([(i, t) for i, t in zip([None, None, 7, 7], texts)], "doc_id long, text string")
    assert result(alignment.aligned(docs)) == sorted((str(i), *x) for i, x in zip([None, None, 7, 7], want))


def test_empty_table(spark, no_docs):
    assert alignment.aligned(no_docs).count() == 0


def test_long_texts_are_cut_at_blanks_without_effect(libraries):
    encode, _ = alignment.piece_encoder(B)
    words = [w for x in TEXTS if x for w in x.split(" ")]
    text = "".join(w + " " * (1 + k % 4) for k, w in enumerate(words * 3000))
    ids, counts = encode([" " + text, " ", " a" + " " * 200_000, " " + "x" * 200_000])
    want = [libraries[1].encode(x) for x in (text, "", "a" + " " * 200_000, "x" * 200_000)]
    assert counts.tolist() == list(map(len, want)) and ids.tolist() == [i for x in want for i in x]


def test_other_vocabularies_are_encoded_by_their_own_library(tmp_path, libraries):
    model = json.loads(open(A, encoding="utf-8").read())
    model["model"]["merges"] = model["model"]["merges"][:2000]
    path = tmp_path / "other.json"
    path.write_text(json.dumps(model), encoding="utf-8")
    own = Tokenizer.from_file(str(path))
    own.encode_special_tokens = True
    ids, counts = alignment.byte_encoder(str(path))[0](TEXTS[:12])
    assert ids.tolist() == [i for x in TEXTS[:12] for i in own.encode(x, add_special_tokens=False).ids]
