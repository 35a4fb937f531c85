"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence gets a probability from a logistic model over hashed
words and word beginnings, and a document is toxic if any sentence is (noisy-or):
1 - prod(1 - p). The sentence weights are trained from document labels alone, by full-batch gradient
steps on the documents' likelihood; the sentence probabilities then locate what offends.

The model is fitted on at most ``FIT_ROWS`` labelled documents of each label (a documented bound), chosen
by a hash of doc_id; the sampled labels are weighted back to their shares among all labelled rows. Repeated rows are learnt
once, and where ids repeat or texts are very long, at most 3 * ``FIT_ROWS`` rows and ``FIT_BYTES`` of features, by hash.

Defined results: null and empty texts have no sentence and score 0. Documents with several labels count
as toxic if any label says so; null labels are ignored. Without labels of both kinds all scores are 0. Repeated rows score alike; an empty
table gives an empty result. Texts are read whole. Extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm.common import checkpoint, held_out, map_texts, row_starts, table

BITS, FIT_ROWS, FIT_BYTES, ROUNDS = 18, 2500, 256 << 20, 150
START = -7.0
#: Bytes of text that a worker scores at once.
SLICE_BYTES = 1 << 20
#: Tokens whose features or values a worker remembers before it starts afresh.
TOKENS = 150_000
_STRIP = b".,;:!?\"'()[]{}<>*#&%$-_"


def features(token: bytes) -> tuple[int, int, int, bool]:
    """Hashed word, its first four and first five letters, and whether a sentence ends with it."""
    word = token.decode("utf-8", "replace").strip(_STRIP.decode()).lower()
    end = token.rstrip(b"\"')]")[-1:] in (b".", b"!", b"?")
    if not word:
        return 0, 0, 0, end
    mask = (1 << BITS) - 1
    parts = ("=" + word, "<" + word[:4], "<<" + word[:5])
    return *(xxhash.xxh3_64_intdigest(p.encode()) & mask or 1 for p in parts), end


class Tokens(dict):
    """Token to its features; forgets all when it has grown past TOKENS."""

    def __missing__(self, token: bytes):
        if len(self) >= TOKENS:
            self.clear()
        self[token] = value = features(token)
        return value


def sentence_bounds(ends: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word of each sentence over concatenated documents, and the number of sentences of each document."""
    starts = np.concatenate([[True], ends[:-1]]) if len(ends) else np.zeros(0, bool)
    at = row_starts(counts)[:-1][counts > 0]
    starts[at] = True
    first = np.flatnonzero(starts)
    owner = np.repeat(np.arange(len(counts)), counts)
    return first, np.bincount(owner[first], minlength=len(counts)) if len(first) else np.zeros(len(counts), int)


def _bags(raw: list[bytes], _: pa.RecordBatch) -> dict:
    tokens, words, sizes = Tokens(), [], []
    for text in raw:
        x = np.array([tokens[w] for w in text.split()], np.int64).reshape(-1, 4)
        first, _ = sentence_bounds(x[:, 3].astype(bool), np.array([len(x)]))
        words.append(zlib.compress(np.ascontiguousarray(x[:, :3]).astype(np.uint32).tobytes(), 1))
        sizes.append(np.diff(np.append(first, len(x))).astype(np.uint32).tobytes())
    return {"words": words, "sizes": sizes}


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, rounds: int = ROUNDS) -> np.ndarray:
    """Weights of the sentence model; the bias is the last."""
    known = labels.filter("toxic is not null and doc_id is not null").filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    sizes = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    weights = np.zeros((1 << BITS) + 1)
    weights[-1] = -1e9
    if len(sizes) < 2:
        return weights
    u = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    cut = {k: min(1.0, fit_rows / n) for k, n in sizes.items()}
    picked = known.filter(u < F.when(F.col("toxic") == 1, cut[1]).otherwise(cut[0]))
    # about 2 * fit_rows ids by the filter above
    sample = docs.select("doc_id", "text").join(F.broadcast(picked.withColumnRenamed("doc_id", "id_")), F.col("doc_id") == F.col("id_"))
    made = map_texts(sample, ["doc_id", "toxic"], "words binary, sizes binary", lambda: _bags).dropDuplicates(["doc_id", "words"])
    made = checkpoint(made.withColumn("o_", F.xxhash64("doc_id", "words")))
    # however often ids repeat and however long texts are: rows and bytes that reach the driver are bounded
    held = made.select("o_", F.length("words")).orderBy("o_").limit(3 * fit_rows).collect()
    inside = np.cumsum([n for _, n in held]) <= FIT_BYTES
    last = max((o for (o, _), fits in zip(held, inside) if fits), default=None)
    found = [] if last is None else made.filter(F.col("o_") <= last).select("doc_id", "toxic", "words", "sizes").collect()
    rows = sorted((r[0], r[1], bytes(r[2]), bytes(r[3])) for r in found)
    bags = [(y, np.frombuffer(zlib.decompress(w), np.uint32).reshape(-1, 3), np.frombuffer(s, np.uint32)) for _, y, w, s in rows if s]
    return train(bags, {k: 1 / c for k, c in cut.items()}, rounds)


def train(bags: list[tuple[int, np.ndarray, np.ndarray]], importance: dict[int, float], rounds: int = ROUNDS) -> np.ndarray:
    """Adam on the noisy-or likelihood of the bags (label, features of each word, words of each sentence)."""
    weights = np.zeros((1 << BITS) + 1)
    weights[-1] = START
    if not bags:
        return weights
    y = np.array([b[0] for b in bags], float)
    # features of fewer than three documents, or no commoner in toxic ones, stay at zero
    held = {k: np.zeros(1 << BITS) for k in (0, 1)}
    for label, x, _ in bags:
        held[int(label > 0)][np.unique(x)] += 1
    p, n = max(1, y.sum()), max(1, (1 - y).sum())
    usable = (held[0] + held[1] >= 3) & ((held[1] + 0.1) / p > 1.5 * (held[0] + 0.1) / n)
    usable[0] = False
    rows, cols, at = [], [], 0
    for _, x, sizes in bags:
        keep = usable[x]
        rows.append((np.repeat(np.arange(at, at + len(sizes)), sizes)[:, None] * np.ones(3, np.int64))[keep].astype(np.int32))
        cols.append(x[keep])
        at += len(sizes)
    row, col = np.concatenate(rows), np.concatenate(cols)
    words = np.zeros(at)
    doc = np.repeat(np.arange(len(bags)), [len(b[2]) for b in bags])
    names, col = np.unique(col, return_inverse=True)
    w, b = np.zeros(len(names)), START
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    c = np.where(y > 0, importance.get(1, 1), importance.get(0, 1))
    c = c / c.mean()
    for step in range(1, rounds + 1):
        z = b + np.bincount(row, w[col], len(words))
        prob = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        log_clean = np.bincount(doc, -np.logaddexp(0, z), len(bags))
        q = np.exp(log_clean)
        slope = np.where(y > 0, -q / np.maximum(1 - q, 1e-9), 1.0) * c
        g = slope[doc] * prob
        grad = np.append(np.bincount(col, g[row], len(names)) + 0.05 * w, g.sum()) / len(bags)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        move = 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    weights[names], weights[-1] = w, b
    return weights


def score_texts(docs: DataFrame, weights: np.ndarray, keep: list[str]) -> DataFrame:
    """`keep` columns with ``score``, ``predicted``, ``n_sentences``, and ``offending``: [first word, end word) of each
    sentence of probability 0.5 or more, with that probability."""
    at = np.flatnonzero(weights)
    shared = docs.sparkSession.sparkContext.broadcast((at, weights[at]))

    def kernel():
        w = np.zeros((1 << BITS) + 1)
        w[shared.value[0]] = shared.value[1]
        class Values(dict):  # real: what a token adds to a sentence; imaginary: 1 if it ends one
            def __missing__(self, token: bytes) -> complex:
                if len(self) >= TOKENS:
                    self.clear()
                a, b, c, end = features(token)
                self[token] = out = complex(w[a] + w[b] + w[c], end)
                return out

        value = Values().__getitem__

        def judge(raw: list[bytes], _: pa.RecordBatch) -> dict:
            per_token, counts = [], []
            for text in raw:
                words = text.split()
                counts.append(len(words))
                per_token.append(np.fromiter(map(value, words), complex, len(words)))
            x, counts = np.concatenate(per_token), np.array(counts)
            first, n = sentence_bounds(x.imag > 0, counts)
            if not len(first):
                return {"score": np.zeros(len(raw)), "predicted": np.zeros(len(raw), np.int32), "n_sentences": n, "offending": [[]] * len(raw)}
            z = np.add.reduceat(x.real, first) + w[-1]
            doc = np.repeat(np.arange(len(raw)), n)
            score = -np.expm1(np.bincount(doc, -np.logaddexp(0, z), len(raw)))
            offending = [[] for _ in raw]
            begin, stop = row_starts(counts), np.append(first[1:], len(x))
            for s in np.flatnonzero(z >= 0):
                d = doc[s]
                offending[d].append({"first": int(first[s] - begin[d]), "end": int(stop[s] - begin[d]), "p": float(1 / (1 + np.exp(-z[s])))})
            return {"score": score, "predicted": (score >= 0.5).astype(np.int32), "n_sentences": n, "offending": offending}

        return judge

    return map_texts(docs, keep, "score double, predicted int, n_sentences long, offending array<struct<first:long,end:long,p:double>>", kernel, most=SLICE_BYTES)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score_texts(docs, fit(docs, labels), ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_sentences", F.size("offending").cast("long").alias("n_offending"))


def without_toxic(docs: DataFrame, labels: DataFrame, at: float = 0.5) -> DataFrame:
    """`docs` without the rows that score `at` or more; same columns."""
    weights = fit(docs, labels)
    names = {c: f"kept_{i}_" for i, c in enumerate(docs.columns)}
    marked = docs.withColumnsRenamed(names).withColumn("text", F.col(names["text"]))
    return score_texts(marked, weights, list(names.values())).filter(F.col("score") < at).select(*[F.col(n).alias(c) for c, n in names.items()])
