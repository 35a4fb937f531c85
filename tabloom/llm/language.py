"""Language identification by nearest centroid.

Texts become normalised TF-IDF vectors of hashed byte trigrams (letters in lower case, all else as
space). Each language is clustered (spherical k-means) into a few centroids; the language of the nearest
centroid by cosine is predicted. A text farther from it than nearly all training texts of that language
is flagged as rejected.

Document frequencies cover every learnable document; centroids are fitted on at most ``FIT_ROWS``
texts of each language (a documented bound), chosen by a hash of doc_id and text (repeated rows count once), one task a language. The model is
languages x ``CENTROIDS`` x ``DIMS`` numbers; more than ``MAX_LANGUAGES`` languages are an error.

Defined results: null texts and texts without a letter give ``und``, score 0, rejected; without any learnable
row every text does. An empty table gives an empty result. Rows that repeat are judged alike, ties go to the first language by name. Texts are
read whole, in slices. Extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm.common import held_out, map_texts, table, text_slices

DIMS, CENTROIDS, FIT_ROWS, MAX_LANGUAGES = 4096, 4, 1000, 500
#: Share of training texts that lie nearer to their centroid than the rejection limit.
INSIDE = 0.995
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(raw: bytes) -> bool:
    return bool(_LETTER.search(raw)) or any(c.isalpha() for c in raw.decode("utf-8", "ignore"))


def term_counts(texts: list[bytes]) -> np.ndarray:
    """(texts x DIMS) counts of hashed trigrams; trigrams with two spaces or more are left out."""
    joined = b"  ".join(b" " + t.translate(_PLAIN) + b" " for t in texts) + b"  "
    x = np.frombuffer(joined, np.uint8)
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), [len(t) + 4 for t in texts])[: len(x) - 2]
    space = x == 32
    ok = (space[:-2].astype(np.int8) + space[1:-1] + space[2:]) < 2
    y = x.astype(np.uint32)
    gram = (y[:-2] << 16) | (y[1:-1] << 8) | y[2:]
    gram = (gram * np.uint32(2654435761)) >> np.uint32(32 - int(np.log2(DIMS)))
    return np.bincount(owner[: len(gram)][ok] * DIMS + gram[ok], minlength=len(texts) * DIMS).reshape(len(texts), DIMS)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts, dtype=np.float32) * idf.astype(np.float32)
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.maximum(norm, 1e-12)


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts from rows spread over the data, so reruns agree."""
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        for j in range(len(c)):
            if (near == j).any():
                m = x[near == j].mean(0)
                c[j] = m / max(np.linalg.norm(m), 1e-12)
    return c


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS) -> dict:
    """Model from the documents that may be learnt from and have a language."""
    learn = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    sizes = {r[0]: r[1] for r in learn.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return {"langs": [], "idf": np.ones(DIMS), "centroids": np.zeros((0, DIMS), np.float32), "owner": [], "limit": []}

    def frequencies(batches):
        total, n = np.zeros(DIMS, np.int64), 0
        for batch in batches:
            for _, _, raw in text_slices(batch.column(0)):
                for a in range(0, len(raw), 1024):
                    total += (term_counts(raw[a : a + 1024]) > 0).sum(0)
                n += len(raw)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMS + 1, dtype=np.int32)), pa.array(np.append(total, n))], names=["dim", "df"])

    df = np.zeros(DIMS + 1)
    for r in learn.select("text").mapInArrow(frequencies, "dim int, df long").groupBy("dim").agg(F.sum("df").alias("df")).collect():
        df[r[0]] = r[1]
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    u = F.pmod(F.xxhash64("doc_id", "text", F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, fit_rows / n))])
    picked = map_texts(learn.filter(u < share[F.col("lang")]), ["lang"], "at binary, n binary", lambda: _sparse).dropDuplicates()  # repeated rows count once

    def clustered(t: pa.Table) -> pa.Table:  # the sampled texts of one language
        counts = np.zeros((t.num_rows, DIMS), np.int32)
        for row, (at, n) in zip(counts, sorted(zip(t.column("at").to_pylist(), t.column("n").to_pylist()))):
            row[np.frombuffer(at, np.uint16)] = np.frombuffer(n, np.int32)
        x = vectors(counts, idf)
        x = x[x.any(1)]
        c = cluster(x, CENTROIDS) if len(x) else x
        limit = float(np.quantile((x @ c.T).max(1), 1 - INSIDE)) if len(c) else 0.0
        return pa.table({"lang": pa.array([t.column("lang")[0].as_py()] * len(c), pa.string()), "centroid": pa.array([r.astype(np.float32).tobytes() for r in c], pa.binary()), "limit": pa.array([limit] * len(c), pa.float64())})

    fitted = picked.groupBy("lang").applyInArrow(clustered, "lang string, centroid binary, limit double").collect()
    langs = sorted({r[0] for r in fitted})
    rows = sorted((langs.index(r[0]), bytes(r[1]), r[2]) for r in fitted)
    limits = {r[0]: r[2] for r in rows}
    centroids = np.array([np.frombuffer(r[1], np.float32) for r in rows]).reshape(-1, DIMS)
    return {"langs": langs, "idf": idf, "centroids": centroids, "owner": [r[0] for r in rows], "limit": [limits[i] for i in range(len(langs))]}


def _sparse(raw: list[bytes], _: pa.RecordBatch) -> dict:
    at, n = [], []
    for a in range(0, len(raw), 1024):
        for row in term_counts(raw[a : a + 1024]):
            nz = np.flatnonzero(row)
            at.append(nz.astype(np.uint16).tobytes())
            n.append(row[nz].astype(np.int32).tobytes())
    return {"at": at, "n": n}


def identify(docs: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """`keep` columns with ``lang_pred``, ``score`` (cosine to the nearest centroid) and ``rejected``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kernel():
        m = shared.value
        owner, limit = np.array(m["owner"], int), np.array(m["limit"])

        def judge(raw: list[bytes], _: pa.RecordBatch) -> dict:
            lang, score, rejected = ["und"] * len(raw), np.zeros(len(raw)), np.ones(len(raw), bool)
            for a in range(0, len(raw), 1024):
                part = raw[a : a + 1024]
                if not len(owner):
                    break
                cos = vectors(term_counts(part), m["idf"]) @ m["centroids"].T
                best = cos.argmax(1)
                for i, t in enumerate(part):
                    if has_letter(t):
                        who, c = owner[best[i]], float(cos[i, best[i]])
                        lang[a + i], score[a + i], rejected[a + i] = m["langs"][who], min(1.0, max(0.0, c)), c < limit[who]
            return {"lang_pred": lang, "score": score, "rejected": rejected}

        return judge

    return map_texts(docs, keep, "lang_pred string, score double, rejected boolean", kernel)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs), ["doc_id"]).withColumn("held_out", held_out(F.col("doc_id")))
