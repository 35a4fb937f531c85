"""Benchmark decontamination by winnowing.

Words are lower-cased runs of ASCII letters, digits and all non-ASCII characters. Of every ``WINDOW - GRAM + 1``
consecutive word ``GRAM``-grams the one with the smallest hash is kept, in documents and in benchmark items alike,
so two texts that share ``WINDOW`` words share a kept fingerprint. Fingerprint hits are extended: each window of
``WINDOW`` words around a hit is looked up word for word, and the words of an occurring window are hit. An
item of fewer words is one window of its own length and has one fingerprint.

The documents are scanned where they lie, without a shuffle; the items' fingerprints and windows are broadcast as arrays. That
is bounded: items are taken in slices of at most ``SLICE_BYTES`` of text, one after another, and more slices mean more passes.

Defined results: null texts have no words; null and wordless items have no window; items that share an id are
one item, a null id is ``null``; repeated documents are judged alike; an empty benchmark hits nothing; an empty table gives an empty result. Texts are read
whole. Extra columns are untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm.common import WordHashes, checkpoint, map_texts, rolling, row_starts, sliding_min, table

WINDOW, GRAM, FACTOR = 10, 5, 0x9E3779B97F4A7C15
SLICE_BYTES = 8 << 20
#: Bytes of document text that a worker takes at once.
KERNEL = 1 << 20
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


def winnowed(h: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the kept grams of a sequence of word hashes."""
    grams, width = rolling(h, gram, FACTOR), window - gram + 1
    if len(grams) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least, kept = sliding_min(grams, width), np.zeros(len(grams), bool)
    for o in range(width):
        kept[o : o + len(least)] |= grams[o : o + len(least)] == least
    at = np.flatnonzero(kept)
    return at, grams[at]


class Index:
    """Fingerprints and windows of benchmark items, as arrays over the items' words in one string of bytes."""

    def __init__(self, items: list[tuple[str, bytes]]):
        hashes = WordHashes()
        texts, sizes, parts, begin = [], [], {}, 0
        self.names = []
        for name, text in items:
            words = words_of(text)
            if not words:
                continue
            n, h = min(WINDOW, len(words)), hashes.array(words)
            windows, prints = rolling(h, n, FACTOR), winnowed(h, GRAM, WINDOW)[1] if n == WINDOW else rolling(h, n, FACTOR)
            parts.setdefault(n, []).append((prints, windows, np.arange(begin, begin + len(windows)), np.full(len(windows), len(self.names))))
            self.names.append(name)
            texts += words
            sizes.append(np.fromiter(map(len, words), np.int64, len(words)))
            begin += len(words)
        self.flat = b" ".join(texts)
        ends = np.cumsum(np.concatenate([np.zeros(0, np.int64), *sizes]) + 1)
        self.starts, self.ends = np.concatenate([[0], ends])[:-1], ends - 1
        self.prints, self.windows = {}, {}
        for n, found in parts.items():
            prints, windows, at, item = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((item, windows))
            self.prints[n], self.windows[n] = np.unique(prints), (windows[order], at[order], item[order])
        self.told: dict[tuple[int, int], dict[bytes, set[str]]] = {}

    def items_of(self, n: int, window: np.uint64, words: bytes) -> set[str]:
        """Items that hold these n words, of which `window` is the hash."""
        key = (n, int(window))
        if key not in self.told:
            if len(self.told) >= 1 << 16:
                self.told.clear()
            hashes, at, item = self.windows[n]
            same: dict[bytes, set[str]] = {}
            for k in range(int(np.searchsorted(hashes, window, "left")), int(np.searchsorted(hashes, window, "right"))):
                same.setdefault(self.flat[self.starts[at[k]] : self.ends[at[k] + n - 1]], set()).add(self.names[item[k]])
            self.told[key] = same
        return self.told[key].get(words, set())

    def hits(self, texts: list[bytes], hashes: WordHashes) -> Iterator[tuple[int, np.ndarray, set[str]]]:
        """For each text: its number of words, which of them are hit, and the items that occur."""
        split = [words_of(t) for t in texts]
        counts = np.array([len(w) for w in split], np.int64)
        words = [w for s in split for w in s]
        h, begin = hashes.array(words), row_starts(counts)
        hit, items = np.zeros(len(words), bool), [set() for _ in texts]
        for n, prints in self.prints.items():
            if n == WINDOW:
                at, kept = winnowed(h, GRAM, WINDOW)
                at = at[_member(kept, prints)]
                starts = np.unique((at[:, None] - np.arange(WINDOW - GRAM + 1)[None, :]).ravel()) if len(at) else at
            else:
                starts = np.flatnonzero(_member(rolling(h, n, FACTOR), prints))
            starts = starts[(starts >= 0) & (starts + n <= len(words))]
            if not len(starts):
                continue
            doc = np.searchsorted(begin, starts, "right") - 1
            inside = starts + n <= begin[doc + 1]
            starts, doc = starts[inside], doc[inside]
            window = rolling(h, n, FACTOR)[starts]
            sure = _member(window, self.windows[n][0])
            for s, d, x in zip(starts[sure].tolist(), doc[sure].tolist(), window[sure]):
                if names := self.items_of(n, x, b" ".join(words[s : s + n])):
                    hit[s : s + n] = True
                    items[d] |= names
        for i in range(len(texts)):
            yield int(counts[i]), hit[begin[i] : begin[i + 1]], items[i]


def _member(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.searchsorted(known, x)
    return known[np.minimum(at, len(known) - 1)] == x


def benchmark_slices(benchmark: DataFrame, most: int = SLICE_BYTES) -> Iterator[list[tuple[str, bytes]]]:
    """Items in slices of at most `most` bytes of text (at least one item); one slice is on the driver at a time."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text").filter("text is not null")
    held, size = [], 0
    for r in items.orderBy("item", "text").toLocalIterator():
        text = r[1].encode()
        if held and size + len(text) > most:
            yield held
            held, size = [], 0
        held.append((r[0], text))
        size += len(text)
    if held:
        yield held


def contamination(docs: DataFrame, benchmark: DataFrame, keep: list[str], most: int = SLICE_BYTES) -> DataFrame:
    """`keep` columns with ``n_words``, ``n_hit``, ``hit_words`` (a bit for each word) and ``items`` (ids as strings, sorted)."""
    share, parts = docs.sparkSession.sparkContext.broadcast, benchmark_slices(benchmark, most)
    first, more = share(Index(next(parts, []))), next(parts, None)
    if more is None:
        return map_texts(docs, keep, _ADDED, _kernel(first), most=KERNEL)
    # each further slice is a pass of its own over the rows with what they have so far
    kept = keep if "text" in keep else [*keep, "text"]
    rows = checkpoint(map_texts(docs, kept, _ADDED, _kernel(first), most=KERNEL))
    first.destroy()
    while more is not None:
        before = rows.drop("n_words", "n_hit").withColumnsRenamed({"hit_words": "hit_before_", "items": "items_before_"})
        now = share(Index(more))
        rows = checkpoint(map_texts(before, [*kept, "hit_before_", "items_before_"], _ADDED, _kernel(now), most=KERNEL).drop("hit_before_", "items_before_"))
        now.destroy()
        more = next(parts, None)
    return rows.select(*keep, "n_words", "n_hit", "hit_words", "items")


_ADDED = "n_words long, n_hit long, hit_words binary, items array<string>"


def _kernel(shared):
    def kernel():
        index, hashes = shared.value, WordHashes()  # a worker reads the index once

        def judge(raw: list[bytes], rows: pa.RecordBatch) -> dict:
            out = {"n_words": [], "n_hit": [], "hit_words": [], "items": []}
            before = [rows.column(c).to_pylist() for c in ("hit_before_", "items_before_")] if "hit_before_" in rows.schema.names else None
            for i, (n, hit, items) in enumerate(index.hits(raw, hashes)):
                if before:
                    hit = hit | np.unpackbits(np.frombuffer(before[0][i], np.uint8), count=n).astype(bool)
                    items = items | set(before[1][i])
                for k, v in (("n_words", n), ("n_hit", int(hit.sum())), ("hit_words", np.packbits(hit).tobytes()), ("items", sorted(items))):
                    out[k].append(v)
            return out

        return judge

    return kernel


def without_hits(docs: DataFrame, benchmark: DataFrame, least: int = 1) -> DataFrame:
    """`docs` without the rows that hold a benchmark window; same columns. Items of fewer than `least` words condemn no document."""
    if least > 1:
        benchmark = benchmark.filter(F.regexp_count("text", F.lit("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")) >= least)
    names = {c: f"kept_{i}_" for i, c in enumerate(docs.columns)}
    marked = docs.withColumnsRenamed(names).withColumn("text", F.col(names["text"]))
    found = contamination(marked, benchmark, list(names.values()))
    return found.filter("n_hit = 0").select(*[F.col(n).alias(c) for c, n in names.items()])


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that an occurring benchmark window covers, and the items."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    items = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items, (F.col("n_hit") > 0).alias("contaminated"))


def oracle() -> str:
    """Windows are compared as lists of words; at most WINDOW words long."""
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
    WITH d AS (SELECT doc_id, {words} AS w FROM documents),
    b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {words} AS w FROM benchmark),
    sizes AS (SELECT DISTINCT least(len(w), {WINDOW}) AS n FROM b WHERE len(w) > 0),
    bw AS (SELECT DISTINCT item, array_to_string(w[i : i + least(len(w), {WINDOW}) - 1], ' ') AS gram
           FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i FROM b WHERE len(w) > 0)),
    dw AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS gram
           FROM (SELECT doc_id, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS i FROM d, sizes WHERE len(w) >= n)),
    hits AS (SELECT doc_id, i, n, item FROM dw JOIN bw USING (gram)),
    covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
    named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
    SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
    """
