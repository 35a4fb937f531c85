"""Near duplicates of a corpus: op9's components, then texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Fingerprints within 2 bits find few texts of that similarity (most differ in 4 to 11 bits), and vantage points prune
nothing at such a radius, as unrelated texts lie 32 bits apart give or take 4. So the rest is found from MinHash bands. Candidates share one of ``BANDS`` band keys of ``ROWS`` MinHash values each (a pair at 0.8 is missed with probability
5e-5, a closer one less often); a candidate counts only if the similarity of the real shingles confirms it. Buckets are
first searched from pivots, one pair for each text and round, so that a large group of near copies becomes one component
without its pairs being listed. Buckets that still hold several components (texts of one template, alike but less than 0.8, share many) are not paired: their texts are joined on the rarest of
their shingles, with filters of length and position in the join's condition (`unlike_pairs`), which is exact for these texts and proposes few pairs that are not near copies.

Defined results: words are those of `bytes.split`, ASCII case ignored; a text of fewer than five words has its whole
sequence as the only shingle; null and empty texts are no near copies here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm import simhash
from tabloom.llm.common import WordHashes, checkpoint, map_texts, mix, rolling
from tabloom.llm.components import stars
from tabloom.sources.shared import Scratch

SHINGLE, BANDS, ROWS, PIVOTS, FACTOR = 5, 25, 5, 2, 0x9E3779B97F4A7C15
#: Bytes of text that a worker sketches at once.
SLICE_BYTES = 1 << 20
#: Longs of parities of a text's shingles.
PARITY = 8
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _sketcher():
    known = WordHashes(7)
    odd = np.random.default_rng(11).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)

    def sketch(texts: list[bytes], _) -> dict:
        grams, at, owners, size = [], [], [], 0
        for i, text in enumerate(texts):
            words = text.translate(_LOWER).split()
            if words:
                grams.append(rolling(known.array(words), min(SHINGLE, len(words)), FACTOR))
                at.append(size)
                owners.append(i)
                size += len(grams[-1])
        out: list = [None] * len(texts)
        if owners:
            x = mix(np.concatenate(grams))
            keys = np.zeros((len(owners), BANDS), np.uint64)
            for k, m in enumerate(odd):
                keys[:, k // ROWS] = mix(keys[:, k // ROWS] ^ np.minimum.reduceat(x * m, at)) + np.uint64(k)
            for i, row in zip(owners, keys.view(np.int64)):
                out[i] = row
        return {"bands": out}

    return sketch


def shingles(text: bytes) -> set[bytes]:
    words = text.translate(_LOWER).split()
    return {b" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))} if words else set()


def alike(a: set[bytes], b: set[bytes]) -> bool:
    both = len(a & b)
    return both > 0 and 5 * both >= 4 * (len(a) + len(b) - both)


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of text keys whose shingles are alike."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, last = set(), None
            keep = np.zeros(batch.num_rows, bool)
            a, left, right = batch.column(0).to_pylist(), batch.column(2), batch.column(3)
            for i in range(batch.num_rows):
                if a[i] != last:
                    held, last = shingles(left[i].as_py().encode()), a[i]
                keep[i] = alike(held, shingles(right[i].as_py().encode()))
            yield batch.select([0, 1]).filter(pa.array(keep))

    both = pairs.join(texts.withColumnsRenamed({"key": "a", "text": "text_a"}).hint("merge"), "a")
    both = both.join(texts.withColumnsRenamed({"key": "b", "text": "text_b"}).hint("merge"), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(confirm, "a long, b long")


#: Keys that may be broadcast (16 bytes each).
BROADCAST_KEYS = 1_000_000


def _small(keys: DataFrame) -> DataFrame:
    """Checkpointed keys, broadcast if there are few; else they are joined by a shuffle."""
    keys = checkpoint(keys)
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys.hint("merge")


def copy_links(entries: DataFrame, keyed: DataFrame) -> DataFrame:
    """(node, root) of text keys in components of near copies, but for the roots.

    `entries`: (key, band) of the texts that take part; `keyed`: (key, text), from which the candidates' texts are read."""
    first, scratch = Scratch(keyed.sparkSession), Scratch(keyed.sparkSession)
    entries = first.keep(entries)
    shared = entries.groupBy("band").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).filter("lo <> hi").select("band")
    members = scratch.keep(entries.join(shared.hint("merge"), "band").distinct())
    first.drop()
    texts = scratch.keep(keyed.join(_small(members.select("key").distinct()), "key").dropDuplicates(["key"]))
    edges = keyed.sparkSession.createDataFrame([], "a long, b long")
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for turn in range(PIVOTS + 1):
        own = members.join(found.withColumnRenamed("node", "key").hint("merge"), "key", "left").select("band", "key", F.coalesce("root", "key").alias("c"))
        now = Scratch(keyed.sparkSession)  # goes with the turn
        own = now.keep(own)
        mixed = own.groupBy("band").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min(F.struct(F.xxhash64(F.lit(turn), "key").alias("h"), F.col("key").alias("other"), F.col("c").alias("d"))).alias("p"))
        mixed = mixed.filter("lo <> hi").select("band", "p.*")
        if turn < PIVOTS:
            pairs = own.join(mixed.hint("merge"), "band").filter("c <> d").groupBy("key").agg(F.min(F.struct("h", "other")).alias("p")).select(F.least("key", "p.other").alias("a"), F.greatest("key", "p.other").alias("b")).distinct()
        else:
            open_ = now.keep(own.join(mixed.select("band").hint("merge"), "band").select("key", "c").distinct())
            pairs = unlike_pairs(open_, texts, now.keep)
        pairs = checkpoint(pairs)
        if pairs.isEmpty():
            now.drop()
            break
        edges = checkpoint(edges.unionByName(_confirmed(pairs, texts)))
        now.drop()
        found = stars(edges)
    scratch.drop()
    return found


def _hashed_shingles():
    known = WordHashes(7)

    def distinct(texts: list[bytes], _) -> dict:
        out, parity = [], []
        for text in texts:
            words = text.translate(_LOWER).split()
            grams = np.unique(mix(rolling(known.array(words), min(SHINGLE, len(words)), FACTOR))) if words else np.zeros(0, np.uint64)
            out.append(grams.view(np.int64))
            odd = np.bincount((grams >> np.uint64(40) & np.uint64(64 * PARITY - 1)).astype(np.int64), minlength=64 * PARITY) & 1
            parity.append(np.packbits(odd.astype(bool)).view(np.int64))
        return {"grams": out, "parity": parity}

    return distinct


def unlike_pairs(members: DataFrame, texts: DataFrame, keep: Callable[[DataFrame], DataFrame] = checkpoint) -> DataFrame:
    """Candidate pairs (a, b) of the texts of `members` (key, component c) in different components: all that are near copies, and few others.

    Shingles are ordered by how many texts hold them, rarest first. Near copies share a shingle among the first ninth of the shorter and the first fifth of the longer text, and behind the first
    one that they share enough must be left in both to reach the similarity. What only one text holds takes a place in this order but no row. A template's shingles come last, so
    texts that differ in more than a ninth don't even meet. Of those that meet, most that are not near copies fail by parities: each text has a bit for each hash of 512, set if an odd number of its
    shingles have it; texts differ in no more bits than shingles, and near copies in at most a ninth of both their shingles. No filter loses a near copy."""
    made = map_texts(texts.join(members.hint("merge"), "key").select("key", "c", "text"), ["key", "c"], "grams array<long>, parity array<long>", _hashed_shingles, most=SLICE_BYTES)
    made = keep(made)
    held = made.select("key", "c", F.size("grams").alias("n"), F.explode("grams").alias("g"))
    often = held.groupBy("g").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1")
    shared = held.join(often.hint("merge"), "g")
    rank = F.row_number().over(Window.partitionBy("key").orderBy("texts", "g"))
    placed = shared.withColumn("rank", rank).withColumn("left", F.count(F.lit(1)).over(Window.partitionBy("key")) - F.col("rank") + 1)  # shingles from this one on
    placed = placed.filter("5 * left >= 4 * n").select("key", "c", "n", "g", "left")
    bits = [F.col("parity")[i].alias(f"p{i}") for i in range(PARITY)]
    placed = keep(placed.join(made.select("key", *bits).hint("merge"), "key"))
    x, y = placed.filter("9 * left >= 8 * n").alias("x"), placed.alias("y")
    met = F.expr("x.g = y.g and x.c <> y.c and (x.n < y.n or (x.n = y.n and x.key < y.key)) and 5 * x.n >= 4 * y.n and 9 * least(x.left, y.left) >= 4 * (x.n + y.n)")
    met &= F.expr("9 * (" + " + ".join(f"bit_count(x.p{i} ^ y.p{i})" for i in range(PARITY)) + ") <= x.n + y.n")
    return x.join(y.hint("merge"), met).select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")).distinct()


def _kernel():
    sketch = _sketcher()
    return lambda texts, batch: {"fp": simhash.fingerprints_of(texts).view(np.int64), **sketch(texts, batch)}


def keep_one(docs: DataFrame) -> DataFrame:
    """`docs` without all but one document of each group of near duplicates; same columns.

    Groups are first the components of op9 (fingerprints within 2 bits), then, among the documents that stay, the components of near
    copies. Of a group the smallest doc_id stays (null last; of equal ids the text of the smallest hash); of rows that agree on
    doc_id and text one stays, whichever. Only keys are shuffled while groups are sought. The texts stay where they are
    unless more than ``BROADCAST_KEYS`` documents go; then they are shuffled once."""
    keys = ["k1_", "k2_"]
    keyed = docs.withColumns({"k1_": F.xxhash64("doc_id", "text"), "k2_": F.xxhash64("text")})
    slim = keyed.select("doc_id", *keys, "text")
    scratch = Scratch(docs.sparkSession)
    made = scratch.keep(map_texts(slim, ["doc_id", *keys], "fp long, bands array<long>", _kernel, most=SLICE_BYTES))
    rows = simhash.with_components(checkpoint(made.select("doc_id", *keys, "fp")))
    first = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "k2_", "k1_")
    kept = checkpoint(rows.groupBy("root").agg(F.min(first).alias("m")).select("m.doc_id", "m.k1_", "m.k2_"))

    entries = made.join(kept.select("k2_").distinct().hint("merge"), "k2_", "left_semi").filter("bands is not null")
    entries = entries.groupBy(F.col("k2_").alias("key")).agg(F.first("bands").alias("bands")).select("key", F.explode("bands").alias("band"))
    found = checkpoint(copy_links(entries, keyed.select(F.col("k2_").alias("key"), "text")))
    members = found.unionByName(found.select(F.col("root").alias("node"), "root")).distinct()
    ids = kept.join(members.hint("merge"), F.col("k2_") == F.col("node"))
    best = ids.groupBy("root").agg(F.min(first).alias("m")).select("root", F.col("m.k1_").alias("b1_"), F.col("m.k2_").alias("b2_"))
    copies = ids.join(best.hint("merge"), "root").filter("k1_ <> b1_ or k2_ <> b2_").select(*keys)
    kept = checkpoint(kept.join(copies.hint("merge"), keys, "left_anti").select(*keys))

    counts = made.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    stays = counts.join(kept.withColumn("stays", F.lit(True)).hint("merge"), keys, "left")
    moved = checkpoint(stays.filter("stays is null or n > 1").select(*keys, F.col("stays").isNotNull().alias("again")))
    scratch.drop()
    out = keyed.join(_small(moved.select(*keys)), keys, "left_anti")
    again = moved.filter("again").select(*keys)
    if not again.isEmpty():
        out = out.unionByName(keyed.join(_small(again), keys, "left_semi").dropDuplicates(keys))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
