"""Mixing of sources to target weights, by fixed-length blocks of tokens.

The words of a source, document after document, are one stream, cut into blocks of ``block_words``.
Output shards draw how many blocks they take from each source (multinomial draws given the sources' totals, so
that these are exact; each task draws for its own shards). The slots of a source are numbered over all shards and mapped through a
pseudorandom permutation of the source's block indices, pass after pass; a join on (source, block)
brings the blocks in: each document is cut at the borders of its blocks, and the pieces meet the slots that take
their block (``Mix.taken``). The mix's text by slot, its documents and the words taken of each document all come from
that join. A source with a third of all rows is dealt into hash chunks, and its stream offsets come from per-chunk sums.

Targets: sources by code point (null last) weigh 3, 1, 2, repeating, and share ``share`` times all
words by weight; none exceeds ``limit`` times its source, and what is above goes to the others.
Targets are computed on the driver from one row per source; more than ``MAX_SOURCES`` sources are an error.

Defined results: null and empty texts have size 0 and are taken 0 times; a null source is a source of
its own; repeated rows are separate stretches of the stream; an empty table gives an empty result;
only doc_id, source and text are read, other columns are ignored. The last block may be short.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tabloom.llm.common import checkpoint, table, text_slices

WEIGHTS, SHARE, LIMIT = (3.0, 1.0, 2.0), 1.5, 2.0
BLOCK_WORDS, BLOCKS_PER_SHARD, MAX_SOURCES, SHARDS_PER_TASK, SEED = 256, 4096, 100_000, 256, 20
#: Below so many slots draws are hypergeometric, which is what numpy can do.
EXACT_SLOTS = 10**9
#: Rows of one hash chunk of a source; the square root of the source's rows if that is more.
CHUNK_ROWS = 5000


def targets(sizes: list[int], weights: list[float], share: float = SHARE, limit: float = LIMIT) -> list[float]:
    """Words for each source: by weight, at most `limit` times its size, the excess reshared until none is above."""
    total = share * sum(sizes)
    out, open_ = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0]
    left = min(total, limit * sum(sizes))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if weights[i] * unit > limit * sizes[i]]
        if not over:
            for i in open_:
                out[i] = weights[i] * unit
            break
        for i in over:
            out[i] = limit * sizes[i]
            left -= out[i]
        open_ = [i for i in open_ if i not in set(over)]
    return out


def _rounds(n: int, key: str) -> tuple[np.uint64, np.uint64, list[np.uint64]]:
    half = np.uint64(max(1, math.ceil(math.log2(n) / 2)))
    keys = [np.uint64(int.from_bytes(hashlib.md5(f"{key}|{r}".encode()).digest()[:8], "little") | 1) for r in range(4)]
    return half, np.uint64((1 << int(half)) - 1), keys


def _scramble(x: np.ndarray, k: np.uint64, mask: np.uint64) -> np.ndarray:
    f = (x + k) * np.uint64(0x9E3779B97F4A7C15)
    return (((f ^ (f >> np.uint64(29))) * k) >> np.uint64(32)) & mask


def permuted(i: np.ndarray, n: int, key: str, inverse: bool = False) -> np.ndarray:
    """A pseudorandom permutation of range(n), or its inverse, at `i`: a Feistel network, walked until it is in range."""
    if n <= 1:
        return np.zeros(len(i), np.int64)
    half, mask, keys = _rounds(n, key)
    out, todo = i.astype(np.uint64), np.arange(len(i))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for k in keys[::-1] if inverse else keys:
            if inverse:
                left, right = right ^ _scramble(left, k, mask), left
            else:
                left, right = right, left ^ _scramble(right, k, mask)
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def _part(have: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """How many of `n` slots, drawn without putting back, each source's `have` slots give."""
    total = int(have.sum())
    if total < EXACT_SLOTS:
        return rng.multivariate_hypergeometric(have, n, method="marginals")
    out = np.floor(have * (n / total)).astype(np.int64)  # of so many, even shares; chance deals what is left over
    while (missing := n - int(out.sum())) > 0:
        rest = have - out
        out += np.minimum(rng.multinomial(missing, rest / rest.sum()), rest)
    return out


def shard_draws(slots: list[int], per_shard: int, seed: int, first: int = 0, stop: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, slots it takes of each source, each source's slots before it) for shards `first` to `stop`.

    Multinomial counts of the shards, given each source's total: halves of the range of shards are drawn one from another,
    each by a seed of its own, so any task finds its shards without the others' draws."""
    shards = -(-sum(slots) // per_shard)
    stop = shards if stop is None else min(stop, shards)

    def walk(a: int, b: int, have: np.ndarray, before: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if a >= stop or b <= first:
            return
        if b - a == 1:
            yield a, have, before
            return
        middle = (a + b) // 2
        left = _part(have, (middle - a) * per_shard, np.random.default_rng([seed, a, b]))
        yield from walk(a, middle, left, before)
        yield from walk(middle, b, have - left, before + left)

    if shards:
        yield from walk(0, shards, np.array(slots, np.int64), np.zeros(len(slots), np.int64))


SLOT = "src_no int, shard int, slot long, block long, words long"
_SLOT = pa.schema([("src_no", pa.int32()), ("shard", pa.int32()), ("slot", pa.int64()), ("block", pa.int64()), ("words", pa.int64())])


def stream_offsets(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`docs` with src_no, size, row_key (source, chunk, number) and ``at``, the offset in the source's stream; and the words of each source.

    The order in a stream is by hash chunk, then doc_id and the other columns; only rows alike in all of them tie."""
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    sized = lambda columns: docs.select(*columns, words.alias("mix_size_"), F.xxhash64("doc_id").alias("mix_h_"))
    narrow = checkpoint(sized(["source"]))
    # one row for each source, at most MAX_SOURCES
    sources = narrow.groupBy("source").agg(F.count(F.lit(1)).cast("double").alias("n_"), F.sum("mix_size_").alias("words_"))
    if sources.limit(MAX_SOURCES + 1).count() > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sources = sources.select(F.col("source").alias("s_"), "words_", F.ceil(F.col("n_") / F.greatest(F.lit(float(CHUNK_ROWS)), F.sqrt("n_"))).cast("long").alias("chunks_"))
    sources = checkpoint(sources)

    def chunked(rows: DataFrame) -> DataFrame:
        rows = rows.join(F.broadcast(sources.drop("words_")), F.col("source").eqNullSafe(F.col("s_")))
        return rows.withColumn("mix_chunk_", F.pmod("mix_h_", F.col("chunks_"))).drop("s_", "chunks_")

    sums = chunked(narrow).groupBy("source", "mix_chunk_").agg(F.sum("mix_size_").alias("chunk_size"))
    before = Window.partitionBy("source").orderBy("mix_chunk_").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("mix_base_", F.coalesce(F.sum("chunk_size").over(before), F.lit(0))).drop("chunk_size")
    sums = checkpoint(sums.withColumnsRenamed({"source": "s_", "mix_chunk_": "c_"}))
    rows = chunked(sized(docs.columns).withColumn("mix_like_", F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])))
    within = Window.partitionBy("source", "mix_chunk_").orderBy("mix_h_", "doc_id", "mix_size_", "mix_like_").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"mix_upto_": F.sum("mix_size_").over(within), "mix_nth_": F.count(F.lit(1)).over(within).cast("long")})
    # one row for each CHUNK_ROWS rows of a source, or fewer
    rows = rows.join(F.broadcast(sums), F.col("source").eqNullSafe(F.col("s_")) & (F.col("mix_chunk_") == F.col("c_")))
    rows = rows.withColumn("mix_at_", F.col("mix_base_") + F.col("mix_upto_") - F.col("mix_size_")).select(*docs.columns, "mix_chunk_", "mix_nth_", "mix_size_", "mix_at_")
    return rows, sources.select(F.col("s_").alias("source"), F.col("words_").alias("size"))


def plan_mix(sizes: list[tuple[str | None, int]], block_words: int, per_shard: int, seed: int) -> dict:
    """Targets, whole passes and drawn slots of each source, in code-point order with null last."""
    ordered = sorted(sizes, key=lambda r: (r[0] is None, (r[0] or "").encode()))
    words = [s for _, s in ordered]
    goal = targets(words, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(words))])
    blocks = [-(-s // block_words) for s in words]
    passes = [int(t) // s if s else 0 for t, s in zip(goal, words)]
    slots, cut = [], []
    for i, (t, s, b, p) in enumerate(zip(goal, words, blocks, passes)):
        rest, n = (int(t) - p * s, 0) if s else (0, 0)
        if rest:  # the short last block stands somewhere in the order
            short = b * block_words - s
            where = int(permuted(np.array([b - 1]), b, f"{seed}|{i}|{p}", inverse=True)[0]) if short else b
            taken = lambda n: n * block_words - (short if n > where else 0)
            n = rest // block_words
            while taken(n) < rest:
                n += 1
        slots.append(p * b + n)
        cut.append(taken(n) - rest if rest else 0)
    return {"names": [n for n, _ in ordered], "words": words, "targets": goal, "blocks": blocks, "slots": slots, "cut": cut, "per_shard": per_shard}


def draw_slots(spark: SparkSession, plan: dict, block_words: int, seed: int) -> DataFrame:
    """One row for each slot of the mix: shard, source, the block it takes and how many of the block's words."""
    shared = spark.sparkContext.broadcast(plan)  # a few numbers for each source, at most MAX_SOURCES
    n = -(-sum(plan["slots"]) // plan["per_shard"])

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in batches:
            ids = batch.column(0).to_numpy()  # neighbours
            for shard, draws, starts in shard_draws(p["slots"], p["per_shard"], seed, int(ids[0]), int(ids[-1]) + 1):
                source = np.repeat(np.arange(len(draws)), draws)
                slot = np.arange(len(source)) - np.repeat(np.cumsum(draws) - draws - starts, draws)
                block, words = np.empty(len(slot), np.int64), np.empty(len(slot), np.int64)
                for i in np.flatnonzero(draws):
                    b, s, of = p["blocks"][i], p["words"][i], slice(*np.searchsorted(source, [i, i + 1]))
                    own, turns = slot[of], slot[of] // b
                    for turn in np.unique(turns):
                        block[of][turns == turn] = permuted(own[turns == turn] % b, b, f"{seed}|{i}|{turn}")
                    words[of] = np.minimum(block_words, s - block[of] * block_words)
                    words[of][own == p["slots"][i] - 1] -= p["cut"][i]
                yield pa.RecordBatch.from_arrays([pa.array(source, pa.int32()), pa.array(np.full(len(slot), shard), pa.int32()), pa.array(slot), pa.array(block), pa.array(words)], schema=_SLOT)

    tasks = max(spark.sparkContext.defaultParallelism * 4, -(-n // SHARDS_PER_TASK))
    return spark.range(0, n, 1, max(1, min(n, tasks))).mapInArrow(slots, SLOT)


class Mix:
    """The plan of a mix of `docs`, and its outputs: ``pieces`` of blocks taken by slots, whole blocks, words taken."""

    def __init__(self, docs: DataFrame, block_words: int = BLOCK_WORDS, per_shard: int = BLOCKS_PER_SHARD, seed: int = SEED):
        self.docs, self.block_words = docs, block_words
        spark = docs.sparkSession
        rows, sizes = stream_offsets(docs)
        plan = plan_mix([(r[0], int(r[1])) for r in sizes.collect()], block_words, per_shard, seed)  # at most MAX_SOURCES, checked above
        # one row per source: at most MAX_SOURCES
        facts = spark.createDataFrame(
            [(i, n, s, float(t)) for i, (n, s, t) in enumerate(zip(plan["names"], plan["words"], plan["targets"]))], "mix_src_ int, src string, source_size long, target double"
        )
        self.facts = facts.withColumnRenamed("mix_src_", "src_no").withColumnRenamed("src", "source")
        self.rows = rows.join(F.broadcast(facts), F.col("source").eqNullSafe(F.col("src"))).drop("src")
        self.slots = draw_slots(spark, plan, block_words, seed)
        # where the last slot of a source ends within its block
        self.ends = {}
        for i, (slots, b, s, cut) in enumerate(zip(plan["slots"], plan["blocks"], plan["words"], plan["cut"])):
            if cut:
                block = int(permuted(np.array([(slots - 1) % b]), b, f"{seed}|{i}|{(slots - 1) // b}")[0])
                self.ends[i] = min((block + 1) * block_words, s) - cut

    def pieces(self) -> DataFrame:
        """Each row of docs cut at the borders of blocks (and where a source's last slot ends): its columns with the piece as
        text, mix_block_, and the words mix_a_ to mix_z_ of the block that it is. A row's pieces make up its text."""
        added = StructType.fromDDL("mix_block_ long, mix_a_ long, mix_z_ long")
        rows = self.rows.filter("mix_size_ > 0").drop("source_size", "target")
        schema = StructType(rows.schema.fields + added.fields)
        arrow, ends, width = to_arrow_schema(schema), self.docs.sparkSession.sparkContext.broadcast(self.ends), self.block_words

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            end_of = ends.value
            for whole in batches:
                for first, stop, raw in text_slices(whole.column("text")):
                    batch = whole.slice(first, stop - first)
                    column = lambda n: batch.column(n).to_pylist()
                    taken, blocks, lows, highs, texts = [], [], [], [], []
                    for i, (text, at, size, src) in enumerate(zip(raw, column("mix_at_"), column("mix_size_"), column("mix_src_"))):
                        borders = list(range((at // width + 1) * width, at + size, width))
                        if at < end_of.get(src, 0) < at + size and end_of[src] % width:
                            borders = sorted([*borders, end_of[src]])
                        edges = [at, *borders, at + size]
                        if borders:
                            x = np.frombuffer(text, np.uint8)
                            word = (x != 32) & ((x < 9) | (x > 13))
                            word[1:] &= ~word[:-1]
                            places = [0, *np.flatnonzero(word)[np.array(borders) - at].tolist(), len(text)]
                        else:
                            places = [0, len(text)]
                        for low, high, p, q in zip(edges, edges[1:], places, places[1:]):
                            taken.append(i)
                            blocks.append(low // width)
                            lows.append(low - low // width * width)
                            highs.append(high - low // width * width)
                            texts.append(text[p:q].decode())
                    made = {"text": texts, "mix_block_": blocks, "mix_a_": lows, "mix_z_": highs}
                    index = pa.array(taken, pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) if f.name in made else batch.column(f.name).take(index).cast(f.type) for f in arrow], schema=arrow)

        return rows.mapInArrow(cut, schema)

    def taken(self) -> DataFrame:
        """One row for each piece and each slot that takes it: the columns of pieces, mix_shard_ and mix_slot_."""
        slots = self.slots.select(F.col("src_no").alias("mix_src_"), F.col("shard").alias("mix_shard_"), F.col("slot").alias("mix_slot_"), F.col("block").alias("mix_block_"), "words")
        return self.pieces().join(slots.hint("merge"), ["mix_src_", "mix_block_"]).filter("mix_z_ <= words").drop("words")

    def blocks(self) -> DataFrame:
        """(shard, slot, source, block, words, text): the text of each slot of the mix, pieces of documents on lines of their own."""
        piece = F.struct("mix_a_", "text", (F.col("mix_z_") - F.col("mix_a_")).alias("n"))  # at most block_words of a slot
        out = self.taken().groupBy("mix_src_", F.col("mix_shard_").alias("shard"), F.col("mix_slot_").alias("slot"), F.col("mix_block_").alias("block")).agg(F.array_sort(F.collect_list(piece)).alias("p"))
        out = out.join(F.broadcast(self.facts), F.col("mix_src_") == F.col("src_no"))
        return out.select("shard", "slot", "source", "block", F.aggregate("p.n", F.lit(0).cast("long"), lambda x, y: x + y).alias("words"), F.concat_ws("\n", "p.text").alias("text"))

    def documents(self) -> DataFrame:
        """The columns of docs, one row for each taken piece, with the piece as text (n_chars is its length); rows without words stay once."""
        out = self.taken()
        if "n_chars" in self.docs.columns:
            out = out.withColumn("n_chars", F.length("text").cast(self.docs.schema["n_chars"].dataType))
        return out.select(*self.docs.columns).unionByName(self.rows.filter("mix_size_ = 0").select(*self.docs.columns))

    def counts(self) -> DataFrame:
        """(doc_id, source, size, source_size, target, taken): how many words of each document the mix takes."""
        key = ["mix_src_", "mix_chunk_", "mix_nth_"]
        taken = self.taken().groupBy(*key).agg(F.sum(F.col("mix_z_") - F.col("mix_a_")).alias("taken"))
        rows = self.rows.select(*key, "doc_id", "source", F.col("mix_size_").alias("size"), "source_size", "target")
        return rows.join(taken.hint("merge"), key, "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix_sources(docs: DataFrame, block_words: int = BLOCK_WORDS, per_shard: int = BLOCKS_PER_SHARD, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken): how many words of each document the mix takes."""
    return Mix(docs.select("doc_id", "source", "text"), block_words, per_shard, seed).counts()


def apply_mix(docs: DataFrame, mixed: DataFrame, seed: int = SEED) -> DataFrame:
    """A mix of whole documents (`Mix.documents` is the exact one): `docs`, each row as often as the mix takes its words (the rest by a keyed draw); same columns.

    Rows that repeat a doc_id share the mean of what the mix takes of them; rows without words stay once."""
    share = mixed.groupBy("doc_id").agg(F.sum("size").alias("mix_size_"), F.sum("taken").alias("mix_taken_")).withColumnRenamed("doc_id", "mix_id_")
    ratio = F.when(F.col("mix_size_") > 0, F.col("mix_taken_") / F.col("mix_size_")).otherwise(F.lit(1.0))
    u = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    times = F.floor(ratio) + F.when(u < ratio - F.floor(ratio), 1).otherwise(0)
    out = docs.join(share, F.col("doc_id").eqNullSafe(F.col("mix_id_")), "left")
    return out.withColumn("mix_copy_", F.explode(F.array_repeat(F.lit(1), times.cast("int")))).select(*docs.columns)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
