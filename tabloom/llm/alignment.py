"""Alignment of two tokenizers over a corpus: which tokens of one cover the same bytes as which of the other.

Both encode " " + text. NumPy does the rest for a few megabytes of documents at a time: cumulative sums of token lengths are the ends, their intersection the common
cuts, a binary search labels each token with its group, and repeats of each token by the number of tokens it overlaps make the links.
Documents are encoded once. What a batch of documents leaves (digests, its distinct pairs, and each document's pairs as numbers into these) is written as one row of Parquet in
the shared folder; all later steps read that.

Counts of pairs (in how many documents a pair is linked) are summed in batches, then by (pair, salt), then by pair, so a pair that every document holds is one row
for each batch and a few for each salt. A batch asks for each of its distinct pairs once, by an ordinary join, and gets counts back sorted; no table of all pairs is gathered or broadcast, only the highest
count of each id of the first tokenizer, whose number its vocabulary bounds.

Encoding is exact: ranks of the first vocabulary are its merges (checked when it is loaded; else its own library encodes), and no piece of the second holds a blank after something
else (checked, too), so very long texts can be cut there, which bounds the memory that the model takes.

Defined results: an empty table gives an empty result; null and empty texts, and texts whose tokens don't give back " " + text, have no tokens, zeros and an empty digest; each
row is a document of its own, whatever its doc_id; extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm.common import row_starts, table, text_slices
from tabloom.llm.dealing import squeeze, unsqueeze
from tabloom.sources.shared import written

TOKENIZERS = "/opt/tokenizers"
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text that are encoded and aligned at once, that share one row of distinct pairs, and salts of a pair.
SLICE_BYTES, BATCH_BYTES, SALTS = 1 << 20, 8 << 20, 16
#: Code points of a text that the second model encodes at once; longer texts are cut at blanks.
PART_POINTS = 1 << 17
#: How byte-level vocabularies split text before merging: a fixed value of the format.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLANK = "▁"

#: Encodes texts: ids of all their tokens and the number of tokens of each text.
Encode = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


def byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 for itself, the others in order from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _flat(parts: list[list[int]], dtype=np.int32) -> tuple[np.ndarray, np.ndarray]:
    counts = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.fromiter(itertools.chain.from_iterable(parts), dtype, int(counts.sum())), counts


@functools.lru_cache(2)
def byte_encoder(path: str) -> tuple[Encode, list[bytes]]:
    """(encoder, bytes of each id) of a byte-level vocabulary."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    letters = byte_of_letter()
    ids = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items()}
    entries = [b""] * (max(ids.values(), default=-1) + 1)
    for token, i in ids.items():
        entries[i] = token
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if all(model["vocab"].get(a + b) == 256 + k for k, (a, b) in enumerate(merges)) and len(ids) == 256 + len(merges):
        import tiktoken

        ranks = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ids, special_tokens={})
        return (lambda texts: _flat([ranks.encode_ordinary(x) for x in texts])), entries
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    return (lambda texts: _flat([own.encode(x, add_special_tokens=False).ids for x in texts])), entries


@functools.lru_cache(2)
def piece_encoder(path: str) -> tuple[Encode, list[bytes]]:
    """(encoder, bytes of each id) of a piece vocabulary that adds a blank in front. Texts are given with that blank."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    entries = [bytes([int(p[3:-1], 16)]) if model.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
    if any(re.search(f"[^{BLANK}]{BLANK}", p) for p in pieces):
        return (lambda texts: _flat([model.encode(x[1:]) for x in texts])), entries
    cut = re.compile("(?<=[^ ]) +[^ ]")

    def parts(text: str) -> list[str]:
        """A long text in pieces that begin at a blank; each without that blank, which the model adds."""
        found, start = [], 0
        while len(text) - start > PART_POINTS and (m := cut.search(text, start + PART_POINTS)):
            found.append(text[start + 1 : m.start()])
            start = m.start()
        return [*found, text[start + 1 :]]

    def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        cuts = [parts(x) for x in texts]
        ids, counts = _flat(model.encode(list(itertools.chain.from_iterable(cuts)), num_threads=1))
        return ids, np.diff(row_starts(counts)[row_starts([len(x) for x in cuts])])

    return encode, entries


def _equal_bytes(ids: np.ndarray, counts: np.ndarray, entries: list[bytes], texts: list[bytes]) -> np.ndarray:
    """Which texts their tokens give back."""
    at, listed = row_starts(counts), ids.tolist()
    return np.fromiter((b"".join([entries[i] for i in listed[at[k] : at[k + 1]]]) == x for k, x in enumerate(texts)), bool, len(texts))


def align(a_ids: np.ndarray, b_ids: np.ndarray, a_lengths: np.ndarray, b_lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group of each A token, group of each B token, A token of each link, B token of each link) of tokens that cover the same bytes."""
    ends_a, ends_b = np.cumsum(a_lengths), np.cumsum(b_lengths)
    cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
    first = np.searchsorted(ends_b, ends_a - a_lengths, "right")  # the B token that holds the first byte, and after the one that holds the last
    after = np.searchsorted(ends_b - b_lengths, ends_a, "left")
    each = after - first
    link_a = np.repeat(np.arange(len(a_ids)), each)
    link_b = np.arange(len(link_a)) - np.repeat(np.cumsum(each) - each, each) + np.repeat(first, each)
    return np.searchsorted(cuts, ends_a, "left"), np.searchsorted(cuts, ends_b, "left"), link_a, link_b


def group_digests(a_ids, b_ids, group_a, group_b, doc_a, doc_b, docs: int, names: dict) -> list[str]:
    """SHA-256 of each document's groups as text; empty for those without tokens."""
    ids = np.concatenate([a_ids, b_ids])
    side = np.concatenate([np.zeros(len(a_ids), np.int64), np.ones(len(b_ids), np.int64)])
    group = np.concatenate([group_a, group_b])
    order = np.argsort(2 * group + side, kind="stable")
    ids, side, group, doc = ids[order], side[order], group[order], np.concatenate([doc_a, doc_b])[order]
    # what stands before each token: nothing, a comma, a bar or a semicolon
    before = np.where(group[1:] != group[:-1], 2, np.where(side[1:] != side[:-1], 1, 0))
    before = np.concatenate([[3], np.where(doc[1:] != doc[:-1], 3, before)]) if len(ids) else np.zeros(0, np.int64)
    if "table" not in names:
        names["table"] = np.array([mark + b"%d" % i for mark in (b",", b"|", b";", b"") for i in range(names["most"])], object)
    text = names["table"][before * names["most"] + ids]
    cut = np.searchsorted(doc, np.arange(docs + 1))
    return [hashlib.sha256(b"".join(text[cut[k] : cut[k + 1]])).hexdigest() if cut[k + 1] > cut[k] else "" for k in range(docs)]


BATCH = "batch string, docs binary, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, digests array<string>, pairs binary, held binary, which binary, times binary"
_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers as compressed byte planes of their differences."""
    d = np.diff(x.astype(np.int64), prepend=np.int64(0))
    return squeeze(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(unsqueeze(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.int64).ravel())


def aligned_batches(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row for each few megabytes of documents; `which` numbers the distinct pairs of each document within `pairs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (encode_a, bytes_a), (encode_b, bytes_b) = byte_encoder(a_path), piece_encoder(b_path)
        length_a, length_b = (np.array([len(x) for x in e], np.int64) for e in (bytes_a, bytes_b))
        wide = len(bytes_b)
        names, span = {"most": max(len(bytes_a), wide)}, len(bytes_a) * wide
        held: list[dict] = []

        def measured(ids: list, raw: list[bytes]) -> dict:
            """What is kept of some documents: counts, digests, their distinct pairs."""
            n, raw = len(raw), [b" " + x if x else b"" for x in raw]
            texts = [x.decode() for x in raw]
            (a, n_a), (b, n_b) = encode_a(texts), encode_b(texts)
            ok = _equal_bytes(a, n_a, bytes_a, raw) & _equal_bytes(b, n_b, bytes_b, raw)
            a, b, n_a, n_b = a[np.repeat(ok, n_a)], b[np.repeat(ok, n_b)], n_a * ok, n_b * ok
            doc_a, doc_b = np.repeat(np.arange(n), n_a), np.repeat(np.arange(n), n_b)
            group_a, group_b, link_a, link_b = align(a, b, length_a[a], length_b[b])
            link_doc = doc_a[link_a]
            keys, times = np.unique(link_doc * span + a[link_a].astype(np.int64) * wide + b[link_b], return_counts=True)
            groups = np.bincount(doc_a[np.flatnonzero(np.diff(group_a, prepend=-1))], minlength=n)
            found = {"doc_ids": ids, "n_a": n_a, "n_b": n_b, "n_groups": groups, "n_links": np.bincount(link_doc, minlength=n)}
            found["digests"] = group_digests(a, b, group_a, group_b, doc_a, doc_b, n, names)
            return found | {"docs": np.bincount(keys // span, minlength=n), "pairs": keys % span, "times": times}

        def made() -> pa.RecordBatch:
            every = {c: np.concatenate([x[c] for x in held]) for c in (*_COUNTS, "docs", "pairs", "times")}
            pairs, which, often = np.unique(every["pairs"], return_inverse=True, return_counts=True)
            row = {"batch": uuid.uuid4().hex, "docs": _packed(every["docs"]), **{c: every[c].tolist() for c in _COUNTS}}
            row |= {c: list(itertools.chain.from_iterable(x[c] for x in held)) for c in ("doc_ids", "digests")}
            row |= {"pairs": _packed(pairs), "held": _packed(often), "which": _packed(which), "times": _packed(every["times"])}
            held.clear()
            return pa.RecordBatch.from_pylist([row], schema=_SCHEMA)

        size = 0
        for batch in batches:
            for i, k, raw in text_slices(batch.column(1), SLICE_BYTES):
                held.append(measured(batch.column(0).slice(i, k - i).to_pylist(), raw))
                size += sum(map(len, raw))
                if size >= BATCH_BYTES:
                    yield made()
                    size = 0
        if held:
            yield made()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, BATCH)


_SCHEMA = pa.schema(
    [("batch", pa.string()), ("docs", pa.binary()), ("doc_ids", pa.list_(pa.int64()))]
    + [(c, pa.list_(pa.int64())) for c in _COUNTS]
    + [("digests", pa.list_(pa.string()))]
    + [(c, pa.binary()) for c in ("pairs", "held", "which", "times")]
)


def batch_pairs(batches: DataFrame) -> DataFrame:
    """(batch, pair, held): the distinct pairs of each batch, and in how many of its documents they are linked."""
    schema = pa.schema([("batch", pa.string()), ("pair", pa.int64()), ("held", pa.int64())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows:
            for name, pairs, held in zip(*(r.column(i).to_pylist() for i in range(3))):
                pair = _unpacked(pairs)
                yield pa.RecordBatch.from_arrays([pa.array([name]).take(pa.array(np.zeros(len(pair), np.int32))), pa.array(pair), pa.array(_unpacked(held))], schema=schema)

    return batches.select("batch", "pairs", "held").mapInArrow(run, "batch string, pair long, held long")


def pair_counts(found: DataFrame, salts: int = SALTS) -> DataFrame:
    """(pair, n): documents that hold each pair, summed by pair and salt and then by pair."""
    salted = found.groupBy("pair", F.pmod(F.xxhash64("batch"), F.lit(salts)).alias("salt")).agg(F.sum("held").alias("n"))
    return salted.groupBy("pair").agg(F.sum("n").alias("n"))


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def aligned(docs: DataFrame, a_path: str = f"{TOKENIZERS}/{BYTE_BPE}", b_path: str = f"{TOKENIZERS}/{PIECE_BPE}") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every document."""
    wide = len(piece_encoder(b_path)[1])
    batches = written(aligned_batches(docs, a_path, b_path), "aligned")
    found = batch_pairs(batches)
    counts = written(pair_counts(found), "pairs")
    a_id = F.floor(F.col("pair") / wide)
    best = counts.groupBy(a_id.alias("a")).agg(F.max("n").alias("most"))  # a row for each id of the first vocabulary at most
    rated = counts.withColumn("a", a_id).join(F.broadcast(best), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    told = found.select("batch", "pair").join(rated, "pair")
    schema = pa.schema([("doc_id", pa.int64())] + [(c, pa.int64()) for c in (*_COUNTS, "n_best", "count_sum")] + [("groups_sha256", pa.string())])

    def results(batch: pa.Table, answers: pa.Table) -> pa.Table:
        if not batch.num_rows:
            return schema.empty_table()
        row = batch.slice(0, 1).to_pylist()[0]
        n = top = np.zeros(0, np.int64)
        if answers.num_rows:
            order = np.argsort(answers.column("pair").to_numpy())
            n, top = answers.column("n").to_numpy()[order], answers.column("best").to_numpy()[order].astype(np.int64)
        which, times, distinct = _unpacked(row["which"]), _unpacked(row["times"]), _unpacked(row["docs"])
        at = row_starts(distinct)
        sums = [np.concatenate([[0], np.cumsum(times * x[which])]) for x in (top, n)]
        best_, total = (s[at[1:]] - s[at[:-1]] for s in sums)
        columns = [row["doc_ids"], *(row[c] for c in _COUNTS), best_, total, row["digests"]]
        return pa.Table.from_arrays([pa.array(x, type=f.type) for x, f in zip(columns, schema)], schema=schema)

    return batches.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(results, RESULT)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, groups, links and counts of links of every document."""
    return aligned(table(spark, sf_dir, "documents"))
