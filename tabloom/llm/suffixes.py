"""Removal of repeated byte strings by a distributed difference-cover suffix sort.

A byte is removed if a string of ``LENGTH`` bytes that covers it also starts in a document with a smaller doc_id.

Suffixes that can share ``LENGTH`` bytes are brought to the same block: a string's smallest ``GRAM``-byte hash (its
minimizer) names its block, and neighbouring strings with the same minimizer travel as one segment. Segments whose
minimizer occurs in one document only (by merged sketches, which never undercount) stay where they are, for
nothing in them can match. A block sorts the suffixes of its distinct segments by the difference cover of
period 3: sampled triples get names, names are sorted recursively until they cover ``LENGTH`` bytes, the
remaining suffixes are merged in by their first byte and the rank that follows, and neighbours in the order are compared for
a common prefix of ``LENGTH`` bytes.

Dealing by minimizer ships about four bytes for each suffix of a possible match, once; shipping every position in each
round of the recursion would need many times the input.

Defined results: null texts are empty; texts shorter than ``LENGTH`` lose nothing; a null doc_id counts as the largest;
rows that share a doc_id never match each other. A segment that many documents share is sent once by each group.
Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm import dealing
from tabloom.llm.common import mix, parallelism, rolling, row_starts, runs, sliding_min, table, text_bytes, window_mask

LENGTH, GRAM, CELLS_EACH, FACTOR = 50, 16, 16, 0x9E3779B97F4A7C15
#: Text for one block of segments, about; and bytes that are hashed at once.
BLOCK_BYTES, PIECE = 2 << 20, 2 << 20
PAYLOAD = "b int, g int, own binary, at binary, ids binary, lengths binary, text binary"
_PAYLOAD = pa.schema([("b", pa.int32()), ("g", pa.int32())] + [(c, pa.binary()) for c in ("own", "at", "ids", "lengths", "text")])


# --- difference cover ----------------------------------------------------------------------------


def dense(key: np.ndarray) -> np.ndarray:
    """Ranks from 1, equal for equal keys."""
    order = np.argsort(key)
    by = key[order]
    out = np.empty(len(key), np.uint64)
    out[order] = np.cumsum(np.concatenate([[True], by[1:] != by[:-1]])) if len(key) else order
    return out


def _wide(x: np.ndarray) -> int:
    return int(x.max(initial=0)).bit_length()


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One key with the order of the pairs (a, b)."""
    if _wide(a) + _wide(b) > 64:
        a = dense(a)
    if _wide(a) + _wide(b) > 64:
        b = dense(b)
    return (a << np.uint64(_wide(b))) | b


def suffix_order(s: np.ndarray, need: int) -> np.ndarray:
    """Positions of all suffixes of `s` (symbols from 1), ordered by their first `need` symbols at least; ends count as 0."""
    n = len(s)
    m = n + need + 3 + (-(n + need)) % 3  # padded, to a multiple of 3
    t = np.concatenate([s, np.zeros(m + 3 - n, np.uint64)])
    if need <= 3:
        order = np.argsort(joined(joined(t[:m], t[1 : m + 1]), t[2 : m + 2])[:n])
        return order
    sample = np.concatenate([np.arange(1, m, 3), np.arange(2, m, 3)])
    names = dense(joined(joined(t[sample], t[sample + 1]), t[sample + 2]))
    ordered = sample[suffix_order(names, -(-need // 3))]
    rank = np.zeros(m + 3, np.uint64)
    rank[ordered] = np.arange(1, len(ordered) + 1, dtype=np.uint64)
    # the remaining suffixes: by a symbol and the rank that follows, which also tells which suffix it is
    zero, bits = np.arange(0, m, 3), np.uint64(len(ordered).bit_length())
    own = np.sort((t[zero] << bits) | rank[zero + 1])
    zero = ordered[(own & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64) - 1] - 1
    # and their places among the sampled: by one symbol and a rank, or by two symbols and a rank
    one, two = np.arange(1, m, 3), np.arange(2, m, 3)
    before = np.searchsorted(np.sort((t[one] << bits) | rank[one + 1]), own)
    pair = lambda i: joined(t[i], t[i + 1])
    both = joined(pair(np.concatenate([zero, two])), rank[np.concatenate([zero, two]) + 2])
    before = before + np.searchsorted(np.sort(both[len(zero) :]), both[: len(zero)])
    at = np.maximum.accumulate(before) + np.arange(len(zero))
    out = np.empty(len(zero) + len(ordered), np.int64)
    free = np.ones(len(out), bool)
    free[at] = False
    out[at], out[free] = zero, ordered
    return out[out < n]


def equal_strings(text: bytes, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """A number for each start, equal where the `length` bytes from there are equal: neighbours in the order are compared."""
    x = np.frombuffer(text, np.uint8)
    number = np.full(len(x), -1, np.int64)
    number[starts] = np.arange(len(starts))
    at = suffix_order(x.astype(np.uint64) + np.uint64(1), length)
    at = at[number[at] >= 0]
    words = np.ndarray((max(0, len(x) - 7),), "<u8", buffer=text, strides=(1,))
    differs = np.zeros(max(0, len(at) - 1), bool)
    for o in [*range(0, length - 7, 8), length - 8]:
        word = words[at + o]
        differs |= word[1:] != word[:-1]
    out = np.empty(len(starts), np.int64)
    out[number[at]] = np.concatenate([[0], np.cumsum(differs)]) if len(at) else at
    return out


# --- dealing -------------------------------------------------------------------------------------


def minimizer_runs(raw: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first string, number of strings, minimizer) of each run of strings with one minimizer, over concatenated texts."""
    text, first, many, value = b"".join(raw), [], [], []
    valid = window_mask(np.array([len(x) for x in raw], np.int64), length, len(text) - length + 1)
    for a in range(0, len(valid), PIECE):  # whatever the lengths of the texts
        ok = valid[a : a + PIECE]
        x = np.frombuffer(text, np.uint8, len(ok) + length - 1, a).astype(np.uint64) + np.uint64(1)
        least = sliding_min(mix(rolling(x, gram, FACTOR)), length - gram + 1)
        s = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | ~ok[:-1]]) & ok)
        _, ends = runs(ok)
        e = np.minimum(np.append(s[1:], len(ok)), ends[np.searchsorted(ends, s, "right")]) if len(s) else s
        first.append(s + a)
        many.append(e - s)
        value.append(least[s])
    joined_ = lambda p, kind: np.concatenate(p) if p else np.zeros(0, kind)
    return joined_(first, np.int64), joined_(many, np.int64), joined_(value, np.uint64)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary) for every document."""
    spark, size = docs.sparkSession, text_bytes(docs)
    groups = parallelism(spark, size, dealing.GROUP_BYTES)
    blocks, cells = groups, dealing.cells_for(size / 19, groups, CELLS_EACH)
    parts = parallelism(spark, size, BLOCK_BYTES)
    dealt = dealing.grouped(docs, groups)

    def entries(sort_ids: np.ndarray, raw: list[bytes]):
        """Runs, their minimizers, and the distinct (document, minimizer) pairs with each run's pair."""
        first, many, value = minimizer_runs(raw, length, gram)
        doc = np.searchsorted(row_starts(np.array([len(x) for x in raw], np.int64)), first, "right") - 1
        order = np.lexsort((sort_ids[doc], value))
        v, d = value[order], sort_ids[doc][order]
        new = np.concatenate([[True], (v[1:] != v[:-1]) | (d[1:] != d[:-1])]) if len(v) else np.zeros(0, bool)
        pair = np.empty(len(v), np.int64)
        pair[order] = np.cumsum(new) - 1
        return first, many, value, doc, v[new], pair

    def sketch(t: pa.Table) -> pa.Table:
        _, sort_ids, raw = dealing.documents_of(t)
        return dealing.cells_table(dealing.sketch_rows(t.column("g")[0].as_py(), entries(sort_ids, raw)[4], 1, blocks, cells))

    answers = dealt.groupBy("g").applyInArrow(sketch, dealing.CELLS).groupBy("b").applyInArrow(dealing.merged_answers, dealing.ANSWER)

    def segments(t: pa.Table, told: pa.Table) -> pa.Table:
        if not told.num_rows:
            return _PAYLOAD.empty_table()
        g = t.column("g")[0].as_py()
        _, sort_ids, raw = dealing.documents_of(t)
        first, many, value, doc, pairs, pair = entries(sort_ids, raw)
        often = dealing.estimated_repeated(pairs, told, 1, blocks, cells)[pair]
        first, many, value, doc = first[often], many[often], value[often], doc[often]
        text = b"".join(raw)
        seen: dict[bytes, int] = {}
        own, sent = [], []
        for i, (a, n, d) in enumerate(zip(first.tolist(), many.tolist(), sort_ids[doc].tolist())):
            piece = text[a : a + n + length - 1]
            before = seen.setdefault(piece, d)
            if before < d:  # all of it is in an earlier document of this group
                own.append((a, a + len(piece)))
            else:
                sent.append(i)
        rows = [{"b": g % parts, "g": g, "own": _spans(np.array(own, np.int64).reshape(-1, 2))}] if own else []
        sent = np.array(sent, np.int64)
        part = mix(value[sent] ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(parts)
        order = np.argsort(part, kind="stable")
        cut = np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))
        for k in np.flatnonzero(np.diff(cut)):
            i = sent[order[cut[k] : cut[k + 1]]]
            pieces = [text[a : a + n + length - 1] for a, n in zip(first[i].tolist(), many[i].tolist())]
            rows.append({
                "b": int(k), "g": g, "at": dealing.pack_sorted(first[i]), "ids": dealing.squeeze(np.diff(sort_ids[doc[i]], prepend=np.int64(0)).tobytes()),
                "lengths": dealing.squeeze((many[i] + length - 1).astype(np.int32).tobytes()), "text": dealing.squeeze(b"".join(pieces)),
            })
        return pa.Table.from_pylist(rows, _PAYLOAD)

    payload = dealt.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(segments, PAYLOAD)
    found = payload.groupBy("b").applyInArrow(lambda t: _matches(t, length), dealing.ANSWER)
    kept = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])

    def cut_out(t: pa.Table, told: pa.Table) -> pa.Table:
        ids, _, raw = dealing.documents_of(t)
        counts = np.array([len(x) for x in raw], np.int64)
        begin, step = row_starts(counts), np.zeros(int(counts.sum()) + 1, np.int32)
        for data in told.column("data").to_pylist():
            spans = np.frombuffer(dealing.unsqueeze(data), np.int64).reshape(-1, 2)
            np.add.at(step, spans[:, 0], 1)
            np.add.at(step, spans[:, 1], -1)
        gone = np.cumsum(step, dtype=np.int32)[:-1] > 0
        out = {"doc_id": ids, "n_bytes": counts, "n_removed": [], "n_spans": [], "kept": []}
        for i, x in enumerate(raw):
            own = gone[begin[i] : begin[i + 1]]
            n = int(own.sum())
            out["n_removed"].append(n)
            out["n_spans"].append(len(runs(own)[0]) if n else 0)
            out["kept"].append(np.frombuffer(x, np.uint8)[~own].tobytes() if n else x)
        return pa.Table.from_arrays([pa.array(out[f.name], f.type) for f in kept], schema=kept)

    return dealt.groupBy("g").cogroup(found.groupBy("g")).applyInArrow(cut_out, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def _spans(x: np.ndarray) -> bytes:
    return dealing.squeeze(np.ascontiguousarray(x, np.int64).tobytes())


def _matches(t: pa.Table, length: int) -> pa.Table:
    """Of a block's segments, the spans whose strings also start in an earlier document, for each group."""
    out, groups, at, ids, pieces = [], [], [], [], []
    for r in t.to_pylist():
        if r["own"] is not None:
            out.append({"g": r["g"], "b": -1, "data": r["own"]})
            continue
        at.append(dealing.unpack_sorted(r["at"]))
        ids.append(np.cumsum(np.frombuffer(dealing.unsqueeze(r["ids"]), np.int64)))
        groups.append(np.full(len(at[-1]), r["g"]))
        lengths, text, a = np.frombuffer(dealing.unsqueeze(r["lengths"]), np.int32).tolist(), dealing.unsqueeze(r["text"]), 0
        for n in lengths:
            pieces.append(text[a : a + n])
            a += n
    if at:
        at, ids, groups = (np.concatenate(x) for x in (at, ids, groups))
        # equal segments are sorted once; all but those of the earliest document match whole
        number: dict[bytes, int] = {}
        which = np.array([number.setdefault(p, len(number)) for p in pieces], np.int64)
        texts = list(number)
        size = np.array([len(p) for p in texts], np.int64)
        lowest = np.full(len(texts), np.iinfo(np.int64).max)
        np.minimum.at(lowest, which, ids)
        begin = row_starts(size)
        starts = np.flatnonzero(window_mask(size, length, int(begin[-1]) - length + 1))
        seg = np.searchsorted(begin, starts, "right") - 1
        same = equal_strings(b"".join(texts), starts, length)
        least = np.full(int(same.max(initial=-1)) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, same, lowest[seg])
        hit = np.zeros(int(begin[-1]) + 1, bool)
        hit[starts] = least[same] < lowest[seg]
        first, end = runs(hit)  # runs of matching starts; those of one segment never touch the next one's
        owner = np.searchsorted(begin, first, "right") - 1
        rows = np.argsort(which, kind="stable")
        cut = np.searchsorted(which[rows], np.arange(len(texts) + 1))
        whole = ids > lowest[which]
        some = [
            (groups[i], at[i] + f, at[i] + e - 1 + length)
            for f, e, s in zip((first - begin[owner]).tolist(), (end - begin[owner]).tolist(), owner.tolist())
            for i in rows[cut[s] : cut[s + 1]].tolist()
            if not whole[i]
        ]
        spans = np.stack([groups[whole], at[whole], at[whole] + size[which[whole]]], 1)
        spans = np.concatenate([spans, np.array(some, np.int64).reshape(-1, 3)])
        for g in np.unique(spans[:, 0]):
            out.append({"g": int(g), "b": 0, "data": _spans(spans[spans[:, 0] == g][:, 1:])})
    return pa.Table.from_pylist(out, dealing._ANSWER)


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that every document loses, and a digest of those it keeps."""
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
