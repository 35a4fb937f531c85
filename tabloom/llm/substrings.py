"""Removal of repeated word windows, behind a count-min prefilter.

A window is ``WINDOW`` consecutive words of one document. First each group of documents sketches its windows, and the
sketches are merged block by block into counts that are never too low. Then only windows whose estimate is two or
more in every row of the sketch are grouped exactly (by 96 bits from two hashes of their words), and each occurrence but the first, by doc_id
and start, has its words removed. A window that repeats is never estimated as single, so none is lost.

The sketch's width follows the input, and it stays dealt over the blocks: merging happens where the block is, and groups
get one bit for each of their windows back. A window that very many documents share is sent once by each group.

Defined results: an empty table gives an empty result; null and empty texts have no words; texts shorter than a window lose nothing; a null doc_id counts as
the largest; rows that share a doc_id count as one after the other by text. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm import dealing
from tabloom.llm.common import WordHashes, mix, parallelism, rolling, row_starts, table, text_bytes, window_mask

WINDOW, DEPTH, CELLS_EACH = 20, 2, 4
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
PAYLOAD = "b int, g int, own binary, at binary, ids binary, hashes binary"
_PAYLOAD = pa.schema([("b", pa.int32()), ("g", pa.int32())] + [(c, pa.binary()) for c in ("own", "at", "ids", "hashes")])


def group_windows(t: pa.Table, width: int, hashes: bool = True):
    """(ids, sort ids, word lists, counts, starts of windows, word hashes) of a group."""
    ids, sort_ids, raw = dealing.documents_of(t)
    split = [x.split() for x in raw]
    counts = np.array([len(w) for w in split], np.int64)
    if not hashes:
        return ids, sort_ids, split, counts, None, None
    known = WordHashes()
    h = np.concatenate([known.array(w) for w in split]) if split else np.zeros(0, np.uint64)
    at = np.flatnonzero(window_mask(counts, width, len(h) - width + 1))
    return ids, sort_ids, split, counts, at, h


def remove_repeats(docs: DataFrame, width: int = WINDOW, depth: int = DEPTH) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) for every document."""
    spark, size = docs.sparkSession, text_bytes(docs)
    groups = parallelism(spark, size, dealing.GROUP_BYTES)
    blocks = groups
    cells = dealing.cells_for(size / 6, blocks, CELLS_EACH)
    dealt = dealing.grouped(docs, groups)

    def sketch(t: pa.Table) -> pa.Table:
        *_, at, h = group_windows(t, width)
        return dealing.cells_table(dealing.sketch_rows(t.column("g")[0].as_py(), rolling(h, width, _FACTORS[0])[at], depth, blocks, cells))

    answers = dealt.groupBy("g").applyInArrow(sketch, dealing.CELLS).groupBy("b").applyInArrow(dealing.merged_answers, dealing.ANSWER)

    def repeated(t: pa.Table, told: pa.Table) -> pa.Table:
        if not told.num_rows:
            return _PAYLOAD.empty_table()
        g = t.column("g")[0].as_py()
        _, sort_ids, split, counts, at, h = group_windows(t, width)
        first = rolling(h, width, _FACTORS[0])[at]
        at_often = dealing.estimated_repeated(first, told, depth, blocks, cells)
        at, first = at[at_often], first[at_often]
        other = WordHashes(1)  # a second hash of the words themselves
        second = (mix(rolling(np.concatenate([other.array(w) for w in split]), width, _FACTORS[1])[at]) >> np.uint64(32)).astype(np.uint32) if len(at) else np.zeros(0, np.uint32)
        order = np.lexsort((at, second, first))
        a, b = first[order], second[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(order) else np.zeros(0, bool)
        rows = [{"b": g % blocks, "g": g, "own": dealing.pack_sorted(np.sort(at[order[~new]]))}] if not new.all() else []
        sel = np.sort(order[new])
        at, first, second = at[sel], first[sel], second[sel]
        doc = sort_ids[np.searchsorted(row_starts(counts), at, "right") - 1]
        block = mix(first) % np.uint64(blocks)
        order = np.argsort(block, kind="stable")
        cut = np.searchsorted(block[order], np.arange(blocks + 1, dtype=np.uint64))
        for k in np.flatnonzero(np.diff(cut)):
            i = order[cut[k] : cut[k + 1]]
            rows.append({"b": int(k), "g": g, "at": dealing.pack_sorted(at[i]), "ids": dealing.squeeze(np.diff(doc[i], prepend=np.int64(0)).tobytes()), "hashes": first[i].tobytes() + second[i].tobytes()})
        return pa.Table.from_pylist(rows, _PAYLOAD)

    payload = dealt.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(repeated, PAYLOAD)

    def exact(t: pa.Table) -> pa.Table:
        out, groups_, at, ids, first, second = [], [], [], [], [], []
        for r in t.to_pylist():
            if r["own"] is not None:
                out.append({"g": r["g"], "b": -1, "data": r["own"]})
                continue
            at.append(dealing.unpack_sorted(r["at"]))
            n = len(at[-1])
            groups_.append(np.full(n, r["g"]))
            ids.append(np.cumsum(np.frombuffer(dealing.unsqueeze(r["ids"]), np.int64)))
            first.append(np.frombuffer(r["hashes"][: 8 * n], np.uint64))
            second.append(np.frombuffer(r["hashes"][8 * n :], np.uint32))
        if at:
            at, ids, first, second, of = (np.concatenate(x) for x in (at, ids, first, second, groups_))
            order = np.lexsort((ids, second, first))
            a, b = first[order], second[order]
            later = order[1:][(a[1:] == a[:-1]) & (b[1:] == b[:-1])]
            for g in np.unique(of[later]):
                out.append({"g": int(g), "b": 0, "data": dealing.pack_sorted(np.sort(at[later[of[later] == g]]))})
        return pa.Table.from_pylist(out, dealing._ANSWER)

    found = payload.groupBy("b").applyInArrow(exact, dealing.ANSWER)
    kept = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])

    def cut_out(t: pa.Table, told: pa.Table) -> pa.Table:
        ids, _, split, counts, _, _ = group_windows(t, width, hashes=False)
        step, begin = np.zeros(int(counts.sum()) + 1, np.int64), row_starts(counts)
        for data in told.column("data").to_pylist():
            at = dealing.unpack_sorted(data)
            np.add.at(step, at, 1)
            np.add.at(step, at + width, -1)
        gone = np.cumsum(step)[:-1] > 0
        lost = [int(gone[begin[i] : begin[i + 1]].sum()) for i in range(len(ids))]
        texts = [b" ".join([w for w, x in zip(words, gone[begin[i] : begin[i + 1]].tolist()) if not x] if lost[i] else words) for i, words in enumerate(split)]
        return pa.Table.from_arrays([pa.array(ids, pa.int64()), pa.array(counts), pa.array(lost, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], schema=kept)

    return dealt.groupBy("g").cogroup(found.groupBy("g")).applyInArrow(cut_out, "doc_id long, n_words long, n_removed long, kept_text string")


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that every document loses, and a digest of those it keeps."""
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def oracle() -> str:
    return f"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    wins AS (SELECT doc_id, i, md5(array_to_string(w[i : i + {WINDOW - 1}], ' ')) AS win
             FROM (SELECT doc_id, w, unnest(range(1, CAST(len(w) - {WINDOW} + 2 AS BIGINT))) AS i FROM d WHERE len(w) >= {WINDOW})),
    later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS n FROM wins) WHERE n > 1),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM later),
    words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
    kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY words.doc_id)
    SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
    FROM d LEFT JOIN kept USING (doc_id)
    """
