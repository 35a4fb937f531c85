"""Sketches and payloads that groups of documents deal to blocks of hash space, and the answers that come back.

Documents are dealt into groups by a hash of doc_id; a group fits a task. A group's hashes go to blocks of hash
space as compressed arrays, one row for each (group, block) pair that has any, and a block answers each group in
the order in which that group's entries came. So no sketch is ever gathered in one place or broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import mix

GROUP_BYTES = 12 << 20
ANSWER = "g int, b int, data binary"
_ANSWER = pa.schema([("g", pa.int32()), ("b", pa.int32()), ("data", pa.binary())])
CELLS = "b int, g int, data binary"
_CELLS = pa.schema([("b", pa.int32()), ("g", pa.int32()), ("data", pa.binary())])
_LAST = (1 << 63) - 1


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def unsqueeze(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack_sorted(x: np.ndarray) -> bytes:
    """Non-decreasing values below 2**63 as deltas, small ones in two byte planes."""
    d = np.diff(x.astype(np.int64), prepend=np.int64(0))
    wide = d >= 0xFFFF
    small = np.where(wide, 0xFFFF, d).astype("<u2")
    planes = small.view(np.uint8).reshape(-1, 2).T
    return squeeze(np.int64(len(d)).tobytes() + planes.tobytes() + d[wide].tobytes())


def unpack_sorted(data: bytes) -> np.ndarray:
    raw = unsqueeze(data)
    n = int(np.frombuffer(raw[:8], np.int64)[0])
    d = np.ascontiguousarray(np.frombuffer(raw[8 : 8 + 2 * n], np.uint8).reshape(2, n).T).view("<u2").ravel().astype(np.int64)
    d[d == 0xFFFF] = np.frombuffer(raw[8 + 2 * n :], np.int64)
    return np.cumsum(d)


def grouped(docs: DataFrame, groups: int) -> DataFrame:
    """(g, doc_id, text); rows of one doc_id share a group."""
    return docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("int").alias("g"), F.col("doc_id").cast("long").alias("doc_id"), "text")


def documents_of(t: pa.Table) -> tuple[list, np.ndarray, list[bytes]]:
    """(doc_ids as they are, sort ids, texts) of a group by doc_id, null last; equal ids by text."""
    ids = t.column("doc_id").to_pylist()
    raw = [b"" if x is None else x for x in t.column("text").combine_chunks().cast(pa.large_binary()).to_pylist()]
    order = sorted(range(len(ids)), key=lambda i: (_LAST if ids[i] is None else ids[i], raw[i]))
    ids = [ids[i] for i in order]
    return ids, np.array([_LAST if x is None else x for x in ids], np.int64), [raw[i] for i in order]


def cell_keys(h: np.ndarray, row: int, blocks: int, cells: int) -> np.ndarray:
    """Block (above bit 40) and cell of each hash in a row of the sketch."""
    c = mix(h ^ np.uint64(0xA0761D6478BD642F * (row + 1) & (1 << 64) - 1))
    return ((c >> np.uint64(40)) % np.uint64(blocks) << np.uint64(40)) | (c & np.uint64(cells - 1))


def sketch_rows(g: int, h: np.ndarray, depth: int, blocks: int, cells: int) -> list[dict]:
    """A group's sketch: for each row and block the sorted cells, one entry for each hash counted."""
    out = []
    for row in range(depth):
        keys = np.sort(cell_keys(h, row, blocks, cells))
        cut = np.searchsorted(keys >> np.uint64(40), np.arange(blocks + 1, dtype=np.uint64))
        for b in np.flatnonzero(np.diff(cut)):
            part = keys[cut[b] : cut[b + 1]] & np.uint64((1 << 40) - 1)
            out.append({"b": int(row * blocks + b), "g": g, "data": pack_sorted(part)})
    return out


def merged_answers(t: pa.Table) -> pa.Table:
    """Merge the sketches of one block: for each group a bit for each entry, set if its cell counts two or more."""
    b = t.column("b")[0].as_py()
    groups, parts = t.column("g").to_pylist(), [unpack_sorted(x) for x in t.column("data").to_pylist()]
    cells = np.concatenate(parts)
    order = np.argsort(cells, kind="stable")
    same = cells[order][1:] == cells[order][:-1]
    often = np.empty(len(cells), bool)
    often[order] = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    out, at = [], 0
    for g, p in zip(groups, parts):
        out.append({"g": g, "b": b, "data": squeeze(np.packbits(often[at : at + len(p)]).tobytes())})
        at += len(p)
    return pa.Table.from_pylist(out, _ANSWER)


def estimated_repeated(h: np.ndarray, answers: pa.Table, depth: int, blocks: int, cells: int) -> np.ndarray:
    """Which of a group's hashes count two or more in every row of the merged sketch."""
    told = dict(zip(answers.column("b").to_pylist(), answers.column("data").to_pylist()))
    often = np.ones(len(h), bool)
    for row in range(depth):
        keys = cell_keys(h, row, blocks, cells)
        order = np.argsort(keys, kind="stable")
        cut = np.searchsorted(keys[order] >> np.uint64(40), np.arange(blocks + 1, dtype=np.uint64))
        for b in np.flatnonzero(np.diff(cut)):
            bits = np.unpackbits(np.frombuffer(unsqueeze(told[int(row * blocks + b)]), np.uint8), count=int(cut[b + 1] - cut[b])).astype(bool)
            often[order[cut[b] : cut[b + 1]]] &= bits
    return often


def cells_table(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, _CELLS)


def cells_for(entries: float, blocks: int, each: int) -> int:
    """Cells of a block (a power of two) for `each` cells an entry."""
    return 1 << max(10, min(39, int(np.ceil(np.log2(max(1.0, each * entries / blocks))))))
