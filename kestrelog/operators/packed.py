"""Lengths of documents' weight vectors from packed terms.

The terms of some documents together are a pack. Each distinct term is in it once, as hashes, with the places of its documents
and its counts there; a pack is cut into slices of the range of hashes. A task that has a slice of all packs knows how many
documents a term has and adds up the squared weights of each pack's documents. Numbers are stored by planes of bytes, which compress.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Characters of text whose terms a slice has, at the least; terms that a pack has unless a document has more, and its documents at the most.
SLICE_CHARS, PACK_TERMS, PACK_DOCS = 16 << 20, 2 << 20, 1 << 16
#: Documents whose sums a task holds.
HELD = 4 << 20

#: ids come with one row of a pack. docs: the number of documents a distinct term has, at and c: their places and the term's counts, in order.
PACKED = "slice int, pack binary, size int, ids binary, h binary, g binary, docs binary, at binary, c binary"
SUMS = "pack binary, ids binary, sums binary"
_COLUMNS = [c.split()[0] for c in PACKED.split(", ")]
_TYPES = {"slice": pa.int32(), "size": pa.int32()}


def _planes(a: np.ndarray) -> bytes:
    return a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def _numbers(raw: pa.Scalar, kind: type) -> np.ndarray:
    return np.frombuffer(raw.as_buffer(), np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def _runs(h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of terms by both hashes, and where in it another term begins."""
    order = np.lexsort((g, h))
    h, g = h[order], g[order]
    return order, np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])]))


def _ids(column: pa.Array) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, pa.schema([("id", column.type)])) as writer:
        writer.write_batch(pa.RecordBatch.from_arrays([column], ["id"]))
    return out.getvalue().to_pybytes()


def _pack(ids: pa.Array, lengths: np.ndarray, h: np.ndarray, g: np.ndarray, slices: int) -> pa.RecordBatch:
    order, first = _runs(h, g)
    h, g, at = h[order[first]], g[order[first]], np.repeat(np.arange(len(lengths), dtype=np.uint16), lengths)[order]
    other = np.concatenate([[True], at[1:] != at[:-1]])  # a term's documents are in order
    other[first] = True
    each = np.flatnonzero(other)
    at, c = at[each], np.diff(np.append(each, len(order))).astype(np.uint32)
    ends = np.append(np.searchsorted(each, first), len(each))
    docs = np.diff(ends).astype(np.uint32)
    of = ((h >> np.uint64(32)) * np.uint64(slices)) >> np.uint64(32)  # grows with h
    cuts = np.searchsorted(of, np.arange(slices + 1, dtype=np.uint64))
    there, raw = np.flatnonzero(np.diff(cuts)), _ids(ids)
    pack = hashlib.blake2b(raw, digest_size=16).digest()  # the same if a task is tried again
    bearer = int.from_bytes(pack[:4], "little") % len(there)
    rows = []
    for k, s in enumerate(there.tolist()):
        a, b = cuts[s], cuts[s + 1]
        x, y = ends[a], ends[b]
        rows.append((s, pack, len(lengths), raw if k == bearer else None, *map(_planes, (h[a:b], g[a:b], docs[a:b], at[x:y], c[x:y]))))
    return pa.RecordBatch.from_arrays([pa.array(v, _TYPES.get(name, pa.binary())) for name, v in zip(_COLUMNS, zip(*rows))], _COLUMNS)


def pack(slices: int):
    """(id, t), t the hashes (h, g) of a document's terms, repeats included and not empty -> PACKED."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ends, terms = batch.column(1).offsets.to_numpy(), batch.column(1).flatten()
            h, g, ends = terms.field(0).to_numpy().view(np.uint64), terms.field(1).to_numpy().astype(np.uint16), ends - ends[0]
            first = 0
            while first < batch.num_rows:
                last = int(np.searchsorted(ends, ends[first] + PACK_TERMS, side="right")) - 1
                last = max(first + 1, min(last, first + PACK_DOCS))
                own = slice(ends[first], ends[last])
                yield _pack(batch.column(0).slice(first, last - first), np.diff(ends[first : last + 1]), h[own], g[own], slices)
                first = last

    return run


def weigh(n: int):
    """PACKED of n documents, by slice -> SUMS: the sums of squared weights of each pack's documents."""

    def add(rows: list[dict], sums: dict) -> None:
        terms = [(_numbers(r["h"], np.uint64), _numbers(r["g"], np.uint16), _numbers(r["docs"], np.uint32)) for r in rows]
        h, g, docs = map(np.concatenate, zip(*terms))
        order, first = _runs(h, g)
        whole = np.add.reduceat(docs[order].astype(np.int64), first)
        idf = np.empty(len(order))
        idf[order] = np.repeat(np.log((1.0 + n) / (1 + whole)) + 1, np.diff(np.append(first, len(order))))
        ends = np.cumsum([0] + [len(t[0]) for t in terms])
        for r, a, b in zip(rows, ends, ends[1:]):
            w = (1 + np.log(_numbers(r["c"], np.uint32).astype(np.float64))) * np.repeat(idf[a:b], docs[a:b])
            own = np.bincount(_numbers(r["at"], np.uint16), w * w, r["size"].as_py())
            pack = r["pack"].as_py()
            sums[pack] = sums[pack] + own if pack in sums else own

    def out(sums: dict, ids: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.binary()), pa.array([ids.get(k) for k in sums], pa.binary()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["pack", "ids", "sums"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, sums, ids = [], None, {}, {}
        for batch in batches:
            for k, s in enumerate(batch.column(0).to_pylist()):
                if s != at and held:
                    add(held, sums)
                    held = []
                    if sum(map(len, sums.values())) > HELD:
                        yield out(sums, ids)
                        sums, ids = {}, {}
                row = {name: batch.column(i)[k] for i, name in enumerate(_COLUMNS)}
                if row["ids"].is_valid:
                    ids[row["pack"].as_py()] = row["ids"].as_py()
                held.append(row)
                at = s
        if held:
            add(held, sums)
        if sums:
            yield out(sums, ids)

    return run


def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SUMS by pack -> (id, norm)."""

    def out(ids: bytes, total: np.ndarray) -> pa.RecordBatch:
        column = pa.ipc.open_stream(ids).read_all().column(0).combine_chunks()
        return pa.RecordBatch.from_arrays([column, pa.array(np.sqrt(total))], ["id", "norm"])

    at, ids, total = None, None, None
    for batch in batches:
        for pack, its, sums in zip(*[c.to_pylist() for c in batch.columns]):
            if pack != at and at is not None:
                yield out(ids, total)
            if pack != at:
                at, ids, total = pack, None, 0.0
            ids, total = its or ids, total + np.frombuffer(sums)
    if at is not None:
        yield out(ids, total)
