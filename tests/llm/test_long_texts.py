"""Very long texts: memory stays bounded and results are those of the whole text."""

from __future__ import annotations

import resource

import numpy as np
import pyarrow as pa

from kestrelog.llm import common, langid


class Shared:
    def __init__(self, value):
        self.value = value


def model(languages: int) -> langid.Model:
    rng = np.random.default_rng(1)
    language, gram, n = [], [], []
    for i in range(languages):
        raw = rng.integers(97, 123, 4_000).astype(np.uint8)
        keys, count = np.unique(langid._codes(raw, np.array([0, len(raw)])), return_counts=True)
        language.append(np.full(len(keys), i))
        gram.append(keys.astype(np.int64))
        n.append(count)
    return langid.Model(tuple(f"l{i:02}" for i in range(languages)), (langid.tables(*map(np.concatenate, (language, gram, n)), languages),))


def test_pieces_add_up_to_the_whole(monkeypatch):
    tables = model(5).groups[0]
    rng = np.random.default_rng(2)
    raw = rng.integers(95, 125, 5_000).astype(np.uint8)
    offsets = np.sort(np.append(rng.integers(0, 5_000, 20), [0, 0, 5_000, 5_000]))
    whole = common.row_sums(langid._costs(tables, raw, offsets), offsets)
    for size in (1, 2, 3, 7, 100, 4_999):
        monkeypatch.setattr(common.pieces, "__defaults__", (size,))
        assert np.allclose(langid.code_lengths(tables, raw, offsets), whole)
        assert np.allclose(common.row_sums(raw.astype(np.float64), offsets), [raw[a:b].sum() for a, b in zip(offsets, offsets[1:])])


def test_a_hundred_megabytes_in_sixteen_languages():
    known = model(16)
    text = pa.array(["abcdefghij klmnop " * 5_600_000, "short"])
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    (got,) = langid._predict(Shared(known))(iter([pa.RecordBatch.from_arrays([pa.array([1, 2]), text], ["doc_id", "text"])]))
    assert got.column(1)[0].as_py() in known.languages
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024 < 1_000
