"""Token ids in a binary form: frequency-ranked ids, byte-aligned variable-length coding.

The format is a Parquet table of blocks. A block holds whole documents in ascending doc_id order:
(part, block, start, n_tokens, doc_ids, lengths, control, data). Ids are replaced by their rank
by frequency, so that common ones take one byte. control has two bits an id, four ids a byte,
lowest bits first: the number of bytes less one. data has the ranks' bytes, little-endian and
without padding. doc_ids (signed 64-bit) and lengths (unsigned 32-bit) are per document. start
counts the ids of earlier blocks of the same part; parts follow each other in doc_id order.
A second table has the ranks' ids. A null doc_id stands for the first place in the order.
"""

from __future__ import annotations

import gc
import string
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
BLOCK_IDS = 1 << 17
#: Pieces whose ids a worker remembers in each of two generations.
CACHE_PIECES = 300_000

_LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)

def _byte_letters() -> dict[int, str]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 for itself, the rest from U+0100 on in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = _byte_letters()
_BLANK = _LETTERS[32]
#: UTF-16 units of the bytes' stand-ins; a blank stays one, since it separates the pieces.
_SPELT = np.array([32 if b == 32 else ord(_LETTERS[b]) for b in range(256)], "<u2")
#: White space that a blank may touch, and white space outside ASCII: texts with these are not cut at blanks.
_RUNS = [
    b"  ", b" \n", b"\n ", b"\n\n", b"\t", b"\r", b"\x0b", b"\x0c", b"\x1c", b"\x1d", b"\x1e",
    b"\x1f", b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80",
]
#: Marks the first piece of a text; texts that hold it are not cut.
_MARK = b"\x01"
#: 1 for a blank or line break, 2 for bytes that are in or begin other white space, or are the mark.
_KIND = np.zeros(256, np.uint8)
_KIND[[32, 10]] = 1
_KIND[[1, 9, 11, 12, 13, 28, 29, 30, 31, 0xC2, 0xE1, 0xE2, 0xE3]] = 2


def _plain(raw: np.ndarray) -> bool:
    """Whether text bytes surely hold none of _RUNS and no mark."""
    kind = _KIND[raw]
    return not (kind[1:] & kind[:-1] & 1).any() and not (kind == 2).any()


class PieceEncoder:
    """Encodes texts with the tokenizers library, remembering the ids of pieces.

    The pre-tokenizer never joins what stands before a single blank or line break with what
    follows it, so a text cut there is encoded as its pieces are. Texts with longer runs of
    white space are encoded whole.
    """

    def __init__(self, name: str):
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(public_tokenizers.path(name))
        self.tokenize = self.encoder.model.tokenize
        self.width = "H" if self.encoder.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "I"
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.marks: dict[str, list[int]] = {}
        self.met = bytearray(1 << 21)  # a bit per hash of the pieces met so far
        # the short way to the model is taken only where it gives what the library's own way gives
        samples = ["word", "Straße", "ciónñado,", "e", "naïveté...", "日本", "don!?", "œuvre)", "\nNew", "\nÉtat."]
        straight, ends, late = self.simple([x.encode() for x in samples])
        self.direct = not late and [straight[a:b] for a, b in zip([0, *ends], ends)] == self.whole([x if x[0] == "\n" else " " + x for x in samples])

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array(self.width, e.ids).tobytes() for e in self.encoder.encode_batch_fast(texts, add_special_tokens=False)]

    def mark(self, text: str) -> list[int]:
        """The ids of a run of ASCII punctuation or a line break."""
        if text not in self.marks:
            self.marks[text] = [t.id for t in self.tokenize("".join(_LETTERS[b] for b in text.encode()))]
        return self.marks[text]

    def simple(self, pieces: list[bytes]) -> tuple[bytes, list[int], list[int]]:
        """Pieces straight to the library's model -> (all ids, the bytes of them where each piece's end, places of pieces that can't go this way).

        A piece can if it has letters, or letters and then ASCII punctuation, after a blank or a
        line break: up to three pre-tokens, each of which the pre-tokenizer keeps whole.
        """
        joined = b" ".join(pieces)
        spelt = _SPELT[np.frombuffer(joined, np.uint8)].tobytes().decode("utf-16-le").split(" ")
        ids: list[int] = []
        ends: list[int] = []
        late: list[int] = []
        tokenize, mark, known, width = self.tokenize, self.mark, self.young.get, self.width
        for piece, text, letters in zip(pieces, joined.decode().split(" "), spelt):
            if text.isalpha():
                ids += [t.id for t in tokenize(_BLANK + letters)]
            else:
                blank = _BLANK
                if text[:1] == "\n":
                    ids += mark("\n")
                    blank, text, letters = "", text[1:], letters[1:]
                stem = text.rstrip(string.punctuation)
                tail = len(text) - len(stem)
                if stem.isalpha():
                    if blank and tail and (held := known(piece[:-tail])) is not None:  # met without the punctuation
                        ids += array(width, held)
                    else:
                        ids += [t.id for t in tokenize(blank + letters[: len(letters) - tail])]
                    if tail:
                        ids += mark(text[len(stem) :])
                else:
                    late.append(len(ends))
            ends.append(len(ids))
        size = array(self.width).itemsize
        return array(self.width, ids).tobytes(), [n * size for n in ends], late

    def learn(self, missing: list[bytes]) -> list[bytes]:
        """The ids of pieces as split: those after a blank lack it, those after a line break begin with it.

        Pieces that are met for the first time are not remembered.
        """
        out: list = list(map(self.old.get, missing))
        todo = [i for i, ids in enumerate(out) if ids is None]
        if todo and self.direct:
            raw, ends, late = self.simple([missing[i] for i in todo])
            first = 0
            for i, end in zip(todo, ends):
                out[i] = raw[first:end]
                first = end
            todo = [todo[i] for i in late]
        for k in range(0, len(todo), 4096):
            part = [missing[i] for i in todo[k : k + 4096]]
            for i, ids in zip(todo[k : k + 4096], self.whole([(p if p[:1] == b"\n" else b" " + p).decode() for p in part])):
                out[i] = ids
        met, young = self.met, self.young
        for piece, ids in zip(missing, out):
            at = hash(piece) & 0xFFFFFF
            if met[at >> 3] >> (at & 7) & 1:
                young[piece] = ids
            else:
                met[at >> 3] |= 1 << (at & 7)
        return out

    def ids_of(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of distinct pieces as split."""
        if len(self.young) > CACHE_PIECES:
            self.old, self.young = self.young, {}
        ids: list = list(map(self.young.get, pieces))
        missing = [i for i, x in enumerate(ids) if x is None]
        for i, x in zip(missing, self.learn([pieces[i] for i in missing])):
            ids[i] = x
        return ids

    def encode(self, texts: list[bytes], end: bytes = b"") -> tuple[np.ndarray, memoryview]:
        """encoded() without collecting garbage, since many small objects come and go here and none are in cycles."""
        gc.disable()
        try:
            return self.encoded(texts, end)
        finally:
            gc.enable()

    def encoded(self, texts: list[bytes], end: bytes = b"") -> tuple[np.ndarray, memoryview]:
        """Texts -> (offsets, data): where each text's ids begin and the last ones end in data; end follows each text's ids.

        All texts are split at once and each distinct piece is looked up once. A text's first
        piece, and a text that can't be cut, is marked by a byte 1 in front, and brings the end
        of the text before it.
        """
        joined = b" \x00".join(texts)
        bare = _plain(np.frombuffer(joined, np.uint8)) or not any(x in joined for x in (*_RUNS, _MARK))
        parts, first = [], {}
        for i, text in enumerate(texts):
            if not text or text[:1] in b" \n" or text[-1:] in b" \n" or not bare and any(x in text for x in (*_RUNS, _MARK)):
                parts.append(_MARK * 2 + b"%d" % i)
                first[parts[-1]] = text
            else:
                parts.append(_MARK + text)
        joined = b" ".join([*parts, _MARK]).replace(b"\n", b" \n")
        pieces = pc.split_pattern(pa.array([joined], pa.large_binary()), b" ").values.dictionary_encode()
        place, spelt = pieces.indices, pieces.dictionary
        cuts = np.frombuffer(spelt.buffers()[1], np.int64).tolist()
        text = spelt.buffers()[2].to_pybytes()
        distinct = [text[a:b] for a, b in zip(cuts, cuts[1:])]
        is_first = np.zeros(len(distinct), bool)
        is_first[[i for i, p in enumerate(distinct) if p[:1] == _MARK]] = True
        ids: list = self.ids_of([p for p in distinct if p[:1] != _MARK])
        heads = np.flatnonzero(is_first).tolist()
        for i, x in zip(heads, self.whole([first.get(distinct[i], distinct[i][1:]).decode() for i in heads])):
            ids.insert(i, end + x)  # few, and in ascending order
        values = pa.array(ids, pa.large_binary()).take(place)
        starts = np.flatnonzero(is_first[place.to_numpy()])
        offsets = np.frombuffer(values.buffers()[1], np.int64)[starts] + len(end)
        return offsets, memoryview(values.buffers()[2] or b"")


_ENCODERS: dict[str, PieceEncoder] = {}


def _encode(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _ENCODERS:
            _ENCODERS[name] = PieceEncoder(name)
        encoder = _ENCODERS[name]
        end, kind, total = array(encoder.width, [END_ID]).tobytes(), np.dtype(encoder.width), np.zeros(0, np.int64)
        names = ["doc_id", "ids", "tally"]
        for batch in batches:
            for first, last, raw, offsets in common.text_blocks(batch.column(1), 1 << 20):
                data, cuts = raw.tobytes(), offsets.tolist()
                where, ids = encoder.encode([data[a:b] for a, b in zip(cuts, cuts[1:])], end)
                used = ids[where[0] : where[-1]]
                n = np.bincount(np.frombuffer(used, kind), minlength=len(total))
                n[: len(total)] += total
                total = n
                column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), last - first, [None, pa.py_buffer(where.astype(np.int64)), pa.py_buffer(ids)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), column, pa.nulls(last - first, pa.binary())], names)
        at = np.flatnonzero(total)
        tally = np.stack([at, total[at]]).astype("<i8").tobytes()
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([tally], pa.binary())], names)
        common.give_back()

    return run


def encoded(docs: DataFrame, name: str = TOKENIZER) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, ids, tally).

    ids are those of the text with the end id, as unsigned 16-bit (32-bit for larger
    vocabularies). Each task adds a row without ids whose tally has the ids that it met and, after them, how often.
    """
    return docs.select("doc_id", "text").mapInArrow(_encode(name), "doc_id long, ids binary, tally binary")


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for tally in batch.column(0):
            ids, n = np.frombuffer(tally.as_buffer(), "<i8").reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n)], ["id", "n"])


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Ranks -> control bytes and data bytes."""
    high = int(ranks.max(initial=0))
    kind = np.dtype("<u1" if high < 1 << 8 else "<u2" if high < 1 << 16 else "<u4")
    ranks = ranks.astype(kind)
    extra = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    for k in range(1, kind.itemsize):
        extra[: len(ranks)] += ranks >= 1 << 8 * k
    quads = extra.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    keep = np.empty((len(ranks), kind.itemsize), bool)
    for k in range(kind.itemsize):
        keep[:, k] = extra[: len(ranks)] >= k
    return control.astype(np.uint8).tobytes(), ranks.view(np.uint8)[keep.reshape(-1)].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks of control and data bytes: lengths by table, then gathered bytes."""
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    ends = np.cumsum(lengths, dtype=np.int64)
    starts = ends - lengths
    raw = np.frombuffer(data, np.uint8)
    out = raw[starts].astype(np.uint32) if n else np.empty(0, np.uint32)
    for k in range(1, int(lengths.max(initial=1))):
        more = np.flatnonzero(lengths > k)
        out[more] |= raw[starts[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


BLOCKS = "part int, block int, start long, n_tokens long, doc_ids binary, nulls int, lengths binary, control binary, data binary"


def _blocks(dtype: str, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = shared.value
        part, block, start = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            keys = batch.column(0)
            numbers = keys.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8")
            missing = keys.is_null().to_numpy(zero_copy_only=False)
            for first, last, raw, offsets in common.text_blocks(batch.column(1), BLOCK_IDS * np.dtype(dtype).itemsize):
                lengths = (np.diff(offsets) // np.dtype(dtype).itemsize).astype("<u4")
                control, data = pack(ranks[raw.copy().view(dtype)])
                n = int(lengths.sum(dtype=np.int64))
                row = [part, block, start, n, numbers[first:last].tobytes(), int(missing[first:last].sum()), lengths.tobytes(), control, data]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], [c.split()[0] for c in BLOCKS.split(", ")])
                block, start = block + 1, start + n
        common.give_back()

    return run


@dataclass(frozen=True)
class Files:
    blocks: str
    ranks: str


def write(docs: DataFrame, path: str, name: str = TOKENIZER) -> Files:
    """Encodes docs and writes the two tables under path. Copies keep an entry each; order among equal doc_ids is by a hash of the ids."""
    spark = docs.sparkSession
    found = common.stored(encoded(docs, name), "token-ids", "zstd")
    from tokenizers import Tokenizer

    dtype = "<u2" if Tokenizer.from_file(public_tokenizers.path(name)).get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
    counts = found.where("tally is not null").select("tally").mapInArrow(_frequencies, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    ordered = counts.toPandas().sort_values(["n", "id"], ascending=[False, True])  # a row for each id of the vocabulary at most
    files = Files(f"{path}/blocks", f"{path}/ranks")
    spark.createDataFrame(ordered.assign(rank=np.arange(len(ordered)))[["rank", "id", "n"]], "rank long, id long, n long").write.parquet(files.ranks)
    ranks = np.zeros(int(ordered["id"].max()) + 1 if len(ordered) else 1, dtype)
    ranks[ordered["id"].to_numpy()] = np.arange(len(ordered))
    shared = spark.sparkContext.broadcast(ranks)
    ids = found.where("ids is not null").select("doc_id", "ids", F.xxhash64("ids").alias("mark"))
    placed = ids.repartitionByRange("doc_id", "mark").sortWithinPartitions("doc_id", "mark", "ids").select("doc_id", "ids")
    placed.mapInArrow(_blocks(dtype, shared), BLOCKS).write.parquet(files.blocks)
    return files


def _decode(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
                ids = ids_of[unpack(row["control"], row["data"], row["n_tokens"])].astype("<u4")
                ends = np.cumsum(lengths)
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - lengths).tolist(), ends.tolist())]
                keys = np.frombuffer(row["doc_ids"], "<i8")
                missing = np.arange(len(keys)) < row["nulls"]
                yield pa.RecordBatch.from_arrays([pa.array(keys, mask=missing), pa.array(row["before"] + row["start"] + ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read(spark: SparkSession, files: Files) -> DataFrame:
    """The files -> (doc_id, start, n_tokens, ids_crc32), decoded from the blocks."""
    ranks = spark.read.parquet(files.ranks).orderBy("rank").toPandas()
    shared = spark.sparkContext.broadcast(ranks["id"].to_numpy(np.uint32))
    blocks = spark.read.parquet(files.blocks)
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row for each shuffle partition
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return blocks.join(F.broadcast(before), "part").mapInArrow(_decode(shared), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_ids(docs: DataFrame, path: str | None = None, name: str = TOKENIZER) -> DataFrame:
    """documents -> (doc_id, start, n_tokens, ids_crc32), from files written under path and read back.

    A null text is empty and has the end id alone. Null doc_ids come first in the order. No
    rows give no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    return read(spark, write(docs, path or common.fresh_path(spark, "token-files"), name))


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(common.table(spark, sf_dir, "documents"))


QUERIES = {"op7_token_ids": op7_token_ids}
ORACLE_SQL: dict[str, str] = {}
