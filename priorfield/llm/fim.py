"""Fill-in-the-middle over seekable compressed frames.

A text is stored as a row of independent zstandard frames of a bounded size, with the number of
units that begin before each frame. A cut is given in units: the counts name its frame, and only
that frame is decompressed to find the byte where the unit begins. Output texts are frames too:
frames between cuts are taken over as they are, only the pieces of cut frames and the sentinels are
compressed anew. Put behind each other, the frames of an output are one zstandard stream. Digests
and restored texts are streamed frame by frame, so memory never holds a long text whole.

Units are runs of ASCII letters and all other single code points: ``[A-Za-z]+|[^A-Za-z]``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialize

#: Bytes of text in a frame, and of rows in a batch handed to Spark.
FRAME, BATCH = 1 << 16, 4 << 20
LEVEL = 3
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
LETTER = np.zeros(256, dtype=bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
OUTPUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output array<binary>"


def unit_starts(raw: np.ndarray) -> np.ndarray:
    """Which bytes of an UTF-8 text begin a unit."""
    letter = LETTER[raw]
    start = (raw & 0xC0) != 0x80
    start[1:] &= ~(letter[1:] & letter[:-1])
    return start


def frame_edges(raw: np.ndarray, size: int) -> np.ndarray:
    """Frames of ``size`` bytes, each moved on to the next code point: the bytes where they begin, and the end."""
    edges = np.arange(0, max(len(raw), 1), size)
    for i in range(1, len(edges)):
        while edges[i] < len(raw) and raw[edges[i]] & 0xC0 == 0x80:
            edges[i] += 1
    return np.unique(np.append(edges, len(raw)))


def to_frames(text: bytes, size: int, pack) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The frames of a text, and the units and the code points that begin before each frame and in all."""
    raw = np.frombuffer(text, dtype=np.uint8)
    edges = frame_edges(raw, size)
    frames, units, chars = [], [0], [0]
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        own = raw[a:b]
        inside = a > 0 and LETTER[raw[a - 1]] and LETTER[raw[a]]  # the frame begins inside a unit
        units.append(units[-1] + int(unit_starts(own).sum()) - int(inside))
        chars.append(chars[-1] + int(((own & 0xC0) != 0x80).sum()))
        frames.append(pack.compress(text[a:b]))
    return frames, np.array(units), np.array(chars)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def _in_batches(sized: Iterable[tuple[int, tuple]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for more, row in sized:
        rows.append(row)
        size += more + 64
        if size >= BATCH:
            yield _batch(rows, schema)
            rows, size = [], 0
    if rows:
        yield _batch(rows, schema)


def store_frames(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frame: int = FRAME) -> DataFrame:
    """The texts as frames, written to the shared folder: doc_id, frames, units and chars (those before
    each frame, then all), marked (the text holds a sentinel). One row out per row in, in any order.

    Null texts count as empty; an empty text has no frame. Rows that repeat and null ids stay.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("frames", pa.list_(pa.binary())), ("units", pa.list_(pa.int64())), ("chars", pa.list_(pa.int64())), ("marked", pa.bool_())])

    def store(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, write_content_size=True)

        def rows():
            for batch in batches:
                for key, text in zip(batch.column(0), batch.column(1)):
                    text = text.as_py() or b""
                    frames, units, chars = to_frames(text, frame, pack)
                    marked = any(m in text for m in (PREFIX, SUFFIX, MIDDLE))
                    yield sum(map(len, frames)), (key.as_py(), frames, units, chars, marked)

        yield from _in_batches(rows(), schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    return materialize(rows.mapInArrow(store, "doc_id long, frames array<binary>, units array<long>, chars array<long>, marked boolean"))


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four unsigned 32-bit integers from the digest of seed and id; a null id counts as no digits."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i:i + 4], "big") for i in range(0, 16, 4)]


class _Cutter:
    """Splits the frames of one text at unit counts; decompresses the cut frames only."""

    def __init__(self, frames: list[bytes], units: np.ndarray, chars: np.ndarray, unpack):
        self.frames, self.units, self.chars, self.unpack = frames, units, chars, unpack
        self.open: dict[int, bytes] = {}

    def text(self, f: int) -> bytes:
        if f not in self.open:
            self.open[f] = self.unpack.decompress(self.frames[f])
        return self.open[f]

    def find(self, k: int) -> tuple[int, int, int]:
        """Where unit ``k`` begins: frame, byte in it, code points before."""
        if k == self.units[-1]:
            return len(self.frames), 0, int(self.chars[-1])
        f = int(np.searchsorted(self.units, k, side="right")) - 1
        raw = np.frombuffer(self.text(f), dtype=np.uint8)
        start = unit_starts(raw)
        start[0] = start.sum() == self.units[f + 1] - self.units[f]  # else the frame begins inside a unit
        at = int(np.flatnonzero(start)[k - self.units[f]])
        return f, at, int(self.chars[f]) + int(((raw[:at] & 0xC0) != 0x80).sum())

    def between(self, a: tuple[int, int, int], b: tuple[int, int, int]) -> Iterator[tuple[bool, bytes]]:
        """The pieces from a to b: (True, whole frame as stored) or (False, text)."""
        f, at = a[:2]
        while f < b[0]:
            yield (True, self.frames[f]) if at == 0 else (False, self.text(f)[at:])
            f, at = f + 1, 0
        if b[1] > at:
            yield False, self.text(f)[at:b[1]]


def joined(pieces: Iterable[tuple[bool, bytes]], pack) -> list[bytes]:
    """Frames of the pieces; texts that follow each other share a frame."""
    out, texts = [], []
    for whole, piece in chain(pieces, [(True, b"")]):
        if not whole:
            texts.append(piece)
            continue
        if texts:
            out.append(pack.compress(b"".join(texts)))
            texts = []
        if piece:
            out.append(piece)
    return out


def cut_text(doc_id, frames, units, chars, marked, seed, plain_from, spm_below, pack, unpack) -> tuple:
    """The row of ``OUTPUT`` of one stored text."""
    n = int(units[-1])
    h = draws(doc_id, seed)
    if n == 0 or marked or h[2] % 100 >= plain_from:
        return doc_id, n, "plain", None, None, frames
    cutter = _Cutter(frames, units, chars, unpack)
    begin, end = (0, 0, 0), (len(frames), 0, int(chars[-1]))
    one, two = (cutter.find(k) for k in sorted((h[0] % (n + 1), h[1] % (n + 1))))
    prefix, middle, suffix = (list(cutter.between(a, b)) for a, b in ((begin, one), (one, two), (two, end)))
    mark = lambda m: [(False, m)]
    form = "spm" if h[3] % 100 < spm_below else "psm"
    order = [(SUFFIX, suffix), (PREFIX, prefix)] if form == "spm" else [(PREFIX, prefix), (SUFFIX, suffix)]
    pieces = chain.from_iterable(mark(m) + part for m, part in [*order, (MIDDLE, middle)])
    return doc_id, n, form, one[2], two[2] - one[2], joined(pieces, pack)


def fill_in_middle(docs: DataFrame, seed: int = 1, plain_from: int = 90, spm_below: int = 20,
                   id_col: str = "doc_id", text_col: str = "text", frame: int = FRAME) -> DataFrame:
    """Cut every text into prefix, middle and suffix and put it into the form plain, psm or spm.

    Returns doc_id, n (units), form, prefix_chars and middle_chars (code points; null if plain) and
    ``output``: the frames of the output text. One row out per row in; the cuts follow from seed and
    id alone. A text is plain if it is empty, null or holds a sentinel, or by draw. Repeated rows get
    the same cuts; null ids share one draw. Other columns are not read, so their names may clash with
    those returned. An empty table gives no rows. A long text's frames are one row, as the text was;
    no row is shuffled.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()),
                        ("output", pa.list_(pa.binary()))])

    def cut(batches):
        import zstandard

        pack, unpack = zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()

        def rows():
            for batch in batches:
                for key, frames, units, chars, marked in zip(*batch.columns):
                    row = cut_text(key.as_py(), frames.as_py(), units.values.to_numpy(), chars.values.to_numpy(), marked.as_py(),
                                   seed, plain_from, spm_below, pack, unpack)
                    yield sum(map(len, row[-1])), row

        yield from _in_batches(rows(), schema)

    return store_frames(docs, id_col, text_col, frame).select("doc_id", "frames", "units", "chars", "marked").mapInArrow(cut, OUTPUT)


def sections(pieces: Iterable[bytes], marks: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """(sentinel, text behind it) of a stream that begins with the first sentinel and has all in this
    order; a section may come in several pieces, and a sentinel may lie across two."""
    own, left, rest = b"", list(marks), b""
    for piece in chain(pieces, [None]):
        rest += piece or b""
        while left and (at := rest.find(left[0])) >= 0:
            if own:
                yield own, rest[:at]
            own, rest = left[0], rest[at + len(left[0]):]
            left.pop(0)
        hold = len(left[0]) - 1 if left and piece is not None else 0
        if own and len(rest) > hold:
            yield own, rest[:len(rest) - hold]
            rest = rest[len(rest) - hold:]
    if left:
        raise ValueError("an output text lacks a sentinel")


def restored(form: str, pieces: Iterable[bytes]) -> Iterator[bytes]:
    """The original text, piece by piece, from the pieces of an output; the suffix waits in compressed frames."""
    if form == "plain":
        yield from pieces
        return
    import zstandard

    pack, unpack, waiting = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor(), []
    marks = [SUFFIX, PREFIX, MIDDLE] if form == "spm" else [PREFIX, SUFFIX, MIDDLE]
    for own, text in sections(pieces, marks):
        if own == SUFFIX:
            waiting.append(pack.compress(text))
        else:
            yield text
    yield from map(unpack.decompress, waiting)


def digests(outputs: DataFrame) -> DataFrame:
    """The rows of ``fill_in_middle`` with output_sha256 and restored_sha256 (lowercase hex) in place of the
    frames; the original texts are rebuilt from output and form alone."""
    fields = [("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())]
    schema = pa.schema([*fields, ("output_sha256", pa.string()), ("restored_sha256", pa.string())])

    def digest(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor()

        def both(form, frames):
            out, back = hashlib.sha256(), hashlib.sha256()

            def read():
                for frame in frames:
                    text = unpack.decompress(frame)
                    out.update(text)
                    yield text

            for text in restored(form, read()):
                back.update(text)
            return out.hexdigest(), back.hexdigest()

        for batch in batches:
            found = [both(form, frames) for form, frames in zip(batch.column(2).to_pylist(), (f.as_py() for f in batch.column(5)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string())], schema=schema)

    return outputs.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").mapInArrow(
        digest, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")


def output_texts(outputs: DataFrame) -> DataFrame:
    """The rows of ``fill_in_middle`` with the output as a string column ``text``."""
    fields = [("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())]
    schema = pa.schema([*fields, ("text", pa.string())])

    def read(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor()

        def rows():
            for batch in batches:
                for *own, frames in zip(*(c.to_pylist() for c in batch.columns)):
                    text = b"".join(map(unpack.decompress, frames)).decode()
                    yield len(text), (*own, text)

        yield from _in_batches(rows(), schema)

    return outputs.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").mapInArrow(
        read, "doc_id long, n long, form string, prefix_chars long, middle_chars long, text string")
