"""SentencePiece encoding with byte offsets into the original text, and decoding."""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct runs whose pieces a task remembers; the store is emptied when full.
MEMORY = 300_000
SPACE = "▁"


class CharacterMap:
    """A model's compiled character map: a double-array trie over UTF-8 keys and zero-ended replacements.

    The blob starts with the trie's size in bytes; its units carry an offset (bits 10-30, with bit 9 as a shift by 8), a
    leaf mark (bit 8) and a label. The longest key that starts at a place is replaced; a character without one stays.
    """

    def __init__(self, blob: bytes):
        n = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", n // 4, 4).tolist() if blob else []
        self.texts = blob[4 + n :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes read, replacement) of the longest key at a place."""
        units, best = self.units, None
        if not units:
            return None
        offset = lambda u: (u >> 10) << ((u & 512) >> 6)
        node = offset(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units) or units[node] & 0x800000FF != data[i]:
                break
            unit = units[node]
            node ^= offset(unit)
            if unit >> 8 & 1:
                best = i + 1 - at, units[node] & 0x7FFFFFFF
        return best and (best[0], self.texts[best[1] : self.texts.index(b"\0", best[1])])

    def apply(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes and, for each of them and the end, its place in data."""
        out, places, at = bytearray(), [], 0
        while at < len(data):
            found = self.longest(data, at)
            if found:
                read, new = found
            else:
                read = 1
                while at + read < len(data) and data[at + read] & 0xC0 == 0x80:
                    read += 1
                new = data[at : at + read]
            out += new
            places += [at] * len(new)
            at += read
        return bytes(out), np.asarray([*places, len(data)], np.int64)


class PieceEncoder:
    """Ids of whole texts as the library gives them, with the original byte span of every piece."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        spec = proto.normalizer_spec
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        pieces = [p.piece for p in proto.pieces]
        # Runs can be encoded apart where no piece joins a space mark to what stands before it, and none has a line end.
        self.apart = proto.trainer_spec.byte_fallback and spec.escape_whitespaces and not proto.trainer_spec.treat_whitespace_as_suffix and all(p.type in (1, 2, 3, 6) for p in proto.pieces) and not any(re.search(f"[^{SPACE}]{SPACE}|\n", p) for p in pieces)
        # A mark that the text itself holds is the same sign as a space then, so a row of either is never cut.
        self.runs = re.compile(f"\n|[ {SPACE}]+[^ {SPACE}\n]*|[^ {SPACE}\n]+")
        self.width = [1 if p.type == 6 else len(p.piece.encode()) for p in proto.pieces]
        self.narrow = [w if p.type == 6 else w - 2 * p.piece.count(SPACE) for w, p in zip(self.width, proto.pieces, strict=True)]
        # A processor for text that is normalised already.
        spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces = b"", False, False
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.known: dict[str, tuple[bytes, bytes]] = {}

    def learn(self, runs: set[str]) -> None:
        """Remembers ids and covered bytes of runs not met yet; a space mark counts as the one byte it stands for."""
        if len(self.known) + len(runs) > MEMORY:
            self.known.clear()
        new = [r for r in runs if r not in self.known]
        for run, ids in zip(new, self.plain.encode(new, num_threads=1) if new else (), strict=True):
            if SPACE in run:  # marks that the text itself holds are three bytes there too
                places = [0, *accumulate(w for c in run for w in ((0, 0, 1) if c == " " else (1,) * len(c.encode())))]
                ends = [places[e] for e in accumulate(self.width[i] for i in ids)]
                widths = [b - a for a, b in zip([0, *ends], ends, strict=False)]
            else:
                table = self.narrow if " " in run else self.width
                widths = [table[i] for i in ids]
            self.known[run] = array("i", ids).tobytes(), array("i", widths).tobytes()

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, first byte, end byte) of every piece of each text; spans lie in the UTF-8 bytes of the text as it was given."""
        prepared = [self.prepare(text) for text in texts]
        self.learn(set().union(*(runs for runs, _ in prepared)))
        return [self.project(runs, places) for runs, places in prepared]

    def prepare(self, text: str) -> tuple[list[str], np.ndarray | None]:
        """Runs of the normalised text, and the original place of each of its bytes where normalising moved any."""
        places = None
        if text and (self.map.units or self.squeeze):
            norm, places = self.map.apply(text.encode())
            if self.squeeze:
                norm, places = _squeezed(norm, places)
            text = norm.decode("utf-8", "replace")
        if not text:
            return [], None
        text = " " + text if self.prefix else text
        return (self.runs.findall(text) if self.apart else [text]), places

    def project(self, runs: list[str], places: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts = [self.known[r] for r in runs]
        ids = np.frombuffer(b"".join([p[0] for p in parts]), "<i4")
        ends = np.cumsum(np.frombuffer(b"".join([p[1] for p in parts]), "<i4"), dtype=np.int64) - int(self.prefix)
        begins = np.maximum(np.concatenate([[0], ends[:-1]]), 0)[: len(ids)]
        ends = np.maximum(ends, 0)
        if places is not None:
            begins, ends = places[begins], places[ends]
        return ids, begins, ends


def _squeezed(norm: bytes, places: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Without leading, trailing and repeated spaces."""
    data = np.frombuffer(norm, np.uint8)
    space = data == 32
    keep = ~(space & np.concatenate([[True], space[:-1]]))
    if keep.any() and space[np.flatnonzero(keep)[-1]]:
        keep[np.flatnonzero(keep)[-1]] = False
    last = np.flatnonzero(keep)
    end = places[last[-1] + 1] if len(last) else 0
    return data[keep].tobytes(), np.append(places[:-1][keep], end)


def encode_pieces(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids, begins, ends and decoded for every row of docs (doc_id, text).

    ids are those of the library without begin or end marks; piece i covers bytes begins[i] to ends[i] of the original
    text, and the spans follow each other; decoded is the library's decoding of ids. Null and empty texts give empty lists
    and an empty text. Ids of documents are passed through, null or repeated. Whole texts are read whatever their length.
    The driver alone reads the model's file, some 500 kB; its bytes travel with the tasks.
    """
    schema = "doc_id long, ids array<int>, begins array<int>, ends array<int>, decoded string"
    with open(model_path, "rb") as file:
        model = docs.sparkSession.sparkContext.broadcast(file.read())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder(model.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = encoder.encode_all([text or "" for text in part.column(1).to_pylist()])
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(f[0]) for f in found])]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([f[k] for f in found]).astype(np.int32))) for k in range(3)]
                decoded = pa.array([encoder.library.decode(f[0].tolist()) if len(f[0]) else "" for f in found], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), *lists, decoded], names=["doc_id", "ids", "begins", "ends", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, schema)
