"""SentencePiece encoding and decoding with byte offsets.

The normaliser walks the model's compiled character map (a double-array trie followed by zero-terminated
replacements), always taking the longest prefix, and records for each normalised byte the source byte it came
from.  The library's pieces, which lie on the normalised text, are projected through that record to spans of the
original UTF-8 text.  A model without a map normalises only white space, which numpy does for a whole text at once.

Merges of this model family never join a word to the white space after it (checked when a model is loaded), so
a text longer than ``LONG`` is encoded in parts cut before a space.  Models for which the check fails are encoded whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import trim_memory

MARK = "▁"
_CUT = re.compile(rf"(?<=[^ \n{MARK}\0]) (?=[^ \n{MARK}\0])")


class CharsMap:
    """The compiled character map of a model: longest-prefix lookup in a double array."""

    def __init__(self, blob: bytes):
        self.units: np.ndarray | None = None
        self.texts = b""
        if len(blob) >= 4:
            n = int.from_bytes(blob[:4], "little")
            self.units = np.frombuffer(blob[4 : 4 + n], "<u4")
            self.texts = blob[4 + n :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(length, replacement) of the longest key that is a prefix of data[at:], or None."""
        if self.units is None or not len(self.units):
            return None
        u, best = self.units, None
        unit = int(u[0])
        node = (unit >> 10) << ((unit & 0x200) >> 6)
        for i in range(at, len(data)):
            c = data[i]
            if c == 0:
                break
            node ^= c
            if node >= len(u):
                break
            unit = int(u[node])
            if unit & 0x800000FF != c:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit >> 8 & 1:
                best = (i + 1 - at, int(u[node]) & 0x7FFFFFFF)
        if best is None:
            return None
        end = self.texts.index(b"\0", best[1])
        return best[0], self.texts[best[1] : end]


class Codec:
    """Encoder and decoder of one model file, equal to the library's encode(text) and decode(ids)."""

    LONG = 1 << 20  # characters encoded at once, where a text can be cut

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        self.chars = CharsMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        pieces = [p.piece for p in model.pieces]
        byte = {i for i, p in enumerate(model.pieces) if p.type == 6}
        self.unknown = self.sp.unk_id()
        self.width = np.array([1 if i in byte else len(p.encode()) for i, p in enumerate(pieces)])  # in normalised bytes
        self.decimal = [str(i) for i in range(len(pieces))]
        plain = self.chars.units is None and self.prefix and self.escape and not self.squeeze and not model.trainer_spec.treat_whitespace_as_suffix
        self.simple = plain and bool(byte)  # nothing to look up, and no unknown piece
        self.divisible = self.simple and model.trainer_spec.model_type == 2 and not any(p.type == 4 for p in model.pieces) and not any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces)

    def ids(self, text: str) -> list[int]:
        """The library's ids; a long text in parts cut before a space, which the next part's dummy prefix stands for."""
        if len(text) <= self.LONG or not self.divisible:
            return self.sp.encode(text)
        out: list[int] = []
        a = 0
        while a < len(text):
            m = _CUT.search(text, a + self.LONG) if len(text) - a > self.LONG else None
            out += self.sp.encode(text[a : m.start()] if m else text[a:])
            a = m.end() if m else len(text)
        return out

    def normalise(self, text: str) -> tuple[bytes, list[int]]:
        """Normalised UTF-8 and, for each of its bytes and its end, the source byte it came from."""
        data = text.encode()
        out, at, i = bytearray(), [], 0
        mark = MARK.encode() if self.escape else b" "

        def add(piece: bytes, src: int, step: int = 0) -> None:
            for j, b in enumerate(piece):
                if b == 0x20:
                    out.extend(mark)
                    at.extend([src] * len(mark))
                else:
                    out.append(b)
                    at.append(src + j * step)

        def unit(i: int) -> tuple[int, bytes]:
            if m := self.chars.longest(data, i):
                return m
            b = data[i]
            n = 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
            return n, data[i : i + n]

        if self.squeeze:
            while i < len(data) and unit(i)[1] == b" ":
                i += unit(i)[0]
        if self.prefix and i < len(data):
            add(b" ", i)
        spaced = self.squeeze
        while i < len(data):
            n, new = unit(i)
            same = new == data[i : i + n]  # a character that stays keeps its bytes' places
            if self.squeeze:
                while spaced and new[:1] == b" ":
                    new = new[1:]
                spaced = new[-1:] == b" " if new else spaced
            add(new, i, int(same))
            i += n
        if self.squeeze:
            while out.endswith(mark):
                del out[-len(mark) :], at[-len(mark) :]
        return bytes(out), [*at, len(data)]

    def alignment(self, text: str) -> np.ndarray:
        """For each byte of the normalised text and its end, the source byte it came from."""
        if not self.simple:
            return np.array(self.normalise(text)[1], np.int64)
        raw = np.frombuffer(text.encode(), np.uint8)
        at = np.repeat(np.arange(len(raw) + 1), np.where(np.append(raw, 0) == 0x20, 3, 1))
        return np.concatenate([np.zeros(3 if len(raw) else 0, np.int64), at])

    def spans(self, text: str, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of each piece in the bytes of ``text``.

        The dummy prefix belongs to no source byte, so its piece begins where the text does.
        """
        at, width = self.alignment(text), self.width[ids]
        if self.unknown in ids:  # one stands for a run of characters without a piece, which ends where the next piece fits
            norm, k = self.normalise(text)[0], 0
            for j, i in enumerate(ids):
                if i == self.unknown:
                    width[j] = self._unknown_width(norm, k, ids[j + 1 :])
                k += int(width[j])
        end = np.cumsum(width)
        return at[end - width], at[np.minimum(end, len(at) - 1)]

    def _unknown_width(self, norm: bytes, k: int, rest: list[int]) -> int:
        """Bytes of the unknown run at ``k``: up to where the known pieces that follow it stand."""
        known = b""
        for i in rest:
            if i == self.unknown:
                break
            known += self.sp.id_to_piece(i).encode()
        n = 1
        while k + n < len(norm) and (norm[k + n] & 0xC0 == 0x80 or not (norm.startswith(known, k + n) if known else False)):
            n += 1
        return n

    def encode(self, text: str) -> list[tuple[int, int, int]]:
        """(id, begin, end) for each piece: the span of original UTF-8 bytes, end exclusive."""
        if not text:
            return []
        ids = self.ids(text)
        begin, end = self.spans(text, ids)
        return list(zip(ids, begin.tolist(), end.tolist()))

    def digest(self, text: str) -> tuple[str, int, str, bytes]:
        """(decimal ids joined by commas, number of ids, decoded text, begins and ends as little-endian 64-bit pairs)."""
        if not text:
            return "", 0, "", b""
        ids = self.ids(text)
        spans = np.stack(self.spans(text, ids), 1).astype("<i8").tobytes()
        return ",".join([self.decimal[i] for i in ids]), len(ids), self.sp.decode(ids), spans


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``pieces``, an array of (id, begin, end): ids as the library gives them, spans in original bytes.

    Null and empty texts have no pieces.  One narrow Arrow pass; a column named ``pieces`` is replaced.
    """
    keep = [c for c in docs.columns if c != "pieces"]
    kind = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([*(f"`{c}` {kind[c]}" for c in keep), "pieces array<struct<id:int,begin:long,end:long>>"])
    t = pa.list_(pa.struct([("id", pa.int32()), ("begin", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for b in batches:
            for a in range(0, b.num_rows, 64):
                s = b.slice(a, 64)
                rows = [[dict(zip(("id", "begin", "end"), p)) for p in codec.encode(x or "")] for x in s.column(keep.index(text)).to_pylist()]
                yield pa.record_batch([*s.columns, pa.array(rows, t)], [*keep, "pieces"])

    return docs.select(*(F.col(f"`{c}`") for c in keep)).mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` without the text, with ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and ``spans_sha256``.

    The last is the digest of each piece's begin and end in the text's UTF-8 bytes, as little-endian 64-bit pairs.
    Null counts as empty: no ids, the digests of the empty string.  Repeated rows stay; clashing columns are replaced.
    Texts of any length are encoded whole, those over a million characters in parts that give the same ids; there is
    nothing to tie.  One narrow pass.
    """
    new = ("n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256")
    keep = [c for c in docs.columns if c not in (*new, text)]
    kind = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([*(f"`{c}` {kind[c]}" for c in keep), "n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            n, ids, back, spans = [], [], [], []
            for t in b.column(b.num_columns - 1):
                i, k, d, s = codec.digest(t.as_py() or "")
                n.append(k)
                ids.append(sha(i.encode()))
                back.append(sha(d.encode()))
                spans.append(sha(s))
            yield pa.record_batch([*(b.column(k) for k in range(len(keep))), pa.array(n, pa.int64()), *(pa.array(c, pa.string()) for c in (ids, back, spans))], [*keep, *new])
            trim_memory()

    return docs.select(*(F.col(f"`{c}`") for c in keep), F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)
