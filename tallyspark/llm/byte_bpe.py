"""Byte-level BPE through a sentencepiece model that is serialised straight from a rank file.

Each byte becomes one printable character, each token of the vocabulary a piece of such
characters whose score is its negative rank, and normalisation is the identity; so sentencepiece
merges in the order of the ranks, the leftmost first among equals. Texts are cut into pre-tokens
by the pattern; a pre-token that is itself a token is taken as it is, all others are encoded by
the model. Decoding maps ids back to their bytes.

The serialised model (about 1 MB, as large as the vocabulary and not as the data) goes to the
executors as a broadcast. Each Python worker keeps a bounded memory of pre-tokens.

Defined cases: a null text is an empty one and gives no ids; null or unknown ids decode to nothing; a
text of any length is encoded whole, in one task; repeated rows are encoded each; an empty table gives
an empty table; other columns pass through, but for those named like the result's, which are replaced.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices

#: Most pre-tokens that a worker remembers; beyond, it starts afresh. It changes speed only.
REMEMBERED = 300_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is printable Latin-1, else one above 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """A protocol-buffer field."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """The model as sentencepiece stores it: pieces by id, BPE, no normalisation; the unknown piece comes last."""
    chars = byte_characters()
    normal, unknown, bpe = 1, 2, 2
    by_rank = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in by_rank] != list(range(len(ranks))):
        raise ValueError("the ranks must run from 0 without a gap")
    pieces = [_field(1, "".join(chars[b] for b in t).encode()) + _field(2, float(-i)) + _field(3, normal) for i, t in enumerate(by_rank)]
    pieces.append(_field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown))
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, len(pieces) - 1) + b"".join(_field(k, -1) for k in (41, 42, 43))
    normalizer = _field(1, b"identity") + b"".join(_field(k, 0) for k in (3, 4, 5))
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normalizer)


def latin_pattern(pattern: str) -> re.Pattern | None:
    """The pattern for texts of Latin-1 characters alone, with classes spelt out; the standard module matches it several times as fast.

    None where the pattern holds a class that is not known here.
    """

    def spelt(kind: str) -> str:
        return "".join(re.escape(chr(c)) for c in range(256) if regex.match(kind, chr(c)))

    letter, number, space = spelt(r"\p{L}"), spelt(r"\p{N}"), spelt(r"\s")
    out = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letter}{number}]")
    for kind, chars in ((r"\p{L}", f"[{letter}]"), (r"\p{N}", f"[{number}]"), (r"\S", f"[^{space}]"), (r"\s", f"[{space}]")):
        out = out.replace(kind, chars)
    return None if re.search(r"\\[pPwWdDbBsS]", out) else re.compile(out)


class PreTokenEncoder(dict):
    """Pre-token -> its ids as little-endian 32-bit integers."""

    def __init__(self, model: bytes, pattern: str):
        super().__init__()
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        chars = byte_characters()
        self.by_byte = dict(enumerate(chars))
        byte_of = {c: i for i, c in enumerate(chars)}
        self.tokens = [bytes(byte_of[c] for c in self.sp.id_to_piece(i)) for i in range(self.sp.get_piece_size() - 1)]
        self.whole = {t: i for i, t in enumerate(self.tokens)}
        self.find = regex.compile(pattern).findall
        latin = latin_pattern(pattern)
        self.find_latin = latin.findall if latin else self.find

    def learn(self, pre_tokens: list[str]) -> None:
        if len(self) + len(pre_tokens) > REMEMBERED:
            self.clear()
        rest = []
        for p in pre_tokens:
            raw = p.encode("utf-8", "surrogatepass")
            one = self.whole.get(raw)
            if one is None:
                rest.append((p, raw.decode("latin-1").translate(self.by_byte)))
            else:
                self[p] = struct.pack("<i", one)
        for (p, _), ids in zip(rest, self.sp.encode([m for _, m in rest], out_type=int, num_threads=1), strict=True):
            self[p] = struct.pack(f"<{len(ids)}i", *ids)

    def encode(self, text: str) -> bytes:
        try:
            text.encode("latin-1")
            found = self.find_latin(text)
        except UnicodeEncodeError:
            found = self.find(text)
        kinds = set(found)
        if new := [p for p in kinds if p not in self]:
            self.learn(new)
            if len(self) < len(kinds) or not all(map(self.__contains__, kinds)):  # the memory was cleared
                self.learn(list(kinds))
        return b"".join(map(self.__getitem__, found))


def bpe_functions(spark: SparkSession, path: str, pattern: str) -> tuple[Callable[[Column], Column], Callable[[Column], Column]]:
    """(encode, decode) as column functions: string -> array<int>, array<int> -> binary."""
    ranks = read_ranks(path)
    model, pieces = spark.sparkContext.broadcast(sentencepiece_model(ranks)), spark.sparkContext.broadcast({i: t for t, i in ranks.items()})

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = PreTokenEncoder(model.value, pattern)
        for texts in slices(batches):
            ends, out = [0], bytearray()
            for t in texts:
                out += encoder.encode(t.as_py() or "")
                ends.append(len(out) // 4)
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(out, np.int32)))

    @F.arrow_udf("binary")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens = pieces.value

        def of(ids: pa.Array | None) -> bytes:
            if ids is None:
                return b""
            listed = ids.to_pylist() if ids.null_count else ids.to_numpy().tolist()
            return b"".join([tokens.get(i, b"") for i in listed])

        for ids in slices(batches):
            yield pa.array((of(x.values) for x in ids), pa.binary())

    return encode, decode


def encode_bpe(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = "decoded") -> DataFrame:
    """``docs`` with the ids of each text and, if asked for, the bytes that they decode to."""
    encode, decode = bpe_functions(docs.sparkSession, path, pattern)
    out = docs.withColumn(ids_col, encode(F.coalesce(F.col(text_col), F.lit(""))))
    return out.withColumn(decoded_col, decode(F.col(ids_col))) if decoded_col else out
