"""Media columns as baseline JPEG: bytes in DC coefficients, and a decoder of DC-only luminance thumbnails.

*Storing.* A text's UTF-8 bytes, padded with 255 to a positive multiple of 576, become the DC
coefficients of 8x8 blocks: with a DC quantiser of 8 a coefficient of ``v - 128`` is a block of
constant sample ``v``, so the thumbnail of one sample per block is the payload, without loss. A
picture is 24 blocks wide and at most ``FRAME_ROWS`` blocks high; longer payloads are several
pictures, one after another. Every row of blocks is a restart interval.

*Reading.* Markers are parsed from the bytes (SOF0, DQT, DHT, DRI, SOS, RSTn); stuffed zeros are
taken out, and the Huffman codes of all restart intervals of a batch of pictures with the same
tables are decoded side by side in numpy, one code of each interval per step. The decoder takes
any baseline picture with one interleaved scan (grey or YCbCr, with AC coefficients, with or
without restart intervals) and gives its luminance thumbnail.

Pictures are coded and decoded a few at a time (``BATCH_BYTES``), so beyond the value itself memory
does not grow with a text, and the end of a scan is looked for in pieces, so time grows in proportion.

Defined cases: a null text is an empty one and stores 576 bytes of 255; equal texts give equal
bytes; a very long text is several pictures in one value; null media decode to nulls; an empty table
gives an empty table; repeated rows and extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

UNIT, FILL, ACROSS = 576, 255, 24
#: Most rows of blocks in a picture: a multiple of 24 whose 8 lines each stay below 65,536.
FRAME_ROWS = 8184
#: Payload that is encoded or decoded at once.
BATCH_BYTES = 1 << 20
DC_QUANTISER = 8
#: Code lengths of the categories 0 to 8 of a DC difference, short where text has them most; one AC symbol, end of block.
DC_LENGTHS = {0: 4, 1: 6, 2: 5, 3: 4, 4: 3, 5: 2, 6: 2, 7: 3, 8: 6}
#: Fixed values of the format: marker codes.
SOI, EOI, SOF0, DHT, DQT, DRI, SOS = 0xD8, 0xD9, 0xC0, 0xC4, 0xDB, 0xDD, 0xDA
NO_LENGTH = {0x01, *range(0xD0, 0xD9)}


def padded(data: bytes) -> bytes:
    return data + bytes([FILL]) * (-len(data) % UNIT if data else UNIT)


def _canonical(lengths_of: dict[int, int]) -> tuple[bytes, dict[int, tuple[int, int]]]:
    """DHT body (16 counts, symbols) and symbol -> (code, length)."""
    ordered = sorted(lengths_of, key=lambda s: (lengths_of[s], s))
    counts, codes, code, last = [0] * 16, {}, 0, 0
    for s in ordered:
        n = lengths_of[s]
        code <<= n - last
        codes[s], last = (code, n), n
        code += 1
        counts[n - 1] += 1
    return bytes(counts) + bytes(ordered), codes


_DC_BODY, _DC_CODES = _canonical(DC_LENGTHS)
_AC_BODY, _AC_CODES = _canonical({0: 1})


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _head(rows: int) -> bytes:
    size = (8 * rows).to_bytes(2, "big") + (8 * ACROSS).to_bytes(2, "big")
    return (
        bytes([0xFF, SOI]) + _segment(DQT, bytes([0, DC_QUANTISER]) + bytes([1]) * 63) + _segment(SOF0, bytes([8]) + size + bytes([1, 1, 0x11, 0]))
        + _segment(DHT, bytes([0x00]) + _DC_BODY) + _segment(DHT, bytes([0x10]) + _AC_BODY) + _segment(DRI, ACROSS.to_bytes(2, "big"))
        + _segment(SOS, bytes([1, 1, 0x00, 0, 63, 0]))
    )


def _code_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each difference -255..255: the bits of its code, extra bits and end of block, left-aligned in 24, and their number."""
    bits, lengths = np.zeros(511, np.uint32), np.zeros(511, np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, n = _DC_CODES[size]
        extra = d if d >= 0 else d + (1 << size) - 1
        end, one = _AC_CODES[0]
        lengths[d + 255] = n + size + one
        bits[d + 255] = ((code << size | extra) << one | end) << 24 - lengths[d + 255]
    return bits, lengths


_BITS, _LENGTHS = _code_tables()


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """A picture for each payload (each a multiple of UNIT of at most FRAME_ROWS rows), encoded side by side."""
    rows = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, ACROSS).astype(np.int64)
    level = rows - 128
    diff = np.diff(level, axis=1, prepend=0) + 255
    bits, lengths = _BITS[diff], _LENGTHS[diff]
    fill = -lengths.sum(axis=1) % 8  # ones up to a whole byte
    bits = np.column_stack((bits, np.full(len(rows), 0xFFFFFF, np.uint32)))
    lengths = np.column_stack((lengths, fill))
    spread = np.unpackbits(bits.astype(">u4").view(np.uint8).reshape(*bits.shape, 4)[:, :, 1:], axis=2)
    data = np.packbits(spread[np.arange(24) < lengths[:, :, None]])
    row_bytes = lengths.sum(axis=1) // 8
    row_of = np.repeat(np.arange(len(rows)), row_bytes)
    counts = np.array([len(p) // ACROSS for p in payloads])
    ends = np.cumsum(counts)
    inside = np.arange(len(rows)) - np.repeat(ends - counts, counts)
    is_last = np.zeros(len(rows), bool)
    is_last[ends - 1] = True
    stuffed = np.cumsum(data == 0xFF) - (data == 0xFF)
    marks = np.concatenate(([0], np.cumsum(2 * ~is_last)))
    out = np.zeros(len(data) + int((data == 0xFF).sum()) + int(marks[-1]), np.uint8)
    place = np.arange(len(data)) + stuffed + marks[row_of]
    out[place] = data
    ff_before = np.concatenate(([0], np.cumsum(data == 0xFF)))
    row_end = np.cumsum(row_bytes)
    after = row_end + ff_before[row_end] + marks[:-1]
    m = after[~is_last]
    out[m], out[m + 1] = 0xFF, 0xD0 + inside[~is_last] % 8
    scan_ends = after[is_last]
    scan_starts = np.concatenate(([0], scan_ends[:-1]))
    return [_head(n) + out[a:b].tobytes() + bytes([0xFF, EOI]) for n, a, b in zip(counts.tolist(), scan_starts, scan_ends, strict=True)]


@dataclass
class Picture:
    """What the markers say; the scan's restart intervals as unstuffed bytes."""

    width: int = 0
    height: int = 0
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, horizontal, vertical, quantiser
    quantisers: dict[int, int] = field(default_factory=dict)  # of DC
    tables: dict[int, bytes] = field(default_factory=dict)
    interval: int = 0
    scan: list[tuple[int, int, int]] = field(default_factory=list)  # id, DC table, AC table
    data: np.ndarray | None = None
    starts: np.ndarray | None = None


def parse_pictures(media: bytes) -> list[Picture]:
    """All pictures in a string of bytes, one after another."""
    out, at = [], 0
    while at < len(media):
        if media[at] != 0xFF:
            raise ValueError(f"a marker was due at byte {at}")
        marker, at = media[at + 1], at + 2
        if marker == SOI:
            out.append(Picture())
        if marker == 0xFF:
            at -= 1
            continue
        if marker in NO_LENGTH or marker == EOI:
            continue
        size = int.from_bytes(media[at : at + 2], "big")
        body, at = media[at + 2 : at + size], at + size
        p = out[-1]
        if marker == SOF0:
            p.height, p.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            p.components = [(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)]
        elif marker == DQT:
            while body:
                wide = body[0] >> 4
                p.quantisers[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                body = body[1 + 64 * (1 + wide) :]
        elif marker == DHT:
            while body:
                n = 17 + sum(body[1:17])
                p.tables[body[0]] = body[1:n]
                body = body[n:]
        elif marker == DRI:
            p.interval = int.from_bytes(body, "big")
        elif marker == SOS:
            p.scan = [(body[i], body[i + 1] >> 4, body[i + 1] & 15) for i in range(1, 1 + 2 * body[0], 2)]
            at = _take_scan(p, media, at)
        elif 0xC1 <= marker <= 0xCF:
            raise ValueError("only baseline pictures are read")
    return out


def _scan_end(media: bytes, at: int) -> int:
    """Where the marker that ends a scan stands: no stuffed byte, restart or fill."""
    while at < len(media) - 1:
        raw = np.frombuffer(media, np.uint8, min(BATCH_BYTES, len(media) - at), at)
        ff = np.flatnonzero(raw[:-1] == 0xFF)
        after = raw[ff + 1]
        ends = ff[(after != 0) & ((after < 0xD0) | (after > 0xD7)) & (after != 0xFF)]
        if len(ends):
            return at + int(ends[0])
        at += max(len(raw) - 1, 1)
    return len(media)


def _take_scan(p: Picture, media: bytes, at: int) -> int:
    stop = _scan_end(media, at) - at
    raw = np.frombuffer(media, np.uint8, min(stop + 1, len(media) - at), at)
    ff = np.flatnonzero(raw[:-1] == 0xFF)
    after = raw[ff + 1]
    ff, after = ff[ff < stop], after[ff < stop]
    keep = np.ones(stop, bool)
    keep[ff[after == 0] + 1] = False
    marks = ff[after != 0]
    keep[marks], keep[marks + 1] = False, False
    p.data = raw[:stop][keep]
    p.starts = np.concatenate(([0], np.cumsum(keep)[marks])).astype(np.int64)
    return at + stop


def _lookup(body: bytes) -> np.ndarray:
    """For every 16 bits: length of the code that they start with, times 256, plus its symbol; 0 where there is none."""
    table, code, at = np.zeros(1 << 16, np.int32), 0, 16
    for n in range(1, 17):
        for _ in range(body[n - 1]):
            table[code << 16 - n : code + 1 << 16 - n] = n << 8 | body[at]
            code, at = code + 1, at + 1
        code <<= 1
    return table


def _plan(p: Picture) -> tuple:
    """What pictures must share to be decoded side by side."""
    one = len(p.scan) == 1
    sampling = {c[0]: (1, 1) if one else (c[1], c[2]) for c in p.components}
    blocks = tuple((i, dc, ac) for i, dc, ac in p.scan for _ in range(sampling[i][0] * sampling[i][1]))
    tables = tuple(sorted((k, p.tables[k]) for _, dc, ac in p.scan for k in (dc, 16 + ac)))
    return blocks, tuple(dict(tables).items())


def _shape(p: Picture) -> tuple[int, int, int, int]:
    """MCUs across and down, and the luminance's blocks across and down in an MCU."""
    own = {c[0]: c for c in p.components}[p.scan[0][0]]
    h, v = (1, 1) if len(p.scan) == 1 else own[1:3]
    most_h, most_v = (1, 1) if len(p.scan) == 1 else (max(c[1] for c in p.components), max(c[2] for c in p.components))
    return -(-p.width // (8 * most_h)), -(-p.height // (8 * most_v)), h, v


def _decode_alike(group: list[Picture]) -> list[np.ndarray]:
    """The DC coefficients of the first component, for pictures of one plan: [MCU, block of the MCU]."""
    blocks, tables = _plan(group[0])
    lookup = {k: _lookup(body) for k, body in tables}
    total = [(s := _shape(p))[0] * s[1] for p in group]
    base = np.cumsum([0, *(len(p.data) + 4 for p in group)])
    data = np.concatenate([np.concatenate((p.data, np.full(4, 255, np.uint8))) for p in group]).astype(np.int64)
    window = np.zeros(len(data), np.int64)
    for k in range(4):
        window[: len(data) - k] |= data[k:] << 24 - 8 * k
    at = 8 * np.concatenate([p.starts + b for p, b in zip(group, base)])
    todo = np.concatenate([np.diff(np.minimum(np.arange(len(p.starts) + 1) * (p.interval or n), n)) for p, n in zip(group, total, strict=True)])
    own = [k for k, b in enumerate(blocks) if b[0] == blocks[0][0]]
    result = np.zeros((int(todo.sum()), len(own)), np.int64)
    first = np.cumsum(todo) - todo
    predicted = {b[0]: np.zeros(len(at), np.int64) for b in blocks}

    def bits16(pos: np.ndarray) -> np.ndarray:
        return window[pos >> 3] >> 16 - (pos & 7) & 0xFFFF

    for step in range(int(todo.max(initial=0))):
        live = np.flatnonzero(todo > step)
        pos = at[live]
        for k, (component, dc, ac) in enumerate(blocks):
            found = lookup[dc][bits16(pos)]
            pos = pos + (found >> 8)
            size = found & 255
            extra = bits16(pos) >> 16 - size
            pos = pos + size
            predicted[component][live] += np.where(extra < 1 << np.maximum(size, 1) - 1, extra - (1 << size) + 1, extra)
            if k in own:
                result[first[live] + step, own.index(k)] = predicted[component][live]
            open_, done = np.arange(len(live)), np.zeros(len(live), np.int64)
            while len(open_):  # AC coefficients are passed over
                found = lookup[16 + ac][bits16(pos[open_])]
                symbol = found & 255
                if not np.all(found):
                    raise ValueError("the scan holds a code that no table has")
                pos[open_] += (found >> 8) + (symbol & 15)
                done[open_] += np.where(symbol == 0, 63, np.where(symbol == 0xF0, 16, (symbol >> 4) + 1))
                open_ = open_[done[open_] < 63]
        at[live] = pos
    cuts = np.cumsum(total)[:-1]
    return np.split(result, cuts)


def thumbnails(pictures: list[Picture]) -> list[np.ndarray]:
    """DC-only luminance thumbnails, a sample per block."""
    plans: dict[tuple, list[int]] = {}
    for i, p in enumerate(pictures):
        plans.setdefault(_plan(p), []).append(i)
    out: list[np.ndarray] = [np.zeros((0, 0), np.uint8)] * len(pictures)
    for alike in plans.values():
        for i, dc in zip(alike, _decode_alike([pictures[i] for i in alike]), strict=True):
            p = pictures[i]
            across, down, h, v = _shape(p)
            q = p.quantisers[{c[0]: c[3] for c in p.components}[p.scan[0][0]]]
            grid = dc.reshape(down, across, v, h).swapaxes(1, 2).reshape(down * v, across * h)
            samples = np.clip((grid * q + 4) // 8 + 128, 0, 255).astype(np.uint8)
            most_h, most_v = max(c[1] for c in p.components), max(c[2] for c in p.components)
            own = p.components[0]
            out[i] = samples[: -(-p.height * own[2] // (8 * most_v)), : -(-p.width * own[1] // (8 * most_h))]
    return out


def average_hash(thumb: np.ndarray) -> int:
    """64 bits: which cells of an 8x8 grid over the thumbnail are brighter than the mean of the cells."""
    y, x = np.linspace(0, thumb.shape[0], 9).astype(int), np.linspace(0, thumb.shape[1], 9).astype(int)
    sums = np.zeros((thumb.shape[0] + 1, thumb.shape[1] + 1), np.int64)
    sums[1:, 1:] = thumb.astype(np.int64).cumsum(0).cumsum(1)
    area = np.maximum(np.diff(y)[:, None] * np.diff(x)[None, :], 1)
    cells = (sums[y[1:]][:, x[1:]] - sums[y[:-1]][:, x[1:]] - sums[y[1:]][:, x[:-1]] + sums[y[:-1]][:, x[:-1]]) / area
    return int.from_bytes(np.packbits(cells > cells.mean()).tobytes(), "big")


def _in_batches(sizes: list[int]) -> Iterator[slice]:
    at = 0
    while at < len(sizes):
        end, load = at + 1, sizes[at]
        while end < len(sizes) and load + sizes[end] <= BATCH_BYTES:
            load += sizes[end]
            end += 1
        yield slice(at, end)
        at = end


@F.arrow_udf(T.BinaryType())
def _encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    frame = FRAME_ROWS * ACROSS
    for texts in slices(batches):
        frames, owner = [], []
        out: list[list[bytes]] = []
        for i, t in enumerate(texts.to_pylist()):
            data = padded((t or "").encode("utf-8", "surrogatepass"))
            frames += [data[k : k + frame] for k in range(0, len(data), frame)]
            owner += [i] * (len(frames) - len(owner))
            out.append([])
        for part in _in_batches([len(f) for f in frames]):
            for i, picture in zip(owner[part], encode_payloads(frames[part]), strict=True):
                out[i].append(picture)
        yield pa.array([b"".join(x) for x in out], pa.binary())


FEATURES = T.StructType([
    T.StructField("payload", T.BinaryType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()),
    T.StructField("n_pictures", T.IntegerType()), T.StructField("hashes", T.ArrayType(T.StringType())),
])


@F.arrow_udf(FEATURES)
def _decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kinds = [pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string())]
    names = FEATURES.names
    for media in slices(batches):
        columns: list[list] = [[] for _ in names]
        values = media.to_pylist()
        for part in _in_batches([len(m or b"") for m in values]):
            parsed = [parse_pictures(m) if m is not None else [] for m in values[part]]
            pictures = [p for own in parsed for p in own]
            thumbs = chain.from_iterable(thumbnails(pictures[some]) for some in _in_batches([len(p.data) for p in pictures]))
            for own in parsed:
                mine = [next(thumbs) for _ in own]
                row = (b"".join(t.tobytes() for t in mine), own[0].width, own[0].height, len(own), [f"{average_hash(t):016x}" for t in mine]) if own else (None,) * 5
                for c, v in zip(columns, row, strict=True):
                    c.append(v)
        yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def store_as_jpeg(text: Column) -> Column:
    """The text's padded bytes as baseline JPEG."""
    return _encode(F.coalesce(text, F.lit("")))


def read_jpeg(media: Column) -> Column:
    """payload (the thumbnails' samples), size of the first picture, number of pictures and a hash of each thumbnail."""
    return _decode(media)
