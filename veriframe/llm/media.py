"""Baseline JPEG media columns in numpy.

Reading: markers are parsed, scans are Huffman-decoded, and the DC terms alone give a luminance thumbnail of one pixel
a block. All restart intervals of all files of a batch that share their tables are lanes of one decoder: each step
decodes one coefficient of every lane, so there is no Python work for each coefficient. A file without restart markers
is one lane.

Writing: a payload of bytes is stored losslessly as quantised coefficients, which entropy coding keeps exactly (samples
would be rounded by the cosine transform). A block holds 64 bytes; the first is the DC term, with a quantiser of 8, so
that a thumbnail pixel equals it; the others become AC terms of size category 8, whose 256 values stand for the bytes.
Each row of blocks is a restart interval. The payload's length is in a comment segment.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriframe.llm.common import chunks

UNIT = 192
PAD = b"\x20"
#: Bytes that are coded at once.
PIECE = 1_000_000
#: Most rows of blocks that a frame header can hold.
ROWS = 65535 // 8
_TAG = b"payload"


class MediaError(ValueError):
    """The bytes are no baseline JPEG that can be read."""


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


def _header(width: int, height: int, interval: int, length: int) -> bytes:
    lengths = lambda n, bits: bytes(n if i == bits else 0 for i in range(1, 17))
    return b"".join((
        b"\xff\xd8",
        _segment(0xFE, _TAG + struct.pack(">Q", length)),
        _segment(0xDB, bytes([0, 8]) + bytes([1]) * 63),
        _segment(0xC0, struct.pack(">BHHB", 8, height, width, 1) + bytes([1, 0x11, 0])),
        _segment(0xC4, bytes([0x00]) + lengths(9, 4) + bytes(range(9))),  # DC: sizes 0 to 8, four bits each
        _segment(0xC4, bytes([0x10]) + lengths(1, 1) + bytes([0x08])),  # AC: run 0, size 8, one bit
        _segment(0xDD, struct.pack(">H", interval)),
        _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
    ))


def encode(payloads: list[bytes]) -> list[bytes]:
    """A JPEG file for each payload; a payload's length is a positive multiple of 192.

    Rows of blocks are coded about PIECE bytes at a time, so a long payload takes no more working memory than short ones.
    """
    files: list[list[bytes]] = []
    todo: list[tuple[int, bytes, int, int, bool]] = []  # file, rows of blocks, blocks of a row, first row's number, last
    size = 0

    def code() -> None:
        for (file, *_), scan in zip(todo, _scans([(data, wide, number, last) for _, data, wide, number, last in todo])):
            files[file].append(scan)
        todo.clear()

    for file, p in enumerate(payloads):
        if not p or len(p) % UNIT:
            raise ValueError(f"a payload of {len(p)} bytes")
        blocks = len(p) // 64
        wide = 3 * -(-blocks // (3 * ROWS))
        high = -(-blocks // wide)
        files.append([_header(8 * wide, 8 * high, wide, len(p))])
        step = max(1, PIECE // (64 * wide))
        for row in range(0, high, step):
            rows = min(step, high - row)
            data = p[64 * wide * row : 64 * wide * (row + rows)]
            todo.append((file, data.ljust(64 * wide * rows, PAD), wide, row, row + rows == high))
            size += len(data)
            if size >= PIECE:
                code()
                size = 0
    if todo:
        code()
    return [b"".join(f) for f in files]


def _scans(parts: list[tuple[bytes, int, int, bool]]) -> list[bytes]:
    """The entropy-coded bytes of rows of blocks, each row closed by its marker.

    parts: bytes of whole rows, blocks of a row, the first row's number, whether the image ends with them.
    """
    data = np.frombuffer(b"".join(d for d, *_ in parts), np.uint8).reshape(-1, 64).astype(np.int64)
    n = len(data)
    rows_of = np.array([len(d) // (64 * w) for d, w, *_ in parts])
    wide_of = np.repeat([w for _, w, *_ in parts], rows_of)  # blocks of each interval
    first = np.concatenate(([0], np.cumsum(wide_of)[:-1]))  # its first block
    interval = np.repeat(np.arange(len(wide_of)), wide_of)
    code, length = data.copy(), np.full((n, 64), 9, np.int64)
    dc = data[:, 0] - 128
    diff = np.diff(dc, prepend=0)
    diff[first] = dc[first]
    size = np.ceil(np.log2(np.abs(diff) + 1)).astype(np.int64)
    code[:, 0] = (size << size) | np.where(diff < 0, diff + (1 << size) - 1, diff)
    length[:, 0] = 4 + size
    # bit positions: intervals begin at whole bytes
    bits = length.sum(1)
    total = np.add.reduceat(bits, first)
    nbytes = (total + 7) // 8
    base = np.concatenate(([0], np.cumsum(nbytes)))
    before = np.cumsum(bits) - bits
    start = before - before[first][interval] + base[interval] * 8
    at = (start[:, None] + np.cumsum(length, 1) - length).ravel()
    length, code = length.ravel(), code.ravel()
    shifted, byte = code << (24 - (at & 7) - length), at >> 3
    room = int(base[-1]) + 3
    buf = sum(np.bincount(byte + k, (shifted >> (16 - 8 * k)) & 255, room) for k in range(3)).astype(np.int64)[:-3]
    buf[base[1:] - 1] |= (1 << (nbytes * 8 - total)) - 1
    # stuffing after each 255, a marker after each interval
    full = buf == 255
    shift = np.cumsum(full) - full + 2 * np.repeat(np.arange(len(nbytes)), nbytes)
    out = np.zeros(len(buf) + int(full.sum()) + 2 * len(nbytes), np.uint8)
    place = np.arange(len(buf)) + shift
    out[place] = buf
    last = base[1:] - 1
    mark = place[last] + 1 + full[last]
    number = np.arange(len(nbytes)) - np.repeat(np.cumsum(rows_of) - rows_of, rows_of) + np.repeat([k for _, _, k, _ in parts], rows_of)
    ends = np.cumsum(rows_of) - 1
    out[mark] = 255
    out[mark + 1] = 0xD0 + number % 8
    closed = ends[[last for *_, last in parts]]
    out[mark[closed] + 1] = 0xD9
    stops = mark[ends] + 2
    return [out[a:b].tobytes() for a, b in zip(np.concatenate(([0], stops[:-1])), stops)]


def parse(data: bytes) -> dict:
    """Dimensions, tables, components and the scan's place of a baseline JPEG with one scan of all its components."""
    if data[:2] != b"\xff\xd8":
        raise MediaError("no start of image")
    out: dict = {"quant": {}, "huff": {}, "interval": 0, "comment": b""}
    at = 2
    while True:
        while data[at : at + 1] == b"\xff" and data[at + 1 : at + 2] == b"\xff":
            at += 1
        if data[at : at + 1] != b"\xff" or at + 4 > len(data):
            raise MediaError(f"no marker at {at}")
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                out["quant"][body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[65 + 64 * wide :]
        elif marker == 0xC0:
            bits, out["height"], out["width"], n = struct.unpack_from(">BHHB", body)
            if bits != 8 or not out["width"] or not out["height"]:
                raise MediaError("not 8 bits a sample, or no size")
            out["parts"] = {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)}
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise MediaError("not baseline")
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                out["huff"][body[0]] = body[1 : 17 + n]
                body = body[17 + n :]
        elif marker == 0xDD:
            out["interval"] = struct.unpack_from(">H", body)[0]
        elif marker == 0xFE:
            out["comment"] = body
        elif marker == 0xDA:
            if "parts" not in out or body[0] != len(out["parts"]):
                raise MediaError("the scan lacks a frame or a component")
            out["scan"] = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            out["data"] = at
            return out


_luts: dict[bytes, np.ndarray] = {}


def _lut(spec: bytes) -> np.ndarray:
    """For each 16 bits the length and symbol of the code they begin with, as length * 256 + symbol; 0: none."""
    if spec not in _luts:
        if len(_luts) > 64:
            _luts.clear()
        lut, code, k = np.zeros(65536, np.int64), 0, 16
        for bits in range(1, 17):
            for _ in range(spec[bits - 1]):
                lut[code << (16 - bits) : (code + 1) << (16 - bits)] = bits << 8 | spec[k]
                code, k = code + 1, k + 1
            code <<= 1
        _luts[spec] = lut
    return _luts[spec]


def _lanes(window: np.ndarray, pos: np.ndarray, mcus: np.ndarray, pattern: list[tuple[int, np.ndarray, np.ndarray]], place: np.ndarray, out: np.ndarray) -> None:
    """Decodes coefficients, in zigzag order, into ``out``: all lanes at once.

    pattern: component, DC and AC table of each block of an MCU. place: the block in ``out`` that a lane begins with.
    """
    pred = np.zeros((len(pos), 1 + max(p[0] for p in pattern)), np.int64)

    def value(a: np.ndarray, lut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = pos[a]
        w, used = window[p >> 3], p & 7
        code = lut[(w >> (24 - used)) & 0xFFFF]
        if not code.all():
            raise MediaError("bits that begin no code")
        bits, sym = code >> 8, code & 255
        size = sym & 15
        extra = (w >> (40 - used - bits - size)) & ((1 << size) - 1)
        pos[a] = p + bits + size
        return sym >> 4, np.where((extra >> np.maximum(size - 1, 0)) > 0, extra, extra - (1 << size) + 1) * (size > 0)

    limit = 8 * (len(window) - 1)
    for m in range(int(mcus.max(initial=0))):
        live = np.flatnonzero(mcus > m)
        for b, (part, dc, ac) in enumerate(pattern):
            block = place[live] + m * len(pattern) + b
            pred[live, part] += value(live, dc)[1]
            out[block, 0] = pred[live, part]
            k, a, own = np.zeros(len(live), np.int64), live, block
            while len(a):
                run, v = value(a, ac)
                end = (run == 0) & (v == 0)
                k = np.where(end, 64, k + run + 1)
                keep = k < 64
                if keep.all():
                    out[own, k] = v
                else:
                    out[own[keep], k[keep]] = v[keep]
                if (more := k < 63).all():
                    continue
                a, own, k = a[more], own[more], k[more]
        if (pos > limit).any():
            raise MediaError("the scan ends early")


def decode(files: list[bytes]) -> list[dict]:
    """Of each file: width, height, comment, its luminance blocks in scan order (coefficients in zigzag order, one row
    of blocks after another) and the thumbnail of their DC terms."""
    heads = [parse(f) for f in files]
    groups: dict[tuple, list[int]] = {}
    for i, h in enumerate(heads):
        h["sampling"] = tuple(h["parts"][c][:2] for c, _, _ in h["scan"])
        key = (h["sampling"] if len(h["scan"]) > 1 else 1, tuple((h["huff"].get(dc), h["huff"].get(16 + ac)) for _, dc, ac in h["scan"]))
        if any(None in pair for pair in key[1]):
            raise MediaError("a table is missing")
        groups.setdefault(key, []).append(i)
    out: list[dict] = [{} for _ in files]
    for (_, tables), members in groups.items():
        single = len(tables) == 1
        parts, starts, mcus, at = [], [], [], 0
        places, blocks_of, total = [], [], 0
        for i in members:
            h = heads[i]
            sampling = ((1, 1),) if single else h["sampling"]
            hmax, vmax = (1, 1) if single else (max(s[0] for s in sampling), max(s[1] for s in sampling))
            across, down = -(-h["width"] // (8 * hmax)), -(-h["height"] // (8 * vmax))
            pattern = [(c, _lut(tables[c][0]), _lut(tables[c][1])) for c, (x, y) in enumerate(sampling) for _ in range(x * y)]
            scan = np.frombuffer(files[i], np.uint8, offset=h["data"])
            ff = np.flatnonzero(scan[:-1] == 255)
            after = scan[ff + 1]
            stop = np.flatnonzero((after != 0) & ((after < 0xD0) | (after > 0xD7)))
            end = int(ff[stop[0]]) if len(stop) else len(scan)
            inner = (after != 0) & (ff < end)
            drop = np.sort(np.concatenate((ff[(after == 0) & (ff < end)] + 1, ff[inner], ff[inner] + 1)))
            drop = drop[drop < end]
            keep = np.ones(end, bool)
            keep[drop] = False
            resets = ff[inner] - np.searchsorted(drop, ff[inner])  # kept bytes before each marker
            n, step = across * down, h["interval"] or across * down
            count = -(-n // step)
            if len(resets) + 1 < count:
                raise MediaError("restart markers are missing")
            body = scan[:end][keep]
            starts.append(at + np.concatenate(([0], resets[: count - 1])))
            mcus.append(np.minimum(step, n - step * np.arange(count)))
            places.append(total + step * np.arange(count) * len(pattern))
            blocks_of.append((total, n * len(pattern), across, down, sampling))
            total += n * len(pattern)
            parts += [body, np.full(8, 255, np.uint8)]
            at += len(body) + 8
        every = np.concatenate(parts)
        coefs = np.zeros((total, 64), np.int16)
        starts, mcus, places = np.concatenate(starts), np.concatenate(mcus), np.concatenate(places)
        # lanes of about PIECE bytes at a time; a lane ends before the next begins
        edges = np.unique(np.append(np.searchsorted(starts, np.arange(0, at, PIECE)), len(starts)))
        for a, b in zip(edges[:-1], edges[1:]):
            low, high = int(starts[a]), int(starts[b]) if b < len(starts) else len(every)
            flat = np.append(every[low : min(high + 8, len(every))], np.full(4, 255, np.uint8)).astype(np.int64)
            window = flat[:-4] << 32 | flat[1:-3] << 24 | flat[2:-2] << 16 | flat[3:-1] << 8 | flat[4:]
            _lanes(window, (starts[a:b] - low) * 8, mcus[a:b], pattern, places[a:b], coefs)
        for i, (a, n, across, down, sampling) in zip(members, blocks_of):
            h = heads[i]
            x, y = sampling[0]
            luma = coefs[a : a + n].reshape(down, across, -1, 64)[:, :, : x * y]
            luma = luma.reshape(down, across, y, x, 64).transpose(0, 2, 1, 3, 4).reshape(down * y, across * x, 64)
            q = h["quant"].get(h["parts"][h["scan"][0][0]][2])
            if q is None:
                raise MediaError("a quantiser is missing")
            thumb = np.clip(luma[:, :, 0] * int(q[0]) // 8 + 128, 0, 255).astype(np.uint8)
            out[i] = {"width": h["width"], "height": h["height"], "comment": h["comment"], "blocks": luma.reshape(-1, 64), "thumb": thumb}
    return out


def payload_of(read: dict) -> bytes:
    """The payload of a decoded file that :func:`encode` has written."""
    if not read["comment"].startswith(_TAG):
        raise MediaError("no payload")
    (length,) = struct.unpack_from(">Q", read["comment"], len(_TAG))
    c = read["blocks"][: length // 64]
    out = np.empty(c.shape, np.uint8)
    for i in range(0, len(c), 16384):
        part = c[i : i + 16384]
        out[i : i + 16384] = np.where(part < 0, part + 255, part)
        out[i : i + 16384, 0] = part[:, 0] + 128
    return out.tobytes()


def thumbnail_hash(thumb: np.ndarray) -> str:
    """16 hex digits: which cells of an 8 by 8 grid of the thumbnail are brighter than the grid's mean."""
    h, w = thumb.shape
    grid = thumb[np.arange(8) * h // 8][:, np.arange(8) * w // 8].astype(np.int64)
    return np.packbits(grid.ravel() * 64 > grid.sum()).tobytes().hex()


def features(read: dict) -> str:
    """Dimensions, the thumbnail's dimensions, its hash and its checksum."""
    t = read["thumb"]
    return f"{read['width']}x{read['height']} {t.shape[1]}x{t.shape[0]} {thumbnail_hash(t)} {zlib.crc32(t.tobytes()):08x}"


def media_columns(media: DataFrame, key: str, content: str) -> DataFrame:
    """(key, width, height, thumb_width, thumb_height, thumb_hash, thumb binary, error) of a column of JPEG files.

    A null, empty or unreadable file gives null columns and says why in ``error``; no row is dropped.
    """
    schema = f"{key} bigint, width int, height int, thumb_width int, thumb_height int, thumb_hash string, thumb binary, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i in range(b.num_rows):
                data = b.column(1)[i].as_py()
                try:
                    r = decode([data or b""])[0]
                    t = r["thumb"]
                    rows.append((r["width"], r["height"], t.shape[1], t.shape[0], thumbnail_hash(t), t.tobytes(), None))
                except (MediaError, struct.error, IndexError) as e:
                    rows.append((None,) * 6 + (str(e),))
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], names=[x.split()[0] for x in schema.split(", ")])

    return media.select(F.col(key).alias(key), F.col(content).alias(content)).mapInArrow(run, schema)


def stored(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text stored as a JPEG file, with what reading the file back gives.

    (key, n_bytes, media binary, payload binary, feature). The payload is the text as UTF-8 (null: empty) with spaces
    up to a positive multiple of 192 bytes. Files are made and read in batches of about a megabyte, or one longer text.
    """
    schema = f"{key} bigint, n_bytes bigint, media binary, payload binary, feature string"
    return _round_trip(docs, key, text, schema, lambda n, m, p, f: (n, m, p, f))


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """:func:`stored` with digests in place of the bytes, so that these don't leave the worker.

    (key, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature)
    """
    schema = f"{key} bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return _round_trip(docs, key, text, schema, lambda n, m, p, f: (n, len(p), sha(p), zlib.crc32(p[-16:]), len(m), sha(m), f))


def _round_trip(docs: DataFrame, key: str, text: str, schema: str, row) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    types = [kinds[x.split()[1]] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, texts in chunks(b, text):
                raw = [t.encode("utf-8", "surrogatepass") for t in texts]
                files = encode([r.ljust(max(1, -(-len(r) // UNIT)) * UNIT, PAD) for r in raw])
                rows = [row(len(r), f, payload_of(d), features(d)) for r, f, d in zip(raw, files, decode(files))]
                keys = b.column(0).slice(start, len(texts)).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([keys, *(pa.array([x[k] for x in rows], t) for k, t in enumerate(types[1:]))], names=names)

    return docs.select(F.col(key).alias(key), F.col(text).alias(text)).mapInArrow(run, schema)
