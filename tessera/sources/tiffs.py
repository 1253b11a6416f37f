"""The TIFF container: directories, chunk codecs and georeference tags, for the data source in geotiff.py. Each call works on a
directory or on one chunk."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field

import numpy as np

# Fixed values of the format: tags, field types, compressions, sample formats, and GeoTIFF's keys.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, STRIP_ROWS, STRIP_COUNTS, PLANAR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS, SAMPLE_FORMAT = 317, 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINT, TRANSFORM, GEO_KEYS, GEO_DOUBLES, GEO_ASCII, NODATA = 33550, 33922, 34264, 34735, 34736, 34737, 42113
FIELD = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACK_BITS = 1, 5, 8, 32946, 32773
KINDS = {1: "u", 2: "i", 3: "f"}
MODEL_TYPE, RASTER_TYPE, GEOGRAPHIC, RADIUS_A, RADIUS_B, PROJECTED, PROJECTION, PARALLEL, MERIDIAN, UNITS = 1024, 1025, 2048, 2057, 2058, 3072, 3075, 3078, 3080, 3076
EQUIRECTANGULAR, METRE, USER = 17, 9001, 32767

Geotransform = tuple[float, float, float, float, float, float]


@dataclass(frozen=True)
class Layout:
    """What a directory says of one image. geotransform: x = g0 + col g1 + row g2, y = g3 + col g4 + row g5. offsets, counts: where
    each chunk's bytes are; those of length 0 were never written."""

    height: int
    width: int
    bands: int
    dtype: str
    chunk_h: int
    chunk_w: int
    planar: bool
    compression: int
    predictor: int
    offsets: np.ndarray
    counts: np.ndarray
    nodata: float | None = None
    geotransform: Geotransform | None = None
    keys: dict[int, float] = field(default_factory=dict)

    @property
    def grid(self) -> tuple[int, int]:
        return -(-self.height // self.chunk_h), -(-self.width // self.chunk_w)

    @property
    def projected(self) -> bool:
        return self.keys.get(MODEL_TYPE) == 1


def read_layout(read) -> Layout:
    """The first image's layout; read(offset, length) gives a file's bytes. Classic and 64-bit files, of either byte order."""
    head = read(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    version = struct.unpack(order + "H", head[2:4])[0] if order else 0
    if version == 42:
        at, (count, entry, inline) = struct.unpack(order + "I", head[4:8])[0], ("H", "HHI", 4)
    elif version == 43:
        at, (count, entry, inline) = struct.unpack(order + "Q", head[8:16])[0], ("Q", "HHQ", 8)
    else:
        raise ValueError("not a TIFF file")
    n_size, size = struct.calcsize(order + count), struct.calcsize(order + entry) + inline
    n = struct.unpack(order + count, read(at, n_size))[0]
    table, tags = read(at + n_size, n * size), {}
    for k in range(n):
        row = table[k * size : (k + 1) * size]
        tag, kind, many = struct.unpack(order + entry, row[:-inline])
        if kind not in FIELD:
            continue
        length = struct.calcsize(order + FIELD[kind]) * many
        raw = row[-inline:][:length] if length <= inline else read(struct.unpack(order + ("I" if inline == 4 else "Q"), row[-inline:])[0], length)
        tags[tag] = raw.rstrip(b"\0").decode("latin-1") if kind == 2 else np.frombuffer(raw, np.dtype(FIELD[kind][0]).newbyteorder(order))
    return _layout(tags, order)


def _layout(tags: dict, order: str) -> Layout:
    def one(tag: int, default: int) -> int:
        return int(tags[tag][0]) if tag in tags and len(tags[tag]) else default

    bits, kind = {int(b) for b in tags.get(BITS, [1])}, {int(k) for k in tags.get(SAMPLE_FORMAT, [1])}
    if len(bits) != 1 or len(kind) != 1 or next(iter(bits)) not in (8, 16, 32, 64) or next(iter(kind)) not in KINDS:
        raise ValueError(f"samples of {sorted(bits)} bits and formats {sorted(kind)} aren't read")
    dtype = np.dtype(f"{KINDS[next(iter(kind))]}{next(iter(bits)) // 8}").newbyteorder(order)
    height, width, tiled = one(LENGTH, 0), one(WIDTH, 0), TILE_OFFSETS in tags
    bands = one(SAMPLES, 1)
    nodata = float(tags[NODATA]) if tags.get(NODATA, "").strip() else None
    offsets, counts = (tags[TILE_OFFSETS], tags[TILE_COUNTS]) if tiled else (tags[STRIP_OFFSETS], tags[STRIP_COUNTS])
    chunk_h, chunk_w = (one(TILE_LENGTH, 0), one(TILE_WIDTH, 0)) if tiled else (min(one(STRIP_ROWS, height), height), width)
    keys: dict[int, float] = {}
    if GEO_KEYS in tags:
        words, doubles = tags[GEO_KEYS].astype(int), tags.get(GEO_DOUBLES, np.zeros(0))
        for key, where, _, value in words[4 : 4 + 4 * words[3]].reshape(-1, 4).tolist():
            if where == 0:
                keys[key] = value
            elif where == GEO_DOUBLES and value < len(doubles):
                keys[key] = float(doubles[value])
    out = Layout(height, width, bands, dtype.str, chunk_h, chunk_w, one(PLANAR, 1) == 2, one(COMPRESSION, NONE), one(PREDICTOR, 1), offsets.astype(np.int64), counts.astype(np.int64), nodata, _geotransform(tags, keys), keys)
    wanted = out.grid[0] * out.grid[1] * (bands if out.planar else 1)
    if not height or not width or len(out.offsets) < wanted or len(out.counts) < wanted:
        raise ValueError(f"a directory with {len(out.offsets)} chunks for {wanted}")
    return out


def _geotransform(tags: dict, keys: dict) -> Geotransform | None:
    """To the outer corner of the first pixel; where places are those of pixel middles, moved by half a pixel."""
    if TRANSFORM in tags:
        m = tags[TRANSFORM].astype(float)
        g = (m[3], m[0], m[1], m[7], m[4], m[5])
    elif PIXEL_SCALE in tags and TIE_POINT in tags:
        sx, sy = tags[PIXEL_SCALE][:2].astype(float)
        i, j, _, x, y = tags[TIE_POINT][:5].astype(float)
        g = (x - i * sx, sx, 0.0, y + j * sy, 0.0, -sy)
    else:
        return None
    if keys.get(RASTER_TYPE) == 2:
        g = (g[0] - (g[1] + g[2]) / 2, g[1], g[2], g[3] - (g[4] + g[5]) / 2, g[4], g[5])
    return tuple(float(v) for v in g)


# ---------------------------------------------------------------- codecs


def lzw_decoded(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bits first, which widen one code early; 256 clears, 257 ends."""
    singles = [bytes([k]) for k in range(256)] + [b"", b""]
    table, out, width, held, bits, last = list(singles), [], 9, 0, 0, None
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & (1 << width) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = list(singles), 9, None
            continue
        if last is None:
            word = table[code]
        else:
            if code < len(table):
                word = table[code]
            elif code == len(table):
                word = last + last[:1]
            else:
                raise ValueError("an LZW code that isn't in the table")
            table.append(last + word[:1])
            width = min(12, max(9, (len(table) + 1).bit_length()))
        out.append(word)
        last = word
    return b"".join(out)


def lzw_encoded(data: bytes) -> bytes:
    out, held, bits = bytearray(), 0, 0
    singles = {bytes([k]): k for k in range(256)}
    table, size, width, word = dict(singles), 258, 9, b""

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    put(256)
    for k in range(len(data)):
        longer = word + data[k : k + 1]
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer] = size
        size += 1
        if size == 4094:  # the decoder's table, one behind, must not widen past 12 bits
            put(256)
            table, size, width = dict(singles), 258, 9
        else:
            width = size.bit_length()
        word = data[k : k + 1]
    if word:
        put(table[word])
        width = min(12, (size + 1).bit_length())
    put(257)
    if bits:
        out.append(held << 8 - bits & 255)
    return bytes(out)


def _unpacked(data: bytes) -> bytes:
    out, k = [], 0
    while k < len(data):
        n = data[k]
        if n < 128:
            out.append(data[k + 1 : k + 2 + n])
            k += 2 + n
        else:
            if n > 128:
                out.append(data[k + 1 : k + 2] * (257 - n))
            k += 2 if n > 128 else 1
    return b"".join(out)


def decoded(data: bytes, at: Layout) -> np.ndarray:
    """A chunk's bytes as an array (chunk_h or fewer rows, chunk_w, samples), in the machine's byte order."""
    samples = 1 if at.planar else at.bands
    if at.compression == LZW:
        data = lzw_decoded(data)
    elif at.compression in (DEFLATE, OLD_DEFLATE):
        data = zlib.decompress(data)
    elif at.compression == PACK_BITS:
        data = _unpacked(data)
    elif at.compression != NONE:
        raise ValueError(f"compression {at.compression} isn't read")
    dtype = np.dtype(at.dtype)
    row = at.chunk_w * samples * dtype.itemsize
    rows = min(len(data) // row, at.chunk_h)  # the last strip may be short
    if at.predictor == 3:
        # Bytes of a row stand by significance, the most significant first, as differences to the byte `samples` before.
        planes = np.frombuffer(data, np.uint8, rows * row).reshape(rows, -1, samples)
        flat = np.cumsum(planes, axis=1, dtype=np.uint8).reshape(rows, dtype.itemsize, at.chunk_w * samples)
        return np.ascontiguousarray(flat.swapaxes(1, 2)).view(dtype.newbyteorder(">")).astype(dtype.newbyteorder("=")).reshape(rows, at.chunk_w, samples)
    a = np.frombuffer(data, dtype, rows * at.chunk_w * samples).reshape(rows, at.chunk_w, samples).astype(dtype.newbyteorder("="))
    return np.cumsum(a, axis=1, dtype=a.dtype) if at.predictor == 2 else a


def encoded(a: np.ndarray, compression: int, predictor: int = 1, level: int = 6) -> bytes:
    """A chunk of one band as bytes, least significant first."""
    a = np.ascontiguousarray(a)
    if predictor == 2:
        a = np.concatenate([a[:, :1], np.diff(a, axis=1).astype(a.dtype)], axis=1)
    data = a.astype(a.dtype.newbyteorder("<")).tobytes()
    return {NONE: bytes, LZW: lzw_encoded, DEFLATE: lambda b: zlib.compress(b, level)}[compression](data)


def most_bytes(size: int, compression: int) -> int:
    """Bytes that encoded can make of a chunk of that many."""
    return {NONE: size, LZW: 3 * size // 2 + 64, DEFLATE: size + size // 1000 + 64}[compression]


# ---------------------------------------------------------------- directories


def directory(
    at: int, height: int, width: int, bands: int, dtype: np.dtype, tile: int, compression: int, predictor: int, offsets: np.ndarray, counts: np.ndarray,
    nodata: float | None = None, geotransform: Geotransform | None = None, radius: float | None = None,
) -> bytes:
    """A 64-bit directory that stands at a file's offset at, with what doesn't fit into its fields after it. radius: of the sphere of
    an equirectangular projection in metres; without one there is no reference system."""
    kind = {"u": 1, "i": 2, "f": 3}[dtype.kind]
    tags: list[tuple[int, int, object]] = [
        (WIDTH, 4, [width]), (LENGTH, 4, [height]), (BITS, 3, [8 * dtype.itemsize] * bands), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [2 if bands == 3 and dtype == np.uint8 else 1]),
        (SAMPLES, 3, [bands]), (PLANAR, 3, [2 if bands > 1 else 1]), (PREDICTOR, 3, [predictor]), (TILE_WIDTH, 4, [tile]), (TILE_LENGTH, 4, [tile]),
        (TILE_OFFSETS, 16, offsets), (TILE_COUNTS, 16, counts), (SAMPLE_FORMAT, 3, [kind] * bands),
    ]
    if geotransform is not None:
        g = geotransform
        if g[2] == 0 and g[4] == 0 and g[1] > 0 > g[5]:
            tags += [(PIXEL_SCALE, 12, [g[1], -g[5], 0.0]), (TIE_POINT, 12, [0.0, 0.0, 0.0, g[0], g[3], 0.0])]
        else:
            tags.append((TRANSFORM, 12, [g[1], g[2], 0.0, g[0], g[4], g[5], 0.0, g[3], 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0]))
        if radius is not None:
            plain = [(MODEL_TYPE, 1), (RASTER_TYPE, 1), (GEOGRAPHIC, USER), (PROJECTED, USER), (PROJECTION, EQUIRECTANGULAR), (UNITS, METRE)]
            real = [(RADIUS_A, radius), (RADIUS_B, radius), (PARALLEL, 0.0), (MERIDIAN, 0.0)]
            rows = sorted([(k, 0, 1, v) for k, v in plain] + [(k, GEO_DOUBLES, 1, n) for n, (k, _) in enumerate(real)])
            tags += [(GEO_KEYS, 3, [1, 1, 0, len(rows), *(v for row in rows for v in row)]), (GEO_DOUBLES, 12, [v for _, v in real])]
        else:
            tags.append((GEO_KEYS, 3, [1, 1, 0, 1, RASTER_TYPE, 0, 1, 1]))
    if nodata is not None:
        tags.append((NODATA, 2, f"{nodata:.17g}".encode() + b"\0"))
    tags.sort(key=lambda t: t[0])
    rows, rest, free = [], [], at + 8 + 20 * len(tags) + 8
    for tag, kind_of, value in tags:
        raw = value if kind_of == 2 else np.asarray(value).astype(np.dtype(FIELD[kind_of]).newbyteorder("<")).tobytes()
        many = len(raw) // (1 if kind_of == 2 else struct.calcsize("<" + FIELD[kind_of]))
        if len(raw) > 8:
            rest.append(raw + bytes(-len(raw) % 8))
            raw, free = struct.pack("<Q", free), free + len(rest[-1])
        rows.append(struct.pack("<HHQ", tag, kind_of, many) + raw.ljust(8, b"\0"))
    return struct.pack("<Q", len(tags)) + b"".join(rows) + bytes(8) + b"".join(rest)


def header(directory_at: int) -> bytes:
    return b"II" + struct.pack("<HHHQ", 43, 8, 0, directory_at)
