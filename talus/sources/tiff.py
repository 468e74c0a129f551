"""Single-band GeoTIFF files as NumPy arrays: the parts of the format that elevation grids use.

Reads classic TIFF of either byte order, in strips or tiles, plain or packed by LZW, Deflate or PackBits, with or
without a predictor. Writes little-endian files in strips packed by Deflate.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field

import numpy as np

# Fixed values of the format: tags, field types, compressions.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, ROWS, COUNTS = 256, 257, 258, 259, 262, 273, 277, 278, 279
PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS, SAMPLE_FORMAT = 317, 322, 323, 324, 325, 339
PIXEL_SCALE, TIEPOINT, TRANSFORM, GEO_KEYS, GEO_DOUBLES, GEO_ASCII, NODATA = 33550, 33922, 34264, 34735, 34736, 34737, 42113
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773


@dataclass
class GeoRef:
    """Cell sizes, the outer corner of the first cell, and the coordinate system's keys as the file holds them."""

    dx: float = 1.0
    dy: float = 1.0
    x: float = 0.0
    y: float = 0.0
    nodata: float | None = None
    keys: dict[int, tuple] = field(default_factory=dict)

    @property
    def area(self) -> float:
        return self.dx * self.dy


@dataclass
class Block:
    """A strip or tile, still packed."""

    row: int
    column: int
    rows: int
    columns: int
    data: bytes


class Tiff:
    """The directory of a file, and its blocks."""

    def __init__(self, data: bytes):
        order = {b"II": "<", b"MM": ">"}.get(data[:2])
        if order is None or struct.unpack(f"{order}H", data[2:4])[0] != 42:
            raise ValueError("not a classic TIFF file")
        self.order, self.data = order, data
        self.tags = self._directory(struct.unpack(f"{order}I", data[4:8])[0])
        self.columns, self.rows = self._one(WIDTH), self._one(LENGTH)
        self.packing, self.predictor = self._one(COMPRESSION, PLAIN), self._one(PREDICTOR, 1)
        if self._one(SAMPLES, 1) != 1:
            raise ValueError("more than one band")
        kind = {1: "u", 2: "i", 3: "f"}[self._one(SAMPLE_FORMAT, 1)]
        self.dtype = np.dtype(f"{order}{kind}{self._one(BITS, 8) // 8}")

    def _directory(self, at: int) -> dict[int, tuple]:
        tags = {}
        for k in range(struct.unpack_from(f"{self.order}H", self.data, at)[0]):
            tag, kind, n = struct.unpack_from(f"{self.order}HHI", self.data, at + 2 + 12 * k)
            if kind not in TYPES:
                continue
            form = f"{self.order}{n}s" if kind == 2 else f"{self.order}{n * len(TYPES[kind])}{TYPES[kind][0]}"
            place = at + 10 + 12 * k
            if struct.calcsize(form) > 4:
                place = struct.unpack_from(f"{self.order}I", self.data, place)[0]
            tags[tag] = struct.unpack_from(form, self.data, place)
        return tags

    def _one(self, tag: int, default: int | None = None) -> int:
        if tag not in self.tags and default is None:
            raise ValueError(f"TIFF tag {tag} is missing")
        return self.tags.get(tag, (default,))[0]

    @property
    def georef(self) -> GeoRef:
        out = GeoRef(keys={k: self.tags[k] for k in (GEO_KEYS, GEO_DOUBLES, GEO_ASCII) if k in self.tags})
        if PIXEL_SCALE in self.tags and TIEPOINT in self.tags:
            sx, sy = self.tags[PIXEL_SCALE][:2]
            i, j, _, x, y = self.tags[TIEPOINT][:5]
            out.dx, out.dy, out.x, out.y = abs(sx), abs(sy), x - i * sx, y + j * sy
        elif TRANSFORM in self.tags:
            t = self.tags[TRANSFORM]
            out.dx, out.dy, out.x, out.y = abs(t[0]), abs(t[5]), t[3], t[7]
        if NODATA in self.tags:
            out.nodata = float(self.tags[NODATA][0].rstrip(b"\0 ").decode())
        return out

    def blocks(self) -> list[Block]:
        tiled = TILE_OFFSETS in self.tags
        high, wide = (self._one(TILE_LENGTH), self._one(TILE_WIDTH)) if tiled else (min(self._one(ROWS, self.rows), self.rows), self.columns)
        across, out = -(-self.columns // wide), []
        for k, (at, n) in enumerate(zip(self.tags[TILE_OFFSETS if tiled else OFFSETS], self.tags[TILE_COUNTS if tiled else COUNTS], strict=True)):
            r, c = k // across * high, k % across * wide
            out.append(Block(r, c, high if tiled else min(high, self.rows - r), wide, self.data[at : at + n]))
        return out


def unpack(b: Block, dtype: np.dtype, packing: int, predictor: int, rows: int, columns: int) -> np.ndarray:
    """A block's values, cut to the part inside the grid."""
    size = b.rows * b.columns * dtype.itemsize
    raw = {PLAIN: bytes, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress, LZW: unlzw, PACKBITS: unpackbits}[packing](b.data)
    if predictor == 3:  # bytes of floats in planes, most significant first, as differences along a row
        planes = np.cumsum(np.frombuffer(raw[:size], np.uint8).reshape(b.rows, -1), axis=1, dtype=np.uint8)
        values = np.ascontiguousarray(planes.reshape(b.rows, dtype.itemsize, b.columns).transpose(0, 2, 1)).view(dtype.newbyteorder(">"))[..., 0]
    else:
        values = np.frombuffer(raw[:size], dtype).reshape(b.rows, b.columns)
        if predictor == 2:
            values = np.cumsum(values, axis=1, dtype=dtype)
    return values[: rows - b.row, : columns - b.column]


def unlzw(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits from the high end, 256 clears the table, 257 ends."""
    out, table, last = [], [], None
    value = held = at = 0
    width = 9
    while True:
        while held < width and at < len(data):
            value, held, at = (value << 8 | data[at]) & 0xFFFFFFFF, held + 8, at + 1
        if held < width:
            break
        held -= width
        code = value >> held & (1 << width) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, None
            continue
        if last is None:
            entry = table[code]
        else:
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
        out.append(entry)
        last = entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return b"".join(out)


def unpackbits(data: bytes) -> bytes:
    out, at = [], 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out.append(data[at + 1 : at + 2 + n])
            at += n + 2
        else:
            if n > 128:
                out.append(data[at + 1 : at + 2] * (257 - n))
            at += 2 if n > 128 else 1
    return b"".join(out)


def decode(data: bytes) -> tuple[np.ndarray, GeoRef]:
    """A whole file's grid and reference."""
    t = Tiff(data)
    grid = np.zeros((t.rows, t.columns), t.dtype.newbyteorder("="))
    for b in t.blocks():
        part = unpack(b, t.dtype, t.packing, t.predictor, t.rows, t.columns)
        grid[b.row : b.row + part.shape[0], b.column : b.column + part.shape[1]] = part
    return grid, t.georef


def encode(grid: np.ndarray, ref: GeoRef | None = None, strip: int = 64) -> bytes:
    """A file of the grid in strips of ``strip`` rows. Floats have NaN for no data; integers keep the reference's value."""
    ref = ref or GeoRef()
    grid = np.ascontiguousarray(grid, grid.dtype.newbyteorder("<"))
    rows, columns = grid.shape
    strips = [zlib.compress(grid[i : i + strip].tobytes(), 6) for i in range(0, rows, strip)]
    nodata = "nan" if grid.dtype.kind == "f" else None if ref.nodata is None else f"{ref.nodata:g}"
    fields = [
        (WIDTH, 4, (columns,)), (LENGTH, 4, (rows,)), (BITS, 3, (8 * grid.dtype.itemsize,)), (COMPRESSION, 3, (DEFLATE,)), (PHOTOMETRIC, 3, (1,)),
        (OFFSETS, 4, None), (SAMPLES, 3, (1,)), (ROWS, 4, (strip,)), (COUNTS, 4, tuple(map(len, strips))), (PREDICTOR, 3, (1,)),
        (SAMPLE_FORMAT, 3, ({"u": 1, "i": 2, "f": 3}[grid.dtype.kind],)), (PIXEL_SCALE, 12, (ref.dx, ref.dy, 0.0)), (TIEPOINT, 12, (0.0, 0.0, 0.0, ref.x, ref.y, 0.0)),
        *((tag, {GEO_KEYS: 3, GEO_DOUBLES: 12, GEO_ASCII: 2}[tag], value) for tag, value in ref.keys.items()),
    ]
    if nodata is not None:
        fields.append((NODATA, 2, (nodata.encode() + b"\0",)))
    head = 8 + 2 + 12 * len(fields) + 4
    size = lambda kind, v: len(v[0]) if kind == 2 else struct.calcsize(f"<{len(v)}{TYPES[kind]}")
    offsets, at = [], head + sum(s + s % 2 for _, kind, v in fields if (s := size(kind, v or (0,) * len(strips))) > 4)
    for s in strips:
        offsets.append(at)
        at += len(s)
    if at >= 1 << 32:
        raise ValueError("larger than a classic TIFF file can be")
    directory, extra, place = [], [], head
    for tag, kind, v in sorted(fields, key=lambda f: f[0]):
        v = tuple(offsets) if v is None else v
        raw = v[0] if kind == 2 else struct.pack(f"<{len(v)}{TYPES[kind]}", *v)
        if len(raw) > 4:
            directory.append(struct.pack("<HHII", tag, kind, len(v[0]) if kind == 2 else len(v), place))
            extra.append(raw + b"\0" * (len(raw) % 2))
            place += len(extra[-1])
        else:
            directory.append(struct.pack("<HHI", tag, kind, len(v[0]) if kind == 2 else len(v)) + raw.ljust(4, b"\0"))
    return b"".join([struct.pack("<2sHIH", b"II", 42, 8, len(fields)), *directory, struct.pack("<I", 0), *extra, *strips])
