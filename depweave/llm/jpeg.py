"""Progressive JPEG in numpy: scans to coefficients and back, coefficients to RGB.

Scans are cut by restart markers into segments that can be decoded apart from each other, so the
decoder steps through all segments of all images at once: one step reads one symbol in each of
some thousand segments.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

#: The zigzag order of a block of 8 x 8, as places in row order.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8) if (i // 8 + i % 8) % 2 else (i % 8))))
#: Segments that are decoded, or blocks that are encoded, at once.
LANES, BLOCKS = 4096, 1 << 14
_U8, _U64 = np.uint8, np.uint64


@lru_cache(64)
def _once(table: bytes) -> np.ndarray:
    return _at_once(_lookup(table[:16], table[16:]))


def _canonical(counts: list[int], symbols: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Code and length of each symbol: codes count up within a length and double from one to the next."""
    codes, lengths, code, at = np.zeros(256, np.uint32), np.zeros(256, np.uint8), 0, 0
    for length, n in enumerate(counts, 1):
        for symbol in symbols[at : at + n]:
            codes[symbol], lengths[symbol] = code, length
            code += 1
        at += n
        code <<= 1
    return codes, lengths


def _at_once(table: np.ndarray) -> np.ndarray:
    """For every 16 bits that begin with a symbol for a value and that value: its run, value and bits; -1 for others.

    Packed as bits + 64 * run + 1024 * (value + 2**15).
    """
    used, symbol = table & 31, table >> 5
    run, size = symbol >> 4, symbol & 15
    fits = (used > 0) & (size > 0) & (used + size <= 16)
    bits = (np.arange(1 << 16) >> np.where(fits, 16 - used - size, 0)) & ((1 << np.where(fits, size, 0)) - 1)
    value = _extend(bits, np.where(fits, size, 0))
    return np.where(fits, used + size + 64 * run + 1024 * (value + (1 << 15)), -1).astype(np.int64)


@lru_cache(64)
def _lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """For every 16 bits the symbol and the length of the code that they begin with, as symbol * 32 + length."""
    codes, lengths = _canonical(list(counts), list(symbols))
    table = np.zeros(1 << 16, np.int32)
    for s in symbols:
        n = int(lengths[s])
        first = int(codes[s]) << (16 - n)
        table[first : first + (1 << (16 - n))] = s * 32 + n
    return table


def _spread(frequent: list[int], shorts: list[int]) -> tuple[list[int], list[int]]:
    rest = [s for s in range(256) if s % 16 <= 10 and s not in frequent]
    counts = [0] * 16
    for n, length in shorts:
        counts[length - 1] = n
    left = len(frequent) + len(rest) - sum(counts)
    counts[11] = left
    return counts, frequent + rest


#: The writer's tables: categories of DC differences in 4 bits; of AC symbols the usual ones in 2 to 4 bits, some in 8, the rest in 12.
DC_TABLE = ([0, 0, 0, 12] + [0] * 12, list(range(12)))
AC_TABLE = _spread([0x06, 0x05, 0x07, 0x00, 0x04, 0x01, 0x02, 0x03, 0x08, *(0x10 * r + s for r in (1, 2) for s in (4, 5, 6, 7)), 0x11, 0x21, 0xF0, 0x31, 0x41], [(2, 2), (2, 3), (2, 4), (16, 8)])
_DC_CODES, _AC_CODES = _canonical(*DC_TABLE), _canonical(*AC_TABLE)


def _category(v: np.ndarray) -> np.ndarray:
    """Bits of the magnitude."""
    return np.ceil(np.log2(np.abs(v) + 1.0)).astype(np.int64)


#: Values of up to 10 bits, and for each run of zeros and value its code with the extra bits, and how long that is.
_REACH = 1024
_VALUES = np.arange(-_REACH, _REACH)
_SIZES = np.minimum(_category(_VALUES), 10)
_EXTRA = np.where(_VALUES < 0, _VALUES + (1 << _SIZES) - 1, _VALUES)
_RUNS = np.arange(16)[:, None] * 16 + _SIZES[None, :]
_RUN_CODES = ((_AC_CODES[0][_RUNS].astype(np.int64) << _SIZES) | _EXTRA).astype(np.int32).ravel()
_RUN_LENGTHS = (_AC_CODES[1][_RUNS] + _SIZES).astype(np.int32).ravel()


def pack(codes: np.ndarray, lengths: np.ndarray, segments: np.ndarray, n_segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of up to 32 bits in order, as bytes, and the number of bytes of each segment; segments are filled up with ones."""
    bits = np.bincount(segments, weights=lengths, minlength=n_segments).astype(np.int64)
    sizes = (bits + 7) // 8
    starts = np.cumsum(sizes) - sizes
    at = np.cumsum(lengths, dtype=np.int64)
    at -= lengths
    at += (starts * 8 - (np.cumsum(bits) - bits))[segments]
    fill = sizes * 8 - bits
    total = int(sizes.sum())
    out = np.zeros(total // 4 + 3)
    for c, n, where in ((codes, lengths, at), ((1 << fill) - 1, fill, starts * 8 + bits)):
        words = c.astype(_U64) << (64 - n - (where & 31)).astype(_U64)
        if not n.all():
            words[n == 0] = 0
        word = where >> 5
        out += np.bincount(word, weights=words >> _U64(32), minlength=len(out))
        out[1:] += np.bincount(word, weights=words & _U64(0xFFFFFFFF), minlength=len(out))[:-1]
    return out.astype(">u4").view(_U8)[:total], sizes


def _dc_items(values: np.ndarray, component: np.ndarray, segments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Differences from the block before of the same component in the same segment."""
    before = np.zeros(len(values), np.int64)
    for c in np.unique(component):
        i = np.flatnonzero(component == c)
        before[i[1:]] = np.where(segments[i[1:]] == segments[i[:-1]], values[i[:-1]], 0)
    diff = values - before
    size = _category(diff)
    extra = np.where(diff < 0, diff + (1 << size) - 1, diff)
    return (_DC_CODES[0][size].astype(np.int64) << size) | extra, _DC_CODES[1][size].astype(np.int64) + size


def _ac_items(blocks: np.ndarray, al: int, segments: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First pass over a band: runs of zeros with the value that ends them, and the end of the block; also the items of each block."""
    values = np.where(blocks < 0, -(-blocks >> al), blocks >> al)
    width, full = blocks.shape[1], values.all(axis=1)
    if full.any():
        some = np.flatnonzero(~full)
        codes, lengths, _, rest = _ac_items(blocks[some], al, segments[some]) if len(some) else (None, None, None, np.zeros(0, np.int64))
        per_row = np.full(len(blocks), width)
        per_row[some] = rest
        out, sizes = np.empty(int(per_row.sum()), np.int32), np.empty(int(per_row.sum()), np.int32)
        mine = np.repeat(full, per_row)
        place = values[full].ravel() + _REACH
        out[mine], sizes[mine] = _RUN_CODES[place], _RUN_LENGTHS[place]
        if len(some):
            out[~mine], sizes[~mine] = codes, lengths
        return out, sizes, np.repeat(segments, per_row), per_row
    row, k = np.nonzero(values)
    before = np.full(len(k), -1)
    same = row[1:] == row[:-1]
    before[1:][same] = k[:-1][same]
    run = k - before - 1
    place = (run & 15) * (2 * _REACH) + values[row, k] + _REACH
    code, length = _RUN_CODES[place], _RUN_LENGTHS[place]
    last = np.full(len(blocks), -1)
    last[row] = k
    ends = last < blocks.shape[1] - 1
    many = 1 + (run >> 4)
    place = np.cumsum(many) - 1 + (np.cumsum(ends) - ends)[row]
    per_row = np.bincount(row, weights=many, minlength=len(blocks)).astype(np.int64)
    total = int(many.sum() + ends.sum())
    codes, lengths = np.full(total, int(_AC_CODES[0][0xF0]), np.int32), np.full(total, int(_AC_CODES[1][0xF0]), np.int32)
    codes[place], lengths[place] = code, length
    at_end = (np.cumsum(per_row) + np.cumsum(ends) - 1)[ends]
    codes[at_end], lengths[at_end] = int(_AC_CODES[0][0]), int(_AC_CODES[1][0])
    return codes, lengths, np.repeat(segments, per_row + ends), per_row + ends


def _refine_items(blocks: np.ndarray, segments: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Last bit of a band: values that become nonzero with the zeros before them, and one more bit of all known values."""
    size, weight = np.abs(blocks), blocks.shape[1]
    known = size > 1
    number, fresh = known.sum(axis=1), (size == 1).any(axis=1)
    end, end_bits = int(_AC_CODES[0][0]), int(_AC_CODES[1][0])
    full = np.flatnonzero((number == weight) & ~fresh)
    parts = np.array_split(np.arange(weight), 3)
    n = len(blocks)
    per_row = np.ones(n, np.int64)
    per_row[full] = 4
    odd = np.flatnonzero(fresh | ((number > 0) & (number < weight)))
    written = [_refine_block(blocks[i]) for i in odd]
    per_row[odd] = [len(w) for w in written]
    start = np.cumsum(per_row) - per_row
    codes, lengths = np.full(int(per_row.sum()), end, np.int64), np.full(int(per_row.sum()), end_bits, np.int64)
    bits = size[full] & 1
    for k, part in enumerate(parts, 1):
        codes[start[full] + k], lengths[start[full] + k] = bits[:, part].astype(np.int64) @ (1 << np.arange(len(part) - 1, -1, -1)), len(part)
    for i, w in zip(odd, written, strict=True):
        codes[start[i] : start[i] + len(w)], lengths[start[i] : start[i] + len(w)] = [x for x, _ in w], [x for _, x in w]
    return codes, lengths, np.repeat(segments, per_row)


def _refine_block(block: np.ndarray) -> list[tuple[int, int]]:
    out, waiting, zeros = [], [], 0
    later = np.flatnonzero(np.abs(block) == 1)
    last = later[-1] if len(later) else -1
    put = lambda symbol: out.append((int(_AC_CODES[0][symbol]), int(_AC_CODES[1][symbol])))
    for k, v in enumerate(block.tolist()):
        if abs(v) > 1:
            waiting.append((abs(v) & 1, 1))
        elif abs(v) == 1:
            put(zeros * 16 + 1)
            out += [(int(v > 0), 1), *waiting]
            waiting, zeros = [], 0
        else:
            zeros += 1
            if zeros == 16 and k < last:
                put(0xF0)
                out += waiting
                waiting, zeros = [], 0
    if last < len(block) - 1:
        put(0)
    return out + waiting


#: Blocks, or MCUs of an interleaved scan, between restart markers.
RESTART = 8


def _segment(kind: int, body: bytes) -> bytes:
    return bytes([0xFF, kind]) + (len(body) + 2).to_bytes(2, "big") + body


def encode_blocks(images: list[np.ndarray], notes: list[bytes]) -> list[bytes]:
    """Progressive files, chroma at half resolution, of blocks of quantized coefficients in zigzag order.

    Each image is an array (6 m, 64) of values of at most 10 bits: 4 m blocks of Y in row order of
    an image of ceil(m / ceil(sqrt(m))) rows of MCUs, then m of Cb and m of Cr; m is a number of
    whole rows (see ``shape``). The note goes into a comment. Scans: DC without its last bit; two
    bands of Y, then Cb and Cr, without their last bits; the last bits of each.
    """
    files = []
    heads = [_head(x, n) for x, n in zip(images, notes, strict=True)]
    bodies: list[list[bytes]] = [[] for _ in images]
    grids = [shape(len(x)) for x in images]
    scans = [((0, 1, 2), 0, 0, 0, 1), ((0,), 1, 5, 0, 1), ((0,), 6, 63, 0, 1), ((1,), 1, 63, 0, 1), ((2,), 1, 63, 0, 1), ((0,), 1, 63, 1, 0), ((1,), 1, 63, 1, 0), ((2,), 1, 63, 1, 0), ((0, 1, 2), 0, 0, 1, 0)]
    for components, first, last, high, low in scans:
        head = _segment(0xDA, bytes([len(components), *(b for c in components for b in (c + 1, 0)), first, last, high * 16 + low]))
        data, counts = [], []
        for x, (rows, cols) in zip(images, grids, strict=True):
            if len(components) == 3:
                order, component, unit = *_mcu_order(rows, cols), RESTART * 6
            else:
                m = rows * cols
                lo, hi = (0, 4 * m) if components[0] == 0 else (4 * m, 5 * m) if components[0] == 1 else (5 * m, 6 * m)
                order, component, unit = np.arange(lo, hi), None, RESTART
            chunk = BLOCKS // unit * unit
            for at in range(0, len(order), chunk):
                data.append((x[order[at : at + chunk], first : last + 1], None if component is None else component[at : at + chunk], unit))
            counts.append(-(-len(order) // chunk))
        streams = _entropy(data, high, low, first == 0)
        at = 0
        for i, n in enumerate(counts):
            bodies[i] += [head, _with_restarts(streams[at : at + n])]
            at += n
    for h, b in zip(heads, bodies, strict=True):
        files.append(b"".join([h, *b, b"\xff\xd9"]))
    return files


def shape(n_blocks: int) -> tuple[int, int]:
    """Rows and columns of MCUs of an image of 6 * rows * cols blocks."""
    m = n_blocks // 6
    cols = next(c for c in range(int(np.ceil(np.sqrt(m))), 0, -1) if m % c == 0)
    return m // cols, cols


def whole(n_blocks: int) -> int:
    """The least number of blocks, n_blocks or more, that fills whole rows of MCUs."""
    m = max(1, -(-n_blocks // 6))
    cols = int(np.ceil(np.sqrt(m)))
    return 6 * cols * -(-m // cols)


@lru_cache(256)
def _mcu_order(rows: int, cols: int) -> tuple[np.ndarray, np.ndarray]:
    m = rows * cols
    y = np.arange(4 * m).reshape(rows, 2, cols, 2).transpose(0, 2, 1, 3).reshape(m, 4)
    order = np.concatenate([y, np.arange(4 * m, 5 * m)[:, None], np.arange(5 * m, 6 * m)[:, None]], axis=1).ravel()
    return order, np.tile(np.array([0, 0, 0, 0, 1, 2]), m)


def _entropy(data: list, high: int, low: int, dc: bool) -> list[list[bytes]]:
    """The stuffed bytes of the segments of each piece of data; pieces are packed together up to BLOCKS blocks."""
    out, group, held = [], [], 0
    for i, piece in enumerate(data):
        group.append(piece)
        held += len(piece[0])
        if held >= BLOCKS or i + 1 == len(data):
            out += _entropy_group(group, high, low, dc)
            group, held = [], 0
    return out


def _entropy_group(group: list, high: int, low: int, dc: bool) -> list[list[bytes]]:
    blocks = np.concatenate([x for x, _, _ in group]).astype(np.int32)
    sizes = [-(-len(x) // unit) for x, _, unit in group]
    base = np.cumsum(sizes) - sizes
    segments = np.concatenate([b + np.arange(len(x)) // unit for b, (x, _, unit) in zip(base, group, strict=True)])
    total = int(sum(sizes))
    if dc and not high:
        codes, lengths = _dc_items(blocks[:, 0] >> low, np.concatenate([c for _, c, _ in group]), segments)
    elif dc:
        codes, lengths = ((blocks[:, 0] >> low) & 1).astype(np.int64), np.ones(len(blocks), np.int64)
    elif not high:
        codes, lengths, segments, _ = _ac_items(blocks, low, segments)
    else:
        codes, lengths, segments = _refine_items(blocks, segments)
    raw, lengths = pack(codes, lengths, segments, total)
    stuff = np.flatnonzero(raw == 255)
    ends = np.cumsum(lengths)
    ends = ends + np.searchsorted(stuff, ends, "left")
    raw = np.insert(raw, stuff + 1, 0).tobytes()
    cuts = [0, *ends.tolist()]
    pieces = [raw[a:b] for a, b in zip(cuts, cuts[1:])]
    return [pieces[b : b + n] for b, n in zip(base.tolist(), sizes, strict=True)]


def _with_restarts(pieces: list[list[bytes]]) -> bytes:
    flat = [p for ps in pieces for p in ps]
    marks = [bytes([0xFF, 0xD0 + i % 8]) for i in range(8)]
    return b"".join(x for i, p in enumerate(flat) for x in ((marks[(i - 1) % 8], p) if i else (p,)))


def _head(blocks: np.ndarray, note: bytes) -> bytes:
    rows, cols = shape(len(blocks))
    table = lambda kind, t: bytes([kind, *t[0], *t[1]])
    frame = bytes([8]) + (16 * rows).to_bytes(2, "big") + (16 * cols).to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    return b"".join([
        b"\xff\xd8", _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"), _segment(0xFE, note), _segment(0xDB, bytes([0]) + bytes([1] * 64)), _segment(0xC2, frame),
        _segment(0xC4, table(0x00, DC_TABLE) + table(0x10, AC_TABLE)), _segment(0xDD, RESTART.to_bytes(2, "big")),
    ])


@dataclass
class Component:
    id: int
    h: int
    v: int
    quant: int
    first: int = 0
    rows: int = 0
    cols: int = 0


@dataclass
class Scan:
    """A scan of one image: components with their tables, band, bits, restart interval and coded bytes."""

    parts: list[tuple[int, int, int]]
    band: tuple[int, int, int, int]
    restart: int
    tables: dict[tuple[int, int], bytes]
    data: bytes


@dataclass
class Image:
    """A parsed file. ``coefficients``: blocks of all components, one component after the other, in zigzag order."""

    width: int = 0
    height: int = 0
    components: list[Component] = field(default_factory=list)
    quants: dict[int, np.ndarray] = field(default_factory=dict)
    scans: list[Scan] = field(default_factory=list)
    note: bytes = b""
    coefficients: np.ndarray | None = None


def parse(file: bytes) -> Image:
    """Reads the frame, tables and scans of a progressive file; scans are kept undecoded."""
    image, at, tables, restart = Image(), 2, {}, 0
    if file[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    while at < len(file):
        if file[at] != 0xFF:
            raise ValueError("marker expected")
        kind = file[at + 1]
        if kind == 0xFF:
            at += 1
            continue
        if kind == 0xD9:
            break
        size = int.from_bytes(file[at + 2 : at + 4], "big")
        body, at = file[at + 4 : at + 2 + size], at + 2 + size
        if kind == 0xFE:
            image.note = body
        elif kind == 0xDB:
            while body:
                wide, which = body[0] >> 4, body[0] & 15
                image.quants[which] = np.frombuffer(body[1 : 1 + 64 * (wide + 1)], ">u2" if wide else "u1").astype(np.float32)
                body = body[1 + 64 * (wide + 1) :]
        elif kind == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0] >> 4, body[0] & 15] = body[1 : 17 + n]
                body = body[17 + n :]
        elif kind == 0xDD:
            restart = int.from_bytes(body, "big")
        elif kind == 0xC2:
            image.height, image.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            image.components = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
            _lay_out(image)
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC8, 0xCC):
            raise ValueError("only progressive Huffman files of 8 bits are read")
        elif kind == 0xDA:
            ids = {c.id: i for i, c in enumerate(image.components)}
            parts = [(ids[body[1 + 2 * i]], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            first, last, bits = body[-3:]
            end = at
            while True:
                end = file.find(b"\xff", end)
                if end < 0 or end + 1 >= len(file):
                    end = len(file)
                    break
                if file[end + 1] == 0 or 0xD0 <= file[end + 1] <= 0xD7:
                    end += 2
                    continue
                break
            image.scans.append(Scan(parts, (first, last, bits >> 4, bits & 15), restart, dict(tables), file[at:end]))
            at = end
    return image


def _lay_out(image: Image) -> None:
    """Rows and columns of blocks of each component, filled up to whole MCUs."""
    hm, vm = max(c.h for c in image.components), max(c.v for c in image.components)
    rows, cols = -(-image.height // (8 * vm)), -(-image.width // (8 * hm))
    at = 0
    for c in image.components:
        c.first, c.rows, c.cols = at, rows * c.v, cols * c.h
        at += c.rows * c.cols
    image.coefficients = np.zeros((at, 64), np.int16)


def _scan_blocks(image: Image, scan: Scan) -> tuple[np.ndarray, np.ndarray, int]:
    """Blocks in the order of a scan, the part of the scan that each belongs to, and blocks between restarts (0: none)."""
    grid = tuple((c.h, c.v, c.first, c.rows, c.cols) for c in image.components)
    order, parts, unit = _scan_order(image.height, image.width, grid, tuple(i for i, _, _ in scan.parts))
    return order, parts, scan.restart * unit


@lru_cache(256)
def _scan_order(height: int, width: int, grid: tuple, chosen: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, int]:
    hm, vm = max(c[0] for c in grid), max(c[1] for c in grid)
    if len(chosen) == 1:
        h, v, first, _, cols = grid[chosen[0]]
        down, across = -(-(-(-height * v // vm)) // 8), -(-(-(-width * h // hm)) // 8)
        order = (first + np.arange(down)[:, None] * cols + np.arange(across)[None, :]).ravel()
        return order, np.zeros(len(order), np.int64), 1
    orders, parts = [], []
    for p, i in enumerate(chosen):
        h, v, first, rows, cols = grid[i]
        orders.append(np.arange(first, first + rows * cols).reshape(rows // v, v, cols // h, h).transpose(0, 2, 1, 3).reshape(-1, v * h))
        parts += [p] * (v * h)
    order = np.concatenate(orders, axis=1)
    return order.ravel(), np.tile(np.array(parts), len(order)), len(parts)


def decode_scans(images: list[Image]) -> None:
    """Fills the coefficients of all images; scans that stand at the same place and have the same parameters are decoded together."""
    blocks, base = np.concatenate([x.coefficients for x in images]), np.cumsum([0] + [len(x.coefficients) for x in images])
    for k in range(max((len(x.scans) for x in images), default=0)):
        alike: dict = {}
        for i, x in enumerate(images):
            if k < len(x.scans):
                s = x.scans[k]
                alike.setdefault((tuple(s.parts), s.band, tuple(sorted(s.tables.items()))), []).append(i)
        for (parts, band, tables), which in alike.items():
            _decode_alike(blocks, [(base[i], images[i], images[i].scans[k]) for i in which], parts, band, dict(tables))
    for i, x in enumerate(images):
        x.coefficients = blocks[base[i] : base[i + 1]]


def _decode_alike(blocks: np.ndarray, scans: list, parts: tuple, band: tuple, tables: dict) -> None:
    ordered = [_scan_blocks(image, scan) for _, image, scan in scans]
    held = np.array([len(o) for o, _, _ in ordered])
    unit = np.array([u or len(o) for o, _, u in ordered])
    lanes = -(-held // unit)
    order = np.concatenate([base + o for (base, _, _), (o, _, _) in zip(scans, ordered, strict=True)])
    owner = np.concatenate([p for _, p, _ in ordered]) if len(parts) > 1 else None
    lanes_n = np.repeat(unit, lanes)
    lanes_n[np.cumsum(lanes) - 1] = held - (lanes - 1) * unit
    lanes_at = np.cumsum(lanes_n) - lanes_n
    raw = np.frombuffer(b"".join(scan.data for _, _, scan in scans), _U8)
    files = np.cumsum([len(scan.data) for _, _, scan in scans])
    ff = np.flatnonzero(raw[:-1] == 255)
    after = raw[ff + 1]
    drop = np.zeros(len(raw), bool)
    drop[ff[after == 0] + 1] = True
    marks = ff[(after >= 0xD0) & (after <= 0xD7)]
    drop[marks] = drop[marks + 1] = True
    kept = np.concatenate([[0], np.cumsum(~drop)])
    starts = np.sort(np.concatenate([[0], kept[files[:-1]], kept[marks]]))
    if len(starts) != len(lanes_n):
        raise ValueError("restart markers are missing")
    data = np.concatenate([raw[~drop], np.zeros(24, _U8)])
    looked = {}
    for p, (_, dc, ac) in enumerate(parts):
        key = (0, dc) if band[0] == 0 else (1, ac)
        if not (band[0] == 0 and band[2]):
            raw = tables[key]
            looked[p] = _lookup(raw[:16], raw[16:])
            if band[0] and not band[2]:
                looked[p] = looked[p], _once(raw)
    for first in range(0, len(starts), LANES):
        some = slice(first, first + LANES)
        begin = int(starts[first])
        stop = int(starts[first + LANES]) if first + LANES < len(starts) else len(data) - 24
        part = np.ascontiguousarray(data[begin : stop + 24])
        words = np.lib.stride_tricks.as_strided(part[:8].view("<u8"), (len(part) - 8,), (1,))
        args = (blocks, order, lanes_at[some], lanes_n[some], words, (starts[some] - begin) * 8)
        if band[0] == 0:
            _dc_scan(*args, owner, looked, band)
        elif not band[2]:
            _ac_scan(*args, looked[0], band)
        else:
            _refine_scan(*args, looked[0], band)


def _peek(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """At least the next 57 bits, from the top."""
    return words[at >> 3].byteswap() << (at & 7).astype(_U64)


def _top(word: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The first n bits of each word as a number."""
    return np.where(n > 0, word >> (64 - np.maximum(n, 1)).astype(_U64), _U64(0)).astype(np.int64)


def _extend(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(bits < (1 << np.maximum(size - 1, 0)), bits - (1 << size) + 1, bits)


def _dc_scan(blocks, order, lane_at, lane_n, words, at, owner, looked, band) -> None:
    last = np.zeros((len(at), max(looked, default=0) + 1), np.int64)
    live = np.arange(len(at))
    for step in range(int(lane_n.max(initial=0))):
        live = live[lane_n[live] > step]
        place = lane_at[live] + step
        word = _peek(words, at[live])
        if band[2]:
            blocks[order[place], 0] |= ((word >> _U64(63)) << _U64(band[3])).astype(np.int16)
            at[live] += 1
            continue
        which = np.zeros(len(live), np.int64) if owner is None else owner[place]
        found = np.zeros(len(live), np.int64)
        for p, table in looked.items():
            found = np.where(which == p, table[(word >> _U64(48)).astype(np.int64)], found)
        size, used = found >> 5, found & 31
        diff = _extend(_top(word << used.astype(_U64), size), size)
        last[live, which] += diff
        blocks[order[place], 0] = last[live, which] << band[3]
        at[live] += used + size


def _ac_scan(blocks, order, lane_at, lane_n, words, at, tables, band) -> None:
    table, once = tables
    first, last, _, low = band
    flat = blocks.reshape(-1)
    done, stop = lane_at.copy(), lane_at + lane_n
    k = np.full(len(at), first, np.int64)
    at = at.copy()
    live = done < stop
    done, stop, k, at = done[live], stop[live], k[live], at[live]
    block = order[done] * 64
    while len(at):
        word = words[at >> 3].byteswap() << (at & 7).astype(_U64)
        top = (word >> _U64(48)).astype(np.int64)
        found = once[top]
        if found.min() >= 0:
            k += (found >> 6) & 15
            flat[block + k] = ((found >> 10) - (1 << 15)) << low
            k += 1
            at += found & 63
        else:
            found = table[top].astype(np.int64)
            used, symbol = found & 31, found >> 5
            run, size = symbol >> 4, symbol & 15
            word <<= used.astype(_U64)
            plain = size == 0
            value = ~plain
            n = np.where(plain & (run < 15), run, size)
            bits = _top(word, n)
            k += np.where(value, run, 0)
            i = np.flatnonzero(value)
            flat[order[done[i]] * 64 + k[i]] = _extend(bits[i], size[i]) << low
            ended = plain & (run < 15)
            k += np.where(value, 1, np.where(ended, 64, 16))
            done += np.where(ended, (1 << np.where(ended, run, 0)) + bits - 1, 0)
            at += used + n
        over = k > last
        if over.any():
            done += over
            k[over] = first
            live = done < stop
            if not live.all():
                done, stop, k, at = done[live], stop[live], k[live], at[live]
            block = order[done] * 64


def _refine_scan(blocks, order, lane_at, lane_n, words, at, table, band) -> None:
    first, last, _, low = band
    done, stop, at = lane_at.copy(), lane_at + lane_n, at.copy()
    k, open_ = np.full(len(at), first, np.int64), np.zeros(len(at), np.int64)
    seat = np.arange(first, last + 1)
    while True:
        live = done < stop
        if not live.all():
            done, stop, at, k, open_ = done[live], stop[live], at[live], k[live], open_[live]
        if not len(at):
            return
        word = _peek(words, at)
        found = table[(word >> _U64(48)).astype(np.int64)].astype(np.int64)
        reads = open_ == 0
        used, symbol = np.where(reads, found & 31, 0), np.where(reads, found >> 5, 0)
        run, size = symbol >> 4, symbol & 15
        word <<= used.astype(_U64)
        ends = reads & (size == 0) & (run < 15)
        n = np.where(ends, run, size)  # the size of a value that is new is 1: its sign
        bits = _top(word, n)
        open_ += np.where(ends, (1 << np.where(ends, run, 0)) + bits, 0)
        at = at + used + n
        rows = order[done]
        now = blocks[rows, first : last + 1]
        known = now != 0
        closing = open_ > 0
        whole = closing.all() and (k == first).all()
        if whole and known.all():
            high, rest = _peek(words, at) >> _U64(32), _peek(words, at + 32) >> _U64(32)
            bit = np.unpackbits(((high << _U64(32)) | rest).byteswap().view(_U8).reshape(-1, 8), axis=1)[:, : len(seat)].astype(np.int16) << low
            blocks[rows, first : last + 1] = now + np.where(now > 0, bit, -bit)
            at = at + len(seat)
            open_ = open_ - 1
            done = done + 1
            continue
        if whole:
            upto = np.full(len(at), last + 1)
            hit = known
        else:
            zero = ~known & (seat >= k[:, None])
            wanted = (np.cumsum(zero, axis=1) == (run + 1)[:, None]) & zero
            there = np.where(wanted.any(axis=1), seat[wanted.argmax(axis=1)], last + 1)
            upto = np.where(closing, last + 1, there)
            hit = known & (seat >= k[:, None]) & (seat < upto[:, None])
        rank = np.cumsum(hit, axis=1)
        more = rank[:, -1]
        high, rest = _peek(words, at) >> _U64(32), _peek(words, at + 32) >> _U64(32)
        both = (high << _U64(32)) | rest
        bit = ((both[:, None] >> (64 - rank.clip(1)).astype(_U64)) & _U64(1)).astype(np.int16)
        now = now + np.where(hit, np.sign(now) * bit, 0).astype(np.int16) * np.int16(1 << low)
        at = at + more
        if not whole:
            new = np.flatnonzero(~closing & (size == 1) & (upto <= last))
            now[new, upto[new] - first] = np.where(bits[new] > 0, 1, -1) << low
        blocks[rows, first : last + 1] = now
        open_ = open_ - closing
        k = np.where(closing, first, upto + 1)
        over = closing | (k > last)
        done = done + over
        k = np.where(over, first, k)


_COS = np.array([[(np.sqrt(0.125) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
#: From coefficients in zigzag order to samples in row order.
INVERSE = np.einsum("ux,vy->uvxy", _COS, _COS).reshape(64, 64)[ZIGZAG].astype(np.float32)


def to_rgb(image: Image) -> np.ndarray:
    """The full-resolution tensor (height, width, 3) of bytes; grey images have three equal channels, chroma is repeated."""
    hm, vm = max(c.h for c in image.components), max(c.v for c in image.components)
    planes = []
    for c in image.components:
        block = image.coefficients[c.first : c.first + c.rows * c.cols].astype(np.float32) * image.quants[c.quant]
        plane = (block @ INVERSE).reshape(c.rows, c.cols, 8, 8).transpose(0, 2, 1, 3).reshape(c.rows * 8, c.cols * 8)
        if (vm // c.v, hm // c.h) != (1, 1):
            plane = np.repeat(np.repeat(plane, vm // c.v, axis=0), hm // c.h, axis=1)
        planes.append(plane[: image.height, : image.width])
    y = planes[0] + np.float32(128.5)
    if len(planes) < 3:
        return np.repeat(np.clip(y, 0, 255).astype(_U8)[:, :, None], 3, axis=2)
    cb, cr = planes[1], planes[2]
    out = np.empty((*y.shape, 3), _U8)
    for i, channel in enumerate((y + np.float32(1.402) * cr, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, y + np.float32(1.772) * cb)):
        out[:, :, i] = np.clip(channel, 0, 255)
    return out
