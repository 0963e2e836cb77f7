"""Lossless WebP: a decoder of everything the format has, and an encoder of 8-bit samples.

The decoder reads prefix codes (simple and normal), meta prefix codes, back-references with the two-dimensional distance
codes and the colour cache, and inverts the predictor, cross-colour, subtract-green and palette transforms.  Pixels are
uint32 ARGB.  Where one group of codes without a colour cache varies in green only, all bit positions are looked up at once
(what begins there, where the next code begins), the chain of codes is followed, and copies are made run by run; other
images are read symbol by symbol.

The encoder writes grey samples: subtract-green; a palette, packed, for up to 16 values; the predictor (left or top) where it
lowers the entropy; back-references to the last place with the same eight samples that has the next four, too; prefix codes of the samples, lengths and
distances that occur.  The colour cache and cross-colour cannot pay for grey samples: a cache code only splits the share of
the sample it stands for, and red and blue are constant after subtract-green.
"""

from __future__ import annotations

import struct

import numpy as np

#: The order in which the lengths of the code-length code are stored (fixed values).
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
CACHE_MULTIPLIER = 0x1E35A7BD
SIDE = 16_384
#: Distance codes 1 to 120 are neighbours (x to the left, y up), nearest first.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))
BLACK = 0xFF000000
#: The lowest 15 bits of a number in reverse.
REVERSED = np.zeros(1 << 15, np.int64)
for _bit in range(15):
    REVERSED |= (np.arange(1 << 15) >> _bit & 1) << (14 - _bit)


class Bits:
    """Bits of a byte string, least significant first."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def peek(self, n: int) -> int:
        a = self.at >> 3
        return int.from_bytes(self.data[a : a + (n + 14) // 8], "little") >> (self.at & 7) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        value = self.peek(n)
        self.at += n
        if self.at > 8 * len(self.data):
            raise ValueError("the image ends too early")
        return value


class Code:
    """A canonical prefix code, given the lengths of its symbols' codes."""

    def __init__(self, lengths: list[int]) -> None:
        self.lengths = lengths
        used = [s for s, n in enumerate(lengths) if n]
        self.only = used[0] if len(used) == 1 else None
        self.order = sorted(used, key=lambda s: (lengths[s], s))
        self.width = lengths[self.order[-1]] if len(used) > 1 else 0
        if not used or len(used) > 1 and sum(1 << (self.width - lengths[s]) for s in used) != 1 << self.width:
            raise ValueError("a prefix code is not complete")
        self.flat = bool(self.width) and lengths[self.order[0]] == self.width
        self.table: list[tuple[int, int]] | None = None

    def _fill(self) -> None:
        self.table, code, last = [(0, 0)] * (1 << self.width), 0, 0
        for s in self.order:
            n = self.lengths[s]
            code <<= n - last
            back = int(format(code, f"0{n}b")[::-1], 2)
            self.table[back :: 1 << n] = [(s, n)] * (1 << (self.width - n))
            code, last = code + 1, n

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        if self.table is None:
            self._fill()
        symbol, n = self.table[bits.peek(self.width)]
        bits.at += n
        return symbol


#: Codes read lately by (alphabet, bits of the description, description): a description never begins another one.
_KNOWN: dict[tuple[int, int, int], Code] = {}
_KNOWN_BITS: dict[int, set[int]] = {}


def read_code(bits: Bits, size: int) -> Code:
    """A prefix code, read anew or recognized as one read before."""
    for n in _KNOWN_BITS.get(size, ()):
        code = _KNOWN.get((size, n, bits.peek(n)))
        if code is not None:
            bits.at += n
            return code
    if len(_KNOWN) >= 512:
        _KNOWN.clear(), _KNOWN_BITS.clear()
    began = bits.at
    code = _read_code(bits, size)
    n, bits.at = bits.at - began, began
    if n <= 96:
        _KNOWN[size, n, bits.peek(n)] = code
        _KNOWN_BITS.setdefault(size, set()).add(n)
    bits.at += n
    return code


def _read_code(bits: Bits, size: int) -> Code:
    lengths = [0] * size
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        lengths[bits.read(8 if wide else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return Code(lengths)
    own = [0] * 19
    for k in range(4 + bits.read(4)):
        own[LENGTH_ORDER[k]] = bits.read(3)
    most = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    code, at, last = Code(own), 0, 8
    while at < size and most:
        most -= 1
        n = code.read(bits)
        if n < 16:
            lengths[at], at = n, at + 1
            last = n or last
        else:
            times = _repeat(bits, n)
            if at + times > size:
                raise ValueError("code lengths run over")
            if n == 16:
                lengths[at : at + times] = [last] * times
            at += times
    return Code(lengths)


def _repeat(bits: Bits, n: int) -> int:
    least, extra = ((3, 2), (3, 3), (11, 7))[n - 16]
    return least + bits.read(extra)


def _value(bits: Bits, prefix: int) -> int:
    """Lengths and distances: a prefix, then extra bits."""
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def _same_width(bits: Bits, codes: list[Code], n: int) -> np.ndarray:
    """n literal pixels, each channel's symbols in codes of one width (or none, if there is one symbol)."""
    widths = [0 if c.only is not None else c.width for c in codes[:4]]
    end = bits.at + n * sum(widths)
    if end > 8 * len(bits.data):
        raise ValueError("the image ends too early")
    first = bits.at >> 3
    stream = np.unpackbits(np.frombuffer(bits.data, np.uint8, offset=first, count=((end + 7) >> 3) - first), bitorder="little")
    stream = stream[bits.at - 8 * first :][: end - bits.at].reshape(n, -1)
    bits.at, at, pixels = end, 0, np.zeros(n, np.uint32)
    for code, width, shift in zip(codes, widths, (8, 16, 0, 24)):
        if width:
            index = np.packbits(stream[:, at : at + width], axis=1)[:, 0] >> (8 - width)
            pixels |= (np.array(code.order, np.uint32) << np.uint32(shift))[index]
            at += width
        else:
            pixels |= np.uint32(code.only << shift)
    return pixels


def _looked_up(code: Code) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and code length for each value of the next `width` bits, the first bit lowest."""
    if code.only is not None:
        return np.array([code.only]), np.array([0])
    order = np.array(code.order)
    lengths = np.array(code.lengths)[order]
    entry = np.repeat(np.arange(len(order)), 1 << (code.width - lengths))[REVERSED[: 1 << code.width] >> (15 - code.width)]
    return order[entry], lengths[entry]


def _values(prefix: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths or distances from their prefixes and the bits behind them; how many of these bits they take."""
    extra = np.maximum(prefix - 2, 0) >> 1
    base = np.where(prefix < 4, prefix, (2 + (prefix & 1)) << extra)
    return base + (window & ((1 << extra) - 1)) + 1, extra


def _green_only(bits: Bits, codes: list[Code], n: int, width: int) -> np.ndarray:
    """n pixels whose red, blue and alpha are constant."""
    first, data = bits.at >> 3, bits.data
    padded = data[first:] + bytes(12)
    count = len(data) - first
    near = np.ndarray((count,), "<u4", padded, 0, (1,))
    wide = np.ndarray((count + 4,), "<u8", padded, 0, (1,))
    window = lambda at: (wide[at >> 3] >> (at & 7).astype(np.uint64)).astype(np.int64)
    symbols, lengths = _looked_up(codes[0])
    table = (symbols | lengths << 9).astype(np.int32)
    found = table[(near.astype(np.int64)[:, None] >> np.arange(8) & ((1 << codes[0].width) - 1)).reshape(-1)]
    symbol, step = found & 511, found >> 9
    refer = np.flatnonzero(symbol >= 256)
    length, taken = _values(symbol[refer].astype(np.int64) - 256, window(refer + step[refer]))
    at = np.minimum(refer + step[refer] + taken, 8 * count)
    far, more = _looked_up(codes[4])
    ahead = window(at)
    far_at = ahead & ((1 << codes[4].width) - 1) if codes[4].only is None else np.zeros(len(at), np.int64)
    distance, last = _values(far[far_at], ahead >> more[far_at])
    step[refer] += taken + more[far_at] + last
    end = 8 * count
    after = np.append(np.minimum(step + np.arange(end, dtype=np.int32), end), end).astype(np.int32)  # where the next code begins
    twice = after[after]
    jump, chain, at = memoryview(np.ascontiguousarray(twice[twice])), [], bits.at & 7
    while at < end:  # every fourth code is looked for one by one
        chain.append(at)
        at = jump[at]
    chain = np.array(chain, np.int64)
    chain = np.stack((chain, after[chain], twice[chain], after[twice[chain]]), axis=1).reshape(-1)
    chain = chain[chain < end]
    green, run = symbol[chain], np.ones(len(chain), np.int64)
    copies = np.flatnonzero(green >= 256)
    entry = np.searchsorted(refer, chain[copies])
    run[copies] = length[entry]
    until = np.cumsum(run)
    used = int(np.searchsorted(until, n)) + 1
    if used > len(chain) or first * 8 + chain[used - 1] + step[chain[used - 1]] > 8 * len(data):
        raise ValueError("the image ends too early")
    bits.at = int(first * 8 + chain[used - 1] + step[chain[used - 1]])
    literal, out, done = green[:used].astype(np.uint8).tobytes(), bytearray(), 0
    for k, size, back in zip(copies.tolist(), length[entry].tolist(), distance[entry].tolist()):
        if k >= used:
            break
        out += literal[done:k]
        done = k + 1
        if back > 120:
            back -= 120
        else:
            x, y = NEAR[back - 1]
            back = max(1, x + y * width)
        if back > len(out):
            raise ValueError("a back-reference before the first pixel")
        run_of = out[len(out) - back : len(out) - back + size]
        out += (run_of * (size // len(run_of) + 1))[:size]
    out += literal[done:]
    rest = np.uint32(codes[1].only << 16 | codes[2].only | codes[3].only << 24)
    return np.frombuffer(bytes(out[:n]), np.uint8).astype(np.uint32) << np.uint32(8) | rest


def read_image(bits: Bits, width: int, height: int, main: bool = False) -> np.ndarray:
    """An entropy-coded image: width * height pixels."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    groups, meta, fine = 1, None, 0
    if main and bits.read(1):
        fine = bits.read(3) + 2
        wide = -(-width // (1 << fine))
        meta = (read_image(bits, wide, -(-height // (1 << fine))) >> np.uint32(8)) & np.uint32(0xFFFF)
        groups = int(meta.max()) + 1
        meta = meta.tolist()
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    all_codes = [[read_code(bits, n) for n in sizes] for _ in range(groups)]
    n, codes = width * height, all_codes[0]
    if groups == 1 and not cache_bits and codes[0].order[-1] < 256 and all(c.only is not None or c.flat and c.width <= 8 for c in codes[:4]):
        return _same_width(bits, codes, n)
    if groups == 1 and not cache_bits and codes[0].only is None and all(c.only is not None for c in codes[1:4]):
        return _green_only(bits, codes, n, width)
    return _one_by_one(bits, all_codes, n, width, meta, fine, wide if meta else 0, cache_bits)


def _one_by_one(bits: Bits, all_codes: list[list[Code]], n: int, width: int, meta: list[int] | None, fine: int, wide: int, cache_bits: int) -> np.ndarray:
    """n pixels, symbol by symbol; meta: the group of codes of each block of 2**fine pixels, `wide` blocks in a line."""
    codes, out, cache, at = all_codes[0], [0] * n, [0] * (1 << cache_bits), 0
    while at < n:
        if meta:
            codes = all_codes[meta[(at // width >> fine) * wide + (at % width >> fine)]]
        s = codes[0].read(bits)
        if s < 256:
            red, blue, alpha = codes[1].read(bits), codes[2].read(bits), codes[3].read(bits)
            new = (alpha << 24 | red << 16 | s << 8 | blue,)
        elif s < 280:
            length = _value(bits, s - 256)
            back = _value(bits, codes[4].read(bits))
            if back > 120:
                back -= 120
            else:
                x, y = NEAR[back - 1]
                back = max(1, x + y * width)
            if back > at:
                raise ValueError("a back-reference before the first pixel")
            for k in range(at, min(n, at + length)):
                out[k] = out[k - back]
            new = out[at : min(n, at + length)]
        else:
            new = (cache[s - 280],)
        out[at : at + len(new)] = new
        at += len(new)
        if cache_bits:
            for p in new:
                cache[(p * CACHE_MULTIPLIER & 0xFFFFFFFF) >> (32 - cache_bits)] = p
        if bits.at > 8 * len(bits.data):
            raise ValueError("the image ends too early")
    return np.array(out, np.uint32)


def _channels(pixels: np.ndarray) -> np.ndarray:
    """uint32 ARGB -> bytes B, G, R, A in the last axis."""
    return np.ascontiguousarray(pixels, "<u4").view(np.uint8).reshape(*pixels.shape, 4)


def _joined(channels: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(channels).view("<u4")[..., 0].astype(np.uint32)


def _predicted(mode: int, left, top, top_left, top_right):
    """One pixel's prediction; arguments are lists of four channels."""
    mean = lambda a, b: [(x + y) >> 1 for x, y in zip(a, b)]
    clip = lambda v: [min(255, max(0, x)) for x in v]
    if mode == 5:
        return mean(mean(left, top_right), top)
    if mode in (6, 7, 8, 9):
        return mean(*((left, top_left), (left, top), (top_left, top), (top, top_right))[mode - 6])
    if mode == 10:
        return mean(mean(left, top_left), mean(top, top_right))
    if mode == 11:
        far_left = sum(abs(t - c) for t, c in zip(top, top_left))
        far_top = sum(abs(a - c) for a, c in zip(left, top_left))
        return left if far_left < far_top else top
    if mode == 12:
        return clip([a + t - c for a, t, c in zip(left, top, top_left)])
    if mode == 13:
        half = mean(left, top)
        return clip([h + int((h - c) / 2) for h, c in zip(half, top_left)])
    return {1: left, 2: top, 3: top_right, 4: top_left}.get(mode, [0, 0, 0, 255])


def undo_predictor(pixels: np.ndarray, width: int, height: int, fine: int, modes: np.ndarray) -> np.ndarray:
    kinds = ((modes >> np.uint32(8)) & np.uint32(15)).tolist()
    if len(set(kinds)) == 1 and kinds[0] in (1, 2):  # left or top everywhere: running sums
        sums = _channels(pixels.reshape(height, width)).copy()
        sums[0, 0, 3] = (int(sums[0, 0, 3]) + 255) & 255
        if kinds[0] == 1:
            sums[:, 0] = np.cumsum(sums[:, 0], axis=0, dtype=np.uint8)
            return _joined(np.cumsum(sums, axis=1, dtype=np.uint8)).reshape(-1)
        sums[0] = np.cumsum(sums[0], axis=0, dtype=np.uint8)
        return _joined(np.cumsum(sums, axis=0, dtype=np.uint8)).reshape(-1)
    data = _channels(pixels.reshape(height, width)).astype(int).tolist()
    wide = -(-width // (1 << fine))
    for y in range(height):
        row, above = data[y], data[y - 1]
        for x in range(width):
            if y == 0:
                guess = row[x - 1] if x else [0, 0, 0, 255]
            elif x == 0:
                guess = above[0]
            else:
                right = above[x + 1] if x + 1 < width else row[0]
                guess = _predicted(kinds[(y >> fine) * wide + (x >> fine)], row[x - 1], above[x], above[x - 1], right)
            row[x] = [(a + b) & 255 for a, b in zip(row[x], guess)]
    return _joined(np.array(data, np.uint8)).reshape(-1)


def undo_cross_colour(pixels: np.ndarray, width: int, height: int, fine: int, factors: np.ndarray) -> np.ndarray:
    wide = -(-width // (1 << fine))
    at = (np.arange(height) >> fine)[:, None] * wide + (np.arange(width) >> fine)
    factor = _channels(factors[at]).view(np.int8).astype(np.int32)
    data = _channels(pixels.reshape(height, width)).copy()
    signed = lambda c: c.astype(np.int8).astype(np.int32)
    green = signed(data[..., 1])
    red = (data[..., 2] + (factor[..., 0] * green >> 5)) & 255
    blue = data[..., 0] + (factor[..., 1] * green >> 5) + (factor[..., 2] * signed(red.astype(np.uint8)) >> 5)
    data[..., 2], data[..., 0] = red, blue & 255
    return _joined(data).reshape(-1)


def undo_subtract_green(pixels: np.ndarray) -> np.ndarray:
    data = _channels(pixels).copy()
    data[..., 2] += data[..., 1]
    data[..., 0] += data[..., 1]
    return _joined(data)


def undo_palette(pixels: np.ndarray, width: int, height: int, packed: int, colours: np.ndarray) -> np.ndarray:
    index = ((pixels >> np.uint32(8)) & np.uint32(255)).astype(np.int64)
    if packed:
        each, n = 8 >> packed, 1 << packed
        index = (index[:, None] >> (np.arange(n) * each)) & ((1 << each) - 1)
        index = index.reshape(height, -1)[:, :width].reshape(-1)
    table = np.zeros(256, np.uint32)
    table[: len(colours)] = colours
    return table[index]


def decode_bitstream(data: bytes) -> tuple[int, int, np.ndarray]:
    """The VP8L bitstream -> (width, height, pixels)."""
    bits = Bits(data)
    if bits.read(8) != 0x2F:
        raise ValueError("not a lossless bitstream")
    full, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("an unknown version")
    width, undo = full, []
    while bits.read(1):
        kind = bits.read(2)
        if kind == 2:
            undo.append((undo_subtract_green, ()))
        elif kind == 3:
            n = bits.read(8) + 1
            colours = _joined(np.cumsum(_channels(read_image(bits, n, 1)), axis=0, dtype=np.uint8))
            packed = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append((undo_palette, (width, height, packed, colours)))
            width = -(-width // (1 << packed))
        else:
            fine = bits.read(3) + 2
            side = read_image(bits, -(-width // (1 << fine)), -(-height // (1 << fine)))
            undo.append((undo_cross_colour if kind else undo_predictor, (width, height, fine, side)))
    pixels = read_image(bits, width, height, main=True)
    for f, more in reversed(undo):
        pixels = f(pixels, *more)
    return full, height, pixels


def decode(data: bytes) -> tuple[int, int, np.ndarray]:
    """A WebP file with a lossless image -> (width, height, pixels)."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at = 12
    while at + 8 <= len(data):
        name, n = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        if name == b"VP8L":
            return decode_bitstream(data[at + 8 : at + 8 + n])
        at += 8 + n + (n & 1)
    raise ValueError("no lossless image in the file")


class Writer:
    """Bits to bytes, least significant first; arrays of codes at once."""

    def __init__(self) -> None:
        self.value, self.n, self.tail = 0, 0, None

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n

    def codes(self, values: np.ndarray, widths: np.ndarray) -> None:
        """Codes of at most 64 bits, after all that was put."""
        self.tail = values.astype(np.uint64), widths.astype(np.int64)

    def bytes(self) -> bytes:
        if self.tail is None:
            return self.value.to_bytes((self.n + 7) // 8, "little")
        head = self.n + -self.n % 64
        words = np.frombuffer(self.value.to_bytes(head // 8, "little"), np.uint64)
        values, widths = self.tail
        ends = self.n + np.cumsum(widths)
        starts = ends - widths
        out = np.zeros(int(ends[-1]) // 64 + 2, np.uint64)
        out[: len(words)] = words
        at, shift = starts >> 6, (starts & 63).astype(np.uint64)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        out[at[first]] |= np.add.reduceat(values << shift, first)  # codes in a word don't overlap: their sum is their union
        over = np.flatnonzero((starts & 63) + widths > 64)
        out[at[over] + 1] |= values[over] >> (np.uint64(64) - shift[over])
        return out.tobytes()[: -(-int(ends[-1]) // 8)]


#: The bits of a byte in reverse.
BACKWARDS = (REVERSED[:256] >> 7).tolist()


def _put_one(w: Writer, symbol: int) -> None:
    """A code with one symbol."""
    w.put(1, 1), w.put(0, 1), w.put(1, 1), w.put(symbol, 8)


def code_lengths(counts: np.ndarray, most: int) -> np.ndarray:
    """Lengths (`most` at most) of an optimal prefix code; for a single symbol, 1."""
    lengths, used = np.zeros(len(counts), np.int64), np.flatnonzero(counts)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    order, least = used[np.argsort(counts[used], kind="stable")], 0
    while True:
        leaves = np.maximum(counts[order], least).tolist()
        n, parent, inner, a, b = len(leaves), [0] * (2 * len(leaves) - 1), [], 0, 0
        for k in range(n - 1):  # the two rarest, leaves or joined ones, are joined
            weight = 0
            for _ in range(2):
                if a < n and (b >= len(inner) or leaves[a] <= inner[b]):
                    weight, parent[a], a = weight + leaves[a], n + k, a + 1
                else:
                    weight, parent[n + b], b = weight + inner[b], n + k, b + 1
            inner.append(weight)
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if max(depth) <= most:
            lengths[order] = depth[:n]
            return lengths
        least = max(2 * least, -(-sum(leaves) >> most))


def code_words(lengths: np.ndarray) -> np.ndarray:
    """The canonical codes of the lengths, first bit lowest."""
    words, used = np.zeros(len(lengths), np.int64), np.flatnonzero(lengths)
    if len(used) > 1:
        order = used[np.argsort(lengths[used], kind="stable")]
        sizes = 1 << (15 - lengths[order])
        words[order] = REVERSED[np.cumsum(sizes) - sizes]
    return words


def _put_code(w: Writer, lengths: np.ndarray) -> None:
    """The description of a code: runs of its lengths, in a code of their own."""
    used = np.flatnonzero(lengths)
    if len(used) < 2:
        _put_one(w, int(used[0]) if len(used) else 0)
        return
    runs, last = [], 8  # (symbol, extra, bits of extra)
    edges = np.flatnonzero(np.diff(lengths, prepend=-1))
    for value, n in zip(lengths[edges].tolist(), np.diff(np.append(edges, len(lengths))).tolist()):
        if value and value != last:
            runs.append((value, 0, 0))
            last, n = value, n - 1
        while n >= 3:
            if value:
                took = min(6, n)
                runs.append((16, took - 3, 2))
            elif n < 11:
                took = n
                runs.append((17, took - 3, 3))
            else:
                took = min(138, n)
                runs.append((18, took - 11, 7))
            n -= took
        runs += [(value, 0, 0)] * n
    own = code_lengths(np.bincount([r[0] for r in runs], minlength=19), 7)
    words, own = code_words(own).tolist(), own.tolist()
    only = sum(x > 0 for x in own) == 1
    order = [own[x] for x in LENGTH_ORDER]
    stored = max(4, max(k for k, x in enumerate(order) if x) + 1)
    w.put(0, 1), w.put(stored - 4, 4)
    for x in order[:stored]:
        w.put(x, 3)
    w.put(0, 1)
    for symbol, extra, n in runs:
        w.put(words[symbol] | extra << (0 if only else own[symbol]), (0 if only else own[symbol]) + n)


def _prefixes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths or distances (1 and more) -> their prefixes, extra bits, and how many these are."""
    v = values - 1
    high = np.maximum(np.frexp(v.astype(float))[1] - 1, 1)
    extra = np.where(v < 4, 0, high - 1)
    return np.where(v < 4, v, 2 * high + (v >> extra & 1)), v & ((1 << extra) - 1), extra


def back_references(samples: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, distance) of copies from the last place with the same REACH samples; 4096 long and FAREST away at most."""
    n = len(samples) - REACH + 1
    if n < 2:
        return []
    data = samples.tobytes()
    eight = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,)).copy()
    keys = eight[:n] * np.uint64(0x9E3779B97F4A7C15) & ~np.uint64(2**32 - 1)
    ordered = np.sort(keys | np.arange(n, dtype=np.uint64))  # by a hash of the samples, then by place
    order = (ordered & np.uint64(2**32 - 1)).astype(np.int64)
    same = np.flatnonzero(ordered[1:] >> np.uint64(32) == ordered[:-1] >> np.uint64(32))
    starts, sources = order[same + 1], order[same]
    equal = (starts - sources <= FAREST) & (eight[starts] == eight[sources]) & (eight[starts + REACH - 8] == eight[sources + REACH - 8])
    before = np.full(n, -1)
    before[starts[equal]] = sources[equal]
    starts = np.flatnonzero(before >= 0)
    found, free, starts, sources = [], 0, starts.tolist(), before[starts].tolist()
    for i, j in zip(starts, sources):
        if i < free:
            continue
        size, most = REACH, min(4096, len(data) - i)
        step = REACH
        while size < most and data[i + size : i + size + step] == data[j + size : j + size + step]:
            size, step = min(most, size + step), step * 2
        while step and size < most:
            if size + step <= most and data[i + size : i + size + step] == data[j + size : j + size + step]:
                size += step
            step //= 2
        found.append((i, size, i - j))
        free = i + size
    return found


#: Samples that a back-reference has at least (8 to 16); distance it has at most: the format's 40 prefixes end at 2**20, 120 of these are near places.
REACH, FAREST = 12, (1 << 20) - 120


def _entropy(values: np.ndarray) -> float:
    held = np.bincount(values, minlength=256)
    held = held[held > 0] / len(values)
    return float(-(held * np.log2(held)).sum())


def residuals(samples: np.ndarray, mode: int) -> np.ndarray:
    """Grey samples (height, width) less what the predictor says: 1 left, 2 top; at the edges, as the format says."""
    out = samples.copy()
    if mode == 1:
        out[:, 1:] -= samples[:, :-1]
        out[1:, 0] -= samples[:-1, 0]
    else:
        out[1:] -= samples[:-1]
        out[0, 1:] -= samples[0, :-1]
    return out


def _put_image(w: Writer, green: np.ndarray, alpha: int) -> None:
    """Pixels that vary in green: back-references and prefix codes."""
    copies = np.array(back_references(green), np.int64).reshape(-1, 3)
    inside = np.zeros(len(green) + 1, np.int64)
    inside[copies[:, 0]] += 1
    np.subtract.at(inside, copies[:, 0] + copies[:, 1], 1)
    kept = np.cumsum(inside)[:-1] == 0
    kept[copies[:, 0]] = True  # a copy stands where it starts
    at = np.flatnonzero(kept)
    symbols, widths = green[at].astype(np.int64), np.zeros(len(at), np.int64)
    where = np.searchsorted(at, copies[:, 0])
    length, length_extra, length_bits = _prefixes(copies[:, 1])
    far, far_extra, far_bits = _prefixes(copies[:, 2] + 120)
    symbols[where] = 256 + length
    codes = code_lengths(np.bincount(symbols, minlength=280), 15), code_lengths(np.bincount(far, minlength=40), 15)
    _put_code(w, codes[0]), _put_one(w, 0), _put_one(w, 0), _put_one(w, alpha), _put_code(w, codes[1])
    words, far_words = code_words(codes[0]), code_words(codes[1])
    if np.count_nonzero(codes[0]) > 1:
        widths = codes[0][symbols]
    values = words[symbols]
    far_widths = codes[1][far] if np.count_nonzero(codes[1]) > 1 else np.zeros(len(far), np.int64)
    ahead = widths[where]
    for value, n in ((length_extra, length_bits), (far_words[far], far_widths), (far_extra, far_bits)):
        values[where] |= value << ahead
        ahead = ahead + n
    widths[where] = ahead
    w.codes(values, widths)


def encode_grey(samples: np.ndarray) -> bytes:
    """A WebP file of 8-bit samples (height, width)."""
    height, width = samples.shape
    held = np.flatnonzero(np.bincount(samples.reshape(-1), minlength=256)).astype(np.uint8)
    n, w, pixels, alpha = len(held), Writer(), samples, 255
    w.put(0x2F, 8), w.put(width - 1, 14), w.put(height - 1, 14), w.put(0, 1), w.put(0, 3)
    w.put(1, 1), w.put(2, 2)  # subtract green: grey pixels keep their sample in green only
    if n <= 16:
        w.put(1, 1), w.put(3, 2), w.put(n - 1, 8)  # palette, whose steps lie in green; alpha steps once
        w.put(0, 1)
        steps = np.diff(held, prepend=np.uint8(0))
        lengths = code_lengths(np.bincount(steps, minlength=280), 15)
        _put_code(w, lengths), _put_one(w, 0), _put_one(w, 0)
        w.put(1, 1), w.put(1, 1), w.put(1, 1), w.put(0, 8), w.put(255, 8)  # alpha: 0 or 255, a bit each
        _put_one(w, 0)
        words, one = code_words(lengths).tolist(), np.count_nonzero(lengths) < 2
        for k, step in enumerate(steps.tolist()):
            w.put(words[step], 0 if one else int(lengths[step])), w.put(k == 0, 1)
        index = np.zeros(256, np.uint8)
        index[held] = np.arange(n)
        packed = 3 if n <= 2 else 2 if n <= 4 else 1
        each, per = 8 >> packed, 1 << packed
        pixels = np.pad(index[samples], ((0, 0), (0, -width % per))).reshape(height, -1, per)
        pixels = (pixels << (np.arange(per) * each).astype(np.uint8)).sum(axis=2, dtype=np.uint8)
    else:
        plain, best = _entropy(samples.reshape(-1)), None
        for mode in (1, 2):
            rest = residuals(samples, mode)
            bits = _entropy(rest.reshape(-1))
            if bits < 0.95 * plain:
                plain, best, pixels, alpha = bits, mode, rest, 0
        if best:
            w.put(1, 1), w.put(0, 2), w.put(7, 3)  # predictor, one mode in blocks of 512 pixels
            w.put(0, 1), _put_one(w, best), _put_one(w, 0), _put_one(w, 0), _put_one(w, 255), _put_one(w, 0)
    w.put(0, 1)  # no further transform
    w.put(0, 1), w.put(0, 1)  # no colour cache, one group of codes
    _put_image(w, pixels.reshape(-1), alpha)
    body = w.bytes()
    body += b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(body)) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body
