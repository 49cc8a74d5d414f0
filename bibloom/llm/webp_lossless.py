"""Lossless WebP (VP8L): pixel arrays to image files and back.

The helper that media.py runs inside tasks. The writer weighs, for several images side by
side, the pixels as they are against subtract-green, every predictor, cross-colour and
colour caches by the bits that their values would take, and writes what takes least.
An image with one prefix-code group is read without a loop over bits: at every bit of a
window the length of the token that would start there is looked up, and a chain of jumps
from the first bit finds the tokens. Files are read in windows, so what is looked up at
once stays bounded.
"""

from __future__ import annotations

import functools
import heapq
import struct

import numpy as np

# Fixed values of the format
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
ALPHABETS = (256 + 24, 256, 256, 256, 40)
HASH = 0x1E35A7BD
MAX_SIDE = 16384
#: Distance codes 1 to 120: neighbours (left, up) by distance, the higher first, the left one first
NEAR = sorted(
    ((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, -p[1], -p[0])
)
WINDOW = 1 << 14  # bytes
PAD = 64
SIDE_BY_SIDE = 1 << 15  # pixels that the writer weighs together
MODES = range(1, 14)  # predictors that it weighs: number 0 leaves pixels as they are
CACHES = (5, 8)  # colour caches that it weighs, in bits
BLOCK = 4
NEVER = 1 << 60
SYMBOL, TRANSFORM = 16 * 6, 16 * 80  # about what a symbol in a code's header, and a transform, take
R, G, B, A = range(4)  # channels of a pixel array
READ_ORDER = (G, R, B, A)
# once so large a block was freed, the C library keeps smaller ones for the next image instead of giving them back
np.empty(30 << 20, np.uint8)


# --- prefix codes


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Huffman code lengths of at most ``limit``; one used symbol gets length 1."""
    lengths = np.zeros(len(counts), dtype=np.int64)
    used = np.nonzero(counts)[0]
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    weights = counts[used].tolist()
    while True:
        heap = [(w, i) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        parent = [0] * (2 * len(weights) - 1)
        for node in range(len(weights), len(parent)):
            a, i = heapq.heappop(heap)
            b, j = heap[0]
            parent[i] = parent[j] = node
            heapq.heapreplace(heap, (a + b, node))
        depth = [0] * len(parent)
        for node in range(len(parent) - 2, -1, -1):
            depth[node] = depth[parent[node]] + 1
        if max(depth) <= limit:
            lengths[used] = depth[: len(weights)]
            return lengths
        weights = [(w + 1) // 2 for w in weights]


_REVERSED = np.array([int(f"{i:015b}"[::-1], 2) for i in range(1 << 15)], dtype=np.int64)


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of each symbol, its first bit lowest."""
    order = np.argsort(lengths, kind="stable")
    order = order[lengths[order] > 0]
    sizes = lengths[order]
    steps = np.int64(1) << (15 - sizes)
    starts = np.cumsum(steps) - steps
    codes = np.zeros(len(lengths), dtype=np.int64)
    codes[order] = _REVERSED[starts]
    return codes


@functools.cache
def _reversed(width: int) -> np.ndarray:
    """Every number of so many bits with its bits reversed."""
    return _REVERSED[np.arange(1 << width) << (15 - width)]


class Table:
    """Looks up the code that the next ``width`` bits begin with: symbol and length."""

    def __init__(self, lengths: np.ndarray):
        used = np.nonzero(lengths)[0]
        if len(used) < 2:  # a single symbol takes no bits
            self.width = 0
            self.symbols, self.sizes = np.array([used[0] if len(used) else 0]), np.zeros(1, np.int64)
            return
        self.width = int(lengths.max())
        order = used[np.argsort(lengths[used], kind="stable")]
        steps = 1 << (self.width - lengths[order])
        if steps.sum() != 1 << self.width:
            raise ValueError("a prefix code is not complete")
        back = _reversed(self.width)
        self.symbols = np.repeat(order, steps)[back]
        self.sizes = np.repeat(lengths[order], steps)[back]


# --- bits


class Writer:
    def __init__(self):
        self.values: list[int] = []
        self.sizes: list[int] = []
        self.arrays: list[tuple[np.ndarray, np.ndarray]] = []

    def put(self, value: int, size: int) -> None:
        self.values.append(value)
        self.sizes.append(size)

    def put_all(self, values: list[int], sizes: list[int]) -> None:
        self.values += values
        self.sizes += sizes

    def _flush(self) -> None:
        if self.values:
            self.arrays.append((np.array(self.values, np.uint64), np.array(self.sizes, np.int64)))
            self.values, self.sizes = [], []

    def extend(self, values: np.ndarray, sizes: np.ndarray) -> None:
        """Each size is at most 60."""
        self._flush()
        self.arrays.append((values.astype(np.uint64), sizes.astype(np.int64)))

    def data(self) -> bytes:
        self._flush()
        values = np.concatenate([a for a, _ in self.arrays])
        sizes = np.concatenate([b for _, b in self.arrays])
        ends = np.cumsum(sizes)
        starts = ends - sizes
        word, shift = starts >> 6, (starts & 63).astype(np.uint64)
        low = values << shift
        high = np.where(shift > 0, values >> ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        first = np.nonzero(np.diff(word, prepend=-1))[0]
        words = np.zeros(int(ends[-1] >> 6) + 2, np.uint64)
        at = word[first]
        words[at] = np.bitwise_or.reduceat(low, first)
        words[at + 1] |= np.bitwise_or.reduceat(high, first)
        return words.astype("<u8").tobytes()[: int(ends[-1] + 7) >> 3]


class Reader:
    def __init__(self, data: bytes):
        self.data = data + bytes(PAD)
        self.at = 0

    def take(self, size: int) -> int:
        if size == 0:
            return 0
        p = self.at >> 3
        value = int.from_bytes(self.data[p : p + 8], "little") >> (self.at & 7)
        self.at += size
        if self.at > 8 * (len(self.data) - PAD):
            raise ValueError("the image ends early")
        return value & ((1 << size) - 1)

    def between(self, start: int, size: int) -> int:
        """The given bits, without moving."""
        p = start >> 3
        return int.from_bytes(self.data[p : (start + size + 7 >> 3)], "little") >> (start & 7) & ((1 << size) - 1)

    def symbol(self, table: Table) -> int:
        if not table.width:
            return int(table.symbols[0])
        p = self.at >> 3
        code = int.from_bytes(self.data[p : p + 4], "little") >> (self.at & 7) & ((1 << table.width) - 1)
        self.at += int(table.sizes[code])
        return int(table.symbols[code])


# --- writing


def _value_code(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbol, extra bits and their number, of a length or distance."""
    v = np.asarray(value, np.int64) - 1
    top = np.where(v < 4, 1, np.floor(np.log2(np.maximum(v, 1))).astype(np.int64))
    symbol = np.where(v < 4, v, 2 * top + (v >> np.maximum(top - 1, 0) & 1))
    size = np.where(v < 4, 0, top - 1)
    return symbol, v & ((1 << size) - 1), size


def _code_header(lengths: np.ndarray) -> tuple[list[int], list[int]]:
    """How a code is written: values and their sizes in bits."""
    used = np.nonzero(lengths)[0]
    if len(used) <= 2 and (not len(used) or used[-1] < 256):
        used = used.tolist() or [0]
        return [1, len(used) - 1, 1, *used], [1, 1, 1, *(8 for _ in used)]
    symbols: list[int] = []
    extras: dict[int, tuple[int, int]] = {}
    begins = [0, *(np.nonzero(lengths[1:] != lengths[:-1])[0] + 1).tolist(), len(lengths)]
    for value, a, b in zip(lengths[begins[:-1]].tolist(), begins, begins[1:]):
        run = b - a
        if run < 3:
            symbols += (value,) * run
            continue
        if value == 0:
            while run >= 11:
                n = min(run, 138)
                extras[len(symbols)] = n - 11, 7
                symbols.append(18)
                run -= n
            if run >= 3:
                extras[len(symbols)] = run - 3, 3
                symbols.append(17)
                run = 0
        elif run >= 4:
            symbols.append(value)
            run -= 1
            while run >= 3:
                n = min(run, 6)
                extras[len(symbols)] = n - 3, 2
                symbols.append(16)
                run -= n
        symbols += (value,) * run
    meta = code_lengths(np.bincount(symbols, minlength=19), 7)
    codes, sizes, single = canonical(meta).tolist(), meta.tolist(), int(np.count_nonzero(meta)) == 1
    ordered = [sizes[s] for s in CODE_LENGTH_ORDER]
    n = max(4, max(i for i, s in enumerate(ordered) if s) + 1)
    if single:
        codes = sizes = [0] * 19
    values, widths = [codes[s] for s in symbols], [sizes[s] for s in symbols]
    for at, (extra, size) in extras.items():
        values[at] |= extra << widths[at]
        widths[at] += size
    return [0, n - 4, *ordered[:n], 0, *values], [1, 4, *[3] * n, 1, *widths]


def _cache_index(pixels: np.ndarray, bits: int) -> np.ndarray:
    argb = np.ascontiguousarray(pixels[:, [B, G, R, A]]).view("<u4").ravel()
    return (argb * np.uint32(HASH) >> np.uint32(32 - bits)).astype(np.int64)


def _cached(pixels: np.ndarray, bits: int) -> np.ndarray:
    """Where the colour cache holds the pixel when it comes: the last pixel of its slot was equal."""
    return _repeats(_cache_index(pixels, bits).astype(np.uint16), pixels)


# what pixels would take, in sixteenths of a bit


def _product(counts: np.ndarray) -> np.ndarray:
    return np.rint(16 * counts * np.log2(np.maximum(counts, 1))).astype(np.int64)


_PRODUCTS = _product(np.arange(1 << 16))


def _bits(counts: np.ndarray) -> np.ndarray:
    """The entropy of each histogram along the last axis, and what its code's header takes."""
    total = counts.sum(axis=-1)
    product = _PRODUCTS.__getitem__ if total.max(initial=0) < len(_PRODUCTS) else _product
    return product(total) - product(counts).sum(axis=-1) + SYMBOL * np.count_nonzero(counts, axis=-1)


def _taken(counts: np.ndarray, slots: np.ndarray | None = None) -> np.ndarray:
    """Of (images, 4, 256) counts, and those of cache slots: the cheaper of one and three codes for red, blue and alpha."""
    green = counts[:, G] if slots is None else np.concatenate([counts[:, G], slots], axis=1)
    others = counts[:, [R, B, A]]
    return _bits(green) + np.minimum(_bits(others.sum(axis=1)), _bits(others).sum(axis=1))


class _Side:
    """Images of one width, one below another: their neighbours and counts."""

    def __init__(self, images: list[np.ndarray]):
        self.n, self.width = len(images), images[0].shape[1]
        heights = np.array([len(x) for x in images])
        self.flat = np.concatenate([x.reshape(-1, 4) for x in images])
        self.image = np.repeat(np.arange(self.n), heights * self.width)
        self.starts = np.concatenate([[0], np.cumsum(heights * self.width)[:-1]])
        self.place = self.image[:, None] * 1024 + np.arange(4) * 256
        self.sum = np.empty_like(self.place)
        wide = self.flat.astype(np.int16)
        before = lambda d: np.concatenate([np.zeros((min(d, len(wide)), 4), np.int16), wide[: max(0, len(wide) - d)]])
        w = self.width
        self.near = before(1), before(w), before(w - 1) if w > 1 else before(1), before(w + 1)
        self.near_green = tuple(np.ascontiguousarray(x[:, G]) for x in self.near)
        self.green, self.place_green = np.ascontiguousarray(self.flat[:, G]), self.image * 256
        # the first row is predicted by the left, the first column by the top
        row = (self.starts[:, None] + np.arange(w)).ravel()
        column = np.arange(0, len(wide), w)
        self.edge = np.concatenate([column, row])
        self.known = np.concatenate([self.near[1][column], self.near[0][row]]).astype(np.uint8)
        self.known[len(column) :: w] = (0, 0, 0, 255)

    def greens(self, mode: int) -> np.ndarray:
        """Counts of what green leaves under a mode."""
        if mode == 11:
            left = self.residual(mode)[:, G]
        else:
            predicted = _predict(mode, *self.near_green).astype(np.uint8)
            predicted[self.edge] = self.known[:, G]
            left = self.green - predicted
        return np.bincount(self.place_green + left, minlength=self.n * 256).reshape(self.n, 256)

    def residual(self, mode: int) -> np.ndarray:
        predicted = _predict(mode, *self.near).astype(np.uint8)
        predicted[self.edge] = self.known
        return self.flat - predicted

    def counts(self, pixels: np.ndarray, some: np.ndarray | None = None) -> np.ndarray:
        if some is None:
            at = np.add(self.place, pixels, out=self.sum)
        else:
            some = np.nonzero(some)[0]
            at = self.place.take(some, axis=0) + pixels.take(some, axis=0)
        return np.bincount(at.ravel(), minlength=self.n * 1024).reshape(self.n, 4, 256)

    def bent(self, small: np.ndarray, a: int, b: int, slope: np.ndarray) -> np.ndarray:
        """Counts of one channel less what another tells of it."""
        left = small[:, b] - (small[:, a] * slope[self.image] >> 5) & 255
        return np.bincount(self.place_green + left, minlength=self.n * 256).reshape(self.n, 256)

    def sums(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.starts)


def _green_taken(pixels: np.ndarray) -> np.ndarray:
    out = pixels.copy()
    out[..., R] -= out[..., G]
    out[..., B] -= out[..., G]
    return out


def plans(images: list[np.ndarray]) -> list[dict]:
    """What encode is to use for each image, palettes aside: what its values would take the fewest bits with.

    Images of one width are weighed together; a choice depends on the image alone.
    """
    found: list[dict] = []
    group: list[np.ndarray] = []
    size = 0
    for image in images:
        area = image.shape[0] * image.shape[1]
        if group and (len(group) == 64 or size + area > SIDE_BY_SIDE or image.shape[1] != group[0].shape[1]):
            found += _plans(group)
            group, size = [], 0
        group.append(image)
        size += area
    return found + (_plans(group) if group else [])


def _plans(images: list[np.ndarray]) -> list[dict]:
    # a large image is weighed in strips, each as if it stood alone
    rows = max(1, SIDE_BY_SIDE // images[0].shape[1])
    strips = [_Side(images)] if len(images) > 1 else [_Side([images[0][y : y + rows]]) for y in range(0, len(images[0]), rows)]
    total = lambda f: sum(f(k) for k in range(len(strips)))
    every = np.arange(len(images))
    counted = [s.counts(s.flat) for s in strips]
    plain = _taken(sum(counted))
    green = _taken(total(lambda k: strips[k].counts(_green_taken(strips[k].flat))))
    # the predictor that leaves least of green is weighed with all channels, where it leaves less than there was
    greens = np.stack([_bits(total(lambda k, m=m: strips[k].greens(m))) for m in MODES])
    mode, hopeful = np.argmin(greens, axis=0), greens.min(axis=0) < _bits(sum(counted)[:, G])
    blocks = np.array([np.prod(_blocks(x.shape[1], len(x), BLOCK)) for x in images])
    spatial = np.full(len(images), NEVER)
    if hopeful.any():
        weighed = _taken(total(lambda k: strips[k].counts(_picked(strips[k], mode, hopeful)))) + TRANSFORM + 2 * 16 * blocks
        spatial[hopeful] = weighed[hopeful]
    predicted = spatial < np.minimum(plain, green)
    best = np.where(predicted, spatial, plain)

    left = [_picked(s, mode, predicted) for s in strips]
    if predicted.any():
        green = _taken(total(lambda k: strips[k].counts(_green_taken(left[k])))) + np.where(predicted, TRANSFORM + 2 * 16 * blocks, 0)
    subtract = green < best
    best = np.minimum(best, green)

    # cross-colour: the slopes of red and blue on green, of blue on red
    small = [np.asfortranarray(x.view(np.int8)).astype(np.int64) for x in left]
    slope = lambda a, b: np.clip(
        np.rint(32 * total(lambda k: strips[k].sums(small[k][:, a] * small[k][:, b])) / np.maximum(1, total(lambda k: strips[k].sums(small[k][:, a] ** 2)))), -128, 127
    ).astype(np.int64)
    red, blue, again, none = slope(G, R), slope(G, B), slope(R, B), every * 0
    elements = [np.stack(x, axis=1) for x in ((red, blue, none), (red, none, again))]
    # weighed with all channels where red or blue by itself gets less
    if predicted.any():
        counted = [s.counts(x) for s, x in zip(strips, left)]
    tried = ((G, R, red), (G, B, blue), (R, B, again))
    hopeful = np.logical_or.reduce([_bits(total(lambda k: strips[k].bent(small[k], a, b, e))) < _bits(sum(counted)[:, b]) for a, b, e in tried])
    cross = every * 0 - 1
    if hopeful.any():
        crossed = np.stack([_taken(total(lambda k, e=e: strips[k].counts(_cross(left[k], e[strips[k].image], -1)))) for e in elements])
        crossed += TRANSFORM + 3 * 16 * 8 + np.where(predicted, TRANSFORM + 2 * 16 * blocks, 0)
        cross = np.where(hopeful & (crossed.min(axis=0) < best), crossed.argmin(axis=0), -1)
    for k, s in enumerate(strips):
        for j, chosen in enumerate((subtract & (cross < 0), cross == 0, cross == 1)):
            if chosen.any():
                those = chosen[s.image]
                left[k][those] = _cross(left[k][those], elements[j - 1][s.image[those]], -1) if j else _green_taken(left[k][those])

    # colour caches, for pixels that don't repeat the one before
    if subtract.any() or (cross >= 0).any():
        counted = [s.counts(x) for s, x in zip(strips, left)]
    alone = []
    for k, s in enumerate(strips):
        packed = left[k].view("<u4").ravel()
        fresh = np.ones(len(packed), bool)
        fresh[1:] = packed[1:] != packed[:-1]
        fresh[s.starts] = True
        alone.append(fresh)
        counted[k] -= s.counts(left[k], ~fresh)
    taken = [_taken(sum(counted))]
    for b in CACHES:
        counts, slots = 0, 0
        for k, s in enumerate(strips):
            slot = s.image << b | _cache_index(left[k], b)
            hit = _repeats(slot.astype(np.uint16), left[k]) & alone[k]
            counts += counted[k] - s.counts(left[k], hit)
            slots += np.bincount(slot[hit], minlength=s.n << b).reshape(s.n, -1)
        taken.append(_taken(counts, slots) + SYMBOL * np.count_nonzero(slots, axis=1))
    cache = np.argmin(np.stack(taken), axis=0)

    return [
        {
            "predictor": _block_modes(x, MODES[mode[i]]) if predicted[i] else None,
            "cross": tuple(elements[cross[i]][i].tolist()) if cross[i] >= 0 else None,
            "subtract_green": bool(subtract[i] and cross[i] < 0),
            "cache_bits": (0, *CACHES)[cache[i]],
        }
        for i, x in enumerate(images)
    ]


def _picked(side: _Side, mode: np.ndarray, predicted: np.ndarray) -> np.ndarray:
    """What the mode of each image leaves, of those that are predicted."""
    out = side.flat.copy()
    for m in np.unique(mode[predicted]).tolist():
        those = (predicted & (mode == m))[side.image]
        out[those] = side.residual(MODES[m])[those]
    return out


def _block_modes(image: np.ndarray, mode: int) -> np.ndarray:
    """The mode of each block that takes least, at the prices of values under the given one."""
    height, width = image.shape[:2]
    h, w = _blocks(height, width, BLOCK)
    left = (image - _predicted(image, mode)).astype(np.uint8)
    counts = np.stack([np.bincount(left[..., c].ravel(), minlength=256) for c in range(4)])
    price = np.rint(16 * np.log2((height * width + 256) / (counts + 1))).astype(np.int32)
    takes = []
    for m in (mode, *(m for m in MODES if m != mode)):
        left = (image - _predicted(image, m)).astype(np.uint8)
        each = sum(price[c][left[..., c]] for c in range(4))
        each = np.pad(each, ((0, (h << BLOCK) - height), (0, (w << BLOCK) - width)))
        takes.append(each.reshape(h, 1 << BLOCK, w, 1 << BLOCK).sum(axis=(1, 3)) + (0 if m == mode else SYMBOL))
    modes = np.array([mode, *(m for m in MODES if m != mode)])
    return modes[np.argmin(np.stack(takes), axis=0)]


def _repeats(slot: np.ndarray, pixels: np.ndarray) -> np.ndarray:
    """Where the pixel before in the same slot is equal."""
    order = np.argsort(slot, kind="stable")
    packed = np.ascontiguousarray(pixels).view("<u4").ravel()[order]
    slot = slot[order]
    same = np.zeros(len(slot), bool)
    same[order[1:]] = (slot[1:] == slot[:-1]) & (packed[1:] == packed[:-1])
    return same


def _put_pixels(out: Writer, pixels: np.ndarray, main: bool, cache_bits: int, limit: int) -> None:
    """Runs of a pixel as back-references, cached colours as cache codes, the rest as literals."""
    n = len(pixels)
    packed = np.ascontiguousarray(pixels).view("<u4").ravel()
    same = np.zeros(n, bool)
    same[1:] = packed[1:] == packed[:-1]
    edges = np.zeros(n + 1, np.int8)
    edges[:n] = same
    edges[1:] -= same
    begins, ends = np.nonzero(edges == 1)[0], np.nonzero(edges == -1)[0]
    long = ends - begins >= 4
    begins, ends = begins[long], ends[long]
    # a copy has 4096 pixels at most
    parts = -(-(ends - begins) // 4096)
    starts = np.repeat(begins, parts) + 4096 * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    sizes = np.minimum(np.repeat(ends, parts) - starts, 4096)
    inside = np.zeros(n + 1, np.int64)
    np.add.at(inside, begins, 1)
    np.add.at(inside, ends, -1)
    literal = np.cumsum(inside)[:n] == 0
    cached = literal & _cached(pixels, cache_bits) if cache_bits else np.zeros(n, bool)
    literal &= ~cached

    out.put(1 if cache_bits else 0, 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if main:
        out.put(0, 1)
    copy_symbol, copy_extra, copy_size = _value_code(sizes)
    lit = pixels[literal]
    slots = _cache_index(pixels[cached], cache_bits) if cache_bits else np.zeros(0, np.int64)
    counts = [np.bincount(lit[:, G], minlength=ALPHABETS[0] + (1 << cache_bits if cache_bits else 0))]
    counts[0] += np.bincount(256 + copy_symbol, minlength=len(counts[0])) + np.bincount(280 + slots, minlength=len(counts[0]))
    others = np.bincount((lit[:, [R, B, A]] + np.array([0, 256, 512])).ravel(), minlength=768).reshape(3, 256)
    joint = others.sum(axis=0)
    if _bits(joint) <= _bits(others).sum():  # one code for three channels saves headers
        others = [joint]
    near = np.zeros(2, np.int64)
    near[1] = len(sizes)  # distance code 2: the pixel to the left
    lengths = [code_lengths(c, limit) for c in (counts[0], *others, near)]
    headers = [_code_header(x) for x in lengths]
    which = (0, 1, 1, 1, 2) if len(others) == 1 else (0, 1, 2, 3, 4)
    for k in which:
        out.put_all(*headers[k])
    alone = [np.count_nonzero(x) < 2 for x in lengths]  # such a code takes no bits
    codes = [np.zeros_like(x) if one else canonical(x) for x, one in zip(lengths, alone)]
    bits = [np.zeros_like(x) if one else x for x, one in zip(lengths, alone)]
    codes, bits = [[x[k] for k in which] for x in (codes, bits)]

    value, size = np.zeros(n, np.uint64), np.zeros(n, np.int64)
    v, s = np.zeros(len(lit), np.uint64), np.zeros(len(lit), np.int64)
    for k, channel in enumerate(READ_ORDER):
        v |= codes[k][lit[:, channel]].astype(np.uint64) << s.astype(np.uint64)
        s += bits[k][lit[:, channel]]
    value[literal], size[literal] = v, s
    value[cached], size[cached] = codes[0][280 + slots], bits[0][280 + slots]
    value[starts] = codes[0][256 + copy_symbol] | copy_extra << bits[0][256 + copy_symbol]
    size[starts] = bits[0][256 + copy_symbol] + copy_size
    token = literal | cached
    token[starts] = True
    out.extend(value[token], size[token])


def _blocks(width: int, height: int, bits: int) -> tuple[int, int]:
    return (width + (1 << bits) - 1) >> bits, (height + (1 << bits) - 1) >> bits


def encode(
    pixels: np.ndarray, predictor: int | np.ndarray | None = None, cross: tuple[int, int, int] | None = None,
    subtract_green: bool = False, palette: bool = False, cache_bits: int | None = None, block_bits: int = BLOCK, limit: int = 12,
) -> bytes:
    """A file of an (height, width, 4) array of RGBA bytes.

    Transforms: a predictor mode for all blocks or one for each, one cross-colour element
    (green to red, green to blue, red to blue), subtract-green, or a palette. Where none is
    named, nor a cache, those of plans() are taken.
    """
    if predictor is None and cross is None and cache_bits is None and not (subtract_green or palette):
        return encode(pixels, **plans([pixels])[0], limit=limit)
    cache_bits = cache_bits or 0
    height, width = pixels.shape[:2]
    if not (0 < height <= MAX_SIDE and 0 < width <= MAX_SIDE):
        raise ValueError("sides are 1 to 16384 pixels")
    out = Writer()
    for value, size in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        out.put(value, size)
    image = pixels
    if palette:
        colours, index = np.unique(np.ascontiguousarray(pixels).view("<u4").ravel(), return_inverse=True)
        if len(colours) > 256:
            raise ValueError("a palette has 256 colours at most")
        table = colours.astype("<u4").view(np.uint8).reshape(-1, 4)
        out.put(1, 1)
        out.put(PALETTE, 2)
        out.put(len(table) - 1, 8)
        _put_pixels(out, np.diff(table, axis=0, prepend=np.zeros((1, 4), np.uint8)).astype(np.uint8), False, 0, limit)
        share = _bundle(len(table))
        index = index.reshape(height, width).astype(np.int64)
        index = np.pad(index, ((0, 0), (0, -width % share))).reshape(height, -1, share)
        image = np.zeros((*index.shape[:2], 4), np.uint8)
        image[..., A] = 255
        image[..., G] = (index << (np.arange(share) * (8 // share))).sum(axis=2)
    w, h = image.shape[1], image.shape[0]
    if predictor is not None:
        modes = np.broadcast_to(np.asarray(predictor), _blocks(h, w, block_bits))
        spread = modes.repeat(1 << block_bits, axis=0).repeat(1 << block_bits, axis=1)[:h, :w]
        left = np.empty_like(image)
        for m in np.unique(modes).tolist():
            left[spread == m] = (image - _predicted(image, m)).astype(np.uint8)[spread == m]
        image = left
        _put_blocks(out, PREDICTOR, (0, modes, 0, 255), w, h, block_bits, limit)
    if cross is not None:
        image = _cross(image, np.broadcast_to(np.array(cross, np.int64), (h, w, 3)), -1)
        _put_blocks(out, CROSS_COLOUR, (cross[2] & 255, cross[1] & 255, cross[0] & 255, 255), w, h, block_bits, limit)
    if subtract_green:
        image = _green_taken(image)
        out.put(1, 1)
        out.put(SUBTRACT_GREEN, 2)
    out.put(0, 1)
    _put_pixels(out, image.reshape(-1, 4), True, cache_bits, limit)
    data = out.data()
    data += bytes(len(data) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(data)) + b"WEBPVP8L" + struct.pack("<I", len(data)) + data


def _put_blocks(out: Writer, kind: int, element: tuple, width: int, height: int, bits: int, limit: int) -> None:
    out.put(1, 1)
    out.put(kind, 2)
    out.put(bits - 2, 3)
    w, h = _blocks(width, height, bits)
    image = np.empty((h, w, 4), np.uint8)
    for channel, value in enumerate(element):
        image[..., channel] = value
    _put_pixels(out, image.reshape(-1, 4), False, 0, limit)


def _bundle(colours: int) -> int:
    """Palette indices in a byte."""
    return 8 if colours <= 2 else 4 if colours <= 4 else 2 if colours <= 16 else 1


# --- transforms


def _predict(mode, left, top, right, corner):
    """Predictions from neighbours, as integer arrays of four channels."""
    mean = lambda a, b: (a + b) >> 1
    if mode == 0:
        return np.broadcast_to(np.array([0, 0, 0, 255], top.dtype), top.shape)
    if mode in (1, 2, 3, 4):
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return mean(mean(left, right), top)
    if mode == 6:
        return mean(left, corner)
    if mode == 7:
        return mean(left, top)
    if mode == 8:
        return mean(corner, top)
    if mode == 9:
        return mean(top, right)
    if mode == 10:
        return mean(mean(left, corner), mean(top, right))
    if mode == 11:
        near_left = np.abs(top - corner).sum(axis=-1) < np.abs(left - corner).sum(axis=-1)
        return np.where(near_left[..., None], left, top)
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        a = mean(left, top)
        return np.clip(a + ((a - corner + (a < corner)) >> 1), 0, 255)
    raise ValueError("predictor modes are 0 to 13")


def _predicted(image: np.ndarray, mode: int) -> np.ndarray:
    """What a known image's pixels are predicted as."""
    x = image.astype(np.int16)
    flat = x.reshape(-1, 4)
    w = image.shape[1]
    before = lambda n: np.concatenate([np.zeros((min(n, len(flat)), 4), np.int16), flat[: max(0, len(flat) - n)]]).reshape(x.shape)
    left, top, right, corner = before(1), before(w), before(w - 1) if w > 1 else x * 0, before(w + 1)
    if w == 1:
        right = left
    out = np.array(_predict(mode, left, top, right, corner))
    out[0], out[:, 0] = left[0], top[:, 0]
    out[0, 0] = (0, 0, 0, 255)
    return out


def _inverse_predictor(image: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    height, width = image.shape[:2]
    out = image.astype(np.int64).reshape(-1, 4)
    first = out[0] + (0, 0, 0, 255)
    out[0] = first & 255
    row = out[:width]
    row[:] = np.cumsum(row, axis=0) & 255
    for y in range(1, height):
        a = y * width
        out[a] = (out[a] + out[a - width]) & 255
        line = modes[y >> bits]
        x = 1
        while x < width:
            stop = min(width, ((x >> bits) + 1) << bits)
            while stop < width and line[stop >> bits] == line[x >> bits]:
                stop = min(width, stop + (1 << bits))
            mode, span = int(line[x >> bits]), slice(a + x, a + stop)
            top, right, corner = (out[a + x - d : a + stop - d] for d in (width, width - 1, width + 1))
            if mode in (0, 2, 3, 4, 8, 9):
                # a right neighbour of the last pixel is this row's first, which is known
                out[span] = (out[span] + _predict(mode, top, top, right, corner)) & 255
            elif mode == 1:
                out[span] = (np.cumsum(np.concatenate([out[a + x - 1 : a + x], out[span]]), axis=0)[1:]) & 255
            else:
                out[span] = _rest_of_line(mode, out[a + x - 1].tolist(), top.tolist(), right.tolist(), corner.tolist(), out[span].tolist())
            x = stop
    return out.astype(np.uint8).reshape(image.shape)


def _rest_of_line(mode: int, left: list, top: list, right: list, corner: list, line: list) -> list:
    """Pixels of a line under a mode that looks to the left: each needs the one before."""
    out = []
    for t, r, c, x in zip(top, right, corner, line):
        if mode == 5:
            p = [((a + d) // 2 + b) // 2 for a, b, d in zip(left, t, r)]
        elif mode == 6:
            p = [(a + d) // 2 for a, d in zip(left, c)]
        elif mode == 7:
            p = [(a + b) // 2 for a, b in zip(left, t)]
        elif mode == 10:
            p = [((a + e) // 2 + (b + d) // 2) // 2 for a, b, d, e in zip(left, t, r, c)]
        elif mode == 11:
            p = left if sum(abs(b - e) for b, e in zip(t, c)) < sum(abs(a - e) for a, e in zip(left, c)) else t
        elif mode == 12:
            p = [min(255, max(0, a + b - e)) for a, b, e in zip(left, t, c)]
        elif mode == 13:
            p = [min(255, max(0, m + (m - e + (m < e) >> 1))) for m, e in zip([(a + b) // 2 for a, b in zip(left, t)], c)]
        else:
            raise ValueError("predictor modes are 0 to 13")
        left = [a + b & 255 for a, b in zip(x, p)]
        out.append(left)
    return out


def _cross(image: np.ndarray, elements: np.ndarray, sign: int) -> np.ndarray:
    """Adds (sign 1) or takes away what green tells of red and blue, and red of blue."""
    small = lambda v: np.asarray(v).astype(np.int8).astype(np.int32)
    delta = lambda e, c: small(e) * small(c) >> 5
    red, green, blue = (image[..., k].astype(np.int32) for k in (R, G, B))
    changed = (red + sign * delta(elements[..., 0], green)) & 255
    true_red = changed if sign > 0 else red
    blue = (blue + sign * (delta(elements[..., 1], green) + delta(elements[..., 2], true_red))) & 255
    out = image.copy()
    out[..., R], out[..., B] = changed, blue
    return out


# --- reading


def _read_code(bits: Reader, alphabet: int) -> Table:
    lengths = np.zeros(alphabet, dtype=np.int64)
    if bits.take(1):
        n = bits.take(1) + 1
        lengths[bits.take(8 if bits.take(1) else 1)] = 1
        if n == 2:
            lengths[bits.take(8)] = 1
        return Table(lengths)
    meta = np.zeros(19, dtype=np.int64)
    for s in CODE_LENGTH_ORDER[: bits.take(4) + 4]:
        meta[s] = bits.take(3)
    left = alphabet
    if bits.take(1):
        left = 2 + bits.take(2 + 2 * bits.take(3))
    table, last, data = Table(meta), 8, bits.data
    symbols, sizes, mask = table.symbols.tolist(), table.sizes.tolist(), (1 << table.width) - 1
    found: list[int] = []
    p = bits.at >> 3
    have = 256 - (bits.at & 7)
    held = int.from_bytes(data[p : p + 32], "little") >> (bits.at & 7)
    p += 32
    while len(found) < alphabet and left > 0:
        left -= 1
        if have < 16:
            held |= int.from_bytes(data[p : p + 32], "little") << have
            have += 256
            p += 32
        code = held & mask
        s, size = symbols[code], sizes[code]
        if s < 16:
            found.append(s)
            last = s or last
        else:
            extra = (2, 3, 7)[s - 16]
            run = (held >> size & ((1 << extra) - 1)) + (11 if s == 18 else 3)
            found += [last if s == 16 else 0] * run
            size += extra
        held >>= size
        have -= size
    bits.at = 8 * p - have
    if bits.at > 8 * (len(data) - PAD):
        raise ValueError("the image ends early")
    if len(found) > alphabet:
        raise ValueError("too many code lengths")
    lengths[: len(found)] = found
    return Table(lengths)


def _read_group(bits: Reader, alphabets: tuple[int, ...]) -> list[Table]:
    """The codes of a group; one written with the same bits as the one before is that code."""
    tables: list[Table] = []
    start = size = 0
    for k, alphabet in enumerate(alphabets):
        if k and alphabet == alphabets[k - 1] and bits.between(bits.at, size) == bits.between(start, size):
            tables.append(tables[-1])
            bits.at += size
            continue
        start = bits.at
        tables.append(_read_code(bits, alphabet))
        size = bits.at - start
    return tables


def _value(bits: Reader, symbol: int) -> int:
    if symbol < 4:
        return symbol + 1
    size = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << size) + bits.take(size) + 1


def _distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def _windows(bits: Reader, start: int, size: int, mask: int) -> np.ndarray:
    """The bits from each bit of a window of so many bytes on."""
    raw = np.frombuffer(bits.data, np.uint8, min(size + 3, len(bits.data) - start), start).astype(np.uint32)
    words = raw[:-3] | raw[1:-2] << np.uint32(8) | raw[2:-1] << np.uint32(16) | raw[3:] << np.uint32(24)
    return ((words[:, None] >> np.arange(8, dtype=np.uint32)) & np.uint32(mask)).ravel().astype(np.int64)


def _read_tokens(bits: Reader, tables: list[Table], n: int, width: int, cache_bits: int) -> np.ndarray:
    """n pixels of literals, back-references and cache codes, of one code group.

    Where tokens end doesn't depend on pixels, so it is looked up for every bit; only
    back-references stop the walk. Cached colours are found once all tokens are known.
    """
    green, others, far = tables[0], tables[1:4], tables[4]
    widest = max(t.width for t in tables[:4])
    if not green.width and (green.symbols[0] >= 256 or not widest):
        if 256 <= green.symbols[0] < 280:
            raise ValueError("a back-reference leaves the image")
        out = np.zeros((n, 4), np.uint8)
        if green.symbols[0] < 256:
            out[:] = [tables[(1, 0, 2, 3)[k]].symbols[0] for k in range(4)]
        return out
    colours: list[np.ndarray] = []
    kinds: list[np.ndarray] = []
    copies: list[tuple[int, int, int]] = []  # tokens before, pixels, distance
    done = tokens = 0
    while done < n:
        base = bits.at >> 3 << 3
        codes = _windows(bits, base >> 3, min(WINDOW, 8 * (n - done) + PAD), (1 << widest) - 1)
        last = len(codes) - 64
        if last <= bits.at - base:
            raise ValueError("the image ends early")
        places = np.arange(len(codes))
        cut = lambda t: codes if t.width == widest else codes & ((1 << t.width) - 1)
        code = cut(green)
        symbol = green.symbols.take(code)
        first = places[:last] + green.sizes.take(code[:last])
        jump, step, before = places, places, None
        after = first
        for t in others:
            if t is not before:
                step, before = places + t.sizes.take(cut(t)), t
            after = step.take(after)
        jump = np.concatenate([after, places[last:]])
        special = np.nonzero(symbol[:last] >= 256)[0]
        jump[special] = np.where(symbol[special] >= 280, first[special], special)  # the walk stops at copies
        twice = jump.take(jump)
        leap = memoryview(twice.take(twice))
        chains: list[np.ndarray] = []
        p = bits.at - base
        while p < last and done < n:
            found: list[int] = []
            put = found.append
            while (q := leap[p]) != p:
                put(p)
                p = q
            if found:
                at = np.array(found)
                chain = np.empty((len(at), 4), np.int64)
                chain[:, 0], chain[:, 1], chain[:, 2] = at, jump.take(at), twice.take(at)
                chain[:, 3] = jump.take(chain[:, 2])
                chain = chain.ravel()
                chain = chain[: int(np.searchsorted(chain, p))][: n - done]
                chains.append(chain)
                done += len(chain)
                tokens += len(chain)
                if done == n:
                    p = int(jump[chain[-1]])
                    break
            if p < last:
                bits.at = base + int(first[p])
                size = _value(bits, int(symbol[p]) - 256)
                distance = _distance(_value(bits, bits.symbol(far)), width)
                if distance > done or size > n - done:
                    raise ValueError("a back-reference leaves the image")
                copies.append((tokens, size, distance))
                done += size
                p = bits.at - base
        bits.at = base + p
        if bits.at > 8 * (len(bits.data) - PAD):
            raise ValueError("the image ends early")
        if not chains:
            continue
        at = np.concatenate(chains) if len(chains) > 1 else chains[0]
        kinds.append(symbol[at])
        part = np.empty((len(at), 4), np.uint8)
        part[:, G] = kinds[-1]
        at = first[at]
        for t, channel in zip(others, READ_ORDER[1:]):
            code = codes.take(at, mode="clip") & ((1 << t.width) - 1)
            part[:, channel] = t.symbols.take(code)
            at = at + t.sizes.take(code)
        colours.append(part)
    pixels = np.concatenate(colours) if len(colours) != 1 else colours[0]
    kind = np.concatenate(kinds)
    of = np.arange(n)  # the token of each pixel
    if copies:
        sizes, shift = np.zeros(tokens + 1, np.int64), 0
        for before, size, _ in copies:
            sizes[before] += size
        own = np.arange(tokens) + np.cumsum(sizes)[:tokens]
        of[own] = np.arange(tokens)
        for before, size, distance in copies:
            a = before + shift
            shift += size
            if distance == 1:
                of[a : a + size] = of[a - 1]
                continue
            for b in range(a, a + size, distance):
                k = min(distance, a + size - b)
                of[b : b + k] = of[b - distance : b - distance + k]
    else:
        own = of
    cached = kind >= 280
    if cached.any():
        if not cache_bits:
            raise ValueError("a cache code without a cache")
        slot = np.where(cached, kind - 280, _cache_index(pixels, cache_bits))
        seen = slot[of].astype(np.uint16)
        order = np.argsort(seen, kind="stable")
        held = np.full(n, n)  # the pixel before in the same slot
        follows = seen[order[1:]] == seen[order[:-1]]
        held[order[1:][follows]] = order[:-1][follows]
        source = np.append(own[of], n)
        source[own[cached]] = held[own[cached]]
        while True:
            further = source[source]
            if (further == source).all():
                break
            source = further
        return np.concatenate([pixels[of], np.zeros((1, 4), np.uint8)])[source[:n]]
    return pixels[of] if copies else pixels


def _read_groups(bits: Reader, groups: list, which: np.ndarray, block_bits: int, n: int, width: int, cache_bits: int) -> np.ndarray:
    """n pixels where the block decides the code group, one token after another."""
    out = np.zeros((n, 4), np.uint8)
    cache = np.zeros((1 << cache_bits, 4), np.uint8) if cache_bits else None
    pixel = 0
    while pixel < n:
        y, x = divmod(pixel, width)
        green, red, blue, alpha, far = groups[which[y >> block_bits, x >> block_bits]]
        s, size = bits.symbol(green), 1
        if s < 256:
            r, b, a = bits.symbol(red), bits.symbol(blue), bits.symbol(alpha)
            out[pixel] = (r, s, b, a)
        elif s < 280:
            size = _value(bits, s - 256)
            distance = _distance(_value(bits, bits.symbol(far)), width)
            if distance > pixel or size > n - pixel:
                raise ValueError("a back-reference leaves the image")
            for i in range(pixel, pixel + size):
                out[i] = out[i - distance]
        elif cache is not None:
            out[pixel] = cache[s - 280]
        else:
            raise ValueError("a cache code without a cache")
        if cache is not None:
            cache[_cache_index(out[pixel : pixel + size], cache_bits)] = out[pixel : pixel + size]
        pixel += size
    return out


def _read_image(bits: Reader, width: int, height: int, main: bool) -> np.ndarray:
    cache_bits = bits.take(4) if bits.take(1) else 0
    which, block_bits, groups = None, 0, 1
    if main and bits.take(1):
        block_bits = bits.take(3) + 2
        blocks = _read_image(bits, *_blocks(width, height, block_bits), False).astype(np.int64)
        which = blocks[..., R] << 8 | blocks[..., G]
        groups = int(which.max()) + 1
    sizes = (ALPHABETS[0] + (1 << cache_bits if cache_bits else 0), *ALPHABETS[1:])
    codes = [_read_group(bits, sizes) for _ in range(groups)]
    n = width * height
    if which is not None:
        flat = _read_groups(bits, codes, which, block_bits, n, width, cache_bits)
    else:
        flat = _read_tokens(bits, codes[0], n, width, cache_bits)
    return flat.reshape(height, width, 4)


def decode(data: bytes) -> np.ndarray:
    """The (height, width, 4) array of RGBA bytes of a lossless file."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP file")
    bits = Reader(data[20 : 20 + struct.unpack_from("<I", data, 16)[0]])
    if bits.take(8) != 0x2F:
        raise ValueError("bad signature")
    width, height = bits.take(14) + 1, bits.take(14) + 1
    bits.take(1)
    if bits.take(3):
        raise ValueError("unknown version")
    undo, seen, w = [], set(), width
    while bits.take(1):
        kind = bits.take(2)
        if kind in seen:
            raise ValueError("a transform comes twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            b = bits.take(3) + 2
            undo.append((kind, b, _read_image(bits, *_blocks(w, height, b), False)))
        elif kind == PALETTE:
            table = np.cumsum(_read_image(bits, bits.take(8) + 1, 1, False)[0].astype(np.int64), axis=0).astype(np.uint8)
            undo.append((kind, w, table))
            w = -(-w // _bundle(len(table)))
        else:
            undo.append((kind, 0, None))
    image = _read_image(bits, w, height, True)
    for kind, b, extra in reversed(undo):
        if kind == PREDICTOR:
            image = _inverse_predictor(image, extra[..., G] & 15, b)
        elif kind == CROSS_COLOUR:
            spread = extra.repeat(1 << b, axis=0).repeat(1 << b, axis=1)[:height, : image.shape[1]]
            image = _cross(image, spread[..., [B, G, R]], 1)
        elif kind == SUBTRACT_GREEN:
            image = image.copy()
            image[..., R] += image[..., G]
            image[..., B] += image[..., G]
        else:
            share = _bundle(len(extra))
            index = image[..., G].astype(np.int64)[..., None] >> (np.arange(share) * (8 // share)) & ((1 << 8 // share) - 1)
            index = index.reshape(height, -1)[:, :b]
            colours = np.zeros((256, 4), np.uint8)
            colours[: len(extra)] = extra
            image = colours[index]
    return image
