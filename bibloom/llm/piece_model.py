"""A SentencePiece BPE model read from its file: normalisation with alignment, encoding, decoding.

The helper that pieces.py runs inside tasks. Texts are cut where no piece of the
vocabulary can reach across (before a space mark that follows another character), so equal
words are encoded once and then looked up. New words of many texts are merged side by side.
"""

from __future__ import annotations

import heapq
import re
import struct

import numpy as np

SPACE = "▁"
# Fixed values of the model format: kinds of pieces
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
CACHE = 600_000
SHORT = 48
TOGETHER = 1 << 19  # characters of new words that are merged at once
NEVER = float("inf")


def fields(data: bytes):
    """(number, value) of each field of a protocol buffer message; fixed-width values as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield tag >> 3, data[at : at + size]
        at += size


class CharacterMap:
    """The compiled character map: a double-array trie of source prefixes with their replacements."""

    def __init__(self, blob: bytes):
        self.rules: dict[str, str] = {}
        if not blob:
            self.longest = 0
            return
        size = struct.unpack_from("<I", blob)[0]
        units = np.frombuffer(blob, "<u4", size // 4, 4).astype(np.int64)
        strings = blob[4 + size :]
        shift = lambda u: (int(u) >> 10) << ((int(u) & 512) >> 6)
        todo, letters = [(shift(units[0]), b"")], np.arange(1, 256)
        while todo:
            base, prefix = todo.pop()
            at = base ^ letters
            at = np.where(at < len(units), at, 0)
            for c in letters[(units[at] & 0x800000FF) == letters].tolist():
                unit = int(units[base ^ c])
                below, key = (base ^ c) ^ shift(unit), prefix + bytes([c])
                if unit >> 8 & 1:
                    start = int(units[below]) & 0x7FFFFFFF
                    self.rules[key.decode()] = strings[start : strings.index(b"\0", start)].decode()
                todo.append((below, key))
        self.longest = max(map(len, self.rules), default=0)
        self.first = re.compile("[" + re.escape("".join(sorted({k[0] for k in self.rules}))) + "]")

    def walk(self, text: str):
        """(output, source characters, whether unchanged) from left to right: by the longest rule at each place, what no rule begins in as whole runs."""
        at = 0
        while at < len(text):
            m = self.first.search(text, at) if self.rules else None
            stop = m.start() if m else len(text)
            if stop > at:
                yield text[at:stop], stop - at, True
            if not m:
                return
            at = stop
            for n in range(min(self.longest, len(text) - at), 0, -1):
                if (out := self.rules.get(text[at : at + n])) is not None:
                    yield out, n, False
                    at += n
                    break
            else:
                yield text[at], 1, True
                at += 1


class PieceModel:
    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        trainer: dict = {}
        spec: dict = {}
        for number, value in fields(data):
            if number == 1:
                f = dict(fields(value))
                self.pieces.append((f.get(1, b"").decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                spec = dict(fields(value))
        if trainer.get(3, 1) != 2 or trainer.get(24, 0):
            raise ValueError("only BPE models with the space mark in front are supported")
        if any(kind in (USER_DEFINED, UNUSED) for _, _, kind in self.pieces):
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.byte_fallback = bool(trainer.get(35, 0))
        signed = lambda v: v - (1 << 64) if v >> 63 else v
        self.unk, self.bos, self.eos = (signed(trainer.get(k, d)) for k, d in ((40, 0), (41, 1), (42, 2)))
        self.unk_surface = trainer.get(44, " ⁇ ".encode()).decode()
        self.map = CharacterMap(spec.get(2, b""))
        self.dummy, self.squeeze = bool(spec.get(3, 1)), bool(spec.get(4, 1))
        self.mark = SPACE if spec.get(5, 1) else " "
        self.ids = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind == NORMAL}
        self.scores = {p: s for p, s, kind in self.pieces if kind == NORMAL}
        self.costs = {p: -s for p, s in self.scores.items()}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(self.pieces) if kind == BYTE}
        apart = self.mark == SPACE and not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.segments = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if apart else "(?s:.+)")
        self.known: dict[str, bytes] = {}
        self._pairs()
        self.surfaces = [self._surface(p, kind) for p, _, kind in self.pieces]

    def _surface(self, piece: str, kind: int) -> bytes:
        if kind == CONTROL:
            return b""
        if kind == UNKNOWN:
            return self.unk_surface.encode()
        return bytes([int(piece[3:5], 16)]) if kind == BYTE else piece.replace(SPACE, " ").encode()

    # normalisation

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its characters and its end the source byte where it begins."""
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        at = np.zeros(len(points) + 1, dtype=np.int64)
        np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF), out=at[1:])
        out: list[str] = []
        source: list[np.ndarray] = []
        # where the text begins: its first character other than the spaces that are squeezed away
        begin, done, space = None, 0, self.squeeze
        for piece, n, same in self.map.walk(text):
            places = np.arange(done, done + n) if same else np.full(len(piece), done)
            if begin is None:
                blank = n - len(piece.lstrip(" ")) if same and self.squeeze else 0
                if not self.squeeze or (blank < n if same else piece != " "):
                    begin = done + blank
            if self.squeeze and same:
                blanks = points[done : done + n] == 32
                keep = ~(blanks & np.concatenate([[space], blanks[:-1]]))
                space = bool(blanks[-1])
                piece, places = points[done : done + n][keep].tobytes().decode("utf-32-le"), places[keep]
            elif self.squeeze:
                blank = len(piece) - len(piece.lstrip(" ")) if space else 0
                piece, places = piece[blank:], places[blank:]
                space = piece[-1] == " " if piece else space
            out.append(piece)
            source.append(places)
            done += n
        if begin is None:
            return "", at[:1]
        norm = (self.mark if self.dummy else "") + "".join(out).replace(" ", self.mark)
        places = np.concatenate([[begin] if self.dummy else [], *source, [done]]).astype(np.int64)
        if self.squeeze:
            norm = norm.rstrip(self.mark)
        return norm, at[places[: len(norm) + 1]]

    # encoding

    def _merge(self, segment: str) -> list[str]:
        """Best-scored neighbours merge first, the leftmost of equals."""
        if len(segment) > SHORT:
            return self._merge_long(segment)
        cost, parts = self.costs, list(segment)
        costs = [cost.get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        while costs and (best := min(costs)) < NEVER:
            i = costs.index(best)
            parts[i : i + 2] = [whole := parts[i] + parts[i + 1]]
            del costs[i]
            if i:
                costs[i - 1] = cost.get(parts[i - 1] + whole, NEVER)
            if i < len(costs):
                costs[i] = cost.get(whole + parts[i + 1], NEVER)
        return parts

    def _merge_long(self, segment: str) -> list[str]:
        """The same with a heap, for segments where looking through all neighbours is slow."""
        parts: list[str | None] = list(segment)
        n = len(parts)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        scores = self.scores
        heap = [(-s, i, i + 1, 2) for i in range(n - 1) if (s := scores.get(segment[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, j, size = heapq.heappop(heap)
            a, b = parts[i], parts[j]
            if a is None or b is None or len(a) + len(b) != size or right[i] != j:
                continue
            parts[i], parts[j] = a + b, None
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                if (s := scores.get(parts[i] + parts[k])) is not None:
                    heapq.heappush(heap, (-s, i, k, size + len(parts[k])))
            if (h := left[i]) >= 0 and (s := scores.get(parts[h] + parts[i])) is not None:
                heapq.heappush(heap, (-s, h, i, size + len(parts[h])))
        return [p for p in parts if p is not None]

    def _segment(self, segment: str) -> bytes:
        """Pairs of an id and a normalised length; of a character's byte pieces the last one holds the character."""
        pairs: list[int] = []
        for part in self._merge(segment):
            found = self.ids.get(part)
            if found is not None:
                pairs += (found, len(part))
            else:
                pairs += self._unknown(part)
        out = struct.pack(f"<{len(pairs)}I", *pairs)
        if len(segment) <= 64:
            if len(self.known) >= CACHE:
                self.known.clear()
            self.known[segment] = out
        return out

    def _unknown(self, part: str) -> list[int]:
        if not self.byte_fallback:
            return [self.unk, len(part)]
        pairs: list[int] = []
        for c in part:
            for b in c.encode():
                pairs += (self.bytes[b], 0)
            pairs[-1] = 1
        return pairs

    def _pairs(self) -> None:
        """Sorted keys of the pairs of pieces that merge to a piece, with its id and its rank by score."""
        ids, width = self.ids, len(self.pieces)
        found = [(a * width + b, i) for p, i in ids.items() for k in range(1, len(p)) if (a := ids.get(p[:k])) is not None and (b := ids.get(p[k:])) is not None]
        keys, wholes = np.array(found, np.int64).reshape(-1, 2).T
        order = np.argsort(keys)
        self.pair_keys, self.pair_ids = np.append(keys[order], np.iinfo(np.int64).max), np.append(wholes[order], 0)
        ranks = np.unique([-s for _, s, _ in self.pieces], return_inverse=True)[1]
        self.pair_ranks = ranks[self.pair_ids]
        self.piece_sizes = np.array([len(p) for p, _, _ in self.pieces], "<u4")
        # the piece of a single character; those that are none merge with nothing and keep their numbers beyond all pieces
        self.letters = np.arange(width, width + 0x110000, dtype=np.int32)
        for p, i in ids.items():
            if len(p) == 1:
                self.letters[ord(p)] = i
        self.spelt = all(c in ids for c in set("".join(ids)))

    def _learn(self, segments: list[str]) -> None:
        """Merges in short new segments, one in each a round: the best-scored, the leftmost of equals."""
        piece = self.letters[np.frombuffer("".join(segments).encode("utf-32-le"), "<u4")].astype(np.int64)
        of = np.repeat(np.arange(len(segments)), [len(s) for s in segments])
        apart, place, width = np.iinfo(np.int64).max, (1 << 20) - 1, len(self.pieces)

        def weigh(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Rank and merged piece of the pairs that begin at these places."""
            key = np.where(np.maximum(piece[at], piece[at + 1]) < width, piece[at] * width + piece[at + 1], -1)
            k = np.searchsorted(self.pair_keys, key)
            good = (self.pair_keys[k] == key) & (of[at] == of[at + 1])
            return np.where(good, self.pair_ranks[k], apart), self.pair_ids[k]

        rank, whole = np.full(len(of), apart), np.zeros(len(of), np.int64)
        if len(of) > 1:
            rank[:-1], whole[:-1] = weigh(np.arange(len(of) - 1))
        ended: list[tuple[np.ndarray, np.ndarray]] = []
        while len(of):
            first = np.nonzero(np.diff(of, prepend=-1))[0]
            best = np.minimum.reduceat(np.where(rank == apart, apart, (rank << 20) + np.arange(len(of))), first)
            more = best < apart
            at = best[more] & place
            piece[at] = whole[at]
            keep = np.ones(len(of), bool)
            keep[at + 1] = False
            if not more.all():
                over = np.repeat(~more, np.diff(first, append=len(of)))
                ended.append((of[over], piece[over]))
                keep &= ~over
            moved = np.cumsum(keep) - 1
            of, piece, rank, whole, at = of[keep], piece[keep], rank[keep], whole[keep], moved[at]
            rank[at] = apart
            at = np.concatenate([at, at - 1])
            at = at[(at >= 0) & (at < len(of) - 1)]
            rank[at], whole[at] = weigh(at)
        of, piece = (np.concatenate(x) for x in zip(*ended)) if ended else (of, piece)
        order = np.argsort(of, kind="stable")
        of, piece = of[order], piece[order]
        pairs = np.empty((len(piece), 2), "<u4")
        pairs[:, 0], pairs[:, 1] = piece, self.piece_sizes.take(piece, mode="clip")
        data = pairs.tobytes()
        ends = (8 * np.cumsum(np.bincount(of, minlength=len(segments)))).tolist()
        begin = 0
        for segment, end in zip(segments, ends):
            self.known[segment] = data[begin:end]
            begin = end
        odd = np.nonzero(piece >= width)[0]
        for k in np.unique(of[odd]).tolist():
            own = piece[np.searchsorted(of, k) : np.searchsorted(of, k, side="right")].tolist()
            flat = [v for i in own for v in ((i, len(self.pieces[i][0])) if i < width else self._unknown(chr(i - width)))]
            self.known[segments[k]] = struct.pack(f"<{len(flat)}I", *flat)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids with begin and end ids, and the source bytes [begin, end) of each."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """encode() of each text; words that are new in them are merged together."""
        known = self.known
        normal = [self.normalise(t) for t in texts]
        parts = [self.segments.findall(norm) for norm, _ in normal]
        if len(known) >= CACHE:
            known.clear()
        found = [list(map(known.get, segments)) for segments in parts]
        missing = [[i for i, x in enumerate(have) if x is None] for have in found]
        if self.spelt:
            new, size = [], 0
            for s in dict.fromkeys(segments[i] for segments, at in zip(parts, missing) for i in at if len(segments[i]) <= SHORT):
                new.append(s)
                size += len(s)
                if size >= TOGETHER:
                    self._learn(new)
                    new, size = [], 0
            if new:
                self._learn(new)
        for segments, have, at in zip(parts, found, missing):
            for i in at:
                have[i] = known.get(segments[i]) or self._segment(segments[i])
        return [self._joined(have, at) for have, (_, at) in zip(found, normal)]

    def _joined(self, found: list[bytes], at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, sizes = np.frombuffer(b"".join(found), "<u4").reshape(-1, 2).T
        ends = np.cumsum(sizes, dtype=np.int64)
        begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        edge = lambda a, b, x: np.concatenate([[a], x, [b]])
        last = int(at[-1])
        return edge(self.bos, self.eos, ids).astype("<u4"), edge(0, last, at[begins]), edge(0, last, at[ends])

    # decoding

    def decode(self, ids: np.ndarray) -> str:
        ids = ids.tolist()
        out = b"".join(map(self.surfaces.__getitem__, ids))
        if self.dummy or self.squeeze:
            first = next((i for i in ids if self.pieces[i][2] != CONTROL), None)
            if first is not None and self.pieces[first][2] == NORMAL and out[:1] == b" ":
                out = out[1:]
        try:
            return out.decode()
        except UnicodeDecodeError:
            return lenient(out)


def lenient(data: bytes) -> str:
    """Every byte that is part of no valid character becomes U+FFFD."""
    out, at = [], 0
    while at < len(data):
        try:
            out.append(data[at:].decode())
            break
        except UnicodeDecodeError as e:
            out += [data[at : at + e.start].decode(), "�"]
            at += e.start + 1
    return "".join(out)
