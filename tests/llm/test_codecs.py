import hashlib
import random
import zlib

import numpy as np
import pytest
import sentencepiece

from bibloom.llm import media, piece_model, pieces, webp_lossless
from bibloom.llm.piece_model import PieceModel, fields

from . import cases


@pytest.fixture(scope="module")
def both():
    with open(pieces.default_model(), "rb") as f:
        data = f.read()
    return PieceModel(data), sentencepiece.SentencePieceProcessor(model_proto=data)


def odd_texts():
    rng = random.Random(1)
    pool = "ab ▁é漢😀\n\t  the 　\x00"
    return ["", " ", "a  b", " x ", "▁", " ▁ ", "<s></s><unk>", "x" * 3000, *["".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(300)]]


def test_pieces_equal_the_library(both):
    own, library = both
    for text in odd_texts() + [t or "" for t in cases.TEXTS]:
        want = library.encode(text, add_bos=True, add_eos=True)
        ids, begins, ends = own.encode(text)
        assert ids.tolist() == want and own.decode(ids) == library.decode(want)
        raw = text.encode()
        assert begins[1:-1].tolist() == sorted(begins[1:-1].tolist()) and (begins <= ends).all()
        assert b"".join(raw[a:b] for a, b in zip(begins[1:-1], ends[1:-1])) == raw


def test_short_and_long_merges_agree(both):
    own, _ = both
    rng = random.Random(2)
    for _ in range(300):
        s = "▁" + "".join(rng.choice("theanioré") for _ in range(rng.randint(1, 40)))
        assert own._merge(s) == own._merge_long(s)


@pytest.mark.parametrize("dummy", [True, False])
@pytest.mark.parametrize("squeeze", [True, False])
def test_character_map_and_offsets_equal_the_library(both, dummy, squeeze):
    library = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=dummy, remove_extra_whitespaces=squeeze, escape_whitespaces=True)
    spec = next(dict(fields(v)) for n, v in fields(library.serialized_model_proto()) if n == 3)
    own = object.__new__(PieceModel)
    from bibloom.llm.piece_model import CharacterMap

    own.map, own.dummy, own.squeeze, own.mark = CharacterMap(spec[2]), dummy, squeeze, "▁"
    rng = random.Random(3)
    for text in ["", " ", "\t\n", *["".join(rng.choice("ab  \t\nＡＢ ﬁ㍿éｶﾞé½漢😀　①") for _ in range(rng.randint(0, 12))) for _ in range(500)]]:
        norm, at = library.normalize(text, with_offsets=True)
        got, offsets = own.normalise(text)
        bytes_at = np.concatenate([[0], np.cumsum([len(c.encode()) for c in text])]).astype(int)
        assert got == norm and offsets.tolist() == [bytes_at[k] for k in at]


def test_piece_tables(spark, both):
    _, library = both
    docs = cases.documents(spark)
    rows = {r["doc_id"]: r for r in pieces.round_trip(docs).collect()}
    encoded = pieces.encode(docs)
    back = {r["doc_id"]: r["text"] for r in pieces.decode(encoded).collect()}
    for i, t in enumerate(cases.TEXTS):
        ids = np.array(library.encode(t or "", add_bos=True, add_eos=True), "<u4")
        assert rows[i]["n_tokens"] == len(ids) and rows[i]["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()
        assert rows[i]["decoded_sha256"] == cases.sha(library.decode(ids.tolist())) and back[i] == library.decode(ids.tolist())
    assert pieces.round_trip(docs.limit(0)).count() == 0


def images():
    rng = np.random.default_rng(0)
    for trial in range(14):
        h, w, k = int(rng.integers(1, 40)), int(rng.integers(1, 50)), int(rng.integers(2, 256))
        image = rng.integers(0, k, (h, w, 4)).astype(np.uint8)
        if trial % 3 == 0:
            image = (image // max(1, k // 3) * 17).astype(np.uint8).repeat(3, axis=1)[:, :w]
        if trial % 7 == 0:
            image[:] = image[0, 0]
        yield image


def test_webp_round_trips_with_every_transform():
    options = [{}, {"cache_bits": 6}, {"subtract_green": True}, {"cross": (-20, 33, -100)}, {"limit": 15}, {"palette": True}, {"palette": True, "predictor": 3}]
    options += [{"predictor": m, "cache_bits": m % 3 * 2, "block_bits": 2 + m % 5} for m in range(14)]
    options += [{"cross": (120, -33, 10), "predictor": 11, "subtract_green": True, "cache_bits": 3}]
    for image in images():
        for o in options:
            if o.get("palette") and len(np.unique(image.reshape(-1, 4), axis=0)) > 256:
                continue
            back = webp_lossless.decode(webp_lossless.encode(image, **o))
            assert back.shape == image.shape and (back == image).all(), (o, image.shape)


def bits(*parts):
    """A file of (value, size) fields, written by hand."""
    out = at = 0
    for value, size in parts:
        out |= value << at
        at += size
    data = out.to_bytes((at + 7) // 8, "little")
    data += bytes(len(data) & 1)
    return b"RIFF" + (12 + len(data)).to_bytes(4, "little") + b"WEBPVP8L" + len(data).to_bytes(4, "little") + data


ONE = lambda s: [(1, 1), (0, 1), (1, 1), (s, 8)]  # noqa: E731  a code of one symbol
TWO = lambda a, b: [(1, 1), (1, 1), (1, 1), (a, 8), (b, 8)]


def test_webp_reads_files_written_by_hand():
    head = [(0x2F, 8), (4 - 1, 14), (2 - 1, 14), (1, 1), (0, 3)]
    plain = [(0, 1), (0, 1), (0, 1), *TWO(7, 9), *ONE(1), *ONE(2), *ONE(255), *ONE(0)]
    got = webp_lossless.decode(bits(*head, *plain, *[(b, 1) for b in (0, 1, 1, 0, 1, 0, 0, 1)]))
    assert got[..., 1].ravel().tolist() == [7, 9, 9, 7, 9, 7, 7, 9] and (got[..., [0, 2, 3]] == (1, 2, 255)).all()
    # green codes of length 1: literal 5, and length symbol 256 + 3 (four pixels), written with the long form
    lengths = [(0, 1), (12 - 4 + 4, 4)]
    order = webp_lossless.CODE_LENGTH_ORDER[:16]
    lengths += [({0: 2, 1: 2, 18: 1}.get(s, 0), 3) for s in order] + [(0, 1)]
    # canonical: 18 -> 0, 0 -> 10, 1 -> 11; bits go first bit first
    zero, one, long = [(1, 1), (0, 1)], [(1, 1), (1, 1)], lambda n: [(0, 1), (n - 11, 7)]
    lengths += [*(zero * 5), *one, *long(138), *long(115), *one, *long(20)]
    image = [(0, 1), (0, 1), (0, 1), *lengths, *ONE(3), *ONE(4), *ONE(255), *ONE(1)]
    # literal, copy of four from one to the left, literals
    got = webp_lossless.decode(bits(*head, *image, (0, 1), (1, 1), (0, 1), (0, 1), (0, 1)))
    assert (got == np.array([3, 5, 4, 255], np.uint8)).all()


def test_webp_refuses_broken_files():
    good = webp_lossless.encode(np.arange(64, dtype=np.uint8).reshape(4, 4, 4))
    for bad in (b"", good[:30], good[:12] + b"VP8 " + good[16:], good[:20] + b"\0" + good[21:]):
        with pytest.raises((ValueError, IndexError)):
            webp_lossless.decode(bad)


def test_media_columns(spark):
    docs = cases.documents(spark)
    rows = {r["doc_id"]: r for r in media.round_trip(docs).collect()}
    stored = media.encode_column(docs)
    read = {r["doc_id"]: r for r in media.read_column(stored).collect()}
    for i, t in enumerate(cases.TEXTS):
        raw = (t or "").encode()
        want = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(want)) and r["payload_sha256"] == hashlib.sha256(want).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(want[-32:]) and bytes(read[i]["pixels"]) == want and read[i]["feature"] == r["feature"]
    assert rows[0]["media_sha256"] == rows[1]["media_sha256"]
    assert media.round_trip(docs.limit(0)).count() == 0


def test_a_payload_beyond_one_image():
    payload = media.payload_of(b"ab" * 300_000) * 17
    files = media.store(payload)
    assert len(files) == 2 and media.pixels(files).tobytes() == payload


def test_repeated_colours_take_the_smaller_file():
    sizes = []
    for text in ("abcdWXYZ" * 900, "the same line again and again\n" * 400, "", "a", "".join(chr(0x4E00 + i % 4000) for i in range(9000))):
        payload = media.payload_of(text.encode())
        files = media.store(payload)
        assert media.pixels(files).tobytes() == payload
        plain = webp_lossless.encode(np.frombuffer(payload, np.uint8).reshape(-1, media.WIDTH, 4))
        assert len(files) == 1 and len(files[0]) <= len(plain)
        sizes.append(len(files[0]) < len(plain))
    assert sizes[0] and not sizes[-1]


@pytest.mark.parametrize("bits", [2, 3])
def test_predictors_that_differ_by_block(bits):
    rng = np.random.default_rng(bits)
    height, width = 13, 11
    image = rng.integers(0, 256, (height, width, 4), dtype=np.uint8)
    modes = rng.permutation(np.arange(webp_lossless._blocks(width, height, bits)[0] * webp_lossless._blocks(width, height, bits)[1]) % 14)
    modes = modes.reshape(webp_lossless._blocks(width, height, bits)[::-1])
    each = [webp_lossless._predicted(image, m) for m in range(14)]
    left = image.copy()
    for y in range(height):
        for x in range(width):
            left[y, x] = (image[y, x] - each[modes[y >> bits, x >> bits]][y, x]) & 255
    assert (webp_lossless._inverse_predictor(left, modes, bits) == image).all()


def test_a_file_of_several_code_groups():
    """Two groups, blocks of 4 pixels: one code writes the pixel (1, 2, 3, 255) without bits, the other (9, 8, 7, 255) or green 0."""
    out = webp_lossless.Writer()
    for value, size in ((0x2F, 8), (8 - 1, 14), (4 - 1, 14), (1, 1), (0, 3), (0, 1), (0, 1), (1, 1), (0, 3)):
        out.put(value, size)

    def simple(*symbols):
        out.put(1, 1)
        out.put(len(symbols) - 1, 1)
        out.put(1, 1)
        for symbol in symbols:
            out.put(symbol, 8)

    # the image of groups: two pixels, green 0 and 1, a bit each
    out.put(0, 1)
    for symbols in ((0, 1), (0,), (0,), (0,), (0,)):
        simple(*symbols)
    out.put(0, 1)
    out.put(1, 1)
    for group in (((2,), (1,), (3,), (255,), (0,)), ((0, 8), (9,), (7,), (255,), (0,))):
        for symbols in group:
            simple(*symbols)
    picks = [[1, 0, 0, 1], [1, 1, 1, 1], [0, 0, 0, 0], [0, 1, 0, 1]]
    for row in picks:
        for bit in row:
            out.put(bit, 1)
    data = out.data()
    data += bytes(len(data) & 1)
    import struct

    got = webp_lossless.decode(b"RIFF" + struct.pack("<I", 12 + len(data)) + b"WEBPVP8L" + struct.pack("<I", len(data)) + data)
    want = np.zeros((4, 8, 4), np.uint8)
    want[:, :4] = (1, 2, 3, 255)
    want[:, 4:] = [[(9, 8 * bit, 7, 255) for bit in row] for row in picks]
    assert (got == want).all()


def test_stored_texts_take_the_transforms_and_caches_that_pay():
    rng = np.random.default_rng(5)
    rows = 24
    slope = (np.arange(rows)[:, None, None] * 2 + np.arange(media.WIDTH)[None, :, None] + rng.integers(0, 2, (rows, media.WIDTH, 4))).astype(np.uint8)
    grey = np.repeat(rng.integers(0, 256, (rows, media.WIDTH, 1)), 4, axis=2).astype(np.uint8)
    half = grey.copy()
    half[..., 0] = grey[..., 0].view(np.int8) // 2
    words = rng.integers(0, 256, (300, 4)).astype(np.uint8)[rng.integers(0, 300, rows * media.WIDTH)].reshape(rows, media.WIDTH, 4)
    text = np.frombuffer(media.payload_of("".join(chr(0x4E00 + i % 4000) for i in range(9000)).encode()), np.uint8).reshape(-1, media.WIDTH, 4)
    images = [slope, grey, half, words, text]
    plans = webp_lossless.plans(images)
    assert [str(p) for p in plans] == [str(webp_lossless.plans([x])[0]) for x in images]  # neighbours don't matter
    assert plans[0]["predictor"] is not None and plans[4]["predictor"] is not None
    assert plans[1]["subtract_green"] or plans[1]["cross"]
    assert plans[2]["cross"] and plans[3]["cache_bits"]
    for image, files in zip(images, media.store_all([x.tobytes() for x in images])):
        assert media.pixels(files).tobytes() == image.tobytes()
        assert len(files[0]) < 0.9 * len(webp_lossless.encode(image, cache_bits=0))
    # blocks that are unlike take modes of their own
    both = np.concatenate([slope[:16], np.repeat(rng.integers(0, 256, (1, media.WIDTH, 4)), 16, axis=0).astype(np.uint8)])
    modes = webp_lossless._block_modes(both, 2)
    assert len(np.unique(modes)) > 1 and (webp_lossless.decode(webp_lossless.encode(both, predictor=modes)) == both).all()


def test_cached_colours_behind_copies_and_collisions():
    rng = np.random.default_rng(6)
    for bits in (1, 3, 5, 8, 11):
        pool = rng.integers(0, 256, (40, 4)).astype(np.uint8)
        image = pool[rng.integers(0, 40, 3000)].repeat(rng.integers(1, 9, 3000), axis=0)[:4320].reshape(-1, media.WIDTH, 4)
        assert (webp_lossless.decode(webp_lossless.encode(image, cache_bits=bits)) == image).all()


def test_new_words_of_many_texts_merge_together(both, monkeypatch):
    model, library = both
    rng = random.Random(9)
    letters = "abcdeghilmnorst-.0123456789ÄßéżΩЖ中文🙂\t\n"
    texts = ["", " ", "aaaa aaaa", "▁ ▁▁x"] + [" ".join("".join(rng.choices(letters, k=rng.randint(1, 60))) for _ in range(rng.randint(1, 80))) for _ in range(60)]
    tried = []
    merge = PieceModel._merge
    monkeypatch.setattr(PieceModel, "_merge", lambda self, segment: tried.append(len(segment)) or merge(self, segment))
    model.known.clear()
    got = [e[0].tolist() for e in model.encode_all(texts)]
    assert got == [library.encode(t, add_bos=True, add_eos=True) for t in texts]
    assert all(n > piece_model.SHORT for n in tried)  # words are merged by themselves only where they are long
    one = [model.encode(t) for t in texts]
    model.known.clear()
    for a, b in zip(model.encode_all(texts), one):
        assert all((x == y).all() for x, y in zip(a, b))


def test_copies_from_further_away():
    lengths = np.zeros(280, np.int64)
    lengths[[7, 9]], lengths[259] = 2, 1  # two literals, a copy of four pixels
    codes = webp_lossless.canonical(lengths)
    for symbol, want in ((0, [7, 9, 9, 7]), (1, [7, 7, 7, 7]), (3, [9, 9, 7, 9])):  # the row above, the left, above to the right
        out = webp_lossless.Writer()
        for value, size in ((0x2F, 8), (4 - 1, 14), (2 - 1, 14), (1, 1), (0, 3), (0, 1), (0, 1), (0, 1)):
            out.put(value, size)
        out.put_all(*webp_lossless._code_header(lengths))
        for field in (*ONE(1), *ONE(2), *ONE(255), *ONE(symbol)):
            out.put(*field)
        for s in (7, 9, 9, 7, 259):
            out.put(int(codes[s]), int(lengths[s]))
        data = out.data()
        data += bytes(len(data) & 1)
        got = webp_lossless.decode(b"RIFF" + (12 + len(data)).to_bytes(4, "little") + b"WEBPVP8L" + len(data).to_bytes(4, "little") + data)
        assert got[..., 1].tolist() == [[7, 9, 9, 7], want] and (got[..., [0, 2, 3]] == (1, 2, 255)).all()
