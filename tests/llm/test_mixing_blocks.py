"""The second block format: round trips, damage, size and time against the first format and zlib."""

import io
import time
import zlib

import numpy as np
import pytest

from mercato.llm import id_files, mixing_blocks
from mercato.llm.id_coder import CorruptBlock, decode_block, encode_block


def prose(n, seed=5):
    """Ids of words of a skewed vocabulary, in sentences that partly come again."""
    rng = np.random.default_rng(seed)
    said = rng.zipf(1.2, (400, 12)) % 3000
    return np.concatenate([np.where(rng.random((n // 12 + 1, 12)) < 0.6, said[rng.integers(0, 400, n // 12 + 1)], rng.zipf(1.2, (n // 12 + 1, 12)) % 3000)]).ravel()[:n].astype("<u4")


#: With 150,000 different ids a rare id's number has more than 16 bits; 40,000 of one id leave it all but one part.
@pytest.mark.parametrize("n, vocab", [(0, 9), (1, 9), (64, 9), (65, 50_257), (3000, 300), (40_000, 1), (200_000, 50_257), (150_000, 1 << 27)])
def test_round_trip(n, vocab):
    ids = np.random.default_rng(n).integers(0, vocab, n)
    block = mixing_blocks.encode(ids, vocab)
    assert mixing_blocks.decode(block).tolist() == ids.tolist()
    for at in (-1, len(block) // 2):
        bad = bytearray(block)
        bad[at] ^= 1
        with pytest.raises(CorruptBlock):
            mixing_blocks.decode(bytes(bad))


def test_round_trip_of_skewed_ids():
    rng = np.random.default_rng(7)
    for ids in (prose(100_000), rng.zipf(1.3, 50_000) % 50_257, np.where(rng.random(50_000) < 0.999, 7, 8), np.repeat(np.arange(500), 90)):
        assert mixing_blocks.decode(mixing_blocks.encode(ids, 50_257)).tolist() == ids.tolist()
    with pytest.raises(ValueError):
        mixing_blocks.encode(np.zeros(3, "<u4"), (1 << 27) + 1)


@pytest.mark.parametrize("n", [20_000, 1 << 18])
def test_blocks_are_smaller_than_before(n):
    ids = prose(n)
    assert len(mixing_blocks.encode(ids, 50_257)) < 0.95 * len(encode_block(ids, 50_257))


def test_files_of_earlier_versions_stay_readable():
    ids, docs = prose(5000), np.array([(4, True, 3000), (9, True, 2000)], id_files._DOC)
    block, footer = encode_block(ids, 50_257), zlib.compress(docs.tobytes())
    whole = block + footer + id_files.TAIL.pack(len(block), len(footer), zlib.crc32(footer), b"CMRF")

    class Source(io.BytesIO):
        def size(self):
            return len(whole)

    got = [(i, x.tolist()) for i, x in id_files.read_file(Source(whole))]
    assert got == [(4, ids[:3000].tolist()), (9, ids[3000:].tolist())]


def test_files_take_less_time_than_the_first_format():
    """CPU seconds to write and read a file's ids, side by side on this machine."""
    ids = prose(1 << 19)

    class Source(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    def by_file():
        out = io.BytesIO()
        id_files.write_file(out, [(1, ids)], 50_257)
        assert [len(x) for _, x in id_files.read_file(Source(out.getvalue()))] == [len(ids)]

    took = {}
    for _ in range(4):
        for name, f in (("first", lambda: decode_block(encode_block(ids, 50_257))), ("files", by_file)):
            began = time.process_time()
            f()
            took[name] = min(took.get(name, 1e9), time.process_time() - began)
    assert took["files"] < 0.8 * took["first"]
