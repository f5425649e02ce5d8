"""Whole-text ids by the tokenizers library, asked once for each distinct piece between safe cuts.

A byte-level BPE vocabulary splits a text by a fixed pattern before it merges. A space
that is followed by a character other than white space always begins a new split, so ids of
a text are the ids of its pieces, cut before every such space. Pieces repeat a great deal; each
worker keeps the ids of those it has met, in a bounded table.
"""

from __future__ import annotations

import os
import re
from array import array
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import common

_GLUED = re.compile(r" (?=\s|\Z)")
_LONG = 64
_MET = 1 << 22
_PLACES = 1 << 17
_MARKED = r"([\pL\pN])([.,;:!?*&%#$<>|()\-]+\n?|\n)"


def _space_start(piece: str) -> bool:
    return not piece or piece[0].isspace()


def cut(text: str) -> list[str]:
    """The pieces of a text, cut before every space that something other than white space follows."""
    first, *rest = text.split(" ")
    if not _GLUED.search(text):
        return [first, *(" " + p for p in rest)] if first else [" " + p for p in rest]
    out = [first]
    for p in rest:
        if _space_start(p):
            out[-1] += " " + p
        else:
            out.append(" " + p)
    return out if out[0] else out[1:]


def gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``values`` end to end. Places take eight bytes a value, so only ``_PLACES`` of them (or one run) are made at a time."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    out = np.empty(total, values.dtype)
    a = done = 0
    while done < total:
        b = max(a + 1, int(np.searchsorted(ends, done + _PLACES, side="right")))
        upto = int(ends[b - 1])
        out[done:upto] = values[np.repeat(starts[a:b] - (ends[a:b] - sizes[a:b]), sizes[a:b]) + np.arange(done, upto)]
        a, done = b, upto
    return out


class Split:
    """Texts in pieces: ``keys`` are distinct, ``pieces`` says which of them come, text by text from ``starts``.

    Texts whose white space may be glued to a word, and those with a NUL, are cut one by one (``cuts``, by text); those with a special
    string are left whole (``special``). Both have no ``pieces``. Null is empty.
    """

    def __init__(self, texts: pa.Array, specials: list[str]):
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        odd = pc.match_substring_regex(texts, r"\x00|[ \n](\s|\p{Z}|[\x0B\x1C-\x1F\x85]|\z)").to_numpy(zero_copy_only=False)
        special = np.zeros(len(texts), bool)
        for x in specials:
            special |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(odd | special), "", texts)
        # A split ends where marks or a line end follow a letter or digit, and behind a line end: more places that are safe to cut.
        marked = pc.replace_substring_regex(plain, _MARKED, "\\1 \0\\2")
        whole = [pa.scalar(x, pa.large_string()) for x in ("\0", "")]
        split = pc.split_pattern(pc.binary_join_element_wise(whole[0], pc.replace_substring(marked, "\n", "\n \0"), whole[1]), " ")
        coded = split.flatten().dictionary_encode()
        self.starts = split.offsets.to_numpy() - split.offsets[0].as_py()
        self.pieces = coded.indices.to_numpy(zero_copy_only=False)
        self.keys = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.special = {i: texts[i].as_py() for i in np.flatnonzero(special).tolist()}
        self.cuts = {i: ["\0" + p for p in cut(texts[i].as_py())] for i in np.flatnonzero(odd & ~special).tolist()}
        self.place = {}
        if self.cuts:
            self.place = {k: i for i, k in enumerate(self.keys)}
            for k in chain.from_iterable(self.cuts.values()):
                if k not in self.place:
                    self.place[k] = len(self.keys)
                    self.keys.append(k)


class Encoder:
    """Ids of whole texts from the ids of their pieces. ``learn`` gives the ids of distinct keys, ``whole`` those of a text with specials."""

    specials: list[str]

    def encode_flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text's begin, with the end. Null is empty."""
        s = Split(texts, self.specials)
        ids = self.learn(s.keys)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        begin = np.cumsum(size) - size
        values = np.frombuffer(b"".join(ids), "<u4")
        per_piece = size[s.pieces]
        before = np.concatenate([[0], np.cumsum(per_piece)])[s.starts]
        flat = gather(values, begin[s.pieces], per_piece)
        instead = {i: np.concatenate([values[begin[k] : begin[k] + size[k]] for k in map(s.place.__getitem__, c)] or [values[:0]]) for i, c in s.cuts.items()}
        instead |= {i: self.whole(text) for i, text in s.special.items()}
        if instead:
            rows = [instead[i] if i in instead else flat[before[i] : before[i + 1]] for i in range(len(texts))]
            flat = np.concatenate(rows)
            before = np.cumsum([0, *map(len, rows)])
        return flat, before

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        flat, at = self.encode_flat(pa.array(texts, pa.string()))
        raw, ends = flat.tobytes(), (4 * at).tolist()
        return [raw[a:b] for a, b in zip(ends, ends[1:])]


class ChunkEncoder(Encoder):
    """The library's ids, asked for once where pieces come again.

    At most ``most`` pieces stay known. A piece is kept when it comes a second time, so what occurs once takes no room; ``met`` is a
    table of marks by hash, in which a false mark only keeps a piece early.
    """

    def __init__(self, path: str, most: int = 500_000):
        from tokenizers import Tokenizer

        # A task has one core: the library's own threads, one a core in each worker, would only get into each other's way.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        vocab = self.library.get_vocab(with_added_tokens=True)
        self.bytes_of = np.zeros(max(vocab.values()) + 1, np.int64)  # a byte-level token has a character for each byte
        for token, i in vocab.items():
            self.bytes_of[i] = len(token)
        self.most, self.known, self.met = most, {}, np.zeros(_MET, bool)

    def _joined(self, words: list[str], glue: str = " ") -> list[bytes]:
        """Ids of ``glue`` + word for words without white space in front: 256 at a time are one text, whose ids are parted by their bytes."""
        out: list[bytes] = []
        for a in range(0, len(words), 65_536):
            part = words[a : a + 65_536]
            coded = self.library.encode_batch_fast([glue + glue.join(part[k : k + 256]) for k in range(0, len(part), 256)], add_special_tokens=False)
            flat = np.concatenate([np.array(e.ids, "<u4") for e in coded])
            ends = np.cumsum(pc.binary_length(pa.array(part)).to_numpy().astype(np.int64) + 1)
            upto = (4 * (np.searchsorted(np.cumsum(self.bytes_of[flat]), ends) + 1)).tolist()
            raw = flat.tobytes()
            out += [raw[x:y] for x, y in zip([0, *upto], upto)]
        return out

    def learn(self, wanted: list[str]) -> list[bytes]:
        """Ids of distinct keys. A key is a word without the one space before it, or a whole piece behind a NUL."""
        if len(self.known) > self.most:
            self.known.clear()
            self.met[:] = False
        out = list(map(self.known.get, wanted))
        new = [i for i, x in enumerate(out) if x is None]
        words = [i for i in new if wanted[i][:1] != "\0"]
        whole = [i for i in new if wanted[i][:1] == "\0"]
        ids = self._joined([wanted[i] for i in words])
        # A line end before a word is a split of its own and one id.
        plain = [i for i in whole if wanted[i][1:].split() == [wanted[i][1:]]]
        ids += [x[4:] for x in self._joined([wanted[i][1:] for i in plain], "\n")]
        rest = [i for i in whole if wanted[i][1:].split() != [wanted[i][1:]]]
        ids += [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast([wanted[i][1:] for i in rest], add_special_tokens=False)]
        whole = plain + rest
        names = [wanted[i] for i in (*words, *whole)]
        at = np.fromiter(map(hash, names), np.int64, len(names)) & (len(self.met) - 1)
        again = self.met[at] & (np.fromiter(map(len, names), np.int64, len(names)) <= _LONG)
        self.met[at] = True
        self.known.update(compress(zip(names, ids), again))
        for i, x in zip((*words, *whole), ids):
            out[i] = x
        return out

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")


def encoder(path: str) -> ChunkEncoder:
    """One per worker process and vocabulary, as long as one run of an operator lasts."""
    return common.held("encoder", path, lambda: ChunkEncoder(path))


def slices(batches, text: int = 1, most_bytes: int = 6 << 20):
    """Each batch in slices of at most ``most_bytes`` of text (or one row): few enough to hold, long enough for pieces to come again."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most_bytes, side="right")))
            yield batch.slice(a, b - a)
            common.release()
            a = b


def encoded(batches, path: str, end_id: int | None):
    """(id, ids with ``end_id`` behind them as uint32) of each row of batches with an id and a text."""
    enc = encoder(path)
    end = np.array([] if end_id is None else [end_id], "<u4")
    for part in slices(batches):
        flat, at = enc.encode_flat(part.column(1))
        for doc_id, a, b in zip(part.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist()):
            yield doc_id, np.concatenate([flat[a:b], end])
