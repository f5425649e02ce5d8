"""Ids of merge-type piece vocabularies (sentencepiece) by a score-ordered agenda of adjacent symbol pairs.

A text becomes U+2581 for each space, one more in front, and is cut where no piece of the vocabulary goes across: before a space that
something else precedes and around characters that no piece holds. Each distinct part is segmented once: its symbols are characters
to begin with, the agenda holds the adjacent pairs that are pieces, the best score first and of equal scores the leftmost; a
merge puts the pairs with its neighbours on the agenda. Characters without a piece become their bytes. What a worker learns from an Arrow
batch is encoded by the library too and has to be equal.
"""

from __future__ import annotations

import re
from array import array
from heapq import heapify, heappop, heappush
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .chunked_tokens import gather, slices

SPACE = "▁"
#: Marks that may follow a word.
MARKS = ".,;:!?*&%#$<>|()-"
_WIDE, _LONG, _NEVER = 32, 64, 1 << 30
_CELLS = 1 << 18  # symbols that go on together
_OTHER = 1 << 19  # symbols from here on are characters without a piece
_NONE = (1 << 21) - 1
_MET = 1 << 22


class Vocabulary:
    """Pieces, the order of their scores and their bytes, from a model file."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = lib = SentencePieceProcessor(model_file=path)
        every = range(lib.get_piece_size())
        self.unknown, self.end = lib.unk_id(), lib.eos_id()
        self.byte = {int(lib.id_to_piece(i)[3:5], 16): i for i in every if lib.is_byte(i)}
        self.ids = {lib.id_to_piece(i): i for i in every if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i))}
        if len(self.byte) != 256 or any(lib.is_unused(i) for i in every):
            raise ValueError(f"not a merge vocabulary with byte fallback: {path}")
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError(f"pieces go across words: {path}")
        scores = {p: lib.get_score(i) for p, i in self.ids.items()}
        places = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = {p: places[s] for p, s in scores.items() if len(p) > 1}
        self.symbol = np.arange(0x110000, dtype=np.int32) + _OTHER
        for p, i in self.ids.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        one = {p: i for p, i in self.ids.items()}
        alone = {c: _OTHER + ord(c) for p in self.rank for c in p if c not in one}
        halves = {(one.get(p[:k], alone.get(p[:k])), one.get(p[k:], alone.get(p[k:]))): p for p in self.rank for k in range(1, len(p))}
        order = sorted((a << 21 | b, self.rank[p], self.ids[p]) for (a, b), p in halves.items() if a is not None and b is not None)
        self.pairs, ranks, self.made = (np.array([*x, last], np.int64) for x, last in zip(zip(*order), (1 << 62, _NEVER, _NONE)))
        self.rank_at, self.made = ranks.astype(np.int32), self.made.astype(np.int32)
        raw = [b""] * len(every)
        for p, i in self.ids.items():
            raw[i] = p.replace(SPACE, " ").encode()
        for b, i in self.byte.items():
            raw[i] = bytes([b])
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.bytes_of = np.array([len(r) for r in raw], np.int64)  # bytes of the text that a token stands for
        self.at = np.cumsum(self.bytes_of) - self.bytes_of
        # A text is also cut before a mark behind a letter, and behind a line end, if no piece goes across.
        self.marks = [m for m in MARKS if not any(x[-1:].isalpha() for p in self.ids for x in p.split(m)[:-1])]
        self.lines = not any("\n" in p for p in self.ids)

    def merged(self, part: str) -> list[str]:
        """The symbols that are left when no two neighbours are a piece: one part, its agenda a heap of rank and place."""
        rank, symbols, n = self.rank, list(part), len(part)
        agenda = []
        for i in range(n - 1):
            r = rank.get(symbols[i] + symbols[i + 1])
            if r is not None:
                agenda.append(r << 32 | i)
        heapify(agenda)
        behind, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while agenda:
            x = heappop(agenda)
            i = x & 0xFFFFFFFF
            j = behind[i]
            if j >= n or not symbols[i]:
                continue
            both = symbols[i] + symbols[j]
            if rank.get(both) != x >> 32:  # one of the two has grown since
                continue
            symbols[i], symbols[j] = both, ""
            k = behind[i] = behind[j]
            if k < n:
                before[k] = i
                r = rank.get(both + symbols[k])
                if r is not None:
                    heappush(agenda, r << 32 | i)
            h = before[i]
            if h >= 0:
                r = rank.get(symbols[h] + both)
                if r is not None:
                    heappush(agenda, r << 32 | h)
        return [s for s in symbols if s]

    def segment(self, part: str) -> list[int]:
        """Ids of one part; a symbol without a piece is its bytes."""
        out: list[int] = []
        for s in self.merged(part):
            if s in self.ids:
                out.append(self.ids[s])
            else:
                out.extend(map(self.byte.__getitem__, s.encode()))
        return out

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of each pair in ``pairs``; the last place is of no pair."""
        key = left.astype(np.int64) << 21 | right
        at = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[at] == key, at, len(self.pairs) - 1).astype(np.int32)

    def segment_many(self, parts: list[str]) -> list[bytes]:
        """Ids of parts as little-endian unsigned 32-bit integers. Short parts go on together.

        A row holds a part's symbols, another its agenda, the ranks of its adjacent pairs: in each round every part merges its best pair,
        of equal ones the leftmost.
        """
        out = [b""] * len(parts)
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        for i in np.flatnonzero(size > _WIDE).tolist():
            out[i] = array("I", self.segment(parts[i])).tobytes()
        for low, wide in ((0, 6), (6, 12), (12, 20), (20, _WIDE)):
            todo = np.flatnonzero((size > low) & (size <= wide))
            rows = _CELLS // wide
            for a in range(0, len(todo), rows):
                some = todo[a : a + rows]
                for i, x in zip(some.tolist(), self._together([parts[i] for i in some.tolist()], size[some], wide)):
                    out[i] = x
        return out

    def _together(self, parts: list[str], size: np.ndarray, wide: int) -> list[bytes]:
        points = np.frombuffer("".join(parts).encode("utf-32-le"), "<u4")
        symbols = np.full((len(parts), wide + 1), _NONE, np.int32)  # one column of nothing at the end
        symbols[np.arange(wide + 1) < size[:, None]] = self.symbol[points]
        agenda = self.rank_at[self._ranks(symbols[:, :-1], symbols[:, 1:])]
        row, each = np.arange(len(parts)), np.arange(wide)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(row):
            best = agenda.argmin(axis=1)
            here = np.arange(len(best))
            going = agenda[here, best] != _NEVER
            if not going.all():
                done.append((row[~going], symbols[~going]))
                row, symbols, agenda, best = row[going], symbols[going], agenda[going], best[going]
                here = here[: len(best)]
            if not len(row):
                break
            new = self.made[self._ranks(symbols[here, best], symbols[here, best + 1])]
            symbols[here, best] = new
            behind = np.minimum(each + (each > best[:, None]), wide)  # what stands behind the pair moves one to the left
            symbols[:, :wide] = np.take_along_axis(symbols, behind, axis=1)
            symbols[:, wide] = _NONE
            agenda = np.take_along_axis(agenda, np.minimum(each + (each > best[:, None]), wide - 1), axis=1)
            agenda[here, best] = self.rank_at[self._ranks(new, symbols[here, best + 1])]
            left = np.flatnonzero(best)
            agenda[left, best[left] - 1] = self.rank_at[self._ranks(symbols[left, best[left] - 1], new[left])]
        rows = np.concatenate([r for r, _ in done]) if done else row
        last = np.concatenate([s for _, s in done]) if done else symbols
        flat = last[last != _NONE]
        ends = np.cumsum((last != _NONE).sum(axis=1))
        known = flat < _OTHER
        if known.all():
            ids, upto = flat, ends
        else:  # characters without a piece
            spelled = [[i] if i < _OTHER else [self.byte[b] for b in chr(i - _OTHER).encode()] for i in flat.tolist()]
            ids = np.array([i for x in spelled for i in x], np.int64)
            upto = np.cumsum([len(x) for x in spelled])[ends - 1]
        raw, cuts = ids.astype("<u4").tobytes(), (4 * upto).tolist()
        out = [b""] * len(parts)
        for i, x, y in zip(rows.tolist(), [0, *cuts], cuts):
            out[i] = raw[x:y]
        return out

    def by_library(self, parts: list[str]) -> list[list[int]]:
        """The library's ids of parts. It puts a space in front, so a part's own first one is left out, or a line end is put before it."""
        head = len(self.library.encode("\n"))
        ids = self.library.encode([p[1:] if p[0] == SPACE else "\n" + p for p in parts], num_threads=1)
        return [[self.ids[SPACE]] if p == SPACE else i if p[0] == SPACE else i[head:] for p, i in zip(parts, ids)]


class PieceEncoder:
    """Ids of whole texts. Parts that have come twice are known, at most ``most`` of them.

    ``met`` marks by hash what has come once; a false mark only keeps a part early.
    """

    def __init__(self, path: str, most: int = 600_000):
        v = self.vocabulary = Vocabulary(path)
        self.most, self.known, self.met = most, {}, np.zeros(_MET, bool)
        self.marked = r"(\pL)([" + "".join("\\" + m for m in v.marks) + "])" if v.marks else ""
        self.cuts = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n" if v.lines else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+").findall

    def learn(self, parts: list[str]) -> list[bytes]:
        """Ids of distinct parts by the agenda; those that are not known have to be the library's."""
        if len(self.known) > self.most:
            self.known.clear()
            self.met[:] = False
        out = list(map(self.known.get, parts))
        new = [i for i, x in enumerate(out) if x is None]
        fresh = [parts[i] for i in new]
        ids = self.vocabulary.segment_many(fresh)
        if ids != [array("I", i).tobytes() for i in self.vocabulary.by_library(fresh)]:
            raise AssertionError("the agenda and the library differ on a part of a text")
        at = np.fromiter(map(hash, fresh), np.int64, len(fresh)) & (_MET - 1)
        again = self.met[at] & (np.fromiter(map(len, fresh), np.int64, len(fresh)) <= _LONG)
        self.met[at] = True
        self.known.update(compress(zip(fresh, ids), again.tolist()))
        for i, x in zip(new, ids):
            out[i] = x
        return out

    def encode_flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text's begin, with the end. Null is empty.

        A key is what stands between two single spaces, and stands for a space and itself, or for itself without the NUL in front. Texts
        with several spaces in a row, U+2581 or NUL are cut one by one.
        """
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        odd = pc.match_substring_regex(texts, r"\x00|\x{2581}|  |\A ").to_numpy(zero_copy_only=False)
        empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(odd), "", texts)
        if self.marked:
            plain = pc.replace_substring_regex(plain, self.marked, "\\1 \0\\2")
        if self.vocabulary.lines:
            plain = pc.replace_substring(plain, "\n", "\n \0")
        split = pc.split_pattern(plain, " ")
        coded = split.flatten().dictionary_encode()
        starts = split.offsets.to_numpy() - split.offsets[0].as_py()
        pieces = coded.indices.to_numpy(zero_copy_only=False)
        parts = [k[1:] if k[:1] == "\0" else SPACE + k for k in coded.dictionary.to_numpy(zero_copy_only=False).tolist()]
        nothing = parts.index("") if "" in parts else None
        if nothing is not None:
            parts[nothing] = "\n"  # any part: its size becomes 0
        first = len(parts)
        cuts = {i: self.cuts(SPACE + texts[i].as_py().replace(" ", SPACE)) for i in np.flatnonzero(odd).tolist()}
        place = {k: first + i for i, k in enumerate(dict.fromkeys(chain.from_iterable(cuts.values())))}
        ids = self.learn([*parts, *place])
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        begin = np.cumsum(size) - size
        values = np.frombuffer(b"".join(ids), "<u4")
        if nothing is not None:
            size[nothing] = 0
        per_piece = size[pieces]
        before = np.concatenate([[0], np.cumsum(per_piece)])[starts]
        flat = gather(values, begin[pieces], per_piece)
        if not (odd.any() or empty.any()):
            return flat, before
        rows = [flat[a:b] for a, b in zip(before, before[1:])]
        for i, c in cuts.items():
            rows[i] = np.frombuffer(b"".join(ids[place[k]] for k in c), "<u4")
        for i in np.flatnonzero(empty).tolist():
            rows[i] = values[:0]
        return np.concatenate(rows), np.cumsum([0, *map(len, rows)])

    def decode_flat(self, ids: np.ndarray, at: np.ndarray) -> list[str]:
        """The library's decoding of each run of ids (``at``: where they begin, with the end)."""
        v = self.vocabulary
        size = v.bytes_of[ids]
        raw = gather(v.raw, v.at[ids], size).tobytes()
        ends = np.concatenate([[0], np.cumsum(size)])[at].tolist()
        unknown = set(np.searchsorted(at, np.flatnonzero(ids == v.unknown), side="right").tolist())
        out = []
        for k, (a, b) in enumerate(zip(ends, ends[1:])):
            try:
                if k + 1 in unknown:
                    raise UnicodeError
                text = raw[a:b].decode()
                out.append(text[1:] if text[:1] == " " else text)
            except UnicodeError:  # ids that no text has
                out.append(v.library.decode(ids[at[k] : at[k + 1]].tolist()))
        return out


def encoder(path: str) -> PieceEncoder:
    """One per worker process and vocabulary, as long as one run of an operator lasts."""
    return common.held("pieces", path, lambda: PieceEncoder(path))


def _encode(path: str, run_id: str, ends: bool):
    def run(batches):
        common.only(run_id)
        enc = encoder(path)
        end = [enc.vocabulary.end] if ends else []
        for part in slices(batches):
            flat, at = enc.encode_flat(part.column(1))
            decoded = enc.decode_flat(flat, at)
            if end:
                flat, at = np.insert(flat, at[1:], end[0]), at + np.arange(len(at))
            ids = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat.view("<i4"), pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column(0), ids, pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])

    return run


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end: bool = True) -> DataFrame:
    """doc_id, ids (array of int, the end id last if ``end``), decoded: each whole text's ids and what they decode to.

    One row for each row, whatever its id: repeated rows and equal texts get equal ids, null ids stay, and a null text is empty (the end
    id alone, decoded to the empty text). Ties of scores go to the leftmost pair. An empty table gives no rows; further columns are left
    out. A text of any length is read whole, in a task whose memory is about twenty times the text, or three hundred times
    its longest part without a space or line end.
    """
    common.ship(docs.sparkSession)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(_encode(path or common.tokenizer_path("piece_bpe_32k.model"), common.new_run(), end), "doc_id long, ids array<int>, decoded string")
