"""BPE over a minimal acyclic transducer of frequent pieces, with exact merging of the rest.

The frequent pieces of the corpus are compiled into a minimal automaton: equal suffix languages share states, and each edge carries
an integer output, so the outputs along a piece's path sum to its rank among the pieces and the rank leads to its ids. The
automaton is four flat arrays in one file that workers map into memory. A batch's distinct pieces walk it together. Pieces
it does not have are split by the vocabulary's pattern and merged by rank.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from array import array
from collections import Counter
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .chunked_tokens import Encoder, Split, gather, slices


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in shown}
    extra = (b for b in range(256) if b not in set(shown))
    return out | {chr(256 + i): b for i, b in enumerate(extra)}


_NEVER = 1 << 30


class Merger:
    """The vocabulary: exact ids of any piece, and bytes of any id."""

    def __init__(self, path: str, pattern: str):
        import regex

        spec = json.loads(Path(path).read_text())
        back = byte_symbols()
        vocab = spec["model"]["vocab"]
        self.bytes = {i: bytes(back[c] for c in token) for token, i in vocab.items() if all(c in back for c in token)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes |= {i: t.encode() for t, i in self.special.items()}
        of = {b: i for i, b in self.bytes.items()}
        self.single = [of[bytes([b])] for b in range(256)]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.rank[vocab[a], vocab[b]] = (r, vocab[a + b])
        self.order = {p: r for p, (r, _) in self.rank.items()}
        self.made = {r: new for r, new in self.rank.values()}
        self.words = regex.compile(pattern).findall
        # The merges as arrays, by the pair: for many words at once.
        order = sorted((a << 20 | b, r, new) for (a, b), (r, new) in self.rank.items())
        self.pairs, self.ranks, self.news = (np.array(x, np.int64) for x in zip(*order))
        self.bytes_at = np.zeros(max(self.bytes) + 2, np.int64)
        for i, raw in self.bytes.items():
            self.bytes_at[i + 1] = len(raw)
        np.cumsum(self.bytes_at, out=self.bytes_at)
        self.all_bytes = np.frombuffer(b"".join(self.bytes.get(i, b"") for i in range(len(self.bytes_at) - 1)), np.uint8)

    def merge_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of single splits of at most 32 bytes: in each round every word merges its leftmost pair of the least rank."""
        out: list[bytes] = [b""] * len(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        for low, high in ((0, 8), (8, 16), (16, 32)):
            at = np.flatnonzero((size > low) & (size <= high))
            if not len(at):
                continue
            ids = np.full((len(at), high), -1, np.int64)
            ids[np.arange(high) < size[at][:, None]] = np.array(self.single)[np.frombuffer(b"".join([words[i] for i in at.tolist()]), np.uint8)]
            left, columns = np.arange(len(at)), np.arange(high - 1)
            while len(left):
                key = np.where(ids[:, 1:] >= 0, ids[:, :-1] << 20 | ids[:, 1:], -1)
                e = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
                rank = np.where(self.pairs[e] == key, self.ranks[e], _NEVER)
                j = rank.argmin(axis=1)
                rows = np.arange(len(j))
                going = rank[rows, j] < _NEVER
                ended = ~going
                count = (ids[ended] >= 0).sum(axis=1)
                flat = ids[ended]
                raw, ends = flat[flat >= 0].astype("<u4").tobytes(), (4 * np.cumsum(count)).tolist()
                for i, a, b in zip(at[left[ended]].tolist(), [0, *ends], ends):
                    out[i] = raw[a:b]
                ids[rows, j] = np.where(going, self.news[e[rows, j]], ids[rows, j])
                ids, j, left = ids[going], j[going], left[going]
                moved = np.take_along_axis(ids, columns + (columns > j[:, None]), axis=1)
                ids = np.concatenate([moved, np.full((len(ids), 1), -1, np.int64)], axis=1)
        return out

    def merge(self, word: bytes) -> list[int]:
        """Ids of one split. Merges only make pairs of later rank, so one merge at a time from the left is exact."""
        if len(word) > 256:
            return self._merge_long(word)
        single, get, made = self.single, self.order.get, self.made
        ids = [single[b] for b in word]
        ranks = [get(p, _NEVER) for p in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == _NEVER:
                break
            i = ranks.index(best)
            ids[i : i + 2] = [made[best]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), _NEVER)
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), _NEVER)
        return ids

    def _merge_long(self, word: bytes) -> list[int]:
        """All places of the best pair in one pass: few passes also over a very long split."""
        ids = [self.single[b] for b in word]
        rank = self.rank
        while len(ids) > 1:
            best = min((x for p in zip(ids, ids[1:]) if (x := rank.get(p))), default=None)
            if best is None:
                break
            new, out, i, n = best[1], [], 0, len(ids)
            while i < n:
                if i + 1 < n and rank.get((ids[i], ids[i + 1])) == best:
                    out.append(new)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def piece(self, text: str) -> bytes:
        words = [text] if text.removeprefix(" ").isalpha() else self.words(text)
        return array("I", [i for w in words for i in self.merge(w.encode())]).tobytes()


class _State:
    __slots__ = ("edges", "final")

    def __init__(self):
        self.edges: dict[int, _State] = {}
        self.final = False

    def key(self):
        return self.final, tuple((b, id(s)) for b, s in self.edges.items())


def compile_automaton(words: list[bytes]) -> dict[str, np.ndarray]:
    """Arrays of the minimal automaton of the words (sorted, distinct, not empty).

    ``edge``: ascending state * 256 + byte; ``to``, ``out``: the edge's target and output; ``final``: by state. State 0 is the start.
    """
    root, register = _State(), {}
    path: list[tuple[_State, int, _State]] = []  # the last word's states that may still change

    def freeze(upto: int) -> None:
        while len(path) > upto:
            parent, b, child = path.pop()
            parent.edges[b] = register.setdefault(child.key(), child)

    last = b""
    for w in words:
        common_len = len(os.path.commonprefix([last, w]))
        freeze(common_len)
        state = path[-1][2] if path else root
        for b in w[common_len:]:
            new = _State()
            state.edges[b] = new
            path.append((state, b, new))
            state = new
        state.final = True
        last = w
    freeze(0)

    number, order, count = {id(root): 0}, [root], {}
    for s in order:
        for t in s.edges.values():
            if id(t) not in number:
                number[id(t)] = len(order)
                order.append(t)

    def words_below(state: _State) -> int:
        stack = [state]
        while stack:
            s = stack[-1]
            wait = [t for t in s.edges.values() if id(t) not in count]
            if wait:
                stack.extend(wait)
            else:
                count[id(s)] = s.final + sum(count[id(t)] for t in s.edges.values())
                stack.pop()
        return count[id(state)]

    words_below(root)
    edge, to, out = [], [], []
    for k, s in enumerate(order):
        before = int(s.final)
        for b in sorted(s.edges):
            t = s.edges[b]
            edge.append(k * 256 + b)
            to.append(number[id(t)])
            out.append(before)
            before += count[id(t)]
    return {"edge": np.array(edge, np.int64), "to": np.array(to, np.int64), "out": np.array(out, np.int64), "final": np.array([s.final for s in order], np.int64)}


class Lexicon:
    """A memory-mapped automaton with the ids of its pieces; nothing of it is copied to the heap."""

    def __init__(self, file: str):
        raw = np.load(file, mmap_mode="r")
        head = raw[:6].tolist()
        parts, at = [], 6
        for n in head:
            parts.append(raw[at : at + n])
            at += n
        self.edge, self.to, self.out, self.final, self.starts, packed = parts
        self.ids = packed.view("<u4")  # two in a 64-bit number

    @staticmethod
    def write(file: str, words: list[bytes], ids: list[bytes]) -> None:
        a = compile_automaton(words)
        flat = b"".join(ids)
        packed = np.frombuffer(flat + b"\0" * (-len(flat) % 8), "<i8")
        parts = [a["edge"], a["to"], a["out"], a["final"], np.cumsum([0] + [len(i) // 4 for i in ids]), packed]
        np.save(file, np.concatenate([np.array([len(p) for p in parts], np.int64), *parts]))

    def ids_of(self, ranks: np.ndarray) -> list[bytes]:
        """The ids of pieces by rank, as little-endian unsigned 32-bit integers."""
        begin = self.starts[ranks]
        sizes = self.starts[ranks + 1] - begin
        raw, ends = gather(self.ids, begin, sizes).tobytes(), (4 * np.cumsum(sizes)).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]

    def ranks(self, pieces: list[bytes]) -> np.ndarray:
        """Each piece's rank, or -1; all pieces take a step at once."""
        n = len(pieces)
        size = np.fromiter(map(len, pieces), np.int64, n)
        text = np.frombuffer(b"".join(pieces), np.uint8)
        begin = np.cumsum(size) - size
        rank, state = np.zeros(n, np.int64), np.zeros(n, np.int64)
        alive, step = np.flatnonzero(size), 0
        rank[size == 0] = -1
        if not len(self.edge):
            return np.full(n, -1)
        while len(alive):
            key = state[alive] * 256 + text[begin[alive] + step]
            e = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
            ok = self.edge[e] == key
            rank[alive[~ok]] = -1
            alive, e = alive[ok], e[ok]
            state[alive] = self.to[e]
            rank[alive] += self.out[e]
            step += 1
            end = size[alive] == step
            done = alive[end]
            rank[done[self.final[state[done]] == 0]] = -1
            alive = alive[~end]
        return rank


class LexiconEncoder(Encoder):
    """Pieces by the automaton; the others are merged. At most ``most`` merged ones are kept, those that come a second time."""

    def __init__(self, lexicon: Lexicon, merger: Merger, most: int = 300_000):
        self.lexicon, self.merger, self.most, self.merged = lexicon, merger, most, {}
        self.specials, self.met = list(merger.special), np.zeros(1 << 22, bool)

    def learn(self, wanted: list[str]) -> list[bytes]:
        if len(self.merged) > self.most:
            self.merged.clear()
            self.met[:] = False
        raw = [(k[1:] if k[:1] == "\0" else " " + k).encode() for k in wanted]
        ranks = self.lexicon.ranks(raw)
        there = np.flatnonzero(ranks >= 0)
        out: list[bytes | None] = list(map(self.merged.get, wanted))
        for i, x in zip(there.tolist(), self.lexicon.ids_of(ranks[there])):
            out[i] = x
        rest = [i for i, x in enumerate(out) if x is None]
        words = [i for i in rest if len(raw[i]) <= 32 and wanted[i].removeprefix("\0").isalpha()]  # one split each
        for i, x in zip(words, self.merger.merge_words([raw[i] for i in words])):
            out[i] = x
        for i in rest:
            if out[i] is None:
                out[i] = self.merger.piece(raw[i].decode())
            at = hash(wanted[i]) & (len(self.met) - 1)
            if self.met[at] and len(raw[i]) <= 64:
                self.merged[wanted[i]] = out[i]
            self.met[at] = True
        return out

    def whole(self, text: str) -> np.ndarray:
        """Special strings in a text are one id each, as in the library; what lies between is encoded alone."""
        special, out = self.merger.special, []
        while text:
            at, which = min(((text.find(s), s) for s in special if s in text), default=(-1, ""))
            out.append(self.merger.piece(text if at < 0 else text[:at]))
            if at < 0:
                break
            out.append(np.uint32(special[which]).tobytes())
            text = text[at + len(which) :]
        return np.frombuffer(b"".join(out), "<u4")

    def decode_flat(self, flat: np.ndarray, at: np.ndarray) -> list[str]:
        """The texts of ids that lie end to end; bytes that are no UTF-8 become U+FFFD, as in the library."""
        begin = self.merger.bytes_at[flat]
        sizes = self.merger.bytes_at[flat + 1] - begin
        raw, ends = gather(self.merger.all_bytes, begin, sizes).tobytes(), np.concatenate([[0], np.cumsum(sizes)])[at].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:])]


def frequent_pieces(docs: DataFrame, text_col: str, most: int, specials: list[str]) -> list[str]:
    """Keys of the commonest pieces of all texts, at most ``most`` of those that occur more than once.

    Counts cover every text. How often a piece must occur follows from a histogram of the counts, in sixteenths of a power of two, so the
    driver gets its few rows and the pieces above that bound, and of those at the bound as many as make ``most``.
    """
    run_id = common.new_run()

    def count(batches):
        common.only(run_id)
        seen: Counter = Counter()

        def rows():
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["piece", "n"])
            seen.clear()
            return out

        for part in slices(batches, 0):
            s = Split(part.column(0), specials)
            seen.update(dict(zip(s.keys, np.bincount(s.pieces, minlength=len(s.keys)).tolist())))
            seen.update(chain.from_iterable(s.cuts.values()))
            if len(seen) > 300_000:
                yield rows()
        yield rows()

    spark = docs.sparkSession
    counts = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "piece string, n long").where(F.length("piece") <= 64)
    path = common.write_table(counts.groupBy("piece").agg(F.sum("n").alias("n")).where("n > 1").withColumn("level", F.floor(F.log2("n") * 16).cast("int")), "pieces")
    kept = spark.read.schema("piece string, n long, level int").parquet(path)
    levels = sorted(((r["level"], r["count"]) for r in kept.groupBy("level").count().collect()), reverse=True)
    total = np.cumsum([n for _, n in levels])
    enough = int(np.searchsorted(total, most, side="right"))  # so many of the highest levels fit
    wanted = kept.where(F.col("level") >= levels[enough - 1][0]).select("piece") if enough else kept.limit(0).select("piece")
    if enough < len(levels):  # the next level fills what is left, its pieces in the order of a hash
        rest = most - int(total[enough - 1] if enough else 0)
        wanted = wanted.unionByName(kept.where(F.col("level") == levels[enough][0]).orderBy(F.xxhash64("piece"), "piece").limit(rest).select("piece"))
    out = sorted(r["piece"] for r in wanted.collect())
    common.drop_table(spark, path)
    return out


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, pattern: str | None = None, most_pieces: int = 65_536) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit), decoded (string) for each row of ``docs``.

    Ids are those of the tokenizers library for the same vocabulary without special tokens added; special strings in a text are
    their id. A null text is empty. ``most_pieces`` bounds the automaton; pieces beyond it are merged, with the same ids.
    Repeated rows get equal results, an empty table none; null ids stay; other columns are not read. Of merges of one rank the leftmost comes
    first. A text of any length is read whole, in its task's memory; the time of one split without a place to cut grows with its square.
    """
    import public_tokenizers

    spark = docs.sparkSession
    common.ship(spark)
    path, pattern = tokenizer or common.tokenizer_path(), pattern or public_tokenizers.PATTERN
    merger = Merger(path, pattern)
    keys = frequent_pieces(docs, text_col, most_pieces, list(merger.special))
    words = sorted({w for k in keys if (w := (k[1:] if k[:1] == "\0" else " " + k).encode()) and not any(s.encode() in w for s in merger.special)})
    name = f"lexicon-{uuid.uuid4().hex}.npy"
    local = Path(tempfile.mkdtemp(prefix="mercato-lexicon-")) / name
    Lexicon.write(str(local), words, [merger.piece(w.decode()) for w in words])
    spark.sparkContext.addFile(str(local))  # the driver serves it; every executor gets a copy of its own to map

    run_id = common.new_run()

    def run(batches):
        common.only(run_id)
        enc = common.held("lexicon", name, lambda: LexiconEncoder(Lexicon(SparkFiles.get(name)), Merger(path, pattern)))
        for part in slices(batches, most_bytes=4 << 20):
            flat, at = enc.encode_flat(part.column(1))
            raw, ends = flat.tobytes(), (4 * at).tolist()
            ids = pa.array([raw[a:b] for a, b in zip(ends, ends[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), ids, pa.array(enc.decode_flat(flat, at), pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids binary, decoded string")
