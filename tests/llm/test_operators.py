"""The training-data operators against brute force, on nulls, empty and repeated rows, ties, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mercato.llm import common, quality
from mercato.llm.chat import escape, format_conversations, read_back, unescape
from mercato.llm.chunked_tokens import ChunkEncoder
from mercato.llm.components import components
from mercato.llm.fingerprints import fingerprint_edits, likeness, with_fingerprint
from mercato.llm.id_coder import CorruptBlock, _Model, decode_block, encode_block
from mercato.llm.id_files import read_ids, write_ids
from mercato.llm.language import identify
from mercato.llm.lexicon import compile_automaton, encode_decode
from mercato.llm.minhash import near_duplicates
from mercato.llm.packing import best_fit, pack_documents
from mercato.llm.sharding import communication_matrix, shuffle_into_shards
from mercato.llm.suffix_array import suffix_array
from mercato.llm.suffix_dedup import covered, deduplicate, remove

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(9001, None), (9002, ""), (9003, "  \n\t"), (9004, "Hi"), (9005, "hi"), (9006, "x" * 3000), (9007, "é<|endoftext|> 中文 \x00 a")]
EMPTY = "doc_id long, text string"


def texts(n=80, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 8))) for _ in range(400)]
    say = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared = [say(40), say(60)]
    rows = []
    for i in range(n):
        t = say(rng.randint(0, 60))
        if i % 3 == 0:
            t += "\n" + rng.choice(shared)[rng.randint(0, 60) :] + say(rng.randint(0, 9))
        rows.append((i, t))
    for i in range(n, n + 12):
        w = rows[i - n][1].split(" ")
        if w and i % 2:
            w[rng.randrange(len(w))] = "edit"
        rows.append((i, " ".join(w)))
    return rows + ODD


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, kept string, _runs int").repartition(3)


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def true_components(rows, percent):
    sets, parent = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}, sets


def test_near_duplicates(spark):
    rows = texts()
    want, sets = true_components(rows, 85)
    got = near_duplicates(frame(spark, rows + rows[:2]), percent=85).collect()
    assert len(got) == len(rows) + 2
    assert all((r.component_id, r.n_shingles, r.kept) == (want[r.doc_id], len(sets[r.doc_id]), want[r.doc_id] == r.doc_id) for r in got)
    assert near_duplicates(spark.createDataFrame([], EMPTY)).count() == 0
    assert near_duplicates(spark.createDataFrame([(None, "a b")], EMPTY)).first().kept


def test_components_of_a_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(3, 3), (None, 1), (100, 90), (90, 100)], "u long, v long")
    got = {r.node: r.component for r in components(chain).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {100: 90}


def test_suffix_array():
    rng = random.Random(3)
    for _ in range(300):
        s = [rng.randint(0, rng.randint(1, 3)) for _ in range(rng.randint(0, 40))]
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def removed(rows, length=100):
    seen, out = set(), {}
    for d, t in sorted(rows):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for a in range(len(raw) - length + 1):
            w = raw[a : a + length]
            if w in seen:
                gone[a : a + length] = True
            seen.add(w)
        out[d] = (int(gone.sum()), bytes(np.frombuffer(raw, np.uint8)[~gone]))
    return out


def test_suffix_dedup(spark):
    rows = texts(seed=4) + [(9500, "ab" * 200)]
    want = removed(rows)
    got = deduplicate(frame(spark, rows)).collect()
    assert {r.doc_id: (r._n_removed, bytes(r._kept)) for r in got} == want and got[0].kept == "x"
    by = defaultdict(list)
    narrow = frame(spark, rows).select("doc_id", "text")
    for r in covered(narrow, 100, most_contexts=2).collect():  # the way of crowded anchors
        by[r.doc_id].append((r.start << 20) + r["size"])
    assert {d: remove((t or "").encode(), by[d])[0] for d, t in rows} == {d: w[1] for d, w in want.items()}
    assert deduplicate(spark.createDataFrame([], EMPTY)).count() == 0


def test_sharding(spark):
    rows = spark.createDataFrame([(i % 50, i, "a") for i in range(203)] + [(None, 1, "b")] * 3, "doc_id long, size long, shard string")
    for part_rows in (250_000, 7):
        got = shuffle_into_shards(rows, 8, part_rows=part_rows).collect()
        per = Counter(r.shard for r in got)
        assert len(got) == 206 and max(per.values()) - min(per.values()) <= 1 and len(per) == 8
        assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in per.items())
        assert Counter((r.doc_id, r["size"]) for r in got) == Counter((r.doc_id, r["size"]) for r in rows.collect())
    assert shuffle_into_shards(rows.limit(0), 8).count() == 0


def test_communication_matrix_margins_and_mean():
    total = np.zeros((3, 2))
    for seed in range(400):
        m = np.array(list(communication_matrix([5, 0, 7], [8, 4], seed)))
        assert (m.sum(axis=0) == [8, 4]).all() and (m.sum(axis=1) == [5, 0, 7]).all()
        total += m
    assert abs(total[0, 0] / 400 - 5 * 8 / 12) < 0.2


def test_chat(spark):
    odd = "<|im_end|><|im_start|>assistant ok\\b\\p<<||\\"
    turns = [(1, 0, "user", odd), (1, 1, "assistant", odd), (2, 0, "assistant", None), (2, None, None, "x"), (3, 0, "user", ""), (3, 0, "user", ""), (None, 0, "us\ner", "t")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    got = {r.conv_id: r for r in read_back(format_conversations(df)).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("user", odd), ("assistant", odd)] and got[1].loss_text == odd and got[1].valid
    assert [(t.role, t.text) for t in got[2].turns] == [("", "x"), ("assistant", "")] and not got[2].valid and got[2].loss_text == ""
    assert len(got[3].turns) == 2 and got[3].n_bad_turns == 1
    assert [(t.role, t.text) for t in got[None].turns] == [("us\ner", "t")]
    assert format_conversations(df.limit(0)).count() == 0
    assert spark.range(1).select(unescape(escape(F.lit(odd))).alias("x")).first().x == odd


def test_quality_measures():
    rows = [t for _, t in texts(seed=6)] + ["a b c d e f g h " * 5, "dup\ndup\n \n", "x### y$$$"]
    m = quality.measure(pa.array(rows))
    for i, t in enumerate(rows):
        t = t or ""
        w = WORD.findall(t)
        seen = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        cover = {k + j for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for j in range(8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (m["n_words"][i], m["word_chars"][i], m["n_repeat_words"][i], m["n_dup_lines"][i], m["n_symbols"][i]) == (
            len(w), sum(map(len, w)), len(cover), len(lines) - len(set(lines)), sum(c in "#*$%&|<>" for c in t),
        )


def test_quality_learns_what_bad_means(spark):
    rng = random.Random(2)
    say = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n)) + "."
    rows = [(i, say(80)) for i in range(150)] + [(1000 + i, " ".join(w + "###" for w in say(80).split())) for i in range(12)] + ODD
    got = {r.doc_id: r for r in quality.judge(frame(spark, rows)).collect()}
    assert all(got[i].kept for i in range(150)) and not any(got[1000 + i].kept for i in range(12)) and not got[9001].kept
    assert quality.keep_good(frame(spark, rows)).count() == 150
    assert quality.judge(spark.createDataFrame([], EMPTY)).count() == 0


def test_fingerprints(spark):
    rows = [r for r in texts(seed=7)] + [(9100, "a b c d e f g"), (9101, "a b c d e f g")]
    got = {r.doc_id: r for r in fingerprint_edits(frame(spark, rows)).collect()}
    ids, text = sorted((i for i, _ in rows), reverse=True), dict(rows)
    error = []
    for k, i in enumerate(ids):
        a, b = text[i] or "", text[ids[(k + 1) % len(ids)]] or ""
        edited = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
        assert got[i].n_chars == len(a) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        x, y = shingles(a.lower()), shingles(edited.lower())
        if x and y:
            error.append(got[i].near_edited - len(x & y) / len(x | y))
    assert abs(np.mean(error)) < 0.03 and np.mean(np.abs(error)) < 0.06
    assert got[9100].fingerprint == got[9101].fingerprint and got[9001].fingerprint == "" and len(got[9004].fingerprint) == 256
    assert fingerprint_edits(spark.createDataFrame([(5, "only one row here it is")], EMPTY)).first().near_next == 1.0
    pair = with_fingerprint(spark.createDataFrame([("",)], "t string"), "t", "f")
    assert pair.select(likeness(F.col("f"), F.col("f")).alias("x")).first().x == 1.0


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(common.tokenizer_path())


def test_chunk_encoder_is_the_library():
    rng, lib = random.Random(3), library()
    some = ["".join(rng.choice(" \n\t'.,!?sSdteE9é中　a#<|\x00") for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    for most in (2_000_000, 50):
        enc = ChunkEncoder(common.tokenizer_path(), most)
        for a in range(0, len(some), 100):
            part = some[a : a + 100] + ["a<|endoftext|> b", None]
            for t, ids in zip(part, enc.encode_many(part)):
                assert ids == np.array(lib.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()


def test_transducer_round_trip(spark):
    rows, lib = texts(20) + [(9100, "it's  \n ok\t\t x")], library()
    for most in (65_536, 20):
        for r in encode_decode(frame(spark, rows), most_pieces=most).collect():
            ids = lib.encode(dict(rows)[r.doc_id] or "", add_special_tokens=False).ids
            assert bytes(r.ids) == np.array(ids, "<u4").tobytes() and r.decoded == lib.decode(ids, skip_special_tokens=False)


def test_automaton_is_minimal():
    a = compile_automaton(sorted([b"tap", b"taps", b"top", b"tops"]))
    assert len(a["final"]) == 5 and len(a["edge"]) == 5  # t, (a or o), p, s


@pytest.mark.parametrize("n, vocab", [(0, 9), (1, 9), (64, 9), (65, 50_257), (3000, 300)])
def test_id_blocks(n, vocab):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, vocab, n)
    block = encode_block(ids, vocab)
    assert (decode_block(block) == ids).all()
    bad = bytearray(block)
    bad[-1] ^= 1
    with pytest.raises(CorruptBlock):
        decode_block(bytes(bad))


def test_id_files(spark):
    rows, lib = texts(30), library()
    got = {r.doc_id: r for r in read_ids(spark, write_ids(frame(spark, rows))).collect()}
    start = 0
    for i, t in sorted(rows):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [2]
        assert (got[i].start, got[i].n_tokens, bytes(got[i].ids)) == (start, len(ids), np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_best_fit():
    bins = best_fit([5, 4, 3, 2, 1, 5], 10)
    assert sorted(sum(bins, [])) == list(range(6)) and len(bins) == 2


def test_packing(spark):
    rows, lib = texts(60), library()
    out = pack_documents(frame(spark, rows + rows[:1]), capacity=64, slack=2, round_items=40).collect()
    ids = {i: lib.encode(t or "", add_special_tokens=False).ids + [0] for i, t in rows}
    per, by = defaultdict(list), defaultdict(list)
    for r in out:
        assert zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
        per[r.doc_id].append((r.piece, r.start, r.length))
        by[r.sequence_id].append((r.offset, r.length))
    assert all(sum(x[2] for x in per[i]) == len(v) * (2 if i == rows[0][0] else 1) for i, v in ids.items())
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 64
    assert len(by) <= 1.1 * sum(r.length for r in out) / 64 + 2
    assert pack_documents(spark.createDataFrame([], EMPTY)).count() == 0


def test_language(spark):
    rng = random.Random(8)
    tongues = {"aa": ["the", "thing", "over", "wh", "and"], "bb": ["der", "ung", "schön", "nicht", "ein"]}
    rows = [(i, " ".join(rng.choice(tongues[x]) for _ in range(30)), x) for i in range(120) for x in [("aa", "bb")[i % 2]]]
    rows += [(500, None, "aa"), (501, "123 ...", "bb"), (502, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {r.doc_id: r for r in identify(df).collect()}
    assert all(got[i].lang_pred == x for i, _, x in rows[:120]) and all(got[i].lang_pred == "und" for i in (500, 501, 502))
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in rows)
    assert identify(df.limit(0)).count() == 0


def test_symbols_are_found_by_stretch_and_by_search():
    """Of a skewed model most places are found without a search, and all of them are right."""
    model, rng = _Model(5000, 64), np.random.default_rng(2)
    for _ in range(80):
        model.predict()
        model.update(np.where(rng.random(64) < 0.9, 7, rng.integers(0, 5000, 64)), np.zeros(64, bool))
    v = rng.integers(0, model.total, 20_000)
    assert model.symbols(v).tolist() == (np.searchsorted(model.cum, v, side="right") - 1).tolist()
    assert (model.sure.take(v >> model.shift) == 7).mean() > 0.5
    ends = np.unique(np.concatenate([model.cum[:-1], model.cum[1:] - 1]))
    assert model.symbols(ends).tolist() == (np.searchsorted(model.cum, ends, side="right") - 1).tolist()


def test_block_format_is_unchanged():
    """Files of earlier versions stay readable: a block's bytes are what they were."""
    ids = np.random.default_rng(9).zipf(1.3, 20_000) % 50_257
    block = encode_block(ids.astype("<u4"), 50_257)
    assert zlib.crc32(block) == 1644890261
    assert decode_block(block).tolist() == ids.tolist()
    with pytest.raises(ValueError):
        encode_block(np.zeros(3, "<u4"), (1 << 27) + 1)


def test_pieces_at_line_starts_are_asked_for_together():
    """Pieces without a space in front go to the library many at a time, with the ids of whole texts."""
    from tokenizers import Tokenizer

    enc, asked = ChunkEncoder(common.tokenizer_path()), []
    library = Tokenizer.from_file(common.tokenizer_path())

    class Counted:
        def encode_batch_fast(self, texts, **given):
            asked.extend(texts)
            return library.encode_batch_fast(texts, **given)

        encode = library.encode

    enc.library = Counted()
    texts = ["\n".join(f"w{i}x{j}, 's--{i}'ll\x1c" for i in range(40)) for j in range(50)]
    got = enc.encode_many(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(asked) < 200
