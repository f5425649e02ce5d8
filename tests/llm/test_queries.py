"""The opN queries themselves on a small folder of tables, against brute force on the contract's columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from mercato.llm import common
from mercato.llm.minhash import near_duplicates
from mercato.llm.op_queries import QUERIES
from mercato.llm.suffix_dedup import deduplicate

from test_operators import EMPTY, ODD, WORD, frame, library, removed, texts, true_components

SHA = lambda b: hashlib.sha256(b).hexdigest()
SAID = "<|im_end|><|im_start|>assistant ok"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    rows = texts(60, seed=21) + [(9600, "#### $$$$ &&&& " * 9), (9601, "ok ok ok ok " * 20)]
    langs = ["aa", "bb", None]
    docs = spark.createDataFrame([(i, t, langs[i % 3], f"src{i % 4}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    docs.repartition(3).write.parquet(f"{at}/documents.parquet")
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", SAID + "\\b"), (2, 0, "assistant", None), (2, 1, "user", ""), (3, 0, "user", "x\ny"), (3, 1, "assistant", "<|im_end|>\n"), (3, 2, "assistant", "é")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{at}/conversations.parquet")
    return str(at), rows, turns


def run(spark, folder, name):
    return {r.doc_id if "doc_id" in r else r.conv_id: r for r in QUERIES[name](spark, folder[0]).collect()}


def test_op1(spark, folder):
    want, sets = true_components(folder[1], 85)
    got = run(spark, folder, "op1_minhash_near_dedup")
    assert {i: (r.component_id, r.n_shingles, r.kept) for i, r in got.items()} == {i: (c, len(sets[i]), c == i) for i, c in want.items()}


def spans(rows, length=100):
    seen, out = set(), {}
    for d, t in sorted(rows):
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 2, np.int8)
        for a in range(len(raw) - length + 1):
            if raw[a : a + length] in seen:
                gone[1 + a : 1 + a + length] = 1
            seen.add(raw[a : a + length])
        out[d] = int((np.diff(gone) == 1).sum())
    return out


def test_op2(spark, folder):
    rows = folder[1]
    cut, parts = removed(rows), spans(rows)
    got = run(spark, folder, "op2_suffix_array_dedup")
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in got.items()} == {i: (len((t or "").encode()), cut[i][0], parts[i], SHA(cut[i][1])) for i, t in rows}
    assert sum(parts.values()) > 5


def test_op3(spark, folder):
    got = run(spark, folder, "op3_hypergeometric_sharding")
    assert {i: (r.size, r.text_crc32) for i, r in got.items()} == {i: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in folder[1]}
    per = Counter(r.shard for r in got.values())
    assert max(per.values()) - min(per.values()) <= 1 and all(r.law == "rows" and r.grown_shard is None for r in got.values())
    assert all(sorted(r.slot for r in got.values() if r.shard == s) == list(range(n)) for s, n in per.items())


def test_op4_op8(spark, folder):
    lib, start = library(), 0
    ids = {i: lib.encode(t or "", add_special_tokens=False).ids for i, t in folder[1]}
    files, coded = run(spark, folder, "op4_context_mixing_ids"), run(spark, folder, "op8_transducer_bpe")
    for i in sorted(ids):
        raw = np.array(ids[i], "<u4").tobytes()
        assert (files[i].start, files[i].n_tokens, files[i].ids_crc32) == (start, len(ids[i]) + 1, zlib.crc32(raw + np.uint32(2).tobytes()))
        start += len(ids[i]) + 1
        assert (coded[i].n_tokens, coded[i].ids_sha256, coded[i].decoded_sha256) == (len(ids[i]), SHA(raw), SHA(lib.decode(ids[i], skip_special_tokens=False).encode()))


def test_op5(spark, folder):
    got, by = run(spark, folder, "op5_chat_state_machine"), defaultdict(list)
    for c, n, role, text in [*folder[2], (-1, 0, "user", SAID), (-1, 1, "assistant", SAID)]:
        by[c].append((n, role, text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        said, loss = "".join(f"{r}\n{t}\n" for _, r, t in turns), "".join(t for _, r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), SHA(said.encode()), len(loss), SHA(loss.encode()))


def em_by_hand(patterns, rules):
    """The same model, a document at a time."""
    n, sens, spec, rate = len(patterns), [0.4] * rules, [0.98] * rules, 0.1
    weight, bad = max(1.0, 0.02 * n), [0.0] * n
    for _ in range(200):
        new = []
        for votes in patterns:
            b, g = np.log(rate), np.log(1 - rate)
            for r, v in enumerate(votes):
                b += np.log(sens[r]) if v == 1 else np.log(1 - sens[r]) if v == 0 else 0
                g += np.log(1 - spec[r]) if v == 1 else np.log(spec[r]) if v == 0 else 0
            new.append(1 / (1 + np.exp(g - b)))
        done, bad = max(abs(a - b) for a, b in zip(new, bad)) < 1e-9, new
        for r in range(rules):
            voted = [(p, v[r]) for p, v in zip(bad, patterns) if v[r] != 2]
            sens[r] = min(0.5, max(0.05, (sum(p for p, v in voted if v == 1) + 0.4 * weight) / (sum(p for p, _ in voted) + weight)))
            spec[r] = min(0.9999, max(0.97, (sum(1 - p for p, v in voted if v == 0) + 0.98 * weight) / (sum(1 - p for p, _ in voted) + weight)))
        rate = min(0.5, max(1e-4, (sum(bad) + 0.1 * weight) / (n + weight)))
        if done:
            break
    return [1 - p for p in bad]


def test_op6(spark, folder):
    import pyarrow as pa

    from mercato.llm import quality

    rows = folder[1]
    got = run(spark, folder, "op6_quality_weak_supervision")
    m = quality.measure(pa.array([t for _, t in rows], pa.string()))
    good = em_by_hand(list(zip(*(r.votes(m).tolist() for r in quality.RULES))), len(quality.RULES))
    for k, (i, t) in enumerate(rows):
        w = WORD.findall(t or "")
        seen = Counter(tuple(w[a : a + 8]) for a in range(len(w) - 7))
        cover = {a + j for a in range(len(w) - 7) if seen[tuple(w[a : a + 8])] > 1 for j in range(8)}
        failed = len(w) < 20 or 100 * len(cover) > 30 * len(w)
        assert (got[i].n_words, got[i].n_repeat_words, got[i].base_failed) == (len(w), len(cover), failed)
        assert got[i].quality == pytest.approx(good[k], abs=1e-6) and got[i].kept == (not failed and good[k] >= 0.5)


def test_op7(spark, folder):
    got, text = run(spark, folder, "op7_one_permutation_fingerprints"), dict(folder[1])
    ids = sorted(text, reverse=True)
    for k, i in enumerate(ids):
        a, b = text[i] or "", text[ids[(k + 1) % len(ids)]] or ""
        edited = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(a), SHA(edited.encode())) and 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert all(got[i].fingerprint == got[j].fingerprint for i in ids for j in ids if text[i] == text[j])


def test_op9(spark, folder):
    lib, at = library(), defaultdict(list)
    ids = {i: lib.encode(t or "", add_special_tokens=False).ids + [0] for i, t in folder[1]}
    out = QUERIES["op9_best_fit_packing"](spark, folder[0]).collect()
    for r in out:
        assert zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
        at[r.sequence_id].append((r.offset, r.length))
    assert Counter({i: len(v) for i, v in ids.items()}) == sum((Counter({r.doc_id: r.length}) for r in out), Counter())
    for parts in at.values():
        parts.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and parts[0][0] == 0 and sum(parts[-1]) <= 2048


def test_op10_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in QUERIES["op10_language_mixture"](spark, sf).collect()}
    truth = [r for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text").collect() if r.lang and r.text and got[r.doc_id].held_out and re.search(r"[^\W\d_]", r.text)]
    assert len(truth) > 20 and np.mean([got[r.doc_id].lang_pred == r.lang for r in truth]) >= 0.95
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in truth)


def test_op1_recall_on_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    want, _ = true_components(rows, 85)
    got = run(spark, ("/root/testdata/sf0.001",), "op1_minhash_near_dedup")
    assert {i: r.component_id for i, r in got.items()} == want


def test_near_duplicates_that_differ_from_their_hub(spark):
    """Edits shared by some, and texts cut at either end: links beside the hub, by what it lacks and by size."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(2):
        base = [rng.choice(words) for _ in range(150)]
        for k in range(90):
            w = list(base)
            for _ in range(rng.randint(0, 9)):
                w[rng.randrange(len(w))] = rng.choice(words[:20])
            w = w[: rng.randint(90, 149)] if k % 7 == 0 else w
            w = w[rng.randint(0, 40) :] if k % 11 == 0 else w
            rows.append((len(rows), " ".join(w)))
    want, _ = true_components(rows, 80)
    got = {r.doc_id: r.component_id for r in near_duplicates(frame(spark, rows), percent=80).collect()}
    assert got == want and 20 < len(set(want.values())) < len(rows)


def test_suffix_dedup_of_very_long_texts_and_clashing_names(spark):
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefgh ") for _ in range(1_500_000))
    rows = [(1, long), (2, "x" * 50 + long[700_000:700_300] + "y" * 200), (3, "z" * 120_000)]
    docs = spark.createDataFrame([(i, t, i, "k") for i, t in rows], "doc_id long, text string, _of long, start string")
    got = {r.doc_id: r for r in deduplicate(docs).collect()}
    assert got[1]._n_removed == 0 and (got[2]._n_removed, got[2]._n_spans) == (300 + 199, 2) and (got[3]._n_removed, got[3]._n_spans) == (119_999, 1)
    assert all((r._of, r.start) == (i, "k") for i, r in got.items())


def test_crowded_anchor_is_split_by_content(spark):
    rng = random.Random(4)
    say = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    passage, rows = say(160), []
    for i in range(60):
        rows.append((i, say(rng.randint(0, 90)) + passage[rng.choice((0, 0, 20)) :] + say(rng.randint(0, 90))))
    rows += [(100 + i, rows[i][1][:70] + rows[i + 1][1][70:]) for i in range(20)]
    want = removed(rows)
    from mercato.llm.suffix_dedup import covered, remove

    by = defaultdict(list)
    for r in covered(spark.createDataFrame(rows, EMPTY).repartition(4), 100, most_contexts=3).collect():
        by[r.doc_id].append((r.start << 20) + r["size"])
    assert {d: remove(t.encode(), by[d])[0] for d, t in rows} == {d: w[1] for d, w in want.items()}


def test_every_query_takes_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, query in QUERIES.items():
        assert query(spark, str(tmp_path)).count() == (1 if name.startswith("op5") else 0), name


def test_unused_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "_of int, __OF int, x int")
    assert common.unused(df, "_of") == "___of" and ODD
