import zlib
from collections import defaultdict

import numpy as np

import corpus_pipeline
from mercato.llm.language import identify
from mercato.llm.quality import judge
from test_operators import library, removed, true_components
from test_pipeline import COLUMNS, _word

PASSAGE = " ".join(_word(9000 + k * 3) for k in range(20))


def test_cut_characters_go_and_replacement_characters_stay(spark):
    rows = [(1, f"one {PASSAGE}é end"), (2, f"two � {PASSAGE}è � tail"), (3, "�"), (4, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], COLUMNS)
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.suffix_dedup(spark, docs, "").collect()}
    assert got == {1: (rows[0][1], len(rows[0][1])), 2: ("two � � tail", 12), 3: ("�", 1), 4: (None, None)}


def fixture():
    """Documents with near copies on both sides of 0.8, shared passages cut within characters, and rows that the first stages reject."""
    say = "Plain words follow each other here without much ado and so on, number {}. "
    rows = [(i, say.format(i) + " ".join(_word(i * 37 + k * k) for k in range(70))) for i in range(24)]
    for i in range(12):
        w = rows[i][1].split(" ")
        for k in (30, 30 + i):
            w[k] += "x"
        rows.append((40 + i, " ".join(w)))
    for i, tail in enumerate(("é", "è", "ê �", "中", "丮 �")):
        rows.append((60 + i, f"{rows[12 + i][1][60:400]} mid{i} � {PASSAGE}{tail} " + " ".join(_word(5000 + 41 * i + k * k) for k in range(30))))
    return rows + [(80, rows[0][1]), (81, None), (82, ""), (83, "12 34 56"), (84, "a " * 400)]


def test_run_against_brute_force(spark, tmp_path):
    rows = fixture()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], COLUMNS)
    docs.coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")

    # The models of the first two stages are held against brute force by the operators' tests; here their verdicts decide.
    good = {r.doc_id for r in judge(docs).where("kept").collect()}
    kept = docs.where(docs.doc_id.isin(*good))
    named = {r.doc_id for r in identify(kept).where("lang_pred <> 'und' and score >= 0.5").collect()}
    left = [(i, t) for i, t in rows if i in named]
    assert named >= set(range(24)) and not named & {81, 82, 83}
    first = {p: {i for i, c in true_components(left, p)[0].items() if i == c} for p in (75, 80, 85)}
    assert first[75] < first[80] < first[85]  # the threshold matters here
    left = [(i, t) for i, t in left if i in first[80]]
    want = {i: kept.decode(errors="ignore") for i, (_, kept) in removed(left).items()}
    assert any("�" in t for i, t in want.items() if t != dict(left)[i]) and sum(t != dict(left)[i] for i, t in want.items()) >= 4

    seen, at = {}, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = corpus_pipeline.common.table(stage(spark, at, str(tmp_path)), name)
        seen[name] = {r.doc_id: r for r in at.collect()}
    assert set(seen["quality_rules"]) == good and set(seen["language_id"]) == named and set(seen["near_dedup"]) == first[80]
    assert {i: (r.text, r.n_chars) for i, r in seen["suffix_dedup"].items()} == {i: (t, len(t)) for i, t in want.items()}

    lib, per, by = library(), defaultdict(list), defaultdict(list)
    ids = {i: lib.encode(t, add_special_tokens=False).ids + [0] for i, t in want.items()}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    for r in out:
        assert zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
        per[r.doc_id].append((r.start, r.length))
        by[r.sequence_id].append((r.offset, r.length))
    for parts, full in [(per[i], len(v)) for i, v in ids.items()] + [(p, None) for p in by.values()]:
        end = 0
        for begin, n in sorted(parts):
            assert begin == end
            end += n
        assert end == full if full else end <= 2048
    assert set(per) == set(ids) and len(by) <= 1.1 * sum(map(len, ids.values())) / 2048 + 2
