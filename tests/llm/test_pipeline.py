import corpus_pipeline
from mercato.llm import common

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def _word(n):
    return "".join("abcdefghij"[int(c)] for c in str(n * 7919 % 99991)) + "en"


def test_stages_over_odd_rows(spark):
    say = "Plain words follow each other here without much ado and so on, number {}. " * 1
    body = [" ".join(_word(i * 37 + k * k) for k in range(70)) for i in range(30)]
    rows = [(i, say.format(i) + b, "en", "s", len(b)) for i, b in enumerate(body)]
    rows += [(100, rows[0][1], "en", "s", 1), (101, None, None, None, None), (102, "", "en", "s", 0), (103, body[1][:300] + " " + body[2][:300], "en", "s", 1)]
    docs = spark.createDataFrame(rows, COLUMNS)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.table(stage(spark, docs, ""), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {r.doc_id for r in docs.collect()}
    assert ids >= set(range(30)) and not ids & {100, 101, 102}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert {r.doc_id for r in packed.select("doc_id").collect()} == ids


def test_run_is_registered():
    import __spark_entry__

    assert "pipeline" in __spark_entry__.queries() and [k for k in __spark_entry__.queries() if k.startswith("op")]


def test_run_over_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.collect() == [] and {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns)
