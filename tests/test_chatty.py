"""The first JSON object of a text against trying every brace, and its work on long texts."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from mercato.functions.chatty import first_object, json_object


def by_hand(text):
    for i, c in enumerate(text):
        if c == "{":
            try:
                _, n = json.JSONDecoder().raw_decode(text[i:])
                return text[i : i + n]
            except ValueError:
                continue
    return None


CASES = ['Sure: {"a": {"b": 5, "c": "}"}} and {more', 'He said "hi {" then {"a": [1, {"b": null}]} ok', '{oops {"a": 1}', '{"a": {"b": 1}, oops}', '{"note: {"a":1}', "{}", "[{}]", "{'a': 1} {\"k\": -1.5e3}", '{"a": 01} {"b": "\\u00e9\\n"}', "none", "", '{"a" 1} {"a":,} {"a":1,} {"ok":[]}', '{"x": "\t"} {"y": [true, false]}']


@pytest.mark.parametrize("text", CASES)
def test_cases(text):
    assert first_object(text) == by_hand(text)


def test_random_texts():
    rnd = random.Random(3)
    for _ in range(20_000):
        t = "".join(rnd.choice(['{', '}', '"', 'a', ':', ',', '[', ']', '1', ' ', '"k":', '{"a":1}', '\\']) for _ in range(rnd.randint(0, 14)))
        assert first_object(t) == by_hand(t), t


@pytest.mark.parametrize("text", ['{"a":' * 200_000, "{" * 1_000_000, '{"k": "' + "x" * 1_000_000 + '"}', '{"s": "' + "{" * 500_000, "}" * 1_000_000 + '{"a": 1}', '{"a": [' + "1," * 400_000 + "1]}", '{"a":{"b":1},' * 50_000])
def test_work_is_linear(text):
    began = time.process_time()
    first_object(text)
    assert time.process_time() - began < 5


def test_column(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*CASES, None])], "i int, t string")
    got = [r.x for r in df.select("i", json_object(F.col("t")).alias("x")).orderBy("i").collect()]
    assert got == [by_hand(t) for t in CASES] + [None]
