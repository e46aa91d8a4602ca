import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from recollect.functions import exprs as X


def one(spark, column, **values):
    names = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], names).select(column).first()[0]


def test_tokens_mix_words_and_grams(spark):
    got = one(spark, X.tokens("t"), t="记忆检索 Dark-mode")
    assert sorted(got) == sorted(["dark", "mode", "记忆检", "忆检索", "记忆", "忆检", "检索"])
    assert one(spark, X.tokens("t"), t="记") == []


def test_hash_ignores_case_and_space(spark):
    assert one(spark, X.content_hash("t"), t="  A  b\n") == one(spark, X.content_hash("t"), t="a B")


@pytest.mark.parametrize("text,ok", [("short", False), ("a good statement", True), ("is this fine?", False), ("unfinished thing,", False), ("你会用吗这个工具", False), ("不是abc一般的情况", False)])
def test_quality_gate(spark, text, ok):
    assert one(spark, X.quality_gate("t"), t=text) is ok


def test_redact(spark):
    assert one(spark, X.redact("t"), t="密钥sk-abcdefghijklmnop1 end") == "密钥[REDACTED_SECRET] end"
    assert one(spark, X.redact("t"), t="password: hunter22") == "password: [REDACTED_SECRET]"


@pytest.mark.parametrize("strength,status", [(0.8, "active"), (0.4, "fading"), (0.15, "dormant"), (0.05, "retired")])
def test_status(spark, strength, status):
    assert one(spark, X.status_of(F.col("s")), s=strength) == status


def test_confidence_decays_to_a_floor(spark):
    assert one(spark, X.decayed_confidence(F.col("c"), F.lit(0), F.lit(360.0)), c=8.0) == math.floor(1 + 7 * 2**-4 + 0.5)
    assert one(spark, X.decayed_confidence(F.col("c"), F.lit(0), F.lit(360.0)), c=1.0) == 1


@pytest.mark.parametrize("text,day", [("on 2024-01-15", "2024-01-15"), ("today", "2024-02-01"), ("昨天", "2024-01-31"), ("last month", "2024-01-02"), ("never", None), ("2024-99-99", None)])
def test_time_reference(spark, text, day):
    got = one(spark, X.time_reference("t", datetime(2024, 2, 1)).cast("string"), t=text)
    assert got == day


def test_entities_first_of_each_name(spark):
    got = one(spark, X.entities("t"), t="see https://a.b/c v1.2.3 my-tool 'my-tool' 'quoted text'")
    assert [(e["name"], e["type"]) for e in got] == [("https://a.b/c", "url"), ("v1.2.3", "version"), ("my-tool", "tool"), ("quoted text", "concept")]


def test_nulls_stay_null(spark):
    for c in (X.tokens("t"), X.content_hash("t"), X.estimate_tokens("t"), X.redact("t")):
        assert one(spark, c, t=None) is None
