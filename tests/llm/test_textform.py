import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from platewright.llm.textform import canonical, canonical_form, comparable, comparison_key


@pytest.mark.parametrize(("text", "want"), [
    ("ｂｅｃａｕｓｅ", "because"), ("cоllесtіon", "collection"), ("Αctinomma", "Actinomma"), ("T. οrx", "T. orx"), ("Τ． οrxanseissima", "T. orxanseissima"),
    ("po​int­x﻿", "pointx"), ("Monte Orvella", "Monte Orvella"), ("Karst‑Pass", "Karst-Pass"), ("Véranne", "Véranne"), ("ﬀ", "ff"), ("bу", "by"),
])
def test_put_right(text, want):
    assert canonical(text) == want


@pytest.mark.parametrize("text", ["Río Almeñar", "Река Тальменка", "Όρμος Σαρτίβου", "神崎沢", "Çamaltı Creek", "50 μm (δ18O) – “ghost”", "a\nb\r\nc", "", "Großmoor", "上野別川 DNA", "Карьер Белозёрный"])
def test_left_alone(text):
    assert canonical(text) == text


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_idempotent_and_composed(text):
    once = canonical(text)
    assert canonical(once) == once
    assert comparable(comparable(text)) == comparable(text)
    assert unicodedata.is_normalized("NFC", once)


def test_columns(spark):
    df = spark.createDataFrame([("Ｔｈｅ  Straße",), (None,), ("",), ("x" * 100_000,)], "t string")
    got = df.select(canonical_form(F.col("t")).alias("a"), comparison_key(F.col("t")).alias("b")).collect()
    assert [(r.a, r.b) for r in got[:3]] == [("The  Straße", "the strasse"), (None, None), ("", "")]
    assert len(got[3].a) == 100_000
