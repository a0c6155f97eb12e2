import random

import pytest
from pyspark.sql import functions as F

from platewright.llm.canonical_names import is_slip, map_names, parse_name, similarity_join, slips, trigrams

LIST = [
    (1, "Tavopylora", "mifaella", ["Orbulina vetusa"]), (2, "Tremibrachium", "datadriica", []), (3, "Tremibrachium", "datadriicana", []), (4, "Hespobrachium", "minelosa", None),
    (5, "Karnolithopsis", "cerrepaosa", []),
]


@pytest.fixture(scope="module")
def reference(spark):
    return spark.createDataFrame(LIST, "name_id bigint, genus string, epithet string, synonyms array<string>")


CASES = {
    "Tavopylora mifaella": 1, "T. mifaella": 1, "Tavo. mifaella": 1, "TAVOPYLORA MIFAELLA": 1, "Tavopy1ora mifae11a": 1, "Таvopylora mifaella": 1, "Tavopylora cf. T. mifaella": 1,
    "Tavopylora (Tavopylora) mifaella (Zelnik) emend. Brann": 1, "?Tavopylora mifaella s.l.": 1, "Tavopylora ?mifaella Zelnik, 1994": 1, '"Tavopylora mifaella"': 1, "Tavopyloramifaella": 1,
    "Tavoyplora mifaela": 1, "Tavopylora mifaellus": 1, "Orbulina vetusa": 1, "Tremibrachium datadriica": 2, "Tremibrachium datadriicana": 3, "Hespobrachiurn rninelosa": 4, "hespobrachium minelosa": 4,
    "Karnolithopsis cerre-\npaosa": 5, "Tavopylora": 0, "Tavopylora sp.": 0, "Tavopylora sp. A": 0, "Tavopylora spp.": 0, "Tavopylora sezokelissima": 0, "not determined": 0, "see plate 4": 0, "n/a": 0, "?": 0, "K. mifaella": 0,
    "x" * 5000: 0, "Tavopylora " + "y" * 5000: 0,
}


@pytest.mark.parametrize("limit", [100_000, 0], ids=["index", "shuffle"])
def test_names(spark, reference, limit):
    df = spark.createDataFrame([(n,) for n in [*CASES, *list(CASES)[:3], None, "", " \t"]], "name string").withColumn("genus", F.lit("clash")).withColumn("key", F.lit(1))
    got = {r.name: r.name_id for r in map_names(df, "name", reference, index_limit=limit).collect()}
    assert got == CASES


def test_empty_sides(spark, reference):
    df = spark.createDataFrame([("Tavopylora mifaella",)], "name string")
    assert map_names(df.limit(0), "name", reference).count() == 0
    assert [r.name_id for r in map_names(df, "name", reference.limit(0)).collect()] == [0]


def test_join_loses_no_pair(spark):
    """All pairs of the join, against brute force."""
    rng = random.Random(3)
    syllables = ["ta", "vo", "py", "lo", "ra", "mi", "fa", "el", "la", "xan"]
    left = sorted({"f:" + "".join(rng.choices(syllables, k=rng.randint(2, 6))) for _ in range(150)})
    right = sorted({"f:" + "".join(rng.choices(syllables, k=rng.randint(2, 6))) for _ in range(150)} | set(left[:10]))
    a, b = (spark.createDataFrame([(k,) for k in side], "key string") for side in (left, right))
    for t in (0.3, 0.6):
        got = {(r.key, r.other): r.jaccard for r in similarity_join(a, b, t).collect()}
        want = {}
        for x in left:
            for y in right:
                p, q = set(trigrams(x)), set(trigrams(y))
                j = len(p & q) / len(p | q)
                if j >= t:
                    want[x, y] = j
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_slips():
    assert slips("abcd", "abdc") == 1 and slips("abc", "ac") == 1 and slips("", "ab") == 2 and slips("abc", "abc") == 0
    assert parse_name(None) == (None, None) and parse_name("  ") == (None, None)
    assert not is_slip("t.", "mifaella", 1, 0) and is_slip("tavopylora", "mifaella", 4, 1)
