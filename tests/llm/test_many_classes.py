import random

import numpy as np

from platewright.llm import consensus as module
from platewright.llm.consensus import TYPES, _Field, _judge_block, consensus

VOTES = "field string, item string, annotator string, answer string"


def test_matrix_of_more_than_a_thousand_classes(spark):
    """A is always seen as such, B as A in two of five votes, so that one vote for either means B: also beside 1,100 other classes."""
    rng = random.Random(3)
    truth = {f"i{k}": "AB"[k % 3 > 0] for k in range(2400)}
    votes = {i: [(a, "A" if t == "A" or rng.random() < 0.4 else "B") for a in rng.sample([f"a{n}" for n in range(12)], 2)] for i, t in truth.items()}
    data = [("f", i, *v) for i, given in votes.items() for v in given] + [("f", f"other{k}", f"a{n}", f"x{k}") for k in range(1100) for n in range(3)]
    got = {r.item: r.answer for r in consensus(spark.createDataFrame(data, VOTES), rounds=6)[0].collect()}
    split = [i for i, given in votes.items() if given[0][1] != given[1][1]]
    assert len(split) > 500 and sum(got[i] == "B" for i in split) > 0.7 * len(split)
    assert sum(got[i] == t for i, t in truth.items()) > 0.8 * len(truth)


def test_answers_do_not_depend_on_how_many_classes_are_taken_at_a_time(spark, monkeypatch):
    rng = random.Random(5)
    data = [("f", f"i{k}", f"a{n}", rng.choice("ABCDEFGHIJ"[k % 7 : k % 7 + 3])) for k in range(80) for n in rng.sample(range(20), 5)]
    df = spark.createDataFrame(data, VOTES)
    answers = lambda: consensus(df, rounds=4)[0].toPandas().sort_values("item").values.tolist()
    want = answers()
    monkeypatch.setattr(module, "CLASSES", 4)
    assert answers() == want


def test_item_of_many_answers_by_parts_is_the_same(monkeypatch):
    rng = np.random.default_rng(1)
    field = _Field([str(i) for i in range(40)], 3.0)
    codes = np.sort(rng.choice(1600, 500, replace=False))
    field.learn(codes, rng.gamma(1, 40, (500, len(TYPES))), False)
    k = np.array([3, 30, 1, 40, 2])
    code = np.concatenate([np.sort(rng.choice(40, n, replace=False)) for n in k])
    n, w = rng.integers(1, 5, len(code)).astype(float), rng.random((len(code), len(TYPES)))
    for first in (True, False):
        whole = _judge_block(field, k, code, n, w, first)
        with monkeypatch.context() as m:
            m.setattr(module, "PAIRS_A_BLOCK", 100)
            parts = _judge_block(field, k, code, n, w, first)
        assert all(np.allclose(a, b) for a, b in zip(whole, parts)) and len(whole[2]) == len(parts[2])


def test_item_with_hundreds_of_answers(spark):
    data = [("f", "big", f"a{n}", f"x{n % 500}") for n in range(502)] + [("f", f"i{k}", f"a{n}", "x1") for k in range(20) for n in range(3)]
    got = {r.item: (r.answer, r.n_votes) for r in consensus(spark.createDataFrame(data, VOTES), rounds=2)[0].collect()}
    assert len(got) == 21 and got["i3"] == ("x1", 3) and got["big"][1] == 502 and got["big"][0] in ("x0", "x1")
