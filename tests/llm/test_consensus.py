import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from platewright.llm.consensus import consensus, latest_votes
from platewright.llm.p5_queries import bare_label, same_reviewer

VOTES = "field string, item string, annotator string, answer string"


def test_beats_the_majority_when_the_careless_agree(spark):
    """Planted truth: careful, middling and misled annotators, the misled often of one mind."""
    rng = random.Random(7)
    skill = {f"c{i}": 0.95 for i in range(5)} | {f"m{i}": 0.75 for i in range(4)} | {f"b{i}": 0.25 for i in range(6)}
    data, truth = [], {}
    for k in range(500):
        item, right, wrong = f"i{k}", *rng.sample("ABCDEF", 2)
        truth[item] = right
        for a in rng.sample(sorted(skill), 5):
            data.append(("label", item, a, right if rng.random() < skill[a] else wrong))
    data.append(("label", "i0", "new", truth["i0"]))
    answers, people = consensus(spark.createDataFrame(data, VOTES).withColumn("truth", F.lit("clash")))
    got = {r.item: r for r in answers.collect()}
    accuracy = sum(got[i].answer == t for i, t in truth.items()) / len(truth)
    by = {}
    for _, i, _, v in data:
        by.setdefault(i, Counter())[v] += 1
    majority = sum(by[i].most_common(1)[0][0] == t for i, t in truth.items()) / len(truth)
    # What votes weighed by the true skills would give: no method can know more.
    weighed = {}
    for _, i, a, v in data:
        if a in skill:
            weighed.setdefault(i, Counter())[v] += math.log(skill[a] / (1 - skill[a]))
    known = sum(weighed[i].most_common(1)[0][0] == t for i, t in truth.items()) / len(truth)
    assert accuracy > known - 0.02 and accuracy > majority + 0.1
    r = {x.annotator: x.reliability for x in people.collect()}
    assert min(r[a] for a in r if a[0] == "c") > 0.85 and max(r[a] for a in r if a[0] == "b") < 0.5
    assert 0.2 < r["new"] < 0.97


def test_nulls_ties_repeats_and_nothing(spark):
    data = [("f", "a", "x", "B"), ("f", "a", "y", "A"), ("f", "b", "x", "Q"), ("f", "b", "x", "Q"), ("f", "d", "y", "Q"), ("f", "b", None, "Z"), ("f", "c", "x", None), (None, "c", "x", "Z")]
    answers, people = consensus(spark.createDataFrame(data, VOTES))
    got = {r.item: (r.answer, r.n_votes, r.agreement) for r in answers.collect()}
    assert got == {"a": ("A", 2, 0.0), "b": ("Q", 1, None), "d": ("Q", 1, None)}
    assert people.count() == 2
    answers, people = consensus(spark.createDataFrame([], VOTES))
    assert answers.count() == 0 and people.count() == 0


def test_latest_votes(spark):
    df = spark.createDataFrame([(1, "p", "r", "A", "2024-01-01"), (2, "p", "r", "B", "2024-01-02"), (3, "p", "r", None, "2024-01-02"), (4, None, "r", "A", "2024-01-01"), (5, "p", " ", "A", "2024-01-01")], "id int, item0 string, who string, label string, t string").withColumn("item", F.lit("clash"))
    assert [tuple(r) for r in latest_votes(df, "item0", "who", ["label"], "t", "id").collect()] == [("p", "r", None)]


@pytest.mark.parametrize(("written", "label"), [("(A)", "A"), (" b.", "B"), ("panel C", "C"), ("[12]", "12"), ("3)", "3"), ("", None), ("unclear", None), (None, None), ("A", "A"), ("p", "P")])
def test_labels(spark, written, label):
    assert spark.createDataFrame([(written,)], "t string").select(bare_label(F.col("t"))).first()[0] == label


def test_reviewers(spark):
    df = spark.createDataFrame([("RV-011",), (" rv_011 ",), ("rv-011​",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(same_reviewer(F.col("t"))).collect()] == ["rv-011"] * 3 + [None, None]


def test_items_in_several_rows_and_open_fields(spark, monkeypatch):
    """An item's votes in one row or dealt into many give the same; so does a field of too many answers for a matrix, nearly."""
    rng = random.Random(5)
    skill = {f"a{i}": s for i, s in enumerate([0.2] * 6 + [0.7] * 10 + [0.95] * 14)}
    data = [("f", f"i{k}", a, "ABCDEFG"[k % 7] if rng.random() < skill[a] else rng.choice("ABCDEFG")) for k in range(60) for a in rng.sample(sorted(skill), 3 if k else 30)]
    df = spark.createDataFrame(data, VOTES)
    one, many = consensus(df)[0].toPandas().sort_values("item"), consensus(df, votes_a_row=2)[0].toPandas().sort_values("item")
    assert one[["item", "answer", "n_votes"]].values.tolist() == many[["item", "answer", "n_votes"]].values.tolist()
    assert abs(one["probability"].to_numpy() - many["probability"].to_numpy()).max() < 1e-6 and one["agreement"].tolist() == many["agreement"].tolist()
    truth = {f"i{k}": "ABCDEFG"[k % 7] for k in range(60)}
    words = df.withColumn("answer", F.concat("answer", F.lit("_"), F.col("item")))
    monkeypatch.setattr("platewright.llm.consensus.CLASSES", 20)
    for got in (consensus(words)[0], consensus(words, votes_a_row=2)[0]):
        assert sum(r.answer[0] == truth[r.item] for r in got.collect()) >= 54


def test_rows_of_a_matrix_sum_to_one_and_digamma():
    import numpy as np

    from platewright.llm.consensus import TYPES, _Field, _judge_block, digamma

    assert np.allclose(digamma(np.array([0.5, 1.0, 10.0])), [-1.9635100260, -0.5772156649, 2.2517525890])
    field = _Field(["A", "B", "C"], 2.0)
    # Class 0 is taken for 1 nine times as often as for 2; all are right in four of five votes.
    votes = np.array([4000.0, 900.0, 100.0, 1000.0, 4000.0, 0.0, 1000.0, 0.0, 4000.0])
    field.learn(np.arange(9), np.repeat(votes[:, None], len(TYPES), axis=1), False)
    # What is told of each answer of an item that surely shows A: logs of a row that sums to nearly 1 (expected logs lie below).
    _, told, *_ = _judge_block(field, np.array([3]), np.array([0, 1, 2]), np.array([1e9, 1e-9, 1e-9]), np.zeros((3, len(TYPES))), True)
    row = np.exp(told)
    assert (row.sum(0) <= 1 + 1e-9).all() and (row.sum(0) > 0.99).all() and (row[1] > 2 * row[2]).all()
