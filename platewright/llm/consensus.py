"""Consensus of several annotators by a community confusion model.

Annotators belong to a few types; each type has one confusion matrix per field,
shared by its members, so that an annotator with a handful of labels borrows the
matrix of the types that they fit. Variational updates alternate between the items'
answers, the annotators' types and the types' matrices, whose logarithms are
expectations under their Beta and Dirichlet posteriors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewright.plans.lineage import cut

#: Types of annotators, as the chance of a right label that each starts with.
TYPES = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.78, 0.85, 0.9, 0.94, 0.97, 0.99)
#: Pseudo-counts of a type's accuracy per class, drawn to its accuracy overall; of that, drawn to ``TYPES``; of each wrong class of
#: a row. Many, lest an annotator's own votes decide a cell and hold them in the type that they started in.
CLASS_PRIOR, TYPE_PRIOR, WRONG_PRIOR = 400.0, 50.0, 50.0
#: Classes of a field whose expectations are worked out at a time, however many it has.
CLASSES = 1_000
#: Votes that one row holds at most, items with more are dealt into several rows; pairs of answers that are judged, and cells
#: that are sent, at a time.
VOTES_A_ROW, PAIRS_A_BLOCK = 1_000, 200_000


def latest_votes(rows: DataFrame, item: str, annotator: str, fields: list[str], when: str, id_col: str) -> DataFrame:
    """(item, annotator, *fields): of each annotator's rows on an item the latest
    (ties: the larger id). Rows without item or annotator are left out."""
    newest = F.max(F.struct(F.col(when), F.col(id_col), *fields)).alias("_n")
    named = rows.where(F.col(item).isNotNull() & (F.trim(item) != "") & F.col(annotator).isNotNull() & (F.trim(annotator) != ""))
    return named.groupBy(F.col(item).alias("item"), F.col(annotator).alias("annotator")).agg(newest).select("item", "annotator", *[f"_n.{f}" for f in fields])


def consensus(votes: DataFrame, rounds: int = 12, tolerance: float = 1e-3, votes_a_row: int = VOTES_A_ROW) -> tuple[DataFrame, DataFrame]:
    """Answers and annotators from votes (field, item, annotator, answer).

    Returns (answers, annotators):

    * answers: field, item, answer (the most probable), probability, n_votes,
      agreement (chance that two of the item's votes agree; null for one vote);
    * annotators: annotator, reliability (expected share of right labels by the
      annotator's types), type_weights, n_votes.

    Rows with a null in any column don't vote. One vote per annotator, field and
    item is expected; repeats are reduced to the smallest answer. Ties are broken by
    probability, votes, then the smallest answer. Empty votes give empty results.

    An item's votes lie in one row, those of an item with more than ``votes_a_row`` in
    several, whose sums are combined per answer. A round is one map over these rows
    and one shuffle of its sums: a row per annotator and one per cell of the matrices
    that occurs. Types and matrices are shared with the tasks: ``len(TYPES)`` numbers
    an annotator, twice as many an answer of a field and as many a cell that occurs, that
    is, a pair of answers that one item was given. Every field has its whole matrix.
    """
    votes = votes.select("field", "item", "annotator", "answer").where("field is not null and item is not null and annotator is not null and answer is not null")
    votes = votes.groupBy("field", "item", "annotator").agg(F.min("answer").alias("answer"))
    sizes = votes.groupBy("field", "item").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > votes_a_row)
    parts = F.coalesce(F.ceil(F.col("n") / votes_a_row), F.lit(1)).cast("int")
    dealt = votes.join(sizes, ["field", "item"], "left").select("field", "item", "annotator", "answer", parts.alias("parts"))
    chunk = F.pmod(F.xxhash64("annotator"), F.col("parts")).cast("int").alias("chunk")
    rows = dealt.groupBy("field", "item", "parts", chunk).agg(F.collect_list("annotator").alias("who"), F.collect_list("answer").alias("said"))
    rows = cut(rows)
    model = _Model(rows)
    moved = math.inf
    for turn in range(rounds):
        if moved <= tolerance:
            break
        moved = model.update(first=turn == 0)
    annotators = model.annotators()
    return model.answers(), annotators


def digamma(x: np.ndarray) -> np.ndarray:
    """The logarithmic derivative of the gamma function, for numbers above 0."""
    x = np.asarray(x, dtype=float)
    low = np.zeros_like(x)
    for _ in range(6):
        small = x < 6
        low -= np.where(small, 1 / x, 0.0)
        x = np.where(small, x + 1, x)
    f = 1 / (x * x)
    return low + np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f / 240)))


class _Field:
    """The posterior of one field: per type the accuracy of every class (Beta) and, of
    what is said instead of it, each class (Dirichlet over an item's other answers)."""

    def __init__(self, classes: list[str], offered: float):
        self.number = {c: i for i, c in enumerate(classes)}
        self.offered = offered
        k, m = len(classes), len(TYPES)
        self.overall = np.array(TYPES)
        self.right, self.wrong = np.zeros((k, m)), np.zeros((k, m))
        #: Cells that occur, by class * classes + answer, and the votes of each type in them.
        self.codes, self.cells = np.zeros(0, dtype=np.int64), np.zeros((0, m))
        self.derive()

    def derive(self) -> None:
        """Expectations of logarithms under the posteriors."""
        self.log_right, self.log_wrong = np.empty_like(self.right), np.empty_like(self.wrong)
        for i in range(0, len(self.right), CLASSES):
            a, b = self.right[i : i + CLASSES] + CLASS_PRIOR * self.overall, self.wrong[i : i + CLASSES] + CLASS_PRIOR * (1 - self.overall)
            both = digamma(a + b)
            self.log_right[i : i + CLASSES], self.log_wrong[i : i + CLASSES] = digamma(a) - both, digamma(b) - both
        # Of cells that nothing is known of, and of those that occurred; an item's answers share by their ratios.
        self.known = np.exp(digamma(self.cells + WRONG_PRIOR))
        self.unknown = float(np.exp(digamma(np.array(WRONG_PRIOR))))

    def learn(self, codes: np.ndarray, sums: np.ndarray, first: bool) -> None:
        """Take the votes ``sums`` of the cells ``codes``, each of which is there once, in order."""
        size = len(self.number)
        self.right, self.wrong = np.zeros_like(self.right), np.zeros_like(self.wrong)
        same = codes // size == codes % size
        np.add.at(self.right, codes[same] // size, sums[same])
        np.add.at(self.wrong, codes[~same] // size, sums[~same])
        self.codes, self.cells = codes[~same], sums[~same]
        if not first:
            r, w = self.right.sum(0), self.wrong.sum(0)
            self.overall = (r + TYPE_PRIOR * np.array(TYPES)) / (r + w + TYPE_PRIOR)
        self.derive()

    def __getstate__(self) -> dict:
        """What tasks need: no votes, which the driver alone learns from."""
        return {k: v for k, v in self.__dict__.items() if k not in ("right", "wrong", "cells")}


class _Model:
    """The state of the rounds: what is known of fields, types and annotators."""

    def __init__(self, rows: DataFrame):
        self.rows, self.spark = rows, rows.sparkSession
        m = len(TYPES)
        people = rows.select(F.explode("who").alias("annotator")).groupBy("annotator").agg(F.count(F.lit(1)).alias("n")).toPandas()  # len(TYPES) numbers each
        people = people.sort_values("annotator", ignore_index=True)
        self.people = people
        self.number = {a: i for i, a in enumerate(people["annotator"])}
        self.types = np.full((len(people), m), 1.0 / m)
        self.share = np.full(m, 1.0 / m)
        self.large = not rows.where("parts > 1").isEmpty()
        classes: dict[str, list[str]] = {}
        said = rows.select("field", F.explode(F.array_distinct("said")).alias("answer")).distinct()
        given = said.toArrow()  # a row per class of each field
        for f, a in zip(given["field"].to_pylist(), given["answer"].to_pylist()):
            classes.setdefault(f, []).append(a)
        self.fields = {f: _Field(sorted(found), 1.0) for f, found in classes.items()}
        self.blocks = cut(self._encoded())
        self._count_alternatives()

    def _shared(self):
        return self.spark.sparkContext.broadcast((self.fields, self.number, self.types.astype(np.float32)))

    def _of_large(self, shared, first: bool) -> DataFrame | None:
        """(field, item, answers, n, q, told) of the items that lie in several rows, and rows without item: sums of cells."""
        if not self.large:
            return None
        m = len(TYPES)

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            _, number, types = shared.value
            for batch in batches:
                out = []
                for f, item, who, said in zip(batch["field"], batch["item"], batch["who"], batch["said"]):
                    names, at = np.unique(np.asarray(said, dtype=object).astype(str), return_inverse=True)
                    w = types[[number[x] for x in who]]
                    sums = np.stack([np.bincount(at, weights=w[:, k], minlength=len(names)) for k in range(m)], axis=1)
                    out += [(f, item, a, int(n), *s) for a, n, s in zip(names, np.bincount(at), sums.tolist())]
                yield pd.DataFrame(out, columns=["field", "item", "answer", "n", *[f"w{k}" for k in range(m)]])

        schema = "field string, item string, answer string, n bigint, " + ", ".join(f"w{k} double" for k in range(m))
        w = [f"w{k}" for k in range(m)]
        by_answer = self.rows.where("parts > 1").mapInPandas(partial, schema).groupBy("field", "item", "answer").agg(F.sum("n").alias("n"), *[F.sum(x).alias(x) for x in w])
        whole = by_answer.groupBy("field", "item").agg(F.array_sort(F.collect_list(F.struct("answer", "n", F.array(*w).alias("w")))).alias("a"))

        def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            fields = shared.value[0]
            for batch in batches:
                answers = [[x["answer"] for x in a] for a in batch["a"]]
                n = np.array([x["n"] for a in batch["a"] for x in a], dtype=float)
                weights = np.array([x["w"] for a in batch["a"] for x in a], dtype=float).reshape(-1, m)
                q, told, cells = _judge(fields, list(batch["field"]), answers, n, weights, first)
                ends = np.cumsum([len(a) for a in answers])[:-1]
                split = lambda x: [y.tolist() for y in np.split(x, ends)]
                yield pd.DataFrame({"field": batch["field"], "item": batch["item"], "answers": answers, "n": split(n.astype(np.int64)), "q": split(q), "told": split(told), "codes": None, "sums": None})
                for f, (codes, votes) in cells.items():
                    for i in range(0, len(codes), PAIRS_A_BLOCK):
                        part = codes[i : i + PAIRS_A_BLOCK].astype(np.int64).tobytes(), votes[i : i + PAIRS_A_BLOCK].astype(float).tobytes()
                        yield pd.DataFrame([(f, None, None, None, None, None, *part)], columns=["field", "item", "answers", "n", "q", "told", "codes", "sums"])

        schema = "field string, item string, answers array<string>, n array<bigint>, q array<double>, told array<array<double>>, codes binary, sums binary"
        return cut(whole.mapInPandas(judge, schema))

    def _encoded(self) -> DataFrame:
        """(field, k, code, who, at): the items that lie in one row, a batch of them in a row of
        packed numbers: how many answers each has, their classes, who voted and for which of all
        those answers. The rounds read these and nothing else."""
        shared = self.spark.sparkContext.broadcast((self.fields, self.number))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            fields, number = shared.value
            for batch in batches:
                out = []
                for name, part in batch.groupby("field", sort=False):
                    classes = fields[name].number
                    answers, at, _ = _numbered(part["said"])
                    code = np.array([classes[a] for given in answers for a in given])
                    who = np.array([number[x] for row in part["who"] for x in row])
                    numbers = (np.array([len(a) for a in answers]), code, who, at)
                    out.append((name, *[x.astype(np.int32).tobytes() for x in numbers]))
                yield pd.DataFrame(out, columns=["field", "k", "code", "who", "at"])

        return self.rows.where("parts = 1").select("field", "who", "said").mapInPandas(run, "field string, k binary, code binary, who binary, at binary")

    def _count_alternatives(self) -> None:
        """How many wrong answers an item of each field effectively offers, by how often two
        votes against its leading answer agree. Between 1 and 50."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for name, k, code, _, at in batch.itertuples(index=False, name=None):
                    k, n = np.frombuffer(k, np.int32), np.bincount(np.frombuffer(at, np.int32), minlength=len(code) // 4).astype(float)
                    begins = np.concatenate([[0], np.cumsum(k)[:-1]]).astype(np.int64)
                    top, total, same = np.maximum.reduceat(n, begins), np.add.reduceat(n, begins), np.add.reduceat(n * (n - 1), begins)
                    out.append((name, float(((total - top) * (total - top - 1)).sum()), float((same - top * (top - 1)).sum())))
                yield pd.DataFrame(out, columns=["field", "pairs", "same"])

        told = self.blocks.mapInPandas(run, "field string, pairs double, same double")
        if self.large:
            tally = self.rows.where("parts > 1").select("field", "item", F.explode("said").alias("answer")).groupBy("field", "item", "answer").agg(F.count(F.lit(1)).alias("n"))
            per = tally.groupBy("field", "item").agg(F.max("n").alias("top"), F.sum("n").alias("all"), F.sum(F.col("n") * (F.col("n") - 1)).alias("same"))
            wrong = F.col("all") - F.col("top")
            told = told.unionByName(per.select("field", (wrong * (wrong - 1)).cast("double").alias("pairs"), (F.col("same") - F.col("top") * (F.col("top") - 1)).cast("double").alias("same")))
        for r in told.groupBy("field").agg(F.sum("pairs").alias("pairs"), F.sum("same").alias("same")).collect():  # a row per field
            self.fields[r["field"]].offered = min(50.0, max(1.0, (r["pairs"] + 4.0) / (r["same"] + 2.0)))

    def update(self, first: bool) -> float:
        """One round; how far the type of any annotator moved."""
        m = len(TYPES)
        shared = self._shared()
        large = self._of_large(shared, first)

        def packed(people: np.ndarray, met: np.ndarray, sums: dict[str, list[tuple[np.ndarray, np.ndarray]]]) -> Iterator[pd.DataFrame]:
            some = np.flatnonzero(met)
            tables = [("", some, people[some])] + [(f"f{f}", *_added(found)) for f, found in sums.items()]
            for kind, codes, values in tables:
                if len(codes):
                    yield pd.DataFrame({"kind": [kind] * len(codes), "code": codes, **{f"v{t}": values[:, t] for t in range(m)}})

        def of_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            fields, number, types = shared.value
            people, met = np.zeros((len(number), m)), np.zeros(len(number), dtype=bool)
            sums: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
            for batch in batches:
                for name, *numbers in batch.itertuples(index=False, name=None):
                    k, code, who, at = (np.frombuffer(x, np.int32).astype(np.int64) for x in numbers)
                    n = np.bincount(at, minlength=len(code)).astype(float)
                    weights = np.stack([np.bincount(at, weights=types[who, t], minlength=len(n)) for t in range(m)], axis=1)
                    _, told, codes, values = _judge_items(fields[name], k, code, n, weights, first)
                    sums.setdefault(name, []).append((codes, values))
                    if len(sums[name]) > 16:
                        sums[name] = [_added(sums[name])]
                    met[who] = True
                    for t in range(m):
                        people[:, t] += np.bincount(who, weights=told[at, t], minlength=len(number))
            yield from packed(people, met, sums)

        def of_large(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            _, number, _ = shared.value
            people, met = np.zeros((len(number), m)), np.zeros(len(number), dtype=bool)
            for batch in batches:
                for who, said, answers, told in batch.itertuples(index=False, name=None):
                    place = {a: i for i, a in enumerate(answers)}
                    who, logs = np.array([number[x] for x in who], dtype=np.int64), np.array([list(x) for x in told], dtype=float)
                    met[who] = True
                    np.add.at(people, who, logs[[place[x] for x in said]])
            yield from packed(people, met, {})

        def of_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for name, codes, sums in batch.itertuples(index=False, name=None):
                    yield from packed(np.zeros((0, m)), np.zeros(0, dtype=bool), {name: [(np.frombuffer(codes, np.int64), np.frombuffer(sums, float).reshape(-1, m))]})

        columns = [f"v{t}" for t in range(m)]
        schema = "kind string, code bigint, " + ", ".join(f"{c} double" for c in columns)
        told = self.blocks.mapInPandas(of_blocks, schema)
        if large is not None:
            rows = self.rows.where("parts > 1").join(large.select("field", "item", "answers", "told"), ["field", "item"])
            told = told.unionByName(rows.select("who", "said", "answers", "told").mapInPandas(of_large, schema))
            told = told.unionByName(large.where("item is null").select("field", "codes", "sums").mapInPandas(of_cells, schema))
        found = told.groupBy("kind", "code").agg(*[F.sum(c).alias(c) for c in columns]).toArrow()  # a row per annotator and per cell that occurs
        kinds, codes = np.array(found["kind"].to_pylist(), dtype=object), found["code"].to_numpy()
        values = np.stack([found[c].to_numpy() for c in columns], axis=1)
        logs = np.zeros_like(self.types)
        logs[codes[kinds == ""]] = values[kinds == ""]
        for name, field in self.fields.items():
            mine = np.flatnonzero(kinds == f"f{name}")
            mine = mine[codes[mine].argsort()]
            field.learn(codes[mine], values[mine], first)
        # Weights of the types by their expected log under a Dirichlet posterior with one pseudo-annotator each.
        members = self.types.sum(0) + 1.0
        logs += digamma(members) - digamma(members.sum())
        fresh = np.exp(logs - logs.max(1, keepdims=True)) if len(logs) else logs
        fresh = fresh / np.maximum(fresh.sum(1, keepdims=True), 1e-300)
        moved = float(np.abs(fresh - self.types).max()) if len(fresh) else 0.0
        self.types = fresh
        return moved

    def annotators(self) -> DataFrame:
        accuracy = np.mean([f.overall for f in self.fields.values()], axis=0) if self.fields else np.array(TYPES)
        rows = [(a, float(w @ accuracy), [float(x) for x in w], int(n)) for a, n, w in zip(self.people["annotator"], self.people["n"], self.types)]
        return self.spark.createDataFrame(rows, "annotator string, reliability double, type_weights array<double>, n_votes bigint")

    def answers(self) -> DataFrame:
        m = len(TYPES)
        shared = self._shared()
        schema = "field string, item string, answer string, probability double, n_votes bigint, agreement double"

        def chosen(fields, items, answers, n, q) -> pd.DataFrame:
            out, at = [], 0
            for f, item, names in zip(fields, items, answers):
                mine, p = n[at : at + len(names)], q[at : at + len(names)]
                at += len(names)
                best = max(range(len(names)), key=lambda i: (round(float(p[i]), 9), mine[i], [-ord(c) for c in names[i]], names[i]))
                total = float(mine.sum())
                agree = float((mine * (mine - 1)).sum() / (total * (total - 1))) if total > 1 else None
                out.append((f, item, names[best], round(float(p[best]), 9), int(total), agree))
            return pd.DataFrame(out, columns=["field", "item", "answer", "probability", "n_votes", "agreement"])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            fields, number, types = shared.value
            for batch in batches:
                who = np.array([number[x] for row in batch["who"] for x in row], dtype=np.int64)
                answers, at, n = _numbered(batch["said"])
                weights = np.stack([np.bincount(at, weights=types[who, k], minlength=len(n)) for k in range(m)], axis=1)
                q, _, _ = _judge(fields, list(batch["field"]), answers, n, weights, False)
                yield chosen(batch["field"], batch["item"], answers, n, q)

        result = self.rows.where("parts = 1").mapInPandas(run, schema)
        large = self._of_large(shared, False)
        if large is not None:

            def of_large(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for batch in batches:
                    n, q = (np.array([x for row in batch[c] for x in row], dtype=float) for c in ("n", "q"))
                    yield chosen(batch["field"], batch["item"], [list(a) for a in batch["answers"]], n, q)

            result = result.unionByName(large.where("item is not null").select("field", "item", "answers", "n", "q").mapInPandas(of_large, schema))
        return result


def _numbered(said: pd.Series) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
    """Each row's distinct answers in order, the place of every vote among all of them, and the votes that each has."""
    answers, at, base = [], [], 0
    for row in said:
        names = sorted(set(row))
        place = {a: base + i for i, a in enumerate(names)}
        at += [place[x] for x in row]
        answers.append(names)
        base += len(names)
    at = np.array(at, dtype=np.int64)
    return answers, at, np.bincount(at, minlength=base).astype(float)


def _added(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The votes of tables of cells added up: the codes that occur, in order, each once, and their sums."""
    codes, where = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
    votes = np.concatenate([v for _, v in found])
    return codes, np.stack([np.bincount(where, weights=votes[:, t], minlength=len(codes)) for t in range(votes.shape[1])], axis=1)


def _judge(fields: dict[str, _Field], names: list[str], answers: list[list[str]], n: np.ndarray, weights: np.ndarray, first: bool) -> tuple[np.ndarray, np.ndarray, dict[str, tuple[np.ndarray, np.ndarray]]]:
    """(q, told, cells) of items whose distinct answers ``answers`` have ``n`` votes of types ``weights``.

    q: the probability of each answer; told: what each type has to say of a vote for
    it, its expected log-chance; cells: by field the codes of true and given classes and the
    votes of each type. ``first`` takes the share of the votes for q.
    """
    sizes = np.array([len(a) for a in answers], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if len(sizes) else sizes
    q, told = np.zeros(len(n)), np.zeros((len(n), len(TYPES)))
    cells: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    of_field: dict[str, list[int]] = {}
    for i, f in enumerate(names):
        of_field.setdefault(f, []).append(i)
    for name, items in of_field.items():
        field, mine = fields[name], np.array(items, dtype=np.int64)
        k = sizes[mine]
        place = np.repeat(starts[mine] - np.concatenate([[0], np.cumsum(k)[:-1]]), k) + np.arange(k.sum())
        code = np.array([field.number[a] for i in items for a in answers[i]], dtype=np.int64)
        q[place], told[place], *cells[name] = _judge_items(field, k, code, n[place], weights[place], first)
    return q, told, cells


def _judge_items(field: _Field, k: np.ndarray, code: np.ndarray, n: np.ndarray, w: np.ndarray, first: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """:func:`_judge_block` of items one after the other, so many at a time that their pairs of answers stay few."""
    block = np.cumsum(k**2) // PAIRS_A_BLOCK
    ends = np.cumsum(k)
    cuts = np.flatnonzero(np.diff(block)) + 1
    q, told, cells = np.zeros(len(n)), np.zeros((len(n), len(TYPES))), []
    for i, j in zip([0, *cuts], [*cuts, len(k)]):
        here = slice(int(ends[i - 1]) if i else 0, int(ends[j - 1]))
        q[here], told[here], codes, votes = _judge_block(field, k[i:j], code[here], n[here], w[here], first)
        cells.append((codes, votes))
    return q, told, *_added(cells)


def _judge_block(field: _Field, k: np.ndarray, code: np.ndarray, n: np.ndarray, w: np.ndarray, first: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(q, told, codes, votes), see :func:`_judge`, for items of one field with ``k`` answers each, whose classes are ``code``.

    An item offers as many wrong answers as the field does on average; of these the
    ones that it was given share by the types' matrices, so that a row of a matrix
    sums to 1 over what an item offers. Of an item of very many answers some are taken
    for the true one at a time.
    """
    first_of = np.concatenate([[0], np.cumsum(k)[:-1]]).astype(np.int64)
    item = np.repeat(np.arange(len(k)), k)
    share = np.minimum(1.0, (k - 1) / field.offered)
    right, wrong = field.log_right[code], field.log_wrong[code]

    def of_item(x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, first_of)[item]

    def posterior(score: np.ndarray) -> np.ndarray:
        if first:
            return n / of_item(n)
        e = np.exp(score - np.maximum.reduceat(score, first_of)[item])
        return e / of_item(e)

    reach = k[item]

    def pairs(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(x, y, cell, logp, begins) of the answers from ``i`` to ``j`` as true (x) and all that their items were given (y)."""
        x = np.repeat(np.arange(i, j), reach[i:j])
        begins = np.concatenate([[0], np.cumsum(reach[i:j])[:-1]]).astype(np.int64)
        y = np.arange(len(x)) - np.repeat(begins - first_of[item[i:j]], reach[i:j])
        cell = code[x] * len(field.number) + code[y]
        same = x == y
        at = np.minimum(np.searchsorted(field.codes, cell), max(len(field.codes) - 1, 0))
        odds = np.full((len(x), len(TYPES)), field.unknown)
        if len(field.codes):
            hit = field.codes[at] == cell
            odds[hit] = field.known[at[hit]]
        odds[same] = 0.0
        total = np.add.reduceat(odds, begins)[x - i]
        with np.errstate(divide="ignore", invalid="ignore"):
            logp = wrong[x] + np.log(odds / total * share[item[x]][:, None])
        logp[same] = right[x[same]]
        return x, y, cell, logp, begins

    cuts = np.flatnonzero(np.diff(np.cumsum(reach) // (2 * PAIRS_A_BLOCK))) + 1
    spans = list(zip([0, *cuts], [*cuts, len(code)]))
    held = [pairs(*spans[0])] if len(spans) == 1 else None

    def each() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        yield from held or (pairs(int(i), int(j)) for i, j in spans)

    p = posterior(n if first else np.concatenate([np.add.reduceat((w[y] * logp).sum(1), begins) for _, y, _, logp, begins in each()]))
    told, cells = np.zeros((len(code), len(TYPES))), []
    for x, y, cell, logp, _ in each():
        weighed = p[x][:, None] * logp
        told += np.stack([np.bincount(y, weights=weighed[:, t], minlength=len(code)) for t in range(len(TYPES))], axis=1)
        kept = p[x] > 1e-9
        cells.append((cell[kept], p[x[kept]][:, None] * w[y[kept]]))
    return p, told, *_added(cells)
