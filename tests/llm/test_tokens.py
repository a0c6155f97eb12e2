import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from platewright.llm.bpe import DEFAULT_FOLDER, PATTERN, Encoder, encode_corpus, encode_piece, read_ranks
from platewright.llm.packing import BestFit, pack

pytestmark = pytest.mark.skipif(not os.path.exists(f"{DEFAULT_FOLDER}/byte_bpe_50k.tiktoken"), reason="no vocabulary")


@pytest.fixture(scope="module")
def ranks():
    return read_ranks()


@pytest.fixture(scope="module")
def oracle(ranks):
    import tiktoken

    return tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def brute(piece, ranks):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
        if best is None:
            return [ranks[p] for p in parts]
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@settings(max_examples=200, deadline=None)
@given(text=st.text(max_size=120))
def test_same_ids_as_an_independent_encoder(ranks, oracle, text):
    assert Encoder(ranks).encode(text) == oracle.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(piece=st.binary(min_size=1, max_size=40))
def test_segment_tree_merges_like_brute_force(ranks, piece):
    assert encode_piece(piece, ranks) == ([ranks[piece]] if piece in ranks else brute(piece, ranks))


def test_long_pieces_and_special_strings(ranks, oracle):
    e = Encoder(ranks)
    for text in ("a" * 50_000, "日本語" * 5_000, "<|endoftext|>", "  \n\t " * 300, "'s'LL x"):
        assert e.encode(text) == oracle.encode_ordinary(text)
    back = {v: k for k, v in ranks.items()}
    assert b"".join(back[i] for i in e.encode("naïve 🔬")).decode() == "naïve 🔬"


def test_corpus(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, None), (3, ""), (3, ""), (4, " ")], "doc_id bigint, text string").withColumn("ids", F.lit("x")).withColumn("_id", F.lit(1))
    got = [(r.doc_id, r.ids) for r in encode_corpus(df, "doc_id", "text").orderBy("doc_id").collect()]
    assert got == [(1, [15496, 995]), (2, []), (3, []), (3, []), (4, [220])]
    assert encode_corpus(df.limit(0), "doc_id", "text").count() == 0
    assert [r.n_tokens for r in encode_corpus(df, "doc_id", "text", counts_only=True).orderBy("doc_id").collect()] == [2, 0, 0, 0, 1]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200), st.integers(1, 8))
def test_containers_never_overflow_and_best_fit_is_used(sizes, most_open):
    fit, room, opened = BestFit(64, most_open), {}, []
    for s in sizes:
        at = fit.place(s)
        if at in room:
            assert room[at] >= s and all(room[o] < s or room[o] >= room[at] for o in opened if o in room and o != at)
        room[at] = room.get(at, 64) - s
        assert room[at] >= 0
        if at in opened:
            opened.remove(at)
        if room[at]:
            opened.append(at)
            if len(opened) > most_open:
                opened.remove(min(opened, key=lambda o: room[o]))
        opened = [o for o in opened if any(o in v for v in fit.by_room.values())]
        assert fit.n_open <= most_open


def test_pack(spark):
    items = spark.createDataFrame([(i, (i * 37) % 90) for i in range(2000)] + [(5000, 230), (5001, None), (5002, 0), (7, 11)], "doc_id bigint, n int").withColumn("capacity", F.lit("x"))
    sizes = spark.createDataFrame([("s", 100), ("l", 400), ("bad", None), ("zero", 0)], "size_name string, capacity int")
    got = pack(items, "doc_id", "n", sizes, stream=500).cache()
    full = got.groupBy("size_name", "capacity", "container").agg(F.sum("piece_size").alias("s")).where("container is not null and s > capacity")
    assert full.count() == 0
    assert got.select("size_name").distinct().count() == 2
    for name in ("s", "l"):
        mine = got.where(F.col("size_name") == name)
        assert mine.agg(F.sum("piece_size")).first()[0] == items.agg(F.sum("n")).first()[0]
        assert mine.where("piece = 0").groupBy("doc_id").count().where("count > 1 and doc_id <> 7").count() == 0
    assert sorted(r.piece_size for r in got.where("doc_id = 5000 and size_name = 's'").collect()) == [30, 100, 100]
    assert got.where("doc_id in (5001, 5002)").where("container is null and piece_size = 0").count() == 4
    used = got.where("size_name = 's' and container is not null").select("container").distinct().count()
    assert items.agg(F.sum("n")).first()[0] / (used * 100) > 0.9
    assert pack(items.limit(0), "doc_id", "n", sizes).count() == 0
    again = pack(items, "doc_id", "n", sizes, stream=500)
    assert again.exceptAll(got).count() == 0
