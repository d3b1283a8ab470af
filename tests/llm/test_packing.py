import random
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm.packing import WORDS, Centroids, ShardIndex, fill, fill_report, pack
from tessera.llm.tokens import default_ranks, encoder

ENC = encoder(default_ranks())


def index(docs):
    vocabulary = {w: i for i, w in enumerate(sorted({w for d in docs for w in d}))}
    words = [sorted(set(d)) for d in docs]
    flat = np.array([vocabulary[w] for d in words for w in d], np.int64)
    return ShardIndex(flat, np.array([docs[i].count(w) for i, d in enumerate(words) for w in d], float), np.array(list(map(len, words))))


def test_neighbours_come_first():
    docs = [["đất", "nhà"], ["thuế", "phí"], ["đất", "nhà", "x"], ["thuế"], []]
    scores = index(docs).scores(0)
    assert scores[2] > 0 and scores[1] == scores[3] == scores[4] == 0
    assert fill(np.array([40, 39, 10, 10, 10]), index(docs), 100)[0][:2] == [0, 2]


def test_all_words_of_a_long_seed_count():
    own = [f"riêng{i}" for i in range(60)]
    docs = [[*own, "đất"], ["thuế"], ["đất"], ["đất", "thuế"]]
    scores = index(docs).scores(0)
    assert scores[1] == 0 and scores[2] > scores[3] > 0
    assert fill(np.array([40, 20, 20, 20]), index(docs), 100)[0][:2] == [0, 2]


def test_no_overflow_and_each_once():
    rng = random.Random(0)
    sizes = np.array([rng.randint(1, 90) for _ in range(400)])
    held = fill(sizes, index([[f"w{rng.randrange(50)}" for _ in range(8)] for _ in sizes]), 100)
    assert sorted(i for h in held for i in h) == list(range(400))
    used = [int(sizes[h].sum()) for h in held]
    assert max(used) <= 100 and sum(used) / (100 * len(held)) > 0.95
    assert fill(np.array([], int), index([]), 100) == []


def test_every_row_is_placed(spark):
    rng = random.Random(2)
    texts = [None, "", " ".join(["dài"] * 3000)] + [" ".join(rng.choice(["một", "hai", "ba", "bốn"]) for _ in range(rng.randint(1, 200))) for _ in range(150)]
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(5, texts[5], 0), (None, "hai", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, size int")
    packed = pack(df, "doc_id", capacity=512, shard_docs=40)
    got = packed.collect()
    pieces, room = defaultdict(list), defaultdict(int)
    for r in got:
        pieces[r.doc_id].append((r.piece_no, r.token_start, r.n_tokens))
        if r.container is not None:
            room[r.container] += r.n_tokens
    assert max(room.values()) <= 512
    assert set(pieces) == {r[0] for r in rows} and len(pieces[5]) == 2
    for i, t in enumerate(texts):
        size = len(ENC.encode_ordinary(t or ""))
        own = sorted(set(pieces[i]))
        assert sum(n for _, _, n in own) == size and (len(own) == 1 or size > 512)
        assert all(start == 512 * no for no, start, _ in own)
    slots = defaultdict(list)
    for r in got:
        slots[r.container].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for c, s in slots.items() if c is not None)
    assert fill_report(packed, 512).first().tokens == sum(room.values())
    assert pack(df.limit(0), "doc_id").count() == 0
    with pytest.raises(ValueError):
        pack(df, "doc_id", capacity=0)


def test_retrieval_decides_where_room_is_left():
    """The best neighbour goes in although larger documents that share nothing would leave less room."""
    docs = [["đất", "nhà"], *[[f"khác{i}"] for i in range(20)], ["đất", "nhà", "x"], ["đất"]]
    sizes = np.array([40, *[30] * 10, *[10] * 10, 9, 11])
    first = fill(sizes, index(docs), 100)[0]
    assert {first[1], first[2]} == {21, 22}


def test_shards_hold_neighbours(spark):
    """Share of the ten best neighbours by BM25 over all documents that lie in a document's shard, against chance."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 0")
    texts = {r.doc_id: r.text for r in rows.select("doc_id", "text").collect()}
    placed = pack(rows, "doc_id", shard_docs=100).where("container is not null").select("doc_id", "container").collect()
    shard = {r.doc_id: r.container.rpartition("-")[0] for r in placed}
    ids = sorted(shard)
    all_docs = index([WORDS.findall(texts[i].lower()) for i in ids])
    held = []
    for at in range(0, len(ids), 7):
        score = all_docs.scores(at)
        score[at] = -1
        held += [shard[ids[j]] == shard[ids[at]] for j in np.argsort(-score)[:10]]
    sizes = np.array([n for n in {s: sum(x == s for x in shard.values()) for s in shard.values()}.values()])
    chance = float((sizes**2).sum()) / len(ids) ** 2
    assert sum(held) / len(held) > 2.5 * chance


def test_centroids_of_few_documents():
    none = Centroids(np.zeros((0, 2048), np.float32), 256)
    assert none.place(np.array([1, 2]), np.array([1.0, 1.0])) == 0
    one = Centroids(np.eye(16, 2048, dtype=np.float32), 2)
    assert 0 <= one.place(np.array([1]), np.array([1.0])) < 4
