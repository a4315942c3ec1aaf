import hashlib
import random

import numpy as np
import pytest

from mixweave.llm import piece_table as P
from mixweave.llm.queries import piece_model

ODD = list(" ▁a b\tc\nd  é漢\u3000\u200d\u00a0ﬁ\u0301😀.,%\x00\x85") + ["<s>", "</s>", "<unk>", "<0x0A>", "hello", "   "]


@pytest.fixture(scope="module")
def table():
    return P.ChunkTable(piece_model())


def check(table, texts):
    ids, offsets, decoded = table.encode(texts)
    for i, text in enumerate(texts):
        want = table.sp.encode(text, add_eos=True)
        assert list(ids[offsets[i] : offsets[i + 1]]) == want and decoded[i] == table.sp.decode(want)


def test_equals_the_library_on_odd_texts(table):
    rng = random.Random(5)
    assert table.splits
    check(table, ["", " ", "  ", "▁", " a", "a ", "a  b"] + ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 30))) for _ in range(4000)])
    check(table, [])


def test_forgetting_changes_nothing(table, monkeypatch):
    monkeypatch.setattr(P, "TABLE_ENTRIES", 5)
    small = P.ChunkTable(piece_model())
    for k in range(4):
        check(small, [f"word{i} again and{i + k} again" for i in range(20)])
    assert len(small.codes) < 70


def test_models_whose_pieces_cross_markers_are_encoded_whole(table):
    whole = P.ChunkTable(piece_model())
    whole.splits = False
    texts = ["some text", "", "  two  "]
    for a, b in zip(table.encode(texts), whole.encode(texts), strict=True):
        assert np.array_equal(a, b)


def test_decoding_any_ids(spark, table):
    rng = random.Random(6)
    rows = [(i, [rng.randrange(table.sp.get_piece_size()) for _ in range(12)]) for i in range(300)] + [(300, []), (301, [0, 1, 2]), (302, None), (303, [200, 201, 5])]
    out = P.decode(spark.createDataFrame(rows, "k int, ids array<int>"), piece_model()).collect()
    assert all(r["decoded"] == table.sp.decode(r["ids"] or []) for r in out)


def test_query_on_all_documents(spark, sf_dir, table):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = {r["doc_id"]: r for r in P.pieces_query(docs, piece_model()).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in docs.collect():
        ids = table.sp.encode(r["text"] or "", add_eos=True)
        got = out[r["doc_id"]]
        assert (got["n_tokens"], got["ids_sha256"], got["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(table.sp.decode(ids)))


def test_edges(docs_of, edges):
    docs = docs_of(edges, extra=True)
    out = P.encode_decode(docs, piece_model())
    rows = out.collect()
    assert set(out.columns) == set(docs.columns) and len(rows) == len(edges)
    assert [r["ids"] for r in rows if r["doc_id"] in (2, 3)] == [[2], [2]]
    assert P.pieces_query(docs.limit(0), piece_model()).count() == 0
