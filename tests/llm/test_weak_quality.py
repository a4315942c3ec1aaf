from collections import Counter

import numpy as np
import pytest

from mixweave.llm import weak_quality as Q


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    out = Q.quality_query(spark.read.parquet(f"{folder}/documents.parquet"))
    rows = out.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    good, bad = [r["keep"] for r in rows if r["quality"] == 1], [r["keep"] for r in rows if r["quality"] == 0]
    assert np.mean(good) > 0.995 and np.mean(bad) < 0.03


def test_em_finds_accuracies():
    rng = np.random.default_rng(0)
    counts = {}
    for _ in range(20_000):
        good = rng.random() < 0.8
        votes = "".join(("+" if rng.random() < 0.9 else "0") if good else ("-" if rng.random() < p else "+") for p in (0.9, 0.7, 0.8))
        counts[votes] = counts.get(votes, 0) + 1
    rate, share, posterior = Q.fit_votes(counts)
    assert abs(share - 0.8) < 0.05 and posterior["+++"] > 0.9 and posterior["---"] < 0.01
    assert np.all(np.abs(rate[:, 0] - [0.9, 0.7, 0.8]) < 0.1)


@pytest.mark.parametrize(("alarms", "hits"), [((0.1, 0.02, 0.02, 0.02), (0.9, 0.7, 0.8, 0.8)), ((0.05, 0.05, 0.05), (0.7, 0.7, 0.7))])
def test_em_finds_accuracies_on_both_sides(alarms, hits):
    rng = np.random.default_rng(0)
    good = rng.random(20_000) < 0.8
    accused = rng.random((20_000, len(alarms))) < np.where(good[:, None], alarms, hits)
    counts = dict(Counter("".join("+-"[x] for x in row) for row in accused.astype(int)))
    rate, share, posterior = Q.fit_votes(counts)
    assert abs(share - 0.8) < 0.02 and np.abs(rate[:, 1] - alarms).max() < 0.01 and np.abs(rate[:, 0] - hits).max() < 0.03
    if alarms[0] == 0.1:
        assert posterior["-+++"] > 0.9  # only the noisiest labeller accuses


def test_em_separates_kinds_of_bad_documents():
    """Two kinds that different labellers see, one of them often seen by a single labeller alone."""
    posterior = Q.fit_votes({"++++": 9000, "--++": 400, "++--": 240, "++-0": 90, "+++0": 110})[2]
    assert posterior["++++"] > 0.99 and posterior["+++0"] > 0.9 and max(posterior[p] for p in ("--++", "++--", "++-0")) < 0.05


def test_the_scorer_is_fitted_on_few_rows_however_often_they_repeat(docs_of):
    docs = docs_of([(None, "The same words again and again in this text.", "a")] * 500 + [(i, f"A text with number {i} in it.", "a") for i in range(100)])
    voted = Q.vote_docs(docs, fit_docs=100_000).where("at is not null")
    assert voted.count() == 600 and voted.dropDuplicates(["text_hash"]).count() == 101


def test_abstentions_are_no_evidence():
    posterior = Q.fit_votes({"+++": 900, "+00": 20, "000": 5, "--+": 60, "-++": 15})[2]
    assert posterior["+00"] > 0.9 and posterior["000"] > 0.5 and posterior["--+"] < 0.01


def test_a_corpus_without_bad_votes_is_kept(docs_of):
    docs = docs_of([(i, f"A plain sentence number {i} about nothing in particular, really.", "a") for i in range(40)])
    assert all(r["keep"] for r in Q.classify(docs).collect())


def test_edges(docs_of, edges):
    docs = docs_of([*edges, *[(100 + i, f"An ordinary text with the words of number {i} and some more.", "a") for i in range(30)]], extra=True)
    out = Q.classify(docs)
    rows = {r["doc_id"]: r for r in out.collect()}
    assert set(out.columns) == set(docs.columns) and out.count() == len(edges) + 30
    assert [rows[i]["score"] for i in (2, 3, 5)] == [0.0] * 3 and not rows[2]["keep"]
    assert not rows[6]["keep"] and rows[1]["keep"] and rows[None]["keep"]
    assert Q.classify(docs.limit(0)).count() == 0
