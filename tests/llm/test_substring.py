import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from lacewing.llm.substring import BUCKET_BYTES, Cover, Layout, remove_repeats

SCHEMA = "doc_id long, text string, id long, tag string, at int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], SCHEMA)


def brute(rows, window):
    """The contract, literally: rows sorted by id (null first), windows seen so far."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    key = lambda i: (i is not None, i or 0)
    first = {}
    for (i, _), w in zip(rows, words, strict=True):
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            first[k] = min(first.get(k, ((2, 0), 0)), (key(i), s))
    out = Counter()
    for (i, _), w in zip(rows, words, strict=True):
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < (key(i), s):
                gone |= set(range(s, s + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept] += 1
    return out


def corpus(seed, n=120):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + rng.choice("xyzé")
    passages = [[word() for _ in range(rng.randrange(15, 70))] for _ in range(6)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(rng.randrange(6)):
            w += rng.choice(passages) if rng.random() < 0.5 else [word() for _ in range(rng.randrange(30))]
            if rng.random() < 0.2:
                w += ["r"] * rng.randrange(60)
        rows.append((i - 20, rng.choice([" ", "\n", " \t"]).join(w)))
    rows += [(None, None), (None, " ".join(passages[0])), (500, rows[7][1]), (500, rows[7][1]), (501, ""), (502, " "), (503, rows[9][1]), (503, rows[11][1] + " z " + rows[9][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "chunk", "limit"), [(1, 1 << 20, 1000), (2, 50, 1000), (3, 50, 0)])
def test_matches_brute_force(spark, seed, chunk, limit, monkeypatch):
    monkeypatch.setattr("lacewing.llm.substring.CHUNK", chunk)
    rows = corpus(seed)
    got = Counter(map(tuple, remove_repeats(table(spark, rows).repartition(5), layout=Layout(5, 17), broadcast_ids=limit).collect()))
    assert got == brute(rows, 20)


def test_other_covers(spark):
    rows = corpus(4, 60)
    for cover in (Cover(8, 7, (1, 2, 4)), Cover(3, 3, (0, 1))):
        assert Counter(map(tuple, remove_repeats(table(spark, rows), cover).collect())) == brute(rows, cover.window)
    with pytest.raises(ValueError, match="difference cover"):
        Cover(20, 13, (0, 1, 2, 3))


def test_each_pair_of_windows_shares_an_aligned_anchor():
    c = Cover()
    for a in range(13):
        for b in range(13):
            assert any((a + k) % 13 in c.members and (b + k) % 13 in c.members for k in range(13))
    at, hashes = c.anchors(np.arange(100, dtype=np.uint64))
    assert at.tolist() == [i for i in range(93) if i % 13 in c.members]
    assert len(set(hashes.tolist())) == len(at)


def test_one_long_document_and_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(50_000))
    rows = [(1, text), (2, "start " + text + " end")]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in remove_repeats(table(spark, rows)).collect()}
    assert got == {1: (50_000, 0, text), 2: (50_002, 50_000, "start end")}
    assert remove_repeats(table(spark, [])).count() == 0


def test_smallest_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert Counter(map(tuple, remove_repeats(docs).collect())) == brute(rows, 20)


def test_buckets_stay_small_as_the_corpus_grows():
    assert Layout.of(0, 8) == Layout(8, 8)
    for size in (10**6, 10**9, 30 * 10**9, 10**14):
        layout = Layout.of(size, 51)
        assert size / layout.buckets <= BUCKET_BYTES
        assert 51 <= layout.parts <= max(51, 1 << 16)
        assert layout.buckets < 1 << 31
