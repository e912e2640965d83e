import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from lacewing.llm import components
from lacewing.llm.components import connected_components
from lacewing.llm.exact import DigestIndex, drop_exact_duplicates, exact_duplicates
from lacewing.llm.minhash import MinHash, _dealt, _merged, drop_near_duplicates, near_duplicates
from lacewing.llm.shingles import shingle_set

SCHEMA = "doc_id long, text string, key string, id long, digest string, n int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "k", 1, "d", 0) for i, t in rows], SCHEMA)


def squeeze(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


TEXTS = [None, "", " ", "\n\t", "a b", "a  b", "a\nb", " a b", "A b", "a\xa0b", "x" * 100_000]


def test_exact_matches_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(TEXTS)) for i in range(100, 400)] + [(400 + i, "hot") for i in range(200)]
    rng.shuffle(rows)
    groups = defaultdict(list)
    for i, t in rows:
        groups[squeeze(t)].append(i)
    got = {r["doc_id"]: r for r in exact_duplicates(table(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        r, g = got[i], groups[squeeze(t)]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (min(g), len(g), i == min(g))
        assert r["text_sha256"] == hashlib.sha256(squeeze(t).encode()).hexdigest()


def test_exact_repeated_rows_and_missing_ids(spark):
    rows = [(1, "a"), (1, "a"), (None, "a"), (None, "b"), (None, "b"), (2, "c")]
    got = Counter((r["doc_id"], r["text_sha256"][:4], r["kept"]) for r in exact_duplicates(table(spark, rows)).collect())
    a, b, c = (hashlib.sha256(x.encode()).hexdigest()[:4] for x in "abc")
    assert got == {(1, a, True): 1, (1, a, False): 1, (None, a, False): 1, (None, b, True): 1, (None, b, False): 1, (2, c, True): 1}
    kept = drop_exact_duplicates(table(spark, rows))
    assert kept.columns == ["doc_id", "text", "key", "id", "digest", "n"]
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == {(1, "a"): 1, (None, "b"): 1, (2, "c"): 1}
    assert exact_duplicates(table(spark, [])).count() == 0


def test_index_goes_on_between_batches_and_sessions(spark, tmp_path):
    path = str(tmp_path / "index")
    first = DigestIndex(spark, path, buckets=4)
    first.add(table(spark, [(5, "a"), (6, "b"), (7, "b")])).count()
    again = DigestIndex(spark, path, buckets=4)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in again.add(table(spark, [(1, "a"), (2, "c"), (3, "c"), (4, "b")])).collect()}
    assert got == {1: (5, 2, False), 2: (2, 2, True), 3: (2, 2, False), 4: (6, 3, False)}
    assert {r["keep_id"] for r in again.table().collect()} == {5, 6, 2}


def test_index_counts_the_copies_of_all_batches(spark):
    index = DigestIndex(spark, buckets=4)
    batches = [[(5, "a"), (None, "n")], [(1, "a"), (2, "a"), (3, "c")], [(4, "a"), (6, "c"), (7, "n")], [(8, "a"), (9, "n")]]
    got = [{r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in index.add(table(spark, b)).collect()} for b in batches]
    assert got[2] == {4: (5, 4, False), 6: (3, 2, False), 7: (None, 2, False)}
    assert got[3] == {8: (5, 5, False), 9: (None, 3, False)}
    assert sorted((r["keep_id"] or 0, r["copies"]) for r in index.table().collect()) == [(0, 3), (3, 2), (5, 5)]


def test_index_refuses_other_buckets_and_finds_its_own(spark, tmp_path):
    path = str(tmp_path / "index")
    docs = table(spark, [(i, f"t{i}") for i in range(50)])
    first = DigestIndex(spark, path, buckets=4)
    first.add(docs).count()
    first.close()
    with pytest.raises(ValueError, match="4 buckets, not 8"):
        DigestIndex(spark, path, buckets=8)
    again = DigestIndex(spark, path)
    assert again.buckets == 4
    assert again.add(docs).filter("kept").count() == 0
    again.close()
    spark.createDataFrame([(1,)], "a int").write.parquet(str(tmp_path / "other"))
    with pytest.raises(ValueError, match="not an index"):
        DigestIndex(spark, str(tmp_path / "other"))


def test_a_batch_given_again_has_the_same_verdicts(spark, tmp_path):
    index = DigestIndex(spark, str(tmp_path / "index"), buckets=4)
    index.add(table(spark, [(5, "a"), (6, "b")]), batch="one")
    rows = table(spark, [(1, "a"), (2, "c"), (3, "c")])
    verdicts = lambda: sorted(map(tuple, index.add(rows, batch="two").collect()))
    first = verdicts()
    assert verdicts() == first  # as after a lost driver
    assert [r[:4] for r in first] == [(1, 5, 2, False), (2, 2, 2, True), (3, 2, 2, False)]
    assert sorted((r["keep_id"], r["copies"]) for r in index.table().collect()) == [(2, 2), (5, 2), (6, 1)]
    index.close()


def test_nothing_is_left_in_the_catalog(spark):
    before = {t.name for t in spark.catalog.listTables()}
    exact_duplicates(table(spark, [(1, "a")])).count()
    assert {t.name for t in spark.catalog.listTables()} == before


@pytest.mark.parametrize("broadcast_rows", [1000, 0])
def test_clashing_columns_stay(spark, broadcast_rows):
    rows = [(1, "a", 7, "r", "s"), (2, "a", 7, "r", "s"), (3, "b", 7, "r", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __row long, row string, copies string")
    assert {(r["doc_id"], r["kept"]) for r in exact_duplicates(df).collect()} == {(1, True), (2, False), (3, True)}
    kept = drop_exact_duplicates(df, broadcast_rows=broadcast_rows)
    assert kept.columns == df.columns
    assert sorted(map(tuple, kept.collect())) == [rows[0], rows[2]]


def brute_components(edges, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        root[b] = a
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(-20, 300), rng.randrange(300)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 6000 + i) for i in range(100)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    nodes = {x for u, v in edges if u != v for x in (u, v)}
    assert got == brute_components([e for e in edges if e[0] != e[1]], nodes)
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("hubs", [1, 5, 10**6])
def test_components_of_hubs(spark, monkeypatch, hubs):
    monkeypatch.setattr(components, "HUBS", hubs)
    rng = random.Random(hubs)
    edges = [(rng.choice([0, 900, 901]), 1 + i) for i in range(600)] + [(2000 + i, 2001 + i) for i in range(40)] + [(3000, 3001)] * 5
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == brute_components(edges, {x for e in edges for x in e})


def brute_near(rows):
    sets = {i: set(shingle_set(t).tolist()) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), c) for i, c in brute_components(links, ids).items()}


def variants(rng, n, groups, length):
    rows = []
    for g in range(groups):
        base = [f"w{rng.randrange(4000)}" for _ in range(length)]
        for _ in range(n):
            words = list(base)
            for _ in range(rng.randrange(0, length // 12)):
                words[rng.randrange(length)] = f"v{rng.randrange(4000)}"
            rows.append(" ".join(words))
            if rng.random() < 0.3:
                base = words  # chains: ends may be linked only through others
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("seed", "block"), [(1, 1000), (2, 7), (3, 2)])
def test_near_matches_brute_force(spark, seed, block):
    rng = random.Random(seed)
    rows = variants(rng, 12, 12, 60) + [(1000 + i, t) for i, t in enumerate([None, "", "  ", "A b", "a B", "a b c", "One two three four five", "one two three four FIVE", "É é a b c d", "é é a b c d"])]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(table(spark, rows), MinHash(block=block)).collect()}
    assert got == brute_near(rows)


def test_near_duplicates_of_the_smallest_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(docs).collect()}
    assert got == {i: (n, c, i == c) for i, (n, c) in brute_near(rows).items()}


def test_near_repeated_rows_missing_ids_and_empty(spark):
    a, b = "p q r s t u v w", "k l m n o p q"
    rows = [(5, a), (5, a), (3, a), (None, a), (None, None), (9, None), (8, b), (5, b)]
    got = Counter(map(tuple, near_duplicates(table(spark, rows)).collect()))
    assert got == {(5, 4, 3, False): 2, (3, 4, 3, True): 1, (None, 4, None, True): 1, (None, 0, None, True): 1, (9, 0, 9, True): 1, (8, 3, 3, False): 1, (5, 3, 3, False): 1}
    assert near_duplicates(table(spark, [])).count() == 0
    assert {(r["doc_id"], r["key"]) for r in drop_near_duplicates(table(spark, rows)).collect()} == {(3, "k"), (None, "k"), (9, "k")}


def test_ids_can_be_joined_by_a_shuffle(spark):
    rows = variants(random.Random(4), 4, 3, 60)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(table(spark, rows), broadcast_ids=0).collect()}
    assert got == brute_near(rows)


@pytest.mark.parametrize("block", [1, 6, 40, 1000])
def test_blocks_hold_each_pair_across_components_once(spark, block):
    rng = random.Random(block)
    named = [(1, 0, i, 5 if i < 60 else 1000 + i % 9) for i in range(80)] + [(2, 1, i, i) for i in range(30)] + [(3, 1, i, 4) for i in range(50)] + [(4, 2, 100 + i, rng.randrange(3)) for i in range(12)]
    blocks = defaultdict(list)
    for r in _dealt(spark.createDataFrame(named, "key long, band int, id long, component long"), block).collect():
        blocks[r["key"], r["i"], r["j"]].append(r)
    met = Counter()
    for (key, i, j), rows in blocks.items():
        for x in rows:
            for y in rows:
                if x["id"] < y["id"] and x["component"] != y["component"] and (x["chunk"] != y["chunk"] or i == j):
                    met[key, x["id"], y["id"]] += 1
    want = {(k, a, b) for k, _, a, c in named for k2, _, b, d in named if k == k2 and a < b and c != d}
    assert set(met) == want
    assert set(met.values()) == {1}


def test_buckets_of_one_group_are_dealt_as_one(spark):
    # a group in every band, most of it one component; buckets that only have their least class in common; settled ones
    group = [(100 + b, b, i, 1 if i < 60 else i) for b in range(32) for i in range(1, 80) if i == 1 or (i + b) % 8]
    apart = [(200 + b, b, i, i) for b in range(4) for i in [1000, *range(1010 + 20 * b, 1030 + 20 * b)]]
    settled = [(300 + b, b, i, 2000) for b in range(4) for i in range(2000, 2050)]
    schema = "key long, band int, id long, component long"
    got = _merged(spark.createDataFrame(group + apart + settled, schema)).collect()
    assert Counter(r["id"] for r in got if r["id"] < 1000) == {i: 1 for i in range(1, 80)}
    assert sum(r["id"] >= 1000 for r in got) == len(apart)
    held = defaultdict(list)
    for r in got:
        for b in r["bands"]:
            held[r["key"], b].append((r["id"], r["component"]))
    buckets = defaultdict(list)
    for key, b, i, c in group + apart:
        buckets[key, b].append((i, c))
    assert sorted(map(sorted, held.values())) == sorted(map(sorted, buckets.values()))
    assert _dealt(_merged(spark.createDataFrame(group, schema)), 256).count() == 79


def test_near_of_very_long_texts_and_many_copies(spark):
    long = " ".join(f"w{i}" for i in range(200_000))
    rows = [(1, long), (2, long + " end"), (3, "x" * 1_500_000), (4, "x" * 1_500_000)] + [(10 + i, "a b c d e f g") for i in range(500)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(table(spark, rows)).collect()}
    assert got == {1: (199_996, 1), 2: (199_997, 1), 3: (1, 3), 4: (1, 3)} | {10 + i: (3, 10) for i in range(500)}
