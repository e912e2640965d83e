import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lacewing.llm.quality import host_verdicts, keep_good_documents, quality_rules
from lacewing.llm.sharding import BestFitTree, best_fit_decreasing, equal_bins, shard_documents

SCHEMA = "doc_id long, text string, source string, shard int, kept string"


def test_tree_finds_the_tightest_bin():
    rng, tree, held = random.Random(1), BestFitTree(), set()
    for step in range(3000):
        if held and rng.random() < 0.45:
            key = rng.choice(sorted(held))
            held.remove(key)
            tree.delete(key)
        else:
            key = (rng.randrange(100), step)
            held.add(key)
            tree.insert(key)
        need = rng.randrange(110)
        assert tree.tightest(need) == min((k for k in held if k[0] >= need), default=None)


def brute_best_fit(sizes, capacity):
    bins, out = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [(left, b) for b, left in enumerate(bins) if left >= sizes[i]]
        if not fits:
            bins.append(max(capacity, sizes[i]))
            fits = [(bins[-1], len(bins) - 1)]
        b = min(fits)[1]
        bins[b] -= sizes[i]
        out[i] = b
    return [out[i] for i in range(len(sizes))]


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_decreasing(seed):
    rng = random.Random(seed)
    sizes = [rng.randrange(1, 60) for _ in range(200)] + [150]
    assert best_fit_decreasing(sizes, 100) == brute_best_fit(sizes, 100)
    filled = Counter()
    for s, b in zip(sizes, equal_bins(sizes, 7), strict=True):
        filled[b] += s
    assert max(filled.values()) - min(filled.values()) <= 0.02 * sum(sizes) / 7


def documents(spark, n=3000, seed=3):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice(["aa", "bé", "c"]) for _ in range(rng.randrange(80))) for _ in range(n // 3)]
    rows = [(i, rng.choice(pool), "s", 0, "x") for i in range(n)] + [(n + i, "hot", "s", 0, "x") for i in range(n // 2)]
    rows += [(None, None, None, None, None), (n + 10**6, "", "s", 0, "x"), (5, "again", "s", 0, "x"), (5, "again", "s", 0, "x")]
    return spark.createDataFrame(rows, SCHEMA), rows


@pytest.mark.parametrize("bundles", [64, 8192])
def test_shards_are_whole_equal_and_gapless(spark, bundles):
    df, rows = documents(spark)
    got = shard_documents(df, 8, bundles=bundles, parts=4).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    of_text, filled, slots = defaultdict(set), Counter(), defaultdict(list)
    for r in got:
        of_text[r["text_crc32"], r["size"]].add(r["shard"])
        filled[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(len(x) == 1 for x in of_text.values())
    assert sorted(filled) == list(range(8))
    assert max(filled.values()) - min(filled.values()) <= 0.05 * max(filled.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_fixed_capacity_and_empty(spark):
    df, rows = documents(spark, 600)
    filled = Counter()
    for r in shard_documents(df, capacity=4000).collect():
        filled[r["shard"]] += r["size"]
    assert max(filled.values()) <= 4000
    assert len(filled) <= sum(filled.values()) // 4000 + 2
    assert shard_documents(df.limit(0)).count() == 0


def test_capacity_holds_where_bundles_would_not_fit(spark):
    # 40,000 groups of 101 bytes in 16 bundles: a bundle is far over the capacity
    df = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lpad(F.col("id").cast("string"), 100, "x").alias("text"))
    for capacity in (2020, 10_100):
        filled = Counter()
        rows = shard_documents(df, capacity=capacity, bundles=16).collect()
        for r in rows:
            filled[r["shard"]] += r["size"]
        assert len(rows) == 40_000
        assert max(filled.values()) <= capacity
        assert sorted(filled) == list(range(len(filled)))
        assert len(filled) <= 1.03 * 40_000 * 101 / capacity


def brute_rules(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\v\f\r")]
    windows = defaultdict(list)
    for i in range(len(words) - 4):
        windows[tuple(words[i : i + 5])].append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    n, chars, symbols, again = len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines))
    broken = (n < 10 or 100 * len(covered) > 20 * n, 10 * symbols > n, 10 * again > 3 * len(lines), chars < 3 * n or chars > 10 * n)
    return n, chars, symbols, len(lines), again, len(covered), *broken


def brute_kept(rows):
    """Verdicts on (text, host) pairs."""
    broken = [brute_rules(t)[6:] for t, _ in rows]
    n, failed = Counter(h for _, h in rows), [Counter(h for b, (_, h) in zip(broken, rows, strict=True) if b[k]) for k in range(4)]
    rejected, trusted = set(), [set() for _ in range(4)]
    for k in range(4):
        rates = [failed[k][h] / n[h] for h in n]
        m = sum(rates) / len(rates)
        v = sum((x - m) ** 2 for x in rates) / (len(rates) - 1) if len(rates) > 1 else 0
        s = max(m * (1 - m) / v - 1, 1) if v > 0 else 1
        for h in n:
            p = (failed[k][h] + m * s) / (n[h] + s)
            spread = math.sqrt(p * (1 - p) / (n[h] + s + 1))
            if p - spread > 0.5:
                rejected.add(h)
            if p + spread < m:
                trusted[k].add(h)
    return [not b[0] and h not in rejected and not any(b[k] and h not in trusted[k] for k in (1, 2, 3)) for b, (_, h) in zip(broken, rows, strict=True)]


def test_rules_match_brute_force(spark):
    rng = random.Random(5)
    texts = [None, "", " \n\t ", "a", "a b c d e", "a a a a a a", "x\ny\nx\n \n \nx", "é # * \x0b & <é> \xa0 q　r"]
    texts += [" ".join(rng.choice("abcd") for _ in range(rng.randrange(40))) for _ in range(200)]
    texts += ["\n".join(rng.choice(["one two three four five", "six seven", "", " "]) for _ in range(12)) for _ in range(50)] + [" ".join(f"w{i}" for i in range(20_000)) + " w1 w2 w3 w4 w5 w6"]
    df = spark.createDataFrame([(i, t, f"h{i % 3}", 0, "x") for i, t in enumerate(texts)], SCHEMA)
    for r in quality_rules(df).collect():
        assert tuple(r)[2:12] == brute_rules(texts[r["doc_id"]]), texts[r["doc_id"]]


def hosted():
    """Pages of clean, spam, careful and careless hosts, and small ones."""
    good = lambda i: " ".join(f"wd{i}x{k}" for k in range(30))
    marked = lambda i: good(i).replace("x", "#x")
    rows = [(i, good(i) if i % 20 else "short", "clean", 0, "") for i in range(400)] + [(1000 + i, "short" if i % 50 else good(i), "spam", 0, "") for i in range(300)]
    rows += [(2000 + i, good(i), f"small{i}", 0, "") for i in range(20)] + [(3000, "short", "tiny", 0, ""), (3001, good(1), None, 0, ""), (3001, good(1), None, 0, ""), (3002, None, None, 0, "")]
    rows += [(4000 + i, marked(i) if i % 5 else good(i), "careless", 0, "") for i in range(100)]
    rows += [(5000 + i, marked(i) if i % 2 else good(i), "mixed", 0, "") for i in range(100)]
    return rows + [(6000 + i, good(i) if i % 200 else marked(i), "careful", 0, "") for i in range(600)]


@pytest.mark.parametrize("broadcast_hosts", [100, 0])
def test_hosts_are_judged_by_shrunk_rates(spark, broadcast_hosts):
    rows = hosted()
    df = spark.createDataFrame(rows, SCHEMA)
    out = quality_rules(df, broadcast_hosts=broadcast_hosts)
    got = out.collect()
    kept = Counter((r["source"], r["kept"]) for r in got)
    assert kept["clean", True] == 380
    assert kept["spam", True] == 0
    assert kept["spam", False] == 300
    assert kept["careless", True] == 0  # its clean pages go with it
    assert kept["mixed", True] == 50
    assert kept["careful", True] == 600  # its marked pages have the benefit of the doubt
    assert kept[None, True] == 2
    assert sum(kept.values()) == len(rows)
    assert any(r["kept"] == r["base_failed"] for r in got)
    want = Counter((r[0], r[2], k) for r, k in zip(rows, brute_kept([r[1:3] for r in rows]), strict=True))
    assert Counter((r["doc_id"], r["source"], r["kept"]) for r in got) == want
    stay = keep_good_documents(df, broadcast_hosts=broadcast_hosts)
    assert stay.columns == df.columns
    assert Counter(map(tuple, stay.collect())) == Counter(r for r, k in zip(rows, brute_kept([r[1:3] for r in rows]), strict=True) if k)
    rates = {r["source"]: r["rate_base_failed"] for r in host_verdicts(out).collect()}
    assert rates["small1"] > 0
    assert rates["tiny"] < 1
    assert quality_rules(df.limit(0)).count() == 0
    assert keep_good_documents(df.limit(0)).count() == 0


def test_rules_of_tables_with_clashing_columns(spark):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(30)), "h", i, "x", "y") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_words long, __row string, __host string")
    assert quality_rules(df).filter("kept").count() == 5
    stay = keep_good_documents(df)
    assert stay.columns == df.columns
    assert sorted(map(tuple, stay.collect())) == rows
