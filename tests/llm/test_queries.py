"""The registered queries themselves, over the smallest tables."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from test_duplicates import brute_near
from test_sharding_quality import brute_kept
from test_substring import brute as brute_repeats
from tokenizers import Tokenizer

from lacewing.llm import queries as Q

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return sorted((r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect())


def ids_of(file, text, end):
    t = Tokenizer.from_file(public_tokenizers.path(file))
    return [*t.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op1(spark):
    got = {r["conv_id"]: r for r in Q.op1_chat_formatting(spark, SMALL).collect()}
    said = "</s>[INST] ok [/INST]"
    assert got[-1]["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert got[-1]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{SMALL}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns[r["conv_id"]].append((r["role"], r["text"] or ""))
    assert set(got) == {-1, *turns}
    for c, t in turns.items():
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in t).encode()).hexdigest()


def test_op2(spark, rows):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {(i, len((t or "").encode()), n := len(sp.encode(t or "")), n > 4096) for i, t, _ in rows}
    assert set(map(tuple, Q.op2_token_counts(spark, SMALL).collect())) == want


def test_op3(spark, rows):
    got = Q.op3_sharding(spark, SMALL).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "bytes", None) for i, t, _ in rows)
    slots, filled = defaultdict(list), Counter()
    for r in got:
        slots[r["shard"]].append(r["slot"])
        filled[r["shard"]] += r["size"]
    assert set(slots) <= set(range(16))
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    largest = max(len((t or "").encode()) + 1 for _, t, _ in rows)
    assert max(filled.values()) - min(filled.values()) <= largest


def test_op4(spark, rows):
    got = {r["doc_id"]: r["kept"] for r in Q.op4_quality_rules(spark, SMALL).collect()}
    assert got == dict(zip([r[0] for r in rows], brute_kept([r[1:] for r in rows]), strict=True))


def test_op5(spark, rows):
    want, before = set(), 0
    for i, t, _ in rows:
        ids = ids_of("word_bpe_49k.json", t, 1)
        want.add((i, before, len(ids), crc(ids)))
        before += len(ids)
    assert set(map(tuple, Q.op5_token_files(spark, SMALL).collect())) == want


def test_op6(spark, rows):
    want = Counter({x[:4]: n for x, n in brute_repeats([r[:2] for r in rows], 20).items()})
    assert Counter(map(tuple, Q.op6_substring_dedup(spark, SMALL).collect())) == want


def test_op7(spark, rows):
    ids = {i: ids_of("byte_bpe_50k.json", t, 0) for i, t, _ in rows}
    pieces, seats = defaultdict(list), defaultdict(list)
    for r in Q.op7_packing(spark, SMALL).collect():
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert (r["ids_crc32"], r["doc_tokens"], len(part)) == (crc(part), len(ids[r["doc_id"]]), r["length"])
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        seats[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, x in ids.items():
        assert [s for s, _ in sorted(pieces[i])] == [0, *np.cumsum([n for _, n in sorted(pieces[i])]).tolist()[:-1]]
        assert sum(n for _, n in pieces[i]) == len(x)
    assert sorted(seats) == list(range(len(seats)))
    for x in seats.values():
        x.sort()
        assert [o for o, _ in x] == [0, *np.cumsum([n for _, n in x]).tolist()[:-1]]
        assert sum(n for _, n in x) <= 1024
    assert len(seats) <= 1.02 * sum(map(len, ids.values())) / 1024 + 1


def test_op8(spark, rows):
    got = Q.op8_mixing(spark, SMALL).collect()
    assert sorted(r["position"] for r in got) == list(range(len(got)))
    assert {r["doc_id"] for r in got} <= {r[0] for r in rows}
    assert all(0 <= r["copy"] < r["copies"] for r in got)


def test_op9(spark, rows):
    got = {r["doc_id"]: r for r in Q.op9_exact_dedup(spark, SMALL).collect()}
    groups = defaultdict(list)
    for i, r in got.items():
        groups[r["text_sha256"]].append(i)
    assert len(got) == len(rows)
    for g in groups.values():
        assert {(got[i]["keep_id"], got[i]["group_size"]) for i in g} == {(min(g), len(g))}
        assert [i for i in g if got[i]["kept"]] == [min(g)]


def test_op10(spark, rows):
    want = {i: (n, c, i == c) for i, (n, c) in brute_near([r[:2] for r in rows]).items()}
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in Q.op10_minhash_near_dedup(spark, SMALL).collect()} == want
