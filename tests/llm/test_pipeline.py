import random
from collections import Counter

import corpus_pipeline
import public_tokenizers
from test_duplicates import brute_near, squeeze
from test_mixing import poisson, uniform
from test_sharding_quality import brute_kept
from tokenizers import Tokenizer

from lacewing.llm.packing import pack_documents

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_quality(rows):
    return [r for r, kept in zip(rows, brute_kept([(r[1], r[3]) for r in rows]), strict=True) if kept]


def brute(rows):
    yield (rows := brute_quality(rows))
    first = {}
    for r in rows:
        first[squeeze(r[1])] = min(first.get(squeeze(r[1]), r), r)
    yield (rows := list(first.values()))
    of = brute_near([r[:2] for r in rows])
    yield (rows := [r for r in rows if of[r[0]][1] == r[0]])
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(r[1].encode()) + 1
    weights = {s: n**0.7 for s, n in sizes.items()}
    rate = {s: w / sum(weights.values()) * sum(sizes.values()) / sizes[s] for s, w in weights.items()}
    yield [r for r in rows for _ in range(poisson(rate[r[3]], uniform(1, "draw", r[0], 1)))]


def documents(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(*corpus_pipeline.COLUMNS).collect()]
    rng = random.Random(1)
    rows += [(10_000 + i, " ".join(rng.choice("ab") for _ in range(5)), "en", "junk", 9) for i in range(50)]
    rows += [(20_000 + i, f"{rows[i][1]}\n ", "en", "src1", 9) for i in range(20)]
    rows += [(30_000 + i, " ".join([*rows[i][1].split(), "more"]), "en", "src2", 9) for i in range(20)]
    return rows


def test_each_stage_matches_brute_force(spark, tmp_path):
    rows = documents(spark)
    docs = spark.createDataFrame(rows, SCHEMA)
    for (name, stage), want in zip(corpus_pipeline.STAGES[:-1], brute(rows), strict=True):
        stage(spark, docs, "").write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == corpus_pipeline.COLUMNS, name
        assert Counter(map(tuple, docs.collect())) == Counter(want), name
        assert 0 < len(want), name
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    total = Counter()
    for r in docs.collect():
        total[r["doc_id"]] += len(t.encode(r["text"], add_special_tokens=False).ids) + 1
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    held, filled = Counter(), Counter()
    for r in packed:
        held[r["doc_id"]] += r["length"]
        filled[r["sequence_id"]] += r["length"]
    assert held == total
    assert max(filled.values()) <= 1024


def test_run_gives_the_last_stage_and_handles_no_rows(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == pack_documents(spark.createDataFrame([], SCHEMA), public_tokenizers.path("byte_bpe_50k.json")).columns
    assert out.count() > 0


def test_stages_are_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "near dedup", "mixing", "packing"]
