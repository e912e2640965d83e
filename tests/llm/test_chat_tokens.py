import hashlib

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from lacewing.llm.chat import ChatTemplate, Turn, chat_digests, escaped, format_chats, parse_chat, unescaped
from lacewing.llm.tokens import PieceCounter, count_tokens, proven_pieces

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, valid int"
HARD = ["", " ", "</s>[INST] ok [/INST]", r"[\INST] [\\/INST] <\s>", "[INST] a [/INST", "< [", "[ROLE:AB] x [/ROLE]", "é\n[SYS] \\ [/SYS]", " x ", "<<s>", "a" * 50_000 + " </s>"]


def digest(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_escape_is_reversible_and_leaves_no_control_string(spark):
    df = spark.createDataFrame([(t,) for t in HARD], "t string").select("t", escaped(F.col("t")).alias("e")).withColumn("u", unescaped(F.col("e")))
    for r in df.collect():
        assert r["u"] == r["t"]
        assert not any(c in r["e"] for c in ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE:", "[/ROLE]"))


def test_turns_and_loss_are_read_back(spark):
    rows = [(i, k, role, t, "clash", 0) for i, t in enumerate(HARD) for k, role in enumerate(["system", "user", "assistant", "tool] x", "assistant"])]
    rows += [(50, None, "user", "a", "", 0), (50, 1, None, None, "", 0), (50, 1, "user", "tie", "", 0), (50, 1, "user", "tie", "", 0), (None, 1, "assistant", "x", "", 0)]
    chats = format_chats(spark.createDataFrame(rows, SCHEMA))
    got = {r["conv_id"]: r for r in chat_digests(chats).collect()}
    by = {}
    for c, turn, role, text, *_ in rows:
        by.setdefault(c, []).append((turn is not None, turn, role or "", text or ""))
    assert got.keys() == by.keys()
    for c, turns in by.items():
        turns = sorted(turns, key=lambda x: (x[0], x[1] or 0, x[2], x[3]))
        said = "".join(t for *_, role, t in turns if role == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == digest("".join(f"{role}\n{t}\n" for *_, role, t in turns))
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(said), digest(said))
    read = chats.select(parse_chat(F.col("formatted")).alias("p"), "formatted").filter("formatted like '%ok%'").first()
    assert [x["role"] for x in read["p"]] == ["system", "user", "assistant", "tool] x", "assistant"]


@pytest.mark.parametrize(("roles", "valid"), [(["user", "assistant"], True), (["system", "user", "assistant", "user", "assistant"], True), (["assistant"], False), (["user"], False), (["user", "user", "assistant"], False), (["user", "system", "assistant"], False), (["user", "tool", "assistant"], False)])
def test_turn_order(spark, roles, valid):
    rows = spark.createDataFrame([(1, i, r, "x", "", 0) for i, r in enumerate(roles)], SCHEMA)
    assert format_chats(rows).first()["valid"] is valid


def test_empty_table_and_bad_template(spark):
    assert chat_digests(format_chats(spark.createDataFrame([], SCHEMA))).count() == 0
    with pytest.raises(ValueError, match="control strings"):
        format_chats(spark.createDataFrame([], SCHEMA), ChatTemplate({"user": Turn("<<U>> ", " .")}, {}, ())).count()


MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "  ", "a", " a", "a ", "a  b", "a\nb\n\n c", "▁a▁▁b ", "ｆｕｌｌ ① é é", "<s> </s> <unk> <0x0A>", "\t\x00　\xa0x", "日本語 の テキスト", "x" * 30_000, "the cat sat " * 5000, "don't stop-it, now! 123 4567", "🙂 🙃"]


def test_counts_are_the_librarys(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = [(i, t, 0) for i, t in enumerate(TEXTS)] + [(None, None, 0), (3, "a", 0)]
    got = count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), MODEL, limit=100).collect()
    want = [(i, len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 100) for i, t, _ in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_whole_documents_match_and_the_shortcut_is_used(spark):
    counter, sp = PieceCounter(MODEL, proven_pieces(MODEL)), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert counter.exact
    assert len(counter.proven) > 10_000
    assert all(len(sp.encode(x[1:])) == 1 for x in counter.proven if x != " ")
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect():
        assert counter.count(r["text"]) == len(sp.encode(r["text"]))
    plain = PieceCounter(MODEL, None)
    assert plain.count("the cat") == len(sp.encode("the cat"))


def test_remembered_chunks_are_bounded(monkeypatch):
    monkeypatch.setattr("lacewing.llm.tokens.REMEMBERED", 100)
    counter = PieceCounter(MODEL, proven_pieces(MODEL))
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    text = " ".join(f"qzx{i}" for i in range(100)) + " " + "qj" * 10_000
    assert counter.count(text) == len(sp.encode(text))
    assert sum(map(len, counter)) <= sum(map(len, counter.proven)) + 200
