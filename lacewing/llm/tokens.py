"""Token counts with a whole-token shortcut.

A BPE model whose pieces never have a space mark after another character cannot merge
across the start of a run of spaces, so each such chunk is counted alone. Which chunks
are one token is proved once, before the job, by encoding every piece of the vocabulary.
The proven pieces, a part of the vocabulary, are broadcast and counted by lookup; only the
rest is merged by the library.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Characters of chunks remembered per worker beside the vocabulary; then the memory is emptied.
REMEMBERED = 1 << 22
#: Longer chunks are counted anew each time.
LONGEST_REMEMBERED = 64


def proven_pieces(path: str) -> list[str] | None:
    """The chunks that the model encodes as one token each; None if chunks can't be counted alone.

    They can if no piece crosses the start of a run of spaces, and text is taken as it is.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces) or model.normalize("  A  ａ\n ") != f"{MARK * 3}A{MARK * 2}ａ\n{MARK}":
        return None
    if model.id_to_piece(model.piece_to_id(MARK)) != MARK:
        return None
    ids = model.encode([p[1:].replace(MARK, " ") for p in pieces], num_threads=1)
    return [" "] + [p.replace(MARK, " ") for i, p in enumerate(pieces) if p != MARK and p.startswith(MARK) and ids[i] == [i]]


class PieceCounter(dict):
    """Chunk -> number of tokens. ``proven`` single tokens stay; others are counted when missed."""

    def __init__(self, path: str, proven: list[str] | None) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.exact, self.proven, self.held = proven is not None, dict.fromkeys(proven or [], 1), 0
        super().__init__(self.proven)

    def __missing__(self, chunk: str) -> int:
        n = len(self.model.encode(chunk[1:], num_threads=1))
        if len(chunk) <= LONGEST_REMEMBERED:
            if self.held > REMEMBERED:
                self.clear()
                self.update(self.proven)
                self.held = 0
            self.held += len(chunk)
            self[chunk] = n
        return n

    chunks = re.compile(" +[^ ]*").findall

    def count(self, text: str) -> int:
        if not self.exact:
            return len(self.model.encode(text, num_threads=1))
        if not text:
            return 0
        return sum(map(self.__getitem__, self.chunks(" " + text.replace(MARK, " "))))


_counters: dict[str, PieceCounter] = {}


def count_tokens(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` of each row of ``docs(doc_id, text)``.

    Counts are those of the library for whole texts, without added tokens; ``model`` is
    a path that every worker can read. Null text counts as empty (0 tokens). Very long texts
    are counted whole; what a worker remembers is bounded in characters. Rows with a
    null or repeated ``doc_id`` are counted each; other columns are ignored; an empty
    table gives no rows. One narrow pass: nothing is shuffled.
    """
    proven = docs.sparkSession.sparkContext.broadcast(proven_pieces(model))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model not in _counters:
            _counters[model] = PieceCounter(model, proven.value)
        counter = _counters[model]
        for b in batches:
            n = [counter.count(t) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    out = plain.mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
