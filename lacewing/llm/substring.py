"""Removal of repeated runs of words, found by difference-cover anchors.

A window is ``window`` consecutive words. Positions in the cover modulo ``period`` are
anchors, hashed over the ``window - period + 1`` words from there: by the cover's
property two equal windows, wherever they start, hold an equal anchor at the same
distance from their starts. So

1. anchors are counted: only those that occur twice point at candidates. A task sends
   each different anchor once, so a passage in a third of all documents costs a task one
   row, not one for each document;
2. around shared anchors, all windows that hold one (the extension) are hashed with 96
   bits, and the least (document, start) of equal ones is found, again combined per task
   before the shuffle. All others are repeats;
3. words under a repeat go.

Rows travel as packed arrays, one per task and bucket of hashes. A worker holds a bucket at
a time; the number of buckets follows the size of the corpus, so that a bucket stays small
however much a partition holds. Texts are read again in each step instead of carried.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacewing.llm.minhash import _groups
from lacewing.llm.shingles import mixed, windows, word_hashes
from lacewing.session import tidy, written

#: Ids that are broadcast to pick their texts; more are joined by a shuffle.
BROADCAST_IDS = 200_000
#: Rows that a task gathers before it packs and sends them.
CHUNK = 1 << 20
LOWEST = -(1 << 63)
#: Bytes of text whose hashes a bucket gets at most, about, and most partitions made for that.
BUCKET_BYTES, MOST_PARTS = 32 << 20, 1 << 16


@dataclass(frozen=True)
class Layout:
    """Shuffle partitions, and buckets of hashes in them: a bucket's partition is its number modulo ``parts``."""

    parts: int
    buckets: int

    @classmethod
    def of(cls, text_bytes: int, parts: int) -> Layout:
        """For a corpus of ``text_bytes``, in at least ``parts`` partitions, of as many buckets each."""
        least = -(-text_bytes // BUCKET_BYTES)
        parts = max(parts, min(least, MOST_PARTS))
        return cls(parts, parts * max(1, -(-least // parts)))

    def dealt(self, rows: DataFrame, *order: str) -> DataFrame:
        # by number, not by its hash: that would put several buckets into one task and none into another
        return rows.repartitionById(self.parts, (F.col("bucket") % self.parts).cast("int")).sortWithinPartitions("bucket", *order)


@dataclass(frozen=True)
class Cover:
    """The window, and a difference cover: each difference modulo ``period`` is one of two of its members."""

    window: int = 20
    period: int = 13
    members: tuple[int, ...] = (0, 1, 3, 9)

    def __post_init__(self) -> None:
        found = {(a - b) % self.period for a in self.members for b in self.members}
        if len(found) < self.period or self.window < self.period:
            raise ValueError("not a difference cover of a period within the window")

    @property
    def anchor(self) -> int:
        return self.window - self.period + 1

    def anchors(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of the anchors of a document's word hashes."""
        all_of = windows(hashes, self.anchor)
        at = np.flatnonzero(np.isin(np.arange(self.period), self.members)[np.arange(len(all_of)) % self.period])
        return at, all_of[at]

    def candidates(self, shared: np.ndarray, words: int) -> np.ndarray:
        """Starts of the windows that hold one of the anchors at ``shared`` in their first ``period`` places."""
        starts = max(words - self.window + 1, 0)
        shared = shared[shared < words]  # rows with equal ids see each other's
        change = np.zeros(words + 2, np.int64)
        np.add.at(change, np.maximum(shared - self.period + 1, 0), 1)
        np.add.at(change, shared + 1, -1)
        return np.flatnonzero(np.cumsum(change)[:starts] > 0)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def _packed(head: tuple, bucket: np.ndarray, columns: list[np.ndarray], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """A row per bucket: the bucket, ``head``, and the packed columns of its rows, in their order."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    rows = [(int(bucket[part[0]]), *head, *[c[part].tobytes() for c in columns]) for part in np.split(order, cuts) if len(part)]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _joined(groups: pa.Table, column: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(groups.column(column).to_pylist()), kind)


#: How places in documents travel back: packed by a hash of the document.
FOUND = pa.schema([("bucket", pa.int32()), ("id", pa.binary()), ("tag", pa.binary()), ("place", pa.binary())])


def _found(pieces: Iterator[list[np.ndarray]], buckets: int) -> Iterator[pa.RecordBatch]:
    """Found (ids, tags, places), packed by document in chunks."""
    held, n = [], 0
    for piece in pieces:
        held.append(piece)
        n += len(piece[0])
        if n >= CHUNK:
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            yield from _packed((), columns[0] % buckets, columns, FOUND)
            held, n = [], 0
    if n:
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        yield from _packed((), columns[0] % buckets, columns, FOUND)


def _by_document(found: DataFrame, layout: Layout) -> DataFrame:
    """``(id, tag, places)``: a row per document of all its packed places."""
    out = pa.schema([("id", pa.int64()), ("tag", pa.int64()), ("places", pa.binary())])

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, 1):
            ids, tags, places = _joined(g, "id", "<i8"), _joined(g, "tag", "<i8"), _joined(g, "place", "<u4")
            order = np.lexsort((places, tags, ids))
            ids, tags, places = ids[order], tags[order], places[order]
            cuts = np.flatnonzero((ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1])) + 1
            starts = np.concatenate([[0], cuts])
            yield pa.RecordBatch.from_arrays([pa.array(ids[starts]), pa.array(tags[starts]), pa.array([x.tobytes() for x in np.split(places, cuts)], pa.binary())], schema=out)

    return layout.dealt(found).mapInArrow(gathered, "id long, tag long, places binary")


def _gathered(batches: Iterator[pa.RecordBatch], rows_of: Callable, flush: Callable) -> Iterator[pa.RecordBatch]:
    """Collect ``rows_of(row)`` of each row and hand them to ``flush`` in chunks."""
    held, n = [], 0
    for b in batches:
        for at in range(0, b.num_rows, 256):
            for row in zip(*(c.to_pylist() for c in b.slice(at, 256).columns), strict=True):
                if (x := rows_of(*row)) is not None and len(x[0]):
                    held.append(x)
                    n += len(x[0])
                if n >= CHUNK:
                    yield from flush([np.concatenate(c) for c in zip(*held, strict=True)])
                    held, n = [], 0
    if held:
        yield from flush([np.concatenate(c) for c in zip(*held, strict=True)])


def shared_anchors(docs: DataFrame, cover: Cover, layout: Layout) -> DataFrame:
    """``(id, places)``: for documents of ``docs(id, text)`` packed positions of anchors that occur twice or more."""
    buckets = layout.buckets
    schema = pa.schema([("bucket", pa.int32()), ("known", pa.bool_()), *[(n, pa.binary()) for n in ("hash", "id", "at", "alone")]])

    def of_document(id: int, text: str | None):
        words = _words(text)
        if len(words) < cover.window:
            return None
        at, hashes = cover.anchors(word_hashes(words))
        return hashes, np.full(len(at), id, np.int64), at.astype(np.uint32)

    def flush(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        hashes, ids, at = columns
        _, first, which, counts = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        again = counts[which] > 1  # shared already: nobody has to be asked
        empty = np.zeros(int(again.sum()), "V0")
        yield from _packed((True,), ids[again] % buckets, [empty, ids[again], at[again], empty], schema)
        first = np.sort(first)
        yield from _packed((False,), (hashes[first] >> np.uint64(33)).astype(np.int64) % buckets, [hashes[first], ids[first], at[first], (~again[first]).astype(np.uint8)], schema)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _gathered(batches, of_document, flush)

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        for g in _groups(batches, 2):
            ids, at = _joined(g, "id", "<i8"), _joined(g, "at", "<u4")
            if not g.column("known")[0].as_py():
                hashes, alone = _joined(g, "hash", "<u8"), _joined(g, "alone", "<u1")
                _, which = np.unique(hashes, return_inverse=True)
                again = (np.bincount(which, 2.0 - alone)[which] > 1) & (alone > 0)
                ids, at = ids[again], at[again]
            yield [ids, np.zeros(len(ids), np.int64), at]

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _found(shared(batches), buckets)

    sent = docs.select("id", "text").mapInArrow(asked, "bucket int, known boolean, hash binary, id binary, at binary, alone binary")
    found = layout.dealt(sent, "known").mapInArrow(answered, "bucket int, id binary, tag binary, place binary")
    return _by_document(found, layout).select("id", "places")


def repeated_windows(docs: DataFrame, cover: Cover, layout: Layout) -> DataFrame:
    """``(id, tag, places)``: packed starts of the windows that also start earlier.

    ``docs(id, tag, text, places)`` has the shared anchors of its documents.
    """
    buckets = layout.buckets
    schema = pa.schema([("bucket", pa.int32()), ("known", pa.bool_()), *[(n, pa.binary()) for n in ("hash", "more", "id", "tag", "start")]])

    def of_document(id: int, tag: int, text: str | None, at: bytes):
        hashes = word_hashes(_words(text))
        starts = cover.candidates(np.frombuffer(at, "<u4").astype(np.int64), len(hashes))
        one, two = windows(hashes, cover.window)[starts], windows(mixed(~hashes), cover.window)[starts]
        n = len(starts)
        return one, (two >> np.uint64(32)).astype(np.uint32), np.full(n, id, np.int64), np.full(n, tag, np.int64), starts.astype(np.uint32)

    def repeats(one: np.ndarray, two: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Which rows have an equal window with a lesser (id, start)."""
        order = np.lexsort((starts, ids, two, one))
        new = np.ones(len(order), bool)
        new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
        least = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
        result = np.empty(len(order), bool)
        result[order] = (ids[order] != ids[least]) | (starts[order] != starts[least])
        return result

    def flush(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        one, two, ids, tags, starts = columns
        again = repeats(one, two, ids, starts)
        empty = np.zeros(int(again.sum()), "V0")
        yield from _packed((True,), ids[again] % buckets, [empty, empty, ids[again], tags[again], starts[again]], schema)
        ask = ~again
        yield from _packed((False,), (one[ask] >> np.uint64(33)).astype(np.int64) % buckets, [c[ask] for c in columns], schema)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _gathered(batches, of_document, flush)

    def later(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        for g in _groups(batches, 2):
            ids, tags, starts = _joined(g, "id", "<i8"), _joined(g, "tag", "<i8"), _joined(g, "start", "<u4")
            if not g.column("known")[0].as_py():
                again = repeats(_joined(g, "hash", "<u8"), _joined(g, "more", "<u4"), ids, starts)
                ids, tags, starts = ids[again], tags[again], starts[again]
            yield [ids, tags, starts]

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _found(later(batches), buckets)

    sent = docs.select("id", "tag", "text", "places").mapInArrow(asked, "bucket int, known boolean, hash binary, more binary, id binary, tag binary, start binary")
    found = layout.dealt(sent, "known").mapInArrow(answered, "bucket int, id binary, tag binary, place binary")
    return _by_document(found, layout)


def _kept(docs: DataFrame, cover: Cover, texts: bool) -> DataFrame:
    """What is left of each row of ``docs(doc_id, text, places)``: the starts of repeats, or null."""
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"][: 4 + texts]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                rows = []
                for text, starts in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    words = _words(text)
                    n, kept = len(words), words
                    if starts:
                        s = np.frombuffer(starts, "<u4").astype(np.int64)
                        change = np.zeros(n + 1, np.int64)
                        np.add.at(change, s, 1)
                        np.add.at(change, s + cover.window, -1)
                        kept = [words[i] for i in np.flatnonzero(np.cumsum(change)[:n] == 0)]
                    left = b" ".join(kept)
                    rows.append((n, n - len(kept), sha256(left).hexdigest(), left.decode())[: 3 + texts])
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)]], names=names)

    return docs.select("doc_id", "text", "places").mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * texts)


def remove_repeats(docs: DataFrame, cover: Cover | None = None, texts: bool = True, layout: Layout | None = None, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256 [, kept_text])`` of each row of ``docs(doc_id, text)``.

    A word goes if it lies in a window that also starts earlier: in a document with a
    lesser ``doc_id``, or earlier in the same one. Kept words are joined by one space.
    Null text has no words. A null id comes before all others; rows with equal ids count
    as one document with several texts: of equal windows at the same start in them none
    is earlier. Very long texts are read whole. Other columns are ignored; an empty table
    gives no rows. ``layout`` follows from the size of all texts unless given.
    """
    cover, spark = cover or Cover(), docs.sparkSession
    if layout is None:
        size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0]
        layout = Layout.of(size or 0, int(spark.conf.get("spark.sql.shuffle.partitions")))
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    named = whole.select("doc_id", "text", F.coalesce("doc_id", F.lit(LOWEST)).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tag"))

    def split(found: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """The rows of documents in ``found``, and the others; None where a shuffle has to tell them apart."""
        ids = written(found.select("id").distinct(), "ids")
        if ids.count() > broadcast_ids:
            return named, None
        return named.join(F.broadcast(ids), "id", "left_semi"), named.join(F.broadcast(ids), "id", "left_anti")

    anchors = written(shared_anchors(named, cover, layout), "anchors")
    tidy(spark)
    some, _ = split(anchors)
    repeats = written(repeated_windows(some.join(anchors, "id"), cover, layout), "repeats")
    tidy(spark)
    some, others = split(repeats)
    out = _kept(some.join(repeats, ["id", "tag"], "left"), cover, texts)
    if others is not None:
        out = out.unionByName(_kept(others.withColumn("places", F.lit(None).cast("binary")), cover, texts))
    return out
