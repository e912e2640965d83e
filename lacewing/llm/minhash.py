"""Near duplicates: many universal hash minima, banding, verification, components.

1. One narrow pass takes each text to the minima of its shingle set under universal
   hash functions. Rows with equal sets become one class, so copies cost nothing more.
2. Classes that agree on a band share a bucket. Each is compared with the least class
   of its bucket only: first by signature, then on full sets. Components of these links
   settle nearly all buckets.
3. Where a bucket still holds classes of different components, all pairs across
   components are compared by signature in blocks of bounded size, and those that may
   reach the threshold are confirmed on full sets in the block, unless links found
   there have joined their components. No pair in a bucket is left out, and none is a row.
   The bucket's largest component meets only the rest, so a large group of near copies
   costs no more than its members times the chunks of the few that aren't in it.
   Such a group fills a bucket in nearly every band: buckets with one least class are
   dealt as one where that compares fewer pairs than each by itself.
4. Components by alternating large-star and small-star.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacewing.llm.components import connected_components
from lacewing.llm.shingles import shingle_set
from lacewing.session import written

#: Ids that are broadcast to pick their texts; more are joined by a shuffle.
BROADCAST_IDS = 200_000


@dataclass(frozen=True)
class MinHash:
    """Parameters: at a similarity s a pair shares no band with (1 - s**rows)**bands.

    ``margin`` is the least share of equal minima at which a pair is compared in full:
    over four standard deviations below the threshold at the defaults. A block compares
    ``block`` classes of a bucket with each other, or two chunks of half as many.
    """

    threshold: int = 75
    shingle: int = 5
    bands: int = 32
    rows: int = 4
    seed: int = 7
    margin: float = 0.585
    block: int = 256

    @property
    def hashes(self) -> int:
        return self.bands * self.rows

    def functions(self) -> tuple[np.ndarray, np.ndarray]:
        """Multiply-add-shift: strongly universal from 64-bit sets to 32 bits."""
        rng = np.random.default_rng(self.seed)
        a, b = rng.integers(0, 1 << 63, (2, self.hashes), np.uint64)
        return a * np.uint64(2) + np.uint64(1), b


def minima(sets: list[np.ndarray], params: MinHash, chunk: int = 1 << 15) -> np.ndarray:
    """A row of 32-bit minima for each set, none of them empty."""
    a, b = params.functions()
    out = np.empty((len(sets), params.hashes), np.uint32)
    first = 0
    while first < len(sets):
        last, n = first, 0
        while last < len(sets) and (n == 0 or n + len(sets[last]) <= chunk):
            n, last = n + len(sets[last]), last + 1
        x = np.concatenate(sets[first:last])
        starts = np.cumsum([0, *map(len, sets[first : last - 1])])
        t = np.empty_like(x)
        for k in range(params.hashes):
            np.multiply(x, a[k], out=t)
            np.add(t, b[k], out=t)
            out[first:last, k] = np.minimum.reduceat(t, starts) >> np.uint64(32)
        first = last
    return out


def signatures(docs: DataFrame, params: MinHash) -> DataFrame:
    """``(doc_id, n_shingles, digest, sig)``; ``digest`` names the set, null without words."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                sets = [shingle_set(t, params.shingle) for t in b.column(1).to_pylist()]
                full = [i for i, s in enumerate(sets) if len(s)]
                rows = minima([sets[i] for i in full], params) if full else []
                sig, digest = [None] * len(sets), [None] * len(sets)
                for i, r in zip(full, rows, strict=True):
                    sig[i], digest[i] = r.tobytes(), blake2b(sets[i].tobytes(), digest_size=16).hexdigest()
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.string()), pa.array(sig, pa.binary())], names=["doc_id", "n_shingles", "digest", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(signed, "doc_id long, n_shingles long, digest string, sig binary")


def shingle_sets(docs: DataFrame, params: MinHash) -> DataFrame:
    """``(id, shingles)``: the sets themselves, as sorted arrays of hashes."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                sets = [shingle_set(t, params.shingle).view(np.int64) for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "shingles"])

    return docs.select(F.col("doc_id").cast("long").alias("id"), "text").mapInArrow(made, "id long, shingles array<long>")


def _likely(pairs: DataFrame, classes: DataFrame, params: MinHash) -> DataFrame:
    """The pairs whose signatures agree often enough to be worth a comparison in full."""
    sig = lambda c: classes.select(F.col("id").alias(c), F.col("sig").alias(f"sig_{c}"))
    least = params.margin * params.hashes

    def agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint32).reshape(b.num_rows, -1) for i in (2, 3))
                yield b.select([0, 1]).filter(pa.array((x == y).sum(axis=1) >= least))

    return pairs.join(sig("u"), "u").join(sig("v"), "v").select("u", "v", "sig_u", "sig_v").mapInArrow(agreeing, "u long, v long")


def _sets_of(ids: DataFrame, docs: DataFrame, params: MinHash, broadcast_ids: int) -> DataFrame:
    """``(id, shingles)`` of the documents named in ``ids(doc_id)``."""
    ids = written(ids.distinct(), "ids")
    few = ids.count() <= broadcast_ids
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    return written(shingle_sets(texts, params), "sets")


def _confirmed(pairs: DataFrame, docs: DataFrame, params: MinHash, broadcast_ids: int) -> DataFrame:
    """The pairs that reach the threshold on their full shingle sets."""
    pairs = written(pairs, "pairs")
    sets = _sets_of(pairs.select(F.explode(F.array("u", "v")).alias("doc_id")), docs, params, broadcast_ids)
    side = lambda c: sets.select(F.col("id").alias(c), F.col("shingles").alias(f"set_{c}"))
    both = pairs.join(side("u"), "u").join(side("v"), "v")
    shared = both.select("u", "v", F.size(F.array_intersect("set_u", "set_v")).alias("shared"), (F.size("set_u") + F.size("set_v")).alias("sizes"))
    return written(shared.filter(100 * F.col("shared") >= params.threshold * (F.col("sizes") - F.col("shared"))).select("u", "v").distinct(), "links")


def _groups(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[pa.Table]:
    """The runs of rows that agree in the first ``by`` columns, of rows sorted by them."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        keys = [b.column(i).to_numpy(zero_copy_only=False) for i in range(by)]
        cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        if held and any(held[-1].column(i)[0].as_py() != keys[i][0] for i in range(by)):
            yield pa.Table.from_batches(held)
            held = []
        starts = [0, *cuts.tolist()]
        for k, at in enumerate(starts):
            piece = b.slice(at, (starts[k + 1] if k + 1 < len(starts) else b.num_rows) - at)
            held.append(piece)
            if k + 1 < len(starts):
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def _rivals(members: DataFrame, params: MinHash) -> DataFrame:
    """Of each block the members with likely partners in another component, and those partners.

    ``(key, i, j, id, component, partners)``: a pair stands once, at the member with the
    lesser id, where the bucket of the first band that it shares is; a partner has a row of its own.
    """
    least, shape = params.margin * params.hashes, (-1, params.bands, params.rows)
    schema = "key long, i int, j int, id long, component long, partners array<long>"

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, 3):
            ids, of, chunk = (g.column(c).to_numpy() for c in ("id", "component", "chunk"))
            sig = np.frombuffer(b"".join(g.column("sig").to_pylist()), np.uint32).reshape(len(ids), -1)
            key, i, j = (g.column(c)[0].as_py() for c in ("key", "i", "j"))
            bands = g.column("bands").combine_chunks()
            has = np.zeros((len(ids), params.bands), bool)
            has[np.repeat(np.arange(len(ids)), bands.value_lengths().to_numpy()), bands.flatten().to_numpy()] = True
            partners: dict[int, list[int]] = {}
            for k in range(len(ids)):
                near = np.flatnonzero((of != of[k]) & (ids > ids[k]) & ((chunk != chunk[k]) | (i == j)))
                if len(near):
                    same = sig[near] == sig[k]
                    enough = same.sum(axis=1) >= least
                    near, same = near[enough], same[enough]
                if len(near):
                    shared = same.reshape(shape).all(axis=2)
                    near = near[shared.any(axis=1) & has[k][shared.argmax(axis=1)]]
                if len(near):
                    partners[k] = ids[near].tolist()
                    for x in near.tolist():
                        partners.setdefault(x, [])
            if partners:
                at, n = sorted(partners), len(partners)
                yield pa.RecordBatch.from_arrays([pa.array([key] * n, pa.int64()), pa.array([i] * n, pa.int32()), pa.array([j] * n, pa.int32()), pa.array(ids[at]), pa.array(of[at]), pa.array([partners[k] for k in at], pa.list_(pa.int64()))], names=["key", "i", "j", "id", "component", "partners"])

    dealt = members.select("key", "i", "j", "id", "component", "chunk", "sig", "bands").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(compared, schema)


def _settled_rivals(rivals: DataFrame, params: MinHash) -> DataFrame:
    """Links that join components, found on full sets: at most one fewer than a block's members."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, 3):
            ids = g.column("id").to_pylist()
            of = dict(zip(ids, g.column("component").to_pylist(), strict=True))
            sets = {x: s.values.to_numpy() for x, s in zip(ids, g.column("shingles"), strict=True)}
            joined: dict[int, int] = {}

            def top(c: int, joined: dict[int, int] = joined) -> int:
                while c in joined:
                    c = joined[c]
                return c

            us, vs = [], []
            for u, partners in zip(ids, g.column("partners").to_pylist(), strict=True):
                for v in partners:
                    a, b = top(of[u]), top(of[v])
                    if a == b:
                        continue
                    shared = len(np.intersect1d(sets[u], sets[v], assume_unique=True))
                    if 100 * shared >= params.threshold * (len(sets[u]) + len(sets[v]) - shared):
                        joined[max(a, b)] = min(a, b)
                        us.append(u)
                        vs.append(v)
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    dealt = rivals.select("key", "i", "j", "id", "component", "partners", "shingles").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(linked, "u long, v long")


def _dealt(named: DataFrame, block: int) -> DataFrame:
    """Members of buckets that hold several components, once for each block they are compared in.

    The columns of ``named(key, id, component, ...)`` with ``chunk``, ``i`` and ``j``. A bucket of
    at most ``block`` members is one block. Of a larger one the members of its largest
    component, whose chunks are numbered from -1 downwards, meet the chunks of the rest, from
    0 upwards; the rest meet each other too. A block is a pair of chunks, each of half a block.
    """
    half = max(block // 2, 1)
    of = named.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = of.groupBy("key").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("n")).filter("n > top.n")
    one = F.col("n") <= block
    chunks = lambda n: F.ceil(n / F.lit(half)).cast("int")
    mixed = mixed.select("key", F.when(~one, F.col("top.component")).alias("top"), F.when(one, F.lit(1)).otherwise(chunks(F.col("n") - F.col("top.n"))).alias("rest"), F.when(one, F.lit(0)).otherwise(chunks(F.col("top.n"))).alias("tops"))
    members = named.join(written(mixed, "mixed"), "key")
    inside = F.col("component").eqNullSafe(F.col("top"))
    chunk = F.when(inside, -1 - F.pmod(F.xxhash64("id"), F.col("tops"))).otherwise(F.pmod(F.xxhash64("id"), F.col("rest"))).cast("int")
    pair = lambda a, b: F.struct(F.least(a, b).alias("i"), F.greatest(a, b).alias("j"))
    others = F.transform(F.sequence(F.lit(0), F.col("rest") - 1), lambda k: pair(F.col("chunk"), k))
    above = F.when(F.col("tops") > 0, F.transform(F.sequence(F.lit(1), F.col("tops")), lambda k: pair(F.col("chunk"), -k))).otherwise(F.array().cast("array<struct<i:int,j:int>>"))
    members = members.withColumn("chunk", chunk).withColumn("at", F.explode(F.when(inside, others).otherwise(F.concat(others, above))))
    return members.select(*named.columns, "chunk", "at.i", "at.j")


def _merged(named: DataFrame) -> DataFrame:
    """``(key, id, component, bands)`` of buckets ``(key, band, id, component)`` that hold several components.

    Buckets with the same least class, 32 at most by default, become one if the square of their
    different members is no more than the squares of the buckets' sizes in all. ``bands`` are those
    of its buckets that a member is in: a pair that shares a band meets where that bucket went.
    """
    mixed = named.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    mixed = written(mixed.filter("a < b").select("key", "least", "n"), "mixed")
    members = written(named.join(mixed, "key").select("key", "band", "id", "component", "least"), "members")
    apart = mixed.groupBy("least").agg(F.sum(F.col("n") * F.col("n")).alias("apart"), F.count(F.lit(1)).alias("buckets")).filter("buckets > 1")
    once = members.groupBy("least", "id").agg(F.lit(1)).groupBy("least").agg(F.count(F.lit(1)).alias("n"))
    merged = written(apart.join(once, "least").filter("n * n <= apart").select("least", F.xxhash64(F.lit("least"), "least").alias("to")), "merged")
    to = members.join(merged, "least", "left").select(F.coalesce("to", "key").alias("key"), "band", "id", "component")
    return to.groupBy("key", "id").agg(F.min("component").alias("component"), F.collect_set("band").alias("bands"))


def _across(bands: DataFrame, labels: DataFrame, classes: DataFrame, docs: DataFrame, params: MinHash, broadcast_ids: int) -> DataFrame:
    """Confirmed links between different components that share a bucket.

    A bucket of many classes is dealt to blocks, so no task gets a bucket; pairs are
    looked at where they are and only links come out.
    """
    named = bands.join(labels, bands["id"] == labels["node"], "left").select("key", "band", "id", F.coalesce("component", "id").alias("component"))
    members = _dealt(written(_merged(named), "merged"), params.block).join(classes.select("id", "sig"), "id")
    rivals = written(_rivals(members, params), "rivals")
    sets = _sets_of(rivals.select(F.col("id").alias("doc_id")), docs, params, broadcast_ids)
    return written(_settled_rivals(rivals.join(sets, "id"), params).distinct(), "links")


def near_duplicates(docs: DataFrame, params: MinHash | None = None, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` of each row of ``docs(doc_id, text)``.

    Documents are linked if 100 * intersection >= threshold * union of their shingle sets;
    a component's id is its least ``doc_id``, whose rows are kept. Null or blank text has
    no shingles and is linked with nothing. Rows with equal ids are one document's: what
    either links is linked, and they share a verdict. Rows without an id aren't compared:
    they are kept, with a null component. Very long texts are read whole. Other columns
    are ignored; an empty table gives no rows.
    """
    params = params or MinHash()
    rows = written(signatures(docs, params), "signatures")
    known = rows.filter("doc_id IS NOT NULL AND digest IS NOT NULL")
    classes = written(known.groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig")), "classes")
    width = 4 * params.rows
    keys = F.transform(F.sequence(F.lit(0), F.lit(params.bands - 1)), lambda i: F.xxhash64(F.substring(F.col("sig"), i * width + 1, F.lit(width)), i))
    bands = written(classes.select("id", F.posexplode(keys).alias("band", "key")), "bands")
    # tables, where a bucket may be a hot key: adaptive joins don't split behind an aggregation
    least = written(bands.groupBy("key").agg(F.min("id").alias("u"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "u"), "least")
    stars = bands.join(least, "key").filter("id != u").select("u", F.col("id").alias("v")).distinct()
    links = _confirmed(_likely(stars, classes, params), docs, params, broadcast_ids)
    labels = connected_components(links)
    more = _across(bands, labels, classes, docs, params, broadcast_ids)
    # copies under an id that another class has as well join the classes
    same = known.groupBy("digest", "doc_id").agg(F.lit(1)).join(classes.select("digest", "id"), "digest").filter("doc_id != id").select(F.col("id").alias("u"), F.col("doc_id").alias("v"))
    repeated = known.groupBy("doc_id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).filter("a != b").select(F.col("doc_id").alias("v"))
    extra = same.join(repeated, "v", "left_semi")
    if more.unionByName(extra.select("u", "v")).limit(1).count():
        labels = connected_components(links.unionByName(more).unionByName(extra.select("u", "v")))
    named = classes.join(labels, classes["id"] == labels["node"], "left").select("digest", F.coalesce("component", "id").alias("component_id"))
    out = rows.drop("sig").join(named, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, params: MinHash | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one document of each group."""
    gone = near_duplicates(docs, params).filter("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
