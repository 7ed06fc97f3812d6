"""Embedding near-dedup with rotated binary codes and stored correction factors."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galeworks.llm.common import connected_components, discard, written

#: Chance that a pair at the threshold shares no table, and that its estimate lies beyond its confidence bound.
MISS = 1e-6
#: Vectors in a block; a bucket with more is compared in pairs of blocks.
BLOCK = 1024
#: Rows of a group up to which its pairs are compared together with those of the other groups of a batch.
SMALL = 16
KINDS = {"float": np.dtype("<f4"), "double": np.dtype("<f8")}


def rotations(dim: int, count: int, seed: int = 7) -> np.ndarray:
    """`count` random orthogonal matrices."""
    rng = np.random.default_rng(seed)
    return np.stack([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(count)])


def axes(x: np.ndarray) -> np.ndarray:
    """For each row, the signed axis that it lies nearest to, as a number below twice the dimension."""
    at = np.abs(x).argmax(axis=1)
    return 2 * at + (x[np.arange(len(x)), at] > 0)


def meet_chance(dim: int, least: float, draws: int = 20_000) -> float:
    """Chance that two vectors of cosine `least` lie nearest to the same axis of a random rotation, by drawing pairs."""
    rng = np.random.default_rng(3)
    x, y = rng.standard_normal((2, draws, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if dim > 1:
        y -= (x * y).sum(axis=1, keepdims=True) * x
        y /= np.linalg.norm(y, axis=1, keepdims=True)
        y = least * x + math.sqrt(1 - least * least) * y
    else:
        y = x
    return float((axes(x) == axes(y)).mean())


def table_shape(rows: int, dim: int, least: float) -> tuple[int, int]:
    """(axes of a key, tables): keys have as many combinations as there are rows at least, so that unrelated vectors hardly
    ever meet; the number of tables makes a pair at the threshold meet with probability 1 - MISS."""
    per_key = max(1, math.ceil(math.log(max(rows, 2)) / math.log(2 * dim)))
    meet = min(meet_chance(dim, least) ** per_key, 1 - 1e-9)
    return per_key, max(1, math.ceil(math.log(MISS) / math.log(1 - meet)))


def confidence(dim: int) -> float:
    """t such that a coordinate of a random unit vector of dim - 1 numbers exceeds t with a chance below MISS."""
    return min(1.0, math.sqrt(2 * math.log(1 / MISS) / max(dim - 1, 1)))


def hashed(vectors: DataFrame) -> DataFrame:
    """vec_id, dim, vector (its numbers as bytes) and a digest of it; the digest is null where the vector links with nothing.

    Null or empty vectors, zero vectors and vectors with null or non-finite components link with nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            values = lists.values.to_numpy(zero_copy_only=False)
            values = values if values.dtype in (np.float32, np.float64) else values.astype(np.float64)
            cuts, there, known = lists.offsets.to_numpy(), lists.is_valid().to_numpy(zero_copy_only=False), batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            digest, vector = [None] * len(lists), [None] * len(lists)
            for i in np.flatnonzero(there & known & (cuts[1:] > cuts[:-1])).tolist():
                own = values[cuts[i] : cuts[i + 1]]
                if np.isfinite(own).all() and own.any():
                    vector[i] = own.tobytes()
                    digest[i] = hashlib.blake2b(vector[i], digest_size=16).digest()
            dim = np.where(there, np.diff(cuts), 0).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dim), pa.array(digest, pa.binary()), pa.array(vector, pa.binary())], names=["vec_id", "dim", "digest", "vector"])

    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast(f"array<{_number(vectors)}>")).mapInArrow(run, "vec_id long, dim int, digest binary, vector binary")


def _number(vectors: DataFrame) -> str:
    """The type that numbers are kept in: float where they are floats, else double."""
    return "float" if vectors.schema["embedding"].dataType.elementType == T.FloatType() else "double"


def coded(classes: DataFrame, dim: int, per_key: int, tables: int, number: str) -> DataFrame:
    """classes (digest, rep, weight, vector) with code, factor and keys, once for each vector.

    The code holds the signs of the rotated unit vector; the factor is the inner product of the vector and its code (each
    of length 1). A key is made of the axes that the vector lies nearest to under further rotations, hashed to 32 bits.
    """
    kind, seeds = KINDS[number], (dim, per_key * tables + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mats = rotations(*seeds).astype(np.float32)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = units(part.column("vector"), kind, dim).astype(np.float32)
                keys = np.zeros((len(x), tables), np.uint64)
                for k in range(tables * per_key):
                    keys[:, k // per_key] = keys[:, k // per_key] * np.uint64(2 * dim) + axes(x @ mats[k + 1].T).astype(np.uint64)
                keys = ((keys + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                rotated = x @ mats[0].T
                factor = np.abs(rotated).sum(axis=1) / math.sqrt(dim)
                code = [c.tobytes() for c in np.packbits(rotated > 0, axis=1)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) * tables + 1, tables, dtype=np.int32)), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(code, pa.binary()), pa.array(factor.astype(np.float32)), lists], names=[*part.schema.names, "code", "factor", "keys"])

    return classes.select("digest", "rep", "weight", "vector").mapInArrow(run, "digest binary, rep long, weight long, vector binary, code binary, factor float, keys array<int>")


def units(vectors: pa.Array, kind: np.dtype, dim: int) -> np.ndarray:
    """Vectors in double precision, scaled by their largest number and to length 1."""
    x = np.frombuffer(b"".join(vectors.to_pylist()), kind).reshape(-1, dim).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def near_rows(codes: DataFrame, dim: int, least: float, number: str) -> DataFrame:
    """rep, linked and root: for each block of a bucket and each vector linked in it, the weight of its links there and the
    smallest rep that it reaches there. A link counts in the first table where its two vectors meet, and there alone.

    For unit vectors q, o and o's code c with factor f = <o, c>, <q, c> / f estimates <q, o> without bias; its error is
    sqrt(1 - <q, o>^2) * sqrt(1 - f^2) / f times a coordinate of a random unit vector of dim - 1 numbers, which exceeds
    `confidence` with a chance below MISS. A pair whose estimate, either way round, lies below `least` by more than that
    is left; the others are recomputed in double precision. Only keys travel until it is known which rows
    share a bucket. Large buckets are dealt in blocks, and what leaves a block grows with its rows, not its pairs.
    """
    rows = codes.select("rep", F.posexplode("keys").alias("turn", "key"))
    rows = rows.select("rep", (F.shiftleft(F.col("turn").cast("long"), 32) + F.col("key").cast("long") + (1 << 31)).alias("bucket"))
    counts = rows.groupBy("bucket").count().where("count > 1").select("bucket", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    dealt = rows.join(counts, "bucket").withColumn("own", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("bucket", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "rep")
    dealt = dealt.join(codes.select("rep", "weight", "vector", "code", "factor", "keys"), "rep")
    parts = int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(parts, "bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")
    kind, reach = KINDS[number], math.sqrt(1 - least * least) * confidence(dim)

    def compare(mat: np.ndarray, rows: pa.Table) -> pa.RecordBatch:
        """Links of whole groups (bucket, low, high), in their order."""
        bucket, low, high, own, ids, weight, f = (rows.column(c).to_numpy() for c in ("bucket", "low", "high", "own", "rep", "weight", "factor"))
        x = units(rows.column("vector"), kind, dim)
        keys = rows.column("keys").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        code = np.unpackbits(np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(len(ids), -1), axis=1)[:, :dim]
        code = (code.astype(np.float32) * 2 - 1) / (np.float32(math.sqrt(dim)) * f[:, None])
        turned = (x @ mat.T).astype(np.float32)
        floor = (least - reach * np.sqrt(np.maximum(0, 1 - f * f)) / f - 1e-4).astype(np.float32)
        starts = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])]))
        sizes = np.diff(np.append(starts, len(ids)))
        group = np.repeat(np.arange(len(starts)), sizes)
        small = np.repeat(sizes <= SMALL, sizes)

        def kept(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Of pairs that pass their estimates: those that meet here first and are linked."""
            apart = (low[i] == high[i]) | (own[i] != own[j])
            i, j = i[apart], j[apart]
            fresh = ~((keys[i] == keys[j]) & (np.arange(keys.shape[1])[None, :] < (bucket[i] >> 32)[:, None])).any(axis=1)
            i, j = i[fresh], j[fresh]
            exact = (x[i] * x[j]).sum(axis=1) / np.sqrt((x[i] * x[i]).sum(axis=1) * (x[j] * x[j]).sum(axis=1)) >= least
            return i[exact], j[exact]

        linked = []
        for o in range(1, min(SMALL, len(ids))):  # pairs of small groups, all groups at once
            i = np.flatnonzero((group[o:] == group[:-o]) & small[o:])
            if not len(i):
                break
            j = i + o
            near = ((turned[i] * code[j]).sum(axis=1) >= floor[j]) & ((turned[j] * code[i]).sum(axis=1) >= floor[i])
            linked.append(kept(i[near], j[near]))
        for k in np.flatnonzero(sizes > SMALL):
            at = slice(starts[k], starts[k] + sizes[k])
            near = turned[at] @ code[at].T >= floor[None, at]
            i, j = np.nonzero(np.triu(near & near.T, 1))
            for c in range(0, len(i), 1 << 16):
                linked.append(kept(i[c : c + (1 << 16)] + starts[k], j[c : c + (1 << 16)] + starts[k]))
        a, b = (np.concatenate([np.zeros(0, np.int64), *c]) for c in zip(*linked, strict=True)) if linked else (np.zeros(0, np.int64),) * 2
        total = np.zeros(len(ids), np.int64)
        np.add.at(total, a, weight[b])
        np.add.at(total, b, weight[a])
        root, before = ids.copy(), None
        while before is None or (root != before).any():
            before, less = root.copy(), np.minimum(root[a], root[b])
            np.minimum.at(root, a, less)
            np.minimum.at(root, b, less)
        some = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(total[some]), pa.array(root[some])], names=["rep", "linked", "root"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mat = rotations(dim, 1)[0].astype(np.float64)
        held: list[pa.RecordBatch] = []  # rows of groups that may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            last = [batch.column(c).to_numpy() for c in ("bucket", "low", "high")]
            cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in last], axis=0)) + 1
            if held:
                before = [held[-1].column(c)[held[-1].num_rows - 1].as_py() for c in ("bucket", "low", "high")]
                if any(c[0] != v for c, v in zip(last, before, strict=True)):
                    yield compare(mat, pa.Table.from_batches(held))
                    held = []
            if len(cut):
                yield compare(mat, pa.Table.from_batches([*held, batch.slice(0, cut[-1])]))
                held = [batch.slice(cut[-1])]
            else:
                held.append(batch)
        if held:
            yield compare(mat, pa.Table.from_batches(held))

    return dealt.mapInArrow(scan, "rep long, linked long, root long")


def near_vectors(vectors: DataFrame, least: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding).

    Vectors of equal length are linked when their cosine is `least` or more; n_links counts the other rows linked directly,
    component_id is the smallest vec_id reachable. Equal vectors form a class that takes part once; its rows count each
    other. Vectors that cannot be compared (see hashed) and rows without an id link with nothing. Rows that repeat
    an id and vector count as rows of one class. Where rows of one id hold different vectors, each has its own
    vector's result; only where that id is the smallest of several vectors do their links count together. Vectors of different lengths are compared within their
    length, one length after the other. A pair at the threshold is missed with a chance of 3 * MISS at most; nearer ones with less.
    """
    number = _number(vectors)
    base = hashed(vectors)
    own = written(base.select("vec_id", "dim", "digest"), "vectors")
    sizes = own.where("digest is not null").groupBy("dim").agg(F.approx_count_distinct("digest").alias("rows")).collect()  # a row a length
    nothing = F.lit(0).cast("long")
    codes, found = [], []
    for dim, rows in sorted((r["dim"], r["rows"]) for r in sizes):
        classes = base.where((F.col("dim") == dim) & F.col("digest").isNotNull()).groupBy("digest")
        classes = classes.agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("vector").alias("vector"))
        codes.append(written(coded(classes, dim, *table_shape(rows, dim, least), number), "codes"))
        found.append(written(near_rows(codes[-1], dim, least, number), "linked"))
    if not codes:
        return own.select("vec_id", nothing.alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    reps, linked = codes[0].select("digest", "rep", "weight"), found[0]
    for more, also in zip(codes[1:], found[1:], strict=True):
        reps, linked = reps.unionByName(more.select("digest", "rep", "weight")), linked.unionByName(also)
    reps = written(reps, "classes")
    for done in codes:
        discard(done)
    groups = connected_components(linked.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    degree = linked.groupBy("rep").agg(F.sum("linked").alias("linked"))
    classes = reps.join(degree, "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left").select(
        "digest", (F.coalesce("linked", nothing) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    out = own.select("vec_id", "digest").join(classes, "digest", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", nothing).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
