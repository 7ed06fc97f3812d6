"""MinHash near-dedup with an LSH forest over sorted signature orders."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galeworks.llm.common import connected_components, discard, marked_slots, slot_filter, written

#: Signature length; trees of the forest; least and greatest depth of a common prefix, in values, at which two documents of a
#: tree are candidates. Each tree's first DEPTH values are its own, so a pair of similarity 0.8 misses all trees with
#: probability (1 - 0.8**4)**32, 5e-8.
HASHES, TREES, DEPTH, DEEPEST = 128, 32, 4, 8
#: A region is what shares a prefix. Regions of DEPTH values up to this size give all their pairs; larger ones are split, each
#: part by as many further values as it takes to be as small. Where DEEPEST values do not do, each document is paired with
#: its next NEAREST neighbours in the order, those of the longest common prefix. Pairs that all this leaves out come
#: from `crowded_pairs`, which is exact.
REGION, NEAREST = 16, 3
#: Most slots, as a power of two, of the table of shingle counts that orders the shingles of crowded documents.
SLOT_BITS = 22
#: Rows of a shingle that are joined in one block.
BLOCK = 2048
#: Distinct words whose hash a task remembers.
MEMORY = 400_000
#: Standard deviations of the signature's estimate that a pair may lie below the threshold and still be compared in full.
DEVIATIONS = 7.0

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_MIX = np.random.default_rng(20240501).integers(1, 1 << 63, size=HASHES + 5, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import hashlib

        if len(self) >= MEMORY:
            self.clear()
        self[word] = h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


def shingle_set(text: str | None, size: int, words: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text.

    A-Z are lower-cased; words are what stands between spaces and the signs 9 to 13. Fewer words than `size` make one shingle
    of the whole sequence; no word, none.
    """
    found = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    size = min(size, len(h))
    mixed = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        mixed = (mixed ^ h[k : len(h) - size + 1 + k]) * _MIX[HASHES + k % 5]
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def signature(shingles: np.ndarray) -> np.ndarray:
    """HASHES minima of multiply-shift hashes of a non-empty set, as unsigned 32-bit numbers."""
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(shingles), 1024):  # blocks that stay in the processor's cache
        part = shingles[at : at + 1024]
        np.minimum(out, ((part[None, :] * _MIX[:HASHES, None]) >> np.uint64(32)).astype(np.uint32).min(axis=1), out=out)
    return out


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set (null if empty) signature with 16 bits a value and with 8 (low) for every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        words = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                rows = []
                for text in part.column(1):
                    own = shingle_set(text.as_py(), shingle, words)
                    if len(own):  # the low bits of the values: as evenly spread as they are, and enough to tell them apart
                        sig = signature(own)
                        rows.append((len(own), hashlib.blake2b(own.tobytes(), digest_size=16).digest(), sig.astype("<u2").tobytes(), sig.astype("u1").tobytes()))
                    else:
                        rows.append((0, None, None, None))
                n, *rest = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), *(pa.array(c, pa.binary()) for c in rest)], names=["doc_id", "n_shingles", "digest", "sig", "low"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, digest binary, sig binary, low binary")


def forest_rows(reps: DataFrame) -> DataFrame:
    """A row for each document and tree: the first DEPTH values of the tree's order, and the further ones, 16 bits each.

    A tree's order starts with its own values and goes on with the next tree's, so that sorting by (key, more) sorts by
    prefixes of values, and the common prefix of two rows can be read from them.
    """

    def joined(values: np.ndarray, turn: int) -> np.ndarray:
        values = np.roll(values.reshape(len(values), TREES, DEPTH), -turn, axis=1).astype(np.uint64)
        return sum(values[:, :, k] << np.uint64(16 * (DEPTH - 1 - k)) for k in range(DEPTH)).ravel().view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                ids = part.column("rep").to_numpy()
                sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), "<u2").reshape(-1, HASHES)
                tree = np.tile(np.arange(TREES, dtype=np.int32), len(ids))
                yield pa.RecordBatch.from_arrays([pa.array(tree), pa.array(joined(sig, 0)), pa.array(joined(sig, 1)), pa.array(np.repeat(ids, TREES))], names=["tree", "key", "more", "rep"])

    return reps.select("rep", "sig").mapInArrow(run, "tree int, key long, more long, rep long")


def common_prefixes(tree: np.ndarray, key: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Values that each row of a sorted order has in common with the row before it, below DEPTH counting as 0."""
    same = np.zeros(len(tree), np.int64)
    if len(tree) > 1:
        differ = (more[1:] ^ more[:-1]).view(np.uint64)
        further = sum((differ >> np.uint64(16 * (3 - k)) == 0).astype(np.int64) for k in range(4))
        same[1:] = np.where((tree[1:] == tree[:-1]) & (key[1:] == key[:-1]), DEPTH + further, 0)
    return same


def regions(same: np.ndarray, most: int = REGION) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row: the size of its region of DEPTH values, the name of the region it gives all its pairs in, which
    has as many values in common as it takes to hold `most` rows at most, and whether there is one."""
    name, found, first = np.full(len(same), -1, np.int64), np.zeros(len(same), bool), None
    for depth in range(DEPTH, DEEPEST + 1):
        own = np.cumsum(same < depth) - 1
        size = np.bincount(own)[own]
        first = size if first is None else first
        fits = ~found & (size <= most)
        name[fits] = own[fits] * (DEEPEST + 1) + depth
        found |= fits
    return first, name, found


def neighbours(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Candidate pairs (a < b) of documents next to each other in the trees' sorted orders; the rows (tree, key, rep)
    of regions above REGION documents, where not all pairs are candidates; and the written table that both are read from.

    Rows are dealt by ranges of the whole sort key, so a region as large as a third of all rows is spread over many
    tasks. Rows near a task's first and last place are handed on and paired across the cut by a window over these few.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = [np.zeros(0, np.int64)] * 4
        held, head, known = empty, True, None

        def out(a, b, edge):
            cut = [np.full(len(a), -1, np.int64)] * 3 if edge is None else edge
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *map(pa.array, cut)], names=["a", "b", "tree", "key", "more"])

        def pairs(t, k, m, d):
            same = common_prefixes(t, k, m)
            size, name, small = regions(same, REGION)
            region = np.cumsum(same < DEPTH)
            for o in range(1, min(REGION, len(d))):
                near = region[o:] == region[:-o]
                if not near.any():
                    break
                i = np.flatnonzero(near & ((small[o:] & (name[o:] == name[:-o])) | (~small[o:] | ~small[:-o]) & (o <= NEAREST)))
                low, high = np.minimum(d[i], d[i + o]), np.maximum(d[i], d[i + o])
                yield out(low[low < high], high[low < high], None)
            crowd = size > REGION
            if known is not None:  # a part of a region that began in an earlier batch
                crowd |= (t == known[0]) & (k == known[1])
            if crowd.any():
                yield out(d[crowd], np.full(int(crowd.sum()), -2, np.int64), [t[crowd], k[crowd], m[crowd]])

        def edges(t, k, m, d):
            none = np.full(len(d), -1, np.int64)
            return out(d, none, [t, k, m])

        for batch in batches:
            cols = [np.concatenate([h, batch.column(c).to_numpy().astype(np.int64)]) for h, c in zip(held, ("tree", "key", "more", "rep"), strict=True)]
            if not len(cols[0]):
                continue
            t, k = cols[0], cols[1]
            if head:
                first = (t == t[0]) & (k == k[0])
                n = min(int(first.sum()), REGION)
                if n < len(t) or len(t) >= 4 * REGION:
                    yield edges(*(c[:n] for c in cols))
                    head = False
            last = int(np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (k[1:] != k[:-1])]))[-1])
            if len(t) - last > 4 * REGION:  # a large region goes on: pair what is here, keep its last rows for what follows
                yield from pairs(*cols)
                held, known = [c[-max(REGION, NEAREST) :] for c in cols], (t[-1], k[-1])
            else:
                yield from pairs(*(c[:last] for c in cols)) if last else ()
                held = [c[last:] for c in cols]
        if len(held[0]):
            yield from pairs(*held)
            yield edges(*(c[-REGION:] for c in held))
            if head and len(held[0]) > REGION:
                yield edges(*(c[:REGION] for c in held))

    dealt = rows.repartitionByRange(max(parts, 1), "tree", "key", "more", "rep").sortWithinPartitions("tree", "key", "more", "rep")
    found = written(dealt.mapInArrow(scan, "a long, b long, tree long, key long, more long"), "neighbours")
    cut = found.where("b = -1").select("tree", "key", "more", F.col("a").alias("rep")).distinct()
    nexts = F.array(*[F.expr(f"lead(rep, {k}) over (partition by tree, key order by more, rep)") for k in range(1, REGION)])
    across = cut.select("rep", nexts.alias("nexts")).select("rep", F.explode(F.array_compact("nexts")).alias("next")).select(F.least("rep", "next").alias("a"), F.greatest("rep", "next").alias("b")).where("a <> b")
    split = cut.withColumn("size", F.expr("count(*) over (partition by tree, key)")).where(f"size > {REGION}").select("tree", "key", "rep")
    crowded = found.where("b = -2").select("tree", "key", F.col("a").alias("rep"))
    further = cut.join(crowded.select("tree", "key").distinct(), ["tree", "key"], "left_semi").select("tree", "key", "rep")
    crowded = crowded.unionByName(split).unionByName(further).distinct()
    return found.where("b >= 0").select("a", "b").unionByName(across).distinct(), crowded, found


def likely_pairs(candidates: DataFrame, reps: DataFrame, num: int, den: int) -> DataFrame:
    """The candidate pairs that may reach num/den by the sizes of their sets and by their signatures' estimate.

    A byte a value is enough to estimate from, and all that is sent: values that differ agree in it by chance alone, which
    lets more pairs through and loses none.
    """
    least = num / den
    floor = int(HASHES * (least - DEVIATIONS * (least * (1 - least) / HASHES) ** 0.5))

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, HASHES) for c in ("sig_a", "sig_b"))
            same = (one == two).sum(axis=1)
            keep = same >= floor
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], names=["a", "b"])

    small = "100 * least(n_a, n_b) >= {} * greatest(n_a, n_b)".format(100 * num // den)
    a = reps.select(F.col("rep").alias("a"), F.col("low").alias("sig_a"), F.col("n_shingles").alias("n_a"))
    b = reps.select(F.col("rep").alias("b"), F.col("low").alias("sig_b"), F.col("n_shingles").alias("n_b"))
    likely = candidates.join(a, "a").join(b, "b").where(small).select("a", "b", "sig_a", "sig_b").mapInArrow(agree, "a long, b long")
    return written(likely, "likely")


def confirmed(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs with den * intersection >= num * union, by full sets; a set is shipped once for each pair it is the first of."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                one, two = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(den * both >= num * (len(one) + len(two) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    a = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("set_a"))
    b = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("set_b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "set_a", "set_b").mapInArrow(check, "a long, b long")


def full_sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """rep, shingles (sorted 64-bit hashes as bytes) of the documents of docs whose id is among `wanted` (rep, each once).

    A table of bits of the wanted ids, of bounded size, keeps nearly all other texts from being sent anywhere. The join is an
    inner one, since Spark would move a semi join below that filter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingle_set(t.as_py(), shingle, words).tobytes() for t in part.column(1)], pa.binary())], names=["rep", "shingles"])

    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("rep"), "text")
    texts = slot_filter(texts, marked_slots(wanted, "rep"), "rep")
    return texts.join(wanted.hint("shuffle_hash"), "rep").mapInArrow(run, "rep long, shingles binary")


def crowded_pairs(crowded: DataFrame, groups: DataFrame, docs: DataFrame, shingle: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs (a < b) of documents of crowded regions that lie in different components, and these documents' sets: no
    pair at the threshold is left out.

    A region whose documents all lie in one component is settled. Those of the others are joined by prefixes: with the
    shingles of every document in one common order, two documents at the threshold share one among the first
    n - ceil(n * num / den) + 1 of each. Rare shingles come first, by a table of counts with a slot for each shingle up
    to 2**SLOT_BITS, so that what a whole region shares stays out of the prefixes; the order decides the cost only.
    Documents that share a shingle are joined in blocks of BLOCK, so no shingle's rows meet in one task.
    """
    at = crowded.join(groups.withColumnRenamed("node", "rep"), "rep", "left").select("tree", "key", "rep", F.coalesce("component", "rep").alias("component"))
    at = written(at, "crowded")
    unsettled = at.groupBy("tree", "key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("tree", "key")
    reps = written(at.join(unsettled, ["tree", "key"], "left_semi").select("rep", "component").distinct(), "unsettled")
    discard(at)
    sets = written(full_sets(docs, reps.select("rep"), shingle).join(reps, "rep"), "unsettled_sets")
    total = sets.agg(F.sum(F.length("shingles") / 8)).first()[0] or 0
    slots = 1 << min(SLOT_BITS, max(10, math.ceil(math.log2(total + 1))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(slots, np.int64)
        for batch in batches:
            for one in batch.column(0):
                np.add.at(seen, (np.frombuffer(one.as_py(), np.uint64) % np.uint64(slots)).astype(np.int64), 1)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], names=["slot", "n"])

    counts = sets.select("shingles").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # at most 2**SLOT_BITS rows
    weight = np.zeros(slots, np.int64)
    weight[counts.column("slot").to_numpy()] = counts.column("n").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(weight)

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                token, place, size = [], [], []
                for one in part.column("shingles"):
                    own = np.frombuffer(one.as_py(), np.uint64)
                    first = len(own) + num * -len(own) // den + 1
                    order = np.lexsort((own, shared.value[(own % np.uint64(slots)).astype(np.int64)]))
                    token.append(own[order[:first]].view(np.int64))
                    place.append(np.arange(first, dtype=np.int64))
                    size.append(first)
                n = np.array([len(one.as_py()) // 8 for one in part.column("shingles")], np.int64)
                cols = [np.concatenate(token), np.concatenate(place), *(np.repeat(c, size) for c in (part.column("rep").to_numpy(), part.column("component").to_numpy(), n))]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols)], names=["token", "place", "rep", "component", "n"])

    posts = written(sets.mapInArrow(prefix, "token long, place long, rep long, component long, n long"), "prefixes")
    useful = posts.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("rows")).where("lo <> hi")
    useful = useful.select("token", F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks"))
    own = written(posts.join(useful, "token"), "postings")
    discard(posts)
    x = own.withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int")).alias("x")
    y = own.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("y")
    left = F.least(F.expr("x.n - x.place"), F.expr("y.n - y.place"))  # the most that the pair can share from this place on
    fits = F.expr(f"{den} * least(x.n, y.n) >= {num} * greatest(x.n, y.n)") & ((num + den) * left >= num * F.expr("x.n + y.n"))
    met = x.join(y.hint("merge"), F.expr("x.token = y.token and x.block = y.block and x.component < y.component") & fits)
    pairs = written(met.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct(), "met")
    discard(own)
    return pairs, sets


def near_duplicates(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text).

    Documents are linked when den * intersection >= num * union of their sets of `shingle`-word shingles; component_id is the
    smallest doc_id reachable. Equal sets form a class that takes part once. Candidates come from the forest; links
    are confirmed on full sets: first each document's best candidate, then, of the other pairs, those that still lie in
    different components; last, pairs of crowded regions that the forest leaves out, by an exact join. Documents without words (null, empty, white space) are linked with nothing. Null ids are
    linked with nothing and have no component (kept is true); rows that repeat an id must repeat its text, and share its result.
    """
    own = written(sketches(docs, shingle).withColumn("digest", F.when(F.col("doc_id").isNotNull(), F.col("digest"))), "sketches")
    reps = own.where("digest is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "n_shingles", "sig", "low")).alias("x"))
    reps = written(reps.select("digest", F.col("x.doc_id").alias("rep"), F.col("x.n_shingles").alias("n_shingles"), F.col("x.sig").alias("sig"), F.col("x.low").alias("low")), "classes")
    candidates, crowded, found = neighbours(forest_rows(reps))
    likely = likely_pairs(candidates, reps, num, den)
    wanted = likely.select(F.col("a").alias("rep")).unionByName(likely.select(F.col("b").alias("rep"))).distinct()
    sets = written(full_sets(docs, wanted, shingle), "sets")
    first = likely.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = written(confirmed(first, sets, num, den), "first")
    groups = connected_components(links)
    side = lambda c: groups.select(F.col("node").alias(c), F.col("component").alias(f"in_{c}"))
    rest = likely.join(first, ["a", "b"], "left_anti").join(side("a"), "a", "left").join(side("b"), "b", "left")
    rest = rest.where("coalesce(in_a, a) <> coalesce(in_b, b)").select("a", "b")
    links = written(links.unionByName(confirmed(rest, sets, num, den)), "links")
    for done in (sets, likely, groups):
        discard(done)
    groups = connected_components(links)
    met, sets = crowded_pairs(crowded, groups, docs, shingle, num, den)
    discard(found)
    more = written(confirmed(likely_pairs(met, reps, num, den), sets, num, den), "more")
    discard(sets)
    groups = connected_components(links.unionByName(more))
    classes = reps.join(groups.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    out = own.drop("sig", "low").join(classes, "digest", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
