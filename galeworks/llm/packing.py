"""Best-fit packing of tokenised documents by exact complements of length counts."""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galeworks.llm.common import written

#: Distinct words whose ids a task remembers; the store is emptied when full.
MEMORY = 500_000

# Letters and numbers below U+0250, and the white space there, as the vocabulary's word pattern reads them.
LETTERS, NUMBERS, SPACES = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
BEYOND = re.compile("[^\x00-ɏ]|<\\|")


class WordIds(dict):
    """Word -> its ids as little-endian unsigned 32-bit bytes, worked out once.

    The file's own vocabulary, read as byte ranks, encodes single words several times faster than the whole tokenizer. That
    gives the same ids where the file cuts and merges as WORDS and ranks do, which `_by_ranks` looks up in it; else the
    tokenizer is asked for whole texts.
    """

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(file)
        self.ask = lambda text: np.asarray(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        self.word = _by_ranks(file)

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MEMORY:
            self.clear()
        self[word] = ids = self.word(word)
        return ids

    def text(self, text: str) -> bytes:
        """Ids never cross the words of the tokenizer's own pattern, so words are looked up one by one; texts with
        characters beyond those that WORDS is exact for, or with a special token's mark, are encoded whole."""
        return self.ask(text) if self.word is None or BEYOND.search(text) else b"".join(map(self.__getitem__, WORDS.findall(text)))


def _by_ranks(file: str):
    """A function from a word to its ids' bytes; None unless the file cuts words as WORDS does (byte level, by its own
    pattern, without a prefix), normalises nothing, marks its added tokens as BEYOND expects, and merges in the order of ids."""
    import tiktoken

    spec = json.loads(file)
    model, cut = spec["model"], spec["pre_tokenizer"] or {}
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and spec["normalizer"] is None
    plain &= all(BEYOND.search(t["content"]) and not (t["lstrip"] or t["rstrip"]) for t in spec["added_tokens"])
    plain &= model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    if not plain:
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    merged = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
    ids = [model["vocab"][m.replace(" ", "")] for m in merged]
    if ids != sorted(ids):
        return None
    ranks = {bytes(signs[c] for c in piece): i for piece, i in model["vocab"].items() if all(c in signs for c in piece) and (len(piece) == 1 or i >= ids[0])}
    ranks = {k: v for k, v in ranks.items() if v <= ids[-1]}
    encoding = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    return lambda word: array("I", encoding.encode_ordinary(word)).tobytes()


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, size: int, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): the pieces of every document of docs (doc_id, text).

    A document's ids are followed by end_id; null and empty texts are end_id alone. Longer documents are cut so that
    all pieces but the first have `size` ids. The driver alone reads the tokenizer's file, a few MB; it travels with the tasks.
    """
    with open(tokenizer_path, encoding="utf-8") as opened:
        shipped = docs.sparkSession.sparkContext.broadcast(opened.read())
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    fields += [("ids", pa.list_(pa.int64()))] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = WordIds(shipped.value), np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows: list[tuple] = []
                part = batch.slice(at, 512)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    ids = words.text(text.as_py() or "") + end
                    n = len(ids) // 4
                    first = (n - 1) % size + 1
                    cuts = [0, *range(first, n + 1, size)]
                    for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        own = ids[4 * a : 4 * b]
                        rows.append((doc_id, piece, a, b - a, zlib.crc32(own), *([np.frombuffer(own, "<u4").astype("i8")] if with_ids else [])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def plan_sequences(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths that share one sequence, number of such sequences)] for counts of pieces by length.

    Work depends on `size` alone, not on the number of pieces. The plan that needs the fewest sequences is taken of those
    that complete gaps by one length alone, by pair sums too, and by triple sums too: using up many short
    pieces in exact sums can leave long ones without a partner.
    """
    plans = [_plan(counts, size, most) for most in (1, 2, 3)]
    return min(plans, key=lambda plan: sum(n for _, n in plan))


class SumIndex:
    """The sums of one, two and three lengths, and how many pieces of each length are still there.

    pairs[s] lists the pairs (a, b), a >= b, of lengths with a + b = s, longest a first; a triple is a length c and a pair
    of lengths up to c whose sum is s - c. The pairs are hashed by their sum once; pairs that have run out are skipped.
    """

    def __init__(self, counts: dict[int, int], size: int):
        self.left = np.zeros(size + 1, np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.lengths = np.flatnonzero(self.left)[::-1]
        self.pairs: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, a in enumerate(self.lengths.tolist()):
            for b in self.lengths[k:].tolist():
                if a + b < size:
                    self.pairs[a + b].append((a, b))

    def single(self, total: int, most: int) -> Iterator[tuple[int, ...]]:
        if total <= most and self.left[total]:
            yield (total,)

    def pair(self, total: int, most: int) -> Iterator[tuple[int, ...]]:
        """Pairs of the sum `total`, of lengths up to `most`, that are there."""
        for a, b in self.pairs.get(total, ()):
            if a <= most and self.left[a] and self.left[b]:
                yield a, b

    def triple(self, total: int, most: int) -> Iterator[tuple[int, ...]]:
        for c in self.lengths.tolist():
            if c <= most and c < total and self.left[c] and 3 * c >= total:
                for pair in self.pair(total - c, c):
                    yield c, *pair


def _plan(counts: dict[int, int], size: int, most: int) -> list[tuple[tuple[int, ...], int]]:
    """Full lengths alone; then, longest first, the gap beside each length is looked up among the sums of one, two ...
    `most` lengths, and what fills it exactly is consumed as often as all its lengths are still there. The rest goes,
    longest first, into the fullest open sequence with room."""
    index = SumIndex(counts, size)
    left = index.left
    plan: list[tuple[tuple[int, ...], int]] = []

    def use(*lengths: int) -> None:
        times = min(int(left[x]) // k for x, k in Counter(lengths).items())
        if times:
            plan.append((lengths, times))
            for x in lengths:
                left[x] -= times

    use(size)
    for sums in (index.single, index.pair, index.triple)[:most]:
        for a in index.lengths.tolist():
            if left[a] and a < size:
                for fill in sums(size - a, a):
                    use(a, *fill)
                    if not left[a]:
                        break
    open_: dict[int, Counter] = defaultdict(Counter)  # room left -> contents -> how many
    for length in range(size, 0, -1):
        n = int(left[length])
        while n:
            room = next((r for r in range(length, size + 1) if open_.get(r)), None)
            if room is None:
                each = size // length
                for many, times in ((each, n // each), (n % each, 1)):
                    if many and times:
                        open_[size - many * length][(length,) * many] += times
                break
            contents, times = next(iter(open_[room].items()))
            k = min(times, n)
            n -= k
            open_[room][contents] -= k
            if not open_[room][contents]:
                del open_[room][contents]
            open_[room - length][(*contents, length)] += k
    return plan + [(contents, n) for bins in open_.values() for contents, n in bins.items() if n]


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 2, size: int = 1024, buckets: int | None = None, with_ids: bool = False) -> DataFrame:
    """The pieces of token_pieces with sequence_id and offset: every piece lies in one sequence of at most `size` ids.

    Pieces are tokenised once and written. The driver sees the count of each length (at most `size` rows) and plans from
    these alone; pieces are numbered within their length in parallel, by hash bucket (as many as the session has
    shuffle partitions, if not given), and look their place up in the plan, whose size is bounded too. Offsets in a sequence are gapless. Repeated rows and null ids are packed
    like any other; an empty table gives no rows.
    """
    buckets = buckets or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = written(token_pieces(docs, tokenizer_path, end_id, size, with_ids), "pieces")
    bucket = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets))
    counts = written(pieces.groupBy("length", bucket.alias("bucket")).count(), "lengths")
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    starts: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # length -> (first rank, first sequence, offset)
    seen: Counter = Counter()
    sequence = 0
    for contents, times in plan_sequences(totals, size):
        offset = 0
        for length in contents:
            starts[length].append((seen[length], sequence, offset))
            seen[length] += times
            offset += length
        sequence += times
    looked = {length: tuple(np.asarray(x, np.int64) for x in zip(*rows, strict=True)) for length, rows in starts.items()}

    shifts = counts.select("length", "bucket", F.expr("sum(count) over (partition by length order by bucket) - count").alias("shift"))
    ranked = pieces.withColumn("bucket", bucket).withColumn("place", F.expr("row_number() over (partition by length, bucket order by doc_id, piece, ids_crc32) - 1"))
    ranked = ranked.join(shifts, ["length", "bucket"]).withColumn("rank", F.col("place") + F.col("shift")).drop("bucket", "place", "shift")
    columns = [c for c in pieces.columns]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence_id, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                first, base, off = looked[int(x)]
                own = np.flatnonzero(length == x)
                i = np.searchsorted(first, rank[own], "right") - 1
                sequence_id[own], offset[own] = base[i] + rank[own] - first[i], off[i]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(sequence_id), pa.array(offset)], names=[*columns, "sequence_id", "offset"])

    return ranked.select(*columns, "rank").mapInArrow(place, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long")
