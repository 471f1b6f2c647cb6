"""Best-fit packing of documents into fixed-length token sequences.

A configuration linear program over the histogram of piece lengths (at most
``capacity`` of them, however many documents there are) is solved by multiplicative
weights: each round prices the lengths by their exponential weights, finds the best
filling of one sequence by knapsack dynamic programming and adds some of it.  The
solution is rounded down, and what it leaves is packed by best-fit decreasing over
the histogram, where equal sequences are one group, so that the work on the driver
does not depend on the number of pieces either.  Spark then ranks the pieces of each
length and looks up each rank's place in the plan.

Null and empty texts are one piece that holds the end id alone.  Repeated rows are
packed once each.  An empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quakeweave.llm._common import parts, table, written
from quakeweave.llm.hashing import small

CAPACITY, END_ID, ROUNDS = 1024, 2, 1200
#: Fixed value: how byte-level BPE tokenizers of this family part a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of whole texts as little-endian uint32 bytes.

    The vocabulary and merges are those of the tokenizers file at path, a byte-level BPE
    whose ids follow its merges' order; tiktoken's engine runs them, several times faster
    and to the same ids.  A text that spells an added token goes to tokenizers itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        # a byte-level vocabulary spells bytes as characters: printable Latin-1 as itself, the rest from 256 on
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        ranks = {bytes(byte_of[c] for c in t): k for t, k in self.tokenizer.get_vocab(with_added_tokens=False).items() if t not in self.added}
        self.engine = tiktoken.Encoding("byte_level", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if any(t in text for t in self.added):
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.engine.encode_to_numpy(text).astype("<u4", copy=False).tobytes()


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; only the first may be shorter than capacity."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    return [(0, head)] * (head > 0) + [(s, capacity) for s in range(head, n, capacity)]


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece of each document: doc_id, piece, start, length, ids_crc32."""
    path = tokenizer or default_tokenizer()
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches):
        encoder = Encoder(path)
        for batch in small(batches):
            out = [[], [], [], [], []]
            for did, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encoder.encode(text or "") + end
                for k, (s, n) in enumerate(cut(len(ids) // 4, capacity)):
                    for column, value in zip(out, (did, k, s, n, zlib.crc32(memoryview(ids)[4 * s : 4 * (s + n)])), strict=True):
                        column.append(value)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def knapsack(lengths: np.ndarray, price: np.ndarray, capacity: int) -> np.ndarray:
    """How often each length stands in the dearest filling of one sequence (lengths ascending, repeats allowed)."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    below = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := below[c]:
            value = best[c - lengths[:k]] + price[:k]
            j = int(value.argmax())
            if value[j] > best[c]:
                best[c], took[c] = value[j], j
    times, c = np.zeros(len(lengths), np.int64), capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            times[took[c]] += 1
            c -= lengths[took[c]]
    return times


def relaxed(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> list[tuple[np.ndarray, float]]:
    """Fillings and how often to use each, from multiplicative weights on the configuration linear program."""
    least = float(lengths @ counts) / capacity
    covered, out = np.zeros(len(lengths)), {}
    eta = 2 * np.log(max(2, len(lengths)))
    for _ in range(rounds):
        share = covered / counts
        if share.min() >= 1:
            break
        # a length's price starts at its size and falls as its cover grows
        price = np.where(share < 1, lengths * np.exp(-eta * share), 0)
        times = knapsack(lengths, price, capacity)
        used = times > 0
        step = min(4 * least / rounds + 1, float(((counts - covered)[used] / times[used]).clip(0).min()) or 1)
        covered += step * times
        key = times.tobytes()
        out[key] = (times, out[key][1] + step if key in out else step)
    return list(out.values())


def best_fit(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Best-fit decreasing over a histogram: (number of sequences, {length: times in each})."""
    room: dict[int, list[tuple[int, dict[int, int]]]] = {}
    for ell, n in sorted(zip(lengths.tolist(), counts.tolist(), strict=True), reverse=True):
        while n > 0:
            c = min((c for c in room if c >= ell), default=None)
            if c is None:
                m, fill, c = -(-n // (capacity // ell)), {}, capacity
            else:
                m, fill = room[c].pop()
                if not room[c]:
                    del room[c]
            each = c // ell
            full = min(m, n // each)
            if full:
                room.setdefault(c - each * ell, []).append((full, fill | {ell: each}))
            n, m = n - full * each, m - full
            if n and m and n < each:
                room.setdefault(c - n * ell, []).append((1, fill | {ell: n}))
                n, m = 0, m - 1
            if m:
                room.setdefault(c, []).append((m, fill))
    return [g for groups in room.values() for g in groups if g[1]]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[int, dict[int, int]]]:
    """(number of sequences, {length: times in each}); every piece of the histogram has exactly one place."""
    out = [(histogram[capacity], {capacity: 1})] if histogram.get(capacity) else []
    lengths = np.array(sorted(k for k, v in histogram.items() if 0 < k < capacity and v), np.int64)
    if not len(lengths):
        return out
    left = np.array([histogram[int(k)] for k in lengths], np.int64)
    for times, x in sorted(relaxed(lengths, left.copy(), capacity, rounds), key=lambda p: -float(lengths @ p[0])):
        used = times > 0
        # fillings that leave room are for the rounding to improve on
        m = min(int(x), int((left[used] // times[used]).min())) if lengths @ times == capacity else 0
        if m > 0:
            left -= m * times
            out.append((m, {int(lengths[k]): int(times[k]) for k in np.flatnonzero(used)}))
    return out + best_fit(lengths[left > 0], left[left > 0], capacity)


def placed(rows: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """Rows of pieces() with sequence_id and offset.

    Pieces of one length are ranked in two steps, within a hash bucket and by the counts of
    the buckets before it, so that no length, however common, is ranked in one task.
    """
    spark = rows.sparkSession
    buckets = max(64, 4 * parts(spark))
    rows = rows.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    sizes = rows.groupBy("length", "_b").agg(F.count("*").alias("_n"))
    w = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    histogram = {r[0]: r[1] for r in rows.groupBy("length").agg(F.count("*")).collect()}  # capacity rows at most
    places: dict[int, list[tuple[int, int, int, int]]] = {}
    base, seen = 0, dict.fromkeys(histogram, 0)
    for m, fill in plan(histogram, capacity, rounds):
        at = 0
        for ell, times in sorted(fill.items(), reverse=True):
            places.setdefault(ell, []).append((seen[ell], times, base, at))
            seen[ell] += m * times
            at += times * ell
        base += m
    assert seen == histogram, "a piece has no place"
    index = {ell: tuple(np.array(c, np.int64) for c in zip(*p, strict=True)) for ell, p in places.items()}

    def look_up(batches):
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("_rank").to_numpy()
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for ell in np.unique(length).tolist():
                here = length == ell
                first, times, start, at = index[ell]
                k = np.searchsorted(first, rank[here], "right") - 1
                r = rank[here] - first[k]
                seq[here], off[here] = start[k] + r // times[k], at[k] + r % times[k] * ell
            yield pa.record_batch([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(seq), pa.array(off)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    order = Window.partitionBy("length", "_b").orderBy("doc_id", "piece", "ids_crc32")
    ranked = rows.withColumn("_r", F.row_number().over(order)).join(sizes.drop("_n"), ["length", "_b"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_before") + F.col("_r") - 1).alias("_rank"))
    return ranked.mapInArrow(look_up, f"{PIECES}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return placed(written(pieces(docs, tokenizer, capacity, end_id), "pieces"), capacity, rounds)


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op8_pack": op8_pack}
SQL: dict[str, str] = {}
