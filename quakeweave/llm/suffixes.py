"""Exact removal of repeated byte windows by a depth-limited radix sort of suffixes.

Every suffix of every text's UTF-8 bytes is ordered through its first ``depth`` bytes
only, by passes from the most significant digit on; suffixes that are alone in their group
after a pass are done, and the groups left after the last pass are exactly the repeated
windows.  The groups on the way, after ``passage`` bytes, are the shorter windows that
repeat; they are reported as well, but nothing is removed for them.

* Pass 0, over all suffixes, deals them by their rarest gram: of the 64-bit hashes of
  the ``GRAM``-byte grams within the first ``passage`` bytes, the least.  It depends on
  those bytes alone, so equal windows get the same bucket.  Neighbouring suffixes share
  their gram, so a bucket's members are runs of suffixes: (document, first, count).
  Buckets of one run are dropped; no equal windows lie in different buckets.
* The runs left are sent, with their bytes, to their buckets.  There the later passes
  part each bucket by successive digits of ``DIGIT`` bytes, compared by 64-bit hashes:
  two different windows would have to agree in the bucket and in every digit's hash.
* Runs with equal bytes are held once, however many there are, and the runs of a periodic
  stretch as one.  A bucket of more than ``HOT`` of these is dealt further before it is sent: by the bytes that ``STEP`` neighbouring
  suffixes have in common, and one of more than ``STEP`` times ``HOT`` by whole windows, of
  which only one is held.  So a task holds at most ``STEP`` times ``HOT`` short runs.

A null or empty text has no bytes.  Windows may overlap and repeat within a document;
they never cross documents.  Rows equal in doc_id and text count as separate
occurrences.  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeweave.llm._common import NULL_ID, drop, keyed, parts, table, written
from quakeweave.llm.hashing import M3, mix, small

DEPTH, PASSAGE, GRAM, DIGIT, HOT, STEP = 400, 256, 96, 128, 10_000, 34
#: Bytes of text that are hashed at a time; longer texts are taken in overlapping segments.
SEGMENT = 2 << 20
_BYTES = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * M3)
_BASE = 0xD1B54A32D192ED03


class Rolling:
    """Hashes of all substrings of one length of a byte array; powers are kept."""

    def __init__(self):
        self.power = self.inverse = np.ones(0, np.uint64)

    def sums(self, data: np.ndarray) -> np.ndarray:
        if len(self.power) < len(data):
            n = max(len(data), 2 * len(self.power))
            for name, base in (("power", _BASE), ("inverse", pow(_BASE, -1, 1 << 64))):
                p = np.full(n, np.uint64(base))
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * self.power[: len(data)], out=out[1:])
        return out

    def at(self, sums: np.ndarray, first: np.ndarray | None, length: int) -> np.ndarray:
        """Hash of each substring [first, first + length), of all where first is None."""
        if first is None:
            n = len(sums) - length
            return mix((sums[length:] - sums[:n]) * self.inverse[:n]) if n > 0 else np.zeros(0, np.uint64)
        return mix((sums[first + length] - sums[first]) * self.inverse[first])


def _least_at(g: np.ndarray, width: int) -> np.ndarray:
    """For each window of width values of g, where its least stands, the last of equals."""
    m = (g & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - np.arange(len(g), dtype=np.uint64))
    done = 1
    while done < width:
        step = min(done, width - done)
        m = np.minimum(m[: len(m) - step], m[step:])
        done += step
    return (np.uint64(0xFFFFFFFF) - (m & np.uint64(0xFFFFFFFF))).astype(np.int64)


def _segments(batch, depth: int):
    """(did, uid, offset, bytes) of the texts, overlapping by depth - 1 where a text is cut."""
    for did, uid, text in zip(batch.column("did").to_pylist(), batch.column("uid").to_pylist(), batch.column("text"), strict=True):
        data = text.as_buffer() if text.is_valid else None
        if data is not None and len(data) >= depth:
            view = np.frombuffer(data, np.uint8)
            for s in range(0, len(view) - depth + 1, SEGMENT):
                yield did, uid, s, view[s : s + SEGMENT + depth - 1]


def _gathered(segments, most: int = SEGMENT):
    held, size = [], 0
    for x in segments:
        if held and size + len(x[3]) > most:
            yield held
            held, size = [], 0
        held.append(x)
        size += len(x[3])
    if held:
        yield held


def _runs(texts: DataFrame, depth: int, gram: int) -> DataFrame:
    """(did, uid, key, first, n, gram, leads): runs of suffixes that share their least gram, and where it stands.

    In periodic text a run follows another of the same key; only the first of such a row leads.
    """

    def run(batches):
        rolling = Rolling()
        for batch in batches:
            for held in _gathered(_segments(batch, depth)):
                data = np.concatenate([x[3] for x in held])
                sizes = np.array([len(x[3]) for x in held])
                start = np.cumsum(sizes) - sizes
                g = rolling.at(rolling.sums(data), None, gram)
                least = _least_at(g, depth - gram + 1)
                owner = np.repeat(np.arange(len(held)), sizes)[: len(least)]
                good = np.flatnonzero(np.arange(len(least)) + depth <= (start + sizes)[owner])
                new = np.ones(len(good), bool)
                new[1:] = (least[good][1:] != least[good][:-1]) | (owner[good][1:] != owner[good][:-1])
                at = np.flatnonzero(new)
                first = good[at]
                of, key = owner[first], g[least[first]]
                leads = np.ones(len(key), bool)
                leads[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
                yield pa.record_batch(
                    [
                        pa.array(np.array([x[0] for x in held], np.int64)[of]), pa.array(np.array([x[1] for x in held], np.int64)[of]),
                        pa.array(key.view(np.int64)), pa.array(first - start[of] + np.array([x[2] for x in held], np.int64)[of]),
                        pa.array(np.diff(np.append(at, len(good))).astype(np.int32)), pa.array(least[first] - start[of] + np.array([x[2] for x in held], np.int64)[of]), pa.array(leads),
                    ],
                    ["did", "uid", "key", "first", "n", "gram", "leads"],
                )

    return texts.mapInArrow(run, "did long, uid long, key long, first long, n int, gram long, leads boolean")


def _bodies(chosen: DataFrame, depth: int, passage: int) -> DataFrame:
    """(key, did, uid, first, n, body): a run's bytes, as far as its n suffixes go; with a step, parted and dealt by what step suffixes have in common."""

    def run(batches):
        for batch in batches:
            out, size = tuple([] for _ in _BODY), 0
            for did, uid, text, runs in zip(*(batch.column(c) for c in ("did", "uid", "text", "runs")), strict=True):
                data = text.as_buffer()
                joined: list[dict] = []  # in periodic text each suffix has a gram of its own, all alike: their bytes are sent once
                for r in sorted(runs.as_py(), key=lambda r: r["first"]):
                    if joined and not r["step"] and r["key"] == joined[-1]["key"] and r["first"] == joined[-1]["first"] + joined[-1]["n"]:
                        joined[-1]["n"] += r["n"]
                    else:
                        joined.append(r)
                for r in joined:
                    first, last, gram, step = r["first"], r["first"] + r["n"] - 1, r["gram"], r["step"]
                    rows = [] if step else [(r["key"], first, last)]
                    for d in range((gram - last) // step, (gram - first) // step + 1) if step else ():
                        high = gram - d * step  # the last suffix of this part, if the run holds it
                        common = data[high : high - step + 1 + passage].to_pybytes()
                        rows.append((xxhash.xxh3_64_intdigest(common, (r["key"] + d) & (1 << 63) - 1) - (1 << 63), max(first, high - step + 1), min(last, high)))
                    for key, lo, hi in rows:
                        body = data[lo : hi + depth].to_pybytes()
                        for column, value in zip(out, (key, did.as_py(), uid.as_py(), lo, hi - lo + 1, body), strict=True):
                            column.append(value)
                        size += len(body)
                    if size > SEGMENT:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(out, _BODY_TYPES, strict=True)], _BODY)
                        out, size = tuple([] for _ in _BODY), 0
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, _BODY_TYPES, strict=True)], _BODY)

    return chosen.mapInArrow(run, _BODY_SCHEMA)


_BODY, _BODY_TYPES = ["key", "did", "uid", "first", "n", "body"], [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
_BODY_SCHEMA = "key long, did long, uid long, first long, n int, body binary"


def radix_groups(keys: np.ndarray, bodies: list[bytes], counts: np.ndarray, times: np.ndarray, rolling: Rolling, depths: tuple[int, ...], digit: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each of the ascending depths, (body number, offset) of every suffix whose first so many bytes equal another's of the same key.

    counts are the suffixes of each body; times tells how often a body stands.
    """
    sizes = np.array([len(b) for b in bodies], np.int64)
    start = np.cumsum(sizes) - sizes
    of = np.repeat(np.arange(len(bodies)), counts)
    offset = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    place, again = start[of] + offset, (times > 1)[of]
    group = mix(keys.view(np.uint64))[of]
    sums = rolling.sums(np.frombuffer(b"".join(bodies), np.uint8))
    alive, at, out = np.arange(len(of)), 0, []
    for depth in depths:
        alive = alive[offset[alive] + depth <= sizes[of[alive]]]
        while at < depth and len(alive):
            step = min(digit, depth - at)
            name = mix(group[alive] * M3 + rolling.at(sums, place[alive] + at, step))
            order = np.argsort(name)
            s = name[order]
            same = s[1:] == s[:-1]
            keep = again[alive][order]
            keep[1:] |= same
            keep[:-1] |= same
            group[alive] = name
            alive = alive[np.sort(order[keep])]
            at += step
        at = depth
        out.append((of[alive], offset[alive]))
    return out


def _spans(sent: DataFrame, depths: tuple[int, ...], digit: int) -> DataFrame:
    """(did, uid, depth, start, end) of bytes covered by repeated windows of each depth; input sorted by key, body and n."""

    def work(rolling, keys, bodies, counts, owners):
        rows = []
        found = radix_groups(np.array(keys, np.int64), bodies, np.array(counts), np.array([len(o) for o in owners]), rolling, depths, digit)
        for depth, (of, offset) in zip(depths, found, strict=True):
            new = np.ones(len(of), bool)
            new[1:] = (of[1:] != of[:-1]) | (offset[1:] != offset[:-1] + 1)
            at = np.flatnonzero(new)
            lo, hi = offset[at], offset[np.append(at[1:], len(of)) - 1] + depth if len(of) else offset
            rows += [(did, uid, depth, first + a, first + b) for k, a, b in zip(of[at].tolist(), lo.tolist(), hi.tolist(), strict=True) for did, uid, first in owners[k]]
        return pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else ((),) * 5)], ["did", "uid", "depth", "start", "end"])

    def run(batches):
        rolling = Rolling()
        keys, bodies, counts, owners, size = [], [], [], [], 0
        for batch in batches:
            for key, did, uid, first, n, body in zip(*(batch.column(c).to_pylist() for c in _BODY), strict=True):
                if keys and key == keys[-1] and n == counts[-1] and body == bodies[-1]:
                    owners[-1].append((did, uid, first))
                    continue
                if keys and key != keys[-1] and size > SEGMENT:
                    yield work(rolling, keys, bodies, counts, owners)
                    keys, bodies, counts, owners, size = [], [], [], [], 0
                keys.append(key)
                bodies.append(body)
                counts.append(n)
                owners.append([(did, uid, first)])
                size += len(body)
        if keys:
            yield work(rolling, keys, bodies, counts, owners)

    return sent.mapInArrow(run, "did long, uid long, depth long, start long, end long")


def repeated_spans(docs: DataFrame, depth: int = DEPTH, passage: int = PASSAGE, gram: int = GRAM, digit: int = DIGIT, hot: int = HOT) -> DataFrame:
    """(did, uid, depth, start, end): bytes that a repeated window of depth or passage bytes covers; spans of a document may overlap."""
    return _repeated(keyed(docs), depth, passage, gram, digit, hot)


def _repeated(texts: DataFrame, depth: int, passage: int, gram: int, digit: int, hot: int) -> DataFrame:
    spark, passage = texts.sparkSession, min(passage, depth)
    runs = written(_runs(texts, passage, gram), "runs")
    step = F.when(F.col("led") <= hot, 0).when(F.col("led") <= STEP * hot, STEP).otherwise(1)
    buckets = runs.groupBy("key").agg(F.count("*").alias("c"), F.count_if("leads").alias("led")).filter("c > 1").select("key", step.alias("step"))
    # each table cuts the shuffles behind it, so that those of two steps are never on disk together
    chosen = written(runs.join(buckets, "key").groupBy("did", "uid").agg(F.collect_set(F.struct("first", "n", "gram", "key", "step")).alias("runs")), "chosen")
    drop(runs)
    sent = _bodies(texts.join(chosen, ["did", "uid"]), depth, passage)
    spans = written(_spans(sent.repartition(parts(spark), "key").sortWithinPartitions("key", "body", "n"), tuple(sorted({passage, depth})), digit), "spans")
    drop(chosen)
    return spans


def without_repeats(docs: DataFrame, depth: int = DEPTH, passage: int = PASSAGE, gram: int = GRAM, digit: int = DIGIT, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary: what is left of the text's bytes), n_passage (bytes that repeated windows of passage bytes cover)."""
    texts = keyed(docs)
    spans = _repeated(texts, depth, passage, gram, digit, hot)
    part = lambda shown: F.collect_set(F.when(F.col("depth") == shown, F.struct("start", "end")))
    by_doc = spans.groupBy("did", "uid").agg(part(depth).alias("spans"), part(min(passage, depth)).alias("passages"))

    def runs_of(spans):
        """Disjoint (start, end), in order."""
        out = []
        for s, e in sorted((x["start"], x["end"]) for x in spans or ()):
            if out and s <= out[-1][1]:
                out[-1][1] = max(out[-1][1], e)
            else:
                out.append([s, e])
        return out

    def run(batches):
        for batch in small(batches):
            out = tuple([] for _ in names)
            for did, text, spans, passages in zip(*(batch.column(c) for c in ("did", "text", "spans", "passages")), strict=True):
                data = text.as_py().encode() if text.is_valid else b""
                gone = runs_of(spans.as_py())
                kept = b"".join(data[a:b] for a, b in zip([0, *(e for _, e in gone)], [*(s for s, _ in gone), len(data)], strict=True))
                d = did.as_py()
                row = (None if d == NULL_ID else d, len(data), len(data) - len(kept), len(gone), kept, sum(e - s for s, e in runs_of(passages.as_py())))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            yield pa.record_batch([pa.array(c, pa.binary() if n == "kept" else pa.int64()) for c, n in zip(out, names, strict=True)], names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "n_passage"]
    return texts.join(by_doc, ["did", "uid"], "left").mapInArrow(run, ", ".join(f"{n} {'binary' if n == 'kept' else 'long'}" for n in names))


def op5_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passage")


QUERIES = {"op5_suffixes": op5_suffixes}
SQL: dict[str, str] = {}
