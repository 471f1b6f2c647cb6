"""Line dedup by a deletion-neighbourhood join.

Lines are compared in normal form: A-Z in lower case, words parted by one space.  A
line that is not blank is removed if an earlier line, in order of doc_id and place, is
equal to it, whatever its length, or near it, an earlier line that is itself removed
included.  Two lines are near if one edit, an insertion, deletion or substitution of a
unit, makes one the other.  Of lines of ``words`` words or more a unit is a word, so that
one word in as many may differ, by however many code points; of other lines of
``shortest`` code points or more it is a code point.  Lines of different units are not
compared, and shorter ones are removed as exact copies only.  Blank lines part
paragraphs and stay.

Equal lines are found by hash and represented by their first occurrence.  For the rest
each line emits the hashes of its deletion neighbourhood: itself, and itself less the
unit at each place.  Two lines are one substitution apart exactly if they share a
variant made at the same place, and one insertion apart exactly if a variant of one is
the other; so a group needs no pairs, only the earliest member of either role.  Each
match is verified by its edit distance.  Long lines have as many variants as units, so
only lines that can match are expanded: of two lines within one edit, one shares its
first and one its last half, of the shorter's length, with the other.

Null texts stay null, without lines; empty texts stay empty.  Rows equal in doc_id and
text are one document: they keep the same lines.  Null doc_ids come last.  An empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeweave.llm._common import NULL_ID, drop, keyed, parts, table, written
from quakeweave.llm.hashing import M3, mix, small

#: Least words of a line whose units are words, least code points of one whose units are code points.
WORDS, SHORTEST = 8, 20


def normal(line: str) -> str:
    return b" ".join(line.encode().lower().split()).decode()


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode()) - (1 << 63)


def units(line: str, words: int = WORDS, shortest: int = SHORTEST) -> list[str] | str:
    """What an edit of the line changes one of; nothing if the line is too short."""
    parted = line.split(" ")
    return parted if len(parted) >= words else line if len(line) >= shortest else ""


def _halves(line: str, words: int, shortest: int) -> list[int]:
    """Keys of which two lines within one edit share one: their unit, common length class, side and half."""
    parted, out = units(line, words, shortest), []
    glue, least = (" ", words) if isinstance(parted, list) else ("", shortest)
    for m in (len(parted), len(parted) - 1):
        if m >= least:
            out += [_hash(f"{glue}{m}{side}{glue.join(half)}") for side, half in (("<", parted[: m // 2]), (">", parted[len(parted) - m // 2 :]))]
    return out


def _lines(texts: DataFrame, words: int, shortest: int) -> DataFrame:
    """(did, uid, pos, h, halves) of the lines that are not blank; short ones have no halves."""

    def run(batches):
        for batch in small(batches):
            out = ([], [], [], [], [])
            for did, uid, text in zip(*(batch.column(c).to_pylist() for c in ("did", "uid", "text")), strict=True):
                for pos, line in enumerate((text or "").split("\n")):
                    if line := normal(line):
                        for column, value in zip(out, (did, uid, pos, _hash(line), _halves(line, words, shortest)), strict=True):
                            column.append(value)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64())), strict=True)], ["did", "uid", "pos", "h", "halves"])

    return texts.mapInArrow(run, "did long, uid long, pos int, h long, halves array<long>")


def _fetched(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h, first, line): the normal form of the wanted (h, first) lines."""
    by_doc = wanted.groupBy(F.col("first.did").alias("did"), F.col("first.uid").alias("uid")).agg(F.collect_list(F.struct(F.col("first.pos").alias("pos"), "h")).alias("take"))

    def run(batches):
        for batch in small(batches):
            out = ([], [], [], [], [])
            for did, uid, text, take in zip(*(batch.column(c).to_pylist() for c in ("did", "uid", "text", "take")), strict=True):
                lines = text.split("\n")
                for x in take:
                    for column, value in zip(out, (x["h"], did, uid, x["pos"], normal(lines[x["pos"]])), strict=True):
                        column.append(value)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string()), strict=True)], ["h", "did", "uid", "pos", "line"])

    rows = texts.join(by_doc, ["did", "uid"]).mapInArrow(run, "h long, did long, uid long, pos int, line string")
    return rows.select("h", F.struct("did", "uid", "pos").alias("first"), "line").dropDuplicates(["h"])


def _shared(halves: DataFrame) -> DataFrame:
    """h of the lines that share a half with another line; sorted by half and h, of which only the last group's ends are held."""

    def run(batches):
        held = None  # the last row's half and h, and its group's first h
        for batch in batches:
            half, h = batch.column("half").to_numpy(), batch.column("h").to_numpy()
            if not len(half):
                continue
            new = np.ones(len(half), bool)
            new[1:] = half[1:] != half[:-1]
            first = h[np.maximum.accumulate(np.where(new, np.arange(len(half)), 0))]
            other = np.zeros(len(half), bool)
            other[1:] = ~new[1:] & (h[1:] != h[:-1])
            if held is not None and held[0] == half[0]:
                here = np.cumsum(new) == 1
                first = np.where(here, held[2], first)
                other[0] = h[0] != held[1]
            held = (half[-1], h[-1], first[-1])
            yield pa.record_batch([pa.array(np.unique(np.concatenate([h[other], first[other]])))], ["h"])

    return halves.mapInArrow(run, "h long").distinct()


def variant_hashes(parted: list[str] | str) -> tuple[int, np.ndarray]:
    """(hash of the units, hash of the units less each of them)."""
    of = np.fromiter((_hash(x) for x in parted), np.int64, len(parted)).view(np.uint64) if isinstance(parted, list) else np.frombuffer(parted.encode("utf-32-le"), np.uint32).astype(np.uint64)
    c = mix(of + M3)
    base, n = M3 | np.uint64(1), len(parted)
    power = np.full(n, base)
    power[:1] = 1
    power = np.multiply.accumulate(power)
    terms = c * power
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms)])
    back = np.uint64(pow(int(base), -1, 1 << 64))
    less = upto[:-1] + (upto[-1:] - upto[1:]) * back
    size = np.uint64(n)
    return int(mix(upto[-1:] ^ mix(size.reshape(1)))[0].view(np.int64)), mix(less ^ mix((size - np.uint64(1)).reshape(1))).view(np.int64)


def within_one(a: list[str] | str, b: list[str] | str) -> bool:
    """Whether one edit at most makes a b."""
    if type(a) is not type(b) or abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return any(a[i + j :] == b[i + k :] for j, k in ((0, 0), (1, 1), (0, 1), (1, 0)))


def _neighbourhood(lines: DataFrame, words: int, shortest: int) -> DataFrame:
    """(key, role, h): role 0 the line itself, 1 a variant, 2 a variant together with its place."""

    def run(batches):
        for batch in batches:
            keys, roles, owners, size = [], [], [], 0
            for h, line in zip(batch.column("h").to_pylist(), batch.column("line").to_pylist(), strict=True):
                own, less = variant_hashes(units(line, words, shortest))
                alike = np.unique(less)
                placed = mix(less.view(np.uint64) * M3 + np.arange(1, len(less) + 1, dtype=np.uint64)).view(np.int64)
                keys += [np.array([own]), alike, placed]
                roles.append(np.repeat(np.array([0, 1, 2], np.int8), [1, len(alike), len(placed)]))
                owners.append(np.full(1 + len(alike) + len(placed), h))
                size += len(owners[-1])
                if size > 1 << 17:
                    yield pa.record_batch([pa.array(np.concatenate(c)) for c in (keys, roles, owners)], ["key", "role", "h"])
                    keys, roles, owners, size = [], [], [], 0
            if size:
                yield pa.record_batch([pa.array(np.concatenate(c)) for c in (keys, roles, owners)], ["key", "role", "h"])

    return lines.select("h", "line").mapInArrow(run, "key long, role byte, h long")


def _met(rows: DataFrame) -> DataFrame:
    """The rows whose key another row has as well; sorted by key, of which only the last row is held."""

    def run(batches):
        held = None  # the last row of the batch before, and whether it was given
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([held[0], batch] if held else [batch]).combine_chunks()
            key = rows.column("key").to_numpy()
            same = key[1:] == key[:-1]
            keep = np.zeros(len(key), bool)
            keep[1:] |= same
            keep[:-1] |= same
            if held and held[1]:
                keep[0] = False
            last = bool(keep[-1]) or bool(held and held[1] and len(key) == 1)
            held = (batch.slice(batch.num_rows - 1), last)
            yield from rows.filter(pa.array(keep)).to_batches()

    return rows.mapInArrow(run, "key long, role byte, h long")


def _near(lines: DataFrame, words: int, shortest: int) -> DataFrame:
    """h of the lines within one edit of an earlier one."""

    def run(batches):
        for batch in batches:
            a, b = ([units(x, words, shortest) for x in batch.column(c).to_pylist()] for c in "ab")
            yield batch.select(["h"]).filter(pa.array([within_one(x, y) for x, y in zip(a, b, strict=True)], pa.bool_()))

    rows = _neighbourhood(lines, words, shortest).repartition(parts(lines.sparkSession), "key").sortWithinPartitions("key")
    rows = written(_met(rows).join(lines.select("h", "first"), "h"), "met")
    me, role = F.struct("first", "h"), F.col("role")
    least = rows.groupBy("key").agg(*[F.min(F.when(role == r, me)).alias(f"m{r}") for r in (0, 1, 2)])
    other = F.when(role == 0, F.col("m1")).when(role == 1, F.col("m0")).otherwise(F.col("m2"))
    found = rows.join(least, "key").select("h", "first", other.alias("o")).filter(F.col("o.first") < F.col("first"))
    pairs = found.select("h", F.col("o.h").alias("oh")).distinct()
    a, b = lines.select("h", F.col("line").alias("a")), lines.select(F.col("h").alias("oh"), F.col("line").alias("b"))
    return pairs.join(a, "h").join(b, "oh").select("h", "a", "b").mapInArrow(run, "h long").distinct()


def removed_lines(docs: DataFrame, words: int = WORDS, shortest: int = SHORTEST) -> DataFrame:
    """(did, uid, removed): the places, from 0, of the lines to remove from each document that has any."""
    texts = keyed(docs)
    lines = written(_lines(texts, words, shortest), "lines")
    firsts = lines.groupBy("h").agg(F.min(F.struct("did", "uid", "pos")).alias("first"), F.count("*").alias("n"))
    firsts = written(firsts, "firsts")
    halves = lines.select("h", F.explode(F.array_distinct("halves")).alias("half"))
    possible = _shared(halves.repartition(parts(docs.sparkSession), "half").sortWithinPartitions("half", "h"))
    candidates = written(_fetched(texts, firsts.select("h", "first").join(possible, "h")), "possible")
    near = written(_near(candidates, words, shortest), "near").withColumn("near", F.lit(True))
    drop(candidates)
    again = firsts.select("h", "first", "n").join(near, "h", "left").filter("n > 1 or near").select("h", "first", F.coalesce("near", F.lit(False)).alias("near"))
    here = F.struct("did", "uid", "pos")
    gone = lines.select("did", "uid", "pos", "h").join(again, "h").filter(F.col("near") | (here != F.col("first")))
    return gone.groupBy("did", "uid").agg(F.sort_array(F.collect_set("pos")).alias("removed"))


def deduplicated(docs: DataFrame, words: int = WORDS, shortest: int = SHORTEST) -> DataFrame:
    """The documents with their texts less the removed lines, all their columns (n_chars counted anew), and _lines and _removed."""
    gone = removed_lines(docs, words, shortest).select(F.col("did").alias("_did"), F.col("uid").alias("_uid"), F.col("removed").alias("_removed"))
    out = docs.withColumns({"_did": F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)), "_uid": F.xxhash64("doc_id", "text")}).join(gone, ["_did", "_uid"], "left")
    lines = F.split("text", "\n")
    left = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("_removed", i)), "\n")
    changed = {"text": F.when(F.col("_removed").isNull(), F.col("text")).otherwise(left), "_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size(lines))}
    out = out.withColumns(changed).withColumn("_removed", F.coalesce("_removed", F.array().cast("array<int>")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns, "_lines", "_removed")


def op1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", F.col("_lines").cast("long").alias("n_lines"), F.size("_removed").cast("long").alias("n_removed"), F.concat_ws(",", F.col("_removed").cast("array<string>")).alias("removed"), F.sha2("text", 256).alias("text_sha256")
    )


QUERIES = {"op1_lines": op1_lines}
SQL: dict[str, str] = {}
