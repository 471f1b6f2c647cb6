"""Exact n-gram Jaccard join by PartEnum signatures.

A document's set is its distinct ``n``-word shingles.  Set sizes fall into bands; a set
signs its own band, and the next one if a set of that band can still be similar enough.
In a band whose largest size is r, two similar sets differ in at most
k = floor(2 r (1-t)/(1+t)) shingles.  The shingle domain is dealt by hash into
k // 2 + 1 first-level partitions, in one of which two such sets differ in one shingle
at most, and each of these into ``SECOND`` second-level ones, of which all subsets that
leave out one are enumerated: one subset has no difference at all.  Its shingles are the
signature that the sets share.  (With k = 0 only equal sets are similar.)

A subset that a set has no shingle in would be shared by most sets of a band, and is no
signature.  A set with so many partitions with such subsets that they could be all it
has in common with a similar set signs again with other hashes, ``ROUNDS`` times at most;
the last time empty subsets count as well, so no link is lost.

Equal sets are one class from the start, however many documents hold them.  Within a
signature's group only (first member, member) is tested; then components are formed,
and only where a group spans several components are the pairs between those tested,
which loses no link: a pair left out is connected already.  A group of more than ``HOT``
sets that still spans several components is first parted by a further enumeration, so
that similar sets meet in smaller groups.  Before sets are compared, pairs are pruned by
size and by 1024 parity bits, of which each shingle flips one: two sets that differ in
more bits than similar sets may differ in elements cannot link.

The links found are those that the components need, not all: a class of m near copies is
joined by about m links, and a number of links by document is not given.

Null and empty texts have an empty set, linked with nothing.  Rows are known by doc_id
and text, so rows of one doc_id may be in different classes; equal rows are one class.
Null doc_ids come after all others.  An empty table gives no rows.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quakeweave.llm._common import NULL_ID, chosen, drop, keyed, parts, table, unkeyed, written
from quakeweave.llm.hashing import M3, WordHasher, flat_words, mix, shingles, small
from quakeweave.operators.components import components

SHINGLE, PERCENT = 5, 80
BAND, SECOND, ROUNDS, HOT = 1.35, 3, 4, 2000
SALT = np.uint64(0x5851F42D4C957F2D)
WIDE, FOLDED = 16, 4
SUBSETS = [list(s) for s in combinations(range(SECOND), SECOND - 1)]


def bands(top: int, percent: int) -> np.ndarray:
    """Least size of each band up to top; a band is wide enough that similar sets are in the same or the next one."""
    ratio = max(BAND, 100 / percent)
    out = [1]
    while out[-1] <= top:
        out.append(max(out[-1] + 1, math.ceil(out[-1] * ratio)))
    return np.array(out, np.int64)


def differences(both: np.ndarray, percent: int) -> np.ndarray:
    """Most elements in which two sets of so many elements together may differ."""
    return both * (100 - percent) // (100 + percent)


def _enumerated(takes: np.ndarray, doc: np.ndarray, h: np.ndarray, n1: np.ndarray, band: np.ndarray, salt: int, last: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set number, signature) of the sets that take part, and for every set its number of first-level partitions with an empty subset."""
    n = np.where(takes, n1, 0)
    first, total = np.cumsum(n) - n, int(n.sum())
    here = takes[doc]
    d, x = doc[here], h[here]
    dealt = mix(x + np.uint64(salt) * M3 ^ SALT)
    cell = (first[d] + (dealt % n[d].astype(np.uint64)).astype(np.int64)) * SECOND + (dealt // n[d].astype(np.uint64) % np.uint64(SECOND)).astype(np.int64)
    sums, sizes = np.zeros(total * SECOND, np.uint64), np.bincount(cell, minlength=total * SECOND).reshape(-1, SECOND)
    np.add.at(sums, cell, mix(x + M3))
    sums = sums.reshape(-1, SECOND)
    of = np.repeat(np.arange(len(n)), n)
    place = mix((band[of] * (1 << 32) + np.arange(total) - first[of]).astype(np.uint64) * np.uint64(ROUNDS * 8) + np.uint64(salt))
    empty = np.zeros(total, bool)
    out_of, out_sig = [], []
    for j, s in enumerate(SUBSETS):
        full = sizes[:, s].any(axis=1)
        empty |= ~full
        use = slice(None) if last else full
        out_of.append(of[use])
        out_sig.append(mix(mix(sums[:, s].sum(axis=1, dtype=np.uint64)[use] + np.uint64(1)) + place[use] + np.uint64(j)))
    return np.concatenate(out_of), np.concatenate(out_sig), np.bincount(of[empty], minlength=len(n))


def signatures(doc: np.ndarray, h: np.ndarray, sizes: np.ndarray, percent: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(set number, 64-bit signature) of every set; doc, h as from shingles()."""
    edge = bands(4 * int(sizes.max(initial=1)) + 10, percent)  # the band after the largest set whole, in every batch alike
    own = np.searchsorted(edge, sizes, "right") - 1
    out: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    for ahead in (0, 1):
        band = own + ahead
        high = edge[band + 1] - 1
        k = differences(2 * high, percent)
        n1 = k // 2 + 1
        takes = (sizes > 0) & (k > 0) & ((ahead == 0) | (100 * sizes >= percent * edge[band]))
        # of so many first-level partitions at least a similar set differs in one shingle at most
        alike = n1 - differences(sizes + np.minimum(high, 100 * sizes // percent), percent) // 2
        for again in range(ROUNDS):
            if not takes.any():
                break
            of, sig, empty = _enumerated(takes, doc, h, n1, band, salt * ROUNDS + again, again == ROUNDS - 1)
            out.append((of, sig))
            takes = takes & (empty >= alike)
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def digests(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """128 bits of each set."""
    out = np.zeros((n, 2), np.uint64)
    np.add.at(out[:, 0], doc, mix(h))
    np.add.at(out[:, 1], doc, mix(h ^ SALT))
    return out


def parity(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """WIDE words of 64 bits for each set, each shingle flipping one bit: two sets differ in no more bits than elements."""
    out = np.zeros(n * WIDE, np.uint64)
    at = (mix(h + SALT) & np.uint64(64 * WIDE - 1)).astype(np.int64)
    np.bitwise_xor.at(out, doc * WIDE + at // 64, np.uint64(1) << (at % 64).astype(np.uint64))
    return out.reshape(n, WIDE)


def _blobs(x: np.ndarray) -> pa.Array:
    """Rows of numbers as binary values."""
    width = x.shape[1] * x.dtype.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(x), [None, pa.py_buffer(np.ascontiguousarray(x).tobytes())]).cast(pa.binary())


def _numbers(column: pa.Array, words: int) -> np.ndarray:
    """Binary values of so many 64-bit words, none null, as rows of numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, words)


def _of_texts(batch, hasher: WordHasher, n: int) -> tuple[np.ndarray, np.ndarray, int]:
    words, counts = flat_words(batch.column("text").to_pylist(), hasher)
    return *shingles(words, counts, n), len(counts)


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """did, uid, n_shingles, h (the set's digest; null if empty), wide (its parity bits)."""

    def run(batches):
        hasher = WordHasher()
        for batch in small(batches):
            doc, h, k = _of_texts(batch, hasher, n)
            sizes = np.bincount(doc, minlength=k)
            names = pa.array([x.tobytes() if s else None for x, s in zip(digests(doc, h, k), sizes, strict=True)], pa.binary())
            yield pa.record_batch([batch.column("did"), batch.column("uid"), pa.array(sizes.astype(np.int64)), names, _blobs(parity(doc, h, k))], ["did", "uid", "n_shingles", "h", "wide"])

    return docs.mapInArrow(run, "did long, uid long, n_shingles long, h binary, wide binary")


def _signed(docs: DataFrame, n: int, percent: int, salt: int = 0) -> DataFrame:
    """(sig, a, b): the signatures of every set with its digest's two words; of equal sets in a task once."""

    def run(batches):
        hasher, seen = WordHasher(), set()
        for batch in small(batches):
            doc, h, k = _of_texts(batch, hasher, n)
            name = digests(doc, h, k)
            new = np.zeros(k, bool)
            for i, x in enumerate(name):
                if (x := x.tobytes()) not in seen:
                    seen.add(x)
                    new[i] = True
            keep = new[doc]
            of, sig = signatures(doc[keep], h[keep], np.where(new, np.bincount(doc, minlength=k), 0), percent, salt)
            order = np.argsort(of, kind="stable")
            yield pa.record_batch([pa.array(x.view(np.int64)) for x in (sig[order], name[of[order], 0].copy(), name[of[order], 1].copy())], ["sig", "a", "b"])

    return docs.mapInArrow(run, "sig long, a long, b long")


def _groups(signed: DataFrame) -> DataFrame:
    """(sig, h, first): members of the groups of two sets or more, with the group's first.

    The input is sorted by all columns; of a group that goes on in the next batch only its first and last are held.
    """

    def run(batches):
        held = None  # sig and h of the last group's first; its last h; whether the first was given
        for batch in batches:
            k = batch.num_rows
            if not k:
                continue
            sig = batch.column("sig").to_numpy()
            h = np.stack([batch.column(c).to_numpy() for c in ("a", "b")], axis=1)
            goes_on = held is not None and held[0] == sig[0]
            new = np.ones(k, bool)
            new[1:] = sig[1:] != sig[:-1]
            start = np.maximum.accumulate(np.where(new, np.arange(k), 0))
            first = h[start]
            other = np.zeros(k, bool)
            other[1:] = ~new[1:] & (h[1:] != h[:-1]).any(1)
            if goes_on:
                first[start == 0] = held[1]
                other[0] = bool((h[0] != held[2]).any())
            firsts = np.unique(start[other])  # groups whose first is to be given as well
            if goes_on and held[3]:
                firsts = firsts[firsts != 0]
            rows = np.flatnonzero(other)
            of = np.concatenate([firsts, rows])
            if len(of):
                yield pa.record_batch([pa.array(sig[of]), _blobs(np.concatenate([first[firsts], h[rows]])), _blobs(first[of])], ["sig", "h", "first"])
            last = int(start[-1])
            carried = goes_on and last == 0
            held = (sig[-1], first[-1].copy(), h[-1].copy(), bool(other[last:].any()) or (carried and held[3]))

    spark = signed.sparkSession
    return signed.repartition(parts(spark), "sig").sortWithinPartitions("sig", "a", "b").mapInArrow(run, "sig long, h binary, first binary")


def _may_link(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """The (u, v) whose sizes and parity bits allow a link."""

    def run(batches):
        for batch in batches:
            n, m = batch.column("n").to_numpy(), batch.column("m").to_numpy()
            apart = np.bitwise_count(_numbers(batch.column("x"), WIDE) ^ _numbers(batch.column("y"), WIDE)).sum(axis=1, dtype=np.int64)
            ok = (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (apart <= differences(n + m, percent))
            yield batch.select(["u", "v"]).filter(pa.array(ok))

    left = members.select(F.col("h").alias("u"), F.col("n"), F.col("wide").alias("x"))
    right = members.select(F.col("h").alias("v"), F.col("n").alias("m"), F.col("wide").alias("y"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "n", "m", "x", "y").mapInArrow(run, "u binary, v binary")


def _linked(pairs: DataFrame, members: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The (u, v) of pairs whose sets are similar enough, counted on the texts."""

    def run(batches):
        hasher, sets = WordHasher(), {}
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                names = [(part.column(c).to_pylist(), part.column(t).to_pylist()) for c, t in (("u", "x"), ("v", "y"))]
                new = {h: t for hs, ts in names for h, t in zip(hs, ts, strict=True)}
                sets = {h: sets[h] for h in new if h in sets}
                for h, t in new.items():
                    if h not in sets:
                        sets[h] = shingles(*flat_words([t], hasher), n)[1]
                keep = []
                for u, v in zip(names[0][0], names[1][0], strict=True):
                    a, b = sets[u], sets[v]
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    keep.append(100 * both >= percent * (len(a) + len(b) - both))
                yield part.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    pairs = written(pairs, "pairs")
    need = pairs.select(F.col("u").alias("h")).union(pairs.select(F.col("v").alias("h"))).distinct().join(members.select("h", "rep"), "h")
    need = written(need.select("h", "rep.did", "rep.uid"), "need")
    texts = written(chosen(docs, need).select("h", "text").dropDuplicates(["h"]), "texts")
    left, right = texts.select(F.col("h").alias("u"), F.col("text").alias("x")), texts.select(F.col("h").alias("v"), F.col("text").alias("y"))
    out = written(pairs.join(right, "v").join(left, "u").mapInArrow(run, "u binary, v binary"), "links")
    drop(pairs)
    drop(texts)
    return out


def _across(rows: DataFrame, percent: int) -> DataFrame:
    """(u, v) of members of a group in different components that may link; rows (sig, n, h, c, bits) sorted by sig and n, of which only the last group is held."""

    def run(batches):
        def given(sig, n, h, c, bits):
            at, far = np.arange(len(sig)), 1
            # in order of size, so what is too large for a set is followed by larger ones
            while len(at := at[at + far < len(sig)]) and len(at := at[(sig[at] == sig[at + far]) & (100 * n[at] >= percent * n[at + far])]):
                to = at + far
                ok = (c[at] != c[to]).any(axis=1)
                x, y = at[ok], to[ok]
                near = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64) <= differences(n[x] + n[y], percent)
                if near.any():
                    yield pa.record_batch([_blobs(h[x[near]]), _blobs(h[y[near]])], ["u", "v"])
                far += 1

        held: list[np.ndarray] | None = None
        for batch in batches:
            new = [batch.column("sig").to_numpy(), batch.column("n").to_numpy(), *(_numbers(batch.column(c), w) for c, w in (("h", 2), ("c", 2), ("bits", FOLDED)))]
            held = [np.concatenate([x, y]) for x, y in zip(held, new, strict=True)] if held else new
            if len(held[0]):
                whole = int(np.searchsorted(held[0], held[0][-1]))
                yield from given(*[x[:whole] for x in held])
                held = [x[whole:] for x in held]
        if held:
            yield from given(*held)

    return rows.mapInArrow(run, "u binary, v binary").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _folded(members: DataFrame) -> DataFrame:
    """(h, n, bits): the parity bits folded to FOLDED words."""

    def run(batches):
        for batch in batches:
            wide = _numbers(batch.column("wide"), WIDE).reshape(-1, WIDE // FOLDED, FOLDED)
            yield pa.record_batch([batch.column("h"), batch.column("n"), _blobs(np.bitwise_xor.reduce(wide, axis=1))], ["h", "n", "bits"])

    return members.select("h", "n", "wide").mapInArrow(run, "h binary, n long, bits binary")


def _spelt(rows: DataFrame) -> DataFrame:
    """(sig, h) -> (sig, a, b)."""

    def run(batches):
        for batch in batches:
            h = _numbers(batch.column("h"), 2).view(np.int64)
            yield pa.record_batch([batch.column("sig"), *(pa.array(h[:, k].copy()) for k in (0, 1))], ["sig", "a", "b"])

    return rows.mapInArrow(run, "sig long, a long, b long")


def _between(groups: DataFrame, comps: DataFrame, members: DataFrame, docs: DataFrame, n: int, percent: int, hot: int, again: bool = True) -> DataFrame:
    """(u, v) that may link, of the groups that span several components; larger groups than hot are parted first."""
    named = groups.select("sig", "h").join(comps.withColumnRenamed("node", "h"), "h", "left").select("sig", "h", F.coalesce("component", "h").alias("c"))
    mixed = named.groupBy("sig").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("size")).filter("lo <> hi").select("sig", "size")
    rows = written(named.join(mixed, "sig"), "mixed")
    usual = rows.filter(F.col("size") <= hot) if again else rows
    ready = usual.join(_folded(members), "h").select("sig", "n", "h", "c", "bits")
    pairs = _across(ready.repartition(parts(docs.sparkSession), "sig").sortWithinPartitions("sig", "n", "h"), percent)
    large = rows.filter(F.col("size") > hot).select("sig", "h")
    if again and not large.isEmpty():
        wanted = large.select("h").distinct().join(members.select("h", "rep"), "h").select("rep.did", "rep.uid")
        more = _signed(chosen(docs, wanted), n, percent, 1).withColumnRenamed("sig", "more")
        parted = written(_groups(_spelt(large).join(more, ["a", "b"]).select(F.xxhash64("sig", "more").alias("sig"), "a", "b")), "parted")
        pairs = pairs.union(_between(parted, comps, members, docs, n, percent, hot, False)).distinct()
    return pairs


def classes(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT, hot: int = HOT) -> DataFrame:
    """did, uid, n_shingles, first (did and uid of the least row reachable); a row for each row of docs."""
    docs = keyed(docs)
    sets = written(_sets(docs, n), "sets")
    groups = written(_groups(_signed(docs, n, percent)), "groups")
    row = F.struct("did", "uid")
    known = sets.filter("h is not null").join(groups.select("h").distinct(), "h")
    members = written(known.groupBy("h").agg(F.min(row).alias("rep"), F.max("n_shingles").alias("n"), F.max("wide").alias("wide")), "members")
    star = groups.filter("h <> first").select(F.col("first").alias("u"), F.col("h").alias("v")).distinct()
    links = _linked(_may_link(star, members, percent), members, docs, n, percent)
    comps = components(links)
    late = _linked(_may_link(_between(groups, comps, members, docs, n, percent, hot), members, percent), members, docs, n, percent)
    if not late.isEmpty():
        comps = components(links.union(late))
    drop(groups)
    names = sets.filter("h is not null").groupBy("h").agg(F.min(row).alias("rep")).join(comps.withColumnRenamed("node", "h"), "h", "left").withColumn("c", F.coalesce("component", "h"))
    names = written(names.select("h", "rep", "c"), "names")
    least = names.groupBy("c").agg(F.min("rep").alias("first"))
    out = sets.select("did", "uid", "n_shingles", "h").join(names.join(least, "c").select("h", "first"), "h", "left")
    return out.select("did", "uid", "n_shingles", F.coalesce("first", row).alias("first"))


def near_duplicates(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id."""
    out = classes(docs, n, percent).withColumn("least", F.col("first.did"))
    return out.select(unkeyed(), "n_shingles", F.when(F.col("least") != F.lit(NULL_ID), F.col("least")).alias("component_id"))


def first_of_each(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The row of least doc_id of each class (of one doc_id, by hash of the text), all its columns; of equal rows one stays.

    Rows without a word are classes of their own.
    """
    keep = classes(docs, n, percent).filter(F.col("first") == F.struct("did", "uid")).select(F.col("did").alias("_did"), F.col("uid").alias("_uid")).distinct()
    did = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))
    rows = docs.withColumns({"_did": did, "_uid": F.xxhash64("doc_id", "text")}).join(keep, ["_did", "_uid"], "left_semi")
    nth = F.row_number().over(Window.partitionBy("_did", "_uid").orderBy(*[F.col(c) for c in docs.columns]))
    return rows.withColumn("_nth", nth).filter("_nth = 1").select(*docs.columns)


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), 3, 90)


QUERIES = {"op6_jaccard": op6_jaccard}
SQL = {
    "op6_jaccard": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(generate_series(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])
                              WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT p.i, p.j FROM p JOIN n x ON x.doc_id = p.i JOIN n y ON y.doc_id = p.j WHERE 100 * p.c >= 90 * (x.n + y.n - p.c)),
r AS (SELECT doc_id AS i, doc_id AS j FROM documents UNION SELECT r.i, e.j FROM r JOIN e ON e.i = r.j)
SELECT d.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(r.j) AS component_id
FROM documents d JOIN r ON r.i = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""
}
