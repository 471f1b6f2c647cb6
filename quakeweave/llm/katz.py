"""Katz backoff language model of words, trained and evaluated in Spark.

Tokens are a text's words, A-Z in lower case, and one end.  Counts of n-grams are
discounted by Good-Turing up to ``K``, and what is taken off is left to shorter
histories with backoff weights that make every distribution sum to one exactly:

    P(w | h) = d(c) c(h w) / c(h)              if h w was seen
             = a(h) P(w | h less its first)    otherwise

and P(w) = d(c) c(w) / N for a word seen, the whole remaining mass for one word that
stands for all others.  The counts of counts are smoothed as in simple Good-Turing, by a
power law through the numbers of n-grams seen 1 .. ``FIT`` times, whose exponent is held
at ``FLATTEST`` or steeper; from such counts every Katz factor lies between 0 and 1.  A
history none of whose counts is discounted counts one more event, so that unseen words
never get probability 0.

The texts are written once as batches of tokens: a batch's distinct words, and its tokens
as numbers of them.  A batch asks for the statistics of its distinct words, and of its
distinct pairs, which travel as sorted arrays of 64-bit hashes, one for each bucket of
hashes.  A bucket holds about ``BUCKET`` tokens' pairs; it adds up the counts that come
with them, stores them and answers every batch with an array.  So a pair common to many
documents crosses the shuffle once a batch, no document or history is gathered whole, and
each token is evaluated by the recursion where its text is.  (Where a batch has fewer
tokens than there are buckets, an array holds a pair or two, as a row for each would.)
Pairs are equal if their hashes are.  Of the batches with a pair one owns it and takes it
into its history's sums.

The model is three tables partitioned by bucket: ``words`` and ``pairs`` (sorted hashes and
counts) and ``histories`` (sorted hashes, totals and backoff weights).  Arrays are stored and
sent in their narrowest type, hashes as differences, compressed.

Null and empty texts are the end alone.  Rows equal in doc_id and text are scored once
for each and count once each in training; null doc_ids are kept.  An empty training set
gives every word the one remaining mass, 1 (score 0).  An empty table gives no rows.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeweave.llm._common import keyed, table, unkeyed, written
from quakeweave.llm.hashing import M3, WordHasher, flat_words, mix, small

K, FIT, FLATTEST = 5, 10, -1.1
FOLDS, HELD = 7, 2
#: Tokens whose pairs a bucket holds, about.
BUCKET = 2_000_000
#: Hash keys of the text's edges.
START, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def _packed(x: np.ndarray, kept=np.int64) -> bytes:
    """Numbers as bytes: their width (and 16 if compressed), then integers in the narrowest type that holds them, byte by place, or floats."""
    x = np.ascontiguousarray(x, kept)
    width = 8
    if kept is np.int64:
        if x.min(initial=0) >= 0:
            width = next(w for w in (1, 2, 4, 8) if int(x.max(initial=0)) < 1 << 8 * w)
            x = x.astype(f"<u{width}")
        x = np.ascontiguousarray(x.view(np.uint8).reshape(-1, width).T)
    raw = x.tobytes()
    less = len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)
    return bytes([16 + width]) + less if len(less) < len(raw) else bytes([width]) + raw


def _unpacked(b: bytes, kept=np.int64) -> np.ndarray:
    width = b[0] & 15
    raw = pa.decompress(b[9:], int.from_bytes(b[1:9], "little"), codec="zstd", asbytes=True) if b[0] & 16 else b[1:]
    if kept is np.float64:
        return np.frombuffer(raw, kept)
    x = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).ravel()
    return x.view(kept) if width == 8 else x.view(f"<u{width}").astype(kept)


def _packed_keys(keys: np.ndarray) -> bytes:
    """Ascending hashes, as what each is above the one before."""
    return _packed(np.diff(keys, prepend=np.uint64(0)).view(np.int64))


def _unpacked_keys(b: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(b).view(np.uint64), dtype=np.uint64)


class Batch(NamedTuple):
    """Texts as tokens: each one's ids, whether it is held out and its tokens; the distinct words' hashes (the start's first); every token's word."""

    did: np.ndarray
    uid: np.ndarray
    held: np.ndarray
    counts: np.ndarray
    vocab: np.ndarray
    word: np.ndarray

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.counts) - self.counts

    @property
    def history(self) -> np.ndarray:
        h = np.zeros_like(self.word)
        h[1:] = self.word[:-1]
        h[self.starts] = 0
        return h

    @property
    def learnt(self) -> np.ndarray:
        """For each token, whether it is learnt from."""
        return np.repeat(self.held == 0, self.counts)

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct words' hashes, ascending, and where each stands among the words."""
        order = np.argsort(self.vocab.view(np.uint64))
        return self.vocab.view(np.uint64)[order], order

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct pairs' hashes, ascending, a token of each, and every token's pair."""
        spread = self.vocab.view(np.uint64)
        return np.unique(mix(spread[self.history] * M3 + mix(spread[self.word])), return_index=True, return_inverse=True)


def _batch_of(blobs: list[bytes]) -> Batch:
    return Batch(*map(_unpacked, blobs))


def _tokenised(docs: DataFrame) -> DataFrame:
    """(did, uid, text, held) -> (bid, n, blobs): batches of tokens, written."""

    def run(batches):
        hasher, bid = WordHasher(), TaskContext.get().partitionId() << 32
        for batch in small(batches, rows=1 << 16):
            words, counts = flat_words(batch.column("text").to_pylist(), hasher)
            counts = counts + 1
            all_words = np.empty(int(counts.sum()) + 1, np.uint64)
            inner = np.ones(len(all_words), bool)
            inner[np.cumsum(counts)] = inner[0] = False
            all_words[inner], all_words[~inner], all_words[0] = words, END, START
            of, vocab = pd.factorize(all_words.view(np.int64))
            ids = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("did", "uid", "held")]
            blobs = [_packed(x) for x in (*ids, counts, vocab, of[1:])]
            yield pa.record_batch([pa.array([bid], pa.int64()), pa.array([len(of) - 1], pa.int64()), pa.array([blobs], pa.list_(pa.binary()))], ["bid", "n", "blobs"])
            bid += 1

    return written(docs.mapInArrow(run, "bid long, n long, blobs array<binary>"), "tokens")


def _by_bucket(keys: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, first, end) of ascending hashes."""
    at = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    return list(zip(at[first].tolist(), first.tolist(), [*first[1:].tolist(), len(at)], strict=True))


def _asked(tokens: DataFrame, buckets: int, pairs: bool) -> DataFrame:
    """(bucket, bid, keys, n): every batch's distinct pairs, or words, by bucket, ascending, and how often it has them in texts learnt from."""

    def run(batches):
        for batch in batches:
            for bid, blobs in zip(batch.column("bid").to_pylist(), batch.column("blobs").to_pylist(), strict=True):
                b = _batch_of(blobs)
                if pairs:
                    keys, _, of = b.pairs()
                    n = np.bincount(of[b.learnt], minlength=len(keys))
                else:
                    keys, order = b.words()
                    n = np.bincount(b.word[b.learnt], minlength=len(keys))[order]
                cuts = _by_bucket(keys, buckets)
                for lo in range(0, len(cuts), 256):
                    some = cuts[lo : lo + 256]
                    cols = [[k for k, _, _ in some], [bid] * len(some), [_packed_keys(keys[i:j]) for _, i, j in some], [_packed(n[i:j]) for _, i, j in some]]
                    yield pa.record_batch([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["bucket", "bid", "keys", "n"])

    return tokens.select("bid", "blobs").mapInArrow(run, "bucket long, bid long, keys binary, n binary")


def _keys(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A bucket's distinct keys, ascending, each row's keys' places among them, and where rows end."""
    rows = [_unpacked_keys(b) for b in blobs]
    distinct, of = np.unique(np.concatenate(rows), return_inverse=True)
    return distinct, of, np.cumsum([len(x) for x in rows])


ANSWERS = "bid long, bucket long, answer binary, keys binary, counts binary, total long, distinct long, hist array<long>"


def _met(asked: pa.Table) -> pa.Table:
    """A bucket's keys added up: an answer to each batch (2 * count, and 1 if the batch owns the key), and a row of the model."""
    blobs = asked.column("keys").to_pylist()
    distinct, of, ends = _keys(blobs)
    n = np.concatenate([_unpacked(b) for b in asked.column("n").to_pylist()])
    c = np.bincount(of, weights=n, minlength=len(distinct)).astype(np.int64)
    owner = np.full(len(distinct), -1)
    learnt = np.flatnonzero(n)
    owner[of[learnt]] = learnt
    answer = 2 * c[of]
    answer[owner[owner >= 0]] += 1
    seen = c > 0
    m = len(blobs)
    model = {
        "keys": (_packed_keys(distinct[seen]), pa.binary()),
        "counts": (_packed(c[seen]), pa.binary()),
        "total": (int(c.sum()), pa.int64()),
        "distinct": (int(seen.sum()), pa.int64()),
        "hist": (np.bincount(np.minimum(c, FIT + 1), minlength=FIT + 2)[1 : FIT + 1].tolist(), pa.list_(pa.int64())),
    }
    cols = {
        "bid": pa.array([*asked.column("bid").to_pylist(), None], pa.int64()),
        "bucket": pa.array([asked.column("bucket")[0].as_py()] * (m + 1), pa.int64()),
        "answer": pa.array([*(_packed(x) for x in np.split(answer, ends[:-1])), None], pa.binary()),
    }
    return pa.table(cols | {name: pa.array([None] * m + [x], t) for name, (x, t) in model.items()})


def discounts(of: dict[int, int], k: int = K) -> dict[int, float]:
    """Katz's factor for each count up to k, from the numbers of n-grams seen 1 .. FIT times, smoothed by a power law."""
    seen = [(math.log(r), math.log(n)) for r, n in of.items() if 1 <= r <= FIT and n > 0]
    slope = float(np.polyfit(*zip(*seen, strict=True), 1)[0]) if len(seen) > 1 else -2.0
    slope = min(slope, FLATTEST)
    smooth = lambda r: r**slope  # noqa: E731  n of r, but for a factor that cancels out
    last = (k + 1) * smooth(k + 1) / smooth(1)
    return {r: ((r + 1) * smooth(r + 1) / (r * smooth(r)) - last) / (1 - last) for r in range(1, k + 1)}


def _taken(c: np.ndarray, d: dict[int, float]) -> np.ndarray:
    """Discounted counts."""
    return c * np.array([1.0, *(d[r] for r in sorted(d)), 1.0])[np.minimum(c, len(d) + 1)]


class Rates(NamedTuple):
    """A model's numbers: N, V, the mass of words not seen, the events it is a share of, and the factors of words and pairs."""

    total: int
    distinct: int
    unseen: float
    events: int
    of_words: dict[int, float]
    of_pairs: dict[int, float]

    def log_p(self, c: np.ndarray) -> np.ndarray:
        """log10 P of words from their counts."""
        return np.log10(np.where(c > 0, _taken(c, self.of_words) / max(self.events, 1), self.unseen))


class Katz(NamedTuple):
    """A trained model: words and pairs (bucket, keys, counts), histories (bucket, keys, total, log_a) and its numbers; arrays as _unpacked reads them, keys as _unpacked_keys."""

    words: DataFrame
    pairs: DataFrame
    histories: DataFrame
    rates: Rates


def _answered(tokens: DataFrame, *answers: DataFrame) -> DataFrame:
    """Each batch's tokens (kind 0) and the answers (bid, bucket, blobs) to it, by kind from 1, as rows of one group bid."""
    rows = tokens.select("bid", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("bucket"), "blobs")
    for k, x in enumerate(answers, 1):
        rows = rows.union(x.filter("bid is not null").select("bid", F.lit(k), "bucket", "blobs"))
    return rows.groupBy("bid")


def _opened(group: pa.Table) -> tuple[Batch, list[list[list[bytes]]]]:
    """A group of _answered: its tokens, and by kind the answers in the order of their buckets."""
    rows = sorted(zip(group.column("kind").to_pylist(), group.column("bucket").to_pylist(), group.column("blobs").to_pylist(), strict=True))
    by = [[blobs for kind, _, blobs in rows if kind == k] for k in range(4)]
    return _batch_of(by[0][0]), by


def _joined(answers: list[list[bytes]], at: int = 0, kept=np.int64) -> np.ndarray:
    return np.concatenate([_unpacked(blobs[at], kept) for blobs in answers])


def _counts_of_words(batch: Batch, answers: list[list[bytes]]) -> np.ndarray:
    c = np.empty(len(batch.vocab), np.int64)
    c[batch.words()[1]] = _joined(answers) >> 1
    return c


#: What _history_sums adds up by history.
SUMS = {"ch": np.int64, "seen": np.float64, "low": np.float64, "few": np.int64, "backed": np.int64}


def _history_sums(rates: Rates, buckets: int):
    """(bucket, bid, keys, ch, seen, low, few, backed): by word, sums over the pairs that follow it and that the batch owns, of counts, discounted counts, next words' probabilities and discounted pairs, and how often the batch's texts back off from it."""

    def run(group: pa.Table) -> pa.Table:
        batch, by = _opened(group)
        c, answers = _counts_of_words(batch, by[1]), _joined(by[2])
        _, token, of = batch.pairs()
        own = np.flatnonzero(answers & 1)
        h, w, n = batch.history[token[own]], batch.word[token[own]], answers[own] >> 1
        keys, order = batch.words()
        total = lambda x: np.bincount(h, weights=x, minlength=len(keys))[order]
        sums = {"ch": total(n), "seen": total(_taken(n, rates.of_pairs)), "low": total(10.0 ** rates.log_p(c)[w]), "few": total(n <= len(rates.of_pairs))}
        sums["backed"] = np.bincount(batch.history[answers[of] < 2], minlength=len(keys))[order]
        cuts = _by_bucket(keys, buckets)
        cols = {"bucket": pa.array([k for k, _, _ in cuts], pa.int64()), "bid": pa.array([group.column("bid")[0].as_py()] * len(cuts), pa.int64())}
        cols["keys"] = pa.array([_packed_keys(keys[i:j]) for _, i, j in cuts], pa.binary())
        return pa.table(cols | {name: pa.array([_packed(x[i:j], SUMS[name]) for _, i, j in cuts], pa.binary()) for name, x in sums.items()})

    return run


def _weighed(asked: pa.Table) -> pa.Table:
    """A bucket's histories added up: their totals and log10 of their backoff weights (0 where a batch backs off from none), for each batch that has them, and a row of the model."""
    blobs = asked.column("keys").to_pylist()
    distinct, of, ends = _keys(blobs)

    def rows(name: str) -> np.ndarray:
        return np.concatenate([_unpacked(b, SUMS[name]) for b in asked.column(name).to_pylist()])

    def total(name: str) -> np.ndarray:
        return np.bincount(of, weights=rows(name), minlength=len(distinct))

    ch, seen, low, few = map(total, ("ch", "seen", "low", "few"))
    known = ch > 0
    events = np.where(known, ch + (few == 0), 1.0)
    log_a = np.log10(np.where(known, (1 - seen / events) / (1 - np.where(known, low, 0)), 1.0))
    backed = rows("backed") > 0
    totals = [_packed(x) for x in np.split(events[of], ends[:-1])]
    weights = [_packed(x, np.float64) for x in np.split(np.where(backed, log_a[of], 0.0), ends[:-1])]
    answers = [[a, b] for a, b in zip(totals, weights, strict=True)] + [[_packed(events[known]), _packed(log_a[known], np.float64)]]
    m = len(blobs)
    return pa.table(
        {
            "bid": pa.array([*asked.column("bid").to_pylist(), None], pa.int64()),
            "bucket": pa.array([asked.column("bucket")[0].as_py()] * (m + 1), pa.int64()),
            "keys": pa.array([None] * m + [_packed_keys(distinct[known])], pa.binary()),
            "blobs": pa.array(answers, pa.list_(pa.binary())),
        }
    )


def _text_scores(rates: Rates):
    """did, uid, held_out, n_tokens, n_known, base_score, score of a batch's texts."""

    def run(group: pa.Table) -> pa.Table:
        batch, by = _opened(group)
        c = _counts_of_words(batch, by[1])
        order = batch.words()[1]
        log_total, log_a = np.empty(len(c)), np.empty(len(c))
        log_total[order], log_a[order] = np.log10(_joined(by[3])), _joined(by[3], 1, np.float64)
        _, _, of = batch.pairs()
        h, w, n = batch.history, batch.word, (_joined(by[2]) >> 1)[of]
        seen = np.log10(np.where(n > 0, _taken(n, rates.of_pairs), 1.0)) - log_total[h]
        each = np.where(n > 0, seen, log_a[h] + rates.log_p(c)[w])
        base = np.log10((c + 1) / (rates.total + rates.distinct + 1))[w]
        by_text = lambda x: np.add.reduceat(x, batch.starts)
        known = by_text((c > 0)[w].astype(np.int64))
        cols = {"did": batch.did, "uid": batch.uid, "held_out": batch.held == 1, "n_tokens": batch.counts, "n_known": known, "base_score": by_text(base), "score": by_text(each)}
        return pa.table(cols)

    return run


def _hist(answers: DataFrame) -> dict[int, int]:
    """The numbers of keys seen 1 .. FIT times."""
    return {r["c"] + 1: r["n"] for r in answers.select(F.posexplode("hist").alias("c", "n")).groupBy("c").agg(F.sum("n").alias("n")).collect()}  # FIT rows


def fitted(tokens: DataFrame, k: int = K, bucket: int = BUCKET) -> tuple[Katz, list[DataFrame]]:
    """The model learnt from batches of tokens (k up to FIT), and the answers to all of them: words' counts, pairs' counts, histories' weights."""
    if not 1 <= k <= FIT:
        raise ValueError(f"k must be 1 to {FIT}")
    buckets = 1 + (tokens.agg(F.sum("n")).first()[0] or 0) // bucket
    words, pairs = (written(_asked(tokens, buckets, x).groupBy("bucket").applyInArrow(_met, ANSWERS), "pairs" if x else "words") for x in (False, True))
    total, distinct = words.agg(F.sum("total"), F.sum("distinct")).first()
    total, of = total or 0, _hist(words)
    d1, d2 = discounts(of, k), discounts(_hist(pairs), k)
    mass = total - sum((1 - d1[c]) * c * of.get(c, 0) for c in d1)
    events = total if mass < total else total + 1
    rates = Rates(total, distinct or 0, 1 - mass / events if total else 1.0, events, d1, d2)
    counted = [x.select("bid", "bucket", F.array("answer").alias("blobs")) for x in (words, pairs)]
    sums = _answered(tokens, *counted).applyInArrow(_history_sums(rates, buckets), "bucket long, bid long, keys binary, ch binary, seen binary, low binary, few binary, backed binary")
    weights = written(sums.groupBy("bucket").applyInArrow(_weighed, "bid long, bucket long, keys binary, blobs array<binary>"), "histories")
    model = [x.filter("bid is null").select("bucket", "keys", "counts") for x in (words, pairs)]
    histories = weights.filter("bid is null").select("bucket", "keys", F.col("blobs")[0].alias("total"), F.col("blobs")[1].alias("log_a"))
    return Katz(*model, histories, rates), [*counted, weights]


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD


def scored(docs: DataFrame, held: Column | None = None, k: int = K, bucket: int = BUCKET) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; learnt from what is not held out."""
    marked = docs.withColumn("_held", F.coalesce(held_out() if held is None else held, F.lit(False)))
    tokens = _tokenised(keyed(marked, "_held").withColumn("held", F.col("_held").cast("long")).drop("_held"))
    model, answers = fitted(tokens, k, bucket)
    out = _answered(tokens, *answers).applyInArrow(_text_scores(model.rates), "did long, uid long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(unkeyed(), "held_out", "n_tokens", "n_known", F.lit(model.rates.total).cast("long").alias("train_tokens"), "base_score", "score")


def op4_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))


QUERIES = {"op4_katz": op4_katz}
SQL: dict[str, str] = {}
