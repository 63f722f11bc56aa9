"""Language-model scoring by deleted interpolation.

A bigram model: the maximum-likelihood estimates of the word after its
context, of the word alone, and a uniform one are mixed.  The mixture weights
depend on how often the context was seen, in buckets of powers of two, and
are learned by expectation-maximisation on counts held out from those that
the estimates come from.

Counting never puts single n-grams through a shuffle.  A chunk of documents
counts its own n-grams and sends FAN_OUT packed, sorted slices of them, one
for each range of the hash space, however large the corpus is.  A task adds up
the slices of at most about FAN_IN chunks for one range; if there are more,
its sums are slices themselves, of FAN_OUT narrower ranges, and so on.  What
was asked is answered the same way back, with the counts of all others.
Chunks keep their token streams in the shared folder and are scored from
those.  What is gathered thus grows with the corpus, every chunk and task is
bounded, and a frequent word is one entry per chunk.

N-grams are told apart by hashes of 64 bits (words) and 56 bits (bigrams):
among a trillion distinct bigrams one in 70,000 shares its count with another.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, chunks, lean_memory, mix, packed, raw_texts, release, saved, tasks_for, unpacked, word_hashes, work_folder

CHUNK = 8 << 20
#: Slices that a chunk sends, and slices that a task adds up.
FAN_OUT = 128
FAN_IN = 512
FOLDS = 10
BUCKETS = 33
#: Steps per octave of the probabilities that expectation-maximisation sees.
STEPS = 4
SMOOTHING = 0.1
_END, _BEGIN = np.uint64(0x6A09E667F3BCC908), np.uint64(0xBB67AE8584CAA73B)
_HELD = "h"
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SCHEMA = "part string, kind int, shard long, payload binary, train_docs long, kept_docs long"
_ANSWER = "part string, kind int, shard long, payload binary, n long, v long, kept_n long, kept_v long"
_BITS = {1: 64, 2: 56}


def fold_of(doc_id: int | None) -> int:
    """crc32 of the id as text, modulo 10; a null id is learned from (fold -1)."""
    return -1 if doc_id is None else zlib.crc32(str(doc_id).encode()) % FOLDS


def _pairs(vocabulary: np.ndarray, stream: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """56-bit keys of the chunk's bigrams, sorted and distinct; each token's bigram; each token's context (-1: beginning)."""
    context = np.empty(len(stream), np.int64)
    context[1:] = stream[:-1]
    context[np.cumsum(lengths) - lengths] = -1
    local = (context + 1) * (len(vocabulary) + 1) + stream
    seen, of = np.unique(local, return_inverse=True)
    hashes = np.append(_BEGIN, vocabulary)
    left, right = hashes[seen // (len(vocabulary) + 1)], vocabulary[seen % (len(vocabulary) + 1)]
    keys = mix(left * np.uint64(0x9E3779B97F4A7C15) + right) >> np.uint64(8)
    keys, back = np.unique(keys, return_inverse=True)
    return keys, back[of], context


def _slices(keys: np.ndarray, counts: list[np.ndarray], kind: int, shard: int = 0, depth: int = 1) -> Iterator[tuple[int, bytes]]:
    """Sorted slices of a shard's keys, one for each of FAN_OUT ranges; at depth 1 the shard is the whole hash space."""
    first, width = shard * FAN_OUT, FAN_OUT**depth
    bounds = np.array([min(-(-((first + i) << _BITS[kind]) // width), (1 << 64) - 1) for i in range(1, FAN_OUT)], dtype=np.uint64)
    cuts = [0, *np.searchsorted(keys, bounds).tolist(), len(keys)]
    for s, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        if hi > lo:
            steps = np.diff(keys[lo:hi], prepend=np.uint64(0))
            yield first + s, packed(steps, *[c[lo:hi].astype("<u4") for c in counts])


def _counted(docs: DataFrame) -> DataFrame:
    """Kind 0: a chunk's stream; kinds 1 and 2: its words and bigrams in slices."""

    def part(name: str, ids: list[int | None], texts: list[list[bytes]], folds: np.ndarray, cache: WordHashes) -> pa.RecordBatch:
        lengths = np.array([len(t) + 1 for t in texts])
        hashes = np.full(lengths.sum(), _END)
        inside = np.ones(len(hashes), dtype=bool)
        inside[np.cumsum(lengths) - 1] = False
        hashes[inside] = word_hashes([w for t in texts for w in t], cache)
        vocabulary, stream = np.unique(hashes, return_inverse=True)
        learned = _learned(folds)
        data = packed(stream.astype("<u4"), lengths.astype("<u4"), folds.astype("<i4"), np.array([0 if i is None else i for i in ids], "<i8"), np.array([i is None for i in ids], "u1"))
        rows = [(name, 0, zlib.crc32(name.encode()), data, *(int(x.sum()) for x in learned))]
        pairs, of, _ = _pairs(vocabulary, stream, lengths)
        for kind, keys, index in ((1, vocabulary, stream), (2, pairs, of)):
            rows += [(name, kind, s, data, None, None) for s, data in _slices(keys, _tallies(index, lengths, learned, len(keys)), kind)]
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64()))], ["part", "kind", "shard", "payload", "train_docs", "kept_docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, at = WordHashes(), 0
        for batch in chunks(batches, most=CHUNK):
            ids = batch.column("doc_id").to_pylist()
            texts = [(t or b"").translate(_LOWER).split() for t in raw_texts(batch)]
            folds = np.array([fold_of(i) for i in ids])
            for held in (False, True):  # the fold that weights are learned on is a part of its own
                own = np.flatnonzero((folds == 1) == held)
                if len(own):
                    name = f"{TaskContext.get().partitionId()}-{at}{_HELD * held}"  # the same if the task runs again
                    yield part(name, [ids[i] for i in own], [texts[i] for i in own], folds[own], cache)
            at += 1

    return docs.mapInArrow(run, _SCHEMA)


def _learned(folds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which documents are learned from: all that count, and those that the estimates for the weights come from."""
    return folds != 0, (folds != 0) & (folds != 1)


def _tallies(index: np.ndarray, lengths: np.ndarray, learned: tuple[np.ndarray, np.ndarray], n: int) -> list[np.ndarray]:
    return [np.bincount(index[np.repeat(which, lengths)], minlength=n) for which in learned]


class _Sum:
    """The slices of one range added up."""

    def __init__(self, table: pa.Table):
        lean_memory()
        self.parts, self.kind, self.shard = table.column("part").to_pylist(), table.column("kind")[0].as_py(), table.column("shard")[0].as_py()
        self.slices = [unpacked(p, "<u8", "<u4", "<u4") for p in table.column("payload").to_pylist()]
        self.keys, self.of = np.unique(np.concatenate([np.cumsum(s[0], dtype=np.uint64) for s in self.slices]), return_inverse=True)
        self.counts = [np.bincount(self.of, weights=np.concatenate([s[i] for s in self.slices]), minlength=len(self.keys)).astype(np.int64) for i in (1, 2)]

    def answers(self, totals: list[np.ndarray], words: bool) -> list[bytes]:
        """For each slice, how often all others have its keys; words come back too: a part's words are its vocabulary."""
        ends = np.cumsum([len(s[0]) for s in self.slices])
        return [packed(*[s[0]] * words, *[(t[self.of[e - len(s[0]) : e]] - s[i]).astype("<u4") for i, t in enumerate(totals, 1)]) for s, e in zip(self.slices, ends.tolist())]

    def rows(self, answers: list[bytes], totals: list[int] | None) -> pa.Table:
        parts, n = [*self.parts, *[None] * (totals is not None)], len(self.parts)
        more = [pa.array([None] * n + [t], pa.int64()) for t in totals] if totals is not None else [pa.nulls(n, pa.int64())] * 4
        return pa.table([pa.array(parts, pa.string()), pa.array([self.kind] * len(parts), pa.int32()), pa.array([self.shard] * len(parts), pa.int64()), pa.array([*answers, *[None] * (totals is not None)], pa.binary()), *more],
                        names=["part", "kind", "shard", "payload", "n", "v", "kept_n", "kept_v"])


def _answered(slices: DataFrame, tasks: int, folder: str, depth: int = 1) -> DataFrame:
    """Answers to all slices, and a row of totals (``part`` null) of each narrowest range; streams pass through.

    ``tasks``: how many tasks the slices of one range are too many for.  Each
    level of the way up and back is written to ``folder``.
    """
    words = depth == 1
    if tasks == 1:

        def settle(table: pa.Table) -> pa.Table:
            if not table.column("kind")[0].as_py():
                none = pa.nulls(table.num_rows, pa.int64())
                return pa.table([*(table.column(c) for c in ("part", "kind", "shard", "payload", "train_docs")), none, table.column("kept_docs"), none], names=["part", "kind", "shard", "payload", "n", "v", "kept_n", "kept_v"])
            s = _Sum(table)
            train, kept = s.counts
            return s.rows(s.answers(s.counts, words and s.kind == 1), [int(train.sum()), int((train > 0).sum()), int(kept.sum()), int((kept > 0).sum())])

        ranges = 2 * FAN_OUT**depth
        return saved(slices.repartition(tasks_for(ranges), "kind", "shard").groupBy("kind", "shard").applyInArrow(settle, _ANSWER), f"{folder}/answers-{depth}", "kind")

    if words:
        slices = saved(slices, f"{folder}/counted", "kind")
    streams = slices.where("kind = 0")
    slices = slices.where("kind > 0").select("part", "kind", "shard", "payload")
    dealt = slices.withColumn("batch", F.pmod(F.xxhash64("part"), F.lit(tasks)))
    node = lambda kind, shard, at: f"{kind}/{shard}/{at}"

    def merge(table: pa.Table) -> pa.Table:
        s, at = _Sum(table), table.column("batch")[0].as_py()
        rows = [(node(s.kind, s.shard, at), s.kind, x, data) for x, data in _slices(s.keys, s.counts, s.kind, s.shard, depth + 1)]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.int64(), pa.binary()))], names=["part", "kind", "shard", "payload"])

    ranges = tasks_for(2 * FAN_OUT**depth * tasks)
    merged = saved(dealt.repartition(ranges, "kind", "shard", "batch").groupBy("kind", "shard", "batch").applyInArrow(merge, "part string, kind int, shard long, payload binary"), f"{folder}/merged-{depth}")
    merged = merged.withColumns({"train_docs": F.lit(None).cast("long"), "kept_docs": F.lit(None).cast("long")})
    above = _answered(merged, -(-tasks // FAN_IN), folder, depth + 1)

    def share(left: pa.Table, right: pa.Table) -> pa.Table:
        s = _Sum(left)
        others = [unpacked(p, "<u4", "<u4") for _, p in sorted(zip(right.column("place").to_pylist(), right.column("counts").to_pylist()))]
        totals = [own + np.concatenate([o[i] for o in others]).astype(np.int64) for i, own in enumerate(s.counts)]
        return s.rows(s.answers(totals, words and s.kind == 1), None)

    asked = dealt.withColumn("node", F.concat_ws("/", "kind", "shard", "batch"))
    told = above.where("part is not null").select(F.col("part").alias("asker"), F.col("shard").alias("place"), F.col("payload").alias("counts"))
    shared = asked.groupBy("node").cogroup(told.groupBy("asker")).applyInArrow(share, _ANSWER)
    every = shared.unionByName(above.where("part is null").select(shared.columns))
    if words:
        none = F.lit(None).cast("long")
        every = every.unionByName(streams.select("part", "kind", "shard", "payload", F.col("train_docs").alias("n"), none.alias("v"), F.col("kept_docs").alias("kept_n"), none.alias("kept_v")))
    return saved(every, f"{folder}/answers-{depth}", "kind")


class Chunk:
    """A chunk's stream with the corpus counts of its words and bigrams."""

    def __init__(self, stream: pa.Table, answers: pa.Table):
        lean_memory()
        self.stream, self.lengths, self.folds, self.ids, self.null = unpacked(stream.column("payload")[0].as_py(), "<u4", "<u4", "<i4", "<i8", "u1")
        self.stream, self.lengths = self.stream.astype(np.int64), self.lengths.astype(np.int64)
        # shards are ranges of hashes, so slices in order of their shards are in order of hashes
        slices = sorted(zip(answers.column("order").to_pylist(), answers.column("place").to_pylist(), answers.column("counts").to_pylist()))
        words = [unpacked(data, "<u8", "<u4", "<u4") for kind, _, data in slices if kind == 1]
        pairs = [unpacked(data, "<u4", "<u4") for kind, _, data in slices if kind == 2]
        vocabulary = np.concatenate([np.cumsum(w[0], dtype=np.uint64) for w in words])
        keys, self.pair, self.context = _pairs(vocabulary, self.stream, self.lengths)
        learned = _learned(self.folds)
        own = (_tallies(self.stream, self.lengths, learned, len(vocabulary)), _tallies(self.pair, self.lengths, learned, len(keys)))
        self.words, self.pairs = ([mine + np.concatenate(c) for mine, c in zip(o, theirs)] for o, theirs in zip(own, ([*zip(*words)][1:], [*zip(*pairs)])))

    def counts(self, kept: bool, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token: count of its bigram, of its context and of itself, in kept or all training text."""
        words, pairs = self.words[kept], self.pairs[kept]
        context = np.append(words, docs)[self.context]  # -1: the beginning, once for each document
        return pairs[self.pair], context, words[self.stream]


def bucket_of(context: np.ndarray) -> np.ndarray:
    """0 for unseen contexts, else 1 + the whole part of log2 of the count."""
    return np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))).astype(np.int64) + 1, 0)


def learn_weights(events: np.ndarray, uniform: float, rounds: int = 60) -> np.ndarray:
    """Weights of bigram, word and uniform estimate for each bucket.

    ``events``: rows of bucket, quantised log2 probability of the bigram and
    of the word (1: zero), number of tokens.
    """
    weights = np.tile(np.array([0.4, 0.5, 0.1]), (BUCKETS, 1))
    weights[0] = (0.0, 0.9, 0.1)
    if len(events):
        back = lambda q: np.where(q <= 0, 2.0 ** (q / STEPS), 0.0)
        b, n = events[:, 0].astype(np.int64), events[:, 3].astype(np.float64)
        p = np.stack([back(events[:, 1]), back(events[:, 2]), np.full(len(events), uniform)], axis=1)
        for _ in range(rounds):
            share = weights[b] * p
            share *= (n / share.sum(axis=1))[:, None]
            new = np.stack([np.bincount(b, share[:, i], BUCKETS) for i in range(3)], axis=1)
            some = new.sum(axis=1) > 0
            weights[some] = new[some] / new[some].sum(axis=1, keepdims=True)
        # the uniform estimate keeps a sliver, so that no text has probability zero
        weights = np.maximum(weights, np.array([0.0, 1e-6, 1e-6]))
        weights /= weights.sum(axis=1, keepdims=True)
    return weights


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``; one row per input row.

    Learns from documents whose fold is not 0 (``held_out``: fold 0); fold 1
    is what the weights are learned on.  Tokens are the words, A-Z lowered,
    and one end.  Null and empty texts are an end alone.  Rows with a null id
    are learned from.  Repeated rows count each.  With nothing to learn from,
    both scores rest on the uniform estimate.
    """
    spark = docs.sparkSession
    folder = work_folder(spark)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    total = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    answers = _answered(_counted(slim), max(1, -(-total // (FAN_IN * CHUNK))), folder)
    streams = answers.where("kind = 0").select("part", "payload", "n", "kept_n")
    train_docs, kept_docs, parts = (x or 0 for x in streams.agg(F.sum("n"), F.sum("kept_n"), F.count(F.lit(1))).first())
    release(spark)
    n, v, kept_n, kept_v = (x or 0 for x in answers.where("kind = 1 and part is null").agg(*[F.sum(c) for c in ("n", "v", "kept_n", "kept_v")]).first())
    # new names: the two sides of a cogroup must not share columns of one table
    slices = answers.where("kind > 0 and part is not null").select(F.col("part").alias("chunk"), F.col("kind").alias("order"), F.col("shard").alias("place"), F.col("payload").alias("counts"))
    is_held = lambda c: F.endswith(F.col(c), F.lit(_HELD))

    def joined(streams: DataFrame, slices: DataFrame, tasks: int):
        tasks = tasks_for(tasks)
        return streams.select("part", "payload").repartition(tasks, "part").groupBy("part").cogroup(slices.repartition(tasks, "chunk").groupBy("chunk"))

    both = joined(streams, slices, parts)
    held_parts = joined(streams.where(is_held("part")), slices.where(is_held("chunk")), parts // FOLDS)

    def events(stream: pa.Table, slices_: pa.Table) -> pa.Table:
        c = Chunk(stream, slices_)
        held = np.repeat(c.folds == 1, c.lengths)
        pair, context, word = (x[held] for x in c.counts(True, kept_docs))
        q = lambda a, b: np.where(a > 0, np.round(STEPS * np.log2(np.maximum(a, 1) / np.maximum(b, 1))), 1).astype(np.int64)
        rows, many = np.unique(np.stack([bucket_of(context), q(pair, context), q(word, kept_n)], axis=1), axis=0, return_counts=True) if held.any() else (np.empty((0, 3), np.int64), np.empty(0, np.int64))
        return pa.table([*[pa.array(rows[:, i]) for i in range(3)], pa.array(many)], names=["bucket", "q2", "q1", "n"])

    # quantised, so at most BUCKETS x 160 x 160 rows whatever the corpus
    seen = held_parts.applyInArrow(events, "bucket long, q2 long, q1 long, n long").groupBy("bucket", "q2", "q1").agg(F.sum("n").alias("n")).toPandas()
    weights = learn_weights(seen[["bucket", "q2", "q1", "n"]].sort_values(["bucket", "q2", "q1"]).to_numpy(), 1 / (kept_v + 1))

    release(spark)

    def scored(stream: pa.Table, slices_: pa.Table) -> pa.Table:
        c = Chunk(stream, slices_)
        pair, context, word = c.counts(False, train_docs)
        w = weights[bucket_of(context)]
        p = w[:, 0] * pair / np.maximum(context, 1) + w[:, 1] * word / max(n, 1) + w[:, 2] / (v + 1)
        base = np.log10((word + SMOOTHING) / (n + SMOOTHING * (v + 1)))
        starts = np.cumsum(c.lengths) - c.lengths
        add = lambda x: np.add.reduceat(x, starts)
        return pa.table([
            pa.array(c.ids, mask=c.null.astype(bool)), pa.array(c.folds == 0), pa.array(c.lengths), pa.array(add((word > 0).astype(np.int64))),
            pa.array(np.full(len(c.ids), n, np.int64)), pa.array(add(base)), pa.array(add(np.log10(p))),
        ], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return both.applyInArrow(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
