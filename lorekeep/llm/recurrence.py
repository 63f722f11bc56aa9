"""Where windows of fixed length recur across a corpus, exactly and without a sort of all windows.

A window of ``length`` units (words or bytes) picks its leftmost least-hashed
gram of ``gram`` units as anchor.  The pick depends on the window's content
alone, so equal windows have equal anchors at equal offsets.  Consecutive
windows that share an anchor form a run; there are about two for every
``length - gram`` units.

1. The corpus is packed into chunks of text, and each chunk names the hashes
   of its anchors, one row each.  They are counted; an anchor seen once
   settles its run: nothing in it recurs.  Hashes only ever rule out here.
2. Chunks deal out the text of the runs whose anchors recur, each distinct
   run once, to where their anchor is settled.
3. There the operator's own method compares the texts themselves.

An anchor whose runs are of very many kinds (a passage that a large part of
the corpus shares, in ever other surroundings) is dealt by window instead:
window hashes are counted as anchors were, and only windows that recur are
dealt, each to its own place.  So no task gets a share of the input that one
key decides, and every row is dealt by its own key: nothing depends on how
many tasks there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHashes, chunks, forget, lean_memory, mix, prefix_hashes, raw_texts, release, saved, sliding_hashes, sliding_leftmost_min, span_hashes, tasks_for, word_hashes, worker_hashes

#: Kinds of runs of one anchor, summed over chunks, beyond which they are dealt by window: as many as a task settles in some 200 MB.
CROWD = 20_000
#: Occurrences of one piece that a chunk sends along; further ones share the verdict, as they are the same text.
LOCAL = 16
#: Units hashed at once, so that their arrays stay in the processor's cache.
PIECE = 1 << 16
#: Distinct pieces settled at once, and rows of pieces for each task.
PIECES = 4000
TASK_ROWS = 20_000
_CHUNK, _KEYS = 0, 1
_ANCHOR, _CROWDED, _WINDOW = 0, 1, 2
_PLACE = np.dtype([("id", "<i8"), ("d", "<u4"), ("a", "<u4")])
_RANGE = np.dtype([("d", "<u4"), ("a", "<u4"), ("b", "<u4")])


@dataclass(frozen=True)
class Units:
    """What windows are made of."""

    words: bool
    length: int
    gram: int
    later: bool  # only windows that also start earlier
    chunk: int = 8 << 20

    def values(self, text: bytes, cache: WordHashes) -> np.ndarray:
        if self.words:
            return word_hashes(text.split(), cache)
        return _BYTES[np.frombuffer(text, np.uint8)]


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def runs_of(values: list[np.ndarray], units: Units) -> tuple[np.ndarray, ...]:
    """Anchor hash, run hash, document, first and last window start of each run of a chunk.

    Documents longer than a piece are taken in pieces that overlap by a
    window; a run that a cut divides is merely compared more finely.
    """
    size, piece = units.length, PIECE
    parts = [(d, at, v[at : at + piece + size - 1]) for d, v in enumerate(values) for at in range(0, max(len(v) - size + 1, 0), piece)]
    out = []
    while parts:
        n, take = 0, 0
        while take < len(parts) and (not take or n + len(parts[take][2]) <= piece + size):
            n += len(parts[take][2])
            take += 1
        now, parts = parts[:take], parts[take:]
        flat = np.concatenate([v for _, _, v in now])
        lengths = np.array([len(v) for _, _, v in now])
        begins = np.cumsum(lengths) - lengths
        prefix = prefix_hashes(flat)
        grams = sliding_hashes(prefix, units.gram)
        pick = sliding_leftmost_min(grams, size - units.gram + 1)
        owner = np.repeat(np.arange(len(now)), lengths)
        starts = np.flatnonzero(np.arange(len(pick)) + size <= (begins + lengths)[owner[: len(pick)]])
        anchor, own = pick[starts], owner[starts]
        first = np.ones(len(starts), dtype=bool)
        first[1:] = (anchor[1:] != anchor[:-1]) | (own[1:] != own[:-1])
        at = np.flatnonzero(first)
        last = np.append(at[1:], len(starts)) - 1
        a, b, p, o = starts[at], starts[last], anchor[at], own[at]
        h = grams[p]
        r = mix(span_hashes(prefix, a, b + size) ^ ((p - a).astype(np.uint64) << np.uint64(20)) ^ (b - a).astype(np.uint64))
        shift = np.array([x for _, x, _ in now])[o] - begins[o]
        # an anchor's hash is the least of many; mixed again, hashes spread evenly over shards
        out.append((mix(h + np.uint64(1)), r, np.array([d for d, _, _ in now])[o], a + shift, b + shift))
    if not out:
        empty = np.empty(0, np.int64)
        return empty.astype(np.uint64), empty.astype(np.uint64), empty, empty, empty
    return tuple(np.concatenate(x) for x in zip(*out))


def joined_ranges(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ranges of window starts, with neighbours in one document joined."""
    if not len(doc):
        return doc, a, b
    order = np.lexsort((a, doc))
    doc, a, b = doc[order], a[order], b[order]
    far = np.maximum.accumulate(b + doc.astype(np.int64) * (1 << 40))  # documents never meet
    new = np.ones(len(doc), dtype=bool)
    new[1:] = a[1:] + doc[1:].astype(np.int64) * (1 << 40) > far[:-1] + 1
    at = np.flatnonzero(new)
    ends = np.append(at[1:], len(doc)) - 1
    return doc[at], a[at], far[ends] - doc[at].astype(np.int64) * (1 << 40)


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of runs of equal keys in sorted arrays, and each row's run."""
    new = np.ones(len(keys[0]), dtype=bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new), np.cumsum(new) - 1


class Chunk:
    """Whole texts packed in one row: ``head`` has ids, nulls and lengths, ``body`` the texts."""

    SCHEMA = "head binary, body binary"

    def __init__(self, ids: np.ndarray, null: np.ndarray, texts: list[bytes]):
        self.ids, self.null, self.texts = ids, null, texts

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> Chunk:
        ids = batch.column("doc_id")
        return cls(ids.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False), [t or b"" for t in raw_texts(batch)])

    def packed(self) -> tuple[bytes, bytes]:
        head = np.stack([self.ids.astype("<i8"), self.null.astype("<i8"), np.array(list(map(len, self.texts)), "<i8")]).tobytes()
        return head, zstandard.ZstdCompressor(level=1).compress(b"".join(self.texts))

    @classmethod
    def unpacked(cls, table: pa.Table) -> Chunk:
        lean_memory()
        ids, null, sizes = np.frombuffer(table.column("head")[0].as_py(), "<i8").reshape(3, -1)
        total = int(sizes.sum())
        whole = zstandard.ZstdDecompressor().decompress(table.column("body")[0].as_py(), max_output_size=max(1, total)) if total else b""
        ends = np.cumsum(sizes).tolist()
        return cls(ids, null.astype(bool), [whole[e - n : e] for e, n in zip(ends, sizes.tolist())])

    def id_column(self) -> pa.Array:
        return pa.array(self.ids, mask=self.null)


def _recurring_keys(rows: DataFrame) -> DataFrame:
    """``cid, key, crowded`` of the keys that more than one occurrence has, from ``key, cid, n, kinds``, one row for each chunk and key."""
    every = Window.partitionBy("key")
    return rows.withColumns({"t": F.sum("n").over(every), "m": F.sum("kinds").over(every)}).where("t > 1").select("cid", "key", (F.col("m") > CROWD).alias("crowded"))


def _windows(values: dict[int, np.ndarray], d: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document and start of each window of the runs."""
    hs, ds, ss = ([np.empty(0, t)] for t in (np.uint64, np.int64, np.int64))
    for doc in np.unique(d).tolist():
        own = d == doc
        _, x, y = joined_ranges(np.zeros(int(own.sum()), np.int64), a[own], b[own])
        s = np.concatenate([np.arange(i, j + 1) for i, j in zip(x.tolist(), y.tolist())])
        hs.append(span_hashes(prefix_hashes(values[doc]), s, s + length))
        ds.append(np.full(len(s), doc))
        ss.append(s)
    return np.concatenate(hs), np.concatenate(ds), np.concatenate(ss)


def _keys(kind: pa.Table) -> dict[int, np.ndarray]:
    how, key = kind.column("how").to_numpy(), kind.column("key").to_numpy().view(np.uint64)
    return {k: key[how == k] for k in (_ANCHOR, _CROWDED, _WINDOW)}


Settle = Callable[[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def _settled(settle: Settle):
    """Pieces in order of their keys to the ranges of window starts that ``settle`` marks, and those marked before."""

    def flush(rows: list[tuple[int, int, bytes, bytes]]) -> pa.RecordBatch:
        lean_memory()
        index: dict[tuple[int, bytes], int] = {}
        piece = [index.setdefault((key, text), len(index)) for key, _, text, _ in rows]
        places = [np.frombuffer(p, _PLACE) for _, _, _, p in rows]
        many = list(map(len, places))
        at = np.concatenate(places)
        of, cid = np.repeat(piece, many), np.repeat(np.array([c for _, c, _, _ in rows], np.int64), many)
        _, group = np.unique(np.array([k for k, _ in index], np.int64), return_inverse=True)
        which, x, y = settle([t for _, t in index], group, of, at["id"].astype(np.int64), at["a"].astype(np.int64))
        order = np.argsort(cid[which], kind="stable")
        which, x, y = which[order], x[order], y[order]
        out = np.empty(len(which), _RANGE)
        out["d"], out["a"], out["b"] = at["d"][which], at["a"][which] + x, at["a"][which] + y
        names, starts = np.unique(cid[which], return_index=True)
        return pa.RecordBatch.from_arrays([pa.array(names), pa.array([out[i:j].tobytes() for i, j in zip(starts, [*starts[1:], len(out)])], pa.binary())], ["cid", "ranges"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes, bytes]] = []
        for batch in batches:
            marked = batch.filter(batch.column("ranges").is_valid())
            if marked.num_rows:
                yield pa.RecordBatch.from_arrays([marked.column("cid"), marked.column("ranges")], ["cid", "ranges"])
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "cid", "piece", "places"))):
                if len(held) >= PIECES and row[0] != held[-1][0]:
                    yield flush(held)
                    held = []
                held.append(row)
        if held:
            yield flush(held)

    return run


def recurring(docs: DataFrame, units: Units, folder: str, settle: Settle) -> tuple[DataFrame, DataFrame]:
    """``cid, head, body``, the corpus in chunks, and ``cid, ranges``, the window starts in each that recur.

    ``docs``: ``doc_id, text``.  ``settle(pieces, group, of, ids, starts)``
    gets distinct texts of runs, joined by single spaces if they are of words,
    the number of each one's anchor, and of each occurrence its piece, its
    doc_id (null: the least) and the start of its first window; all pieces of
    an anchor come together.  It returns occurrences and the first and last of
    their windows to mark, counted from the piece's start.  Everything between
    stages is written to ``folder``.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cid = TaskContext.get().partitionId() << 32  # the same if the task runs again
        names = ["kind", "cid", "head", "body", "key", "n", "kinds"]
        for batch in chunks(batches, most=units.chunk):
            chunk = Chunk.of(batch)
            none = lambda t: pa.nulls(1, t)
            yield pa.RecordBatch.from_arrays([pa.array([_CHUNK], pa.int32()), pa.array([cid]), *[pa.array([x], pa.binary()) for x in chunk.packed()], none(pa.int64()), none(pa.int32()), none(pa.int32())], names)
            h, r, *_ = runs_of([units.values(t, worker_hashes()) for t in chunk.texts], units)
            order = np.lexsort((r, h))
            h, r = h[order], r[order]
            heads, by = _groups(h)
            if len(heads):
                kinds = np.bincount(by[_groups(h, r)[0]], minlength=len(heads))
                n = len(heads)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n, _KEYS, np.int32)), pa.array(np.full(n, cid)), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()),
                    pa.array(h[heads].view(np.int64)), pa.array(np.minimum(np.bincount(by), 2).astype(np.int32)), pa.array(kinds.astype(np.int32)),
                ], names)
            cid += 1

    first = saved(docs.mapInArrow(scan, f"kind int, cid long, {Chunk.SCHEMA}, key long, n int, kinds int"), f"{folder}/chunks", "kind")
    corpus = first.where(F.col("kind") == _CHUNK).select("cid", "head", "body")
    n_chunks = tasks_for(corpus.count())
    found = saved(_recurring_keys(first.where(F.col("kind") == _KEYS)), f"{folder}/anchors")
    forget(docs.sparkSession, f"{folder}/chunks/kind={_KEYS}")
    known = found.select(F.col("cid").alias("in"), "key", F.when(F.col("crowded"), _CROWDED).otherwise(_ANCHOR).alias("how"))

    def by_window(left: pa.Table, right: pa.Table) -> pa.Table:
        cid, crowd = left.column("cid")[0].as_py() if left.num_rows else 0, right.column("key").to_numpy().view(np.uint64)
        hashes = np.empty(0, np.uint64)
        if left.num_rows and len(crowd):
            chunk = Chunk.unpacked(left)
            values = [units.values(t, worker_hashes()) for t in chunk.texts]
            h, _, d, a, b = runs_of(values, units)
            own = np.isin(h, crowd)
            hashes, _, _ = _windows(values, d[own], a[own], b[own], units.length)
        hashes, n = np.unique(hashes, return_counts=True)
        return pa.table([pa.array(np.full(len(hashes), cid)), pa.array(hashes.view(np.int64)), pa.array(np.minimum(n, 2).astype(np.int32))], names=["cid", "key", "n"])

    crowded = known.where(F.col("how") == _CROWDED)
    if not crowded.isEmpty():
        having = corpus.join(crowded.select("in").distinct(), F.col("cid") == F.col("in"), "left_semi")
        rows = having.repartition(n_chunks, "cid").groupBy("cid").cogroup(crowded.repartition(n_chunks, "in").groupBy("in")).applyInArrow(by_window, "cid long, key long, n int")
        again = saved(_recurring_keys(rows.withColumn("kinds", F.lit(1))), f"{folder}/windows")
        known = known.unionByName(again.select(F.col("cid").alias("in"), "key", F.lit(_WINDOW).alias("how")))

    names = ["key", "cid", "piece", "places", "ranges"]

    def deal(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if left.num_rows and right.num_rows:
            cid, chunk, keys = left.column("cid")[0].as_py(), Chunk.unpacked(left), _keys(right)
            values = [units.values(t, worker_hashes()) for t in chunk.texts]
            h, _, d, a, b = runs_of(values, units)
            own = np.isin(h, keys[_ANCHOR])
            parts = [(h[own], d[own], a[own], b[own])]
            if len(keys[_CROWDED]):
                own = np.isin(h, keys[_CROWDED])
                w, wd, s = _windows(values, d[own], a[own], b[own], units.length)
                own = np.isin(w, keys[_WINDOW])
                parts.append((w[own], wd[own], s[own], s[own]))
            h, d, a, b = (np.concatenate(c) for c in zip(*parts))
            order = np.lexsort((a, d, chunk.ids[d]))  # places of a piece come in order of doc_id, then place
            places = np.empty(len(order), _PLACE)
            places["id"], places["d"], places["a"] = chunk.ids[d[order]], d[order], a[order]
            held: dict[tuple[int, bytes], list[int]] = {}
            doc, text = -1, []
            for i, (k, x, u, v) in enumerate(zip(h[order].view(np.int64).tolist(), d[order].tolist(), a[order].tolist(), b[order].tolist())):
                if x != doc:
                    doc, text = x, chunk.texts[x].split() if units.words else chunk.texts[x]
                piece = text[u : v + units.length]
                held.setdefault((k, b" ".join(piece) if units.words else piece), []).append(i)
            last = b[order]
            for (k, piece), at in held.items():
                ranges = None
                if len(at) > LOCAL:
                    more = places[at[LOCAL:]]
                    rest = np.empty(len(more), _RANGE)
                    rest["d"], rest["a"], rest["b"] = more["d"], more["a"], last[at[LOCAL:]]
                    lead = places[at[0]]
                    ranges = rest[(more["id"] != lead["id"]) | (more["a"] != lead["a"])].tobytes() if units.later else rest.tobytes()
                rows.append((k, cid, piece, places[at[:LOCAL]].tobytes(), ranges))
        columns = zip(*rows) if rows else [[]] * 5
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=names)

    tasks = tasks_for(-(-known.count() // TASK_ROWS))
    dealt = corpus.repartition(n_chunks, "cid").groupBy("cid").cogroup(known.repartition(n_chunks, "in").groupBy("in")).applyInArrow(deal, "key long, cid long, piece binary, places binary, ranges binary")
    marked = dealt.repartition(tasks, "key").sortWithinPartitions("key").mapInArrow(_settled(settle), "cid long, ranges binary")
    marks = saved(marked, f"{folder}/found")
    for part in ("anchors", "windows"):
        forget(docs.sparkSession, f"{folder}/{part}")
    return corpus, marks


def applied(corpus: DataFrame, found: DataFrame, judge: Callable[[Chunk, list[tuple[np.ndarray, np.ndarray]]], pa.Table], schema: str) -> DataFrame:
    """``judge`` on each chunk, with the joined ranges of window starts of each of its texts."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = Chunk.unpacked(left)
        every = np.frombuffer(b"".join(right.column("ranges").to_pylist()), _RANGE)
        d, a, b = joined_ranges(*(every[c].astype(np.int64) for c in ("d", "a", "b")))
        cuts = np.searchsorted(d, np.arange(len(chunk.texts) + 1))
        return judge(chunk, [(a[i:j], b[i:j]) for i, j in zip(cuts, cuts[1:])])

    n_chunks = tasks_for(corpus.count())
    release(corpus.sparkSession)  # the pieces that were dealt, before the corpus is shuffled again
    marks = found.select(F.col("cid").alias("in"), "ranges")
    return corpus.repartition(n_chunks, "cid").groupBy("cid").cogroup(marks.repartition(n_chunks, "in").groupBy("in")).applyInArrow(run, schema)
