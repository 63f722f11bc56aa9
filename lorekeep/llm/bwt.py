"""Substring dedup with merged Burrows-Wheeler transforms.

Where a long byte string may recur is narrowed down first (``recurrence``):
runs of windows are dealt to shards by their anchor, as short texts.  If all
texts of an anchor are the same bytes, every one but the earliest is a repeat.
Where they differ, strings begin to differ somewhere inside.  A shard builds
the transforms of its parts and merges them by iterative interleave
refinement: an interleave vector says which part each row of the merged
transform comes from; one pass, a stable sort of the rows by the symbol before
them, makes it right for one more symbol.  Rows that a pass separates get
their common prefix from the number of passes; after as many passes as a
string is long, the rows not separated are the repeated intervals.  Suffixes
of different parts are never sorted together.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import work_folder
from .recurrence import Chunk, Units, applied, joined_ranges, recurring

PART = 128 << 10
#: Bytes in a symbol.  A text is taken as one string of symbols for each phase, so every byte begins a suffix.
WIDE = 10


def ordered(keys: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """A stable order of integers from 0 to ``most``, and these in order: sorted with their places as the lowest bits, several times faster than by reference."""
    bits = len(keys).bit_length()
    if most.bit_length() + bits > 63:
        order = np.argsort(keys, kind="stable")
        return order, keys[order]
    both = (keys.astype(np.int64) << bits) | np.arange(len(keys))
    both.sort()
    return both & ((1 << bits) - 1), both >> bits


def ranks(values: np.ndarray) -> np.ndarray:
    """Codes of integers, from 0 on, in their order."""
    order, found = ordered(values, int(values.max()))
    out = np.empty(len(values), np.int64)
    out[order] = np.cumsum(np.append(0, found[1:] != found[:-1]))
    return out


def symbols_of(texts: list[bytes], wide: int = WIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All strings of whole symbols, each with a terminator (0) after it: symbols; and for each string text, phase and length."""
    flat = np.frombuffer(b"".join(texts) + b"\0" * wide, np.uint8)
    half = wide if wide < 8 else wide // 2  # more than a number holds: the code of one half and that of the other
    grams = np.zeros(len(flat) - half + 1, np.int64)
    for i in range(half):
        grams = (grams << 8) | flat[i : i + len(grams)]
    if half < wide:
        codes = ranks(grams)
        grams = codes[:-half] * len(codes) + codes[half:]
    lengths = np.array(list(map(len, texts)))
    begins = np.cumsum(lengths) - lengths
    text = np.repeat(np.arange(len(texts)), wide)
    phase = np.tile(np.arange(wide), len(texts))
    many = np.maximum(0, (lengths[text] - phase) // wide)
    ends = np.cumsum(many + 1) - 1
    index = np.arange(ends[-1] + 1)
    string = np.repeat(np.arange(len(text)), many + 1)
    step = index - (ends - many)[string]
    place = begins[text[string]] + phase[string] + step * wide
    out = np.where(step < many[string], grams[np.minimum(place, len(grams) - 1)] + 1, 0)
    return out, text, phase, many


def transform(symbols: np.ndarray, strings: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix positions in order, and the symbol before each.

    ``symbols`` are small codes; terminators are 0 and ordered as their strings.
    """
    n = len(symbols)
    rank = symbols.astype(np.int64) + strings
    ends = np.flatnonzero(symbols == 0)
    rank[ends] = np.arange(strings)
    top = int(rank.max()) + 2
    span, key = 1, rank.copy()
    while top ** (span + 1) < 1 << 62 - n.bit_length() and span < 3:  # the first sort sees a few symbols at once
        key *= top
        key[:-span] += rank[span:] + 1
        span += 1
    most = top**span
    while True:
        order, key = ordered(key, most)
        new = np.empty(n, np.int64)
        new[0] = 0
        np.cumsum(key[1:] != key[:-1], out=new[1:])
        if new[-1] == n - 1 or span > n:
            return order, symbols[order - 1]
        rank = np.empty(n, np.int64)
        rank[order] = new
        key = rank * (n + 1)
        key[:-span] += rank[span:] + 1
        span, most = span * 2, (n + 1) ** 2


def merge(parts: list[tuple[np.ndarray, int]], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge transforms (symbols, number of strings): the interleave vector and each row's common prefix with the row before.

    Prefixes are told up to ``most`` symbols: ``most`` stands for as many or more.
    """
    sizes = np.array([len(b) for b, _ in parts])
    begins = np.cumsum(sizes) - sizes
    symbols = np.concatenate([b for b, _ in parts]).astype(np.int64)
    part = np.repeat(np.arange(len(parts), dtype=np.uint8), sizes)
    fixed = np.concatenate([np.arange(i, i + m) for i, (_, m) in zip(begins.tolist(), parts)])
    n, strings, top = len(symbols), len(fixed), int(symbols.max()) + 1
    # where a part's row goes in it when its suffix takes in the symbol before
    longer = np.empty(n, np.int64)
    longer[ordered(part * np.int64(top) + symbols, len(parts) * top)[0]] = np.arange(n)
    row = np.arange(n)  # the interleave: each row's place in the parts, one after the other
    order, first = ordered(symbols, top)
    moved = np.arange(n)  # rows that the order of the last pass may not hold for
    block = np.zeros(n, dtype=np.int32)
    prefix = np.full(n, most, dtype=np.int16)
    prefix[0] = 0
    new = np.zeros(n, dtype=bool)
    alike = np.append(False, first[1:] == first[:-1])
    alike[:strings] = False
    for done in range(most):
        if len(moved):
            came = longer[row[order[moved]]]
            came[: np.searchsorted(moved, strings)] = fixed[moved[moved < strings]]
            swapped = moved[came != row[moved]]
            row[moved] = came
        else:
            swapped = moved
        held = block[order]
        was, new = new, np.empty(n, dtype=bool)
        new[0] = True
        np.not_equal(held[1:], held[:-1], out=new[1:])
        new |= ~alike
        prefix[np.flatnonzero(new != was)] = done
        # rows change places within blocks only, so the rest of the order stays
        live = np.zeros(int(block[-1]) + 1, dtype=bool)
        live[block[swapped]] = True
        live = live[block]
        old, block = block, np.cumsum(new, dtype=np.int32)
        if not len(swapped) and block[-1] == old[-1]:
            break
        place, moved = np.flatnonzero(live), np.flatnonzero(live[order])
        order[moved] = place[ordered(symbols[row[place]], top)[0]]
    return part[row], prefix


def repeated_windows(texts: list[bytes], length: int, many: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, offset and interval of each suffix whose first ``length`` bytes recur among the texts, of which there are ``many`` each."""
    wide = next(w for w in (WIDE, 5, 4, 3, 2, 1) if length % w == 0)
    weight = np.ones(len(texts), np.int64) if many is None else many
    symbols, text, phase, many = symbols_of(texts, wide)
    codes = ranks(symbols)  # 0 stays 0
    ends = np.cumsum(many + 1)
    limit = max(PART, len(symbols) // 200)
    cuts = np.unique(np.searchsorted(ends, np.arange(limit, len(symbols) + limit, limit), side="left") + 1)
    built, where, offset = [], [], []
    for lo, hi in zip([0, *cuts[:-1].tolist()], np.minimum(cuts, len(many)).tolist()):
        if hi <= lo:
            continue
        begin = ends[lo] - many[lo] - 1
        order, before = transform(codes[begin : ends[hi - 1]], hi - lo)
        string = np.repeat(np.arange(lo, hi), many[lo:hi] + 1)[order]
        built.append((before, hi - lo))
        where.append(string)
        offset.append(order + begin - (ends - many - 1)[string])
    source, prefix = merge(built, length // wide)
    rows = np.argsort(source, kind="stable")
    string, off = np.empty(len(source), np.int64), np.empty(len(source), np.int64)
    string[rows], off[rows] = np.concatenate(where), np.concatenate(offset)
    interval = np.cumsum(prefix < length // wide)
    inside = many[string] - off >= length // wide
    take = inside & (np.bincount(interval, weights=inside * weight[text[string]]) > 1)[interval]
    string, off = string[take], off[take]
    return text[string], phase[string] + off * wide, interval[take]


def later_in_pieces(length: int):
    """For ``recurring``: the windows that also start earlier, by equal bytes and by merged transforms."""

    def settle(pieces: list[bytes], group: np.ndarray, of: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        alone = (np.bincount(group) == 1)[group]
        # one text: whole runs, told apart by the piece; unlike texts: windows, told apart by their interval
        whole = np.flatnonzero(alone[of])
        which, off, kind = [whole], [np.zeros(len(whole), np.int64)], [of[whole]]
        if not alone.all():
            unlike = np.flatnonzero(~alone)
            many = np.bincount(of, minlength=len(pieces))
            text, at, interval = repeated_windows([pieces[i] for i in unlike.tolist()], length, many[unlike])
            order = np.argsort(of, kind="stable")
            first = np.searchsorted(of[order], np.arange(len(pieces) + 1))[unlike[text]]
            n = many[unlike[text]]  # a window stands wherever its piece does
            which.append(order[np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())])
            off.append(np.repeat(at, n))
            kind.append(len(pieces) + np.repeat(interval, n))
        which, off, kind = np.concatenate(which), np.concatenate(off), np.concatenate(kind)
        order = np.lexsort((starts[which] + off, ids[which], kind))
        which, off, kind = which[order], off[order], kind[order]
        heads = np.ones(len(kind), dtype=bool)
        heads[1:] = kind[1:] != kind[:-1]
        lead = np.flatnonzero(heads)[np.cumsum(heads) - 1] if len(heads) else np.empty(0, np.int64)
        place = starts[which] + off
        gone = (ids[which] != ids[which[lead]]) | (place != place[lead])
        which, off, single = which[gone], off[gone], kind[gone] < len(pieces)
        sizes = np.array(list(map(len, pieces)))
        return joined_ranges(which, off, np.where(single, sizes[of[which]] - length, off))

    return settle


def remove_later_substrings(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Remove each byte in a ``length``-byte string that also starts earlier (smaller doc_id, or earlier in the same document).

    ``doc_id, n_bytes, n_removed, n_spans`` and the kept bytes, as ``kept``
    (binary: a cut may fall inside a character) or as their SHA-256.  One row
    per input row; null and empty texts lose nothing; a null id counts as
    smaller than any other.  Rows that repeat an id are not earlier than each
    other at the same place.  Strings are judged on the input.  Long texts are
    read in whole, in pieces that overlap by a string.  Other columns are left
    out.
    """
    folder = work_folder(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    corpus, found = recurring(slim, Units(words=False, length=length, gram=min(32, max(1, length // 3)), later=True), folder, later_in_pieces(length))

    def judge(chunk: Chunk, ranges: list[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
        sizes, removed, spans, out = [], [], [], []
        for text, (a, b) in zip(chunk.texts, ranges):
            kept, n, gone = text, 0, 0
            if len(a):
                # bytes of neighbouring strings join where they touch
                _, x, y = joined_ranges(np.zeros(len(a), np.int64), a, b + length - 1)
                n, gone = len(x), int((y - x + 1).sum())
                edges = [0, *np.stack([x, y + 1], axis=1).reshape(-1).tolist(), len(text)]
                kept = b"".join(text[i:j] for i, j in zip(edges[::2], edges[1::2]))
            sizes.append(len(text))
            removed.append(gone)
            spans.append(n)
            out.append(hashlib.sha256(kept).hexdigest() if digest else kept)
        return pa.table([chunk.id_column(), *[pa.array(v, pa.int64()) for v in (sizes, removed, spans)], pa.array(out, pa.string() if digest else pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", name])

    name = "kept_sha256" if digest else "kept"
    return applied(corpus, found, judge, f"doc_id long, n_bytes long, n_removed long, n_spans long, {name} {'string' if digest else 'binary'}")
