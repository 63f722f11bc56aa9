"""Substring dedup with repeated-phrase automata.

Runs of windows that may recur are dealt out by anchor (``recurrence``).  A
shard holds the texts of all runs of its anchors.  It confirms which windows
recur, by the words themselves, compiles the passages they make up, each
distinct one once, into an Aho-Corasick automaton over words, and streams all
texts through it that share an anchor with the shard; what the automaton
locates, and nothing else, is removed wherever that text stands.  Shards are
bounded, so each automaton stays in memory whatever the size of the corpus.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from itertools import accumulate, compress

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import work_folder
from .recurrence import Chunk, Units, applied, joined_ranges, recurring

#: Code points that stand for one word each: all but surrogates and NUL, which stands for words in no passage.
_ONE = 0x10FFFF - 0x800 - 1


def _symbol(i: int) -> str:
    return chr(i + 1 if i < 0xD7FF else i + 0x801)


class PassageAutomaton:
    """All passages of a shard; words are coded as one code point, or two where a shard has too many words."""

    def __init__(self, passages: set[tuple[bytes, ...]], most: int = _ONE):
        words = sorted({w for p in passages for w in p})
        self.width = 1 if len(words) <= most else 2
        self.blank = "\0" * self.width
        base = min(most, 1 << 20)
        self.codes = {w: _symbol(i) if self.width == 1 else _symbol(i // base) + _symbol(i % base) for i, w in enumerate(words)}
        self.automaton = ahocorasick.Automaton()
        for p in passages:
            self.automaton.add_word("".join(map(self.codes.__getitem__, p)), len(p))
        if passages:
            self.automaton.make_automaton()

    def located(self, words: list[bytes]) -> list[tuple[int, int]]:
        """First word and end of each occurrence of a passage."""
        found = []
        if len(self.automaton):
            codes, blank, width = self.codes, self.blank, self.width
            line = "".join([codes.get(w, blank) for w in words])
            for end, n in self.automaton.iter(line):
                if (end + 1) % width == 0:
                    stop = (end + 1) // width
                    found.append((stop - n, stop))
        return found


def confirmed(pieces: list[bytes], many: np.ndarray, group: np.ndarray, length: int) -> set[tuple[bytes, ...]]:
    """The passages that recurring windows of the pieces make up; ``many``: occurrences of each piece, ``group``: its anchor.

    Equal windows have equal anchors.  An anchor whose occurrences all have
    the same text recurs with the whole of it.
    """
    alone = np.bincount(group)[group] == 1
    passages = {tuple(pieces[i].split()) for i in np.flatnonzero(alone & (many > 1)).tolist()}
    seen: Counter[bytes] = Counter()
    windows = []
    pieces, many = [pieces[i] for i in np.flatnonzero(~alone).tolist()], many[~alone]
    for piece, n in zip(pieces, many.tolist()):
        ends = list(accumulate(len(w) + 1 for w in piece.split()))  # of words, with the space after
        own = [piece[a : b - 1] for a, b in zip([0, *ends], ends[length - 1 :])]
        windows.append(own)
        for w in own:
            seen[w] += n
    for piece, own in zip(pieces, windows):
        twice = np.array([seen[w] > 1 for w in own])
        if twice.any():
            words = piece.split()
            edges = np.flatnonzero(np.diff(twice.astype(np.int8), prepend=0, append=0))
            passages.update(tuple(words[x : y - 1 + length]) for x, y in zip(edges[::2].tolist(), edges[1::2].tolist()))
    return passages


def located_in_pieces(length: int):
    """For ``recurring``: confirm, compile and locate."""

    def settle(pieces: list[bytes], group: np.ndarray, of: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        automaton = PassageAutomaton(confirmed(pieces, np.bincount(of, minlength=len(pieces)), group, length))
        hits = [(i, x, y - length) for i, piece in enumerate(pieces) for x, y in automaton.located(piece.split())]
        p, x, y = joined_ranges(*(np.array(c, np.int64) for c in zip(*hits))) if hits else (np.empty(0, np.int64),) * 3
        order = np.argsort(of, kind="stable")
        first = np.searchsorted(of[order], np.arange(len(pieces) + 1))
        n = np.diff(first)[p]  # each hit stands wherever its piece does
        return order[np.repeat(first[:-1][p] - np.cumsum(n) + n, n) + np.arange(n.sum())], np.repeat(x, n), np.repeat(y, n)

    return settle


def remove_repeated_phrases(docs: DataFrame, length: int = 35, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Remove each word in a window of ``length`` words that also starts anywhere else in the corpus.

    ``doc_id, n_words, n_removed`` and the kept words joined by single spaces,
    as ``text`` or as its SHA-256.  One row per input row.  Null, empty and
    short texts lose nothing.  Repeated rows are occurrences of each other;
    rows with a null id take part like others.  Windows are judged on the
    input.  Long texts are read in whole, in pieces that overlap by a window.
    Other columns are left out.
    """
    folder = work_folder(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    corpus, found = recurring(slim, Units(words=True, length=length, gram=min(8, length), later=False), folder, located_in_pieces(length))

    def judge(chunk: Chunk, ranges: list[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
        counts, removed, out = [], [], []
        for text, (a, b) in zip(chunk.texts, ranges):
            words = text.split()
            steps = np.zeros(len(words) + 1, np.int64)
            np.add.at(steps, a, 1)
            np.add.at(steps, b + length, -1)
            kept = np.cumsum(steps[:-1]) == 0
            line = b" ".join(compress(words, kept.tolist()) if len(a) else words)
            counts.append(len(words))
            removed.append(len(words) - int(kept.sum()))
            out.append(hashlib.sha256(line).hexdigest() if digest else line.decode())
        return pa.table([chunk.id_column(), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(out, pa.string())], names=["doc_id", "n_words", "n_removed", name])

    name = "kept_sha256" if digest else "text"
    return applied(corpus, found, judge, f"doc_id long, n_words long, n_removed long, {name} string")
