"""BPE encoding and decoding with a public vocabulary file.

Each word is merged over a contiguous rank array: the boundaries of its parts
and, beside each boundary, the rank of the pair that meets there.  The array
is scanned for its minimum, that boundary is deleted and the two neighbouring
ranks are refreshed, until no pair has a rank.  Words of more than
``SHORT_WORD`` parts, where repeated scans would be quadratic, keep the same
ranks in a heap and give the same result.

Words repeat, so each worker remembers what a word became.  Nothing is
shuffled: the operator is one projection of its input.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import CACHE_ENTRIES, chunks, list_column

SHORT_WORD = 256
#: Bytes of text encoded at once: the ids of a chunk and the strings of its words stay in memory until it is done.
CHUNK = 1 << 20

# The vocabulary's splitting pattern, spelled for Latin-1 text.
_SPACE = r"\t-\r \x85\xa0"
_LETTER = r"A-Za-zªµºÀ-ÖØ-öø-ÿ"
_NUMBER = r"0-9²³¹¼½¾"
_LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")


@lru_cache(1)
def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordBpe:
    """Encoder and decoder for one vocabulary file of the ``tokenizers`` library.

    Normalising and splitting text other than Latin-1 is left to the
    library's components; the merges are done here.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.ids.items(), *self.special.items()]}
        # pair of ids -> (rank, id of the merged part)
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            self.ranks[self.ids[a], self.ids[b]] = rank, self.ids[a + b]
        whole = Tokenizer.from_file(path)
        self.normalizer, self.splitter = whole.normalizer, whole.pre_tokenizer
        self.special_pattern = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.alphabet = byte_alphabet()
        self.cache: dict[str, tuple[str, int, str]] = {}

    # -- one word ---------------------------------------------------------
    def encode_word(self, word: str) -> list[int]:
        """Ids of one word, given in the byte alphabet."""
        if not word:
            return []
        parts = [self.ids[c] for c in word[:-1]]
        parts.append(self.ids[word[-1] + self.suffix])
        return self._scan(parts) if len(parts) <= SHORT_WORD else self._heap(parts)

    def _scan(self, parts: list[int]) -> list[int]:
        ranks, none = self.ranks, (1 << 60, -1)
        # at[i]: rank (and result) of the pair that meets at boundary i, between parts i and i + 1
        at = [ranks.get(pair, none) for pair in zip(parts, parts[1:])]
        while at:
            least = min(at)
            if least is none:
                break
            i = at.index(least)
            parts[i] = least[1]
            del parts[i + 1], at[i]
            if i:
                at[i - 1] = ranks.get((parts[i - 1], parts[i]), none)
            if i < len(at):
                at[i] = ranks.get((parts[i], parts[i + 1]), none)
        return parts

    def _heap(self, parts: list[int]) -> list[int]:
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(r[0], i, parts[i], parts[i + 1], r[1]) for i in range(n - 1) if (r := self.ranks.get((parts[i], parts[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, i, a, b, merged = heapq.heappop(queue)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue  # one of the two has been merged meanwhile
            parts[i], parts[j] = merged, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := self.ranks.get((parts[x], parts[y]))):
                    heapq.heappush(queue, (r[0], x, parts[x], parts[y], r[1]))
        return [p for p in parts if p >= 0]

    # -- texts ------------------------------------------------------------
    def words(self, text: str) -> list[str]:
        """The words of a text without special tokens; Latin-1 words as they are, others in the byte alphabet after a lone surrogate, which no text holds."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return ["\ud800" + w for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text))]
        return _LATIN.findall(text.lower())

    def remembered(self, word: str) -> tuple[str, int, str]:
        """(ids joined by spaces, their number, decoded text) of a word as ``words`` gives it."""
        if (known := self.cache.get(word)) is None:
            mapped = word[1:] if word[0] == "\ud800" else "".join(self.alphabet[b] for b in word.encode())
            ids = self.encode_word(mapped)
            known = " ".join(map(str, ids)), len(ids), self.decode(ids)
            if len(self.cache) >= CACHE_ENTRIES // 2:
                self.cache.clear()
            if len(word) <= SHORT_WORD:
                self.cache[word] = known
        return known

    def pieces(self, text: str) -> tuple[list[str], int, list[str]]:
        """Id strings, number of ids and decoded strings, word by word."""
        ids: list[str] = []
        decoded: list[str] = []
        n = at = 0
        marks = list(self.special_pattern.finditer(text)) if self.special_pattern else []
        for mark in [*marks, None]:
            words = self.words(text[at : mark.start() if mark else len(text)])
            cached = self.cache
            found = [cached.get(w) or self.remembered(w) for w in words]
            if found:
                a, b, c = zip(*found)
                ids += a
                n += sum(b)
                decoded += c
            if mark:
                ids.append(str(self.special[mark[0]]))
                decoded.append(mark[0])
                n += 1
                at = mark.end()
        return ids, n, decoded

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for i in " ".join(self.pieces(text or "")[0]).split()]

    def decode(self, ids: Iterable[int]) -> str:
        """The vocabulary names no decoder: parts are joined by single spaces, special ones included."""
        return " ".join(self.tokens[i] for i in ids)


_loaded: dict[str, WordBpe] = {}


def loaded(path: str) -> WordBpe:
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, decoded: bool = False, digests: bool = False) -> DataFrame:
    """Encode each whole text; one row per input row, in no given order.

    ``doc_id, n_tokens`` and, as asked, ``token_ids`` (array of int),
    ``decoded`` (string) and the two digests.  A null or empty text has no
    tokens.  Repeated rows and repeated or null ids each keep their row; long
    texts are encoded in whole, one at a time; other columns are left out, so
    none can clash.  ``vocabulary`` is a path that
    every worker can open.
    """
    fields = [("doc_id", "long"), ("n_tokens", "long")] + [("token_ids", "array<int>")] * ids + [("decoded", "string")] * decoded + [("ids_sha256", "string"), ("decoded_sha256", "string")] * digests
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary)
        for batch in chunks(batches, most=CHUNK):
            out: dict[str, list] = {name: [] for name, _ in fields}
            numbers: list[np.ndarray] = []
            for text in batch.column("text").to_pylist():
                strings, n, parts = bpe.pieces(text or "")
                out["n_tokens"].append(n)
                if ids:
                    numbers.append(np.fromstring(" ".join(strings), dtype=np.int32, sep=" ") if n else np.empty(0, np.int32))
                if decoded or digests:
                    whole = " ".join(parts)
                    if decoded:
                        out["decoded"].append(whole)
                    if digests:
                        out["ids_sha256"].append(sha(" ".join(strings)))
                        out["decoded_sha256"].append(sha(whole))
            columns = {"doc_id": batch.column("doc_id")}
            if ids:
                columns["token_ids"] = list_column(np.concatenate(numbers), np.array(list(map(len, numbers))), pa.int32())
            kinds = {"long": pa.int64(), "string": pa.string()}
            yield pa.RecordBatch.from_arrays([columns[name] if name in columns else pa.array(out[name], kinds[kind]) for name, kind in fields], [name for name, _ in fields])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, ", ".join(f"{name} {kind}" for name, kind in fields))


def decode_documents(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """``doc_id, decoded``; null ids decode to the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary)
        for batch in batches:
            texts = [bpe.decode(x or []) for x in batch.column("token_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "decoded"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("token_ids")).mapInArrow(run, "doc_id long, decoded string")
