"""SimHash near-duplicates, linked with BK-trees.

Fingerprints of whole texts are made document by document.  Exact copies
share a fingerprint, so only distinct fingerprints are compared.

Two fingerprints that differ in at most ``radius`` of 64 bits agree in full on
at least ``blocks - radius`` of ``blocks`` blocks of bits.  Each fingerprint
goes to one shard for each choice of so many blocks, keyed by their bits; each
shard is a BK-tree whose children are keyed by their Hamming distance to the
parent, and a search follows only edges within the radius of the searched
distance.  Any linked pair meets in a shard, so no link is lost.  The trees
are not broadcast: together they grow with the corpus, so each is built in the
task its shard is shuffled to.  A shard of more than ``SLICE`` fingerprints is
dealt further by other bits; if it is crowded still, all its rows are compared
with a leader, and only those not near it search, in cells of bounded size.  A
shard emits the links of a spanning forest, never all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, mix, raw_texts, saved, work_folder
from .components import DisjointSets, connected_components

SHINGLE_WORDS = 4
SEED = 42
SLICE = 4096
#: What a row does in a cell.
SEARCHES, HELD, NEAR = 1, 2, 4
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_hashes(text: bytes | None, width: int = SHINGLE_WORDS) -> np.ndarray:
    """XXH64 of each shingle of ``width`` words, repeats included; A-Z lowered."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    line = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    stops = ends[width - 1 :].tolist()
    starts = [0, *(ends[: -width] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts, stops)], dtype=np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in more than half of the hashes; 0 for none."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)]).astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, dtype=np.uint64).view(np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, fp`` (the fingerprint as a signed long); one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            prints = _signed([simhash(shingle_hashes(t, shingle)) for t in raw_texts(batch)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints)], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


class BkTree:
    """A BK-tree over integers; children are keyed by the distance to their parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        """Its node; an equal value shares one."""
        if not self.values:
            self.values.append(value)
            self.children.append({})
            return 0
        at = 0
        while d := (value ^ self.values[at]).bit_count():
            if (child := self.children[at].get(d)) is None:
                self.children[at][d] = len(self.values)
                self.values.append(value)
                self.children.append({})
                return len(self.values) - 1
            at = child
        return at

    def within(self, value: int, radius: int) -> list[int]:
        """Nodes at most ``radius`` away."""
        found, left = [], [0] if self.values else []
        while left:
            at = left.pop()
            d = (value ^ self.values[at]).bit_count()
            if d <= radius:
                found.append(at)
            left += [c for k, c in self.children[at].items() if d - radius <= k <= d + radius]
        return found


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of rows of 64-bit words."""
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


class PackedBkTree:
    """The same tree for large shards: built and searched level by level with numpy.

    Values are rows of 64-bit words.  All nodes of a level form one array, so
    a search of many values handles a level's (value, node) visits in one step.
    """

    def __init__(self, values: np.ndarray):
        self.values = values
        n = len(values)
        self.edge = np.zeros(n, dtype=np.int16)  # distance to the parent
        self.first, self.count = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        order: list[np.ndarray] = []  # children lists, level by level
        done = 0
        members, parent_of = np.arange(1, n), np.zeros(max(n - 1, 0), dtype=np.int64)
        while len(members):
            d = distance(values[members], values[parent_of])
            rank = np.lexsort((members, d, parent_of))
            members, parent_of, d = members[rank], parent_of[rank], d[rank]
            new = np.ones(len(members), dtype=bool)
            new[1:] = (parent_of[1:] != parent_of[:-1]) | (d[1:] != d[:-1])
            heads = members[new]  # each becomes the child of its parent at distance d
            self.edge[heads] = d[new]
            parents, at, many = np.unique(parent_of[new], return_index=True, return_counts=True)
            self.first[parents], self.count[parents] = done + at, many
            order.append(heads)
            done += len(heads)
            parent_of = heads[np.cumsum(new) - 1]
            members, parent_of = members[~new], parent_of[~new]
        self.order = np.concatenate(order) if order else np.empty(0, dtype=np.int64)

    def within(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (index of the query, node) at most ``radius`` apart, in pieces."""
        q, node = np.arange(len(queries)), np.zeros(len(queries), dtype=np.int64)
        if not len(self.values):
            return
        while len(q):
            d = distance(queries[q], self.values[node])
            hit = d <= radius
            yield q[hit], node[hit]
            many = self.count[node]
            at = np.repeat(self.first[node] - np.cumsum(many) + many, many) + np.arange(many.sum())
            q, d, node = np.repeat(q, many), np.repeat(d, many), self.order[at]
            near = np.abs(self.edge[node] - d) <= radius
            q, node = q[near], node[near]


def cell_links(values: np.ndarray, nodes: np.ndarray, roles: np.ndarray, radius: int, alike: Callable[[int, int], bool] | None = None) -> list[tuple[int, int]]:
    """Links (by index) of a spanning forest of those that SEARCHES find among the HELD.

    With ``alike``, values within the radius are linked only if it agrees; it
    is asked about each two that no links connect yet.  Those NEAR a leader
    are connected from the start.
    """
    sets, links = DisjointSets(len(values)), []
    near = np.flatnonzero(roles & NEAR).tolist()
    for i in near[1:]:
        sets.union(near[0], i)

    def link(i: int, j: int) -> None:
        if sets.find(i) != sets.find(j) and (alike is None or alike(j, i)):
            sets.union(i, j)
            links.append((j, i))

    if len(values) <= 64 and (roles == SEARCHES | HELD).all():
        tree, at = BkTree(), []
        held: dict[int, list[int]] = {}
        for i, v in enumerate(int.from_bytes(row.tobytes(), "little") for row in values):  # each link is found when its later end comes
            for k in (k for j in tree.within(v, radius) for k in held[j]):
                link(i, k)
            at.append(tree.add(v))
            held.setdefault(at[-1], []).append(i)
        return links
    kept, asked = np.flatnonzero(roles & HELD), np.flatnonzero(roles & SEARCHES)
    tree = PackedBkTree(values[kept])
    both = (roles & (SEARCHES | HELD)) == SEARCHES | HELD
    for at in range(0, len(asked), 256):
        own = asked[at : at + 256]
        for q, node in tree.within(values[own], radius):
            i, j = own[q], kept[node]
            new = (nodes[i] != nodes[j]) & ~(both[i] & both[j] & (j > i))  # the other finds those too
            for x, y in zip(i[new].tolist(), j[new].tolist()):
                link(x, y)
    return links


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sets (sorted arrays) share at least ``similarity`` of their union."""
    few, many = sorted((len(a), len(b)))
    if few < similarity * many - 1e-9:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (few + many - both) - 1e-9


def _close(fp: pa.Array, other: pa.Array, radius: int) -> np.ndarray:
    a, b = (np.frombuffer(b"".join(c.to_pylist()), "<u8").reshape(len(c), -1) for c in (fp, other))
    return distance(a, b) <= radius


def link_shards(dealt: DataFrame, radius: int, similarity: float | None = None, shingle: int = SHINGLE_WORDS, split: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``a, b``: links that connect all nodes of each shard whose fingerprints are within ``radius``.

    ``dealt``: ``shard`` (long), ``node`` (long) and ``fp`` (binary, whole
    64-bit words), each node once in a shard.  With ``similarity`` it also has
    ``text``, and only texts that share so much of their shingles are linked.

    A shard of more than SLICE rows is first dealt further by ``split``.  If
    it is crowded still, all its rows are compared with one of them, its
    leader; of a group of copies few remain that are not near it, and only
    these search, in cells of at most SLICE searches and SLICE rows searched.
    """
    exact = similarity is not None
    folder, more = work_folder(dealt.sparkSession), ["text"] if exact else []
    columns = ["shard", "node", "fp", *more]
    sizes = saved(dealt.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), f"{folder}/sizes")
    sized = dealt.join(sizes, "shard")
    zero = F.lit(0).cast("long")
    cells = sized.where(F.col("n") <= SLICE).select(*columns, zero.alias("strip"), zero.alias("block"), F.lit(SEARCHES | HELD).alias("role"))
    others: DataFrame | None = None
    if not sizes.where(F.col("n") > SLICE).isEmpty():
        crowded = sized.where(F.col("n") > SLICE).select(columns)
        if split is not None:
            others = link_shards(split(crowded), radius, similarity, shingle)
        else:
            names = [c if c == "shard" else "lead" if c == "node" else f"lead_{c}" for c in columns]

            def pick(table: pa.Table) -> pa.Table:
                """That row of some of a shard's which is closest to what most of them have in each bit."""
                prints = np.frombuffer(b"".join(table.column("fp").to_pylist()), np.uint8).reshape(table.num_rows, -1)
                middle = np.packbits(2 * np.unpackbits(prints, axis=1).sum(axis=0, dtype=np.int64) > table.num_rows)
                return table.slice(int(np.bitwise_count(prints ^ middle).sum(axis=1).argmin()), 1).rename_columns(names)

            # which row leads decides what is compared, not what is linked, so some of the rows may choose
            some = sized.where((F.col("n") > SLICE) & (F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / 1024)) == 0)).select(columns)
            lead = some.groupBy("shard").applyInArrow(pick, f"shard long, lead long, lead_fp binary{', lead_text string' * exact}")

            def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    near = _close(batch.column("fp"), batch.column("lead_fp"), radius) if batch.num_rows else np.empty(0, bool)
                    if exact:
                        text, other = raw_texts(batch), raw_texts(batch, "lead_text")
                        for i in np.flatnonzero(near).tolist():
                            near[i] = similar(*(np.unique(shingle_hashes(t, shingle)) for t in (text[i], other[i])), similarity)
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in [*columns, "lead"]), pa.array(near)], [*columns, "lead", "near"])

            starred = saved(crowded.join(lead, "shard").mapInArrow(compare, f"shard long, node long, fp binary, {'text string, ' * exact}lead long, near boolean"), f"{folder}/starred")
            left = starred.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("near")).alias("u")).where("u > 0")
            open_ = starred.join(left, "shard").withColumns({"strips": F.ceil(F.col("u") / SLICE), "blocks": F.ceil(F.col("n") / SLICE)})
            one = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
            each = lambda n: F.explode(F.sequence(zero, F.col(n) - 1))
            searches = open_.where("not near").select(*columns, one("strips").alias("strip"), each("blocks").alias("block"), F.lit(SEARCHES).alias("role"))
            held = open_.select(*columns, each("strips").alias("strip"), one("blocks").alias("block"), F.when(F.col("near"), HELD | NEAR).otherwise(HELD).alias("role"))
            cells = cells.unionByName(searches).unionByName(held)
            others = starred.where("near and node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(keys: np.ndarray, prints: list[bytes], texts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            cuts = np.flatnonzero(np.any(keys[1:, :3] != keys[:-1, :3], axis=1)) + 1
            values = np.frombuffer(b"".join(prints), "<u8").reshape(len(prints), -1)
            links = []
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
                if b - a > 1:
                    alike = (lambda i, j, a=a: similar(texts[a + i], texts[a + j], similarity)) if exact else None
                    links += [(a + i, a + j) for i, j in cell_links(values[a:b], keys[a:b, 3], keys[a:b, 4], radius, alike)]
            if links:
                nodes = keys[:, 3][np.array(links)]
                yield pa.RecordBatch.from_arrays([pa.array(nodes[:, 0]), pa.array(nodes[:, 1])], ["a", "b"])

        held_keys: list[np.ndarray] = []
        held: list[bytes] = []
        sets: list[np.ndarray] = []
        for batch in chunks(batches) if exact else batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("shard", "strip", "block", "node", "role")], axis=1)
            prints = batch.column("fp").to_pylist()
            own = [np.unique(shingle_hashes(t, shingle)) for t in raw_texts(batch)] if exact else []
            changes = np.flatnonzero(np.any(keys[1:, :3] != keys[:-1, :3], axis=1)) + 1
            if held and tuple(held_keys[-1][-1, :3]) != tuple(keys[0, :3]):
                yield from flush(np.concatenate(held_keys), held, sets)
                held_keys, held, sets = [], [], []
            last = int(changes[-1]) if len(changes) else 0
            if last:
                yield from flush(np.concatenate([*held_keys, keys[:last]]), held + prints[:last], sets + own[:last])
                held_keys, held, sets = [], [], []
            held_keys.append(keys[last:])
            held += prints[last:]
            sets += own[last:]
        if held:
            yield from flush(np.concatenate(held_keys), held, sets)

    cell = ("shard", "strip", "block")
    links = cells.repartition(*cell).sortWithinPartitions(*cell, "node").mapInArrow(run, "a long, b long")
    return links if others is None else links.unionByName(others)


def _block_keys(fp: Column, blocks: list[int], radius: int, *more: Column) -> Column:
    """A key for each choice of so many blocks (masks of bits) that two values within the radius agree in one of them."""
    keys = []
    for t, chosen in enumerate(combinations(blocks, len(blocks) - radius)):
        mask = sum(chosen)
        keys.append(F.xxhash64(*more, F.lit(t), fp.bitwiseAND(F.lit(mask - ((mask >> 63) << 64)))))
    return F.array(*keys)


def link_fingerprints(distinct: DataFrame, radius: int = 4, blocks: int | None = None) -> DataFrame:
    """``a, b``: links that connect all fingerprints (column ``fp``, distinct longs) within ``radius``."""
    blocks = blocks or radius + 2
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    rows = lambda df, keys: df.select("node", "fp", F.explode(keys).alias("shard"))

    def split(crowded: DataFrame) -> DataFrame:
        """By blocks made of every ``blocks``-th bit, which differ from those that the shard agrees in."""
        apart = [sum(1 << i for i in range(k, 64, blocks)) for k in range(blocks)]
        return rows(crowded.select("node", "fp", "shard"), _block_keys(F.col("node"), apart, radius, F.col("shard")))

    named = distinct.select(F.col("fp").alias("node"), F.unhex(F.lpad(F.hex("fp"), 16, "0")).alias("fp"))
    in_row = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    return link_shards(rows(named, _block_keys(F.col("node"), in_row, radius)), radius, split=split)


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, fp, component_id``; one row per input row.

    Null and empty texts have fingerprint 0 and link like any other.
    ``component_id`` is the smallest doc_id reachable (null ids are smaller
    than none: a component of null ids alone has a null id).  Repeated rows
    share a fingerprint and so a component.  Columns other than the two named
    are not read, so their names cannot clash.
    """
    folder = work_folder(docs.sparkSession)
    prints = saved(fingerprints(docs, id_col, text_col, shingle), f"{folder}/prints")
    distinct = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), f"{folder}/distinct")
    groups = connected_components(link_fingerprints(distinct.select("fp"), radius))
    named = distinct.join(groups, distinct["fp"] == groups["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("group"))
    named = saved(named, f"{folder}/named")
    least = named.groupBy("group").agg(F.min("least").alias("component_id"))
    by_print = named.join(least, "group").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", "fp", "component_id")


#: Words of 64 bits in the wide fingerprint, shingles that name a document's shards, and that deal a crowded shard further.
WIDE = 4
SHARDS_EACH = 6
SPLITS_EACH = 6
CANDIDATE_SLACK = 0.05


def wide_prints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """``doc_id, content`` (hash of the text), ``node`` (hash of its set of shingles), ``fp`` (binary, WIDE words, of that set) and ``keys``: for each of some orders of all shingles, the least of the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            prints, keys, nodes = [], [], []
            for text in raw_texts(batch):
                h = np.unique(shingle_hashes(text, shingle))
                nodes.append(xxhash.xxh64_intdigest(h.tobytes(), SEED))
                prints.append(b"".join(simhash(h if i == 0 else mix(h + np.uint64(i))).to_bytes(8, "little") for i in range(WIDE)))
                keys.append([int(mix(h ^ np.uint64(0x5851F42D4C957F2D * (i + 1) % (1 << 64))).min().view(np.int64)) if len(h) else 0 for i in range(SHARDS_EACH + SPLITS_EACH)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("content"), pa.array(_signed(nodes)), pa.array(prints, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "content", "node", "fp", "keys"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("content"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, "doc_id long, content long, node long, fp binary, keys array<long>")


def near_duplicates_removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """The input's rows without all but one (the smallest doc_id) of each group of near-duplicates.

    Documents are near-duplicates if their sets of ``shingle``-word shingles
    have a Jaccard similarity of at least ``similarity``; groups are the
    components of these links.  Candidates come first: fingerprints of WIDE
    words that agree in ``similarity`` less CANDIDATE_SLACK of their bits (four
    standard deviations beyond what texts of 0.8 have), in shards named by the
    shingles that come first in SHARDS_EACH orders; documents that share a
    part J of their shingles miss each other in all shards with probability
    (1 - J) ** SHARDS_EACH, below 0.0001 at 0.8.  Then each component of
    candidates is searched once more, with its texts, and a link stays only
    if the shingles themselves agree.

    Of each group one row is kept: that with the smallest doc_id, one with a
    null id only if there is no other, and of rows that repeat an id and a
    text one.  Null and empty texts are near-duplicates of each other.  Texts
    are read in whole.  All columns stay, whatever their names.
    """
    folder = work_folder(docs.sparkSession)
    prints = saved(wide_prints(docs, id_col, text_col, shingle), f"{folder}/prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "content"))
    distinct = saved(prints.groupBy("node").agg(first.alias("least"), F.first("fp").alias("fp"), F.first("keys").alias("keys")), f"{folder}/distinct")
    keyed = lambda df, at: df.select("node", "fp", "shard", F.posexplode(F.slice("keys", at + 1, SHARDS_EACH)).alias("i", "key")).select("node", "fp", F.xxhash64("shard", "i", "key").alias("shard"))
    dealt = keyed(distinct.withColumn("shard", F.lit(0)), 0)
    split = lambda crowded: keyed(crowded.join(distinct.select("node", "keys"), "node"), SHARDS_EACH)
    radius = int(64 * WIDE * (1 - similarity + CANDIDATE_SLACK) + 1e-9)
    loose = connected_components(link_shards(dealt, radius, split=split))
    searched = distinct.join(loose, "node").select(F.col("least.content").alias("content"), "node", "fp", F.col("component").alias("shard"))
    texts = docs.groupBy(F.xxhash64(text_col).alias("content")).agg(F.first(text_col).alias("text"))
    searched = saved(searched.join(texts, "content").select("shard", "node", "fp", "text"), f"{folder}/searched")
    groups = connected_components(link_shards(searched, radius, similarity, shingle))
    named = saved(distinct.join(groups, "node", "left").select("node", "least", F.coalesce("component", "node").alias("group")), f"{folder}/named")
    kept = named.groupBy("group").agg(F.min("least").alias("kept"))
    found = prints.select("doc_id", "content", "node").join(named.select("node", "group"), "node").join(kept, "group")
    same = F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("content") == F.col("kept.content"))
    gone = found.where(~same).select(F.col("doc_id").alias("g_id"), F.col("content").alias("g_content")).distinct()
    again = saved(found.where(same).groupBy("doc_id", "content").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("r_id"), F.col("content").alias("r_content")), f"{folder}/again")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("content"))
    rows = rows.join(gone, F.col("id").eqNullSafe(F.col("g_id")) & (F.col("content") == F.col("g_content")), "left_anti")
    if not again.isEmpty():
        both = F.col("id").eqNullSafe(F.col("r_id")) & (F.col("content") == F.col("r_content"))
        rows = rows.join(again, both, "left_anti").unionByName(rows.join(again, both, "left_semi").dropDuplicates(["id", "content"]))
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
