"""Operators over the whole corpus, against brute force on small inputs."""

import hashlib
import math
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lorekeep.llm import bwt, components, lm, media, phrases, recurrence, simhash

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 7) for r in rows], "doc_id long, text string, rid string, ranges int")


def docs_of(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def in_order(rows):
    return sorted(map(tuple, rows), key=str)


def repeats(seed, base, joiner, alphabet):
    """Documents around a shared passage: parts of it, all of it in other surroundings, noise, nulls and repeated rows."""
    rng = random.Random(seed)
    noise = lambda n: joiner.join(rng.choice(alphabet) for _ in range(n))
    rows = []
    for i in range(70):
        a = rng.randrange(len(base) // 3)
        part = joiner.join(base[a : a + rng.randrange(len(base))])
        text = rng.choice([noise(rng.randrange(30)), part + "\t" + noise(9), "x" + joiner + "x", noise(10) + joiner + joiner.join(base) + joiner + noise(10), None, "", "ñandú\x0b\x0c y", joiner.join(base), (joiner + "x") * rng.randrange(40)])
        rows.append((i if rng.random() < 0.9 else None, text))
    return rows + rows[:5]


# -- repeated phrases ----------------------------------------------------------------


def brute_phrases(rows, length):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    seen = Counter(tuple(w[k : k + length]) for _, w in words for k in range(len(w) - length + 1))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if seen[tuple(w[k : k + length])] > 1:
                gone[k : k + length] = [True] * length
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return in_order(out)


def small_parts(monkeypatch, crowd):
    """Many small chunks, shards and batches of pieces."""
    monkeypatch.setattr(recurrence, "CROWD", crowd)
    monkeypatch.setattr(recurrence, "LOCAL", 2)
    monkeypatch.setattr(recurrence, "PIECES", 50)
    monkeypatch.setattr(recurrence, "TASK_ROWS", 100)
    monkeypatch.setattr(recurrence.Units, "__post_init__", lambda self: object.__setattr__(self, "chunk", 2000), raising=False)


@pytest.mark.parametrize("crowd", [2, 256])
def test_phrases(spark, monkeypatch, crowd):
    small_parts(monkeypatch, crowd)
    rows = repeats(crowd, [f"w{i % 23}" for i in range(60)], " ", [str(i) for i in range(50)])
    assert in_order(phrases.remove_repeated_phrases(frame(spark, rows), 12, digest=True).collect()) == brute_phrases(rows, 12)


@needs_tables
def test_phrases_on_documents(spark):
    rows = [tuple(r) for r in docs_of(spark).select("doc_id", "text").collect()]
    assert in_order(phrases.remove_repeated_phrases(docs_of(spark), digest=True).collect()) == brute_phrases(rows, 35)


def test_phrases_edges(spark):
    assert phrases.remove_repeated_phrases(frame(spark, [(1, "a")]).limit(0)).count() == 0
    long = " ".join(map(str, range(40)))
    got = {r["doc_id"]: r["text"] for r in phrases.remove_repeated_phrases(frame(spark, [(1, f"a {long} b"), (2, f"c {long}"), (3, None)])).collect()}
    assert got == {1: "a b", 2: "c", 3: ""}


def test_long_texts_and_empty_tables_of_both(spark):
    rng = random.Random(6)
    long = " ".join(rng.choice("abcdefghij") * 3 for _ in range(30_000))
    rows = [(1, long + " x y"), (2, long[1000:60_000]), (3, "x " * 20_000), (4, "no " + long[4 * 20_000 :])]
    assert in_order(phrases.remove_repeated_phrases(frame(spark, rows), digest=True).collect()) == brute_phrases(rows, 35)
    assert in_order(bwt.remove_later_substrings(frame(spark, rows), digest=True).collect()) == brute_later(rows, 100)
    assert bwt.remove_later_substrings(frame(spark, rows).limit(0)).count() == 0


def test_automaton_with_two_symbols():
    passages = {(b"a", b"b"), (b"b", b"c", b"d")}
    for most in (3, 1 << 20):
        a = phrases.PassageAutomaton(passages, most)
        assert sorted(a.located(b"x a b c d b c a".split())) == [(1, 3), (2, 5)]
    assert phrases.PassageAutomaton(set()).located([b"a"]) == []


def settled_by(settle, pieces, ids, starts):
    """Marked (piece, window) of pieces of one anchor that stand in one place each."""
    n = len(pieces)
    which, x, y = settle(pieces, np.zeros(n, np.int64), np.arange(n), np.array(ids), np.array(starts))
    return sorted((w, k) for w, i, j in zip(which.tolist(), x.tolist(), y.tolist()) for k in range(i, j + 1))


def test_only_the_automaton_removes(spark, monkeypatch):
    rows = [(1, "a b c d e f"), (2, "x b c d e y"), (3, "b c d e")]
    assert settled_by(phrases.located_in_pieces(3), [b"a b c d", b"b c d", b"x y z"], [1, 2, 3], [0, 0, 0]) == [(0, 1), (1, 0)]
    assert sum(r["n_removed"] for r in phrases.remove_repeated_phrases(frame(spark, rows), 3).collect()) == 12
    monkeypatch.setattr(phrases.PassageAutomaton, "located", lambda self, words: [])
    assert settled_by(phrases.located_in_pieces(3), [b"a b c d", b"b c d", b"x y z"], [1, 2, 3], [0, 0, 0]) == []


def test_only_intervals_of_the_transform_settle_unlike_texts(monkeypatch):
    pieces = [b"abcdef", b"xbcdeg", b"bcdefz"]
    assert settled_by(bwt.later_in_pieces(3), pieces, [1, 2, 3], [0, 0, 0]) == [(1, 1), (1, 2), (2, 0), (2, 1), (2, 2)]
    monkeypatch.setattr(bwt, "merge", lambda parts, most: (np.concatenate([np.full(len(b), i) for i, (b, _) in enumerate(parts)]), np.zeros(sum(len(b) for b, _ in parts), np.int16)))
    assert settled_by(bwt.later_in_pieces(3), pieces, [1, 2, 3], [0, 0, 0]) == []


def test_long_documents_in_pieces():
    units = recurrence.Units(True, 12, 4, False, 1 << 20)
    rng = np.random.default_rng(0)
    v = rng.integers(0, 5, 5000).astype(np.uint64)
    whole = recurrence.runs_of([v], units)
    assert sum((whole[4] - whole[3] + 1).tolist()) == 5000 - 11


# -- later substrings -------------------------------------------------------------------


def brute_later(rows, length):
    texts = [(-1 if i is None else i, i, (t or "").encode()) for i, t in rows]
    first = {}
    for k, _, t in texts:
        for p in range(len(t) - length + 1):
            g = t[p : p + length]
            first[g] = min(first.get(g, (k, p)), (k, p))
    out = []
    for k, i, t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if first[t[p : p + length]] < (k, p):
                gone[p : p + length] = b"\1" * length
        runs = sum(g and (j == 0 or not gone[j - 1]) for j, g in enumerate(gone))
        out.append((i, len(t), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(t, gone) if not g)).hexdigest()))
    return in_order(out)


@pytest.mark.parametrize("crowd", [2, 256])
def test_later_substrings(spark, monkeypatch, crowd):
    small_parts(monkeypatch, crowd)
    rng = random.Random(crowd)
    rows = repeats(crowd, [rng.choice("abcdé") for _ in range(150)], "", list("0123456789"))
    assert in_order(bwt.remove_later_substrings(frame(spark, rows), 30, digest=True).collect()) == brute_later(rows, 30)


@needs_tables
def test_later_substrings_on_documents(spark):
    rows = [tuple(r) for r in docs_of(spark).select("doc_id", "text").collect()]
    assert in_order(bwt.remove_later_substrings(docs_of(spark), digest=True).collect()) == brute_later(rows, 100)


@pytest.mark.parametrize("part", [60, 400, 1 << 20])
@pytest.mark.parametrize("length", [10, 7, 4])
def test_merged_transforms_find_all_repeats(monkeypatch, part, length):
    monkeypatch.setattr(bwt, "PART", part)
    rng = random.Random(length)
    for _ in range(25):
        base = bytes(rng.choice(b"abc") for _ in range(40))
        texts = [base[a : a + rng.randrange(40)] + bytes(rng.choice(b"abcd") for _ in range(rng.randrange(12))) for a in (rng.randrange(30) for _ in range(rng.randrange(1, 20)))]
        want, got = defaultdict(set), defaultdict(set)
        for i, t in enumerate(texts):
            for o in range(len(t) - length + 1):
                want[t[o : o + length]].add((i, o))
        for i, o, k in zip(*(x.tolist() for x in bwt.repeated_windows(texts, length))):
            got[k].add((i, o))
        assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


@pytest.mark.parametrize("part", [300, 1 << 20])
def test_wide_symbols_find_all_repeats(monkeypatch, part):
    """Symbols of more bytes than a number holds."""
    monkeypatch.setattr(bwt, "PART", part)
    rng = random.Random(part)
    base = bytes(rng.randrange(256) for _ in range(200))
    texts = [base[a : a + rng.randrange(80)] + bytes(rng.choice(b"\0\1") for _ in range(rng.randrange(30))) for a in (rng.randrange(180) for _ in range(60))]
    want, got = defaultdict(set), defaultdict(set)
    for i, t in enumerate(texts):
        for o in range(len(t) - 19):
            want[t[o : o + 20]].add((i, o))
    for i, o, k in zip(*(x.tolist() for x in bwt.repeated_windows(texts, 20))):
        got[k].add((i, o))
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_merge_sorts_only_rows_of_changed_blocks(monkeypatch):
    """Each pass once sorted all rows, also those that no longer move."""
    rng = np.random.default_rng(4)
    texts = [rng.integers(0, 256, 2000).astype(np.uint8).tobytes() for _ in range(3)]
    texts[2] = texts[0][500:900] + texts[2]
    parts = []
    for t in texts:
        s, *_ = bwt.symbols_of([t], 1)
        parts.append((bwt.transform(s.astype(np.int64), 1)[1], 1))
    seen, real = [], bwt.ordered
    monkeypatch.setattr(bwt, "ordered", lambda keys, most: seen.append(len(keys)) or real(keys, most))
    source, prefix = bwt.merge(parts, 100)
    assert len(source) == sum(map(len, texts)) + 3 and prefix.max() == 100
    assert sum(seen) < 20 * len(source)


def test_merge_gives_order_and_common_prefixes():
    texts = [b"banana", b"ananas", b"nab", b"bandana"]
    parts = []
    for t in texts:
        s, *_ = bwt.symbols_of([t], 1)
        parts.append((bwt.transform(s.astype(np.int64), 1)[1].astype(np.int64), 1))
    source, prefix = bwt.merge(parts, 10)
    suffixes = sorted(((t[i:] + b"\0" + bytes([k]), k) for k, t in enumerate(texts) for i in range(len(t) + 1)), key=lambda x: x[0])
    assert source.tolist() == [k for _, k in suffixes]
    common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y or x == 0), 0)
    assert prefix.tolist()[1:] == [common(a, b) for (a, _), (b, _) in zip(suffixes, suffixes[1:])]


# -- fingerprints ----------------------------------------------------------------------------


def brute_groups(prints, ids, radius):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if ((prints[i] ^ prints[j]) & ((1 << 64) - 1)).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    least = {}
    for i, n in enumerate(ids):
        if n is not None:
            least[find(i)] = min(least.get(find(i), n), n)
    return [least.get(find(i)) for i in range(len(prints))]


def test_fingerprint_by_bits():
    import xxhash

    text = "The the cat\tsat on  the mat, Ünder the the cat sat on"
    words = text.replace("T", "t").replace("Ü", "Ü").split()
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.simhash(simhash.shingle_hashes(text.encode())) == want
    assert simhash.simhash(simhash.shingle_hashes(None)) == 0 == simhash.simhash(simhash.shingle_hashes(b" \n"))
    assert simhash.simhash(simhash.shingle_hashes(b"One two")) == xxhash.xxh64_intdigest(b"one two", 42)


@needs_tables
def test_fingerprints_of_documents(spark):
    import xxhash

    lower = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "").encode().split()
    want = {}
    for r in docs_of(spark).collect():
        w = lower(r["text"])
        grams = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        want[r["doc_id"]] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert {r["doc_id"]: r["fp"] % (1 << 64) for r in simhash.fingerprints(docs_of(spark)).collect()} == want


@pytest.mark.parametrize("master, alone", [("local", True), ("local[4]", True), ("local-cluster[3,2,1024]", False), ("spark://host:7077", False), ("yarn", False)])
def test_a_cluster_needs_a_shared_folder(master, alone):
    from types import SimpleNamespace

    from lorekeep.llm import common

    session = SimpleNamespace(sparkContext=SimpleNamespace(master=master))
    if alone:
        assert os.path.isdir(common._local_top(session))
    else:
        with pytest.raises(ValueError):
            common._local_top(session)


def test_bk_trees():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62, 40, dtype=np.uint64)
    values = np.unique(np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 64, 12, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 12, dtype=np.uint64)) for b in base]))
    rng.shuffle(values)
    tree, packed = simhash.BkTree(), simhash.PackedBkTree(values.reshape(-1, 1))
    for v in values.tolist():
        tree.add(v)
    pairs = {(int(q), int(n)) for a, b in packed.within(values.reshape(-1, 1), 4) for q, n in zip(a, b)}
    near = np.bitwise_count(values[:, None] ^ values[None]) <= 4
    assert pairs == set(zip(*(x.tolist() for x in np.nonzero(near))))
    for i, v in enumerate(values.tolist()):
        assert {tree.values[n] for n in tree.within(v, 4)} == set(values[near[i]].tolist())


@needs_tables
def test_components_on_documents(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SLICE", 16)
    rows = [(r["doc_id"], r["text"]) for r in docs_of(spark).collect()] + [(None, None), (7_000, ""), (7_001, None), (None, "alone in the world of words"), (7_002, "x"), (7_002, "x")]
    got = simhash.simhash_components(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    ids, prints = [r["doc_id"] for r in got], [r["fp"] for r in got]
    assert [r["component_id"] for r in got] == brute_groups(prints, ids, 4)
    assert simhash.simhash_components(frame(spark, rows).limit(0)).count() == 0


def test_fingerprint_of_a_long_text(spark):
    long = "One two three four five " * 40_000
    (row,) = simhash.simhash_components(frame(spark, [(1, long)])).collect()
    assert row["fp"] % (1 << 64) == simhash.simhash(simhash.shingle_hashes(long.encode())) != 0


def test_near_duplicates(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, groups = [], {}
    for g in range(60):
        words = [word() for _ in range(300)]
        for c in range(3):
            copy = list(words)
            if c:
                copy[rng.randrange(300)] = word()
            rows.append((3 * g + c, " ".join(copy)))
            groups[3 * g + c] = 3 * g
    rows += [(1000, None), (1001, ""), (None, "no id"), (None, "no id"), (0, "another text of the same id"), (2000, "twice"), (2000, "twice"), (None, "twice")]
    docs = spark.createDataFrame([(*r, "clash", 7) for r in rows], "doc_id long, text string, g_id string, content int")
    kept = simhash.near_duplicates_removed(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([*set(groups.values()), 0, 1000, 2000, None], key=str)
    assert simhash.near_duplicates_removed(frame(spark, rows).limit(0)).count() == 0


def test_near_duplicates_are_verified(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    jaccard = lambda a, b: len(a & b) / len(a | b)
    rows, want = [], set()
    for g in range(40):  # a text and one that shares a start with it: shingle similarity 0.6 to 0.9
        words = [word() for _ in range(300)]
        part = rng.randrange(225, 285)
        other = words[:part] + [word() for _ in range(300 - part)]
        grams = [{tuple(w[i : i + 5]) for i in range(296)} for w in (words, other)]
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(other))]
        want |= {2 * g} if jaccard(*grams) >= 0.8 else {2 * g, 2 * g + 1}
    assert 50 < len(want) < 75
    assert {r["doc_id"] for r in simhash.near_duplicates_removed(frame(spark, rows)).collect()} == want


@needs_tables
@pytest.mark.parametrize("slice_", [8, 4096])
def test_near_duplicates_on_documents(spark, monkeypatch, slice_):
    """What all pairs of texts with a similarity of 0.8 connect, with and without crowded shards."""
    monkeypatch.setattr(simhash, "SLICE", slice_)
    rows = [(r["doc_id"], r["text"]) for r in docs_of(spark).collect()]
    rng = random.Random(1)
    base = " ".join(rng.choice(["aa", "bb", "cc", "dd", "ee", "ff"]) + str(rng.randrange(50)) for _ in range(200))
    for i in range(40):  # a large group of near copies
        words = base.split()
        for _ in range(rng.randrange(5)):
            words[rng.randrange(200)] = f"x{rng.randrange(99)}"
        rows.append((10_000 + i, " ".join(words)))
    lower = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "")
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := lower(t).encode().split()) else set() for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    want = {rows[i][0] for i in range(len(rows)) if find(i) == i}
    assert len(want) < 190 and {r["doc_id"] for r in simhash.near_duplicates_removed(frame(spark, rows)).collect()} == want


def test_crowded_shards_cost_linear_rows(spark, monkeypatch):
    """Thousands of copies whose fingerprints are a few bits from one: few of them search, and all are linked."""
    monkeypatch.setattr(simhash, "SLICE", 500)
    rng = np.random.default_rng(3)
    flips = (np.uint64(1) << rng.permutation(64)[:20].astype(np.uint64))[np.stack([rng.permutation(20)[:4] for _ in range(9000)])]
    flips[rng.random(flips.shape) < 0.3] = 0
    center = np.uint64(0x0123456789ABCDEF)
    prints = np.unique(np.append(center ^ np.bitwise_xor.reduce(flips, axis=1), center))
    one = [int(center) ^ 31, int(center) ^ 0xFFFF_0000_0000]  # 5 and 16 bits away
    table = spark.createDataFrame([(int(v),) for v in np.append(prints, np.array(one, np.uint64)).view(np.int64).tolist()], "fp long")
    links = simhash.link_fingerprints(table).cache()
    assert len(prints) > 2000 and links.count() < 300 * len(prints)
    groups = {r["node"] % (1 << 64): r["component"] for r in components.connected_components(links).collect()}
    assert len({groups[v] for v in prints.tolist()}) == 1 and one[1] not in groups


def test_connected_components(spark):
    rng = random.Random(9)
    links = [(i, i + 1) for i in range(200)] + [(500, 500), (None, 3), (600, 601), (601, 600)] + [(1000, 1000 + rng.randrange(1, 400)) for _ in range(300)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and got[601] == 600 and 500 not in got and {v for k, v in got.items() if k >= 1000} == {1000}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- language model -----------------------------------------------------------------------------


def brute_lm(rows):
    """Counts, buckets, EM and scores of the whole model in plain Python."""
    lower = lambda t: ["<s>", *(w.replace("T", "t") for w in (t or "").split()), "</s>"]
    fold = lambda i: -1 if i is None else zlib.crc32(str(i).encode()) % 10

    def counted(keep):
        pairs, words, docs = Counter(), Counter(), 0
        for i, t in rows:
            if keep(fold(i)):
                w = lower(t)
                docs += 1
                words.update(w[1:])
                pairs.update(zip(w, w[1:]))
        words["<s>"] = docs
        return pairs, words, sum(n for w, n in words.items() if w != "<s>"), sum(w != "<s>" and n > 0 for w, n in words.items())

    def estimates(model, a, b):
        pairs, words, n, v = model
        return [pairs[a, b] / words[a] if words[a] else 0.0, words[b] / n if n else 0.0, 1 / (v + 1)]

    bucket = lambda c: c.bit_length()
    round_ = lambda p: 2 ** (round(4 * math.log2(p)) / 4) if p else 0.0
    kept = counted(lambda f: f not in (0, 1))
    events = defaultdict(Counter)
    for i, t in rows:
        if fold(i) == 1:
            w = lower(t)
            for a, b in zip(w, w[1:]):
                p = estimates(kept, a, b)
                events[bucket(kept[1][a])][round_(p[0]), round_(p[1]), p[2]] += 1
    weights = defaultdict(lambda: [0.4, 0.5, 0.1], {0: [0.0, 0.9, 0.1]})
    for k, seen in events.items():
        x = weights[k]
        for _ in range(60):
            new = [0.0, 0.0, 0.0]
            for p, n in seen.items():
                share = [a * b for a, b in zip(x, p)]
                new = [s + n * a / sum(share) for s, a in zip(new, share)]
            x = [a / sum(new) for a in new]
        weights[k] = x
    final = {}
    for k in {*weights, *range(33)}:
        x = [max(a, b) for a, b in zip(weights[k], (0.0, 1e-6, 1e-6) if events else (0, 0, 0))]
        final[k] = [a / sum(x) for a in x]
    train = counted(lambda f: f != 0)
    out = []
    for _, t in rows:
        w = lower(t)
        out.append(sum(math.log10(sum(a * p for a, p in zip(final[bucket(train[1][x])], estimates(train, x, y)))) for x, y in zip(w, w[1:])))
    return out


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_lm(spark, monkeypatch, levels):
    monkeypatch.setattr(lm, "CHUNK", 2000)
    monkeypatch.setattr(lm, "FAN_OUT", {1: 8, 2: 4, 3: 3}[levels])
    monkeypatch.setattr(lm, "FAN_IN", {1: 512, 2: 4, 3: 2}[levels])
    rng = random.Random(5)
    rows = [(i if rng.random() < 0.95 else None, " ".join(rng.choice(["the", "The", "cat", "sat", "on", "é", "mat" + str(rng.randrange(30))]) for _ in range(rng.randrange(40)))) for i in range(300)]
    rows += [(900, None), (901, ""), (902, "the cat"), (902, "the cat"), (903, "on the mat1 " * 1000)]
    got = lm.score(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    lower = lambda t: [w.replace("T", "t") for w in (t or "").split()] + [None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    counts = Counter(w for i, t in rows if not held(i) for w in lower(t))
    n, v = sum(counts.values()), len(counts)
    close = lambda x: round(x, 4)
    want = in_order((i, held(i), len(lower(t)), sum(counts[w] > 0 for w in lower(t)), n, close(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in lower(t))), close(s)) for (i, t), s in zip(rows, brute_lm(rows)))
    assert in_order((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], close(r["base_score"]), close(r["score"])) for r in got) == want
    assert lm.score(frame(spark, rows).limit(0)).count() == 0


def test_lm_slices_do_not_grow_with_the_corpus():
    """A chunk sends the same slices however many others there are."""
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 56, 200_000, dtype=np.uint64))
    ones = np.ones(len(keys), np.int64)
    slices = list(lm._slices(keys, [ones, ones], 2))
    assert len(slices) <= lm.FAN_OUT and sum(len(p) for _, p in slices) < 6.5 * len(keys)
    shard, data = slices[7]
    own = np.cumsum(lm.unpacked(data, "<u8", "<u4", "<u4")[0], dtype=np.uint64)
    narrow = list(lm._slices(own, [ones[: len(own)]] * 2, 2, shard, 2))
    assert {s // lm.FAN_OUT for s, _ in narrow} == {shard} and sum(len(lm.unpacked(p, "<u8", "<u4", "<u4")[0]) for _, p in narrow) == len(own)


def test_lm_is_a_distribution():
    """Whatever the weights, the words after a context and one unknown word share 1."""
    events = np.array([[3, -4, -20, 50], [3, 1, -30, 5], [0, 1, -12, 9], [3, 1, 1, 2]])
    w = lm.learn_weights(events, 1e-3)
    assert np.allclose(w.sum(axis=1), 1) and (w >= 0).all() and w[0, 0] < 1e-9
    pair, word, v = np.array([3, 5, 0, 0]), np.array([4, 8, 6, 2]), 4
    p = w[3, 0] * pair / pair.sum() + w[3, 1] * word / word.sum() + w[3, 2] / (v + 1)
    assert abs(p.sum() + w[3, 2] / (v + 1) - 1) < 1e-9


def test_lm_prefers_its_language(spark):
    rows = [(i, "the cat sat on the mat") for i in range(200)]
    got = {r["doc_id"]: r["score"] / r["n_tokens"] for r in lm.score(frame(spark, [*rows, (10_000, "mat the on sat cat the")])).collect()}
    assert got[1] > got[10_000]


# -- images ---------------------------------------------------------------------------------------


def test_image_copies(spark):
    rng = np.random.default_rng(2)
    vectors = [rng.normal(size=64).tolist() for _ in range(12)]
    rows = [(10 * i + e, bytearray(media.picture(v, e))) for i, v in enumerate(vectors) for e in (0, 1, 2)]
    rows += [(5, rows[0][1]), (5, rows[0][1]), (900, None), (901, None), (902, bytearray(b"not an image")), (903, bytearray(b"not an image")), (904, bytearray(media.pgm(np.full((90, 90), 7.0)))), (None, rows[3][1])]
    images = spark.createDataFrame([(*r, "clash") for r in rows], "media_id long, media binary, node string")
    got = media.image_copies(images).collect()
    assert len(got) == len(rows)
    group = {r["media_id"]: r["group_id"] for r in got}
    assert all(group[10 * i + e] == 10 * i for i in range(12) for e in (0, 1, 2)) and group[5] == 0 and group[None] == 10
    assert group[900] == 900 and group[901] == 901 and group[902] == group[903] == 902 and group[904] == 904
    assert media.image_copies(images.limit(0)).count() == 0


def test_image_formats():
    import struct

    a = np.arange(12, dtype=np.float64).reshape(3, 4) * 20
    assert (media.gray(media.pgm(a)) == a).all()
    raw = b"".join(b"\0" + bytes(int(x) for x in row) for row in a)
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 3, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    assert (media.gray(png) == a).all()
    for bad in (None, b"", b"P5", b"P5 4 3 255\n12", b"\x89PNG\r\n\x1a\nxx", png[:40]):
        assert media.gray(bad) is None


def test_turned_image_matches():
    image = media.gray(media.picture(np.random.default_rng(1).normal(size=64).tolist(), 0))
    assert media.consensus(media.features(image), media.features(np.rot90(image))) >= 3 * media.INLIERS


def small_edits(image, n):
    """Copies with a little noise each."""
    return [bytearray(media.pgm(image + np.random.default_rng(k).normal(0, 2, image.shape))) for k in range(n)]


def test_all_pairs_of_a_group_are_linked(spark, monkeypatch):
    monkeypatch.setattr(media, "PAIRS_AT_ONCE", 40)
    rows = list(enumerate(small_edits(media.gray(media.picture(np.random.default_rng(3).normal(size=64).tolist(), 0)), 15)))
    got = media.image_copies(spark.createDataFrame(rows, "media_id long, media binary")).collect()
    assert {(r["group_id"], r["n_links"]) for r in got} == {(0, 14)}


def drawn(rng):
    return media.gray(media.picture(rng.normal(size=64).tolist(), 0))


def with_logo(image, logo, y, x):
    a = image.copy()
    a[y : y + 36, x : x + 36] = logo
    return a


EDITS = {
    "noise": lambda a, r: a + r.normal(0, 8, a.shape),
    "crop": lambda a, r: a[20:110, 30:120],
    "half": lambda a, r: a[10:101, 5:96],
    "overlay": lambda a, r: np.where((np.arange(128)[:, None] // 40 == 1) & (np.arange(128) // 64 == 0), 200.0, a),
    "dimmed": lambda a, r: 0.6 * a + 10,
    "smaller": lambda a, r: media.resized(a, 0.7),
    "larger": lambda a, r: media.resized(a, 1.4),
    "turned 5": lambda a, r: media.turned(a, 5),
    "turned 15": lambda a, r: media.turned(a, 15),
    "turned 30": lambda a, r: media.turned(a, 30),
    "quantised": lambda a, r: np.rint(a / 16) * 16,
}


def test_recall_of_edited_copies(spark):
    """Each edit of 30 pictures is found at least 9 times in 10, and unlike pictures stay apart, with a common logo too."""
    rng = np.random.default_rng(4)
    rows, logo = [], 1.5 * (drawn(rng)[:36, :36] - 128) + 128
    names = list(EDITS)
    for i in range(30):
        image = drawn(rng)
        rows += [(100 * i + k, image if k == 0 else EDITS[names[k - 1]](image, rng)) for k in range(len(names) + 1)]
    rows += [(10_000 + i, with_logo(drawn(rng), logo, 40, 70) if i % 2 else with_logo(drawn(rng), logo, *rng.integers(0, 92, 2))) for i in range(200)]
    got = {r["media_id"]: r["group_id"] for r in media.image_copies(spark.createDataFrame([(i, bytearray(media.pgm(a))) for i, a in rows], "media_id long, media binary")).collect()}
    recall = {name: np.mean([got[100 * i + k] == got[100 * i] for i in range(30)]) for k, name in enumerate(names, 1)}
    assert min(recall.values()) >= 0.9, recall
    assert all(g // 100 == i // 100 for i, g in got.items() if i < 10_000)
    assert len({got[i] for i in got if i >= 10_000}) == 200


def test_operator_links_what_brute_force_links(spark):
    rng = np.random.default_rng(5)
    images = []
    for i in range(50):
        image = drawn(rng)
        images += [image, image[15:, 10:], media.turned(image, float(rng.integers(3, 20))), media.resized(image, 0.85)]
    images = [media.gray(media.pgm(a)) for a in images]
    found = [media.features(a) for a in images]
    pairs = [(i, j) for i in range(200) for j in range(i) if media.consensus(found[j], found[i])]
    got = {r["media_id"]: r["group_id"] for r in media.image_copies(spark.createDataFrame([(i, bytearray(media.pgm(a))) for i, a in enumerate(images)], "media_id long, media binary")).collect()}
    assert all(i // 4 == j // 4 for i, j in pairs) and len(pairs) > 200
    assert np.mean([got[i] == got[j] for i, j in pairs]) >= 0.95 and all(g // 4 == i // 4 for i, g in got.items())


@pytest.mark.parametrize("crowd", [4, 1000])
def test_crowded_buckets(spark, monkeypatch, crowd):
    """Copies of one picture, and of another with the same half, in few or many rows of a bucket."""
    monkeypatch.setattr(media, "CROWD", crowd)
    monkeypatch.setattr(media, "BLOCK", 8)
    rng = np.random.default_rng(7)
    one, two = drawn(rng), drawn(rng)
    two[:, :40] = one[:, :40]
    rows = list(enumerate([*small_edits(one, 20), *small_edits(two, 20)]))
    got = media.image_copies(spark.createDataFrame(rows, "media_id long, media binary")).collect()
    assert {r["media_id"]: r["group_id"] for r in got} == {i: i // 20 * 20 for i in range(40)}


def test_large_and_empty_images(spark):
    rng = np.random.default_rng(8)
    large = np.block([[drawn(rng) for _ in range(6)] for _ in range(6)])
    rows = [(1, media.pgm(large)), (2, media.pgm(large[:-90, 50:])), (3, media.pgm(np.zeros((1, 1)))), (4, b"P5 0 0 255\n"), (5, b"")]
    got = {r["media_id"]: r["group_id"] for r in media.image_copies(spark.createDataFrame([(i, bytearray(d)) for i, d in rows], "media_id long, media binary")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


def test_crop_of_a_large_image_matches():
    rng = np.random.default_rng(6)
    draw = lambda: media.gray(media.picture(rng.normal(size=64).tolist(), 0)) - 128
    large = 128 + np.block([[draw() * (0.4 if (y, x) == (2, 1) else 1) for x in range(4)] for y in range(4)])
    assert media.consensus(media.features(large), media.features(large[250:390, 120:260])) >= 2 * media.INLIERS
