"""BPE, personal data, quality, language ID and mixing, against brute force."""

import hashlib
import os
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lorekeep.llm import bpe, langid, mixing, pii, quality
from lorekeep.llm.queries import vocabulary_path

SF = "/root/testdata/sf0.001"
EDGES = [(1, "a b c", "x"), (2, None, None), (None, "a b", "x"), (3, "", "z"), (1, "a b c", "x"), (4, "q " * 50, None), (5, "\n \t\x0b\x0c\r", "x")]


def frame(spark, rows=EDGES):
    """Rows with clashing extra columns."""
    return spark.createDataFrame([(*r, "clash", 7) for r in rows], "doc_id long, text string, source string, rid string, size int")


# -- BPE ------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path())
    t.no_truncation()
    t.no_padding()
    return t


SAMPLES = ["", "Hello world's don't", "a\x85b\x1cc", "<|endoftext|>hi<|startoftext|> <|ENDOFTEXT|>", "日本語 héÉ ÀÅ Å ½²", "İstanbul ǅ", "\0abc \0! \0\0", "a" * 700 + "zq" * 300, "'''s !!'s 'd'll", "٣٤ Ⅷ １２", "😀😀"]


def agrees(library, text):
    e = library.encode(text, add_special_tokens=False)
    mine = bpe.loaded(vocabulary_path())
    assert mine.encode(text) == e.ids
    assert mine.decode(e.ids) == library.decode(e.ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", SAMPLES)
def test_bpe_equals_library(library, text):
    agrees(library, text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_bpe_equals_library_on_any_text(library, text):
    agrees(library, text)


def test_special_tokens_of_any_shape(library, monkeypatch):
    b = bpe.WordBpe(vocabulary_path())
    b.special = {"[MASK]": 7}
    b.special_pattern = re.compile(r"\[MASK\]")
    assert b.encode("a[MASK]b") == [*b.encode("a"), 7, *b.encode("b")]


def test_long_texts_of_row_operators(spark, library):
    """Texts of a megabyte go through whole."""
    rng = random.Random(9)
    long = " ".join(rng.choice(["The", "cat,", "sat", "on", "mats!", "é#", "\n"]) for _ in range(250_000))
    docs = frame(spark, [(1, long, "a"), (2, "x", "b")])
    (got,) = bpe.encode_documents(docs.where("doc_id = 1"), vocabulary_path(), digests=True).collect()
    ids = library.encode(long, add_special_tokens=False).ids
    assert got["n_tokens"] == len(ids) and got["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    (q,) = quality.quality(docs.where("doc_id = 1")).collect()
    assert q["n_words"] == len(long.encode().split()) and q["n_symbols"] == long.count("#")
    assert {r["doc_id"]: r["size"] for r in mixing.mix(docs).collect()} == {1: len(long.split()), 2: 1}


def test_long_words_merge_alike():
    b = bpe.loaded(vocabulary_path())
    rng = random.Random(4)
    for _ in range(30):
        parts = [b.ids[rng.choice("etaoinsh")] for _ in range(rng.randrange(2, 300))]
        assert b._scan(list(parts)) == b._heap(list(parts))


def test_bpe_frame(spark):
    got = bpe.encode_documents(frame(spark), vocabulary_path(), digests=True).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in EDGES)
    for r in got:
        assert r["n_tokens"] == len(r["token_ids"]) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, r["token_ids"])).encode()).hexdigest()
    assert {r["n_tokens"] for r in got if r["doc_id"] in (2, 3)} == {0}
    back = bpe.decode_documents(bpe.encode_documents(frame(spark), vocabulary_path()), vocabulary_path()).collect()
    assert {r["decoded"] for r in back if r["doc_id"] == 1} == {"a</w> b</w> c</w>"}
    assert bpe.encode_documents(frame(spark).limit(0), vocabulary_path()).count() == 0


# -- personal data ------------------------------------------------------------------

EMAIL, IP, CARD, PHONE = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(t):
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    return {
        "email": [m.span() for m in EMAIL.finditer(t)], "ip": [m.span() for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))],
        "card": [m.span() for m in CARD.finditer(t) if 16 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))], "phone": [m.span() for m in PHONE.finditer(t) if 8 <= len(digits(m[0])) <= 15],
    }


@settings(max_examples=500, deadline=None)
@given(st.text("ab.@-+%(1) 27é0", max_size=50))
def test_plain_spans(text):
    assert pii.plain_spans(text) == brute_spans(text)


DISGUISED = [
    ("mail jane [at] corp (dot) org now", "email", "jane [at] corp (dot) org"), ("jane dot doe at mail dot example dot com", "email", "jane dot doe at mail dot example dot com"),
    ("ｊａｎｅ＠ｃｏｒｐ．ｏｒｇ", "email", "ｊａｎｅ＠ｃｏｒｐ．ｏｒｇ"), ("jаne@cоrp.org x", "email", "jаne@cоrp.org"), ("ja​ne@corp.org", "email", "ja​ne@corp.org"), ("a 1٢٣.0.0.1", "ip", "1٢٣.0.0.1"),
    ("ip 10 dot 0 dot 0 dot 1 ok", "ip", "10 dot 0 dot 0 dot 1"), ("call plus one two three four five six seven eight nine zero", "phone", "plus one two three four five six seven eight nine zero"),
    ("card four one one one one one one one one one one one one one one one", "card", "four one one one one one one one one one one one one one one one"),
]


@pytest.mark.parametrize("text, kind, span", DISGUISED)
def test_disguises_map_back(text, kind, span):
    found = pii.all_spans(text, pii.plain_spans(text))
    assert span in [text[a:b] for a, b in found[kind]]


FEW = [
    ("card 4111 1111 1111 one one 11 ok", "card", "4111 1111 1111 one one 11"), ("card 4111 1111 1111 111 one", "card", "4111 1111 1111 111 one"), ("4111 1111 1111 one one 11 onetime", "card", "4111 1111 1111 one one 11"),
    ("call +1 five five 5-0100 now", "phone", "+1 five five 5-0100"), ("+1 (five five five) 555-0100", "phone", "+1 (five five five) 555-0100"), ("mail john @ example.com.", "email", "john @ example.com"), ("john@ example.com", "email", "john@ example.com"),
]


FEW += [
    ("write john_at_example_dot_com now", "email", "john_at_example_dot_com"), ("jane-at-mail-dot-example-dot-org", "email", "jane-at-mail-dot-example-dot-org"), ("john @ example . com", "email", "john @ example . com"),
    ("host 1 9 2 . 1 6 8 . 0 . 1 up", "ip", "1 9 2 . 1 6 8 . 0 . 1"), ("+1 triple five 555 0100", "phone", "+1 triple five 555 0100"), ("plus one double two three four five six seven eight", "phone", "plus one double two three four five six seven eight"),
    ("tel +4 neun eins fünf 5 5 0 1 0 0", "phone", "+4 neun eins fünf 5 5 0 1 0 0"), ("tel +33 un deux trois quatre cinq six", "phone", "+33 un deux trois quatre cinq six"), ("tel más tres cuatro seis uno dos tres cuatro cinco seis", "phone", "más tres cuatro seis uno dos tres cuatro cinco seis"),
]


@pytest.mark.parametrize("text, kind, span", FEW)
def test_slight_disguises(text, kind, span):
    assert span in [text[a:b] for a, b in pii.all_spans(text, pii.plain_spans(text))[kind]]
    assert f"<{kind}>" in pii.redact(text)


@pytest.mark.parametrize("text", ["2 @ 3.50 each", "hi @some.name", "look_at_this_dot_product", "a list 1 . 2 . 3 of 4", "pay 5 @ home . then go", "he sat @ home. De facto", "met @ work. Us too", "un deux trois", "tres de los cuatro", "triple five", "one two 3 and 4 five", "in 2024 one of 10 - two at most"])
def test_prose_with_digits_stays(text):
    assert pii.redact(text) == text


@pytest.mark.parametrize("text", ["meet at example.com at noon", "seven of nine one two", "привет мир", "a dot in the text", "look at me dot", "one two three go", "the end.", "naïve café"])
def test_clean_text_stays(text):
    assert not any(pii.all_spans(text, pii.plain_spans(text)).values()) and pii.redact(text) == text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["one ", "two-", " at ", " dot ", "[at]", "(dot)", "a@b.c", "x", "1", ".", " ", "＠", "а", "​", "plus ", "+"]), max_size=25))
def test_base_spans_stay(parts):
    text = "".join(parts)
    base = pii.plain_spans(text)
    for kind, spans in pii.all_spans(text, base).items():
        assert set(base[kind]) <= set(spans) and all(0 <= a < b <= len(text) for a, b in spans)


def disguises(rng):
    """Name of a disguise, and one identifier in it."""
    name, host, end = rng.choice(["john", "jane.doe", "m_k", "info7"]), rng.choice(["example", "mail-7", "corp"]), rng.choice(["com", "org", "de", "fr"])
    digits = [rng.choice("123456789") for _ in range(10)]
    word = lambda names, d: names.split()[int(d)]
    languages = {"en": pii._DIGITS_EN, "de": pii._DIGITS_DE, "fr": pii._DIGITS_FR, "es": pii._DIGITS_ES}
    ip = [str(rng.randrange(256)) for _ in range(4)]
    dotted = name.replace(".", " dot ")
    out = {
        "brackets": ("email", f"{name} [at] {host} [dot] {end}"), "words": ("email", f"{dotted} at {host} dot {end}"), "capitals": ("email", f"{name} (AT) {host} (DOT) {end}"),
        "spaced at": ("email", f"{name} @ {host}.{end}"), "spaced": ("email", f"{name} @ {host} . {end}"), "full width": ("email", "".join(chr(ord(c) + 0xFEE0) for c in f"{name}@{host}.{end}")),
        "homoglyphs": ("email", f"{name}@{host}.{end}".replace("o", "о").replace("a", "а").replace("e", "е")), "invisible": ("email", f"{name}@{host}.{end}".replace("@", "\u200b@\u2060")),
        "joined": ("email", f"john_at_{host.replace('-', '')}_dot_{end}"), "ip words": ("ip", " dot ".join(ip)), "ip brackets": ("ip", "[.]".join(ip)), "ip spaced": ("ip", " . ".join(" ".join(p) for p in ip)),
        "ip scripts": ("ip", ".".join(ip).translate({ord(c): chr(0x0660 + int(c)) for c in "0123456789"})), "some spelled": ("phone", "+1 " + " ".join(word(languages["en"], d) if k % 3 == 0 else d for k, d in enumerate(digits))),
    }
    return out | {f"spelled {k}": ("phone", "+1 " + " ".join(word(v, d) for d in digits)) for k, v in languages.items()}


def test_recall_and_precision_of_disguises():
    rng = random.Random(3)
    found, asked = {}, {}
    for _ in range(200):
        for name, (kind, text) in disguises(rng).items():
            line = f"please use {text} today"
            spans = pii.all_spans(line, pii.plain_spans(line))[kind]
            asked[name] = asked.get(name, 0) + 1
            found[name] = found.get(name, 0) + any(a <= 11 and b >= 11 + len(text) for a, b in spans)
    recall = {k: found[k] / asked[k] for k in asked}
    assert min(recall.values()) >= 0.95, recall


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_few_spans_are_added_to_documents(spark):
    """Texts that nobody disguised: what is added to the plain spans stays below one in 200 documents."""
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r["text"]]
    added = sum(sum(map(len, pii.all_spans(t, base).values())) > sum(map(len, base.values())) for t in texts if (base := pii.plain_spans(t)) is not None)
    assert added <= len(texts) / 200


def test_long_runs_are_quick():
    for text in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "+1" * 100_000, "one " * 50_000, "a@" * 100_000, " at " * 50_000, "x dot " * 30_000, "a-at-" * 40_000, "a_dot_" * 30_000, "x . " * 50_000, "@ a . " * 30_000, "1 . " * 50_000, "double " * 30_000, "a@a.a.a" * 20_000):
        pii.all_spans(text, pii.plain_spans(text))


def test_pii_frame(spark):
    rows = [*EDGES, (9, "mail a@b.co or +1 (222) 333-4444", "x")]
    got = pii.find_pii(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    last = next(r for r in got if r["doc_id"] == 9)
    assert last["spans"] == "email:5:11,phone:15:32" and last["base_sha256"] == hashlib.sha256(last["spans"].encode()).hexdigest() and last["n_phone"] == 1
    clean = pii.redact_documents(frame(spark, rows))
    assert clean.columns == frame(spark).columns and clean.where("doc_id = 9").first()["text"] == "mail <email> or <phone>" and clean.where("text is null").count() == 1
    assert pii.find_pii(frame(spark).limit(0)).count() == 0


# -- quality -----------------------------------------------------------------------


def brute_quality(text):
    w = (text or "").encode().split()
    w = [x.decode() for x in w]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    cover = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover)


def test_quality(spark):
    rng = random.Random(1)
    rows = [*EDGES, *[(100 + i, "".join(rng.choice(["a ", "b ", "the ", "é", "\n", "#", "\t", "😀 ", "Aa\n", "|"]) for _ in range(rng.randrange(160))), "x") for i in range(150)]]
    got = {(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in quality.quality(frame(spark, rows)).collect()}
    assert got == {(i, *brute_quality(t)) for i, t, _ in rows}
    judged = quality.quality(frame(spark, rows)).collect()
    assert len(judged) == len(rows)
    for r in judged:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and not (r["base_failed"] and r["kept"])
    assert quality.quality(frame(spark).limit(0)).count() == 0
    plan = quality.quality(frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_quality_keeps_the_clean(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    judged = quality.quality(docs).join(labels, "doc_id")
    assert judged.where("quality = 1 and not base_failed and not kept").count() == 0 and judged.where("quality = 0 and kept").count() == 0


# -- language ID -----------------------------------------------------------------------


def test_language_id(spark):
    words = {"en": "the and of that with which", "de": "der und nicht über schön für", "fr": "les que été français où ça", "el": "και το είναι από"}
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(words[k].split()) for _ in range(rng.randrange(5, 90))), k) for i, k in enumerate(rng.choices(list(words), k=400))]
    docs = spark.createDataFrame([*rows, (900, None, "en"), (901, "12 345 !!", "en"), (902, "", None), (None, "the and of", None)], "doc_id long, text string, lang string")
    model = langid.learn(docs.where(~langid.held_out()))
    got = langid.predict(docs, model, keep=("lang",)).withColumn("held_out", langid.held_out()).collect()
    assert len(got) == 404 and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 400]
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.95
    assert {r["lang_pred"] for r in got if r["doc_id"] in (900, 901, 902)} == {"und"}
    again = langid.learn(docs.where(~langid.held_out()))
    assert (again.embed == model.embed).all() and (again.out == model.out).all()
    kept = langid.keep_identified(docs, model)
    assert kept.columns == docs.columns and 390 < kept.count() <= 401 and kept.where("doc_id >= 900").count() == 0
    assert langid.learn(docs.limit(0)) is None
    assert {r["lang_pred"] for r in langid.predict(docs, None).collect()} == {"und"}


@pytest.mark.parametrize("text,letter", [("½", False), ("² 3", False), ("①", False), ("Ⅷ", False), ("٣", False), ("_", False), ("ª", True), ("12 é", True), ("語", True), ("\u0301", False)])
def test_what_a_letter_is(text, letter):
    assert langid.has_letter(text.encode()) is letter is any(map(str.isalpha, text))


def test_every_label_is_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_TOTAL", 60)
    monkeypatch.setattr(langid, "STEPS", 10)
    rows = [(i, f"words of l{i % 3}", f"l{i % 3}") for i in range(300)] + [(1000, "one of its kind", "rare")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        langid.learn(docs)
    monkeypatch.setattr(langid, "SAMPLE_TOTAL", 80)
    assert langid.learn(docs).languages == ["l0", "l1", "l2", "rare"]


def test_language_of_edges(spark):
    docs = spark.createDataFrame([(1, "½ ① Ⅷ"), (2, "die und das " * 60_000), (2, "die und das " * 60_000), (3, "ab"), (None, None)], "doc_id long, text string")
    model = langid.ByteCnn.fresh(["a", "b"])
    model.out[:] = 0  # a tie
    got = sorted(map(tuple, langid.predict(docs, model).collect()), key=str)
    assert got == [(1, "und", 1.0), (2, "a", 0.5), (2, "a", 0.5), (3, "a", 0.5), (None, "und", 1.0)]
    assert langid.predict(docs.limit(0), model).count() == 0 and langid.keep_identified(docs, model).count() == 3


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_language_id_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.learn(docs.where(~langid.held_out()))
    held = [r for r in langid.predict(docs.where(langid.held_out()), model, keep=("lang",)).collect() if r["lang"] is not None and r["lang_pred"] != "und"]
    assert len(held) > 40 and sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.95


# -- mixing ------------------------------------------------------------------------------


def brute_targets(sizes, share=1.5, most=2.0):
    names = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    budget, full = share * sum(sizes.values()), set()
    while True:
        rest = budget - sum(most * sizes[s] for s in full)
        free = [s for s in names if s not in full]
        level = rest / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if level * weight[s] > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in full else level * weight[s] for s in names}
        full |= over


@pytest.mark.parametrize("seed", range(4))
def test_mixing(spark, seed):
    rng = random.Random(seed)
    names = ["s0", "s1", "S", None, "é", "z" * 9, ""][: 7 - seed]
    rows = [(i if rng.random() < 0.95 else None, " ".join("w" * rng.randrange(1, 4) for _ in range(rng.randrange(12))), rng.choices(names, [50, 9, 3, 5, 1, 4, 2][: len(names)])[0]) for i in range(900)]
    rows += rows[:20] + [(5000, None, "s0"), (5001, "", "empty source")]
    docs = frame(spark, rows)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = brute_targets(sizes)
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    taken = dict.fromkeys(sizes, 0)
    for i, _, s in rows:
        if i is not None:
            assert by_id[i]["source_size"] == sizes[s] and abs(by_id[i]["target"] - want[s]) < 1e-6
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert sum(r["taken"] for r in got) == int(1.5 * sum(sizes.values()))
    for r in got:
        name = next(s for s in sizes if sizes[s] == r["source_size"] and abs(want[s] - r["target"]) < 1e-6)
        taken[name] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 40 for s in sizes)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, mixing.mix(docs.repartition(7)).collect())) == sorted(map(key, got))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and abs(sum(len(r["text"].split()) for r in mixed.collect()) - 1.5 * sum(sizes.values())) < 60
    assert "Python" not in mixing.mix(docs)._jdf.queryExecution().executedPlan().toString()


def brute_queue(rows, places, share=1.5, epochs=2):
    """Words taken of each copy of each row by one queue over all copies in order of finish time."""
    size = lambda t: len((t or "").split())
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    goals = brute_targets(sizes, share, epochs)
    nulls_first = lambda v: (v is not None, v if v is not None else 0)
    queues, copies = {}, []
    for i, t, s in rows:
        queues.setdefault(s, []).append((places[i, s, size(t)], nulls_first(i), size(t), i))
    for s, queue in queues.items():
        before, alike = 0, {}
        for place, _, n, i in sorted(queue, key=lambda q: (q[0] % (1 << 64), *q[1:3])):
            alike[i, n] = copy = alike.get((i, n), 0) + 1
            before += n
            for turn in range(epochs):
                if goals[s] > 0:
                    copies.append(((turn * sizes[s] + before) / goals[s], place, nulls_first(i), s or "", n, turn, copy, (i, s, n)))
    left, taken = int(share * sum(sizes.values())), {}
    for *_, n, turn, copy, key in sorted(copies):
        took = min(n, left)
        left -= took
        taken[*key, copy] = taken.get((*key, copy), 0) + took
    return taken


@pytest.mark.parametrize("seed", range(3))
def test_mixing_is_one_queue(spark, seed, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(mixing, "SLOTS", 8)
    rng = random.Random(seed)
    rows = [(i if rng.random() < 0.97 else None, "w " * rng.choice([0, 1, 3, 9, 40, 3000 * (rng.random() < 0.01)]), rng.choices(["a", "b", "c", None], [60, 5, 2, 9])[0]) for i in range(400)] + [(1000, "w " * 7, "tiny"), (1001, "w " * 20_000, "b")]
    rows += rows[:30]
    docs = frame(spark, rows)
    place = F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), "source", F.size(F.filter(F.split("text", " "), lambda w: w != "")).cast("long"), F.lit(1))
    places = {(r["doc_id"], r["source"], len((r["text"] or "").split())): r["place"] for r in docs.withColumn("place", place).collect()}
    want, got = brute_queue(rows, places), {}
    for r in mixing.mix(docs).collect():
        got.setdefault((r["doc_id"], r["source"], r["size"]), []).append(r["taken"])
    alike = {}
    for (i, s, n, _), took in want.items():
        alike.setdefault((i, s, n), []).append(took)
    assert {k: sorted(v) for k, v in got.items() if any(v)} == {k: sorted(v) for k, v in alike.items() if any(v)}


def test_the_queue_is_sorted_by_one_exchange(spark):
    plan = mixing.mix(frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning(time_slot") == 1 and "Python" not in plan
    above = plan[: plan.index("rangepartitioning(time_slot")]
    assert "Window" in above and above.count("Exchange") == 2  # the queue's own, and that which brings a row's copies together


def test_mixing_edges(spark):
    assert mixing.mix(frame(spark).limit(0)).count() == 0
    got = {(r["doc_id"], r["size"], r["taken"]) for r in mixing.mix(frame(spark, [(1, None, "a"), (2, "", "b")])).collect()}
    assert got == {(1, 0, 0), (2, 0, 0)}
