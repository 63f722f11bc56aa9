"""Each stage of the pipeline on its own input, against a plain version of it."""

import hashlib
import os
from collections import Counter

import pytest
from test_text_ops import brute_queue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain_groups(rows):
    """The least id of each group that pairs of texts with a shingle similarity of 0.8 connect."""
    lower = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "").encode().split()
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := lower(t)) else set() for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    least = {}
    for g, (i, _) in zip(group, rows):
        least[g] = min(i, least.get(g, i))
    return set(least.values())


def test_stages(spark):
    import corpus_pipeline as p
    from pyspark.sql import functions as F
    from tokenizers import Tokenizer

    from lorekeep.llm import langid, pii
    from lorekeep.llm.queries import vocabulary_path

    stages = dict(p.STAGES)
    assert list(stages) == ["language_id", "near_dedup", "pii", "mixing", "bpe"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    noise = [(900_001, "12 34 -- 56 ½", "en", "web", 13), (900_002, "", "en", "web", 0), (900_003, None, None, "web", None)]
    docs = docs.unionByName(spark.createDataFrame(noise, docs.schema)).cache()
    told = stages["language_id"](spark, docs, SF).cache()
    model = langid.learn(docs.where(~langid.held_out()))
    assert {r["doc_id"] for r in told.collect()} == {r["doc_id"] for r in langid.predict(docs, model).collect() if r["lang_pred"] != "und" and r["score"] >= 0.4}
    assert told.where("doc_id > 900000").isEmpty() and told.count() > 0.97 * (docs.count() - 3)

    single = stages["near_dedup"](spark, told, SF).cache()
    texts = {r["doc_id"]: r["text"] for r in told.collect()}
    assert {r["doc_id"] for r in single.collect()} == plain_groups(sorted(texts.items()))

    clean = stages["pii"](spark, single, SF).cache()
    assert {r["doc_id"]: r["text"] for r in clean.collect()} == {r["doc_id"]: pii.redact(r["text"]) for r in single.collect()}
    assert all(r["n_chars"] == len(r["text"]) for r in clean.collect())

    rows = [(r["doc_id"], r["text"], r["source"]) for r in clean.collect()]
    size = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")
    place = F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), "source", size, F.lit(1))
    places = {(r["doc_id"], r["source"], len(r["text"].encode().split())): r["place"] for r in clean.withColumn("place", place).collect()}
    taken = brute_queue(rows, places)
    mix = stages["mixing"](spark, clean, SF).cache()
    assert Counter(r["doc_id"] for r in mix.collect()) == Counter({i: -(-took // n) for (i, _, n, _), took in taken.items() if took})

    library = Tokenizer.from_file(vocabulary_path())
    library.no_truncation()
    library.no_padding()
    coded = stages["bpe"](spark, mix, SF)
    want = Counter((r["doc_id"], tuple(library.encode(r["text"], add_special_tokens=False).ids)) for r in mix.collect())
    assert Counter((r["doc_id"], tuple(r["token_ids"])) for r in coded.collect()) == want
    assert all(r["ids_sha256"] == hashlib.sha256(" ".join(map(str, r["token_ids"])).encode()).hexdigest() for r in coded.collect())


def test_run_and_empty_tables(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = p.run(spark, SF)
    assert got.columns == ["doc_id", "n_tokens", "token_ids", "ids_sha256", "decoded_sha256"] and got.count() > 150
    for name, stage in p.STAGES:
        nothing = stage(spark, docs.limit(0), SF)
        assert nothing.count() == 0 and (name == "bpe" or nothing.columns == docs.columns)
