"""What finished steps leave on disk is given back before the last step."""

import time

import numpy as np
import pytest

from lorekeep.llm import bwt, common, phrases


def shuffled(spark) -> int:
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(k).length() for k in range(files.size()) if files.apply(k).getName().startswith("shuffle_"))


@pytest.mark.parametrize("remove", [bwt.remove_later_substrings, phrases.remove_repeated_phrases])
def test_anchors_and_pieces_are_given_back(spark, tmp_path, monkeypatch, remove):
    for module in (bwt, phrases):
        monkeypatch.setattr(module, "work_folder", lambda spark: str(tmp_path))
    common.release(spark)
    time.sleep(1)
    before = shuffled(spark)
    rng = np.random.default_rng(8)
    texts = [" ".join(map(str, rng.integers(1 << 40, size=300).tolist())) for _ in range(40)]
    left = remove(spark.createDataFrame(list(enumerate(texts + texts)), "doc_id long, text string"))
    for _ in range(40):  # Spark deletes them in the background
        if shuffled(spark) <= before + 4096:
            break
        time.sleep(0.25)
    assert shuffled(spark) <= before + 4096  # the last count's own
    assert sorted(p.name for p in tmp_path.iterdir()) == ["chunks", "found"] and not (tmp_path / "chunks" / "kind=1").exists()
    assert left.where("n_removed > 0").count() >= 40
