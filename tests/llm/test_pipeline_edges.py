"""The whole pipeline on an empty table and on nulls, empties, repeats and clashing column names."""

import corpus_pipeline
import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, content string, digest string, words int"
LONG = "the quick brown fox jumps over the lazy dog again and " * 3000
ROWS = [(i, f"plain words about topic{i} and more words about thing{i * 7} for the reader of page {i}", "en", f"s{i % 3}", 60, "c", "d", 1) for i in range(30)]
ODD = [
    (100, None, "en", "s1", None, None, None, None), (101, "", None, None, 0, "", "", 0), (102, " \n\t ", "en", "s0", 4, "c", "d", 1), (103, "1234 !!!", "en", "s0", 8, "c", "d", 1),
    (None, "a text without an id but with words enough", "en", None, 40, "c", "d", 1), (None, "a text without an id but with words enough", "en", None, 40, "c", "d", 1),
    ROWS[0], ROWS[0], (104, ROWS[1][1], "en", "s0", 60, "c", "d", 1), (105, LONG, "en", "s2", len(LONG), "c", "d", 1), (106, LONG + "end", "en", "s2", len(LONG) + 3, "c", "d", 1),
]


@pytest.mark.parametrize("rows", [[], ROWS + ODD])
def test_stages_on_odd_tables(spark, tmp_path, rows):
    path = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).repartition(2).write.parquet(f"{path}/documents.parquet")
    docs, kept = spark.read.parquet(f"{path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, path).write.parquet(f"{path}/{name}")
        before, docs = docs, spark.read.parquet(f"{path}/{name}")
        kept[name] = docs.collect()
        if name != "bpe":
            assert docs.columns == before.columns
    texts = {n: [r["text"] for r in found] for n, found in kept.items() if n != "bpe"}
    if not rows:
        assert not any(kept.values())
        return
    assert len(texts["language_id"]) == len(rows) - 4 and all(t and any(map(str.isalpha, t)) for t in texts["language_id"])
    assert sorted(texts["exact_dedup"]) == sorted(set(texts["language_id"]))
    assert {r["doc_id"] for r in kept["exact_dedup"] if r["text"] == ROWS[1][1]} == {104}
    assert sorted(texts["near_dedup"]) == sorted(set(texts["exact_dedup"]) - {LONG + "end"})
    assert len(kept["bpe"]) == len(kept["mixing"]) and all(texts["mixing"].count(t) <= 3 for t in texts["mixing"])
