"""The stages on the smallest tables, and on odd rows."""

import pytest

import corpus_pipeline
from tamarisk.llm import simhash


def test_stages_keep_columns_and_shrink(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).toPandas(), docs.schema)
        assert docs.columns == corpus_pipeline.COLUMNS, name
        assert 0 < docs.count() <= n
        n = docs.count()
    packed = corpus_pipeline.run(spark, sf_dir)
    assert packed.select("doc_id").distinct().count() == n


SCHEMA_ODD = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"long{i} word{i % 977}" for i in range(20_000))
PLAIN = "Anes in erth to the hahe hare, and the ththedth was on to the is in atreing."
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, PLAIN, "en", "a", 76), (3, PLAIN, "en", "a", 76), (None, "Be lyin is thti oned, en tith oningti heoues the thd.", "en", None, 52),
    (4, "12 34 !!", "en", "b", 8), (5, LONG, "en", "b", len(LONG)), (6, PLAIN, "en", "b", 76),
]
#: What each stage keeps of these rows: ids and numbers of rows, and what is done to the rest.
KEPT = {
    "SimHash near-dedup": [1, 3, 4, 5, None],  # the two without a word are one group, and so are the four equal texts
    "substring dedup": [1, 2, 3, 3, 4, 5, 6, None],  # none repeats 35 words
    "benchmark decontamination": [1, 2, 3, 3, 4, 5, 6, None],
}


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_odd_rows(spark, name, stage):
    """Nulls, empty and very long texts, ties, repeated rows, clashing columns and an empty table."""
    docs = spark.createDataFrame(ODD, SCHEMA_ODD).selectExpr("*", "1 as length", "2 as score", "3 as row_key", "4 as fp", "5 as spans", "6 as digest")
    rows = stage(spark, docs, "/root/testdata/sf0.001").collect()
    ids = sorted((r["doc_id"] for r in rows), key=lambda x: (x is None, x))
    if name in KEPT:
        assert ids == KEPT[name]
        texts = {r["doc_id"]: r["text"] for r in rows}
        assert texts[5] == LONG and all(texts[i] == next(o[1] for o in ODD if o[0] == i) for i in texts)
    elif name == "language ID":
        assert not {1, 2, 4} & set(ids)  # no letter
    else:
        lengths = {}
        for r in rows:
            lengths.setdefault((r["doc_id"], r["start"]), []).append(r["length"])
        assert lengths[1, 0] == lengths[2, 0] == [1] and len(lengths[3, 0]) == 2 and sum(x[0] for (i, _), x in lengths.items() if i == 5) > 40_000
    assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def ids_and_texts(rows):
    return sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in rows))


def test_near_dedup_by_brute_force(spark):
    """Null and repeated ids: one row of each group, that with the smallest id."""
    texts = [" ".join(f"w{g}x{i}" for i in range(300)) for g in range(6)]
    rows = [(None, texts[0]), (None, texts[0]), (None, texts[0] + " end"), (4, texts[1]), (None, texts[1]), (4, texts[2]), (2, texts[2]), (-3, texts[3]), (5, texts[3]), (7, texts[4]), (7, texts[4])]
    rows += [(7, texts[5]), (None, None), (None, ""), (8, "a few words"), (None, "some other words"), (9, texts[4] + " end"), (9, texts[5][::-1])]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], SCHEMA)
    prints, group = [simhash.fingerprint(t or "") for _, t in rows], list(range(len(rows)))
    for _ in rows:
        group = [min(group[j] for j, q in enumerate(prints) if (p ^ q).bit_count() <= 4) for p in prints]
    kept = corpus_pipeline.simhash_near_dedup(spark, docs, "/root/testdata/sf0.001").collect()
    expected = {g: min((rows[i][0] is None, rows[i][0] or 0) for i in range(len(rows)) if group[i] == g) for g in set(group)}
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept) == sorted(expected.values())
    assert len({group[rows.index((r["doc_id"], r["text"]))] for r in kept}) == len(kept) == len(expected)


def test_decontamination_by_brute_force(spark):
    """Null and repeated ids: rows that hold an item go, and only these."""
    sf_dir = "/root/testdata/sf0.001"
    items = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").where("text is not null").orderBy("item_id").limit(3).collect()]
    clean = "nothing of this kind is written anywhere in these few lines"
    rows = [(None, f"before {items[0]} after"), (None, clean), (1, items[1]), (1, clean), (1, clean + " again"), (2, items[2]), (2, items[2]), (None, None), (3, None), (None, clean), (None, items[1])]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], SCHEMA)
    kept = corpus_pipeline.benchmark_decontamination(spark, docs, sf_dir).collect()
    held = [{"doc_id": i, "text": t} for i, t in rows if not any(item in (t or "") for item in items)]
    assert ids_and_texts(kept) == ids_and_texts(held)
