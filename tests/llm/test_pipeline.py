import random

import pytest

import corpus_pipeline
from narrative_spark.llm import queries, runtime
from narrative_spark.llm.decontaminate import drop_contaminated
from narrative_spark.llm.simhash import keep_one

from .conftest import prose


def test_queries_cover_all_operators():
    import __spark_entry__

    found = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in found) for k in range(1, 11)) and "pipeline" in found
    assert set(queries.QUERIES) <= set(found)


def test_stages(spark, tmp_path):
    r = random.Random(4)
    leak = prose(900, 25)
    rows, labels = [], []
    for k in range(240):
        words = prose(k, 60).split()
        toxic = k % 6 == 0
        if toxic:
            for at in r.sample(range(60), 4):
                words[at] = r.choice(("scoundrel", "blockhead"))
        text = " ".join(words)
        if k % 20 == 1:
            text += " " + leak
        rows.append((k, text, "en" if k % 2 else "de", "s", len(text)))
        labels.append((k, 1, int(toxic)))
    rows += [(1000 + k, rows[2][1], "de", "s", 1) for k in range(5)] + [(2000, None, "en", "s", 0), (2001, "12 34", "en", "s", 5), (2002, "", None, None, None)]
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs, columns = spark.read.parquet(f"{d}/documents.parquet"), None
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        out = stage(spark, docs, d)
        if name != "packing":
            assert out.columns == columns
        out.write.parquet(f"{d}/{name}")
        docs = spark.read.parquet(f"{d}/{name}")
    want = {k for k in range(240) if k % 6 and k % 20 != 1}
    assert {x.doc_id for x in docs.select("doc_id").collect()} == want
    assert {x.doc_id for x in corpus_pipeline.run(spark, d).select("doc_id").collect()} == want


def table_dir(spark, path, rows, labels, items, extra=""):
    full = [(*r[:2], r[2], "s", len(r[1] or ""), *([1, "p", "d"] if extra else [])) for r in rows]
    spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long{extra}").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def staged(spark, path):
    """The rows that each stage keeps."""
    docs, out = spark.read.parquet(f"{path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        made, columns = stage(spark, docs, path), docs.columns
        if name != "packing":
            assert made.columns == columns
        made.write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
        out[name] = docs.collect()
    return out


EXTRA = ", root int, gone_id string, digest string"


def test_stages_of_an_empty_table(spark, tmp_path):
    assert all(rows == [] for rows in staged(spark, table_dir(spark, str(tmp_path), [], [], [], EXTRA)).values())


def test_stages_judge_rows_by_their_text(spark, tmp_path):
    """Rows that share an id, have none, or are very long: nothing is lost but what a stage names; extra columns stay."""
    leak, texts = prose(900, 25), [prose(k, 80) for k in range(60)]
    rows = [(k, t, "en") for k, t in enumerate(texts)]
    rows += [(3, texts[20], "en"), (3, prose(500, 80), "en"), (None, prose(501, 80), "en"), (None, texts[5], None), (4, texts[4], "en")]
    edited = texts[7].split()
    edited[40] = "changed"
    rows += [(200, " ".join(edited), "en"), (201, prose(503, 80) + " " + leak, "en"), (3, leak, "en"), (202, None, "en"), (203, "", "en"), (204, prose(502, 30000), "en")]
    found = staged(spark, table_dir(spark, str(tmp_path), rows, [], [(1, leak)], EXTRA))
    assert len(found["language_id"]) == len(rows) - 2 and len(found["toxicity"]) == len(rows) - 2
    kept = sorted(((str(r.doc_id), r.text) for r in found["near_dedup"]))
    want = [(str(i), t) for i, t, _ in rows if t and t not in (texts[20], texts[5], " ".join(edited))]
    want = sorted(set(want) | {("3", texts[20]), ("5", texts[5])})  # of equal texts the smallest id, of repeated rows one
    assert kept == want
    clean = [x for x in want if leak not in x[1]]
    assert sorted((str(r.doc_id), r.text) for r in found["decontamination"]) == clean
    assert {r.source for r in found["decontamination"]} == {"s"} and {r.gone_id for r in found["decontamination"]} == {"p"}
    packed = found["packing"]
    assert sorted({str(r.doc_id) for r in packed}) == sorted({i for i, _ in clean}) and sum(r.piece == 0 for r in packed) == len(clean)


@pytest.mark.parametrize("small", [0, 400_000])
def test_columns_named_as_inside(spark, monkeypatch, small):
    """Extra columns may have the names that the stages use for their own, in any case, and keep their values."""
    monkeypatch.setattr(runtime, "SMALL", small)
    names = ["gone", "GONE_ID", "gone_text", "_gone_text", "copies_key", "_copies_key", "filter_word", "_word", "_place", "_bits"]
    texts = [prose(1, 80), prose(1, 80), prose(2, 80), prose(3, 80)]
    rows = [(k, t, *([f"x{k}"] * len(names))) for k, t in enumerate(texts)] + [(2, texts[2], *(["x2"] * len(names)))]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, {', '.join(f'{n} string' for n in names)}")
    kept = keep_one(docs)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == [rows[0], rows[2], rows[3]]
    clean = drop_contaminated(docs, spark.createDataFrame([(1, texts[3])], "item_id long, text string"))
    assert clean.columns == docs.columns and sorted(map(tuple, clean.collect())) == sorted([*rows[:3], rows[4]])


def test_near_copies_caught(spark, tmp_path):
    """Recall of the stage at its own setting: copies with a similarity of 0.8 or more by brute force."""
    from narrative_spark.llm import simhash

    from .test_near_and_leaks import brute_groups, near_copies_of

    texts = [t for k in range(60) for t in near_copies_of(k, 200, [0, 1, 2, 3, 4])] + [prose(700 + k, 200) for k in range(100)]
    labels, pairs = brute_groups(texts)
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "").collect()}
    copies = {k for k in range(len(texts)) if labels[k] != k}
    assert len(copies) > 150 and len(kept & copies) <= 0.02 * len(copies) and set(range(len(texts))) - copies <= kept and simhash.RECALL >= 0.95
