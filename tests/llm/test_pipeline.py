import random

import corpus_pipeline


def prose(rng, n):
    """The stages put together: every kind of planted row meets the stage meant for it."""
    parts = "the er ing on ti en an re th nd ou ha".split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_stages(spark, tmp_path):
    rng = random.Random(12)
    clean = [prose(rng, 150) for _ in range(120)]
    passage = prose(rng, 70)
    junk = [" ".join(w + "!!" for w in prose(rng, 120).split()) for _ in range(40)]
    texts = [*clean, *junk, clean[0], clean[1], f"{clean[2]} {prose(rng, 3)}", f"{prose(rng, 90)}\n{passage}", f"{prose(rng, 90)}\n{passage}", "short", None]
    rows = [(i, t, "en", "site", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 120), 0) for i in range(160) if i % 2], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name.replace(' ', '-')}")
        docs = spark.read.parquet(f"{tmp_path}/{name.replace(' ', '-')}")
        seen[name] = {r.doc_id: r for r in docs.collect()}
        assert name == "packing" or docs.columns == columns
    good = set(seen["quality rules"])
    assert not good & set(range(120, 160)) and good >= set(range(120)) and not good & {165, 166}
    unlike = set(seen["n-gram Jaccard join"])
    assert unlike >= set(range(120)) and not unlike & {160, 161, 162} and unlike >= {163, 164}
    left = seen["suffix-array dedup"]
    assert passage in left[163].text and passage not in left[164].text and left[5].text == clean[5]
    assert set(seen["packing"]) == set(left)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, key string, _key long, family double"


def run_stages(spark, rows, labels, folder):
    """What each stage leaves, and that all but the last keep the columns, those of clashing names too."""
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    kinds = docs.dtypes
    for name, stage in corpus_pipeline.STAGES:
        done = stage(spark, docs, str(folder))
        done.write.parquet(f"{folder}/{name.replace(' ', '-')}")
        docs = spark.read.parquet(f"{folder}/{name.replace(' ', '-')}")
        assert name == "packing" or docs.dtypes == kinds
        out[name] = docs.collect()
    return out


def test_stages_of_an_empty_table(spark, tmp_path):
    out = run_stages(spark, [], [], tmp_path)
    assert [len(x) for x in out.values()] == [0] * 5


def test_stages_of_odd_rows(spark, tmp_path):
    """Null ids, texts and sources, repeated rows, empty and very long texts, extra columns; no labels at all."""
    rng = random.Random(13)
    a, b, long = prose(rng, 80), prose(rng, 80), prose(rng, 60_000)
    texts = [(1, a), (1, a), (2, a), (3, b), (None, prose(rng, 80)), (None, None), (4, None), (5, ""), (6, long), (7, long + " end"), (8, "one two")]
    rows = [(i, t, None, f"s{n}" if n else None, None, "k", 7, 1.5) for n, (i, t) in enumerate(texts)]
    out = run_stages(spark, rows, [], tmp_path)
    ids = {name: sorted((r.doc_id for r in got), key=str) for name, got in out.items()}
    assert ids["quality rules"] == [1, 1, 2, 3, 6, 7, None] and ids["line dedup"] == ids["quality rules"]
    assert ids["n-gram Jaccard join"] == [1, 1, 3, 6, None] == ids["suffix-array dedup"]
    left = {r.doc_id: r for r in out["suffix-array dedup"]}
    assert left[6].text == long and left[3].text == b and left[1].text == a
    assert left[1]["key"] == "k" and left[1]["_key"] == 7 and left[1].family == 1.5 and left[1].n_chars == len(a)
    assert set(ids["packing"]) == {1, 3, 6, None} and ids["packing"].count(1) == 2
