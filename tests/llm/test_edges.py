"""Nulls, empty and long texts, ties, repeated rows, empty tables, and further columns with clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from inkplan.llm import decontamination, language_id, license_scan, line_dedup, near_dup, packing, sharding, token_files, toxicity

LONG = "un mot apres l autre " * 20_000
DATA = [
    (1, "Some English words here", "en", "s", 23), (1, "Some English words here", "en", "s", 23), (2, None, "en", "s", None), (3, "", None, None, 0),
    (4, LONG, "fr", None, len(LONG)), (None, "no id at all", None, "s", 3), (None, None, None, None, None), (5, " \n\t ", "en", "s", 4), (6, "12 34 !!", "en", "s", 8), (7, "été́ İ 漢字 <|endoftext|>", "fr", "t", 9),
]
CLASH = ["words", "pos", "term", "rank", "content", "n", "source_", "text_hash", "rid", "label", "bucket", "many", "at", "ids", "host", "comp"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(DATA, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("x") for c in CLASH})


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "un mot apres l autre un mot apres l", "x"), (2, "english WORDS", "x"), (3, None, "x"), (None, "some english", "x"), (4, "--", "x")], "item_id long, text string, win string")


def test_language_id(spark, docs):
    model = language_id.train(docs.select("text", "lang"))
    assert sorted(model) == ["en", "fr"]
    got = {(r["doc_id"], r["text"]): r["p"] for r in docs.select("doc_id", "text", language_id.predict(model, F.col("text")).alias("p")).collect()}
    assert got[(1, DATA[0][1])]["lang_pred"] == "en" and got[(4, LONG)]["lang_pred"] == "fr"
    for key in ((2, None), (3, ""), (5, " \n\t "), (6, "12 34 !!")):
        assert got[key]["lang_pred"] == "und" and got[key]["score"] == 0 and got[key]["rejected"]
    assert language_id.train(docs.limit(0).select("text", "lang")) == {}
    assert docs.select(language_id.predict({}, F.col("text")).alias("p")).where("p.lang_pred = 'und'").count() == len(DATA)


def test_ties(spark):
    """Equal sizes go by name, equal texts have equal results, equally rare words decide nothing."""
    same = {"b": b"the words of a text", "a": b"the words of a text", "c": b"quite other letters xyz"}
    df = spark.createDataFrame([(k, t) for k, t in enumerate(["some words of a text", "some words of a text", "MIT License", "MIT License"])], "doc_id long, text string")
    told = df.select(language_id.predict(same, F.col("text")).alias("p")).collect()
    assert [r["p"]["lang_pred"] for r in told] == ["a"] * 4 and {r["p"]["margin"] for r in told} == {0.0} and told[0]["p"]["rejected"]
    found = {r["doc_id"]: tuple(r)[1:] for r in license_scan.scan(df, license_scan.Index({})).collect()}
    assert found[0] == found[1] and found[2] == found[3] and found[2][5] == "mit"
    model = toxicity.train(df.select("doc_id", "text", (F.col("doc_id") > 1).cast("int").alias("label")), min_docs=1, features=7)
    scores = [r["s"] for r in df.orderBy("doc_id").select(toxicity.score(model, F.col("text")).alias("s")).collect()]
    assert scores[0] == scores[1] < 0.5 < scores[2] == scores[3]
    again = toxicity.train(df.select("doc_id", "text", (F.col("doc_id") > 1).cast("int").alias("label")), min_docs=1, features=7)
    assert again.grams.tolist() == model.grams.tolist()


def test_sharding(docs):
    got = sharding.shard(docs, 3).collect()
    assert sorted(r["size"] for r in got) == sorted(len((d[1] or "").encode()) + 16 for d in DATA)
    assert sorted(sum(r["shard"] == s for r in got) for s in range(3)) == [3, 3, 4]
    assert sharding.shard(docs.limit(0)).count() == 0


def test_license_scan(docs):
    got = license_scan.scan(docs, license_scan.build_index(docs)).collect()
    assert len(got) == len(DATA) and {r["labels"] for r in got} == {""} and {r["first_word"] for r in got} == {None}
    empty = docs.limit(0)
    assert license_scan.scan(empty, license_scan.build_index(empty)).count() == 0


def test_decontamination(docs, items):
    got = decontamination.contamination(docs, items)
    rows = sorted((tuple(r) for r in got.collect()), key=repr)
    assert len(rows) == len(DATA)
    by = {(r[0], r[1]): r for r in rows}
    assert by[(4, 100_000)][2:4] == (99_999, 1)
    assert by[(1, 4)][2:4] == (3, 1)  # the null item_id does not count
    assert by[(2, 0)][2:4] == (0, 0)
    assert decontamination.contamination(docs.limit(0), items).count() == 0
    assert decontamination.contamination(docs, items.limit(0)).where("contaminated or n_items > 0").count() == 0
    kept = decontamination.without_contaminated(docs, items, min_items=1)
    assert kept.columns == docs.columns and kept.count() == len(DATA) - 3


def test_token_files(spark, docs):
    got = [tuple(r) for r in token_files.token_output(spark, docs).orderBy("start").collect()]
    assert [r[0] for r in got] == [None, None, 1, 1, 2, 3, 4, 5, 6, 7]
    assert [r[2] for r in got if r[0] in (2, 3, 5)] == [1, 1, 1]
    at = 0
    for r in got:
        assert r[1] == at
        at += r[2]
    assert token_files.token_output(spark, docs.limit(0)).count() == 0


def test_near_duplicates(docs):
    got = sorted(map(tuple, near_dup.near_duplicates(docs).collect()), key=repr)
    assert got == sorted([(1, 1, 2), (1, 1, 2), (2, 2, 1), (3, 3, 1), (4, 4, 1), (None, None, 1), (None, None, 1), (5, 5, 1), (6, 6, 1), (7, 7, 1)], key=repr)
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0
    kept = near_dup.first_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == len(DATA) - 1


def test_near_duplicates_of_long_texts_in_one_bucket(spark, monkeypatch):
    """A bucket of long texts that are not linked is indexed in blocks of few of them, and all links are found."""
    monkeypatch.setattr(near_dup, "BLOCK_SHINGLES", 50_000)
    common = [f"c{k}" for k in range(6000)]
    own = [[f"o{i}_{k}" for k in range(14_000)] for i in range(12)]
    texts = [" ".join(common + w) for w in own] + [" ".join(common + own[3][:-40]), " ".join(common + own[7][:-40])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(df).collect()}
    assert got == {i: i for i in range(12)} | {12: 3, 13: 7}


def test_line_dedup(spark, docs):
    data = [(i, "s" if i % 2 else None, f"menu\n own line {i}\n\nmenu ") for i in range(10)] + [(10, "s", None), (11, "s", "menu"), (12, "t", "menu")]
    df = spark.createDataFrame(data, "doc_id long, source string, text string").withColumns({c: F.lit("x") for c in [*CLASH, "n_lines", "N_dropped", "line"]})
    cleaned = line_dedup.line_dedup(df, counts=True)
    assert len({c.lower() for c in cleaned.columns}) == len(cleaned.columns) == len(df.columns)
    got = {r["doc_id"]: r for r in cleaned.collect()}
    assert len(got) == len(data)
    assert (got[3]["text"], got[3]["n_lines"], got[3]["n_dropped"]) == (" own line 3\n", 4, 2) and got[4]["text"] == " own line 4\n"
    assert (got[10]["text"], got[10]["n_lines"]) == (None, 0) and got[11]["text"] == "" and got[12]["text"] == "menu"
    assert line_dedup.line_dedup(df.limit(0)).columns == df.columns
    assert line_dedup.line_dedup(docs).count() == len(DATA)


def test_packing(docs):
    got = packing.pack(docs).collect()
    assert sum(r["piece"] == 0 for r in got) == len(DATA)
    assert sum(r["length"] == 1 for r in got) == 4 and max(r["length"] for r in got) == 2048
    assert packing.pack(docs.limit(0)).count() == 0


def test_toxicity(spark, docs):
    model = toxicity.train(docs.select("doc_id", "text", F.when(F.col("doc_id") == 1, 1).when(F.col("doc_id") > 3, 0).alias("label"), "rank"))
    got = docs.select("text", toxicity.score(model, F.col("text")).alias("s")).collect()
    assert len(got) == len(DATA) and all(0 <= r["s"] <= 1 for r in got)
    none = toxicity.train(docs.limit(0).select("doc_id", "text", F.lit(1).alias("label")))
    assert docs.select(toxicity.score(none, F.col("text")).alias("s")).where("s = 0.5").count() == len(DATA)


def test_pipeline(spark, docs, items, tmp_path):
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    for source in (docs, docs.limit(0)):
        df = source
        for name, stage in corpus_pipeline.STAGES:
            df = stage(spark, df, str(tmp_path))
            assert name == "packing" or df.columns == docs.columns
        assert (df.count() > 0) == (source is docs)
