"""The operators against plain versions of what they compute."""

import hashlib
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkplan.llm import ann, decontamination, language_id, license_scan, line_dedup, near_dup, packing, queries, sharding, token_files, tokens, toxicity
from inkplan.llm.common import table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


@pytest.fixture(scope="module")
def docs(spark, sf):
    return table(spark, sf, "documents")


@pytest.fixture(scope="module")
def rows(docs):
    return [r.asDict() for r in docs.collect()]


def crc(n):
    return zlib.crc32(str(n).encode())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, sf, name):
    got = queries.QUERIES[name](spark, sf)
    names = sorted(got.columns)
    with duckdb.connect() as con:
        for t in ("documents", "benchmark"):
            con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
        want = con.execute(f"select {', '.join(names)} from ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.select(names).collect())


def test_language_id_is_right_for_held_out_documents(spark, sf, rows):
    got = {r["doc_id"]: r for r in queries.op1_language_id(spark, sf).collect()}
    assert len(got) == len(rows)
    held = [r for r in rows if crc(r["doc_id"]) % 3 == 1]
    assert all(got[r["doc_id"]]["held_out"] == (crc(r["doc_id"]) % 3 == 1) for r in rows)
    right = [got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held]
    assert np.mean(right) >= 0.95


def test_dictionaries_of_few_texts_with_many_copies(spark):
    texts = [f"zq{chr(97 + k // 26)}{chr(97 + k % 26)} " * 5 for k in range(50)]
    copies = spark.range(33_000).select(F.lit(texts[0]).alias("text"), F.lit("en").alias("lang"))
    known = spark.createDataFrame([(t, "en") for t in texts] + [("un texte", "fr")], "text string, lang string").unionByName(copies)
    model = language_id.train(known)
    assert sorted(model) == ["en", "fr"]
    assert {t.split()[0] for t in texts} <= set(model["en"].decode().split())


def plain_dictionaries(known):
    """From (text, lang): the dictionaries of language_id.train, text by text."""
    import xxhash

    by = defaultdict(dict)
    for text, lang in known:
        if text and lang is not None:
            by[lang][(xxhash.xxh64_intdigest(text.encode(), 42) % 2**40)] = text
    out = {}
    for lang, texts in by.items():
        texts = [texts[h] for h in sorted(texts)][: language_id.TRAINING_DOCS]
        n = -(-language_id.DICTIONARY_BYTES // (language_id.PASSAGE * len(texts)))
        own = []
        for t in texts:
            step = len(t) // n
            own.append(t if len(t) <= n * language_id.PASSAGE else " ".join(t[i * step : i * step + language_id.PASSAGE] for i in range(n)))
        out[lang] = plain_letters(" ".join(own))[-language_id.DICTIONARY_BYTES :]
    return out


def plain_letters(text):
    import regex

    return regex.sub(r"\P{L}+", " ", text.lower()).encode()


def plain_language(dictionaries, text):
    import zstandard

    raw, sizes = plain_letters(text or ""), []
    if not raw.strip():
        return "und"
    for lang, d in sorted(dictionaries.items()):
        how = zstandard.ZstdCompressionParameters.from_level(language_id.LEVEL, source_size=language_id.LEAD_BYTES + language_id.PIECE_BYTES, dict_size=len(d), min_match=language_id.MIN_MATCH, write_content_size=False)
        c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how)
        lead = d[-language_id.LEAD_BYTES :]
        sizes.append((sum(len(c.compress(lead + raw[k : k + language_id.PIECE_BYTES])) - len(c.compress(lead)) for k in range(0, len(raw), language_id.PIECE_BYTES)), lang))
    return min(sizes)[1]


def test_language_id_against_plain_compression(spark, sf, rows):
    want = plain_dictionaries([(r["text"], r["lang"]) for r in rows if crc(r["doc_id"]) % 3 != 1])
    known = table(spark, sf, "documents").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1).select("text", "lang")
    assert language_id.train(known) == want
    got = {r["doc_id"]: r["lang_pred"] for r in queries.op1_language_id(spark, sf).collect()}
    assert got == {r["doc_id"]: plain_language(want, r["text"]) for r in rows}


def test_languages_of_texts_without_letters(spark):
    texts = ["½ ²", "① ⅷ Ⅷ", "12.5 %", "\u0301", "_ _", "漢", "ª", "a1b2", " \n", "٣"]
    model = {"en": b"the words of a text", "fr": b"les mots d un texte"}
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r["text"]: r["l"] for r in df.select("text", language_id.predict(model, F.col("text"))["lang_pred"].alias("l")).collect()}
    assert {t for t, lang in got.items() if lang != "und"} == {"漢", "ª", "a1b2"}
    assert set(texts) - {"漢", "ª", "a1b2"} == {t for t in texts if not any(unicodedata.category(c)[0] == "L" for c in t)}


def brute_nearest(rows, k=10):
    good = [(r["vec_id"], np.array(r["embedding"], float)) for r in rows if r["embedding"] and None not in r["embedding"]]
    good = [(i, v) for i, v in good if np.isfinite(v).all() and v.any()]
    out = {}
    for i, v in good:
        if i % 100 == 0:
            out[i] = sorted((float(np.sqrt(((v - x) ** 2).sum())), j) for j, x in good if j != i)[:k]
    return out


def test_nearest_neighbours_recall_and_measure(spark, sf):
    rows = [r.asDict() for r in table(spark, "/root/testdata/sf0.1", "embeddings").collect()]
    want = brute_nearest(rows)
    got = defaultdict(list)
    for r in queries.op2_nearest_neighbours(spark, "/root/testdata/sf0.1").orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    vector = {r["vec_id"]: np.array(r["embedding"], float) for r in rows}
    for q, found in got.items():
        assert found == sorted(found)
        for s, i in found:
            assert s == pytest.approx(float(np.sqrt(((vector[q] - vector[i]) ** 2).sum())), rel=1e-12)
    recall = np.mean([len({i for _, i in got[q]} & {i for _, i in want[q]}) / 10 for q in want])
    assert recall >= 0.9


def test_nearest_neighbours_of_clustered_vectors_take_few_comparisons(spark, monkeypatch):
    """Recall, and rows in visited leaves against all rows, where vectors have clusters."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(100, 32))
    x = centres[rng.integers(0, 100, 20_000)] + 0.15 * rng.normal(size=(20_000, 32))
    rows = [{"vec_id": i, "embedding": v} for i, v in enumerate(x.tolist())]
    want = brute_nearest(rows)
    kept, plan = [], ann.rows_to_visit
    monkeypatch.setattr(ann, "rows_to_visit", lambda *a, **b: kept.append(plan(*a, **b)) or kept[-1])
    df = spark.createDataFrame([(r["vec_id"], r["embedding"]) for r in rows], "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for r in ann.nearest(df, F.col("vec_id") % 100 == 0).collect():
        got[r["query_id"]].add(r["vec_id"])
    assert np.mean([len(got[q] & {i for _, i in want[q]}) / 10 for q in want]) >= 0.9
    assert kept[0][0] < 0.15 * len(rows)


def test_nearest_neighbours_of_other_lengths_and_sizes(spark):
    data = [(0, [1.0, 0.0]), (1, [1.0, 2.0]), (2, [1.0, 0.0, 0.0]), (3, [1.0]), (100, [1.0]), (4, [1e200, 0.0]), (200, [-1e200, 1.0])]
    got = ann.nearest(spark.createDataFrame(data, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0)
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got.collect()) == [(0, 1, 1), (0, 2, 4), (0, 3, 200), (100, 1, 3), (200, 1, 0), (200, 2, 1), (200, 3, 4)]


def test_nearest_neighbours_of_few_and_bad_vectors(spark):
    data = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (7, [0.0, 1.0]), (7, [0.0, 1.0]), (8, None), (9, [0.0, 0.0]), (10, [float("nan"), 1.0]), (11, [None, 1.0]), (None, [1.0, 1.0]), (200, [float("inf"), 1.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in data], "vec_id long, embedding array<float>, rank string")
    got = [tuple(r) for r in ann.nearest(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()]
    assert [(a, b, c) for a, b, c, _ in got] == [(0, 1, 100), (0, 2, 7), (100, 1, 0), (100, 2, 7)]
    assert ann.nearest(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(500)] + [(1000, [1.0, 2.5])], "vec_id long, embedding array<float>")
    got = [r["vec_id"] for r in ann.nearest(same, F.col("vec_id") == 100).orderBy("rank").collect()]
    assert got == list(range(10))


def test_shards_follow_the_law(spark, docs, rows):
    got = sharding.shard(docs).collect()
    assert len(got) == len(rows)
    text = {r["doc_id"]: r["text"] or "" for r in rows}
    for r in got:
        raw = text[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert set(slots) <= set(range(40))
    sizes = [len(slots[s]) for s in range(40)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_shards_keep_groups_together(spark):
    data = [(i, f"text {i % 300}" if i < 3000 else f"own {i}") for i in range(8000)] + [(9000 + i, "hot") for i in range(4000)]
    got = sharding.shard(spark.createDataFrame(data, "doc_id long, text string"), shards=10)
    sizes = Counter(r["shard"] for r in got.select("shard").collect())
    assert sorted(sizes.values()) == [1200] * 10
    cuts = {r["text_crc32"]: r for r in sharding.cut_groups(got).where("n_rows > 1").collect()}
    hot = cuts.pop(zlib.crc32(b"hot"))
    assert hot["n_rows"] == 4000 and hot["n_shards"] <= 6
    assert len(cuts) == 300 and np.mean([r["n_shards"] for r in cuts.values()]) < 1.1
    # rows dealt by a hash of their ids cut nearly every group into most of the shards
    hashed = defaultdict(set)
    for i, text in data[:3000]:
        hashed[text].add(crc(i) % 10)
    assert np.mean([len(x) for x in hashed.values()]) > 5 * np.mean([r["n_shards"] for r in cuts.values()])


def test_license_scan_counts_all_places(spark, docs):
    extra = [
        (10**6, "The MIT license, the mit-license. Apache License 2; GNU general public license. CC  by-NC"),
        (10**6 + 1, "mit mit license license"), (10**6 + 2, None), (10**6 + 3, ""), (10**6 + 4, "Permission is hereby granted, free of charge, to any person obtaining a copy of this SOFTWARE and associated documentation files"),
        (10**6 + 5, "All rights reserved. " * 3000 + "MIT License"),
    ]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    got = {r["doc_id"]: r for r in license_scan.scan(both, license_scan.build_index(both)).collect()}
    for r in both.collect():
        w = words_of(r["text"])
        places, labels = [], set()
        for phrase, label in license_scan.BASE_PHRASES.items():
            p = phrase.split()
            at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        g = got[r["doc_id"]]
        assert (g["n_words"], g["n_base"], g["first_word"], g["last_word"], g["base_labels"]) == (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert labels <= set(g["labels"].split(",")) | set() and 0 <= g["score"] <= 1
    assert got[10**6 + 4]["labels"] == "mit-grant"
    assert got[10**6 + 5]["labels"] == "mit,reserved"


def plain_labels(words, templates):
    """Every template held against every place of the words: labels, and the best share."""
    want, best = set(), 0.0
    for label, text, keys in templates:
        t = words_of(text)
        for s in range(-len(t), len(words) + 1):
            near = [words[max(0, s + i - 2) : max(0, s + i + 3)] for i in range(len(t))]
            share = sum(w in x for w, x in zip(t, near, strict=True)) / len(t)
            around = " " + " ".join(words[max(0, s - 2) : max(0, s + len(t) + 2)]) + " "
            if share >= 0.75 and all(f" {key} " in around for key in keys):
                want.add(label)
                best = max(best, share)
    return want, best


def test_license_templates_are_found_at_all_places():
    rng = random.Random(2)
    templates = [*license_scan.TEMPLATES, ("free", "one two three four two six seven eight", []), ("one", "lonely", [])]
    index = license_scan.Index({"obtaining": 9.0, "copy": 8.0, "associated": 7.0, "three": 6.0, "six": 5.0}, templates=templates)
    mit = words_of(license_scan.TEMPLATES[0][1])
    changed = ["x" if w in ("obtaining", "copy", "associated") else w for w in mit]
    assert index.scan(["x"] * 5 + changed)[4:] == ("mit-grant", (len(mit) - 3) / len(mit))
    labelled = 0
    for k in range(600):
        words = words_of(templates[k % len(templates)][1])
        for _ in range(rng.randint(0, max(5, len(words) // 8))):
            at = rng.randrange(len(words))
            words[at : at + rng.randint(0, 1)] = rng.choice([[], ["x"], [rng.choice(words)]])
            words = words or ["x"]
        words = ["y"] * rng.randint(0, 4) + words + ["y"] * rng.randint(0, 4)
        want, best = plain_labels(words, templates)
        n_base, _, _, base, labels, score = index.scan(words)
        assert set(filter(None, labels.split(","))) == want | set(filter(None, base.split(",")))
        assert score == (1.0 if n_base else best)
        labelled += bool(want)
    assert 100 < labelled < 600


def test_license_labels_of_documents(spark, docs, rows):
    """The labels of whole documents, and IDF values, against plain versions."""
    index = license_scan.build_index(docs)
    seen = Counter(w for r in rows for w in set(words_of(r["text"])))
    assert index.idf == {w: pytest.approx(np.log((len(rows) + 1) / (seen[w] + 1))) for w in index.idf}
    for r in rows:
        if len(words := words_of(r["text"])) < 2000:
            assert set(filter(None, index.scan(words)[4].split(","))) >= plain_labels(words, license_scan.TEMPLATES)[0]


def test_proximity_matches(spark):
    docs = spark.createDataFrame([(1, "x one two three four y"), (2, "one two q three four"), (3, "four three two one"), (4, "one two")], "doc_id long, text string")
    items = spark.createDataFrame([(5, "One two three FOUR")], "item_id long, text string")
    got = {(r["doc_id"], r["kind"]): r["at"] for r in decontamination.matches(docs, items, slop=1).collect()}
    assert got[(1, "exact")] == 1 and (2, "proximity") in got and (4, "proximity") not in got and (4, "exact") not in got
    assert [r["doc_id"] for r in decontamination.matches(docs, items).collect()] == [1]


def test_contamination_without_broadcast_is_the_same(spark, sf, docs, monkeypatch):
    items = table(spark, sf, "benchmark")
    want = sorted(map(tuple, decontamination.contamination(docs, items).collect()))
    monkeypatch.setattr(decontamination, "small", lambda df, rows=0: df)
    assert sorted(map(tuple, decontamination.contamination(docs, items).collect())) == want
    assert sum(r[3] for r in want) > 0


def test_contamination_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = "a b c d e".split()
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 400)))) for i in range(30)]
    items = [(j, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 3, 5, 8, 9, 12])))) for j in range(25)] + [(99, ""), (98, None)]
    got = {r["doc_id"]: r for r in decontamination.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for i, text in docs:
        w, hit, found = words_of(text), set(), set()
        for j, t in items:
            x = words_of(t)
            n = min(8, len(x))
            for a in range(len(x) - n + 1) if n else ():
                for s in range(len(w) - n + 1):
                    if w[s : s + n] == x[a : a + n]:
                        hit |= set(range(s, s + n))
                        found.add(j)
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        assert tuple(got[i])[1:] == (len(w), len(hit), len(found), digest, len(found) >= 2)


def whole_encoding(texts, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_tokenizer())
    return [e.ids + [end] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


TEXT = st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t'sİΣéé́가\xa0\x1f <|endoftext|>")), max_size=60)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, max_size=4))
def test_segments_encode_as_whole_texts(texts):
    encoder = test_segments_encode_as_whole_texts.__dict__.setdefault("encoder", tokens.SegmentEncoder(open(tokens.default_tokenizer(), encoding="utf-8").read()))
    got = [x.tolist() for x in encoder.documents(pa.array(texts, pa.string()), 0)]
    assert got == whole_encoding(texts, 0)


def test_token_files_round_trip(spark, docs, rows):
    rows = sorted(rows, key=lambda r: r["doc_id"])
    want, start = [], 0
    for r, ids in zip(rows, whole_encoding([r["text"] for r in rows], 2), strict=True):
        want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, token_files.token_output(spark, docs).collect())) == want
    full = {r["doc_id"]: r["ids"] for r in token_files.token_output(spark, docs, digest=False).collect()}
    assert [zlib.crc32(np.array(full[w[0]], "<u4").tobytes()) for w in want] == [w[3] for w in want]


def test_token_files_are_in_order_and_split(spark, docs, tmp_path):
    files = token_files.write_token_files(docs, f"file://{tmp_path}/t", file_tokens=5000)
    meta = sorted(files.collect(), key=lambda r: (r["part"], r["seq"]))
    assert len(meta) > 10
    ids = []
    for r in meta:
        with open(r["path"].removeprefix("file://"), "rb") as f:
            ids += token_files.file_documents(f.read())[0]
    assert ids == sorted(ids) and len(ids) == docs.count()
    assert token_files.read_token_files(files, digest=True).count() == docs.count()


@given(st.lists(st.integers(0, 2**32 - 1)))
def test_variable_length_codes_round_trip(values):
    x = np.array(values, np.uint32)
    control, data = token_files.encode_ranks(x)
    assert token_files.decode_ranks(control, data, len(x)).tolist() == values


@settings(deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(0, 40), max_size=30))
def test_plan_packs_all_pieces(counts):
    seen, used = Counter(), defaultdict(list)
    for length, first, pieces, per, sequence, offset in packing.pack_plan(counts, 60):
        assert first == seen[length]
        seen[length] += pieces
        for k in range(pieces):
            used[sequence + k // per].append((offset + k % per * length, length))
    assert seen == Counter({n: c for n, c in counts.items() if c})
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 60
        assert sum(3 * n > 60 for _, n in places) <= 2
    total = sum(n * c for n, c in counts.items())
    assert len(used) <= 2 * -(-total // 60)


def test_packing(spark, docs, rows):
    got = packing.pack(docs).collect()
    ids = {r["doc_id"]: x for r, x in zip(rows, whole_encoding([r["text"] for r in rows], 0), strict=True)}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(ids)
    for doc_id, x in ids.items():
        pieces = sorted(by_doc[doc_id], key=lambda r: r["piece"])
        assert [(r["piece"], r["start"], r["length"]) for r in pieces] == [(k, s, len(x[s : s + 2048])) for k, s in enumerate(range(0, len(x), 2048))]
        assert [r["ids_crc32"] for r in pieces] == [zlib.crc32(np.array(x[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for r in pieces]
    for places in by_sequence.values():
        at = 0
        for r in sorted(places, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    least = -(-sum(map(len, ids.values())) // 2048)
    assert len(by_sequence) <= 1.02 * least + 1


def shingles(text):
    w = words_of(text)
    return near_dup.shingle_list(w) if w else []


def lcs(a, b):
    last = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(row[-1], last[j + 1]))
        last = row
    return last[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=25), st.lists(st.integers(0, 3), max_size=25), st.sampled_from([0.0, 0.3, 0.5, 0.8]))
def test_alignment(a, b, similarity):
    common = lcs(a, b)
    want = common / (len(a) + len(b) - common) if a or b else 0.0
    got = near_dup.aligned(a, b, similarity) if a or b else 0.0
    assert got == (pytest.approx(want) if want >= similarity - 1e-12 else 0.0)


def components(nodes, edges):
    top = {n: n for n in nodes}

    def find(x):
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        top[b] = a
    return {n: find(n) for n in nodes}


def brute_classes(rows):
    own = {r["doc_id"]: shingles(r["text"]) for r in rows}
    by, edges = defaultdict(list), []
    for i, s in own.items():
        for x in set(s):
            by[x].append(i)
    for pair in {tuple(sorted((a, b))) for v in by.values() for a in v for b in v if a < b}:
        a, b = (own[i] for i in pair)
        if 10 * min(len(a), len(b)) >= 8 * max(len(a), len(b)) and near_dup.aligned(a, b, 0.8):
            edges.append(pair)
    return components(own, edges)


def test_near_duplicates_are_those_of_all_pairs(spark, rows, docs):
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(docs).collect()}
    want = brute_classes(rows)
    assert got == want
    assert len(set(want.values())) < len(want)


def test_near_duplicates_in_one_large_group(spark):
    rng = random.Random(5)
    hub = [f"w{rng.randint(0, 500)}" for _ in range(120)]
    data = [(0, " ".join(hub))]
    for i in range(1, 120):  # each close to the hub, few close to each other
        w = list(hub)
        for k in rng.sample(range(120), 2):
            w[k] = f"x{i}_{k}"
        data.append((i, " ".join(w)))
    data += [(1000 + i, " ".join(f"y{i}_{k}" for k in range(50))) for i in range(20)]
    df = spark.createDataFrame(data[::-1], "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(df).collect()}
    assert got == brute_classes([{"doc_id": i, "text": t} for i, t in data])


def test_near_duplicates_of_short_texts(spark):
    rng = random.Random(11)
    texts = []
    for k, (n, more) in enumerate([(8, 1), (9, 1), (12, 2), (24, 5), (44, 10)] * 60):  # shingles at 0.8 or little above
        own = [f"s{k}_{j}" for j in range(n + more)]
        low = rng.randint(0, more)
        texts += [own[low : low + n], own]
    for k in range(20):  # one with a shingle twice, one without
        own = [f"r{k}_{j}" for j in range(30)]
        texts += [own, [*own, *own[:5]]]
    texts += [[f"h{j}" for j in range(9)] + [f"t{k}"] for k in range(40)]  # one bucket, and what only shares a shingle with it
    texts += [[f"h{j}" for j in range(5)] + [f"u{k}_{j}" for j in range(3)] for k in range(40)]
    data = [{"doc_id": i, "text": " ".join(w)} for i, w in enumerate(texts)]
    df = spark.createDataFrame([(r["doc_id"], r["text"]) for r in data], "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(df).collect()}
    want = brute_classes(data)
    assert got == want
    assert all(want[i + 1] == i for i in range(0, 640, 2))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components(spark, edges):
    got = {r["node"]: r["comp"] for r in near_dup.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges for x in e if e[0] != e[1]}
    want = components(nodes, [e for e in edges if e[0] != e[1]])
    assert set(got) == nodes
    assert len({(got[n], want[n]) for n in nodes}) == len(set(got.values())) == len(set(want.values()))


def test_toxicity_against_a_plain_version(spark, sf, rows):
    """n-grams, ratios, features and the scores of a fitted model, text by text."""
    label = {r["doc_id"]: r["toxic"] for r in table(spark, sf, "labels").collect() if r["toxic"] is not None}
    known = [(r["doc_id"], r["text"], label[r["doc_id"]]) for r in rows if r["doc_id"] in label]
    model = toxicity.train(spark.createDataFrame(known, "doc_id long, text string, label int"))

    def own(text):
        t, out = f" {text or ''} ".lower(), set()
        for n in toxicity.LENGTHS:
            for k in range(len(t) - n + 1):
                h = n
                for c in t[k : k + n]:
                    h = (h ^ ord(c)) * 0x01000193 % 2**32
                h = (h ^ h >> 15) * 0x2C1B3C6D % 2**32
                out.add(h >> 32 - toxicity.BITS)
        return out

    found = [(own(t), y) for _, t, y in known]
    yes, no = sum(y for _, y in found), sum(1 - y for _, y in found)
    n_yes, n_no = Counter(g for s, y in found if y for g in s), Counter(g for s, y in found if not y for g in s)
    ratio = {g: np.log((n_yes[g] + 1) / (yes + 2)) - np.log((n_no[g] + 1) / (no + 2)) for g in {*n_yes, *n_no} if n_yes[g] + n_no[g] >= 3}
    telling = {g: abs(x) * np.sqrt(n_yes[g] + n_no[g] * yes / no) for g, x in ratio.items()}
    least = sorted(telling.values(), reverse=True)[: toxicity.FEATURES][-1]
    used = set(model.grams.tolist())
    assert len(used) == min(toxicity.FEATURES, len(ratio)) and {g for g, x in telling.items() if x > least * 1.0001} <= used
    assert min(telling[g] for g in used) >= least * 0.9999
    # the weights are where the penalized loss is least: a step of its gradient changes nothing
    order = model.grams.tolist()
    x = np.array([[ratio[g] * (g in s) for g in order] for s, _ in found])
    y = np.array([y for _, y in found], float)
    w = model.weights / np.array([ratio[g] for g in order])
    p = 1 / (1 + np.exp(-(x @ w + model.bias)))
    assert np.abs(x.T @ (p - y) / len(y) + toxicity.L2 / len(y) * w).max() < 1e-4 and abs((p - y).mean()) < 1e-3
    got = {r["text"]: r["s"] for r in table(spark, sf, "documents").select("text", toxicity.score(model, F.col("text")).alias("s")).collect()}
    weight = dict(zip(order, model.weights.astype(float), strict=True))
    for r in rows:
        if len(r["text"]) < 5000:
            z = sum(weight.get(g, 0.0) for g in own(r["text"])) + model.bias
            assert got[r["text"]] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-4)


def test_fitting_in_chunks_is_the_same(monkeypatch):
    rng = np.random.default_rng(4)
    rows = [np.sort(rng.choice(30, rng.integers(0, 12), replace=False)).astype("<u2") for _ in range(200)]
    y, ratio = rng.integers(0, 2, 200).astype(float), rng.normal(size=30)
    w, b = toxicity._fit(rows, y, ratio)
    monkeypatch.setattr(toxicity, "CHUNK", 17)
    again, c = toxicity._fit(rows, y, ratio)
    assert np.allclose(w, again) and b == pytest.approx(c)


def test_toxicity_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    label = {r["doc_id"]: r["toxic"] for r in table(spark, sf, "labels").collect()}
    got = [r for r in queries.op10_toxicity(spark, sf).collect()]
    assert len(got) == table(spark, sf, "documents").count()
    held = [(r["score"], r["predicted"], label[r["doc_id"]]) for r in got if r["held_out"] and label.get(r["doc_id"]) is not None]
    assert np.mean([p == y for _, p, y in held]) >= 0.98
    yes, no = [s for s, _, y in held if y], [s for s, _, y in held if not y]
    assert np.mean([[a > b for b in no] for a in yes]) >= 0.99


def test_pipeline(spark, sf, rows):
    """Each stage against a plain version of it, stage after stage."""
    import corpus_pipeline

    df = table(spark, sf, "documents")
    columns = df.columns
    now = {r["doc_id"]: r for r in rows}
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, sf)
        got = [r.asDict() for r in df.collect()]
        if name == "packing":
            assert {r["doc_id"] for r in got} == set(now)
            assert sum(r["length"] for r in got) == sum(map(len, whole_encoding([r["text"] for r in now.values()], 0)))
            continue
        assert df.columns == columns
        got = {r["doc_id"]: r for r in got}
        if name == "language id":
            known = [r for r in rows if crc(r["doc_id"]) % 3 != 1]
            c = language_id.Classifier(language_id.train(spark.createDataFrame([(r["text"], r["lang"]) for r in known], "text string, lang string")))
            assert got == {i: r for i, r in now.items() if not c.predict(r["text"])[3]}
            assert len(got) >= 0.98 * len(now)
        elif name == "line dedup":
            pages, on = Counter(r["source"] for r in now.values()), Counter()
            for r in now.values():
                on.update({(r["source"], x.strip(" ")) for x in r["text"].split("\n")})
            for i, r in now.items():
                keep = [x for x in r["text"].split("\n") if not x.strip(" ") or on[r["source"], x.strip(" ")] < 2 or on[r["source"], x.strip(" ")] <= 0.05 * pages[r["source"]]]
                text = "\n".join(keep)
                assert got[i] == r | {"text": text, "n_chars": len(text)}
        elif name == "near dedup":
            classes = brute_classes(list(now.values()))
            assert got == {i: r for i, r in now.items() if classes[i] == i}
            assert len(got) < len(now)
        else:
            items = [words_of(r["text"]) for r in table(spark, sf, "benchmark").collect()]
            wins = defaultdict(set)
            for j, x in enumerate(items):
                for a in range(max(1, len(x) - 7)) if x else ():
                    wins[tuple(x[a : a + 8])].add(j)
            bad = set()
            for i, r in now.items():
                w = words_of(r["text"])
                if any(tuple(w[a : a + n]) in wins for n in {len(x) for x in wins} for a in range(len(w))):
                    bad.add(i)
            assert bad
            assert got == {i: r for i, r in now.items() if i not in bad}
        now = got
        df = spark.createDataFrame([tuple(r[c] for c in columns) for r in got.values()], df.schema)
