"""Every query of the core against its SQL, and the shape of those that have none."""

import duckdb
import pyarrow as pa
import pytest

from inkplan.operators import layout
from inkplan.plans import queries
from inkplan.plans.convert import convert
from inkplan.plans.queries import ORACLE_SQL, QUERIES
from inkplan.sources import pdf

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    with duckdb.connect() as con:
        for t in TABLES:
            con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
        yield con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    names = sorted(got.columns)
    rows = sorted(repr(tuple(r)) for r in got.select(names).collect())
    assert rows
    if name in ORACLE_SQL:
        want = duck.execute(f"select {', '.join(names)} from ({ORACLE_SQL[name]})").fetchall()
        want = sorted(map(repr, want))
        assert len(rows) == len(want)
        assert [(a, b) for a, b in zip(rows, want, strict=True) if a != b][:3] == []


def rows_of(frame):
    return sorted(repr(tuple(r)) for r in frame.select(sorted(frame.columns)).collect())


def wanted(name, **tables):
    """The rows of a query's SQL over these files, as rows_of() gives those of the query."""
    with duckdb.connect() as con:
        for t, path in tables.items():
            con.execute(f"create view {t} as select * from '{path}'")
        columns = sorted(c for c, *_ in con.execute(f"describe {ORACLE_SQL[name]}").fetchall())
        return sorted(map(repr, con.execute(f"select {', '.join(columns)} from ({ORACLE_SQL[name]})").fetchall()))


def written(path, rows, schema):
    with duckdb.connect() as con:
        con.execute(f"create table t ({schema})")
        con.executemany(f"insert into t values ({', '.join('?' * len(rows[0]))})", rows)
        con.execute(f"copy t to '{path}' (format parquet)")
    return str(path)


def test_sizes_at_halves_of_a_tenth(spark, tmp_path):
    ids = [0, 1, 262144, 524288, 786432, 1835008, 5000000, 5999999, 6029312, 10**12]
    events = written(tmp_path / "events.parquet", [(i, 1.5) for i in ids], "event_id bigint, value double")
    assert rows_of(QUERIES["card_texts"](spark, str(tmp_path))) == wanted("card_texts", events=events)


#: Texts that look like Markdown, begin with spaces, are blank or null.
ODD = [None, "", " ", "\n", "  \n ", " a b", "\n\nx", " \n# y", "- a\n- b", "41. Abc", "a\n12. b", "| a | b |", "a\n| c |", "> q", "```\nx\n```", "+ plus", " the the", "the", "1. ", "#", "# h\nthe text"]


def odd_documents(tmp_path):
    return written(tmp_path / "documents.parquet", [(i, t) for i, t in enumerate(ODD * 11)], "doc_id bigint, text varchar")


def test_paragraphs_of_texts_that_look_like_markdown(spark, tmp_path):
    documents = odd_documents(tmp_path)
    assert rows_of(QUERIES["text_paragraphs"](spark, str(tmp_path))) == wanted("text_paragraphs", documents=documents)
    assert rows_of(QUERIES["render_markdown"](spark, str(tmp_path))) == wanted("render_markdown", documents=documents)


def test_jobs_of_documents_without_text(spark, sf, tmp_path):
    documents = odd_documents(tmp_path)
    for t in ("events", "customer"):
        (tmp_path / f"{t}.parquet").symlink_to(f"{sf}/{t}.parquet")
    got = rows_of(QUERIES["convert_all"](spark, str(tmp_path)))
    assert got == wanted("convert_all", documents=documents, events=f"{sf}/events.parquet", customer=f"{sf}/customer.parquet")


def test_files_come_to_python_in_small_batches(spark, sf):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int32())})

    inputs = queries._pdf_inputs(spark, sf)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    pdf.probe(inputs)
    n = [r[0] for r in inputs.select("doc_id", "content").mapInArrow(sizes, "n int").collect()]
    assert sum(n) == 200 and max(n) <= pdf.FILES_IN_BATCH


def test_inputs_are_made_three_times_at_most(spark, tmp_path):
    """For the PDF reader, for parsers, and for texts with what is not supported; names come along with what is read."""
    log, data = str(tmp_path / "log"), pdf.write_pdf([[("Rain fell.", 12.0, 72.0, 700.0)]])

    def run(batches):
        for batch in batches:
            with open(log, "a") as f:
                f.write("x\n" * batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([data] * batch.num_rows, pa.binary())], ["doc_id", "content"])

    made = spark.range(40).toDF("doc_id").coalesce(1).mapInArrow(run, "doc_id long, content binary")
    rows = convert(made.selectExpr("doc_id", "content", "concat('d', doc_id) as name", "if(startswith(content, X'25504446'), 'pdf', 'text') as format")).select("doc_id", "name", "format", "content").collect()
    assert sorted(map(tuple, rows)) == [(i, f"d{i}", "pdf", "Rain fell.\n") for i in range(40)]
    with open(log) as f:
        assert len(f.readlines()) <= 3 * 40


def test_spans_are_gathered_before_they_are_folded():
    small = [pa.RecordBatch.from_pydict({"n": pa.array([i] * k, pa.int64())}) for i, k in enumerate([0, 64, 0, *[64] * 300, 1])]
    out = list(layout._gathered(iter(small)))
    assert [b.num_rows for b in out] == [8192, 8192, 64 * 301 + 1 - 2 * 8192]
    assert [i for b in out for i in b.column(0).to_pylist()] == [i for b in small for i in b.column(0).to_pylist()]
    assert list(layout._gathered(iter(small[:1]))) == []
