"""Three-line windows: SQL on the tables, edge cases by hand."""

import __spark_entry__ as entry
from compare import differences, duck
from edge_rows import ROWS, documents, empty
from rankweave.llm import line_dedup


def test_matches_sql(spark, folder):
    name = "op9_line_dedup"
    assert differences(entry.queries()[name](spark, folder), duck(folder), entry.oracle_sql()[name]) is None


def clean(spark, *texts):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    return {r.doc.doc_id: r.cleaned.text for r in line_dedup.dedup_lines(documents(spark, rows)).collect()}


def test_later_occurrences_go_and_covers_merge(spark):
    got = clean(spark, "a\nb\nc\nd", "x\na\nb\n\nc\nd\ny", "a\nb", "p\nq\nr\np\nq\nr", "z\nz\nz\nz")
    assert got == {0: "a\nb\nc\nd", 1: "x\ny", 2: "a\nb", 3: "p\nq\nr", 4: "z\nz\nz"}


def test_edges(spark):
    docs = documents(spark, clashes=True)
    rows = line_dedup.dedup_lines(docs).collect()
    assert len(rows) == len(ROWS)
    by_id = {(r.doc.doc_id, r.doc.text): r.cleaned for r in rows}
    assert by_id[2, None].text is None and by_id[3, ""].text == ""
    assert by_id[ROWS[9][0], ROWS[9][1]].text == "other\nelse"
    applied = line_dedup.apply(docs)
    assert applied.columns == docs.columns and applied.count() == len(ROWS)
    assert {r.n_chars for r in applied.filter("doc_id = 7").collect()} == {10, 30}
    assert line_dedup.apply(empty(spark)).count() == 0


def test_a_copy_of_earlier_lines_goes_whole(spark):
    rows = [(1, "a\nb\nc", "en", "s", 5), (2, "a\nb\nc", "en", "s", 5), (3, None, "en", "s", 0), (4, " \n ", "en", "s", 0)]
    assert sorted(r.doc_id for r in line_dedup.apply(documents(spark, rows)).collect()) == [1, 3, 4]
