"""Batches cut small keep all rows in order, and the rows of a batch decide where it is cut."""

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from gigmatch.llm.workers import cut

ROWS = st.lists(st.tuples(st.one_of(st.none(), st.text(max_size=60)), st.lists(st.integers(0, 9), max_size=4)), max_size=40)


def batch_of(rows) -> pa.RecordBatch:
    texts, lists = [r[0] for r in rows], [r[1] for r in rows]
    return pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int64()), pa.array(texts, pa.string()), pa.array(lists, pa.list_(pa.int64()))], ["n", "text", "list"])


@settings(max_examples=60, deadline=None)
@given(ROWS, st.integers(1, 500), st.integers(0, 10))
def test_cut_keeps_rows(rows, most, skip):
    whole = batch_of(rows)
    for source in (whole, whole.slice(min(skip, len(rows)))):
        got = list(cut(iter([source]), most))
        assert pa.Table.from_batches(got).to_pylist() == source.to_pylist()


def test_cut_by_size():
    rows = [("x" * 100, [])] * 50 + [("y" * 5000, [])] + [(None, [])] * 50
    got = list(cut(iter([batch_of(rows)]), 1000))
    assert len(got) > 5
    assert [g.num_rows for g in got if "y" * 5000 in g.column("text").to_pylist()] == [1]
    assert all(g.nbytes <= 1300 for g in got if "y" * 5000 not in g.column("text").to_pylist())
