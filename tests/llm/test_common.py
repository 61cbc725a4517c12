import pyarrow as pa

from trialscope.llm.common import slices


def test_slices_keep_every_row_and_cut_by_size():
    texts = ["a" * 30, None, "", "b" * 500, "c" * 60, "d" * 60, "e"]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(7)), "text": texts})
    got = list(slices(iter([batch, batch.slice(0, 0)]), most=100))
    assert [x for b in got for x in b.column("text").to_pylist()] == texts
    assert all(sum(len(x or "") for x in b.column("text").to_pylist()[1:]) < 100 for b in got) and len(got) > 2
    lists = pa.RecordBatch.from_pydict({"tokens": [["x"] * 3, [], None, ["y"] * 4]})
    assert [b.num_rows for b in slices(iter([lists]), "tokens", 4)] == [3, 1]
