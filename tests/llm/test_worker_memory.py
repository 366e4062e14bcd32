"""What a worker process keeps after a task: the vocabulary of SentencePiece, not what was learned from the task's texts."""

import pyarrow as pa

from wanderlane.llm import pieces


def test_a_worker_keeps_no_units_of_a_finished_task():
    path = pieces.model_path()
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["some words of a text, some words", None])], ["doc_id", "text"])
    first = pa.Table.from_batches(pieces._encode(path)([batch]))
    known = pieces._loaded(path)
    assert first["round_trip"].to_pylist() == [True, True]
    assert not known._units and not known._pair and not known._first and not known._n_pairs
    assert pa.Table.from_batches(pieces._encode(path)([batch])) == first
