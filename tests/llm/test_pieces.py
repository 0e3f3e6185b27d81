"""Tasks turn Arrow batches into Python objects piece by piece, whatever the batch holds."""

import pyarrow as pa

from farewright.llm import language_id, pseudonyms, shared


def test_all_rows_in_order_in_small_parts():
    texts = ["x" * (5000 + i % 7) if i % 3 else None for i in range(10_000)]
    batch = pa.RecordBatch.from_pydict({"k": pa.array(range(10_000)), "text": pa.array(texts, pa.string())})
    empty = batch.slice(0, 0)
    got = list(shared.pieces(iter([empty, batch, batch.slice(0, 1)])))
    assert [x for b in got for x in b.column(0).to_pylist()] == [*range(10_000), 0]
    assert [x for b in got for x in b.column(1).to_pylist()] == [*texts, texts[0]]
    assert max(b.nbytes for b in got) <= 2 * shared.PIECE_BYTES < batch.nbytes


def test_one_row_larger_than_a_piece():
    batch = pa.RecordBatch.from_pydict({"text": pa.array(["a", "y" * (3 * shared.PIECE_BYTES), "b"])})
    assert [len(x) for b in shared.pieces([batch]) for x in b.column(0).to_pylist()] == [1, 3 * shared.PIECE_BYTES, 1]


def test_operators_send_each_text_once_and_keep_all_rows(spark):
    rows = [(i, f"a line of english text, number {i}, to a@b.example" if i % 5 else None, "en") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    model = language_id.fit(docs)
    judged = language_id.identify(docs, model)
    assert judged.columns == [*docs.columns, "lang_pred", "score", "langs", "lang_fit"]
    assert "whole_text" not in judged._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.doc_id, r.text, r.lang_pred) for r in judged.collect()) == [(i, t, "en" if t else "und") for i, t, _ in rows]
    by_upper = language_id.identify(docs, model, "TEXT")
    assert sorted((r.doc_id, r.lang_pred) for r in by_upper.collect()) == [(i, "en" if t else "und") for i, t, _ in rows]
    made = pseudonyms.pseudonymise(docs, b"k").collect()
    assert sorted(r.doc_id for r in made) == [*range(300)] and all((r.text is None) == (r.doc_id % 5 == 0) for r in made)
