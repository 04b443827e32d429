"""What a Python worker holds while it encodes a corpus."""

import random
import tracemalloc

import pyarrow as pa

from casemill.llm import pieces_codec
from casemill.llm.queries import MODEL_FILE


def test_a_worker_holds_little_while_it_encodes(spark, monkeypatch):
    """64 MB of Python and NumPy memory before, beside the codec itself, over texts of ever new words; 34 MB now."""
    docs, functions = spark.createDataFrame([], "doc_id long, text string"), []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: functions.append(run))
    pieces_codec.encoded(docs, MODEL_FILE)
    draw = random.Random(5)
    texts = [" ".join("".join(draw.choices("abcdefghijklmnop", k=draw.randrange(3, 40))) for _ in range(100)) for _ in range(2_000)]
    batch = lambda rows: pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(rows)), pa.int64()), "text": pa.array(rows, pa.string())})
    batches = [batch(texts[i : i + 1000]) for i in range(0, len(texts), 1000)]
    assert sum(len(x) for x in texts) > 4_000_000

    def fed():
        tracemalloc.start()  # the codec itself is built
        yield from batches

    try:
        n = [k for out in functions[0](fed()) for k in out.column("n_tokens").to_pylist()]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 48_000_000
    large = pieces_codec.Codec(pieces_codec.Vocabulary.load(MODEL_FILE))
    assert n[::50] == [len(large.encode(t)) for t in texts[::50]]
    again = functions[0](iter([batch([texts[0], None, ""])]))
    assert [x for out in again for x in out.column("token_ids").to_pylist()] == [large.encode(texts[0]).tolist(), None, []]
