import numpy as np

from earlog.llm import quality_cnn as q


def seen(monkeypatch, docs, labels, **more):
    """Texts and labels that training hands to the network."""
    got = []
    monkeypatch.setattr(q, "fit", lambda texts, y, *a, **k: got.append((texts, y)))
    q.train(docs, labels, **more)
    return got[0]


def test_training_reads_all_chunks(spark, monkeypatch):
    long = "".join(chr(33 + i % 90) for i in range(20000))
    docs = spark.createDataFrame([(1, long), (2, "short"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, quality int")
    texts, y = seen(monkeypatch, docs, labels)
    assert y == [1, 0, 0] and np.array_equal(texts[0], q.chunks(long.encode())) and len(texts[0]) > 8
    assert np.array_equal(texts[1], q.chunks(b"short")) and not texts[2].any()


def test_repeated_ids_leave_both_labels(spark, monkeypatch):
    docs = spark.createDataFrame([(1, f"copy {i}") for i in range(50)] + [(1, None), (2, "two"), (3, "three")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "doc_id long, quality int")
    texts, y = seen(monkeypatch, docs, labels, docs_each=2)
    assert y == [0, 1, 1] and len(texts) == 3 and texts[0].any()


def test_peaks_in_blocks():
    rng = np.random.default_rng(5)
    net = q.Network(rng.normal(size=(256, q.DIM)), rng.normal(size=(q.WIDTH, q.DIM, q.FILTERS)), np.zeros(q.FILTERS), rng.normal(size=2 * q.FILTERS), 0.)
    c = rng.integers(0, 256, (2 * q.BLOCK + 3, q.CHUNK)).astype(np.uint8)
    raw = q.convolve(c, net.tables())
    where, top = q.peaks(c, net.tables())
    assert np.array_equal(where, raw.argmax(1)) and np.array_equal(top, raw.max(1))
