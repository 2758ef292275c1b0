import hashlib
from collections import Counter

from earlog.llm import fingerprint as f
from earlog.llm.queries import op2_fingerprint


def counts(b):
    c = Counter((((b[i] << 16 | b[i + 1] << 8 | b[i + 2]) * 2654435761) % 2**32) >> 23 for i in range(len(b) - 2))
    return [c[k] for k in range(f.BUCKETS)]


def test_digest_against_plain_counts(monkeypatch):
    b = bytes((i * i) % 251 for i in range(5000))
    want = counts(b)
    assert f.bucket_counts(b).tolist() == want
    monkeypatch.setattr(f, "STEP", 100)
    assert f.bucket_counts(b).tolist() == want
    cut = sorted(want)[f.BUCKETS // 4 - 1::f.BUCKETS // 4]
    assert f.levels(f.digest(b)).tolist() == [sum(x > q for q in cut[:3]) for x in want]
    for x in (b"", b"a", b"ab", b"abc", b"abcd" * 999):
        assert len(f.digest(x)) == 2 + f.BUCKETS // 2 and f.likeness(f.digest(x), f.digest(x)) == 1.0
        assert 0 <= f.likeness(f.digest(x), f.digest(b)) < 1


def brute(rows):
    rows = sorted(rows, key=lambda r: r[0])
    for (i, t), (_, n) in zip(rows, rows[1:] + rows[:1]):
        cut = len(t) // 4
        e = (t[:len(t) - cut] + n[:cut]).encode()
        yield (i, len(t), hashlib.sha256(e).hexdigest(), d := f.digest(t.encode()), f.digest(e), f.likeness(d, f.digest(e)),
               f.likeness(d, f.digest(n.encode())))


def test_query(spark, sf, docs):
    want = list(brute([tuple(r) for r in docs.select("doc_id", "text").collect()]))
    got = [tuple(r) for r in op2_fingerprint(spark, sf).collect()]
    assert sorted(got) == sorted(want)
    assert sum(r[5] for r in got) / len(got) > sum(r[6] for r in got) / len(got) + 0.05


def test_odd(spark, odd_docs):
    got = f.edited_fingerprints(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert [r["n_chars"] for r in got if r["doc_id"] == 0] == [0]
    one = f.edited_fingerprints(odd_docs.where("doc_id = 3")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert f.edited_fingerprints(odd_docs.limit(0)).count() == 0
    assert f.fingerprint(odd_docs, out="key").columns.count("key") == 1
