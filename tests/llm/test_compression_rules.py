import random
import re
import string
from collections import Counter

import zstandard

from earlog.llm import compression_rules as cr
from earlog.llm.queries import op11_compression

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    """Base columns by plain loops."""
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    lines = text.split("\n")
    dup = sum(bool(WORD.search(x)) and x in lines[:i] for i, x in enumerate(lines)) if len(lines) < 4000 else None
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(text.count(c) for c in "#*$%&|<>"),
            "n_dup_lines": dup, "n_repeat_words": len(inside), "base_failed": len(words) < 50 or 100 * len(inside) > 50 * len(words)}


def verdict(text):
    """Whole and chunk ratios by one-shot compression."""
    data = (text or "").encode()
    pack = zstandard.ZstdCompressor(level=cr.LEVEL, write_content_size=False)

    def usual(x):
        low, high = next((lo, hi) for end, lo, hi in cr.LIMITS if end is None or len(x) <= end)
        return low <= (len(pack.compress(x)) / len(x) if x else 0.0) <= high
    bad = sum(len(x) for k in range(0, len(data), cr.CHUNK_BYTES) if not usual(x := data[k:k + cr.CHUNK_BYTES]))
    return usual(data) and bad <= cr.MOST_BAD * len(data)


def check(rows, got):
    for r, text in zip(got, rows):
        want = brute(text)
        for k, v in want.items():
            assert v is None or r[k] == v, (k, r[k], v, (text or "")[:80])
        assert r["kept"] == (not want["base_failed"] and verdict(text))


def test_query(spark, sf, docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = op11_compression(spark, sf).collect()
    assert len(got) == len(texts) and any(r["kept"] for r in got) and any(r["base_failed"] for r in got)
    check([texts[r["doc_id"]] for r in got], got)


def test_crafted(spark):
    rng = random.Random(5)
    few = ["a", "b", "c d", "\x1c", "é", "#*", "<>", "日本"]
    texts = [" ".join(rng.choice(few) + rng.choice(["", "\n", "\t "]) for _ in range(n)) for n in range(0, 160, 3)]
    got = cr.quality_rules(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    check(texts, got)


def test_verdicts(spark):
    rng = random.Random(1)
    syllables = [rng.choice("bdfgklmnprst") + rng.choice("aeiou") + rng.choice(["", "n", "r", "s"]) for _ in range(90)]
    vocabulary = ["".join(rng.choices(syllables, k=rng.randrange(1, 4))) for _ in range(3000)]
    prose = lambda n: " ".join(rng.choice(vocabulary[:rng.choice([40, 400, 3000])]) for _ in range(n))       # noqa: E731
    noise = lambda n: " ".join("".join(rng.choices(string.ascii_letters + string.digits + "+/", k=70)) for _ in range(n))
    rolled = lambda n: " ".join("cheap" * 12 + str(i) for i in range(n))                                     # noqa: E731
    cases = [(prose(60), True), (prose(700), True), (prose(20_000), True), (noise(100), False), (rolled(4000), False),
             (prose(3000) + " " + noise(200), False), (prose(9000) + " " + noise(20), True)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in cr.quality_rules(df).collect()}
    assert [got[i]["kept"] and not got[i]["base_failed"] for i in range(len(cases))] == [k for _, k in cases]
    assert got[5]["zstd_ratio"] < 0.62 and got[5]["n_bad_chunks"] >= 2          # only its chunks tell


def test_repeats_of_large_vocabularies():
    import numpy as np
    ids = np.concatenate([np.arange(1 << 21), [5, 6, 7, 9]])
    assert cr.repeated_words(ids) == 6 and cr.repeated_words(ids[:100]) == 0
    assert cr.repeated_words(np.zeros(4, np.int64)) == 4 and cr.repeated_words(np.zeros(3, np.int64)) == 0


def test_cut_words(monkeypatch):
    text = " ".join(f"w{i % 97}" * (i % 5 + 1) for i in range(900)).encode()
    whole = cr.word_ids(text).tolist()
    monkeypatch.setattr(cr, "STEP", 7)
    assert cr.word_ids(text).tolist() == whole and cr.word_ids(b"x" * 50).tolist() == [0]
    data = b"the quick brown fox " * 40
    assert 0 < cr.Bands().ratio(data) < 0.2


def test_odd(spark, odd_docs):
    clash = odd_docs.selectExpr("*", "1 AS kept", "'x' AS `_text`", "'y' AS `a``b`", "named_struct('p', 1) AS s", "text AS zstd_ratio")
    out = cr.quality_rules(clash)
    got = out.collect()
    assert len(got) == odd_docs.count() and set(out.columns) == set(clash.columns) | set(cr.OUT.fieldNames())
    check([r["text"] for r in got], got)
    assert all(r["base_failed"] and not r["kept"] and r["n_words"] == 0 for r in got if not r["text"])
    assert cr.quality_rules(odd_docs.limit(0)).count() == 0
