import math
import random

import pytest

from locusmill.llm import distinct as D


def test_text_terms_brute_force(spark):
    r = random.Random(0)
    docs = [(i, " ".join(r.choice("abcdefg") for _ in range(r.randrange(0, 30)))) for i in range(40)] + [(100, None), (101, "  ,. "), (102, "Word word WORD"), (103, "x y " * 20_000)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {(r.doc_id, r.term): (r.frequency, r.degree) for r in D.text_terms(df).collect()}
    want = {}
    for i, t in docs:
        w = t.lower().split() if t and t.strip(" ,.") else []
        if not w:
            want[i, None] = (0, 0)
        if i == 103:
            want |= {(i, "x"): (20_000, 1), (i, "y"): (20_000, 1)}
            continue
        for x in set(w):
            near = {w[b] for a in range(len(w)) if w[a] == x for b in range(max(0, a - 3), min(len(w), a + 4)) if w[b] != x}
            want[i, x] = (w.count(x), len(near))
    assert got == want
    s = D.distinctive(D.text_terms(df), ["doc_id"], "term").collect()
    n = len(docs)
    with_ = {x: len({i for i, t in want if t == x}) for _, x in want}
    assert all(r.score == pytest.approx(want[r.doc_id, r.term][1] * math.log(n / with_[r.term])) for r in s)


@pytest.mark.parametrize("few", [1000, 0])
def test_record_terms_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(D, "BROADCAST_ROWS", few)
    r = random.Random(1)
    peaks = [(i, c, 500 * j, 500 * j + 200) for i, (c, j) in enumerate((c, j) for c in ("chr1", "chr2") for j in range(12))]
    frags = [("s", r.choice("xyz"), r.choice(["chr1", "chr2", "chr3"]), s := r.randrange(6000), s + r.randrange(1, 900), r.randrange(1, 4)) for _ in range(150)] + [("s", "lone", "chr9", 1, 2, 1)]
    frags = sorted(set(frags))
    f = spark.createDataFrame(frags, "sample_id string, barcode string, chrom string, start bigint, end bigint, count int")
    p = spark.createDataFrame([(i, c, s, e, "extra") for i, c, s, e in peaks] + [(99, "chr1", None, 5, "x"), (98, "chr1", 9, 9, "x")], "peak_id bigint, chrom string, start bigint, end bigint, barcode string")
    got = {(x.barcode, x.peak_id): (x.weight, x.total, x.n_fragment, x.degree) for x in D.record_terms(f, p, window=1200).collect()}
    want = {}
    for b in ("x", "y", "z"):
        own = [q for q in frags if q[1] == b]
        w = {}
        for i, c, s, e in peaks:
            v = sum(q[5] for q in own if q[2] == c and q[3] < e and q[4] > s)
            if v:
                w[i] = v
        for i, v in w.items():
            deg = sum(1 for j in w if j != i and peaks[j][1] == peaks[i][1] and abs(peaks[j][2] - peaks[i][2]) <= 1200)
            want[b, i] = (v, sum(w.values()), len(own), deg)
    assert {k: v for k, v in got.items() if k[1] is not None} == want
    assert got["lone", None][2] == 1
    assert D.record_terms(f.limit(0), p).count() == 0
    assert D.distinctive(D.record_terms(f.limit(0), p), ["sample_id", "barcode"], "peak_id").count() == 0
