"""Content-defined chunks: the arrays against the recurrence, and passages that repeat wherever they stand."""

from __future__ import annotations

import random

import numpy as np

from quarry.llm import chunk_dedup as C


def test_gear_hash_is_the_recurrence():
    buf = np.frombuffer(random.Random(1).randbytes(500), np.uint8)
    h, want = 0, []
    for b in buf.tolist():
        h = (2 * h + int(C._GEAR[b])) & 0xFFFFFFFF
        want.append(h)
    assert C.gear(buf).tolist() == want


def test_chunks_cover_each_text_within_bounds():
    buf = np.frombuffer(random.Random(2).randbytes(4000), np.uint8)
    offsets = np.array([0, 0, 10, 1500, 1500, 4000])
    starts, ends = C.cuts(buf, offsets)
    assert (starts[1:] == ends[:-1]).all() and starts[0] == 0 and ends[-1] == 4000 and set(offsets) <= {*starts.tolist(), 4000}
    assert (ends - starts).max() <= C.MOST and all(e - s >= C.LEAST or e in offsets for s, e in zip(starts, ends, strict=True))


def test_passages_are_found_wherever_they_stand(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvwé") for _ in range(rng.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(51) for _ in range(20)]
    rows = [(k, f"{text(rng.randint(0, 40))} {p} {text(rng.randint(1, 40))}") for k, p in enumerate(passages * 2)]
    rows += [(100 + k, text(200)) for k in range(30)] + [(200, None), (201, ""), (202, rows[5][1]), (202, rows[5][1]), (203, "short line"), (204, "short line"), (None, rows[3][1])]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, id int, start int")
    found = C.repeated_passages(spark, docs)
    got = {r.doc_id: r for r in found.collect()}
    assert all(got[k].repeated for k in range(40)) and all(got[k].removed for k in range(20, 40)) and not any(got[k].removed for k in range(20) if k != 5)
    assert not any(got[k].repeated or got[k].removed for k in [*range(100, 130), 200, 201, 203, 204, None])
    kept = {}
    for r in C.without_spans(docs, found).collect():
        kept[r.doc_id] = r.text
    assert kept[202] is not None and len(kept[202]) < 0.2 * len(rows[5][1]) and kept[200] is None and kept[None] == rows[3][1]
    for k in range(20, 40):
        lost = len(rows[k][1]) - len(kept[k])
        assert 0 < lost <= len(passages[k - 20]) + 2
    assert C.repeated_passages(spark, docs.limit(0)).count() == 0
