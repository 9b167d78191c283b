import hashlib

import numpy as np

from bytesieve.llm import syncmers


def plain_anchors(text):
    """Closed syncmers by definition, from the hashes of single s-mers."""
    codes = np.array([ord(c) for c in text], dtype=np.uint32)
    found = []
    for i in range(len(text) - syncmers.K + 1):
        window = codes[i : i + syncmers.K]
        inner = [syncmers._roll(np.concatenate([window[j : j + syncmers.S], np.zeros(20, np.uint32)]))[0][0] for j in range(15)]
        if min(inner) in (inner[0], inner[-1]):
            found.append(i)
    return found


def test_anchors_by_definition_and_context_free():
    text = "The rain in Spain stays mainly in the plain, é è ü said nobody ever at all."
    at, hashes = syncmers.anchors(text)
    assert at.tolist() == plain_anchors(text) and len(at)
    shifted, again = syncmers.anchors("zz" + text + "more")
    known = dict(zip(shifted.tolist(), again.tolist(), strict=True))
    assert all(known[p + 2] == h for p, h in zip(at.tolist(), hashes.tolist(), strict=True))
    assert syncmers.anchors("short")[0].size == 0


def test_likeness():
    a = "".join(chr(97 + i * i % 26) + str(i) for i in range(500))
    assert syncmers.likeness(syncmers.sketch(a), syncmers.sketch(a)) == 1
    assert syncmers.likeness(syncmers.sketch(a), syncmers.sketch(a[:800] + "x" * 400)) > 0.4
    assert syncmers.likeness(syncmers.sketch(a), syncmers.sketch("other words " * 50)) < 0.1
    assert syncmers.likeness(syncmers.sketch(""), syncmers.sketch("")) == 1
    assert syncmers.likeness(syncmers.sketch(""), syncmers.sketch("x")) == 0


def plain_rows(rows):
    ordered = sorted(rows, key=lambda r: -r[0])
    out = []
    for i, (doc, text) in enumerate(ordered):
        text, other = text or "", ordered[(i + 1) % len(ordered)][1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + other[:third]
        own, changed, following = syncmers.sketch(text), syncmers.sketch(edited), syncmers.sketch(other)
        out.append((
            doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), syncmers.as_string(own), syncmers.as_string(changed),
            syncmers.likeness(own, changed), syncmers.likeness(own, following),
        ))
    return sorted(out)


def test_neighbours_equal_plain_python(spark, small_documents, monkeypatch):
    rows = [(r["doc_id"], r["text"]) for r in small_documents.collect()]
    for run_rows in (7, 1000):
        monkeypatch.setattr(syncmers, "RUN_ROWS", run_rows)
        assert sorted(tuple(r) for r in syncmers.compare_with_edits(small_documents).collect()) == plain_rows(rows)
    for n in (1, 2, 3):
        few = spark.createDataFrame(rows[:n], "doc_id long, text string")
        monkeypatch.setattr(syncmers, "RUN_ROWS", 1)
        assert sorted(tuple(r) for r in syncmers.compare_with_edits(few).collect()) == plain_rows(rows[:n])


def test_odd_rows(odd, nothing, monkeypatch):
    for run_rows in (1, 1000):
        monkeypatch.setattr(syncmers, "RUN_ROWS", run_rows)
        rows = syncmers.compare_with_edits(odd).collect()
        assert len(rows) == 11
        same = {r["fingerprint"] for r in rows if r["doc_id"] in (1, 7)}
        assert len(same) == 1
        alone = next(r for r in rows if r["doc_id"] is None and r["n_chars"] == 10)
        assert alone["edited_sha256"] == hashlib.sha256(b"no id h").hexdigest() and alone["near_next"] == 0
    assert syncmers.compare_with_edits(nothing).collect() == []
    assert syncmers.anchor_table(odd).where("doc_id = 1").count() % 2 == 0
