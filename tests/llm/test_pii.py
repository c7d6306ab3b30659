"""Personal data: decoding against all segmentations, held-out accuracy, edge cases."""

from __future__ import annotations

import numpy as np
import pytest

from gyeol.llm import pii


@pytest.fixture(scope="module")
def crf():
    return pii.model()


def test_decoding_is_the_best_segmentation(crf):
    raw = "mail a.b@c.de 4111 1111 +1 22"
    x = pii.Island(raw, "")

    def every(at, last, score, out):
        if at == len(x.unit):
            yield score, out
            return
        s = crf._score(x.outside(at), False)[0]
        yield from every(at + 1, 0, score + crf.transition[last, 0] + s, out)
        for j, f in x.candidates(at):
            for y in range(1, len(pii.TYPES)):
                yield from every(j, y, score + crf.transition[last, y] + crf._score(f, True)[y], [*out, (at, j, y)])

    best = max(every(0, 0, 0.0, []), key=lambda p: p[0])
    assert [s[:3] for s in crf.segments(x)] == best[1]


def test_held_out_accuracy(crf):
    right = found = wanted = 0
    for text, spans in pii._examples(250, 99):
        raw = np.frombuffer(text.encode(), np.uint8)
        got = {(s, e, y) for _, s, e, y, _, _ in pii.entities(raw, np.array([0, len(raw)]), crf)}
        gold = set(spans)
        right, found, wanted = right + len(got & gold), found + len(got), wanted + len(gold)
    assert right / found > 0.9 and right / wanted > 0.9


def test_spans(spark, crf):
    long = "plain words without any number " * 40_000
    rows = [
        (1, "Write to jane.doe@example.com or call +1 (555) 123-4567 now", "x", 1), (2, "ünïcode föö host 10.20.30.40, ssn 123-45-6789", None, 2), (3, None, "z", None), (4, "", "t", 4),
        (None, "bob@example.org", "n", 5), (5, long + " visa 4111 1111 1111 1111", "l", 6), (6, "version 1.2.3 of 2024-01-02, page 12", "p", 7), (7, "card 4111111111111111", "d", 8), (7, "card 4111111111111111", "d", 8),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, type string, start int")
    got = pii.find_pii(docs, crf).collect()
    text = {r[0]: r[1] for r in rows}
    assert all(text[r["doc_id"]][r["start"] : r["end"]] == r["span"] for r in got)
    assert sorted((r["doc_id"], r["type"], r["span"]) for r in got) == [
        (1, "EMAIL", "jane.doe@example.com"), (1, "PHONE", "+1 (555) 123-4567"), (2, "IP", "10.20.30.40"), (2, "SSN", "123-45-6789"), (5, "CARD", "4111 1111 1111 1111"), (7, "CARD", "4111111111111111"), (7, "CARD", "4111111111111111"),
    ]
    assert pii.find_pii(docs.where("false"), crf).count() == 0


def test_bank_code_in_capitals():
    crf = pii.model()
    for span in ("GB29 NWBK 6016 1331 9268 19", "GB29NWBK60161331926819", "NL91 ABNA 0417 1643 00", "DE89 3704 0044 0532 0130 00"):
        raw = np.frombuffer(f"please pay to {span} by friday".encode(), np.uint8)
        assert [(x[3], x[4]) for x in pii.entities(raw, np.array([0, len(raw)]), crf)] == [("IBAN", span)]


def test_long_run_of_numbers():
    """One run of 60 KB: memory and time in proportion, and what is in it is found."""
    import random
    import tracemalloc

    r = random.Random(1)
    numbers = " ".join(str(r.randint(0, 99_999)) for _ in range(10_000))
    text = numbers[:30_000] + " mail bob7@example.com, " + numbers[30_000:]
    raw = np.frombuffer(text.encode(), np.uint8)
    crf = pii.model()
    tracemalloc.start()
    found = [x for x in pii.entities(raw, np.array([0, len(raw)]), crf) if x[3] == "EMAIL"]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [x[4] for x in found] == ["bob7@example.com"] and peak < 30e6
