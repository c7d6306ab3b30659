"""The byte network: held-out accuracy, folded tables against the plain network, edge cases."""

from __future__ import annotations

import random

import numpy as np

from gyeol.llm import langid

SAMPLES = {
    "en": "the and that with this from they have been were which would there their what about when people time over such into only other some could them than these".split(),
    "de": "der die und den von das mit sich des auf für ist nicht ein eine auch nach wird bei einer um am sind noch wie einem über einen so zum zur haben".split(),
    "fr": "le de un à être et en avoir que pour dans ce il qui ne sur se pas plus par je avec tout faire son mettre autre on mais nous comme où".split(),
}


def texts(seed, n):
    r = random.Random(seed)
    return [(lang, " ".join(r.choice(SAMPLES[lang]) for _ in range(r.randint(8, 120)))) for lang in SAMPLES for _ in range(n)]


def test_held_out_accuracy(spark):
    train, test = texts(1, 80), texts(2, 60)
    docs = spark.createDataFrame([(i, t, y) for i, (y, t) in enumerate(train)], "doc_id long, text string, lang string")
    net = langid.fit(docs)
    held = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(test)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in langid.identify(held, net).collect()}
    right = sum(got[i]["predicted"] == y for i, (y, _) in enumerate(test))
    assert right >= 0.95 * len(test)
    assert net.languages == ["de", "en", "fr"]


def test_windows_cover_everything():
    for n in (0, 1, 255, 256, 257, 1000, 5000):
        data = np.random.default_rng(n).integers(1, 255, n, dtype=np.uint8)
        win, row, used = langid.windows(data, np.array([0, n]))
        seen = np.zeros(n, bool)
        for k, w in enumerate(win):
            a = k * langid.STRIDE
            assert np.array_equal(w[: used[k]], data[a : a + used[k]]) and not w[used[k] :].any()
            seen[a : a + used[k]] = True
        assert seen.all()


def test_folded_tables_equal_convolution():
    """The pair tables give the filters' responses: position by position, filter by filter."""
    r = np.random.default_rng(1)
    net = langid.train([b"abc def " * 40, b"xyz uvw " * 40], ["a", "b"], steps=5)
    win = r.integers(0, 256, (3, langid.WINDOW), dtype=np.uint8)
    h = []
    for w in win:
        p = w.astype(int)
        z = np.stack([net.first[p[i] << 8 | p[i + 1]] + np.concatenate([np.zeros(langid.FILTERS), net.second[p[i + 2] << 8 | p[i + 3]]]) for i in range(langid.STRIDE)])
        h.append(np.maximum(z.max(axis=0) + net.bias, 0))
    x = np.array(h) @ net.out + net.out_bias
    want = np.exp(x) / np.exp(x).sum(axis=1, keepdims=True)
    assert np.allclose(net.probabilities(win), want, atol=1e-4)


def test_edge_cases(spark):
    rows = [(i, t, y, 1.0) for i, (y, t) in enumerate(texts(3, 30))]
    odd = [(900, None, "en", 1.0), (901, "", None, None), (902, "12345 !!", "fr", 2.0), (903, "le de un être avec " * 30_000, None, 0.0), (None, "the people have been there with them", "en", 0.0), (904, "der die das", None, 0.0), (904, "der die das", None, 0.0)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, confidence double")
    net = langid.fit(docs)
    got = [(r["doc_id"], r["predicted"], r["keep"]) for r in langid.identify(docs, net).where("doc_id >= 900 or doc_id is null").collect()]
    assert sorted(got, key=str) == sorted([(900, None, False), (901, None, False), (902, None, False), (903, "fr", True), (None, "en", True), (904, "de", True), (904, "de", True)], key=str)
    kept = langid.keep_identified(docs, net)
    assert kept.columns == docs.columns and kept.where("doc_id in (900, 901, 902)").count() == 0 and kept.where("doc_id = 904").count() == 2
    empty = docs.where("false")
    none = langid.fit(empty)
    assert langid.identify(empty, net).count() == 0 and [r["keep"] for r in langid.identify(docs.where("doc_id = 904"), none).collect()] == [False, False]
