"""Noun extraction against sequential simulations in plain Python."""

from __future__ import annotations

import random

import pytest

from gyeol.operators import nouns as n

POS, NEG = {"는", "를", "의", "에서", "로"}, {"다", "고", "는", "한다"}
COMMON = POS & NEG


def feats(spark):
    one = lambda words: spark.createDataFrame([(w,) for w in sorted(words)], "feature string")
    return n.features(one(POS), one(NEG))


def table(spark, d):
    return spark.createDataFrame(sorted(d.items()), "eojeol string, count long")


def corpus(seed):
    r = random.Random(seed)
    heads = ["".join(r.choice("가나다라마") for _ in range(r.randint(1, 4))) for _ in range(14)]
    tails = ["", "는", "를", "의", "에서", "로", "다", "고", "한다", "장", "도"]
    out = {}
    for _ in range(220):
        w = r.choice(heads) + r.choice(tails)
        out[w] = out.get(w, 0) + r.randint(1, 9)
    return out


class Simulated:
    """Longest words first, each taking its eojeols away before the next is scored."""

    def __init__(self, counts):
        self.pos, self.neg = POS - COMMON, NEG - COMMON
        self.left = dict(counts)

    def rs(self, word):
        return {e[len(word) :]: c for e, c in self.left.items() if e.startswith(word) and len(e) - len(word) <= 9 and len(word) <= 10}

    def longer(self, word, r, kind):
        return any(word[i:] + r in kind for i in range(len(word)))

    def predict(self, word, least):
        t = dict.fromkeys(("pos", "common", "neg", "unk", "end"), 0)
        own, first = 0, set()
        for r, c in self.rs(word).items():
            if not r:
                t["end"] += c
                continue
            p, m = self.longer(word, r, self.pos), self.longer(word, r, self.neg)
            own += (r in self.pos and not p) or (r in self.neg and not m)
            if not (r in self.pos or r in COMMON) or not p:
                first.add(r[0])
            if not p and not m:
                t["common" if r in COMMON else "pos" if r in self.pos else "neg" if r in self.neg else "unk"] += c
        total, base = sum(t.values()), t["pos"] + t["neg"]
        score = (t["pos"] - t["neg"]) / base if base else 0.0
        support = (t["pos"] if score >= least else t["neg"]) + t["end"] + t["common"]
        good = t["pos"] + t["common"] + t["end"]
        if own > 1 or (total and t["end"] > 30 and t["pos"] >= t["neg"]):
            return support, score
        if total and (((t["common"] or t["pos"]) and t["end"] / total >= 0.3 and t["common"] >= t["neg"]) or len(first) >= 2):
            return good, good / total
        return support, 0.0

    def run(self, least=0.3):
        cand = {e[:i] for e in self.left for i in range(1, min(len(e), 10) + 1) if e[i:] in self.pos}
        out = {}
        for word in sorted(cand, key=lambda w: (-len(w), w)):
            out[word] = self.predict(word, least)
            if out[word][1] >= least:
                for r in self.rs(word):
                    del self.left[word + r]
        return out


@pytest.mark.parametrize("seed", [1, 2])
def test_rounds_equal_one_by_one(spark, seed):
    counts = corpus(seed)
    sim = Simulated(counts)
    want = sim.run()
    scored, rest = n.predict_longest_first(table(spark, counts), feats(spark))
    got = {r["l"]: (r["support"], r["score"]) for r in scored.collect()}
    assert got.keys() == want.keys()
    assert all(got[w][0] == want[w][0] and abs(got[w][1] - want[w][1]) < 1e-9 for w in want)
    assert {r["eojeol"]: r["count"] for r in rest.collect()} == sim.left


def test_derived_prediction(spark):
    f = n.features(spark.createDataFrame([("를",), ("의",), ("는",)], "feature string"), spark.createDataFrame([("는",)], "feature string"))
    c = table(spark, {"학교는": 5, "학교를": 4, "학교": 3})
    r = n.predict(n._splits(n.marked(c, f), 10, 9).where("l = '학교'"), f).first()
    assert (r["pos"], r["common"], r["neg"], r["unk"], r["end"], r["support"], r["score"]) == (4, 5, 0, 0, 3, 12, 1.0)


def test_compounds_and_filters(spark):
    f = feats(spark)
    c = table(spark, {"데이터센터": 4, "데이터센터의": 3, "데이터": 9, "센터": 9})
    scored = spark.createDataFrame([("데이터", 9, 1.0), ("센터", 9, 0.8)], "l string, support long, score double")
    got = [(r["noun"], r["parts"], r["frequency"], r["score"]) for r in n.compounds(c, scored, f).collect()]
    assert got == [("데이터센터", ["데이터", "센터"], 7, 1.0)]
    nouns = spark.createDataFrame([("학교", 50, 1.0), ("학교에서", 5, 1.0), ("학교로", 5, 0.5), ("에서", 3, 1.0), ("는", 1, 1.0)], "noun string, frequency long, score double")
    assert {r["noun"] for r in n.detaching_features(nouns, f).collect()} == {"학교", "학교로", "에서", "는"}
    assert {r["noun"] for r in n.ignore_features(nouns, f).collect()} == {"학교", "학교에서", "학교로"}
    josa = spark.createDataFrame([(x,) for x in ("는", "를", "의", "로", "도")], "word string")
    counts = table(spark, {"학교" + x: 2 for x in ("는", "를", "의", "로", "도")})
    assert {r["noun"] for r in n.ignore_noun_josa(nouns, counts, josa, josa.limit(0)).collect()} == {"학교", "학교에서", "에서", "는"}
    assert n.ignore_noun_josa(nouns, counts, josa, josa.where("word = '로'")).count() == 5


def test_coverage_and_driver(spark):
    f = feats(spark)
    c = table(spark, {"학교는": 5, "학교를": 4, "학교": 3, "학교에서": 1, "간다": 7, "나의": 2, "나도": 1})
    r = n.covered(c, spark.createDataFrame([("학교",), ("나",), ("간",)], "noun string"), f).first()
    assert (r["total"], r["covered"]) == (23, 15)
    sents = spark.createDataFrame([(1, 0, "학교는 학교를 학교의 학교에서 학교"), (2, 0, ""), (3, 0, None)], "doc_id long, sent_id int, sent string")
    got = n.NounExtractor(f).train_extract(sents).collect()
    assert [(r["noun"], r["frequency"], r["score"]) for r in got] == [("학교", 5, 1.0)]
    assert n.NounExtractor(f).train_extract(sents.where("false")).count() == 0


def test_weighted(spark):
    w = spark.createDataFrame([("는", 0.9), ("를", 1.0), ("다", -1.0), ("에서", 0.8), ("서", -0.5), ("는", 0.1)], "feature string, weight double")
    counts = {"학교는": 6, "학교를": 5, "학교에서": 7, "학교": 9, "가다": 8, "가는": 5, "학교장": 5}
    got = {r["noun"]: (r["frequency"], round(r["score"], 6), round(r["known_r_ratio"], 6)) for r in n.extract_weighted(table(spark, counts), n.max_weights(w)).collect()}
    known = 6 + 5 + 7
    assert got == {"학교": (32, round((6 * 0.9 + 5 + 7 * 0.8) / known, 6), round(known / (known + 5), 6))}
