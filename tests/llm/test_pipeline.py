"""The pipeline on a small corpus: each stage's decisions take effect, and run() is the stages one after the other."""

from __future__ import annotations

import random

import corpus_pipeline
from gyeol.llm import mixing
from tests.llm.test_langid import SAMPLES

ITEM = "which planet of the solar system has the most moons and what are the largest ones called"


def corpus():
    r = random.Random(4)
    text = lambda lang, n=60: " ".join(r.choice(SAMPLES[lang]) for _ in range(n))
    rows = [(i, text(lang), lang, r.choice("pq")) for i, lang in enumerate(["en", "de", "fr"] * 30)]
    base = text("en", 150)
    rows += [(200, base, "en", "p"), (201, base, "en", "q"), (202, base + " indeed", "en", "p")]  # copies
    rows += [(210, "12345 67890 !!!", "en", "p"), (211, "", None, "p"), (212, None, "en", None)]  # no language
    head = "this page has been archived for all of them"
    rows += [(220, f"{head}\n{text('en')}", "en", "p"), (221, f"{head}!\n{text('en')}", "en", "q"), (222, head, "en", "q")]  # repeated lines
    rows += [(230, f"{text('en', 30)} {ITEM} {text('en', 30)}", "en", "p")]  # a benchmark passage
    rows += [(240, "the people were there with their words about this and that " * 3000, "en", "q")]
    return [(*x, len(x[1] or "")) for x in rows]


def test_stages(spark, tmp_path):
    rows = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontaminate", "mix"]
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / f"stage-{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage-{k}"))
        if k < 4:
            assert docs.columns == [f.split()[0] for f in schema.split(", ")]
            kept[name] = {x["doc_id"]: x["text"] for x in docs.collect()}
    every = {x[0] for x in rows}
    assert set(kept["language_id"]) == every - {210, 211, 212}
    # 201 has no line of its own left, 222 neither; 202 is one edit too far from 200 and stays for the next stage
    assert set(kept["language_id"]) - set(kept["line_dedup"]) == {201, 222}
    assert "archived" in kept["line_dedup"][220] and "archived" not in kept["line_dedup"][221]
    assert set(kept["line_dedup"]) - set(kept["near_dedup"]) == {202}
    assert set(kept["decontaminate"]) == set(kept["near_dedup"])
    assert "planet" not in kept["decontaminate"][230] and all(kept["decontaminate"][d] == t for d, t in kept["near_dedup"].items() if d != 230)
    want = sum(len(t.split()) for t in kept["decontaminate"].values())
    blocks = docs.collect()
    assert {x["source"] for x in blocks} <= {"p", "q"} and len(blocks) >= want // mixing.BLOCK
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(str, again)) == sorted(map(str, blocks))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_empty_tables(spark, tmp_path):
    for name, rows, items in (("none", [], [(1, ITEM)]), ("no-items", corpus(), [])):
        d = tmp_path / name
        spark.createDataFrame(rows, SCHEMA).write.parquet(str(d / "documents.parquet"))
        spark.createDataFrame(items, "item_id long, text string").write.parquet(str(d / "benchmark.parquet"))
        assert corpus_pipeline.run(spark, str(d)).isEmpty() == (not rows)


def test_repeated_ids_and_clashing_columns(spark, tmp_path):
    """One id with two texts: each text is judged on its own, in every stage; equal rows count once."""
    r = random.Random(9)
    text = lambda lang, n=60: " ".join(r.choice(SAMPLES[lang]) for _ in range(n))
    rows = [(i, text(lang), lang, "p") for i, lang in enumerate(["en", "de", "fr"] * 20)]
    one, two, item = text("en"), text("en"), f"{text('en', 20)} {ITEM} {text('en', 20)}"
    rows += [(70, one, "en", "p"), (71, one, "en", "p"), (71, two, "en", "p"), (72, item, "en", "p"), (72, two + " indeed so", "en", "p"), (73, text("de"), "de", None), (73, None, "de", "q")]
    rows.append(rows[3])
    full = [(*x, len(x[1] or ""), "h", 5) for x in rows]
    docs = spark.createDataFrame(full, SCHEMA + ", h string, gone_doc int")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"s{k}"))
        docs = spark.read.parquet(str(tmp_path / f"s{k}"))
    left = [(x["doc_id"], x["text"]) for x in docs.collect()]
    assert (70, one) in left and (71, one) not in left and sum(t == rows[3][1] for _, t in left) == 1
    assert sum(d in (71, 72) and t in (two, two + " indeed so") for d, t in left) == 1  # near copies of each other
    assert [t for d, t in left if d == 72 and "planet" not in t and t.startswith(item[:30])] and len(left) >= 62
    assert set(x["gone_doc"] for x in docs.collect()) == {5}
