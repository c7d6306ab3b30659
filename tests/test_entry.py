"""The driver contract, streaming counts, text formats."""

from __future__ import annotations

import subprocess
import sys

from gyeol.sources import corpus, lexicon
from gyeol.streaming import counts
from tests.conftest import ROOT


def test_registry():
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) > 80


def test_rest_stands_alone():
    """Everything but the llm subpackage imports without it."""
    code = "import sys; sys.modules['gyeol.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not [k for k in q if k.startswith('op')] and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_streamed_counts_equal_batch(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(["a b a", "b c", "", None, "a"])]
    for k in range(0, 5, 2):
        spark.createDataFrame(rows[k : k + 2], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = counts.stream_documents(spark, str(tmp_path / "in/*"), files_per_trigger=1)
    counts.write_counts(counts.token_counts(stream), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    got = {r["tok"]: r["n"] for r in counts.read_counts(spark, str(tmp_path / "out")).collect()}
    assert got == {"a": 3, "b": 2, "c": 1}


def test_text_formats(spark, tmp_path):
    (tmp_path / "c.txt").write_text("head\none  two \n three\n\n", encoding="utf-8")
    docs = corpus.read_doublespace(spark, str(tmp_path / "c.txt"), skip_header=1)
    assert [r["text"] for r in docs.orderBy("doc_id").collect()] == ["one  two", "three", ""]
    sents = corpus.read_doublespace(spark, str(tmp_path / "c.txt"), iter_sent=True, skip_header=1)
    assert [r["sent"] for r in sents.orderBy("doc_id", "sent_id").collect()] == ["one", "two", "three"]
    (tmp_path / "w.txt").write_text("하 5\n가 1\n나\n\n", encoding="utf-8")
    assert sorted(map(tuple, lexicon.read_words(spark, str(tmp_path / "w.txt"), 1).collect())) == [("가", 1), ("나", 1), ("하", 5)]
    (tmp_path / "f.tsv").write_text("는\t0.5\n는\t0.9\n를\tx\n의\t-1\n", encoding="utf-8")
    assert {r["feature"]: r["weight"] for r in lexicon.read_weights(spark, str(tmp_path / "f.tsv")).collect()} == {"는": 0.9, "의": -1.0}
    corpus.sorted_lines(spark, str(tmp_path / "w.txt"), str(tmp_path / "sorted"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "sorted")).collect()] == ["가 1", "나", "하 5"]
