import os
import random
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from tests.llm.test_dedup import components, plain_dedup  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r["doc_id"], r["text"]) for r in kept.collect()]
        kept = stage(spark, kept, SF)
        after = sorted(r["doc_id"] for r in kept.select("doc_id").distinct().collect())
        if k < 3:
            assert kept.columns == docs.columns
        if k == 1:
            want = plain_dedup(before)
            assert after == sorted(i for i, _ in before if want[i][0] == i)
        if k == 2:
            want = components(before, 5, 80)
            assert after == sorted(i for i, _ in before if want[i][1] == i)
        if k == 3:
            assert after == sorted(i for i, _ in before)
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, SF).select("doc_id").distinct().collect()) == after


def test_stages_on_odd_tables(spark, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows and ids, clashing columns, and empty tables: defined, and no row is lost without a reason."""
    rnd = random.Random(4)
    text = lambda n: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))
    near, long = text(60), text(40_000)
    rows = [
        (None, near, None), (1, near + " more", "a"), (2, None, "b"), (3, "", None), (4, " \n", "c"), (5, long, "d"), (5, long, "d"), (6, long + " end", "d"),
        (7, text(30), "e"), (7, text(31), "e"), (None, text(32), None), (None, None, None),
    ]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit("clash") for c in ("kept", "keep_id", "row_key", "component_id", "score", "half", "bucket", "batch", "row")})
    odd.write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1), (None, 0), (2, None)], "doc_id long, quality int").write.parquet(f"file://{tmp_path}/labels.parquet")
    sf = f"file://{tmp_path}"
    shown = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    kept = corpus_pipeline.quality(spark, odd, sf)  # no classifier can be fitted on these labels: all stay
    assert shown(kept) == sorted(((i, t) for i, t, _ in rows), key=str)
    kept = corpus_pipeline.exact(spark, kept, sf)
    want = [(None, near), (1, near + " more"), (4, " \n"), (5, long), (6, long + " end"), *[(r[0], r[1]) for r in rows[8:11]]]
    assert shown(kept) == sorted(want, key=str) and kept.columns == odd.columns
    kept = corpus_pipeline.near(spark, kept, sf)
    want = [r for r in want if r not in ((None, near), (6, long + " end"))]
    assert shown(kept) == sorted(want, key=str) and kept.columns == odd.columns
    packed = corpus_pipeline.packing(spark, kept, sf).toPandas()
    assert packed.length.max() <= 2048 and len(packed[packed.piece == 0]) == len(want)
    assert corpus_pipeline.run(spark, sf).count() == len(packed)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.where("false"), sf).count() == 0


def test_the_rest_works_without_this_part(tmp_path):
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    shutil.copytree(os.path.join(root, "noticeflow"), tmp_path / "noticeflow", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and not any(k.startswith('op1') for k in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
