"""Columns of any name and type through the pipeline, and executors that cannot import the package."""

import os
import subprocess
import sys

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from pixelmill.llm import bpe, licenses, lm, quality

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
DATA = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

WORKER = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[2]).getOrCreate()

def importable(batches):
    import importlib.util
    import pyarrow as pa
    for b in batches:
        yield pa.RecordBatch.from_pydict({"found": [importlib.util.find_spec("pixelmill") is not None] * b.num_rows})

assert not spark.range(1).mapInArrow(importable, "found boolean").first()[0]
import pixelmill.llm.queries as q
for name in sys.argv[4:]:
    print(name, q.QUERIES[name](spark, sys.argv[3]).count())
"""


def test_executors_without_the_package(tmp_path):
    """Only the driver's path holds the package: functions and broadcasts travel whole."""
    names = ["op3_license_scan", "op4_quality_classifier", "op5_cover_tree_near_dedup", "op6_byte_bpe", "op7_suffix_tree_scores", "op9_simhash_near_dedup", "op10_chat_formatting", "op11_url_filter", "op13_conversation_trie"]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    (tmp_path / "run.py").write_text(WORKER)
    done = subprocess.run([sys.executable, "run.py", ROOT, str(tmp_path / "shared"), DATA, *names], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    assert [line.split()[0] for line in done.stdout.splitlines()] == names


@pytest.fixture(scope="module")
def odd_tables(spark, tmp_path_factory):
    """A folder of tables whose documents have columns of clashing, dotted and nested names, null ids, a text of 1 MB."""
    folder = str(tmp_path_factory.mktemp("odd"))
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(60)
    more = spark.createDataFrame([(None, None), (None, "a few words without id"), (900_001, ""), (900_002, "long words, again. " * 55_000), (900_003, "Mail x@example.com now"), (900_003, "Mail x@example.com now")], "doc_id long, text string")
    whole = docs.unionByName(more.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")}).select(docs.columns))
    whole = whole.withColumns({"a.b": F.lit("dotted"), "nested": F.struct(F.lit(1).alias("x y"), F.lit("v").alias("z.w")), "_row": F.lit(7), "_score": F.lit(0.5), "_text": F.lit("t"), "words": F.lit("w"), "m": F.create_map(F.lit("k"), F.lit(1)), "_kept0": F.lit(0), "tick`ed": F.lit(1)})
    whole.write.parquet(f"{folder}/documents.parquet")
    whole.limit(0).write.parquet(f"{folder}/none/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{DATA}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
        spark.read.parquet(f"{DATA}/{name}.parquet").write.parquet(f"{folder}/none/{name}.parquet")
    return folder


def test_pipeline_with_any_columns(spark, odd_tables, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{odd_tables}/documents.parquet")
    kept = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, kept, odd_tables).write.parquet(str(tmp_path / str(i)))
        kept = spark.read.parquet(str(tmp_path / str(i)))
        assert kept.schema.simpleString() == docs.schema.simpleString(), name
        row = kept.select("`a.b`", "nested", "m", "_row", "`tick``ed`").first()
        assert row is None or (row["a.b"], row["nested"]["x y"], row["m"], row["_row"], row["tick`ed"]) == ("dotted", 1, {"k": 1}, 7, 1)
    final = corpus_pipeline.run(spark, odd_tables)
    assert final.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and final.count() == kept.count()


def test_pipeline_of_nothing(spark, odd_tables):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, f"{odd_tables}/none").count() == 0


def test_operators_keep_any_columns(spark, odd_tables):
    """Kept columns come back under their names; a name of the result is refused."""
    docs = spark.read.parquet(f"{odd_tables}/documents.parquet").where("doc_id < 900002")
    keep = ["doc_id", "a.b", "nested", "_row", "_score", "_text", "m"]
    model = lm.fit(docs)
    for found, own in (
        (lm.score(docs, model, keep), ["n_tokens", "n_known", "base_score", "score"]),
        (licenses.scan(docs, keep), ["license", "coverage", "first_word", "end_word", "licenses", "copies"]),
        (quality.score(docs, quality.fit(docs, spark.read.parquet(f"{odd_tables}/labels.parquet"))), None),
    ):
        assert found.columns == ([*keep, *own] if own else [*docs.columns, "score"])
        row = found.where("doc_id IS NOT NULL").select("`a.b`", "nested", "m").first()
        assert (row[0], row[1]["x y"], row[2]) == ("dotted", 1, {"k": 1})
    renamed = docs.withColumns({c: F.lit(1) for c in ("score", "n_tokens", "license")})
    for call in (lambda: lm.score(renamed, model, ["score"]), lambda: bpe.digests(renamed, PATH, PATTERN, ["n_tokens"]), lambda: licenses.scan(renamed, ["license"])):
        with pytest.raises(ValueError, match="clash"):
            call()
