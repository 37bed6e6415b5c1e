"""The pipeline's stages on a small corpus with planted cases, and what is registered."""

import random

from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline


def test_registered():
    names = list(entry.queries())
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and [s for s, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "decontamination", "byte_bpe"]


def test_planted_cases(spark, tmp_path):
    rng = random.Random(11)
    words = ["".join(rng.choice(["ka", "lo", "mi", "tu", "re", "so"]) for _ in range(rng.randint(1, 4))) for _ in range(900)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n)) + "."
    rows, labels = [], []
    for k in range(900):
        t, toxic, poor = text(rng.randint(30, 150)), k % 9 == 0, k % 10 == 1
        if toxic:
            parts = t.split()
            for _ in range(5):
                parts.insert(rng.randrange(len(parts)), rng.choice(["scum", "moron", "filth"]))
            t = " ".join(parts)
        if poor:
            t = (rng.choice(words) + " ") * 80
        rows.append([k, t, "en", "s", len(t)])
        labels.append((k, int(not poor), int(toxic)))
    clean = [k for k in range(900) if k % 9 and k % 10 != 1]
    items = [(k, f"{text(20)} {text(7)}") for k in range(12)]
    leaked, copied = clean[10:16], clean[20:26]
    for k, (_, item) in zip(leaked, items, strict=False):
        rows[k][1] += " " + item
    rows += [[2000 + k, rows[k][1], "en", "s", 0] for k in copied] + [[3000 + k, rows[k][1] + " extra tail", "en", "s", 0] for k in copied]
    rows += [[4000, None, "en", "s", 0], [4001, "", "en", "s", 0], [None, text(60), "en", "s", 0], list(rows[clean[40]])]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = docs
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == before.columns
    left = [r.doc_id for r in docs.collect()]
    assert sorted(x for x in left if x is not None) == sorted({*clean, *(x for x in left if x is not None and x >= 4000)} - set(leaked))
    assert left.count(None) == 1
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(left)


def test_clashing_columns_and_repeated_ids(spark, tmp_path):
    """Columns named like the stages' own stay as they are; rows that share an id are judged by their texts."""
    rng = random.Random(13)
    text = lambda n: " ".join("".join(rng.choice("aeioustrnl") for _ in range(rng.randint(2, 8))) for _ in range(n)) + "."
    a, b, item = text(60), text(60), text(24)
    rows = [(1, a, 0, "x"), (1, b, 1, "y"), (1, b, 1, "y"), (2, a + " more", 2, "z"), (3, text(50) + " " + item, 3, "w"), (None, a, 4, "v"), (5, None, 5, None), (6, "", 6, None)]
    clash = ["score", "text_hash"], ["statistics", "kept_id"], ["item_id", "hash"]
    for k, names in enumerate(clash):
        where = tmp_path / str(k)
        docs = spark.createDataFrame(rows, f"doc_id long, text string, {names[0]} int, {names[1]} string")
        docs.write.parquet(str(where / "documents.parquet"))
        spark.createDataFrame([(k, 1, 0) for k in range(9)], "doc_id long, quality int, toxic int").write.parquet(str(where / "labels.parquet"))
        spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(str(where / "benchmark.parquet"))
        for name, stage in corpus_pipeline.STAGES[:-1]:
            stage(spark, docs, str(where)).write.parquet(str(where / name))
            docs = spark.read.parquet(str(where / name))
            assert docs.columns == ["doc_id", "text", *names]
        left = sorted((str(r.doc_id), r.text or "", r[2], r[3]) for r in docs.collect())
        assert left == sorted([("1", a, 0, "x"), ("1", b, 1, "y"), ("None", a, 4, "v"), ("5", "", 5, None), ("6", "", 6, None)])


def test_batches_are_bounded(spark, tmp_path):
    """What a stage's workers get at once is bounded by bytes, not by 10,000 rows; a smaller bound is kept."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.range(0, 9000, 1, 1).selectExpr("id doc_id", "repeat('some words ', 150) text")

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "size"])

    before = spark.conf.get(name)
    try:
        for _, stage in corpus_pipeline.STAGES:
            spark.conf.unset(name)
            stage(spark, docs, str(tmp_path))
            rows, most = docs.mapInArrow(sizes, "n long, size long").agg(F.sum("n"), F.max("size")).first()
            assert rows == 9000 and most <= 4_100_000
            spark.conf.set(name, 1_000_000)
            stage(spark, docs, str(tmp_path))
            assert int(spark.conf.get(name).rstrip("b")) == 1_000_000
    finally:
        spark.conf.set(name, before)


def test_empty_corpus(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).agg(F.count("*")).first()[0] == 0
