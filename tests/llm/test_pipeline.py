"""The pipeline's stages, each judged on its own input by a brute-force version."""

import re

import pyarrow as pa
from test_operators import brute_decontaminate, brute_secrets, check_packing, lower, similar_pairs

import corpus_pipeline
from rallylake.llm import packing, secrets
from rallylake.llm.common import arrow_map


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    clean = {r["doc_id"] for r in spark.read.parquet(f"{small}/labels.parquet").collect() if r["quality"] == 1 and r["toxic"] == 0}
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    rows, columns = {r["doc_id"]: r for r in docs.collect()}, docs.columns
    for (name, stage), last in zip(corpus_pipeline.STAGES, [False] * 4 + [True], strict=True):
        before, docs = docs, corpus_pipeline.materialize(stage(spark, docs, small), "stage")
        found = docs.collect()
        if last:
            assert check_packing(found, {k: r["text"] for k, r in rows.items()}) == 0
            break
        assert docs.columns == columns, name
        out = {r["doc_id"]: r for r in found}
        assert len(out) == len(found)
        if name == "quality classifier":
            assert len(clean & set(out)) >= 0.97 * len(clean) and set(out) < set(rows)
            assert all(out[k] == rows[k] for k in out)
        elif name == "SimHash near-dedup":
            # one row of each group of all pairs at 0.8 or more; a pair may be missed, none is made up
            ids, least = sorted(rows), {}
            texts = [rows[k]["text"] for k in ids]
            pairs = similar_pairs(texts) + [(j, i) for j in range(len(ids)) for i in range(j) if lower(texts[i]).split() == lower(texts[j]).split()]
            for j, i in sorted(pairs, key=lambda x: (max(x), min(x))):
                a, b = least.get(i, i), least.get(j, j)
                least = {k: min(a, b) if v in (a, b) else v for k, v in {**{i: i, j: j}, **least}.items()}
            gone = {ids[k] for k, v in least.items() if v != k}
            assert gone and set(rows) - gone <= set(out) and len(set(out) & gone) <= 0.1 * len(gone)
            assert all(out[k] == rows[k] for k in out)
        elif name == "benchmark decontamination":
            assert set(out) == {k for k, r in rows.items() if not brute_decontaminate(r["text"], items)[3]}
        else:
            model = secrets.fit(docs=before)
            assert set(out) == set(rows)
            for k, r in rows.items():
                assert brute_secrets(out[k]["text"])[1] == "" and out[k]["n_chars"] == len(out[k]["text"])
                if not secrets.scan([r["text"].encode()], model)[0].spans:
                    assert out[k]["text"] == r["text"]
        rows = out


def test_run_and_odd_rows(spark, small, tmp_path):
    schema = spark.read.parquet(f"{small}/documents.parquet").schema
    text = "some plain words that nobody would reject out of hand here"
    odd = [(None, text, None, None, None), (None, text, None, None, None), (1, None, None, None, None), (2, "", "", "", 0), (2, "", "", "", 0), (3, text + " and token = abcdef123", "en", "s", 9)]
    spark.createDataFrame(odd, schema).write.parquet(str(tmp_path / "documents.parquet"))
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{small}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in rows} == {None, 1, 3}  # texts 1 and 2 are both empty
    assert re.match(r"^\d+$", str(sum(r["length"] for r in rows)))
    spark.read.parquet(str(tmp_path / "documents.parquet")).limit(0).write.parquet(str(tmp_path / "none/documents.parquet"))
    for t in ("labels", "benchmark"):
        spark.read.parquet(str(tmp_path / f"{t}.parquet")).write.parquet(str(tmp_path / f"none/{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_a_worker_keeps_tables_of_one_operator(spark, small):
    """What one stage's tasks keep in a worker that is used again is gone in the next stage's."""

    def alive(batches):
        import gc

        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(type(x).__name__ == "ChunkEncoder" for x in gc.get_objects())])], names=["n"])

    docs = spark.read.parquet(f"{small}/documents.parquet").repartition(8)
    packed = lambda: sorted(r["ids_crc32"] for r in packing.pack(docs).collect())
    before = packed()
    assert {r["n"] for r in arrow_map(docs.select("doc_id"), alive, "n long").collect()} == {0}
    # nor does that change what is packed when its turn comes again
    assert packed() == before
