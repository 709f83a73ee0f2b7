"""The pipeline's decisions, stage by stage, on planted cases."""

import os
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import tiktoken
import public_tokenizers as P

import corpus_pipeline
from tidemark.llm.bpe import load_ranks
from tidemark.runtime import LARGE_ROWS, drop, keep, map_arrow


def test_pipeline(spark, tmp_path):
    import numpy as np

    r = np.random.default_rng(11)
    words = ["".join(r.choice(["the", "ing", "and", "wh", "er", "ou"], 3)) for _ in range(400)]
    texts = {i: " ".join(r.choice(words, 60)) for i in range(40)}
    item = " ".join(r.choice(words, 30))
    texts[100] = texts[0]
    texts[101] = texts[1].rsplit(" ", 1)[0] + " changed"
    texts[102] = "clean start " + item + " " + texts[2]
    texts[103] = texts[3][::-1] + " secret = abcdef123 end"
    texts[104] = "12 34 !!"
    rows = [(i, t, "en", "s", len(t)) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/stage-{i}")
        docs = spark.read.parquet(f"{tmp_path}/stage-{i}")
        seen.append({x.doc_id for x in docs.select("doc_id").collect()})
        if i < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
    every = set(texts)
    assert seen == [every - {104}, every - {104, 100, 101}, every - {104, 100, 101, 102}, every - {104, 100, 101, 102}, every - {104, 100, 101, 102}]
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    for x in docs.collect():
        text = re.sub(r"secret = abcdef123", "[SECRET]", texts[x.doc_id])
        assert x.n_tokens == len(library.encode_ordinary(text))
    assert {x.doc_id for x in corpus_pipeline.run(spark, str(tmp_path)).collect()} == seen[-1]


def test_worker_gives_memory_back(spark):
    """A worker kept for the next stage does not hold what an earlier task freed."""

    def resident() -> int:
        return int(re.search(r"VmRSS:\s+(\d+)", Path("/proc/self/status").read_text())[1]) >> 10

    def run(spend):
        def task(batches):
            for _ in batches:
                pass
            if spend:
                blocks = [np.ones(60 << 10, np.uint8) for _ in range(5000)]
                os.kept = blocks.pop()  # the last block stands above all that is freed
                blocks.clear()
            yield pa.record_batch([pa.array([os.getpid()], pa.int64()), pa.array([resident()], pa.int64())], names=["pid", "mb"])

        return map_arrow(spark.range(1).coalesce(1), task, "pid long, mb long").collect()[0]

    spent = run(True)
    for _ in range(40):  # idle workers take turns
        later = run(False)
        if later.pid == spent.pid:
            break
    assert later.pid == spent.pid
    assert later.mb < spent.mb - 200


def test_large_rows_make_small_groups(spark):
    """Few large rows do not make one row group, which a reader and a writer would hold whole."""

    def run(batches):
        for batch in batches:
            for _ in range(batch.num_rows):
                yield pa.record_batch([pa.array([os.urandom(512 << 10)], pa.binary())], names=["block"])

    table = keep(map_arrow(spark.range(64).coalesce(1), run, "block binary"), "large", **LARGE_ROWS)
    (path,) = Path(table.kept_at.removeprefix("file://")).glob("*.parquet")
    found = pq.ParquetFile(path).metadata
    sizes = [found.row_group(i).total_byte_size for i in range(found.num_row_groups)]
    assert found.num_rows == 64 and max(sizes) <= 20 << 20
    drop(table)
