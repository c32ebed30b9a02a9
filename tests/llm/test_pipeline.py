"""The pipeline against plain versions of its stages, and the package without it."""

import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from llm import brute
from spendloom.llm import checks, mixing, registry, secrets

FOLDER = "/root/testdata/sf0.001"


def expected_pieces():
    """Quality by SQL, duplicates over all pairs, secrets by format, the mix by SQL, ids by the tokenizer."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE TABLE documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    kept = {row[0] for row in con.execute(f"SELECT doc_id FROM ({checks.quality_rules_sql()}) WHERE kept").fetchall()}
    rows = [r for r in con.execute("SELECT * FROM documents ORDER BY doc_id").fetchall() if r[0] in kept]
    labels = brute.classes([r[1] for r in rows])
    rows = [r for k, r in enumerate(rows) if labels[k] == k]
    import re

    secret = re.compile(r"(?<![\w+/-])(?:AKIA[0-9A-Z]{16}|[0-9a-fA-F]{18}|[0-9a-fA-F]{40})(?!\w)")
    clean = [(r[0], secret.sub(lambda m: secrets.MARK if re.search(r"\D", m[0]) else m[0], r[1]), r[2], r[3], r[4]) for r in rows]
    con.execute("CREATE TABLE cleaned AS SELECT * FROM documents LIMIT 0")
    con.executemany("INSERT INTO cleaned VALUES (?, ?, ?, ?, ?)", clean)
    mixed = con.execute(f"SELECT doc_id, text FROM ({checks.poisson_mix_sql('cleaned')})").fetchall()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(registry.tokenizer_path())
    out = []
    for doc_id, text in mixed:
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            own = np.array(ids[at : at + 4096], "<u4").tobytes()
            out.append((doc_id, k, at, len(own) // 4, zlib.crc32(own)))
    return sorted(out)


def test_pipeline_equals_plain_stages(spark):
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == expected_pieces()
    ends = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 4096


def test_stages_keep_the_columns_and_bear_odd_rows(spark, documents):
    """Extra columns, clashing names, nulls, empty and repeated rows pass through every stage; so does no row at all."""
    from pyspark.sql import functions as F

    good = "The first line of a text has words that end. Another sentence follows here, and it is fine. " * 4
    rows = [None, "", good, good, good + "And more words at the end of it all.", (None, good), (2, good)]
    for some in (rows, []):
        docs = documents(some).withColumn("kept", F.lit(1)).withColumn("copy", F.lit("c")).withColumn("row", F.lit("r"))
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, FOLDER)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns, name
            out.collect()


def test_order_and_number_of_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "secret_scan", "mix_sources", "pack_sequences"]
    assert mixing.POWER == 0.5


def test_functions_travel_with_their_jobs():
    """Executors need not have the package: its functions are pickled by value."""
    code = "import sys; sys.path.insert(0, sys.argv[1]); import pickle; from pyspark import cloudpickle; from spendloom.llm import neardup; sys.stdout.buffer.write(cloudpickle.dumps(neardup.similar))"
    made = subprocess.run([sys.executable, "-c", code, str(Path(__file__).parents[2])], capture_output=True, check=True)
    code = "import sys, pickle; f = pickle.loads(sys.stdin.buffer.read()); print(f(b'', b''), 'spendloom' in sys.modules)"
    used = subprocess.run([sys.executable, "-c", code], input=made.stdout, capture_output=True, check=True, cwd="/")
    assert used.stdout.split() == [b"True", b"False"]
