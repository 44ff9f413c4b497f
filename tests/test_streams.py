"""Streams over tables that come as folders of files."""

import os
import shutil

from conftest import SF
from noviscan.catalog import QUERIES


def foldered(spark, tmp_path):
    """The smallest scale with its documents in a folder of three files."""
    root = str(tmp_path / "sf")
    shutil.copytree(SF, root)
    os.remove(f"{root}/documents.parquet")
    spark.read.parquet(f"{SF}/documents.parquet").limit(60).repartition(3).write.parquet(f"{root}/documents.parquet")
    return root


def test_streams_read_folders(spark, tmp_path):
    root = foldered(spark, tmp_path)
    docs = spark.read.parquet(f"{root}/documents.parquet")
    got = QUERIES["str8_text_dedupe_stream"](spark, root).collect()
    assert len(got) == docs.select("text").distinct().count()
    paths = {r["note_path"] for r in QUERIES["str1_change_feed_index"](spark, root).collect()}
    assert paths == {f"{r['source']}/{r['doc_id']}.md" for r in docs.collect()}
    scored = {r["source_id"] for r in QUERIES["str4_streaming_novelty"](spark, root).collect()}
    assert scored == {str(r["doc_id"]) for r in docs.collect()}
