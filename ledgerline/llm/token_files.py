"""Token-id files (operator 2): flat unsigned integers with 64-bit document offsets.

Layout of a folder: per part, `tokens-<part>.bin` holds the ids of its documents one after
another (uint16 where the vocabulary allows it, else uint32, little-endian), and
`offsets-<part>.bin` holds n + 1 int64 offsets within the part followed by n int64 doc_ids.
`manifest.json` lists the parts in document order with their bases, which are prefix sums of
the parts' token counts. Files can be memory-mapped as they are.

Texts are dealt out by range of doc_id and each task writes one part under a name of its own,
so a retried or speculative task never touches another's files; the manifest names the parts
of the tasks that succeeded. Only one row a part comes to the driver.

Defined results: null text is empty (one end id); null doc_ids come first; rows that share
a doc_id are ordered by a hash of their text; an empty table gives a manifest without parts.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import textarrays, tokens
from ledgerline.llm.rows import KEY, doc_id, keyed
from ledgerline.session import scratch, table

END_ID = 2
VOCABULARY = "byte_bpe_50k.json"

_SUMMARY = "part int, name string, documents long, tokens long"
_READ = "did long, start long, ids binary"


def _writer(folder: str, vocabulary: str, end_id: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(folder)
        name = uuid.uuid4().hex
        coder = tokens.encoder(vocabulary)
        sizes, ids = [np.zeros(1, np.int64)], [np.zeros(0, np.int64)]
        out = None
        for whole in batches:
            for batch in textarrays.slices(whole, "text"):
                out = out or store.open_output_stream(f"{top}/tokens-{name}.bin")
                coded = coder.encode(batch.column("text").to_pylist())
                flat = np.frombuffer(np.array([end_id], "<u4").tobytes().join([*coded, b""]), "<u4")
                out.write(flat.astype(f"<u{width}").tobytes())
                sizes.append(np.array([len(c) // 4 + 1 for c in coded], np.int64))
                ids.append(batch.column("did").to_numpy(zero_copy_only=False))
        if out is None:
            return
        out.close()
        offsets = np.cumsum(np.concatenate(sizes))
        with store.open_output_stream(f"{top}/offsets-{name}.bin") as f:
            f.write(offsets.astype("<i8").tobytes())
            f.write(np.concatenate(ids).astype("<i8").tobytes())
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pylist([{"part": part, "name": name, "documents": len(offsets) - 1, "tokens": int(offsets[-1])}], pa.schema([("part", pa.int32()), ("name", pa.string()), ("documents", pa.int64()), ("tokens", pa.int64())]))

    return run


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int = END_ID) -> dict:
    """Write the files of docs (doc_id, text) to a folder (a URI all executors share); returns the manifest."""
    width = 2 if max(tokens.Encoder(vocabulary).vocabulary_size(), end_id + 1) <= 1 << 16 else 4
    store, top = fs.FileSystem.from_uri(folder)
    store.create_dir(top, recursive=True)
    ordered = keyed(docs).repartitionByRange(*KEY).sortWithinPartitions(*KEY)
    rows = ordered.mapInArrow(_writer(folder, vocabulary, end_id, width), _SUMMARY).collect()
    parts, base = [], 0
    for row in sorted(rows, key=lambda r: r["part"]):
        parts.append({"name": row["name"], "documents": row["documents"], "tokens": row["tokens"], "base": base})
        base += row["tokens"]
    manifest = {"width": width, "end_id": end_id, "tokens": base, "parts": parts}
    with store.open_output_stream(f"{top}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def _mapped(store: fs.FileSystem, path: str) -> pa.Buffer:
    """The whole file, memory-mapped where the store is local."""
    if isinstance(store, fs.LocalFileSystem):
        with pa.memory_map(path) as f:
            return f.read_buffer()
    with store.open_input_file(path) as f:
        return f.read_buffer()


def _reader(folder: str, width: int, rows: int = 512):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for part in batch.to_pylist():
                ids = np.frombuffer(_mapped(store, f"{top}/tokens-{part['name']}.bin"), f"<u{width}")
                index = np.frombuffer(_mapped(store, f"{top}/offsets-{part['name']}.bin"), "<i8")
                offsets, dids = index[: part["documents"] + 1], index[part["documents"] + 1 :]
                for i in range(0, len(dids), rows):
                    j = min(i + rows, len(dids))
                    wide = [ids[offsets[k] : offsets[k + 1]].astype("<u4").tobytes() for k in range(i, j)]
                    yield pa.RecordBatch.from_arrays([pa.array(dids[i:j]), pa.array(offsets[i:j] + part["base"]), pa.array(wide, pa.binary())], names=["did", "start", "ids"])

    return run


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(did, start, ids) of a folder of token files; ids are little-endian uint32 bytes."""
    store, top = fs.FileSystem.from_uri(folder)
    with store.open_input_stream(f"{top}/manifest.json") as f:
        manifest = json.loads(f.read())
    parts = manifest["parts"]
    listed = spark.createDataFrame([(p["name"], p["documents"], p["base"]) for p in parts], "name string, documents long, base long")
    return listed.repartition(max(1, len(parts))).mapInArrow(_reader(folder, manifest["width"]), _READ)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{scratch(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(table(spark, sf_dir, "documents"), folder, tokens.vocabulary(VOCABULARY))
    read = read_token_files(spark, folder)
    return read.select(doc_id(), "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
