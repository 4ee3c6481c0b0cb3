"""Readers of text, span data, label spaces and the small binary formats."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPAN_SCHEMA = "text string, spans array<struct<start:int,end:int,label:string>>"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files, without one line feed at the end."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", r"\n\z", "").alias("text"))


def read_spans(spark: SparkSession, path: str | list[str], skip: int = 0) -> DataFrame:
    """(file, row_no, text, spans) of span JSONL; blank lines don't count, the first ``skip`` rows of each file go.

    Numbers follow the place in the file: the order of its splits, then of
    lines in them.  Only the counts of splits meet on one task.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"), "value").filter(F.trim("value") != "")
    at = Window.partitionBy("file", "_block").orderBy("_id")
    numbered = lines.withColumn("_k", F.row_number().over(at))
    before = lines.groupBy("file", "_block").agg(F.count("*").alias("_n"))
    before = before.withColumn("_before", F.sum("_n").over(Window.partitionBy("file").orderBy("_block")) - F.col("_n")).drop("_n")
    rows = numbered.join(before, ["file", "_block"]).withColumn("row_no", F.col("_before") + F.col("_k") - 1 - skip).filter("row_no >= 0")
    return rows.select("file", "row_no", F.from_json("value", SPAN_SCHEMA).alias("x")).select("file", "row_no", "x.text", "x.spans")


def read_label_space(spark: SparkSession, path: str) -> DataFrame:
    """(label, redaction, description) of a label space in JSON."""
    return spark.read.schema("name string, description string, labels array<struct<name:string,redaction:string,description:string>>").json(path, multiLine=True).select(F.explode("labels").alias("x")).select(F.col("x.name").alias("label"), "x.redaction", "x.description")


def parse_pack(raw: bytes) -> list[bytes]:
    """Texts of a pack: a count, then the length and bytes of each, little-endian."""
    (n,), at, out = struct.unpack_from("<I", raw), 4, []
    for _ in range(n):
        (k,) = struct.unpack_from("<I", raw, at)
        if at + 4 + k > len(raw):
            raise ValueError("the pack ends too early")
        out.append(raw[at + 4 : at + 4 + k])
        at += 4 + k
    return out


def read_packs(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, raw) of text packs; a pack is one task's work."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                texts = parse_pack(raw)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(texts), pa.string()), pa.array(range(len(texts)), pa.int32()), pa.array(texts, pa.binary())], ["path", "pos", "raw"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, pos int, raw binary")


def pack_texts(texts: list[bytes]) -> bytes:
    return struct.pack("<I", len(texts)) + b"".join(struct.pack("<I", len(t)) + t for t in texts)


def pack_tokens(rows: list[list[tuple[int, int, int]]]) -> bytes:
    """The token pack: a count of tokens, their ids, their offsets, for each text."""
    out = []
    for row in rows:
        x = np.array(row, "<i4").reshape(-1, 3)
        out.append(struct.pack("<I", len(x)) + x[:, 0].tobytes() + np.ascontiguousarray(x[:, 1:]).tobytes())
    return b"".join(out)


def packed_tokens(tokens) -> Column:
    """Each row's tokens (id, start, end) as its part of a token pack; null counts as none."""

    @F.arrow_udf("binary")
    def run(column: pa.Array) -> pa.Array:
        flat, ends = column.flatten(), np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy())]).tolist()
        x = np.stack([flat.field(k).to_numpy(zero_copy_only=False) for k in ("id", "start", "end")], axis=1).astype("<i4") if len(flat) else np.zeros((0, 3), "<i4")
        return pa.array([struct.pack("<I", b - a) + x[a:b, 0].tobytes() + np.ascontiguousarray(x[a:b, 1:]).tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary())

    return run(F.transform(F.col(tokens) if isinstance(tokens, str) else tokens, lambda t: F.struct(*(t[k].cast("int").alias(k) for k in ("id", "start", "end")))))


def write_token_packs(docs: DataFrame, path: str, pos_col: str = "pos", tokens_col: str = "tokens") -> DataFrame:
    """Writes ``docs`` as Parquet of (pos, pack): executors write their own rows' parts.  Returns the table.

    In the order of pos the parts put together are one token pack, as ``join_packs`` makes it.
    """
    docs.select(F.col(pos_col).alias("pos"), packed_tokens(tokens_col).alias("pack")).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def join_packs(packs: DataFrame, path: str) -> None:
    """One file of all parts in order, partition after partition through the driver."""
    with open(path, "wb") as f:
        for row in packs.orderBy("pos").select("pack").toLocalIterator():
            f.write(row.pack)


def parse_tokens(raw: bytes) -> list[list[tuple[int, int, int]]]:
    at, out = 0, []
    while at < len(raw):
        (n,) = struct.unpack_from("<I", raw, at)
        ids = np.frombuffer(raw, "<i4", n, at + 4)
        ends = np.frombuffer(raw, "<i4", 2 * n, at + 4 + 4 * n).reshape(-1, 2)
        out.append([(int(i), int(a), int(b)) for i, (a, b) in zip(ids, ends)])
        at += 4 + 12 * n
    return out


def read_i32(path: str) -> np.ndarray:
    raw = Path(path).read_bytes()
    if len(raw) % 4:
        raise ValueError(f"{path} isn't a whole number of 32-bit integers")
    return np.frombuffer(raw, "<i4")


def read_taps(spark: SparkSession, folder: str) -> DataFrame:
    """(tap, row, val) of a folder with meta.json and a .f32 or .i32 file for each tap; files are read and taken apart by executors."""
    taps = json.loads((Path(folder) / "meta.json").read_text())["taps"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                name, _, wide = path.rpartition("/")[2].rpartition(".")
                if name not in taps or wide != ("i32" if "i" in taps[name].get("dtype", "f32") else "f32"):
                    continue
                x = np.frombuffer(raw.as_buffer(), "<i4" if wide == "i32" else "<f4").reshape(taps[name]["shape"])
                x = x.reshape(len(x), -1).astype(np.float64)
                values = pa.ListArray.from_arrays(np.arange(0, x.size + 1, max(x.shape[1], 1), dtype=np.int32)[: len(x) + 1], x.ravel())
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(x), pa.string()), pa.array(np.arange(len(x), dtype=np.int32)), values], ["tap", "row", "val"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[fi]32").load(folder)
    return files.select("path", "content").mapInArrow(run, "tap string, row int, val array<double>")


def write_taps(folder: str, taps: dict[str, np.ndarray], tokens: int) -> None:
    base = Path(folder)
    base.mkdir(parents=True, exist_ok=True)
    meta = {}
    for name, x in taps.items():
        wide = "i32" if x.dtype.kind == "i" else "f32"
        (base / f"{name}.{wide}").write_bytes(x.astype("<i4" if wide == "i32" else "<f4").tobytes())
        meta[name] = {"shape": list(x.shape), "dtype": wide}
    (base / "meta.json").write_text(json.dumps({"n_tok": tokens, "taps": meta}))


_TYPES = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "I64": "<i8", "I32": "<i4", "U8": "u1"}


def read_safetensors(folder: str) -> Iterator[tuple[str, np.ndarray]]:
    """(name, tensor) of a single file or of the shards of an index; bfloat16 becomes float32."""
    base = Path(folder)
    index = base / "model.safetensors.index.json"
    files = sorted(set(json.loads(index.read_text())["weight_map"].values())) if index.exists() else ["model.safetensors"]
    for f in files:
        raw = np.memmap(base / f, np.uint8, mode="r")
        n = int(raw[:8].view("<u8")[0])
        for name, x in json.loads(bytes(raw[8 : 8 + n])).items():
            if name == "__metadata__":
                continue
            part = raw[8 + n + x["data_offsets"][0] : 8 + n + x["data_offsets"][1]]
            if x["dtype"] == "BF16":
                yield name, (np.frombuffer(part.tobytes(), "<u2").astype(np.uint32) << 16).view(np.float32).reshape(x["shape"])
            else:
                yield name, np.frombuffer(part.tobytes(), _TYPES[x["dtype"]]).reshape(x["shape"])


def read_hf_tokenizer(folder: str) -> dict:
    """tokens (gaps filled as [PADi]), types (1 plain, 3 special), merges, eos and pad of a model folder."""
    base = Path(folder)
    t = json.loads((base / "tokenizer.json").read_text(encoding="utf-8"))
    config = json.loads((base / "config.json").read_text()) if (base / "config.json").exists() else {}
    ids = {v: (k, 1) for k, v in t["model"]["vocab"].items()} | {a["id"]: (a["content"], 3 if a.get("special") else 1) for a in t.get("added_tokens", ())}
    n = max([config.get("vocab_size", 0), *(i + 1 for i in ids)])
    filled = [ids.get(i, (f"[PAD{i}]", 5)) for i in range(n)]
    return {"tokens": [k for k, _ in filled], "types": [k for _, k in filled], "merges": [m if isinstance(m, str) else " ".join(m) for m in t["model"]["merges"]], "eos": config.get("eos_token_id"), "pad": config.get("pad_token_id")}
