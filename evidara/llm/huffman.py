"""Token-ID files: canonical length-limited Huffman coding with bit-offset checkpoints.

File format: a folder with two tables. ``codebook`` holds (symbol, length); codes are canonical, so the lengths are all
there is to know. ``blocks`` has one folder a part (parts follow ascending doc_id) and one row a block: the part, the number of the
block's first token in the whole file, the documents in it with their token counts, the coded bits, and the bit offset of every EVERY-th token. Blocks decode
independently of each other; inside a block all stretches between checkpoints decode side by side, one table look-up a token.

Writing: texts are range-partitioned by doc_id and encoded once; ids are kept as a table; their global counts give the code
(package-merge, LIMIT bits at most); a second job codes each part into blocks of about BLOCK tokens. A document longer than
that is a block of its own.

Results: a null or empty text still has its end id; an empty table makes an empty file that reads back as no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.llm.common import dropped, records, shared_root, written
from evidara.llm.textarrays import slices
from evidara.llm.tokens import END_ID, binary, encoder, id_width

LIMIT = 18
EVERY = 64
BLOCK = 1 << 17
BLOCKS = "first_token bigint, doc_id array<bigint>, n array<bigint>, payload binary, checkpoints array<bigint>, part int"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Code length of every symbol (0: never occurs) that minimises the total under the limit, by package-merge."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), dtype=np.int64)
    if len(used) < 2:
        out[used] = 1
        return out
    limit = max(limit, int(len(used) - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    level, own = leaves, [np.ones(len(leaves), dtype=bool)]
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        at = np.argsort(both, kind="stable")
        level = both[at]
        own.append(at < len(leaves))
    lengths, take = np.zeros(len(leaves), dtype=np.int64), 2 * len(leaves) - 2
    for is_leaf in reversed(own):
        n = int(is_leaf[:take].sum())
        lengths[:n] += 1
        take = 2 * (take - n)
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code of every symbol, and the symbols in code order."""
    symbols = np.lexsort((np.arange(len(lengths)), lengths))
    symbols = symbols[lengths[symbols] > 0]
    codes = np.zeros(len(lengths), dtype=np.uint64)
    if len(symbols):
        sizes = lengths[symbols]
        top = int(sizes.max())
        step = np.uint64(1) << (top - sizes).astype(np.uint64)
        first = np.concatenate([[0], np.cumsum(step)[:-1]]).astype(np.uint64)
        codes[symbols] = first >> (top - sizes).astype(np.uint64)
    return codes, symbols


def pack_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray, every: int = EVERY) -> tuple[bytes, np.ndarray]:
    """Codes of ids back to back, most significant bit first, and the bit offset of every every-th id."""
    n = lengths[ids]
    ends = np.cumsum(n)
    if not len(ids):
        return b"", np.zeros(0, np.int64)
    starts = ends - n
    words = np.zeros(int(ends[-1] + 63) // 64 + 1, dtype=np.uint64)
    at, shift = starts >> 6, 64 - (starts & 63) - n
    code = codes[ids]
    inside = np.where(shift >= 0, code << np.maximum(shift, 0).astype(np.uint64), code >> np.maximum(-shift, 0).astype(np.uint64))
    first = np.flatnonzero(np.diff(at, prepend=-1))
    words[at[first]] |= np.bitwise_or.reduceat(inside, first)
    over = np.flatnonzero(shift < 0)  # one code at most crosses each border
    words[at[over] + 1] |= code[over] << (64 + shift[over]).astype(np.uint64)
    return words.astype(">u8").tobytes()[: int(ends[-1] + 7) // 8], starts[::every].copy()


class Decoder:
    """Table-driven: the next ``top`` bits name the symbol and its length."""

    def __init__(self, lengths: np.ndarray, every: int = EVERY):
        _, symbols = canonical(lengths)
        self.top = int(lengths.max()) if len(symbols) else 1
        span = 1 << (self.top - lengths[symbols])
        self.symbols = np.zeros(1 << self.top, dtype=np.uint32)
        self.lengths = np.zeros(1 << self.top, dtype=np.uint8)
        self.symbols[: span.sum()] = np.repeat(symbols, span)
        self.lengths[: span.sum()] = np.repeat(lengths[symbols], span)
        self.every = every

    def decode(self, payload: bytes, checkpoints: np.ndarray, total: int) -> np.ndarray:
        raw = np.frombuffer(payload + b"\0\0\0\0", dtype=np.uint8).astype(np.uint32)
        ahead = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
        out = np.zeros((self.every, len(checkpoints)), dtype=np.uint32)
        at, last = checkpoints.astype(np.int64), (total - 1) % self.every + 1 if total else 0
        for step in range(self.every if total > self.every else last):
            live = at if step < last else at[:-1]
            key = (ahead[live >> 3] << (live & 7).astype(np.uint32)) >> np.uint32(32 - self.top)
            out[step, : len(live)] = self.symbols[key]
            live += self.lengths[key]
        return out.T.reshape(-1)[:total]


def _stored_ids(docs: DataFrame, tokenizer: str, end: int, key: str, text: str) -> DataFrame:
    """(part, own, doc_id, n, ids, counts) in ascending doc_id over parts; own: tokens before the document in its part. Each part ends
    with a row that has nothing but the counts of its ids."""
    width = id_width(tokenizer)
    kinds = pa.schema([("own", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, coder = 0, encoder(tokenizer)
        counts = np.zeros(max(coder.size, end + 1), dtype=np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, bounds = coder.encode(part.column(1), end)
                counts += np.bincount(ids, minlength=len(counts))
                yield pa.record_batch([pa.array(own + bounds[:-1]), part.column(0), pa.array(np.diff(bounds)), binary(ids.astype(width), bounds), pa.nulls(part.num_rows, pa.binary())], schema=kinds)
                own += int(bounds[-1])
        yield pa.RecordBatch.from_pylist([{"own": own, "n": 0, "counts": counts.tobytes()}], schema=kinds)

    rows = records(docs, key, text).select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return ordered.mapInArrow(run, "own bigint, doc_id bigint, n bigint, ids binary, counts binary").withColumn("part", F.spark_partition_id())


def write(docs: DataFrame, path: str, tokenizer: str, *, key: str = "doc_id", text: str = "text", end: int = END_ID, limit: int = LIMIT, every: int = EVERY, block: int = BLOCK) -> None:
    """Encode all texts and write a token-ID file at path."""
    spark = docs.sparkSession
    width = id_width(tokenizer)
    table = written(_stored_ids(docs, tokenizer, end, key, text))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for x in batch.column(0):
                got = np.frombuffer(x.as_buffer(), dtype=np.int64)
                sums = got + sums if len(sums) else got
        at = np.flatnonzero(sums)
        yield pa.record_batch({"symbol": pa.array(at, pa.int64()), "n": pa.array(sums[at])})

    counted = table.select("counts").where("counts is not null").mapInArrow(count, "symbol bigint, n bigint").groupBy("symbol").agg(F.sum("n").alias("n")).collect()  # one row a symbol
    counts = np.zeros(max([encoder(tokenizer).size, end + 1, *(x["symbol"] + 1 for x in counted)]), dtype=np.int64)
    for x in counted:
        counts[x["symbol"]] = x["n"]
    lengths = code_lengths(counts, limit)
    codes, symbols = canonical(lengths)
    spark.createDataFrame([(int(s), int(lengths[s])) for s in symbols], "symbol bigint, length int").coalesce(1).write.parquet(f"{path}/codebook")
    before, at = {}, 0
    for x in table.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():  # one row a part
        before[x["part"]], at = at, at + x["n"]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list = []
        size = 0

        def flush():
            ids = np.frombuffer(b"".join(x[3] for x in waiting), dtype=width)
            payload, checkpoints = pack_bits(ids, codes, lengths, every)
            one = lambda value, kind: pa.array([value], kind)
            many = pa.list_(pa.int64())
            return pa.record_batch(
                {
                    "first_token": one(before[waiting[0][4]] + waiting[0][0], pa.int64()), "doc_id": one([x[1] for x in waiting], many), "n": one([x[2] for x in waiting], many),
                    "payload": one(payload, pa.binary()), "checkpoints": one(checkpoints, many), "part": one(waiting[0][4], pa.int32()),
                }
            )

        for batch in batches:
            own, doc, n, part = (batch.column(i).to_pylist() for i in (0, 1, 2, 4))
            for i in range(batch.num_rows):
                if waiting and (size + n[i] > block or part[i] != waiting[-1][4] or doc[i] < waiting[-1][1]):
                    yield flush()
                    waiting, size = [], 0
                waiting.append((own[i], doc[i], n[i], batch.column(3)[i].as_buffer().to_pybytes(), part[i]))
                size += n[i]
        if waiting:
            yield flush()

    blocks = table.where("doc_id is not null").select("own", "doc_id", "n", "ids", "part").mapInArrow(code, BLOCKS)
    blocks.write.partitionBy("part").option("compression", "none").parquet(f"{path}/blocks")
    dropped(table)


def read(spark: SparkSession, path: str, *, every: int = EVERY) -> DataFrame:
    """(doc_id, start, n, ids) of a token-ID file; ids as little-endian unsigned 32-bit; start: ids of all documents before."""
    book = spark.read.schema("symbol bigint, length int").parquet(f"{path}/codebook").collect()
    lengths = np.zeros(max([x["symbol"] + 1 for x in book], default=1), dtype=np.int64)
    for x in book:
        lengths[x["symbol"]] = x["length"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(lengths, every)
        for batch in batches:
            for i in range(batch.num_rows):
                first, docs, n, payload, checkpoints = (batch.column(k)[i] for k in range(5))
                n = n.values.to_numpy()
                bounds = np.concatenate([[0], np.cumsum(n)])
                ids = decoder.decode(payload.as_buffer().to_pybytes(), checkpoints.values.to_numpy(), int(bounds[-1]))
                yield pa.record_batch({"doc_id": docs.values, "start": pa.array(first.as_py() + bounds[:-1]), "n": pa.array(n), "ids": binary(ids, bounds)})

    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").select("first_token", "doc_id", "n", "payload", "checkpoints")
    return blocks.mapInArrow(decode, "doc_id bigint, start bigint, n bigint, ids binary")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared_root(spark)}/token_files/{uuid.uuid4().hex}"
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"))

    return read(spark, path).select("doc_id", "start", F.col("n").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
