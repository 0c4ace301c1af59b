"""Best-fit packing by length histogram.

The plan is made over counts, not documents: for each length, longest first, all its pieces go at
once into the open sequences with the smallest sufficient room (best-fit decreasing). The plan is
a list of runs, each giving consecutive ranks of one length to consecutive sequences; it depends on
the capacity alone, not on the number of documents. Pieces then take their slots by joining on
length and rank. The rank within a length is counted in about sqrt(n) hashed buckets of each
length, so that a length which a third of all rows share is dealt to many tasks.

Defined results: null or empty text is the end token alone; repeated rows are packed each; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
import os
import re
import struct
import zlib
from bisect import bisect_left, insort

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import WordTable, byte_of_char, ids_and_text, slices, stash, tidy

CAPACITY = 4096
END_ID = 1
#: Beyond so many runs the plan is joined by shuffle, not broadcast.
BROADCAST_RUNS = 500_000

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
)


def tokenizer_text(path: str | None, name: str) -> str:
    """The tokenizer file's text, read on the driver; executors get it by broadcast."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(name)
    with open(path, encoding="utf-8") as f:
        return f.read()


def refuse_other_rules(text: str, normalizer, pre_tokenizer, kind: str) -> None:
    """A tokenizer file whose normalisation or splitting isn't what the caller's own splitting follows."""
    import json

    file = json.loads(text)
    if file.get("normalizer") != normalizer or file.get("pre_tokenizer") != pre_tokenizer or file["model"].get("type") != "BPE" or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in file["added_tokens"]):
        raise ValueError(f"this tokenizer does not normalise and split as {kind}: its texts would be cut wrongly")


# Normalisation and splitting as tokenizer files state them.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}

#: Words of these characters alone are split here as the tokenizer splits them: runs of letters,
#: single digits, runs of marks. (With an apostrophe a contraction may be split off.)
_PLAIN = re.compile("[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff0-9!-&(-/:-@\\[-`{-~]+")
_PARTS = re.compile("[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[!-&(-/:-@\\[-`{-~]+")


@functools.lru_cache(1)
def word_table(text: str) -> WordTable:
    """A worker's table of distinct words: UTF-8 word to its little-endian ids, kept from task to task.

    Neither normalisation nor splitting reaches across ASCII white space, and no special token holds
    any. A plain word's parts have a table of their own; any other word is encoded as a text.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(text)
    tok.no_truncation()
    tok.no_padding()
    model, char = tok.model, {b: c for c, b in byte_of_char().items()}
    special = tuple(t.content for t in tok.get_added_tokens_decoder().values())
    pack_ids = lambda ids: struct.pack(f"<{len(ids)}I", *ids)
    part = WordTable(lambda p: pack_ids([t.id for t in model.tokenize("".join([char[b] for b in p.encode()]))]), limit=120_000)

    def ids(word: bytes) -> bytes:
        w = word.decode()
        if word.isalpha():  # ASCII letters alone: one part
            part.trim()
            return part[w.lower()]
        if _PLAIN.fullmatch(w) and not ("<" in w and any(s in w for s in special)):
            out = b"".join([part[p] for p in _PARTS.findall(w.lower())])
            part.trim()
            return out
        return pack_ids(tok.encode(w, add_special_tokens=False).ids)

    return WordTable(ids)


def token_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``capacity`` ids; with ``with_ids`` also the ids themselves. ``tokenizer``: another
    file of the same rules; one that normalises or splits in another way is refused."""
    rows, text = ids_and_text(docs, id_col, text_col), tokenizer_text(tokenizer, "word_bpe_49k.json")
    refuse_other_rules(text, _NORMALIZER, _PRE_TOKENIZER, "word_bpe_49k.json")
    shared = rows.sparkSession.sparkContext.broadcast(text)
    schema = T.StructType([*PIECES, T.StructField("ids", T.ArrayType(T.IntegerType(), False))]) if with_ids else PIECES

    def run(batches):
        import numpy as np
        import pyarrow as pa

        table = word_table(shared.value)
        end = np.array([END_ID], "<u4").tobytes()
        kinds = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.list_(pa.int32()))] if with_ids else [])])
        for batch in batches:
            cols: list[list] = [[] for _ in kinds]
            texts = (t for part in slices(batch.column(1).cast(pa.binary())) for t in part)
            for doc, text in zip(batch.column(0).to_pylist(), texts):
                ids = b"".join(map(table.__getitem__, text.split())) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    row = [doc, k, at // 4, len(part) // 4, zlib.crc32(part)]
                    if with_ids:
                        row.append(np.frombuffer(part, "<u4").astype(np.int32))
                    for c, v in zip(cols, row):
                        c.append(v)
                table.trim()
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, kinds)], schema=kinds)

    return rows.mapInArrow(tidy(run), schema)


def plan_best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first rank, pieces, first sequence, offset, pieces a sequence)."""
    runs: list[tuple[int, int, int, int, int, int]] = []
    rooms: list[int] = []  # sorted rooms that some open sequence has
    open_: dict[int, list[tuple[int, int]]] = {}  # room -> (first sequence, sequences)
    sequences = 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in open_:
                open_[room] = []
                insort(rooms, room)
            open_[room].append((first, n))

    def place(length: int, rank: int, left: int, first: int, n: int, room: int) -> int:
        """Into n sequences with equal room, as many as fit into each; returns the pieces placed."""
        each = room // length
        full = min(n, left // each)
        if full:
            runs.append((length, rank, full * each, first, capacity - room, each))
            put(room - each * length, first, full)
        done = full * each
        rest = min(left - done, each) if full < n else 0
        if rest:
            runs.append((length, rank + done, rest, first + full, capacity - room, rest))
            put(room - rest * length, first + full, 1)
        used = full + bool(rest)
        put(room, first + used, n - used)
        return done + rest

    for length in sorted((n for n in counts if counts[n]), reverse=True):
        rank, left = 0, counts[length]
        while left:
            i = bisect_left(rooms, length)
            if i == len(rooms):
                n = -(-left // (capacity // length))
                placed = place(length, rank, left, sequences, n, capacity)
                sequences += n
            else:
                room = rooms[i]
                first, n = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[i]
                placed = place(length, rank, left, first, n, room)
            rank, left = rank + placed, left - placed
    return runs


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (any table with doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    spark: SparkSession = pieces.sparkSession
    # At most ``capacity`` rows.
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    runs = plan_best_fit(counts, capacity)
    spread = spark.createDataFrame([(n, math.isqrt(c - 1) + 1) for n, c in counts.items()], "length long, buckets long")
    plan = spark.createDataFrame(runs, "length long, first_rank long, n long, first_sequence long, at long, each long")
    dealt = pieces.join(F.broadcast(spread), "length").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), "buckets")).drop("buckets")
    before = (
        dealt.groupBy("length", "bucket")
        .count()
        .select("length", "bucket", (F.sum("count").over(W.partitionBy("length").orderBy("bucket")) - F.col("count")).alias("before"))
    )
    order = W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = (
        dealt.withColumn("place", F.row_number().over(order))
        .join(before, ["length", "bucket"])
        .withColumn("rank", F.col("before") + F.col("place") - 1)
    )
    p = (F.broadcast(plan) if len(runs) <= BROADCAST_RUNS else plan).withColumnRenamed("length", "run_length")
    k = F.col("rank") - F.col("first_rank")
    return ranked.join(
        p, (F.col("length") == F.col("run_length")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("n"))
    ).select(
        *PIECES.names,
        (F.col("first_sequence") + F.floor(k / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("at") + k % F.col("each") * F.col("length")).alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise (once: the pieces are kept in shared storage) and pack."""
    return pack(stash(token_pieces(docs, tokenizer, capacity, id_col=id_col, text_col=text_col), "pieces"), capacity)


def sequences(pieces_with_ids: DataFrame, packed: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id and its ids in order (at most the capacity each)."""
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    rows = pieces_with_ids.join(packed.dropDuplicates(key), key)
    return rows.groupBy("sequence_id").agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda s: s["ids"])).alias("ids")
    )


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
