"""BPE encoding and decoding through a distinct-word table.

Texts are split at places where the byte-level pre-tokenizer must split too, so that a piece
encodes alike wherever it stands. A task turns its documents into blocks: the block's distinct
pieces and, for each document, their positions. The pieces are dealt by hash to the tasks of one
table for all blocks, which encode each distinct piece once; its ids go back to the blocks that hold
it and are joined to the positions. What moves are packed lists, one for each block and part of the
table, not a row a piece. Decoding joins ids to their bytes (a table as large as the vocabulary).

Defined results: null text is empty and has no ids; repeated rows give repeated results; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import WordTable, byte_of_char, give_back, ids_and_text, slices, stash, tidy
from .packing import refuse_other_rules, tokenizer_text

_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_LETTER = "A-Za-z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u024f"
_MARK = "!-/:-@\\[-`{-~"
#: Runs of one class, each with the space before it, if what follows is ASCII or the end (another
#: class for certain); else all up to white space; of white space before a word the last apart.
SPLIT = re.compile(
    f" ?[{_LETTER}]++(?![^\\x00-\\x7f])| ?[0-9]++(?![^\\x00-\\x7f])| ?(?!')[{_MARK}]++(?![^\\x00-\\x7f])| ?[^{_WS}]+|[{_WS}]+(?=[{_WS}][^{_WS}])|[{_WS}]+"
)
SPECIAL = "<|endoftext|>"
# Splitting as tokenizer files state it.
_PRE_TOKENIZER = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
#: A block ends with so many characters or distinct pieces.
BLOCK_CHARS = 32_000_000
BLOCK_PIECES = 500_000


def split_pieces(text: str) -> list[str]:
    """Pieces whose encodings, one after another, are the text's."""
    if SPECIAL not in text:
        return SPLIT.findall(text)
    out: list[str] = []
    for i, part in enumerate(text.split(SPECIAL)):
        out += ([SPECIAL] if i else []) + SPLIT.findall(part)
    return out


@functools.lru_cache(1)
def _tokenizer(text: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(text)
    tok.no_truncation()
    tok.no_padding()
    return tok


def piece_encoder(text: str):
    """Piece -> its ids, each distinct piece encoded once."""
    tok = _tokenizer(text)
    return WordTable(lambda w: tuple(tok.encode(w, add_special_tokens=False).ids), limit=500_000)


@functools.lru_cache(1)
def bytes_of_ids(text: str) -> dict[int, bytes]:
    """The vocabulary's table: id -> bytes."""
    char = byte_of_char()
    return {i: bytes(char[c] for c in w) if all(c in char for c in w) else w.encode() for w, i in _tokenizer(text).get_vocab(with_added_tokens=True).items()}


def _packed(numbers) -> bytes:
    """Unsigned 32-bit numbers by their bytes' places, squeezed."""
    import numpy as np
    import zstandard

    return zstandard.compress(np.asarray(numbers, "<u4").view("u1").reshape(-1, 4).T.tobytes(), 3)


def _unpacked(data: bytes):
    import numpy as np
    import zstandard

    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), "u1").reshape(4, -1).T).view("<u4").ravel()


def _packed_positions(ranks) -> bytes:
    """A byte each for the 255 most frequent pieces; the others' numbers stand behind, by bytes' places."""
    import numpy as np
    import zstandard

    rare = _packed(ranks[ranks >= 255] - 255)
    return len(rare).to_bytes(8, "little") + rare + zstandard.compress(np.minimum(ranks, 255).astype("u1").tobytes(), 3)


def _unpacked_positions(data: bytes):
    import numpy as np
    import zstandard

    n = int.from_bytes(data[:8], "little")
    out = np.frombuffer(zstandard.decompress(data[8 + n :]), "u1").astype(np.uint32)
    out[out == 255] = _unpacked(data[8 : 8 + n]) + 255
    return out


_BLOCKS = "block long, part int, pieces binary, doc_id array<bigint>, lens array<int>, pos binary, part_of binary"
_END = b"\xff"  # no UTF-8 text holds it


def _blocks(docs: DataFrame, parts: int, id_col: str, text_col: str) -> DataFrame:
    """A block's own row (part null), and a row for each part of the table with the pieces it gets."""

    def run(batches):
        import zlib
        from array import array

        import numpy as np
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()

        class Places(dict):
            def __missing__(self, piece):
                self[piece] = at = len(self)
                return at

        def out(k, places, pos, ids, lens):
            block = task << 32 | k
            flat = np.frombuffer(pos, np.uint32)
            often = np.argsort(-np.bincount(flat, minlength=len(places)), kind="stable")  # pieces by falling count
            rank = np.empty(len(often), np.uint32)
            rank[often] = np.arange(len(often), dtype=np.uint32)
            named = list(places)
            pieces = [named[i].encode() for i in often]
            part_of = np.fromiter((zlib.crc32(p) % parts for p in pieces), np.uint32, len(pieces))
            order = np.argsort(part_of, kind="stable")
            cuts = np.searchsorted(part_of[order], np.arange(parts + 1))
            rows = [(p, zstandard.compress(_END.join([pieces[i] for i in order[cuts[p] : cuts[p + 1]]]), 3)) for p in range(parts) if cuts[p] < cuts[p + 1]]
            n = len(rows)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n + 1, block)), pa.array([None, *[r[0] for r in rows]], pa.int32()), pa.array([None, *[r[1] for r in rows]], pa.binary()),
                    pa.array([ids, *[None] * n], pa.list_(pa.int64())), pa.array([lens, *[None] * n], pa.list_(pa.int32())),
                    pa.array([_packed_positions(rank[flat]), *[None] * n], pa.binary()), pa.array([_packed(part_of), *[None] * n], pa.binary()),
                ],
                names=["block", "part", "pieces", "doc_id", "lens", "pos", "part_of"],
            )

        k, size = 0, 0
        places, pos, ids, lens = Places(), array("I"), [], []
        for batch in batches:
            texts = (t for part in slices(batch.column(1)) for t in part)
            for doc, text in zip(batch.column(0).to_pylist(), texts):
                pieces = split_pieces(text)
                pos.extend(map(places.__getitem__, pieces))
                ids.append(doc)
                lens.append(len(pieces))
                size += len(text)
                if size >= BLOCK_CHARS or len(places) >= BLOCK_PIECES:
                    yield from out(k, places, pos, ids, lens)
                    k, size = k + 1, 0
                    places, pos, ids, lens = Places(), array("I"), [], []
        if ids:
            yield from out(k, places, pos, ids, lens)

    return ids_and_text(docs, id_col, text_col).mapInArrow(tidy(run), _BLOCKS)


def _encoded_blocks(docs: DataFrame, text: str, each, schema, id_col: str, text_col: str) -> DataFrame:
    """``each(doc_ids, lens, positions, ids of each distinct piece)`` gives the rows of a block."""
    import json

    refuse_other_rules(text, None, _PRE_TOKENIZER, "byte_bpe_50k.json")
    if [t["content"] for t in json.loads(text)["added_tokens"]] != [SPECIAL]:
        raise ValueError(f"the only added token that texts are split at is {SPECIAL}")
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared = spark.sparkContext.broadcast(text)
    both = stash(_blocks(docs, parts, id_col, text_col), "pieces")

    def encode_parts(batches):
        import pyarrow as pa
        import zstandard

        table = piece_encoder(shared.value)
        for batch in batches:
            out = []
            for data in batch.column(2).to_pylist():
                found = [table[p.decode()] for p in zstandard.decompress(data).split(_END)]
                out.append((_packed([len(f) for f in found]), _packed([i for f in found for i in f])))
                table.trim()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array([o[k] for o in out], pa.binary()) for k in range(2)]], names=["block", "part", "counts", "ids"])

    # The part is hashed once more by Spark, so some tasks get two parts and some none.
    dealt = both.filter("part is not null").select("block", "part", "pieces").repartition(parts, "part")
    coded = dealt.mapInArrow(tidy(encode_parts), "block long, part int, counts binary, ids binary")

    def join_positions(own, coded):
        import numpy as np

        give_back()  # the group before
        r = own.to_pylist()[0]
        part_of, pos = _unpacked(r["part_of"]), _unpacked_positions(r["pos"])
        ids: list = [()] * len(part_of)
        for c in coded.to_pylist():
            flat, cuts = _unpacked(c["ids"]).tolist(), np.concatenate([np.zeros(1, np.int64), np.cumsum(_unpacked(c["counts"]), dtype=np.int64)]).tolist()
            for k, at in enumerate(np.flatnonzero(part_of == c["part"]).tolist()):
                ids[at] = flat[cuts[k] : cuts[k + 1]]
        return each(r["doc_id"], r["lens"], pos, ids)

    own = both.filter("part is null").select("block", "doc_id", "lens", "pos", "part_of")
    return own.groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(join_positions, schema)


def encode(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the array of ids."""

    def each(doc_ids, lens, pos, ids):
        import numpy as np
        import pyarrow as pa

        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for p in pos.tolist() for i in ids[p]), np.int32)
        ends = np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)
        cuts = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes[pos], dtype=np.int64)])[ends]
        return pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "ids": pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(flat))})

    return _encoded_blocks(docs, tokenizer_text(tokenizer, "byte_bpe_50k.json"), each, "doc_id long, ids array<int>", id_col, text_col)


def decode(encoded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id and the text of its ids (null ids: empty)."""
    shared = encoded.sparkSession.sparkContext.broadcast(tokenizer_text(tokenizer, "byte_bpe_50k.json"))

    def run(batches):
        import pyarrow as pa

        table = bytes_of_ids(shared.value)
        for batch in batches:
            texts = [b"".join([table[i] for i in ids or ()]).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(tidy(run), "doc_id long, text string")


DIGESTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
)


def round_trip_digests(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text; digests of both, so that the ids needn't move again."""
    text = tokenizer_text(tokenizer, "byte_bpe_50k.json")
    shared = docs.sparkSession.sparkContext.broadcast(text)

    def each(doc_ids, lens, pos, ids):
        import pyarrow as pa

        table = bytes_of_ids(shared.value)
        # A piece's ids as text and as bytes, once for each distinct piece; positions put them together.
        written = ["".join([f"{i}," for i in p]) for p in ids]
        spelled = [b"".join([table[i] for i in p]) for p in ids]
        counts, ids_sha, text_sha, end = [], [], [], 0
        for n in lens:
            at = pos[end : end + n].tolist()
            end += n
            joined = "".join([written[k] for k in at])[:-1]
            back = b"".join([spelled[k] for k in at]).decode("utf-8", "replace")
            counts.append(joined.count(",") + 1 if joined else 0)
            ids_sha.append(hashlib.sha256(joined.encode()).hexdigest())
            text_sha.append(hashlib.sha256(back.encode()).hexdigest())
        return pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())})

    return _encoded_blocks(docs, text, each, DIGESTS, id_col, text_col)


def op8_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trip_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
