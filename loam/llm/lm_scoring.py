"""Language-model scoring by a hidden Markov model, learnt from all training documents.

A task turns its documents into blocks: a block's distinct words and, for each document, the
positions of its words in that list. Only distinct words of blocks are shuffled: their counts are
summed by word, partial sums first, and joined back to the blocks; words of over a ten-thousandth of
these rows are joined by broadcast (at most ten thousand of them). The model emits word classes (words of at most
four bytes by themselves, longer ones by their last three bytes, hashed to ``CLASSES``; the end has
its own) and, within a class, words by their smoothed counts, with one place for unknown words in
each. Baum-Welch counts are summed across partitions: each pass, ``START_PASSES`` and ``PASSES`` of
them, runs over every training document, from emissions at random around the corpus counts of the classes.

Defined results: null text is empty: its only token is the end; a null id counts as the empty text
in the choice of training documents; repeated rows give repeated results; with no training
document every count is zero; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import attach, give_back, ids_and_text, remainder, stash, tidy

CLASSES = 4096
STATES = 6
PASSES = 2
START_PASSES = 8
BLOCK_CHARS = 24_000_000
BLOCK_WORDS = 400_000

_BLOCKS = T.StructType(
    [
        T.StructField("block", T.LongType()),
        T.StructField("ix", T.IntegerType()),  # a word's row: its place, itself, class, count in training documents
        T.StructField("word", T.BinaryType()),
        T.StructField("cls", T.IntegerType()),
        T.StructField("n", T.LongType()),
        T.StructField("doc_id", T.ArrayType(T.LongType())),  # the block's own row
        T.StructField("held", T.ArrayType(T.BooleanType())),
        T.StructField("lens", T.ArrayType(T.IntegerType())),
        T.StructField("pos", T.BinaryType()),
        T.StructField("classes", T.BinaryType()),
    ]
)


def word_class(word: bytes) -> int:
    import zlib

    return zlib.crc32(word if len(word) <= 4 else b"~" + word[-3:]) % CLASSES


def _squeeze(a) -> bytes:
    import zstandard

    return zstandard.compress(a.astype("<u4").view("u1").reshape(-1, 4).T.tobytes(), 1)


def _open(data: bytes):
    import numpy as np
    import zstandard

    flat = np.frombuffer(zstandard.decompress(data), "u1") if data else np.zeros(0, "u1")
    return np.ascontiguousarray(flat.reshape(4, -1).T).view("<u4").ravel()


def blocks(docs: DataFrame, modulus: int, held_rest: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    rows = ids_and_text(docs, id_col, text_col).withColumn("held", remainder(F.col("doc_id"), modulus) == held_rest)

    def run(batches):
        from array import array

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        kinds = pa.schema([("block", pa.int64()), ("ix", pa.int32()), ("word", pa.binary()), ("cls", pa.int32()), ("n", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("lens", pa.list_(pa.int32())), ("pos", pa.binary()), ("classes", pa.binary())])

        class Places(dict):
            def __missing__(self, word):
                self[word] = at = len(self)
                return at

        def out(k, places, pos, ids, held, lens):
            block = task << 32 | k
            p = np.frombuffer(pos, np.uint32)
            words = list(places)
            trained = np.repeat(~np.array(held, bool), lens)
            n = np.bincount(p[trained], minlength=len(words)).astype(np.int64)
            cls = np.fromiter(map(word_class, words), np.int32, len(words))
            none = lambda t, m: pa.nulls(m, t)
            own = [pa.array([ids], kinds.field(5).type), pa.array([held], kinds.field(6).type), pa.array([lens], kinds.field(7).type), pa.array([_squeeze(p)], pa.binary()), pa.array([_squeeze(cls)], pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *[none(f.type, 1) for f in list(kinds)[1:5]], *own], schema=kinds)
            for a in range(0, len(words), 50_000):
                part = words[a : a + 50_000]
                m = len(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(m, block)), pa.array(np.arange(a, a + m, dtype=np.int32)), pa.array(part, pa.binary()), pa.array(cls[a : a + m]), pa.array(n[a : a + m]), *[none(f.type, m) for f in list(kinds)[5:]]],
                    schema=kinds,
                )

        k, size = 0, 0
        places, pos, ids, held, lens = Places(), array("I"), [], [], []
        for batch in batches:
            for doc, text, h in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
                words = text.lower().split()  # of bytes: A-Z alone, and [\x20\x09-\x0D]
                pos.extend(map(places.__getitem__, words))
                ids.append(doc)
                held.append(h)
                lens.append(len(words))
                size += len(text)
                if size >= BLOCK_CHARS or len(places) >= BLOCK_WORDS:
                    yield from out(k, places, pos, ids, held, lens)
                    k, size = k + 1, 0
                    places, pos, ids, held, lens = Places(), array("I"), [], [], []
        if ids:
            yield from out(k, places, pos, ids, held, lens)

    return rows.mapInArrow(tidy(run), _BLOCKS)


def _sequences(classes, pos, lens, chosen):
    """Symbols of the chosen documents, each with the end behind it, and their lengths."""
    import numpy as np

    lens = np.asarray(lens, np.int64)
    ends = np.cumsum(lens)
    symbols = np.insert(classes[pos].astype(np.int64), ends, CLASSES)
    keep = np.repeat(chosen, lens + 1)
    return symbols[keep], (lens + 1)[chosen]


def _train_rows(table):
    """(classes, pos, lens, held) of each block in an Arrow batch."""
    import numpy as np

    for r in table.to_pylist():
        yield _open(r["classes"]), _open(r["pos"]), r["lens"], np.array(r["held"], bool)


def train(own: DataFrame, symbol_counts, states: int = STATES, passes: int = PASSES):
    """The model after Baum-Welch over all training documents of the blocks' own rows, in ``START_PASSES``
    and ``passes`` rounds; ``symbol_counts``: each class's and the end's count in those documents."""
    import numpy as np

    from .hmm import Model

    spark = own.sparkSession
    data = own.select("block", "classes", "pos", "lens", "held")
    size = states * (CLASSES + 1)
    model = Model.first(states, symbol_counts)
    if not symbol_counts.any():
        return model

    def pack(start, step, emit):
        return np.concatenate([start, step.ravel(), emit.ravel()])

    def unpack(flat):
        return flat[:states], flat[states : states + states**2].reshape(states, states), flat[states + states**2 :].reshape(states, -1)

    def summed(df) -> np.ndarray:
        flat = np.zeros(states + states**2 + size)  # as many rows at most, whatever the corpus
        for r in df.groupBy("ix").agg(F.sum("v").alias("v")).collect():
            flat[r["ix"]] = r["v"]
        return flat

    def rows(flat):
        import pyarrow as pa

        at = np.flatnonzero(flat)
        return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(flat[at])], names=["ix", "v"])

    def count(shared):
        def run(batches):
            from loam.llm import hmm

            total = np.zeros(states + states**2 + size)
            for batch in batches:
                for classes, pos, lens, held in _train_rows(batch):
                    x, n = _sequences(classes, pos, lens, ~held)
                    total += pack(*hmm.expected_counts(hmm.Model(*shared.value), x, n)[:3])
            yield rows(total)

        return run

    for _ in range(START_PASSES + passes):
        shared = spark.sparkContext.broadcast((model.start, model.step, model.emit))
        model = Model.from_counts(*unpack(summed(data.mapInArrow(tidy(count(shared)), "ix int, v double"))))
    return model


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_documents(docs: DataFrame, modulus: int = 7, held_rest: int = 2, states: int = STATES, passes: int = PASSES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on the documents whose id's crc32 leaves another rest, score all."""
    import numpy as np

    spark = docs.sparkSession
    both = stash(blocks(docs, modulus, held_rest, id_col, text_col), "blocks")
    own = both.filter("ix is null")
    # Read apart, as both meet again at the end.
    words = spark.read.schema(both.schema).parquet(both.stash_path).filter("ix is not null").select("block", "ix", "word", "cls", "n")
    counts = stash(words.groupBy("word").agg(F.first("cls").alias("cls"), F.sum("n").alias("c"), F.count("*").alias("held_by")), "counts")
    # At most as many rows as there are classes.
    stats = counts.groupBy("cls").agg(F.sum("c").alias("c"), F.count_if(F.col("c") > 0).alias("v")).collect()
    counted = attach(words.select("block", "ix", "word"), counts.select("word", "c", "held_by"), ["word"], "held_by", words.count())
    n_cls, v_cls = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in stats:
        n_cls[r["cls"]], v_cls[r["cls"]] = r["c"], r["v"]
    ends = own.select(F.explode("held").alias("h")).filter("not h").count()
    total, distinct = int(n_cls.sum()) + ends, int(v_cls.sum()) + (ends > 0)
    model = train(own, np.append(n_cls, ends), states, passes)
    shared = spark.sparkContext.broadcast((model.start, model.step, model.emit, n_cls, v_cls))

    def run(payload, words):
        import pyarrow as pa

        from loam.llm import hmm

        give_back()  # the group before
        start, step, emit, in_class, kinds_in_class = shared.value
        r = payload.to_pylist()[0]
        classes, pos, lens = _open(r["classes"]), _open(r["pos"]), np.array(r["lens"], np.int64)
        c = np.zeros(len(classes))
        if words.num_rows:
            c[words.column("ix").to_numpy()] = words.column("c").to_numpy()
        floor = np.log10(total + distinct + 1)
        base = np.log10(c + 1) - floor
        within = np.log10(c + 1) - np.log10(in_class[classes] + kinds_in_class[classes] + 1)
        doc = np.repeat(np.arange(len(lens)), lens)
        add = lambda v: np.bincount(doc, weights=v[pos], minlength=len(lens))
        x, n = _sequences(classes, pos, lens, np.ones(len(lens), bool))
        ll = hmm.likelihoods(hmm.Model(start, step, emit), x, n) / np.log(10)
        return pa.table(
            {
                "doc_id": pa.array(r["doc_id"], pa.int64()),
                "held_out": pa.array(r["held"], pa.bool_()),
                "n_tokens": pa.array(n),
                "n_known": pa.array(add(c > 0).astype(np.int64) + (ends > 0)),
                "train_tokens": pa.array(np.full(len(lens), total)),
                "base_score": pa.array(add(base) + np.log10(ends + 1) - floor),
                "score": pa.array(ll + add(within)),
            }
        )

    payload = own.select("block", "doc_id", "held", "lens", "pos", "classes")
    return payload.groupBy("block").cogroup(counted.select("block", "ix", "c").groupBy("block")).applyInArrow(run, SCORES)


def op9_hmm_scoring(spark, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
