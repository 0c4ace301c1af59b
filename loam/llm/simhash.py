"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Every distinct fingerprint of 64 bits emits all variants within half the radius (2081 within two
bits): two fingerprints at most four bits apart meet in a variant, and whoever shares one is at most
four bits apart. Variants are shuffled by their first bits: of the 2081, those that begin alike go to
the same bucket, so one row stands for all of them (37 rows a fingerprint for 8 bits). The bucket's
task writes the variants out, in lots of at most ``LOT`` by splitting on further bits, and links the
fingerprints that share one to the smallest of them; each link is verified. A variant's ball bounds
its members by 2081 fingerprints, so the work grows with the fingerprints alone, however crowded a
neighbourhood is. Copies of a fingerprint count once.

Components come from alternating large-star and small-star steps over stashed tables, until nothing
changes (after a number of rounds that grows with the logarithm of the longest path).

``similar_documents`` covers a wider radius than one fingerprint's ball can. At a similarity of 0.8
(Jaccard, shingles of five words) two texts differ in about 15 % of their fingerprint's bits, 10 of
64, and a ball of five bits has 8.3 million variants. So each text gets ``TABLES`` shorter
fingerprints of ``BITS`` bits and a check of 64 bits, all independent, from the same shingles. The
ball of each short fingerprint goes the way above; two texts link if some short fingerprint of theirs
differs in at most four bits and their checks in at most ``CHECK_BITS``. Members of a variant
are compared with its smallest one; where the check refutes one of them, the variant's members are
searched from one to the next, so that no link is lost. In numbers: a pair at similarity 0.8 meets in
one table with probability 0.25 and in one of eleven with 0.96, and passes the check with 0.97.

Defined results: null text is empty, its fingerprint zero, linked like any other; a row with a null
id gets its fingerprint, a null component and makes no link; repeated rows share fingerprint and
component; an empty table gives an empty result; other columns are ignored. ``similar_documents``
does the same; texts of fewer words than a shingle are one shingle, so they link if they are equal.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, ids_and_text, slices, stash, tidy

RADIUS = 4
WORDS = 4
SEED = 42
#: Variants that a task writes out at a time.
LOT = 1 << 21
#: Of ``similar_documents``: shingles, short fingerprints, their bits, and bits that checks may differ in.
SHINGLE = 5
TABLES = 11
BITS = 40
CHECK_BITS = 15


def shingle_hashes(text: bytes, words: int):
    """XXH64 of each shingle of the lower-cased words, repeats included; none for a text without words."""
    import numpy as np
    import xxhash

    digest = xxhash.xxh64_intdigest
    tokens = text.lower().split()  # of bytes: A-Z alone, and [\x20\x09-\x0D]
    if not tokens:
        return np.zeros(0, np.uint64)
    flat = b" ".join(tokens)
    ends, at = [], -1
    for t in tokens:
        at += len(t) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[:-1]]]
    if len(tokens) <= words:
        spans = [(0, len(flat))]
    else:
        spans = zip(starts[: len(tokens) - words + 1], ends[words - 1 :])
    return np.fromiter([digest(flat[a:b], SEED) for a, b in spans], np.uint64)


def fingerprints(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the 64 bits as a long)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def one(text: bytes) -> int:
            h = shingle_hashes(text, words)
            ones = np.zeros(64, np.int64)
            for k in range(0, len(h), 65536):  # bits from the highest, in bounded pieces
                part = h[k : k + 65536].astype(">u8")
                ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
            return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big", signed=True)

        for batch in batches:
            fps = [one(x) for part in slices(batch.column(1).cast(pa.binary())) for x in part]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return ids_and_text(docs, id_col, text_col).mapInArrow(tidy(run), "doc_id long, fp long")


def ball(bits: int, radius: int) -> list[int]:
    """Masks of at most ``radius`` of the bits."""
    return [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(bits), r)]


def prefix_bits(nodes: DataFrame, size: int = 1 << 21, most: int = 1 << 27) -> int:
    """Bits by which variants are dealt: buckets of about ``size`` variants, of at most ``most`` where
    fingerprints crowd (32 bits are the end). Results don't depend on it."""
    n, bits = nodes.count() * len(ball(64, RADIUS // 2)), 8
    while bits < 32 and n >> bits > size:
        bits += 1
    while bits < 32:
        crowd = nodes.groupBy(F.shiftrightunsigned("fp", 64 - bits).alias("p")).count().agg(F.max("count")).first()[0] or 0
        if crowd * len(ball(64, RADIUS // 2)) <= most:
            break
        bits += 4
    return min(bits, 32)


def dealt_variants(nodes: DataFrame, bits: int, radius: int) -> DataFrame:
    """bucket, fp, rep: a row for each prefix that variants of the fingerprint have."""
    masks = F.array(*[F.lit(m).cast("long") for m in ball(bits, radius // 2)])
    own = F.shiftrightunsigned("fp", 64 - bits)
    return nodes.select(F.explode(F.transform(masks, lambda m: own.bitwiseXOR(m))).alias("bucket"), "fp", "rep")


def linked_members(check, members, most: int):
    """(member, smallest of its component) where members link if their checks differ in at most ``most`` bits."""
    import numpy as np

    left = members
    while len(left) > 1:
        seed, left = left[0], left[1:]
        front = np.array([seed])
        while len(front) and len(left):
            near, step = np.zeros(len(left), bool), max(1, (1 << 22) // len(left))
            for a in range(0, len(front), step):
                near |= (np.bitwise_count(check[front[a : a + step], None] ^ check[left][None, :]) <= most).any(0)
            front, left = left[near], left[~near]
            if len(front):
                yield front, np.full(len(front), seed)


def shared_variants(fp, rep, left, bits: int, radius: int, lot: int, check=None, most: int = 64):
    """Links (a, b) of fingerprints that share a variant; ``left``: changes that each may still make in its
    last ``bits`` bits; with ``check``, of those whose checks differ in at most ``most`` bits."""
    import numpy as np

    many = [1, 1 + bits, 1 + bits + bits * (bits - 1) // 2]
    total = sum(int((left == r).sum()) * many[r] for r in range(3))
    if len(fp) < 2:
        return
    if total > lot and bits > 1:
        bit = (fp >> np.uint64(bits - 1)) & np.uint64(1)
        for side in (0, 1):
            own = bit == side
            keep = own | (left > 0)
            yield from shared_variants(fp[keep], rep[keep], (left - ~own)[keep], bits - 1, radius, lot, None if check is None else check[keep], most)
        return
    low = np.uint64((1 << bits) - 1) if bits < 64 else np.uint64(2**64 - 1)
    parts, owners = [], []
    for r in range(3):
        at = np.flatnonzero(left == r)
        if len(at):
            masks = np.array(ball(bits, r), np.uint64)
            parts.append(((fp[at] & low)[:, None] ^ masks[None, :]).ravel())
            owners.append(np.repeat(at, len(masks)))
    v, owner = np.concatenate(parts), np.concatenate(owners)
    flat = np.sort(v)
    twice = flat[1:][flat[1:] == flat[:-1]]
    if not len(twice):
        return
    twice = twice[np.append(True, twice[1:] != twice[:-1])]
    hit = twice[np.minimum(np.searchsorted(twice, v), len(twice) - 1)] == v
    v, owner = v[hit], owner[hit]
    order = np.lexsort((rep[owner], v))
    v, owner = v[order], owner[order]
    new = np.append(True, v[1:] != v[:-1])
    group = np.cumsum(new) - 1
    first = owner[np.flatnonzero(new)[group]]  # of each variant the member with the smallest id
    if check is not None:
        far = np.bitwise_count(check[owner] ^ check[first]) > most
        begins, done = np.append(np.flatnonzero(new), len(v)), set()
        for g in np.unique(group[far]):
            members = owner[begins[g] : begins[g + 1]]
            if len(members) > 2 and (same := members.tobytes()) not in done:
                done.add(same)
                for a, b in linked_members(check, members, most):
                    yield rep[a], rep[b]
        owner, first = owner[~far], first[~far]
    pairs = np.unique(np.stack([owner, first], 1)[owner != first], axis=0)
    near = np.bitwise_count(fp[pairs[:, 0]] ^ fp[pairs[:, 1]]) <= radius
    yield rep[pairs[near, 0]], rep[pairs[near, 1]]


def local_roots(a, b):
    """(member, smallest member of its component) of links within a task, roots themselves left out."""
    import numpy as np

    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v, low = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        new = low.copy()
        least = np.minimum(low[u], low[v])
        for ends in (u, v, low[u], low[v]):
            np.minimum.at(new, ends, least)
        new = new[new]
        if (new == low).all():
            break
        low = new
    moved = np.flatnonzero(low != np.arange(len(nodes)))
    return nodes[moved], nodes[low[moved]]


def variant_links(dealt: DataFrame, bits: int, radius: int, lot: int = LOT, width: int = 64, most: int | None = None) -> DataFrame:
    """For each bucket's fingerprints of ``width`` bits, (a, b): a fingerprint and the smallest that it
    reaches by links within the bucket; with ``most``, links are those whose column check differs in at
    most so many bits. The bucket's number ends with its prefix of ``bits`` bits."""
    names = ["bucket", "fp", "rep", *(["check"] if most is not None else [])]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def linked(kept):
            fp, rep, *check = (np.concatenate([k[c] for k in kept]) for c in range(1, len(names)))
            fp, prefix = fp.view(np.uint64), np.uint64(int(kept[0][0][0]) & ((1 << bits) - 1))
            off = np.bitwise_count((fp >> np.uint64(width - bits)) ^ prefix).astype(np.int64)
            more = (check[0].view(np.uint64), most) if check else ()
            found = list(shared_variants(fp, rep, radius // 2 - off, width - bits, radius, lot, *more))
            if found:
                a, b = local_roots(*(np.concatenate([f[k] for f in found]) for k in range(2)))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        kept: list = []
        for batch in batches:
            new = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(len(names))]
            if not len(new[0]):
                continue
            cuts = [0, *(np.flatnonzero(np.diff(new[0])) + 1), len(new[0])]
            for x, y in zip(cuts, cuts[1:]):
                part = [c[x:y] for c in new]
                if kept and kept[0][0][0] != part[0][0]:
                    yield from linked(kept)
                    kept = []
                kept.append([c.copy() for c in part])
        if kept:
            yield from linked(kept)

    return dealt.repartition("bucket").sortWithinPartitions("bucket").select(*names).mapInArrow(tidy(run), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of an edge (a, b) with the smallest node that it reaches."""
    now = stash(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    old = None
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stash(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stash(large, "large")
        low2 = stash(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        joined = large.join(low2, "u")
        small = joined.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        nxt = stash(small.select("e.u", "e.v").filter("u <> v").distinct(), "edges")
        discard(low, large, low2, now)
        mark = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        now = nxt
        if mark == old:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        old = mark


def near_duplicates(docs: DataFrame, radius: int = RADIUS, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (hex), component_id (the smallest doc_id reachable)."""
    if radius != RADIUS:
        raise ValueError("variants within two bits cover a radius of four")
    fps = stash(fingerprints(docs, words, id_col, text_col), "fps")
    nodes = stash(fps.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    bits = prefix_bits(nodes)
    roots = components(variant_links(dealt_variants(nodes, bits, radius), bits, radius))
    named = stash(nodes.join(roots, nodes["rep"] == roots["node"], "left").select("fp", F.coalesce("root", "rep").alias("component")), "named")
    discard(nodes)
    return fps.join(named, "fp", "left").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"),
    )


def signatures(docs: DataFrame, words: int = SHINGLE, tables: int = TABLES, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, check (64 bits) and fps, the short fingerprints; all zero for a text without words."""
    longs = 1 + -(-tables * bits // 64)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        step = np.arange(1, longs + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

        def mixed(h):
            """Independent words from a hash each, by a finaliser of 64 bits."""
            x = h[:, None] + step[None, :]
            x ^= x >> np.uint64(30)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(27)
            x *= np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
            return x

        def one(text: bytes):
            h = shingle_hashes(text, words)
            ones = np.zeros(64 * longs, np.int64)
            for k in range(0, len(h), 255 * 32):
                part = np.unpackbits(mixed(h[k : k + 255 * 32]).astype(">u8").view(np.uint8), axis=1)
                for a in range(0, len(part), 255):  # sums of at most 255 ones fit a byte
                    ones += np.add.reduce(part[a : a + 255], axis=0, dtype=np.uint8)
            flags = ones * 2 > len(h)
            own = int.from_bytes(np.packbits(flags[:64]).tobytes(), "big", signed=True)
            short = np.zeros((tables, 64), np.uint8)
            short[:, 64 - bits :] = flags[64 : 64 + tables * bits].reshape(tables, bits)
            return own, np.packbits(short, axis=1).view(">u8").ravel().astype(np.int64)

        for batch in batches:
            found = [one(x) for part in slices(batch.column(1).cast(pa.binary())) for x in part]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.list_(pa.int64()))], names=["doc_id", "check", "fps"])

    return ids_and_text(docs, id_col, text_col).mapInArrow(tidy(run), "doc_id long, check long, fps array<long>")


def table_prefix_bits(nodes: DataFrame, bits: int, size: int = 1 << 24, most: int = 1 << 27) -> int:
    """As ``prefix_bits``, for the short fingerprints: few bits, as every bit multiplies the rows that move."""
    n, ball_size, own = nodes.count() * len(ball(bits, RADIUS // 2)), len(ball(bits, RADIUS // 2)), 4
    while own < bits // 2 and n >> own > size:
        own += 1
    while own < bits // 2:
        cells = nodes.select(F.posexplode("fps").alias("t", "fp")).groupBy("t", F.shiftrightunsigned("fp", bits - own).alias("p")).count()
        if (cells.agg(F.max("count")).first()[0] or 0) * ball_size <= most:
            break
        own += 2
    return own


def dealt_tables(nodes: DataFrame, bits: int, own: int, radius: int) -> DataFrame:
    """bucket (table and prefix), fp, rep, check: a row for each prefix that variants of a short fingerprint have."""
    masks = F.array(*[F.lit(m).cast("long") for m in ball(own, radius // 2)])
    each = nodes.select("rep", "check", F.posexplode("fps").alias("t", "fp"), masks.alias("masks"))
    first = F.shiftrightunsigned("fp", bits - own)
    bucket = F.shiftleft(F.col("t").cast("long"), own)
    return each.select(F.explode(F.transform("masks", lambda m: bucket + first.bitwiseXOR(m))).alias("bucket"), "fp", "rep", "check")


def similar_documents(docs: DataFrame, words: int = SHINGLE, tables: int = TABLES, bits: int = BITS, check_bits: int = CHECK_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, component_id (the smallest doc_id reachable) of texts that are similar to about 0.8 or more."""
    own = stash(signatures(docs, words, tables, bits, id_col, text_col), "signatures")
    same = ["check", "fps"]
    nodes = stash(own.filter("doc_id is not null").groupBy(*same).agg(F.min("doc_id").alias("rep")), "nodes")
    prefix = table_prefix_bits(nodes, bits)
    roots = components(variant_links(dealt_tables(nodes, bits, prefix, RADIUS), prefix, RADIUS, width=bits, most=check_bits))
    named = stash(nodes.join(roots, nodes["rep"] == roots["node"], "left").select(*same, F.coalesce("root", "rep").alias("component")), "named")
    discard(nodes)
    return own.join(named, same, "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
