import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from loam.llm import bpe, exact_dedup, line_dedup, packing, simhash


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def key(r):
    return tuple((v is None, v) for v in r)


# --- exact dedup


def brute_dedup(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((i, t or ""))
    out = []
    for norm, members in groups.items():
        best = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))
        out += [(i, best[0], len(members), (len(t), i) == (len(best[1]), best[0]), hashlib.sha256(norm.encode()).hexdigest()) for i, t in members]
    return sorted(out, key=key)


@pytest.mark.parametrize("salts", [1, 64])
def test_exact_dedup(spark, sf, odd, salts):
    for df in (documents(spark, sf), odd.repartition(5)):
        rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
        got = sorted(map(tuple, exact_dedup.exact_dedup(df, salts=salts).collect()), key=key)
        assert got == brute_dedup(rows)


def test_exact_dedup_compares_contents(spark, sf, odd, monkeypatch):
    """Texts of one digest are never one group; hot groups are joined by broadcast."""
    from pyspark.sql import functions as F

    from loam.llm import common

    last = spark.createDataFrame([(2**63 - 1, "a text"), (None, "a text"), (5, "b")], "doc_id long, text string")
    split = common.attach
    monkeypatch.setattr(exact_dedup, "attach", lambda *a: split(*a, least=2))
    for digests in (exact_dedup._digests, lambda norm: [F.length(norm) % 3, F.lit(1)]):
        monkeypatch.setattr(exact_dedup, "_digests", digests)
        for df in (documents(spark, sf), odd, last):
            rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
            assert sorted(map(tuple, exact_dedup.exact_dedup(df).collect()), key=key) == brute_dedup(rows)


def test_exact_dedup_empty(empty):
    assert exact_dedup.exact_dedup(empty).count() == 0


# --- packing


@pytest.fixture(scope="module")
def word_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_str(packing.tokenizer_text(None, "word_bpe_49k.json"))


def check_packing(rows, got, tok, capacity):
    want = Counter()
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            want[i, k // capacity, k, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for p in places.values():
        at = 0
        for offset, n in sorted(p):
            assert offset == at
            at += n
        assert at <= capacity
    total = sum(k[3] * n for k, n in want.items())
    return len(places), -(-total // capacity)


def test_packing(spark, sf, odd, word_tokenizer):
    for df, capacity in ((documents(spark, sf), 4096), (odd, 512)):
        rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
        got = packing.pack_documents(df, capacity=capacity).collect()
        used, least = check_packing(rows, got, word_tokenizer, capacity)
        assert used <= 1.05 * least + 1


def test_packing_empty(empty):
    assert packing.pack_documents(empty).count() == 0


def test_sequences_hold_the_pieces(spark):
    docs = spark.createDataFrame([(i, "lorem ipsum dolor " * (i % 7 + 1)) for i in range(40)], "doc_id long, text string")
    pieces = packing.token_pieces(docs, capacity=20, with_ids=True).cache()
    packed = packing.pack(pieces.drop("ids"), 20)
    full = packing.sequences(pieces, packed).collect()
    assert sum(len(r["ids"]) for r in full) == sum(len(r["ids"]) for r in pieces.collect()) and max(len(r["ids"]) for r in full) <= 20


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_plan_is_best_fit_decreasing(counts):
    bins: list[int] = []
    for n in sorted(counts, reverse=True):
        for _ in range(counts[n]):
            fits = [i for i, room in enumerate(bins) if room >= n]
            if fits:
                bins[min(fits, key=lambda i: bins[i])] -= n
            else:
                bins.append(64 - n)
    used: dict[int, list[tuple[int, int]]] = defaultdict(list)
    ranks = Counter()
    for length, rank, n, first, offset, each in packing.plan_best_fit(counts, 64):
        assert rank == ranks[length]
        ranks[length] += n
        for k in range(n):
            used[first + k // each].append((offset + k % each * length, length))
    assert ranks == Counter(counts) and len(used) == len(bins)
    for spans in used.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at = o + n
        assert at <= 64


ALPHABET = ["a", "Z", "é", "ß", "Ǆ", "Σ", "İ", "\u0301", "\x1c", "\x85", "\u00a0", "\u200b", "\u3000", "日", "ю", "'", "s", "'ll", "9", "٣", "½", ".", ",", "<|endoftext|>", "<|startoftext|>", "😀", " ", "  ", "\n", "\n\n", "\t", "\r\n", "-", "<", "|", "the", " of"]


def test_both_splits_equal_the_library(word_tokenizer):
    from tokenizers import Tokenizer

    text = bpe.tokenizer_text(None, "byte_bpe_50k.json")
    byte_tok, table, bytes_of = Tokenizer.from_str(text), bpe.piece_encoder(text), bpe.bytes_of_ids(text)
    words = packing.word_table(packing.tokenizer_text(None, "word_bpe_49k.json"))
    r = random.Random(11)
    for _ in range(6000):
        s = "".join(r.choice(ALPHABET) for _ in range(r.randint(0, 10)))
        ids = word_tokenizer.encode(s, add_special_tokens=False).ids
        assert b"".join(words[w] for w in s.encode().split()) == struct.pack(f"<{len(ids)}I", *ids), s
        enc = byte_tok.encode(s, add_special_tokens=False).ids
        assert [i for w in bpe.split_pieces(s) for i in table[w]] == enc, s
        assert b"".join(bytes_of[i] for i in enc).decode("utf-8", "replace") == byte_tok.decode(enc, skip_special_tokens=False)


# --- BPE


def test_tokenizers_of_other_rules_are_refused(spark):
    import public_tokenizers

    docs = spark.createDataFrame([(1, "It's A text")], "doc_id long, text string")
    words, pieces = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    assert packing.pack_documents(docs, words).count() == 1 and bpe.decode(bpe.encode(docs, pieces), pieces).first()["text"] == "It's A text"
    for make in (lambda: packing.pack_documents(docs, pieces), lambda: bpe.encode(docs, words), lambda: bpe.round_trip_digests(docs, words)):
        with pytest.raises(ValueError):
            make()


def test_bpe(spark, sf, odd):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(bpe.tokenizer_text(None, "byte_bpe_50k.json"))
    for df in (documents(spark, sf).limit(80), odd):
        df = df.cache()
        want = []
        for r in df.select("doc_id", "text").collect():
            ids = tok.encode(r["text"] or "", add_special_tokens=False).ids
            back = tok.decode(ids, skip_special_tokens=False)
            assert back == (r["text"] or "")
            want.append((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
        assert sorted(map(tuple, bpe.round_trip_digests(df).collect()), key=key) == sorted(want, key=key)
        round_trip = bpe.decode(bpe.encode(df))
        assert sorted(map(tuple, round_trip.collect()), key=key) == sorted(((r["doc_id"], r["text"] or "") for r in df.collect()), key=key)


def test_bpe_blocks_do_not_matter(spark, sf, monkeypatch):
    df = documents(spark, sf).limit(60).cache()
    whole = sorted(map(tuple, bpe.round_trip_digests(df).collect()))
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 3000)
    assert sorted(map(tuple, bpe.round_trip_digests(df.repartition(3)).collect())) == whole


def test_bpe_empty(empty):
    assert bpe.round_trip_digests(empty).count() == 0 and bpe.decode(bpe.encode(empty)).count() == 0


def test_word_table_is_bounded():
    from loam.llm.common import WordTable

    made = []
    t = WordTable(lambda w: made.append(w) or w, limit=10)
    for i in range(100):
        assert t["hot"] == "hot" and t[str(i)] == str(i)
        t.trim()
    assert len(t) <= 11 and len(t.old) <= 12 and made.count("hot") == 1


# --- SimHash


def brute_fingerprint(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[k : k + 4]), 42) for k in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if sum(v >> b & 1 for v in h) * 2 > len(h))


def brute_components(prints):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    v = np.array([prints[i] for i in ids], np.uint64)
    for k, i in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(v[k + 1 :] ^ v[k]) <= 4):
            a, b = find(i), find(ids[k + 1 + j])
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_documents(spark, sf, odd):
    for df in (documents(spark, sf), odd):
        rows = {r["doc_id"]: r["text"] or "" for r in df.collect()}
        prints = {i: brute_fingerprint(t) for i, t in rows.items()}
        comp = brute_components({i: p for i, p in prints.items() if i is not None})
        for r in simhash.near_duplicates(df).collect():
            if r["doc_id"] is None:
                assert r["component_id"] is None
                continue
            assert r["fingerprint"] == f"{prints[r['doc_id']]:016x}" and r["component_id"] == comp[r["doc_id"]]


def test_simhash_empty(empty):
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize(("bits", "lot"), [(8, 1 << 21), (8, 3000), (12, 60), (32, 1000)])
def test_links_of_fingerprints(spark, bits, lot):
    """A crowded neighbourhood, chains, and halves that agree; small lots split on further bits."""
    r = random.Random(4)
    centre = r.getrandbits(64)
    prints = {0: centre, 1: centre ^ (2**64 - 1), 2: (centre & 0xFFFFFFFF) | (r.getrandbits(32) << 32)}
    for i in range(3, 60):
        base = centre if i < 35 else prints[i - 1]
        prints[i] = base ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5)))
    signed = [(p - 2**64 if p >> 63 else p, i) for i, p in prints.items()]
    nodes = spark.createDataFrame(signed, "fp long, rep long").groupBy("fp").agg({"rep": "min"}).withColumnRenamed("min(rep)", "rep")
    links = simhash.variant_links(simhash.dealt_variants(nodes, bits, 4), bits, 4, lot).cache()
    comp = brute_components(prints)  # a bucket's links lead to the smallest member within reach
    assert all(r["a"] > r["b"] and comp[r["a"]] == comp[r["b"]] for r in links.collect())
    roots = {x["node"]: x["root"] for x in simhash.components(links).collect()}
    first = {}
    for i, p in sorted(prints.items()):
        first.setdefault(p, i)
    for i, p in prints.items():
        assert roots.get(first[p], first[p]) == comp[i]


def test_local_roots():
    r = random.Random(8)
    for n, m in ((2, 1), (50, 30), (300, 260), (400, 900)):
        links = [(r.randrange(n), r.randrange(n)) for _ in range(m)]
        root = list(range(n))

        def find(x):
            return x if root[x] == x else find(root[x])

        for x, y in links:
            root[max(find(x), find(y))] = min(find(x), find(y))
        got = dict(zip(*(x.tolist() for x in simhash.local_roots(*(np.array(x) for x in zip(*links))))))
        assert got == {x: find(x) for pair in links for x in pair if find(x) != x}
    path = np.arange(1000)
    assert set(simhash.local_roots(path[1:], path[:-1])[1].tolist()) == {0}


def test_balls_and_prefixes(spark):
    assert len(simhash.ball(64, 2)) == 2081 and len(set(simhash.ball(64, 2))) == 2081
    nodes = spark.range(3000).selectExpr("id AS fp", "id AS rep")  # all begin alike
    assert simhash.prefix_bits(nodes) == 8
    assert simhash.prefix_bits(nodes, most=1 << 20) == 32 and simhash.prefix_bits(nodes.limit(0)) == 8
    spread = spark.range(3000).selectExpr("xxhash64(id) AS fp", "id AS rep")
    assert 8 < simhash.prefix_bits(spread, size=1 << 12) < 16


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(900, 901), (901, 900)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, 901: 900}


# --- similar documents


M64 = 2**64 - 1


def brute_signature(text, words=5, tables=11, bits=40):
    def mix(x):
        x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & M64
        x = ((x ^ x >> 27) * 0x94D049BB133111EB) & M64
        return x ^ x >> 31

    toks = text.encode().lower().split()
    if not toks:
        return 0, (0,) * tables
    h = [xxhash.xxh64_intdigest(b" ".join(toks[k : k + words]), 42) for k in range(max(1, len(toks) - words + 1))]
    flags = ""
    for j in range(1, 2 + -(-tables * bits // 64)):
        mixed = [mix((v + j * 0x9E3779B97F4A7C15) & M64) for v in h]
        flags += "".join("1" if sum(v >> b & 1 for v in mixed) * 2 > len(h) else "0" for b in range(63, -1, -1))
    return int(flags[:64], 2), tuple(int(flags[64 + t * bits : 64 + (t + 1) * bits], 2) for t in range(tables))


def brute_similar(rows, check_bits=15):
    found = {i: brute_signature(t or "") for i, t in rows}
    root = {i: i for i in found}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(found)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            near = any((a ^ b).bit_count() <= 4 for a, b in zip(found[i][1], found[j][1]))
            if near and (found[i][0] ^ found[j][0]).bit_count() <= check_bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def edited(r, words, share):
    return [r.choice(WORDS) if r.random() < share else w for w in words]


WORDS = [f"w{k}" for k in range(5000)]


def jaccard(a, b):
    cut = lambda t: {tuple(t[k : k + 5]) for k in range(len(t) - 4)}
    return len(cut(a) & cut(b)) / len(cut(a) | cut(b))


def test_similar_documents_equal_brute_force(spark, odd):
    r = random.Random(9)
    base = [r.choice(WORDS) for _ in range(120)]
    rows = [(i, " ".join(edited(r, base, r.choice([0, 0.01, 0.03, 0.06])))) for i in range(60)]
    rows += [(100 + i, " ".join(r.choice(WORDS) for _ in range(r.randint(0, 9)))) for i in range(30)]
    made = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for df in (made, odd.filter("length(text) < 1000 or text is null")):
        data = [(x["doc_id"], x["text"]) for x in df.select("doc_id", "text").collect()]
        want = brute_similar([x for x in data if x[0] is not None])
        got = simhash.similar_documents(df).collect()
        assert len(got) == len(data)
        assert all(x["component_id"] == (None if x["doc_id"] is None else want[x["doc_id"]]) for x in got)
    assert len(set(want.values())) > 3


def test_similar_documents_on_whole_tables(spark, odd, empty):
    got = simhash.similar_documents(odd).collect()
    assert len(got) == odd.count() and {x["component_id"] for x in got if x["doc_id"] in (3, 4, 5)} == {3}
    assert simhash.similar_documents(empty).count() == 0


def test_similar_documents_recall(spark):
    """Pairs at a similarity of 0.8 or more link, unlike texts don't."""
    r = random.Random(12)
    rows, alike, apart = [], [], []
    for n in range(300):
        a = [r.choice(WORDS) for _ in range(r.choice([80, 200, 600]))]
        b = edited(r, a, r.choice([0.005, 0.01, 0.02, 0.03, 0.2]))
        j = jaccard(a, b)
        (alike if j >= 0.8 else apart if j <= 0.4 else []).append(n)
        rows += [(2 * n, " ".join(a)), (2 * n + 1, " ".join(b))]
    got = {x["doc_id"]: x["component_id"] for x in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    joined = [n for n in range(300) if got[2 * n] == got[2 * n + 1]]
    assert len(alike) > 100 and len(set(alike) & set(joined)) >= 0.95 * len(alike)
    assert len(apart) > 40 and not set(apart) & set(joined)
    assert all(got[i] in (i, i - 1) for i in got)


@pytest.mark.parametrize("lot", [1 << 21, 500])
def test_checked_links_in_a_crowd(lot):
    """A variant's smallest member may be refuted while others link."""
    r = random.Random(2)
    fp = np.array([r.getrandbits(40)] * 40 + [r.getrandbits(40) for _ in range(10)], np.uint64)
    fp[1:40] ^= np.array([sum(1 << b for b in r.sample(range(40), r.randint(0, 2))) for _ in range(39)], np.uint64)
    check = np.array([r.choice([0, 0xFFFF, 0xFFFFFFFF]) ^ r.getrandbits(5) for _ in range(50)], np.uint64)
    rep = np.arange(50)
    root = list(range(50))

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b in simhash.shared_variants(fp, rep, np.full(50, 2), 40, 4, lot, check, 15):
        for x, y in zip(a, b):
            assert (int(fp[x]) ^ int(fp[y])).bit_count() <= 8
            root[max(find(x), find(y))] = min(find(x), find(y))
    want = list(range(50))

    def top(x):
        return x if want[x] == x else top(want[x])

    for x in range(50):
        for y in range(x):
            if (int(fp[x]) ^ int(fp[y])).bit_count() <= 4 and (int(check[x]) ^ int(check[y])).bit_count() <= 15:
                want[max(top(x), top(y))] = min(top(x), top(y))
    assert [find(x) for x in range(50)] == [top(x) for x in range(50)]


# --- line dedup


def brute_lines(rows, min_docs=3, min_tokens=3, depth=3, constant=0.6):
    """Straight from the definition: every line in the tree, every document that holds it in full."""
    split = lambda s: re.split(r"[\x20\x09-\x0D]+", s.strip(" \t\n\x0b\x0c\r"))
    mask = lambda s: ["<*>" if re.search("[0-9]", t) else t for t in split(s)]
    leaf = lambda s: (len(split(s)), *mask(s)[:depth])
    low = lambda docs: min((x for x, own in docs if own is None), default=None)
    held = defaultdict(set)  # line -> documents: an id, or a row without one
    for n, (i, t) in enumerate(rows):
        for line in (t or "").split("\n"):
            if len(split(line)) >= min_tokens:
                held[line].add((i, n if i is None else None))
    drop = {s: low(docs) for s, docs in held.items() if len(docs) >= min_docs}
    tree = {s: docs for s, docs in held.items() if low(docs) is not None}
    slots, fields, words = defaultdict(set), defaultdict(set), defaultdict(set)
    around = lambda m, p: (m[p - 1] if p else "", m[p + 1] if p + 1 < len(m) else "")
    for s, docs in tree.items():
        m, at = mask(s), leaf(s)
        for p, t in enumerate(m):
            slots[at, p, t] |= docs
            fields[at, p, around(m, p)] |= docs
            words[at, p, around(m, p)].add(t)
    templates = defaultdict(list)
    for s in tree:
        m, at = mask(s), leaf(s)
        varies = lambda p, m=m, at=at: len(words[at, p, around(m, p)]) > 1 and len(fields[at, p, around(m, p)]) >= min_docs
        shape = [t if t != "<*>" and len(slots[at, p, t]) >= min_docs and not varies(p) else "<*>" for p, t in enumerate(m)]
        if sum(t != "<*>" for t in shape) >= constant * len(shape):
            templates[" ".join(shape)].append(s)
    for lines in templates.values():
        docs = set().union(*(tree[s] for s in lines))
        if len(docs) >= min_docs:
            drop |= {s: low(docs) for s in lines}
    out = []
    for i, t in rows:
        kept = [s for s in (t or "").split("\n") if i is None or s not in drop or drop[s] == i]
        changed = len(kept) != len((t or "").split("\n"))
        out.append((i, "\n".join(kept) if changed else t, len((t or "").split("\n")) - len(kept)))
    return sorted(out, key=key)


def test_line_dedup(spark, sf, odd):
    logs = [(100 + k, f"{name * 2} {name * 3} writes {name * 4} alone\nUser logged in as {name} from {k}.1.1.1 at {k}:00\nok fine") for k, name in enumerate(["ann", "bob", "cid", "dan"])]
    logs += [(200 + k, "All rights reserved here.\nAnother text altogether " + "z" * k) for k in range(4)]
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()] + logs
    for df in (documents(spark, sf), spark.createDataFrame(rows, "doc_id long, text string")):
        data = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
        got = sorted(map(tuple, line_dedup.drop_lines(df.select("doc_id", "text")).collect()), key=key)
        assert got == brute_lines(data)
    text = {i: t for i, t, _ in got}
    assert "logged in" in text[100] and "logged in" not in text[103] and "writes" in text[103]
    assert "reserved" in text[200] and "reserved" not in text[203]


def test_line_dedup_counts_documents_not_lines(spark):
    """Variants in one document count once; so do rows of one id, while a row without an id counts."""
    long = "Row 1 has value x\nRow 2 has value x\nRow 3 has value x"
    kept = lambda rows: {i: t for i, t, _ in line_dedup.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    two = [(1, long), (2, "Row 9 has value x"), (2, "Row 9 has value x")]
    assert kept(two) == dict(two)
    assert kept([*two, (3, "Row 7 has value x")]) == {1: long, 2: "", 3: ""}
    assert kept([*two[:2], (None, "Row 9 has value x")])[2] == ""


def lines_kept(spark, rows):
    return {i: t for i, t, _ in line_dedup.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_recurring_lines_stand_in_the_tree(spark):
    """A line of three documents and two variants in two others: one template of five documents."""
    rows = [(k, "User logged in as ann today") for k in (1, 2, 3)] + [(4, "User logged in as bob today"), (5, "User logged in as cid today")]
    assert lines_kept(spark, rows) == {1: rows[0][1], 2: "", 3: "", 4: "", 5: ""}
    # Variants that each recur are one template, and one copy stays.
    many = [(10 * k + j, f"Posted to the board by {name} this week") for k, name in enumerate(["ann", "bob", "cid", "dan"]) for j in (1, 2, 3)]
    assert [i for i, t in lines_kept(spark, many).items() if t] == [1]
    # Two documents alone hold no recurring template, however many lines they have of it.
    few = [(1, "\n".join(f"User logged in as {n} today" for n in ("ann", "bob", "cid", "dan"))), (2, "User logged in as eve today")]
    assert lines_kept(spark, few) == dict(few)
    assert lines_kept(spark, [*few, *few[1:] * 3]) == dict(few)


def test_line_dedup_on_made_logs(spark, monkeypatch):
    """Against brute force: fields of one word and of several, hot lines, prose; hot keys by broadcast as well."""
    from loam.llm import common

    r = random.Random(3)
    shapes = ["user {} logged in from {} at noon", "job {} took {} of the time", "the page was read by {} and {} again", "copyright of the town and of {} people", "a note without any field at all"]
    names = ["ann", "bob", "cid", "dan", "eve", "n1", "n2", "x9"]
    rows = []
    for i in range(90):
        lines = [s.format(r.choice(names), r.choice(names)) for s in r.sample(shapes, r.randint(0, 3))]
        lines += [" ".join(r.choice(["a", "note", "without", "the", "page", "field"]) for _ in range(r.randint(1, 5))) for _ in range(r.randint(0, 2))]
        rows.append((None if i % 17 == 0 else i // 2 if i % 5 == 0 else i, "\n".join(lines)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()
    rows = [tuple(x) for x in df.collect()]
    want = brute_lines(rows)
    assert sum(x[2] for x in want) > 50
    assert sorted(map(tuple, line_dedup.drop_lines(df).collect()), key=key) == want
    split = common.attach
    monkeypatch.setattr(line_dedup, "attach", lambda *a: split(*a, least=2))
    assert sorted(map(tuple, line_dedup.drop_lines(df).collect()), key=key) == want


def test_line_dedup_keeps_columns(odd, empty):
    got = line_dedup.drop_lines(odd)
    assert got.columns == [*odd.columns, "n_dropped"] and got.count() == odd.count()
    assert line_dedup.drop_lines(empty).count() == 0


def test_line_dedup_is_native(spark, sf):
    plan = line_dedup.drop_lines(documents(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
