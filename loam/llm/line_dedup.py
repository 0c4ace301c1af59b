"""Line dedup by a log-template tree, in DataFrame functions alone.

Every line descends a tree of fixed depth: its token count, then its first ``depth`` tokens, with
tokens that hold a digit as the wildcard. Lines meet in a leaf, recurring ones among them. At a
position of a leaf, a token is a variable field, and becomes a wildcard, if fewer than ``min_docs``
documents have it there, or if between the same two neighbours there stand two different tokens or
more, in ``min_docs`` documents or more. What is left is the line's template, if at least
``min_constant`` of its tokens are constant. A template recurs if ``min_docs`` distinct documents
hold lines of it; its lines are dropped from all documents but the one with the smallest id. A line
without such a template is its own: it recurs if it stands as it is in ``min_docs`` documents.

Lines are identified by two hashes of 64 bits each, made once and kept in shared storage, and
identical ones are collapsed before they are grouped: a line that a third of all documents hold is
one row of the tree. As a line in ``min_docs`` documents settles every count that it enters, only
the documents of rarer lines are listed. Keys that hold over a ten-thousandth of the rows are joined
by broadcast (there are at most ten thousand of them), all others by shuffle. Text moves twice: for
the lines of leaves that hold several lines, and to rebuild the documents.

Defined results: null text is empty; lines of fewer than ``min_tokens`` tokens stay; of a document
without lines left the text is empty; a document's own repetitions don't count as recurring; rows
of one id share their dropped lines; a row with a null id counts but keeps its lines, and lines that
no other row has enter no tree; an empty table gives an empty result; other columns come along
unchanged in ``drop_lines``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, attach, discard, fresh, stash

MIN_DOCS = 3
MIN_TOKENS = 3
DEPTH = 3
MIN_CONSTANT = 0.6
WILD = "<*>"
_SPACE = r"[\x20\x09-\x0D]+"
_LINE = ["h1", "h2"]
_LEAF = ["leaf1", "leaf2"]


def _tokens(line: Column) -> Column:
    return F.split(F.trim(line, F.lit(ASCII_SPACE)), _SPACE)


def _masked(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.when(t.rlike("[0-9]"), F.lit(WILD)).otherwise(t))


def _two(names: list[str], *of) -> list[Column]:
    """Two independent hashes of 64 bits."""
    return [F.xxhash64(*of).alias(names[0]), F.xxhash64(F.lit("second"), *of).alias(names[1])]


def _leaf(tokens: str, depth: int) -> list[Column]:
    return _two(_LEAF, F.size(tokens), _masked(F.slice(tokens, 1, depth)))


def _light(docs: DataFrame, min_tokens: int, depth: int) -> DataFrame:
    """doc_id, row (of rows without an id), line and leaf of the distinct lines of each document that take part."""
    row = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).alias("row")
    lines = docs.select("doc_id", row, F.explode(F.array_distinct(F.split(F.coalesce("text", F.lit("")), "\n"))).alias("line"))
    return lines.withColumn("tokens", _tokens(F.col("line"))).filter(F.size("tokens") >= min_tokens).select("doc_id", "row", *_two(_LINE, "line"), *_leaf("tokens", depth))


def _branches(docs: DataFrame, light: DataFrame, lines: DataFrame, min_docs: int, depth: int) -> DataFrame:
    """h1, h2, first, docs (null if they are ``min_docs`` or more), tokens and leaf of the lines that share
    their leaf with others. Stashed."""
    named = lines.filter(F.col("first").isNotNull())
    full = named.groupBy(*_LEAF).agg(F.count("*").alias("n"), F.sum("n_docs").alias("held"))
    full = stash(full.filter(F.col("n") > 1).filter(F.col("held") >= min_docs).select(*_LEAF, "n"), "leaves")
    found = stash(attach(named, full, _LEAF, "n", named.count()).select(*_LINE, "first", "n_docs"), "found")
    rare = found.filter(F.col("n_docs") < min_docs).select(*_LINE)
    holders = light.join(rare, _LINE).groupBy(*_LINE).agg(F.collect_set(F.struct("doc_id", "row")).alias("docs"))  # fewer than min_docs each
    wanted = found.groupBy("first").agg(F.collect_set("h1").alias("wanted"))
    texts = docs.filter("doc_id is not null").join(wanted.hint("shuffle_hash"), F.col("doc_id") == F.col("first"))
    some = F.filter(F.array_distinct(F.split("text", "\n")), lambda x: F.array_contains("wanted", F.xxhash64(x)))
    own = texts.select(F.explode(some).alias("line")).select(*_two(_LINE, "line"), _masked(_tokens(F.col("line"))).alias("tokens"))
    own = own.dropDuplicates(_LINE).join(found.select(*_LINE, "first"), _LINE).join(holders, _LINE, "left")
    out = stash(own.select(*_LINE, "first", "docs", "tokens", *_leaf("tokens", depth)), "branches")
    discard(full, found)
    return out


def _recurring(at: DataFrame, key: list[str], min_docs: int, *more: Column) -> DataFrame:
    """Keys with ``min_docs`` distinct documents or more, ``more`` aggregates, and in ``n`` how many rows and
    documents of rare lines the key has (fewer than ``min_docs`` a row)."""
    each = at.withColumn("many", F.col("docs").isNull()).withColumn("doc", F.explode_outer("docs"))
    counted = each.groupBy(*key).agg(F.count("*").alias("n"), F.bool_or("many").alias("many"), F.count_distinct("doc").alias("rare"), *more)
    return counted.filter(F.col("many") | (F.col("rare") >= min_docs)).drop("many", "rare")


def _templates(own: DataFrame, min_docs: int, depth: int, min_constant: float) -> DataFrame:
    """h1, h2, docs, first, template of the lines that have one. Stashed."""
    beside = lambda d: F.coalesce(F.try_element_at("tokens", F.col("pos") + d), F.lit(""))
    at = own.select(*_LINE, *_LEAF, "docs", "tokens", F.posexplode("tokens").alias("pos", "token")).filter(F.col("pos") >= depth)
    at = at.select(
        *_LINE, "docs", "pos", (F.col("token") == WILD).alias("wild"),
        *_two(["slot1", "slot2"], *_LEAF, "pos", "token"), *_two(["field1", "field2"], *_LEAF, "pos", beside(0), beside(2)), F.xxhash64("token").alias("spelled"),
    )
    at = stash(at, "positions")
    rows = at.count() * max(1, min_docs - 1)
    slots = stash(_recurring(at.filter("not wild"), ["slot1", "slot2"], min_docs), "slots")
    varied = [F.min("spelled").alias("low"), F.max("spelled").alias("high")]
    fields = stash(_recurring(at, ["field1", "field2"], min_docs, *varied).filter("low <> high").drop("low", "high"), "fields")
    settled = stash(attach(at.filter("not wild").select(*_LINE, "pos", "slot1", "slot2", "field1", "field2"), slots, ["slot1", "slot2"], "n", rows), "settled")
    changing = attach(settled.drop("n"), fields, ["field1", "field2"], "n", rows).select(*_LINE, "pos", F.lit(1).alias("changes"))
    constant = settled.select(*_LINE, "pos").join(changing, [*_LINE, "pos"], "left_anti").groupBy(*_LINE).agg(F.collect_set("pos").alias("constant"))
    fixed = lambda t, i: (t != WILD) & ((i < depth) | F.coalesce(F.array_contains("constant", i), F.lit(False)))
    general = own.join(constant, _LINE, "left").withColumn("shape", F.transform("tokens", lambda t, i: F.when(fixed(t, i), t).otherwise(F.lit(WILD))))
    general = general.filter(F.size(F.filter("shape", lambda t: t != WILD)) >= min_constant * F.size("shape"))
    out = stash(general.select(*_LINE, "docs", "first", F.array_join("shape", " ").alias("template")), "general")
    discard(at, slots, fields, settled)
    return out


def drop_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS, depth: int = DEPTH, min_constant: float = MIN_CONSTANT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the recurring lines gone from the text, and n_dropped."""
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    light = stash(_light(plain, min_tokens, depth).distinct(), "light")  # rows of one id are one document
    lines = stash(light.groupBy(*_LINE, *_LEAF).agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first")), "lines")
    own = _branches(plain, light, lines, min_docs, depth)
    general = _templates(own, min_docs, depth, min_constant)
    held = _recurring(general, ["template"], min_docs, F.min("first").alias("keeper"))
    varied = stash(attach(general, stash(held, "templates"), ["template"], "n", general.count() * max(1, min_docs - 1)).select(*_LINE, "keeper"), "varied")
    exact = lines.filter(F.col("n_docs") >= min_docs).select(*_LINE, F.col("first").alias("keeper")).join(varied.select(*_LINE), _LINE, "left_anti")
    drop = stash(exact.union(varied).join(lines.select(*_LINE, "n_docs"), _LINE), "drop")
    own_id, own_gone = fresh(docs, "__id"), fresh(docs, "__gone")
    gone = (
        attach(light.filter("doc_id is not null").select("doc_id", *_LINE), drop, _LINE, "n_docs", light.count())
        .filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy("doc_id")
        .agg(F.collect_set("h1").alias(own_gone))
        .withColumnRenamed("doc_id", own_id)
    )
    discard(lines, own, general, varied)
    parts = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    kept = F.filter(parts, lambda x: ~F.array_contains(own_gone, F.xxhash64(x)))
    hit = F.col(own_gone).isNotNull()
    out = docs.filter(F.col(id_col).isNotNull()).join(gone.hint("shuffle_hash"), F.col(id_col) == F.col(own_id), "left")
    out = out.select(
        *[F.when(hit, F.array_join(kept, "\n")).otherwise(F.col(c)).alias(c) if c == text_col else F.col(c) for c in docs.columns],
        F.when(hit, F.size(parts) - F.size(kept)).otherwise(F.lit(0)).cast("long").alias("n_dropped"),
    )
    return out.unionByName(docs.filter(F.col(id_col).isNull()).withColumn("n_dropped", F.lit(0).cast("long")))


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = drop_lines(docs)
    return out.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "n_dropped")


OP2_SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT DISTINCT doc_id, unnest(parts) AS line FROM d),
k AS (
  SELECT doc_id, line, list_transform(
           regexp_split_to_array(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '[\x20\x09-\x0D]+'),
           lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS m
  FROM l),
held AS (SELECT doc_id, line, m, len(m) || '|' || array_to_string(m[1:3], ' ') AS leaf FROM k WHERE len(m) >= 3),
spot AS (SELECT doc_id, line, leaf, m, unnest(range(1, len(m) + 1)) AS pos FROM held),
seen AS (SELECT doc_id, line, leaf, pos, m[pos] AS token, coalesce(m[pos - 1], '') AS prev, coalesce(m[pos + 1], '') AS nxt FROM spot),
common AS (SELECT leaf, pos, token FROM seen WHERE token <> '<*>' GROUP BY ALL HAVING count(DISTINCT doc_id) >= 3),
field AS (SELECT leaf, pos, prev, nxt FROM seen GROUP BY ALL HAVING count(DISTINCT token) >= 2 AND count(DISTINCT doc_id) >= 3),
constant AS (
  SELECT line, list(DISTINCT pos) AS kept
  FROM (SELECT * FROM seen ANTI JOIN field USING (leaf, pos, prev, nxt)) JOIN common USING (leaf, pos, token) GROUP BY line),
general AS (
  SELECT doc_id, line, array_to_string(list_transform(range(1, len(m) + 1),
           lambda i: CASE WHEN list_contains(kept, i) THEN m[i] ELSE '<*>' END), ' ') AS template
  FROM held JOIN constant USING (line) WHERE len(kept) >= 0.6 * len(m)),
recurring AS (SELECT template, min(doc_id) AS keeper FROM general GROUP BY template HAVING count(DISTINCT doc_id) >= 3),
varied AS (SELECT DISTINCT line, keeper FROM general JOIN recurring USING (template)),
exact AS (SELECT line, min(doc_id) AS keeper FROM held GROUP BY line HAVING count(*) >= 3),
gone AS (SELECT * FROM varied UNION ALL SELECT * FROM exact WHERE line NOT IN (SELECT line FROM varied)),
p AS (SELECT doc_id, unnest(range(len(parts))) AS place, unnest(parts) AS line FROM d),
marked AS (SELECT p.*, keeper IS NOT NULL AND keeper IS DISTINCT FROM doc_id AS cut FROM p LEFT JOIN gone USING (line))
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT cut), '') AS text,
       count(*) FILTER (cut)::BIGINT AS n_dropped
FROM marked GROUP BY doc_id
"""
