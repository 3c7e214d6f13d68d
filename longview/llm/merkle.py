"""Merkle manifest of a table: a subtree for each source, a tree over the subtrees' roots, and a proof for every row.

Leaves lie in aligned blocks of FANOUT ** HEIGHT. A block hashes its own subtree; then blocks run a butterfly exchange: in every
round the aligned groups of FANOUT neighbouring groups swap their roots lane by lane, and every block hashes the parent for itself.
After the last round each block holds all that its rows' proofs need from above, and nothing has to be passed down again.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from longview.llm.common import table
from longview.operators.scan import OrderedScan
from longview.session import cut

FANOUT, HEIGHT = 3, 7
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
#: A level of a proof: the siblings left and right of the own node.
STEP = "struct<before:string,after:string>"
PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(fields: list[Column]) -> Column:
    """SHA-256 over the fields: ``-`` for null, else byte count, colon and value."""
    texts = [f.cast("string") for f in fields]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """doc_id, source, leaf and ``changed``: the leaf with ``tampered`` as text, null where that leaves the text alone."""
    fields = [F.col(c) for c in FIELDS]
    changed = F.lit(None).cast("string")
    if tampered is not None:
        changed = F.when(~tampered.eqNullSafe(F.col("text")), leaf([*fields[:-1], tampered]))
    return docs.select("doc_id", "source", leaf(fields).alias("leaf"), changed.alias("changed"))


def placed(rows: DataFrame, height: int) -> DataFrame:
    """``rows`` with ``key`` (the source, told apart from null), ``place`` (from 0, ascending by doc_id, then leaf) and ``block``."""
    own = rows.withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    ranked = OrderedScan(own, ["key"], ["doc_id", "leaf"]).row_number("_n").result()
    place = F.col("_n") - 1
    return ranked.select("doc_id", "key", "leaf", "changed", place.alias("place"), F.floor(place / FANOUT**height).alias("block"))


def tree(nodes: list[str], height: int | None) -> list[list[str]]:
    """The levels over ``nodes``: ``height`` of them above, or as many as it takes until one node is left."""
    levels = [nodes]
    while len(levels) <= height if height is not None else len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([digest("".join(last[i : i + FANOUT])) for i in range(0, len(last), FANOUT)])
    return levels


def fold(node: str, steps: list[tuple[str, str]]) -> str:
    for before, after in steps:
        node = digest(before + node + after)
    return node


def _swap(blocks: DataFrame) -> DataFrame:
    """One round: every block gets the roots of the other groups in its lane, hashes the parent, and notes its siblings.

    ``blocks`` has ``group`` (what becomes one node), ``digit`` (which of its parts this block is in), ``lane`` (its number in that
    part), ``size`` (blocks of the part) and ``lanes`` (those of the largest part of the group). A lane holds one block of each
    part at most; where a part is too short to have it, a block of the part stands in, so its root is sent more than once.
    """
    stands_in = F.sequence(F.col("lane"), F.col("lanes") - 1, F.col("size"))
    state = [c for c in blocks.columns if c not in ("group", "digit", "lane", "size", "lanes")]
    sent = blocks.select("group", "digit", F.explode(stands_in).alias("to"), "node", F.struct("lane", *state).alias("own"))
    sent = sent.withColumn("own", F.when(F.col("to") == F.col("own.lane"), F.col("own")))
    met = sent.groupBy("group", "to").agg(F.sort_array(F.collect_list(F.struct("digit", "node", "own"))).alias("parts"))
    each = met.select("parts", F.sha2(F.array_join(F.transform("parts", lambda p: p["node"]), "").cast("binary"), 256).alias("parent"),
                      F.explode("parts").alias("me")).where("me.own is not null")

    def side(test) -> Column:
        return F.array_join(F.transform(F.filter("parts", lambda p: test(p["digit"])), lambda p: p["node"]), "")

    step = F.struct(side(lambda d: d < F.col("me.digit")).alias("before"), side(lambda d: d > F.col("me.digit")).alias("after"))
    kept = [F.col(f"me.own.{c}").alias(c) for c in state if c not in ("node", "steps")]
    return each.select(*kept, F.col("parent").alias("node"), F.array_append("me.own.steps", step).alias("steps"))


def upper(blocks: DataFrame) -> DataFrame:
    """key, block, blocks (of the source), subroot, root and ``steps`` from the block's root upwards, of every block (key, block, alone,
    whole: its root if it is its source's only block, and if it is not).

    Rounds grow with the logarithm of the blocks of the largest source, then of the number of sources; all sources take a round
    together, and each round's table (one row a block) is written, so a lost executor costs one round.
    """
    sized = blocks.groupBy("key").agg(F.count(F.lit(1)).alias("blocks"))
    sources = cut(OrderedScan(sized, [], ["key"]).running(_to=F.col("blocks"), _rank=F.lit(1).cast("long")).result().select(
        "key", "blocks", (F.col("_to") - F.col("blocks")).alias("start"), (F.col("_rank") - 1).alias("rank")))
    n, most = sources.agg(F.count(F.lit(1)), F.max("blocks")).first()
    node = F.when(F.col("blocks") == 1, F.col("alone")).otherwise(F.col("whole"))
    rows = cut(blocks.join(sources, "key").select("key", "block", "blocks", "start", "rank", node.alias("node"), F.array().cast(f"array<{STEP}>").alias("steps")))
    width = 1
    while width < (most or 0):
        one, open_ = F.lit(width).cast("long"), F.col("blocks") > width
        part, full = F.floor(F.col("block") / one), F.floor((F.col("blocks") - 1) / one)
        size = F.when(part < full, one).otherwise(F.col("blocks") - full * one)
        alone = (part == full) & (part % FANOUT == 0)
        moved = _swap(rows.where(open_).select("*", F.struct("rank", F.floor(part / FANOUT).alias("at")).alias("group"), (part % FANOUT).alias("digit"),
                                               (F.col("block") % one).alias("lane"), size.alias("size"), F.when(alone, size).otherwise(one).alias("lanes")))
        rows = cut(moved.unionByName(rows.where(~open_)))
        width *= FANOUT
    rows, width = rows.withColumn("subroot", F.col("node")), 1
    while width < n:
        parts = sources.groupBy(F.floor(F.col("rank") / width).alias("part")).agg(F.min("start").alias("first"), F.sum("blocks").alias("size"))
        largest = parts.groupBy(F.floor(F.col("part") / FANOUT).alias("group")).agg(F.max("size").alias("lanes"))
        both = parts.withColumn("group", F.floor(F.col("part") / FANOUT)).join(largest, "group")
        state = rows.columns
        dealt = rows.withColumn("part", F.floor(F.col("rank") / width)).join(both, "part").select(
            *state, "group", (F.col("part") % FANOUT).alias("digit"), (F.col("start") + F.col("block") - F.col("first")).alias("lane"), "size", "lanes")
        rows = cut(_swap(dealt))
        width *= FANOUT
    return rows.select("key", "block", "blocks", "subroot", F.col("node").alias("root"), "steps")


def manifest(docs: DataFrame, tampered: Column | None = None, height: int = HEIGHT) -> DataFrame:
    """Leaf, subroot, root and proof of every row of ``docs`` (doc_id, source, lang, n_chars, text).

    Where ``tampered`` is given, the root is folded from the leaf with that text and the untampered siblings, and ``verified`` says
    whether it still is the root. Nulls in any column have a leaf of their own; a null doc_id comes first, as does the null source;
    rows of equal doc_id are ordered by their leaf, so repeated rows are alike. A table of one row has its leaf as root and a proof
    of nothing. Extra columns are not part of a leaf and are left out. However many rows a source has, a task holds one block.
    """
    rows = cut(placed(leaves(docs, tampered), height))

    def root_of(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = pdf.sort_values("place")["leaf"].tolist()
        return pd.DataFrame({"key": pdf["key"].iloc[:1], "block": pdf["block"].iloc[:1], "alone": [tree(nodes, None)[-1][0]], "whole": [tree(nodes, height)[-1][0]]})

    # Blocks are dealt by themselves: a join by source before would leave a whole source in one task.
    tops = cut(rows.select("key", "block", "place", "leaf").groupBy("key", "block").applyInPandas(root_of, "key string, block long, alone string, whole string"))

    def prove(own: pd.DataFrame, top: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("place", ignore_index=True)
        t = top.iloc[0]
        levels = tree(own["leaf"].tolist(), None if t["blocks"] == 1 else height)
        high = [(s["before"], s["after"]) for s in t["steps"]]
        ends: dict[str, str] = {}
        out = []
        for i, (doc, node, changed) in enumerate(zip(own["doc_id"], own["leaf"], own["changed"])):
            steps, at = [], i
            for level in levels[:-1]:
                first = at - at % FANOUT
                steps.append(("".join(level[first:at]), "".join(level[at + 1 : first + FANOUT])))
                at //= FANOUT
            proof = digest("".join(a + b for a, b in steps + high))
            mid = fold(changed if isinstance(changed, str) else node, steps)
            if mid not in ends:
                ends[mid] = fold(mid, high)
            out.append((doc, node, t["subroot"], t["root"], proof, ends[mid], ends[mid] == t["root"]))
        made = pd.DataFrame(out, columns=[c.split()[0] for c in PROOFS.split(", ")])
        return made.astype({"doc_id": "Int64"})

    ids = rows.select("key", "block", "place", "doc_id", "leaf", "changed")
    return ids.groupBy("key", "block").cogroup(upper(tops).groupBy("key", "block")).applyInPandas(prove, PROOFS)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every document.

    Where the CRC-32 of the decimal doc_id is even, the tampered text lacks its line feeds.
    """
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return manifest(docs, F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text")))


def _leaf_sql(text: str) -> str:
    parts = [f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in [*FIELDS[:-1], text]]
    return f"sha256({' || '.join(parts)})"


# CRC-32 of the decimal digits, bit by bit; its lowest bit says whether it is even.
_BYTE = "list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda v, b: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, xor(c, x))"
_CRC = f"xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT), lambda c, x: {_BYTE}, 4294967295::BIGINT), 4294967295)"
SQL = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT *, {_leaf_sql('text')} AS leaf,
    CASE WHEN {_CRC} % 2 = 0 AND contains(text, chr(10)) THEN {_leaf_sql("replace(text, chr(10), '')")} END AS changed FROM documents),
r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, row_number() OVER () AS row,
    count(*) OVER (PARTITION BY source) AS n FROM d),
low(source, level, place, h, n) AS (SELECT source, 0, place, leaf, n FROM r UNION ALL
  SELECT source, level + 1, place // 3, sha256(string_agg(h, '' ORDER BY place)), (any_value(n) + 2) // 3 FROM low WHERE n > 1 GROUP BY source, level, place // 3),
subroots AS MATERIALIZED (SELECT source, level AS depth, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM low WHERE n = 1),
high(level, place, h, n) AS (SELECT 0, place, h, n FROM subroots UNION ALL
  SELECT level + 1, place // 3, sha256(string_agg(h, '' ORDER BY place)), (any_value(n) + 2) // 3 FROM high WHERE n > 1 GROUP BY level, place // 3),
root AS (SELECT h FROM high WHERE n = 1),
own AS MATERIALIZED (SELECT r.row, s.source, s.depth, level, r.place // CAST(pow(3, level) AS BIGINT) AS mine, false AS above FROM r JOIN subroots s ON r.source IS NOT DISTINCT FROM s.source, unnest(range(s.depth)) t(level)
  UNION ALL SELECT r.row, s.source, s.depth, level, s.place // CAST(pow(3, level) AS BIGINT), true FROM r JOIN subroots s ON r.source IS NOT DISTINCT FROM s.source,
  unnest(range((SELECT max(level) FROM high))) t(level)),
steps AS MATERIALIZED (SELECT row, depth * o.above::INT + o.level AS step, coalesce(string_agg(h, '' ORDER BY place) FILTER (place < mine), '') AS before, coalesce(string_agg(h, '' ORDER BY place) FILTER (place > mine), '') AS after
  FROM own o JOIN (SELECT source, level, place, h, false AS above FROM low UNION ALL SELECT NULL, level, place, h, true FROM high) v
  ON v.above = o.above AND v.level = o.level AND v.place // 3 = mine // 3 AND (o.above OR v.source IS NOT DISTINCT FROM o.source) GROUP BY ALL),
folded(row, step, h) AS (SELECT row, 0, coalesce(changed, leaf) FROM r UNION ALL
  SELECT row, step + 1, sha256(before || h || after) FROM folded JOIN steps USING (row, step)),
proofs AS (SELECT row, sha256(string_agg(before || after, '' ORDER BY step)) AS proof FROM steps GROUP BY row),
ends AS (SELECT row, arg_max(h, step) AS h FROM folded GROUP BY row)
SELECT doc_id, leaf, s.h AS subroot, root.h AS root, coalesce(proof, sha256('')) AS proof_sha256, ends.h AS folded_root, ends.h = root.h AS verified
FROM r JOIN subroots s ON r.source IS NOT DISTINCT FROM s.source JOIN ends USING (row) LEFT JOIN proofs USING (row), root
"""

QUERIES = {"op11_merkle_manifest": (op11_merkle_manifest, SQL)}
