"""Prefix trie of conversations, with subtree totals by tree contraction.

A conversation is its sequence of turns (role, text) in order. Every distinct
sequence of the first d turns of some conversation is a node of depth d, from
the textless root on; the conversations that begin with it are its members,
and (smallest member, depth) names it.

* Texts are never moved: each turn becomes two 64-bit hashes and its length.
  Turns get their place by a range sort over all turns, so one conversation
  may hold any share of them: each sorted partition counts its own rows of a
  conversation, and a running sum over the partitions gives the offset.
* A prefix is the XOR of its turns' hashes, each taken with its place
  (2 x 64 bits). XOR runs within a partition and is carried on the same way.
* Subtree totals come from parallel tree contraction. A round rakes all
  leaves into their parents and compresses unary chains: a node with one
  child left, whose random number exceeds those of its parent and child, is
  taken out and the child keeps the amount between them. Rounds are joins by
  message: rows for one node meet in one pre-aggregated group-by, so a node
  of very many children is no hot key. Nodes taken out are expanded again in
  reverse order, each from the total of the child it was taken out over.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, held

#: Members' ids are hashed in runs of so many consecutive ids.
RUN = 4096

#: A node's children look up their parent in so many groups.
SLOTS = 256

Rule = Callable[[Column], Column]


def _xor(name: str) -> Column:
    return F.coalesce(F.bit_xor(name), F.lit(0).cast("long"))


def _marks(place: Column, a: Column, b: Column) -> tuple[Column, Column]:
    """Two hashes of a turn at its place."""
    return F.xxhash64(place, a, b), F.xxhash64(b, place, a, F.lit(7))


def placed_turns(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(part, c, pos, t1, t2, chars, total): every turn with its place in its
    conversation; turns of one conversation in one sorted partition share
    ``part``; total is the number of turns of the conversation."""
    role, text = F.coalesce(col(role_col), F.lit("")), F.coalesce(col(text_col), F.lit(""))
    rows = turns.select(
        col(conv_col).cast("long").alias("c"), col(turn_col).alias("turn"), role.alias("role"),
        F.sha2(text, 256).alias("sha"), F.length(text).cast("long").alias("chars"),
    ).where("c is not null").withColumn("row", F.monotonically_increasing_id())
    rows = rows.orderBy("c", F.asc_nulls_first("turn"), "role", "sha", "row").select(
        "c", F.xxhash64("role", "sha").alias("t1"), F.xxhash64("sha", "role", F.lit(1)).alias("t2"), "chars",
        F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"))
    rows = held(rows)
    pieces = rows.groupBy("part", "c").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    each = Window.partitionBy("c")
    before = each.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("part", "c", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"),
                           F.sum("n").over(each).alias("total"))
    return held(rows.join(pieces, ["part", "c"]).select(
        "part", "c", (F.col("row") + F.col("shift")).alias("pos"), "t1", "t2", "chars", "total"))


def rebuilt_steps(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str,
                  base: Rule | None, share: Rule | None, most: int) -> tuple[DataFrame, DataFrame]:
    """(steps, convs). ``convs`` has one row (c, n) per conversation, n its
    rebuilt turns. ``steps`` has one row per conversation and rebuilt turn:
    (c, depth, x1, x2, p1, p2, chars, n), the prefix that ends in it, the
    prefix before it and the turn's length."""
    placed = placed_turns(turns, conv_col, turn_col, role_col, text_col)
    c = F.col("c")
    h = share(c).cast("long") if share else F.lit(0).cast("long")
    convs = placed.groupBy("c").agg(F.max("total").alias("total")).withColumn("h", h)
    turn = "struct<pos:bigint,t1:bigint,t2:bigint,chars:bigint>"
    if base:   # of every conversation that others begin with, at most ``most`` turns
        wanted = convs.select(base(c).alias("c")).distinct()
        heads = placed.where(F.col("pos") < most).join(wanted, "c", "left_semi").groupBy("c").agg(
            F.array_sort(F.collect_list(F.struct("pos", "t1", "t2", "chars"))).alias("head"))
        convs = convs.withColumn("from", base(c)).join(heads.withColumnRenamed("c", "from"), "from", "left")
        head = F.filter("head", lambda t: t["pos"] < F.col("h"))
    else:
        head = F.lit(None)
    convs = convs.withColumn("head", F.coalesce(head, F.array()).cast(f"array<{turn}>"))
    mark = lambda k: F.aggregate(
        "head", F.lit(0).cast("long"), lambda a, t: a.bitwiseXOR(_marks(t["pos"], t["t1"], t["t2"])[k]))
    own = F.greatest(F.col("total") - F.col("h"), F.lit(0))
    convs = held(convs.select("c", "h", "head", F.size("head").cast("long").alias("n_head"),
                              (F.size("head") + own).alias("n"), mark(0).alias("h1"), mark(1).alias("h2")))

    # The first turns, from elsewhere: a few rows per conversation.
    g1, g2 = _marks(F.col("pos"), F.col("t1"), F.col("t2"))
    first = convs.select("c", "n", F.inline("head")).select("c", "n", "pos", "chars", g1.alias("g1"), g2.alias("g2"))
    so_far = Window.partitionBy("c").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    first = first.withColumns({"x1": F.bit_xor("g1").over(so_far), "x2": F.bit_xor("g2").over(so_far)})

    # The own turns. What holds for a conversation is joined by (part, c), so
    # that one conversation's rows stay dealt out.
    pieces = placed.select("part", "c").distinct().join(convs.drop("head"), "c")
    rest = placed.drop("total").join(pieces, ["part", "c"]).where("pos >= h")
    rest = rest.withColumn("pos", F.col("pos") - F.col("h") + F.col("n_head"))
    inside = Window.partitionBy("part", "c").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rest = rest.withColumns({"g1": g1, "g2": g2}).withColumns(
        {"l1": F.bit_xor("g1").over(inside), "l2": F.bit_xor("g2").over(inside)})
    rest = held(rest.select("part", "c", "n", "pos", "chars", "g1", "g2", "l1", "l2", "h1", "h2"))
    sums = rest.groupBy("part", "c").agg(F.bit_xor("g1").alias("s1"), F.bit_xor("g2").alias("s2"))
    before = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    sums = sums.select("part", "c", F.coalesce(F.bit_xor("s1").over(before), zero).alias("s1"),
                       F.coalesce(F.bit_xor("s2").over(before), zero).alias("s2"))
    rest = rest.join(sums, ["part", "c"]).withColumns({
        "x1": F.col("l1").bitwiseXOR(F.col("s1")).bitwiseXOR(F.col("h1")),
        "x2": F.col("l2").bitwiseXOR(F.col("s2")).bitwiseXOR(F.col("h2"))})
    columns = ["c", "n", (F.col("pos") + 1).alias("depth"), "x1", "x2", F.col("x1").bitwiseXOR(F.col("g1")).alias("p1"),
               F.col("x2").bitwiseXOR(F.col("g2")).alias("p2"), "chars"]
    return held(first.select(*columns).union(rest.select(*columns))), convs.select("c", "n")


def subtree_sums(tree: DataFrame, measures: list[str]) -> DataFrame:
    """(c, d, measures): for each node of a forest the sum of each measure
    over its subtree. ``tree``: c, d (the node's two-part id), pc, pd (its
    parent's, null for a root), k (number of children), kc, kd (XOR of their
    ids' parts) and the measures, as longs."""
    node = ["c", "d"]
    carry = [f"carry_{m}" for m in measures]
    zero = F.lit(0).cast("long")
    none = F.lit(None).cast("long")
    live = tree.select(*node, "pc", "pd", "k", "kc", "kd", *measures, *[zero.alias(x) for x in carry])
    raked, expand, turn = [], [], 0
    while True:
        # Rake: leaves leave and add what they hold to their parents.
        leaves = live.where("k = 0")
        raked.append(leaves.select(*node, *measures))
        sent = leaves.where("pc is not null").select(
            F.col("pc").alias("c"), F.col("pd").alias("d"), none.alias("pc"), none.alias("pd"), F.lit(-1).cast("long").alias("k"),
            F.col("c").alias("kc"), F.col("d").alias("kd"), *[(F.col(m) + F.col(x)).alias(m) for m, x in zip(measures, carry)],
            *[zero.alias(x) for x in carry])
        live = held(live.where("k > 0").union(sent).groupBy(*node).agg(
            F.max("pc").alias("pc"), F.max("pd").alias("pd"), F.sum("k").alias("k"), _xor("kc").alias("kc"),
            _xor("kd").alias("kd"), *[F.sum(x).alias(x) for x in measures + carry]))
        if live.isEmpty():
            break
        # Compress: of neighbours in a chain no two are taken out.
        draw = lambda a, b: F.xxhash64(F.lit(turn), a, b)  # noqa: B023, E731
        out = (F.col("k") == 1) & F.col("pc").isNotNull() & (draw("c", "d") > draw("kc", "kd")) & (draw("c", "d") > draw("pc", "pd"))
        out = F.coalesce(out, F.lit(False))
        new = {"up_c": none, "up_d": none, "out_c": none, "out_d": none, **{f"out_{m}": zero for m in measures}}
        full = [*node, "pc", "pd", "k", "kc", "kd", *measures, *carry, *new]
        stay = live.where(~out).withColumns(new).select(*full)
        gone = live.where(out)
        to_child = gone.select(
            F.col("kc").alias("c"), F.col("kd").alias("d"), none.alias("pc"), none.alias("pd"), zero.alias("k"), zero.alias("kc"),
            zero.alias("kd"), *[zero.alias(m) for m in measures], *[(F.col(m) + F.col(x)).alias(x) for m, x in zip(measures, carry)],
            F.col("pc").alias("up_c"), F.col("pd").alias("up_d"), F.col("c").alias("out_c"), F.col("d").alias("out_d"),
            *[F.col(x).alias(f"out_{m}") for m, x in zip(measures, carry)]).select(*full)
        to_parent = gone.select(
            F.col("pc").alias("c"), F.col("pd").alias("d"), none.alias("pc"), none.alias("pd"), zero.alias("k"),
            F.col("c").bitwiseXOR(F.col("kc")).alias("kc"), F.col("d").bitwiseXOR(F.col("kd")).alias("kd"),
            *[zero.alias(x) for x in measures + carry]).withColumns(new).select(*full)
        live = held(stay.union(to_child).union(to_parent).groupBy(*node).agg(
            F.coalesce(F.max("up_c"), F.max("pc")).alias("pc"), F.coalesce(F.max("up_d"), F.max("pd")).alias("pd"),
            F.sum("k").alias("k"), _xor("kc").alias("kc"), _xor("kd").alias("kd"), *[F.sum(x).alias(x) for x in measures + carry],
            F.max("out_c").alias("out_c"), F.max("out_d").alias("out_d"), *[F.sum(f"out_{m}").alias(f"out_{m}") for m in measures]))
        # A node taken out: its child's total and what the child now keeps,
        # without what the node itself kept for its own parent.
        expand.append(live.where("out_c is not null").select(
            "c", "d", "out_c", "out_d", *[(F.col(x) - F.col(f"out_{m}")).alias(f"more_{m}") for m, x in zip(measures, carry)]))
        live = live.drop("out_c", "out_d", *[f"out_{m}" for m in measures])
        turn += 1
    totals = raked[0]
    for more in raked[1:]:
        totals = totals.union(more)
    for again in reversed(expand):
        found = again.join(totals, node).select(
            F.col("out_c").alias("c"), F.col("out_d").alias("d"), *[(F.col(m) + F.col(f"more_{m}")).alias(m) for m in measures])
        totals = totals.union(held(found))
    return totals


def _run_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(depth, x1, x2, ends) of sorted runs (depth, x1, x2, run, ids)."""
    key, sha = None, None
    for batch in batches:
        done = []
        for *now, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if now == key:
                sha.update(b",")
            else:
                if key is not None:
                    done.append((*key, sha.hexdigest()))
                key, sha = now, hashlib.sha256()
            sha.update(ids.encode())
        if done:
            yield _hash_rows(done)
    if key is not None:
        yield _hash_rows([(*key, sha.hexdigest())])


def _hash_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], ["depth", "x1", "x2", "ends"])


def end_hashes(steps: DataFrame, convs: DataFrame) -> DataFrame:
    """(depth, x1, x2, ends): SHA-256 of the ids, ascending and joined by
    commas, of the conversations that end in each node where any does. Ids
    are joined in runs of ``RUN``; the runs of a node of several are hashed
    one after another as they stream by."""
    place = ["depth", "x1", "x2"]
    zero = F.lit(0).cast("long")
    ends = steps.where("depth = n").select(*place, "c").union(
        convs.where("n = 0").select(zero.alias("depth"), zero.alias("x1"), zero.alias("x2"), "c"))
    runs = held(ends.groupBy(*place, F.floor(F.col("c") / F.lit(RUN)).alias("run")).agg(
        F.array_join(F.array_sort(F.collect_list("c")), ",").alias("ids")))
    counts = runs.groupBy(*place).agg(F.count(F.lit(1)).alias("runs"), F.min("ids").alias("ids"))
    one = counts.where("runs = 1").select(*place, F.sha2(F.col("ids").cast("binary"), 256).alias("ends"))
    more = runs.join(counts.where("runs > 1").select(*place), place, "left_semi")
    more = more.repartition(*place).sortWithinPartitions(*place, "run").select(*place, "run", "ids")
    return one.union(more.mapInArrow(_run_hashes, "depth long, x1 long, x2 long, ends string"))


def conversation_trie(turns: DataFrame, base: Rule | None = None, share: Rule | None = None, most: int = 0,
                      conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                      text_col: str = "text") -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id
    (the parent's conv_id; null for the root), n_convs (members), n_children,
    n_leaves (childless nodes in the subtree), saved_tokens (over the subtree
    the sum of (n_convs - 1) x code points of the last turn's text) and
    ends_sha256 (of the ids of members that end here).

    Turns stand in the order of ``turn`` (null first); equal ones by role,
    then by the text's SHA-256; repeated rows are turns each. A null role or
    text is empty. Rows without a conversation id take no part; an empty
    table has no nodes. With ``base`` and ``share`` (0 to ``most``) each
    conversation c is rebuilt first: the first ``share(c)`` turns of
    conversation ``base(c)`` (fewer or none if it has not as many), then its
    own turns after its first ``share(c)``; a conversation left without turns
    is a member of the root. Texts are hashed whole, of any length. Further
    columns are not read.
    """
    steps, convs = rebuilt_steps(turns, conv_col, turn_col, role_col, text_col, base, share, most)
    place = ["depth", "x1", "x2"]
    zero = F.lit(0).cast("long")
    nodes = steps.groupBy(*place).agg(
        F.min("c").alias("c"), F.count(F.lit(1)).alias("n_convs"), F.first("chars").alias("chars"),
        F.first("p1").alias("p1"), F.first("p2").alias("p2"))
    root = convs.agg(F.min("c").alias("c"), F.count(F.lit(1)).alias("n_convs")).where("c is not null").select(
        zero.alias("depth"), zero.alias("x1"), zero.alias("x2"), "c", "n_convs", zero.alias("chars"),
        F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"))
    nodes = held(nodes.union(root).withColumn("slot", F.pmod(F.xxhash64("c"), F.lit(SLOTS))))
    # Children find their parent's name by (parent, slot), and are counted by
    # it, so a parent of very many children is dealt out.
    up = nodes.where("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2"),
                                         "slot", "c")
    slots = up.groupBy(*place, "slot").agg(F.count(F.lit(1)).alias("k"), F.bit_xor("c").alias("kc"))
    parents = slots.join(nodes.select(*place, F.col("c").alias("pc")), place)
    parents = parents.select((F.col("depth") + 1).alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), "slot", "pc")
    kids = slots.groupBy(*place).agg(F.sum("k").alias("k"), F.bit_xor("kc").alias("kc"))
    tree = nodes.join(parents, ["depth", "p1", "p2", "slot"], "left").join(kids, place, "left")
    k = F.coalesce("k", zero)
    tree = held(tree.select(
        *place, "c", F.col("depth").alias("d"), "pc", F.when(F.col("depth") > 0, F.col("depth") - 1).alias("pd"), "n_convs",
        k.alias("k"), F.coalesce("kc", zero).alias("kc"), F.when(k % 2 == 1, F.col("depth") + 1).otherwise(zero).alias("kd"),
        F.when(k == 0, 1).otherwise(0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved")))
    totals = subtree_sums(tree, ["leaves", "saved"])
    ends = end_hashes(steps, convs)
    return (
        tree.drop("leaves", "saved").join(totals, ["c", "d"]).join(ends, place, "left")
        .select(F.col("c").alias("conv_id"), "depth", F.col("pc").alias("parent_conv_id"), "n_convs", F.col("k").alias("n_children"),
                F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
                F.coalesce("ends", F.sha2(F.lit(b""), 256)).alias("ends_sha256"))
    )


#: The rebuilding of the registered query: conversations share first turns
#: with the first of their hundred.
def hundred(c: Column) -> Column:
    return c - c % 100


def drawn_share(c: Column) -> Column:
    return F.crc32(c.cast("string").cast("binary")) % 6


#: CRC-32 of a decimal number in DuckDB, bit by bit.
_CRC = """xor(list_reduce(
    list_prepend(4294967295, flatten(list_transform(string_split(CAST({c} AS VARCHAR), ''),
        lambda x: list_prepend(CAST(ord(x) AS BIGINT), [-1, -1, -1, -1, -1, -1, -1, -1])))),
    lambda a, o: CASE WHEN o >= 0 THEN xor(a, o) ELSE xor(a >> 1, (a & 1) * 3988292384) END), 4294967295)"""

#: DuckDB SQL for the registered query on ``conversations``: totals by
#: joining every node with all its ancestors.
SQL = f"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), h AS (
  SELECT c, n, c - c % 100 AS base, {_CRC.format(c="c")} % 6 AS h FROM (SELECT c, count(*) AS n FROM t GROUP BY c)
), r AS (
  SELECT h.c, t.pos + 1 AS depth, role, text FROM h JOIN t ON t.c = h.base AND t.pos < h.h
  UNION ALL
  SELECT h.c, t.pos - h.h + least(h.h, coalesce(b.n, 0)) + 1, role, text
  FROM h JOIN t ON t.c = h.c AND t.pos >= h.h LEFT JOIN h b ON b.c = h.base
), m AS (
  SELECT c, depth, length(text) AS chars,
         string_agg(sha256(concat(length(role), ':', role, text)), ',') OVER (PARTITION BY c ORDER BY depth) AS key
  FROM r
  UNION ALL SELECT c, 0, 0, '' FROM h
), n AS (
  SELECT depth, key, min(c) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars FROM m GROUP BY depth, key
), u AS (
  SELECT n.*, p.conv_id AS parent_conv_id, p.key AS up
  FROM n LEFT JOIN m ON m.c = n.conv_id AND m.depth = n.depth - 1
         LEFT JOIN n p ON p.depth = m.depth AND p.key = m.key
), k AS (
  SELECT up, depth - 1 AS depth, count(*) AS n_children FROM u WHERE depth > 0 GROUP BY ALL
), o AS (
  SELECT u.*, coalesce(k.n_children, 0) AS n_children FROM u LEFT JOIN k ON k.up = u.key AND k.depth = u.depth
), s AS (
  SELECT m.depth, m.key, CAST(sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves,
         CAST(sum((n_convs - 1) * o.chars) AS BIGINT) AS saved_tokens
  FROM o JOIN m ON m.c = o.conv_id AND m.depth <= o.depth GROUP BY ALL
), e AS (
  SELECT depth, key, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS ends
  FROM (SELECT *, max(depth) OVER (PARTITION BY c) AS last FROM m) WHERE depth = last GROUP BY ALL
)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
       coalesce(ends, sha256('')) AS ends_sha256
FROM o JOIN s USING (depth, key) LEFT JOIN e USING (depth, key)
"""
