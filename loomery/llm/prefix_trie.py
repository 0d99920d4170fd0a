"""A trie of conversation prefixes by SQL ROLLUP over positional turn-id columns.

Turns are ranked within their conversations by a range sort (counts of a conversation's rows in earlier ranges are added, so no
task ever holds a whole conversation). Blocks of ``BLOCK`` turns become rows with a column for each position. ``GROUP BY block, key of the prior block's
node, ROLLUP (t0, t1, ...)`` makes a row for each prefix that ends in a block, whatever its number, in one pass: a long
conversation continues in further blocks, whose key is an XOR of position-bound hashes of all turns before (128 bits, beside the depth).

Sums over subtrees need no walk through the tree. Every node is owned by its smallest member; a conversation owns the end of its path, from
the depth below its branching from a smaller conversation's path. So each node's subtree is covered by its members' own parts, and a second ROLLUP adds those up.

Edge cases: rows without a conv_id take no part. A null role or text is empty. Turns of equal number are ordered by role, by the first 100
characters and by the turn's hash; repeated rows are turns of their own. Extra columns are ignored. A conversation whose rebuilt turns are none is a member of the root. An empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize

#: Turns of a block, and blocks of a chunk: within a chunk prefixes are added up by a window, beyond it by chunk totals.
BLOCK, CHUNK = 8, 512
#: Conversations of one digested piece.
PIECE = 4096
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def turn_positions(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ranges of ranked turns: (conv_id, range, at, t) and (conv_id, range, first, carry, n); a turn's position from 0 is at - first + carry.

    ``t`` is a turn's id: 128 bits of the SHA-256 of role and text, and the text's code points.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    h = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 32))
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.substring(text, 1, 100).alias("start"), F.struct(h.alias("h"), F.char_length(text).cast("long").alias("n")).alias("t"), F.monotonically_increasing_id().alias("salt")
    )
    order = [F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("start"), F.asc("t"), F.asc("salt")]
    ranked = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", F.monotonically_increasing_id().alias("at"), "t"))
    ranked = ranked.withColumn("range", F.shiftright("at", 33))
    cells = ranked.groupBy("conv_id", "range").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = W.partitionBy("conv_id").orderBy("range")  # a row for each range at most
    return ranked, cells.withColumn("carry", F.sum("n").over(earlier) - F.col("n"))


def rebuild(conversations: DataFrame, every: int = 100, heads: int = 6) -> DataFrame:
    """conv_id, pos, t and length of every rebuilt conversation's turns; one row without a turn for a conversation that has none.

    The first h turns are those of conversation c - c % ``every``, the others c's own after its first h; h = crc32(c) % ``heads``.
    """
    ranked, cells = turn_positions(conversations)
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("long")
    base = ranked.filter(F.col("conv_id") % every == 0).join(cells, ["conv_id", "range"]).withColumn("pos", F.col("at") - F.col("first") + F.col("carry")).filter(F.col("pos") < heads - 1)
    base = base.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "t"))).alias("lead")).select(F.col("conv_id").alias("base"), "lead")  # heads - 1 turns at most
    convs = cells.groupBy("conv_id").agg(F.sum("n").alias("own")).withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % every})
    none = F.array().cast(base.schema["lead"].dataType)
    convs = convs.join(base, "base", "left").withColumn("lead", F.when(F.col("lead").isNull() | (F.col("h") == 0), none).otherwise(F.slice("lead", 1, F.greatest(F.col("h"), F.lit(1)).cast("int"))))
    convs = convs.withColumn("k", F.size("lead").cast("long")).withColumn("length", F.col("k") + F.greatest(F.lit(0), F.col("own") - F.col("h")))
    convs = materialize(convs.select("conv_id", "h", "k", "length", "lead"))
    led = convs.select("conv_id", "length", F.explode("lead").alias("x")).select("conv_id", "x.pos", "x.t", "length")
    own = ranked.join(cells.join(convs.drop("lead"), "conv_id"), ["conv_id", "range"]).withColumn("pos", F.col("at") - F.col("first") + F.col("carry")).filter("pos >= h")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "t", "length")
    bare = convs.filter("length = 0").select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(None).cast(ranked.schema["t"].dataType).alias("t"), "length")
    return led.unionByName(own).unionByName(bare)


def _mark(seed: int, pos: Column, h: Column) -> Column:
    return F.when(h.isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(F.lit(seed), pos.cast("long"), h))


def blocks(rebuilt: DataFrame, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """A row for each conversation and block: turn ids t0, t1, ..., the prior node's key (p1, p2) with its characters (before), the block's own marks (z1, z2), length and total characters of the conversation."""
    size = block * chunk
    rows = rebuilt.withColumns({"block": F.expr(f"pos div {block}"), "chunk": F.expr(f"pos div {size}")}).repartition("conv_id", "chunk")
    rows = rows.groupBy("conv_id", "chunk", "block").agg(
        F.sort_array(F.collect_list(F.struct("pos", "t"))).alias("turns"), F.bit_xor(_mark(1, F.col("pos"), F.col("t.h"))).alias("z1"), F.bit_xor(_mark(2, F.col("pos"), F.col("t.h"))).alias("z2"), F.coalesce(F.sum("t.n"), F.lit(0)).alias("chars"), F.max("length").alias("length"),
    )
    own = W.partitionBy("conv_id", "chunk")
    before = own.orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    over = lambda f, c: F.coalesce(f(c).over(before), F.lit(0).cast("long"))
    placed = rows.withColumns({"p1": over(F.bit_xor, "z1"), "p2": over(F.bit_xor, "z2"), "before": over(F.sum, "chars"), "total": F.sum("chars").over(own)})
    # Only conversations of several chunks take more from their other chunks: a row for each chunk.
    sums = rows.filter(F.col("length") > size).groupBy("conv_id", "chunk").agg(F.bit_xor("z1").alias("z1"), F.bit_xor("z2").alias("z2"), F.sum("chars").alias("chars"))
    whole = W.partitionBy("conv_id")
    earlier = whole.orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("conv_id", "chunk", *[F.coalesce(f(c).over(earlier), F.lit(0).cast("long")).alias(f"c_{c}") for f, c in ((F.bit_xor, "z1"), (F.bit_xor, "z2"), (F.sum, "chars"))], F.sum("chars").over(whole).alias("c_total"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    return placed.join(sums, ["conv_id", "chunk"], "left").select(
        "conv_id", "block", "length", F.coalesce("c_total", "total").alias("total"), F.col("p1").bitwiseXOR(zero("c_z1")).alias("p1"), F.col("p2").bitwiseXOR(zero("c_z2")).alias("p2"), (F.col("before") + zero("c_chars")).alias("before"), "z1", "z2",
        *[F.get("turns", F.lit(i))["t"].alias(f"t{i}") for i in range(block)],
    )


def _prefixes(rows: DataFrame, aggregates: str, block: int) -> DataFrame:
    """One row for each node: depth, key (k1, k2), parent's key (q1, q2), characters before the last turn (pre), and the aggregates over its members."""
    turns = [f"t{i}" for i in range(block)]
    found = rows.sparkSession.sql(f"select block, p1, p2, before, {', '.join(turns)}, {block} - bit_count(grouping_id()) as k, {aggregates} from {{rows}} group by block, p1, p2, before, rollup ({', '.join(turns)})", rows=rows)
    last = reduce(lambda c, i: F.when(F.col("k") == i + 1, F.col(turns[i])).otherwise(c), range(block), F.lit(None).cast(rows.schema["t0"].dataType))
    found = found.withColumn("last", last).filter(F.col("last").isNotNull() | ((F.col("k") == 0) & (F.col("block") == 0)))
    at = lambda i: F.col("block") * block + i
    key = lambda seed, n: reduce(lambda c, i: c.bitwiseXOR(F.when(n > i, _mark(seed, at(i), F.col(turns[i])["h"])).otherwise(F.lit(0).cast("long"))), range(block), F.col(f"p{seed}"))
    pre = reduce(lambda c, i: c + F.when(F.col("k") - 1 > i, F.col(turns[i])["n"]).otherwise(0), range(block), F.col("before"))
    keys = {"depth": F.col("block") * block + F.col("k"), "k1": key(1, F.col("k")), "k2": key(2, F.col("k")), "q1": key(1, F.col("k") - 1), "q2": key(2, F.col("k") - 1), "pre": pre}
    return found.withColumns(keys).drop("block", "p1", "p2", "before", "k", "last", *turns)


def _ends(rows: DataFrame, block: int) -> DataFrame:
    """depth, k1, k2 and the digest of the ascending ids of the conversations that end there. Ids meet in pieces; a task streams a node's pieces in order."""
    here = rows.filter(F.col("length") <= (F.col("block") + 1) * block).select(F.col("length").alias("depth"), F.col("p1").bitwiseXOR(F.col("z1")).alias("k1"), F.col("p2").bitwiseXOR(F.col("z2")).alias("k2"), "conv_id")
    pieces = here.groupBy("depth", "k1", "k2", F.floor(F.col("conv_id") / F.lit(PIECE)).alias("piece")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("ids"))
    order = ["depth", "k1", "k2", "piece"]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, node, h = ["depth", "k1", "k2", "ends_sha256"], None, None
        made: list[tuple] = []
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names)
        for batch in batches:
            *keys, ids = (batch.column(c).to_pylist() for c in ("depth", "k1", "k2", "ids"))
            for *own, text in zip(*keys, ids, strict=True):
                if own == node:
                    h.update(b"," + text.encode())
                    continue
                if node:
                    made.append((*node, h.hexdigest()))
                node, h = own, hashlib.sha256(text.encode())
            if made:
                yield pack()
                made.clear()
        if node:
            made.append((*node, h.hexdigest()))
            yield pack()

    return pieces.repartition("depth", "k1", "k2").sortWithinPartitions(*order).select("depth", "k1", "k2", "ids").mapInArrow(stream, "depth bigint, k1 bigint, k2 bigint, ends_sha256 string")


def trie(conversations: DataFrame, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """One row for each distinct prefix of the rebuilt conversations."""
    rows = materialize(blocks(rebuild(conversations), block, chunk))
    nodes = materialize(_prefixes(rows, "min(conv_id) as r, max(length) as deepest, min_by(total, conv_id) as r_total", block))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("q1"), F.col("k2").alias("q2"), F.col("r").alias("p"))
    # Where a path leaves that of its node's smallest member.
    branches = nodes.filter("depth > 0").join(parents, ["depth", "q1", "q2"]).filter("r <> p").select("r", (F.col("depth") - 1).alias("s"), "p", "q1", "q2", (F.col("r_total") - F.col("pre")).alias("own"))
    branches = materialize(branches)
    root = nodes.filter("depth = 0").select("r", F.lit(-1).cast("long").alias("s"), F.lit(None).cast("long").alias("p"), F.col("r_total").alias("own"))
    leaves = nodes.filter("depth = deepest").select("r", F.lit(1).cast("long").alias("leaf"))
    owners = branches.drop("q1", "q2").unionByName(root).unionByName(leaves, allowMissingColumns=True).groupBy(F.col("r").alias("conv_id")).agg(*[F.max(c).alias(c) for c in ("s", "p", "own", "leaf")])
    zero = F.lit(0).cast("long")
    owned = rows.join(owners, "conv_id", "left").withColumns({c: F.coalesce(c, zero) for c in ("own", "leaf")})
    found = _prefixes(owned, "min(conv_id) as conv_id, count(*) as n_convs, sum(total) as totals, sum(own) as owns, sum(leaf) as n_leaves, " + ", ".join(f"min_by({c}, conv_id) as r_{c}" for c in ("s", "p", "own", "total", "length")), block)
    forks = branches.groupBy(F.col("s").alias("depth"), F.col("q1").alias("k1"), F.col("q2").alias("k2")).agg(F.count(F.lit(1)).alias("forks"))
    found = found.join(forks, ["depth", "k1", "k2"], "left").join(_ends(rows, block), ["depth", "k1", "k2"], "left")
    text_of_members = F.col("totals") - F.col("n_convs") * F.col("pre")
    text_of_nodes = F.col("owns") - F.col("r_own") + F.col("r_total") - F.col("pre")
    return found.select(
        "conv_id", "depth", F.when(F.col("depth") == 0, F.lit(None)).when(F.col("r_s") < F.col("depth") - 1, F.col("conv_id")).otherwise(F.col("r_p")).cast("long").alias("parent_conv_id"),
        "n_convs", ((F.col("r_length") > F.col("depth")).cast("long") + F.coalesce("forks", zero)).alias("n_children"), "n_leaves", (text_of_members - text_of_nodes).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"),
    )
