"""A Merkle manifest of a dataset, with an inclusion proof per row, by concatenated-level strings.

A row's leaf is the SHA-256 of its fields, each with its length before it. The leaves of a group (a source), in the order of
the row key, are cut into aligned blocks of `ARITY ** LEVELS` nodes. A block keeps each of its levels as one string of hex
digests: the parents of a level are the hashes of its fixed-width substrings, and the siblings of a node are the substrings
to the left and to the right of it inside its run. The tops of the blocks are the nodes of the next round, until a group has
one node, its subroot; the subroots of all groups go through the same rounds to the root. On the way back every block hands
its members the segments of siblings above them.

Positions come from one range exchange over (group, key, leaf): each task's rows are numbered as they lie, and the sizes of
the tasks before are added, so a group that holds a third of all rows is spread over many tasks. No block holds more than
`ARITY ** LEVELS` members, and the number of rounds grows with the logarithm of the largest group.

Defined results: a null field is `-` in the leaf, another one its UTF-8 length, `:` and its value; rows with a null key come
first in their group, rows without group are a group of their own, which comes first; repeated rows are leaves of their own,
equal ones side by side; a group of one row has the leaf as its subroot, a table of one group its subroot as the root; an
empty table gives an empty table; only the named columns matter, whatever the others are called.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, saved

ARITY = 3
LEVELS = 5
HEX = 64  # characters of a digest
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_RUN = ARITY * HEX


def hashed(text: Column) -> Column:
    return F.sha2(text, 256)


def _field(value: Column) -> Column:
    value = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf(fields: Sequence[Column]) -> Column:
    return hashed(F.concat(*map(_field, fields)))


def _placed(rows: DataFrame, order: Sequence[str], label: str) -> DataFrame:
    """Adds pos, the place of a row in its key's order from 0, and height, the levels above the key's nodes."""
    height = sum((F.when(F.col("group_rows") > ARITY**k, 1).otherwise(0) for k in range(39)), F.lit(0))
    return numbered(rows, ["key"], order, label).withColumn("height", height).drop("group_rows")


def _parents(level: Column) -> Column:
    """The next level: the hashes of the runs of a level, one after the other."""
    runs = F.ceil(F.length(level) / _RUN).cast("int")
    return F.array_join(F.transform(F.sequence(F.lit(0), runs - 1), lambda i: hashed(F.substring(level, i * _RUN + 1, F.lit(_RUN)))), "")


def _blocks(nodes: DataFrame, payload: Sequence[str], round_no: int) -> DataFrame:
    """(key, height, block, members, level0 .. levelN): levels above the top of the key's tree are null.

    ``nodes``: key, height, pos, node and ``payload``.
    """
    block = F.expr(f"pos div {ARITY**LEVELS}").alias("block")
    member = F.struct("pos", "node", *payload)
    out = nodes.groupBy("key", "height", block).agg(F.sort_array(F.collect_list(member)).alias("members"))
    out = out.withColumn("level0", F.array_join(F.transform("members", lambda m: m["node"]), ""))
    for k in range(LEVELS):
        above = F.col("height") > round_no * LEVELS + k
        out = out.withColumn(f"level{k + 1}", F.when(above, _parents(F.col(f"level{k}"))))
    return out


def _top() -> Column:
    return F.coalesce(*[F.col(f"level{k}") for k in range(LEVELS, -1, -1)])


def _segments(pos: Column) -> Column:
    """The siblings of the member at ``pos`` at each level of its block: to the left of its path and to the right of it."""
    found = []
    for k in range(LEVELS):
        level = F.col(f"level{k}")
        at = F.floor((pos % ARITY**LEVELS) / ARITY**k).cast("int")  # small whole numbers: exact
        child = at % ARITY
        left = F.substring(level, (at - child) * HEX + 1, child * HEX)
        right = F.substring(level, (at + 1) * HEX + 1, (ARITY - 1 - child) * HEX)
        found.append(F.when(F.col(f"level{k + 1}").isNotNull(), F.struct(left.alias("left"), right.alias("right"))))
    return F.filter(F.array(*found), lambda s: s.isNotNull())


def tree(nodes: DataFrame, payload: Sequence[str], label: str) -> DataFrame:
    """Per member of ``nodes`` (key, height, pos, node and payload): key, member, path (its segments, upwards) and top."""
    rounds, current, carried = [], nodes, payload
    while True:
        blocks = saved(_blocks(current, carried, len(rounds)), f"{label}-blocks")
        rounds.append(blocks)
        above = blocks.where(F.col("height") > len(rounds) * LEVELS)
        if not above.take(1):
            break
        current, carried = above.select("key", "height", F.col("block").alias("pos"), _top().alias("node")), ()
    none = F.array().cast("array<struct<left:string,right:string>>")
    members = None
    for blocks in reversed(rounds):
        if members is None:
            blocks = blocks.withColumn("upper", none).withColumn("top", _top())
        else:
            uppers = members.select("key", F.col("member.pos").alias("block"), F.col("path").alias("upper"), "top")
            blocks = blocks.join(uppers, ["key", "block"], "left")
            # a key whose tree ended in this round has no block above
            blocks = blocks.withColumn("upper", F.coalesce("upper", none)).withColumn("top", F.coalesce("top", _top()))
        placed = F.transform("members", lambda m: F.struct(m.alias("member"), _segments(m["pos"]).alias("own")))
        members = blocks.select("key", "top", "upper", F.inline(placed))
        members = members.select("key", "member", F.concat("own", "upper").alias("path"), "top")
    return members


def folded(node: Column, path: Column) -> Column:
    """The root that a node and the siblings on its path lead to."""
    return F.aggregate(path, node, lambda acc, s: hashed(F.concat(s["left"], acc, s["right"])))


def manifest(
    docs: DataFrame, fields: Sequence[str] = FIELDS, group: str = "source", key: str = "doc_id", tampered: dict[str, Column] | None = None,
    tampered_where: Column | None = None,
) -> DataFrame:
    """Per row: key, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``tampered``: other values of fields; rows where ``tampered_where`` holds fold the leaf of those values instead of their
    own, against the siblings of the untampered table.
    """
    own = leaf([F.col(f) for f in fields])
    rows = docs.select(
        F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit("")).alias("key"),  # null first, then bytewise
        F.col(key).alias("id"),
        own.alias("node"),
        F.when(tampered_where, leaf([(tampered or {}).get(f, F.col(f)) for f in fields])).alias("changed") if tampered_where is not None else F.lit(None).cast("string").alias("changed"),
        F.monotonically_increasing_id().alias("row_no"),  # only tells equal rows apart
    )
    leaves = tree(_placed(rows, ["id", "node", "row_no"], "manifest-leaves").drop("row_no"), ["id", "changed"], "manifest")
    leaves = saved(leaves, "manifest-paths")
    subroots = leaves.groupBy("key").agg(F.min("top").alias("node"))
    nodes = _placed(subroots.select(F.lit(0).alias("key"), F.col("key").alias("name"), "node"), ["name"], "manifest-subroots")
    groups = tree(nodes, ["name"], "manifest-groups").select(F.col("member.name").alias("key"), F.col("path").alias("group_path"), F.col("top").alias("root"))
    met = leaves.join(saved(groups, "manifest-roots"), "key")
    met = met.select("member", "top", "root", F.concat("path", "group_path").alias("path"))
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    out = met.select(
        F.col("member.id").alias(key),
        F.col("member.node").alias("leaf"),
        F.col("top").alias("subroot"),
        "root",
        hashed(siblings).alias("proof_sha256"),
        folded(F.coalesce("member.changed", "member.node"), F.col("path")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
