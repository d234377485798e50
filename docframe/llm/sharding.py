"""Sharding by a hierarchical weighted hash tree.

Regions hold racks and racks hold shards. A document descends from the root: at each level every child draws an exponential
number of its weight's rate, hashed from seed, document id and the child's name, and the least draw wins. A child's
share is its weight's, and a draw depends on nothing but that child: when the weight of a subtree changes,
documents move only into or out of that subtree. A shard that is added as a region of its own takes documents only into itself.

A document's shard depends on its id and the tree alone. A null id draws as the text ``-``. Rows that share an id share a shard and have
different slots. A null text has size 1. Extra columns pass through, and an empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import text_of
from .mixing import uniform


@dataclass
class Node:
    """A subtree; without children it is the shard of that number."""

    name: str
    children: list[Node] = field(default_factory=list)
    shard: int = -1
    own: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own


def topology(shards: int, *, base: int = 8, per_region: int = 4, per_rack: int = 2, weights: dict[int, float] | None = None) -> Node:
    """The first ``base`` shards by region and rack, later ones each as a region of its own: the tree grows only beside what is there."""
    leaf = lambda s: Node(f"shard{s}", shard=s, own=(weights or {}).get(s, 1.0))
    regions = []
    for r in range(0, min(shards, base), per_region):
        own = range(r, min(r + per_region, shards, base))
        racks = [Node(f"rack{k // per_rack}", [leaf(s) for s in own if s // per_rack == k // per_rack]) for k in own if k % per_rack == 0]
        regions.append(Node(f"region{r // per_region}", racks))
    regions += [Node(f"added{s}", [Node(f"rack-added{s}", [leaf(s)])]) for s in range(base, shards)]
    return Node("root", regions)


def descend(tree: Node, key: Column, seed: int = 29) -> Column:
    """The shard of a document with this key."""
    nodes: list[Node] = []

    def number(node: Node) -> int:
        nodes.append(node)
        return len(nodes) - 1

    table: list[list[tuple[int, str, float]]] = []
    queue = [number(tree)]
    depth = {0: 0}
    while queue:
        at = queue.pop(0)
        row = []
        for child in nodes[at].children:
            if child.weight > 0:
                i = number(child)
                depth[i] = depth[at] + 1
                row.append((i, child.name, child.weight))
                queue.append(i)
        table.append(row)
    child_type = "array<array<struct<node:int,name:string,weight:double>>>"
    children = F.array(*[F.array(*[F.struct(F.lit(i).alias("node"), F.lit(n).alias("name"), F.lit(float(w)).alias("weight")) for i, n, w in row]) if row else F.array() for row in table]).cast(child_type)
    shards = F.array(*[F.lit(n.shard) for n in nodes])
    at = F.lit(0)
    for _ in range(max(depth.values())):
        draws = F.transform(F.get(children, at), lambda c: F.struct((-F.log(uniform(F.lit(seed), c["name"], key) + 2.0**-53) / c["weight"]).alias("draw"), c["node"].alias("node")))
        at = F.coalesce(F.array_min(draws)["node"], at)
    return F.get(shards, at)


def shard(docs: DataFrame, tree: Node, *, id: str = "doc_id", text: str = "text", name: str = "shard", slot: str = "slot", crc: str | None = None, seed: int = 29, buckets: int = 1024) -> DataFrame:
    """All columns, ``name``, and ``slot``: a gapless place from 0 in the shard, in a pseudo-random order.

    The order is that of a hash of id and text; ``crc`` names a column that holds the text's CRC-32 already.

    A shard is ordered in ``buckets`` of the order's hash; their counts, at most shards * buckets rows, give the offsets.
    """
    key = F.col(f"`{id}`")
    rows = docs.withColumn(name, descend(tree, key, seed)).withColumn("__crc", F.col(f"`{crc}`") if crc else F.crc32(text_of(text).cast("binary")))
    rows = rows.withColumn("__key", uniform(F.lit(seed), F.lit("slot"), key, F.col("__crc")))
    rows = rows.withColumn("__bucket", F.floor(F.col("__key") * buckets).cast("int"))
    counts = rows.groupBy(name, "__bucket").agg(F.count(F.lit(1)).alias("__c"))
    before = Window.partitionBy(name).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(name).alias("__s"), F.col("__bucket").alias("__o"), F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__from"))
    own = Window.partitionBy(name, "__bucket").orderBy("__key", key)
    ranked = rows.withColumn("__r", F.row_number().over(own) - 1)
    # at most shards * buckets rows
    out = ranked.join(F.broadcast(offsets), (F.col(name) == F.col("__s")) & (F.col("__bucket") == F.col("__o")))
    return out.withColumn(slot, (F.col("__r") + F.col("__from")).cast("long")).drop("__crc", "__key", "__bucket", "__r", "__s", "__o", "__from")


def write(sharded: DataFrame, path: str, *, name: str = "shard") -> None:
    """One folder of Parquet files per shard; a shard's rows are spread over tasks by hash, so none is one task's."""
    sharded.write.partitionBy(name).parquet(path)


def oracle(seed: int = 29) -> str:
    """DuckDB SQL for the query over distinct ids. Its CRC-32 is built from the polynomial."""
    uni = lambda *parts: "(('0x' || substr(md5(concat_ws(':', " + ", ".join(parts) + ")), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0)"
    draw = lambda name, w: f"(-ln({uni(f"'{seed}'", f"'{name}'", 'doc_id::VARCHAR')} + 1.1102230246251565e-16) / {float(w)!r})"

    def pick(node: Node) -> str:
        if not node.children:
            return str(node.shard)
        if len(node.children) == 1:
            return pick(node.children[0])
        least = f"least({', '.join(draw(c.name, c.weight) for c in node.children)})"
        return "CASE " + " ".join(f"WHEN {draw(c.name, c.weight)} = {least} THEN {pick(c)}" for c in node.children) + " END"

    return f"""
WITH bits AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
c AS (SELECT doc_id, octet_length(encode(text))::BIGINT + 1 AS size,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT)), lambda a, b: xor(a // 256, t[(xor(a, b) % 256) + 1])), 4294967295) AS text_crc32 FROM d, bits),
s AS (SELECT *, ({pick(topology(8))})::INTEGER AS shard, ({pick(topology(9))})::INTEGER AS grown_shard FROM c)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, grown_shard, row_number() OVER (PARTITION BY shard ORDER BY {uni(f"'{seed}'", "'slot'", 'doc_id::VARCHAR', 'text_crc32::VARCHAR')}, doc_id) - 1 AS slot FROM s"""
