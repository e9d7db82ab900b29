"""Merkle manifest of a dataset with a witness for every row.

Rows are leaves, in the order of their ids within each group; eight consecutive nodes make their parent.  A task takes a block of
512 consecutive, aligned leaves and appends them one by one.  The right edge of the block is a stack of open runs; a node that is
appended gets a partial witness, its siblings so far, and extends the witnesses of those siblings.  A run of
eight is closed into its parent, which is appended to the run above in the same way.  What a block leaves is its root, and
roots of blocks are appended as leaves of the next pass, until each group is one node; then the groups' roots are.

A pass makes 512 nodes to one, so there are few.  A leaf's witness is its path in its block with the path of the block's root
behind it: tables of blocks are joined back by block, never a path for each leaf sent up.  Positions come from ranges sorted
in Spark and a table of counts with a row for each range and group.
"""
from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, met, passing, saved, table

ARITY, LEVELS = 8, 3
#: Leaves of a block.
BLOCK = ARITY**LEVELS
#: Columns of a document that its leaf holds.
HELD = ("doc_id", "source", "lang", "n_chars", "text")
#: Digests are hex text where they are hashed, and bytes in paths.
PATH = "array<array<binary>>"
STEPS = f"array<struct<at:bigint,path:{PATH}>>"


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


class Block:
    """An aligned block of leaves that is appended to; `paths[i]` is the witness of leaf i: siblings, level by level."""

    def __init__(self):
        self.open: list[list[tuple[str, list[int], list[str]]]] = [[] for _ in range(LEVELS + 1)]
        self.paths: list[list[list[str]]] = []

    def append(self, leaf: str) -> None:
        self.paths.append([])
        self._add(0, leaf, [len(self.paths) - 1])

    def _add(self, level: int, node: str, leaves: list[int]) -> None:
        run = self.open[level]
        for _, _, siblings in run:  # a later sibling extends their witnesses
            siblings.append(node)
        run.append((node, leaves, [n for n, _, _ in run]))
        if level < LEVELS and len(run) == ARITY:
            self._close(level)

    def _close(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        for _, leaves, siblings in run:
            for leaf in leaves:
                self.paths[leaf].append(siblings)
        self._add(level + 1, digest([n for n, _, _ in run]), [i for _, leaves, _ in run for i in leaves])

    def finish(self, alone: bool) -> str:
        """The block's root.  A block that is alone in its group ends with its last single node, others at their full height."""
        for level in range(LEVELS):
            run = self.open[level]
            if alone and len(run) == 1 and not any(self.open[level + 1 :]):
                return run[0][0]
            if run:
                self._close(level)
        return self.open[LEVELS][0][0]


def folded(leaf: str, steps: list[dict]) -> str:
    """The root that a leaf and its witness give: at each level the node takes its place among its siblings."""
    for step in steps:
        at = step["at"]
        for siblings in step["path"]:
            k, others = at % ARITY, [x.hex() for x in siblings]
            leaf, at = digest([*others[:k], leaf, *others[k:]]), at // ARITY
    return leaf


def _blocks(batches):
    """Rows of leaves with their paths in their blocks, and a row of each block (with no at) with its root; rows come in order."""
    schema = pa.schema([("grp", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("at", pa.int64()), ("row", pa.int64()), ("path", pa.list_(pa.list_(pa.binary()))), ("root", pa.string())])

    def made(key, rows):
        block = Block()
        for r in rows:
            block.append(r["node"])
        grp, number, n = key
        root = block.finish(n <= BLOCK)
        paths = [[[bytes.fromhex(x) for x in level] for level in p] for p in block.paths]
        out = [(grp, number, n, r["at"], r["row"], p, None) for r, p in zip(rows, paths, strict=True)]
        out.append((grp, number, n, None, None, None, root))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    key, rows = None, []
    for batch in batches:
        for r in batch.to_pylist():
            this = r["grp"], r["block"], r["n"]
            if this != key and rows:
                yield made(key, rows)
                rows = []
            key = this
            rows.append(r)
    if rows:
        yield made(key, rows)


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with at, their place from 0 in their group, n, the group's size, and row, a number of their own; written to the shared folder.

    Ranges of (group, order) are sorted, so a large group is many ranges; rows that are alike in all of it are
    spread by their number in the input.
    """
    tie, row, shard, first, before = fresh(rows, "tie", "row", "shard", "first", "before")
    spread = F.pmod(F.monotonically_increasing_id(), F.lit(1024))
    keys = [group, *order, tie]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.withColumn(tie, spread).repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop(tie)
    placed = saved(placed.withColumn(row, F.monotonically_increasing_id()).withColumn(shard, F.shiftright(row, 33)), "placed")
    counts = placed.groupBy(group, shard).agg(F.min(row).alias(first), F.count("*").alias("n"))
    of = Window.partitionBy(group)
    before_it = F.coalesce(F.sum("n").over(of.orderBy(shard).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = saved(counts.select(group, shard, first, before_it.alias(before), F.sum("n").over(of).alias("n")), "ranges")
    out = met(placed, counts, [group, shard], "inner")
    return out.withColumn("at", F.col(before) + F.col(row) - F.col(first)).withColumnRenamed(row, "row").drop(shard, first, before)


def climb(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Witnesses and roots of nodes(grp, at, n, row, node): (grp, row, steps) for each and (grp, root) for each group.

    steps holds a leaf's place and path in its block, then its block's in the blocks of the next pass, and so on.
    """
    blocked = nodes.select("grp", F.floor(F.col("at") / BLOCK).alias("block"), "n", "at", "row", "node")
    sorted_ = blocked.repartition("grp", "block").sortWithinPartitions("grp", "block", "at")
    made = saved(sorted_.mapInArrow(_blocks, f"grp string, block long, n long, at long, row long, path {PATH}, root string"), "blocks")
    leaves = made.where("at is not null").select("grp", "block", "row", F.array(F.struct("at", "path")).cast(STEPS).alias("steps"))
    roots = made.where("at is null")
    done = roots.where(F.col("n") <= BLOCK).select("grp", "root")
    more = roots.where(F.col("n") > BLOCK)
    if more.isEmpty():
        return leaves.drop("block"), done
    up = more.select("grp", F.col("block").alias("at"), F.ceil(F.col("n") / BLOCK).alias("n"), F.col("block").alias("row"), F.col("root").alias("node"))
    above, tops = climb(up)
    above = saved(above.select("grp", F.col("row").alias("block"), F.col("steps").alias("above")), "above")
    leaves = met(leaves, above, ["grp", "block"], "left")
    steps = F.concat("steps", F.coalesce("above", F.array().cast(STEPS)))
    return leaves.select("grp", "row", steps.alias("steps")), done.unionByName(tops)


def leaf(columns: dict[str, Column]) -> Column:
    """The leaf of a row: each value as its UTF-8 byte count, a colon and itself, `-` for null."""
    texts = [c.cast("string") for c in columns.values()]
    parts = [F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def manifest(rows: DataFrame) -> DataFrame:
    """rows(grp, id, leaf, ...) with steps (the witness up to the root, for `folded`), subroot of their group and root of all.

    Leaves of a group ascend by id, null first, then by leaf; groups ascend bytewise, null first.  Rows that are alike are
    leaves of their own.  An empty table gives an empty one.  Other columns stay.
    """
    with passing(rows.sparkSession):
        key = F.coalesce(F.concat(F.lit("="), F.col("grp").cast("string")), F.lit(""))
        placed = saved(numbered(rows.withColumn("grp", key), "grp", ["id", "leaf"]), "numbered")
        steps, subroots = climb(placed.select("grp", "at", "n", "row", F.col("leaf").alias("node")))
        named = subroots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.col("root").alias("node"))
        named = saved(numbered(saved(named, "subroots"), "grp", ["name"]), "groups")
        above, root = climb(named)
        groups = named.join(above, ["grp", "row"]).join(F.broadcast(root), "grp")
        groups = saved(groups.select(F.col("name").alias("grp"), F.col("node").alias("subroot"), F.col("steps").alias("above"), "root"), "groups")
        out = met(placed.drop("at", "n").join(steps, ["grp", "row"]), groups, "grp", "inner")
        out = out.withColumn("steps", F.concat("steps", "above")).withColumn("grp", F.when(F.col("grp") != "", F.substring("grp", 2, 1 << 30)))
        return saved(out.drop("above", "row"), "manifest", keep=True)


def _verified(batches):
    for batch in batches:
        leaves, changed, steps = (batch.column(c).to_pylist() for c in ("leaf", "changed", "steps"))
        proof = [digest([x.hex() for s in w for siblings in s["path"] for x in siblings]) for w in steps]
        back = [folded(a if b is None else b, w) for a, b, w in zip(leaves, changed, steps, strict=True)]
        names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        same = [a == b for a, b in zip(back, batch.column("root").to_pylist(), strict=True)]
        cols = [batch.column("id"), batch.column("leaf"), batch.column("subroot"), batch.column("root"), pa.array(proof, pa.string()), pa.array(back, pa.string()), pa.array(same, pa.bool_())]
        yield pa.RecordBatch.from_arrays(cols, names)


def documents_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of documents by lang, verified against a tampered copy: see `op12_incremental_witnesses`.

    Null and empty texts are leaves of their own kind, very long ones are hashed in Spark.  A row without doc_id comes first
    and is not tampered with; rows that share an id are in the order of their leaves, and repeated rows are leaves each.
    An empty table gives no rows; columns other than HELD are ignored.
    """
    held = {c: F.col(c) for c in HELD}
    lower = F.translate(F.col("text").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    with passing(docs.sparkSession):
        rows = docs.select(F.col("lang").alias("grp"), F.col("doc_id").cast("long").alias("id"), leaf(held).alias("leaf"), F.when(hit, leaf(held | {"text": lower})).alias("changed"))
        made = manifest(saved(rows, "leaves")).select("id", "leaf", "changed", "steps", "subroot", "root")
        schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
        return saved(made.mapInArrow(_verified, schema), "verified", keep=True)


def op12_incremental_witnesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_manifest(table(spark, sf_dir, "documents"))


def _levels(name: str, height: int) -> str:
    """SQL tables name0 .. nameH(grp, i, n, node) and lists of runs nameRk(grp, run, nodes), from name0."""
    out = []
    for k in range(height):
        out.append(f"{name}R{k} as (select grp, i // 8 as run, max(n) as n, list(node order by i) as nodes from {name}{k} group by 1, 2)")
        out.append(f"{name}{k + 1} as (select grp, run as i, (n + 7) // 8 as n, case when n = 1 then nodes[1] else sha256(array_to_string(nodes, '')) end as node from {name}R{k})")
    return ", ".join(out)


def _folds(name: str, height: int, start: str) -> str:
    """SQL tables that fold `start`(id, grp, i, f, proof) level by level; the last is nameF{height}."""
    out = [f"{name}F0 as ({start})"]
    for k in range(height):
        at = f"({name}F{k}.i % 8)"
        out.append(f"""{name}F{k + 1} as (select id, {name}F{k}.grp, {name}F{k}.i // 8 as i, case when n = 1 then f else sha256(array_to_string(nodes[1 : {at}] || [f] || nodes[{at} + 2 :], '')) end as f,
 case when n = 1 then proof else proof || array_to_string(nodes[1 : {at}] || nodes[{at} + 2 :], '') end as proof from {name}F{k} join {name}R{k} on {name}R{k}.grp = {name}F{k}.grp and run = {name}F{k}.i // 8)""")
    return ", ".join(out)


#: Heights for 8^7 rows of a language and 8^3 languages.
_UP, _OVER = 7, 3
_VALUE = "case when {c} is null then '-' else strlen(cast({c} as varchar)) || ':' || {c} end"
_LEAF = " || ".join(_VALUE.format(c=c) for c in HELD)
_CRC = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast(doc_id as varchar), ''), lambda c: ascii(c)::bigint)), lambda a, b: list_reduce(list_prepend(xor(a, b), generate_series(1, 8)), lambda x, k: case when x & 1 = 1 then xor(x >> 1, 3988292384::bigint) else x >> 1 end)), 4294967295::bigint)"
ORACLE = {
    "op12_incremental_witnesses": f"""
with d as (select doc_id, coalesce('=' || lang, '') as grp, sha256({_LEAF}) as leaf, {_CRC} % 3 = 0 as hit, sha256({_LEAF.replace("strlen(cast(text as varchar)) || ':' || text", "strlen(low) || ':' || low")}) as changed from (select *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low from documents)),
o as (select *, row_number() over () as id, row_number() over (partition by grp order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by grp) as n from d),
a0 as (select grp, i, n, leaf as node from o), {_levels('a', _UP)},
s as (select grp as name, node, row_number() over (order by grp) - 1 as i, count(*) over () as n from a{_UP}), b0 as (select '' as grp, i, n, node from s), {_levels('b', _OVER)},
{_folds('a', _UP, "select id, grp, i, case when coalesce(hit, false) then changed else leaf end as f, '' as proof from o")}, {_folds('b', _OVER, f"select id, '' as grp, s.i, f, proof from aF{_UP} join s on name = grp")}
select doc_id, leaf, s.node as subroot, b{_OVER}.node as root, sha256(proof) as proof_sha256, f as folded_root, f = b{_OVER}.node as verified from o join bF{_OVER} using (id) join s on s.name = o.grp cross join b{_OVER}"""
}
