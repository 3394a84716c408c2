"""A Merkle manifest of a table: one tree a group, one tree over the groups' roots.

H is the lower-case hexadecimal SHA-256 of its concatenated inputs. Leaves of a group ascend by
id; while several nodes remain, every ``FANOUT`` consecutive ones become their H.

Checkpoint and recompute: only every ``STRIDE``-th level is written (leaves are level 0), so the
stored nodes above the leaves are fewer than one in 700. Levels between are made twice and kept
never: once when a stored node is built from the aligned subtree below it, and once when proofs
are extracted, where each subtree's interior is grown again from its stored descendants, the
siblings on the way to each of them are put out, and the interior is thrown away. Proofs run
from the root down, a subtree's rows receive the path of the subtree's own node.

Nodes are placed by a range exchange on (group, id) and counts per (group, partition), so a group
that holds a third of all rows is spread over as many tasks as its size asks for; a task holds one
subtree of at most ``FANOUT ** STRIDE`` nodes at a time, whatever the sizes of the groups.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexitilt.llm.common import durable, fold_of

FANOUT = 3
STRIDE = 6
#: The fields of a document that its leaf binds, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_NODES = "grp string, n long, pos long, node string"


def digest(value: str) -> str:
    return hashlib.sha256(value.encode("ascii")).hexdigest()


def leaf_hash(columns: Sequence[Column]) -> Column:
    """H of the fields, each ``-`` if null, else its UTF-8 byte count, ``:`` and its text."""
    def framed(c: Column) -> Column:
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))
    return F.sha2(F.concat(*[framed(c) for c in columns]).cast("binary"), 256)


def group_key(group: Column) -> Column:
    """The group as text that sorts bytewise with null first: empty for null, else after an s."""
    return F.coalesce(F.concat(F.lit("s"), group.cast("string")), F.lit(""))


def height(n: int) -> int:
    """Levels above ``n`` nodes until one remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


def grown(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes and ``levels`` levels above them."""
    out = [nodes]
    for _ in range(levels):
        last = out[-1]
        out.append([digest("".join(last[k:k + FANOUT])) for k in range(0, len(last), FANOUT)])
    return out


def paths(levels: list[list[str]], above: str) -> list[str]:
    """The path of every node of the lowest level: ``left.right`` for each level up to the root,
    the siblings before and after the node, each followed by a slash."""
    path = [above]
    for nodes in reversed(levels[:-1]):
        here = []
        for k in range(len(nodes)):
            run = k - k % FANOUT
            left, right = nodes[run:k], nodes[k + 1:run + FANOUT]
            here.append(f"{''.join(left)}.{''.join(right)}/{path[k // FANOUT]}")
        path = here
    return path


def placed(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` (grp, ...) with pos, the place within grp in ``order`` from 0, and n, its size.

    The rows are sorted over all tasks by a range exchange and written; a row's place is its place
    in its partition plus the group's rows in the partitions before, of which there is a count a
    partition that the group reaches.
    """
    part = F.shiftright("_at", 33)
    spread = durable(rows.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order)
                     .withColumn("_at", F.monotonically_increasing_id()))
    spread = spread.withColumn("_part", part)
    runs = spread.groupBy("grp", "_part").agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    before = Window.partitionBy("grp").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("grp", "_part", "_first",
                       F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
                       F.sum("_rows").over(Window.partitionBy("grp")).alias("n"))
    return spread.join(runs, ["grp", "_part"]).withColumn(
        "pos", F.col("_before") + F.col("_at") - F.col("_first")) \
        .drop("_at", "_part", "_first", "_before")


def _subtrees(rows: DataFrame, run: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``run`` over the rows (grp, chunk, pos, ...) of each (grp, chunk) in order of pos."""

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            held = batch if held is None or held.empty else pd.concat([held, batch], ignore_index=True)
            if held.empty:
                continue
            last = held.iloc[-1]
            open_from = int(((held["grp"] == last["grp"]) & (held["chunk"] == last["chunk"])).argmax())
            done, held = held.iloc[:open_from], held.iloc[open_from:]
            if len(done):
                yield run(done)
        if held is not None and len(held):
            yield run(held)

    return rows.repartition("grp", "chunk").sortWithinPartitions("grp", "chunk", "pos") \
        .mapInPandas(stream, schema)


def _cut(grp: list, chunk: list) -> Iterator[tuple[int, int]]:
    """Bounds of the runs of equal (grp, chunk)."""
    start = 0
    for k in range(1, len(grp) + 1):
        if k == len(grp) or chunk[k] != chunk[start] or grp[k] != grp[start]:
            yield start, k
            start = k


def raised(nodes: DataFrame, stride: int = STRIDE) -> DataFrame:
    """grp, n, pos, node of the level ``stride`` above ``nodes``, or of the top if that is nearer."""
    width = FANOUT ** stride

    def run(part: pd.DataFrame) -> pd.DataFrame:
        grp, chunk = part["grp"].tolist(), part["chunk"].tolist()
        n, node = part["n"].tolist(), part["node"].tolist()
        return pd.DataFrame([
            (grp[a], -(-n[a] // width), chunk[a],
             grown(node[a:b], min(stride, height(n[a])))[-1][0])
            for a, b in _cut(grp, chunk)], columns=["grp", "n", "pos", "node"])

    rows = nodes.select("grp", "n", "pos", "node", F.expr(f"pos div {width}").alias("chunk"))
    return _subtrees(rows, run, _NODES)


def lowered(nodes: DataFrame, above: DataFrame, stride: int = STRIDE,
            carry: Sequence[str] = ()) -> DataFrame:
    """grp, pos, node, the columns ``carry`` (text), subroot and path of ``nodes``, each subtree
    grown again below the path of its own node, which ``above`` (grp, pos, subroot, path) holds."""
    width = FANOUT ** stride

    def run(part: pd.DataFrame) -> pd.DataFrame:
        grp, chunk = part["grp"].tolist(), part["chunk"].tolist()
        n, node, path = part["n"].tolist(), part["node"].tolist(), part["path"].tolist()
        subroot = part["subroot"].tolist()
        keep, tops, found = [], [], []
        for a, b in _cut(grp, chunk):  # the subtree's own path comes first, at place -1
            keep.extend(range(a + 1, b))
            tops.extend([subroot[a]] * (b - a - 1))
            if b > a + 1:
                levels = grown(node[a + 1:b], min(stride, height(n[a + 1])))
                found.extend(paths(levels, path[a]))
        out = part.iloc[keep][["grp", "pos", "node", *carry]].copy()
        out["subroot"], out["path"] = tops, found
        return out

    def no(name: str) -> Column:
        return F.lit(None).cast("string").alias(name)

    rows = nodes.select("grp", F.expr(f"pos div {width}").alias("chunk"), "pos", "n", "node",
                        no("subroot"), no("path"), *carry)
    marks = above.select("grp", F.col("pos").alias("chunk"), F.lit(-1).cast("long").alias("pos"),
                         F.lit(0).cast("long").alias("n"), no("node"), "subroot", "path",
                         *[no(c) for c in carry])
    schema = ", ".join(["grp string", "pos long",
                        *[f"{c} string" for c in ("node", *carry, "subroot", "path")]])
    return _subtrees(rows.unionByName(marks), run, schema)


def stored_levels(leaves: DataFrame, stride: int = STRIDE) -> list[DataFrame]:
    """``leaves`` (grp, n, pos, node) and every ``stride``-th level above, each written, up to one
    node a group."""
    levels = [leaves]
    largest = leaves.agg(F.max("n")).first()[0] or 0
    while largest > 1:
        levels.append(durable(raised(levels[-1].select("grp", "n", "pos", "node"), stride)))
        largest = -(-largest // FANOUT ** stride)
    return levels


@dataclass(frozen=True)
class Manifest:
    """Stored levels of the groups' trees and of the tree over their roots; no group: no root.

    groups[0] holds the leaves with the columns ``carry``, groups[-1] a row a group.
    """

    groups: list[DataFrame]
    top: list[DataFrame]
    carry: tuple[str, ...] = field(default=())
    stride: int = STRIDE

    def subroots(self) -> DataFrame:
        """grp and subroot."""
        return self.groups[-1].select("grp", F.col("node").alias("subroot"))

    def root(self) -> str | None:
        """The one root; None for an empty table."""
        row = self.top[-1].select("node").first()
        return row and row[0]


def build(leaves: DataFrame, order: Sequence[str], carry: Sequence[str] = (),
          stride: int = STRIDE) -> Manifest:
    """The manifest of ``leaves`` (grp, node, the columns ``order`` and ``carry``)."""
    first = durable(placed(leaves, order).select("grp", "n", "pos", "node", *carry))
    groups = stored_levels(first, stride)
    roots = groups[-1].select(F.lit("").alias("grp"), F.col("grp").alias("name"), "node")
    top = stored_levels(durable(placed(roots, ["name"])), stride)
    return Manifest(groups, top, tuple(carry), stride)


def proofs(manifest: Manifest) -> DataFrame:
    """grp, pos, node, the carried columns, subroot and path: a row a leaf.

    ``path`` runs from the leaf via its group's root to the root (see ``paths``); ``siblings`` and
    ``folded`` read it.
    """
    none = F.lit(None).cast("string")
    above = manifest.top[-1].select("grp", "pos", none.alias("subroot"), F.lit("").alias("path"))
    for level in reversed(manifest.top[:-1]):
        above = lowered(level, above, manifest.stride)
    roots = manifest.top[0].select("pos", F.col("name").alias("grp"), F.col("node").alias("subroot"))
    above = durable(roots.join(above.select("pos", "path"), "pos")
                    .select("grp", F.lit(0).cast("long").alias("pos"), "subroot", "path"))
    if len(manifest.groups) == 1:  # every group is a lone leaf
        return manifest.groups[0].drop("n").join(above.drop("pos"), "grp")
    for k in range(len(manifest.groups) - 2, -1, -1):
        above = lowered(manifest.groups[k], above, manifest.stride, manifest.carry if k == 0 else ())
    return above


def siblings(path: Column) -> Column:
    """All siblings of a path concatenated, from the leaf up and left to right."""
    return F.translate(path, "./", "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` and the siblings of ``path`` give."""
    def step(node: Column, level: Column) -> Column:
        sides = F.split(level, "[.]")
        return F.sha2(F.concat(sides[0], node, sides[1]).cast("binary"), 256)
    levels = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.aggregate(levels, leaf, step)


def manifest_of(docs: DataFrame, fields: Sequence[str] = FIELDS, id_col: str = "doc_id",
                group: str = "source", tampered: Column | None = None) -> Manifest:
    """The manifest of a table; each leaf carries its row's id and the leaf of its tampered row.

    ``tampered`` stands in for the column text in the second leaf. Rows with one id follow each
    other in the order of their leaves, a null id comes first, equal rows are as many equal leaves.
    Very long texts are hashed where they lie, only digests are moved.
    """
    other = [tampered if c == "text" and tampered is not None else F.col(c) for c in fields]
    leaves = docs.select(
        group_key(F.col(group)).alias("grp"), F.col(id_col).alias("_id"),
        leaf_hash([F.col(c) for c in fields]).alias("node"), leaf_hash(other).alias("tampered"))
    leaves = leaves.withColumn("id_text", F.col("_id").cast("string"))
    return build(leaves, ["_id", "node", "tampered"], ["id_text", "tampered"])


def verified_manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: a row a document.

    Where two divides the CRC-32 of the id, the text is tampered with by deleting its line feeds;
    the proof is then held against the leaf of what is left. A null text or id is not tampered
    with. Nulls, empty texts, repeated ids and rows have leaves like any other (see
    ``manifest_of``); an empty table gives no rows; other columns are not used.
    """
    hit = F.coalesce(fold_of(F.col("doc_id"), 2) == 0, F.lit(False))
    text = F.when(hit, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    manifest = manifest_of(docs, tampered=text)
    rows = proofs(manifest)
    back = folded(F.col("tampered"), F.col("path"))
    return rows.select(
        F.col("id_text").cast(docs.schema["doc_id"].dataType).alias("doc_id"),
        F.col("node").alias("leaf"), "subroot", F.lit(manifest.root()).cast("string").alias("root"),
        F.sha2(siblings(F.col("path")).cast("binary"), 256).alias("proof_sha256"),
        back.alias("folded_root")) \
        .withColumn("verified", F.col("folded_root") == F.col("root"))
