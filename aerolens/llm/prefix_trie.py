"""Prefix trie of conversations: neighbours of one global sort, merged by union-find in descending order of what they share.

Each conversation is a path of prefix ids. After a range sort, conversations that share a prefix stand side by
side, and the longest common prefix (LCP) of neighbours is an edge. Each partition takes its edges from the longest down;
every merge of two components is a branching node, and the stretch below it a chain of nodes with one child. Only nodes that
reach over a partition's end stay open: they are the contracted forest of the partition, merged with those of the others.
Paths are cut into blocks of turns, so that no row grows with a conversation; blocks are handled from the deepest up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolens.llm.running import PART, POS, running
from aerolens.llm.texts import importable, n_words
from aerolens.session import written

#: Turns of a block: a row holds 32 bytes for each.
BLOCK = 256
LANES, ID = 3, 24
NOTHING = hashlib.sha256(b"").hexdigest()

FOREST = ("kind string, id string, parent string, depth long, conv long, n long, children long, leaves long, saved long, words long, "
          "below_children long, below_leaves long, below_saved long, parent_conv long, ends string, path string, first long, chunk string")
FIELDS = [f.split()[0] for f in FOREST.split(", ")]


def ordered(turns: DataFrame) -> DataFrame:
    """(conv_id, position, key, words) of (conv_id, turn, role, text): by turn, null first, then by the turn's key.

    A turn's key is a digest of role and text, both empty when null. Rows without a conv_id belong to no conversation and
    are left out; repeated rows are turns of their own. A conversation of any length is split between partitions.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.md5(F.concat(F.octet_length(role), F.lit(":"), role, text)).alias("key"),
        n_words(text).alias("words"), F.col("conv_id").cast("string").alias("conv"), F.lit(1).cast("long").alias("one"), F.monotonically_increasing_id().alias("from"))
    return running(rows, ["turn", "key", "from"], ["one"], "conv", "trie-turns").select("conv_id", F.col("one_before").alias("position"), "key", "words")


def with_length(turns: DataFrame) -> DataFrame:
    """``ordered`` turns plus ``length``, the number of turns of their conversation."""
    return turns.join(turns.groupBy("conv_id").agg(F.count("*").alias("length")), "conv_id")


def rebuilt(turns: DataFrame, family: int = 20, ways: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversation c rebuilt from ``ordered`` turns: the first h turns of conversation c - c % family, then its own after its
    first h, with h = crc32(c) % ways. Returns (turns with ``length``, the conv_ids left without turns)."""
    heads = turns.where((F.col("conv_id") % family == 0) & (F.col("position") < ways - 1)).groupBy(F.col("conv_id").alias("base")).agg(
        F.array_sort(F.collect_list(F.struct("position", "key", "words"))).alias("head"))
    own = turns.groupBy("conv_id").agg(F.count("*").alias("own")).withColumns(
        {"base": F.col("conv_id") - F.col("conv_id") % family, "h": (F.crc32(F.col("conv_id").cast("string").cast("binary")) % ways).cast("int")})
    head = F.slice(F.coalesce("head", F.array().cast("array<struct<position:bigint,key:string,words:bigint>>")), F.lit(1), F.col("h"))
    plan = own.join(heads, "base", "left").withColumn("head", head).withColumn(
        "length", F.size("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    plan = written(plan.select("conv_id", "h", "head", "length"), "trie-plan")
    first = plan.select("conv_id", "length", F.inline("head")).select("conv_id", "position", "key", "words", "length")
    rest = turns.join(plan.select("conv_id", "h", "length", F.size("head").alias("k")), "conv_id").where("position >= h").select(
        "conv_id", (F.col("position") - F.col("h") + F.col("k")).alias("position"), "key", "words", "length")
    return first.union(rest), plan.where("length = 0").select("conv_id")


def paths(turns: DataFrame, turnless: DataFrame, block: int) -> DataFrame:
    """(block, entry, path, conv_id, words, ends): a row for each conversation and block of turns.

    ``entry`` is the id of the prefix before the block, ``path`` the ids of the prefixes that end in it, ``words`` those of
    their last turns, ``ends`` whether the conversation goes no further. A prefix id is a sum of turn hashes in three lanes of
    32 bits, so that it can be carried from partition to partition. A conversation whose last block is
    full has an empty row in the next, so a block knows all that reach it.
    """
    lanes = {f"h{i}": F.xxhash64(F.lit(i), "position", "key").bitwiseAND(F.lit((1 << 32) - 1)) for i in range(LANES)}
    rows = turns.select("conv_id", "position", "words", "length", F.col("conv_id").cast("string").alias("conv"), *[c.alias(n) for n, c in lanes.items()])
    sums = running(rows, ["position"], list(lanes), "conv", "trie-prefixes").drop(PART, POS)

    def name(values: list[Column]) -> Column:
        return F.concat(*[F.lpad(F.hex(v.bitwiseAND(F.lit((1 << 32) - 1))), 8, "0") for v in values])

    named = sums.select("conv_id", "position", "words", "length", name([F.col(f"{n}_before") for n in lanes]).alias("before"),
                        name([F.col(f"{n}_before") + F.col(n) for n in lanes]).alias("id"))
    blocks = named.groupBy("conv_id", F.expr(f"position div {block}").alias("block")).agg(
        F.min_by("before", "position").alias("entry"), F.array_sort(F.collect_list(F.struct("position", "id", "words"))).alias("t"), F.max("length").alias("length"))
    full = blocks.select("block", "entry", F.array_join("t.id", "").alias("path"), "conv_id", F.col("t.words").alias("words"),
                         (F.col("length") <= (F.col("block") + 1) * block).alias("ends"))
    bare = [F.lit("").alias("path"), "conv_id", F.array().cast("array<bigint>").alias("words"), F.lit(True).alias("ends")]
    last = named.where((F.col("position") == F.col("length") - 1) & (F.col("length") % block == 0))
    return full.union(last.select(F.expr(f"length div {block}"), "id", *bare)).union(
        turnless.select(F.lit(0).cast("long"), F.lit("0" * ID), *bare))


def shared(a: str, b: str) -> int:
    """Number of ids that two paths have in common at their beginning."""
    low, high = 0, min(len(a), len(b)) // ID
    while low < high:
        middle = (low + high + 1) // 2
        if a[:ID * middle] == b[:ID * middle]:
            low = middle
        else:
            high = middle - 1
    return low


def forest(rows: pd.DataFrame, block: int, deepest_first: bool) -> pd.DataFrame:
    """Nodes of one partition's rows, which stand in sorted order; see ``FOREST`` for the records.

    Kind "closed": a finished node; "open": this partition's share of a node that reaches over its end; "ends": the ids of
    the conversations that end in an open node. ``deepest_first``: rows of a later block, whose entry is a node of the one before.
    """
    entry, path, conv = rows["entry"].tolist(), rows["path"].tolist(), rows["conv_id"].to_numpy(np.int64).tolist()
    words, ends = rows["words"].tolist(), rows["ends"].tolist()
    below = [rows[c].to_numpy(np.int64).tolist() for c in ("below_children", "below_leaves", "below_saved")]
    lcp_left, lcp_right, m = int(rows["lcp_left"].iloc[0]), int(rows["lcp_right"].iloc[0]), len(rows)
    lcp = [-1] + [shared(path[i - 1], path[i]) if entry[i - 1] == entry[i] else -1 for i in range(1, m)]
    out: list[dict] = []

    # Components are runs of rows, held at the row that stands for them.
    root, left, right = list(range(m)), list(range(m)), list(range(m))
    depth, n, least = [len(p) // ID for p in path], [1] * m, conv[:]
    length = depth[:]
    children, leaves, saved, waiting = [0] * m, [0] * m, [0] * m, [[] for _ in range(m)]

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def lift(c: int, to: int) -> None:
        """Give out the nodes of component ``c`` deeper than ``to``; it then stands for one child at ``to``."""
        i, j = left[c], right[c]
        while depth[c] > to:
            d = depth[c]
            node = {"id": entry[i] if d == 0 else path[i][ID * (d - 1):ID * d], "depth": d, "conv": least[c], "n": n[c],
                    "parent": None if d == 0 else entry[i] if d == 1 else path[i][ID * (d - 2):ID * (d - 1)],
                    "words": int(words[i][d - 1]) if d else 0}
            ending, r = [], i
            while r <= j and length[r] == d:
                if ends[r] and not (deepest_first and d == 0):
                    ending.append(conv[r])
                r += 1
            listed = ",".join(map(str, ending))
            under = [b[i] if d == block else 0 for b in below]
            if (i == 0 and lcp_left >= d) or (j == m - 1 and lcp_right >= d):
                out.append(node | {"kind": "open", "children": children[c], "leaves": leaves[c], "saved": saved[c], "path": entry[i] + path[i][:ID * d],
                                   "below_children": under[0], "below_leaves": under[1], "below_saved": under[2]})
                if ending:
                    out.append({"kind": "ends", "id": node["id"], "first": ending[0], "chunk": listed})
                waiting[c], children[c] = [], 0
            else:
                children[c] += under[0]
                leaves[c] = leaves[c] + under[1] if children[c] else 1
                saved[c] += under[2] + (n[c] - 1) * node["words"]
                for child in waiting[c]:
                    child["parent_conv"] = least[c]
                closed = node | {"kind": "closed", "children": children[c], "leaves": leaves[c], "saved": saved[c],
                                 "ends": hashlib.sha256(listed.encode()).hexdigest() if ending else NOTHING}
                out.append(closed)
                waiting[c], children[c] = [closed], 1
            depth[c] = d - 1

    for i in sorted((i for i in range(1, m) if lcp[i] >= 0), key=lcp.__getitem__, reverse=True):
        a, b = find(i - 1), find(i)
        for c in (a, b):
            lift(c, lcp[i])
        if len(waiting[a]) < len(waiting[b]):
            waiting[a], waiting[b] = waiting[b], waiting[a]
        waiting[a] += waiting[b]
        root[b], right[a], least[a] = a, right[b], min(least[a], least[b])
        n[a], children[a], leaves[a], saved[a] = n[a] + n[b], children[a] + children[b], leaves[a] + leaves[b], saved[a] + saved[b]
    for c in [i for i in range(m) if root[i] == i]:
        lift(c, -1)
    columns = {f: [x.get(f) for x in out] for f in FIELDS}
    texts = {"kind", "id", "parent", "ends", "path", "chunk"}
    return pd.DataFrame({f: pd.Series(v, dtype=object if f in texts else "Int64") for f, v in columns.items()})


def block_nodes(rows: DataFrame, block: int, later: bool) -> tuple[DataFrame, DataFrame]:
    """(closed nodes, merged open nodes) of one block's rows (see ``paths``, with what lies ``below_`` full paths)."""
    spark = rows.sparkSession
    order = ["entry", "path", "conv_id"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = written(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "trie-rows")
    key = F.struct("entry", "path")
    bounds = sorted(placed.groupBy("part").agg(F.min(key).alias("first"), F.max(key).alias("last")).collect())  # two paths a partition
    between = [shared(a["last"]["path"], b["first"]["path"]) if a["last"]["entry"] == b["first"]["entry"] else -1 for a, b in zip(bounds, bounds[1:])]
    ends = [(row["part"], x, y) for row, x, y in zip(bounds, [-1, *between], [*between, -1])]
    edges = spark.createDataFrame(ends, "part int, lcp_left int, lcp_right int")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return forest(rows.sort_values(order, ignore_index=True), block, later)

    found = written(placed.join(F.broadcast(edges), "part").groupBy("part").applyInPandas(run, FOREST), "trie-forest")
    parts = found.where("kind = 'open'").groupBy("id").agg(
        *[F.max(c).alias(c) for c in ("parent", "depth", "words", "path", "below_children", "below_leaves", "below_saved")],
        *[F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")], F.min("conv").alias("conv"))
    opened = parts.groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("opened"))
    whole = written(parts.join(opened, "id", "left").withColumn(
        "children", F.col("children") + F.coalesce("opened", F.lit(0)) + F.col("below_children")).drop("opened"), "trie-open")
    up = F.transform(F.sequence(F.lit(0), F.col("depth").cast("int")), lambda d: F.substring(F.col("path"), d * ID + 1, F.lit(ID)))
    own = whole.select(F.explode(up).alias("id"), F.when(F.col("children") == 0, 1).otherwise(F.col("below_leaves")).alias("l"),
                       ((F.col("n") - 1) * F.col("words") + F.col("below_saved")).alias("s"))
    sums = own.groupBy("id").agg(F.sum("l").alias("l"), F.sum("s").alias("s"))
    merged = whole.join(sums, "id").withColumns({"leaves": F.col("leaves") + F.col("l"), "saved": F.col("saved") + F.col("s")})
    merged = written(merged.join(_digests(found), "id", "left").select(
        "id", "parent", "depth", "conv", "n", "children", "leaves", "saved", F.coalesce("ends", F.lit(NOTHING)).alias("ends")), "trie-merged")
    return found.where("kind = 'closed'"), merged


def _digests(found: DataFrame) -> DataFrame:
    """(id, ends): SHA-256 of the ids that end in an open node. The lists come ready-made from the partitions, and a
    digest takes them one by one in order, in constant memory."""
    chunks = found.where("kind = 'ends'").select("id", "first", "chunk")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for rows in frames:
            for id_, chunk in zip(rows["id"], rows["chunk"]):
                if id_ != now:
                    if now is not None:
                        yield pd.DataFrame({"id": [now], "ends": [state.hexdigest()]})
                    now, state = id_, hashlib.sha256(chunk.encode())
                else:
                    state.update(b"," + chunk.encode())
        if now is not None:
            yield pd.DataFrame({"id": [now], "ends": [state.hexdigest()]})

    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return chunks.repartition(n, "id").sortWithinPartitions("id", "first").mapInPandas(run, "id string, ends string")


def nodes(turns: DataFrame, turnless: DataFrame, block: int = BLOCK) -> DataFrame:
    """The nodes of the trie over (conv_id, position, key, words, length) and conversations without turns.

    A node for each distinct sequence of first turns: conv_id (its smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens (over its subtree, (members - 1) times the words of a node's last turn) and ends_sha256 (of
    the conversations that end in it). Without conversations there is no node. A round for each ``block`` turns of
    the longest conversation; a later round only handles those that reach it.
    """
    importable(turns.sparkSession)
    rows = written(paths(turns, turnless, block), "trie-paths")
    top, out, below = rows.agg(F.max("block")).first()[0], [], None
    for at in range(top if top is not None else 0, -1, -1):
        here, names = rows.where(F.col("block") == at).drop("block"), ("below_children", "below_leaves", "below_saved")
        if below is None:
            here = here.withColumns({c: F.lit(0).cast("long") for c in names})
        else:
            bottom = F.when(F.length("path") == ID * block, F.substring("path", ID * (block - 1) + 1, ID))
            here = here.withColumn("bottom", bottom).join(below, F.col("bottom") == F.col("below_id"), "left").drop("bottom", "below_id").na.fill(0, list(names))
        closed, merged = block_nodes(here, block, at > 0)
        tops = [df.where("depth = 0").selectExpr("id AS below_id", "children AS below_children", "leaves AS below_leaves", "saved AS below_saved") for df in (closed, merged)]
        below = written(tops[0].union(tops[1]), "trie-below") if at else None
        # Open nodes: at most two paths a partition. Left to the size check of the join, as closed nodes are many.
        parents = merged.select(F.col("id").alias("parent"), F.col("conv").alias("open_conv"))
        for df in (closed.withColumn("known", F.col("parent_conv")), merged.withColumn("known", F.lit(None).cast("long"))):
            lifted = df.where("depth > 0") if at else df
            out.append(lifted.join(parents, "parent", "left").select(
                F.col("conv").alias("conv_id"), (F.col("depth") + at * block).alias("depth"), F.coalesce("known", "open_conv").alias("parent_conv_id"),
                F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
                F.col("ends").alias("ends_sha256")))
    result = out[0]
    for df in out[1:]:
        result = result.union(df)
    return result


def conversation_trie(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """The trie of (conv_id, turn, role, text) as they stand; see ``ordered`` and ``nodes``."""
    own = with_length(ordered(turns))
    return nodes(own, own.select("conv_id").limit(0), block)
