"""Conversation prefix trie: burst tries over turn sequences.

A turn's id is the 128-bit hash of its role and text, a node's id the hash chained along the turns that
lead to it, so that a node is the same wherever it is made.

1. Conversations become rows of packed turn ids and node ids. Equal sequences are one row from here on
   (counted before the exchange), so thousands of copies weigh as much as one.
2. All sequences start in one suffix container under the trie's root. A container of more than
   ``CONTAINER`` turn ids bursts: its sequences move on to containers under the nodes that their next
   turn ids lead to, by 1, 2, 4, ... turns in turn, and the nodes passed become trie heads. Rounds grow with
   the logarithm of the longest sequence. Sizes and heads are grouped sums, so a hot first turn is
   no hot task.
3. The containers that remain are dealt to shards by their head, sorted by path, and swept: of each
   sequence only what the one before does not share opens a node; a node closes with its whole subtree known.
4. Heads get their subtrees' sums from the containers and heads below them, by grouped sums over the
   ancestors.

Defined results: a null role or text is empty; rows without a conversation id belong to no conversation
and are left out; turns that repeat a turn number follow each other in the order of their ids, equal
rows stay separate turns; other columns are ignored; an empty table has no node, not even a root. The
turn ids of one conversation (16 bytes each) are one row; texts are never gathered.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm import common as c
from corpuslab.operators.ranking import broadcast_if_small

CONTAINER = 4096  # turn ids above which a container of several sequences bursts
ROOT = bytes(16)
ID_BLOCK = 12  # bits of a conversation id inside one block of a digest
EMIT = 20_000  # node rows handed on together

_ROOT_SQL = f"unhex('{ROOT.hex()}')"
_NODE = "node binary, parent binary, depth long, turn binary, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, at (the turn's number), role, text, turn (its 128-bit id), words: one row a turn."""
    clean = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("at"),
                                 F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    marked = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))))
    return clean.where("conv_id is not null").withColumn("turn", marked).withColumn("words", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id and seq, its turns (turn, words) in order."""
    by = turns(conversations).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "turn", "words"))).alias("s"))
    return by.select("conv_id", F.transform("s", lambda t: F.struct(t["turn"].alias("turn"), t["words"].alias("words"))).alias("seq"))


def rebuilt(seqs: DataFrame, family: int = 20, most: int = 3) -> DataFrame:
    """Each conversation c with its first h = crc32(c) % (most + 1) turns taken from conversation c - c % family."""
    donors = seqs.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("donor"), F.slice("seq", 1, most).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % (most + 1)).cast("int")
    taken = F.slice(F.coalesce("head", F.slice("seq", 1, 0)), F.lit(1), h)
    own = F.slice("seq", h + 1, F.size("seq"))
    joined = seqs.join(donors, F.col("conv_id") - F.col("conv_id") % family == F.col("donor"), "left")
    return joined.select("conv_id", F.concat(taken, own).alias("seq"))


def _paths(seqs: DataFrame) -> DataFrame:
    """conv_id, key (node where it ends), path and turns (16 bytes a turn), words, len."""

    def chain(batches):
        for pdf in batches:
            keys, paths, ids, words = [], [], [], []
            for seq in pdf["seq"]:
                node, path = ROOT, []
                for t in seq:
                    node = hashlib.blake2b(node + t["turn"], digest_size=16).digest()
                    path.append(node)
                keys.append(node)
                paths.append(b"".join(path))
                ids.append(b"".join(t["turn"] for t in seq))
                words.append([t["words"] for t in seq])
            yield pd.DataFrame({"conv_id": pdf["conv_id"], "key": keys, "path": paths, "turns": ids, "words": words, "len": [len(w) for w in words]})

    return seqs.select("conv_id", "seq").mapInPandas(chain, "conv_id long, key binary, path binary, turns binary, words array<int>, len int")


def _node_at(depth: str) -> str:
    return f"CASE WHEN {depth} <= 0 THEN {_ROOT_SQL} ELSE substring(path, cast({depth} * 16 - 15 as int), 16) END"


def _burst(distinct: DataFrame, limit: int):
    """Containers (rows with their head and its depth ``at``) and heads, the nodes above them."""
    live, at, step, settled, heads = distinct, 0, 1, [], []
    while True:
        held = live.withColumn("head", F.expr(_node_at(str(at)))).withColumn("at", F.lit(at))
        large = c.checkpointed(held.groupBy("head").agg(F.sum(F.col("len") - at + 1).alias("ids"), F.count("*").alias("rows")).where(f"ids > {limit} and rows > 1").select("head"))
        if not large.take(1):
            settled.append(held)
            break
        large = broadcast_if_small(large)
        settled.append(held.join(large, "head", "left_anti"))
        burst = c.checkpointed(held.join(large, "head", "left_semi"))
        last = f"least(len, {at + step - 1})"
        passed = F.expr(f"""transform(sequence({at}, {last}), d -> struct({_node_at('d')} AS node, CASE WHEN d > 0 THEN {_node_at('(d - 1)')} END AS parent,
            cast(d as long) AS depth, CASE WHEN d > 0 THEN substring(turns, d * 16 - 15, 16) END AS turn, CASE WHEN d > 0 THEN words[d - 1] ELSE 0 END AS words))""")
        heads.append(c.checkpointed(burst.select("n", "least", F.explode(passed).alias("x")).groupBy("x.node", "x.parent", "x.depth", "x.turn", "x.words")
                                    .agg(F.min("least").alias("conv_id"), F.sum("n").alias("n_convs"))))
        at, step = at + step, step * 2
        live = burst.where(f"len >= {at}").drop("head", "at")
    containers = settled[0]
    for more in settled[1:]:
        containers = containers.unionByName(more)
    found = None
    for more in heads:
        found = more if found is None else found.unionByName(more)
    return containers, found


def _shared(a: bytes, b: bytes) -> int:
    """Turns that two paths share: node ids are chained, so equal ids at a depth mean equal beginnings."""
    low, high = 0, min(len(a), len(b)) // 16
    while low < high:
        mid = (low + high + 1) // 2
        if a[16 * mid - 16 : 16 * mid] == b[16 * mid - 16 : 16 * mid]:
            low = mid
        else:
            high = mid - 1
    return low


class _Sweep:
    """Nodes of sorted containers. A frame is an open node: its row, and the rows of its children."""

    def __init__(self):
        self.rows: list[list] = []
        self.frames: list[tuple[list, list]] = []
        self.head, self.path = None, b""

    def open(self, at, depth, path, turns, words):
        node = path[16 * depth - 16 : 16 * depth] if depth else ROOT
        parent = None if not depth else path[16 * depth - 32 : 16 * depth - 16] if depth > 1 else ROOT
        turn, held = (turns[16 * depth - 16 : 16 * depth], int(words[depth - 1])) if depth else (None, 0)
        # node, parent, depth, turn, conv, parent's conv, n, children, leaves, saved, top, words
        self.frames.append(([node, parent, depth, turn, None, None, 0, 0, 0, 0, depth == at, held], []))

    def close(self, depth):
        """Closes the open nodes deeper than ``depth``."""
        while self.frames and self.frames[-1][0][2] > depth:
            row, children = self.frames.pop()
            row[8] += not children
            row[9] += (row[6] - 1) * row[11]
            for child in children:
                child[5] = row[4]
            if self.frames:
                above, beside = self.frames[-1]
                above[4] = row[4] if above[4] is None else min(above[4], row[4])
                for k in (6, 8, 9):
                    above[k] += row[k]
                above[7] += 1
                beside.append(row)
            self.rows.append(row)

    def add(self, head, at, path, turns, words, n, least):
        if head != self.head:
            self.close(-1)
            self.head, shared = head, at - 1
        else:
            shared = _shared(self.path, path)
            self.close(shared)
        for depth in range(shared + 1, len(path) // 16 + 1):
            self.open(at, depth, path, turns, words)
        end = self.frames[-1][0]
        end[4] = least if end[4] is None else min(end[4], least)
        end[6] += n
        self.path = path


def _sweep(batches):
    s = _Sweep()
    names = [x.split()[0] for x in _NODE.split(", ")] + ["top", "words"]

    def out():
        rows, s.rows = s.rows, []
        df = pd.DataFrame(rows, columns=names)
        df["parent_conv_id"] = df["parent_conv_id"].astype("Int64")
        return df.drop(columns="words")

    for pdf in batches:
        for row in zip(pdf["head"], pdf["at"].tolist(), pdf["path"], pdf["turns"], pdf["words"], pdf["n"].tolist(), pdf["least"].tolist()):
            if len(s.rows) >= EMIT and row[0] != s.head:
                s.close(-1)  # a container's rows are handed on together: its nodes know their parents then
                s.head = None
                yield out()
            s.add(*row)
    s.close(-1)
    if s.rows:
        yield out()


def trie(seqs: DataFrame, limit: int = CONTAINER) -> tuple[DataFrame, DataFrame]:
    """Nodes of the trie of (conv_id, seq) rows, one a conversation, and where each conversation ends.

    Nodes: node, parent (ids), depth, turn (id of the last turn; see ``turns``), conv_id (smallest member),
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens. Ends: conv_id, key (a node)."""
    convs = c.checkpointed(_paths(seqs))
    distinct = c.checkpointed(convs.groupBy("key").agg(F.count("*").alias("n"), F.min("conv_id").alias("least"), *[F.first(x).alias(x) for x in ("path", "turns", "words", "len")]))
    containers, heads = _burst(distinct, limit)
    dealt = containers.select("head", "at", "path", "turns", "words", "n", "least").repartition("head").sortWithinPartitions("head", "path")
    swept = dealt.mapInPandas(_sweep, _NODE + ", top boolean")
    names = [x.split()[0] for x in _NODE.split(", ")]
    ends = convs.select("conv_id", "key")
    if heads is None:
        return swept.select(*names), ends
    swept, heads = c.checkpointed(swept), c.checkpointed(heads)
    tops = swept.where("top")
    children = tops.select("parent").unionByName(heads.select("parent")).groupBy("parent").agg(F.count("*").alias("n_children")).withColumnRenamed("parent", "node")
    heads = c.checkpointed(heads.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))
    # what every top of a container and every head adds to the heads above it (a head to itself as well)
    adds = tops.select("conv_id", (F.col("depth") - 1).alias("to"), "n_leaves", "saved_tokens").unionByName(
        heads.select("conv_id", F.col("depth").alias("to"), (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens")))
    above = F.expr(f"transform(sequence(0L, to), d -> {_node_at('d')})")
    sums = adds.join(distinct.select(F.col("least").alias("conv_id"), "path"), "conv_id").select("n_leaves", "saved_tokens", F.explode(above).alias("node")).groupBy("node").agg(
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    known = broadcast_if_small(heads.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id")))
    upper = heads.join(sums, "node").join(known, "parent", "left").select(*names)
    lower = tops.drop("parent_conv_id").join(known, "parent", "left").select(*names)
    return swept.where("not top").select(*names).unionByName(lower).unionByName(upper), ends


def end_digests(ends: DataFrame) -> DataFrame:
    """key and the SHA-256 of the ids that end there, ascending, comma-joined. Ids are joined to blocks
    of nearby ids first; a node's blocks then pass one digest in order, one batch in memory."""
    block = F.shiftright("conv_id", ID_BLOCK)
    parts = ends.groupBy("key", block.alias("block")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("ids"))

    def digest(batches):
        key, sha = None, None
        for pdf in batches:
            keys, shas = [], []
            for k, ids in zip(pdf["key"], pdf["ids"]):
                if k != key:
                    if sha is not None:
                        keys.append(key)
                        shas.append(sha.hexdigest())
                    key, sha = k, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield pd.DataFrame({"key": keys, "sha": shas})
        if sha is not None:
            yield pd.DataFrame({"key": [key], "sha": [sha.hexdigest()]})

    return parts.repartition("key").sortWithinPartitions("key", "block").mapInPandas(digest, "key binary, sha string")


def query(spark, sf_dir: str) -> DataFrame:
    nodes, ends = trie(rebuilt(sequences(spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet"))))
    digests = end_digests(ends).withColumnRenamed("key", "node")
    none = F.sha2(F.lit("").cast("binary"), 256)
    return nodes.join(digests, "node", "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha", none).alias("ends_sha256"))
