"""MinHash near-duplicates: bottom-k sketches of one hash function.

A document's set is its distinct ``SHINGLE``-word shingles (A-Z lower-cased, words
``[^\\x20\\x09-\\x0D]+``); with fewer words the whole sequence is one, without words the set is empty.
Documents are linked if 100 |A and B| >= percent |A or B|: 85 for the query, 80 for the pipeline's stage.

1. One hash function gives each set its sketch: the K smallest shingle hashes. Equal sets are one
   class from here on, so thousands of copies are one row.
2. Inverted lists of retained values generate candidates. Two linked sets share at least ``SHARED``
   values of their sketches; K is the smallest number for which this fails with a chance below ``MISS``
   (a binomial of K draws at percent / 100: K = 33 at 85, 37 at 80), so
   each class may skip its SHARED - 1 most frequent ones: boilerplate makes no long lists.
3. Each member of a list is paired with the list's leader: candidates grow with the rows, never
   with the square of a list. Pairs must pass the estimate on the union's sketch, then exact Jaccard
   on the full sets of both whole texts; links are joined to components.
4. Lists that still hold several components are compared in full, by pairs of bounded pieces: sketch
   estimate first, exact sets after, within one task a pair of already linked members is skipped.
   So no link between different texts is lost and none is assumed.

Defined results: null and empty texts: set size 0, linked with nothing, kept. A null id counts as one
id later than all others. Rows that repeat an id are rows of one document: linked if one of its texts
is. The component is the smallest id reachable. Empty table: no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm import common as c
from corpuslab.operators.ranking import broadcast_if_small

SHINGLE, SHARED, PERCENT, MISS = 5, 14, 85, 1e-8
PIECE = 1024  # members of a list compared with each other at once
AT_ONCE = 512  # texts encoded together
SIGN = np.uint64(1 << 63)  # flipped, so that signed columns and SQL have the order of the unsigned hashes
SMALL = 32  # members of a list whose pairs are joined in plain rows


def sketch_size(percent: int) -> int:
    """Smallest K of which linked sets share SHARED values but for a chance below MISS."""
    p, k = percent / 100, SHARED
    while sum(math.comb(k, i) * p**i * (1 - p) ** (k - i) for i in range(SHARED)) >= MISS:
        k += 1
    return k


def shingle_sets(texts: list[bytes], size: int = SHINGLE):
    """Sorted distinct 64-bit shingle hashes of each text."""
    for first, last in c.chunks(texts):
        words, bounds = c.word_units([t.translate(c.LOWER) for t in texts[first:last]])
        pre = c.prefix(words)
        at = np.arange(max(0, len(words) - size + 1))
        grams = c.span_hash(pre, at, at + size)
        for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if y - x >= size:
                yield np.unique(grams[x : y - size + 1])
            else:
                yield c.span_hash(pre, np.array([x]), np.array([y])) if y > x else np.zeros(0, np.uint64)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def signatures(docs: DataFrame, percent: int, id_col="doc_id", text_col="text") -> DataFrame:
    """doc, n (set size), h1, h2 (hash of the set), sketch."""
    k = sketch_size(percent)
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(c.NULL_ID)).alias("doc"), F.col(text_col).cast("string").alias("text"))

    def sign(batches):
        for pdf in batches:
            n, h1, h2, sketch = [], [], [], []
            for lo in range(0, len(pdf), AT_ONCE):
                for s in shingle_sets(c.encode(pdf["text"].iloc[lo : lo + AT_ONCE])):
                    n.append(len(s))
                    h1.append(int(c.mix(s * np.uint64(0x9FB21C651E98DF25)).sum().astype(np.int64)))
                    h2.append(int(c.mix(s ^ np.uint64(0x3C6EF372FE94F82B)).sum().astype(np.int64)))
                    sketch.append((s[:k] ^ SIGN).astype(np.int64))
            yield pd.DataFrame({"doc": pdf["doc"], "n": n, "h1": h1, "h2": h2, "sketch": sketch})

    return base.mapInPandas(sign, "doc long, n long, h1 long, h2 long, sketch array<long>")


def _need(n: str, percent: int) -> str:
    """SQL: values that the sketches of two linked sets share at least, the smaller set having n.

    With p = percent / 100, of n/p shingles in the union at most (1 - p) n/p are not shared, so
    K - (1 - p) n/p of the K smallest are; a sketch that is the whole set lacks none but what the
    other sketch leaves out."""
    k, most = sketch_size(percent), f"floor(100 * {n} / {percent})"
    return (f"CASE WHEN {n} <= {k} THEN ceil({percent} * {n} / 100) - greatest(0, {most} - {k}) "
            f"ELSE greatest({SHARED}, {k} - floor({100 - percent} * {n} / {percent})) END")


def _lists(classes: DataFrame, percent: int, held: c.Scratch) -> DataFrame:
    """(v, id): members of the inverted lists that can make a candidate."""
    values = classes.select("id", F.expr(f"cast({_need('n', percent)} as int)").alias("need"), F.size("sketch").alias("s"), F.explode("sketch").alias("v"))
    often = held(values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1"))
    common = values.join(often, "v").groupBy("id").agg(F.first("need").alias("need"), F.first("s").alias("s"), F.sort_array(F.collect_list(F.struct("df", "v"))).alias("by"))
    # values that no other class has are the rarest and need no list
    rare = F.col("s") - F.size("by")
    keep = F.greatest(F.lit(0), F.col("s") - F.col("need") + 1 - rare)
    return common.select("id", F.explode(F.slice("by", F.lit(1), keep.cast("int"))).alias("x")).select("x.v", "id")


def _estimated(a: str, b: str, percent: int) -> str:
    """Shared values in the union's sketch reach what linked sets have."""
    union = f"slice(array_sort(array_union({a}.sketch, {b}.sketch)), 1, {sketch_size(percent)})"
    return f"size(array_intersect({union}, array_intersect({a}.sketch, {b}.sketch))) >= {_need(f'least({a}.n, {b}.n)', percent)}"


def _by_leader(lists: DataFrame, held: c.Scratch) -> DataFrame:
    """Distinct pairs (a, b): member and leader of a list. The leader is the member of most lists: of
    many copies with edits, the one nearest to what they have in common."""
    central = held(lists.join(held(lists.groupBy("id").agg(F.count("*").alias("n"))), "id"))
    leader = held(central.groupBy("v").agg(F.max(F.struct("n", (-F.col("id")).alias("i"))).alias("l"), F.count("*").alias("m")).where("m > 1").select("v", (-F.col("l.i")).alias("b")))
    return lists.join(leader, "v").where("id <> b").select(F.greatest("id", "b").alias("a"), F.least("id", "b").alias("b")).distinct()


def _confirmed(pairs: DataFrame, classes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs that pass the estimate and whose full sets are linked."""
    sketches = classes.select("id", "n", "sketch")
    for side in "ab":
        s = sketches.select(F.col("id").alias(side), F.struct("n", "sketch").alias(f"s{side}"))
        pairs = pairs.join(s, side)
    pairs = pairs.where(F.expr(_estimated("sa", "sb", percent))).select("a", "b")
    for side in "ab":
        pairs = pairs.join(texts.select(F.col("id").alias(side), F.col("z").alias(f"z{side}")), side)

    def confirm(batches):
        for pdf in batches:
            seen: dict[bytes, np.ndarray] = {}
            keep = []
            for za, zb in zip(pdf["za"], pdf["zb"]):
                sets = []
                for z in (za, zb):
                    if z not in seen:
                        if len(seen) > 512:
                            seen.clear()
                        seen[z] = next(shingle_sets([zlib.decompress(z)]))
                    sets.append(seen[z])
                keep.append(linked(*sets, percent))
            yield pdf.loc[keep, ["a", "b"]]

    return pairs.mapInPandas(confirm, "a long, b long")


def _parts(lists: DataFrame, links: DataFrame, held: c.Scratch) -> DataFrame:
    """Lists with the component of each member, without lists that are one component."""
    found = c.components(links)
    lists = held(lists.join(found, "id", "left").select("v", "id", F.coalesce("component", "id").alias("part")))
    open_ = held(lists.groupBy("v").agg(F.min("part").alias("x"), F.max("part").alias("y"), F.count("*").alias("m")).where("x <> y").select("v", "m"))
    return held(lists.join(open_, "v"))


def _common(groups: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets: values of many sets by a matrix product,
    values of few by counting their pairs."""
    n = len(groups)
    inverse, often = np.unique(np.concatenate(groups), return_inverse=True, return_counts=True)[1:]
    owner = np.repeat(np.arange(n), [len(s) for s in groups])
    order = np.argsort(inverse, kind="stable")
    owner, first = owner[order], np.cumsum(often) - often
    wide = np.flatnonzero(often > 32)
    out = np.zeros((n, n), np.float32)
    for low in range(0, len(wide), 1024):
        part = wide[low : low + 1024]
        table = np.zeros((n, len(part)), np.float32)
        for k, v in enumerate(part):
            table[owner[first[v] : first[v] + often[v]], k] = 1
        out += table @ table.T
    out = out.astype(np.int64).ravel()
    for size in range(2, 33):
        at = first[often == size]
        if len(at):
            sets = owner[at[:, None] + np.arange(size)]
            out += np.bincount((sets[:, :, None] * n + sets[:, None, :]).ravel(), minlength=n * n)
    return out.reshape(n, n)


def _sides(g: pd.DataFrame, x, y, percent: int) -> np.ndarray:
    """Which pairs of a group belong to it: within piece x, or between pieces x and y."""
    i = g["i"].to_numpy()
    pairs = np.triu(np.ones((len(g), len(g)), bool), 1) if x == y else (i[:, None] == x) & (i[None] == y)
    part, n = g["part"].to_numpy(), g["n"].to_numpy()
    return pairs & (part[:, None] != part[None]) & (100 * np.minimum.outer(n, n) >= percent * np.maximum.outer(n, n))


def _pieces(lists: DataFrame, held: c.Scratch) -> DataFrame:
    """v, id, part, piece i and the pairs of pieces that a member meets others in.

    Only members of different parts can make a new link. So the members of a list's largest part (pieces
    0, 1, ...) meet the rest, and the rest (pieces -1, -2, ...) meets all: where most of a list hangs
    together, its members go to one task each, not to one for every other piece."""
    of_part = lists.groupBy("v", "part").agg(F.count("*").alias("k"))
    sizes = of_part.groupBy("v").agg(F.max(F.struct("k", (-F.col("part")).alias("p"))).alias("top"), F.sum("k").alias("m"))
    sizes = held(sizes.select("v", (-F.col("top.p")).alias("large"), F.ceil(F.col("top.k") / PIECE).cast("int").alias("pl"), F.ceil((F.col("m") - F.col("top.k")) / PIECE).cast("int").alias("pr")))
    placed = lists.select("v", "id", "part").join(sizes, "v").withColumn("of_large", F.col("part") == F.col("large"))
    drawn = F.xxhash64("id", "v")
    placed = placed.withColumn("i", F.when(F.col("of_large"), F.pmod(drawn, F.col("pl"))).otherwise(-1 - F.pmod(drawn, F.col("pr"))).cast("int"))
    met = F.when(F.col("of_large"), F.sequence(-F.col("pr"), F.lit(-1))).otherwise(F.sequence(-F.col("pr"), F.col("pl") - 1))
    return placed.select("v", "id", "part", "i", F.transform(met, lambda j: F.struct(F.least("i", j).alias("x"), F.greatest("i", j).alias("y"))).alias("pairs"))


def _in_full(lists: DataFrame, every: DataFrame, classes: DataFrame, texts: DataFrame, percent: int, held: c.Scratch) -> DataFrame:
    """Links between different components of the same list. Lists of up to SMALL members give their
    pairs as rows (rows x SMALL at most); longer ones are compared by pairs of pieces of about PIECE.
    A pair belongs to the first list that both are in; only members of a pair that passes the
    estimate bring their texts."""
    k = sketch_size(percent)
    other = lists.where(F.col("m") <= SMALL).select("v", F.col("id").alias("b"), F.col("part").alias("pb"))
    few = lists.where(F.col("m") <= SMALL).join(other, "v").where("id > b and part <> pb").select(F.col("id").alias("a"), "b").distinct()
    small = _confirmed(few, classes, texts, percent)
    members = held(_pieces(lists.where(F.col("m") > SMALL), held))
    # a class's lists as bits of the places of their values in its sketch
    mine = every.join(members.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.collect_set("v").alias("mine")).join(classes.select("id", "n", "sketch"), "id")
    bits = "aggregate(sequence(1, size(sketch)), 0L, (acc, p) -> CASE WHEN array_contains(mine, sketch[p - 1]) THEN acc | shiftleft(1L, p - 1) ELSE acc END)"
    mine = held(mine.select("id", "n", F.expr(bits).alias("mine"), "sketch"))
    fanned = members.agg(F.sum(F.size("pairs"))).first()[0] or 0
    rows = members.join(mine, "id").select("v", "i", "id", "part", "n", "mine", "sketch", F.explode("pairs").alias("p")).select("v", "p.x", "p.y", "i", "id", "part", "n", "mine", "sketch")

    def owned(key, pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (v, x, y), g in pdf.groupby(["v", "x", "y"], sort=False):
            g = g.drop_duplicates("id")
            if g["part"].nunique() < 2:
                continue
            pairs = _sides(g, x, y, percent)
            before = [s[((bits >> np.arange(len(s))) & 1 == 1) & (s < v)] for s, bits in zip(g["sketch"], g["mine"])]
            if sum(map(len, before)):
                pairs &= _common(before) == 0
            if not pairs.any():
                continue
            n = g["n"].to_numpy()
            low = np.minimum.outer(n, n)
            most = 100 * low // percent
            need = np.where(low <= k, -(-percent * low // 100) - np.maximum(0, most - k), np.maximum(SHARED, k - (100 - percent) * low // percent))
            pairs &= _common(g["sketch"].tolist()) >= need
            hit = pairs.any(0) | pairs.any(1)
            if hit.any():
                out.append(g.loc[hit, ["v", "x", "y", "i", "id", "part", "n"]])
        return pd.concat(out) if out else pd.DataFrame({k: [] for k in ("v", "x", "y", "i", "id", "part", "n")})

    def compare(key, pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (_, x, y), g in pdf.groupby(["v", "x", "y"], sort=False):
            sets = list(shingle_sets([zlib.decompress(z) for z in g["z"]]))
            pairs = _sides(g.assign(n=[len(s) for s in sets]), x, y, percent)
            n = np.array([len(s) for s in sets])
            both = _common(sets)
            near = pairs & (100 * both >= percent * (n[:, None] + n[None] - both)) & (both > 0)
            ids, part = g["id"].tolist(), g["part"].tolist()
            root = {p: p for p in part}

            def find(p):
                while root[p] != p:
                    root[p] = p = root[root[p]]
                return p

            for i, j in np.argwhere(near).tolist():
                a, b = find(part[i]), find(part[j])
                if a != b:  # members that hang together already need no further link
                    root[a] = b
                    out.append((max(ids[i], ids[j]), min(ids[i], ids[j])))
        return pd.DataFrame(out, columns=["a", "b"])

    def dealt(df: DataFrame, n: int):
        return df.withColumn("g", F.pmod(F.xxhash64("v", "x", "y"), F.lit(max(1, n // PIECE)))).groupBy("g")

    schema = "v long, x int, y int, i int, id long, part long, n long"
    wanted = held(dealt(rows, fanned).applyInPandas(owned, schema))
    return small.union(dealt(wanted.join(texts, "id"), wanted.count()).applyInPandas(compare, "a long, b long"))


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", percent: int = PERCENT) -> DataFrame:
    """doc, n_shingles, component_id, kept for every row."""
    held, kept = c.Scratch(), c.Scratch()
    signed = c.checkpointed(signatures(docs, percent, id_col, text_col))
    classes = kept(signed.where("n > 0").groupBy("h1", "h2").agg(F.min(F.struct(F.col("doc").alias("id"), "n", "sketch")).alias("x")).select("h1", "h2", "x.*"))
    lists = held(_lists(classes, percent, held))
    wanted = _by_leader(lists, held)
    # a text is needed of every member of a list with two members or more
    ids = lists.join(lists.groupBy("v").count().where("count > 1").select("v"), "v", "left_semi").select("id").distinct()
    pairs_of = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(c.NULL_ID)).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")

    def shrink(batches):
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "z": [zlib.compress(c.encode([t])[0], 1) for t in pdf["text"]]})

    # shrunk before the exchange: it moves and sorts a fraction of the bytes
    texts = held(pairs_of.mapInPandas(shrink, "id long, z binary").join(ids, "id", "left_semi"))
    links = held(_confirmed(wanted, classes, texts, percent))
    links = kept(links.union(_in_full(_parts(lists, links, held), lists, classes, texts, percent, held)))
    held.release()
    found = c.components(links)
    of_class = c.checkpointed(classes.join(found, "id", "left").select("h1", "h2", F.coalesce("component", "id").alias("component")))
    kept.release()
    out = signed.select("doc", "n", "h1", "h2").join(of_class, ["h1", "h2"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc"))
    return out.select("doc", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("doc") == F.col("component_id"))


def keep_one(docs: DataFrame, id_col="doc_id", text_col="text", percent: int = PERCENT) -> DataFrame:
    """One row of each group of near duplicates: of the smallest id (null last).

    Here every distinct (id, text) is a document of its own, under a hash of both: different texts under one
    id stay apart, and of rows that repeat id and text one stays (of rows that differ in other columns the one with the
    smallest hash of all columns), null ids and empty texts included. Columns stay as they are, whatever their names."""
    rows, names = c.shielded(docs, (id_col, text_col))
    rows = rows.withColumn("row key", F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string")))
    keys = c.checkpointed(rows.groupBy("row key").agg(F.first(F.coalesce(F.col(id_col).cast("long"), F.lit(c.NULL_ID))).alias("id"), F.count("*").alias("rows")))
    found = near_duplicates(rows, "row key", text_col, percent).select(F.col("doc").alias("row key"), "component_id").distinct()
    found = c.checkpointed(found.join(keys.select("row key", "id"), "row key"))
    best = found.groupBy("component_id").agg(F.min(F.struct("id", "row key")).alias("b")).select("component_id", F.col("b.row key").alias("best"))
    gone = found.join(best, "component_id").where(F.col("row key") != F.col("best")).select("row key")
    left = rows.join(broadcast_if_small(c.checkpointed(gone)), "row key", "left_anti")
    again = broadcast_if_small(c.checkpointed(keys.where("rows > 1").select("row key")))
    packed = F.struct(*[F.col(f"`{x}`") for x in rows.columns])
    once = left.join(again, "row key", "left_semi").groupBy("row key").agg(F.min_by(packed, F.xxhash64(F.to_json(packed))).alias("r")).select("r.*")
    return left.join(again, "row key", "left_anti").select(*rows.columns).unionByName(once).drop("row key").withColumnsRenamed(names).select(*[f"`{x}`" for x in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet"))
    return out.select(c.real_id().alias("doc_id"), "n_shingles", c.real_id("component_id").alias("component_id"), "kept")
