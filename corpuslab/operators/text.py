"""Text -> sequence preparation (tokenise, vocabulary, encode/decode, pairs, k-grams, batches).

Token work stays inside array expressions on the document row wherever it can: pairs, k-gram
windows, chunks and blocks are built from the document's token array, so they need no shuffle.
The only shuffles are the vocabulary count (pre-aggregated map side) and, for ids, one exchange of
whole documents by block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslab.functions import text as tx
from corpuslab.operators import grams
from corpuslab.operators.ranking import broadcast_if_small, exact_rank
from corpuslab.session import small_batches, written


def tokenize(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per token: (*keep, pos from 1, t). Whole texts, every token."""
    return df.select(*keep, F.posexplode(tx.token_array(text_col)).alias("pos0", "t")).select(
        *keep, (F.col("pos0") + 1).alias("pos"), "t"
    )


def token_arrays(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*keep, toks ARRAY<STRING>) - the same tokens kept on the document row."""
    return df.select(*keep, tx.token_array(text_col).alias("toks"))


def build_vocab(tok: DataFrame, max_size: int | None = None) -> DataFrame:
    """(t, c, token_id): ids from 1 by (count desc, token asc); 0 is reserved for padding.
    ``max_size`` keeps the ``max_size`` most frequent tokens (a vocabulary cap is the feature)."""
    return ranked_vocab(tok.groupBy("t").agg(F.count(F.lit(1)).alias("c")), max_size)


def count_tokens(lines: DataFrame, col: str = "line") -> DataFrame:
    """(t, c) of strings whose tokens are joined by single spaces. A task counts about a million tokens at once in Arrow, so
    no row is a token; null and empty strings have none."""

    def run(batches):
        held, total = [], 0

        def flush():
            found = pa.chunked_array(held).value_counts()
            return pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], ["t", "c"])

        for batch in batches:
            held.append(pc.split_pattern(batch.column(0), " ").flatten())
            total += len(held[-1])
            if total >= BLOCK_TOKENS:
                yield flush()
                held, total = [], 0
        if held:
            yield flush()

    found = lines.where(F.col(col) != "").select(col).mapInArrow(run, "t string, c long")
    return found.groupBy("t").agg(F.sum("c").alias("c"))


def ranked_vocab(counts: DataFrame, max_size: int | None = None) -> DataFrame:
    """The vocabulary of (t, c)."""
    ranked = exact_rank(counts, [F.col("c").desc(), F.col("t").asc()], name="token_id")
    if max_size is not None:
        ranked = ranked.where(F.col("token_id") <= max_size)
    return ranked.select("t", "c", F.col("token_id").cast("int").alias("token_id"))


def encode(tok: DataFrame, vocab: DataFrame) -> DataFrame:
    """Token strings -> ids. The vocabulary is broadcast only when its row count is under the
    limit; beyond it the join shuffles on the token and AQE splits hot tokens."""
    v = broadcast_if_small(vocab.select("t", "token_id"))
    return tok.join(v, "t", "inner")


BLOCK_TOKENS = 1_000_000  # tokens of a block of documents
PART_TOKENS = 500_000  # tokens of a part of the vocabulary on average


def _hash(token, seed: int):
    return F.xxhash64(F.lit(seed), token)


def _distinct_seed(vocab: DataFrame) -> tuple[int, int]:
    """The first seed under which no two tokens of the vocabulary share a 64-bit hash, and the number of tokens."""
    for seed in range(16):
        r = vocab.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(_hash(F.col("t"), seed)).alias("d")).first()
        if r["n"] == r["d"]:
            return seed, r["n"]
    raise ValueError("the vocabulary holds a token twice")


def _ints(column, dtype) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype) for x in column.to_pylist()]


def _buffers(parts) -> pa.Array:
    return pa.array([np.ascontiguousarray(x).tobytes() for x in parts], pa.binary())


def _blocks(batches, arrays: str, tokens: int):
    """(documents of a block of about ``tokens`` items in the column ``arrays``, number of the block) of a task's Arrow batches."""
    block, total, made = [], 0, 0
    for batch in batches:
        start, ends = 0, np.cumsum(batch.column(arrays).value_lengths().to_numpy(zero_copy_only=False))
        while start < batch.num_rows:  # a batch may hold several blocks
            before = int(ends[start - 1]) if start else 0
            stop = min(int(np.searchsorted(ends, before + tokens - total)) + 1, batch.num_rows)
            block.append(batch.slice(start, stop - start))
            total += int(ends[stop - 1]) - before
            start = stop
            if total >= tokens:
                yield pa.Table.from_batches(block), TaskContext.get().partitionId() * (1 << 32) + made
                block, total, made = [], 0, made + 1
    if block:
        yield pa.Table.from_batches(block), TaskContext.get().partitionId() * (1 << 32) + made


def encode_arrays(arr: DataFrame, vocab: DataFrame, keep: tuple[str, ...] = ("doc_id",), block_tokens: int = BLOCK_TOKENS, made: list[DataFrame] | None = None) -> DataFrame:
    """(*keep, ids ARRAY<INT>): token arrays written over with their ids. Tokens go as 64-bit hashes, which are
    checked to be different for all tokens of the vocabulary. A task's documents form blocks, whose tokens are numbered
    by falling frequency inside the block; a block's distinct tokens, packed, meet the vocabulary once (a frequent token is one
    entry per block, not one per occurrence), and the ids of its numbers go to its documents, which are exchanged once, as
    numbers. Documents without tokens are left out; a token that the vocabulary lacks is dropped, as ``encode`` does. ``made`` takes
    the numbered documents, a written table that can be dropped once the ids are written."""
    full = arr.where(F.size("toks") > 0).select(*keep, "toks")
    seed, size = _distinct_seed(vocab)
    parts = max(int(arr.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_TOKENS))

    def number(batches):
        for docs, number in _blocks(batches, "h", block_tokens):
            column = docs["h"].combine_chunks()
            words, at, n = np.unique(column.flatten().to_numpy(zero_copy_only=False), return_inverse=True, return_counts=True)
            order = np.argsort(-n, kind="stable")
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order))
            ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
            # the numbers of a document as planes of bytes, which shuffle compression shrinks well
            codes = _buffers(x.astype("<i4").view(np.uint8).reshape(-1, 4).T for x in np.split(place[at], ends[:-1]))
            cols = [*[docs[c].combine_chunks() for c in keep], pa.array([number] * len(docs), pa.int64()), codes, pa.nulls(len(docs), pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names)
            cols = [*[pa.nulls(1, docs.schema.field(c).type) for c in keep], pa.array([number], pa.int64()), pa.nulls(1, pa.binary()), _buffers([words[order]])]
            yield pa.RecordBatch.from_arrays(cols, names)

    def ask(batches):
        for batch in batches:
            for block, words in zip(batch.column("_c").to_pylist(), _ints(batch.column("words"), np.int64)):
                part = words % parts
                order = np.argsort(part, kind="stable")
                at = np.flatnonzero(np.r_[True, np.diff(part[order]) > 0])
                pieces = np.split(order, at[1:])
                cols = [pa.array(part[order][at], pa.int32()), pa.array([block] * len(at), pa.int64()), _buffers(words[x] for x in pieces), _buffers(x.astype(np.int32) for x in pieces)]
                yield pa.RecordBatch.from_arrays(cols, ["_p", "_w", "words", "codes"])

    def meet(asked, known):
        h, ids = (known[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("h", "token_id"))
        order = np.argsort(h)
        h, ids, codes, found = h[order], ids[order], [], []
        for words, code in zip(_ints(asked["words"], np.int64), _ints(asked["codes"], np.int32)):
            at = np.searchsorted(h, words)
            at[at == len(h)] = 0
            there = h[at] == words if len(h) else np.zeros(len(words), bool)
            codes.append(code[there])
            found.append(ids[at[there]].astype(np.int32))
        return pa.table({"_w": asked["_w"], "codes": _buffers(codes), "ids": _buffers(found)})

    def write(docs, dictionary):
        numbers = [np.ascontiguousarray(x.reshape(4, -1).T).view("<i4").reshape(-1) for x in _ints(docs["codes"], np.uint8)]
        flat = np.concatenate([np.zeros(0, np.int32), *numbers])
        table = np.zeros(int(flat.max(initial=-1)) + 1, np.int32)
        for codes, ids in zip(_ints(dictionary["codes"], np.int32), _ints(dictionary["ids"], np.int32)):
            table[codes] = ids
        ids = table[flat]
        ends = np.r_[0, np.cumsum(ids > 0)][np.r_[0, np.cumsum([len(x) for x in numbers])].astype(np.int64)]
        made = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids[ids > 0], pa.int32()))
        return pa.table({**{c: docs[c] for c in keep}, "ids": made})

    names = [*keep, "_c", "codes", "words"]
    kept = [T.StructField(c, full.schema[c].dataType) for c in keep]
    numbered = T.StructType([*kept, T.StructField("_c", T.LongType()), T.StructField("codes", T.BinaryType()), T.StructField("words", T.BinaryType())])
    hashed = full.select(*keep, F.transform("toks", lambda t: _hash(t, seed)).alias("h"))
    with small_batches(full.sparkSession):
        table = written(hashed.mapInArrow(number, numbered))
    if made is not None:
        made.append(table)
    asked = table.where("words is not null").select("_c", "words").mapInArrow(ask, "_p int, _w long, words binary, codes binary")
    known = vocab.select(F.pmod(_hash(F.col("t"), seed), F.lit(parts)).cast("int").alias("_v"), _hash(F.col("t"), seed).alias("h"), "token_id")
    found = asked.groupBy("_p").cogroup(known.groupBy("_v")).applyInArrow(meet, "_w long, codes binary, ids binary")
    docs = table.where("codes is not null").select(*keep, "_c", "codes")
    schema = T.StructType([*kept, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return docs.groupBy("_c").cogroup(found.groupBy("_w")).applyInArrow(write, schema).where(F.size("ids") > 0)


def decode_arrays(arrays: DataFrame, vocab: DataFrame, keep: tuple[str, ...] = ("doc_id",), sep: str = " ", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(*keep, text, n_tokens): id arrays written back as the tokens of ``vocab`` joined by ``sep``, the way back of
    ``encode_arrays``. A task's documents form blocks; a block's distinct ids meet the vocabulary once, and their tokens go to
    the block's documents, which are exchanged once. An id that the vocabulary lacks is dropped, as ``decode`` does; documents
    without a known id are left out."""
    full = arrays.where(F.size("ids") > 0).select(*keep, "ids")
    size = vocab.count()
    parts = max(int(arrays.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_TOKENS))

    def number(batches):
        for docs, block in _blocks(batches, "ids", block_tokens):
            column = docs["ids"].combine_chunks()
            words, at = np.unique(column.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
            ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
            codes = _buffers(x.astype("<i4").view(np.uint8).reshape(-1, 4).T for x in np.split(at.astype(np.int32), ends[:-1]))
            cols = [*[docs[c].combine_chunks() for c in keep], pa.array([block] * len(docs), pa.int64()), codes, pa.nulls(len(docs), pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names)
            cols = [*[pa.nulls(1, docs.schema.field(c).type) for c in keep], pa.array([block], pa.int64()), pa.nulls(1, pa.binary()), _buffers([words.astype(np.int32)])]
            yield pa.RecordBatch.from_arrays(cols, names)

    def ask(batches):
        for batch in batches:
            for block, words in zip(batch.column("_c").to_pylist(), _ints(batch.column("words"), np.int32)):
                part = words % parts
                order = np.argsort(part, kind="stable")
                pieces = np.split(order, np.flatnonzero(np.diff(part[order]) > 0) + 1)
                cols = [pa.array([part[x[0]] for x in pieces], pa.int32()), pa.array([block] * len(pieces), pa.int64()), _buffers(words[x] for x in pieces), _buffers(x.astype(np.int32) for x in pieces)]
                yield pa.RecordBatch.from_arrays(cols, ["_p", "_w", "words", "codes"])

    def meet(asked, known):
        ids, tokens = known["token_id"].combine_chunks().to_numpy(zero_copy_only=False), known["t"].combine_chunks()
        order = np.argsort(ids)
        ids, codes, found = ids[order], [], []
        for words, code in zip(_ints(asked["words"], np.int32), _ints(asked["codes"], np.int32)):
            at = np.minimum(np.searchsorted(ids, words), max(len(ids) - 1, 0))
            there = ids[at] == words if len(ids) else np.zeros(len(words), bool)
            codes.append(code[there])
            found.append(tokens.take(pa.array(order[at[there]])) if there.any() else pa.array([], pa.string()))
        return pa.table({"_w": asked["_w"], "codes": _buffers(codes), "t": pa.array([x.to_pylist() for x in found], pa.list_(pa.string()))})

    def write(docs, dictionary):
        numbers = [np.ascontiguousarray(x.reshape(4, -1).T).view("<i4").reshape(-1) for x in _ints(docs["codes"], np.uint8)]
        table = np.full(max((int(x.max()) for x in numbers), default=-1) + 1, None, object)
        for codes, tokens in zip(_ints(dictionary["codes"], np.int32), dictionary["t"].to_pylist()):
            table[codes] = tokens
        lines = [[t for t in table[x] if t is not None] for x in numbers]
        made = {"text": pa.array([sep.join(x) for x in lines], pa.string()), "n_tokens": pa.array([len(x) for x in lines], pa.int64())}
        return pa.table({**{c: docs[c] for c in keep}, **made})

    names = [*keep, "_c", "codes", "words"]
    kept = [T.StructField(c, full.schema[c].dataType) for c in keep]
    numbered = T.StructType([*kept, T.StructField("_c", T.LongType()), T.StructField("codes", T.BinaryType()), T.StructField("words", T.BinaryType())])
    table = written(full.mapInArrow(number, numbered))
    asked = table.where("words is not null").select("_c", "words").mapInArrow(ask, "_p int, _w long, words binary, codes binary")
    known = vocab.select(F.pmod("token_id", F.lit(parts)).cast("int").alias("_v"), F.col("token_id").cast("int").alias("token_id"), "t")
    found = asked.groupBy("_p").cogroup(known.groupBy("_v")).applyInArrow(meet, "_w long, codes binary, t array<string>")
    docs = table.where("codes is not null").select(*keep, "_c", "codes")
    schema = T.StructType([*kept, T.StructField("text", T.StringType()), T.StructField("n_tokens", T.LongType())])
    return docs.groupBy("_c").cogroup(found.groupBy("_w")).applyInArrow(write, schema).where("n_tokens > 0")


def id_arrays(tok_ids: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Regroup encoded tokens into one ordered id array per document (group = one document,
    bounded by its length)."""
    return tok_ids.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "token_id"))), lambda s: s["token_id"]).alias("ids")
    )


def decode(tok_ids: DataFrame, vocab: DataFrame, keys: tuple[str, ...] = ("doc_id",), sep: str = " ") -> DataFrame:
    """ids -> text (tokens joined by ``sep`` in position order)."""
    v = broadcast_if_small(vocab.select("token_id", "t"))
    return (
        tok_ids.select(*keys, "pos", "token_id")
        .join(v, "token_id")
        .groupBy(*keys)
        .agg(
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("pos", "t"))), lambda s: s["t"]), sep
            ).alias("text"),
            F.count(F.lit(1)).alias("n_tokens"),
        )
    )


def next_pairs(arrays: DataFrame, arr_col: str = "toks", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, pos, t, nxt): predict t+1 at t. Sequences shorter than 2 give nothing."""
    return arrays.select(*keys, F.explode(tx.next_pairs_array(arr_col)).alias("p")).select(*keys, "p.*")


def kgrams(
    arrays: DataFrame, k: int, arr_col: str = "ids", keys: tuple[str, ...] = ("doc_id",), include_current: bool = True
) -> DataFrame:
    """(keys, pos, ctx ARRAY): last k tokens ending at pos (or pos-1), left-padded with 0."""
    return arrays.select(*keys, F.explode(tx.kgram_array(arr_col, k, include_current)).alias("g")).select(*keys, "g.*")


def position_chunks(arrays: DataFrame, size: int, arr_col: str = "ids", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Fixed-size position chunks: (keys, chunk from 0, n, first_id, last_id, chunk ARRAY)."""
    return arrays.select(*keys, F.posexplode(tx.blocks_array(arr_col, size)).alias("chunk", "items")).select(
        *keys,
        "chunk",
        F.size("items").alias("n"),
        F.element_at("items", 1).alias("first_id"),
        F.element_at("items", -1).alias("last_id"),
        "items",
    )


def blocks(arrays: DataFrame, block: int, arr_col: str = "ids", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Whole sequences cut into block-size training sequences; empty pieces dropped.
    (The reference keeps only the head block; we keep every block so whole texts are used.)"""
    return (
        arrays.select(*keys, F.posexplode(tx.blocks_array(arr_col, block)).alias("block", "seq"))
        .where(F.size("seq") > 0)
    )


def line_scan(df: DataFrame, text_col: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One example per line: split on line breaks, strip whitespace at both ends, drop blanks."""
    return (
        df.select(*keys, F.posexplode(tx.split_lines(text_col)).alias("line0", "raw"))
        .select(*keys, (F.col("line0") + 1).alias("line_no"), tx.strip_ws("raw").alias("line"))
        .where(F.length("line") > 0)
    )


def union_sources(a: DataFrame, b: DataFrame, name_a: str = "a", name_b: str = "b") -> DataFrame:
    """Two pools, tagged by source (columns aligned by name)."""
    return a.withColumn("source", F.lit(name_a)).unionByName(b.withColumn("source", F.lit(name_b)), allowMissingColumns=True)


def pad_batches(seqs: DataFrame, batch_col: str = "batch_id", arr_col: str = "ids") -> DataFrame:
    """Zero-pad every sequence to its batch's longest one. Lengths come from a grouped maximum, so that arrays are
    exchanged only where the batches are too many to broadcast."""
    longest = seqs.groupBy(F.col(batch_col).alias("_b")).agg(F.max(F.size(arr_col)).alias("max_len"))
    out = seqs.join(broadcast_if_small(longest), F.col(batch_col).eqNullSafe(F.col("_b"))).drop("_b")
    return out.withColumn("padded", F.concat(F.col(arr_col), F.array_repeat(F.lit(0), F.col("max_len") - F.size(arr_col))))


def pad_waste(padded: DataFrame, batch_col: str = "batch_id", arr_col: str = "ids") -> DataFrame:
    return padded.groupBy(batch_col).agg(
        F.count(F.lit(1)).alias("n_seqs"),
        F.sum(F.size("padded")).cast("bigint").alias("cells"),
        F.sum(F.col("max_len") - F.size(arr_col)).cast("bigint").alias("pad_cells"),
    ).withColumn("pad_fraction", F.col("pad_cells") / F.col("cells"))


def padded_pairs(seqs: DataFrame, batch_col: str = "batch_id", arr_col: str = "ids", pad: int = 0) -> DataFrame:
    """(ctx, nxt, n): next-token pairs of sequences padded to their batch's longest one, pads included. The pads
    are counted, not written: a sequence's last token meets a pad once, pads meet pads in the rest. Batch lengths
    come from a grouped maximum, so arrays are not exchanged; real pairs are counted as packed grams."""
    size = F.size(arr_col)
    longest = seqs.groupBy(batch_col).agg(F.max(size).alias("_max"))
    tail = seqs.where(size > 0).select(batch_col, F.element_at(arr_col, -1).alias("last"), size.alias("len"))
    tail = tail.unionByName(seqs.where(size == 0).select(batch_col, F.lit(None).cast("int").alias("last"), size.alias("len")))
    gaps = tail.join(longest, batch_col).select("last", (F.col("_max") - F.greatest("len", F.lit(1))).cast("bigint").alias("gap")).where("gap > 0")
    # of an empty sequence every pair is of pads
    per_last = gaps.groupBy("last").agg(F.count(F.lit(1)).alias("rows"), F.sum("gap").alias("gap"))
    ends = per_last.where("last is not null").select(F.col("last").alias("ctx"), F.lit(pad).alias("nxt"), F.col("rows").alias("n"))
    pads = per_last.select(F.lit(pad).alias("ctx"), F.lit(pad).alias("nxt"), (F.col("gap") - F.when(F.col("last").isNull(), F.lit(0)).otherwise(F.col("rows"))).alias("n"))
    ids = seqs.select(F.lit("train").alias("split"), F.col(arr_col).alias("ids"))
    # written once: real pairs come out of packed grams one row a pair, only those with the pad meet the pads
    real = written(grams.counts(grams.deal(ids, 1, grams.slices_for(ids)), 1).select(F.col("c1").alias("ctx"), "nxt", "n"))
    padded = real.where(F.col("nxt") == pad).unionByName(ends).unionByName(pads).groupBy("ctx", "nxt").agg(F.sum("n").alias("n")).where("n > 0")
    return real.where(F.col("nxt") != pad).unionByName(padded)


def corpus_stats(arrays: DataFrame, by: str = "source", arr_col: str = "toks") -> DataFrame:
    """Sequences, tokens, longest sequence and distinct tokens per source."""
    per_seq = arrays.groupBy(by).agg(
        F.count(F.lit(1)).alias("sequences"),
        F.sum(F.size(arr_col)).cast("bigint").alias("tokens"),
        F.max(F.size(arr_col)).cast("bigint").alias("max_len"),
    )
    distinct = (
        arrays.select(by, F.explode(arr_col).alias("t"))
        .groupBy(by, "t")
        .agg(F.lit(1).alias("one"))
        .groupBy(by)
        .agg(F.count(F.lit(1)).alias("distinct_tokens"))
    )
    return per_seq.join(distinct, by, "left")


def token_audit(tok_ids: DataFrame, vocab_size: int) -> DataFrame:
    """Ids must lie in [1, V]; report counts, min, max and the smallest offending id."""
    bad = (F.col("token_id") < 1) | (F.col("token_id") > vocab_size)
    return tok_ids.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(bad, 1).otherwise(0)).cast("bigint").alias("n_bad"),
        F.min("token_id").cast("bigint").alias("min_id"),
        F.max("token_id").cast("bigint").alias("max_id"),
        F.min(F.when(bad, F.col("token_id"))).cast("bigint").alias("first_bad"),
    )


def tokenize_with(df: DataFrame, fn, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Pluggable tokenizer: ``fn(pd.Series[str]) -> pd.Series[list[str]]`` run as an
    Arrow-batched pandas UDF (e.g. a byte-pair encoder when its files are available). The
    built-in regex tokenizer (``token_arrays``) stays the default because it runs in the JVM."""
    from pyspark.sql import types as T

    udf = F.pandas_udf(fn, T.ArrayType(T.StringType()))
    return df.select(*keep, udf(F.col(text_col)).alias("toks"))


def regex_tokenizer(series):
    """Python twin of the JVM pre-tokeniser (same pattern on lower-cased text)."""
    import regex

    pat = regex.compile(tx.TOKEN_PATTERN)
    return series.map(lambda s: pat.findall(s.lower()) if s is not None else None)
