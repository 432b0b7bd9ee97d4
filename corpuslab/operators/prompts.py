"""Prompts that meet the successors of their last token, both packed and dealt by it.

A prompt is a row of arrays: its id, its last token (the context), the distinct tokens that it holds and the tokens made so
far. About ``CHUNK`` tokens of prompts are one packed row, its columns planes of bytes as in ``grams``. Successors are packed in
slices of their context, those of one context by falling logit (a run of the same logit is a *level*), smaller token first.
A step deals prompts into the slice of their context and exchanges them once; no row is a pair of a prompt and a token. A
context whose prompts hold more than ``HEAVY`` tokens is spread over several slices, each with a copy of its successors.

In a slice the tokens that a prompt holds are looked up among the successors through one array over token ids, and a draw
is made in a matrix of prompts x levels, never prompts x successors.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.operators import grams
from corpuslab.operators.grams import _NO_DOC, CHUNK, SLICE, _distinct, _heads, _planes, _slice_of, _values
from corpuslab.session import dropped, small_batches, written

HEAVY = 1_000_000  # tokens of one context's prompts that a slice takes
PROMPT = 256  # tokens that a prompt counts for besides its own
CELLS = 1_000_000  # prompts x levels that are drawn from at once
EDGE = 1e-9  # share of the whole mass by which a sum may miss the nucleus cut through rounding
TIE = 9  # decimals to which a prompt's logits are compared
_STATE = "slice int, n int, m int, s int, ctx binary, size binary, cols array<binary>"
_SUCC = "slice int, n array<int>, cols array<binary>"


def _slices(df: DataFrame, n: int) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // SLICE))


def _starts(size: np.ndarray) -> np.ndarray:
    return np.cumsum(size) - size


def _ragged(size: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Places of the items of ``rows``, in that order, where row i has ``size[i]`` items."""
    n = size[rows]
    return np.repeat(_starts(size)[rows] - _starts(n), n) + np.arange(int(n.sum()))


def _none(schema: str) -> pd.DataFrame:
    return pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")], dtype=object)


@dataclass(frozen=True)
class Successors:
    """(slice, n, cols): per slice contexts, their numbers of levels, levels' logits and sizes, and successors by (context,
    logit descending, token)."""

    table: DataFrame
    slices: int


def _sealed(key, ctx: np.ndarray, nxt: np.ndarray, logit: np.ndarray) -> pd.DataFrame:
    order = np.lexsort((nxt, -logit, ctx))
    ctx, nxt, logit = ctx[order], nxt[order], logit[order]
    level, first = _heads([ctx, logit]), _heads([ctx])
    per_ctx = np.diff(np.r_[np.searchsorted(level, first), len(level)])
    k = np.diff(np.r_[level, len(nxt)])
    step = nxt.copy()  # members of a level ascend: their steps
    step[1:] -= nxt[:-1]
    step[level] = nxt[level]
    cols = [ctx[first], per_ctx.astype(np.int32), logit[level], k.astype(np.int32), step]
    return pd.DataFrame({"slice": [key[0]], "n": [[len(first), len(level), len(nxt)]], "cols": [[_planes(x) for x in cols]]})


def successors(cands: DataFrame, slices: int) -> Successors:
    """Successors of the rows (ctx, nxt, logit), written once."""

    def deal(batches):
        held, total = [], 0

        def flush():
            ctx, nxt, logit = (np.concatenate([g[i] for g in held]) for i in range(3))
            part = _slice_of([ctx], slices)
            order = np.argsort(part, kind="stable")
            part = part[order]
            at = _heads([part])
            cols = [x[order] for x in (ctx, nxt, logit)]
            ends = np.r_[at[1:], len(part)]
            return pd.DataFrame({"slice": part[at], "n": [[int(n)] for n in ends - at], "cols": [[_planes(x[i:j]) for x in cols] for i, j in zip(at, ends)]})

        for pdf in batches:
            held.append((pdf["ctx"].to_numpy(np.int32), pdf["nxt"].to_numpy(np.int32), pdf["logit"].to_numpy(np.float64)))
            total += len(pdf)
            if total >= CHUNK:
                yield flush()
                held, total = [], 0
        if total:
            yield flush()

    def seal(key, pdf: pd.DataFrame) -> pd.DataFrame:
        size = [n[0] for n in pdf["n"]]
        return _sealed(key, *(_values([c[i] for c in pdf["cols"]], size, t) for i, t in enumerate((np.int32, np.int32, np.float64))))

    dealt = cands.select("ctx", "nxt", "logit").mapInPandas(deal, _SUCC)
    return Successors(written(dealt.groupBy("slice").applyInPandas(seal, _SUCC)), slices)


def counted(ids: DataFrame) -> Successors:
    """Successors of all next-token pairs of (ids), with logit = ln(count) as ``decode.candidates_from_counts`` has it. Written
    once; pairs stay packed from the documents on."""
    slices = grams.slices_for(ids)

    def seal(key, pdf: pd.DataFrame) -> pd.DataFrame:
        (ctx,), nxt, (n,), _, _ = grams._unpacked(pdf, 1, 1)
        return _sealed(key, ctx, nxt, np.log(n.astype(np.float64)))  # merged grams are distinct

    dealt = grams.pairs(ids.select(F.lit(0).alias("doc_id"), F.lit("train").alias("split"), "ids"), slices)
    with small_batches(ids.sparkSession):
        return Successors(written(dealt.groupBy("slice").applyInPandas(seal, _SUCC)), slices)


def _met(cands, prompts: DataFrame, state: DataFrame) -> Successors:
    if isinstance(cands, Successors):
        return cands
    weight = state.agg(F.sum(F.col("m") + F.col("n") * PROMPT)).first()[0] or 0
    return successors(cands, _slices(prompts, max(cands.count(), weight)))


class _Successors:
    """Successors of the contexts of a slice, from its packed rows."""

    def __init__(self, rows: pd.DataFrame):
        n = np.array([list(x) for x in rows["n"]], np.int64).reshape(-1, 3)
        get = lambda i, size, t: _values([c[i] for c in rows["cols"]], size, t)
        self.ctx, self.levels = get(0, n[:, 0], np.int32), get(1, n[:, 0], np.int32).astype(np.int64)
        self.logit, self.k, step = get(2, n[:, 1], np.float64), get(3, n[:, 1], np.int32).astype(np.int64), get(4, n[:, 2], np.int32)
        self.first = _starts(self.levels)  # level of each context
        self.start = _starts(self.k)  # member of each level
        total = np.cumsum(step.astype(np.int64))
        self.nxt = total - np.repeat((total - step)[self.start], self.k) if len(step) else total
        self.member = self.start[self.first] if len(self.ctx) else self.first
        self.members = np.add.reduceat(self.k, self.first) if len(self.ctx) else self.first
        self.order = np.argsort(self.ctx, kind="stable")

    def find(self, ctx: np.ndarray) -> np.ndarray:
        """Number of each context, -1 where it has no successors."""
        names = self.ctx[self.order]
        at = np.minimum(np.searchsorted(names, ctx), max(len(names) - 1, 0))
        return np.where(names[at] == ctx, self.order[at], -1) if len(names) else np.full(len(ctx), -1)

    def hits(self, number: np.ndarray, own: np.ndarray, size: np.ndarray):
        """(prompt, member) of the tokens in ``own`` that follow their prompt's context; ``number`` ascends."""
        ends = np.cumsum(size)
        dense = np.zeros(int(max(own.max(initial=0), self.nxt.max(initial=0))) + 1, np.int64)
        at, found = _heads([number]), []
        for a, b in zip(at, np.r_[at[1:], len(number)]):
            c = number[a]
            if c < 0:
                continue
            low, high = (ends[a - 1] if a else 0), ends[b - 1]
            members = self.nxt[self.member[c] : self.member[c] + self.members[c]]
            dense[members] = np.arange(self.member[c] + 1, self.member[c] + 1 + len(members))
            got = dense[own[low:high]]
            dense[members] = 0
            there = np.flatnonzero(got)
            found.append((there + low, got[there] - 1))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        where = np.concatenate([x for x, _ in found])
        return np.searchsorted(ends, where, "right"), np.concatenate([x for _, x in found])

    def level_of(self, member: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.start, member, "right") - 1


def _penalised(logit: np.ndarray, penalty: float) -> np.ndarray:
    """``decode.repetition_penalty`` of seen tokens."""
    return np.where(logit > 0, logit / penalty, logit * penalty)


def _nth_left(nth: np.ndarray, row: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """Rank of the nth (from 0) member that is not among ``gone``, ranks that ascend within each ``row``."""
    head = _heads([row])
    place = np.arange(len(row)) - np.repeat(head, np.diff(np.r_[head, len(row)]))
    return nth + np.bincount(row[gone - place <= nth[row]], minlength=len(nth))


def sampled(succ: _Successors, number: np.ndarray, row: np.ndarray, member: np.ndarray, u: np.ndarray, top_p: float, temperature: float, penalty: float) -> np.ndarray:
    """Token drawn for each prompt (0 where its context has no successors): ``number`` is its context, (row, member) the
    successors that it holds. Order: logit to TIE decimals descending, unseen before seen, smaller token first."""
    level = succ.level_of(member)
    known = succ.logit[level] != 0 if penalty != 1.0 else np.zeros(len(row), bool)  # a logit of 0 stays 0 under the penalty
    row, member, level = row[known], member[known], level[known]
    pen, place = _penalised(succ.logit, penalty), np.zeros(len(succ.logit), np.int64)
    rounded, seen = np.round(succ.logit, TIE), np.round(pen, TIE)
    for c in np.unique(number[number >= 0]):  # levels before a seen token, by the level it comes from
        at = slice(succ.first[c], succ.first[c] + succ.levels[c])
        place[at] = np.searchsorted(-rounded[at], -seen[at], side="right")
    if temperature:
        top = np.repeat(succ.logit[succ.first], succ.levels) if len(succ.ctx) else succ.logit
        mass, mass_seen = np.exp((succ.logit - top) / temperature), np.exp((pen - top) / temperature)
    else:
        mass = mass_seen = np.ones(len(succ.logit))
    out = np.zeros(len(number), np.int64)
    wide = np.where(number >= 0, succ.levels[np.maximum(number, 0)] if len(succ.ctx) else 0, 0)
    order = np.argsort(wide, kind="stable")
    order = order[wide[order] > 0]
    ascending = wide[order]
    hit_order, hits = np.argsort(row, kind="stable"), np.bincount(row, minlength=len(number))
    at = 0
    while at < len(order):  # prompts whose contexts have about as many levels
        most = max(1, CELLS // (4 * int(ascending[at]) + 1))
        stop = min(len(order), at + most, int(np.searchsorted(ascending, 2 * ascending[at] + 8, "right")))
        mine = order[at:stop]
        pick = hit_order[_ragged(hits, mine)]
        local = np.repeat(np.arange(len(mine)), hits[mine])
        out[mine] = _drawn(succ, number[mine], local, member[pick], level[pick], pen, place, mass, mass_seen, u[mine], top_p, temperature)
        at = stop
    return out


def _drawn(succ, number, row, member, level, pen, place, mass, mass_seen, u, top_p, temperature) -> np.ndarray:
    rows, first, wide = len(number), succ.first[number], succ.levels[number]
    most = int(wide.max())
    cell = first[:, None] + np.arange(most)
    real = np.arange(most) < wide[:, None]
    cell = np.where(real, cell, 0)
    left = np.where(real, succ.k[cell], 0) - np.bincount(row * most + level - first[row], minlength=rows * most).reshape(rows, most)
    block = np.zeros((rows, 2 * most + 1))  # seen tokens before the first level, that level, seen tokens after it, ...
    block[:, 1::2] = left * mass[cell]
    block[:, 0::2] = np.bincount(row * (most + 1) + place[level], weights=mass_seen[level], minlength=rows * (most + 1)).reshape(rows, -1)
    upto, each = np.cumsum(block, axis=1), np.arange(rows)
    z = upto[:, -1]
    last = (upto < z[:, None]).sum(axis=1)
    token = succ.nxt[member]

    class At:
        """Block of each prompt that holds a running mass, and what is inside."""

        def __init__(self, value, most_block):
            self.b = np.minimum((upto <= value[:, None]).sum(axis=1), most_block)
            self.before = np.where(self.b > 0, upto[each, np.maximum(self.b - 1, 0)], 0.0)
            self.base = self.b % 2 == 1
            self.level = np.where(self.base, (self.b - 1) // 2, 0)
            self.e, self.n = mass[cell[each, self.level]], left[each, self.level]
            inside = np.flatnonzero(self.b[row] == 2 * place[level])
            inside = inside[np.lexsort((token[inside], -pen[level[inside]], row[inside]))]
            self.inside, self.of = inside, row[inside]
            self.head = np.searchsorted(self.of, each)
            e = mass_seen[level[inside]]
            run = np.cumsum(e)
            self.upto = run - (run - e)[self.head[self.of]] + self.before[self.of] if len(e) else run
            self.held = self.upto - e
            with np.errstate(all="ignore"):
                o = np.clip(np.floor((value - self.before) / self.e), 0, np.maximum(self.n - 1, 0))
            seen = np.maximum(np.bincount(self.of[self.held <= value[self.of]], minlength=rows) - 1, 0)
            self.o = np.where(self.base, o, seen).astype(np.int64)

        def mass(self):
            """Mass up to and with the entry."""
            seen = self.upto[np.minimum(self.head + self.o, len(self.upto) - 1)] if len(self.upto) else self.before
            return np.where(self.base, self.before + (self.o + 1) * self.e, seen)

        def tokens(self):
            lv = first + self.level
            gone = np.flatnonzero(self.base[row] & (level == lv[row]))
            gone = gone[np.lexsort((member[gone], row[gone]))]
            r = _nth_left(self.o, row[gone], member[gone] - succ.start[lv[row[gone]]])
            unseen = succ.nxt[np.minimum(succ.start[lv] + r, len(succ.nxt) - 1)]
            seen = token[self.inside[np.minimum(self.head + self.o, len(self.inside) - 1)]] if len(self.inside) else unseen
            return np.where(self.base, unseen, seen)

    if temperature == 0:
        return At(np.zeros(rows), last).tokens()
    if top_p < 1.0:
        cut = At((top_p + EDGE) * z, last)
    else:
        cut = At(np.full(rows, np.inf), last)
    kept = cut.mass()
    x = u * (kept + 1e-8 * z)
    hit = At(x, cut.b)
    over = (x >= kept) | (hit.b > cut.b)
    hit.o = np.where(hit.b == cut.b, np.where(over, cut.o, np.minimum(hit.o, cut.o)), hit.o)
    return hit.tokens()


def penalised_choice(succ: _Successors, number: np.ndarray, row: np.ndarray, member: np.ndarray, penalty: float) -> pd.DataFrame:
    """(n_cand, n_penalized, choice, choice_logit) of each prompt whose context has successors: the argmax of its penalised
    logits (ties: smaller token), null logits nowhere."""
    n, base = len(number), succ.member[number]
    counts = np.bincount(row, minlength=n)
    # the first member by (logit descending, token) that the prompt doesn't hold
    early = np.flatnonzero(member - base[row] < counts[row])
    early = early[np.lexsort((member[early], row[early]))]
    free = _nth_left(np.zeros(n, np.int64), row[early], member[early] - base[row[early]])
    there = free < succ.members[number]
    at = base + np.where(there, free, 0)
    choice, best = np.where(there, succ.nxt[at], np.iinfo(np.int64).max), np.where(there, succ.logit[succ.level_of(at)], -np.inf)
    pen, token = _penalised(succ.logit[succ.level_of(member)], penalty), succ.nxt[member]
    order = np.lexsort((token, -pen, row))
    head = order[_heads([row[order]])] if len(row) else order
    r = row[head]
    wins = (pen[head] > best[r]) | ((pen[head] == best[r]) & (token[head] < choice[r]))
    choice[r[wins]], best[r[wins]] = token[head][wins], pen[head][wins]
    return pd.DataFrame({"n_cand": succ.members[number], "n_penalized": counts, "choice": choice.astype(np.int32), "choice_logit": best})


class _Prompts:
    """Prompts as arrays: pid, ctx, size and length of each, ``own`` tokens in ascending order (``at``: their last positions, or
    empty), ``made`` tokens by step."""

    def __init__(self, pid, ctx, size, length, own, at, made):
        self.pid, self.ctx, self.size, self.length, self.own, self.at, self.made = pid, ctx, size, length, own, at, made

    @classmethod
    def read(cls, rows: pd.DataFrame) -> _Prompts:
        n, m, s = [*rows["n"]], [*rows["m"]], int(rows["s"].iloc[0])
        get = lambda i, size, t: _values([c[i] for c in rows["cols"]], size, t)
        ctx, size = _values(rows["ctx"], n, np.int32), _values(rows["size"], n, np.int32).astype(np.int64)
        step, has_at = get(2, m, np.int32), bool(len(rows["cols"].iloc[0]) > 4)
        total, filled = np.cumsum(step.astype(np.int64)), size > 0
        own = total - np.repeat((total - step)[_starts(size)[filled]], size[filled]) if len(step) else total
        made = get(3, [x * s for x in n], np.int32).reshape(len(ctx), s)
        return cls(get(0, n, np.int64), ctx, size, get(1, n, np.int32), own.astype(np.int32), get(4, m, np.int32) if has_at else None, made)

    def take(self, order: np.ndarray) -> _Prompts:
        items = _ragged(self.size, order)
        at = self.at[items] if self.at is not None else None
        return _Prompts(self.pid[order], self.ctx[order], self.size[order], self.length[order], self.own[items], at, self.made[order])

    def packed(self, part: np.ndarray) -> pd.DataFrame:
        """One packed row for each run of ``part`` of at most about CHUNK tokens."""
        if not len(part):
            return _none(_STATE)
        ends = np.cumsum(self.size)
        heads = _heads([part, ends // CHUNK])
        step = self.own.astype(np.int32)
        step[1:] -= self.own[:-1]
        begin = _starts(self.size)[self.size > 0]
        step[begin] = self.own[begin]
        out = []
        for i, j in zip(heads, np.r_[heads[1:], len(part)]):
            low, high = (ends[i - 1] if i else 0), ends[j - 1]
            cols = [self.pid[i:j], self.length[i:j].astype(np.int32), step[low:high], self.made[i:j].astype(np.int32).reshape(-1)]
            cols += [self.at[low:high].astype(np.int32)] if self.at is not None else []
            out.append((part[i], j - i, high - low, self.made.shape[1], _planes(self.ctx[i:j].astype(np.int32)), _planes(self.size[i:j].astype(np.int32)), [_planes(x) for x in cols]))
        return pd.DataFrame(out, columns=[c.split()[0] for c in _STATE.split(", ")])

    def seen(self, context: int | None):
        """(own tokens, size) that count as past, of the last ``context`` tokens if it is given."""
        if context is None:
            return self.own.astype(np.int64), self.size
        s, row = self.made.shape[1], np.repeat(np.arange(len(self.size)), self.size)
        there = self.at > self.length[row] + s - context
        late = self.made[:, max(0, s - context) :]
        key = _distinct(np.r_[(row[there] << 32) | self.own[there], ((np.arange(len(late))[:, None] << 32) | late).reshape(-1)].astype(np.int64))
        return key & 0xFFFFFFFF, np.bincount(key >> 32, minlength=len(self.size))

    def moved(self, token: np.ndarray, track: bool) -> _Prompts:
        """With ``token`` made; ``track``: it is one of their own tokens from now on."""
        made, own, size = np.hstack([self.made, token[:, None].astype(np.int32)]), self.own, self.size
        if track:
            key = (np.repeat(np.arange(len(size)), size) << 32) | own
            new = (np.arange(len(size)) << 32) | token
            at = np.searchsorted(key, new)
            fresh = np.append(key, -1)[at] != new
            own, size = np.insert(own, at[fresh], token[fresh]).astype(np.int32), size + fresh
        return _Prompts(self.pid, token.astype(np.int32), size, self.length, own, self.at, made)


def packed(prompts: DataFrame, positions: bool = False) -> DataFrame:
    """Packed rows of (pid, ctx, own) and, with ``positions``, (at, length): the tokens that a prompt holds, in any order
    and repeated, their positions and the prompt's length. Written once."""
    names = ["pid", "ctx", "own", *(["at", "length"] if positions else [])]

    def pack(batches):
        held, total = [], 0

        def flush():
            get = lambda c: np.concatenate([x.column(c).to_numpy(zero_copy_only=False) for x in held])
            flat = lambda c: np.concatenate([x.column(c).flatten().to_numpy(zero_copy_only=False) for x in held]).astype(np.int64)
            size = np.concatenate([x.column("own").value_lengths().fill_null(0).to_numpy(zero_copy_only=False) for x in held]).astype(np.int64)
            key = (np.repeat(np.arange(len(size)), size) << 32) | flat("own")
            if positions:
                order = np.lexsort((flat("at"), key))
                last = np.append(key[order][1:] != key[order][:-1], True) if len(key) else np.zeros(0, bool)
                at, key = flat("at")[order][last], key[order][last]
            else:
                at, key = None, _distinct(key)
            n, pid = len(size), np.concatenate([x.column("pid").fill_null(_NO_DOC).to_numpy(zero_copy_only=False) for x in held])
            length = get("length").astype(np.int32) if positions else np.zeros(n, np.int32)
            made = _Prompts(pid.astype(np.int64), get("ctx").astype(np.int32), np.bincount(key >> 32, minlength=n), length, (key & 0xFFFFFFFF).astype(np.int32), at, np.zeros((n, 0), np.int32))
            return made.packed(np.zeros(n, np.int32))

        for batch in batches:
            ends, start = np.cumsum(batch.column("own").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)), 0
            while start < batch.num_rows:
                before = int(ends[start - 1]) if start else 0
                stop = min(int(np.searchsorted(ends, before + CHUNK - total)) + 1, batch.num_rows)
                held.append(batch.slice(start, stop - start))
                total, start = total + int(ends[stop - 1]) - before, stop
                if total >= CHUNK:
                    yield pa.RecordBatch.from_pandas(flush(), schema=kind, preserve_index=False)
                    held, total = [], 0
        if held:
            yield pa.RecordBatch.from_pandas(flush(), schema=kind, preserve_index=False)

    i, b = pa.int32(), pa.binary()
    kind = pa.schema([("slice", i), ("n", i), ("m", i), ("s", i), ("ctx", b), ("size", b), ("cols", pa.list_(b))])
    with small_batches(prompts.sparkSession):
        return written(prompts.select(F.col("pid").cast("long").alias("pid"), *names[1:]).mapInArrow(pack, _STATE))


def _heavy(state: DataFrame):
    """Contexts whose prompts hold over HEAVY tokens and the pieces of each: fewer than the tokens fill."""

    def run(batches):
        for pdf in batches:
            for n, c, s in zip(pdf["n"], pdf["ctx"], pdf["size"]):
                ctx, at = np.unique(_values([c], [n], np.int32), return_inverse=True)
                yield pd.DataFrame({"ctx": ctx, "w": np.bincount(at, _values([s], [n], np.int32) + float(PROMPT), len(ctx))})

    found = state.select("n", "ctx", "size").mapInPandas(run, "ctx int, w double").groupBy("ctx").agg(F.sum("w").alias("w"))
    rows = sorted((r["ctx"], int(-(-r["w"] // HEAVY))) for r in found.where(F.col("w") > HEAVY).collect())
    return np.array([c for c, _ in rows], np.int64), np.array([p for _, p in rows], np.int64)


def meet(state: DataFrame, succ: Successors, work, schema: str, context: int | None = None) -> DataFrame:
    """Rows of ``work(prompts, successors, number, row, member)`` of every slice: prompts by context, the number of each one's
    context and the (prompt, member) pairs of the tokens it holds among that context's successors."""
    slices, (hot, pieces) = succ.slices, _heavy(state)

    def parts(ctx):
        at = np.minimum(np.searchsorted(hot, ctx), max(len(hot) - 1, 0))
        return np.where(hot[at] == ctx, pieces[at], 1) if len(hot) else np.ones(len(ctx), np.int64)

    def deal(batches):
        for pdf in batches:
            for i in range(len(pdf)):
                p = _Prompts.read(pdf.iloc[i : i + 1])
                piece = _slice_of([p.pid], 1 << 30) % parts(p.ctx)
                part = (_slice_of([p.ctx], slices) + piece) % slices
                order = np.lexsort((p.ctx, part))
                yield p.take(order).packed(part[order].astype(np.int32))

    def send(batches):
        for pdf in batches:
            yield pdf
            for i, key in enumerate(pdf["slice"]):
                mine = hot[_slice_of([hot], slices) == key] if len(hot) else hot
                if not len(mine):
                    continue
                one = _Successors(pdf.iloc[i : i + 1])
                for c, at in zip(mine, one.find(mine)):
                    if at < 0:
                        continue
                    level = slice(one.first[at], one.first[at] + one.levels[at])
                    nxt, start = one.nxt[one.member[at] : one.member[at] + one.members[at]], one.start[level] - one.member[at]
                    step = np.diff(nxt, prepend=0)
                    step[start] = nxt[start]
                    cols = [np.array([c], np.int32), one.levels[at : at + 1].astype(np.int32), one.logit[level], one.k[level].astype(np.int32), step.astype(np.int32)]
                    cols = [_planes(x) for x in cols]
                    others = {(key + j) % slices for j in range(int(pieces[np.searchsorted(hot, c)]))} - {key}
                    yield pd.DataFrame([(o, [1, int(one.levels[at]), len(nxt)], cols) for o in sorted(others)], columns=["slice", "n", "cols"])

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return _none(schema)
        p, known = _Prompts.read(left), _Successors(right)
        number = known.find(p.ctx)
        order = np.argsort(number, kind="stable")
        p, number = p.take(order), number[order]
        own, size = p.seen(context)
        return work(p, known, number, *known.hits(number, own, size))

    dealt = state.mapInPandas(deal, _STATE).groupBy("slice")
    return dealt.cogroup(succ.table.mapInPandas(send, _SUCC).groupBy("slice")).applyInPandas(run, schema)


def generate(prompts: DataFrame, cands: DataFrame | Successors, steps: int, top_p: float, temperature: float, penalty: float, seed, fallback: int, context: int | None, track: bool) -> DataFrame:
    """(pid, step, token) of ``decode.generate`` by sampling, of prompts as ``packed`` takes them."""
    state = packed(prompts, positions=context is not None)
    succ = _met(cands, prompts, state)

    def step_of(step):
        def work(p, known, number, row, member):
            keys = [f"{seed}|{i}|{step}" if i != _NO_DOC else f"{seed}|{step}" for i in p.pid.tolist()]
            u = np.array([int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in keys], np.float64) / 4294967296.0
            token = sampled(known, number, row, member, u, top_p, temperature, penalty if track else 1.0)
            token = np.where(number >= 0, token, fallback)
            return p.moved(token, track and context is None).packed(np.zeros(len(token), np.int32))

        return work

    def out(batches):
        for pdf in batches:
            for i in range(len(pdf)):
                p = _Prompts.read(pdf.iloc[i : i + 1])
                n = p.made.shape[1]
                yield pd.DataFrame({"pid": np.repeat(p.pid, n), "token": p.made.reshape(-1), "step": np.tile(np.arange(1, n + 1, dtype=np.int32), len(p.pid))})

    for step in range(1, steps + 1):
        with small_batches(state.sparkSession):
            state, old = written(meet(state, succ, step_of(step), _STATE, context)), state
        dropped(old)
        state.sparkSession._jvm.System.gc()  # else a step's shuffle files stay until the driver's heap is full
    dropped(succ.table)
    return state.mapInPandas(out, "pid long, token int, step int").select(_pid(), "token", "step")


def _pid():
    return F.when(F.col("pid") != _NO_DOC, F.col("pid")).alias("pid")


def choices(prompts: DataFrame, cands: DataFrame | Successors, penalty: float) -> DataFrame:
    """(pid, n_cand, n_penalized, choice, choice_logit) of ``penalised_choice`` for every prompt (pid, ctx, own)."""
    state = packed(prompts)
    succ = _met(cands, prompts, state)

    def work(p, known, number, row, member):
        there = number >= 0
        low = int((~there).sum())  # prompts come by number
        done = penalised_choice(known, number[low:], row - low, member, penalty) if there.any() else pd.DataFrame({"n_cand": [], "n_penalized": [], "choice": [], "choice_logit": []})
        return done.assign(pid=p.pid[low:])[["pid", "n_cand", "n_penalized", "choice", "choice_logit"]]

    names = "n_cand", "n_penalized", "choice", "choice_logit"
    return meet(state, succ, work, "pid long, n_cand long, n_penalized long, choice int, choice_logit double").select(_pid(), *names)
