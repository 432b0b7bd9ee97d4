"""Decoding over next-token distributions held as tables of candidates (ctx, nxt, logit).

Candidates of a context with the same logit form a *level*. A context of N counted pairs has at most about
sqrt(2 N) levels, whatever the number of its successors, so running masses are taken over levels (``level_table``)
and a candidate's place follows from its level and its rank inside it (``exact_rank``, which spreads a hot
context over many tasks). No window has a context as its partition.

Sampling steps run on packed prompts (``prompts``): a prompt meets the levels of its context and the successors that it
contains already, the documents' own tokens, never documents x successors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.functions.hashing import draw
from corpuslab.operators import prompts as packed_prompts
from corpuslab.operators.prompts import EDGE, TIE  # noqa: F401
from corpuslab.operators.ranking import broadcast_if_small, exact_rank, running_total, spread_join
from corpuslab.session import dropped, written

GREEDY_BYTES = 8 << 20  # measured bytes up to which the argmax tokens of a greedy step are broadcast


def candidates_from_counts(counts: DataFrame) -> DataFrame:
    """(ctx, nxt, n) -> (ctx, nxt, n, logit = ln n): the seen continuations of each context."""
    return counts.withColumn("logit", F.log(F.col("n").cast("double")))


def level_table(cands: DataFrame, by: str = "ctx", logit: str = "logit", temperature: float = 1.0, counts: str | None = None, running: bool = True) -> DataFrame:
    """(by, logit, k, e, z): candidates of a level, the mass of each and the context's whole mass; with
    ``running`` also ``before``, the mass of the higher levels. Mass is exp of the max-shifted logit / temperature,
    or the count itself where logits are ln(counts) and T == 1 (whole numbers, exact sums)."""
    if temperature <= 0:
        raise ValueError("temperature must be > 0 for sampling; use greedy() for T == 0")
    exact = counts is not None and temperature == 1.0
    lv = cands.groupBy(by, logit).agg(F.count(F.lit(1)).alias("k"), *([F.first(counts).alias("e")] if exact else []))
    if not exact:
        top = lv.groupBy(by).agg(F.max(logit).alias("_top"))
        lv = lv.join(top, by).withColumn("e", F.exp((F.col(logit) - F.col("_top")) / F.lit(float(temperature)))).drop("_top")
    lv = lv.withColumn("_m", F.col("k") * F.col("e"))
    if running:
        lv = running_total(lv, [F.col(logit).desc()], "_m", [by], name="_upto", before="before").drop("_upto")
    return lv.join(lv.groupBy(by).agg(F.sum("_m").alias("z")), by).drop("_m")


def softmax(
    cands: DataFrame, by: str = "ctx", logit: str = "logit", temperature: float = 1.0, out: str = "p", counts: str | None = None
) -> DataFrame:
    """Max-shifted softmax of logit / temperature inside each group. When the logits are
    ln(counts) and T == 1 the softmax is exactly counts / total, computed as such."""
    lv = level_table(cands, by, logit, temperature, counts, running=False)
    return cands.join(broadcast_if_small(lv.select(by, logit, (F.col("e") / F.col("z")).alias(out))), [by, logit])


def _placed(cands: DataFrame, levels: DataFrame, by: str, logit: str, tok: str) -> DataFrame:
    """Candidates with their level's columns and their rank r in the level (smaller token first)."""
    return exact_rank(cands, [tok], partition_by=(by, logit), name="r").join(broadcast_if_small(levels), [by, logit])


def cum_prob(cands: DataFrame, by: str = "ctx", logit: str = "logit", tok: str = "nxt", temperature: float = 1.0, counts: str | None = None) -> DataFrame:
    """Candidates with p and the running probability mass in descending order (ties: smaller token
    first), inclusive (``cum``) and exclusive (``cum_before``)."""
    placed = _placed(cands, level_table(cands, by, logit, temperature, counts), by, logit, tok)
    at = lambda k: (F.col("before") + k * F.col("e")) / F.col("z")
    return placed.withColumns({"p": F.col("e") / F.col("z"), "cum": at(F.col("r")), "cum_before": at(F.col("r") - 1)}).drop("k", "e", "z", "before", "r")


def _kept(top_p: float, size: str) -> Column:
    """Members of a level inside the nucleus: the exclusive mass of a kept one is at most top_p of the whole."""
    if top_p >= 1.0:
        return F.col(size)
    inside = F.floor(((F.lit(top_p + EDGE) * F.col("z")) - F.col("before")) / F.col("e")) + 1
    return F.least(F.col(size), F.greatest(F.lit(0), inside)).cast("long")


def nucleus(cands: DataFrame, top_p: float, temperature: float, by: str = "ctx", logit: str = "logit", tok: str = "nxt") -> DataFrame:
    """Top-p cut: keep the shortest prefix (descending probability) whose mass exceeds
    ``top_p`` - i.e. rows whose exclusive cumulative mass is <= top_p (to EDGE) - then renormalise by
    (kept mass + 1e-8). ``ck`` is the renormalised running mass that draws are looked up in."""
    lv = level_table(cands, by, logit, temperature).withColumn("kk", _kept(float(top_p), "k"))
    lv = lv.join(lv.groupBy(by).agg(F.sum(F.col("kk") * F.col("e")).alias("kept")), by).where("kk > 0")
    rows = _placed(cands, lv, by, logit, tok).where(F.col("r") <= F.col("kk"))
    whole = F.col("kept") + F.lit(1e-8) * F.col("z")
    done = rows.withColumns({"p": F.col("e") / F.col("z"), "p_keep": F.col("e") / whole, "ck": (F.col("before") + F.col("r") * F.col("e")) / whole})
    return done.drop("k", "e", "z", "before", "r", "kk", "kept")


def greedy(cands: DataFrame, by: str = "ctx", score: str = "logit", tok: str = "nxt") -> DataFrame:
    """Argmax per group; ties -> smallest token id."""
    return cands.groupBy(by).agg(F.min_by(tok, F.struct((-F.col(score)).alias("a"), F.col(tok).alias("b"))).alias(tok))


def repetition_penalty(logit: Column, seen: Column, r: float) -> Column:
    """Sign-aware penalty on already-seen tokens: positive logits / r, others * r."""
    return F.when(seen, F.when(logit > 0, logit / F.lit(r)).otherwise(logit * F.lit(r))).otherwise(logit)


def penalised_choice(prompts: DataFrame, cands: DataFrame | packed_prompts.Successors, penalty: float) -> DataFrame:
    """One greedy step under the repetition penalty: (pid, n_cand, n_penalized, choice, choice_logit) of every prompt (pid, ctx,
    ``own`` tokens) whose context has candidates (ties -> smallest token id)."""
    return packed_prompts.choices(prompts, cands, penalty)


def draw_from(kept: DataFrame, seed, by: str = "ctx", key: Column | None = None, tok: str = "nxt") -> DataFrame:
    """Multinomial draw by inverse CDF over the kept rows: the first row (descending
    probability) whose renormalised cumulative mass exceeds u(seed, key); the last kept row if
    rounding leaves u above the total. Two grouped extremes: a hot context is combined map-side."""
    key = key if key is not None else F.col(by)
    drawn = kept.withColumn("_hit", F.col("ck") > draw(seed, key))
    place = F.struct("ck", tok)
    first = F.min(F.when(F.col("_hit"), place))
    return drawn.groupBy(by).agg(F.coalesce(first[tok], F.max(place)[tok]).alias(tok))


def _greedy_chain(prompts: DataFrame, cands: DataFrame, steps: int, fallback: int) -> DataFrame:
    """(pid, step, token) of ``steps`` argmax tokens. They follow from a prompt's last token alone, so a chain is followed
    once for each last token, whatever the number of prompts. Argmax tokens are broadcast only while they are few: a step
    would leave another broadcast of the vocabulary on the driver."""
    nexts = written(greedy(cands).withColumnRenamed("nxt", "tok"))
    table = broadcast_if_small(nexts, GREEDY_BYTES)
    state = written(prompts.select(F.col("ctx").alias("root"), "ctx").distinct().withColumn("made", F.array().cast("array<int>")))
    for _ in range(steps):
        moved = state.join(table, "ctx", "left").withColumn("token", F.coalesce("tok", F.lit(fallback)).cast("int"))
        state, old = written(moved.select("root", F.col("token").alias("ctx"), F.concat("made", F.array("token")).alias("made"))), state
        dropped(old)
    dropped(nexts)
    chains = state.select(F.col("root").alias("ctx"), "made")
    made = spread_join(prompts.select("pid", "ctx"), chains, "ctx", "pid")
    return made.select("pid", F.posexplode("made").alias("at", "token")).select("pid", F.col("token"), (F.col("at") + 1).alias("step"))


def generate(
    prompts: DataFrame,
    cands: DataFrame | packed_prompts.Successors,
    steps: int,
    mode: str = "greedy",
    top_p: float = 0.95,
    temperature: float = 0.8,
    penalty: float = 1.5,
    seed=42,
    past: DataFrame | None = None,
    fallback: int = 1,
    context: int | None = None,
) -> DataFrame:
    """Generate ``steps`` tokens for every prompt (prompts: (pid, ctx) where ctx is the last
    token). Greedy takes the argmax of the plain logits. Sampling applies the repetition penalty against
    ``past`` ((pid, token) of the prompt; in place of it prompts may have their tokens as an array ``own``) and the tokens generated so far, then temperature, nucleus cut and a
    keyed draw; top_p >= 1 keeps the whole distribution, and with temperature 0 takes the argmax of the
    penalised logits. With ``context`` only the last so many tokens count as past: ``past`` then needs the token's
    last position ``pos`` (from 1) and prompts their ``length``. A context without continuations falls
    back to ``fallback``. Every step's state (packed prompts, or chains, with the tokens ``made`` so far) is written to the shared
    folder, so neither lineage nor the plan of a step grows. Returns (pid, step, token)."""
    if mode == "greedy":
        return _greedy_chain(prompts, cands, steps, fallback)
    if temperature == 0 and top_p < 1.0:
        raise ValueError("temperature 0 with top_p < 1 is undefined (division by zero)")
    track = past is not None or "own" in prompts.columns
    if past is not None:
        one = F.struct("token", *(["pos"] if context is not None else []))
        held = past.groupBy("pid").agg(F.collect_list(one).alias("h"))  # bounded by the prompt's own tokens
        prompts = prompts.join(held, "pid", "left").withColumn("own", F.coalesce("h.token", F.array().cast("array<int>")))
        prompts = prompts.withColumn("at", F.coalesce("h.pos", F.array().cast("array<int>"))) if context is not None else prompts
    elif "own" not in prompts.columns:
        prompts = prompts.withColumn("own", F.array().cast("array<int>"))
    if context is not None and "at" not in prompts.columns:
        last = F.size("own")
        prompts = prompts.withColumn("at", F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))).withColumn("length", last)
    return packed_prompts.generate(prompts, cands, steps, top_p, temperature, penalty, seed, fallback, context, track)
