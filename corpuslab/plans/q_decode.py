"""Queries: decoding over the corpus bigram distribution (candidates = seen continuations)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from corpuslab.functions import text as tx
from corpuslab.operators import decode as dc
from corpuslab.operators import grams
from corpuslab.operators import prompts as prompts_op
from corpuslab.operators import text as tt
from corpuslab.operators.ranking import broadcast_if_small
from corpuslab.plans import sql as q
from corpuslab.plans import views
from corpuslab.plans.catalog import finish, register
from corpuslab.session import dropped, written
from corpuslab.sources.tables import table

TEMP = 0.8
TOP_P = 0.9
PENALTY = 1.5
SEED = 42
GEN_TOP_P = 0.95
GEN_STEPS = 20  # new tokens of a text


def encoded(spark: SparkSession, sf_dir: str):
    """(vocabulary, documents): (t, token_id) and (doc_id, ids), the ids written once; tokens and numbered documents,
    which nothing here reads after that, are freed."""
    voc, made = views.vocab(spark, sf_dir).select("t", "token_id"), []
    docs = written(tt.encode_arrays(views.doc_tokens(spark, sf_dir), voc, made=made))
    dropped(*made)
    views.release_tokens(spark, sf_dir)
    return voc, docs


def pair_candidates(docs):
    """(ctx, nxt, n, logit) of all next-token pairs of (doc_id, ids), counted as packed grams in slices of their context."""
    dealt = grams.deal(docs.withColumn("split", F.lit("train")), 1, grams.slices_for(docs))
    return dc.candidates_from_counts(grams.counts(dealt, 1).select(F.col("c1").alias("ctx"), "nxt", "n"))


def corpus(spark: SparkSession, sf_dir: str):
    """(candidates, documents): ``pair_candidates`` and (doc_id, ids). Both are written once: several levels, ranks and
    steps read them."""
    docs = encoded(spark, sf_dir)[1]
    return written(pair_candidates(docs)), docs


def candidates(spark: SparkSession, sf_dir: str):
    return corpus(spark, sf_dir)[0]


def doc_context(docs):
    """(doc_id, ctx = id of the document's last token) and (doc_id, ctx, token id) for every distinct token of
    the document, both from its ids."""
    last = docs.select("doc_id", F.element_at("ids", -1).alias("ctx"))
    past = docs.select("doc_id", F.element_at("ids", -1).alias("ctx"), F.explode(F.array_distinct("ids")).alias("nxt"))
    return last, past


_CAND = q.with_(q.DOC_TOKS, q.TOK, q.VOCAB) + """, tok_ids AS (SELECT tok.doc_id, tok.pos, vocab.token_id FROM tok JOIN vocab USING (t)),
cand AS (SELECT ctx, nxt, count(*) AS n, ln(count(*)) AS logit FROM (
   SELECT token_id AS ctx, lead(token_id) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM tok_ids) WHERE nxt IS NOT NULL GROUP BY ALL)
"""


def _soft_sql(t: float) -> str:
    if t == 1.0:
        return """, s3 AS (SELECT ctx, nxt, n, n / sum(n) OVER (PARTITION BY ctx) AS p, sum(n) OVER (PARTITION BY ctx) AS tot FROM cand),
s4 AS (SELECT *, sum(n) OVER (PARTITION BY ctx ORDER BY p DESC, nxt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / tot AS cum,
       coalesce(sum(n) OVER (PARTITION BY ctx ORDER BY p DESC, nxt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / tot AS cum_before FROM s3)
"""
    return f""", s1 AS (SELECT ctx, nxt, n, logit / {t} AS z, max(logit / {t}) OVER (PARTITION BY ctx) AS zm FROM cand),
s2 AS (SELECT ctx, nxt, n, exp(z - zm) AS e FROM s1),
s3 AS (SELECT ctx, nxt, n, e / sum(e) OVER (PARTITION BY ctx) AS p FROM s2),
s4 AS (SELECT *, sum(p) OVER (PARTITION BY ctx ORDER BY p DESC, nxt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
       coalesce(sum(p) OVER (PARTITION BY ctx ORDER BY p DESC, nxt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS cum_before FROM s3)
"""


@register("softmax", _CAND + _soft_sql(1.0) + "SELECT ctx, nxt, round(p, 6) AS p FROM s3")
def softmax(spark: SparkSession, sf_dir: str):
    c = candidates(spark, sf_dir)
    return finish(dc.softmax(c, counts="n").select("ctx", "nxt", "p"))


@register("temperature", _CAND + _soft_sql(TEMP) + "SELECT ctx, nxt, round(p, 6) AS p FROM s3")
def temperature(spark: SparkSession, sf_dir: str):
    c = candidates(spark, sf_dir)
    return finish(dc.softmax(c, temperature=TEMP).select("ctx", "nxt", "p"))


@register("cum_prob", _CAND + _soft_sql(1.0) + "SELECT ctx, nxt, round(p, 6) AS p, round(cum, 6) AS cum FROM s4")
def cum_prob(spark: SparkSession, sf_dir: str):
    c = candidates(spark, sf_dir)
    return finish(dc.cum_prob(c, counts="n").select("ctx", "nxt", "p", "cum"))


_NUC = _CAND + _soft_sql(TEMP) + f""", kept AS (SELECT *, p / (sum(p) OVER (PARTITION BY ctx) + 1e-8) AS p_keep FROM s4 WHERE cum_before <= {TOP_P} + {dc.EDGE})
"""


@register("nucleus", _NUC + "SELECT ctx, nxt, round(p_keep, 6) AS p_keep FROM kept")
def nucleus(spark: SparkSession, sf_dir: str):
    c = candidates(spark, sf_dir)
    return finish(dc.nucleus(c, TOP_P, TEMP).select("ctx", "nxt", "p_keep"))


@register(
    "multinomial_draw",
    _NUC + f""", ck AS (SELECT ctx, nxt, sum(p_keep) OVER (PARTITION BY ctx ORDER BY p DESC, nxt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ck,
       row_number() OVER (PARTITION BY ctx ORDER BY p DESC, nxt) AS ord,
       (('0x' || substr(md5('{SEED}|' || CAST(ctx AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0) AS u FROM kept)
SELECT ctx, coalesce(arg_min(nxt, ord) FILTER (WHERE ck > u), arg_max(nxt, ord)) AS nxt FROM ck GROUP BY ctx""",
)
def multinomial_draw(spark: SparkSession, sf_dir: str):
    c = candidates(spark, sf_dir)
    return dc.draw_from(dc.nucleus(c, TOP_P, TEMP), SEED)


@register("greedy_next", _CAND + "SELECT ctx, arg_min(nxt, [-n, nxt]) AS nxt FROM cand GROUP BY ctx")
def greedy_next(spark: SparkSession, sf_dir: str):
    return dc.greedy(pair_candidates(encoded(spark, sf_dir)[1]))


@register(
    "repetition_penalty",
    _CAND + f""", last AS (SELECT doc_id, arg_max(token_id, pos) AS ctx FROM tok_ids GROUP BY doc_id),
past AS (SELECT DISTINCT doc_id, token_id FROM tok_ids),
c AS (SELECT l.doc_id, cand.nxt, cand.logit, p.token_id IS NOT NULL AS seen FROM last l JOIN cand ON cand.ctx = l.ctx
      LEFT JOIN past p ON p.doc_id = l.doc_id AND p.token_id = cand.nxt),
pen AS (SELECT doc_id, nxt, seen, CASE WHEN seen THEN (CASE WHEN logit > 0 THEN logit / {PENALTY} ELSE logit * {PENALTY} END) ELSE logit END AS pl FROM c)
SELECT doc_id, count(*) AS n_cand, CAST(sum(CASE WHEN seen THEN 1 ELSE 0 END) AS BIGINT) AS n_penalized,
       arg_min(nxt, [-pl, nxt]) AS choice, round(max(pl), 6) AS choice_logit FROM pen GROUP BY doc_id""",
)
def repetition_penalty(spark: SparkSession, sf_dir: str):
    """One decoding step per document with the whole document as the prompt: the candidates of
    its last token, with every token already in the document penalised. Documents and successors meet packed, in slices of
    the last token."""
    docs = encoded(spark, sf_dir)[1]
    c = prompts_op.counted(docs)
    prompts = docs.select(F.col("doc_id").alias("pid"), F.element_at("ids", -1).alias("ctx"), F.col("ids").alias("own"))
    out = dc.penalised_choice(prompts, c, PENALTY)
    return finish(out.select(F.col("pid").alias("doc_id"), "n_cand", "n_penalized", "choice", "choice_logit"))


@register(
    "generate_greedy",
    "WITH RECURSIVE " + _CAND[len("WITH "):] + f""", g AS (SELECT ctx, arg_min(nxt, [-n, nxt]) AS nxt FROM cand GROUP BY ctx),
last AS (SELECT doc_id, arg_max(token_id, pos) AS ctx FROM tok_ids GROUP BY doc_id),
gen(doc_id, step, token_id) AS (
  SELECT last.doc_id, 1, coalesce(g.nxt, 1) FROM last LEFT JOIN g ON g.ctx = last.ctx
  UNION ALL
  SELECT gen.doc_id, gen.step + 1, coalesce(g.nxt, 1) FROM gen LEFT JOIN g ON g.ctx = gen.token_id WHERE gen.step < {GEN_STEPS})
SELECT doc_id, step, token_id FROM gen""",
)
def generate_greedy(spark: SparkSession, sf_dir: str):
    """Greedy continuation of every document (whole text as prompt) for a fixed number of steps."""
    docs = encoded(spark, sf_dir)[1]
    last, _ = doc_context(docs)
    prompts = last.select(F.col("doc_id").alias("pid"), "ctx")
    g = dc.generate(prompts, pair_candidates(docs), GEN_STEPS, "greedy")
    return g.select(F.col("pid").alias("doc_id"), F.col("step"), F.col("token").alias("token_id"))


def _topp_sql() -> str:
    """The steps of ``generate_topp`` unrolled, each over documents x successors."""
    parts = [_CAND, """, last AS (SELECT doc_id, arg_max(token_id, pos) AS token FROM tok_ids GROUP BY doc_id),
cd AS MATERIALIZED (SELECT * FROM cand), s0 AS MATERIALIZED (SELECT doc_id, token FROM last), past0 AS MATERIALIZED (SELECT DISTINCT doc_id, token_id AS token FROM tok_ids)"""]
    for i in range(1, GEN_STEPS + 1):
        parts.append(f""",
a{i} AS (SELECT s.doc_id, c.nxt, CASE WHEN p.token IS NULL OR c.logit = 0 THEN 0 ELSE 1 END AS pen,
  CASE WHEN p.token IS NULL THEN c.logit WHEN c.logit > 0 THEN c.logit / {PENALTY} ELSE c.logit * {PENALTY} END AS pl
  FROM s{i - 1} s JOIN cd c ON c.ctx = s.token LEFT JOIN past{i - 1} p ON p.doc_id = s.doc_id AND p.token = c.nxt),
b{i} AS (SELECT *, exp((pl - max(pl) OVER (PARTITION BY doc_id)) / {TEMP}) AS e, row_number() OVER (PARTITION BY doc_id ORDER BY round(pl, {dc.TIE}) DESC, pen, pl DESC, nxt) AS o FROM a{i}),
c{i} AS (SELECT *, sum(e) OVER (PARTITION BY doc_id) AS z, sum(e) OVER (PARTITION BY doc_id ORDER BY o ROWS UNBOUNDED PRECEDING) AS cum FROM b{i}),
k{i} AS (SELECT *, sum(e) OVER (PARTITION BY doc_id) + 1e-8 * z AS kept, ('0x' || substr(md5('{SEED}|' || doc_id || '|{i}'), 1, 8))::BIGINT / 4294967296.0 AS u
  FROM c{i} WHERE cum - e <= ({GEN_TOP_P} + {dc.EDGE}) * z),
g{i} AS (SELECT doc_id, coalesce(arg_min(nxt, o) FILTER (WHERE cum > u * kept), arg_max(nxt, o)) AS token FROM k{i} GROUP BY doc_id),
s{i} AS MATERIALIZED (SELECT s.doc_id, coalesce(g.token, 1) AS token FROM s{i - 1} s LEFT JOIN g{i} g USING (doc_id)),
past{i} AS MATERIALIZED (SELECT doc_id, token FROM past{i - 1} UNION SELECT doc_id, token FROM s{i})""")
    return "".join(parts) + "\n" + " UNION ALL ".join(f"SELECT doc_id, {i} AS step, token AS token_id FROM s{i}" for i in range(1, GEN_STEPS + 1))


@register("generate_topp", _topp_sql())
def generate_topp(spark: SparkSession, sf_dir: str):
    """Nucleus sampling (p=0.95, T=0.8, repetition penalty 1.5 over the prompt and generated
    tokens) for every document; keyed draws make the output repeatable."""
    docs = encoded(spark, sf_dir)[1]
    c = prompts_op.counted(docs)
    prompts = docs.select(F.col("doc_id").alias("pid"), F.element_at("ids", -1).alias("ctx"), F.col("ids").alias("own"))
    g = dc.generate(prompts, c, GEN_STEPS, "topp", top_p=GEN_TOP_P, temperature=TEMP, penalty=PENALTY, seed=SEED)
    return g.select(F.col("pid").alias("doc_id"), "step", F.col("token").alias("token_id"))


@register(
    "generation_report",
    f"""WITH c AS (SELECT conv_id, turn, role, regexp_extract_all(lower(text), '{tx.TOKEN_PATTERN}') AS toks FROM conversations)
SELECT conv_id, turn, role, CAST(len(toks) AS BIGINT) AS n_tokens, CAST(len(list_distinct(toks)) AS BIGINT) AS n_distinct,
       round(CASE WHEN len(toks) > 0 THEN len(list_distinct(toks)) / len(toks) END, 6) AS distinct_ratio,
       round(CASE WHEN len(toks) > 0 THEN 1 - len(list_distinct(toks)) / len(toks) END, 6) AS repeat_rate FROM c""",
)
def generation_report(spark: SparkSession, sf_dir: str):
    """Per conversation turn: length, distinct-token ratio and repeat rate (array functions on
    the row - no shuffle)."""
    cv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", tx.token_array("text").alias("toks"))
    n = F.size("toks")
    d = F.size(F.array_distinct("toks"))
    return finish(cv.select(
        "conv_id", "turn", "role", n.cast("bigint").alias("n_tokens"), d.cast("bigint").alias("n_distinct"),
        F.when(n > 0, d / n).alias("distinct_ratio"), F.when(n > 0, 1 - d / n).alias("repeat_rate"),
    ))
