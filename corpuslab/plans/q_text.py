"""Queries: text -> sequence preparation."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from corpuslab.functions import text as tx
from corpuslab.functions.hashing import draw, draw_sql
from corpuslab.functions.text import STRIP_CLASS
from corpuslab.operators import text as tt
from corpuslab.operators.ranking import exact_rank
from corpuslab.plans import sql as q
from corpuslab.plans import views
from corpuslab.plans.catalog import finish, register
from corpuslab.session import written
from corpuslab.sources.tables import table

BLOCK = 64
K = 3
CHUNK = 2
BATCH = 16
SEED = 42

_TOKVOCAB = q.with_(q.DOC_TOKS, q.TOK, q.VOCAB, q.DOC_IDS)


@register("tokenize", q.with_(q.DOC_TOKS, q.TOK) + "SELECT doc_id, pos, t FROM tok")
def tokenize(spark: SparkSession, sf_dir: str):
    return views.tok(spark, sf_dir).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "t")


@register("vocab", q.with_(q.DOC_TOKS, q.TOK, q.VOCAB) + "SELECT t, c, token_id FROM vocab")
def vocab(spark: SparkSession, sf_dir: str):
    return views.vocab(spark, sf_dir)


@register("encode_ids", _TOKVOCAB + "SELECT doc_id, pos, token_id FROM tok_ids")
def encode_ids(spark: SparkSession, sf_dir: str):
    voc = views.vocab(spark, sf_dir)
    return tt.encode(views.tok(spark, sf_dir), voc).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "token_id")


@register(
    "decode_roundtrip",
    _TOKVOCAB
    + """SELECT i.doc_id, string_agg(v.t, ' ' ORDER BY i.pos) AS text, count(*) AS n_tokens,
       string_agg(v.t, ' ' ORDER BY i.pos) = array_to_string(d.toks, ' ') AS same
FROM tok_ids i JOIN vocab v ON v.token_id = i.token_id JOIN doc_toks d ON d.doc_id = i.doc_id
GROUP BY i.doc_id, d.toks""",
)
def decode_roundtrip(spark: SparkSession, sf_dir: str):
    """The original goes along with its ids as a 256-bit digest, so texts are not exchanged to be compared."""
    voc = views.vocab(spark, sf_dir)
    line = views.doc_tokens(spark, sf_dir).select("doc_id", "toks", F.unhex(F.sha2(F.array_join("toks", " "), 256)).alias("orig"))
    ids = tt.encode_arrays(line.where("doc_id is not null"), voc, keep=("doc_id", "orig"))
    dec = tt.decode_arrays(ids, voc, keep=("doc_id", "orig"))
    return dec.select("doc_id", "text", "n_tokens", (F.unhex(F.sha2("text", 256)) == F.col("orig")).alias("same"))


@register(
    "blocks",
    _TOKVOCAB
    + f"""SELECT doc_id, CAST((pos - 1) // {BLOCK} AS BIGINT) AS block, count(*) AS n,
       arg_min(token_id, pos) AS first_id, arg_max(token_id, pos) AS last_id
FROM tok_ids GROUP BY doc_id, (pos - 1) // {BLOCK}""",
)
def blocks(spark: SparkSession, sf_dir: str):
    b = tt.blocks(views.doc_ids(spark, sf_dir), BLOCK)
    return b.select(
        "doc_id", F.col("block").cast("bigint").alias("block"), F.size("seq").cast("bigint").alias("n"),
        F.element_at("seq", 1).alias("first_id"), F.element_at("seq", -1).alias("last_id"),
    )


@register("next_pairs", q.with_(q.DOC_TOKS, q.PAIRS) + "SELECT doc_id, CAST(pos AS BIGINT) AS pos, t, nxt FROM pairs")
def next_pairs(spark: SparkSession, sf_dir: str):
    p = tt.next_pairs(views.doc_tokens(spark, sf_dir))
    return p.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "t", "nxt")


def _kgram_sql(k: int, include_current: bool) -> str:
    lags = range(k - 1, -1, -1) if include_current else range(k, 0, -1)
    parts = [
        "token_id" if j == 0 else f"coalesce(lag(token_id, {j}) OVER (PARTITION BY doc_id ORDER BY pos), 0)" for j in lags
    ]
    return _TOKVOCAB + f"SELECT doc_id, CAST(pos AS BIGINT) AS pos, concat_ws(',', {', '.join(parts)}) AS ctx FROM tok_ids"


@register("kgrams", _kgram_sql(K, True))
def kgrams(spark: SparkSession, sf_dir: str):
    g = tt.kgrams(views.doc_ids(spark, sf_dir), K)
    return g.select("doc_id", F.col("pos").cast("bigint").alias("pos"), tx.ids_string("ctx").alias("ctx"))


@register("kgrams_exclusive", _kgram_sql(K, False))
def kgrams_exclusive(spark: SparkSession, sf_dir: str):
    g = tt.kgrams(views.doc_ids(spark, sf_dir), K, include_current=False)
    return g.select("doc_id", F.col("pos").cast("bigint").alias("pos"), tx.ids_string("ctx").alias("ctx"))


@register(
    "position_chunks",
    _TOKVOCAB
    + f"""SELECT doc_id, CAST((pos - 1) // {CHUNK} AS BIGINT) AS chunk, count(*) AS n,
       arg_min(token_id, pos) AS first_id, arg_max(token_id, pos) AS last_id
FROM tok_ids GROUP BY doc_id, (pos - 1) // {CHUNK}""",
)
def position_chunks(spark: SparkSession, sf_dir: str):
    c = tt.position_chunks(views.doc_ids(spark, sf_dir), CHUNK)
    return c.select("doc_id", F.col("chunk").cast("bigint").alias("chunk"), F.col("n").cast("bigint").alias("n"), "first_id", "last_id")


def _batched(spark: SparkSession, sf_dir: str, voc=None):
    """Ids are written before they are ranked: ranges are sampled first, which would write them over twice."""
    ids = written(views.doc_ids(spark, sf_dir, voc).select("doc_id", "ids"))
    ranked = exact_rank(ids.withColumn("_u", draw(SEED, "doc_id")), ["_u", "doc_id"], name="rank")
    return ranked.withColumn("batch_id", F.floor((F.col("rank") - 1) / BATCH).cast("bigint"))


_BATCH_SQL = _TOKVOCAB + f""", lens AS (SELECT doc_id, len(ids) AS n_tokens, {draw_sql(SEED, 'doc_id')} AS u FROM doc_ids),
bat AS (SELECT doc_id, n_tokens, CAST((row_number() OVER (ORDER BY u, doc_id) - 1) // {BATCH} AS BIGINT) AS batch_id FROM lens),
pad AS (SELECT batch_id, doc_id, n_tokens, max(n_tokens) OVER (PARTITION BY batch_id) AS max_len FROM bat)
"""


@register(
    "pad_batches",
    _BATCH_SQL + "SELECT batch_id, doc_id, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(max_len AS BIGINT) AS max_len, "
    "CAST(max_len - n_tokens AS BIGINT) AS pad_cells FROM pad",
)
def pad_batches(spark: SparkSession, sf_dir: str):
    p = tt.pad_batches(_batched(spark, sf_dir))
    return p.select(
        "batch_id", "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.col("max_len").cast("bigint").alias("max_len"),
        (F.size("padded") - F.size("ids")).cast("bigint").alias("pad_cells"),
    )


@register(
    "pad_waste",
    _BATCH_SQL
    + """SELECT batch_id, count(*) AS n_seqs, CAST(sum(max_len) AS BIGINT) AS cells, CAST(sum(max_len - n_tokens) AS BIGINT) AS pad_cells,
       round(sum(max_len - n_tokens) / sum(max_len), 6) AS pad_fraction FROM pad GROUP BY batch_id""",
)
def pad_waste(spark: SparkSession, sf_dir: str):
    return finish(tt.pad_waste(tt.pad_batches(_batched(spark, sf_dir))))


@register(
    "cross_entropy_padded",
    _BATCH_SQL
    + """, seq AS (SELECT pad.doc_id, list_concat(ids, list_resize([]::INTEGER[], max_len - n_tokens, 0)) AS s FROM pad JOIN doc_ids USING (doc_id)),
pr AS (SELECT unnest(s[:-2]) AS ctx, unnest(s[2:]) AS nxt FROM seq WHERE len(s) > 1),
cnt AS (SELECT ctx, nxt, count(*) AS n FROM pr GROUP BY ALL), tot AS (SELECT ctx, sum(n) AS C FROM cnt GROUP BY ctx),
sc AS (SELECT n, nxt, -ln((n + 1.0::DOUBLE) / (C + 1.0::DOUBLE + (SELECT count(*) FROM vocab))) AS nll FROM cnt JOIN tot USING (ctx))
SELECT CAST(sum(n) AS BIGINT) AS tokens, CAST(coalesce(sum(n) FILTER (WHERE nxt = 0), 0) AS BIGINT) AS pad_tokens, round(sum(n * nll) / sum(n), 6) AS cross_entropy,
       round(exp(sum(n * nll) / sum(n)), 2) AS perplexity FROM sc""",
)
def cross_entropy_padded(spark: SparkSession, sf_dir: str):
    """Next-token cross-entropy with padding positions included: batches of shuffled whole documents padded to
    their longest one, the pad (0) as a token like others, add-one bigram model over all pairs."""
    voc = views.vocab(spark, sf_dir)
    v = voc.count() + 1
    counts = tt.padded_pairs(_batched(spark, sf_dir, voc))
    # -ln((n + 1) / (C + v)) summed over pairs: a context's share needs its counts only, and no join of pairs
    of_pair = F.sum(F.col("n") * F.log(F.col("n") + F.lit(1.0))).alias("own")
    s = counts.groupBy("ctx").agg(F.sum("n").alias("C"), of_pair, F.sum(F.when(F.col("nxt") == 0, F.col("n"))).alias("pads"))
    nll = F.col("C") * F.log(F.col("C") + F.lit(float(v))) - F.col("own")
    e = s.agg(F.sum("C").cast("bigint").alias("tokens"), F.coalesce(F.sum("pads"), F.lit(0)).cast("bigint").alias("pad_tokens"), (F.sum(nll) / F.sum("C")).alias("cross_entropy"))
    return finish(e.withColumn("perplexity", F.exp("cross_entropy")), perplexity=2)


@register(
    "corpus_stats",
    q.with_(q.DOC_TOKS)
    + """, d AS (SELECT source, count(*) AS sequences, CAST(sum(len(toks)) AS BIGINT) AS tokens, CAST(max(len(toks)) AS BIGINT) AS max_len
           FROM doc_toks GROUP BY source),
u AS (SELECT source, count(DISTINCT t) AS distinct_tokens FROM (SELECT source, unnest(toks) AS t FROM doc_toks) GROUP BY source)
SELECT d.*, u.distinct_tokens FROM d LEFT JOIN u USING (source)""",
)
def corpus_stats(spark: SparkSession, sf_dir: str):
    return tt.corpus_stats(views.doc_tokens(spark, sf_dir), "source")


@register(
    "corpus_lines",
    f"""SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, line FROM (
  SELECT doc_id, line_no, regexp_replace(raw, '^{STRIP_CLASS}+|{STRIP_CLASS}+$', '', 'g') AS line FROM (
    SELECT doc_id, unnest(generate_series(1, len(parts))) AS line_no, unnest(parts) AS raw
    FROM (SELECT doc_id, regexp_split_to_array(text, '\\r\\n|\\r|\\n') AS parts FROM documents)))
WHERE length(line) > 0""",
)
def corpus_lines(spark: SparkSession, sf_dir: str):
    ls = tt.line_scan(views.documents(spark, sf_dir))
    return ls.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "line")


@register(
    "source_union",
    """SELECT 'documents' AS source, doc_id AS item_id, CAST(length(text) AS BIGINT) AS n_chars FROM documents
UNION ALL SELECT 'benchmark' AS source, item_id, CAST(length(text) AS BIGINT) AS n_chars FROM benchmark""",
)
def source_union(spark: SparkSession, sf_dir: str):
    a = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text")
    b = table(spark, sf_dir, "benchmark").select("item_id", "text")
    u = tt.union_sources(a, b, "documents", "benchmark")
    return u.select("source", "item_id", F.length("text").cast("bigint").alias("n_chars"))


@register(
    "token_audit",
    _TOKVOCAB
    + """SELECT count(*) AS n, CAST(sum(CASE WHEN token_id < 1 OR token_id > (SELECT count(*) FROM vocab) THEN 1 ELSE 0 END) AS BIGINT) AS n_bad,
       CAST(min(token_id) AS BIGINT) AS min_id, CAST(max(token_id) AS BIGINT) AS max_id,
       CAST(min(CASE WHEN token_id < 1 OR token_id > (SELECT count(*) FROM vocab) THEN token_id END) AS BIGINT) AS first_bad
FROM tok_ids""",
)
def token_audit(spark: SparkSession, sf_dir: str):
    voc = views.vocab(spark, sf_dir)
    v = voc.count()
    return tt.token_audit(tt.encode(views.tok(spark, sf_dir), voc), v)


@register(
    "safe_name",
    """SELECT page_id, regexp_replace(replace(replace(url, ':', '-'), ' ', ''), '[<>:"/\\\\|?*]', '', 'g') AS safe FROM pages""",
)
def safe_name(spark: SparkSession, sf_dir: str):
    from corpuslab.functions import scalars as sc

    return table(spark, sf_dir, "pages").select("page_id", sc.safe_name("url").alias("safe"))


@register("basename", """SELECT page_id, string_split(replace(url, '\\', '/'), '/')[-1] AS base FROM pages""")
def basename(spark: SparkSession, sf_dir: str):
    from corpuslab.functions import scalars as sc

    return table(spark, sf_dir, "pages").select("page_id", sc.basename("url").alias("base"))


CONTEXT = 16


@register(
    "tail_tokens",
    _TOKVOCAB + f"""SELECT doc_id, string_agg(CAST(token_id AS VARCHAR), ',' ORDER BY pos) AS context
FROM (SELECT doc_id, pos, token_id, max(pos) OVER (PARTITION BY doc_id) AS n FROM tok_ids) WHERE pos > n - {CONTEXT} GROUP BY doc_id""",
)
def tail_tokens(spark: SparkSession, sf_dir: str):
    """Rolling generation context of every document: its last 16 token ids (the whole text is
    tokenised; the window is the decoding context, as in generation)."""
    ids = views.doc_ids(spark, sf_dir)
    return ids.where(F.size("ids") > 0).select("doc_id", tx.ids_string(tx.tail("ids", CONTEXT)).alias("context"))
