"""Oracle SQL building blocks (DuckDB dialect) mirroring ``views.py`` definition by definition.

These strings are the independent check: they state each view in plain SQL with global windows
and self-joins - fine for a single-node oracle at sf0.01, never used by the Spark plans.
"""

from __future__ import annotations

from corpuslab.functions.hashing import draw_sql
from corpuslab.functions.text import TOKEN_PATTERN

DOC_TOKS = f"""doc_toks AS (
  SELECT doc_id, lang, source, regexp_extract_all(lower(text), '{TOKEN_PATTERN}') AS toks FROM documents)"""

TOK = """tok AS (
  SELECT doc_id, lang, source, unnest(generate_series(1, len(toks))) AS pos, unnest(toks) AS t FROM doc_toks)"""

VOCAB = """vocab AS (
  SELECT t, c, CAST(row_number() OVER (ORDER BY c DESC, t) AS INTEGER) AS token_id
  FROM (SELECT t, count(*) AS c FROM tok GROUP BY t))"""

DOC_IDS = """tok_ids AS (SELECT tok.doc_id, tok.pos, tok.t, vocab.token_id FROM tok JOIN vocab USING (t)),
doc_ids AS (
  SELECT d.doc_id, d.lang, d.source, coalesce(list(i.token_id ORDER BY i.pos) FILTER (WHERE i.token_id IS NOT NULL), []) AS ids
  FROM documents d JOIN tok_ids i USING (doc_id) GROUP BY d.doc_id, d.lang, d.source)"""

PAIRS = """pairs AS (
  SELECT doc_id, lang, source, i AS pos, toks[i] AS t, toks[i + 1] AS nxt
  FROM (SELECT doc_id, lang, source, toks, unnest(generate_series(1, len(toks) - 1)) AS i FROM doc_toks))"""


def split(seed=42, frac=0.1, key="doc_id", table="documents", name="split_t") -> str:
    u = draw_sql(seed, key)
    return f"""{name} AS (
  SELECT {key}, CASE WHEN rk <= floor({frac} * n) THEN 'val' ELSE 'train' END AS split
  FROM (SELECT {key}, row_number() OVER (ORDER BY u, {key}) AS rk, count(*) OVER () AS n
        FROM (SELECT {key}, {u} AS u FROM {table})))"""


STEPS = """steps AS (
  SELECT run, epoch, split, row_number() OVER (PARTITION BY run, epoch, split ORDER BY ts, event_id) AS step,
         event_id, ts, value, loss
  FROM (SELECT user_id AS run, event_id, ts, value,
               CAST(1 + floor((dayofmonth(ts) - 1) / 6) AS INTEGER) AS epoch,
               CASE WHEN event_type = 'view' THEN 'val' ELSE 'train' END AS split,
               ln(1 + value) AS loss
        FROM events))"""

RUN_EPOCHS = """run_epochs AS (
  SELECT run, epoch,
         CAST(sum(CASE WHEN split = 'train' THEN 1 ELSE 0 END) AS BIGINT) AS n_train,
         CAST(sum(CASE WHEN split <> 'train' THEN 1 ELSE 0 END) AS BIGINT) AS n_val,
         avg(CASE WHEN split = 'train' THEN loss END) AS avg_loss,
         avg(CASE WHEN split <> 'train' THEN loss END) AS val_loss,
         exp(avg(CASE WHEN split = 'train' THEN loss END)) AS perplexity,
         avg(CASE WHEN split = 'train' THEN (CASE WHEN value < 20 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) END) AS token_accuracy,
         max(CASE WHEN split = 'train' THEN loss END) AS max_loss,
         min(ts) AS first_ts
  FROM steps GROUP BY run, epoch)"""

RUNS = """runs_base AS (
  SELECT run, epoch, avg_loss, val_loss, perplexity, token_accuracy, max_loss,
         min(first_ts) OVER (PARTITION BY run) AS start_ts
  FROM run_epochs QUALIFY row_number() OVER (PARTITION BY run ORDER BY epoch DESC) = 1),
runs_cfg AS (
  SELECT *,
    ['kgram_mlp_seq', 'lstm_seq', 'kvcache_transformer', 'deepseek_latent_attention'][run % 4 + 1] AS model_type,
    ['relu', 'gelu'][(run // 4) % 2 + 1] AS activation,
    CAST([32, 64, 128, 256][(run // 8) % 4 + 1] AS INTEGER) AS embed_size,
    CAST(1 + run % 5 AS INTEGER) AS k,
    CAST(1 + run % 3 AS INTEGER) AS chunk_size,
    CAST(3 + 2 * ((run // 5) % 5) AS INTEGER) AS inner_layers,
    CAST(pow(2, 3 + (run // 2) % 5) AS INTEGER) AS block_size,
    CAST(pow(2, 5 + (run // 7) % 4) AS INTEGER) AS batch_size,
    ['0.001', '0.005', '0.05'][(run // 3) % 3 + 1] AS learning_rate,
    '0.8' AS tinystories_weight,
    CAST(epoch AS INTEGER) AS num_epochs
  FROM runs_base),
runs AS (
  SELECT * EXCLUDE (start_ts),
    model_type || '_tsw' || tinystories_weight || '_bs' || batch_size || '_lr' || learning_rate || '_act' || activation
      || '_ep' || num_epochs || '_mlp' || inner_layers || '_k' || k || '_cs' || chunk_size || '_blk' || block_size
      || '_emb' || embed_size || '_' || strftime(start_ts, '%Y%m%d_%H%M%S') AS config_name
  FROM runs_cfg)"""

RUNLOG = ",\n".join([STEPS, RUN_EPOCHS, RUNS])


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
