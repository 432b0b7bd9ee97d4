"""Scalar column functions: run-configuration names, parsing, names and paths, coercion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Model types and activations known to the run-name format.
MODEL_TYPES = ["kgram_mlp_seq", "lstm_seq", "kvcache_transformer", "deepseek_latent_attention"]
ACTIVATIONS = ["relu", "gelu"]

# Run-name fields, in name order, with their column names.
NAME_FIELDS = [
    ("tsw", "tinystories_weight"),
    ("bs", "batch_size"),
    ("lr", "learning_rate"),
    ("act", "activation"),
    ("ep", "num_epochs"),
    ("mlp", "inner_layers"),
    ("k", "k"),
    ("cs", "chunk_size"),
    ("blk", "block_size"),
    ("emb", "embed_size"),
]

# Strict parse patterns (anchored forms) for a run name.
STRICT_PATTERNS = {
    "model_type": r"^(kgram_mlp_seq|lstm_seq|kvcache_transformer|deepseek_latent_attention)",
    "inner_layers": r"mlp(\d+)",
    "k": r"k(\d+)",
    "chunk_size": r"cs(\d+)",
    "block_size": r"blk(\d+)",
    "embed_size": r"emb(\d+)",
    "activation": r"_act(relu|gelu)(?:_|$)",
    "learning_rate": r"lr([0-9.]+)(?:_|$)",
    "batch_size": r"bs(\d+)(?:_|$)",
    "tinystories_weight": r"tsw([0-9.]+)(?:_|$)",
    "num_epochs": r"ep(\d+)(?:_|$)",
}

# Lenient patterns used when filling only missing values.
LENIENT_PATTERNS = {
    "model_type": r"^(kgram_mlp_seq|lstm_seq|kvcache_transformer|deepseek_latent_attention)",
    "inner_layers": r"mlp(\d+)",
    "k": r"k(\d+)",
    "chunk_size": r"cs(\d+)",
    "block_size": r"blk(\d+)",
    "embed_size": r"emb(\d+)",
    "activation": r"_act(relu|gelu)_",
    "learning_rate": r"lr([0-9.]+)",
    "batch_size": r"bs(\d+)",
    "tinystories_weight": r"tsw([0-9.]+)",
    "num_epochs": r"ep(\d+)",
}

INT_KEYS = {"inner_layers", "k", "chunk_size", "block_size", "embed_size", "batch_size", "num_epochs"}
DOUBLE_KEYS = {"learning_rate", "tinystories_weight"}
CONFIG_KEYS = list(STRICT_PATTERNS)

TIMESTAMP_SUFFIX = r"_\d{8}_\d{6}$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _pick(values: list, idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


def synthetic_config(run_col: str = "run") -> list[Column]:
    """Configuration columns derived from an integer run id (driver-table convention)."""
    r = F.col(run_col)
    return [
        _pick(MODEL_TYPES, r % 4).alias("model_type"),
        _pick(ACTIVATIONS, F.expr(f"({run_col} div 4) % 2")).alias("activation"),
        _pick([32, 64, 128, 256], F.expr(f"({run_col} div 8) % 4")).cast("int").alias("embed_size"),
        (F.lit(1) + r % 5).cast("int").alias("k"),
        (F.lit(1) + r % 3).cast("int").alias("chunk_size"),
        (F.lit(3) + 2 * F.expr(f"({run_col} div 5) % 5")).cast("int").alias("inner_layers"),
        F.expr(f"shiftleft(1, CAST(3 + ({run_col} div 2) % 5 AS INT))").cast("int").alias("block_size"),
        F.expr(f"shiftleft(1, CAST(5 + ({run_col} div 7) % 4 AS INT))").cast("int").alias("batch_size"),
        _pick(["0.001", "0.005", "0.05"], F.expr(f"({run_col} div 3) % 3")).alias("learning_rate"),
        F.lit("0.8").alias("tinystories_weight"),
        F.col("epoch").cast("int").alias("num_epochs"),
    ]


def config_name(ts_col=None) -> Column:
    """``{model}_tsw.._bs.._lr.._act.._ep.._mlp.._k.._cs.._blk.._emb.._{yyyyMMdd_HHmmss}``.
    Hyper-parameters travel as strings so the text does not depend on double formatting."""
    parts = [F.col("model_type")]
    for prefix, col in NAME_FIELDS:
        parts.append(F.concat(F.lit(prefix), F.col(col).cast("string")))
    if ts_col is not None:
        parts.append(F.date_format(_c(ts_col), "yyyyMMdd_HHmmss"))
    return F.concat_ws("_", *parts)


def parse_config(name, lenient: bool = False, overrides: dict | None = None) -> list[Column]:
    """Typed configuration columns parsed from a run name; a missing field is NULL.
    ``overrides`` maps key -> Column/literal that wins over the parsed value (lenient mode)."""
    patterns = LENIENT_PATTERNS if lenient else STRICT_PATTERNS
    overrides = overrides or {}
    out = []
    for key, pat in patterns.items():
        raw = F.nullif(F.regexp_extract(_c(name), pat, 1), F.lit(""))
        if key in INT_KEYS:
            val = raw.try_cast("int")
        elif key in DOUBLE_KEYS:
            val = raw.try_cast("double")
        else:
            val = raw
        if key in overrides:
            val = F.coalesce(overrides[key] if isinstance(overrides[key], Column) else F.lit(overrides[key]), val)
        out.append(val.alias(key))
    return out


def missing_keys(keys: list[str] = CONFIG_KEYS) -> Column:
    """Comma list of configuration keys that are NULL (the reject reason)."""
    return F.concat_ws(",", *[F.when(F.col(k).isNull(), F.lit(k)) for k in keys])


def core_config(name) -> Column:
    """Run name without its ``_yyyyMMdd_HHmmss`` suffix."""
    return F.regexp_replace(_c(name), TIMESTAMP_SUFFIX, "")


def safe_name(s) -> Column:
    """':' -> '-', spaces removed, then the characters < > : " / \\ | ? * removed."""
    step = F.replace(F.replace(_c(s), F.lit(":"), F.lit("-")), F.lit(" "), F.lit(""))
    return F.regexp_replace(step, r'[<>:"/\\|?*]', "")


def basename(p) -> Column:
    """Last path element, either slash."""
    return F.element_at(F.split(F.replace(_c(p), F.lit("\\"), F.lit("/")), "/"), -1)


def to_double(c) -> Column:
    """Lenient numeric coercion: unparsable -> NULL (ANSI-safe)."""
    return _c(c).try_cast("double")


def perplexity(loss) -> Column:
    return F.exp(_c(loss))


def utc_instant(ts_ntz) -> Column:
    """TIMESTAMP_NTZ wall-clock time read as UTC -> TIMESTAMP instant, whatever the session
    time zone (event time must not move with the session setting)."""
    from pyspark.sql import SparkSession

    tz = SparkSession.getActiveSession().conf.get("spark.sql.session.timeZone")
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), _c(ts_ntz)).cast("timestamp")
