"""Personal data: candidate generation, gradient-boosted trees, calibrated thresholds; no Python on rows.

Base spans follow fixed formats (emails, IP addresses, card numbers passing Luhn, phone numbers).
Two wide generators propose further, overlapping candidates: anything around an at sign (also spelt
out) and any run of digits with separators. Boosted trees (Spark ML) score a candidate by its format
and context; the trees are then written as one SQL expression, so scoring is a narrow step on the
document row. A candidate that overlaps no base span is added if its score reaches its kind's
threshold. The tables label nothing beyond the base rules, so labels are made: in the rows for fitting
every email, card and phone number that the rules find is written in a way that they miss (``disguised``), and
the candidates that overlap no base span, which are the ones that can be added, are right if they end where a
disguised span does. The threshold is the lowest score at which at least ``PRECISION`` of the held-out ones are
right: real data that no rule finds counts as wrong there, so the precision is understated. The trees are
fitted on a bounded sample, about ``SAMPLE_DOCS`` documents with a digit or an at sign, chosen by a hash of id
and text; the thresholds on all held-out documents (a quarter).

Offsets are code points, end exclusive. Matches are found by ``regexp_extract_all`` and placed by the
lengths of the pieces that ``split`` leaves between them. The context of a candidate is the piece before it with
the match before that, and the piece after it. Long lists of spans are worked in blocks of ``BLOCK``: running
sums, overlaps and redaction never copy or scan a text's whole list, or the whole text, for one span.

Defined results: null or empty text: no spans and the hash of the empty string; redaction keeps null.
Null ids and repeated rows are rows like others. An empty table: no rows. Extra columns are kept by
``redact``. A sample without both kinds of candidates adds nothing.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm import common as c

KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCS, TREES, DEPTH, PRECISION = 8000, 12, 3, 0.9
# possessive forms of the contract's patterns: the same matches, without backtracking or recursion;
# a match can start only where no match could have started one character earlier, or after a match
_MAIL = r"[A-Za-z0-9._%+-]"
BASE = (
    rf"(?:\G|(?<!{_MAIL})){_MAIL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
_ANY = r"[^\x00-\x20@,;:<>()\[\]]"
WIDE = (
    rf"(?:\G|(?<!{_ANY}))(?>{_ANY}++(?:@|\x20?[\[(]at[\])]\x20?))(?:{_ANY}++)",
    r"[+(]{0,2}[0-9](?:[\x20().+/-]{0,3}[0-9])++",
)
_NEED = ("instr({t}, '@') > 0", "{t} rlike '[0-9][.][0-9]'", "{t} rlike '[0-9]'", "instr({t}, '+') > 0")
_WIDE_NEED = ("instr({t}, '@') > 0 or {t} rlike '[(\\\\[]at[)\\\\]]'", "{t} rlike '[0-9]'")
_SPAN = "array<struct<start:int,kind:int,end:int,text:string>>"
_NEAR = "array<struct<start:int,kind:int,end:int,text:string,before:string,after:string>>"
BLOCK = 256
MARK = "\x01"
_CUES = "(?i)mail|phone|tel|call|mobile|fax|card|visa|account|ip|host|server|contact|write"
FEATURES = ("kind", "n", "digits", "dots", "blanks", "dashes", "brackets", "plus", "at", "letters", "runs", "longest", "cue", "glued_before", "glued_after", "quote_before")


def _blocks(n: str) -> str:
    """Numbers from 0 of the blocks of n > 0 entries."""
    return f"sequence(0, cast(({n} - 1) div {BLOCK} as int))"


def _running(lens: str, n: str) -> str:
    """Sums of all entries before each of the n > 0 entries of ``lens``, block by block."""
    append = "(acc, x) -> concat(acc, array(element_at(acc, -1) + x))"
    cut = f"transform({_blocks(n)}, b -> slice({lens}, b * {BLOCK} + 1, {BLOCK}))"
    return (f"aggregate(array({cut}), array(0), (_, blocks) -> flatten(zip_with(slice(aggregate(transform(blocks, x -> aggregate(x, 0, (sum, y) -> sum + y)), "
            f"array(0), {append}), 1, size(blocks)), blocks, (at, x) -> slice(aggregate(x, array(at), {append}), 1, size(x)))))")


def _placed(m: str, g: str, kind: str, context: bool) -> str:
    """Spans of the matches m between the pieces g, with ``context`` also the text around them."""
    n = f"size({m})"
    lens = f"zip_with(slice({g}, 1, {n}), {m}, (x, y) -> length(x) + length(y))"
    near = (f", concat(array(''), slice({m}, 1, {n} - 1)), slice({g}, 2, {n}), concat(slice({m}, 2, {n}), array(''))" if context else "")
    zipped = f"arrays_zip({_running('lens', n)}, slice({g}, 1, {n}), slice({m}, 1, {n}){near})"
    around = ", right(concat(z.`3`, z.`1`), 24) as before, left(concat(z.`4`, z.`5`), 1) as after" if context else ""
    span = f"struct(z.`0` + length(z.`1`) as start, {kind.format(x='z.`2`')} as kind, z.`0` + length(z.`1`) + length(z.`2`) as end, z.`2` as text{around})"
    none = f"cast(array() as {_NEAR if context else _SPAN})"
    # the lambda of aggregate holds the lengths, so that they are evaluated once
    return f"CASE WHEN coalesce({n}, 0) = 0 THEN {none} ELSE aggregate(array({lens}), {none}, (_, lens) -> transform({zipped}, z -> {span})) END"


def _find(df: DataFrame, patterns, needs, kinds, text: str, name: str, context: bool = False) -> DataFrame:
    for i, (p, need) in enumerate(zip(patterns, needs)):
        need = F.expr(need.format(t=f"`{text}`"))
        df = df.withColumns({f"_m{i}": F.when(need, F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0))),
                             f"_g{i}": F.when(need, F.split(F.col(text), p, -1))})
    found = df.withColumn(name, F.expr("concat(" + ", ".join(_placed(f"_m{i}", f"_g{i}", k, context) for i, k in enumerate(kinds)) + ")"))
    return found.drop(*[f"_{x}{i}" for i in range(len(patterns)) for x in "mg"])


_DIGITS = r"regexp_replace(s.text, '[^0-9]', '')"
_LUHN = (f"aggregate(sequence(1, length({_DIGITS})), 0, (sum, i) -> sum + CASE WHEN i % 2 = 1 THEN cast(substring(reverse({_DIGITS}), i, 1) as int) "
         f"ELSE int(cast(substring(reverse({_DIGITS}), i, 1) as int) * 2 / 10) + cast(substring(reverse({_DIGITS}), i, 1) as int) * 2 % 10 END) % 10 = 0")
_VALID = ("filter(_found, s -> CASE s.kind WHEN 0 THEN true "
          "WHEN 1 THEN forall(split(s.text, '[.]'), p -> length(ltrim('0', p)) <= 3 and coalesce(try_cast(p as decimal(38,0)) <= 255, length(ltrim('0', p)) = 0)) "
          f"WHEN 2 THEN length({_DIGITS}) between 14 and 19 and {_LUHN} ELSE length({_DIGITS}) between 10 and 15 END)")


def base_spans(docs: DataFrame, text_col="text") -> DataFrame:
    """``docs`` with ``_base``: spans by start, then kind."""
    found = _find(docs, BASE, _NEED, ("0", "1", "2", "3"), text_col, "_found")
    return found.withColumn("_base", F.expr(f"array_sort({_VALID})")).drop("_found")


def candidates(docs: DataFrame, text_col="text") -> DataFrame:
    """``docs`` (with ``_base``) with ``_wide``: candidates with their features."""
    digits = "length(regexp_replace({x}, '[^0-9]', ''))"
    number = f"CASE WHEN {{x}} rlike '^[0-9]+([.][0-9]+){{{{3}}}}$' THEN 1 WHEN {digits} >= 13 and instr({{x}}, '+') = 0 THEN 2 ELSE 3 END"
    found = _find(docs, WIDE, _WIDE_NEED, ("0", number), text_col, "_found", context=True)

    def count(chars: str) -> str:
        return f"double(length(s.text) - length(regexp_replace(s.text, '[{chars}]', '')))"

    features = {"kind": "double(s.kind)", "n": "double(length(s.text))", "digits": count("0-9"), "dots": count("."), "blanks": count("\\\\x20"),
                "dashes": count("-"), "brackets": count("()"), "plus": count("+"), "at": count("@"), "letters": count("A-Za-z"),
                "runs": "double(size(split(s.text, '[^0-9A-Za-z]+')))", "longest": "double(array_max(transform(split(s.text, '[^0-9A-Za-z]+'), p -> length(p))))",
                "cue": f"double(s.before rlike '{_CUES}')", "glued_before": "double(s.before rlike '[0-9A-Za-z_]$')",
                "glued_after": "double(s.after rlike '[0-9A-Za-z_]')", "quote_before": "double(s.before rlike '[=\"]\\\\s*$')"}
    x = ", ".join(f"{features[k]} as {k}" for k in FEATURES)
    few = "filter(_found, s -> s.kind = 0 or length(regexp_replace(s.text, '[^0-9]', '')) >= 7)"
    # a candidate looks into the blocks of base spans that reach it, not at all of them
    group = f"slice(_base, b * {BLOCK} + 1, {BLOCK})"
    groups = (f"CASE WHEN size(_base) = 0 THEN array() ELSE transform({_blocks('size(_base)')}, b -> struct({group} as spans, "
              f"array_min(transform({group}, x -> x.start)) as start, array_max(transform({group}, x -> x.end)) as end)) END")
    near = "filter(groups, g -> g.start < s.end and s.start < g.end)"
    wide = (f"aggregate(array({groups}), cast(null as {{type}}), (_, groups) -> transform({few}, s -> struct(s.start as start, s.kind as kind_no, s.end as end, s.text as text, "
            f"exists({near}, g -> exists(g.spans, b -> b.start < s.end and s.start < b.end)) as taken, "
            f"s.after = char({ord(MARK)}) as planted, struct({x}) as f)))")
    kinds = ",".join(f"{k}:double" for k in FEATURES)
    return found.withColumn("_wide", F.expr(wide.format(type=f"array<struct<start:int,kind_no:int,end:int,text:string,taken:boolean,planted:boolean,f:struct<{kinds}>>>"))).drop("_found")


def _tree_sql(node) -> str:
    if node.subtreeDepth() == 0:
        return repr(float(node.prediction())) + "D"
    s = node.split()
    return f"CASE WHEN w.f.{FEATURES[s.featureIndex()]} <= {float(s.threshold())!r}D THEN {_tree_sql(node.leftChild())} ELSE {_tree_sql(node.rightChild())} END"


def disguised(docs: DataFrame, text_col="text") -> DataFrame:
    """``docs`` with the base spans spelt as no rule finds them, each followed by the sign ``MARK``: an at sign spelt
    out, a card whose last digit is one off, a phone number without its plus. IP addresses stay as they are."""
    found = base_spans(docs.withColumn(text_col, F.translate(text_col, MARK, " ")), text_col)
    found = found.withColumn("_some", F.expr("filter(_base, s -> s.kind <> 1)"))
    other = ("CASE s.kind WHEN 0 THEN replace(s.text, '@', ' [at] ') WHEN 3 THEN substring(s.text, 2) "
             "ELSE concat(left(s.text, length(s.text) - 1), cast((cast(right(s.text, 1) as int) + 1) % 10 as string)) END")
    text = F.expr(_rewritten(f"`{text_col}`", "_some", f"concat({other}, char({ord(MARK)}))"))
    return found.withColumn(text_col, F.when(F.size("_some") > 0, text).otherwise(F.col(text_col))).drop("_base", "_some")


def labelled(docs: DataFrame) -> DataFrame:
    """(w, label) of the candidates of disguised (id, text) rows that overlap no base span, the only ones that are
    ever added; label 1.0: a disguised span."""
    # the outer form: of a plain explode Spark infers a filter that evaluates the candidates once more
    rows = candidates(base_spans(disguised(docs))).select(F.explode_outer("_wide").alias("w")).where("not w.taken")
    return rows.select("w", F.col("w.planted").cast("double").alias("label"))


def calibrate(rows: DataFrame, score: str, precision=PRECISION) -> dict[int, float]:
    """The lowest score of each kind at which at least ``precision`` of the labelled rows are right."""
    levels = rows.select(F.col("w.kind_no").alias("k"), F.expr(f"int(floor({score} * 20))").alias("level"), "label")
    levels = levels.groupBy("k", "level").agg(F.count("*").alias("n"), F.sum("label").alias("hits"))
    cuts, found = {}, sorted(((r["k"], r["level"], r["n"], r["hits"]) for r in levels.collect()), reverse=True)
    for kind in range(len(KINDS)):
        n = hits = 0
        for _, level, more, right in (x for x in found if x[0] == kind):
            n, hits = n + more, hits + right
            if hits >= precision * n:
                cuts[kind] = level / 20
    return cuts


def fit(docs: DataFrame, id_col="doc_id", text_col="text", sample_docs=SAMPLE_DOCS, precision=PRECISION):
    """(SQL expression of a candidate's score, thresholds by kind), or None if nothing can be learned. A quarter
    of the documents, by a hash, is held out and sets the thresholds; the trees see a sample of the others."""
    t = F.col(text_col).cast("string")
    some = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), t.alias("text")).where(t.rlike("[0-9@]"))
    held = F.pmod(F.xxhash64("id", "text"), F.lit(4)) == 0
    n = some.where(~held).count()
    draw = F.pmod(F.xxhash64("id", "text", F.lit("pii")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = labelled(some.where(~held & (draw < min(1.0, sample_docs / n)) if n else F.lit(False))).select("w.f.*", "label").cache()
    try:
        if {r["label"] for r in rows.select("label").distinct().collect()} != {0.0, 1.0}:
            return None
        data = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(rows)
        model = GBTClassifier(featuresCol="x", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=3).fit(data)
    finally:
        rows.unpersist()
    margin = " + ".join(f"{w!r}D * ({_tree_sql(tree._call_java('rootNode'))})" for w, tree in zip(model.treeWeights, model.trees))
    score = f"(1D / (1D + exp(-2D * ({margin}))))"
    return score, calibrate(labelled(some.where(held)), score, precision)


def find_spans(docs: DataFrame, model, text_col="text") -> DataFrame:
    """``docs`` with ``_base`` and ``_spans`` (base and added spans by start, then kind)."""
    df = base_spans(docs, text_col)
    if model is None or not model[1]:
        return df.withColumn("_spans", F.col("_base"))
    score, cuts = model
    df = candidates(df, text_col)
    cut = "CASE w.kind_no " + " ".join(f"WHEN {k} THEN {v!r}D" for k, v in cuts.items()) + " ELSE 2D END"
    added = f"transform(filter(_wide, w -> not w.taken and {score} >= {cut}), w -> struct(w.start as start, w.kind_no as kind, w.end as end, w.text as text))"
    return df.withColumn("_spans", F.expr(f"array_sort(concat(_base, {added}))")).drop("_wide")


def _listed(spans: str) -> str:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return f"array_join(transform({spans}, s -> concat({names}[s.kind], ':', s.start, ':', s.end)), ',')"


def report(docs: DataFrame, model, id_col="doc_id", text_col="text") -> DataFrame:
    found = find_spans(docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")), model)
    counts = [F.expr(f"cast(size(filter(_base, s -> s.kind = {i})) as long)").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select(id_col, *counts, F.expr(f"sha2({_listed('_base')}, 256)").alias("base_sha256"), F.expr(_listed("_spans")).alias("spans"))


def _rewritten(t: str, spans: str, by: str) -> str:
    """Text t with every one of its spans (some, sorted; overlapping ones together) replaced by ``by``."""
    # each block of spans works on its own piece of the text, from the furthest end before it
    ends = (f"aggregate(transform({_blocks(f'size({spans})')}, b -> array_max(transform(slice({spans}, b * {BLOCK} + 1, {BLOCK}), s -> s.end))), array(0), "
            "(acc, x) -> concat(acc, array(greatest(element_at(acc, -1), x))))")
    piece = (f"transform({_blocks(f'size({spans})')}, b -> struct(ends[b] as at, substring({t}, ends[b] + 1, ends[b + 1] - ends[b]) as text, "
             f"slice({spans}, b * {BLOCK} + 1, {BLOCK}) as spans))")
    marked = (f"aggregate(p.spans, struct(p.at as at, cast(array() as array<string>) as out), (acc, s) -> CASE WHEN s.end <= acc.at THEN acc "
              f"WHEN s.start < acc.at THEN struct(s.end as at, acc.out as out) "
              f"ELSE struct(s.end as at, concat(acc.out, array(substring(p.text, acc.at - p.at + 1, s.start - acc.at), {by})) as out) END, acc -> array_join(acc.out, ''))")
    return f"aggregate(array({ends}), '', (_, ends) -> concat(array_join(transform({piece}, p -> {marked}), ''), substring({t}, element_at(ends, -1) + 1)))"


def redact(docs: DataFrame, model, text_col="text") -> DataFrame:
    """``docs`` with every span (overlapping ones together) replaced by its kind in brackets."""
    marks = "array(" + ", ".join(f"'[{k.upper()}]'" for k in KINDS) + ")"
    parts = _rewritten(f"`{text_col}`", "_spans", f"{marks}[s.kind]")
    rows, names = c.shielded(docs, (text_col,))
    found = find_spans(rows, model, text_col)
    safe = found.withColumn(text_col, F.when(F.size("_spans") > 0, F.expr(parts)).otherwise(F.col(text_col)))
    return safe.select(*[f"`{x}`" for x in rows.columns]).withColumnsRenamed(names)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    return report(docs, fit(docs))
