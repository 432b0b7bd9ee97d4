"""The dealt operators against plain versions, on the smallest tables and on odd rows."""

import math
import os
import random
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

from corpuslab.llm import common, ctw, decontam, embed_dedup, langid, minhash, mixing, pii, quality, substring_dedup, suffix_dedup  # noqa: E402

SF = "/root/testdata/sf0.001"


def odd_rows():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    rows = [(1000 + i, " ".join(rng.choice("ab") for _ in range(rng.randint(1, 120)))) for i in range(30)]
    rows += [(2000, "x" * 5000), (2001, None), (2002, ""), (2003, "é" * 300), (2004, " \n\t"), (2005, "one two"), (2006, "One TWO"), (2007, "1234 5678")]
    shared = " ".join(f"common{j}" for j in range(40))
    rows += [(3000 + i, f"{' '.join(f'u{i}w{j}' for j in range(20))} {shared} {' '.join(f'v{i}w{j}' for j in range(20))}") for i in range(40)]
    base = [rng.choice(vocab) for _ in range(150)]
    for i in range(60):  # a large group of near copies with up to 12 edits
        copy = list(base)
        for _ in range(rng.randint(0, 12)):
            copy[rng.randrange(150)] = rng.choice(vocab)
        rows.append((4000 + i, " ".join(copy)))
    rows += [(5000, " ".join(rng.choice(vocab) for _ in range(20_000)))]  # very long
    rows += [(5001 + i, " ".join(base)) for i in range(20)]  # exact copies
    rows += [(6000 + i, "".join(rng.choice("ab1 2.@+-()é😀%\n45") for _ in range(300))) for i in range(40)]
    rows += [(6100, "4111 1111 1111 1111, 1.2.3.4.5.6.7.8 and a@b.c%d@e.f"), (6101, "1" * 5000), (6102, "a" * 9000 + "@"), (6103, "+1 (555) 555-1234 tel")]
    return rows


@pytest.fixture(scope="module")
def rows(spark):
    real = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    return real + odd_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With extra columns whose names operators use themselves."""
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    extra = {k: F.lit(7) for k in ("doc", "block", "id", "n", "s", "h", "v", "part", "word", "held", "kind")}
    return df.withColumns({**extra, "lang": F.lit("en"), "source": F.when(F.col("doc_id") % 3 > 0, F.lit("a"))})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def got(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.mark.parametrize("options", [{}, {"block_bytes": 200_000, "crowd": 10, "block_crowd": 3}])
def test_substring_dedup(docs, rows, options):
    out = substring_dedup.find_removed(docs, **options)
    assert got(out, "doc", "n_words", "n_removed", "kept_sha256") == brute.substring(rows)


@pytest.mark.parametrize("options", [{}, {"block_bytes": 200_000, "crowd": 10, "block_crowd": 3, "batch": 64}])
def test_suffix_dedup(docs, rows, options):
    out = suffix_dedup.find_removed(docs, **options)
    assert got(out, "doc", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.repeated_bytes(rows)


def test_kept_text_agrees(docs):
    out = {r.doc_id: r.text for r in substring_dedup.remove_shared_substrings(docs).collect()}
    assert out[3000].startswith("u0w0") and "common5" in out[3000] and "common5" not in out[3001].split()
    assert suffix_dedup.remove_repeated_bytes(docs).where("doc_id = 2000").first().text == ""


def test_pii_base_spans(docs, rows):
    out = {r[0]: tuple(r)[1:6] for r in pii.report(docs, None).collect()}
    assert {d: brute.personal(t) for d, t in rows} == out


def test_pii_model_adds_and_redacts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = pii.fit(docs)
    for r in pii.report(docs, model).collect():
        assert len([x for x in r.spans.split(",") if x]) >= r.n_email + r.n_ip + r.n_card + r.n_phone
    assert pii.redact(docs, model).columns == docs.columns
    text = spark.createDataFrame([(1, "é 😀 a@b.cd or +1 (555) 555-1234!"), (2, None)], "doc_id long, text string")
    assert [r.text for r in pii.redact(text, None).orderBy("doc_id").collect()] == ["é 😀 [EMAIL] or [PHONE]!", None]


@pytest.mark.parametrize("block", [2 << 20, 1500])
def test_decontamination(spark, docs, rows, block):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text")
    items = [(r.item_id, r.text) for r in bench.collect()] + [(900, "One two"), (901, None), (902, ""), (903, "one two")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontam.contamination(docs, bench, block_bytes=block)
    assert got(out, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == brute.contamination(rows, items)
    spans = {r.doc_id: r.hit_spans for r in out.where("doc_id in (2005, 2007)").collect()}
    assert spans == {2005: "0:7", 2007: ""}
    clean = {r.doc_id for r in decontam.drop_contaminated(docs, bench).select("doc_id").collect()}
    assert clean == {x[0] for x in brute.contamination(rows, items) if not x[5]}


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs)
    out = langid.identify(docs, model).where(langid.fold("doc_id", langid.FOLDS) == 0).toPandas()
    assert (out["lang"] == out["_lang_pred"]).mean() > 0.97
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (4, "the")], "doc_id long, text string")
    found = {r.doc_id: (r._lang_pred, r._score) for r in langid.identify(odd, model).collect()}
    assert all(found[i] == ("und", 0.0) for i in (1, 2, 3)) and found[4][0] in model.classes
    assert {r.doc_id for r in langid.reject_unknown(odd, model, min_score=0.0).collect()} == {4}
    assert langid.fit(docs.where("false")) is None


def test_language_gradients():
    net = langid.ByteCnn(["a", "b"])
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 256, (3, langid.WINDOW)).astype(np.uint8), np.array([0, 1, 1])

    def loss():
        p = net.predict(x, {w: t for w, t in net.tables().items()})
        return -np.log(p[np.arange(3), y]).mean()

    grad = net.step(x, y)
    for name, at in (("V", (3, 1)), ("W3", (5, 2)), ("b2", (1,))):
        old = net.p[name][at]
        net.p[name][at] = old + 1e-3
        up = loss()
        net.p[name][at] = old - 1e-3
        down = loss()
        net.p[name][at] = old
        assert abs((up - down) / 2e-3 - grad[name][at]) < 5e-3


def test_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = quality.classify(docs, labels).withColumnRenamed("id", "doc_id").join(labels, "doc_id").where("held_out").toPandas()
    assert (out["predicted"] == out["quality"]).mean() > 0.9
    odd = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [r.score for r in quality.classify(odd, labels.where("false")).collect()] == [0.5, 0.5]


def test_language_model_base(docs, rows):
    out = ctw.score(docs, block_bytes=200_000)
    mine = sorted((r[0], r[1], r[2], r[3], r[4], round(r[5], 5)) for r in out.select("doc", "held_out", "n_tokens", "n_known", "train_tokens", "base_score").collect())
    want = brute.base_lm(rows)
    assert [x[:5] for x in mine] == [x[:5] for x in want]
    assert all(abs(a[5] - b[5]) < 1e-3 for a, b in zip(mine, want))


def test_context_tree_weighting_is_exact():
    from math import lgamma, log, pi

    def weighted(a, b, depth):
        kt = lgamma(sum(a) + 0.5) + lgamma(sum(b) + 0.5) - lgamma(sum(a) + sum(b) + 1) - log(pi)
        if not depth:
            return np.exp(kt)
        h = len(a) // 2
        return 0.5 * np.exp(kt) + 0.5 * weighted(a[:h], b[:h], depth - 1) * weighted(a[h:], b[h:], depth - 1)

    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 6, 8).astype(float), rng.integers(0, 6, 8).astype(float)
    a[3] = b[3] = 0
    p = ctw._decision(a, b, 3)
    for k in range(8):
        more = b.copy()
        more[k] += 1
        assert abs(p[k] - weighted(list(a), list(more), 3) / weighted(list(a), list(b), 3)) < 1e-9
    counts = np.zeros((4, 256))
    counts[1, 65:70] = 9
    assert np.allclose((10.0 ** ctw.code_table(counts, 2).astype(float)).sum(1), 1, atol=1e-5)


def _vectors():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 16))
    x[100:160] = x[0] + 0.12 * rng.normal(size=(60, 16))  # a large group
    x[160:170] = x[1]  # copies
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    return rows + [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [None] + [1.0] * 15), (905, [1.0, 2.0]), (906, [2.0, 4.0]), (None, [1.0] * 16)]


def test_embedding_dedup(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "PIECE", 64)
    monkeypatch.setattr(embed_dedup, "HALO", 16)
    monkeypatch.setattr(embed_dedup, "BLOCK", 32)
    rows = _vectors()
    out = embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(out) == len(rows)
    good = {i: np.array(v) for i, v in rows if i is not None and (i < 900 or i > 904)}
    links = [(a, b) for a in good for b in good if a < b and len(good[a]) == len(good[b])
             and good[a] @ good[b] / np.sqrt((good[a] @ good[a]) * (good[b] @ good[b])) >= 0.9]
    root = brute.roots([i for i, _ in rows if i is not None], links)
    mine = {r.id: r for r in out}
    assert all(mine[i].component_id == root[i] and mine[i].kept == (root[i] == i) for i in root)
    assert all(mine[i].n_links == sum(i in p for p in links) for i in root)
    assert embed_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("small,piece", [(32, 512), (2, 8)])
def test_minhash(docs, rows, monkeypatch, small, piece):
    monkeypatch.setattr(minhash, "SMALL", small)
    monkeypatch.setattr(minhash, "PIECE", piece)
    out = minhash.near_duplicates(docs)
    assert got(out, "doc", "n_shingles", "component_id", "kept") == brute.near(rows)
    kept = {r.doc_id for r in minhash.keep_one(docs).select("doc_id").collect()}
    assert kept == {d for d, _, _, k in brute.near(rows) if k}


def test_embedding_dedup_meets_isolated_links_of_a_large_table(spark, monkeypatch):
    """Windows of a small piece stand for a table of many pieces: 1,500 planted links, no other ones."""
    for name, value in {"PIECE": 8, "HALO": 2, "BLOCK": 16}.items():
        monkeypatch.setattr(embed_dedup, name, value)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(6000, 64))
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    side = rng.normal(size=(1500, 64))
    side -= (side * x[:1500]).sum(1, keepdims=True) * x[:1500]
    side /= np.sqrt((side * side).sum(1, keepdims=True))
    x[1500:3000] = 0.905 * x[:1500] + (1 - 0.905**2) ** 0.5 * side
    out = embed_dedup.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    lost = 1500 - sum(r.component_id == r.id - 1500 for r in out if 1500 <= r.id < 3000)
    assert lost <= 1, f"{lost} of 1500 links lost"


def near_pairs(percents, sizes, per_cell):
    """Pairs of documents, the second with e shingles more: their similarity is in [percents)."""
    rng, rows = random.Random(11), []
    for m in sizes:
        for e in range(1, m):
            if percents[0] * (m + e) <= 100 * m < percents[1] * (m + e):
                for _ in range(per_cell):
                    words = [f"w{rng.getrandbits(40)}" for _ in range(m + e + 4)]
                    rows += [(len(rows), " ".join(words[: m + 4])), (len(rows) + 1, " ".join(words))]
    return rows


def test_minhash_short_documents(spark):
    rows = near_pairs((85, 92), range(33, 61), 8)
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    lost = [r.doc for r in out.collect() if r.component_id != r.doc - r.doc % 2]
    assert len(rows) > 800 and not lost, f"{len(lost)} of {len(rows) // 2} links lost"


def test_near_copies_leave_the_pipeline_from_80(spark):
    import corpus_pipeline

    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    rows = near_pairs((80, 85), [*range(20, 61, 4), 300], 1)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(rows) > 40 and {r.doc_id for r in stage(spark, df, SF).collect()} == {d for d, _ in rows if d % 2 == 0}
    assert minhash.near_duplicates(df).where("not kept").count() == 0
    apart = spark.createDataFrame(near_pairs((75, 80), range(20, 61, 8), 1), "doc_id long, text string")
    assert stage(spark, apart, SF).count() == apart.count()


def test_mixing(spark, docs, rows):
    out = mixing.replicate(docs)
    a = got(out, "doc_id", "_copy", "_place")
    assert a == got(mixing.replicate(docs.repartition(3), broadcast_rows=0), "doc_id", "_copy", "_place")
    assert set(docs.columns) <= set(out.columns) and len(set(a)) == len(a)
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 10 == 0, "x").otherwise(F.lit("y")).alias("source"))
    n = {r["source"]: r["count"] for r in mixing.replicate(many).groupBy("source").count().collect()}
    share = 2000**0.5 / (2000**0.5 + 18000**0.5)
    assert abs(n["x"] / (20_000 * share) - 1) < 0.05 and abs(n["y"] / (20_000 * (1 - share)) - 1) < 0.05
    few = mixing.replicate(many.where("source = 'x'"), rows=4000).groupBy("doc_id").count().groupBy("count").count().collect()
    assert max(r["count"] for r in few) > 4  # Poisson with mean 2


def test_null_ids_and_repeats(spark):
    text = " ".join(f"t{i}" for i in range(60))
    df = spark.createDataFrame([(None, text), (1, text), (1, text), (2, None)], "doc_id long, text string")
    out = {(r.doc, r.n_removed) for r in substring_dedup.find_removed(df).collect()}
    assert out == {(common.NULL_ID, 60), (1, 0), (2, 0)}
    assert {r.n_removed for r in suffix_dedup.find_removed(df).where("doc <> 2").collect()} == {len(text)}
    assert {(r.doc, r.component_id) for r in minhash.near_duplicates(df).collect()} == {(common.NULL_ID, 1), (1, 1), (2, 2)}
    assert {r.n_tokens for r in ctw.score(df).collect()} == {61, 1}


def test_empty_tables(spark, empty):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert substring_dedup.find_removed(empty).count() == 0
    assert suffix_dedup.find_removed(empty).count() == 0
    assert pii.report(empty, pii.fit(empty)).count() == 0
    assert decontam.contamination(empty, bench).count() == 0
    assert langid.identify(empty, langid.fit(empty)).count() == 0
    assert ctw.score(empty).count() == 0
    assert mixing.replicate(empty).count() == 0
    assert minhash.near_duplicates(empty).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 300), (300, 200), (7, 7), (50, 51), (51, 50)]
    out = {r.id: r.component for r in common.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert out == {**{i: 0 for i in range(41)}, 100: 100, 200: 100, 300: 100, 50: 50, 51: 50}


def test_pipeline_keeps_columns_and_decides(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert set(out.columns) == {*docs.columns, "copy", "place"} and out.count() > 0
    assert "[" in "".join(r.text for r in out.collect())
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    bad = {r.doc_id for r in decontam.contamination(docs, bench).where("contaminated").collect()}
    assert not bad & {r.doc_id for r in out.select("doc_id").collect()}


def test_mixing_oracle(spark):
    from oracle_check import check

    assert check(spark, ["op8_mixing"], SF, verbose=False) == {"op8_mixing": "OK"}


def test_pii_many_matches(spark):
    """Spans beyond several blocks, overlapping ones too, equal the base rules and a plain redaction."""
    rng = random.Random(6)
    bits = ["é 😀", "x.y@z.de", "10.0.0.{}", "4111 1111 1111 1111", "+49 30 55{}", "no {}", "+1 (555) 123-4567.", "a@b.c.d@e.f", "\n\n"]
    texts = [(i, " ".join(rng.choice(bits).format(rng.randint(1000, 99999)) for _ in range(n))) for i, n in enumerate((0, 1, 255, 256, 257, 513, 3000))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    everything = ("0.95D", {k: 0.5 for k in range(4)})  # a model that takes every candidate
    base = {r[0]: tuple(r)[1:6] for r in pii.report(docs, None).collect()}
    spans = {r.doc_id: [x.split(":") for x in r.spans.split(",") if x] for r in pii.report(docs, everything).collect()}
    redacted = {r.doc_id: r.text for r in pii.redact(docs, everything).collect()}
    for i, text in texts:
        assert base[i] == brute.personal(text)
        out, at = [], 0
        for kind, start, end in sorted(((k, int(a), int(b)) for k, a, b in spans[i]), key=lambda x: (x[1], pii.KINDS.index(x[0]), x[2])):
            if end <= at:
                continue
            if start >= at:
                out += [text[at:start], f"[{kind.upper()}]"]
            at = end
        assert redacted[i] == "".join(out) + text[at:]
    assert sum(base[6][:4]) > 2 * pii.BLOCK


def test_pii_thresholds_come_from_spans_that_no_rule_finds(spark):
    """Labels are disguised spans among the candidates that can be added; the model finds such spans elsewhere."""
    some = spark.createDataFrame([("1", "mail a@b.cd, card 4111 1111 1111 1111 and +49 30 5551234; 10.0.0.1\x01 no 1234567890"), ("2", None), ("3", "plain")], "id string, text string")
    text = {r["id"]: r.text for r in pii.disguised(some).collect()}
    assert text == {"1": "mail a [at] b.cd\x01, card 4111 1111 1111 1112\x01 and 49 30 5551234\x01; 10.0.0.1  no 1234567890", "2": None, "3": "plain"}
    got = [(r.w.text, r.label) for r in pii.labelled(some).collect()]
    assert sorted(got) == [("1234567890", 0.0), ("4111 1111 1111 1112", 1.0), ("49 30 5551234", 1.0), ("a [at] b.cd", 1.0)]
    model = pii.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert model is not None and 0 in model[1]
    new = spark.createDataFrame([(1, "write to anna.k [at] example.org today"), (2, "a line of 12 words and 3 numbers")], "doc_id long, text string")
    assert [r.spans for r in pii.report(new, model).orderBy("doc_id").collect()] == ["email:9:32", ""]  # the text from anna.k to org


def test_deep_contexts_are_weighted_trees():
    """deep_scores against a recursion over the nodes of one context's tree; probabilities of all bytes sum to 1."""
    rng = np.random.default_rng(4)
    texts = [bytes(rng.choice([97, 98, 99], 300).astype(np.uint8)) for _ in range(3)]
    train = np.array([True, True, False])
    keys, n = ctw.gram_counts(texts, train)
    assert n.sum() == 2 * 301 and (n == 0).any()
    counts = np.zeros(1 << 24)
    code, real, _ = ctw._coded(texts[:2])
    np.add.at(counts, code[real], 1)
    table = ctw.code_table(counts.reshape(1 << 16, 256))
    got = ctw.deep_scores(keys, n, table)
    plain = [(int(k).to_bytes(ctw.REACH + 1, "big"), int(m)) for k, m in zip(keys, n)]

    def ab(context, low, mid, high):
        rows = [(k[-1], m) for k, m in plain if k.startswith(context) and low <= k[-1] < high]
        return sum(m for x, m in rows if x < mid), sum(m for x, m in rows if x >= mid)

    def weighted(context, *span):
        kt = math.exp(ctw._estimates(*(np.array([float(v)]) for v in ab(context, *span)))[0][0])
        if len(context) == ctw.REACH:
            return kt, kt, 1.0
        split = math.prod(weighted(context + bytes([x]), *span)[0] for x in {k[len(context)] for k, _ in plain if k.startswith(context)})
        return (kt + split) / 2, kt, kt / (kt + split)

    def decision(context, low, high):
        mid, share = (low + high) // 2, 10.0 ** table[context[0] * 256 + context[1]].astype(float)
        top = share[mid:high].sum() / share[low:high].sum()
        a, b = ab(context[:3], low, mid, high)
        rest = 1 / (1 + (1 - top) ** a * top**b / weighted(context[:3], low, mid, high)[0])
        p = (1 - rest) * top
        for d in range(3, ctw.REACH + 1):
            a, b = ab(context[:d], low, mid, high)
            own = weighted(context[:d], low, mid, high)[2]
            p, rest = p + rest * own * (b + 0.5) / (a + b + 1), rest * (1 - own)
        return p

    for i in range(0, len(plain), 41):
        context, x, low, high, want = plain[i][0][:-1], plain[i][0][-1], 0, 256, 0.0
        while high - low > 1:
            p, mid = decision(context, low, high), (low + high) // 2
            want += math.log10(p if x >= mid else 1 - p)
            low, high = (mid, high) if x >= mid else (low, mid)
        assert math.isclose(got[i], want, abs_tol=1e-9)
    whole = np.unique(np.concatenate([keys, (keys[5] & ~np.uint64(255)) | np.arange(256, dtype=np.uint64)]))
    full = ctw.deep_scores(whole, np.isin(whole, keys) * np.r_[n, 0][np.minimum(np.searchsorted(keys, whole), len(n))], table)
    assert math.isclose((10.0 ** full[whole >> np.uint64(8) == keys[5] >> np.uint64(8)]).sum(), 1, abs_tol=1e-6)


def test_score_reads_beyond_two_bytes(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice(["aXXX1", "bXXX2"]) for _ in range(60))) for i in range(60)]
    rows += [(1000, "aXXX1" * 50), (1001, "aXXX2" * 50)]
    got = {r.doc_id: r.score for r in ctw.score(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=4000).withColumnRenamed("doc", "doc_id").collect()}
    assert len(got) == 62 and got[1000] > got[1001] + 30
