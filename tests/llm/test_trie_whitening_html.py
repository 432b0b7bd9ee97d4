"""Conversation tries, whitening and page extraction against plain versions and on odd rows."""

import hashlib
import html
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslab.llm import conversation_trie, html_blocks, html_extraction, html_layouts, whitening

SF = "/root/testdata/sf0.001"
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]


def plain_trie(rows):
    conv = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            conv[c].append(((turn is not None, turn or 0), hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    conv = {c: [x[2:] for x in sorted(v)] for c, v in conv.items()}
    built = {}
    for c, v in conv.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(conv.get(c - int(math.fmod(c, 20)), [])[:h] + v[h:])
    members, children = defaultdict(list), Counter()
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
            leaves[p[:d]] += not children[p]
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def odd_conversations():
    rng = random.Random(3)
    rows = [(None, 0, "user", "nobody"), (-41, 1, "user", "below zero"), (-40, None, None, None), (-40, 2, "a", "b"), (7, 5, "x", "tie"), (7, 5, "x", "tie"), (7, 5, "a", "tie"), (7, None, "s", "first")]
    for c in range(100, 400):  # copies of few beginnings, many endings
        n = rng.randint(0, 6)
        rows += [(c, t, "user", f"turn {t} {'common' if rng.random() < 0.8 else rng.randint(0, 5)} words") for t in range(n)]
    rows += [(500 + c, t, "user", "same thing") for c in range(40) for t in range(3)]  # copies
    rows += [(900 + c, t, "a", f"long {t}" if t < 150 + c else f"own {c}") for c in range(5) for t in range(160)]
    return rows


@pytest.fixture(scope="module")
def conversations(spark):
    real = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows = real + odd_conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    return df.withColumns({k: F.lit(1) for k in ("node", "at", "seq", "words", "n", "key", "head", "donor")}), rows


@pytest.mark.parametrize("limit", [1, 40, conversation_trie.CONTAINER])
def test_trie_nodes(conversations, limit):
    df, rows = conversations
    nodes, ends = conversation_trie.trie(conversation_trie.rebuilt(conversation_trie.sequences(df)), limit)
    want = plain_trie(rows)
    assert sorted((tuple(r) for r in nodes.select(*NODE).collect()), key=str) == sorted((x[:7] for x in want), key=str)
    digests = {bytes(r.key): r.sha for r in conversation_trie.end_digests(ends).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    got = sorted(((r.conv_id, r.depth, digests.get(bytes(r.node), empty)) for r in nodes.collect()), key=str)
    assert got == sorted(((x[0], x[1], x[7]) for x in want), key=str)


def test_trie_query_and_empty_table(spark, conversations, tmp_path):
    df, rows = conversations
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    assert sorted((tuple(r) for r in conversation_trie.query(spark, str(tmp_path)).collect()), key=str) == plain_trie(rows)
    df.where("false").write.parquet(str(tmp_path / "none" / "conversations.parquet"))
    assert conversation_trie.query(spark, str(tmp_path / "none")).count() == 0


def test_trie_turns_name_the_nodes(conversations):
    df, _ = conversations
    nodes, _ = conversation_trie.trie(conversation_trie.sequences(df), 30)
    texts = conversation_trie.turns(df).select("turn", "role", "text").distinct()
    named = {r.text for r in nodes.join(texts, "turn").where("conv_id = 900").collect()}
    assert {"long 0", "long 149", "own 0"} <= named


def plain_whitening(vectors):
    x = np.floor(256 * np.array(vectors, dtype=float)).astype(np.int64)
    once = np.unique(x, axis=0)
    n, s = len(once), once.sum(0)
    centred = once - s / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    k = min(4, int((e > 1e-9 * e[0]).sum()))
    return n, ((n * x - s) ** 2).sum(1), (x - s / n) @ v[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def test_whitening(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    rows += [(10_000 + i, rows[3][1]) for i in range(200)] + [(3, rows[4][1]), (None, rows[5][1])]  # a hot vector, a repeated id, a null id
    bad = [(20_000, None), (20_001, [1.0, None] + [0.0] * 62), (20_002, [float("nan")] * 64), (20_003, [float("inf")] + [0.0] * 63)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumns({k: F.lit(2) for k in ("i", "x", "id", "v", "n", "whitened")})
    out = whitening.whiten(df).collect()
    n, deviation, white, share = plain_whitening([v for _, v in rows])
    got = defaultdict(list)
    for r in out:
        got[r.id].append(r)
    assert sum(map(len, got.values())) == len(rows) and not set(got) & {b[0] for b in bad}
    first = np.array(got[rows[0][0]][0].whitened)
    sign = np.sign(first * white[0])
    for (i, _), d, w in zip(rows, deviation.tolist(), white):
        assert any(r.deviation == d and r.n == n and np.allclose(np.array(r.whitened) * sign, w, atol=1e-9) for r in got[i])
    assert np.allclose(out[0].explained, share, rtol=1e-9) and 0 <= out[0].identity_error < 1e-9


def test_whitening_odd_tables(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for rows in ([], [(1, [])], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert whitening.whiten(make(rows)).count() == 0
    ragged = whitening.whiten(make([(1, [1.0, 2.0]), (2, [3.0]), (3, []), (4, [1.0, 2.5])])).collect()
    assert sorted(r.x for r in ragged) == [[0, 0], [256, 512], [256, 640], [768, 0]] and len(ragged[0].whitened) == 2
    wide = whitening.whiten(make([(1, [1e300]), (2, [0.0])])).collect()
    assert [r.deviation for r in wide] == [None, None] and len(wide) == 2


def test_negative_zero_and_floor(spark):
    x = whitening.scaled(spark.createDataFrame([(1, [-0.0, -0.001, 0.999, 1 / 256])], "vec_id long, embedding array<double>"))[0].first().x
    assert x == [0, -1, 255, 1]


@pytest.fixture(scope="module")
def field(spark):
    return html_extraction.fit(spark.read.parquet(f"{SF}/pages.parquet"))


def article_text(page):
    part = page[page.index("<article>") + 9 : page.index("</article>")]
    part = re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)>", " ", part))
    return " ".join(html.unescape(part).split())


def test_html_query_against_the_articles(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    out = html_extraction.query(spark, SF).collect()
    assert len(out) == len(pages)
    for r in out:
        assert r.text == article_text(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_html_held_out_layouts(field):
    blocks = right = pages = whole = 0
    for b, y in html_layouts.labelled_pages(html_extraction.OWN_WORDS, 300, seed=77):
        same = [(p == html_extraction.MAIN) == (q == html_extraction.MAIN) for p, q in zip(y, html_extraction.decode(field, b))]
        blocks, right, pages, whole = blocks + len(same), right + sum(same), pages + 1, whole + all(same)
    assert right / blocks > 0.98 and whole / pages > 0.85


PAGE = """<body><header><h1>Site</h1><nav><a href=/>Home</a> <a href=/n>News</a></nav></header><div class="cookie-notice">We use cookies to make this site better for you. <button>Accept</button></div>
<div id="content"><h1>Title&nbsp;here</h1><p>First para&shy;graph with <b>bold</b>ness, and a <a href=x>link</a> in it.<p>Short.<ul><li>One item<li>Two items</ul>
<div class="ad">Buy now, cheap things for everyone.</div><p>Tom &amp; Jerry, 1 &lt; 2, went on to say much more about the matter at hand.</p>
<form><label>Mail</label><input><p>Sign up for our letter today.</p></form></div><aside class="sidebar"><h3>Related</h3><a href=q>Other story</a></aside>
<section id="comments"><h3>2 Comments</h3><p>Great article, I liked it very much, thanks for writing it.</p></section><footer>&copy; 2024 Site. All rights reserved.</footer>"""


def test_html_parts_of_a_page(field):
    blocks = html_blocks.leaf_blocks(PAGE)
    text = " ".join(b.text for b, y in zip(blocks, html_extraction.decode(field, blocks)) if y == html_extraction.MAIN)
    assert text == "Title here First para\xadgraph with boldness, and a link in it. Short. One item Two items Tom & Jerry, 1 < 2, went on to say much more about the matter at hand."


def test_html_odd_rows(spark, field):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "just some words, without any markup at all."), (3, "u", "<p"), (4, "u", "<script>var a = '<p>x</p>'"), (5, "u", PAGE), (5, "u", PAGE), (6, "u", "<article><p>" + "word " * 300_000 + "</p></article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({k: F.lit(1) for k in ("text", "n_chars", "id", "block")})
    out = html_extraction.extract(df, field).collect()
    by = {(r.page_id, r.url): r for r in out}
    assert len(out) == len(rows) and by[(1, "u")].text == by[(2, None)].text == by[(3, "u")].text == by[(4, "u")].text == ""
    assert by[(None, "u")].text.startswith("just some") and by[(6, "u")].n_chars == 5 * 300_000 - 1
    assert sum(r.page_id == 5 and r.n_chars > 100 for r in out) == 2
    assert html_extraction.extract(df.where("false"), html_extraction.fit(df.where("false"))).count() == 0
    assert html_extraction.label_blocks(df.where("page_id = 5"), field).where("label = 'comment'").count() >= 2


@pytest.mark.parametrize("part", ["<a ", '<p a="', "<svg>", "<b></i>", "<li>", "<b><li>", "<!--", "< ", "&amp", "<div><td>", "<ul><li><ul><b><li></li>"])
def test_html_pass_is_linear(part):
    took = []
    for n in (30_000, 60_000):
        start = time.process_time()
        html_blocks.features(html_blocks.leaf_blocks(part * n))
        took.append(time.process_time() - start)
    assert took[1] < 3.2 * took[0] + 0.3
