"""Labelled pages for training: layouts of web pages whose parts are known.

A layout puts page parts (header, menus, notices, adverts, article, sidebar, reader comments, forms, footer)
in the orders and with the elements, class names and habits that web pages have: semantic elements or plain
``div``, names or none, tables, unclosed paragraphs, boilerplate inside the article. Each block of text begins
with a mark of its label; the words are given by the caller."""

from __future__ import annotations

import random

from corpuslab.llm.html_blocks import FAMILIES, leaf_blocks

LABELS = ("other", "main", "comment")
_MARKS = "\ue000\ue001\ue002"  # private characters, one a label
_NEUTRAL = "wrapper container inner outer row col left right center x1 css-1q8 block area region block-1 grid".split()


class _Layout:
    def __init__(self, rng: random.Random, words: list[str]):
        self.r, self.words, self.named = rng, words, rng.random() < 0.8

    def say(self, label: int, low: int, high: int, stop=None, inline=0.0) -> str:
        n = self.r.randint(low, high)
        words = [self.r.choice(self.words) for _ in range(n)]
        words[0] = words[0][:1].upper() + words[0][1:]
        for i in range(n - 1):
            x = self.r.random()
            if n > 4 and x < 0.08:
                words[i] += ","
            elif n > 8 and x < 0.15:
                words[i] += "."
                words[i + 1] = words[i + 1][:1].upper() + words[i + 1][1:]
            elif x > 1 - inline:
                t = self.r.choice(["b", "i", "em", "strong", "code", "span", 'a href="/x"'])
                words[i] = f"<{t}>{words[i]}</{t.split()[0]}>"
        text = " ".join(words).replace("&", "&amp;")
        if self.r.random() < (0.85 if stop is None else stop):
            text += self.r.choice(".....!?")
        return _MARKS[label] + text

    def name(self, family: str, always=False) -> str:
        """Attributes that name a part by a word of its family; none on some pages."""
        if not (always or self.named and self.r.random() < 0.85):
            return self.r.choice(["", f' class="{self.r.choice(_NEUTRAL)}"'])
        word = self.r.choice(FAMILIES[family].split())
        if self.r.random() < 0.35:
            beside = self.r.choice([*_NEUTRAL, "main", "content", "site", "page", "post", "list", "box"])
            word = self.r.choice([f"{word}-{beside}", f"{beside}-{word}", f"{word} {beside}", f"{word}_{beside}"])
        return f' {self.r.choice(["class", "class", "id"])}="{word}"'

    def part(self, family: str, element: str, body: str, semantic=0.5) -> str:
        tag = element if element and self.r.random() < semantic else "div"
        return f"<{tag}{self.name(family, always=tag == 'div' and self.r.random() < 0.6)}>{body}</{tag}>"

    def links(self, low=3, high=9) -> str:
        items = [f'<a href="/{i}">{self.say(0, 1, self.r.choice([1, 1, 3, 6]), 0.1)}</a>' for i in range(self.r.randint(low, high))]
        return self.r.choice(["<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", " ".join(f"<span>{x}</span>" for x in items), "".join(f"<p>{x}" for x in items), "<ul>" + "".join(f"<li>{x}" for x in items) + "</ul>"])

    def menu(self) -> str:
        return self.part("nav", "nav", self.links(), 0.6)

    def header(self) -> str:
        inside = self.r.choice([f"<h1>{self.say(0, 1, 4, 0)}</h1>", f'<a href="/">{self.say(0, 1, 3, 0)}</a>', f"<p>{self.say(0, 2, 9)}</p>", ""]) + self.r.choice(["", self.menu()])
        return self.part("head", "header", inside or self.menu())

    def advert(self) -> str:
        return self.part("ad", self.r.choice(["aside", "ins"]), self.r.choice([self.say(0, 2, 25), f"<p>{self.say(0, 3, 30)}</p>", f"<a href='#'>{self.say(0, 2, 10)}</a>"]), 0.2)

    def notice(self) -> str:
        what = self.r.choice(["cookies", "newsletter", "privacy", "subscribe", ""])
        return self.part("notice", self.r.choice(["dialog", "section"]), f"<p>{self.say(0, 4, 40)} {what}</p>" + self.r.choice(["", f"<button>{self.say(0, 1, 3, 0)}</button>"]), 0.2)

    def form(self) -> str:
        rows = "".join(self.r.choice([f"<label>{self.say(0, 1, 4, 0.1)}</label><input>", f"<p>{self.say(0, 2, 20)}</p>", f"<select><option>{self.say(0, 1, 2, 0)}<option>{self.say(0, 1, 2, 0)}</select>", "<textarea>x</textarea>"]) for _ in range(self.r.randint(1, 4)))
        return f"<form{self.name('form')}>{rows}<button>{self.say(0, 1, 2, 0)}</button></form>"

    def sidebar(self) -> str:
        items = [self.r.choice([f"<h3>{self.say(0, 1, 5, 0.1)}</h3>{self.links(2, 6)}", f"<p>{self.say(0, 5, 40)}</p>", self.advert(), f"<div>{self.say(0, 2, 12)}</div>"]) for _ in range(self.r.randint(1, 4))]
        return self.part("side", "aside", "".join(items), 0.6)

    def footer(self) -> str:
        inside = self.r.choice([f"<p>&copy; {self.say(0, 1, 14)}</p>", f"&copy; {self.say(0, 1, 4, 0)} &middot; {' '.join(self.r.choice(self.words) for _ in range(6))}.", f"{self.links(2, 7)}<p>{self.say(0, 2, 25)}</p>"])
        return self.part("foot", "footer", inside, 0.6)

    def comments(self) -> str:
        item = lambda: self.r.choice([f"<p>{self.say(2, 2, 50)}</p>", f"<div><b>{self.say(2, 1, 2, 0)}</b><p>{self.say(2, 2, 50)}</p></div>", f"<p>{self.say(2, 1, 3, 0.1)}</p><p>{self.say(2, 4, 60)}</p>"])
        tag = self.r.choice(["div", "article", "li"])
        body = "".join(f"<{tag}{self.name('comment')}>{item()}</{tag}>" for _ in range(self.r.randint(1, 6)))
        body = f"<ol{self.name('comment')}>{body}</ol>" if tag == "li" else body
        title = f"<{(h := self.r.choice(['h2', 'h3', 'h4', 'div']))}>{_MARKS[2]}{self.r.randint(1, 40)} {self.r.choice(['Comments', 'comments', 'Kommentare', 'Replies', 'Commentaires', 'Comentarios', 'Responses'])}</{h}>"
        if self.r.random() < 0.35:
            title = ""
        word = f' {self.r.choice(["class", "id"])}="{self.r.choice(FAMILIES["comment"].split())}"' if not title or self.r.random() < 0.8 else ""
        return f"<{(t := self.r.choice(['section', 'div']))}{word}>{title}{body}{self.form() if self.r.random() < 0.3 else ''}</{t}>"

    def paragraph(self) -> str:
        x, long = self.r.random(), self.r.choice([(1, 3), (4, 12), (10, 40), (30, 120), (60, 200)])
        if x < 0.72:
            return self.r.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}", "<p><b>{}<br>", "<div>{}</div>"]).format(self.say(1, *long, inline=0.03))
        if x < 0.78:
            h = self.r.randint(2, 4)
            return f"<h{h}>{self.say(1, 1, 9, 0.2)}</h{h}>"
        if x < 0.86:
            tag = self.r.choice(["ul", "ol"])
            return f"<{tag}>" + "".join(f"<li>{self.say(1, 1, 20, 0.5)}</li>" for _ in range(self.r.randint(2, 6))) + f"</{tag}>"
        if x < 0.91:
            return f"<blockquote>{self.say(1, 4, 40)}</blockquote>"
        if x < 0.94:
            return f"<pre>{self.say(1, 3, 30)}\n{' '.join(self.r.choice(self.words) for _ in range(5))}</pre>"
        if x < 0.97:
            return "<table>" + "".join(f"<tr><td>{self.say(1, 1, 3, 0)}<td>{self.say(1, 1, 5, 0)}" for _ in range(self.r.randint(2, 4))) + "</table>"
        return f"<figure><img src=x><figcaption>{self.say(1, 2, 15)}</figcaption></figure>"

    def article(self, comments_inside: str) -> str:
        parts = [f"<h{self.r.choice([1, 1, 1, 2])}>{self.say(1, 1, 14, 0.3)}</h1>"] if self.r.random() < 0.85 else []
        if parts and self.r.random() < 0.15:
            parts = [f"<header>{parts[0]}</header>"]
        parts += [self.paragraph() for _ in range(self.r.choice([1, 2, 4, 8, 14]))]
        for extra in (self.advert, self.form, self.notice, lambda: self.part("share", "", self.links(2, 4)), lambda: self.part("side", "aside", f"<h3>{self.say(0, 1, 4, 0)}</h3>{self.links(2, 5)}"), self.menu):
            if self.r.random() < 0.1:
                parts.insert(self.r.randint(1, len(parts)), extra())
        body = "".join(parts) + comments_inside
        style = self.r.random()
        if style < 0.35:
            return f"<article{self.name('main')}>{body}</article>"
        if style < 0.55:
            return f"<main{self.name('main')}>{self.r.choice(['<article>{}</article>', '<div>{}</div>', '{}']).format(body)}</main>"
        if style < 0.65:
            return f"<table><tr><td{self.name('main')}>{body}</td></tr></table>"
        return f"<div{self.name('main', always=self.r.random() < 0.7)}>{body}</div>"

    def page(self) -> str:
        if self.r.random() < 0.04:  # an article alone
            return "".join(f"<p>{self.say(1, 3, 60)}</p>" for _ in range(self.r.randint(1, 5)))
        has = lambda p: self.r.random() < p
        comments = self.comments() if has(0.45) else ""
        inside = comments if has(0.4) else ""
        top = [x() for x, p in ((self.notice, 0.25), (self.header, 0.5), (self.menu, 0.7), (self.advert, 0.5), (self.form, 0.15)) if has(p)]
        if has(0.3):
            self.r.shuffle(top)
        sides = [self.sidebar()] if has(0.4) else []
        before = sides if has(0.4) else []
        after = [] if before else sides
        tail = [x() for x, p in ((self.advert, 0.2), (self.menu, 0.15), (self.notice, 0.15)) if has(p)]
        end = [self.footer()] if has(0.85) else []
        return "<!DOCTYPE html><html><head><title>t</title></head><body class='post page'>" + "".join([*top, *before, self.article(inside), "" if inside else comments, *after, *tail, *end])


def labelled_pages(words: list[str], n: int, seed: int = 0):
    """(blocks without their marks, labels) of n pages."""
    rng = random.Random(seed)
    for _ in range(n):
        blocks = leaf_blocks(_Layout(rng, words).page())
        labels = [_MARKS.index(next(x for x in b.text if x in _MARKS)) for b in blocks]
        yield [b._replace(text="".join(x for x in b.text if x not in _MARKS).strip() or "x") for b in blocks], labels
