"""Labelled pages for the block model: page parts in many markups, filled with made-up words.

Every part says in a ``data-main`` attribute whether its blocks belong to the article; the features do not see it.
"""

from __future__ import annotations

import random

SYLLABLES = "ka lo mi ter sen du pra vel on ri shi an ber co de fu gal hin ist jor".split()


class PageMaker:
    """Makes pages from a seed; the same seed makes the same pages."""

    def __init__(self, seed: int):
        self.random = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        r = self.random
        return " ".join("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 3))) for _ in range(r.randint(low, high)))

    def sentence(self, low: int = 4, high: int = 25) -> str:
        return self.words(low, high).capitalize() + self.random.choice("...!?")

    def prose(self, most: int) -> str:
        return " ".join(self.sentence() for _ in range(self.random.randint(1, most)))

    def links(self, n: int) -> str:
        return "".join(f'<li><a href="/{i}">{self.words(1, 3)}</a></li>' for i in range(n))

    def article(self) -> str:
        r = self.random
        tag, extra = r.choice([("article", ""), ("article", ' class="post"'), ("main", ""), ("div", ' class="content"'),
                               ("div", ' id="article-body"'), ("section", ' class="entry-content"'), ("div", ' role="main"')])
        parts = [f"<h1>{self.words(3, 12)}</h1>"] if r.random() < 0.9 else []
        for _ in range(r.randint(2, 9)):
            kind = r.random()
            if kind < 0.62:
                parts.append(f"<p>{self.prose(5)}</p>")
            elif kind < 0.72:
                parts.append(f"<p><b>{self.sentence(1, 8)}<br>")
            elif kind < 0.80:
                parts.append(f"<p>{self.words(1, 2).capitalize()}.</p>")
            elif kind < 0.86:
                parts.append(f"<h2>{self.words(2, 7)}</h2>")
            elif kind < 0.92:
                parts.append("<ul>" + "".join(f"<li>{self.sentence()}</li>" for _ in range(3)) + "</ul>")
            elif kind < 0.96:
                parts.append(f'<p>{self.sentence()} <a href="/x">{self.words(1, 4)}</a> {self.sentence()}</p>')
            else:
                parts.append(f"<blockquote>{self.prose(2)}</blockquote>")
        return f'<{tag}{extra} data-main="1">{"".join(parts)}</{tag}>'

    def rest(self) -> str:
        r = self.random
        prose = self.prose(2)
        return r.choice([
            lambda: f'<nav data-main="0"><ul>{self.links(r.randint(3, 8))}</ul></nav>',
            lambda: f'<ul class="menu" data-main="0">{self.links(r.randint(3, 8))}</ul>',
            lambda: f'<header data-main="0"><p>{self.words(1, 6)}</p><a href="/">{self.words(1, 2)}</a></header>',
            lambda: f'<div class="ad" data-main="0">{prose}</div>',
            lambda: f'<div class="{r.choice(["advert", "banner", "promo", "sponsored"])}" data-main="0"><p>{prose}</p></div>',
            lambda: f'<aside data-main="0"><h3>{self.words(1, 3)}</h3><p>{prose}</p><ul>{self.links(3)}</ul></aside>',
            lambda: f'<div class="sidebar" data-main="0"><h3>{self.words(1, 3)}</h3><p>{prose}</p></div>',
            lambda: f'<div class="{r.choice(["cookie-notice", "notice", "alert", "consent"])}" data-main="0">{prose}</div>',
            lambda: f'<form data-main="0"><label>{self.words(1, 3)}</label><input><button>{self.words(1, 2)}</button><p>{self.sentence()}</p></form>',
            lambda: f'<div class="related" data-main="0"><h3>{self.words(1, 3)}</h3><ul>{self.links(4)}</ul></div>',
            lambda: f'<div class="breadcrumb" data-main="0"><a href="/">{self.words(1, 1)}</a> &gt; <a href="/a">{self.words(1, 2)}</a></div>',
            lambda: f'<div class="share" data-main="0"><a href="#">{self.words(1, 1)}</a> <a href="#">{self.words(1, 1)}</a></div>',
        ])()

    def comments(self) -> str:
        r = self.random
        tag, name = r.choice([("section", "comments"), ("div", "comment-list"), ("ol", "comments"), ("div", "discussion")])
        each = "".join(f'<div class="comment"><p>{self.prose(3)}</p></div>' for _ in range(r.randint(1, 5)))
        return f'<{tag} {r.choice(["class", "id"])}="{name}" data-main="0"><h3>{self.words(1, 2)}</h3>{each}</{tag}>'

    def footer(self) -> str:
        text = f"&copy; {self.words(1, 3)} &middot; {self.sentence()}"
        return self.random.choice([f'<footer data-main="0">{text}</footer>', f'<footer data-main="0"><p>{text}</p></footer>',
                                   f'<div id="footer" data-main="0"><p>{text}</p></div>'])

    def page(self) -> str:
        r = self.random
        before = "".join(self.rest() for _ in range(r.randint(1, 4)))
        after = "".join(self.rest() for _ in range(r.randint(0, 3)))
        article = self.article()
        if r.random() < 0.3:  # something foreign inside the article
            at = article.find("<p>", len(article) // 2)
            if at > 0:
                article = article[:at] + self.rest() + article[at:]
        talk = self.comments() if r.random() < 0.5 else ""
        if talk and r.random() < 0.3:
            cut = article.rindex("</")
            article, talk = article[:cut] + talk + article[cut:], ""
        body = before + article + talk + after + self.footer() * (r.random() < 0.9)
        if r.random() < 0.4:
            body = f'<div class="{r.choice(["page", "wrapper", "container", "site"])}">{body}</div>'
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title></head><body>{body}</body></html>"


def labelled_pages(n: int, seed: int) -> list[str]:
    maker = PageMaker(seed)
    return [maker.page() for _ in range(n)]
