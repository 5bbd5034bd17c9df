"""Labelled pages for training: built from layouts that sites use, the main text marked by the attribute data-main."""

from __future__ import annotations

import random

# Words of the invented text, and names that sites give to the parts of a page.
VOCABULARY = (
    "time river stone market people garden window letter winter history music village paper light morning road teacher summer island "
    "story voice family mountain question water country student answer silver number forest doctor bridge"
).split()
CONTENT_NAMES = ("content", "post", "entry-content", "article-body", "main-content", "story", "text", "post-body", "page-content")
AD_NAMES = ("ad", "ads", "advert", "advertisement", "banner", "sponsored", "promo", "ad-slot")
NOTICE_NAMES = ("cookie", "cookie-notice", "consent", "gdpr-banner", "notice", "alert", "popup", "modal")
SIDE_NAMES = ("sidebar", "side", "widget", "related", "recommended", "trending", "popular")
MENU_NAMES = ("menu", "nav", "navigation", "navbar", "breadcrumb", "topbar", "links", "tags", "share", "social")
COMMENT_NAMES = ("comments", "comment-list", "responses", "discussion", "replies", "disqus")


class _Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, least: int, most: int) -> str:
        return " ".join(self.r.choice(VOCABULARY) for _ in range(self.r.randint(least, most)))

    def sentences(self, least: int, most: int) -> str:
        return " ".join(self.words(4, 18).capitalize() + self.r.choice((".", ".", ".", "!", "?")) for _ in range(self.r.randint(least, most)))

    def named(self, tag: str, names: tuple[str, ...], inner: str) -> str:
        return f'<{tag} {self.r.choice(("class", "id"))}="{self.r.choice(names)}">{inner}</{tag}>'

    def links(self, n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/x">{self.words(1, 4)}</a></li>' for _ in range(n)) + "</ul>"

    def boilerplate(self) -> str:
        r = self.r
        return r.choice(
            (
                lambda: f"<nav>{self.links(r.randint(2, 9))}</nav>",
                lambda: self.named("div", MENU_NAMES, self.links(r.randint(2, 9))),
                lambda: self.named("div", AD_NAMES, self.sentences(1, 2)),
                lambda: self.named(r.choice(("div", "section")), AD_NAMES, f"<p>{self.sentences(1, 3)}</p>"),
                lambda: self.named("div", NOTICE_NAMES, f"<p>{self.sentences(1, 3)}</p><button>{self.words(1, 2)}</button>"),
                lambda: self.named("div", NOTICE_NAMES, self.sentences(1, 2)),
                lambda: f"<aside><h3>{self.words(1, 3)}</h3>{self.links(r.randint(2, 6))}</aside>",
                lambda: f"<aside><p>{self.sentences(1, 3)}</p></aside>",
                lambda: self.named("div", SIDE_NAMES, f"<h3>{self.words(1, 3)}</h3><p>{self.sentences(1, 2)}</p>{self.links(3)}"),
                lambda: f'<form action="/s"><p>{self.sentences(1, 1)}</p><input name="q"><button>{self.words(1, 1)}</button></form>',
                lambda: f'<form><label>{self.words(1, 3)}</label><select><option>{self.words(1, 2)}<option>{self.words(1, 2)}</select></form>',
            )
        )()

    def comments(self) -> str:
        r = self.r
        many = range(r.randint(1, 4))
        item = lambda: r.choice((f'<div class="comment"><p>{self.sentences(1, 4)}</p></div>', f'<li class="comment">{self.sentences(1, 3)}</li>', f"<p>{self.sentences(1, 3)}</p>"))
        return self.named(r.choice(("div", "section", "ul")), COMMENT_NAMES, f"<h3>{self.words(1, 2)}</h3>" + "".join(item() for _ in many))

    def body(self) -> str:
        r = self.r
        out = [r.choice((f"<h1>{self.words(2, 10)}</h1>", f"<h1>{self.sentences(1, 1)}</h1>", f"<header><h1>{self.words(2, 10)}</h1></header>", f"<h2>{self.words(2, 8)}</h2>"))]
        for _ in range(r.randint(1, 9)):
            out.append(
                r.choice(
                    (
                        *[lambda: f"<p>{self.sentences(1, 7)}</p>"] * 5,
                        lambda: f"<p><b>{self.sentences(1, 2)}<br><p>{self.sentences(1, 3)}</p>",
                        lambda: f"<p>{self.sentences(1, 1)} <a href='/y'>{self.words(1, 4)}</a> {self.sentences(1, 2)}</p>",
                        lambda: f"<p>{self.words(1, 5)}</p>",
                        lambda: f"<h2>{self.words(1, 6)}</h2>",
                        lambda: f"<div><p>{self.sentences(1, 3)}</p></div>",
                        lambda: f"<ul><li>{self.sentences(1, 2)}</li><li>{self.words(2, 9)}</li></ul>",
                        lambda: f"<blockquote><p>{self.sentences(1, 2)}</p></blockquote>",
                        lambda: f"<table><tr><td>{self.words(1, 3)}</td><td>{self.words(1, 3)}</td></tr></table>",
                        lambda: f"<pre>{self.words(3, 12)}</pre>",
                    )
                )()
            )
            if r.random() < 0.12:
                out.append(_unmarked(self.boilerplate()))
        if r.random() < 0.25:
            out.append(_unmarked(self.comments()))
        return "".join(out)

    def page(self) -> str:
        r = self.r
        body = self.body()
        kind = r.random()
        if kind < 0.35:
            main = f'<article data-main="1">{body}</article>'
        elif kind < 0.5:
            main = f'<main data-main="1">{body}</main>'
        elif kind < 0.62:
            main = f'<main><article data-main="1">{body}</article></main>'
        elif kind < 0.88:
            main = f'<div {r.choice(("class", "id"))}="{r.choice(CONTENT_NAMES)}" data-main="1">{body}</div>'
        elif kind < 0.93:
            main = f'<section data-main="1">{body}</section>'
        else:
            main = f'<div data-main="1">{body}</div>'
        before = "".join(self.boilerplate() for _ in range(r.randint(0, 4)))
        after = "".join(self.boilerplate() for _ in range(r.randint(0, 3)))
        if r.random() < 0.5:
            after += self.comments()
        if r.random() < 0.3:
            main = f'<div class="{r.choice(("wrapper", "container", "row", "page"))}">{before}{main}{after}</div>'
            before = after = ""
        head = r.choice((f"<header><h2>{self.words(1, 3)}</h2>{self.links(3)}</header>", f"<header><p>{self.words(2, 6)}</p></header>", self.named("div", ("header", "site-header", "masthead"), f"<h1>{self.words(1, 3)}</h1>"), ""))
        foot = r.choice((f"<footer>&copy; site.example.com &middot; {self.sentences(1, 1)}</footer>", f"<footer><p>{self.sentences(1, 2)}</p></footer>", self.named("div", ("footer", "site-footer"), f"<p>&copy; {self.words(1, 4)}</p>"), f"<footer>{self.links(4)}</footer>"))
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title></head><body>{head}{before}{main}{after}{foot}</body></html>"


def _unmarked(part: str) -> str:
    """A part inside the main text that isn't of it."""
    tag, _, rest = part.partition(">")
    return f'{tag} data-main="0">{rest}'


def labelled_pages(n: int, seed: int = 1) -> list[str]:
    return [_Maker(seed * 100_003 + k).page() for k in range(n)]
