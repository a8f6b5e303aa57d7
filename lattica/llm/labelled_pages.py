"""Labelled pages for training content extraction: invented pages in many layouts.

Blocks carry data-mark="c" (main text) or "n" (not); a mark holds for the blocks within, too. The
layouts cover semantic tags, class names, tables and bare bodies, closed and unclosed markup.
"""

from __future__ import annotations

import random

import numpy as np

from lattica.llm.html_extract import Page, main_text, parse, train_tree

SYLLABLES = "ba ce di fo gu la me ni po ru sa te vi zo an el in or us".split()


class Writer:
    def __init__(self, rng: random.Random) -> None:
        self.r = rng

    def word(self) -> str:
        return "".join(self.r.choice(SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def words(self, a: int, b: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(a, b)))

    def sentences(self, a: int, b: int) -> str:
        return " ".join(self.words(4, 16).capitalize() + "." for _ in range(self.r.randint(a, b)))

    def link(self) -> str:
        return f'<a href="/{self.word()}">{self.words(1, 4)}</a>'

    def links(self) -> str:
        n = self.r.randint(3, 8)
        return self.r.choice(("<ul>" + "".join(f"<li>{self.link()}</li>" for _ in range(n)) + "</ul>", " | ".join(self.link() for _ in range(n))))

    def box(self, tags: str, names: str, inner: str, mark: str = "n") -> str:
        """A block of one of `tags`; generic ones need one of `names` as class or id."""
        tag = self.r.choice(tags.split())
        name = self.r.choice(names.split()) if names else ""
        if name and (tag in ("div", "section", "ul", "p", "td") or self.r.random() < 0.4):
            kind = self.r.choice(("class", "class", "id"))
            name = self.r.choice(("", "", "site-", "page-", "block-")) + name + self.r.choice(("", "", "-box", " clearfix", "-1"))
            return f'<{tag} {kind}="{name}" data-mark="{mark}">{inner}</{tag}>'
        return f'<{tag} data-mark="{mark}">{inner}</{tag}>'

    def menu(self) -> str:
        return self.box("nav nav div ul", "nav menu navbar breadcrumb main-menu toc pagination", self.links())

    def masthead(self) -> str:
        inner = self.r.choice((f"<h1>{self.words(1, 3)}</h1>", f"<p>{self.words(2, 8)}.</p>", f"<div>{self.words(1, 3)}</div>", self.words(2, 6)))
        return self.box("header header div", "header masthead topbar logo", inner + self.r.choice(("", self.menu())))

    def footer(self) -> str:
        return self.box("footer footer div", "footer copyright legal colophon", self.r.choice((f"&copy; {self.words(1, 3)} &middot; {self.sentences(1, 2)}", f"<p>{self.sentences(1, 2)}</p>", self.links() + f"<p>© {self.words(2, 6)}.</p>")))

    def side(self) -> str:
        return self.box("aside aside div section", "sidebar widget related recommended trending popular more-stories", f"<h3>{self.words(1, 4)}</h3>" + self.r.choice((self.links(), f"<p>{self.sentences(1, 3)}</p>", f"<div>{self.sentences(1, 2)}</div>")))

    def advert(self) -> str:
        return self.box("div div section p", "ad ads advert advertisement sponsored promo banner ad-slot", self.r.choice((self.sentences(1, 3), f"<p>{self.sentences(1, 2)}</p>", self.link() + " " + self.words(3, 9) + ".")))

    def notice(self) -> str:
        return self.box("div div section dialog p", "cookie cookie-notice consent gdpr-notice alert notice newsletter subscribe popup privacy-notice", self.r.choice((self.sentences(1, 3), f"<p>{self.sentences(1, 2)}</p><button>{self.word()}</button>")))

    def form(self) -> str:
        return self.box("form form form div", "search login signup contact-form register", f"<label>{self.words(1, 3)}</label><input name=q><button>{self.word()}</button>" + self.r.choice(("", f"<p>{self.sentences(1, 2)}</p>")))

    def comments(self) -> str:
        each = "".join(self.r.choice((f'<div class="comment"><b>{self.word()}</b><p>{self.sentences(1, 4)}</p></div>', f"<p>{self.sentences(1, 3)}</p>", f"<li>{self.word()}: {self.sentences(1, 3)}</li>", f"<article class=comment><p>{self.sentences(1, 3)}</p></article>")) for _ in range(self.r.randint(1, 6)))
        return self.box("section section div ul", "comments comment-list reader-comments replies discussion responses", self.r.choice(("", f"<h3>{self.words(1, 2)}</h3>")) + each)

    def share(self) -> str:
        return self.box("div ul", "share social tags", self.links())

    def boiler(self, within: bool = False) -> str:
        kinds = [self.advert, self.side, self.notice, self.form, self.comments, self.share, self.menu, self.footer]
        return self.r.choice(kinds if within else [*kinds, self.masthead, self.menu, self.footer, self.advert])()

    def body(self) -> str:
        """The main text's blocks; some unclosed, some with boilerplate within."""
        out = [f"<h1>{self.words(3, 10)}</h1>"]
        if self.r.random() < 0.25:
            out = [f"<header>{out[0]}{self.r.choice(('', f'<p>{self.sentences(1, 1)}</p>'))}</header>"]
        if self.r.random() < 0.1:
            out = []
        for _ in range(self.r.choice((0, 1, 2, 3, 5, 8))):
            s = self.sentences(1, 7)
            k = self.r.random()
            if k < 0.5:
                out.append(f"<p>{s}</p>")
            elif k < 0.6:
                out.append(f"<p><b>{s}<br>")
            elif k < 0.65:
                out.append(f"<p>{s} {self.link()} {self.words(2, 5)}.</p>")
            elif k < 0.7:
                out.append(f"<h2>{self.words(2, 6)}</h2>")
            elif k < 0.76:
                out.append("<ul>" + "".join(f"<li>{self.words(2, 12)}</li>" for _ in range(3)) + "</ul>")
            elif k < 0.8:
                out.append(f"<blockquote>{s}</blockquote>")
            elif k < 0.84:
                out.append(f"<table><tr><th>{self.word()}</th><td>{self.words(1, 4)}</td></tr><tr><td>{self.words(1, 5)}</td></tr></table>")
            elif k < 0.87:
                out.append(f"<figure><img src=x><figcaption>{self.words(3, 9)}.</figcaption></figure>")
            elif k < 0.9:
                out.append(f"<div>{s}</div>")
            elif k < 0.93:
                out.append(f"<section><h3>{self.words(1, 5)}</h3><p>{s}</p></section>")
            else:
                out.append(self.boiler(within=True))
        return "".join(out)

    def page(self) -> str:
        top = "".join(self.boiler() for _ in range(self.r.randint(0, 3)))
        end = "".join(self.boiler() for _ in range(self.r.randint(0, 3)))
        inner = self.body()
        k = self.r.random()
        if k < 0.45:
            main = f'<article data-mark="c">{inner}</article>'
            if self.r.random() < 0.3:
                main = f"<main>{main}{self.r.choice(('', self.side(), self.comments()))}</main>"
        elif k < 0.6:
            main = f'<main data-mark="c">{inner}</main>'
        elif k < 0.85:
            name = self.r.choice(("content", "main-content", "post", "entry", "story-body", "article-text", "main"))
            main = f'<div class="{name}" data-mark="c">{inner}</div>'
        elif k < 0.9:
            main = f'<table><tr><td data-mark="n">{self.links()}</td><td data-mark="c">{inner}<p>{self.sentences(2, 5)}</td></tr></table>'
        elif k < 0.95:
            main = f'<div data-mark="c">{inner}<p>{self.sentences(3, 6)}</p></div>'
        else:
            return f'<html><body data-mark="c">{self.sentences(3, 9)}<p>{self.sentences(2, 4)}</body></html>'
        if self.r.random() < 0.3:
            main = f'<div class="{self.r.choice(("wrapper", "container", "page", "row"))}">{main}{self.r.choice(("", self.side()))}</div>'
        head = f"<head><title>{self.words(3, 8)}</title><script>var a='<p>';</script></head>"
        return f"<!DOCTYPE html><html>{head}<body>{top}{main}{end}</body></html>"


def marks(page: Page) -> np.ndarray:
    """Labels of a page's blocks from their marks: 1 for main text."""
    y = np.zeros(len(page.tag), int)
    for i, m in enumerate(page.mark):
        y[i] = (m == "c") if m else (y[page.parent[i]] if i else 0)
    return y


def labelled_pages(n: int = 240, seed: int = 11) -> list[tuple[Page, np.ndarray]]:
    writer = Writer(random.Random(seed))
    pages = [parse(writer.page()) for _ in range(n)]
    return [(p, marks(p)) for p in pages]


def trained_model(n: int = 240, seed: int = 11, steps: int = 60):
    return train_tree(labelled_pages(n, seed), steps)


__all__ = ["Writer", "labelled_pages", "main_text", "marks", "trained_model"]
