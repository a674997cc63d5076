"""A bounded sample of labelled pages for operator 7: invented pages of many layouts whose article is known by construction.

``PAGES`` pages are made from a fixed seed, with semantic elements, with class names or with neither, so that a classifier
has to weigh what a block is in against what it reads like.
"""

from __future__ import annotations

import random
from collections.abc import Callable

PAGES = 1000
SEED = 17
#: Shares of pages with semantic elements, with telling names, and masked ones with neither.
STYLES = (10, 10, 5)
_SYLLABLES = "ka lo mi ren tas vo ner dul pri san el or an ti che mon bri gal fe ux".split()


class Maker:
    def __init__(self, rng: random.Random, styles: tuple[int, int, int]):
        self.rng, self.content = rng, set()
        self.style = rng.choices(("semantic", "classes", "plain"), styles)[0]

    def word(self) -> str:
        return "".join(self.rng.choice(_SYLLABLES) for _ in range(self.rng.randint(1, 4)))

    def phrase(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.rng.randint(low, high))).capitalize()

    def sentences(self, low: int, high: int) -> str:
        out = []
        for _ in range(self.rng.randint(low, high)):
            words = [self.word() for _ in range(self.rng.randint(3, 22))]
            out.append(" ".join(w + ("," if self.rng.random() < 0.08 else "") for w in words).capitalize().rstrip(",") + self.rng.choice("....!?"))
        return " ".join(out)

    def wrap(self, inner: str, element: str, names: str) -> str:
        """The inner part in its element, in a div with a telling class or id, or in a plain div."""
        if self.style == "semantic" and element:
            return f"<{element}>{inner}</{element}>"
        if self.style != "plain" and self.rng.random() < 0.95:
            key, name = self.rng.choice(("class", "class", "id")), self.rng.choice(names.split())
            return f'<div {key}="{name}">{inner}</div>'
        return f"<div>{inner}</div>"

    def keep(self, tag: str, text: str) -> str:
        self.content.add(text)
        if self.rng.random() < 0.2:
            words = text.split(" ")
            k = self.rng.randrange(len(words))
            words[k] = self.rng.choice(("<b>{}</b>", "<a href=x>{}</a>", "<i>{}</i>")).format(words[k])
            text = " ".join(words)
        return f"<{tag}>{text}</{tag}>"

    def links(self, low: int, high: int, words: int = 3) -> str:
        return "<ul>" + "".join(f'<li><a href="/{self.word()}">{self.phrase(1, words)}</a></li>' for _ in range(self.rng.randint(low, high))) + "</ul>"

    def article(self) -> str:
        out = [self.keep("h1", self.phrase(3, 10))]
        for _ in range(self.rng.randint(2, 9)):
            kind = self.rng.random()
            if kind < 0.6:
                out.append(self.keep("p", self.sentences(1, 6)))
            elif kind < 0.7:
                out.append(self.keep("p", self.phrase(1, 5) + "."))
            elif kind < 0.78:
                out.append(self.keep("h2", self.phrase(2, 7)))
            elif kind < 0.86:
                out.append("<ul>" + "".join(self.keep("li", self.phrase(2, 9) + self.rng.choice((".", ""))) for _ in range(self.rng.randint(2, 5))) + "</ul>")
            elif kind < 0.9:
                out.append(self.keep(self.rng.choice(("blockquote", "div", "td")), self.sentences(1, 2)))
            elif kind < 0.93:  # parts whose names have words of boilerplate, and are none
                names = self.rng.choice(("related-work search-trees menu-planning", "form-of-government overlay-network comment-style", "side notes-on-ads social-history")).split()
                own = f'{self.rng.choice(("id", "class"))}="{self.rng.choice(names)}"' if self.style != "plain" else ""
                inner = self.keep(self.rng.choice(("h2", "h3")), self.phrase(2, 7)) + "".join(self.keep("p", self.sentences(1, 4)) for _ in range(self.rng.randint(1, 3)))
                out.append(f"<section {own}>{inner}</section>")
            elif kind < 0.965:
                out.append(self.wrap(self.phrase(2, 8) + ".", "", "ad advert sponsored promo"))
            else:
                out.append(self.wrap(f"<a href=x>{self.phrase(1, 1)}</a> <a href=y>{self.phrase(1, 2)}</a>", "aside", "share social related"))
        if self.rng.random() < 0.4:  # often nothing tells where the article begins and ends
            return "".join(out)
        return self.wrap("".join(out), self.rng.choice(("article", "main", "article")), "article content post entry-content story main-body")

    def around(self) -> tuple[list[Callable[[], str]], list[Callable[[], str]]]:
        r, wrap = self.rng, self.wrap
        before = [
            lambda: wrap(f'<a href="/">{self.phrase(1, 2)}</a><p>{self.phrase(2, 6)}</p>', "header", "header masthead topbar banner"),
            lambda: wrap(self.links(3, 8), "nav", "nav menu navbar breadcrumbs"),
            lambda: wrap(f"<p>{self.sentences(1, 2)}</p><button>{self.phrase(1, 1)}</button>", "dialog", "cookie-notice consent popup notice"),
            lambda: wrap(self.rng.choice(("{}", "<p>{}</p>", "<a href=z>{}</a>")).format(self.sentences(1, 2)), "aside" if r.random() < 0.3 else "", "ad ads advert sponsored"),
        ]
        after = [
            lambda: wrap(f"<h3>{self.phrase(1, 3)}</h3>{self.links(2, 6, 8)}<p>{self.sentences(1, 2)}</p>", "aside", "sidebar widget side rail"),
            lambda: wrap(f"<h3>{self.phrase(1, 3)}</h3>" + "".join(f"<div><b>{self.phrase(1, 2)}</b></div><p>{self.sentences(1, 3)}</p>" for _ in range(r.randint(1, 5))), "section" if r.random() < 0.1 else "aside", "comments commentlist replies discussion"),
            lambda: wrap(f"<p>{self.sentences(1, 1)}</p><label>{self.phrase(1, 3)}</label><input><button>{self.phrase(1, 2)}</button>", "form", "newsletter subscribe signup form"),
            lambda: wrap(f"<h4>{self.phrase(1, 2)}</h4>{self.links(2, 5, 9)}", "nav", "related recommended popular"),
            lambda: wrap(f"<p>&copy; 2020 {self.phrase(1, 4)}.</p>{self.links(2, 5)}", "footer", "footer copyright foot"),
            lambda: r.choice(("<p hidden>{}</p>", '<div style="display:none"><p>{}</p></div>', '<p aria-hidden="true">{}</p>')).format(self.sentences(1, 2)),
        ]
        return [f for f in before if r.random() < 0.6], [f for f in after if r.random() < 0.6]


def labelled_pages(pages: int = PAGES, seed: int = SEED, styles: tuple[int, int, int] = STYLES) -> list[tuple[str, set[str]]]:
    """(html, texts of the article's blocks) of each page, in shares of the three styles."""
    out, rng = [], random.Random(seed)
    for _ in range(pages):
        make = Maker(rng, styles)
        if rng.random() < 0.08:  # a fragment: text alone, or paragraphs without a page around them
            bare = rng.random() < 0.5
            parts = [make.sentences(1, 4) for _ in range(1 if bare else rng.randint(1, 3))]
            out.append(("".join(parts if bare else map("<p>{}</p>".format, parts)), set(parts)))
            continue
        before, after = make.around()
        body = [f() for f in before] + [make.article()] + [f() for f in after]
        inner = "".join(body)
        if rng.random() < 0.3:
            inner = f'<div class="wrap">{inner}</div>'
        out.append((f"<html><head><title>{make.phrase(2, 6)}</title></head><body>{inner}</body></html>", make.content))
    return out
