"""Labelled pages for the extractor: pages put together from parts whose label is known.

A page is a random arrangement of page furniture (label 0) around an article (label 1), with the names that sites commonly
give to such parts, in tidy and in careless markup. Words are drawn from random syllables, so no language is learnt.
"""

from __future__ import annotations

import html
import random

# fixed values: usual names of page parts
NAMES = {
    "header": "header masthead topbar site-header banner page-header branding logo top".split(),
    "menu": "nav navbar menu main-menu navigation breadcrumb breadcrumbs site-nav toc pagination pager tabs".split(),
    "advert": "ad ads advert advertisement ad-slot sponsored sponsor promo banner-ad adsbygoogle dfp commercial".split(),
    "notice": "cookie cookie-notice consent gdpr notice alert banner popup modal paywall subscribe-wall disclaimer".split(),
    "sidebar": "sidebar side rail widget related related-posts recommended popular trending aside more-stories social share".split(),
    "form": "search search-form newsletter subscribe signup login contact-form".split(),
    "comments": "comments comment-list comment replies responses disqus discussion reader-comments commentlist reply".split(),
    "footer": "footer site-footer page-footer bottom colophon copyright legal credits".split(),
    "article": "article post content entry entry-content article-body story post-content main main-content body-text text".split(),
    "plain": "wrapper container row col page inner layout site block box group".split(),
}
SYLLABLES = "an be con de er fi ga ho in ju ka lo mi no or pe qua ri sto ta un ver wa xi yo zu".split()


class _Page:
    def __init__(self, draw: random.Random):
        self.draw, self.out, self.labels = draw, [], []

    def word(self) -> str:
        return "".join(self.draw.choice(SYLLABLES) for _ in range(self.draw.randint(1, 4)))

    def sentence(self, low: int, high: int, end: str = ".") -> str:
        words = [self.word() for _ in range(self.draw.randint(low, high))]
        for k in range(3, len(words) - 1, self.draw.randint(4, 9)):
            words[k] += ","
        odd = self.draw.random()
        if odd < 0.06:
            words = [w.upper() + "!!" for w in words]
        elif odd < 0.12:
            words = [w + self.draw.choice(["###", "$$$", "%%%"]) for w in words]
        return html.escape(" ".join(words).capitalize() + (end if self.draw.random() < 0.9 else ""))

    def paragraph(self) -> str:
        return " ".join(self.sentence(2, 16) for _ in range(self.draw.choice([1, 1, 2, 3, 5, 8])))

    def title(self) -> str:
        return self.sentence(1, 9, "")

    def link(self, text: str) -> str:
        return f'<a href="/{self.word()}">{text}</a>'

    def block(self, tag: str, text: str, label: int, attributes: str = "", close: bool = True) -> None:
        self.out.append(f"<{tag}{attributes}>{text}" + (f"</{tag}>" if close else ""))
        self.labels.append(label)

    def named(self, part: str) -> str:
        name = self.draw.choice(NAMES[part])
        if self.draw.random() < 0.3:
            name += " " + self.draw.choice(NAMES["plain"])
        return f' {self.draw.choice(["class", "class", "class", "id"])}="{name}"'

    def around(self, part: str, tag: str, body) -> None:
        """``body`` inside the part's own element or a division with the part's name, or both."""
        own = self.draw.random() < 0.5
        if own and tag != "div":
            self.out.append(f"<{tag}{self.named(part) if self.draw.random() < 0.4 else ''}>")
        else:
            tag = self.draw.choice(["div", "div", "section", "aside"]) if part != "article" else "div"
            self.out.append(f"<{tag}{self.named(part)}>")
        body()
        self.out.append(f"</{tag}>")

    def link_list(self, low: int, high: int, long: bool = False) -> None:
        tag = self.draw.choice(["ul", "ul", "ol", "div"])
        self.out.append(f"<{tag}>")
        for _ in range(self.draw.randint(low, high)):
            text = self.link(self.title() if long else self.word())
            self.block("li" if tag != "div" else "p", text, 0, close=self.draw.random() < 0.9)
        self.out.append(f"</{tag}>")

    def short_texts(self, low: int, high: int) -> None:
        for _ in range(self.draw.randint(low, high)):
            kind = self.draw.random()
            text = self.sentence(1, 10) if kind < 0.5 else self.paragraph() if kind < 0.75 else self.link(self.title())
            self.block(self.draw.choice(["p", "div", "p", "h3", "li"]), text, 0)

    def bare_text(self) -> None:
        """Text directly inside the part's element."""
        self.out.append(self.sentence(1, 12) if self.draw.random() < 0.6 else self.paragraph())
        self.labels.append(0)

    def form(self) -> None:
        self.out.append(f'<form action="/{self.word()}">')
        for _ in range(self.draw.randint(1, 3)):
            self.block("label", self.title(), 0)
            self.out.append('<input type="text">')
        if self.draw.random() < 0.4:
            self.out.append("<select>")
            for _ in range(3):
                self.block("option", self.word(), 0)
            self.out.append("</select>")
        self.block(self.draw.choice(["button", "p"]), self.word(), 0)
        self.out.append("</form>")

    def furniture(self, part: str) -> None:
        draw = self.draw
        if part == "menu":
            self.around(part, "nav", lambda: self.link_list(2, 8))
        elif part == "header":
            self.around(part, "header", lambda: (self.block(draw.choice(["h2", "div", "p", "h1"]), self.link(self.title()), 0), self.link_list(0, 4)))
        elif part == "footer":
            mark = draw.choice(["&copy; 2024 ", "&copy; ", "Copyright ", ""])
            self.around(part, "footer", lambda: (self.out.append(mark + self.title() + draw.choice([" &middot; ", " | ", " "]) + self.sentence(1, 8)), self.labels.append(0), self.link_list(0, 3)))
        elif part == "form":
            self.around(part, "div", self.form) if draw.random() < 0.6 else self.form()
        elif part == "comments":
            def comments() -> None:
                self.block(draw.choice(["h2", "h3"]), self.title(), 0)
                for _ in range(draw.randint(1, 5)):
                    self.block(draw.choice(["p", "div", "li"]), self.paragraph(), 0)
            self.around(part, "section", comments)
        elif part == "sidebar":
            self.around(part, "aside", lambda: (self.block(draw.choice(["h3", "h4", "h2"]), self.title(), 0), self.link_list(1, 6, True), self.short_texts(0, 2)))
        else:
            self.around(part, "aside" if part == "advert" else "div", self.bare_text if draw.random() < 0.6 else lambda: self.short_texts(1, 2))

    def article(self) -> None:
        draw = self.draw
        if draw.random() < 0.9:
            self.block("h1", self.title(), 1)
        inside = draw.choice(["advert", "sidebar", "form", "notice"]) if draw.random() < 0.25 else None
        count = draw.choice([0, 1, 2, 3, 5, 8, 12])
        for k in range(count):
            kind = draw.random()
            if kind < 0.62:
                self.block("p", self.paragraph(), 1, close=draw.random() < 0.9)
            elif kind < 0.70:
                self.block("p", f"<b>{self.sentence(1, 12)}<br>", 1, close=False)
            elif kind < 0.76:
                self.block(draw.choice(["h2", "h3"]), self.title(), 1)
            elif kind < 0.84:
                self.out.append("<ul>")
                for _ in range(draw.randint(1, 4)):
                    self.block("li", self.sentence(1, 12), 1)
                self.out.append("</ul>")
            elif kind < 0.89:
                self.block("blockquote", self.paragraph(), 1)
            elif kind < 0.93:
                self.out.append("<table><tr>")
                for _ in range(3):
                    self.block("td", self.title(), 1)
                self.out.append("</tr></table>")
            elif kind < 0.96:
                self.block("pre", self.title(), 1)
            else:
                self.block("p", f"{self.sentence(3, 9)} {self.link(self.title())} {self.sentence(2, 9)}", 1)
            if inside and k == count // 2:
                self.furniture(inside)

    def build(self) -> str:
        draw = self.draw
        self.out.append('<!DOCTYPE html><html lang="x"><head><meta charset="utf-8">')
        self.block("title", self.title(), 0)
        self.out.append("<style>p{margin:0}</style><script>var t=1;</script></head><body>")
        wrapped = draw.random() < 0.4
        if wrapped:
            self.out.append(f"<div{self.named('plain')}>")
        before = draw.sample(["header", "menu", "advert", "notice", "form", "sidebar"], draw.randint(0, 4))
        after = draw.sample(["sidebar", "comments", "advert", "form", "menu", "notice"], draw.randint(0, 4))
        for part in before:
            self.furniture(part)
        self.around("article", draw.choice(["article", "article", "main"]), self.article)
        for part in after:
            self.furniture(part)
        if draw.random() < 0.9:
            self.furniture("footer")
        if wrapped:
            self.out.append("</div>")
        if draw.random() < 0.9:
            self.out.append("</body></html>")
        return "".join(self.out)


def labelled_pages(count: int, seed: int) -> list[tuple[str, list[int]]]:
    """(html, label of every leaf block in page order)."""
    draw = random.Random(seed)
    pages = []
    for _ in range(count):
        page = _Page(draw)
        pages.append((page.build(), page.labels))
    return pages
