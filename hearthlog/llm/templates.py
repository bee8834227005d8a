"""Generated page layouts with known main text, to train the extractor on more markup than one site has."""
from __future__ import annotations

import random
from collections.abc import Iterator

MARK = "\ue000"  # stands in the texts that are main text
PAGES, SEED = 800, 7

_SYLLABLES = "an be co de en fu ga he in jo ka le mo na or pe qui ra so te un va wi xo ya zu".split()


class _Layout:
    def __init__(self, rng: random.Random):
        self.r = rng

    def words(self, low: int, high: int, stops: bool = True) -> str:
        r, out = self.r, []
        for i in range(r.randint(low, high)):
            word = "".join(r.choices(_SYLLABLES, k=r.randint(1, 4)))
            out.append(word + (r.choice(",..?;") if stops and r.random() < 0.15 else ""))
        return " ".join(out).capitalize() + ("." if stops else "")

    def named(self, *names: str) -> str:
        """An element with one of the names: a landmark tag (`<nav`) or a div with class or id."""
        name = self.r.choice(names)
        if name.startswith("<"):
            return name[1:]
        extra = self.r.choice(["", "", " " + self.r.choice(["box", "inner", "clearfix", "col", "block"])])
        return f'{self.r.choice(["div", "div", "section"])} {self.r.choice(["class", "class", "id", "role"])}="{name}{extra}"'

    def element(self, opening: str, inside: str) -> str:
        return f"<{opening}>{inside}</{opening.split()[0]}>"

    def links(self, low: int, high: int) -> str:
        item = self.r.choice(["<li><a href='/x'>{}</a></li>", "<a href='/x'>{}</a> ", "<p><a href='/x'>{}</a></p>"])
        inside = "".join(item.format(self.words(1, self.r.choice([2, 6, 12]), False)) for _ in range(self.r.randint(low, high)))
        return f"<ul>{inside}</ul>" if item.startswith("<li") else inside

    def notes(self) -> str:
        """Some text that is not main text: sentences, links or both, in a paragraph or bare."""
        r = self.r
        kind = r.randint(0, 3)
        text = self.words(2, r.choice([8, 20, 60]))
        return [text, f"<p>{text}</p>", self.links(1, 6), f"<h3>{self.words(1, 4, False)}</h3><p>{text}</p>{self.links(1, 3)}"][kind]

    def main(self) -> str:
        r, out = self.r, []
        say = lambda low, high, stops=True: MARK + self.words(low, high, stops)
        if r.random() < 0.85:
            title = f"<h1>{say(2, 14, False)}</h1>"
            if r.random() < 0.25:
                out.append(f"<p><b>{say(2, 14)}<br>")
            out.insert(0, self.element("header", title) if r.random() < 0.15 else title)
        for _ in range(r.choice([0, 1, 1, 1, 2, 3, 5, 8, 14])):
            text = say(1, r.choice([4, 12, 40, 120]))
            shape = r.random()
            if shape < 0.5:
                out.append(f"<p>{text}</p>")
            elif shape < 0.6:
                out.append(f"<p>{text}")
            elif shape < 0.68:
                out.append(f"<p><b>{text}<br><p>{say(3, 60)}</p>")
            elif shape < 0.76:
                out.append(f"<p>{text} <a href='/y'>{self.words(1, 3, False)}</a> {self.words(1, 20)}</p>")
            elif shape < 0.82:
                out.append(f"<h2>{say(1, 7, False)}</h2><p>{text}</p>")
            elif shape < 0.87:
                out.append("<ul>" + "".join(f"<li>{say(2, 15)}</li>" for _ in range(r.randint(1, 6))) + "</ul>")
            elif shape < 0.91:
                out.append(f"<blockquote>{text}</blockquote>")
            elif shape < 0.94:
                out.append(f"<div>{text}</div>")
            elif shape < 0.97:
                out.append("<table>" + "".join(f"<tr><td>{say(1, 3)}</td><td>{say(1, 8)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>")
            else:
                out.append(f"<pre>{text}</pre>")
        for chance, extra in ((0.15, self.advert), (0.15, self.share), (0.08, self.form), (0.1, self.related)):
            if r.random() < chance:
                out.insert(r.randint(0, len(out)), extra())
        return "".join(out)

    def advert(self) -> str:
        return self.element(self.named("ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot"), self.notes())

    def share(self) -> str:
        return self.element(self.named("share", "social", "share-buttons"), self.links(1, 5))

    def form(self) -> str:
        return self.element(self.r.choice(["form", "form class='search'", self.named("newsletter", "login", "signup")]), f"<label>{self.words(1, 6, False)}</label><input name='q'><p>{self.words(2, 20)}</p>")

    def notice(self) -> str:
        return self.element(self.named("notice", "cookie-banner", "cookies", "consent", "gdpr", "alert", "popup", "newsletter"), self.notes())

    def menu(self) -> str:
        return self.element(self.named("<nav", "<nav", "nav", "menu", "navigation", "breadcrumb"), self.links(2, 10))

    def top(self) -> str:
        return self.element(self.named("<header", "<header", "header", "masthead", "site-header", "topbar"), self.r.choice([f"<h1>{self.words(1, 4, False)}</h1>", f"<p>{self.words(1, 10)}</p>", ""]) + self.r.choice([self.menu(), "", self.notes()]))

    def foot(self) -> str:
        return self.element(self.named("<footer", "<footer", "<footer", "footer", "copyright", "site-footer"), self.r.choice([self.notes(), "&copy; " + self.words(2, 30), self.links(2, 8)]))

    def related(self) -> str:
        return self.element(self.named("<aside", "<aside", "sidebar", "related", "widget", "recommended", "side"), "".join(self.notes() for _ in range(self.r.randint(1, 4))))

    def comments(self) -> str:
        each = lambda: self.element(self.r.choice(["div class='comment'", "li", "article class='comment'", "div"]), f"<p>{self.words(2, self.r.choice([10, 60]))}</p>")
        return self.element(self.named("comments", "comment-list", "discussion", "responses", "disqus"), f"<h2>{self.words(1, 3, False)}</h2>" + "".join(each() for _ in range(self.r.randint(1, 6))))

    def page(self) -> str:
        r = self.r
        column = self.element(r.choice(["article", "article", "article", "main", "article class='post'"]) if r.random() < 0.65 else self.named("content", "main", "post", "entry-content", "story", "article-body", "text", "box"), self.main())
        if r.random() < 0.2:
            column = self.element("main", column)
        if r.random() < 0.2:
            column = column[: column.rindex("</")] + self.comments() + column[column.rindex("</"):]
        before = [f() for f, chance in ((self.notice, 0.25), (self.top, 0.5), (self.menu, 0.6), (self.advert, 0.4), (self.related, 0.15), (self.form, 0.15)) if r.random() < chance]
        after = [f() for f, chance in ((self.comments, 0.3), (self.related, 0.35), (self.advert, 0.2), (self.form, 0.15), (self.notice, 0.1), (self.share, 0.15), (self.foot, 0.8)) if r.random() < chance]
        r.shuffle(before)
        if r.random() < 0.1:
            after.append(self.words(1, 8))
        inside = "".join([*before, column, *after])
        for _ in range(r.choice([0, 0, 1, 2])):
            inside = self.element(f'div class="{r.choice(["page", "wrapper", "container", "site", "layout"])}"', inside)
        return f"<html><head><title>{self.words(2, 6, False)}</title><style>p{{}}</style></head><body>{inside}</body></html>"


def labelled_pages(pages: int = PAGES, seed: int = SEED) -> Iterator[str]:
    rng = random.Random(seed)
    for _ in range(pages):
        yield _Layout(rng).page()
