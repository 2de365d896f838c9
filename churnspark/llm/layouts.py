"""Made-up page layouts with known main text, on which the block labeller is trained."""

from __future__ import annotations

import random
from html import escape

#: Put before every piece of main text of a made-up page; private use, in no real text.
MAIN = ""

# Common names of page regions, by what they hold.
REGIONS = {
    "nav": (["nav", "div", "ul", "div"], "nav navbar menu main-menu topnav breadcrumb breadcrumbs pagination pager tabs links site-nav mega-menu toc"),
    "header": (["header", "div"], "header site-header masthead topbar page-header logo branding top-bar"),
    "footer": (["footer", "div"], "footer site-footer bottom copyright legal colophon page-footer imprint"),
    "side": (["aside", "div", "section"], "sidebar side widget rail right-column left-column sidebar-left aside secondary"),
    "notice": (["div", "section", "p", "dialog", "aside"], "notice cookie cookie-notice cookie-banner consent alert message gdpr popup modal newsletter subscribe paywall warning banner overlay"),
    "ad": (["div", "aside", "section", "ins", "p"], "ad ads advert advertisement sponsored promo banner-ad ad-slot adsbox sponsor promotion advertorial dfp"),
    "form": (["form", "form", "div"], "search search-form login signup contact-form form newsletter-form"),
    "comments": (["section", "div", "ol", "aside"], "comments comment-list reader-comments replies responses discussion comment-section commentlist user-comments thread"),
    "related": (["div", "section", "aside", "ul"], "related recommended more-stories share social tags related-posts read-more sharing trending also-like author-bio meta"),
}
MAINS = "content post entry entry-content article-body story post-body main-content text body article page-content post-content story-body prose"
PLAIN = "wrapper container row col col-8 inner box layout grid outer page wrap left wide block group"
SAID = (
    "© copyright all rights reserved privacy terms contact about home menu search login subscribe newsletter cookies accept "
    "share tweet related comments reply posted advertisement sponsored skip navigation follow us more read next previous"
).split()


class Layouts:
    """Draws pages; words come from the caller's pool, for main text and the rest alike."""

    def __init__(self, words: list[str], seed: int):
        self.words, self.draw = words or ["word"], random.Random(seed)

    def text(self, most: int) -> str:
        r = self.draw
        picked = [r.choice(self.words) for _ in range(r.randint(1, most))]
        style = r.random()
        if style < 0.05:
            picked = [w + r.choice([" |", "%%%", "&&&", "***", "###", "!!"]) for w in picked]
        elif style < 0.08:
            picked = [picked[0]] * len(picked)
        elif style < 0.12:
            picked.insert(r.randrange(len(picked) + 1), str(r.randrange(10**r.randint(1, 16))))
        return " ".join(picked) + r.choice(["", ".", ".", "?", "!"])

    def line(self, main: bool, most: int = 40) -> str:
        r = self.draw
        if not main and r.random() < 0.35:
            text = " ".join(r.sample(SAID, r.randint(1, 6)) + self.text(6).split())
        else:
            text = self.text(r.choice([3, 8, most]))
        text = escape(text, quote=False)
        if r.random() < 0.15:
            tag = r.choice(["b", "i", "em", "strong", "span", "code"])
            text = f"<{tag}>{text}" + (f"</{tag}>" if r.random() < 0.8 else "")
        if r.random() < (0.08 if main else 0.4):
            text = f'<a href="/{r.randrange(999)}">{text}</a>'
        if r.random() < 0.08:
            text += "<br>" + escape(self.text(8), quote=False)
        return (MAIN if main else "") + text

    def leaves(self, main: bool, count: int) -> str:
        """Paragraphs, headings, lists, quotes, tables; end tags are sometimes left out."""
        r, out = self.draw, []
        for _ in range(count):
            kind = r.choices(["p", "h", "list", "quote", "table", "div", "pre", "bare", "dl", "figure"], [10, 2, 2, 1, 1, 2, 0.5, 0.7, 0.4, 0.5])[0]
            if kind == "p":
                out.append(f"<p>{self.line(main)}" + ("</p>" if r.random() < 0.85 else ""))
            elif kind == "h":
                level = r.choice("1234")
                out.append(f"<h{level}>{self.line(main, 8)}</h{level}>")
            elif kind == "list":
                tag = r.choice(["ul", "ol"])
                out.append(f"<{tag}>" + "".join(f"<li>{self.line(main, 10)}" + ("</li>" if r.random() < 0.8 else "") for _ in range(r.randint(1, 5))) + f"</{tag}>")
            elif kind == "quote":
                out.append(f"<blockquote><p>{self.line(main)}</p></blockquote>")
            elif kind == "table":
                out.append("<table><tr>" + "".join(f"<td>{self.line(main, 6)}</td>" for _ in range(r.randint(1, 4))) + "</tr></table>")
            elif kind == "figure":
                out.append(f"<figure><img src='x.png'><figcaption>{self.line(main, 12)}</figcaption></figure>")
            elif kind == "dl":
                out.append(f"<dl><dt>{self.line(main, 4)}<dd>{self.line(main, 12)}</dl>")
            elif kind == "bare":
                out.append("<hr>" + self.line(main))
            else:
                out.append(f"<{kind}>{self.line(main)}</{kind}>")
        return "".join(out)

    def named(self, names: str, chance: float) -> str:
        r = self.draw
        if r.random() >= chance:
            return ""
        picked = [r.choice(names.split())] + ([r.choice(PLAIN.split())] if r.random() < 0.2 else [])
        return f' {r.choice(["class", "class", "id"])}="{" ".join(picked)}"'

    def region(self, kind: str) -> str:
        r = self.draw
        tags, names = REGIONS[kind]
        tag = r.choice(tags)
        telling = tag not in ("div", "section", "p", "ul", "ol", "aside", "ins", "dialog")
        name = self.named(names, 0.5 if telling else 1.0)
        if kind == "nav":
            items = "".join(f'<li><a href="/{r.randrange(99)}">{escape(self.text(2), quote=False)}</a></li>' for _ in range(r.randint(1, 8)))
            inside = items if tag == "ul" else f"<ul>{items}</ul>" if r.random() < 0.8 else items.replace("li>", "span>")
        elif kind == "form":
            inside = f"<label>{self.line(False, 4)}</label><input name=q><button>{self.line(False, 2)}</button>" + (self.leaves(False, 1) if r.random() < 0.4 else "")
        elif kind == "comments":
            one = r.choice(["div class=comment", "article class=comment", "li", "p", "div class=reply", "section class=response"])
            shut = one.split()[0]
            inside = (f"<h3>{self.line(False, 4)}</h3>" if r.random() < 0.5 else "") + "".join(
                f"<{one}>{self.leaves(False, 1) if r.random() < 0.6 and shut != 'p' else self.line(False)}</{shut}>" for _ in range(r.randint(1, 6)))
        elif tag == "p" or r.random() < 0.4:
            inside = self.line(False)
        else:
            inside = self.leaves(False, r.randint(1, 4))
        return f"<{tag}{name}>{inside}</{tag}>"

    def main(self) -> str:
        r = self.draw
        count = r.choice([1, 2, 4, 8, 16, 40])
        parts = [f"<h1>{self.line(True, 10)}</h1>"] if r.random() < 0.7 else []
        while count > 0:
            n = min(count, r.randint(1, 8))
            parts.append(self.leaves(True, n))
            count -= n
            if r.random() < 0.25:
                parts.append(self.region(r.choice(["ad", "related", "notice", "side", "form", "nav"])))
        if r.random() < 0.2:
            parts.append(self.region(r.choice(["comments", "related", "footer"])))
        out = "".join(parts)
        shape = r.random()
        if shape < 0.5:
            out = f"<article{self.named(MAINS + ' ' + PLAIN, 0.3)}>{out}" + ("</article>" if r.random() < 0.95 else "")
        elif shape < 0.65:
            out = f"<main{self.named(MAINS, 0.3)}>{out}</main>"
        elif shape < 0.75:
            out = f"<main><article><div{self.named(MAINS, 0.8)}>{out}</div></article></main>"
        else:
            out = f"<{(t := r.choice(['div', 'section']))}{self.named(MAINS, 1.0)}>{out}</{t}>"
        return out

    def page(self) -> str:
        """A page; its main text carries MAIN in every line."""
        r = self.draw
        if r.random() < 0.03:
            return MAIN + escape(self.text(60), quote=False)
        before = [self.region(k) for k in ("header", "nav", "notice", "ad", "side", "form") if r.random() < 0.35]
        after = [self.region(k) for k in ("comments", "related", "side", "ad", "form", "notice", "nav", "footer") if r.random() < 0.35]
        r.shuffle(before)
        if r.random() < 0.4:
            r.shuffle(after)
        body = "".join(before) + self.main() + "".join(after)
        for _ in range(r.randint(0, 2)):
            body = f"<div{self.named(PLAIN, 0.7)}>{body}</div>"
        head = f"<head><title>{escape(self.text(8))}</title><style>p{{margin:0}}</style></head>" if r.random() < 0.8 else ""
        return f"<!DOCTYPE html><html>{head}<body>{body}" + ("</body></html>" if r.random() < 0.9 else "")
