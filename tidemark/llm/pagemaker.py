"""Made-up pages with known labels, on which the block classifier of `mincut` is fitted.

Pages differ in how much their markup tells: sectioning elements, class names,
or plain containers without any.  Content holds headings, paragraphs of all
lengths, lists, quotes and captions; boilerplate holds menus, headers,
sidebars, notices, adverts, forms, comments and footers.
"""

from __future__ import annotations

import random

SYLLABLES = "ba ce di fo gu ha je ki lo mu na pe ri so tu va we xi yo zu an en in on un".split()


def words(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choice(SYLLABLES) for _ in range(r.randrange(1, 5))) for _ in range(n))


def sentence(r: random.Random, n: int) -> str:
    return words(r, max(1, n)).capitalize() + r.choice([".", ".", ".", "!", "?", ":", ""])


def prose(r: random.Random) -> str:
    n = r.choice([1, 3, 8, 15, 30, 60, 60, 100, 160])
    text = sentence(r, n)
    if r.random() < 0.15:
        text += f' <a href="/x">{words(r, r.randrange(1, 4))}</a> {words(r, 4)}.'
    return text + (" &copy; " + words(r, 3) if r.random() < 0.02 else "")


def links(r: random.Random, n: int) -> list[str]:
    return [f'<li><a href="/{k}">{words(r, r.randrange(1, 5))}</a></li>' for k in range(n)]


def page(r: random.Random) -> tuple[str, list[bool]]:
    """(html, whether each text block is content, in page order)."""
    kind = r.choice(["elements", "names", "plain"])
    out: list[str] = []
    labels: list[bool] = []

    def region(element: str, names: list[str], blocks: list[str], content: bool) -> None:
        if not blocks:
            return
        tag = element if kind == "elements" or (kind == "names" and r.random() < 0.2) else "div"
        name = f' class="{r.choice(names)}"' if kind == "names" or (kind == "elements" and r.random() < 0.4) else ""
        out.append(f"<{tag}{name}>" + "".join(blocks) + f"</{tag}>")
        labels.extend([content] * len(blocks))

    def some(share: float) -> bool:
        return r.random() < share

    if some(0.7):
        region("header", ["header", "masthead", "topbar"], [f"<h1>{words(r, 2)}</h1>", f"<p>{sentence(r, r.randrange(2, 9))}</p>"], False)
    if some(0.8):
        region("nav", ["nav", "menu", "navbar"], links(r, r.randrange(3, 9)), False)
    if some(0.4):
        region("div", ["cookie-notice", "banner", "alert"], [f"<p>{sentence(r, r.randrange(6, 25))}</p>", f"<a href=x>{words(r, 1)}</a>"][: r.randrange(1, 3)], False)
    if some(0.5):
        region("div", ["ad", "advert", "sponsored", "promo"], [f"<div>{sentence(r, r.randrange(5, 30))}</div>"], False)
    body = [f"<h1>{words(r, r.randrange(3, 10))}</h1>"]
    for _ in range(r.randrange(1, 12)):
        p = r.random()
        if p < 0.7:
            body.append(f"<p>{prose(r)}</p>")
        elif p < 0.8:
            body.append(f"<h2>{words(r, r.randrange(1, 7))}</h2>")
        elif p < 0.9:
            body.extend(f"<li>{sentence(r, r.randrange(1, 20))}</li>" for _ in range(r.randrange(2, 6)))
        else:
            body.append(f"<blockquote>{prose(r)}</blockquote>")
    # a container around the article often holds boilerplate, too
    around = "" if kind == "plain" or some(0.4) else r.choice(['<main>', '<div id="content">', '<div class="main">', '<main class="content with-sidebar">'])
    if around:
        out.append(around)
    region("article", ["content", "article", "post", "entry", "story"], body, True)
    if some(0.4):
        region("aside", ["related", "recommended", "share"], [f"<h3>{words(r, 2)}</h3>", *links(r, r.randrange(2, 6))], False)
    if some(0.4):
        region("aside", ["sidebar", "side", "widget"], [f"<h3>{words(r, 2)}</h3>", *[f"<p>{sentence(r, r.randrange(5, 30))} <a href=y>{words(r, 3)}</a></p>" for _ in range(r.randrange(1, 4))]], False)
    if some(0.4) and kind != "plain":
        inside = r.choice(['<p class="comment">{}</p>', '<article class="comment"><p>{}</p></article>', '<article><p>{}</p></article>', '<div class="comment-text"><p>{}</p></div>'])
        out.append(f'<section class="{r.choice(["comments", "discussion", "replies"])}">')
        said = [sentence(r, r.randrange(2, 60)) for _ in range(r.randrange(1, 5))]
        out.append("".join(inside.format(t) for t in said) + "</section>")
        labels.extend([False] * len(said))
    if some(0.3) and kind == "elements":
        teasers = [f'<article><h3><a href="/t">{words(r, 5)}</a></h3><p>{sentence(r, r.randrange(5, 30))}</p></article>' for _ in range(r.randrange(1, 4))]
        out.append("<aside>" + "".join(teasers) + "</aside>")
        labels.extend([False, False] * len(teasers))
    if some(0.3):
        region("form", ["newsletter", "subscribe", "signup"], [f"<p>{sentence(r, r.randrange(4, 20))}</p>"], False)
    if around:
        out.append("</main>" if around.startswith("<main") else "</div>")
    if some(0.8):
        mark = "&copy; " if some(0.8) else ""
        region("footer", ["footer", "foot", "legal"], [f"<p>{mark}{words(r, r.randrange(2, 20))}</p>"], False)
    return "<html><body>" + "".join(out) + "</body></html>", labels
