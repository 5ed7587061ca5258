"""Labelled pages that the content model is trained on: page layouts of many kinds, written by rule.

Every element that holds part of the article has the attribute ``data-y="1"``; the model's features never see it.

On a part of the pages the names in class and id mean something, on others they are made up, missing, or misleading (an
article of class ``sports-form``): ``renamed`` replaces them, so labels don't follow from names alone.
"""

from __future__ import annotations

import random
import re

SYLLABLES = "ka lo mi ten dor vas el un per rin sta gor ne phi qua bel".split()


def words(r: random.Random, lo: int, hi: int) -> str:
    return " ".join("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(r.randint(lo, hi)))


def sentences(r: random.Random, lo: int, hi: int) -> str:
    return " ".join(words(r, 4, 18).capitalize() + r.choice([".", ".", ".", "?", ","]) for _ in range(r.randint(lo, hi)))


def menu(r: random.Random, n: int) -> str:
    items = "".join(f'<li><a href="/{i}">{words(r, 1, 2)}</a></li>' for i in range(n))
    return f"<ul>{items}</ul>" if r.random() < 0.7 else "".join(f'<a href="/{i}">{words(r, 1, 2)}</a> | ' for i in range(n))


def article(r: random.Random) -> str:
    y = ' data-y="1"'
    title = words(r, 3, 12)
    out = [f"<h1{y}>{title}</h1>"] if r.random() < 0.85 else []
    for _ in range(r.choice([1, 2, 3, 5, 8, 12])):
        kind = r.random()
        if kind < 0.68:
            text = sentences(r, 1, 8) if r.random() < 0.85 else words(r, 1, 5)
            if r.random() < 0.15:
                text = f"<b>{text}<br>"  # left open, as pages do
            elif r.random() < 0.2:
                text += f' <a href="/x">{words(r, 1, 4)}</a> {words(r, 2, 9)}.'
            out.append(f"<p{y}>{text}</p>" if r.random() < 0.8 else f"<p{y}>{text}")
        elif kind < 0.76:
            out.append(f"<h{r.randint(2, 4)}{y}>{words(r, 1, 7)}</h{r.randint(2, 4)}>")
        elif kind < 0.82:
            out.append(f"<ul{y}>" + "".join(f"<li{y}>{words(r, 2, 14)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
        elif kind < 0.87:
            out.append(f"<blockquote{y}><p{y}>{sentences(r, 1, 3)}</p></blockquote>")
        elif kind < 0.9:
            out.append(f"<table{y}>" + "".join(f"<tr{y}><td{y}>{words(r, 1, 3)}</td><td{y}>{words(r, 1, 5)}</td></tr>" for _ in range(3)) + "</table>")
        elif kind < 0.93:
            out.append(f"<div{y}><p{y}>{sentences(r, 1, 4)}</p></div>")
        elif kind < 0.95:
            out.append(f"<pre{y}>{words(r, 4, 20)}</pre>")
        else:
            out.append(aside(r))
    return "".join(out)


def aside(r: random.Random) -> str:
    """Something inside or beside the article that is not part of it."""
    text = sentences(r, 1, 4)
    return r.choice(
        [
            f'<div class="{r.choice(["ad", "ads", "advert", "ad-slot", "sponsored", "promo", "banner-ad", "advertisement"])}">{r.choice([text, "<p>" + text + "</p>", words(r, 1, 6)])}</div>',
            f'<div class="{r.choice(["share", "social", "share-buttons", "related", "related-posts", "newsletter", "subscribe", "tags", "breadcrumb"])}">{r.choice([menu(r, 4), "<p>" + text + "</p>"])}</div>',
            f"<aside>{r.choice([menu(r, 5), '<h3>' + words(r, 1, 3) + '</h3><p>' + text + '</p>', text])}</aside>",
            f'<form action="/s"><label>{words(r, 1, 3)}</label><input name="q"><p>{words(r, 1, 9)}</p><button>{words(r, 1, 1)}</button></form>',
            f'<div id="{r.choice(["cookie-notice", "notice", "consent", "cookie", "gdpr", "alert", "disclaimer", "popup", "modal"])}"><p>{text}</p><a href="#">ok</a></div>',
        ]
    )


def comments(r: random.Random) -> str:
    each = lambda: r.choice([f'<div class="comment"><p>{sentences(r, 1, 4)}</p></div>', f'<li class="comment"><b>{words(r, 1, 2)}</b> {sentences(r, 1, 3)}</li>', f'<article class="comment"><p>{sentences(r, 1, 3)}</p></article>'])
    body = "".join(each() for _ in range(r.randint(1, 5)))
    return r.choice([f'<section id="comments"><h2>{words(r, 1, 3)}</h2>{body}</section>', f'<div class="{r.choice(["comments", "comment-list", "discussion", "replies"])}">{body}</div>'])


#: Names that sites give to elements of any kind, whatever their parts say.
ANY = "wrapper inner box row col block unit region layer panel grid zone card side nav form alert header footer menu sports page fixed open top post text note list item left right".split()
NAMED = re.compile(r' (class|id)="([^"]*)"')


def renamed(r: random.Random, source: str, kind: str) -> str:
    """The page with other names: invented or none in place of its own, or made up ones on the article beside its own."""
    if kind == "none":
        return NAMED.sub("", source)
    made = lambda: "-".join(r.choice([words(r, 1, 1), r.choice(ANY)]) for _ in range(r.randint(1, 3))).replace(" ", "")
    if kind == "invented":
        known: dict[str, str] = {}
        source = NAMED.sub(lambda m: f' {m[1]}="{known.setdefault(m[2], words(r, 1, 1))}"', source)
    if kind != "own":
        source = re.sub(r"<(article|main|div|section|p)( data-y)", lambda m: f'<{m[1]} class="{made()}"{m[2]}' if r.random() < 0.5 else m[0], source)
        source = re.sub(r"<body>", lambda m: f'<body class="{made()}">' if r.random() < 0.5 else m[0], source)
    return source


def page(seed: int, names: str | None = None) -> str:
    """A page; names: own, mixed, invented or none (by the seed if not given)."""
    r = random.Random(seed)
    names = names or r.choice(["own", "own", "mixed", "mixed", "mixed", "invented", "none"])
    y = ' data-y="1"'
    top = r.choice(
        [
            f"<nav>{menu(r, r.randint(3, 8))}</nav>",
            f"<header><h1>{words(r, 1, 3)}</h1><p>{words(r, 3, 9)}</p><nav>{menu(r, 4)}</nav></header>",
            f'<div class="{r.choice(["menu", "navbar", "header", "top-bar", "site-header", "nav"])}">{menu(r, r.randint(3, 8))}</div>',
            f'<header>{words(r, 1, 5)}</header><div id="nav">{menu(r, 5)}</div>',
            f"{menu(r, 6)}",
        ]
    )
    body = article(r)
    main = r.choice(
        [
            f"<article{y}>{body}</article>",
            f"<article{y}>{body}</article>",
            f"<main{y}>{body}</main>",
            f"<main{y}><article{y}>{body}</article></main>",
            f'<div class="{r.choice(["content", "post", "entry-content", "article-body", "story", "main-content", "post-body"])}"{y}>{body}</div>',
            f'<div id="{r.choice(["content", "main", "article"])}"{y}>{body}</div>',
            f"<div{y}>{body}</div>",
            f"<section{y}>{body}</section>",
            body,
        ]
    )
    beside = "".join(aside(r) for _ in range(r.randint(0, 2)))
    side = r.choice(["", f'<div class="{r.choice(["sidebar", "side", "widget", "right-rail"])}"><h3>{words(r, 1, 3)}</h3>{menu(r, 5)}<p>{sentences(r, 1, 3)}</p></div>', f"<aside><h2>{words(r, 1, 3)}</h2><p>{sentences(r, 1, 4)}</p></aside>"])
    end = r.choice(
        [
            f"<footer>&copy; {words(r, 1, 3)} &middot; {sentences(r, 1, 2)}</footer>",
            f"<footer><p>{sentences(r, 1, 3)}</p>{menu(r, 4)}</footer>",
            f'<div class="{r.choice(["footer", "site-footer", "copyright", "bottom"])}">{r.choice([menu(r, 4), "<p>" + sentences(r, 1, 3) + "</p>"])}</div>',
            f'<footer class="footer">{words(r, 2, 9)}</footer>',
        ]
    )
    parts = [top, beside, main, *([comments(r)] if r.random() < 0.4 else []), side, end]
    if r.random() < 0.3:
        parts[1], parts[-2] = side, beside
    inner = "".join(parts)
    wrap = r.choice(["{}", "{}", '<div class="wrapper">{}</div>', '<div id="page"><div class="container">{}</div></div>', "<div>{}</div>"])
    inner = renamed(r, inner, names)
    return f"<!DOCTYPE html><html><head><title>{words(r, 2, 6)}</title><style>p{{}}</style><script>var a='</p>';</script></head><body>{wrap.format(inner)}</body></html>"
