"""Generated training pages: many layouts, random words, known main text."""

from __future__ import annotations

from html import escape

import numpy as np

_SYLLABLES = "an ar be ca ción de el en er es et ge ha in ing is la le lich ment na o on or ou ra re sch se st ta te th ti tion un ver é è ñ ü".split()
_MARKS = ["%%%", "***", "###", "&&&", "$$$", "!!", " |"]


def _word(rng) -> str:
    return "".join([_SYLLABLES[i] for i in rng.integers(len(_SYLLABLES), size=rng.integers(1, 5)).tolist()])


def _words(rng, low: int, high: int) -> str:
    out = [_word(rng) for _ in range(rng.integers(low, high))]
    if rng.random() < 0.1:
        mark = rng.choice(_MARKS)
        out = [w + mark for w in out]
    if rng.random() < 0.06:
        out = [w.upper() for w in out]
    return " ".join(out).capitalize() + ("" if rng.random() < 0.15 else ".")


def _pick(rng, *options):
    return options[rng.integers(len(options))]


def _links(rng, low: int = 3, high: int = 9) -> str:
    kind = rng.integers(3)
    links = [f'<a href="/{_word(rng)}">{escape(_word(rng) if rng.random() < 0.7 else _words(rng, 2, 5))}</a>' for _ in range(rng.integers(low, high))]
    return "<ul>" + "".join(f"<li>{x}</li>" for x in links) + "</ul>" if kind else " | ".join(links) if rng.random() < 0.5 else "".join(f"<div>{x}</div>" for x in links)


def _notice(rng) -> str:
    words = _pick(rng, "We use cookies", "Accept cookies", "Subscribe to our newsletter", "Sign up", "This site uses cookies", "Wir verwenden Cookies", "Ce site utilise des cookies", "Usamos cookies", "Share this", "Log in")
    name = _pick(rng, "cookie", "cookie-notice", "notice", "banner", "consent", "alert", "popup", "gdpr", "newsletter", "message")
    inner = f"<p>{words} {escape(_words(rng, 3, 25))}</p>" if rng.random() < 0.6 else f"{words} {escape(_words(rng, 3, 25))}"
    return f'<{(t := _pick(rng, "div", "aside", "section", "div"))} {_pick(rng, "class", "id")}="{name}">{inner}</{t}>'


def _advert(rng) -> str:
    name = _pick(rng, "ad", "ad", "ads", "advert", "sponsored", "promo", "banner-ad", "advertisement", "ad-slot")
    inner = escape(_words(rng, 2, 25))
    return f'<div class="{name}">{f"<p>{inner}</p>" if rng.random() < 0.4 else inner}</div>'


def _form(rng) -> str:
    return f'<form action="/x"{_pick(rng, "", " class=search", " id=subscribe")}>' + _pick(rng, f"<label>{_words(rng, 1, 4)}</label>", f"<p>{_words(rng, 2, 12)}</p>", "") + '<input name="q">' + f"<button>{_words(rng, 1, 3)}</button>" + _pick(rng, "", f"<select><option>{_word(rng)}</option><option>{_word(rng)}</option></select>") + "</form>"


def _aside(rng) -> str:
    title = f"<h3>{escape(_words(rng, 1, 4))}</h3>"
    body = _pick(rng, _links(rng), f"<p>{escape(_words(rng, 4, 40))}</p>", "".join(f"<p>{escape(_words(rng, 4, 20))}</p>" for _ in range(rng.integers(1, 4))))
    if rng.random() < 0.5:
        return f"<aside>{title}{body}</aside>"
    return f'<{(t := _pick(rng, "div", "section"))} {_pick(rng, "class", "id")}="{_pick(rng, "sidebar", "related", "widget", "side", "recommended", "sidebar-right", "tags", "share")}">{title}{body}</{t}>'


def _comments(rng) -> str:
    name = _pick(rng, "comments", "comment-list", "discussion", "responses", "reader-comments", "replies")
    one = lambda: _pick(rng, f'<div class="comment"><p>{escape(_words(rng, 3, 60))}</p></div>', f"<li class=comment><b>{_word(rng)}</b><p>{escape(_words(rng, 3, 60))}</p></li>", f"<p>{escape(_words(rng, 3, 60))}</p>", f"<article class=comment><p>{escape(_words(rng, 3, 60))}</p></article>")
    return f'<{(t := _pick(rng, "section", "div", "div"))} {_pick(rng, "class", "id")}="{name}">' + _pick(rng, "", f"<h3>{_words(rng, 1, 3)}</h3>", "<h2>Comments</h2>") + "".join(one() for _ in range(rng.integers(1, 7))) + f"</{t}>"


def generate(rng: np.random.Generator) -> tuple[str, set[str]]:
    """A page and the texts of its main blocks."""
    main: list[str] = []

    def text(low: int, high: int) -> str:
        main.append(_words(rng, low, high))
        return escape(main[-1])

    def paragraph() -> str:
        kind = rng.random()
        if kind < 0.72:
            return f"<p>{text(1, 6) if rng.random() < 0.15 else text(4, 120)}</p>"
        if kind < 0.8:
            return f"<h2>{text(1, 8)}</h2>"
        if kind < 0.86:
            return "<ul>" + "".join(f"<li>{text(2, 20)}</li>" for _ in range(rng.integers(1, 5))) + "</ul>"
        if kind < 0.9:
            return f"<blockquote>{text(4, 50)}</blockquote>"
        if kind < 0.92:
            return f"<pre>{text(3, 20)}</pre>"
        if kind < 0.94:
            return "<table><tr>" + "".join(f"<td>{text(1, 6)}</td>" for _ in range(rng.integers(1, 4))) + "</tr></table>"
        return f"<p><b>{text(2, 40)}<br>" if kind < 0.98 else f"<figure><figcaption>{text(3, 14)}</figcaption></figure>"

    title = text(2, 14)
    first = f"<p><b>{title}<br>" if rng.random() < 0.4 else ""
    body = "".join([f"<h1>{title}</h1>", first, *(paragraph() for _ in range(int(rng.integers(1, 16) if rng.random() < 0.8 else rng.integers(16, 45))))])
    for part, chance in ((_advert, 0.15), (_aside, 0.06), (_form, 0.05), (_notice, 0.05)):
        if rng.random() < chance:  # inside the article
            body += part(rng)
            if rng.random() < 0.7:
                body += f"<p>{text(4, 60)}</p>"
    name = _pick(rng, "content", "post", "article", "entry", "entry-content", "story", "main-content", "post-body", "article-body", "text")
    body = _pick(rng, f"<article>{body}</article>", f"<article>{body}</article>", f"<main>{body}</main>", f'<div class="{name}">{body}</div>', f'<div id="{name}">{body}</div>', f'<main><article class="{name}">{body}</article></main>', f"<section class={name}>{body}</section>")
    nav = lambda: _pick(rng, f"<nav>{_links(rng)}</nav>", f"<nav>{_links(rng)}</nav>", f'<div class="{_pick(rng, "menu", "nav", "navigation", "breadcrumb", "navbar", "topnav")}">{_links(rng)}</div>')
    header = lambda: _pick(rng, f"<header>{escape(_words(rng, 1, 6))}{nav() if rng.random() < 0.4 else ''}</header>", f"<header><h1>{escape(_words(rng, 1, 5))}</h1><p>{escape(_words(rng, 2, 9))}</p></header>", f'<div class="{_pick(rng, "header", "masthead", "site-header", "top")}"><p>{escape(_words(rng, 1, 9))}</p></div>')
    footer = lambda: _pick(rng, f"<footer>&copy; {_word(rng)}.example.{_pick(rng, 'com', 'org', 'net')} &middot; {escape(_words(rng, 1, 25))}</footer>", f"<footer><p>{escape(_words(rng, 2, 25))}</p>{_links(rng) if rng.random() < 0.4 else ''}</footer>", f'<div class="{_pick(rng, "footer", "site-footer", "bottom", "copyright")}">{escape(_words(rng, 2, 25))}</div>')
    some = lambda *parts: "".join(p() for p, chance in parts if rng.random() < chance)
    notice, advert, form, aside, comments = ((lambda f=f: f(rng)) for f in (_notice, _advert, _form, _aside, _comments))
    top = some((header, 0.5), (nav, 0.8), (notice, 0.3), (advert, 0.5), (form, 0.2), (aside, 0.15))
    end = some((comments, 0.4), (aside, 0.35), (advert, 0.3), (form, 0.25), (nav, 0.1), (footer, 0.85), (notice, 0.2))
    html = f"<!DOCTYPE html><html><head><title>{title}</title></head><body>{top}{body}{end}</body></html>"
    return html, {" ".join(m.split()) for m in main}
