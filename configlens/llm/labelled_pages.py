"""Labelled pages for html_extract: pages made from a grammar, whose elements say whether they are content."""

from __future__ import annotations

import random
from collections.abc import Iterator

#: The attribute that gives an element's label, and everything below it.
LABEL = "data-content"
PAGES, SEED = 1200, 11
#: Share of pages without anything around their text, or with hardly any text.
BARE = 0.1
#: Share of pages whose content is in no element that says so.
LOOSE = 0.35

#: Words of class names: of what holds the content, and those that elsewhere name what is not content.
_CONTENT_NAMES = "content post article entry story main body text".split()
_OTHER_NAMES = "sidebar side social share ad advert banner promo related more info search discussion comments nav menu header footer contact widget form notice popular follow".split()

_SYLLABLES = "an ber con de en fi ga ha in ja ka lo me no os pre qua re sta to un ver wi za".split()


def labelled_pages(count: int = PAGES, seed: int = SEED) -> Iterator[str]:
    """count pages; the same for the same seed."""
    rng = random.Random(seed)
    for _ in range(count):
        yield _page(rng)


def _words(rng: random.Random, low: int, high: int) -> str:
    return " ".join("".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(low, high)))


def _link(rng: random.Random) -> str:
    return f'<a href="/{_words(rng, 1, 1)}">{_words(rng, 1, 4)}</a>'


def _paragraph(rng: random.Random) -> str:
    words = rng.choice([(1, 4), (5, 30), (20, 90), (60, 200)])
    text = _words(rng, *words)
    if rng.random() < 0.25:
        text += f" {_link(rng)} {_words(rng, 0, 12)}"
    if rng.random() < 0.1:
        text = f"<b>{text}<br>"
    return f"<p>{text}" + "</p>" * (rng.random() < 0.9)


def _links(rng: random.Random) -> str:
    if rng.random() < 0.7:
        return "<ul>" + "".join(f"<li>{_link(rng)}</li>" for _ in range(rng.randint(1, 9))) + "</ul>"
    return " ".join(_link(rng) for _ in range(rng.randint(2, 8)))


def _body_of_article(rng: random.Random) -> str:
    parts = [f"<h1>{_words(rng, 2, 10)}</h1>"] if rng.random() < 0.85 else []
    if rng.random() < 0.15:
        parts = [f"<header>{''.join(parts)}<p>{_words(rng, 2, 8)}</p></header>"]
    for _ in range(rng.choice([1, 2, 4, 8, 14])):
        kind = rng.random()
        if kind < 0.7:
            parts.append(_paragraph(rng))
        elif kind < 0.78:
            parts.append(f"<h{rng.randint(2, 4)}>{_words(rng, 1, 8)}</h2>")
        elif kind < 0.85:
            tag = rng.choice(["ul", "ol"])
            parts.append(f"<{tag}>" + "".join(f"<li>{_words(rng, 1, 25)}" + "</li>" * (rng.random() < 0.8) for _ in range(rng.randint(1, 7))) + f"</{tag}>")
        elif kind < 0.89:
            parts.append(f"<blockquote>{_paragraph(rng)}</blockquote>")
        elif kind < 0.92:
            parts.append("<table>" + "".join(f"<tr><th>{_words(rng, 1, 2)}</th><td>{_words(rng, 1, 6)}</td></tr>" for _ in range(rng.randint(1, 5))) + "</table>")
        elif kind < 0.95:
            parts.append(f"<figure><img src=x><figcaption>{_words(rng, 2, 12)}</figcaption></figure>")
        elif kind < 0.97:
            parts.append(f"<pre>{_words(rng, 3, 30)}</pre>")
        else:
            parts.append(rng.choice(["<section>{}</section>", "<div>{}</div>"]).format(_paragraph(rng) + _paragraph(rng)))
    for _ in range(rng.choice([0, 0, 1, 1, 2])):  # what isn't content inside it
        parts.insert(rng.randint(0, len(parts)), rng.choice([_advert, _share, _aside, _notice, _form])(rng))
    if rng.random() < 0.15:
        parts.append(_comments(rng))
    if rng.random() < 0.15:
        parts.append(f"<footer {LABEL}=0>{rng.choice([_words(rng, 1, 12), _links(rng)])}</footer>")
    return "".join(parts)


def _layout(rng: random.Random) -> str:
    """The class of an element that holds the content, whose words may say something else."""
    name, other, some = rng.choice(_CONTENT_NAMES), rng.choice(_OTHER_NAMES), _words(rng, 1, 1)
    return rng.choice([f"{name} {rng.choice(['with', 'has', 'no'])}-{other}", f"{name}-{other}-{some}", f"{other}-{name}", f"{name}-{some} {other}-{some}", f"{some}-{other}", other, f"{other}-{some}-{other}", some, f"{some}-{some}"])


def _stretch(rng: random.Random) -> str:
    text = _words(rng, *rng.choice([(8, 30), (8, 30), (20, 60)]))
    return f"{text} {_link(rng)} {_words(rng, 1, 9)}" if rng.random() < 0.15 else text


def _other_body(rng: random.Random) -> str:
    """Content without p elements: text between br elements, a div each, in a font or a table."""
    parts = [_stretch(rng) for _ in range(rng.randint(3, 10))]
    kind = rng.random()
    head = f"<h{(level := rng.randint(1, 3))}>{_words(rng, 1, 8)}</h{level}>" * (rng.random() < 0.4)
    if kind < 0.35:
        return head + rng.choice(["<br><br>", "<br/><br/>", "<br>\n<br>", "<br>"]).join(parts)
    if kind < 0.65:
        return head + "".join(f"<div>{x}</div>" for x in parts)
    if kind < 0.8:
        return f"<center><font size=2>{'<br><br>'.join(parts)}</font></center>"
    if kind < 0.9:
        return f"<section>{head}{''.join(f'<div>{x}</div>' for x in parts)}</section>"
    return f"<center>{head}{''.join(f'<p>{x}</p>' for x in parts)}</center>"


def _loose(rng: random.Random) -> str:
    """An element that only its place and text show to be the content."""
    body = _other_body(rng) if rng.random() < 0.6 else "".join(f"<p>{_stretch(rng)}</p>" for _ in range(rng.randint(3, 10)))
    for _ in range(rng.choice([0, 0, 0, 1])):
        body += rng.choice([_advert, _share, _aside, _form])(rng)
    kind = rng.random()
    if kind < 0.5:
        return f'<{(tag := rng.choice(["div", "div", "div", "section"]))} {rng.choice(["class", "class", "id"])}="{_layout(rng)}" {LABEL}=1>{body}</{tag}>'
    if kind < 0.85:
        return f"<{(tag := rng.choice(['div', 'div', 'section', 'center']))} {LABEL}=1>{body}</{tag}>"
    beside = f"<td {LABEL}=0>{_links(rng)}</td>" * (rng.random() < 0.6)
    return f"<table><tr>{beside}<td {LABEL}=1>{body}</td></tr></table>"


def _advert(rng: random.Random) -> str:
    name = rng.choice(["ad", "ads", "advert", "sponsor", "promo", "banner", "ad-slot", "sponsored", "post-ad", "article-ads", "content-banner"])
    tag = rng.choice(["div", "div", "section", "aside", "p"])
    return f'<{tag} {rng.choice(["class", "id"])}="{name}" {LABEL}=0>{rng.choice([_words(rng, 3, 30), _words(rng, 20, 80), _link(rng)])}</{tag}>'


def _share(rng: random.Random) -> str:
    return f'<div class="{rng.choice(["share", "social", "share-links", "follow", "post-share", "entry-social"])}" {LABEL}=0>{_links(rng)}</div>'


def _aside(rng: random.Random) -> str:
    inner = f"<h3>{_words(rng, 1, 4)}</h3>" + rng.choice([_links(rng), _paragraph(rng), _links(rng) + _paragraph(rng)])
    if rng.random() < 0.5:
        return f"<aside {LABEL}=0>{inner}</aside>"
    return f'<div class="{rng.choice(["sidebar", "widget", "related", "side", "recommended", "trending", "related-posts", "more-stories", "sidebar-content", "story-related"])}" {LABEL}=0>{inner}</div>'


def _notice(rng: random.Random) -> str:
    name = rng.choice(["cookie", "notice", "consent", "cookie-banner", "alert", "popup", "modal", "gdpr"])
    return f'<{(tag := rng.choice(["div", "section", "p", "div"]))} class="{name}" {LABEL}=0>{_words(rng, 4, 40)} {_link(rng)}<button>OK</button></{tag}>'


def _form(rng: random.Random) -> str:
    inner = f"<label>{_words(rng, 1, 3)}</label><input name=q><p>{_words(rng, 2, 15)}</p><button>{_words(rng, 1, 2)}</button>"
    if rng.random() < 0.7:
        return f"<form {LABEL}=0>{inner}</form>"
    return f'<div class="{rng.choice(["newsletter", "subscribe", "login", "search-form", "signup", "contact-form", "post-newsletter"])}" {LABEL}=0>{inner}</div>'


def _comments(rng: random.Random) -> str:
    one = lambda: rng.choice(['<div class="comment">{}</div>', "<li>{}</li>", "<article>{}</article>", '<article class="comment">{}</article>']).format(_paragraph(rng) + f"<p>{_words(rng, 2, 20)}</p>")
    inner = f"<h2>{_words(rng, 1, 3)}</h2>" + "".join(one() for _ in range(rng.randint(1, 6)))
    tag = rng.choice(["section", "div", "ol", "ul", "aside"])
    return f'<{tag} {rng.choice(["class", "id"])}="{rng.choice(["comments", "comment-list", "comments-area", "discussion", "replies", "reader-comments", "post-comments", "article-discussion"])}" {LABEL}=0>{inner}</{tag}>'


def _bare(rng: random.Random) -> str:
    """A page that is nothing but its text, some with tags left out."""
    text = "".join(f"<p>{_words(rng, 30, 200)}" + "</p>" * (rng.random() < 0.8) for _ in range(rng.choice([1, 1, 2, 3])))
    if rng.random() < 0.4:
        text = _other_body(rng)
        text = text if rng.random() < 0.5 else f"<div>{text}</div>"
    head = f"<h1>{_words(rng, 2, 8)}</h1>" * (rng.random() < 0.5)
    return f"<!DOCTYPE html><html><head><title>x</title></head><body {LABEL}=1>{head}{text}</body></html>"


def _tiny(rng: random.Random) -> str:
    """A page whose article is a word or two, even of a letter."""
    some = lambda: rng.choice([_words(rng, 1, 3), rng.choice("abcdefgh"), rng.choice("abcdefgh") + rng.choice("xyz")])
    tag = rng.choice(["article", "article", "main", 'div class="content"'])
    body = rng.choice(["", f"<h1>{some()}</h1>"]) + "".join(rng.choice(["<p>{}</p>", "<p>{}</p>", "{}", "<ul><li>{}</li></ul>"]).format(some()) for _ in range(rng.randint(1, 3)))
    before, after = (rng.choice(["", make(rng)]) for make in (lambda rng: f"<nav {LABEL}=0>{rng.choice([some(), _links(rng)])}</nav>", rng.choice([_comments, _form, _advert])))
    return f"<body>{before}<{tag} {LABEL}=1>{body}</{tag.split()[0]}>{after}</body>"


def _page(rng: random.Random) -> str:
    if rng.random() < BARE:
        return rng.choice([_bare, _tiny])(rng)
    parts = []
    if rng.random() < 0.5:
        parts.append(f"<header {LABEL}=0>{rng.choice([_words(rng, 1, 6), f'<h1>{_words(rng, 1, 4)}</h1>', _links(rng), f'<p>{_words(rng, 2, 12)}</p>'])}</header>")
    elif rng.random() < 0.15:
        parts.append(f"<div {LABEL}=0>{rng.choice([_words(rng, 1, 6), f'<h1>{_words(rng, 1, 4)}</h1>'])}</div>")
    elif rng.random() < 0.3:
        parts.append(f'<div class="{rng.choice(["header", "masthead", "topbar", "branding"])}" {LABEL}=0>{_words(rng, 1, 8)}</div>')
    if rng.random() < 0.8:
        parts.append(f"<nav {LABEL}=0>{_links(rng)}</nav>")
    elif rng.random() < 0.3:
        parts.append(f"<div {LABEL}=0>{_links(rng)}</div>")
    elif rng.random() < 0.7:
        parts.append(f'<{(tag := rng.choice(["div", "ul"]))} class="{rng.choice(["menu", "nav", "navbar", "breadcrumbs"])}" {LABEL}=0>{_links(rng)}</{tag}>')
    for make, share in ((_notice, 0.3), (_advert, 0.5), (_form, 0.2)):
        if rng.random() < share:
            parts.append(make(rng))
    body = _body_of_article(rng)
    shape, whole = rng.random(), rng.random() < 0.12
    if whole:
        body = body + _paragraph(rng) if rng.random() < 0.5 else _other_body(rng)
    elif rng.random() < LOOSE:
        body = _loose(rng)
    elif shape < 0.45:
        body = f"<article {LABEL}=1>{body}</article>"
    elif shape < 0.55:
        body = f"<main {LABEL}=1>{body}</main>"
    elif shape < 0.67:
        body = f"<main {LABEL}=1><article>{body}</article></main>"
    elif shape < 0.86:
        body = f'<div {rng.choice(["class", "id"])}="{rng.choice(["content", "post", "article-body", "entry-content", "story", "main-content", "post-text"])}" {LABEL}=1>{body}</div>'
    else:
        body = f"<div {LABEL}=1>{body + ''.join(_paragraph(rng) for _ in range(4))}</div>"
    if rng.random() < 0.25 and not whole:
        body = f'<div class="{_layout(rng)}">{body}</div>' if rng.random() < 0.5 else f"<div>{body}</div>"
    parts.append(body)
    tail = [make(rng) for make, share in ((_comments, 0.35), (_aside, 0.4), (_advert, 0.3), (_share, 0.2), (_form, 0.2), (_notice, 0.15)) if rng.random() < share]
    rng.shuffle(tail)
    parts += tail
    if rng.random() < 0.85:
        footer = rng.choice([f"&copy; {_words(rng, 2, 25)}", f"<p>{_words(rng, 3, 20)}</p>", _links(rng)])
        name = rng.choice(["footer", "footer", "site-footer", "footer-content", "legal"])
        parts.append(rng.choice(["<footer {1}=0>{0}</footer>"] * 8 + ['<div class="{2}" {1}=0>{0}</div>', '<div class="{2}" {1}=0>{0}</div>', "<div {1}=0>{0}</div>"]).format(footer, LABEL, name))
    return f"<!DOCTYPE html><html><head><title>x</title></head><body{f" {LABEL}=1" * whole}>" + "".join(parts) + "</body></html>"
