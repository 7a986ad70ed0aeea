"""Main text of ordinary pages against hand-written texts, and the rules of the docstring restated over a parsed tree."""

import random
import re
from html.parser import HTMLParser

import pytest

from barloom.llm import html_extract as x

SAY = [
    "It was in the spring of that year that they came to the town, and all of them had been on the road for more than a month now.",
    "He said that there was nothing to be done about it, and that it would be the same for all who came after them in the end.",
    "She had been to the sea with her mother when she was a child, but that was so long ago that she could not be sure of it.",
    "They were not the first to try this, and it is said that some of those who went up by the old path have not been seen again.",
    "If you can read this on the wall then the light has come in at the door, which is what it does in the first days of the year.",
]
P = lambda *k: "".join(f"<p>{SAY[i % 5]}</p>" for i in k)
T = lambda *k: "\n".join(SAY[i % 5] for i in k)
NAV = '<nav><a href="/">Home</a></nav>'
CASES = {
    "short paragraphs in a div": (f"{NAV}<div id=content>{P(*range(10))}</div><footer>All rights are with the owner.</footer>", T(*range(10))),
    "short paragraphs in the body": (f"<body>{NAV}{P(*range(10))}</body>", T(*range(10))),
    "list items": ("<ul>" + "".join(f"<li>{SAY[k % 5]}</li>" for k in range(20)) + "</ul>", T(*range(20))),
    "headings between": ("<h2>One</h2>" + P(0) + "<h2>Two</h2>" + P(1), f"One\n{SAY[0]}\nTwo\n{SAY[1]}"),
    "one paragraph": (NAV + P(0) + '<div><a href="/a">One of the many links of this page</a> <a href="/b">and another one of the links here</a></div>', SAY[0]),
    "tiny paragraphs": ("<div><p>I have been here.</p><p>So have I, and not just once.</p></div>", "I have been here.\nSo have I, and not just once."),
    "article beside more": (f"<div>{P(0, 1, 2)}</div><article>{P(0, 1, 2, 3)}</article><div>{P(3, 4, 0)}</div>", T(0, 1, 2, 3)),
    "teaser card": (f"<div>{P(0, 1, 2, 3, 4)}</div><article><h3>More</h3><p>Read it here.</p></article>", T(*range(5)) + "\nMore\nRead it here."),
    "two articles": (f"<article>{P(0, 1)}</article><article>{P(2, 3)}</article>", T(0, 1, 2, 3)),
    "main with a list": (f"<main>{P(0)}<ul><li>Alpha</li><li>Beta</li></ul>{P(1)}</main>", f"{SAY[0]}\nAlpha\nBeta\n{SAY[1]}"),
    "comments after an article": (f"<article>{P(0, 1)}</article><section id=comments>{P(*range(8))}</section>", T(0, 1)),
    "comments in the article": (f"<article>{P(0, 1)}<div class=comments>{P(*range(8))}</div></article>", T(0, 1)),
    "comments in main": (f"<main>{P(0, 1)}<div class='comments'>{P(*range(8))}</div></main>", T(0, 1)),
    "comment as an article": (f"<article>{P(0, 1)}</article>" + "".join(f"<article class='comment odd'>{P(k)}</article>" for k in range(5)), T(0, 1)),
    "comment as an article by part": (f"<main>{P(0, 1)}<article class='comment-body'>{P(2, 3, 4)}</article></main>", T(0, 1)),
    "user comments": (f"<main>{P(0, 1)}<div class='user-comments'>{P(2, 3, 4)}</div></main>", T(0, 1)),
    "comments by hump": (f"<main>{P(0, 1)}<div class='commentSection'>{P(2, 3, 4)}</div></main>", T(0, 1)),
    "cookie banner": (f"<main><div class='cookie-banner'>{P(4)}</div>{P(0, 1)}</main>", T(0, 1)),
    "long notice": (f"<div class=notice>{P(*range(9))}</div><div>{P(0, 1)}</div>", T(0, 1)),
    "advert inside": (f"<article>{P(0)}<div class='ad-slot'>{P(3)}</div>{P(1)}</article>", T(0, 1)),
    "sponsored": (f"<article>{P(0)}<div class='box sponsored'>{P(3, 4)}</div>{P(1)}</article>", T(0, 1)),
    "inline advert": (f"<article><p>{SAY[0]} <span class=ad>Buy it now.</span></p>{P(1)}</article>", T(0, 1)),
    "article that allows comments": (f"<article class='post comments-open'>{P(0, 1)}</article>", T(0, 1)),
    "layout free of adverts": (f"<div class='content ad-free'>{P(0, 1)}</div>", T(0, 1)),
    "layout with comments": (f"<div class='page has-comments'>{P(0, 1)}</div>", T(0, 1)),
    "layout named by a part": (f"<div class='ad-layout'><article>{P(0, 1)}</article></div>", T(0, 1)),
    "sidebar": (f"<div class=page><div class=sidebar>{P(4)}</div><div class='text with-sidebar'>{P(0, 1, 2)}</div></div>", T(0, 1, 2)),
    "header class around all": (f"<div class='page header'>{P(0, 1, 2)}</div>", T(0, 1, 2)),
    "links only": ("<div><a href=/a>" + SAY[0] + "</a></div>", ""),
    "references": ("<p>" + SAY[0].replace("and", "&amp;") + "&nbsp;&#8364;</p>" + P(1), SAY[0].replace("and", "&") + " €\n" + SAY[1]),
    "empty": ("<html><body></body></html>", ""),
}


@pytest.mark.parametrize("name", CASES)
def test_main_text_of_ordinary_pages(name):
    html, want = CASES[name]
    assert x.main_text(html) == want


def test_tiny_paragraphs_of_fewer_words_stay_where_something_decides():
    assert x.main_text("<article>" + P(0) + "<p>Yes.</p></article>") == SAY[0] + "\nYes."


class Tree(HTMLParser):
    """Well-formed pages as nested lists: [tag, attributes, children]."""

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.root = ["root", {}, []]
        self.open = [self.root]
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = [tag, dict(attrs), []]
        self.open[-1][2].append(node)
        self.open.append(node)

    def handle_endtag(self, tag):
        self.open.pop()

    def handle_data(self, data):
        self.open[-1][2].append(data)


def plain_main_text(html):
    """The docstring's rules, one after the other, over the tree; every step reads all blocks."""
    names_of = lambda n: [re.sub(r"([a-z0-9])([A-Z])", r"\1-\2", v).lower() for k in ("class", "id") for v in n[1].get(k, "").split()]
    words = lambda n: re.split("[^a-z0-9]+", n)
    whole = lambda n, marks: n in marks or re.split("__|--", n)[0] in marks
    part = lambda n, marks: set(words(n)) & marks and not set(words(n)) & x.STATES
    texts, blocks = [], []

    def below(node):
        return [node, *(m for c in node[2] if not isinstance(c, str) and kind(c) != "drop" for m in below(c))]

    def kind(node):
        tag, names = node[0], names_of(node)
        if tag in x.DROPPED:
            return "drop"
        if tag in ("html", "body", "main", "root"):
            return ""
        if tag == "article":
            return "drop" if any(whole(n, x.COMMENTS) or part(n, x.COMMENTS) for n in names) else ""
        if set(node[1].get("role", "").lower().split()) & x.ROLES:
            return "drop"
        if any(whole(n, x.FINAL) for n in names):
            return "drop"
        if any(part(n, x.FINAL) for n in names):
            return "final part" if tag in x.BLOCK else ""
        if any(whole(n, x.MARKS) for n in names):
            return "mark" if tag in x.BLOCK else "drop"
        if tag not in x.BLOCK:
            return ""
        return "part" if any(set(words(n)) & x.MARKS for n in names) else ""

    def cut():
        text = " ".join("".join(t for t, *_ in texts).split())
        if text:
            linked = len(" ".join("".join(t for t, link, *_ in texts if link).split()))
            path = texts[-1][2] if texts else ()
            path = next((p for t, _, p in texts if t.strip()), path)
            blocks.append({"text": text, "linked": linked, "path": path})
        texts.clear()

    def walk(node, path):
        path = (*path, node)
        if kind(node) == "drop":
            if node[0] in x.BLOCK:
                cut()
            return
        if node[0] in x.BLOCK:
            cut()
        for c in node[2]:
            if isinstance(c, str):
                texts.append((c, any(p[0] == "a" for p in path), path))
            else:
                walk(c, path)
        if node[0] in x.BLOCK:
            cut()

    walk(Tree(html).root, ())
    for b in blocks:
        b["tags"] = [p[0] for p in b["path"]]
        b["own"] = max(0, len(b["text"]) - b["linked"])
        b["few links"] = b["linked"] <= x.MAX_LINKS * len(b["text"])
        b["prose"] = b["own"] if b["few links"] and ("p" in b["tags"] or len(b["text"]) >= x.SHORT) else 0
        b["main"] = next((id(p) for p in b["path"] if p[0] in ("article", "main")), None)
    gone = set()
    all_prose, all_mains = sum(b["prose"] for b in blocks), sum(b["own"] for b in blocks if b["main"])
    for node in {id(p): p for b in blocks for p in b["path"]}.values():
        inside = [b for b in blocks if any(p is node for p in b["path"])]
        k, prose, titled = kind(node), sum(b["prose"] for b in inside), any("h1" in b["tags"] for b in inside)
        mains = sum(b["own"] for b in inside if b["main"])
        holds = any(n[0] in ("article", "main") for n in below(node)[1:])
        if k == "final part" and not titled and not holds or k == "part" and not prose and not titled or k == "mark" and 2 * prose <= all_prose and (mains < x.LONG or 2 * mains <= all_mains):
            gone.add(id(node))
    blocks = [b for b in blocks if not any(id(p) in gone for p in b["path"])]
    for k, b in enumerate(blocks):
        b["at"] = k
    deciding = set()
    for m in {b["main"] for b in blocks} - {None}:
        own = [b for b in blocks if b["main"] == m]
        prose = sum(b["prose"] for b in own)
        if prose and (prose > x.LONG or any("h1" in b["tags"] for b in own) or 2 * sum(b["own"] for b in own) >= sum(b["own"] for b in blocks)):
            deciding.add(m)
    if deciding:
        blocks = [b for b in blocks if b["main"] in deciding]  # those outside are bad, and no neighbours
    for b in blocks:
        b["stops"] = share(b["text"])
    return blocks, deciding


def share(text):
    words = re.findall(r"[^\W\d_]+", text.lower())
    return sum(w in x.STOP_WORDS for w in words) / max(1, len(words))


def plain_labels(blocks, deciding, everything):
    known = any(b["stops"] >= x.FEW_STOPS for b in everything if len(b["text"]) >= x.SHORT and b["few links"])
    medium = []
    for b in blocks:
        n, many = len(b["text"]), b["stops"] >= x.MANY_STOPS or not known
        if not b["few links"]:
            b["label"] = "bad"
        elif n < x.SHORT:
            b["label"] = ""
        elif many:
            b["label"] = "good" if n > x.LONG or deciding else ""
            if not b["label"]:
                medium.append(b)
        else:
            b["label"] = "" if b["stops"] >= x.FEW_STOPS or deciding else "bad"
    if not any(b["label"] == "good" for b in blocks):
        longer = [b for b in blocks if len(b["text"]) >= x.SHORT]
        paired = [b for k, b in enumerate(longer) if b in medium and ((k and longer[k - 1] in medium) or (k + 1 < len(longer) and longer[k + 1] in medium))]
        for b in paired or medium:
            b["label"] = "good"
        if not medium:
            for b in blocks:
                if "p" in b["tags"] and not b["label"] and len(b["text"].split()) >= x.PLAIN and (b["stops"] >= x.MANY_STOPS or not known):
                    b["label"] = "good"
    first = [b["label"] for b in blocks]
    for k, b in enumerate(blocks):
        if not first[k]:
            near = [(abs(b["at"] - blocks[j]["at"]), v) for j, v in enumerate(first) if v]
            best = [v for d, v in near if d == min(near)[0]]
            b["label"] = "good" if "good" in best or (not best and deciding) else "bad"
    return "\n".join(b["text"] for b in blocks if b["label"] == "good")


def some_page(rng):
    names = ["", "", "", "comments", "user-comments", "has-comments", "ad", "ad-slot", "ad-free", "sidebar", "with-sidebar", "menu", "post", "cookie-banner", "post__body", "comment--new", "header"]
    attr = lambda: f' {rng.choice(["class", "id"])}="{n}"' if (n := rng.choice(names)) else ""
    line = lambda: rng.choice([SAY[rng.randrange(5)], SAY[0] + " " + SAY[1], "A few words.", "and so it is with all of them", "Alpha beta gamma delta " * rng.choice([1, 5, 12]), ""])

    def inline():
        return "".join(rng.choice([line(), f"<b>{line()}</b>", f"<a href='/x'>{rng.choice(['More', line()])}</a>", f"<span{attr()}>{line()}</span>", " "]) for _ in range(rng.choice([1, 1, 2])))

    def node(depth):
        tag = rng.choice(["p", "p", "p", "div", "section", "ul", "h2", "h1", "article", "main", "nav", "footer"] if depth else ["p", "h2", "p"])
        if tag in ("p", "h1", "h2"):
            return f"<{tag}{attr() if rng.random() < 0.1 else ''}>{inline()}</{tag}>"
        if tag == "ul":
            return "<ul>" + "".join(f"<li>{inline()}</li>" for _ in range(rng.randrange(1, 4))) + "</ul>"
        return f"<{tag}{attr()}>" + "".join(node(depth - 1) for _ in range(rng.randrange(1, 5))) + f"</{tag}>"

    return "<html><body>" + "".join(node(3) for _ in range(rng.randrange(1, 5))) + "</body></html>"


def test_random_pages_equal_the_rules_restated():
    rng, kept = random.Random(7), 0
    for _ in range(3000):
        html = some_page(rng)
        blocks, deciding = plain_main_text(html)
        # whether the page has known stop words is asked of all blocks, also of those outside an article
        everything = [{"text": b.text, "few links": b.linked <= x.MAX_LINKS * len(b.text), "stops": share(b.text)} for b in x.blocks_of(html)]
        want = plain_labels(blocks, deciding, everything)
        assert x.main_text(html) == want, html
        kept += bool(want)
    assert kept > 1500
