"""Main text of web pages by two passes of rules over blocks.

A page is cut into blocks at block-level tags. Pass one classifies each block by link density, length and the share of
stop words: good, bad, or undecided (short blocks; blocks between the two stop-word limits; and, inside an ``article``
or ``main``, blocks of any length with few stop words, such as lists and tables). Outside those, only blocks of more than LONG
characters are good by themselves; where a page has none, blocks of SHORT to LONG characters with many stop words make
their neighbours of the same kind good (a page in short paragraphs), or, if no two are neighbours, count alone; where it has
none of these either, paragraphs of at least PLAIN words do. Pass two gives each undecided block the label of the nearest
decided neighbour, looking both ways; if both are as near, good wins; if no block is decided, the blocks of an article
are good and all others bad.

Before the passes, what is never main text by its markup is dropped: scripts, styles, forms and the like by tag;
menus, headers, footers and sidebars by tag, role, or the names in class and id; comments, notices and adverts by those names,
however long they are. A name is a mark if it is one of MARKS or FINAL as a whole (or its BEM block is). A mark of FINAL always
drops what it names, an ``article`` too if it is a reader's comment; a name of which such a mark is one word
(``user-comments``) does so unless it states something of what it holds (``has-comments``, ``ad-free``) or holds an article, a
main or an h1. A mark of MARKS drops a container unless that holds most of the page's prose or of its articles; a name of which one is
only a part (``with-sidebar``) drops a container only if it holds neither prose nor an ``h1``; inline tags are dropped by marks
only, whatever they hold. A ``main`` with prose, and an ``article`` that has an h1, more than LONG characters of prose, or half of the
page's text outside links, decide: blocks outside them are bad. Otherwise they don't count. On a page without any block that
has enough stop words of the known languages, length decides instead.

Defined cases: null and empty html, and pages without a good block, give the empty text; unclosed and stray tags and
comments are tolerated (an end tag closes what is open inside it; an unclosed comment or script runs to the end); a
``<`` that begins no tag is text; pages may be of any length; rows are independent, so repeated rows come out alike;
an empty table gives an empty result; other columns pass through ``extract_text`` (``text`` is replaced).
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from barloom.llm.common import fresh, table

# Common function words.
STOP_WORDS = frozenset(
    """
    the of and to in a is that it for was on with as by at be this are from or an not but they he she his her we you
    have had has which their were been one all there would will what so if can out up who into no more when some them
    der die das und ist in den von zu mit dem des im nicht ein eine als auch es an auf für sich aus er sie hat dass bei
    wird sind noch nach wie einem einer am um so zum haben nur oder aber vor zur bis mehr durch man sein wurde war
    le la les de des du un une et est en que qui dans pour pas sur au aux avec par ce il elle on ne se sont plus son sa
    ses ou mais comme nous vous cette été leur ont être fait si y
    el los las del una unos y en es por con para como se su al lo más o pero sus le ya este sí porque esta entre cuando
    muy sin sobre también me hasta hay donde quien desde todo nos durante
    """.split()
)

MAX_LINKS = 0.3  # share of a block's characters inside links
SHORT, LONG = 70, 200  # characters
PLAIN = 5  # words
FEW_STOPS, MANY_STOPS = 0.15, 0.25  # share of a block's words

# Tags by their part in a page.
DROPPED = frozenset("script style noscript template head title nav header footer aside form button select option textarea iframe object svg canvas dialog menu".split())
RAW = frozenset("script style noscript template textarea iframe title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article blockquote body center dd div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html li main ol p pre section table tbody td tfoot th thead tr ul".split()
) | DROPPED
MAIN = frozenset(("article", "main"))
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
# Words of class and id that mark what is not main text.
MARKS = frozenset(
    """
    menu nav navbar navigation breadcrumb breadcrumbs header masthead footer sidebar aside rail widget widgets share sharing
    social related recommended login signup search form pagination pager toolbar skip
    """.split()
)
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond".split())
FINAL = COMMENTS | frozenset(
    """
    ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion notice notices cookie cookies consent
    gdpr banner popup modal overlay newsletter subscribe subscription
    """.split()
)
# Words beside a mark that say how a page is laid out, not what a container is.
STATES = frozenset("with without has have had is no not non free on off open opened closed enabled disabled allow allowed show hide hidden js after before below above count counter link links".split())

# possessive throughout: an attempt reads each character once, whether it matches or not
_MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+)>|<(?P<odd_end>/?)(?P<odd>[a-zA-Z][^\s/>]*+)(?P<odd_rest>[^>]*+)>""", re.S
)
_ATTRIBUTE = re.compile(r"""(?i)\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
_WORD = re.compile(r"[^\W\d_]+")
_HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


class Block:
    __slots__ = ("label", "linked", "main", "own", "paragraph", "prose", "text", "title", "within")

    def __init__(self, text: str, linked: int, main: int, paragraph: bool, title: bool, within: int):
        self.text, self.linked, self.label = text, linked, ""
        self.main = main  # the outermost article or main that holds it, or -1
        self.paragraph, self.title = paragraph, title
        self.own = max(0, len(text) - linked)  # characters outside links
        self.prose = self.own if linked <= MAX_LINKS * len(text) and (paragraph or len(text) >= SHORT) else 0
        self.within = within  # the innermost marked container that holds it, or -1


def _final(names: list[str], words: frozenset) -> str:
    """Whether a name is a mark as a whole, or has one among its words without saying how the page is laid out."""
    found = ""
    for n in names:
        parts = re.split(r"[^a-z0-9]+", n)
        if n in words or re.split("__|--", n)[0] in words:
            return "always"
        if words.intersection(parts) and not STATES.intersection(parts):
            found = "final part"
    return found


def _dropped(tag: str, rest: str) -> str:
    """always; mark: by a class or id that is a mark; final part, part: that has one among its words; or nothing."""
    if tag in DROPPED:
        return "always"
    if tag in ("html", "body", "main") or "=" not in rest:
        return ""
    found = ""
    for name, value in _ATTRIBUTE.findall(rest):
        names = _HUMP.sub("-", value.strip("\"'")).lower().split()
        if tag == "article":
            if name.lower() != "role" and _final(names, COMMENTS):
                return "always"
        elif name.lower() == "role":
            if ROLES.intersection(names):
                return "always"
        elif kind := _final(names, FINAL):
            if kind == "always":
                return kind
            found = kind
        elif found in ("", "part") and any(n in MARKS or re.split("__|--", n)[0] in MARKS for n in names):
            found = "mark"
        elif not found and any(MARKS.intersection(re.split(r"[^a-z0-9]+", n)) for n in names):
            found = "part"
    return found


def _without_marked(blocks: list[Block], kinds: list[str], outer: list[int], titles: set[int], articles: set[int]) -> list[Block]:
    """The blocks outside the marked containers that are to be dropped. A container comes after those that hold it."""
    holds = [k in articles for k in range(len(kinds))]
    prose, mains, title = [0] * len(kinds), [0] * len(kinds), [k in titles for k in range(len(kinds))]
    for b in blocks:
        if b.within >= 0:
            prose[b.within] += b.prose
            mains[b.within] += b.own * (b.main >= 0)
    for k in range(len(kinds) - 1, -1, -1):
        if outer[k] >= 0:
            prose[outer[k]] += prose[k]
            mains[outer[k]] += mains[k]
            title[outer[k]] |= title[k]
            holds[outer[k]] |= holds[k]
    all_prose, all_mains = sum(b.prose for b in blocks), sum(b.own for b in blocks if b.main >= 0)
    gone: list[bool] = []
    for k, kind in enumerate(kinds):
        if outer[k] >= 0 and gone[outer[k]]:
            gone.append(True)
        elif kind == "final part":
            gone.append(not title[k] and not holds[k])
        elif kind == "part":
            gone.append(not prose[k] and not title[k])
        else:
            gone.append(prose[k] * 2 <= all_prose and (mains[k] < LONG or mains[k] * 2 <= all_mains))
    return [b for b in blocks if b.within < 0 or not gone[b.within]]


def blocks_of(html: str) -> list[Block]:
    """Cut and dropped in one walk; what is open is counted by name, so a step costs the same at any depth."""
    out: list[Block] = []
    parts: list[str] = []
    links: list[str] = []
    open_: list[tuple[str, bool, bool]] = []  # tags that are open, whether each is dropped, and whether it is marked
    names: dict[str, int] = {}  # how often each is open
    kinds: list[str] = []  # of marked containers
    outer: list[int] = []  # the marked container around each
    titles: set[int] = set()  # marked containers with an h1
    articles: set[int] = set()  # marked containers with an article or main
    inner, drop, mains, outermost = -1, 0, 0, -1

    def flush() -> None:
        text = " ".join(unescape("".join(parts)).split())
        if text:
            if inner >= 0 and names.get("h1"):
                titles.add(inner)
            out.append(Block(text, len(" ".join(unescape("".join(links)).split())), outermost if mains else -1, bool(names.get("p")), bool(names.get("h1")), inner))
        parts.clear()
        links.clear()

    def say(text: str) -> None:
        if text and not drop:
            parts.append(text)
            if names.get("a"):
                links.append(text)

    def close() -> str:
        nonlocal inner, drop, mains
        t, dropped, marked = open_.pop()
        names[t] -= 1
        drop -= dropped
        mains -= t in MAIN
        if marked:
            inner = outer[inner]
        return t

    at, last = 0, html.rfind(">")
    while True:
        m = _MARKUP.search(html, at) if at <= last else None
        if m is None:
            rest = html.find("<!--", at)  # an unclosed comment runs to the end
            say(html[at:] if rest < 0 else html[at:rest])
            break
        say(html[at : m.start()])
        at = m.end()
        tag, rest = (m["tag"] or m["odd"] or "").lower(), m["rest"] or m["odd_rest"] or ""
        if not tag:
            continue
        if tag in BLOCK:
            flush()
        elif tag == "br":
            say(" ")
        if m["end"] or m["odd_end"]:
            if names.get(tag):
                while close() != tag:
                    pass
        elif tag not in VOID and not rest.endswith("/"):
            if tag == "p":
                while open_ and open_[-1][0] not in BLOCK:  # inline tags end with their paragraph
                    close()
                if open_ and open_[-1][0] == "p":
                    close()
            if tag in RAW:
                end = re.compile(rf"</{tag}\b[^>]*+>?", re.I).search(html, at)
                at = end.end() if end else len(html)
                continue
            kind = _dropped(tag, rest)
            marked = kind not in ("", "always") and tag in BLOCK
            dropped = kind == "always" or (kind == "mark" and not marked)
            if marked:
                outer.append(inner)
                inner = len(kinds)
                kinds.append(kind)
            open_.append((tag, dropped, marked))
            names[tag] = names.get(tag, 0) + 1
            drop += dropped
            if tag in MAIN:
                outermost += not mains
                mains += 1
                if inner >= 0 and not drop:
                    articles.add(inner)
    flush()
    return _without_marked(out, kinds, outer, titles, articles)


def _deciding(blocks: list[Block]) -> set[int]:
    """The articles and mains that decide."""
    own, prose, titled = {}, {}, set()
    for b in blocks:
        if b.main >= 0:
            own[b.main] = own.get(b.main, 0) + b.own
            prose[b.main] = prose.get(b.main, 0) + b.prose
            if b.title:
                titled.add(b.main)
    every = sum(b.own for b in blocks)
    return {m for m in own if prose[m] and (prose[m] > LONG or m in titled or 2 * own[m] >= every)}


def _by_neighbours(blocks: list[Block], near: list[int], stops: list[float], known: bool) -> None:
    """On a page without a good block: which blocks of medium length, or else paragraphs, count."""
    others = [i for i, b in enumerate(blocks) if len(b.text) >= SHORT and b.label != "outside"]
    place, own = {i: k for k, i in enumerate(others)}, set(near)
    paired = [i for i in near if any(0 <= k < len(others) and others[k] in own for k in (place[i] - 1, place[i] + 1))]
    for i in paired or near:
        blocks[i].label = "good"
    if not near:
        for b, share in zip(blocks, stops, strict=True):
            if b.paragraph and not b.label and len(b.text.split()) >= PLAIN and (share >= MANY_STOPS or not known):
                b.label = "good"


def classify(blocks: list[Block]) -> None:
    """Both passes: sets each block's label to good or bad."""
    deciding = _deciding(blocks)
    has_main, shares = bool(deciding), []
    for b in blocks:
        b.main = b.main in deciding
        words = _WORD.findall(b.text.lower())
        shares.append(sum(w in STOP_WORDS for w in words) / max(1, len(words)))
    known = any(x >= FEW_STOPS for x, b in zip(shares, blocks, strict=True) if len(b.text) >= SHORT and b.linked <= MAX_LINKS * len(b.text))
    near = []
    for i, (b, stops) in enumerate(zip(blocks, shares, strict=True)):
        if has_main and not b.main:
            b.label = "outside"
        elif b.linked > MAX_LINKS * len(b.text):
            b.label = "bad"
        elif len(b.text) < SHORT:
            b.label = ""
        elif stops >= MANY_STOPS or not known:
            b.label = "good" if len(b.text) > LONG or b.main else ""
            if not b.label:
                near.append(i)
        else:
            b.label = "" if stops >= FEW_STOPS or b.main else "bad"
    if not any(b.label == "good" for b in blocks):
        _by_neighbours(blocks, near, shares, known)
    for b in blocks:
        b.label = "bad" if b.label == "outside" else b.label
    decided = [b.label for b in blocks]
    before: list[int | None] = []
    last = None
    for i, label in enumerate(decided):
        last = i if label and blocks[i].main == has_main else last
        before.append(last)
    after = None
    for i in range(len(blocks) - 1, -1, -1):
        if decided[i]:
            after = i if blocks[i].main == has_main else after
            continue
        near = [j for j in (before[i], after) if j is not None]
        least = min((abs(i - j) for j in near), default=0)
        labels = {decided[j] for j in near if abs(i - j) == least}
        blocks[i].label = "good" if "good" in labels or (not labels and blocks[i].main) else "bad"


def main_text(html: str | None) -> str:
    if not html:
        return ""
    blocks = blocks_of(html)
    classify(blocks)
    return "\n".join(b.text for b in blocks if b.label == "good")


def extract_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages without the html column, with text."""
    fields = [f for f in pages.schema.fields if f.name not in ("text", html_col)]
    html_name = fresh("html")

    def run(batches):
        for batch in batches:
            html = batch.column(batch.num_columns - 1)
            text = pa.array([main_text(h.as_py()) for h in html], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], text], names=[*batch.schema.names[:-1], "text"])

    out = StructType([*fields, StructField("text", StringType())])
    return pages.select(*[f"`{f.name}`" for f in fields], F.col(html_col).alias(html_name)).mapInArrow(run, out)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_text(pages).withColumn("n_chars", F.length("text").cast("long"))
