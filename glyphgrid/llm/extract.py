"""Main text of web pages by scoring the element tree.

1. The page is parsed into elements, with the usual omitted end tags. What can't be
   article is cut off: scripts, styles, forms, menus, page headers and footers, asides, hidden
   elements, and those whose class, id or role names such a part, unless they hold the article or nearly all text.
2. Every block of text passes points to its ancestors, one for being there, one for
   each comma and one for each 100 characters up to three: all to its parent, half to its
   grandparent, a third of that and less above. A container's points are discounted by
   the share of its text that stands in links.
3. The container with most points is the article, or the article or main element around
   it. Of its siblings, those are kept that are headings, paragraphs of mostly plain text,
   or containers with a fifth of its points.

White space within a block becomes one space, and blocks are joined by one space in page
order. A null or empty page, and one without text, gives the empty text. Pages are
independent, so copies and ties get what each would get alone, and an empty table gives no rows. Only the kept columns
are read beside the page. Time grows with the page, however long, deep or broken it is.
"""

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

TAG = re.compile(r"<(?:(!--)|([!?])|/([a-zA-Z][^\s/>]*)|([a-zA-Z][^\s/>]*))")
#: To the end of a tag; quotes count after an equals sign only. Nothing is matched in two ways, so time is linear.
REST = re.compile(r"""((?>[^>"'=]+|=\s*+(?>"[^"]*"|'[^']*')?|["'])*+)>""")
ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORDS = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+(?![a-z])")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var nobr ruby rt rp picture img wbr math mi mn mo mrow msup msub mfrac msqrt mtext".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
SCOPE = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "option": ("select",)}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CUT_TAGS = frozenset("nav header footer aside form button select input dialog head object canvas audio video menu".split())
KEEP_TAGS = frozenset("html body article main".split())
CUT_WORDS = frozenset(
    """ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion
    nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager header masthead banner footer foot colophon sidebar
    sidebars aside widget widgets rail cookie cookies consent gdpr notice notices alert alerts popup popups modal overlay newsletter
    subscribe subscription signup login comment comments commentlist disqus discussion replies respond share sharing social
    related recommended recommendations trending toolbar search searchbox skip legal copyright disclaimer paywall hidden""".split()
)
CUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: With one of these behind it a word still names the part: ``share-buttons``, but not ``share-price``.
PART_WORDS = frozenset("box block blocks container wrapper wrap area section list bar panel slot unit button buttons link links item items form posts stories left right top bottom inner outer row col column group holder zone region module".split())
OTHER_WORDS = frozenset("no not non has have with without of hide overflow scroll clear main article content".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class _Page:
    """Elements as parallel lists, parents before children; texts hold (block, in a link, text)."""

    def __init__(self):
        self.tag, self.parent, self.cut, self.link, self.block = ["#"], [-1], [0], [False], [0]
        self.texts: list[tuple[int, int, bool, str]] = []

    def open(self, tag: str, parent: int, attrs: str) -> int:
        i = len(self.tag)
        self.tag.append(tag)
        self.parent.append(parent)
        self.cut.append(judged(tag, attrs))
        self.link.append(tag == "a" or self.link[parent])
        self.block.append(self.block[parent] if tag in INLINE else i)
        return i


def judged(tag: str, attrs: str) -> int:
    """2: not article; 1 (forms): not article unless it holds half of the text; 3 (named so): not article unless it
    holds an article or main element or four fifths of the text that isn't cut off by its tag; 0: may be.

    A class or id names a part by one of its tokens: by its last word, or by words that only say where or in what (``sidebar-left``).
    Tokens that deny, measure or describe (``has-sidebar``, ``share-price``, ``notice-of-facts``) name none, and headings and
    paragraphs are never cut by a name. A header is cut by its tag outside an article or main element only (4).
    """
    if tag in KEEP_TAGS:
        return 0
    level = (1 if tag == "form" else 4 if tag == "header" else 2) if tag in CUT_TAGS else 0
    if level == 2 or not attrs or attrs.isspace():
        return level
    for m in ATTR.finditer(attrs):
        name, value = m[1].lower(), entities.unescape(m[2] or m[3] or m[4] or "")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and HIDDEN.search(value)):
            return 2
        if name == "role" and value.strip().lower() in CUT_ROLES:
            return 2
        if name in ("class", "id") and level == 0 and tag not in HEADINGS and tag != "p":
            for token in value.split():
                words = [w.lower() for w in WORDS.findall(token) if not w.isdigit()]
                named = [w in CUT_WORDS for w in words]
                if any(named) and OTHER_WORDS.isdisjoint(words) and (named[-1] or all(k or w in PART_WORDS for k, w in zip(named, words))):
                    level = 3
    return level


def parse(page: str) -> _Page:
    out = _Page()
    stack, at, n = [0], 0, len(page)
    opened: dict = {}
    unended: set = set()
    tag_of, add = out.tag, out.texts.append

    def say(text: str) -> None:
        if text:
            top = stack[-1]
            add((top, out.block[top], out.link[top], text))

    def push(name: str, node: int) -> None:
        stack.append(node)
        opened[name] = opened.get(name, 0) + 1

    def close_to(names, stop=()) -> None:
        if not any(opened.get(x) for x in names):
            return
        for depth in range(len(stack) - 1, 0, -1):
            if tag_of[stack[depth]] in names:
                for node in stack[depth:]:
                    opened[tag_of[node]] -= 1
                del stack[depth:]
                return
            if tag_of[stack[depth]] in stop:
                return

    while at < n:
        m = TAG.search(page, at)
        if m is None:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        if m[1]:
            end = page.find("-->", m.end())
            at = n if end < 0 else end + 3
            continue
        if m[2]:
            end = page.find(">", m.end())
            at = n if end < 0 else end + 1
            continue
        r = REST.match(page, m.end())
        if r is None:  # the page ends within a tag
            break
        at = r.end()
        alone = r[1].endswith("/")
        if m[3]:
            name = m[3].lower()
            if name == "br":
                say(" ")
            elif name in INLINE:
                close_to((name,), CLOSES_P)
            else:
                close_to((name,), ("table",) if name in ("p", "li") else ())
            continue
        name = m[4].lower()
        if name in RAW:
            if alone:
                continue
            end = None if name in unended else re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            if end is None:
                unended.add(name)
            at = n if end is None and name in ("script", "style") else at if end is None else end.end()
            continue
        if name in VOID:
            if name in ("br", "hr"):
                if name == "hr":
                    close_to(("p",), ("table", "button"))
                say(" ")
            continue
        if name in CLOSES_P:
            close_to(("p",), ("table", "button", "article", "section", "div", "li", "td"))
        if name in HEADINGS and tag_of[stack[-1]] in HEADINGS:
            opened[tag_of[stack.pop()]] -= 1
        if name in ENDS:
            close_to(ENDS[name], SCOPE.get(name, ("table",)))
        node = out.open(name, stack[-1], r[1])
        if not alone or name not in INLINE:
            push(name, node)
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    tree = parse(page)
    n, parent, tag = len(tree.tag), tree.parent, tree.tag
    size = [0] * n
    for node, _, _, text in tree.texts:
        size[node] += len(text.strip())
    whole = sum(size)
    for i in range(n - 1, 0, -1):
        size[parent[i]] += size[i]
    gone = [False] * n
    holds = [t in ("article", "main") for t in tag]
    rest = whole
    for i in range(n - 1, 0, -1):
        holds[parent[i]] |= holds[i]
    inside = [t in ("article", "main") for t in tag]
    for i in range(1, n):
        inside[i] |= inside[parent[i]]
        gone[i] = gone[parent[i]] or tree.cut[i] == 2 or (tree.cut[i] == 4 and not inside[i] and not holds[i]) or (tree.cut[i] == 1 and 2 * size[i] < whole)
        if gone[i] and not gone[parent[i]]:
            rest -= size[i]
    for i in range(1, n):
        gone[i] = gone[i] or gone[parent[i]] or (tree.cut[i] == 3 and not holds[i] and 5 * size[i] < 4 * rest)
    blocks: dict[int, list] = {}
    plain, linked = [0] * n, [0] * n
    for node, block, link, text in tree.texts:
        if not gone[node]:
            text = entities.unescape(text)
            blocks.setdefault(block, []).append(text)
            length = len(text.strip())
            plain[node] += length
            linked[node] += length * link
    for i in range(n - 1, 0, -1):
        plain[parent[i]] += plain[i]
        linked[parent[i]] += linked[i]
    points, told = [0.0] * n, [False] * n  # told: a paragraph of its own lies right in it
    for block, parts in blocks.items():
        text = " ".join("".join(parts).split())
        if not text:
            continue
        worth = 1.0 + text.count(",") + min(len(text) // 100, 3)
        # Text that stands in a container itself counts for the container.
        up = block if tag[block] not in ("p", "pre", "td", "blockquote", "li") and tag[block] not in HEADINGS else parent[block]
        told[up] |= tag[block] in ("p", "blockquote", "pre") and up >= 0
        share = 1.0
        while up >= 0 and share > 1e-6:  # what a deeper ancestor would get changes nothing
            points[up] += worth * share
            share = share / 2 if share == 1.0 else share / 3
            up = parent[up]
    best, most = -1, 0.0
    for i in range(n):
        if points[i] and not gone[i]:
            got = points[i] * (1.0 - linked[i] / max(plain[i], 1))
            points[i] = got
            if got > most:
                best, most = i, got
    if best < 0:
        return ""
    up = best
    while up >= 0:
        if tag[up] in ("article", "main"):
            best = up
        up = parent[up]
    kept = [False] * n
    for i in range(n):
        above = parent[i]
        if gone[i]:
            continue
        if i == best or (above >= 0 and kept[above]):
            kept[i] = True
        elif above == parent[best] and above >= 0 and i != best and tag[i] not in INLINE:
            dense = linked[i] / max(plain[i], 1)
            kept[i] = tag[i] in HEADINGS or ((tag[i] == "p" or told[i]) and dense < 0.25) or (points[i] >= most / 5 and dense < 0.5)
    parts: list[str] = []
    last = -1
    for node, block, _, text in tree.texts:
        if kept[node]:
            if block != last:
                parts.append(" ")
                last = block
            parts.append(entities.unescape(text))
    return " ".join("".join(parts).split())


def extract(pages: DataFrame, keep: tuple = ("page_id", "url"), html: str = "html") -> DataFrame:
    """The kept columns, text and n_chars (code points) of each page."""

    def run(batches):
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    schema = ", ".join([f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep] + ["text string", "n_chars long"])
    return pages.select(*keep, F.col(html).cast("string").alias("_html")).mapInArrow(run, schema)
