"""Main text of web pages by wrappers: union-free regular expressions inferred from the pages of a host.

A page becomes a tree of block elements with text slots. Runs of equal neighbours, and of equal pairs and triples, fold
into repeated groups, and the trees of one host are aligned one after another: text that differs becomes a slot,
elements that one side lacks become optional, neighbours that meet become repeated. Copies of a page count once a host.
Tasks fold the pages of a host that they hold, and the wrappers of a host meet in two salted steps.

Every page is read through its host's wrapper: its tree is matched with the expression, and the slot that a text falls
into decides on it. Slots with one text on most pages may be template. What is left is weighed over all pages of the host:
names of furniture, forms, and marks of the main part are priors against that weight. A page that its host's wrapper
does not match, or leaves without text, is read through the wrapper of itself alone.

Headings, paragraphs, list items and cells that repeat are template only outside of marks of the main part, and there only if
no texts that vary stand before and behind them in one container; what repeats in a bare block is template everywhere.
"""

from __future__ import annotations

import hashlib
import html as html_module
import json
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemforge.llm.common import bound_batches, stored

SALTS = 32
# The next three bound the size of a wrapper; no text is lost by them.
MOST_DEPTH = 48  # elements further down count as their ancestor's text
MOST_CHILDREN = 64  # a wider node becomes one repeated group of optional children
MOST_SLOT_TEXT = 200  # longer text is no template text
TEMPLATE_SHARE = 0.5  # of the host's different pages
MARK_WEIGHT = 10  # of text inside article or main, against 1 elsewhere
WORD_WEIGHT = 2  # of text outside of a block with a furniture name, against 1 inside
HOT_SHARE = 0.002  # of the pages, to be a hot host
HOT_GUIDE = 65_536  # characters of a guide that may be broadcast: 1 / HOT_SHARE of them take 33 MB at most
HELD_CHARS = 8_000_000  # of wrappers, that a task holds to meet copies before the shuffle
OUT_CHARS = 4_000_000  # of wrappers in an output batch

#: Names of the HTML standard, and words by which pages name their furniture and their content.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("head nav header footer aside button select menu dialog search canvas svg math audio video object map".split())
FORMS = frozenset("form fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 html body main".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
FLOW = frozenset("h1 h2 h3 h4 h5 h6 p li dt dd th td caption figcaption blockquote pre".split())
COMMENTS = frozenset("comment comments commentlist disqus reply replies".split())
TOPS = frozenset("header headers head masthead banner".split())
FURNITURE = COMMENTS | TOPS | frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsors sponsored promo promos promotion sidebar menu menus nav navbar navigation "
    "breadcrumb breadcrumbs footer footers cookie cookies consent gdpr notice notices notification notifications popup modal overlay newsletter subscribe subscription "
    "signup social share shares sharing related recommend recommended recommendations widget widgets toolbar pagination pager search login alert alerts skip hidden".split()
) - {"head"}
CONTENT = frozenset("article post entry story content body page main text news blog".split())
PLACES = frozenset("site top bottom left right global inner outer wrap wrapper container box bar block area section list item items link links slot unit zone row col column buttons button js".split())
#: An open element that a start tag closes, by the start tag; the search stops at the second set.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
_P_SCOPE = {"table", "td", "th", "caption", "button", "object"}
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<(?P<raw>script|style|textarea|title|noscript|template|xmp|iframe|noembed|noframes)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*+>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-zA-Z][^>]*+(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?+""")


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html_module.unescape((m[2] or "").strip("\"'")) for m in _ATTR.finditer(raw)} if raw else {}


#: What an element says about itself: nothing, furniture at all times, a name or a form that the wrapper weighs.
PLAIN, HARD, WORD, FORM = 0, 1, 2, 3


def _says_furniture(token: str) -> frozenset:
    """The furniture words of a class or id, if it names furniture: no other word, and no content's heading, is in it."""
    words = {w for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", token).lower()) if w}
    named = frozenset(words & FURNITURE)
    if not named or words - FURNITURE - CONTENT - PLACES or words & CONTENT - {"page", "main"} and named <= TOPS:
        return frozenset()
    return named


def _kind(name: str, attrs: dict[str, str]) -> int:
    if name in DROPPED:
        return HARD
    if attrs and name not in HEADINGS:
        role = attrs.get("role", "").lower()
        if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower() or role in ROLES:
            return HARD
        named = frozenset().union(*(_says_furniture(t) for t in f"{attrs.get('class', '')} {attrs.get('id', '')}".split()))
        if named:
            return HARD if named & COMMENTS else WORD
        if role == "form":
            return FORM
    return FORM if name in FORMS else PLAIN


def _mark(name: str, attrs: dict[str, str]) -> str:
    if name == "article" or attrs.get("itemprop", "").lower() == "articlebody":
        return "@a"
    return "@m" if name == "main" or attrs.get("role", "").lower() == "main" else ""


def read_page(html: str) -> list:
    """The page's tree: nodes [key, children], texts [None, text]. Furniture that needs no weighing is an empty node.

    A key is the element's name, what it says about itself (?w a name, ?f a form, @a and @m marks), and its class.
    """
    root: list = ["", []]
    #: name, is a block, is or is in hard furniture, node
    stack: list[tuple[str, bool, bool, list]] = [("", True, False, root)]
    buffer: list[str] = []
    quiet = 0  # open inline furniture

    def flush() -> None:
        text = " ".join("".join(buffer).split())
        buffer.clear()
        if text:
            _, _, hard, node = next(e for e in reversed(stack) if e[1])
            if not hard:
                node[1].append([None, text])

    def cut(depth: int) -> None:
        nonlocal quiet
        if any(e[1] for e in stack[depth:]):
            flush()
        quiet -= sum(not e[1] for e in stack[depth:])
        del stack[depth:]

    def add(text: str) -> None:
        if text and not quiet:
            buffer.append(html_module.unescape(text) if "&" in text else text)

    at = 0
    for m in _TOKEN.finditer(html):
        add(html[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if m["end"]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == name:
                    cut(depth)
                    break
                if name not in BLOCKS and stack[depth][1]:
                    break  # an inline end tag does not close a block
            else:
                if name in BLOCKS:
                    flush()
            continue
        if name == "br":
            add(" ")
            continue
        attrs = _attributes(m["attrs"])
        if name in BLOCKS:
            flush()
            closed, stop = _CLOSES.get(name, ({"p"}, _P_SCOPE))
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] in stop:
                    break
                if stack[depth][0] in closed:
                    cut(depth)
        if name in VOID:
            continue
        _, _, hard, node = stack[-1]
        # a header inside of the main part is that part's own
        kind = _kind("div" if name == "header" and any("@" in e[3][0] for e in stack) else name, attrs)
        if name in BLOCKS:
            deep = len(stack) > MOST_DEPTH
            if not hard and not deep:
                flags = {WORD: "?w", FORM: "?f"}.get(kind, "!" if kind == HARD else "") + _mark(name, attrs)
                word = re.sub(r"\d+", "", (attrs.get("class") or attrs.get("id") or "").split(" ")[0])[:40]
                child: list = [f"{name}{flags}.{word}" if word else f"{name}{flags}", []]
                node[1].append(child)
                node = child
            stack.append((name, True, hard or kind == HARD or deep and kind == WORD, node))
        elif kind in (HARD, WORD):
            quiet += 1
            stack.append((name, False, True, node))
    add(html[at:])
    flush()
    return root


# ---------------------------------------------------------------- wrappers
# A node is [key, optional, repeated, children]; a group's key is "(" and its children's keys, that of a group which
# takes its children in any order "(*". A text slot is ["#", optional, repeated, [text or None, uses, chars]].
# Uses count pages: what meets inside one page is used as often as the side with more uses.

WIDE = "(*"


def wrapper_of(node: list) -> list:
    """The wrapper of one page's tree, equal neighbours folded."""
    children = [["#", False, False, [c[1] if len(c[1]) <= MOST_SLOT_TEXT else None, 1, len(c[1])]] if c[0] is None else wrapper_of(c) for c in node[1]]
    return [node[0], False, False, _fold(children)]


def _keys(nodes: list) -> list[str]:
    return [n[0] for n in nodes]


def _merge(a: list, b: list, inside: bool = False) -> list:
    if a[0] == "#":
        (x, p, c), (y, q, d) = a[3], b[3]
        body = [x if x == y else None, max(p, q) if inside else p + q, c + d]
    elif a[0][:1] == "(" and a[0] != WIDE:
        body = [_merge(x, y, inside) for x, y in zip(a[3], b[3], strict=True)]
    else:
        body = align(a[3], b[3], inside)
    return [a[0], a[1] or b[1], a[2] or b[2], body]


def _wide(children: list, inside: bool) -> list:
    """One repeated group of optional children, by key; with very many keys by what stands before their class."""
    by_key: dict[str, list] = {}
    for child in (grand for c in children for grand in (c[3] if c[0] == WIDE else [c])):
        key = child[0] if len(by_key) < MOST_CHILDREN or child[0] in by_key else child[0].split(".")[0]
        child = [key, *child[1:]]
        by_key[key] = _merge(by_key[key], child, inside) if key in by_key else child
        by_key[key][1] = True
    return [WIDE, True, True, [by_key[k] for k in sorted(by_key)]]


def _grouped(nodes: list, period: int, keys: list[str] | None = None) -> list:
    """Neighbouring stretches of `period` nodes that repeat become a group; with keys, every stretch with these keys."""
    out, i = [], 0
    while i < len(nodes):
        part = nodes[i : i + period]
        if len(part) == period and (_keys(part) == keys if keys else _keys(part) == _keys(nodes[i + period : i + 2 * period])):
            wanted, group = _keys(part), ["(" + " ".join(_keys(part)), False, False, part]
            i += period
            while _keys(nodes[i : i + period]) == wanted:
                group = [group[0], False, True, [_merge(a, b, True) for a, b in zip(group[3], nodes[i : i + period], strict=True)]]
                i += period
            out.append(group)
        else:
            out.append(nodes[i])
            i += 1
    return out


def _fold(children: list) -> list:
    out: list = []
    for child in children:
        if out and out[-1][0] == child[0]:
            out[-1] = _merge(out[-1], child, True)
            out[-1][2] = True
        else:
            out.append(child)
    for period in (2, 3):
        out = _grouped(out, period)
    return [_wide(out, True)] if len(out) > MOST_CHILDREN else out


def align(a: list, b: list, inside: bool = False) -> list:
    """Align two lists of nodes on their longest common subsequence; what one side lacks becomes optional."""
    if _keys(a) == _keys(b):
        return [_merge(x, y, inside) for x, y in zip(a, b, strict=True)]
    if any(x[0] == WIDE for x in (*a, *b)):
        return [_wide([*a, *b], inside)]
    for group in [x for x in (*a, *b) if x[0][:1] == "("]:  # the other side may hold the group once, unfolded
        a, b = (_grouped(side, len(group[3]), _keys(group[3])) for side in (a, b))
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i][0] == b[j][0] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i][0] == b[j][0]:
            out.append(_merge(a[i], b[j], inside))
            i, j = i + 1, j + 1
        elif j == m or i < n and best[i + 1][j] >= best[i][j + 1]:
            out.append([a[i][0], True, *a[i][2:]])
            i += 1
        else:
            out.append([b[j][0], True, *b[j][2:]])
            j += 1
    return _fold(out)


def merge_wrappers(a: list, b: list) -> list:
    return ["", False, False, align(a[3], b[3])]


def expression(node: list) -> str:
    """The wrapper as a union-free regular expression."""
    if node[0] == "#":
        body = "#TEXT" if node[3][0] is None else json.dumps(node[3][0], ensure_ascii=False)
    else:
        inner = " ".join(expression(c) for c in node[3])
        body = f"<{node[0]}> {inner} </{node[0]}>" if node[0] and node[0][0] != "(" else inner
    mark = "*" if node[1] and node[2] else "+" if node[2] else "?" if node[1] else ""
    return f"( {body} ){mark}" if mark else body


# ---------------------------------------------------------------- reading pages through a wrapper


def guide_of(wrapper: list, pages: int) -> list:
    """The wrapper of that many different pages with a verdict for each slot: 1 keep, 0 drop, or the text to drop.

    Nodes are [key, repeated, children], groups dissolved; slots ["#", repeated, verdict].
    """
    slots: list[tuple[list, tuple[int, ...], str]] = []  # body, weighed blocks around it, marks around it
    weighed: list[tuple[bool, tuple[int, ...]]] = []  # is a form; the weighed blocks around
    flow: list[int | None] = []  # of slots in paragraphs, headings and the like: their container's number

    def visit(node: list, around: tuple[int, ...], marks: str, containers: tuple[int, int] = (0, 0), name: str = "") -> None:
        if node[0] == "#":
            slots.append((node[3], around, marks))
            flow.append(containers[0] if name in FLOW else None)
            return
        own = node[0].split(".")[0] if node[0][:1] != "(" else ""
        if own:
            name, containers = re.split("[?@!]", own)[0], (containers[1], id(node))
        if "?" in own:
            weighed.append(("?f" in own, around))
            around = (*around, len(weighed) - 1)
        marks += "a" * ("@a" in own) + "m" * ("@m" in own)
        for child in node[3]:
            visit(child, around, marks, containers, name)

    visit(wrapper, (), "")
    constant = [pages > 1 and b[0] is not None and b[1] >= max(2, TEMPLATE_SHARE * pages) for b, _, _ in slots]
    # headings and paragraphs that repeat are the article's own inside of its marks, and between texts that vary
    spread: dict[int, list[int]] = {}
    for i, container in enumerate(flow):
        if container is not None and not constant[i]:
            spread.setdefault(container, []).append(i)
    own = lambda i, marks: bool(marks) or flow[i] in spread and spread[flow[i]][0] < i < spread[flow[i]][-1]
    constant = [c and not (flow[i] is not None and own(i, marks)) for i, (c, (_, _, marks)) in enumerate(zip(constant, slots, strict=True))]
    chars = lambda want, free: sum(b[2] for (b, around, _), c in zip(slots, constant, strict=True) if c == want and (not around or not free and all(weighed[k][0] for k in around)))
    if chars(True, False) > chars(False, False):  # pages that mostly repeat each other are versions of one text
        constant = [False] * len(slots)
    varying = chars(False, True)
    taken: set[int] = set()
    for k, (is_form, around) in enumerate(weighed):
        held = sum(b[2] for (b, inside, _), c in zip(slots, constant, strict=True) if k in inside and not c)
        if taken.issuperset(around) and (held > varying if is_form else pages > 1 and varying and held > WORD_WEIGHT * varying):
            taken.add(k)
    weights = [b[2] if taken.issuperset(around) and not c else 0 for (b, around, _), c in zip(slots, constant, strict=True)]
    weight = lambda marks: sum(w for w, (_, _, m) in zip(weights, slots, strict=True) if set(marks) <= set(m))
    total, region = weight(""), ""
    if weight("m") and MARK_WEIGHT * weight("m") >= total - weight("m"):
        region = "m"
    inner = weight(region + "a")
    if inner and (2 * inner >= weight("m") if region else MARK_WEIGHT * inner >= total - inner):
        region += "a"
    verdicts = iter([b[0] if c else 1 if taken.issuperset(around) and set(region) <= set(m) else 0 for (b, around, m), c in zip(slots, constant, strict=True)])

    def build(node: list, repeated: bool) -> Iterator[list]:
        if node[0] == "#":
            yield ["#", repeated or node[2], next(verdicts)]
        elif node[0][:1] == "(":
            for child in node[3]:
                yield from build(child, repeated or node[2])
        else:
            yield [node[0], repeated or node[2], [g for c in node[3] for g in build(c, False)]]

    return [g for c in wrapper[3] for g in build(c, False)]


class Guide:
    """A guide with its children by key."""

    def __init__(self, children: list) -> None:
        self.repeated = [c[1] for c in children]
        self.inner = [c[2] if c[0] == "#" else Guide(c[2]) for c in children]
        self.places: dict[str, list[int]] = {}
        for i, child in enumerate(children):
            self.places.setdefault(child[0], []).append(i)

    def read(self, node: list, out: list[str]) -> bool:
        """Append the texts of a tree that the wrapper keeps; false if the wrapper does not match it."""
        last = -1
        for child in node[1]:
            key = "#" if child[0] is None else child[0]
            places = self.places.get(key) or self.places.get(key.split(".")[0])
            if not places:
                return False
            k = bisect_left(places, last if last >= 0 and self.repeated[last] else last + 1)
            last = places[k] if k < len(places) else places[-1]  # else back to the start of a repeated group
            if child[0] is not None:
                if not self.inner[last].read(child, out):
                    return False
            elif self.inner[last] == 1 or self.inner[last] != 0 and self.inner[last] != child[1]:
                out.append(child[1])
        return True


def main_text(html: str | None, guide: Guide | None = None) -> str:
    """The article's blocks joined by two line ends; without a guide the page is read through its own wrapper."""
    if not html:
        return ""
    root, out = read_page(html), []
    if guide is None or not guide.read(root, out) or not out:
        out = []
        Guide(guide_of(wrapper_of(root), 1)).read(root, out)
    return "\n\n".join(out)


def _host(url) -> object:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))


def _content(node: list) -> list:
    """What makes two pages copies: their tree without furniture and what is named like it."""
    return [c[1] if c[0] is None else [c[0], _content(c)] for c in node[1] if c[0] is None or not re.search(r"!|\?w", c[0].split(".")[0])]


def infer_wrappers(pages: DataFrame, salts: int = SALTS) -> DataFrame:
    """(host, wrapper, pages, copies): one wrapper for each host of pages (url, html), its different pages and all its rows.

    Pages of a host with the same blocks outside of furniture are copies of one page.
    """

    def read(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, bytes], tuple[str, int]] = {}
        held = 0
        for batch in source:
            for host, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                root = read_page(html)
                key, wrapper = (host, hashlib.blake2b(json.dumps(_content(root)).encode(), digest_size=16).digest()), json.dumps(wrapper_of(root), ensure_ascii=False)
                held += len(wrapper) if key not in found else 0
                least, copies = found.get(key, (wrapper, 0))
                found[key] = min(least, wrapper), copies + 1
                if held > HELD_CHARS:
                    yield contents(found)
                    found, held = {}, 0
        yield contents(found)

    def contents(found: dict[tuple[str, bytes], tuple[str, int]]) -> pa.RecordBatch:
        columns = [pa.array([h for h, _ in found], pa.string()), pa.array([c for _, c in found], pa.binary()), pa.array([w for w, _ in found.values()], pa.string()), pa.array([n for _, n in found.values()], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["host", "content", "wrapper", "copies"])

    def fold(source: Iterator[pa.RecordBatch], has_count: bool) -> Iterator[pa.RecordBatch]:
        """Rows come by host, so one wrapper is open at a time and each host of the task gives one row."""
        done: list[tuple[str, str, int, int]] = []
        host, content, wrapper, count, copies = None, None, None, 0, 0

        def close() -> None:
            if wrapper is not None:
                done.append((host, json.dumps(wrapper, ensure_ascii=False), count, copies))

        for batch in source:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != host:
                    close()
                    host, content, wrapper, count, copies = row[0], None, None, 0, 0
                    if sum(len(d[1]) for d in done) > OUT_CHARS:
                        yield out(done)
                        done = []
                copies += row[3]
                if not has_count and row[1] == content:
                    continue  # a copy: rows come by host and content
                other, number = (json.loads(row[1]), row[2]) if has_count else (json.loads(row[2]), 1)
                content = None if has_count else row[1]
                wrapper, count = other if wrapper is None else merge_wrappers(wrapper, other), count + number
        close()
        yield out(done)

    def out(done: list[tuple[str, str, int, int]]) -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["host", "wrapper", "pages", "copies"])

    schema = "host string, wrapper string, pages long, copies long"
    partial = pages.filter(F.col("html").isNotNull()).select(_host(F.col("url")).alias("host"), "html").mapInArrow(read, "host string, content binary, wrapper string, copies long")
    partial = partial.repartition("host", "content").sortWithinPartitions("host", "content", "wrapper").mapInArrow(lambda s: fold(s, False), schema)
    for keys in ([F.col("host"), F.pmod(F.xxhash64("wrapper"), F.lit(salts))], [F.col("host")]):
        partial = partial.repartition(*keys).sortWithinPartitions("host", "wrapper").mapInArrow(lambda s: fold(s, True), schema)
    return partial


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    Null or empty html, and pages without article text, give the empty text. A null or odd url has the empty host.
    Repeated rows give repeated results and count as copies; other columns are ignored. A page of any length is held
    whole by one task. An empty table gives no rows.
    """

    def guides(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            hosts, wrappers, counts, copies = (c.to_pylist() for c in batch.columns)
            found = [json.dumps(guide_of(json.loads(w), n), ensure_ascii=False) for w, n in zip(wrappers, counts, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(found, pa.string()), pa.array(copies, pa.int64())], ["host", "guide", "copies"])

    def texts(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, Guide] = {}
        held = 0
        for batch in source:
            found = []
            for value, guide in zip(batch.column(2), batch.column(3).to_pylist(), strict=True):
                if guide is not None and guide not in cache:
                    held += len(guide)
                    if held > HELD_CHARS:
                        cache.clear()
                        held = len(guide)
                    cache[guide] = Guide(json.loads(guide))
                found.append(main_text(value.as_py(), cache.get(guide)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], ["page_id", "url", "text", "n_chars"])

    bound_batches(pages.sparkSession)
    known = stored(infer_wrappers(pages.select("url", "html")).mapInArrow(guides, "host string, guide string, copies long"), "guides")
    total = known.agg(F.sum("copies")).collect()[0][0] or 0
    # at most 1 / HOT_SHARE hosts are hot, with guides of at most HOT_GUIDE: a bounded broadcast, and their pages stay
    # where they are; of the others none has more than a small share of the pages, or adaptive joins split it
    is_hot = (F.col("copies") >= max(1.0, HOT_SHARE * total)) & (F.length("guide") <= HOT_GUIDE)
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    rows = pages.select("page_id", "url", "html", _host(F.col("url")).alias("host"))
    rows = rows.join(F.broadcast(known.filter(is_hot).select("host", F.col("guide").alias("hot_guide"))), "host", "left")
    # a hot page's key meets no host and spreads over the tasks
    key = F.when(F.col("hot_guide").isNull(), F.col("host")).otherwise(F.concat(F.lit("/"), F.xxhash64("url", "page_id").cast("string")))
    rows = rows.withColumn("key", key).join(known.filter(~is_hot).select(F.col("host").alias("key"), "guide"), "key", "left").withColumn("guide", F.coalesce("hot_guide", "guide"))
    return rows.select("page_id", "url", "html", "guide").mapInArrow(texts, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
