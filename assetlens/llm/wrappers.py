"""Main text of web pages by inferring one wrapper, a union-free regular expression, for each host.

A page is a stream of tags and texts; block-level tags with their classes make its skeleton, with text
slots between them. Pages of one host are aligned one after the other with the host's wrapper so far:
equal neighbours become a repeated group, tags that only some pages have become optional, texts that
differ become slots. Tasks infer a wrapper from the pages they hold; wrappers of one host are then
aligned with each other, first in several heaps a host and then once more, so no task sees more than a
heap of wrappers, however many pages a host has. The wrapper tells where a host's pages keep their main
text: the element that holds most text outside links and outside furniture (menus, headers, footers,
sidebars, notices, adverts, forms, comments). A class or id makes an element furniture only as a whole
name: each of its words is a known or a neutral one, and headings, paragraphs and spans are never judged
by theirs. Extraction walks a page's tags again and gathers the blocks
of that element.

Null and empty pages have no text. A page without the wrapper's element, a page without a host, or text
outside any tag is read by the furniture rules alone. Equal rows give equal rows. Only the id, url and
html columns are read. An empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetlens.llm.staging import staged

# Element names of HTML and words that sites use in the classes of furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math".split())
BLOCK = frozenset(
    "html body head address article aside blockquote canvas center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
ENDS_P = BLOCK - frozenset("html body head td th tr tbody thead tfoot option optgroup".split())
SIBLING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tbody", "thead", "tr", "td", "th"), "thead": ("tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th")}
HOLDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "option": ("select",), "tr": ("table",), "td": ("table",), "th": ("table",), "tbody": ("table",), "thead": ("table",), "tfoot": ("table",)}
FURNITURE = frozenset("nav aside footer form button select dialog menu head search fieldset label".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense banner banners promo promos promotion promotions sponsor sponsors sponsored cookie cookies consent gdpr notice notices notification notifications alert alerts popup popups modal overlay menu menus nav navbar navigation breadcrumb breadcrumbs sidebar sidebars rail widget widgets footer footers masthead topbar comment comments commentlist disqus reply replies respond related recommend recommended recommendation recommendations share sharing social newsletter newsletters subscribe signup login search tags pagination pager toolbar skip".split()
)
# words that may stand beside those in a name without changing what it names
NEUTRAL_WORDS = frozenset(
    "a area article articles bar block body bottom box btn button buttons card cards col column container content entry field form global group header icons inner input item items left link links list local main media middle module more outer page panel post posts primary right row secondary section site slot space stories story sub text title to top unit wrap wrapper".split()
)
NEVER_BY_NAME = frozenset("html body article main h1 h2 h3 h4 h5 h6 p span".split())  # text of their own, whatever they are called
HEADER_WORD = re.compile(r"(?:^|[^a-z])headers?(?:$|[^a-z])")  # furniture outside the main text only
MAIN_WORD = re.compile(r"(?:^|[^a-z])(?:article|articlebody|content|post|entry|story|main|text|body)(?:$|[^a-z])")
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)


def named_furniture(names: str) -> bool:
    """Whether one of the names is a whole name of furniture: "cookie-notice" is one, "comments-on-the-proof" is not."""
    for one in names.split():
        parts = re.findall(r"[^\W\d_]+", one)
        if any(x in FURNITURE_WORDS for x in parts) and all(x in FURNITURE_WORDS or x in NEUTRAL_WORDS for x in parts):
            return True
    return False


def describe(name: str, attributes: str) -> tuple[str, bool]:
    """An element's key (name and classes without digits) and whether it is furniture by itself."""
    if not attributes.strip():
        return name, name in FURNITURE
    found = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in ATTRIBUTE.finditer(attributes)}
    names = " ".join(found.get(k, "") for k in ("id", "class", "itemprop"))
    words = re.sub(r"\d+", "", re.sub(r"\s+", ".", names.strip()))
    role = found.get("role", "")
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
    out = name in FURNITURE or role in ROLES or hidden or (name not in NEVER_BY_NAME and named_furniture(names))
    return (f"{name}.{words}" if words else name) + (f"@{role}" if role else ""), out


def walk(page: str) -> Iterator[tuple[str, str, str, bool]]:
    """Events of a page: ("open", name, key, furniture), ("close", name, "", False), ("text", text, "", False).

    Opens and closes are balanced: end tags that HTML lets out are added, stray ones dropped.
    """
    stack: list[str] = []
    at = 0
    while True:
        m = TAG.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            yield "text", text, "", False
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                yield "text", entities.escape(m[0][9:].removesuffix("]]>")), "", False
            continue
        if m[1] or m[4]:
            if name in stack:
                depth = len(stack) - 1 - stack[::-1].index(name)
                if name in BLOCK or not any(x in BLOCK for x in stack[depth + 1 :]):
                    while len(stack) > depth:
                        yield "close", stack.pop(), "", False
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in ("html", "body") and name in stack:
            continue
        closes = set(SIBLING.get(name, ()))
        if name in ENDS_P:
            closes.add("p")
        if closes:
            fence = HOLDS.get(name, ()) + ("td", "th") * (name not in ("td", "th", "tr", "tbody", "thead", "tfoot"))
            depth = None
            for i in range(len(stack) - 1, -1, -1):
                if stack[i] in closes:
                    depth = i
                elif stack[i] in fence or (stack[i] in BLOCK and stack[i] not in closes and name not in HOLDS):
                    break
            if depth is not None:
                while len(stack) > depth:
                    yield "close", stack.pop(), "", False
        key, out = describe(name, m[3] if m[2] else m[6] or "")
        yield "open", name, key, out
        if name in VOID or (m[3] or m[6] or "").rstrip().endswith("/") and name not in BLOCK:
            yield "close", name, "", False
        else:
            stack.append(name)
    while stack:
        yield "close", stack.pop(), "", False


DEEPEST = 100  # elements below that many others count as their text
# A wrapper node is [key, how often (1 ? + *), characters of text, of them in links, fixed text or None, children].
OFTEN = {("1", "1"): "1", ("+", "1"): "+", ("1", "+"): "+", ("+", "+"): "+"}


def _more(a: str, b: str) -> str:
    return OFTEN.get((a, b)) or ("*" if "+" in a + b or "*" in a + b else "?")


def skeleton(page: str) -> list:
    """A page as a wrapper of its own: block elements and the amount of text in each, repeats folded."""
    root = ["", "1", 0, 0, "", []]
    nodes, out, links = [root], 0, 0
    marks: list[tuple[bool, bool, bool]] = []
    for kind, value, key, furniture in walk(page):
        if kind == "open":
            block = value in BLOCK and len(nodes) < DEEPEST
            if block:
                child = [key, "1", 0, 0, "", []]
                nodes[-1][5].append(child)
                nodes.append(child)
            out += furniture
            links += value == "a"
            marks.append((block, furniture, value == "a"))
        elif kind == "close":
            block, furniture, link = marks.pop()
            out -= furniture
            links -= link
            if block:
                node = nodes.pop()
                node[5] = fold(node[5])
        else:
            size = len(value) - value.count(" ")
            if size and not value.isspace():
                node = nodes[-1]
                node[4] = value.strip() if not node[4] and len(value) < 80 else None
                if not out:
                    node[2] += size
                    node[3] += size * (links > 0)
    root[5] = fold(root[5])
    return root


def _keys(nodes: list) -> list[str]:
    return [n[0] for n in nodes]


def merge(a: list, b: list) -> list:
    """Two nodes of one key as one."""
    text = a[4] if a[4] == b[4] else None
    return [a[0], _more(a[1], b[1]), a[2] + b[2], a[3] + b[3], text, align(a[5], b[5])]


def _group(nodes: list, often: str = "+") -> list:
    return ["(" + " ".join(_keys(nodes)) + ")", often, sum(x[2] for x in nodes), sum(x[3] for x in nodes), "", nodes]


def _add_turn(group: list, turn: list) -> None:
    """One more turn of a repeated group."""
    group[2] += sum(x[2] for x in turn)
    group[3] += sum(x[3] for x in turn)
    group[5] = [merge(x, y) for x, y in zip(group[5], turn)]


def fold(nodes: list) -> list:
    """Equal neighbours, and equal runs of two or three neighbours, as one repeated node or group."""
    out: list = []
    for n in nodes:
        if out and out[-1][0] == n[0]:
            n = merge(out.pop(), n)
            n[1] = "+" if n[1] in "1+" else "*"
        out.append(n)
        for size in (2, 3):
            turn, before = out[-size:], out[: -size]
            if len(before) and before[-1][0] == _group(turn)[0]:
                del out[-size:]
                _add_turn(out[-1], turn)
                break
            if len(before) >= size and _keys(before[-size:]) == _keys(turn):
                first = before[-size:]
                del out[-2 * size :]
                out.append(_group(first))
                _add_turn(out[-1], turn)
                break
    return out


def align(a: list, b: list) -> list:
    """Two sibling lists as one: common keys in order are merged, the others become optional."""
    ka, kb = _keys(a), _keys(b)
    if ka == kb:
        return [merge(x, y) for x, y in zip(a, b)]
    lo = 0
    while lo < min(len(ka), len(kb)) and ka[lo] == kb[lo]:
        lo += 1
    hi = 0
    while hi < min(len(ka), len(kb)) - lo and ka[-1 - hi] == kb[-1 - hi]:
        hi += 1
    ma, mb = a[lo : len(a) - hi], b[lo : len(b) - hi]
    best = [[0] * (len(mb) + 1) for _ in range(len(ma) + 1)]
    for i in range(len(ma) - 1, -1, -1):
        for j in range(len(mb) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if ma[i][0] == mb[j][0] else max(best[i + 1][j], best[i][j + 1])
    middle, i, j = [], 0, 0
    while i < len(ma) or j < len(mb):
        if i < len(ma) and j < len(mb) and ma[i][0] == mb[j][0]:
            middle.append(merge(ma[i], mb[j]))
            i, j = i + 1, j + 1
        elif j >= len(mb) or i < len(ma) and best[i + 1][j] >= best[i][j + 1]:
            middle.append([ma[i][0], _more(ma[i][1], "?"), *ma[i][2:]])
            i += 1
        else:
            middle.append([mb[j][0], _more(mb[j][1], "?"), *mb[j][2:]])
            j += 1
    head = [merge(x, y) for x, y in zip(a[:lo], b[:lo])]
    tail = [merge(x, y) for x, y in zip(a[len(a) - hi :], b[len(b) - hi :])]
    return fold(head + middle + tail)


def expression(node: list) -> str:
    """The wrapper as a union-free regular expression; #TEXT is a slot."""
    text = "" if node[4] == "" else "#TEXT" if node[4] is None else node[4]
    inner = text + "".join(map(expression, node[5]))
    body = inner if not node[0] or node[0].startswith("(") else f"<{node[0]}>{inner}</{node[0].split('.')[0].split('@')[0]}>"
    return body if node[1] == "1" else f"({body}){node[1]}"


def main_path(root: list) -> list[str]:
    """Keys from the outermost element to the one that holds the main text; groups are looked through."""

    def total(n):
        return n[2] - n[3] + sum(map(total, n[5]))

    def children(n):
        for c in n[5]:
            if c[0].startswith("("):
                yield from children(c)
            else:
                yield c

    def rate(key: str) -> int:
        name = re.split(r"[.@]", key)[0]
        return 3 if name == "article" or "articlebody" in key else 2 if name == "main" or key.endswith("@main") else 1 if name in ("div", "section", "td") and MAIN_WORD.search(key) else 0

    everything = max(total(root), 1)
    found: list[tuple[int, int, list[str]]] = []

    def search(n, path):
        for c in children(n):
            here = [*path, c[0]]
            if rate(c[0]) and total(c) >= 0.4 * everything:
                found.append((rate(c[0]), -len(here), here))
            search(c, here)

    search(root, [])
    if found:
        return max(found)[2]
    node, path = root, []
    while True:
        inner = [c for c in children(node) if total(c) >= 0.7 * max(total(node), 1)]
        if len(inner) != 1 or not any(True for _ in children(inner[0])):
            return path
        node = inner[0]
        path.append(node[0])


def extract(page: str, path: list[str]) -> str:
    """Blocks of the element at ``path`` (or, where the page lacks it, of the page), without furniture."""
    events = list(walk(page))
    for where in (path, None):
        blocks, parts = [], []
        keys: list[str] = []
        marks: list[tuple[bool, bool, str]] = []
        out = inside = 0
        seen = where is None

        def end():
            text = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            if text:
                blocks.append(text)

        for kind, value, key, furniture in events:
            if kind == "open":
                block = value in BLOCK
                if block or value == "br":
                    end()
                header = not inside and bool(HEADER_WORD.search(key))
                # what the wrapper points at is no furniture, whatever it is called
                entered = False
                if block:
                    keys.append(key)
                    entered = where is not None and keys == where
                    seen |= entered
                    inside += entered or where is None and re.split(r"[.@]", key)[0] in ("article", "main")
                mark = (furniture or header) and not entered
                out += mark
                marks.append((block, mark, key if block and (entered or where is None and value in ("article", "main")) else ""))
            elif kind == "close":
                block, mark, entered = marks.pop()
                if block:
                    end()
                    keys.pop()
                out -= mark
                inside -= bool(entered)
            elif not out and (inside or where is None):
                parts.append(value)
        end()
        if seen:
            return "\n".join(blocks)
    return ""


def host_of(url: Column) -> Column:
    """Host name of a url in lower case; null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One wrapper for each host among rows (host, wrapper) or (host, heap, wrapper)."""
    held: dict[str, list] = {}
    for batch in batches:
        for host, text in zip(batch.column(0).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
            new = json.loads(text)
            held[host] = merge(held[host], new) if host in held else new
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([json.dumps(w) for w in held.values()])], ["host", "wrapper"])


def _inferred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Wrappers of the pages (host, html) of one task, handed on when there are many hosts."""
    held: dict[str, list] = {}

    def out():
        rows = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([json.dumps(w) for w in held.values()], pa.string())], ["host", "wrapper"])
        held.clear()
        return rows

    for batch in batches:
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            new = skeleton(page)
            held[host] = merge(held[host], new) if host in held else new
            if len(held) > 5_000:
                yield out()
    if held:
        yield out()


def infer(pages: DataFrame, url_col: str = "url", html_col: str = "html", heaps: int = 32) -> DataFrame:
    """(host, wrapper, expression, path) of every host that has pages."""
    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).where("host is not null and html <> ''")
    partial = rows.mapInArrow(_inferred, "host string, wrapper string")
    for heap in (F.pmod(F.xxhash64("wrapper", F.spark_partition_id()), F.lit(heaps)), F.lit(0)):
        # rows of one host and heap lie together, so one pass over a partition folds each host once
        partial = partial.withColumn("heap", heap).select("host", "heap", "wrapper").repartition("host", "heap").mapInArrow(_folded, "host string, wrapper string")

    def located(batches):
        for batch in batches:
            trees = [json.loads(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([expression(t) for t in trees], pa.string()), pa.array([main_path(t) for t in trees], pa.list_(pa.string()))], ["host", "wrapper", "expression", "path"])

    return partial.mapInArrow(located, "host string, wrapper string, expression string, path array<string>")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_hosts: int = 200_000) -> DataFrame:
    """(id, url, text, n_chars) of every page."""
    paths = staged(infer(pages, url_col, html_col).select("host", "path"), "wrappers")
    # a path is a few short keys, so this many hosts are a few tens of MB; more are joined by shuffle
    small = paths.limit(broadcast_hosts + 1).count() <= broadcast_hosts
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    joined = rows.join(F.broadcast(paths) if small else paths, "host", "left").select("id", "url", "html", "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                text = [extract(h, p or []) if h else "" for h, p in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], [id_col, url_col, "text", "n_chars"])

    schema = T.StructType([T.StructField(id_col, pages.schema[id_col].dataType), T.StructField(url_col, T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return joined.mapInArrow(run, schema)
