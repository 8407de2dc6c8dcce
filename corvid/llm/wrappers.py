"""HTML main-text extraction by union-free regular-expression inference.

A page becomes a token stream of block elements and texts; unclosed elements are closed as browsers
do. A text that stands on SAME_PAGES or more different pages of a host, and on SAME_SHARE of them, is
a literal of the host's template; other texts are slots. Neighbouring units of one kind, also
sequences of two or three, fold into repeated groups. The streams of one host are then aligned one
after the other with the host's wrapper, a regular expression without unions: what only one side has
becomes optional, what repeats on one side becomes a repeated group. Wrappers of parts of a host are
aligned in the same way. Parts are dealt by a hash of the page and each is aligned in the order of
its streams, so the wrapper doesn't depend on how the pages were partitioned.

A wrapper's slots are then judged: by their elements (menus, headers, footers, sidebars, notices,
adverts, forms, comments), by whether link text prevails, by the mean length of their texts on all
pages, and literals go. Where a page has an article or main element, or one that is named so, its
texts, also literals, are the page's; elsewhere the wrapper decides. A page is aligned with its
host's wrapper, and the texts of the main slots, in page order, are its text.

Every step is linear in the page but for the alignment of siblings, whose table has at most CELLS
cells; beyond, kinds that stand once on both sides split the siblings first. Elements nested deeper than DEPTH
are taken as children of their ancestor there.

Defined results: null or empty html: empty text. A null url, or one without a host, belongs to the
host ''. Pages without any markup are one text slot. Repeated rows: equal results; they count as one page. Extra columns are ignored.
A tag that never ends is text. Empty table: empty result.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, maybe_broadcast, small_batches

#: Elements whose content is never text, and elements without content.
RAW = "script style noscript template textarea iframe svg math object canvas video audio select"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that stand within a line.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter output progress q ruby rb rp rt s samp small span strike strong sub sup time tt u var br wbr img nobr center blink".split())
#: Elements that an opening element of the same set ends, and those it ends.
ENDS = {"p": "p", "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "body": "head"}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SCOPES = frozenset("table ul ol dl div article section main aside nav header footer form body html".split())
#: Elements and words of class, id and role that don't hold main text.
OUTSIDE = frozenset("head title nav footer aside form menu dialog button fieldset legend".split())
WORDS = frozenset("ad ads adv advert adverts advertisement advertising adbox adslot banner banners sponsor sponsored sponsors promo promos promotion menu menus nav navbar navigation breadcrumb breadcrumbs sidebar sidebars aside widget widgets footer foot header masthead topbar toolbar cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments commentlist respond disqus replies reply pagination pager skip complementary contentinfo search searchbox copyright disclaimer legal paywall tracking".split())
MAIN = frozenset({"article", "main"})
#: Words of class, id and role that name main text; in a kind they have a plus.
MAIN_WORDS = frozenset("article content main post entry story".split())
NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9:-]*)")
TAG_END = re.compile(r"""(?:"[^"]*+"|'[^']*+'|[^'">])*+>""")
RAW_END = {name: re.compile(rf"</{name}\s*+>", re.I) for name in RAW.split()}
ATTR = re.compile(r"""\b(?:class|id|role)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: A literal stands on so many different pages of its host, and on such a share of them.
SAME_PAGES, SAME_SHARE = 4, 0.3
#: Levels of elements, cells of an alignment's table, and bytes of streams that are aligned by one task.
DEPTH, CELLS, PART_BYTES = 48, 250_000, 256 << 10
#: Parts whose wrappers are aligned by one task.
ARITY = 64

# A page's node is [kind, children], a text's [kind, words, number]. A wrapper's node is [kind,
# optional, repeated, children, stats]. Kinds: an element's name and the words of WORDS among its
# class, id and role; "#" a text, "#m" one within main elements, "#l" one mostly of links, "#o" one
# that is never main, and "#=" with a hash a literal; "(kinds)" a group. Stats of texts: [pages, words].


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """(what, name, text): "text", or "open" or "close" with the element's name and its attributes; in one pass."""
    at, end = 0, len(html)
    while at < end:
        lt = html.find("<", at)
        if lt != at:
            yield "text", "", html[at : lt if lt >= 0 else end]
            if lt < 0:
                return
        if html.startswith("<!--", lt):
            stop = html.find("-->", lt + 4)
            at = stop + 3 if stop >= 0 else end
        elif html.startswith("<![CDATA[", lt):
            stop = html.find("]]>", lt)
            yield "text", "", html[lt + 9 : stop if stop >= 0 else end]
            at = stop + 3 if stop >= 0 else end
        elif html.startswith(("<!", "<?"), lt):
            stop = html.find(">", lt)
            at = stop + 1 if stop >= 0 else end
        elif (m := NAME.match(html, lt + 1)) is None:
            yield "text", "", "<"
            at = lt + 1
        else:
            whole = TAG_END.match(html, m.end())  # an unclosed quote can fail it once for either kind of quote
            stop = whole.end() if whole else html.find(">", m.end()) + 1
            if not stop:
                yield "text", "", html[lt:]
                return
            name, attrs = m[1].lower(), html[m.end() : stop - 1]
            at = stop
            if html[lt + 1] == "/":
                yield "close", name, ""
            elif name in RAW_END:
                yield "text", "", " "
                close = RAW_END[name].search(html, stop)
                at = close.end() if close else end
            else:
                yield "open", name, attrs


class Stack:
    """The open elements; finds the nearest of some names, or that a scope lies between, without walking them."""

    def __init__(self, root: list):
        self.open = [("", root, False, False)]  # name, node, outside of main text, within main text
        self.at: dict[str, list[int]] = {}
        self.scopes: list[int] = []

    def push(self, name: str, node: list, outside: bool, main: bool) -> None:
        self.at.setdefault(name, []).append(len(self.open))
        if name in SCOPES:
            self.scopes.append(len(self.open))
        self.open.append((name, node, outside, main))

    def close(self, names: tuple[str, ...], scoped: bool) -> None:
        i = max((self.at[n][-1] for n in names if self.at.get(n)), default=0)
        if not i or (scoped and self.scopes and self.scopes[-1] > i):
            return
        while len(self.open) > i:
            self.at[self.open.pop()[0]].pop()
        while self.scopes and self.scopes[-1] >= i:
            self.scopes.pop()


def parse(html: str | None) -> tuple[list, list[str]]:
    """The page's tree, and its texts but for those that are never main."""
    root: list = ["", []]
    stack, texts = Stack(root), []
    buffer: list[str] = []
    links, in_link = 0, False

    def flush() -> None:
        nonlocal links
        _, node, outside, main = stack.open[-1]
        if buffer and outside:
            if n := sum(len(x.split()) for x in buffer):
                node[1].append(["#o", n, -1])
        elif buffer and (words := entities.unescape("".join(buffer)).split()):
            node[1].append(["#m" if main else "#l" if 2 * links > len(words) else "#", len(words), len(texts)])
            texts.append(" ".join(words))
        buffer.clear()
        links = 0

    for what, name, text in tokens(html or ""):
        if what == "text":
            buffer.append(text)
            links += len(text.split()) if in_link else 0
            continue
        if name in INLINE:
            if name == "a":
                in_link = what == "open"
            elif name == "br":
                buffer.append(" ")
            continue
        flush()
        in_link = False
        if what == "close":
            stack.close((name,), False)
            continue
        if name in ENDS_P:
            stack.close(("p",), True)
        if name in ENDS and name != "p":
            stack.close(tuple(ENDS[name].split()), True)
        if name in VOID:
            continue
        words = {w for a in ATTR.findall(text) for w in re.split(r"[^a-z0-9]+", "".join(a).lower())} if "=" in text else set()
        named = bool(words & MAIN_WORDS) and name in ("div", "section")
        marks = sorted(words & WORDS)
        _, _, outside, main = stack.open[-1]
        outside = outside or name in OUTSIDE or (name == "header" and not main) or (bool(marks) and name not in ("body", "html") and name not in MAIN)
        node = [".".join([name, *(marks or ["+main"] * named)]), []]
        stack.open[min(len(stack.open), DEPTH) - 1][1][1].append(node)
        if not text.rstrip().endswith("/"):
            stack.push(name, node, outside, main or name in MAIN or (named and not marks))
    flush()
    return root, texts


def text_hash(text: str) -> int:
    """48 bits, so that JSON holds it exactly."""
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")) >> 16


def nodes_of(node: list, hashes: list[int], literal: set[int]) -> list:
    """A page's node as a wrapper's; texts that are literals of the host get kinds of their own."""
    if node[0].startswith("#"):
        kind = f"{node[0]}={hashes[node[2]]}" if node[2] >= 0 and hashes[node[2]] in literal else node[0]
        return [kind, False, False, [], [1, node[1]]]
    return [node[0], False, False, [nodes_of(c, hashes, literal) for c in node[1]], None]


def merge(a: list, b: list) -> list:
    """Nodes of one kind aligned: the wrapper of both."""
    return [a[0], a[1] or b[1], a[2] or b[2], align(a[3], b[3]) if a[3] or b[3] else [], [a[4][0] + b[4][0], a[4][1] + b[4][1]] if a[4] else None]


def within_page(node: list) -> list:
    """A unit that repeats in a page counts its texts once for the page."""
    return [node[0], node[1], node[2], [within_page(c) for c in node[3]], [1, node[4][1]] if node[4] else None]


def fold(children: list) -> list:
    """Children with runs of one kind, or of two or three kinds in turn, folded into repeated groups."""
    children = [[c[0], c[1], c[2], fold(c[3]), c[4]] for c in children]
    for period in (1, 2, 3):
        kinds, out, i = [c[0] for c in children], [], 0
        while i < len(children):
            unit, n = kinds[i : i + period], 1
            while len(unit) == period and kinds[i + n * period : i + (n + 1) * period] == unit:
                n += 1
            if n == 1 or (period > 1 and len(set(unit)) == 1):
                out.append(children[i])
                i += 1
                continue
            own = children[i : i + period]
            for k in range(1, n):
                own = [merge(a, b) for a, b in zip(own, children[i + k * period : i + (k + 1) * period], strict=True)]
            if period == 1:
                out.append(within_page([own[0][0], own[0][1], True, own[0][3], own[0][4]]))
            else:
                out.append(within_page(["(" + " ".join(unit) + ")", False, True, own, None]))
            i += n * period
        children = out
    return children


def grouped(children: list, other: list) -> list:
    """children with the sequences that are repeated groups in other wrapped as such groups."""
    for g in other:
        if not g[0].startswith("("):
            continue
        unit, out, i = [c[0] for c in g[3]], [], 0
        while i < len(children):
            if [c[0] for c in children[i : i + len(unit)]] == unit:
                out.append([g[0], False, False, children[i : i + len(unit)], None])
                i += len(unit)
            else:
                out.append(children[i])
                i += 1
        children = out
    return children


def pairs(a: list[str], b: list[str]) -> list[tuple[int | None, int | None]]:
    """Kinds that match, as places in a and b, in the order of both; None where one side has none."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    out: list[tuple[int | None, int | None]] = [(i, i) for i in range(head)]
    out += [(None if i is None else head + i, None if j is None else head + j) for i, j in middle(a[head : len(a) - tail], b[head : len(b) - tail])]
    return out + [(len(a) - tail + k, len(b) - tail + k) for k in range(tail)]


def middle(a: list[str], b: list[str]) -> list[tuple[int | None, int | None]]:
    """A longest common subsequence; of sequences too long for its table, one through the kinds that stand once on both sides."""
    if len(a) * len(b) <= CELLS:
        return common(a, b)
    once = lambda x: {k for k, n in zip(*np.unique(np.array(x, object).astype(str), return_counts=True), strict=True) if n == 1}
    shared, where = once(a) & once(b), {k: j for j, k in enumerate(b)}
    # The longest run of shared kinds in the order of both: the least last place of a run of each length, and the one before it.
    ends: list[int] = []
    last: list[int] = []
    before: dict[int, int] = {}
    for i, k in enumerate(a):
        if k in shared:
            n = int(np.searchsorted(ends, where[k])) if ends else 0
            before[i] = last[n - 1] if n else -1
            ends[n : n + 1], last[n : n + 1] = [where[k]], [i]
    anchors, i = [], last[-1] if last else -1
    while i >= 0:
        anchors.append((i, where[a[i]]))
        i = before[i]
    out: list[tuple[int | None, int | None]] = []
    x = y = 0
    for i, j in [*reversed(anchors), (len(a), len(b))]:
        small = (i - x) * (j - y) <= CELLS
        between = common(a[x:i], b[y:j]) if small else [(k, None) for k in range(i - x)] + [(None, k) for k in range(j - y)]
        out += [(None if p is None else x + p, None if q is None else y + q) for p, q in between]
        out += [(i, j)] if i < len(a) else []
        x, y = i + 1, j + 1
    return out


def common(a: list[str], b: list[str]) -> list[tuple[int | None, int | None]]:
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        row, below, k = best[i], best[i + 1], a[i]
        for j in range(len(b) - 1, -1, -1):
            row[j] = below[j + 1] + 1 if k == b[j] else max(below[j], row[j + 1])
    out: list[tuple[int | None, int | None]] = []
    i = j = 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif j == len(b) or (i < len(a) and best[i + 1][j] >= best[i][j + 1]):
            out.append((i, None))
            i += 1
        else:
            out.append((None, j))
            j += 1
    return out


def align(a: list, b: list) -> list:
    """The wrapper of two sequences: matches merged, the rest optional; neighbours of one kind, which arise where one side's match lies between, repeat."""
    if any(x[0].startswith("(") for x in b):
        a = grouped(a, b)
    if any(x[0].startswith("(") for x in a):
        b = grouped(b, a)
    out: list = []
    for i, j in pairs([x[0] for x in a], [x[0] for x in b]):
        if i is not None and j is not None:
            node = merge(a[i], b[j])
        else:
            node = a[i] if j is None else b[j]
            node = [node[0], True, *node[2:]]
        if out and out[-1][0] == node[0]:
            m = merge(out[-1], node)
            out[-1] = [m[0], out[-1][1] and node[1], True, m[3], m[4]]
        else:
            out.append(node)
    return out


def judged(wrapper: list, literal: list[int]) -> dict:
    """literal: hashes; tree: the wrapper's nodes as [kind, children, rank]: 1 at texts of main elements, 2 at texts that are main where a page has none of these, else 0."""
    blocks = re.compile(r"(p|h[1-6]|li|pre|blockquote|td|th|dd|dt|figcaption)\b")

    def ranked(node: list, holder: str) -> list:
        kind, stats, rank = node[0], node[4], 0
        if kind.startswith("#m"):
            rank = 1
        elif kind == "#" and (stats[1] >= 5 * stats[0] or blocks.match(holder)):
            rank = 2
        below = holder if kind.startswith(("#", "(")) else kind
        return [kind, [ranked(c, below) for c in node[3]], rank]

    return {"literal": literal, "tree": ranked(wrapper, "")}


def extract(root: list, texts: list[str], literal: set[int], tree: list) -> str:
    """The texts of a page that its wrapper's main slots take, in page order."""
    out: dict[int, list[int]] = {0: [], 1: [], 2: []}
    hashes = [text_hash(t) for t in texts] if literal else []
    todo = [(root[1], tree[1])]
    while todo:
        children, slots = todo.pop()
        # Each child goes to the nearest slot of its kind, from the last one taken on; groups stand for what is in them.
        flat = [x for s in slots for x in (s[1] if s[0].startswith("(") else [s])]
        of: dict[str, list[int]] = {}
        for i, s in enumerate(flat):
            of.setdefault(s[0], []).append(i)
        place = 0
        for c in children:
            text = c[0].startswith("#")
            kind = f"{c[0]}={hashes[c[2]]}" if text and literal and c[2] >= 0 and hashes[c[2]] in literal else c[0]
            if found := of.get(kind):
                at = next((i for i in found if i >= place), found[-1])
                place = max(place, at)
                if text:
                    out[flat[at][2]].append(c[2])
                else:
                    todo.append((c[1], flat[at][1]))
    return "\n".join(texts[i] for i in sorted(out[1] or out[2]))


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def streams(html: Column) -> Column:
    """A struct of stream (the page's tree, JSON) and hashes (of its texts, in their order)."""

    @F.pandas_udf("stream string, hashes array<long>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            parsed = [parse(h) for h in s]
            yield pd.DataFrame({"stream": [json.dumps(root, separators=(",", ":")) for root, _ in parsed], "hashes": [[text_hash(t) for t in texts] for _, texts in parsed]})

    return of(html)


def aligned(wrappers: list[list]) -> str:
    out = wrappers[0]
    for w in wrappers[1:]:
        out = merge(out, w)
    return json.dumps(out, separators=(",", ":"))


def align_streams(pdf: pd.DataFrame) -> pd.DataFrame:
    """The wrapper of a part's streams, aligned in their own order."""
    literal = set(pdf["literal"].iloc[0])
    pages = sorted(zip(pdf["stream"], map(tuple, pdf["hashes"]), strict=True))
    built = (nodes_of(json.loads(s), h, literal) for s, h in pages)
    return pd.DataFrame({"host": [pdf["host"].iloc[0]], "part": [pdf["part"].iloc[0]], "wrapper": [aligned([[*n[:3], fold(n[3]), None] for n in built])]})


def align_wrappers(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("own")
    return pd.DataFrame({"host": [pdf["host"].iloc[0]], "part": [pdf["part"].iloc[0]], "wrapper": [aligned([json.loads(w) for w in pdf["wrapper"]])]})


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (JSON), literal (hashes) of every host of pages (host, html): parts by a hash, then ARITY parts together until one is left."""
    rows = pages.select("host", streams(F.col("html")).alias("s")).select("host", "s.*")
    rows = cut(rows.groupBy("host", "stream", "hashes").agg(F.count(F.lit(1)).alias("n")).drop("n"))
    size = F.octet_length("stream") + 8 * F.size("hashes")
    hosts = cut(rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.ceil(F.sum(size) / PART_BYTES).alias("parts")))
    n_hosts, parts = hosts.agg(F.count(F.lit(1)), F.max("parts")).first()
    seen = rows.select("host", F.explode(F.array_distinct("hashes")).alias("h")).groupBy("host", "h").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= SAME_PAGES)
    seen = seen.join(maybe_broadcast(hosts, n_hosts), "host").where(F.col("k") >= SAME_SHARE * F.col("pages"))
    literal = seen.groupBy("host").agg(F.sort_array(F.collect_list("h")).alias("literal"))  # at most 1 / SAME_SHARE times a page's texts
    known = cut(hosts.join(literal, "host", "left").select("host", "parts", F.coalesce("literal", F.array().cast("array<bigint>")).alias("literal")))
    dealt = rows.join(maybe_broadcast(known, n_hosts), "host").withColumn("part", F.pmod(F.xxhash64("stream", "hashes"), F.col("parts")))
    out = dealt.groupBy("host", "part").applyInPandas(align_streams, "host string, part long, wrapper string")
    while (parts or 1) > 1:
        out = out.withColumnRenamed("part", "own").withColumn("part", F.floor(F.col("own") / ARITY)).groupBy("host", "part").applyInPandas(align_wrappers, "host string, part long, wrapper string")
        parts = -(-parts // ARITY)
    return out.join(maybe_broadcast(known, n_hosts), "host").select("host", "wrapper", "literal")


#: Wrappers are broadcast if their JSON has at most so many bytes together.
BROADCAST_BYTES = 16 << 20


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    small_batches(pages)
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))

    @F.pandas_udf("string")
    def slots(wrapper: pd.Series, literal: pd.Series) -> pd.Series:
        return pd.Series([json.dumps(judged(json.loads(w), [int(x) for x in h]), separators=(",", ":")) for w, h in zip(wrapper, literal, strict=True)])

    known = cut(wrappers(rows).select("host", slots(F.col("wrapper"), F.col("literal")).alias("slots")))
    size = known.agg(F.sum(F.octet_length("slots"))).first()[0] or 0
    joined = rows.join(F.broadcast(known) if size <= BROADCAST_BYTES else known, "host")

    @F.pandas_udf("string")
    def taken(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        loaded: dict[str, tuple] = {}
        for html, slots in batches:
            out = []
            for h, s in zip(html, slots, strict=True):
                if s not in loaded:
                    if len(loaded) > 1000:
                        loaded.clear()
                    own = json.loads(s)
                    loaded[s] = set(own["literal"]), own["tree"]
                out.append(extract(*parse(h), *loaded[s]))
            yield pd.Series(out, dtype=object)

    out = joined.select("page_id", "url", taken(F.col("html"), F.col("slots")).alias("text"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
