"""Main text of web pages through wrappers that are inferred per host.

A page's block elements form a token stream, kept as an ordered tree. Streams of one host are aligned
one after another: equal siblings in a row (or groups of two or three) fold into repeated groups,
elements that one side lacks become optional, texts that differ become slots. The outcome is a union-free
regular expression for the host, which grows with the kinds of elements and not with pages: a row of siblings that stays
long becomes a group of optional members, one a kind. Wrappers merge with wrappers; so each task folds its own pages,
and only partial wrappers are shuffled, salted first.

Extraction drops what markup itself names as no article (menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles, reader comments), and keeps the part of the host's wrapper whose slots hold
the varying text, within it the text of `article` or `main` where there is any. An article elsewhere stays too, unless
most pages of the host have it beside their main part, as a teaser. Constant texts inside an article or a main part stay.
Where the main part is the whole page, or a page has none, constant texts before and after all others go.
On hosts with too few pages for constants, `article` and `main` decide alone.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Generator, Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import lru_cache
from html import unescape
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import texts_of
from .common import written

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
WORD = re.compile(r"[a-z]+")
BLOCKS = frozenset("address article aside blockquote body button canvas center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template title textarea iframe svg math object xmp".split())
DROPPED = frozenset("head nav footer aside form script style noscript template title textarea iframe svg math object select option button dialog menu search".split())
#: Names in class or id of parts outside the article. A name of several words ("cookie-notice", "ad_box") is meant if
#: they all stand here or in NEUTRAL_WORDS: "share-buttons" is one, "share-prices" and "social-history" are none.
DROPPED_WORDS = frozenset(
    "ad ads adsense adslot advert adverts advertisement advertising adbox banner promo promotion sponsor sponsored sidebar menu nav navbar navigation navi breadcrumb breadcrumbs footer masthead "
    "topbar cookie cookies consent gdpr notice notices notification alert popup modal overlay paywall subscribe subscription newsletter signup login share sharing social related recommended "
    "recommendations comment comments commentlist disqus reply replies respond widget toolbar pagination pager skip".split()
)
NEUTRAL_WORDS = frozenset("a area bar block body bottom box button buttons center container content form group head icons inner item items left link links list main outer panel part posts right row section site slot text thread top unit user wrap wrapper".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status".split())
#: Dropped outside an article only: an article has its own header.
OUTER_WORDS = frozenset(["header", "site", "page"])
MAIN = frozenset(["article", "main"])
#: Elements that are text rather than parts of a page.
TEXT_BLOCKS = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre ul ol dl table figure".split())
#: What an opening tag closes, and where the search for it ends.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set()),
}
#: Pages a host must have before its constant texts count as its own.
CONSTANT_PAGES = 3
#: Siblings in a wrapper, after folding, beyond which their order is given up.
SIBLINGS = 48


def names_outside(name: str) -> bool:
    """Whether a class or id names a part outside the article."""
    words = WORD.findall(name)
    return any(w in DROPPED_WORDS for w in words) and all(w in DROPPED_WORDS or w in NEUTRAL_WORDS for w in words)


def attributes(raw: str) -> tuple[str, list[str], bool]:
    """(label part, names in class and id, hidden) of an opening tag."""
    label, names, role, hidden = "", [], "", False
    for m in ATTRIBUTE.finditer(raw):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id"):
            names += value.split()
            found = WORD.findall(value)
            label += "." + "-".join(found) if found else ""
        elif name == "role":
            role = value
        else:
            hidden |= name == "hidden" or value == "true"
    if role in DROPPED_ROLES:
        hidden = True
    return label + ("@main" if role == "main" else ""), names, hidden


def node(label: str) -> dict:
    return {"l": label, "n": 1, "c": 0, "t": None, "k": []}


def bounced(work: Generator):
    """The result of a recursive generator that yields its calls, kept on a list: pages may be nested at any depth."""
    calls, value = [work], None
    while calls:
        try:
            calls.append(calls[-1].send(value))
            value = None
        except StopIteration as end:
            calls.pop()
            value = end.value
    return value


class Page:
    """Blocks of text, (path of open block elements, in an article or main, text), and the tree.

    A path is a number: `paths` gives that of a path and one more label, from 0, the page, on.
    """

    def __init__(self, html: str) -> None:
        self.blocks: list[tuple[int, bool, str]] = []
        self.root = node("")
        self.paths: dict[tuple[int, str], int] = {}
        # name, is block, dropped, in main, tree node, path
        self.stack: list[tuple] = [("", True, False, False, self.root, 0)]
        self.opened: Counter[str] = Counter()
        self.buffer: list[str] = []
        at = 0
        while at < len(html):
            m = TOKEN.search(html, at)
            if m is None:
                self.text(html[at:])
                break
            if m.start() > at:
                self.text(html[at : m.start()])
            at = m.end()
            name = m[2] or m[5]
            if name is None:
                continue
            name = name.lower()
            if m[1] or m[4]:
                self.close(name)
            else:
                raw = m[3] if m[2] else m[6]
                self.open(name, raw)
                if name in RAW and not raw.endswith("/"):
                    end = re.compile(f"</{name}", re.I).search(html, at)
                    at = end.start() if end else len(html)
        self.flush()
        # tells a host with copies of one page only, whose texts are no template
        self.root["h"] = crc32("\n".join(b[2] for b in self.blocks).encode("utf-8", "replace"))

    def text(self, raw: str) -> None:
        if not self.stack[-1][2]:
            self.buffer.append(unescape(raw) if "&" in raw else raw)

    def flush(self) -> None:
        if not self.buffer:
            return
        text = " ".join("".join(self.buffer).split())
        self.buffer.clear()
        if text:
            _, _, _, in_main, tree, path = next(s for s in reversed(self.stack) if s[1])
            self.blocks.append((path, in_main, text))
            tree["t"] = crc32(text.encode("utf-8", "replace")) if not tree["c"] else -1
            tree["c"] += len(text)

    def pop_to(self, k: int) -> None:
        if any(s[1] for s in self.stack[k:]):
            self.flush()
        self.opened.subtract(s[0] for s in self.stack[k:])
        del self.stack[k:]

    def close(self, name: str) -> None:
        block = name in BLOCKS
        if not self.opened[name]:
            return None
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] == name:
                return self.pop_to(k)
            if not block and self.stack[k][1]:
                return None

    def open(self, name: str, raw: str) -> None:
        if name == "br" or name == "wbr":
            if name == "br":
                self.text(" ")
            return
        block = name in BLOCKS
        if block:
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k][0] == "p":
                    self.pop_to(k)
                    break
                if self.stack[k][1]:
                    break
            if name in CLOSES:
                what, until = CLOSES[name]
                for k in range(len(self.stack) - 1, 0, -1) if any(self.opened[x] for x in what) else ():
                    if self.stack[k][0] in what:
                        self.pop_to(k)
                        break
                    if self.stack[k][0] in until:
                        break
            self.flush()
        if name in VOID:
            return
        _, _, dropped, in_main, tree, path = self.stack[-1]
        extra, names, hidden = attributes(raw) if raw and not raw.isspace() else ("", [], False)
        root = name in ("html", "body") or name in MAIN and not any(w in ("comment", "comments", "reply") for x in names for w in WORD.findall(x))
        dropped = dropped or hidden or name in DROPPED or (not root and any(map(names_outside, names))) or (not in_main and (name == "header" or (not root and any(OUTER_WORDS.issuperset(WORD.findall(x)) for x in names))))
        in_main = in_main or name in MAIN or extra.endswith("@main")
        if block:
            label = name + extra
            path = self.paths.setdefault((path, label), len(self.paths) + 1)
            if not dropped:
                child = node(label)
                tree["k"].append(child)
                tree = child
        self.opened[name] += 1
        self.stack.append((name, block, dropped, in_main, tree, path))


def merging(a: dict, b: dict) -> Generator:
    """Two nodes with one label: texts that differ become a slot (-1), children are aligned."""
    text = b["t"] if a["t"] is None else a["t"] if b["t"] is None or a["t"] == b["t"] else -1
    out = {"l": a["l"], "n": a["n"] + b["n"], "c": a["c"] + b["c"], "t": text, "k": (yield aligning(a["k"], b["k"]))}
    for q in ("q", "r"):
        if a.get(q) or b.get(q):
            out[q] = 1
    if "h" in a:
        out["h"] = a["h"] if a["h"] == b.get("h") else -1
    return out


def aligning(a: list[dict], b: list[dict]) -> Generator:
    la, lb = [x["l"] for x in a], [x["l"] for x in b]
    out = []
    if la != lb and max(len(a), len(b)) > SIBLINGS:
        a, b = (yield gathering(a)), (yield gathering(b))
        there = {x["l"]: x for x in b}
        for x in a:
            y = there.pop(x["l"], None)
            out.append((yield merging(x, y)) if y else x | {"q": 1})
        return out + [x | {"q": 1} for x in there.values()]
    for tag, i1, i2, j1, j2 in [("equal", 0, len(a), 0, len(b))] if la == lb else SequenceMatcher(None, la, lb, autojunk=False).get_opcodes():
        if tag == "equal":
            for x, y in zip(a[i1:i2], b[j1:j2]):
                out.append((yield merging(x, y)))
        else:
            out += [x | {"q": 1} for x in (*a[i1:i2], *b[j1:j2])]
    return (yield folding(out))


def repeating(a: dict, b: dict) -> Generator:
    """Two siblings of one repeated group: pages are not counted twice, and the text is a slot."""
    out = (yield merging(a, b)) | {"n": max(a["n"], b["n"]), "r": 1}
    if a["c"] or b["c"]:
        out["t"] = -1
    if not (a.get("q") and b.get("q")):
        out.pop("q", None)
    return out


def folding(nodes: list[dict]) -> Generator:
    """Groups of one to three siblings that occur again right after themselves become repeated."""
    for size in (1, 2, 3):
        done: list[dict] = []
        for x in nodes:
            done.append(x)
            if len(done) >= 2 * size and all(done[k - 2 * size]["l"] == done[k - size]["l"] for k in range(size)):
                again = [done.pop() for _ in range(size)][::-1]
                for k in range(size):
                    done[k - size] = yield repeating(done[k - size], again[k])
        nodes = done
    return (yield gathering(nodes)) if len(nodes) > SIBLINGS else nodes


def gathering(nodes: list[dict]) -> Generator:
    """A long row of siblings as a group of optional members, one a label. Paths are by label, so none is lost."""
    found: dict[str, dict] = {}
    for x in nodes:
        found[x["l"]] = ((yield repeating(found[x["l"]], x)) if x["l"] in found else x) | {"q": 1}
    return list(found.values())


def merge(a: dict, b: dict) -> dict:
    return bounced(merging(a, b))


def bottom_up(tree: dict) -> list[dict]:
    """All nodes, children before their parents."""
    out, left = [], [tree]
    while left:
        x = left.pop()
        out.append(x)
        left += x["k"]
    return out[::-1]


def folded(tree: dict) -> dict:
    """The tree with its repeated siblings folded, in place."""
    for x in bottom_up(tree):
        x["k"] = bounced(folding(x["k"]))
    return tree


def dumped(tree: dict) -> str:
    """JSON of a tree as a list of nodes, parents before their children, each with its depth."""
    out, left = [], [(0, tree)]
    while left:
        depth, x = left.pop()
        out.append({"d": depth} | {a: b for a, b in x.items() if a != "k"})
        left += [(depth + 1, y) for y in reversed(x["k"])]
    return json.dumps(out)


def loaded(raw: str) -> dict:
    path: list[dict] = []
    for x in json.loads(raw):
        del path[x.pop("d") :]
        x["k"] = []
        if path:
            path[-1]["k"].append(x)
        path.append(x)
    return path[0]


def expression(tree: dict) -> str:
    """The wrapper as a regular expression over tags: `+` repeated, `?` optional, `#` a text slot, `'` a constant text."""

    def of(x: dict) -> Generator:
        inner = "#" if x["t"] == -1 else "'" if x["t"] is not None else ""
        for y in x["k"]:
            inner += yield of(y)
        own = f"<{x['l']}>{inner}</>" if x["l"] else inner
        return f"({own}){'+' if x.get('r') else ''}{'?' if x.get('q') else ''}" if x.get("r") or x.get("q") else own

    return bounced(of(tree))


def with_varying(tree: dict) -> dict:
    """Every node with `v`: characters of slot texts in it."""
    for x in bottom_up(tree):
        x["v"] = (x["c"] if x["t"] == -1 else 0) + sum(y["v"] for y in x["k"])
    return tree


def is_main(label: str) -> bool:
    return label.split(".")[0].split("@")[0] in MAIN or label.endswith("@main")


@dataclass(frozen=True)
class Rules:
    """What a wrapper says of its host's pages. Paths are numbers, as in Page; `steps` holds (path, label) of path 1, 2, ..."""

    steps: tuple[tuple[int, str], ...] = ()
    main: int = 0
    #: Headings, paragraphs, lists, tables and whatever itself holds varying text, beside the main part or a part around it.
    beside: tuple[int, ...] = ()
    #: Is the main part the whole page?
    whole: bool = True
    #: Articles of half the pages or more that stand outside the main part.
    teasers: tuple[int, ...] = ()
    #: (path, hash) of texts that all pages share.
    constants: tuple[tuple[int, int], ...] = ()
    #: Are there pages enough to go by the wrapper alone?
    enough: bool = False


@lru_cache(maxsize=4096)
def rules(wrapper: str) -> Rules:
    """The main part is the deepest element that holds most of the varying text, and at most the article or main on the way to it.
    A headline or lead beside it, or beside a part around it, belongs to it where it varies from page to page."""
    w = with_varying(loaded(wrapper))
    paths: dict[tuple[int, str], int] = {}
    below = lambda path, x: paths.setdefault((path, x["l"]), len(paths) + 1)
    main, at, beside, around = 0, w, [], [0]
    while at["v"]:
        best = max(at["k"], key=lambda x: x["v"], default=None)
        if best is None or 10 * best["v"] < 7 * at["v"] or best.get("r"):
            break
        beside += [below(main, x) for x in at["k"] if x is not best and (x["t"] == -1 or x["v"] and x["l"].split(".")[0].split("@")[0] in TEXT_BLOCKS)]
        main, at = below(main, best), best
        around.append(main)
        if is_main(best["l"]):
            break
    whole = at["l"].split(".")[0] in ("", "html", "body")
    same, teasers, left = set(), set(), [(0, w)] if w["v"] and w.get("h") == -1 else []
    while left:
        path, x = left.pop()
        if is_main(x["l"]) and path not in around and 2 * x["n"] >= w["n"]:
            teasers.add(path)
        if x["t"] not in (None, -1) and x["n"] >= CONSTANT_PAGES and not x.get("r"):
            same.add((path, x["t"]))
        left += [(below(path, y), y) for y in x["k"]] if whole or path != main else []
    return Rules(tuple(paths), main, tuple(beside), whole, tuple(teasers), tuple(same), w["n"] >= CONSTANT_PAGES)


def main_text(html: str, wrapper: str | None) -> str:
    page, rule = Page(html), rules(wrapper) if wrapper else Rules()
    blocks, here = page.blocks, [0]
    for path, label in rule.steps:  # the wrapper's paths in this page, -1 if it has them not
        here.append(page.paths.get((here[path], label), -1))
    fixed = {(here[path], text) for path, text in rule.constants}

    def below(parts: set[int]) -> list[bool]:
        """Of each path whether it is one of these or inside one."""
        out = [0 in parts]
        for k, (path, _) in enumerate(page.paths, 1):
            out.append(out[path] or k in parts)
        return out

    def trimmed(some: list[tuple]) -> list[tuple]:
        own = [k for k, b in enumerate(some) if (b[0], crc32(b[2].encode("utf-8", "replace"))) not in fixed] if fixed else []
        return some[own[0] : own[-1] + 1] if own else some

    in_part = below({here[rule.main], *(here[k] for k in rule.beside)} if here[rule.main] >= 0 else set())
    inside = [b for b in blocks if b[1]]
    part = [b for b in blocks if in_part[b[0]]]
    if inside and not rule.enough:
        kept = inside
    elif part:
        teaser = below({here[k] for k in rule.teasers})
        marked = any(b[1] for b in part)
        kept = [b for b in blocks if in_part[b[0]] and b[1] >= marked or b[1] and not teaser[b[0]]]
        kept = kept if inside or not rule.whole else trimmed(kept)
    else:
        kept = inside or trimmed(blocks)
    return "\n".join(b[2] for b in kept)


def host_of(url: F.Column) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)", 1))


#: Hosts a task keeps at once before it passes their partial wrappers on.
HOSTS_IN_TASK = 2000


def host_wrappers(pages: DataFrame, salts: int = 32) -> DataFrame:
    """(host, wrapper) over all pages: folded in each task, then by host and salt, then by host."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(map(dumped, found.values()), pa.string())], names=["host", "wrapper"])

        found: dict[str, dict] = {}
        for batch in batches:
            for host, html in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                tree = folded(Page(html).root)
                found[host] = merge(found[host], tree) if host in found else tree
            if len(found) > HOSTS_IN_TASK:
                yield out()
                found.clear()
        if found:
            yield out()

    def merged(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        parts = sorted(table.column("wrapper").to_pylist())
        whole = loaded(parts[0])
        for p in parts[1:]:
            whole = merge(whole, loaded(p))
        return pa.table({"host": [key[0].as_py()], "wrapper": [dumped(whole)]})

    parts = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(partial, "host string, wrapper string")
    for keys in (["host", F.pmod(F.xxhash64("wrapper"), F.lit(salts)).alias("salt")], ["host"]):
        parts = parts.groupBy(*keys).applyInArrow(merged, "host string, wrapper string")
    return parts


def extract_main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page.

    Defined cases: null html is an empty page, whose text is empty; pages without a host share the wrapper
    of ''; repeated rows give a row each; an empty table gives no row; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, w) for h, w in zip(texts_of(batch.column(2)), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    wrappers = written(host_wrappers(pages), "wrappers")
    schema = pages.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")
    return rows.join(wrappers, "host", "left").select("page_id", "url", "html", "wrapper").mapInArrow(run, schema)
