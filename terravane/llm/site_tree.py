"""HTML extraction by site style trees.

The pages of one host are merged into a style tree: an element is known by the
path of tags and attributes that leads to it, siblings of one kind are one
element. Each element has two importances between 0 and 1, entropies to the
base of the number of pages m that have it:

* presentation: the entropy of the ways in which its children are laid out,
* content: one less the entropy of its words over the pages, each word weighed
  by how often it occurs. What every page says is worth nothing.

A branch, an element with all below it, is noise if neither importance reaches
``THRESHOLD`` anywhere in it; its texts are removed from every page. Elements
that the markup itself names (navigation, adverts, forms and the like) are of
no importance whatever their entropy: menus and adverts that differ from page
to page cannot be told from articles by entropy. Likewise the article, or what
comes nearest to it, is a page's root: where a page has one, only what is below
it is text, and branches below are judged against it. Where the root itself is
of low importance, as for copies of one page, the entropies say nothing and the
root's branches stay.

Pages are parsed twice, once for the tree and once for the text; in between only
counts of words and layouts by element are shuffled, summed before and after.
The removed branches of a host are broadcast if they are few, else joined by
host; no page or host is ever gathered in one place.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.llm.common import Scratch, tidied
from terravane.llm.url_filter import host

THRESHOLD = 0.25
#: Elements that fewer pages have are not judged.
MIN_PAGES = 3
#: Elements further down count as their ancestor at this depth.
MAX_DEPTH = 48
#: Most removed branches that are broadcast (16 bytes each at most).
BROADCAST_BRANCHES = 200_000

# Fixed names of the markup language.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style textarea title xmp iframe noembed noframes".split())
_NO_TEXT = set("head script style noscript template iframe svg math canvas object select datalist textarea button title audio video map".split())
_NOISE = set("nav footer aside form dialog menu header".split())
_NOISE_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar note".split())
_BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend "
    "li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
_CLOSES_P = _BLOCK - set("html body option optgroup td th tr tbody thead tfoot caption legend".split())
_P_FENCES = set("button td th caption table object".split())
_TABLE = set("table caption thead tbody tfoot tr td th".split())
#: What a start tag ends, and what that does not reach beyond.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"})}
_ENDS |= {"td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}), "tr": ({"tr", "td", "th"}, {"table"})}
_ENDS |= {t: (_TABLE - {"table"}, {"table"}) for t in ("thead", "tbody", "tfoot")}
#: Words of class and id by which pages name what is not their article.
_NOISE_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion banner banners cookie cookies consent gdpr notice notices notification "
    "popup modal newsletter subscribe subscription signup login nav navbar navigation menu menus menubar breadcrumb breadcrumbs sidebar sidebars widget widgets footer masthead topbar toolbar "
    "share sharing social related recommended recommendations comment comments commentlist respond replies disqus pagination pager skip".split()
)
#: Class names and ids of what holds the article in pages without such an element.
_CONTENT = re.compile(r"(?:main|article|post|entry|story|page)?[-_]?(?:content|body|text|main|article|story)", re.I)
#: What a page's text is taken from, the first kind that it has.
_ARTICLE, _MAIN, _NAMED, _DOCUMENT = range(4)

_TAG = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?>[^>\"'=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[=\"'])*+)(?P<end>>|\Z)|<[!?/](?P<bogus>[^>]*+)(?:>|\Z)", re.S
)
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_TELLING = re.compile(r"class|id|role|hidden|style|itemprop", re.I)
_HIDDEN = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_DIGITS = re.compile(r"\d+")
_hashes: dict[tuple[int, str], int] = {}


def _child_hash(parent: int, signature: str) -> int:
    key = (parent, signature)
    found = _hashes.get(key)
    if found is None:
        if len(_hashes) > 100_000:
            _hashes.clear()
        found = _hashes[key] = int.from_bytes(hashlib.blake2b(f"{parent}/{signature}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)
    return found


def _described(name: str, attrs: str) -> tuple[str, bool, int]:
    """Signature of an element (digits count as one), whether its markup names it as noise, and what kind of root it is."""
    if not attrs or not _TELLING.search(attrs):
        return name, name in _NOISE, _ARTICLE if name == "article" else _MAIN if name == "main" else _DOCUMENT
    given: dict[str, str] = {}
    for m in _ATTR.finditer(attrs):
        given.setdefault(m[1].lower(), entities.unescape(m[2] or m[3] or m[4] or ""))
    classes, ident, role = given.get("class", "").split(), given.get("id", "").strip(), given.get("role", "").lower()
    signature = name + "".join(f".{c}" for c in sorted({_DIGITS.sub("0", c) for c in classes})) + (f"#{_DIGITS.sub('0', ident)}" if ident else "") + (f"@{role}" if role else "")
    names = [*classes, ident]
    noise = name in _NOISE or role in _NOISE_ROLES or "hidden" in given or given.get("aria-hidden", "").lower() == "true" or bool(_HIDDEN.search(given.get("style", "")))
    noise = noise or any(w.lower() in _NOISE_WORDS for n in names for w in _WORDS.findall(n))
    if name == "article" or role == "article" or "articlebody" in given.get("itemprop", "").lower():
        return signature, noise, _ARTICLE
    if name == "main" or role == "main":
        return signature, noise, _MAIN
    return signature, noise, _NAMED if name not in ("html", "body") and any(_CONTENT.fullmatch(n) for n in names) else _DOCUMENT


class Page:
    """A page's elements in document order, and its texts with the element that each is in.

    ``tags``, ``parents``, ``signatures``, ``noise`` and ``roots`` go by
    element; element 0 is the document. ``texts`` holds (element, text) and
    (element, None) where a block begins or ends. Whatever the markup, each
    page has such a tree: end tags that nothing opened are ignored, elements
    that nothing closed end with the page, a tag that the page breaks off in is
    dropped.
    """

    def __init__(self, html: str) -> None:
        self.tags, self.parents, self.signatures, self._own, self._kinds = [""], [-1], [""], [False], [_DOCUMENT]
        self.texts: list[tuple[int, str | None]] = []
        self._open = [0]
        at, size = 0, len(html)
        while at < size:
            m = _TAG.search(html, at)
            if m is None:
                self._text(html[at:])
                break
            if m.start() > at:
                self._text(html[at : m.start()])
            at = m.end()
            name = m["name"]
            if name is None or not m["end"]:
                continue
            name = name.lower()
            if m["close"]:
                self._close(name, _P_FENCES if name == "p" else _BLOCK if name not in _BLOCK else frozenset() if name in _TABLE else _P_FENCES)
            else:
                self._start(name, m["attrs"])
                if name in _RAW:
                    end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(html, at)
                    at = end.start() if end else size
        self._settle()

    def _text(self, text: str) -> None:
        self.texts.append((self._open[-1], entities.unescape(text)))

    def _start(self, name: str, attrs: str) -> None:
        if name in ("html", "body") and name in (self.tags[i] for i in self._open):
            return
        if name in _CLOSES_P:
            self._close("p", _P_FENCES, opening=True)
        if name in _ENDS:
            self._end_siblings(*_ENDS[name])
        if name == "body":
            self._close("head", opening=True)
        i, parent = len(self.tags), self._open[-1]
        signature, noise, kind = _described(name, attrs)
        self.tags.append(name)
        self.parents.append(parent)
        self.signatures.append(signature)
        self._own.append(noise)
        self._kinds.append(kind)
        if name in _BLOCK:
            self.texts.append((parent, None))
        elif name == "br":
            self.texts.append((parent, "\n"))
        if name not in _VOID:
            self._open.append(i)

    def _close(self, name: str, fences: frozenset[str] | set[str] = frozenset(), opening: bool = False) -> None:
        """End the innermost open element of that name and all in it, unless a fence stands between."""
        for k in range(len(self._open) - 1, 0, -1):
            tag = self.tags[self._open[k]]
            if tag == name:
                self._end(k)
                return
            if tag in fences:
                break
        if name == "p" and not opening:
            self.texts.append((self._open[-1], None))

    def _end_siblings(self, ends: set[str], fences: set[str]) -> None:
        last = 0
        for k in range(len(self._open) - 1, 0, -1):
            tag = self.tags[self._open[k]]
            if tag in fences:
                break
            if tag in ends:
                last = k
        if last:
            self._end(last)

    def _end(self, k: int) -> None:
        if any(self.tags[i] in _BLOCK for i in self._open[k:]):
            self.texts.append((self._open[k - 1], None))
        del self._open[k:]

    def _settle(self) -> None:
        """``root`` and ``noise`` of each element: whether it is in the page's root, and in what its markup names as noise."""
        n, tags, up, kinds = len(self.tags), self.tags, self.parents, self._kinds
        holds = [False] * n
        for i in range(n - 1, 0, -1):
            holds[up[i]] |= holds[i] or kinds[i] <= _MAIN and not self._own[i]
        own = [tags[i] in _NO_TEXT or self._own[i] and not holds[i] and tags[i] not in ("html", "body") for i in range(n)]
        self.noise = self._below(own)
        sizes = [0] * n
        for i, text in self.texts:
            sizes[i] += len(text.strip()) if text and not self.noise[i] else 0
        for i in range(n - 1, 0, -1):
            sizes[up[i]] += sizes[i]
        kind = min((k for i, k in enumerate(kinds) if k < _NAMED and not self.noise[i]), default=_NAMED)
        roots = [kinds[i] == kind and not self.noise[i] for i in range(n)]
        if kind == _NAMED:
            # a name is trusted only if what it names holds most of the page's text
            roots = [r and 2 * sizes[i] > sizes[0] for i, r in enumerate(roots)]
        if not any(roots):
            roots = [i == 0 for i in range(n)]
        self.root = self._below(roots)
        if not roots[0]:
            # a header in the article holds its headline
            headline = [tags[i] == "header" and self.signatures[i] == "header" and self.root[i] for i in range(n)]
            self.noise = self._below([o and not h for o, h in zip(own, headline, strict=True)])

    def _below(self, marked: list[bool]) -> list[bool]:
        out = list(marked)
        for i in range(1, len(out)):
            out[i] |= out[self.parents[i]]
        return out

    def keys(self, site: str) -> list[int]:
        """The style tree's key of each element; an inline element has that of the block it is in."""
        out, depths = [_child_hash(0, site)], [0]
        for i in range(1, len(self.tags)):
            up = self.parents[i]
            deeper = self.tags[i] in _BLOCK and depths[up] < MAX_DEPTH
            out.append(_child_hash(out[up], self.signatures[i]) if deeper else out[up])
            depths.append(depths[up] + deeper)
        return out

    def layout(self, keys: list[int]) -> dict[int, tuple[list[int], list[str], list[str]]]:
        """For each key within the root: the keys from the root's to itself, the signatures of the children, the texts."""
        out: dict[int, tuple[list[int], list[str], list[str]]] = {}
        for i, key in enumerate(keys):
            if not self.root[i] or self.noise[i]:
                continue
            up = self.parents[i]
            inside = up >= 0 and self.root[up]
            if key not in out:
                out[key] = ([*out[keys[up]][0], key] if inside else [key], [], [])
            if inside:
                out[keys[up]][1].append(self.signatures[i])
        for i, text in self.texts:
            if text and self.root[i] and not self.noise[i]:
                out[keys[i]][2].append(text)
        return out

    def blocks(self, keys: list[int], removed: set[int]) -> list[str]:
        """The root's blocks of text in page order, without noise and removed branches."""
        gone = list(self.noise)
        for i in range(1, len(gone)):
            gone[i] |= gone[self.parents[i]] or self.root[self.parents[i]] and keys[i] in removed
        out, block = [], []
        for i, text in [*self.texts, (0, None)]:
            if text is None:
                words = "".join(block).split()
                if words:
                    out.append(" ".join(words))
                block = []
            elif self.root[i] and not gone[i]:
                block.append(text)
        return out


#: What a row of counts is about; the numbers only tell them apart.
_WORD, _LAYOUT, _TOLD, _ABOVE, _TOP, _SITE = range(6)


def _measure(batches):
    """For each page and element in its root: its words with their numbers, its layout, the elements above it, its site."""
    for b in batches:
        nodes, kinds, values, counts = [], [], [], []
        for site, of, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            page = Page(html)
            for key, (chain, children, texts) in page.layout(page.keys(site)).items():
                found = Counter(" ".join(texts).lower().split())
                other = [(_LAYOUT, zlib.crc32(" ".join(children).encode("utf-8", "surrogatepass"))), (_TOP, chain[0]), (_SITE, of), *((_ABOVE, c) for c in chain)]
                other += [(_TOLD, 0)] if found else []
                n = len(found) + len(other)
                nodes += [key] * n
                kinds += [_WORD] * len(found)
                kinds += [k for k, _ in other]
                values += [zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in found]
                values += [v for _, v in other]
                counts += found.values()
                counts += [1] * len(other)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(kinds, pa.int8()), pa.array(values, pa.int64()), pa.array(counts, pa.int32())], names=["node", "kind", "value", "tf"])


def _pages(pages: DataFrame) -> DataFrame:
    site = host(F.col("url"))
    return pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), site.alias("site"), F.xxhash64(site).alias("of"))


def importances(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """node, of (its site's hash), top (its root's key), above (keys from there to itself), n_words and importance of each element of the style trees.

    Words and layouts are counted by 32-bit hashes: they are statistics. Keys
    of elements have 64 bits and are used within one site only.
    """
    seen = _pages(pages).where("site <> ''").select("site", "of", "html").mapInArrow(tidied(_measure), "node long, kind byte, value long, tf int")
    each = seen.groupBy("node", "kind", "value").agg(F.sum("tf").alias("t"), F.sum(F.col("tf") * F.log("tf")).alias("l"))
    named = F.when(F.col("kind") >= _ABOVE, F.col("value")).otherwise(0)
    each = each.groupBy("node", "kind", named.alias("value")).agg(F.sum("t").alias("t"), F.sum(F.col("t") * F.log("t")).alias("tlt"), F.sum("l").alias("l"))
    each = scratch.keep(each, "counts")

    def of(kind: int, c: str):
        return F.max(F.when(F.col("kind") == kind, F.col(c)))

    nodes = each.groupBy("node").agg(
        of(_LAYOUT, "t").alias("m"),
        of(_LAYOUT, "tlt").alias("layouts"),
        F.coalesce(of(_TOLD, "t"), F.lit(0)).alias("told"),
        F.coalesce(of(_WORD, "t"), F.lit(0)).alias("n_words"),
        (of(_WORD, "tlt") - of(_WORD, "l")).alias("spread"),
        of(_TOP, "value").alias("top"),
        of(_SITE, "value").alias("of"),
        F.collect_set(F.when(F.col("kind") == _ABOVE, F.col("value"))).alias("above"),
    )
    presentation = 1 - F.col("layouts") / (F.col("m") * F.log("m"))
    content = F.when(F.col("told") >= 2, 1 - F.col("spread") / (F.col("n_words") * F.log("told"))).when(F.col("told") == 1, 1.0).otherwise(0.0)
    importance = F.when(F.col("m") < MIN_PAGES, 1.0).otherwise(F.greatest(presentation, content))
    return scratch.keep(nodes.select("node", "of", "top", "above", "n_words", importance.alias("importance")), "tree")


def noise_branches(tree: DataFrame) -> DataFrame:
    """of and node of the branches of low importance: all in them, but neither a root nor most of one's words."""
    branch = tree.select("of", "top", F.explode("above").alias("node"), "n_words", "importance")
    branch = branch.groupBy("of", "top", "node").agg(F.sum("n_words").alias("n_words"), F.max("importance").alias("importance"))
    top = branch.where("node = top").select(F.col("top").alias("root"), F.col("n_words").alias("all_words"), F.col("importance").alias("best"))
    low = branch.where((F.col("importance") < THRESHOLD) & (F.col("node") != F.col("top"))).join(top, F.col("top") == F.col("root"))
    return low.where((F.col("best") >= THRESHOLD) & (F.col("n_words") * 2 < F.col("all_words"))).select("of", "node")


def _extract(batches):
    for b in batches:
        texts = []
        for site, html, removed in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
            page = Page(html)
            texts.append("\n\n".join(page.blocks(page.keys(site), set(removed or ()))))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row of ``pages`` (page_id, url, html).

    ``text`` is the page's main text: white space (as Unicode has it) within a
    block is one space, blocks are joined by two line feeds, line breaks are
    white space, table cells and list items are blocks of their own. A null or
    empty page, and one without text, has the text "". Pages whose url is null
    or has no host are taken by their markup alone, as are pages of hosts with
    fewer than ``MIN_PAGES``. Null ids, repeated rows and copies of a page come
    back as they are; very long pages are parsed whole, elements below
    ``MAX_DEPTH`` blocks count as their ancestor there; other columns are
    ignored, whatever their names; an empty table gives an empty result.
    """
    scratch = Scratch(pages.sparkSession)
    noise = noise_branches(importances(pages, scratch)).groupBy(F.col("of").alias("owner")).agg(F.collect_set("node").alias("removed"))
    noise = scratch.keep(noise, "noise")
    size = noise.agg(F.coalesce(F.sum(F.size("removed")), F.lit(0))).first()[0]
    few = F.broadcast(noise) if size <= BROADCAST_BRANCHES else noise
    laid = _pages(pages).join(few, F.col("of") == F.col("owner"), "left").select("page_id", "url", "site", "html", "removed")
    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url {pages.schema['url'].dataType.simpleString()}, text string, n_chars long"
    return laid.mapInArrow(tidied(_extract), schema)
