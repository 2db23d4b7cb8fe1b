"""HTML main text by consensus host paths.

1. Each page is cut into blocks of text in a tree of generalised paths: tags with their classes,
   digits replaced, of the containers and of all elements whose class, id or role names what is
   no article text ("suspects"). Elements that never hold article text by their tag (menus, footers,
   scripts, ...) are left out. A page scores its containers by their characters outside links and
   names the one that holds the article. It also judges its suspects: one goes unless it is
   where the page's text is, that is, it holds the article element, or most of the text of a page
   without such an element.
2. Spark counts both by host. Container paths with at least ``SHARE`` of a host's votes, so at
   most 1 / SHARE, are the host's consensus, most votes first. A suspect's path about which the host's pages
   disagree goes or stays for all of them, as most of them say.
3. Each page is cut again, and its text is that of the first consensus path it has, less the
   suspects that go; a page that has none of them keeps the container it named itself.

A word list alone never takes a text away: a suspect is told by a whole class name or by one made of
such words and of words for a place ("site-header", not "has-header"), ``article``, ``main`` and ``body`` never are
suspects, and pages vote on all of them.

Counting is by partial aggregation, so a host with a third of all pages is no hot spot, and
the join back reads both sides from files or the scan, so Spark can split a hot host. A host's
row has at most 1 / SHARE container paths and, for each of its pages' suspects on average, 1 / SHARE contested ones.

Cases: a null or empty html, or one without text, gives an empty text; unclosed and stray
tags, cut-off tags and references are read as browsers do, roughly; time and memory are linear in
the page, whatever the depth; a null url is a host of its own; a null page_id and repeated rows are
kept as they are; an empty table gives an empty result; other columns are passed over.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import common

SHARE = 0.05
#: A container that names the article needs this share of the page's characters ...
ENOUGH = 0.8
#: ... or this share where its tag or class says that it is the article. A suspect with this share may be it.
ENOUGH_MARKED = 0.5

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|title|textarea|svg|iframe)\b[^>]*+>.*?(?:</\1\s*+>|\Z)"
    r"|<(/?)([a-z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-z][^\s/>]*+)([^>]*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_CLASS = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_CUT = re.compile(r"[^a-z]+")

# Kinds of HTML elements, and the words that name what is not article text.
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br math mfrac mi mn mo mroot mrow msqrt msub msup mtext".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CONTAINER = frozenset("body main article section div td th table center dl".split())
_DROP_TAG = frozenset("nav footer aside button select menu head dialog".split())
_SUSPECT_TAG = frozenset("form".split())
_TITLE_TAG = "header"
_SUSPECT_WORD = frozenset(
    "ad ads adsbygoogle adv advert adverts advertisement advertising adbox adslot alert banner bio breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer "
    "gdpr header login masthead menu meta modal nav navbar navigation newsletter notice notification outbrain overlay paywall popular popup promo promoted recommended "
    "related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription taboola tags toolbar topbar widget widgets".split()
)
_TITLE_WORD = frozenset("header masthead banner".split())
_PLACE_WORD = frozenset(
    "site page main global primary secondary top bottom left right upper lower inner outer wrapper wrap container box area list bar block section panel links link unit slot group form "
    "js desktop mobile sticky fixed post posts entry article articles author reader readers user users thread trail button buttons item items brand content media text privacy google wp".split()
)
_SUSPECT_ROLE = frozenset("navigation banner contentinfo complementary search dialog alert menu".split())
_MARKED = frozenset("article main content entry post story body maincontent".split())
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = frozenset("body main article section div td th table ul ol dl blockquote".split())

Path = tuple[str, ...]


def _suspicious(name: str, in_article: bool) -> bool:
    """Whether a class or id is of words for what is no article text, and at most of places besides."""
    words = [w for w in _CUT.split(name) if w]
    found = {w for w in words if w in _SUSPECT_WORD}
    if in_article and found <= _TITLE_WORD:
        return False  # the head of an article is its title
    return bool(found) and all(w in found or w in _PLACE_WORD for w in words)


class Page:
    """Blocks of text in a tree of generalised paths. Node 0 is the page."""

    def __init__(self, page: str):
        self.parent, self.step, self.depth, self.suspect, self.inside = [-1], [""], [0], [False], [False]
        self.children: dict[tuple[int, str], int] = {}
        self.blocks: list[tuple[int, str, int]] = []  # node, text, characters in links
        self._cut(page)

    def _node(self, parent: int, step: str, suspect: bool) -> int:
        if (node := self.children.get((parent, step))) is None:
            node = self.children[parent, step] = len(self.parent)
            self.parent.append(parent)
            self.step.append(step)
            self.depth.append(self.depth[parent] + 1)
            self.suspect.append(suspect)
            self.inside.append(self.inside[parent] or step.split(".")[0] in ("article", "main"))
        return node

    def _element(self, tag: str, attributes: str, node: int) -> tuple[int, bool]:
        """(node of the element's text, whether it never is article text)."""
        in_article = self.inside[node]
        if tag in _DROP_TAG or (tag == _TITLE_TAG and not in_article):
            return node, True
        step, suspect = tag, tag in _SUSPECT_TAG
        if "=" in attributes:
            names = {m[1].lower(): m[2].strip("\"'").lower() for m in _CLASS.finditer(attributes)}
            classes, own = names.get("class", "").split(), names.get("id", "")
            step = ".".join([tag, *sorted({re.sub(r"\d+", "#", c) for c in classes})])
            if tag not in ("article", "main", "body", "html"):
                suspect = suspect or any(_suspicious(c, in_article) for c in classes)
                if names.get("role") in _SUSPECT_ROLE:
                    suspect, step = True, f"{step}@{names['role']}"
                if _suspicious(own, in_article):
                    suspect, step = True, f"{step}@{re.sub(r'[0-9]+', '#', own)}"
        if tag in _CONTAINER or suspect:
            node = self._node(node, step, suspect)
        return node, False

    def _cut(self, page: str) -> None:
        stack: list[tuple[str, int, bool, int]] = [("", 0, False, 0)]  # tag, node, left out, links around
        opened: Counter[str] = Counter()
        parts: list[str] = []
        links = here = at = 0

        def flush() -> None:
            nonlocal links
            if parts:
                text = " ".join(entities.unescape("".join(parts)).split())
                if text:
                    self.blocks.append((here, text, min(links, len(text))))
                parts.clear()
            links = 0

        def text(chunk: str) -> None:
            nonlocal links, here
            _, node, out, linked = stack[-1]
            if chunk and not out:
                if not parts:
                    here = node
                parts.append(chunk)
                if linked:
                    links += len(chunk)

        def close(k: int) -> None:
            opened.subtract(entry[0] for entry in stack[k:])
            del stack[k:]

        for m in _TOKEN.finditer(page):
            text(page[at : m.start()])
            at = m.end()
            tag = (m[3] or m[6] or "").lower()
            if not tag:
                continue
            if m[2] or m[5]:  # an end
                if tag not in _INLINE:
                    flush()
                if opened[tag] > 0:
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] == tag:
                            close(k)
                            break
                        if tag in _INLINE and stack[k][0] in _SCOPE:
                            break
                continue
            if tag in _INLINE:
                if tag == "br":
                    text(" ")
            else:
                flush()
                closing = _CLOSES.get(tag, ("p",))
                if any(opened[c] > 0 for c in closing):
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] in closing:
                            close(k)
                            break
                        if stack[k][0] in _SCOPE:
                            break
            attributes = m[4] or m[7] or ""
            if tag in _VOID or attributes.endswith("/"):
                continue
            _, node, out, linked = stack[-1]
            if not out:
                node, out = self._element(tag, attributes, node)
            stack.append((tag, node, out, linked + (tag == "a")))
            opened[tag] += 1
        text(page[at:])
        flush()

    def _sums(self, without: set[int] = frozenset()) -> tuple[list[int], list[int]]:
        """Characters and linked characters below each node, without those below some."""
        own, linked = [0] * len(self.parent), [0] * len(self.parent)
        for node, text, links in self.blocks:
            own[node] += len(text)
            linked[node] += links
        for node in range(len(self.parent) - 1, 0, -1):
            if node not in without:
                own[self.parent[node]] += own[node]
                linked[self.parent[node]] += linked[node]
        return own, linked

    def judge(self) -> set[int]:
        """The suspects that go, as far as this page alone can tell."""
        if not any(self.suspect):
            return set()
        own, linked = self._sums()
        size = len(self.parent)
        holds = [s.split(".")[0] in ("article", "main") for s in self.step]  # such an element is in the node
        for node in range(size - 1, 0, -1):
            holds[self.parent[node]] |= holds[node]
        free, marked = [True] * size, [False] * size  # in no suspect; and in a container that says it is the article
        for node in range(1, size):
            free[node] = free[self.parent[node]] and not self.suspect[node]
            marked[node] = free[node] and (marked[self.parent[node]] or _marked(self.step[node]))
        total = max(own[0] - linked[0], 1)
        elsewhere = holds[0] or sum(len(t) - k for node, t, k in self.blocks if marked[node]) >= 0.05 * total
        return {n for n in range(1, size) if self.suspect[n] and not holds[n] and (elsewhere or own[n] - linked[n] < ENOUGH_MARKED * total)}

    def gone(self, without: set[int]) -> list[bool]:
        """Whether each node is below (or is) one of some."""
        out = [False] * len(self.parent)
        for node in range(1, len(self.parent)):
            out[node] = out[self.parent[node]] or node in without
        return out

    def best(self, without: set[int]) -> int:
        """The container that holds the page's article; ``without`` are the suspects that go."""
        own, linked = self._sums(without)
        gone = self.gone(without)
        score = [a - b for a, b in zip(own, linked)]
        total = max(score[0], 1)
        there = [n for n in range(1, len(self.parent)) if not gone[n]]
        marked = [n for n in there if _marked(self.step[n]) and score[n] >= ENOUGH_MARKED * total]
        if marked:
            return min(marked, key=lambda n: (self.depth[n], -score[n], n))
        deep = max((n for n in there if score[n] >= ENOUGH * total), key=lambda n: (self.depth[n], score[n], -n), default=0)
        # Up again while what comes in is text rather than links: a heading belongs to the article.
        while self.depth[deep] > 1 and self.step[self.parent[deep]].split(".")[0] != "body":
            up = self.parent[deep]
            if linked[up] - linked[deep] > 0.3 * max(own[up] - own[deep], 1):
                break
            deep = up
        return deep

    def spell(self, node: int) -> Path:
        steps = []
        while node > 0:
            steps.append(self.step[node])
            node = self.parent[node]
        return tuple(reversed(steps))

    def find(self, path: Path) -> int | None:
        node = 0
        for step in path:
            if (node := self.children.get((node, step))) is None:
                return None
        return node

    def marks(self) -> dict[int, str]:
        """A digest of the path of each suspect."""
        if not any(self.suspect):
            return {}
        said = [b""]
        for node in range(1, len(self.parent)):
            said.append(hashlib.blake2b(said[self.parent[node]] + self.step[node].encode("utf-8", "surrogatepass"), digest_size=10).digest())
        return {n: said[n].hex() for n in range(1, len(self.parent)) if self.suspect[n]}


def _marked(step: str) -> bool:
    tag, *classes = step.partition("@")[0].split(".")
    return tag in ("article", "main") or any(w in _MARKED for c in classes for w in _CUT.split(c))


def extract(page: str | None, consensus: list[Path], go: set[str] = frozenset(), stay: set[str] = frozenset()) -> str:
    """Text under the first path of ``consensus`` that the page has, else under its own best.

    ``go`` and ``stay`` are the marks of suspects that the host has decided about.
    """
    cut = Page(page or "")
    judged = cut.judge()
    marks = cut.marks() if go or stay else {}
    voted = {n for n in judged if marks.get(n) not in stay} | {n for n, mark in marks.items() if mark in go}
    for without in [voted] if voted == judged else [voted, judged]:
        gone = cut.gone(without)
        for top in [*(n for path in consensus if (n := cut.find(path)) is not None), cut.best(without)]:
            below = [False] * len(gone)
            for node in range(len(gone)):
                below[node] = not gone[node] and (node == top or (node > 0 and below[cut.parent[node]]))
            if lines := [t for node, t, _ in cut.blocks if below[node]]:
                return "\n".join(lines)
    return ""


def host(url: Column) -> Column:
    return F.regexp_extract(F.lower(F.coalesce(url.cast("string"), F.lit(""))), "^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)


def _votes(page: str | None) -> list[tuple[str, str]]:
    """What a page says: (``in``, path of its article), and (``go`` or ``stay``, mark) of each suspect."""
    cut = Page(page or "")
    judged = cut.judge()
    return [("in", "\t".join(cut.spell(cut.best(judged)))), *(("go" if n in judged else "stay", mark) for n, mark in cut.marks().items())]


def host_paths(pages: DataFrame) -> DataFrame:
    """host, paths, go, stay: each host's consensus, most votes first, and marks of suspects that go or stay there.

    paths are steps joined by tabs. Only suspects on ``SHARE`` of the host's pages about which
    its pages disagree are given; about any other, each page's own judgement is the host's.
    """

    def vote(batches):
        for batch in batches:
            said = Counter((host, *v) for host, page in zip(batch.column(0).to_pylist(), batch.column(1)) for v in _votes(page.as_py()))
            columns = [list(c) for c in zip(*said)] or [[], [], []]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns), pa.array(list(said.values()), pa.int64())], names=["host", "kind", "path", "n"])

    votes = pages.select(host(F.col("url")).alias("host"), F.col("html").cast("string")).mapInArrow(vote, "host string, kind string, path string, n long")
    counts = common.stored(votes.groupBy("host", "kind", "path").agg(F.sum("n").alias("n")), "votes")
    totals = counts.filter("kind = 'in'").groupBy("host").agg(F.sum("n").alias("all"))
    said = counts.withColumn("of", F.when(F.col("kind") == "in", "in").otherwise("suspect")).groupBy("host", "of", "path").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("kind") == "go", F.col("n")).otherwise(0)).alias("gone")
    )
    often = said.join(totals, "host").filter(F.col("n") >= F.col("all") * SHARE)
    contested = (F.col("of") == "suspect") & (F.col("gone") > 0) & (F.col("gone") < F.col("n"))
    goes = 2 * F.col("gone") >= F.col("n")
    of = lambda which, value: F.collect_list(F.when(which, value))
    ranked = F.sort_array(of(F.col("of") == "in", F.struct((-F.col("n")).alias("n"), "path")))
    return often.groupBy("host").agg(
        F.transform(ranked, lambda r: r["path"]).alias("paths"), F.sort_array(of(contested & goes, F.col("path"))).alias("go"), F.sort_array(of(contested & ~goes, F.col("path"))).alias("stay")
    )


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def each(batches):
        for batch in batches:
            said = zip(*(batch.column(k).to_pylist() for k in (3, 4, 5)))
            texts = [extract(h.as_py(), [tuple(p.split("\t")) if p else () for p in paths or []], set(go or ()), set(stay or ())) for h, (paths, go, stay) in zip(batch.column(2), said)]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    consensus = common.stored(host_paths(pages), "host-paths")
    named = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), host(F.col("url")).alias("host"))
    met = named.join(consensus, "host", "left").select("page_id", "url", "html", "paths", "go", "stay")
    return met.mapInArrow(each, "page_id long, url string, text string, n_chars long")


def op5_host_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the main text of every page."""
    return main_text(common.table(spark, sf_dir, "pages"))
