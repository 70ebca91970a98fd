"""HTML extraction by consensus host paths.

1. Every page is read as a tree of containers.  A container's generalised path
   is its chain of tags with their class names, digits dropped, ids ignored
   (``body>div.post>article``).  A path scores the text of its blocks, less its
   link text, by the containers that hold them directly or through headings,
   lists, quotes and tables; menus, forms, adverts and the like count nothing.
   A class or id is noise by its whole name (``sidebar``, ``ad-box``; not
   ``with-sidebar``).  Where no article or main outside noise has paragraphs, the
   largest one inside and every container with most of the page's paragraph
   text, comments aside, are no noise; comments, menus and what is hidden stay noise.  A page that yields
   nothing is read again with tags and hiding as its only noise.
2. Spark adds up the scores by host and path and each host elects its best path
   (the page's own best path stands in where a host has none).
   The path then grows by its ancestors (an article or main is whole and does
   not): other containers inside count as text, small ones too, unless
   mostly links or the same on all of the host's pages, of which at least three
   must differ otherwise; the innermost ancestor with such a container is the last.
3. Every page is read again: the blocks inside the elected path and the
   containers that it grew by are the text.  A page without it uses its own
   best path, grown alike.

Blocks are separated by block elements; inside a block white space becomes one
space, and blank blocks vanish.  Character references are decoded.  Hosts are
lower-cased, without port; a null or odd url has the empty host.  A null or
empty page has the empty text; repeated rows are extracted each and are one
page where containers are compared.  Of paths with equal votes the smaller is
elected.  A path has 256 steps at most: what is nested deeper belongs to the
last, and no text is lost.  Reading takes time in proportion to a page's length.
An empty table gives an empty result; extra columns pass through, but a column
``text`` is replaced.
"""

from __future__ import annotations

import hashlib
import html
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField

from cohera.llm.common import map_texts, materialise

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
_ATTR = re.compile(r"\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WHITE = re.compile(r"\s+")

#: different pages on which a container's text must be the same to count as repeated
SAME = 3
#: steps of a container path; what is nested deeper belongs to the last of them
DEPTH = 256

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title".split())
SKIP = frozenset("nav header footer aside form button dialog menu head svg math canvas object select".split()) | RAW
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
                   "strike strong sub sup time tt u var wbr img".split())
#: blocks that belong to the container around them
MEMBER = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr td th figure figcaption br hr "
                   "caption address center".split()) | INLINE
CLOSES_P = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table div section article main nav header footer aside form "
                     "figure hr address fieldset".split())
#: class and id words of what is not the article
_NOISE = frozenset("ad ads advert adverts advertisement advertising adslot adbox banner promo promoted promotion sponsor sponsored "
                   "nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar sidebars rail footer masthead topbar "
                   "cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe signup login "
                   "share sharing social related recommended recommendations comment comments commentlist respond reply replies "
                   "disqus pagination pager widget skip search toolbar copyright disclaimer".split())
#: parts of a name that do not tell what it holds
_HELPER = frozenset("area bar block box button buttons container bottom group holder inner item items left link links list outer panel right "
                    "section slot text title top unit wrap wrapper post posts entry article site".split())
_COMMENTS = frozenset("comment comments commentlist respond reply replies disqus".split())
_NOISE_ROLE = frozenset("navigation banner contentinfo complementary search dialog alert menu form".split())


def _attributes(raw: str) -> dict:
    return {m.group(1).lower(): (m.group(2) or m.group(3) or m.group(4) or "") for m in _ATTR.finditer(raw)} if raw else {}


def _names(at: dict) -> list[list[str]]:
    """The words of each class and id name."""
    return [[w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if w]
            for name in (at.get("class", "") + " " + at.get("id", "")).split()]


def _noisy(tag: str, at: dict, by_name: bool = True) -> int:
    """0: no noise; 1: noise unless it holds the page's text; 2: noise."""
    hidden = at and ("hidden" in at or at.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", at.get("style", "")))
    if tag in ("html", "body", "article", "main"):
        return 0
    if hidden:
        return 2
    if tag in SKIP and (by_name or tag != "form"):
        return 1 if tag == "form" else 2
    if not at or not by_name:
        return 0
    names = [set(n) for n in _names(at)]
    names = [n for n in names if not _NOISE.isdisjoint(n) and n <= _NOISE | _HELPER]
    if names:
        return 2 if any(not _COMMENTS.isdisjoint(n) for n in names) else 1
    return int(at.get("role", "").lower() in _NOISE_ROLE)


def _step(tag: str, at: dict) -> str:
    names = sorted({w for c in at.get("class", "").split() if (w := re.sub(r"[0-9]+", "", c).lower())})
    return ".".join([tag, *names])


def blocks(page: str | None) -> list[tuple[str, str, int]]:
    """``(container path, block text, characters inside links)`` in page order."""
    if not page:
        return []
    out, held = _read(page, frozenset(), True)
    total, free = held.pop(0), held.pop(-1)
    keep = {k for k, (x, whole) in held.items() if not whole and 2 * x > total}
    inside = [(-x, k) for k, (x, whole) in held.items() if whole and x]
    if inside:
        keep.add(min(inside)[1])
    if keep and not free:
        out, _ = _read(page, frozenset(keep), True)
    return out or _read(page, frozenset(), False)[0]


def _read(page: str, keep: frozenset, by_name: bool) -> tuple[list[tuple[str, str, int]], dict]:
    """The blocks, and the characters in paragraphs: key 0 of the page without comments, -1 of
    its articles and mains outside noise, n of its n-th element that is noise or
    (second value true) an article or main in noise.  Those in ``keep`` end noise."""
    out: list[tuple[str, str, int]] = []
    kinds: dict = {}  # of each counted element: article or main in noise
    # noise around a place is a node: its parent, element, whether comments, menus or hidden, own paragraph characters
    up, element, hard, told_in = [0], [0], [False], [0]
    total, free = 0, 0
    stack: list[tuple] = []  # tag, nearest place that is no inline element, then what ``here`` holds
    opened: dict = {}  # places of each tag on the stack
    # path, its steps, whether it ends in an article or main, noise node, paragraph 1 and article 2
    top = ("", 0, False, 0, 0)
    path, steps, whole, noise, state = top
    buf, linked, links, count = [], 0, 0, 0

    def flush():
        nonlocal linked
        if buf:
            t = _WHITE.sub(" ", html.unescape("".join(buf))).strip()
            if t:
                out.append((path, t, min(linked, len(t))))
            buf.clear()
        linked = 0

    def told(n):
        nonlocal total, free
        if not hard[noise]:
            total += n
            told_in[noise] += n
        if not noise and state & 2:
            free += n

    def pop():
        nonlocal links
        tag = stack.pop()[0]
        opened[tag].pop()
        if tag == "a":
            links = max(0, links - 1)
        return tag

    def here():
        return stack[-1][2:] if stack else top

    at = 0
    n = len(page)
    while at < n:
        lt = page.find("<", at)
        m = _TAG.match(page, lt) if lt >= 0 else None
        if lt < 0 or not m:
            end = n if lt < 0 else lt + 1  # a lone < is text
            if not noise:
                buf.append(page[at:end] if lt < 0 else page[at:lt] + "&lt;")
            if state & 1:
                told(len(page[at:end].strip()))
            at = end
            continue
        if lt > at and not noise:
            buf.append(page[at:lt])
            if links:
                linked += lt - at
        if lt > at and state & 1:
            told(len(page[at:lt].strip()))
        at = m.end()
        if not m.group(2):
            continue
        tag = m.group(2).lower()
        if m.group(1):  # an end tag
            if not opened.get(tag):
                if tag in ("br", "p") and not noise:
                    flush()
                continue
            if tag in INLINE:  # ends the element only if no block was opened in it
                if opened[tag][-1] <= stack[-1][1]:
                    continue
            elif not noise:
                flush()
            while pop() != tag:
                pass
            path, steps, whole, noise, state = here()
            continue
        if tag in VOID:
            if tag in ("br", "img", "wbr"):
                if not noise and tag == "br":
                    buf.append(" ")
            elif not noise:
                flush()
            continue
        if tag in CLOSES_P and stack and stack[-1][1] >= 0 and stack[stack[-1][1]][0] == "p":  # only inline elements since
            if not noise:
                flush()
            while pop() != "p":
                pass
            path, steps, whole, noise, state = here()
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            if tag not in INLINE and not noise:
                flush()
            at = end.end() if end else n
            continue
        attributes = _attributes(m.group(3))
        if tag not in INLINE and not noise:
            flush()
        if tag == "a":
            links += 1
        now, kind = noise, _noisy(tag, attributes, by_name)
        if kind or (noise and tag in ("article", "main")):
            count += 1
            if kind != 2 and count in keep:
                now = noise if kind else 0
            else:
                now = len(up)
                up.append(noise), element.append(count), hard.append(hard[noise] or kind == 2), told_in.append(0)
                if kind != 2:
                    kinds[count] = not kind
        if tag not in MEMBER and not whole:  # an article or main stays whole
            if steps < DEPTH:
                path = f"{path}>{_step(tag, attributes)}" if path else _step(tag, attributes)
                steps += 1
            whole = tag in ("article", "main")
        noise = now
        state = state | (tag == "p") | 2 * (tag in ("article", "main"))
        if not m.group(3).rstrip().endswith("/"):
            opened.setdefault(tag, []).append(len(stack))
            block = len(stack) if tag not in INLINE else stack[-1][1] if stack else -1
            stack.append((tag, block, path, steps, whole, noise, state))
        else:
            links -= tag == "a"
            path, steps, whole, noise, state = here()
    if not noise:
        flush()
    held: dict = {0: total, -1: free}
    for k in range(len(up) - 1, 0, -1):  # inner nodes come after outer ones
        told_in[up[k]] += told_in[k]
        if element[k] in kinds:
            held[element[k]] = told_in[k], kinds[element[k]]
    return out, held


def path_scores(page: list[tuple[str, str, int]]) -> dict[str, float]:
    """Scores of the container paths: own text without links, and of every
    container inside, nearer ones more (a wrapper scores less than what it wraps
    if that holds nearly all)."""
    own: dict[str, float] = {}
    for path, text, links in page:
        own[path] = own.get(path, 0.0) + max(0, len(text) - 2 * links)
    total: dict[str, float] = {}
    for path, x in own.items():
        share, end = 1.0, len(path)
        while end >= 0:
            p = path[:end]
            total[p] = total.get(p, 0.0) + x * share
            share, end = share * 0.9, path.rfind(">", 0, end)
    return total


def _best(scores: dict[str, float]) -> str | None:
    return min(scores, key=lambda p: (-scores[p], p)) if scores else None


def _owned(page: list[tuple[str, str, int]]) -> dict[str, tuple[int, int]]:
    """Characters, and those inside links, that each container holds itself."""
    own: dict[str, tuple[int, int]] = {}
    for path, text, links in page:
        n, k = own.get(path, (0, 0))
        own[path] = n + len(text), k + links
    return own


def _whole(path: str) -> bool:
    return path.rpartition(">")[2].partition(".")[0] in ("article", "main")


def _common(a: str, b: str) -> int:
    """Leading steps that two paths share."""
    n = 0
    for x, y in zip(a.split(">"), b.split(">")):
        if x != y:
            break
        n += 1
    return n


def main_text(page: list[tuple[str, str, int]], elected: str | None, level: int | None = None, same: list[str] | None = None) -> str:
    """The blocks inside the elected path, or inside the page's best one, and of
    the containers that share ``level`` steps with it, without those in ``same``."""
    def inside(path):
        return [p == path or p.startswith(path + ">") for p, *_ in page]

    found = inside(elected) if elected else []
    own = _owned(page)
    if not any(found):
        elected = _best(path_scores(page))
        if elected is None:
            return ""
        found, same = inside(elected), []
        level = max((_common(p, elected) for p, (n, k) in own.items() if 2 * k > n and not (p == elected or p.startswith(elected + ">"))), default=0)
    if _whole(elected):
        return "\n".join(t for (_, t, _), ok in zip(page, found) if ok)
    same = frozenset(same or ())

    joins = {path for path, (n, k) in own.items()
             if 2 * k <= n and path not in same and _common(path, elected) >= max(level or 0, 1)}
    return "\n".join(t for (p, t, _), ok in zip(page, found) if ok or p in joins)


def _host(url):
    host = F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return host


def elected_paths(pages: DataFrame) -> DataFrame:
    """``host, path, level, same``: the path that the host's pages elect, how many
    of its steps the containers share that it grows by, and those among them
    that are the same on all pages."""
    def f(batches):
        for pdf in batches:
            seen: dict = {}
            for host, page in zip(pdf["host"], pdf["html"]):
                name = int.from_bytes(hashlib.md5((page or "").encode("utf-8", "surrogatepass")).digest()[:8], "big", signed=True)
                page = blocks(page)
                scores, own = path_scores(page), _owned(page)
                top = max(scores.values(), default=0.0)
                texts: dict[str, list[str]] = {}
                for path, text, _ in page:
                    texts.setdefault(path, []).append(text)
                for path in {*scores, *own}:
                    x = seen.setdefault((host, path), [0.0, 0, 0, None, None, set()])
                    x[0] += scores.get(path, 0.0) / top if top > 0 else 0.0
                    if path in texts:
                        h = hashlib.md5("\n".join(texts[path]).encode("utf-8", "surrogatepass")).hexdigest()
                        x[1], x[2] = x[1] + own[path][0], x[2] + own[path][1]
                        x[3], x[4] = min(x[3] or h, h), max(x[4] or h, h)
                        if len(x[5]) < SAME:
                            x[5].add(name)
            # a row for each of up to SAME different pages: enough to know whether there are as many
            rows = [(host, path, *(x[:5] if i == 0 else (0.0, 0, 0, x[3], x[4])), name)
                    for (host, path), x in seen.items() for i, name in enumerate(sorted(x[5]) or [None])]
            if rows:
                df = pd.DataFrame([r[:-1] for r in rows], columns=["host", "path", "votes", "n", "k", "lo", "hi"])
                yield df.assign(page=pd.array([r[-1] for r in rows], dtype="Int64"))

    votes = pages.select(_host(F.col("url")).alias("host"), "html").mapInPandas(
        f, "host string, path string, votes double, n long, k long, lo string, hi string, page long")
    votes = votes.groupBy("host", "path").agg(*[F.sum(c).alias(c) for c in ("votes", "n", "k")], F.min("lo").alias("lo"), F.max("hi").alias("hi"),
                                              F.count_distinct("page").alias("pages"))
    votes = materialise(votes, "html-votes")
    best = votes.where("votes > 0").groupBy("host").agg(F.min(F.struct((-F.round("votes", 6)).alias("v"), "path")).alias("best"))
    best = best.select("host", F.col("best.path").alias("best"))
    # containers outside the elected path that are no text: they end its growth
    other = votes.where("pages > 0").withColumn("same", (F.col("lo") == F.col("hi")) & (F.col("pages") >= SAME))
    other = other.where(F.col("same") | (2 * F.col("k") > F.col("n"))).join(best, "host")
    other = other.where((F.col("path") != F.col("best")) & ~F.col("path").startswith(F.concat("best", F.lit(">"))))
    x, y = F.split("path", ">"), F.split("best", ">")
    steps = F.sequence(F.lit(1), F.least(F.size(x), F.size(y)))
    other = other.withColumn("level", F.size(F.filter(steps, lambda i: F.slice(x, 1, i) == F.slice(y, 1, i))))
    ends = other.groupBy("host").agg(F.max("level").alias("level"))
    same = other.where("same").drop("level").withColumn("at", F.lit(0)).join(ends, "host").where(
        F.size(F.filter(steps, lambda i: F.slice(x, 1, i) == F.slice(y, 1, i))) >= F.col("level"))
    same = same.groupBy("host").agg(F.sort_array(F.collect_set("path")).alias("same"))
    out = best.join(ends, "host", "left").join(same, "host", "left")
    return out.select("host", F.col("best").alias("path"), F.coalesce("level", F.lit(0)).alias("level"), "same")


def extract(pages: DataFrame, spread: int = 64) -> DataFrame:
    """``pages`` with ``text``, the main text (a column of that name is
    replaced).  A host's pages are dealt to ``spread`` keys, with a copy of its
    path for each, so that no task holds a large host."""
    paths = materialise(elected_paths(pages), "html-paths")
    paths = paths.select(F.col("host").alias("__host"), F.struct("path", "level", "same").alias("__path"),
                         F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("__salt"))
    keep = [c for c in pages.columns if c != "text"]
    salt = F.pmod(F.xxhash64("html"), F.lit(spread)).cast("int")
    rows = pages.select(*keep, _host(F.col("url")).alias("__host"), salt.alias("__salt"))
    rows = rows.join(paths, ["__host", "__salt"], "left").drop("__host", "__salt")

    def make(pages_and_paths):
        return {"text": [main_text(blocks(x["html"]), *((x["by"] or {}).get(k) for k in ("path", "level", "same"))) for x in pages_and_paths]}

    rows = rows.withColumn("__both", F.struct("html", F.col("__path").alias("by")))
    return map_texts(rows, keep, [StructField("text", StringType())], make, "__both")
