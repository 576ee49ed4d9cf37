"""HTML extraction by equivalence-class template deduction.

Every page is read as tags, each named by its path from the root (containers with their number among like siblings).
Paths that occur equally often on the same pages of a host share an occurrence vector and form an equivalence class;
vectors are compared by sums of salted page hashes, so counting is a grouped aggregation, repeated rows do not cancel
out, and a hot host is no special case. Valid classes (enough pages, enough members) nest by their paths into the
host's template.

The template decides what is kept: from the root, the main slot goes down to that container which still holds nearly
all text that varies from page to page, is not linked and stands in no place of menus, adverts and the like (where a
template has articles, down to them). Inside the main slot a member of a valid class whose text is the same on at least
half of the host's pages is fixed text of the template and is left out, unless that would be most of the slot (a host
of copies). All other slots of the main one are the result. Tags and names of places (`DROPPED`, `NAMES`) are a prior.

Defined results: null or empty html gives an empty text; a page without the main slot of its host is read by its own
tags; a null url is a host of its own; repeated rows keep their rows; other columns of the input are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, read

#: Characters of the hosts' kept paths up to which they are broadcast; beyond, pages are joined by host.
BROADCAST_CHARS = 32 << 20
#: Elements without end tag, elements whose content is no markup, and those that break lines.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul option".split())
DROPPED = frozenset("nav footer aside form script style noscript template iframe head menu dialog button select textarea svg canvas object title fieldset xmp noembed math audio video".split())
#: Containers: their number among like siblings is part of the path, and the main slot is one of them.
CONTAINERS = frozenset("article aside body center details div figure footer form header html main nav section table td th".split())
NAMES = "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar menu menubar nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments commentlist disqus respond replies notice notices cookie cookies consent newsletter subscribe signup popup modal overlay share sharing social related recommended widget pagination pager toolbar login search"
_NAMES = frozenset(NAMES.split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_LABEL = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_SPACE = re.compile(r"\s+")
#: Numbers in names tell pages apart, not places.
_DIGITS = re.compile(r"\d+")
_CLOSES_P = BLOCK - {"br"}


def _named(attributes: str) -> tuple[str, bool, bool]:
    """A tag's class for its path; whether its names mark it as no content; whether as the main part."""
    if "=" not in attributes:
        return "", False, False
    labels = [x for m in _LABEL.finditer(attributes) for x in (m[1] or m[2] or m[3] or "").lower().split()]
    words = {w for x in labels for w in (x, *re.split(r"[-_]", x))}
    return _DIGITS.sub("0", ".".join(sorted(labels)[:3]).replace("/", "|")), bool(words & _NAMES) or "hidden" in attributes.lower().split(), "main" in labels and "role" in attributes.lower()


def parse(html: str) -> list[tuple[str, str, int, int]]:
    """(path, text, linked characters, place) of every block in page order; place: 2 main, 1 open, 0 dropped.

    The empty text of a tag without text is given too, as its path belongs to the template.
    """
    out: list[tuple[str, str, int, int]] = []
    stack: list[tuple[str, str, int, dict]] = [("", "", 1, {})]  # tag, path, place, names of children so far
    buffer: list[str] = []
    linked, owner, pos, filled = 0, stack[0], 0, False

    def flush() -> None:
        nonlocal linked, buffer, filled
        text = _SPACE.sub(" ", unescape("".join(buffer))).strip()
        if text:
            out.append((owner[1], text, linked, owner[2]))
        buffer, linked, filled = [], 0, False

    def put(text: str) -> None:
        nonlocal owner, linked, filled
        if not text:
            return
        top = stack[-1]
        if top[2] != owner[2] and (text.strip()):
            flush()
        if not filled:
            owner = next((x for x in reversed(stack) if x[0] in BLOCK or x[0] in DROPPED or x[2] != top[2]), top)
            owner = (owner[0], owner[1], top[2], owner[3])
        buffer.append(text)
        filled = filled or bool(text.strip())
        if any(x[0] == "a" for x in stack):
            linked += len(text)

    for m in _TOKEN.finditer(html):
        if m.start() < pos:
            continue
        put(html[pos : m.start()])
        pos = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in BLOCK:
            flush()
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            continue
        if tag in _CLOSES_P or tag == "p":
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    del stack[i:]
                    break
                if stack[i][0] in BLOCK:
                    break
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
                if stack[i][0] in ("ul", "ol", "dl", "table", "select", "menu", "tr"):
                    break
        label, bad, main = _named(m[3])
        above = stack[-1]
        place = above[2]
        if place and (tag in DROPPED or bad and tag not in ("html", "body", "article", "main") or tag == "header" and place != 2 or bad and tag == "article" and place == 2):
            place = 0
        elif place and (tag in ("article", "main") or main):
            place = 2
        name = f"{tag}.{label}" if label else tag
        if tag in CONTAINERS and place != 2:
            above[3][name] = number = above[3].get(name, 0) + 1
            if number > 1:
                name = f"{name}#{number}"
        path = f"{above[1]}/{name}"
        out.append((path, "", 0, place))
        if tag in VOID or m[3].endswith("/"):
            continue
        if tag in RAW:  # skip to its end tag
            end = re.compile(rf"</{tag}\s*>", re.I).search(html, pos)
            pos = end.end() if end else len(html)
            continue
        stack.append((tag, path, place, {}))
    put(html[pos:])
    flush()
    return out


_MASK, _HALF = (1 << 63) - 1, (1 << 32) - 1


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each (host, path) of a batch: occurrence vector in two halves, pages, most on a page, characters, linked characters, texts' hashes, place."""
    for batch in batches:
        seen: dict[tuple, list] = {}
        for host, key, html in zip(*(c.to_pylist() for c in batch.columns)):
            paths: dict[str, list] = {}
            for path, text, linked, place in parse(html or ""):
                p = paths.setdefault(path, [0, 0, 0, 0, place])
                if text:
                    p[1] += len(text)
                    p[2] += linked
                    p[3] = (p[3] + xxhash.xxh64_intdigest(text.encode("utf-8", "replace"))) & _MASK
                else:
                    p[0] += 1
            for path, (n, chars, linked, texts, place) in paths.items():
                v = seen.setdefault((host, path), [0, 0, 0, 0, 0, 0, _MASK, 0, place])
                own = xxhash.xxh64_intdigest(f"{key}:{n}".encode())
                v[0], v[1] = v[0] + (own & _HALF), v[1] + (own >> 32)
                v[2], v[3] = v[2] + 1, max(v[3], n)
                v[4], v[5] = v[4] + chars, v[5] + linked
                v[6], v[7] = min(v[6], texts), max(v[7], texts)
                v[8] = max(v[8], place)
        rows = [(h, p, *v) for (h, p), v in seen.items()]
        columns = list(zip(*rows)) if rows else [[]] * 11
        types = [pa.string(), pa.string(), *[pa.int64()] * 8, pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["host", "path", "v0", "v1", "pages", "most", "chars", "linked", "low", "high", "place"])


def templates(pages: DataFrame, min_pages: int = 3, min_class: int = 2, share: float = 0.95) -> DataFrame:
    """(host, path, class, class_size, pages, valid, fixed, main, keep) of every path of the hosts' templates.

    pages: host, page, html. min_pages, min_class: pages and members that make a class valid. share: of the varying
    text that the main slot holds. class: the shortest path of the class, under which its other members nest.
    """
    counted = pages.mapInArrow(_vectors, "host string, path string, v0 long, v1 long, pages long, most long, chars long, linked long, low long, high long, place int")
    sums = [F.sum(c).alias(c) for c in ("v0", "v1", "pages", "chars", "linked")]
    paths = checkpoint(counted.groupBy("host", "path").agg(*sums, F.max("most").alias("most"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("place").alias("place")))
    vector = ["host", "v0", "v1", "pages"]
    classes = paths.groupBy(*vector).agg(F.count("*").alias("class_size"), F.min_by("path", F.struct(F.length("path"), "path")).alias("class"))
    sizes = paths.groupBy("host").agg(F.max("pages").alias("host_pages"))
    valid = (F.col("pages") >= min_pages) & (F.col("class_size") >= min_class)
    # text of the template itself; on a host of a few pages, or of copies alone, nothing shows what varies
    fixed = F.col("valid") & (F.col("chars") > 0) & (F.col("low") == F.col("high")) & (2 * F.col("pages") >= F.col("host_pages"))
    # unlinked text in a place of its own, that of articles before all other
    worth = F.when(F.col("place") > 0, (F.col("chars") - F.col("linked")) * F.when(F.col("place") == 2, 1000).otherwise(1)).otherwise(0)
    found = paths.join(classes, vector).join(sizes, "host").withColumn("valid", valid).withColumn("fixed", fixed)
    found = checkpoint(found.withColumn("worth", F.when(F.col("fixed"), 0).otherwise(worth).cast("long")))
    # all that stands below each path of the template: a page has few levels
    steps = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(2), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))
    below = found.where("path <> ''").select("host", F.explode(above).alias("path"), "worth").groupBy("host", "path").agg(F.sum("worth").alias("below"))
    whole = found.groupBy("host").agg(F.sum("worth").alias("whole"))
    container = F.regexp_extract("path", r"/([^/.#]*)[^/]*$", 1).isin(*CONTAINERS)
    inside = F.regexp_like("path", F.lit(r"/(?:article|main)[^/]*/"))
    slots = below.join(whole, "host").join(found.select("host", "path", "valid", "most", "place"), ["host", "path"])
    slots = slots.where((F.col("below") >= share * F.col("whole")) & (F.col("whole") > 0) & F.col("valid") & container & ~inside & ((F.col("most") == 1) | (F.col("place") == 2)))
    main = slots.groupBy("host").agg(F.max_by("path", F.struct(F.length("path"), "path")).alias("main"))
    out = found.join(main, "host", "left").withColumn("inside", (F.col("path") == F.col("main")) | F.startswith("path", F.concat("main", F.lit("/"))))
    open_slot = F.col("inside") & (F.col("place") > 0)
    # of a host of copies most of the slot would be fixed: then nothing is
    sums = out.groupBy("host").agg((F.sum(F.when(open_slot & F.col("fixed"), F.col("chars"))) * 2 > F.sum(F.when(open_slot, F.col("chars")))).alias("much"))
    out = out.join(sums, "host").withColumn("fixed", F.col("fixed") & ~F.coalesce("much", F.lit(False)))
    return out.select("host", "path", "class", "class_size", "pages", "valid", "fixed", "main", F.coalesce(open_slot & ~F.col("fixed"), F.lit(False)).alias("keep"))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        dropped: dict[tuple, frozenset] = {}
        for html, main, fixed in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
            key = tuple(fixed or ())
            if (fixed := dropped.get(key)) is None:
                dropped[key] = fixed = frozenset(key)
            blocks = [b for b in parse(html or "") if b[1]]
            found = []
            if main is not None:
                found = [t for p, t, _, place in blocks if place and p not in fixed and (p == main or p.startswith(f"{main}/"))]
            if not found:  # not of its host's template
                best = max((b[3] for b in blocks), default=0)
                found = [t for _, t, _, place in blocks if place and place == best]
            texts.append("\n".join(found))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """(page_id, url, text) for every input row."""
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    given = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))
    found = checkpoint(templates(given.select("host", F.col("page_id").cast("string").alias("page"), "html")))
    # a host's main slot, and its template's fixed text in that slot: no more of it than half of the pages hold
    slots = found.where("main IS NOT NULL").groupBy("host").agg(F.max("main").alias("main"), F.array_sort(F.collect_list(F.when(F.col("fixed"), F.col("path")))).alias("fixed"))
    slots = checkpoint(slots)
    size = slots.agg(F.coalesce(F.sum(F.length("host") + F.length("main") + F.length(F.array_join("fixed", " "))), F.lit(0))).first()[0]
    joined = given.join(F.broadcast(slots) if size <= broadcast_chars else slots, "host", "left")
    types = {f.name: f.dataType.simpleString() for f in given.schema}
    return joined.select("page_id", "url", "html", "main", "fixed").mapInArrow(_extract, f"page_id {types['page_id']}, url {types['url']}, text string")


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
