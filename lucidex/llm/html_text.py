"""Main text of web pages through equivalence classes of template tokens.

A page is read as tokens: opening tags told apart by the path of tags above
them (class and id are opaque parts of a path), and words with the path they
stand on.  Over the pages of one host each token has an occurrence vector, its
number of occurrences page by page.  Tokens with equal vectors form an
equivalence class; a class is valid if it stands on MIN_SHARE of the host's
distinct pages, has MIN_CLASS tokens, and its tokens nest below one place.  The
valid classes nest into the host's template, each below the class that owns
the tag around it.

Vectors are never built: sums of hashes of (page, occurrences) identify them.
Words are too many to be counted each by itself, so a first pass over the pages
only finds tokens that are on MIN_SHARE of a host's pages in some chunk of
pages (a token that is on that share of all pages must be so in some chunk) and
notes them in a bit map of fixed size; a second pass counts the tokens on the
map, chunk by chunk, which drops those that chance let in.  Copies of a page
share one page's weight.

Between the template's tokens are slots.  The deepest template tag that holds
MAIN_SHARE of the host's text outside links and boilerplate elements finds the
article; the main slot is the outermost article or main element around it, or,
where there is none, the outermost template tag below body, together with the
page's heading.  Hosts with fewer than MIN_PAGES distinct pages, and pages
without their host's main slot, use the page's own article, main or body in
that order.

Extraction reads the main slot of a page and joins its blocks in page order.
Menus, headers, footers, sidebars, forms and the like go by their elements.
Where no tag holds the article alone and the slot is the body, blocks made of
template words only go too; a slot of the article's own is kept whole, since
articles of a host may share a passage.  Only for containers with less than
half of the page's text a list of customary class names decides, and never for
one with the page's title heading: its one h1 (of several, the first in an
article or main element) or, without any, its only heading.  Names that mean
other things as well (share, widgets, related, header) count only if nothing
else is in the name, and not for containers with sentences of their own.  Of
several article elements at different places that with the most text is the
article.

Defined cases: null or empty html has the text ''; a null url is a host of its
own; repeated pages each get a row; unclosed tags end with their parent, and
unclosed form controls hold nothing; a page whose blocks are all template keeps
them; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, by_value, materialize, share, shared

#: Distinct pages that a host's template needs, and the share of them that a valid class stands on; tokens that make a class.
MIN_PAGES = 4
MIN_SHARE = 0.75
MIN_CLASS = 3

#: Share of the text outside links and boilerplate that the tag which finds the main slot holds.
MAIN_SHARE = 0.9

#: Different tokens that a chunk of pages may gather, and bits of the map of frequent tokens (2 MB).
CHUNK_TOKENS = 300_000
MAP_BITS = 24

#: Words outside links that make the text of a container one of its own.
PROSE = 10

#: Stands for the tag itself among the words of a path.
TAG = "<\n"

# HTML and MathML element names and customary class and id words.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img math mfrac mi mn mo mover mroot mrow ms msqrt msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
_RAW = frozenset("script style noscript template iframe svg object textarea select option button title head canvas audio video annotation".split())
_RUNS_ON = frozenset("script style template iframe textarea title noscript".split())
_BOILER_TAGS = frozenset("nav footer aside form menu dialog fieldset".split())
_BOILER_WORDS = frozenset("ad ads adbox adslot advert adverts advertisement advertising breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disclaimer disqus footer gdpr menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted sidebar signup sponsor sponsored subscribe".split())
_WEAK_WORDS = frozenset("banner header masthead recommended related replies share sharing social toolbar widget widgets".split())
_PLACE_WORDS = frozenset("article blog bottom entry global left main mobile page post posts primary right secondary side site sticky top".split())
_BOX_WORDS = frozenset("area bar block box container inner item items list outer panel row section slot wrap wrapper".split())
_STATE_WORDS = frozenset("has is no not with without".split())
_CLOSED_BY = {"p": frozenset("p".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
_BLOCKS_CLOSE_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden)(?![\w-])\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[a-z]+")
_STOP = re.compile(r"[.!?…。](?:\s|\Z)")


class Node:
    """An open element: its token (path), and what decides about the text below it.

    boiler: it or a parent is boilerplate by its element; soft: it is a header
    outside articles; customary: 2 for a boilerplate name, 1 for a name that
    may be one; title: the page's title heading is below; words, links:
    words below and those of them in links; sentence: whether one ends below.
    """

    __slots__ = ("boiler", "customary", "links", "parent", "path", "sentence", "soft", "tag", "title", "under_name", "under_soft", "weak", "words")

    def __init__(self, tag: str, path: str, parent: Node | None = None, boiler: bool = False, soft: bool = False, customary: int = 0):
        self.tag, self.path, self.parent, self.boiler, self.soft, self.customary = tag, path, parent, boiler, soft, customary
        self.title, self.words, self.links, self.sentence = False, 0, 0, False
        self.under_soft = soft or bool(parent and parent.under_soft)
        self.under_name = customary > 0 or bool(parent and parent.under_name)
        #: The nearest element with such a name, itself included.
        self.weak: Node | None = self if customary == 1 else parent.weak if parent else None

    def above(self) -> Iterator[Node]:
        node: Node | None = self
        while node:
            yield node
            node = node.parent

    @property
    def out(self) -> bool:
        """Whether the text below is boilerplate by elements."""
        return self.boiler or self.under_soft and any(n.soft and not n.title for n in self.above())

    @property
    def named(self) -> str:
        """The path of the outermost parent that is boilerplate by its name, or ''."""
        found = ""
        for n in self.above() if self.under_name else ():
            prose = n.sentence and n.words - n.links >= PROSE and 2 * n.links < n.words
            if n.customary and not n.title and not (n.customary == 1 and prose):
                found = n.path
        return found


def _customary(value: str) -> int:
    """2 if the last part of a class or id, but for words for boxes, says boilerplate; 1 if it may and the other parts say nothing else; else 0."""
    best = 0
    for own in value.split():
        parts = _NAME.findall(own)
        if parts and parts[0] in _STATE_WORDS:
            continue
        while len(parts) > 1 and parts[-1] in _BOX_WORDS:
            parts.pop()
        if parts and parts[-1] in _BOILER_WORDS:
            return 2
        if parts and parts[-1] in _WEAK_WORDS and all(p in _WEAK_WORDS or p in _PLACE_WORDS or p in _BOX_WORDS for p in parts[:-1]):
            best = 1
    return best


def _names(attributes: str) -> tuple[str, int, bool]:
    """An opaque name for the path, how far it is a customary boilerplate name, and hidden or not."""
    name, customary, hidden = "", 0, False
    if "=" in attributes or "hidden" in attributes:
        for key, value in _ATTRIBUTE.findall(attributes):
            value = value.strip("\"'").lower()
            if key.lower() in ("hidden", "aria-hidden"):
                hidden |= key.lower() == "hidden" or value == "true"
                continue
            customary = max(customary, _customary(value))
            name = name or "-".join(_NAME.findall(value)[:3])
    return name, customary, hidden


def walk(source: str) -> Iterator[tuple[str, Node | None, str]]:
    """("open", node, "") for each structural element, ("text" or, in a link, "link", node, text) and ("break", node, "") in page order."""
    stack: list[Node] = [Node("", "")]
    at, end, kind = 0, len(source), "text"
    while at < end:
        m = _TOKEN.search(source, at)
        if m is None:
            yield kind, stack[-1], source[at:]
            return
        if m.start() > at:
            yield kind, stack[-1], source[at : m.start()]
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag == "a":
            kind = "text" if m[1] else "link"
        if m[1]:
            if tag in _INLINE:
                continue
            yield "break", stack[-1], ""
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if tag in _INLINE:
            if tag in ("br", "img"):
                yield "text", stack[-1], " "
            continue
        if tag in _RAW:
            if not m[3].rstrip().endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(source, at)
                if close or tag in _RUNS_ON:
                    at = close.end() if close else end
            continue
        yield "break", stack[-1], ""
        if tag in _VOID:
            continue
        closed = _CLOSED_BY.get(tag, frozenset())
        if tag in _BLOCKS_CLOSE_P:
            closed = closed | {"p"}
        if stack[-1].tag in closed:
            stack.pop()
        name, customary, hidden = _names(m[3]) if m[3] else ("", 0, False)
        soft = tag == "header" and not any(n.tag in ("article", "main") for n in stack)
        path = f"{stack[-1].path}/{tag}" + f".{name}" * bool(name)
        node = Node(tag, path, stack[-1], stack[-1].boiler or hidden or tag in _BOILER_TAGS, soft, 0 if tag in ("html", "body", "article", "main") else customary)
        stack.append(node)
        yield "open", node, ""


def structure(source: str) -> dict[str, list]:
    """{path: [occurrences of its tag, characters of text below outside boilerplate elements, {word: occurrences}]}."""
    out: dict[str, list] = {"": [0, 0, {}]}
    for kind, node, text in walk(source):
        own = out.get(node.path)
        if own is None:
            own = out[node.path] = [0, 0, {}]
        if kind == "open":
            own[0] += 1
        elif kind != "break" and (words := text.split()):
            for word in words:
                own[2][word] = own[2].get(word, 0) + 1
            if not node.boiler and not node.under_soft:
                own[1] += sum(map(len, words))
    # Characters of a path go to the paths above it too, the longest first.
    for path in sorted(out, key=len, reverse=True):
        above = path.rpartition("/")[0]
        if path and above in out:
            out[above][1] += out[path][1]
    return out


def tokens(source: str) -> dict[str, list[int]]:
    """[occurrences, characters below] of each token: the path of a tag, "word path" of a word."""
    out = {}
    for path, (n, chars, words) in structure(source).items():
        if n:
            out[path] = [n, chars]
        out |= {f"{word} {path}": [k, 0] for word, k in words.items()}
    return out


def _mark_title(headings: list[Node]) -> None:
    """Note the page's title heading in the elements around it."""
    own = [h for h in headings if not h.boiler]
    first = [h for h in own if h.tag == "h1"] or own
    inner = [h for h in first if any(n.tag in ("article", "main") for n in h.above())]
    if first and (first[0].tag == "h1" or len(first) == 1):
        for n in (inner or first)[0].above():
            n.title = True


def blocks(source: str) -> list[tuple[str, str, str, str]]:
    """(path, path of a customary boilerplate container or '', text, text as it stands) of each block of text outside boilerplate elements, in page order."""
    whole: list[tuple[Node, str]] = []
    headings: list[Node] = []
    part: list[str] = []
    where: Node | None = None
    for kind, node, text in walk(source):
        if kind == "open" and len(node.tag) == 2 and node.tag[0] == "h" and node.tag[1] in "123456":
            headings.append(node)
        if kind in ("text", "link") and not node.boiler:
            n = len(text.split()) if node.weak else 0
            weak = node.weak
            while weak:
                weak.words += n
                weak.links += n if kind == "link" else 0
                weak.sentence |= _STOP.search(text) is not None
                weak = weak.parent.weak if weak.parent else None
            if node is where:
                part.append(text)
                continue
        if part:
            whole.append((where, "".join(part)))
        part, where = ([text], node) if kind in ("text", "link") and not node.boiler else ([], node)
    if part:
        whole.append((where, "".join(part)))
    _mark_title(headings)
    kept = ((node, _SPACE.sub(" ", html.unescape(text)).strip(), text) for node, text in whole if not node.out)
    return [(node.path, node.named, text, raw) for node, text, raw in kept if text]


def main_text(source: str, slots: set[str] | frozenset[str] = frozenset(), template: frozenset[int] = frozenset(), of: str = "") -> str:
    """Blocks of text below the slots, or below the page's own article, main or body; template: numbers of host of's template words."""
    found = blocks(source)
    roots = {s for s in slots if any(_below(path, s) for path, *_ in found)}
    for tag in () if roots else ("article", "main", "body"):
        at = re.compile(rf"(.*?/{tag}(?:\.[^/]*)?)(?:/|$)")
        texts: dict[str, int] = {}
        for path, _, text, _ in found:
            if m := at.match(path):
                texts[m[1]] = texts.get(m[1], 0) + len(text)
        if texts:
            roots = {max(texts, key=lambda r: (texts[r], r))}
            break
    inside = [x for x in found if not roots or any(_below(x[0], r) for r in roots)]
    if template and (own := [x for x in inside if not all(number(w, seed(of, x[0])) in template for w in x[3].split())]):
        inside = own
    every, sizes = sum(len(x[2]) for x in inside), {}
    for _, named, text, _ in inside:
        sizes[named] = sizes.get(named, 0) + len(text)
    return "\n\n".join(text for _, named, text, _ in inside if not named or 2 * sizes[named] >= every)


def _below(path: str, root: str) -> bool:
    return path == root or path.startswith(root + "/")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))


def seed(of: str, path: str) -> int:
    from xxhash import xxh64_intdigest as h

    return h(f"{of} {path}", 7)


def number(word: str, own: int) -> int:
    """64 bits for a word, or TAG for the tag, on the path of a seed; signed."""
    from xxhash import xxh64_intdigest as h

    x = h(word, own)
    return x - (1 << 64) if x >> 63 else x


def _chunks(parts):
    """Runs of pages with at most about CHUNK_TOKENS different tokens.

    Yields (tokens by path, host, hash, weight, html) of each page, which the
    caller counts into the tokens, and at its end the chunk: {host: {"pages": weight, "tokens": {path: {word: ...}}}}.
    """
    chunk: dict[str, dict] = {}
    size = 0
    for part in parts:
        for own, page, copies, source in zip(*(part.column(c).to_pylist() for c in ("host", "page", "copies", "html")), strict=True):
            at = chunk.setdefault(own, {"pages": 0.0, "tokens": {}, "size": 0})
            at["pages"] += 1 / copies
            before = at["size"]
            yield at, own, page, 1 / copies, source
            size += at["size"] - before
        if size > CHUNK_TOKENS:
            yield chunk
            chunk, size = {}, 0
    yield chunk


def _frequent(parts):
    """Numbers of the tokens that are on MIN_SHARE of a host's pages in a chunk."""
    import pyarrow as pa

    for at in _chunks(parts):
        if isinstance(at, dict):
            found = []
            for own, x in at.items():
                least = MIN_SHARE * x["pages"] - 1e-6
                for path, seen in x["tokens"].items():
                    if often := [w for w, n in seen.items() if n >= least]:
                        key = seed(own, path)
                        found += [number(w, key) for w in often]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["token"])
            continue
        own, _, _, weight, source = at
        for path, (n, _, words) in structure(source).items():
            seen = own["tokens"].setdefault(path, {})
            before = len(seen)
            for word in words:
                seen[word] = seen.get(word, 0.0) + weight
            if n:
                seen[TAG] = seen.get(TAG, 0.0) + weight
            own["size"] += len(seen) - before


_COUNTED = T.StructType([T.StructField("host", T.StringType()), T.StructField("token", T.StringType()), T.StructField("number", T.LongType()), T.StructField("low", T.LongType()), T.StructField("high", T.LongType()), T.StructField("weight", T.DoubleType()), T.StructField("most", T.LongType()), T.StructField("chars", T.DoubleType())])


def _counted(bits):
    """Sums over a chunk's pages for each token that is on the map of frequent ones."""

    def run(parts):
        import pyarrow as pa
        from xxhash import xxh64_intdigest as h

        on = shared(bits)
        for at in _chunks(parts):
            if isinstance(at, dict):
                rows = [(own, path if w == TAG else f"{w} {path}", *x) for own, seen in at.items() for (path, w), x in seen["tokens"].items()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 8, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64()), strict=True)], names=_COUNTED.names)
                continue
            own, name, page, weight, source = at
            seen = own["tokens"]
            for path, (opened, chars, words) in structure(source).items():
                key = seed(name, path)
                if opened:
                    words[TAG] = opened
                for word, n in words.items():
                    x = h(word, key)
                    place = x & ((1 << MAP_BITS) - 1)
                    if not on[place >> 3] >> (place & 7) & 1:
                        continue
                    # Copies of a page add its numbers as often for every token, so equal vectors keep equal sums.
                    v = h(f"{page} {n}", 9)
                    to = seen.get((path, word))
                    if to is None:
                        to = seen[path, word] = [x - (1 << 64) if x >> 63 else x, 0, 0, 0.0, 0, 0.0]
                        own["size"] += 1
                    to[1] += v & 0x7FFFFFFF
                    to[2] += v >> 33
                    to[3] += weight
                    to[4] = max(to[4], n)
                    if word == TAG:
                        to[5] += chars * weight

    return run


def equivalence_classes(pages: DataFrame) -> DataFrame:
    """(host, low, high, token, number, most, weight, chars, host_pages, parent_low, parent_high) of the tokens of valid classes.

    pages: host, page (a hash of html) and html.  low and high name the class, parent_* the class that owns the tag around it.
    """
    spark = pages.sparkSession
    copies = pages.groupBy("host", "page").agg(F.count("*").alias("copies"))
    counts = copies.groupBy("host").agg(F.count("*").cast("double").alias("host_pages"))
    several = materialize(copies.where("copies > 1"), "page-copies")
    rows = pages.join(several, ["host", "page"], "left").select("host", "page", F.coalesce("copies", F.lit(1)).alias("copies"), "html")
    place = F.pmod(F.col("token"), F.lit(1 << MAP_BITS)) + 1
    marked = rows.mapInArrow(_frequent, "token long").select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    # The map has 2 ** MAP_BITS bits, in pieces of 4096 bytes numbered from 1, whatever the input.
    bits = bytearray(1 << (MAP_BITS - 3))
    for r in marked.collect():
        bits[(r["bucket"] - 1) << 12 : r["bucket"] << 12] = r["bits"]
    sums = ["low", "high", "weight", "chars"]
    counted = rows.mapInArrow(_counted(share(spark, bytes(bits))), _COUNTED).groupBy("host", "token", "number").agg(*[F.sum(c).alias(c) for c in sums], F.max("most").alias("most"))
    frequent = materialize(counted.join(counts, "host").where((F.col("host_pages") >= MIN_PAGES) & (F.col("weight") >= MIN_SHARE * F.col("host_pages") - 1e-6)), "template-tokens")
    is_tag = ~F.col("token").contains(" ")
    path = F.regexp_replace("token", r"^\S+ ", "")
    frequent = frequent.withColumn("path", path).withColumn("around", F.when(is_tag, F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.col("path")))
    # The class's place is the shortest path around one of its tokens; those elsewhere don't nest with it.
    places = frequent.groupBy("host", "low", "high").agg(F.min(F.struct(F.length("around"), "around"))["around"].alias("place"))
    nested = frequent.join(places, ["host", "low", "high"]).where(F.col("around").startswith(F.col("place")))
    large = nested.groupBy("host", "low", "high").agg(F.count("*").alias("size")).where(F.col("size") >= MIN_CLASS).drop("size")
    valid = nested.join(large, ["host", "low", "high"])
    owners = valid.where(is_tag).select("host", F.col("path").alias("place"), F.col("low").alias("parent_low"), F.col("high").alias("parent_high"))
    return valid.join(owners, ["host", "place"], "left").select("host", "low", "high", "token", "number", "path", "most", "weight", "chars", "host_pages", "parent_low", "parent_high")


def templates(pages: DataFrame) -> DataFrame:
    """(host, slot, words) for each host that has a template: the path of the main slot, and the numbers of the template's words if that slot is the body."""
    classes = materialize(equivalence_classes(pages), "template")
    tags = classes.where(~F.col("token").contains(" ") & (F.col("most") == 1))
    every = tags.groupBy("host").agg(F.max("chars").alias("every"))
    deep = tags.join(every, "host").where((F.col("chars") >= MAIN_SHARE * F.col("every")) & (F.col("every") > 0))
    found = deep.groupBy("host").agg(F.max(F.struct(F.size(F.split("path", "/")), "path"))["path"].alias("deepest"))
    heading = tags.where(F.col("path").rlike(r"/h1(?:\.[^/]*)?$")).groupBy("host").agg(F.min("path").alias("heading"))
    semantic = F.regexp_extract("deepest", r"^(.*?/(?:article|main)(?:\.[^/]*)?)(?:/|$)", 1)
    outermost = F.regexp_extract("deepest", r"^(.*?/body(?:\.[^/]*)?/[^/]+)(?:/|$)", 1)
    # A heading outside the outermost tag belongs to the article too, whose slot then is the body.
    body = F.regexp_extract("deepest", r"^(.*?/body(?:\.[^/]*)?)(?:/|$)", 1)
    covers = F.col("heading").isNull() | F.col("heading").startswith(F.concat(outermost, F.lit("/")))
    slot = F.when(semantic != "", semantic).when((outermost != "") & covers, outermost).otherwise(body)
    slots = found.join(heading, "host", "left").select("host", slot.alias("slot"))
    shared_slots = slots.where(F.col("slot").rlike(r"/body(?:\.[^/]*)?$|^$")).select("host")
    words = classes.where(F.col("token").contains(" ")).join(shared_slots, "host", "left_semi").groupBy("host").agg(F.collect_list("number").alias("words"))
    return slots.join(words, "host", "left").select("host", "slot", F.coalesce("words", F.array().cast("array<bigint>")).alias("words"))


def main_slots(pages: DataFrame) -> DataFrame:
    """(host, slot) of each host that has a template."""
    return templates(pages).select("host", "slot")


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html", template: bool = True) -> DataFrame:
    """(key, url, text, n_chars) for every page row; template=False reads each page by itself."""
    batches(pages.sparkSession)
    rows = pages.select(F.col(f"`{key}`").alias("key"), F.col(f"`{url}`").alias("url"), F.coalesce(F.col(f"`{source}`"), F.lit("")).alias("html")).withColumn("host", host(F.col("url")))
    if template:
        found = materialize(templates(rows.select("host", F.xxhash64("html").alias("page"), "html").where("html <> ''")), "slots").withColumnRenamed("host", "slot_host")
        joined = rows.join(found, F.col("host") == F.col("slot_host"), "left").select("key", "url", "html", "host", "slot", "words")
    else:
        joined = rows.select("key", "url", "html", "host", F.lit(None).cast("string").alias("slot"), F.lit(None).cast("array<bigint>").alias("words"))
    schema = T.StructType([T.StructField("key", rows.schema["key"].dataType), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(parts):
        import pyarrow as pa

        sets: dict = {}
        for part in parts:
            texts = []
            for own, page, slot, words in zip(part.column("host").to_pylist(), part.column("html").to_pylist(), part.column("slot").to_pylist(), part.column("words"), strict=True):
                if own not in sets:
                    if len(sets) > 1000:
                        sets.clear()
                    sets[own] = frozenset(words.as_py() or ())
                texts.append(main_text(page, {slot} if slot else frozenset(), sets[own], own))
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return joined.mapInArrow(run, schema).withColumnRenamed("key", key)


by_value(__name__)
