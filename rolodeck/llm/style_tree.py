"""Operator 9, main text by site style trees.

The DOMs of a host's pages are merged by style path (tags with class and id
words). A path's presentation importance is the entropy of its child
sequences, its content importance one minus the mean entropy of its texts over
the pages: a text on every page tells nothing, a text on one page is content.
Their composite, as in the published method, marks low-importance paths, and
each page drops those branches.

Entropy alone cannot tell a menu whose words differ from page to page from an
article, so what the markup states outranks it: elements that say they are
menus, footers, adverts, forms, comments and the like are noise wherever they
stand, and the prose of an ``article`` or ``main`` element is content. The
importance decides everything else. A word or form names a wrapper, not noise,
where it holds the larger part of the page's main content or, in prose, of its
text (``_Page.settle``); text outside an ``article`` goes unless its prose is longer.

Pages are parsed where they are read (the parser is a small helper per row).
Counts are map-side combined by hashed (host, path, text), so a host with a
third of all pages is no hot task; only its low paths are joined back to pages.

Defined cases: null or empty html gives empty text; a page without a host
merges with no other; equal pages of a host, and near copies (pages with the
same shared texts that make up most of them), count once; a page whose blocks
would all go keeps its largest branch; broken markup is
closed as browsers do; repeated rows get a row each.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from rolodeck.llm.staging import staged

#: A path below ``THRESHOLD`` is noise; hosts with fewer distinct pages than MIN_PAGES tell nothing. GAMMA: see importance().
THRESHOLD, MIN_PAGES, GAMMA = 0.2, 3, 0.9

#: Elements of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html "
    "legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
PROSE = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre ul ol li dl dt dd table thead tbody tfoot tr td th caption figure figcaption".split())
#: Elements that an opening tag of the key ends, if they are open within the innermost element of the second set.
CLOSES = {
    **{t: (frozenset(["p"]), frozenset(["table", "td", "th", "caption", "button", "object"])) for t in BLOCK - {"html", "body", "head", "title", "option", "optgroup", "tr", "td", "th", "tbody", "thead", "tfoot", "caption", "legend"}},
    "body": (frozenset(["head"]), frozenset()),
    "option": (frozenset(["option"]), frozenset(["select"])),
    "tr": (frozenset(["tr", "td", "th", "caption"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tbody": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "caption"]), frozenset(["table"])),
    "tfoot": (frozenset(["thead", "tbody", "tr", "td", "th", "caption"]), frozenset(["table"])),
}
SIBLINGS = {"li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])), "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"]))}
#: Elements that are never main text, and words of class, id or role that say so.
NOISE_TAGS = frozenset("head nav footer aside script style noscript template button select textarea iframe svg canvas object menu dialog title search audio video map datalist input label fieldset".split())
NOISE_WORDS = frozenset(
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside footer header masthead banner ad ads advert adverts advertisement advertisements adsense adslot sponsor sponsors "
    "sponsored promo promos promotion promotions cookie cookies consent gdpr notice notices alert alerts popup popups modal overlay newsletter subscribe subscription signup login signin search "
    "searchbox form comment comments commentlist disqus respond replies reply share sharing social related recommended recommendations widget widgets toolbar pagination pager skip hidden "
    "copyright legal disclaimer complementary contentinfo dialog alertdialog tooltip".split()
)
#: Words that make an ``article`` element something else.
ARTICLE_NOISE = frozenset("comment comments ad ads advert advertisement promo related recommended sponsored teaser".split())
MAIN_TAGS = frozenset(("article", "main"))
#: Words that say what an element holds, not how a page is laid out: only a ``main`` element inside makes it a wrapper.
HELD_WORDS = frozenset("comment comments commentlist disqus respond replies reply related recommended recommendations cookie cookies consent gdpr hidden popup popups modal".split())
PARAGRAPHS = frozenset("p blockquote pre".split())
#: How main content began: by an article, by a main element.
ARTICLE, MAIN = 1, 2

_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_WORDS = re.compile(r"[A-Za-z0-9]+")
_STOP = re.compile(r"""[>"']""")


def _tag_end(text: str, at: int, none: dict[str, int]) -> int:
    """Index after the tag whose attributes begin at ``at``; quoted values hide a ``>``. none: from where each quote is no more found."""
    while m := _STOP.search(text, at):
        i, c = m.start(), m[0]
        if c == ">":
            return i + 1
        if not text[at:i].rstrip().endswith("="):  # a stray quote hides nothing
            at = i + 1
            continue
        end = -1 if none.get(c, len(text)) <= i + 1 else text.find(c, i + 1)
        if end < 0:  # never closed: the tag ends at its first ``>``
            none[c] = min(none.get(c, len(text)), i + 1)
            close = text.find(">", i)
            return len(text) if close < 0 else close + 1
        at = end + 1
    return len(text)


class _Page:
    """Blocks of a page in order: (path, text, is noise, how its main content began or 0, is exempt prose); children by path."""

    def __init__(self, text: str):
        self.blocks: list[tuple[str, str, bool, int, bool]] = []
        #: Of each block the stated elements (words, forms) that it is in, of these the ones that main content began in; of each element whether HELD_WORDS name it.
        self.stated: list[tuple[tuple[int, ...], tuple[int, ...]]] = []
        self.named: list[bool] = []
        self.children: dict[str, list[str]] = {}
        #: Tag, path, noise, main, exempt, stated, and for noise within a line the text before it, which goes on behind it.
        self.open: list[tuple[str, str, bool, int, bool, tuple[tuple[int, ...], tuple[int, ...]], list[str] | None]] = []
        self.held: list[str] = []
        self._parse(text)
        self.settle()

    def _top(self) -> tuple[str, bool, int, bool, tuple[tuple[int, ...], tuple[int, ...]]]:
        return self.open[-1][1:6] if self.open else ("", False, 0, False, ((), ()))

    def settle(self) -> None:
        """Blocks in stated elements are noise, but for wrappers: those with more than half of the page's main content, or of its text in prose."""
        if not self.named:
            return
        everything, mains = 0, 0
        prose, inside, of_main = ([0] * len(self.named) for _ in range(3))
        for (path, said, noise, main, _), (within, around) in zip(self.blocks, self.stated):
            if noise:
                continue
            everything += len(said)
            mains += len(said) * (main > 0)
            paragraph = path.rpartition("/")[2].partition(".")[0] in PARAGRAPHS
            for e in within:
                prose[e] += len(said) * (paragraph and not main)
            for e in around:
                inside[e] += len(said)
                of_main[e] += len(said) * (main == MAIN)
        wraps = [2 * (of_main[e] if held else inside[e]) > mains or (not held and 2 * prose[e] > everything) for e, held in enumerate(self.named)]
        self.blocks = [(path, said, noise or not all(wraps[e] for e in within), main, exempt) for (path, said, noise, main, exempt), (within, _) in zip(self.blocks, self.stated)]

    def _flush(self) -> None:
        if self.held:
            said = " ".join(entities.unescape("".join(self.held)).split())
            self.held = []
            if said:
                path, noise, main, exempt, stated = self._top()
                self.blocks.append((path, said, noise, main, exempt))
                self.stated.append(stated)

    def _push(self, tag: str, attributes: str) -> None:
        path, noise, main, exempt, (within, around) = self._top()
        got = {}
        if attributes.strip():
            got = {k.lower(): entities.unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(attributes)}
        words = {w.lower() for key in ("class", "id", "role") for w in _WORDS.findall(got.get(key, ""))}
        begins = tag in MAIN_TAGS or "main" in _WORDS.findall(got.get("role", "")) or "articlebody" in got.get("itemprop", "").lower()
        own = tag in NOISE_TAGS or (tag == "header" and not main) or "hidden" in got or got.get("aria-hidden") == "true" or "display:none" in got.get("style", "").replace(" ", "").lower()
        if tag == "article":
            own = own or not ARTICLE_NOISE.isdisjoint(words)
        says = tag == "form"
        if tag == "article":
            pass
        elif not begins and tag not in ("html", "body"):
            # within the main content a header holds the title
            says = says or not NOISE_WORDS.isdisjoint(words - {"header"} if main else words)
        # prose right under the main element, or under prose of it, is content whatever its importance
        exempt = begins or (exempt and (tag not in BLOCK or (tag in PROSE and not words)))
        if begins and not main:
            around = within  # the main content begins inside all of these
        noise, main = noise or own, max(main, begins and (ARTICLE if tag == "article" else MAIN))
        if says and not own:
            within = (*within, len(self.named))
            self.named.append(not HELD_WORDS.isdisjoint(words))
        own = own or says
        saved = None
        if tag in BLOCK:
            self._flush()
        elif own:
            saved, self.held = self.held, []
        if tag in BLOCK or own:
            style = ".".join([tag, *sorted({"#" if w.isdigit() else w for w in words})])
            self.children.setdefault(path, []).append(style)
            path = f"{path}/{style}"
        self.open.append((tag, path, noise, main, exempt, (within, around), saved))

    def _pop_to(self, index: int) -> None:
        while len(self.open) > index:
            tag, saved = self.open[-1][0], self.open[-1][6]
            if tag in BLOCK or saved is not None:
                self._flush()
            self.open.pop()
            if saved is not None:
                self.held = saved

    def _close(self, tags: frozenset, within: frozenset) -> None:
        k = len(self.open) - 1
        while k >= 0 and self.open[k][0] not in within:
            if self.open[k][0] in tags:
                self._pop_to(k)
            k -= 1

    def _parse(self, text: str) -> None:
        at, none = 0, {}
        while (lt := text.find("<", at)) >= 0:
            if lt > at:
                self.held.append(text[at:lt])
            if text.startswith("<!--", lt):
                end = text.find("-->", lt + 4)
                at = len(text) if end < 0 else end + 3
                continue
            if text.startswith(("<!", "<?"), lt):
                end = text.find(">", lt)
                at = len(text) if end < 0 else end + 1
                continue
            m = _TAG.match(text, lt)
            if not m:
                self.held.append("<")
                at = lt + 1
                continue
            tag, end = m[1].lower(), _tag_end(text, m.end(), none)
            attributes = text[m.end() : end].rstrip(">")
            at = end
            if text[lt + 1] == "/":
                for k in range(len(self.open) - 1, -1, -1):
                    if self.open[k][0] == tag:
                        self._pop_to(k)
                        break
                    if self.open[k][0] in BLOCK and tag not in BLOCK:
                        break  # an inline end tag does not end blocks
                continue
            if tag in VOID:
                if tag in ("br", "img", "wbr", "input"):
                    self.held.append(" " if tag != "wbr" else "")
                elif tag == "hr":
                    self._flush()
                continue
            for rule in (CLOSES.get(tag), SIBLINGS.get(tag)):
                if rule:
                    self._close(*rule)
            self._push(tag, attributes)
            if tag in RAW:
                stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|$)", re.I).search(text, at)
                stop_at = stop.start() if stop else len(text)
                if tag not in ("script", "style"):
                    self.held.append(text[at:stop_at])
                at = stop_at
        self.held.append(text[at:])
        self._pop_to(0)
        self._flush()


def main_text(html: str | None, low: frozenset[int] = frozenset()) -> str:
    """The page's main text without the paths whose hashes are in ``low``."""
    page = _Page(html or "")
    kept = [b for b in page.blocks if not b[2]]
    within = [b for b in kept if b[3]]
    if not any(b[3] == MAIN for b in within):
        # a teaser's article does not hide longer prose
        outside = sum(len(b[1]) for b in kept if not b[3] and b[0].rpartition("/")[2].partition(".")[0] in PARAGRAPHS)
        within = within if outside <= sum(len(b[1]) for b in within) else kept
    whole = within or kept
    if low:
        left = [b for b in whole if b[4] or hashed(b[0]) not in low]
        if not left and whole:
            size: dict[str, int] = {}
            for b in whole:
                size[b[0]] = size.get(b[0], 0) + len(b[1])
            largest = max(size, key=size.__getitem__)
            left = [b for b in whole if b[0] == largest]
        whole = left
    return "\n\n".join(b[1] for b in whole)


def hashed(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))


_NODES = "host string, page long, path long, kind byte, feature long, chars long"
#: Kinds of a node's features: the sequence of its block children, a text of its own; and of a page's: a text that is not stated noise, all of these.
STYLE, TEXT, SAID, PAGE = 0, 1, 2, 3
#: Bits that a text's hash gives up, so that the sum over a page's texts stays within a long.
SPARE = 20
#: A page is a near copy if at most one in COPY of its characters is of texts that no other page of the host has.
COPY = 5


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: tuple[list, ...] = ([], [], [], [], [], [])
        for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            page = _Page(html or "")
            number = hashed("\n".join(said for _, said, _, _, _ in page.blocks))
            texts = {(path, said) for path, said, _, _, _ in page.blocks}
            paths = {path for path, _ in texts} | page.children.keys()
            found = [(hashed(path), TEXT, hashed(said), 0) for path, said in texts]
            found += [(hashed(path), STYLE, hashed(" ".join(page.children.get(path, ()))), 0) for path in paths]
            own = {hashed(said) >> SPARE: len(said) for _, said, noise, _, _ in page.blocks if not noise}
            found += [(0, SAID, text, n) for text, n in own.items()] + [(0, PAGE, sum(own), sum(own.values()))]
            for path, kind, feature, chars in found:
                for column, x in zip(rows, (host, number, path, kind, feature, chars)):
                    column.append(x)
        types = (pa.string(), pa.int64(), pa.int64(), pa.int8(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], ["host", "page", "path", "kind", "feature", "chars"])


def _copies(nodes: DataFrame) -> DataFrame:
    """(host, page, of): the near copies among the pages; ``of`` is the same for pages with the same shared texts."""
    texts = nodes.where(F.col("kind") == SAID).groupBy("host", "feature").agg(F.count(F.lit(1)).alias("k"), F.min("page").alias("page"), F.first("chars").alias("chars"))
    # a text that one page has counts against it; a page's shared texts are all of its texts but these
    alone = texts.where("k = 1").select("host", "page", (-F.col("feature")).alias("feature"), F.lit(0).cast("long").alias("chars"), F.col("chars").alias("alone"))
    whole = nodes.where(F.col("kind") == PAGE).select("host", "page", "feature", "chars", F.lit(0).cast("long").alias("alone"))
    sums = whole.unionByName(alone).groupBy("host", "page").agg(*[F.sum(c).alias(c) for c in ("feature", "chars", "alone")])
    return sums.where(F.col("alone") * COPY <= F.col("chars")).select("host", "page", F.col("feature").alias("of"))


def importance(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """The site style trees: (host, path, pages, presentation, content, importance), paths as hashes.

    With m pages, near copies counted once, that have a path, presentation is -sum(p log_m p) over its child sequences, content is the mean
    over its distinct texts of 1 - log_m(pages that have the text); importance is
    (1 - GAMMA^l) presentation + GAMMA^l content with l child sequences. Below MIN_PAGES all are 1.
    """
    sites = pages.select(host_of(F.col(url)).alias("host"), F.col(html).alias("html")).where("host <> ''")
    nodes = staged(sites.mapInArrow(_nodes, _NODES).distinct(), "nodes")  # equal pages count once
    copies = staged(_copies(nodes), "near-copies")
    style = F.col("kind") == STYLE
    features = nodes.where(F.col("kind").isin(STYLE, TEXT)).join(copies, ["host", "page"], "left").withColumn("page", F.coalesce("of", "page"))
    # near copies count once: each of their texts, and of a path's child sequences one
    text = F.when(~style, F.col("feature")).alias("text")
    once = features.groupBy("host", "page", "path", "kind", text).agg(F.min("feature").alias("feature"))
    counted = once.groupBy("host", "path", "kind", "feature").agg(F.count(F.lit(1)).alias("k"))
    sums = counted.groupBy("host", "path").agg(
        F.sum(F.when(style, F.col("k"))).alias("pages"),
        F.sum(F.when(style, F.col("k") * F.log("k"))).alias("spread"),
        F.count(F.when(style, True)).alias("styles"),
        F.avg(F.when(~style, F.log("k"))).alias("common"),
    )
    m = F.log("pages")
    known = F.col("pages") >= MIN_PAGES
    presentation = F.when(known, 1 - F.col("spread") / F.col("pages") / m).otherwise(1.0)
    content = F.when(known, 1 - F.col("common") / m).otherwise(1.0)
    trust = F.pow(F.lit(GAMMA), F.col("styles"))
    return sums.select(
        "host", "path", "pages", presentation.alias("presentation"), content.alias("content"),
        F.when(known, (1 - trust) * presentation + trust * F.coalesce(content, presentation)).otherwise(1.0).alias("importance"),
    )


def _extracted(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        said = [main_text(h, frozenset(low or ())) for h, low in zip(batch.column("html").to_pylist(), batch.column("low").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(said, pa.string()), pa.array(map(len, said), pa.int64())], schema=schema)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, url, text, n_chars), a row for each row of ``pages``."""
    low = importance(pages, url, html).where((F.col("importance") < threshold) & F.col("content").isNotNull())
    # written first, so that its size is known before it is joined
    hosts = staged(low.groupBy("host").agg(F.collect_list("path").alias("low")), "low-paths")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host_of(F.col(url)).alias("host"))
    rows = rows.join(hosts, "host", "left").select("page_id", "url", "html", "low")
    out = T.StructType([rows.schema["page_id"], rows.schema["url"]]).add("text", T.StringType()).add("n_chars", T.LongType())
    schema = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in out])
    return rows.mapInArrow(lambda it: _extracted(it, schema), out)
