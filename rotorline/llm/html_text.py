"""Main text of pages by consensus of their host.

A page scores its containers: the elements that hold text, each known by its path, the chain of block
elements with their classes, numbers generalised, so that the pages of one template share it. It votes
for the paths that hold much of its text, against those that are named as something around an article,
and tells a digest of every block. Spark sums the votes per host and path, and finds the blocks that
pages of different content share: a path most of whose text is repeated is boilerplate, whatever its
name. Each page is then read again by what its host decided of its own paths, widened to the article
element around them. Where that leaves a page without text, its own best container is taken.

Only the path's digest travels, which starts with the host's. Names are a prior: a container whose
class says `sidebar` or `cookie-banner` votes against itself, unless it is where most of the page is; one
that has such a word among others (`social-science`) counts half.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rotorline.llm.common import byte_texts, in_arrow, named, sent_if_small, settled, width

# Elements of the HTML standard by what they mean for text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select "
    "summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
SPACE = frozenset("br img wbr hr input".split()) - {"wbr"}
PARAGRAPHS = frozenset("p pre h1 h2 h3 h4 h5 h6 li dt dd td th tr tbody thead tfoot blockquote figcaption caption summary address hgroup ul ol dl".split())
#: Elements that show no text of the page, or controls.
UNSHOWN = frozenset(
    "head button select option noscript template svg canvas object audio video map iframe script style textarea label datalist".split())
#: Elements that are around an article by their meaning.
AROUND = frozenset("nav header footer aside dialog menu search".split())
#: What a start tag ends: the open elements of the first set, up to one of the second.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"}), "body": ({"head"}, {"html"}),
}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split())
#: Words that name what is around an article, and words that say nothing beside them.
CHROME = frozenset(
    "ad ads adv advert advertisement adverts advertising adsense banner breadcrumb breadcrumbs byline comment comments commentlist "
    "cookie cookies consent discussion discussions disqus dropdown feedback footer footnav gdpr header login masthead menu modal nav "
    "navbar navigation newsletter notice notices notification overlay pager paginate pagination paywall popup promo promoted promotion "
    "recommended related replies reply respond responses reviews share sharing sidebar signin signup skip skyscraper social sponsor "
    "sponsored sponsors subscribe subscription tags teaser toolbar topbar widget widgets".split())
FILLERS = frozenset(
    "area bar bars block body bottom box button buttons col column container content form global group holder inner item items left "
    "link links list main outer page panel primary reader readers right row secondary section site thread top unit user users "
    "wrap wrapper".split())
#: Words that name it whatever is beside them.
SURE = frozenset("adsense advertisement breadcrumb breadcrumbs comment comments commentlist disqus navbar pagination sidebar".split())
#: Names of which each word is one of these are of the article, whatever the other names of the element.
ARTICLE = frozenset("article body content entry main post story text".split())
#: Before such a word, the name tells the layout of a container and not what it holds.
LAYOUT = frozenset("has with without no is layout".split())
UNNAMED = frozenset("html body main article".split())
#: Elements around everything on a page; the root has no name.
OUTERMOST = frozenset(("", "html", "body"))

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>", re.DOTALL)
UNFINISHED = re.compile(r"<[!?/a-zA-Z]")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
DIGITS = re.compile(r"\d+")

#: What a path is: nothing special, with a word of what is around an article, a form, named as what is around, or so by its element.
PLAIN, DOUBTFUL, FORM, CHROME_NAMED, CHROME_ELEMENT = range(5)
FACTORS = {PLAIN: 1.0, DOUBTFUL: 0.5, FORM: 0.5, CHROME_NAMED: 0.1, CHROME_ELEMENT: 0.0}
FAVOURED = {"article": 1.25, "main": 1.25}
#: Share of the fullest container's score from which a page is for a path, and text from which one that is named as chrome may be the fullest.
LEAST_SHARE, LEAST_NAMED = 0.1, 250
FOR, SMALL, AGAINST, REPEATED = 1, 0, -1, -2


def _hash(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "big", signed=True)


class Path(NamedTuple):
    """A path of a page. Numbers are places in the page's list of paths, -1 for none."""

    id: int
    parent: int
    tag: str
    factor: float
    chrome: int
    container: int
    article: int


class Block(NamedTuple):
    """The text of one block, its container, and how many of its characters are in links."""

    container: int
    text: str
    linked: int


class Page(NamedTuple):
    """Paths of a page, each after its parent, and its blocks in order."""

    paths: list[Path]
    blocks: list[Block]


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)} if text.strip() else {}


def _unshown(tag: str, attributes: dict[str, str]) -> bool:
    return tag in UNSHOWN or bool(attributes) and (
        "hidden" in attributes or attributes.get("aria-hidden") == "true"
        or "display:none" in attributes.get("style", "").replace(" ", "").lower()) and tag not in UNNAMED


def _named_as(attributes: dict[str, str]) -> int:
    """What the classes and the id of an element make it."""
    found = set()
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        words = [w.lower() for w in NAMES.findall(name)]
        told = [w in CHROME and not (i and words[i - 1] in LAYOUT) for i, w in enumerate(words)]
        if any(told):
            sure = all(t or w in FILLERS or len(w) == 1 for t, w in zip(told, words)) or any(t and w in SURE for t, w in zip(told, words))
            found.add(CHROME_NAMED if sure else DOUBTFUL)
        elif words and all(w in ARTICLE for w in words):
            found.add(PLAIN)
    return CHROME_NAMED if CHROME_NAMED in found else PLAIN if PLAIN in found else DOUBTFUL if found else PLAIN


def _has_role(attributes: dict[str, str]) -> bool:
    return attributes.get("role", "").lower() in ROLES


def _kind(tag: str, attributes: dict[str, str], within_article: bool) -> int:
    if tag in UNNAMED:
        return PLAIN
    if tag in AROUND and not (tag == "header" and within_article) or _has_role(attributes):
        return CHROME_ELEMENT
    return max(_named_as(attributes) if attributes else PLAIN, FORM if tag in ("form", "fieldset") else PLAIN)


def _label(tag: str, attributes: dict[str, str]) -> str:
    classes = sorted({DIGITS.sub("#", c) for c in attributes.get("class", "").split()})
    return ".".join([tag, *classes])


class _Paths:
    """The paths of one page, each once."""

    def __init__(self, site: int):
        self.known: dict[tuple[int, str, int], int] = {}
        self.list = [Path(site, -1, "", 1.0, -1, 0, -1)]

    def below(self, parent: int, tag: str, attributes: dict[str, str]) -> int:
        above = self.list[parent]
        kind = _kind(tag, attributes, above.article >= 0)
        label = _label(tag, attributes) if attributes else tag
        key = (parent, label, kind)
        at = self.known.get(key)
        if at is None:
            at = self.known[key] = len(self.list)
            chrome = at if kind >= FORM else above.chrome
            self.list.append(Path(
                _hash(b"%d/%d/%s" % (above.id, kind, label.encode())), parent, tag, min(above.factor, FACTORS[kind]), chrome,
                above.container if tag in PARAGRAPHS and kind == PLAIN else at, at if tag == "article" and above.article < 0 else above.article))
        return at


def blocks_of(page: str, site: int = 0) -> Page:
    """The blocks of a page in order, without what is never shown; unclosed elements end as browsers end them."""
    paths = _Paths(site)
    # An open element: its tag, its path, whether it is shown, and the inline elements open inside it if it is a block.
    stack: list[tuple[str, int, bool, dict[str, int] | None]] = [("", 0, True, {})]
    inner = [0]  # the places of open blocks on the stack
    opened: Counter = Counter()
    out: list[Block] = []
    held: list[str] = []
    linked, links = 0, 0
    at, end = 0, page.rfind(">") + 1

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            out.append(Block(paths.list[stack[inner[-1]][1]].container, text, linked))
        linked = 0

    def close(depth: int) -> None:
        nonlocal links
        if inner[-1] >= depth:
            flush()
            while inner[-1] >= depth:
                inner.pop()
        for tag, *_ in stack[depth:]:
            opened[tag] -= 1
            links -= tag == "a"
        for tag, _, _, inside in stack[depth:]:
            if inside is not None:
                break
            stack[inner[-1]][3][tag] -= 1
        del stack[depth:]

    def read(text: str) -> None:
        nonlocal linked
        if text and stack[-1][2]:
            text = html.unescape(text)
            held.append(text)
            if links:
                linked += len(text)

    while at < end:
        m = TAG.search(page, at, end)
        if m is None:
            read(page[at:end])
            break
        read(page[at:m.start()])
        at = m.end()
        if m[2] is None:
            if at == end and m[0].startswith("<!--") and not m[0].endswith("-->"):
                at = len(page)
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in ("html", "body") or not opened[tag] or tag not in BLOCKS and not stack[inner[-1]][3].get(tag):
                continue
            depth = len(stack) - 1
            while stack[depth][0] != tag:
                depth -= 1
            close(depth)
            continue
        if tag in RAW:
            found = re.compile(f"</{tag}(?=[\\s/>])[^>]*>?", re.IGNORECASE).search(page, at)
            at = found.end() if found else len(page)
            continue
        shown = stack[-1][2]
        if tag in SPACE and shown:
            held.append(" ")
        if tag in BLOCKS:
            if stack[inner[-1]][0] == "p":
                close(inner[-1])
            ended, until = ENDS.get(tag, ((), ()))
            if any(opened[t] for t in ended):
                for i in range(len(inner) - 1, 0, -1):
                    if stack[inner[i]][0] in ended:
                        close(inner[i])
                        break
                    if stack[inner[i]][0] in until:
                        break
            flush()
        if tag in VOID:
            continue
        attributes = _attributes(m[3])
        above = stack[-1][1]
        shown = stack[-1][2] and not _unshown(tag, attributes)
        if tag in BLOCKS:
            inner.append(len(stack))
            stack.append((tag, paths.below(above, tag, attributes) if shown else above, shown, {}))
        else:  # what is named as chrome inside a line has no path to vote on
            inside = stack[inner[-1]][3]
            inside[tag] = inside.get(tag, 0) + 1
            shown = shown and (not attributes or _named_as(attributes) != CHROME_NAMED and not _has_role(attributes))
            stack.append((tag, above, shown, None))
        opened[tag] += 1
        links += tag == "a"
    tail = page[max(at, end):]
    if tail:
        unfinished = UNFINISHED.search(tail)
        read(tail[:unfinished.start()] if unfinished else tail)
    flush()
    return Page(paths.list, out)


class Scores(NamedTuple):
    """Of every container of a page that has text: its text less what is in links, and its score, with the names' factor."""

    net: dict[int, int]
    score: dict[int, float]
    main: int  # the fullest one that may be an article, or -1


def scores_of(page: Page) -> Scores:
    net: dict[int, int] = {}
    for block in page.blocks:
        net[block.container] = net.get(block.container, 0) + max(0, len(block.text) - 2 * block.linked)
    score = {c: n * page.paths[c].factor * FAVOURED.get(page.paths[c].tag, 1.0) for c, n in net.items()}
    return Scores(net, score, _fullest(page, net, score, net))


def _fullest(page: Page, net: dict[int, int], score: dict[int, float], among) -> int:
    able = [c for c in among if score[c] > 0 and (page.paths[c].factor > FACTORS[CHROME_NAMED] or net[c] >= LEAST_NAMED)]
    return max(able, key=lambda c: (score[c], page.paths[c].id), default=-1)


def _above(page: Page, at: int) -> set[int]:
    """A path and all around it."""
    out = set()
    while at >= 0:
        out.add(at)
        at = page.paths[at].parent
    return out


def _opinion(page: Page, scores: Scores, c: int, around: set[int], most: float) -> int:
    """What a page has to say of a container, where `around` are its main one and all that it is in."""
    chrome = page.paths[c].chrome
    if chrome >= 0 and chrome not in around:
        return AGAINST
    return FOR if scores.score[c] > 0 and scores.score[c] >= LEAST_SHARE * most else SMALL


def opinions(page: Page, scores: Scores) -> dict[int, int]:
    """FOR, SMALL or AGAINST of every container of a page that has text."""
    around, most = _above(page, scores.main), scores.score.get(scores.main, 0.0)
    return {c: _opinion(page, scores, c, around, most) for c in scores.net}


def text_within(page: Page, known: dict[int, int] | None) -> str:
    """The blocks of a page's article, one a line.

    `known` tells of path ids what the host decided; of others the page's own opinion counts. The
    fullest of the paths that are kept is the main one: if it lies in an article element, all that
    is in it and not rejected is the article. Else all kept ones are, with what the elements around
    the main one hold themselves, such as a headline. If none is kept, the fullest one that was not
    voted down is, and repetition does not count.
    """
    if not page.blocks:
        return ""
    known, scores, paths = known or {}, scores_of(page), page.paths
    own = opinions(page, scores)
    state = {c: known.get(paths[c].id, s) for c, s in own.items()}
    kept = {c for c, s in state.items() if s == FOR}
    main = _fullest(page, scores.net, scores.score, kept)
    if main < 0:
        state = {c: own[c] if s == REPEATED else s for c, s in state.items()}
        main = _fullest(page, scores.net, scores.score, [c for c, s in state.items() if s != AGAINST])
        if main < 0:
            plain = {c for c, s in state.items() if s != AGAINST and paths[c].chrome < 0}  # all of it is in links
            return "\n".join(b.text for b in page.blocks if b.container in plain)
        kept = {c for c, s in state.items() if s == FOR} | {main}
    around = _above(page, main)
    for c in state:
        if paths[c].id not in known:  # named parts around the main one are not chrome, also where the host has chosen it
            state[c] = _opinion(page, scores, c, around, scores.score[main]) if c not in kept else FOR
    article = paths[main].article
    if article >= 0:
        return "\n".join(b.text for b in page.blocks if paths[b.container].article == article and state[b.container] >= SMALL)
    spread: dict[int, float] = {}
    for c, score in scores.score.items():
        if state[c] >= SMALL:
            spread[c] = spread.get(c, 0.0) + score
            if (up := paths[c].parent) >= 0:
                spread[up] = spread.get(up, 0.0) + score / 2
    best = max(spread, key=lambda c: (spread[c], paths[c].id))
    whole = {c for c in kept if c == main or c not in around}
    if best in around and paths[best].tag not in OUTERMOST:
        whole.add(best)
    inside = [False] * len(paths)
    for at, path in enumerate(paths):
        inside[at] = at in whole or path.parent >= 0 and inside[path.parent]
    taken = {c for c, s in state.items() if s >= SMALL and (
        inside[c] or c in around and (c in kept or paths[c].tag not in OUTERMOST))}
    return "\n".join(b.text for b in page.blocks if b.container in taken)


VOTES = "site long, path long, block long, pages long, votes long, against long, chars long, first long, last long"
#: Sums that a task holds before it sends them on.
MOST_HELD = 100_000


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the votes on each path (block null), and of the characters of each block of it that is not voted against.

    `first` and `last` are the least and greatest digest of the main text of the pages that have the
    block, so they differ where pages of different content share it.
    """
    held: dict[tuple[int, int, int | None], list[int]] = {}

    def flush() -> pa.RecordBatch:
        columns = list(zip(*((*key, *sums) for key, sums in held.items()))) or [()] * 9
        held.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in columns], ["site", "path", "block", "pages", "votes", "against", "chars", "first", "last"])

    for batch in batches:
        for site, data in zip(batch.column("site").to_pylist(), byte_texts(batch.column("html"))):
            page = blocks_of(data.decode(), site)
            scores = scores_of(page)
            told = opinions(page, scores)
            for c, opinion in told.items():
                sums = held.setdefault((site, page.paths[c].id, None), [0, 0, 0, 0, None, None])
                sums[0] += 1
                sums[1] += opinion == FOR
                sums[2] += opinion == AGAINST
            content = _hash("\n".join(b.text for b in page.blocks if b.container == scores.main).encode())
            for block in page.blocks:
                if told[block.container] != AGAINST:
                    sums = held.setdefault(
                        (site, page.paths[block.container].id, _hash(block.text.encode())), [0, 0, 0, 0, content, content])
                    sums[3] += len(block.text)
                    sums[4], sums[5] = min(sums[4], content), max(sums[5], content)
            if len(held) >= MOST_HELD:
                yield flush()
    yield flush()


def host_decisions(pages: DataFrame) -> DataFrame:
    """(site, path, state) of the paths of `pages` (site, html) whose host decides otherwise than some of its pages.

    A path is AGAINST if more than half of the pages that have it say so, REPEATED if half of its text
    or more is in blocks that pages of different content share, FOR if half of the pages say so, else
    SMALL. What all pages say, and repetition does not change, need not be told to them.
    """
    blocks = pages.transform(in_arrow, _votes, VOTES).groupBy("site", "path", "block").agg(
        *(F.sum(c).alias(c) for c in ("pages", "votes", "against", "chars")), F.min("first").alias("first"), F.max("last").alias("last"))
    paths = blocks.groupBy("site", "path").agg(
        *(F.sum(c).alias(c) for c in ("pages", "votes", "against", "chars")),
        F.sum(F.when(F.col("first") < F.col("last"), F.col("chars")).otherwise(0)).alias("shared"))
    down = 2 * F.col("against") > F.col("pages")
    repeated = ~down & (F.col("shared") > 0) & (2 * F.col("shared") >= F.col("chars"))
    state = F.when(down, AGAINST).when(repeated, REPEATED).when(2 * F.col("votes") >= F.col("pages"), FOR).otherwise(SMALL)
    agreed = F.greatest("votes", "against", F.col("pages") - F.col("votes") - F.col("against")) == F.col("pages")
    return paths.filter(repeated | ~agreed).select("site", "path", state.cast("byte").alias("state"))


class Decisions(NamedTuple):
    """Path ids in order and what was decided of each."""

    paths: np.ndarray
    states: np.ndarray

    def of(self, page: Page) -> dict[int, int]:
        """What was decided of the paths of a page."""
        ids = np.array([page.paths[c].id for c in {b.container for b in page.blocks}], np.int64)
        if not len(ids) or not len(self.paths):
            return {}
        at = np.minimum(np.searchsorted(self.paths, ids), len(self.paths) - 1)
        found = self.paths[at] == ids
        return dict(zip(ids[found].tolist(), self.states[at[found]].tolist()))


OUT = ["page_id", "url", "text", "n_chars"]


def _texts_by(sent):
    """Texts of pages, where the decisions of all hosts are at hand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decisions = Decisions(*sent.value)
        for batch in batches:
            texts = []
            for site, data in zip(batch.column("site").to_pylist(), byte_texts(batch.column("html"))):
                page = blocks_of(data.decode(), site)
                texts.append(text_within(page, decisions.of(page)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], OUT)

    return run


def _texts_after(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of pages that come host by host, after the decisions (rows with a path) of their host."""
    now, known = None, {}
    for batch in batches:
        places, texts = [], []
        sites, paths, states = (batch.column(c).to_pylist() for c in ("site", "path", "state"))
        for i, data in enumerate(byte_texts(batch.column("html"))):
            if sites[i] != now:
                now, known = sites[i], {}
            if paths[i] is not None:
                known[paths[i]] = states[i]
                continue
            places.append(i)
            texts.append(text_within(blocks_of(data.decode(), now), known))
        took = pa.array(places, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id").take(took), batch.column("url").take(took), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], OUT)


#: Bytes of decisions up to which all are sent to every task; above, pages and decisions meet by host, so many pages of a host in a task.
MOST_BROADCAST = 32 << 20
DECISION_BYTES = 9
PAGES_A_TASK = 50_000


def _by_host(read: DataFrame, decisions: DataFrame) -> DataFrame:
    """Pages and their hosts' decisions, brought together by host; a host of many pages is dealt to several tasks."""
    crowded = sent_if_small(
        read.groupBy("site").count().filter(F.col("count") > PAGES_A_TASK)
        .select(F.col("site").alias("of"), F.ceil(F.col("count") / PAGES_A_TASK).cast("int").alias("shares")), DECISION_BYTES)
    shares = F.coalesce("shares", F.lit(1))
    pages = read.join(crowded, F.col("site") == F.col("of"), "left").select(
        "site", F.pmod(F.xxhash64("html", "url"), shares).cast("int").alias("share"), F.lit(None).cast("long").alias("path"),
        F.lit(None).cast("int").alias("state"), "page_id", "url", "html")
    told = decisions.join(crowded, F.col("site") == F.col("of"), "left").select(
        "site", F.explode(F.sequence(F.lit(0), shares - 1)).alias("share"), "path", F.col("state").cast("int").alias("state"),
        F.lit(None).cast(read.schema["page_id"].dataType).alias("page_id"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"))
    tasks = max(width(read.sparkSession), -(-read.count() // PAGES_A_TASK))
    return pages.unionByName(told).repartition(tasks, "site", "share").sortWithinPartitions("site", F.col("path").isNull())


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text (of the article, a block a line), n_chars (its code points).

    Null html is empty and gives an empty text, an empty table gives no rows. Pages without a url, or
    whose url has no host, vote together. Rows may repeat; pages of equal content count as one where
    repetition is told. Ids may be null. Extra columns are ignored.
    """
    host = F.regexp_extract(F.lower(F.coalesce(named(url_col), F.lit(""))), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)
    read = pages.select(
        named(id_col).alias("page_id"), named(url_col).cast("string").alias("url"), F.coalesce(named(html_col), F.lit("")).alias("html"),
        F.xxhash64(host).alias("site"))
    decisions = settled(host_decisions(read.select("site", "html")))
    out = f"page_id {read.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long"
    if decisions.count() * DECISION_BYTES > MOST_BROADCAST:
        return _by_host(read, decisions).transform(in_arrow, _texts_after, out)
    told = decisions.select("path", "state").toArrow().sort_by("path")
    sent = pages.sparkSession.sparkContext.broadcast((told.column("path").to_numpy(), told.column("state").to_numpy()))
    return read.select("page_id", "url", "site", "html").transform(in_arrow, _texts_by(sent), out)
