"""Main text of web pages from text-to-tag ratios.

The standard library's parser streams events. Text is gathered in lines, one
for each block element's run of text, together with the tags met in it. A
line's ratio is its text outside of links over its tags, weighed where a name
speaks of menus, notices, comments and the like: an element's tag, or a whole
word of its class, id or role, weighs it MARKED times as much, a part of such a
word only HINTED times. A hint counts for nothing where its element holds most
of the page's text, inside `article` or `main`, or where a cluster is in it.
Ratios are smoothed with a Gaussian over neighbouring lines of the same part,
and lines above a threshold, the standard deviation of the smoothed ratios,
form the clusters of content. Where nothing unmarked stands out, the word that
marks most text is taken back, so a page whose wrapper has such a name keeps
its text. Sibling items of one form outside of `article` elements that begin
with a short line with a link or number, as comments do under any name, are
marked too. The content region is the innermost element that
holds all clusters and outside of which there are only links, teasers (parts
with links and no cluster) and marked lines. All its lines, short ones too, are
the main text, but for marked ones in no cluster.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.session import table

#: Standard deviation of the Gaussian in lines, and how far it reaches.
SIGMA, REACH = 1.0, 3
#: Weight of the ratio of lines in marked parts, and where only a part of a word speaks of one.
MARKED, HINTED = 1e-3, 0.3
#: Characters of a comment's first line at most.
BYLINE = 60

BLOCKS = frozenset("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never content.
SILENT = frozenset("head title script style noscript template iframe object svg math canvas audio video select option datalist button textarea".split())
#: Elements whose text is marked.
ASIDE = frozenset("nav header footer aside form menu dialog".split())
#: Elements whose end tag may be missing, and what ends them.
CLOSES = {"p": frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
#: Elements that a missing end tag inside them cannot outlive.
REGIONS = frozenset("article aside body details dialog div dl fieldset figure footer form header html main menu nav ol section table ul".split())
#: Words of class, id and role that mark a part, and those of reader comments.
WORDS = frozenset("ad ads advert adverts advertisement advertising banner banners breadcrumb breadcrumbs consent cookie cookies disclaimer footer gdpr header menu menus modal nav navbar navigation newsletter notice notices notification pagination popup promo promos promotion related share sharing sidebar skip social sponsor sponsored sponsors subscribe subscription toolbar widget widgets complementary contentinfo search alert dialog".split())
COMMENTS = frozenset("comment comments commentlist disqus discussion discussions feedback replies reply responses respond reactions talkback thread".split())
PARTS = re.compile(r"[^\s_-]+")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose start ends another.
ENDERS = frozenset().union(*CLOSES.values())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
SPACE = re.compile(r"\s+")


@dataclass
class Line:
    text: str
    tags: int
    region: int  # the element of REGIONS around it
    mark: int  # the outermost marked element around it that counts, or 0
    plain: int  # characters outside of links
    weight: float = 1.0


class Lines(HTMLParser):
    """Lines of a page. Text and tags of silent parts are left out.

    Open elements are also listed by name for each region, so that what an end
    tag closes is looked up, however many inline elements stay open.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, int, bool]] = []  # tag, region, mark, silent
        self.frames: list[dict[str, list[int]]] = [{}]  # of each open region: places of the open elements in it by name
        self.places: dict[str, list[int]] = {}  # of open regions by name
        self.parents, self.kinds, self.classes, self.headed = [0], [""], [""], [False]
        # Of each mark: the one around it, whether it is only a hint, whether more than a hint is around or in it, whether it may be taken back.
        self.around, self.hint, self.sure, self.word = [0], [True], [False], [False]
        self.lines: list[Line] = []
        self.text: list[str] = []
        self.tags = self.plain = 0

    def silent(self) -> bool:
        return bool(self.open) and self.open[-1][3]

    def flush(self) -> None:
        text = SPACE.sub(" ", "".join(self.text)).strip()
        if text:
            region, mark = self.open[-1][1:3] if self.open else (0, 0)
            self.lines.append(Line(text, self.tags, region, mark, min(self.plain, len(text))))
            self.tags = 0
        self.text.clear()
        self.plain = 0

    def shut(self, place: int) -> None:
        """Closes all elements from a place of the stack on."""
        while len(self.open) > place:
            name = self.open.pop()[0]
            if name in REGIONS:
                self.frames.pop()
                self.places[name].pop()
            else:
                self.frames[-1][name].pop()

    def named(self, tag: str, attrs: dict[str, str | None]) -> tuple[bool, bool, bool]:
        """Whether an element's name marks it, only hints at it, and whether a word of its class alone does."""
        if tag in ASIDE:
            return True, False, False
        if tag in ("html", "body", "main"):
            return False, False, False
        values = " ".join(attrs.get(a) or "" for a in ("class", "id", "role")).lower()
        words = set(values.split())
        if tag == "article":
            return bool(words & COMMENTS), False, False
        if words & COMMENTS or words & WORDS:
            return True, False, not words & COMMENTS
        return False, any(x in WORDS or x in COMMENTS for x in PARTS.findall(values)), False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.flush()
        self.tags += not self.silent()
        if tag in ENDERS:
            last = max((places[-1] for name, places in self.frames[-1].items() if places and tag in CLOSES.get(name, ())), default=-1)
            if last >= 0:
                self.shut(last)
        if tag in VOID:
            return
        _, region, mark, silent = self.open[-1] if self.open else ("", 0, 0, False)
        values = dict(attrs)
        if tag in HEADINGS:
            self.headed[region] = True
        if not silent:
            silent = tag in SILENT or "hidden" in values or values.get("aria-hidden") == "true" or bool(HIDDEN.search(values.get("style") or ""))
            if tag in ("article", "main") and not self.sure[mark]:
                mark = 0
            sure, hint, word = self.named(tag, values)
            if sure or hint:
                self.around.append(mark)
                self.hint.append(not sure)
                self.sure.append(sure or self.sure[mark])
                self.word.append(word)
                mark = len(self.around) - 1
        if tag in REGIONS:
            self.parents.append(region)
            self.kinds.append(tag)
            self.classes.append(values.get("class") or "")
            self.headed.append(False)
            region = len(self.parents) - 1
            self.places.setdefault(tag, []).append(len(self.open))
            self.frames.append({})
        else:
            self.frames[-1].setdefault(tag, []).append(len(self.open))
        self.open.append((tag, region, mark, silent))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        self.tags += not self.silent()
        places = (self.places if tag in REGIONS else self.frames[-1]).get(tag)
        if places:
            self.shut(places[-1])

    def handle_data(self, data: str) -> None:
        if not self.silent():
            self.text.append(data)
            if not data.isspace() and not self.frames[-1].get("a"):  # no anchor is open in the innermost region
                self.plain += len(data.strip())

    def weigh(self, void: set[int]) -> None:
        """Sets the mark and weight of each line; void: marks that count for nothing."""
        n = len(self.around)
        outer, sure = [0] * n, [False] * n
        for m in range(1, n):
            up = self.around[m]
            on = m not in void
            outer[m] = outer[up] or (m if on else 0)
            sure[m] = sure[up] or on and not self.hint[m]
        for x, m in zip(self.lines, self.innermost, strict=True):
            x.mark = outer[m]
            x.weight = 1.0 if not x.mark else MARKED if sure[m] else HINTED

    def settle(self) -> set[int]:
        """Marks all lines; returns the hints that hold most of the page's unlinked text and count for nothing."""
        self.innermost = [x.mark for x in self.lines]
        self.held = [0] * len(self.around)
        for x in self.lines:
            self.held[x.mark] += x.plain
        for m in range(len(self.around) - 1, 0, -1):
            self.held[self.around[m]] += self.held[m]
        void = {m for m in range(1, len(self.around)) if self.hint[m] and 2 * self.held[m] > self.held[0]}
        self.weigh(void)
        return void


def smoothed(ratios: np.ndarray, sigma: float = SIGMA, reach: int = REACH) -> np.ndarray:
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(ratios, kernel / kernel.sum())[reach : reach + len(ratios)]


def clusters(lines: list[Line], parents: list[int]) -> np.ndarray:
    """Which lines are above the threshold; a line's neighbours are those of its part of the page."""
    ratios = np.asarray([x.plain / max(1, x.tags) * x.weight for x in lines])
    part = np.zeros(len(lines), int)
    for k in range(1, len(lines)):
        a, b = lines[k - 1], lines[k]
        part[k] = part[k - 1] + (a.mark != b.mark or not (_inside(parents, a.region, b.region) or _inside(parents, b.region, a.region)))
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(lines)]
    ratios = np.concatenate([smoothed(ratios[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)])
    return ratios > ratios.std() if len(lines) > 2 else ratios > 0


def items(parser: Lines) -> None:
    """Marks sibling items of one form that begin with a short line with a link or number and have no heading, as comments do; none inside `article` elements."""
    lines, parents = parser.lines, parser.parents
    n = len(parents)
    first, count, headed = [len(lines)] * n, [0] * n, parser.headed[:]
    for k, x in enumerate(lines):
        first[x.region] = min(first[x.region], k)
        count[x.region] += 1
    for k in range(n - 1, 0, -1):
        up = parents[k]
        first[up], count[up], headed[up] = min(first[up], first[k]), count[up] + count[k], headed[up] or headed[k]
    forms: dict[tuple[int, str, str], list[int]] = {}
    home = [False] * n
    for k in range(1, n):
        home[k] = home[parents[k]] or parser.kinds[k] == "article"
        if parser.classes[k] and count[k] and not home[k]:
            forms.setdefault((parents[k], parser.kinds[k], parser.classes[k]), []).append(k)

    def comment(k: int) -> bool:
        x = lines[first[k]]
        return not headed[k] and count[k] > 1 and len(x.text) <= BYLINE and (x.plain < len(x.text) or any(c.isdigit() for c in x.text))

    said = [False] * n
    for like in forms.values():
        if len(like) > 1 and all(map(comment, like)):
            for k in like:
                said[k] = True
    for k in range(1, n):
        said[k] |= said[parents[k]]
    if any(said) and not all(said[x.region] or x.mark for x in lines):
        for x in lines:
            if said[x.region]:
                x.mark, x.weight = x.mark or len(parser.around), MARKED


def main_text(html: str | None) -> str:
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    if re.match(r"<[/a-zA-Z!?]", parser.rawdata):  # a tag or comment that the page ends in
        parser.rawdata = ""
    parser.close()
    parser.flush()
    lines, parents = parser.lines, parser.parents
    if not lines:
        return ""
    void = parser.settle()
    items(parser)
    content = clusters(lines, parents)
    if all(x.mark for x, on in zip(lines, content, strict=True) if on):  # nothing but marked lines stands out
        words = [m for m in range(1, len(parser.around)) if m not in void and (parser.word[m] or parser.hint[m])]
        most = max(words, key=lambda m: (parser.held[m], -m), default=0)
        if most and 2 * parser.held[most] > parser.held[0]:  # the name of a wrapper
            parser.weigh(void := void | {most})
            content = clusters(lines, parents)
        if all(x.mark for x, on in zip(lines, content, strict=True) if on):
            content = np.asarray([not x.mark and x.plain > 0 for x in lines])
    found = {m for m, on in zip(parser.innermost, content, strict=True) if on}
    if hints := {m for m in found if m not in void and parser.hint[m]}:  # hints with a cluster in them
        parser.weigh(void | hints)
    n = len(parents)
    inner: list[list[int]] = [[] for _ in range(n)]
    for k in range(1, n):
        inner[parents[k]].append(k)
    # Of each region with those inside it: lines of clusters, lines that are text, and whether a link is in it.
    held, texts, links = np.zeros(n, int), np.zeros(n, int), np.zeros(n, bool)
    for x, on in zip(lines, content, strict=True):
        held[x.region] += on
        texts[x.region] += x.plain > 0 and (not x.mark or bool(on))
        links[x.region] |= x.plain < len(x.text)
    own = texts.copy()
    for k in range(n - 1, 0, -1):
        held[parents[k]] += held[k]
        texts[parents[k]] += texts[k]
        links[parents[k]] |= links[k]
    best = 0
    while held[best]:
        down = [k for k in inner[best] if held[k] == held[best]]
        if not down or own[best] or any(texts[k] and not links[k] for k in inner[best] if k != down[0]):
            break
        best = down[0]
    loose = {k for k in inner[best] if not held[k] and links[k]} if parser.kinds[best] in ("", "html", "body") else set()  # menus and teasers beside the content
    kept = [False] * n  # regions inside the best one and outside of loose ones; a region's number is above its parent's
    for k in range(best, n):
        kept[k] = k == best or kept[parents[k]] and k not in loose
    keep = [x.text for x, on in zip(lines, content, strict=True) if kept[x.region] and (on or not x.mark)]
    return " ".join(keep)


def _inside(parents: list[int], k: int, m: int) -> bool:
    while k > m:
        k = parents[k]
    return k == m


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) for every page.

    Null and empty html, and html without content, give an empty text. Broken
    markup is read as browsers read it: missing end tags are implied. A narrow
    map over three columns; repeated rows and ids are independent, very long
    pages are read whole, an empty table gives an empty table, and further
    columns, whatever their names, are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                batch = whole.slice(i, 500)
                texts = [main_text(h) for h in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
