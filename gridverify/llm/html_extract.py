"""Main text of pages by consensus of their host.

Each page's containers are scored by the text of the blocks in them that is not
links; the best one is widened to the containers around it whose other text is main
text too, and its path of tags and classes, with numbers generalised, is the page's
vote. Per host the path with most votes wins, and the pages are extracted
again from the containers on that path. A page without text on it uses its own
best container.

Edge cases: a null or empty page has empty text; pages without markup are one
block; unclosed, unopened and wrongly nested tags are closed where a parent ends;
a null or odd url has the empty host. Repeated rows are separate pages. Markup
ends at any depth, and text of any length is kept whole. A page of any markup, such as tags
without an end or a hundred thousand nested elements, takes time and memory in proportion to it. What classes, ids and roles
leave out comes back where it is most of the page's text and has a first heading, an
article or main element, discussions aside, or where nothing else is left.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import defaultdict
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridverify.llm.common import free_names, small_batches, staged

#: Winning paths of up to so many hosts are broadcast; beyond, pages meet them by a salted join.
BROADCAST_HOSTS, SALTS = 50_000, 32

#: What begins markup; the same with the attributes of tags up to the first > outside of quotes; what decides that.
START = r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*+)"
MARKUP = re.compile(START + ")")
WHOLE_TAG = re.compile(START + r"""(?:((?:[^'">]++|"[^"]*"|'[^']*')*+)>)?)""")
QUOTES = re.compile("""["'>]""")
#: Decimal references of any length, which Python's own decoding limits.
NUMBER = re.compile(r"&#(?=[0-9])0*+([0-9]*+);?")
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp".split())
HEAD = frozenset("base link meta noscript script style template title".split())
#: Elements that never hold main text.
LEFT_OUT = frozenset(
    "aside audio button canvas dialog footer form head header iframe menu nav noscript object script select style svg template textarea title video".split()
)
#: Words of which classes, ids and roles of such elements consist, with or without those of PLAIN_WORDS.
LEFT_OUT_WORDS = frozenset(
    "ad ads advert advertisement adverts aside banner breadcrumb breadcrumbs comment comments consent cookie cookies discussion disqus footer header login masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo promoted recommended related replies respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
PLAIN_WORDS = frozenset(
    "area areas bar block body bottom box boxes btn button buttons col column container content desktop entries entry footer form global group header icons inline inner item items js left link links list main mobile outer page panel post posts primary right secondary section site slot thread title top unit wp wrap wrapper".split()
)
#: Words of discussions, which may be longer than the text that they are about.
DISCUSSION_WORDS = frozenset("comment comments discussion disqus replies respond".split())
BLOCK = frozenset(
    "address article blockquote body caption center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINER = frozenset("article center div main section td".split())
#: Start tags that end an open element of the second kind.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("article div dl main ol section table td th ul".split())
ROW_SCOPE = SCOPE - {"td", "th"}


def named_words(attributes: list[tuple[str, str]]) -> set[str]:
    """Of the whole names among classes, ids and roles that leave an element out, the words."""
    found = set()
    for _, value in attributes:
        for name in value.lower().split():
            words = {w for w in re.split(r"[^a-z]+", name) if w}
            if words & LEFT_OUT_WORDS and words <= LEFT_OUT_WORDS | PLAIN_WORDS:
                found |= words & LEFT_OUT_WORDS
    return found


class Ends:
    """Where the tags of a page end: at the first > outside of quotes, or the first one if quotes leave none."""

    def __init__(self, source: str):
        self.source = source
        marks = [(m.start(), m[0]) for m in QUOTES.finditer(source)]
        self.marks = [at for at, _ in marks]
        # Of each mark: the end of a tag whose first mark it is, -1 if there is none.
        self.ends = [-1] * (len(marks) + 1)
        after = {}
        for k in range(len(marks) - 1, -1, -1):
            at, mark = marks[k]
            if mark == ">":
                self.ends[k] = at
            else:
                self.ends[k] = self.ends[after[mark] + 1] if mark in after else -1
                after[mark] = k

    def find(self, start: int) -> int:
        """Place of the > that ends a tag whose attributes start here, or -1."""
        end = self.ends[bisect_left(self.marks, start)]
        return end if end >= 0 else self.source.find(">", start)


def decoded(piece: str) -> str:
    """The text with character references decoded; numbers beyond Unicode are U+FFFD, however long."""
    if "&" not in piece:
        return piece
    try:
        return html.unescape(piece)
    except ValueError:
        return html.unescape(NUMBER.sub(lambda m: f"&#{m[1] or 0};" if len(m[1]) < 8 else "\ufffd", piece))


class Page:
    """Blocks of text in page order, and containers as (path, score, first block, end block, number of the one around it, name).

    A path is a number: that of the path around it and a label make another. Time and memory are in
    proportion to the page, whatever its markup.
    """

    def __init__(self, source: str):
        self._read(source)
        most = {k for k, (size, talk, article) in enumerate(self.named) if 2 * size > self.size and article and not talk}
        if most:
            self._read(source, most.__contains__)
        if not self.blocks and self.named:
            self._read(source, lambda k: True)

    def _read(self, source: str, shown=lambda k: False) -> None:
        """Read the page; shown says which of the elements that are left out by name are not."""
        self.shown = shown
        # Elements that are left out by name: size of the text that is no link, whether a discussion, whether they
        # hold a first heading, article or main element. While open, what size and heads were at their start.
        self.named: list[list] = []
        self.size = self.heads = self.never = 0
        self.blocks: list[str] = []
        self.block_links: list[int] = []
        # Paths by number: the one around, and its last label.
        self.paths: list[tuple[int, str]] = [(-1, "")]
        self.path_numbers: dict[tuple[int, str], int] = {}
        self.containers: list[list] = [[0, 0, 0, 0, -1, ""]]
        # Open elements: name, whether left out, whether a link, number of its container or 0, path,
        # whether left out by that name, place among those left out by class, id or role or -1.
        self.open: list[tuple] = []
        # Of each name the places of its open elements, and the open containers.
        self.places: dict[str, list[int]] = defaultdict(list)
        self.within: list[int] = []
        self.pieces: list[str] = []
        self.hidden = self.links = self.link_size = 0
        # A pattern finds the ends of tags, until quotes leave one without: then all are tabled, as each
        # such tag would have the rest of the page read.
        ends, tag, at, look = None, WHOLE_TAG, 0, 0
        while m := tag.search(source, look):
            if ends is None and m[4] and m[5] is None:
                ends, tag = Ends(source), MARKUP
                continue
            if m[4]:
                end = m.end() - 1 if ends is None else ends.find(m.end())
            elif m[2]:
                end = source.find(">", m.end())
            else:
                end = source.find("-->", m.end())
                end = end + 2 if end >= 0 else len(source)
            if end < 0:
                # Without a > only a comment is markup, and takes the rest.
                look = source.find("<!--", m.start())
                if look < 0:
                    break
                continue
            if m.start() > at:
                self._text(source[at : m.start()])
            at = look = end + 1
            if not m[4]:
                continue
            name = m[4].lower()
            if m[3]:
                self._close(name)
                continue
            attributes = m[5] if ends is None else source[m.end() : end]
            self._start(name, attributes)
            if name in RAW and not attributes.endswith("/"):
                raw_end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(source, at)
                at = look = raw_end.end() if raw_end else len(source)
                self._close(name)
        if at < len(source):
            self._text(source[at:])
        while self.open:
            self._pop()
        self._block()
        self.containers[0][3] = len(self.blocks)

    def _text(self, raw: str) -> None:
        if not self.never and not self.links:
            self.size += len(raw.strip())
        if not self.hidden:
            self.pieces.append(raw)
            if self.links:
                self.link_size += len(raw.strip())

    def _block(self) -> None:
        """End the block of text collected so far."""
        if self.pieces:
            # References are decoded piece by piece: one can't go across a tag.
            text = " ".join("".join(map(decoded, self.pieces)).split())
            if text:
                self.blocks.append(text)
                self.block_links.append(min(len(text), self.link_size))
                score = max(0, len(text) - 2 * self.link_size)
                # In full for the nearest container, half and a quarter for those around it.
                for number, part in zip([*self.within[:-4:-1], 0], (1, 2, 4)):
                    self.containers[number][1] += score // part
            self.pieces, self.link_size = [], 0

    def _start(self, name: str, attributes: str) -> None:
        if name == "br" or name in VOID:
            if name == "hr":
                self._block()
            elif not self.hidden and name == "br":
                self.pieces.append(" ")
            return
        if name not in HEAD and self.open and self.open[-1][0] == "head":
            self._pop()
        if name in BLOCK:
            self._block()
            self._end({"p"}, name)
        if name in ENDS:
            self._end(ENDS[name], name)
        if name in ("article", "main") and self.places["nav"]:
            self._close("nav")
        words = [(m[1].lower(), m[2] or m[3] or m[4] or "") for m in NAMED.finditer(attributes)] if "=" in attributes else []
        out, never, inside = name in LEFT_OUT, name in LEFT_OUT, -1
        if not out and name not in ("html", "body", "article", "main") and (left_out := named_words(words)):
            inside = len(self.named)
            out = not self.shown(inside)
            self.named.append([self.size, bool(left_out & DISCUSSION_WORDS), self.heads])
        self.heads += name in ("article", "h1", "main")
        path, number = self.open[-1][4] if self.open else 0, 0
        if name in CONTAINER and not self.hidden and not out:
            kind = next((v.split() for k, v in words if k == "class" and v.split()), None)
            label = name + (f".{re.sub(r'[0-9]+', '0', kind[0])}" if kind else "")
            path = self._path(path, label.replace(">", "0"))
            number = len(self.containers)
            around = self.within[-1] if self.within else 0
            self.containers.append([path, 0, len(self.blocks), 0, around, name])
            self.within.append(number)
        self.places[name].append(len(self.open))
        self.open.append((name, out, name == "a", number, path, never, inside))
        self.hidden += out
        self.never += never
        self.links += name == "a"

    def _path(self, around: int, label: str) -> int:
        number = self.path_numbers.setdefault((around, label), len(self.paths))
        if number == len(self.paths):
            self.paths.append((around, label))
        return number

    def _last(self, names) -> int:
        """Place of the innermost open element of these names, or -1."""
        last = -1
        for name in names:
            if (found := self.places.get(name)) and found[-1] > last:
                last = found[-1]
        return last

    def _end(self, names: set[str], by: str) -> None:
        """Close the innermost of these elements, if it is open in the same list, table or section."""
        k = self._last(names)
        if k >= 0 and (k == len(self.open) - 1 or k >= self._last(ROW_SCOPE if by == "tr" else SCOPE)):
            while len(self.open) > k:
                self._pop()

    def _close(self, name: str) -> None:
        if found := self.places.get(name):
            k = found[-1]
            while len(self.open) > k:
                self._pop()
        elif name in BLOCK:
            self._block()

    def _pop(self) -> None:
        name, out, link, number, _, never, inside = self.open[-1]
        if name in BLOCK:
            self._block()
        self.open.pop()
        self.places[name].pop()
        self.hidden -= out
        self.never -= never
        if inside >= 0:
            found = self.named[inside]
            found[0], found[2] = self.size - found[0], self.heads > found[2]
        self.links -= link
        if number:
            self.containers[number][3] = len(self.blocks)
            self.within.pop()

    def best(self) -> list:
        """The container with the highest score, the first of equals, widened to those around it with more main text.

        Its path, score, first block and end block. That text is what is beside it, at most a third of it
        links. From within an article or main element only to such elements.
        """
        found = max(self.containers, key=lambda c: c[1])
        around, number = [], found[4]
        while number >= 0:
            around.append(self.containers[number])
            number = around[-1][4]
        if any(c[5] in ("article", "main") for c in [found, *around]):
            around = [c for c in around if c[5] in ("article", "main")]
        sizes = [0, *accumulate(map(len, self.blocks))]
        links = [0, *accumulate(self.block_links)]

        def beside(c: list, of: list[int]) -> int:
            return of[found[2]] - of[c[2]] + of[c[3]] - of[found[3]]

        wide = next((c for c in reversed(around) if 0 < beside(c, sizes) >= 3 * beside(c, links)), found)
        return [self.path_text(wide[0]), found[1], *wide[2:]]

    def path_text(self, number: int) -> str:
        labels = []
        while number:
            number, label = self.paths[number]
            labels.append(f">{label}")
        return "".join(reversed(labels))

    def text(self, path: str | None) -> str:
        """Text of the containers on the path, or of the best one if there is none."""
        number = None if path is None else 0
        for label in (path or "").split(">")[1:]:
            number = self.path_numbers.get((number, label))
        spans = [(c[2], c[3]) for c in self.containers if c[0] == number and c[3] > c[2]]
        if not spans:
            spans = [tuple(self.best()[2:4])]
        out, at = [], 0
        for a, b in sorted(spans):
            out += self.blocks[max(a, at) : b]
            at = max(at, b)
        return "\n".join(out)


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit("")))


def _votes(batches):
    for batch in batches:
        best = [Page(t or "").best() for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([b[0] for b in best], pa.string()), pa.array([b[1] for b in best], pa.int64())],
            names=["host", "path", "score"],
        )


def host_paths(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path): of each host the path most pages voted for, the larger score sum and then the later name of equals."""
    small_batches(pages.sparkSession)
    keyed = pages.select(host(F.col(url_col)).alias("host"), F.col(html_col).cast("string").alias("html"))
    votes = keyed.mapInArrow(_votes, "host string, path string, score long").where("score > 0")
    sums = votes.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("score").alias("score"))
    return sums.groupBy("host").agg(F.max(F.struct("n", "score", "path")).alias("best")).select("host", "best.path")


def with_main_text(pages: DataFrame, *, url_col: str = "url", html_col: str = "html", drop_html: bool = True) -> DataFrame:
    """The pages with ``__text``, and without the html unless that is wanted.

    If a column is called so, underscores are added.
    """
    text_name, host_name, path_name, salt_name = free_names(pages.columns, ["__text", "__host", "__path", "__salt"])
    paths = staged(host_paths(pages, url_col=url_col, html_col=html_col), "host-paths")
    rows = pages.withColumn(host_name, host(F.col(url_col)))
    if paths.count() <= BROADCAST_HOSTS:
        joined = rows.join(F.broadcast(paths.toDF(host_name, path_name)), host_name, "left")
    else:
        salts = paths.select(F.col("host").alias(host_name), F.col("path").alias(path_name), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(salt_name))
        salted = rows.withColumn(salt_name, F.pmod(F.xxhash64(url_col, F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"))
        joined = salted.join(salts, [host_name, salt_name], "left")
    ordered = joined.select(*pages.columns, path_name)
    place = pages.columns.index(html_col)
    kept = [i for i in range(len(pages.columns)) if not (drop_html and i == place)]

    def extract(batches):
        for batch in batches:
            texts = [Page(t or "").text(p) for t, p in zip(batch.column(place).to_pylist(), batch.columns[-1].to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in kept), pa.array(texts, pa.string())],
                names=[*(batch.schema.names[i] for i in kept), text_name],
            )

    schema = T.StructType([*(pages.schema[i] for i in kept), T.StructField(text_name, T.StringType())])
    return ordered.mapInArrow(extract, schema)
