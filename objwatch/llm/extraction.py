"""Main text of web pages by equivalence classes of template tokens.

A page is a tree of elements, each with its path of roles (name, class, id) from the top, and texts
in them. Elements and texts are tokens; how often a token is on each page of a host is its
occurrence vector. A token whose vector agrees with that of what it is in, or with that of the page,
is in its class; where vectors part (what is repeated, what only some pages have), another
class begins, nested in the first. Classes are found from counts by host; pages are never gathered.

The classes of a host are its template. Texts in a class are the template's own, if enough different pages
show that; all else is data, in the slots of the template. From the page down, a slot is opened as long as one element of the same class
holds all data of the slot; the last one is the main node, and all of its slots, in each place where it is on the page, are the article, but
for menus, adverts, forms, comments and the like. Names break ties only: where several elements
hold data, an article element among them is taken, or, beside mere paragraphs, an element with a class
like "post"; and a class like "sidebar" leaves an element out unless it holds most of the data around it.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from objwatch.llm.common import cut_lineage, map_batches, table

#: A text is the template's own if, by the rule of succession, the next page has it with this chance, in percent: (on + 1) / (pages + 2),
#: of different pages. All of 2 pages give 75, all of 3 give 80, all of 8 give 90; what two pages share may be the article of both.
CERTAIN = 80
#: Hosts with more than one page in so many of all are hot, and fewer than that; their pages are dealt to SALTS keys.
HOT, SALTS = 1000, 64
#: A token is part of a template from this share of the host's pages on, in percent.
SUPPORT = 5
#: Vectors agree if they do on this share of the pages, in percent. So a page that is cut off changes nothing for the others.
AGREE = 90

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(script|style|noscript|template|svg|iframe|textarea|select|canvas)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^'\"<>]|\"[^\"<]*\"|'[^'<]*')*+)>|<(/?)([a-zA-Z][^\s/<>]*)([^<>]*)>|<[!?][^>]*>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([^\s\"'>/=][^\s/>=]*)(?:\s*=\s*(\"[^\"]*\"?|'[^']*'?|[^\s>]+))?")
NUMBER = re.compile(r"[0-9]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
LEFT_OUT = frozenset("nav footer aside form head button dialog menu input label option datalist fieldset annotation annotation-xml".split())
CONTAINER = frozenset("div section ul ol dl table center span figure details".split())


def _cue(words: str) -> re.Pattern:
    return re.compile(rf"(?:^|[\s_-])(?:{words})(?:$|[\s_-])", re.I)


#: What a class word for something left out may be followed by: "promo-box" holds a promotion, "promo-code" is a code.
HOLDERS = "ads?|area|banner|bar|block|body|bottom|box|break|card|cell|container|content|embed|feed|footer|form|frame|group|head|header|heading|holder|inner|item|label|leaderboard|left|link|list|message|module|notice|outer|overlay|panel|placeholder|popup|rail|right|root|row|section|sidebar|signup|skyscraper|slot|space|stream|text|thread|title|top|unit|widget|wrap|wrapper|zone|[0-9]+(?:x[0-9]+)?"


def _holding(words: str) -> re.Pattern:
    return re.compile(rf"(?:^|[\s_-])(?:{words})(?:[_-]+(?:{HOLDERS}))*(?:--[\w-]+)?(?:$|\s)", re.I)


#: Class words of what is no part of an article: adverts in any element; sponsors, notices about the site and comments in containers.
CUE_AD = _holding("ads?|advert(?:s|isements?|ising)?|sponsored")
CUE_OUT = _holding("sponsors?|cookies?|consent|gdpr|newsletter|promo(?:tion)?s?|comments?|comment-?list|repl(?:y|ies)|respond|disqus")
#: Class words of containers that are left out unless the host's classes show that they hold most of the data.
CUE_WEAK = _cue("nav(?:bar|igation)?|menus?|site-?header|page-?header|masthead|footer|side-?bar|aside|banner|notices?|alert|pop-?up|modal|overlay|subscri(?:be|ption)|sign-?up|login|share|sharing|social|related|recommend(?:ed|ations?)?|discussion|breadcrumbs?|pagination|pager|widget|toolbar|search")
CUE_MAIN = re.compile(r"(?:^|[\s_-])(?:main|article(?:-?body)?|articlebody|content|post(?:-?(?:body|content))?|entry(?:-?content)?|story|body-?text|page-?text|text)(?:$|[\s_-])", re.I)
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
SPECIAL = frozenset("applet article aside blockquote body button caption center colgroup dd details dir dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup html li listing main marquee menu nav ol optgroup option pre search section summary table tbody td tfoot th thead title tr ul".split())
SCOPE = frozenset("applet button caption html marquee table td th".split())
TABLE = frozenset(["html", "table"])


def _ends() -> dict[str, list[tuple[frozenset[str], frozenset[str]]]]:
    """By the name of an opening tag: which open elements it ends, and the elements beyond which it ends none."""
    out: dict[str, list[tuple[frozenset[str], frozenset[str]]]] = defaultdict(list)
    for name in ("dd", "dt"):
        out[name].append((frozenset(["dd", "dt"]), SPECIAL - {"dd", "dt"}))
    out["li"].append((frozenset(["li"]), SPECIAL - {"li"}))
    out["option"].append((frozenset(["option"]), SPECIAL - {"option"}))
    out["optgroup"].append((frozenset(["option", "optgroup"]), SPECIAL - {"option", "optgroup"}))
    cells = frozenset(["td", "th", "caption", "colgroup"])
    for name in ("td", "th"):
        out[name].append((cells, TABLE))
    out["tr"].append((cells | {"tr"}, TABLE))
    for name in ("tbody", "thead", "tfoot", "caption", "colgroup"):
        out[name].append((cells | {"tr", "tbody", "thead", "tfoot"}, TABLE))
    for name in "address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li listing main menu nav ol p pre search section summary table ul".split():
        out[name].append((frozenset(["p"]), SCOPE))
    return dict(out)


ENDS = _ends()
ROLE_OUT = frozenset("navigation banner contentinfo complementary search form alert dialog menu".split())


WEAK, CLASS_NAMED, TAG_NAMED, HOLDS = 1, 2, 4, 8  # flags of an element


class Element:
    """An opened element of a page; key is its role: name, class, id. It ends at end. path is that of the roles from the top, up that of its parent."""

    __slots__ = ("end", "flags", "key", "name", "open", "out", "parent", "path", "up")

    def __init__(self, name: str, attributes: str, at: int, parent: Element | None = None, number: int = -1):
        self.name, self.open, self.end, self.parent = name, at, -1, number
        self.key, self.out = name, name in LEFT_OUT or name == "header" and not (parent and parent.flags & TAG_NAMED)
        self.flags = HOLDS * (name in CONTAINER) | TAG_NAMED * (name in ("article", "main") or bool(parent and parent.flags & TAG_NAMED))
        if attributes and not attributes.isspace():
            found: dict[str, str] = {}  # every value is read to its end, so that none is taken for a name; the first of a name counts
            for k, v in ATTRIBUTE.findall(attributes):
                found.setdefault(k.lower(), v.strip("\"'"))
            cues = f"{found.get('class', '')} {found.get('id', '')}"
            role = found.get("role", "").lower()
            self.key = f"{name} {found.get('class', '')} #{found.get('id', '')}"
            self.out |= role in ROLE_OUT or "hidden" in found or found.get("aria-hidden") == "true"
            if name not in ("article", "main", "body", "html"):
                self.out |= bool(CUE_AD.search(cues)) or name in CONTAINER and bool(CUE_OUT.search(cues))
                self.flags |= WEAK * (name in CONTAINER and bool(CUE_WEAK.search(cues)))
            self.flags |= TAG_NAMED * (role == "main" or found.get("itemprop", "").lower() == "articlebody")
            self.flags |= CLASS_NAMED * (bool(CUE_MAIN.search(cues)) and name in ("div", "section", "td"))
        self.up = parent.path if parent else 0
        self.path = xxhash.xxh3_64_intdigest(f"{self.up} {NUMBER.sub('0', self.key)}") >> 1 or 1


def text_token(path: int, text: str) -> int:
    """The token of a text in an element with this path; those of texts are negative, those of elements positive, and 0 is the page."""
    return -(xxhash.xxh3_64_intdigest(f"{path}#{text}") >> 1 or 1)


class Page:
    """A page as a tree: elements with their places, and texts between tags."""

    def __init__(self, source: str | None):
        source = source or ""
        self.elements: list[Element] = []
        self.texts: list[tuple[int, str, int]] = []  # place, raw text, number of the element
        self.breaks: list[int] = []  # places where a block begins or ends
        self.spaces: list[int] = []
        stack: list[Element] = []
        numbers: list[int] = []
        opened: Counter = Counter()

        def ended(upto: int, place: int) -> None:
            """End the elements from number upto of the stack on."""
            while len(stack) > upto:
                e = stack.pop()
                numbers.pop()
                opened[e.name] -= 1
                e.end = place

        def innermost(name: str) -> int:
            return next(i for i in range(len(stack) - 1, -1, -1) if stack[i].name == name)

        def texted(text: str, place: int) -> None:
            if stack and stack[-1].name == "head" and not text.isspace():
                ended(len(stack) - 1, place)
            self.texts.append((place, text, numbers[-1] if numbers else -1))

        place = last = 0
        for m in TOKEN.finditer(source):
            if m.start() > last:
                texted(source[last : m.start()], place)
                place += 1
            last = m.end()
            name = m[3] or m[6]
            if not name:
                continue
            name = name.lower()
            if name in BLOCK:
                self.breaks.append(place)
            elif name == "br":
                self.spaces.append(place)
            if not (m[2] or m[5]) and opened["head"] and name not in IN_HEAD:
                ended(innermost("head"), place)
            if name in VOID:
                for targets, barrier in ENDS.get(name, ()):
                    self._imply(stack, opened, targets, barrier, ended, place)
                continue
            if not (m[2] or m[5]):
                for targets, barrier in ENDS.get(name, ()):
                    self._imply(stack, opened, targets, barrier, ended, place)
                e = Element(name, m[4] or m[7] or "", place, stack[-1] if stack else None, numbers[-1] if numbers else -1)
                if not (m[4] or m[7] or "").endswith("/"):
                    stack.append(e)
                    numbers.append(len(self.elements))
                    opened[name] += 1
                else:
                    e.end = place
                self.elements.append(e)
            elif opened[name]:
                ended(innermost(name), place)
            place += 1
        if last < len(source):
            texted(source[last:], place)
            place += 1
        ended(0, place)
        self.end = place

    @staticmethod
    def _imply(stack: list[Element], opened: Counter, targets: frozenset[str], barrier: frozenset[str], ended: Callable[..., None], place: int) -> None:
        """End the outermost of the targets that no element of barrier is in between."""
        if not any(opened[t] for t in targets):
            return
        found = -1
        for i in range(len(stack) - 1, -1, -1):
            if stack[i].name in targets:
                found = i
            elif stack[i].name in barrier:
                break
        if found >= 0:
            ended(found, place)

    def tokens(self) -> dict[int, list[int]]:
        """Of each token but what is left out: [up, flags, 1, whether its count agrees with that of what it is in, or with the page's, characters].

        The characters of an element are those of all texts in it.
        """
        gone = self._gone(None)
        count: Counter = Counter(e.path for e in self.elements if not gone[e.open])
        chars = [0] * len(self.elements)
        found: dict[int, list[int]] = {}
        total = 0
        for place, raw, number in self.texts:
            text = " ".join(raw.split())
            if text and not gone[place]:
                up = self.elements[number].path if number >= 0 else 0
                x = found.setdefault(text_token(up, text), [up, 0, 0, 0, 0])
                x[2] += 1
                x[4] += len(text)
                total += len(text)
                if number >= 0:
                    chars[number] += len(text)
        for x in found.values():
            x[3], x[2] = int(x[2] in (1, count[x[0]])), 1
        for i in range(len(self.elements) - 1, -1, -1):
            e = self.elements[i]
            if e.parent >= 0:
                chars[e.parent] += chars[i]
            if not gone[e.open]:
                x = found.setdefault(e.path, [e.up, e.flags, 1, int(count[e.path] == (count[e.up] if e.up else 1)), 0])
                x[4] += chars[i]
        found[0] = [0, 0, 1, 1, total]
        return found

    def content(self) -> int:
        """A number for all texts of the page: copies have the same."""
        return xxhash.xxh3_64_intdigest("\n".join(k for _, t, _ in self.texts if (k := " ".join(t.split())))) >> 1

    def _gone(self, major: frozenset[int] | None) -> bytearray:
        """Places of what is left out; major: weak elements that are not. None keeps all weak ones."""
        gone = bytearray(self.end + 1)
        upto = 0
        for e in self.elements:
            if e.open >= upto and (e.out or major is not None and e.flags & WEAK and e.path not in major):
                gone[e.open : e.end] = b"\1" * (e.end - e.open)
                upto = e.end
        return gone

    def main_text(self, template: Template) -> str:
        """The article's blocks, by the host's template; by the page's own one if the page has no main node of the host's."""
        if not self.texts:
            return ""
        gone = self._gone(template.major)
        inside = b"\1" * (self.end + 1)
        if template.main:
            nodes = [e for e in self.elements if e.path == template.main and not gone[e.open]]
            if not nodes:
                return "" if template.alone else self.main_text(deduce(self.tokens(), 1, 1, 100, alone=True))
            inside = bytearray(self.end + 1)
            for e in nodes:
                inside[e.open : e.end] = b"\1" * (e.end - e.open)
        kept = [(p, t) for p, t, n in self.texts if inside[p] and not gone[p] and (template.whole or not template.texts or text_token(self.elements[n].path if n >= 0 else 0, " ".join(t.split())) not in template.texts)]
        return self._blocks(kept)

    def _blocks(self, texts: list[tuple[int, str]]) -> str:
        cuts, spaces = self.breaks, set(self.spaces)
        blocks: list[str] = []
        parts: list[str] = []
        k, before = 0, -1
        for p, t in texts:
            moved = False
            while k < len(cuts) and cuts[k] <= p:
                moved |= cuts[k] > before
                k += 1
            if moved and parts:
                blocks.append("".join(parts))
                parts = []
            if spaces and any(s in spaces for s in range(before + 1, p + 1)):
                parts.append(" ")
            parts.append(t)
            before = p
        blocks.append("".join(parts))
        return "\n".join(b for b in (" ".join(html.unescape(x).split()) for x in blocks) if b)


@dataclass(frozen=True)
class Template:
    """main: path of the node whose slots are the article, 0 for the page. whole: its template texts stay, as it is named as an article.
    texts: tokens of the template's texts. major: weak elements that hold data. alone: learned from the page itself."""

    main: int = 0
    whole: bool = False
    texts: frozenset[int] = frozenset()
    major: frozenset[int] = frozenset()
    alone: bool = False


def deduce(tokens: dict[int, list[int]], pages: int, different: int, certain: int = CERTAIN, alone: bool = False) -> Template:
    """The template of a host. tokens: by token, [up, flags, pages, pages on which vectors agree, characters]; different: pages less copies."""
    nodes = {k: v for k, v in tokens.items() if k > 0}
    own: set[int] = set()
    data = {k: v[4] for k, v in nodes.items()} | {0: tokens[0][4]}

    def less(node: int, n: int) -> None:
        while node in nodes:
            data[node] -= n
            node = nodes[node][0]
        data[0] -= n

    for k, (up, _, on, agree, n) in tokens.items():
        of = nodes[up][2] if up in nodes else pages
        # pages with and without the text are counted less copies, in proportion
        if k < 0 and 100 * (on * different + pages) >= certain * (of * different + 2 * pages) and 100 * on >= AGREE * of and 100 * agree >= AGREE * on:
            own.add(k)
            less(up, n)
    below: dict[int, list[int]] = defaultdict(list)
    for k, v in nodes.items():
        below[v[0]].append(k)
    order = [0]  # parents first
    for k in order:
        order += sorted(below[k])
    major: set[int] = set()
    minor: set[int] = set()  # weak elements with little data, and what is in them
    for k in order[1:]:
        up = nodes[k][0]
        if up in minor:
            minor.add(k)
        elif nodes[k][1] & WEAK:
            if data[k] > 0 and 2 * data[k] >= data[up]:
                major.add(k)
            else:
                minor.add(k)
                less(up, data[k])
    slots = lambda k: [c for c in below[k] if c not in minor and data[c] > 0]
    main, flags = 0, 0
    while len(only := slots(main)) == 1 and data[only[0]] == data[main]:
        _, more, on, agree, _ = nodes[only[0]]
        if 2 * on < (nodes[main][2] if main else pages) or 100 * agree < AGREE * on:
            break  # repeated, or on some pages only: a class of its own
        main, flags = only[0], flags | more
    if not flags & TAG_NAMED:
        inside, outer = [main], {TAG_NAMED: [], CLASS_NAMED: []}
        for k in inside:
            for c in slots(k):
                inside.append(c)
                for how in outer:
                    if nodes[c][1] & how and not (nodes[c][0] in nodes and nodes[c][0] != main and nodes[nodes[c][0]][1] & how):
                        outer[how].append(c)
        best = lambda found: max(found, key=lambda k: (data[k], k), default=None)
        tag, named = best(outer[TAG_NAMED]), best(outer[CLASS_NAMED])
        if tag:
            main, flags = tag, nodes[tag][1]
        elif named and not flags & CLASS_NAMED and 2 * data[named] >= data[main]:
            around, k = set(), named
            while k in nodes:
                around.add(k)
                k = nodes[k][0]
            beside = [c for k in around | {main} if k != named for c in slots(k) if c not in around]
            if not any(nodes[c][1] & HOLDS for c in beside if main in (*around, 0)):
                main, flags = named, nodes[named][1]
    return Template(main, bool(flags & (TAG_NAMED | CLASS_NAMED)), frozenset(own), frozenset(major), alone)


def host(url: str = "url") -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/?#]*)", 1)), F.lit(""))


def occurrences(pages: DataFrame) -> DataFrame:
    """(host, token, up, flags, pages, agree, chars): by token, the element that it is in, on how many pages it is, on how many its vector agrees.

    Rows with 0 pages stand for the host's different pages, by their texts, one each. Each task adds up its own
    pages before anything is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[str, int], list[int]] = {}
            for h, source in zip(batch["host"].to_pylist(), batch["html"].to_pylist(), strict=True):
                page = Page(source)
                for token, row in page.tokens().items():
                    x = found.get((h, token))
                    if x is None:
                        found[h, token] = row
                    else:
                        x[1] |= row[1]
                        for i in (2, 3, 4):
                            x[i] += row[i]
                found.setdefault((h, page.content()), [0, 0, 0, 0, 0])
            columns = [[k[0] for k in found], [k[1] for k in found], *([v[i] for v in found.values()] for i in range(5))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i == 0 else pa.int64()) for i, c in enumerate(columns)], NAMES)

    rows = map_batches(pages.select(host().alias("host"), "html"), run, "host string, token bigint, up bigint, flags bigint, pages bigint, agree bigint, chars bigint")
    return rows.groupBy("host", "token").agg(F.max("up").alias("up"), F.bit_or("flags").alias("flags"), F.sum("pages").alias("pages"), F.sum("agree").alias("agree"), F.sum("chars").alias("chars"))


NAMES = ["host", "token", "up", "flags", "pages", "agree", "chars"]


def templates(pages: DataFrame, certain: int = CERTAIN) -> tuple[DataFrame, DataFrame]:
    """(host, main, whole, texts, major): the fields of each host's Template. And the hot hosts, fewer than HOT rows.

    A host's tokens are gathered: those on SUPPORT percent of its pages, so no more than some of its pages have.
    """
    # a text on one page is no template; an element on one page may be, if the host has few pages
    counted = cut_lineage(occurrences(pages).where("pages = 0 or pages > 1 or token >= 0"))
    different = counted.where("pages = 0").groupBy("host").agg(F.count(F.lit(1)).alias("different"))
    size = counted.where("token = 0 and pages > 0").select("host", F.col("pages").alias("of")).join(different, "host")
    total = size.agg(F.sum("of")).first()[0] or 0
    hot = size.where(F.col("of") * HOT > total).select(F.col("host").alias("_hot"))
    frequent = counted.where("pages > 0").join(size, "host").where(f"pages * 100 >= of * {SUPPORT} and (token >= 0 or agree * 100 >= pages * {AGREE})")
    gathered = frequent.groupBy("host").agg(F.collect_list(F.struct("token", "up", "flags", "pages", "agree", "chars")).alias("tokens"), F.max("of").alias("of"), F.max("different").alias("different"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for tokens, of, different in zip(batch["tokens"].to_pylist(), batch["of"].to_pylist(), batch["different"].to_pylist(), strict=True):
                found.append(deduce({t["token"]: [t["up"], t["flags"], t["pages"], t["agree"], t["chars"]] for t in tokens}, of, different, certain))
            sets = [pa.array([sorted(getattr(t, c)) for t in found], pa.list_(pa.int64())) for c in ("texts", "major")]
            yield pa.RecordBatch.from_arrays([batch["host"], pa.array([t.main for t in found], pa.int64()), pa.array([t.whole for t in found], pa.bool_()), *sets], ["host", "main", "whole", "texts", "major"])

    return map_batches(gathered, run, "host string, main bigint, whole boolean, texts array<bigint>, major array<bigint>"), hot


def extract(pages: DataFrame, certain: int = CERTAIN) -> DataFrame:
    """(page_id, url, text) for every row of pages(page_id, url, html, ...).

    Blocks are joined by a line feed; within one, character references are decoded and white space
    is one space. Null or empty html and pages without an article give an empty text. Very long html is read whole, in
    one task. Pages without a readable host share the host ''. Repeated rows are pages like any other, and
    count as one for what a host's texts show. The lower certain, the fewer pages make a text they share a template's; a null page_id or url is only carried through. Other columns are ignored.
    """
    learned, hot = templates(pages, certain)
    hot = F.broadcast(hot)
    dealt = learned.join(hot, F.col("host") == F.col("_hot"), "left").withColumn("_salt", F.explode(F.when(F.col("_hot").isNotNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    dealt = dealt.select(F.col("host").alias("_host"), "_salt", "main", "whole", "texts", "major")
    keyed = pages.select("page_id", "url", "html", host().alias("_h")).join(hot, F.col("_h") == F.col("_hot"), "left")
    keyed = keyed.withColumn("_s", F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).otherwise(0))
    joined = keyed.join(dealt, (F.col("_h") == F.col("_host")) & (F.col("_s") == F.col("_salt")), "left").select("page_id", "url", "html", "_host", "main", "whole", "texts", "major")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, Template] = {}
        for batch in batches:
            texts = []
            for i, (h, source) in enumerate(zip(batch["_host"].to_pylist(), batch["html"].to_pylist(), strict=True)):
                if h not in known:
                    if len(known) > 1000:
                        known.clear()
                    sets = [frozenset(batch[c][i].as_py() or ()) for c in ("texts", "major")]
                    known[h] = Template(batch["main"][i].as_py() or 0, bool(batch["whole"][i].as_py()), *sets)
                texts.append(Page(source).main_text(known[h]))
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return map_batches(joined, run, "page_id bigint, url string, text string")


def op10_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))
