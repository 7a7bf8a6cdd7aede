"""Main text of web pages by equivalence-class template deduction.

Pages of one host are filled from a template. Its tokens (tags, and words in their place
in the element tree) occur in all pages in the same numbers, those of its repeated parts
in numbers that vary together. So:

1. Pages of a host whose own markup gives the same text are copies; one of them counts.
   Every such page is cut into tokens. For each host and token the occurrence vector over the
   host's pages is kept as its support, its total and a hash sum, which partial sums
   build without bringing a host's pages together.
2. Tokens of one host with equal vectors form an equivalence class. Classes of at least
   two tokens that occur in enough of the pages are the template's.
3. Page by page, a class is valid if its tokens keep their order in every round; classes
   must nest, the one that breaks into another is dropped. Text made of the valid
   classes' tokens is template, what remains fills the slots. Long text and text inside an
   article element is never template: repetition alone does not tell it from articles.
4. The article's slot is found from the valid classes: of the template's containers, the
   innermost that holds ``MOST`` of the words in the slots. The article is what remains of
   its text. Markup is a veto: menus, headers, footers, sidebars, notices, adverts, forms
   and comments, as elements and class names tell them, never count. An article element
   around the slot is taken whole, one inside is the article alone, one elsewhere on the page is
   none of it. Only pages without valid classes are judged by their markup alone.

A host's template has at most as many tokens as its pages have on average, times two; it
is joined to the pages by host (broadcast or skew-split shuffle, by its written size).

Nulls and odd rows: a null or empty page has an empty text; a page without host, and one
of a host with too few pages, is judged by its own markup; null ids are kept; repeated
rows are extracted each and count once; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwatch.llm.common import Numbered, byte_values, written
from bandwatch.llm.urls import host_and_path

#: Least different pages of a host with a template, and least share of them with its tokens.
LEAST_PAGES, SUPPORT = 3, 0.5
#: Text of so many words is compared word by word, longer text as a whole; that is never dropped for being repeated.
SHORT = 8
#: Share of the slots' words that the article's element holds.
MOST = 0.9
#: Partial sums that a task holds before it hands them on.
HELD = 200_000

# The elements of the language that matter here, and names of parts that are not the article.
RAW = "script style template noscript iframe svg textarea select object"
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES = {  # an opening element ends these if they are innermost
    "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"},
    "th": {"td", "th", "p"}, "option": {"option"}, "body": {"head"},
}
ASIDE = set("head nav header footer aside form button dialog menu label input iframe".split())
ASIDE_NAMES = set(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies footer header "
    "masthead menu modal nav navbar navigation newsletter notice notices popup promo promoted related respond share sharing sidebar "
    "social sponsor sponsored subscribe widget".split()
)
#: Elements that may hold a whole article.
CONTAINERS = set("article body center div fieldset main section table tbody td tr".split())
INLINE_IN_P = BLOCKS - {"body", "html", "head"}

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{'|'.join(RAW.split())})\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|</?(?P<tag>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|</?[a-zA-Z][^>]*>|<[!?][^>]*>",
    re.S | re.I,
)
_NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPLIT = re.compile(r"[\s_-]+")


#: Stands for the element around a page.
NOTHING = ("", False, False, 0, False, -1)


class Run:
    """A piece of text between tags, with where it stands."""

    __slots__ = ("article", "aside", "block", "element", "text", "tokens")

    def __init__(self, text, block, aside, article, element):
        self.text, self.block, self.aside, self.article, self.element, self.tokens = text, block, aside, article, element, []


def read(page: str) -> tuple[list[Run], list[int], list[tuple[int, int, bool, bool]]]:
    """The text runs of a page, the hashes of all its tokens, and its elements, in their order.

    Runs point into the tokens by position and to their element (-1: none). An element is
    the number of its parent, the position of its token, whether it is in an article or one, and
    whether it is a container.
    """
    runs: list[Run] = []
    tokens: list[int] = []
    elements: list[tuple[int, int, bool, bool]] = []
    stack: list[tuple[str, bool, bool, int, bool, int]] = []  # name, aside, in article, hash of the path, in a paragraph that a block ends, element
    open_: Counter[str] = Counter()
    block, at = 0, 0
    digest = xxhash.xxh64_intdigest

    def emit(text: str) -> None:
        if not text or text.isspace():
            if text and runs and runs[-1].block == block:
                runs[-1].text += " "
            return
        _, aside, article, path, _, element = stack[-1] if stack else NOTHING
        plain = html.unescape(text) if "&" in text else text
        run = Run(plain, block, aside, article, element)
        words = plain.split()
        for w in words if len(words) <= SHORT else [" ".join(words)]:
            run.tokens.append(len(tokens))
            tokens.append(digest(w, path & 0xFFFFFFFFFFFFFFFF))
        runs.append(run)

    for m in _TOKEN.finditer(page):
        emit(page[at : m.start()])
        at = m.end()
        if not m["tag"]:
            continue
        name = m["tag"].lower()
        if page.startswith("</", m.start()):
            if open_[name]:
                while True:
                    last = stack.pop()[0]
                    open_[last] -= 1
                    if last == name:
                        break
            block += name in BLOCKS
            continue
        if name in BLOCKS:
            block += 1
            ends = CLOSES.get(name, {"p"})
            while stack and (stack[-1][0] in ends or name in INLINE_IN_P and stack[-1][4]):
                open_[stack.pop()[0]] -= 1
        _, aside, article, path, paragraph, parent = stack[-1] if stack else NOTHING
        named = " ".join(a or b or c for a, b, c in _NAMED.findall(m["attributes"])).lower() if m["attributes"] else ""
        path = digest(f"{name} {named}", path)
        tokens.append(path)
        if name in VOID:
            if name == "br" and runs and runs[-1].block == block:
                runs[-1].text += " "
            continue
        within = article or name in ("article", "main")
        aside = aside or name in ASIDE and not (name == "header" and within) or not ASIDE_NAMES.isdisjoint(_SPLIT.split(named)) and not name in ("body", "html", "article", "main")
        stack.append((name, aside, within, path, name == "p" or paragraph and name not in BLOCKS, len(elements)))
        elements.append((parent, len(tokens) - 1, within, name in CONTAINERS))
        open_[name] += 1
    emit(page[at:])
    return runs, tokens, elements


def template_positions(tokens: list[int], template: dict[int, tuple], least: float) -> set[int]:
    """Positions of tokens that belong to valid, nested classes of the template.

    ``template``: token -> (class, place in the class, share of pages).
    """
    places: dict[int, list[tuple[int, int]]] = {}
    for i, t in enumerate(tokens):
        found = template.get(t)
        if found and found[2] >= least:
            places.setdefault(found[0], []).append((i, found[1]))
    sizes = Counter(c for c, _, share in template.values() if share >= least)
    spans = []
    for c, seen in places.items():
        # Every round of the class in its order, from its first token on.
        order = [p for _, p in seen]
        rounds, size = len(order) // sizes[c], sizes[c]
        if rounds and order == sorted(range(size)) * rounds:
            spans += [(seen[r * size][0], seen[(r + 1) * size - 1][0], c) for r in range(rounds)]
    open_spans: list[tuple[int, int]] = []
    broken = set()
    for first, last, c in sorted(spans, key=lambda s: (s[0], -s[1])):
        while open_spans and open_spans[-1][1] < first:
            open_spans.pop()
        if open_spans and open_spans[-1][1] < last:
            broken.add(c)
        else:
            open_spans.append((first, last))
    good = {c for *_, c in spans} - broken
    return {i for c in good for i, _ in places[c]}


def article_runs(runs: list[Run], elements: list[tuple[int, int, bool, bool]], outside: set[int]) -> list[Run]:
    """The runs in the article's slot of a page whose template has the tokens at the positions ``outside``."""
    slots = [0 if r.aside or len(r.text.split()) <= SHORT and all(i in outside for i in r.tokens) else len(r.text.split()) for r in runs]
    words = [0] * len(elements)
    for r, n in zip(runs, slots):
        if r.element >= 0:
            words[r.element] += n
    for e in range(len(elements) - 1, 0, -1):  # parents come before their elements
        if elements[e][0] >= 0:
            words[elements[e][0]] += words[e]
    total = sum(slots)
    # More than half of the words: such elements lie in each other, the last is the innermost.
    found = max((e for e, (_, at, _, holds) in enumerate(elements) if holds and at in outside and words[e] >= MOST * total), default=-1) if total else -1
    while found >= 0 and elements[found][2] and elements[found][0] >= 0 and elements[elements[found][0]][2]:
        found = elements[found][0]
    inside = [False] * len(elements)
    for e, (parent, *_) in enumerate(elements):
        inside[e] = e == found or parent >= 0 and inside[parent]
    chosen = [r for r in runs if not r.aside and (found < 0 or r.element >= 0 and inside[r.element])]
    return [r for r in chosen if r.article] if any(r.article for r in chosen) else chosen


def main_text(page: str, template: dict[int, tuple] | None = None, pages: int = 0) -> str:
    """The article of a page, a line for each block."""
    runs, tokens, elements = read(page)
    outside = template_positions(tokens, template, SUPPORT) if template and pages >= LEAST_PAGES else set()
    lines: list[str] = []
    last = None
    for r in article_runs(runs, elements, outside):
        if not r.article and len(r.text.split()) <= SHORT and all(i in outside for i in r.tokens):
            continue
        if r.block == last:
            lines[-1] += r.text
        else:
            lines.append(r.text)
        last = r.block
    return "\n".join(filter(None, (" ".join(x.split()) for x in lines)))


SUMS = "host string, token long, pages long, total long, vector long, place double"


def occurrences(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """Partial occurrence vectors of tokens by host; token 0 counts the host's pages. Copies count once."""

    def run(batches):
        held: dict[tuple[str, int], list] = {}

        def rows():
            keys, values = list(held), list(zip(*held.values())) or [()] * 4
            hosts, tokens = zip(*keys) if keys else ((), ())
            columns = [pa.array(hosts, pa.string()), pa.array(tokens, pa.int64()), *(pa.array(v, pa.int64()) for v in values[:3]), pa.array(values[3], pa.float64())]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SUMS.split(", ")])

        for batch in batches:
            for key, host, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), byte_values(batch.column(2))):
                tokens = read(raw.decode("utf-8", "replace"))[1]
                own = repr(key)
                held.setdefault((host, 0), [0, 0, 0, 0.0])[0] += 1
                first: dict[int, int] = {}
                for i, t in enumerate(tokens):
                    first.setdefault(t, i)
                for t, n in Counter(tokens).items():
                    s = held.setdefault((host, t - (1 << 63)), [0, 0, 0, 0.0])
                    s[0] += 1
                    s[1] += n
                    s[2] += xxhash.xxh32_intdigest(own, n & 0xFFFFFFFF)
                    s[3] += first[t] / len(tokens)
                if len(held) > HELD:
                    yield rows()
        yield rows()

    host = host_and_path(F.col(url_col).cast("string"))[0]
    chosen = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), F.col(html_col).cast("string").alias("html")).where("host <> ''")

    def make():
        return lambda page: (xxhash.xxh64_intdigest(main_text(page.decode("utf-8", "replace"))) - (1 << 63),)

    stored = Numbered(chosen, "html", "content long", make, "pages")
    one = stored.narrow(F.col("host")).groupBy("host", "content").agg(F.min(F.struct("slice", "place")).alias("one"))
    return stored.only(one.select("one.slice", "one.place")).mapInArrow(run, SUMS)


def deduce(sums: DataFrame) -> DataFrame:
    """(host, pages, template): each host's equivalence classes, as an array of (class, place, token, share).

    Classes are numbered by their vectors; a token's place in its class is that of its
    mean first position on the pages.
    """
    whole = sums.groupBy("host", "token").agg(*[F.sum(c).alias(c) for c in ("pages", "total", "vector", "place")])
    whole, _ = written(whole.where(F.col("pages") >= LEAST_PAGES), "occurrences")
    hosts = whole.where("token = 0").select("host", F.col("pages").alias("n"))
    frequent = whole.where("token <> 0").join(hosts, "host").where(F.col("pages") >= SUPPORT * F.col("n"))
    share = F.col("pages") / F.col("n")
    item = F.struct((F.col("place") / F.col("pages")).alias("place"), "token", share.alias("share"))
    classes = frequent.groupBy("host", "n", "pages", "total", "vector").agg(F.sort_array(F.collect_list(item)).alias("items")).where(F.size("items") > 1)
    return classes.groupBy("host", "n").agg(F.collect_list("items").alias("classes"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text): one row per row of ``pages``."""
    templates, _ = written(deduce(occurrences(pages, id_col, url_col, html_col)), "templates")
    host = host_and_path(F.col(url_col).cast("string"))[0]
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"), host.alias("host")
    ).join(templates, "host", "left").select("page_id", "url", "html", "host", "n", "classes")

    def run(batches):
        known: dict[str, tuple[dict[int, tuple], int]] = {}
        for batch in batches:
            hosts, texts = batch.column(3).to_pylist(), []
            for i, (host, raw) in enumerate(zip(hosts, byte_values(batch.column(2)))):
                if host not in known:
                    if len(known) > 1000:
                        known.clear()
                    classes = batch.column(5)[i].as_py() or []
                    table = {x["token"] + (1 << 63): (c, p, x["share"]) for c, items in enumerate(classes) for p, x in enumerate(items)}
                    known[host] = table, batch.column(4)[i].as_py() or 0
                texts.append(main_text(raw.decode("utf-8", "replace"), *known[host]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return rows.mapInArrow(run, "page_id long, url string, text string")
