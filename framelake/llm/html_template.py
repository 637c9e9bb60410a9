"""HTML extraction by equivalence classes of tokens.

Pages of a host come from few templates. A token is an element with its path, or a text with its
path; its occurrence vector says how often it occurs in each page of the host. Tokens with equal
vectors form an equivalence class. The class of most pages that occurs once in each is the skeleton;
other classes of enough support nest in the deepest skeleton element around them. What skeleton and
nested classes leave between their tags are slots. A slot is closed if the texts that fill it keep
coming back (menus, adverts, footers: a few texts on many pages) and open if they do not; a text that
most pages of the host show is a token of the template, not a filling. Extraction walks a page against
the template: of the element that holds most of the open slots' text it keeps what fills open slots.

Among open slots, tags and names break ties: a small open part that calls itself comments, sidebar,
form and so on is left out, since its texts differ as much as an article's do.

Vectors are compared by their size and two sums of a hash of (page, count), so they are aggregated
like any sum: a host with a third of all pages is pre-aggregated in the tasks that read it. A host's
template is small (tokens of high support only), whatever the number of its pages. Pages that repeat
as a whole count once.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, small_batches
from .url_filter import host_of

#: Share of a host's pages that an element of its template is in at least.
SUPPORT = 0.1
#: Share of a host's pages that a text of its template is in at least, when ``PRIOR`` pages without it are added.
TEXT_SUPPORT, PRIOR = 0.5, 4
#: A slot is closed if each of its texts occurs so often on average, when ``SLOT_PRIOR`` blocks are added
#: that repeat as those of the same path on all hosts do.
REPEATS, SLOT_PRIOR = 3.0, 10
#: Templates are broadcast up to this size; beyond it, pages and templates are joined by host.
BROADCAST_BYTES = 32 << 20

_TAG = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>", re.S)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "svg", "iframe")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
#: An opening tag of the second group ends an open element of the first.
_ENDS = {t: frozenset(by.split()) for t, by in {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr tbody", "td": "td th tr", "th": "td th tr", "option": "option optgroup"}.items()}
#: Elements whose text is never an article's, and names of parts beside an article (they decide among open slots only).
_NO_TEXT = frozenset("head form script style noscript template iframe button select svg dialog textarea".split())
_SIDE_TAGS = frozenset("nav footer aside menu header".split())
_SIDE_NAMES = re.compile(
    r"(?:^|[-_. ])(?:ads?|advert\w*|sponsor\w*|promo\w*|sidebar|widgets?|menu|nav|navbar|navigation|breadcrumbs?|masthead|footer|cookies?|consent|notices?|newsletter|"
    r"subscribe|signup|popup|modal|share|sharing|social|related|recommend\w*|comments?|replies|discussion|disqus|pagination|pager|toolbar|legal|copyright|login|search)(?:$|[-_. ])", re.I,
)
#: Unnamed elements of these tags are told apart by their place among their like.
_PLACED = frozenset("div section table td th ul ol".split())
_LEAVES = frozenset("html body article main p h1 h2 h3 h4 h5 h6 td".split())

#: Labels and what their names say, remembered within a task.
_LABELS: dict[tuple[str, str], str] = {}
_SIDES: dict[tuple[str], int] = {}


def _remembered(cache: dict, function, *args):
    found = cache.get(args)
    if found is None:
        if len(cache) > 50_000:
            cache.clear()
        found = cache[args] = function(*args)
    return found


def _label(tag: str, attrs: str) -> str:
    """Name of an element in paths: tag, and what class, id or role say (numbers made alike)."""
    said = [m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)]
    names = re.sub(r"\d+", "0", " ".join(said)).split()
    return tag + "." + " ".join(names) if names else tag


def _side(label: str) -> int:
    """2: never holds an article's text; 1: calls itself a part beside the article; 0: neither."""
    tag, _, names = label.partition(".")
    tag = tag.partition(":")[0]
    if tag in _NO_TEXT:
        return 2
    return int(tag in _SIDE_TAGS or bool(names) and tag not in _LEAVES and bool(_SIDE_NAMES.search(names)))


def _hash(said: str, seed: int) -> int:
    return xxhash.xxh64_intdigest(said, seed & 0xFFFFFFFFFFFFFFFF) - (1 << 63)


class Page:
    """Elements and text blocks of a page in order.

    ``paths``, ``parents`` (numbers of elements) and ``labels`` of the elements in order of opening;
    number 0 is the page itself. A path is the hash of an element's label and its parent's path; the
    label of an unnamed container says which of its parent's it is.
    ``blocks``: lists of (element, text as written); a block ends where a block-level tag begins or
    ends, and has several parts where inline elements with a class or id lie in it.
    """

    def __init__(self, source: str) -> None:
        self.paths, self.parents, self.labels = [0], [0], [""]
        self.blocks: list[list[tuple[int, str]]] = []
        self._stack: list[tuple[str, int]] = [("", 0)]
        self._places: Counter = Counter()
        self._held: list[tuple[int, str]] = []
        at = 0
        while at < len(source):
            m = _TAG.search(source, at)
            if not m:
                self._hold(source[at:])
                break
            self._hold(source[at : m.start()])
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            closing, attrs = m[1] or m[4], m[3] or m[6] or ""
            if tag in _RAW and not closing:
                end = _RAW[tag].search(source, at)
                self._flush()
                self._open(tag, attrs)
                if tag == "title":
                    self._hold(source[at : end.start() if end else len(source)])
                at = end.end() if end else len(source)
                self._flush()
                self._stack.pop()
            elif tag in _VOID:
                self._hold(" ") if tag != "hr" else self._flush()
            elif tag in _INLINE:
                if closing:
                    self._close_inline(tag)
                elif "=" in attrs and _ATTR.search(attrs):
                    self._push(tag, attrs)
            else:
                self._flush()
                self._close(tag) if closing else self._open(tag, attrs)
        self._flush()

    def _hold(self, said: str) -> None:
        if said:
            self._held.append((self._stack[-1][1], said))

    def _flush(self) -> None:
        if self._held:
            if any(not said.isspace() for _, said in self._held):
                self.blocks.append(self._held)
            self._held = []

    def _push(self, tag: str, attrs: str) -> None:
        label, parent = _remembered(_LABELS, _label, tag, attrs), self._stack[-1][1]
        if label in _PLACED:
            place = self._places[parent, label]
            self._places[parent, label] += 1
            label = f"{label}:{place}" if place else label
        self._stack.append((tag, len(self.paths)))
        self.paths.append(_hash(label, self.paths[parent]))
        self.parents.append(parent)
        self.labels.append(label)

    def _open(self, tag: str, attrs: str) -> None:
        while self._stack[-1][0] in _INLINE or self._stack[-1][0] == "p":
            self._stack.pop()
        for ended in _ENDS.get(tag, ()):
            if self._stack[-1][0] == ended:
                self._stack.pop()
        self._push(tag, attrs)

    def _close(self, tag: str) -> None:
        for k in range(len(self._stack) - 1, 0, -1):
            if self._stack[k][0] == tag:
                del self._stack[k:]
                return

    def _close_inline(self, tag: str) -> None:
        for k in range(len(self._stack) - 1, 0, -1):
            if self._stack[k][0] not in _INLINE:
                return
            if self._stack[k][0] == tag:
                del self._stack[k:]
                return

    def parts(self) -> Iterator[list[tuple[int, str]]]:
        """Blocks with their adjacent parts of one element joined."""
        for block in self.blocks:
            out: list[tuple[int, str]] = []
            for element, said in block:
                if out and out[-1][0] == element:
                    out[-1] = (element, out[-1][1] + said)
                else:
                    out.append((element, said))
            yield out


def _clean(said: str) -> str:
    return " ".join(entities.unescape(said).split())


def _text_token(path: int, text: str) -> int:
    return _hash(text, path)


# -------------------------------------------------------------------- occurrence vectors

PAGE, ELEMENT, TEXT = 0, 1, 2
_TOKENS = "kind:int,token:long,parent:long,label:string,n:int,chars:long"
_TOKEN_TYPE = pa.list_(pa.struct([("kind", pa.int32()), ("token", pa.int64()), ("parent", pa.int64()), ("label", pa.string()), ("n", pa.int32()), ("chars", pa.int64())]))


def page_tokens(page: Page) -> list[dict]:
    """Tokens of a page: itself, its element paths (characters: of their own text), its texts (parent: their element)."""
    chars: Counter = Counter()
    texts: Counter = Counter()
    for block in page.parts():
        for element, said in block:
            if text := _clean(said):
                path = page.paths[element]
                chars[path] += len(text)
                texts[path, _text_token(path, text)] += 1
    found = [{"kind": PAGE, "token": 0, "parent": 0, "label": "", "n": 1, "chars": 0}]
    above = {p: (page.paths[page.parents[k]], page.labels[k]) for k, p in enumerate(page.paths)}
    for path, n in Counter(page.paths).items():
        found.append({"kind": ELEMENT, "token": path, "parent": above[path][0], "label": above[path][1], "n": n, "chars": chars[path]})
    found += [{"kind": TEXT, "token": t, "parent": path, "label": "", "n": n, "chars": 0} for (path, t), n in texts.items()]
    return found


def tokens(pages: DataFrame) -> DataFrame:
    """Tokens of every host (``host, html``) with their vectors; pages that repeat as a whole count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sources = b.column("html").to_pylist()
            keys = pa.array([_hash(s, 0) for s in sources], pa.int64())
            found = pa.array([page_tokens(Page(s)) for s in sources], _TOKEN_TYPE)
            yield pa.RecordBatch.from_arrays([b.column("host"), keys, found], names=["host", "key", "tokens"])

    rows = pages.select("host", "html").mapInArrow(run, f"host long, key long, tokens array<struct<{_TOKENS}>>")
    once = rows.groupBy("host", "key").agg(F.any_value("tokens").alias("tokens")).select("host", "key", F.inline("tokens"))
    v = F.xxhash64("key", "n")
    return once.groupBy("host", "kind", "token").agg(
        F.any_value("parent").alias("parent"), F.any_value("label").alias("label"), F.count("*").alias("n_pages"), F.sum("n").alias("total"),
        F.sum(F.shiftrightunsigned(v, 33)).alias("v1"), F.sum(v.bitwiseAND((1 << 31) - 1)).alias("v2"), F.sum("chars").alias("chars"),
    )


# -------------------------------------------------------------------- templates


def _vector(r: dict) -> tuple[int, int, int, int]:
    return r["n_pages"], r["total"], r["v1"], r["v2"]


def deduce(rows: list[dict], constants: list[int]) -> dict:
    """A host's template from its elements of enough support.

    A row has ``token, parent, label``, its vector, ``chars``, and of its own texts the ``blocks`` and
    ``distinct`` (blocks, each divided by how often its text occurs), and both for its path on all hosts
    (``all_blocks, all_distinct``). ``skeleton``: element: parent in
    the skeleton; ``nested``: skeleton element: classes below it; ``main``: the skeleton element that
    holds most text of open slots (0: the page); ``drop``: elements whose own text is none of the
    article's; ``known``: all elements; ``extra``: open headings outside ``main``.
    """
    rows = [r for r in rows if r["token"]]
    by = {r["token"]: r for r in rows}
    once = Counter(_vector(r) for r in rows if r["total"] == r["n_pages"])
    own = max(once, key=lambda v: (v[0], once[v], v), default=None)
    skeleton: dict[int, int] = {r["token"]: 0 for r in rows if _vector(r) == own}

    def around(token: int) -> int:
        """The nearest skeleton element above."""
        token = by[token]["parent"]
        while token and token not in skeleton:
            token = by[token]["parent"] if token in by else 0
        return token

    for t in skeleton:
        skeleton[t] = around(t)
    classes: dict[tuple, list[int]] = {}
    for r in rows:
        if r["token"] not in skeleton:
            classes.setdefault((around(r["token"]), *_vector(r)), []).append(r["token"])
    nested: dict[int, list[list[int]]] = {}
    for (above, *_), members in sorted(classes.items()):
        nested.setdefault(above, []).append(sorted(members))
    slots = [[t] for t in skeleton] + [c for cs in nested.values() for c in cs]  # every skeleton tag opens a slot of its own

    def is_closed(slot: list[int]) -> bool:
        blocks, distinct, all_blocks, all_distinct = (sum(by[t][c] for t in slot) for c in ("blocks", "distinct", "all_blocks", "all_distinct"))
        return blocks > 0 and (distinct + SLOT_PRIOR * all_distinct / all_blocks) * REPEATS <= blocks + SLOT_PRIOR

    closed = {t for slot in slots if is_closed(slot) for t in slot}
    below: dict[int, list[int]] = {}
    for r in rows:
        below.setdefault(r["parent"], []).append(r["token"])
    order: list[int] = []  # children before parents
    todo = list(below.get(0, ()))
    while todo:
        order.append(todo.pop())
        todo += below.get(order[-1], ())
    order.reverse()

    def mass(out: set[int]) -> dict[int, int]:
        found: dict[int, int] = {0: 0}
        for t in order:
            found[t] = found.get(t, 0) + (0 if t in out else by[t]["chars"])
            found[by[t]["parent"]] = found.get(by[t]["parent"], 0) + found[t]
        return found

    never = {t for t in by if _side(by[t]["label"]) == 2}
    for t in reversed(order):  # parents first
        if by[t]["parent"] in never:
            never.add(t)
    open_ = mass(closed | never)
    if not open_[0]:  # nothing varies: what is said on these pages can't be told from their template
        closed, open_ = set(), mass(never)
    side: set[int] = set()
    for t in reversed(order):
        small = 2 * open_[t] < open_[0]
        if by[t]["parent"] in side or small and _side(by[t]["label"]) and not _within_main_header(by, t):
            side.add(t)
    drop = closed | never | side
    whole = mass(drop)
    main = 0
    while True:
        inside = [t for t, above in skeleton.items() if above == main and 2 * whole[t] > whole[main] and 2 * by[t]["chars"] < whole[t]]
        if not inside:
            break
        main = inside[0]
    within = set()
    for t in reversed(order):
        if t == main or by[t]["parent"] in within:
            within.add(t)
    extra = [t for t in skeleton if main and t not in within and t not in drop and by[t]["label"].partition(".")[0] == "h1"]
    for t in order:  # what fills closed slots only is closed as a whole, for elements that the template does not know
        if t not in drop and not whole[t] and not by[t]["chars"] and below.get(t):
            drop.add(t)
    return {"skeleton": skeleton, "nested": nested, "main": main, "drop": sorted(drop), "known": sorted(by), "extra": sorted(extra), "constant": sorted(constants)}


def _within_main_header(by: dict[int, dict], t: int) -> bool:
    """Is this the header of an article or main element?"""
    if by[t]["label"].partition(".")[0] != "header":
        return False
    while (t := by[t]["parent"]) in by:
        if by[t]["label"].partition(".")[0] in ("article", "main"):
            return True
    return False


def templates(pages: DataFrame) -> tuple[DataFrame, list[int]]:
    """``host, template`` (JSON) of every host, and the texts that half of all pages show."""
    found = checkpointed(tokens(pages))
    sizes = found.where(F.col("kind") == PAGE).select("host", F.col("n_pages").alias("__of"))
    n_all = sizes.agg(F.sum("__of")).first()[0] or 0
    texts = found.where(F.col("kind") == TEXT).select("host", "token", "parent", "n_pages", "total")
    often = texts.groupBy("token").agg(F.sum("n_pages").alias("__n"), F.sum("total").alias("__g")).where("__g > 1")
    everywhere = [r.token for r in often.where(F.col("__n") >= TEXT_SUPPORT * (n_all + PRIOR)).select("token").collect()]  # no more than two pages' worth
    filled = texts.join(often.select("token", "__g"), "token", "left").groupBy("host", F.col("parent").alias("token")).agg(
        F.sum("total").alias("blocks"), F.sum(F.col("total") / F.coalesce("__g", F.lit(1))).alias("distinct")
    )
    filled = checkpointed(filled)
    anywhere = filled.groupBy("token").agg(F.sum("blocks").alias("all_blocks"), F.sum("distinct").alias("all_distinct"))
    filled = filled.join(anywhere, "token")
    constant = texts.where(F.col("n_pages") >= TEXT_SUPPORT * (1 + PRIOR)).join(sizes, "host").where(F.col("n_pages") >= TEXT_SUPPORT * (F.col("__of") + PRIOR)).groupBy("host").agg(F.collect_list("token").alias("constants"))
    kept = found.where(F.col("kind") == ELEMENT).join(sizes, "host").where(F.col("n_pages") >= SUPPORT * F.col("__of")).drop("kind", "__of")
    whole = kept.join(filled, ["host", "token"], "left").fillna(0, ["blocks", "distinct", "all_blocks", "all_distinct"])
    names = ["token", "parent", "label", "n_pages", "total", "v1", "v2", "chars", "blocks", "distinct", "all_blocks", "all_distinct"]
    per_host = whole.groupBy("host").agg(F.collect_list(F.struct(*names)).alias("tokens")).join(constant, "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = [json.dumps(deduce(sorted(t, key=lambda r: r["token"]), c or [])) for t, c in zip(b.column("tokens").to_pylist(), b.column("constants").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("host"), pa.array(said, pa.string())], names=["host", "template"])

    return per_host.mapInArrow(run, "host long, template string"), everywhere


# -------------------------------------------------------------------- extraction


class Template:
    """A template as extraction reads it."""

    def __init__(self, said: dict, everywhere: frozenset[int] = frozenset()) -> None:
        self.main, self.extra = said["main"], frozenset(said["extra"])
        self.drop, self.known = frozenset(said["drop"]), frozenset(said["known"])
        self.constant = everywhere | frozenset(said["constant"])


def extract(source: str, template: Template) -> str:
    """What fills the open slots of the template's main element, one block per line; where a page lacks
    that element, its own article or main element stands for it, or else the page."""
    page = Page(source)
    n = len(page.paths)
    main = template.main
    if main and main not in page.paths:
        main = next((p for p, label in zip(page.paths, page.labels, strict=True) if label.partition(".")[0] in ("article", "main")), 0)
    inside, dropped = [main == 0] * n, [False] * n
    for k in range(1, n):
        path, above = page.paths[k], page.parents[k]
        inside[k] = inside[above] or path == main or path in template.extra
        if path in template.known:
            dropped[k] = path in template.drop
        else:  # too rare for the template: like what it lies in, or by its name
            dropped[k] = dropped[above] or _remembered(_SIDES, _side, page.labels[k]) > 0
    own, every = [], []
    for block in page.parts():
        kept = [(e, said) for e, said in block if inside[e] and not dropped[e]]
        if text := _clean("".join(said for _, said in kept)):
            every.append(text)
            if not all(_text_token(page.paths[e], _clean(said)) in template.constant for e, said in kept if _clean(said)):
                own.append(text)
    return "\n".join(own or every)  # a page all of whose texts its host repeats keeps them


TEXT_SCHEMA = "page_id long, url string, text string, n_chars long"


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row; null or empty html gives an empty text.

    Rows that repeat are extracted again; URLs without a host share one template. Of texts that tie
    in how often they occur all are treated alike. An empty table gives an empty one; texts are never
    cut, whatever their length; further columns are ignored.
    """
    small_batches(pages.sparkSession)
    read = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), F.xxhash64(host_of(F.col("url").cast("string"))).alias("host"),
    )
    made, everywhere = templates(read)
    found, everywhere = checkpointed(made), frozenset(everywhere)
    n_bytes = found.agg(F.sum(F.length("template"))).first()[0] or 0
    joined = read.join(F.broadcast(found) if n_bytes <= BROADCAST_BYTES else found, "host", "left").drop("host")
    bare = json.dumps(deduce([], []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Template] = {}
        for b in batches:
            texts = []
            for source, said in zip(b.column("html").to_pylist(), b.column("template").to_pylist(), strict=True):
                said = said or bare
                if said not in known:
                    known = known if len(known) < 1000 else {}
                    known[said] = Template(json.loads(said), everywhere)
                texts.append(extract(source, known[said]))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, TEXT_SCHEMA)
