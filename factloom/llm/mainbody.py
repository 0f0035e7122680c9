"""The main body of pages whose text is mixed with menus, notices, sidebars, inserts and footers.

Wrapper induction per host. Every page is read once into a tree: nested containers, and lines as leaves. The references of
a host are pages of its commonest layouts. Every page is aligned to the reference of its layout, else to the one it fits
best, by simple tree matching: containers match by label, lines by tag, and a line with the same text weighs twice, so
constant lines find each other. Each line then has an aligned place, that of the container its own was matched to. What
stands at the same place with the same masked text on a share of the host's pages is constant and becomes template, as is
what is constant wherever it stands on the host, or over the corpus; what varies is content. The host's main place is
the one that holds the most running text over all aligned pages once template is gone, and a page's body is what
varies there.

Texts without containers have no tree. `main_body(plain_rule=False)` aligns them as sequences of lines, which can only take
the constants away and leaves foreign titles, so by default they are read by line rules over the same constants: the body
is the stretch from the title line to the first list of foreign titles.

Work per page is linear in its lines but for the matching (lines of the page times lines of the reference). Nothing is
gathered per host except its constants, of which there are at most (lines per page / share).
"""

from __future__ import annotations

import html
import pickle
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from urllib.parse import unquote, urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from factloom.llm.residue import known_line
from factloom.session import stage

_TAG = re.compile(r"<!--.*?-->|</?[a-zA-Z!][^>]*>", re.S)
_OPEN = re.compile(r"<([a-zA-Z][a-zA-Z0-9]*)([^>]*)>")
_CONTAINERS = {"div", "nav", "main", "article", "aside", "footer", "header", "section", "table", "tbody", "tr", "td", "ul", "ol", "form"}
_CLASS = re.compile(r"""\b(?:class|id)\s*=\s*["']?([^"'\s>]+)""")
# Labels that open an insert in the corpus' languages.
_LABEL = re.compile(
    r"(?:related|read also|see also|read more|share(?: this page)?|sponsored|advertisement|tags|filed under|teilen|partager|compartir|поделиться|lesen sie auch|mehr dazu|siehe auch|verwandt|anzeige|gesponsert|schlagwörter|à lire aussi|lire aussi|à lire|sponsorisé|publicité|mots-clés"
    r"|lea también|ver también|relacionado|patrocinado|etiquetas|читайте также|смотрите также|по теме|реклама|теги|метки)\s*(?:[:–—|]|$)",
    re.I,
)
_CRUMB = re.compile(r"^[^.!?]{1,60}(?:\s[>›»/→]\s[^.!?>›»/→]{1,90})+(?:[.!?…]|\.\.\.)?$")
_PAGER = re.compile(r"^[\d\s…«»<>‹›.|·-]+$")
_COPYRIGHT = re.compile(r"^(?:©|\(c\)|copyright)\s", re.I)
_CODE = re.compile(r"^\s{2,}\S|^\$ |^\t|[={}\[\]]|\w\([^)]*\)|^(?:import|from|for|assert|def|return|class|const|let|var|print)\b.*[\w)]$")
#: A line of a specification: a label of a few words, and a quantity with its unit, or single words.
_MEASURED = re.compile(r"^(?:\* )?[^:–.!?]{2,40}?\s?[:–]\s\d[\d.,]*\s?(?:[^\W\d_]{1,4}|[%°\"])$")
_VALUED = re.compile(r"^(?:\* )?[^:–.!?]{2,40}?\s?[:–]\s[^\W\d_]+(?:, [^\W\d_]+)*$")
_PROSE_END = re.compile(r"[.!?…][»”\"')\]]*$|:$")
_ITEMS = re.compile(r"\s*[|·•/]\s*|\s{2,}|\s+[>›»–]\s+")


def _parts(url: str | None) -> tuple[str, str]:
    """(host, path) of an address; both are empty where it is none."""
    try:
        u = urlsplit(url or "")
        return (u.hostname or "").lower(), unquote(u.path)
    except ValueError:  # brackets that hold no address
        return "", ""


def host_of(url: str | None) -> str:
    return _parts(url)[0]


@lru_cache(maxsize=4096)
def _brand(host: str) -> tuple[str, re.Pattern] | None:
    parts = host.split(".")
    brand = parts[-2] if len(parts) > 1 else parts[0]
    return (brand, re.compile(re.escape(brand), re.I)) if len(brand) > 2 else None


_DIGITS = re.compile(r"\d+")


def mask(text: str, host: str) -> str:
    """A line without what differs between the sites and days that show it: brand and numbers."""
    b = _brand(host)
    if b and b[0] in text.lower():
        text = b[1].sub("@", text)
    return _DIGITS.sub("9", text).strip()


def key(masked: str) -> int:
    return xxhash.xxh64_intdigest(masked) - (1 << 63)


class Line:
    __slots__ = ("no", "text", "tag", "block", "mask", "key", "kind", "bare")

    def __init__(self, no: int, text: str, tag: str, block: int, host: str, bare: bool = False) -> None:
        self.no, self.text, self.tag, self.block, self.bare = no, text, tag, block, bare
        self.mask = mask(text, host)
        self.key = key(self.mask)
        self.kind = ""

    @classmethod
    def of(cls, row: tuple, block: int) -> Line:
        x = cls.__new__(cls)
        x.no, x.text, x.tag, x.mask, x.key, x.bare = row
        x.block, x.kind = block, ""
        return x

    @property
    def words(self) -> int:
        return self.text.count(" ") + 1


def is_html(text: str) -> bool:
    return bool(re.match(r"\s*(?:<!--.*?-->\s*)*<(?:!doctype|html|head|body|div|p|h1|title)\b", text, re.I | re.S))


_PART = re.compile(r"<!--.*?-->|<(/?)([a-zA-Z][a-zA-Z0-9]*)([^>]*)>|<![^>]*>", re.S)
_SKIPPED = re.compile(r"\s*<(script|style|template)\b", re.I)
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_INNER = {"a", "code", "dl", "li"}


class Block:
    """A container: its label, its parent, and its children in order, containers and lines."""

    __slots__ = ("label", "up", "kids", "no")

    def __init__(self, label: str, up: Block | None, no: int) -> None:
        self.label, self.up, self.kids, self.no = label, up, [], no


def parse_html(text: str, host: str) -> list[Block]:
    """The containers of a page in document order, the body first, with their lines. A container is an element that is still
    open at the end of the line that opens it; what opens and closes on one line is part of the line. The lines before the
    body tag, wherever it stands, are left out. Where a page leaves out end tags, a container of a kind that is not closed as
    often as it is opened ends where the next one opens."""
    low = text.lower()
    start = low.find("<body")
    unclosed = {t for t in _CONTAINERS if low.count(f"</{t}") < low.count(f"<{t}>") + low.count(f"<{t} ")}
    root = Block("body", None, 0)
    blocks, at, skip, offset = [root], root, "", 0
    for no, raw in enumerate(text.split("\n"), 1):
        begin, offset = offset, offset + len(raw) + 1
        if start >= 0 and offset <= start:
            continue
        if begin <= start:
            raw = raw[start - begin :]
        if skip:
            if skip in raw.lower():
                skip = ""
            continue
        if "<" not in raw:
            if plain := raw.strip():
                at.kids.append(Line(no, html.unescape(plain) if "&" in plain else plain, "", at.no, host))
            continue
        if m := _SKIPPED.match(raw):
            end = f"</{m[1].lower()}"
            skip = "" if end in raw.lower() else end
            continue
        # the containers that the line leaves open, and how many of the open ones it closes
        opened: list[tuple[str, str]] = []
        tags: list[str] = []
        closed: list[str] = []
        for m in _PART.finditer(raw):
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                if any(t == tag for t, _ in opened):
                    while opened.pop()[0] != tag:
                        pass
                elif tag in _CONTAINERS:
                    closed.append(tag)
                continue
            tags.append(tag)
            if tag in _CONTAINERS and not m[3].endswith("/"):
                cls = _CLASS.search(m[3])
                opened.append((tag, tag + ("." + cls[1] if cls else "")))
        plain = _TAG.sub("", raw).strip()
        for tag in closed:
            up = at
            while up is not root and up.label.partition(".")[0] != tag:
                up = up.up
            if up is not root:
                at = up.up
        for tag, label in opened:
            while at is not root and at.label.partition(".")[0] in unclosed:
                at = at.up
            new = Block(label, at, len(blocks))
            at.kids.append(new)
            blocks.append(new)
            at = new
        if plain:
            tag = next((t for t in tags if t not in _INNER and t not in _VOID), tags[0] if tags else "")
            at.kids.append(Line(no, html.unescape(plain) if "&" in plain else plain, tag, at.no, host))
    return blocks


def parse_plain(text: str, host: str) -> list[Line]:
    """Lines with text; the block counts the blank lines before."""
    out, block = [], 0
    for no, raw in enumerate(text.split("\n"), 1):
        if raw.strip():
            out.append(Line(no, raw.strip(), "*" if raw.startswith("* ") else "", block, host, bare=raw.startswith(("    ", "\t"))))
        else:
            block += 1
    return out


def pack(blocks: list[Block]) -> bytes:
    """A tree as bytes: (parent, label) of each container, and of its children the containers' numbers and the lines."""
    return pickle.dumps([(b.up.no if b.up else -1, b.label, [k.no if isinstance(k, Block) else (k.no, k.text, k.tag, k.mask, k.key, k.bare) for k in b.kids]) for b in blocks], 5)


def unpack(data: bytes) -> list[Block]:
    blocks: list[Block] = []
    rows = pickle.loads(data)
    for no, (up, label, _) in enumerate(rows):
        blocks.append(Block(label, blocks[up] if up >= 0 else None, no))
    for b, (_, _, kids) in zip(blocks, rows):
        b.kids = [blocks[k] if isinstance(k, int) else Line.of(k, b.no) for k in kids]
    return blocks


def layout(blocks: list[Block]) -> str:
    """The containers of a page, nested, without its lines."""

    def said(b: Block) -> str:
        inner = "".join(said(k) for k in b.kids if isinstance(k, Block))
        return f"{b.label}({inner})"

    return said(blocks[0])


def match(a: Block, b: Block, pairs: bool = False) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching: the weight of the largest matching of two trees that keeps order and parents, and the numbers
    of the matched containers (if pairs). Containers match if their labels are equal, lines if their tags are; a
    line with the same text weighs twice, so constant lines find each other. Roots are matched."""
    x, y = a.kids, b.kids
    n, m = len(x), len(y)
    inner: dict[tuple[int, int], tuple[int, list]] = {}
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        k = x[i - 1]
        up, row = best[i - 1], best[i]
        is_block = k.__class__ is Block
        for j in range(1, m + 1):
            o = y[j - 1]
            w = 0
            if is_block:
                if o.__class__ is Block and k.label == o.label:
                    inner[i, j] = got = match(k, o, pairs)
                    w = got[0]
            elif o.__class__ is not Block and k.tag == o.tag:
                w = 2 if k.key == o.key else 1
            v = up[j - 1] + w
            if up[j] > v:
                v = up[j]
            if row[j - 1] > v:
                v = row[j - 1]
            row[j] = v
    found: list[tuple[int, int]] = []
    if pairs:
        found.append((a.no, b.no))
        i, j = n, m
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                if (i, j) in inner:
                    found += inner[i, j][1]
                i, j = i - 1, j - 1
    return best[n][m] + 1, found


def is_crumb(x: Line) -> bool:
    return bool(_CRUMB.match(x.text)) and not _CODE.search(x.text)


def frame(masked: str) -> str | None:
    """A line of three parts or more that is no sentence, without its last part, as in addresses: what is constant of it may be
    its frame."""
    return masked.rpartition(", ")[0] + ", *" if masked.count(", ") >= 2 and not _PROSE_END.search(masked) else None


def is_template(x: Line, constant) -> bool:
    """Whether a line is constant over the host's pages, or built from constant items, or an insert by its label. A quantity
    with its unit is never template."""
    if _MEASURED.match(x.text):  # with the number masked, what many pages say of their own things looks constant
        return False
    if x.key in constant or _LABEL.match(x.text) or _PAGER.match(x.text) or _COPYRIGHT.match(x.text):
        return True
    if (f := frame(x.mask)) and key(f) in constant:
        return True
    items = [i for i in _ITEMS.split(x.mask) if i]
    if len(items) >= 2:
        known = sum(key(i) in constant for i in items)
        return known >= 0.6 * len(items) or (known >= 1 and is_crumb(x))
    return False


def prose_words(x: Line) -> int:
    return x.words if x.words >= 5 and (_PROSE_END.search(x.text) or x.tag in ("p", "*")) else 0


def only_message(lines: list[Line]) -> bool:
    """Whether what is left is an error message or a notice alone: few words on one line or two, one of them a known message."""
    return len(lines) <= 2 and sum(x.words for x in lines) <= 40 and any(known_line(x.text) for x in lines)


def blocks_of_html(blocks: list[Block], slots: dict[int, int], constant: Callable[[int], frozenset]) -> list[tuple[int, int, int, list[int]]]:
    """(block, slot, score, line numbers) of the containers that may be the body: lines that are constant at their aligned
    place are template. A page without containers is one block, read like a text without markup."""
    if len(blocks) == 1:
        known = constant(-1)
        keep = [x for x in blocks[0].kids if not is_template(x, known)]
        found = [] if not keep or only_message(keep) else body_of_plain(keep, known, None)
        return [(0, -1, 1, found)] if found else []
    out = []
    for b in blocks[1:]:
        slot = slots.get(b.no, -1)
        known = constant(slot)
        xs = [k for k in b.kids if k.__class__ is Line and not is_template(k, known)]
        if xs:
            score = sum(prose_words(x) + (3 if x.tag in ("h1", "pre") else 0) for x in xs)
            out.append((b.no, slot, score, [] if only_message(xs) else [x.no for x in xs]))
    return out


def slug_words(url: str | None) -> list[str]:
    path = _parts(url)[1].rstrip("/").rpartition("/")[2]
    words = [w for w in re.split(r"[-_.]+", _fold(path)) if w]
    return words[:-1] if words and words[-1].isdigit() else words


def _fold(t: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", t.lower()) if not unicodedata.combining(c))


def _is_title(text: str, slug: list[str]) -> bool:
    """Whether the slug's words begin the text, as far as the slug kept them."""
    if len(slug) < 2:
        return False
    # addresses fold letters with marks, or drop them
    return any(re.findall(r"[a-z0-9]+", t)[: len(slug)] == slug for t in (_fold(text), text.lower()))


def body_of_plain(lines: list[Line], constant, url: str | None) -> list[int]:
    """Line numbers of the body of a text without markup: from the title line, without template lines, to the first
    list of foreign titles."""
    crumb = ""
    for x in lines:
        if is_template(x, constant):
            x.kind = "template"
            if _CRUMB.match(x.text) and not crumb:
                crumb = re.split(r"\s[>›»/→]\s", x.text)[-1].strip(" .…")
        elif x.bare or _CODE.search(x.text):
            x.kind = "code"
        elif _MEASURED.match(x.text) or _VALUED.match(x.text):
            x.kind = "spec"
        elif x.tag == "*" or (x.words >= 4 and _PROSE_END.search(x.text) and not (x.words <= 3)):
            x.kind = "prose"
        else:
            x.kind = "title"
    own = [i for i, x in enumerate(lines) if x.kind != "template"]
    if not own:
        return []
    slug = [w for w in slug_words(url)]
    start = next((i for i in own if _is_title(lines[i].text, slug)), None)
    if start is None and len(crumb) > 3:
        start = next((i for i in own if lines[i].text.startswith(crumb)), None)
    if start is None:
        first = next((i for i in own if lines[i].kind != "title"), None)
        run = []
        i = (len(lines) if first is None else first) - 1
        back = i
        while back >= 0 and lines[back].kind == "template":
            back -= 1
        if first is not None and 0 <= back < i and lines[back].kind == "title" and (back == 0 or lines[back - 1].kind == "template"):
            i = back  # a title alone, with inserts between it and the text; foreign titles come in runs
        while i >= 0 and lines[i].kind == "title":
            run.append(i)
            i -= 1
        if first is None:
            start = own[0] if len(own) <= 2 else len(lines)
        elif not run:
            start = first
        else:
            start = run[1] if len(run) > 1 and (lines[run[0]].text.endswith(".") or len(run) == 2) else run[0]
    out: list[Line] = []
    i = start
    while i < len(lines):
        x = lines[i]
        titles = 0
        while i + titles < len(lines) and lines[i + titles].kind == "title" and (titles == 0 or lines[i + titles].block == x.block):
            titles += 1
        after_head = i > start and lines[i - 1].kind == "template"
        if i > start and (titles >= 3 or (titles == 2 and after_head and out)):
            # a run that ends in prose is a subheading below the title; foreign titles come in runs
            if not (i == start + 1 and titles == 2):
                break
        if x.kind != "template":
            out.append(x)
        i += 1
    return [] if only_message(out) else [x.no for x in out]


# -- over the tables -------------------------------------------------------------------------------------------------

_ANY = 0  # the slot of a line wherever it stands
PARSED = "src string, rec_id string, url string, host string, address bigint, layout string, tree binary, slots array<bigint>, keys array<bigint>"


def _address(url: str | None) -> str:
    host, path = _parts(url)
    return host + path.rstrip("/").lower() if host else url or ""


def _keys(lines: list[Line]) -> set[int]:
    """The keys of lines, of their frames, and of the items of lines that list several: of two items both say the line unless it is a
    breadcrumb, for label and value of a specification repeat too."""
    found = {x.key for x in lines}
    for x in lines:
        if len(items := [i for i in _ITEMS.split(x.mask) if i]) >= 3 or (len(items) == 2 and is_crumb(x)):
            found.update(map(key, items))
        if f := frame(x.mask):
            found.add(key(f))
    return found


def _slices(batches: Iterator[pa.RecordBatch], most: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in pieces: what Python holds at once is bounded by a few hundred pages, however many rows a batch has."""
    for b in batches:
        for at in range(0, b.num_rows, most):
            yield b.slice(at, most)


def _batch(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(schema)], [n for n, _ in schema])


_STR, _INT, _INTS = pa.string(), pa.int64(), pa.list_(pa.int64())
_PARSED = [("src", _STR), ("rec_id", _STR), ("url", _STR), ("host", _STR), ("address", _INT), ("layout", _STR), ("tree", pa.binary()), ("slots", _INTS), ("keys", _INTS)]


def parsed(docs: DataFrame) -> DataFrame:
    """Every text read once: its tree as bytes, its layout if it has containers, and the keys of its lines if it has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            out = []
            for src, rec, url, text in zip(*(c.to_pylist() for c in b.columns)):
                host = host_of(url)
                if is_html(text):
                    blocks = parse_html(text, host)
                    shape = layout(blocks) if len(blocks) > 1 else None
                else:
                    blocks, shape = [Block("", None, 0)], None
                    blocks[0].kids = parse_plain(text, host)
                keys = sorted(_keys(blocks[0].kids)) if shape is None else []
                data = pack(blocks) if blocks[0].label else pickle.dumps([(x.no, x.text, x.tag, x.mask, x.key, x.bare, x.block) for x in blocks[0].kids], 5)
                out.append((src, rec, url, host, key(_address(url)), shape, data, [_ANY] * len(keys), keys))
            yield _batch(out, _PARSED)

    return docs.select("src", "rec_id", "url", "text").mapInArrow(run, PARSED)


def references(pages: DataFrame, layouts: int = 3) -> DataFrame:
    """(host, references): per host the trees of one page of each of its `layouts` commonest layouts, of equals the
    smallest id."""
    per = pages.filter("layout IS NOT NULL").groupBy("host", F.xxhash64("layout").alias("shape")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rec_id", "src")).alias("first"))
    top = per.withColumn("r", F.row_number().over(W.partitionBy("host").orderBy(F.desc("n"), "shape"))).filter(F.col("r") <= layouts)
    top = top.select(F.col("host").alias("_host"), "r", F.col("first.rec_id").alias("_rec"), F.col("first.src").alias("_src"), "shape")
    trees = pages.join(top, (F.col("host") == F.col("_host")) & (F.col("rec_id") == F.col("_rec")) & (F.col("src") == F.col("_src")) & (F.xxhash64("layout") == F.col("shape")))
    trees = trees.groupBy("host", "r").agg(F.min("tree").alias("tree"))
    return trees.groupBy(F.col("host").alias("_host")).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "tree"))), lambda x: x["tree"]).alias("references"))


def _places(blocks: list[Block]) -> list[int]:
    """A number for the place of each container: its labels from the body down, counted among equal siblings."""
    names = [""] * len(blocks)
    for b in blocks[1:]:
        same = [k for k in b.up.kids if k.__class__ is Block and k.label == b.label]
        names[b.no] = f"{names[b.up.no]}/{b.label}[{same.index(b)}]"
    return [key(n) or 1 for n in names]


def aligned(pages: DataFrame, wrapper: DataFrame) -> DataFrame:
    """Pages with containers, aligned to the reference of their host that fits best: its own layout's, else that of the
    heaviest matching. slots and keys: the aligned place and key of every line. The tree is kept with the places of its
    containers. A wrapper is a row per host, so a hot host is no hot key: AQE broadcasts while wrappers are small and
    splits skewed partitions otherwise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list] = {}
        for b in _slices(batches):
            out = []
            for src, rec, url, host, address, shape, data, refs in zip(*(c.to_pylist() for c in b.columns)):
                if host not in known:
                    known[host] = [(layout(t), t, _places(t)) for t in map(unpack, refs or [])]
                blocks = unpack(data)
                refs_ = known[host]
                best = next((r for r in refs_ if r[0] == shape), None)
                if best is None and refs_:
                    best = max(refs_, key=lambda r: match(blocks[0], r[1][0])[0])
                place = dict.fromkeys(range(len(blocks)), -1)
                if best:
                    place |= {i: best[2][j] for i, j in match(blocks[0], best[1][0], True)[1] if i}
                slots, keys = [], []
                for x in blocks:
                    for k in _keys([k for k in x.kids if k.__class__ is Line]):
                        slots.append(place[x.no])
                        keys.append(k)
                out.append((src, rec, url, host, address, shape, pickle.dumps((place, data), 5), slots, keys))
            yield _batch(out, _PARSED)

    both = pages.filter("layout IS NOT NULL").join(wrapper, F.col("host") == F.col("_host"), "left")
    return both.select("src", "rec_id", "url", "host", "address", "layout", "tree", "references").mapInArrow(run, PARSED)


def constants(texts: DataFrame, host_share: float = 0.04, corpus_share: float = 0.004, least: int = 4, most_common: int = 1_000_000) -> tuple[DataFrame, list[int]]:
    """(host, places): what is constant: at an aligned place of a host, the lines with the same text and place on `host_share` of
    the addresses that have the place; anywhere on a host, on that share of its addresses; and, as a list, the lines on
    `corpus_share` of all addresses; on `least` addresses each. Counted over all texts. A place has at most (lines per text /
    host_share) constants, the corpus (lines per text / corpus_share), whatever the number of pages; more than
    most_common of the latter raise ValueError. An address counts once, and is combined before it is shuffled."""
    each = texts.select(F.xxhash64("host").alias("h"), "address", F.explode(F.arrays_zip("slots", "keys")).alias("x")).select("h", "address", F.col("x.slots").alias("slot"), F.col("x.keys").alias("key"))
    anywhere = each.select("h", "address", F.lit(_ANY).cast("bigint").alias("slot"), "key").unionAll(texts.select(F.xxhash64("host"), "address", F.lit(_ANY).cast("bigint"), F.lit(0).cast("bigint")))
    at = each.filter((F.col("slot") != _ANY) & (F.col("slot") != -1))
    # the places themselves, as key 0
    places = texts.select(F.xxhash64("host").alias("h"), "address", F.explode(F.array_distinct("slots")).alias("slot")).filter((F.col("slot") != _ANY) & (F.col("slot") != -1)).select("h", "address", "slot", F.lit(0).cast("bigint").alias("key"))
    once = anywhere.unionAll(at.select("h", "address", "slot", "key")).unionAll(places).distinct()
    n = stage(once.groupBy("h", "slot", "key").agg(F.count(F.lit(1)).alias("n")), "lines")
    total = n.filter("key = 0").select(F.col("h").alias("_h"), F.col("slot").alias("_s"), F.col("n").alias("_all"))
    often = n.filter((F.col("key") != 0) & (F.col("n") >= least)).join(total, (F.col("h") == F.col("_h")) & (F.col("slot") == F.col("_s"))).filter(F.col("n") >= host_share * F.col("_all"))
    by_host = often.groupBy("h", "slot").agg(F.collect_set("key").alias("keys")).groupBy("h").agg(F.collect_list(F.struct("slot", "keys")).alias("places"))
    whole = n.filter(F.col("slot") == _ANY).groupBy("key").agg(F.sum("n").alias("n"))
    total = whole.filter("key = 0").select("n").first()  # key 0 counts the addresses themselves
    by_host = stage(by_host, "constants")
    if total is None:
        return by_host, []
    common = whole.filter((F.col("key") != 0) & (F.col("n") >= max(least, corpus_share * total["n"]))).select("key").limit(most_common + 1).collect()
    if len(common) > most_common:
        raise ValueError(f"more than {most_common} lines are constant over the corpus")
    return by_host, [r["key"] for r in common]


def main_body(docs: DataFrame, plain_rule: bool = True, layouts: int = 3, **options: float) -> DataFrame:
    """(src, rec_id, line_no): the lines of the body of each text. docs: src, rec_id, url, text, and `page` BOOLEAN: whether
    the text is a fetched page. Lines count from 1, empty ones too.

    plain_rule: texts without a tree are read by `body_of_plain`; else they are aligned as sequences of lines, which leaves
    all lines that are not constant. Null and empty texts have no lines; a null url has no host, so only corpus-wide
    constants apply; error pages and notices have no body; repeated rows count once; hosts with few pages use the
    corpus' constants and each page's own best block. options: host_share, corpus_share, least of `constants`."""
    docs = docs.filter(F.length("text") > 0).select("src", "rec_id", "url", "text")
    read = stage(parsed(docs), "parsed")
    # wrappers are written first: their size is then known, and while it is small no page is shuffled for them
    pages = stage(aligned(read, stage(references(read, layouts), "references")), "aligned")
    texts = read.filter("layout IS NULL").unionAll(pages)
    by_host, everywhere = constants(texts, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = frozenset(everywhere)
        hosts: dict[str, dict] = {}
        for b in _slices(batches):
            out: list[tuple] = []
            for src, rec, url, host, shape, data, places in zip(*(c.to_pylist() for c in b.columns)):
                if host not in hosts:
                    hosts[host] = {p["slot"]: p["keys"] for p in places or []}
                    hosts[host][_ANY] = common.union(hosts[host].get(_ANY, ()))
                    hosts[host][-1] = hosts[host][_ANY]
                known = hosts[host]

                def constant(slot: int, known: dict = known) -> frozenset:
                    got = known.get(slot)
                    if got is None or isinstance(got, list):
                        got = known[slot] = known[_ANY].union(got or ())
                    return got

                if shape is not None:
                    place, tree = pickle.loads(data)
                    out += [(src, rec, host, *x) for x in blocks_of_html(unpack(tree), place, constant)]
                    continue
                rows = pickle.loads(data)
                if rows and len(rows[0]) == 3:  # markup without containers
                    out += [(src, rec, host, *x) for x in blocks_of_html(unpack(data), {}, constant)]
                    continue
                lines = [Line.of(r[:6], r[6]) for r in rows]
                if plain_rule:
                    numbers = body_of_plain(lines, constant(-1), url)
                else:
                    kept = [x for x in lines if not is_template(x, constant(-1))]
                    numbers = [] if only_message(kept) else [x.no for x in kept]
                if numbers:
                    out.append((src, rec, host, 0, -1, 1, numbers))
            yield _batch(out, [("src", _STR), ("rec_id", _STR), ("host", _STR), ("block", pa.int32()), ("slot", _INT), ("score", pa.int32()), ("lines", pa.list_(pa.int32()))])

    asked = texts.select("src", "rec_id", "url", "host", "layout", "tree").join(by_host, F.xxhash64("host") == F.col("h"), "left")
    asked = asked.select("src", "rec_id", "url", "host", "layout", "tree", "places")
    found = stage(asked.mapInArrow(run, "src string, rec_id string, host string, block int, slot bigint, score int, lines array<int>"), "blocks")
    # the host's main place holds the most running text over all its aligned pages
    main = found.filter("slot <> -1").groupBy("host", "slot").agg(F.sum("score").alias("n")).groupBy(F.col("host").alias("_host")).agg(F.max_by("slot", F.struct("n", "slot")).alias("_main"))
    rows = found.join(main, F.col("host") == F.col("_host"), "left")
    # a page whose aligned main place holds less than half of what its fullest block does is not built like its reference
    fullest, mine = F.struct("score", -F.col("block")), F.when((F.col("slot") == F.col("_main")) & (F.col("score") > 0), F.struct("score", -F.col("block")))
    best = rows.groupBy("src", "rec_id").agg(F.max("score").alias("s"), F.max_by("lines", fullest).alias("f"), F.max(F.when(F.col("slot") == F.col("_main"), F.col("score"))).alias("t"), F.max_by("lines", mine).alias("m"))
    best = best.select("src", "rec_id", F.when(2 * F.col("t") >= F.col("s"), F.coalesce("m", "f")).otherwise(F.col("f")).alias("lines"))
    return best.select("src", "rec_id", F.explode("lines").alias("n")).select("src", "rec_id", F.col("n").cast("bigint").alias("line_no"))
