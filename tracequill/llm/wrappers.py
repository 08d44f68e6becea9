"""Main-text extraction with wrappers inferred from the pages of a host.

A page becomes a stream of tags and texts. Repeated neighbours fold into repeated groups, so a page is a
union-free regular expression over its tokens. The wrapper of a host starts as its first page and is
aligned with one page after another: texts that differ become slots, tokens that one side lacks become optional
groups, groups that repeat absorb their repetitions. Tasks fold their own pages per host; the partial wrappers
of a host are folded again in two levels, so a host with very many pages is no bottleneck. All pages count.

Each text token of a wrapper knows the region of the page it stands in. Texts within an article (or main
part) are content. Of a page that has none, the texts outside are, but for those of the template: texts and groups
that two or more unlike pages have alike at the same place of the wrapper. Extraction aligns such a page with its host's
wrapper to tell them; slots and what only this page has stay. Menus, headers, footers, side bars, adverts, notices,
forms, comments, scripts and styles never are content.

Null and empty html give an empty text. Repeated rows give a row each. A page without a host (null or odd url)
belongs to the empty host. An unfinished tag or comment at the end is dropped, an unfinished element ends with the page. An empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import json
import math
import re
from collections import defaultdict

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequill.llm.bpe import slices
from tracequill.llm.common import ship, written

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|</?[a-zA-Z](?:[^>"']|"[^"]*"|'[^']*')*\Z|[^<]+|<""", re.S)
_NAMES = re.compile(r"""(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_CLASSES = re.compile(_NAMES.pattern.replace("class|id|role", "class|role"), re.I)
#: Elements whose content is no text of the page, elements and names of what stands around an article, inline and void elements.
RAW = frozenset("script style noscript template title textarea svg iframe object select math".split())
_RAW_END = {x: re.compile(rf"</{x}(?=[\s/>]|\Z)", re.I) for x in RAW}
AROUND = frozenset("head nav header footer aside form button dialog menu".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROOTS = frozenset("article main".split())
AROUND_NAMES = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|header|footer|sidebar|side|aside|comments?|repl(?:y|ies)|respond|disqus|cookies?|consent|gdpr|notices?|alert|newsletter|subscribe|signup|login|share|sharing|social|related|recommend\w*|widget|popup|modal|overlay|toolbar|pagination|pager|copyright|search|contentinfo|complementary|navigation|banner)(?:$|[\s_-])", re.I)
ROOT_NAMES = re.compile(r"(?:^|\s)(?:main|article|articlebody|main-content|article-body|post-content|entry-content)(?:$|\s)", re.I)
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Longest repeated group, in tokens.
PERIOD = 24


def tokens(page: str):
    """(tag name or "", region, text): region is c within an article, o without one, b around it; a tag's text is its sign."""
    open_: list[list] = []  # [name, region, depth] of the elements that change the region
    region, at = "o", 0
    while at < len(page):
        m = _TOKEN.match(page, at)
        at = m.end()
        name = m[2]
        if name is None:
            t = m[0]
            if t[0] == "<" and len(t) > 1:
                continue
            yield "", region, t
            continue
        name = name.lower()
        if m[1]:
            if name in RAW:
                continue
            for i in range(len(open_) - 1, -1, -1):
                if open_[i][0] == name:
                    open_[i][2] -= 1
                    del open_[i + 1 :]
                    if not open_[i][2]:
                        open_.pop()
                    region = open_[-1][1] if open_ else "o"
                    break
            yield name, region, f"</{name}>"
            continue
        closed = m[3].endswith("/") or name in VOID
        if name in RAW:
            if not closed:  # what it holds is no markup
                end = _RAW_END[name].search(page, at)
                at = end.start() if end else len(page)
            continue
        names = ""
        if "=" in m[3] and not (region == "c" and name in HEADINGS):  # an article's headings are its own, and ids of its sections name their subjects
            names = " ".join(x.strip("\"'") for x in (_CLASSES if region == "c" and name == "section" else _NAMES).findall(m[3]))
        now = region
        if name in AROUND or names and name not in ("body", "html") and name not in ROOTS and AROUND_NAMES.search(names):
            now = "b"
        elif name in ROOTS or names and ROOT_NAMES.search(names):
            now = region if region == "b" else "c"
        if not closed:
            if now != region or name in AROUND or name in ROOTS:
                open_.append([name, now, 1])
                region = now
            elif open_ and open_[-1][0] == name:
                open_[-1][2] += 1
        yield name, region, f"<{name}>"


def fold(signs: list[str]) -> list:
    """Signs with runs of repeated neighbours as ("+", items): the union-free expression of one page, and each item's tokens."""
    out, i, n = [], 0, len(signs)
    while i < n:
        best = 0
        if signs[i][0] == "<" and signs[i][1] != "/":
            for p in range(1, min(PERIOD, (n - i) // 2) + 1):
                if signs[i] == signs[i + p] and signs[i : i + p] == signs[i + p : i + 2 * p]:
                    best = p
                    break
        if best:
            j = i + best
            while signs[j : j + best] == signs[i : i + best]:
                j += best
            out.append(["+", [["t", s, None] for s in signs[i : i + best]], i, j])
            i = j
        else:
            out.append(["t", signs[i], i])
            i += 1
    return out


def expression(page: str) -> tuple[list, list]:
    """The page's items and its tokens. Texts outside groups carry their text, groups a hash of their texts, both the page they were seen on."""
    return _read(page)[:2]


def _read(page: str) -> tuple[list, list, list[tuple[int, int]]]:
    """The page's items, its tokens, and the tokens of each item."""
    toks = list(tokens(page))
    toks = [t for t in toks if t[0] or not t[2].isspace()]
    items = fold([f"#{r}" if not name else text for name, r, text in toks])
    who = _hash(page)
    spans = []
    for x in items:
        if x[0] == "t":
            spans.append((x[2], x[2] + 1))
            x[2:] = [toks[x[2]][2].strip(), who] if x[1][0] == "#" else [None]
        else:
            i, j = x[2:]
            spans.append((i, j))
            texts = [t.strip() for name, _, t in toks[i:j] if not name]
            x[2:] = [_hash("\0".join(texts)) if texts else None, who]
    return items, toks, spans


def _hash(text: str) -> int:
    """Of six bytes, and never 0: that stands for several pages."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=6).digest(), "big") + 1


def key(item: list) -> str:
    """What must be equal for two items to align; an optional group aligns as what it holds."""
    if item[0] == "t":
        return item[1]
    if item[0] == "+":
        return "+(" + "".join(key(x) for x in item[1]) + ")"
    return "".join(key(x) for x in item[1])


def _flat(wrapper: list) -> list[tuple[list, bool]]:
    """Items with their optional flag; optional groups are opened."""
    out = []
    for x in wrapper:
        if x[0] == "?":
            out += [(y, True) for y in x[1]]
        else:
            out.append((x, False))
    return out


def _matching(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence of two lists of keys, equal ends first."""
    begin = 0
    while begin < min(len(a), len(b)) and a[begin] == b[begin]:
        begin += 1
    end = 0
    while end < min(len(a), len(b)) - begin and a[-1 - end] == b[-1 - end]:
        end += 1
    inner = _longest(a[begin : len(a) - end], b[begin : len(b) - end])
    return [*((k, k) for k in range(begin)), *((begin + i, begin + j) for i, j in inner), *((len(a) - k, len(b) - k) for k in range(end, 0, -1))]


def _longest(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """The pairs of a longest common subsequence.

    With best(i, j) the length of one of x[i:] and y[j:], a row i is a number: its bit len(y) - 1 - j tells whether best(i, j) is one more than
    best(i, j + 1), and a row follows from the one below by a few operations on whole numbers. Of the rows only every
    so many are kept and those between made again on the way, so memory grows with len(y) times the root of len(x).
    """
    n, m = len(x), len(y)
    if not n or not m:
        return []
    full = (1 << m) - 1
    wanted = set(x)
    places: dict[str, list[int]] = defaultdict(list)
    for j, v in enumerate(reversed(y)):
        if v in wanted:
            places[v].append(j)
    often: dict[str, int] = {}  # at most the root of m

    def mask(v: str) -> int:
        """The bits of y's places that hold v."""
        if v not in places:
            return 0
        if v in often:
            return often[v]
        bits = bytearray(m + 7 >> 3)
        for j in places[v]:
            bits[j >> 3] |= 1 << (j & 7)
        out = int.from_bytes(bits, "little")
        if len(places[v]) > math.isqrt(m):
            often[v] = out
        return out

    def above(row: int, i: int) -> int:
        """Row i from row i + 1."""
        flat = full ^ row
        both = flat & mask(x[i])
        return full ^ ((flat + both | flat - both) & full)

    step = math.isqrt(n) + 1
    kept, row = {n: 0}, 0
    for i in range(n - 1, -1, -1):
        row = above(row, i)
        if i % step == 0:
            kept[i] = row
    pairs, i, j = [], 0, 0
    rows: dict[int, int] = {}
    while i < n and j < m:
        if i not in rows or i + 1 not in rows:
            low = min(n, (i // step + 1) * step)
            rows = {low: kept[low]}
            for k in range(low - 1, i - 1, -1):
                rows[k] = above(rows[k + 1], k)
        here, below = rows[i], rows[i + 1]
        left = (1 << m - j) - 1
        best, under = (here & left).bit_count(), (below & left).bit_count()
        if x[i] != y[j] and under < best:
            one, two = here.to_bytes(m + 7 >> 3, "little"), below.to_bytes(m + 7 >> 3, "little")
            while j < m and x[i] != y[j] and under < best:  # without x[i] less is left
                at, bit = m - 1 - j >> 3, m - 1 - j & 7
                best -= one[at] >> bit & 1
                under -= two[at] >> bit & 1
                j += 1
        if j < m and x[i] == y[j]:
            pairs.append((i, j))
            j += 1
        i += 1
    return pairs


def _merged(one: list, two: list) -> list:
    """The item that covers both: a slot if their texts differ; seen on several pages (0) unless both are of the same one."""
    if one[0] == "t" and one[1][0] != "#":
        return one
    return [one[0], one[1], one[2] if one[2] == two[2] else None, one[3] if one[3] == two[3] else 0]


def _gap(a: list[tuple[list, bool]], b: list[tuple[list, bool]]) -> list[tuple[list, bool]]:
    """What has no partner by key, as optional, but for a group that stands on one side where the other has its tokens once."""
    for one, two, swapped in ((a, b, False), (b, a, True)):
        for p, (item, optional) in enumerate(one):
            if item[0] != "+":
                continue
            body, n = [x[1] for x in item[1]], len(item[1])
            for q in range(len(two) - n + 1):
                if two[q][0][1] == body[0] and [x[1] for x, _ in two[q : q + n]] == body:
                    met = (["+", item[1], None, 0], optional or any(o for _, o in two[q : q + n]))
                    sides = (one[:p], two[:q], one[p + 1 :], two[q + n :])
                    l1, l2, r1, r2 = (sides[1], sides[0], sides[3], sides[2]) if swapped else sides
                    return [*_gap(l1, l2), met, *_gap(r1, r2)]
    return [(w, True) for w, _ in a] + [(w, True) for w, _ in b]


def align(wrapper: list, page: list) -> list:
    """The wrapper that covers both: differing texts become slots, what one side lacks optional groups; repetitions beside a group of their kind join it."""
    a, b = _flat(wrapper), _flat(page)
    out: list[tuple[list, bool]] = []
    i = j = 0
    for x, y in [*_matching([key(w[0]) for w in a], [key(w[0]) for w in b]), (len(a), len(b))]:
        out += _gap(a[i:x], b[j:y])
        if x < len(a):
            one, two = a[x], b[y]
            out.append((_merged(one[0], two[0]), one[1] or two[1]))
        i, j = x + 1, y + 1
    out = _absorb(out)
    folded: list = []
    for item, optional in out:
        if not optional:
            folded.append(item)
        elif folded and folded[-1][0] == "?":
            folded[-1][1].append(item)
        else:
            folded.append(["?", [item]])
    return folded


def _absorb(items: list[tuple[list, bool]]) -> list[tuple[list, bool]]:
    """Drops single repetitions that stand next to a repeated group of the same tokens: the group covers them."""
    out: list[tuple[list, bool]] = []
    i = 0
    while i < len(items):
        item, optional = items[i]
        if item[0] == "+":
            body = [x[1] for x in item[1]]
            n = len(body)
            while len(out) >= n and [x[0][1] if x[0][0] == "t" else None for x in out[-n:]] == body:
                optional = optional and all(x[1] for x in out[-n:])
                item = ["+", item[1], None, 0]
                del out[-n:]
            if out and key(out[-1][0]) == key(item):
                before, also = out.pop()
                item, optional = _merged(item, before), optional and also
            i += 1
            while [x[0][1] if x[0][0] == "t" else None for x in items[i : i + n]] == body:
                item = ["+", item[1], None, 0]
                i += n
            out.append((item, optional))
            continue
        out.append((item, optional))
        i += 1
    return out


def template(items: list, flat: list[tuple[list, bool]], keys: list[str]) -> set[int]:
    """Which of a page's items the template holds: their place in the wrapper (its items and their keys) has the same text on several pages."""
    out = set()
    for x, y in _matching(keys, [key(w) for w in items]):
        place, own = flat[x][0], items[y]
        if len(place) > 3 and place[3] == 0 and place[2] is not None and place[2] == own[2]:
            out.add(y)
    return out


def opened(wrapper: list) -> tuple[list[tuple[list, bool]], list[str]]:
    """A wrapper's items, optional groups opened, and their keys."""
    flat = _flat(wrapper)
    return flat, [key(w) for w, _ in flat]


def main_text(page: str, wrapper: tuple | None) -> str:
    """The texts at the content places of the (opened) wrapper, block by block."""
    items, toks, spans = _read(page)
    within = any(not name and region == "c" for name, region, _ in toks)
    content = "c" if within else "o"
    constant: set[int] = set()  # tokens of the template
    if not within and wrapper is not None:
        constant = {t for x in template(items, *wrapper) for t in range(*spans[x])}
    blocks, now = [], []
    for at, (name, region, text) in enumerate(toks):
        if name:
            if name not in INLINE:
                blocks.append("".join(now))
                now = []
        elif region == content and at not in constant:
            now.append(text)
    blocks.append("".join(now))
    clean = (" ".join(html_lib.unescape(b).split()) for b in blocks)
    return " ".join(b for b in clean if b)


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.nullif(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1), F.lit(""))), F.lit(""))


def infer(pages: DataFrame, url_col: str = "url", html_col: str = "html", salts: int = 16) -> DataFrame:
    """host, wrapper (JSON), pages (how many it was aligned with)."""
    ship(pages.sparkSession)
    schema = "host string, wrapper string, pages long"
    rows = pages.select(host_of(pages[url_col]).alias("host"), pages[html_col].cast("string").alias("html"))

    def partial(batches):
        wrappers: dict[str, list] = {}
        count: dict[str, int] = defaultdict(int)
        seen: dict[str, dict[str, tuple[list, int]]] = defaultdict(dict)

        def flush():
            out = pa.RecordBatch.from_pydict({"host": list(wrappers), "wrapper": [json.dumps(w) for w in wrappers.values()], "pages": [count[h] for h in wrappers]}, schema=pa.schema([("host", pa.string()), ("wrapper", pa.string()), ("pages", pa.int64())]))
            wrappers.clear()
            count.clear()
            seen.clear()
            return out

        for b in batches:
            for s in slices(b):
                for host, page in zip(s.column(0).to_pylist(), s.column(1).to_pylist(), strict=True):
                    items, _ = expression(page or "")
                    count[host] += 1
                    shape = "".join(map(key, items))
                    texts, who = [x[2] for x in items], _hash(page or "")
                    known = seen[host].get(shape)
                    if known is not None and known[1] in (0, who) and all(k is None or k == t for k, t in zip(known[0], texts, strict=True)):
                        continue  # the wrapper covers this page already
                    if known is not None:
                        seen[host][shape] = [k if k == t else None for k, t in zip(known[0], texts, strict=True)], known[1] if known[1] == who else 0
                    elif len(seen[host]) < 1000:
                        seen[host][shape] = texts, who
                    wrappers[host] = align(wrappers[host], items) if host in wrappers else items
                if len(wrappers) > 5000:
                    yield flush()
        if wrappers:
            yield flush()

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = None
        for w in pdf["wrapper"].sort_values():
            whole = json.loads(w) if whole is None else align(whole, json.loads(w))
        return pd.DataFrame({"host": pdf["host"].iloc[:1].tolist(), "wrapper": [json.dumps(whole)], "pages": [int(pdf["pages"].sum())]})

    some = rows.mapInArrow(partial, schema).withColumn("salt", F.pmod(F.hash("wrapper"), F.lit(salts)))
    halfway = some.groupBy("host", "salt").applyInPandas(join, schema)
    return halfway.groupBy("host").applyInPandas(join, schema)


def extract(pages: DataFrame, wrappers: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text. The wrappers are joined by host: broadcast by Spark if it finds them small, else by a shuffle that splits hot hosts."""
    wrappers = wrappers if wrappers is not None else written(infer(pages, url_col, html_col), "wrappers")
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html"), host_of(pages[url_col]).alias("_host"))
    both = rows.join(wrappers.select(F.col("host").alias("_host"), "wrapper"), "_host", "left").select("page_id", "url", "html", "wrapper")

    def run(batches):
        parsed: dict[str, tuple] = {}
        for b in batches:
            for s in slices(b, column=2):
                out = []
                for page, raw in zip(*(s.column(i).to_pylist() for i in (2, 3)), strict=True):
                    if raw is not None and raw not in parsed:
                        if len(parsed) > 500:
                            parsed.clear()
                        parsed[raw] = opened(json.loads(raw))
                    out.append(main_text(page or "", parsed[raw] if raw is not None else None))
                yield pa.RecordBatch.from_arrays([s.column(0), s.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])

    return both.mapInArrow(run, "page_id long, url string, text string")
