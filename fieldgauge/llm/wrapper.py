"""Main text of web pages by wrappers inferred per host.

A page becomes a stream of text blocks, each named by the path of block elements above it. Pages of a
host are aligned one after another with the host's wrapper, a regular expression without unions over
these names: a name, or a group of names, that repeats becomes ``+``, one that only some pages have
becomes ``?``. Different shapes of a host are aligned in shards in the order of their text, and the shards
likewise, so the expression does not depend on tasks and a host with a third of all pages is never gathered.

Every page is then matched against the expression of its host, and the place of a block in it is its
slot, whose texts are counted over the different pages of the host; copies count once. Content are the slots with varying texts outside links,
required, repeated or optional alike, as a section that only some articles have is text; slots with
one text on three different pages or more and slots of links are template. Those below menus, headers, footers
and hidden elements are not read. Those below a form or an element with a class word for sidebars,
notices, adverts or comments are not read either, unless it holds more than half of the letters
in varying slots outside links of the pages it is on (comments never do), or the page has no other text: then
articles below it come first. Where an article element, else a main
element, else a container named as content holds at least half of a page's content, only that is read;
slots on fewer than three pages do not count against it.

Defined cases: null or empty html gives an empty text; broken or cut markup is read as far as it goes;
a drawing inside a paragraph ends it; a heading that an article keeps in a header element of its own is
not read; very long pages are read whole; repeated rows give repeated rows; a null or unreadable url is a host of its own name; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from difflib import SequenceMatcher
from hashlib import blake2b
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldgauge.session import cut

# Element names of HTML and words used to name page parts.
BLOCKS = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe xmp noembed noframes".split())
SILENT = RAW | set("head svg math canvas audio video object button select option datalist label".split())
APART = set("nav header footer aside menu search dialog".split())
FORMS = set("form fieldset".split())
CLOSES = {  # a start tag that ends open elements of these names
    "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"},
    "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"},
}
SCOPES = set("ul ol dl table tr div section article main body td th".split())
ASIDE_WORDS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored banner promo promotion cookie cookies consent gdpr notice "
    "notices alert popup modal overlay newsletter subscribe subscription comment comments disqus reply replies respond discussion sidebar "
    "widget widgets menu nav navbar navigation navi breadcrumb breadcrumbs pagination pager share sharing social related recommended "
    "recommendations footer header masthead topbar login signup search form skip copyright legal".split()
)
COMMENT_WORDS = set("comment comments reply replies related teaser promo ad ads advert".split())
TALK_WORDS = set("comment comments disqus reply replies respond discussion".split())
CONTENT_WORDS = set("content main article post entry story articlebody maincontent".split())

# A tag's attributes by the states of the HTML tokenizer: a quote opens a value only straight after ``=``; elsewhere it is
# part of a name or of an unquoted value. A quote that never closes opens nothing, so that no text is lost to it.
TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[\s/]+|[^\s/>][^\s/>=]*(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]*))?)*)(?:>|\Z)"
    r"|[^<]+|<",
    re.S,
)
NAMES = re.compile(r"\b(class|id|role|itemprop|hidden|style|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
VETOES = ("!", "~", "^")  # by element or hidden; by a class word or form; by a word for comments
FEW = 6


def _step(tag: str, attributes: str) -> str:
    """The part of a path an element adds: its name, a flag and its classes without digits."""
    said = {}
    if attributes.strip():
        for m in NAMES.finditer(attributes):
            said.setdefault(m[1].lower(), (m[2] or "").strip("\"'").lower())
    names = [w for k in ("class", "id", "role", "itemprop") for w in re.split(r"[^a-z]+", said.get(k, "")) if w]
    hidden = "hidden" in said or said.get("aria-hidden") == "true" or "display:none" in said.get("style", "").replace(" ", "")
    flag = ""
    if hidden or tag in APART:
        flag = "!"
    elif tag in ("article", "main"):
        flag = "^" if COMMENT_WORDS & set(names) else "@" if tag == "article" else "%"
    elif tag in FORMS or tag not in ("html", "body") and not tag[1:].isdigit() and ASIDE_WORDS & set(names):
        flag = "^" if TALK_WORDS & set(names) else "~"
    elif said.get("role") == "main" or "articlebody" in names:
        flag = "%"
    elif CONTENT_WORDS & set(names):
        flag = "*"
    return tag + flag + ("." + ".".join(sorted(set(names))) if names else "")


def blocks(page: str) -> Iterator[tuple[str, str, int]]:
    """(path, text, letters inside links) of each text block in page order."""
    open_: list[tuple[str, str]] = []
    held: list[str] = []
    links = silent = in_link = 0
    position, size = 0, len(page)

    def flush() -> Iterator[tuple[str, str, int]]:
        nonlocal links
        text = " ".join("".join(held).split())
        held.clear()
        linked, links = links, 0
        if text:
            yield "/".join(s for t, s in open_ if t in BLOCKS or s[len(t) : len(t) + 1] in VETOES), text, linked

    def drop(at: int) -> None:
        nonlocal silent, in_link
        for t, _ in open_[at:]:
            silent -= t in SILENT
            in_link -= t == "a"
        del open_[at:]

    while position < size:
        m = TOKEN.match(page, position)
        position = m.end()
        tag = m[2]
        if tag is None:
            piece = m[0]
            if piece[0] != "<" or piece == "<":
                if not silent:
                    plain = html.unescape(piece)
                    held.append(plain)
                    if in_link:
                        links += len(plain.strip())
            continue
        tag = tag.lower()
        boundary = tag in BLOCKS or tag in SILENT
        if boundary:
            yield from flush()
        elif tag in ("br", "td", "th"):
            held.append(" ")
        if m[1]:
            at = next((i for i in range(len(open_) - 1, -1, -1) if open_[i][0] == tag), None)
            if at is not None:
                drop(at)
            continue
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, position)
            position = end.end() if end else size
            continue
        ends = CLOSES.get(tag) or ({"p"} if tag in BLOCKS else ())
        for i in range(len(open_) - 1, -1, -1):
            if open_[i][0] in ends:
                drop(i)
                break
            if open_[i][0] in SCOPES:
                break
        step = _step(tag, m[3])
        if not boundary and step[len(tag) : len(tag) + 1] in VETOES:
            yield from flush()
        if not m[3].rstrip().endswith("/") or tag in BLOCKS:
            open_.append((tag, step))
            silent += tag in SILENT
            in_link += tag == "a"
    yield from flush()


def keys(found: list[tuple[str, str, int]]) -> tuple[int, int]:
    """A hash of what makes a page another one, and one of all blocks.

    Menus, adverts and links do not make a copy another page, unless a page has little else.
    """
    own = [b for b in found if not any(v in b[0] for v in VETOES) and 2 * b[2] < len(b[1])]
    if 2 * sum(len(b[1]) for b in own) < sum(len(b[1]) - b[2] for b in found if "!" not in b[0]):
        own = found
    return tuple(int.from_bytes(blake2b(repr(x).encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True) for x in (own, found))


# ------------------------------------------------------------------------------ wrappers


def fold(names: list[str]) -> list[tuple[tuple[str, ...], str]]:
    """Names with runs that stand again and again made into groups with ``+``, whatever the length of the run.

    At each place the run that covers most names is taken, of equal ones the shortest. For every length the
    names are compared with those that many places further, as whole arrays.
    """
    code = {name: i for i, name in enumerate(dict.fromkeys(names))}
    x = np.array([code[name] for name in names], np.int64)
    size = len(x)
    best = np.zeros(size, np.int64), np.ones(size, np.int64)  # names covered and length of the run
    for n in range(1, size // 2 + 1):
        differs = np.flatnonzero(x[:-n] != x[n:])
        if len(differs) > size - 2 * n:  # fewer than n names equal those n places further
            continue
        ahead = np.append(differs, size - n)
        same = ahead[np.searchsorted(ahead, np.arange(size - n))] - np.arange(size - n)
        covered = np.where(same >= n, same // n * n + n, 0)
        more = covered > best[0][: size - n]
        best[0][: size - n][more], best[1][: size - n][more] = covered[more], n
    out: list[tuple[tuple[str, ...], str]] = []
    i = 0
    while i < size:
        covered, n = int(best[0][i]), int(best[1][i])
        out.append((tuple(names[i : i + n]), "+") if covered else ((names[i],), "1"))
        i += covered or 1
    return out


def _loose(q: str, r: str) -> str:
    """The quantifier that allows both; ``?`` and ``*`` also allow none."""
    many = "+" in (q, r) or "*" in (q, r)
    none = "?" in (q, r) or "*" in (q, r)
    return "*" if many and none else "+" if many else "?" if none else "1"


def align(a: list, b: list) -> list:
    """The expression that covers both: common groups stay, others become optional in their place."""
    if not a or a == b:
        return b
    out: list = []
    keys_a, keys_b = [g for g, _ in a], [g for g, _ in b]
    for what, i, j, k, m in SequenceMatcher(None, keys_a, keys_b, autojunk=False).get_opcodes():
        if what == "equal":
            out += [(g, _loose(q, r)) for (g, q), (_, r) in zip(a[i:j], b[k:m])]
        else:
            out += [(g, _loose(q, "?")) for g, q in a[i:j] + b[k:m]]
    kept: list = []
    for g, q in out:  # neighbours of one name are one repeated slot
        if kept and kept[-1][0] == g:
            kept[-1] = (g, _loose(_loose(kept[-1][1], q), "+"))
        else:
            kept.append((g, q))
    return kept


def load(text: str) -> list:
    return [(tuple(g), q) for g, q in json.loads(text)]


def regex(expr: list) -> str:
    """The expression in the usual notation."""
    return " ".join((f"({' '.join(g)})" if len(g) > 1 else g[0]) + ("" if q == "1" else q) for g, q in expr)


class Matcher:
    """Finds the slot of an expression that each name of a stream stands in; slots are the names of all groups in order."""

    def __init__(self, expr: list):
        self.groups = [g for g, _ in expr]
        self.many = [q in "+*" for _, q in expr]
        self.slots = [n for g in self.groups for n in g]
        self.base = [0, *accumulate(len(g) for g in self.groups)]
        self.starts: dict[str, list[int]] = {}
        for i, g in enumerate(self.groups):
            self.starts.setdefault(g[0], []).append(i)
        self.reach = [len(expr)] * (len(expr) + 1)  # the last group that may come next if groups before i are done
        for i in range(len(expr) - 1, -1, -1):
            self.reach[i] = i if expr[i][1] in "1+" else self.reach[i + 1]
        self.known: dict[tuple[str, ...], list[int]] = {}

    def match(self, names: list[str]) -> list[int]:
        shape = tuple(names)
        if shape not in self.known:
            if len(self.known) > 1000:
                self.known.clear()
            self.known[shape] = self._match(names)
        return self.known[shape]

    def _match(self, names: list[str]) -> list[int]:
        """States are (group, place in it); of several ways the one through the earliest groups is taken."""
        trail: list[dict] = [{(-1, 0): None}]
        for name in names:
            to: dict = {}
            for state in sorted(trail[-1]):
                g, o = state
                if g >= 0 and o + 1 < len(self.groups[g]):
                    if self.groups[g][o + 1] == name:
                        to.setdefault((g, o + 1), state)
                    continue
                if g >= 0 and self.many[g] and self.groups[g][0] == name:
                    to.setdefault((g, 0), state)
                starts = self.starts.get(name, [])
                for h in starts[bisect_right(starts, g) : bisect_right(starts, self.reach[g + 1])]:
                    to.setdefault((h, 0), state)
            if not to:
                raise ValueError("a page outside its host's expression")
            trail.append(to)
        ends = [(g, o) for g, o in sorted(trail[-1]) if g < 0 or (o + 1 == len(self.groups[g]) and self.reach[g + 1] == len(self.groups))]
        if names and not ends:
            raise ValueError("a page outside its host's expression")
        state, out = ends[0] if names else None, []
        for step in reversed(trail[1:]):
            out.append(self.base[state[0]] + state[1])
            state = step[state]
        return out[::-1]


def count(held: dict, slots: list[int], letters: list[int], links: list[int], marks: list[int]) -> None:
    """Adds a page: per slot pages, letters, letters in links, a few text hashes."""
    found: dict = {}
    for slot, n, l, mark in zip(slots, letters, links, marks):
        row = found.setdefault(slot, [1, 0, 0, set()])
        row[1] += n
        row[2] += l
        row[3].add(mark)
    add(held, found)


def count_vetoes(held: dict, slots: list[int], names: list[str], letters: list[int]) -> None:
    """Adds a page: per path that ends in a class word, the letters of every slot of the page."""
    paths = set()
    for name in set(names):
        if "~" in name:
            steps = name.split("/")
            paths |= {"/".join(steps[: i + 1]) for i, s in enumerate(steps) if s.split(".")[0][-1:] == "~"}
    if paths:
        found: dict = {}
        for slot, n in zip(slots, letters):
            found[slot] = found.get(slot, 0) + n
        add_vetoes(held, dict.fromkeys(paths, found))


def add_vetoes(held: dict, more: dict) -> None:
    for path, found in more.items():
        row = held.setdefault(path, {})
        for slot, n in found.items():
            row[int(slot)] = row.get(int(slot), 0) + n


def add(held: dict, more: dict) -> None:
    for slot, (n, letters, links, marks) in more.items():
        row = held.setdefault(int(slot), [0, 0, 0, set()])
        row[0] += n
        row[1] += letters
        row[2] += links
        row[3] = set(sorted(row[3] | set(marks))[:FEW])


def dump(held: dict, vetoes: dict) -> str:
    return json.dumps([{k: [*v[:3], sorted(v[3])] for k, v in held.items()}, vetoes])


class Reader:
    """Which slots of a host hold main text: ``pick`` gives the text of a page."""

    def __init__(self, expr: str, counts: str):
        self.matcher = Matcher(load(expr))
        held: dict = {}
        slots, vetoes = json.loads(counts)
        add(held, slots)
        steps = [[s.split(".")[0][-1:] for s in n.split("/")] for n in self.matcher.slots]
        open_ = {i for i in held if "!" not in steps[i]}
        fixed = {i for i in open_ if held[i][0] >= 3 and len(held[i][3]) == 1}
        linked = {i for i in open_ if 2 * held[i][2] >= held[i][1]}
        stands = set()
        for path, found in vetoes.items():  # a class word above most of the text of the pages it is on does not stand
            text = {int(i): n for i, n in found.items() if int(i) in open_ - fixed - linked}
            under = sum(n for i, n in text.items() if f"{self.matcher.slots[i]}/".startswith(f"{path}/"))
            if 2 * under <= sum(text.values()):
                stands.add(path)
        free = {i for i in open_ if not self._vetoed(i, steps[i], stands)}
        self.content = free - fixed - linked
        self.proven = {i for i in self.content if held[i][0] >= 3}
        self.marked = [{i for i in free - fixed if flag in steps[i]} for flag in "@%*"]
        held_apart = open_ - free - fixed - linked
        self.last = [{i for i in held_apart if "@" in steps[i] or "%" in steps[i]}, held_apart, free - linked, open_ - linked]

    def _vetoed(self, slot: int, flags: list[str], stands: set) -> bool:
        names = self.matcher.slots[slot].split("/")
        return any(f == "^" or f == "~" and "/".join(names[: i + 1]) in stands for i, f in enumerate(flags))

    def pick(self, names: list[str], texts: list[str]) -> str:
        slots = self.matcher.match(names)

        def letters(wanted: set) -> int:
            return sum(len(t) for s, t in zip(slots, texts) if s in wanted)

        chosen = self.content
        for part in self.marked:  # a mark only narrows what the slots say, and decides where they say nothing yet
            inside = letters(part & self.content)
            if inside and inside >= letters(self.proven - part):
                chosen = part
                break
        for wanted in [chosen, *self.last]:
            text = "\n\n".join(t for s, t in zip(slots, texts) if s in wanted)
            if text:
                return text
        return ""


# ------------------------------------------------------------------------------ on Spark


def page_blocks(pages: DataFrame) -> DataFrame:
    """``page_id, url, host, names, texts, letters, links, marks, page, whole``: pages as block streams, and their ``keys``."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts, letters, links, marks, both = [], [], [], [], [], []
            for page in batch.column(3):
                found = list(blocks(page.as_py() or ""))
                both.append(keys(found))
                names.append([b[0] for b in found])
                texts.append([b[1] for b in found])
                letters.append([len(b[1]) for b in found])
                links.append([b[2] for b in found])
                marks.append([zlib.crc32(b[1].encode("utf-8", "replace")) for b in found])
            ints = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(names, pa.list_(pa.string())), pa.array(texts, pa.list_(pa.string())),
                 pa.array(letters, ints), pa.array(links, ints), pa.array(marks, ints),
                 pa.array([k for k, _ in both], pa.int64()), pa.array([k for _, k in both], pa.int64())],
                names=["page_id", "url", "host", "names", "texts", "letters", "links", "marks", "page", "whole"],
            )

    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    schema = f"page_id {kind}, url string, host string, names array<string>, texts array<string>, letters array<bigint>, links array<bigint>, marks array<bigint>, page bigint, whole bigint"
    return pages.select("page_id", "url", host.alias("host"), "html").mapInArrow(run, schema)


SALTS = 64


def infer(streams: DataFrame) -> DataFrame:
    """``host, expr`` from block streams: shapes of a host are aligned in the order of their text, whatever task they come from."""

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            out: list = []
            for host, names in zip(*(c.to_pylist() for c in batch.columns)):
                key = (host, tuple(names))
                if key not in seen:
                    if len(seen) > 10_000:
                        seen.clear()
                    seen.add(key)
                    out.append((host, json.dumps(fold(names))))
            yield pa.RecordBatch.from_arrays(
                [pa.array([h for h, _ in out], pa.string()), pa.array([zlib.crc32(x.encode()) % SALTS for _, x in out], pa.int64()), pa.array([x for _, x in out], pa.string())],
                names=["host", "salt", "expr"],
            )

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, expr = None, None, []

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"host": pa.array([now[0]], pa.string()), "salt": pa.array([now[1]], pa.int64()), "expr": pa.array([json.dumps(expr)], pa.string())})

        for batch in batches:
            for host, salt, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (host, salt) != now:
                    if now:
                        yield row()
                    now, last, expr = (host, salt), text, load(text)
                elif text != last:
                    last, expr = text, align(expr, load(text))
        if now:
            yield row()

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        whole: list = []
        for text in sorted(rows["expr"]):
            whole = align(whole, load(text))
        return rows.iloc[:1].assign(expr=json.dumps(whole))

    schema = "host string, salt bigint, expr string"
    own = streams.select("host", "names").mapInArrow(shapes, schema)
    ordered = own.repartition("host", "salt").sortWithinPartitions("host", "salt", "expr")
    return ordered.mapInArrow(aligned, schema).groupBy("host").applyInPandas(merged, schema).drop("salt")


def statistics(streams: DataFrame, exprs: DataFrame) -> DataFrame:
    """``host, counts`` of the slots of each host's expression; copies of a page count once."""

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[Matcher, dict, dict]] = {}
        salt = TaskContext.get().partitionId() % SALTS

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.string()), pa.array([salt] * len(held), pa.int64()), pa.array([dump(c, v) for _, c, v in held.values()], pa.string())],
                names=["host", "salt", "counts"],
            )

        for batch in batches:
            host, expr = (batch.column(i).to_pylist() for i in (0, 1))
            for h, x, *row in zip(host, expr, *(c.to_pylist() for c in batch.columns[2:])):
                if h not in held:
                    if len(held) > 5_000:  # bounded memory; the same host may give several rows
                        yield rows()
                        held.clear()
                    held[h] = Matcher(load(x)), {}, {}
                matcher, counts, vetoes = held[h]
                slots = matcher.match(row[0])
                count(counts, slots, *row[1:])
                count_vetoes(vetoes, slots, *row[:2])
        yield rows()

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        slots, vetoes = {}, {}
        for text in rows["counts"]:
            more = json.loads(text)
            add(slots, more[0])
            add_vetoes(vetoes, more[1])
        return rows.iloc[:1].assign(counts=dump(slots, vetoes))

    schema = "host string, salt bigint, counts string"
    one = F.min_by(F.struct("names", "letters", "links", "marks"), "whole")
    pages = streams.groupBy("host", "page").agg(one.alias("_b")).select("host", "_b.*")
    own = pages.join(exprs, "host").select("host", "expr", "names", "letters", "links", "marks").mapInArrow(begin, schema)
    salted = own.groupBy("host", "salt").applyInPandas(merged, schema)
    return salted.groupBy("host").applyInPandas(merged, schema).drop("salt")


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars, wrapper`` for every page; ``wrapper`` is the expression of its host."""
    kind = pages.schema["page_id"].dataType.simpleString()
    streams = cut(page_blocks(pages), "blocks")
    exprs = cut(infer(streams), "expressions")
    wrappers = cut(exprs.join(statistics(streams, exprs), "host"), "wrappers")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[Reader, str]] = {}
        for batch in batches:
            host, names, texts, expr, counts = (batch.column(i).to_pylist() for i in range(2, 7))
            out, made = [], []
            for h, n, t, x, c in zip(host, names, texts, expr, counts):
                if h not in held:
                    if len(held) > 5_000:
                        held.clear()
                    held[h] = Reader(x, c), regex(load(x))
                reader, shown = held[h]
                out.append(reader.pick(n, t))
                made.append(shown)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(out, pa.string()), pa.array(made, pa.string())], names=["page_id", "url", "text", "wrapper"]
            )

    rows = streams.select("page_id", "url", "host", "names", "texts").join(wrappers, "host")
    found = rows.select("page_id", "url", "host", "names", "texts", "expr", "counts").mapInArrow(read, f"page_id {kind}, url string, text string, wrapper string")
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"), "wrapper")
