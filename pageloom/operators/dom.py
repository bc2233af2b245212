"""The node table: every page's elements as rows, and CSS selection as joins on it.

An element has its place in document order (pre) and its last descendant's (post), so descent is an interval test next to
an equality on page_id; its parent's pre and its place among siblings give the other axes.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as tx
from ..sources.staging import staged

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote br body dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
_NO_TEXT = frozenset("script style noscript template".split())
NODES = (
    "page_id long, pre int, post int, parent int, depth int, sib int, last boolean, tag string, id string, classes array<string>, attrs map<string,string>, "
    "own_text string, text string, text_len int, joined string, joined_len int, hidden boolean, src_from int, src_to int"
)


#: What stands between two words: nothing, a space, or a line feed where a block begins or ends between them (texts hold none of their own).
_BETWEEN = ("", " ", "\n")

#: Characters of a page that are fed to the parser at a time; a piece ends before a tag, where no text is cut.
PIECE = 1 << 18


# Tags as most pages write them. The base class reads these alike, slower, and all others.
_PLAIN_START = re.compile(r"""<([a-zA-Z][a-zA-Z0-9]*)((?:[ \n]+[a-zA-Z][a-zA-Z0-9-]*=(?:"[^"&<>]*"|'[^'&<>]*'))*)>""")
_PLAIN_ATTRIBUTE = re.compile(r"""[ \n]+([a-zA-Z][a-zA-Z0-9-]*)=(?:"([^"]*)"|'([^']*)')""")
_PLAIN_END = re.compile("</([a-zA-Z][a-zA-Z0-9]*)>")


class _Tree(HTMLParser):
    """Builds rows as the lenient parser does: an end tag closes up to its open tag, a stray one is ignored; nothing is implied.
    implied adds what browsers imply: a new p, li, td, th, tr, dt, dd or option closes an open one.

    A row is given away as soon as its element is closed and it is known whether another follows it, and a page is taken in parts,
    so what is held is what is open and what is wanted of it, not a page or its rows. wanted says which columns are made, tags of
    which elements. says tells, of an element's names, whether its text is made even if it is longer than short; joins the same of
    joined, whatever its length. Of other texts just the length is known, and no more is held of them."""

    _CLOSES = {"p": ("p",), "li": ("li",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}

    def __init__(
        self, implied: bool = False, wanted: frozenset[str] | None = None, tags: frozenset[str] | None = None, says: Callable[[dict], bool] | None = None, short: int = 0, joins: Callable[[dict], bool] | None = None
    ):
        super().__init__(convert_charrefs=True)
        self.ready: list[dict] = []
        self.stack: list[dict] = []
        self.implied, self.roots, self.made, self.tags = implied, 0, 0, tags
        self.open: dict[str, int] = {}  # how many of each tag are open
        self.waiting: list[str] = []  # what came and was not fed
        self.waits = self.size = self.place = 0  # characters of that, of what was fed, and before what is being read
        wants = lambda *names: wanted is None or not wanted.isdisjoint(names)
        self.texts, self.joined, self.owns = wants("text", "text_len"), wants("joined", "joined_len"), wants("own_text")
        never = lambda row: False
        self.says, self.short = (says, short) if wants("text") else (never, -1)
        self.joins = joins if wants("joined") else never
        self.whole = self.spelled = 0  # how many are open whose text, whose joined is made at any length

    def run(self, html: str) -> Iterator[dict]:
        """Rows, those of an element after those in it."""
        for at in range(0, len(html), PIECE):
            yield from self.take(html[at : at + PIECE])
        yield from self.end()

    def take(self, more: str) -> list[dict]:
        """Rows that are known when more of the page has come."""
        self.waiting.append(more)
        self.waits += len(more)
        if self.waits < PIECE or "<" not in more:
            return []
        here = "".join(self.waiting)
        at = here.rfind("<")
        self.waiting, self.waits = [here[at:]], len(here) - at
        self._feed(here[:at])
        return self._given()

    def end(self) -> Iterator[dict]:
        """The other rows, when all has come."""
        self._feed("".join(self.waiting))
        self.close()
        yield from self._given()
        while self.stack:
            self._close(self.size)
            yield from self._given()

    def _feed(self, part: str) -> None:
        self.size += len(part)
        self.feed(part)

    def _given(self) -> list[dict]:
        rows, self.ready = self.ready, []
        return rows

    def updatepos(self, i, j):
        self.place += max(j - i, 0)
        return j

    def parse_starttag(self, i):
        m = _PLAIN_START.match(self.rawdata, i)
        if not m:
            self.plain = None
            return super().parse_starttag(i)
        tag, self.plain = m[1].lower(), m[0]
        self.handle_starttag(tag, [(k.lower(), x or y) for k, x, y in _PLAIN_ATTRIBUTE.findall(m[2])] if m[2] else ())
        if tag in self.CDATA_CONTENT_ELEMENTS:
            self.set_cdata_mode(tag)
        return m.end()

    def get_starttag_text(self):
        return self.plain or super().get_starttag_text()

    def parse_endtag(self, i):
        m = _PLAIN_END.match(self.rawdata, i)
        if not m or self.cdata_elem is not None:
            return super().parse_endtag(i)
        self.handle_endtag(m[1].lower())
        return m.end()

    def handle_starttag(self, tag, attrs):
        if self.implied and self.stack and self.stack[-1]["tag"] in self._CLOSES.get(tag, ()):
            self._close(self.place)
        up = self.stack[-1] if self.stack else None
        a = {}
        for k, v in attrs:
            a.setdefault(k, v or "")
        off = "hidden" in a
        if a.get("style"):
            style = a["style"].replace(" ", "").lower()
            off = off or "display:none" in style or "visibility:hidden" in style or re.search(r"opacity:0(\.0*)?(;|$)", style) is not None
        row = {
            "pre": self.made, "parent": up["pre"] if up else -1, "depth": up["depth"] + 1 if up else 0, "sib": up["kids"] if up else self.roots, "tag": tag, "id": a.get("id", ""),
            "classes": a.get("class", "").split(), "attrs": a, "own": [], "kids": 0, "hidden": bool(off or up and up["hidden"]), "src_from": self.place, "last": True, "youngest": None,
            "text": "", "joined": "", "own_text": "", "said": [], "text_len": 0, "lead": 0, "trail": 0, "bits": [], "joined_len": 0,
        }
        kept = self.tags is None or tag in self.tags
        row["whole"] = self.texts and kept and (self.says is None or self.says(row))
        row["spelled"] = self.joined and kept and (self.joins is None or self.joins(row))
        self.whole += row["whole"]
        self.spelled += row["spelled"]
        self.made += 1
        if not up:
            self.roots += 1
        else:
            up["kids"] += 1
            if up["youngest"] is not None:
                up["youngest"]["last"] = False
                self._give(up["youngest"])
            up["youngest"] = row
        self.stack.append(row)
        self.open[tag] = self.open.get(tag, 0) + 1
        if tag in VOID:
            self._close(self.place + len(self.get_starttag_text() or ""))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._close(self.place + len(self.get_starttag_text() or ""))

    def handle_endtag(self, tag):
        if self.open.get(tag):
            at = self.place
            while self.stack[-1]["tag"] != tag:
                self._close(at)
            self._close(at + len(tag) + 3)

    def _give(self, row: dict) -> None:
        if self.tags is None or row["tag"] in self.tags:
            self.ready.append(row)

    def _close(self, at: int) -> None:
        row = self.stack.pop()
        tag, up = row["tag"], self.stack[-1] if self.stack else None
        self.open[tag] -= 1
        self.whole -= row["whole"]
        self.spelled -= row["spelled"]
        row["post"], row["src_to"] = self.made - 1, min(at, self.size)
        if self.texts:
            said = "".join(row["said"]) if row["said"] is not None else None
            if row["whole"] or row["text_len"] <= self.short:
                row["text"] = said
            if up is not None and tag not in _NO_TEXT:
                lead, trail = (2, 2) if tag in _BLOCK else (row["lead"], row["trail"])
                self._say(up, lead, said, row["text_len"], trail)
        if self.joined:
            joined = "".join(row["bits"])
            if row["spelled"]:
                row["joined"] = joined
            if up is not None:
                up["joined_len"] += row["joined_len"]
                if self.spelled:
                    up["bits"].append(joined)
        if self.owns:
            row["own_text"] = " ".join("".join(row["own"]).split())
        row["own"] = row["said"] = row["bits"] = None
        if row["youngest"] is not None:
            self._give(row["youngest"])
            row["youngest"] = None
        if up is None:  # a root is the last of its kind
            self._give(row)

    def _say(self, row: dict, lead: int, said: str | None, n: int, trail: int) -> None:
        """Adds n characters that show to an element, and what is between them and those before and after (_BETWEEN)."""
        if not n:
            side = "trail" if row["text_len"] else "lead"
            row[side] = max(row[side], lead, trail)
            return
        between = _BETWEEN[max(row["trail"], lead)] if row["text_len"] else ""
        if not row["text_len"]:
            row["lead"] = max(row["lead"], lead)
        row["text_len"] += len(between) + n
        row["trail"] = trail
        if not self.whole and row["text_len"] > self.short:
            row["said"] = None
        elif row["said"] is not None:
            row["said"] += (between, said) if between else (said,)

    def handle_data(self, data):
        if not self.stack:
            return
        top = self.stack[-1]
        if self.owns:
            top["own"].append(data)
        if self.texts and data:
            said = " ".join(data.split())
            self._say(top, data[0].isspace(), said, len(said), data[-1].isspace())
        if self.joined and (bit := data.strip()) and top["tag"] not in _NO_TEXT:
            top["joined_len"] += len(bit)
            if self.spelled:
                top["bits"].append(bit)


def parse_html(html: str | None, implied: bool = False, wanted: frozenset[str] | None = None, says: Callable[[dict], bool] | None = None, short: int = 0, joins: Callable[[dict], bool] | None = None) -> list[dict]:
    """All rows of a page, in document order."""
    return sorted(_Tree(implied, wanted, says=says, short=short, joins=joins).run(html or ""), key=lambda r: r["pre"])


#: Bytes of the parts in which a page goes to Python: an Arrow batch has as many of them as it has rows (10,000), of however few pages.
PART = 1 << 12


def _parts(pages: DataFrame) -> DataFrame:
    """(page_id, at, part): the bytes of each page in parts, in order, in the task that has the page; at is 0 where a page begins."""
    ends = F.floor(F.octet_length("html") / PART).cast("int")
    # by way of an array's element the bytes of a page are made once, not once for each part
    cut = F.transform(F.array(F.col("html").cast("binary")), lambda b: F.transform(F.sequence(F.lit(0), ends), lambda i: F.substring(b, i * PART + 1, F.lit(PART))))
    return pages.select("page_id", F.posexplode(F.get(cut, F.lit(0))).alias("at", "part"))


def parse_pages(
    pages: DataFrame, implied: bool = False, text_cap: int | None = None, columns: str = "", tags: str = "", says: Callable[[dict], bool] | None = None, short: int = 0, joins: Callable[[dict], bool] | None = None
) -> DataFrame:
    """The node table of (page_id, html). A page without elements, or without HTML, has no rows. text is what shows, a line a
    block; joined the stripped strings without separator. Both are whole unless text_cap is given; text_len and joined_len are the
    full lengths. Elements hold the text of what is in them, so a table of them has a page's text about as often as it is deep.
    columns, if given, are those that are made besides page_id; tags those elements that have a row.

    If says is given, an element's text is '' unless says(its tag, id, classes and attrs) or it has at most short characters; if
    joins is given, joined is '' unless joins(those). For operators that read no others: what no text is made of is not held.

    Use node_table() where several operators read the result: this is an expression, and each of them would parse anew.
    """
    row = StructType.fromDDL(NODES)
    names = [n for n in row.names if not columns or n == "page_id" or n in columns.split()]
    row = StructType([row[n] for n in names])
    wanted, kept = frozenset(names), frozenset(tags.split()) or None

    def rows_of(batches):
        tree = page = decoder = None
        for batch in batches:
            for i in range(batch.num_rows):
                if batch.column(1)[i].as_py() == 0:
                    if tree is not None:
                        yield from ((page, r) for r in tree.end())
                    page, tree, decoder = batch.column(0)[i].as_py(), _Tree(implied, wanted, kept, says, short, joins), codecs.getincrementaldecoder("utf-8")()
                yield from ((page, r) for r in tree.take(decoder.decode(batch.column(2)[i].as_py())))
        if tree is not None:
            yield from ((page, r) for r in tree.end())

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(row)

        def made(cols):
            return pa.RecordBatch.from_arrays([pa.array(cols[n], schema.field(n).type) for n in names], schema=schema)

        cols: dict[str, list] = {n: [] for n in names}
        held = 0
        for page, r in rows_of(batches):
            r["page_id"], r["attrs"] = page, list(r["attrs"].items())
            r["text"], r["joined"] = r["text"][:text_cap], r["joined"][:text_cap]
            for n in names:
                cols[n].append(r[n])
            held += 1000 + len(r["text"]) + len(r["joined"])
            if held > 1 << 23:
                yield made(cols)
                cols, held = {n: [] for n in names}, 0
        yield made(cols)
        _give_back()

    return _parts(spread(pages.select(F.col("page_id").cast("long").alias("page_id"), "html"))).mapInArrow(run, row)


def page_records(pages: DataFrame, compute: Callable[[list[dict], str | None], dict], fields: str, columns: str, says: Callable[[dict], bool]) -> DataFrame:
    """(page_id, url, fields): a row a page, of what compute gives of its elements' rows in document order, made with those columns
    (text where says), and its URL.
    For small pages of a fixed layout: each is parsed and read in one place, and nothing of it is shuffled."""
    out = StructType.fromDDL("page_id long, url string, " + fields)
    names, wanted = out.names, frozenset(columns.split())

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(out)
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], schema.field(n).type) for n in names], schema=schema)
        for batch in batches:
            rows, held = [], 0
            for i in range(batch.num_rows):
                page, url, html = (batch.column(k)[i].as_py() for k in range(3))
                rows.append({"page_id": page, "url": url, **compute(parse_html(html, wanted=wanted, says=says), url)})
                held += 1000 + len(html or "")
                if held > 1 << 23:
                    yield made(rows)
                    rows, held = [], 0
            yield made(rows)
        _give_back()

    return spread(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")).mapInArrow(run, out)


def _give_back() -> None:
    """Returns memory that a Python worker no longer uses to the system: workers live on beside those of later stages."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library, which has no such call
        pass


#: Bytes of a task's share of the pages, as their plan estimates them (of files, compressed), and the most tasks a core gets.
SHARE, MOST = 2 << 20, 64


def spread(pages: DataFrame, key: str = "page_id", share: int = SHARE) -> DataFrame:
    """Pages over all cores, and over as many tasks as their size asks for, where their files have fewer splits (a row group is one).
    Pages that are made of smaller rows are better spread as those rows; they are not dealt again."""
    cores = pages.sparkSession.sparkContext.defaultParallelism
    plan = pages._jdf.queryExecution()
    size = int(str(plan.optimizedPlan().stats().sizeInBytes()))
    tasks = min(max(cores, size // share), cores * MOST) if size < 1 << 62 else cores  # beyond that it is not known
    base = next((x for x in plan.optimizedPlan().toString().split("\n") if x.lstrip("+- ").split(" ")[0] not in ("Project", "Filter")), "")
    if base.lstrip("+- ").startswith("RepartitionByExpression"):
        return pages
    shuffled = "Exchange" in plan.executedPlan().toString()  # to ask such a plan for its partitions would run it
    return pages.repartition(tasks, key) if shuffled or pages.rdd.getNumPartitions() < tasks else pages


def node_table(pages: DataFrame, implied: bool = False, columns: str = "", **which) -> DataFrame:
    """The node table, parsed once and written to the shared folder; which: parse_pages()' says, short and joins."""
    return staged(parse_pages(pages, implied, columns=columns, **which), "nodes")


# --- CSS selection (D35) -------------------------------------------------------------------------
_PART = re.compile(
    r"""(?P<tag>^(?:[a-zA-Z][\w-]*|\*))|\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)|\[(?P<attr>[\w-]+)(?:(?P<op>[~^$*|]?=)["']?(?P<val>[^"'\]]*)["']?\s*(?P<flag>i)?)?\]"""
    r"""|:not\((?P<neg>[^)]*)\)|:has-text\(["']?(?P<says>[^"')]*)["']?\)|:(?P<pseudo>first-child|last-child|scope)""",
    re.X,
)


def compound(selector: str) -> Column:
    """The test of one element that a compound selector makes."""
    test, at = F.lit(True), 0
    while at < len(selector):
        m = _PART.match(selector, at)
        if not m or m.end() == at:
            raise ValueError(f"unsupported selector {selector!r}")
        at = m.end()
        if m["tag"] and m["tag"] != "*":
            test &= F.col("tag") == m["tag"].lower()
        elif m["cls"]:
            test &= F.array_contains("classes", m["cls"])
        elif m["id"]:
            test &= F.col("id") == m["id"]
        elif m["attr"]:
            have = F.try_element_at("attrs", F.lit(m["attr"]))
            if not m["op"]:
                test &= have.isNotNull()
            else:
                v = m["val"].lower() if m["flag"] else m["val"]
                have = F.lower(have) if m["flag"] else have
                if m["op"] != "=" and not v:
                    test &= F.lit(False)
                else:
                    test &= F.coalesce({"=": lambda h: h == v, "^=": lambda h: h.startswith(v), "$=": lambda h: h.endswith(v), "*=": lambda h: h.contains(v), "~=": lambda h: F.array_contains(F.split(h, " "), v), "|=": lambda h: (h == v) | h.startswith(v + "-")}[m["op"]](have), F.lit(False))
        elif m["neg"] is not None:
            test &= ~compound(m["neg"].strip())
        elif m["says"] is not None:
            test &= F.lower("text").contains(m["says"].lower())
        elif m["pseudo"] == "first-child":
            test &= F.col("sib") == 0
        elif m["pseudo"] == "last-child":
            test &= F.col("last")
    return test


def _split(selector: str, by: str) -> list[str]:
    out, depth, quote, part = [], 0, "", ""
    for ch in selector:
        if quote:
            quote = "" if ch == quote else quote
        elif ch in "\"'":
            quote = ch
        elif ch in "[(":
            depth += 1
        elif ch in "])":
            depth -= 1
        if ch in by and not depth and not quote:
            out.append(part)
            out.append(ch)
            part = ""
        else:
            part += ch
    return [x.strip() if x.strip() else x for x in [*out, part] if x]


def _steps(selector: str) -> list[tuple[str, str]]:
    """(combinator, compound) from left to right; the first combinator is ''."""
    text = re.sub(r"\s*([>~])\s*", r"\1", selector.strip())
    steps, how = [], ""
    for piece in _split(text, " >~"):
        if piece in (" ", ">", "~"):
            how = piece
        else:
            steps.append((how, piece))
            how = " "
    return steps


#: Places of one bucket of within(). An outer element is there once for each bucket that it reaches into.
BUCKET = 64


def within(inner: DataFrame, outer: DataFrame, page: str, pre: str, post: str) -> DataFrame:
    """inner (page_id, pre, ...) joined to the outer elements (page, pre, post, ...: columns of names that inner lacks) they are in.

    Besides the page they share a bucket of places, so a node meets the elements around it, not all of its page.
    """
    mine, theirs = tx.free_name(inner.columns + outer.columns, "_bucket"), tx.free_name(inner.columns + outer.columns, "_reach")
    reach = F.sequence(F.floor((F.col(pre) + 1) / BUCKET), F.floor(F.col(post) / BUCKET))
    some = outer.filter(F.col(post) > F.col(pre)).withColumn(theirs, F.explode(reach))
    left = inner.withColumn(mine, F.floor(F.col("pre") / BUCKET))
    on = (F.col("page_id") == F.col(page)) & (F.col(mine) == F.col(theirs)) & (F.col("pre") > F.col(pre)) & (F.col("pre") <= F.col(post))
    return left.join(some, on).drop(mine, theirs)


def select(nodes: DataFrame, selector: str, scopes: DataFrame | None = None) -> DataFrame:
    """Nodes that match a selector list. With scopes (page_id, scope_pre, scope_post) only those inside a scope, as
    (scope_pre, node columns); a selector may then begin with :scope >."""
    found = None
    for one in (s for s in _split(selector, ",") if s != ","):
        steps = _steps(one)
        scoped = scopes is not None
        if scoped and steps[0][1] == ":scope":
            base = scopes.select("page_id", F.col("scope_pre").alias("l_pre"), F.col("scope_post").alias("l_post"), F.lit(-2).alias("l_parent"), F.lit(0).alias("l_sib"), "scope_pre")
            steps = steps[1:]
        elif scoped:
            first = nodes.filter(compound(steps[0][1])).alias("n")
            s = scopes.select(F.col("page_id").alias("s_page"), "scope_pre", "scope_post")
            base = within(first, s, "s_page", "scope_pre", "scope_post")
            out = base.select("scope_pre", *nodes.columns)
            base, steps = out.select("page_id", F.col("pre").alias("l_pre"), F.col("post").alias("l_post"), F.col("parent").alias("l_parent"), F.col("sib").alias("l_sib"), "scope_pre"), steps[1:]
        else:
            out = nodes.filter(compound(steps[0][1])).withColumn("scope_pre", F.lit(-1))
            base, steps = out.select("page_id", F.col("pre").alias("l_pre"), F.col("post").alias("l_post"), F.col("parent").alias("l_parent"), F.col("sib").alias("l_sib"), "scope_pre"), steps[1:]
        for how, piece in steps:
            right = nodes.filter(compound(piece))
            left = base.withColumnRenamed("page_id", "l_page")
            same = F.col("page_id") == F.col("l_page")
            if how == ">":
                out = right.join(left, same & (F.col("parent") == F.col("l_pre")))
            elif how == "~":
                out = right.join(left, same & (F.col("parent") == F.col("l_parent")) & (F.col("sib") > F.col("l_sib")))
            else:
                out = within(right, left, "l_page", "l_pre", "l_post")
            out = out.select("scope_pre", *nodes.columns)
            base = out.select("page_id", F.col("pre").alias("l_pre"), F.col("post").alias("l_post"), F.col("parent").alias("l_parent"), F.col("sib").alias("l_sib"), "scope_pre")
        found = out.select("scope_pre", *nodes.columns) if found is None else found.unionByName(out.select("scope_pre", *nodes.columns))
    found = found.dropDuplicates(["page_id", "scope_pre", "pre"])
    return found if scopes is not None else found.drop("scope_pre")


def matches(nodes: DataFrame, selectors: dict[int, str]) -> DataFrame:
    """(rank, node columns): nodes that match each of several selectors. Selectors of one element are all tested in one pass."""
    plain = {r: s for r, s in selectors.items() if "," not in s and len(_steps(s)) == 1}
    found = None
    if plain:
        hit = F.filter(F.array(*(F.when(compound(s), F.lit(r)) for r, s in plain.items())), lambda x: x.isNotNull())
        found = nodes.select(F.explode(hit).alias("rank"), *nodes.columns)
    for r, s in selectors.items():
        if r not in plain:
            part = select(nodes, s).select(F.lit(r).alias("rank"), *nodes.columns)
            found = part if found is None else found.unionByName(part)
    return found


def scopes_of(nodes: DataFrame) -> DataFrame:
    """Nodes as scopes for select()."""
    return nodes.select("page_id", F.col("pre").alias("scope_pre"), F.col("post").alias("scope_post"))


def first_match(nodes: DataFrame, selectors: list[str], scopes: DataFrame) -> DataFrame:
    """(page_id, scope_pre, rank, node columns): in each scope the first node of the first selector that has one."""
    found = None
    for rank, s in enumerate(selectors):
        part = select(nodes, s, scopes).withColumn("rank", F.lit(rank))
        found = part if found is None else found.unionByName(part)
    best = found.groupBy("page_id", "scope_pre").agg(F.min_by(F.struct("rank", *[c for c in nodes.columns if c != "page_id"]), F.struct("rank", "pre")).alias("b"))
    return best.select("page_id", "scope_pre", "b.*")
