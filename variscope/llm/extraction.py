"""Main text of web pages by equivalence-class template deduction.

Tokens of a page are its element paths and its text strings under a path. Across the pages of a host, tokens
with equal occurrence vectors (how often in which page) form a class; a class of enough tokens that all pages
of the host have is part of the template. Classes over some of the pages (boilerplate of most pages, one of two
layouts) are not used, and classes are not nested. Template strings and link lists of the template are not
content; what else the page says is extracted, unless it lies in an element that is never part of an article
(navigation, footers, adverts, forms and the like). Pages without text are no witnesses.

An occurrence vector is never held: its counts and two commutative hashes of (page, count) are summed, so a
host of any size is an aggregation with partial sums.
"""

from __future__ import annotations

import re
from zlib import crc32

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from variscope.llm.scratch import stored
from variscope.llm.urls import with_host_and_path

#: Different pages a host must have before strings that its pages share count as its template.
MIN_PAGES = 8
#: Tokens of an equivalence class.
MIN_TOKENS = 2
#: Kinds of tokens.
PAGE, PATH, LINKS, TEXT = range(4)

# Element names and words in class, id and role attributes that mark what is not the article.
NEVER = frozenset(
    "head nav footer aside form script style noscript template svg iframe object button select option textarea menu dialog title canvas audio video map".split()
)
MARKED = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adbox banner banners promo promotion promoted sponsor sponsored sponsors sidebar "
    "menu menus nav navbar navigation breadcrumb breadcrumbs header footer masthead topbar toolbar notice notices cookie cookies consent gdpr alert popup modal "
    "overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments reply replies respond "
    "disqus pagination pager widget widgets tags copyright legal disclaimer skip search contentinfo complementary".split()
)
COMMENTS = frozenset("comment comments reply replies respond disqus".split())
#: Words that decide without further evidence; the others of MARKED also name parts of articles and layouts.
ALONE = COMMENTS | frozenset(
    "ad ads advert adverts advertisement advertisements advertising adbox sponsor sponsored sponsors cookie cookies consent gdpr breadcrumb breadcrumbs "
    "navbar navigation footer contentinfo pagination pager share sharing subscribe subscription signup login".split()
)
#: Slots whose articles are others than the page's.
TEASERS = frozenset("ad ads advert adverts advertisement advertisements sponsored promo promoted related recommended recommendations".split())
#: Words before which a class names the element and after which its layout.
LAYOUT = frozenset("has have no not non with without".split())
NOTHING: frozenset[str] = frozenset()
NONE: frozenset[int] = frozenset()
MAIN = frozenset(["article", "main"])
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SAME_CLOSES = frozenset("li dt dd tr td th option".split())

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)
      | <(?P<raw>script|style|title|textarea|iframe|noembed|noframes|xmp)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)
      | <(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*)>
      | <[!?/][^>]*(?:>|\Z)
      | <[a-zA-Z][^>]*(?:>|\Z)
      | (?P<text>[^<]+|<)""",
    re.S | re.I | re.X,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|\b(hidden)\b(?!\s*-)""", re.I)
WORD = re.compile(r"[a-z]+")


def marks_of(name: str, attrs: str, in_main: bool) -> tuple[bool, frozenset[str]]:
    """Whether an element is never content, and the words by which its class, id and role mark it as such.

    What follows has-, no-, with- and the like in a class speaks of the layout, not of the element.
    """
    if name in NEVER or name == "header" and not in_main:
        return True, NOTHING
    if not attrs or name in ("html", "body", "main"):
        return False, NOTHING
    words: set[str] = set()
    for m in ATTRIBUTE.finditer(attrs):
        if m[5]:
            return True, NOTHING
        for one in (m[2] or m[3] or m[4] or "").lower().split():
            parts = WORD.findall(one)
            at = next((k for k, x in enumerate(parts) if x in LAYOUT), len(parts))
            words.update(parts[:at])
    return False, COMMENTS & words if name == "article" else MARKED & words


def below(path: int, name: str) -> int:
    """The path of an element in the element of another path: 64 bits, whatever the depth."""
    return (path * 0x9E3779B97F4A7C15 + crc32(name.encode()) + 1) & 0xFFFFFFFFFFFFFFFF


def blocks(html: str) -> list[tuple[int, bool, bool, str, bool]]:
    """(element path as a hash, lies in article or main, all of it links, text, marked) of every block that may be content.

    Text that is not in a block of its own belongs to the block around it; white space inside is one space.
    Slots that a word of ALONE marks are left out; ``marked`` says that other words mark the block, which
    needs evidence. No mark but those of COMMENTS counts for a slot with an article or main element below it.
    Below a mark of TEASERS that is so only if the page has no other article or main, and then all text is left.
    """
    from html import unescape

    kept: list[tuple[int, frozenset[int] | None, bool, str, frozenset[int], frozenset[int]]] = []
    # name, path of the block, left out, marks of TEASERS around the main element (None outside one), marks that
    # need evidence, marks of ALONE
    stack: list[tuple[str, int, bool, frozenset[int] | None, frozenset[int], frozenset[int]]] = [("", 0, False, None, NONE, NONE)]
    teasers: set[int] = set()
    under: set[int] = set()  # marks with an article or main below
    marks = 0
    text: list[str] = []
    plain = False  # the block has text outside links
    bare = False  # the block has text outside marked inline elements
    links = inner = 0  # open links, open marked inline elements

    def flush() -> None:
        nonlocal plain, bare, marks
        if text:
            joined = " ".join(unescape("".join(text)).split())
            if joined:
                _, path, _, main, weak, alone = stack[-1]
                weak = weak - {-1}
                if not bare:
                    marks += 1
                    weak = weak | {marks}
                kept.append((path, main, not plain, joined, weak, alone))
            text.clear()
        plain = bare = False

    def pop(to: int) -> None:
        nonlocal links, inner
        for name, _, _, _, weak, _ in stack[to:]:
            links -= name == "a"
            inner -= -1 in weak and name in INLINE
        del stack[to:]

    def top_block() -> int:
        at = len(stack) - 1
        while at and stack[at][0] in INLINE:
            at -= 1
        return at

    for m in TOKEN.finditer(html):
        kind = m.lastgroup
        if kind == "text":
            if not stack[-1][2]:
                text.append(m[0])
                if not m[0].isspace():
                    plain = plain or not links
                    bare = bare or not inner
            continue
        if m["name"] is None:  # comments, raw text elements, declarations, a tag that the page's end cuts
            continue
        name = m["name"].lower()
        if m["close"]:
            if name in INLINE:
                at = len(stack) - 1
                while at and stack[at][0] in INLINE and stack[at][0] != name:
                    at -= 1
                if at and stack[at][0] == name:
                    pop(at)
            elif name not in VOID:
                flush()
                at = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == name), 0)
                if at:
                    pop(at)
            continue
        if name in VOID:
            if name in ("br", "hr", "wbr"):
                text.append("" if name == "wbr" else " ")
            continue
        if name in INLINE:
            _, path, out_, main, weak, alone = stack[-1]
            never, words = marks_of(name, m["attrs"], main is not None) if m["attrs"] else (False, NOTHING)
            marked = bool(words) and words.isdisjoint(ALONE)
            stack.append((name, path, out_ or never or bool(words) and not marked, main, weak - {-1} | {-1} if marked else weak - {-1}, alone))
            links += name == "a"
            inner += marked
            continue
        flush()
        at = top_block()
        if stack[at][0] == "p" or name in SAME_CLOSES and stack[at][0] == name:
            pop(at)
        _, path, out_, main, weak, alone = stack[-1]
        if not m["attrs"].endswith("/"):
            never, words = marks_of(name, m["attrs"], main is not None)
            weak = weak - {-1}
            if words:
                marks += 1
                out_ = out_ or not words.isdisjoint(COMMENTS)
                if words.isdisjoint(ALONE):
                    weak = weak | {marks}
                else:
                    alone = alone | {marks}
                if not words.isdisjoint(TEASERS):
                    teasers.add(marks)
            if name in MAIN and not out_ and not never:
                under.update(weak | alone)
                if main is None:
                    main = (weak | alone) & teasers
            stack.append((name, below(path, name), out_ or never, main, weak, alone))
    flush()
    cleared = under - teasers
    if not any(b[1] == NONE and b[5] <= cleared for b in kept):
        cleared = under
    return [(path, main == NONE, all_links, joined, not weak <= cleared) for path, main, all_links, joined, weak, alone in kept if alone <= cleared]


def content(html: str, strings: frozenset[int] = frozenset(), lists: frozenset[int] = frozenset()) -> str:
    """The main text: one line a block, without template ``strings`` (hashes) and link ``lists`` (paths).

    A marked block goes if it is all links; otherwise its text is evidence only if the host repeats it. A page with an article or main element that holds text gives that; any other page gives all that is left.
    """
    found = [b for b in blocks(html) if not (b[2] and (b[4] or signed(b[0]) in lists)) and not (strings and string_hash(b[0], b[3]) in strings)]
    main = [b for b in found if b[1]]
    return "\n".join(b[3] for b in main or found)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def string_hash(path: int, text: str) -> int:
    import xxhash

    return signed(xxhash.xxh3_64_intdigest(text.encode(), path))


def witness(found: list[tuple[int, bool, bool, str, bool]]) -> int:
    """Hash of what a page says: its main text if it has one, else all its text."""
    import xxhash

    main = [b[3] for b in found if b[1]] or [b[3] for b in found]
    return signed(xxhash.xxh3_64_intdigest("\0".join(main).encode()))


def tokens(pages: DataFrame) -> DataFrame:
    """host, token, path, kind, n, mark: the tokens of each different page.

    Of ``kind`` PAGE is the page itself, PATH an element path, LINKS a path whose blocks are all links and TEXT a
    string under a path. ``pages`` has host and html. Pages of a host that say the same are one witness of its
    template, however often they are repeated: of them the one with the least hash of all its blocks counts.
    ``mark`` is a hash of the witness and the count.
    """
    import pyarrow as pa

    kinds = pa.struct([("token", pa.int64()), ("path", pa.int64()), ("kind", pa.int32()), ("n", pa.int64()), ("mark", pa.int64())])

    def run(batches):
        from collections import Counter

        import xxhash

        for batch in batches:
            hosts, says, wholes, sets = [], [], [], []
            for host, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = blocks(html or "")
                if not found:
                    continue
                seen: Counter = Counter([(0, PAGE, "")])
                for path, _, links, text, _ in found:
                    seen[path, PATH, ""] += 1
                    if links:  # in one class with the path itself if all its blocks are links
                        seen[path, LINKS, ""] += 1
                    seen[path, TEXT, text] += 1
                said = witness(found)
                salt = said & 0xFFFFFFFFFFFFFFFF
                made = []
                for (path, kind, text), n in seen.items():
                    token = string_hash(path, text) if kind == TEXT else string_hash(path, f"\0{kind}")
                    mark = signed(xxhash.xxh3_64_intdigest(n.to_bytes(8, "little"), salt))
                    made.append({"token": token, "path": signed(path), "kind": kind, "n": n, "mark": mark})
                hosts.append(host)
                says.append(said)
                wholes.append(signed(xxhash.xxh3_64_intdigest("\0".join(f"{b[0]}\0{b[2]}\0{b[3]}" for b in found).encode())))
                sets.append(made)
            columns = [pa.array(hosts, pa.string()), pa.array(says, pa.int64()), pa.array(wholes, pa.int64()), pa.array(sets, pa.list_(kinds))]
            yield pa.RecordBatch.from_arrays(columns, ["host", "said", "whole", "tokens"])

    made = pages.select("host", "html").mapInArrow(run, "host string, said long, whole long, tokens array<struct<token:long,path:long,kind:int,n:long,mark:long>>")
    return made.groupBy("host", "said").agg(F.min_by("tokens", "whole").alias("tokens")).select("host", F.inline("tokens"))


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """host, strings (hashes of template strings), lists (paths of the template's link lists).

    A string is in the template if it shares its vector with the page itself, so stands once in every page of
    a host with ``min_pages`` different pages or more. A link list is in it if its path is in a valid class that all
    pages have. Both are at most as many as one page has blocks.
    """
    vector = ["pages", "total", "x", "y"]
    counted = tokens(pages).groupBy("host", "token", "kind").agg(
        F.max("path").alias("path"), F.count("*").alias("pages"), F.sum("n").alias("total"), F.bit_xor("mark").alias("x"), F.sum(F.col("mark").bitwiseAND(0x7FFFFFFF)).alias("y")
    )
    counted = stored(counted.filter(F.col("pages") >= min_pages), "tokens")
    page = F.col("kind") == PAGE
    hosts = counted.filter(page).select("host", F.col("pages").alias("all_pages"))
    classes = counted.groupBy("host", *vector).agg(F.count("*").alias("tokens"), F.max(page).alias("root")).filter(F.col("tokens") >= min_tokens)
    valid = classes.join(hosts, "host").filter("pages = all_pages")
    members = counted.join(valid.drop("all_pages", "tokens"), ["host", *vector])
    return members.groupBy("host").agg(
        F.collect_list(F.when((F.col("kind") == TEXT) & F.col("root"), F.col("token"))).alias("strings"),
        F.collect_list(F.when(F.col("kind") == LINKS, F.col("path"))).alias("lists"),
    )


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", min_pages: int = MIN_PAGES, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """key, url, text for every page: the article, one line a block; empty if there is none.

    A null html counts as empty; pages without a url share the empty host. Pages that say the same count
    once for the template. Hosts with few different pages have no template of their own: their pages lose only what the element
    itself marks. Other columns are left out.
    """
    import pyarrow as pa

    named = with_host_and_path(pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(html).alias("html")), "url").drop("path")
    made = stored(templates(named.select("host", "html"), min_pages, min_tokens), "templates")
    both = named.join(made, "host", "left").select("key", "url", "html", "strings", "lists")

    def run(batches):
        for batch in batches:
            texts = [
                content(h or "", frozenset(s or ()), frozenset(p or ()))
                for h, s, p in zip(*(batch.column(n).to_pylist() for n in (2, 3, 4)), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["key", "url", "text"])

    kind = pages.schema[key].dataType
    from pyspark.sql import types as T

    out = both.mapInArrow(run, T.StructType([T.StructField("key", kind), T.StructField("url", T.StringType()), T.StructField("text", T.StringType())]))
    return out.select(F.col("key").alias(key), F.col("url").alias(url), "text")
