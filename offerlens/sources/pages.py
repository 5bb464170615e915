"""Raw pages: block detection, robots rules, HTML tiles and embedded payloads."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

# Fixed values.
BLOCK_MARKERS = {"datadome": ["datadome", "captcha-delivery"], "cloudflare": ["cf-challenge", "just a moment", "cf_chl"], "bot protection": ["access denied", "are you a robot", "unusual traffic", "incapsula"]}
BLOCK_CHARS = 200_000
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
WRAPPERS = ("Ref", "ShallowRef", "Reactive", "ShallowReactive", "EmptyRef", "EmptyShallowRef")


def detect_block(body: Column) -> Column:
    """Which protection a page shows instead of its content; null for none."""
    head = F.lower(F.substring(body, 1, BLOCK_CHARS))
    return F.coalesce(*(F.when(head.contains(m), label) for label, markers in BLOCK_MARKERS.items() for m in markers))


def robots_rules(files: DataFrame, agent: str) -> DataFrame:
    """``host, pattern, allow, fallback`` of ``files(host, body)``: the rules of the agent's own block, else of ``*``."""
    line = F.posexplode(F.split("body", r"\r?\n")).alias("at", "line")
    lines = files.select("host", line).withColumn("line", F.trim(F.regexp_replace("line", "#.*", ""))).where("line <> ''")
    field = F.lower(F.trim(F.substring_index("line", ":", 1)))
    lines = lines.select("host", "at", field.alias("field"), F.trim(F.expr("substring(line, instr(line, ':') + 1)")).alias("value"))
    # a run of agent lines opens a block; one host's file is one small group
    w = Window.partitionBy("host").orderBy("at")
    opens = ((F.col("field") == "user-agent") & (F.coalesce(F.lag("field").over(w), F.lit("")) != "user-agent")).cast("int")
    blocks = lines.withColumn("block", F.sum(opens).over(w))
    agents = blocks.where("field = 'user-agent'").select("host", "block", F.lower("value").alias("name"))
    named = agents.where((F.col("name") != "*") & F.lit(agent.lower()).contains(F.col("name"))).select("host", "block").distinct()
    general = agents.where("name = '*'").join(named.select("host").distinct(), "host", "left_anti").select("host", "block").distinct()
    rules = blocks.where(F.col("field").isin("allow", "disallow") & (F.col("value") != ""))
    return rules.join(named.unionByName(general), ["host", "block"], "left_semi").select("host", F.col("value").alias("pattern"), (F.col("field") == "allow").alias("allow"))


def robots_allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls(url)`` with ``allowed``: the longest rule that fits wins, a tie allows, no rule allows."""
    quoted = F.regexp_replace("pattern", r"([\\.+?^{}()\[\]|])", r"\\$1")
    regex = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(quoted, r"\*", ".*"), r"\$(?!$)", r"\\$"))
    u = urls.withColumn("host", F.lower(F.try_parse_url("url", F.lit("HOST")))).withColumn(
        "path", F.concat(F.coalesce(F.nullif(F.try_parse_url("url", F.lit("PATH")), F.lit("")), F.lit("/")), F.coalesce(F.concat(F.lit("?"), F.try_parse_url("url", F.lit("QUERY"))), F.lit(""))))
    fit = u.select("url", "host", "path").distinct().join(rules.withColumn("regex", regex), "host").where(F.regexp_like("path", "regex"))
    best = fit.groupBy("url").agg(F.max_by("allow", F.struct(F.length("pattern").alias("n"), F.col("allow").alias("a"))).alias("allowed"))
    return urls.join(best, "url", "left").withColumn("allowed", F.coalesce("allowed", F.lit(True)))


#: Elements whose start closes an open one, by what it closes and what it does not look beyond (the optional tags of HTML).
_BLOCKS = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
_TABLE = frozenset({"table", "html", "body"})
IMPLIED: dict[str, tuple[frozenset[str], frozenset[str]]] = {
    **{t: (frozenset({"p"}), frozenset({"table", "td", "th", "caption", "button", "object", "html", "body"})) for t in _BLOCKS},
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu", "table", "td", "th", "html", "body"})),
    **{t: (frozenset({"dt", "dd"}), frozenset({"dl", "table", "td", "th", "html", "body"})) for t in ("dt", "dd")},
    "option": (frozenset({"option"}), frozenset({"select", "datalist", "html", "body"})),
    "optgroup": (frozenset({"option", "optgroup"}), frozenset({"select", "html", "body"})),
    **{t: (frozenset({"td", "th"}), frozenset({"tr"}) | _TABLE) for t in ("td", "th")},
    "tr": (frozenset({"tr", "td", "th", "caption", "colgroup"}), _TABLE),
    **{t: (frozenset({"tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"}), _TABLE) for t in ("thead", "tbody", "tfoot")},
    **{t: (frozenset({"rt", "rp"}), frozenset({"ruby", "html", "body"})) for t in ("rt", "rp")},
}


class _Tree(HTMLParser):
    """Nodes ``[tag, attributes, children, parent]``; texts are plain strings among the children."""

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.root: list = ["", {}, [], None]
        self.at = self.root
        self.feed(page)
        self.close()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in IMPLIED:
            closes, stops = IMPLIED[tag]
            node = self.at
            while node is not self.root and node[0] not in stops:
                if node[0] in closes:
                    self.at = node[3]
                node = node[3]
        node = [tag, {k: v or "" for k, v in attrs}, [], self.at]
        self.at[2].append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if self.at[0] == tag and tag not in VOID:
            self.at = self.at[3]

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node is not self.root and node[0] != tag:
            node = node[3]
        if node is not self.root:
            self.at = node[3]

    def handle_data(self, data: str) -> None:
        self.at[2].append(data)


def _walk(node: list) -> Iterator[list]:
    """All nodes below, in the page's order; a stack, as pages may nest deeper than calls."""
    todo = [c for c in reversed(node[2]) if isinstance(c, list)]
    while todo:
        n = todo.pop()
        yield n
        todo += [c for c in reversed(n[2]) if isinstance(c, list)]


def _fits(node: list, selector: str) -> bool:
    """``tag``, ``.class``, ``tag.class`` or ``[attribute]``."""
    if selector.startswith("["):
        return selector[1:-1] in node[1]
    tag, *classes = selector.split(".")
    own = node[1].get("class", "").split()
    return (not tag or node[0] == tag) and all(c in own for c in classes)


def _text(node: list) -> str:
    out: list[str] = []
    todo: list = list(reversed(node[2]))
    while todo:
        c = todo.pop()
        if isinstance(c, str):
            out.append(c)
        elif c[0] not in ("script", "style"):
            todo += reversed(c[2])
    return re.sub(r"\s+", " ", " ".join(out)).strip()


def _find(tile: list, selector: str) -> Iterator[list]:
    """Nodes below ``tile`` that fit the last of the selector's parts, inside nodes that fit the others in turn."""
    *outer, last = selector.split()
    for n in _walk(tile):
        if not _fits(n, last):
            continue
        up, left = n[3], list(outer)
        while left and up is not None:
            if _fits(up, left[-1]):
                left.pop()
            up = up[3] if up is not tile else None
        if not left:
            yield n


def _value(tile: list, spec: str) -> str | None:
    """``selector`` for the text of the first fitting node, ``selector*`` for the texts of all, ``selector@name`` for an attribute, ``@name`` for the
    tile's own; of several, split by ``|``, the first that gives a text."""
    for one in spec.split("|"):
        selector, _, name = one.partition("@")
        if selector.endswith("*"):
            found: str | None = " ".join(filter(None, map(_text, _find(tile, selector[:-1]))))
        else:
            node = next(_find(tile, selector), None) if selector else tile
            found = None if node is None else node[1].get(name) if name else _text(node)
        if found or one == spec:
            return found
    return None


def tiles(pages: DataFrame, tile: str, fields: dict[str, str], html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """One row per node that fits ``tile``, with the named fields as strings and ``all_text``."""
    kept = keep or [c for c in pages.columns if c != html]
    types = dict(pages.dtypes)
    schema = ", ".join([*(f"{c} {types[c]}" for c in kept), "position int", *(f"{f} string" for f in fields), "all_text string"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.to_dict("records"):
                found = [n for n in _walk(_Tree(r[html] or "").root) if _fits(n, tile)]
                rows += [[*(r[c] for c in kept), i, *(_value(n, s) for s in fields.values()), _text(n)] for i, n in enumerate(found)]
            yield pd.DataFrame(rows, columns=[*kept, "position", *fields, "all_text"])

    return pages.select(*kept, html).mapInPandas(run, schema)


def absolute_url(base: Column, href: Column) -> Column:
    """An address as its page means it; null for none."""

    @F.pandas_udf("string")
    def absolute(bases: pd.Series, hrefs: pd.Series) -> pd.Series:
        return pd.Series([_joined_url(b, h) for b, h in zip(bases, hrefs, strict=True)], dtype=object)

    return absolute(base, href)


def _joined_url(base: str | None, href: str | None) -> str | None:
    try:
        return None if href is None else urljoin(base or "", href)
    except ValueError:  # a bracket that is no address
        return None


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Absolute links of every page."""
    got = tiles(pages.select(url, html), "a", {"href": "@href"}, html, [url])
    return got.where("href IS NOT NULL").select(url, absolute_url(F.col(url), F.col("href")).alias("link"), "all_text")


class Graph:
    """A flat array whose values are places in it."""

    def __init__(self, array: list, keyed: bool, depth: int):
        self.array, self.keyed, self.depth = array, keyed, depth

    def _hop(self, x: object, left: int, trail: tuple | None) -> tuple[object, int, tuple | None]:
        """What ``x`` stands for, behind all places and wrappers, with the steps that are left and the places behind it; None for a cycle."""
        while left > 0:
            if type(x) is list and not self.keyed and len(x) == 2 and isinstance(x[0], str) and x[0] in WRAPPERS:
                x, left = x[1], left - 1
                continue
            if type(x) is not int or not (self.keyed or 0 <= x < len(self.array)):
                return x, left, trail
            behind = trail
            while behind is not None and behind[0] != x:
                behind = behind[1]
            if behind is not None or not 0 <= x < len(self.array):
                return None, left, trail
            trail, x, left = (x, trail), self.array[x], left - 1
            if self.keyed and not isinstance(x, (list, dict)):
                return x, max(left, 1), trail  # a scalar at its place is a value, never another place
        return None, 0, trail

    def value(self, x: object) -> object:
        """``x`` with places resolved, container by container from a worklist; a cycle or too deep a nesting gives None."""
        out: list = [None]
        todo: list[tuple[list | dict, object, object, int, tuple | None]] = [(out, 0, x, self.depth, None)]
        while todo:
            into, slot, raw, left, trail = todo.pop()
            raw, left, trail = self._hop(raw, left, trail)
            if isinstance(raw, list) and left > 0:
                made: list | dict = [None] * len(raw)
                todo += [(made, i, v, left - 1, trail) for i, v in enumerate(raw)]
            elif isinstance(raw, dict) and left > 0:
                made = dict.fromkeys(map(self.key, raw))
                todo += [(made, self.key(k), v, left - 1, trail) for k, v in raw.items()]
            else:
                made = None if isinstance(raw, (list, dict)) else raw
            into[slot] = made
        return out[0]

    def key(self, k: str) -> str:
        if self.keyed and (m := re.fullmatch(r"_(\d+)", k)) and int(m[1]) < len(self.array):
            return str(self.array[int(m[1])])
        return k

    def objects(self, required: list[str]) -> list[dict]:
        """Objects of the flat array that have all the keys, resolved."""
        found = [e for e in self.array if isinstance(e, dict) and set(required) <= {self.key(k) for k in e}]
        return [v for v in map(self.value, found) if isinstance(v, dict)]


def graph_objects(text: Column, required: list[str], keyed: bool = False, depth: int | None = None) -> Column:
    """Array of JSON objects with the required keys, from an index graph in JSON. ``keyed``: keys are places too."""
    limit = depth or (24 if keyed else 12)

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            try:
                data = json.loads(t) if t else None
            except (ValueError, RecursionError):
                data = None
            out.append([json.dumps(o, ensure_ascii=False) for o in Graph(data, keyed, limit).objects(required)] if isinstance(data, list) else [])
        return pd.Series(out)

    return run(text)


def embedded_objects(text: Column, required: list[str]) -> Column:
    """Array of the balanced JSON objects inside a text, at any depth, that have all the keys."""

    def walk(v: object) -> Iterator[dict]:
        todo = [v]
        while todo:
            x = todo.pop()
            if isinstance(x, dict):
                if set(required) <= set(x):
                    yield x
                todo += reversed(list(x.values()))
            elif isinstance(x, list):
                todo += reversed(x)

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        decoder, out = json.JSONDecoder(), []
        for t in texts:
            found, at = [], 0
            while t and (at := t.find("{", at)) >= 0:
                try:
                    value, at = decoder.raw_decode(t, at)
                    found += [json.dumps(o, ensure_ascii=False) for o in walk(value)]
                except (ValueError, RecursionError):
                    at += 1
            out.append(found)
        return pd.Series(out)

    return run(text)


def script_payload(html: Column, marker: str) -> Column:
    """Body of the first script element whose tag holds the marker."""
    return F.nullif(F.regexp_extract(html, r"(?is)<script[^>]*" + re.escape(marker) + r"[^>]*>(.*?)</script>", 1), F.lit(""))


def unescape(text: Column) -> Column:
    """Text with the usual HTML entities replaced."""
    for a, b in (("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def title(html: Column) -> Column:
    return F.trim(F.regexp_replace(unescape(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), r"\s+", " "))


def page_lang(html: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(html, r"(?i)<html[^>]*\blang=[\"']?([A-Za-z-]+)", 1)), F.lit(""))
