"""Fields of HTML pages by selectors, in one pass over each page inside a Spark job.

A rule names elements by a chain of simple selectors (tag, .class, [attribute=value], descendants by blanks), or by the label in
a paragraph near them, and says which to take: the first, all, the only one, or one inside each. Pages may be broken: open elements
end with their parent, unknown end tags are skipped, what is no tag is text. A page is cut at its tags; the shape that these give, and what
selectors find in it, is kept for the pages of a task that share it. A field that can't be read has its default, the row lives on, and the same
pass can say of each such field why, so that what failed is told from what a page doesn't have.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracota.functions.clean import best_photo, first_photo, photos
from terracota.schema import RAW, RAW_COLUMNS

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SIMPLE = re.compile(r"^([\w-]+)?((?:\.[\w-]+)*)((?:\[[\w-]+=[^\]]*\])*)$")
#: A comment's or declaration's begin, or a tag: end mark, name, what follows up to its end.
TAG = re.compile(r"""<(?:(!--)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+>|[^>]*>)|[!?][^>]*>)""")
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""")
RAW_TEXT = {t: re.compile(f"</{t}", re.I) for t in ("script", "style")}


@dataclass(frozen=True)
class Rule:
    """css: elements. take: first, all, only, or each (inner, else the first one with attr, inside each). attr: an attribute in place of the text.
    has: text that the element holds. label: text of a p; then: what comes next after that p, inside the css element; beside: the p after the div around it;
    else the p in the div after it. tight: each piece of text is stripped. default: the value if there is no element."""

    css: str = ""
    take: str = "first"
    attr: str = ""
    has: str = ""
    label: str = ""
    inner: str = ""
    then: str = ""
    beside: bool = False
    tight: bool = False
    default: str | None = None


def by_id(name: str, take: str = "first") -> Rule:
    return Rule(f"[data-testid={name}]", take)


FIELDS = {
    "titulo": Rule("h2.text-neutral-130.line-clamp-2"),
    "metragem": Rule("p.font-secondary", has="m²"),
    "banheiros": Rule(label="Banheiros"),
    "vagas": Rule(label="Vagas"),
    "quartos": Rule(label="Quartos"),
    "valor_venda": Rule(".value-item__value-highlight .value-item__value"),
    "condominio": by_id("condoFee"),
    "endereco": by_id("location-address"),
    "iptu": by_id("iptu"),
    "descricao": by_id("description-content"),
    "data_criacao": by_id("listing-created-date"),
    "caracteristicas": Rule("ul[data-testid=amenities-list] li span.amenities-item-text", "all"),
    "fotos": Rule("ul[data-testid=carousel-photos] source[type=image/webp]", "all", "srcset"),
    "link_maps": Rule("iframe[data-testid=map-iframe]", "only", "src"),
}
#: The same fields in the older form of the pages. Fixed values.
OLD_FIELDS = FIELDS | {
    "titulo": Rule("h2.text-neutral-130", tight=True),
    **{k: Rule("ul.amenities-scrollbar", label=label, then="p.font-bold", tight=True) for k, label in (("metragem", "Metragem"), ("banheiros", "Banheiros"), ("vagas", "Vagas"), ("quartos", "Quartos"))},
    "valor_venda": Rule(label="Venda", beside=True, tight=True, default="N/A"),
    "condominio": Rule("p[data-testid=condoFee]", tight=True, default="N/A"),
    "endereco": Rule("[data-testid=location-address]", tight=True),
    "iptu": Rule("p[data-testid=iptu]", tight=True, default="N/A"),
    "descricao": Rule("p[data-testid=description-content]", tight=True, default="N/A"),
    "fotos": Rule("li.carousel-photos--item", "each", "srcset", inner="source"),
}
RESULT_LINKS = Rule(".listings-wrapper a.olx-core-surface", "all", "href")
CARD_LINKS = Rule("li[data-cy=rp-property-cd]", "each", "href")
LAST_PAGE = Rule(".olx-core-pagination__button", "all")


class Unreadable(ValueError):
    """A page has the element, but no value can be taken from it."""


#: Quotes in what follows a tag's name close each other, so the tag ends at the first ">".
CLOSED = re.compile(r"""(?:[^>"']|"[^"]*"|'[^']*')*+>""")
#: Attributes that selectors may ask for by value. Others count by name alone for the shape of a page.
TESTED = ("class", "data-testid", "data-cy", "type", "itemprop")
#: How many tags and shapes a task keeps.
KEPT_TAGS, KEPT_SHAPES = 20_000, 500
SKIPPED, ENDS, OPENS = 0, 1, 2


class Shape:
    """Elements in order, without their texts: tag, attributes that selectors test, parent, the range of elements inside, and that of the pieces of text inside.
    What selectors find is kept, as pages made by one program share few shapes."""

    def __init__(self, kinds):
        self.tags: list[str] = []
        self.own: list[dict] = []
        self.at: list[int] = []
        self.parent: list[int] = []
        self.stop: list[int] = []
        self.begin: list[int] = []
        self.end: list[int] = []
        self.by_tag: dict[str, list[int]] = {}
        self.found: dict = {}
        tags, parent, stop, begin, end = self.tags, self.parent, self.stop, self.begin, self.end
        stack: list[int] = []
        t = 0

        def close(depth):
            n = len(tags)
            for i in stack[depth:]:
                stop[i], end[i] = n, t
            del stack[depth:]

        for t, (does, tag, own, closed) in enumerate(kinds, 1):
            if does == ENDS:
                for depth in range(len(stack) - 1, -1, -1):
                    if tags[stack[depth]] == tag:
                        close(depth)
                        break
            elif does == OPENS:
                if (tag == "p" or tag == "li") and stack and tags[stack[-1]] == tag:
                    close(len(stack) - 1)
                i = len(tags)
                self.by_tag.setdefault(tag, []).append(i)
                tags.append(tag)
                self.own.append(own)
                self.at.append(t - 1)
                parent.append(stack[-1] if stack else -1)
                begin.append(t)
                end.append(t)
                stop.append(i + 1)
                if not closed:
                    stack.append(i)
        t += 1
        close(0)

    def matches(self, i: int, simple: tuple) -> bool:
        tag, classes, attrs = simple
        if tag and self.tags[i] != tag:
            return False
        own = self.own[i]
        return (not classes or classes <= set(own.get("class", "").split())) and all(own.get(k) == v for k, v in attrs)

    def select(self, css: str, inside: int = -1) -> list[int]:
        key = (css, inside)
        if key not in self.found:
            *above, last = chain(css)
            end = self.stop[inside] if inside >= 0 else len(self.tags)
            known = self.by_tag.get(last[0], ()) if last[0] else range(inside + 1, end)
            self.found[key] = [i for i in known if inside < i < end and self.matches(i, last) and (not above or self._under(i, above))]
        return self.found[key]

    def _under(self, i: int, above: list) -> bool:
        todo, at = list(above), self.parent[i]
        while todo and at >= 0:
            if self.matches(at, todo[-1]):
                todo.pop()
            at = self.parent[at]
        return not todo

    def beside(self, i: int) -> list[int]:
        """The p after the div around element i."""
        if (key := ("beside", i)) not in self.found:
            at = self.parent[i]
            while at >= 0 and self.tags[at] != "div":
                at = self.parent[at]
            self.found[key] = [j for j in self.by_tag.get("p", ()) if at >= 0 and j >= self.stop[at] and self.parent[j] == self.parent[at]][:1]
        return self.found[key]

    def below(self, i: int) -> list[int]:
        """The p elements in the divs that come after element i, beside it."""
        if (key := ("below", i)) not in self.found:
            divs = {j for j in self.by_tag.get("div", ()) if j > i and self.parent[j] == self.parent[i]}
            self.found[key] = [j for j in self.by_tag.get("p", ()) if self.parent[j] in divs]
        return self.found[key]


class Reader:
    """Takes pages apart, and keeps the tags and shapes that it has seen. Attributes outside `tested` are compared by no selector."""

    def __init__(self, rules: Iterable[Rule] = ()):
        self.tested = frozenset(TESTED).union(k for rule in rules for k in re.findall(r"\[([\w-]+)=", f"{rule.css} {rule.inner} {rule.then}"))
        self.tags: dict[str, tuple] = {}
        self.kinds: dict[tuple, int] = {}
        self.known: list[tuple] = []
        self.shapes: dict[tuple, Shape] = {}

    def tag(self, inner: str) -> tuple:
        """(number of its kind, attributes, whether it ends at its first ">", the raw text it begins) of a tag, without its brackets."""
        if len(self.tags) >= KEPT_TAGS:
            self.tags.clear()
        m = None if inner.startswith("!--") else TAG.fullmatch(f"<{inner}>")
        _, ends, tag, attributes = m.groups() if m else (None,) * 4
        if not m:
            own, kind, closed, raw = {}, (SKIPPED, "", (), True), False, ""
        elif not tag:
            own, kind, closed, raw = {}, (SKIPPED, "", (), True), True, ""
        else:
            tag, closed, raw = tag.lower(), bool(CLOSED.fullmatch(attributes)), ""
            if ends:
                own, kind = {}, (ENDS, tag, (), True)
            else:
                own = {k.lower(): unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(attributes[:-1])}
                alone = tag in VOID or attributes.endswith("/>")
                kind, raw = (OPENS, tag, tuple((k, v if k in self.tested else "") for k, v in own.items()), alone), "" if alone or tag not in RAW_TEXT else tag
        if (number := self.kinds.get(kind)) is None:
            number = self.kinds[kind] = len(self.known)
            self.known.append((kind[0], kind[1], dict(kind[2]), kind[3]))
        found = (number, own, closed, raw)
        if len(inner) < 500:
            self.tags[inner] = found
        return found

    def read(self, html: str) -> Page:
        if len(self.kinds) >= KEPT_TAGS:  # numbers begin anew, and with them all that refers to them
            self.kinds, self.known = {}, []
            self.tags.clear()
            self.shapes.clear()
        tags, text = self._plain(html) or self._any(html)
        key = tuple([t[0] for t in tags])
        if (shape := self.shapes.get(key)) is None:
            if len(self.shapes) >= KEPT_SHAPES:
                self.shapes.clear()
            shape = self.shapes[key] = Shape([self.known[n] for n in key])
        return Page(html, shape, tags, text)

    def _plain(self, html: str) -> tuple[list, list] | None:
        """Tags, and the text before the first and behind each, of a page whose "<" each begin a tag that ends at the next ">"; else null."""
        first, *parts = html.split("<")
        if not parts:
            return [], [first]
        parts = [p.partition(">") for p in parts]
        known, read, tags, text, raw = self.tags.get, self.tag, [], [first], ""
        for inner, end, behind in parts:
            if raw:
                if not RAW_TEXT[raw].match(f"<{inner}"):
                    continue
                raw = ""
            if not end:
                return None
            found = known(inner) or read(inner)
            if not found[2]:
                return None
            tags.append(found)
            if raw := found[3]:
                behind = ""
            text.append(behind)
        return tags, text

    def _any(self, html: str) -> tuple[list, list]:
        """The same of any page."""
        find, at, last_comment = TAG.search, 0, html.rfind("-->")
        tags, text, known = [], [""], self.tags.get
        while m := find(html, at):
            text[-1] += html[at : m.start()]
            at = m.end()
            if m[1]:
                at = html.index("-->", at) + 3 if at <= last_comment else len(html)
                tags.append(self.tag("!--"))
            else:
                found = known(m[0][1:-1]) or self.tag(m[0][1:-1])
                tags.append(found)
                if found[3]:
                    end = RAW_TEXT[found[3]].search(html, at)
                    at = end.start() if end else len(html)
            text.append("")
        text[-1] += html[at:]
        return tags, text


class Page:
    """A page: its shape, and what stands in it. texts: the pieces of text before the first tag and behind each."""

    def __init__(self, html: str, shape: Shape | None = None, tags: list | None = None, texts: list[str] | None = None):
        if shape is None:
            own = Reader()
            tags, texts = own._plain(html) or own._any(html)
            shape = Shape([(*own.known[t[0]][:2], t[1], own.known[t[0]][3]) for t in tags])
        self.shape, self._tags, self.texts = shape, tags, texts
        self._labels: dict[str, list[int]] | None = None

    @property
    def tags(self) -> list[str]:
        return self.shape.tags

    @property
    def text(self) -> list[str]:
        return [t for t in self.texts if t]

    @property
    def by_tag(self) -> dict[str, list[int]]:
        return self.shape.by_tag

    def attributes(self, i: int) -> dict:
        return self._tags[self.shape.at[i]][1]

    def pieces(self, i: int) -> list[str]:
        return [unescape(t) if "&" in t else t for t in self.texts[self.shape.begin[i] : self.shape.end[i]]]

    def text_of(self, i: int) -> str:
        return "".join(self.pieces(i))

    def select(self, css: str, inside: int = -1) -> list[int]:
        return self.shape.select(css, inside)

    def _labelled(self, label: str) -> list[int]:
        """p elements with this text."""
        if self._labels is None:
            self._labels = {}
            for i in self.by_tag.get("p", ()):
                self._labels.setdefault(self.text_of(i).strip(), []).append(i)
        return self._labels.get(label, [])

    def labelled(self, rule: Rule) -> list[int]:
        out, shape = [], self.shape
        if rule.then:
            for box in self.select(rule.css)[:1]:
                for i in [i for i in self._labelled(rule.label) if box < i < shape.stop[box]][:1]:
                    out += [j for j in self.select(rule.then) if j > i][:1]
            return out
        for i in self._labelled(rule.label):
            if rule.beside:
                return shape.beside(i)
            out += shape.below(i)
        return out

    def each(self, rule: Rule) -> list[int]:
        """The first inner element, or the first one with the attribute, inside each element."""
        out = []
        for i in self.select(rule.css):
            out += self.select(rule.inner, i)[:1] if rule.inner else [j for j in range(i + 1, self.shape.stop[i]) if rule.attr in self.attributes(j)][:1]
        return out

    def get(self, rule: Rule):
        """The value; null where the element has none."""
        try:
            return self.read(rule)
        except Unreadable:
            return None

    def read(self, rule: Rule):
        """The value; an error that says why where the element has none."""
        found = self.labelled(rule) if rule.label else self.each(rule) if rule.take == "each" else self.select(rule.css)
        if rule.has:
            found = [i for i in found if rule.has in self.text_of(i)]
        tight = lambda i: "".join(p.strip() for p in self.pieces(i))
        value = (lambda i: self.attributes(i).get(rule.attr)) if rule.attr else tight if rule.tight else (lambda i: clean(self.text_of(i)))
        if rule.take in ("all", "each"):
            return [v for v in map(value, found) if v]
        if not found:
            if rule.label and self._labelled(rule.label):  # only a missing label has the default
                raise Unreadable("a label without its value")
            return rule.default
        if rule.take == "only" and len(found) > 1:
            raise Unreadable("several elements for one")
        if rule.attr and rule.attr not in self.attributes(found[0]):
            raise Unreadable("an element without its attribute")
        return value(found[0])

    def tax(self):
        """The value beside IPTU if there is exactly one such element, else the test-id; an empty one is null."""
        found = {j for i in self.select("div.value-item") if "IPTU" in self.text_of(i) for j in self.select("p.value-item__value", i)}
        return clean(self.text_of(found.pop())) if len(found) == 1 else self.read(FIELDS["iptu"])


def clean(text: str) -> str | None:
    """Without Unicode blanks at both ends; the empty text is null, while blanks alone give the empty text."""
    return text.strip() if text else None


_chains: dict[str, list[tuple]] = {}


def chain(css: str) -> list[tuple]:
    if css not in _chains:
        steps = []
        for part in css.split():
            tag, classes, attrs = SIMPLE.match(part).groups()
            classes, attrs = frozenset(classes.split(".")[1:]), tuple(tuple(a.split("=", 1)) for a in re.findall(r"\[([^\]]*)\]", attrs))
            steps.append((tag, classes, attrs))
        _chains[css] = steps
    return _chains[css]


ERRORS = (ArithmeticError, AttributeError, LookupError, RecursionError, TypeError, ValueError, re.error)


def guarded(read, default, failed: dict | None = None, name: str = ""):
    """A field that can't be read has its default; the row lives on. failed gets the reason under name."""
    try:
        return read()
    except ERRORS as e:
        if failed is not None:
            failed[name] = str(e) if isinstance(e, Unreadable) else type(e).__name__
        return default


LISTS = ("caracteristicas", "fotos")


def extract_listings(pages: DataFrame, fields: list[str] | None = None, url_col: str = "url", html_col: str = "html", rules: dict[str, Rule] | None = None, parts: int | None = None, failures: bool = False) -> DataFrame:
    """Raw listings, one for each page, with extract_status: ok, no_page where html is null, or failed where it can't be read at all (only url is set then).

    fields: names to read, when few are needed; others are null, and with none at all no page is parsed or sent to Python. rules: FIELDS, or
    OLD_FIELDS for pages of the older form. Photos are the largest candidate of each source, in the older form the first. parts: see spread.
    failures: a further column `failed`, field -> why it has its default though the page has its element, or its rule broke off.
    """
    rules = rules or FIELDS
    old, wanted = rules is OLD_FIELDS, {k: rules[k] for k in (rules if fields is None else fields)}
    rows = pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    if not wanted:
        none = [F.array().cast("array<string>").alias(f.name) if f.name in LISTS else F.lit(None).cast(f.dataType).alias(f.name) for f in RAW if f.name != "url"]
        more = [F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("failed")] if failures else []
        return rows.select("url", *none, F.when(F.col("html").isNull(), "no_page").otherwise("ok").alias("extract_status"), *more)
    texts, maps = pa.list_(pa.string()), pa.map_(pa.string(), pa.string())
    types = {c: texts if c in LISTS else pa.string() for c in RAW_COLUMNS} | {"extract_status": pa.string()} | ({"failed": maps} if failures else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(wanted.values())
        for batch in batches:
            urls = batch.column("url").to_pylist()
            out = {c: [[] for _ in urls] if c in LISTS else [None] * len(urls) for c in types} | {"url": urls, "failed": [()] * len(urls)}
            for at, html in enumerate(batch.column("html").to_pylist()):
                if not isinstance(html, str):
                    out["extract_status"][at] = "no_page"
                    continue
                failed: dict[str, str] = {}
                page = guarded(lambda h=html: reader.read(h), None, failed, "page")
                out["extract_status"][at] = "ok" if page else "failed"
                for name, rule in wanted.items() if page else ():
                    try:
                        out[name][at] = page.tax() if name == "iptu" and not old else page.read(rule)
                    except ERRORS as e:
                        failed[name] = str(e) if isinstance(e, Unreadable) else type(e).__name__
                out["failed"][at] = list(failed.items())
            yield pa.RecordBatch.from_arrays([pa.array(out[c], t) for c, t in types.items()], list(types))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in RAW) + ", extract_status string" + (", failed map<string,string>" if failures else "")
    out = spread(rows, parts).mapInArrow(run, schema)
    return out.withColumn("fotos", photos("fotos", first_photo if old else best_photo)) if "fotos" in wanted else out


def field_outcomes(listings: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """(field, n_ok, n_absent, n_failed, reasons): of the pages that were read, how many have a value, have none, or have one that couldn't be read; reasons counts the failures.

    listings: extract_listings(..., failures=True). An empty list is no value.
    """
    names = fields or [c for c in RAW_COLUMNS if c != "url"]
    some = lambda c: F.size(c) > 0 if c in LISTS else F.col(c).isNotNull()
    each = F.array(*(F.struct(F.lit(c).alias("field"), some(c).alias("ok"), F.element_at("failed", F.lit(c)).alias("reason")) for c in names))
    rows = listings.where("extract_status = 'ok'").select(F.explode(each).alias("x")).select("x.*")
    counts = rows.groupBy("field", "ok", "reason").agg(F.count("*").alias("n"))  # a few rows a field
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    failed = F.col("reason").isNotNull()
    reasons = F.map_from_entries(F.array_sort(F.collect_list(F.when(failed, F.struct("reason", "n")))))
    return counts.groupBy("field").agg(total(~failed & F.col("ok")).alias("n_ok"), total(~failed & ~F.col("ok")).alias("n_absent"), total(failed).alias("n_failed"), reasons.alias("reasons"))


def first_photos(srcsets):
    """Address of each source's first candidate."""
    return photos(srcsets, first_photo)


def select_all(pages: DataFrame, rules: dict[str, Rule], keep: list[str], html_col: str = "html", parts: int | None = None) -> DataFrame:
    """keep columns, and an array of texts for each rule (take: all or each)."""
    schema = ", ".join([*(f"{c} {pages.schema[c].dataType.simpleString()}" for c in keep), *(f"{k} array<string>" for k in rules)])
    text = _unused("html", keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(rules.values())
        for batch in batches:
            read = [guarded(lambda h=h: reader.read(h), Page("")) for h in (h if isinstance(h, str) else "" for h in batch.column(text).to_pylist())]
            found = [pa.array([guarded(lambda r=r, p=p: p.get(r), []) for p in read], pa.list_(pa.string())) for r in rules.values()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *found], [*keep, *rules])

    return spread(pages.select(*keep, F.col(html_col).alias(text)), parts).mapInArrow(run, schema)


def characteristics(pages: DataFrame, keep: list[str], html_col: str = "html", parts: int | None = None) -> DataFrame:
    """keep columns and the map itemprop -> text; of a repeated key the last counts."""
    schema = ", ".join([*(f"{c} {pages.schema[c].dataType.simpleString()}" for c in keep), "caracteristicas map<string,string>"])
    text = _unused("html", keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            maps = []
            for html in batch.column(text).to_pylist():
                page, found = guarded(lambda h=html: reader.read(h if isinstance(h, str) else ""), Page("")), {}
                for i in page.by_tag.get("li", ()):
                    if (name := page.attributes(i).get("itemprop")) and (spans := page.select("span.amenities-item-text", i)):
                        found[name] = clean(page.text_of(spans[0]))
                maps.append(list(found.items()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(maps, pa.map_(pa.string(), pa.string()))], [*keep, "caracteristicas"])

    return spread(pages.select(*keep, F.col(html_col).alias(text)), parts).mapInArrow(run, schema)


def _unused(name: str, taken: list[str]) -> str:
    while name in taken:
        name += "_"
    return name


def spread(pages: DataFrame, parts: int | None = None) -> DataFrame:
    """Pages dealt out, row by row, to that many tasks; without parts as they are. For tables of fewer splits (files, or row groups) than there are cores:
    reading a page costs much more than moving it. Tables of many files need no parts, and a page store (sources/page_store.py) keeps its layout only without."""
    return pages if parts is None or pages.isStreaming else pages.repartition(parts)


def total_pages(texts: Column) -> Column:
    """Number in the last pagination button's text, dots removed; 0 if there is none."""
    return F.coalesce(F.trim(F.replace(F.try_element_at(texts, F.lit(-1)), F.lit("."), F.lit(""))).try_cast("int"), F.lit(0))
