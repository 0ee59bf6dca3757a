"""Citable units of marked-up acts and judgments as rows: one pass over a page gives all its units, a lookup is a filter."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from xml.etree import ElementTree

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versed.functions import legacy
from versed.functions.python import flat

HEADING = re.compile(r"(?i)article\s+\d+[a-z]?$")
#: Classes of an act's title, and how many lines of each make one.
TITLES = {"oj-doc-ti": 2, "title-doc-first": 2, "doc-ti": 2, "oj-ti-tbl": 1}
#: Tags that never hold one of their own kind directly.
LIKE = frozenset(("p", "li", "tr", "td", "th", "dt", "dd", "option"))
VOID = frozenset(("br", "img", "meta", "link", "input", "hr", "col", "area", "base", "wbr"))


class Node:
    __slots__ = ("attrs", "children", "tag", "up")

    def __init__(self, tag: str, attrs: dict[str, str], up: Node | None):
        self.tag, self.attrs, self.up, self.children = tag, attrs, up, []

    def walk(self):
        """This node and all below it in order; without recursion, since tags that nobody closed nest deeply."""
        todo = [self]
        while todo:
            n = todo.pop()
            yield n
            todo += [c for c in reversed(n.children) if isinstance(c, Node)]

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                out.append(n)
            elif n.tag not in ("script", "style"):
                todo += reversed(n.children)
        return re.sub(r"\s+", " ", " ".join(out) if self.tag == "tr" else "".join(out)).strip()

    def has(self, name: str) -> bool:
        return name in self.attrs.get("class", "").split()


class Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in LIKE and self.at.tag == tag:  # one that wasn't closed
            self.at = self.at.up
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        n = self.at
        while n.up is not None and n.tag != tag:
            n = n.up
        if n.up is not None:
            self.at = n.up

    def handle_data(self, data):
        self.at.children.append(data)


def within(node: Node, tag: str) -> Node | None:
    while node is not None and node.tag != tag:
        node = node.up
    return node


def parsed(markup: str | None) -> Node:
    tree = Tree()
    tree.feed(markup or "")
    tree.close()
    return tree.root


def units(markup: str | None) -> list[tuple[str, str, str]]:
    """(unit_id, kind, text) of a page; of equal ids the first counts.

    Kinds: article, annex, paragraph and subpoint of acts; point of judgments; practice, a numbered cell of practice
    directions, on pages without articles. Headings 'Article N', and those of older consolidations, count on pages without
    ids of articles. Paragraphs are art_N.M, whether the page
    numbers them by id (NNN.MMM) or by a marker span; sub-points add their letter in brackets.
    """
    root = parsed(markup)
    out: dict[str, tuple[str, str, str]] = {}

    def add(unit: str, kind: str, text: str) -> None:
        if text:
            out.setdefault(unit, (unit, kind, text))

    def subpoints(paragraph: Node, unit: str) -> None:
        for n in paragraph.walk():
            cells = [c for c in n.children if isinstance(c, Node) and c.tag == "td"] if n.tag == "tr" else []
            if not cells and any(isinstance(c, Node) and c.has("grid-list-column-1") for c in n.children):
                cells = [c for c in n.children if isinstance(c, Node) and (c.has("grid-list-column-1") or c.has("grid-list-column-2"))]
            if len(cells) >= 2 and (m := re.fullmatch(r"\(?([A-Za-z])\)?", cells[0].text())):
                add(f"{unit}({m[1].lower()})", "subpoint", cells[1].text())

    article = ""
    nodes = list(root.walk())
    for n in nodes:
        unit = n.attrs.get("id") or n.attrs.get("eid") or ""
        if re.fullmatch(r"art_?\d+[A-Za-z]?", unit):
            article = "art_" + unit.removeprefix("art").lstrip("_").lower()
            add(article, "article", n.text())
            subpoints(n, article)
        elif re.fullmatch(r"anx_[IVXLC]+", unit):
            add(unit, "annex", n.text())
        elif m := re.fullmatch(r"(\d{3})\.(\d{3})", unit):
            name = f"art_{int(m[1])}.{int(m[2])}"
            add(name, "paragraph", n.text())
            subpoints(n, name)
        elif m := re.fullmatch(r"point(\d+)", unit):
            row = within(n, "tr")
            cells = [c for c in row.children if isinstance(c, Node) and c.tag == "td"] if row else []
            if len(cells) >= 2:
                add(f"point_{int(m[1])}", "point", cells[-1].text())
        elif n.tag == "p" and "C01Pointnumerote" in n.attrs.get("class", "") and (m := re.match(r"(\d+)\.?\s*(.*)", n.text())):
            add(f"point_{int(m[1])}", "point", m[2])
        elif n.has("norm") and not n.has("inline-element") and article:
            marks = [c for c in n.children if isinstance(c, Node) and c.tag == "span" and c.has("no-parag")]
            if marks and (m := re.match(r"(\d+)", marks[0].text())):
                inner = next((c for c in n.children if isinstance(c, Node) and c.has("inline-element")), None)
                name = f"{article}.{int(m[1])}"
                add(name, "paragraph", inner.text() if inner else n.text().removeprefix(marks[0].text()).strip())
                subpoints(n, name)

    if not any(n.attrs.get("id", "").startswith("art_") for n in nodes):
        for unit in legacy.units(nodes):
            add(*unit)
        headings = [n for n in nodes if n.tag == "p" and n.has("ti-art")]
        for n in headings:
            if m := re.match(r"Article (\w+)(?: |$)", n.text()):
                add("art_" + m[1].lower(), "article", after(n))
        if not headings and not divided(nodes):
            for n in nodes:
                if n.tag == "p" and (within(n, "td") or "oj-normal" in n.attrs.get("class", "")) and (m := re.fullmatch(r"(\d+)\.", n.text())):
                    row = within(n, "tr")
                    cells = [c for c in row.children if isinstance(c, Node) and c.tag == "td"] if row else []
                    if len(cells) >= 2:
                        add(f"point_{m[1]}", "practice", cells[-1].text())
    if any(n.tag == "div" and n.attrs.get("id") == "TexteOnly" for n in nodes):
        expected, grounds = 1, False
        for n in nodes:
            if (n.attrs.get("name") or n.attrs.get("id")) == "MO":
                grounds = True
            elif grounds and n.tag == "p" and (m := re.match(r"(\d{1,4})(?!\.)\s+(.+)$", n.text())) and int(m[1]) == expected:
                add(f"point_{expected}", "point", m[2])
                expected += 1
    return list(out.values())


def divided(nodes: list[Node]) -> bool:
    """Whether a page has headings of articles, by class or text; then a cell 'N.' is no unit."""
    return any(n.tag == "p" and (any(map(n.has, ("oj-ti-art", "ti-art", "title-article-norm"))) or HEADING.match(n.text())) for n in nodes)


def after(heading: Node) -> str:
    """Text of what follows a heading up to the next one."""
    around, parts = [c for c in heading.up.children if isinstance(c, Node)], []
    for n in around[next(k for k, c in enumerate(around) if c is heading) + 1 :]:
        if "ti-art" in n.attrs.get("class", ""):
            break
        parts.append(n.text())
    return " ".join(filter(None, parts))


def act_title(markup: str | None) -> str:
    """The first group of title lines of one class, at most 300 characters; empty if there is none."""
    found, wanted = [], ""
    for n in parsed(markup).walk():
        name = next((c for c in n.attrs.get("class", "").split() if c in TITLES), "")
        if not name:
            continue
        if wanted and name != wanted:
            break
        if text := n.text():
            wanted = name
            found.append(text)
            if len(found) >= TITLES[name]:
                break
    return " ".join(found)[:300].strip()


def judgment_text(markup: str | None) -> str:
    """Text of #judgment, else of the body, else of the whole page."""
    nodes = list(parsed(markup).walk())
    for found in (next((n for n in nodes if n.attrs.get("id") == "judgment"), None), next((n for n in nodes if n.tag == "body"), None)):
        if found and (text := found.text()):
            return text
    return nodes[0].text()


def notice_links(xml: str | None, relation: str) -> list[str] | None:
    """Ids of type celex of NOTICE/WORK/`relation`/SAMEAS/URI; None if it is no notice."""
    try:
        root = ElementTree.fromstring(xml or "")
    except ElementTree.ParseError:
        return None
    if root.tag != "NOTICE" or root.find("WORK") is None:
        return None
    links = root.iterfind(f"WORK/{relation}/SAMEAS/URI")
    return [name for u in links if (name := (u.findtext("IDENTIFIER") or "").strip()) and u.findtext("TYPE") == "celex"]


def page_texts(pages: DataFrame, key: str, markup: str) -> DataFrame:
    """key, title (of an act) and text (of a judgment) of all pages."""
    return flat(pages, [key], [markup], "title string, text string", lambda x: [(act_title(x), judgment_text(x))])


def unit_table(pages: DataFrame, key: str, markup: str) -> DataFrame:
    """key, unit_id, kind and text of all units of all pages."""
    return flat(pages, [key], [markup], "unit_id string, kind string, text string", units)


def akn_texts(xml: str | None) -> list[tuple[str, str]]:
    """(eId, text) of the elements of an Akoma Ntoso document that have one, the first of each; nothing if it is no XML."""
    try:
        root = ElementTree.fromstring((xml or "").strip())
    except ElementTree.ParseError:
        return []
    out: dict[str, str] = {}
    for n in root.iter():
        if (name := n.attrib.get("eId")) and name not in out:
            out[name] = re.sub(r"\s+", " ", "".join(n.itertext())).strip()
    return list(out.items())


def akn_table(pages: DataFrame, key: str, xml: str) -> DataFrame:
    """key, eid and text of all elements of Akoma Ntoso documents."""
    return flat(pages, [key], [xml], "eid string, text string", akn_texts)


def akn_find(table: DataFrame, key: str, asked: DataFrame, path: str) -> DataFrame:
    """Each asked (key, path) with its element by the spellings of an article's or a paragraph's eId in order; status ok, or path_not_found also where the element is empty."""
    clean = F.trim(path)
    names = F.when(clean != "", F.array(*(F.concat(F.lit(start), clean) for start in ("art_", "art", "para_", "para", ""))))
    each = asked.select(key, path, F.posexplode(names).alias("place", "name")).join(table.withColumnRenamed(key, "__key"), (F.col(key) == F.col("__key")) & (F.col("name") == F.col("eid")))
    best = each.groupBy(F.col(key).alias("__key"), F.col(path).alias("__path")).agg(F.min_by(F.struct("eid", "text"), "place").alias("unit"))
    found = asked.join(best, (F.col(key) == F.col("__key")) & (F.col(path) == F.col("__path")), "left").drop("__key", "__path")
    ok = F.coalesce(F.col("unit.text") != "", F.lit(False))
    return found.select(*asked.columns, F.when(ok, F.col("unit.eid")).alias("eid"), F.when(ok, F.col("unit.text")).alias("text"), F.when(ok, "ok").otherwise("path_not_found").alias("status"))


def find(table: DataFrame, key: str, asked: DataFrame, locator: str) -> DataFrame:
    """Each asked (key, locator) with its unit, by canonical locator: 5, 5(1), 5(1)(a), Annex II; status ok or path_not_found."""
    from versed.functions import ids

    parts = ids.locator(F.col(locator))
    unit = F.coalesce(
        F.concat(F.lit("anx_"), ids.annex(F.col(locator))),
        F.concat(F.lit("art_"), parts["article"], F.when(parts["para"].isNotNull(), F.concat(F.lit("."), parts["para"])).otherwise(""), F.when(parts["sub"].isNotNull(), F.concat(F.lit("("), parts["sub"], F.lit(")"))).otherwise("")),
        F.regexp_replace(F.trim(F.col(locator)), r"^point\s*", "point_"),
    )
    practice = table.where("kind = 'practice'").withColumn("unit_id", F.regexp_replace("unit_id", "^point_", "art_"))  # asked for as N
    found = asked.withColumn("unit_id", unit).join(table.unionByName(practice).withColumn("__found", F.lit(True)), [key, "unit_id"], "left")
    return found.withColumn("status", F.when(F.col("__found"), "ok").otherwise("path_not_found")).drop("__found")
