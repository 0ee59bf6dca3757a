"""Units of consolidated acts whose articles have no ids: what follows a heading, block by block, up to the next one.

Marks of modification are no text, wherever they stand. A table counts as its rows. A paragraph starts with the block whose
number is the last one plus 1; a sub-point is a block that starts with its letter, else a row or grid item inside a block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

# fixed values: classes of headings and of what ends a unit, and the shapes of numbers
ARTICLE, ANNEX, ENDS, SEPARATOR, MARK = "title-article-norm", "title-annex", ("title-article", "title-annex", "title-division"), "separator", "modref"
ARTICLE_NUMBER, ANNEX_NUMBER = re.compile(r"\d+[A-Za-z]?(?![A-Za-z\d])"), re.compile(r"\b([IVXLC]+|\d{1,2})\s*$")
PARAGRAPH, LETTER = re.compile(r"^(\d+)\.\s+"), re.compile(r"^\(([A-Za-z])\)\s*")


def classes(node) -> list[str]:
    return node.attrs.get("class", "").split()


def is_mark(node) -> bool:
    return node.tag == "p" and MARK in classes(node)


def plain(node) -> str:
    """Text without marks of modification; cells of a row are apart."""
    if node.tag == "tr":
        return " ".join(filter(None, (plain(c) for c in node.children if not isinstance(c, str) and c.tag in ("td", "th"))))
    out, todo = [], [node]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            out.append(n)
        elif n.tag not in ("script", "style") and not is_mark(n):
            todo += reversed(n.children)
    return re.sub(r"\s+", " ", "".join(out)).strip()


def ends(node) -> bool:
    start = {"p": ENDS, "hr": SEPARATOR}.get(node.tag)
    return start is not None and any(c.startswith(start) for c in classes(node))


def blocks(heading) -> Iterator[tuple[object, str]]:
    """The blocks between a heading and what ends its unit, with their texts."""
    seen = False
    for n in heading.up.children:
        if seen and not isinstance(n, str) and not is_mark(n):
            if ends(n):
                return
            for block in [r for r in n.walk() if r.tag == "tr"] if n.tag == "table" else [n]:
                if text := plain(block):
                    yield block, text
        seen = seen or n is heading


def letters(own: list[tuple[object, str]]) -> dict[str, str]:
    """Sub-points by letter."""
    found: dict[str, str] = {}
    for _, text in own:
        if m := LETTER.match(text):
            found.setdefault(m[1].lower(), text[m.end() :].strip())
    for block, _ in own:
        for n in block.walk():
            parts = [c for c in n.children if not isinstance(c, str)]
            pairs = [(c, parts[k + 1]) for k, c in enumerate(parts[:-1]) if (n.tag == "tr" and k == 0 and c.tag == parts[1].tag == "td") or ("grid-list-column-1" in classes(c) and "grid-list-column-2" in classes(parts[k + 1]))]
            for mark, body in pairs:
                name = plain(mark).strip("()").strip().lower()
                if re.fullmatch("[a-z]", name) and (text := plain(body)):
                    found.setdefault(name, text)
    return found


def units(nodes: list) -> Iterator[tuple[str, str, str]]:
    """(unit_id, kind, text) of articles, their paragraphs and sub-points, and annexes."""
    known = set()
    for n in nodes:
        if n.tag != "p" or n.up is None:
            continue
        if any(c.startswith(ANNEX) for c in classes(n)) and (m := ANNEX_NUMBER.search(plain(n))):
            yield f"anx_{m[1].upper()}", "annex", " ".join([plain(n), *(text for _, text in blocks(n))])
        elif ARTICLE in classes(n) and (m := ARTICLE_NUMBER.search(plain(n))) and m[0].lower() not in known:
            known.add(m[0].lower())
            article, own = f"art_{m[0].lower()}", list(blocks(n))
            yield article, "article", " ".join([plain(n), *(text for _, text in own)])
            yield from ((f"{article}({k})", "subpoint", text) for k, text in letters(own).items())
            starts = []
            for k, (_, text) in enumerate(own):
                if (m := PARAGRAPH.match(text)) and int(m[1]) == len(starts) + 1:
                    starts.append(k)
            for number, (i, j) in enumerate(zip(starts, [*starts[1:], len(own)], strict=True) if starts else (), 1):
                part = own[i:j]
                yield f"{article}.{number}", "paragraph", PARAGRAPH.sub("", " ".join(text for _, text in part), count=1)
                yield from ((f"{article}.{number}({k})", "subpoint", text) for k, text in letters(part).items())
