"""Fields out of job pages, with the standard library's HTML parser in Arrow-batched functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_SKIP = {"script", "style", "template", "noscript"}


class Node:
    """An element with attributes, children in order (elements and texts) and its parent."""

    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent

    @property
    def classes(self) -> set[str]:
        return set((self.attrs.get("class") or "").split())

    def texts(self) -> Iterator[str]:
        for c in self.children:
            if isinstance(c, str):
                yield c
            elif c.tag not in _SKIP:
                yield from c.texts()

    def text(self, joined: str = " ") -> str:
        """The pieces of text joined, blanks collapsed; with a line end as joint, blank lines dropped."""
        if joined == "\n":
            return "\n".join(t for x in self.texts() if (t := " ".join(x.split())))
        return " ".join(joined.join(self.texts()).split())

    def walk(self) -> Iterator[Node]:
        for c in self.children:
            if isinstance(c, Node):
                yield c
                yield from c.walk()

    def find_all(self, selector: str) -> list[Node]:
        """Elements by a chain of "tag.class[attr]" steps, each a descendant of the one before."""
        found = [self]
        for step in selector.split():
            tag, _, rest = step.partition("[")
            attr = rest.rstrip("]")
            tag, *classes = tag.split(".")
            nxt, seen = [], set()
            for n in found:
                for d in n.walk():
                    if (not tag or d.tag == tag) and set(classes) <= d.classes and (not attr or attr in d.attrs) and id(d) not in seen:
                        seen.add(id(d))
                        nxt.append(d)
            found = nxt
        return found


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("", {}, None)
        self.at = self.root

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_endtag(self, tag: str) -> None:
        n = self.at
        while n.parent is not None and n.tag != tag:
            n = n.parent
        if n.parent is not None:
            self.at = n.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str | None) -> Node:
    """The tree of a page; broken markup gives what could be read."""
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


def first_text(root: Node, selectors: list[str], joined: str = " ") -> str | None:
    """The text of the first selector that finds a non-empty element."""
    for s in selectors:
        for n in root.find_all(s):
            if t := n.text(joined):
                return t
    return None


def labelled(root: Node, labels: list[str], contains: bool = False) -> str | None:
    """The text that follows an element whose own text is (or contains) one of the labels, ignoring case and a colon."""
    for n in root.walk():
        own = n.text().rstrip(":").strip().lower()
        leaf = not any(isinstance(c, Node) and c.text() == n.text() for c in n.children)
        if leaf and own and len(own) < 80 and (any(x in own for x in labels) if contains else own in labels):
            after = n.parent.children[n.parent.children.index(n) + 1 :]
            for s in after:
                t = s.text() if isinstance(s, Node) else " ".join(s.split())
                if t.strip(": "):
                    return t.strip(": ")
    return None


def section(root: Node, headings: list[str]) -> str | None:
    """The text between a heading (h1 to h6) that contains one of the words and the next heading."""
    heads = {f"h{i}" for i in range(1, 7)}
    for n in root.walk():
        if n.tag in heads and any(x in n.text().lower() for x in headings):
            out = []
            for s in n.parent.children[n.parent.children.index(n) + 1 :]:
                if isinstance(s, Node) and s.tag in heads:
                    break
                out.append(s.text("\n") if isinstance(s, Node) else s.strip())
            if text := "\n".join(x for x in out if x):
                return text
    return None


def texts_of(root: Node, selector: str, exclude: tuple[str, ...] = ()) -> list[str]:
    """Distinct texts of all found elements in order, without those that contain an excluded word."""
    found = (n.text() for n in root.find_all(selector))
    return list(dict.fromkeys(t for t in found if t and not any(x in t.lower() for x in exclude)))


def links(root: Node) -> list[str]:
    """Distinct targets of job links in order: titles' anchors, data-url attributes and stretched links."""
    out = [n.attrs.get("href") for n in root.find_all("h3.title a")] + [n.attrs.get("data-url") for n in root.find_all("h3[data-url]")] + [n.attrs.get("href") for n in root.find_all("a.stretched-link")]
    return list(dict.fromkeys(x for x in out if x))


def last_page(root: Node) -> int:
    """The highest page number of the pagination, 1 if there is none."""
    numbers = [int(t) for n in root.find_all("a") if (t := n.text()).isdigit() and "page" in (n.attrs.get("href") or "")]
    return max(numbers, default=1)


def page_kind(root: Node) -> str:
    """login (a password field), listing (several job links and no job title) or job."""
    if any(n.attrs.get("type") == "password" for n in root.find_all("input")):
        return "login"
    return "listing" if not root.find_all("h1") and len(links(root)) > 1 else "job"


ROW = T.StructType([T.StructField(c, T.StringType()) for c in ("kind", "job_title", "company", "location", "salary", "job_description", "requirement")] + [T.StructField("required_skills", T.ArrayType(T.StringType()))])


def job_row(html: str | None) -> dict:
    """The fields of a job page; salary falls back to "Not Found", missing texts are null."""
    root = parse(html)
    return {
        "kind": page_kind(root), "job_title": first_text(root, ["h1.job-title", "h1.title", "h1"]), "company": first_text(root, ["a.company", "div.company-name", "h2.company"]) or labelled(root, ["company", "công ty"]),
        "location": " - ".join(texts_of(root, "span.location", ("remote", "oversea"))) or labelled(root, ["location", "địa điểm", "địa điểm làm việc"]),
        "salary": first_text(root, ["span.salary", "div.salary"]) or labelled(root, ["salary", "mức lương", "thu nhập"]) or "Not Found",
        "job_description": section(root, ["job description", "mô tả công việc"]), "requirement": section(root, ["your skills", "requirement", "yêu cầu"]), "required_skills": texts_of(root, "a.tag"),
    }


def column(function: Callable[[str | None], object], returns: T.DataType | str):
    """`function` of one page as a column function."""

    if isinstance(returns, T.StructType):

        @F.pandas_udf(returns)
        def rows(pages: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([function(p) for p in pages], columns=returns.fieldNames())

        return rows

    @F.pandas_udf(returns)
    def values(pages: pd.Series) -> pd.Series:
        return pd.Series([function(p) for p in pages], dtype=object)

    return values


def pairs_of(root: Node, row: str, name: str, value: str) -> dict[str, str]:
    """The map of a sidebar: of each element `row` the text of its first `name` to that of its first `value`; the first row of a name counts."""
    out: dict[str, str] = {}
    for n in root.find_all(row):
        k, v = (first_text(n, [s]) for s in (name, value))
        if k and v:
            out.setdefault(k.rstrip(":").strip(), v)
    return out


def without(root: Node, tags: tuple[str, ...]) -> Node:
    """The tree without elements of these tags; `root` is changed."""
    root.children = [c for c in root.children if not (isinstance(c, Node) and c.tag in tags)]
    for c in root.children:
        if isinstance(c, Node):
            without(c, tags)
    return root


BRAND_ROW = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("url", "job_title", "company", "location", "salary", "experience", "education", "level", "employment_type", "industry", "specialization", "job_description", "requirement")]
    + [T.StructField(c, T.ArrayType(T.StringType())) for c in ("required_skills", "preferred_skills")]
)


def brand_row(html: str | None) -> dict:
    """The fields of a company's own page of a job; its url is left to the caller, skill lists are empty, missing texts null, a missing salary "Not Found".

    Icons and spans inside the title are no part of it. Overview fields stand beside their labels.
    """
    root = parse(html)
    title = next((without(n, ("span", "i", "svg")).text() for s in ("h1", "h2.title", "h2") for n in root.find_all(s)), "") or None
    beside = lambda *labels: labelled(root, list(labels))
    return {
        "url": None, "job_title": title, "company": first_text(root, ["div.company-name", "a.company", "h2.company"]), "location": section(root, ["địa điểm", "location"]) or beside("địa điểm", "location"),
        "salary": beside("mức lương", "thu nhập", "salary") or "Not Found", "experience": beside("kinh nghiệm", "experience"), "education": beside("học vấn", "education"), "level": beside("cấp bậc", "level"),
        "employment_type": beside("hình thức làm việc", "hình thức", "employment"), "industry": beside("ngành nghề", "lĩnh vực", "industry"), "specialization": beside("chuyên môn", "specialization"),
        "job_description": section(root, ["mô tả", "description"]), "requirement": section(root, ["yêu cầu", "requirement"]), "required_skills": [], "preferred_skills": [],
    }


def crawl_links(pages: DataFrame, done: DataFrame) -> DataFrame:
    """(tag, link): distinct links of the pages (tag, html) whose tag isn't in `done` (tag), in order of tag and link."""
    todo = pages.join(done.select("tag").distinct(), "tag", "left_anti")
    found = todo.select("tag", F.explode(column(lambda p: links(parse(p)), "array<string>")(F.col("html"))).alias("link"))
    return found.distinct().orderBy("tag", "link")
